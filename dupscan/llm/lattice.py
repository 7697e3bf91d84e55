"""Language-model scores by the likelihood of the subword lattice.

A text is a path through the lattice of its segmentations: for each word a first piece (of those that begin with a space),
inner pieces and a stop, then one end. Its probability is the sum over all segmentations of the product of their pieces'
probabilities, by a forward recursion in log space. First pieces and end add up to 1, inner pieces and stop too, so texts do
as well; every byte is a piece, so there are no unknown words. No piece goes over white space, so the sum over a text's
segmentations is the product of the sums over its words', and each distinct word is worked off once.

The pieces are those of an existing vocabulary, whose scores (its ranks, read as a Zipf law) are the start and, with the
weight of PRIOR words, the prior; they are carried on to the training rows by ROUNDS steps of expectation maximisation over
their words, each as often as it occurs. No segmentation is trained.

A second score lets one more arc lead across each whole word of training: the word's count less a discount, whose total
is what the lattice shares out.

Texts are worked off in blocks of BLOCK_BYTES. A block passes on one row for each of its distinct words, with the
places where it occurs, so a frequent word makes one row a block; the rows meet the words' counts and probabilities in
a join, and each block's rows come together again, in a task that holds one block at a time. Ends, which all texts have, are in
no join.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from math import exp, inf, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, LongType, StructField, StructType

from dupscan.llm.common import drop_scratch, free_shuffles, scratch, unmeasured_batches, word_chunks

#: Bytes of text of a block, about, and its documents at most (a place has two bytes for them).
BLOCK_BYTES, BLOCK_ROWS = 32 << 20, 1 << 16
#: Steps of expectation maximisation, and the weight of the vocabulary's own scores in words.
ROUNDS, PRIOR = 2, 500.0
#: Cells (words x bytes) of a lattice that are worked off at once; longer words go one by one, CHUNK bytes at once.
CELLS, LONG_WORD, CHUNK = 1 << 19, 2048, 1 << 15
_MULTIPLIER, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_PLACE, MOST = np.dtype([("doc", "<u2"), ("n", "<u2")]), (1 << 16) - 1


class Pieces:
    """The distinct bodies of a vocabulary's pieces, numbered, and how to find them in many words at once."""

    def __init__(self, bodies: list[bytes]):
        self.bodies = bodies
        self.number = {b: i for i, b in enumerate(bodies)}
        keys = np.array([self._key(b) for b in bodies], np.uint64)
        self.order = np.argsort(keys).astype(np.int32)
        self.keys = keys[self.order]
        self.maybe = np.zeros(1 << 21, bool)
        self.maybe[self.keys >> np.uint64(43)] = True
        #: Bytes of the longest piece.
        self.longest = max(map(len, bodies))

    @staticmethod
    def _key(body: bytes) -> int:
        h = 0
        for b in body:
            h = ((h ^ (b + 1)) * int(_MULTIPLIER)) & (2**64 - 1)
            h ^= h >> 29
        return (h * int(_MIX)) & (2**64 - 1)

    def find(self, words: np.ndarray) -> list[list[tuple[np.ndarray, np.ndarray]]]:
        """found[i][m - 1]: columns of words in which the m bytes from row i are a piece, and its number there.

        words: a column of bytes each.
        """
        width = len(words)
        found: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(width)]
        b, h = words.astype(np.uint64) + np.uint64(1), np.zeros(words.shape, np.uint64)
        for m in range(1, min(self.longest, width) + 1):
            h = (h[: width - m + 1] ^ b[m - 1 :]) * _MULTIPLIER
            h ^= h >> np.uint64(29)
            key = h * _MIX
            row, column = np.nonzero(self.maybe[key >> np.uint64(43)])
            some = key[row, column]
            place = np.minimum(np.searchsorted(self.keys, some), len(self.keys) - 1)
            hit = self.keys[place] == some
            row, column, ids = row[hit], column[hit], self.order[place[hit]]
            cuts = np.searchsorted(row, np.arange(width - m + 2))
            for i in range(width - m + 1):
                found[i].append((column[cuts[i] : cuts[i + 1]], ids[cuts[i] : cuts[i + 1]]))
        return found


    def hits(self, word: bytes, begin: int, end: int) -> list[list[tuple[int, int]]]:
        """For each i from begin to end: (end, number) of the pieces that begin at i of a word."""
        stretch = np.frombuffer(word[begin : end + self.longest], np.uint8)
        b, h = stretch.astype(np.uint64) + np.uint64(1), np.zeros(len(stretch), np.uint64)
        out: list[list[tuple[int, int]]] = [[] for _ in range(end - begin)]
        for m in range(1, min(self.longest, len(stretch)) + 1):
            h = (h[: len(stretch) - m + 1] ^ b[m - 1 :]) * _MULTIPLIER
            h ^= h >> np.uint64(29)
            key = h[: end - begin] * _MIX
            place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            for i in np.flatnonzero(self.keys[place] == key).tolist():
                out[i].append((begin + i + m, int(self.order[place[i]])))
        return out


def load_pieces(path: str) -> tuple[Pieces, np.ndarray, np.ndarray]:
    """Pieces of a rank file, and the log-probabilities that its ranks stand for: (inner, first), -inf where not allowed.

    Pieces with capitals A-Z or with white space but for one leading space are in no text as it is scored. The stop is last of
    the inner ones, the bare space and the end are last of the first ones; each has the weight of the best piece.
    """
    inner: dict[bytes, float] = {}
    first: dict[bytes, float] = {}
    with open(path, "rb") as f:
        for token, rank in map(bytes.split, f):
            token, weight = base64.b64decode(token), 1 / (1 + int(rank))
            side, body = (first, token[1:]) if token[:1] == b" " else (inner, token)
            if body and body == body.lower() and not any(c in b" \t\n\x0b\x0c\r" for c in body):
                side[body] = weight
    for b in range(256):
        inner.setdefault(bytes([b]), 1e-6)
    bodies = sorted(inner.keys() | first.keys())
    log_of = lambda d, x: log(d[x]) if x in d else -inf
    start_inner = np.array([log_of(inner, x) for x in bodies] + [0.0])
    start_first = np.array([log_of(first, x) for x in bodies] + [0.0, 0.0])
    return Pieces(bodies), _normal(start_inner), _normal(start_first)


def _normal(logs: np.ndarray) -> np.ndarray:
    top = logs.max()
    return logs - (top + np.log(np.exp(logs - top).sum()))


class Model:
    """inner: log-probability of each inner piece, then the stop; first: of each first piece, then the bare space and the end."""

    def __init__(self, pieces: Pieces, inner: np.ndarray, first: np.ndarray):
        self.pieces, self.inner, self.first = pieces, inner, first
        self.stop, self.bare, self.end = float(inner[-1]), float(first[-2]), float(first[-1])

    def _alpha(self, found: list, n: int) -> np.ndarray:
        """alpha[j]: log-probability of the first j bytes of each word, over all ways to cut them."""
        alpha = np.full((len(found) + 1, n), -inf)
        alpha[0] = self.bare
        for i, ends in enumerate(found):
            for m, (at, ids) in enumerate(ends, 1):
                if len(at):
                    way = alpha[i, at] + self.inner[ids]
                    if not i:
                        way = np.logaddexp(way, self.first[ids])
                    alpha[i + m, at] = np.logaddexp(alpha[i + m, at], way)
        return alpha

    @staticmethod
    def _shelves(words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Words of like lengths: (their numbers, their bytes, padded, a column each, their lengths)."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        steps = np.r_[np.arange(2, 33, 2), 48, 64, 96, 128, 256, 512, 1024, LONG_WORD]
        shelf = np.searchsorted(steps, lengths)
        for s in np.unique(shelf[lengths <= LONG_WORD]):
            width = int(steps[s])
            at = np.flatnonzero(shelf == s)
            for k in range(0, len(at), max(1, CELLS // width)):
                own = at[k : k + max(1, CELLS // width)]
                raw = np.frombuffer(b"".join(words[i].ljust(width, b" ") for i in own), np.uint8)
                yield own, np.ascontiguousarray(raw.reshape(len(own), width).T), lengths[own]

    def score(self, words: list[bytes]) -> np.ndarray:
        """Log of the lattice probability of each word."""
        out = np.empty(len(words))
        for own, raw, lengths in self._shelves(words):
            out[own] = self._alpha(self.pieces.find(raw), len(own))[lengths, np.arange(len(own))]
        for i, w in enumerate(words):
            if len(w) > LONG_WORD:
                out[i] = self._long(w)
        return out + self.stop

    def _forward(self, word: bytes) -> np.ndarray:
        """_alpha of one long word."""
        alpha = np.full(len(word) + 1, -inf)
        alpha[0] = self.bare
        for at in range(0, len(word), CHUNK):
            end = min(at + CHUNK, len(word))
            for i, found in enumerate(self.pieces.hits(word, at, end), at):
                for j, k in found:
                    way = alpha[i] + self.inner[k]
                    alpha[j] = np.logaddexp(alpha[j], np.logaddexp(way, self.first[k]) if not i else way)
        return alpha

    def _long(self, word: bytes) -> float:
        """_alpha's last value for one long word."""
        return float(self._forward(word)[-1])

    def _expected_long(self, word: bytes, inner: np.ndarray, first: np.ndarray, weight: float) -> None:
        """Add to inner and first the expected uses of one long word."""
        alpha, beta = self._forward(word), np.full(len(word) + 1, -inf)
        beta[-1], total = 0.0, alpha[-1]
        for at in reversed(range(0, len(word), CHUNK)):
            found = self.pieces.hits(word, at, min(at + CHUNK, len(word)))
            for i in range(at + len(found) - 1, at - 1, -1):
                for j, k in found[i - at]:
                    way = self.inner[k] + beta[j]
                    inner[k] += weight * exp(alpha[i] + way - total)
                    beta[i] = np.logaddexp(beta[i], way)
                    if not i:
                        first[k] += weight * exp(self.first[k] + beta[j] - total)
        first[-2] += weight * exp(alpha[0] + beta[0] - total)
        inner[-1] += weight

    def expected(self, words: list[bytes], weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Expected uses of each piece (inner and stop, first and bare space) over words that occur as often as weights say."""
        n = len(self.pieces.bodies)
        inner, first = np.zeros(n + 1), np.zeros(n + 2)
        for w, x in zip(words, weights.tolist(), strict=True):
            if len(w) > LONG_WORD:
                self._expected_long(w, inner, first, x)
        for own, raw, lengths in self._shelves(words):
            found, each, x = self.pieces.find(raw), np.arange(len(own)), weights[own].astype(np.float64)
            alpha = self._alpha(found, len(own))
            total = alpha[lengths, each]
            beta = np.full(alpha.shape, -inf)
            beta[lengths, each] = 0.0
            for i in range(len(found) - 1, -1, -1):
                for m, (at, ids) in enumerate(found[i], 1):
                    if not len(at):
                        continue
                    rest = beta[i + m, at]
                    way = self.inner[ids] + rest
                    inner += np.bincount(ids, x[at] * np.exp(alpha[i, at] + way - total[at]), n + 1)
                    beta[i, at] = np.logaddexp(beta[i, at], way)
                    if not i:
                        first += np.bincount(ids, x[at] * np.exp(self.first[ids] + rest - total[at]), n + 2)
            inner[n] += x.sum()
            first[n] += (x * np.exp(alpha[0] + beta[0] - total)).sum()
        return inner, first


def _tokens(text: str | None) -> Iterator[list[bytes]]:
    yield from word_chunks((text or "").encode().lower())


def _pack(ids: pa.Array) -> bytes:
    """An array as bytes, which pass between Spark and Python faster than lists."""
    sink, batch = pa.BufferOutputStream(), pa.record_batch([ids], ["id"])
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpack(raw: bytes) -> pa.Array:
    return pa.ipc.open_stream(raw).read_all().column("id").combine_chunks()


def _blocks(id_type: pa.DataType):
    """Batches of (id, text, train) -> rows (block, word, places, train, ids); one row a block has no word, but its ids and training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        names = ["block", "word", "places", "train", "ids"]
        flat, ids, known, size, made = [], [], [], 0, 0
        vocabulary: dict[bytes, int] = {}
        take = vocabulary.get

        def done() -> Iterator[pa.RecordBatch]:
            own = pa.array([number + made])
            yield pa.RecordBatch.from_arrays([own, pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary()), pa.array([sum(known)], pa.int64()), pa.array([_pack(pa.array(ids, id_type))], pa.binary())], names)
            docs = np.repeat(np.arange(len(flat), dtype=np.int64), [len(x) for x in flat])
            pairs, n = np.unique((np.concatenate(flat).astype(np.int64) << 16) | docs, return_counts=True)
            train = np.bincount(pairs >> 16, n * np.array(known, bool)[pairs & 0xFFFF], len(vocabulary)).astype(np.int64)
            parts = -(-n // MOST)  # a place holds up to MOST; more take several
            last = np.cumsum(parts) - 1
            pairs = np.repeat(pairs, parts)
            places = np.empty(len(pairs), _PLACE)
            places["doc"], places["n"] = pairs & 0xFFFF, MOST
            places["n"][last] = n - (parts - 1) * MOST
            ends = _PLACE.itemsize * np.r_[0, np.cumsum(np.bincount(pairs >> 16, minlength=len(vocabulary)))]
            keys, raw = list(vocabulary), places.tobytes()
            for a in range(0, len(keys), 1 << 16):
                b = min(a + (1 << 16), len(keys))
                offsets = pa.array((ends[a : b + 1] - ends[a]).astype(np.int32)).buffers()[1]
                packed = pa.Array.from_buffers(pa.binary(), b - a, [None, offsets, pa.py_buffer(raw[ends[a] : ends[b]])])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(b - a, number + made)), pa.array(keys[a:b], pa.binary()), packed, pa.array(train[a:b]), pa.nulls(b - a, pa.binary())], names)

        for batch in batches:
            for key, text, train in zip(*(batch.column(c).to_pylist() for c in ("id", "text", "train")), strict=True):
                got = []
                for words in _tokens(text):
                    got += [i if (i := take(w)) is not None else vocabulary.setdefault(w, len(vocabulary)) for w in words]
                flat.append(np.array(got, np.int32))
                ids.append(key)
                known.append(train)
                size += len(text or "")
                if size >= BLOCK_BYTES or len(flat) == BLOCK_ROWS:
                    yield from done()
                    flat, ids, known, size, made = [], [], [], 0, made + 1
                    vocabulary.clear()
        if flat:
            yield from done()

    return run


def _word_logs(lattice: np.ndarray, c: np.ndarray, discount: float, total: int, free: float) -> np.ndarray:
    """Log-probability of tokens: their discounted counts and their share of the lattice (its log), added up in log space."""
    with np.errstate(divide="ignore"):
        return np.logaddexp(np.log(np.maximum(c - discount, 0) / max(total, 1)), np.log(free) + lattice)


def _columns(c: np.ndarray, lattice: np.ndarray, total: int, distinct: int, discount: float, free: float) -> tuple[np.ndarray, ...]:
    """What one token of count c and lattice log-probability adds to n_tokens, n_known, base_score, score and word_score."""
    base = np.log10((c + 0.1) / (total + 0.1 * (distinct + 1)))
    return np.ones(len(c)), (c > 0).astype(float), base, lattice / log(10), _word_logs(lattice, c, discount, total, free) / log(10)


def _assemble(ends: int, end: float, of: tuple):
    """Rows sorted by block -> a row a document; ends: count of the end, end: its log-probability, of: what _columns needs."""
    own = np.concatenate(_columns(np.array([float(ends)]), np.array([end]), *of))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, ids = None, None
        sums = np.zeros((5, BLOCK_ROWS))

        def done() -> pa.RecordBatch:
            tokens, known, *scores = sums[:, : len(ids)] + own[:, None]
            return pa.RecordBatch.from_arrays([ids, pa.array(tokens.astype(np.int64)), pa.array(known.astype(np.int64)), *map(pa.array, scores)], ["id", "n_tokens", "n_known", "base_score", "score", "word_score"])

        for batch in batches:
            b = batch.column("block").to_numpy()
            cuts = np.r_[np.flatnonzero(np.r_[True, b[1:] != b[:-1]]), len(b)] if len(b) else []
            for x, y in zip(cuts, cuts[1:], strict=False):
                part = batch.slice(x, y - x)
                if b[x] != block:
                    if block is not None:
                        yield done()
                    block, ids = b[x], None
                    sums[:] = 0
                for v in part.column("ids").drop_null().to_pylist():
                    ids = _unpack(v)
                part = part.filter(part.column("ids").is_null())
                packed = part.column("places").to_pylist()
                places = np.frombuffer(b"".join(packed), _PLACE)
                at = np.repeat(np.arange(len(part)), [len(p) // _PLACE.itemsize for p in packed])
                n, doc = places["n"].astype(np.float64), places["doc"]
                for k, v in enumerate(_columns(part.column("c").to_numpy().astype(np.float64), part.column("lattice").to_numpy(), *of)):
                    sums[k] += np.bincount(doc, n * v[at], BLOCK_ROWS)
        if block is not None:
            yield done()

    return run


def fit(words: DataFrame, path: str, ends: int, rounds: int = ROUNDS) -> Model:
    """Fit the pieces' probabilities to a table of distinct words and their counts (word, c), and to the number of texts."""
    pieces, prior_inner, prior_first = load_pieces(path)
    model = Model(pieces, prior_inner, prior_first)
    n = len(pieces.bodies)

    for _ in range(rounds):

        def step(batches: Iterator[pa.RecordBatch], model: Model = model) -> Iterator[pa.RecordBatch]:
            both = np.zeros(2 * n + 3)
            for batch in batches:
                both += np.concatenate(model.expected(batch.column("word").to_pylist(), batch.column("c").to_numpy()))
            some = np.flatnonzero(both)
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(both[some])], ["piece", "uses"])

        used = np.zeros(2 * n + 3)
        # one row for each piece at most: the vocabulary bounds what the driver gets
        for r in words.select("word", "c").mapInArrow(step, "piece int, uses double").groupBy("piece").agg(F.sum("uses").alias("uses")).collect():
            used[r.piece] = r.uses
        used[-1] = ends
        with np.errstate(divide="ignore"):
            inner = np.log(used[: n + 1] + PRIOR * np.exp(prior_inner))
            first = np.log(used[n + 1 :] + PRIOR * np.exp(prior_first))
        model = Model(pieces, _normal(inner), _normal(first))
    return model


def score_texts(docs: DataFrame, training: Column, path: str, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """One row per row of docs: (id, n_tokens, n_known, train_tokens, base_score, score, word_score).

    training (a condition on the id column) says which rows to learn from. Words are the runs without white space, A-Z
    lower-cased, then one end; null and empty texts are an end alone. n_known counts tokens that training has; base_score is
    the log10 probability under the word model with 0.1 added to every count, score that of the lattice, word_score that of the lattice with
    arcs across the words of training. Repeated rows are scored, and learnt from, as often as they occur. With nothing to learn
    from, scores are those of the vocabulary. An empty table gives an empty result. Other columns of docs are not read.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    key = docs.schema[id_col]
    id_type = to_arrow_type(key.dataType)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(training, F.lit(False)).alias("train"))
    schema = StructType([StructField("block", LongType()), StructField("word", BinaryType()), StructField("places", BinaryType()), StructField("train", LongType()), StructField("ids", BinaryType())])
    postings = scratch(rows.mapInArrow(_blocks(id_type), schema), "postings")
    counts = scratch(postings.where("word is not null").groupBy("word").agg(F.sum("train").alias("c")), "counts")
    free_shuffles(docs)
    ends = postings.where("word is null").agg(F.sum("train")).first()[0] or 0
    of = counts.agg(F.sum("c").alias("n"), *(F.count_if(F.expr(f"c {x}")).alias(k) for k, x in (("v", "> 0"), ("once", "= 1"), ("twice", "= 2")))).first()
    total, distinct, once, twice = (of.n or 0) + ends, of.v + (ends > 0), of.once + (ends == 1), of.twice + (ends == 2)
    model = fit(counts.where("c > 0"), path, ends, rounds)
    discount = max(0.1, min(0.9, once / (once + 2 * twice))) if once else 0.5
    free = discount * distinct / total if total else 1.0  # what the discounts leave to the lattice

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("c"), pa.array(model.score(batch.column("word").to_pylist()))], ["word", "c", "lattice"])

    scored = scratch(counts.mapInArrow(score, "word binary, c bigint, lattice double"), "scored")
    drop_scratch(counts)
    met = postings.join(scored, "word").select("block", "places", "ids", "c", "lattice")
    met = met.union(postings.where("word is null").select("block", "places", "ids", F.lit(None).cast("bigint"), F.lit(None).cast("double")))
    out_schema = StructType([StructField("id", key.dataType), *(StructField(k, LongType()) for k in ("n_tokens", "n_known")), *(StructField(k, DoubleType()) for k in ("base_score", "score", "word_score"))])
    # a block bounds what its rows hold together
    with unmeasured_batches(docs.sparkSession):
        out = scratch(met.repartition("block").sortWithinPartitions("block").mapInArrow(_assemble(ends, model.end, (total, distinct, discount, free)), out_schema), "scores")
    for x in (postings, scored):
        drop_scratch(x)
    free_shuffles(docs)
    return out.select(F.col("id").alias(id_col), "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score", "word_score")
