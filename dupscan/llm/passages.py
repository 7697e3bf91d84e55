"""Passages that documents share, found by collinear chaining of k-mer seeds.

1. Seeds. Of the hashed SEED-word k-mers of a text those stay that are least in some WINDOW successive ones, so two texts
   that agree in SEED + WINDOW - 1 successive words have a seed there in common. A passage of MIN_WORDS words or more whose
   five-word shingles agree to SIMILARITY has such a stretch between its edits.
2. Join. Every occurrence of a seed is matched with one other, the seed's first (in the document of the smallest key),
   so a seed with n occurrences makes n - 1 matches (in periodic text: of those that are as long). Firsts are found by partial aggregation, and the join is one
   whose hot keys adaptive execution can split.
3. Chains. Documents are cut into stretches of CORE words, so that no pair is large; matches of a pair of stretches are
   chained by a Fenwick tree of prefix maxima: a chain's score is its seeds' words less GAP for every word between.
4. Alignment. A chain's seeds grow into runs of equal words, and over small edits into further runs, up to MARGIN words
   beyond the stretch; runs are cut where their five-word shingles agree too little. What is long enough is a passage. As
   it grows beyond its seeds, it is found even if all of its other seeds have their firsts elsewhere.
5. The rest. A seed's first may be a document that has the seed but not the passage. Around seed occurrences outside all
   passages found so far, documents are matched again by longer keys, each with the first document that has the key: all
   windows of MIN_WORDS words, whose first is sure to have a passage, and pairs of seeds NEAR to FAR words apart, which may
   lie on both sides of an edit. Then steps 3 and 4 as before. What lies within a run of equal words is also in the document of
   smaller key that the run leads to, so keys there are left out: copies have none.

So of a stretch of MIN_WORDS or more successive words that documents share, all but the first have passages that cover it, but for at
most SEED words at either end: where all of its seeds lie in passages it is not matched again, and seeds leave no more than
that uncovered; else its windows meet their firsts. Edited passages are found if one of their seeds, windows or pairs has
a first that has the passage.

A passage is a copy of one in another document, which is never one of a larger key: cutting all copies out leaves
each passage in the documents that have it first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dupscan.llm.common import drop_scratch, files_for, free_shuffles, scratch, word_chunks

#: Words of a seed, and successive seeds of which the least stays.
SEED, WINDOW = 10, 11
#: Words of a passage at least, words of its shingles, and how far those must agree (Jaccard).
MIN_WORDS, SHINGLE, SIMILARITY = 50, 5, 0.8
#: Words from one seed of a pair to the other: any 50 successive words have seeds NEAR words apart.
NEAR, FAR = 20, 64
#: Words of the longest period at which text counts as periodic.
PERIOD = 16
#: Words of a stretch, and beyond it on either side.
CORE, MARGIN = 1024, 80
#: Cost of a word of a gap, in words of seeds.
GAP = 0.1
#: Words that an edit may leave out or put in, and equal words that end it.
EDIT, RESUME = 8, 4
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(text: str | None) -> np.ndarray:
    """64-bit hashes of the words of a text, A-Z lower-cased."""
    from xxhash import xxh3_64_intdigest

    parts = [np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words)) for words in word_chunks((text or "").encode().lower())]
    return np.concatenate(parts) if parts else np.empty(0, np.uint64)


def seeds(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys, positions) of a text's seeds."""
    n = len(words) - SEED + 1
    if n < 1:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    h = np.zeros(n, np.uint64)
    for j in range(SEED):
        h = (h ^ words[j : j + n]) * _MULTIPLIER
        h ^= h >> np.uint64(29)
    if n <= WINDOW:
        at = np.array([int(h.argmin())])
    else:
        least = np.lib.stride_tricks.sliding_window_view(h, WINDOW)
        at = np.concatenate([least[i : i + (1 << 16)].argmin(1) + np.arange(i, min(i + (1 << 16), len(least))) for i in range(0, len(least), 1 << 16)])
        at = np.unique(at)
    return _marked(h[at], at, words), at


def _marked(keys: np.ndarray, at: np.ndarray, words: np.ndarray) -> np.ndarray:
    """keys, changed where the MIN_WORDS words from there are periodic.

    A seed within a run of one word (or of a few) has its first wherever such a run is, however short. Marked, it has it in
    a run that is long enough to be a passage.
    """
    if len(np.unique(keys)) == len(keys) or len(words) < MIN_WORDS:
        return keys
    periodic = np.zeros(len(at), bool)
    for q in range(1, PERIOD + 1):
        odd = np.r_[np.flatnonzero(words[:-q] != words[q:]), len(words) - q]
        periodic |= odd[np.minimum(np.searchsorted(odd, at), len(odd) - 1)] - at >= MIN_WORDS - q
    return np.where(periodic, (keys ^ _MULTIPLIER) * _MULTIPLIER, keys)


def seeds_of_all(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, key, position) of the seeds of texts of MIN_WORDS words or more, as seeds finds them one by one; ~position where the text has had the key before."""
    words = np.concatenate(texts)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    begin = np.cumsum(sizes) - sizes
    n = len(words) - SEED + 1
    h = np.zeros(n, np.uint64)
    for j in range(SEED):
        h = (h ^ words[j : j + n]) * _MULTIPLIER
        h ^= h >> np.uint64(29)
    # least hashes of 1, 2, 4, 8, then WINDOW successive places
    least, width = h, 1
    while 2 * width <= WINDOW:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    least = np.minimum(least[: n - WINDOW + 1], least[WINDOW - width : WINDOW - width + n - WINDOW + 1])
    # windows that lie in one text
    inside = np.zeros(len(words) + 1, np.int64)
    np.add.at(inside, begin, 1)
    np.add.at(inside, begin + sizes - SEED - WINDOW + 2, -1)
    open_ = np.flatnonzero(np.cumsum(inside)[: n - WINDOW + 1] > 0)
    found = []
    for k in range(WINDOW):  # the first place that has the least hash
        hit = h[open_ + k] == least[open_]
        found.append(open_[hit] + k)
        open_ = open_[~hit]
    at = np.unique(np.concatenate(found))
    of = np.searchsorted(begin, at, "right") - 1
    key, pos = h[at], at - begin[of]
    order = np.lexsort((key, of))
    again = np.zeros(len(at), bool)
    again[order[1:]] = (key[order][1:] == key[order][:-1]) & (of[order][1:] == of[order][:-1])
    for i in np.unique(of[again]).tolist():
        own = slice(*np.searchsorted(of, [i, i + 1]))
        key[own] = _marked(key[own], pos[own], texts[i])
        again[own] = True
        again[own.start + np.unique(key[own], return_index=True)[1]] = False
    return of, key, np.where(again, ~pos, pos)


def _seed_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, text) -> (key, node, pos); pos is ~pos where the key has occurred in the text before."""
    for batch in batches:
        nodes: list[int] = []
        texts: list[np.ndarray] = []
        size = 0

        def done() -> pa.RecordBatch:
            of, key, pos = seeds_of_all(texts)
            return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(np.array(nodes, np.int64)[of]), pa.array(pos.astype(np.int32))], ["key", "node", "pos"])

        for node, text in zip(batch.column("node").to_pylist(), batch.column("text").to_pylist(), strict=True):
            words = word_hashes(text)
            if len(words) >= MIN_WORDS:
                nodes.append(node)
                texts.append(words)
                size += len(words)
            if size >= 1 << 18:
                yield done()
                nodes, texts, size = [], [], 0
        if texts:
            yield done()


def long_keys(words: np.ndarray, keys: np.ndarray, at: np.ndarray, state: np.ndarray, exact: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(keys, positions, spans, open) of the windows of MIN_WORDS words and the pairs of seeds of a text.

    keys, at (ascending) and state are of its seeds that other texts have too; state is 0 for those whose occurrences all lie in
    passages already, OPEN where this one doesn't, else in between. Only what holds a seed above 0 has a key. A span leads to the
    last seed's place. What lies in one of the exact stretches (start, end), sorted, has no key. Of equal windows that overlap
    (periodic text), the first and the last stay.
    """
    begins, ends = exact[:, 0], np.maximum.accumulate(exact[:, 1])
    low, high = np.searchsorted(at, at + NEAR), np.searchsorted(at, at + FAR, "right")
    i = np.repeat(np.arange(len(at)), high - low)
    j = np.arange(len(i)) - np.repeat(np.cumsum(high - low) - (high - low), high - low) + np.repeat(low, high - low)
    some = np.maximum(state[i], state[j]) > 0
    if len(exact):
        before = np.searchsorted(begins, at[i], "right") - 1
        some &= (before < 0) | (ends[before] < at[j] + SEED)
    i, j = i[some], j[some]
    h = (keys[i] ^ np.uint64(SEED)) * _MULTIPLIER
    h ^= h >> np.uint64(29)
    pairs = (h ^ keys[j]) * _MULTIPLIER, at[i], at[j] - at[i], np.maximum(state[i], state[j]) == OPEN
    last = len(words) - MIN_WORDS
    if last < 0:
        return pairs
    # a window has seeds at most WINDOW words apart, the outer ones at most WINDOW - 1 from where a seed can begin and end
    runs = np.split(np.arange(len(at)), np.flatnonzero(np.diff(at) > WINDOW) + 1)
    reach = MIN_WORDS - SEED
    shared, near, open_, held = (np.zeros(last + 2, np.int64) for _ in range(4))

    def add(to: np.ndarray, begin: np.ndarray, end: np.ndarray) -> None:
        begin, end = np.clip(begin, 0, last + 1), np.clip(end + 1, 0, last + 1)
        np.add.at(to, begin[begin < end], 1)
        np.add.at(to, end[begin < end], -1)

    add(shared, np.array([at[r[0]] for r in runs]) - (WINDOW - 1), np.array([at[r[-1]] for r in runs]) - reach + WINDOW - 1)
    for to, least in ((near, 1), (open_, OPEN)):
        add(to, at[state >= least] - reach, at[state >= least])
    add(held, exact[:, 0], exact[:, 1] - MIN_WORDS)
    start = np.flatnonzero((np.cumsum(shared)[:-1] > 0) & (np.cumsum(near)[:-1] > 0) & (np.cumsum(held)[:-1] == 0))
    if not len(start):
        return pairs
    own = np.cumsum(open_)[start] > 0
    h = np.full(len(start), MIN_WORDS, np.uint64)
    for k in range(MIN_WORDS):
        h = (h ^ words[start + k]) * _MULTIPLIER
        h ^= h >> np.uint64(29)
    order = np.lexsort((start, h))
    h, start, own = h[order], start[order], own[order]
    new = np.r_[True, (h[1:] != h[:-1]) | (start[1:] - start[:-1] >= MIN_WORDS)]
    own = np.logical_or.reduceat(own, np.flatnonzero(new))[np.cumsum(new) - 1]
    outer = new | np.r_[new[1:], True]
    windows = h[outer], start[outer], np.full(int(outer.sum()), reach), own[outer]
    return tuple(np.concatenate(x) for x in zip(pairs, windows, strict=True))


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shared seeds (node, key, pos, state), sorted by node and pos -> (node, seeds), for texts that have a pair of seeds with a key."""
    nodes, packed = [], []
    for group in _groups(batches, ("node",)):
        row = np.empty(len(group), _SHARED)
        for k in ("key", "pos", "state"):
            row[k] = group.column(k).to_numpy()
        at, state = row["pos"].astype(np.int64), row["state"]
        low, high = np.searchsorted(at, at + NEAR), np.searchsorted(at, at + FAR, "right")
        above = np.r_[0, np.cumsum(state > 0)]
        if ((high > low) & ((state > 0) | (above[high] > above[low]))).any():
            nodes.append(group.column("node")[0].as_py())
            packed.append(row.tobytes())
        if len(nodes) == 1024:
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(packed, pa.binary())], ["node", "seeds"])
            nodes, packed = [], []
    if nodes:
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(packed, pa.binary())], ["node", "seeds"])


_SHARED = np.dtype([("key", "<i8"), ("pos", "<i4"), ("state", "<i1")])
#: State of a seed occurrence outside all passages.
OPEN = 2


def _long_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, text, seeds, exact) -> (key, node, pos, span, open); pos is ~pos where the key has occurred in the text before."""
    names = ["key", "node", "pos", "span", "open"]
    for batch in batches:
        for node, text, packed, exact in zip(*(batch.column(c).to_pylist() for c in ("node", "text", "seeds", "exact")), strict=True):
            row = np.frombuffer(packed, _SHARED)
            spans = np.array(sorted((x["s"], x["e"]) for x in exact or ()), np.int64).reshape(-1, 2)
            key, pos, span, own = long_keys(word_hashes(text), row["key"].astype(np.int64).view(np.uint64), row["pos"].astype(np.int64), row["state"], spans)
            order = np.lexsort((pos, key))
            key, pos, span, own = key[order], pos[order], span[order], own[order]
            pos = np.where(np.r_[True, key[1:] != key[:-1]][: len(key)], pos, ~pos)
            for a in range(0, len(key), 1 << 16):
                x = slice(a, a + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array(key[x].view(np.int64)), pa.array(np.full(len(key[x]), node, np.int64)), pa.array(pos[x].astype(np.int32)), pa.array(span[x].astype(np.int32)), pa.array(own[x])], names)


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, text) -> (node, seg, words): 32-bit hashes of the words of each stretch and its margins."""
    for batch in batches:
        out: tuple[list, list, list] = ([], [], [])
        for node, text in zip(batch.column("node").to_pylist(), batch.column("text").to_pylist(), strict=True):
            words = (word_hashes(text) >> np.uint64(32)).astype("<u4")
            if len(words) >= MIN_WORDS:
                for seg in range(-(-len(words) // CORE)):
                    for o, x in zip(out, (node, seg, words[max(0, seg * CORE - MARGIN) : (seg + 1) * CORE + MARGIN].tobytes()), strict=True):
                        o.append(x)
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.binary())], ["node", "seg", "words"])


def chains(c: list[int], a: list[int]) -> list[list[int]]:
    """Chains of matches (c ascending, a), as lists of their numbers, best first; each match is in one chain."""
    ranks = {x: i for i, x in enumerate(sorted(set(a)), 1)}
    tree: list[tuple[float, int]] = [(-1e18, -1)] * (len(ranks) + 1)
    score, before = [], []
    for i, (x, y) in enumerate(zip(c, a, strict=True)):
        best, j = -1e18, ranks[y] - 1
        link = -1
        while j:
            if tree[j][0] > best:
                best, link = tree[j]
            j &= j - 1
        gain = best - GAP * (x + y)
        score.append(SEED + max(0.0, gain))
        before.append(link if gain > 0 else -1)
        own, j = (score[i] + GAP * (x + y), i), ranks[y]
        while j < len(tree):
            if own[0] > tree[j][0]:
                tree[j] = own
            j += j & -j
    used, out = [False] * len(c), []
    for i in sorted(range(len(c)), key=lambda i: (-score[i], i)):
        chain = []
        while i >= 0 and not used[i]:
            used[i] = True
            chain.append(i)
            i = before[i]
        if chain:
            out.append(chain[::-1])
    return out


def _equal(c: np.ndarray, a: np.ndarray) -> int:
    """Length of the equal beginnings of two arrays."""
    n = min(len(c), len(a))
    for size in (16, n):
        size = min(size, n)
        odd = c[:size] != a[:size]
        k = int(odd.argmax()) if size else 0
        if size and odd[k]:
            return k
    return n


def _resume(c: np.ndarray, a: np.ndarray) -> tuple[int, int] | None:
    """The smallest edit behind which RESUME words are equal again: words left out of either."""
    x, y = c[: EDIT + RESUME].tolist(), a[: EDIT + RESUME].tolist()
    there: dict[tuple, int] = {}
    for j in range(len(y) - RESUME, 0, -1):
        there[tuple(y[j : j + RESUME])] = j  # the first place of each but 0
    best = None
    for i in range(len(x) - RESUME + 1):
        run = tuple(x[i : i + RESUME])
        j = 0 if i and len(y) >= RESUME and run == tuple(y[:RESUME]) else there.get(run)
        if j is not None and (best is None or i + j < best[0] + best[1]):
            best = i, j
    return best


def align(c: np.ndarray, a: np.ndarray, anchors: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """Runs (c, a, words) of equal words along a chain of seeds, and beyond its ends."""
    runs: list[tuple[int, int, int]] = []
    i, j = anchors[0]
    # back from the first seed
    x, y, back = i, j, []
    while True:
        k = _equal(c[:x][::-1], a[:y][::-1])
        if k:
            back.append((x - k, y - k, k))
        edit = _resume(c[: x - k][::-1], a[: y - k][::-1])
        if edit is None:
            break
        x, y = x - k - edit[0], y - k - edit[1]
    runs = back[::-1]
    for i, j in [*anchors, (len(c), len(a))]:
        # on from the last run over small edits, up to the next seed
        while runs:
            x, y, k = runs[-1]
            if x + k >= i or y + k >= j:
                break
            edit = _resume(c[x + k :], a[y + k :])
            if edit is None or x + k + edit[0] >= i or y + k + edit[1] >= j:
                break
            x, y = x + k + edit[0], y + k + edit[1]
            runs.append((x, y, _equal(c[x:], a[y:])))
        x, y, k = runs[-1] if runs else (0, 0, 0)
        if i == len(c) or x + k >= i + SEED or y + k >= j + SEED:
            continue
        if runs and i - j == x - y and x + k >= i:
            runs.pop()
        else:
            i, j = (i + max(0, x + k - i, y + k - j), j + max(0, x + k - i, y + k - j)) if runs else (i, j)
            low = _equal(c[x + k : i][::-1], a[y + k : j][::-1]) if runs else 0
            x, y = i - low, j - low
        n = _equal(c[x:], a[y:])
        if n:
            runs.append((x, y, n))
    return runs


def agreement(runs: list[tuple[int, int, int]]) -> float:
    """Jaccard similarity of the shingles of what the runs span, those in runs being common."""
    (x, y, _), (u, v, k) = runs[0], runs[-1]
    common = sum(max(0, n - SHINGLE + 1) for *_, n in runs)
    return common / max(1, u + k - x + v + k - y - 2 * (SHINGLE - 1) - common)


def passages(runs: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, int, int, float]]:
    """(c start, c end, a start, a end, similarity) of the long and similar parts of runs, cut at the widest gaps."""
    while runs and runs[0][2] < SHINGLE:
        runs = runs[1:]
    while runs and runs[-1][2] < SHINGLE:
        runs = runs[:-1]
    if not runs:
        return
    (x, y, _), (u, v, k) = runs[0], runs[-1]
    if min(u + k - x, v + k - y) < MIN_WORDS:
        return
    if (found := agreement(runs)) >= SIMILARITY:
        yield x, u + k, y, v + k, found
        return
    gaps = [q[0] - p[0] - p[2] + q[1] - p[1] - p[2] for p, q in zip(runs, runs[1:], strict=False)]
    if gaps:
        cut = max(range(len(gaps)), key=gaps.__getitem__) + 1
        yield from passages(runs[:cut])
        yield from passages(runs[cut:])


def _groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """Groups of equal keys of sorted rows, which batches may cut."""
    rest, last = [], None
    for batch in batches:
        if not len(batch):
            continue
        g = np.stack([batch.column(k).to_numpy().astype(np.int64) for k in keys], 1)
        cuts = np.r_[np.flatnonzero(np.r_[True, (g[1:] != g[:-1]).any(1)]), len(g)]
        for x, y in zip(cuts, cuts[1:], strict=False):
            own = tuple(g[x])
            if own != last and rest:
                yield pa.Table.from_batches(rest)
                rest = []
            last = own
            rest.append(batch.slice(x, y - x))
    if rest:
        yield pa.Table.from_batches(rest)


def _thinned(c: list[int], a: list[int]) -> tuple[list[int], list[int]]:
    """Matches (c ascending) without those that overlap the last one left of their diagonal, which lead to the same run."""
    last: dict[int, int] = {}
    left = [(x, y) for x, y in zip(c, a, strict=True) if x - last.get(x - y, -SEED) >= SEED and not last.update({x - y: x})]
    return [x for x, _ in left], [y for _, y in left]


_PAIR = ("c_node", "c_seg", "a_node", "a_seg")


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Matches sorted by pair of stretches and c_pos -> pairs with their chains: [words of a chain, c, a, c, a, ...] ..."""
    out: list[list] = [[] for _ in range(5)]

    def batch() -> pa.RecordBatch:
        types = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary())
        made = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types, strict=True)], [*_PAIR, "chains"])
        for x in out:
            x.clear()
        return made

    for group in _groups(batches, _PAIR):
        c, a = _thinned(group.column("c_pos").to_pylist(), group.column("a_pos").to_pylist())
        flat: list[int] = []
        for chain in chains(c, a):
            flat.append(len(chain))
            for i in chain:
                flat += (c[i], a[i])
        for x, v in zip(out, (*(group.column(k)[0].as_py() for k in _PAIR), np.array(flat, np.int32).tobytes()), strict=True):
            x.append(v)
        if len(out[0]) == 4096:
            yield batch()
    if out[0]:
        yield batch()


#: Instead of a similarity: marks a run of equal words.
EXACT = 2.0
_PASSAGE = ("c_node", "c_start", "c_end", "a_node", "a_start", "a_end", "similarity")
_PASSAGE_TYPES = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.float64())


def _aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (link, side): both stretches of a pair -> its passages, in words of the documents.

    Runs of MIN_WORDS equal words are rows of their own, of similarity EXACT; those that begin or end the text go beyond it.
    """
    out: list[list] = [[] for _ in _PASSAGE]
    for group in _groups(batches, ("link",)):
        # rows that agree in id and text bring the same stretch more than once
        rows = group.to_pylist()
        first, second = rows[0], rows[-1]
        if first["side"] == second["side"]:
            raise ValueError("a stretch of a pair is missing")
        c, a = (np.frombuffer(x["words"], "<u4") for x in (first, second))
        c_at, a_at = (max(0, x["seg"] * CORE - MARGIN) for x in (first, second))
        flat, at = np.frombuffer(first["chains"], np.int32).tolist(), 0
        covered = np.zeros(len(c), bool)
        while at < len(flat):
            n = flat[at]
            anchors = [(flat[k] - c_at, flat[k + 1] - a_at) for k in range(at + 1, at + 1 + 2 * n, 2)]
            at += 1 + 2 * n
            if all(covered[x : x + SEED].all() for x, _ in anchors):  # a better chain has made a passage there
                continue
            runs = align(c, a, anchors)
            ends_text = len(c) < (first["seg"] + 1) * CORE + MARGIN - c_at
            for x, y, k in runs:
                if k >= MIN_WORDS:
                    begin, end = x + c_at - 2 * FAR * (x + c_at == 0), x + k + c_at + 2 * FAR * (ends_text and x + k == len(c))
                    for o, v in zip(out, (first["node"], begin, end, second["node"], y + a_at, y + k + a_at, EXACT), strict=True):
                        o.append(v)
            for p, q, r, s, found in passages(runs):
                covered[p:q] = True
                row = (first["node"], p + c_at, q + c_at, second["node"], r + a_at, s + a_at, found)
                for o, v in zip(out, row, strict=True):
                    o.append(v)
        if len(out[0]) >= 4096:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, _PASSAGE_TYPES, strict=True)], list(_PASSAGE))
            out = [[] for _ in _PASSAGE]
    if out[0]:
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, _PASSAGE_TYPES, strict=True)], list(_PASSAGE))


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Passages sorted by (c_node, a_node, c_start): parts that overlap in both documents become one."""
    out: list[list] = [[] for _ in _PASSAGE]
    for group in _groups(batches, ("c_node", "a_node")):
        open_: list[list] = []
        done: list[list] = []
        for row in zip(*(group.column(k).to_pylist() for k in _PASSAGE), strict=True):
            _, p, q, _, r, s, found = row
            done += [x for x in open_ if x[2] < p]  # all later parts begin behind these
            open_ = [x for x in open_ if x[2] >= p]
            for x in reversed(open_):
                if r <= x[5] and x[4] <= s and abs((p - r) - (x[1] - x[4])) <= 4 * EDIT:
                    weight, more = x[2] - x[1], max(0, q - x[2])
                    x[6] = (x[6] * weight + found * more) / (weight + more)
                    x[2], x[4], x[5] = max(x[2], q), min(x[4], r), max(x[5], s)
                    break
            else:
                open_.append(list(row))
        for x in sorted(done + open_):
            for o, v in zip(out, x, strict=True):
                o.append(v)
        if len(out[0]) >= 4096:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, _PASSAGE_TYPES, strict=True)], list(_PASSAGE))
            out = [[] for _ in _PASSAGE]
    if out[0]:
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, _PASSAGE_TYPES, strict=True)], list(_PASSAGE))


def node_key(id_col: str, text_col: str) -> Column:
    """Key of a document: a hash of its id and text, so rows that agree in both are one document."""
    return F.xxhash64(F.col(id_col).cast("string"), F.col(text_col))


def find_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(c_node, c_start, c_end, a_node, a_start, a_end, similarity): passages of documents that others have first.

    Nodes are keys as of node_key, positions are in words, ends exclusive. a_node < c_node, so cutting out all [c_start, c_end)
    leaves every passage somewhere. Words are runs without white space, A-Z lower-cased. Null and empty texts and those
    under MIN_WORDS words have no passages; rows that agree in id and text are one document; repeats within one document
    are none. Other columns of docs are not read. An empty table gives an empty result.
    """
    rows = docs.select(node_key(id_col, text_col).alias("node"), F.col(text_col).cast("string").alias("text"))
    found = scratch(rows.mapInArrow(_seed_rows, "key bigint, node bigint, pos int"), "seeds")
    spark, n = docs.sparkSession, found.count()
    firsts = scratch(_firsts(found, F.col("pos")), "firsts", files_for(spark, n // 2))
    free_shuffles(docs)
    shared = scratch(found.join(firsts, "key").select("key", "node", _place("pos").alias("pos"), "a_node", "a_pos"), "shared", files_for(spark, n))
    for x in (found, firsts):
        drop_scratch(x)
    free_shuffles(docs)
    parts = _verified(docs, rows, shared.where("node != a_node").select(F.col("node").alias("c_node"), F.col("pos").alias("c_pos"), "a_node", "a_pos"))
    texts = _open_texts(rows, shared, parts)
    drop_scratch(shared)
    matches = _long_matches(texts)
    more = _verified(docs, texts.select("node", "text"), matches)
    for x in (texts, matches):
        drop_scratch(x)
    merged = parts.union(more).where(F.col("similarity") < EXACT).repartition("c_node", "a_node").sortWithinPartitions("c_node", "a_node", "c_start", "a_start", "c_end", "a_end").mapInArrow(_merged, _SCHEMA)
    out = scratch(merged, "passages", files_for(spark, parts.count() + more.count()))
    for x in (parts, more):
        drop_scratch(x)
    free_shuffles(docs)
    return out


def _place(pos: str) -> Column:
    return F.when(F.col(pos) < 0, F.bitwise_not(pos)).otherwise(F.col(pos))


def _firsts(places: DataFrame, what: Column) -> DataFrame:
    """(key, a_node, a_pos) of the keys that more than one node has: the smallest node, and what is at the key's first place in it."""
    met = places.groupBy("key").agg(F.min("node").alias("a_node"), F.max("node").alias("other"), F.min_by(F.when(F.col("pos") >= 0, what), F.when(F.col("pos") >= 0, F.col("node"))).alias("a_pos"))
    return met.where("other != a_node").select("key", "a_node", "a_pos")


_SCHEMA = "c_node bigint, c_start int, c_end int, a_node bigint, a_start int, a_end int, similarity double"


def _verified(docs: DataFrame, rows: DataFrame, matches: DataFrame) -> DataFrame:
    """Passages, stretch by stretch, along the chains of matches (c_node, c_pos, a_node, a_pos) of rows (node, text)."""
    matches = matches.select("c_node", F.expr(f"c_pos div {CORE}").cast("int").alias("c_seg"), "a_node", F.expr(f"a_pos div {CORE}").cast("int").alias("a_seg"), "c_pos", "a_pos")
    spark = docs.sparkSession
    links = matches.repartition(*_PAIR).sortWithinPartitions(*_PAIR, "c_pos", "a_pos").mapInArrow(_chained, "c_node bigint, c_seg int, a_node bigint, a_seg int, chains binary")
    links = scratch(links.withColumn("link", F.monotonically_increasing_id()), "links", files_for(spark, matches.count()))
    free_shuffles(docs)
    one = links.select("link", F.lit(0).alias("side"), F.col("c_node").alias("node"), F.col("c_seg").alias("seg"), "chains")
    two = links.select("link", F.lit(1), "a_node", "a_seg", F.lit(None).cast("binary"))
    sides = one.union(two)
    words = rows.mapInArrow(_stretches, "node bigint, seg int, words binary")
    both = sides.join(words, ["node", "seg"]).repartition("link").sortWithinPartitions("link", "side")
    # a link brings two stretches, of up to 5 kB each
    parts = scratch(both.mapInArrow(_aligned, _SCHEMA), "parts", files_for(spark, 8 * links.count()))
    drop_scratch(links)
    free_shuffles(docs)
    return parts


def _open_texts(rows: DataFrame, shared: DataFrame, parts: DataFrame) -> DataFrame:
    """(node, text, seeds, exact) of the texts (rows) whose shared seeds have long keys to be matched again; parts: the passages so far."""
    of = F.struct(F.col("c_start").alias("s"), F.col("c_end").alias("e"))
    spans = parts.groupBy("c_node").agg(F.collect_set(F.when(F.col("similarity") < EXACT, of)).alias("spans"), F.collect_set(F.when(F.col("similarity") >= EXACT, of)).alias("exact"))
    files = files_for(rows.sparkSession, shared.count())
    spans = scratch(spans, "spans", files)
    within = lambda spans, before, after: F.coalesce(F.exists(spans, lambda x: (F.col("pos") - before >= x["s"]) & (F.col("pos") + after <= x["e"])), F.lit(False))
    # no key reaches out of a run from so deep inside
    flagged = shared.join(spans, F.col("node") == F.col("c_node"), "left").where(~within("exact", FAR, FAR + SEED))
    flagged = scratch(flagged.select("key", "node", "pos", ((F.col("node") != F.col("a_node")) & ~within("spans", 0, SEED)).alias("open")), "flagged", files)
    free_shuffles(rows)
    keys = scratch(flagged.where("open").select(F.col("key").alias("k")).distinct(), "keys", files)
    state = F.when(F.col("open"), OPEN).when(F.col("k").isNotNull(), 1).otherwise(0).cast("tinyint")
    some = flagged.join(keys, F.col("key") == F.col("k"), "left").select("node", "key", "pos", state.alias("state"))
    found = some.repartition("node").sortWithinPartitions("node", "pos").mapInArrow(_candidates, "node bigint, seeds binary")
    found = scratch(found.join(spans.select("c_node", "exact"), F.col("node") == F.col("c_node"), "left").select("node", "seeds", "exact"), "candidates", files)
    for x in (flagged, keys, spans):
        drop_scratch(x)
    free_shuffles(rows)
    out = scratch(rows.join(found, "node").select("node", "text", "seeds", "exact"), "open")
    drop_scratch(found)
    free_shuffles(rows)
    return out


def _long_matches(texts: DataFrame) -> DataFrame:
    """(c_node, c_pos, a_node, a_pos): both ends of the long keys of texts, each with the first node that has the key."""
    keys = scratch(texts.mapInArrow(_long_rows, "key bigint, node bigint, pos int, span int, open boolean"), "long")
    spark, n = texts.sparkSession, keys.count()
    # one number, as structs are aggregated by sorting
    firsts = scratch(_firsts(keys, F.shiftleft(F.col("pos").cast("long"), 16).bitwiseOR(F.col("span"))), "long-firsts", files_for(spark, n // 2))
    firsts = firsts.select("key", "a_node", F.shiftright("a_pos", 16).cast("int").alias("first"), F.col("a_pos").bitwiseAND(0xFFFF).cast("int").alias("reach"))
    met = keys.where("open").join(firsts, "key").where("node != a_node")
    ends = lambda x, pos, span: F.array(F.struct(x.alias("c"), pos.alias("a")), F.struct((x + F.col("span")).alias("c"), (pos + span).alias("a")))
    met = met.select("node", "a_node", F.explode(ends(_place("pos"), F.col("first"), F.col("reach"))).alias("end"))
    out = scratch(met.select(F.col("node").alias("c_node"), F.col("end.c").alias("c_pos"), "a_node", F.col("end.a").alias("a_pos")).distinct(), "matches", files_for(spark, n))
    for x in (keys, firsts):
        drop_scratch(x)
    return out


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start_word, n_words, first_doc_id, first_start_word, first_n_words, similarity): find_passages by ids."""
    ids = docs.select(node_key(id_col, text_col).alias("node"), F.col(id_col).alias("id")).distinct()
    found = find_passages(docs, id_col, text_col)
    first = ids.select(F.col("node").alias("a_node"), F.col("id").alias(f"first_{id_col}"))
    out = found.join(ids.select(F.col("node").alias("c_node"), F.col("id").alias(id_col)), "c_node").join(first, "a_node")
    return out.select(id_col, F.col("c_start").alias("start_word"), F.expr("c_end - c_start").alias("n_words"), f"first_{id_col}", F.col("a_start").alias("first_start_word"), F.expr("a_end - a_start").alias("first_n_words"), "similarity")


def cut_words(text: str, spans: list[tuple[int, int]]) -> str:
    """text without the words of the spans [start, end), and without the white space behind each."""
    import re

    out, at, n, spans = [], 0, 0, sorted(spans)
    k = 0
    for m in re.finditer(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*", text):
        while k < len(spans) and spans[k][1] <= n:
            k += 1
        if k < len(spans) and spans[k][0] <= n:
            out.append(text[at : m.start()])
            at = m.end()
        n += 1
    out.append(text[at:])
    return "".join(out)


def _cut(texts: pa.Array, spans: pa.Array) -> pa.Array:
    return pa.array([t if not s or t is None else cut_words(t, [(x["start"], x["end"]) for x in s]) for t, s in zip(texts.to_pylist(), spans.to_pylist(), strict=True)], pa.string())


def cut_passages(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the passages that other documents have first (found: as of find_passages), and (cut_words) how many words went.

    Documents of which nothing is left stay, with what white space they had; cut_words is 0 for all others that lose nothing.
    """
    spans = found.groupBy("c_node").agg(F.collect_set(F.struct(F.col("c_start").alias("start"), F.col("c_end").alias("end"))).alias("_spans"))
    names = [c for c in docs.columns if c != "cut_words"]
    rows = docs.select(*names, node_key(id_col, text_col).alias("_node")).join(spans, F.col("_node") == F.col("c_node"), "left")
    union = F.aggregate(F.array_sort("_spans"), F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")), lambda s, x: F.struct(F.greatest(s["end"], x["end"]).alias("end"), (s["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(s["end"], x["start"]))).alias("n")), lambda s: s["n"])
    # else the optimizer copies it into filters on the text, and each task cuts twice, in two workers
    new = F.arrow_udf(_cut, "string").asNondeterministic()(F.col(text_col), F.col("_spans"))
    return rows.withColumn("cut_words", F.coalesce(union, F.lit(0))).withColumn(text_col, new).select(*names, "cut_words")
