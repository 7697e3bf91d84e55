"""Byte-level BPE encoding and decoding by monoid tree reduction.

A text is encoded in halves, recursively, and neighbours are joined by encoding a window around the seam again. It
happens on two levels:

* pieces (matches of the splitting pattern). The pattern looks behind nowhere, and what it matches depends on at most SEEN
  characters behind the match (of 're, 've and 'll, where the seam leaves only ' and a letter). So of the left half only the
  last piece and those that end less than SEEN characters before the seam can change, and once a piece of the window begins where a piece of the right half
  begins, all later pieces are the same. The window grows to the right until that holds.
* tokens within a piece. Every adjacent pair of an encoding encodes to itself, and a sequence whose adjacent pairs all do
  is the encoding of its bytes. The window takes in more tokens on either side until its outer pairs pass that test.

Ranks come from a file of a public tokenizer, whose path is a parameter; nothing is trained here.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField, StructType

#: Characters of a text that are split at once.
LEAF_CHARS = 512
#: Characters behind a piece that can decide where it ends.
SEEN = 3
#: Bytes of a piece that are merged at once, and ids that are decoded at once.
LEAF_BYTES, LEAF_IDS = 8, 256
#: Bytes of a window up to which it is merged by a scan of its pairs instead of a heap.
SCAN_BYTES = 192
#: Encodings of pieces, of up to SHORT characters each, that a worker remembers, and as many older ones.
REMEMBERED, SHORT = 1 << 18, 48


class _Memory(dict):
    """Piece -> its ids as little-endian 32-bit integers; bounded.

    When it is full, what it has becomes the older half, from which pieces come back as they are asked for; the half before goes.
    """

    def __init__(self, make):
        self.make, self.older = make, {}

    def __missing__(self, piece: str) -> bytes:
        out = self.older.pop(piece, None)
        if out is None:
            out = np.array(self.make(piece.encode()), "<u4").tobytes()
        if len(piece) <= SHORT:
            if len(self) >= REMEMBERED:
                self.older = dict(self)
                self.clear()
            self[piece] = out
        return out


class ByteBPE:
    """Encoder and decoder for a rank table (bytes -> rank) and a splitting pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.split = ranks, regex.compile(pattern)
        self.bytes_of = {i: t for t, i in ranks.items()}
        self.memory = _Memory(self.encode_piece)
        self._stable = lru_cache(1 << 16)(lambda a, b: self._merge(a + b) == [a, b])
        self._short = lru_cache(1 << 16)(lambda piece: tuple(self._merge(piece)))

    # tokens of a piece

    def _merge(self, piece: bytes) -> list[bytes]:
        """Merge the leftmost pair of least rank until none is left."""
        ranks, none = self.ranks, 1 << 62
        parts = [piece[i : i + 1] for i in range(len(piece))]
        pairs = [ranks.get(piece[i : i + 2], none) for i in range(len(piece) - 1)]
        while pairs and (low := min(pairs)) != none:
            i = pairs.index(low)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i:
                pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], none)
            if i < len(pairs):
                pairs[i] = ranks.get(parts[i] + parts[i + 1], none)
        return parts

    def _join(self, left: list[bytes], right: list[bytes]) -> list[bytes]:
        """Encoding of the two encodings' bytes together."""
        if self._stable(left[-1], right[0]):
            return left + right
        width = 1
        while True:
            a, b = max(0, len(left) - width), min(len(right), width)
            window = b"".join(left[a:]) + b"".join(right[:b])
            inner = list(self._short(window)) if len(window) <= 2 * LEAF_BYTES else self._merge(window) if len(window) <= SCAN_BYTES else self._heaped(window)
            if (not a or self._stable(left[a - 1], inner[0])) and (b == len(right) or self._stable(inner[-1], right[b])):
                return left[:a] + inner + right[b:]
            width *= 2

    def _heaped(self, piece: bytes) -> list[bytes]:
        """_merge in n log n, for windows that have to grow far (runs of one character)."""
        import heapq

        ranks, n = self.ranks, len(piece)
        part, after, before = [piece[i : i + 1] for i in range(n)], list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, part[i], part[i + 1]) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)

        def offer(i: int) -> None:
            if i >= 0 and after[i] < n and (r := ranks.get(part[i] + part[after[i]])) is not None:
                heapq.heappush(heap, (r, i, part[i], part[after[i]]))

        while heap:
            _, i, x, y = heapq.heappop(heap)
            if part[i] != x or after[i] >= n or part[after[i]] != y:
                continue
            j = after[i]
            part[i], part[j], after[i] = x + y, None, after[j]
            if after[j] < n:
                before[after[j]] = i
            offer(i)
            offer(before[i])
        return [x for x in part if x is not None]

    def _tokens(self, piece: bytes) -> list[bytes]:
        if len(piece) <= LEAF_BYTES:
            return list(self._short(piece))
        half = len(piece) // 2
        return self._join(self._tokens(piece[:half]), self._tokens(piece[half:]))

    def encode_piece(self, piece: bytes) -> list[int]:
        if piece in self.ranks:
            return [self.ranks[piece]]
        return [self.ranks[t] for t in self._tokens(piece)]

    # pieces of a text

    def pieces(self, text: str, start: int = 0, end: int | None = None) -> list[str]:
        """Matches of the pattern in text[start:end] taken by itself."""
        end = len(text) if end is None else end
        if end - start <= LEAF_CHARS:
            return self.split.findall(text, start, end)
        half = (start + end) // 2
        left, right = self.pieces(text, start, half), self.pieces(text, half, end)
        keep, head = len(left) - 1, half - len(left[-1])
        while keep and half - head < SEEN:
            keep -= 1
            head -= len(left[keep])
        width = 4
        while True:
            begins = set(accumulate(map(len, right[:width]), initial=half))
            stop = max(begins)
            window = self.split.findall(text, head, min(stop + 1, end))
            at = list(accumulate(map(len, window), initial=head))
            # a piece's end is sure if the window goes on behind it
            sure = next((k for k in range(1, len(at)) if at[k] in begins and (at[k] <= stop and k < len(at) - 1 or stop >= end)), None)
            if sure is not None:
                skip, place = 0, half
                while place < at[sure]:
                    place += len(right[skip])
                    skip += 1
                return left[:keep] + window[:sure] + right[skip:]
            width *= 2

    def encode_packed(self, text: str | None) -> bytes:
        """Ids of a whole text as little-endian 32-bit integers; a null text has none."""
        return b"".join(map(self.memory.__getitem__, self.pieces(text))) if text else b""

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encode_packed(text), "<u4").tolist()

    def decode(self, ids: list[int]) -> bytes:
        """Bytes of ids: those of the halves, one after the other."""
        if len(ids) <= LEAF_IDS:
            return b"".join(map(self.bytes_of.__getitem__, ids))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


@lru_cache(4)
def load(path: str, pattern: str) -> ByteBPE:
    """The coder for a rank file, once per process."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return ByteBPE(ranks, pattern)


def _lists(packed: list[bytes]) -> pa.Array:
    ends = np.cumsum([0] + [len(p) // 4 for p in packed])
    flat = np.frombuffer(b"".join(packed), "<u4").astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))


def _slices(batch: pa.RecordBatch, column: str, size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in runs of about size bytes of text."""
    lengths = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    run = np.cumsum(lengths) // size
    cuts = np.flatnonzero(np.r_[True, run[1:] != run[:-1]]) if len(run) else []
    for a, b in zip(cuts, [*cuts[1:], len(run)], strict=True):
        yield batch.slice(a, b - a)


def encode(df: DataFrame, path: str, pattern: str, text_col: str = "text", ids_col: str | None = "ids", decoded_col: str | None = None, packed_col: str | None = None) -> DataFrame:
    """df with the token ids of text_col as array<int>; with decoded_col, also the bytes that the ids decode to.

    packed_col: the ids as little-endian unsigned 32-bit integers; ids_col None: no array.

    Narrow: no shuffle, and a batch is worked off in runs of bounded size. Null and empty texts have no ids (and decode to
    no bytes). Special tokens are ordinary text. Repeated rows are kept. The new columns replace columns of df of the same name.
    """
    new = [StructField(name, kind) for name, kind in ((ids_col, ArrayType(IntegerType())), (packed_col, BinaryType()), (decoded_col, BinaryType())) if name]
    kept = [c for c in df.columns if c not in {f.name for f in new}]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = load(path, pattern)
        for whole in batches:
            for batch in _slices(whole, text_col):
                packed = [coder.encode_packed(t) for t in batch.column(text_col).to_pylist()]
                ids = _lists(packed)
                out = [*(batch.column(c) for c in kept), *([ids] if ids_col else [])]
                if packed_col:
                    out.append(pa.array(packed, pa.binary()))
                if decoded_col:
                    out.append(_decoded(coder, ids))
                yield pa.RecordBatch.from_arrays(out, [*kept, *(f.name for f in new)])

    return df.mapInArrow(run, StructType([df.schema[c] for c in kept] + new))


def _decoded(coder: ByteBPE, ids: pa.ListArray) -> pa.Array:
    flat, ends = ids.flatten().to_numpy(), ids.offsets.to_numpy()
    flat, ends = flat.tolist(), (ends - ends[0]).tolist()
    return pa.array([coder.decode(flat[a:b]) for a, b in zip(ends, ends[1:], strict=False)], pa.binary())


def decode(df: DataFrame, path: str, pattern: str, ids_col: str = "ids", decoded_col: str = "decoded") -> DataFrame:
    """df with the bytes of the ids in ids_col; a null list decodes to no bytes. An unknown id is an error."""
    kept = [c for c in df.columns if c != decoded_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = load(path, pattern)
        for batch in batches:
            got = pa.array([coder.decode(x or ()) for x in batch.column(ids_col).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), got], [*kept, decoded_col])

    return df.mapInArrow(run, StructType([df.schema[c] for c in kept] + [StructField(decoded_col, BinaryType())]))
