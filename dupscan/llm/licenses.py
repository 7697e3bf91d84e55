"""License scans: MinHash bands of text windows retrieve templates, exact shingle containment verifies them.

Templates and texts become words (runs of letters and digits, A-Z lower-cased) and shingles of SHINGLE words. A template
of s shingles is indexed by all of its windows of w shingles, w the largest power of two up to s / 2 (1 at least). Texts
are cut into windows of each w in use, half of them overlapping, so every occurrence of a template holds whole windows
that the index has too. Minima of windows of 2 w shingles are those of two of w, so all sizes come from one doubling.

A window that shares Jaccard similarity J with a template's shares one of BANDS bands of ROWS minima with probability
1 - (1 - J ** ROWS) ** BANDS: all windows of an exact copy do (J = 1), and one of a copy with a fifth of its shingles lost
(J >= 2/3) with probability over 0.99. Around each hit the share of the template's shingles that the text has there is
counted exactly; CONTAINMENT of them make a match.

Every text is scanned where it lies, in runs of bounded size; there is no shuffle. The templates, a parameter, are a constant
of the plan. Those of fewer than SHINGLE words are one shingle of their own width.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

SHINGLE, CONTAINMENT = 5, 0.8
BANDS, ROWS = 10, 2
#: Words that are scanned at once; longer texts are scanned in runs that overlap.
RUN = 1 << 16
_WORD = re.compile(rb"[a-z0-9\x80-\xff]+")
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def collision_probability(similarity: float, bands: int = BANDS, rows: int = ROWS) -> float:
    """Chance that two windows of that Jaccard similarity share a band."""
    return 1 - (1 - similarity**rows) ** bands


def _words(text: str | None) -> np.ndarray:
    from xxhash import xxh3_64_intdigest

    found = _WORD.findall((text or "").encode().lower())
    return np.fromiter(map(xxh3_64_intdigest, found), np.uint64, len(found))


def _shingles(words: np.ndarray, width: int) -> np.ndarray:
    n = max(0, len(words) - width + 1)
    h = np.full(n, width, np.uint64)
    for j in range(width):
        h = (h ^ words[j : j + n]) * _MULTIPLIER
        h ^= h >> np.uint64(29)
    return h


_SEEDS = np.random.default_rng(9).integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def _permuted(shingles: np.ndarray) -> np.ndarray:
    """One row for each hash function."""
    out = np.empty((len(_SEEDS), len(shingles)), np.uint32)
    for k, seed in enumerate(_SEEDS):
        out[k] = ((shingles ^ seed) * _MULTIPLIER) >> np.uint64(32)
    return out


def _bands(minima: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """Keys of each band of windows whose minima are columns; the size and the number of the band are part of a key."""
    for b in range(BANDS):
        h = np.full(minima.shape[1], size * BANDS + b, np.uint64)
        for r in range(ROWS):
            h = (h ^ minima[b * ROWS + r].astype(np.uint64)) * _MULTIPLIER
            h ^= h >> np.uint64(31)
        yield h * _MULTIPLIER


def window_of(shingles: int) -> int:
    """Shingles of the windows by which a template of so many is indexed."""
    return 1 << max(0, (shingles // 2).bit_length() - 1)


class Index:
    """Bands of templates: name -> text."""

    def __init__(self, templates: dict[str, str]):
        self.names, self.widths, self.own = [], [], []
        entries: dict[int, list[tuple[int, int, int]]] = {}
        self.sizes: dict[int, set[int]] = {}
        for name, text in templates.items():
            words = _words(text)
            if not len(words):
                continue
            width = min(SHINGLE, len(words))
            s = _shingles(words, width)
            number, w = len(self.names), window_of(len(s))
            self.names.append(name)
            self.widths.append(width)
            self.own.append(s)
            self.sizes.setdefault(width, set()).add(w)
            minima = np.lib.stride_tricks.sliding_window_view(_permuted(s), w, 1).min(2)
            for keys in _bands(minima, w):
                for at, key in enumerate(keys.tolist()):
                    entries.setdefault(key, []).append((number, at, w))
        self.entries = entries
        self.keys = np.array(sorted(entries), np.uint64)
        self.maybe = np.zeros(1 << 18, bool)
        self.maybe[self.keys >> np.uint64(46)] = True
        #: Words on either side of a hit that its template can reach.
        self.reach = max((2 * len(s) + 2 * SHINGLE for s in self.own), default=0)

    def hits(self, words: np.ndarray) -> set[tuple[int, int, int]]:
        """(template, place where it would begin, place of the window) of all windows that share a band with it."""
        out: set[tuple[int, int, int]] = set()
        for width, sizes in self.sizes.items():
            s = _shingles(words, width)
            if not len(s):
                continue
            minima, w = _permuted(s), 1
            while True:
                if w in sizes:
                    step = max(1, w // 2)
                    for keys in _bands(minima[:, ::step], w):
                        for i in np.flatnonzero(self.maybe[keys >> np.uint64(46)]):
                            for number, at, _ in self.entries.get(int(keys[i]), ()):
                                if self.widths[number] == width:
                                    out.add((number, int(i) * step - at, int(i) * step))
                if w >= max(sizes) or minima.shape[1] <= w:
                    break
                minima = np.minimum(minima[:, :-w], minima[:, w:])
                w *= 2
        return out

    def scan(self, texts: list[np.ndarray]) -> list[list[tuple[str, int, int, float]]]:
        """For each text (its words): (template, first word, number of words, containment) of the matches, in order.

        Texts are retrieved from together, as one run of words; every hit is verified within its own text.
        """
        ends = np.cumsum([len(t) for t in texts])
        words = np.concatenate(texts) if texts else np.empty(0, np.uint64)
        shingles = {width: _shingles(words, width) for width in self.sizes}
        found: list[dict[int, list[tuple[int, int, float]]]] = [{} for _ in texts]
        for number, at, place in sorted(self.hits(words)):
            own, width = self.own[number], self.widths[number]
            text = int(np.searchsorted(ends, place, "right"))
            begin, end = int(ends[text]) - len(texts[text]), int(ends[text])
            slack = len(own) // 4 + 1
            low = max(begin, at - slack)
            near = shingles[width][low : max(low, min(at + len(own) + slack, end - width + 1))]
            held = np.isin(near, own)
            share = len(np.unique(near[held])) / len(np.unique(own))
            if share < CONTAINMENT:
                continue
            places = np.flatnonzero(held)
            first, last = low - begin + int(places[0]), low - begin + int(places[-1]) + width
            matches = found[text].setdefault(number, [])
            if matches and first < matches[-1][1]:  # the same one, seen from elsewhere
                if share > matches[-1][2]:
                    matches[-1] = (first, last, share)
                continue
            matches.append((first, last, share))
        return [sorted(((self.names[k], a, b - a, share) for k, m in f.items() for a, b, share in m), key=lambda x: (x[1], x[0])) for f in found]


@lru_cache(4)
def index_of(templates: tuple[tuple[str, str], ...]) -> Index:
    return Index(dict(templates))


def scan_long(index: Index, words: np.ndarray) -> list[tuple[str, int, int, float]]:
    """The matches in a text above RUN words, in runs that overlap by what a template can reach."""
    out: dict[tuple[str, int], tuple[str, int, int, float]] = {}
    for at in range(0, len(words), RUN):
        begin = max(0, at - index.reach)
        for name, start, n, share in index.scan([words[begin : at + RUN + index.reach]])[0]:
            if at <= start + begin < at + RUN:
                out[name, start + begin] = (name, start + begin, n, share)
    return sorted(out.values(), key=lambda x: (x[1], x[0]))


def scan_texts(index: Index, texts: Iterator[str | None]) -> Iterator[list[tuple[str, int, int, float]]]:
    """The matches in each text; short texts are scanned together."""
    held: list[np.ndarray] = []
    size = 0
    for text in texts:
        words = _words(text)
        if held and size + len(words) > RUN:
            yield from index.scan(held)
            held, size = [], 0
        if len(words) > RUN:
            yield scan_long(index, words)
            continue
        held.append(words)
        size += len(words)
    yield from index.scan(held)


def closest(found: list[tuple[str, int, int, float]]) -> list[tuple[str, int, int, float]]:
    """Matches without those whose place, but for a fifth, another template matches better: versions of one notice."""
    shared = lambda a, b: min(a[1] + a[2], b[1] + b[2]) - max(a[1], b[1])
    return [m for m in found if not any(o[3] > m[3] and shared(m, o) >= 0.8 * max(m[2], o[2]) for o in found)]


def scan(docs: DataFrame, templates: dict[str, str], id_col: str = "doc_id", text_col: str = "text", closest_only: bool = False) -> DataFrame:
    """(id, template, start_word, n_words, containment): a row for each match of a template in a text.

    closest_only: of versions of one notice that match in one place, only the closest (several, if they are as close).

    Positions count words as scanned: runs of letters and digits. Null and empty texts have none; repeated rows give their
    matches as often as they occur; a template is matched wherever it occurs, also inside a longer one. Templates without
    words match nothing. Other columns of docs are not read.
    """
    chosen = tuple(sorted(templates.items()))

    def matches(texts: pa.Array) -> pa.Array:
        index = index_of(chosen)
        return pa.array([[dict(zip(("template", "start_word", "n_words", "containment"), m, strict=True)) for m in (closest(found) if closest_only else found)] for found in scan_texts(index, (t.as_py() for t in texts))], kind)

    kind = pa.list_(pa.struct([("template", pa.string()), ("start_word", pa.int32()), ("n_words", pa.int32()), ("containment", pa.float64())]))
    schema = ArrayType(StructType([StructField("template", StringType()), StructField("start_word", IntegerType()), StructField("n_words", IntegerType()), StructField("containment", DoubleType())]))
    found = docs.select(F.col(id_col), F.explode(F.arrow_udf(matches, schema)(F.col(text_col))).alias("_match"))
    return found.select(id_col, "_match.*")
