"""Pixel tensors: rotations, costs, sums, resampling. A tensor is the row-major bytes of a px x px x channels image."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Rows that wrapped_near adds up at once, so that they stay in a core's cache.
NEAR_ROWS = 128

def rot90(tensors: np.ndarray, px: int, turns: int = 1) -> np.ndarray:
    """Tensors (one a row) turned counter-clockwise by quarter turns."""
    n = len(tensors)
    return np.ascontiguousarray(np.rot90(tensors.reshape(n, px, px, -1), turns, (1, 2))).reshape(n, -1)


def rot90_places(px: int, channels: int, turns: int = 1) -> list[int]:
    """For each place of a turned tensor, the place it is filled from."""
    return rot90(np.arange(px * px * channels)[None], px, turns)[0].tolist()


def wrapped_cost(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sums of (a - b)^2 mod 256 over the bytes of all pairs of rows, which are uint8: the arithmetic wraps by itself."""
    out = np.empty((len(a), len(b)), np.int64)
    step = max(1, (1 << 22) // max(1, b.size))
    for i in range(0, len(a), step):
        d = a[i : i + step, None] - b[None]
        out[i : i + step] = np.multiply(d, d).sum(2, dtype=np.int64)
    return out


def true_cost(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sums of (a - b)^2 over the bytes of all pairs of rows; exact, as doubles hold these sums."""
    x, y = a.astype(np.float64), b.astype(np.float64)
    return np.rint((x * x).sum(1)[:, None] + (y * y).sum(1)[None] - 2 * (x @ y.T)).astype(np.int64)


def _where(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the true places, in order; looks at eight places at once, as few are true."""
    flat, width = mask.ravel(), max(1, mask.shape[1])
    whole = len(flat) // 8 * 8
    words = np.flatnonzero(flat[:whole].view(np.uint64))
    i, j = np.nonzero(flat[:whole].reshape(-1, 8)[words])
    at = np.r_[words[i] * 8 + j, whole + np.flatnonzero(flat[whole:])]
    return at // width, at % width


def wrapped_near(a: np.ndarray, b: np.ndarray, limit: float) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) of all pairs of rows with wrapped_cost of at most limit, in order, and of few others.

    Per byte, an eighth of the square modulo 256, rounded down: eight of these add up within a byte. They come from a table of
    each value of a against all of b, so a byte of a pair costs a copy and an addition of bytes.
    """
    (n, size), m = a.shape, len(b)
    total = np.zeros((n, m), np.uint16 if size * 31 < 1 << 16 else np.int64)
    part, more = np.empty((2, min(n, NEAR_ROWS), m), np.uint8)
    for at in range(0, size, 8):
        tables = []
        for k in range(at, min(size, at + 8)):
            values = np.flatnonzero(np.bincount(a[:, k], minlength=256)).astype(np.uint8)
            place = np.zeros(256, np.intp)
            place[values] = np.arange(len(values))
            d = values[:, None] - b[:, k][None]
            np.multiply(d, d, out=d)
            tables.append((np.right_shift(d, 3, out=d), place[a[:, k]]))
        for i in range(0, n, NEAR_ROWS):
            rows = slice(0, min(n - i, NEAR_ROWS))
            for first, (table, place) in enumerate(tables):
                # the places are all valid; "clip" spares a copy
                np.take(table, place[i : i + NEAR_ROWS], axis=0, out=(more if first else part)[rows], mode="clip")
                if first:
                    np.add(part[rows], more[rows], out=part[rows])
            np.add(total[i : i + NEAR_ROWS], part[rows], out=total[i : i + NEAR_ROWS])
    return _where(total <= np.clip(limit // 8, -1, size * 31))


def true_near(a: np.ndarray, b: np.ndarray, limit: float) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) of all pairs of rows with true_cost of at most limit, in order, and of few others.

    cost <= limit where x y - (x x + y y) / 2 >= -limit / 2, a product of floats; of up to 512 bytes around 0 all sums are below
    2 ** 25, so each of its additions is wrong by 1 at most.
    """
    x, y = a.astype(np.float32) - 128, b.astype(np.float32) - 128
    half = lambda z: ((z * z).sum(1, dtype=np.float64) / 2).astype(np.float32)[:, None]
    one = lambda z: np.ones((len(z), 1), np.float32)
    near = np.hstack([x, half(x), one(x)]) @ np.hstack([y, -one(y), -half(y)]).T
    return _where(near >= -limit / 2 - a.shape[1] - 4)


def nibbles(tensors: np.ndarray) -> np.ndarray:
    """Low halves of the bytes, two packed in one: equal for tensors whose wrapped cost is 0, and only for them."""
    low = tensors & 15
    if low.shape[1] % 2:
        low = np.c_[low, np.zeros(len(low), np.uint8)]
    return low[:, ::2] << 4 | low[:, 1::2]


@lru_cache(16)
def _bicubic_weights(size: int, px: int) -> tuple[np.ndarray, np.ndarray]:
    """Per output place: first input place, and 22-bit fixed-point weights."""
    scale = size / px
    support = 2 * max(scale, 1.0)
    taps = int(np.ceil(support)) * 2 + 1
    first, weights = np.zeros(px, np.int64), np.zeros((px, taps), np.int64)
    for i in range(px):
        centre = (i + 0.5) * scale
        low, high = max(0, int(centre - support + 0.5)), min(size, int(centre + support + 0.5))
        x = np.abs((np.arange(low, high) + 0.5 - centre) / max(scale, 1.0))
        w = np.where(x < 1, (1.5 * x - 2.5) * x * x + 1, np.where(x < 2, ((-0.5 * x + 2.5) * x - 4) * x + 2, 0.0))
        w = w / w.sum()
        first[i] = low
        weights[i, : high - low] = np.where(w < 0, np.ceil(w * (1 << 22) - 0.5), np.floor(w * (1 << 22) + 0.5)).astype(np.int64)
    return first, weights


def _resample_rows(image: np.ndarray, px: int) -> np.ndarray:
    """Resample the first axis."""
    size = len(image)
    if size == px:
        return image
    first, weights = _bicubic_weights(size, px)
    places = np.minimum(first[:, None] + np.arange(weights.shape[1])[None], size - 1)
    out = np.full((px, *image.shape[1:]), 1 << 21, np.int64)
    for k in range(weights.shape[1]):
        out += weights[:, k].reshape(-1, *[1] * (image.ndim - 1)) * image[places[:, k]]
    return np.clip(out >> 22, 0, 255).astype(np.uint8)


def resample(image: np.ndarray, px: int) -> np.ndarray:
    """Bicubic resampling (a = -0.5, with antialiasing) of an H x W x C image to px x px: width first, then height."""
    return _resample_rows(_resample_rows(image.swapaxes(0, 1), px).swapaxes(0, 1), px)


# the same in SQL, over array<int>


def quantised(vector: Column) -> Column:
    """A vector of numbers in [-1, 1] as array<int> of bytes."""
    return F.transform(vector, lambda x: F.greatest(F.lit(0), F.least(F.lit(255), F.floor((x.cast("double") + 1) * 127.5).cast("int"))))


def turned(tensor: Column, px: int, channels: int = 1, turns: int = 1) -> Column:
    """array<int> turned counter-clockwise by quarter turns."""
    if not turns:
        return tensor
    return F.transform(F.array(*map(F.lit, rot90_places(px, channels, turns))), lambda i: F.get(tensor, i))


def packed(tensor: Column) -> Column:
    """array<int> as binary."""
    return F.unhex(F.array_join(F.transform(tensor, lambda x: F.lpad(F.hex(x), 2, "0")), ""))


def array_sum(tensor: Column) -> Column:
    return F.aggregate(tensor, F.lit(0).cast("long"), lambda s, x: s + x)
