"""Words of many texts at once as numpy arrays, for tasks that Spark deals out.

Texts come as Arrow string columns, whose buffers are already one run of UTF-8 bytes with offsets. A slice is a
few megabytes of such a run. Inside it everything is arithmetic on whole arrays: white space, word starts, and
64-bit hashes of any byte range from one running polynomial. A null text is an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text in a slice; a longer text is a slice by itself.
SLICE = 4 << 20
#: The same where the arrays of a slice, and not its distinct words, decide: a worker then holds a fourth.
SMALL = 1 << 20
#: Bytes that are hashed in one step.
STEP = 1 << 19
_rng = np.random.default_rng(20240229)
#: A fixed random 64-bit value for each byte, and an odd multiplier with its inverse modulo 2^64.
BYTE_VALUES = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + _rng.integers(0, 2, 256, dtype=np.uint64)
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INVERSE = pow(BASE, -1, 1 << 64)
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _powers(of: int, n: int) -> np.ndarray:
    out = np.full(n + 1, of, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_up, _down = _powers(BASE, STEP), _powers(BASE_INVERSE, STEP)


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xA0761D6478BD642F)
    h ^= h >> np.uint64(32)
    return h


class Slice:
    """Some consecutive texts: rows first..first+n of the batch, buf their bytes, offs their n + 1 offsets in buf."""

    def __init__(self, first: int, buf: np.ndarray, offs: np.ndarray):
        self.first, self.buf, self.offs, self.n = first, buf, offs, len(offs) - 1

    def lower(self) -> Slice:
        """The same texts with A-Z in lower case."""
        return Slice(self.first, LOWER[self.buf], self.offs)

    def spans(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and row (from 0) of each word."""
        mark = np.empty(len(self.buf) + 2, bool)
        mark[0] = mark[-1] = True
        mark[1:-1] = IS_SPACE[self.buf]
        start = np.flatnonzero(mark[:-1] & ~mark[1:])
        end = np.flatnonzero(~mark[:-1] & mark[1:])
        # words do not cross texts: cut those in which a text begins
        inner = self.offs[1:-1]
        inner = inner[(inner > 0) & (inner < len(self.buf))]
        if len(inner):
            inner = np.unique(inner[~mark[inner] & ~mark[inner + 1]])
            if len(inner):
                start, end = np.sort(np.concatenate([start, inner])), np.sort(np.concatenate([end, inner]))
        row = np.searchsorted(self.offs, start, side="right") - 1
        return start, end, row

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """64-bit hashes of byte ranges; start must not fall, and equal bytes give equal hashes anywhere.

        A range's value is the sum of BYTE_VALUES[b] * BASE^i from i = 0; ranges that cross a step are summed of parts.
        """
        out = np.zeros(len(start), np.uint64)
        for lo in range(0, len(self.buf), STEP):
            hi = min(lo + STEP, len(self.buf))
            a, b = np.searchsorted(start, lo), np.searchsorted(start, hi)
            run = np.zeros(hi - lo + 1, np.uint64)
            np.cumsum(BYTE_VALUES[self.buf[lo:hi]] * _up[: hi - lo], out=run[1:])
            s, e = start[a:b] - lo, np.minimum(end[a:b], hi) - lo
            out[a:b] = (run[e] - run[s]) * _down[s]
            for k in np.flatnonzero(end[:b] > hi) if b and end[:b].max() > hi else ():  # the rest of long ranges
                out[k] = self._long(int(start[k]), int(end[k]))
        return mix64(out)

    def _long(self, start: int, end: int) -> np.uint64:
        total, scale = 0, 1
        for lo in range(start, end, STEP):
            part = self.buf[lo : min(lo + STEP, end)]
            total += int(np.sum(BYTE_VALUES[part] * _up[: len(part)])) * scale
            scale = scale * pow(BASE, STEP, 1 << 64) % (1 << 64)
        return np.uint64(total % (1 << 64))


def slices(column: pa.Array | pa.ChunkedArray, limit: int = SLICE) -> Iterator[Slice]:
    """The texts of a string column, in slices."""
    parts = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    done = 0
    for part in parts:
        if part.null_count:
            part = part.fill_null("")
        part = part.cast(pa.large_string())
        if not len(part):
            continue
        offs = np.frombuffer(part.buffers()[1], np.int64)[part.offset : part.offset + len(part) + 1]
        data = np.frombuffer(part.buffers()[2], np.uint8) if part.buffers()[2] is not None and part.buffers()[2].size else np.zeros(0, np.uint8)
        a = 0
        while a < len(part):
            b = max(a + 1, int(np.searchsorted(offs, offs[a] + limit, side="right")) - 1)
            b = min(b, len(part))
            yield Slice(done + a, data[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
            a = b
        done += len(part)


def shingles(words: np.ndarray, row: np.ndarray, n_rows: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words, and their rows; a row with fewer words, but any, gives its whole sequence."""
    n = len(words)
    if n >= k:
        inside = row[: n - k + 1] == row[k - 1 :]
        h = words[: n - k + 1] * np.uint64(_odd(0))
        for j in range(1, k):
            h = h + words[j : n - k + 1 + j] * np.uint64(_odd(j))
        h, at = mix64(h[inside]), row[: n - k + 1][inside]
    else:
        h, at = np.zeros(0, np.uint64), np.zeros(0, row.dtype)
    count = np.bincount(row, minlength=n_rows)
    few = np.flatnonzero((count > 0) & (count < k))
    if len(few):
        first = np.searchsorted(row, few)
        whole = count[few].astype(np.uint64) * np.uint64(0x1F3D5B79)
        for j in range(k - 1):
            has = count[few] > j
            whole = np.where(has, whole + words[np.minimum(first + j, n - 1)] * np.uint64(_odd(j)), whole)
        h, at = np.concatenate([h, mix64(whole)]), np.concatenate([at, few.astype(at.dtype)])
        order = np.argsort(at, kind="stable")
        h, at = h[order], at[order]
    return h, at


def _odd(j: int) -> int:
    return (pow(BASE, 2 * j + 3, 1 << 64) ^ 0x5851F42D4C957F2C) | 1


def twice(values: np.ndarray) -> np.ndarray:
    """Which values occur more than once."""
    order = np.argsort(values, kind="stable")
    v = values[order]
    same = v[1:] == v[:-1]
    found = np.zeros(len(values), bool)
    found[order[1:]] = same
    found[order[:-1]] |= same
    return found
