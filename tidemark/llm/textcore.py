"""Vectorised text primitives shared by the operators of this subpackage.

Texts arrive as Arrow string columns.  Their UTF-8 bytes lie in one buffer, so words, word hashes and windows of whole
batches are found with NumPy passes instead of a Python loop over words.  All hashes are 64 bits wide and are the same
in every process, which lets independent tasks give the same name to the same content.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Odd multipliers of the usual 64-bit finalisers (fixed values).
M1, M2, M3 = U64(0x9E3779B97F4A7C15), U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)
S27, S30, S31, S32 = U64(27), U64(30), U64(31), U64(32)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64 arrays."""
    x = x ^ (x >> S30)
    x = x * M2
    x ^= x >> S27
    x *= M3
    x ^= x >> S31
    return x


def seeded(x: np.ndarray, seed: int) -> np.ndarray:
    """An independent hash function of 64-bit values for each seed."""
    return mix(x + U64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF))


def _table(keep: set[int], lower: bool) -> tuple[np.ndarray, np.ndarray]:
    word = np.zeros(256, bool)
    word[sorted(keep)] = True
    to = np.arange(256, dtype=np.uint8)
    if lower:
        to[65:91] += 32
    return word, to


#: Words are runs of anything but space, tab and the other ASCII line and page breaks.
SPACED = _table(set(range(256)) - {0x20, *range(0x09, 0x0E)}, lower=False)
SPACED_LOWER = _table(set(range(256)) - {0x20, *range(0x09, 0x0E)}, lower=True)
#: Words are runs of ASCII letters and digits and of everything beyond ASCII.
ALNUM_LOWER = _table({*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)}, lower=True)


def buffers(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks() if col.num_chunks != 1 else col.chunk(0)
    col = pc.fill_null(col, "").cast(pa.large_string())
    off = np.frombuffer(col.buffers()[1], np.int64, len(col) + 1 + col.offset)[col.offset :]
    data = col.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo, hi = (int(off[0]), int(off[-1])) if len(off) else (0, 0)
    return raw[lo:hi], off - lo


def groups(off: np.ndarray, most: int = 4 << 20) -> list[tuple[int, int]]:
    """Ranges of rows of at most `most` bytes together (a longer row stands alone), so that passes stay in cache."""
    out, i, n = [], 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        out.append((i, min(j, n)))
        i = min(j, n)
    return out


class Words:
    """The words of some rows: byte ranges, hashes, and the index of each row's first word."""

    __slots__ = ("raw", "start", "end", "first", "hash")

    def __init__(self, raw: np.ndarray, off: np.ndarray, rule: tuple[np.ndarray, np.ndarray], hashed: bool = True):
        word, to = rule
        n = len(raw)
        inside = word[raw]
        lead = np.empty(n, bool)
        tail = np.empty(n, bool)
        if n:
            lead[0] = tail[-1] = True
            np.logical_not(inside[:-1], out=lead[1:])
            np.logical_not(inside[1:], out=tail[:-1])
            at = off[1:-1]
            at = at[(at > 0) & (at < n)]
            lead[at] = True
            tail[at - 1] = True
            lead &= inside
            tail &= inside
        self.start = np.flatnonzero(lead)
        self.end = np.flatnonzero(tail) + 1
        self.first = np.searchsorted(self.start, off)
        padded = np.zeros(n + 8, np.uint8)
        padded[:n] = to[raw]
        self.raw = padded
        self.hash = word_hashes(padded, self.start, self.end) if hashed else None

    def __len__(self) -> int:
        return len(self.start)


_LOW = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], U64)


def word_hashes(padded: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges, eight bytes a step; `padded` has eight bytes more than the text."""
    at = np.ndarray((max(len(padded) - 7, 0),), "<u8", buffer=padded, strides=(1,))
    length = end - start
    h = length.astype(U64) * M1
    piece = at[start] & _LOW[np.minimum(length, 8)] if len(start) else np.zeros(0, U64)
    h = mix(h ^ piece)
    more = np.flatnonzero(length > 8)
    step = 8
    while len(more):
        piece = at[start[more] + step] & _LOW[np.minimum(length[more] - step, 8)]
        h[more] = mix(h[more] * M1 + piece)
        step += 8
        more = more[length[more] > step]
    return h


def backward_hashes(w: Words, at: np.ndarray) -> np.ndarray:
    """An independent hash of chosen words: of their bytes read from the end."""
    eight = np.ndarray((max(len(w.raw) - 7, 0),), "<u8", buffer=w.raw, strides=(1,))
    h = np.zeros(len(at), U64)
    start, end = w.start[at], w.end[at]
    todo, back = np.arange(len(at)), 0
    while len(todo):
        left = end[todo] - back - start[todo]
        size = np.minimum(left, 8)
        piece = eight[end[todo] - back - size] & _LOW[size]
        h[todo] = mix(h[todo] * M2 + piece + size.astype(U64))
        back += 8
        todo = todo[left > 8]
    return seeded(h, 41)


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k consecutive word hashes, as if the words were one sequence; shorter than h by k - 1."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    out, width, have, done = None, 1, h, 0
    # doubling: a run of k words is put together from runs whose lengths are powers of two
    while True:
        if k & width:
            piece = have[done : done + n]
            out = piece.copy() if out is None else mix(out * M1 + piece)
            done += width
        if width * 2 > k:
            break
        have = mix(have[: len(have) - width] * M3 + have[width:])
        width *= 2
    return mix(out + U64(k))


def inside(first: np.ndarray, k: int, total: int) -> np.ndarray:
    """Which of the windows of k words stay in one row: booleans for window starts 0 .. total - k."""
    n = total - k + 1
    if n <= 0:
        return np.zeros(0, bool)
    ok = np.ones(n, bool)
    for back in range(1, k):
        at = first - back
        ok[at[(at >= 0) & (at < n)]] = False
    return ok
