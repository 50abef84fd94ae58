"""Vectorised word kernels over Arrow string buffers (NumPy, whole texts, bounded slices)."""

from __future__ import annotations

import contextlib
import ctypes
import hashlib
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_ODD = U64(0x9E3779B97F4A7C15)
_STEP = U64(0xD1342543DE82EF95)
#: Bytes of text that one kernel call holds; one longer document still is one call.
SLICE_BYTES = 1 << 20

def give_back() -> None:
    """Return freed memory to the system at a task's end: the worker stays, and other stages run beside it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def frugal(kernel, tokenizes: bool = False):
    """``kernel``, for mapInArrow, with memory given back at the end; unless it ``tokenizes``, a tokenizer that an earlier stage has left goes first."""

    def run(batches):
        pa.set_memory_pool(pa.system_memory_pool())  # what is freed can be given back
        if not tokenizes and (left := sys.modules.get(f"{__package__}.tokens")):
            left.coder.cache_clear()
        try:
            yield from kernel(batches)
        finally:
            give_back()

    return run


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply and shift)."""
    x = x ^ (x >> U64(31))
    x = x * U64(0x7FB5D329728EA185)
    x = x ^ (x >> U64(27))
    x = x * U64(0x81DADEF4BC2DD44D)
    return x ^ (x >> U64(33))


def byte_map(lower: bool) -> np.ndarray:
    """What each byte is read as: A-Z as a-z if ``lower``."""
    t = np.arange(256, dtype=np.uint8)
    if lower:
        t[65:91] = t[97:123]
    return t


def blank_separators() -> np.ndarray:
    """True for the bytes 0x20 and 0x09-0x0D."""
    s = np.zeros(256, bool)
    s[[0x20, *range(0x09, 0x0E)]] = True
    return s


BLANK, LOWER, EXACT = blank_separators(), byte_map(True), byte_map(False)
#: Bytes up to which a word is read in chunks of eight; longer ones are hashed by BLAKE2.
LONG_WORD = 64
_FIRST = np.array([(1 << (8 * k)) - 1 for k in range(9)], U64)


@dataclass
class Words:
    """Words of some documents: byte range, document index, 64-bit hash; ``first`` has each document's first word."""

    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    hash: np.ndarray
    first: np.ndarray


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes and n + 1 offsets of a string column; null is an empty text."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8) if offsets is not None and len(column) else np.zeros(len(column) + 1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offs


def slices(offs: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents of at most ``limit`` bytes together, or one document."""
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def hashes(b: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of the byte ranges ``b[start:end]``: eight bytes at a time are put through ``mix``, which isn't linear in them. Ranges of one
    length and up to eight bytes never collide; those over ``LONG_WORD`` bytes are read by BLAKE2. Another ``seed`` gives an independent hash."""
    n = end - start
    padded = np.zeros(len(b) + 8, np.uint8)
    padded[: len(b)] = b
    eight = np.ndarray((len(b) + 1,), "<u8", padded, strides=(1,))
    h = mix(n.astype(U64) * _ODD + U64(seed))
    live, at = np.flatnonzero(n <= LONG_WORD), 0
    while len(live):
        chunk = eight[start[live] + at] & _FIRST[np.minimum(n[live] - at, 8)]
        h[live] = mix((h[live] * _STEP if at else h[live]) ^ chunk)
        at += 8
        live = live[n[live] > at]
    for i in np.flatnonzero(n > LONG_WORD).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(b[start[i] : end[i]].tobytes(), digest_size=8, salt=seed.to_bytes(16, "little")).digest(), "little")
    return h


def words(data: np.ndarray, offs: np.ndarray, table: np.ndarray | None = LOWER, separators: np.ndarray = BLANK, cuts=None) -> Words:
    """Words of the documents ``data[offs[i]:offs[i + 1]]``; ``start`` and ``end`` count from ``offs[0]``.

    Words are hashed as ``table`` maps their bytes, or not at all without one. ``cuts``, given the bytes, says before which of them a word begins though no separator stands there.
    """
    b = data[offs[0] : offs[-1]]
    o = offs - offs[0]
    inside = ~separators[b]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    final = inside.copy()
    final[:-1] &= ~inside[1:]
    if cuts is not None and len(b):
        more = cuts(b) & inside
        begin |= more
        final[:-1] |= more[1:]
    edges = o[:-1][o[:-1] < len(b)]
    begin[edges] |= inside[edges]
    before = edges[edges > 0] - 1
    final[before] |= inside[before]
    start, end = np.flatnonzero(begin), np.flatnonzero(final) + 1
    first = np.searchsorted(start, o)
    return Words(start, end, np.repeat(np.arange(len(o) - 1), np.diff(first)), np.zeros(0, U64) if table is None else hashes(table[b], start, end), first)


def paired(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Hashes of the pairs (x[i], y[i])."""
    return mix(x * _STEP + mix(y ^ _ODD))


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` consecutive entries of ``h`` (over document ends too: mask those), put together from runs of powers of two."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    out, at, size, level = np.full(n, k, U64), 0, 1, h
    while size <= k:
        if k & size:
            out = paired(out, level[at : at + n])
            at += size
        if 2 * size <= k:
            level = paired(level[:-size], level[size:])
        size *= 2
    return out


def shingle_sets(data: np.ndarray, offs: np.ndarray, k: int = 5) -> Iterator[np.ndarray]:
    """For each document the sorted distinct hashes of its ``k``-word shingles; fewer words are one shingle, no words none."""
    for lo, hi in slices(offs):
        w = words(data, offs[lo : hi + 1])
        g = grams(w.hash, k)
        for i in range(hi - lo):
            a, z = int(w.first[i]), int(w.first[i + 1])
            if z - a >= k:
                yield np.unique(g[a : z - k + 1])
            elif z > a:
                yield grams(w.hash[a:z], z - a)
            else:
                yield np.zeros(0, U64)
