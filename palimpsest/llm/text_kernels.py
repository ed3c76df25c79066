"""Vectorised text kernels over Arrow string buffers: words, exact word ids, shingles, per-document sums.

All work on UTF-8 bytes. A block holds consecutive whole documents; a document is never cut. Whether words, lines or pieces are
equal is decided by Arrow's dictionary encoding, which compares bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Bytes of text that one block holds at most, but for a single longer document.
BLOCK_BYTES = 4 << 20
_U = np.uint64


def splitmix(n: int, seed: int) -> np.ndarray:
    """``n`` pseudo-random 64-bit values from a seed."""
    x = (np.arange(1, n + 1, dtype=_U) * _U(0x9E3779B97F4A7C15)) + _U(seed)
    return mix(x)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words that end at ASCII white space, and bytes of words of letters, digits and non-ASCII text.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, 9, 10, 11, 12, 13]] = False
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
#: The same after lower-casing, so that A-Z count too.
ALNUM_ANY = ALNUM[LOWER]


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (from 0) of a string or binary column; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    n = len(col)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(col.buffers()[1], np.int64 if wide else np.int32)[col.offset : col.offset + n + 1].astype(np.int64)
    data = col.buffers()[2]
    buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, off - off[0]


def blocks(buf: np.ndarray, off: np.ndarray, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first document, last + 1, bytes, offsets from 0) of runs of whole documents."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        yield i, j, buf[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def runs(mask: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of true bytes that don't cross documents."""
    if not len(mask):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.zeros(len(mask) + 1, bool)
    edge[off] = True
    before = np.empty(len(mask), bool)
    before[0] = True
    np.logical_not(mask[:-1], out=before[1:])
    before |= edge[:-1]
    after = np.empty(len(mask), bool)
    after[-1] = True
    np.logical_not(mask[1:], out=after[:-1])
    after |= edge[1:]
    return np.flatnonzero(mask & before), np.flatnonzero(mask & after) + 1


def words(buf: np.ndarray, off: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and, by document, the offset of its first word."""
    start, end = runs(is_word[buf], off)
    return start, end, np.searchsorted(start, off)


def span_bytes(buf: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = False) -> pa.Array:
    """The bytes of disjoint ascending spans as one Arrow column; with ``lower`` A-Z are lower-cased."""
    size = end - start
    off = np.zeros(len(start) + 1, np.int64)
    np.cumsum(size, out=off[1:])
    if not len(start):
        data = np.zeros(0, np.uint8)
    elif off[-1] == end[-1] - start[0]:
        data = buf[start[0] : end[-1]]
    else:
        step = np.zeros(len(buf) + 1, np.int8)
        np.add.at(step, start, 1)
        np.subtract.at(step, end, 1)
        data = buf[np.cumsum(step[:-1], dtype=np.int8) > 0]
    data = np.ascontiguousarray(LOWER[data] if lower else data)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(off), pa.py_buffer(data)])


def distinct(buf: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = False) -> tuple[np.ndarray, pa.Array]:
    """An id for every span and the distinct spans by id: two spans have one id exactly if all their bytes are equal."""
    coded = span_bytes(buf, start, end, lower).dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def hashes(spans: pa.Array) -> np.ndarray:
    """64-bit hashes of byte strings. They only propose: whatever rests on equality is decided on ids of ``distinct``."""
    buf, off = buffers(spans)
    data, off = buf.tobytes(), off.tolist()
    return np.fromiter((xxhash.xxh3_64_intdigest(data[a:b]) for a, b in zip(off[:-1], off[1:], strict=True)), _U, len(spans))


def shingles(ids: np.ndarray, word_off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Exact codes of all k-word shingles of word ids, and the offset of each document's first.

    Equal codes stand for equal words. A document of fewer than ``k`` words has no codes here.
    """
    n = np.diff(word_off)
    count = np.maximum(n - k + 1, 0)
    s_off = np.concatenate([[0], np.cumsum(count)]).astype(np.int64)
    at = np.repeat(word_off[:-1] - s_off[:-1], count) + np.arange(s_off[-1])
    base = int(ids.max()) + 1 if len(ids) else 1
    code, top = ids[at], base
    for j in range(1, k):
        if top > (1 << 62) // base:
            known, code = np.unique(code, return_inverse=True)
            top = len(known)
        code, top = code * base + ids[at + j], top * base
    return code, s_off


def shingle_hashes(h: np.ndarray, word_off: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the same shingles from the hashes of their words, in the order of ``shingles``."""
    count = np.maximum(np.diff(word_off) - k + 1, 0)
    first = np.concatenate([[0], np.cumsum(count)])
    at = np.repeat(word_off[:-1] - first[:-1], count) + np.arange(first[-1])
    out = h[at]
    for j in range(1, k):
        out = mix(out * _U(0xD6E8FEB86659FD93) + h[at + j])
    return out


def valid_text(col: pa.Array) -> pa.Array:
    """A string column whose bytes are all UTF-8: in rows that are not, bad bytes become U+FFFD."""
    buf, _ = buffers(col)
    try:
        buf.tobytes().decode()
        return col
    except UnicodeDecodeError:
        return pa.array([None if x is None else x.decode("utf-8", "replace") for x in col.cast(pa.large_binary()).to_pylist()], pa.large_string())


def sums(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sums of consecutive values by document; 0 for empty documents."""
    total = np.zeros(len(values) + 1, np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[off[1:]] - total[off[:-1]]


def within(start: np.ndarray, off: np.ndarray) -> np.ndarray:
    """The document of each position."""
    return np.searchsorted(off, start, "right") - 1
