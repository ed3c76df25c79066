"""Statistics of whole documents, computed by block over UTF-8 buffers; shared by the quality rules and the classifiers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .text_kernels import NOT_SPACE, blocks, buffers, distinct, mix, runs, shingle_hashes, shingles, sums, within

#: Characters that count as symbols, and those that mark code or markup.
SYMBOLS = "#*$%&|<>"
CODE = "{}[]();=_/\\"
CLOSING = ".!?:\"'"

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = (
    "log_words", "word_len", "symbol_rate", "dup_line_rate", "repeat_rate", "upper_rate", "digit_rate", "bang_rate", "pipe_rate",
    "code_rate", "punct_rate", "distinct_rate", "line_len", "closed_line_rate", "short_line_rate", "max_word", "non_ascii_rate", "adjacent_same_rate", "capital_word_rate", "no_alpha_word_rate",
)
_U = np.uint64


def _table(chars: str) -> np.ndarray:
    t = np.zeros(256, bool)
    t[[ord(c) for c in chars]] = True
    return t


_SYMBOL, _CODE, _CLOSING = _table(SYMBOLS), _table(CODE), _table(CLOSING)
_UPPER, _DIGIT, _ALPHA, _PUNCT, _CHAR = (np.zeros(256, bool) for _ in range(5))
_UPPER[65:91] = True
_DIGIT[48:58] = True
_ALPHA[65:91] = _ALPHA[97:123] = _ALPHA[0x80:] = True
_PUNCT[[ord(c) for c in ".,;:!?'\"-"]] = True
_CHAR[:0x80] = _CHAR[0xC0:] = True


def block_stats(buf: np.ndarray, off: np.ndarray, window: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """(documents x BASE as integers, documents x FEATURES) of one block."""
    n = len(off) - 1
    base = np.zeros((n, len(BASE)), np.int64)
    feats = np.zeros((n, len(FEATURES)))
    if not len(buf):
        return base, feats
    in_word = NOT_SPACE[buf]
    start, end = runs(in_word, off)
    w_off = np.searchsorted(start, off)
    nw = np.diff(w_off)
    chars = np.concatenate([[0], np.cumsum(_CHAR[buf] & in_word)])
    wlen = chars[end] - chars[start]
    ids, _ = distinct(buf, start, end)
    base[:, 0] = nw
    base[:, 1] = chars[off[1:]] - chars[off[:-1]]
    count = lambda table: sums(table[buf], off)
    base[:, 2] = count(_SYMBOL)

    # lines with a word, told apart by all their bytes: equal to an earlier one of the document
    l_start, l_end = _lines(buf, off)
    l_doc = within(l_start, off)
    has_word = np.searchsorted(start, l_end) > np.searchsorted(start, l_start)
    l_start, l_end, l_doc = l_start[has_word], l_end[has_word], l_doc[has_word]
    line_id, _ = distinct(buf, l_start, l_end)
    l_off = np.searchsorted(l_doc, np.arange(n + 1))
    # hashes of all windows of the block: only documents in which two agree are looked at by their words
    win = shingle_hashes(mix(ids.astype(_U)), w_off, window)
    win_off = np.concatenate([[0], np.cumsum(np.maximum(nw - window + 1, 0))])
    n_distinct = np.zeros(n)
    for d in range(n):
        a, b = l_off[d], l_off[d + 1]
        if b - a > 1:
            base[d, 3] = b - a - len(np.unique(line_id[a:b]))
        mine = ids[w_off[d] : w_off[d + 1]]
        if nw[d]:
            n_distinct[d] = len(np.unique(mine))
        s = np.sort(win[win_off[d] : win_off[d + 1]])
        if (s[1:] == s[:-1]).any():
            base[d, 4] = _repeated(mine, window)

    w = np.maximum(nw, 1)
    c = np.maximum(base[:, 1], 1)
    nl = np.maximum(np.diff(l_off), 1)
    feats[:, 0] = np.log1p(nw)
    feats[:, 1] = base[:, 1] / w
    feats[:, 2] = base[:, 2] / w
    feats[:, 3] = base[:, 3] / nl
    feats[:, 4] = base[:, 4] / w
    feats[:, 5] = count(_UPPER) / c
    feats[:, 6] = count(_DIGIT) / c
    feats[:, 7] = count(_table("!")) / w
    feats[:, 8] = count(_table("|")) / w
    feats[:, 9] = count(_CODE) / c
    feats[:, 10] = count(_PUNCT) / w
    feats[:, 11] = n_distinct / w**0.75
    feats[:, 12] = nw / nl
    if len(l_end):
        last = np.searchsorted(end, l_end, "right") - 1  # the last word that ends in the line
        feats[:, 13] = np.bincount(l_doc, _CLOSING[buf[end[last] - 1]], n) / nl
        feats[:, 14] = np.bincount(l_doc, (np.searchsorted(start, l_end) - np.searchsorted(start, l_start)) <= 4, n) / nl
    if len(start):
        full = nw > 0
        feats[full, 15] = np.log1p(np.maximum.reduceat(wlen, w_off[:-1][full]))
        same = np.zeros(len(ids), bool)
        same[1:] = ids[1:] == ids[:-1]
        same[w_off[:-1][full]] = False
        feats[:, 17] = sums(same, w_off) / w
        feats[:, 18] = sums(_UPPER[buf[start]], w_off) / w
        alpha = np.concatenate([[0], np.cumsum(_ALPHA[buf])])
        feats[:, 19] = sums(alpha[end] == alpha[start], w_off) / w
    feats[:, 16] = count(np.arange(256) >= 0xC0) / c
    return base, feats


def _repeated(ids: np.ndarray, window: int) -> int:
    """Words of a document that stand in a window found twice or more."""
    code, _ = shingles(ids, np.array([0, len(ids)]), window)
    _, at, many = np.unique(code, return_inverse=True, return_counts=True)
    first = np.flatnonzero(many[at] > 1)
    cover = np.zeros(len(ids) + 1, np.int64)
    cover[first] += 1
    cover[first + window] -= 1
    return int(np.count_nonzero(np.cumsum(cover[:-1]) > 0))


def _lines(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return runs(buf != 10, off)


def column_stats(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """BASE and FEATURES of every text of an Arrow column; null counts as empty."""
    buf, off = buffers(col)
    parts = [block_stats(b, o) for _, _, b, o in blocks(buf, off)]
    if not parts:
        return np.zeros((0, len(BASE)), np.int64), np.zeros((0, len(FEATURES)))
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
