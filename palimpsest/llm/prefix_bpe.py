"""Byte-level BPE by prefix dynamic programming.

For every byte prefix of a piece the encoding ends in exactly one token. It is the token ending there that may follow
the last token of the prefix before it: the pair is stable when encoding their joined bytes gives the two tokens again.
So one table (last token by prefix) holds the encodings of all prefixes: appending bytes extends it, and after an edit only the
entries near it are made again. Text is cut into pieces by the published pattern, each piece encoded alone.

Defined cases: null and empty texts have no ids; bytes that are not UTF-8 are read as U+FFFD; repeated rows agree; rows without id are dropped; further columns are ignored;
pieces of any length take time in proportion to their bytes times the longest token.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .spark_util import map_arrow, with_id
from .text_kernels import blocks, buffers, distinct, valid_text

#: Bytes of pieces and their ids that a worker remembers, and pairs of tokens it has tried; beyond that the memory starts anew.
CACHE_BYTES = 64 << 20
CACHE_PAIRS = 2_000_000


class PrefixBPE:
    def __init__(self, ranks: dict[bytes, int]):
        self.rank = ranks
        self.token = [b""] * (max(ranks.values()) + 1)
        for b, r in ranks.items():
            self.token[r] = b
        self.longest = max(map(len, ranks))
        #: The two tokens whose merge made each token (itself twice for single bytes); None if merging never makes it.
        self.halves: list[tuple[int, int] | None] = [None] * len(self.token)
        for b, r in sorted(ranks.items(), key=lambda x: x[1]):
            if len(b) == 1:
                self.halves[r] = (r, r)
            else:
                parts = self._merge(b, r)
                if len(parts) == 2:
                    self.halves[r] = (ranks[parts[0]], ranks[parts[1]])
        #: Tokens by their bytes from the last to the first: (state << 8 | byte) -> state, and the token of a state.
        self.step: dict[int, int] = {}
        self.token_at: list[int] = [-1]
        for b, r in ranks.items():
            if self.halves[r] is None:
                continue
            state = 0
            for byte in reversed(b):
                key = state << 8 | byte
                state = self.step.get(key, -1)
                if state < 0:
                    state = self.step[key] = len(self.token_at)
                    self.token_at.append(-1)
            self.token_at[state] = r
        self._stable: dict[int, bool] = {}

    def _merge(self, piece: bytes, below: int) -> list[bytes]:
        """Merge by rank, lowest first, using only ranks under ``below``."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        get = self.rank.get
        while len(parts) > 1:
            best, at = below, -1
            for i in range(len(parts) - 1):
                r = get(parts[i] + parts[i + 1])
                if r is not None and r < best:
                    best, at = r, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def stable(self, left: int, right: int) -> bool:
        """Whether the bytes of ``left`` and ``right`` together encode as these two tokens.

        Undo merges from the last one on: whichever of the two facing tokens was made later is split, and its facing
        half must not have merged across the border before that point.
        """
        key = left * len(self.token) + right
        known = self._stable.get(key)
        if known is None:
            known = self._check(left, right)
            if len(self._stable) > CACHE_PAIRS:
                self._stable.clear()
            self._stable[key] = known
        return known

    def _check(self, a: int, b: int) -> bool:
        token, rank, halves = self.token, self.rank, self.halves
        limit = len(token)  # merges of this rank or later haven't happened yet
        while True:
            across = rank.get(token[a] + token[b])
            if across is not None and across < limit:
                return False
            single_a, single_b = len(token[a]) == 1, len(token[b]) == 1
            if single_a and single_b:
                return True
            if single_b or (not single_a and a > b):
                limit, a = a, halves[a][1]
            else:
                # equal ranks: the left one merges first, so the border still faces the whole left token
                limit, b = b + 1, halves[b][0]

    def last_tokens(self, data: bytes, table: list[int] | None = None, upto: int | None = None) -> list[int]:
        """``table[i]``: the last token of the encoding of ``data[:i]`` (i from 1); a given table of a prefix is extended up to ``upto``."""
        last = table if table is not None else [-1]
        step, token_at, known, stable, base = self.step.get, self.token_at, self._stable.get, self.stable, len(self.token)
        for i in range(len(last), (len(data) if upto is None else upto) + 1):
            state, j, found = 0, i, []
            while j:
                state = step(state << 8 | data[j - 1], -1)
                if state < 0:
                    break
                j -= 1
                if token_at[state] >= 0:
                    found.append((token_at[state], j))
            for t, j in reversed(found):  # the longest first; just one is stable
                if not j:
                    break
                ok = known(last[j] * base + t)
                if ok or (ok is None and stable(last[j], t)):
                    break
            last.append(t)
        return last

    def trace(self, data: bytes, last: list[int]) -> list[int]:
        out, i = [], len(data)
        while i:
            out.append(last[i])
            i -= len(self.token[last[i]])
        return out[::-1]

    def encode_piece(self, data: bytes) -> list[int]:
        """The ids of one piece; a piece that is a token itself is that token."""
        whole = self.rank.get(data)
        if whole is not None:
            return [whole]
        return self.trace(data, self.last_tokens(data))

    def decode(self, ids) -> bytes:
        return b"".join([self.token[i] for i in ids])


class PrefixTable:
    """The encodings of all prefixes of a growing byte string."""

    def __init__(self, bpe: PrefixBPE, data: bytes = b""):
        self.bpe, self.data, self.last = bpe, b"", [-1]
        self.append(data)

    def append(self, more: bytes) -> None:
        self.data += more
        self.bpe.last_tokens(self.data, self.last)

    def replace(self, start: int, end: int, new: bytes) -> None:
        """Put ``new`` for ``data[start:end]`` and encode again near the edit only.

        The table before ``start`` stays. An entry rests on the bytes and entries of one longest token before it, so
        once that many entries behind the edit are what they were, all that follow are too.
        """
        was, moved, reach = self.last, len(new) - (end - start), self.bpe.longest
        self.last = was[: start + 1]
        self.data = self.data[:start] + new + self.data[end:]
        n, clean = len(self.data), start + len(new) + reach
        while (i := len(self.last) - 1) < n:
            if i >= clean and self.last[i - reach + 1 :] == was[i - reach + 1 - moved : i + 1 - moved]:
                self.last += was[i + 1 - moved :]
                break
            self.bpe.last_tokens(self.data, self.last, min(n, max(clean, i + reach)))

    def ids(self, upto: int | None = None) -> list[int]:
        return self.bpe.trace(self.data[:upto], self.last)


def from_ranks(data: bytes) -> PrefixBPE:
    return PrefixBPE({base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)})


@lru_cache(maxsize=1)
def char_classes() -> np.ndarray:
    """Class of every code point: 0 white space, 1 letter, 2 number, 3 other."""
    chars = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    out = np.full(0x110000, 3, np.uint8)
    for value, name in ((1, r"\p{L}+"), (2, r"\p{N}+"), (0, r"\s+")):
        for m in regex.finditer(name, chars):
            points = np.arange(m.start(), m.end())
            out[np.where(points >= 0xD800, points + 0x800, points)] = value
    return out


def piece_starts(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Byte offsets at which the pieces of the published pattern begin, for a block of documents.

    Works on runs of one class: a run of letters, numbers or others takes one plain space before it; of white space before
    text the last character stands alone or goes with the text; the English contractions follow an apostrophe that begins a piece.
    """
    if not len(buf):
        return np.zeros(0, np.int64)
    at = np.flatnonzero((buf & 0xC0) != 0x80)
    point = np.frombuffer(buf.tobytes().decode().encode("utf-32-le"), "<u4")
    cls = char_classes()[point]
    n = len(point)
    first = np.zeros(n + 1, bool)
    first[np.searchsorted(at, off)] = True
    same = np.zeros(n + 1, bool)  # the character before is in the same document
    same[1:n] = ~first[1:n]
    new = ~same[:n]
    new[1:] |= cls[1:] != cls[:-1]
    space = cls == 0
    plain = point == 32
    # text runs begin at their first character, or at the plain space before it
    before = np.zeros(n, bool)
    before[1:] = plain[:-1]
    before &= same[:n]
    start = new & ~space & ~before
    # white-space runs begin at their first character; the last one before text begins a piece too
    start |= new & space
    text_next = np.zeros(n, bool)
    text_next[:-1] = ~space[1:] & same[1:n]
    start |= space & text_next
    # contractions
    alone = new & (point == 39) & ~before
    alone[:-1] &= new[1:]
    alone[-1] = False
    for i in np.flatnonzero(alone):
        if not same[i + 1] or cls[i + 1] != 1:
            continue
        a = point[i + 1]
        b = point[i + 2] if i + 2 < n and same[i + 2] else 0
        size = 1 if a in (0x73, 0x74, 0x6D, 0x64) else 2 if (a, b) in ((0x72, 0x65), (0x76, 0x65), (0x6C, 0x6C)) else 0
        if size:
            start[i + 1] = False
            if i + 1 + size < n:
                start[i + 1 + size] = True
    return at[start]


class TextCodec:
    """Blocks of whole texts to ids and back; each distinct piece is encoded once, in byte order, so that prefixes are shared."""

    def __init__(self, bpe: PrefixBPE, cache: int = CACHE_BYTES):
        self.bpe, self.most, self.held = bpe, cache, 0
        self.seen: dict[bytes, bytes] = {}
        self.size = np.array([len(t) for t in bpe.token], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.size)])[:-1]
        self.bytes = np.frombuffer(b"".join(bpe.token), np.uint8)

    def learn(self, pieces: list[bytes]) -> None:
        """Put the ids of new pieces into the memory."""
        bpe, seen = self.bpe, self.seen
        table, was = [-1], b""
        for piece in sorted(pieces):
            whole = bpe.rank.get(piece)
            if whole is not None:
                seen[piece] = whole.to_bytes(4, "little")
                continue
            k, most = 0, min(len(piece), len(was))
            while k < most and piece[k] == was[k]:
                k += 1
            del table[k + 1 :]
            bpe.last_tokens(piece, table)
            was = piece
            seen[piece] = struct.pack(f"<{len(ids)}I", *ids) if (ids := bpe.trace(piece, table)) else b""

    def encode_block(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a block and each document's offset in them."""
        start = piece_starts(buf, off)
        if not len(start):
            return np.zeros(0, np.uint32), np.zeros(len(off), np.int64)
        end = np.append(start[1:], len(buf))
        inverse, known = distinct(buf, start, end)
        pieces = known.to_pylist()
        if self.held > self.most:
            self.seen.clear()
            self.held = 0
        new = [p for p in pieces if p not in self.seen]
        self.learn(new)
        self.held += sum(len(p) + len(self.seen[p]) for p in new) + 200 * len(new)
        packed = [self.seen[p] for p in pieces]
        many = np.array([len(p) // 4 for p in packed], np.int64)
        ids = self._spread(np.frombuffer(b"".join(packed), "<u4"), np.concatenate([[0], np.cumsum(many)])[:-1][inverse], many[inverse])
        total = np.concatenate([[0], np.cumsum(many[inverse])])
        return ids, total[np.searchsorted(start, off)]

    @staticmethod
    def _spread(values: np.ndarray, first: np.ndarray, many: np.ndarray) -> np.ndarray:
        """``values[first[i] : first[i] + many[i]]`` for all i, one after the other."""
        end = np.cumsum(many)
        return values[np.arange(end[-1] if len(end) else 0) + np.repeat(first - (end - many), many)]

    def decode(self, ids: np.ndarray) -> bytes:
        ids = ids.astype(np.int64)
        return self._spread(self.bytes, self.start[ids], self.size[ids]).tobytes()


_CODECS: dict[str, TextCodec] = {}


MADE = ("n_tokens", "ids_sha256", "decoded_sha256", "ids")


def encode_texts(docs: DataFrame, ranks: bytes, keep_ids: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` (and ``ids`` where asked for) of every whole text; no shuffle.

    ``ranks`` are the contents of the rank file: its size is that of a vocabulary, so it goes to the workers by broadcast.
    ``keep``: columns of ``docs`` that go along, but for those named like a result.
    """
    known = docs.sparkSession.sparkContext.broadcast(ranks)
    name = hashlib.sha256(ranks).hexdigest()
    keep = [c for c in keep if c != "doc_id" and c not in MADE]
    made = MADE if keep_ids else MADE[:3]

    def run(batches):
        codec = _CODECS.get(name)
        if codec is None:
            codec = _CODECS[name] = TextCodec(from_ranks(known.value))
        for b in batches:
            n, sha, back, kept = [], [], [], []
            buf, off = buffers(valid_text(b.column(1)))
            for _, _, bb, oo in blocks(buf, off):
                ids, at = codec.encode_block(bb, oo)
                n.append(np.diff(at))
                data = ids.astype("<u4").tobytes()
                if keep_ids:
                    kept.append(ids.astype(np.int32))
                for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                    sha.append(hashlib.sha256(data[4 * lo : 4 * hi]).hexdigest())
                    back.append(hashlib.sha256(codec.decode(ids[lo:hi])).hexdigest())
            many = np.concatenate(n) if n else np.zeros(0, np.int64)
            out = [b.column(0), *b.columns[2:], pa.array(many), pa.array(sha, pa.string()), pa.array(back, pa.string())]
            if keep_ids:
                flat = pa.array(np.concatenate(kept) if kept else np.zeros(0, np.int32))
                out.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(many)]).astype(np.int32)), flat))
            yield pa.RecordBatch.from_arrays(out, names=["doc_id", *keep, *made])

    kinds = {f.name: f.dataType for f in docs.schema}
    types = {"n_tokens": T.LongType(), "ids": T.ArrayType(T.IntegerType())}
    schema = T.StructType([T.StructField("doc_id", kinds["doc_id"]), *(T.StructField(c, kinds[c]) for c in keep), *(T.StructField(c, types.get(c, T.StringType())) for c in made)])
    rows = with_id(docs, "doc_id").select("doc_id", F.col("text").alias("_read"), *(F.col(f"`{c}`") for c in keep))
    return map_arrow(rows, run, schema)
