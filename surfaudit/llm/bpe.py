"""Byte-level BPE: encoding by rank files and decoding by ids.

Texts are cut into pieces without a regular expression: code points become classes, a class with
its look-ahead becomes a symbol, and each symbol is a function from the state before it to the
state after it.  Functions compose associatively, so the states of all places come from a scan:
blocks are composed for every entry state at once, block functions are scanned by doubling, and
one more pass inside the blocks yields the places where a piece starts.  Pieces are then merged
by rank, through a cache.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from surfaudit.llm.common import slices

RANKS = "byte_bpe_50k.tiktoken"
CACHE_PIECES = 1 << 18
SLICE_CHARS = 1 << 20  # text whose pieces are held at once
LONG_PIECE = 64  # bytes from which merges are kept in a heap
BLOCK = 64
NONE = 1 << 30

# White space as Unicode's White_Space property has it.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
# Contractions that are pieces of their own, after the apostrophe.
SHORT_ENDS, LONG_ENDS = ("s", "t", "m", "d"), ("re", "ve", "ll")

LETTER, NUMBER, OTHER, SPACE, WHITE, BREAK = range(6)  # classes
S_LETTER, S_NUMBER, S_OTHER, S_SHORT, S_LONG, S_SPACE, S_WHITE, S_RUN, S_BREAK = range(9)  # symbols
(Q_FREE, Q_LETTERS, Q_NUMBERS, Q_OTHERS, Q_SPACE, Q_WHITES, Q_ONE, Q_TWO), STATES, SYMBOLS = range(8), 8, 9
SEPARATOR = "\ud800"  # a lone surrogate is in no UTF-8 text


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """Flat tables over state * SYMBOLS + symbol: the next state, and whether a piece starts.

    S_SPACE is a blank right before a non-space, which joins the piece that follows; S_WHITE is
    any other white space there, a piece of its own; S_RUN is white space before white space or
    the end.  S_SHORT and S_LONG are apostrophes that a contraction of one or two letters follows.
    """
    to, starts = np.zeros((STATES, SYMBOLS), dtype=np.uint8), np.ones((STATES, SYMBOLS), dtype=bool)
    for symbol, state in (
        (S_LETTER, Q_LETTERS), (S_NUMBER, Q_NUMBERS), (S_OTHER, Q_OTHERS), (S_SHORT, Q_ONE), (S_LONG, Q_TWO),
        (S_SPACE, Q_SPACE), (S_WHITE, Q_FREE), (S_RUN, Q_WHITES), (S_BREAK, Q_FREE),
    ):
        to[:, symbol] = state
    for symbol, state in ((S_LETTER, Q_LETTERS), (S_NUMBER, Q_NUMBERS), (S_OTHER, Q_OTHERS), (S_SHORT, Q_OTHERS), (S_LONG, Q_OTHERS)):
        for before in (state, Q_SPACE):
            to[before, symbol], starts[before, symbol] = state, False
    starts[Q_WHITES, S_RUN] = False
    to[Q_TWO, S_LETTER], starts[Q_TWO, S_LETTER] = Q_ONE, False
    to[Q_ONE, S_LETTER], starts[Q_ONE, S_LETTER] = Q_FREE, False
    return to.ravel(), starts.ravel()


_TO, _STARTS = _automaton()
_classes: list[np.ndarray] = []


def code_point_classes() -> np.ndarray:
    """Class of every code point, built once per process."""
    if not _classes:
        kind = {"L": LETTER, "N": NUMBER}
        table = np.fromiter((kind.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), dtype=np.uint8, count=0x110000)
        table[WHITE_SPACE] = WHITE
        table[0x20] = SPACE
        table[ord(SEPARATOR)] = BREAK
        _classes.append(table)
    return _classes[0]


def _symbols(points: np.ndarray) -> np.ndarray:
    kind = code_point_classes()[points]
    after = np.append(kind[1:], np.uint8(BREAK))
    solid = after <= OTHER
    symbol = np.array([S_LETTER, S_NUMBER, S_OTHER, S_RUN, S_RUN, S_BREAK], dtype=np.uint8)[kind]
    symbol[(kind == SPACE) & solid] = S_SPACE
    symbol[(kind == WHITE) & solid] = S_WHITE
    quote = np.flatnonzero(points == 0x27)
    if len(quote):
        ahead = np.append(points, np.zeros(2, dtype=points.dtype))
        one, two = ahead[quote + 1], ahead[quote + 2]
        symbol[quote[np.isin(one, [ord(c) for c in SHORT_ENDS])]] = S_SHORT
        for a, b in LONG_ENDS:
            symbol[quote[(one == ord(a)) & (two == ord(b))]] = S_LONG
    return symbol


def piece_starts(points: np.ndarray) -> np.ndarray:
    """Places where a piece starts; every separator is a piece."""
    n = len(points)
    blocks = -(-n // BLOCK)
    symbol = np.full(blocks * BLOCK, S_BREAK, dtype=np.uint8)
    symbol[:n] = _symbols(points)
    by_step = np.ascontiguousarray(symbol.reshape(blocks, BLOCK).T)
    after = np.repeat(np.arange(STATES, dtype=np.uint8)[:, None], blocks, axis=1)  # state at entry -> state now
    for step in by_step:
        after = _TO[after * np.uint8(SYMBOLS) + step]
    whole = np.ascontiguousarray(after.T)
    reach = 1
    while reach < blocks:  # whole[i] becomes the composition of all blocks up to i
        whole[reach:] = np.take_along_axis(whole[reach:], whole[:-reach].copy(), axis=1)
        reach *= 2
    state = np.append(np.uint8(Q_FREE), whole[:-1, Q_FREE])
    starts = np.empty((BLOCK, blocks), dtype=bool)
    for i, step in enumerate(by_step):
        at = state * np.uint8(SYMBOLS) + step
        starts[i] = _STARTS[at]
        state = _TO[at]
    return np.flatnonzero(starts.T.ravel()[:n])


def merge_ranks(piece: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """Ids of one piece: the adjacent pair of lowest rank, leftmost first, is joined until none is left."""
    whole = ranks.get(piece)
    if whole is not None:
        return (whole,)
    if len(piece) >= LONG_PIECE:
        return _merge_long(piece, ranks)
    parts = [piece[i : i + 1] for i in range(len(piece))]
    of = [ranks.get(a + b, NONE) for a, b in zip(parts, parts[1:])]
    while of:
        low = min(of)
        if low == NONE:
            break
        i = of.index(low)
        parts[i] += parts.pop(i + 1)
        del of[i]
        if i:
            of[i - 1] = ranks.get(parts[i - 1] + parts[i], NONE)
        if i < len(of):
            of[i] = ranks.get(parts[i] + parts[i + 1], NONE)
    return tuple(ranks[p] for p in parts)


def _merge_long(piece: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """The same with a heap of candidate pairs; entries whose ends have moved are passed over."""
    n = len(piece)
    end = list(range(1, n + 1))  # end of the part that starts here
    start = list(range(n))  # start of the part that ends here, by its last place
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    alive = [True] * n
    while heap:
        _, i, stop = heapq.heappop(heap)
        middle = end[i]
        if not alive[i] or middle >= n or end[middle] != stop:
            continue
        alive[middle] = False
        end[i] = stop
        start[stop - 1] = i
        if stop < n and (r := ranks.get(piece[i : end[stop]])) is not None:
            heapq.heappush(heap, (r, i, end[stop]))
        if i and (r := ranks.get(piece[start[i - 1] : stop])) is not None:
            heapq.heappush(heap, (r, start[i - 1], stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return tuple(out)


class Vocabulary:
    """Ranks of a file, a bounded cache of merged pieces, and byte tables for decoding."""

    _loaded: dict[str, Vocabulary] = {}

    def __init__(self, path: str):
        with open(path, "rb") as file:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        size = max(self.ranks.values()) + 1
        tokens = [b""] * size
        for token, rank in self.ranks.items():
            tokens[rank] = token
        self.length = np.fromiter(map(len, tokens), dtype=np.int64, count=size)
        self.first = np.cumsum(self.length) - self.length
        self.bytes = np.frombuffer(b"".join(tokens), dtype=np.uint8)
        self.cache: dict[str, tuple[int, ...]] = {}

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        """Once per process."""
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def _merged(self, piece: str) -> tuple[int, ...]:
        if len(self.cache) >= CACHE_PIECES:
            self.cache.clear()
        ids = self.cache[piece] = merge_ranks(piece.encode(), self.ranks)
        return ids

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        joined = SEPARATOR.join(texts)
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype="<u4")
        starts = piece_starts(points)
        size = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        begin = np.cumsum(size + 1) - size - 1  # of each text in ``joined``
        cut = np.searchsorted(starts, np.append(begin, len(points) + 1))
        get, out = self.cache.get, []
        for i, text in enumerate(texts):
            at = starts[cut[i] : cut[i + 1]] - begin[i]
            at = at[at < size[i]].tolist()
            pieces = [text[a:b] for a, b in zip(at, [*at[1:], len(text)])]
            merged = [get(p) or self._merged(p) for p in pieces]
            out.append(np.fromiter(chain.from_iterable(merged), dtype=np.int32))
        return out

    def offsets(self, ids: np.ndarray) -> np.ndarray:
        """Byte at which each token starts."""
        length = self.length[ids]
        return np.cumsum(length) - length

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> bytes:
        length = self.length[ids]
        source = np.repeat(self.first[ids] - offsets, length) + np.arange(length.sum())
        return self.bytes[source].tobytes()


def _lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    ends = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts) if parts else [], kind))


def encode_texts(
    docs: DataFrame, ranks_path: str | None = None, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False
) -> DataFrame:
    """(doc_id, ids, offsets): token ids and the byte at which each token starts.

    Special tokens are ordinary text here.  Null and empty texts have no token; rows that repeat
    a doc_id, or have none, are rows of their own.  With ``decoded`` the same task decodes the ids
    again, into a column of bytes.
    """
    path = ranks_path or public_tokenizers.path(RANKS)
    names = ["doc_id", "ids", "offsets", *["decoded"] * decoded]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary.load(path)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for part in slices([len(t or "") for t in texts], SLICE_CHARS):
                ids = vocabulary.encode([t or "" for t in texts[part]])
                offsets = [vocabulary.offsets(x).astype(np.int32) for x in ids]
                columns = [batch.column("doc_id").slice(part.start, len(ids)), _lists(ids, pa.int32()), _lists(offsets, pa.int32())]
                if decoded:
                    columns.append(pa.array(list(map(vocabulary.decode, ids, offsets)), pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names)

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, ids array<int>, offsets array<int>" + ", decoded binary" * decoded)


def decode_ids(ids: Column | str, offsets: Column | str, ranks_path: str | None = None) -> Column:
    """Bytes of a row's tokens, put together at their offsets."""
    path = ranks_path or public_tokenizers.path(RANKS)

    @F.pandas_udf("binary")
    def run(ids: pd.Series, offsets: pd.Series) -> pd.Series:
        vocabulary = Vocabulary.load(path)
        return pd.Series([vocabulary.decode(np.asarray(i, dtype=np.int64), np.asarray(o, dtype=np.int64)) for i, o in zip(ids, offsets)], dtype=object)

    return run(ids, offsets)
