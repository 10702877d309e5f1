"""What several corpus operators share: tables, row identity, word hashes, written cuts."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from surfaudit.session import checkpoint_dir

NO_ID = -(1 << 63)  # stands for a null id inside an operator; it sorts before all others
MEMO_WORDS = 1 << 18  # words a task remembers the hash of before it starts afresh
BLOCK_BYTES = 16 << 20  # text of a block of documents that is handled together
ROWS_AT_ONCE = 256  # texts of a batch that are held outside it
SLICE_BYTES = 1 << 22  # text handled at once inside a batch


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialize(df: DataFrame) -> DataFrame:
    """A written table in the shared checkpoint folder: cuts lineage and survives lost executors."""
    path = f"{checkpoint_dir(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def in_blocks(rows: DataFrame, ids: DataFrame, block_bytes: int) -> tuple[DataFrame, DataFrame]:
    """``rows`` (doc_id, text) and ``ids`` (_id) with a ``block`` that sends equal ids together.

    A block has about ``block_bytes`` of text.  Rows without an id are dealt by their text.
    """
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks))
    own = F.when(F.col("doc_id").isNotNull(), place("doc_id")).otherwise(place("text"))
    target = F.col("_id").cast("bigint")
    return rows.select("doc_id", "text", own.alias("block")), ids.select(target.alias("_id"), place(target).alias("block"))


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def text_bytes(batch: pa.RecordBatch, name: str = "text") -> Iterator[bytes | None]:
    """UTF-8 of a text column, without decoding it and a few rows at a time."""
    column = batch.column(name)
    for i in range(0, len(column), ROWS_AT_ONCE):
        yield from column.slice(i, ROWS_AT_ONCE).cast(pa.binary()).to_pylist()


def slices(sizes: list[int], most: int = SLICE_BYTES) -> Iterator[slice]:
    """Cuts a batch into runs of about ``most`` bytes; a longer text is a run of its own."""
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > most:
            yield slice(start, i)
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield slice(start, len(sizes))


WHITE = np.zeros(256, dtype=bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
HASHED_BYTES = 1 << 20  # whose word hashes are computed at once
LONG_WORD = 1 << 8  # longer words are hashed one by one


class Words:
    """Words of several texts: runs of anything but ASCII white space, found in one buffer.

    ``start`` and ``end`` are byte places, ``text`` is the number of the text a word lies in and
    ``first`` the number of the first word of each text (and of all words at its end).
    """

    def __init__(self, texts: list[bytes | None], apart: np.ndarray | None = None):
        """``apart``: True for the bytes between words, a line feed among them; white space if not given."""
        size = np.fromiter((len(t) if t else 0 for t in texts), dtype=np.int64, count=len(texts))
        # The white space after each text ends its last word.
        self.bytes = np.frombuffer(b"".join(x for t in texts for x in (t or b"", b"\n")), dtype=np.uint8)
        solid = ~(WHITE if apart is None else apart)[self.bytes]
        turn = np.flatnonzero(solid[1:] != solid[:-1]) + 1
        if len(solid) and solid[0]:
            turn = np.concatenate(([0], turn))
        self.start, self.end = turn[::2], turn[1::2]
        begin = np.cumsum(size + 1) - size - 1
        self.first = np.append(np.searchsorted(self.start, begin), len(self.start))
        self.text = np.repeat(np.arange(len(texts)), np.diff(self.first))
        self._solid = solid

    def __len__(self) -> int:
        return len(self.start)

    def spaced(self) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, place): all words with one space after each, and where each word starts there."""
        keep = self._solid.copy()
        keep[self.end] = True
        out = np.where(self._solid, self.bytes, np.uint8(0x20))[keep]
        size = self.end - self.start + 1
        return out, np.cumsum(size) - size

    def hashes(self) -> np.ndarray:
        """One 64-bit hash per word, from the word alone."""
        out = np.zeros(len(self), dtype=np.uint64)
        i = 0
        while i < len(self):
            base = self.start[i]
            j = max(i + 1, int(np.searchsorted(self.end, base + HASHED_BYTES, side="right")))
            if self.end[j - 1] - base <= HASHED_BYTES:
                power, inverse = powers(HASHED_BYTES + 1)
                part = self.bytes[base : self.end[j - 1]]
                sums = np.zeros(len(part) + 1, dtype=np.uint64)
                np.cumsum(_BYTE[part] * power[: len(part)], dtype=np.uint64, out=sums[1:])
                a, b = self.start[i:j] - base, self.end[i:j] - base
                out[i:j] = mix((sums[b] - sums[a]) * inverse[a])
            i = j
        for k in np.flatnonzero(self.end - self.start > LONG_WORD):
            out[k] = xxhash.xxh64_intdigest(self.bytes[self.start[k] : self.end[k]])
        return out


class WordHashes(dict):
    """word -> XXH64, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser on uint64, so that the order of the values says nothing of their sum."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64))
_powers = [np.ones(1, dtype=np.uint64)] * 2


def powers(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, n of each at least."""
    if n > len(_powers[0]):
        size = max(2 * len(_powers[0]), n)
        for i, base in enumerate((SpanHashes.BASE, pow(SpanHashes.BASE, -1, 1 << 64))):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _powers[i] = np.cumprod(steps, dtype=np.uint64)
    return _powers


class SpanHashes:
    """Hash of any span of a sequence of word hashes, from prefix sums modulo 2^64."""

    BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2^64

    def __init__(self, tokens: np.ndarray):
        n = len(tokens)
        self.power, self.inverse = powers(n + 1)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(tokens * self.power[:n], dtype=np.uint64, out=self.sums[1:])

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.inverse[start])

    def grams(self, k: int) -> np.ndarray:
        n = len(self.sums) - k
        return mix((self.sums[k:] - self.sums[:n]) * self.inverse[:n]) if n > 0 else np.zeros(0, dtype=np.uint64)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each window of ``width`` values, by doubling."""
    have, out = 1, values
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
