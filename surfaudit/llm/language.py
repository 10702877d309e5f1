"""Language identification by compression with one raw-content dictionary per language."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
import zstandard
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from surfaudit.llm.common import slices

UNKNOWN = "und"
DICTIONARY_BYTES = 1 << 17  # of text per language: the bound of the labelled sample ...
ALL_BYTES = 1 << 25  # ... and of all languages together; more labels mean shorter dictionaries
PIECE_CHARS = 1024  # taken from one labelled text, at a place its hash chooses
SPARE = 3  # candidates drawn for each piece wanted
LEVEL = 9
BLOCK_BYTES = 2048  # a text is packed block by block, each against the dictionary alone
SLICE = 1 << 20  # bytes of text that a filtering task holds outside its batch
MIN_MARGIN = 0.01  # share of the second smallest size by which the smallest has to be smaller ...
MARGIN_BYTES = 64  # ... for texts of so many bytes of letters; shorter ones cannot show a margin
LETTERS = regex.compile(r"\p{L}+")


@dataclass(frozen=True)
class Dictionaries:
    """Text per language, the most frequent label first, which also wins ties."""

    text: dict[str, bytes]


def letters_of(text: str | None) -> bytes:
    """Lower-cased words of letters, one space between them."""
    return " ".join(LETTERS.findall(text.lower())).encode() if text else b""


def learn_dictionaries(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Dictionaries:
    """Dictionaries from a sample of labelled texts, chosen by hash, copies counted once.

    Rows without text or label teach nothing; without any row left there is no language.
    """
    text = F.col(text_col)
    mark = F.xxhash64(text)
    begin = (F.lit(1) + F.pmod(mark, F.greatest(F.length(text) - PIECE_CHARS, F.lit(0)) + 1)).cast("int")
    rows = labelled.where(text.isNotNull() & F.col(lang_col).isNotNull()).select(
        F.col(lang_col).alias("lang"), mark.alias("mark"), F.substring(text, begin, F.lit(PIECE_CHARS)).alias("piece")
    )
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("mark").alias("texts")).collect()
    counts = sorted(counts, key=lambda r: (-r["n"], r["lang"]))  # one row per label
    if not counts:
        return Dictionaries({})
    size = min(DICTIONARY_BYTES, ALL_BYTES // len(counts))
    wanted = max(1, size // PIECE_CHARS + 1)
    share = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], min(1.0, SPARE * wanted / max(1, r["texts"])))])
    drawn = rows.where(F.pmod(F.xxhash64("mark"), F.lit(1 << 30)) < F.element_at(share, F.col("lang")) * (1 << 30))
    pieces = drawn.groupBy("lang", "mark").agg(F.first("piece").alias("piece"))
    order = W.partitionBy("lang").orderBy("mark")
    pieces = pieces.withColumn("i", F.row_number().over(order)).where(F.col("i") <= SPARE * wanted)
    text_of: dict[str, list[bytes]] = {r["lang"]: [] for r in counts}
    for r in sorted(pieces.collect(), key=lambda r: (r["lang"], r["i"])):  # SPARE * ALL_BYTES at most
        if sum(map(len, text_of[r["lang"]])) < size:
            text_of[r["lang"]].append(letters_of(r["piece"]) + b" ")
    return Dictionaries({lang: b"".join(parts)[:size] for lang, parts in text_of.items()})


class Packer:
    """Packed sizes of a text under each dictionary."""

    def __init__(self, dictionaries: Dictionaries):
        self.languages = list(dictionaries.text)
        self.packers = []
        for text in dictionaries.text.values():
            settings = zstandard.ZstdCompressionParameters.from_level(
                LEVEL, source_size=BLOCK_BYTES, dict_size=len(text), write_content_size=False, write_dict_id=False, write_checksum=False
            )
            if len(text) < 8:  # nothing to look back on
                self.packers.append(zstandard.ZstdCompressor(compression_params=settings))
                continue
            held = zstandard.ZstdCompressionDict(text, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            held.precompute_compress(compression_params=settings)
            self.packers.append(zstandard.ZstdCompressor(dict_data=held, compression_params=settings))

    def sizes(self, letters: bytes) -> list[int]:
        total = [0] * len(self.packers)
        for i in range(0, len(letters), BLOCK_BYTES):
            block = letters[i : i + BLOCK_BYTES]
            for k, p in enumerate(self.packers):
                total[k] += len(p.compress(block))
        return total

    def judge(self, text: str | None) -> tuple[str, float, float, bool]:
        letters = letters_of(text)
        if not letters or not self.packers:
            return UNKNOWN, 0.0, 0.0, False
        sizes = self.sizes(letters)
        best = min(sizes)
        first = sizes.index(best)
        second = min((s for k, s in enumerate(sizes) if k != first), default=None)
        margin = 1.0 if second is None else (second - best) / second
        score = 1.0 / sum(2.0 ** min(0, best - s) for s in sizes)
        return self.languages[first], score, margin, len(letters) < MARGIN_BYTES or margin >= MIN_MARGIN


_latest: list[tuple[Dictionaries, Packer]] = []


def _packer(dictionaries: Dictionaries) -> Packer:
    """The packer of these dictionaries, made once per process."""
    if not _latest or _latest[0][0] != dictionaries:
        _latest[:] = [(dictionaries, Packer(dictionaries))]
    return _latest[0][1]


def language_of(text: Column | str, dictionaries: Dictionaries) -> Column:
    """struct(lang_pred, score, margin, accepted) of a text.

    The language whose dictionary packs the text smallest; ties go to the more frequent label.
    ``score`` falls from 1 by what each other language would need in bytes more.  ``accepted`` is
    false for ``und`` (null, no letter, or nothing learned) and where the margin is narrow.
    """

    @F.pandas_udf("lang_pred string, score double, margin double, accepted boolean")
    def run(texts: pd.Series) -> pd.DataFrame:
        packer = _packer(dictionaries)
        return pd.DataFrame([packer.judge(t) for t in texts], columns=["lang_pred", "score", "margin", "accepted"])

    return run(text)


def held_out(id_col: str = "doc_id") -> Column:
    """Rows whose label is kept for measuring: crc32 of the id as text, modulo 3, is 1."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 3 == 1


def identify_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, held_out, lang_pred, score, margin, accepted) per row, learned from rows not held out.

    Rows that repeat a doc_id are judged one by one, each on its whole text however long; a null
    doc_id is not held out.  Only the three columns named are read, so others may have any name.
    An empty table gives no row, one without a label gives ``und`` throughout.
    """
    learned = learn_dictionaries(docs.where(~held_out(id_col)), text_col, lang_col)
    found = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), language_of(F.col(text_col), learned).alias("p"))
    return found.select("doc_id", "held_out", "p.*")


def keep_identified(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose language is accepted, with all columns as they are.

    Rows without text, with an empty one or without a letter go; rows that repeat a doc_id are
    judged one by one, and texts whole.  Rows go through a task a few at a time.
    """
    learned = learn_dictionaries(docs.where(~held_out()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(learned)
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_pylist()
            for part in slices(sizes, SLICE):
                rows = batch.slice(part.start, part.stop - part.start)
                yield rows.filter(pa.array([packer.judge(t)[3] for t in rows.column("text").to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
