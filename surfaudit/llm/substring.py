"""Exact substring dedup on a compacted De Bruijn graph of the corpus.

Edges are windows of WINDOW words.  Of the GRAM-word grams inside a window the one with the
smallest hash (the leftmost of equals) is its anchor, so equal windows have equal anchors at
equal places.  Consecutive windows with the same anchor are a path of the graph, and the paths
through an anchor are compared whole:

* an anchor met once cannot lie in a repeated window and leaves after one count;
* an anchor whose occurrences all carry the same path does not branch: the first occurrence
  stays and all windows of the others repeat, without looking at any single window;
* where different paths share an anchor the graph branches.  Each distinct path is opened into
  its windows once, at its first occurrence, and these few windows are joined one by one.

Paths carry their source coordinates (document, text hash, start), which decide what came first
and which words are covered.  What the 64-bit hashes of anchor and path (or window) call equal is
verified on the words at both coordinates: the source's words are digested when its text is read
again, and a window goes only if its own words give the same digest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from surfaudit.llm.common import NO_ID, SpanHashes, Words, materialize, mix, signed, slices, sliding_min, text_bytes

WINDOW = 20
GRAM = 6
PATH_BITS = 4  # a path has at most WINDOW - GRAM + 1 windows, less one in these bits
SLICE = 1 << 20  # bytes of text whose words are handled at once


def _anchored_paths(words: Words, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """(text, anchor hash, path hash, first window, windows - 1) of each path of the texts."""
    n = len(words)
    if n < window:
        return (np.zeros(0, dtype=np.int64),) * 5
    spans = SpanHashes(words.hashes())
    grams = spans.grams(gram)
    # High half: hash; low half: place.  The minimum is the leftmost of the smallest.
    ranked = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    at = (sliding_min(ranked, window - gram + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    inside = np.flatnonzero(words.text[: n - window + 1] == words.text[window - 1 :])  # windows of one text
    at = at[inside]
    fresh = np.ones(len(inside), dtype=bool)
    fresh[1:] = (at[1:] != at[:-1]) | (inside[1:] != inside[:-1] + 1)
    head = np.flatnonzero(fresh)
    more = np.diff(np.append(head, len(inside))) - 1
    start, place = inside[head], at[head]
    path = spans.spans(start, start + more + window)
    path = mix(path ^ ((place - start).astype(np.uint64) << np.uint64(32)) ^ more.astype(np.uint64))
    text = words.text[start]
    return text, grams[place], path, start - words.first[text], more


def _digests(words: Words, start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """64-bit digest of the words themselves of each span, joined by one space."""
    joined, place = words.spaced()
    stop = np.append(place, len(joined))[start + count]
    view, digest = memoryview(joined), xxhash.xxh3_64_intdigest
    found = [digest(view[a:b]) for a, b in zip(place[start].tolist(), stop.tolist())]
    return np.array(found, dtype=np.uint64).view(np.int64)


def _keys(id_col: str, text_col: str) -> list[Column]:
    """(doc, mark): rows that share an id are told apart by a hash of their text."""
    return [F.coalesce(F.col(id_col).cast("bigint"), F.lit(NO_ID)).alias("doc"), F.xxhash64(text_col).alias("mark")]


def _parts(batch: pa.RecordBatch) -> Iterator[tuple[slice, Words]]:
    """Words of a batch, a few texts at a time."""
    sizes = np.diff(np.append(0, np.cumsum([x or 0 for x in batch.column("size").to_pylist()])))
    for part in slices(sizes.tolist(), SLICE):
        yield part, Words(list(text_bytes(batch.slice(part.start, part.stop - part.start))))


def _batch(columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns.values()], list(columns))


def _paths(rows: DataFrame, window: int, gram: int) -> DataFrame:
    """(anchor, path, doc, mark, at): ``at`` packs the first window and the number of windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, marks = (batch.column(c).to_numpy() for c in ("doc", "mark"))
            for part, words in _parts(batch):
                text, anchor, path, start, more = _anchored_paths(words, window, gram)
                if len(text):
                    own = part.start + text
                    yield _batch({"anchor": signed(anchor), "path": signed(path), "doc": docs[own], "mark": marks[own], "at": start << PATH_BITS | more})

    return rows.mapInArrow(run, "anchor bigint, path bigint, doc bigint, mark bigint, at bigint")


def _opened(rows: DataFrame, window: int) -> DataFrame:
    """(whole, anchor, edge, doc, mark, at, digest) of the paths listed in ``paths`` of each row.

    A repeated path gives one row for itself (``whole``), with ``edge`` its own hash; a branching
    one gives a row for every window.  ``digest`` is taken from the words at these coordinates.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, marks, lists = (batch.column(c) for c in ("doc", "mark", "paths"))
            docs, marks = docs.to_numpy(), marks.to_numpy()
            for part, words in _parts(batch):
                mine = lists.slice(part.start, part.stop - part.start)
                held = mine.flatten()
                if not len(held):
                    continue
                anchor, path, at, opens, repeats = (held.field(k).to_numpy(zero_copy_only=False) for k in range(5))
                text = np.repeat(np.arange(len(mine)), mine.value_lengths().to_numpy())
                start, count = words.first[text] + (at >> PATH_BITS), (at & (1 << PATH_BITS) - 1) + 1
                own = np.flatnonzero(repeats)
                if len(own):
                    digest = _digests(words, start[own], count[own] + window - 1)
                    yield _batch({
                        "whole": np.ones(len(own), dtype=bool), "anchor": anchor[own], "edge": path[own],
                        "doc": docs[part.start + text[own]], "mark": marks[part.start + text[own]], "at": at[own], "digest": digest,
                    })
                own = np.flatnonzero(opens)
                if len(own):
                    edges = SpanHashes(words.hashes()).grams(window)
                    own = np.repeat(own, count[own])
                    step = np.arange(len(own)) - np.searchsorted(own, own)
                    first = start[own] + step
                    yield _batch({
                        "whole": np.zeros(len(own), dtype=bool), "anchor": anchor[own], "edge": signed(edges[first]),
                        "doc": docs[part.start + text[own]], "mark": marks[part.start + text[own]],
                        "at": (at[own] >> PATH_BITS) + step << PATH_BITS, "digest": _digests(words, first, np.full(len(own), window)),
                    })

    return rows.mapInArrow(run, "whole boolean, anchor bigint, edge bigint, doc bigint, mark bigint, at bigint, digest bigint")


PLACE = ("doc", "mark", "at")


def _firsts(df: DataFrame, *by: str) -> DataFrame:
    """The first occurrence (doc0, mark0, at0) of each key, and the number of rows, n."""
    out = df.groupBy(*by).agg(F.min(F.struct(*PLACE)).alias("f"), F.count(F.lit(1)).alias("n"))
    return out.select(*by, *[F.col(f"f.{c}").alias(f"{c}0") for c in PLACE], "n")


def _later() -> Column:
    return (F.col("doc") != F.col("doc0")) | (F.col("mark") != F.col("mark0")) | (F.col("at") != F.col("at0"))


def repeated_windows(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, mark, runs): windows that start earlier elsewhere, as structs (at, digest).

    ``at`` packs the first window and the number of windows less one.  ``digest`` is that of the
    words at the source, null where the two have been compared already.
    """
    text = F.col(text_col)
    rows = docs.select(*_keys(id_col, text_col), F.octet_length(text).alias("size"), text.alias("text"))
    paths = _paths(rows, window, gram)
    # Counts are written before they are joined: then adaptive execution can split a hot anchor.
    met = materialize(paths.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor"))
    shared = materialize(paths.join(met, "anchor"))

    first = materialize(_firsts(shared, "anchor", "path"))
    branching = first.groupBy("anchor").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("anchor", F.lit(True).alias("opens"))
    listed = first.join(branching, "anchor", "left").withColumn("opens", F.coalesce("opens", F.lit(False))).where("opens or n > 1")
    asked = listed.groupBy(F.col("doc0").alias("doc"), F.col("mark0").alias("mark")).agg(
        F.collect_list(F.struct("anchor", "path", F.col("at0").alias("at"), "opens", (F.col("n") > 1).alias("repeats"))).alias("paths")
    )
    once = rows.join(asked, ["doc", "mark"])
    opened = materialize(_opened(once, window))
    sources = opened.where("whole").select("anchor", F.col("edge").alias("path"), F.col("digest").alias("digest0")).dropDuplicates(["anchor", "path"])
    sources = materialize(sources.join(first.drop("n"), ["anchor", "path"]))
    again = shared.join(sources, ["anchor", "path"]).where(_later()).select(*PLACE, F.col("digest0").alias("digest"))

    edges = opened.where("not whole")
    known = edges.groupBy("anchor", "edge").agg(F.min(F.struct(*PLACE, "digest")).alias("f"), F.count(F.lit(1)).alias("n")).where("n > 1")
    known = materialize(known.select("anchor", "edge", *[F.col(f"f.{c}").alias(f"{c}0") for c in (*PLACE, "digest")]))
    later = edges.join(known, ["anchor", "edge"]).where(_later() & (F.col("digest") == F.col("digest0")))
    later = later.select(*PLACE, F.lit(None).cast("bigint").alias("digest"))
    # Copies of one row say the same: a set, so that they are one before and after the shuffle.
    return again.unionAll(later).groupBy("doc", "mark").agg(F.collect_set(F.struct("at", "digest")).alias("runs"))


def _gone(words: Words, runs: pa.ListArray, window: int) -> np.ndarray:
    """True for each word inside a window of ``runs`` whose words are those of the source."""
    step = np.zeros(len(words) + 1, dtype=np.int64)
    held = runs.flatten()
    if len(held):
        size = runs.value_lengths().fill_null(0).to_numpy()
        at = held.field(0).to_numpy()
        start = words.first[np.repeat(np.arange(len(runs)), size)] + (at >> PATH_BITS)
        count = (at & (1 << PATH_BITS) - 1) + window
        asked = np.flatnonzero(held.field(1).is_valid().to_numpy(zero_copy_only=False))
        wanted = held.field(1).take(pa.array(asked)).to_numpy()
        good = np.ones(len(at), dtype=bool)
        good[asked] = _digests(words, start[asked], count[asked]) == wanted
        np.add.at(step, start[good], 1)
        np.add.at(step, (start + count)[good], -1)
    return np.cumsum(step[:-1]) > 0


def cut_spans(docs: DataFrame, carried: list[str], window: int, gram: int, id_col: str, text_col: str) -> DataFrame:
    """(row, n_words, n_removed, kept) per row of ``docs``; ``row`` holds the columns ``carried``."""
    if not 0 < window - gram < 1 << PATH_BITS:
        raise ValueError("window - gram must lie between 1 and 15")
    runs = repeated_windows(docs, window, gram, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, found = batch.column("row"), batch.column("runs")
            for part, words in _parts(batch):
                n = part.stop - part.start
                gone = _gone(words, found.slice(part.start, n), window)
                joined, _ = words.spaced()
                size = (words.end - words.start + 1) * ~gone
                kept = joined[np.repeat(~gone, words.end - words.start + 1)]
                total = np.append(0, np.cumsum(size))[words.first]
                out = kept.tobytes()
                texts = [out[a : max(a, b - 1)] for a, b in zip(total[:-1].tolist(), total[1:].tolist())]
                lost = np.append(0, np.cumsum(gone))[words.first]
                columns = [row.slice(part.start, n), pa.array(np.diff(words.first)), pa.array(np.diff(lost)), pa.array(texts, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["row", "n_words", "n_removed", "kept"])

    whole = docs.select(F.struct(*carried).alias("row"), *_keys(id_col, text_col), F.octet_length(text_col).alias("size"), F.col(text_col).alias("text"))
    row = whole.schema["row"].dataType.simpleString()
    met = whole.join(runs, ["doc", "mark"], "left").select("row", "size", "text", "runs")
    return met.mapInArrow(run, f"row {row}, n_words bigint, n_removed bigint, kept string")


def dedup_substrings(
    docs: DataFrame, window: int = WINDOW, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``docs`` plus ``n_words``, ``n_removed`` and ``kept`` (words joined by one space).

    Words are runs of anything but ASCII white space; a null text has none.  A word goes if a
    window over it has a word sequence that also starts earlier: in a smaller doc_id, or earlier
    in the same document.  Windows are judged on the input.  A null doc_id sorts first.  Rows
    that share a doc_id are ordered by a hash of their text; equal rows share their coordinates,
    so they remove nothing from each other.  A column of ``docs`` named like a result gives way.
    """
    added = ("n_words", "n_removed", "kept")
    cut = cut_spans(docs, docs.columns, window, gram, id_col, text_col)
    return cut.select(*[F.col("row")[c].alias(c) for c in docs.columns if c not in added], *added)


def drop_repeated_spans(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """``docs`` with the repeated spans cut out of ``text`` and ``n_chars`` set anew.

    A text that loses nothing stays as it is, white space included; one that loses every word
    goes with its row.  All other columns stay.
    """
    cut = cut_spans(docs, docs.columns, window, gram, "doc_id", "text").where((F.col("n_words") == 0) | (F.col("n_removed") < F.col("n_words")))
    changed = F.col("n_removed") > 0
    new = {"text": F.when(changed, F.col("kept")).otherwise(F.col("row")["text"])}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(changed, F.length("kept").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row")["n_chars"])
    return cut.select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])
