"""Benchmark decontamination by winnowing, in DataFrame functions only.

A window is WINDOW consecutive words.  Its fingerprint is the smallest hash among its grams of
GRAM words, so every shared window shares its fingerprint (Schleimer, Wilkerson and Aiken, 2003).
Fingerprints of documents are held against those of the benchmark, and a hit is extended from
the gram to the whole window by the hash of all its words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from surfaudit.llm.common import NO_ID, ascii_lower, materialize

WINDOW = 10
GRAM = 5
BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SIEVE_BITS = 32  # bits of the sieve per fingerprint of the benchmark ...
SIEVE_LONGS = 1 << 13  # ... up to so many longs in all; more fingerprints only let more through
BROADCAST_WINDOWS = 200_000  # benchmark windows up to which that side is broadcast (below 20 MB)


def word_hashes(text: Column) -> Column:
    """Hashes of the words of a text: digits, a-z after lower-casing, and all beyond ASCII."""
    words = F.split(ascii_lower(F.coalesce(text, F.lit(""))), BETWEEN_WORDS)
    return F.transform(F.array_remove(words, ""), lambda w: F.xxhash64(w))


def _over(values: str, width: int, join) -> Column:
    """``join`` of each value and the width - 1 after it; places beyond the end are null."""
    return F.transform(values, lambda x, i: join(x, *[F.get(F.col(values), i + d) for d in range(1, width)]))


def _fingerprints(df: DataFrame, lengths: list[int]) -> DataFrame:
    """Adds f<L>: the fingerprint of the window of L words at each place of ``h``, for each L."""
    df = df.withColumns({f"g{k}": _over("h", k, F.xxhash64) for k in sorted({min(GRAM, n) for n in lengths})})
    return df.withColumns({
        f"f{n}": _over(f"g{GRAM}", n - GRAM + 1, F.least) if n > GRAM else F.col(f"g{n}") for n in lengths
    })


def _windows(n: int, test=None) -> Column:
    """Windows of n words at every place, or where ``test`` of the fingerprint holds."""
    places = F.when(F.size("h") >= n, F.sequence(F.lit(0), F.size("h") - n)).otherwise(F.array().cast("array<int>"))
    if test is not None:
        places = F.filter(places, lambda i: test(F.get(F.col(f"f{n}"), i)))
    return F.transform(
        places,
        lambda i: F.struct(
            F.lit(n).alias("n"), i.alias("at"), F.get(F.col(f"f{n}"), i).alias("f"), F.xxhash64(F.slice("h", i + 1, n)).alias("whole")
        ),
    )


def benchmark_windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(n, f, whole, items): distinct windows with the sorted ids of the items that hold them.

    An item of fewer than WINDOW words is one window; one without words has none.  Ids are
    strings; a null id is the empty string.
    """
    items = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), word_hashes(F.col(text_col)).alias("h"))
    items = items.where(F.size("h") > 0)
    lengths = [r[0] for r in items.select(F.least(F.size("h"), F.lit(WINDOW)).alias("n")).distinct().collect()]  # WINDOW at most
    parts = None
    for n in sorted(lengths):
        some = _fingerprints(items.where(F.least(F.size("h"), F.lit(WINDOW)) == n), [n])
        some = some.select("item", F.inline(_windows(n))).select("n", "f", "whole", "item")
        parts = some if parts is None else parts.unionAll(some)
    if parts is None:
        return items.sparkSession.createDataFrame([], "n int, f bigint, whole bigint, items array<string>")
    return parts.groupBy("n", "f", "whole").agg(F.sort_array(F.collect_set("item")).alias("items"))


def _sieve(windows: DataFrame):
    """A test of fingerprints that all of the benchmark pass: a bit table of bounded size."""
    count = windows.count()
    longs = 1
    while 64 * longs < SIEVE_BITS * count and longs < SIEVE_LONGS:
        longs *= 2
    place = F.col("f").bitwiseAND(F.lit(longs - 1))
    bit = F.shiftright("f", 40).bitwiseAND(F.lit(63)).cast("int")
    held = windows.groupBy(place.alias("i")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), bit)).alias("b"))
    bits = [0] * longs
    for i, b in held.collect():  # SIEVE_LONGS at most
        bits[i] = b
    table = F.array(*[F.lit(b).cast("bigint") for b in bits])

    def test(f: Column) -> Column:
        at = F.get(table, f.bitwiseAND(F.lit(longs - 1)).cast("int"))
        shift = F.shiftright(f, 40).bitwiseAND(F.lit(63)).cast("int")
        return F.call_function("shiftright", at, shift).bitwiseAND(F.lit(1).cast("bigint")) == 1

    return test, count


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """(doc, mark, copies, n_words, n_hit, items): one row per distinct document (id and text).

    A word is hit if it lies in an occurrence of a benchmark window; ``items`` are the ids of the
    items with occurring windows, sorted as strings.  ``doc`` is the id (NO_ID for a null one),
    ``mark`` a hash of the text and ``copies`` the number of equal rows.  A null text has no words.
    """
    windows = materialize(benchmark_windows(benchmark, item_col, item_text_col).withColumn("set", F.xxhash64("items")))
    test, count = _sieve(windows)
    lengths = sorted(r[0] for r in windows.select("n").distinct().collect())  # WINDOW at most
    sets = windows.select("set", "items").distinct()
    spots = windows.select("n", "f", "whole", "set")
    if count <= BROADCAST_WINDOWS:
        spots = F.broadcast(spots)

    text = F.col(text_col)
    rows = docs.select(
        F.coalesce(F.col(id_col).cast("bigint"), F.lit(NO_ID)).alias("doc"), F.xxhash64(text).alias("mark"), word_hashes(text).alias("h")
    )
    rows = _fingerprints(rows, lengths)
    # One row more per document carries its word count; its key is its own, so that it spreads.
    own = F.struct(F.lit(0).alias("n"), F.lit(-1).alias("at"), F.lit(0).cast("bigint").alias("f"), F.xxhash64("doc", "mark").alias("whole"))
    found = rows.select("doc", "mark", F.size("h").alias("n_words"), F.inline(F.concat(F.array(own), *[_windows(n, test) for n in lengths])))
    hits = found.join(spots, ["n", "f", "whole"], "left").where((F.col("at") < 0) | F.col("set").isNotNull())
    span = F.when(F.col("at") >= 0, F.struct("at", "n"))
    by_doc = hits.groupBy("doc", "mark").agg(
        F.max("n_words").cast("bigint").alias("n_words"), F.count_if(F.col("at") < 0).alias("copies"),
        F.sort_array(F.collect_set(span)).alias("spans"), F.collect_set("set").alias("sets"),
    )
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("bigint").alias("total"))
    covered = F.aggregate(
        "spans", zero,
        lambda acc, s: F.struct(
            F.greatest(acc["end"], s["at"] + s["n"]).alias("end"),
            (acc["total"] + F.greatest(F.lit(0), s["at"] + s["n"] - F.greatest(s["at"], acc["end"]))).alias("total"),
        ),
        lambda acc: acc["total"],
    )
    by_doc = by_doc.select("doc", "mark", "copies", "n_words", covered.alias("n_hit"), F.explode_outer("sets").alias("set"))
    return by_doc.join(sets, "set", "left").groupBy("doc", "mark").agg(
        F.max("copies").alias("copies"), F.max("n_words").alias("n_words"), F.max("n_hit").alias("n_hit"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )


def contamination_report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document row: doc_id, n_words, n_hit, items, contaminated."""
    found = find_contamination(docs, benchmark)
    each = found.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))))
    return each.select(
        F.when(F.col("doc") != NO_ID, F.col("doc")).alias("doc_id"), "n_words", "n_hit", "items", (F.col("n_hit") > 0).alias("contaminated")
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows that hold a benchmark window; all columns stay as they are."""
    bad = find_contamination(docs, benchmark).where("n_hit > 0").select(F.col("doc").alias("_doc"), F.col("mark").alias("_mark"))
    whole = docs.select(
        F.struct(*docs.columns).alias("row"), F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("_doc"),
        F.xxhash64("text").alias("_mark"),
    )
    return whole.join(bad, ["_doc", "_mark"], "left_anti").select("row.*")
