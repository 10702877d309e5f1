"""The supplied tables seen as pixels, grids, volumes, boxes and ledgers.

Each binding exists twice: as a DataFrame, and as the SQL text of a common table
expression so that the twin of a query starts from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

WIDTH = 125  # raster width; the key of an order or line is its linear pixel index

VIEW_GROUPS = {1: "a", 2: "a", 3: "b", 4: "b", 5: "c", 6: "c", 7: "c"}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _yx(key: str):
    return (
        F.floor(F.col(key) / WIDTH).cast("int").alias("y"),
        F.pmod(F.col(key), F.lit(WIDTH)).cast("int").alias("x"),
    )


def _yx_sql(key: str) -> str:
    return (
        f"cast(floor({key} / cast({WIDTH} AS DOUBLE)) AS INTEGER) AS y, "
        f"cast({key} % {WIDTH} AS INTEGER) AS x"
    )


# -- pixels ---------------------------------------------------------------------------


def raw_pixels(spark: SparkSession, sf: str) -> DataFrame:
    """Every line as a pixel reading: y, x, view_id, score in [0, 1] (may repeat per view)."""
    return table(spark, sf, "lineitem").select(
        *_yx("l_orderkey"),
        F.col("l_linenumber").alias("view_id"),
        (F.col("l_discount") * 10).alias("score"),
    )


def cells(spark: SparkSession, sf: str) -> DataFrame:
    """pixels(y, x, view_id, grp, score): one row per pixel and view."""
    groups = F.create_map(*[F.lit(v) for pair in VIEW_GROUPS.items() for v in pair])
    return (
        raw_pixels(spark, sf)
        .groupBy("y", "x", "view_id")
        .agg(F.max("score").alias("score"))
        .withColumn("grp", groups[F.col("view_id")])
    )


CELLS = f"""cells AS (
  SELECT {_yx_sql('l_orderkey')}, l_linenumber AS view_id,
         CASE WHEN l_linenumber <= 2 THEN 'a' WHEN l_linenumber <= 4 THEN 'b' ELSE 'c' END AS grp,
         max(l_discount * 10) AS score
  FROM lineitem GROUP BY l_orderkey, l_linenumber)"""


def two_views(spark: SparkSession, sf: str) -> DataFrame:
    """Pixels carrying both view 1 and view 2: y, x, a, b (one aggregate, no self-join)."""
    return (
        raw_pixels(spark, sf)
        .where(F.col("view_id") <= 2)
        .groupBy("y", "x")
        .agg(
            F.max(F.when(F.col("view_id") == 1, F.col("score"))).alias("a"),
            F.max(F.when(F.col("view_id") == 2, F.col("score"))).alias("b"),
        )
        .where(F.col("a").isNotNull() & F.col("b").isNotNull())
    )


TWO_VIEWS = f"""two AS (
  SELECT a.y, a.x, a.score AS a, b.score AS b
  FROM cells a JOIN cells b ON a.y = b.y AND a.x = b.x
  WHERE a.view_id = 1 AND b.view_id = 2)"""


def truth(spark: SparkSession, sf: str) -> DataFrame:
    """Labels: y, x, cy, cx (32-pixel chunk), positive, valid, area_um2."""
    return (
        table(spark, sf, "orders")
        .select(
            *_yx("o_orderkey"),
            (F.col("o_orderstatus") == "F").alias("positive"),
            (F.col("o_orderpriority") != "5-LOW").alias("valid"),
            F.col("o_totalprice").alias("area_um2"),
        )
        .withColumn("cy", F.floor(F.col("y") / 32).cast("int"))
        .withColumn("cx", F.floor(F.col("x") / 32).cast("int"))
    )


TRUTH = f"""truth AS (
  SELECT *, cast(floor(y / cast(32 AS DOUBLE)) AS INTEGER) AS cy,
         cast(floor(x / cast(32 AS DOUBLE)) AS INTEGER) AS cx
  FROM (SELECT {_yx_sql('o_orderkey')}, o_orderstatus = 'F' AS positive,
               o_orderpriority <> '5-LOW' AS valid, o_totalprice AS area_um2 FROM orders))"""


def canvas(spark: SparkSession, sf: str) -> tuple[int, int]:
    """Height and width of the raster."""
    return truth(spark, sf).agg(F.max("y") + 1).first()[0], WIDTH


def scored(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled pixels with two model scores: truth columns plus s0, s1."""
    both = two_views(spark, sf).select("y", "x", F.col("a").alias("s0"), F.col("b").alias("s1"))
    return truth(spark, sf).where("valid").join(both, ["y", "x"])


SCORED = """scored AS (
  SELECT t.*, p.a AS s0, p.b AS s1
  FROM truth t JOIN two p ON t.y = p.y AND t.x = p.x WHERE t.valid)"""

SCORED_ALL = f"{CELLS},\n{TWO_VIEWS},\n{TRUTH},\n{SCORED}"


def mask_readings(spark: SparkSession, sf: str) -> DataFrame:
    """Readings of a sparse pixel set, which may repeat: y, x."""
    return table(spark, sf, "lineitem").where(F.col("l_discount") >= F.lit(0.09)).select(*_yx("l_orderkey"))


def mask(spark: SparkSession, sf: str) -> DataFrame:
    """A sparse pixel set: y, x."""
    return mask_readings(spark, sf).distinct()


MASK = f"""mask AS (
  SELECT DISTINCT {_yx_sql('l_orderkey')} FROM lineitem WHERE l_discount >= cast(0.09 AS DOUBLE))"""


def surfaces(spark: SparkSession, sf: str) -> DataFrame:
    """Three surfaces and one without a name, whose coordinates overlap: surface, y, x, a, b."""
    return table(spark, sf, "lineitem").where(F.col("l_discount") >= F.lit(0.05)).groupBy(
        F.when(F.col("l_linenumber") <= 3, F.col("l_linenumber")).alias("surface"), *_yx("l_orderkey")
    ).agg(F.max("l_quantity").alias("a"), F.max("l_tax").alias("b"))


SURFACES = f"""surfaces AS (
  SELECT CASE WHEN l_linenumber <= 3 THEN l_linenumber END AS surface, {_yx_sql('l_orderkey')}, max(l_quantity) AS a, max(l_tax) AS b
  FROM lineitem WHERE l_discount >= cast(0.05 AS DOUBLE) GROUP BY 1, 2, 3)"""


# -- volumes and profiles ---------------------------------------------------------------


def voxels(spark: SparkSession, sf: str) -> DataFrame:
    """A seven-layer depth stack: z, y, x, v (uint8-like); absent voxels are not stored."""
    return (
        table(spark, sf, "lineitem")
        .groupBy("l_orderkey", "l_linenumber")
        .agg(F.max("l_quantity").alias("v"))
        .select(
            (F.col("l_linenumber") - 1).alias("z"), *_yx("l_orderkey"), F.col("v").cast("int").alias("v")
        )
    )


VOXELS = f"""voxels AS (
  SELECT l_linenumber - 1 AS z, {_yx_sql('l_orderkey')},
         cast(max(l_quantity) AS INTEGER) AS v
  FROM lineitem GROUP BY l_orderkey, l_linenumber)"""


def profiles(spark: SparkSession, sf: str) -> DataFrame:
    """Depth profiles: pixel, layers ARRAY<FLOAT>, positive."""
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("pixel"), F.col("embedding").alias("layers"), (F.col("label") == 0).alias("positive")
    )


PROFILES = """profiles AS (
  SELECT vec_id AS pixel, embedding AS layers, label = 0 AS positive FROM embeddings)"""


# -- grid -----------------------------------------------------------------------------


def grid(spark: SparkSession, sf: str) -> DataFrame:
    """A vertex grid with whole and partial sentinels: v, u, x, y, z."""
    o = table(spark, sf, "orders")
    gone = F.col("o_custkey") % 97 == 0
    partial = F.col("o_custkey") % 89 == 0
    y, x = _yx("o_orderkey")
    base = o.select(y.alias("v"), x.alias("u"), "o_custkey")
    minus = F.lit(-1.0)
    return base.select(
        "v",
        "u",
        F.when(gone | partial, minus).otherwise(F.col("u") * 20 + (F.col("o_custkey") % 7) * F.lit(0.5)).alias("x"),
        F.when(gone, minus).otherwise(F.col("v") * 20 + (F.col("o_custkey") % 5) * F.lit(0.5)).alias("y"),
        F.when(gone, minus).otherwise(F.lit(100.0) + (F.col("o_custkey") % 11) * F.lit(0.25)).alias("z"),
    )


GRID = f"""grid AS (
  SELECT v, u,
    CASE WHEN c % 97 = 0 OR c % 89 = 0 THEN cast(-1 AS DOUBLE) ELSE u * 20 + (c % 7) * cast(0.5 AS DOUBLE) END AS x,
    CASE WHEN c % 97 = 0 THEN cast(-1 AS DOUBLE) ELSE v * 20 + (c % 5) * cast(0.5 AS DOUBLE) END AS y,
    CASE WHEN c % 97 = 0 THEN cast(-1 AS DOUBLE) ELSE 100 + (c % 11) * cast(0.25 AS DOUBLE) END AS z
  FROM (SELECT cast(floor(o_orderkey / cast({WIDTH} AS DOUBLE)) AS INTEGER) AS v,
               cast(o_orderkey % {WIDTH} AS INTEGER) AS u, o_custkey AS c FROM orders))"""

STRICT = "(x <> -1 AND y <> -1 AND z <> -1 AND z > 0)"
NOT_ALL = "(NOT (x = -1 AND y = -1 AND z = -1) AND z > 0)"


# -- boxes, points, ledgers -------------------------------------------------------------


def boxes(spark: SparkSession, sf: str) -> DataFrame:
    """Half-open rectangles: box_id, y0, y1, x0, x1."""
    k = F.col("p_partkey")
    return (
        table(spark, sf, "part")
        .select(
            k.alias("box_id"), (k * 7 % 100).alias("y0"), (k * 13 % 100).alias("x0"), "p_size"
        )
        .select(
            "box_id",
            "y0",
            (F.col("y0") + 1 + F.col("p_size")).alias("y1"),
            "x0",
            (F.col("x0") + 1 + F.col("p_size") % 17).alias("x1"),
        )
    )


BOXES = """boxes AS (
  SELECT p_partkey AS box_id, p_partkey * 7 % 100 AS y0, p_partkey * 7 % 100 + 1 + p_size AS y1,
         p_partkey * 13 % 100 AS x0, p_partkey * 13 % 100 + 1 + p_size % 17 AS x1
  FROM part)"""


def points3(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        F.col("l_partkey").cast("double").alias("z"),
        F.col("l_suppkey").cast("double").alias("y"),
        F.col("l_quantity").alias("x"),
    )


POINTS3 = """points3 AS (
  SELECT cast(l_partkey AS DOUBLE) AS z, cast(l_suppkey AS DOUBLE) AS y, l_quantity AS x FROM lineitem)"""


def manifest(spark: SparkSession, sf: str) -> DataFrame:
    """File listing: path, bytes, sha, regime, role, surface."""
    i = F.col("doc_id") % 3
    return table(spark, sf, "documents").select(
        "doc_id",
        F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"),
        F.col("source").alias("surface"),
        F.col("n_chars").cast("bigint").alias("bytes"),
        F.sha2("text", 256).alias("sha"),
        F.when(i == 0, "DEV").when(i == 1, "VALIDATION").otherwise("DISCOVERY").alias("regime"),
        F.col("lang").alias("role"),
        "text",
    )


MANIFEST = """manifest AS (
  SELECT doc_id, source || '/' || cast(doc_id AS VARCHAR) AS path, source AS surface,
         cast(n_chars AS BIGINT) AS bytes, sha256(text) AS sha,
         CASE doc_id % 3 WHEN 0 THEN 'DEV' WHEN 1 THEN 'VALIDATION' ELSE 'DISCOVERY' END AS regime,
         lang AS role, text
  FROM documents)"""


def views(spark: SparkSession, sf: str) -> DataFrame:
    """Declared views: ord, view_id, grp, acquisition, family."""
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_regionkey")
    return table(spark, sf, "supplier").join(n, "s_nationkey").select(
        F.col("s_suppkey").alias("ord"),
        F.col("s_suppkey").cast("string").alias("view_id"),
        F.concat(F.lit("g"), F.col("s_nationkey").cast("string")).alias("grp"),
        F.col("n_regionkey").cast("string").alias("acquisition"),
        (F.col("s_suppkey") % 3).cast("string").alias("family"),
        F.col("s_acctbal").alias("score"),
    )


VIEWS = """views AS (
  SELECT s_suppkey AS ord, cast(s_suppkey AS VARCHAR) AS view_id, 'g' || cast(s_nationkey AS VARCHAR) AS grp,
         cast(n_regionkey AS VARCHAR) AS acquisition, cast(s_suppkey % 3 AS VARCHAR) AS family,
         s_acctbal AS score
  FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""


def reviews(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        "event_id",
        F.col("user_id").alias("candidate_id"),
        F.col("event_type").alias("response"),
        F.col("value").alias("seconds"),
        (F.col("event_id") % 5 + 1).alias("confidence"),
    )


REVIEWS = """reviews AS (
  SELECT event_id, user_id AS candidate_id, event_type AS response, value AS seconds,
         event_id % 5 + 1 AS confidence FROM events)"""
