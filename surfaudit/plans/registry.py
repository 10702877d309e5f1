"""Query registry: one Spark callable, one output schema, one SQL twin per operator."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    name: str
    run: Query
    sql: str | None


ENTRIES: dict[str, Entry] = {}


def _fields(spec: str) -> list[tuple[str, str]]:
    return [tuple(part.split(":")) for part in spec.split()]


def _nudge(places: int) -> float:
    """Moves exact decimal ties off the rounding boundary, the same way in both engines."""
    return float(f"3.7e-{places + 4}")


def _spark_column(name: str, kind: str):
    col = F.col(name)
    if kind.startswith("d"):
        places = int(kind[1:] or 6)
        return (F.round(col.cast("double") + F.lit(_nudge(places)), places) + F.lit(0.0)).alias(name)
    return col.cast({"i": "bigint", "b": "boolean", "s": "string"}[kind]).alias(name)


def _sql_column(name: str, kind: str) -> str:
    if kind.startswith("d"):
        places = int(kind[1:] or 6)
        return f"round(cast({name} AS DOUBLE) + cast({_nudge(places)} AS DOUBLE), {places}) + cast(0 AS DOUBLE) AS {name}"
    return f"cast({name} AS {dict(i='BIGINT', b='BOOLEAN', s='VARCHAR')[kind]}) AS {name}"


def register(name: str, spec: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)``; ``spec`` lists output columns as name:type.

    Types: i bigint, d double rounded to 6 (dN: to N) places, b boolean, s string.  Both
    engines sum doubles in their own order, so results are compared after rounding.
    """
    fields = _fields(spec)

    def wrap(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(spark, sf_dir).select(*[_spark_column(n, k) for n, k in fields])

        twin = None
        if sql is not None:
            columns = ",\n       ".join(_sql_column(n, k) for n, k in fields)
            twin = f"SELECT {columns}\nFROM (\n{sql.strip()}\n) AS result"
        if name in ENTRIES:
            raise ValueError(f"query registered twice: {name}")
        ENTRIES[name] = Entry(name, run, twin)
        return fn

    return wrap
