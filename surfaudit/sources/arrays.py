"""Array files as rows, and dense chunks back as array files.

A file or chunk is the unit of work: its size is fixed by the chunk shape, and Spark spreads
the files over tasks.
"""

from __future__ import annotations

import io
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F


def _load(content: bytes, path: str, key: str | None, shape, dtype: str) -> np.ndarray:
    if path.endswith((".npy", ".npz")):
        loaded = np.load(io.BytesIO(content), allow_pickle=False)
        return loaded if isinstance(loaded, np.ndarray) else loaded[key or loaded.files[0]]
    return np.frombuffer(content, dtype=dtype).reshape(shape)


def decode_arrays(
    files: DataFrame, axes: Sequence[str], key: str | None = None, shape: Sequence[int] | None = None,
    dtype: str = "uint8", keep: Sequence[str] = (),
) -> DataFrame:
    """(keep, path, axes, value) for each element of files(path, content); NaN becomes NULL."""
    axes, keep = list(axes), list(keep)

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                array = _load(bytes(row.content), row.path, key, shape, dtype)
                if array.ndim != len(axes):
                    raise ValueError(f"{row.path}: {array.ndim} axes, expected {len(axes)}")
                out = {k: getattr(row, k) for k in keep} | {"path": row.path}
                frame = pd.DataFrame({a: i.ravel().astype("int32") for a, i in zip(axes, np.indices(array.shape))})
                for name, value in out.items():
                    frame[name] = value
                frame["value"] = array.ravel().astype("float64")
                yield frame[[*keep, "path", *axes, "value"]]

    types = dict(files.dtypes)
    schema = ", ".join([*[f"{k} {types[k]}" for k in keep], "path string", *[f"{a} int" for a in axes], "value double"])
    rows = files.select(*keep, "path", "content").mapInPandas(decode, schema)
    return rows.withColumn("value", F.when(~F.isnan("value"), F.col("value")))


def read_arrays(
    spark: SparkSession, glob: str, axes: Sequence[str], key: str | None = None,
    shape: Sequence[int] | None = None, dtype: str = "uint8",
) -> DataFrame:
    """.npy, .npz (one key) or raw chunk files under a path or glob, as rows."""
    files = spark.read.format("binaryFile").load(glob).select("path", "content")
    return decode_arrays(files, axes, key, shape, dtype)


def encode_chunks(px: DataFrame, value: str, size: int, axes: Sequence[str] = ("y", "x")) -> DataFrame:
    """(k<axis>, path, content): each size ** dims chunk of a sparse raster as .npy bytes.

    Missing cells are NaN.  A chunk holds at most size ** dims cells.
    """
    axes = list(axes)
    keys = [f"k{a}" for a in axes]

    def encode(pdf: pd.DataFrame) -> pd.DataFrame:
        dense = np.full((size,) * len(axes), np.nan)
        origin = [int(pdf[k].iloc[0]) for k in keys]
        dense[tuple((pdf[a] - o * size).to_numpy() for a, o in zip(axes, origin))] = pdf[value].to_numpy(dtype="float64")
        out = io.BytesIO()
        np.save(out, dense)
        return pd.DataFrame([[*origin, "_".join(map(str, origin)) + ".npy", out.getvalue()]], columns=[*keys, "path", "content"])

    cells = px.select(*axes, value, *[F.floor(F.col(a) / size).cast("int").alias(k) for a, k in zip(axes, keys)])
    schema = ", ".join([*[f"{k} int" for k in keys], "path string", "content binary"])
    return cells.groupBy(*keys).applyInPandas(encode, schema)
