"""Large array files as rows: headers are read to plan ranges, each range is decoded in small batches.

``.npy`` files, members of ``.npz`` files and raw files are read where they lie, so a folder has to
be one that the driver and all executors see under the same path.  For files in a store that only
Spark reads, ``arrays.decode_arrays`` takes them whole, file by file.
"""

from __future__ import annotations

import contextlib
import glob
import json
import os
import zipfile
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

NAME = "surfaudit_array_bands"
BAND_ELEMENTS = 1 << 23  # of a partition
BATCH_ELEMENTS = 1 << 16  # that become rows at once
COPY_BYTES = 1 << 20


@dataclass
class Band(InputPartition):
    """Elements [first, last) of one array, in the order in which the file holds them."""

    path: str
    member: str | None
    dtype: str
    shape: tuple[int, ...]
    fortran: bool
    offset: int
    first: int
    last: int


def _local(path: str) -> str:
    scheme, colon, rest = path.partition(":")
    if colon and scheme == "file":
        return "/" + rest.lstrip("/")
    if colon and rest.startswith("/") and not os.path.exists(path):
        raise ValueError(f"{path}: bands are read from shared folders; give files of a {scheme} store to decode_arrays")
    return path


@contextlib.contextmanager
def _opened(path: str, member: str | None):
    """The bytes of an array: a file, or a member of an archive."""
    if member is None:
        with open(path, "rb") as file:
            yield file
    else:
        with zipfile.ZipFile(path) as archive, archive.open(member) as file:
            yield file


def _header(path: str, member: str | None) -> tuple[str, tuple[int, ...], bool, int]:
    """(dtype, shape, fortran, offset) from the first bytes of an array."""
    with _opened(path, member) as file:
        version = np.lib.format.read_magic(file)
        read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
        shape, fortran, dtype = read(file)
        if dtype.hasobject:
            raise ValueError(f"{path}: arrays of objects are not read")
        return dtype.str, shape, fortran, file.tell()


def plan_bands(paths: Sequence[str], key: str | None, shape: Sequence[int] | None, dtype: str, elements: int = BAND_ELEMENTS) -> list[Band]:
    """Ranges of all arrays; of each file only the header is read.

    A compressed member of an archive cannot be entered in the middle: it is one range, and is
    read through in small batches all the same.
    """
    out = []
    for path in paths:
        member, one = None, False
        if path.endswith(".npz"):
            with zipfile.ZipFile(path) as archive:
                names = archive.namelist()
                member = f"{key}.npy" if key else names[0]
                one = archive.getinfo(member).compress_type != zipfile.ZIP_STORED
        if path.endswith((".npy", ".npz")):
            kind, dims, fortran, offset = _header(path, member)
        else:
            if shape is None:
                raise ValueError(f"{path}: a raw file needs its shape")
            kind, dims, fortran, offset = np.dtype(dtype).str, tuple(shape), False, 0
            if os.path.getsize(path) != int(np.prod(dims, dtype=np.int64)) * np.dtype(kind).itemsize:
                raise ValueError(f"{path}: size does not match shape {dims} of {dtype}")
        total = int(np.prod(dims, dtype=np.int64))
        step = total if one else elements
        out += [Band(path, member, kind, tuple(dims), fortran, offset, i, min(total, i + step)) for i in range(0, total, max(1, step))]
    return out


def _skip(file, count: int) -> None:
    while count > 0:
        count -= len(file.read(min(count, COPY_BYTES))) or count


def read_band(band: Band, axes: Sequence[str], batch: int = BATCH_ELEMENTS) -> Iterator[pa.RecordBatch]:
    """Rows (path, axes, value) of one range, at most ``batch`` at a time."""
    kind = np.dtype(band.dtype)
    dims = band.shape[::-1] if band.fortran else band.shape
    with _opened(band.path, band.member) as file:
        if band.member is None or band.first:
            file.seek(band.offset + band.first * kind.itemsize)
        else:
            _skip(file, band.offset)
        for i in range(band.first, band.last, batch):
            n = min(batch, band.last - i)
            held = file.read(n * kind.itemsize)
            if len(held) < n * kind.itemsize:
                raise ValueError(f"{band.path}: ends before its shape {band.shape}")
            value = np.frombuffer(held, dtype=kind).astype("float64")
            places = np.unravel_index(np.arange(i, i + n), dims)
            places = places[::-1] if band.fortran else places
            columns = [pa.DictionaryArray.from_arrays(pa.array(np.zeros(n, dtype=np.int32)), pa.array([band.path])).cast(pa.string())]
            columns += [pa.array(p.astype("int32")) for p in places]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(value, mask=np.isnan(value))], ["path", *axes, "value"])


class ArrayBands(DataSource):
    """Options: paths (JSON list), axes (comma-separated), key, shape, dtype, elements."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return ", ".join(["path string", *[f"{a} int" for a in self.options["axes"].split(",")], "value double"])

    def reader(self, schema) -> DataSourceReader:
        return BandReader(dict(self.options))


class BandReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options
        self.axes = options["axes"].split(",")

    def partitions(self) -> list[Band]:
        o = self.options
        shape = [int(n) for n in o["shape"].split(",")] if o.get("shape") else None
        bands = plan_bands(json.loads(o["paths"]), o.get("key") or None, shape, o["dtype"], int(o["elements"]))
        for b in bands:
            if len(b.shape) != len(self.axes):
                raise ValueError(f"{b.path}: {len(b.shape)} axes, expected {len(self.axes)}")
        return bands

    def read(self, partition: Band) -> Iterator[pa.RecordBatch]:
        return read_band(partition, self.axes)


def read_array_bands(
    spark: SparkSession, pattern: str, axes: Sequence[str], key: str | None = None, shape: Sequence[int] | None = None,
    dtype: str = "uint8", elements: int = BAND_ELEMENTS,
) -> DataFrame:
    """(path, axes, value) for each element of the arrays under a path or glob; NaN becomes NULL.

    Arrays of any size: a task holds BATCH_ELEMENTS of one at a time.  Files are .npy, .npz (one
    key, the first if none is given) or raw (shape and dtype given); empty arrays give no row.
    """
    found = _local(pattern)
    if os.path.isdir(found):
        found = os.path.join(found, "*")
    paths = sorted(p for p in glob.glob(found) if os.path.isfile(p) and not os.path.basename(p).startswith((".", "_")))
    if not paths:
        raise ValueError(f"{pattern}: no files")
    spark.dataSource.register(ArrayBands)
    options = {"paths": json.dumps(paths), "axes": ",".join(axes), "dtype": dtype, "elements": str(elements)}
    options |= {"key": key} if key else {}
    options |= {"shape": ",".join(map(str, shape))} if shape is not None else {}
    return spark.read.format(NAME).options(**options).load()


def write_array_files(files: DataFrame, folder: str) -> int:
    """Writes (path, content) rows as files below a shared folder; the number of files.

    A file takes its name only once it is whole, so a task that is run again does no harm.
    """
    target = _local(folder)
    os.makedirs(target, exist_ok=True)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content")):
                name = os.path.join(target, path.as_py())
                part = os.path.join(target, f".{os.getpid()}-{path.as_py()}")
                with open(part, "wb") as file:
                    file.write(content.as_py())
                os.replace(part, name)
            yield pa.RecordBatch.from_arrays([pa.array([len(batch)])], ["n"])

    return files.select("path", "content").mapInArrow(put, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
