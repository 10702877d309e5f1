"""Chunk stores: assembly over chunk borders, samples against NumPy, pruning; banded array files."""

import io
import os
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from surfaudit.operators.joins import chunk_cover, sample_volume
from surfaudit.operators import probe
from surfaudit.sources import bands, chunks
from surfaudit.sources.bands import read_array_bands, write_array_files
from surfaudit.sources.chunks import ChunkStore, assemble_pixels


def sparse(spark, array, names, value="v"):
    """Rows of the cells of an array that have a value."""
    at = np.argwhere(~np.isnan(array))
    rows = [(*map(int, p), float(array[tuple(p)])) for p in at]
    return spark.createDataFrame(rows, ", ".join([*[f"{n} int" for n in names], f"{value} double"]))


def volume(draw, shape, share=0.6):
    out = draw.integers(0, 255, shape).astype("float64")
    out[draw.random(shape) > share] = np.nan
    return out


def test_windows_over_chunk_borders(spark, tmp_path, rows):
    draw = np.random.default_rng(1)
    image = volume(draw, (50, 70))
    image[16:32, 32:48] = np.nan  # a chunk that is not there
    store = ChunkStore(str(tmp_path / "store"), ("y", "x"), 16, 2).write(sparse(spark, image, "yx"), "v")
    boxes = rows("box_id string, y0 int, y1 int, x0 int, x1 int", [("a", 3, 45, 5, 69), ("b", 20, 21, 40, 41), ("c", 7, 7, 0, 9), ("d", 0, 16, 0, 16), ("e", 48, 90, 60, 65)])
    cover = chunk_cover(boxes.where("y0 < y1"), {"y": 16, "x": 16})
    got = {(r.box_id, r.y, r.x): (r.value, r.covered) for r in assemble_pixels(boxes, store.chunks(cover), 16).collect()}
    want = {}
    for name, y0, y1, x0, x1 in boxes.collect():
        for y in range(y0, y1):
            for x in range(x0, x1):
                inside = y < 50 and x < 70
                covered = inside or (y < 64 and x < 80)
                covered = covered and not (16 <= y < 32 and 32 <= x < 48)
                v = image[y, x] if inside else np.nan
                want[name, y, x] = (None if np.isnan(v) else v, covered)
    assert got == want
    with pytest.raises(Exception, match="no chunk covers box"):
        assemble_pixels(boxes, store.chunks(cover), 16, gaps="raise").collect()
    whole = assemble_pixels(boxes.where("box_id = 'd'"), store.chunks(cover), 16, gaps="raise")
    assert whole.count() == 256 and whole.where("not covered").count() == 0


def test_windows_in_three_axes_and_small_batches(spark, tmp_path, rows, monkeypatch):
    monkeypatch.setattr(chunks, "CELLS_AT_ONCE", 7)
    image = volume(np.random.default_rng(2), (5, 9, 11))
    store = ChunkStore(str(tmp_path / "store"), size=4, slab=1).write(sparse(spark, image, "zyx"), "v")
    boxes = rows("box_id bigint, z0 int, z1 int, y0 int, y1 int, x0 int, x1 int", [(1, 0, 5, 2, 9, 3, 11), (1, 1, 2, 0, 1, 0, 1)])
    got = sorted((r.z, r.y, r.x, -1 if r.value is None else r.value) for r in assemble_pixels(boxes, store.chunks(chunk_cover(boxes, dict.fromkeys("zyx", 4))), 4, "zyx").collect())
    want = [(z, y, x) for z in range(5) for y in range(2, 9) for x in range(3, 11)] + [(1, 0, 0)]
    assert got == sorted((*p, -1 if np.isnan(image[p]) else image[p]) for p in want)


@pytest.mark.parametrize("at_once", [1 << 16, 5])
def test_samples_equal_numpy(spark, tmp_path, monkeypatch, at_once):
    monkeypatch.setattr(chunks, "POINTS_AT_ONCE", at_once)
    draw = np.random.default_rng(3)
    image = volume(draw, (9, 12, 13))
    full = np.nan_to_num(np.pad(image, 2, constant_values=np.nan))
    store = ChunkStore(str(tmp_path / "store"), size=4, slab=2).write(sparse(spark, image, "zyx"), "v")
    p = np.concatenate([draw.random((150, 3)) * [10, 13, 14] - 0.9, np.floor(draw.random((30, 3)) * 9), np.tile([[4.5, 4.5, 4.5]], (40, 1)), [[0.5, 2.5, 3.5]]])
    df = spark.createDataFrame([(i, *map(float, q)) for i, q in enumerate(p)], "id bigint, pz double, py double, px double")
    got = {r.id: r["sample"] for r in sample_volume(df, store, ["id"]).collect()}
    near = {r.id: r["sample"] for r in store.sample(df, ["id"], "nearest").collect()}
    assert len(got) == len(near) == len(p)
    for i, q in enumerate(p):
        base, want = np.floor(q).astype(int), 0.0
        for c in np.ndindex(2, 2, 2):
            want += np.prod(np.where(c, q - base, 1 - (q - base))) * full[tuple(base + c + 2)]
        assert abs(got[i] - want) < 1e-9
        assert near[i] == full[tuple(np.rint(q).astype(int) + 2)]


def test_corners_clamp_to_the_border(spark, tmp_path):
    image = np.arange(30.0).reshape(5, 6)
    store = ChunkStore(str(tmp_path / "store"), ("y", "x"), 4).write(sparse(spark, image, "yx"), "v")
    p = [(-3.0, 2.0), (-0.5, -0.5), (4.75, 5.5), (9.0, 9.0), (1.25, 2.5)]
    df = spark.createDataFrame([(i, *q) for i, q in enumerate(p)], "id int, py double, px double")
    got = [r["sample"] for r in store.sample(df, ["id"], shape=(5, 6)).orderBy("id").collect()]
    assert np.allclose(got, [2.0, 0.0, 29.0, 29.0, 1.25 * 6 + 2.5])


def test_only_the_slabs_of_the_points_are_read(spark, tmp_path):
    image = np.ones((8, 64, 64))
    store = ChunkStore(str(tmp_path / "store"), size=8, slab=2).write(sparse(spark, image, "zyx"), "v")
    assert len([d for d in os.listdir(store.path) if d.startswith("slab=")]) == 16
    wanted = spark.createDataFrame([(0, 0, 0), (0, 1, 1), (0, 6, 7), (5, 900, 900)], "kz int, ky int, kx int")
    found = store.chunks(wanted)
    assert found.count() == 3
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "0_3_3" in plan
    assert store.chunks(wanted.where("kz = 5")).count() == 0
    for folder in os.listdir(store.path):  # what is not looked at may as well be broken
        if folder.startswith("slab=") and folder not in ("slab=0_0_0", "slab=0_3_3", "slab=0_0_1"):
            for name in os.listdir(f"{store.path}/{folder}"):
                with open(f"{store.path}/{folder}/{name}", "r+b") as file:
                    file.write(b"broken" * 9)
    points = spark.createDataFrame([(1, 1.5, 2.5, 3.5), (2, 0.0, 50.0, 60.0)], "id int, pz double, py double, px double")
    assert [r["sample"] for r in store.sample(points, ["id"]).collect()] == [1.0, 1.0]


def test_store_of_an_empty_look(spark, tmp_path):
    store = ChunkStore(str(tmp_path / "store"), size=4).write(sparse(spark, np.ones((2, 2, 2)), "zyx"), "v")
    none = spark.createDataFrame([], "id int, pz double, py double, px double")
    assert store.sample(none, ["id"]).count() == 0
    far = spark.createDataFrame([(1, 1e6, 0.0, 0.0)], "id int, pz double, py double, px double")
    assert [r["sample"] for r in store.sample(far, ["id"]).collect()] == [0.0]


# banded array files --------------------------------------------------------------------------


@pytest.mark.parametrize("elements", [7, 1 << 20])
def test_bands_equal_the_arrays(spark, tmp_path, elements, monkeypatch):
    monkeypatch.setattr(bands, "BATCH_ELEMENTS", 5)
    draw = np.random.default_rng(5)
    a = draw.random((6, 5)).astype("float32")
    a[2, 3] = np.nan
    np.save(tmp_path / "a.npy", a)
    np.save(tmp_path / "b.npy", np.asfortranarray(draw.integers(0, 9, (4, 7))))
    np.save(tmp_path / "c.npy", np.zeros((0, 4)))
    np.savez(tmp_path / "d.npz", first=a + 1, other=a[:2] * 2)
    np.savez_compressed(tmp_path / "e.npz", other=a * 3)
    want = {
        "a.npy": a, "b.npy": np.load(tmp_path / "b.npy"), "d.npz": np.load(tmp_path / "d.npz")["other"], "e.npz": a * 3,
    }
    got = {}
    for pattern in ("*.npy", "*.npz"):
        for r in read_array_bands(spark, f"file://{tmp_path}/{pattern}", ["y", "x"], key="other" if "npz" in pattern else None, elements=elements).collect():
            got.setdefault(os.path.basename(r.path), {})[r.y, r.x] = r.value
    assert set(got) == set(want)
    for name, array in want.items():
        assert len(got[name]) == array.size
        assert all((v is None) == bool(np.isnan(array[p])) and (v is None or v == array[p]) for p, v in got[name].items())
    (tmp_path / "raw.bin").write_bytes(np.arange(24, dtype="<u2").tobytes())
    raw = read_array_bands(spark, str(tmp_path / "raw.bin"), ["z", "y", "x"], shape=(2, 3, 4), dtype="<u2", elements=elements)
    assert sorted((r.z, r.y, r.x, r.value) for r in raw.collect()) == [(z, y, x, z * 12 + y * 4 + x) for z in range(2) for y in range(3) for x in range(4)]


def test_bands_of_unfit_files(spark, tmp_path):
    np.save(tmp_path / "a.npy", np.zeros((3, 3)))
    (tmp_path / "raw.bin").write_bytes(b"12345")
    for pattern, more in (("nothing*", {}), ("a.npy", {"axes": ["x"]}), ("raw.bin", {"shape": (2, 2)}), ("raw.bin", {})):
        with pytest.raises(Exception):
            read_array_bands(spark, str(tmp_path / pattern), **({"axes": ["y", "x"]} | more)).collect()
    with pytest.raises(ValueError, match="shared folders"):
        read_array_bands(spark, "s3://some/array.npy", ["y"])


def test_files_are_written_whole(spark, tmp_path, rows):
    files = rows("path string, content binary", [("a.npy", bytearray(b"x" * 10)), ("b.npy", bytearray(b""))])
    assert write_array_files(files, f"file://{tmp_path}/out") == 2 and write_array_files(files, str(tmp_path / "out")) == 2
    assert sorted(os.listdir(tmp_path / "out")) == ["a.npy", "b.npy"]


def test_a_band_takes_little_memory(tmp_path):
    """A file of 1.6 GB (a sparse one) is planned and a band of it decoded below 512 MB."""
    path = tmp_path / "large.npy"
    with open(path, "wb") as file:
        np.lib.format.write_array_header_1_0(file, {"descr": "<f8", "fortran_order": False, "shape": (20_000, 10_000)})
        file.truncate(file.tell() + 8 * 20_000 * 10_000)
    code = (
        "import resource; resource.setrlimit(resource.RLIMIT_DATA, (512 << 20, 512 << 20))\n"
        "from surfaudit.sources.bands import plan_bands, read_band\n"
        f"plan = plan_bands([{str(path)!r}], None, None, 'uint8')\n"
        "rows = sum(len(b) for b in read_band(plan[-1], ['y', 'x']))\n"
        "print(len(plan), rows)"
    )
    env = os.environ | {"PYTHONPATH": os.getcwd(), "OMP_NUM_THREADS": "1", "OPENBLAS_NUM_THREADS": "1"}
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, env=env, cwd=os.path.dirname(os.path.dirname(__file__)))
    assert done.returncode == 0, done.stderr[-2000:]
    planned, count = map(int, done.stdout.split())
    assert planned == -(-200_000_000 // bands.BAND_ELEMENTS) and count == 200_000_000 - (planned - 1) * bands.BAND_ELEMENTS


def test_maps_of_one_surface_are_many_compact_files(spark, tmp_path):
    from surfaudit.sources.ledgers import write_maps

    maps = spark.range(128 * 128).select(F.lit("s").alias("surface"), (F.col("id") % 128).cast("int").alias("y"), F.floor(F.col("id") / 128).cast("int").alias("x"), F.rand(1).alias("v"))
    write_maps(maps, str(tmp_path / "maps"), ["surface"], tasks=8)
    files = [os.path.join(d, n) for d, _, names in os.walk(tmp_path / "maps") for n in names if n.endswith(".parquet")]
    assert len(files) >= 6
    back = spark.read.parquet(str(tmp_path / "maps"))
    assert back.count() == 128 * 128 and back.select("y", "x").distinct().count() == 128 * 128
    boxes = back.groupBy(F.input_file_name()).agg(((F.max("y") - F.min("y") + 1) * (F.max("x") - F.min("x") + 1)).alias("a"), F.count("*").alias("n")).collect()
    assert sum(r.a for r in boxes) <= 2.5 * sum(r.n for r in boxes)
    from surfaudit.functions.scalar import interleaved

    code = lambda y, x: sum(((y >> i & 1) << 2 * i + 1) | ((x >> i & 1) << 2 * i) for i in range(31))
    pairs = [(0, 0), (1, 2), (5, 9), (2**31 - 1, 0), (123456789, 987654321)]
    got = spark.createDataFrame(pairs, "y int, x int").select("y", "x", interleaved(F.col("y"), F.col("x")).alias("m")).collect()
    assert all(r.m == code(r.y, r.x) for r in got)


def test_windows_of_a_chunk_are_pasted_together_into_few_batches(rows, spark, monkeypatch):
    """One batch of rows for each window was slow; the cells of 500 small windows are a few batches."""
    import surfaudit.sources.chunks as module

    content = io.BytesIO()
    np.save(content, np.arange(256, dtype="float64").reshape(16, 16))
    made = []
    boxes = rows("box_id int, y0 int, y1 int, x0 int, x1 int", [(i, i % 7, i % 7 + 3, i % 5, i % 5 + 2) for i in range(500)])
    chunks = rows("ky int, kx int, content binary", [(0, 0, bytearray(content.getvalue()))])
    monkeypatch.setattr(type(boxes), "mapInArrow", lambda df, fn, schema: made.append((df, fn)) or df)
    module.assemble_pixels(boxes, chunks, 16)
    df, paste = made[0]
    out = list(paste(iter(df.toArrow().combine_chunks().to_batches())))
    assert len(out) <= 3 and sum(len(b) for b in out) == 3000
    got = {(b, y, x): v for batch in out for b, y, x, v in zip(*[batch.column(i).to_pylist() for i in range(4)])}
    assert got == {(i, y, x): 16.0 * y + x for i in range(500) for y in range(i % 7, i % 7 + 3) for x in range(i % 5, i % 5 + 2)}


def test_folders_do_not_grow_with_the_store(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(chunks, "FOLDERS", 4)  # two names along an axis
    image = np.arange(40.0 * 12).reshape(40, 12)
    store = ChunkStore(str(tmp_path / "store"), ("y", "x"), 4, 1).write(sparse(spark, image, "yx"), "v")
    assert len([d for d in os.listdir(store.path) if d.startswith("slab=")]) == 4
    wanted = spark.createDataFrame([(0, 0), (9, 2), (4, 1), (10, 0), (-2, 0)], "ky int, kx int")
    assert sorted((r.ky, r.kx) for r in store.chunks(wanted).collect()) == [(0, 0), (4, 1), (9, 2)]
    points = spark.createDataFrame([(int(y * 12 + x), float(y), float(x)) for y in range(40) for x in range(12)], "id int, py double, px double")
    assert all(r["sample"] == r.id for r in store.sample(points, ["id"]).collect())


def test_profiles_equal_single_samples_and_shuffle_a_point_once(spark, tmp_path):
    draw = np.random.default_rng(8)
    image = volume(draw, (7, 20, 40))
    store = ChunkStore(str(tmp_path / "store"), size=16, slab=2).write(sparse(spark, image, "zyx"), "v")
    rows = [(i, *map(float, draw.random(3) * [7, 20, 40]), 1.0, float(i % 3) / 4, 0.0) for i in range(200)]
    points = spark.createDataFrame(rows, "point_id int, pz double, py double, px double, nz double, ny double, nx double")
    points = points.withColumn("nx", F.lit(0.0)).withColumn("nz", F.lit(1.0)).withColumn("pz", F.lit(3.0))
    places = probe._places([1, 2, 3])
    got = {r.point_id: r.samples for r in probe.probe_profiles(points, store, [1, 2, 3]).collect()}
    assert len(got) == 200 and any(any(s) for s in got.values())
    for i, s in [(r.point_id, r) for r in probe.probe_samples(points, store, [1, 2, 3]).collect()]:
        assert got[i][places.index((s.step, s.side))] == s["sample"]
    table = sparse(spark, image, "zyx")
    score = [probe.seating_score(points, v, [1, 2, 3], 20, 0.05).first() for v in (store, table)]
    assert score[0].gap == score[1].gap and np.allclose(score[0], score[1])
    moved = []
    plain = chunks.written
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(chunks, "written", lambda df, name: moved.append((name, plain(df, name))) or moved[-1][1])
        store.sample_along(points, ["point_id"], [0.0, 1.0, -1.0, 2.0, -2.0, 3.0, -3.0], "nearest").count()
    assert sum(df.count() for name, df in moved if name == "samples") < 2 * 200  # places would be 1,400 rows
