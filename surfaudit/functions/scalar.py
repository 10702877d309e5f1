"""Column functions: normalisation, validity, ids, geometry arithmetic, small-array statistics."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, functions as F


def lit(value: float) -> Column:
    return F.lit(float(value))


def floor_div(a: Column, b) -> Column:
    """Floor division: Spark's DIV truncates toward zero, coordinates may be negative."""
    return F.floor(a.cast("double") / F.lit(b).cast("double")).cast("bigint")


# -- scores -----------------------------------------------------------------------------


def normalize(col: Column, lo: float, hi: float) -> Column:
    """Rescale to [0, 1] and clip, so infinities become 0 or 1."""
    if not (math.isfinite(lo) and math.isfinite(hi) and hi > lo):
        raise ValueError("value range must be finite and increasing")
    scaled = (col.cast("double") - lit(lo)) / lit(hi - lo)
    return F.when(~F.isnan(col), F.greatest(lit(0), F.least(lit(1), scaled)))


def valid_score(col: Column, valid: Column | None = None) -> Column:
    """The score where it is finite and unmasked, otherwise NULL."""
    keep = ~F.isnan(col) & (F.abs(col) < lit(math.inf))
    return F.when(keep if valid is None else keep & valid, col)


def fuse(a: Column, b: Column, how: str) -> Column:
    if how == "mean":
        return (a + b) / lit(2)
    if how == "disagreement":
        return F.abs(a - b)
    if how == "geometric":
        clip = lambda c: F.greatest(lit(0), F.least(lit(1), c))
        return F.sqrt(clip(a) * clip(b))
    raise ValueError(f"unknown fusion: {how}")


def shortfall(gate: float, *cols: Column) -> Column:
    """How far the worst of the columns stays below the gate, 0 when all reach it."""
    return F.round(F.greatest(lit(0), *[lit(gate) - c for c in cols]), 6)


# -- vertices -----------------------------------------------------------------------------


def vertex_valid(x: Column, y: Column, z: Column, mode: str = "strict") -> Column:
    """Three rules: no sentinel at all, not the whole sentinel, all coordinates positive."""
    finite = F.lit(True)
    for c in (x, y, z):
        finite = finite & c.isNotNull() & ~F.isnan(c) & (F.abs(c) < lit(math.inf))
    if mode == "strict":
        rule = (x != -1) & (y != -1) & (z != -1) & (z > 0)
    elif mode == "not_all_sentinel":
        rule = ~((x == -1) & (y == -1) & (z == -1)) & (z > 0)
    elif mode == "positive":
        rule = (x > 0) & (y > 0) & (z > 0)
    else:
        raise ValueError(f"unknown vertex rule: {mode}")
    return F.coalesce(finite & rule, F.lit(False))


# -- tiles and names --------------------------------------------------------------------


def region_id(y: Column, x: Column, size: int) -> Column:
    y0, x0 = floor_div(y, size) * size, floor_div(x, size) * size
    return F.format_string("y%05d_x%05d", y0, x0)


def block_id(y: Column, x: Column, size: int) -> Column:
    return F.format_string("by%02d_bx%02d", floor_div(y, size), floor_div(x, size))


def interleaved(y: Column, x: Column) -> Column:
    """Morton code of a pixel: the bits of y and x, 31 of each, in turn; near pixels have near codes."""
    def spread(c: Column) -> Column:
        c = c.cast("bigint").bitwiseAND(F.lit((1 << 31) - 1))
        for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
            c = c.bitwiseOR(F.shiftleft(c, shift)).bitwiseAND(F.lit(mask))
        return c

    return F.shiftleft(spread(y), 1).bitwiseOR(spread(x))


def parse_int(text: Column, pattern: str, group: int = 1) -> Column:
    """A captured integer, NULL where the pattern does not match."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit("")).cast("bigint")


def parse_text(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


# The name formats that are parsed.
CHUNK_NAME = r"^0\.(\d+)\.(\d+)$"
VOLUME_NAME = r"^(\d+)-(\d+(?:\.\d+)?)um-"
ENERGY_NAME = r"-(\d+)keV-"
VOLUME_IN_URL = r"volume-(\d+)"
BLOCK_ROW = r"^by(\d+)_"


def parse_required(text: Column, pattern: str, group: int = 1) -> Column:
    """``parse_text`` that fails on a text without a match, for names a job cannot do without."""
    found = parse_text(text, pattern, group)
    return F.coalesce(found, F.raise_error(F.concat(F.lit("no match for "), F.lit(pattern), F.lit(": "), F.coalesce(text, F.lit("NULL")))).cast("string"))


def chunk_key(path: Column) -> tuple[Column, Column]:
    name = F.substring_index(path, "/", -1)
    return parse_int(name, CHUNK_NAME, 1), parse_int(name, CHUNK_NAME, 2)


def s3_to_https(url: Column) -> Column:
    return F.regexp_replace(url, r"^s3://([^/]+)/(.+)$", r"https://$1.s3.amazonaws.com/$2")


def url_host(url: Column) -> Column:
    return parse_text(url, r"^[a-z0-9]+://([^/?#:]+)")


def path_prefix(url: Column, marker: str) -> Column:
    """The object key before a marker, NULL when the marker is absent."""
    key = F.regexp_replace(url, r"^[a-z0-9]+://[^/]+/", "")
    return F.when(F.instr(key, marker) > 0, F.substring_index(key, marker, 1))


# -- coordinates ----------------------------------------------------------------------------


def affine(matrix: Sequence[Sequence[float]], z: Column, y: Column, x: Column) -> list[Column]:
    """A 4x4 affine on Z,Y,X columns; a projective last row is rejected."""
    if [len(r) for r in matrix] != [4] * 4 or [float(v) for v in matrix[3]] != [0, 0, 0, 1]:
        raise ValueError("a 4x4 affine with last row 0 0 0 1 is required")
    return [lit(r[0]) * z + lit(r[1]) * y + lit(r[2]) * x + lit(r[3]) for r in matrix[:3]]


def chunk_center(index: Column, size: int) -> Column:
    return index.cast("double") * lit(size) + lit(size / 2)


def to_level(value: Column, level: int, rounding: bool = False) -> Column:
    if level < 0:
        raise ValueError("level must not be negative")
    scaled = value.cast("double") / lit(2**level)
    return F.rint(scaled).cast("bigint") if rounding else scaled


def centered_bounds(center: Column, size: int, limit: int) -> tuple[Column, Column]:
    """Half-open [lo, hi) around a centre, clipped to [0, limit); lo >= hi means no overlap."""
    lo = center.cast("bigint") - size // 2
    return F.greatest(lo, F.lit(0)), F.least(lo + size, F.lit(limit))


def map_bounds(lo: Column, hi: Column, source: int, target: int) -> tuple[Column, Column]:
    """Rescale half-open bounds to another canvas, rounding outward."""
    to = lambda c: c.cast("double") * lit(target) / lit(source)
    return F.floor(to(lo)).cast("bigint"), F.ceil(to(hi)).cast("bigint")


def box_distance(point: Sequence[Column], lo: Sequence[Column], hi: Sequence[Column]) -> Column:
    deltas = [F.greatest(l - p, p - h, lit(0)) for p, l, h in zip(point, lo, hi)]
    total = deltas[0] * deltas[0]
    for d in deltas[1:]:
        total = total + d * d
    return F.sqrt(total)


def box_volume(lo: Sequence[Column], hi: Sequence[Column]) -> Column:
    total = lit(1)
    for l, h in zip(lo, hi):
        total = total * (h - l)
    return total


def edge_chunk(index: Column, chunk: int, shape: int) -> Column:
    """Extent of a chunk along one axis; the last one is short, NULL outside the array."""
    left = F.lit(shape) - index.cast("bigint") * chunk
    return F.when((index >= 0) & (left > 0), F.least(F.lit(chunk), left))


def hann(i: Column, n: int) -> Column:
    return lit(0.5) - lit(0.5) * F.cos(lit(2 * math.pi) * i / lit(n - 1))


def tile_starts(length: int, tile: int, stride: int) -> Column:
    """Array of tile starts; the last tile always ends at the edge."""
    if length < tile or tile <= 0 or stride <= 0:
        raise ValueError("length must cover one positive tile and stride")
    end = length - tile
    return F.array_union(F.sequence(F.lit(0), F.lit(end), F.lit(stride)), F.array(F.lit(end)))


# -- statistics over a short array ------------------------------------------------------------


def array_sum(col: Column) -> Column:
    return F.aggregate(col, lit(0), lambda a, v: a + v.cast("double"))


def array_mean(col: Column) -> Column:
    return F.try_divide(array_sum(col), F.size(col))


def array_std(col: Column) -> Column:
    """Population standard deviation."""
    m = array_mean(col)
    return F.sqrt(array_mean(F.transform(col, lambda v: (v - m) * (v - m))))


def median_of(*cols: Column) -> Column:
    """Median of the non-NULL values of a few columns in one row."""
    ordered = F.sort_array(F.array(*cols), asc=False)  # NULLs last
    n = count_of(*cols)
    mid = F.get(ordered, F.greatest(F.floor((n - 1) / 2), F.lit(0)).cast("int"))
    return (mid + F.get(ordered, F.floor(n / 2).cast("int"))) / lit(2)


def count_of(*cols: Column) -> Column:
    total = F.lit(0)
    for c in cols:
        total = total + c.isNotNull().cast("int")
    return total


def profile_features(col: Column) -> dict[str, Column]:
    """Fixed features of a depth profile of L layers."""
    n, quarter = F.size(col), F.floor(F.size(col) / 4).cast("int")
    values = F.transform(col, lambda v: v.cast("double"))
    center = F.slice(values, quarter + 1, n - quarter * 2)
    edges = F.concat(F.slice(values, F.lit(1), quarter), F.slice(values, n - quarter + 1, quarter))
    offset = (n - 1) / lit(2)
    slope = F.try_divide(
        array_sum(F.transform(values, lambda v, i: v * (i - offset))),
        array_sum(F.transform(values, lambda v, i: (i - offset) * (i - offset))),
    )
    top, low = F.array_max(values), F.array_min(values)
    return {
        "mean": array_mean(values),
        "std": array_std(values),
        "min": low,
        "max": top,
        "range": top - low,
        "argmax": F.array_position(values, top) - 1,
        "slope": slope,
        "center_contrast": array_mean(center) - array_mean(edges),
    }


def extent_ratio(shape_a: Column, scale_a: Column, shape_b: Column, scale_b: Column) -> Column:
    """Per-axis physical extents, smaller over larger."""
    extent = lambda s, c: F.zip_with(s, c, lambda n, u: F.round(n * u, 6))
    return F.zip_with(
        extent(shape_a, scale_a),
        extent(shape_b, scale_b),
        lambda a, b: F.coalesce(F.try_divide(F.least(a, b), F.greatest(a, b)), lit(0)),
    )
