"""Cutout planning for whole tables of sky requests, and tile availability across levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from starloom.functions import grid
from starloom.functions.nan import is_finite
from starloom.functions.wcs import FIELDS, Wcs, sky_to_pix
from starloom.operators.ordering import coalesce_bounded

PERIMETER_SAMPLES = 16


def pyramids(levels: DataFrame) -> DataFrame:
    """One row per band with its levels (finest first) as an array; at most about 40 entries.

    With the levels in the row, choosing one is array arithmetic: requests meet their
    band once and are never regrouped.
    """
    entry = F.struct("z", "pixel_scale_arcsec", "h", "w", "n_ty", "n_tx", *[f for f in FIELDS])
    return levels.groupBy("band").agg(F.array_sort(F.collect_list(entry)).alias("levels"))


def choose_level(levels: Column, target: Column, rounding: str = "nearest") -> Column:
    """z of the level serving ``target`` arcsec per pixel.

    nearest: closest in log scale, the finer on ties. finer: the coarsest not coarser than
    the target, else the finest. coarser: the finest not finer, else the coarsest.
    """
    scale = "pixel_scale_arcsec"
    if rounding == "nearest":
        ranked = F.transform(levels, lambda l: F.struct(F.abs(F.log2(l[scale] / target)).alias("d"), l["z"].alias("z")))
        return F.array_min(ranked)["z"]
    zs = F.transform(levels, lambda l: l["z"])
    if rounding == "finer":
        return F.coalesce(
            F.array_max(F.transform(F.filter(levels, lambda l: l[scale] <= target), lambda l: l["z"])), F.array_min(zs)
        )
    if rounding == "coarser":
        return F.coalesce(
            F.array_min(F.transform(F.filter(levels, lambda l: l[scale] >= target), lambda l: l["z"])), F.array_max(zs)
        )
    raise ValueError(f"unknown rounding {rounding!r}")


def output_scale(target: Column, fov_x: Column, fov_y: Column, out_x: Column, out_y: Column, finest: Column) -> Column:
    """Explicit scale, else the finer axis of field over output size, else the finest level's."""
    by_size = F.when(out_x.isNotNull() & out_y.isNotNull(), F.least(fov_x / out_x, fov_y / out_y))
    return F.coalesce(target, by_size, finest)


def perimeter_point(i: Column, ra: Column, dec: Column, fov_x: Column, fov_y: Column, samples: int) -> tuple[Column, Column]:
    """Sample i of 4 * samples along the edges of a sky box (sizes in arcsec): bottom, top, left, right.

    The RA offset is divided by the cosine of each sample's own declination.
    """
    hx, hy = fov_x / 7200.0, fov_y / 7200.0
    edge = F.floor(i / samples)
    t = (i % samples) * (2.0 / (samples - 1)) - 1.0
    dx = F.when(edge < 2, t * hx).when(edge == 2, -hx).otherwise(hx)
    dy = F.when(edge >= 2, t * hy).when(edge == 0, -hy).otherwise(hy)
    c = F.cos(F.radians(dec + dy))
    return ra + dx / F.when(F.abs(c) > 1e-9, c).otherwise(F.lit(1e-9)), dec + dy


def pixel_box(requests: DataFrame, bands: DataFrame, rounding: str = "nearest", samples: int = PERIMETER_SAMPLES) -> DataFrame:
    """Level and clamped half-open pixel box of every request.

    ``requests``: request_id, band, ra, dec, fov_x, fov_y, out_x, out_y, target_scale;
    ``bands`` from :func:`pyramids`. The samples of a request are rows of one task, so
    partial aggregation leaves one row per request to shuffle.
    """
    joined = requests.join(bands, "band").withColumn(
        "output_scale",
        output_scale(
            F.col("target_scale"), F.col("fov_x"), F.col("fov_y"), F.col("out_x"), F.col("out_y"),
            F.array_min(F.transform("levels", lambda l: l["pixel_scale_arcsec"])),
        ),
    )
    chosen = joined.withColumn("z", choose_level(F.col("levels"), F.col("output_scale"), rounding)).withColumn(
        "level", F.get(F.filter("levels", lambda l: l["z"] == F.col("z")), F.lit(0))
    )
    n = max(2, samples)
    keys = ["request_id", "band", "z", "output_scale", "h", "w", "n_tx", "n_ty"]
    every = F.explode(F.sequence(F.lit(0), F.lit(4 * n - 1)))
    points = chosen.select(*keys[:4], "level", "ra", "dec", "fov_x", "fov_y", every.alias("i"))
    sky = perimeter_point(*[F.col(c) for c in ("i", "ra", "dec", "fov_x", "fov_y")], n)
    points = points.select(
        *keys[:4], *["level." + c for c in (*keys[4:], *FIELDS)], sky[0].alias("ra"), sky[1].alias("dec")
    )
    x, y, front = sky_to_pix(Wcs.of(), F.col("ra"), F.col("dec"))
    # Array index of a native position: the pixel whose cell holds it.
    cells = points.select(
        *keys, F.when(front & is_finite(x), F.floor(x)).alias("_x"), F.when(front & is_finite(y), F.floor(y)).alias("_y")
    )
    ends = cells.groupBy(*keys).agg(
        F.min("_x").alias("x0"), F.min("_y").alias("y0"), (F.max("_x") + 1).alias("x1"), (F.max("_y") + 1).alias("y1")
    )
    zero = F.lit(0).cast("long")
    return ends.select(
        "request_id", "band", "z", "output_scale", "n_tx", "n_ty",
        F.greatest(zero, "x0").alias("x0"), F.greatest(zero, "y0").alias("y0"),
        # Without one projected sample the box is empty.
        F.when(F.col("x1").isNull(), zero).otherwise(F.least("w", "x1")).alias("x1"),
        F.when(F.col("y1").isNull(), zero).otherwise(F.least("h", "y1")).alias("y1"),
    )


def covering_tiles(boxes: DataFrame, tile_size: int = grid.TILE_SIZE) -> DataFrame:
    """One row per tile a box touches, row-major; a box that misses the image has none."""

    def span(lo: str, hi: str, n: str) -> Column:
        return F.sequence(
            F.floor(F.col(lo) / tile_size).cast("int"),
            F.least(F.col(n) - 1, F.floor((F.col(hi) - 1) / tile_size)).cast("int"),
        )

    inside = boxes.filter((F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0")))
    rows = inside.select("*", F.explode(span("y0", "y1", "n_ty")).alias("tile_y"))
    return rows.select("*", F.explode(span("x0", "x1", "n_tx")).alias("tile_x"))


def tile_map(supertiles: DataFrame) -> DataFrame:
    """Every stored tile with its supertile and the coordinates local to it.

    Supertiles become equi-join keys here; a range predicate would be a nested-loop join.
    """
    rows = supertiles.select("*", F.explode(F.sequence(F.lit(0), F.col("ny") - 1)).alias("local_y"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("nx") - 1)).alias("local_x"))
    return rows.select(
        "band", "z",
        (F.col("tx0") + F.col("local_x")).alias("tile_x"),
        (F.col("ty0") + F.col("local_y")).alias("tile_y"),
        "idx", "filename", "local_x", "local_y",
    )


def resolve_tiles(wanted: DataFrame, stored: DataFrame) -> DataFrame:
    """Left join of wanted tiles to their supertile; ``missing`` marks a gap."""
    return wanted.join(stored, ["band", "z", "tile_x", "tile_y"], "left").withColumn(
        "missing", F.col("idx").isNull()
    )


def plan_cutouts(
    requests: DataFrame, levels: DataFrame, supertiles: DataFrame, rounding: str = "nearest", tile_size: int = grid.TILE_SIZE
) -> DataFrame:
    """Requests in, the tiles to fetch out."""
    boxes = pixel_box(requests, pyramids(levels), rounding)
    tiles = covering_tiles(boxes, tile_size)
    return resolve_tiles(tiles, tile_map(supertiles)).select(
        "request_id", "band", "z", "output_scale", "x0", "y0", "x1", "y1",
        "tile_x", "tile_y", "idx", "filename", "local_x", "local_y", "missing",
    )


def plan_files(plan: DataFrame) -> DataFrame:
    """Distinct files per request, in the order a row-major walk meets them."""
    first = (
        plan.filter(~F.col("missing"))
        .groupBy("request_id", "filename")
        .agg(F.min(F.struct("tile_y", "tile_x")).alias("_o"))
    )
    return first.groupBy("request_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_o", "filename"))), lambda e: e["filename"]).alias("files")
    )


def plan_byte_ranges(plan: DataFrame, index: DataFrame, gap: int = 0) -> DataFrame:
    """Byte ranges to fetch per request and file. ``index``: filename, local_x, local_y, start, length."""
    hits = plan.filter(~F.col("missing")).join(index, ["filename", "local_x", "local_y"])
    # A supertile file has a bounded number of tiles, and so has a request in it.
    return coalesce_bounded(hits.select("request_id", "filename", "start", "length"), ["request_id", "filename"], gap)


def ancestors(wanted: DataFrame, first: int, max_level: Column | int) -> DataFrame:
    """Each tile's ancestors from ``first`` levels up to ``max_level``, with the step ``k``."""
    top = max_level if isinstance(max_level, Column) else F.lit(max_level)
    steps = F.filter(F.sequence(F.lit(0), F.lit(40)), lambda k: (k >= first) & (F.col("z") + k <= top))
    up = wanted.select(*[F.col(c).alias("_w" + c) if c in ("z", "tile_x", "tile_y") else F.col(c) for c in wanted.columns], F.explode(steps).alias("k"))
    half = F.pow(F.lit(2.0), F.col("k"))
    return up.select(
        "*",
        (F.col("_wz") + F.col("k")).alias("z"),
        F.floor(F.col("_wtile_x") / half).cast("int").alias("tile_x"),
        F.floor(F.col("_wtile_y") / half).cast("int").alias("tile_y"),
    )


def _nearest(found: DataFrame, keys: list[str]) -> DataFrame:
    by = [*keys, "_wz", "_wtile_x", "_wtile_y"]
    # k alone names the ancestor, so the smallest k is all that has to be kept.
    best = found.groupBy(*by).agg(F.min("k").alias("k"))
    half = F.pow(F.lit(2.0), F.col("k"))
    return best.select(
        *keys, F.col("_wz").alias("z"), F.col("_wtile_x").alias("tile_x"), F.col("_wtile_y").alias("tile_y"),
        (F.col("_wz") + F.col("k")).alias("from_z"),
        F.floor(F.col("_wtile_x") / half).cast("int").alias("from_x"),
        F.floor(F.col("_wtile_y") / half).cast("int").alias("from_y"),
    )


def coarser_source(wanted: DataFrame, stored: DataFrame, max_level: Column | int) -> DataFrame:
    """Nearest stored ancestor of each wanted tile (band, z, tile_x, tile_y)."""
    keys = ["band", "z", "tile_x", "tile_y"]
    return _nearest(ancestors(wanted, 1, max_level).join(stored.select(*keys), keys, "left_semi"), ["band"])


def common_level(wanted: DataFrame, stored: DataFrame, bands: int, max_level: Column | int, first: int = 0) -> DataFrame:
    """Finest level, own included, at which all ``bands`` store the tile or its ancestor."""
    keys = ["z", "tile_x", "tile_y"]
    everywhere = stored.select("band", *keys).distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") == bands)
    return _nearest(ancestors(wanted, first, max_level).join(everywhere.select(*keys), keys, "left_semi"), [])


def finer_cover(wanted: DataFrame, stored: DataFrame, max_depth: int = 2) -> DataFrame:
    """Stored descendants at the nearest finer level (at most ``max_depth`` down) that has any."""
    half = F.pow(F.lit(2.0), F.col("k"))
    down = stored.select("band", "z", "tile_x", "tile_y", F.explode(F.sequence(F.lit(1), F.lit(max_depth))).alias("k")).select(
        "band", (F.col("z") + F.col("k")).alias("_wz"),
        F.floor(F.col("tile_x") / half).cast("int").alias("_wx"), F.floor(F.col("tile_y") / half).cast("int").alias("_wy"),
        "k", F.struct(F.col("tile_y").alias("y"), F.col("tile_x").alias("x")).alias("_t"),
    )
    # At most 4**max_depth tiles per wanted tile.
    by_level = down.groupBy("band", "_wz", "_wx", "_wy", "k").agg(F.array_sort(F.collect_list("_t")).alias("tiles"))
    nearest = by_level.groupBy("band", "_wz", "_wx", "_wy").agg(F.min("k").alias("k"))
    pick = by_level.join(nearest, ["band", "_wz", "_wx", "_wy", "k"]).select(
        "band", F.col("_wz").alias("z"), F.col("_wx").alias("tile_x"), F.col("_wy").alias("tile_y"),
        (F.col("_wz") - F.col("k")).alias("from_z"), "tiles",
    )
    return wanted.join(pick, ["band", "z", "tile_x", "tile_y"])


def view_level(zoom: Column, max_level: Column) -> Column:
    """Level whose pixel is about one screen pixel, rounded half up and clamped."""
    z = F.floor(-F.log2(zoom) + 0.5)
    return F.when(zoom > 0, F.greatest(F.lit(0), F.least(max_level, z))).otherwise(max_level).cast("int")


def visible_tiles(views: DataFrame, levels: DataFrame, tile_size: int = grid.TILE_SIZE) -> DataFrame:
    """Tiles each view shows. ``views``: view_id, band, z, box STRUCT<x0, y0, x1, y1> in native pixels."""
    f = F.pow(F.lit(2.0), F.col("z"))
    v = views.join(levels.select("band", "z", "h", "w", "n_ty", "n_tx"), ["band", "z"])
    lo, hi = F.greatest, F.least
    box = v.select(
        "*",
        *[
            e.alias(n)
            for n, e in (
                ("_x0", lo(F.lit(0.0), hi("box.x0", "box.x1"))), ("_x1", hi(F.col("w") * f, lo("box.x0", "box.x1"))),
                ("_y0", lo(F.lit(0.0), hi("box.y0", "box.y1"))), ("_y1", hi(F.col("h") * f, lo("box.y0", "box.y1"))),
            )
        ],
    ).filter((F.col("_x1") > F.col("_x0")) & (F.col("_y1") > F.col("_y0")))
    side = f * tile_size

    def span(a: str, b: str, n: str) -> Column:
        # The far edge is open: a view ending on a tile border does not pull in the next tile.
        return F.sequence(
            F.floor(F.col(a) / side).cast("int"), F.least(F.col(n) - 1, F.floor((F.col(b) - 1e-6) / side)).cast("int")
        )

    rows = box.select("*", F.explode(span("_y0", "_y1", "n_ty")).alias("tile_y"))
    return rows.select("*", F.explode(span("_x0", "_x1", "n_tx")).alias("tile_x")).drop("_x0", "_x1", "_y0", "_y1")
