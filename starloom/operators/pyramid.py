"""Block-averaged pyramids, supertiles and their checks."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, functions as F

from starloom import kernels
from starloom.functions import grid
from starloom.functions.nan import finite_count, finite_sum, is_finite, mean_or_nan
from starloom.operators.stats import quantisation_tolerance
from starloom.operators.tiles import TILE_COLUMNS
from starloom.session import materialise


def downsample_pixels(pixels: DataFrame, factor: int, dims: DataFrame) -> DataFrame:
    """Mean of finite pixels per factor x factor block; an empty block is NaN.

    ``dims``: band, img_h, img_w. Blocks that do not fill at the high edge are trimmed.
    """
    cut = pixels.join(dims, "band").filter(
        (F.col("x") < F.floor(F.col("img_w") / factor) * factor)
        & (F.col("y") < F.floor(F.col("img_h") / factor) * factor)
    )
    v = F.col("v")
    return (
        cut.groupBy(
            "band",
            F.floor(F.col("y") / factor).cast("int").alias("y"),
            F.floor(F.col("x") / factor).cast("int").alias("x"),
        )
        .agg(finite_sum(v).alias("_s"), finite_count(v).alias("_n"))
        .select("band", "y", "x", mean_or_nan(F.col("_s"), F.col("_n")).alias("v"), F.col("_n").alias("n"))
    )


def build_pyramid(native: DataFrame, tile_size: int = grid.TILE_SIZE, max_level: int = 40) -> DataFrame:
    """All levels of every band, native included, at tile grain.

    One visit to a native tile yields its patch of each of the next log2(tile_size)
    levels, and one shuffle of those patches (a third of the input) assembles them:
    8 levels per round for 256-pixel tiles. Sums and counts, not means, carry over to a
    further round, so every level equals a direct reduction of the native pixels.
    """
    if tile_size & (tile_size - 1):
        raise ValueError("tile_size must be a power of two")
    top = F.least(
        grid.n_downsample_levels(F.col("img_h"), F.col("img_w"), tile_size), F.lit(max_level)
    )
    base = native.select(*TILE_COLUMNS).withColumn("top_z", top)
    levels = base.select(*TILE_COLUMNS)
    depth = tile_size.bit_length() - 1
    # Number of rounds from the largest image: one small aggregate over the tile table.
    deepest = base.agg(F.max("top_z")).first()[0] or 0
    for round_no in range(-(-deepest // depth)):
        patches = base.mapInPandas(
            partial(
                kernels.halve_tiles, tile_size=tile_size, max_level=max_level, with_totals=round_no > 0
            ),
            kernels.PATCH_SCHEMA,
        )
        # A tile of level z has at most 4**z patches of tile_size**2 / 4**z pixels: one tile's worth.
        gathered = patches.groupBy("band", "z", "tile_x", "tile_y", "img_h", "img_w", "top_z").agg(
            F.collect_list(F.struct("oy", "ox", "ph", "pw", "pixels", "sums", "counts")).alias("patches")
        )
        built = gathered.mapInPandas(
            partial(kernels.assemble_tiles, tile_size=tile_size), kernels.CARRY_SCHEMA
        )
        if (round_no + 1) * depth < deepest:
            built = materialise(built)
        levels = levels.unionByName(built.select(*TILE_COLUMNS))
        base = built.filter(F.col("z") == (round_no + 1) * depth)
    return levels


def level_table(dims: DataFrame, tile_size: int = grid.TILE_SIZE) -> DataFrame:
    """One row per band and level: h, w, n_ty, n_tx. ``dims``: band, img_h, img_w."""
    n = grid.n_downsample_levels(F.col("img_h"), F.col("img_w"), tile_size)
    z = F.col("z")
    return (
        dims.select("*", F.explode(F.sequence(F.lit(0), n)).alias("z"))
        .withColumn("h", grid.level_dim(F.col("img_h"), z))
        .withColumn("w", grid.level_dim(F.col("img_w"), z))
        .withColumn("n_ty", grid.tile_count(F.col("h"), tile_size))
        .withColumn("n_tx", grid.tile_count(F.col("w"), tile_size))
    )


def level_wcs(levels: DataFrame) -> DataFrame:
    """Scale native crpix1/2 and cd11..cd22 of each row to its level z."""
    f = F.pow(F.lit(2.0), F.col("z"))
    out = levels
    for name in ("crpix1", "crpix2"):
        out = out.withColumn(name, grid.level_crpix(F.col(name), f))
    for name in ("cd11", "cd12", "cd21", "cd22"):
        out = out.withColumn(name, F.col(name) * f)
    return out.withColumn(
        "pixel_scale_arcsec", grid.pixel_scale_mean(*[F.col(c) for c in ("cd11", "cd12", "cd21", "cd22")])
    )


def level_tiles(levels: DataFrame) -> DataFrame:
    """Every tile of every level."""
    return levels.select(
        "*", F.explode(grid.indices(F.col("n_ty"))).alias("tile_y")
    ).select("*", F.explode(grid.indices(F.col("n_tx"))).alias("tile_x"))


def supertile_blocks(levels: DataFrame, blocks: int = grid.SUPERTILE_BLOCKS) -> DataFrame:
    """Disjoint row-major cover of each level's tile grid by blocks x blocks rectangles."""
    nx = F.ceil(F.col("n_tx") / blocks).cast("int")
    cut = levels.select(
        "*", F.explode(grid.indices(F.col("n_ty"), blocks)).alias("ty0")
    ).select("*", F.explode(grid.indices(F.col("n_tx"), blocks)).alias("tx0"))
    return cut.select(
        "*",
        ((F.col("ty0") / blocks).cast("int") * nx + (F.col("tx0") / blocks).cast("int")).alias("idx"),
        F.least(F.lit(blocks), F.col("n_tx") - F.col("tx0")).alias("nx"),
        F.least(F.lit(blocks), F.col("n_ty") - F.col("ty0")).alias("ny"),
    )


def supertile_filename(stem, levels_single, z, tx0, ty0):
    """``{stem}_z{z}.fits.fz`` for an undivided level, else with the origin appended."""
    return F.when(levels_single, F.concat(stem, F.lit("_z"), z, F.lit(".fits.fz"))).otherwise(
        F.concat(stem, F.lit("_z"), z, F.lit("_"), tx0, F.lit("_"), ty0, F.lit(".fits.fz"))
    )


def supertile_coverage(tiles: DataFrame, blocks: int = grid.SUPERTILE_BLOCKS) -> DataFrame:
    """Finite pixels per supertile, counted inside each tile's array."""
    in_tile = F.size(F.filter("pixels", lambda v: is_finite(v)))
    return (
        tiles.select(
            "band",
            "z",
            grid.supertile_origin(F.col("tile_x"), blocks).alias("tx0"),
            grid.supertile_origin(F.col("tile_y"), blocks).alias("ty0"),
            in_tile.alias("_n"),
        )
        .groupBy("band", "z", "tx0", "ty0")
        .agg(F.sum("_n").alias("n_finite"), F.count(F.lit(1)).alias("n_tiles"))
    )


def drop_empty_supertiles(tiles: DataFrame, blocks: int = grid.SUPERTILE_BLOCKS) -> DataFrame:
    """Tiles of supertiles that hold data; a level keeps its full tile grid regardless."""
    kept = supertile_coverage(tiles, blocks).filter("n_finite > 0").select("band", "z", "tx0", "ty0")
    keyed = tiles.withColumn("tx0", grid.supertile_origin(F.col("tile_x"), blocks)).withColumn(
        "ty0", grid.supertile_origin(F.col("tile_y"), blocks)
    )
    return keyed.join(kept, ["band", "z", "tx0", "ty0"], "left_semi").drop("tx0", "ty0")


def empty_levels(tiles: DataFrame) -> DataFrame:
    """Violations: levels without one finite pixel."""
    return (
        supertile_coverage(tiles)
        .groupBy("band", "z")
        .agg(F.sum("n_finite").alias("n"))
        .filter("n = 0")
        .select(
            F.concat_ws("/", "band", "z").alias("entity"),
            F.lit("empty_level").alias("rule"),
            F.lit("no finite pixel").alias("detail"),
        )
    )


def compare_tiles(original: DataFrame, stored: DataFrame, tolerance: DataFrame) -> DataFrame:
    """Round-trip verdict per band and level.

    The NaN masks must be the same and the largest difference within ``tolerance``
    (band, z, atol; a level without one gets that of noise 0). A tile on one side only fails its level.
    """
    keys = ["band", "z", "tile_x", "tile_y"]
    both = original.select(*keys, F.col("pixels").alias("_a")).join(
        stored.select(*keys, F.col("pixels").alias("_b")), keys, "full"
    )
    pair = F.arrays_zip("_a", "_b")
    same_mask = F.coalesce(
        (F.size("_a") == F.size("_b"))
        & F.forall(pair, lambda p: F.isnan(p["_a"]) == F.isnan(p["_b"])),
        F.lit(False),
    )
    worst = F.array_max(
        F.transform(
            F.filter(pair, lambda p: is_finite(p["_a"]) & is_finite(p["_b"])),
            lambda p: F.abs(p["_a"].cast("double") - p["_b"].cast("double")),
        )
    )
    return (
        both.select(*keys, same_mask.alias("_m"), worst.alias("_e"))
        .groupBy("band", "z")
        .agg(
            F.bool_and("_m").alias("mask_ok"),
            F.coalesce(F.max("_e"), F.lit(0.0)).alias("max_err"),
            F.count(F.lit(1)).alias("n_tiles"),
        )
        .join(tolerance, ["band", "z"], "left")
        .withColumn("atol", F.coalesce("atol", quantisation_tolerance(F.lit(0.0))))
        .withColumn("ok", F.col("mask_ok") & (F.col("max_err") <= F.col("atol")))
    )
