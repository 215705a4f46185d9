"""Conversions between row strips, tiles and pixels.

Tiles are the storage grain: ``band, z, tile_x, tile_y, w, h, img_h, img_w, pixels``
with ``pixels`` row-major float32 and ``img_h, img_w`` the native image size, carried
so no later step has to look it up. Pixels are exploded only to be aggregated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from starloom.functions import grid

TILE_COLUMNS = ["band", "z", "tile_x", "tile_y", "w", "h", "img_h", "img_w", "pixels"]


def tiles_from_rows(rows: DataFrame, tile_size: int = grid.TILE_SIZE) -> DataFrame:
    """``rows``: band, img_h, img_w, y, values ARRAY<FLOAT> (one full image row each) -> tiles at z = 0.

    Each row is cut into tile-wide runs and the runs of a tile are joined in order of y;
    pixels are never exploded. A tile gathers at most ``tile_size`` runs.
    """
    runs = rows.select(
        "band",
        "img_h",
        "img_w",
        F.floor(F.col("y") / tile_size).cast("int").alias("tile_y"),
        "y",
        F.posexplode(
            F.transform(
                F.sequence(F.lit(0), grid.tile_count(F.col("img_w"), tile_size) - 1),
                lambda t: F.slice("values", t * tile_size + 1, F.lit(tile_size)),
            )
        ).alias("tile_x", "run"),
    )
    gathered = runs.groupBy("band", "img_h", "img_w", "tile_y", "tile_x").agg(
        F.array_sort(F.collect_list(F.struct("y", "run"))).alias("runs")
    )
    return gathered.select(
        "band",
        F.lit(0).alias("z"),
        "tile_x",
        "tile_y",
        grid.tile_extent(F.col("img_w"), F.col("tile_x"), tile_size).alias("w"),
        grid.tile_extent(F.col("img_h"), F.col("tile_y"), tile_size).alias("h"),
        "img_h",
        "img_w",
        F.flatten(F.transform("runs", lambda r: r["run"])).alias("pixels"),
    )


def pixels_from_tiles(tiles: DataFrame, tile_size: int = grid.TILE_SIZE) -> DataFrame:
    """One row per pixel: band, z, y, x, v."""
    flat = tiles.select("band", "z", "tile_x", "tile_y", "w", F.posexplode("pixels").alias("i", "v"))
    return flat.select(
        "band",
        "z",
        (F.col("tile_y") * tile_size + F.floor(F.col("i") / F.col("w"))).cast("int").alias("y"),
        (F.col("tile_x") * tile_size + F.col("i") % F.col("w")).cast("int").alias("x"),
        "v",
    )


def runs_from_tiles(tiles: DataFrame, tile_size: int = grid.TILE_SIZE) -> DataFrame:
    """One row per image row of each tile: band, z, tile_x, tile_y, y, values."""
    return tiles.select(
        "band",
        "z",
        "tile_x",
        "tile_y",
        "w",
        F.posexplode(
            F.transform(
                F.sequence(F.lit(0), F.col("h") - 1),
                lambda r: F.slice("pixels", r * F.col("w") + 1, F.col("w")),
            )
        ).alias("_r", "values"),
    ).select(
        "band", "z", "tile_x", "tile_y", (F.col("tile_y") * tile_size + F.col("_r")).alias("y"), "values"
    )


def point_sample(points: DataFrame, tiles: DataFrame, levels: DataFrame, x: str, y: str, tile_size: int) -> DataFrame:
    """Value of every band at native positions, at each point's level ``z``.

    ``points`` has id, z and the position columns; ``levels`` one row per (band, z) with
    h, w. NULL: outside the grid or tile not stored. NaN: no data there.
    """
    located = points.join(levels.select("band", "z", "h", "w"), "z").withColumn(
        "_at",
        grid.world_to_tile_index(F.col(x), F.col(y), F.col("z"), F.col("h"), F.col("w"), tile_size),
    )
    located = located.withColumn("tile_x", F.col("_at.tile_x")).withColumn("tile_y", F.col("_at.tile_y"))
    hit = tiles.select("band", "z", "tile_x", "tile_y", "pixels")
    return (
        located.join(hit, ["band", "z", "tile_x", "tile_y"], "left")
        .withColumn("value", F.get("pixels", F.col("_at.index")))
        .drop("pixels", "_at", "tile_x", "tile_y", "h", "w")
    )
