"""Placing overlapping exposures of one grid onto a shared pixel frame."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from starloom.functions import grid

#: Fixed value: how far from a whole pixel an offset may lie and still be placed.
PHASE_TOL = 1e-3
_WCS = ("ctype1", "ctype2", "crval1", "crval2", "cd11", "cd12", "cd21", "cd22")


def with_signature(exposures: DataFrame) -> DataFrame:
    return exposures.withColumn("signature", grid.grid_signature(*[F.col(c) for c in _WCS]))


def frames(exposures: DataFrame) -> DataFrame:
    """Shared frame per grid signature and each band's own footprint.

    ``exposures``: band, exposure, ord, nx, ny, crpix1, crpix2, signature. The reference
    pixel is the largest CRPIX of the group, the extent its farthest placed corner. A
    band gets the shared frame when two or more bands share the signature and its own
    footprint differs; otherwise it keeps its own.
    """

    def footprint(by: list[str], prefix: str) -> DataFrame:
        ref = exposures.groupBy(*by).agg(
            F.max("crpix1").alias("_r1"), F.max("crpix2").alias("_r2")
        )
        return (
            exposures.join(ref, by)
            .groupBy(*by, F.col("_r1").alias(prefix + "ref1"), F.col("_r2").alias(prefix + "ref2"))
            .agg(
                F.max(F.rint(F.col("_r2") - F.col("crpix2")) + F.col("ny")).cast("int").alias(prefix + "h"),
                F.max(F.rint(F.col("_r1") - F.col("crpix1")) + F.col("nx")).cast("int").alias(prefix + "w"),
                F.count_distinct("band").alias(prefix + "bands"),
            )
        )

    shared = footprint(["signature"], "frame_")
    own = footprint(["signature", "band"], "own_").drop("own_bands")
    same = (
        (F.abs(F.col("own_ref1") - F.col("frame_ref1")) <= PHASE_TOL)
        & (F.abs(F.col("own_ref2") - F.col("frame_ref2")) <= PHASE_TOL)
        & (F.col("own_h") == F.col("frame_h"))
        & (F.col("own_w") == F.col("frame_w"))
    )
    use = (F.col("frame_bands") >= 2) & ~same
    return own.join(shared, "signature").select(
        "signature",
        "band",
        use.alias("padded"),
        *[F.when(use, F.col("frame_" + c)).otherwise(F.col("own_" + c)).alias(c) for c in ("ref1", "ref2", "h", "w")],
    )


def place(exposures: DataFrame, frame: DataFrame) -> DataFrame:
    """Offset of each exposure in its band's frame, with the fractional part kept."""
    return exposures.join(frame, ["signature", "band"]).select(
        *[exposures[c] for c in exposures.columns],
        "ref1", "ref2", "h", "w",
        (F.col("ref1") - F.col("crpix1")).alias("ox_f"),
        (F.col("ref2") - F.col("crpix2")).alias("oy_f"),
        F.rint(F.col("ref1") - F.col("crpix1")).cast("int").alias("ox"),
        F.rint(F.col("ref2") - F.col("crpix2")).cast("int").alias("oy"),
    )


def placement_violations(exposures: DataFrame, placed: DataFrame) -> DataFrame:
    """Exposures that cannot be placed: foreign grid in a band, sub-pixel phase, outside the frame."""
    entity = F.concat_ws("/", "band", "exposure")
    # The first exposure of a band sets its signature; one small row per band is compared with.
    first = exposures.groupBy("band").agg(F.min_by("signature", "ord").alias("_sig"))
    foreign = exposures.join(first, "band").filter(F.col("signature") != F.col("_sig")).select(
        entity.alias("entity"), F.lit("grid_signature").alias("rule"), F.col("signature").alias("detail")
    )
    phase = placed.filter(
        (F.abs(F.col("ox_f") - F.col("ox")) > PHASE_TOL) | (F.abs(F.col("oy_f") - F.col("oy")) > PHASE_TOL)
    ).select(
        entity.alias("entity"),
        F.lit("integer_phase").alias("rule"),
        F.format_string("%.4f,%.4f", "ox_f", "oy_f").alias("detail"),
    )
    outside = placed.filter(
        (F.col("ox") < 0)
        | (F.col("oy") < 0)
        | (F.col("oy") + F.col("ny") > F.col("h"))
        | (F.col("ox") + F.col("nx") > F.col("w"))
    ).select(
        entity.alias("entity"),
        F.lit("outside_frame").alias("rule"),
        F.concat_ws(",", "ox", "oy").alias("detail"),
    )
    return foreign.unionByName(phase).unionByName(outside)


def exposure_tiles(placed: DataFrame, tile_size: int = grid.TILE_SIZE) -> DataFrame:
    """Which frame tiles each exposure touches, and the rectangle it covers there."""

    def span(o: str, n: str):
        return F.sequence(
            F.floor(F.col(o) / tile_size).cast("int"),
            F.floor((F.col(o) + F.col(n) - 1) / tile_size).cast("int"),
        )

    t = placed.select("band", "exposure", "ord", "ox", "oy", "nx", "ny", F.explode(span("oy", "ny")).alias("tile_y"))
    t = t.select("*", F.explode(span("ox", "nx")).alias("tile_x"))
    return t.select(
        "band", "exposure", "ord", "tile_x", "tile_y",
        F.greatest(F.col("ox"), F.col("tile_x") * tile_size).alias("x0"),
        F.greatest(F.col("oy"), F.col("tile_y") * tile_size).alias("y0"),
        F.least(F.col("ox") + F.col("nx"), (F.col("tile_x") + 1) * tile_size).alias("x1"),
        F.least(F.col("oy") + F.col("ny"), (F.col("tile_y") + 1) * tile_size).alias("y1"),
    )


def _nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of one image row of one tile, laid over each other: each pixel from the exposure whose centre is nearest."""
    for batch in batches:
        values, ords = [], []
        for x0, width, runs in zip(*(batch.column(i).to_pylist() for i in (4, 5, 6)), strict=True):
            near = np.full(width, np.iinfo(np.int64).max)
            v = np.full(width, np.nan, np.float32)
            o = np.full(width, -1, np.int64)
            for run in sorted(runs, key=lambda r: r["ord"]):
                at = run["x"] - x0
                line = np.array(run["values"], np.float32)
                # Four times the squared distance: whole numbers, as offsets are whole pixels.
                far = (2 * (run["col"] + np.arange(len(line), dtype=np.int64)) - (run["nx"] - 1)) ** 2 + run["dy2"]
                span = slice(at, at + len(line))
                won = far < near[span]
                near[span] = np.where(won, far, near[span])
                v[span] = np.where(won, line, v[span])
                o[span] = np.where(won, run["ord"], o[span])
            values.append(v)
            ords.append(o)
        yield pa.RecordBatch.from_arrays(
            [*[batch.column(i) for i in range(6)], pa.array(values, pa.list_(pa.float32())), pa.array(ords, pa.list_(pa.int64()))],
            ["band", "tile_y", "tile_x", "y", "x0", "w", "values", "ords"],
        )


def resolve_runs(strips: DataFrame, placed: DataFrame, tile_size: int = grid.TILE_SIZE) -> DataFrame:
    """Covered rows of frame tiles: band, tile_y, tile_x, y, x0, w, values, ords (-1: nothing placed there).

    ``strips``: band, exposure, row, values (one image row each). Each pixel has the value of the exposure whose centre
    is nearest; the earlier exposure wins ties, and a NaN of the winner stays NaN. Strips are cut at tile borders and
    meet by row of a tile: a group holds one run for each exposure of the stack there.
    """
    on_frame = strips.join(placed.select("band", "exposure", "ord", "ox", "oy", "nx", "ny", F.col("w").alias("frame_w")), ["band", "exposure"])
    first, last = F.floor(F.col("ox") / tile_size), F.floor((F.col("ox") + F.size("values") - 1) / tile_size)
    cut = on_frame.filter(F.size("values") > 0).select(
        "band", "ord", "ox", "nx", "frame_w", "values", (F.col("oy") + F.col("row")).cast("int").alias("y"),
        F.pow(2 * F.col("row").cast("bigint") - (F.col("ny") - 1), 2).cast("bigint").alias("dy2"),
        F.explode(F.sequence(first.cast("int"), last.cast("int"))).alias("tile_x"),
    )
    col = F.greatest(F.lit(0), F.col("tile_x") * tile_size - F.col("ox"))
    length = F.least(F.size("values"), (F.col("tile_x") + 1) * tile_size - F.col("ox")) - col
    runs = cut.select(
        "band", F.floor(F.col("y") / tile_size).cast("int").alias("tile_y"), "tile_x", "y", "frame_w",
        F.struct(
            "ord", (F.col("ox") + col).alias("x"), col.alias("col"), F.col("nx").cast("int").alias("nx"), "dy2",
            F.slice("values", (col + 1).cast("int"), length.cast("int")).alias("values"),
        ).alias("run"),
    )
    gathered = runs.groupBy("band", "tile_y", "tile_x", "y", "frame_w").agg(F.collect_list("run").alias("runs")).select(
        "band", "tile_y", "tile_x", "y", (F.col("tile_x") * tile_size).alias("x0"), grid.tile_extent(F.col("frame_w"), F.col("tile_x"), tile_size).cast("int").alias("w"), "runs"
    )
    return gathered.mapInArrow(_nearest, "band string, tile_y int, tile_x int, y int, x0 int, w int, values array<float>, ords array<bigint>")


def resolve_overlaps(strips: DataFrame, placed: DataFrame, tile_size: int = grid.TILE_SIZE) -> DataFrame:
    """One row per covered frame pixel: band, y, x, v, ord of the exposure it is from."""
    runs = resolve_runs(strips, placed, tile_size)
    flat = runs.select("band", "y", "x0", F.posexplode(F.arrays_zip("values", "ords")).alias("i", "p")).filter("p.ords >= 0")
    return flat.select("band", "y", (F.col("x0") + F.col("i")).cast("int").alias("x"), F.col("p.values").alias("v"), F.col("p.ords").alias("ord"))


def mosaic_tiles(runs: DataFrame, frame: DataFrame, tile_size: int = grid.TILE_SIZE) -> DataFrame:
    """All tiles of each band's frame from :func:`resolve_runs`, NaN where nothing was placed. A tile gathers ``tile_size`` rows at most."""
    gathered = runs.groupBy("band", "tile_y", "tile_x").agg(F.map_from_entries(F.collect_list(F.struct("y", "values"))).alias("_rows"))
    tall = F.sequence(F.lit(0), grid.tile_count(F.col("h"), tile_size) - 1)
    wide = F.sequence(F.lit(0), grid.tile_count(F.col("w"), tile_size) - 1)
    every = frame.select("band", F.col("h").alias("img_h"), F.col("w").alias("img_w"), F.explode(tall).alias("tile_y"), wide.alias("_wide")).select("*", F.explode("_wide").alias("tile_x"))
    sized = every.withColumn("w", grid.tile_extent(F.col("img_w"), F.col("tile_x"), tile_size).cast("int")).withColumn(
        "h", grid.tile_extent(F.col("img_h"), F.col("tile_y"), tile_size).cast("int")
    )
    blank = F.array_repeat(F.lit(float("nan")).cast("float"), F.col("w"))
    lines = F.transform(F.sequence(F.lit(0), F.col("h") - 1), lambda i: F.coalesce(F.try_element_at("_rows", F.col("tile_y") * tile_size + i), blank))
    return sized.join(gathered, ["band", "tile_y", "tile_x"], "left").select(
        "band", F.lit(0).alias("z"), "tile_x", "tile_y", "w", "h", "img_h", "img_w", F.flatten(lines).alias("pixels")
    )


def footprint_union(placed: DataFrame) -> DataFrame:
    """Bounding box of all exposures per band, in frame pixels."""
    return placed.groupBy("band").agg(
        F.min("ox").alias("x0"),
        F.min("oy").alias("y0"),
        F.max(F.col("ox") + F.col("nx")).alias("x1"),
        F.max(F.col("oy") + F.col("ny")).alias("y1"),
        F.count(F.lit(1)).alias("exposures"),
    )
