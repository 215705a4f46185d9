"""Box joins of points as equi-joins on grid cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from starloom.session import materialise

#: Points per cell above which the cell is split over several join keys.
ROWS_PER_SALT = 100_000


def _cell(v: Column, level: Column, cell: float) -> Column:
    return F.floor(v / (F.pow(F.lit(2.0), level) * cell))


def bucketed_join(
    points: DataFrame,
    probes: DataFrame,
    cell: float,
    x: str = "x",
    y: str = "y",
    how: str = "inner",
    rows_per_salt: int = ROWS_PER_SALT,
    also: tuple[str, ...] = (),
) -> DataFrame:
    """Pairs of a point (x, y) and a probe box (x0, y0, x1, y1, inclusive) that contains it and is equal in the columns ``also``.

    Boxes are placed on the grid level (cell * 2**n) at which they span at most two cells
    a side, so a wide region costs four keys, not one per small cell, and narrow ones are
    not widened to the widest. Points are keyed on the levels in use. Cells holding many
    points are split by salt: their points are spread over the salts, their probes repeated.
    """
    extent = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    level = F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(extent, F.lit(cell)) / cell))).cast("int")
    # Probes are used three times below (levels, splitting, join); they are worked out once.
    probes = materialise(probes.withColumn("_lvl", level))
    # The levels in use: a handful of integers (a double spans at most 2100).
    used = sorted(r[0] for r in probes.select("_lvl").distinct().collect())
    used = used or [0]
    keys = ["_lvl", "_cx", "_cy", *also]
    keyed = points.select("*", F.explode(F.array(*[F.lit(n) for n in used])).alias("_lvl"))
    keyed = keyed.withColumn("_cx", _cell(F.col(x), F.col("_lvl"), cell)).withColumn(
        "_cy", _cell(F.col(y), F.col("_lvl"), cell)
    )
    hot = (
        keyed.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_n"))
        .filter(F.col("_n") > rows_per_salt)
        .select(*keys, F.ceil(F.col("_n") / rows_per_salt).cast("int").alias("_salts"))
    )
    # Salted by content, not at random: a task run again after a lost executor must salt alike.
    content = [f.name for f in points.schema.fields if "map<" not in f.dataType.simpleString()]
    salted = (
        keyed.join(hot, keys, "left")
        .withColumn("_salt", F.pmod(F.xxhash64(*content), F.coalesce("_salts", F.lit(1))).cast("int"))
        .drop("_salts")
    )
    boxes = probes.select(
        "*", F.explode(F.sequence(_cell(F.col("x0"), F.col("_lvl"), cell), _cell(F.col("x1"), F.col("_lvl"), cell))).alias("_cx")
    )
    boxes = boxes.select(
        "*", F.explode(F.sequence(_cell(F.col("y0"), F.col("_lvl"), cell), _cell(F.col("y1"), F.col("_lvl"), cell))).alias("_cy")
    )
    boxes = (
        boxes.join(hot, keys, "left")
        .select("*", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1)).alias("_salt"))
        .drop("_salts")
    )
    inside = F.col(x).between(F.col("x0"), F.col("x1")) & F.col(y).between(F.col("y0"), F.col("y1"))
    return salted.join(boxes, [*keys, "_salt"], how).filter(inside).drop("_lvl", "_cx", "_cy", "_salt")


def with_box(df: DataFrame, cx: Column, cy: Column, r: Column) -> DataFrame:
    """x0, y0, x1, y1 around a centre, for a later exact test of the distance.

    Each side lies outward by more than all rounding of that test, so that it never loses a point on the rim.
    """
    slack = lambda c: (F.abs(c) + r) * 2.0**-48 + 2.0**-500
    sides = (("x0", cx - r - slack(cx)), ("y0", cy - r - slack(cy)), ("x1", cx + r + slack(cx)), ("y1", cy + r + slack(cy)))
    return df.select("*", *[e.alias(n) for n, e in sides])


def near_points(points: DataFrame, probes: DataFrame, cell: float) -> DataFrame:
    """Points within ``radius`` of a probe position (qx, qy)."""
    r = F.greatest(F.lit(0.0), F.col("radius"))
    boxes = with_box(probes, F.col("qx"), F.col("qy"), r)
    dx, dy = F.col("x") - F.col("qx"), F.col("y") - F.col("qy")
    return bucketed_join(points, boxes, cell).filter(dx * dx + dy * dy <= r * r).drop("x0", "y0", "x1", "y1")


def extent(points: DataFrame) -> DataFrame:
    """Bounding box, count and grid cell size of a point set; one row.

    The cell starts at sqrt(area / n) and doubles until the grid has at most 2**20 cells;
    NULL when 64 points or fewer, or when they do not spread.
    """
    box = points.agg(
        F.count(F.lit(1)).alias("n"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")
    )
    eps = 2.0**-52
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    start = F.sqrt(F.greatest(w, F.lit(eps)) * F.greatest(h, F.lit(eps)) / F.col("n"))

    def cells(c: Column) -> Column:
        return F.greatest(F.lit(1.0), F.ceil(w / c) + 1.0) * F.greatest(F.lit(1.0), F.ceil(h / c) + 1.0)

    grown = F.aggregate(
        F.sequence(F.lit(1), F.lit(200)), start, lambda c, _: F.when(cells(c) > float(1 << 20), c * 2).otherwise(c)
    )
    return box.withColumn("cell", F.when((F.col("n") > 64) & ((w > 0) | (h > 0)), grown))


# Glyph slack in screen pixels.
HIT_SLOP = 1.0


def glyph_half(size: Column, dpr: Column) -> Column:
    return (size / 2 + HIT_SLOP) * dpr


def topmost_marker(markers: DataFrame, positions: DataFrame, cell: float) -> DataFrame:
    """The last-drawn marker under each position.

    ``markers``: id, ord, x, y, shape, size; ``positions``: pos_id, qx, qy (native), view
    STRUCT<cx, cy, zoom, vw, vh>, m STRUCT<m11..m22>, dpr, max_size. Glyphs are upright
    on screen: a box is a square, anything else a disc of half size (size/2 + 1) * dpr.
    Markers are looked up by size class (powers of two), each with its own reach, so that one
    very large marker widens no box but that of its class.
    """
    classed = lambda size: F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(size, F.lit(1.0))))).cast("int")
    markers = markers.withColumn("_class", classed(F.col("size")))
    positions = positions.select("*", F.explode(F.sequence(F.lit(0), classed(F.col("max_size")))).alias("_class"))
    largest = F.least(F.pow(F.lit(2.0), F.col("_class")), F.greatest(F.col("max_size"), F.lit(1.0)))
    reach = glyph_half(largest, F.col("dpr")) / F.col("view.zoom") * 2.0**0.5
    boxes = with_box(positions.select("pos_id", "qx", "qy", "view", "m", "dpr", "max_size", "_class"), F.col("qx"), F.col("qy"), reach)
    # Markers alike in place and glyph are hit together: the last drawn and their number are enough.
    look = ["x", "y", "shape", "size", "_class"]
    alike = markers.groupBy(*look).agg(F.max("ord").alias("ord"), F.count(F.lit(1)).alias("_alike"))
    near = bucketed_join(alike, boxes, cell, also=("_class",))
    ddx, ddy = (F.col("x") - F.col("qx")) * F.col("view.zoom"), (F.col("y") - F.col("qy")) * F.col("view.zoom")
    sx = F.col("m.m11") * ddx + F.col("m.m12") * ddy
    sy = F.col("m.m21") * ddx + F.col("m.m22") * ddy
    half = glyph_half(F.col("size"), F.col("dpr"))
    hit = F.when(F.col("shape") == "box", (F.abs(sx) <= half) & (F.abs(sy) <= half)).otherwise(sx * sx + sy * sy <= half * half)
    # Numbers only: a hash aggregate that keeps one row a position, where one with texts would sort every hit.
    top = near.filter(hit).groupBy("pos_id").agg(F.max("ord").alias("ord"), F.sum("_alike").alias("hits"))
    named = markers.groupBy("ord").agg(F.max("id").alias("marker"))
    return top.join(named, "ord").select("pos_id", "marker", "hits")
