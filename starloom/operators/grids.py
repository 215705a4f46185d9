"""Which bands share a pixel grid, and summaries over groups of bands."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from starloom.functions import grid
from starloom.functions.let import let, pack
from starloom.functions.wcs import FIELDS, Wcs, separation_deg, sky_at
from starloom.operators.ordering import with_row_number
from starloom.session import materialise

#: Fixed value: how far apart, in pixels of the finer grid, two grids may lie and still match.
MATCH_PIXELS = 0.05
_SHAPE = ["h", "w", "ctype1", "ctype2"]
_GRID = [*_SHAPE, *FIELDS]


def dataset_rows(bands: DataFrame) -> DataFrame:
    """Grid-parameter row of each band from its z = 0 level, with the advisory hash."""
    cd = [F.col(c) for c in ("cd11", "cd12", "cd21", "cd22")]
    hashed = grid.grid_hash(
        F.col("ctype1"), F.col("ctype2"), F.col("h"), F.col("w"),
        F.col("crpix1"), F.col("crpix2"), F.col("crval1"), F.col("crval2"), *cd,
    )
    return bands.filter("z = 0").withColumn("grid_hash", hashed)


def default_rgb(bands: DataFrame, key: str) -> DataFrame:
    """First three bands in order per dataset; none when there are fewer than three."""
    # Three rows per dataset survive: the window limit is pushed below the shuffle.
    first = Window.partitionBy(key).orderBy("ord")
    top = bands.withColumn("_n", F.row_number().over(first)).filter("_n <= 3")
    return (
        top.groupBy(key)
        .agg(*[F.max(F.when(F.col("_n") == i + 1, F.col("band"))).alias(c) for i, c in enumerate("rgb")])
        .filter("b is not null")
    )


def groups_by_hash(bands: DataFrame, key: str) -> DataFrame:
    """Group number of each band: 0 for the grid seen first in its dataset, and so on."""
    first = bands.groupBy(key, "grid_hash").agg(F.min("ord").alias("_first"))
    numbered = with_row_number(first, ["_first", "grid_hash"], "grid_group", [key])
    return bands.join(numbered.drop("_first"), [key, "grid_hash"])


def _matches(a: str, b: str) -> Column:
    """Whether grids with column prefixes ``a`` and ``b`` agree at four corners and the centre."""
    wa, wb = Wcs.of(prefix=a), Wcs.of(prefix=b)
    areas = [grid.pixel_scale_area(w.cd11, w.cd12, w.cd21, w.cd22) for w in (wa, wb)]
    w, h = F.col(a + "w").cast("double"), F.col(a + "h").cast("double")
    zero = F.lit(0.0)
    places = [(zero, zero), (w, zero), (zero, h), (w, h), (w / 2, h / 2)]

    def apart(p: Column) -> Column:
        return let(
            pack(a=sky_at(wa, p["x"], p["y"]), b=sky_at(wb, p["x"], p["y"])),
            lambda s: separation_deg(s["a"]["ra"], s["a"]["dec"], s["b"]["ra"], s["b"]["dec"]),
        )

    worst = F.array_max(F.transform(F.array(*[pack(x=x, y=y) for x, y in places]), apart))
    return worst * 3600.0 <= F.least(*areas) * MATCH_PIXELS


def match_reference(bands: DataFrame, references: DataFrame, key: str) -> DataFrame:
    """Bands of a dataset that share the grid of its reference band (one reference per key).

    Shapes must be equal. Two bands without a projection match; one without does not.
    Axis types compare without regard to case.
    """
    a = bands.select(*[F.col(c).alias("a_" + c) if c in _GRID else F.col(c) for c in bands.columns])
    b = references.select(key, *[F.col(c).alias("b_" + c) for c in _GRID], F.col("band").alias("reference"))
    both = a.join(b, key)
    shape = (F.col("a_h") == F.col("b_h")) & (F.col("a_w") == F.col("b_w"))
    none_a, none_b = F.col("a_crpix1").isNull(), F.col("b_crpix1").isNull()
    types = (F.upper(F.trim("a_ctype1")) == F.upper(F.trim("b_ctype1"))) & (
        F.upper(F.trim("a_ctype2")) == F.upper(F.trim("b_ctype2"))
    )
    ok = F.when(none_a & none_b, shape).when(none_a | none_b, False).otherwise(shape & types & _matches("a_", "b_"))
    return both.select(key, "band", "reference", F.coalesce(ok, F.lit(False)).alias("compatible"))


def _normal(bands: DataFrame) -> DataFrame:
    """Axis types in upper case, and none at all for a band without a projection."""
    none = F.col("crpix1").isNull()
    out = bands
    for c in ("ctype1", "ctype2"):
        out = out.withColumn(c, F.when(~none, F.upper(F.trim(c))))
    return out


def distinct_grids(bands: DataFrame, key: str) -> DataFrame:
    """One row per dataset and exactly equal grid, numbered by its first band."""
    return _normal(bands).groupBy(key, *_GRID).agg(F.min("ord").alias("ord"), F.count(F.lit(1)).alias("members"))


def matching_pairs(grids: DataFrame, key: str) -> DataFrame:
    """Pairs (a_ord < b_ord) of distinct grids of a dataset that match.

    Grids that match have centres within a twentieth of a pixel, so only grids in the same
    or touching cells of about one pixel (in 3-D direction cosines: no seam, no pole) are
    compared, never all grids of one shape.
    """
    w = Wcs.of()
    centre = sky_at(w, F.col("w") / 2.0, F.col("h") / 2.0)
    scale = grid.pixel_scale_area(w.cd11, w.cd12, w.cd21, w.cd22)
    keyed = (
        grids.filter("crpix1 is not null")
        .withColumn("_sky", centre)
        .withColumn("_ra", F.radians("_sky.ra"))
        .withColumn("_dec", F.radians("_sky.dec"))
        .withColumn("_l", F.floor(F.log2(scale)).cast("int"))
    )
    unit = [F.cos("_dec") * F.cos("_ra"), F.cos("_dec") * F.sin("_ra"), F.sin("_dec")]
    arcsec = math.radians(1 / 3600)
    size = F.pow(F.lit(2.0), F.col("_lv")) * arcsec
    reach = F.pow(F.lit(2.0), F.col("_l")) * arcsec * 2 * MATCH_PIXELS
    own = keyed.withColumn("_lv", F.col("_l"))
    # A partner's scale differs by less than a factor of two either way: three cell sizes.
    probe = keyed.select("*", F.explode(F.array(F.col("_l") - 1, F.col("_l"), F.col("_l") + 1)).alias("_lv"))
    cells = ["_c0", "_c1", "_c2"]
    for c, u in zip(cells, unit):
        own = own.withColumn(c, F.floor(u / size))
        probe = probe.withColumn(c, F.explode(F.sequence(F.floor((u - reach) / size), F.floor((u + reach) / size))))
    on = [key, "h", "w", "ctype1", "ctype2", "_lv", *cells]

    def side(df: DataFrame, prefix: str) -> DataFrame:
        return df.select(*on, *[F.col(c).alias(prefix + c) for c in [*FIELDS, "h", "w", "ord"]])

    return (
        side(own, "a_")
        .join(side(probe, "b_"), on)
        .filter(F.col("a_ord") != F.col("b_ord"))
        .filter(_matches("a_", "b_"))
        .select(F.least("a_ord", "b_ord").alias("a_ord"), F.greatest("a_ord", "b_ord").alias("b_ord"))
        .distinct()
    )


def _connected(pairs: DataFrame) -> DataFrame:
    """``ord, part`` of every grid in ``pairs``: the least grid it is connected with. A label spreads to neighbours and to
    the grids that label them, and is then replaced by its own label: rounds grow with the logarithm of a chain."""
    edges = materialise(pairs.unionByName(pairs.select(F.col("b_ord").alias("a_ord"), F.col("a_ord").alias("b_ord"))))
    labels = edges.groupBy(F.col("a_ord").alias("ord")).agg(F.min("b_ord").alias("near")).select("ord", F.least("ord", "near").alias("part"))
    before = None
    while True:
        labels = materialise(labels)
        total = labels.agg(F.sum(F.col("part").cast("decimal(38,0)"))).first()[0]
        if total == before:
            return labels
        before = total
        ends = [labels.select(F.col("ord").alias(o), F.col("part").alias(p)) for o, p in (("a_ord", "_a"), ("b_ord", "_b"))]
        met = edges.join(ends[0], "a_ord").join(ends[1], "b_ord").select(F.explode(F.array("a_ord", "_a")).alias("ord"), "_b")
        spread = met.groupBy("ord").agg(F.min("_b").alias("_near"))
        better = labels.join(spread, "ord").select("ord", F.least("part", "_near").alias("part"))
        labels = better.join(better.select(F.col("ord").alias("part"), F.col("part").alias("_next")), "part").select("ord", F.col("_next").alias("part"))


def _settle(pdf: pd.DataFrame) -> pd.DataFrame:
    """Representatives of one connected part, in order of appearance."""
    earlier: dict[int, list[int]] = {}
    for a, b in zip(pdf.a_ord, pdf.b_ord, strict=True):
        earlier.setdefault(b, []).append(a)
    rep: dict[int, int] = {}
    for o in sorted({*pdf.a_ord, *pdf.b_ord}):
        rep[o] = min((a for a in earlier.get(o, ()) if rep[a] == a), default=o)
    return pd.DataFrame({"ord": list(rep), "rep": list(rep.values())}, dtype="int64")


def representatives(grids: DataFrame, pairs: DataFrame) -> DataFrame:
    """``ord, rep`` of every grid: the earliest earlier representative that it is paired with, else itself."""
    parted = pairs.join(_connected(pairs).select(F.col("ord").alias("a_ord"), "part"), "a_ord")
    settled = parted.groupBy("part").applyInPandas(lambda pdf: _settle(pdf), "ord bigint, rep bigint")
    return grids.join(settled, "ord", "left").select("ord", F.coalesce("rep", "ord").alias("rep"))


def greedy_groups(bands: DataFrame, key: str) -> DataFrame:
    """Each band joins the earliest earlier representative it matches, else starts a group.

    The rule goes by order and the match is not transitive, so it runs along each connected part of the match graph by
    itself: distinct grids that lie within a twentieth of a pixel of a neighbour, however many bands share them.
    ``bands``: key, band, ord (unique) and the grid columns; the result adds ``grid_group``, numbered per
    dataset in order of appearance.
    """
    distinct = materialise(distinct_grids(bands, key))
    pairs = materialise(matching_pairs(distinct, key))
    state = representatives(distinct.select("ord"), pairs)
    of_grid = distinct.drop("members").join(state, "ord").drop("ord")
    numbered = with_row_number(of_grid.select(key, "rep").distinct(), ["rep"], "grid_group", [key])
    of_grid = of_grid.join(numbered, [key, "rep"]).select(
        *[F.col(c).alias("_g_" + c) for c in (key, *_GRID)], "grid_group"
    )
    cond = F.lit(True)
    for c in (key, *_GRID):
        cond = cond & F.col(c).eqNullSafe(F.col("_g_" + c))
    return _normal(bands).join(of_grid, cond).select(key, "band", "ord", "grid_group")


def same_levels(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: whether two pyramids have the same levels, sizes and tile counts."""
    cols = ["h", "w", "n_ty", "n_tx"]
    left = a.select(*keys, "z", *[F.col(c).alias("_a" + c) for c in cols])
    right = b.select(*keys, "z", *[F.col(c).alias("_b" + c) for c in cols])
    same = F.lit(True)
    for c in cols:
        same = same & F.col("_a" + c).eqNullSafe(F.col("_b" + c))
    return left.join(right, [*keys, "z"], "full").groupBy(*keys).agg(F.bool_and(same).alias("same"), F.count(F.lit(1)).alias("levels"))


def group_summary(bands: DataFrame, key: str) -> DataFrame:
    """Per dataset: its largest grid group (the first on ties) and whether any can be composited."""
    sizes = bands.groupBy(key, "grid_group").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("_first"))
    return sizes.groupBy(key).agg(
        F.max_by("grid_group", F.struct(F.col("n"), -F.col("_first"))).alias("largest_group"),
        F.max("n").alias("largest_size"),
        F.bool_or(F.col("n") >= 2).alias("can_composite"),
    )
