"""Band statistics: histogram, noise, bright tail, display cuts, views.

Every statistic is over all finite values; a ``cap`` that thins them is a parameter whose
default is none. Ranks come from :func:`starloom.operators.ordering.ranked_values`, at any size.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from starloom import kernels
from starloom.functions import grid
from starloom.functions.nan import is_finite
from starloom.operators.ordering import exact_quantiles, ranked_values, with_running_sum
from starloom.operators.tiles import runs_from_tiles
from starloom.session import materialise

# Histogram bins and domain, scale from MAD to sigma.
BINS = 128
DOMAIN = (0.001, 0.999)
MAD_SIGMA = 1.4826
NOISE_FLOOR = 1e-6
TAIL = (0.5, 0.99, 0.999, 0.9999, 0.99999)


def representative_level(levels: DataFrame, cap: int | None = None) -> DataFrame:
    """Per band: the finest level of at most ``cap`` pixels, else the coarsest; without a cap the native level."""
    fits = F.lit(True) if cap is None else F.col("h").cast("long") * F.col("w") <= cap
    return levels.groupBy("band").agg(F.coalesce(F.min(F.when(fits, F.col("z"))), F.max("z")).alias("z"))


def finite_values(tiles: DataFrame) -> DataFrame:
    """band, v for every finite pixel."""
    return tiles.select("band", F.explode(F.filter("pixels", lambda v: is_finite(v))).alias("v"))


def bin_index(v: Column, lo: Column, hi: Column, bins: int = BINS) -> Column:
    """Equal-width bin of v in [lo, hi]; hi falls in the last bin."""
    return F.least(F.lit(bins - 1), F.floor((v - lo) / (hi - lo) * bins)).cast("int")


def band_histogram(tiles: DataFrame, bins: int = BINS) -> DataFrame:
    """band, lo, hi, bin, n over the robust domain of a band's representative tiles.

    Bands with no spread have no rows; empty bins have n = 0.
    """
    values = finite_values(tiles)
    v = F.col("v").cast("double")
    domain = exact_quantiles(values, ["band"], "v", [*DOMAIN, 0.0, 1.0])
    q = F.col("q")
    flat = ~(q[1] > q[0])
    domain = materialise(
        domain.select("band", F.when(flat, q[2]).otherwise(q[0]).alias("lo"), F.when(flat, q[3]).otherwise(q[1]).alias("hi")).filter("hi > lo")
    )
    counts = (
        values.join(domain, "band")
        .filter((v >= F.col("lo")) & (v <= F.col("hi")))
        .groupBy("band", bin_index(v, F.col("lo"), F.col("hi"), bins).alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    every = domain.select("*", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return every.join(counts, ["band", "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def noise(values: DataFrame, keys: list[str]) -> DataFrame:
    """Robust sigma (1.4826 MAD) and quantisation tolerance per key, any group size.

    A key without finite values has a row too: n 0, sigma 0, the least tolerance.
    """
    middle = materialise(exact_quantiles(values, keys, "v", [0.5], empty=True).select(*keys, "n", F.col("q")[0].alias("median")))
    spread = values.join(middle, keys).withColumn("_d", F.abs(F.col("v") - F.col("median")))
    mad = exact_quantiles(spread, keys, "_d", [0.5], empty=True).select(*keys, F.col("q")[0].alias("_mad"))
    return middle.join(mad, keys, "left").select(
        *keys, "n", "median", F.coalesce(F.col("_mad") * MAD_SIGMA, F.lit(0.0)).alias("sigma")
    ).withColumn("atol", quantisation_tolerance(F.col("sigma")))


def quantisation_tolerance(sigma: Column) -> Column:
    return F.greatest(F.coalesce(sigma, F.lit(0.0)), F.lit(NOISE_FLOOR)) * 2


def quota_sample(
    native: DataFrame, tile_size: int, blocks: int = grid.SUPERTILE_BLOCKS, cap: int | None = None
) -> DataFrame:
    """About ``cap`` finite native values per band, the same number from every supertile; all without a cap.

    Every (n div quota)-th finite value of a supertile in row-major order. Positions come
    from a running count over image-row runs (256 pixels each), never over pixels.
    """
    keys = ["band", "tx0", "ty0"]
    if cap is None:
        origin = [grid.supertile_origin(F.col(c), blocks).alias(n) for c, n in (("tile_x", "tx0"), ("tile_y", "ty0"))]
        return native.select("band", *origin, F.explode(F.filter("pixels", lambda v: is_finite(v))).alias("v"))
    runs = runs_from_tiles(native, tile_size).select(
        "band",
        grid.supertile_origin(F.col("tile_x"), blocks).alias("tx0"),
        grid.supertile_origin(F.col("tile_y"), blocks).alias("ty0"),
        "tile_x",
        "y",
        F.filter("values", lambda v: is_finite(v)).alias("vals"),
    )
    counted = runs.select(*keys, "tile_x", "y", F.size("vals").cast("long").alias("_n"))
    # A supertile has at most blocks**2 * tile_size runs (590 000 for the defaults).
    before = Window.partitionBy(*keys).orderBy("y", "tile_x").rowsBetween(Window.unboundedPreceding, -1)
    starts = counted.select(
        *keys,
        "tile_x",
        "y",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_at"),
        F.sum("_n").over(Window.partitionBy(*keys)).alias("_total"),
    )
    tiles_of = counted.groupBy(*keys).agg(F.count(F.lit(1)).alias("_r"))
    quota = tiles_of.groupBy("band").agg(
        F.greatest(F.lit(1), F.ceil(F.lit(cap) / F.count(F.lit(1)))).cast("long").alias("_quota")
    )
    stride = F.when(
        F.col("_total") > F.col("_quota"), F.floor(F.col("_total") / F.col("_quota"))
    ).otherwise(F.lit(1)).cast("long")
    kept = (
        runs.join(starts, [*keys, "tile_x", "y"])
        .join(quota, "band")
        .withColumn("_stride", stride)
        .withColumn("_kept", F.filter("vals", lambda v, i: (F.col("_at") + i) % F.col("_stride") == 0))
    )
    return kept.select("band", "tx0", "ty0", F.explode("_kept").alias("v"))


def trilogy_stats(sample: DataFrame) -> DataFrame:
    """Sky level, noise and bright tail per band; no row for a band without spread."""
    tail = materialise(exact_quantiles(sample, ["band"], "v", TAIL).select("band", F.col("q").alias("_p")))
    spread = sample.join(tail, "band").select("band", F.abs(F.col("v").cast("double") - F.col("_p")[0]).alias("_d"))
    mad = exact_quantiles(spread, ["band"], "_d", [0.5]).select("band", F.col("q")[0].alias("_mad"))
    names = ("mean", "p99", "p99_9", "p99_99", "p99_999")
    return tail.join(mad, "band").select(
        "band",
        *[F.col("_p")[i].alias(n) for i, n in enumerate(names)],
        (F.col("_mad") * MAD_SIGMA).alias("sigma"),
    ).filter("sigma > 0")


def zscale(tiles: DataFrame, tile_size: int, blocks: int = grid.SUPERTILE_BLOCKS) -> DataFrame:
    """Display cuts z1, z2 per band from a strided sample of at most 1000 finite values.

    The sample is the definition's own. Its order is that of supertiles row-major, then pixels row-major inside
    each; positions come from a running count over image-row runs, dealt by range, so a band of any size will do.
    """
    runs = runs_from_tiles(tiles, tile_size).select(
        "band",
        grid.supertile_origin(F.col("tile_y"), blocks).alias("ty0"),
        grid.supertile_origin(F.col("tile_x"), blocks).alias("tx0"),
        "y",
        "tile_x",
        F.filter("values", lambda v: is_finite(v)).alias("vals"),
    )
    sized = runs.withColumn("_size", F.size("vals"))
    totals = sized.groupBy("band").agg(F.sum("_size").alias("_n"))
    placed = with_running_sum(sized, ["band"], ["ty0", "tx0", "y", "tile_x"], "_size", "_at").join(totals, "band")
    stride = F.greatest(F.lit(1), F.floor(F.col("_n") / kernels.Z_SAMPLES)).cast("long")
    sample = placed.withColumn("_s", stride).select(
        "band",
        "_s",
        F.explode(
            F.filter(
                F.transform("vals", lambda v, i: F.struct((F.col("_at") + i).alias("p"), v.alias("v"))),
                lambda e: e["p"] % F.col("_s") == 0,
            )
        ).alias("e"),
    ).filter(F.col("e.p") / F.col("_s") < kernels.Z_SAMPLES).select("band", F.col("e.v").alias("v"))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        cuts = kernels.zscale_limits(pdf.v.to_numpy())
        rows = [] if cuts is None else [(pdf.band.iloc[0], *cuts)]
        return pd.DataFrame(rows, columns=["band", "z1", "z2"])

    return sample.groupBy("band").applyInPandas(fit, "band string, z1 double, z2 double")


def view_values(windows: DataFrame, tiles: DataFrame, keys: list[str], cap: int | None = None) -> DataFrame:
    """Finite values of the tiles of each view; with a ``cap``, thinned to it by a fixed stride.

    ``windows``: keys, band, z, tile_x, tile_y, one row per tile of a view. The stride
    counts every pixel, finite or not, over the tiles in row-major order; so it is worked
    out from tile sizes alone before any pixel is touched.
    """
    by = [*keys, "band"]
    if cap is None:
        shown = windows.join(tiles.select("band", "z", "tile_x", "tile_y", "pixels"), ["band", "z", "tile_x", "tile_y"])
        return shown.select(*by, F.explode(F.filter("pixels", lambda v: is_finite(v))).alias("v"))
    size = F.col("w").cast("long") * F.col("h")
    sized = windows.join(tiles.select("band", "z", "tile_x", "tile_y", "w", "h"), ["band", "z", "tile_x", "tile_y"])
    order = Window.partitionBy(*by).orderBy("tile_y", "tile_x").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn("_at", F.coalesce(F.sum(size).over(order), F.lit(0))).withColumn(
        "_all", F.sum(size).over(Window.partitionBy(*by))
    )
    stride = F.when(F.col("_all") > cap, F.ceil(F.col("_all") / cap)).otherwise(F.lit(1)).cast("long")
    pixels = placed.withColumn("_s", stride).drop("w", "h").join(
        tiles.select("band", "z", "tile_x", "tile_y", "pixels"), ["band", "z", "tile_x", "tile_y"]
    )
    kept = F.filter(
        F.filter("pixels", lambda v, i: (F.col("_at") + i) % F.col("_s") == 0), lambda v: is_finite(v)
    )
    return pixels.select(*by, F.explode(kept).alias("v"))


def nearest_rank_range(values: DataFrame, keys: list[str], lo: float, hi: float) -> DataFrame:
    """Nearest-rank percentile pair per key; no row when the range collapses."""
    rank = [F.floor(F.lit(p) * (F.col("n") - 1) + 0.5) for p in (lo, hi)]
    found = ranked_values(values, keys, "v", F.array(*rank))
    at = [F.try_element_at("at", x.cast("bigint")).alias(name) for x, name in zip(rank, ("lo", "hi"), strict=True)]
    return found.select(*keys, *at, "n").filter("hi > lo")


def view_histogram(values: DataFrame, domain: DataFrame, keys: list[str], bins: int = BINS) -> DataFrame:
    """keys, bin, n over each key's given domain; only bins that hold values."""
    v = F.col("v").cast("double")
    return (
        values.join(domain, keys)
        .filter((v >= F.col("lo")) & (v <= F.col("hi")))
        .groupBy(*keys, bin_index(v, F.col("lo"), F.col("hi"), bins).alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def stats_violations(stats: DataFrame) -> DataFrame:
    """Published-statistics rules. ``stats``: name, stats STRUCT<histogram, zscale, trilogy>."""
    inf = float("inf")

    def bad_number(c: Column) -> Column:
        return c.isNull() | F.isnan(c) | (F.abs(c) == inf)

    h, z, t = F.col("stats.histogram"), F.col("stats.zscale"), F.col("stats.trilogy")
    fields = [t["mean"], t["sigma"], *[t[p] for p in ("p99", "p99_9", "p99_99", "p99_999")]]
    bad_trilogy = fields[0].isNull() & F.lit(False)
    for f in fields:
        bad_trilogy = bad_trilogy | bad_number(f)
    checks = [
        ("histogram_counts", h.isNull() | (F.size(h["counts"]) <= 0) | F.exists(h["counts"], lambda c: bad_number(c.cast("double")))),
        ("histogram_domain", bad_number(h["lo"]) | bad_number(h["hi"]) | ~(h["hi"] > h["lo"])),
        ("zscale", z.isNotNull() & ((F.size(z) != 2) | F.exists(z, bad_number) | ~F.coalesce(F.get(z, F.lit(1)) > F.get(z, F.lit(0)), F.lit(False)))),
        ("trilogy", t.isNotNull() & bad_trilogy),
    ]
    hits = F.filter(
        F.array(*[F.when(F.coalesce(test, F.lit(True)), F.lit(rule)) for rule, test in checks]), lambda r: r.isNotNull()
    )
    return stats.filter("stats is not null").select(F.col("name").alias("entity"), F.explode(hits).alias("rule"))
