"""Per-pixel stretches and colour composites of co-gridded bands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from starloom import kernels
from starloom.functions import stretch as S
from starloom.functions.let import let, pack

NAN = float("nan")


def align_tiles(tiles: DataFrame, roles: dict[str, str], carried: dict[str, Column] | None = None) -> DataFrame:
    """Tiles of the chosen bands side by side: z, tile_x, tile_y, w, h and an array per role.

    One grouped pass over tiles, no pixel exploded. A band without the tile is NaN there.
    ``carried`` names values of a tile's row to keep: the largest of each.
    """
    picked = tiles.filter(F.col("band").isin(*set(roles.values())))
    arrays = [F.max(F.when(F.col("band") == b, F.col("pixels"))).alias(r) for r, b in roles.items()]
    more = [F.max(c).alias(n) for n, c in (carried or {}).items()]
    # Bands of one grid have one width; a band that ends higher up just has fewer rows in its last tiles.
    gathered = picked.groupBy("z", "tile_x", "tile_y", "w").agg(F.max("h").alias("h"), *arrays, *more)
    blank = F.array_repeat(F.lit(NAN).cast("float"), F.col("w") * F.col("h"))
    return gathered.withColumns({r: F.coalesce(r, blank) for r in roles})


def composite_pixels(composites: DataFrame, tile_size: int) -> DataFrame:
    """z, y, x and the three channels of the pixels that have data: the last step, for display or comparison."""
    flat = composites.select("z", "tile_x", "tile_y", "w", F.posexplode("out").alias("i", "o")).filter("o.shown")
    return flat.select(
        "z",
        (F.col("tile_y") * tile_size + F.floor(F.col("i") / F.col("w"))).cast("int").alias("y"),
        (F.col("tile_x") * tile_size + F.col("i") % F.col("w")).cast("int").alias("x"),
        *[F.col("o." + c).alias("out_" + c) for c in "rgb"],
    )


def _has_data(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c)


def _shown(channels, shown: Column) -> Column:
    return F.struct(*[v.cast("double").alias(c) for c, v in zip("rgb", channels, strict=True)], shown.alias("shown"))


def _over_pixels(aligned: DataFrame, body) -> DataFrame:
    """``out``: ARRAY of struct(r, g, b, shown), ``body`` of the three values at each pixel."""
    out = F.transform(F.arrays_zip("r", "g", "b"), body)
    return aligned.select("z", "tile_x", "tile_y", "w", "h", out.alias("out"))


def _any_data(p: Column) -> Column:
    return _has_data(p["r"]) | _has_data(p["g"]) | _has_data(p["b"])


def rgb_composite(
    aligned: DataFrame, ranges: dict[str, tuple[Column, Column]], mode: str, saturation: float = 1.0
) -> DataFrame:
    """Each channel stretched over its own range; NaN is 0; not shown where all three are NaN. Tiles in, tiles out."""

    def body(p: Column) -> Column:
        chans = [F.when(_has_data(p[c]), S.scale_value(p[c], *ranges[c], mode)).otherwise(0.0) for c in "rgb"]
        if saturation == 1.0:
            return _shown(chans, _any_data(p))
        return let(pack(**dict(zip("rgb", chans))), lambda q: _shown(S.saturate(q["r"], q["g"], q["b"], saturation), _any_data(p)))

    return _over_pixels(aligned, body)


def luminance_composite(
    aligned: DataFrame, black: dict[str, Column], lsat: Column, k: Column, saturation: float = 1.0
) -> DataFrame:
    """Colour-preserving composite: subtract black points, stretch the mean, scale all three alike. Tiles in, tiles out."""

    def body(p: Column) -> Column:
        lifted = {c: F.when(_has_data(p[c]), F.greatest(p[c].cast("double") - black[c], F.lit(0.0))).otherwise(0.0) for c in "rgb"}

        def scaled(q: Column) -> Column:
            lum = (q["r"] + q["g"] + q["b"]) / 3
            scale = F.when(lum > 0, S.trilogy_curve(S.clamp01(lum / lsat), k) / lum).otherwise(0.0)
            return let(scale, lambda s: _shown(S.saturate(*[S.clamp01(q[c] * s) for c in "rgb"], saturation), _any_data(p)))

        return let(pack(**lifted), scaled)

    return _over_pixels(aligned, body)


def weighted_composite(tiles: DataFrame, weighted: DataFrame, saturation: float = 1.0) -> DataFrame:
    """Weighted mean of trilogy-stretched bands per channel. Tiles in, tiles out.

    ``weighted``: band, x0, x2, k, wr, wg, wb, one row for each band of the view, however many. A NaN band adds nothing
    but its weight stays in the divisor; a channel without weight is 0; a pixel where every stored band is NaN is not
    shown. Sums of whole tiles are formed before the shuffle and added up after it; no tile gathers its bands.
    """
    whole = Window.partitionBy()  # a row per band of one view
    named = weighted.withColumns({"_t" + c: F.sum(c).over(whole) for c in ("wr", "wg", "wb")})
    knobs = ["x0", "x2", "k", "wr", "wg", "wb", "_twr", "_twg", "_twb"]
    joined = tiles.join(named, "band").select("z", "tile_x", "tile_y", "w", "h", *[F.col(c).cast("double").alias(c) for c in knobs], "pixels")
    partial = joined.mapInArrow(kernels.weighted_sums, kernels.SUMS_SCHEMA)
    dealt = partial.repartition("z", "tile_x", "tile_y").sortWithinPartitions("z", "tile_x", "tile_y")
    sums = dealt.mapInArrow(kernels.added_sums, kernels.SUMS_SCHEMA)

    def finished(a: Column) -> Column:
        chans = [F.when(F.col("t" + c) > 0, S.clamp01(a[c] / F.col("t" + c))).otherwise(0.0) for c in "rgb"]
        return _shown(S.saturate(*chans, saturation), a["shown"])

    return sums.select("z", "tile_x", "tile_y", "w", "h", F.transform(F.arrays_zip("r", "g", "b", "shown"), finished).alias("out"))


def colour_mapped(pixels: DataFrame, lut: DataFrame, scaled: Column, size: int = 256) -> DataFrame:
    """Pixels through a lookup table (``i, r, g, b``, ``size`` rows); NaN pixels have no row.

    A value whose row the table lacks keeps its pixel, without a colour.
    """
    return pixels.filter(~F.isnan("v")).withColumn("i", S.lut_index(scaled, size)).join(lut, "i", "left").drop("i")


def gray_lut(spark, size: int = 256) -> DataFrame:
    i = F.col("id").cast("int")
    return spark.range(size).select(i.alias("i"), i.alias("r"), i.alias("g"), i.alias("b"))


def lut_from_bytes(spark, rgb: bytes) -> DataFrame:
    """A lookup table from row-major RGB bytes."""
    if not rgb or len(rgb) % 3:
        raise ValueError("a lookup table needs a positive multiple of 3 bytes")
    rows = [(i, *rgb[3 * i : 3 * i + 3]) for i in range(len(rgb) // 3)]
    return spark.createDataFrame(rows, "i int, r int, g int, b int")


def shared_luminance(levels: DataFrame, keys: list[str], noiselum: float = S.NOISELUM) -> DataFrame:
    """lsat and k of a view from the x0, x1, x2 of its channels."""
    return (
        levels.groupBy(*keys)
        .agg(
            F.avg(F.col("x2") - F.col("x0")).alias("_sat"), F.avg(F.col("x1") - F.col("x0")).alias("_noise")
        )
        .select(*keys, S.luminance_levels(F.col("_sat"), F.col("_noise"), noiselum).alias("_l"))
        .select(*keys, "_l.lsat", "_l.k")
    )


def merge_weights(entries: DataFrame) -> DataFrame:
    """Sum the RGB weights of a band named more than once in a view; first place is kept."""
    return entries.groupBy("view", "band").agg(
        F.sum("wr").alias("wr"), F.sum("wg").alias("wg"), F.sum("wb").alias("wb"), F.min("ord").alias("ord")
    )


def rainbow_weights(bands: DataFrame, most: int | None = S.MAX_BANDS) -> DataFrame:
    """Hue-spread weights of each group's bands, bluest 240 to reddest 0 degrees.

    ``bands``: grp, band, pivot_um, ord. Bands without wavelength come last in their given
    order; more than ``most`` (the rule's 12; none: all stay) are thinned evenly, both ends kept. Rank and size of a group are
    worked out by range, so one large group is no single task's burden.
    """
    from starloom.operators.ordering import with_row_number

    keyed = bands.withColumn("_none", F.col("pivot_um").isNull())
    ranked = with_row_number(keyed, ["_none", "pivot_um", "ord"], "i", ["grp"])
    sizes = ranked.groupBy("grp").agg(F.count(F.lit(1)).alias("n"))
    m = F.col("m")
    slots = sizes.withColumn("m", (F.col("n") if most is None else F.least(F.lit(most), F.col("n"))).cast("int")).select(
        "grp", "n", "m", F.explode(F.sequence(F.lit(0), m - 1)).alias("slot")
    )
    place = F.when(m > 1, F.floor(F.col("slot") * (F.col("n") - 1) / (m - 1) + 0.5)).otherwise(F.lit(0))
    kept = slots.withColumn("i", place.cast("long")).join(ranked, ["grp", "i"])
    hue = F.when(m > 1, (1 - F.col("slot") / (m - 1)) * 240.0).otherwise(F.lit(0.0))
    rgb = S.hsv_to_rgb(hue, F.lit(1.0), F.lit(1.0))
    white = m == 1
    return kept.withColumn("_c", rgb).select(
        "grp", "band", F.col("slot").alias("ord"),
        *[F.when(white, 1.0).otherwise(F.col("_c")[c]).alias("w" + c) for c in "rgb"],
    )
