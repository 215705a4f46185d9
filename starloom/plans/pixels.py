"""Queries over pixels and tiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from starloom import kernels
from starloom.functions import grid, stretch as S
from starloom.operators import composite as C, mosaic as M, pyramid as P, quantise as Q, stats as ST, tiles as T
from starloom.plans import domain as D
from starloom.plans.domain import BLOCKS, TILE, num, with_levels_sql
from starloom.plans.registry import big, bigs, query, r, rs
from starloom.session import materialise

NAN = float("nan")


def pyramid(spark: SparkSession, sf: str, max_level: int = 40) -> DataFrame:
    return P.build_pyramid(D.native_tiles(spark, sf), TILE, max_level)


# -- levels ---------------------------------------------------------------------------------------

@query(
    "pyramid_level_2",
    f"""WITH {D.PIXELS_SQL}
SELECT band, (y // 4)::BIGINT AS y, (x // 4)::BIGINT AS x, count(*) FILTER (WHERE NOT isnan(v))::BIGINT AS n,
       {rs("(sum(v::DOUBLE) FILTER (WHERE NOT isnan(v)) / nullif(count(*) FILTER (WHERE NOT isnan(v)), 0))::FLOAT")} AS v
FROM pixels JOIN dims USING (band)
WHERE x < (img_w // 4) * 4 AND y < (img_h // 4) * 4
GROUP BY band, y // 4, x // 4""",
)
def pyramid_level_2(spark, sf):
    out = P.downsample_pixels(D.pixels(spark, sf), 4, D.dims(spark, sf))
    return out.select("band", *big("y", "x", "n"), r("v").alias("v"))


@query(
    "pyramid_all_levels",
    with_levels_sql()
    + f"""
SELECT band, z::BIGINT AS z, (y // (2 ** z)::BIGINT)::BIGINT AS y, (x // (2 ** z)::BIGINT)::BIGINT AS x,
       {rs("(sum(v::DOUBLE) FILTER (WHERE NOT isnan(v)) / nullif(count(*) FILTER (WHERE NOT isnan(v)), 0))::FLOAT")} AS v
FROM pixels JOIN levels USING (band)
WHERE y < h * (2 ** z)::BIGINT AND x < w * (2 ** z)::BIGINT
GROUP BY band, z, y // (2 ** z)::BIGINT, x // (2 ** z)::BIGINT""",
)
def pyramid_all_levels(spark, sf):
    px = T.pixels_from_tiles(pyramid(spark, sf), TILE)
    return px.select("band", *big("z", "y", "x"), r("v").alias("v"))


@query(
    "level_geometry",
    with_levels_sql()
    + f"""
SELECT band, {bigs("z", "h", "w", "n_ty", "n_tx")},
       {rs("((img_w + 1) / 2e0) / (2 ** z) + ((2 ** z) - 1) / (2 * (2 ** z))", 9)} AS crpix1,
       {rs("((img_h + 1) / 2e0) / (2 ** z) + ((2 ** z) - 1) / (2 * (2 ** z))", 9)} AS crpix2,
       {rs(f"{num(D.ARCSEC)} * (2 ** z)", 9)} AS scale_mean,
       {rs(f"{num(D.ARCSEC)} * (2 ** z)", 9)} AS scale_area
FROM levels""",
)
def level_geometry(spark, sf):
    lv = D.level_wcs(spark, sf)
    cd = [F.col(c) for c in ("cd11", "cd12", "cd21", "cd22")]
    return lv.select(
        "band", *big("z", "h", "w", "n_ty", "n_tx"), r("crpix1", 9).alias("crpix1"), r("crpix2", 9).alias("crpix2"),
        r("pixel_scale_arcsec", 9).alias("scale_mean"), r(grid.pixel_scale_area(*cd), 9).alias("scale_area"),
    )


@query(
    "tile_geometry",
    with_levels_sql()
    + f"""
SELECT band, {bigs("z", "tile_x", "tile_y")},
       least({TILE}, w - tile_x * {TILE})::BIGINT AS tile_w, least({TILE}, h - tile_y * {TILE})::BIGINT AS tile_h,
       (tile_x * {TILE})::BIGINT AS x0, least((tile_x + 1) * {TILE}, w)::BIGINT AS x1,
       (tile_y * {TILE} * (2 ** z))::DOUBLE AS world_y0, (least((tile_y + 1) * {TILE}, h) * (2 ** z))::DOUBLE AS world_y1,
       z || '/' || tile_x || '/' || tile_y AS key
FROM (SELECT *, unnest(range(0, n_tx)) AS tile_x FROM (SELECT *, unnest(range(0, n_ty)) AS tile_y FROM levels))""",
)
def tile_geometry(spark, sf):
    t = P.level_tiles(P.level_table(D.dims(spark, sf), TILE))
    b = grid.tile_bounds(F.col("h"), F.col("w"), F.col("tile_x"), F.col("tile_y"), TILE)
    wr = grid.tile_world_rect(F.col("h"), F.col("w"), F.col("z"), F.col("tile_x"), F.col("tile_y"), TILE)
    return t.select(
        "band", *big("z", "tile_x", "tile_y"),
        grid.tile_extent(F.col("w"), F.col("tile_x"), TILE).cast("bigint").alias("tile_w"),
        grid.tile_extent(F.col("h"), F.col("tile_y"), TILE).cast("bigint").alias("tile_h"),
        b["x0"].cast("bigint").alias("x0"), b["x1"].cast("bigint").alias("x1"),
        wr["y0"].alias("world_y0"), wr["y1"].alias("world_y1"),
        grid.tile_key(F.col("z"), F.col("tile_x"), F.col("tile_y")).alias("key"),
    )


@query(
    "supertile_partition",
    with_levels_sql()
    + f"""
SELECT band, {bigs("z", "tx0", "ty0")},
       ((ty0 // {BLOCKS}) * ((n_tx + {BLOCKS - 1}) // {BLOCKS}) + tx0 // {BLOCKS})::BIGINT AS idx,
       least({BLOCKS}, n_tx - tx0)::BIGINT AS nx, least({BLOCKS}, n_ty - ty0)::BIGINT AS ny,
       CASE WHEN n_tx <= {BLOCKS} AND n_ty <= {BLOCKS} THEN band || '_z' || z || '.fits.fz'
            ELSE band || '_z' || z || '_' || tx0 || '_' || ty0 || '.fits.fz' END AS filename,
       {rs(f"((img_w + 1) / 2e0) / (2 ** z) + ((2 ** z) - 1) / (2 * (2 ** z)) - tx0 * {TILE}", 9)} AS crpix1
FROM (SELECT *, unnest(range(0, n_tx, {BLOCKS})) AS tx0 FROM (SELECT *, unnest(range(0, n_ty, {BLOCKS})) AS ty0 FROM levels))""",
)
def supertile_partition(spark, sf):
    s = P.supertile_blocks(D.level_wcs(spark, sf), BLOCKS)
    single = (F.col("n_tx") <= BLOCKS) & (F.col("n_ty") <= BLOCKS)
    return s.select(
        "band", *big("z", "tx0", "ty0", "idx", "nx", "ny"),
        P.supertile_filename(F.col("band"), single, F.col("z"), F.col("tx0"), F.col("ty0")).alias("filename"),
        r(grid.supertile_crpix(F.col("crpix1"), F.col("tx0"), TILE), 9).alias("crpix1"),
    )


def gappy_tiles(spark, sf):
    """Native tiles with every third supertile of b1, and all of b2, without data."""
    hole = (F.col("band") == "b2") | (
        (F.col("band") == "b1")
        & ((F.floor(F.col("tile_y") / BLOCKS) + F.floor(F.col("tile_x") / BLOCKS)) % 3 == 0)
    )
    return D.native_tiles(spark, sf).withColumn("_hole", hole).withColumn(
        "pixels", F.transform("pixels", lambda v: F.when(F.col("_hole"), F.lit(NAN).cast("float")).otherwise(v))
    ).drop("_hole")


GAPPY_SQL = f"""gappy AS (
  SELECT band, y, x, CASE WHEN band = 'b2' OR (band = 'b1' AND (y // {TILE * BLOCKS} + x // {TILE * BLOCKS}) % 3 = 0)
    THEN 'NaN'::FLOAT ELSE v END AS v FROM pixels
)"""


@query(
    "drop_empty_supertiles",
    f"""WITH {D.PIXELS_SQL}, {GAPPY_SQL}
SELECT band, (y // {TILE})::BIGINT AS tile_y, (x // {TILE})::BIGINT AS tile_x,
       count(*) FILTER (WHERE NOT isnan(v))::BIGINT AS n_finite
FROM gappy
WHERE (band, y // {TILE * BLOCKS}, x // {TILE * BLOCKS}) IN (
  SELECT (band, y // {TILE * BLOCKS}, x // {TILE * BLOCKS}) FROM gappy WHERE NOT isnan(v))
GROUP BY ALL""",
)
def drop_empty_supertiles(spark, sf):
    kept = P.drop_empty_supertiles(gappy_tiles(spark, sf), BLOCKS)
    return kept.select(
        "band", *big("tile_y", "tile_x"), F.size(F.filter("pixels", lambda v: ~F.isnan(v))).cast("bigint").alias("n_finite")
    )


@query(
    "empty_levels",
    f"""WITH {D.PIXELS_SQL}, {GAPPY_SQL}
SELECT band || '/0' AS entity, 'empty_level' AS rule, 'no finite pixel' AS detail
FROM gappy GROUP BY band HAVING count(*) FILTER (WHERE NOT isnan(v)) = 0""",
)
def empty_levels(spark, sf):
    return P.empty_levels(gappy_tiles(spark, sf))


# -- statistics -----------------------------------------------------------------------------------

#: The cap that the query of this name asks for; nothing else is capped.
HIST_CAP = 5000


@query(
    "representative_level",
    with_levels_sql()
    + f"""
SELECT band, coalesce(min(z) FILTER (WHERE h * w <= {HIST_CAP}), max(z))::BIGINT AS z FROM levels GROUP BY band""",
)
def representative_level(spark, sf):
    lv = P.level_table(D.dims(spark, sf), TILE)
    return ST.representative_level(lv, HIST_CAP).select("band", *big("z"))


def representative_tiles(spark, sf):
    """Without a cap, the native level."""
    rep = ST.representative_level(P.level_table(D.dims(spark, sf), TILE))
    return D.native_tiles(spark, sf).join(rep, ["band", "z"], "left_semi")


@query(
    "band_histogram",
    with_levels_sql(
        """rpix AS (SELECT band, v::DOUBLE AS v FROM pixels WHERE NOT isnan(v)), q AS (
  SELECT band, quantile_cont(v, 0.001) AS p0, quantile_cont(v, 0.999) AS p1, min(v) AS mn, max(v) AS mx
  FROM rpix GROUP BY band
), dom AS (
  SELECT band, CASE WHEN p1 > p0 THEN p0 ELSE mn END AS lo, CASE WHEN p1 > p0 THEN p1 ELSE mx END AS hi FROM q
), cnt AS (
  SELECT band, least(127, floor((v - lo) / (hi - lo) * 128))::BIGINT AS bin, count(*) AS n
  FROM rpix JOIN dom USING (band) WHERE v >= lo AND v <= hi GROUP BY 1, 2
)""",
    )
    + f"""
SELECT band, bin::BIGINT AS bin, coalesce(n, 0)::BIGINT AS n, {rs("lo", 9)} AS lo, {rs("hi", 9)} AS hi
FROM (SELECT *, unnest(range(0, 128)) AS bin FROM dom WHERE hi > lo) LEFT JOIN cnt USING (band, bin)""",
)
def band_histogram(spark, sf):
    h = ST.band_histogram(representative_tiles(spark, sf))
    return h.select("band", *big("bin", "n"), r("lo", 9).alias("lo"), r("hi", 9).alias("hi"))


PROBS = (0.001, 0.01, 0.25, 0.5, 0.75, 0.99, 0.999)


@query(
    "band_percentiles",
    f"""WITH {D.PIXELS_SQL}
SELECT band, count(*)::BIGINT AS n, {", ".join(f"{rs(f'quantile_cont(v::DOUBLE, {p})', 9)} AS p{i}" for i, p in enumerate(PROBS))}
FROM pixels WHERE NOT isnan(v) GROUP BY band""",
)
def band_percentiles(spark, sf):
    from starloom.operators.ordering import exact_quantiles

    q = exact_quantiles(D.pixels(spark, sf), ["band"], "v", PROBS)
    return q.select("band", *big("n"), *[r(F.col("q")[i], 9).alias(f"p{i}") for i in range(len(PROBS))])


NOISE_SQL = """vpixels AS (SELECT * FROM pixels UNION ALL SELECT 'void', y, x, 'NaN'::FLOAT FROM pixels WHERE band = 'b0'), med AS (
  SELECT band, median(v::DOUBLE) FILTER (WHERE NOT isnan(v)) AS med, count(*) FILTER (WHERE NOT isnan(v)) AS n FROM vpixels GROUP BY band
), noise AS (
  SELECT band, any_value(n) AS n, any_value(med) AS med, coalesce(1.4826e0 * median(abs(v::DOUBLE - med)) FILTER (WHERE NOT isnan(v)), 0e0) AS sigma
  FROM vpixels JOIN med USING (band) GROUP BY band
)"""


def with_void(rows: DataFrame, column: str, nan) -> DataFrame:
    """The bands and a copy of b0 without one finite value."""
    return rows.unionByName(rows.filter("band = 'b0'").withColumn("band", F.lit("void")).withColumn(column, nan))


@query(
    "band_noise",
    f"""WITH {D.PIXELS_SQL}, {NOISE_SQL}
SELECT band, n::BIGINT AS n, {rs("med", 9)} AS median, {rs("sigma", 9)} AS sigma, {rs("2 * greatest(sigma, 1e-6)", 9)} AS atol FROM noise""",
)
def band_noise(spark, sf):
    out = ST.noise(with_void(D.pixels(spark, sf), "v", F.lit(NAN).cast("float")), ["band"])
    return out.select("band", *big("n"), *[r(c, 9).alias(c) for c in ("median", "sigma", "atol")])


SAMPLE_CAP = 6000


def sample_sql(cap: int) -> str:
    return f"""fin AS (
  SELECT band, y // {TILE * BLOCKS} AS sy, x // {TILE * BLOCKS} AS sx, y, x, v::DOUBLE AS v,
         row_number() OVER (PARTITION BY band, y // {TILE * BLOCKS}, x // {TILE * BLOCKS} ORDER BY y, x) - 1 AS rn,
         count(*) OVER (PARTITION BY band, y // {TILE * BLOCKS}, x // {TILE * BLOCKS}) AS n
  FROM pixels WHERE NOT isnan(v)
), quota AS (
  SELECT band, greatest(1, ceil({cap} / count(*)))::BIGINT AS quota FROM (SELECT DISTINCT band, sy, sx FROM fin) GROUP BY band
), sample AS (
  SELECT band, sy, sx, v FROM fin JOIN quota USING (band)
  WHERE rn % (CASE WHEN n > quota THEN n // quota ELSE 1 END) = 0
)"""


@query(
    "quota_sample",
    f"""WITH {D.PIXELS_SQL}, {sample_sql(SAMPLE_CAP)}
SELECT band, (sx * {BLOCKS})::BIGINT AS tx0, (sy * {BLOCKS})::BIGINT AS ty0, {rs("v")} AS v FROM sample""",
)
def quota_sample(spark, sf):
    s = ST.quota_sample(D.native_tiles(spark, sf), TILE, BLOCKS, SAMPLE_CAP)
    return s.select("band", *big("tx0", "ty0"), r("v").alias("v"))


TRILOGY_SQL = f"""sample AS (SELECT band, v::DOUBLE AS v FROM pixels WHERE NOT isnan(v)), tq AS (
  SELECT band, quantile_cont(v, 0.5) AS mean, quantile_cont(v, 0.99) AS p99, quantile_cont(v, 0.999) AS p99_9,
         quantile_cont(v, 0.9999) AS p99_99, quantile_cont(v, 0.99999) AS p99_999 FROM sample GROUP BY band
), tstats AS (
  SELECT tq.*, sigma FROM tq JOIN (
    SELECT band, 1.4826e0 * median(abs(v - mean)) AS sigma FROM sample JOIN tq USING (band) GROUP BY band) USING (band)
  WHERE sigma > 0
)"""


def trilogy(spark, sf):
    return ST.trilogy_stats(ST.quota_sample(D.native_tiles(spark, sf), TILE, BLOCKS))


@query(
    "trilogy_stats",
    f"""WITH {D.PIXELS_SQL}, {TRILOGY_SQL}
SELECT band, {", ".join(f"{rs(c, 9)} AS {c}" for c in ("mean", "sigma", "p99", "p99_9", "p99_99", "p99_999"))} FROM tstats""",
)
def trilogy_stats(spark, sf):
    return trilogy(spark, sf).select("band", *[r(c, 9).alias(c) for c in ("mean", "sigma", "p99", "p99_9", "p99_99", "p99_999")])


def _zscale_sql() -> str:
    """The clipped line fit, its five rounds written out; 1000 values make the rejected ones grow by ten places."""
    steps = [f"""zpos AS (
  SELECT band, v::DOUBLE AS v, row_number() OVER (PARTITION BY band ORDER BY y // {TILE * BLOCKS}, x // {TILE * BLOCKS}, y, x) - 1 AS p, count(*) OVER (PARTITION BY band) AS total
  FROM pixels WHERE NOT isnan(v)
), z0 AS (
  SELECT band, v, row_number() OVER (PARTITION BY band ORDER BY v) - 1 AS i, count(*) OVER (PARTITION BY band) AS n, true AS keep, count(*) OVER (PARTITION BY band) AS kept,
         count(*) OVER (PARTITION BY band) + 1 AS before, 0e0 AS slope
  FROM zpos WHERE p % greatest(1, total // {kernels.Z_SAMPLES}) = 0 AND p // greatest(1, total // {kernels.Z_SAMPLES}) < {kernels.Z_SAMPLES}
)"""]
    for t in range(kernels.Z_ITERATIONS):
        steps.append(f"""f{t} AS (
  SELECT band, avg(i) FILTER (WHERE keep) AS xm, avg(v) FILTER (WHERE keep) AS vm, regr_slope(v, i) FILTER (WHERE keep) AS fitted,
         any_value(kept) < any_value(before) AND any_value(kept) >= greatest({kernels.Z_MIN_PIXELS}, floor(any_value(n) * {kernels.Z_MAX_REJECT})) AS going FROM z{t} GROUP BY band
), r{t} AS (SELECT z.*, going, fitted, v - (vm + fitted * (i - xm)) AS flat FROM z{t} z JOIN f{t} USING (band)
), l{t} AS (SELECT band, {num(kernels.Z_KREJ)} * stddev_pop(flat) FILTER (WHERE keep) AS lim FROM r{t} GROUP BY band
), k{t} AS (SELECT r.*, NOT bool_or(NOT keep OR flat < -lim OR flat > lim) OVER (PARTITION BY band ORDER BY i ROWS BETWEEN 5 PRECEDING AND 4 FOLLOWING) AS stays FROM r{t} r JOIN l{t} USING (band)
), z{t + 1} AS (
  SELECT band, v, i, n, CASE WHEN going THEN stays ELSE keep END AS keep, CASE WHEN going THEN count(*) FILTER (WHERE stays) OVER (PARTITION BY band) ELSE kept END AS kept,
         CASE WHEN going THEN kept ELSE before END AS before, CASE WHEN going THEN fitted ELSE slope END AS slope FROM k{t}
)""")
    last = f"z{kernels.Z_ITERATIONS}"
    return ",\n".join(steps) + f""", cuts AS (
  SELECT band, any_value(kept) >= greatest({kernels.Z_MIN_PIXELS}, floor(any_value(n) * {kernels.Z_MAX_REJECT})) AS fits, min(v) AS lo, max(v) AS hi, median(v) AS med,
         any_value(slope) / {num(kernels.Z_CONTRAST)} AS run, any_value(n) AS n FROM {last} GROUP BY band
), zs AS (
  SELECT band, CASE WHEN fits THEN greatest(lo, med - ((n - 1) // 2 - 1) * run) ELSE lo END AS z1, CASE WHEN fits THEN least(hi, med + (n - (n - 1) // 2) * run) ELSE hi END AS z2 FROM cuts
)"""


@query("zscale", f"""WITH {D.PIXELS_SQL}, {_zscale_sql()} SELECT band, {rs("z1", 9)} AS z1, {rs("z2", 9)} AS z2 FROM zs WHERE z2 > z1""")
def zscale(spark, sf):
    return ST.zscale(representative_tiles(spark, sf), TILE, BLOCKS).select("band", r("z1", 9).alias("z1"), r("z2", 9).alias("z2"))


def view_windows(spark, sf):
    """Views of orders: a band and a small rectangle of native tiles, anywhere in the image."""
    o = D.read(spark, sf, "orders").join(F.broadcast(D.dims(spark, sf).agg((F.max("img_h") / TILE).cast("int").alias("tall"))))  # one row
    return o.select(
        F.col("o_orderkey").alias("view_id"),
        D.band_name(F.col("o_orderkey")).alias("band"),
        (F.col("o_custkey") % 4).cast("int").alias("vx"),
        (F.floor(F.col("o_custkey") / 4) % F.greatest(F.col("tall"), F.lit(1))).cast("int").alias("vy"),
        (F.col("o_orderkey") % 2 + 1).cast("int").alias("nx"),
        (F.floor(F.col("o_orderkey") / 2) % 2 + 1).cast("int").alias("ny"),
    )


VIEWS_SQL = f"""views AS (
  SELECT o_orderkey AS view_id, 'b' || (o_orderkey % 3) AS band, o_custkey % 4 AS vx, (o_custkey // 4) % greatest((SELECT max(img_h) FROM dims) // {TILE}, 1) AS vy,
         o_orderkey % 2 + 1 AS nx, (o_orderkey // 2) % 2 + 1 AS ny FROM orders
), wins AS (SELECT DISTINCT band, vx, vy, nx, ny FROM views), wpix AS (
  SELECT wins.*, p.v::DOUBLE AS v,
         row_number() OVER (PARTITION BY wins.band, vx, vy, nx, ny ORDER BY y // {TILE}, x // {TILE}, y, x) - 1 AS i,
         count(*) OVER (PARTITION BY wins.band, vx, vy, nx, ny) AS total
  FROM wins JOIN pixels p ON p.band = wins.band AND x // {TILE} >= vx AND x // {TILE} < vx + nx AND y // {TILE} >= vy AND y // {TILE} < vy + ny
), wval AS (
  SELECT * FROM wpix WHERE NOT isnan(v)
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY band, vx, vy, nx, ny ORDER BY v) - 1 AS rk,
         count(*) OVER (PARTITION BY band, vx, vy, nx, ny) AS n FROM wval
)"""


def _ranged_sql(lo: float, hi: float) -> str:
    return f"""(SELECT band, vx, vy, nx, ny, any_value(n) AS n,
         max(v) FILTER (WHERE rk = floor({lo} * (n - 1) + 0.5)) AS lo, max(v) FILTER (WHERE rk = floor({hi} * (n - 1) + 0.5)) AS hi
  FROM ranked GROUP BY band, vx, vy, nx, ny HAVING hi > lo)"""


WINDOW = ["vx", "vy", "nx", "ny"]


def window_values(spark, sf):
    """Values of every distinct window: views that look at the same tiles are measured once."""
    wins = view_windows(spark, sf).select("band", *WINDOW).distinct()
    rows = wins.select("*", F.explode(F.sequence(F.col("vy"), F.col("vy") + F.col("ny") - 1)).alias("tile_y")).select(
        "*", F.explode(F.sequence(F.col("vx"), F.col("vx") + F.col("nx") - 1)).alias("tile_x")
    ).withColumn("z", F.lit(0))
    # Stored tiles are what a view is measured on; several passes read them.
    return ST.view_values(rows, materialise(D.native_tiles(spark, sf)), WINDOW)


@query(
    "percentile_range_nearest",
    f"""WITH {D.PIXELS_SQL}, {VIEWS_SQL}
SELECT view_id::BIGINT AS view_id, band, n::BIGINT AS n, {rs("lo")} AS lo, {rs("hi")} AS hi
FROM views JOIN {_ranged_sql(0.01, 0.99)} USING (band, vx, vy, nx, ny)""",
)
def percentile_range_nearest(spark, sf):
    ranges = ST.nearest_rank_range(window_values(spark, sf), [*WINDOW, "band"], 0.01, 0.99)
    out = view_windows(spark, sf).join(ranges, ["band", *WINDOW])
    return out.select(*big("view_id"), "band", *big("n"), r("lo").alias("lo"), r("hi").alias("hi"))


@query(
    "view_histogram",
    f"""WITH {D.PIXELS_SQL}, {VIEWS_SQL}, dom AS {_ranged_sql(0.001, 0.999)}
SELECT band, {bigs(*WINDOW)}, least(31, floor((v - lo) / (hi - lo) * 32))::BIGINT AS bin, count(*)::BIGINT AS n
FROM wval JOIN dom USING (band, vx, vy, nx, ny) WHERE v >= lo AND v <= hi GROUP BY ALL""",
)
def view_histogram(spark, sf):
    keys = [*WINDOW, "band"]
    values = window_values(spark, sf)
    domain = ST.nearest_rank_range(values, keys, *ST.DOMAIN).drop("n")
    return ST.view_histogram(values, domain, keys, 32).select("band", *big(*WINDOW, "bin", "n"))


# -- mosaics --------------------------------------------------------------------------------------

def exposure_strips(spark, sf):
    """Exposure e of a band is rows [40e, 40e + 60), shifted right by e % 3 and brightened by e / 100."""
    rows = D.image_rows(spark, sf)
    first = F.floor(F.col("y") / 40).cast("int")
    which = F.when((F.col("y") % 40 < 20) & (first > 0), F.array(first, first - 1)).otherwise(F.array(first))
    return rows.select("band", "y", "values", F.explode(which).alias("exposure")).select(
        "band", "exposure", (F.col("y") - F.col("exposure") * 40).cast("int").alias("row"),
        F.transform("values", lambda v: (v + F.col("exposure") / F.lit(100.0)).cast("float")).alias("values"),
    )


def exposures(spark, sf):
    e = exposure_strips(spark, sf).groupBy("band", "exposure").agg(
        F.count(F.lit(1)).cast("int").alias("ny"), F.max(F.size("values")).alias("nx")
    )
    return e.select(
        "band", "exposure", F.col("exposure").cast("bigint").alias("ord"), "nx", "ny",
        (F.lit(100.0) - F.col("exposure") % 3).alias("crpix1"), (F.lit(5000.0) - F.col("exposure") * 40).alias("crpix2"),
        F.lit("RA---TAN").alias("ctype1"), F.lit("DEC--TAN").alias("ctype2"),
        # b2 is on a grid of its own.
        (F.when(F.col("band") == "b2", 1.0).otherwise(0.0) + F.lit(D.CRVAL[0])).alias("crval1"),
        *[F.lit(v).alias(c) for c, v in zip(("crval2", "cd11", "cd12", "cd21", "cd22"), (D.CRVAL[1], *D.CD))],
    )


EXPOSURES_SQL = """epix AS (
  SELECT band, e, y - 40 * e AS row, x AS col, (v + e / 100e0)::FLOAT AS v
  FROM (SELECT *, unnest(CASE WHEN y % 40 < 20 AND y // 40 > 0 THEN [y // 40, y // 40 - 1] ELSE [y // 40] END) AS e FROM pixels)
), exps AS (
  SELECT band, e, max(row) + 1 AS ny, max(col) + 1 AS nx, 100 - e % 3 AS crpix1, 5000 - 40 * e AS crpix2 FROM epix GROUP BY band, e
)"""


def placed(spark, sf):
    e = M.with_signature(exposures(spark, sf))
    return M.place(e, M.frames(e))


@query(
    "grid_frames",
    f"""WITH {D.PIXELS_SQL}, {EXPOSURES_SQL}, g AS (SELECT *, band = 'b2' AS sig FROM exps),
fr AS (SELECT sig, max(crpix1) AS r1, max(crpix2) AS r2, count(DISTINCT band) AS nb FROM g GROUP BY sig),
fs AS (SELECT sig, any_value(r1) AS r1, any_value(r2) AS r2, any_value(nb) AS nb, max(r2 - crpix2 + ny) AS h, max(r1 - crpix1 + nx) AS w FROM g JOIN fr USING (sig) GROUP BY sig),
o0 AS (SELECT band, max(crpix1) AS r1, max(crpix2) AS r2 FROM exps GROUP BY band),
own AS (SELECT band, any_value(sig) AS sig, any_value(r1) AS r1, any_value(r2) AS r2, max(r2 - crpix2 + ny) AS h, max(r1 - crpix1 + nx) AS w FROM g JOIN o0 USING (band) GROUP BY band)
SELECT band, (fs.nb >= 2 AND NOT (own.r1 = fs.r1 AND own.r2 = fs.r2 AND own.h = fs.h AND own.w = fs.w)) AS padded,
       CASE WHEN padded THEN fs.h ELSE own.h END::BIGINT AS h, CASE WHEN padded THEN fs.w ELSE own.w END::BIGINT AS w,
       CASE WHEN padded THEN fs.r1 ELSE own.r1 END::DOUBLE AS ref1, CASE WHEN padded THEN fs.r2 ELSE own.r2 END::DOUBLE AS ref2
FROM own JOIN fs USING (sig)""",
)
def grid_frames(spark, sf):
    f = M.frames(M.with_signature(exposures(spark, sf)))
    return f.select("band", "padded", *big("h", "w"), "ref1", "ref2")


@query(
    "mosaic_resolve",
    f"""WITH {D.PIXELS_SQL}, {EXPOSURES_SQL}
SELECT band, y::BIGINT AS y, x::BIGINT AS x, e::BIGINT AS ord, {rs("v")} AS v FROM (
  SELECT band, 40 * e + row AS y, e % 3 + col AS x, e, v,
         row_number() OVER (PARTITION BY band, 40 * e + row, e % 3 + col
           ORDER BY (row - (ny - 1) / 2e0) ** 2 + (col - (nx - 1) / 2e0) ** 2, e) AS rn
  FROM epix JOIN exps USING (band, e)) WHERE rn = 1""",
)
def mosaic_resolve(spark, sf):
    out = M.resolve_overlaps(exposure_strips(spark, sf), placed(spark, sf), TILE)
    return out.select("band", *big("y", "x", "ord"), r("v").alias("v"))


@query(
    "mosaic_tiles",
    f"""WITH {D.PIXELS_SQL}, {EXPOSURES_SQL}, win AS (
  SELECT band, 40 * e + row AS y, e % 3 + col AS x, v,
         row_number() OVER (PARTITION BY band, 40 * e + row, e % 3 + col
           ORDER BY (row - (ny - 1) / 2e0) ** 2 + (col - (nx - 1) / 2e0) ** 2, e) AS rn
  FROM epix JOIN exps USING (band, e)
), fr AS (SELECT band = 'b2' AS sig, max(40 * e + ny) AS h, max(e % 3 + nx) AS w FROM exps GROUP BY 1)
SELECT band, ty::BIGINT AS tile_y, tx::BIGINT AS tile_x, least({TILE}, h - ty * {TILE})::BIGINT AS h, least({TILE}, w - tx * {TILE})::BIGINT AS w,
       count(v) FILTER (WHERE NOT isnan(v))::BIGINT AS n_finite, {rs("coalesce(sum(v::DOUBLE) FILTER (WHERE NOT isnan(v)), 0)")} AS total
FROM (SELECT band, h, w, unnest(range(0, (w + {TILE - 1}) // {TILE})) AS tx, ty FROM (
        SELECT band, h, w, unnest(range(0, (h + {TILE - 1}) // {TILE})) AS ty FROM (SELECT DISTINCT band FROM exps) JOIN fr ON sig = (band = 'b2')))
LEFT JOIN (SELECT band, y // {TILE} AS ty, x // {TILE} AS tx, v FROM win WHERE rn = 1) USING (band, ty, tx)
GROUP BY band, ty, tx, h, w""",
)
def mosaic_tiles(spark, sf):
    e = M.with_signature(exposures(spark, sf))
    frame = M.frames(e)
    t = M.mosaic_tiles(M.resolve_runs(exposure_strips(spark, sf), M.place(e, frame), TILE), frame, TILE)
    good = F.filter("pixels", lambda v: ~F.isnan(v))
    return t.select(
        "band", *big("tile_y", "tile_x", "h", "w"), F.size(good).cast("bigint").alias("n_finite"),
        r(F.aggregate(good, F.lit(0.0), lambda a, v: a + v)).alias("total"),
    )


@query(
    "exposure_tiles",
    f"""WITH {D.PIXELS_SQL}, {EXPOSURES_SQL}
SELECT band, e::BIGINT AS exposure, tx::BIGINT AS tile_x, ty::BIGINT AS tile_y,
       greatest(e % 3, tx * {TILE})::BIGINT AS x0, greatest(40 * e, ty * {TILE})::BIGINT AS y0,
       least(e % 3 + nx, (tx + 1) * {TILE})::BIGINT AS x1, least(40 * e + ny, (ty + 1) * {TILE})::BIGINT AS y1
FROM (SELECT *, unnest(range((e % 3) // {TILE}, (e % 3 + nx - 1) // {TILE} + 1)) AS tx FROM (
  SELECT *, unnest(range((40 * e) // {TILE}, (40 * e + ny - 1) // {TILE} + 1)) AS ty FROM exps))""",
)
def exposure_tiles(spark, sf):
    t = M.exposure_tiles(placed(spark, sf), TILE)
    return t.select("band", *big("exposure", "tile_x", "tile_y", "x0", "y0", "x1", "y1"))


@query(
    "footprint_union",
    f"""WITH {D.PIXELS_SQL}, {EXPOSURES_SQL}
SELECT band, min(e % 3)::BIGINT AS x0, min(40 * e)::BIGINT AS y0, max(e % 3 + nx)::BIGINT AS x1, max(40 * e + ny)::BIGINT AS y1,
       count(*)::BIGINT AS exposures FROM exps GROUP BY band""",
)
def footprint_union(spark, sf):
    return M.footprint_union(placed(spark, sf)).select("band", *big("x0", "y0", "x1", "y1", "exposures"))


@query(
    "placement_checks",
    f"""WITH {D.PIXELS_SQL}, {EXPOSURES_SQL}, bad AS (
  SELECT band, e, ny, nx, crpix2, crpix1 + CASE WHEN e % 5 = 1 THEN -0.5 ELSE 0 END AS crpix1, CASE WHEN e % 7 = 3 THEN 1 ELSE 0 END AS other FROM exps
), ref AS (SELECT other, max(crpix1) AS r1, band FROM bad GROUP BY other, band),
gref AS (SELECT other, band = 'b2' AS sig, max(crpix1) AS r1, max(crpix2) AS r2 FROM bad GROUP BY other, band = 'b2')
SELECT band || '/' || e AS entity, 'grid_signature' AS rule FROM bad WHERE other = 1
UNION ALL
SELECT band || '/' || e, 'integer_phase' FROM bad JOIN gref ON gref.other = bad.other AND gref.sig = (band = 'b2') WHERE abs(gref.r1 - crpix1 - round_even(gref.r1 - crpix1, 0)) > 1e-3""",
)
def placement_checks(spark, sf):
    e = exposures(spark, sf).withColumn("crpix1", F.col("crpix1") - F.when(F.col("exposure") % 5 == 1, 0.5).otherwise(0.0)).withColumn(
        "crval1", F.col("crval1") + F.when(F.col("exposure") % 7 == 3, 0.5).otherwise(0.0)
    )
    e = M.with_signature(e)
    return M.placement_violations(e, M.place(e, M.frames(e))).select("entity", "rule")


# -- quantised tiles ------------------------------------------------------------------------------

DITHER_SQL = f"""lcg(i, seed) AS (
  SELECT 0, {kernels.LCG_A}::BIGINT UNION ALL SELECT i + 1, ({kernels.LCG_A} * seed) % {kernels.LCG_M} FROM lcg WHERE i < {kernels.N_RANDOM - 1}
), rnd AS (SELECT i, (seed / {num(kernels.LCG_M)})::FLOAT AS u FROM lcg)"""


def coded_tiles(spark, sf):
    """Tiles as integers: thousandths of the value, every 50th code an exact zero, NaN as blank."""
    t = D.native_tiles(spark, sf)
    code = lambda v: F.when(F.isnan(v), Q.BLANK).when(F.rint(v * 1000) % 50 == 0, kernels.ZERO_VALUE).otherwise(F.rint(v * 1000)).cast("int")
    return t.select(
        "band", "tile_x", "tile_y", "w", "h", F.transform("pixels", code).alias("q"),
        ((F.col("tile_x") + 1) / F.lit(1000.0)).alias("zscale"), F.lit(0.5).alias("zzero"), F.lit(float(Q.BLANK)).alias("zblank"),
        F.when(F.col("tile_x") % 3 == 0, 2).when(F.col("tile_x") % 3 == 1, 1).otherwise(Q.NO_DITHER).alias("dither_method"),
        F.lit(9990).alias("zdither0"), (F.col("tile_y") * 4 + F.col("tile_x")).alias("tile_index"),
    )


@query(
    "dequantise",
    f"""WITH RECURSIVE {D.PIXELS_SQL}, {DITHER_SQL}, t AS (
  SELECT band, y, x, x // {TILE} AS tx, y // {TILE} AS ty, v::DOUBLE AS v,
         (y % {TILE}) * {TILE} + x % {TILE} AS i, round_even(v::DOUBLE * 1000, 0) AS code FROM pixels
), s AS (
  SELECT t.*, trunc((a.u * 500::FLOAT)::FLOAT)::BIGINT + t.i AS j FROM t JOIN rnd a ON a.i = (ty * 4 + tx + 9990 - 1) % 10000
)
SELECT band, y::BIGINT AS y, x::BIGINT AS x, {rs('''CASE WHEN isnan(v) THEN NULL
   WHEN tx % 3 = 2 THEN (CASE WHEN code % 50 = 0 THEN -2147483646 ELSE code END) * (tx + 1) / 1000e0 + 0.5e0
   WHEN tx % 3 = 0 AND code % 50 = 0 THEN 0
   ELSE ((CASE WHEN code % 50 = 0 THEN -2147483646 ELSE code END) - b.u::DOUBLE + 0.5e0) * ((tx + 1) / 1000e0) + 0.5e0 END::FLOAT''', 5)} AS v
FROM s JOIN rnd b ON b.i = s.j""",
)
def dequantise(spark, sf):
    px = Q.dequantise(coded_tiles(spark, sf)).withColumn("z", F.lit(0))
    return T.pixels_from_tiles(px, TILE).select("band", *big("y", "x"), r("v", 5).alias("v"))


@query(
    "roundtrip_check",
    f"""WITH RECURSIVE {D.PIXELS_SQL}, {NOISE_SQL}, {DITHER_SQL}, t AS (
  SELECT band, y, x, x // {TILE} AS tx, y // {TILE} AS ty, v::DOUBLE AS v, greatest(sigma, 1e-6) / 8 AS zs, 2 * greatest(sigma, 1e-6) AS atol,
         (y % {TILE}) * {TILE} + x % {TILE} AS i FROM vpixels JOIN noise USING (band)
), s AS (
  SELECT t.*, trunc((a.u * 500::FLOAT)::FLOAT)::BIGINT + t.i AS j FROM t JOIN rnd a ON a.i = (ty * 4 + tx) % 10000
), d AS (
  SELECT band, ty, tx, v, atol, band = 'b1' AND ty = 2 AND tx = 1 AS lost,
         CASE WHEN band = 'b2' AND ty = 1 AND tx = 0 AND isnan(v) THEN 5 WHEN v = 0 THEN 0 ELSE ((round_even(v / zs + b.u::DOUBLE - 0.5e0, 0) - b.u::DOUBLE + 0.5e0) * zs)::FLOAT::DOUBLE END AS back
  FROM s JOIN rnd b ON b.i = s.j
)
SELECT band, 0::BIGINT AS z, count(DISTINCT (ty, tx))::BIGINT AS n_tiles, bool_and(isnan(v) = isnan(back) AND NOT lost) AS mask_ok,
       {rs("coalesce(max(abs(v - back)) FILTER (WHERE NOT isnan(v) AND NOT lost), 0)", 5)} AS max_err,
       mask_ok AND coalesce(max(abs(v - back)) FILTER (WHERE NOT isnan(v) AND NOT lost), 0) <= any_value(atol) AS ok
FROM d GROUP BY band""",
)
def roundtrip_check(spark, sf):
    """Bands quantised and read back: one as it is, one with a tile lost, one whose mask changed, one without data."""
    native = with_void(D.native_tiles(spark, sf), "pixels", F.transform("pixels", lambda _: F.lit(NAN).cast("float")))
    noise = materialise(ST.noise(native.select("band", F.explode("pixels").alias("v")), ["band"]))
    keyed = native.join(noise.select("band", "sigma"), "band").withColumn("zscale", Q.quantise_parameters(F.col("sigma"))).drop("sigma")
    keyed = (
        keyed.withColumn("zzero", F.lit(0.0)).withColumn("zblank", F.lit(float(Q.BLANK))).withColumn("dither_method", F.lit(2))
        .withColumn("zdither0", F.lit(1)).withColumn("tile_index", F.col("tile_y") * 4 + F.col("tile_x"))
    )
    back = Q.dequantise(Q.quantise(keyed)).filter("NOT (band = 'b1' AND tile_y = 2 AND tile_x = 1)")
    changed = (F.col("band") == "b2") & (F.col("tile_y") == 1) & (F.col("tile_x") == 0)
    back = back.withColumn("pixels", F.transform("pixels", lambda v: F.when(changed & F.isnan(v), F.lit(5.0).cast("float")).otherwise(v)))
    # The band without data has no tolerance row; its level is judged all the same.
    tol = noise.filter("n > 0").select("band", F.lit(0).alias("z"), "atol")
    out = P.compare_tiles(native, back, tol)
    return out.select("band", *big("z", "n_tiles"), "mask_ok", r("max_err", 5).alias("max_err"), "ok")


# -- display --------------------------------------------------------------------------------------

LO, HI, K = -0.2, 0.3, 50.0
NORM_SQL = f"least(1e0, greatest(0e0, (v::DOUBLE - {num(LO)}) / ({num(HI)} - {num(LO)})))"
CURVES_SQL = {
    "linear": "n",
    "log": "ln(1000e0 * n + 1) / ln(1001e0)",
    "sqrt": "sqrt(n)",
    "asinh": "asinh(n / 0.1e0) / asinh(1 / 0.1e0)",
    "trilogy": f"ln({num(K)} * n + 1) / ln({num(K)} + 1)",
}


@query(
    "stretch_pixels",
    f"""WITH {D.PIXELS_SQL}
SELECT band, y::BIGINT AS y, x::BIGINT AS x, {", ".join(f"{rs(e, 9)} AS s_{m}" for m, e in CURVES_SQL.items())}
FROM (SELECT *, {NORM_SQL} AS n FROM pixels WHERE NOT isnan(v))""",
)
def stretch_pixels(spark, sf):
    px = D.pixels(spark, sf).filter(~F.isnan("v"))
    return px.select(
        "band", *big("y", "x"), *[r(S.scale_value(F.col("v"), F.lit(LO), F.lit(HI), m, K), 9).alias("s_" + m) for m in S.MODES]
    )


@query(
    "colormap_pixels",
    f"""WITH {D.PIXELS_SQL}
SELECT band, y::BIGINT AS y, x::BIGINT AS x, i AS r, i AS g, i AS b
FROM (SELECT *, least(255, floor(sqrt({NORM_SQL}) * 256))::BIGINT AS i FROM pixels WHERE NOT isnan(v))""",
)
def colormap_pixels(spark, sf):
    px = D.pixels(spark, sf)
    out = C.colour_mapped(px, C.gray_lut(spark), S.scale_value(F.col("v"), F.lit(LO), F.lit(HI), "sqrt"))
    return out.select("band", *big("y", "x", "r", "g", "b"))


ROLES = {"r": "b0", "g": "b1", "b": "b2"}
ALIGNED_SQL = """aligned AS (
  SELECT y, x, max(v) FILTER (WHERE band = 'b0' AND NOT isnan(v))::DOUBLE AS r, max(v) FILTER (WHERE band = 'b1' AND NOT isnan(v))::DOUBLE AS g,
         max(v) FILTER (WHERE band = 'b2' AND NOT isnan(v))::DOUBLE AS b FROM pixels GROUP BY y, x
)"""


def _sat_sql(sat: float) -> str:
    return ", ".join(
        f"{rs(f'least(1e0, greatest(0e0, (r + g + b) / 3 + ({c} - (r + g + b) / 3) * {num(sat)}))', 9)} AS out_{c}" for c in "rgb"
    )


def _channel_sql(c: str) -> str:
    n = f"least(1e0, greatest(0e0, ({c} - {num(LO)}) / ({num(HI)} - {num(LO)})))"
    return f"CASE WHEN {c} IS NULL THEN 0 ELSE asinh({n} / 0.1e0) / asinh(1 / 0.1e0) END AS {c}"


@query(
    "rgb_composite",
    f"""WITH {D.PIXELS_SQL}, {ALIGNED_SQL}
SELECT y::BIGINT AS y, x::BIGINT AS x, {_sat_sql(1.3)} FROM (
  SELECT y, x, {", ".join(_channel_sql(c) for c in "rgb")} FROM aligned WHERE r IS NOT NULL OR g IS NOT NULL OR b IS NOT NULL)""",
)
def rgb_composite(spark, sf):
    aligned = C.align_tiles(D.native_tiles(spark, sf), ROLES)
    rng = {c: (F.lit(LO), F.lit(HI)) for c in "rgb"}
    out = C.composite_pixels(C.rgb_composite(aligned, rng, "asinh", 1.3), TILE)
    return out.select(*big("y", "x"), *[r("out_" + c, 9).alias("out_" + c) for c in "rgb"])


@query(
    "align_tiles",
    f"""WITH {D.PIXELS_SQL}, t AS (
  SELECT band, y // {TILE} AS tile_y, x // {TILE} AS tile_x, count(*) AS n FROM pixels GROUP BY ALL
)
SELECT tile_y::BIGINT AS tile_y, tile_x::BIGINT AS tile_x, {", ".join(f"coalesce(max(n) FILTER (WHERE band = '{b}'), 0)::BIGINT AS n_{c}" for c, b in ROLES.items())}
FROM t GROUP BY tile_y, tile_x""",
)
def align_tiles(spark, sf):
    tiles = D.native_tiles(spark, sf)
    out = C.align_tiles(tiles, ROLES, {"n_" + c: F.when(F.col("band") == b, F.size("pixels")) for c, b in ROLES.items()})
    return out.select(*big("tile_y", "tile_x"), *[F.coalesce("n_" + c, F.lit(0)).cast("bigint").alias("n_" + c) for c in ROLES])


def solve_k_sql(name: str, src: str) -> str:
    """CTEs solving k for rows (id, norm1, nl) of ``src``: doubling, then 64 halvings."""
    g = "ln(({k}) * norm1 + 1) / ln(({k}) + 1)"
    at_hi, at_mid = g.format(k="hi"), g.format(k="(lo + hi) / 2")
    return f"""{name}_b AS (
  SELECT id, norm1, nl, 1e0 AS hi, 0 AS i FROM {src}
  UNION ALL SELECT id, norm1, nl, hi * 2, i + 1 FROM {name}_b WHERE {at_hi} < nl AND hi <= 1e30
), {name}_t AS (SELECT id, any_value(norm1) AS norm1, any_value(nl) AS nl, max(hi) AS hi FROM {name}_b GROUP BY id), {name}_h AS (
  SELECT id, norm1, nl, 0e0 AS lo, hi, hi AS top, 0 AS i FROM {name}_t
  UNION ALL SELECT id, norm1, nl, CASE WHEN {at_mid} < nl THEN (lo + hi) / 2 ELSE lo END, CASE WHEN {at_mid} < nl THEN hi ELSE (lo + hi) / 2 END, top, i + 1
  FROM {name}_h WHERE i < 64
), {name} AS (
  SELECT id, CASE WHEN norm1 IS NULL OR NOT (norm1 > 0 AND norm1 < 1) THEN 1000e0 WHEN nl <= norm1 THEN 0e0 WHEN nl >= 1 THEN 1e30
    WHEN top > 1e30 THEN top ELSE (lo + hi) / 2 END AS k FROM {name}_h WHERE i = 64
)"""


TLEVELS_SQL = f"""{TRILOGY_SQL}, tl0 AS (
  SELECT band, mean - 2 * sigma AS x0, mean + sigma AS x1,
         CASE WHEN p99_999 > mean - 2 * sigma THEN p99_999 ELSE mean - 2 * sigma + greatest(sigma, 1e-30) END AS x2 FROM tstats
), tl1 AS (SELECT band AS id, least(0.999e0, greatest(0e0, (x1 - x0) / (x2 - x0))) AS norm1, 0.15e0 AS nl FROM tl0),
{solve_k_sql("tk", "tl1")}, tlev AS (SELECT tl0.*, k FROM tl0 JOIN tk ON id = band)"""


def levels_of(spark, sf):
    t = trilogy(spark, sf)
    tail = F.struct("p99", "p99_9", "p99_99", "p99_999")
    return t.select("band", S.trilogy_levels(F.col("mean"), F.col("sigma"), tail).alias("l")).select("band", "l.*")


@query(
    "trilogy_levels",
    f"""WITH RECURSIVE {D.PIXELS_SQL}, {TLEVELS_SQL}
SELECT band, {rs("x0", 9)} AS x0, {rs("x1", 9)} AS x1, {rs("x2", 9)} AS x2, {rs("k")} AS k FROM tlev""",
)
def trilogy_levels(spark, sf):
    return levels_of(spark, sf).select("band", *[r(c, 9).alias(c) for c in ("x0", "x1", "x2")], r("k").alias("k"))


LUM_SQL = f"""lum0 AS (SELECT avg(x2 - x0) AS sat, avg(x1 - x0) AS noi FROM tlev), lum1 AS (
  SELECT 'v' AS id, CASE WHEN sat > 0 THEN sat ELSE greatest(noi, 1e-30) END AS lsat,
         least(0.999e0, greatest(0e0, noi / CASE WHEN sat > 0 THEN sat ELSE greatest(noi, 1e-30) END)) AS norm1, 0.15e0 AS nl FROM lum0
), {solve_k_sql("lk", "lum1")}"""


@query(
    "luminance_levels",
    f"""WITH RECURSIVE {D.PIXELS_SQL}, {TLEVELS_SQL}, {LUM_SQL}
SELECT 'all' AS view, {rs("lsat", 9)} AS lsat, {rs("k")} AS k FROM lum1 JOIN lk USING (id)""",
)
def luminance_levels(spark, sf):
    out = C.shared_luminance(levels_of(spark, sf).withColumn("view", F.lit("all")), ["view"])
    return out.select("view", r("lsat", 9).alias("lsat"), r("k").alias("k"))


@query(
    "luminance_composite",
    f"""WITH RECURSIVE {D.PIXELS_SQL}, {TLEVELS_SQL}, {LUM_SQL}, {ALIGNED_SQL}, lifted AS (
  SELECT y, x, lsat, k, {", ".join(f"CASE WHEN {c} IS NULL THEN 0e0 ELSE greatest({c} - (SELECT x0 FROM tlev WHERE band = '{b}'), 0e0) END AS {c}" for c, b in ROLES.items())}
  FROM aligned, (SELECT lsat, k FROM lum1 JOIN lk USING (id)) WHERE r IS NOT NULL OR g IS NOT NULL OR b IS NOT NULL
), sc AS (
  SELECT *, (r + g + b) / 3 AS l, CASE WHEN r + g + b > 0 THEN (CASE WHEN k > 0 THEN ln(k * least(1e0, (r + g + b) / 3 / lsat) + 1) / ln(k + 1)
     ELSE least(1e0, (r + g + b) / 3 / lsat) END) / ((r + g + b) / 3) ELSE 0 END AS s FROM lifted
)
SELECT y::BIGINT AS y, x::BIGINT AS x, {", ".join(f"{rs(f'least(1e0, greatest(0e0, {c} * s))')} AS out_{c}" for c in "rgb")} FROM sc""",
)
def luminance_composite(spark, sf):
    lv = materialise(levels_of(spark, sf)).withColumn("view", F.lit(0))
    # A row per band, with the curve that its view shares; tiles take both along.
    knobs = lv.join(C.shared_luminance(lv, ["view"]).withColumnRenamed("k", "shared_k"), "view").select("band", "x0", "lsat", "shared_k")
    carried = {"x0_" + c: F.when(F.col("band") == b, F.col("x0")) for c, b in ROLES.items()} | {"lsat": F.col("lsat"), "shared_k": F.col("shared_k")}
    aligned = C.align_tiles(D.native_tiles(spark, sf).join(knobs, "band"), ROLES, carried)
    out = C.luminance_composite(aligned, {c: F.col("x0_" + c) for c in "rgb"}, F.col("lsat"), F.col("shared_k"))
    return C.composite_pixels(out, TILE).select(*big("y", "x"), *[r("out_" + c).alias("out_" + c) for c in "rgb"])


WEIGHTS = {"b0": (1.0, 0.25, 0.0), "b1": (0.25, 1.0, 0.25), "b2": (0.0, 0.5, 1.0)}
#: Each band stands for so many bands of growing brightness and weight: 15 in all.
COPIES = 5


@query(
    "weighted_composite",
    f"""WITH RECURSIVE {D.PIXELS_SQL}, {TLEVELS_SQL}, wts(band, wr, wg, wb) AS (
  VALUES {", ".join(f"('{b}', {num(w[0])}, {num(w[1])}, {num(w[2])})" for b, w in WEIGHTS.items())}
), copies AS (SELECT band, wr * (j + 1) AS wr, wg * (j + 1) AS wg, wb * (j + 1) AS wb, j FROM wts, range({COPIES}) c(j)), s AS (
  SELECT y, x, wr, wg, wb, CASE WHEN k > 0 THEN ln(k * n + 1) / ln(k + 1) ELSE n END AS s FROM (
    SELECT y, x, wr, wg, wb, k, least(1e0, greatest(0e0, ((v + j / 10e0)::FLOAT::DOUBLE - x0) / (x2 - x0))) AS n
    FROM pixels JOIN tlev USING (band) JOIN copies USING (band) WHERE NOT isnan(v))
)
SELECT y::BIGINT AS y, x::BIGINT AS x,
  {", ".join(f"{rs(f'least(1e0, greatest(0e0, sum({w} * s) / (SELECT sum({w}) FROM copies)))')} AS out_{w[1]}" for w in ("wr", "wg", "wb"))}
FROM s GROUP BY y, x""",
)
def weighted_composite(spark, sf):
    copy = F.explode(F.sequence(F.lit(0), F.lit(COPIES - 1))).alias("j")
    name = F.concat("band", F.lit("_"), F.col("j").cast("string"))
    pick = lambda i: F.element_at(F.create_map(*[x for b, w in WEIGHTS.items() for x in (F.lit(b), F.lit(w[i]))]), F.col("band")) * (F.col("j") + 1)
    lv = levels_of(spark, sf).select("*", copy)
    weighted = lv.select(name.alias("band"), "x0", "x2", "k", *[pick(i).alias(w) for i, w in enumerate(("wr", "wg", "wb"))])
    tiles = D.native_tiles(spark, sf).select("*", copy).withColumn("band", name)
    tiles = tiles.withColumn("pixels", F.transform("pixels", lambda v: (v + F.col("j") / F.lit(10.0)).cast("float")))
    out = C.composite_pixels(C.weighted_composite(tiles, weighted), TILE)
    return out.select(*big("y", "x"), *[r("out_" + c).alias("out_" + c) for c in "rgb"])


HUE_SQL = {"r": 5, "g": 3, "b": 1}


def _hsv_sql(c: str) -> str:
    t = f"(({HUE_SQL[c]} + hue / 60e0) - 6 * floor(({HUE_SQL[c]} + hue / 60e0) / 6))"
    return f"CASE WHEN m = 1 THEN 1e0 ELSE 1 - greatest(0e0, least({t}, 4 - {t}, 1e0)) END"


@query(
    "rainbow_weights",
    f"""WITH bands AS (
  SELECT p_brand AS grp, p_partkey AS ord, 'p' || p_partkey AS band, CASE WHEN p_size % 10 <> 0 THEN p_retailprice / 1000 END AS pivot_um FROM part
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY grp ORDER BY pivot_um IS NULL, pivot_um, ord) - 1 AS i, count(*) OVER (PARTITION BY grp) AS n FROM bands
), slots AS (
  SELECT grp, n, m, unnest(range(0, m)) AS slot FROM (SELECT DISTINCT grp, n, least(12, n) AS m FROM ranked)
), kept AS (
  SELECT grp, m, slot, CASE WHEN m > 1 THEN floor(slot * (n - 1) / (m - 1)::DOUBLE + 0.5)::BIGINT ELSE 0 END AS i,
         CASE WHEN m > 1 THEN 240e0 * (1 - slot / (m - 1)::DOUBLE) ELSE 0e0 END AS hue FROM slots
)
SELECT grp, band, slot::BIGINT AS ord, {", ".join(f"{rs(_hsv_sql(c), 9)} AS w{c}" for c in "rgb")} FROM kept JOIN ranked USING (grp, i)""",
)
def rainbow_weights(spark, sf):
    p = D.read(spark, sf, "part")
    bands = p.select(
        F.col("p_brand").alias("grp"), F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("band"),
        F.when(F.col("p_size") % 10 != 0, F.col("p_retailprice") / 1000).alias("pivot_um"), F.col("p_partkey").alias("ord"),
    )
    out = C.rainbow_weights(bands)
    return out.select("grp", "band", *big("ord"), *[r("w" + c, 9).alias("w" + c) for c in "rgb"])


@query(
    "weight_merge",
    f"""WITH e AS (
  SELECT o_custkey AS view, 'b' || (o_orderkey % 5) AS band, o_orderkey AS ord, (o_orderkey % 7) / 7e0 AS wr, (o_orderkey % 3) / 3e0 AS wg, (o_orderkey % 2)::DOUBLE AS wb FROM orders
)
SELECT view::BIGINT AS view, band, {rs("sum(wr)", 9)} AS wr, {rs("sum(wg)", 9)} AS wg, {rs("sum(wb)", 9)} AS wb, min(ord)::BIGINT AS ord FROM e GROUP BY view, band""",
)
def weight_merge(spark, sf):
    k = F.col("o_orderkey")
    e = D.read(spark, sf, "orders").select(
        F.col("o_custkey").alias("view"), F.concat(F.lit("b"), (k % 5).cast("string")).alias("band"), k.alias("ord"),
        (k % 7 / 7.0).alias("wr"), (k % 3 / 3.0).alias("wg"), (k % 2).cast("double").alias("wb"),
    )
    out = C.merge_weights(e)
    return out.select(*big("view"), "band", *[r(c, 9).alias(c) for c in ("wr", "wg", "wb")], *big("ord"))
