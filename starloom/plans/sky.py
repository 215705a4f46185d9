"""Queries over sky positions, grids, cutout requests, catalogs and regions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from starloom.functions import grid, polygon as G, skytext as X, wcs as K
from starloom.operators import catalog as CAT, cutout as CUT, grids as GR, pyramid as P, regions as REG, spatial as SP, tiles as T
from starloom.plans import domain as D
from starloom.plans.domain import BLOCKS, LEVELS_SQL, TILE, num, with_levels_sql
from starloom.plans.pixels import pyramid
from starloom.plans.registry import big, bigs, query, r, rs

CRPIX = (32.5, 84.0)
WCS_VALUES = dict(zip(K.FIELDS, (*CRPIX, *D.CRVAL, *D.CD, 180.0)))
W_SQL = {k: num(v) for k, v in WCS_VALUES.items()}


def fixed_wcs() -> K.Wcs:
    return K.Wcs(*[F.lit(v) for v in WCS_VALUES.values()])


def pix_to_sky_sql(x: str, y: str, w: dict[str, str] = W_SQL) -> tuple[str, str]:
    """The textbook form: native spherical coordinates, then the rotation to the sky."""
    u, v = f"({x} + 0.5 - {w['crpix1']})", f"({y} + 0.5 - {w['crpix2']})"
    px, py = f"({w['cd11']} * {u} + {w['cd12']} * {v})", f"({w['cd21']} * {u} + {w['cd22']} * {v})"
    phi = f"(atan2({px}, -{py}) - radians({w['lonpole']}))"
    theta = f"atan2(degrees(1e0), sqrt({px} * {px} + {py} * {py}))"
    dp = f"radians({w['crval2']})"
    sind = f"(sin({theta}) * sin({dp}) + cos({theta}) * cos({dp}) * cos({phi}))"
    ry = f"(-cos({theta}) * sin({phi}))"
    rx = f"(sin({theta}) * cos({dp}) - cos({theta}) * sin({dp}) * cos({phi}))"
    return f"({w['crval1']} + degrees(atan2({ry}, {rx})))", f"degrees(atan2({sind}, sqrt({rx} * {rx} + {ry} * {ry})))"


def sky_to_pix_sql(ra: str, dec: str, w: dict[str, str] = W_SQL) -> tuple[str, str]:
    da, d, dp = f"radians({ra} - {w['crval1']})", f"radians({dec})", f"radians({w['crval2']})"
    a = f"(-cos({d}) * sin({da}))"
    b = f"(sin({d}) * cos({dp}) - cos({d}) * sin({dp}) * cos({da}))"
    st = f"(sin({d}) * sin({dp}) + cos({d}) * cos({dp}) * cos({da}))"
    phi = f"(radians({w['lonpole']}) + atan2({a}, {b}))"
    rr = f"(degrees(sqrt({a} * {a} + {b} * {b})) / {st})"
    px, py = f"({rr} * sin({phi}))", f"(-{rr} * cos({phi}))"
    det = f"({w['cd11']} * {w['cd22']} - {w['cd12']} * {w['cd21']})"
    u = f"(({w['cd22']} * {px} - {w['cd12']} * {py}) / {det})"
    v = f"(({w['cd11']} * {py} - {w['cd21']} * {px}) / {det})"
    return f"({u} + {w['crpix1']} - 0.5)", f"({v} + {w['crpix2']} - 0.5)"


def sep_sql(ra1, dec1, ra2, dec2) -> str:
    sd, sr = f"sin(radians({dec2} - {dec1}) / 2)", f"sin(radians({ra2} - {ra1}) / 2)"
    return f"degrees(2 * asin(least(1e0, sqrt({sd} * {sd} + cos(radians({dec1})) * cos(radians({dec2})) * {sr} * {sr}))))"


def catalog(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as sources: sky position, flux, a style."""
    k = F.col("c_custkey")
    return D.read(spark, sf, "customer").select(
        F.concat(F.lit("s"), k.cast("string")).alias("id"), k.alias("ord"),
        (k * 37 % 1000 / 10000.0 + 150.0).alias("ra"), (k * 91 % 1000 / 10000.0 + 2.2).alias("dec"),
        (k * 13 % 640 / 10.0).alias("px"), (k * 29 % 1670 / 10.0).alias("py"),
        F.col("c_acctbal").alias("flux"), F.col("c_nationkey").alias("nation"),
    )


CAT_SQL = """cat AS (
  SELECT 's' || c_custkey AS id, c_custkey AS ord, c_custkey * 37 % 1000 / 10000e0 + 150e0 AS ra, c_custkey * 91 % 1000 / 10000e0 + 2.2e0 AS dec,
         c_custkey * 13 % 640 / 10e0 AS px, c_custkey * 29 % 1670 / 10e0 AS py, c_acctbal AS flux, c_nationkey AS nation FROM customer
)"""


# -- positions ------------------------------------------------------------------------------------

_ra, _dec = pix_to_sky_sql("px", "py")


@query("pix_to_sky", f"WITH {CAT_SQL} SELECT id, {rs(_ra, 9)} AS sky_ra, {rs(_dec, 9)} AS sky_dec FROM cat")
def pix_to_sky(spark, sf):
    ra, dec = K.pix_to_sky(fixed_wcs(), F.col("px"), F.col("py"))
    return catalog(spark, sf).select("id", r(ra, 9).alias("sky_ra"), r(dec, 9).alias("sky_dec"))


_x, _y = sky_to_pix_sql("ra", "dec")


@query("sky_to_pix", f"WITH {CAT_SQL} SELECT id, {rs(_x)} AS x, {rs(_y)} AS y, true AS front FROM cat")
def sky_to_pix(spark, sf):
    x, y, front = K.sky_to_pix(fixed_wcs(), F.col("ra"), F.col("dec"))
    return catalog(spark, sf).select("id", r(x).alias("x"), r(y).alias("y"), front.alias("front"))


WIDE_SQL = """wide AS (
  SELECT c_custkey AS k, (c_custkey * 7919 % 360000) / 1000e0 AS ra1, (c_custkey * 104729 % 179000) / 1000e0 - 89.5e0 AS dec1,
         (c_custkey * 15485863 % 360000) / 1000e0 AS ra2, (c_custkey * 32452843 % 179000) / 1000e0 - 89.5e0 AS dec2 FROM customer
)"""


def wide_positions(spark, sf):
    k = F.col("c_custkey")
    return D.read(spark, sf, "customer").select(
        k.alias("k"), (k * 7919 % 360000 / 1000.0).alias("ra1"), (k * 104729 % 179000 / 1000.0 - 89.5).alias("dec1"),
        (k * 15485863 % 360000 / 1000.0).alias("ra2"), (k * 32452843 % 179000 / 1000.0 - 89.5).alias("dec2"),
    )


_pa = "degrees(atan2(cos(radians(dec2)) * sin(radians(ra2 - ra1)), cos(radians(dec1)) * sin(radians(dec2)) - sin(radians(dec1)) * cos(radians(dec2)) * cos(radians(ra2 - ra1))))"


@query(
    "separation_pa",
    f"""WITH {WIDE_SQL} SELECT k::BIGINT AS k, {rs(sep_sql('ra1', 'dec1', 'ra2', 'dec2'), 8)} AS sep,
  {rs(f'CASE WHEN {_pa} < 0 THEN ({_pa} + 360) % 360 ELSE {_pa} END', 8)} AS pa FROM wide""",
)
def separation_pa(spark, sf):
    a = [F.col(c) for c in ("ra1", "dec1", "ra2", "dec2")]
    return wide_positions(spark, sf).select(
        *big("k"), r(K.separation_deg(*a), 8).alias("sep"), r(K.position_angle_deg(*a), 8).alias("pa")
    )


_r1, _d1 = pix_to_sky_sql("px", "py")
_r2, _d2 = pix_to_sky_sql("(px + 3)", "(py + 4 + ord % 5)")


@query(
    "ruler",
    f"""WITH {CAT_SQL}, e AS (SELECT *, {_r1} AS ra1, {_d1} AS dec1, {_r2} AS ra2, {_d2} AS dec2 FROM cat)
SELECT id, {rs('sqrt(9 + (4 + ord % 5) ** 2)', 9)} AS pixel_dist, {rs(sep_sql('ra1', 'dec1', 'ra2', 'dec2'), 9)} AS sep,
       {rs(f'CASE WHEN {_pa} < 0 THEN ({_pa} + 360) % 360 ELSE {_pa} END')} AS pa FROM e""",
)
def ruler(spark, sf):
    m = K.ruler(fixed_wcs(), F.col("px"), F.col("py"), F.col("px") + 3, F.col("py") + 4 + F.col("ord") % 5)
    return catalog(spark, sf).select("id", m.alias("m")).select(
        "id", r("m.pixel_dist", 9).alias("pixel_dist"), r("m.sep_deg", 9).alias("sep"), r("m.pa_deg").alias("pa")
    )


def _sexa_sql(v: str, decimals: int) -> str:
    return f"""SELECT k, w + co AS w, m2 - 60 * co AS m, s2 AS s FROM (
    SELECT *, CASE WHEN m2 >= 60 THEN 1 ELSE 0 END AS co FROM (
      SELECT *, m + CASE WHEN s >= 60 THEN 1 ELSE 0 END AS m2, s - CASE WHEN s >= 60 THEN 60 ELSE 0 END AS s2 FROM (
        SELECT *, floor((a - w - m / 60e0) * 3600 * {10 ** decimals} + 0.5) / {10 ** decimals}e0 AS s FROM (
          SELECT *, floor((a - w) * 60) AS m FROM (SELECT k, a, floor(a) AS w FROM (SELECT k, abs({v}) AS a FROM wide))))))"""


@query(
    "format_coords",
    f"""WITH {WIDE_SQL}, rr AS ({_sexa_sql("ra1 / 15", 3)}), dd AS ({_sexa_sql("dec1", 2)}), sp AS (SELECT k, {sep_sql('ra1', 'dec1', 'ra2', 'dec2')} / ((k % 5) ** 6 + 1) AS sep FROM wide)
SELECT k::BIGINT AS k, printf('%02d:%02d:%06.3f', (rr.w % 24)::BIGINT, rr.m::BIGINT, rr.s) AS ra,
       CASE WHEN dec1 < 0 AND (dd.w > 0 OR dd.m > 0 OR dd.s > 0) THEN '-' ELSE '+' END || printf('%02d:%02d:%05.2f', dd.w::BIGINT, dd.m::BIGINT, dd.s) AS dec,
       CASE WHEN sep * 3600 < 60 THEN printf('%.2f″', sep * 3600) WHEN sep * 3600 < 3600 THEN printf('%.2f′', sep * 60) ELSE printf('%.3f°', sep) END AS sep
FROM wide JOIN rr USING (k) JOIN dd USING (k) JOIN sp USING (k)""",
)
def format_coords(spark, sf):
    p = wide_positions(spark, sf)
    sep = K.separation_deg(*[F.col(c) for c in ("ra1", "dec1", "ra2", "dec2")]) / (F.pow(F.col("k") % 5, F.lit(6.0)) + 1)
    return p.select(*big("k"), X.format_ra(F.col("ra1")).alias("ra"), X.format_dec(F.col("dec1")).alias("dec"), X.format_separation(sep).alias("sep"))


@query(
    "parse_coords",
    f"""WITH t AS (SELECT c_custkey AS k, c_custkey % 24 AS h, c_custkey % 60 AS m, c_custkey * 7 % 60 AS s, c_custkey % 90 AS d, c_custkey * 11 % 60 AS dm FROM customer)
SELECT k::BIGINT AS k, CASE WHEN k % 7 IN (5, 6) THEN NULL WHEN k % 7 IN (3, 4) THEN round(h * 15e0 + m / 100e0, 9) ELSE round(15 * (h + m / 60e0 + s / 3600e0), 9) END AS ra,
       CASE WHEN k % 7 IN (5, 6) THEN NULL WHEN k % 7 IN (3, 4) THEN round((d + dm / 100e0) * CASE WHEN k % 2 = 1 THEN -1 ELSE 1 END, 9) + 0e0
            ELSE round((d + dm / 60e0) * CASE WHEN k % 2 = 1 AND k % 7 <> 2 THEN -1 ELSE 1 END, 9) + 0e0 END AS dec FROM t""",
)
def parse_coords(spark, sf):
    k = F.col("c_custkey")
    h, m, s, d, dm = k % 24, k % 60, k * 7 % 60, k % 90, k * 11 % 60
    sign = F.when(k % 2 == 1, "-").otherwise("+")
    dec_ra = F.format_string("%.2f", h * 15.0 + m / 100.0)
    dec_dec = F.concat(F.when(k % 2 == 1, "-").otherwise(""), F.format_string("%.2f", d + dm / 100.0))
    text = (
        F.when(k % 7 == 0, F.format_string("%02d:%02d:%02d %s%02d:%02d:00", h, m, s, sign, d, dm))
        .when(k % 7 == 1, F.format_string("%02dh%02dm%02ds %s%02dd%02dm00s", h, m, s, sign, d, dm))
        .when(k % 7 == 2, F.format_string("%02d %02d %02d %02d %02d 00", h, m, s, d, dm))
        .when(k % 7 == 3, F.concat_ws(" ", dec_ra, dec_dec))
        .when(k % 7 == 4, F.concat_ws(", ", dec_ra, dec_dec))
        .when(k % 7 == 5, F.concat(F.lit("field "), k.cast("string")))
        .otherwise(F.concat(dec_ra, F.lit(" +95.0")))
    )
    p = D.read(spark, sf, "customer").select(k.alias("k"), X.parse_sky(text).alias("p"))
    return p.select(*big("k"), r("p.ra", 9).alias("ra"), r("p.dec", 9).alias("dec"))


# -- headers and grids ----------------------------------------------------------------------------

HDR_SQL = """hdr AS (
  SELECT c_custkey AS k,
         CASE WHEN k % 7 = 3 THEN 'GLON-TAN' ELSE 'RA---TAN' END AS ctype1, CASE WHEN k % 11 = 5 THEN 'DEC--SIN' ELSE 'dec--tan' END AS ctype2,
         CASE k % 5 WHEN 0 THEN 'FK5' WHEN 1 THEN NULL ELSE 'ICRS' END AS radesys, CASE k % 4 WHEN 0 THEN 'deg ' WHEN 1 THEN NULL WHEN 2 THEN 'Degrees' ELSE CASE WHEN k % 12 = 3 THEN 'rad' ELSE 'degree' END END AS cunit1,
         (k % 50)::DOUBLE AS crpix1, CASE WHEN k % 13 = 0 THEN 90e0 ELSE (k % 80)::DOUBLE END AS crval2, CASE WHEN k % 3 = 0 THEN NULL ELSE (k % 360)::DOUBLE END AS lonpole,
         CASE WHEN k % 2 = 0 THEN -(1 + k % 9) / 36000e0 END AS cd11, CASE WHEN k % 6 = 0 THEN (k % 5) / 36000e0 END AS cd12, CASE WHEN k % 2 = 0 AND k % 17 <> 0 THEN (1 + k % 9) / 36000e0 END AS cd22,
         CASE WHEN k % 4 <> 1 THEN -(1 + k % 3) / 36000e0 END AS cdelt1, CASE WHEN k % 10 = 1 THEN (k % 4) / 10e0 END AS pc21 FROM (SELECT *, c_custkey AS k FROM customer)
), cd AS (
  SELECT *, cd11 IS NOT NULL OR cd12 IS NOT NULL OR cd22 IS NOT NULL AS has FROM hdr
), m AS (
  SELECT k, ctype1, ctype2, radesys, cunit1, crpix1, crval2, lonpole,
         CASE WHEN has THEN coalesce(cd11, 0e0) ELSE coalesce(cdelt1, 1e0) * 1e0 END AS m11, CASE WHEN has THEN coalesce(cd12, 0e0) ELSE coalesce(cdelt1, 1e0) * 0e0 END AS m12,
         CASE WHEN has THEN 0e0 ELSE coalesce(pc21, 0e0) END AS m21, CASE WHEN has THEN coalesce(cd22, 0e0) ELSE 1e0 END AS m22 FROM cd
)"""


@query(
    "wcs_parse",
    f"""WITH {HDR_SQL}, u AS (SELECT *, upper(ctype1) LIKE 'RA--%TAN' AND upper(ctype2) LIKE 'DEC-%TAN' AND coalesce(radesys, '') IN ('', 'ICRS')
  AND lower(trim(coalesce(cunit1, ''))) IN ('', 'deg', 'degree', 'degrees') AND m11 * m22 - m12 * m21 <> 0 AS usable FROM m)
SELECT k::BIGINT AS k, usable, {", ".join(f"{rs('m' + i, 12)} AS cd{i}" for i in ("11", "12", "21", "22"))},
       CASE WHEN usable THEN coalesce(lonpole, CASE WHEN crval2 >= 90 THEN 0e0 ELSE 180e0 END) END AS lonpole FROM u""",
)
def wcs_parse(spark, sf):
    k = F.col("c_custkey")
    none = F.lit(None).cast("double")
    hdr = F.struct(
        F.when(k % 7 == 3, "GLON-TAN").otherwise("RA---TAN").alias("ctype1"), F.when(k % 11 == 5, "DEC--SIN").otherwise("dec--tan").alias("ctype2"),
        F.when(k % 5 == 0, "FK5").when(k % 5 != 1, "ICRS").alias("radesys"),
        F.when(k % 4 == 0, "deg ").when(k % 4 == 1, F.lit(None)).when(k % 4 == 2, "Degrees").when(k % 12 == 3, "rad").otherwise("degree").alias("cunit1"),
        F.lit(None).cast("string").alias("cunit2"),
        (k % 50).cast("double").alias("crpix1"), F.lit(1.0).alias("crpix2"), F.lit(10.0).alias("crval1"),
        F.when(k % 13 == 0, 90.0).otherwise((k % 80).cast("double")).alias("crval2"), F.when(k % 3 != 0, (k % 360).cast("double")).alias("lonpole"),
        F.when(k % 2 == 0, -(k % 9 + 1) / 36000.0).alias("cd1_1"), F.when(k % 6 == 0, k % 5 / 36000.0).alias("cd1_2"), none.alias("cd2_1"),
        F.when((k % 2 == 0) & (k % 17 != 0), (k % 9 + 1) / 36000.0).alias("cd2_2"),
        F.when(k % 4 != 1, -(k % 3 + 1) / 36000.0).alias("cdelt1"), none.alias("cdelt2"),
        none.alias("pc1_1"), F.lit(float("nan")).alias("pc1_2"), F.when(k % 10 == 1, k % 4 / 10.0).alias("pc2_1"), none.alias("pc2_2"),
    )
    h = D.read(spark, sf, "customer").select(k.alias("k"), hdr.alias("hdr")).withColumn("cd", grid.cd_matrix(F.col("hdr")))
    w = K.parse_wcs(F.col("hdr"), F.col("cd"))
    return h.select("k", "cd", w.alias("w")).select(
        *big("k"), F.col("w").isNotNull().alias("usable"), *[r(f"cd.cd{i}", 12).alias("cd" + i) for i in ("11", "12", "21", "22")], F.col("w.lonpole").alias("lonpole")
    )


def grids_of(spark, sf):
    """Customers as bands: dataset = nation, a few shapes and slightly shifted reference pixels."""
    k = F.col("c_custkey")
    none = F.when(k % 19 == 0, True).otherwise(False)
    val = lambda v: F.when(~none, v.cast("double"))
    return D.read(spark, sf, "customer").select(
        F.col("c_nationkey").alias("dataset"), F.concat(F.lit("g"), k.cast("string")).alias("band"), k.alias("ord"), F.lit(0).alias("z"),
        F.when(k % 2 == 0, "RA---TAN").otherwise("ra---tan").alias("ctype1"), F.lit("DEC--TAN").alias("ctype2"),
        (k % 3 + 512).cast("int").alias("h"), F.lit(512).alias("w"),
        val(F.lit(256.5) + k % 7 * F.lit(0.02)).alias("crpix1"), val(F.lit(256.5)).alias("crpix2"), val(F.lit(150.0)).alias("crval1"), val(F.lit(2.2)).alias("crval2"),
        val(F.lit(-3e-5)).alias("cd11"), val(F.lit(0.0)).alias("cd12"), val(F.lit(0.0)).alias("cd21"), val(F.lit(3e-5)).alias("cd22"), val(F.lit(180.0)).alias("lonpole"),
    )


GRIDS_SQL = """g AS (
  SELECT c_nationkey AS dataset, 'g' || c_custkey AS band, c_custkey AS ord, CASE WHEN c_custkey % 2 = 0 THEN 'RA---TAN' ELSE 'ra---tan' END AS ctype1,
         c_custkey % 3 + 512 AS h, 512 AS w, CASE WHEN c_custkey % 19 <> 0 THEN 256.5e0 + c_custkey % 7 * 0.02e0 END AS crpix1, c_custkey % 19 = 0 AS bare FROM customer
), gt AS (
  SELECT *, ctype1 || '|DEC--TAN|' || h || '|' || w || '|' || round_even(coalesce(crpix1, 0) / 1e-3, 0)::BIGINT || '|' ||
     CASE WHEN bare THEN '0|0|0|0|0|0|0' ELSE round_even(256.5e0 / 1e-3, 0)::BIGINT || '|' || round_even(150e0 / 1e-7, 0)::BIGINT || '|' || round_even(2.2e0 / 1e-7, 0)::BIGINT || '|'
       || round_even(-3e-5 / 1e-11, 0)::BIGINT || '|0|0|' || round_even(3e-5 / 1e-11, 0)::BIGINT END AS txt FROM g
), gh AS (
  SELECT *, lower(lpad(to_hex(list_reduce(list_concat([2166136261::BIGINT], list_transform(range(1, len(txt) + 1), lambda i: ascii(substr(txt, i, 1))::BIGINT)),
     lambda h, b: (xor(h, b) * 16777619) & 4294967295)), 8, '0')) AS grid_hash FROM gt
)"""


@query(
    "grid_hash_groups",
    f"""WITH {GRIDS_SQL}, f AS (SELECT dataset, grid_hash, min(ord) AS f FROM gh GROUP BY ALL), n AS (SELECT *, dense_rank() OVER (PARTITION BY dataset ORDER BY f) - 1 AS grp FROM f)
SELECT dataset::BIGINT AS dataset, band, grid_hash, grp::BIGINT AS grid_group FROM gh JOIN n USING (dataset, grid_hash)""",
)
def grid_hash_groups(spark, sf):
    out = GR.groups_by_hash(GR.dataset_rows(grids_of(spark, sf)), "dataset")
    return out.select(*big("dataset"), "band", "grid_hash", *big("grid_group"))


@query(
    "grid_group_summary",
    f"""WITH {GRIDS_SQL}, f AS (SELECT dataset, grid_hash, min(ord) AS f, count(*) AS n FROM gh GROUP BY ALL), n AS (SELECT *, dense_rank() OVER (PARTITION BY dataset ORDER BY f) - 1 AS grp FROM f)
SELECT dataset::BIGINT AS dataset, arg_max(grp, n * 1000000000 - f)::BIGINT AS largest_group, max(n)::BIGINT AS largest_size, bool_or(n >= 2) AS can_composite FROM n GROUP BY dataset""",
)
def grid_group_summary(spark, sf):
    out = GR.group_summary(GR.groups_by_hash(GR.dataset_rows(grids_of(spark, sf)), "dataset"), "dataset")
    return out.select(*big("dataset", "largest_group", "largest_size"), "can_composite")


@query(
    "grid_match_reference",
    f"""WITH {GRIDS_SQL}, ref AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY ord) = 1)
SELECT g.dataset::BIGINT AS dataset, g.band, ref.band AS reference,
       g.h = ref.h AND (g.bare AND ref.bare OR (NOT g.bare AND NOT ref.bare AND abs(g.crpix1 - ref.crpix1) <= 0.0501)) AS compatible
FROM g JOIN ref USING (dataset)""",
)
def grid_match_reference(spark, sf):
    bands = grids_of(spark, sf)
    first = bands.groupBy("dataset").agg(F.min_by(F.struct(*[c for c in bands.columns if c != "dataset"]), "ord").alias("_f")).select("dataset", "_f.*")
    return GR.match_reference(bands, first, "dataset").select(*big("dataset"), "band", "reference", "compatible")


@query(
    "greedy_grid_groups",
    """WITH RECURSIVE g AS (
  SELECT c_nationkey AS dataset, 'g' || c_custkey AS band, c_custkey AS ord, c_custkey % 3 AS h, c_custkey % 19 = 0 AS bare, CASE WHEN c_custkey % 19 <> 0 THEN c_custkey % 7 END AS shift FROM customer
), d AS (
  SELECT dataset, h, bare, shift, row_number() OVER (PARTITION BY dataset ORDER BY min(ord)) AS n FROM g GROUP BY dataset, h, bare, shift
), walk AS (
  SELECT dataset, n, [{'h': h, 'bare': bare, 'shift': shift}] AS reps, h, bare, shift, 1::BIGINT AS place FROM d WHERE n = 1
  UNION ALL
  SELECT dataset, n, CASE WHEN place = 0 THEN list_append(reps, {'h': h, 'bare': bare, 'shift': shift}) ELSE reps END, h, bare, shift, CASE WHEN place = 0 THEN len(reps) + 1 ELSE place END
  FROM (SELECT d.*, w.reps, coalesce(list_position(list_transform(w.reps, lambda r: r.h = d.h AND r.bare = d.bare AND (d.bare OR abs(r.shift - d.shift) <= 2)), true), 0) AS place
        FROM walk w JOIN d ON d.dataset = w.dataset AND d.n = w.n + 1)
)
SELECT g.dataset::BIGINT AS dataset, band, ord::BIGINT AS ord, (place - 1)::BIGINT AS grid_group
FROM g JOIN walk w ON w.dataset = g.dataset AND w.h = g.h AND w.bare = g.bare AND w.shift IS NOT DISTINCT FROM g.shift""",
)
def greedy_grid_groups(spark, sf):
    return GR.greedy_groups(grids_of(spark, sf), "dataset").select(*big("dataset"), "band", *big("ord", "grid_group"))


@query(
    "default_rgb",
    """WITH n AS (SELECT c_nationkey AS dataset, 'g' || c_custkey AS band, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS n FROM customer)
SELECT dataset::BIGINT AS dataset, max(band) FILTER (WHERE n = 1) AS r, max(band) FILTER (WHERE n = 2) AS g, max(band) FILTER (WHERE n = 3) AS b FROM n GROUP BY dataset HAVING max(n) >= 3""",
)
def default_rgb(spark, sf):
    return GR.default_rgb(grids_of(spark, sf), "dataset").select(*big("dataset"), "r", "g", "b")


@query(
    "level_geometry_equal",
    f"""WITH dims AS (
  SELECT 'b' || (vec_id % 3) AS band, max(vec_id) // 3 + 1 AS img_h, max(len(embedding)) AS img_w FROM embeddings GROUP BY 1
  UNION ALL SELECT 'l' || label, count(*), max(len(embedding)) FROM embeddings GROUP BY label
), {LEVELS_SQL}
SELECT band, bool_and(coalesce(a.h = b.h AND a.w = b.w, false)) AS same, count(*)::BIGINT AS levels
FROM (SELECT band, z, h, w FROM levels) a FULL JOIN (SELECT n.band, z, h, w FROM (SELECT DISTINCT band FROM levels) n, (SELECT z, h, w FROM levels WHERE band = 'b0')) b USING (band, z)
GROUP BY band""",
)
def level_geometry_equal(spark, sf):
    """Every band, and one for each label, against the levels of b0."""
    e = D.read(spark, sf, "embeddings")
    labels = e.groupBy(F.concat(F.lit("l"), F.col("label").cast("string")).alias("band")).agg(F.count(F.lit(1)).cast("int").alias("img_h"), F.max(F.size("embedding")).alias("img_w"))
    lv = P.level_table(D.dims(spark, sf).unionByName(labels), TILE).withColumn("set", F.lit(0))
    # Few levels, each needed once for every band.
    ref = lv.filter("band = 'b0'").drop("band").join(lv.select("band", "set").distinct(), "set")
    return GR.same_levels(lv, ref, ["band"]).select("band", "same", *big("levels"))


@query(
    "fingerprints",
    """SELECT page_id::BIGINT AS page_id, fp, fp || '/2/3/' || (page_id % 10) AS key FROM (
  SELECT page_id, lower(lpad(to_hex(list_reduce(list_concat([2166136261::BIGINT], list_transform(range(1, len(url) + 1), lambda i: ascii(substr(url, i, 1))::BIGINT)),
     lambda h, b: (xor(h, b) * 16777619) & 4294967295)), 8, '0')) AS fp FROM pages)""",
)
def fingerprints(spark, sf):
    p = D.read(spark, sf, "pages").select("page_id", grid.fnv1a_hex(F.col("url"), "UTF-16BE").alias("fp"))
    return p.select(*big("page_id"), "fp", grid.blob_key(F.col("fp"), F.lit(2), F.lit(3), F.col("page_id") % 10).alias("key"))


# -- cutouts --------------------------------------------------------------------------------------

def requests(spark, sf):
    o, k = D.read(spark, sf, "orders"), F.col("o_orderkey")
    p = F.substring("o_orderpriority", 1, 1).cast("int")
    fov = F.floor(F.col("o_totalprice") / 10000) + 10.0
    out = F.when(p < 5, F.pow(F.lit(2.0), p) * 2)
    return o.select(
        k.alias("request_id"), D.band_name(k).alias("band"), (F.col("o_custkey") * 37 % 400 / 10000.0 + 150.03).alias("ra"),
        (F.col("o_custkey") * 91 % 1000 / 10000.0 + 2.2).alias("dec"), fov.alias("fov_x"), (fov * (k % 3 + 1) / 2.0).alias("fov_y"),
        out.alias("out_x"), out.alias("out_y"), F.when(k % 11 == 0, 3.3).alias("target_scale"),
    )


_f = "(2 ** z)"
LEVEL_W = {
    "crpix1": f"(((img_w + 1) / 2e0) / {_f} + ({_f} - 1) / (2 * {_f}))", "crpix2": f"(((img_h + 1) / 2e0) / {_f} + ({_f} - 1) / (2 * {_f}))",
    "crval1": num(D.CRVAL[0]), "crval2": num(D.CRVAL[1]), **{c: f"({num(v)} * {_f})" for c, v in zip(("cd11", "cd12", "cd21", "cd22"), D.CD)}, "lonpole": "180e0",
}
_rx, _ry = sky_to_pix_sql("sra", "sdec", LEVEL_W)

REQ_SQL = f"""req AS (
  SELECT o_orderkey AS request_id, 'b' || (o_orderkey % 3) AS band, o_custkey * 37 % 400 / 10000e0 + 150.03e0 AS ra, o_custkey * 91 % 1000 / 10000e0 + 2.2e0 AS dec,
         floor(o_totalprice / 10000) + 10e0 AS fov_x, (floor(o_totalprice / 10000) + 10e0) * (o_orderkey % 3 + 1) / 2e0 AS fov_y,
         CASE WHEN substr(o_orderpriority, 1, 1)::INT < 5 THEN 2 * 2e0 ** substr(o_orderpriority, 1, 1)::INT END AS outp,
         CASE WHEN o_orderkey % 11 = 0 THEN 3.3e0 END AS target FROM orders
), scaled AS (
  SELECT *, coalesce(target, least(fov_x / outp, fov_y / outp), {num(D.ARCSEC)}) AS sc FROM req
), opts AS (
  SELECT s.*, l.z, l.h, l.w, l.n_ty, l.n_tx, l.img_h, l.img_w, {num(D.ARCSEC)} * 2 ** l.z AS ls FROM scaled s JOIN levels l USING (band)
)"""


@query(
    "level_choice",
    with_levels_sql(REQ_SQL)
    + f"""
SELECT request_id::BIGINT AS request_id, {rs("any_value(sc)", 9)} AS output_scale,
       arg_min(z, round(abs(log2(ls / sc)), 12) * 1000 + z * 1e-9)::BIGINT AS nearest,
       coalesce(max(z) FILTER (WHERE ls <= sc), min(z))::BIGINT AS finer, coalesce(min(z) FILTER (WHERE ls >= sc), max(z))::BIGINT AS coarser
FROM opts GROUP BY request_id""",
)
def level_choice(spark, sf):
    req = requests(spark, sf).join(CUT.pyramids(D.level_wcs(spark, sf)), "band")
    finest = F.array_min(F.transform("levels", lambda l: l["pixel_scale_arcsec"]))
    sc = CUT.output_scale(*[F.col(c) for c in ("target_scale", "fov_x", "fov_y", "out_x", "out_y")], finest)
    # Scales of the test levels are exact powers of two times one constant; drop the last bits so ties stay ties.
    exact = F.transform("levels", lambda l: F.struct(l["z"].alias("z"), F.round(l["pixel_scale_arcsec"], 9).alias("pixel_scale_arcsec")))
    s = req.withColumn("sc", F.round(sc, 9)).withColumn("levels", exact)
    return s.select(
        *big("request_id"), r("sc", 9).alias("output_scale"),
        *[CUT.choose_level(F.col("levels"), F.col("sc"), m).cast("bigint").alias(m) for m in ("nearest", "finer", "coarser")],
    )


def supertiles(spark, sf):
    """Supertiles of all levels; a third of those of b1 at z < 2 are gaps."""
    s = P.supertile_blocks(D.level_wcs(spark, sf), BLOCKS)
    single = (F.col("n_tx") <= BLOCKS) & (F.col("n_ty") <= BLOCKS)
    s = s.withColumn("filename", P.supertile_filename(F.col("band"), single, F.col("z"), F.col("tx0"), F.col("ty0")))
    return s.filter(~((F.col("band") == "b1") & (F.col("z") < 2) & (F.col("idx") % 3 == 0)))


SUPER_SQL = f"""st AS (
  SELECT *, (ty0 // {BLOCKS}) * ((n_tx + {BLOCKS - 1}) // {BLOCKS}) + tx0 // {BLOCKS} AS idx, least({BLOCKS}, n_tx - tx0) AS nx, least({BLOCKS}, n_ty - ty0) AS ny,
         CASE WHEN n_tx <= {BLOCKS} AND n_ty <= {BLOCKS} THEN band || '_z' || z || '.fits.fz' ELSE band || '_z' || z || '_' || tx0 || '_' || ty0 || '.fits.fz' END AS filename
  FROM (SELECT *, unnest(range(0, n_tx, {BLOCKS})) AS tx0 FROM (SELECT *, unnest(range(0, n_ty, {BLOCKS})) AS ty0 FROM levels))
), stored AS (SELECT * FROM st WHERE NOT (band = 'b1' AND z < 2 AND idx % 3 = 0))"""

PLAN_SQL = f"""chosen AS (
  SELECT * FROM opts QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY round(abs(log2(ls / sc)), 12), z) = 1
), ring AS (
  SELECT *, dec + dy AS sdec, ra + dx / cos(radians(dec + dy)) AS sra FROM (
    SELECT *, CASE e WHEN 0 THEN t * fov_x WHEN 1 THEN t * fov_x WHEN 2 THEN -fov_x ELSE fov_x END / 7200 AS dx,
              CASE e WHEN 0 THEN -fov_y WHEN 1 THEN fov_y ELSE t * fov_y END / 7200 AS dy FROM (
      SELECT *, i * (2 / 15e0) - 1 AS t FROM (SELECT *, unnest(range(0, 16)) AS i FROM (SELECT *, unnest(range(0, 4)) AS e FROM chosen))))
), box AS (
  SELECT request_id, band, z, n_tx, n_ty, any_value(sc) AS sc, greatest(0, min(floor({_rx})))::BIGINT AS x0, greatest(0, min(floor({_ry})))::BIGINT AS y0,
         least(any_value(w), max(floor({_rx})) + 1)::BIGINT AS x1, least(any_value(h), max(floor({_ry})) + 1)::BIGINT AS y1
  FROM ring GROUP BY request_id, band, z, n_tx, n_ty
), plan AS (
  SELECT c.*, s.idx, s.filename, c.tile_x - s.tx0 AS local_x, c.tile_y - s.ty0 AS local_y FROM (
    SELECT *, unnest(range(x0 // {TILE}, least(n_tx - 1, (x1 - 1) // {TILE}) + 1)) AS tile_x FROM (
      SELECT *, unnest(range(y0 // {TILE}, least(n_ty - 1, (y1 - 1) // {TILE}) + 1)) AS tile_y FROM box WHERE x1 > x0 AND y1 > y0)) c
  LEFT JOIN stored s ON s.band = c.band AND s.z = c.z AND c.tile_x >= s.tx0 AND c.tile_x < s.tx0 + s.nx AND c.tile_y >= s.ty0 AND c.tile_y < s.ty0 + s.ny
)"""


def cutout_plan_of(spark, sf):
    return CUT.plan_cutouts(requests(spark, sf), D.level_wcs(spark, sf), supertiles(spark, sf), "nearest", TILE)


@query(
    "cutout_plan",
    with_levels_sql(REQ_SQL, SUPER_SQL, PLAN_SQL)
    + f"""
SELECT request_id::BIGINT AS request_id, band, {bigs("z", "x0", "y0", "x1", "y1", "tile_x", "tile_y")}, coalesce(idx, -1)::BIGINT AS idx, filename,
       coalesce(local_x, -1)::BIGINT AS local_x, coalesce(local_y, -1)::BIGINT AS local_y, idx IS NULL AS missing FROM plan""",
)
def cutout_plan(spark, sf):
    p = cutout_plan_of(spark, sf)
    fill = lambda c: F.coalesce(F.col(c), F.lit(-1)).cast("bigint").alias(c)
    return p.select(*big("request_id"), "band", *big("z", "x0", "y0", "x1", "y1", "tile_x", "tile_y"), fill("idx"), "filename", fill("local_x"), fill("local_y"), "missing")


@query(
    "cutout_files",
    with_levels_sql(REQ_SQL, SUPER_SQL, PLAN_SQL)
    + """
SELECT request_id::BIGINT AS request_id, string_agg(filename, ',' ORDER BY o) AS files, count(*)::BIGINT AS n FROM (
  SELECT request_id, filename, min(tile_y * 100000 + tile_x) AS o FROM plan WHERE idx IS NOT NULL GROUP BY ALL) GROUP BY request_id""",
)
def cutout_files(spark, sf):
    f = CUT.plan_files(cutout_plan_of(spark, sf))
    return f.select(*big("request_id"), F.array_join("files", ",").alias("files"), F.size("files").cast("bigint").alias("n"))


@query(
    "cutout_byte_ranges",
    with_levels_sql(REQ_SQL, SUPER_SQL, PLAN_SQL, """pieces AS (
  SELECT request_id, filename, min(start) AS start, max(stop) AS stop FROM (
    SELECT *, sum(brk) OVER (PARTITION BY request_id, filename ORDER BY start) AS isl FROM (
      SELECT *, CASE WHEN start > lag(stop) OVER (PARTITION BY request_id, filename ORDER BY start) THEN 1 ELSE 0 END AS brk FROM (
        SELECT request_id, filename, 1000 + (local_y * 2 + local_x) * 700 AS start, 1000 + (local_y * 2 + local_x) * 700 + 700 AS stop FROM plan WHERE idx IS NOT NULL)))
  GROUP BY request_id, filename, isl)""")
    + """
SELECT request_id::BIGINT AS request_id, filename, start::BIGINT AS start, (stop - start)::BIGINT AS length FROM pieces""",
)
def cutout_byte_ranges(spark, sf):
    """Ranges to fetch when every stored tile takes 700 bytes, laid out row-major in its file."""
    stored = CUT.tile_map(supertiles(spark, sf))
    row = F.col("local_y") * BLOCKS + F.col("local_x")
    index = stored.select("filename", "local_x", "local_y", (row * 700 + 1000).cast("bigint").alias("start"), F.lit(700).cast("bigint").alias("length"))
    return CUT.plan_byte_ranges(cutout_plan_of(spark, sf), index).select(*big("request_id"), "filename", *big("start", "length"))


@query(
    "tile_lookup",
    with_levels_sql(SUPER_SQL, CAT_SQL)
    + f"""
SELECT id, band, z::BIGINT AS z, coalesce(tx, -1)::BIGINT AS tile_x, coalesce(ty, -1)::BIGINT AS tile_y, filename FROM (
  SELECT c.id, l.band, l.z, CASE WHEN c.px < l.w AND c.py < l.h THEN floor(c.px / {TILE})::BIGINT END AS tx, CASE WHEN c.px < l.w AND c.py < l.h THEN floor(c.py / {TILE})::BIGINT END AS ty
  FROM cat c JOIN levels l ON l.z = c.ord % 3) q
LEFT JOIN stored s ON s.band = q.band AND s.z = q.z AND tx >= s.tx0 AND tx < s.tx0 + s.nx AND ty >= s.ty0 AND ty < s.ty0 + s.ny""".replace("SELECT id, band, z::", "SELECT id, q.band, q.z::"),
)
def tile_lookup(spark, sf):
    """Level pixel -> tile -> supertile for every source, on the level its number picks."""
    c = catalog(spark, sf).withColumn("z", (F.col("ord") % 3).cast("int"))
    at = c.join(D.level_wcs(spark, sf).select("band", "z", "h", "w"), "z").withColumn(
        "_t", grid.pixel_to_tile(F.floor("px"), F.floor("py"), F.col("h"), F.col("w"), TILE)
    ).select("id", "band", "z", F.col("_t.tile_x").cast("int").alias("tile_x"), F.col("_t.tile_y").cast("int").alias("tile_y"))
    out = CUT.resolve_tiles(at, CUT.tile_map(supertiles(spark, sf)))
    fill = lambda n: F.coalesce(F.col(n), F.lit(-1)).cast("bigint").alias(n)
    return out.select("id", "band", *big("z"), fill("tile_x"), fill("tile_y"), "filename")


WANT_SQL = """want AS (
  SELECT band, z, tile_x, tile_y, n_tx FROM (SELECT *, unnest(range(0, n_tx)) AS tile_x FROM (SELECT *, unnest(range(0, n_ty)) AS tile_y FROM levels))
), have AS (SELECT * FROM want WHERE (tile_x * 7 + tile_y * 13 + z * 5 + substr(band, 2, 1)::INT * (tile_y % 2)) % 3 <> 0), top AS (SELECT max(z) AS top FROM levels)"""


def wanted(spark, sf):
    return P.level_tiles(P.level_table(D.dims(spark, sf), TILE)).select("band", "z", "tile_x", "tile_y")


def have(spark, sf):
    b = F.substring("band", 2, 1).cast("int")
    return wanted(spark, sf).filter((F.col("tile_x") * 7 + F.col("tile_y") * 13 + F.col("z") * 5 + b * (F.col("tile_y") % 2)) % 3 != 0)


@query(
    "best_available_tile",
    with_levels_sql(WANT_SQL)
    + f"""
SELECT w.band, {bigs("w.z", "w.tile_x", "w.tile_y").replace("AS w.", "AS ")}, min(h.z)::BIGINT AS from_z
FROM want w JOIN have h ON h.band = w.band AND h.z > w.z AND h.tile_x = w.tile_x // (2 ** (h.z - w.z))::BIGINT AND h.tile_y = w.tile_y // (2 ** (h.z - w.z))::BIGINT
GROUP BY w.band, w.z, w.tile_x, w.tile_y""",
)
def best_available_tile(spark, sf):
    out = CUT.coarser_source(wanted(spark, sf), have(spark, sf), 40)
    return out.select("band", *big("z", "tile_x", "tile_y", "from_z"))


@query(
    "common_level",
    with_levels_sql(WANT_SQL)
    + """, all3 AS (SELECT z, tile_x, tile_y FROM have GROUP BY ALL HAVING count(DISTINCT band) = 3), w AS (SELECT DISTINCT z, tile_x, tile_y FROM want)
SELECT w.z::BIGINT AS z, w.tile_x::BIGINT AS tile_x, w.tile_y::BIGINT AS tile_y, min(h.z)::BIGINT AS from_z
FROM w JOIN all3 h ON h.z >= w.z AND h.tile_x = w.tile_x // (2 ** (h.z - w.z))::BIGINT AND h.tile_y = w.tile_y // (2 ** (h.z - w.z))::BIGINT
GROUP BY w.z, w.tile_x, w.tile_y""",
)
def common_level(spark, sf):
    w = wanted(spark, sf).select("z", "tile_x", "tile_y").distinct()
    return CUT.common_level(w, have(spark, sf), 3, 40).select(*big("z", "tile_x", "tile_y", "from_z"))


@query(
    "finer_coverage",
    with_levels_sql(WANT_SQL)
    + """, d AS (
  SELECT w.band, w.z, w.tile_x, w.tile_y, h.z AS fz, count(*) AS n, sum(h.tile_x * 1000 + h.tile_y) AS chk
  FROM want w JOIN have h ON h.band = w.band AND h.z < w.z AND h.z >= w.z - 2 AND w.tile_x = h.tile_x // (2 ** (w.z - h.z))::BIGINT AND w.tile_y = h.tile_y // (2 ** (w.z - h.z))::BIGINT
  GROUP BY ALL)
SELECT band, z::BIGINT AS z, tile_x::BIGINT AS tile_x, tile_y::BIGINT AS tile_y, fz::BIGINT AS from_z, n::BIGINT AS n, chk::BIGINT AS chk
FROM d QUALIFY row_number() OVER (PARTITION BY band, z, tile_x, tile_y ORDER BY fz DESC) = 1""",
)
def finer_coverage(spark, sf):
    out = CUT.finer_cover(wanted(spark, sf), have(spark, sf))
    chk = F.aggregate("tiles", F.lit(0).cast("bigint"), lambda a, t: a + t["x"] * 1000 + t["y"])
    return out.select("band", *big("z", "tile_x", "tile_y", "from_z"), F.size("tiles").cast("bigint").alias("n"), chk.alias("chk"))


def views(spark, sf):
    """Events as views: centre, zoom, viewport, turned North-up."""
    e, k = D.read(spark, sf, "events"), F.col("event_id")
    v = e.select(
        k.alias("view_id"), D.band_name(F.col("user_id")).alias("band"),
        F.struct(
            (k * 17 % 64).cast("double").alias("cx"), (k * 23 % 160).cast("double").alias("cy"),
            (F.pow(F.lit(2.0), -(k % 5).cast("double")) * (F.col("value") / 1000.0 + 1.0)).alias("zoom"),
            (k % 40 + 10).cast("double").alias("vw"), (k % 30 + 10).cast("double").alias("vh"),
        ).alias("view"),
    )
    return v.withColumn("m", K.north_up(fixed_wcs(), F.col("view.cx"), F.col("view.cy")))


_vra, _vdec = pix_to_sky_sql("cx", "cy")
_nx, _ny = sky_to_pix_sql("ra0", "(dec0 + 1e-4)")
_ex, _ey = sky_to_pix_sql("(ra0 + 1e-4 / cos(radians(dec0)))", "dec0")
VIEW_SQL = f"""v0 AS (
  SELECT event_id AS view_id, 'b' || (user_id % 3) AS band, (event_id * 17 % 64)::DOUBLE AS cx, (event_id * 23 % 160)::DOUBLE AS cy,
         2e0 ** -(event_id % 5) * (value / 1000e0 + 1e0) AS zoom, (event_id % 40 + 10)::DOUBLE AS vw, (event_id % 30 + 10)::DOUBLE AS vh FROM events
), v1 AS (SELECT *, {_vra} AS ra0, {_vdec} AS dec0 FROM v0), v2 AS (SELECT *, {_nx} - cx AS nx, {_ny} - cy AS ny, {_ex} - cx AS ex, {_ey} - cy AS ey FROM v1),
v3 AS (SELECT *, cos(-pi() / 2 - atan2(ny, nx)) AS c, sin(-pi() / 2 - atan2(ny, nx)) AS s FROM v2),
v4 AS (SELECT *, CASE WHEN c * ex - s * ey > 0 THEN -c ELSE c END AS m11, CASE WHEN c * ex - s * ey > 0 THEN s ELSE -s END AS m12, s AS m21, c AS m22 FROM v3),
v5 AS (SELECT *, vw / (2 * zoom) * abs(m11) + vh / (2 * zoom) * abs(m21) AS rx, vw / (2 * zoom) * abs(m12) + vh / (2 * zoom) * abs(m22) AS ry FROM v4)"""


@query(
    "view_geometry",
    f"""WITH {VIEW_SQL}
SELECT view_id::BIGINT AS view_id, {", ".join(f"{rs(c, 4)} AS {c}" for c in ("m11", "m12", "m21", "m22"))}, {rs("cx - rx", 3)} AS x0, {rs("cy + ry", 3)} AS y1,
       {rs("m11 * 5 * zoom + m12 * 7 * zoom + vw / 2", 3)} AS sx, {rs("cx + m11 * (-vw / 2) / zoom + m21 * (-vh / 2) / zoom", 3)} AS wx FROM v5""",
)
def view_geometry(spark, sf):
    v, view, m = views(spark, sf), F.col("view"), F.col("m")
    box = K.viewport_box(view, m)
    sx, _ = K.world_to_screen(view, m, view["cx"] + 5, view["cy"] + 7)
    wx, _ = K.screen_to_world(view, m, F.lit(0.0), F.lit(0.0))
    return v.select(
        *big("view_id"), *[r(m[c], 4).alias(c) for c in ("m11", "m12", "m21", "m22")], r(box["x0"], 3).alias("x0"), r(box["y1"], 3).alias("y1"), r(sx, 3).alias("sx"), r(wx, 3).alias("wx")
    )


@query(
    "view_tile_demand",
    with_levels_sql(VIEW_SQL, f"""v6 AS (
  SELECT v5.*, l.z, l.w, l.h, l.n_tx, l.n_ty, 2 ** l.z AS f FROM v5 JOIN (SELECT band, max(z) AS top FROM levels GROUP BY band) t USING (band)
  JOIN levels l ON l.band = v5.band AND l.z = greatest(0, least(top, floor(-log2(zoom) + 0.5)))
), v7 AS (
  SELECT *, greatest(0, cx - rx) AS x0, least(w * f, cx + rx) AS x1, greatest(0, cy - ry) AS y0, least(h * f, cy + ry) AS y1 FROM v6
)""")
    + f"""
SELECT band, z::BIGINT AS z, tx::BIGINT AS tile_x, ty::BIGINT AS tile_y, count(*)::BIGINT AS views FROM (
  SELECT *, unnest(range(floor(x0 / ({TILE} * f))::BIGINT, least(n_tx - 1, floor((x1 - 1e-6) / ({TILE} * f))::BIGINT) + 1)) AS tx FROM (
    SELECT *, unnest(range(floor(y0 / ({TILE} * f))::BIGINT, least(n_ty - 1, floor((y1 - 1e-6) / ({TILE} * f))::BIGINT) + 1)) AS ty FROM v7 WHERE x1 > x0 AND y1 > y0)) GROUP BY ALL""",
)
def view_tile_demand(spark, sf):
    lv = P.level_table(D.dims(spark, sf), TILE)
    top = lv.groupBy("band").agg(F.max("z").alias("top"))
    v = views(spark, sf).join(top, "band").withColumn("z", CUT.view_level(F.col("view.zoom"), F.col("top"))).withColumn("box", K.viewport_box(F.col("view"), F.col("m")))
    t = CUT.visible_tiles(v.select("view_id", "band", "z", "box"), lv, TILE)
    return t.groupBy("band", "z", "tile_x", "tile_y").agg(F.count(F.lit(1)).alias("views")).select("band", *big("z", "tile_x", "tile_y", "views"))


# -- catalogs -------------------------------------------------------------------------------------

@query(
    "catalog_sample",
    with_levels_sql(CAT_SQL, f"""pos AS (SELECT id, ord % 3 AS z, {_x} AS wx, {_y} AS wy FROM cat), lpix AS (
  SELECT band, z, y // (2 ** z)::BIGINT AS ly, x // (2 ** z)::BIGINT AS lx, (sum(v::DOUBLE) FILTER (WHERE NOT isnan(v)) / nullif(count(*) FILTER (WHERE NOT isnan(v)), 0))::FLOAT AS v
  FROM pixels JOIN levels USING (band) WHERE z < 3 AND y < h * (2 ** z)::BIGINT AND x < w * (2 ** z)::BIGINT GROUP BY ALL
)""")
    + f"""
SELECT id, l.band, l.z::BIGINT AS z, p.band IS NOT NULL AS stored, {rs("v", 5)} AS value
FROM pos JOIN levels l USING (z) LEFT JOIN lpix p ON p.band = l.band AND p.z = l.z AND p.lx = floor(wx / 2 ** l.z) AND p.ly = floor(wy / 2 ** l.z)""",
)
def catalog_sample(spark, sf):
    c = CAT.place(catalog(spark, sf).select("id", "ord", "ra", "dec", F.lit(None).cast("double").alias("x"), F.lit(None).cast("double").alias("y")), fixed_wcs())
    c = c.withColumn("z", (F.col("ord") % 3).cast("int")).select("id", "z", "wx", "wy")
    out = T.point_sample(c, pyramid(spark, sf, 2), P.level_table(D.dims(spark, sf), TILE), "wx", "wy", TILE)
    return out.select("id", "band", *big("z"), F.col("value").isNotNull().alias("stored"), r("value", 5).alias("value"))


MIXED_SQL = f"""mixed AS (
  SELECT id, ord, CASE WHEN ord % 3 <> 0 THEN ra END AS ra, CASE WHEN ord % 3 <> 0 AND ord % 10 <> 1 THEN dec END AS dec,
         CASE WHEN ord % 4 <> 0 THEN px END AS x, CASE WHEN ord % 4 <> 0 THEN py END AS y FROM cat
)"""


def mixed(spark, sf):
    o = F.col("ord")
    return catalog(spark, sf).select(
        "id", "ord", F.when(o % 3 != 0, F.col("ra")).alias("ra"), F.when((o % 3 != 0) & (o % 10 != 1), F.col("dec")).alias("dec"),
        F.when(o % 4 != 0, F.col("px")).alias("x"), F.when(o % 4 != 0, F.col("py")).alias("y"),
    )


_mra, _mdec = pix_to_sky_sql("(x + 0.5)", "(y + 0.5)")


@query(
    "marker_placement",
    f"""WITH {CAT_SQL}, {MIXED_SQL}
SELECT id, {rs(f"CASE WHEN ra IS NOT NULL AND dec IS NOT NULL THEN {_x} ELSE x + 0.5 END")} AS wx, {rs(f"CASE WHEN ra IS NOT NULL AND dec IS NOT NULL THEN {_y} ELSE y + 0.5 END")} AS wy,
       {rs(f"CASE WHEN ra IS NOT NULL AND dec IS NOT NULL THEN ra ELSE {_mra} END", 8)} AS sky_ra, {rs(f"CASE WHEN ra IS NOT NULL AND dec IS NOT NULL THEN dec ELSE {_mdec} END", 8)} AS sky_dec
FROM mixed WHERE (ra IS NOT NULL AND dec IS NOT NULL) OR (x IS NOT NULL AND y IS NOT NULL)""",
)
def marker_placement(spark, sf):
    out = CAT.place(mixed(spark, sf), fixed_wcs())
    return out.select("id", r("wx").alias("wx"), r("wy").alias("wy"), r("sky_ra", 8).alias("sky_ra"), r("sky_dec", 8).alias("sky_dec"))


@query(
    "catalog_placeable",
    f"""WITH {CAT_SQL}, {MIXED_SQL} SELECT id FROM mixed WHERE (ra IS NOT NULL AND dec IS NOT NULL) OR (x IS NOT NULL AND y IS NOT NULL)""",
)
def catalog_placeable(spark, sf):
    return CAT.placeable(mixed(spark, sf)).select("id")


@query(
    "catalog_ids",
    """SELECT c_custkey::BIGINT AS c_custkey, CASE WHEN n < 10000 THEN printf('src_%04d', n) ELSE 'src_' || n END AS id FROM (
  SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal, c_custkey) - 1 AS n FROM customer)""",
)
def catalog_ids(spark, sf):
    c = D.read(spark, sf, "customer").select("c_custkey", "c_acctbal")
    return CAT.with_ids(c, ["c_acctbal", "c_custkey"]).select(*big("c_custkey"), "id")


@query(
    "catalog_duplicates",
    "SELECT (c_custkey // 2 % 700)::VARCHAR AS entity, 'duplicate_id' AS rule, count(*)::VARCHAR AS detail FROM customer GROUP BY c_custkey // 2 % 700 HAVING count(*) > 1",
)
def catalog_duplicates(spark, sf):
    c = D.read(spark, sf, "customer").select((F.floor(F.col("c_custkey") / 2) % 700).alias("id"))
    return CAT.duplicate_ids(c)


CSV_SQL = "WITH l AS (SELECT c_custkey AS k, c_name, c_acctbal, c_mktsegment FROM customer)"
#: Why a line of the fixture is left out: a column too many, one too few, no number for a position.
DROPPED_SQL = "(k % 7 = 3 OR k % 11 = 5 OR k % 5 = 0 OR k % 13 = 1)"


def catalog_lines(spark, sf):
    """Customers as catalog lines: quotes, blanks, words for missing numbers, rows too wide and too narrow, suffixed numbers."""
    k = F.col("c_custkey")
    note = F.when(k % 4 == 0, F.lit("")).otherwise(
        F.concat(F.lit('"'), F.col("c_mktsegment"), F.lit(', ""'), (k % 10).cast("string"), F.lit('"""'))
    )
    ra = F.when(k % 5 == 0, F.lit("nan")).when(k % 13 == 1, F.lit("1d")).otherwise(F.concat((k % 360).cast("string"), F.lit(".5")))
    flux = F.when(k % 6 == 0, F.lit("NaN")).otherwise(F.concat(F.lit("f"), k.cast("string")))
    line = F.concat_ws(",", F.when(k % 9 == 4, F.lit(" ")).otherwise(F.col("c_name")), ra, (k % 90).cast("string"), (k % 3).cast("string"), note)
    line = F.when(k % 11 == 5, line).otherwise(F.concat_ws(",", line, flux))
    line = F.when(k % 7 == 3, F.concat(line, F.lit(",extra,more"))).otherwise(line)
    return D.read(spark, sf, "customer").select(k.alias("k"), line.alias("line"))


CSV_HEADER = "Id, RA,Dec ,EDGE,Note,flux"


@query(
    "catalog_csv",
    CSV_SQL + f"""
SELECT k::BIGINT AS k, CASE WHEN k % 9 <> 4 THEN c_name END AS id, (k % 360 + 0.5)::DOUBLE AS ra, (k % 90)::DOUBLE AS dec, (k % 3)::DOUBLE AS edgewidth,
       CASE WHEN k % 4 <> 0 THEN c_mktsegment || ', "' || (k % 10) || '"' END AS note, CASE WHEN k % 6 <> 0 THEN 'f' || k END AS flux
FROM l WHERE NOT {DROPPED_SQL}""",
)
def catalog_csv(spark, sf):
    from starloom.sources import catalog_csv as CSV

    rows = CSV.kept_rows(CSV.parse_lines(catalog_lines(spark, sf), CSV_HEADER, ["k"]))
    return rows.select(*big("k"), "id", "ra", "dec", "edgewidth", F.col("data")["note"].alias("note"), F.col("data")["flux"].alias("flux"))


@query("catalog_rejects", CSV_SQL + f" SELECT c_mktsegment AS segment, count(*)::BIGINT AS dropped FROM l WHERE {DROPPED_SQL} GROUP BY c_mktsegment")
def catalog_rejects(spark, sf):
    from starloom.sources import catalog_csv as CSV

    lines = catalog_lines(spark, sf).join(D.read(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("segment")), "k")
    return CSV.rejected_rows(CSV.parse_lines(lines, CSV_HEADER, ["segment"]), ["segment"]).select("segment", *big("dropped"))


def points(spark, sf):
    """Sources at native positions, with a style for the hit test."""
    c = catalog(spark, sf)
    return c.select(
        "id", "ord", F.col("px").alias("x"), F.col("py").alias("y"),
        F.when(F.col("nation") % 3 == 0, "box").when(F.col("nation") % 3 == 1, "circle").otherwise("point").alias("shape"), (F.col("nation") % 7 + 2).cast("double").alias("size"),
    )


def probes(spark, sf):
    k = F.col("s_suppkey")
    return D.read(spark, sf, "supplier").select(
        k.alias("pos_id"), (k * 37 % 640 / 10.0).alias("qx"), (k * 71 % 1670 / 10.0).alias("qy"), (k % 5 + 1).cast("double").alias("radius"),
        F.struct(F.lit(32.0).alias("cx"), F.lit(80.0).alias("cy"), (k % 3 + 1).cast("double").alias("zoom"), F.lit(64.0).alias("vw"), F.lit(64.0).alias("vh")).alias("view"),
        F.struct(F.lit(0.6).alias("m11"), F.lit(-0.8).alias("m12"), F.lit(0.8).alias("m21"), F.lit(0.6).alias("m22")).alias("m"), (k % 2 + 1).cast("double").alias("dpr"),
    )


PROBE_SQL = """pr AS (
  SELECT s_suppkey AS pos_id, s_suppkey * 37 % 640 / 10e0 AS qx, s_suppkey * 71 % 1670 / 10e0 AS qy, s_suppkey % 5 + 1e0 AS radius, s_suppkey % 3 + 1e0 AS zoom, s_suppkey % 2 + 1e0 AS dpr FROM supplier
)"""


@query(
    "near_points",
    f"""WITH {CAT_SQL}, {PROBE_SQL} SELECT pos_id::BIGINT AS pos_id, id, {rs("sqrt((px - qx) ** 2 + (py - qy) ** 2)")} AS dist
FROM pr, cat WHERE (px - qx) * (px - qx) + (py - qy) * (py - qy) <= radius * radius""",
)
def near_points(spark, sf):
    out = SP.near_points(points(spark, sf).select("id", "x", "y"), probes(spark, sf).select("pos_id", "qx", "qy", "radius"), 1.0)
    return out.select(*big("pos_id"), "id", r(F.sqrt(F.pow(F.col("x") - F.col("qx"), 2) + F.pow(F.col("y") - F.col("qy"), 2))).alias("dist"))


@query(
    "topmost_marker",
    f"""WITH {CAT_SQL}, {PROBE_SQL}, h AS (
  SELECT pos_id, id, ord, nation % 3 AS sh, ((nation % 7 + 2) / 2e0 + 1) * dpr AS half,
         0.6e0 * ((px - qx) * zoom) - 0.8e0 * ((py - qy) * zoom) AS sx, 0.8e0 * ((px - qx) * zoom) + 0.6e0 * ((py - qy) * zoom) AS sy FROM pr, cat
)
SELECT pos_id::BIGINT AS pos_id, arg_max(id, ord) AS marker, count(*)::BIGINT AS hits FROM h
WHERE CASE WHEN sh = 0 THEN abs(sx) <= half AND abs(sy) <= half ELSE sx * sx + sy * sy <= half * half END GROUP BY pos_id""",
)
def topmost_marker(spark, sf):
    m = points(spark, sf)
    # The largest glyph is one number.
    largest = m.agg(F.max("size").alias("max_size"))
    p = probes(spark, sf).join(F.broadcast(largest))
    return SP.topmost_marker(m, p, 1.0).select(*big("pos_id"), "marker", *big("hits"))


@query(
    "catalog_extent",
    f"""WITH {CAT_SQL}, e AS (SELECT count(*) AS n, min(px) AS x0, max(px) AS x1, min(py) AS y0, max(py) AS y1 FROM cat)
SELECT n::BIGINT AS n, x0, x1, y0, y1, {rs("sqrt((x1 - x0) * (y1 - y0) / n)", 9)} AS cell FROM e""",
)
def catalog_extent(spark, sf):
    return SP.extent(points(spark, sf)).select(*big("n"), "x0", "x1", "y0", "y1", r("cell", 9).alias("cell"))


# -- regions --------------------------------------------------------------------------------------

def rects(spark, sf):
    k = F.col("s_suppkey")
    none = F.lit(None).cast("double")
    sky = k % 4 == 0
    return D.read(spark, sf, "supplier").filter(k % 2 == 0).select(
        F.concat(F.lit("r"), k.cast("string")).alias("id"), k.alias("ord"),
        F.when(sky, k * 37 % 300 / 10000.0 + 150.035).alias("ra"), F.when(sky, k * 91 % 500 / 10000.0 + 2.22).alias("dec"),
        F.when(sky, k % 50 + 10.0).alias("width_arcsec"), F.when(sky, k % 30 + 5.0).alias("height_arcsec"), F.when(sky, (k % 180).cast("double")).alias("pa_deg"),
        F.when(~sky, k * 53 % 640 / 10.0).alias("x"), F.when(~sky, k * 59 % 1600 / 10.0).alias("y"),
        F.when(~sky, k % 20 + 2.0).alias("width"), F.when(~sky, k % 15 + 1.0).alias("height"), F.when(k % 4 == 2, (k % 90).cast("double")).alias("rotation_deg"),
    )


_cx, _cy = sky_to_pix_sql("ra", "dec")
_bnx, _bny = sky_to_pix_sql("ra", "(dec + 1e-4)")
_bex, _bey = sky_to_pix_sql("(ra + 1e-4 / cos(radians(dec)))", "dec")
RECT_SQL = f"""rk AS (
  SELECT 'r' || s_suppkey AS id, s_suppkey AS ord, s_suppkey % 4 = 0 AS sky, s_suppkey * 37 % 300 / 10000e0 + 150.035e0 AS ra, s_suppkey * 91 % 500 / 10000e0 + 2.22e0 AS dec,
         s_suppkey % 50 + 10e0 AS wa, s_suppkey % 30 + 5e0 AS ha, radians((s_suppkey % 180)::DOUBLE) AS pa, s_suppkey * 53 % 640 / 10e0 AS x, s_suppkey * 59 % 1600 / 10e0 AS y,
         s_suppkey % 20 + 2e0 AS w, s_suppkey % 15 + 1e0 AS h, radians((s_suppkey % 90)::DOUBLE) AS rot FROM supplier WHERE s_suppkey % 2 = 0
), rb AS (SELECT *, {_cx} AS bx, {_cy} AS by_, {_bnx} - {_cx} AS nx, {_bny} - {_cy} AS ny, {_bex} - {_cx} AS ex, {_bey} - {_cy} AS ey FROM rk),
rn AS (SELECT *, sqrt(nx * nx + ny * ny) AS nl, CASE WHEN -ny * ex + nx * ey >= 0 THEN 1 ELSE -1 END AS sg FROM rb),
rect AS (
  SELECT id, ord, CASE WHEN sky THEN bx ELSE x + 0.5 END AS cx, CASE WHEN sky THEN by_ ELSE y + 0.5 END AS cy,
         CASE WHEN sky THEN wa / 2 * nl / 1e-4 / 3600 ELSE w / 2 END AS hw, CASE WHEN sky THEN ha / 2 * nl / 1e-4 / 3600 ELSE h / 2 END AS hh,
         CASE WHEN sky THEN cos(pa) * nx / nl - sin(pa) * sg * ny / nl ELSE -sin(rot) END AS vx, CASE WHEN sky THEN cos(pa) * ny / nl + sin(pa) * sg * nx / nl ELSE cos(rot) END AS vy FROM rn
)"""


def polygons(spark, sf):
    """Odd suppliers: five-cornered outlines with a notch, in pixels or on the sky."""
    k = F.col("s_suppkey")
    size = k % 12 + 3.0
    x0, y0 = k * 53 % 640 / 10.0, k * 59 % 1600 / 10.0
    corners = ((0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.5, 0.4), (0.0, 1.0))
    world = F.array(*[F.struct((x0 + size * a).alias("x"), (y0 + size * b).alias("y")) for a, b in corners])
    sky = F.array(
        *[F.struct((k * 37 % 300 / 10000.0 + 150.035 + size * a / 1000.0).alias("ra"), (k * 91 % 500 / 10000.0 + 2.22 + size * b / 1000.0).alias("dec")) for a, b in corners]
    )
    return D.read(spark, sf, "supplier").filter(k % 2 == 1).select(
        F.concat(F.lit("p"), k.cast("string")).alias("id"), k.alias("ord"), F.when(k % 4 == 1, sky).alias("vertices"), F.when(k % 4 == 3, world).alias("world_vertices"),
    )


_vx, _vy = sky_to_pix_sql("(kk * 37 % 300 / 10000e0 + 150.035e0 + size * a / 1000e0)", "(kk * 91 % 500 / 10000e0 + 2.22e0 + size * b / 1000e0)")
POLY_SQL = f"""corner(i, a, b) AS (VALUES (0, 0e0, 0e0), (1, 1e0, 0e0), (2, 1e0, 1e0), (3, 0.5e0, 0.4e0), (4, 0e0, 1e0)), pv AS (
  SELECT 'p' || kk AS id, kk AS ord, i, CASE WHEN kk % 4 = 1 THEN {_vx} ELSE kk * 53 % 640 / 10e0 + size * a + 0.5 END AS x,
         CASE WHEN kk % 4 = 1 THEN {_vy} ELSE kk * 59 % 1600 / 10e0 + size * b + 0.5 END AS y
  FROM (SELECT s_suppkey AS kk, s_suppkey % 12 + 3e0 AS size FROM supplier WHERE s_suppkey % 2 = 1), corner
), pe AS (SELECT a.id, a.ord, a.i, a.x, a.y, b.x AS ox, b.y AS oy FROM pv a JOIN pv b ON a.id = b.id AND b.i = (a.i + 4) % 5)"""


@query(
    "rect_resolve",
    f"""WITH {RECT_SQL} SELECT id, {", ".join(f"{rs(e, 4)} AS {n}" for e, n in (("cx", "cx"), ("cy", "cy"), ("hw", "half_w"), ("hh", "half_h"), ("vy", "ux"), ("-vx", "uy"), ("vx", "vx"), ("vy", "vy"), ("sqrt(hw * hw + hh * hh)", "bound_radius")))} FROM rect""",
)
def rect_resolve(spark, sf):
    out = REG.resolve_rects(rects(spark, sf), fixed_wcs())
    return out.select("id", *[r(c, 4).alias(c) for c in ("cx", "cy", "half_w", "half_h", "ux", "uy", "vx", "vy", "bound_radius")])


@query(
    "polygon_summary",
    f"""WITH {POLY_SQL}, c AS (SELECT id, avg(x) AS cx, avg(y) AS cy, sum(ox * y - x * oy) AS area2, sum(sqrt((x - ox) ** 2 + (y - oy) ** 2)) AS len FROM pe GROUP BY id),
f AS (SELECT id, sqrt((x - ox) ** 2 + (y - oy) ** 2) AS first_side FROM pe WHERE i = 1)
SELECT id, {rs("any_value(cx)")} AS cx, {rs("any_value(cy)")} AS cy, {rs("max(sqrt((x - cx) ** 2 + (y - cy) ** 2))")} AS bound_radius, {rs("any_value(area2)")} AS area2,
       {rs("any_value(len)")} AS outline, {rs("any_value(first_side)")} AS first_side, 6::BIGINT AS marks
FROM pv JOIN c USING (id) JOIN f USING (id) GROUP BY id""",
)
def polygon_summary(spark, sf):
    p = REG.resolve_polygons(polygons(spark, sf), fixed_wcs()).withColumn("arc", G.arc_lengths(F.col("verts")))
    return p.select(
        "id", r("cx").alias("cx"), r("cy").alias("cy"), r("bound_radius").alias("bound_radius"), r(G.signed_area2(F.col("verts"))).alias("area2"),
        r(F.element_at("arc", -1)).alias("outline"), r(F.col("arc")[1]).alias("first_side"), F.size("arc").cast("bigint").alias("marks"),
    )


def regions(spark, sf):
    return REG.all_regions(REG.resolve_rects(rects(spark, sf), fixed_wcs()), REG.resolve_polygons(polygons(spark, sf), fixed_wcs()))


@query(
    "region_bounds",
    f"""WITH {RECT_SQL}, {POLY_SQL}, pc AS (SELECT id, avg(x) AS cx, avg(y) AS cy FROM pv GROUP BY id), b AS (
  SELECT sqrt(hw * hw + hh * hh) AS br FROM rect UNION ALL SELECT max(sqrt((x - cx) ** 2 + (y - cy) ** 2)) FROM pv JOIN pc USING (id) GROUP BY id)
SELECT {rs("max(br)", 4)} AS max_bound, count(*)::BIGINT AS n FROM b""",
)
def region_bounds(spark, sf):
    return REG.largest_bound(regions(spark, sf)).select(r("max_bound", 4).alias("max_bound"), *big("n"))


HIT_SQL = f"""hit AS (
  SELECT c.id AS point_id, r.id, r.ord, 'rect' AS shape FROM cat c, rect r
  WHERE abs((px - cx) * vy - (py - cy) * vx) <= hw AND abs((px - cx) * vx + (py - cy) * vy) <= hh
  UNION ALL
  SELECT c.id, e.id, any_value(e.ord), 'polygon' FROM cat c JOIN pe e ON (e.y > py) <> (e.oy > py) AND px < e.ox + (py - e.oy) / (e.y - e.oy) * (e.x - e.ox)
  GROUP BY c.id, e.id HAVING count(*) % 2 = 1
)"""


def region_points(spark, sf):
    return catalog(spark, sf).select(F.col("id").alias("point_id"), "px", "py")


@query("points_in_regions", f"WITH {CAT_SQL}, {RECT_SQL}, {POLY_SQL}, {HIT_SQL} SELECT point_id, id, shape FROM hit")
def points_in_regions(spark, sf):
    return REG.points_in_regions(region_points(spark, sf), regions(spark, sf), 2.0).select("point_id", "id", "shape")


@query(
    "topmost_region",
    f"""WITH {CAT_SQL}, {RECT_SQL}, {POLY_SQL}, {HIT_SQL}
SELECT point_id, arg_max(id, CASE WHEN shape = 'polygon' THEN 1000000000 ELSE 0 END + ord) AS region, count(*)::BIGINT AS n FROM hit GROUP BY point_id""",
)
def topmost_region(spark, sf):
    return REG.topmost_region_at(region_points(spark, sf), regions(spark, sf), 2.0).select("point_id", "region", *big("n"))


PATCH_SQL = """base AS (
  SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN c_custkey % 360 END::DOUBLE AS ra, CASE WHEN c_custkey % 2 = 0 THEN c_custkey % 90 END::DOUBLE AS dec,
         CASE WHEN c_custkey % 2 = 1 THEN c_custkey % 64 END::DOUBLE AS x, CASE WHEN c_custkey % 2 = 1 THEN c_custkey % 167 END::DOUBLE AS y, (c_custkey % 9)::DOUBLE AS width, c_mktsegment AS label FROM customer
), patch AS (
  SELECT c_custkey AS id, CASE WHEN c_custkey % 15 = 0 THEN 7 END::DOUBLE AS x, CASE WHEN c_custkey % 30 = 0 THEN 8 END::DOUBLE AS y, CASE WHEN c_custkey % 21 = 0 THEN 9 END::DOUBLE AS ra,
         CASE WHEN c_custkey % 5 = 0 THEN (c_custkey % 4) END::DOUBLE AS width, CASE WHEN c_custkey % 25 = 0 THEN 'NEW' END AS label FROM customer WHERE c_custkey % 3 = 0 OR c_custkey % 5 = 0
), j AS (
  SELECT b.id, b.ra AS ra0, b.dec AS dec0, b.x AS x0, b.y AS y0, b.width AS w0, b.label AS l0,
         CASE WHEN p.x IS NOT NULL OR p.y IS NOT NULL THEN NULL ELSE coalesce(p.ra, b.ra) END AS ra1, CASE WHEN p.x IS NOT NULL OR p.y IS NOT NULL THEN NULL ELSE b.dec END AS dec1,
         CASE WHEN p.ra IS NOT NULL THEN NULL ELSE coalesce(p.x, b.x) END AS x1, CASE WHEN p.ra IS NOT NULL THEN NULL ELSE coalesce(p.y, b.y) END AS y1,
         coalesce(p.width, b.width) AS w1, coalesce(p.label, b.label) AS l1 FROM base b LEFT JOIN patch p USING (id) WHERE b.id % 50 <> 7
), k AS (SELECT *, (ra1 IS NOT NULL AND dec1 IS NOT NULL) OR (x1 IS NOT NULL AND y1 IS NOT NULL) AS ok FROM j)"""


@query(
    "catalog_upsert",
    f"""WITH {PATCH_SQL}
SELECT id::BIGINT AS id, {", ".join(f"CASE WHEN ok THEN {a}1 ELSE {a}0 END AS {n}" for a, n in (("ra", "ra"), ("dec", "dec"), ("x", "x"), ("y", "y"), ("w", "width"), ("l", "label")))},
       ok AND (ra0 IS DISTINCT FROM ra1 OR dec0 IS DISTINCT FROM dec1 OR x0 IS DISTINCT FROM x1 OR y0 IS DISTINCT FROM y1 OR w0 IS DISTINCT FROM w1) AS geometry_changed FROM k""",
)
def catalog_upsert(spark, sf):
    k = F.col("c_custkey")
    d = lambda test, v: F.when(test, v).cast("double")
    c = D.read(spark, sf, "customer")
    base = c.select(
        k.alias("id"), d(k % 2 == 0, k % 360).alias("ra"), d(k % 2 == 0, k % 90).alias("dec"), d(k % 2 == 1, k % 64).alias("x"), d(k % 2 == 1, k % 167).alias("y"),
        (k % 9).cast("double").alias("width"), F.col("c_mktsegment").alias("label"),
    )
    patch = c.filter((k % 3 == 0) | (k % 5 == 0)).select(
        k.alias("id"), d(k % 15 == 0, F.lit(7)).alias("x"), d(k % 30 == 0, F.lit(8)).alias("y"), d(k % 21 == 0, F.lit(9)).alias("ra"), d(k % 5 == 0, k % 4).alias("width"),
        F.when(k % 25 == 0, "NEW").alias("label"),
    )
    gone = c.filter(k % 50 == 7).select(k.alias("id"))
    return REG.apply_patches(base, patch, gone).select(*big("id"), "ra", "dec", "x", "y", "width", "label", "geometry_changed")
