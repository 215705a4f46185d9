"""Rules on metadata tables. Each returns violations: entity, rule, detail."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from starloom.functions.stretch import MAX_BANDS


def _violation(entity: Column, rule: str, detail: Column) -> list[Column]:
    return [entity.cast("string").alias("entity"), F.lit(rule).alias("rule"), detail.cast("string").alias("detail")]


def _finite(c: Column) -> Column:
    return F.coalesce(~F.isnan(c) & (F.abs(c) != float("inf")), F.lit(False))


def pixel_scales(levels: DataFrame) -> DataFrame:
    """Levels whose scale is missing, not finite or not positive."""
    s = F.col("pixel_scale_arcsec")
    return levels.filter(~(_finite(s) & F.coalesce(s > 0, F.lit(False)))).select(
        *_violation(F.concat_ws("/", "band", "z"), "pixel_scale", s)
    )


def default_rgb(views: DataFrame, bands: DataFrame) -> DataFrame:
    """Default colour roles (dataset, roles MAP<STRING, STRING>) must be exactly r, g, b and name bands."""
    keys = F.array_sort(F.map_keys("roles"))
    wrong = views.filter(keys != F.array(F.lit("b"), F.lit("g"), F.lit("r"))).select(
        *_violation(F.col("dataset"), "roles", F.concat_ws(",", keys))
    )
    named = views.select("dataset", F.explode("roles").alias("role", "band"))
    unknown = named.join(bands.select("dataset", "band"), ["dataset", "band"], "left_anti").select(
        *_violation(F.col("dataset"), "unknown_band", F.concat_ws("=", "role", "band"))
    )
    return wrong.unionByName(unknown)


def rgb_spans_groups(views: DataFrame, bands: DataFrame) -> DataFrame:
    """Colour views whose bands lie on more than one grid group (a warning). views: dataset, r, g, b."""
    roles = views.select("dataset", F.explode(F.array("r", "g", "b")).alias("band"))
    return (
        roles.join(bands.select("dataset", "band", "grid_group"), ["dataset", "band"])
        .groupBy("dataset")
        .agg(F.count_distinct("grid_group").alias("n"))
        .filter("n > 1")
        .select(*_violation(F.col("dataset"), "rgb_spans_groups", F.col("n")))
    )


def heap_overflow(tables: DataFrame) -> DataFrame:
    """Compressed tables (entity, tforms ARRAY<STRING>, pcount) with 32-bit descriptors and a heap past 2 GiB."""
    narrow = F.exists("tforms", lambda t: t.contains("P") & ~t.contains("Q"))
    return tables.filter(narrow & (F.col("pcount") >= 2**31)).select(*_violation(F.col("entity"), "heap_overflow", F.col("pcount")))


def tile_tables(tables: DataFrame) -> DataFrame:
    """Row count against the tile grid, compression word, and the scale column of quantised tables.

    ``tables``: entity, zcmptype, has_zscale, n_rows, znaxis1, znaxis2, ztile1, ztile2.
    """
    expected = F.ceil(F.col("znaxis1") / F.col("ztile1")) * F.ceil(F.col("znaxis2") / F.col("ztile2"))
    checks = [
        ("compression", ~F.col("zcmptype").isin("RICE_1", "GZIP_2"), F.col("zcmptype")),
        ("no_zscale", (F.col("zcmptype") == "RICE_1") & ~F.col("has_zscale"), F.col("zcmptype")),
        ("row_count", F.col("n_rows") != expected, F.col("n_rows").cast("string")),
    ]
    # One pass: the rules a table breaks are listed in its row, then exploded.
    broken = F.filter(
        F.array(*[F.when(bad, F.struct(F.lit(rule).alias("rule"), detail.alias("detail"))) for rule, bad, detail in checks]),
        lambda v: v.isNotNull(),
    )
    return tables.select(F.col("entity").cast("string").alias("entity"), F.explode(broken).alias("_v")).select(
        "entity", "_v.rule", "_v.detail"
    )


def view_weights(weights: DataFrame, bands: DataFrame | None = None) -> DataFrame:
    """Weights of views (view, band, weight ARRAY<DOUBLE>): 3 finite numbers each, at most 12 bands, and only ``bands`` (band) if given."""
    bad = weights.filter((F.size("weight") != 3) | F.exists("weight", lambda x: ~_finite(x))).select(
        *_violation(F.concat_ws("/", "view", "band"), "weight", F.size("weight"))
    )
    many = weights.groupBy("view").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > MAX_BANDS).select(
        *_violation(F.col("view"), "too_many_bands", F.col("n"))
    )
    out = bad.unionByName(many)
    if bands is None:
        return out
    unknown = weights.join(bands.select("band").distinct(), "band", "left_anti")
    return out.unionByName(unknown.select(*_violation(F.concat_ws("/", "view", "band"), "unknown_band", F.lit(None))))


def path_escapes(paths: DataFrame, relative: Column) -> DataFrame:
    """Paths that do not lie under their root (``relative`` is NULL)."""
    return paths.filter(relative.isNull()).select(*_violation(F.col("path"), "outside_root", F.lit(None)))


def non_finite(metadata: DataFrame, entity: str, columns: list[str]) -> DataFrame:
    """Numbers that JSON cannot carry."""
    bad = F.filter(
        F.array(*[F.when(F.col(c).isNotNull() & ~_finite(F.col(c)), F.lit(c)) for c in columns]), lambda c: c.isNotNull()
    )
    return metadata.select(entity, F.explode(bad).alias("_c")).select(*_violation(F.col(entity), "not_finite", F.col("_c")))
