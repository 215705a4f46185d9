"""Pyramid manifests, datasets and headers as JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from starloom.functions.let import let
from starloom.operators.inventory import card_scalar, json_text
from starloom.operators.validate import non_finite

MANIFEST = (
    "version int, source_file string, native_shape array<int>, fpack_tile_size int, n_levels int, "
    "levels array<struct<z int, filename string, compression string, lossless boolean, shape array<int>, "
    "fpack_tile_count array<int>, pixel_scale_arcsec double, wcs map<string,string>, "
    "supertiles array<struct<filename string, tile_origin array<int>, tile_count array<int>>>>>"
)


def manifest_levels(manifests: DataFrame) -> DataFrame:
    """One row per level of parsed manifests (``path`` and the MANIFEST columns).

    A level without supertiles (the old form) becomes one supertile over its whole grid.
    """
    lv = manifests.select("path", F.coalesce("version", F.lit(1)).alias("version"), F.coalesce("n_levels", F.size("levels") - 1).alias("n_levels"), "native_shape", F.coalesce("fpack_tile_size", F.lit(256)).alias("tile_size"), F.explode("levels").alias("l"))
    whole = F.array(
        F.struct(
            F.col("l.filename").alias("filename"), F.array(F.lit(0), F.lit(0)).alias("tile_origin"),
            F.array(F.col("l.fpack_tile_count")[1], F.col("l.fpack_tile_count")[0]).alias("tile_count"),
        )
    )
    return lv.select(
        "path", "version", "n_levels", "tile_size", F.col("native_shape")[0].alias("img_h"), F.col("native_shape")[1].alias("img_w"),
        "l.z", "l.compression", "l.lossless", F.col("l.shape")[0].alias("h"), F.col("l.shape")[1].alias("w"),
        F.col("l.fpack_tile_count")[0].alias("n_ty"), F.col("l.fpack_tile_count")[1].alias("n_tx"),
        "l.pixel_scale_arcsec", "l.wcs", F.coalesce("l.supertiles", whole).alias("supertiles"),
    )


def manifest_supertiles(levels: DataFrame) -> DataFrame:
    s = levels.select("path", "z", F.posexplode("supertiles").alias("idx", "s"))
    return s.select(
        "path", "z", "idx", "s.filename", F.col("s.tile_origin")[0].alias("tx0"), F.col("s.tile_origin")[1].alias("ty0"),
        F.col("s.tile_count")[0].alias("nx"), F.col("s.tile_count")[1].alias("ny"),
    )


def read_manifests(spark: SparkSession, folder: str) -> DataFrame:
    """All manifest files below a folder."""
    text = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "manifest.json").text(folder)
    return parse_manifests(text.select(F.input_file_name().alias("path"), F.col("value").alias("json")))


def parse_manifests(texts: DataFrame) -> DataFrame:
    """``path, json`` and the MANIFEST columns. A field of another type is null among these; ``json`` still tells."""
    return texts.select("path", "json", F.from_json("json", MANIFEST).alias("_m")).select("path", "json", "_m.*")


def _kind(value: Column) -> Column:
    """number, text, flag, list, object or null as JSON has it; NULL where there is nothing."""

    def named(name: Column) -> Column:
        number = name.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL|TINYINT|SMALLINT|INT)")
        return (
            F.when(number, "number").when(name.startswith("ARRAY"), "list").when(name.startswith("OBJECT"), "object")
            .when(name == "STRING", "text").when(name == "BOOLEAN", "flag").when(name == "VOID", "null").otherwise(name)
        )

    return let(F.schema_of_variant(value), named)


def _wrong_types(json: Column, whole: Column) -> dict[str, Column]:
    """By rule: a field that may be missing is there with a type it can't have. The types are those of the text, read as a variant (``whole``)."""
    at = lambda path: F.try_variant_get(whole, path, "variant")
    other = lambda value, kind: F.coalesce(_kind(value) != kind, F.lit(False))
    levels = F.coalesce(F.try_variant_get(whole, "$.levels", "array<variant>"), F.array().cast("array<variant>"))
    fraction = F.coalesce(F.try_variant_get(whole, "$.version", "double") % 1 != 0, F.lit(False))
    return {
        "json": json.isNotNull() & ~F.coalesce(_kind(whole) == "object", F.lit(False)),
        "version": other(at("$.version"), "number") | fraction,
        "levels": other(at("$.n_levels"), "number") | F.coalesce(F.try_variant_get(whole, "$.n_levels", "double") % 1 != 0, F.lit(False)) | F.exists(levels, lambda x: other(F.try_variant_get(x, "$.z", "variant"), "number")),
        "supertiles": F.exists(levels, lambda x: other(F.try_variant_get(x, "$.supertiles", "variant"), "list")),
    }


def manifest_violations(manifests: DataFrame) -> DataFrame:
    """entity, rule, detail of parsed manifests (``path`` and the MANIFEST columns), a row for each rule broken.

    A missing version is the old one and a missing n_levels is derived; everything else has to be there. With the text in
    ``json`` (see :func:`parse_manifests`), a version, n_levels or supertiles of a wrong type is told from a missing one.
    """
    pair = lambda c: F.coalesce((F.size(c) == 2) & F.forall(c, lambda x: x.isNotNull()), F.lit(False))
    levels = F.coalesce("levels", F.array().cast(manifests.schema["levels"].dataType))
    any_level = lambda test: F.exists(levels, lambda x: F.coalesce(test(x), F.lit(True)))
    zs = F.array_sort(F.transform(levels, lambda x: x["z"]))
    deepest = F.size(levels) - 1
    bad_supertile = lambda t: F.coalesce(t["filename"].isNull() | ~pair(t["tile_origin"]) | ~pair(t["tile_count"]), F.lit(True))
    rules = [
        ("no_levels", F.size(levels) == 0, F.lit(None)),
        ("version", F.col("version").isNotNull() & ~F.col("version").isin(1, 2), F.col("version")),
        ("native_shape", ~pair(F.col("native_shape")), F.to_json("native_shape")),
        ("levels", (F.size(levels) > 0) & ((F.coalesce("n_levels", deepest) != deepest) | F.coalesce(zs != F.sequence(F.lit(0), F.greatest(deepest, F.lit(0))), F.lit(True))), F.to_json(zs)),
        ("shape", any_level(lambda x: ~pair(x["shape"])), F.lit(None)),
        ("tile_count", any_level(lambda x: ~pair(x["fpack_tile_count"])), F.lit(None)),
        ("filename", any_level(lambda x: x["supertiles"].isNull() & x["filename"].isNull()), F.lit(None)),
        ("supertiles", any_level(lambda x: x["supertiles"].isNotNull() & (F.size(x["supertiles"]) == 0)), F.lit(None)),
        ("supertile", any_level(lambda x: x["supertiles"].isNotNull() & F.exists(x["supertiles"], bad_supertile)), F.lit(None)),
    ]
    if "json" in manifests.columns:
        # A column of its own: inside the rules the text would be parsed again for each of them.
        manifests = manifests.withColumn("_whole", F.try_parse_json("json"))
        wrong = _wrong_types(F.col("json"), F.col("_whole"))
        rules = [("json", wrong["json"], F.lit(None)), *[(rule, bad | wrong[rule] if rule in wrong else bad, detail) for rule, bad, detail in rules]]
    broken = F.filter(
        F.array(*[F.when(F.coalesce(bad, F.lit(True)), F.struct(F.lit(rule).alias("rule"), detail.cast("string").alias("detail"))) for rule, bad, detail in rules]), lambda v: v.isNotNull()
    )
    return manifests.select(F.col("path").alias("entity"), F.explode(broken).alias("v")).select("entity", "v.rule", "v.detail")


def manifest_json(levels: DataFrame, supertiles: DataFrame, key: str = "band") -> DataFrame:
    """key, json: one manifest per pyramid. ``levels``: key, source_file, tile_size, img_h, img_w, z,
    h, w, n_ty, n_tx, pixel_scale_arcsec, wcs; ``supertiles``: key, z, idx, filename, tx0, ty0, nx, ny."""
    st = supertiles.groupBy(key, "z").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("idx", "filename", "tx0", "ty0", "nx", "ny"))),
            lambda s: F.struct(
                s["filename"].alias("filename"), F.array(s["tx0"], s["ty0"]).alias("tile_origin"), F.array(s["nx"], s["ny"]).alias("tile_count")
            ),
        ).alias("supertiles")
    )
    level = F.struct(
        "z", F.col("supertiles")[0]["filename"].alias("filename"), F.lit("RICE_1").alias("compression"), F.lit(False).alias("lossless"),
        F.array("h", "w").alias("shape"), F.array("n_ty", "n_tx").alias("fpack_tile_count"), "pixel_scale_arcsec", "wcs", "supertiles",
    )
    # A pyramid has at most about 40 levels.
    return (
        levels.join(st, [key, "z"])
        .groupBy(key, "source_file", "tile_size", "img_h", "img_w")
        .agg(F.array_sort(
            F.collect_list(F.struct(F.col("z"), level.alias("l"))), lambda a, b: a["z"] - b["z"]
        ).alias("_l"))
        .select(
            key,
            F.to_json(
                F.struct(
                    F.lit(2).alias("version"), "source_file", F.array("img_h", "img_w").alias("native_shape"),
                    F.col("tile_size").alias("fpack_tile_size"), (F.size("_l") - 1).alias("n_levels"), F.transform("_l", lambda e: e["l"]).alias("levels"),
                )
            ).alias("json"),
        )
    )


def header_json(cards: DataFrame, file: str = "file") -> DataFrame:
    """file, json: the ordered card list of each header, values with their type. A header holds some hundred cards."""
    card = F.concat(
        F.lit('{"keyword":'), json_text(F.col("keyword")), F.lit(',"value":'), card_scalar(F.col("value"), F.col("is_text")), F.lit(',"comment":'), json_text(F.col("comment")), F.lit("}")
    )
    per = cards.groupBy(file).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("card_no", card.alias("json")))), lambda c: c["json"]), ",").alias("cards"))
    return per.select(file, F.concat(F.lit('{"version":1,"source_file":'), json_text(F.col(file).cast("string")), F.lit(',"cards":['), "cards", F.lit("]}")).alias("json"))


def dataset_json(bands: DataFrame, rgb: DataFrame, key: str = "dataset") -> DataFrame:
    """key, json: bands in order with their grids, and the default colour roles or null."""
    grids = ["ctype1", "ctype2"]
    band = F.struct(
        F.col("band").alias("name"), "path", *grids, F.array("h", "w").alias("shape"), F.array("crpix1", "crpix2").alias("crpix"),
        F.array("crval1", "crval2").alias("crval"), F.array("cd11", "cd12", "cd21", "cd22").alias("cd"), "pixel_scale_arcsec", "grid_hash",
    )
    per = bands.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col("ord"), band.alias("b")))), lambda e: e["b"]).alias("bands"))
    both = per.join(rgb.select(key, F.struct("r", "g", "b").alias("default_rgb")), key, "left")
    return both.select(key, F.to_json(F.struct(F.lit(1).alias("version"), "bands", "default_rgb"), {"ignoreNullFields": "false"}).alias("json"))


def collection_json(cards: DataFrame, name: str, title: str | None = None) -> DataFrame:
    """One JSON line per card; the head (version, name, title) rides on every line, so no task holds them all."""
    centre = F.when(F.col("center_ra").isNotNull(), F.struct(F.col("center_ra").alias("ra"), F.col("center_dec").alias("dec")))
    field = F.struct(F.col("field").alias("name"), "title", F.col("band_count").alias("bandCount"), centre.alias("center"))
    head = F.struct(F.lit(name).alias("name"), F.lit(title).alias("title"))
    return cards.select("field", F.to_json(F.struct(F.lit(1).alias("schemaVersion"), head.alias("collection"), field.alias("field"))).alias("json"))


def config_json(bands: DataFrame, views: DataFrame, key: str = "dataset") -> DataFrame:
    """key, json: display configuration. ``bands``: key, band, label, path, grid_group,
    pixel_scale_arcsec, pivot_um, ord; ``views`` from inventory.default_views."""
    entry = F.struct(
        F.col("band").alias("name"), F.array("path").alias("tiles"),
        F.struct(F.col("grid_group").alias("group"), F.col("pixel_scale_arcsec").alias("pixelScaleArcsec")).alias("grid"),
        "label", F.col("pivot_um").alias("pivotUm"),
    )
    per = bands.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col("ord"), entry.alias("b")))), lambda e: e["b"]).alias("bands"))
    view = F.struct("mode", "band", "r", "g", "b")
    return per.join(views, key).select(
        key, F.to_json(F.struct(F.lit(1).alias("schemaVersion"), F.struct(F.col(key).alias("name"), "bands").alias("dataset"), view.alias("defaultView"))).alias("json")
    )


def write_json(df: DataFrame, path: str, key: str, numbers: DataFrame | None = None, number_columns: list[str] | None = None) -> None:
    """Write ``json`` lines, one folder per key; refuses numbers JSON cannot carry."""
    if numbers is not None and not non_finite(numbers, key, number_columns or []).isEmpty():
        raise ValueError("metadata holds NaN or infinite numbers")
    df.select(key, F.col("json").alias("value")).write.mode("overwrite").partitionBy(key).text(path)
