"""Header inventories: cards, bands, default views, names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from starloom.functions import bands as B, cards as C, naming as N
from starloom.operators.ordering import with_row_number
from starloom.session import materialise


def header_cards(headers: DataFrame, text: str = "header", keys: list[str] | None = None) -> DataFrame:
    """Cards of fixed-width header text: keys, card_no, keyword, value, comment, is_value, is_text.

    Cards are read up to END. A value card has ``= `` in columns 9 and 10; quoted values
    keep inner text with doubled quotes undone and trailing blanks dropped, and are text.
    """
    keys = keys or [c for c in headers.columns if c != text]
    live = headers.select(*keys, F.posexplode(C.split_cards(F.col(text))).alias("card_no", "card"))
    raw = F.substring("card", 11, C.CARD)
    is_value = C.is_value_card(F.col("card"))
    return live.select(
        *keys, "card_no", C.card_keyword(F.col("card")).alias("keyword"),
        F.when(is_value, C.card_value(raw)).alias("value"),
        F.when(is_value, C.card_comment(raw)).otherwise(F.trim(F.substring("card", 9, C.CARD))).alias("comment"),
        is_value.alias("is_value"),
        (is_value & C.is_quoted(raw)).alias("is_text"),
    )


def merge_headers(cards: DataFrame, file: str = "file") -> DataFrame:
    """One value per file and keyword; the later HDU overrides, within an HDU the first card wins."""
    per_hdu = cards.filter("is_value").groupBy(file, "keyword", "hdu").agg(F.min_by("value", "card_no").alias("value"))
    return per_hdu.groupBy(file, "keyword").agg(F.max_by("value", "hdu").alias("value"))


def json_text(c: Column) -> Column:
    """A string as JSON, ``null`` for NULL."""
    return F.coalesce(F.nullif(F.regexp_extract(F.to_json(F.struct(c.alias("s"))), r'(?s)^\{"s":(.*)\}$', 1), F.lit("")), F.lit("null"))


def card_scalar(value: Column, is_text: Column) -> Column:
    """A card's value as a JSON scalar: text, true or false, a number; an empty value or a number that JSON
    cannot carry is null; anything else is text."""
    plain = F.upper(F.trim(value))
    whole = F.when(plain.rlike(r"^[+-]?\d{1,18}$"), plain.try_cast("bigint").cast("string"))
    number = F.when(plain.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([ED][+-]?\d+)?$"), F.regexp_replace(plain, "D", "E").try_cast("double"))
    real = F.when(number.isNotNull(), F.when(F.abs(number) != float("inf"), number.cast("string")).otherwise(F.lit("null")))
    bare = F.coalesce(
        F.when((plain == "") | plain.isin("NAN", "INF", "+INF", "-INF"), F.lit("null")), F.when(plain == "T", F.lit("true")), F.when(plain == "F", F.lit("false")), whole, real
    )
    return F.when(value.isNull(), F.lit("null")).when(is_text, json_text(value)).otherwise(F.coalesce(bare, json_text(value)))


def input_rejects(hdus: DataFrame) -> DataFrame:
    """Files that cannot be tiled: not exactly one 2-D image, or a distorted projection.

    ``hdus``: file, hdu, naxis, ctype1, ctype2.
    """
    counts = hdus.groupBy("file").agg(
        F.count(F.when(F.col("naxis") >= 2, 1)).alias("images"),
        F.count(F.when(F.col("naxis") == 2, 1)).alias("planes"),
        F.bool_or(
            (F.col("naxis") == 2)
            & (F.coalesce("ctype1", F.lit("")).rlike("-(SIP|TPV)") | F.coalesce("ctype2", F.lit("")).rlike("-(SIP|TPV)"))
        ).alias("distorted"),
    )
    rule = (
        F.when(F.col("images") == 0, "no_image")
        .when(F.col("planes") > 1, "several_planes")
        .when(F.col("planes") == 0, "not_two_dimensional")
        .when(F.col("distorted"), "distortion")
    )
    return counts.select(F.col("file").alias("entity"), rule.alias("rule"), F.col("planes").cast("string").alias("detail")).filter("rule is not null")


def _pivoted(df: DataFrame, key: str, filt: str) -> DataFrame:
    """Adds pivot_um from the table by (key, filter), else from the filter number."""
    table = B.pivot_table(df.sparkSession)
    joined = df.join(
        F.broadcast(table), (F.col(key) == table["lookup_key"]) & (F.col(filt) == table["filter"]), "left"
    )
    return joined.select(*[df[c] for c in df.columns], F.coalesce(table["pivot_um"], B.pivot_estimate(F.col(key), F.col(filt))).alias("pivot_um"))


def _by_header(files: DataFrame, keys: list[str]) -> DataFrame:
    """Adds _key, _hf (filter, NULL if unknown) and _hl (table key) from the header words."""
    keyed = files.withColumn("_key", B.instrument_key(F.col("telescop"), F.col("instrume")))
    return keyed.withColumn(
        "_hf", B.header_filter(F.col("_key"), *[F.col(c) for c in ("filter", "pupil", "filter1", "filter2")])
    ).withColumn("_hl", B.lookup_key(F.col("_key"), F.col("detector")))


def _by_name(files: DataFrame, name: str) -> DataFrame:
    """Adds _nf, _nk (instrument token or NULL), _nl (table key), _ni, _nt from the file name."""
    spark = files.sparkSession
    # Both tables are fixed: 84 and 6 rows.
    prefs = spark.createDataFrame([(*row, i) for i, row in enumerate(B.PREFERENCE)], "lookup_key string, telescope string, instrument string, pref int")
    choices = B.pivot_table(spark).join(F.broadcast(prefs), "lookup_key").groupBy(F.col("filter").alias("_nf")).agg(
        F.min_by(F.struct("lookup_key", "telescope", "instrument"), "pref").alias("_first"),
        F.bool_or(F.col("lookup_key") == "WFC3/IR").alias("_ir"),
    )
    tokens = files.withColumn("_nf", B.only(B.name_filters(F.col(name)))).withColumn(
        "_nk", B.only(B.name_instruments(F.col(name)))
    )
    joined = tokens.join(F.broadcast(choices), "_nf", "left")
    told = F.col("_nk").isNotNull()
    wfc3 = F.when(F.col("_ir"), "WFC3/IR").otherwise("WFC3/UVIS")
    own = F.when(F.col("_nk") == "WFC3", wfc3).otherwise(F.col("_nk"))
    return (
        joined.withColumn("_nl", F.when(told, own).otherwise(F.coalesce("_first.lookup_key", F.lit("NIRCAM"))))
        .withColumn("_ni", F.when(told, B.by_instrument(F.col("_nk"), 1)).otherwise(F.coalesce("_first.instrument", F.lit(""))))
        .withColumn("_nt", F.when(told, B.by_instrument(F.col("_nk"), 0)).otherwise(F.coalesce("_first.telescope", F.lit(""))))
        .drop("_first", "_ir")
    )


def _finish(df: DataFrame, keys: list[str], filt: Column, lookup: Column, instrument: Column, telescope: Column) -> DataFrame:
    rows = df.select(
        *keys, filt.alias("band_filter"), lookup.alias("_lookup"), instrument.alias("instrument"), telescope.alias("telescope")
    ).filter("band_filter is not null")
    return _pivoted(rows, "_lookup", "band_filter").select(
        *keys, "band_filter", "instrument", "telescope", "pivot_um", B.is_broadband(F.col("band_filter")).alias("is_broadband")
    )


def detect_from_headers(headers: DataFrame, keys: list[str]) -> DataFrame:
    """keys, band_filter, instrument, telescope, pivot_um, is_broadband; files without a band have no row.

    ``headers``: keys, telescop, instrume, filter, pupil, filter1, filter2, detector.
    """
    key = F.col("_key")
    return _finish(_by_header(headers, keys), keys, F.col("_hf"), F.col("_hl"), B.by_instrument(key, 1), B.by_instrument(key, 0))


def detect_from_names(files: DataFrame, keys: list[str], name: str = "name") -> DataFrame:
    """As :func:`detect_from_headers`, from one filter token and at most one instrument token in the name.

    Without an instrument the first in a fixed preference whose table lists the filter is
    taken; with none the instrument stays empty.
    """
    return _finish(_by_name(files, name), keys, *[F.col(c) for c in ("_nf", "_nl", "_ni", "_nt")])


def detect_bands(files: DataFrame, keys: list[str], name: str = "name") -> DataFrame:
    """Header detection, with the file name as the fallback; one pass, no shuffle."""
    both = _by_name(_by_header(files, keys), name)
    known, key = F.col("_hf").isNotNull(), F.col("_key")
    return _finish(
        both, keys, F.coalesce("_hf", "_nf"), F.when(known, F.col("_hl")).otherwise(F.col("_nl")),
        F.when(known, B.by_instrument(key, 1)).otherwise(F.col("_ni")), F.when(known, B.by_instrument(key, 0)).otherwise(F.col("_nt")),
    )


def contended_filters(bands: DataFrame, key: list[str]) -> DataFrame:
    """Filters seen on more than one instrument (bands without an instrument do not count)."""
    return (
        bands.filter("instrument <> ''")
        .groupBy(*key, "band_filter")
        .agg(F.count_distinct("instrument").alias("instruments"))
        .filter("instruments > 1")
    )


def band_labels(bands: DataFrame, key: list[str]) -> DataFrame:
    """Display label and name seed: the filter, led by the instrument where contended."""
    both = bands.join(contended_filters(bands, key), [*key, "band_filter"], "left")
    split = F.col("instruments").isNotNull() & (F.col("instrument") != "")
    return both.select(
        *[bands[c] for c in bands.columns],
        F.when(split, F.concat_ws(" ", "instrument", "band_filter")).otherwise(F.col("band_filter")).alias("label"),
        F.lower(F.when(split, F.concat_ws("-", "instrument", "band_filter")).otherwise(F.col("band_filter"))).alias("seed"),
    )


def default_views(bands: DataFrame, key: str) -> DataFrame:
    """Default view per dataset (key): RGB of the group with most broadbands, three at least, else single.

    ``bands``: key, name, ord, grid_group, pivot_um, is_broadband. Red is the longest
    wavelength, blue the shortest, green the inner one nearest the middle.
    """
    wide = bands.filter("is_broadband and pivot_um is not null")
    groups = bands.groupBy(key, "grid_group").agg(
        F.min("ord").alias("_first"), F.count(F.when(F.col("is_broadband") & F.col("pivot_um").isNotNull(), 1)).alias("_n")
    )
    best = (
        groups.groupBy(key)
        .agg(F.max_by(F.struct("grid_group", "_n"), F.struct(F.col("_n"), -F.col("_first"))).alias("_b"))
        .select(key, F.col("_b.grid_group").alias("grid_group"), F.col("_b._n").alias("_n"))
    )
    pool = wide.join(best.filter("_n >= 3").select(key, "grid_group"), [key, "grid_group"])
    entry, rank = F.struct("name", "pivot_um", "ord"), F.struct("pivot_um", "ord")
    ends = pool.groupBy(key).agg(F.min_by(entry, rank).alias("_blue"), F.max_by(entry, rank).alias("_red"))
    inner = pool.join(ends, key).filter((F.col("ord") != F.col("_blue.ord")) & (F.col("ord") != F.col("_red.ord")))
    off = F.abs(F.col("pivot_um") - (F.col("_blue.pivot_um") + F.col("_red.pivot_um")) / 2)
    green = inner.groupBy(key).agg(F.min_by("name", F.struct(off, F.col("pivot_um"), F.col("ord"))).alias("g"))
    single = bands.groupBy(key).agg(F.min_by("name", "ord").alias("_single"))
    out = single.join(ends, key, "left").join(green, key, "left")
    rgb = F.col("_red").isNotNull()
    return out.select(
        key, F.when(rgb, "rgb").otherwise("single").alias("mode"), F.when(~rgb, F.col("_single")).alias("band"),
        F.col("_red.name").alias("r"), "g", F.col("_blue.name").alias("b"),
    )


def unique_names(files: DataFrame, keys: list[str], stem: str, order: str = "ord", reserved: tuple[str, ...] = N.RESERVED, max_rounds: int = 100) -> DataFrame:
    """Adds ``slug``: safe for paths, unique within ``keys``, numbered _2, _3.. in order.

    A duplicate takes the next number no earlier row bears by its own name; names that look
    numbered from the start ("a_2") are the only other takers, so a second pass settles all
    but contrived inputs.
    """
    base = N.band_slug(F.col(stem))
    base = F.when(base.isin(*reserved), F.concat(base, F.lit("_1"))).otherwise(base)
    ranked = materialise(with_row_number(files.withColumn("_base", base), [order], "_k", [*keys, "_base"]))
    natural = F.regexp_extract("slug", r"^(.*)_(\d+)$", 1)
    number = F.regexp_extract("slug", r"^(.*)_(\d+)$", 2)
    first = F.when(F.col("_k") == 0, F.col("_base")).otherwise(F.concat(F.col("_base"), F.lit("_"), (F.col("_k") + 1).cast("string")))
    named = ranked.withColumn("slug", first)
    for _ in range(max_rounds):
        named = materialise(named)
        twice = named.groupBy(*keys, "slug").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        if twice.isEmpty():
            return named.drop("_base", "_k")
        # Rows whose name is another base's numbered form, without leading zeros.
        takers = named.select(*keys, natural.alias("_b"), number.alias("_d"), F.col("_base").alias("_from"), F.col(order).alias("_o")).filter(
            (F.col("_b") != "") & (F.col("_b") != F.col("_from")) & F.col("_d").rlike("^[1-9][0-9]{0,8}$")
        )
        blocked = takers.groupBy(*keys, F.col("_b").alias("_base")).agg(
            F.array_sort(F.collect_list(F.struct(F.col("_d").cast("bigint").alias("d"), F.col("_o").alias("o")))).alias("_takers")
        )
        # A base may itself be taken as the numbered form of another base.
        owned = named.select(*keys, F.col("slug").alias("_base"), F.col("_base").alias("_from"), F.col(order).alias("_o")).filter(
            F.col("_base") != F.col("_from")
        ).groupBy(*keys, "_base").agg(F.min("_o").alias("_owner"))
        j = ranked.join(blocked, [*keys, "_base"], "left").join(owned, [*keys, "_base"], "left")
        shift = F.when(F.col("_owner").isNotNull() & (F.col("_owner") < F.col("_start")), 1).otherwise(0)
        starts = ranked.groupBy(*keys, "_base").agg(F.min(order).alias("_start"))
        j = j.join(starts, [*keys, "_base"]).withColumn("_n", F.col("_k") + shift)
        number_of = F.aggregate(
            F.coalesce("_takers", F.array().cast("array<struct<d:bigint,o:bigint>>")),
            F.col("_n") + 1,
            lambda n, t: F.when((t["d"] <= n) & (t["d"] >= 2) & (t["o"] < F.col(order)), n + 1).otherwise(n),
        )
        named = j.withColumn(
            "slug", F.when(F.col("_n") == 0, F.col("_base")).otherwise(F.concat(F.col("_base"), F.lit("_"), number_of.cast("string")))
        ).select(*ranked.columns, "slug")
    raise RuntimeError("names did not settle")
