"""Source catalogs as CSV text."""

from __future__ import annotations

import csv

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from starloom.operators.catalog import KNOWN, check_columns, placeable, with_ids

VERSION = 1
VERSION_PATTERN = r"(?i)^\s*#\s*[\w.]+-catalog\s+v(\d+)"
# Column names read as numbers or text, and other spellings.
NUMBERS = ("ra", "dec", "x", "y", "size", "edgewidth")
TEXTS = ("id", "shape", "color")
EDGE_NAMES = ("edgewidth", "edge_width", "edge")
# Words that mean a missing number.
MISSING = ("nan", "inf", "+inf", "-inf", "infinity", "+infinity", "-infinity")
_BAD = "_malformed"


#: A plain decimal number: no suffixes, no hexadecimal, no words.
_DECIMAL = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """``line`` with its file and, as ``at``, its place there."""
    line = F.regexp_replace("value", "^\ufeff", "")
    at = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    return spark.read.text(path).select(F.regexp_replace(line, "\r$", "").alias("line"), F.col("_metadata.file_path").alias("file"), at.alias("at"))


def version_violations(spark: SparkSession, path: str) -> DataFrame:
    """Version lines of another major version."""
    v = F.regexp_extract("line", VERSION_PATTERN, 1)
    return (
        _lines(spark, path)
        .filter(v != "")
        .filter(v.cast("int") != VERSION)
        .select(F.lit(path).alias("entity"), F.lit("catalog_version").alias("rule"), F.trim("line").alias("detail"))
    )


def _number(c: Column) -> Column:
    n = F.when(F.trim(c).rlike(_DECIMAL), F.trim(c).try_cast("double"))
    return F.when(F.abs(n) != float("inf"), n)


def parse_lines(lines: DataFrame, header: str, keys: list[str] | None = None) -> DataFrame:
    """Catalog rows of text lines (``line``) under a header line, with ``malformed`` marking rows
    of the wrong width or without a position; see :func:`kept_rows` and :func:`rejected_rows`.

    Unknown columns go to ``data`` (MAP<STRING, STRING>), empty and non-finite ones left out.
    """
    names = [n.strip().lower() for n in next(csv.reader([header]))]
    raw = [f"c{i}" for i in range(len(names))]
    schema = ", ".join(f"{c} string" for c in raw) + f", {_BAD} string"
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BAD, "escape": '"', "emptyValue": ""}
    rows = lines.select(*(keys or []), "line", F.from_csv("line", schema, options).alias("r"))
    cols: dict[str, Column] = {}
    extras: list[tuple[str, Column]] = []
    for name, c in zip(names, raw):
        value = F.col("r")[c]
        if name in EDGE_NAMES:
            cols["edgewidth"] = _number(value)
        elif name in NUMBERS:
            cols[name] = _number(value)
        elif name in TEXTS:
            cols[name] = F.nullif(F.trim(value), F.lit(""))
        else:
            extras.append((name, F.trim(value)))
    out = [cols[n].alias(n) if n in cols else F.lit(None).cast("double" if n in NUMBERS else "string").alias(n) for n in (*TEXTS[:1], *NUMBERS, *TEXTS[1:])]
    if extras:
        pairs = F.map_from_arrays(F.array(*[F.lit(n) for n, _ in extras]), F.array(*[v for _, v in extras]))
        data = F.map_filter(pairs, lambda k, v: v.isNotNull() & (v != "") & ~F.lower(v).isin(*MISSING))
    else:
        data = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    typed = rows.select(*(keys or []), *out, data.alias("data"), F.col("r")[_BAD].isNotNull().alias("_ragged"))
    placed = (F.col("ra").isNotNull() & F.col("dec").isNotNull()) | (F.col("x").isNotNull() & F.col("y").isNotNull())
    return typed.withColumn("malformed", F.col("_ragged") | ~placed).drop("_ragged")


def kept_rows(parsed: DataFrame) -> DataFrame:
    """The rows of the catalog: those of the header's width that have a position."""
    return parsed.filter(~F.col("malformed")).drop("malformed")


def rejected_rows(parsed: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, dropped``: how many lines were left out."""
    return parsed.filter("malformed").groupBy(*keys).agg(F.count(F.lit(1)).alias("dropped"))


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Catalog rows of a file or a folder of files (all of them, with ``malformed``).

    The header of each file is its first line that is neither blank nor a comment; a later line that looks like it
    is a row. Only the distinct headers come to the driver.
    """
    text = F.trim("line")
    lines = _lines(spark, path).filter((text != "") & ~text.startswith("#"))
    heads = lines.groupBy("file").agg(F.min(F.struct("at", "line")).alias("head"))
    headers = [r.line for r in heads.select("head.line").distinct().collect()]
    if not headers:
        raise ValueError(f"no header row in {path}")
    out = None
    for header in sorted(headers):
        own = heads.filter(F.col("head.line") == header).select("file", F.col("head.at").alias("_head"))
        rows = parse_lines(lines.join(own, "file").filter(F.col("at") != F.col("_head")), header)
        out = rows if out is None else out.unionByName(rows)
    return out


def canonical_columns(df: DataFrame) -> list[str]:
    return [c for c in KNOWN if c in df.columns] + [c for c in df.columns if c not in KNOWN]


def write_catalog(df: DataFrame, path: str, order: list[str], format_name: str = "sky") -> None:
    """Canonical CSV folder: known columns first, ids filled in, NaN as ``nan``, numbers in their
    shortest exact form; the version line goes to ``path + '.version'``."""
    check_columns(df)
    full = with_ids(df, order)
    ordered = full.select(*canonical_columns(full))
    ordered.write.mode("overwrite").option("nanValue", "nan").option("escape", "\"").csv(path, header=True, nullValue="nan")
    spark = df.sparkSession
    spark.createDataFrame([(f"# {format_name}-catalog v{VERSION}",)], "value string").coalesce(1).write.mode(
        "overwrite"
    ).text(path + ".version")


__all__ = ["canonical_columns", "kept_rows", "parse_lines", "placeable", "read_catalog", "rejected_rows", "version_violations", "write_catalog"]
