"""Words, row keys and gapless positions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

#: Fixed patterns of the two kinds of words.
SPACED_WORD = r"[^\x20\x09-\x0D]+"
ALNUM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same as ALNUM_WORD before A-Z are lower-cased, and what stands between such words.
ALNUM_WORD_ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BETWEEN_ALNUM = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Leading hexadecimal digits of the draw that deal a group's rows to parts when they are numbered.
PART_DIGITS = 3


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only. ``lower`` does that for pure ASCII and is much faster than ``translate``."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def alnum_words(text: Column) -> Column:
    """The ALNUM_WORD words of a text after A-Z are lower-cased; none for null."""
    parts = F.split(ascii_lower(F.coalesce(text, F.lit(""))), BETWEEN_ALNUM)
    return F.filter(parts, lambda w: w != "")


def count_words(text: Column, pattern: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(pattern)), F.lit(0)).cast("bigint")


def drawn(*parts: Column) -> Column:
    """A seeded draw as 32 hexadecimal digits: MD5 of the parts as text with bars between them (null: nothing)."""
    return F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))


def running_start(rows: DataFrame, group: list[str], draw: str, ties: list[str], size: Column, name: str) -> DataFrame:
    """Adds ``name``: the sum of ``size`` over the rows of its group that stand before this one in the order of ``draw``.

    No group is gathered in a task: the leading digits of the draw deal its rows to 4096 parts, each part is summed alone,
    and the sums of the parts (at most 4096 rows a group) are added up in between. Rows of equal draw stand by ``ties``.
    """
    dealt = rows.withColumn("_part", F.substring(draw, 1, PART_DIGITS)).withColumn("_size", size)
    sums = dealt.groupBy(*group, "_part").agg(F.sum("_size").alias("_sum"))
    firsts = sums.select(
        *[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)],
        F.col("_part").alias("_p"),
        (F.sum("_sum").over(_until_here(group, ["_part"])) - F.col("_sum")).alias("_first"),
    )
    same = F.col("_part") == F.col("_p")
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    placed = dealt.withColumn("_within", F.sum("_size").over(_until_here([*group, "_part"], [draw, *ties])) - F.col("_size"))
    return placed.join(firsts, same).withColumn(name, (F.col("_first") + F.col("_within")).cast("bigint")).drop(
        *[f"_g{i}" for i in range(len(group))], "_p", "_part", "_size", "_first", "_within"
    )


def _until_here(group: list[str], order: list[str]) -> WindowSpec:
    return Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
