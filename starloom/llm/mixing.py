"""Mixing sources to target weights by Sainte-Laguë apportionment.

1. Targets: the sources share ``share`` times all words by weight; a source stops at ``most`` times its own
   words and what it cannot take goes to the others by weight.
2. Every shard has the same number of equal seats, a seat being one block of ``block`` words. Seats go to
   sources by the highest quotients target / (2k + 1). All but some boundary seats are certain from bounds on
   the H-th quotient, so that about three quotients a source are ranked, however many seats there are. A source
   with a target under FEW seats would miss it by more than 1 % or get no seat at all; such sources stand outside
   the seats and give their targets to the word.
3. Selection: a source's documents stand in a seeded order, end to end, as a circle of words. Shard i takes the
   run of quota blocks that follows the run of shard i - 1, so a document is whole unless a run's end cuts it.
   Sources outside the seats give each shard an equal run, to the word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from starloom.llm.common import SPACED_WORD, count_words, drawn, running_start

#: Weights of the sources in code point order of their names, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
SHARDS, SEATS, SEED = 16, 65536, 20240901
#: Seats below which a source's target is met to the word instead: half a seat is 1 % of it there.
FEW = 50


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``(source, source_size)`` with ``rank``, ``total`` and ``target``: one row per source, so a small table.

    Sources are filled in order of the level ``most * size / weight`` at which they are full; the first that
    is not full at the common level fixes it for all that follow.
    """
    named = Window.orderBy(F.col("source").asc_nulls_last())
    filling = Window.orderBy("full", "rank")
    every = Window.orderBy("full", "rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    rows = (
        sizes.withColumn("rank", F.row_number().over(named))
        .withColumn("weight", F.get(cycle, (F.col("rank") - 1) % len(weights)))
        .withColumn("full", most * F.col("source_size") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(every))
        .withColumn("full_words", F.coalesce(F.sum(most * F.col("source_size")).over(filling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("open_weight", F.sum("weight").over(filling.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", (share * F.col("total") - F.col("full_words")) / F.col("open_weight"))
    )
    rows = rows.withColumn("common", F.min(F.when(F.col("full") >= F.col("level"), F.struct("full", "level"))).over(every)["level"])
    return rows.select(
        "source", "source_size", "rank", "total",
        F.least(most * F.col("source_size"), F.coalesce(F.col("common") * F.col("weight"), most * F.col("source_size"))).alias("target"),
    )


def apportion(targets: DataFrame, shards: int = SHARDS, seats: int = SEATS, share: float = 1.5, few: int = 0) -> DataFrame:
    """Adds ``block`` (words a seat), ``quota`` (seats of the source in each shard) and ``words`` (of the source in all shards).

    Sources with a target under ``few`` seats have no quota and take no part in the apportionment: their words are their target.
    With q the sources' shares of H seats and S sources, the H-th quotient lies between those of H - S/2 and
    H + S/2 seats; seats below the first bound are given, those past the second cannot be, the rest are ranked.
    """
    every = Window.partitionBy()
    rows = (
        targets.withColumn("block", F.greatest(F.lit(1), F.floor(share * F.col("total") / (shards * seats))).cast("bigint"))
        .withColumn("fine", F.col("target") < few * shards * F.col("block"))
        .withColumn("seated", F.when(F.col("fine"), F.lit(0.0)).otherwise(F.col("target")))
        .withColumn("wanted", F.sum("seated").over(every))
        .withColumn("sources", F.sum(F.when(F.col("fine"), 0).otherwise(1)).over(every))
        .withColumn("seats", F.ceil(F.col("wanted") / (shards * F.col("block"))))
        .withColumn("part", F.coalesce(F.col("seated") / F.nullif(F.col("wanted"), F.lit(0.0)), F.lit(0.0)))
        .withColumn("sure", F.greatest(F.lit(0), F.floor(F.col("part") * (F.col("seats") - F.col("sources") / 2) - 0.5)))
        .withColumn("limit", F.when(F.col("seated") > 0, F.ceil(F.col("part") * (F.col("seats") + F.col("sources") / 2) + 1.5)).otherwise(F.lit(0)))
        .withColumn("open", F.col("seats") - F.sum("sure").over(every))
    )
    asked = (
        rows.where(F.col("limit") > F.col("sure"))
        .select("rank", "target", "open", F.explode(F.sequence(F.col("sure"), F.col("limit") - 1)).alias("k"))
        .withColumn("quotient", F.col("target") / (2 * F.col("k") + 1))
        .withColumn("place", F.row_number().over(Window.orderBy(F.col("quotient").desc(), "rank", "k")))
        .where(F.col("place") <= F.col("open"))
    )
    won = asked.groupBy(F.col("rank").alias("won_rank")).agg(F.count(F.lit(1)).alias("won"))
    quota = (F.col("sure") + F.coalesce(F.col("won"), F.lit(0))).cast("bigint")
    words = F.when(F.col("fine"), F.round("target").cast("bigint")).otherwise(shards * quota * F.col("block"))
    return rows.join(won, F.col("rank") == F.col("won_rank"), "left").select("source", "source_size", "target", "block", quota.alias("quota"), words.alias("words"))


def _overlap(start: Column, size: Column, low: Column, high: Column) -> Column:
    return F.greatest(F.lit(0), F.least(start + size, high) - F.greatest(start, low))


def _placed(
    docs: DataFrame, kept: list[str], key: str, source: str, text: str, weights: tuple[float, ...], share: float, most: int, shards: int, seats: int, seed: int
) -> DataFrame:
    """Rows with the kept columns as ``k_<name>``, the numbers of ``mix_documents`` and, as ``turns``, the words taken each time."""
    rows = docs.select(
        *[F.col(c).alias(f"k_{c}") for c in kept],
        F.col(source).cast("string").alias("source"),
        F.col(key).alias("_key"),
        drawn(F.lit(seed), F.col(key), F.md5(F.coalesce(F.col(text), F.lit("")))).alias("_draw"),
        count_words(F.col(text), SPACED_WORD).alias("size"),
    )
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    quotas = apportion(source_targets(sizes, weights, share, float(most)), shards, seats, share, FEW).select(
        F.col("source").alias("_source"), "source_size", "target",
        F.least(most * F.col("source_size"), F.col("words")).alias("run"),
    )
    placed = running_start(rows, ["source"], "_draw", ["_key", "size"], F.col("size"), "start")
    mixed = placed.join(quotas, F.col("source").eqNullSafe(F.col("_source")))
    turns = F.array(*[_overlap(F.col("start") + i * F.col("source_size"), F.col("size"), F.lit(0), F.col("run")).cast("bigint") for i in range(most)])
    return mixed.select(*[f"k_{c}" for c in kept], "size", "source_size", F.col("target").cast("double").alias("target"), "start", "run", turns.alias("turns"))


def mix_documents(
    docs: DataFrame,
    key: str = "doc_id",
    source: str = "source",
    text: str = "text",
    weights: tuple[float, ...] = WEIGHTS,
    share: float = 1.5,
    most: int = 2,
    shards: int = SHARDS,
    seats: int = SEATS,
    seed: int = SEED,
    keep: list[str] | None = None,
) -> DataFrame:
    """Every document with the words the mix takes of it.

    ``size`` words, ``source_size`` and ``target`` of its source, ``start`` on the source's circle, ``run`` words the
    source gives in all (``shards`` runs of quota blocks, or its target under FEW seats; at most ``most`` times its words), ``taken`` words of this
    document, repeats counted. ``keep`` names input columns to carry (default: the key; not one of these names).
    A null text has no words, takes none and leaves nothing out; a null source is a source, the last in order; repeated
    rows are documents of their own; an empty table gives an empty result; other columns are ignored.
    """
    kept = keep or [key]
    placed = _placed(docs, kept, key, source, text, weights, share, most, shards, seats, seed)
    taken = F.aggregate("turns", F.lit(0).cast("bigint"), lambda a, x: a + x)
    return placed.select(*[F.col(f"k_{c}").alias(c) for c in kept], "size", "source_size", "target", "start", "run", taken.alias("taken"))


def mixed_rows(
    docs: DataFrame,
    key: str = "doc_id",
    source: str = "source",
    text: str = "text",
    n_chars: str = "n_chars",
    weights: tuple[float, ...] = WEIGHTS,
    share: float = 1.5,
    most: int = 2,
    shards: int = SHARDS,
    seats: int = SEATS,
    seed: int = SEED,
    wordless: bool = False,
) -> DataFrame:
    """The mix itself: the columns of ``docs``, a row for each time that a document is taken.

    Where a run's end cuts a document, only its words inside the run remain, joined by spaces. Documents without words
    (null, empty and blank texts) leave, or with ``wordless`` stay once each as they are.
    """
    columns = docs.columns
    placed = _placed(docs, columns, key, source, text, weights, share, most, shards, seats, seed)
    wordless = F.lit(wordless)
    turns = F.when(F.col("size") == 0, F.array(F.lit(0).cast("bigint"))).otherwise(F.col("turns"))
    taken = placed.withColumn("taken", F.explode(turns)).where((F.col("taken") > 0) | wordless & (F.col("size") == 0))
    said = F.col(f"k_{text}")
    words = F.filter(F.split(said, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    cut = F.when(F.col("taken") < F.col("size"), F.array_join(F.slice(words, F.lit(1), F.col("taken").cast("int")), " ")).otherwise(said)
    out = taken.withColumn(f"k_{text}", cut)
    if n_chars in columns:
        out = out.withColumn(f"k_{n_chars}", F.length(said).cast(docs.schema[n_chars].dataType))
    return out.select(*[F.col(f"k_{c}").alias(c) for c in columns])
