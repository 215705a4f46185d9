"""Preference formatting: the longest common turn prefix is rendered once, the rest as paired masked completions.

Both conversations of a pair are laid side by side by turn in one shuffle; the first turn at which they differ
(a partial minimum per pair) ends the prompt. The result has one row per rendered turn, so that a pair of any
length is never gathered; ``assembled`` makes one row per pair for pairs that fit in one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

TRAINED_ROLE = "assistant"


def rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit("<|"), F.coalesce(role, F.lit("")), F.lit("|>\n"), F.coalesce(text, F.lit("")), F.lit("<|end|>\n"))


def format_preferences(
    chosen: DataFrame, rejected: DataFrame, pair: str = "pair_id", turn: str = "turn", role: str = "role", text: str = "text", trained: str = TRAINED_ROLE
) -> DataFrame:
    """Rows ``pair_id, part, turn, role, rendered, loss``; parts are ``prompt``, ``chosen`` and ``rejected``.

    Turns are equal when role and text are (null equals null). ``loss`` is true on completion turns of the trained role.
    Pairs that never differ have a prompt only; a conversation missing on one side leaves the other as its completion.
    A null turn stands first and a null pair is a pair of its own. If a turn is given twice, the larger (role, text)
    counts. Null texts render as empty ones; other columns are ignored; empty tables give an empty result.
    """

    def side(df: DataFrame, n: int) -> DataFrame:
        return df.select(
            F.col(pair).alias("pair_id"), F.coalesce(F.col(turn).cast("bigint"), F.lit(-1).cast("bigint")).alias("turn"),
            F.struct(F.col(role).alias("role"), F.col(text).alias("text")).alias("said"), F.lit(n).alias("side"),
        )

    aligned = (
        side(chosen, 0).unionByName(side(rejected, 1)).groupBy("pair_id", "turn")
        .agg(F.max(F.when(F.col("side") == 0, F.col("said"))).alias("c"), F.max(F.when(F.col("side") == 1, F.col("said"))).alias("r"))
    )
    same = F.col("c").isNotNull() & F.col("r").isNotNull() & F.col("c.role").eqNullSafe(F.col("r.role")) & F.col("c.text").eqNullSafe(F.col("r.text"))
    splits = aligned.groupBy(F.col("pair_id").alias("_pair")).agg(F.min(F.when(~same, F.col("turn"))).alias("split"))
    placed = aligned.join(splits, F.col("pair_id").eqNullSafe(F.col("_pair")))

    def piece(part: str, said: str) -> Column:
        return F.struct(F.lit(part).alias("part"), F.col(f"{said}.role").alias("role"), F.col(f"{said}.text").alias("text"), F.col(said).isNotNull().alias("there"))

    shared = F.col("split").isNull() | (F.col("turn") < F.col("split"))
    pieces = F.when(shared, F.array(piece("prompt", "c"))).otherwise(F.array(piece("chosen", "c"), piece("rejected", "r")))
    return placed.select("pair_id", "turn", F.explode(F.filter(pieces, lambda p: p["there"])).alias("p")).select(
        "pair_id", F.col("p.part").alias("part"), "turn", F.col("p.role").alias("role"), rendered(F.col("p.role"), F.col("p.text")).alias("rendered"),
        ((F.col("p.part") != "prompt") & F.coalesce(F.col("p.role") == trained, F.lit(False))).alias("loss"),
    )


def assembled(pieces: DataFrame) -> DataFrame:
    """One row per pair: ``prompt``, ``chosen``, ``rejected`` and, as ``[text, loss]`` runs, their masks. A pair has to fit in a row."""

    def joined(part: str) -> Column:
        return F.transform(F.filter(F.col("all"), lambda p: p["part"] == part), lambda p: F.struct(p["rendered"].alias("text"), p["loss"].alias("loss")))

    rows = pieces.groupBy("pair_id").agg(F.sort_array(F.collect_list(F.struct("turn", "part", "rendered", "loss"))).alias("all"))
    rows = rows.select("pair_id", *[joined(p).alias(f"{p}_runs") for p in ("prompt", "chosen", "rejected")])
    return rows.select("pair_id", *[F.array_join(F.col(f"{p}_runs.text"), "").alias(p) for p in ("prompt", "chosen", "rejected")], "chosen_runs", "rejected_runs")


def swapped_replies(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chosen and rejected from one table: a conversation is rejected with the last reply of the next conversation."""
    rows = conversations.select(F.col("conv_id").alias("pair_id"), "turn", "role", "text")
    last = rows.where(F.col("role") == TRAINED_ROLE).groupBy("pair_id").agg(F.max(F.struct("turn", "text")).alias("last"))
    own = last.select(F.col("pair_id").alias("_own"), F.col("last.turn").alias("_turn"))
    other = last.select((F.col("pair_id") - 1).alias("_other"), F.col("last.text").alias("_reply"))
    there = rows.join(own, F.col("pair_id") == F.col("_own"), "left").join(other, F.col("pair_id") == F.col("_other"), "left")
    swap = F.coalesce((F.col("turn") == F.col("_turn")) & (F.col("role") == TRAINED_ROLE), F.lit(False))
    rejected = there.where(~swap | F.col("_reply").isNotNull()).select("pair_id", "turn", "role", F.when(swap, F.col("_reply")).otherwise(F.col("text")).alias("text"))
    return rows, rejected
