"""Sharding by jump consistent hashing (Lamping and Veach): no ring table, and an appended shard only takes rows.

The key of a row walks a chain of jumps through the shard numbers; the last jump that stays below the
shard count is its shard. Jumps depend on the key alone, so with one more shard a row either stays or
jumps to the new one. The 64-bit products are taken as decimals: their value stays below 10^38.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from starloom.functions.let import let
from starloom.llm.common import drawn, running_start

#: The multiplier of the published generator, and powers of two.
MULTIPLIER = 2862933555777941757
TWO_64, TWO_33, TWO_31 = 1 << 64, 1 << 33, 1 << 31
RESULT = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")


def _unsigned(key: Column) -> Column:
    k = F.coalesce(key.cast("bigint"), F.lit(0)).cast("decimal(20,0)")
    return F.when(k < 0, k + F.lit(str(TWO_64)).cast("decimal(20,0)")).otherwise(k).cast("decimal(20,0)")


def jump(key: Column, shards: int) -> Column:
    """Struct of ``shard`` (of ``shards``) and ``grown`` (of ``shards + 1``) for an integral key; null counts as 0."""

    def drawn(acc: Column) -> Column:
        product = acc["key"] * F.lit(MULTIPLIER).cast("decimal(19,0)") + F.lit(1)
        return (product % F.lit(str(TWO_64)).cast("decimal(20,0)")).cast("decimal(20,0)")

    def landed(acc: Column, key: Column) -> Column:
        high = ((key - key % F.lit(TWO_33)) / F.lit(TWO_33)).cast("double") + 1.0
        return F.floor((acc["to"].cast("double") + 1.0) * (F.lit(float(TWO_31)) / high)).cast("bigint")

    def step(acc: Column) -> Column:
        moved = let(
            drawn(acc),
            lambda k: F.struct(
                k.alias("key"),
                F.when(acc["to"] < shards, acc["to"]).otherwise(acc["shard"]).alias("shard"),
                acc["to"].alias("grown"),
                landed(acc, k).alias("to"),
            ),
        )
        return F.when(acc["to"] <= shards, moved).otherwise(acc)

    start = F.struct(_unsigned(key).alias("key"), F.lit(0).cast("bigint").alias("shard"), F.lit(0).cast("bigint").alias("grown"), F.lit(0).cast("bigint").alias("to"))
    steps = F.sequence(F.lit(1), F.lit(shards + 1))
    return F.aggregate(steps, start, lambda acc, _: step(acc), lambda acc: F.struct(acc["shard"].cast("int").alias("shard"), acc["grown"].cast("int").alias("grown")))


def shard_documents(docs: DataFrame, shards: int = 16, key: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """All rows with their shard, the shard they would have with one more, and a gapless slot in their shard.

    ``keep`` names the input columns to carry (default: the key; a name of the result is not carried). Sizes are the text's UTF-8 bytes plus 1 (null:
    none plus 1). A null key counts as 0; repeated rows all get a slot; an empty table gives an empty result; other
    columns are ignored unless kept. Equal texts under different keys may part: the law is ``key``.
    """
    kept = [c for c in keep or [key] if c not in RESULT]
    content = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        *[F.col(c).alias(f"k_{c}") for c in kept],
        F.col(key).alias("_key"),
        (F.octet_length(content) + 1).cast("bigint").alias("size"),
        F.crc32(content.cast("binary")).alias("text_crc32"),
        jump(F.col(key), shards).alias("_jump"),
    ).select("*", drawn(F.col("_key"), F.col("text_crc32")).alias("_draw")).select("*", F.col("_jump.shard").alias("shard"), F.col("_jump.grown").alias("grown_shard"))
    slots = running_start(rows.drop("_jump"), ["shard"], "_draw", ["_key", "size"], F.lit(1).cast("bigint"), "slot")
    return slots.select(
        *[F.col(f"k_{c}").alias(c) for c in kept],
        "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard",
    )
