"""SimHash near-duplicates by multi-index hashing, with connected components of all links.

Fingerprints have two segments of 32 bits. Of two fingerprints within 2 bits, either one segment is equal, or each
differs in one bit. So equal segments are looked up as they are, and the ball of radius 1 around the first segment
is enumerated: every pair at distance 1 has a member with a bit set that the other has not, so clearing each set
bit of one side meets the other side's own value. Lookups also carry a slice of the other segment that has to be
equal by the pigeonhole principle, which keeps table entries short. Whole distances are verified.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from starloom.session import materialise

WORDS, SEED = 3, 42
#: Shingles hashed at a time, to bound memory on long texts.
CHUNK = 1 << 16


def shingle_hashes(text: str | None, words: int = WORDS, seed: int = SEED) -> Iterator[np.ndarray]:
    """XXH64 of the text's word shingles as big-endian bytes, in chunks. Bytes split and lower-case ASCII only, as asked."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    digest, join = xxhash.xxh64_digest, b" ".join
    if 0 < len(parts) < words:
        yield np.frombuffer(digest(join(parts), seed), np.uint8)
    for low in range(0, len(parts) - words + 1, CHUNK):
        piece = parts[low : low + CHUNK + words - 1]
        shingles = zip(*[piece[i:] for i in range(words)], strict=False)
        yield np.frombuffer(b"".join([digest(join(s), seed) for s in shingles]), np.uint8)


def fingerprint(text: str | None, words: int = WORDS, seed: int = SEED) -> int:
    """64 bits as a signed integer: a bit is 1 if more than half of the shingles' hashes have it; 0 without words."""
    ones, n = np.zeros(64, np.int64), 0
    for octets in shingle_hashes(text, words, seed):
        bits = np.unpackbits(octets.reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
        n += len(bits)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, seed: int = SEED) -> DataFrame:
    """``id, h, fp`` of all rows, ``h`` being a hash of the text. A null text has no words, so its fingerprint is 0."""
    narrow = docs.select(F.col(key).cast("bigint").alias("id"), F.col(text).cast("string").alias("text")).withColumn("h", F.xxhash64("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(t.as_py(), words, seed) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(fps, pa.int64())], ["id", "h", "fp"])

    return narrow.mapInArrow(run, "id bigint, h bigint, fp bigint")


def _halves(fp: Column) -> tuple[Column, Column]:
    return F.shiftrightunsigned(fp, 32), fp.bitwiseAND(F.lit(0xFFFFFFFF))


def _slices(kind: int, exact: Column, other: Column, widths: tuple[int, ...]) -> Column:
    """Keys ``kind, exact segment, number and value of a slice of the other``, one for each slice."""
    keys, low = [], 0
    for i, width in enumerate(widths):
        part = F.shiftrightunsigned(other, low).bitwiseAND(F.lit((1 << width) - 1))
        keys.append(F.struct(F.lit(4 * kind + i).alias("kind"), exact.alias("exact"), part.alias("part")))
        low += width
    return F.array(*keys)


def links(prints: DataFrame) -> DataFrame:
    """All pairs ``a < b`` of the distinct fingerprints in column ``fp`` that differ in at most two bits."""
    nodes = prints.select("fp").distinct()
    high, low = _halves(F.col("fp"))
    thirds, two = (11, 11, 10), (16, 16)
    at = lambda keys: nodes.select("fp", F.explode(keys).alias("k")).select("fp", "k.*")
    equal = at(F.concat(_slices(0, high, low, thirds), _slices(1, low, high, thirds)))
    balls = at(_slices(2, high, low, two))
    cleared = F.filter(
        F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: high.bitwiseAND(F.bitwise_not(_bit(i)))), lambda v: v != high
    )
    probes = at(F.flatten(F.transform(cleared, lambda v: _slices(2, v, low, two))))

    def met(left: DataFrame, right: DataFrame, wanted: Column) -> DataFrame:
        x, y = left.withColumnRenamed("fp", "x"), right.withColumnRenamed("fp", "y")
        near = F.bit_count(F.col("x").bitwiseXOR(F.col("y"))) <= 2
        return x.join(y, ["kind", "exact", "part"]).where(near & wanted).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))

    return met(equal, equal, F.col("x") < F.col("y")).unionByName(met(probes, balls, F.col("x") != F.col("y"))).distinct()


def _bit(i: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), i)


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for the nodes of edges ``a, b``: the smallest node reachable, by large-star and small-star rounds.

    Stars are built from partial minima and joins, so no neighbourhood is gathered. Each step is checkpointed; that also puts an
    exchange under both sides of a join with minima, which lets AQE split the hub of a large component.
    """
    current = materialise(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where(F.col("u") != F.col("v")).distinct())
    before = _state(current)
    while True:
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialise(both.groupBy(F.col("u").alias("c")).agg(F.min("v").alias("n")).select("c", F.least("c", "n").alias("m")))
        large = both.join(least, F.col("u") == F.col("c")).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialise(large.distinct())
        lowest = materialise(large.groupBy(F.col("u").alias("c")).agg(F.min("v").alias("m")))
        joined = large.join(lowest, F.col("u") == F.col("c"))
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(lowest.select(F.col("c").alias("u"), F.col("m").alias("v")))
        current = materialise(small.where(F.col("u") != F.col("v")).distinct())
        after = _state(current)
        if after == before:
            break
        before = after
    roots = current.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, seed: int = SEED) -> DataFrame:
    """All rows as ``id, h, fp, component_id, kept``: the smallest id whose fingerprint is reachable over links of at most two bits.

    Equal fingerprints are linked, so texts without words form one component. ``kept`` marks the row that stands for its component,
    the one of least id, then least text hash (rows that repeat both are all marked). A null id comes after all others; repeated
    rows stay; an empty table gives an empty result; other columns are ignored.
    """
    prints = materialise(fingerprints(docs, key, text, words, seed))
    first = F.struct(F.col("id").isNull().alias("missing"), "id", "h")
    nodes = materialise(prints.groupBy("fp").agg(F.min(first).alias("least")))
    found = materialise(components(links(nodes)))
    named = nodes.join(found, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    firsts = materialise(named.groupBy(F.col("root").alias("r")).agg(F.min("least").alias("chosen")))
    classes = named.join(firsts, F.col("root") == F.col("r")).select(F.col("fp").alias("_fp"), "chosen")
    stands = F.col("id").eqNullSafe(F.col("chosen.id")) & (F.col("h") == F.col("chosen.h"))
    return prints.join(classes, F.col("fp") == F.col("_fp")).select("id", "h", "fp", F.col("chosen.id").alias("component_id"), stands.alias("kept"))


def without_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, seed: int = SEED) -> DataFrame:
    """The rows of ``docs`` that stand for their component, one each."""
    kept = near_duplicates(docs, key, text, words, seed).where("kept").select(F.col("id").alias("_id"), F.col("h").alias("_h")).distinct()
    marked = docs.withColumn("_hash", F.xxhash64(F.col(text).cast("string")))
    same = F.col(key).cast("bigint").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_h"))
    return marked.join(kept, same).dropDuplicates(["_id", "_h"]).select(*docs.columns)


def hex_digits(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
