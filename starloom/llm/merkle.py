"""Merkle manifests by time-forward processing: digests travel up in label order, proof suffixes travel back down.

Every group of rows (a source) is a tree of fan-out three over its leaves in key order; the trees' roots are the leaves of one more tree.
A node's label is (the last leaf below it, its level), so children come before their parents. A forward sweep visits nodes
by label and keeps the digests on their way to parents in a priority queue; the reversed sweep visits them from the greatest label on
and keeps proof suffixes on their way to children in another.

The queue is external: messages within a block of ``3 ** SPAN`` leaves wait in the heap of one task, and messages between blocks
go through Spark's sorted shuffle, which spills. A round takes all blocks up SPAN levels at once, so the tables shrink 729-fold
a round, a hot source is many blocks, and no task holds more than a block.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from starloom.operators import ordering
from starloom.session import materialise

FAN = 3
#: Levels that a round of sweeps climbs; a block has at most FAN ** SPAN leaves.
SPAN = 6
#: Rows of a table that is broadcast; a larger one is joined by a shuffle.
SMALL = 100_000
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

Steps = tuple[tuple[bytes, bytes], ...]


def encoded(value: Column) -> Column:
    """``-`` for null, else UTF-8 byte count, ``:`` and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(fields: Iterable[Column]) -> Column:
    """SHA-256 (binary) of the encoded fields, one after the other."""
    return F.unhex(F.sha2(F.concat(*[encoded(f) for f in fields]), 256))


def levels_of(leaves: Column) -> Column:
    """Levels above the leaves until one node remains: the powers of three below their number."""
    return F.size(F.filter(F.array(*[F.lit(FAN**i) for i in range(39)]), lambda p: p < leaves))


def digest_of(children: bytes) -> bytes:
    """Digest of nodes whose raw digests stand one after the other; hashed as hexadecimal text."""
    return sha256(children.hex().encode()).digest()


def _parent(place: int, level: int, n: int) -> tuple[int, int]:
    """Label (last leaf, level) of the parent of node ``place`` of a level."""
    return min((place // FAN + 1) * FAN ** (level + 1), n) - 1, level + 1


def forward(leaves: list[bytes], levels: int) -> tuple[bytes, dict[tuple[int, int], list[bytes]]]:
    """The root's digest, and by label the children's digests of every inner node, visited in label order."""
    queue: list[tuple[int, int, int, bytes]] = []
    runs: dict[tuple[int, int], list[bytes]] = {}
    digest = b""

    def done(place: int, level: int) -> None:
        if level < levels:
            heapq.heappush(queue, (*_parent(place, level, len(leaves)), place, digest))

    for i, digest in enumerate(leaves):
        done(i, 0)
        while queue and queue[0][0] == i:
            last, level, place, digest = heapq.heappop(queue)
            children = [digest]
            while queue and queue[0][:2] == (last, level):
                children.append(heapq.heappop(queue)[3])
            runs[last, level] = children
            digest = digest_of(b"".join(children))
            done(place // FAN, level)
    return digest, runs


def backward(runs: dict[tuple[int, int], list[bytes]], n: int, levels: int, suffix: Steps) -> Iterator[tuple[int, Steps]]:
    """Leaves from the last to the first with their proofs: (left, right) siblings level by level, then the root's own ``suffix``."""
    queue = [(-(n - 1), -levels, 0, suffix)]
    while queue:
        last, level, place, steps = heapq.heappop(queue)
        last, level = -last, -level
        if level == 0:
            yield last, steps
            continue
        children = runs[last, level]
        for j, _ in enumerate(children):
            child, width = FAN * place + j, FAN ** (level - 1)
            step = (b"".join(children[:j]), b"".join(children[j + 1 :]))
            heapq.heappush(queue, (-(min((child + 1) * width, n) - 1), -(level - 1), child, (step, *steps)))


def folded(leaf: bytes, steps: Steps) -> bytes:
    """The root that follows from a leaf and its proof."""
    for left, right in steps:
        leaf = digest_of(left + leaf + right)
    return leaf


def packed(steps: Steps) -> bytes:
    return b"".join(bytes((len(left) // 32, len(right) // 32)) + left + right for left, right in steps)


def unpacked(octets: bytes) -> Steps:
    steps, at = [], 0
    while at < len(octets):
        left, right = 32 * octets[at], 32 * octets[at + 1]
        steps.append((octets[at + 2 : at + 2 + left], octets[at + 2 + left : at + 2 + left + right]))
        at += 2 + left + right
    return tuple(steps)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Rows of one (tree, block) at a time; these are the first two columns and rows arrive sorted by them."""
    rows: list[tuple] = []
    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if rows and row[:2] != rows[0][:2]:
                yield rows
                rows = []
            rows.append(row)
    if rows:
        yield rows


def _dealt(nodes: DataFrame, span: int) -> DataFrame:
    """Nodes in label order: blocks stay whole and sorted; a message to a block (``idx`` null) precedes its nodes."""
    block = F.coalesce("block", F.floor(F.col("idx") / F.lit(FAN**span)).cast("bigint"))
    rest = [c for c in nodes.columns if c not in ("tree", "block", "idx")]
    return nodes.select("tree", block.alias("block"), "idx", *rest).repartition("tree", "block").sortWithinPartitions("tree", "block", "idx")


def _climbed(nodes: DataFrame, span: int) -> DataFrame:
    """Block roots ``tree, idx, levels, digest``: each block of ``nodes`` taken up ``span`` levels, or to its tree's root."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _blocks(batches):
            tree, block, levels = rows[0][0], rows[0][1], rows[0][3]
            root, _ = forward([r[4] for r in rows], min(levels, span))
            columns = [pa.array([v], t) for v, t in ((tree, pa.int64()), (block, pa.int64()), (max(levels - span, 0), pa.int32()), (root, pa.binary()))]
            yield pa.RecordBatch.from_arrays(columns, ["tree", "idx", "levels", "digest"])

    dealt = _dealt(nodes.select("tree", F.lit(None).cast("bigint").alias("block"), "idx", "levels", "digest"), span)
    return dealt.mapInArrow(run, "tree bigint, idx bigint, levels int, digest binary")


def climbed(nodes: DataFrame, levels: int, span: int) -> list[DataFrame]:
    """The tables of all rounds, from ``nodes`` (``tree, idx, levels, digest``) to one row for each tree; ``levels`` is the greatest."""
    rounds = [nodes]
    for _ in range(0, levels, span):
        rounds.append(materialise(_climbed(rounds[-1], span)))
    return rounds


def _addressed(nodes: DataFrame, messages: DataFrame, span: int) -> DataFrame:
    """Nodes, and before each block the message to it (``tree``, ``idx`` of the block, ``path``, ``subroot``)."""
    sent = messages.select("tree", F.col("idx").alias("block"), "path", "subroot")
    return _dealt(nodes.unionByName(sent, allowMissingColumns=True), span)


def _descended(nodes: DataFrame, messages: DataFrame, span: int) -> DataFrame:
    """``tree, idx, path, subroot, digest`` of every node of one round, from the messages to its blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (tree, _, _, _, _, path, subroot), *rows in _blocks(batches):
            leaves, levels = [r[4] for r in rows], min(rows[0][3], span)
            _, runs = forward(leaves, levels)
            proofs = list(backward(runs, len(rows), levels, unpacked(path)))
            at = [i for i, _ in proofs]
            columns = [
                pa.array([tree] * len(rows), pa.int64()), pa.array([rows[i][2] for i in at], pa.int64()),
                pa.array([packed(s) for _, s in proofs], pa.binary()), pa.array([subroot] * len(rows), pa.binary()), pa.array([leaves[i] for i in at], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["tree", "idx", "path", "subroot", "digest"])

    dealt = _addressed(nodes.select("tree", F.lit(None).cast("bigint").alias("block"), "idx", "levels", "digest"), messages, span)
    return dealt.select("tree", "block", "idx", "levels", "digest", "path", "subroot").mapInArrow(run, "tree bigint, idx bigint, path binary, subroot binary, digest binary")


RESULT = "key bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def _proven(nodes: DataFrame, messages: DataFrame, span: int, root: bytes) -> DataFrame:
    """The last step down: every row's proof, and the root that its altered leaf gives with it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, _, _, _, _, _, _, path, subroot), *rows in _blocks(batches):
            leaves, levels = [r[4] for r in rows], min(rows[0][3], span)
            _, runs = forward(leaves, levels)
            out: list[tuple] = []
            for i, steps in backward(runs, len(rows), levels, unpacked(path)):
                found = folded(rows[i][5] or leaves[i], steps)
                proof = sha256(b"".join(s for step in steps for s in step).hex().encode()).hexdigest()
                out.append((rows[i][6], leaves[i].hex(), subroot.hex(), root.hex(), proof, found.hex(), found == root))
            types = [pa.int64(), *[pa.string()] * 5, pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], [c.split()[0] for c in RESULT.split(", ")])

    dealt = _addressed(nodes.withColumn("block", F.lit(None).cast("bigint")), messages, span)
    return dealt.select("tree", "block", "idx", "levels", "digest", "altered", "key", "path", "subroot").mapInArrow(run, RESULT)


def _placed(leaves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Leaves with their tree's number and levels and their gapless place in it, and the trees (``tree, levels``)."""
    parts = ordering.ranged(leaves, ["group", "key", "digest", "altered"])
    pieces = materialise(parts.groupBy("group", "_pid").agg(F.min("_row").alias("first"), F.count(F.lit(1)).alias("n")))
    totals = pieces.groupBy("group").agg(F.sum("n").alias("leaves"))
    trees = materialise(ordering.with_row_number(totals, ["group"], "tree").withColumn("levels", levels_of(F.col("leaves"))))
    earlier = Window.partitionBy("group").orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    # A row for each range and source.
    shifts = pieces.select(F.col("group").alias("g"), F.col("_pid").alias("p"), (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first")).alias("shift"))
    bases = shifts.join(trees, F.col("g").eqNullSafe(F.col("group"))).select("g", "p", "shift", "tree", "levels")
    if pieces.count() <= SMALL:
        bases = F.broadcast(bases)
    placed = parts.join(bases, (F.col("_pid") == F.col("p")) & F.col("group").eqNullSafe(F.col("g")))
    return materialise(placed.select("tree", (F.col("_row") + F.col("shift")).alias("idx"), "levels", "digest", "altered", "key")), trees


def manifest(docs: DataFrame, key: str = "doc_id", group: str = "source", fields: tuple[str, ...] = FIELDS, altered: dict[str, Column] | None = None, span: int = SPAN) -> DataFrame:
    """All rows as ``key, leaf, subroot, root, proof_sha256, folded_root, verified``.

    Leaves are digests of ``fields``; ``altered`` gives other values for fields, whose leaf is folded with the original proof (null stays as it is).
    Sources ascend by UTF-8 bytes with null first, as do keys in a source; equal keys stand by their leaves, so repeated rows are leaves of
    their own. A null field counts as ``-``; an empty text is a value of 0 bytes. An empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    changed = leaf_digest((altered or {}).get(f, F.col(f)) for f in fields)
    differs = F.lit(False)
    for f, value in (altered or {}).items():
        differs = differs | ~F.col(f).eqNullSafe(value)
    leaves = docs.select(
        F.col(key).cast("bigint").alias("key"), F.col(group).cast("string").alias("group"), leaf_digest(F.col(f) for f in fields).alias("digest"),
        F.when(differs, changed).alias("altered"),
    )
    # Written before it is ordered, so that texts are read and hashed once.
    placed, trees = _placed(materialise(leaves))
    deepest = trees.agg(F.max("levels"), F.count(F.lit(1))).first()
    if not deepest[1]:
        return spark.createDataFrame([], RESULT)
    rounds = climbed(placed, deepest[0], span)
    above = sum(FAN**i < deepest[1] for i in range(39))
    subroots = rounds[-1].select(F.lit(0).cast("bigint").alias("tree"), F.col("tree").alias("idx"), F.lit(above).alias("levels"), "digest")
    upper = climbed(subroots, above, span)
    root = bytes(upper[-1].first()["digest"])

    none = F.lit(b"").alias("path")
    messages = upper[-1].select("tree", "idx", none, F.col("digest").alias("subroot"))
    for nodes in reversed(upper[:-1]):
        messages = _descended(nodes, messages, span).select("tree", "idx", "path", F.col("digest").alias("subroot"))
    # What a node of the upper tree is told goes to the source's own tree; a single source is the root itself.
    messages = materialise(messages.select(F.col("idx").alias("tree"), F.lit(0).cast("bigint").alias("idx"), "path", "subroot"))
    for nodes in reversed(rounds[1:-1]):
        messages = materialise(_descended(nodes, messages, span).drop("digest"))
    return _proven(placed, messages, span, root)
