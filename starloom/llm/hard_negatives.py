"""Hard negatives from exact integer scores: Strassen products of anchor and candidate tiles, then heaps that merge.

Anchors are a stated query set against all rows. Rows are dealt to a grid of cells (candidate group, anchor group), each of bounded
memory; a cell holds its candidates and streams its anchors past them in tiles. A tile product is Strassen's recursion on 64-bit
integers, padded with zeros to halve evenly; its additions and subtractions wrap around alike, so the result is exact whenever the
score itself fits 64 bits. A first pass keeps, for each anchor, the heap of its best rows of the same label; the heaps of the cells
merge into the positives. A second pass keeps, for each positive, the heap of the best rows of other labels within the window of
scores below it, and merges these. Rows lie by label within a group, so tile pairs that a pass can't use are not multiplied.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from starloom.session import materialise

#: Sides of a tile of scores, and the side at which the recursion multiplies plainly.
ANCHORS, CANDIDATES, PLAIN = 256, 2048, 32
#: Components that a cell holds of its candidates, and of its anchors.
CELL = 1 << 23
#: Rows that a group has at least while there are fewer groups than cores.
LEAST_ROWS = 4096
LAST = (1 << 63) - 1


def strassen(a: np.ndarray, b: np.ndarray, plain: int = PLAIN) -> np.ndarray:
    """The product of two int64 matrices, modulo 2**64 in every step and hence exact where the result fits."""
    m, k, n = a.shape[0], a.shape[1], b.shape[1]
    halvings = 0
    while min(m, k, n) >> (halvings + 1) >= plain:
        halvings += 1
    if not halvings:
        return a @ b
    step = 1 << halvings
    up = [-(-side // step) * step for side in (m, k, n)]
    if up != [m, k, n]:
        a = np.pad(a, ((0, up[0] - m), (0, up[1] - k)))
        b = np.pad(b, ((0, up[1] - k), (0, up[2] - n)))
    return _halved(a, b, halvings)[:m, :n]


def _halved(a: np.ndarray, b: np.ndarray, halvings: int) -> np.ndarray:
    if not halvings:
        return np.ascontiguousarray(a) @ np.ascontiguousarray(b)
    (m, k), n = (side // 2 for side in a.shape), b.shape[1] // 2
    a11, a12, a21, a22 = a[:m, :k], a[:m, k:], a[m:, :k], a[m:, k:]
    b11, b12, b21, b22 = b[:k, :n], b[:k, n:], b[k:, :n], b[k:, n:]
    down = halvings - 1
    m1 = _halved(a11 + a22, b11 + b22, down)
    m2 = _halved(a21 + a22, b11, down)
    m3 = _halved(a11, b12 - b22, down)
    m4 = _halved(a22, b21 - b11, down)
    m5 = _halved(a11 + a12, b22, down)
    m6 = _halved(a21 - a11, b11 + b12, down)
    m7 = _halved(a12 - a22, b21 + b22, down)
    out = np.empty((2 * m, 2 * n), np.int64)
    out[:m, :n] = m1 + m4 - m5 + m7
    out[:m, n:] = m3 + m5
    out[m:, :n] = m2 + m4
    out[m:, n:] = m1 - m2 + m3 + m6
    return out


def prepared(rows: DataFrame, vector: str, label: Column, key: str, scale: int) -> DataFrame:
    """``row, id, label, v``: rows with a label and a vector of finite components, each component ``x`` as ``floor(scale * x)``.

    ``row`` tells rows apart, also repeated ones; the table is written, so that it stays the same in later passes.
    """
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    taking = rows.where(label.isNotNull() & F.col(vector).isNotNull() & finite)
    whole = F.transform(vector, lambda x: F.floor(x.cast("double") * float(scale)).cast("bigint"))
    return materialise(taking.select(F.monotonically_increasing_id().alias("row"), F.coalesce(F.col(key).cast("bigint"), F.lit(LAST)).alias("id"), label.cast("bigint").alias("label"), whole.alias("v")))


def _matrix(column: pa.ListArray, dims: int) -> np.ndarray:
    """Vectors as rows of int64, short ones filled up with zeros."""
    lengths = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False)
    if (lengths == dims).all():
        return values.reshape(len(lengths), dims)
    out = np.zeros((len(lengths), dims), np.int64)
    out[np.arange(dims) < lengths[:, None]] = values
    return out


class _Tile:
    """Rows of one side: row numbers, ids, labels, vectors; for anchors also the positives they ask about."""

    def __init__(self, batches: list[pa.RecordBatch], dims: int):
        self.row, self.id, self.label = (np.concatenate([b.column(i).to_numpy() for b in batches]) for i in (1, 2, 3))
        self.v = np.concatenate([_matrix(b.column(4), dims) for b in batches])
        self.asked = [a for b in batches for a in b.column(5).to_pylist()]

    def tiles(self, size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        for low in range(0, len(self.row), size):
            part = slice(low, low + size)
            yield self.row[part], self.id[part], self.label[part], np.ascontiguousarray(self.v[part].T)


Entry = tuple[int, int, int]


def merged(heap: list[Entry], scores: np.ndarray, ids: np.ndarray, rows: np.ndarray, most: int) -> list[Entry]:
    """The first ``most`` of a heap's entries (minus score, id, row) and new ones, in order."""
    if len(scores) > most:
        kth = np.partition(scores, len(scores) - most)[len(scores) - most]
        keep = np.flatnonzero(scores >= kth)
        keep = keep[np.lexsort((ids[keep], -scores[keep]))[:most]]
        scores, ids, rows = scores[keep], ids[keep], rows[keep]
    return sorted([*heap, *zip((-scores).tolist(), ids.tolist(), rows.tolist(), strict=True)])[:most]


def _best_alike(anchors: _Tile, tiles: list, most: int) -> Iterator[tuple]:
    """Per anchor: its best other rows of the same label."""
    heaps: list[list[Entry]] = [[] for _ in anchors.row]
    labels = set(anchors.label.tolist())
    for row, ids, label, columns in tiles:
        if labels.isdisjoint(label.tolist()):
            continue
        scores = strassen(anchors.v, columns)
        alike = (anchors.label[:, None] == label) & (anchors.row[:, None] != row)
        for i in np.flatnonzero(alike.any(axis=1)):
            found = np.flatnonzero(alike[i])
            heaps[i] = merged(heaps[i], scores[i, found], ids[found], row[found], most)
    for i, heap in enumerate(heaps):
        for score, name, row in heap:
            yield int(anchors.row[i]), int(anchors.id[i]), row, name, -score, None, None


def _best_within(anchors: _Tile, tiles: list, most: int, low: int, high: int) -> Iterator[tuple]:
    """Per anchor and positive: the best rows of other labels with ``low * positive <= high * score <= high * positive``."""
    slots = max(map(len, anchors.asked))
    n = len(anchors.row)
    floor, ceiling = np.full((n, slots), LAST, np.int64), np.full((n, slots), -LAST, np.int64)
    for i, asked in enumerate(anchors.asked):
        for j, positive in enumerate(asked):
            ceiling[i, j] = positive["score"]
            floor[i, j] = -((-low * positive["score"]) // high)
    heaps: list[list[list[Entry]]] = [[[] for _ in range(slots)] for _ in range(n)]
    for row, ids, label, columns in tiles:
        other = anchors.label[:, None] != label
        if not other.any():
            continue
        scores = strassen(anchors.v, columns)
        for j in range(slots):
            within = other & (scores <= ceiling[:, j, None]) & (scores >= floor[:, j, None])
            for i in np.flatnonzero(within.any(axis=1)):
                found = np.flatnonzero(within[i])
                heap = heaps[i][j] = merged(heaps[i][j], scores[i, found], ids[found], row[found], most)
                if len(heap) == most:
                    floor[i, j] = max(floor[i, j], -heap[-1][0])
    for i, asked in enumerate(anchors.asked):
        for j, positive in enumerate(asked):
            for score, name, row in heaps[i][j]:
                yield int(anchors.row[i]), int(anchors.id[i]), positive["row"], positive["id"], positive["score"], name, -score


PARTIAL = "anchor_row bigint, anchor_id bigint, positive_row bigint, positive_id bigint, positive_score bigint, negative_id bigint, negative_score bigint"
ASKED = "array<struct<row: bigint, id: bigint, score: bigint>>"


def _passed(candidates: DataFrame, anchors: DataFrame, groups: int, anchor_groups: int, dims: int, best: Callable[[_Tile, list], Iterator[tuple]]) -> DataFrame:
    """What ``best`` finds in every cell of the grid, candidates of a cell coming before its anchors."""
    draw = F.xxhash64("row")
    of_group = lambda n: F.pmod(draw, F.lit(n)).cast("int")
    columns = ["cell", "side", "row", "id", "label", "v", "asked"]
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = candidates.withColumn("own", of_group(groups)).withColumn("other", spread(anchor_groups))
    left = left.select((F.col("own") * anchor_groups + F.col("other")).alias("cell"), F.lit(0).alias("side"), "row", "id", "label", "v", F.lit(None).cast(ASKED).alias("asked"))
    right = anchors.withColumn("own", of_group(anchor_groups)).withColumn("other", spread(groups))
    right = right.select((F.col("other") * anchor_groups + F.col("own")).alias("cell"), F.lit(1).alias("side"), "row", "id", "label", "v", "asked")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        waiting: list[pa.RecordBatch] = []
        tiles: list = []
        cell = None

        def scored() -> pa.RecordBatch:
            found = list(best(_Tile(waiting, dims), tiles))
            waiting.clear()
            types = [pa.int64()] * 7
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], t) for i, t in enumerate(types)], [c.split()[0] for c in PARTIAL.split(", ")])

        for batch in batches:
            marks = batch.column(0).to_numpy().astype(np.int64) * 2 + batch.column(1).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(marks)) + 1).tolist(), len(marks)]
            for low, high in zip(cuts, cuts[1:], strict=False):
                part, mark = batch.slice(low, high - low).select(columns[1:]), int(marks[low])
                if mark // 2 != cell:
                    if waiting:
                        yield scored()
                    held, tiles, cell = [], [], mark // 2
                if mark % 2 == 0:
                    held.append(part)
                    continue
                if held:
                    tiles, held = list(_Tile(held, dims).tiles(CANDIDATES)), []
                for at in range(0, part.num_rows, ANCHORS):
                    piece = part.slice(at, ANCHORS)
                    if tiles and waiting and sum(w.num_rows for w in waiting) + piece.num_rows > ANCHORS:
                        yield scored()
                    if tiles:
                        waiting.append(piece)
        if waiting:
            yield scored()

    cells = left.unionByName(right).repartitionById(groups * anchor_groups, "cell")
    return cells.sortWithinPartitions("cell", "side", "label", "id", "row").select(columns).mapInArrow(run, PARTIAL)


def _first(found: DataFrame, keys: list[str], score: str, name: str, most: int) -> DataFrame:
    """Heaps of the cells merged: the first ``most`` of each key, with their rank. A cell gives at most ``most`` entries a key, so a key is as short as the groups are few."""
    order = Window.partitionBy(*keys).orderBy(F.col(score).desc(), F.col(name))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def mine(
    rows: DataFrame, anchor: Column, label: Column | None = None, key: str = "vec_id", vector: str = "embedding",
    scale: int = 256, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, cell: int = CELL,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for the rows where ``anchor`` (of ``id``) holds.

    Rows without label, vector or with a component that is null or not finite take no part. Every row counts, repeated ones too (each is another row of the
    other, and an anchor of its own); equal scores stand by id, a null id (never an anchor) last. Vectors of unequal length are filled up with zeros. An anchor without
    positives, or a positive whose window is empty, gives no row; an empty table gives an empty result; other columns are ignored.
    Scores have to fit 64 bits; components are taken as 64-bit integers.
    """
    spark = rows.sparkSession
    taking = prepared(rows, vector, F.col("label") if label is None else label, key, scale)
    asking = taking.where((F.col("id") != LAST) & F.coalesce(anchor, F.lit(False))).withColumn("asked", F.lit(None).cast(ASKED))
    n, dims = taking.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    n_asking, dims = asking.count(), max(dims or 0, 1)
    bound = max(1, cell // dims)
    groups = max(1, -(-n // bound), min(2 * spark.sparkContext.defaultParallelism, -(-n // LEAST_ROWS)))
    anchor_groups = max(1, -(-n_asking // bound))
    alike = _passed(taking, asking, groups, anchor_groups, dims, lambda a, t: _best_alike(a, t, positives))
    chosen = _first(alike, ["anchor_row"], "positive_score", "positive_id", positives)
    asked = chosen.groupBy(F.col("anchor_row").alias("r")).agg(F.collect_list(F.struct(F.col("positive_row").alias("row"), F.col("positive_id").alias("id"), F.col("positive_score").alias("score"))).alias("asked"))
    asking = materialise(asking.drop("asked").join(asked, F.col("row") == F.col("r")).drop("r"))
    within = _passed(taking, asking, groups, anchor_groups, dims, lambda a, t: _best_within(a, t, negatives, low, high))
    named = lambda c: F.when(F.col(c) != LAST, F.col(c)).alias(c)
    found = _first(within, ["anchor_row", "positive_row"], "negative_score", "negative_id", negatives)
    return found.select("anchor_id", named("positive_id"), F.col("rank").cast("int").alias("rank"), named("negative_id"), "positive_score", "negative_score")
