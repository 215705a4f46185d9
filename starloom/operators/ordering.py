"""Row numbers, running totals and exact quantiles with no group held by one task.

A window over a hot (or missing) partition key would send that group to a single
task. These helpers range-partition by the order instead, work inside the ranges,
and carry one small row per (group, range) across them.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from starloom.functions.let import let
from starloom.session import materialise

_PID, _ROW, _OFF = "_pid", "_row", "_off"


def ranged(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """``df`` sorted into ranges of ``order``, with the range number in ``_pid``.

    Written to the checkpoint folder, because the ranges are drawn from a sample and
    two evaluations of the same plan may draw them differently.
    """
    cols = [F.col(c) for c in order]
    parts = df.repartitionByRange(*cols).sortWithinPartitions(*cols)
    return materialise(
        parts.withColumn(_ROW, F.monotonically_increasing_id())
        .withColumn(_PID, F.shiftright(_ROW, 33).cast("int"))
        .withColumn(_ROW, F.col(_ROW).bitwiseAND(F.lit((1 << 33) - 1)))
    )


def _carried(parts: DataFrame, keys: Sequence[str], total: Column, combine) -> DataFrame:
    """Per (keys, range): ``combine`` of the totals of all earlier ranges."""
    totals = parts.groupBy(*keys, _PID).agg(total.alias("_t"))
    earlier = Window.partitionBy(*keys).orderBy(_PID).rowsBetween(Window.unboundedPreceding, -1)
    # One row per range and key, so this window is as small as the number of ranges.
    return totals.select(*keys, _PID, combine(F.col("_t")).over(earlier).alias(_OFF))


def with_row_number(
    df: DataFrame, order: Sequence[str], name: str = "row_no", keys: Sequence[str] = ()
) -> DataFrame:
    """0-based position in ``order``, overall or within ``keys``. ``order`` must be unique per key."""
    if not keys:
        parts = ranged(df, order)
        counts = parts.groupBy(_PID).agg(F.count(F.lit(1)).alias("_t"))
        earlier = Window.orderBy(_PID).rowsBetween(Window.unboundedPreceding, -1)
        offs = counts.select(_PID, F.coalesce(F.sum("_t").over(earlier), F.lit(0)).alias(_OFF))
        # One row per range: bounded by the number of shuffle partitions.
        return (
            parts.join(F.broadcast(offs), _PID)
            .withColumn(name, F.col(_OFF) + F.col(_ROW))
            .drop(_PID, _ROW, _OFF)
        )
    parts = ranged(df, [*keys, *order]).drop(_ROW)
    local = Window.partitionBy(*keys, _PID).orderBy(*order)
    offs = _carried(parts, keys, F.count(F.lit(1)), F.sum)
    return (
        parts.withColumn("_n", F.row_number().over(local) - 1)
        .join(offs, [*keys, _PID])
        .withColumn(name, F.col("_n") + F.coalesce(F.col(_OFF), F.lit(0)))
        .drop(_PID, _OFF, "_n")
    )


def with_running_sum(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, name: str = "before"
) -> DataFrame:
    """Sum of ``value`` over the earlier rows of the same key (the row itself excluded)."""
    parts = ranged(df, [*keys, *order]).drop(_ROW)
    local = (
        Window.partitionBy(*keys, _PID).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    )
    offs = _carried(parts, keys, F.sum(value), F.sum)
    zero = F.lit(0)
    return (
        parts.withColumn("_n", F.coalesce(F.sum(value).over(local), zero))
        .join(offs, [*keys, _PID])
        .withColumn(name, F.col("_n") + F.coalesce(F.col(_OFF), zero))
        .drop(_PID, _OFF, "_n")
    )


def coalesce_ranges(df: DataFrame, keys: Sequence[str], gap: int = 0) -> DataFrame:
    """Merge byte ranges (``start``, ``length``) per key when they touch, overlap or lie
    at most ``gap`` apart."""
    # Ranges with one start merge with no ordering at all; this also thins hot files early.
    ends = df.groupBy(*keys, "start").agg(F.max(F.col("start") + F.col("length")).alias("stop"))
    parts = ranged(ends, [*keys, "start"]).drop(_ROW)
    local = Window.partitionBy(*keys, _PID).orderBy("start")
    before = local.rowsBetween(Window.unboundedPreceding, -1)
    reach = _carried(parts, keys, F.max("stop"), F.max)
    broken = (
        parts.withColumn("_m", F.max("stop").over(before))
        .join(reach, [*keys, _PID])
        .withColumn("_m", F.greatest("_m", _OFF))
        .drop(_OFF)
        .withColumn("_new", F.when(F.col("_m").isNull() | (F.col("start") > F.col("_m") + gap), 1).otherwise(0))
    )
    # start > max(earlier stops) + gap starts a new island; islands are numbered by a running sum.
    offs = _carried(broken, keys, F.sum("_new"), F.sum)
    return (
        broken.withColumn("_i", F.sum("_new").over(local.rowsBetween(Window.unboundedPreceding, 0)))
        .join(offs, [*keys, _PID])
        .withColumn("island", F.col("_i") + F.coalesce(F.col(_OFF), F.lit(0)))
        .groupBy(*keys, "island")
        .agg(F.min("start").alias("start"), (F.max("stop") - F.min("start")).alias("length"), F.count(F.lit(1)).alias("pieces"))
    )


def _unions(batches: Iterator[pa.RecordBatch], gap: int) -> Iterator[pa.RecordBatch]:
    """Ranges (keys, then start, stop, pieces) of one batch and key that touch, overlap or lie at most ``gap`` apart, as one."""
    for batch in batches:
        if not batch.num_rows:
            continue
        n = batch.num_columns - 3
        start, stop, pieces = (batch.column(n + i).to_numpy() for i in range(3))
        codes = [batch.column(i).dictionary_encode(null_encoding="encode").indices.to_numpy() for i in range(n)]
        order = np.lexsort((start, *codes))
        start, stop, pieces, codes = start[order], stop[order], pieces[order], [c[order] for c in codes]
        first = np.ones(len(order), bool)
        first[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in codes])
        # The furthest stop so far within the key: running maxima of ranks that are lifted from key to key.
        ends, rank = np.unique(stop, return_inverse=True)
        lift = np.cumsum(first) * len(ends)
        reach = ends[np.maximum.accumulate(rank + lift) - lift]
        first[1:] |= start[1:] > reach[:-1] + gap
        at = np.flatnonzero(first)
        last = np.append(at[1:], len(order)) - 1
        keys = batch.select(range(n)).take(pa.array(order[at]))
        yield pa.RecordBatch.from_arrays([*keys.columns, pa.array(start[at]), pa.array(reach[last]), pa.array(np.add.reduceat(pieces, at))], schema=batch.schema)


def coalesce_bounded(df: DataFrame, keys: Sequence[str], gap: int = 0) -> DataFrame:
    """:func:`coalesce_ranges` for keys whose ranges, once united, fit a task: no checkpoint and one shuffle.

    Merging is associative, so each batch unites its ranges first and what is left of a key is united after the
    shuffle. ``pieces`` counts ranges. For keys of any size use :func:`coalesce_ranges`.
    """
    whole = df.select(*keys, F.col("start").cast("bigint").alias("start"), (F.col("start") + F.col("length")).cast("bigint").alias("stop"), F.lit(1).cast("bigint").alias("pieces"))
    united = whole.mapInArrow(lambda batches: _unions(batches, gap), whole.schema)
    order = Window.partitionBy(*keys).orderBy("start", "stop")
    reach = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = united.withColumn("_new", F.when(reach.isNull() | (F.col("start") > reach + gap), 1).otherwise(0))
    islands = marked.withColumn("island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy(*keys, "island").agg(F.min("start").alias("start"), (F.max("stop") - F.min("start")).alias("length"), F.sum("pieces").alias("pieces"))


#: Values of one key that a window may rank at once; larger brackets are narrowed by digits first.
RANKED_AT_ONCE = 1 << 16


def ordered_code(v: Column) -> Column:
    """A 64-bit integer in the order of a finite double, one to one: sign, exponent, 52 bits of mantissa."""

    def coded(a: Column) -> Column:
        guess = F.greatest(F.floor(F.log2(a)).cast("int"), F.lit(-1074))
        part = a / F.pow(F.lit(2.0), guess)
        # The logarithm may miss a power of two by one.
        e = F.when(part >= 2.0, guess + 1).when((part < 1.0) & (guess > -1074), guess - 1).otherwise(guess)
        return F.when(a == 0.0, F.lit(0).cast("bigint")).otherwise(
            let(e, lambda x: F.call_function("shiftleft", (x + 1075).cast("bigint"), F.lit(52)) + ((a / F.pow(F.lit(2.0), x) - 1.0) * float(1 << 52)).cast("bigint"))
        )

    return let(F.abs(v), coded) * F.when(v < 0, -1).otherwise(1)


#: Size of the quantile sketches of groups that are too large to be ranked at once, and the share of a group's ranks by which
#: such a sketch is off, twice over (the published error at 99 %).
SKETCH, GRID = 4096, 1024
SKETCH_ERROR = 2 * 2.296 / SKETCH**0.9723


def _sketched(base: DataFrame, wide: DataFrame, keys: list[str]) -> DataFrame:
    """Per key of ``wide``: disjoint ascending intervals ``spans`` that should hold its ``ranks``, from a mergeable sketch of its values."""
    names = [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]
    held = base.join(wide.select(*names), _same(keys)).groupBy(*keys).agg(F.kll_sketch_agg_double("_v", F.lit(SKETCH)).alias("_sketch"))
    found = wide.join(held.select(*names, "_sketch"), _same(keys)).drop(*[f"_k{i}" for i in range(len(keys))])
    # Quantiles are asked for on a fixed grid; an interval reaches to the grid points beyond the error on both sides.
    edges = F.kll_sketch_get_quantile_double("_sketch", F.array(*[F.lit(i / GRID) for i in range(GRID + 1)]))
    found = found.withColumn("_edges", edges).drop("_sketch")
    share = F.transform(F.array_sort("ranks"), lambda r: r / F.col("n"))
    edge = lambda i: F.get("_edges", F.least(F.greatest(i, F.lit(0)), F.lit(GRID)).cast("int"))
    found = found.withColumn("_lows", F.transform(share, lambda p: edge(F.floor((p - SKETCH_ERROR) * GRID))))
    found = found.withColumn("_highs", F.transform(share, lambda p: edge(F.ceil((p + SKETCH_ERROR) * GRID))))
    spans = F.zip_with("_lows", "_highs", lambda lo, hi: F.struct(lo.alias("lo"), hi.alias("hi")))
    # Intervals ascend at both ends, so one that begins within the last one only moves its end.
    joined = F.aggregate(
        spans, F.array().cast("array<struct<lo:double,hi:double>>"),
        lambda done, s: F.when((F.size(done) > 0) & (F.get(done, F.size(done) - 1)["hi"] >= s["lo"]),
                               F.concat(F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))), F.array(F.struct(F.get(done, F.size(done) - 1)["lo"].alias("lo"), s["hi"].alias("hi"))))).otherwise(F.concat(done, F.array(s))),
    )
    return found.withColumn("spans", joined).drop("_edges", "_lows", "_highs")


def _same(keys: list[str]) -> Column:
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return same


def ranked_values(df: DataFrame, keys: Sequence[str], value: str, ranks: Column, bound: int = RANKED_AT_ONCE) -> DataFrame:
    """Per key: ``n`` finite values and ``at`` (MAP rank -> value) for ``ranks``, an array computed from ``n``.

    ``df`` is read twice where no key has more than ``bound`` values: for the totals and to rank. Larger keys are read for sketches, whose
    quantiles give intervals around the ranks, and to count the values between intervals and each distinct one inside. Counts show whether a rank
    lies in its interval; one that does not is looked for again in the gap where it lies. Only the distinct values inside are kept
    (checkpointed). More than ``bound`` of them are narrowed by 16 bits of :func:`ordered_code` at a time, with partial aggregates,
    whatever the distribution; what is left is ranked. A key without finite values has ``n`` = 0 and an empty map.
    """
    keys = list(keys)
    v = F.col(value).cast("double")
    finite = v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    whole = materialise(
        df.groupBy(*keys).agg(F.count(F.when(finite, 1)).alias("n"), F.min(F.when(finite, v)).alias("lo"), F.max(F.when(finite, v)).alias("hi"))
    )
    base = df.filter(finite).select(*keys, (v + 0.0).alias("_v"))
    asked = F.array_distinct(ranks.cast("array<bigint>"))
    large = F.col("n") > bound
    some = not whole.filter(large).isEmpty()
    # A key of at most ``bound`` values is ranked as it is.
    small = whole.filter(~large & (F.col("n") > 0)).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)])
    rows = base.join(small, _same(keys)).select(*keys, "_v") if some else base
    group = Window.partitionBy(*keys)
    ranked = rows.withColumn("_rank", (F.row_number().over(group.orderBy("_v")) - 1).cast("bigint")).withColumn("n", F.count(F.lit(1)).over(group))
    found = ranked.filter(F.array_contains(asked, F.col("_rank"))).select(*keys, "_rank", F.col("_v").alias("_value"))
    if some:
        constant = whole.filter(large & (F.col("lo") == F.col("hi"))).select(*keys, F.explode(asked).alias("_rank"), (F.col("lo") + 0.0).alias("_value"))
        wide = whole.filter(large & (F.col("lo") < F.col("hi"))).select(*keys, "n", asked.alias("ranks"))
        found = found.unionByName(constant)
        if not wide.isEmpty():
            found = found.unionByName(_ranked_wide(base, wide, keys, bound))
    maps = found.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("_rank", "_value"))).alias("at"))
    named = maps.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "at")
    return whole.join(named, _same(keys), "left").select(*keys, "n", F.coalesce("at", F.create_map().cast("map<bigint,double>")).alias("at"))


def _ranked_wide(base: DataFrame, wide: DataFrame, keys: list[str], bound: int) -> DataFrame:
    """keys, _rank, _value for the keys of ``wide`` (keys, n, ranks)."""
    todo = materialise(_sketched(base, wide, keys))
    brackets = cells = None
    for attempt in range(1 << 16):
        hit, inside, todo = _settled(base, todo, keys, attempt)
        brackets, cells = (hit, inside) if brackets is None else (brackets.unionByName(hit), cells.unionByName(inside))
        if todo.isEmpty():
            break
    on = [*keys, "_try", "lo", "hi", "below", "ranks"]
    upto = Window.partitionBy(*on).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)

    def within(wanted: DataFrame) -> DataFrame:
        renamed = wanted.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_try").alias("_t"), "lo", "hi", "below", "ranks")
        return cells.join(renamed, F.col("_v").between(F.col("lo"), F.col("hi")) & (F.col("_try") == F.col("_t")) & _same(keys))

    def counted(rows: DataFrame, cell: Column) -> DataFrame:
        sums = rows.groupBy(*on, cell.alias("_cell")).agg(F.sum("_c").alias("_c"), F.count(F.lit(1)).alias("_held"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        sums = sums.withColumn("_below", F.col("below") + F.coalesce(F.sum("_c").over(upto), F.lit(0)))
        return sums.withColumn("ranks", F.filter("ranks", lambda r: (r >= F.col("_below")) & (r < F.col("_below") + F.col("_c")))).filter(F.size("ranks") > 0)

    wide = F.col("held") > bound
    for shift in (48, 32, 16, 0):
        crowded = brackets.filter(wide)
        if crowded.isEmpty():
            break
        digit = F.shiftright(ordered_code(F.col("_v")), shift)
        narrowed = counted(within(crowded), digit).select(
            *keys, "_try", F.col("_lo").alias("lo"), F.col("_hi").alias("hi"), F.col("_below").alias("below"), F.col("_held").alias("held"), "ranks"
        )
        brackets = materialise(brackets.filter(~wide).unionByName(narrowed))
    return counted(within(brackets), F.col("_v")).select(*keys, F.explode("ranks").alias("_rank"), F.col("_cell").alias("_value"))


def _settled(base: DataFrame, todo: DataFrame, keys: list[str], attempt: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One pass over the values: brackets (keys, lo, hi, below, held, ranks) with exact counts, the distinct values inside intervals
    with theirs, and what is left to do, with the gap as interval, where a rank lies outside of all."""
    renamed = todo.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "spans")
    at = F.size(F.filter("spans", lambda s: s["lo"] <= F.col("_v")))
    rows = base.join(renamed, _same(keys)).select(*keys, "_v", at.alias("_at"), F.get("spans", at - 1)["hi"].alias("_end"))
    gap = F.coalesce(F.col("_v") > F.col("_end"), F.lit(True))
    cells = materialise(rows.groupBy(*keys, "_at", gap.alias("_gap"), F.when(~gap, F.col("_v")).alias("_v")).agg(F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")))
    # At most two blocks an interval and one more.
    before = Window.partitionBy(*keys).orderBy("_at", "_gap").rowsBetween(Window.unboundedPreceding, -1)
    blocks = cells.groupBy(*keys, "_at", "_gap").agg(F.sum("_c").alias("_n"), F.count(F.lit(1)).alias("held"), F.min("_lo").alias("lo"), F.max("_hi").alias("hi"))
    blocks = blocks.withColumn("below", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    asked = todo.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "n", F.col("ranks").alias("_ranks"))
    placed = blocks.join(asked, _same(keys)).withColumn("ranks", F.filter("_ranks", lambda r: (r >= F.col("below")) & (r < F.col("below") + F.col("_n")))).filter(F.size("ranks") > 0)
    placed = materialise(placed.select(*keys, "n", "lo", "hi", "below", "held", "ranks", "_gap"))
    hit = placed.filter(~F.col("_gap")).select(*keys, F.lit(attempt).alias("_try"), "lo", "hi", "below", "held", "ranks")
    span = F.struct("lo", "hi", "ranks")
    missed = placed.filter("_gap").groupBy(*keys).agg(F.first("n").alias("n"), F.flatten(F.collect_list("ranks")).alias("ranks"), F.transform(F.array_sort(F.collect_list(span)), lambda s: F.struct(s["lo"].alias("lo"), s["hi"].alias("hi"))).alias("spans"))
    return hit, cells.filter(~F.col("_gap")).select(*keys, F.lit(attempt).alias("_try"), "_v", "_c"), missed


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float], bound: int = RANKED_AT_ONCE, empty: bool = False) -> DataFrame:
    """Linear-interpolated quantiles of finite ``value`` per key, exact at any group size.

    One row per key with a finite value (with ``empty``, per key): ``n`` and ``q``, an array in the order of ``probs``.
    """
    place = [F.lit(p) * (F.col("n") - 1) for p in probs]
    ranks = F.array(*[f(p) for p in place for f in (F.floor, F.ceil)])
    found = ranked_values(df, keys, value, ranks, bound)

    def interpolated(p: Column) -> Column:
        lo, hi = (F.try_element_at("at", f(p).cast("bigint")) for f in (F.floor, F.ceil))
        return lo + (hi - lo) * (p - F.floor(p))

    kept = found if empty else found.filter("n > 0")
    return kept.select(*keys, "n", F.array(*[interpolated(p) for p in place]).alias("q"))
