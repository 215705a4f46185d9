import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from starloom.operators import ordering as O


def ranges(spark, rows, gap):
    df = spark.createDataFrame([("f", *r) for r in rows], "file string, start bigint, length bigint")
    return sorted((r.start, r.length) for r in O.coalesce_ranges(df, ["file"], gap).collect())


def bounded(spark, rows, gap):
    df = spark.createDataFrame([("f", *r) for r in rows], "file string, start bigint, length bigint").coalesce(2)
    return sorted((r.start, r.length) for r in O.coalesce_bounded(df, ["file"], gap).collect())


@pytest.mark.parametrize("ranges", [ranges, bounded])
def test_coalesce_golden(spark, ranges):
    rows = [(30, 5), (0, 10), (10, 5), (20, 5)]
    assert ranges(spark, rows, 0) == [(0, 15), (20, 5), (30, 5)]
    assert ranges(spark, rows, 5) == [(0, 35)]
    assert ranges(spark, [(0, 20), (5, 3)], 0) == [(0, 20)]


def test_bounded_unions_equal_the_general_ones(spark):
    rng = np.random.default_rng(7)
    pdf = pd.DataFrame({"file": rng.choice(["a", "b", None], 6000), "n": rng.integers(0, 3, 6000), "start": rng.integers(0, 60000, 6000), "length": rng.integers(0, 9, 6000)})
    df = spark.createDataFrame(pdf).repartition(5)
    one = O.coalesce_bounded(df, ["n", "file"], 2)
    assert one._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    key = lambda r: (r.n, r.file or "", r.start, r.length)
    got = sorted(map(key, one.collect()))
    want = []
    for (n, f), part in pdf.fillna({"file": ""}).groupby(["n", "file"]):
        islands = []
        for s, length in sorted(zip(part.start, part.length)):
            if islands and s <= islands[-1][1] + 2:
                islands[-1][1] = max(islands[-1][1], s + length)
            else:
                islands.append([s, s + length])
        want += [(n, f, lo, hi - lo) for lo, hi in islands]
    assert got == sorted(want) and sum(r.pieces for r in one.collect()) == 6000


def test_coalesce_hot_file(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"file": np.where(rng.random(20000) < 0.6, 0, rng.integers(1, 9, 20000)), "start": rng.integers(0, 400000, 20000), "length": rng.integers(1, 40, 20000)})
    got = {(r.file, r.start, r.length) for r in O.coalesce_ranges(spark.createDataFrame(pdf).repartition(16), ["file"], 3).collect()}
    want = set()
    for f, part in pdf.sort_values("start").groupby("file"):
        cur = None
        for s, n in zip(part.start, part.length):
            if cur and s <= cur[1] + 3:
                cur[1] = max(cur[1], s + n)
            else:
                if cur:
                    want.add((f, cur[0], cur[1] - cur[0]))
                cur = [s, s + n]
        want.add((f, cur[0], cur[1] - cur[0]))
    assert got == want


def test_row_numbers_and_running_sums(spark):
    pdf = pd.DataFrame({"k": [0] * 3000 + [1] * 500 + [2], "o": np.random.default_rng(2).permutation(3501)})
    pdf["v"] = pdf.o % 7
    df = spark.createDataFrame(pdf).repartition(8)
    got = O.with_row_number(df, ["o"], "n").toPandas().sort_values("o")
    assert (got.n.to_numpy() == np.arange(3501)).all()
    got = O.with_row_number(df, ["o"], "n", ["k"]).toPandas().sort_values(["k", "o"])
    assert (got.n == got.groupby("k").cumcount()).all()
    got = O.with_running_sum(df, ["k"], ["o"], "v").toPandas().sort_values(["k", "o"])
    assert (got.before == got.groupby("k").v.cumsum() - got.v).all()


def test_exact_quantiles_on_awkward_values(spark):
    rng = np.random.default_rng(3)
    groups = {
        "normal": rng.normal(0, 1, 5000), "constant": np.full(100, 7.0), "spike": np.r_[np.zeros(4000), rng.normal(0, 1e-6, 500), 1e30],
        "one": np.array([3.5]), "two": np.array([1.0, 2.0]),
    }
    pdf = pd.concat([pd.DataFrame({"g": g, "v": v}) for g, v in groups.items()])
    pdf = pd.concat([pdf, pd.DataFrame({"g": ["normal"] * 3, "v": [np.nan, np.inf, -np.inf]})])
    probs = [0.0, 0.001, 0.25, 0.5, 0.99999, 1.0]
    got = {r.g: (r.n, r.q) for r in O.exact_quantiles(spark.createDataFrame(pdf), ["g"], "v", probs, bound=64).collect()}
    for g, v in groups.items():
        assert got[g][0] == len(v)
        np.testing.assert_allclose(got[g][1], np.percentile(v, [100 * p for p in probs]), rtol=1e-12, atol=1e-15)


def test_no_window_without_partition(spark):
    plan = O.with_row_number(spark.range(100).select(F.col("id").alias("o")), ["o"])._jdf.queryExecution().toString()
    assert "SinglePartition" not in plan.split("BroadcastExchange")[0]


def test_ranks_that_a_sketch_misses_are_found_in_the_gap(spark, monkeypatch):
    """A sketch of eight values and no margin: most ranks lie outside of their intervals and take another pass."""
    monkeypatch.setattr(O, "SKETCH", 8)
    monkeypatch.setattr(O, "SKETCH_ERROR", 0.0)
    passes = []
    settled = O._settled
    monkeypatch.setattr(O, "_settled", lambda *a: passes.append(a[-1]) or settled(*a))
    rng = np.random.default_rng(5)
    groups = {"a": rng.normal(0, 1, 3000), "b": np.round(rng.normal(0, 2, 2000)), None: rng.exponential(1, 700)}
    pdf = pd.concat([pd.DataFrame({"g": g, "v": v}) for g, v in groups.items()])
    probs = [0.01, 0.3, 0.5, 0.77, 0.999]
    got = {r.g: (r.n, r.q) for r in O.exact_quantiles(spark.createDataFrame(pdf), ["g"], "v", probs, bound=50).collect()}
    assert len(passes) > 1 and len(got) == 3
    for g, v in groups.items():
        np.testing.assert_allclose(got[g][1], np.percentile(v, [100 * p for p in probs]), rtol=1e-12, atol=1e-15)
