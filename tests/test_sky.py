import tempfile

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from starloom.functions import grid, skytext as X, wcs as K
from starloom.operators import cutout as CUT, grids as GR, pyramid as P, regions as REG, spatial as SP


def wcs(crpix=(256.5, 256.5), crval=(150.0, 2.2), cd=(-8e-6, 0.0, 0.0, 8e-6), lonpole=180.0):
    return K.Wcs(*[F.lit(float(v)) for v in (*crpix, *crval, *cd, lonpole)])


@pytest.mark.parametrize("case", [dict(), dict(crval=(0.05, -5.1), cd=(-3e-5, 2e-5, 2e-5, 3e-5)), dict(crval=(40.0, 89.6)), dict(cd=(8e-6, 0, 0, 8e-6), lonpole=90.0), dict(crval=(10.0, 90.0), lonpole=0.0)])
def test_projection_there_and_back(spark, case):
    w = wcs(**case)
    pts = spark.createDataFrame([(float(x), float(y)) for x in (0, 13.7, 256, 511.5) for y in (0, 100.25, 512)], "x double, y double")
    ra, dec = K.pix_to_sky(w, F.col("x"), F.col("y"))
    sky = pts.select("x", "y", ra.alias("ra"), dec.alias("dec"), K.sky_at(w, F.col("x"), F.col("y")).alias("s"))
    bx, by, front = K.sky_to_pix(w, F.col("ra"), F.col("dec"))
    got = sky.select("*", bx.alias("bx"), by.alias("by"), front.alias("front"), K.pix_at(w, F.col("ra"), F.col("dec")).alias("p")).toPandas()
    np.testing.assert_allclose(got.bx, got.x, atol=1e-6)
    np.testing.assert_allclose(got.by, got.y, atol=1e-6)
    assert got.front.all()
    np.testing.assert_allclose([s["ra"] for s in got.s], got.ra, atol=1e-12)
    np.testing.assert_allclose([p["x"] for p in got.p], got.bx, atol=1e-6)


def test_behind_the_plane(spark):
    assert spark.range(1).select(K.sky_to_pix(wcs(), F.lit(330.0), F.lit(-2.2))[2].alias("f")).first().f is False


def test_separation_golden(spark):
    cases = [((0, 0, 0, 1), 1), ((359.5, 0, 0.5, 0), 1), ((0, 0, 180, 0), 180)]
    angles = [((0, 0, 0, 1), 0), ((0, 0, 1, 0), 90), ((0, 0, 0, -1), 180), ((0, 0, 359, 0), 270)]
    r = spark.range(1).select(
        F.array(*[K.separation_deg(*[F.lit(float(v)) for v in a]) for a, _ in cases]).alias("s"),
        F.array(*[K.position_angle_deg(*[F.lit(float(v)) for v in a]) for a, _ in angles]).alias("p"),
        F.array(*[X.format_separation(F.lit(v)) for v in (1 / 3600, 120 / 3600, 1.0, float("nan"))]).alias("t"),
    ).first()
    assert r.s == pytest.approx([w for _, w in cases]) and r.p == pytest.approx([w for _, w in angles])
    assert r.t == ["1.00″", "2.00′", "1.000°", "—"]


def test_text_edges(spark):
    r = spark.range(1).select(
        X.format_ra(F.lit(359.9999999)).alias("ra"), X.format_dec(F.lit(-0.0000001)).alias("dec"), X.format_dec(F.lit(-12.999999)).alias("carry"),
        *[X.parse_sky(F.lit(t)).alias(f"p{i}") for i, t in enumerate(("", "1 2 3", "10:00:00 -02:12:00", "400 1", "10h00m00s +02d12m00s", "150.12, -2.34"))],
    ).first()
    assert (r.ra, r.dec, r.carry) == ("00:00:00.000", "+00:00:00.00", "-13:00:00.00")
    assert r.p0 is None and r.p1 is None and r.p3 is None
    assert tuple(r.p2) == pytest.approx((150.0, -2.2)) and tuple(r.p4) == pytest.approx((150.0, 2.2)) and tuple(r.p5) == pytest.approx((150.12, -2.34))


def test_grid_hash_golden(spark):
    cd = (-8.333e-6, 0.0, 0.0, 8.333e-6)
    args = [F.lit("RA---TAN"), F.lit("DEC--TAN"), F.lit(512), F.lit(512), *[F.lit(v) for v in (256.5, 256.5, 150.0, 2.2, *cd)]]
    r = spark.range(1).select(grid.grid_hash(*args).alias("h"), grid.fnv1a_hex(F.lit("")).alias("e"), grid.fnv1a_hex(F.lit("é")).alias("u"), grid.fnv1a_hex(F.lit("é"), "UTF-16BE").alias("w")).first()

    def fnv(units):
        h = 0x811C9DC5
        for b in units:
            h = ((h ^ b) * 0x01000193) & 0xFFFFFFFF
        return f"{h:08x}"

    assert r.h == "cd26eeba" and r.e == "811c9dc5" and r.u == fnv("é".encode()) and r.w == fnv([0xE9])


def test_level_choice_golden(spark):
    lv = spark.createDataFrame([("b", z, 0.03 * 2**z) for z in range(3)], "band string, z int, pixel_scale_arcsec double")
    arr = lv.groupBy("band").agg(F.array_sort(F.collect_list(F.struct("z", "pixel_scale_arcsec"))).alias("levels"))
    t = (0.03, 0.06, 0.12, 0.05, 0.041, 0.001, 10.0)
    pick = {m: arr.select(F.array(*[CUT.choose_level(F.col("levels"), F.lit(v), m) for v in t]).alias("z")).first().z for m in ("nearest", "finer", "coarser")}
    assert pick == {"nearest": [0, 1, 2, 1, 0, 0, 2], "finer": [0, 1, 2, 0, 0, 0, 2], "coarser": [0, 1, 2, 1, 1, 0, 2]}


def test_box_join_with_hot_cells(spark):
    rng = np.random.default_rng(11)
    xy = np.r_[rng.normal(5, 0.01, (3000, 2)), rng.uniform(-50, 50, (2000, 2))]
    pts = spark.createDataFrame(pd.DataFrame({"id": np.arange(5000), "x": xy[:, 0], "y": xy[:, 1]})).repartition(8)
    q = pd.DataFrame({"q": np.arange(60), "qx": rng.uniform(-50, 50, 60), "qy": rng.uniform(-50, 50, 60), "radius": rng.choice([0.0, 0.3, 2.0, 40.0], 60)})
    q.loc[0, ["qx", "qy", "radius"]] = [5.0, 5.0, 0.02]
    got = SP.near_points(pts, spark.createDataFrame(q), 1.0)
    few = SP.bucketed_join(
        pts, spark.createDataFrame(q).selectExpr("q", "qx - radius AS x0", "qy - radius AS y0", "qx + radius AS x1", "qy + radius AS y1"), 1.0, rows_per_salt=100
    )
    want = {(r.q, i) for r in q.itertuples() for i in np.flatnonzero((xy[:, 0] - r.qx) ** 2 + (xy[:, 1] - r.qy) ** 2 <= r.radius**2)}
    rows = [(r.q, r.id) for r in got.select("q", "id").collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want
    boxes = {(r.q, i) for r in q.itertuples() for i in np.flatnonzero((abs(xy[:, 0] - r.qx) <= r.radius) & (abs(xy[:, 1] - r.qy) <= r.radius))}
    rows = [(r.q, r.id) for r in few.select("q", "id").collect()]
    assert len(rows) == len(set(rows)) and set(rows) == boxes


def test_greedy_groups_against_a_loop(spark):
    rng = np.random.default_rng(12)
    n = 60
    crpix = 100 + rng.choice([0, 0.03, 0.06, 0.09, 0.12, 5.0], n)
    rows = [
        ("d", f"g{i}", i, "RA---TAN", "DEC--TAN", 100 + int(i % 2), 100, *((float(crpix[i]), 100.0, 0.0, 89.9, -3e-5, 0.0, 0.0, 3e-5, 180.0) if i % 9 else (None,) * 9))
        for i in range(n)
    ]
    df = spark.createDataFrame(rows, "dataset string, band string, ord bigint, ctype1 string, ctype2 string, h int, w int, " + ", ".join(f"{f} double" for f in K.FIELDS))
    reps, want = [], []
    for i in range(n):
        bare = i % 9 == 0
        for g, (j, b) in enumerate(reps):
            if j % 2 == i % 2 and b == bare and (bare or abs(crpix[i] - crpix[j]) <= 0.0505):
                want.append(g)
                break
        else:
            want.append(len(reps))
            reps.append((i, bare))
    got = GR.greedy_groups(df, "dataset").orderBy("ord").toPandas()
    assert got.grid_group.tolist() == want


def test_regions_golden(spark):
    r = spark.createDataFrame(
        [("rect", 0, "rect", 5.0, 5.0, 2**0.5, 1.0, 1.0, 1.0, 0.0, 0.0, 1.0, None), ("poly", 1, "polygon", 5.0, 5.0, 3.0, None, None, None, None, None, None, [(3.0, 3.0), (7.0, 3.0), (7.0, 7.0), (5.0, 5.0), (3.0, 7.0)])],
        "id string, ord bigint, shape string, cx double, cy double, bound_radius double, half_w double, half_h double, ux double, uy double, vx double, vy double, verts array<struct<x:double,y:double>>",
    )
    p = spark.createDataFrame([("in both", 5.0, 4.5), ("notch", 5.0, 6.0), ("poly only", 3.5, 3.5), ("none", 9.0, 9.0)], "point_id string, px double, py double")
    pairs = REG.points_in_regions(p, r, 1.0)
    assert {(x.point_id, x.id) for x in pairs.collect()} == {("in both", "rect"), ("in both", "poly"), ("notch", "rect"), ("poly only", "poly")}
    assert {(x.point_id, x.region) for x in REG.topmost_region(pairs).collect()} == {("in both", "poly"), ("notch", "rect"), ("poly only", "poly")}


def test_a_long_chain_of_grids_settles(spark):
    """500 grids in a row, each matching its neighbours, in shuffled order of appearance; and grids that match none."""
    import random

    from starloom.operators import grids as GR

    order = list(range(500))
    random.Random(1).shuffle(order)
    pairs = [tuple(sorted((order[i], order[i + 1]))) for i in range(499)]
    ords = spark.createDataFrame([(o,) for o in [*order, 900, 901]], "ord bigint")
    got = {r.ord: r.rep for r in GR.representatives(ords, spark.createDataFrame(pairs, "a_ord bigint, b_ord bigint")).collect()}
    near = {o: [a if b == o else b for a, b in pairs if o in (a, b)] for o in order}
    want = {900: 900, 901: 901}
    for o in sorted(order):
        want[o] = min((n for n in near[o] if n < o and want[n] == n), default=o)
    assert got == want


def test_topmost_marker_with_one_very_large_one(spark):
    """Against all pairs, with a marker that covers everything and one probe in a crowd."""
    rng = np.random.default_rng(9)
    rows = [(f"m{i}", i, float(x), float(y), "box" if i % 2 else "circle", float(1 + i % 5)) for i, (x, y) in enumerate(rng.uniform(0, 100, (300, 2)))]
    rows.append(("huge", -1, 50.0, 50.0, "circle", 400.0))
    markers = spark.createDataFrame(rows, "id string, ord long, x double, y double, shape string, size double")
    places = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(0, 100, (60, 2)))]
    positions = spark.createDataFrame(places, "pos_id int, qx double, qy double").selectExpr(
        "*", "named_struct('cx', 0D, 'cy', 0D, 'zoom', 2D, 'vw', 10D, 'vh', 10D) AS view", "named_struct('m11', 1D, 'm12', 0D, 'm21', 0D, 'm22', 1D) AS m", "1.0D AS dpr", "400.0D AS max_size"
    )
    got = {r.pos_id: (r.marker, r.hits) for r in SP.topmost_marker(markers, positions, 1.0).collect()}
    for i, qx, qy in places:
        hits = []
        for name, order, x, y, shape, size in rows:
            dx, dy, half = abs(2 * (x - qx)), abs(2 * (y - qy)), size / 2 + 1
            if (dx <= half and dy <= half) if shape == "box" else dx * dx + dy * dy <= half * half:
                hits.append((order, name))
        assert got.get(i) == ((max(hits)[1], len(hits)) if hits else None)


def thin_levels(spark):
    """An image 200 times as tall as wide: its coarsest levels have no width."""
    return P.level_table(spark.createDataFrame([("b0", 800, 4)], "band string, img_h int, img_w int"), 16)


def test_levels_without_width_have_no_supertiles(spark):
    levels = thin_levels(spark)
    assert levels.filter("n_tx = 0").count() > 0
    got = CUT.tile_map(P.supertile_blocks(levels, 2).withColumn("filename", F.lit("f")))
    assert sorted((r.z, r.tile_y) for r in got.collect()) == sorted((r.z, y) for r in levels.filter("n_tx > 0").collect() for y in range(r.n_ty))


def test_levels_without_width_have_no_tiles(spark):
    levels = thin_levels(spark)
    tiles = P.level_tiles(levels).select("band", "z", "tile_x", "tile_y")
    assert sorted((r.z, r.tile_x, r.tile_y) for r in tiles.collect()) == sorted((r.z, 0, y) for r in levels.filter("n_tx > 0").collect() for y in range(r.n_ty))
    deepest = levels.filter("n_tx > 0").agg(F.max("z")).first()[0]
    assert CUT.coarser_source(tiles, tiles, 40).agg(F.max("from_z")).first()[0] == deepest
    assert CUT.common_level(tiles, tiles, 1, 40).agg(F.max("z")).first()[0] == deepest
    assert CUT.finer_cover(tiles, tiles).agg(F.max("z")).first()[0] == deepest


def test_points_on_the_rim_are_kept(spark):
    # 8.1 - 6.1 is 2.0 or a bit less, 6.1 + 2.0 a bit less than 8.1, and so on: the box must not decide.
    pts = spark.range(2000).select(F.col("id").alias("k"), (F.col("id") / 10.0).alias("x"), F.lit(0.0).alias("y"))
    probes = spark.range(2000).select(F.col("id").alias("pos_id"), (F.col("id") / 10.0).alias("qx"), F.lit(0.0).alias("qy"), F.lit(2.0).alias("radius"))
    got = SP.near_points(pts, probes, 1.0).select("k", "pos_id")
    v = np.arange(2000) / 10.0
    assert got.count() == int(((v[:, None] - v) ** 2 <= 4.0).sum())


def test_position_angle_just_west_of_north(spark):
    """Below 0 by less than half a step of doubles at 360 is 0 in both engines, never 360."""
    from __spark_entry__ import oracle_sql, queries

    folder = tempfile.mkdtemp()
    spark.createDataFrame([(22500,), (67500,)], "c_custkey bigint").coalesce(1).write.parquet(f"{folder}/customer.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW customer AS SELECT * FROM '{folder}/customer.parquet/*.parquet'")
    got = sorted(tuple(r) for r in queries()["separation_pa"](spark, folder).collect())
    assert got == sorted(con.execute(oracle_sql()["separation_pa"]).fetchall()) == [(22500, 138.0, 0.0), (67500, 54.0, 0.0)]


def test_alike_regions_and_points_are_tested_once(spark, monkeypatch):
    shape = "id string, ord bigint, shape string, cx double, cy double, bound_radius double, half_w double, half_h double, ux double, uy double, vx double, vy double, verts array<struct<x: double, y: double>>"
    notch = [(0.0, 0.0), (8.0, 0.0), (8.0, 8.0), (4.0, 2.0), (0.0, 8.0)]
    rows = [(f"r{i}", i, "rect", 2.0, 2.0, 3.0, 2.0, 2.0, 1.0, 0.0, 0.0, 1.0, None) for i in range(30)]
    rows += [(f"p{i}", i, "polygon", 4.0, 3.6, 7.0, *[None] * 6, notch) for i in range(20)]
    regions = spark.createDataFrame(rows, shape)
    points = spark.createDataFrame([(f"s{i}", *((1.0, 1.0), (4.0, 4.0), (4.0, 5.0), (7.0, 3.0))[i % 4]) for i in range(40)], "point_id string, px double, py double")
    tested = []
    whole = REG._held
    monkeypatch.setattr(REG, "_held", lambda *a: tested.append(whole(*a)) or tested[-1])
    monkeypatch.setattr(REG, "MEMBERS", 25)
    pairs = REG.points_in_regions(points, regions, 1.0)
    want = {(f"s{i}", r) for i in range(40) for r in [f"r{k}" for k in range(30) if i % 4 < 2] + [f"p{k}" for k in range(20) if i % 4 in (0, 3)]}
    got = [(x.point_id, x.id) for x in pairs.collect()]
    assert len(got) == len(want) and set(got) == want and set(pairs.columns) == {*points.columns, *regions.columns}
    assert tested[0].count() <= 2 * 4
    assert sorted(REG.topmost_region_at(points, regions, 1.0).collect()) == sorted(REG.topmost_region(pairs).collect())
    assert tested[1].count() == 4


def test_fnv_of_many_texts_at_once(spark):
    texts = ["", None, "a", "é" * 7, "RA---TAN|" * 30, "x", None, "𝄞b"]

    def fnv(units):
        h = 2166136261
        for u in units:
            h = (h ^ u) * 16777619 & 0xFFFFFFFF
        return f"{h:08x}"

    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").coalesce(1).select("i", grid.fnv1a_hex(F.col("t")).alias("b"), grid.fnv1a_hex(F.col("t"), "UTF-16BE").alias("w"))
    # One step for the texts of a batch, not a loop of expressions for every letter of every row.
    assert "transform(" not in got._jdf.queryExecution().optimizedPlan().toString()
    want = [(None, None) if t is None else (fnv(t.encode()), fnv(np.frombuffer(t.encode("utf-16-be"), ">u2").tolist())) for t in texts]
    assert [(r.b, r.w) for r in got.orderBy("i").collect()] == want


def test_alike_markers_are_hit_together(spark, monkeypatch):
    rows = [(f"m{i}", i, float(i % 4), 0.0, "box", 2.0) for i in range(200)]
    markers = spark.createDataFrame(rows, "id string, ord long, x double, y double, shape string, size double")
    positions = spark.createDataFrame([(0, 0.0, 0.0), (1, 9.0, 9.0)], "pos_id int, qx double, qy double").selectExpr(
        "*", "named_struct('cx', 0D, 'cy', 0D, 'zoom', 1D, 'vw', 10D, 'vh', 10D) AS view", "named_struct('m11', 1D, 'm12', 0D, 'm21', 0D, 'm22', 1D) AS m", "1.0D AS dpr", "2.0D AS max_size"
    )
    joined, whole = [], SP.bucketed_join
    monkeypatch.setattr(SP, "bucketed_join", lambda points, *a, **k: joined.append(points) or whole(points, *a, **k))
    assert [tuple(r) for r in SP.topmost_marker(markers, positions, 1.0).collect()] == [(0, "m198", 150)]
    assert joined[0].count() == 4
