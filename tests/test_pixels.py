import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from starloom import kernels
from starloom.functions import grid, stretch as S
from starloom.operators import mosaic as M, pyramid as P, quantise as Q, stats as ST, tiles as T


def rows_of(spark, images):
    """images: {band: 2-D array}."""
    rows = [(b, a.shape[0], a.shape[1], y, [float(v) for v in line]) for b, a in images.items() for y, line in enumerate(a)]
    return spark.createDataFrame(rows, "band string, img_h int, img_w int, y int, values array<float>")


def array_of(px, band, z=0):
    part = px[(px.band == band) & (px.z == z)]
    return part.pivot(index="y", columns="x", values="v").to_numpy()


def block_mean(a, f):
    h, w = a.shape[0] // f, a.shape[1] // f
    blocks = a[: h * f, : w * f].reshape(h, f, w, f).astype(float)
    n = np.isfinite(blocks).sum(axis=(1, 3))
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(n > 0, np.nansum(blocks, axis=(1, 3)) / n, np.nan)


@pytest.fixture(scope="module")
def images():
    rng = np.random.default_rng(5)
    a = rng.normal(1, 0.1, (37, 150)).astype(np.float32)
    a[3:9, 40:90] = np.nan
    a[rng.random(a.shape) < 0.02] = np.nan
    return {"p": a, "q": rng.normal(0, 1, (8, 8)).astype(np.float32)}


def test_pyramid_two_rounds(spark, images):
    """Tile 8 holds three levels, the image needs five: sums and counts carry over."""
    native = T.tiles_from_rows(rows_of(spark, images), 8)
    px = T.pixels_from_tiles(P.build_pyramid(native, 8), 8).toPandas()
    assert sorted(px[px.band == "p"].z.unique()) == [0, 1, 2, 3, 4, 5]
    assert sorted(px[px.band == "q"].z.unique()) == [0]
    for z in range(6):
        np.testing.assert_allclose(array_of(px, "p", z), block_mean(images["p"], 2**z), rtol=1e-5, atol=1e-7)


def test_pixel_and_tile_grain_agree(spark, images):
    rows = rows_of(spark, images)
    px = rows.select("band", F.lit(0).alias("z"), "y", F.posexplode("values").alias("x", "v"))
    dims = rows.select("band", "img_h", "img_w").distinct()
    got = P.downsample_pixels(px, 4, dims).withColumn("z", F.lit(2)).toPandas()
    np.testing.assert_allclose(array_of(got, "p", 2), block_mean(images["p"], 4), rtol=1e-6)


@pytest.mark.parametrize("shape,n", [((1024, 1024), 2), ((256, 1), 0), ((257, 1), 1), ((512, 3), 1), ((513, 3), 2), ((1, 1 << 20), 12)])
def test_level_count(spark, shape, n):
    got = spark.range(1).select(grid.n_downsample_levels(F.lit(shape[0]), F.lit(shape[1])).alias("n")).first().n
    assert got == n


def test_overlap_nan_winner_and_ties(spark):
    strips = [("b", e, r, v) for e, img in ((0, [[1.0, 1.0, 1.0, 1.0]]), (1, [[2.0, float("nan"), 2.0, 2.0]])) for r, v in enumerate(img)]
    s = spark.createDataFrame(strips, "band string, exposure int, row int, values array<float>")
    e = spark.createDataFrame(
        [("b", 0, 0, 4, 1, 10.0, 1.0), ("b", 1, 1, 4, 1, 8.0, 1.0)], "band string, exposure int, ord bigint, nx int, ny int, crpix1 double, crpix2 double"
    )
    for c, v in (("crval1", 1.0), ("crval2", 2.0), ("cd11", -1.0), ("cd12", 0.0), ("cd21", 0.0), ("cd22", 1.0)):
        e = e.withColumn(c, F.lit(v))
    e = M.with_signature(e.withColumn("ctype1", F.lit("RA---TAN")).withColumn("ctype2", F.lit("DEC--TAN")))
    frame = M.frames(e)
    got = M.resolve_overlaps(s, M.place(e, frame)).orderBy("x").toPandas()
    # Centres at 1.5 and 3.5: pixel 2 is nearer the first, 3 the second (its NaN stays).
    assert got.ord.tolist() == [0, 0, 0, 1, 1, 1]
    assert np.isnan(got.v[3]) and got.v[2] == 1.0 and got.v[5] == 2.0


def test_dither_table_end():
    table = kernels.dither_table()
    seed = 1
    for _ in range(kernels.N_RANDOM):
        seed = (kernels.LCG_A * seed) % kernels.LCG_M
    assert seed == 1043618065
    n = 30000
    got = kernels.dither_values(table, 9995, 3, n)
    at, want = (9995 + 3 - 1) % 10000, []
    j = int(np.float32(table[at] * np.float32(500)))
    for _ in range(n):
        want.append(table[j])
        j += 1
        if j == 10000:
            at = (at + 1) % 10000
            j = int(np.float32(table[at] * np.float32(500)))
    assert (got == np.array(want, dtype=np.float32)).all()


def test_quantise_round_trip(spark):
    rng = np.random.default_rng(8)
    px = rng.normal(0, 1, 5000).astype(np.float32)
    px[::50], px[1::70] = np.nan, 0.0
    df = spark.createDataFrame(
        [("b", [float(v) for v in px], 0.125, 0.25, float(Q.BLANK), 2, 77, 9999)],
        "band string, pixels array<float>, zscale double, zzero double, zblank double, dither_method int, zdither0 int, tile_index int",
    )
    back = np.array(Q.dequantise(Q.quantise(df)).first().pixels)
    assert (np.isnan(back) == np.isnan(px)).all()
    assert (back[px == 0] == 0).all()
    assert np.nanmax(np.abs(back - px)) <= 0.0626


def test_zscale_of_a_ramp_and_of_nothing():
    # A clean ramp has slope 1 per rank: the cuts are clipped to its ends.
    assert kernels.zscale_limits(np.arange(1000.0)) == (0.0, 999.0)
    assert kernels.zscale_limits(np.full(100, 2.0)) is None
    assert kernels.zscale_limits(np.array([])) is None
    rng = np.random.default_rng(9)
    sky = np.r_[rng.normal(100, 5, 950), rng.uniform(500, 5000, 50)]
    z1, z2 = kernels.zscale_limits(sky)
    assert 80 < z1 < 100 < z2 < 200


def test_degenerate_statistics(spark):
    nan = float("nan")
    t = spark.createDataFrame(
        [("nothing", 0, 0, 0, 2, 2, 2, 2, [nan] * 4), ("flat", 0, 0, 0, 2, 2, 2, 2, [3.0] * 4), ("outlier", 0, 0, 0, 2, 2, 2, 2, [1.0, 1.0, 1.0, 9.0])],
        "band string, z int, tile_x int, tile_y int, w int, h int, img_h int, img_w int, pixels array<float>",
    )
    assert {r.band for r in ST.band_histogram(t).select("band").distinct().collect()} == {"outlier"}
    assert ST.trilogy_stats(ST.quota_sample(t, 2, 1)).count() == 0
    assert [r.entity for r in P.empty_levels(t).collect()] == ["nothing/0"]


def test_nearest_rank(spark):
    v = spark.createDataFrame([("a", float(i)) for i in range(101)] + [("c", 5.0)] * 3, "g string, v float")
    got = {r.g: (r.lo, r.hi) for r in ST.nearest_rank_range(v, ["g"], 0.01, 0.99).collect()}
    assert got == {"a": (1.0, 99.0)}


def test_stretch_golden(spark):
    tail = F.struct(*[F.lit(v).alias(n) for n, v in (("p99", 10.0), ("p99_9", 20.0), ("p99_99", 30.0), ("p99_999", 40.0))])
    sat = [S.saturation_value(tail, F.lit(sp)) for sp in (1, 0.1, 0.01, 0.001, (0.1 * 0.01) ** 0.5, 5, 1e-6)]
    big_tail = F.struct(*[F.lit(v).alias(n) for n, v in (("p99", 200.0), ("p99_9", 400.0), ("p99_99", 800.0), ("p99_999", 1600.0))])
    levels = S.trilogy_levels(F.lit(100.0), F.lit(5.0), big_tail)
    r = spark.range(1).select(
        S.stretch(F.lit(0.01), "log").alias("log"), S.stretch(F.lit(0.01), "asinh").alias("asinh"), F.array(*sat).alias("sat"), levels.alias("l"),
        S.solve_k(F.lit(0.3), F.lit(0.2)).alias("k"), S.trilogy_curve((levels["x1"] - levels["x0"]) / (levels["x2"] - levels["x0"]), levels["k"]).alias("f"),
        S.scale_value(F.lit(1.0), F.lit(1.0), F.lit(1.0), "linear").alias("same"), S.scale_value(F.lit(2.0), F.lit(1.0), F.lit(1.0), "linear").alias("above"),
    ).first()
    assert r.log == pytest.approx(0.34708067508455476, abs=1e-15) and r.asinh == pytest.approx(0.0332977502187707, abs=1e-15)
    assert r.sat == pytest.approx([10, 20, 30, 40, 25, 10, 40])
    assert (r.l.x0, r.l.x1, r.l.x2) == (90.0, 105.0, 1600.0) and r.f == pytest.approx(0.15, abs=1e-9) and r.k == 0
    assert np.isnan(r.same) and r.above == 1.0


def test_supertile_cover(spark):
    lv = spark.createDataFrame([("b", 0, 7, 10)], "band string, z int, n_ty int, n_tx int")
    s = P.supertile_blocks(lv, 3).toPandas()
    cells = [(x, y) for r in s.itertuples() for x in range(r.tx0, r.tx0 + r.nx) for y in range(r.ty0, r.ty0 + r.ny)]
    assert len(cells) == len(set(cells)) == 70 and s.idx.sort_values().tolist() == list(range(12))


def test_round_trip_flags(spark):
    cols = "band string, z int, tile_x int, tile_y int, pixels array<float>"
    nan = float("nan")
    a = spark.createDataFrame([("ok", 0, 0, 0, [1.0, nan]), ("mask", 0, 0, 0, [1.0, nan]), ("far", 0, 0, 0, [1.0, 2.0]), ("lost", 0, 1, 0, [1.0])], cols)
    b = spark.createDataFrame([("ok", 0, 0, 0, [1.05, nan]), ("mask", 0, 0, 0, [1.0, 2.0]), ("far", 0, 0, 0, [1.0, 3.0])], cols)
    tol = spark.createDataFrame([(n, 0, 0.1) for n in ("ok", "mask", "far", "lost")], "band string, z int, atol double")
    assert {r.band: r.ok for r in P.compare_tiles(a, b, tol).collect()} == {"ok": True, "mask": False, "far": False, "lost": False}


def test_weighted_composite_of_five_hundred_bands(spark, monkeypatch):
    """Partial sums over several tasks and flushes against one sum in numpy; holes, edge tiles, a band without spread, a channel without weight."""
    from starloom import kernels
    from starloom.operators import composite as C

    monkeypatch.setattr(kernels, "HELD_PIXELS", 64)
    rng = np.random.default_rng(11)
    n, sizes = 500, {(0, 0): (8, 8), (1, 0): (5, 8)}
    px = {(b, at): np.where(rng.random(w * h) < 0.3, np.nan, rng.random(w * h)).astype(np.float32) for b in range(n) for at, (w, h) in sizes.items()}
    for b in range(n):
        px[b, (0, 0)][3] = np.nan
    knobs = [(f"b{b:03d}", 0.2, 0.2 if b == 7 else 0.9, float(b % 3) * 5, 1.0 + b % 4, float(b % 2), 0.0) for b in range(n)]
    rows = [(f"b{b:03d}", 0, at[0], at[1], *sizes[at], p.tolist()) for (b, at), p in px.items()]
    for b in (0, 9, 499):  # bands that end three rows earlier
        px[b, (1, 0)][25:] = np.nan
        rows = [(*r[:5], 5, r[6][:25]) if r[0] == f"b{b:03d}" and r[2] == 1 else r for r in rows]
    tiles = spark.createDataFrame(rows, "band string, z int, tile_x int, tile_y int, w int, h int, pixels array<float>")
    out = C.weighted_composite(tiles.repartition(7), spark.createDataFrame(knobs, "band string, x0 double, x2 double, k double, wr double, wg double, wb double"))
    assert "collect_list" not in out._jdf.queryExecution().executedPlan().toString()
    for row in out.collect():
        sums, seen = np.zeros((3, row.w * row.h)), np.zeros(row.w * row.h, bool)
        for b, (_, x0, x2, k, *w) in enumerate(knobs):
            v = px[b, (row.tile_x, row.tile_y)].astype(np.float64)
            x = np.clip((v - x0) / (x2 - x0), 0, 1) if x2 != x0 else (v > x0).astype(float)
            x = np.log(k * x + 1) / np.log(k + 1) if k > 0 else x
            sums += np.outer(w, np.where(np.isnan(v), 0, x))
            seen |= ~np.isnan(v)
        total = np.array([sum(k[4 + c] for k in knobs) for c in range(3)])[:, None]
        want = np.clip(np.divide(sums, total, out=np.zeros_like(sums), where=total > 0), 0, 1)
        np.testing.assert_allclose(np.array([[p.r, p.g, p.b] for p in row.out]).T, want, atol=1e-12)
        assert [p.shown for p in row.out] == seen.tolist()
