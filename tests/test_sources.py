import gzip
import hashlib
import itertools
import json
import os
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from starloom.operators import inventory as INV, ledger as L, tiles as T, validate as V
from starloom.sources import catalog_csv as CSV, fits as FITS, metadata as META, objects as OBJ, tile_store as TS, tile_table as TT


def header(*cards):
    text = "".join(f"{k:<8}= {v}"[:80].ljust(80) for k, v in cards) + "END".ljust(80)
    return text.ljust(-(-len(text) // 2880) * 2880).encode()


def padded(data):
    return data + b"\0" * (-len(data) % 2880)


def image(a, extra=()):
    bits = {"f4": -32, "i2": 16}[a.dtype.str[1:]]
    return header(("SIMPLE", "T"), ("BITPIX", bits), ("NAXIS", 2), ("NAXIS1", a.shape[1]), ("NAXIS2", a.shape[0]), *extra) + padded(a.astype(a.dtype.newbyteorder(">")).tobytes())


@pytest.fixture()
def folder(tmp_path):
    a = np.arange(40 * 30, dtype=np.float32).reshape(40, 30)
    a[3, 4] = np.nan
    (tmp_path / "one.fits").write_bytes(image(a, (("FILTER", "'F444W   '"),)))
    with gzip.open(tmp_path / "two.fits.gz", "wb") as f:
        f.write(image(np.arange(12, dtype=np.int16).reshape(3, 4), (("BZERO", 2), ("BLANK", 5))))
    cube = header(("SIMPLE", "T"), ("BITPIX", 8), ("NAXIS", 3), ("NAXIS1", 2), ("NAXIS2", 2), ("NAXIS3", 2)) + padded(b"12345678")
    (tmp_path / "cube.fit").write_bytes(cube)
    (tmp_path / "broken.fits").write_bytes(b"not fits")
    (tmp_path / "note.txt").write_bytes(b"skip")
    return tmp_path, a


def test_scan_and_read_images(spark, folder):
    path, a = folder
    files = FITS.discover(spark, str(path))
    assert {os.path.basename(r.path) for r in files.collect()} == {"one.fits", "two.fits.gz", "cube.fit", "broken.fits"}
    heads = FITS.scan_headers(files)
    wide = {os.path.basename(r.file): r for r in FITS.wide_headers(heads, ["NAXIS", "FILTER"]).collect()}
    assert wide["one.fits"].filter == "F444W" and wide["cube.fit"].naxis == "3"
    rows = FITS.image_rows(spark, heads)
    one = rows.filter(F.col("file").endswith("one.fits")).orderBy("y").toPandas()
    assert one.img_h[0] == 40
    np.testing.assert_array_equal(np.stack(one["values"].to_numpy()), a)
    two = rows.filter(F.col("file").endswith(".gz")).orderBy("y").toPandas()
    got = np.stack(two["values"].to_numpy())
    assert np.isnan(got[1, 1]) and got[0, 0] == 2.0 and got[2, 3] == 13.0
    assert rows.filter(F.col("file").endswith("cube.fit")).isEmpty()
    hdus = FITS.wide_headers(heads, ["NAXIS", "CTYPE1", "CTYPE2"]).select("file", "hdu", F.col("naxis").cast("int").alias("naxis"), "ctype1", "ctype2")
    assert [(os.path.basename(r.entity), r.rule) for r in INV.input_rejects(hdus).collect()] == [("cube.fit", "not_two_dimensional")]
    t = T.tiles_from_rows(one_band(rows), 16)
    assert t.count() == 6


def one_band(rows):
    return rows.filter(F.col("file").endswith("one.fits")).withColumn("band", F.lit("one")).drop("file")


def test_scan_compressed_tables(spark, tmp_path):
    n, width = 6, 24
    table = np.zeros(n, dtype=[("d", ">i4", 2), ("s", ">f8"), ("z", ">f8")])
    table["d"][:, 0], table["d"][:, 1], table["s"], table["z"] = np.arange(1, n + 1), np.arange(n) * 10, 0.5, np.arange(n)
    cards = [
        ("XTENSION", "'BINTABLE'"), ("BITPIX", 8), ("NAXIS", 2), ("NAXIS1", width), ("NAXIS2", n), ("PCOUNT", 100), ("GCOUNT", 1), ("TFIELDS", 3), ("THEAP", n * width + 8),
        ("TTYPE1", "'COMPRESSED_DATA'"), ("TFORM1", "'1PB(9)'"), ("TTYPE2", "'ZSCALE'"), ("TFORM2", "'1D'"), ("TTYPE3", "'ZZERO'"), ("TFORM3", "'1D'"), ("ZCMPTYPE", "'RICE_1'"),
        ("ZNAXIS1", 250), ("ZNAXIS2", 150), ("ZTILE1", 100), ("ZTILE2", 100), ("ZQUANTIZ", "'SUBTRACTIVE_DITHER_1'"), ("ZDITHER0", 12), ("ZBLANK", -9),
    ]
    head = header(("SIMPLE", "T"), ("BITPIX", 8), ("NAXIS", 0)) + header(*cards)
    (tmp_path / "t.fits.fz").write_bytes(head + padded(table.tobytes() + b"x" * 108))
    assert FITS.discover(spark, str(tmp_path)).count() == 0  # what a build puts out is no input
    heads = FITS.scan_headers(FITS.discover(spark, str(tmp_path), FITS.OUTPUT_GLOB))
    idx = TT.scan_tile_index(spark, str(tmp_path)).orderBy("row").toPandas()
    assert idx.start.tolist() == [len(head) + n * width + 8 + 10 * i for i in range(n)]
    assert idx.length.tolist() == [1, 2, 3, 4, 5, 6] and idx.w.tolist() == [100, 100, 50] * 2 and idx.h.tolist() == [100] * 3 + [50] * 3
    assert idx.zzero.tolist() == [0, 1, 2, 3, 4, 5] and set(idx.zblank) == {-9.0} and set(idx.dither_method) == {1}
    lay = TT.table_layout(heads.filter("hdu = 1")).withColumn("entity", F.lit("t")).withColumn("n_rows", F.lit(7))
    assert [r.rule for r in V.tile_tables(lay).collect()] == ["row_count"]


def row_table(n, seed):
    table = np.zeros(n, dtype=[("d", ">i8", 2), ("b", ">i4"), ("s", ">f8")])
    rng = np.random.default_rng(seed)
    table["d"][:, 0], table["d"][:, 1] = rng.integers(1, 900, n), np.arange(n) * 900
    table["b"], table["s"] = rng.integers(-9, 9, n), rng.random(n)
    cards = [
        ("XTENSION", "'BINTABLE'"), ("BITPIX", 8), ("NAXIS", 2), ("NAXIS1", 28), ("NAXIS2", n), ("PCOUNT", 0), ("GCOUNT", 1), ("TFIELDS", 3),
        ("TTYPE1", "'COMPRESSED_DATA'"), ("TFORM1", "'1QB(900)'"), ("TTYPE2", "'ZBLANK'"), ("TFORM2", "'1J'"), ("TTYPE3", "'ZSCALE'"), ("TFORM3", "'1D'"),
        ("ZCMPTYPE", "'GZIP_2'"), ("ZNAXIS1", n * 8 - 3), ("ZNAXIS2", 8), ("ZTILE1", 8), ("ZTILE2", 8),
    ]
    head = header(("SIMPLE", "T"), ("BITPIX", 8), ("NAXIS", 0)) + header(*cards)
    return table, len(head), head + padded(table.tobytes())


def test_row_tables_are_read_in_shares(spark, tmp_path, monkeypatch):
    """One table of 200 000 rows by many tasks, small ones together; a filter on the file opens no other; unreadable files have their reason."""
    large, start, octets = row_table(200_000, 1)
    (tmp_path / "large.fits.fz").write_bytes(octets)
    small = {f"s{i}.fits.fz": row_table(3 + i, i) for i in range(5)}
    for name, (_, _, o) in small.items():
        (tmp_path / name).write_bytes(o)
    empty = re.sub(rb"(NAXIS2  = *)1 ", rb"\g<1>0 ", row_table(1, 0)[2])
    for name, o in {"bad.fits.fz": b"none", "cut.fits.fz": octets[:9000], "plain.fits.fz": header(("SIMPLE", "T"), ("NAXIS", 0)), "none.fits.fz": empty, "other.fits": octets}.items():
        (tmp_path / name).write_bytes(o)
    parts = TT.read_row_tables(spark, str(tmp_path), chunk=500_000)
    assert parts.rdd.getNumPartitions() >= 12
    bad = {os.path.basename(r.file): r.error for r in parts.filter("error is not null").collect()}
    assert set(bad) == {"bad.fits.fz", "cut.fits.fz", "plain.fits.fz"} and "cut short" in bad["cut.fits.fz"]
    idx = TT.scan_tile_index(spark, str(tmp_path), chunk=500_000).toPandas()
    for name, (table, at, _) in {**small, "large.fits.fz": (large, start, None)}.items():
        rows = idx[idx.file == f"{tmp_path}/{name}"].sort_values("row")
        n = len(table)
        assert rows.row.tolist() == list(range(n)) and rows.length.tolist() == table["d"][:, 0].tolist()
        assert rows.start.tolist() == (at + n * 28 + table["d"][:, 1]).tolist() and rows.zscale.tolist() == table["s"].tolist()
        assert rows.zblank.tolist() == table["b"].tolist() and rows.w.tolist() == [8] * (n - 1) + [5] and rows.zzero.isna().all()
    assert len(idx) == 200_000 + sum(3 + i for i in range(5))
    one = TT.scan_tile_index(spark, str(tmp_path), files=[f"{tmp_path}/s2.fits.fz"])
    assert one.count() == 5
    for name in list(small) + ["large.fits.fz"]:
        if name != "s2.fits.fz":
            (tmp_path / name).write_bytes(b"gone")
    assert TT.read_row_tables(spark, str(tmp_path)).filter(F.col("file") == f"{tmp_path}/s2.fits.fz").filter("error is null").count() == 1


def test_headers_read_alike_in_columns_and_in_files(spark):
    from starloom.functions.cards import word, words

    texts = {"A": "'it''s  '  / said", "B": "  12 / n", "C": "T", "D": "'a / b'", "E": "", "F": "/ only a comment", "G": "1.5E3 /x'y'"}
    text = "".join(f"{f'{k:<8}= {v}':<80}" for k, v in texts.items()) + f"{'A       = 9':<80}" + f"{'COMMENT = no':<80}" + f"{'END':<80}" + f"{'Z       = 1':<80}"
    got = spark.createDataFrame([(text,)], "t string").select(*[word(words(F.col("t")), k).alias(k) for k in (*texts, "Z")]).first().asDict()
    assert {k: v for k, v in got.items() if v is not None} == {k: v for k, v in FITS.header_words(text).items() if k in got}


def test_catalog_round_trip(spark, tmp_path):
    src = "﻿# sky-catalog v1\r\n# note\r\nRA, dec,ID,Mag,edge_width\r\n10.5,-3,a,nan,2\r\n,,b,1,1\r\n1,2\r\n0.1,1e-7,\"c, d\",21.5,\r\n"
    (tmp_path / "c.csv").write_text(src, newline="")
    rows = CSV.read_catalog(spark, str(tmp_path / "c.csv")).collect()
    good = sorted((r for r in rows if not r.malformed), key=lambda r: r.id)
    assert [(r.id, r.ra, r.dec, r.edgewidth, r.data) for r in good] == [("a", 10.5, -3.0, 2.0, {}), ("c, d", 0.1, 1e-7, None, {"mag": "21.5"})]
    assert sum(r.malformed for r in rows) == 2
    assert CSV.version_violations(spark, str(tmp_path / "c.csv")).isEmpty()
    (tmp_path / "old.csv").write_text("# sky-catalog v3\nra,dec\n1,2\n")
    assert CSV.version_violations(spark, str(tmp_path / "old.csv")).count() == 1
    df = spark.createDataFrame([(2.0, 0.1, "q", float("nan")), (1.0, 1 / 3, "p", 4.0)], "ra double, dec double, note string, flux double")
    out = str(tmp_path / "out")
    CSV.write_catalog(df, out, ["ra"])
    again = CSV.read_catalog(spark, out).orderBy("ra").collect()
    assert [(r.id, r.ra, r.dec, r.data) for r in again] == [("src_0000", 1.0, 1 / 3, {"flux": "4.0", "note": "p"}), ("src_0001", 2.0, 0.1, {"note": "q"})]
    with pytest.raises(ValueError):
        CSV.write_catalog(df.drop("dec"), out, ["ra"])


def test_tile_store_prunes(spark, tmp_path):
    rows = [("b", z, x, y, 2, 2, 8, 8, [1.0] * 4) for z in (0, 1) for x in range(4 >> z) for y in range(4 >> z)]
    t = spark.createDataFrame(rows, "band string, z int, tile_x int, tile_y int, w int, h int, img_h int, img_w int, pixels array<float>")
    path = str(tmp_path / "tiles")
    TS.write_tiles(t, path, 2)
    assert TS.read_tiles(spark, path).count() == 20
    win = TS.read_window(spark, path, "b", 0, 1, 1, 2, 3)
    assert win.count() == 6
    plan = win._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(band" in plan and "GreaterThanOrEqual(tile_x,1)" in plan


def test_object_listing_and_diff(spark, tmp_path):
    for name, data in {"index.html": b"<html>", "assets/a.js": b"1", "b/x_z0.fits.fz": b"tile", ".hid/x": b"no", "deploy-manifest.json": b"{}"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    led = {r.path: r for r in OBJ.list_objects(spark, str(tmp_path)).collect()}
    assert set(led) == {"index.html", "assets/a.js", "b/x_z0.fits.fz"}
    assert led["b/x_z0.fits.fz"].sha256 == hashlib.sha256(b"tile").hexdigest() and led["b/x_z0.fits.fz"].cls == "tile"
    df = OBJ.list_objects(spark, str(tmp_path))
    v = L.volume(L.diff(df, df)).first()
    assert v.is_noop and v.upload_bytes == 0


def test_manifest_round_trip(spark, tmp_path):
    lv = spark.createDataFrame(
        [("m", "s.fits", 256, 300, 500, 0, 300, 500, 2, 2, 0.03), ("m", "s.fits", 256, 300, 500, 1, 150, 250, 1, 1, 0.06)],
        "band string, source_file string, tile_size int, img_h int, img_w int, z int, h int, w int, n_ty int, n_tx int, pixel_scale_arcsec double",
    ).withColumn("wcs", F.create_map(F.lit("CTYPE1"), F.lit("RA---TAN")))
    st = spark.createDataFrame([("m", 0, 0, "a", 0, 0, 1, 2), ("m", 0, 1, "b", 1, 0, 1, 2), ("m", 1, 0, "c", 0, 0, 1, 1)], "band string, z int, idx int, filename string, tx0 int, ty0 int, nx int, ny int")
    text = META.manifest_json(lv, st).first().json
    assert json.loads(text)["levels"][0]["filename"] == "a" and json.loads(text)["n_levels"] == 1
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "manifest.json").write_text(text)
    (tmp_path / "old").mkdir()
    old = json.loads(text)
    old["version"] = 1
    for level in old["levels"]:
        del level["supertiles"]
    (tmp_path / "old" / "manifest.json").write_text(json.dumps(old))
    m = META.read_manifests(spark, str(tmp_path))
    assert META.manifest_violations(m).isEmpty()
    got = {(r.path.split("/")[-2], r.z, r.filename, r.nx, r.ny) for r in META.manifest_supertiles(META.manifest_levels(m)).collect()}
    assert got == {("m", 0, "a", 1, 2), ("m", 0, "b", 1, 2), ("m", 1, "c", 1, 1), ("old", 0, "a", 2, 2), ("old", 1, "c", 1, 1)}


def test_json_refuses_nan(spark, tmp_path):
    df = spark.createDataFrame([("a", '{"x":1}', float("nan"))], "k string, json string, x double")
    with pytest.raises(ValueError):
        META.write_json(df, str(tmp_path / "j"), "k", df, ["x"])
    META.write_json(df, str(tmp_path / "j"), "k", df.withColumn("x", F.lit(1.0)), ["x"])


def sequential_names(stems):
    taken, out = set(), []
    for s in stems:
        base = s + "_1" if s in ("catalog",) else s
        name, i = base, 2
        while name in taken:
            name, i = f"{base}_{i}", i + 1
        taken.add(name)
        out.append(name)
    return out


def test_unique_names_against_a_loop(spark):
    pool = ["a", "a_2", "a_3", "a_2_2", "catalog", "catalog_1", "a_02"]
    seqs = [p for n in (3, 4) for p in itertools.product(pool[:4], repeat=n)][::3] + [("catalog", "catalog_1", "catalog"), ("a", "a_02", "a"), ("a_2", "a", "a", "a_2", "a"), tuple(pool) * 2]
    rows = [(d, i, s) for d, seq in enumerate(seqs) for i, s in enumerate(seq)]
    got = INV.unique_names(spark.createDataFrame(rows, "d int, ord bigint, stem string"), ["d"], "stem").toPandas().sort_values(["d", "ord"])
    want = [n for seq in seqs for n in sequential_names(seq)]
    assert got.slug.tolist() == want


def test_band_detection_cases(spark):
    heads = [
        ("JWST", "NIRCAM", "F444W", "CLEAR", "", "", "", "F444W", 4.421), ("JWST", "NIRCAM", "F322W2", "F323N", "", "", "", "F323N", 3.237), ("", "MIRI", "F770W", "", "", "", "", "F770W", 7.7),
        ("HST", "ACS", "", "", "CLEAR1L", "F814W", "", "F814W", 0.8057), ("HST", "ACS", "", "", "F606W", "F814W", "", None, None), ("HST", "WFC3", "F160W", "", "", "", "IR", "F160W", 1.5369),
        ("HST", "WFC3", "F999W", "", "", "", "", "F999W", 0.999), ("JWST", "NIRSPEC", "F444W", "", "", "", "", None, None), ("JWST", "ACS", "", "", "CLEAR", "F814W", "", None, None), ("JWST", "NIRCAM", "CLEAR", "CLEAR", "", "", "", None, None),
    ]
    df = spark.createDataFrame([(i, *h[:7]) for i, h in enumerate(heads)], "k int, telescop string, instrume string, filter string, pupil string, filter1 string, filter2 string, detector string")
    got = {r.k: (r.band_filter, r.pivot_um) for r in INV.detect_from_headers(df, ["k"]).collect()}
    assert got == {i: (h[7], pytest.approx(h[8])) for i, h in enumerate(heads) if h[7]}
    names = {"mosaic_f128n_sci.fits": ("F128N", "", 1.28), "xf090w.fits": None, "f200w_matched_to_f444w.fits": None, "weight.fits": None, "a.F814W-wfc3.fits": ("F814W", "WFC3", 0.8039), "f150w_nircam_niriss.fits": ("F150W", "NIRCam", 1.501)}
    got = {r.name: (r.band_filter, r.instrument, pytest.approx(r.pivot_um)) for r in INV.detect_from_names(spark.createDataFrame([(n,) for n in names], "name string"), ["name"]).collect()}
    assert got == {n: v for n, v in names.items() if v}


def test_manifest_fields_of_a_wrong_type(spark):
    """What the typed parse leaves null is told from what is missing."""
    good = {"version": 2, "native_shape": [4, 4], "n_levels": 0, "levels": [{"z": 0, "filename": "f", "shape": [4, 4], "fpack_tile_count": [1, 1]}]}
    level = lambda **more: {"levels": [{**good["levels"][0], **more}]}
    cases = {
        "good": ({}, set()), "whole": ({"version": 2.0}, set()), "fraction": ({"version": 2.5}, {"version"}), "text": ({"version": "2"}, {"version"}), "null": ({"version": None}, {"version"}), "flag": ({"version": True}, {"version"}),
        "n": ({"n_levels": "x"}, {"levels"}), "n null": ({"n_levels": None}, {"levels"}), "half": ({"n_levels": 0.5}, {"levels"}),
        "tiles text": (level(supertiles="no"), {"supertiles"}), "tiles null": (level(supertiles=None), {"supertiles"}), "tiles object": (level(supertiles={}), {"supertiles"}), "z": (level(z="0"), {"levels"}),
    }
    rows = [(name, json.dumps({**good, **change})) for name, (change, _) in cases.items()]
    rows += [(f"missing {key}", json.dumps({k: v for k, v in good.items() if k != key})) for key in ("version", "n_levels")]
    rows += [("broken", "{"), ("list", "[1]"), ("number", "7")]
    got = {}
    for r in META.manifest_violations(META.parse_manifests(spark.createDataFrame(rows, "path string, json string"))).collect():
        got.setdefault(r.entity, set()).add(r.rule)
    for name, (_, rules) in cases.items():
        assert got.get(name, set()) == rules, name
    assert "missing version" not in got and "missing n_levels" not in got
    assert all("json" in got[name] for name in ("broken", "list", "number"))


def test_small_tables_are_not_left_to_one_task(spark):
    from starloom.plans.files import compressed_tables

    tables = compressed_tables(spark, "/root/testdata/sf0.001")
    assert tables.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_words_of_a_table_header_as_columns_and_in_one_step(spark):
    from starloom.functions.cards import word, words
    from starloom.sources import tile_table as TT

    card = lambda k, v: f"{k:<8}= {v}".ljust(80)
    body = card("NAXIS1", "28") + card("NAXIS1", "99") + card("ZCMPTYPE", "'RICE_1  '") + card("TFIELDS", "2") + card("TFORM1", "'1PB(9)'") + card("TFORM2", "'2D'") + card("TTYPE2", "'B'")
    end = "END".ljust(80)
    texts = [body + end, body, end, "", None, body + card("TFIELDS", "x") + end, end + body, card("TFIELDS", "1") + card("TFORM1", "'?'") + end]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, header string")
    want = df.select("i", *[word(words(F.col("header")), k).alias(k) for k in TT._WORDS]).orderBy("i").collect()
    assert [tuple(r)[1:] for r in want] == [TT._head(t)[: len(TT._WORDS)] for t in texts]
    assert TT._head(texts[0])[-4:] == (["COL1", "B"], ["1PB(9)", "2D"], [0, 8], 24) and TT._head(texts[-1])[-4:] == (["COL1"], ["?"], None, None)


def test_tables_are_read_and_decoded_in_bounded_parts():
    from starloom.sources import tile_table as TT

    sizes = [TT.DECODED // 3] * 10
    shares = [at.tolist() for _, at in TT._shares(np.zeros((10, 6), np.int64), sizes)]
    assert sum(shares, []) == list(range(10)) and max(map(len, shares)) <= 4
    reader = TT.RowTableReader({"path": "/nowhere"})
    reader._rows = lambda p: (("f", "h", 0, i, bytes(TT.PIECE // 2), None) for i in range(7))
    batches = list(reader.read(TT.Share([])))
    assert sum(b.num_rows for b in batches) == 7 and max(b.num_rows for b in batches) == 2


def test_manifest_text_is_parsed_once_for_all_rules(spark):
    texts = spark.createDataFrame([("a", '{"version":2.5,"levels":[]}')], "path string, json string")
    found = META.manifest_violations(META.parse_manifests(texts))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("VariantExpressionEvalUtils.parseJson") == 1
    assert {r.rule for r in found.collect()} >= {"version", "no_levels", "native_shape"}


def test_files_are_read_by_all_tasks(spark, tmp_path):
    paths = spark.createDataFrame([(str(tmp_path / f"{i}.fits"),) for i in range(20)], "path string").distinct()
    assert FITS.scan_headers(paths).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
