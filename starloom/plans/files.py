"""Queries over object ledgers, headers and metadata."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from starloom.functions import bands as B, naming as N, stretch as S
from starloom.operators import inventory as INV, ledger as L, ordering as O, stats as ST, validate as V
from starloom.plans import domain as D
from starloom.plans.registry import big, bigs, query, r, rs
from starloom.session import shared_folder

# -- ledgers --------------------------------------------------------------------------------------
#
# Pages and documents are objects: a page is a pointer or a site file, a document a tile.


def objects(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("page_id")
    page = F.when(k % 10 == 0, F.concat(F.lit("assets/p"), k, F.lit(".js"))).when(k == 1, "index.html").when(
        k % 10 == 3, F.concat(F.lit("."), k, F.lit("/x.css"))
    ).otherwise(F.concat(F.lit("field/p"), k, F.lit(".HTML")))
    d = F.col("doc_id")
    doc = F.concat(F.lit("b"), d % 3, F.lit("/t_"), d, F.when(d % 8 == 0, ".json").otherwise(".fits.fz"))
    pages = D.read(spark, sf, "pages").select(page.alias("path"), F.col("html").alias("content"), k.alias("n"))
    return pages.unionByName(D.read(spark, sf, "documents").select(doc.alias("path"), F.col("text").alias("content"), d.alias("n")))


OBJECTS_SQL = f"""obj AS (
  SELECT CASE WHEN page_id % 10 = 0 THEN 'assets/p' || page_id || '.js' WHEN page_id = 1 THEN 'index.html' WHEN page_id % 10 = 3 THEN '.' || page_id || '/x.css'
         ELSE 'field/p' || page_id || '.HTML' END AS path, html AS content, page_id AS n FROM pages
  UNION ALL SELECT 'b' || (doc_id % 3) || '/t_' || doc_id || CASE WHEN doc_id % 8 = 0 THEN '.json' ELSE '.fits.fz' END, text, doc_id FROM documents
), led AS (
  SELECT path, n, CASE WHEN path LIKE '%.fits.fz' THEN 'tile' WHEN path LIKE 'assets/%' THEN 'asset' ELSE 'pointer' END AS cls,
         CASE WHEN path LIKE '%.fits.fz' THEN 'application/octet-stream' WHEN path LIKE '%.js' THEN 'text/javascript' WHEN path LIKE '%.json' THEN 'application/json' ELSE 'text/html' END AS content_type,
         CASE WHEN path LIKE '%.fits.fz' THEN 'public, max-age=604800, stale-while-revalidate=2592000' WHEN path LIKE 'assets/%' THEN 'public, max-age=31536000, immutable' ELSE 'public, no-cache' END AS cache_control,
         sha256(content) AS sha256, octet_length(encode(content))::BIGINT AS size FROM obj WHERE NOT path LIKE '.%'
), remote AS (
  SELECT path, cls, content_type, CASE WHEN n % 6 = 1 THEN 'public, max-age=60' ELSE cache_control END AS cache_control, CASE WHEN n % 5 = 0 THEN 'old' ELSE sha256 END AS sha256, size FROM led WHERE n % 7 <> 0
  UNION ALL SELECT 'gone/' || path, cls, content_type, cache_control, sha256, size FROM led WHERE n % 9 = 0
)"""


def local_ledger(spark, sf):
    return L.ledger_rows(objects(spark, sf))


def remote_ledger(spark, sf):
    """The last published state: some objects missing, some older, some with other headers, some since removed."""
    led = L.ledger_rows(objects(spark, sf))
    n = F.regexp_extract("path", r"(\d+)\.[^/]*$", 1).try_cast("bigint")
    n = F.when(F.col("path") == "index.html", 1).otherwise(n)
    old = led.filter(n % 7 != 0).withColumn("cache_control", F.when(n % 6 == 1, "public, max-age=60").otherwise(F.col("cache_control"))).withColumn(
        "sha256", F.when(n % 5 == 0, "old").otherwise(F.col("sha256"))
    )
    gone = led.filter(n % 9 == 0).withColumn("path", F.concat(F.lit("gone/"), F.col("path")))
    return old.unionByName(gone)


@query("object_ledger", f"WITH {OBJECTS_SQL} SELECT path, cls, content_type, cache_control, sha256, size FROM led")
def object_ledger(spark, sf):
    return local_ledger(spark, sf)


DIFF_SQL = """dif AS (
  SELECT coalesce(l.path, r.path) AS path, CASE WHEN l.path IS NULL THEN CASE WHEN r.path LIKE '%.fits.fz' THEN 'tile' WHEN r.path LIKE 'assets/%' THEN 'asset' ELSE 'pointer' END ELSE l.cls END AS cls,
         CASE WHEN r.path IS NULL THEN 'new' WHEN l.path IS NULL THEN 'gone' WHEN l.sha256 <> r.sha256 THEN 'content' WHEN l.cache_control <> r.cache_control OR l.content_type <> r.content_type THEN 'headers' ELSE 'same' END AS reason,
         CASE WHEN l.path IS NULL THEN 0 ELSE l.size END AS size FROM led l FULL JOIN remote r ON l.path = r.path
), ch AS (
  SELECT *, CASE WHEN reason IN ('new', 'content', 'headers') THEN 'upload' WHEN reason = 'gone' THEN 'delete' ELSE 'unchanged' END AS action,
         cls = 'tile' AND reason IN ('content', 'headers', 'gone') AS purge FROM dif
)"""


def changes(spark, sf):
    return L.diff(remote_ledger(spark, sf), local_ledger(spark, sf))


@query("ledger_diff", f"WITH {OBJECTS_SQL}, {DIFF_SQL} SELECT path, cls, action, reason, purge, size::BIGINT AS size FROM ch")
def ledger_diff(spark, sf):
    return changes(spark, sf)


@query("first_publication", f"WITH {OBJECTS_SQL} SELECT path, 'upload' AS action, false AS purge, size FROM led")
def first_publication(spark, sf):
    return L.diff(None, local_ledger(spark, sf)).select("path", "action", "purge", "size")


@query(
    "deploy_volume",
    f"""WITH {OBJECTS_SQL}, {DIFF_SQL} SELECT cls, coalesce(sum(size) FILTER (WHERE action = 'upload'), 0)::BIGINT AS upload_bytes, count(*) FILTER (WHERE action = 'upload')::BIGINT AS uploads,
  count(*) FILTER (WHERE action = 'delete')::BIGINT AS deletes, bool_and(action = 'unchanged') AS is_noop FROM ch GROUP BY cls""",
)
def deploy_volume(spark, sf):
    return L.volume(changes(spark, sf), ["cls"]).select("cls", *big("upload_bytes", "uploads", "deletes"), "is_noop")


@query(
    "purge_batches",
    f"""WITH {OBJECTS_SQL}, {DIFF_SQL}, u AS (SELECT 'https://cdn.example.org/sky/' || path AS url, row_number() OVER (ORDER BY path) - 1 AS n FROM ch WHERE purge)
SELECT (n // 100)::BIGINT AS batch, count(*)::BIGINT AS n, min(url) AS first_url, max(url) AS last_url FROM u GROUP BY n // 100""",
)
def purge_batches(spark, sf):
    urls = changes(spark, sf).filter("purge").select(N.public_url(F.lit("https://cdn.example.org/sky/"), F.col("path")).alias("url"))
    b = L.batches(urls, ["url"], "url")
    return b.select(*big("batch"), F.size("items").cast("bigint").alias("n"), F.col("items")[0].alias("first_url"), F.element_at("items", -1).alias("last_url"))


@query(
    "publication_plan",
    f"""WITH {OBJECTS_SQL}, {DIFF_SQL} SELECT CASE WHEN cls = 'tile' THEN 0 ELSE 1 END::BIGINT AS stage, path FROM ch WHERE action = 'upload'
UNION ALL SELECT 2, path FROM ch WHERE action = 'delete' UNION ALL SELECT 3, path FROM ch WHERE purge UNION ALL SELECT 4, 'deploy-manifest.json'""",
)
def publication_plan(spark, sf):
    return L.publication(changes(spark, sf)).select(*big("stage"), "path")


@query(
    "site_merge",
    f"""WITH {OBJECTS_SQL} SELECT path, sha256, size FROM remote WHERE NOT (path = 'index.html' OR path LIKE 'assets/%')
UNION ALL SELECT path, sha256, size FROM led WHERE path = 'index.html' OR path LIKE 'assets/%'""",
)
def site_merge(spark, sf):
    site = local_ledger(spark, sf).filter(N.is_site_file(F.col("path")))
    return L.merge_site(remote_ledger(spark, sf), site).select("path", "sha256", "size")


@query(
    "object_audit",
    f"""WITH {OBJECTS_SQL} SELECT cls, count(*)::BIGINT AS objects, count(*) FILTER (WHERE size > 5000)::BIGINT AS over, max(size)::BIGINT AS largest_size,
  arg_max(path, lpad(size::VARCHAR, 12, '0') || path) AS largest_path, CASE WHEN max(size) > 5000 THEN 'warn' ELSE 'pass' END AS status FROM led GROUP BY cls""",
)
def object_audit(spark, sf):
    return L.size_audit(local_ledger(spark, sf), ["cls"], 5000).select("cls", *big("objects", "over", "largest_size"), "largest_path", "status")


@query(
    "check_rollup",
    """WITH c AS (SELECT l_suppkey AS k, CASE WHEN l_quantity > 49 AND l_discount > 0.09 THEN 'fail' WHEN l_quantity > 48 AND l_tax > 0.07 THEN 'warn' ELSE 'pass' END AS s FROM lineitem)
SELECT k::BIGINT AS entity, count(*) FILTER (WHERE s = 'fail')::BIGINT AS failures, count(*) FILTER (WHERE s = 'warn')::BIGINT AS warnings,
  (count(*) FILTER (WHERE s = 'fail') > 0)::BIGINT AS exit_code, (count(*) FILTER (WHERE s <> 'pass') > 0)::BIGINT AS strict_exit_code FROM c GROUP BY k""",
)
def check_rollup(spark, sf):
    li = D.read(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("entity"),
        F.when((F.col("l_quantity") > 49) & (F.col("l_discount") > 0.09), "fail").when((F.col("l_quantity") > 48) & (F.col("l_tax") > 0.07), "warn").otherwise("pass").alias("status"),
    )
    return L.exit_code(li, ["entity"]).select(*big("entity", "failures", "warnings", "exit_code", "strict_exit_code"))


BANDS_SQL = """bnd AS (
  SELECT s_suppkey AS k, 's' || s_suppkey AS band, s_suppkey % 11 <> 3 AS readable, CASE WHEN s_suppkey % 13 = 5 THEN 0 ELSE 3 END AS n_levels, 'h' || (s_suppkey % 4) AS grid_hash,
         CASE WHEN s_suppkey % 2 = 0 THEN 'h' || (s_suppkey % 5) END AS frame_hash FROM supplier
), sup AS (SELECT DISTINCT 's' || l_suppkey AS band, 's' || l_suppkey || '/' || (l_partkey % 40) AS path, l_suppkey AS sk, l_partkey % 40 AS pk FROM lineitem),
lost AS (SELECT band, count(*) AS lost FROM sup WHERE (sk % 6 = 1) AND pk % 7 = 2 GROUP BY band),
reuse AS (
  SELECT band, k, coalesce(lost, 0) AS lost, CASE WHEN NOT readable THEN 'unreadable' WHEN n_levels = 0 THEN 'no_levels' WHEN lost IS NOT NULL THEN 'missing_file'
    WHEN frame_hash IS NOT NULL AND frame_hash <> grid_hash THEN 'grid_changed' ELSE 'reusable' END AS reason FROM bnd LEFT JOIN lost USING (band)
)"""


def built_bands(spark, sf):
    k = F.col("s_suppkey")
    return D.read(spark, sf, "supplier").select(
        F.concat(F.lit("s"), k).alias("band"), (k % 11 != 3).alias("readable"), F.when(k % 13 == 5, 0).otherwise(3).alias("n_levels"),
        F.concat(F.lit("h"), k % 4).alias("grid_hash"), F.when(k % 2 == 0, F.concat(F.lit("h"), k % 5)).alias("frame_hash"),
    )


def reuse(spark, sf):
    s, p = F.col("l_suppkey"), F.col("l_partkey") % 40
    files = D.read(spark, sf, "lineitem").select(s.alias("s"), p.alias("p")).distinct()
    path = F.concat(F.lit("s"), F.col("s"), F.lit("/"), F.col("p"))
    st = files.select(F.concat(F.lit("s"), F.col("s")).alias("band"), path.alias("path"))
    present = files.filter(~((F.col("s") % 6 == 1) & (F.col("p") % 7 == 2))).select(path.alias("path"))
    return L.reusable_bands(built_bands(spark, sf), st, present)


@query("resume_check", f"WITH {BANDS_SQL} SELECT band, reason, reason = 'reusable' AS reuse, lost::BIGINT AS lost FROM reuse")
def resume_check(spark, sf):
    return reuse(spark, sf).select("band", "reason", "reuse", *big("lost"))


@query("orphan_bands", "SELECT CASE WHEN s_suppkey % 9 = 0 THEN '.' ELSE '' END || 's' || s_suppkey AS band FROM supplier WHERE s_suppkey % 9 <> 0 AND s_suppkey % 4 = 1")
def orphan_bands(spark, sf):
    k = F.col("s_suppkey")
    s = D.read(spark, sf, "supplier")
    name = F.concat(F.when(k % 9 == 0, ".").otherwise(""), F.lit("s"), k)
    return L.orphan_bands(s.select(name.alias("band")), s.filter(k % 4 != 1).select(F.concat(F.lit("s"), k).alias("band"))).select("band")


@query(
    "stats_carryover",
    f"""WITH {BANDS_SQL} SELECT band, CASE WHEN reason = 'reusable' AND k % 3 <> 0 THEN k * 1e0 ELSE k * 2e0 END AS mean, reason = 'reusable' AND k % 3 <> 0 AS carried FROM reuse""",
)
def stats_carryover(spark, sf):
    k = F.substring("band", 2, 20).cast("bigint")
    b = built_bands(spark, sf).select("band")
    prev = b.filter(k % 3 != 0).select("band", k.cast("double").alias("mean"))
    fresh = b.select("band", (k * 2.0).alias("mean"))
    return L.carry_over_stats(reuse(spark, sf).select("band", "reuse"), prev, fresh, ["mean"])


@query(
    "retention_budget",
    """WITH e AS (SELECT user_id % 7 AS ns, event_id AS key, ts, (value * 100)::BIGINT AS size FROM events), t AS (
  SELECT *, sum(size) OVER (PARTITION BY ns) AS total, coalesce(sum(size) OVER (PARTITION BY ns ORDER BY ts, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM e)
SELECT ns::BIGINT AS ns, key::BIGINT AS key, size FROM t WHERE before < total - 1000000""",
)
def retention_budget(spark, sf):
    e = D.read(spark, sf, "events").select(
        (F.col("user_id") % 7).alias("ns"), F.col("event_id").alias("key"), "ts", F.rint(F.col("value") * 100).cast("bigint").alias("size")
    )
    return L.evictions(e, ["ns"], ["ts", "key"], F.lit(1000000)).select(*big("ns", "key"), "size")


@query(
    "collection_cards",
    """WITH b AS (SELECT c_nationkey AS field, c_custkey AS ord, CASE WHEN c_custkey % 6 = 0 THEN 'NaN'::DOUBLE ELSE c_custkey % 360 END AS ra, (c_custkey % 90)::DOUBLE AS dec FROM customer),
p AS (SELECT field, count(*) AS n, arg_min(ra, ord) AS ra, arg_min(dec, ord) AS dec FROM b GROUP BY field)
SELECT n_nationkey::VARCHAR AS field, CASE WHEN n_nationkey % 3 = 0 THEN 'T' || n_nationkey WHEN n_nationkey % 3 = 1 THEN n_name ELSE n_nationkey::VARCHAR END AS title, coalesce(n, 0)::BIGINT AS band_count,
       CASE WHEN NOT isnan(ra) THEN ra END AS center_ra, CASE WHEN NOT isnan(ra) THEN dec END AS center_dec FROM nation LEFT JOIN p ON field = n_nationkey WHERE n_nationkey % 5 <> 4""",
)
def collection_cards(spark, sf):
    k = F.col("n_nationkey")
    none = F.lit(None).cast("string")
    fields = D.read(spark, sf, "nation").select(
        k.cast("string").alias("field"), F.when(k % 3 == 0, F.concat(F.lit("T"), k)).alias("title_override"), F.when(k % 3 == 1, "").otherwise(none).alias("title"),
        F.when(k % 3 == 1, F.col("n_name")).alias("dataset_name"), (k % 5 != 4).alias("built"),
    )
    c = F.col("c_custkey")
    bands = D.read(spark, sf, "customer").select(
        F.col("c_nationkey").cast("string").alias("field"), c.alias("ord"), F.when(c % 6 == 0, float("nan")).otherwise((c % 360).cast("double")).alias("crval1"), (c % 90).cast("double").alias("crval2")
    )
    return L.collection_cards(fields, bands).select("field", "title", *big("band_count"), "center_ra", "center_dec")


@query(
    "range_coalesce",
    """WITH e AS (SELECT l_suppkey AS file, l_partkey * 1000 + l_linenumber * 40 AS start, l_partkey * 1000 + l_linenumber * 40 + l_quantity::BIGINT * 10 AS stop FROM lineitem), m AS (
  SELECT *, max(stop) OVER (PARTITION BY file ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM e), i AS (
  SELECT *, sum(CASE WHEN reach IS NULL OR start > reach + 64 THEN 1 ELSE 0 END) OVER (PARTITION BY file ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS isl FROM m)
SELECT file::BIGINT AS file, min(start)::BIGINT AS start, (max(stop) - min(start))::BIGINT AS length FROM i GROUP BY file, isl""",
)
def range_coalesce(spark, sf):
    li = D.read(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("file"), (F.col("l_partkey") * 1000 + F.col("l_linenumber") * 40).alias("start"), (F.col("l_quantity").cast("bigint") * 10).alias("length")
    )
    return O.coalesce_ranges(li, ["file"], 64).select(*big("file", "start", "length"))


@query(
    "relative_paths",
    """SELECT page_id::BIGINT AS page_id, CASE WHEN page_id % 4 = 0 THEN NULL ELSE 'f/' || page_id || '/manifest.json' END AS rel, 'k/v/f/' || page_id AS key,
  'f/' || page_id || '/x.fits.fz' AS sibling FROM pages""",
)
def relative_paths(spark, sf):
    k = F.col("page_id")
    path = F.concat(F.when(k % 4 == 0, "/other/f/").otherwise("/data/f/"), k, F.lit("/manifest.json"))
    return D.read(spark, sf, "pages").select(
        *big("page_id"), N.relative_path(path, F.lit("/data/")).alias("rel"), N.object_key(F.lit("/k/v/"), F.concat(F.lit("f/"), k)).alias("key"),
        N.sibling(F.concat(F.lit("f/"), k, F.lit("/manifest.json")), F.lit("x.fits.fz")).alias("sibling"),
    )


# -- headers and bands ----------------------------------------------------------------------------

def headers(spark, sf):
    """Parts as image headers: every instrument, wheel layout and a few that cannot be told."""
    k = F.col("p_partkey")
    rows = [(i, f) for i, (_, f, _) in enumerate(B.PIVOTS)]
    # 84 rows, fixed.
    table = spark.createDataFrame(rows, "_i bigint, _known string")
    p = D.read(spark, sf, "part").withColumn("_i", k % len(rows)).join(F.broadcast(table), "_i")
    known = F.col("_known")
    odd = F.concat(F.lit("F"), F.lpad((k % 900 + 100).cast("string"), 3, "0"), F.when(k % 2 == 0, "W").otherwise("N"))
    filt = F.when(k % 5 == 0, odd).otherwise(known)
    ins = F.element_at(F.array(*[F.lit(i) for i in ("NIRCAM", "NIRISS", "MIRI", "ACS", "WFC3", "NIRSPEC")]), (k % 6 + 1).cast("int"))
    none = F.lit(None).cast("string")
    return p.select(
        F.col("p_brand").alias("dataset"), k.alias("ord"),
        F.concat(F.lit("mosaic_"), F.when(k % 3 == 0, F.concat(F.lower(ins), F.lit("_"))).otherwise(""), F.when(k % 7 == 0, "sci").otherwise(F.lower(filt)), F.when(k % 11 == 0, "_to_f444w").otherwise(""), F.lit(".fits")).alias("name"),
        F.when(k % 4 == 0, none).when(ins.isin("ACS", "WFC3"), "HST").otherwise("JWST").alias("telescop"),
        F.when(k % 8 == 5, none).otherwise(F.concat(F.lit(" "), F.lower(ins))).alias("instrume"),
        F.when(ins == "ACS", none).when(k % 9 == 0, "CLEAR").otherwise(filt).alias("filter"), F.when((ins == "NIRCAM") & (k % 12 == 0), "F323N").otherwise("CLEAR").alias("pupil"),
        F.when(ins == "ACS", F.when(k % 10 < 5, "CLEAR1L").otherwise(filt)).alias("filter1"), F.when(ins == "ACS", F.when(k % 10 < 7, filt).otherwise("CLEAR2L")).alias("filter2"),
        F.when(k % 2 == 0, "IR").otherwise("UVIS").alias("detector"),
    )


_TABLE = ", ".join(f"'{f}'" for _, f, _ in B.PIVOTS)
_PIV = ", ".join(f"('{k}', '{f}', {D.num(p)})" for k, f, p in B.PIVOTS)
_PREF = ", ".join(f"('{k}', '{t}', '{i}', {n})" for n, (k, t, i) in enumerate(B.PREFERENCE))
HEADERS_SQL = f"""h0 AS (
  SELECT p_partkey AS k, p_brand AS dataset, CASE WHEN p_partkey % 5 = 0 THEN 'F' || lpad((p_partkey % 900 + 100)::VARCHAR, 3, '0') || CASE WHEN p_partkey % 2 = 0 THEN 'W' ELSE 'N' END
    ELSE ([{_TABLE}])[p_partkey % 84 + 1] END AS f, (['NIRCAM', 'NIRISS', 'MIRI', 'ACS', 'WFC3', 'NIRSPEC'])[p_partkey % 6 + 1] AS ins FROM part
), h1 AS (
  SELECT *, 'mosaic_' || CASE WHEN k % 3 = 0 THEN lower(ins) || '_' ELSE '' END || CASE WHEN k % 7 = 0 THEN 'sci' ELSE lower(f) END || CASE WHEN k % 11 = 0 THEN '_to_f444w' ELSE '' END || '.fits' AS name,
         CASE WHEN k % 4 = 0 THEN '' WHEN ins IN ('ACS', 'WFC3') THEN 'HST' ELSE 'JWST' END AS tel, CASE WHEN k % 8 = 5 THEN '' ELSE ins END AS i,
         CASE WHEN ins = 'ACS' THEN '' WHEN k % 9 = 0 THEN 'CLEAR' ELSE f END AS filt, CASE WHEN ins = 'NIRCAM' AND k % 12 = 0 THEN 'F323N' ELSE 'CLEAR' END AS pupil,
         CASE WHEN ins = 'ACS' THEN CASE WHEN k % 10 < 5 THEN 'CLEAR1L' ELSE f END ELSE '' END AS f1, CASE WHEN ins = 'ACS' THEN CASE WHEN k % 10 < 7 THEN f ELSE 'CLEAR2L' END ELSE '' END AS f2, k % 2 = 0 AS ir FROM h0
), piv(key, f, p) AS (VALUES {_PIV}), pref(key, tel, name, n) AS (VALUES {_PREF}),
h2 AS (SELECT *, CASE WHEN i IN ('NIRCAM', 'NIRISS', 'MIRI') THEN i WHEN tel <> 'JWST' AND i IN ('ACS', 'WFC3') THEN i WHEN tel = 'HST' AND i IN ('ACS', 'WFC3') THEN i END AS ik FROM h1),
h3 AS (
  SELECT *, CASE WHEN ik IN ('NIRCAM', 'NIRISS') THEN CASE WHEN pupil <> 'CLEAR' THEN pupil WHEN filt <> 'CLEAR' THEN filt END WHEN ik IN ('MIRI', 'WFC3') THEN CASE WHEN filt NOT IN ('CLEAR', '') THEN filt END
    WHEN ik = 'ACS' THEN CASE WHEN f1 LIKE 'F%' AND f2 NOT LIKE 'F%' THEN f1 WHEN f2 LIKE 'F%' AND f1 NOT LIKE 'F%' THEN f2 END END AS bf,
    CASE WHEN ik = 'WFC3' THEN CASE WHEN ir THEN 'WFC3/IR' ELSE 'WFC3/UVIS' END ELSE ik END AS lk FROM h2
), byhdr AS (
  SELECT h3.k, h3.dataset, bf, lk, (SELECT name FROM pref WHERE pref.key = lk) AS instrument, (SELECT pref.tel FROM pref WHERE pref.key = lk) AS telescope FROM h3 WHERE bf IS NOT NULL
), nm AS (
  SELECT k, dataset, list_distinct(list_transform(list_filter(regexp_split_to_array(name, '[^a-zA-Z0-9]+'), lambda t: regexp_full_match(t, '[fF]\\d{{3,4}}([wW]2|[lL][pP]|[wWmMnNxX])?')), lambda t: upper(t))) AS fs,
         list_distinct(list_filter(list_transform(regexp_split_to_array(name, '[^a-zA-Z0-9]+'), lambda t: upper(t)), lambda t: t IN ('NIRCAM', 'NIRISS', 'MIRI', 'ACS', 'WFC3'))) AS ns FROM h3
), n1 AS (SELECT k, dataset, fs[1] AS bf, CASE WHEN len(ns) = 1 THEN ns[1] END AS ni FROM nm WHERE len(fs) = 1),
n2 AS (
  SELECT *, CASE WHEN ni = 'WFC3' THEN CASE WHEN EXISTS (SELECT 1 FROM piv WHERE piv.key = 'WFC3/IR' AND piv.f = bf) THEN 'WFC3/IR' ELSE 'WFC3/UVIS' END
    WHEN ni IS NOT NULL THEN ni ELSE (SELECT arg_min(pref.key, n) FROM pref JOIN piv USING (key) WHERE piv.f = bf) END AS lk FROM n1
), bynm AS (
  SELECT k, dataset, bf, coalesce(lk, 'NIRCAM') AS lk, coalesce((SELECT name FROM pref WHERE pref.key = n2.lk), '') AS instrument, coalesce((SELECT pref.tel FROM pref WHERE pref.key = n2.lk), '') AS telescope FROM n2
), det AS (
  SELECT d.*, coalesce(piv.p, CASE WHEN lk IN ('ACS', 'WFC3/UVIS') THEN regexp_extract(bf, '^F(\\d{{3,4}})', 1)::DOUBLE / 1000e0 ELSE regexp_extract(bf, '^F(\\d{{3,4}})', 1)::DOUBLE * 0.01e0 END) AS pivot_um,
         bf LIKE '%W' OR bf LIKE '%W2' AS wide FROM (
    SELECT * FROM byhdr UNION ALL SELECT * FROM bynm WHERE k NOT IN (SELECT k FROM byhdr)) d LEFT JOIN piv ON piv.key = lk AND piv.f = bf
)"""


def detected(spark, sf):
    return INV.detect_bands(headers(spark, sf), ["dataset", "ord"])


@query("detect_bands", f"WITH {HEADERS_SQL} SELECT k::BIGINT AS ord, dataset, bf AS band_filter, instrument, telescope, {rs('pivot_um', 9)} AS pivot_um, wide AS is_broadband FROM det")
def detect_bands(spark, sf):
    return detected(spark, sf).select(*big("ord"), "dataset", "band_filter", "instrument", "telescope", r("pivot_um", 9).alias("pivot_um"), "is_broadband")


@query(
    "contended_filters",
    f"WITH {HEADERS_SQL} SELECT dataset, bf AS band_filter, count(DISTINCT instrument)::BIGINT AS instruments FROM det WHERE instrument <> '' GROUP BY dataset, bf HAVING count(DISTINCT instrument) > 1",
)
def contended_filters(spark, sf):
    return INV.contended_filters(detected(spark, sf), ["dataset"]).select("dataset", "band_filter", *big("instruments"))


LABEL_SQL = """con AS (SELECT dataset, bf FROM det WHERE instrument <> '' GROUP BY ALL HAVING count(DISTINCT instrument) > 1), lab AS (
  SELECT det.*, con.bf IS NOT NULL AND instrument <> '' AS split FROM det LEFT JOIN con USING (dataset, bf))"""


@query(
    "band_labels",
    f"""WITH {HEADERS_SQL}, {LABEL_SQL} SELECT k::BIGINT AS ord, CASE WHEN split THEN instrument || ' ' || bf ELSE bf END AS label, lower(CASE WHEN split THEN instrument || '-' || bf ELSE bf END) AS seed FROM lab""",
)
def band_labels(spark, sf):
    return INV.band_labels(detected(spark, sf), ["dataset"]).select(*big("ord"), "label", "seed")


@query(
    "unique_names",
    f"""WITH {HEADERS_SQL}, {LABEL_SQL}, s AS (SELECT k, dataset, lower(CASE WHEN split THEN instrument || '-' || bf ELSE bf END) AS seed FROM lab)
SELECT k::BIGINT AS ord, seed || CASE WHEN n > 1 THEN '_' || n ELSE '' END AS slug FROM (SELECT *, row_number() OVER (PARTITION BY dataset, seed ORDER BY k) AS n FROM s)""",
)
def unique_names(spark, sf):
    labelled = INV.band_labels(detected(spark, sf), ["dataset"])
    return INV.unique_names(labelled, ["dataset"], "seed").select(*big("ord"), "slug")


@query(
    "default_views",
    f"""WITH {HEADERS_SQL}, b AS (SELECT *, 'n' || k AS name, k % 4 AS grp, k AS o FROM det), g AS (SELECT dataset, grp, min(o) AS f, count(*) FILTER (WHERE wide) AS n FROM b GROUP BY ALL),
best AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY n DESC, f) = 1), pool AS (SELECT b.* FROM b JOIN best USING (dataset, grp) WHERE best.n >= 3 AND b.wide),
ends AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY pivot_um, o) AS a, row_number() OVER (PARTITION BY dataset ORDER BY pivot_um DESC, o DESC) AS z FROM pool),
mid AS (SELECT dataset, (min(pivot_um) + max(pivot_um)) / 2 AS m FROM pool GROUP BY dataset),
gr AS (SELECT dataset, name FROM ends JOIN mid USING (dataset) WHERE a <> 1 AND z <> 1 QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY abs(pivot_um - m), pivot_um, o) = 1),
one AS (SELECT dataset, arg_min(name, o) AS name FROM b GROUP BY dataset)
SELECT one.dataset, CASE WHEN r.name IS NULL THEN 'single' ELSE 'rgb' END AS mode, CASE WHEN r.name IS NULL THEN one.name END AS band, r.name AS r, gr.name AS g, bl.name AS b
FROM one LEFT JOIN (SELECT dataset, name FROM ends WHERE z = 1) r USING (dataset) LEFT JOIN (SELECT dataset, name FROM ends WHERE a = 1) bl USING (dataset) LEFT JOIN gr USING (dataset)""",
)
def default_views(spark, sf):
    b = detected(spark, sf).withColumn("name", F.concat(F.lit("n"), F.col("ord"))).withColumn("grid_group", F.col("ord") % 4)
    return INV.default_views(b, "dataset")


@query(
    "file_stems",
    """WITH n AS (SELECT p_partkey AS k, CASE p_partkey % 6 WHEN 0 THEN 'My Field (' || p_partkey || ')' WHEN 1 THEN p_name || '.x' WHEN 2 THEN '' WHEN 3 THEN '\u00c9t\u00e9 ' || p_brand WHEN 4 THEN '--a_b-' || p_partkey ELSE '...' END AS name FROM part)
SELECT k::BIGINT AS ord, CASE WHEN name = '' THEN 'band' ELSE regexp_replace(name, '[^A-Za-z0-9_-]', '_', 'g') END AS slug,
  CASE WHEN trim(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '-') = '' THEN 'dataset' ELSE trim(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '-') END AS dataset, 'a.' || k AS stem FROM n""",
)
def file_stems(spark, sf):
    k = F.col("p_partkey")
    name = (
        F.when(k % 6 == 0, F.concat(F.lit("My Field ("), k, F.lit(")"))).when(k % 6 == 1, F.concat("p_name", F.lit(".x"))).when(k % 6 == 2, F.lit(""))
        .when(k % 6 == 3, F.concat(F.lit("\u00c9t\u00e9 "), "p_brand")).when(k % 6 == 4, F.concat(F.lit("--a_b-"), k)).otherwise(F.lit("..."))
    )
    file = F.concat(F.lit("a."), k, F.element_at(F.array(*[F.lit(s) for s in (".fits", ".FIT", ".fits.gz", ".Fits.FZ", "")]), (k % 5 + 1).cast("int")))
    return D.read(spark, sf, "part").select(k.cast("bigint").alias("ord"), N.band_slug(name).alias("slug"), N.dataset_slug(name).alias("dataset"), N.strip_fits_suffix(file).alias("stem"))


def card(keyword: str, value, comment: str = ""):
    body = F.concat(F.lit(f"{keyword:<8}= "), value, F.lit(f" / {comment}" if comment else ""))
    return F.rpad(body, 80, " ")


def header_text(k):
    """Two blocks' worth of cards built from a key, END included."""
    return F.concat(
        F.rpad(F.lit("SIMPLE  =                    T"), 80, " "),
        card("OBJECT", F.concat(F.lit("'it''s "), k.cast("string"), F.lit("  '")), "name / of it"),
        card("EXPTIME", F.lpad((k % 100).cast("string"), 20, " "), "seconds"),
        F.rpad(F.concat(F.lit("COMMENT run "), k.cast("string")), 80, " "),
        F.when(k % 3 == 0, card("EXPTIME", F.lit("999"))).otherwise(F.lit("")),
        F.rpad(F.lit("END"), 80, " "),
        card("AFTER", F.lit("1")),
    )


@query(
    "header_cards",
    """WITH c AS (SELECT p_partkey AS file, unnest([{'n': 0, 'k': 'SIMPLE', 'v': 'T', 'c': ''}, {'n': 1, 'k': 'OBJECT', 'v': 'it''s ' || p_partkey, 'c': 'name / of it'},
  {'n': 2, 'k': 'EXPTIME', 'v': (p_partkey % 100)::VARCHAR, 'c': 'seconds'}, {'n': 3, 'k': 'COMMENT', 'v': NULL, 'c': 'run ' || p_partkey}] ||
  CASE WHEN p_partkey % 3 = 0 THEN [{'n': 4, 'k': 'EXPTIME', 'v': '999', 'c': ''}] ELSE [] END) AS e FROM part)
SELECT file::BIGINT AS file, e.n::BIGINT AS card_no, e.k AS keyword, e.v AS value, e.c AS comment FROM c""",
)
def header_cards(spark, sf):
    h = D.read(spark, sf, "part").select(F.col("p_partkey").alias("file"), header_text(F.col("p_partkey")).alias("header"))
    return INV.header_cards(h, "header", ["file"]).select(*big("file", "card_no"), "keyword", "value", "comment")


@query(
    "header_merge",
    """WITH c AS (SELECT l_orderkey AS file, l_linenumber AS hdu, 'K' || (l_partkey % 3) AS keyword, l_suppkey::VARCHAR AS value, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice) AS n FROM lineitem),
p AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY file, keyword, hdu ORDER BY n) = 1)
SELECT file::BIGINT AS file, keyword, value FROM p QUALIFY row_number() OVER (PARTITION BY file, keyword ORDER BY hdu DESC) = 1""",
)
def header_merge(spark, sf):
    from pyspark.sql import Window

    li = D.read(spark, sf, "lineitem")
    # Cards of one HDU are numbered in order; an HDU holds a handful of them.
    w = Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey", "l_extendedprice")
    cards = li.select(
        F.col("l_orderkey").alias("file"), F.col("l_linenumber").alias("hdu"), F.concat(F.lit("K"), F.col("l_partkey") % 3).alias("keyword"),
        F.col("l_suppkey").cast("string").alias("value"), F.row_number().over(w).alias("card_no"), F.lit(True).alias("is_value"),
    )
    return INV.merge_headers(cards).select(*big("file"), "keyword", "value")


@query(
    "input_rejects",
    """WITH h AS (SELECT l_orderkey AS file, l_linenumber AS hdu, CASE WHEN l_partkey % 5 < 2 THEN 2 WHEN l_partkey % 5 = 2 THEN 3 ELSE 0 END AS naxis, CASE WHEN l_suppkey % 10 = 0 THEN 'RA---TAN-SIP' ELSE 'RA---TAN' END AS ct FROM lineitem),
f AS (SELECT file, count(*) FILTER (WHERE naxis >= 2) AS im, count(*) FILTER (WHERE naxis = 2) AS pl, bool_or(naxis = 2 AND ct LIKE '%-SIP') AS sip FROM h GROUP BY file)
SELECT file::BIGINT AS entity, CASE WHEN im = 0 THEN 'no_image' WHEN pl > 1 THEN 'several_planes' WHEN pl = 0 THEN 'not_two_dimensional' ELSE 'distortion' END AS rule, pl::VARCHAR AS detail
FROM f WHERE im = 0 OR pl <> 1 OR sip""",
)
def input_rejects(spark, sf):
    h = D.read(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("file"), F.col("l_linenumber").alias("hdu"), F.when(F.col("l_partkey") % 5 < 2, 2).when(F.col("l_partkey") % 5 == 2, 3).otherwise(0).alias("naxis"),
        F.when(F.col("l_suppkey") % 10 == 0, "RA---TAN-SIP").otherwise("RA---TAN").alias("ctype1"), F.lit("DEC--TAN").alias("ctype2"),
    )
    return INV.input_rejects(h).select(*big("entity"), "rule", "detail")


# -- compressed tables ----------------------------------------------------------------------------

def table_header(rows, wide, k):
    return F.concat(
        card("XTENSION", F.lit("'BINTABLE'")), card("NAXIS1", F.when(wide, F.lit("36")).otherwise(F.lit("28"))), card("NAXIS2", rows.cast("string")), card("PCOUNT", (k * 1000).cast("string")),
        card("TFIELDS", F.lit("4")), card("TTYPE1", F.lit("'COMPRESSED_DATA'")), card("TFORM1", F.when(wide, F.lit("'1QB(900)'")).otherwise(F.lit("'1PB(900)'"))),
        card("TTYPE2", F.lit("'ZBLANK  '")), card("TFORM2", F.lit("'1J'")), card("TTYPE3", F.lit("'ZSCALE  '")), card("TFORM3", F.lit("'D'")), card("TTYPE4", F.lit("'ZZERO'")), card("TFORM4", F.lit("'1D'")),
        card("ZCMPTYPE", F.when(k % 17 == 0, F.lit("'HCOMPRESS_1'")).otherwise(F.lit("'RICE_1'"))), card("ZNAXIS1", (rows * 16 - 5).cast("string")), card("ZNAXIS2", F.lit("16")), card("ZTILE1", F.lit("16")), card("ZTILE2", F.lit("16")),
        card("ZQUANTIZ", F.when(k % 2 == 0, F.lit("'SUBTRACTIVE_DITHER_2'")).otherwise(F.lit("'NO_DITHER'"))), card("ZDITHER0", (k % 10000 + 1).cast("string")),
        F.rpad(F.lit("END"), 80, " "),
    )


def compressed_tables(spark, sf, key="l_orderkey", other="l_suppkey"):
    """Orders (or suppliers) as compressed tables, one row of the table per line item, written out byte by byte.

    Scales are 2.0 and zero points 1.0 or -0.5, whose bytes are known constants.
    """
    li = D.read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    wide = F.col(key) % 2 == 0
    order = [c for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice") if c != key]
    hexed = lambda v, n: F.lpad(F.hex(v.cast("bigint")), n, "0")
    width = F.when(wide, 16).otherwise(8)
    desc = F.when(wide, F.concat(hexed(F.col("l_quantity"), 16), hexed(F.col("l_partkey") * 100, 16))).otherwise(
        F.concat(hexed(F.col("l_quantity"), 8), hexed(F.col("l_partkey") * 100, 8))
    )
    row = F.concat(desc, hexed(F.col(other), 8), F.lit("4000000000000000"), F.when(F.col("l_linenumber") % 2 == 0, F.lit("3FF0000000000000")).otherwise(F.lit("BFE0000000000000")))
    # An order has a handful of line items, a supplier some hundred: a table of theirs is a value of one row, as the format's content is.
    # A table costs far more work than its bytes tell: by number, so that small partitions are not joined into a few tasks.
    spread = li.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), key)
    per = spread.groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct(*order, row.alias("hex")))).alias("rows"), F.count(F.lit(1)).alias("n")
    )
    k = F.col(key)
    return per.select(
        k.cast("string").alias("file"), table_header(F.col("n"), k % 2 == 0, k).alias("header"), F.lit(5760).cast("bigint").alias("data_start"),
        F.unhex(F.array_join(F.transform("rows", lambda e: e["hex"]), "")).alias("content"),
    )


TABLES_SQL = """tb AS (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS row, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem
)"""


@query(
    "tile_index",
    f"""WITH {TABLES_SQL}
SELECT l_orderkey::VARCHAR AS file, row::BIGINT AS local_x, 0::BIGINT AS local_y, (5760 + n * CASE WHEN l_orderkey % 2 = 0 THEN 36 ELSE 28 END + l_partkey * 100)::BIGINT AS start, l_quantity::BIGINT AS length,
       least(16, n * 16 - 5 - row * 16)::BIGINT AS w, 16::BIGINT AS h, 2e0 AS zscale, CASE WHEN l_linenumber % 2 = 0 THEN 1e0 ELSE -0.5e0 END AS zzero, l_suppkey::DOUBLE AS zblank,
       CASE WHEN l_orderkey % 2 = 0 THEN 2 ELSE -1 END::BIGINT AS dither_method, (l_orderkey % 10000 + 1)::BIGINT AS zdither0 FROM tb WHERE l_orderkey % 17 <> 0""",
)
def tile_index(spark, sf):
    from starloom.sources import tile_table as TT

    out = TT.tile_index(compressed_tables(spark, sf))
    return out.select("file", *big("local_x", "local_y", "start", "length", "w", "h"), "zscale", "zzero", "zblank", *big("dither_method", "zdither0"))


@query(
    "tile_index_scan",
    """WITH tb AS (
  SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1 AS row, count(*) OVER (PARTITION BY l_suppkey) AS n FROM lineitem)
SELECT 's' || l_suppkey || '.fits.fz' AS file, row::BIGINT AS local_x, (5760 + n * CASE WHEN l_suppkey % 2 = 0 THEN 36 ELSE 28 END + l_partkey * 100)::BIGINT AS start, l_quantity::BIGINT AS length,
       least(16, n * 16 - 5 - row * 16)::BIGINT AS w, CASE WHEN l_linenumber % 2 = 0 THEN 1e0 ELSE -0.5e0 END AS zzero, l_orderkey::DOUBLE AS zblank, (l_suppkey % 10000 + 1)::BIGINT AS zdither0
FROM tb WHERE l_suppkey % 17 <> 0""",
)
def tile_index_scan(spark, sf):
    """The line items of each supplier written as a compressed-image file, then the folder's row tables scanned; files of other kinds are passed over."""
    from starloom.sources import fits as FITS, objects as OBJ, tile_table as TT

    folder, t = scratch(spark), compressed_tables(spark, sf, "l_suppkey", "l_orderkey")
    block = lambda text: F.encode(F.rpad(text, FITS.BLOCK, " "), "US-ASCII")
    primary = F.concat(F.rpad(F.lit("SIMPLE  =                    T"), 80, " "), card("BITPIX", F.lit("8")), card("NAXIS", F.lit("0")), F.rpad(F.lit("END"), 80, " "))
    size = F.octet_length("content")
    padding = F.unhex(F.repeat(F.lit("00"), ((FITS.BLOCK - size % FITS.BLOCK) % FITS.BLOCK).cast("int")))
    files = t.select(F.explode(F.array(F.concat(F.lit("s"), "file", F.lit(".fits.fz")), F.concat(F.lit("s"), "file", F.lit(".fits")))).alias("path"), F.concat(block(primary), block(F.col("header")), "content", padding).alias("content"))
    OBJ.write_objects(files.filter(F.col("path").endswith(".fz") | (F.substring("path", 2, 1) == "1")), folder)
    out = TT.scan_tile_index(spark, folder)
    return out.select(F.regexp_extract("file", "([^/]+)$", 1).alias("file"), *big("local_x", "start", "length", "w"), "zzero", "zblank", *big("zdither0"))


@query(
    "table_checks",
    f"""WITH {TABLES_SQL}, o AS (SELECT DISTINCT l_orderkey AS k, n FROM tb)
SELECT k::VARCHAR AS entity, 'compression' AS rule, 'HCOMPRESS_1' AS detail FROM o WHERE k % 17 = 0
UNION ALL SELECT k::VARCHAR, 'heap_overflow', (k * 1000000)::VARCHAR FROM o WHERE k % 2 = 1 AND k * 1000000 >= 2147483648""",
)
def table_checks(spark, sf):
    from starloom.sources import tile_table as TT

    t = compressed_tables(spark, sf)
    lay = TT.table_layout(t.select("file", "header", "data_start")).withColumn("entity", F.col("file"))
    heap = lay.select("entity", F.transform("columns", lambda c: c["tform"]).alias("tforms"), (F.col("pcount") * 1000).alias("pcount"))
    return V.tile_tables(lay).unionByName(V.heap_overflow(heap))


@query(
    "image_strips",
    """WITH e AS (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS x FROM embeddings)
SELECT 'b' || (vec_id % 3) AS band, (vec_id // 3)::BIGINT AS y, x::BIGINT AS x, round(abs(round_even(v::DOUBLE * 10000, 0)) * 0.5e0 + 1, 6) AS v FROM e""",
)
def image_strips(spark, sf):
    """Vectors written as big-endian 32-bit rows and read back as image rows."""
    from starloom.operators import tiles as T
    from starloom.sources import fits as FITS

    e = D.read(spark, sf, "embeddings").select(
        D.band_name(F.col("vec_id")).alias("band"), F.lit(32).alias("bitpix"), F.size("embedding").alias("width"), F.floor(F.col("vec_id") / 3).cast("int").alias("y0"),
        F.lit(0.5).alias("bscale"), F.lit(1.0).alias("bzero"), F.lit(None).cast("double").alias("blank"),
        F.unhex(F.array_join(F.transform("embedding", lambda v: F.lpad(F.hex(F.abs(F.rint(v.cast("double") * 10000)).cast("bigint")), 8, "0")), "")).alias("content"),
    )
    rows = FITS.decode_image_rows(e, ["band"])
    return rows.select("band", *big("y"), F.posexplode("values").alias("x", "v")).select("band", "y", *big("x"), r("v").alias("v"))


# -- rules on metadata ----------------------------------------------------------------------------

@query(
    "scale_checks",
    """SELECT c_nationkey || '/' || c_custkey AS entity, 'pixel_scale' AS rule FROM customer WHERE c_custkey % 40 = 0 OR c_custkey % 41 = 0 OR c_acctbal <= 0""",
)
def scale_checks(spark, sf):
    k = F.col("c_custkey")
    s = F.when(k % 40 == 0, float("nan")).when(k % 41 == 0, F.lit(None).cast("double")).otherwise(F.col("c_acctbal"))
    lv = D.read(spark, sf, "customer").select(F.col("c_nationkey").alias("band"), k.alias("z"), s.alias("pixel_scale_arcsec"))
    return V.pixel_scales(lv).select("entity", "rule")


@query(
    "rgb_checks",
    """SELECT s_suppkey::VARCHAR AS entity, 'roles' AS rule, 'b,r' AS detail FROM supplier WHERE s_suppkey % 5 = 0
UNION ALL SELECT s_suppkey::VARCHAR, 'unknown_band', 'b=x' || (s_suppkey % 30) FROM supplier WHERE s_suppkey % 30 >= 25""",
)
def rgb_checks(spark, sf):
    k = F.col("s_suppkey")
    three = F.create_map(F.lit("r"), F.lit("x0"), F.lit("g"), F.lit("x1"), F.lit("b"), F.concat(F.lit("x"), k % 30))
    two = F.create_map(F.lit("r"), F.lit("x0"), F.lit("b"), F.concat(F.lit("x"), k % 30))
    s = D.read(spark, sf, "supplier")
    v = s.select(k.alias("dataset"), F.when(k % 5 == 0, two).otherwise(three).alias("roles"))
    names = D.read(spark, sf, "nation").select(F.concat(F.lit("x"), F.col("n_nationkey")).alias("band"))
    # Every dataset offers the bands its roles may name: 25 of them.
    offered = s.select(k.alias("dataset"), F.explode(F.sequence(F.lit(0), F.lit(24))).alias("_n")).withColumn("band", F.concat(F.lit("x"), F.col("_n"))).join(names, "band", "left_semi")
    return V.default_rgb(v, offered.select("dataset", "band"))


@query(
    "rgb_group_checks",
    """SELECT s_suppkey::VARCHAR AS entity, 'rgb_spans_groups' AS rule, count(DISTINCT g)::VARCHAR AS detail FROM (
  SELECT s_suppkey, unnest([(s_suppkey * 3) % 4, CASE WHEN s_suppkey % 2 = 0 THEN (s_suppkey * 3) % 4 ELSE (s_suppkey * 3 + 1) % 4 END, (s_suppkey * 3) % 4]) AS g FROM supplier) GROUP BY s_suppkey HAVING count(DISTINCT g) > 1""",
)
def rgb_group_checks(spark, sf):
    k = F.col("s_suppkey")
    s = D.read(spark, sf, "supplier")
    v = s.select(k.alias("dataset"), F.lit("a").alias("r"), F.lit("b").alias("g"), F.lit("c").alias("b"))
    same = k * 3 % 4
    groups = F.array(F.struct(F.lit("a").alias("band"), same.alias("grid_group")), F.struct(F.lit("b").alias("band"), F.when(k % 2 == 0, same).otherwise((k * 3 + 1) % 4).alias("grid_group")), F.struct(F.lit("c").alias("band"), same.alias("grid_group")))
    return V.rgb_spans_groups(v, s.select(k.alias("dataset"), F.explode(groups).alias("e")).select("dataset", "e.*"))


@query(
    "stats_checks",
    """WITH s AS (SELECT c_custkey AS k FROM customer WHERE c_custkey % 9 <> 0)
SELECT k::VARCHAR AS entity, 'histogram_counts' AS rule FROM s WHERE k % 10 = 1 UNION ALL SELECT k::VARCHAR, 'histogram_domain' FROM s WHERE k % 7 = 2
UNION ALL SELECT k::VARCHAR, 'zscale' FROM s WHERE k % 11 = 3 UNION ALL SELECT k::VARCHAR, 'trilogy' FROM s WHERE k % 13 = 4""",
)
def stats_checks(spark, sf):
    k = F.col("c_custkey")
    d = lambda v: v.cast("double")
    h = F.struct(
        F.when(k % 10 == 1, F.array().cast("array<bigint>")).otherwise(F.array(k, k + 1)).alias("counts"), d(F.lit(0)).alias("lo"), d(F.when(k % 7 == 2, 0).otherwise(1)).alias("hi")
    )
    z = F.when(k % 11 == 3, F.array(d(F.lit(1)), d(F.lit(0)))).when(k % 2 == 0, F.array(d(F.lit(0)), d(F.lit(1))))
    t = F.struct(
        d(F.lit(1)).alias("mean"), d(F.when(k % 13 == 4, float("inf")).otherwise(2)).alias("sigma"), *[d(k).alias(p) for p in ("p99", "p99_9", "p99_99", "p99_999")]
    )
    st = F.struct(h.alias("histogram"), z.alias("zscale"), F.when((k % 3 != 0) | (k % 13 == 4), t).alias("trilogy"))
    return ST.stats_violations(D.read(spark, sf, "customer").select(k.cast("string").alias("name"), F.when(k % 9 != 0, st).alias("stats")))


@query(
    "weight_checks",
    """SELECT o_custkey || '/' || o_orderkey AS entity, 'weight' AS rule, CASE WHEN o_orderkey % 50 = 0 THEN '2' ELSE '3' END AS detail FROM orders WHERE o_orderkey % 50 = 0 OR o_orderkey % 51 = 0
UNION ALL SELECT o_custkey::VARCHAR, 'too_many_bands', count(*)::VARCHAR FROM orders GROUP BY o_custkey HAVING count(*) > 12
UNION ALL SELECT o_custkey || '/' || o_orderkey, 'unknown_band', NULL FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 2)""",
)
def weight_checks(spark, sf):
    k = F.col("o_orderkey")
    w = F.when(k % 50 == 0, F.array(F.lit(1.0), F.lit(0.0))).when(k % 51 == 0, F.array(F.lit(1.0), F.lit(float("nan")), F.lit(0.0))).otherwise(F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0)))
    bands = D.read(spark, sf, "lineitem").filter("l_linenumber = 2").select(F.col("l_orderkey").alias("band"))
    return V.view_weights(D.read(spark, sf, "orders").select(F.col("o_custkey").alias("view"), k.alias("band"), w.alias("weight")), bands)


@query(
    "non_finite_checks",
    """SELECT c_custkey::VARCHAR AS entity, 'not_finite' AS rule, 'a' AS detail FROM customer WHERE c_custkey % 30 = 0 UNION ALL SELECT c_custkey::VARCHAR, 'not_finite', 'b' FROM customer WHERE c_custkey % 45 = 0""",
)
def non_finite_checks(spark, sf):
    k = F.col("c_custkey")
    m = D.read(spark, sf, "customer").select(k, F.when(k % 30 == 0, float("nan")).otherwise(1.0).alias("a"), F.when(k % 45 == 0, float("-inf")).alias("b"))
    return V.non_finite(m, "c_custkey", ["a", "b"])


@query("path_checks", "SELECT '/' || CASE WHEN page_id % 4 = 0 THEN 'x' ELSE 'data' END || '/' || page_id AS entity, 'outside_root' AS rule FROM pages WHERE page_id % 4 = 0")
def path_checks(spark, sf):
    k = F.col("page_id")
    p = D.read(spark, sf, "pages").select(F.concat(F.lit("/"), F.when(k % 4 == 0, "x").otherwise("data"), F.lit("/"), k).alias("path"))
    return V.path_escapes(p, N.relative_path(F.col("path"), F.lit("/data"))).select("entity", "rule")


# -- manifests ------------------------------------------------------------------------------------

def manifests(spark, sf):
    """Orders as parsed manifests of two levels; every third in the old form without supertiles."""
    k = F.col("o_orderkey")
    st = lambda z: F.when(k % 3 != 0, F.array(*[F.struct(F.concat(F.lit("s"), F.lit(i)).alias("filename"), F.array(F.lit(i), F.lit(0)).alias("tile_origin"), F.array(F.lit(1), F.lit(2 - z)).alias("tile_count")) for i in range(2 - z)]))
    lv = F.array(
        *[
            F.struct(
                F.lit(z).alias("z"), F.concat(F.lit("f"), k, F.lit(f"_z{z}")).alias("filename"), F.lit("RICE_1").alias("compression"), F.lit(False).alias("lossless"), F.array(F.lit(512 >> z), F.lit(512 >> z)).alias("shape"),
                F.array(F.lit(2 >> z), F.lit(2 >> z)).alias("fpack_tile_count"), F.lit(0.03 * 2**z).alias("pixel_scale_arcsec"), F.create_map(F.lit("CTYPE1"), F.lit("RA---TAN")).alias("wcs"), st(z).alias("supertiles"),
            )
            for z in (0, 1)
        ]
    )
    o = D.read(spark, sf, "orders").select(
        F.concat(F.lit("m"), k).alias("path"), F.when(k % 3 == 0, 1).when(k % 100 == 1, 7).otherwise(2).alias("version"), F.lit("x").alias("source_file"), F.array(F.lit(512), F.lit(512)).alias("native_shape"),
        F.lit(256).alias("fpack_tile_size"), F.when(k % 100 == 2, 5).otherwise(1).alias("n_levels"), lv.alias("levels"),
    )
    from starloom.sources.metadata import MANIFEST

    # Through text and back: the parse is part of the question.
    text = o.select("path", F.to_json(F.struct(*[c for c in o.columns if c != "path"])).alias("j"))
    return text.select("path", F.from_json("j", MANIFEST).alias("m")).select("path", "m.*")


@query(
    "manifest_supertiles",
    """WITH m AS (SELECT o_orderkey AS k, unnest(CASE WHEN o_orderkey % 3 = 0 THEN [{'z': 0, 'i': 0, 'f': 'f' || o_orderkey || '_z0', 'x': 0, 'nx': 2, 'ny': 2}, {'z': 1, 'i': 0, 'f': 'f' || o_orderkey || '_z1', 'x': 0, 'nx': 1, 'ny': 1}]
  ELSE [{'z': 0, 'i': 0, 'f': 's0', 'x': 0, 'nx': 1, 'ny': 2}, {'z': 0, 'i': 1, 'f': 's1', 'x': 1, 'nx': 1, 'ny': 2}, {'z': 1, 'i': 0, 'f': 's0', 'x': 0, 'nx': 1, 'ny': 1}] END) AS e FROM orders)
SELECT 'm' || k AS path, e.z::BIGINT AS z, e.i::BIGINT AS idx, e.f AS filename, e.x::BIGINT AS tx0, e.nx::BIGINT AS nx, e.ny::BIGINT AS ny FROM m""",
)
def manifest_supertiles(spark, sf):
    from starloom.sources import metadata as META

    out = META.manifest_supertiles(META.manifest_levels(manifests(spark, sf)))
    return out.select("path", *big("z", "idx"), "filename", *big("tx0", "nx", "ny"))


#: What is wrong with the manifest of an order, by the last two digits of its number (0: only in the old form without supertiles).
BROKEN = {3: "no_levels", 4: "supertiles", 5: "supertile", 8: "native_shape", 10: "levels", 11: "tile_count", 12: "shape", 13: "version", 14: "version", 15: "levels", 16: "supertiles", 17: "version"}


def broken_manifests(spark, sf):
    """Manifests with parts missing; those of 6 and 7 lack what may be missing."""
    k = F.substring("path", 2, 20).cast("bigint")
    m = manifests(spark, sf).withColumn("n", (k % 100).cast("int"))

    def level(x):
        one = lambda name, at: F.when(F.col("n") == at, F.slice(x[name], 1, 1)).otherwise(x[name])
        nothing = F.array().cast("array<struct<filename:string,tile_origin:array<int>,tile_count:array<int>>>")
        lost = F.transform(x["supertiles"], lambda t: F.struct(F.lit(None).cast("string").alias("filename"), t["tile_origin"].alias("tile_origin"), t["tile_count"].alias("tile_count")))
        return F.struct(
            F.when((F.col("n") == 10) & (x["z"] == 1), F.lit(3)).otherwise(x["z"]).alias("z"), F.when((F.col("n") == 9), F.lit(None)).otherwise(x["filename"]).alias("filename"),
            x["compression"].alias("compression"), x["lossless"].alias("lossless"), one("shape", 12).alias("shape"), one("fpack_tile_count", 11).alias("fpack_tile_count"),
            x["pixel_scale_arcsec"].alias("pixel_scale_arcsec"), x["wcs"].alias("wcs"),
            F.when(F.col("n") == 4, nothing).when(F.col("n") == 5, F.coalesce(lost, F.array(F.struct(F.lit(None).cast("string").alias("filename"), F.array(F.lit(0)).alias("tile_origin"), F.array(F.lit(1)).alias("tile_count"))))).otherwise(x["supertiles"]).alias("supertiles"),
        )

    m = m.withColumns({
        "levels": F.when(F.col("n") != 3, F.transform("levels", level)), "native_shape": F.when(F.col("n") == 8, F.slice("native_shape", 1, 1)).otherwise(F.col("native_shape")),
        "n_levels": F.when(F.col("n") != 6, F.col("n_levels")), "version": F.when(F.col("n") != 7, F.col("version")),
    })
    from starloom.sources.metadata import parse_manifests

    text = m.select("path", "n", F.to_json(F.struct(*[c for c in m.columns if c not in ("path", "n")])).alias("j"))
    # Types that a field can't have; where it can have none, null is one.
    said = F.when(F.col("n").isin(13, 14, 17), F.regexp_replace("j", r'"version":\d+', F.element_at(F.create_map(*[F.lit(x) for x in (13, '"version":2.5', 14, '"version":"2"', 17, '"version":null')]), F.col("n"))))
    said = said.when(F.col("n") == 15, F.regexp_replace("j", r'"n_levels":\d+', '"n_levels":"x"'))
    said = said.when(F.col("n") == 16, F.replace(F.replace("j", F.lit('"supertiles"'), F.lit('"other"')), F.lit('"z":0,'), F.lit('"z":0,"supertiles":"no",')))
    return parse_manifests(text.select("path", said.otherwise(F.col("j")).alias("json")))


@query(
    "manifest_checks",
    f"""SELECT 'm' || o_orderkey AS entity, CASE o_orderkey % 100 {" ".join(f"WHEN {n} THEN '{rule}'" for n, rule in BROKEN.items())} END AS rule FROM orders WHERE o_orderkey % 100 IN ({", ".join(map(str, BROKEN))})
UNION ALL SELECT 'm' || o_orderkey, 'version' FROM orders WHERE o_orderkey % 3 <> 0 AND o_orderkey % 100 = 1
UNION ALL SELECT 'm' || o_orderkey, 'levels' FROM orders WHERE o_orderkey % 100 = 2
UNION ALL SELECT 'm' || o_orderkey, 'filename' FROM orders WHERE o_orderkey % 100 = 9 AND o_orderkey % 3 = 0""",
)
def manifest_checks(spark, sf):
    from starloom.sources import metadata as META

    return META.manifest_violations(broken_manifests(spark, sf)).select("entity", "rule")


# -- written and read again -----------------------------------------------------------------------

def scratch(spark) -> str:
    """A new folder below the one that driver and executors share."""
    return f"{shared_folder(spark)}/written-{uuid.uuid4().hex}"


@query(
    "tile_store_roundtrip",
    f"""WITH {D.PIXELS_SQL}
SELECT band, (y // {D.TILE})::BIGINT AS tile_y, (x // {D.TILE})::BIGINT AS tile_x, count(*)::BIGINT AS pixels, count(*) FILTER (WHERE NOT isnan(v))::BIGINT AS n_finite,
       {rs("coalesce(sum(v::DOUBLE) FILTER (WHERE NOT isnan(v)), 0)")} AS total, 0::BIGINT AS oversized
FROM pixels GROUP BY band, y // {D.TILE}, x // {D.TILE}""",
)
def tile_store_roundtrip(spark, sf):
    """Native tiles written to the store and read again, with the files above the ceiling counted."""
    from starloom.sources import tile_store as TS

    folder = scratch(spark)
    TS.write_tiles(D.native_tiles(spark, sf), folder, D.BLOCKS)
    good = F.filter("pixels", lambda v: ~F.isnan(v))
    large = F.lit(TS.oversized_files(spark, folder).count())
    return TS.read_tiles(spark, folder).select(
        "band", *big("tile_y", "tile_x"), F.size("pixels").cast("bigint").alias("pixels"), F.size(good).cast("bigint").alias("n_finite"),
        r(F.aggregate(good, F.lit(0.0), lambda a, v: a + v)).alias("total"), large.cast("bigint").alias("oversized"),
    )


@query(
    "catalog_roundtrip",
    """SELECT printf('src_%04d', row_number() OVER (ORDER BY c_custkey) - 1) AS id, c_custkey % 360 + c_acctbal / 1e5 AS ra, (c_custkey % 180 - 90)::DOUBLE AS dec, c_name || ', "' || c_mktsegment || '"' AS name
FROM customer WHERE c_custkey % 8 <> 0""",
)
def catalog_roundtrip(spark, sf):
    """Customers as a catalog, written and read again; those without a position are left out on reading."""
    from starloom.sources import catalog_csv as CSV

    k, folder = F.col("c_custkey"), scratch(spark)
    c = D.read(spark, sf, "customer").select(
        F.when(k % 8 == 0, float("nan")).otherwise(k % 360 + F.col("c_acctbal") / 1e5).alias("ra"), (k % 180 - 90).cast("double").alias("dec"),
        F.concat("c_name", F.lit(', "'), "c_mktsegment", F.lit('"')).alias("name"), k.alias("number"),
    )
    ids = CSV.with_ids(CSV.placeable(c), ["number"]).select("id", "number")
    named = c.join(ids, "number", "left").withColumn("id", F.coalesce("id", F.lit("none"))).drop("number")
    CSV.write_catalog(named, folder, ["ra"])
    back = CSV.kept_rows(CSV.read_catalog(spark, folder))
    return back.select("id", "ra", "dec", F.col("data")["name"].alias("name"))


@query(
    "metadata_roundtrip",
    """WITH c AS (SELECT p_partkey AS file, unnest([{'n': 0, 'k': 'SIMPLE', 't': 'BOOLEAN', 'v': 'true'}, {'n': 1, 'k': 'OBJECT', 't': 'VARCHAR', 'v': 'it''s ' || p_partkey},
  {'n': 2, 'k': 'EXPTIME', 't': 'UBIGINT', 'v': (p_partkey % 100)::VARCHAR}, {'n': 3, 'k': 'COMMENT', 't': 'NULL', 'v': NULL}] ||
  CASE WHEN p_partkey % 3 = 0 THEN [{'n': 4, 'k': 'EXPTIME', 't': 'UBIGINT', 'v': '999'}] ELSE [] END) AS e FROM part)
SELECT file::VARCHAR AS file, e.n::BIGINT AS place, e.k AS keyword, e.v AS value, CASE e.t WHEN 'BOOLEAN' THEN 'boolean' WHEN 'VARCHAR' THEN 'text' WHEN 'UBIGINT' THEN 'number' ELSE 'null' END AS kind FROM c""",
)
def metadata_roundtrip(spark, sf):
    """Header cards written as JSON and read again with the type of each value."""
    from starloom.sources import metadata as META

    folder = scratch(spark)
    h = D.read(spark, sf, "part").select(F.col("p_partkey").alias("file"), header_text(F.col("p_partkey")).alias("header"))
    cards = INV.header_cards(h, "header", ["file"])
    META.header_json(cards).select(F.col("json").alias("value")).write.text(folder)
    back = spark.read.text(folder).select(F.from_json("value", "source_file string, cards array<string>").alias("h"))
    card = back.select(F.col("h.source_file").alias("file"), F.posexplode("h.cards").alias("place", "card"))
    raw = F.regexp_extract("card", r'(?s)^\{"keyword":"(?:[^"\\]|\\.)*","value":(.*),"comment":(?:null|"(?:[^"\\]|\\.)*")\}$', 1)
    kind = F.when(raw.startswith('"'), "text").when(raw.isin("true", "false"), "boolean").when(raw == "null", "null").otherwise("number")
    value = F.get_json_object("card", "$.value")
    return card.select("file", *big("place"), F.get_json_object("card", "$.keyword").alias("keyword"), value.alias("value"), kind.alias("kind"))


def written_json(spark, df, key, schema):
    """JSON lines of a sink written by key, read again and parsed."""
    from starloom.sources import metadata as META

    folder = scratch(spark)
    META.write_json(df, folder, key)
    back = spark.read.option("recursiveFileLookup", False).text(folder)
    return back.select(F.col(key).cast("string").alias(key), F.from_json("value", schema).alias("j"))


@query(
    "dataset_json",
    """SELECT c_nationkey::VARCHAR AS dataset, (row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1)::BIGINT AS place, 'n' || c_custkey AS band, 'p/' || c_custkey || '.json' AS path,
  (c_custkey % 500 + 1)::BIGINT AS h, 64::BIGINT AS w, (c_custkey % 360)::DOUBLE AS crval1, -0.5e0 AS cd21, CASE WHEN c_custkey % 7 <> 0 THEN c_acctbal::DOUBLE END AS pixel_scale_arcsec, md5(c_name) AS grid_hash,
  CASE WHEN c_nationkey % 3 = 0 THEN 'n' || max(c_custkey) OVER (PARTITION BY c_nationkey) END AS red, 1::BIGINT AS version FROM customer""",
)
def dataset_json(spark, sf):
    """Customers as bands of their nation's dataset, every third with default colours, through the dataset sink and back."""
    from starloom.sources import metadata as META

    k, half = F.col("c_custkey"), lambda n, v: F.lit(v).alias(n)
    c = D.read(spark, sf, "customer")
    bands = c.select(
        F.col("c_nationkey").cast("string").alias("dataset"), F.concat(F.lit("n"), k).alias("band"), F.concat(F.lit("p/"), k, F.lit(".json")).alias("path"), k.alias("ord"),
        F.lit("RA---TAN").alias("ctype1"), F.lit("DEC--TAN").alias("ctype2"), (k % 500 + 1).cast("int").alias("h"), F.lit(64).alias("w"), half("crpix1", 1.0), half("crpix2", 2.0),
        (k % 360).cast("double").alias("crval1"), half("crval2", 3.0), half("cd11", 0.25), half("cd12", 0.5), half("cd21", -0.5), half("cd22", 1.0),
        F.when(k % 7 != 0, F.col("c_acctbal").cast("double")).alias("pixel_scale_arcsec"), F.md5("c_name").alias("grid_hash"),
    )
    name = lambda which: F.concat(F.lit("n"), which(k))
    rgb = c.filter("c_nationkey % 3 = 0").groupBy(F.col("c_nationkey").cast("string").alias("dataset")).agg(name(F.max).alias("r"), name(F.min).alias("g"), name(F.min).alias("b"))
    band = "name string, path string, ctype1 string, shape array<int>, crval array<double>, cd array<double>, pixel_scale_arcsec double, grid_hash string"
    back = written_json(spark, META.dataset_json(bands, rgb), "dataset", f"version int, bands array<struct<{band}>>, default_rgb struct<r: string, g: string, b: string>")
    rows = back.select("dataset", "j.version", "j.default_rgb", F.posexplode("j.bands").alias("place", "b"))
    return rows.select(
        "dataset", *big("place"), F.col("b.name").alias("band"), "b.path", F.col("b.shape")[0].cast("bigint").alias("h"), F.col("b.shape")[1].cast("bigint").alias("w"), F.col("b.crval")[0].alias("crval1"),
        F.col("b.cd")[2].alias("cd21"), "b.pixel_scale_arcsec", "b.grid_hash", F.col("default_rgb.r").alias("red"), *big("version"),
    )


@query(
    "collection_json",
    """WITH b AS (SELECT c_nationkey AS field, c_custkey AS ord, CASE WHEN c_custkey % 6 = 0 THEN 'NaN'::DOUBLE ELSE c_custkey % 360 END AS ra, (c_custkey % 90)::DOUBLE AS dec FROM customer),
p AS (SELECT field, count(*) AS n, arg_min(ra, ord) AS ra, arg_min(dec, ord) AS dec FROM b GROUP BY field)
SELECT n_nationkey::VARCHAR AS field, CASE WHEN n_nationkey % 3 = 0 THEN 'T' || n_nationkey WHEN n_nationkey % 3 = 1 THEN n_name ELSE n_nationkey::VARCHAR END AS title, coalesce(n, 0)::BIGINT AS band_count,
       CASE WHEN NOT isnan(ra) THEN ra END AS center_ra, CASE WHEN NOT isnan(ra) THEN dec END AS center_dec, 'all sky' AS collection, 'All "sky"' AS collection_title
FROM nation LEFT JOIN p ON field = n_nationkey WHERE n_nationkey % 5 <> 4""",
)
def collection_json(spark, sf):
    """The cards of the collection through their sink and back."""
    from starloom.sources import metadata as META

    cards = collection_cards(spark, sf)
    schema = "schemaVersion int, collection struct<name: string, title: string>, field struct<name: string, title: string, bandCount: bigint, center: struct<ra: double, dec: double>>"
    back = written_json(spark, META.collection_json(cards, "all sky", 'All "sky"'), "field", schema)
    return back.select(
        F.col("j.field.name").alias("field"), "j.field.title", F.col("j.field.bandCount").alias("band_count"), F.col("j.field.center.ra").alias("center_ra"), F.col("j.field.center.dec").alias("center_dec"),
        F.col("j.collection.name").alias("collection"), F.col("j.collection.title").alias("collection_title"),
    )


@query(
    "config_json",
    """WITH b AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS place FROM customer)
SELECT c_nationkey::VARCHAR AS dataset, place::BIGINT AS place, 'n' || c_custkey AS band, c_name AS label, 'p/' || c_custkey AS path, (c_custkey % 2)::BIGINT AS grid_group, c_acctbal::DOUBLE AS scale,
  CASE WHEN c_custkey % 4 <> 0 THEN c_custkey / 1000e0 END AS pivot_um, 'single' AS mode, 'n' || min(c_custkey) OVER (PARTITION BY c_nationkey) AS shown FROM b""",
)
def config_json(spark, sf):
    """Customers as narrow bands (so every dataset opens on a single one) through the configuration sink and back."""
    from starloom.sources import metadata as META

    k = F.col("c_custkey")
    bands = D.read(spark, sf, "customer").select(
        F.col("c_nationkey").cast("string").alias("dataset"), F.concat(F.lit("n"), k).alias("band"), F.concat(F.lit("n"), k).alias("name"), F.col("c_name").alias("label"), F.concat(F.lit("p/"), k).alias("path"),
        (k % 2).cast("int").alias("grid_group"), F.col("c_acctbal").cast("double").alias("pixel_scale_arcsec"), F.when(k % 4 != 0, k / 1000.0).alias("pivot_um"), F.lit(False).alias("is_broadband"), k.alias("ord"),
    )
    band = "name string, tiles array<string>, grid struct<group: int, pixelScaleArcsec: double>, label string, pivotUm double"
    schema = f"schemaVersion int, dataset struct<name: string, bands: array<struct<{band}>>>, defaultView struct<mode: string, band: string, r: string>"
    back = written_json(spark, META.config_json(bands, INV.default_views(bands, "dataset")), "dataset", schema)
    rows = back.select("dataset", "j.defaultView", F.posexplode("j.dataset.bands").alias("place", "b"))
    return rows.select(
        "dataset", *big("place"), F.col("b.name").alias("band"), "b.label", F.col("b.tiles")[0].alias("path"), F.col("b.grid.group").cast("bigint").alias("grid_group"), F.col("b.grid.pixelScaleArcsec").alias("scale"),
        F.col("b.pivotUm").alias("pivot_um"), F.col("defaultView.mode").alias("mode"), F.col("defaultView.band").alias("shown"),
    )


@query(
    "object_listing",
    """SELECT CASE WHEN page_id % 3 = 0 THEN 'tiles/p' || page_id || '.fits.fz' WHEN page_id % 3 = 1 THEN 'assets/p' || page_id || '.js' ELSE 'p' || page_id || '.html' END AS path,
  CASE page_id % 3 WHEN 0 THEN 'tile' WHEN 1 THEN 'asset' ELSE 'pointer' END AS cls, octet_length(encode(html))::BIGINT AS size, sha256(html) AS sha256 FROM pages""",
)
def object_listing(spark, sf):
    """Pages published as files of three classes, then listed with hashes; a hidden file and the ledger are passed over."""
    from starloom.sources import objects as OBJ

    k, folder = F.col("page_id"), scratch(spark)
    name = F.when(k % 3 == 0, F.concat(F.lit("tiles/p"), k, F.lit(".fits.fz"))).when(k % 3 == 1, F.concat(F.lit("assets/p"), k, F.lit(".js"))).otherwise(F.concat(F.lit("p"), k, F.lit(".html")))
    pages = D.read(spark, sf, "pages")
    more = pages.filter(k == 0).select(F.explode(F.array(F.lit(".hidden"), F.lit(N.LEDGER_NAME))).alias("path"), F.encode("html", "UTF-8").alias("content"))
    OBJ.write_objects(pages.select(name.alias("path"), F.encode("html", "UTF-8").alias("content")).unionByName(more), folder)
    return OBJ.list_objects(spark, folder).select("path", "cls", *big("size"), "sha256")


@query(
    "fits_scan",
    f"""WITH e AS (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS x FROM embeddings)
SELECT 'v' || vec_id || '.fits' AS file, (x // 8)::BIGINT AS y, (x % 8)::BIGINT AS x, {rs("abs(round_even(v::DOUBLE * 10000, 0)) * 0.5e0 + 1")} AS v FROM e""",
)
def fits_scan(spark, sf):
    """Vectors written as image files of eight columns, found, their headers scanned and the images read; build outputs are passed over."""
    from starloom.sources import fits as FITS, objects as OBJ

    folder = scratch(spark)
    e = D.read(spark, sf, "embeddings")
    cards = F.concat(
        F.rpad(F.lit("SIMPLE  =                    T"), 80, " "), card("BITPIX", F.lit("32")), card("NAXIS", F.lit("2")), card("NAXIS1", F.lit("8")),
        card("NAXIS2", F.floor(F.size("embedding") / 8).cast("string")), card("BSCALE", F.lit("0.5")), card("BZERO", F.lit("1.0")), F.rpad(F.lit("END"), 80, " "),
    )
    data = F.unhex(F.array_join(F.transform("embedding", lambda v: F.lpad(F.hex(F.abs(F.rint(v.cast("double") * 10000)).cast("bigint")), 8, "0")), ""))
    content = F.concat(F.encode(F.rpad(cards, FITS.BLOCK, " "), "US-ASCII"), data, F.unhex(F.repeat(F.lit("00"), (FITS.BLOCK - F.size("embedding") * 4 % FITS.BLOCK).cast("int"))))
    name = F.concat(F.lit("v"), F.col("vec_id").cast("string"))
    files = e.select(F.explode(F.array(F.concat(name, F.lit(".fits")), F.concat(name, F.lit(".fits.fz")))).alias("path"), content.alias("content"))
    OBJ.write_objects(files.filter(~F.col("path").endswith(".fz") | (F.substring("path", 2, 1) == "1")), folder)
    rows = FITS.image_rows(spark, FITS.scan_headers(FITS.discover(spark, folder)))
    return rows.select(F.regexp_extract("file", "([^/]+)$", 1).alias("file"), *big("y"), F.posexplode("values").alias("x", "v")).select("file", "y", *big("x"), r("v").alias("v"))
