"""The registered queries of this package and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

import corpus_pipeline
from starloom.llm import bpe, decontaminate, hard_negatives, licenses, main_text, merkle, mixing, phrases, preference, sharding, simhash, toxicity, url_lists

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The generator of the jumps, and the table of CRC-32 from its polynomial.
@query(
    "op3_jump_shards",
    """
WITH RECURSIVE crc AS (
  SELECT list(list_reduce(list_concat([i], range(8)), lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END) ORDER BY i) AS t FROM range(256) r(i)),
bytes AS (
  SELECT doc_id, coalesce(octet_length(encode(text)), 0) + 1 AS size, list_transform(range(1, coalesce(octet_length(encode(text)), 0) + 1),
    lambda i: ('0x' || substr(hex(encode(text)), 2 * i - 1, 2))::BIGINT) AS b
  FROM documents),
summed AS (
  SELECT doc_id, size::BIGINT AS size, xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], b), lambda a, x: xor(a // 256, t[xor(a % 256, x) + 1]))) AS text_crc32
  FROM bytes, crc),
jumps AS (
  SELECT doc_id, doc_id::HUGEINT AS k, 0::BIGINT AS shard, 0::BIGINT AS grown, 0::BIGINT AS j FROM documents
  UNION ALL
  SELECT doc_id, n AS k, CASE WHEN j < 16 THEN j ELSE shard END, j, floor((j + 1)::DOUBLE * (2147483648::DOUBLE / ((n // 8589934592)::DOUBLE + 1)))::BIGINT
  FROM (SELECT *, (k * 2862933555777941757 + 1) % 18446744073709551616 AS n FROM jumps WHERE j < 17)),
landed AS (SELECT doc_id, max(shard) AS shard, max(grown) AS grown FROM jumps GROUP BY doc_id)
SELECT doc_id, size, text_crc32, 'key' AS law, shard::INT AS shard,
  (row_number() OVER (PARTITION BY shard ORDER BY md5(doc_id || '|' || text_crc32)) - 1)::BIGINT AS slot, grown::INT AS grown_shard
FROM summed JOIN landed USING (doc_id)
""",
)
def op3_jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


@query(
    "op4_preference_format",
    """
WITH last AS (SELECT conv_id, max(turn) AS turn, max_by(text, turn) AS text FROM conversations WHERE role = 'assistant' GROUP BY conv_id),
rej AS (
  SELECT c.conv_id, c.turn, c.role, CASE WHEN l.turn IS NOT NULL THEN o.text ELSE c.text END AS text
  FROM conversations c
  LEFT JOIN last l ON l.conv_id = c.conv_id AND l.turn = c.turn AND c.role = 'assistant'
  LEFT JOIN last o ON o.conv_id = c.conv_id + 1
  WHERE l.turn IS NULL OR o.text IS NOT NULL),
both_sides AS (
  SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, coalesce(c.turn, r.turn) AS turn, c.conv_id IS NOT NULL AS has_c, r.conv_id IS NOT NULL AS has_r,
    c.role AS c_role, c.text AS c_text, r.role AS r_role, r.text AS r_text
  FROM conversations c FULL JOIN rej r ON c.conv_id = r.conv_id AND c.turn = r.turn),
cut AS (
  SELECT conv_id, min(turn) FILTER (WHERE NOT (has_c AND has_r AND c_role IS NOT DISTINCT FROM r_role AND c_text IS NOT DISTINCT FROM r_text)) AS split
  FROM both_sides GROUP BY conv_id),
parts AS (
  SELECT b.conv_id, 'prompt' AS part, turn, c_role AS role, c_text AS text FROM both_sides b JOIN cut USING (conv_id) WHERE split IS NULL OR turn < split
  UNION ALL SELECT b.conv_id, 'chosen', turn, c_role, c_text FROM both_sides b JOIN cut USING (conv_id) WHERE turn >= split AND has_c
  UNION ALL SELECT b.conv_id, 'rejected', turn, r_role, r_text FROM both_sides b JOIN cut USING (conv_id) WHERE turn >= split AND has_r)
SELECT conv_id AS pair_id, part, turn, role, '<|' || role || '|>' || chr(10) || coalesce(text, '') || '<|end|>' || chr(10) AS rendered,
  part <> 'prompt' AND role = 'assistant' AS loss
FROM parts
""",
)
def op4_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preference.format_preferences(*preference.swapped_replies(table(spark, sf_dir, "conversations")))


@query(
    "op5_temporal_url_lists",
    """
WITH hosts AS (SELECT page_id, url, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\\-]*://(?:[^/?#@]*@)?([^/:?#]+)', 1)) AS host FROM pages),
entries AS (
  SELECT CASE WHEN event_id % 2 = 1 THEN array_to_string(list_slice(string_split(host, '.'), greatest(len(string_split(host, '.')) - 1, 1), len(string_split(host, '.'))), '.')
      ELSE host END AS pattern,
    event_type = 'error' AS adds, ts, event_id
  FROM events JOIN hosts ON page_id = user_id WHERE event_type IN ('error', 'signup') AND host <> ''),
captures AS (SELECT page_id, url, host, ts AS fetched, regexp_extract(url, '^[^:]+://[^/?#]+/([^/?#]+)', 1) AS segment FROM hosts LEFT JOIN events ON event_id = (page_id * 7919) % (SELECT count(*) FROM events)),
asked AS (
  SELECT DISTINCT page_id, url, fetched, unnest(CASE WHEN host = '' THEN [] ELSE list_concat(CASE WHEN segment <> '' THEN [host || '/' || segment] ELSE [] END,
    list_transform(range(1, greatest(len(string_split(host, '.')), 2)), lambda i: array_to_string(list_slice(string_split(host, '.'), i, len(string_split(host, '.'))), '.'))) END) AS pattern
  FROM captures),
state AS (
  SELECT a.page_id, a.pattern, max_by(e.adds, (e.ts, e.event_id)) AS active
  FROM asked a JOIN entries e ON e.pattern = a.pattern AND e.ts <= a.fetched GROUP BY a.page_id, a.pattern),
found AS (SELECT page_id, count(*) AS n, min((-length(pattern), pattern)) AS best FROM state WHERE active GROUP BY page_id)
SELECT c.page_id, c.url, c.fetched, f.n IS NOT NULL AS blocked, coalesce(f.n, 0)::BIGINT AS n_active, struct_extract(f.best, 2) AS pattern
FROM captures c LEFT JOIN found f USING (page_id)
""",
)
def op5_temporal_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, events = table(spark, sf_dir, "pages"), table(spark, sf_dir, "events")
    captures = url_lists.derived_captures(pages, events)
    return url_lists.evaluate_captures(captures, url_lists.derived_entries(pages, events), ["page_id", "url", "fetched"])


#: Seats go by bounds and a few ranked quotients in the operator, in SQL by the rank of all quotients.
@query(
    "op6_mix_sources",
    r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5('20240901|' || doc_id || '|' || md5(coalesce(text, ''))) AS draw FROM documents),
s AS (
  SELECT *, [5, 2, 1][(rank - 1) % 3 + 1] AS weight, sum(source_size) OVER () AS total
  FROM (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM d GROUP BY source)),
f AS (
  SELECT *, 2.0::DOUBLE * source_size / weight AS full_at, coalesce(sum(2.0::DOUBLE * source_size) OVER (ORDER BY 2.0::DOUBLE * source_size / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS given,
    sum(weight) OVER (ORDER BY 2.0::DOUBLE * source_size / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open FROM s),
l AS (SELECT *, (1.5::DOUBLE * total - given) / open AS level FROM f),
t AS (
  SELECT *, least(2.0::DOUBLE * source_size, coalesce((SELECT min_by(level, full_at) FROM l WHERE full_at >= level) * weight, 2.0::DOUBLE * source_size)) AS target,
    greatest(1, floor(1.5::DOUBLE * total / (16 * 65536)))::BIGINT AS block FROM l),
h AS (SELECT *, ceil((SELECT sum(target) FROM t) / (16 * block))::BIGINT AS seats FROM t),
q AS (SELECT rank, row_number() OVER (ORDER BY target / (2 * k + 1) DESC, rank, k) AS place, seats FROM (SELECT rank, target, seats, unnest(range(seats)) AS k FROM h WHERE target > 0)),
w AS (SELECT rank, count(*) AS quota FROM q WHERE place <= seats GROUP BY rank),
r AS (SELECT h.*, least(2 * source_size, 16 * coalesce(quota, 0) * block) AS run FROM h LEFT JOIN w USING (rank)),
p AS (SELECT d.*, sum(size) OVER (PARTITION BY source ORDER BY draw, doc_id) - size AS start FROM d)
SELECT doc_id, size, source_size, target, (greatest(0, least(start + size, run) - start) + greatest(0, least(start + source_size + size, run) - (start + source_size)))::BIGINT AS taken
FROM p JOIN r ON p.source IS NOT DISTINCT FROM r.source
""",
)
def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(table(spark, sf_dir, "documents")).drop("start", "run")


@query("op7_simhash_components")
def op7_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), simhash.hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


@query(
    "op9_decontaminate",
    r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
wins AS (SELECT DISTINCT item_id, len, array_to_string(words[i0:i0 + len - 1], ' ') AS win FROM (
  SELECT item_id, words, least(13, len(words)) AS len, unnest(range(1, greatest(len(words) - 11, 2))) AS i0 FROM b WHERE len(words) > 0)),
lens AS (SELECT DISTINCT len FROM wins),
places AS (SELECT doc_id, len, i0, array_to_string(words[i0:i0 + len - 1], ' ') AS win FROM (
  SELECT doc_id, words, len, unnest(range(1, len(words) - len + 2)) AS i0 FROM w, lens WHERE len(words) >= len)),
hits AS (SELECT p.doc_id, p.i0, p.len, wins.item_id FROM places p JOIN wins ON wins.len = p.len AND wins.win = p.win),
covered AS (SELECT doc_id, count(DISTINCT pos) AS n FROM (SELECT doc_id, unnest(range(i0, i0 + len)) AS pos FROM hits) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM hits) GROUP BY doc_id)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(c.n, 0)::BIGINT AS n_hit, coalesce(m.n, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(c.n, 0) > 0 AND 20 * coalesce(c.n, 0) >= len(words) AS contaminated
FROM w LEFT JOIN covered c USING (doc_id) LEFT JOIN named m USING (doc_id)
""",
)
def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated"
    )


_NOTICES = ", ".join(f"({i}, '{label}', string_split('{words}', ' '))" for i, (label, words) in enumerate(licenses.TEMPLATES))


@query(
    "op10_license_scan",
    r"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM d),
p AS (SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS i FROM w),
b AS (
  SELECT doc_id, i - 1 AS at_word, unnest(list_filter([CASE WHEN words[i] = 'cc' AND words[i + 1] = 'by' THEN 'cc-by' END,
    CASE WHEN words[i] = 'general' AND words[i + 1] = 'public' AND words[i + 2] = 'license' THEN 'gpl' END,
    CASE WHEN words[i] = 'all' AND words[i + 1] = 'rights' AND words[i + 2] = 'reserved' THEN 'reserved' END], lambda x: x IS NOT NULL)) AS label FROM p),
base AS (SELECT doc_id, count(*) AS n, min(at_word) AS lo, max(at_word) AS hi, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM b GROUP BY doc_id),
notices(n, label, words) AS (VALUES """ + _NOTICES + r"""),
lines AS (SELECT doc_id, list_distinct(regexp_extract_all(unnest(string_split(text, chr(10))), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS words FROM d),
met AS (
  SELECT doc_id, label, len(list_intersect(l.words, list_distinct(t.words))) AS shared, len(list_distinct(t.words)) AS size FROM lines l, notices t),
found AS (SELECT doc_id, label, shared::DOUBLE / size AS c FROM met WHERE shared >= ceil(0.9 * size)),
every AS (SELECT doc_id, label FROM found UNION SELECT doc_id, label FROM b),
named AS (SELECT doc_id, string_agg(label, ',' ORDER BY label) AS labels FROM every GROUP BY doc_id),
best AS (SELECT doc_id, max(c) AS c FROM found GROUP BY doc_id)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(base.n, 0)::BIGINT AS n_base, base.lo::BIGINT AS first_word, base.hi::BIGINT AS last_word,
  coalesce(base.labels, '') AS base_labels, coalesce(named.labels, '') AS labels, CASE WHEN base.n > 0 THEN 1.0::DOUBLE ELSE coalesce(best.c, 0.0::DOUBLE) END AS score
FROM w LEFT JOIN base USING (doc_id) LEFT JOIN named USING (doc_id) LEFT JOIN best USING (doc_id)
""",
)
def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


@query("op1_main_text")
def op1_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.extract(table(spark, sf_dir, "pages"))


@query("op8_phrase_fingerprints")
def op8_phrase_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.fingerprint_documents(table(spark, sf_dir, "documents"))


@query("op2_toxicity")
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))

#: Nodes level by level in SQL; CRC-32 from its polynomial decides where newlines are deleted.
@query(
    "op11_merkle_manifest",
    r"""
WITH RECURSIVE crc AS (
  SELECT list(list_reduce(list_concat([i], range(8)), lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END) ORDER BY i) AS t FROM range(256) r(i)),
d AS (
  SELECT *, xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, len(doc_id::VARCHAR) + 1), lambda i: ascii(substr(doc_id::VARCHAR, i, 1))::BIGINT)),
    lambda a, x: xor(a // 256, t[xor(a % 256, x) + 1]))) AS crc FROM documents, crc),
kinds AS (SELECT doc_id, source, lang, n_chars, text, 0 AS altered FROM d UNION ALL
  SELECT doc_id, source, lang, n_chars, CASE WHEN crc % 2 = 0 THEN replace(text, chr(10), '') ELSE text END, 1 FROM d),
hashed AS (
  SELECT doc_id, source, altered, sha256(array_to_string(list_transform([doc_id::VARCHAR, source, lang, n_chars::VARCHAR, text],
    lambda v: CASE WHEN v IS NULL THEN '-' ELSE octet_length(encode(v)) || ':' || v END), '')) AS digest FROM kinds),
l AS (
  SELECT a.doc_id, dense_rank() OVER (ORDER BY a.source NULLS FIRST) AS tree, row_number() OVER (PARTITION BY a.source ORDER BY a.doc_id) - 1 AS idx,
    count(*) OVER (PARTITION BY a.source) AS n, a.digest, b.digest AS altered
  FROM hashed a JOIN hashed b ON a.doc_id = b.doc_id AND b.altered = 1 WHERE a.altered = 0),
low AS (
  SELECT tree, 0 AS level, idx, n, digest FROM l
  UNION ALL
  SELECT tree, level + 1, idx // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY idx)) FROM low WHERE n > 1 GROUP BY tree, level, idx // 3, n),
subroots AS (SELECT tree, level AS height, digest FROM low WHERE n = 1),
high AS (
  SELECT 0 AS level, tree - 1 AS idx, (SELECT count(*) FROM subroots) AS n, digest FROM subroots
  UNION ALL
  SELECT level + 1, idx // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY idx)) FROM high WHERE n > 1 GROUP BY level, idx // 3, n),
nodes AS (
  SELECT tree, level, idx, digest FROM low WHERE n > 1
  UNION ALL SELECT tree, height + level, idx, h.digest FROM subroots, high h WHERE h.n > 1),
paths AS (
  SELECT l.doc_id, l.tree, l.altered, height, unnest(range(height + (SELECT max(level) FROM high))) AS level, l.idx AS leaf FROM l JOIN subroots USING (tree)),
placed AS (
  SELECT *, CASE WHEN level < height THEN leaf // (3 ** level)::BIGINT ELSE (tree - 1) // (3 ** (level - height))::BIGINT END AS idx FROM paths),
beside AS (
  SELECT p.doc_id, p.level, coalesce(string_agg(s.digest, '' ORDER BY s.idx) FILTER (WHERE s.idx < p.idx), '') AS before, coalesce(string_agg(s.digest, '' ORDER BY s.idx) FILTER (WHERE s.idx > p.idx), '') AS after
  FROM placed p JOIN nodes s ON s.tree = p.tree AND s.level = p.level AND s.idx // 3 = p.idx // 3 GROUP BY p.doc_id, p.level),
proofs AS (SELECT doc_id, sha256(string_agg(before || after, '' ORDER BY level)) AS proof FROM beside GROUP BY doc_id),
fold AS (
  SELECT doc_id, 0 AS level, altered AS digest FROM l
  UNION ALL
  SELECT f.doc_id, f.level + 1, sha256(before || digest || after) FROM fold f JOIN beside b ON b.doc_id = f.doc_id AND b.level = f.level),
top AS (SELECT doc_id, max_by(digest, level) AS folded FROM fold GROUP BY doc_id)
SELECT l.doc_id, l.digest AS leaf, s.digest AS subroot, r.digest AS root, coalesce(proof, sha256('')) AS proof_sha256, folded AS folded_root, folded = r.digest AS verified
FROM l JOIN subroots s USING (tree) JOIN top USING (doc_id) LEFT JOIN proofs USING (doc_id), (SELECT digest FROM high WHERE n = 1) r
""",
)
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    text = F.when(tampered, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    return merkle.manifest(table(spark, sf_dir, "documents"), altered={"text": text}).withColumnRenamed("key", "doc_id")


@query("op12_byte_bpe")
def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as ranks:
        found = bpe.tokenise(table(spark, sf_dir, "documents"), ranks.read(), public_tokenizers.PATTERN, keep_ids=False)
    return found.select(F.col("key").alias("doc_id"), "n_tokens", "ids_sha256", "decoded_sha256")


@query(
    "op13_hard_negatives",
    """
WITH e AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.r AS ar, a.vec_id AS anchor_id, b.r AS br, b.vec_id AS other_id, a.label = b.label AS alike, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM e a, e b WHERE a.vec_id % 100 = 0 AND a.r <> b.r),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ar ORDER BY score DESC, other_id) AS place FROM s WHERE alike) WHERE place <= 5),
w AS (
  SELECT p.anchor_id, p.other_id AS positive_id, p.score AS positive_score, n.other_id AS negative_id, n.score AS negative_score,
    row_number() OVER (PARTITION BY p.ar, p.br ORDER BY n.score DESC, n.other_id) AS rank
  FROM p JOIN s n ON n.ar = p.ar AND NOT n.alike AND 80 * p.score <= 100 * n.score AND n.score <= p.score)
SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM w WHERE rank <= 5
""",
)
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, label)



QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
