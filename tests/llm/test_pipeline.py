"""Every stage of the pipeline on its own input against the brute-force versions of the operator tests."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from starloom.llm import toxicity
from tests.llm.test_operators import SCHEMA, components_of, contaminated, filled, jump, print_of, spaced


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("corpus"))
    rng = random.Random(8)
    words = [f"{a}{b}{c}" for a in "ba ke lo mi nu".split() for b in "na pe ri so".split() for c in "tu va we zo".split()]
    items = [(i, " ".join(rng.choices(words, k=18))) for i in range(5)]
    rows = []
    for i in range(240):
        said = rng.choices(words, k=rng.randint(5, 60))
        if i % 8 == 0:
            said[rng.randrange(len(said))] = "grumbo"
        if i % 9 == 1:
            said += items[i % 5][1].split()
        rows.append((i, " ".join(said), "en", f"s{i % 5}", len(" ".join(said))))
    rows += [(1000 + i, rows[3 * i][1], "en", "s1", rows[3 * i][4]) for i in range(20)]
    rows += [(2000, None, None, None, None), (2001, "", "en", "s0", 0), (None, "no id", "en", "s0", 5), (7, rows[7][1], "en", "s2", 0)]
    labels = [(i, 1, int(i % 8 == 0)) for i in range(240)]
    spark.createDataFrame(rows, SCHEMA).withColumns({"size": F.lit(1), "score": F.lit("x")}).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def key(r):
    return (r.doc_id is None, r.doc_id or 0, r.text is None, r.text or "")


def test_stages(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    before = sorted(docs.collect(), key=key)
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{i}")
        result = spark.read.parquet(f"{tmp_path}/{i}")
        after = sorted(result.collect(), key=key)
        if name == "toxicity":
            scored = toxicity.score(docs, spark.read.parquet(f"{folder}/labels.parquet")).collect()
            bad = {r.doc_id for r in scored if r.predicted}
            assert after == [r for r in before if r.doc_id not in bad]
            assert len(bad & set(range(0, 240, 8))) == 30 and len(bad - {1000 + j for j in range(20)}) == 30
        elif name == "simhash_near_dedup":
            prints = {r.text: print_of(r.text) for r in before}
            roots, want = components_of(prints.values()), {}
            for r in sorted(before, key=lambda r: (r.doc_id is None, r.doc_id or 0)):
                want.setdefault(roots[prints[r.text]], r.doc_id)
            assert Counter(r.doc_id for r in after) == Counter(want.values()) and len(after) < len(before) - 10
        elif name == "benchmark_decontamination":
            assert after == [r for r in before if not contaminated(r.text, items)[3]] and len(after) < len(before)
        elif name == "mixing":
            sizes, taken = Counter(), Counter()
            for r in before:
                sizes[r.source] += len(spaced(r.text))
            for r in after:
                taken[r.source] += len(spaced(r.text))
            names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
            target = filled({s: n for s, n in sizes.items() if n}, {s: (5, 2, 1)[j % 3] for j, s in enumerate(names)}, 1.5 * sum(sizes.values()))
            assert all(abs(taken[s] - t) <= 16 for s, t in target.items()) and max(Counter(r.doc_id for r in after).values()) == 2
        else:
            assert [(r.doc_id, r.text) for r in after] == [(r.doc_id, r.text) for r in before]
            assert all(r.shard == jump(r.doc_id, 16) for r in after)
        if name != "sharding":
            assert result.columns == docs.columns
        docs, before = result, after


def test_documents_without_words_stay_in_the_mix(spark, folder):
    rows = [(1, "a b c d e f g h", "en", "s0", 15), (2, None, "en", "s0", None), (3, "", "en", "s1", 0), (4, " \t\n", "en", None, 3), (4, " \t\n", "en", None, 3), (None, None, None, None, None)]
    after = corpus_pipeline.mixing_stage(spark, spark.createDataFrame(rows, SCHEMA), folder).collect()
    assert Counter(tuple(r) for r in after if r.doc_id != 1) == Counter(rows[1:])
    assert any(r.doc_id == 1 for r in after)


def test_run_gives_the_last_stage(spark, folder):
    got = corpus_pipeline.run(spark, folder)
    assert got.count() == corpus_pipeline.run(spark, folder).count() > 100
    assert {"doc_id", "text", "shard", "slot"} <= set(got.columns)
