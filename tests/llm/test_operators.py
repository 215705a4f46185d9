"""Operators against brute force on small tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import random
import re
import textwrap
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from starloom.llm import decontaminate, licenses, main_text, mixing, phrases, preference, sharding, simhash, toxicity, url_lists

CLASHING = "id h fp words size start run _key _draw _part n win item k slot shard score x y".split()
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def documents():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(60)] + ["Über", "ÉTÉ", "naïve"]
    rows = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(1, 60))), "en", f"s{i % 4}", 0) for i in range(60)]
    rows += [(i + 100, rows[i][1], "en", "s0", 0) for i in range(12)]
    rows += [(i + 200, rows[i][1] + " tail", "en", "s1", 0) for i in range(6)]
    rows += [
        (300, None, None, None, None), (301, "", "en", "s0", 0), (302, " \t\n", "en", None, 3), (303, "one", "en", "s1", 3), (304, "a b c " * 20000, "en", "s2", 0),
        (305, "…!?%", "de", "s3", 4), (306, "ab\x0bcd\x1eef\xa0gh", "de", "s3", 4), (None, "no id here", "en", "s0", 0), (None, None, "en", "s0", 0), (303, "one", "en", "s1", 3),
    ]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(documents(), SCHEMA)
    return df.withColumns({c: F.lit(7) for c in CLASHING}).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def spaced(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lowered(text):
    return (text or "").translate({i: i + 32 for i in range(65, 91)})


def alnum(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))


def jump(key, n):
    key, b, j = (key or 0) % (1 << 64), -1, 0
    while j < n:
        b, key = j, (key * 2862933555777941757 + 1) % (1 << 64)
        j = int(float(b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_shards(docs):
    got = sharding.shard_documents(docs).collect()
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), jump(i, 16), jump(i, 17)) for i, t, *_ in documents())
    assert Counter((r.doc_id, r.size, r.text_crc32, r.shard, r.grown_shard) for r in got) == want
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 16)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_shards_of_negative_and_huge_keys(spark):
    keys = [-1, -(1 << 63), (1 << 63) - 1, 0, 123456789012345]
    got = spark.createDataFrame([(k,) for k in keys], "k bigint").select("k", sharding.jump(F.col("k"), 7).alias("j")).collect()
    assert [(r.j.shard, r.j.grown) for r in got] == [(jump(k, 7), jump(k, 8)) for k in keys]


def filled(sizes, weights, total):
    """Targets by the words of the contract: share by weight, stop at twice the size, share what is left again."""
    target, full = dict.fromkeys(sizes, 0.0), set()
    while True:
        free = total - sum(2 * sizes[s] for s in full)
        weight = sum(weights[s] for s in sizes if s not in full)
        target = {s: 2.0 * sizes[s] if s in full else free * weights[s] / weight for s in sizes}
        over = {s for s in sizes if s not in full and target[s] > 2 * sizes[s]}
        if not over:
            return target
        full |= over


def test_mix(docs):
    got = mixing.mix_documents(docs, keep=["doc_id", "source", "text"]).collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter((i, t) for i, t, *_ in documents())
    sizes = Counter()
    for _, t, _, s, _ in documents():
        sizes[s] += len(spaced(t))
    names = sorted((s for s in sizes if s is not None)) + [None]
    target = filled(dict(sizes), {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}, 1.5 * sum(sizes.values()))
    taken = Counter()
    for r in got:
        assert r.size == len(spaced(r.text)) and r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source])
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    for s in sizes:
        assert abs(taken[s] - target[s]) <= 16
    again = mixing.mix_documents(docs.repartition(5), keep=["doc_id", "source", "text"]).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_mixed_rows_hold_the_taken_words(docs):
    want = {(r.doc_id, r.text): r for r in mixing.mix_documents(docs, keep=["doc_id", "text"]).collect()}
    rows = mixing.mixed_rows(docs)  # with a column of each number's name
    assert rows.columns == docs.columns
    words = Counter()
    for r in rows.collect():
        assert r.n_chars == len(r.text)
        words[r.doc_id] += len(spaced(r.text))
    total = Counter()
    for (i, _), r in want.items():
        total[i] += r.taken * (2 if i == 303 else 1)
    assert {i: n for i, n in words.items() if i != 303} == {i: n for i, n in total.items() if n and i != 303}


@pytest.mark.parametrize("seats", [1, 7, 40, 1000])
def test_seats_go_to_the_highest_quotients(spark, seats):
    targets = {"a": 10.0, "b": 500.0, "c": 3.0, "d": 487.0, "e": 0.0, "f": 3.0}
    rows = [(s, int(t), i + 1, 1003, t) for i, (s, t) in enumerate(targets.items())]
    df = spark.createDataFrame(rows, "source string, source_size bigint, rank int, total bigint, target double")
    got = mixing.apportion(df, shards=1, seats=seats, share=1.0).collect()
    n = int(np.ceil(sum(targets.values()) / got[0].block))
    quotients = sorted(((-t / (2 * k + 1), i, k) for i, t in enumerate(targets.values()) if t for k in range(n)))[:n]
    want = Counter(list(targets)[i] for _, i, _ in quotients)
    assert {r.source: r.quota for r in got} == {s: want.get(s, 0) for s in targets}


def test_small_sources_get_their_targets(spark):
    rng = random.Random(7)
    counted = {"a": 4000, "b": 12, "c": 3, "d": 300, "e": 4000, "f": 90}
    rows = [(i, " ".join(rng.choices("abcdef", k=min(10, n - at))), s) for s, n in counted.items() for i, at in enumerate(range(0, n, 10))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    target = filled(counted, {s: (5, 2, 1)[i % 3] for i, s in enumerate(counted)}, 1.5 * sum(counted.values()))
    for seats in (4, 100, 300):
        block = int(1.5 * sum(counted.values()) / (16 * seats))
        assert block > 1 and target["b"] < 8 * block or seats == 300
        taken, sizes = Counter(), Counter()
        for r in mixing.mix_documents(df, keep=["source"], seats=seats).collect():
            taken[r.source] += r.taken
            sizes[r.source] += r.size
            assert r.taken > 0 or r.source in "ae"
        assert sizes == counted
        for s in counted:
            if target[s] < mixing.FEW * 16 * block:
                assert abs(taken[s] - target[s]) <= 0.5
            else:
                assert abs(taken[s] - target[s]) <= 0.02 * target[s]
    targets = spark.createDataFrame([("a", 1000, 1, 1640, 2000.0), *[(f"s{i}", 4, i + 2, 1640, 8.0) for i in range(160)]], "source string, source_size bigint, rank int, total bigint, target double")
    got = {r.source: r for r in mixing.apportion(targets, shards=1, seats=100, share=1.5, few=5).collect()}
    assert got["a"].words == got["a"].quota * 24 and abs(got["a"].words - 2000) < 24 and all(got[f"s{i}"].words == 8 and got[f"s{i}"].quota == 0 for i in range(160))


def print_of(text):
    w = [x for x in (text or "").encode().lower().split()]
    grams = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    ones = Counter()
    for g in grams:
        h = xxhash.xxh64_intdigest(g, 42)
        ones.update(b for b in range(64) if h >> b & 1)
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(grams))


def components_of(prints):
    values = sorted(set(prints))
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for i, a in enumerate(values):
        for b in values[i + 1 :]:
            if bin(a ^ b).count("1") <= 2:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {v: find(v) for v in values}


def test_simhash(docs):
    got = simhash.near_duplicates(docs).select("id", simhash.hex_digits(F.col("fp")).alias("fp"), "component_id", "kept").collect()
    rows = [(i, t, print_of(t)) for i, t, *_ in documents()]
    roots = components_of([p for *_, p in rows])
    least = {}
    for i, _, p in rows:
        if i is not None:
            least[roots[p]] = min(i, least.get(roots[p], i))
    assert Counter((r.id, r.fp, r.component_id) for r in got) == Counter((i, f"{p:016x}", least.get(roots[p])) for i, _, p in rows)
    kept = simhash.without_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id) for r in kept.collect()) == sorted([(False, i) for i in least.values()] + [(True, None)] * (len(set(roots.values())) - len(least)))


def test_links_of_planted_fingerprints(spark):
    rng = random.Random(3)
    values = {0, (1 << 64) - 1}
    for _ in range(60):
        v = rng.getrandbits(64)
        values.add(v)
        for d in (1, 2, 2, 2, 3):
            values.add(v ^ sum(1 << b for b in rng.sample(range(64), d)))
    for b in range(0, 64, 5):
        values |= {1 << b, (1 << b) | (1 << ((b * 7 + 3) % 64))}
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    got = {(r.a, r.b) for r in simhash.links(spark.createDataFrame([(v,) for v in signed], "fp bigint")).collect()}
    want = {(a, b) for a in signed for b in signed if a < b and bin((a ^ b) & ((1 << 64) - 1)).count("1") <= 2}
    assert got == want and len(want) > 200


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(1000, i) for i in range(900, 930)] + [(5, 5), (7, 6)]
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys([*range(900, 930), 1000], 900)}


ITEMS = [(1, " ".join(f"w{i}" for i in range(20))), (2, "Über naïve"), (3, "One"), (4, None), (5, "..."), (1, "W1 w2"), (6, " ".join(f"w{i}" for i in range(3, 18))), (None, "w3 w4 w5"), (7, "w1 w2")]


def contaminated(text, items, window=13):
    w = alnum(text)
    hit, found = set(), set()
    for i, t in items:
        v = alnum(t)
        for s in range(max(1, len(v) - window + 1)) if v else ():
            win = v[s : s + window]
            for p in range(len(w) - len(win) + 1):
                if w[p : p + len(win)] == win:
                    hit |= set(range(p, p + len(win)))
                    if i is not None:
                        found.add(str(i))
    return len(w), len(hit), tuple(sorted(found)), len(hit) > 0 and 20 * len(hit) >= len(w)


def test_decontaminate(spark, docs):
    extra = [(400, "x " * 30 + ITEMS[0][1].upper() + " y", "en", "s0", 0), (401, ITEMS[0][1][:-4] + " zz", "en", "s0", 0), (402, "z " * 500 + "one", "en", "s0", 0), (403, "ÜBER NAÏVE über naïve", "en", "s0", 0)]
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string").withColumn("win", F.lit(1))
    both = docs.unionByName(spark.createDataFrame(extra, SCHEMA), allowMissingColumns=True)
    got = decontaminate.decontaminate(both, items).collect()
    rows = [r for r in documents() if r[0] != 304] + extra
    assert Counter((r.id, r.n_words, r.n_hit, tuple(r["items"]), r.contaminated) for r in got if r.id != 304) == Counter((i, *contaminated(t, ITEMS)) for i, t, *_ in rows)
    bad = {i for i, t, *_ in rows if contaminated(t, ITEMS)[3]}
    kept = decontaminate.without_contaminated(both, items)
    assert kept.columns == both.columns and {r.doc_id for r in kept.collect()} == {i for i, *_ in rows if i not in bad} | {304}


def test_decontaminate_without_items(spark, docs):
    got = decontaminate.decontaminate(docs, spark.createDataFrame([], "item_id bigint, text string"))
    assert got.where("n_hit > 0 or contaminated").count() == 0 and got.count() == len(documents())


NOTICES = [
    (500, "Hi.\nReleased under the MIT License.\nAll rights reserved. All rights reserved"), (501, "cc by cc by, CC-BY-NC 4.0"), (502, "licensed under cc by nc 4.0"),
    (503, "This work is licensed under the GNU General Public License, version 2."), (504, "cc\nby x general public  license"), (505, "reserved rights all cc"), (506, "the mit license is what this was released under"),
    (507, "accby cc byx"), (508, "ALL RIGHTS RESERVED"),
]


def license_of(text):
    w = alnum(text)
    places = [(i, label) for p, label in licenses.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    best, labels = 0.0, {label for _, label in places}
    base = sorted(labels)
    for line in (text or "").split("\n"):
        held = set(alnum(line))
        for label, words in licenses.TEMPLATES:
            t = set(words.split())
            if len(held & t) >= int(np.ceil(licenses.THRESHOLD * len(t))):
                labels, best = labels | {label}, max(best, len(held & t) / len(t))
    at = [i for i, _ in places]
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(base), ",".join(sorted(labels)), 1.0 if at else best


def test_licenses(spark, docs):
    both = docs.unionByName(spark.createDataFrame(NOTICES, "doc_id bigint, text string"), allowMissingColumns=True)
    got = licenses.scan(both).collect()
    rows = [(i, t) for i, t, *_ in documents()] + NOTICES
    assert Counter(tuple(r) for r in got) == Counter((i, *license_of(t)) for i, t in rows)
    assert {r.id: r.labels for r in got}[500] == "mit,reserved"


def test_licenses_of_wrapped_notices(spark):
    notices = [words for _, words in licenses.TEMPLATES]
    rows, want = [], {}
    for i, (label, words) in enumerate(licenses.TEMPLATES):
        for j, (width, start) in enumerate([(72, ""), (72, "# "), (40, "    "), (30, " * ")]):
            rows.append((10 * i + j, "Some title\n" + start + ("\n" + start).join(textwrap.wrap("This file: " + words.capitalize() + ". More follows here", width))))
            want[10 * i + j] = label
    scattered = notices[6].split()
    rows += [(900, "\n".join(f"{w} {'x ' * 9}" for w in scattered)), (901, "permission is hereby\ngranted free of charge"), (902, "released under\nthe mit license")]
    want |= {902: "mit"}
    got = {r.id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert all(label in got[i].labels.split(",") and got[i].score >= licenses.THRESHOLD for i, label in want.items())
    assert got[900].labels == got[901].labels == "" and got[900].score == got[901].score == 0


def test_phrases(docs):
    got = defaultdict(list)
    for r in phrases.fingerprint_documents(docs).collect():
        got[r.doc_id].append(r)
    rows = sorted(((i, t or "") for i, t, *_ in documents() if i is not None), reverse=True)
    assert sum(map(len, got.values())) == len(documents())
    for (i, t), (_, following) in zip(rows[:-1], rows[1:], strict=True):
        new = phrases.edited(t, following)
        assert {r.n_chars for r in got[i]} == {len(t)}
        assert hashlib.sha256(new.encode()).hexdigest() in {r.edited_sha256 for r in got[i]}
        for r in got[i]:
            assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    whole, sketch = phrases.sketches([t for _, t in rows])
    assert all(got[i][0].fingerprint == p for (i, _), p in zip(rows, phrases.as_text(whole, sketch), strict=True))
    texts = {}
    for i, t in rows:
        assert texts.setdefault(got[i][0].fingerprint, t) == t


def test_phrases_in_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(phrases, "BUCKET", 300)
    monkeypatch.setattr(phrases, "CHUNK", 500)
    rng = random.Random(1)
    rows = [(i * i, "".join(rng.choices("abcd ", k=rng.randint(0, 200)))) for i in range(80)]
    got = {r.doc_id: r.edited_sha256 for r in phrases.fingerprint_documents(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(7)).collect()}
    for i in range(80):
        new = phrases.edited(rows[i][1], rows[i - 1][1])
        assert got[i * i] == hashlib.sha256(new.encode()).hexdigest()


def parsed(symbols):
    """Phrase ends of one text, symbol by symbol."""
    runs = []
    for s in symbols:
        if runs and runs[-1][0] == s:
            runs[-1][1] += 1
        else:
            runs.append([s, 1])
    names = [int(phrases.mixed(np.array([(s + n * int(phrases._ODD)) % (1 << 64)], np.uint64))[0]) if n > 1 else s for s, n in runs]
    labels = names
    for k in range(phrases.TOSSES):
        wide = (1 << (64 if k == 0 else 8)) - 1
        before = [labels[0] ^ wide, *labels[:-1]]
        bits = [((a ^ b) & -(a ^ b)).bit_length() - 1 for a, b in zip(labels, before, strict=True)]
        labels = [2 * b + (x >> b & 1) for x, b in zip(labels, bits, strict=True)]
    starts = [i for i in range(len(names)) if i == 0 or i + 1 < len(names) and labels[i - 1] < labels[i] > labels[i + 1]]
    return names, labels, starts


def test_parsing_is_local_and_the_same_in_company():
    rng = random.Random(2)
    texts = ["".join(rng.choices("ab c", k=n)) for n in (1, 2, 50, 400)] + ["aaaaaaa", "abababab"]
    codes = [phrases.mixed(np.array([ord(c) for c in t], np.uint64) + np.uint64(1)) for t in texts]
    names, of = phrases.next_level(np.concatenate(codes), np.repeat(np.arange(len(texts)), [len(t) for t in texts]))
    for k, c in enumerate(codes):
        alone, labels, starts = parsed([int(x) for x in c])
        assert max(labels) < 6 and all(a != b for a, b in zip(labels, labels[1:], strict=False))
        assert (of == k).sum() == len(starts)
        single, _ = phrases.next_level(c, np.zeros(len(c), int))
        assert (single == names[of == k]).all()
    base = "".join(rng.choices("abcdefgh ", k=3000))
    _, sketch = phrases.sketches([base, "zz" + base, base[:1500] + "".join(rng.choices("abcdefgh ", k=1500)), "".join(rng.choices("abcdefgh ", k=3000))])
    near = phrases.likeness(np.repeat(sketch[:1], 4, axis=0), sketch)
    assert near[0] == 1 and near[1] > 0.9 and 0.2 < near[2] < 0.6 and near[3] < 0.1


def test_fingerprints_do_not_depend_on_long_neighbours():
    rng = random.Random(6)
    texts = ["one", "a b c", "", *["".join(rng.choices("abcdefgh ", k=n)) for n in (40, 900, 3000)]]
    alone = phrases.as_text(*phrases.sketches(texts))
    for n in (8_000, 60_000):
        long = "".join(rng.choices("abcdefgh ", k=n))
        assert phrases.as_text(*phrases.sketches([*texts, long]))[:-1] == alone
        assert phrases.as_text(*phrases.sketches([long]))[0] == phrases.as_text(*phrases.sketches([*texts, long]))[-1]


PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style></head><body class="page menu-open"><div id="mainMenu"><a href=x>Home</a> <a href=y>About</a></div>
<header><h1>Site</h1></header><div class="cookie-notice">We use cookies, please accept.</div><div id="content"><h2>Real &amp; title</h2>
<p>This is a paragraph,   with commas, &lt;signs&gt; and a good length.<p>Second one, with <a href=z>a link</a>, fine, unclosed <b>bold
<ul><li>point one, which is real<li>point two</ul><!-- <p>hidden</p> --><script>var p = "<p>no</p>"</script><div class="ad">Buy now!</div></div>
<div class="sidebar"><p>Related: something long enough to look like a paragraph, with commas, yes, really.</p></div>
<form><p>Subscribe to us, it is nice, you will like it, we promise you this.</p></form><section id="comments"><p>I think this is a great article, thanks, all, and more.</p></section><footer>c</footer></body></html>"""


def test_main_text(spark):
    assert main_text.main_text(PAGE) == "Real & title\nThis is a paragraph, with commas, <signs> and a good length.\nSecond one, with a link, fine, unclosed bold\npoint one, which is real\npoint two"
    assert [main_text.main_text(p) for p in (None, "", "just text", "<p>hi", "<div>a<div>b</div>c</div>", "<script>x", "<p", "</p></div>x<br>y", "<nav>a</nav>")] == ["", "", "just text", "hi", "a\nb\nc", "", "", "x y", ""]
    assert main_text.main_text('<div class="with-sidebar"><article><div class="entry-header"><h1>T</h1></div><p>Body, here.</p></article></div>') == "T\nBody, here."
    assert main_text.main_text("<div>" * 30000 + "deep") == "deep" and len(main_text.main_text("<p>" + "a b, " * 200000)) == 999999
    rows = [(1, "u", PAGE), (1, "u", PAGE), (2, None, None), (None, "v", "")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("text", F.lit(1))
    got = main_text.extract(df).collect()
    assert Counter(map(tuple, got)) == Counter((i, u, main_text.main_text(h), len(main_text.main_text(h))) for i, u, h in rows)
    assert main_text.extract(df.limit(0)).count() == 0


@pytest.mark.parametrize("around", ["article", 'div id="content"'])
def test_main_text_of_blocks_named_after_titles(around):
    said = [f"Paragraph {i} of the text, with commas, and a good length for a paragraph, as they are." for i in range(6)]
    p = [f"<p>{t}</p>" for t in said]
    page = (
        f'<body><div class="sidebar"><p>{said[0]}</p></div><{around}><h1>T</h1><p class="byline">By A</p>{p[0]}<h2 id="related-work">Related work</h2>{p[1]}'
        f'<section id="social-impact"><h2>Social impact</h2>{p[2]}</section><div class="ad">Buy now</div><h2 id="copyright-law">Copyright law</h2><p class="notice">Notice this.</p>{p[3]}'
        f'<div id="related"><a href=x>Other page</a></div>{p[4]}<section id="comments-on-the-method"><h2>Comments on the method</h2>{p[5]}</section>'
        f'<section id="comments"><p>I think so.</p></section></{around.split()[0]}></body>'
    )
    assert main_text.main_text(page).split("\n") == [
        "T", "By A", said[0], "Related work", said[1], "Social impact", said[2], "Copyright law", "Notice this.", said[3], said[4], "Comments on the method", said[5],
    ]


def test_main_text_beside_the_container():
    body = "".join(f"<p>Paragraph {i} of the text, with commas, and a good length for a paragraph, as they are.</p>" for i in range(4))
    said = [f"Paragraph {i} of the text, with commas, and a good length for a paragraph, as they are." for i in range(4)]
    page = (
        f'<div id=page><nav>n</nav><h1>Title</h1><p>Short lead.</p><ul><li><a href=a>Home</a><li><a href=b>About</a></ul><div class=text>{body}</div><blockquote>Quote.</blockquote>'
        '<ol><li>one<li>two</ol><table><tr><td>1<td>2</table><section><h2>End</h2>Short.</section><h3><a href=x>More here</a></h3><ul class=share><li>Share</ul></div>'
    )
    assert main_text.main_text(page).split("\n") == ["Title", "Short lead.", *said, "Quote.", "one", "two", "1", "2", "End", "Short."]
    assert main_text.main_text(f"<h1>Site</h1><article>{body}</article><p>Beside.</p>").split("\n") == said


SAID = [f"Paragraph {i} of the text, with commas, and a good length for a paragraph, as they are." for i in range(4)]


@pytest.mark.parametrize("block", [
    '<p class="advertisement">Buy this now.</p>', '<section class="newsletter"><p>Get our letter.</p></section>',
    '<section id="comments"><p>I think so, too.</p></section>', '<div class="ad-banner">Buy</div>', '<article class="comment"><p>I think so, too.</p></article>',
])
def test_main_text_drops_unmistakable_names(block):
    p = [f"<p>{t}</p>" for t in SAID]
    assert main_text.main_text(f"<body><article>{p[0]}{p[1]}{block}{p[2]}{p[3]}</article></body>").split("\n") == SAID
    assert main_text.main_text(f"<body><article>{''.join(p)}</article>{block}</body>").split("\n") == SAID


@pytest.mark.parametrize(("block", "text"), [
    ('<div class="market-share"><p>The share grew, as said.</p></div>', "The share grew, as said."), ('<div class="related-work">Others did so.</div>', "Others did so."),
    ('<ul class="market-share"><li>A tenth</ul>', "A tenth"), ("<p>If <math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>x=1</annotation></math> then.</p>", "If x=1 then."),
])
def test_main_text_keeps_names_that_are_only_parts(block, text):
    p = [f"<p>{t}</p>" for t in SAID]
    assert main_text.main_text(f"<body><article>{p[0]}{p[1]}{block}{p[2]}{p[3]}</article></body>").split("\n") == [*SAID[:2], text, *SAID[2:]]


def test_main_text_time_of_unclosed_tags():
    def seconds(n: int) -> float:
        start = time.process_time()
        assert main_text.main_text("<div><p>a, b</section>" * n).count("\n") == n - 1
        return time.process_time() - start

    assert seconds(20_000) < 12 * max(seconds(4_000), 0.05)  # 25 times, if it were quadratic


@pytest.fixture(scope="module")
def counts():
    text = "  " + "  ".join("you are such an idiot and a stupid clown but the house is nice idiot clown stupid house that loser with them".split() * 30) + "  "
    s = toxicity.symbols(text).astype(int)
    return np.bincount(s[:-2] * 4096 + s[1:-1] * 64 + s[2:], minlength=64**3)


@pytest.mark.parametrize("said, meant", [("1d10t", "idiot"), ("id!ot", "idiot"), ("iiidddiiooott", "idiot"), ("i.d.i.o.t", "idiot"), ("$tup1d", "stupid"), ("cl0wn!!!", "clown"), ("l0$er", "loser"), ("house###", "house"), ("i d i o t", "idiot"), ("7h3m", "them")])
def test_restoring(counts, said, meant):
    assert meant in toxicity.Restorer(counts).words(f"you are such {said} , the house")


@pytest.fixture(scope="module")
def more_counts():
    text = "  " + "  ".join("you are such an idiot and a stupid clown but the house is nice ass idiot clown stupid house loser with them have over hit all week deed".split() * 30) + "  "
    s = toxicity.symbols(text).astype(int)
    return np.bincount(s[:-2] * 4096 + s[1:-1] * 64 + s[2:], minlength=64**3)


@pytest.mark.parametrize(
    "said, meant",
    [("$tupid", "stupid"), ("@ss", "ass"), ("!diot", "idiot"), ("idio+", "idiot"), ("iddiioott", "idiot"), ("stuupid", "stupid"), ("stvpid", "stupid"), ("сlown", "clown"), ("idiоt", "idiot"), ("\"$tupid!!!\"", "stupid"), ("(loser", "loser"), ("@$$", "ass")],
)
def test_restoring_ends_doubles_and_letters(more_counts, said, meant):
    assert meant in toxicity.Restorer(more_counts).words(f"you are such {said} , the house")


def test_doubted_words_count_as_they_stand(more_counts):
    assert toxicity.Restorer(more_counts).words("over have all week house! (the clown) #nice " + "*" * 5000) >= {"over", "have", "all", "week", "house", "the", "clown", "nice"}


def test_plain_words_stay(counts):
    assert toxicity.Restorer(counts).words("The house, isn't \"nice\" été") >= {"the", "house", "nice", "été"}
    assert toxicity.Restorer(counts).words(None) == set() == toxicity.Restorer(counts).words(" \n")


def test_toxicity(spark):
    rng = random.Random(4)
    plain = [f"{a}{b}" for a in "ba ke lo mi nu re si to".split() for b in "na pe ri so tu va we zo".split()]
    bad = ["grumbo", "skelf", "blarg"]
    rows, labels = [], []
    for i in range(600):
        words = rng.choices(plain, k=rng.randint(3, 40))
        toxic = i % 5 == 0
        if toxic:
            words[rng.randrange(len(words))] = rng.choice(bad) if i % 10 else rng.choice(["gr0mb0".replace("0m", "um").replace("b0", "b0"), "5kelf", "bl4rg"])
        rows.append((i, " ".join(words)))
        if i % 3:
            labels.append((i, 1, int(toxic)))
    rows += [(1000, None), (1001, ""), (1002, "x " * 50000), (None, "bana"), (5, "grumbo bana")]
    labels += [(1, None, None), (None, 1, 1), (1, 1, 0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({c: F.lit(1) for c in ("score", "toxic", "l", "x", "id")})
    df = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    got = toxicity.score(docs, df).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    held = [(r.score, r.doc_id % 5 == 0) for r in got if r.held_out and r.doc_id < 600]
    worst, best = min(s for s, y in held if y), max(s for s, y in held if not y)
    assert worst > best and sum(r.predicted for r in got if r.doc_id and r.doc_id < 600) > 80
    flipped = df.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert {(r.doc_id, r.score) for r in toxicity.score(docs, flipped).collect()} == {(r.doc_id, r.score) for r in got}


def test_toxicity_without_labels(spark, docs, empty):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert {r.predicted for r in toxicity.score(docs, none).collect()} == {0}
    assert toxicity.score(empty, none).count() == 0


def test_preferences(spark):
    chosen = [(1, 0, "user", "q"), (1, 1, "assistant", "good"), (1, 2, "user", "t"), (2, 0, "user", None), (2, 1, "assistant", "a"), (3, 0, "user", "same"), (None, None, "user", "n"), (4, 0, "user", "b"), (4, 0, "user", "a")]
    rejected = [(1, 0, "user", "q"), (1, 1, "assistant", "bad"), (2, 0, "user", None), (2, 1, None, "a"), (3, 0, "user", "same"), (None, None, "user", "n"), (5, 0, "assistant", "alone"), (4, 0, "user", "b")]
    schema = "pair_id bigint, turn int, role string, text string"
    sides = [spark.createDataFrame(x, schema).withColumns({"part": F.lit(1), "split": F.lit(2)}) for x in (chosen, rejected)]
    pieces = preference.format_preferences(*sides)
    got = {(r.pair_id, r.part, r.turn, r.rendered, r.loss) for r in pieces.collect()}

    def said(role, text):
        return f"<|{role}|>\n{text}<|end|>\n"

    assert got == {
        (1, "prompt", 0, said("user", "q"), False), (1, "chosen", 1, said("assistant", "good"), True), (1, "chosen", 2, said("user", "t"), False),
        (1, "rejected", 1, said("assistant", "bad"), True), (2, "prompt", 0, said("user", ""), False), (2, "chosen", 1, said("assistant", "a"), True),
        (2, "rejected", 1, said("", "a"), False), (3, "prompt", 0, said("user", "same"), False), (None, "prompt", -1, said("user", "n"), False),
        (5, "rejected", 0, said("assistant", "alone"), True), (4, "prompt", 0, said("user", "b"), False),
    }
    one = {r.pair_id: r for r in preference.assembled(pieces).collect()}[1]
    assert one.prompt == said("user", "q") and one.chosen == said("assistant", "good") + said("user", "t") and [x.loss for x in one.chosen_runs] == [True, False]
    assert preference.format_preferences(*[s.limit(0) for s in sides]).count() == 0


def test_url_lists(spark):
    entries = [
        ("a.example.com", "add", "2024-01-01 10:00:00", 1), ("a.example.com", "remove", "2024-01-01 12:00:00", 2), ("a.example.com", "add", "2024-01-03 00:00:00", 3), ("example.com", "add", "2024-01-02 00:00:00", 4),
        ("example.com", "remove", "2024-01-02 00:00:00", 5), ("example.com", "add", "2024-02-01 00:00:00", 6), ("b.org/x", "add", "2023-01-01 00:00:00", 7), (None, "add", "2023-01-01 00:00:00", 8), ("b.org", "add", None, 9), ("b.org", "noise", "2023-01-01 00:00:00", 9),
    ]
    times = ["2024-01-01 09:59:59", "2024-01-01 10:00:00", "2024-01-01 12:00:00", "2024-01-02 00:00:00", "2024-01-03 05:00:00", "2024-03-01 00:00:00", None]
    urls = ["http://A.example.com/p?q=http://b.org/x", "https://user@example.com:8080", "ftp://b.org/x/y", "http://b.org", "nonsense", None, ""]
    captures = [(u, t) for u in urls for t in times] + [(urls[0], times[1])]
    log = spark.createDataFrame(entries, "pattern string, action string, ts string, ord int").withColumn("ts", F.to_timestamp("ts"))
    df = spark.createDataFrame(captures, "url string, t string").withColumns({"fetched": F.to_timestamp("t"), "pattern": F.lit(1), "day": F.lit(1), "n": F.lit(2)})
    got = url_lists.evaluate_captures(df, log, ["url", "t"])

    def active(url, t):
        covers = {urls[0]: ["a.example.com/p", "a.example.com", "example.com"], urls[1]: ["example.com"], urls[2]: ["b.org/x", "b.org"], urls[3]: ["b.org"]}.get(url, [])
        found = []
        for p in covers:
            past = [(s, o, a) for q, a, s, o in entries if q == p and a in ("add", "remove") and s and t and s <= t]
            if past and max(past)[2] == "add":
                found.append(p)
        return bool(found), len(found), min(found, key=lambda p: (-len(p), p)) if found else None

    assert Counter(tuple(r) for r in got.collect()) == Counter((u, t, *active(u, t)) for u, t in captures)
    assert url_lists.evaluate_captures(df, log.limit(0), ["url"]).where("blocked").count() == 0
    assert url_lists.evaluate_captures(df.limit(0), log, ["url"]).count() == 0


def test_empty_tables(spark, empty):
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    results = [
        sharding.shard_documents(empty), mixing.mix_documents(empty), mixing.mixed_rows(empty), simhash.near_duplicates(empty), simhash.without_near_duplicates(empty), phrases.fingerprint_documents(empty),
        decontaminate.decontaminate(empty, items), licenses.scan(empty),
    ]
    assert [r.count() for r in results] == [0] * len(results)
