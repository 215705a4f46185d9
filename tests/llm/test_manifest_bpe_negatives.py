"""Merkle manifests, byte-level BPE and hard negatives against brute force, with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import base64
import hashlib
import random
import sys
import zlib

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from starloom.llm import bpe, hard_negatives, merkle
from tests.llm.test_operators import SCHEMA, documents

CLASHING = "key group digest altered tree idx levels block path subroot g p r row id v asked cell side own other n".split()


def H(text):
    return hashlib.sha256(text.encode()).hexdigest()


def enc(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(row):
    i, text, lang, source, n = row
    return H("".join(map(enc, (i, source, lang, n, text))))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([H("".join(out[-1][i : i + 3])) for i in range(0, len(out[-1]), 3)])
    return out


def proof(tree, i):
    steps = []
    for level in tree[:-1]:
        low = i // 3 * 3
        steps.append((level[low:i], level[i + 1 : low + 3]))
        i //= 3
    return steps


def manifest(rows, change):
    """Every row's result by the words of the contract."""
    first = lambda v: (v is not None, v if v is not None else 0)
    sources = sorted({r[3] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: sorted((r for r in rows if r[3] == s), key=lambda r: (first(r[0]), leaf(r))) for s in sources}
    built = {s: levels([leaf(r) for r in rs]) for s, rs in trees.items()}
    top = levels([built[s][-1][0] for s in sources])
    out = []
    for j, s in enumerate(sources):
        for i, row in enumerate(trees[s]):
            steps = proof(built[s], i) + proof(top, j)
            digest = leaf(change(row))
            for left, right in steps:
                digest = H("".join([*left, digest, *right]))
            out.append((row[0], leaf(row), built[s][-1][0], top[-1][0], H("".join(x for step in steps for side in step for x in side)), digest, digest == top[-1][0]))
    return sorted(out, key=repr)


def tampered(row):
    i, text, *rest = row
    return (i, text.replace("\n", "") if text is not None and i is not None and zlib.crc32(str(i).encode()) % 2 == 0 else text, *rest)


def altered():
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    return {"text": F.when(hit, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))}


@pytest.mark.parametrize("span", [2, 6])
def test_manifest(spark, span):
    rows = documents() + [(400 + i, f"two\nlines {i}\n", "en", "ünï" if i % 2 else "z", None) for i in range(11)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(7) for c in CLASHING}).repartition(5)
    got = sorted((tuple(r) for r in merkle.manifest(df, altered=altered(), span=span).collect()), key=repr)
    assert got == manifest(rows, tampered)
    assert 0 < sum(not r[6] for r in got) < 12


@pytest.mark.parametrize("n", [0, 1, 4, 28])
def test_manifest_of_one_source_or_many(spark, n):
    for source in (lambda i: None, lambda i: f"s{i:02d}"):
        rows = [(i, f"t{i}", None, source(i), i) for i in range(n)]
        got = merkle.manifest(spark.createDataFrame(rows, SCHEMA), span=1).collect()
        assert sorted((tuple(r) for r in got), key=repr) == (manifest(rows, lambda r: r) if n else [])
        assert all(r.verified for r in got)


@given(st.integers(1, 60), st.integers(0, 3))
@settings(max_examples=60, deadline=None)
def test_sweeps(n, extra):
    digests = [hashlib.sha256(bytes([i])).digest() for i in range(n)]
    height = sum(3**i < n for i in range(9)) + extra
    root, runs = merkle.forward(digests, height)
    labels = list(runs)
    assert labels == sorted(labels)
    for i, steps in merkle.backward(runs, n, height, ()):
        assert len(steps) == height and merkle.folded(digests[i], steps) == root
        assert merkle.unpacked(merkle.packed(steps)) == steps


@pytest.fixture(scope="module")
def lines():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        return f.read()


@pytest.fixture(scope="module")
def reference(lines):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines.splitlines())}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids(packed):
    return np.frombuffer(packed, "<u4").tolist()


HARD = ["", " ", "  ", "   a", "a   b", " \n \n x", "x \n", "foo  ", "it's we'LL 'tis", "a  b", "x\x1c y\x1d  z", "\x85 q", "aaaaaaa ababab hahaha", "naïve Über 東京 都 𝒳𝒴 🏳️‍🌈", "1234 ½ Ⅷ ² ٣", "\n\n\n", "a" * 5000, "ab" * 3000 + " " * 50 + "!" * 99, "<|endoftext|> x"]


def test_tokens_are_those_of_the_library(lines, reference):
    rng = random.Random(4)
    alphabet = "aabcdeehilnorst  '\n\t.,-0159éßжЯ你🙂 \x1f"
    texts = HARD + ["".join(rng.choices(alphabet, k=rng.randint(0, 60))) for _ in range(3000)] + ["".join(chr(rng.choice([rng.randrange(32, 0xD7FF), rng.randrange(0xE000, 0x2FFFF)])) for _ in range(20)) for _ in range(500)]
    encoder = bpe.Encoder(bpe.Vocabulary(lines), public_tokenizers.PATTERN, known=500)
    for low in range(0, len(texts), 400):
        for text, packed in zip(texts[low : low + 400], encoder.encode(texts[low : low + 400]), strict=True):
            assert ids(packed) == reference.encode_ordinary(text), text
            assert encoder.vocabulary.decoded(packed) == text.encode()


def test_every_character_is_of_the_library_s_class():
    """A letter is one piece with a letter before it and a number with a number, for which there are tokens here."""
    known = regex.compile(r"[\p{L}\p{N}]")
    characters = [c for c in map(chr, (*range(0xD800), *range(0xE000, 0x110000))) if known.match(c)]
    assert len(characters) > 140_000  # any other character is other to the older version as well
    for low in range(0, len(characters), 100_000):
        part = characters[low : low + 100_000]
        ranks = {bytes([b]): b for b in range(256)} | {(p + c).encode(): 256 + 2 * i + j for i, c in enumerate(part) for j, p in enumerate("a1") if (p + c).encode() != p.encode()}
        library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        encoder = bpe.Encoder(bpe.Vocabulary(b"\n".join(base64.b64encode(t) + b" " + str(r).encode() for t, r in ranks.items())), public_tokenizers.PATTERN)
        texts = [f"a{c} 1{c}" for c in part]
        assert [ids(p) for p in encoder.encode(texts)] == library.encode_ordinary_batch(texts)


def one_by_one(word, ranks):
    """Least rank first, leftmost first, looked for anew after every merge."""
    if word in ranks:
        return [ranks[word]]
    parts = [word[i : i + 1] for i in range(len(word))]
    while True:
        best = min(((ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in ranks), default=None)
        if best is None:
            return [ranks[p] for p in parts]
        i = best[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


@given(st.lists(st.text("abc", min_size=2, max_size=6), unique=True, max_size=30), st.lists(st.text("abc", min_size=1, max_size=14), max_size=20), st.randoms())
@settings(max_examples=300, deadline=None)
def test_replay_with_ranks_in_any_order(tokens, words, rng):
    """Also where a merge makes a pair of lower rank, which no trained vocabulary has."""
    rng.shuffle(tokens)
    ranks = {bytes([b]): b for b in range(256)} | {t.encode(): 256 + i for i, t in enumerate(tokens)}
    vocabulary = bpe.Vocabulary(b"\n".join(base64.b64encode(t) + b" " + str(r).encode() for t, r in ranks.items()))
    encoder = bpe.Encoder(vocabulary, r"\S+|\s+")
    want = [one_by_one(w.encode(), ranks) for w in words]
    assert [ids(p) for p in encoder.encode(words)] == want
    left = [w.encode() for w in words if w.encode() not in ranks]
    for many in (1, 24):
        bpe.MANY = many
        flat, counts = bpe.replay(left, vocabulary)
        assert [part.tolist() for part in np.split(flat, np.cumsum(counts)[:-1])][: len(left)] == [one_by_one(w, ranks) for w in left]


def test_bpe_of_a_table(spark, lines, reference):
    rows = documents() + [(500 + i, t, "en", "s", 0) for i, t in enumerate(HARD)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(7) for c in ("key", "ids", "n_tokens", "decoded")})
    for chunk in (1 << 22, 64):
        got = bpe.tokenise(df, lines, public_tokenizers.PATTERN, keep_decoded=True, chunk=chunk).collect()
        want = []
        for i, text, *_ in rows:
            packed = np.array(reference.encode_ordinary(text or ""), "<u4").tobytes()
            octets = (text or "").encode()
            want.append((i, len(packed) // 4, packed, octets, hashlib.sha256(packed).hexdigest(), hashlib.sha256(octets).hexdigest()))
        assert sorted((tuple(bytes(v) if isinstance(v, bytearray) else v for v in r) for r in got), key=repr) == sorted(want, key=repr)
    assert bpe.tokenise(spark.createDataFrame([], SCHEMA), lines, public_tokenizers.PATTERN).count() == 0
    assert sys.byteorder == "little" or got


def test_a_vocabulary_without_a_byte_is_refused():
    with pytest.raises(ValueError):
        bpe.Vocabulary(base64.b64encode(b"a") + b" 0")


@given(st.integers(1, 70), st.integers(1, 70), st.integers(1, 70), st.sampled_from([1, 2, 4, 16]))
@settings(max_examples=60, deadline=None)
def test_strassen(m, k, n, plain):
    rng = np.random.default_rng(m * k * n)
    for top in (3, 1 << 40, 1 << 62):
        a, b = rng.integers(-top, top, (m, k)), rng.integers(-top, top, (k, n))
        assert (hard_negatives.strassen(a, b, plain) == a @ b).all()


VECTORS = "vec_id bigint, embedding array<float>, label int"


def vectors():
    rng = random.Random(2)
    rows = [(i, [rng.choice([-0.5, -0.25, 0.0, 0.25, 0.5, 0.7]) for _ in range(5)], rng.randrange(3)) for i in range(260)]
    rows += [(i, [0.5, 0.5, 0.25, 0.0, 0.5], i % 3) for i in range(260, 420)]  # one vector many times
    rows += [(100, rows[100][1], rows[100][2]), (7, rows[7][1], rows[7][2]), (200, [0.1] * 5, 1)]
    rows += [(500, None, 1), (501, [0.1, None, 0.2, 0.3, 0.4], 1), (502, [float("nan")] * 5, 1), (503, [float("inf")] * 5, 1), (600, [0.1] * 5, None), (None, [0.5] * 5, 1), (None, [0.7] * 5, 2), (700, [], 1), (800, [0.9, 0.9], 2)]
    return rows


def hard(rows):
    taking = []
    for i, v, label in rows:
        if label is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        whole = [int(np.floor(256 * float(np.float32(x)))) for x in v] + [0] * (5 - len(v))
        taking.append((i, (label + 1) % 10 if i is not None and i % 7 == 0 else label, np.array(whole, np.int64)))
    out, last = [], 1 << 63
    for a, (i, label, v) in enumerate(taking):
        if i is None or i % 100:
            continue
        scored = [(-int(v @ w), last if j is None else j, other) for b, (j, other, w) in enumerate(taking) if b != a]
        for p, pid, _ in sorted(s for s in scored if s[2] == label)[:5]:
            window = sorted(s for s in scored if s[2] != label and -80 * p <= -100 * s[0] <= -100 * p)[:5]
            out += [(i, None if pid == last else pid, rank, None if s[1] == last else s[1], -p, -s[0]) for rank, s in enumerate(window, 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("cell, sizes", [(1 << 23, None), (200, (4, 16))])
def test_hard_negatives(spark, monkeypatch, cell, sizes):
    if sizes:
        monkeypatch.setattr(hard_negatives, "ANCHORS", sizes[0])
        monkeypatch.setattr(hard_negatives, "CANDIDATES", sizes[1])
    df = spark.createDataFrame(vectors(), VECTORS).withColumns({c: F.lit(7) for c in CLASHING + ["rank", "anchor_id", "score", "anchor_row"]}).repartition(4)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    got = hard_negatives.mine(df, F.col("id") % 100 == 0, label, cell=cell).collect()
    want = hard(vectors())
    assert sorted((tuple(r) for r in got), key=repr) == want and len(want) > 60


def test_hard_negatives_of_nothing(spark):
    df = spark.createDataFrame([], VECTORS)
    assert hard_negatives.mine(df, F.col("id") % 100 == 0).count() == 0
    lonely = spark.createDataFrame([(100, [0.5], 1), (3, [0.5], 2)], VECTORS)
    assert hard_negatives.mine(lonely, F.col("id") % 100 == 0).count() == 0
