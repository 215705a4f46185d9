"""Document fingerprints by locally consistent parsing.

Texts become phrases of phrases. At each level runs of one symbol are named as such; then deterministic coin tossing
(the lowest bit in which a symbol differs from its left neighbour, with its value there, iterated) turns names into
labels below 6 that differ between neighbours, and a phrase begins at every local maximum of the labels. As a
boundary depends on few symbols around it, equal substrings get equal phrases but for their ends, wherever they
stand. A phrase's name is a hash of its symbols, so names need no shared dictionary.

The fingerprint holds a hash of the whole text and, for each level, one minimum of the phrase names in each of BINS
classes. Likeness compares these classes. Many texts are parsed as one array, with forced phrase ends between them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

LEVELS, BINS = 5, 32
#: Characters parsed as one array; a longer text is parsed alone.
CHUNK = 1 << 18
#: Characters in one bucket of ids, and the most buckets.
BUCKET, MOST_BUCKETS = 1 << 20, 2048
#: Rounds of coin tossing that take 64-bit names to labels below 6.
TOSSES = 4

_ODD = np.uint64(0x9E3779B97F4A7C15)
_LOWEST = np.array([(i & -i).bit_length() - 1 if i else 0 for i in range(256)], np.uint8)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit values."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _powers(place: np.ndarray) -> np.ndarray:
    """Odd factors by place in a piece."""
    return mixed(place.astype(np.uint64) + _ODD) | np.uint64(1)


#: The same factors for the first places, which are most.
_POWERS = _powers(np.arange(64))


def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Hash of each piece: its values times factors by place, and its length."""
    place = np.arange(len(values)) - np.repeat(starts, np.diff(np.append(starts, len(values))))
    lengths = np.diff(np.append(starts, len(values))).astype(np.uint64)
    powers = _POWERS[place] if len(_POWERS) > place.max(initial=0) else _powers(place)
    return mixed(np.add.reduceat(values * powers, starts) + lengths)


def _labels(names: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Labels below 6, different between neighbours of one text; ``first`` marks where texts begin."""
    before = np.empty_like(names)
    before[1:] = names[:-1]
    before[first] = ~names[first]
    differ = names ^ before
    lowest = np.bitwise_count((differ & (~differ + np.uint64(1))) - np.uint64(1))
    labels = 2 * lowest + ((names >> lowest) & np.uint64(1)).astype(np.uint8)
    for _ in range(TOSSES - 1):
        before = np.empty_like(labels)
        before[1:] = labels[:-1]
        before[first] = ~labels[first]
        lowest = _LOWEST[labels ^ before]
        labels = 2 * lowest + ((labels >> lowest) & np.uint8(1))
    return labels


def next_level(names: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Phrase names and their texts (an ascending number for each name) from the names of the level below."""
    new_text = np.empty(len(names), bool)
    new_text[0] = True
    new_text[1:] = texts[1:] != texts[:-1]
    change = new_text.copy()
    change[1:] |= names[1:] != names[:-1]
    runs = np.flatnonzero(change)
    lengths = np.diff(np.append(runs, len(names))).astype(np.uint64)
    names = np.where(lengths > 1, mixed(names[runs] + lengths * _ODD), names[runs])
    texts, new_text = texts[runs], new_text[runs]
    labels = _labels(names, np.flatnonzero(new_text))
    peak = np.empty(len(names), bool)
    peak[1:-1] = (labels[1:-1] > labels[:-2]) & (labels[1:-1] > labels[2:])
    peak[[0, -1]] = False
    peak[:-1] &= ~new_text[1:]
    peak |= new_text
    # The place after a text's first is no peak of its own unless it stands above both neighbours, which holds as it is.
    starts = np.flatnonzero(peak)
    return _sums(names, starts), texts[starts]


def sketches(texts: list[str], levels: int = LEVELS, bins: int = BINS) -> tuple[np.ndarray, np.ndarray]:
    """Whole-text hashes, and for each text and level the ``bins`` minima as 16-bit values (0: none)."""
    whole = np.zeros(len(texts), np.uint64)
    out = np.zeros((len(texts), levels, bins), np.uint16)
    lengths = np.array([len(t) for t in texts], np.int64)
    filled = np.flatnonzero(lengths)
    if not len(filled):
        return whole, out
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    names = mixed(codes.astype(np.uint64) + np.uint64(1))
    of = np.repeat(np.arange(len(filled)), lengths[filled])
    for level in range(levels):
        names, of = next_level(names, of)
        least = np.full(len(filled) * bins, np.iinfo(np.uint64).max, np.uint64)
        slot = of * bins + (names % np.uint64(bins)).astype(np.int64)
        np.minimum.at(least, slot, names)
        there = np.zeros(len(least), bool)
        there[slot] = True
        short = np.where(there, (mixed(least) >> np.uint64(48)) % np.uint64(65535) + np.uint64(1), np.uint64(0))
        out[filled, level] = short.reshape(len(filled), bins)
    starts = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
    whole[filled] = _sums(names, starts)
    return whole, out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """0 to 1 for rows of two sketch arrays: the share of equal minima, averaged over the levels that tell most.

    Phrases of the lowest levels occur in any text of a language; so levels count from the third on, and lower ones
    only where one of the texts has but a few phrases there.
    """
    there = ((a != 0) | (b != 0)).sum(axis=2)
    equal = ((a == b) & (a != 0)).sum(axis=2)
    share = equal / np.maximum(there, 1)
    count = np.minimum((a != 0).sum(axis=2), (b != 0).sum(axis=2))
    weight = (count >= 4).astype(float)
    weight[:, :2] = 0
    for level in (2, 1):
        weight[:, level - 1] = np.where(weight[:, level:].sum(axis=1) == 0, count[:, level - 1] >= 4, weight[:, level - 1])
    weight[:, 0] = np.where(weight.sum(axis=1) == 0, 1.0, weight[:, 0])
    same = (a == b).all(axis=(1, 2))
    return np.where(same, 1.0, (share * weight).sum(axis=1) / weight.sum(axis=1))


def as_text(whole: np.ndarray, sketch: np.ndarray) -> list[str]:
    rows = sketch.astype(">u2")
    return [f"{int(w):016x}{r.tobytes().hex()}" for w, r in zip(whole, rows, strict=True)]


def edited(text: str, following: str) -> str:
    """The last half of the text (floor) replaced by as many first characters of the following one."""
    n = len(text) // 2
    return text[: len(text) - n] + following[:n]


def _in_order(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Rows ``bucket, id, text, guest`` placed and sorted by descending id; each bucket ends with the first row of the next one.

    Buckets are ranges between approximate quantiles of the ids, of about BUCKET characters. Only ids, counts and at
    most MOST_BUCKETS bounds come to the driver, and a text travels once.
    """
    rows = docs.select(F.col(key).cast("bigint").alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("place", F.coalesce("id", F.lit(-(1 << 63))))
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    n = int(max(1, min(MOST_BUCKETS, total // BUCKET)))
    bounds = rows.agg(F.percentile_approx("place", [i / n for i in range(1, n)], 100 * n).alias("b")).first()["b"] if n > 1 else []
    bounds = sorted(set(bounds or []))
    edges = F.array(*[F.lit(b) for b in bounds]) if bounds else F.array().cast("array<bigint>")
    rows = rows.withColumn("bucket", F.size(F.filter(edges, lambda b: b > F.col("place"))))
    firsts = sorted((r.bucket, r.top) for r in rows.groupBy("bucket").agg(F.max("place").alias("top")).collect())
    before = {top: firsts[i - 1][0] for i, (_, top) in enumerate(firsts)}
    home = F.struct(F.col("bucket"), F.lit(0).alias("guest"))
    hosts = rows.sparkSession.createDataFrame(list(before.items()), "top bigint, host int")
    marked = rows.join(F.broadcast(hosts), F.col("place") == F.col("top"), "left")  # at most a row per bucket
    both = F.when(F.col("host").isNull(), F.array(home)).otherwise(F.array(home, F.struct(F.col("host").alias("bucket"), F.lit(1).alias("guest"))))
    dealt = marked.select("id", "text", "place", F.explode(both).alias("at")).select("at.bucket", "at.guest", F.col("place"), "id", "text")
    return dealt.repartition("bucket").sortWithinPartitions("bucket", "guest", F.col("place").desc(), F.xxhash64("text"))


COLUMNS = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _described(rows: list[tuple[int | None, str]], levels: int, bins: int) -> pa.RecordBatch:
    """Results of all rows but the last, which only follows."""
    texts = [t for _, t in rows]
    changed = [edited(t, f) for t, f in zip(texts, texts[1:], strict=False)]
    whole, sketch = sketches(texts + changed, levels, bins)
    m = len(changed)
    own, following, new = sketch[:m], sketch[1 : m + 1], sketch[m + 1 :]
    return pa.RecordBatch.from_arrays(
        [
            pa.array([i for i, _ in rows[:-1]], pa.int64()),
            pa.array([len(t) for t in texts[:-1]], pa.int64()),
            pa.array([hashlib.sha256(c.encode("utf-8", "surrogatepass")).hexdigest() for c in changed], pa.string()),
            pa.array(as_text(whole[:m], own), pa.string()),
            pa.array(as_text(whole[m + 1 :], new), pa.string()),
            pa.array(likeness(own, new), pa.float64()),
            pa.array(likeness(own, following), pa.float64()),
        ],
        ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    )


def fingerprint_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", levels: int = LEVELS, bins: int = BINS) -> DataFrame:
    """All rows with their fingerprint, that of their edited text, and the likeness to it and to the next document's.

    The next document is that of the next smaller id (null ids come last, equal ids by a hash of their texts); the first follows the last.
    Null texts are empty; an empty text's fingerprint is all zeros and like itself only; repeated rows stay, each followed by
    the other; an empty table gives an empty result; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int | None, str]] = []
        size, bucket, over = 0, None, False
        for batch in batches:
            columns = [batch.column(i) for i in range(4)]
            for b, guest, i, t in zip(*columns, strict=True):
                b, guest = b.as_py(), guest.as_py()
                if b != bucket:
                    held, size, bucket, over = [], 0, b, False
                if over:
                    continue
                said = t.as_py()
                held.append((i.as_py(), said))
                size += len(said)
                over = bool(guest)
                if len(held) > 1 and (size >= CHUNK or over):
                    yield _described(held, levels, bins)
                    held = held[-1:]
                    size = len(said)

    return _in_order(docs, key, text).select("bucket", "guest", "id", "text").mapInArrow(run, COLUMNS)
