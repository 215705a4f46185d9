"""Toxicity by noisy-channel deobfuscation.

1. A character trigram model is counted over all texts (SYMBOLS^3 cells at most, whatever the input).
2. Words with digits or signs, stretched or doubled letters or letters that may stand for others, and runs of single
   characters are restored: every character opens a lattice of readings (itself, letters it may stand for, nothing),
   and the Viterbi path with the best model probability less the channel's costs is the restored word. A word that is
   one without its end signs counts as it stands too.
3. The restored text is scored: each distinct word has the log odds of its longest well-known prefix among labelled
   documents, and a logistic model combines their extremes, counts and rates. It is fitted on at most SAMPLE labelled
   rows (documented bound; those of least hash); every row is scored over its whole text.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache
from math import log
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from starloom.session import materialise

SYMBOLS = 64
#: Labelled rows that the classifier is fitted on, cells of its table of prefixes, and bytes of the longest prefix.
SAMPLE, CELLS, LONGEST = 20_000, 1 << 20, 24
#: Documents that a prefix needs to be known, and the weight of the base rate in documents.
KNOWN, SHRINK = 5, 5.0
THRESHOLD = 0.7
#: Letters that a sign may stand for.
STANDS_FOR = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "bg", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il",
    "+": "t", "(": "c", "<": "c", "¢": "c", "€": "e", "£": "l", "¡": "i", "*": "aeiou", "#": "h", "%": "o", "^": "a", "v": "u", "к": "k", "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "і": "i",
}
#: Costs of the channel in nats: reading a sign as a letter, a letter as another, dropping a sign, one at an end, a repeated letter.
AS_LETTER, AS_OTHER, DROP, DROP_END, REPEAT = 1.0, 3.0, 1.5, 0.3, 0.7
EDGE = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "«»“”„’‘…–—¡¿"
STRETCHED = re.compile(r"(.)\1\1")
#: In a plain word, what leaves more than one reading: doubled letters, and signs and letters that stand for others.
DOUBTED = re.compile(r"([^\W\d_])\1|[" + re.escape("".join(STANDS_FOR)) + "]")
#: Runs of a sign, read as three.
SIGNS = re.compile(r"([^\w\s])\1{3,}")
#: Words that a worker remembers, and the longest of them in characters.
CACHE, LONG = 400_000, 64


def _code_table() -> np.ndarray:
    """Code points to symbols: a-z are 1 to 26, other letters share the rest, everything else ends a word (0)."""
    table = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        if c < 0x250 or 0x370 <= c < 0x600 or 0x900 <= c < 0xA000 or 0xAC00 <= c < 0xD7A4:
            if chr(c).isalpha():
                table[c] = c - 96 if 97 <= c <= 122 else 27 + c % (SYMBOLS - 27)
    return table


_TABLE: np.ndarray | None = None


def symbols(text: str) -> np.ndarray:
    global _TABLE
    if _TABLE is None:
        _TABLE = _code_table()
    return _TABLE[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]


@lru_cache(8192)
def _readings(c: str, inside: bool) -> tuple[tuple[str, float, int], ...]:
    """What a character may stand for, with its costs and symbols; "" drops it. ``inside``: it does not stand at an end of its word."""
    if c.isalpha():
        said = [(c, 0.0), *((x, AS_OTHER) for x in STANDS_FOR.get(c, "") if "a" <= x <= "z")]
    else:
        said = [*((x, AS_LETTER) for x in STANDS_FOR.get(c, "")), ("", DROP if inside else DROP_END)]
    return tuple((x, cost, int(symbols(x)[0]) if x else 0) for x, cost in said)


class Certain(dict):
    """Symbols of characters that are read as they stand, -1 for others."""

    def __missing__(self, c: str) -> int:
        found = _readings(c, True)
        self[c] = found[0][2] if len(found) == 1 and found[0][0] else -1
        return self[c]


CERTAIN = Certain()


def trigram_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``cell, n``: how often three symbols follow each other in the lower-cased texts, each set between word ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SYMBOLS**3, np.int64)
        for batch in batches:
            pieces, size = [], 0
            for t in [*batch.column(0).to_pylist(), None]:
                if t:
                    pieces.append(t)
                    size += len(t)
                if pieces and (t is None or size > 1 << 20):
                    s = symbols("  " + "  ".join(pieces).lower() + "  ").astype(np.int32)
                    total += np.bincount(s[:-2] * SYMBOLS**2 + s[1:-1] * SYMBOLS + s[2:], minlength=SYMBOLS**3)
                    pieces, size = [], 0
        cells = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int64()), pa.array(total[cells], pa.int64())], ["cell", "n"])

    counted = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(run, "cell bigint, n bigint")
    return counted.groupBy("cell").agg(F.sum("n").alias("n"))


def language_model(counts: np.ndarray) -> np.ndarray:
    """Log probabilities of a symbol after two others, from the counts of all cells; lower orders are mixed in."""
    three = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS).astype(float)
    two, one = three.sum(0), three.sum((0, 1))
    p1 = (one + 0.1) / (one.sum() + 0.1 * SYMBOLS)
    p2 = (two + 5 * p1) / (two.sum(1, keepdims=True) + 5)
    p3 = (three + 5 * p2[None]) / (three.sum(2, keepdims=True) + 5)
    return np.log(p3).astype(np.float32)


def restore(word: str, model: np.ndarray, spaced: bool = False) -> str:
    """The likeliest reading of a lower-cased word; in a ``spaced`` run of characters, words may end anywhere.

    States are the last two symbols; each holds its best reading.
    """
    return _restored(word, model.ravel().tolist(), spaced)


def _restored(word: str, chance: list[float], spaced: bool) -> str:
    """:func:`restore` with the model as one list, the last symbol running fastest. A state is its two symbols as one number."""
    states: dict[int, tuple[float, str]] = {0: (0.0, "")}
    size = len(word)
    ends = (0, size)
    if not word.isalpha() and (spaced or word.strip(EDGE)):
        ends = (size - len(word.lstrip(EDGE)), len(word.rstrip(EDGE)))
    at = 0
    while at < size:
        if len(states) == 1 and not spaced:
            # One path until a character has two readings or repeats the one before.
            ((ab, (score, said)),) = states.items()
            start, b = at, ab % SYMBOLS
            while at < size:
                s = CERTAIN[word[at]]
                if s < 0 or (s == b and b):
                    break
                score += chance[ab * SYMBOLS + s]
                ab, b = b * SYMBOLS + s, s
                at += 1
            states = {ab: (score, said + word[start:at])}
            if at == size:
                break
        coded = _readings(word[at], ends[0] <= at < ends[1])
        at += 1
        into: dict[int, tuple[float, str]] = {}
        best = into.get
        for ab, (score, said) in states.items():
            b = ab % SYMBOLS
            for x, cost, s in coded:
                if not x:
                    held = best(ab)
                    if held is None or score - cost > held[0]:
                        into[ab] = (score - cost, said)
                    continue
                state, new = b * SYMBOLS + s, score - cost + chance[ab * SYMBOLS + s]
                held = best(state)
                if held is None or new > held[0]:
                    into[state] = (new, said + x)
                if b == s and b:
                    held, new = best(ab), score - cost - REPEAT
                    if held is None or new > held[0]:
                        into[ab] = (new, said)
                if spaced and b:
                    held, new = best(s), score + chance[ab * SYMBOLS] - cost + chance[b * SYMBOLS * SYMBOLS + s]
                    if held is None or new > held[0]:
                        into[s] = (new, f"{said} {x}")
        states = into
    return max(((score + chance[ab * SYMBOLS], said) for ab, (score, said) in states.items()), default=(0.0, word))[1]


def plain(word: str) -> str | None:
    """The word without signs at its ends if it is one as it stands."""
    core = word if word.isalpha() else word.strip(EDGE)
    if (core.isalpha() or not core) and not STRETCHED.search(core):
        return core
    return None


class Remembered(dict):
    """Values of words, worked out on first use. Of more than CACHE, those met since the last CACHE // 2 new ones stay; words over LONG are not held."""

    def __init__(self, make: Callable[[str], object]):
        super().__init__()
        self.make, self.older = make, {}

    def __missing__(self, word: str):
        value = self.older.get(word)
        if value is None:
            value = self.make(word)
        if len(word) <= LONG:
            if len(self) >= CACHE // 2:
                self.older = dict(self)
                self.clear()
            self[word] = value
        return value


class Restorer:
    """Distinct restored words of texts. A text costs one look-up for each of its distinct words; only new ones are taken apart."""

    def __init__(self, counts: np.ndarray):
        self.chance = language_model(counts).ravel().tolist()
        self.readings = Remembered(self._read)
        self.runs = Remembered(lambda run: _restored(run, self.chance, True))

    def _read(self, w: str) -> str:
        """The restored words of a word, space-joined."""
        core = w if w.isalpha() and len(w) < 3 else plain(w)
        if core is not None:
            if len(w) > 2 and DOUBTED.search(w):
                return f"{core} {_restored(SIGNS.sub(r'\1\1\1', w), self.chance, False)}"
            return core
        if any(c.isalpha() or c in STANDS_FOR for c in w):
            return _restored(w, self.chance, False)
        return ""

    def words(self, text: str | None) -> set[str]:
        said = (text or "").lower().split()
        found = set(" ".join(map(self.readings.__getitem__, set(said))).split())
        alone = np.fromiter(map(len, said), np.int64, len(said)) == 1
        if (alone[:-2] & alone[1:-1] & alone[2:]).any():
            run: list[str] = []
            last = -2
            for i in [*np.flatnonzero(alone).tolist(), len(said) + 1]:
                if i != last + 1:
                    if len(run) >= 3:
                        found.update(self.runs["".join(run)].split())
                    run = []
                if i < len(said):
                    run.append(said[i])
                last = i
        return found


#: The restorer and the scorer of this Python worker and the counts they are for: later tasks find what earlier ones worked out.
_RESTORERS: dict[bytes, Restorer] = {}
_SCORERS: dict[bytes, Scorer] = {}


def restorer_of(counts: np.ndarray) -> Restorer:
    name = hashlib.sha256(counts.tobytes()).digest()
    if name not in _RESTORERS:
        _RESTORERS.clear()
        _RESTORERS[name] = Restorer(counts)
    return _RESTORERS[name]


def scorer_of(toxic: np.ndarray, both: np.ndarray, rows: tuple[int, int]) -> Scorer:
    name = hashlib.sha256(toxic.tobytes() + both.tobytes() + repr(rows).encode()).digest()
    if name not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[name] = Scorer(toxic, both, rows)
    return _SCORERS[name]


def units(word: str) -> list[int]:
    """Cells of the word's prefixes (in bytes, up to LONGEST) and of the whole word, shortest first."""
    c, cells = 0, []
    octets = word.encode("utf-8", "surrogatepass")
    for i in range(min(len(octets), LONGEST)):
        c = crc32(octets[i : i + 1], c)
        cells.append(c & (CELLS - 1))
    cells.append(crc32(b"\0", crc32(octets)) & (CELLS - 1))
    return cells


OCTETS = [bytes([b]) for b in range(256)]


class Scorer:
    """Log odds of words and features of texts, from how many labelled documents of either kind have each unit."""

    def __init__(self, toxic: np.ndarray, both: np.ndarray, rows: tuple[int, int]):
        self.toxic, self.both, self.known = array("i", toxic.tolist()), array("i", both.tolist()), (both >= KNOWN).tobytes()
        self.base = (rows[0] + 0.5) / (rows[1] + 1.0)
        self.offset = float(np.log(self.base / (1 - self.base)))
        self.seen = Remembered(self._odds)

    def odds(self, word: str, own: int | None = None) -> float:
        """``own``: the label of the document itself, whose counts are then left out."""
        n = t = 0
        octets = word.encode("utf-8", "surrogatepass")
        c, mask, less = 0, CELLS - 1, own is not None
        for i in range(min(len(octets), LONGEST)):
            c = crc32(octets[i : i + 1], c)
            m = self.both[c & mask] - less
            if m < KNOWN:
                break
            n, t = m, self.toxic[c & mask] - (own or 0)
        else:
            cell = crc32(b"\0", crc32(octets)) & mask
            if self.both[cell] - less >= KNOWN:
                n, t = self.both[cell] - less, self.toxic[cell] - (own or 0)
        return self._log_odds(t, n)

    def _log_odds(self, t: int, n: int) -> float:
        p = (max(t, 0) + SHRINK * self.base) / (n + SHRINK)
        return log(p / (1 - p)) - self.offset if p < 1 else 20.0

    def _odds(self, word: str) -> float:
        """:meth:`odds` of a document that is not among the counted ones."""
        octets = word.encode("utf-8", "surrogatepass")
        c, mask, known, cell = 0, CELLS - 1, self.known, -1
        for octet in octets[:LONGEST]:
            c = crc32(OCTETS[octet], c)
            if not known[c & mask]:
                break
            cell = c & mask
        else:
            whole = crc32(b"\0", crc32(octets)) & mask
            cell = whole if known[whole] else cell
        return self._log_odds(self.toxic[cell], self.both[cell]) if cell >= 0 else self._log_odds(0, 0)

    def features(self, words: set[str], own: int | None = None) -> list[float]:
        odds = [self.odds(w, own) for w in words] if own is not None else list(map(self.seen.__getitem__, words))
        x = np.sort(np.array(odds or [0.0]))[::-1]
        strong, very = float(np.count_nonzero(x > 1.0)), float(np.count_nonzero(x > 2.0))
        n = len(x)
        return [
            1.0, x[0], x[: min(3, n)].mean(), np.log1p(strong), np.log1p(1000 * strong / n), np.log1p(very), np.log1p(1000 * very / n),
            np.minimum(np.maximum(x, -2), 4).sum() / np.sqrt(n), np.log(n), np.log1p(strong) * np.log1p(1000 * strong / n), np.log1p(very) * np.log1p(1000 * very / n),
        ]


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights for standardised columns, folded back to the given ones, by Newton steps."""
    if not len(y) or y.min() == y.max():
        w = np.zeros(x.shape[1])
        w[0] = np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
        return w
    mean, spread = x.mean(0), x.std(0)
    mean[0], spread[0] = 0.0, 1.0
    spread[spread == 0] = 1.0
    z = (x - mean) / spread
    w, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    penalty[0] = 1e-3
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty), z.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    folded = w / spread
    folded[0] = w[0] - (w[1:] * mean[1:] / spread[1:]).sum()
    return folded


def probability(weights: np.ndarray, x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))


def training_rows(docs: DataFrame, labels: DataFrame, key: str, text: str, sample: int) -> DataFrame:
    """At most ``sample`` labelled rows outside the held-out third, those of least hash of the id, as ``text, toxic``."""
    named = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("bigint").alias("l"), F.col("toxic").cast("int").alias("toxic"))
    named = named.where(~_held_out("l")).groupBy("l").agg(F.max("toxic").alias("toxic"))
    named = named.orderBy(F.xxhash64("l"), "l").limit(sample)
    rows = docs.select(F.col(key).cast("bigint").alias("id"), F.col(text).cast("string").alias("text"))
    return rows.join(F.broadcast(named), F.col("id") == F.col("l")).select("text", "toxic")  # at most ``sample`` rows


def _held_out(key: str):
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def score(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """All rows as the key, ``held_out, score, predicted``.

    Nothing but the text is an input of a score. Null and empty texts have no words and get the score of such a text; without
    labels all scores are that of the base rate; a null id is not held out; repeated rows stay; other columns are ignored.
    """
    scored = _scored(docs, labels, key, text, sample, [key])
    return scored.select(F.col(f"k_{key}").alias(key), "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below the threshold."""
    scored = _scored(docs, labels, key, text, sample, docs.columns)
    return scored.where(F.col("score") < threshold).select(*[F.col(f"k_{c}").alias(c) for c in docs.columns])


def _scored(docs: DataFrame, labels: DataFrame, key: str, text: str, sample: int, kept: list[str]) -> DataFrame:
    """All rows as ``score``, the kept columns as ``k_<name>``, and ``held_out``."""
    sc = docs.sparkSession.sparkContext
    counts = np.zeros(SYMBOLS**3, np.int64)
    for r in trigram_counts(docs, text).collect():  # SYMBOLS^3 rows at most
        counts[r.cell] = r.n
    lm = sc.broadcast(counts)
    train = materialise(training_rows(docs, labels, key, text, sample))

    def count_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer, found = restorer_of(lm.value), np.zeros((2, CELLS), np.int32)
        for batch in batches:
            for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                cells = np.array(sorted({c for w in restorer.words(t) for c in units(w)}), np.int64)
                found[1, cells] += 1
                found[0, cells] += y
        cells = np.flatnonzero(found[1])
        yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int64()), *[pa.array(f[cells], pa.int64()) for f in found]], ["cell", "toxic", "n"])

    toxic, both = np.zeros(CELLS, np.int32), np.zeros(CELLS, np.int32)
    table = train.mapInArrow(count_units, "cell bigint, toxic bigint, n bigint").groupBy("cell").agg(F.sum("toxic").alias("toxic"), F.sum("n").alias("n")).where(F.col("n") >= KNOWN)
    got = table.toPandas()  # CELLS rows at most
    toxic[got["cell"]], both[got["cell"]] = got["toxic"], got["n"]
    n_toxic, n_all = train.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.count(F.lit(1))).first()
    shared = sc.broadcast((toxic, both, (n_toxic, n_all)))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer, scorer = restorer_of(lm.value), scorer_of(*shared.value)
        for batch in batches:
            ys = batch.column(1).to_pylist()
            rows = [[float(v) for v in scorer.features(restorer.words(t), y)] for t, y in zip(batch.column(0).to_pylist(), ys, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), pa.array(ys, pa.int32())], ["x", "y"])

    seen = train.mapInArrow(describe, "x array<double>, y int").toPandas()  # a short row for each of the sample
    x = np.array(seen["x"].tolist()).reshape(len(seen), -1) if len(seen) else np.zeros((0, 11))
    weights = fit_logistic(x, seen["y"].to_numpy(float))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer, scorer = restorer_of(lm.value), scorer_of(*shared.value)
        for batch in batches:
            rows = np.array([scorer.features(restorer.words(t)) for t in batch.column(0).to_pylist()]).reshape(batch.num_rows, -1)
            values = probability(weights, rows) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([pa.array(values, pa.float64()), *[batch.column(i) for i in range(1, batch.num_columns)]], names)

    rows = docs.select(F.col(text).cast("string").alias("_text"), *[F.col(c).alias(f"k_{c}") for c in kept], _held_out(key).alias("held_out"))
    names = ["score", *rows.columns[1:]]
    schema = ", ".join(f"`{n}` {t}" for n, t in [("score", "double"), *rows.dtypes[1:]])
    return rows.mapInArrow(judge, schema)
