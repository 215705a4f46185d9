"""Benchmark decontamination by a prefix-filtered set join over item-sized windows.

A window is ``window`` consecutive words of an item (the whole of a shorter one); a document contains it where the
same words stand in it. Shingles of two words are ordered by how often the corpus has them. As all shingles of a
window have to be found, the necessary prefix is its rarest one: documents are joined on that alone, the place in
the window gives the place where it would have to start (positional bound), and it has to end inside the document
(length bound). The words of what is left are compared one by one in the document.

Passes over the documents: shingle counts, candidates, and the comparison, which takes each document's candidates
to its text by one join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from starloom.functions.let import let
from starloom.llm.common import alnum_words
from starloom.session import materialise

WINDOW = 13
#: Shingles of windows are sent to every task up to so many (about 8 bytes each); beyond it the join is shuffled.
BROADCAST_ROWS = 1 << 20


def _identified(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).cast("bigint").alias("id"), F.col(text).cast("string").alias("text")).withColumn("h", F.xxhash64("text"))


def _places(rows: DataFrame) -> DataFrame:
    """A row per word: its place, the shingle that begins there (a null second word at the end) and the number of words."""
    w = rows.withColumn("_words", alnum_words(F.col("text")))
    pairs = F.arrays_zip(F.col("_words").alias("w"), F.slice("_words", 2, F.greatest(F.size("_words"), F.lit(1))).alias("x"))
    return w.select("id", "h", F.size("_words").alias("n"), F.posexplode(pairs).alias("pos", "pair"))


def item_windows(items: DataFrame, key: str = "item_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """``item, win``: the windows of all items, each an array of words."""
    rows = items.select(F.col(key).cast("string").alias("item"), alnum_words(F.col(text).cast("string")).alias("words"))
    rows = rows.where(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - window + 1, F.lit(1)))
    return rows.select("item", "words", F.explode(starts).alias("at")).select("item", F.slice("words", F.col("at"), F.lit(window)).alias("win")).distinct()


def _shingles(win: Column) -> Column:
    """The window's shingles with their places; that of a single word has no second word."""
    return F.transform(
        F.sequence(F.lit(0), F.greatest(F.size(win) - 2, F.lit(0))),
        lambda i: F.struct(F.xxhash64(F.get(win, i), F.get(win, i + 1)).alias("t"), i.cast("int").alias("offset")),
    )


def _meet(left: DataFrame, right: DataFrame, on: Column, rows: int, how: str = "inner") -> DataFrame:
    return left.join(F.broadcast(right) if rows <= BROADCAST_ROWS else right, on, how)


def find_windows(docs: DataFrame, windows: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """All rows as ``id, h, n_words, n_hit, wins``: words inside occurring windows, and those windows (their hashes).

    ``windows`` has a column ``win``. Words of one-word windows are looked up as such.
    """
    rows = _identified(docs, key, text)
    wins = windows.select("win").distinct().withColumn("many", F.size("win") > 1)
    asked = materialise(wins.select("win", "many", F.explode(_shingles(F.col("win"))).alias("s")).select("win", "many", "s.*"))
    shingles = asked.select("many", "t").distinct().withColumnsRenamed({"many": "_many", "t": "_t"})
    n_shingles = shingles.count()

    def tokens(alone: bool) -> DataFrame:
        second = F.lit(None).cast("string") if alone else F.col("pair.x")
        return _places(rows).select("id", "h", "n", "pos", F.lit(not alone).alias("pairs"), F.xxhash64(F.col("pair.w"), second).alias("token"))

    there = tokens(False)
    if not asked.where(~F.col("many")).isEmpty():
        there = there.unionByName(tokens(True))
    same = (F.col("token") == F.col("_t")) & (F.col("pairs") == F.col("_many"))
    counts = _meet(there.select("token", "pairs"), shingles, same, n_shingles, "left_semi").groupBy("token", "pairs").count()
    counts = counts.withColumnsRenamed({"token": "_t", "pairs": "_many"})
    ranked = asked.join(counts, (F.col("t") == F.col("_t")) & (F.col("many") == F.col("_many")))
    rarest = F.min(F.struct("count", "t", "offset"))
    # A window with a shingle that no document has lacks a row here and is found nowhere.
    whole = ranked.groupBy("win", "many").agg(rarest.alias("r"), F.count(F.lit(1)).alias("known"))
    prefix = materialise(
        whole.where(F.col("known") == F.greatest(F.size("win") - 1, F.lit(1)))
        .select("win", F.col("many").alias("_many"), F.col("r.t").alias("_t"), F.col("r.offset").alias("offset"))
    )
    met = _meet(there, prefix, same, prefix.count()).withColumn("start", F.col("pos") - F.col("offset"))
    met = met.where((F.col("start") >= 0) & (F.col("start") + F.size("win") <= F.col("n")))
    candidates = met.groupBy(F.col("id").alias("_id"), F.col("h").alias("_h")).agg(F.collect_set(F.struct("start", "win")).alias("c"))
    joined = rows.join(candidates, F.col("id").eqNullSafe(F.col("_id")) & F.col("h").eqNullSafe(F.col("_h")), "left")

    def verified(words: Column) -> Column:
        found = F.filter(F.coalesce(F.col("c"), F.array().cast(candidates.schema["c"].dataType)), lambda c: F.slice(words, c["start"] + 1, F.size(c["win"])) == c["win"])
        return F.struct(F.size(words).alias("n"), F.array_sort(F.transform(found, lambda c: F.struct(c["start"].alias("start"), F.size(c["win"]).alias("len"), F.xxhash64(c["win"]).alias("w")))).alias("hits"))

    seen = F.aggregate(
        F.col("v.hits"),
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda a, x: F.struct(
            (a["n"] + F.greatest(F.lit(0), x["start"] + x["len"] - F.greatest(a["end"], x["start"]))).alias("n"), F.greatest(a["end"], x["start"] + x["len"]).alias("end")
        ),
        lambda a: a["n"],
    )
    return joined.select("id", "h", let(alnum_words(F.col("text")), verified).alias("v")).select(
        "id", "h", F.col("v.n").cast("bigint").alias("n_words"), seen.cast("bigint").alias("n_hit"), F.array_distinct("v.hits.w").alias("wins")
    )


def decontaminate(
    docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", window: int = WINDOW
) -> DataFrame:
    """All rows as ``id, h, n_words, n_hit, items, contaminated``; ``h`` is the text's hash, ``items`` the sorted ids as strings.

    Contaminated: at least one word hit and at least one in twenty. A null or empty text has no words and no hits; items without
    words have no window; items of one id count once; repeated rows each get their result; without items nothing is hit;
    other columns are ignored.
    """
    named = materialise(item_windows(items, item_key, item_text, window))
    found = materialise(find_windows(docs, named, key, text))
    of = named.select(F.xxhash64("win").alias("_win"), "item")
    pairs = found.where(F.col("n_hit") > 0).select("id", "h", F.explode("wins").alias("win")).distinct()
    ids = pairs.join(of, F.col("win") == F.col("_win")).groupBy(F.col("id").alias("_id"), F.col("h").alias("_h")).agg(F.array_sort(F.collect_set("item")).alias("items"))
    joined = found.join(ids, F.col("id").eqNullSafe(F.col("_id")) & F.col("h").eqNullSafe(F.col("_h")), "left")
    return joined.select(
        "id", "h", "n_words", "n_hit", F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


def without_contaminated(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that are not contaminated."""
    bad = decontaminate(docs, items, key, text, **options).where("contaminated").select(F.col("id").alias("_id"), F.col("h").alias("_h")).distinct()
    same = F.col(key).cast("bigint").eqNullSafe(F.col("_id")) & (F.xxhash64(F.col(text).cast("string")) == F.col("_h"))
    return docs.join(bad, same, "left_anti")
