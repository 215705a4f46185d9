"""Temporal list join: dated list entries become validity intervals, and captures meet those active at fetch time.

An entry adds or removes a pattern: a host, a parent domain or ``host/first-segment``. A pattern's entries are
put in order within each day and joined up over the days, so that no pattern's whole log meets in one task; each
interval is cut at day borders and joined on (pattern, day), which AQE may split further.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

DAY = 86400


def host_of(url: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1)), F.lit(""))


def candidate_patterns(url: Column) -> Column:
    """The patterns that can cover a URL: its host, every parent of two labels or more, and the host with the first segment."""
    host = host_of(url)
    labels = F.split(host, r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    segment = F.nullif(F.regexp_extract(url, r"^[^:]+://[^/?#]+/([^/?#]+)", 1), F.lit(""))
    longer = F.when(segment.isNotNull(), F.array(F.concat(host, F.lit("/"), segment))).otherwise(F.array().cast("array<string>"))
    return F.when(host.isNotNull(), F.concat(longer, parents)).otherwise(F.array().cast("array<string>"))


def validity_intervals(entries: DataFrame) -> DataFrame:
    """``pattern, action, ts, ord`` to ``pattern, since, until``: half-open, in microseconds, ``until`` null while open.

    Of entries of one pattern and time the one with the largest ``ord`` counts; entries without pattern, time or a known
    action are left out; intervals of no length are not made.
    """
    known = entries.where(F.col("pattern").isNotNull() & F.col("ts").isNotNull() & F.col("action").isin("add", "remove"))
    log = known.groupBy("pattern", F.unix_micros(F.col("ts").cast("timestamp")).alias("at")).agg(F.max(F.struct("ord", "action"))["action"].alias("action"))
    log = log.withColumn("day", F.floor(F.col("at") / (DAY * 1_000_000)))
    days = log.groupBy(F.col("pattern").alias("_p"), F.col("day").alias("_d")).agg(F.min("at").alias("first"))
    days = days.withColumn("following", F.lead("first").over(Window.partitionBy("_p").orderBy("_d"))).drop("first")
    within = Window.partitionBy("pattern", "day").orderBy("at")
    runs = log.withColumn("next", F.lead("at").over(within)).join(days, (F.col("pattern") == F.col("_p")) & (F.col("day") == F.col("_d")))
    return runs.where(F.col("action") == "add").select("pattern", F.col("at").alias("since"), F.coalesce("next", "following").alias("until"))


def evaluate_captures(captures: DataFrame, entries: DataFrame, keep: list[str], url: str = "url", fetched: str = "fetched") -> DataFrame:
    """All captures with ``blocked``, ``n_active`` (active patterns that cover it) and ``pattern`` (the longest, then least).

    A null or malformed URL or a null time meets no entry; a URL at the very time of an entry sees that entry; repeated rows
    stay. Other columns than those in ``keep`` are dropped. Without entries nothing is blocked.
    """
    rows = captures.select(*[F.col(c).alias(f"k_{c}") for c in keep], F.col(url).alias("_url"), F.unix_micros(F.col(fetched).cast("timestamp")).alias("_at"))
    asked = rows.where(F.col("_url").isNotNull() & F.col("_at").isNotNull()).select("_url", "_at").distinct()
    low, high = asked.agg(F.min("_at"), F.max("_at")).first()
    day = lambda c: F.floor(c / (DAY * 1_000_000))
    wanted = asked.select("_url", "_at", day(F.col("_at")).alias("_day"), F.explode(F.array_distinct(candidate_patterns(F.col("_url")))).alias("_pattern"))
    spans = validity_intervals(entries).withColumn("until", F.coalesce("until", F.lit(1 << 62)))
    spans = spans.where((F.col("until") > F.lit(low or 0)) & (F.col("since") <= F.lit(high or 0)))
    first, last = day(F.greatest("since", F.lit(low or 0))), day(F.least(F.col("until") - 1, F.lit(high or 0)))
    pieces = spans.select("pattern", "since", "until", F.explode(F.sequence(first, last)).alias("day"))
    met = wanted.join(pieces, (F.col("_pattern") == F.col("pattern")) & (F.col("_day") == F.col("day")) & (F.col("_at") >= F.col("since")) & (F.col("_at") < F.col("until")))
    best = F.min(F.struct((-F.length("pattern")).alias("l"), F.col("pattern").alias("p")))["p"]
    verdicts = met.groupBy(F.col("_url").alias("_u"), F.col("_at").alias("_a")).agg(F.count(F.lit(1)).alias("n"), best.alias("best"))
    joined = rows.join(verdicts, (F.col("_url") == F.col("_u")) & (F.col("_at") == F.col("_a")), "left")
    return joined.select(*[F.col(f"k_{c}").alias(c) for c in keep], F.col("n").isNotNull().alias("blocked"), F.coalesce("n", F.lit(0)).cast("bigint").alias("n_active"), F.col("best").alias("pattern"))


def derived_captures(pages: DataFrame, events: DataFrame) -> DataFrame:
    """Pages with the time of an event as their fetch time: its number is 7919 times the page's, modulo the number of events."""
    times = events.select(F.col("event_id").alias("_e"), F.col("ts").alias("fetched"))
    drawn = F.pmod(F.col("page_id") * 7919, F.lit(max(events.count(), 1)))
    return pages.select("page_id", "url").join(times, drawn == F.col("_e"), "left").drop("_e")


def derived_entries(pages: DataFrame, events: DataFrame) -> DataFrame:
    """Error events add, signups remove: the host of the page numbered by the user, or for odd events its last two labels."""
    hosts = pages.select(F.col("page_id").alias("_page"), host_of(F.col("url")).alias("host")).where(F.col("host").isNotNull())
    acts = events.where(F.col("event_type").isin("error", "signup")).select(
        "user_id", "ts", F.col("event_id").alias("ord"), F.when(F.col("event_type") == "error", "add").otherwise("remove").alias("action")
    )
    labels = F.split("host", r"\.")
    parent = F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), F.lit(2)), ".")
    named = acts.join(hosts, F.col("user_id") == F.col("_page"))
    return named.select(F.when(F.col("ord") % 2 == 1, parent).otherwise(F.col("host")).alias("pattern"), "action", "ts", "ord")
