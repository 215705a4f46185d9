"""Object ledgers: what changed, what to publish, what to evict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from starloom.functions import grid, naming as N
from starloom.operators.ordering import with_row_number, with_running_sum

COLUMNS = ["path", "cls", "content_type", "cache_control", "sha256", "size"]


def ledger_rows(objects: DataFrame, content: str = "content", path: str = "path") -> DataFrame:
    """Ledger of a listing (path, content): class, serving headers, hash and size.

    Hidden segments and the ledger itself are left out.
    """
    p = F.col(path)
    listed = objects.filter(~N.is_hidden(p) & (p != N.LEDGER_NAME))
    body = F.col(content).cast("binary")
    return listed.select(
        p.alias("path"), N.object_class(p).alias("cls"), N.content_type(p).alias("content_type"),
        F.sha2(body, 256).alias("sha256"), F.octet_length(body).cast("bigint").alias("size"),
    ).withColumn("cache_control", N.cache_control(F.col("cls"))).select(*COLUMNS)


def diff(remote: DataFrame | None, local: DataFrame) -> DataFrame:
    """path, action (upload, delete, unchanged), reason, purge, size.

    New paths are uploaded; so are changed bytes and changed serving headers, and those
    are purged when tiles; paths gone locally are deleted and purged when tiles.
    """
    if remote is None:
        return local.select(
            "path", "cls", F.lit("upload").alias("action"), F.lit("new").alias("reason"), F.lit(False).alias("purge"), "size"
        )
    r = remote.select("path", *[F.col(c).alias("_r_" + c) for c in COLUMNS if c != "path"])
    both = local.join(r, "path", "full")
    new, gone = F.col("_r_sha256").isNull(), F.col("sha256").isNull()
    reason = (
        F.when(new, "new")
        .when(gone, "gone")
        .when(F.col("sha256") != F.col("_r_sha256"), "content")
        .when(
            ~F.col("cache_control").eqNullSafe(F.col("_r_cache_control")) | ~F.col("content_type").eqNullSafe(F.col("_r_content_type")),
            "headers",
        )
        .otherwise("same")
    )
    cls = F.when(gone, N.object_class(F.col("path"))).otherwise(F.col("cls"))
    return both.select("path", cls.alias("cls"), reason.alias("reason"), F.when(gone, F.lit(0)).otherwise(F.col("size")).cast("bigint").alias("size")).select(
        "path", "cls",
        F.when(F.col("reason").isin("new", "content", "headers"), "upload").when(F.col("reason") == "gone", "delete").otherwise("unchanged").alias("action"),
        "reason",
        ((F.col("cls") == "tile") & F.col("reason").isin("content", "headers", "gone")).alias("purge"),
        "size",
    )


def volume(changes: DataFrame, keys: list[str] | None = None) -> DataFrame:
    up, gone = F.col("action") == "upload", F.col("action") == "delete"
    return changes.groupBy(*(keys or [])).agg(
        F.sum(F.when(up, F.col("size")).otherwise(0)).alias("upload_bytes"),
        F.count(F.when(up, 1)).alias("uploads"),
        F.count(F.when(gone, 1)).alias("deletes"),
        F.bool_and(~up & ~gone).alias("is_noop"),
    )


def batches(rows: DataFrame, order: list[str], value: str, size: int = N.PURGE_BATCH) -> DataFrame:
    """Arrays of at most ``size`` values in order."""
    if size < 1:
        raise ValueError("batch size must be at least 1")
    placed = with_row_number(rows, order, "_n").withColumn("batch", F.floor(F.col("_n") / size).cast("bigint"))
    return placed.groupBy("batch").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_n", value))), lambda e: e[value]).alias("items")
    )


# The order in which a publication is carried out.
STAGES = ("tile", "other", "delete", "purge", "ledger")


def publication(changes: DataFrame) -> DataFrame:
    """Steps in publication order: tiles, other uploads, deletes, purges, the ledger last."""
    tile = F.col("cls") == "tile"
    up = changes.filter("action = 'upload'").select(F.when(tile, 0).otherwise(1).alias("stage"), "path")
    rest = changes.filter("action = 'delete'").select(F.lit(2).alias("stage"), "path")
    purge = changes.filter("purge").select(F.lit(3).alias("stage"), "path")
    last = changes.sparkSession.range(1).select(F.lit(4).alias("stage"), F.lit(N.LEDGER_NAME).alias("path"))
    return up.unionByName(rest).unionByName(purge).unionByName(last).orderBy("stage", "path")


def merge_site(remote: DataFrame, local_site: DataFrame) -> DataFrame:
    """Ledger after a site-only publication: old entries but the site's, then the fresh site's."""
    return remote.filter(~N.is_site_file(F.col("path"))).unionByName(local_site).orderBy("path")


def size_audit(objects: DataFrame, keys: list[str], cap: int = grid.OBJECT_SIZE_CAP) -> DataFrame:
    """Per level: objects, how many exceed the cap, and the largest."""
    return objects.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("objects"),
        F.count(F.when(F.col("size") > cap, 1)).alias("over"),
        F.max("size").alias("largest_size"),
        F.max_by("path", F.struct("size", "path")).alias("largest_path"),
        F.when(F.max("size") > cap, "warn").otherwise("pass").alias("status"),
    )


def exit_code(checks: DataFrame, keys: list[str]) -> DataFrame:
    """Counts of failed and warned checks and the exit codes, plain and strict."""
    fail, warn = F.count(F.when(F.col("status") == "fail", 1)), F.count(F.when(F.col("status") == "warn", 1))
    return checks.groupBy(*keys).agg(fail.alias("failures"), warn.alias("warnings")).withColumn(
        "exit_code", F.when(F.col("failures") > 0, 1).otherwise(0)
    ).withColumn("strict_exit_code", F.when((F.col("failures") > 0) | (F.col("warnings") > 0), 1).otherwise(0))


def reusable_bands(bands: DataFrame, supertiles: DataFrame, objects: DataFrame) -> DataFrame:
    """Per band whether its last build can be kept, and why not.

    ``bands``: band, readable, n_levels, grid_hash, frame_hash (NULL without a frame);
    ``supertiles``: band, path; ``objects``: path.
    """
    lost = supertiles.join(objects.select("path"), "path", "left_anti").groupBy("band").agg(F.count(F.lit(1)).alias("lost"))
    reason = (
        F.when(~F.col("readable"), "unreadable")
        .when(F.col("n_levels") == 0, "no_levels")
        .when(F.col("lost").isNotNull(), "missing_file")
        .when(F.col("frame_hash").isNotNull() & ~F.col("frame_hash").eqNullSafe(F.col("grid_hash")), "grid_changed")
        .otherwise("reusable")
    )
    return bands.join(lost, "band", "left").select(
        "band", reason.alias("reason"), (reason == "reusable").alias("reuse"), F.coalesce("lost", F.lit(0)).alias("lost")
    )


def orphan_bands(existing: DataFrame, configured: DataFrame) -> DataFrame:
    return existing.filter(~F.col("band").startswith(".")).join(configured.select("band"), "band", "left_anti")


def carry_over_stats(bands: DataFrame, previous: DataFrame, fresh: DataFrame, columns: list[str]) -> DataFrame:
    """Statistics per band: the previous ones where the band was reused and has them, else fresh."""
    p = previous.select("band", *[F.col(c).alias("_p_" + c) for c in columns], F.lit(True).alias("_has"))
    out = bands.join(p, "band", "left").join(fresh, "band", "left")
    keep = F.col("reuse") & F.col("_has").isNotNull()
    return out.select(
        "band", *[F.when(keep, F.col("_p_" + c)).otherwise(F.col(c)).alias(c) for c in columns], F.coalesce(keep, F.lit(False)).alias("carried")
    )


def evictions(entries: DataFrame, keys: list[str], order: list[str], budget: Column) -> DataFrame:
    """Entries to evict, least recently used first, until each key fits its byte budget."""
    placed = with_running_sum(entries, keys, order, "size", "before")
    totals = entries.groupBy(*keys).agg(F.sum("size").alias("total"))
    return placed.join(totals, keys).filter(F.col("before") < F.col("total") - budget)


def collection_cards(fields: DataFrame, bands: DataFrame) -> DataFrame:
    """One card per built field: title by fallback, band count, centre of its first band.

    ``fields``: field, title_override, title, dataset_name, built; ``bands``: field, ord,
    crval1, crval2.
    """
    usable = ~F.isnan("crval1") & ~F.isnan("crval2") & (F.abs("crval1") < float("inf")) & (F.abs("crval2") < float("inf"))
    per = bands.groupBy("field").agg(F.count(F.lit(1)).alias("band_count"), F.min_by(F.struct("crval1", "crval2", usable.alias("ok")), "ord").alias("_c"))
    title = F.coalesce(*[F.nullif(c, F.lit("")) for c in ("title_override", "title", "dataset_name", "field")])
    return fields.filter("built").join(per, "field", "left").select(
        "field", title.alias("title"), F.coalesce("band_count", F.lit(0)).alias("band_count"),
        F.when(F.col("_c.ok"), F.col("_c.crval1")).alias("center_ra"), F.when(F.col("_c.ok"), F.col("_c.crval2")).alias("center_dec"),
    )
