"""Row tables of compressed images: a data source that reads them in parts, their layout as columns, the tile index.

The reader lists the folder by name and size only; a task opens its files, walks to the table and reads its own share of the
rows. Layouts are worked out from header text by column functions, so a row of this source (a part of a table with its
header) becomes index rows without a join or a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from fnmatch import fnmatch
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from starloom.operators.quantise import dither_method
from starloom.session import bound_batches
from starloom.sources.fits import CARD, OUTPUT_GLOB, header_number, header_words, headers_of

FORMAT = "starloom_row_tables"
#: Bytes of files that one task is given; a larger file is read by several tasks, each with a share of its rows.
CHUNK = 128 << 20
#: Table bytes in one row of the source.
PIECE = 4 << 20


@dataclass
class Share(InputPartition):
    """``(file, k, n)``: the k-th of n equal shares of the rows of each file."""

    value: list[tuple[str, int, int]]


class RowTableReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.folder = options["path"].rstrip("/")
        self.glob = options.get("glob", OUTPUT_GLOB)
        self.chunk = int(options.get("chunk", CHUNK))
        self.wanted: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Equality and membership on ``file`` choose files before any is opened."""
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("file",):
                named = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted = named if self.wanted is None else self.wanted & named
            else:
                yield f

    def _files(self) -> Iterator[tuple[str, int]]:
        system, inner = fs.FileSystem.from_uri(self.folder) if ":" in self.folder else (fs.LocalFileSystem(), self.folder)
        for info in sorted(system.get_file_info(fs.FileSelector(inner)), key=lambda i: i.base_name):
            file = f"{self.folder}/{info.base_name}"
            if info.is_file and fnmatch(info.base_name, self.glob) and (self.wanted is None or file in self.wanted):
                yield file, info.size

    def partitions(self) -> Sequence[InputPartition]:
        shares, group, size = [], [], 0
        for file, length in self._files():
            n = max(1, -(-length // self.chunk))
            if n > 1:
                shares += [Share([(file, k, n)]) for k in range(n)]
                continue
            if group and size + length > self.chunk:
                shares.append(Share(group))
                group, size = [], 0
            group.append((file, 0, 1))
            size += length
        return [*shares, Share(group)]

    def read(self, partition: Share) -> Iterator[pa.RecordBatch]:
        """Batches of about PIECE bytes, so that a task holds no more of its files at a time."""
        waiting, size = [], 0
        for row in self._rows(partition):
            waiting.append(row)
            size += len(row[4] or b"") + len(row[1] or "")
            if size >= PIECE:
                yield _batch(waiting)
                waiting, size = [], 0
        yield _batch(waiting)

    def _rows(self, partition: Share) -> Iterator[tuple]:
        for file, k, n in partition.value:
            try:
                yield from _rows_of(file, k, n)
            except (OSError, EOFError, ValueError, TypeError) as e:
                yield file, None, None, None, None, str(e)


_ROW = pa.schema([("file", pa.string()), ("header", pa.string()), ("data_start", pa.int64()), ("first_row", pa.int64()), ("content", pa.binary()), ("error", pa.string())])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_ROW)], schema=_ROW)


def _rows_of(file: str, k: int, n: int) -> Iterator[tuple]:
    """The k-th of n shares of the rows of the first table, in pieces; the first share of a table without rows has an empty piece."""
    for hdu, text, start, handle in headers_of(file):
        if hdu != 1:
            continue
        given = header_words(text)
        width, rows = header_number(given, "NAXIS1"), header_number(given, "NAXIS2")
        if width is None or rows is None or width < 0 or rows < 0:
            break
        low, high = rows * k // n, rows * (k + 1) // n
        step = max(1, PIECE // max(width, 1))
        for at in range(low, high, step) if high > low else [0] * (k == 0):
            length = (min(at + step, high) - at) * width if high > low else 0
            handle.seek(start + at * width)
            content = handle.read(length)
            if len(content) < length:
                raise ValueError("row table cut short")
            yield file, text, start, at, content, None
        return
    raise ValueError("no row table behind the primary header")


class RowTables(DataSource):
    """Options: ``path`` of the folder, ``glob`` of file names, ``chunk`` bytes a task."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "file string, header string, data_start bigint, first_row bigint, content binary, error string"

    def reader(self, schema) -> RowTableReader:
        return RowTableReader(dict(self.options))


def read_row_tables(spark: SparkSession, folder: str, glob: str = OUTPUT_GLOB, chunk: int = CHUNK) -> DataFrame:
    """Parts of row tables: file, header, data_start, first_row, content, error (unreadable files, then the rest is null)."""
    bound_batches(spark)
    # Without this setting, which is off by default, filters would not reach pushFilters.
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RowTables)
    return spark.read.format(FORMAT).option("glob", glob).option("chunk", chunk).load(folder)


# Bytes per element of each table column code.
_CODE_BYTES = {"L": 1, "X": 1, "B": 1, "A": 1, "I": 2, "J": 4, "E": 4, "K": 8, "D": 8, "C": 8, "M": 16}


#: Words of a table header that the layout needs, and their columns.
_WORDS = "ZCMPTYPE ZQUANTIZ NAXIS1 NAXIS2 PCOUNT ZBLANK ZNAXIS1 ZNAXIS2 ZTILE1 ZTILE2 ZBLOCKSIZE ZDITHER0 THEAP".split()
_HEAD = ", ".join(f"{w.lower()} string" for w in _WORDS) + ", name array<string>, tform array<string>, offset array<int>, table_bytes int"


@lru_cache(maxsize=4096)
def _width(form: str) -> int | None:
    """Bytes of one table column: descriptors are 16 or 8, the rest count times element size; None for an unknown code."""
    if "Q" in form or "P" in form:
        return 16 if "Q" in form else 8
    found = re.match(r"\s*([0-9]*)([A-Z])", form)
    size = _CODE_BYTES.get(found[2]) if found else None
    count = int(found[1] or 1) if found else 0
    return size * count if size is not None and count < 1 << 31 else None


def _head(text: str | None) -> tuple:
    """The words of one header, then names, forms and offsets of its table columns and the bytes of a row; None without END."""
    if text is None or not any(text[i : i + 8].strip() == "END" for i in range(0, len(text), CARD)):
        return (None,) * (len(_WORDS) + 4)
    given = header_words(text)
    columns = range(1, header_number(given, "TFIELDS", 0) + 1)
    forms = [given.get(f"TFORM{i}", "") for i in columns]
    widths = [_width(f) for f in forms]
    ends = None if None in widths else [0, *accumulate(widths)]
    return (
        *[given.get(w) for w in _WORDS], [given.get(f"TTYPE{i}", f"COL{i}") for i in columns], forms,
        ends and ends[:-1], ends and ends[-1],
    )


def header_layout(headers: pd.Series) -> pd.DataFrame:
    out = pd.DataFrame([_head(t) for t in headers], columns=[f.split()[0] for f in _HEAD.split(", ")], dtype=object)
    return out.assign(table_bytes=out.table_bytes.astype("Int32"))


def table_layout(tables: DataFrame) -> DataFrame:
    """Byte layout of compressed-image tables from their header text, beside the columns of ``tables`` (file, header, data_start, ...).

    ``valid`` is false where the tile index cannot be read (see ``validate.tile_tables`` for the reasons); ``columns``
    lists name, tform, offset, and is empty where a column's width is not known.
    """
    head = F.col("_w")

    def number(key: str, default: Column | None = None) -> Column:
        value = head[key.lower()]
        whole = F.when(value.rlike(r"^[+-]?\d+$"), value.try_cast("bigint"))
        return whole if default is None else F.coalesce(whole, default)

    one = F.lit(1).cast("bigint")
    placed = tables.withColumn("_w", F.pandas_udf(header_layout, _HEAD)(F.col("header"))).select(
        *tables.columns, "_w", head["zcmptype"].alias("zcmptype"), head["zquantiz"].alias("zquantiz"),
        number("NAXIS1").alias("row_bytes"), number("NAXIS2").alias("n_rows"), number("PCOUNT", one * 0).alias("pcount"), number("ZBLANK").alias("zblank_key"),
        number("ZNAXIS1").alias("znaxis1"), number("ZNAXIS2").alias("znaxis2"), number("ZTILE1").alias("ztile1"), number("ZTILE2", one).alias("ztile2"),
        number("ZBLOCKSIZE", one * 32).alias("block_size"), number("ZDITHER0", one * 0).alias("zdither0"), number("THEAP").alias("theap"), head["table_bytes"].alias("_all"),
    )
    kind = "array<struct<name:string,tform:string,offset:int>>"
    placed = placed.withColumn("ztile1", F.coalesce("ztile1", "znaxis1")).withColumn(
        "columns", F.when(F.col("_all").isNull(), F.array().cast(kind)).otherwise(F.arrays_zip("_w.name", "_w.tform", "_w.offset").cast(kind))
    )
    has = lambda name: F.coalesce(F.array_contains("_w.name", name), F.lit(False))
    known = F.col("_all").isNotNull() & F.col("row_bytes").isNotNull() & F.col("n_rows").isNotNull() & (F.col("ztile1") > 0) & (F.col("ztile2") > 0) & F.col("znaxis2").isNotNull()
    across, down = (F.ceil(F.col(n) / F.col(t)).cast("bigint") for n, t in (("znaxis1", "ztile1"), ("znaxis2", "ztile2")))
    valid = known & (F.col("_all") == F.col("row_bytes")) & (F.col("n_rows") == across * down) & F.col("zcmptype").isin("RICE_1", "GZIP_2") & has("COMPRESSED_DATA")
    valid = valid & ((F.col("zcmptype") != "RICE_1") | has("ZSCALE"))
    laid = placed.select(
        *[c for c in placed.columns if c not in ("_w", "_all", "theap")],
        F.coalesce("theap", F.col("row_bytes") * F.col("n_rows")).alias("theap"), F.when(known, across).alias("nx"), has("ZSCALE").alias("has_zscale"),
        F.coalesce(valid, F.lit(False)).alias("valid"),
    ).withColumn("heap_start", F.col("data_start") + F.col("theap"))
    # Each row as its own only element: a filter on the layout stays above this instead of taking copies of all formulas down to the scan.
    return laid.select(F.inline(F.array(F.struct(*laid.columns))))


_INDEX = (
    "file string, local_x int, local_y int, row int, start bigint, length bigint, w int, h int, zscale double, zzero double, "
    "zblank double, dither_method int, zdither0 int, compression string, block_size int"
)
_INDEX_TYPES = [pa.string(), *[pa.int32()] * 3, *[pa.int64()] * 2, *[pa.int32()] * 2, *[pa.float64()] * 3, *[pa.int32()] * 2, pa.string(), pa.int32()]


#: Table bytes decoded at once: an index row takes some ten times its table row.
DECODED = 2 << 20


def _shares(laid: np.ndarray, sizes: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of one layout, in shares that begin at most DECODED bytes apart."""
    for layout in np.unique(laid, axis=0):
        chosen = np.flatnonzero((laid == layout).all(axis=1))
        before = np.cumsum([0, *(sizes[i] for i in chosen)])[:-1]
        for at in np.split(chosen, np.flatnonzero(np.diff(before // DECODED)) + 1):
            yield layout, at


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts of row tables to one row per tile. Parts of one layout are decoded together, as one array of table rows."""
    for batch in batches:
        col = {n: batch.column(n) for n in batch.schema.names}
        laid = np.stack([col[n].to_numpy() for n in ("row_bytes", "wide", "at_data", "at_blank", "at_scale", "at_zero")], axis=1)
        for layout, chosen in _shares(laid, [len(c.as_buffer()) for c in col["content"]]):
            width, wide, at_data, at_blank, at_scale, at_zero = layout.tolist()
            octets = [col["content"][int(i)].as_buffer() for i in chosen]
            counts = np.array([len(o) // width for o in octets], np.int64)
            table = np.frombuffer(b"".join(octets), np.uint8).reshape(-1, width)
            of = lambda n: np.repeat(col[n].to_numpy(zero_copy_only=False)[chosen], counts)
            field = lambda at, kind: np.ascontiguousarray(table[:, at : at + np.dtype(kind).itemsize]).view(kind)[:, 0]
            nan = np.full(len(table), np.nan)
            length, offset = (field(at_data + d, kind).astype(np.int64) for kind in (">i8" if wide else ">i4",) for d in (0, np.dtype(kind).itemsize))
            row = np.arange(len(table)) - np.repeat(np.cumsum(counts) - counts, counts) + of("first_row")
            nx, t1, t2 = of("nx"), of("ztile1"), of("ztile2")
            lx, ly = row % nx, row // nx
            values = [
                of("file"), lx, ly, row, of("heap_start") + offset, length, np.minimum(t1, of("znaxis1") - lx * t1), np.minimum(t2, of("znaxis2") - ly * t2),
                nan if at_scale < 0 else field(at_scale, ">f8"), nan if at_zero < 0 else field(at_zero, ">f8"), of("zblank_key") if at_blank < 0 else field(at_blank, ">i4"),
                of("dither_method"), of("zdither0"), of("zcmptype"), of("block_size"),
            ]
            arrays = [pa.array(v if t == pa.string() else v.astype(t.to_pandas_dtype()), t) for v, t in zip(values, _INDEX_TYPES, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, [c.split()[0] for c in _INDEX.split(", ")])


def tile_index(tables: DataFrame) -> DataFrame:
    """One row per compressed tile: where its bytes are and how to undo the quantisation.

    ``tables``: file, header, data_start, content (rows of the table) and, for a part, first_row. Tables that
    break a rule of ``validate.tile_tables`` have no rows.
    """
    if "first_row" not in tables.columns:
        tables = tables.withColumn("first_row", F.lit(0).cast("bigint"))
    ready = table_layout(tables.filter("header is not null").select("file", "header", "data_start", "first_row", "content")).filter("valid")
    column = lambda name: F.get(F.filter("columns", lambda c: c["name"] == name), F.lit(0))
    at = lambda name: F.coalesce(column(name)["offset"], F.lit(-1)).cast("bigint")
    form = column("COMPRESSED_DATA")["tform"]
    return ready.select(
        "file", "content", "first_row", "heap_start", "row_bytes", "nx", "znaxis1", "znaxis2", "ztile1", "ztile2", form.contains("Q").cast("bigint").alias("wide"),
        at("COMPRESSED_DATA").alias("at_data"), at("ZBLANK").alias("at_blank"), at("ZSCALE").alias("at_scale"), at("ZZERO").alias("at_zero"),
        F.coalesce(F.col("zblank_key").cast("double"), F.lit(float("nan"))).alias("zblank_key"), F.col("zdither0"), F.col("zcmptype"), F.col("block_size"), dither_method(F.col("zquantiz")).alias("dither_method"),
    ).mapInArrow(_decoded, _INDEX)


def scan_tile_index(spark: SparkSession, folder: str, glob: str = OUTPUT_GLOB, chunk: int = CHUNK, files: list[str] | None = None) -> DataFrame:
    """Tile index of the compressed files of a folder (or of some of them); only row tables are read."""
    parts = read_row_tables(spark, folder, glob, chunk)
    return tile_index(parts if files is None else parts.filter(F.col("file").isin(files)))
