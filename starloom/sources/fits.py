"""FITS files: discovery, header scan, image rows.

Listing never opens a file (the content column of the binary reader is pruned). Headers
and image strips are then read by byte range on the executors.
"""

from __future__ import annotations

import gzip
import math
import re
from collections.abc import Iterator
from typing import BinaryIO

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from starloom.functions.cards import word, words
from starloom.functions.let import let, pack
from starloom.session import spread

BLOCK, CARD = 2880, 80
#: Inputs of a build, and what a build puts out.
GLOB = "*.{fits,fit,fits.gz,fit.gz}"
OUTPUT_GLOB = "*.fits.fz"
#: Image bytes read by one task step.
STRIP_BYTES = 64 * 1024 * 1024


def discover(spark: SparkSession, folder: str, glob: str = GLOB) -> DataFrame:
    """path, length of the FITS files in a folder, each once."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder)
    return found.select("path", "length").dropDuplicates(["path"])


def _open(path: str):
    system, inner = fs.FileSystem.from_uri(path) if ":" in path else (fs.LocalFileSystem(), path)
    handle = system.open_input_file(inner)
    return gzip.GzipFile(fileobj=handle) if path.lower().endswith(".gz") else handle


def header_words(text: str) -> dict[str, str]:
    """First value of each keyword up to END: quoted text unquoted, else the word before the slash.

    For code that walks a file; columns of header text are read by ``functions.cards``, to which the tests hold this.
    """
    out: dict[str, str] = {}
    for i in range(0, len(text), CARD):
        key, raw = text[i : i + 8].strip(), text[i + 10 : i + CARD]
        if key == "END":
            break
        if key and text[i + 8 : i + 10] == "= " and key not in out:
            quoted = re.match(r"[^/']*'((?:[^']|'')*)", raw)
            out[key] = quoted[1].replace("''", "'").rstrip() if quoted else raw.split("/")[0].strip()
    return out


def header_number(given: dict[str, str], key: str, default: int | None = None) -> int | None:
    value = given.get(key, "")
    return int(value) if re.fullmatch(r"[+-]?\d+", value) else default


def headers_of(path: str) -> Iterator[tuple[int, str, int, BinaryIO]]:
    """(hdu, header text without padding blocks, offset of the data, the open file) down the file."""
    with _open(path) as f:
        hdu, at = 0, 0
        while True:
            f.seek(at)
            text = ""
            while True:
                block = f.read(BLOCK)
                if len(block) < BLOCK:
                    return
                text += block.decode("ascii", errors="replace")
                at += BLOCK
                if any(block[i : i + 8] == b"END     " for i in range(0, BLOCK, CARD)):
                    break
            yield hdu, text, at, f
            given = header_words(text)
            axes = header_number(given, "NAXIS", 0)
            size = 0
            if axes:
                cells = math.prod(header_number(given, f"NAXIS{n}", 0) for n in range(1, axes + 1))
                size = abs(header_number(given, "BITPIX", 8)) // 8 * header_number(given, "GCOUNT", 1) * (cells + header_number(given, "PCOUNT", 0))
            at += -(-size // BLOCK) * BLOCK
            hdu += 1


def _scan_headers(batches):
    for pdf in batches:
        rows = []
        for path in pdf.path:
            try:
                rows += [(path, hdu, text, start, None) for hdu, text, start, _ in headers_of(path)]
            except (OSError, EOFError, ValueError) as e:
                rows.append((path, None, None, None, str(e)))
        yield pd.DataFrame(rows, columns=["file", "hdu", "header", "data_start", "error"])


def scan_headers(paths: DataFrame) -> DataFrame:
    """Header text of every HDU: file, hdu, header, data_start, error (unreadable files)."""
    # In turn, not by name: dropDuplicates has partitioned by name already, and a second time would be left out.
    return spread(paths.select("path")).mapInPandas(
        _scan_headers, "file string, hdu int, header string, data_start bigint, error string"
    )


def wide_headers(headers: DataFrame, keywords: list[str]) -> DataFrame:
    """One row per HDU with the first value of each keyword, lower-case columns, all text."""
    keys = ["file", "hdu", "data_start"]
    named = let(words(F.col("header")), lambda w: pack(**{k.lower(): word(w, k) for k in keywords}))
    return headers.filter("header is not null").select(*keys, named.alias("_w")).select(*keys, "_w.*")


def _read_ranges(batches):
    """Ranges in the order given, at most about STRIP_BYTES at a time; a file stays open while its ranges follow each other,
    so those of a compressed file, which come sorted, are inflated once."""
    path, handle = None, None
    try:
        for pdf in batches:
            first, got, size = 0, [], 0
            for i, (file, start, length) in enumerate(zip(pdf.file, pdf.start, pdf.length, strict=True)):
                if file != path:
                    if handle is not None:
                        handle.close()
                    path, handle = file, _open(file)
                handle.seek(int(start))
                got.append(handle.read(int(length)))
                size += int(length)
                if size >= STRIP_BYTES or i + 1 == len(pdf):
                    yield pdf.iloc[first : i + 1].assign(content=got)
                    first, got, size = i + 1, [], 0
    finally:
        if handle is not None:
            handle.close()


def read_ranges(ranges: DataFrame) -> DataFrame:
    """Adds ``content``: the bytes [start, start + length) of ``file``."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranges.schema.fields)
    return ranges.mapInPandas(_read_ranges, fields + ", content binary")


# Numpy type of each BITPIX (big-endian).
_TYPES = {8: "u1", 16: ">i2", 32: ">i4", 64: ">i8", -32: ">f4", -64: ">f8"}


def decode_image_rows(strips: DataFrame, keys: list[str]) -> DataFrame:
    """Strips of big-endian image rows to one row per image row as float32.

    ``strips``: keys, bitpix, width, y0, bscale, bzero, blank, content.
    """

    def body(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                px = np.frombuffer(r.content, dtype=_TYPES[int(r.bitpix)]).reshape(-1, int(r.width))
                values = px.astype(np.float64) * r.bscale + r.bzero if (r.bscale, r.bzero) != (1.0, 0.0) else px
                values = values.astype(np.float32)
                if r.bitpix > 0 and r.blank is not None and not pd.isna(r.blank):
                    values[px == int(r.blank)] = np.nan
                head = tuple(getattr(r, k) for k in keys)
                rows += [(*head, int(r.y0) + i, line) for i, line in enumerate(values)]
            yield pd.DataFrame(rows, columns=[*keys, "y", "values"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in strips.schema.fields if f.name in keys)
    return strips.mapInPandas(body, fields + ", y int, `values` array<float>")


def image_rows(spark: SparkSession, headers: DataFrame) -> DataFrame:
    """Image rows of every file with exactly one two-dimensional image: file, img_h, img_w, y, values.

    Work is split by file and strip of rows, so one huge mosaic is read by many tasks (unless it is compressed as a whole).
    """
    wide = wide_headers(headers, ["BITPIX", "NAXIS", "NAXIS1", "NAXIS2", "BSCALE", "BZERO", "BLANK", "XTENSION"])
    plane = F.col("naxis").try_cast("int") == 2
    image = plane & F.coalesce(F.trim("xtension").isin("IMAGE"), F.lit(True))
    one = wide.filter(image).groupBy("file").agg(
        F.count(F.lit(1)).alias("_n"),
        F.first(F.struct(*[c for c in wide.columns if c != "file"])).alias("_h"),
    ).filter("_n = 1").select("file", "_h.*")
    i = lambda c: F.col(c).try_cast("int")
    d = lambda c, default: F.coalesce(F.col(c).try_cast("double"), F.lit(default))
    row_bytes = (F.abs(F.col("bits")) / 8 * F.col("img_w")).cast("bigint")
    laid = one.select(
        "file", "data_start", i("bitpix").alias("bits"), i("naxis2").alias("img_h"), i("naxis1").alias("img_w"),
        d("bscale", 1.0).alias("bscale"), d("bzero", 0.0).alias("bzero"), F.col("blank").try_cast("double").alias("blank"),
    ).withColumn("_rb", row_bytes).withColumn("_rows", F.greatest(F.lit(1), F.floor(F.lit(STRIP_BYTES) / F.col("_rb"))).cast("int"))
    strips = laid.select("*", F.explode(F.sequence(F.lit(0), F.col("img_h") - 1, F.col("_rows"))).alias("y0"))
    n = F.least(F.col("_rows"), F.col("img_h") - F.col("y0"))
    ranges = strips.select(
        "file", "img_h", "img_w", F.col("bits").alias("bitpix"), F.col("img_w").alias("width"), "y0", "bscale", "bzero", "blank",
        (F.col("data_start") + F.col("y0") * F.col("_rb")).alias("start"), (n * F.col("_rb")).alias("length"),
    )
    # Strips of a plain file are read anywhere; those of a compressed one by the one task that inflates it.
    ranges = spread(ranges, "file", F.when(~F.lower("file").endswith(".gz"), F.col("y0"))).sortWithinPartitions("file", "start")
    return decode_image_rows(read_ranges(ranges), ["file", "img_h", "img_w"])
