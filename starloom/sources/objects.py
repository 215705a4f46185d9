"""Listing of a published folder with content hashes."""

from __future__ import annotations

import hashlib

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from starloom.functions import naming as N
from starloom.operators.ledger import COLUMNS
from starloom.session import bound_batches, spread

#: Bytes hashed at a time; objects are too big to load whole.
CHUNK = 1024 * 1024


def _hash(batches):
    for pdf in batches:
        digests = []
        for path in pdf.full_path:
            h = hashlib.sha256()
            with _raw(path) as f:
                while chunk := f.read(CHUNK):
                    h.update(chunk)
            digests.append(h.hexdigest())
        yield pdf.assign(sha256=digests)


def _raw(path: str):
    """Stored bytes: a compressed object is hashed as it lies."""
    system, inner = fs.FileSystem.from_uri(path) if ":" in path else (fs.LocalFileSystem(), path)
    return system.open_input_file(inner)


def write_objects(objects: DataFrame, folder: str) -> None:
    """Writes ``content`` (BINARY) of each row to ``path`` below ``folder``, on the executors. Rerun tasks write the same bytes."""
    bound_batches(objects.sparkSession)
    system_uri = folder if ":" in folder else f"file://{folder}"

    def write(batches):
        system, base = fs.FileSystem.from_uri(system_uri)
        for pdf in batches:
            for path, content in zip(pdf.path, pdf.content, strict=True):
                target = f"{base}/{path}"
                system.create_dir(target.rpartition("/")[0], recursive=True)
                with system.open_output_stream(target) as out:
                    out.write(content)
            yield pdf[["path"]]

    objects.select("path", "content").mapInPandas(write, "path string").write.format("noop").mode("overwrite").save()


def list_objects(spark: SparkSession, folder: str) -> DataFrame:
    """Ledger rows of every file below ``folder``; hidden names and the ledger itself are left out."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    base = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(root).toString()
    rel = N.relative_path(F.col("full_path"), F.lit(base))
    listed = (
        found.select(F.col("path").alias("full_path"), F.col("length").alias("size"))
        .withColumn("path", rel)
        .filter(~N.is_hidden(F.col("path")) & (F.col("path") != N.LEDGER_NAME))
    )
    hashed = spread(listed, "full_path").mapInPandas(_hash, "full_path string, size bigint, path string, sha256 string")
    return (
        hashed.withColumn("cls", N.object_class(F.col("path")))
        .withColumn("content_type", N.content_type(F.col("path")))
        .withColumn("cache_control", N.cache_control(F.col("cls")))
        .select(*COLUMNS)
    )


def site_objects(ledger: DataFrame) -> DataFrame:
    return ledger.filter(N.is_site_file(F.col("path")))
