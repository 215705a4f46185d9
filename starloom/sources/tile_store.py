"""The pyramid as Parquet: folders by band and level, files by supertile, tiles in row-major order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from starloom.functions import grid

#: Fixed value: bytes that a stored file may have at most.
FILE_CEILING = 512 * 1024 * 1024


def write_tiles(tiles: DataFrame, path: str, blocks: int = grid.SUPERTILE_BLOCKS) -> None:
    """Range-partitioned by band, level and supertile, so a supertile's tiles lie together and
    Parquet's min/max on tile_x, tile_y prune a box read to a few row groups."""
    keyed = tiles.withColumn("supertile_y", grid.supertile_origin(F.col("tile_y"), blocks)).withColumn(
        "supertile_x", grid.supertile_origin(F.col("tile_x"), blocks)
    )
    order = ["band", "z", "supertile_y", "supertile_x", "tile_y", "tile_x"]
    (
        keyed.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        # A full supertile per file at most: 48 x 48 tiles of 256 KiB stay near the object cap.
        .write.option("maxRecordsPerFile", blocks * blocks)
        .mode("overwrite")
        .partitionBy("band", "z")
        .parquet(path)
    )


def oversized_files(spark: SparkSession, path: str, ceiling: int = FILE_CEILING) -> DataFrame:
    """Violations: stored files of more bytes than ``ceiling``. Files are listed, not opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(path)
    return files.filter(F.col("length") > ceiling).select(F.col("path").alias("entity"), F.lit("file_size").alias("rule"), F.col("length").cast("string").alias("detail"))


def read_tiles(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("supertile_x", "supertile_y")


def read_window(spark: SparkSession, path: str, band: str, z: int, tx0: int, ty0: int, tx1: int, ty1: int) -> DataFrame:
    """Tiles of one level inside an inclusive tile rectangle: partitions and row groups are pruned."""
    return read_tiles(spark, path).filter(
        (F.col("band") == band) & (F.col("z") == z) & F.col("tile_x").between(tx0, tx1) & F.col("tile_y").between(ty0, ty1)
    )
