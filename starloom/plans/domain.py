"""Domain tables derived from the driver tables, and the same rules as SQL text.

Every table is a rule over whole driver tables; nothing is invented or cut.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, functions as F

from starloom.operators import tiles as T

TILE = 16
BLOCKS = 2
ARCSEC = 2.0
ROLL_DEG = 10.0
CRVAL = (150.05, 2.25)


def num(x: float) -> str:
    """A double literal that no SQL dialect reads as a decimal."""
    text = repr(float(x))
    return text if "e" in text else text + "e0"


S = ARCSEC / 3600.0
COS, SIN = math.cos(math.radians(ROLL_DEG)), math.sin(math.radians(ROLL_DEG))
CD = (-S * COS, S * SIN, S * SIN, S * COS)


def read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


def band_name(i):
    return F.concat(F.lit("b"), (i % 3).cast("string"))


def image_rows(spark: SparkSession, sf: str) -> DataFrame:
    """band, img_h, img_w, y, values: vector i is row i div 3 of band i % 3, holes every 97th value."""
    e = read(spark, sf, "embeddings").select(
        band_name(F.col("vec_id")).alias("band"),
        F.floor(F.col("vec_id") / 3).cast("int").alias("y"),
        F.transform(
            "embedding",
            lambda v, i: F.when((F.col("vec_id") * 64 + i) % 97 == 0, F.lit(float("nan")).cast("float")).otherwise(v),
        ).alias("values"),
    )
    # Three rows, whatever the size of the images.
    dims = e.groupBy("band").agg((F.max("y") + 1).alias("img_h"), F.max(F.size("values")).alias("img_w"))
    return e.join(F.broadcast(dims), "band")


def dims(spark: SparkSession, sf: str) -> DataFrame:
    e = read(spark, sf, "embeddings")
    return e.groupBy(band_name(F.col("vec_id")).alias("band")).agg(
        (F.floor(F.max("vec_id") / 3) + 1).cast("int").alias("img_h"),
        F.max(F.size("embedding")).alias("img_w"),
    )


def pixels(spark: SparkSession, sf: str) -> DataFrame:
    return image_rows(spark, sf).select(
        "band", F.lit(0).alias("z"), "y", F.posexplode("values").alias("x", "v")
    )


def native_tiles(spark: SparkSession, sf: str) -> DataFrame:
    return T.tiles_from_rows(image_rows(spark, sf), TILE)


PIXELS_SQL = """pixels AS (
  SELECT 'b' || (vec_id % 3) AS band, vec_id // 3 AS y, x,
         CASE WHEN (vec_id * 64 + x) % 97 = 0 THEN 'NaN'::FLOAT ELSE v END AS v
  FROM (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS x FROM embeddings)
), dims AS (
  SELECT band, max(y) + 1 AS img_h, max(x) + 1 AS img_w FROM pixels GROUP BY band
)"""

LEVELS_SQL = f"""levels AS (
  SELECT band, img_h, img_w, z,
         (img_h // (2 ** z)::BIGINT) AS h, (img_w // (2 ** z)::BIGINT) AS w,
         ((img_h // (2 ** z)::BIGINT) + {TILE - 1}) // {TILE} AS n_ty,
         ((img_w // (2 ** z)::BIGINT) + {TILE - 1}) // {TILE} AS n_tx
  FROM (SELECT *, unnest(range(0, greatest(0, ceil(log2(greatest(img_h, img_w) / {TILE}.0)))::BIGINT + 1)) AS z FROM dims)
)"""


def with_levels_sql(*more: str) -> str:
    return "WITH " + ",\n".join([PIXELS_SQL, LEVELS_SQL, *more])


def with_wcs(df: DataFrame) -> DataFrame:
    """Native projection of the test bands: reference pixel at the image centre, rolled 10 degrees."""
    out = df.withColumn("crpix1", (F.col("img_w") + 1) / F.lit(2.0)).withColumn("crpix2", (F.col("img_h") + 1) / F.lit(2.0))
    out = out.withColumn("crval1", F.lit(CRVAL[0])).withColumn("crval2", F.lit(CRVAL[1]))
    for name, v in zip(("cd11", "cd12", "cd21", "cd22"), CD):
        out = out.withColumn(name, F.lit(v))
    return out.withColumn("lonpole", F.lit(180.0))


def level_wcs(spark: SparkSession, sf: str) -> DataFrame:
    """Levels of every band with their projections and scales."""
    from starloom.operators import pyramid as P

    return P.level_wcs(with_wcs(P.level_table(dims(spark, sf), TILE)))
