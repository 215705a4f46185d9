"""Session defaults and the one way this package cuts lineage."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

#: Settings the operators are written for. Cluster sizes (executors, memory,
#: shuffle partitions) stay with the deployment.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(name: str = "starloom", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    if master is not None:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


#: Bytes of one batch between the JVM and Python. The default bounds its rows only, whatever their size.
BATCH_BYTES = 16 << 20


def bound_batches(spark: SparkSession) -> None:
    """For steps whose rows hold whole files or parts of files."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerOutputBatch", str(BATCH_BYTES))


def spread(df: DataFrame, *by) -> DataFrame:
    """Rows that name files, over all tasks: a partition count that is given is kept, where small rows would be joined into one task."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as named by ``spark.checkpoint.dir``.

    A local master without the setting gets a temporary folder, once; a cluster has to name one.
    """
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if not current.isEmpty():
        return current.get()
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        configured = tempfile.mkdtemp(prefix="spark-")
    sc.setCheckpointDir(configured)
    return sc._jsc.sc().getCheckpointDir().get()


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` to the reliable checkpoint folder and return it cut from its lineage.

    Used where a second step must see the very partitions the first one saw
    (prefix sums over a range-partitioned table) and between iterations.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint()
