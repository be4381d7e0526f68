"""Session settings, and cuts in the lineage that outlive executors."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

#: UTC times; of equal map keys the last counts; plans adapt at run time.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share; where that isn't set and all is one process, one of our own."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="chromatid-")
    return at


def durable(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def measured(df: DataFrame) -> DataFrame:
    """durable(), and joined by merging: after a checkpoint Spark still takes a table for as large as the columns of the file that it came from, and would send millions of rows to the driver to broadcast them."""
    return durable(df).hint("merge")


#: Rows of a task of spread().
TASK_ROWS = 200_000


def spread(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """About so many rows, by their keys in tasks of TASK_ROWS: adaptive execution would put partitions together, down to a task a core, whose memory grows with the table. Fewer rows are left to it."""
    if rows <= TASK_ROWS * df.sparkSession.sparkContext.defaultParallelism:
        return df
    return df.repartition(-(-rows // TASK_ROWS), *keys)
