"""Session defaults and materialisation."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "panelweave", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators assume; on a cluster the submitter's settings win."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder for intermediate tables: the session's ``spark.checkpoint.dir``.

    Only a local session may fall back to a fresh temporary folder; executors of a
    cluster could not read one another's.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    made = tempfile.mkdtemp(prefix="panelweave-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def staging_dir(spark: SparkSession) -> str:
    """Where this application's staged tables are."""
    return f"{shared_dir(spark).rstrip('/')}/panelweave/{spark.sparkContext.applicationId}"


def clear(spark: SparkSession) -> None:
    """Deletes all staged tables of this application. Call it when no frame of the library will be read
    again: results that were not written elsewhere are lost, as they read staged tables."""
    path = spark._jvm.org.apache.hadoop.fs.Path(staging_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def wide_partitions(spark: SparkSession) -> int:
    """As many partitions as the session has cores or shuffles into, whichever is more: for few
    rows that cause much work, which adaptive execution would put into one task by their size."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` once as parquet in the shared folder and read it back.

    Cuts the lineage with data that outlives executors, costs one evaluation of the plan
    (``checkpoint`` costs two unless cached) and keeps column pruning for the readers.
    """
    spark = df.sparkSession
    path = f"{staging_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
