"""Model tables on disk: parameters, weights, indicators and configuration under one folder.

A save writes a folder of its own and then appends one row that names it; a reader follows the last
row. So a save may read from the model it replaces, and a broken one changes nothing.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

FORMAT_VERSION = 2
ROW = "save bigint, folder string, config string"


def save_tables(path: str, tables: dict[str, DataFrame | None], config: dict) -> None:
    """The tables as parquet in a new folder, then the row that publishes them."""
    root, folder = path.rstrip("/"), uuid.uuid4().hex
    written = {name: df for name, df in tables.items() if df is not None}
    for name, df in written.items():
        df.write.parquet(f"{root}/tables/{folder}/{name}")
    spark = next(iter(written.values())).sparkSession
    text = json.dumps({"version": FORMAT_VERSION, "tables": sorted(written), **config})
    last = _last(spark, root)
    number = 1 + last["save"] if last else 1
    spark.createDataFrame([(number, folder, text)], ROW).coalesce(1).write.mode("append").parquet(f"{root}/saves")


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def _last(spark: SparkSession, root: str):
    if not _exists(spark, f"{root}/saves"):
        return None
    return spark.read.schema(ROW).parquet(f"{root}/saves").orderBy(F.desc("save"), F.desc("folder")).first()


def load_tables(spark: SparkSession, path: str) -> tuple[dict[str, DataFrame], dict]:
    root = path.rstrip("/")
    last = _last(spark, root)
    if last is None:
        raise ValueError(f"no saved model in {path}")
    config = json.loads(last["config"])
    if config.pop("version") != FORMAT_VERSION:
        raise ValueError("saved by an unknown version")
    return {name: spark.read.parquet(f"{root}/tables/{last['folder']}/{name}") for name in config.pop("tables")}, config
