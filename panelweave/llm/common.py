"""Helpers of the training-data operators: passes over texts, staged tables, free column names."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructField, StructType

from panelweave.session import stage

#: Bytes of text that a Python worker unpacks at a time.
PIECE_BYTES = 1 << 20

#: Rows that Spark hands to a Python worker at a time, unless the session says otherwise: texts are long, and ten thousand of them, Spark's
#: own default, are held several times over outside the heap.
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
BATCH_ROWS = 2_000

#: Spark removes the shuffle files of a finished write when this is set; staged tables do not need them again.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def col(name: str):
    """A column by its literal name, dots included."""
    return F.col(f"`{name}`")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names that no column of ``df`` has, whatever the case: the wished ones, with underscores in front."""
    taken = {c.lower() for c in df.columns}
    found = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        found.append(name)
    return found


@contextmanager
def _cleanup(spark: SparkSession):
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def staged(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder and read back; its shuffle files go with the write."""
    with _cleanup(df.sparkSession):
        return stage(df)


def small_batches(spark: SparkSession) -> None:
    """Sets the session's rows per batch for texts where nobody has set them; the setting stays."""
    if spark.conf.get(BATCH, None) is None:
        spark.conf.set(BATCH, str(BATCH_ROWS))


def discard(df: DataFrame) -> None:
    """Deletes the files of a staged table that nothing will read again."""
    spark = df.sparkSession
    for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def pieces(batch: pa.RecordBatch, text: str, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of about ``limit`` bytes of text, without copies; a longer text is a slice of its own."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    start = 0
    while start < len(sizes):
        base = ends[start] - sizes[start]
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def map_texts(
    df: DataFrame,
    text: str,
    keep: Sequence[str],
    fields: Sequence[StructField],
    start: Callable[[], Callable[[list], Sequence[Sequence]]],
) -> DataFrame:
    """The columns ``keep`` and one new column per field, made from the texts in one narrow pass.

    ``start`` runs once per task and returns the function from a list of texts (None where null)
    to one sequence per field.
    """
    types = [to_arrow_type(f.dataType) for f in fields]
    names = [*keep, *(f.name for f in fields)]

    def run(batches):
        work = start()
        for batch in batches:
            for part in pieces(batch, text):
                made = work(part.column(text).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in keep), *(pa.array(v, t) for v, t in zip(made, types))], names=names
                )

    schema = StructType([*(df.schema[c] for c in keep), *fields])
    small_batches(df.sparkSession)
    return df.select(*(col(c) for c in dict.fromkeys([text, *keep]))).mapInArrow(run, schema)


def with_length(df: DataFrame, text: str, count: str = "n_chars") -> DataFrame:
    """Keeps the column that counts the characters of the text right, where there is one."""
    return df.withColumn(count, F.char_length(col(text)).cast(df.schema[count].dataType)) if count in df.columns else df
