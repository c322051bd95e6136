"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that are worked on together inside a task (bounds the arrays made from them).
SLICE_BYTES = 1 << 21
#: Rows that Spark sends to a Python worker at a time (texts of some kilobytes: a few megabytes).
BATCH_ROWS = 2000
_BATCH_ROWS_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)
_KEPT: dict = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster (``spark.checkpoint.dir``); a temporary one only where Spark runs in one process."""
    sc = spark.sparkContext
    told = spark.conf.get("spark.checkpoint.dir", None)
    if told is None and not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(told or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return told or sc._jsc.sc().getCheckpointDir().get()


def materialize(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends there, a lost executor costs nothing.

    The tables of one application lie in one folder, so that they can be removed together when it has ended.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/lacuna-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the table does not have yet (names are compared without case)."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def held_out(doc_id: str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; a null id counts as the text ''."""
    text = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % parts == 2


def release() -> None:
    """Give memory that nothing uses back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def kept(name: Any, make: Callable[[], Any]) -> Any:
    """What the tasks of one operator keep in a Python worker.  Workers outlive tasks: another operator's things go first."""
    if name not in _KEPT:
        _KEPT.clear()
        release()
        _KEPT[name] = make()
    return _KEPT[name]


def mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``mapInArrow`` in batches of ``BATCH_ROWS`` at most; a task that ends gives its memory back."""
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(_BATCH_ROWS_SETTING)) <= BATCH_ROWS:
        conf.set(_BATCH_ROWS_SETTING, BATCH_ROWS)

    def tidy(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return df.mapInArrow(tidy, schema)


def texts(batch: pa.RecordBatch, column: str | int = "text") -> list[bytes]:
    """The texts of a batch as UTF-8; null counts as empty."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


def slices(sizes: list[int], limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose sizes sum to about ``limit`` (a longer row stands alone)."""
    start = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def parts(batch: pa.RecordBatch, column: str | int = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch a few rows at a time: texts of about ``limit`` bytes together (a longer one stands alone)."""
    for a, b in slices(pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_pylist(), limit):
        yield batch.slice(a, b - a)


def keyed(docs: DataFrame, name: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with a long column ``name`` that tells its rows apart and orders them as doc_id does.

    Where ids are unique and known it is the id.  Otherwise rows are put in order (by id, nulls last, then by
    a hash of the text) and numbered, each one a document of its own; that table is written once, so that
    the numbers hold.
    """
    ids = docs.select(F.col(doc_id).cast("long").alias("id"))
    odd = ids.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or id is null").limit(1).count()
    if not odd:
        return docs.withColumn(name, F.col(doc_id).cast("long"))
    order = docs.orderBy(F.col(doc_id).cast("long").asc_nulls_last(), F.xxhash64(text))
    return materialize(order.withColumn(name, F.monotonically_increasing_id()))
