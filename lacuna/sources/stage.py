"""Tables that are written once and read again: a lineage ends there, and later steps scan instead of recomputing."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_DERIVED: dict[tuple, str] = {}
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Where ``materialize`` writes now: below a folder that goes when the table made of its tables has been written, or the application's.
_SCRATCH: ContextVar[str | None] = ContextVar("scratch", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``); a temporary one only where Spark runs in one process."""
    got = spark.conf.get("spark.checkpoint.dir", None)
    if got:
        return got.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    key = (spark.sparkContext.applicationId, "shared")
    if key not in _DERIVED:
        _DERIVED[key] = tempfile.mkdtemp(prefix="spark-checkpoint-")
    return _DERIVED[key]


@contextlib.contextmanager
def _shuffles_removed(spark: SparkSession):
    """What a write inside has shuffled goes from the disks when it ends, not when the driver next collects its garbage: the table is read from then on."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def _own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/lacuna-{spark.sparkContext.applicationId}"


def materialize(df: DataFrame) -> DataFrame:
    path = f"{_SCRATCH.get() or _own_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    with _shuffles_removed(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _written(spark: SparkSession, build: Callable[[], DataFrame], path: str) -> None:
    """What ``build`` returns as a table; those that it wrote on the way are removed then."""
    folder = f"{_own_dir(spark)}/scratch-{uuid.uuid4().hex}"
    outer = _SCRATCH.set(folder)
    try:
        table = build()
    finally:
        _SCRATCH.reset(outer)
    with _shuffles_removed(spark):
        table.write.parquet(path)
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def finished(spark: SparkSession, build: Callable[[], DataFrame]) -> DataFrame:
    """``materialize`` of what ``build`` returns, without the tables that it wrote on the way: nothing else may read those."""
    path = f"{_SCRATCH.get() or _own_dir(spark)}/{uuid.uuid4().hex}"
    _written(spark, build, path)
    return spark.read.parquet(path)


def derived(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A table that Spark derives from the given ones, written once for each application."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _DERIVED:
        path = f"{_own_dir(spark)}/{name}-{uuid.uuid4().hex}"
        _written(spark, build, path)
        _DERIVED[key] = path
    return spark.read.parquet(_DERIVED[key])
