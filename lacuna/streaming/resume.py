"""The incremental form of ``resume_unprocessed``: a folder of panels that keeps growing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def process_new_files(spark: SparkSession, folder: str, schema: StructType, work: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> None:
    """Each file of the folder is worked on once: runs over what is there, appends to ``out`` and stops.

    The checkpoint remembers the files; a rerun after a failure repeats an unfinished batch, and writes it under its own number.
    """

    def batch(df: DataFrame, number: int) -> None:
        work(df).write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream = spark.readStream.schema(schema).parquet(folder)
    stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
