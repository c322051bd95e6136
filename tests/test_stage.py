"""Tables written between steps: what was written and shuffled on the way does not stay."""

from pathlib import Path

from pyspark.sql import functions as F

from lacuna.sources import stage


def _files(folder, pattern):
    return {str(p) for p in Path(folder).rglob(pattern)}


def test_tables_written_on_the_way_are_removed(spark):
    own = Path(stage.shared_dir(spark).removeprefix("file://"), f"lacuna-{spark.sparkContext.applicationId}")
    before = _files(own, "*.parquet")

    def build():
        inner = stage.finished(spark, lambda: stage.materialize(spark.range(10)).withColumn("a", F.col("id") % 3))
        return stage.materialize(inner).groupBy("a").count()

    table = stage.finished(spark, build)
    assert sorted(map(tuple, table.collect())) == [(0, 4), (1, 3), (2, 3)]
    left = {p for p in _files(own, "*.parquet") - before}
    assert left and len({Path(p).parent for p in left}) == 1  # the table alone


def test_a_write_leaves_no_shuffle_files(spark):
    local = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()[0].getPath()
    before = _files(local, "shuffle_*")
    stage.materialize(spark.range(1000).groupBy(F.col("id") % 7).count())
    assert _files(local, "shuffle_*") <= before
    assert spark.conf.get(stage._CLEANUP) == "false"  # only for the write
