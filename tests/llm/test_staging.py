import os

from pyspark.sql import functions as F

from tidemark.llm.common import CLEANUP, Scratch, staged


def test_shuffle_files_go_with_the_write(spark):
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    held = lambda: set(blocks.getAllFiles().mkString("\n").split("\n"))
    before, had = held(), spark.conf.get(CLEANUP, None)
    with Scratch(spark):
        t = staged(spark.range(10_000).repartition(7).groupBy((F.col("id") % 10).alias("k")).count(), "cleanup")
        new = {os.path.basename(f) for f in held() - before}
        assert not [f for f in new if f.startswith("shuffle")], new
        assert t.count() == 10
    assert spark.conf.get(CLEANUP, None) == had
