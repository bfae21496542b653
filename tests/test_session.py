from types import SimpleNamespace

from pyspark.sql import functions as F

from koewake import session


def test_spread(spark):
    cores = spark.sparkContext.defaultParallelism
    small, shuffled = spark.range(100).coalesce(1), spark.range(100).groupBy((F.col("id") % 3).alias("k")).count()
    assert session.spread(small).rdd.getNumPartitions() == cores and session.spread(small).count() == 100
    assert session.spread(shuffled) is shuffled


def test_written_tables_are_under_the_shared_folder(spark, tmp_path):
    df = session.materialise(spark.range(3), "x")
    assert df.count() == 3 and all(f.replace("file://", "").startswith(session.scratch(spark).replace("file://", "")) for f in df.inputFiles())
    cluster = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: f"{tmp_path}/" if k == "spark.checkpoint.dir" else d))
    assert session.scratch(cluster) == str(tmp_path)
