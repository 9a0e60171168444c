import os

from siftwork.plans.shared import CLEANUP, materialize, release, shared_dir


def test_tables_are_written_and_released(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")
    before = spark.conf.get(CLEANUP, None)
    df = materialize(spark.range(10).repartition(2).withColumnRenamed("id", "n"))
    assert df.columns == ["n"] and df.count() == 10 and os.path.isdir(df.shared_path) and df.shared_path.startswith(shared_dir(spark))
    assert spark.conf.get(CLEANUP, None) == before
    assert materialize(df.limit(0)).count() == 0
    release(df)
    assert not os.path.exists(df.shared_path)


def test_no_lineage(spark):
    df = materialize(spark.range(5).groupBy("id").count())
    assert "Aggregate" not in df._jdf.queryExecution().toString() and "Exchange" not in df._jdf.queryExecution().toString()


def test_costly_rows_of_one_file_are_dealt_out(spark, small):
    from siftwork.queries import QUERIES

    assert QUERIES["scalar_parses"](spark, small).rdd.getNumPartitions() > 4
