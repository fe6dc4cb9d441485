"""Shuffles stay in small partitions, however few the cluster names."""

from carelake.session import WIDTH, tune


def test_a_shuffle_has_many_small_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for named, width in (("2", WIDTH), (str(WIDTH + 100), WIDTH + 100)):
            spark.conf.set("spark.sql.shuffle.partitions", named)
            plan = tune(spark).range(10).selectExpr("id % 3 as k").groupBy("k").count()._jdf.queryExecution().executedPlan().toString()
            assert "hashpartitioning(k#" in plan and f", {width})" in plan
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        tune(spark)
    assert spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes") == "16m"
