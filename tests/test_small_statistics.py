"""Medians and MADs of short arrays."""

from pyspark.sql import functions as F

from spanlake.operators.quantiles import small_mad, small_median


def test_small_statistics_name_their_array_once(spark):
    df = spark.createDataFrame([([3.0, 1.0, 10.0, 2.0],), ([5.0],), ([],), ([4.0, 4.0, 1.0],)], "v array<double>")
    out = df.select(small_median(F.col("v")).alias("m"), small_mad(F.col("v")).alias("d"))
    assert [tuple(r) for r in out.collect()] == [(2.5, 1.0), (5.0, 0.0), (0.0, 0.0), (4.0, 0.0)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("sort_array") + plan.count("array_sort") <= 4  # by expressions copied per use: more than 20
