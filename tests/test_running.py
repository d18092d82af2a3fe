"""Running values over one long group."""

import re

from pyspark.sql import functions as F

from tidewire.plans.running import running_total


def test_running_total_splits_a_long_group(spark):
    df = spark.range(10_000).select(F.when(F.col("id") >= 0, "hot").alias("k"), F.col("id").alias("o"), F.lit(1).alias("v"))
    totals = running_total(df, ["k"], "o", F.floor(F.col("o") / 500), "v", "t")
    assert totals.filter("t <> o + 1").count() == 0
    plan = totals._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"windowspecdefinition\(k#\d+, __block#", plan)
