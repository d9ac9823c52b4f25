"""Percentiles by nearest rank against Spark's own, whose one task takes all distinct values."""

import pytest
from pyspark.sql import functions as F

from cardloom.operators import reads


@pytest.mark.parametrize("sql", ["cast(id * 7919 % 20011 as double) / 7", "double(id % 3)", "if(id % 2 = 0, null, exp(id % 700))", "cast(null as double)", "cast(id as decimal(12, 2))"])
def test_same_as_percentile_disc(spark, sql):
    t = spark.range(20000).selectExpr(f"{sql} as x")
    want = t.agg(*[F.expr(f"percentile_disc({p}) within group (order by x)").alias(f"p{r}") for r, p in ((50, 0.5), (95, 0.95), (99, 0.99))]).first()
    assert reads.nearest_rank(t, "x").first() == want


def test_no_task_gets_all_values(spark):
    plan = reads.nearest_rank(spark.range(20000).selectExpr("cast(id as double) as x"), "x")
    assert "percentile" not in plan._jdf.queryExecution().toString()
