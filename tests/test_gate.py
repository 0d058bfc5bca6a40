"""Sums over the span up to each row, against a plain sum; how they are planned."""

import random

from pyspark.sql import functions as F

from tallyloom.operators import turns as ops

SCHEMA = "k string, ts_ms long, v long"


def test_rolling_sum_equals_brute_force(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, *range(-25, 60)]), rng.choice([None, 0, 1, 5, -3, 2**40])) for _ in range(400)]
    got = ops.rolling_sum(spark.createDataFrame(rows, SCHEMA), ("k",), F.col("v"), "s", 10).collect()
    want = [(k, t, v, sum(w or 0 for j, u, w in rows if j == k and None not in (t, u) and t - 10 <= u <= t)) for k, t, v in rows]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_rolling_sum_keeps_a_running_total(spark):
    """A frame that begins at a row before would be summed anew for each row: the square of a bucket."""
    out = ops.rolling_sum(spark.createDataFrame([("a", 1, 1)], SCHEMA), ("k",), F.col("v"), "s", 10)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "RangeFrame" in plan and "unboundedpreceding" in plan and "RangeFrame, -" not in plan
