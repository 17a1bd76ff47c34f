"""What the operators share."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from quern.llm import simhash
from quern.llm.common import join_small, written


@pytest.mark.parametrize("how", ["inner", "left"])
def test_a_side_past_the_bound_is_never_broadcast(spark, how):
    """Its rows are repeated once per salt, which Spark's estimate of its size doesn't know."""
    big = written(spark.range(600).select(F.when(F.col("id") % 7 > 0, F.col("id") % 3 * 50).alias("key"), F.col("id").alias("x")), "big")
    small = written(spark.range(120).select(F.when(F.col("id") > 0, F.col("id")).alias("key"), (F.col("id") * 10).alias("y")), "small")
    joined = join_small(big, small, "key", bound=100, how=how)
    rows = joined.select("key", "x", "y").collect()
    keys = [(k % 3 * 50 if k % 7 else None, k) for k in range(600)]
    assert Counter(map(tuple, rows)) == Counter((k, x, {None: 0, 0: None}.get(k, 10 * (k or 0))) for k, x in keys if how == "left" or k != 0)  # 0 has no row on the right
    for right in (small, small.limit(90)):
        plan = join_small(big, right, "key", bound=100, how=how)._jdf.queryExecution().executedPlan().toString()
        assert ("BroadcastHashJoin" in plan) == (right is not small)


def test_survivors_are_never_broadcast(spark):
    """Their ids take little room in a file, so Spark would broadcast far more than it counts."""
    docs = written(spark.range(200).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id") % 50).alias("text")), "docs")
    found = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.xxhash64("text").alias("root"))
    kept = simhash.first_of_each(docs, found)
    assert sorted(r.doc_id for r in kept.collect()) == list(range(50))
    assert "BroadcastHashJoin" not in kept._jdf.queryExecution().executedPlan().toString()
