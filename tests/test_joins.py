"""Range and interval joins, as-of slices of numbers, and hierarchies, against brute force."""

import datetime as dt
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quern.operators import evidence, hierarchy, joins


@pytest.mark.parametrize("seed", range(3))
def test_covers(spark, seed):
    """Nodes are apart, make up the interval, and are few."""
    rng = random.Random(seed)
    spans = [(a := rng.randrange(-(10**rng.randrange(1, 13)), 10**12), a + rng.randrange(1, 10 ** rng.randrange(1, 12))) for _ in range(200)] + [(0, 1), (-1, 0), (-8, 8), (3, 17), (-(2**40), 2**40)]
    for r in spark.createDataFrame(spans, "a long, b long").select("a", "b", joins.cover(F.col("a"), F.col("b")).alias("nodes")).collect():
        parts = sorted((n.node << n.level, (n.node + 1) << n.level) for n in r.nodes)
        assert parts[0][0] == r.a and parts[-1][1] == r.b and all(x[1] == y[0] for x, y in zip(parts, parts[1:]))
        assert len(parts) <= 2 * (r.b - r.a).bit_length()


def spans(rng, n):
    out = []
    for k in range(n):
        a = rng.choice([rng.uniform(-50, 50), float(rng.randrange(-20, 20))])
        out.append((k, rng.choice("xxy"), a, a + rng.choice([0.0, 1.0, rng.uniform(0, 3), 10.0 ** rng.randrange(-3, 6), -1.0])))
    return out + [(n, "x", None, 1.0), (n + 1, None, 0.0, 1.0), (n + 2, "x", 0.0, None)]


@pytest.mark.parametrize("width", [0.01, 1.0, 1000.0])
@pytest.mark.parametrize("by", [None, "k"])
def test_intervals(spark, width, by):
    rng = random.Random(7)
    one, other = spans(rng, 80), spans(rng, 70)
    left = spark.createDataFrame(one, "l int, k string, a double, b double")
    right = spark.createDataFrame(other, f"r int, {'k' if by else 'rk'} string, c double, d double")
    some = lambda *x: all(v is not None for v in x)
    want = [(l, r) for l, k, a, b in one for r, j, c, d in other if some(a, b, c, d) and a < b and c < d and a < d and c < b and (by is None or (k == j and k is not None))]
    got = joins.interval_join(left, right, ("a", "b"), ("c", "d"), width, by)
    assert sorted((x.l, x.r) for x in got.select("l", "r").collect()) == sorted(want) and len(want) > 200
    with pytest.raises(ValueError, match="both sides"):
        joins.interval_join(left, left, ("a", "b"), ("a", "b"), width)


def test_times_from_a_second_to_a_year(spark):
    t = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    rng = random.Random(2)
    rows = [(k, s := rng.randrange(10**7), s + 10 ** rng.randrange(8)) for k in range(150)]
    make = lambda p: spark.createDataFrame([(k, t(a), t(b)) for k, a, b in rows], f"{p} int, {p}a timestamp_ntz, {p}b timestamp_ntz")
    got = joins.interval_join(make("x"), make("y"), ("xa", "xb"), ("ya", "yb"), 1.0)
    assert sorted(tuple(r) for r in got.select("x", "y").collect()) == sorted((k, m) for k, a, b in rows for m, c, d in rows if a < d and c < b)


def test_long_intervals_do_not_explode(spark):
    """A year in seconds is a few dozen rows, and 10,000 intervals of one key spread over tasks."""
    ids = spark.range(10_000).withColumn("k", F.lit("hot"))
    long_ = ids.select("k", F.col("id").alias("l"), F.col("id").cast("double").alias("a"), (F.col("id") + 31_536_000).cast("double").alias("b"))
    nodes = long_.withColumn("n", F.explode(joins.cover(F.col("a").cast("long"), F.col("b").cast("long"))))
    assert nodes.count() < 10_000 * 50
    points = ids.select("k", F.col("id").alias("p"), (F.col("id") * 3000 - 5.0).alias("at")).filter("p % 100 = 0")
    joined = joins.range_join(points, long_, "at", "a", "b", 1.0, "k")
    want = sum(max(0, min(10_000, 3000 * p - 4) - max(0, 3000 * p - 5 - 31_536_000)) for p in range(0, 10_000, 100))
    assert joined.count() == want
    assert nodes.groupBy(F.pmod(F.xxhash64("k", "n"), F.lit(50)).alias("task")).count().agg(F.max("count")).first()[0] < 10_000 * 5


@pytest.mark.parametrize("kind", ["long", "double"])
def test_asof_slices_numbers(spark, kind):
    rng = random.Random(3)
    left = [(k, rng.choice("hhha"), rng.randrange(2000)) for k in range(300)] + [(900, "h", None), (901, None, 5), (902, "h", -1)]
    right = [(rng.choice("hhhb"), rng.randrange(2000), k) for k in range(1500)] + [(None, 1, 7), ("h", None, 3)]
    cast = lambda df, c: df.withColumn(c, F.col(c).cast(kind))
    got = joins.asof_join(cast(spark.createDataFrame(left, "id int, k string, at long"), "at"), cast(spark.createDataFrame(right, "k string, at long, v int"), "at"), "k", "at", ["v"])
    last = lambda k, t: max(((at, v) for j, at, v in right if j == k and at is not None and t is not None and at <= t), default=(0, None))[1]
    assert sorted(((r.id, r.v) for r in got.collect()), key=str) == sorted(((i, last(k, t)) for i, k, t in left), key=str)
    assert "_slice" in got._jdf.queryExecution().executedPlan().toString()


def test_a_chain_of_ten_thousand(spark):
    links = spark.range(10_000).select("id", F.when(F.col("id") > 0, F.col("id") - 1).alias("parent"))
    got = hierarchy.climb(links.repartition(4))
    assert got.filter("top <> 0 OR depth <> id OR looped").count() == 0 and got.count() == 10_000
    named = links.select(F.col("id").alias("direction_id"), F.col("parent").alias("parent_id"), F.concat(F.lit("d"), "id").alias("name"))
    below = evidence.directions_under(named, "d4000")
    assert below.count() == 6000 and below.agg(F.max("depth")).first()[0] == 5999


def test_circles_and_odd_parents(spark):
    rows = [(1, None), (2, 1), (3, 99), (4, 4), (5, 6), (6, 7), (7, 5), (8, 7), (9, 2), (10, 11), (11, 10), *((100 + k, 1) for k in range(300))]
    got = {r.id: (r.top, r.depth, r.looped) for r in hierarchy.climb(spark.createDataFrame(rows, "id long, parent long")).collect()}
    circle = (None, None, True)
    assert got == {1: (1, 0, False), 2: (1, 1, False), 3: (3, 0, False), 9: (1, 2, False)} | {k: circle for k in (4, 5, 6, 7, 8, 10, 11)} | {100 + k: (1, 1, False) for k in range(300)}
    below = hierarchy.below(spark.createDataFrame(rows, "id long, parent long"), spark.createDataFrame([(2,), (1,), (5,), (77,)], "id long"))
    found = {r.id: (r.top, r.depth) for r in below.collect()}
    assert found[9] == (2, 1) and found[2] == (2, 0) and found[100] == (1, 1) and found[8] == (5, 2) and found[7] == (5, 1) and found[6] == (5, 2) and 4 not in found
    assert hierarchy.climb(spark.createDataFrame([], "id long, parent long")).count() == 0


def test_range_join_deals_pairs(spark, monkeypatch):
    """Points in one granule, met by all intervals: no task makes more than a small share of the pairs, and each pair is there once."""
    monkeypatch.setattr(joins, "PAIRS", 1000, raising=False)
    points = spark.createDataFrame([(k, 10 + k / 1000) for k in range(400)], "p long, at double").coalesce(1)
    spans = spark.createDataFrame([(k, 9.0, 11.0 + k) for k in range(100)], "s long, lo double, hi double").coalesce(1)
    found = joins.range_join(points, spans, "at", "lo", "hi", 50.0).select("p", "s", F.spark_partition_id().alias("task")).collect()
    assert sorted((r.p, r.s) for r in found) == [(p, s) for p in range(400) for s in range(100)]
    shares = Counter(r.task for r in found)
    assert max(shares.values()) <= len(found) / 5


def test_range_join_cuts_both_sides(spark, monkeypatch):
    """More intervals meet one point than a part may have."""
    monkeypatch.setattr(joins, "PAIRS", 10, raising=False)
    spans = spark.createDataFrame([(k, 0.0, 5.0) for k in range(300)], "s long, lo double, hi double")
    found = joins.range_join(spark.createDataFrame([(1, 1.0), (2, None), (3, 5.0)], "p long, at double"), spans, "at", "lo", "hi", 50.0).select("p", "s").collect()
    assert sorted(map(tuple, found)) == [(1, k) for k in range(300)]
