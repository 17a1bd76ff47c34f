"""Counted theta joins, sketches by day, table functions and tables kept up to date, against plain Python."""

import datetime as dt
import operator
import random
from itertools import product

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from quern.functions import tables
from quern.operators import ranking, sketches, theta
from quern.session import clear_shared, landed, shared_dir
from quern.sources import files

OPS = {"<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}


def pairs(rng, n):
    value = lambda: rng.choice([rng.randrange(6), rng.uniform(-3, 9), None if rng.random() < 0.1 else 2])
    number = lambda v: None if v is None else float(v)
    return [(number(value()), number(value())) for _ in range(n)]


@pytest.mark.parametrize(("one", "two"), [("<", ">"), ("<=", "<="), (">", ">="), (">=", "<")])
def test_theta_counts(spark, one, two):
    rng = random.Random(one + two)
    left, right = [(k % 70, *p) for k, p in enumerate(pairs(rng, 90))], pairs(rng, 130)
    got = theta.theta_counts(spark.createDataFrame(left, "id int, a double, b double").repartition(3), spark.createDataFrame(right, "c double, d double"), ("a", one, "c"), ("b", two, "d"))
    assert got.columns == ["id", "a", "b", "n_matches"]
    fits = lambda op, x, y: x is not None and y is not None and OPS[op](x, y)
    want = [(i, a, b, sum(fits(one, a, c) and fits(two, b, d) for c, d in right)) for i, a, b in left]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_theta_counts_of_nothing(spark):
    none, some = spark.createDataFrame([], "a double, b double"), spark.createDataFrame([(1.0, 2.0)], "c double, d double")
    assert theta.theta_counts(none, some, ("a", "<", "c"), ("b", "<", "d")).count() == 0
    empty = theta.theta_counts(some, none, ("c", "<", "a"), ("d", "<", "b")).collect()
    assert [r.n_matches for r in empty] == [0]


def test_theta_counts_spread_a_hot_value(spark):
    """All left rows are equal: their nodes are the same, but slices and levels deal the right side."""
    left, right = spark.range(500).select(F.lit(0.0).alias("a"), F.lit(5e3).alias("b")), spark.range(9000).select((F.col("id") - 100.0).alias("c"), F.col("id").cast("double").alias("d"))
    assert {r.n_matches for r in theta.theta_counts(left, right, ("a", "<", "c"), ("b", ">", "d")).collect()} == {4899}


def test_ranked(spark):
    df = spark.range(0, 3000, 1, 5).select((F.col("id") * 7919 % 3000).alias("v"))
    assert all(r.v == r.place for r in ranking.ranked(df, [F.col("v")], "place").collect())


def test_sketches(spark):
    rng = random.Random(5)
    rows = [(dt.datetime(2024, 1, 1 + rng.randrange(10), 5), rng.choice("ab"), rng.randrange(3000), rng.gauss(0, 1)) for _ in range(20_000)] + [(dt.datetime(2024, 1, 3), "c", None, None), (None, "a", 1, 1.0)]
    events, path = spark.createDataFrame(rows, "ts timestamp, kind string, user long, value double"), shared_dir(spark, "sketches")
    for first, last in ((1, 6), (4, 10), (4, 10)):
        sketches.keep(sketches.sketched(events.filter(F.dayofmonth("ts").between(first, last)), "ts", ["kind"], "user", "value"), path)
    for first, last in ((1, 10), (3, 3), (5, 8)):
        got = {r.kind: r for r in sketches.merged(spark, path, ["kind"], f"2024-01-{first:02}", f"2024-01-{last:02}", [0.0, 0.25, 0.9]).collect()}
        own = [r for r in rows if r[0] is not None and first <= r[0].day <= last]
        assert set(got) == {r[1] for r in own}
        for kind, r in got.items():
            users, values = {x[2] for x in own if x[1] == kind and x[2] is not None}, sorted(x[3] for x in own if x[1] == kind and x[3] is not None)
            assert r.n == sum(x[1] == kind for x in own) and abs(r.distinct - len(users)) <= sketches.DISTINCT_ERROR * len(users) + 1
            if not values:
                assert r.quantiles is None and r.low is None
                continue
            assert (r.low, r.high) == (values[0], values[-1])
            for q, v in zip((0.25, 0.9), r.quantiles[1:]):
                assert abs(sum(x <= v for x in values) / len(values) - q) <= sketches.RANK_ERROR + 1 / len(values)
    plan = sketches.merged(spark, path, ["kind"], "2024-01-03", "2024-01-04", [0.5])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan


def test_dialogue(spark):
    tables.register(spark)
    rows = [(c, t, random.Random(c * 9 + t).choice(["user", "bot", "tool", None]), None if t % 5 == 4 else "x" * t) for c, t in product(range(12), range(9))] + [(None, 0, "user", "ab"), (50, 2, "bot", "")]
    random.Random(1).shuffle(rows)
    spark.createDataFrame(rows, "c int, t int, role string, text string").repartition(5).createOrReplaceTempView("turns_here")
    got = spark.sql("SELECT * FROM quern_dialogue(table => TABLE(turns_here), conversation => 'c', place => 't', roles => 'bot,user')")
    assert got.columns == ["c", "n_turns", "n_switches", "bot_turns", "bot_chars", "bot_last", "user_turns", "user_chars", "user_last"]
    want = []
    for c in {r[0] for r in rows}:
        own = sorted((r[1:] for r in rows if r[0] == c), key=lambda r: r[0])
        line = [c, len(own), sum(a[1] != b[1] for a, b in zip(own, own[1:]))]
        for role in ("bot", "user"):
            texts = [x[2] for x in own if x[1] == role]
            line += [len(texts), sum(len(x or "") for x in texts), texts[-1] if texts else None]
        want.append(tuple(line))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    one = spark.sql("SELECT * FROM quern_dialogue(table => TABLE(turns_here), conversation => 'c', place => 't', roles => 'tool')")
    assert one.columns[3:] == ["tool_turns", "tool_chars", "tool_last"] and one.count() == len(want)
    with pytest.raises(AnalysisException, match="lacks"):
        spark.sql("SELECT * FROM quern_dialogue(table => TABLE(turns_here), conversation => 'nope', place => 't', roles => 'bot')")


SCHEMA = "k int, part int, v string, version int"


def test_upsert(spark):
    path = shared_dir(spark, "kept")
    load = lambda rows: files.upsert(spark.createDataFrame(rows, SCHEMA), path, ["k"], "part", "version")
    rows = lambda: sorted((r.k, r.part, r.v, r.version) for r in files.existing(spark, path, spark.createDataFrame([], SCHEMA).schema).collect())
    load([(1, 1, "a", 1), (2, 1, "b", 1), (3, 2, "c", 5), (3, 2, "c", 5), (4, 3, "d", None)])
    assert rows() == [(1, 1, "a", 1), (2, 1, "b", 1), (3, 2, "c", 5), (4, 3, "d", None)]
    second = [(2, 1, "B", 2), (3, 2, "old", 4), (9, 9, "new", 1), (4, 3, "D", None)]
    want = [(1, 1, "a", 1), (2, 1, "B", 2), (3, 2, "c", 5), (4, 3, "D", None), (9, 9, "new", 1)]
    for _ in range(2):
        load(second)
        assert rows() == want
    load([])
    assert rows() == want


def test_upsert_reads_touched_folders_only(spark):
    path = shared_dir(spark, "kept")
    files.upsert(spark.range(100).select(F.col("id").alias("k"), (F.col("id") % 10).alias("part"), F.lit(1).alias("version")), path, ["k"], "part", "version")
    new = landed(spark.range(3, 4).select(F.col("id").alias("k"), F.col("id").alias("part"), F.lit(2).alias("version")), "new")
    old = files.in_folders_of(files.existing(spark, path, new.schema), new, "part")
    assert "dynamicpruning" in old._jdf.queryExecution().executedPlan().toString()
    assert old.count() == 10


def test_bucketed_tables_go(spark):
    before = {t.name for t in spark.catalog.listTables()}
    made = files.write_bucketed(spark.range(10).select("id"), shared_dir(spark, "bucketed"), "id", 2)
    assert made.count() == 10 and {t.name for t in spark.catalog.listTables()} > before
    clear_shared(spark)
    assert not any(t.name.startswith("bucketed_") for t in spark.catalog.listTables())


def test_theta_counts_in_slices(spark, monkeypatch):
    """Over many slices, with values that repeat; the rows that are written on the way stay a few times those of the tables."""
    monkeypatch.setattr(theta, "SLICE", 40, raising=False)
    written, landed = [], theta.landed
    monkeypatch.setattr(theta, "landed", lambda df, name: written.append(landed(df, name)) or written[-1])
    rng = random.Random(5)
    left = [(k, float(rng.choice([1, 1, rng.randrange(60)])), float(rng.randrange(30))) for k in range(600)]
    right = [(float(rng.choice([1, 1, rng.randrange(60)])), float(rng.randrange(30))) for _ in range(900)]
    for one, two in (("<", ">="), ("<=", ">"), (">", "<=")):
        written.clear()
        holds = {"<": lambda u, v: u < v, "<=": lambda u, v: u <= v, ">": lambda u, v: u > v, ">=": lambda u, v: u >= v}
        want = {k: sum(holds[one](a, c) and holds[two](b, d) for c, d in right) for k, a, b in left}
        got = theta.theta_counts(spark.createDataFrame(left, "id int, a double, b double"), spark.createDataFrame(right, "c double, d double").repartition(3), ("a", one, "c"), ("b", two, "d"))
        assert {r.id: r.n_matches for r in got.collect()} == want
        assert sum(df.count() for df in written) <= 5 * (len(left) + len(right))
