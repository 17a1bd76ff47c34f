from collections import Counter

import pytest

from quern.llm import sharding


def slow_table(shards, size):
    """The rule read literally: each shard's permutation in full, and turns that walk it."""
    order = []
    for s in shards:
        offset, skip = sharding._hash(f"offset:{s}") % size, sharding._hash(f"skip:{s}") % (size - 1) + 1
        order.append([(offset + j * skip) % size for j in range(size)])
    owner, turn = {}, 0
    while len(owner) < size:
        i = turn % len(shards)
        owner[next(s for s in order[i] if s not in owner)] = i
        turn += 1
    return [owner[s] for s in range(size)]


@pytest.mark.parametrize(("n", "size"), [(1, 2), (3, 7), (5, 101), (8, 257)])
def test_table_is_filled_by_turns(n, size):
    shards = [f"s{i}" for i in range(n)]
    table = sharding.lookup_table(shards, size)
    assert table == slow_table(shards, size)
    counts = Counter(table)
    assert max(counts.values()) - min(counts.values()) <= 1


def test_losing_a_shard_moves_few_other_slots():
    shards = [f"s{i}" for i in range(10)]
    before, after = sharding.lookup_table(shards, 2003), sharding.lookup_table(shards[:-1], 2003)
    moved = sum(a != b for a, b in zip(before, after) if a != 9)
    assert moved < 0.2 * 2003


@pytest.mark.parametrize(("shards", "size"), [([], 7), (["a", "a"], 7), (["a"], 8), (["a", "b", "c"], 2)])
def test_bad_tables(shards, size):
    with pytest.raises(ValueError):
        sharding.lookup_table(shards, size)


def test_every_row_is_placed(spark, odd_docs, no_docs, tmp_path):
    placed = sharding.assign(odd_docs, ["doc_id"], ["x", "y", "z"], 101)
    rows = placed.select("row.doc_id", "row.shard", placed["shard"].alias("s"), "slot").collect()
    assert len(rows) == odd_docs.count() and {r.shard for r in rows} == {7}
    by_id = {}
    table = sharding.lookup_table(["x", "y", "z"], 101)
    for r in rows:
        assert by_id.setdefault(r.doc_id, r.s) == r.s == table[r.slot]
        assert r.slot == int(__import__("hashlib").md5(str("" if r.doc_id is None else r.doc_id).encode()).hexdigest()[:15], 16) % 101
    assert sharding.assign(no_docs, ["doc_id"], ["x"], 7).count() == 0
    docs = odd_docs.select("doc_id", "text")
    sharding.write_shards(sharding.assign(docs, ["doc_id"], ["x", "y", "z"], 101), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == docs.count()


def test_equal_rows_get_all_salts(spark):
    from pyspark.sql import functions as F

    from quern.llm.common import join_small, salt, written

    equal = written(spark.range(10_000).select(F.lit("hot").alias("key"), F.lit(1).alias("v")), "equal")
    per_salt = [r["count"] for r in equal.groupBy(salt(32).alias("s")).count().collect()]
    assert len(per_salt) == 32 and max(per_salt) < 2 * min(per_salt)
    small = written(spark.createDataFrame([("hot", 5)], "key string, w int"), "small")
    assert join_small(equal, small, "key", bound=0).filter("w = 5").count() == 10_000


def test_equal_rows_fill_all_files(spark, tmp_path):
    rows = spark.range(8000).selectExpr("1L AS doc_id", "map('a', 1) AS m")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    sharding.write_shards(sharding.assign(rows, ["doc_id"], ["one", "two"], 7), str(tmp_path / "out"), 16)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = [r["count"] for r in spark.read.parquet(str(tmp_path / "out")).selectExpr("input_file_name() AS f").groupBy("f").count().collect()]
    assert len(sizes) >= 3 and sum(sizes) == 8000 and max(sizes) < 6000
