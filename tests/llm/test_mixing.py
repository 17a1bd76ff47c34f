import hashlib
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quern.llm import common, mixing
from quern.session import table
from tests.conftest import DATA


def slow_targets(sizes):
    """The rule read literally: share by weight, cap, share the excess again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    capped, total = set(), sum(sizes.values())
    while True:
        rest = total - sum(3 * sizes[s] for s in capped)
        left = sum(weight[s] for s in names if s not in capped)
        target = {s: 3.0 * sizes[s] if s in capped else rest * weight[s] / left for s in names}
        above = {s for s in names if s not in capped and target[s] > 3 * sizes[s]}
        if not above:
            return target
        capped |= above


@pytest.mark.parametrize(
    "sizes",
    [{"a": 100, "b": 100, "c": 100, None: 7}, {"a": 1, "b": 1000, "é": 5, "z": 0}, {"only": 10}, {"a": 0, "b": 0}, {f"s{i:02d}": i * i for i in range(40)}],
)
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    found = {r.source: r.target for r in mixing.source_targets(df).collect()}
    assert found == pytest.approx(slow_targets(sizes) if sum(sizes.values()) else dict.fromkeys(sizes, 0.0))
    assert all(found[s] <= 3 * n + 1e-9 for s, n in sizes.items())


def slow_copies(rows):
    """How often the mix takes (doc_id, text, source) rows, by the rule read literally: whole copies, and one more for those of a source's documents, in the
    order of their coins, whose middle lies below the words still wanted."""
    size = lambda text: len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    sizes = defaultdict(int)
    for _, text, source in rows:
        sizes[source] += size(text)
    targets = slow_targets(dict(sizes)) if sum(sizes.values()) else dict.fromkeys(sizes, 0.0)
    out = []
    for source in sizes:
        whole = int(min(3.0, targets[source] / sizes[source])) if sizes[source] else 0
        wanted, before = targets[source] - whole * sizes[source], 0
        coined = [(hashlib.md5(f"{mixing.SEED}:{'' if i is None else i}:{t or ''}".encode()).hexdigest()[: mixing.DIGITS], i, t) for i, t, s in rows if s == source]
        for _, doc_id, text in sorted(coined, key=lambda c: c[0]):
            n = size(text)
            out.append((doc_id, n, sizes[source], round(targets[source], 6), whole + (before + n / 2 < wanted)))
            before += n
    return Counter(out)


def found_copies(mixed):
    return Counter((r.doc_id, r.size, r.source_size, round(r.target, 6), r.copies) for r in mixed.select("doc_id", "size", "source_size", "target", "copies").collect())


def test_mix(spark, odd_docs, no_docs):
    rows = [(d.doc_id, d.text, d.source) for d in odd_docs.collect()]
    mixed = mixing.mix(odd_docs)
    assert found_copies(mixed) == slow_copies(rows) == found_copies(mixing.takes(odd_docs))
    found = mixed.collect()
    assert all(r.taken == r.size * r.copies <= 3 * r.size and r.row.size == 7 for r in found)
    emitted = mixing.emit(mixed)
    assert emitted.columns == odd_docs.columns
    assert emitted.count() == sum(r.copies for r in found)
    assert mixing.mix(no_docs).count() == mixing.takes(no_docs).count() == 0


@pytest.mark.parametrize("sort", [2048, 3])
def test_many_sources(spark, monkeypatch, sort):
    """Sources of one to many documents, hot ones, texts without words; the same result however thresholds are looked for."""
    monkeypatch.setattr(mixing, "SORTED", sort)
    rows = [(i, "w " * (i * 7919 % 90), ["hot", "s1", "s2", None, f"own{i}"][min(4, i % 9 if i % 9 < 4 else (0 if i % 50 else 4))]) for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    assert found_copies(mixing.takes(docs)) == slow_copies(rows)


def test_repeated_rows(spark):
    """Of 1,000 equal rows just so many get the further copy, and reruns agree."""
    rows = [(1, "some words in a text", "a")] * 1000 + [(i, "one two three", f"b{i % 3}") for i in range(2, 900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(7)
    docs = docs.withColumn("other", F.create_map(F.lit("k"), F.lit(1)))
    got = found_copies(mixing.mix(docs))
    assert got == slow_copies(rows) == found_copies(mixing.mix(docs.repartition(3)))
    assert len([k for k in got if k[0] == 1]) == 2
    assert mixing.emit(mixing.mix(docs)).count() == sum(k[4] * n for k, n in got.items())


def test_a_row_has_the_fraction_as_its_chance(spark):
    """Over many seeds, a short and a long document alike."""
    rows = [(i, "w " * (200 if i == 0 else 1 + i % 30), "a" if i < 40 else "b") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1).cache()
    taken, n = Counter(), 12
    for seed in range(n):
        for r in mixing.takes(docs, seed=seed).filter("doc_id < 40").collect():
            taken[r.doc_id] += r.copies
            rate = r.target / r.source_size
    assert sum(taken.values()) / (40 * n) == pytest.approx(rate, abs=0.15)


@pytest.mark.parametrize(("sf", "near"), [("sf0.01", 0.05), ("sf0.1", 0.01)])
def test_takes_of_documents(spark, sf, near):
    mixed = mixing.takes(table(spark, f"{DATA}/{sf}", "documents"))
    for r in mixed.groupBy("source_size", "target").agg(F.sum("taken").alias("taken"), F.max("size").alias("most")).collect():
        assert abs(r.taken - r.target) <= max(near * r.target, r.most / 2)


def test_takes_come_near_targets(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.expr("repeat('w ', 1 + id % 50)").alias("text"), F.expr("if(id % 3 = 0, 'hot', concat('s', id % 7))").alias("source"))
    for r in mixing.mix(docs).groupBy("row.source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect():
        assert r.taken == pytest.approx(r.target, abs=25)


@pytest.mark.parametrize("bound", [0, 100])
def test_join_small_beyond_its_bound(spark, bound):
    big = spark.createDataFrame([(i, None if i % 3 == 0 else f"k{i % 4}") for i in range(200)], "id long, key string")
    small = common.written(spark.createDataFrame([(None, 0), ("k0", 1), ("k1", 2), ("k2", 3)], "key string, v int"), "small")
    got = sorted((r.id, r.v) for r in common.join_small(big, small, "key", salts=4, bound=bound).collect())
    value = {None: 0, "k0": 1, "k1": 2, "k2": 3}
    assert got == [(r.id, value[r.key]) for r in sorted(big.collect()) if r.key in value]
    assert common.join_small(big, small, "key", salts=4, bound=bound, how="left").count() == 200


def test_global_rank(spark):
    df = spark.createDataFrame([(i * 37 % 101,) for i in range(101)] + [(None,)], "v int").repartition(7)
    got = {r.v: r.at for r in common.global_rank(df, [F.col("v").asc_nulls_last()], "at").collect()}
    assert got == {i: i for i in range(101)} | {None: 101}
