"""Frequent term sets by shards against a count of all sets of every document."""

import random
import re
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from quern.operators import termsets
from quern.session import table
from tests.conftest import DATA


def slow(texts, percent, common, most):
    split = [set(re.findall(r"[^\W_]+", (t or "").lower())) for t in texts]
    n, df = len(split), Counter(t for s in split for t in s)
    items = {t for t, c in df.items() if c >= max(1, -(-n * percent // 100)) and c <= n * common // 100}
    sets = Counter(c for s in split for k in range(1, most + 1) for c in combinations(sorted(s & items, key=lambda t: t.encode()), k))
    return {s: c for s, c in sets.items() if c >= max(1, -(-n * percent // 100))}


def corpus(n=600, seed=2):
    rng = random.Random(seed)
    word = lambda: f"w{int(rng.paretovariate(1.1)) % 60}"
    texts = [" ".join(word() for _ in range(rng.randrange(1, 9))) for _ in range(n)]
    # a third of all rows are one text; some rows hold nothing, one is very long
    return texts + ["hot copies of one text"] * (n // 2) + [None, "", " .,", "W1 Wörter w2", "w3 " * 50_000]


def found(df):
    rows = df.collect()
    assert len({tuple(r.terms) for r in rows}) == len(rows)
    return {tuple(r.terms): r.n_docs for r in rows}


@pytest.mark.parametrize(("percent", "common", "most", "shard_rows"), [(5, 100, 3, 8192), (4, 60, 4, 100), (3, 100, 2, 37), (10, 30, 1, 200), (34, 100, 3, 50)])
def test_against_all_sets(spark, percent, common, most, shard_rows):
    texts = corpus()
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3).withColumns({c: F.lit(1) for c in ("row", "terms", "item", "shard")})
    assert found(termsets.term_sets(docs, percent, common, most, shard_rows)) == slow(texts, percent, common, most)


def test_lots(spark, monkeypatch):
    """Named sets beyond a lot are counted in several."""
    texts = corpus(200)
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    monkeypatch.setattr(termsets, "LOT", 7)
    assert found(termsets.term_sets(docs, 4, 100, 3, 64)) == slow(texts, 4, 100, 3)


def test_supplied_documents(spark):
    docs = table(spark, f"{DATA}/sf0.001", "documents")
    sets = found(termsets.term_sets(docs, shard_rows=64))
    assert sets == slow([r.text for r in docs.collect()], termsets.PERCENT, termsets.COMMON, termsets.MOST)
    assert max(map(len, sets)) == termsets.MOST


def test_no_documents(spark):
    none = spark.createDataFrame([], "text string")
    assert found(termsets.term_sets(none)) == {}
    assert termsets.hot(none, 5).collect() == []
    assert found(termsets.term_sets(spark.createDataFrame([(None,), ("",)], "text string"))) == {}


def test_closed(spark):
    sets = [(["a"], 9), (["b"], 7), (["c"], 5), (["a", "b"], 7), (["a", "c"], 4), (["a", "b", "c"], 4)]
    assert found(termsets.closed(spark.createDataFrame(sets, "terms array<string>, n_docs long"))) == {("a",): 9, ("c",): 5, ("a", "b"): 7, ("a", "b", "c"): 4}


def test_hot(spark):
    texts = ["deep learning models"] * 3 + ["deep learning"] * 2 + ["trust online"] * 5 + ["other"] * 10
    rows = termsets.hot(spark.createDataFrame([(t,) for t in texts], "text string"), 2).collect()
    assert [tuple(r) for r in rows] == [(1, "deep learning", 5), (2, "online trust", 5)]
