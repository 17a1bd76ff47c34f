"""BM25 by blocks against a plain score of all documents."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quern.operators import search


def slow(docs, questions, k):
    split = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    found = [(i, n, Counter(split(t)), len(split(t))) for n, (i, t) in enumerate(docs)]
    length = sum(f[3] for f in found) / len(found) or 1.0
    df = Counter(t for f in found for t in f[2])
    out = []
    for q in {q for q, _ in questions}:
        terms = {t for i, text in questions if i == q for t in split(text)}
        scored = []
        for i, _, tf, size in found:
            met = [t for t in terms if tf[t]]
            if met:
                s = sum(math.log(1 + (len(docs) - df[t] + 0.5) / (df[t] + 0.5)) * tf[t] * (search.K1 + 1) / (tf[t] + search.K1 * (1 - search.B + search.B * size / length)) for t in met)
                scored.append((-round(s, search.DIGITS), i is None, i or 0))
        out += [(q, r, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def corpus(n=700, seed=1):
    rng = random.Random(seed)
    word = lambda: f"w{int(rng.paretovariate(0.9)) % 3000}"
    docs = [(k, " ".join(word() for _ in range(rng.randrange(1, 60)))) for k in range(n)]
    docs += [(3, "w1 w2"), (None, "w1 w1 w17"), (n + 1, None), (n + 2, ""), (n + 3, "W1 Wörter, w2!"), (n + 4, "w1 " * 5000)]
    return docs, [(k, " ".join(word() for _ in range(6))) for k in range(12)] + [(90, "nowhere"), (91, None), (92, "w1 W1 wörter"), (92, "w2")]


@pytest.mark.parametrize(("block", "k"), [(16, 10), (1, 3), (100_000, 5), (8, 1)])
def test_against_all_documents(spark, block, k):
    docs, questions = corpus()
    index = search.build(spark.createDataFrame(docs, "doc_id long, text string").repartition(3).withColumns({c: F.lit(1) for c in ("term", "score", "range")}), block)
    got = search.search(index, spark.createDataFrame(questions, "query_id long, text string"), k).collect()
    assert sorted((tuple(r) for r in got), key=str) == slow(docs, questions, k)


def test_blocks_stay_closed(spark):
    """A rare term's documents are enough; the blocks of a common one are not opened elsewhere."""
    docs = [(k, f"common c{k % 7} " + ("rare rare" if k % 400 == 5 else "")) for k in range(2000)]
    questions = spark.createDataFrame([(1, "common rare")], "query_id long, text string")
    index = search.build(spark.createDataFrame(docs, "doc_id long, text string"), 16)
    assert search.skipped(index, questions, 3) > 0.8
    assert [r.doc_id for r in search.search(index, questions, 3).orderBy("rank").collect()] == [5, 405, 805]


def test_nothing_to_find(spark):
    none = search.build(spark.createDataFrame([], "doc_id long, text string"))
    questions = spark.createDataFrame([(1, "a")], "query_id long, text string")
    assert search.search(none, questions, 5).count() == 0 and search.skipped(none, questions, 5) == 0
    some = search.build(spark.createDataFrame([(1, "b")], "doc_id long, text string"))
    assert search.search(some, questions, 5).count() == 0


def test_supplied_documents_leave_blocks_closed(spark):
    from quern.session import table
    from tests.conftest import DATA

    index = search.build(table(spark, f"{DATA}/sf0.01", "documents"))
    share = search.skipped(index, table(spark, f"{DATA}/sf0.01", "benchmark").select(F.col("item_id").alias("query_id"), "text"), 10)
    assert 0 <= share < 1
    print(f"share of blocks skipped: {share:.3f}")


def test_postings_are_not_shuffled(spark):
    """Beyond broadcasts, blocks are scored where they lie: what is shuffled after the index is built is questions' ranges and their best rows."""
    docs, questions = corpus(300)
    index = search.build(spark.createDataFrame(docs, "doc_id long, text string"), 8)
    wanted = search.asked(index, spark.createDataFrame(questions, "query_id long, text string"))
    ranges = search.opened(index, wanted, 3).select("query_id", "range")
    plan = search.scored(index, wanted, ranges)._jdf.queryExecution().executedPlan().toString()
    over = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert over and not any("row#" in line or "doc_id#" in line for line in over)
    sums = search.bounded(index, wanted)
    assert sums.count() == sums.select("query_id", "range").distinct().count() > 0
