"""Exact duplicates against a dictionary of texts."""

import hashlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quern.llm import exact

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def slow(rows):
    """(doc_id, keep_id, group_size, sha) of every row, and how many rows of each text stay."""
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[(text or "").translate(UPPER)].append(doc_id)
    out = []
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        sha = hashlib.sha256(text.encode()).hexdigest()
        out += [(str(i), str(keep), len(ids), sha) for i in ids]
    return sorted(out)


def fast(docs):
    return [(str(r.doc_id), str(r.keep_id), r.group_size, bytes(r.sha).hex(), r.kept) for r in exact.duplicates(docs).collect()]


@pytest.mark.parametrize(("parts", "rounds"), [(1, 1), (3, 1), (9, 2), (40, 3)])
def test_tree_of_runs(spark, parts, rounds):
    """Every digest comes out once, with its largest doc_id and all its rows, however many partitions and rounds."""
    rng = np.random.default_rng(parts)
    rows = [(int(i), bytes(hashlib.sha256(b"%d" % (k * (k % 3 > 0))).digest())) for i, k in enumerate(rng.integers(0, 900, 3000))]
    hashed = spark.createDataFrame(rows, "doc_id long, sha binary").repartition(parts).withColumn("place", F.col("doc_id") * 2)
    want = defaultdict(list)
    for i, sha in rows:
        want[sha].append(i)
    got = exact.tree_merge(hashed, rounds)
    merged = [(bytes(r.sha), r.doc_id, r.place, r.n) for r in got.collect()]
    assert sorted(merged) == sorted((sha, max(ids), 2 * max(ids), len(ids)) for sha, ids in want.items())
    assert max(got.groupBy(F.spark_partition_id()).count().select("count").toPandas()["count"]) < len(want) or rounds == 0


def test_merging_compares_whole_digests():
    """Digests that agree in all but their last byte stay apart; a group may go over batches."""
    sha = [bytes(31) + b"\x00", bytes(31) + b"\x00", bytes(31) + b"\x01", bytes(31) + b"\x01"]
    batch = lambda at: pa.RecordBatch.from_pydict({"at": [0, 0], "sha": sha[at : at + 2], "doc_id": [9, None], "place": [at, at + 1], "n": [1, 4]})
    out = pa.Table.from_batches([b for b in exact.merged([batch(0), batch(0), batch(2)]) if b.num_rows]).to_pydict()
    assert out["sha"] == [sha[0], sha[2]] and out["n"] == [10, 5] and out["doc_id"] == [9, 9]
    assert list(exact.merged([])) == []


def test_odd_documents(spark, odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    got = fast(odd_docs)
    assert sorted(g[:4] for g in got) == slow(rows)
    for sha in {g[3] for g in got}:
        assert sum(g[4] for g in got if g[3] == sha) == 1
    assert all(g[0] == g[1] for g in got if g[4])
    assert fast(no_docs) == []
    kept = exact.survivors(odd_docs)
    assert kept.columns == odd_docs.columns and kept.count() == len({g[3] for g in got})
    assert exact.survivors(no_docs).count() == 0


def test_hot_text_and_case(spark, monkeypatch):
    """A third of all rows are one text; beyond the broadcast's bound both sides are joined by a shuffle. Only A-Z are lowered."""
    docs = spark.range(0, 6000, 1, 7).select(F.col("id").alias("doc_id"), F.expr("CASE WHEN id % 3 = 0 THEN 'The Same' WHEN id % 3 = 1 THEN concat('É', id % 500) ELSE concat('é', id % 500) END").alias("text"))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    for bound in (100_000, 10):
        monkeypatch.setattr(exact, "BROADCAST_ROWS", bound)
        got = fast(docs)
        assert sorted(g[:4] for g in got) == slow(rows)
        assert sum(g[4] for g in got) == len({g[3] for g in got})


def test_rounds():
    assert exact.rounds_for(0) == exact.LEAST and exact.rounds_for(1 << 60) == exact.MOST
    assert exact.ROWS * exact.FAN ** exact.rounds_for(50_000_000) >= 50_000_000
