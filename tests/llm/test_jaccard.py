"""Near copies against the Jaccard similarity of all pairs."""

import random
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from quern.llm import jaccard
from quern.session import table
from tests.conftest import DATA


def slow_set(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def slow_kept(rows):
    """The doc_ids that stay; ids are distinct."""
    sets = {i: slow_set(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(sorted(sets), 2):
        a, b = sets[i], sets[j]
        if 5 * min(len(a), len(b)) >= 4 * max(len(a), len(b)) and 5 * len(a & b) >= 4 * len(a | b):
            x, y = sorted((find(i), find(j)))
            root[y] = x
    return {i for i in root if root[i] == i}


def planted():
    """Originals and copies with a few changed words, from far below the similarity to far above it; common passages; short texts."""
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(3000)}"
    passage = [word() for _ in range(30)]
    texts = []
    for k in range(40):
        own = [word() for _ in range(rng.choice([1, 4, 5, 6, 9, 30, 120, 400]))] + passage * (k % 2)
        texts.append(" ".join(own))
        for _ in range(rng.randrange(6)):
            copy = list(own)
            for _ in range(rng.randrange(1 + len(own) // 12)):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy[: len(copy) - rng.randrange(3)]))
    for _ in range(60):  # a chain and a hub in one large group
        base = texts[0].split() if len(texts[0].split()) > 100 else passage * 4
        texts.append(" ".join(base + [word() for _ in range(rng.randrange(12))]))
    texts += ["", " \n", texts[5].upper(), texts[6].replace(" ", "\t ")]
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize(("common", "sample"), [(4, 10_000), (10_000, 10_000), (2, 20)])
def test_planted_copies(spark, monkeypatch, common, sample):
    """The same result whatever is counted as common."""
    monkeypatch.setattr(jaccard, "COMMON", common)
    monkeypatch.setattr(jaccard, "SAMPLE", sample)
    rows = planted()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    kept = corpus_pipeline.STAGES[1][1](spark, docs, "").collect()
    want = slow_kept(rows)
    assert len(kept) == len(want) < len(rows) and {r.doc_id for r in kept} == want


def test_documents(spark):
    docs = table(spark, f"{DATA}/sf0.01", "documents")
    assert {r.doc_id for r in corpus_pipeline.STAGES[1][1](spark, docs, "").select("doc_id").collect()} == slow_kept([(r.doc_id, r.text) for r in docs.collect()])


def test_odd_documents(spark, odd_docs, no_docs):
    kept = jaccard.survivors(odd_docs)
    assert kept.columns == odd_docs.columns
    rows = kept.collect()
    assert len(rows) == len({frozenset(slow_set(r.text)) for r in odd_docs.collect()})  # no two different texts here are close
    assert jaccard.survivors(no_docs).count() == 0


def test_shingles_in_parts(monkeypatch):
    text = "a bb ccc a bb ccc É  d e f g a bb ccc d"
    want = sorted(xxhash.xxh64_intdigest(s, 42) for s in slow_set(text))
    for part in (1, 3, 7, 1 << 22):
        monkeypatch.setattr(jaccard.simhash, "_PART", part)
        assert jaccard.shingles(text).tolist() == want
    assert jaccard.shingles("One two").tolist() == [xxhash.xxh64_intdigest(b"one two", 42)] and not len(jaccard.shingles(" "))


def pages(n, shared, own):
    """Texts that share ``shared`` shingles of a template and have ``own`` of their own."""
    words = [f"t{k}" for k in range(shared + 4)]
    return [(k, " ".join(words + [f"p{k}x{j}" for j in range(own)])) for k in range(n)]


@pytest.mark.parametrize(("shared", "own", "alike"), [(8, 2, False), (80, 20, False), (18, 2, True), (17, 3, False)])
def test_pages_of_a_template(spark, monkeypatch, shared, own, alike):
    """Large groups around every shingle of a template: pages that are similar are found, others make no pairs."""
    rows = pages(150, shared, own)
    kept = jaccard.survivors(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {r.doc_id for r in kept} == slow_kept(rows) and len(kept) == (1 if alike else 150)


def test_templates_make_no_pairs(spark):
    """What meets in the groups of 3,000 pages that are not similar."""
    docs = spark.createDataFrame(pages(3000, 40, 10), "doc_id long, text string")
    classes = jaccard.prints(docs).withColumn("root", F.col("key"))
    large = jaccard.large_groups(classes)
    assert large.count() >= 3000 and large.filter("met").count() == 0


def met_rows(spark, monkeypatch, rows):
    """What stays of these texts, and how many rows came out of the groups around their shingles."""
    made, meet = [], jaccard.meet
    with monkeypatch.context() as patch:
        patch.setattr(jaccard, "COMMON", 10**9)  # no shingle comes last
        patch.setattr(jaccard, "meet", lambda *a, **k: made.append(jaccard.written(meet(*a, **k), "met")) or made[-1])
        kept = {r.doc_id for r in jaccard.survivors(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    return kept, sum(m.count() for m in made)


def test_passages_make_no_squares(spark, monkeypatch):
    """Texts that share a passage without being similar, five times as many to a passage: what meets grows no faster than the texts."""
    made = []
    for n in (12, 60):
        rows = [(100 * g + k, text.replace("t", f"g{g}t").replace("p", f"g{g}p")) for g in range(3) for k, text in pages(n, 60, 40)]
        kept, count = met_rows(spark, monkeypatch, rows)
        assert kept == {i for i, _ in rows}
        made.append(count)
    assert made[1] <= 5 * made[0] + 180  # texts in all


def test_pairs_meet_once(spark, monkeypatch):
    """Long texts that are just similar or not quite, which cells don't tell apart: a pair comes out a few times, not once for each of the shingles that it shares."""
    rng = random.Random(8)
    base = [f"w{k}" for k in range(2000)]
    rows = []
    for k in range(40):
        copy = list(base)
        for at in rng.sample(range(2000), 22 + k // 4):
            copy[at] = f"c{k}x{at}"
        rows.append((k, " ".join(copy)))
    kept, count = met_rows(spark, monkeypatch, rows)
    assert kept == slow_kept(rows) and 1 < len(kept) < 40
    assert count <= 4 * 40 * 39 // 2


def test_met_before():
    token, head = np.array([5, 5, 5, 5]), np.array([[1, 5, 2], [1, 5, 3], [5, 1, 3], [4, 4, 4]])
    head, left, right = np.pad(head, ((0, 0), (0, jaccard.HEAD - 3)), mode="edge"), np.array([0, 2, 3, 0, 1]), np.array([1, 0, 0, 3, 2])
    assert jaccard.met_before(token, head, left, right).tolist() == [True, False, False, False, True]


def test_meetings(monkeypatch):
    token, size, root = np.array([1, 1, 1, 1, 2, 2]), np.array([8, 8, 9, 20, 5, 5]), np.array([1, 1, 2, 3, 4, 5])
    pairs = lambda every: {(int(a), int(b)) for x, y in jaccard.meetings(token, size, root, every) for a, b in zip(x, y)}
    assert pairs(True) == {(0, 2), (1, 2), (4, 5)} == pairs(False)
    monkeypatch.setattr(jaccard, "FEW", 1)
    assert pairs(False) == {(1, 2), (4, 5)}


def test_stage_compares_fingerprints(spark, monkeypatch):
    """Fingerprints of the sets are linked in tiles, as all pairs within the radius are, and what they link is a first step of the stage."""
    rows = planted()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = jaccard.prints(docs).collect()
    bits = {}
    for text, row in zip((dict(rows)[r.doc_id] for r in found), found):
        hashes = [xxhash.xxh64_intdigest(s, 42) for s in slow_set(text)]
        fp = sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))
        assert row.fp & (1 << 64) - 1 == fp
        bits[row.key] = fp

    def parts(pairs):
        root = {k: k for k in bits}

        def find(k):
            while root[k] != k:
                k = root[k]
            return k

        for a, b in pairs:
            root[find(b)] = find(a)
        return {frozenset(k for k in bits if find(k) == r) for r in {find(k) for k in bits}}

    classes = spark.createDataFrame([(r.key, r.fp) for r in {r.key: r for r in found}.values()], "key long, fp long")
    pairs = [(r.a, r.b) for r in jaccard.fingerprint_candidates(classes).collect()]
    near = [(a, b) for a, b in combinations(bits, 2) if (bits[a] ^ bits[b]).bit_count() <= jaccard.RADIUS]
    assert near and parts(pairs) == parts(near)

    linked, links = [], jaccard.simhash.links
    monkeypatch.setattr(jaccard.simhash, "links", lambda *a: linked.append(a) or links(*a))
    kept = corpus_pipeline.STAGES[1][1](spark, docs, "").collect()
    assert linked and {r.doc_id for r in kept} == slow_kept(rows)
