import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from quern.llm import graph, simhash


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(values, radius):
    root = list(range(len(values)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= radius and find(i) != find(j):
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(values))]


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("aAbÉ \n\x0b\x1c "), max_size=60))
def test_fingerprint(text):
    assert simhash.fingerprint(text) == slow_fingerprint(text)


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("aAbÉ \n"), max_size=60), st.integers(1, 9))
def test_fingerprint_in_parts(text, part):
    whole, old = simhash.fingerprint(text), simhash._PART
    try:
        simhash._PART = part
        assert simhash.fingerprint(text) == whole
    finally:
        simhash._PART = old


@pytest.mark.parametrize("tile", [8, 1024])
def test_links_against_all_pairs(spark, tile):
    """Clusters of close fingerprints; with small tiles most buckets are cut."""
    rng = np.random.default_rng(1)
    centres = [int(x) for x in rng.integers(0, 2**63, 12)]
    values = {0, (1 << 64) - 1}
    for k in range(500):
        x = centres[k % 12]
        for b in rng.integers(0, 64, 1 + k % 5):
            x ^= 1 << int(b)
        values.add(x)
    values = sorted(values)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    classes = spark.createDataFrame([(v,) for v in signed], "fp long").repartition(4)
    edges = simhash.links(classes, tile=tile)
    known = {s: v for s, v in zip(signed, values)}
    found = {r.node: r.root for r in graph.components(edges).collect()}
    slow = slow_components(values, 2)
    groups, want = {}, {}
    for s, v, k in zip(signed, values, slow):
        groups.setdefault(found.get(s, s), set()).add(known[s])
        want.setdefault(k, set()).add(v)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


@pytest.mark.parametrize("held", [7, 100, graph.EDGES])
def test_components_of_a_long_chain_and_a_star(spark, held):
    """The same whether all edges are one task's, or go through forests and rounds."""
    chain = [(i, i + 1) for i in range(0, 60)] + [(1000, 1000 + k) for k in range(1, 300)] + [(5, 5)]
    found = {r.node: r.root for r in graph.components(spark.createDataFrame(chain, "a long, b long").repartition(5), held).collect()}
    assert found == {i: 0 for i in range(61)} | {1000 + k: 1000 for k in range(300)}
    assert graph.components(spark.createDataFrame([], "a long, b long"), held).count() == 0


def test_random_graphs():
    rng = np.random.default_rng(4)
    for n, m in ((1, 0), (50, 20), (300, 280), (300, 900)):
        a, b = rng.integers(0, n, m), rng.integers(0, n, m)
        x, y = graph.stars(a - 20, b - 20)
        root = list(range(n))
        for _ in range(n):
            for i, j in zip(a, b):
                root[i] = root[j] = min(root[i], root[j])
        assert {int(i) + 20: int(j) + 20 for i, j in zip(x, y)} == {i: r for i, r in enumerate(root) if r != i}


def test_documents(spark, odd_docs, no_docs):
    rows = simhash.near_duplicates(odd_docs).collect()
    docs = odd_docs.collect()
    assert len(rows) == len(docs)
    values = [slow_fingerprint(d.text) for d in docs]
    slow = slow_components(values, 2)
    want = sorted(
        (str(d.doc_id), v, str(min((e.doc_id for e, k in zip(docs, slow) if k == own and e.doc_id is not None), default=None))) for d, v, own in zip(docs, values, slow)
    )
    assert sorted((str(r.doc_id), r.fp & (1 << 64) - 1, str(r.component_id)) for r in rows) == want
    assert simhash.near_duplicates(no_docs).count() == 0


def test_survivors(spark, odd_docs, no_docs):
    kept = simhash.survivors(odd_docs)
    assert kept.columns == odd_docs.columns
    rows = kept.collect()
    groups = {}
    for d in odd_docs.collect():
        groups.setdefault(slow_fingerprint(d.text), set()).add(d.doc_id)
    assert len(rows) == len(groups)  # no two different fingerprints here are close
    for r in rows:
        ids = groups[slow_fingerprint(r.text)]
        assert r.doc_id == min((i for i in ids if i is not None), default=None)
    assert simhash.survivors(no_docs).count() == 0
