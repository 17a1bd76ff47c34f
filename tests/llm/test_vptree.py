import numpy as np
import pytest

from quern.llm import vptree


def data(n, dim=8, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((10, dim))
    x = (centres[rng.integers(0, 10, n)] + 0.3 * rng.standard_normal((n, dim))).astype(np.float32)
    x[::7] = x[0]  # one common vector
    return x


def brute(ids, x, k, queries):
    out = []
    for q in queries:
        score = np.zeros(len(ids))
        for d in range(x.shape[1]):
            score += np.float64(x[q, d]) * x[:, d].astype(np.float64)
        order = [i for i in np.lexsort((ids, -score)) if ids[i] != ids[q]][:k]
        out += [(int(ids[q]), r + 1, int(ids[i]), float(score[i])) for r, i in enumerate(order)]
    return sorted(out)


def frame(spark, ids, x):
    return spark.createDataFrame([(int(i), [float(v) for v in row]) for i, row in zip(ids, x)], "vec_id long, embedding array<float>")


@pytest.mark.parametrize("shard_rows", [250, 10_000])
def test_factor_one_is_exact(spark, shard_rows):
    x, ids = data(1200), np.arange(1200) * 5
    df = frame(spark, ids, x)
    index = vptree.build(df, shard_rows)
    got = vptree.search(index, df.filter("vec_id % 20 = 0"), 20, factor=1.0, block=100)
    assert sorted(map(tuple, got.select("query_id", "rank", "vec_id", "score").collect())) == brute(ids, x, 20, [i for i in range(1200) if ids[i] % 20 == 0])


def test_recall_with_the_factor_in_use():
    x, ids = data(5000, 16), np.arange(5000)
    tree = vptree.Tree(x, ids, float(np.linalg.norm(x.astype(float), axis=1).max()))
    queries = np.arange(0, 5000, 20)
    got = tree.neighbours(ids[queries], x[queries].astype(float), 20, vptree.FACTOR).to_pydict()
    worst = {q: s for q, r, _, s in brute(ids, x, 20, queries) if r == 20}
    assert sum(s >= worst[q] for q, s in zip(got["query_id"], got["score"])) >= 0.9 * 20 * len(queries)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (20, [0.0, 1.0]), (1, [1.0, 0.0]), (2, [2.0, 1.0]), (2, [2.0, 1.0]), (3, None), (4, [0.0, 0.0]), (40, [nan, 1.0]), (6, [inf, 1.0]), (60, [1.0, None]), (None, [1.0, 1.0]), (80, [1.0, 2.0, 3.0]), (100, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "7 AS dim", "7 AS shard", "7 AS rank")
    got = vptree.search(vptree.build(df), df.filter("vec_id % 20 = 0"), 3).collect()
    by = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        by.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert by == {0: [(2, 2.0), (2, 2.0), (1, 1.0)], 20: [(2, 1.0), (2, 1.0), (0, 0.0)]}
    empty = df.limit(0)
    assert vptree.search(vptree.build(empty), empty).count() == 0


def searched(ids, x, queries, k, factor, leaf=vptree.LEAF):
    tree = vptree.Tree(x, ids, float(np.sqrt((x.astype(float) ** 2).sum(axis=1)).max()), leaf)
    tree = vptree.Tree.from_bytes(tree.to_bytes())
    found = vptree.Found(ids[queries], x[queries].astype(float), k)
    tree.search(found, factor)
    got = found.batch().to_pydict()
    rank, last, out = 0, None, []
    for q, i, s in zip(got["query_id"], got["vec_id"], got["score"]):
        rank = rank + 1 if q == last else 1
        last = q
        out.append((q, rank, i, s))
    return sorted(out), found.compared / (len(queries) * len(x))


def ties():
    """Vectors with many equal inner products: one-hot ones, equal products of different vectors, a few directions, opposite ones."""
    rng = np.random.default_rng(5)
    yield np.eye(1600, dtype=np.float32)
    flat = rng.standard_normal((600, 8)).astype(np.float32)
    flat[:, 0] = 1
    flat[0] = np.eye(8)[0]
    yield flat
    yield rng.integers(-1, 2, (900, 6)).astype(np.float32) + np.float32(0.0)
    yield np.repeat(np.eye(3, dtype=np.float32), 700, axis=0)
    yield np.vstack([np.eye(4), -np.eye(4)]).astype(np.float32)


@pytest.mark.parametrize("x", list(ties()), ids=["one-hot", "equal products", "grid", "copies", "opposite"])
@pytest.mark.parametrize("leaf", [4, 64])
def test_ties_are_exact(x, leaf):
    x = x[(x != 0).any(axis=1)]
    ids = np.random.default_rng(1).permutation(len(x)).astype(np.int64) * 3
    queries = np.arange(0, len(x), max(1, len(x) // 40))
    assert searched(ids, x, queries, 20, 1.0, leaf)[0] == brute(ids, x, 20, queries)


def test_clusters_are_pruned():
    """Where there is something to prune, exact search leaves vectors out, and the factor more of them."""
    rng = np.random.default_rng(3)
    x = (np.repeat(rng.standard_normal((40, 16)) * 3, 100, axis=0) + 0.1 * rng.standard_normal((4000, 16))).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids, queries = np.arange(4000), np.arange(0, 4000, 20)
    want = brute(ids, x, 20, queries)
    got, exact = searched(ids, x, queries, 20, 1.0)
    assert got == want and exact < 0.3
    got, less = searched(ids, x, queries, 20, vptree.FACTOR)
    assert less <= exact and len(set(got) & set(want)) >= 0.9 * len(want)


def test_doubles_stay_doubles(spark):
    """Scores are those of the original vectors, to the last bit."""
    rng = np.random.default_rng(8)
    x = rng.standard_normal((300, 5))
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "vec_id long, embedding array<double>")
    got = vptree.search(vptree.build(df, 100), df.filter("vec_id % 20 = 0"), 20, factor=1.0)
    want = []
    for q in range(0, 300, 20):
        score = np.zeros(300)
        for d in range(5):
            score += x[q, d] * x[:, d]
        order = [i for i in np.lexsort((np.arange(300), -score)) if i != q][:20]
        want += [(q, r + 1, int(i), float(score[i])) for r, i in enumerate(order)]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_one_id_and_one_vector_in_many_rows(spark):
    """Neither fills a shard; all copies are candidates."""
    df = spark.range(6000).selectExpr("if(id % 3 = 0, 7, id) AS vec_id", "if(id % 3 = 1, array(1.0F, 0.0F), array(float(id % 100) - 200.0F, 1.0F)) AS embedding")
    index = vptree.build(df, 1000)
    sizes = []
    for r in index.collect():
        with vptree.opened(r.path) as file:
            sizes.append(len(vptree.Tree.from_bytes(file.read()).ids))
    assert sum(sizes) == 6000 and len(sizes) == 6 and max(sizes) < 1200
    queries = df.filter("vec_id % 1000 = 1")  # the vector (1, 0): nearest are its copies
    rows = vptree.search(index, queries, 5, factor=1.0).collect()
    assert rows and all(r.score == 1.0 for r in rows if r.query_id % 3 == 1)


@pytest.mark.parametrize("dim", [4, 16, 64])
def test_recall_with_the_calibrated_factor(spark, dim):
    """Nine tenths of the true nearest at least, whatever the data are like, over several trees."""
    rng = np.random.default_rng(dim)
    x = data(3000, dim, seed=dim) if dim < 64 else rng.standard_normal((3000, dim)).astype(np.float32)
    ids = np.arange(3000)
    df = frame(spark, ids, x)
    index, queries = vptree.build(df, 800), df.filter("vec_id % 20 = 0")
    factor, recall, share = vptree.calibrated(index, vptree.usable(queries))
    assert factor in vptree.FACTORS and recall >= vptree.RECALL and 0 < share <= 1
    kth = {q: s for q, r, _, s in brute(ids, x, 20, range(0, 3000, 20)) if r == 20}
    got = vptree.search(index, queries).collect()
    assert len(got) == 20 * len(kth) and sum(r.score >= kth[r.query_id] for r in got) >= 0.9 * len(got)


def test_trees_of_few_vectors():
    for n in (1, 2, 5):
        x = np.eye(6, dtype=np.float32)[:n]
        ids = np.arange(n)
        tree = vptree.Tree(x.reshape(n, 6), ids, 1.0, 2)
        assert len(tree.neighbours(ids, x.reshape(n, 6).astype(float), 20, 1.0)) == n * max(0, n - 1)
