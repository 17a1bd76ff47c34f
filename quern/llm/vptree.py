"""Nearest neighbours by inner product, with a vantage-point tree per shard.

Vectors get one more coordinate that brings them all to the largest norm, and queries a zero there; then the largest inner product is the
smallest Euclidean distance, for which the triangle inequality holds. A tree's node halves its vectors by their distance from a vantage point, and remembers
the least and largest distance in either half. So a leaf's vectors are no nearer to a query than the inequality says for any vantage point above it. A search takes
leaves by that bound, the least first, and leaves out those whose bound, times ``factor``, is beyond the radius found so far. Factor one leaves
out only what cannot hold a neighbour: exact search, ties included. Equal vectors of a shard are one point of its tree.
"""

from __future__ import annotations

import io
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.llm.common import written
from quern.llm.stores import opened, put
from quern.session import shared_dir

K, LEAF = 20, 64
#: How much harder than exact search pruning is, where nothing is known of the data; search() picks the largest of FACTORS that keeps this recall of the k
#: nearest in a sample: so many queries, each looked for in so many trees.
FACTOR, FACTORS, RECALL = 1.3, (1.0, 1.25, 1.5, 2.0, 2.5, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0), 0.95
SAMPLE_QUERIES, SAMPLE_TREES = 256, 4
#: Rows to a shard (and so to a tree) about; queries that go through trees together at most, and at least where there are few trees.
SHARD_ROWS, QUERY_BLOCK, LEAST_BLOCK = 20_000, 4096, 256
#: Candidates of vantage points for a node, and vectors on which they are tried.
_TRIED, _SAMPLED = 8, 64
#: Differences by rounding, as shares of the norms: of distances, and of inner products.
_ROUNDING, _TINY = 1e-7, 1e-12
_HELD = 1 << 20
SEED = 11
_NONE = np.iinfo(np.int64).max


class Found:
    """Each query's k best rows so far, best first: the largest score, then the smallest id."""

    def __init__(self, query_ids: np.ndarray, queries: np.ndarray, k: int) -> None:
        self.query_ids, self.queries, self.k = query_ids, queries, k
        self.score = np.full((len(queries), k), -np.inf)
        self.id = np.full((len(queries), k), _NONE)
        self.norm = np.sqrt((queries**2).sum(axis=1))
        #: Inner products made.
        self.compared = 0

    def merge(self, who: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        """Takes in rows for the queries at the places ``who``; rows of a query's own id are left out."""
        other = ids != self.query_ids[who]
        who, ids, score = who[other], ids[other], score[other]
        changed = np.unique(who)
        if not len(changed):
            return
        who = np.concatenate([who, np.repeat(changed, self.k)])
        ids = np.concatenate([ids, self.id[changed].ravel()])
        score = np.concatenate([score, self.score[changed].ravel()])
        order = np.lexsort((ids, -score, who))
        who, ids, score = who[order], ids[order], score[order]
        place = np.arange(len(who)) - np.searchsorted(who, who)
        kept = place < self.k
        self.id[who[kept], place[kept]] = ids[kept]
        self.score[who[kept], place[kept]] = score[kept]

    def batch(self) -> pa.RecordBatch:
        """query_id, vec_id, score of all rows found."""
        who, place = np.nonzero(self.id != _NONE)
        columns = self.query_ids[who], self.id[who, place], self.score[who, place]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["query_id", "vec_id", "score"])


class Tree:
    """A vantage-point tree over different vectors, in the order of its leaves. ``ids``: for each vector the ids of its rows, in order."""

    _PARTS = ("vectors", "ids", "starts", "leaves", "vantage", "above", "least", "most")

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, norm: float, leaf: int = LEAF) -> None:
        order = np.lexsort((ids, *vectors.T[::-1]))
        vectors, ids = vectors[order], ids[order]
        first = np.flatnonzero(np.append(True, (vectors[1:] != vectors[:-1]).any(axis=1)))
        ends = np.append(first, len(ids))
        vectors, self.norm = vectors[first].astype(np.float64), norm
        lift = np.sqrt(np.maximum(norm**2 - (vectors**2).sum(axis=1), 0))
        order = self._build(np.hstack([vectors, lift[:, None]]), leaf)
        self.vectors = vectors[order]
        count = np.diff(ends)[order]
        self.starts = np.append(0, np.cumsum(count))
        self.ids = ids[np.repeat(ends[:-1][order] - self.starts[:-1], count) + np.arange(len(ids))]

    def _build(self, points: np.ndarray, leaf: int) -> np.ndarray:
        """Sets leaves (bounds), vantage (points), and for each leaf the vantage points above it with the least and most distance there. Halves are
        cut by rank, so a tree of n vectors is log2(n / leaf) deep however they lie."""
        rng = np.random.default_rng(SEED)
        leaves, vantage, found = [], [], []
        todo = [(np.arange(len(points)), [])]
        while todo:
            own, path = todo.pop()
            if len(own) <= leaf:
                leaves.append(own)
                found.append(path)
                continue
            tried, sample = own[rng.integers(len(own), size=_TRIED)], points[own[rng.integers(len(own), size=_SAMPLED)]]
            spread = [np.linalg.norm(sample - points[v], axis=1).std() for v in tried]
            chosen = points[tried[int(np.argmax(spread))]]
            far = np.linalg.norm(points[own] - chosen, axis=1)
            order = np.argsort(far, kind="stable")
            for half in (order[len(own) // 2 :], order[: len(own) // 2]):
                todo.append((own[half], [*path, (len(vantage), far[half].min(), far[half].max())]))
            vantage.append(chosen)
        depth = max(map(len, found))
        padded = [path + [(-1, 0.0, 0.0)] * (depth - len(path)) for path in found]
        table = np.array(padded, dtype=np.float64).reshape(len(found), depth, 3)
        self.above, self.least, self.most = table[..., 0].astype(np.int64), table[..., 1], table[..., 2]
        self.vantage = np.array(vantage).reshape(len(vantage), points.shape[1])[:, :-1]
        self.leaves = np.append(0, np.cumsum([len(x) for x in leaves]))
        return np.concatenate(leaves)

    def to_bytes(self) -> bytes:
        out, parts = io.BytesIO(), {name: getattr(self, name) for name in self._PARTS}
        small = self.vectors.astype(np.float32)
        if (small == self.vectors).all():
            parts["vectors"] = small
        np.savez(out, norm=self.norm, **parts)
        return out.getvalue()

    @classmethod
    def from_bytes(cls, data: bytes) -> Tree:
        tree = cls.__new__(cls)
        with np.load(io.BytesIO(data)) as parts:
            for name in cls._PARTS:
                setattr(tree, name, parts[name])
            tree.vectors, tree.norm = tree.vectors.astype(np.float64), float(parts["norm"])
        return tree

    def bounds(self, queries: np.ndarray, base: np.ndarray) -> np.ndarray:
        """For each query and leaf, what the distance of the leaf's vectors is at least."""
        gap = np.sqrt(np.maximum(base[:, None] - 2 * queries @ self.vantage.T, 0))
        out = np.zeros((len(queries), len(self.leaves) - 1))
        for place in range(len(self.leaves) - 1):
            for v, low, high in zip(self.above[place], self.least[place], self.most[place]):
                if v >= 0:
                    np.maximum(out[:, place], np.maximum(low - gap[:, v], gap[:, v] - high), out=out[:, place])
        return out

    def search(self, found: Found, factor: float) -> None:
        """Takes the nearest rows here into ``found``.

        A query's leaves go through in waves of twice as many each, so that the radius shrinks on the way, and one leaf's vectors are compared with all queries
        that take it in a wave at once. Inner products from a matrix product only pick candidates; those are summed again term by term, which
        gives the same sum wherever it is made, before anything is cut.
        """
        queries, k = found.queries, found.k
        base = self.norm**2 + found.norm**2
        bound = np.maximum(self.bounds(queries, base) - _ROUNDING * np.sqrt(base)[:, None], 0)
        order = np.argsort(bound, axis=1, kind="stable")
        begin, end, held = 0, 1, []

        def close() -> None:
            if held:
                who, place = (np.concatenate(x) for x in zip(*held))
                held.clear()
                score = np.zeros(len(who))
                for d in range(queries.shape[1]):
                    score += queries[who, d] * self.vectors[place, d]
                copies = np.minimum(self.starts[place + 1] - self.starts[place], k + 1)
                row = np.repeat(np.arange(len(who)), copies)
                at = np.repeat(self.starts[place], copies) + np.arange(len(row)) - np.repeat(np.cumsum(copies) - copies, copies)
                found.merge(who[row], self.ids[at], score[row])

        while begin < len(self.leaves) - 1:
            wave = order[:, begin:end]
            radius = np.sqrt(np.maximum(base - 2 * np.where(np.isfinite(found.score[:, -1]), found.score[:, -1], -np.inf), 0))
            who, column = np.nonzero(np.take_along_axis(bound, wave, 1) * factor <= radius[:, None])
            leaf = wave[who, column]
            by_leaf = np.argsort(leaf, kind="stable")
            who, leaf = who[by_leaf], leaf[by_leaf]
            cuts = np.append(np.flatnonzero(np.diff(leaf, prepend=-1)), len(leaf))
            size = 0
            for a, b in zip(cuts[:-1], cuts[1:]):
                own, first, last = who[a:b], self.leaves[leaf[a]], self.leaves[leaf[a] + 1]
                product = queries[own] @ self.vectors[first:last].T
                found.compared += product.size
                row, col = np.nonzero(product >= (found.score[own, -1] - _TINY * (found.norm[own] * self.norm))[:, None])
                held.append((own[row], first + col))
                size += len(row)
                if size > _HELD:
                    close()
                    size = 0
            close()
            begin, end = end, 2 * end + 1

    def nearest(self, query_ids: np.ndarray, queries: np.ndarray, k: int, factor: float) -> Found:
        """As search, from nothing found before: what is pruned here does not depend on other trees, and so neither does recall on their number."""
        found = Found(query_ids, queries, k)
        self.search(found, factor)
        return found

    def neighbours(self, query_ids: np.ndarray, queries: np.ndarray, k: int, factor: float) -> pa.RecordBatch:
        """query_id, vec_id, score of each query's k nearest rows here, rows of its own id left out."""
        return self.nearest(query_ids, queries, k, factor).batch()


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding (doubles) and dim of the vectors that take part: no null id, not null, empty or zero, all components finite."""
    x = F.col("embedding")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return (
        vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
        .filter(F.col("vec_id").isNotNull() & x.isNotNull() & finite & F.exists(x, lambda v: v != 0))
        .withColumn("dim", F.size("embedding"))
    )


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def build(vectors: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The index: dim, shard and path of a tree of every shard, written to the shared folder.

    Rows are dealt by a hash of their place in the table, so neither a common vector nor a common id fills a shard. No usable vectors: no trees.
    """
    spark = vectors.sparkSession
    folder = shared_dir(spark, "trees")
    ready = usable(vectors)
    norm2 = F.aggregate("embedding", F.lit(0.0), lambda a, v: a + v * v)
    n, largest = ready.agg(F.count("*"), F.max(norm2)).first()
    shards = max(1, -(-n // shard_rows))
    norm = float(largest or 0) ** 0.5

    def grow(table: pa.Table) -> pa.Table:
        dim, shard = table["dim"][0].as_py(), table["shard"][0].as_py()
        name = f"tree-{dim:06d}-{shard:08d}.npz"
        put(folder, name, Tree(_matrix(table["embedding"]), table["vec_id"].to_numpy(), norm).to_bytes())
        return pa.table({"dim": pa.array([dim], pa.int32()), "shard": pa.array([shard], pa.int64()), "path": [f"{folder}/{name}"]})

    dealt = ready.withColumn("shard", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)))
    return written(dealt.groupBy("dim", "shard").applyInArrow(grow, "dim int, shard long, path string"), "trees")


def _query_blocks(queries: DataFrame, blocks: int) -> DataFrame:
    """dim and path of each block of queries, written to the shared folder. ``queries``: written, one row an id."""
    folder = shared_dir(queries.sparkSession, "query-blocks")

    def save(table: pa.Table) -> pa.Table:
        dim, block = table["dim"][0].as_py(), table["block"][0].as_py()
        out, name = io.BytesIO(), f"queries-{dim:06d}-{block:08d}.npz"
        np.savez(out, ids=table["vec_id"].to_numpy(), vectors=_matrix(table["embedding"]))
        put(folder, name, out.getvalue())
        return pa.table({"dim": pa.array([dim], pa.int32()), "block_path": [f"{folder}/{name}"]})

    dealt = queries.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(b"q")), F.lit(blocks)))
    return written(dealt.groupBy("dim", "block").applyInArrow(save, "dim int, block_path string"), "blocks")


def _opened_tree(path: str) -> Tree:
    with opened(path) as file:
        return Tree.from_bytes(file.read())


def calibrated(index: DataFrame, queries: DataFrame, k: int = K) -> tuple[float, float, float]:
    """The largest factor that keeps the recall wanted in a sample of bounded size, that recall, and the share of all inner products made with it.

    ``queries``: vec_id, embedding, dim of usable vectors. The dimension with the most trees is sampled; the trees and queries are picked by a hash.
    """
    top = index.groupBy("dim").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").first()
    if top is None:
        return 1.0, 1.0, 1.0
    trees = [_opened_tree(r.path) for r in index.filter(F.col("dim") == top.dim).orderBy(F.xxhash64("shard")).limit(SAMPLE_TREES).collect()]
    rows = queries.filter(F.col("dim") == top.dim).orderBy(F.xxhash64("vec_id", F.lit(SEED))).limit(SAMPLE_QUERIES).collect()
    if not rows:
        return 1.0, 1.0, 1.0
    ids, vectors = np.array([r.vec_id for r in rows], dtype=np.int64), np.array([r.embedding for r in rows])
    exact = [tree.nearest(ids, vectors, k, 1.0) for tree in trees]
    size = len(ids) * sum(len(t.vectors) for t in trees)
    chosen = 1.0, 1.0, sum(x.compared for x in exact) / size
    for factor in FACTORS[1:]:
        tried = [tree.nearest(ids, vectors, k, factor) for tree in trees]
        there = [np.isfinite(x.score) for x in exact]
        hits = [(t.score >= np.where(m, x.score, np.inf).min(axis=1, keepdims=True)) & np.isfinite(t.score) for t, x, m in zip(tried, exact, there)]
        recall = sum(h.sum() for h in hits) / max(1, sum(m.sum() for m in there))
        if recall < RECALL:
            break
        chosen = factor, float(recall), sum(t.compared for t in tried) / size
    return chosen


def search(index: DataFrame, queries: DataFrame, k: int = K, factor: float | None = None, block: int = QUERY_BLOCK) -> DataFrame:
    """Each query's k nearest rows found: query_id, rank, vec_id, score.

    Nearest first, ties to the smaller vec_id. Queries see vectors of their own dimension; rows with the query's vec_id are left out; queries that are
    no usable vectors find nothing; of several queries with one id the least vector counts. Without a ``factor`` the calibrated one is taken. Queries go in blocks of ``block`` rows at
    most about. Each task takes a block through a group of trees one after the other and gives out k rows a query; all tasks are one job. Only
    the paths of trees and blocks are joined, by dimension; tasks read both from the shared folder, one tree at a time.
    """
    spark = index.sparkSession
    ready = written(usable(queries).groupBy("vec_id").agg(F.min("embedding").alias("embedding")).withColumn("dim", F.size("embedding")), "queries")
    factor = calibrated(index, ready, k)[0] if factor is None else factor
    n, trees, cores = ready.count(), max(1, index.count()), spark.sparkContext.defaultParallelism
    blocks = max(1, -(-n // block), min(-(-n // LEAST_BLOCK), 2 * cores // trees))
    together = max(1, trees * blocks // (64 * cores))
    groups = index.groupBy("dim", F.floor(F.col("shard") / together).alias("group")).agg(F.sort_array(F.collect_list("path")).alias("paths"))
    units = _query_blocks(ready, blocks).join(groups, "dim").select("block_path", "paths")

    def look(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, tree_paths in zip(*(c.to_pylist() for c in batch.columns)):
                with opened(path) as file, np.load(io.BytesIO(file.read())) as parts:
                    found = Found(parts["ids"], parts["vectors"], k)
                for tree_path in tree_paths:
                    here = _opened_tree(tree_path).nearest(found.query_ids, found.queries, k, factor)
                    who, place = np.nonzero(np.isfinite(here.score))
                    found.merge(who, here.id[who, place], here.score[who, place])
                yield found.batch()

    dealt = units.repartition(max(1, min(trees * blocks, 64 * cores)))  # by turns: units are alike
    found = written(dealt.mapInArrow(look, "query_id long, vec_id long, score double"), "neighbours")
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
