"""Connected components of an edge table: forests within tasks, then alternating star contraction of what they leave."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import written

#: Edges that a task holds at once.
EDGES = 1 << 19


def least_reached(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The least place each of n rows reaches over the links."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[left], root[right])
        new = root.copy()
        np.minimum.at(new, root[left], low)
        np.minimum.at(new, root[right], low)
        while (new != new[new]).any():
            new = new[new]
        if (new == root).all():
            return root
        root = new


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect the same nodes: from each node, except the least of its component, to that least one."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    root = least_reached(len(nodes), at[: len(a)], at[len(a) :])
    moved = root != np.arange(len(nodes))
    return nodes[moved], nodes[root[moved]]


def forests(edges: DataFrame, held: int) -> DataFrame:
    """Edges that connect the same nodes, fewer than nodes in each task: stars of ``held`` edges at a time, gone over again with the next."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, fresh = [], [], 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(a[0]), pa.array(b[0])], names=["a", "b"])

        for batch in batches:
            a.append(batch.column(0).to_numpy())
            b.append(batch.column(1).to_numpy())
            fresh += batch.num_rows
            if fresh > held:
                x, y = stars(np.concatenate(a), np.concatenate(b))
                a, b, fresh = [x], [y], 0
                if len(x) > held:
                    yield out()
                    a, b = [], []
        if a:
            x, y = stars(np.concatenate(a), np.concatenate(b))
            a, b = [x], [y]
            yield out()

    return edges.select("a", "b").mapInArrow(run, "a long, b long")


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node's larger neighbours are hung on the least node around it."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = written(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours are hung on the least of these. Edges run from the larger to the smaller."""
    least = written(edges.groupBy("a").agg(F.min("b").alias("m")), "least")
    moved = edges.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, held: int = EDGES) -> DataFrame:
    """Nodes that have links, each with the least node it reaches: node, root.

    ``edges``: a, b (long). As long as there are more than ``held`` edges, tasks take forests of their own ones and what these leave is contracted in rounds, which grow with
    the logarithm of a component's size; the last ``held`` are one task's forest. Every round is written to the shared folder; minima are summed up before the shuffle, and
    what is joined is written first, so that Spark can split a hub's rows.
    """
    edges = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), "edges")
    seen = None
    while (n := edges.count()) > held:
        if seen is None:
            edges = written(forests(edges.coalesce(-(-n // held)), held), "forests")
        sign = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        if sign == seen:
            break
        seen = sign
        edges = written(_small_star(written(_large_star(edges), "large-star")), "small-star")
    else:
        edges = written(forests(edges.coalesce(1), held), "forests")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
