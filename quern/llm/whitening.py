"""Embedding whitening with an exact scatter matrix in residue numbers.

Entries become integers. Partitions multiply their vectors, with a one appended, modulo several primes: the residues are small enough for a matrix product in
double precision to be exact. Residues of all partitions are added up in a tree, and Chinese remaindering gives back the exact number of vectors, sums and scatter. The
covariance is centred in integers and rounded to double only then, so it loses nothing however far the vectors lie from zero; its eigenvectors whiten.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm import trees
from quern.llm.common import written

#: x = floor(SCALE * c) + SHIFT
SCALE, SHIFT = 1024, 100_000
#: Components at most.
COMPONENTS = 8
#: Primes lie below 2 ** BITS; so many rows are multiplied before the products are reduced: a sum of them stays below 2 ** 53.
BITS, STEP = 22, 512
#: Integers beyond this are refused: n * x has to fit in 64 bits.
MOST = 1 << 31


def primes(least: int) -> list[int]:
    """The largest primes below 2 ** BITS whose product is over ``least``."""
    found, product, p = [], 1, (1 << BITS) - 1
    while product <= least:
        if all(p % q for q in range(3, int(p**0.5) + 1, 2)):
            found.append(p)
            product *= p
        p -= 2
    return found


def remaindered(residues: dict[int, np.ndarray]) -> np.ndarray:
    """Chinese remaindering: the integers (as Python's own, of any size, signed) with these residues by prime."""
    product, total = 1, 0
    for p in residues:
        product *= p
    for p, r in residues.items():
        rest = product // p
        total = total + r.astype(object) * (rest * pow(rest, -1, p))
    total = total % product
    return np.where(total > product // 2, total - product, total)


def residue_scatter(x: np.ndarray, p: int) -> np.ndarray:
    """Scatter of integer rows (with a one appended) modulo a prime, exactly."""
    total = np.zeros((x.shape[1] + 1,) * 2, dtype=np.int64)
    for i in range(0, len(x), STEP):
        part = np.mod(x[i : i + STEP], p).astype(np.float64)
        part = np.column_stack([part, np.ones(len(part))])
        total = (total + (part.T @ part).astype(np.int64) % p) % p
    return total


def usable(vectors: DataFrame) -> tuple[DataFrame, int]:
    """vec_id and vector (of doubles) of the rows that take part, and their length.

    Left out are vectors that are null or empty, hold null or non-finite entries, or have another length than most have (ties to the longer).
    """
    c: Column = F.col("embedding").cast("array<double>")
    fine = F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), c.alias("vector")).filter(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & fine)
    sizes = rows.groupBy(F.size("vector").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    d = sizes[0].d if sizes else 0
    return rows.filter(F.size("vector") == d), d


def integers(column: pa.Array, d: int) -> np.ndarray:
    """x of a batch of vectors."""
    scaled = np.floor(SCALE * column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)) + SHIFT
    if scaled.size and np.abs(scaled).max() >= MOST:
        raise ValueError(f"entries beyond {MOST // SCALE} cannot be scaled")
    return scaled.astype(np.int64)


def exact_scatter(rows: DataFrame, d: int) -> tuple[int, list[int], np.ndarray]:
    """n, sums per dimension and the scatter matrix of x, all exact. What comes to the driver is d * d numbers for each prime."""
    chosen = primes(2 * rows.count() * MOST * MOST)

    def products(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {p: np.zeros((d + 1, d + 1), dtype=np.int64) for p in chosen}
        for batch in batches:
            x = integers(batch.column(0), d)
            for p in chosen:
                total[p] = (total[p] + residue_scatter(x, p)) % p
        yield trees.parts(chosen, TaskContext.get().partitionId(), list(total.values()))

    made = rows.select("vector").mapInArrow(products, trees.PARTS)
    summed = trees.tree_sum(made, "<i8", "scatter", lambda arrays, p: arrays.sum(axis=0) % p).collect()
    whole = remaindered({r.slot: trees.unpacked(r["values"], "<i8").reshape(d + 1, d + 1) for r in summed})
    return int(whole[d, d]), [int(v) for v in whole[d, :d]], whole[:d, :d]


@dataclass
class Whitening:
    """n and exact sums of the vectors it was fitted to; components (columns) over the square roots of their eigenvalues; eigenvalues' shares of the trace."""

    n: int
    sums: np.ndarray
    scaled: np.ndarray
    explained: np.ndarray

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exactly."""
        return self.n * x - self.sums

    def apply(self, x: np.ndarray) -> np.ndarray:
        return (self.centred(x) / self.n) @ self.scaled


def covariance(n: int, sums: list[int], scatter: np.ndarray) -> np.ndarray:
    """The covariance (divisor n), centred in integers, each entry rounded to double once."""
    s = np.array(sums, dtype=object)
    centred = n * scatter - np.outer(s, s)
    return np.array([[v / (n * n) for v in row] for row in centred.tolist()], dtype=np.float64).reshape(len(sums), len(sums))


def fit(rows: DataFrame, d: int, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of all ``rows``; None without any. Components whose eigenvalue is zero up to rounding are left out, as nothing can be divided by it."""
    if not d:
        return None
    n, sums, scatter = exact_scatter(rows, d)
    if 2 * n * MOST >= 1 << 63:
        raise ValueError("too many vectors for sums of 64 bits")
    values, vectors = np.linalg.eigh(covariance(n, sums, scatter))
    values, vectors = values[::-1], vectors[:, ::-1]
    trace = values.sum()
    k = int((values[:components] > max(trace, 0) * d * np.finfo(np.float64).eps).sum())
    return Whitening(n, np.array(sums, dtype=np.int64), vectors[:, :k] / np.sqrt(values[:k]), values[:k] / trace if k else values[:0])


def identity_error(rows: DataFrame, d: int, net: Whitening) -> float:
    """The largest absolute entry of the whitened vectors' covariance minus the identity, over all ``rows``: their mean first, then centred products, in trees."""
    k = net.scaled.shape[1]

    def total(make, size: int, name: str) -> np.ndarray:
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = np.zeros(size)
            for batch in batches:
                found += make(net.apply(integers(batch.column(0), d))).ravel()
            yield trees.parts([0], TaskContext.get().partitionId(), [found])

        summed = trees.tree_sum(rows.select("vector").mapInArrow(run, trees.PARTS), "<f8", name, lambda arrays, _: arrays.sum(axis=0))
        return trees.unpacked(summed.first()["values"], "<f8") / net.n

    mean = total(lambda w: w.sum(axis=0), k, "means")
    products = total(lambda w: (w - mean).T @ (w - mean), k * k, "products")
    return float(np.abs(products.reshape(k, k) - np.eye(k)).max())


def deviation(centred: np.ndarray) -> np.ndarray:
    """Sums of squares, exact; an error where one does not fit in 64 bits."""
    most = int(np.abs(centred).max()) if centred.size else 0
    if most * most * centred.shape[1] < 1 << 63:
        return (centred * centred).sum(axis=1)
    return np.array([sum(v * v for v in row) for row in centred.tolist()], dtype=object)


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error of every usable row and component.

    Vectors that are null or empty, hold null or non-finite entries, or have another length than most take no part, neither in the fit. Repeated rows and ids are rows
    of their own; null ids stay null. Fewer components come out where the vectors have fewer directions; none where all are equal, and none from an empty table. Entries
    beyond 2,097,054, or a deviation over 64 bits, are an error. Only vec_id and embedding are read, so other columns cannot clash.
    """
    rows, d = usable(vectors)
    rows = written(rows, "vectors")
    net = fit(rows, d, components)
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if net is None or not net.scaled.shape[1]:
        return vectors.sparkSession.createDataFrame([], schema)
    error, k = identity_error(rows, d, net), net.scaled.shape[1]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = integers(batch.column(1), d)
            n = len(x)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(np.repeat(np.arange(n), k))),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), n)),
                    pa.array(np.full(n * k, net.n)),
                    pa.array(np.repeat(deviation(net.centred(x)), k), pa.int64()),
                    pa.array(net.apply(x).ravel()),
                    pa.array(np.tile(net.explained, n)),
                    pa.array(np.full(n * k, error)),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(run, schema)
