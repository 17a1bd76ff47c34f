"""Near copies: all pairs of texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more, and no others.

First the sets' fingerprints are compared by exclusive-or and bit counts in tiles, as ``simhash`` does, and the pairs within ``RADIUS`` bits that whole sets confirm are linked. A fingerprint promises
no bound (sets with a similarity of 0.8 lie up to some 14 bits apart, where all tiles would have to meet), so what lies further apart is found exactly, by prefixes.

Sets that are so similar share at least four fifths of the larger one. So if all shingles have one order, the first ``size // 5 + 1`` of both sets (their
prefixes) share one. Common shingles, as counted in a sample, come last in that order, which keeps the groups of texts around a shingle small; the sample
decides the work only, never the result. Pairs that meet in a group and share enough of their prefixes are compared by counts of
their shingles in 256 cells, which never differ by more than the sets do, and what is left by whole sets.
All pairs of a group come out, once for each shingle they share, in groups of less than ``LARGE`` texts only: no more rows than the groups have. In the others each text meets few others first, at the
first of these shingles that it has, several times and in another order each time; then pairs meet that are not connected yet, so that
many copies aren't compared pair by pair. There only texts that have the shared shingle in the first ninth of their own order meet those of their size or more: the first shingle that
similar sets share lies there in the smaller one. Texts that merely share a template have it further back, so a group of them makes no pairs at all. Cells are compared within the task, and
a pair comes out where it meets first, as far as the first shingles of both tell, not at every shingle that it shares.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from quern.llm import simhash, tokens
from quern.llm.common import give_back, join_small, written
from quern.llm.graph import components

SHINGLE = 5
#: Bits that linked fingerprints may differ by, and blocks of bits they are dealt by: two of eight agree, 16 bits.
RADIUS, BLOCKS = 6, 8
#: Documents in whose texts common shingles are counted, about; texts from which on a shingle is common; common shingles at most.
SAMPLE, COMMON, MOST = 10_000, 4, 100_000
#: Texts of a shingle from which on few others are met first, how many, and how often, each time in another order.
LARGE, FEW, TURNS = 4, 2, 2
#: A text's first shingles of large groups that go with it: at these it meets few, and by them a pair tells whether it has met before.
HEAD = 8
#: Pairs that a task holds before it gives them out.
_HELD = 1 << 17
#: Pairs whose cells are compared at once.
_STEP = 1 << 13


def shingles(text: str) -> np.ndarray:
    """The hashes of a text's different shingles, sorted. Words are those of the fingerprints; of fewer than five all are the one shingle."""
    parts = [simhash._shingle_hashes(words, SHINGLE) for words in simhash._parts(text.encode("utf-8", "surrogatepass").lower(), SHINGLE) if words]
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, "<u8")


def _enough(common: Column, a: Column, b: Column) -> Column:
    """Whether sets of sizes a and b that share ``common`` have a similarity of 0.8 or more."""
    return 9 * common >= 4 * (a + b)


def common_shingles(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (sorted) of shingles that are common in a sample, and their counts."""

    def make(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(shingles(text.as_py()).view(np.int64))], names=["shingle"])

    every = max(1, docs.count() // SAMPLE)
    sample = docs.filter(F.col("text").isNotNull() & (F.pmod(F.xxhash64("text"), F.lit(every)) == 0)).select("text")
    counts = sample.mapInArrow(make, "shingle long").groupBy("shingle").agg(F.count("*").alias("n")).filter(F.col("n") >= COMMON)
    found = counts.orderBy(F.desc("n"), "shingle").limit(MOST).toArrow()
    hashes, n = found.column(0).to_numpy().view(np.uint64), found.column(1).to_numpy()
    order = np.argsort(hashes)
    return hashes[order], n[order]


def prefix(found: np.ndarray, common: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The first shingles of a set: those that aren't common by hash, then common ones by count."""
    hashes, counts = common
    rank = np.zeros(len(found), dtype=np.int64)
    if len(hashes) and len(found):
        at = np.minimum(np.searchsorted(hashes, found), len(hashes) - 1)
        rank = np.where(hashes[at] == found, counts[at], 0)
    return found[np.lexsort((found, rank))[: len(found) // 5 + 1]]


def prints(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, key (of the set), size, cells (a byte each, 255 at most), prefix and fp (the set's fingerprint) of every row. Null texts count as empty."""
    common = common_shingles(docs)

    def make(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens.forget()
        for batch in batches:
            keys, sizes, cells, prefixes, fps = [], [], [], [], []
            for text in batch.column(2):
                found = shingles(text.as_py())
                keys.append(xxh64_intdigest(found.tobytes(), simhash.SEED))
                sizes.append(len(found))
                cells.append(np.minimum(np.bincount((found & 255).astype(np.int64), minlength=256), 255).astype(np.uint8).tobytes())
                prefixes.append(prefix(found, common).view(np.int64))
                fps.append(simhash.majority([found]))
            key = pa.array(np.array(keys, dtype=np.uint64).view(np.int64))
            arrays = [batch.column(0), batch.column(1), key, pa.array(sizes, pa.int64()), pa.array(cells, pa.binary()), pa.array(prefixes, pa.list_(pa.int64()))]
            arrays.append(pa.array(np.array(fps, dtype=np.uint64).view(np.int64)))
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "text_hash", "key", "size", "cells", "prefix", "fp"])
        give_back()

    slim = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.coalesce("text", F.lit("")).alias("text"))
    return slim.mapInArrow(make, "doc_id long, text_hash long, key long, size long, cells binary, prefix array<long>, fp long")


def meetings(token: np.ndarray, size: np.ndarray, root: np.ndarray, every: bool, first: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of pairs of one token, of different roots and of sizes that allow enough similarity, among rows sorted by token: of each row with
    the ``FEW`` after it, or all (then sorted by size within a token). ``first``: which rows may be the earlier of a pair; all by default."""
    left, step = np.arange(len(token)) if first is None else np.flatnonzero(first), 1

    def fit(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return (token[left] == token[right]) & (4 * size[right] <= 5 * size[left]) & (every | (4 * size[left] <= 5 * size[right]))

    while (every or step <= FEW) and len(left := left[left + step < len(token)]):
        met = left[fit(left, left + step)]
        apart = met[root[met] != root[met + step]]
        yield apart, apart + step
        left, step = met if every else left, step + 1


def _dealt(rows: DataFrame, order: list[str], find, out: str) -> DataFrame:
    """``find`` over whole groups of rows (token, size, key, root, pos, and cells and head if there) of one token, as arrays; it gives batches of the schema ``out``."""
    names = ["token", "size", "key", "root", "pos", *(["cells", "head"] if "cells" in rows.columns else [])]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = [[] for _ in names]

        def close(last: bool) -> Iterator[pa.RecordBatch]:
            columns = [np.concatenate(x) for x in held]
            end = len(columns[0]) if last else int(np.searchsorted(columns[0], columns[0][-1]))
            for k, x in enumerate(columns):
                held[k] = [x[end:]]
            yield from find(*(x[:end] for x in columns))

        for batch in batches:
            for k in range(5):
                held[k].append(batch.column(k).to_numpy())
            if len(names) > 5:
                held[5].append(np.frombuffer(b"".join(batch.column(5).to_pylist()), dtype=np.uint8).reshape(-1, 256))
                held[6].append(batch.column(6).flatten().to_numpy().reshape(-1, HEAD))
            if any(len(x) and x[0] != held[0][-1][-1] for x in held[0] if batch.num_rows):  # else the first group is still open
                yield from close(False)
        if held[0]:
            yield from close(True)
        held.clear()
        give_back()

    dealt = rows.repartition("token").sortWithinPartitions("token", *order).select(*names)
    return dealt.mapInArrow(run, out)


def tokens_of(classes: DataFrame) -> DataFrame:
    """token, size, key, root and pos (its place in the order) of every shingle of every prefix. ``classes``: key, size, prefix, root."""
    return classes.select(F.posexplode("prefix").alias("pos", "token"), "size", "key", "root").select("token", "size", "key", "root", F.col("pos").cast("long").alias("pos"))


def groups(classes: DataFrame) -> DataFrame:
    """token, size, key and pos of the rows whose token texts share, whether ``LARGE`` texts or more do (large), and whether any of them may be the smaller one of a pair (met)."""

    def find(token: np.ndarray, size: np.ndarray, key: np.ndarray, root: np.ndarray, pos: np.ndarray) -> Iterator[pa.RecordBatch]:
        start, end = np.searchsorted(token, token), np.searchsorted(token, token, "right")
        keep, large = end - start > 1, end - start >= LARGE
        before = np.concatenate([[0], np.cumsum(leads(size, pos))])
        met = before[end] > before[start]
        yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (token, size, key, pos, large, met)], names=["token", "size", "key", "pos", "large", "met"])

    return _dealt(tokens_of(classes.withColumn("root", F.col("key"))), ["size", "key"], find, "token long, size long, key long, pos long, large boolean, met boolean")


def large_groups(classes: DataFrame) -> DataFrame:
    """token, size, key, pos and met of the rows of large groups."""
    return groups(classes).filter("large").drop("large")


def marked(classes: DataFrame, met: DataFrame) -> DataFrame:
    """key, cells and head (its first ``HEAD`` tokens in their order, the first one again where there are fewer) of the texts in the large groups ``met``."""
    in_order = F.slice(F.array_sort(F.collect_list(F.struct("pos", "token"))), 1, HEAD)["token"]
    heads = met.groupBy("key").agg(in_order.alias("head"))
    heads = heads.select("key", F.slice(F.concat("head", F.array_repeat(F.col("head")[0], HEAD)), 1, HEAD).alias("head"))
    return heads.join(classes.select("key", "cells"), "key")


def leads(size: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """Whether the first shingle that a set shares with a similar one, no smaller, may stand at this place: they share eight ninths of it at least."""
    return 9 * pos <= size


def apart(cells: np.ndarray, size: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Which pairs' cells differ by more than a ninth of both sizes, as sets with a similarity of 0.8 never do."""
    out = np.zeros(len(left), dtype=bool)
    for i in range(0, len(left), _STEP):
        a, b = left[i : i + _STEP], right[i : i + _STEP]
        differ = np.abs(cells[a].astype(np.int16) - cells[b]).sum(axis=1, dtype=np.int64)
        out[i : i + _STEP] = 9 * differ > size[a] + size[b]
    return out


def met_before(token: np.ndarray, head: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Which pairs surely share a token that comes before this one in their order: one of the left text's head before its place there, that is in the right text's head."""
    out = np.zeros(len(left), dtype=bool)
    for i in range(0, len(left), _STEP):
        a, b = left[i : i + _STEP], right[i : i + _STEP]
        earlier = ~np.logical_or.accumulate(head[a] == token[a, None], axis=1)
        out[i : i + _STEP] = (earlier & (head[a, :, None] == head[b, None, :]).any(axis=2)).any(axis=1)
    return out


def meet(rows: DataFrame, every: bool, turn: int = 0) -> DataFrame:
    """a, b, size_a and size_b of pairs of keys that meet at a shingle of their prefixes, once for each such shingle. ``rows``: token, size, key, root, pos.

    With ``cells`` and ``head`` in the rows, pairs that cells tell apart are left out before they leave the task; if every pair meets, the smaller one has to lead, and pairs that have met before are left out too.
    """

    def find(
        token: np.ndarray, size: np.ndarray, key: np.ndarray, root: np.ndarray, pos: np.ndarray, cells: np.ndarray | None = None, head: np.ndarray | None = None
    ) -> Iterator[pa.RecordBatch]:
        def out(found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
            left, right = (np.concatenate(x) for x in zip(*found))
            swap = key[left] > key[right]
            left, right = np.where(swap, right, left), np.where(swap, left, right)
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (key[left], key[right], size[left], size[right])], names=["a", "b", "size_a", "size_b"])

        found, n = [], 0
        for left, right in meetings(token, size, root, every, leads(size, pos) if every and cells is not None else None):
            if cells is not None and every:
                new = ~met_before(token, head, left, right)
                left, right = left[new], right[new]
            if cells is not None:
                near_ = ~apart(cells, size, left, right)
                left, right = left[near_], right[near_]
            found.append((left, right))
            n += len(left)
            if n > _HELD:
                yield out(found)
                found, n = [], 0
        if n:
            yield out(found)

    ordered = rows.withColumn("_order", F.xxhash64("key", F.lit(turn)))
    return _dealt(ordered, ["size", "key"] if every else ["_order", "key"], find, "a long, b long, size_a long, size_b long")


def fingerprint_candidates(classes: DataFrame) -> DataFrame:
    """Pairs a, b of keys whose fingerprints link, compared in tiles as ``simhash`` does; of the keys of one fingerprint the least meets the others and stands for them."""
    firsts = written(classes.groupBy("fp").agg(F.min("key").alias("first")), "fingerprint-classes")
    equal = join_small(classes.select("fp", "key"), firsts, "fp").filter(F.col("key") != F.col("first")).select("first", "key")
    one, other = (firsts.select(F.col("fp").alias(c), F.col("first").alias(f"first_{c}")) for c in ("a", "b"))
    linked = written(simhash.links(firsts.select("fp"), RADIUS, BLOCKS), "links").join(one, "a").join(other, "b").select("first_a", "first_b")
    both = equal.union(linked).toDF("a", "b")
    return both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def few_candidates(large: DataFrame, turn: int) -> DataFrame:
    """Pairs a, b of keys of large groups that cells don't tell apart, each text with few others at the tokens of its head, in an order of its own for each ``turn``."""
    return meet(large.filter(F.array_contains("head", F.col("token"))), False, turn).select("a", "b").distinct()


def candidates(small: DataFrame, large: DataFrame, unmet: DataFrame) -> DataFrame:
    """All pairs a, b of keys that meet, are of different roots and may be similar. ``small``: the rows of small groups; ``large``: those of large ones, with cells and head.

    Pairs that meet in a large group come out as they are. Of the others ``shared`` is what they share in small groups, where all pairs are counted. Beyond it their sets share the rest of one of
    them at most, and what the smaller one has in large groups without leading there (``unmet``: key and how many, written); pairs for which this isn't enough go.
    """
    met = meet(small, True).groupBy("a", "b", "size_a", "size_b").agg(F.count("*").alias("shared"))
    rest = F.greatest(*[F.col(c) - F.floor(F.col(c) / 5) - 1 for c in ("size_a", "size_b")])
    more = [unmet.select(F.col("key").alias(c), F.col("unmet").alias(f"unmet_{c}")) for c in ("a", "b")]
    met = met.join(more[0], "a", "left").join(more[1], "b", "left")
    hidden = F.greatest(*[F.coalesce(f"unmet_{c}", F.lit(0)) for c in ("a", "b")])
    counted = met.filter(_enough(F.col("shared") + rest + hidden, F.col("size_a"), F.col("size_b"))).select("a", "b")
    return counted.unionByName(meet(large, True).select("a", "b")).distinct()


def near(classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs whose cells differ by a ninth of both sizes at most, as the sets themselves do at a similarity of 0.8."""

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, other = (np.frombuffer(b"".join(batch.column(k).to_pylist()), dtype=np.uint8).reshape(-1, 256).astype(np.int16) for k in (3, 4))
            differ = np.abs(one - other).sum(axis=1, dtype=np.int64)
            keep = pa.array(9 * differ <= batch.column(2).to_numpy())
            yield batch.select([0, 1]).filter(keep)
        give_back()

    one, other = (classes.select(F.col("key").alias(c), F.col("size").alias(f"size_{c}"), F.col("cells").alias(f"cells_{c}")) for c in ("a", "b"))
    both = pairs.join(one, "a").join(other, "b")
    return both.select("a", "b", (F.col("size_a") + F.col("size_b")).alias("sizes"), "cells_a", "cells_b").mapInArrow(compare, "a long, b long")


def similar(docs: DataFrame, classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (already written) whose whole sets have a similarity of 0.8 or more. Only texts that are in a pair are read into sets again."""

    def make(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in zip(batch.column(0), batch.column(1)):
                yield pa.RecordBatch.from_arrays([pa.array([key.as_py()]), pa.array([shingles(text.as_py()).view(np.int64)], pa.list_(pa.int64()))], names=["key", "shingles"])
        give_back()

    wanted = pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct()
    wanted = written(wanted.join(classes, "key").select("key", "text_hash"), "wanted")
    texts = join_small(docs.select(F.xxhash64("text").alias("text_hash"), "text"), wanted, "text_hash").dropDuplicates(["key"]).select("key", "text")
    sets = written(texts.mapInArrow(make, "key long, shingles array<long>"), "sets")
    one, other = (sets.select(F.col("key").alias(c), F.col("shingles").alias(f"set_{c}")) for c in ("a", "b"))
    both = pairs.join(one, "a").join(other, "b")
    common = F.size(F.array_intersect("set_a", "set_b"))
    return both.filter(_enough(common, F.size("set_a"), F.size("set_b"))).select("a", "b")


def near_copies(docs: DataFrame) -> DataFrame:
    """Every row's doc_id, text_hash and root: the same for all texts that are connected by similar pairs. Texts without words are copies of each other."""
    found = written(prints(docs), "prints")
    classes = found.groupBy("key").agg(F.min("text_hash").alias("text_hash"), *[F.first(c).alias(c) for c in ("size", "cells", "prefix", "fp")])
    classes = written(classes, "classes")
    shared, edges, roots = written(groups(classes), "groups"), None, None
    large = shared.filter("large AND met")
    marks = written(marked(classes, large), "marks")
    rooted = lambda rows: (
        rows.withColumn("root", F.col("key")) if roots is None else rows.join(roots, F.col("key") == F.col("node"), "left").withColumn("root", F.coalesce("root", "key")).drop("node")
    )
    for turn in range(-1, TURNS + 1):
        every = turn == TURNS
        if turn < 0:
            met = fingerprint_candidates(classes)
        elif every:
            unmet = written(shared.filter("large AND 9 * pos > size").groupBy("key").agg(F.count("*").alias("unmet")), "unmet")
            met = candidates(rooted(shared.filter("NOT large")), rooted(large).join(marks, "key"), unmet)
        else:
            met = few_candidates(rooted(large).join(marks, "key"), turn)
        pairs = written(near(classes, written(met, "pairs")), "near")
        more = written(similar(docs, classes, pairs), "similar")
        edges = more if edges is None else edges.unionByName(more)
        if every or not more.isEmpty():
            roots = written(components(edges), "roots")
    return found.join(roots, F.col("key") == F.col("node"), "left").select("doc_id", "text_hash", F.coalesce("root", "key").alias("root"))


def survivors(docs: DataFrame) -> DataFrame:
    """The input rows that stay: of near copies the one of the smallest doc_id, as for fingerprints."""
    return simhash.first_of_each(docs, near_copies(docs))
