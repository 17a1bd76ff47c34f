"""SimHash near-duplicates by tiled exact comparison.

A fingerprint is the majority of the bits of its shingles' hashes. Equal fingerprints are one class. Classes are compared exactly, tile against
tile, with exclusive-or and bit counts in numpy, and tile pairs whose population counts differ by more than the radius are
skipped. Only classes that agree in enough of the fingerprint's blocks are ever put into one tile: with ``BLOCKS`` blocks,
fingerprints at most ``RADIUS`` bits apart agree in BLOCKS - RADIUS of them at least, so each choice of that many blocks deals classes to buckets by the
bits there, and no link is lost. A bucket larger than a tile is cut by population count, then by hash, and its tile pairs become
work units of their own, so a hot bucket is dealt over many tasks.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from quern.llm.common import join_small, written
from quern.llm.graph import components, least_reached

SEED, SHINGLE, RADIUS, BLOCKS = 42, 3, 2, 4
#: Classes to a tile.
TILE = 1024
#: Rows compared at once.
_STEP = 512
_CHUNK = 1 << 16
#: Bytes of a text whose words are split at once.
_PART = 1 << 22
_BLANK = re.compile(rb"[ \t-\r]")
_WEIGHT = 64


def _shingle_hashes(words: list[bytes], shingle: int = SHINGLE) -> np.ndarray:
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths).tolist()
    ends = ends[min(shingle, len(words)) - 1 :].tolist()
    return np.fromiter(map(xxh64_intdigest, map(joined.__getitem__, map(slice, starts, ends)), repeat(SEED)), dtype="<u8", count=len(ends))


def _parts(data: bytes, shingle: int = SHINGLE) -> Iterator[list[bytes]]:
    """The words of a text in lists that overlap by all but one word of a shingle, so that memory does not grow with the text."""
    at, carried, out = 0, [], False
    while at < len(data):
        blank = _BLANK.search(data, min(at + _PART, len(data)))
        end = blank.start() if blank else len(data)
        words = carried + data[at:end].split()
        at = end
        if len(words) >= shingle:
            yield words
            out = True
        carried = words[1 - shingle :]
    if not out:
        yield carried


def fingerprint(text: str) -> int:
    """The fingerprint of a whole text: A-Z lowered, words split at ASCII blanks, 3-word shingles with repeats.

    Fewer words: all of them are the one shingle; none: zero.
    """
    return majority(_shingle_hashes(words) for words in _parts(text.encode("utf-8", "surrogatepass").lower()) if words)


def majority(parts: Iterable[np.ndarray]) -> int:
    """The bits that are set in over half of all hashes; zero without hashes."""
    counts, n = np.zeros(_WEIGHT, dtype=np.int64), 0
    for hashes in parts:
        n += len(hashes)
        for i in range(0, len(hashes), _CHUNK):
            part = hashes[i : i + _CHUNK]
            counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0]) if n else 0


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash (of the text) and fp (as a signed long) of every row. Null texts count as empty."""

    def make(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(t.as_py()) for t in batch.column(2)), dtype=np.uint64, count=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found.view(np.int64))], names=["doc_id", "text_hash", "fp"])

    slim = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.coalesce("text", F.lit("")).alias("text"))
    return slim.mapInArrow(make, "doc_id long, text_hash long, fp long")


def _masks(radius: int, blocks: int) -> list[int]:
    """For each choice of blocks - radius blocks, the mask of their bits (as a signed long)."""
    edges = [64 * k // blocks for k in range(blocks + 1)]
    block = [(1 << edges[k + 1]) - (1 << edges[k]) for k in range(blocks)]
    masks = [sum(block[k] for k in chosen) for chosen in combinations(range(blocks), blocks - radius)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _units(classes: DataFrame, radius: int, blocks: int, tile: int) -> DataFrame:
    """Work units: unit, side (0 or 1: compare with the other side; 2: compare all), pc, fp.

    A bucket within a tile's size is one unit. A larger one is cut to tiles of one population count each, and each pair of tiles whose counts differ by
    the radius at most is a unit.
    """
    masks = F.array(*[F.lit(m) for m in _masks(radius, blocks)])
    keyed = classes.select("fp", F.bit_count("fp").cast("int").alias("pc"), F.posexplode(masks).alias("table", "mask"))
    keyed = keyed.select("fp", "pc", F.xxhash64("table", F.col("fp").bitwiseAND(F.col("mask"))).alias("bucket"))
    per_count = keyed.groupBy("bucket", "pc").agg(F.count("*").alias("n"))
    hot = (
        per_count.groupBy("bucket")
        .agg(F.sum("n").alias("all"), F.collect_list(F.struct("pc", F.ceil(F.col("n") / tile).cast("int").alias("m"))).alias("tiles"))  # 65 counts at most
        .filter(F.col("all") > tile)
        .select("bucket", "tiles")
    )
    found = join_small(keyed, written(hot, "hot-buckets"), "bucket", how="left")
    cold = found.filter("tiles IS NULL").select(F.col("bucket").alias("unit"), F.lit(2).alias("side"), "pc", "fp")
    own = F.get(F.filter("tiles", lambda t: t["pc"] == F.col("pc")), F.lit(0))["m"]
    cut = found.filter("tiles IS NOT NULL").withColumn("sub", F.pmod(F.xxhash64(F.col("fp"), F.lit(7)), own).cast("int"))
    near = F.filter("tiles", lambda t: F.abs(t["pc"] - F.col("pc")) <= radius)
    other = F.flatten(F.transform(near, lambda t: F.transform(F.sequence(F.lit(0), t["m"] - 1), lambda s: F.struct(t["pc"].alias("pc"), s.alias("sub")))))
    pairs = cut.select("bucket", "pc", "sub", "fp", F.explode(other).alias("o"))
    mine, theirs = F.struct("pc", "sub"), F.struct("o.pc", "o.sub")
    unit = F.xxhash64("bucket", F.least(mine, theirs), F.greatest(mine, theirs))
    side = F.when(mine == theirs, 2).when(mine < theirs, 0).otherwise(1)
    return cold.unionByName(pairs.select(unit.alias("unit"), side.alias("side"), "pc", "fp"))


def linked(unit: np.ndarray, side: np.ndarray, pc: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of all linked pairs among rows sorted by unit and population count."""
    left, right, n = [], [], len(fp)
    for i in range(0, n, _STEP):
        a = slice(i, min(i + _STEP, n))
        for j in range(i, n, _STEP):
            b = slice(j, min(j + _STEP, n))
            if unit[b.start] > unit[a.stop - 1]:
                break
            alone = unit[a.start] == unit[b.stop - 1]
            if alone and (pc[b].min() - pc[a].max() > radius or pc[a].min() - pc[b].max() > radius):
                continue
            near = np.bitwise_count(fp[a, None] ^ fp[None, b]) <= radius
            near &= unit[a, None] == unit[None, b]
            sides = side[a, None] + side[None, b]
            near &= (sides == 1) | (sides == 4)
            if i == j:
                near = np.triu(near, 1)
            x, y = np.nonzero(near)
            left.append(x + i)
            right.append(y + j)
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, int), np.zeros(0, int))


def links(classes: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, tile: int = TILE) -> DataFrame:
    """Edges a, b that join up all classes within the radius of each other.

    Within a unit all pairs are compared, and the edges from each class to the least that it reaches there come out: as many as its rows, never
    all pairs, and they connect just what the pairs connect.
    """

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = [[], [], [], []]

        def close(last: bool) -> pa.RecordBatch | None:
            unit, side, pc, fp = (np.concatenate(x) for x in held)
            end = len(unit) if last else int(np.searchsorted(unit, unit[-1]))
            for k, x in enumerate((unit, side, pc, fp)):
                held[k] = [x[end:]]
            unit, side, pc, fp = (x[:end] for x in (unit, side, pc, fp))
            same = np.zeros(end, dtype=bool)
            if end > 1:
                same[1:] = unit[1:] == unit[:-1]
                same[:-1] |= same[1:]
            unit, side, pc, fp = (x[same] for x in (unit, side, pc, fp))
            if not len(fp):
                return None
            root = least_reached(len(fp), *linked(unit, side, pc, fp.view(np.uint64), radius))
            moved = root != np.arange(len(fp))
            return pa.RecordBatch.from_arrays([pa.array(fp[moved]), pa.array(fp[root[moved]])], names=["a", "b"])

        for batch in batches:
            for k in range(4):
                held[k].append(batch.column(k).to_numpy())
            if (out := close(False)) is not None:
                yield out
        if held[0] and (out := close(True)) is not None:
            yield out

    units = _units(classes, radius, blocks, tile).repartition("unit").sortWithinPartitions("unit", "pc", "fp")
    return units.mapInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Every row's doc_id, text_hash, fp, root (its component's least fingerprint) and component_id: the smallest doc_id reachable over
    links, its own row's included.

    Null texts count as empty; texts without words have fingerprint zero and are linked like others; very long ones are read in parts. Only doc_id and text are
    read, so other columns cannot clash. Null doc_ids are never the
    smallest, unless a component has no other (then component_id is null). Repeated rows share a class. An empty table gives none. Rows are shuffled as
    fingerprints only; classes are found before any comparison, so that copies cost one row each.
    """
    prints = written(fingerprints(docs), "fingerprints")
    classes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "classes")
    roots = written(components(links(classes.select("fp"), radius)), "roots")
    rooted = written(classes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root")), "rooted")
    least = written(rooted.groupBy("root").agg(F.min("first_id").alias("component_id")), "least")
    labelled = written(rooted.select("fp", "root").join(least, "root").select("fp", "root", "component_id"), "labelled")
    return prints.join(labelled, "fp").select("doc_id", "text_hash", "fp", "root", "component_id")


def survivors(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """The input rows that stay: of each component the one of the smallest doc_id, null ids last.

    Among rows of that doc_id in a component, the smallest text hash stays, once. All columns of the input come back unchanged. Texts are
    shuffled once, by id and text hash.
    """
    return first_of_each(docs, near_duplicates(docs, radius))


def first_of_each(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, by the doc_id, text_hash and root that ``found`` has of every row."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none_"), F.coalesce("doc_id", F.lit(-1)).alias("id_"), F.col("text_hash").alias("hash_")))
    kept = written(found.groupBy("root").agg(first.alias("first")).select("first.*").distinct(), "survivors")
    rows = docs.select(F.struct("*").alias("row"), F.coalesce("doc_id", F.lit(-1)).alias("id_"), F.col("doc_id").isNull().alias("none_"), F.xxhash64("text").alias("hash_"))
    joined = rows.join(kept.hint("merge"), ["id_", "none_", "hash_"], "left_semi")  # as files ids are small, broadcast they'd be many times that
    return joined.dropDuplicates(["id_", "none_", "hash_"]).select("row.*")
