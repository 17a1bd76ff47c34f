"""Joins that Spark has no operator for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.session import broadcast_up_to, landed

#: Slices of a number that an as-of join goes by.
SLICES = 64
#: Pairs that a part of a node makes, about; tasks at most.
PAIRS, TASKS = 1 << 22, 8192


def asof_join(left: DataFrame, right: DataFrame, by: str, at: str, columns: list[str], slice_of: Column | None | str = "day") -> DataFrame:
    """Each left row with the ``columns`` of the right row of its key that is last at or before it; null where there is none.

    Both sides go through one shuffle and one sort by (key, time), with no join and no row made twice: a window carries the last right row on. Among
    right rows of one time the largest ``columns`` win. Null times on the left match nothing, null keys match null keys.

    A key with very many rows is cut into slices of time: ``slice_of`` turns the time column ``_at`` into a slice (by default days, if it is a time, and ``SLICES`` quantiles of the right
    side, if it is a number); each slice is one window, and the last right row of every slice (one row each) is carried into the slices after it. None: a key's rows
    are one window, which saves a join where no key has many rows.
    """
    if isinstance(slice_of, str):
        kind = left.schema[at].dataType.typeName()
        if kind.startswith("timestamp") or kind == "date":
            slice_of = F.date_trunc(slice_of, "_at")
        else:
            cuts = right.select(F.col(at).cast("double").alias("_at")).approxQuantile("_at", [k / SLICES for k in range(1, SLICES)], 0.005)
            slice_of = F.size(F.filter(F.array(*[F.lit(x) for x in cuts]).cast("array<double>"), lambda x: x <= F.col("_at")))
    packed = F.struct(*[F.col(c) for c in columns])
    kind = right.select(packed.alias("x")).schema[0].dataType
    keys = [F.col(by).alias("_by"), F.col(at).alias("_at")]
    l = left.select(F.struct("*").alias("_row"), *keys, F.lit(1).alias("_side"), F.lit(None).cast(kind).alias("_v"))
    no_row = F.lit(None).cast(l.schema["_row"].dataType).alias("_row")
    r = right.filter(F.col(at).isNotNull()).select(no_row, *keys, F.lit(0).alias("_side"), packed.alias("_v"))
    both = l.unionByName(r)
    order = [F.col("_at").asc_nulls_first(), F.col("_side"), F.col("_v")]
    if slice_of is None:
        last = F.last("_v", ignorenulls=True).over(W.partitionBy("_by").orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
        found = both.withColumn("_found", last)
    else:
        both = both.withColumn("_slice", slice_of)
        ends = both.groupBy("_by", "_slice").agg(F.max(F.when(F.col("_side") == 0, F.struct("_at", "_v"))).alias("_end"))
        slices = ends.withColumn("_before", F.last("_end", ignorenulls=True).over(W.partitionBy("_by").orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)))
        slices = slices.select(F.col("_by").alias("_b"), F.col("_slice").alias("_s"), F.col("_before._v").alias("_carry"))
        last = F.last("_v", ignorenulls=True).over(W.partitionBy("_by", "_slice").orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
        found = both.withColumn("_found", last).filter("_side = 1").join(slices, F.col("_by").eqNullSafe(F.col("_b")) & F.col("_slice").eqNullSafe(F.col("_s")), "left")
        found = found.withColumn("_found", F.coalesce("_found", "_carry"))
    timed = F.when(F.col("_at").isNotNull(), F.col("_found"))
    return found.filter("_side = 1").withColumn("_found", timed).select("_row.*", *[F.col(f"_found.{c}").alias(c) for c in columns])


def position(at: Column, kind: str, granule: float) -> Column:
    """The granule (a whole number) that a time (granules in seconds) or number lies in."""
    if kind.startswith("timestamp") or kind == "date":
        return F.floor(F.unix_micros(at.cast("timestamp")) / F.lit(granule * 1_000_000)).cast("long")
    return F.floor(at.cast("double") / F.lit(granule)).cast("long")


def cover(start: Column, end: Column) -> Column:
    """The dyadic nodes (level, node: the granules from node * 2 ** level on, 2 ** level of them) that make up [start, end), whole numbers, start < end.

    At each level at most one at either side, so their number grows with the logarithm of the length.
    """

    def at(level: Column) -> Column:
        size = F.call_function("shiftleft", F.lit(1).cast("long"), level)
        first, after = F.call_function("shiftright", start + size - 1, level), F.call_function("shiftright", end, level)
        node = lambda n: F.struct(level.alias("level"), n.alias("node"))
        left = F.when((first < after) & (F.pmod(first, F.lit(2)) == 1), node(first))
        right = F.when((first < after) & (F.pmod(after, F.lit(2)) == 1), node(after - 1))
        return F.array_compact(F.array(left, right))

    return F.flatten(F.transform(F.sequence(F.lit(0), F.floor(F.log2(end - start)).cast("int")), at))


def range_join(points: DataFrame, intervals: DataFrame, at: str, start: str, end: str, width: float, by: str | None = None) -> DataFrame:
    """Pairs of points and intervals with start <= at < end (and equal ``by`` columns, if given, which both sides have), by an equi-join on dyadic nodes.

    An interval is cut into nodes of its own length's scale, a few more rows than the logarithm of its length in granules of ``width`` (seconds for times), so very long ones neither
    explode nor meet all others in one bucket; a point has one row for each scale that any interval uses. A point lies in one node of an interval at most, so each
    pair is found once. Pick ``width`` near the shortest usual length. Nulls and intervals that end before they start match nothing.
    """
    kinds = [df.schema[c].dataType.typeName() for df, c in ((points, at), (intervals, start), (intervals, end))]
    fine = intervals.filter(F.col(end) > F.col(start))
    right = fine.withColumn("_n", F.explode(cover(position(F.col(start), kinds[1], width), position(F.col(end), kinds[2], width) + 1)))
    right = right.withColumn("_level", F.col("_n.level")).withColumn("_node", F.col("_n.node")).drop("_n")
    levels = sorted(r._level for r in right.select("_level").distinct().collect())  # 64 at most
    nodes = F.explode(F.array(*[F.lit(k) for k in levels]).cast("array<int>"))
    left = points.filter(F.col(at).isNotNull()).withColumn("_level", nodes).withColumn("_node", F.call_function("shiftright", position(F.col(at), kinds[0], width), F.col("_level")))
    found = dealt_join(left, right, [*([by] if by else []), "_level", "_node"])
    return found.filter((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).drop("_level", "_node")


def dealt_join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner equi-join whose work is dealt by the pairs it makes, which may be many times the rows: few keys, or small tables, are not few tasks.

    Rows of both sides are counted by key first. A key of over ``PAIRS`` pairs is cut into a grid of parts: left rows go to a random strip, right rows to a random column, and each is repeated
    along the other side. There are as many tasks as the pairs ask for.
    """
    sizes = left.groupBy(*keys).agg(F.count("*").alias("_l")).join(right.groupBy(*keys).agg(F.count("*").alias("_r")), keys)
    parts = F.ceil(F.col("_l").cast("double") * F.col("_r") / PAIRS)
    strips = F.least(parts, F.col("_l")).cast("int")
    hot = landed(sizes.withColumn("_strips", strips).withColumn("_columns", F.ceil(parts / F.col("_strips")).cast("int")), "sizes")
    pairs = hot.agg(F.sum(F.col("_l").cast("double") * F.col("_r")).alias("n")).first().n or 0.0
    shuffled = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = int(min(max(pairs // PAIRS + 1, shuffled), max(TASKS, shuffled)))
    hot = broadcast_up_to(hot.filter("_strips > 1 OR _columns > 1").select(*keys, "_strips", "_columns"))
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))

    def dealt(side: DataFrame, own: str, other: str) -> DataFrame:
        cut = side.withColumn(f"{own}_", F.monotonically_increasing_id()).join(hot, keys, "left")
        cut = cut.withColumn(own, F.pmod(F.xxhash64(f"{own}_"), F.coalesce(own, F.lit(1))).cast("int")).withColumn(other, every(F.coalesce(other, F.lit(1))))
        return cut.drop(f"{own}_").repartition(tasks, *keys, "_strips", "_columns")

    return dealt(left, "_strips", "_columns").join(dealt(right, "_columns", "_strips"), [*keys, "_strips", "_columns"]).drop("_strips", "_columns")


def interval_join(left: DataFrame, right: DataFrame, left_span: tuple[str, str], right_span: tuple[str, str], width: float, by: str | None = None) -> DataFrame:
    """Pairs of intervals [start, end) that overlap (and have equal ``by`` columns). Other columns have to have different names.

    Of two that overlap the later start lies in the other one: two range joins, of right starts in left intervals and of left starts in right ones, without the
    pairs that start together, find each pair once. Nulls and empty intervals match nothing.
    """
    (a, b), (c, d) = left_span, right_span
    left, right = left.filter(F.col(b) > F.col(a)), right.filter(F.col(d) > F.col(c))
    if clash := (set(left.columns) & set(right.columns)) - {by}:
        raise ValueError(f"both sides have {sorted(clash)}")
    later = range_join(right, left, c, a, b, width, by)
    earlier = range_join(left, right, a, c, d, width, by).filter(F.col(a) > F.col(c))
    return later.unionByName(earlier).select(*left.columns, *[x for x in right.columns if x != by])


def salted_join(big: DataFrame, small: DataFrame, key: str, salts: int = 16) -> DataFrame:
    """Inner equi-join that deals each key's big-side rows over ``salts`` tasks; the small side is repeated once per salt.

    Salts go by a row's place in its table, so equal rows are dealt too; ``big`` is to be read from a table, where a repeated task finds each row at the same place.
    """
    left = big.withColumn("_salt", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(salts)))
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return left.join(right, [key, "_salt"]).drop("_salt")
