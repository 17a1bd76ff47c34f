"""Hierarchies of any depth, climbed by path doubling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.session import landed


def climb(links: DataFrame) -> DataFrame:
    """id, top (the id above all that are above it), depth (steps up to it) and looped, of every row of ``links`` (id, parent).

    Ids are different. A null parent, or one that is no id, ends the way up. Every round doubles the steps that a row has taken, so a chain of 10,000 takes 14 rounds; rows that have
    arrived are joined no more, and each round is a written table, so that Spark can split the rows below a parent of very many. A row that has not arrived after as many
    rounds as the longest possible way needs leads into a circle: looped is true, top and depth are null.
    """
    known = links.select(F.col("id").alias("_known"))
    start = links.join(known, F.col("parent") == F.col("_known"), "left")
    ends = F.col("_known").isNull()
    ways = landed(start.select("id", F.coalesce("_known", "id").alias("to"), F.when(ends, 0).otherwise(1).cast("long").alias("steps"), ends.alias("arrived")), "ways")
    n = ways.count()
    for _ in range(max(1, n).bit_length() + 1):
        moving = ways.filter("NOT arrived")
        if moving.isEmpty():
            break
        above = ways.select(F.col("id").alias("_id"), F.col("to").alias("_to"), F.col("steps").alias("_steps"), F.col("arrived").alias("_arrived"))
        moved = moving.join(above, F.col("to") == F.col("_id")).select("id", F.col("_to").alias("to"), (F.col("steps") + F.col("_steps")).alias("steps"), F.col("_arrived").alias("arrived"))
        ways = landed(ways.filter("arrived").unionByName(moved), "ways")
    there = F.col("arrived")
    return ways.select("id", F.when(there, F.col("to")).alias("top"), F.when(there, F.col("steps")).alias("depth"), (~there).alias("looped"))


def below(links: DataFrame, roots: DataFrame) -> DataFrame:
    """id, top and depth of the given roots (id) and of all that is below one of them; below two, the nearer counts."""
    cut = links.join(roots.select(F.col("id").alias("_root")).distinct(), F.col("id") == F.col("_root"), "left")
    found = climb(cut.select("id", F.when(F.col("_root").isNull(), F.col("parent")).alias("parent")))
    return found.join(roots.select(F.col("id").alias("top")).distinct(), "top", "left_semi").select("id", "top", "depth")
