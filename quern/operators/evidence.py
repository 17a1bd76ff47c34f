"""Selecting and grading evidence."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators import hierarchy

#: Fixed counts of the outline.
PARTS, STAGES = 11, 7


def parse_topic(topic: str) -> tuple[str, str | None]:
    """'direction＋question' (full-width or ASCII plus) as (direction, question); no plus: no question."""
    direction, plus, question = topic.replace("+", "＋").partition("＋")
    return direction.strip(), (question.strip() or None) if plus else None


def select_direction(docs: DataFrame, direction: str, question: str | None = None) -> DataFrame:
    """Documents of a direction; with a question, those whose text contains it, case aside. Null texts match no question."""
    kept = docs.filter(F.col("source") == direction)
    return kept if question is None else kept.filter(F.lower("text").contains(question.lower()))


def restrict_to_whitelist(docs: DataFrame, titles: Iterable[str] | DataFrame) -> DataFrame:
    """Documents whose source is listed: a filter pushed to the scan for a list, a semi join for a table of any size."""
    if isinstance(titles, DataFrame):
        return docs.join(titles.select(F.col(titles.columns[0]).alias("source")), "source", "left_semi")
    return docs.filter(F.col("source").isin(*titles))


def provenance(docs: DataFrame) -> DataFrame:
    """Per source and language: documents found, first and last."""
    return docs.groupBy("source", "lang").agg(
        F.count("*").alias("n_found"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc")
    )


def _level(quality: Column) -> Column:
    return F.when(quality == 1, "verified metadata").when(quality == 0, "unverified metadata").otherwise("title only")


def with_level(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents with their evidence level; every row stays pending until its full text is reviewed."""
    graded = labels.select("doc_id", F.col("quality").alias("_quality"))
    return docs.join(graded, "doc_id", "left").withColumn("level", _level(F.col("_quality"))).withColumn("pending_review", F.lit(True)).drop("_quality")


def hot_groups(docs: DataFrame, labels: DataFrame, k: int) -> DataFrame:
    """The k sources with most verified documents, ties to the smaller name."""
    verified = labels.filter(F.col("quality") == 1).select("doc_id")
    return (
        docs.select("doc_id", "source", "n_chars")
        .join(verified, "doc_id", "left_semi")
        .groupBy("source")
        .agg(F.count("*").alias("n_verified"), F.sum("n_chars").alias("verified_chars"))
        .orderBy(F.desc("n_verified"), F.asc("source"))
        .limit(k)
    )


def outline(directions: DataFrame, gap: str | None = None, point: str | None = None) -> DataFrame:
    """Of each direction (the rows and columns given) the numbered placeholder rows of a proposal and of the writing guidance, marked as drafts, with the research gap and
    innovation point that were chosen."""

    def rows(kind: str, word: str, n: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.struct(F.lit(kind).alias("kind"), i.alias("number"), F.concat(F.lit(f"{word} "), i.cast("string")).alias("title")))

    drafted = directions.select("*", F.inline(F.concat(rows("proposal", "part", PARTS), rows("guidance", "stage", STAGES))))
    chosen = {"gap": F.lit(gap).cast("string"), "point": F.lit(point).cast("string")}
    return drafted.withColumns({"status": F.lit("draft, pending full-text review"), **chosen})


def directions_under(directions: DataFrame, root: str) -> DataFrame:
    """direction_id, name and depth of a direction and all below it, however deep. ``directions``: direction_id (different ones), parent_id, name.

    Of two directions of that name, one below the other, what is below both counts from the nearer. Directions in a circle are below nothing.
    """
    links = directions.select(F.col("direction_id").alias("id"), F.col("parent_id").alias("parent"))
    found = hierarchy.below(links, directions.filter(F.col("name") == root).select(F.col("direction_id").alias("id")))
    return found.join(directions.select(F.col("direction_id").alias("id"), "name"), "id").select(F.col("id").alias("direction_id"), "name", F.col("depth").cast("int").alias("depth"))
