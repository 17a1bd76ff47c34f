"""Ranking documents for many questions at once by BM25 over an inverted index whose blocks carry bounds.

Documents are dealt to ranges of about ``BLOCK``. A term's postings in a range are one row of the index, its block, with the largest weight in it. For a question, the sum of its terms' bounds
over a range is the most that any document there can score. The ranges of the highest sums are scored first; the k-th best score found there is a threshold that
the final k-th best cannot fall below, and ranges whose sum stays under it are never opened.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.functions import text as topics
from quern.session import broadcast_up_to, landed, shared_dir
from quern.sources import files

#: Fixed parameters of BM25.
K1, B = 1.2, 0.75
#: Documents to a range, about; ranges of a question that are scored first; digits of a score.
BLOCK, PROBED, DIGITS = 64, 4, 6
#: Documents to a bucket of the index, about; buckets at most.
DEALT, BUCKETS = 512, 4096


@dataclass
class Index:
    """``blocks``: term, range, bound, n, postings (row, doc_id, weight). ``terms``: term, idf."""

    blocks: DataFrame
    terms: DataFrame


def build(docs: DataFrame, block: int = BLOCK) -> Index:
    """An index of doc_id and text, in two written tables. Every row is a document, also of a repeated or null id; null and empty texts count as documents without terms.

    Postings are grouped by range and term, so a term that all documents have is a block in each range, and no row grows with the corpus. Documents are shuffled once, whole, by range;
    blocks are made where they land and are written bucketed by range, so that searching shuffles none of them.
    """
    n = docs.count()
    buckets = max(1, min(BUCKETS, -(-n // DEALT)))
    dealt = landed(docs.select("doc_id", topics.occurrences(F.col("text")).alias("terms"), F.monotonically_increasing_id().alias("row")), "terms")
    length = dealt.agg(F.avg(F.size("terms"))).first()[0] or 1.0
    dealt = dealt.withColumn("range", F.pmod(F.xxhash64("row"), F.lit(-(-n // block) or 1))).repartition(buckets, "range")
    counts = dealt.select("range", "row", "doc_id", F.size("terms").alias("size"), F.explode("terms").alias("term")).groupBy("range", "row", "doc_id", "size", "term").agg(F.count("*").alias("tf"))
    weight = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("size") / length))
    posted = counts.select("term", "range", F.struct("row", "doc_id", weight.alias("weight")).alias("posting"))
    blocks = posted.groupBy("range", "term").agg(F.collect_list("posting").alias("postings"), F.max("posting.weight").alias("bound"))
    blocks = blocks.select("term", "range", "bound", F.size("postings").alias("n"), "postings")
    blocks = files.write_bucketed(blocks, shared_dir(docs.sparkSession, "blocks"), "range", buckets)
    idf = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return Index(blocks, landed(blocks.groupBy("term").agg(F.sum("n").alias("df")).select("term", idf.alias("idf")), "idf"))


def asked(index: Index, questions: DataFrame) -> DataFrame:
    """query_id, term and idf of the different terms of every question that the index has. Questions of one id are one."""
    wanted = questions.select("query_id", F.explode(topics.terms(F.col("text"))).alias("term")).distinct()
    return landed(index.terms.join(broadcast_up_to(wanted), "term").select("query_id", "term", "idf"), "asked")


def bounded(index: Index, wanted: DataFrame) -> DataFrame:
    """query_id, range, bound (the most a document there can score) and the number of the question's blocks there."""
    met = index.blocks.select("term", "range", "bound").join(broadcast_up_to(wanted), "term")
    sums = met.groupBy("query_id", "range").agg(F.sum(F.col("bound") * F.col("idf")).alias("bound"), F.count("*").alias("blocks"))
    return landed(sums, "bounds")


def scored(index: Index, wanted: DataFrame, ranges: DataFrame) -> DataFrame:
    """query_id, row, doc_id and score of all documents of the given ranges (query_id, range) that have a term of their question."""
    readers = ranges.groupBy("range").agg(F.collect_set("query_id").alias("readers"))  # a range meets all its questions where its blocks lie
    blocks = index.blocks.join(readers.hint("shuffle_hash"), "range").join(broadcast_up_to(wanted), "term").filter(F.array_contains("readers", F.col("query_id")))
    parts = blocks.select("query_id", "range", "idf", F.explode("postings").alias("p")).select("query_id", "range", "p.row", "p.doc_id", (F.col("p.weight") * F.col("idf")).alias("part"))
    return parts.groupBy("query_id", "range", "row", "doc_id").agg(F.round(F.sum("part"), DIGITS).alias("score")).drop("range")


def _best(found: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "row"))
    return found.withColumn("rank", place).filter(F.col("rank") <= k)


def opened(index: Index, wanted: DataFrame, k: int, probed: int = PROBED) -> DataFrame:
    """The rows of bounded() with ``read``: whether a range has to be scored. It has, if its bound reaches the question's threshold."""
    bounds = bounded(index, wanted)
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("bound"), "range"))
    first = landed(bounds.withColumn("_place", place).filter(F.col("_place") <= probed).select("query_id", "range"), "probed")
    threshold = _best(scored(index, wanted, first), k).filter(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
    slack = 10.0 ** -DIGITS  # scores are rounded, bounds are not
    return bounds.join(broadcast_up_to(landed(threshold, "threshold")), "query_id", "left").withColumn("read", F.coalesce(F.col("bound") >= F.col("least") - slack, F.lit(True)))


def search(index: Index, questions: DataFrame, k: int) -> DataFrame:
    """query_id, rank, doc_id and score of each question's k best documents; ties go to the smaller id, null ids last. A question without known terms has none.

    ``questions``: query_id and text. Exact: what is skipped cannot be among the k best.
    """
    wanted = asked(index, questions)
    ranges = landed(opened(index, wanted, k).filter("read").select("query_id", "range"), "ranges")
    return _best(scored(index, wanted, ranges), k).select("query_id", "rank", "doc_id", "score")


def skipped(index: Index, questions: DataFrame, k: int) -> float:
    """The share of the questions' blocks that search() leaves closed."""
    sums = opened(index, asked(index, questions), k).agg(F.sum("blocks").alias("all"), F.sum(F.when(~F.col("read"), F.col("blocks"))).alias("closed")).first()
    return (sums.closed or 0) / sums.all if sums.all else 0.0
