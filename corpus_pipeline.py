"""From raw documents to packed sequences: toxicity, near-duplicates, personal data, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept. All but the last return the columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import jaccard, mixing, packing, pii, toxicity
from quern.llm.common import written
from quern.session import table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored under 0.5 stay; the net learns from the labelled rows among ``docs`` that are not held out.

    Null and empty texts are scored as such; very long ones by all their windows; repeated rows get one score and stay or go together. No labels: all stay. No
    documents: none stay. Other columns come back as they are, whatever their names.
    """
    net = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, net).filter("score < 0.5").select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents connected by a Jaccard similarity of their five-word shingles of 0.8 or more, the one of the smallest doc_id stays.

    Fingerprints are compared in tiles and what they link is checked by whole sets; similar texts whose fingerprints lie further apart are found by prefixes of their sets.
    Texts of fewer words are one shingle; null, empty and blank texts are copies of each other; null ids come last. Of rows of one id and text one stays.
    Very long texts are read in parts. No documents: none stay. Other columns come back as they are, whatever their names.
    """
    return jaccard.survivors(docs)


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays, with surrogates for personal data and secrets in its text and ``n_chars`` measured anew.

    Null texts stay null (and so is their n_chars), empty ones empty; very long ones are replaced whole; repeated rows get equal texts. No documents: none. Other
    columns come back as they are, whatever their names.
    """
    new = {"text": F.col("new_text"), "n_chars": F.length("new_text").cast("long")}
    return pii.replace(docs).select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's rate and their coin say, 0 to 3 times.

    Null sources are one source; null and empty texts have no words and weigh nothing; repeated rows are told apart where only some of them belong in the mix.
    A source without words gives none. No documents: none. Columns come back as they are, whatever their names.
    """
    return mixing.emit(mixing.mix(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 1024 ids.

    Null and empty texts are their end id alone; very long ones are cut over several sequences; repeated rows are packed row by row. No documents: no pieces. Only
    doc_id and text are read.
    """
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("surrogates", replace_personal_data),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: A trained net decides what stays, which SQL cannot express; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written as Parquet and read again as the next one's documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
