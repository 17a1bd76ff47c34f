"""Evidence selection (Track A): restricting, matching and ranking documents as evidence.

``documents`` stands for papers, ``source`` for the journal, ``lang`` for its language, and a
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import text as topics
from quern.operators import evidence, search, termsets
from quern.plans.registry import Registry
from quern.session import shared_dir, table
from quern.sources import crossref, papers

REGISTRY = Registry()

#: The stand-in for a whitelist of titles.
WHITELIST = ("src1", "src2", "src3", "src5", "src8", "src13")
DIRECTION, QUESTION = "src0", "the"


@REGISTRY.add(
    "hot_sources_verified",
    """SELECT d.source, CAST(count(*) AS BIGINT) AS n_verified, CAST(sum(d.n_chars) AS BIGINT) AS verified_chars
    FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality = 1)
    GROUP BY d.source ORDER BY n_verified DESC, d.source ASC LIMIT 5""",
)
def hot_sources_verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1 (B5, B8): the five sources with most verified documents; ties go to the smaller name."""
    return evidence.hot_groups(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), k=5)


@REGISTRY.add("docs_by_source", f"SELECT doc_id, lang, source, n_chars FROM documents WHERE source = '{DIRECTION}'")
def docs_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2 (B3): documents of one broad direction."""
    return evidence.select_direction(table(spark, sf_dir, "documents"), DIRECTION).select("doc_id", "lang", "source", "n_chars")


@REGISTRY.add(
    "docs_matching_question",
    f"SELECT doc_id, source FROM documents WHERE source = '{DIRECTION}' AND contains(lower(text), '{QUESTION}')",
)
def docs_matching_question(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3 (B4): documents of a direction that also match a refined question."""
    spec = evidence.parse_topic(f"{DIRECTION}＋{QUESTION}")
    return evidence.select_direction(table(spark, sf_dir, "documents"), *spec).select("doc_id", "source")


@REGISTRY.add(
    "docs_in_whitelist",
    f"SELECT doc_id, source, lang FROM documents WHERE source IN {WHITELIST}",
)
def docs_in_whitelist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4 (B5): documents of whitelisted sources."""
    return evidence.restrict_to_whitelist(table(spark, sf_dir, "documents"), WHITELIST).select("doc_id", "source", "lang")


@REGISTRY.add(
    "evidence_list",
    f"""SELECT source, lang, CAST(count(*) AS BIGINT) AS n_found, min(doc_id) AS first_doc, max(doc_id) AS last_doc
    FROM documents WHERE source IN {WHITELIST} GROUP BY source, lang""",
)
def evidence_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5 (B7): the sources asked in each language, with what was found."""
    return evidence.provenance(evidence.restrict_to_whitelist(table(spark, sf_dir, "documents"), WHITELIST))


@REGISTRY.add(
    "evidence_level",
    """SELECT d.doc_id, CASE WHEN l.quality = 1 THEN 'verified metadata' WHEN l.quality = 0 THEN 'unverified metadata'
    ELSE 'title only' END AS level, true AS pending_review
    FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
)
def evidence_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A6 (B16): every document with its evidence level, all pending full-text review."""
    return evidence.with_level(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select("doc_id", "level", "pending_review")


_HOT = """(SELECT source AS direction, count(*) AS n_verified FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)
    GROUP BY source ORDER BY n_verified DESC, source LIMIT 5)"""
_OUTLINE = """(SELECT 'proposal' AS kind, CAST(i AS INTEGER) AS number, 'part ' || i AS title FROM range(1, 12) t(i)
    UNION ALL SELECT 'guidance', CAST(i AS INTEGER), 'stage ' || i FROM range(1, 8) t(i))"""


@REGISTRY.add("outline_rows", f"SELECT direction, kind, number, title FROM {_HOT}, {_OUTLINE}")
def outline_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A7 (B12, B13): for each of the five hot directions the numbered parts of a proposal and stages of the guidance, with placeholder titles."""
    hot = evidence.hot_groups(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), k=5)
    return evidence.outline(hot.select(F.col("source").alias("direction"))).select("direction", "kind", "number", "title")


GAP, POINT = "gap 2", "point 3"


@REGISTRY.add("outline_for_choice", f"SELECT direction, CAST(n_verified AS BIGINT) AS n_verified, kind, number, title, '{GAP}' AS gap, '{POINT}' AS point FROM {_HOT}, {_OUTLINE}")
def outline_for_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B11 to B13: the outlines of the hot directions for the gap and the point that the user chose, with the verified documents each rests on."""
    hot = evidence.hot_groups(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), k=5)
    return evidence.outline(hot.select(F.col("source").alias("direction"), "n_verified"), GAP, POINT).drop("status")


#: A declared tree of directions (id, parent, name): the data of the knowledge base is not supplied, so the sources stand for sub-directions.
DIRECTIONS = [(1, None, "all"), (2, 1, "systems"), (3, 1, "management"), (4, 2, "adoption"), (5, 4, "src0"), (6, 4, "src3"), (7, 3, "src7"), (8, 2, "src9")]
#: Declared rules (B2): the least characters and the languages that a direction's evidence needs.
EVIDENCE_RULES = [("systems", 200, "en"), ("systems", 400, "de"), ("management", 100, "en")]


@REGISTRY.add(
    "docs_under_direction",
    f"""WITH RECURSIVE d(id, parent, name) AS (VALUES {', '.join(f"({i}, {'NULL' if p is None else p}, '{n}')" for i, p, n in DIRECTIONS)}),
    t(id, name, depth) AS (SELECT id, name, 0 FROM d WHERE name = 'systems' UNION ALL SELECT d.id, d.name, depth + 1 FROM d JOIN t ON d.parent = t.id)
    SELECT doc_id, source, depth FROM documents JOIN t ON source = name""",
)
def docs_under_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B1, B3: documents of a broad direction and of all directions below it."""
    tree = evidence.directions_under(spark.createDataFrame(DIRECTIONS, "direction_id int, parent_id int, name string"), "systems")
    return table(spark, sf_dir, "documents").join(F.broadcast(tree), F.col("source") == F.col("name")).select("doc_id", "source", "depth")


@REGISTRY.add(
    "docs_by_rules",
    f"""WITH RECURSIVE d(id, parent, name) AS (VALUES {', '.join(f"({i}, {'NULL' if p is None else p}, '{n}')" for i, p, n in DIRECTIONS)}),
    r(root, least, lang) AS (VALUES {', '.join(map(str, EVIDENCE_RULES))}),
    t(root, id, name) AS (SELECT name, id, name FROM d WHERE name IN ('systems', 'management') UNION ALL SELECT t.root, d.id, d.name FROM d JOIN t ON d.parent = t.id)
    SELECT doc_id, t.root AS direction FROM documents x JOIN t ON source = name JOIN r ON r.root = t.root AND r.lang = x.lang WHERE n_chars >= least""",
)
def docs_by_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B2: documents that meet the rules declared for their direction."""
    declared = spark.createDataFrame(DIRECTIONS, "direction_id int, parent_id int, name string")
    rules = F.broadcast(spark.createDataFrame(EVIDENCE_RULES, "direction string, least int, rule_lang string"))
    trees = [evidence.directions_under(declared, root).select(F.lit(root).alias("of"), "name") for root in ("systems", "management")]
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars").join(F.broadcast(trees[0].unionByName(trees[1])), F.col("source") == F.col("name"))
    met = (F.col("of") == F.col("direction")) & (F.col("lang") == F.col("rule_lang")) & (F.col("n_chars") >= F.col("least"))
    return docs.join(rules, met).select("doc_id", "direction")


@REGISTRY.add(
    "works_in_whitelist",
    f"SELECT '10.1/' || doc_id AS doi, substr(text, 1, 40) AS title, source AS journal, CAST(2000 + doc_id % 25 AS INTEGER) AS year, lang FROM documents WHERE source IN {WHITELIST}",
)
def works_in_whitelist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B6: works landed as JSON lines (made of the documents here; a title is a text's first 40 characters), read, and kept if their journal is listed. Each landed twice; the later year counts."""
    title, year = F.array(F.substring("text", 1, 40)), (2000 + F.col("doc_id") % 25).cast("int")
    dated = lambda y: F.struct(F.array(F.array(y, F.lit(1))).alias("date-parts"))
    docs, path = table(spark, sf_dir, "documents"), shared_dir(spark, "works")
    doi = F.concat(F.lit("10.1/"), F.col("doc_id").cast("string"))
    for at in (year, year - 1):
        work = F.struct(doi.alias("DOI"), title.alias("title"), F.array("source").alias("container-title"), dated(at).alias("published"), F.col("lang").alias("language"))
        docs.select(F.to_json(work).alias("value")).write.mode("append").text(path)
    titles = spark.createDataFrame([(w,) for w in WHITELIST], "journal string")
    return papers.read_works(spark, path).join(F.broadcast(titles), "journal", "left_semi").select("doi", "title", "journal", "year", "lang")


SINCE = 2010


@REGISTRY.add(
    "works_discovered",
    f"""SELECT '10.1/' || doc_id AS doi, md5(text) AS title_digest, source AS journal, CAST(2000 + doc_id % 25 AS INTEGER) AS year, lang FROM documents
    WHERE source IN {WHITELIST} AND 2000 + doc_id % 25 >= {SINCE}""",
)
def works_discovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B5, B6: works of listed journals since a year, from the source of works; the filters are the source's own. Documents are landed as its pages, a text as the title."""
    path, doi = shared_dir(spark, "pages"), F.concat(F.lit("10.1/"), F.col("doc_id").cast("string"))
    docs = table(spark, sf_dir, "documents").select(doi.alias("doi"), F.col("text").alias("title"), F.col("source").alias("journal"), (2000 + F.col("doc_id") % 25).cast("int").alias("year"), "lang")
    crossref.land(docs, path)
    found = crossref.works(spark, path=path).filter(F.col("journal").isin(*WHITELIST) & (F.col("year") >= SINCE))
    return found.select("doi", F.md5("title").alias("title_digest"), "journal", "year", "lang")


@REGISTRY.add(
    "directions_bilingual",
    """SELECT source, CAST(count(*) FILTER (lang = 'en') AS BIGINT) AS n_en, CAST(count(*) FILTER (lang <> 'en') AS BIGINT) AS n_other
    FROM documents GROUP BY source HAVING count(*) FILTER (lang = 'en') > 0 AND count(*) FILTER (lang <> 'en') > 0""",
)
def directions_bilingual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B1, B7: directions with evidence in the first language and in others."""
    en = F.col("lang") == "en"
    return (
        table(spark, sf_dir, "documents")
        .groupBy("source")
        .agg(F.count_if(en).alias("n_en"), F.count_if(~en).alias("n_other"))
        .filter("n_en > 0 AND n_other > 0")
    )


TOPIC = "the nation of information and them"


@REGISTRY.add(
    "docs_ranked_by_topic",
    f"""WITH t AS (SELECT doc_id, source, list_distinct(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) AS terms FROM documents),
    s AS (SELECT doc_id, source, len(list_intersect(terms, {TOPIC.split()})) AS shared, len(terms) AS n FROM t)
    SELECT doc_id, source, round(shared / (n + {len(set(TOPIC.split()))} - shared), 6) AS similarity FROM s ORDER BY similarity DESC, doc_id LIMIT 20""",
)
def docs_ranked_by_topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B4: the twenty documents whose terms overlap most with a topic's; ties go to the smaller id."""
    similarity = F.round(topics.overlap(topics.terms(F.col("text")), topics.terms(F.lit(TOPIC))), 6)
    ranked = table(spark, sf_dir, "documents").select("doc_id", "source", similarity.alias("similarity"))
    return ranked.orderBy(F.desc("similarity"), "doc_id").limit(20)


@REGISTRY.add(
    "docs_by_bm25",
    f"""WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS terms FROM documents),
    s AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(len(terms)) AS length FROM d),
    p AS (SELECT doc_id, size, term, CAST(count(*) AS DOUBLE) AS tf FROM (SELECT doc_id, len(terms) AS size, unnest(terms) AS term FROM d) GROUP BY ALL),
    f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
    q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) AS term FROM benchmark),
    r AS (SELECT item_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * {search.K1 + 1}::DOUBLE / (tf + {search.K1}::DOUBLE * ({1 - search.B}::DOUBLE + {search.B}::DOUBLE * size / length))), 6) AS score
      FROM q JOIN f USING (term) JOIN p USING (term), s GROUP BY item_id, doc_id),
    w AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM r)
    SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM w WHERE rank <= 10""",
)
def docs_by_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B4: every benchmark text as a question over all documents, the ten best each by an inverted index."""
    index = search.build(table(spark, sf_dir, "documents"))
    found = search.search(index, table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text"), 10)
    return found.select(F.col("query_id").alias("item_id"), "rank", "doc_id", "score")


def _term_sets_sql(documents: str, percent: int) -> str:
    """Common table expressions up to ``sets`` (terms, n_docs): all sets of one to three terms that a share of the documents have."""
    enough = f"count(*) * 100 >= (SELECT count(*) FROM d) * {percent}"
    return f"""d AS (SELECT row_number() OVER () AS id, list_distinct(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) AS terms FROM {documents}),
    u AS (SELECT id, unnest(terms) AS term FROM d),
    f AS (SELECT term, count(*) AS n FROM u GROUP BY term HAVING {enough} AND count(*) * 100 <= (SELECT count(*) FROM d) * {termsets.COMMON}),
    x AS (SELECT id, term FROM u JOIN f USING (term)),
    two AS (SELECT a.term AS t1, b.term AS t2, count(*) AS n FROM x a JOIN x b ON a.id = b.id AND a.term < b.term GROUP BY ALL HAVING {enough}),
    three AS (SELECT t1, t2, c.term AS t3, count(*) AS n FROM two JOIN x a ON a.term = t1 JOIN x b ON b.id = a.id AND b.term = t2 JOIN x c ON c.id = a.id AND c.term > t2 GROUP BY ALL HAVING {enough}),
    sets AS (SELECT [term] AS terms, n AS n_docs FROM f UNION ALL SELECT [t1, t2], n FROM two UNION ALL SELECT [t1, t2, t3], n FROM three)"""


#: A hot sub-direction is one of a tenth of the verified documents at least.
HOT_PERCENT = 10
VERIFIED = "(SELECT text FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1))"


@REGISTRY.add(
    "subdirections_frequent",
    f"""WITH {_term_sets_sql("documents", termsets.PERCENT)}
    SELECT array_to_string(terms, ' ') AS direction, CAST(len(terms) AS INTEGER) AS n_terms, CAST(n_docs AS BIGINT) AS n_docs FROM sets""",
)
def subdirections_frequent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B8: all sets of up to three terms that a twentieth of the documents have together."""
    sets = termsets.term_sets(table(spark, sf_dir, "documents"))
    return sets.select(F.concat_ws(" ", "terms").alias("direction"), F.size("terms").alias("n_terms"), "n_docs")


@REGISTRY.add(
    "subdirections_hot",
    f"""WITH {_term_sets_sql(VERIFIED, HOT_PERCENT)}
    SELECT CAST(row_number() OVER (ORDER BY n_docs DESC, array_to_string(terms, ' ')) AS INTEGER) AS rank, array_to_string(terms, ' ') AS direction, CAST(n_docs AS BIGINT) AS n_docs
    FROM sets s WHERE len(terms) > 1 AND NOT EXISTS (SELECT 1 FROM sets t WHERE len(t.terms) = len(s.terms) + 1 AND t.n_docs = s.n_docs AND list_has_all(t.terms, s.terms))
    ORDER BY rank LIMIT 5""",
)
def subdirections_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B8: the five sub-directions, found in the texts, that most verified documents have; a set that only repeats a part of another one does not count."""
    verified = table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    return termsets.hot(table(spark, sf_dir, "documents").join(verified, "doc_id", "left_semi"), 5, HOT_PERCENT)
