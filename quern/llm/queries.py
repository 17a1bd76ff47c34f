"""Registered queries of the operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import dac, exact, mixing, packing, phrases, pii, quality, sharding, simhash, toxicity, vptree, warc, whitening
from quern.llm.common import WORD
from quern.plans.registry import Registry
from quern.session import table

REGISTRY = Registry()
SHARDS = [f"shard-{i}" for i in range(sharding.N_SHARDS)]
#: DuckDB's text for A-Z lowered.
LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@REGISTRY.add(
    "op1_sharding",
    f"""WITH placed AS (SELECT doc_id, CAST(CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15)) AS BIGINT) % {sharding.TABLE_SIZE} AS INTEGER) AS slot FROM documents),
    filled AS (SELECT {sharding.lookup_table(SHARDS)} AS owner)
    SELECT doc_id, slot, CAST(owner[slot + 1] AS INTEGER) AS shard FROM placed, filled""",
)
def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard of every document, by its id."""
    assigned = sharding.assign(table(spark, sf_dir, "documents"), ["doc_id"], SHARDS)
    return assigned.select("row.doc_id", "slot", "shard")


@REGISTRY.add(
    "op8_host_quality",
    rf"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents),
    w AS (SELECT r, doc_id, source, t, regexp_extract_all(t, '{WORD}') AS words FROM d),
    g AS (SELECT r, unnest(range(1, len(words) - 3)) AS i, words FROM w WHERE len(words) >= 5),
    h AS (SELECT r, i, count(*) OVER (PARTITION BY r, array_to_string(list_slice(words, i, i + 4), ' ')) AS n FROM g),
    c AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 5)) AS p FROM h WHERE n > 1) GROUP BY r),
    m AS (
      SELECT w.r, doc_id, source, CAST(len(words) AS BIGINT) AS n_words,
        CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
        CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS lines,
        CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words
      FROM w LEFT JOIN c ON c.r = w.r),
    b AS (
      SELECT r, doc_id, source, n_words, word_chars, n_symbols, CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, n_repeat_words FROM m),
    x AS (
      SELECT r, source, unnest([
        {{'rule': 1, 'failed': n_words < {quality.MIN_WORDS}}},
        {{'rule': 2, 'failed': 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words}},
        {{'rule': 3, 'failed': 100 * n_symbols > {quality.MAX_SYMBOL_PERCENT} * n_words}},
        {{'rule': 4, 'failed': 100 * n_dup_lines > {quality.MAX_DUP_LINE_PERCENT} * n_lines}},
        {{'rule': 5, 'failed': word_chars < {quality.MIN_MEAN_WORD} * n_words OR word_chars > {quality.MAX_MEAN_WORD} * n_words}}], recursive := true)
      FROM b),
    s AS (SELECT source, rule, count(*) AS n, count(*) FILTER (failed) AS f FROM x GROUP BY source, rule),
    p AS (SELECT rule, avg(f / n) AS mean, coalesce(var_pop(f / n), 0) AS v, avg(1.0 / n) AS inv, avg(n) AS size FROM s GROUP BY rule),
    q AS (SELECT rule, mean, size, (v - mean * (1 - mean) * inv) / greatest(1 - inv, 1e-9) AS excess FROM p),
    k AS (SELECT rule, mean, CASE WHEN excess > 0 THEN greatest(1.0, mean * (1 - mean) / excess - 1) ELSE size END AS strength FROM q),
    hosts AS (SELECT source, max((f + mean * strength) / (n + strength)) AS rate, max(f) AS most_failed FROM s JOIN k USING (rule) GROUP BY source),
    j AS (SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM b)
    SELECT j.doc_id, j.n_words, j.word_chars, j.n_symbols, j.n_dup_lines, j.n_repeat_words, j.base_failed,
      NOT j.base_failed AND NOT hosts.rate > {quality.MAX_HOST_RATE} AS kept,
      round(hosts.rate, 6) AS host_rate, CAST(hosts.most_failed AS BIGINT) AS host_most_failed, hosts.rate > {quality.MAX_HOST_RATE} AS host_rejected
    FROM j JOIN hosts ON j.source IS NOT DISTINCT FROM hosts.source""",
)
def op8_host_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base measures of every document and the verdict on it and its host: the largest of the host's shrunk failure rates, over all rules, and of its failures."""
    judged = quality.host_quality(table(spark, sf_dir, "documents"))
    most_failed = F.greatest(*[F.col(f"host_failed.{rule}") for rule in quality.RULES]).cast("long")
    base = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return judged.select(*base, F.round("shrunk_rate", 6).alias("host_rate"), most_failed.alias("host_most_failed"), "host_rejected")


@REGISTRY.add(
    "op10_mixing",
    rf"""WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS size,
      CAST(('0x' || substr(md5('{mixing.SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, {mixing.DIGITS})) AS BIGINT) AS coin FROM documents),
    s AS (SELECT source, CAST(sum(size) AS DOUBLE) AS n FROM d GROUP BY source),
    w AS (SELECT source, n, 3.0::DOUBLE * n AS cap, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM s),
    f AS (SELECT *, (sum(n) OVER () - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS rest,
        sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS left_weight
      FROM w WINDOW o AS (ORDER BY cap / weight, source NULLS LAST)),
    l AS (SELECT arg_min(rest, cap / weight) AS rest, arg_min(left_weight, cap / weight) AS left_weight FROM f WHERE rest * weight / left_weight <= cap),
    t AS (SELECT w.source, n, CASE WHEN l.rest IS NULL OR l.rest * weight / l.left_weight > cap THEN cap ELSE l.rest * weight / l.left_weight END AS target FROM w, l),
    r AS (SELECT d.doc_id, d.size, t.n, t.target, CASE WHEN t.n > 0 THEN floor(least(t.target / t.n, 3.0::DOUBLE)) ELSE 0 END AS whole,
        sum(d.size) OVER (PARTITION BY d.source ORDER BY d.coin, d.doc_id NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - d.size AS before
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
    SELECT doc_id, size, CAST(n AS BIGINT) AS source_size, target,
      CAST(size * (whole + CASE WHEN before + size / 2.0::DOUBLE < target - whole * n THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM r""",
)
def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document."""
    return mixing.takes(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@REGISTRY.add("op2_token_codes")
def op2_token_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of every document, written to files of directly addressable codes and read back."""
    read = dac.round_trip(table(spark, sf_dir, "documents"), with_ids=False)
    return read.select("doc_id", "start", "n_tokens", "ids_crc32")


@REGISTRY.add("op9_packing")
def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 1024 ids."""
    pieces = packing.pack(table(spark, sf_dir, "documents"), with_ids=False)
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


@REGISTRY.add("op7_simhash")
def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and component."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@REGISTRY.add("op3_toxicity")
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity score of every document."""
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")), ["doc_id"])
    return scored.select(
        "row.doc_id", toxicity.held_out(F.col("row.doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


@REGISTRY.add("op6_surrogates")
def op6_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text with personal data and secrets replaced."""
    replaced = pii.replace(table(spark, sf_dir, "documents"))
    return replaced.select("row.doc_id", F.col("new_text").alias("text"), "n_replaced")


@REGISTRY.add("op5_vantage_trees")
def op5_vantage_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors found for every vector whose id is divisible by 20."""
    vectors = table(spark, sf_dir, "embeddings")
    return vptree.search(vptree.build(vectors), vectors.filter(F.col("vec_id") % 20 == 0))


@REGISTRY.add(
    "op4_warc",
    """WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
    h AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha1(html) AS x, min(page_id) OVER (PARTITION BY html) AS first,
      row_number() OVER (PARTITION BY html ORDER BY page_id NULLS LAST) AS place FROM p)
    SELECT page_id, payload_bytes,
      array_to_string(list_transform(range(0, 8), lambda g:
        array_to_string(list_transform([15, 10, 5, 0], lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST(('0x' || substr(x, 5 * g + 1, 5)) AS BIGINT) >> s) & 31 AS INTEGER) + 1, 1)), '')), '') AS payload_digest,
      CASE WHEN place = 1 THEN 'response' ELSE 'revisit' END AS record_type,
      CASE WHEN place > 1 THEN first END AS refers_to
    FROM h""",
)
def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of all pages, written to archives and read back by the salvage reader. A gap in an archive just written is an error."""
    read = warc.round_trip(table(spark, sf_dir, "pages"))
    gap = F.concat(F.lit("damaged archive "), F.col("file"), F.lit(" at "), F.col("gap_start").cast("string"))
    page_id = F.when(F.col("gap_start").isNotNull(), F.raise_error(gap).cast("long")).otherwise(F.col("page_id"))
    return read.select(page_id.alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


@REGISTRY.add(
    "op11_exact_dedup",
    f"""WITH d AS (SELECT doc_id, {LOWERED} AS t FROM documents)
    SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
      row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
    FROM d""",
)
def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the one that stays of its copies."""
    found = exact.duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


@REGISTRY.add(
    "op12_collocations",
    rf"""WITH d AS (SELECT coalesce(lang, 'und') AS lang, {LOWERED} AS t FROM documents),
    p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
    w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM p),
    t AS (SELECT lang, CAST(sum(len(words)) AS BIGINT) AS n FROM w GROUP BY lang),
    s AS (SELECT lang, words, unnest(range(1, {phrases.LONGEST + 1})) AS size FROM w),
    i AS (SELECT lang, size, words, unnest(range(1, len(words) - size + 2)) AS i FROM s WHERE len(words) >= size),
    f AS (SELECT lang, size, list_slice(words, i, i + size - 1) AS part, count(*) AS a FROM i GROUP BY ALL HAVING count(*) >= {phrases.LIMITS.least}),
    k AS (SELECT lang, part, size, a, unnest(range(1, size)) AS k FROM f WHERE size > 1),
    c AS (SELECT k.*, x.a AS l, y.a AS r, CAST(1000 * CAST(k.a AS HUGEINT) * n // (CAST(x.a AS HUGEINT) * y.a) AS BIGINT) AS score
      FROM k JOIN t USING (lang) JOIN f x ON x.lang = k.lang AND x.part = k.part[:k] JOIN f y ON y.lang = k.lang AND y.part = k.part[k + 1:]),
    b AS (SELECT DISTINCT ON (lang, part) lang, part, size, a, l, r, score FROM c ORDER BY lang, part, score, k),
    o AS (SELECT DISTINCT f.lang, list_slice(part, j, j + m - 1) AS part, a FROM (SELECT *, unnest(range(2, size)) AS m FROM f WHERE size > 2) f, unnest(range(1, size - m + 2)) u(j)),
    e AS (SELECT b.*, n, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, b.a DESC, array_to_string(b.part, ' ')) AS rank
      FROM b JOIN t USING (lang) ANTI JOIN o ON o.lang = b.lang AND o.part = b.part AND o.a >= b.a)
    SELECT lang, rank, array_to_string(part, ' ') AS phrase, a, l, r, n, score FROM e WHERE rank <= {phrases.LIMITS.top}""",
)
def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first collocations of each language."""
    return phrases.collocations(table(spark, sf_dir, "documents"))


@REGISTRY.add("op13_whitening")
def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector on the first eight whitened components."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"))
