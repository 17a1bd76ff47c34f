"""Host-level quality rules, with DataFrame functions only.

Documents are measured one by one and held against several rules. Failures of each rule are summed by host, each rule's host rates are shrunk with a beta
prior fitted to all hosts by the method of moments, and a host of which any rule's shrunk rate passes a limit loses its documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import BLANKS, WORD, join_small, let, written

#: Fixed set of symbol characters.
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 10
WINDOW = 5
#: A text fails if over this share (in hundredths) of its words repeat.
MAX_REPEAT_PERCENT = 20
#: A text fails if over so many of a hundred words' worth of symbols, if over so many hundredths of its lines repeat, or if its words' mean length lies outside these.
MAX_SYMBOL_PERCENT, MAX_DUP_LINE_PERCENT, MIN_MEAN_WORD, MAX_MEAN_WORD = 10, 30, 2, 15
#: A host is turned down if the shrunk failure rate of any rule is above this.
MAX_HOST_RATE = 0.5
#: The rules. A text that fails one of the first two fails itself; the others tell on hosts only.
RULES = ("few_words", "repeats", "symbols", "dup_lines", "word_length")


def _window_hashes(words: Column) -> Column:
    """A hash of each run of WINDOW words, in order; empty for shorter texts."""

    def windows(hashed: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(hashed) - WINDOW)
        found = F.transform(starts, lambda i: F.xxhash64(*[F.get(hashed, i + k) for k in range(WINDOW)]))
        return F.when(F.size(hashed) >= WINDOW, found).otherwise(F.array().cast("array<bigint>"))

    return let(F.transform(words, lambda w: F.xxhash64(w)), windows)


def _covered(hashes: Column) -> Column:
    """Words covered by windows found twice or more. Sorting (hash, place) brings equal windows together; each repeated window
    then covers the words up to the next repeated one's start, WINDOW at most."""

    def repeated(placed: Column) -> Column:
        same = lambda x, k: F.coalesce(F.get(placed, k)["h"] == x["h"], F.lit(False))
        return F.filter(placed, lambda x, k: same(x, k - 1) | same(x, k + 1))

    placed = F.sort_array(F.arrays_zip(hashes.alias("h"), F.sequence(F.lit(1), F.size(hashes)).alias("i")))
    starts = F.sort_array(F.transform(let(placed, repeated), lambda x: x["i"]))
    return F.aggregate(
        starts,
        F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("at")),
        lambda acc, i: F.struct((acc["n"] + F.least(F.lit(WINDOW), i - acc["at"])).alias("n"), i.alias("at")),
        lambda acc: acc["n"],
    )


def measure(docs: DataFrame, *keep: str) -> DataFrame:
    """Base measures of every text: ``keep`` and n_words, word_chars, n_symbols, n_lines (with a word), n_dup_lines, n_repeat_words, base_failed, and failed
    (a boolean for each of RULES).

    A null text has no words and fails. An empty table gives no rows, and columns not kept cannot clash. Windows are compared by 64-bit hashes of their words' 64-bit hashes within one text. The arrays of a
    very long text live in its row alone; the sort runs only for texts in which some window repeats.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = docs.select(*keep, text.alias("_text"), F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("_words"))
    blank = F.lit(BLANKS)
    lines = lines.select(
        *keep,
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.translate("_text", BLANKS, "")).cast("long").alias("word_chars"),
        (F.length("_text") - F.length(F.translate("_text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.filter(F.split("_text", "\n"), lambda x: F.length(F.btrim(x, blank)) > 0).alias("_lines"),
        _window_hashes(F.col("_words")).alias("_hashes"),
    )
    distinct = lambda c: F.size(F.array_distinct(c))
    measured = lines.select(
        *keep,
        "n_words",
        "word_chars",
        "n_symbols",
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - distinct("_lines")).cast("long").alias("n_dup_lines"),
        F.when(distinct("_hashes") == F.size("_hashes"), 0).otherwise(let(F.col("_hashes"), _covered)).cast("long").alias("n_repeat_words"),
    )
    n = F.col("n_words")
    failed = {
        "few_words": n < MIN_WORDS,
        "repeats": 100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * n,
        "symbols": 100 * F.col("n_symbols") > MAX_SYMBOL_PERCENT * n,
        "dup_lines": 100 * F.col("n_dup_lines") > MAX_DUP_LINE_PERCENT * F.col("n_lines"),
        "word_length": (F.col("word_chars") < MIN_MEAN_WORD * n) | (F.col("word_chars") > MAX_MEAN_WORD * n),
    }
    return measured.withColumns({"base_failed": failed["few_words"] | failed["repeats"], "failed": F.struct(*[failed[r].alias(r) for r in RULES])})


def host_rates(measured: DataFrame, host: str = "source", max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """Per host: n_docs, n_failed and shrunk (of each of RULES), shrunk_rate (the largest) and host_rejected.

    For each rule the prior is beta(a, b) with the hosts' mean rate m and a + b from the variance of their rates beyond what chance gives
    (method of moments, each host counting once); with no such excess the prior is as strong as the average host is large.
    shrunk = (failures + a) / (documents + a + b). Null hosts are one host. No hosts: no rows.
    """
    sums = [F.count_if(f"failed.{r}").alias(r) for r in RULES]
    hosts = written(measured.groupBy(host).agg(F.count("*").alias("n_docs"), *sums), "hosts")
    moments = [x for r in RULES for x in (F.avg(F.col(r) / F.col("n_docs")).alias(f"m_{r}"), F.coalesce(F.var_pop(F.col(r) / F.col("n_docs")), F.lit(0.0)).alias(f"v_{r}"))]
    found = hosts.agg(F.avg(F.lit(1.0) / F.col("n_docs")).alias("inv"), F.avg("n_docs").alias("docs"), *moments).first()
    shrunk = []
    for rule in RULES:
        mean, strength = found[f"m_{rule}"] or 0.0, 1.0
        if found.inv is not None:
            excess = (found[f"v_{rule}"] - mean * (1 - mean) * found.inv) / max(1 - found.inv, 1e-9)
            strength = max(1.0, mean * (1 - mean) / excess - 1) if excess > 0 else float(found.docs)
        shrunk.append(((F.col(rule) + F.lit(mean * strength)) / (F.col("n_docs") + F.lit(strength))).alias(rule))
    rates = hosts.select(host, "n_docs", F.struct(*RULES).alias("n_failed"), F.struct(*shrunk).alias("shrunk"))
    rates = rates.withColumn("shrunk_rate", F.greatest(*[F.col(f"shrunk.{r}") for r in RULES]))
    return written(rates.withColumn("host_rejected", F.col("shrunk_rate") > max_rate), "host_rates")


def host_quality(docs: DataFrame, host: str = "source", max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """Every document with its base measures, its host's failures and shrunk rates, and ``kept``: neither failed itself nor of a rejected host.

    Measures are written once (a few numbers a row) and read for the hosts' sums and for the join back, which is a checked broadcast or
    salted: a host with a third of all rows fills no task. Rows with null or repeated ids are judged each for itself. Of the input's columns only doc_id and the
    host come back, so none can clash. An empty table gives no rows.
    """
    measured = written(measure(docs, "doc_id", host), "measures")
    rates = host_rates(measured, host, max_rate).withColumnsRenamed({"n_docs": "host_docs", "n_failed": "host_failed", "shrunk": "host_shrunk"})
    joined = join_small(measured, rates, host)
    return joined.withColumn("kept", ~F.col("base_failed") & ~F.col("host_rejected"))
