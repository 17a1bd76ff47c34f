"""Mixing sources to target weights, with DataFrame functions only.

Tokens (words) are summed per source, targets are shared out by weight, each source gets a repetition rate of
target / size, and a document is emitted floor(rate) times plus one copy more if its coin, seeded by a hash of the document, falls below the
source's threshold. The threshold is the fraction of the rate, made exact on the coins drawn: of a source's documents in the order of their coins as many get
the copy as take the fraction of its words. So each document's chance is the fraction, and what a source yields is
off its target by half a document at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.llm.common import global_rank, join_small, n_words, written

#: Weights that repeat over the sources in code point order.
WEIGHTS = (5.0, 2.0, 1.0)
#: No source is repeated more often than this.
MAX_RATE = 3.0
SEED = 17
#: Hex digits of an MD5 that make up a coin (52 bits), and those looked at in one round of the search for thresholds.
DIGITS, STEP = 13, 3
#: Rows of a source among which a threshold is looked for by sorting.
SORTED = 2048


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_rate: float = MAX_RATE) -> DataFrame:
    """Targets of sources.

    ``sizes``: source, source_size (one row per source, null being a source of its own). Returns it with ``target``: the
    total size shared by weight (sources in code point order, null last, weights repeating), no target above ``max_rate`` times
    its source's size, the excess reshared by weight among the others until none is above. A round caps at least one
    source or is the last; each is one aggregate over the sources, so no task ever holds all of them.
    """
    ranked = global_rank(sizes, [F.col("source").asc_nulls_last()], "_rank")
    choices = F.array(*[F.lit(float(w)) for w in weights])
    open_ = ranked.withColumn("_weight", F.element_at(choices, (F.col("_rank") % len(weights) + 1).cast("int"))).withColumn(
        "_cap", F.col("source_size") * F.lit(float(max_rate))
    )
    state = written(open_.withColumn("_capped", F.lit(False)), "sources")
    total = state.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    while True:
        left = state.agg(
            F.coalesce(F.sum(F.when(F.col("_capped"), F.col("_cap"))), F.lit(0.0)).alias("used"),
            F.coalesce(F.sum(F.when(~F.col("_capped"), F.col("_weight"))), F.lit(0.0)).alias("weight"),
        ).first()
        rest, weight = float(total) - left.used, left.weight
        share = F.lit(0.0) if not weight else F.lit(rest) * F.col("_weight") / F.lit(weight)
        state = state.withColumn("target", F.when(F.col("_capped"), F.col("_cap")).otherwise(share))
        above = ~F.col("_capped") & (F.col("target") > F.col("_cap"))
        if not weight or state.filter(above).isEmpty():
            return written(state.select("source", "source_size", "target"), "targets")
        state = written(state.withColumn("_capped", F.col("_capped") | above).drop("target"), "sources")


def coin(doc_id: Column, text: Column, seed: int = SEED) -> Column:
    """A number fixed by the seed and the document, of DIGITS hex digits."""
    none = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), none(doc_id), none(text)).cast("binary"))
    return F.conv(F.substring(digest, 1, DIGITS), 16, 10).cast("long")


def measured(docs: DataFrame, *keep: str | Column, seed: int = SEED) -> DataFrame:
    """``keep``, doc_id, source, size, coin and tie (a hash of the whole row: rows that share coin and tie are equal) of every row."""
    plain = [F.col(f"`{c}`") for c, t in docs.dtypes if "map<" not in t]  # maps have no hash
    return docs.select(*keep, "doc_id", "source", n_words(F.col("text")).alias("size"), coin(F.col("doc_id"), F.col("text"), seed).alias("coin"), F.xxhash64(*plain).alias("tie"))


def source_rules(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_rate: float = MAX_RATE) -> DataFrame:
    """A row a source: source, source_size, target, whole (copies of each document), and which documents get one more: those with (coin, tie) below
    (at_coin, at_tie), and ``n_more`` of the ``n_there`` equal rows there.

    ``sized`` (written) is looked through by the coins' digits: a round sums up words by source and the next digits, and goes on with the digits at
    which the wanted sum is reached, until few rows are left to sort. So no task ever holds a source's rows.
    """
    targets = source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, max_rate)
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(max_rate)))).otherwise(0.0)
    rules = targets.withColumn("whole", F.floor(rate).cast("long"))
    wanted = (F.col("target") - F.col("whole") * F.col("source_size")).alias("wanted")
    below = lambda first, what: first + F.coalesce(what, F.lit(0))

    def rows_at(digits: int, open_: DataFrame) -> DataFrame:
        """The rows of each open source whose coin has its prefix of so many digits."""
        place = F.struct("source", F.shiftright("coin", 4 * (DIGITS - digits)).alias("prefix")).alias("place")
        return join_small(sized.select(place, "size", "coin", "tie"), open_.select(F.struct("source", "prefix").alias("place"), "wanted", "before"), "place")

    open_, found, digits = written(rules.select("source", wanted, F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("before")), "open"), [], 0
    while True:
        more = min(digits + STEP, DIGITS)
        bins = rows_at(digits, open_).withColumn("next", F.shiftright("coin", 4 * (DIGITS - more)))
        bins = bins.groupBy("place", "wanted", "before", "next").agg(F.sum("size").alias("words"), F.count("*").alias("n"))
        so_far = F.sum("words").over(W.partitionBy("place").orderBy("next").rowsBetween(W.unboundedPreceding, -1))
        bins = bins.withColumn("start", below(F.col("before"), so_far)).filter("start < wanted")
        last = bins.groupBy("place", "wanted").agg(F.max(F.struct("next", "start", "n")).alias("at"))
        reached = written(last.select("place.source", "wanted", F.col("at.next").alias("prefix"), F.col("at.start").alias("before"), F.col("at.n").alias("n")), "reached")
        settled = (F.col("n") <= SORTED) | F.lit(more == DIGITS)
        equal = rows_at(more, written(reached.filter(settled).drop("n"), "few")).groupBy("place", "wanted", "before", "coin", "tie").agg(F.max("size").alias("size"), F.count("*").alias("n_there"))
        so_far = F.sum(F.col("size") * F.col("n_there")).over(W.partitionBy("place").orderBy("coin", "tie").rowsBetween(W.unboundedPreceding, -1))
        equal = equal.withColumn("start", below(F.col("before"), so_far)).filter("start < wanted")
        last = equal.groupBy("place", "wanted").agg(F.max(F.struct("coin", "tie", "size", "n_there", "start")).alias("at"))
        #: a row gets the copy if its middle lies below the wanted sum
        halves = F.ceil((F.col("wanted") - F.col("at.start")) / F.col("at.size") - 0.5)
        n_more = F.when(F.col("at.size") > 0, F.least(F.greatest(halves, F.lit(0)), F.col("at.n_there"))).otherwise(F.col("at.n_there")).cast("long")
        found.append(written(last.select(F.col("place.source").alias("_s"), F.col("at.coin").alias("at_coin"), F.col("at.tie").alias("at_tie"), n_more.alias("n_more"), "at.n_there"), "thresholds"))
        open_, digits = written(reached.filter(~settled).drop("n"), "open"), more
        if digits == DIGITS or open_.isEmpty():
            break
    thresholds = found[0]
    for table in found[1:]:
        thresholds = thresholds.unionByName(table)
    return written(rules.join(thresholds, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s"), "rules")


def decide(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """``rows`` (of measured()) with source_size, target, copies and taken (size times copies).

    Rules are joined back by a checked broadcast or salted, so that a hot source fills no task. Equal rows at a threshold, of which some get one more copy,
    are counted and given out anew, so it does not matter which of them do.
    """
    joined = join_small(rows, rules, "source")
    place, at = F.struct("coin", "tie"), F.struct(F.col("at_coin").alias("coin"), F.col("at_tie").alias("tie"))
    there = F.coalesce(place == at, F.lit(False))
    more = F.coalesce((place < at) & F.col("at_coin").isNotNull(), F.lit(False)) | (there & (F.col("n_more") == F.col("n_there")))
    split = F.col("n_more").between(1, F.col("n_there") - 1)
    joined = joined.withColumn("copies", F.col("whole") + more.cast("int"))
    out = [*rows.columns, "source_size", "target", "copies"]
    if not rules.filter(split).isEmpty():
        some = there & F.coalesce(split, F.lit(False))
        equal = joined.filter(some).groupBy("source").agg(F.first(F.struct(*[F.col(f"`{c}`") for c in joined.columns])).alias("one"))
        again = equal.select("one.*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("one.n_there"))).alias("_k")).withColumn("copies", F.col("whole") + (F.col("_k") <= F.col("n_more")).cast("int"))
        joined = joined.filter(~some).select(*out).unionByName(again.select(*out))
    return joined.select(*out, (F.col("size") * F.col("copies")).alias("taken"))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_rate: float = MAX_RATE, seed: int = SEED) -> DataFrame:
    """Documents with how often the mix takes them.

    Returns ``row`` (the whole input row, so columns of any name are kept apart), doc_id, size, source_size, target, copies and
    taken (size times copies).

    A null text counts as empty (size 0); a source without words has target 0 and gives no copies. Null sources are one source,
    the last. Repeated rows are told apart: where only some of them belong in the mix, just so many get the further copy. A very long text's words live in
    its row alone. An empty table gives an empty mix. Sources are summed before the shuffle; texts are never shuffled.
    """
    rules = source_rules(written(measured(docs, seed=seed), "sized"), weights, max_rate)
    decided = decide(measured(docs, F.struct("*").alias("row"), seed=seed), rules)
    return decided.select("row", "doc_id", "size", "source_size", "target", "copies", "taken")


def takes(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_rate: float = MAX_RATE, seed: int = SEED) -> DataFrame:
    """As mix(), without the rows themselves: texts are read once."""
    sized = written(measured(docs, seed=seed), "sized")
    return decide(sized, source_rules(sized, weights, max_rate)).select("doc_id", "size", "source_size", "target", "copies", "taken")


def emit(mixed: DataFrame) -> DataFrame:
    """The mixed documents themselves: each input row once per copy."""
    return mixed.filter("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_copy")).select("row.*")
