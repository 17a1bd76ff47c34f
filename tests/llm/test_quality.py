import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern.llm import quality


def slow_measures(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    covered = {p for i, g in enumerate(grams) if grams.count(g) > 1 for p in range(i, i + 5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(words)
    return (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), n < 10 or 100 * len(covered) > 20 * n)


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


@settings(max_examples=4, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab#é \n\t\x0b\x85　"), max_size=120) | st.none(), min_size=40, max_size=40))
def test_measures(spark, texts):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = quality.measure(docs, "doc_id").collect()
    assert {r.doc_id: tuple(r[m] for m in MEASURES) for r in rows} == {i: slow_measures(t) for i, t in enumerate(texts)}


def test_odd_documents(spark, odd_docs, no_docs):
    rows = quality.host_quality(odd_docs.withColumn("text", F.expr("if(doc_id = 5, repeat('a b c d e f ', 300), text)"))).collect()
    assert len(rows) == odd_docs.count()
    assert all(not r.kept for r in rows if r.base_failed)
    assert quality.host_quality(no_docs).count() == 0


def test_hosts_are_shrunk_and_joined_back(spark):
    good = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    rows = [(i, good if i % 10 else "short", f"host{i % 20}") for i in range(2000)]
    rows += [(5000 + i, "short" if i < 95 else good, "bad") for i in range(100)]
    rows += [(9000, "short", "tiny"), (9001, good, "tiny"), (9002, good, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    judged = {r.doc_id: r for r in quality.host_quality(docs).collect()}
    assert judged[5099].host_rejected and not judged[5099].kept and not judged[5099].base_failed
    assert judged[9001].kept and judged[9002].kept
    assert judged[9001].shrunk_rate < 0.5
    # the prior, by hand
    by_host = {}
    for d, t, s in rows:
        by_host.setdefault(s, []).append(t == "short")
    rates = [sum(x) / len(x) for x in by_host.values()]
    m = sum(rates) / len(rates)
    v = sum((r - m) ** 2 for r in rates) / len(rates)
    inv = sum(1 / len(x) for x in by_host.values()) / len(by_host)
    excess = (v - m * (1 - m) * inv) / (1 - inv)
    strength = max(1.0, m * (1 - m) / excess - 1) if excess > 0 else sum(map(len, by_host.values())) / len(by_host)
    for s, x in by_host.items():
        d = next(i for i, _, h in rows if h == s)
        assert judged[d].host_shrunk.few_words == pytest.approx((sum(x) + m * strength) / (len(x) + strength))


GOOD = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
#: A text that fails one rule and no other.
BAD = {
    "few_words": "only three words",
    "repeats": " ".join(["a1 b2 c3 d4 e5"] * 4),
    "symbols": GOOD + " ### ***",
    "dup_lines": "\n".join([GOOD, "same", "same", "same"]),
    "word_length": " ".join("x" * 20 + str(i) for i in range(20)),
}


def test_rules(spark):
    docs = spark.createDataFrame([(r, t) for r, t in BAD.items()] + [("none", GOOD)], "doc_id string, text string")
    failed = {r.doc_id: [rule for rule in quality.RULES if r.failed[rule]] for r in quality.measure(docs, "doc_id").collect()}
    assert failed == {r: [r] for r in BAD} | {"none": []}


@pytest.mark.parametrize("rule", quality.RULES)
def test_each_rule_turns_a_host_down(spark, rule):
    """Nearly all of a host's documents fail one rule; its clean ones go with it. Elsewhere few do, and none goes but for its own sake."""
    rows = [(i, BAD[rule] if i % 12 == 0 else GOOD, f"host{i % 10}") for i in range(600)] + [(1000 + i, GOOD if i < 5 else BAD[rule], "bad") for i in range(60)]
    judged = quality.host_quality(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    base = {i for i, t, _ in rows if slow_measures(t)[-1]}
    assert {r.doc_id for r in judged if not r.kept} == base | {i for i, _, s in rows if s == "bad"}
    assert {r.source for r in judged if r.host_rejected} == {"bad"} and all(r.host_failed[rule] == 55 for r in judged if r.source == "bad")
