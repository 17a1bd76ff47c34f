"""Each stage on its own input against brute force, and what the native operators run."""

import inspect
import re
from collections import Counter

import numpy as np
import pytest

import __spark_entry__
import corpus_pipeline
from quern.llm import mixing, pii, quality, sharding, toxicity
from quern.session import table
from tests.conftest import DATA
from tests.llm.test_jaccard import slow_kept
from tests.llm.test_pii import luhn
from tests.llm.test_tokens import check_packing, expected

SF = f"{DATA}/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """The output of every stage, the input first."""
    docs = table(spark, SF, "documents")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(corpus_pipeline.written(stage(spark, out[-1], SF), f"test-{name}"))
    return out


def key(rows):
    return Counter(map(tuple, rows))


def test_columns(stages):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "surrogates", "mixing", "packing"]
    assert all(s.schema.simpleString() == stages[0].schema.simpleString() for s in stages[:-1])


def test_toxic_documents_go(spark, stages):
    net = toxicity.fit(stages[0], table(spark, SF, "labels"))
    rows = stages[0].collect()
    logits = toxicity.Scorer(net).logits([r.text for r in rows])
    assert key(stages[1].collect()) == key(r for r, v in zip(rows, logits) if v < 0)


def test_one_of_each_group_stays(stages):
    rows = stages[1].collect()
    kept = slow_kept([(r.doc_id, r.text) for r in rows])
    assert key(stages[2].collect()) == key(r for r in rows if r.doc_id in kept) and len(kept) < len(rows)


def test_surrogates_change_entities_only(stages):
    before, after = ({r.doc_id: r for r in s.collect()} for s in stages[2:4])
    assert before.keys() == after.keys()
    changed = [i for i in before if before[i].text != after[i].text]
    assert changed and len(changed) < len(before)
    for i in before:
        assert after[i].n_chars == len(after[i].text) and (after[i].lang, after[i].source) == (before[i].lang, before[i].source)
        assert len(after[i].text.split()) == len(before[i].text.split())
    entity = re.compile(r"\d{16}|\S+@\S+\.com|\+1 \(\d{3}\) \d{3}-\d{4}|AKIA\w{16}")
    found = lambda docs: {m for r in docs.values() for m in entity.findall(r.text) if not m.isdigit() or luhn(m)}
    assert found(before) and not found(before) & found(after)


def test_copies(stages):
    taken = {r.doc_id: r.copies for r in mixing.mix(stages[3]).select("doc_id", "copies").collect()}
    assert Counter(r.doc_id for r in stages[4].collect()) == Counter(taken)


def test_all_ids_are_packed(stages):
    _, sizes = check_packing(None, stages[5].collect(), 1024)
    assert sum(sizes) == sum(len(expected(r.text)) for r in stages[4].collect())


def test_empty_input(spark, no_docs):
    docs = no_docs
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, SF), "empty")
        assert docs.count() == 0


def test_odd_documents_pass_all_stages(spark, odd_docs):
    docs = odd_docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, SF), "odd")
        assert docs.columns == odd_docs.columns
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() >= 0


@pytest.mark.parametrize("module", [sharding, quality, mixing, pii])
def test_native_modules_hold_no_python_paths(module):
    source = inspect.getsource(module)
    assert not any(x in source for x in ("udf", "pandas", "mapIn", "applyIn", ".rdd", "Arrow"))


@pytest.mark.parametrize("name", ["op1_sharding", "op6_surrogates", "op8_host_quality", "op10_mixing"])
def test_native_plans(spark, name):
    plan = __spark_entry__.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "CartesianProduct"))


def test_no_silent_nan():
    assert np.isfinite(toxicity.Net.fresh({}).p["char"]).all()
