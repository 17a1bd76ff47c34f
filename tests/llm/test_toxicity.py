import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import toxicity

RNG = np.random.default_rng(0)
SYLLABLES = [a + b for a in "bdfgklmnprst" for b in "aeiou"]


def made(n, toxic):
    words = ["".join(RNG.choice(SYLLABLES, RNG.integers(1, 4))) for _ in range(n)]
    if toxic:
        for i in RNG.integers(0, n, 3):
            words[i] = ["vileword", "zyx" + words[i]][RNG.integers(2)]
    return " ".join(words)


@pytest.fixture(scope="module")
def net():
    labels = [i % 2 for i in range(600)]
    return toxicity.train([made(90, t) for t in labels], labels)


def test_held_out_accuracy(net):
    labels = [i % 2 for i in range(200)]
    logits = toxicity.Scorer(net).logits([made(200, t) for t in labels])
    assert np.mean([(v >= 0) == bool(t) for v, t in zip(logits, labels)]) >= 0.9


def test_spelling_counts(net):
    """A word never seen is judged by its characters."""
    text = made(100, False).split()
    clean = toxicity.Scorer(net).logits([" ".join(text)])[0]
    text[50:50] = ["zyxqo", "zyxpima"]
    assert toxicity.Scorer(net).logits([" ".join(text)])[0] > max(0, clean)


def test_every_window_is_scored(net):
    """The worst window decides wherever it lies, the last words included; scores depend on the text alone."""
    clean, bad = made(5000, False), "vileword zyxla vileword"
    scorer = toxicity.Scorer(net)
    alone = scorer.logits([clean])[0]
    for text in (f"{bad} {clean}", f"{clean} {bad}", f"{clean} {bad} {clean}"):
        assert scorer.logits([text])[0] > max(0, alone)
    texts = [clean, None, "", bad, made(40, False)]
    together = scorer.logits(texts)
    assert together == pytest.approx([toxicity.Scorer(net).logits([t])[0] for t in texts], abs=1e-4)


@pytest.mark.parametrize("n", [0, 1, 11, 12, 13, 71, 72, 73, 83, 84, 85, 86, 150, 500])
def test_long_texts_have_the_same_windows_in_parts(monkeypatch, n):
    words = [f"w{i}" for i in range(n)]
    whole = [words[s : s + toxicity.LENGTH] for s in toxicity.windows(n)]
    monkeypatch.setattr(toxicity, "_PART", 2 * toxicity.STRIDE)
    parts = list(toxicity.parts_of(" ".join(words)))
    assert [p[s : s + toxicity.LENGTH] for p in parts for s in toxicity.windows(len(p))] == whole


def test_windows_cover_all():
    for n in range(0, 400):
        covered = {i for s in toxicity.windows(n) for i in range(s, min(n, s + toxicity.LENGTH))}
        assert covered == set(range(n))


def test_gradient():
    """Backward agrees with differences of forward."""
    rng = np.random.default_rng(2)
    net = toxicity.Net.fresh({"aa": 2, "bb": 3})
    net.p = {k: (v + rng.standard_normal(v.shape) * 0.2).astype(np.float64) for k, v in net.p.items()}
    x = net.inputs(["pad", "aa", "bb", "cc"])[0]
    at = rng.integers(0, 4, (5, toxicity.LENGTH))
    real = np.ones_like(at, dtype=bool)
    d = rng.standard_normal(5)

    def value():
        return float((net.forward(net.projected(x), at, real)[0] * d).sum())

    kept = []
    _, *rest = net.forward(net.projected(x), at, real, kept)
    grad = net.backward(d, (2, 4, 3 * toxicity.HIDDEN), at, kept, *rest)
    for name in ("u", "attend", "out", "bias"):
        flat = net.p[name].reshape(-1)
        for i in rng.integers(0, len(flat), 4):
            old, step = flat[i], 1e-3
            flat[i] = old + step
            up = value()
            flat[i] = old - step
            down = value()
            flat[i] = old
            assert (up - down) / (2 * step) == pytest.approx(grad[name].reshape(-1)[i], rel=0.05, abs=0.02)


def test_one_class_or_none():
    for toxic, score in (([], 0), ([0, 0], 0), ([1, 1], 1)):
        logits = toxicity.Scorer(toxicity.train(["a b"] * len(toxic), toxic)).logits(["x", None])
        assert all((v > 0) == bool(score) for v in logits)


def test_frames(spark, odd_docs, no_docs):
    docs = spark.createDataFrame([(i, made(80, i % 2)) for i in range(100)], "doc_id long, text string")
    docs = docs.unionByName(odd_docs.select("doc_id", "text"))
    labels = spark.createDataFrame([(i, i % 2) for i in range(100)] + [(None, 1), (3, None), (777, 1)], "doc_id long, toxic int")
    net = toxicity.fit(docs, labels, sample=30)
    rows = toxicity.score(odd_docs, net).select("row", "score").collect()
    assert len(rows) == odd_docs.count() and all(0 <= r.score <= 1 and r.row.score == 7 for r in rows)
    assert toxicity.score(no_docs, net).count() == 0
    held = docs.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("h")).filter("doc_id IS NOT NULL").collect()
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in held)


def slow_grams(word):
    """Buckets of a word's n-grams, one by one."""
    marked, out = f"\x02{word}\x03", []
    for n in toxicity.GRAMS:
        for i in range(len(marked) - n + 1):
            # the hash of the shorter n-gram at a place is shifted by each later character
            h = 0
            for c in marked[i : i + n]:
                h = (h * 0x01000193 % 2**32) ^ (ord(c) * 0x9E3779B1 % 2**32)
            h ^= h >> 15
            out.append((h * 0x85EBCA6B % 2**32 >> 18) % toxicity.BUCKETS)
    return out


@pytest.mark.parametrize("word", ["a", "word", "straße", "信息系统", "x\U0001f600y", "o" * 60])
def test_grams_one_by_one(word):
    bucket, start = toxicity.grams([word, "zz", word])
    assert sorted(bucket[start[0] : start[1]].tolist()) == sorted(slow_grams(word)) == sorted(bucket[start[2] :].tolist())


def slow_logit(net, words):
    """A bidirectional GRU over one window, cell by cell, with attention pooling."""
    sigmoid = lambda v: 1 / (1 + np.exp(-v))
    p = {k: v.astype(np.float64) for k, v in net.p.items()}
    xs = [np.concatenate([p["word"][net.vocabulary.get(w, 1)], p["char"][slow_grams(w)].mean(axis=0)]) for w in words]
    xs += [np.zeros_like(xs[0] if xs else np.zeros(toxicity.WORD_DIM + toxicity.CHAR_DIM))] * (toxicity.LENGTH - len(xs))
    n, states = toxicity.HIDDEN, []
    for d, order in enumerate((range(toxicity.LENGTH), range(toxicity.LENGTH - 1, -1, -1))):
        h, out = np.zeros(n), {}
        for t in order:
            gate = xs[t] @ p["w"][d] + p["b"][d][0]
            back = h @ p["u"][d]
            z, r = sigmoid(gate[:n] + back[:n]), sigmoid(gate[n : 2 * n] + back[n : 2 * n])
            new = np.tanh(gate[2 * n :] + r * back[2 * n :])
            h = (1 - z) * new + z * h
            out[t] = h
        states.append(out)
    real = range(max(1, len(words)))
    both = [np.concatenate([states[0][t], states[1][t]]) for t in real]
    score = np.array([b @ p["attend"].ravel() for b in both])
    weight = np.exp(score - score.max())
    weight /= weight.sum()
    return float(sum(w * (b @ p["out"].ravel()) for w, b in zip(weight, both)) + p["bias"][0])


@pytest.mark.parametrize("n", [0, 1, 5, 47, 48, 100])
def test_forward_cell_by_cell(net, n):
    """A text's logit is the largest of its windows', each by a literal network."""
    words = made(max(n, 3), True).split()[:n]
    want = max(slow_logit(net, words[s : s + toxicity.LENGTH]) for s in toxicity.windows(n))
    assert toxicity.Scorer(net).logits([" ".join(words)])[0] == pytest.approx(want, abs=1e-3)


def test_training_in_parts(monkeypatch):
    """Long texts are trained on whole; the parts that their windows go through in change nothing."""
    labels = [i % 2 for i in range(60)]
    texts = [made(40 if i % 10 else 3000, t) for i, t in enumerate(labels)]
    one = toxicity.train(texts, labels, epochs=1)
    monkeypatch.setattr(toxicity, "_WINDOWS", 16)
    other = toxicity.train(texts, labels, epochs=1)
    a, b = (toxicity.Scorer(net).logits(texts) for net in (one, other))
    assert np.corrcoef(a, b)[0, 1] > 0.98


def scores(spark, docs, labels):
    net = toxicity.fit(docs, labels, sample=40)
    return {r.doc_id: r.score for r in toxicity.score(docs, net).select("row.doc_id", "score").collect()}


def test_what_moves_scores(spark):
    """Held-out labels, and the columns lang, source and n_chars, move no score; an id labelled both ways is toxic."""
    rows = [(i, made(60, i % 2), i % 2) for i in range(120)] + [(500, made(9000, 1), 1)]
    docs = spark.createDataFrame([(i, t, "en", f"s{i % 3}") for i, t, _ in rows], "doc_id long, text string, lang string, source string")
    held = {i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0}
    label = lambda pairs: spark.createDataFrame(pairs, "doc_id long, toxic int")
    plain = label([(i, y) for i, _, y in rows])
    want = scores(spark, docs, plain)
    assert scores(spark, docs, label([(i, 1 - y if i in held else y) for i, _, y in rows])) == want
    assert scores(spark, docs.withColumn("lang", F.lit("x")).withColumn("source", F.lit(None).cast("string")), plain) == want
    both = label([(i, y) for i, _, y in rows] + [(i, 0) for i, _, y in rows if y] + [(0, None)])
    assert scores(spark, docs, both) == want


def test_long_rows_are_learned_from(spark, monkeypatch):
    """No text is too long for the sample."""
    seen = []
    monkeypatch.setattr(toxicity, "train", lambda texts, toxic: seen.append((texts, toxic)))
    long = made(20_000, 1)
    docs = spark.createDataFrame([(1, long), (2, "short"), (3, ""), (4, None)], "doc_id long, text string")
    open_ids = [i for i in (1, 2, 3, 4) if zlib.crc32(str(i).encode()) % 5]
    toxicity.fit(docs, spark.createDataFrame([(1, 1), (2, 0), (3, 0), (4, 1)], "doc_id long, toxic int"))
    assert seen == [([t for i, t in ((2, "short"), (1, long)) if i in open_ids], [y for i, y in ((2, 0), (1, 1)) if i in open_ids])]


def test_held_out_documents(spark):
    """On the supplied tables: what was never trained on is told apart."""
    from quern.session import table
    from tests.conftest import DATA

    docs, labels = (table(spark, f"{DATA}/sf0.01", name) for name in ("documents", "labels"))
    net = toxicity.fit(docs, labels)
    rows = toxicity.score(docs, net, ["doc_id"]).select("row.doc_id", "score").join(labels, "doc_id").filter(toxicity.held_out(F.col("doc_id"))).collect()
    bad, good = ([r.score for r in rows if r.toxic == t] for t in (1, 0))
    assert len(bad) >= 5 and len(good) >= 50
    auc = np.mean([(b > g) + 0.5 * (b == g) for b in bad for g in good])
    assert auc > 0.95 and sum(g >= 0.5 for g in good) <= 1
