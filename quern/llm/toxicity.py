"""Toxicity by a bidirectional gated recurrent network with attention pooling, in numpy.

A word's input is its own vector (if it is frequent in the training sample) beside the mean vector of its hashed character n-grams, so
words never seen before are judged by their spelling. A window's states from both directions are pooled by attention into one logit. A text's
score is that of its worst window, over all overlapping windows of the whole text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm import tokens
from quern.llm.common import give_back, written

WORD = re.compile(r"\w+")
#: Words to a window, and between the starts of two windows.
LENGTH, STRIDE = 48, 36
HIDDEN, WORD_DIM, CHAR_DIM = 8, 8, 16
GRAMS, BUCKETS, MIN_TEXTS = (3, 4, 5), 1 << 14, 4
#: The training sample: labelled rows of each class at most.
SAMPLE = 800
#: Passes over the sample, texts to a step, and steps at least: small samples are gone over more often. Only the number of texts counts, never their length.
EPOCHS, BATCH, LEAST_STEPS, RATE = 6, 24, 150, 0.01
SEED = 5
_REMEMBERED, _WORDS, _WINDOWS = 150_000, 100_000, 2048
#: Gradients under this are zero in all that follows from them in single precision.
_NOTHING = 1e-12
_PART = 10_000 * STRIDE
_F = np.float32


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def parts_of(text: str | None) -> Iterator[list[str]]:
    """A text's words in lists of ``_PART`` and as many more as its last window needs, so that memory does not grow with the text."""
    if not text or len(text) <= _PART:
        yield words_of(text)
        return
    found, held, first = (m.group() for m in WORD.finditer(text.lower())), [], True
    while True:
        held += islice(found, _PART + LENGTH - STRIDE - len(held))
        if first or len(held) > LENGTH - STRIDE:
            yield held
        if len(held) < _PART + LENGTH - STRIDE:
            return
        held, first = held[_PART:], False


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the character n-grams of all words, marked at both ends, and where each word's begin."""
    points = np.frombuffer("".join(f"\x02{w}\x03" for w in words).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint32)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 2
    ends = np.repeat(np.cumsum(lengths), lengths)
    owner = np.repeat(np.arange(len(words)), lengths)
    place = np.arange(len(points))
    rolled, found, who = np.zeros(len(points), np.uint32), [], []
    for n in range(1, max(GRAMS) + 1):
        shifted = points[n - 1 :] if n > 1 else points
        rolled = rolled[: len(shifted)] * np.uint32(0x01000193) ^ shifted * np.uint32(0x9E3779B1)
        if n in GRAMS:
            inside = place[: len(shifted)] + n <= ends[: len(shifted)]
            mixed = rolled[inside] ^ (rolled[inside] >> np.uint32(15))
            found.append((mixed * np.uint32(0x85EBCA6B) >> np.uint32(18)).astype(np.int64) % BUCKETS)
            who.append(owner[: len(shifted)][inside])
    bucket, of = np.concatenate(found), np.concatenate(who)
    order = np.argsort(of, kind="stable")
    return bucket[order], np.searchsorted(of[order], np.arange(len(words)))


def windows(n: int) -> range:
    """Starts of the windows over n words; one at least."""
    return range(0, max(1, n - (LENGTH - STRIDE)), STRIDE)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return _F(0.5) * np.tanh(_F(0.5) * x) + _F(0.5)


@dataclass
class Net:
    """Weights. ``vocabulary`` gives frequent words their rows (from 2; 0 is padding, 1 any other word)."""

    vocabulary: dict[str, int]
    p: dict[str, np.ndarray] = field(default_factory=dict)

    @classmethod
    def fresh(cls, vocabulary: dict[str, int], seed: int = SEED) -> Net:
        rng = np.random.default_rng(seed)
        draw = lambda *s, k: (rng.standard_normal(s) * k).astype(_F)
        dim = WORD_DIM + CHAR_DIM
        return cls(
            vocabulary,
            {
                "word": draw(len(vocabulary) + 2, WORD_DIM, k=0.1),
                "char": draw(BUCKETS, CHAR_DIM, k=0.1),
                "w": draw(2, dim, 3 * HIDDEN, k=0.4),
                "b": np.zeros((2, 1, 3 * HIDDEN), _F),
                "u": draw(2, HIDDEN, 3 * HIDDEN, k=0.3),
                "attend": draw(2, HIDDEN, k=0.3),
                "out": draw(2, HIDDEN, k=0.5),
                "bias": np.zeros(1, _F),
            },
        )

    def inputs(self, words: list[str]) -> tuple[np.ndarray, tuple]:
        """Input vectors of different words, and what the gradient needs."""
        bucket, start = grams(words)
        counts = np.maximum(1, np.diff(np.append(start, len(bucket))))[:, None].astype(_F)
        row = np.fromiter((self.vocabulary.get(w, 1) for w in words), dtype=np.int64, count=len(words))
        char = np.add.reduceat(self.p["char"][bucket], start, axis=0) / counts
        return np.concatenate([self.p["word"][row], char], axis=1), (row, bucket, counts, start)

    def projected(self, x: np.ndarray) -> np.ndarray:
        """Both directions' gate inputs: (2, words, 3 * HIDDEN)."""
        return x @ self.p["w"] + self.p["b"]

    def forward(self, gates: np.ndarray, at: np.ndarray, real: np.ndarray, keep: list | None = None):
        """Logits of windows. ``at``: (windows, LENGTH) places in ``gates``; ``real``: which are words."""
        n, h2, u = len(at), 2 * HIDDEN, self.p["u"]
        h = np.zeros((2, n, HIDDEN), _F)
        states = np.empty((LENGTH, 2, n, HIDDEN), _F)
        for t in range(LENGTH):
            g = np.stack([gates[0][at[:, t]], gates[1][at[:, LENGTH - 1 - t]]])
            hu = h @ u
            zr = _sigmoid(g[..., :h2] + hu[..., :h2])
            z, r = zr[..., :HIDDEN], zr[..., HIDDEN:]
            new = np.tanh(g[..., h2:] + r * hu[..., h2:])
            if keep is not None:
                keep.append((h, zr, new, hu[..., h2:]))
            h = new + z * (h - new)
            states[t, 0], states[LENGTH - 1 - t, 1] = h[0], h[1]
        score = np.einsum("tdnh,dh->nt", states, self.p["attend"], optimize=True)
        score[~real] = -1e9
        weight = np.exp(score - score.max(axis=1, keepdims=True))
        weight /= weight.sum(axis=1, keepdims=True)
        value = np.einsum("tdnh,dh->nt", states, self.p["out"], optimize=True)
        return (weight * value).sum(axis=1) + self.p["bias"][0], states, weight, value

    def backward(self, d_logit: np.ndarray, gates_shape: tuple, at: np.ndarray, kept: list, states, weight, value) -> dict[str, np.ndarray]:
        """Gradients of the weights, with those of the gate inputs under "gates"."""
        h2, u = 2 * HIDDEN, self.p["u"]
        pooled = (weight * value).sum(axis=1, keepdims=True)
        d_value = d_logit[:, None] * weight
        d_score = d_logit[:, None] * weight * (value - pooled)
        grad = {
            "out": np.einsum("nt,tdnh->dh", d_value, states, optimize=True),
            "attend": np.einsum("nt,tdnh->dh", d_score, states, optimize=True),
            "bias": np.array([d_logit.sum()], _F),
            "u": np.zeros_like(u),
        }
        d_state = np.einsum("nt,dh->tdnh", d_value, self.p["out"]) + np.einsum("nt,dh->tdnh", d_score, self.p["attend"])
        d_gates = np.empty((LENGTH, 2, len(at), 3 * HIDDEN), _F)
        dh = np.zeros_like(kept[0][0])
        for t in range(LENGTH - 1, -1, -1):
            h, zr, new, hn = kept[t]
            z, r = zr[..., :HIDDEN], zr[..., HIDDEN:]
            dh = dh + np.stack([d_state[t, 0], d_state[LENGTH - 1 - t, 1]])
            dn = dh * (1 - z) * (1 - new * new)
            dz = dh * (h - new) * z * (1 - z)
            dr = dn * hn * r * (1 - r)
            into = np.concatenate([dz, dr, dn * r], axis=-1)
            grad["u"] += np.swapaxes(h, 1, 2) @ into
            dh = dh * z + into @ np.swapaxes(u, 1, 2)
            d_gates[t] = np.concatenate([dz, dr, dn], axis=-1)
        total = np.zeros(gates_shape, _F)
        for k, place in enumerate((at.T, at.T[::-1])):
            flat = place.ravel()
            order = np.argsort(flat, kind="stable")
            first = np.flatnonzero(np.diff(flat[order], prepend=-1))
            total[k, flat[order][first]] = np.add.reduceat(d_gates[:, k].reshape(-1, 3 * HIDDEN)[order], first, axis=0)
        return grad | {"gates": total}

    def gradient(self, d_logit: np.ndarray, gates: np.ndarray, laid: np.ndarray) -> dict[str, np.ndarray]:
        """The gradients of all windows: each part goes forward and backward by itself, without those whose share is nothing."""
        matters = np.flatnonzero(np.abs(d_logit) > _NOTHING)
        matters = matters if len(matters) else np.arange(min(1, len(laid)))
        out: dict[str, np.ndarray] = {}
        for part in (matters[i : i + _WINDOWS] for i in range(0, len(matters), _WINDOWS)):
            kept: list = []
            _, *rest = self.forward(gates, laid[part], _real(laid[part]), kept)
            for name, g in self.backward(d_logit[part], gates.shape, laid[part], kept, *rest).items():
                out[name] = out[name] + g if name in out else g
        return out


def _chunks(laid: np.ndarray) -> Iterator[np.ndarray]:
    """Windows in parts, so that memory does not grow with a text's length."""
    return (laid[i : i + _WINDOWS] for i in range(0, len(laid), _WINDOWS))


def _laid_out(texts: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Windows of all texts over word places (padding is place 0), and the text of each."""
    rows, owner = [], []
    for k, ids in enumerate(texts):
        for s in windows(len(ids)):
            part = ids[s : s + LENGTH]
            rows.append(part + [0] * (LENGTH - len(part)))
            owner.append(k)
    return np.array(rows, dtype=np.int64).reshape(-1, LENGTH), np.array(owner, dtype=np.int64)


def train(texts: list[str | None], toxic: list[int], epochs: int = EPOCHS, seed: int = SEED) -> Net:
    """A net fitted to whole texts: a text's logit is a soft maximum over its windows, so that the windows that matter learn.

    Without both classes the net knows the one class only (or nothing: score 0) and is not fitted.
    """
    split = [words_of(t) for t in texts]
    seen = Counter(chain.from_iterable(map(set, split)))
    net = Net.fresh({w: i for i, w in enumerate(sorted(w for w, c in seen.items() if c >= MIN_TEXTS), 2)}, seed)
    target = np.array(toxic, dtype=_F)
    if len(set(toxic)) < 2:
        net.p["out"][:] = 0
        net.p["bias"][0] = 10 if set(toxic) == {1} else -10
        return net
    rng, step = np.random.default_rng(seed), 0
    mean = {k: np.zeros_like(v) for k, v in net.p.items()}
    square = {k: np.zeros_like(v) for k, v in net.p.items()}
    for _ in range(max(epochs, -(-LEAST_STEPS * BATCH // len(texts)))):
        order = rng.permutation(len(texts))
        for i in range(0, len(order), BATCH):
            chosen = order[i : i + BATCH]
            names: dict[str, int] = {}
            laid, owner = _laid_out([[names.setdefault(w, len(names) + 1) for w in split[k]] for k in chosen])
            x, (row, bucket, counts, first_gram) = net.inputs(["pad", *names])
            x[0] = 0
            gates = net.projected(x)
            kept: list | None = [] if len(laid) <= _WINDOWS else None
            passed = [net.forward(gates, at, _real(at), kept) for at in _chunks(laid)] if kept is not None else []
            logit = passed[0][0] if passed else np.concatenate([net.forward(gates, at, _real(at))[0] for at in _chunks(laid)])
            d_logit, sums = np.zeros_like(logit), np.zeros(len(chosen), _F)
            for k in range(len(chosen)):
                own = owner == k
                share = np.exp(logit[own] - logit[own].max())
                share /= share.sum()
                sums[k] = (share * logit[own]).sum()
                error = 1 / (1 + np.exp(-np.clip(sums[k], -30, 30))) - target[chosen[k]]
                d_logit[own] = error / len(chosen) * share * (1 + logit[own] - sums[k])
            grad = net.backward(d_logit.astype(_F), gates.shape, laid, kept, *passed[0][1:]) if passed else net.gradient(d_logit.astype(_F), gates, laid)
            d_gates = grad.pop("gates")
            grad["b"] = d_gates.sum(axis=1, keepdims=True)
            grad["w"] = np.swapaxes(np.broadcast_to(x, (2, *x.shape)), 1, 2) @ d_gates
            dx = (d_gates @ np.swapaxes(net.p["w"], 1, 2)).sum(axis=0)
            dx[0] = 0
            grad["word"], grad["char"] = np.zeros_like(net.p["word"]), np.zeros_like(net.p["char"])
            np.add.at(grad["word"], row, dx[:, :WORD_DIM])
            of = np.diff(np.append(first_gram, len(bucket)))
            spread = np.repeat(dx[:, WORD_DIM:] / counts, of, axis=0)
            by = np.argsort(bucket, kind="stable")
            first = np.flatnonzero(np.diff(bucket[by], prepend=-1))
            grad["char"][bucket[by][first]] = np.add.reduceat(spread[by], first, axis=0)
            step += 1
            for k, g in grad.items():
                mean[k] += _F(0.1) * (g - mean[k])
                square[k] += _F(0.01) * (g * g - square[k])
                net.p[k] -= _F(RATE) * (mean[k] / _F(1 - 0.9**step)) / (np.sqrt(square[k] / _F(1 - 0.99**step)) + _F(1e-6))
    worst = np.array(Scorer(net).logits(texts))
    net.p["bias"][0] -= _threshold(worst, target)
    return net


def _real(laid: np.ndarray) -> np.ndarray:
    real = laid > 0
    real[:, 0] = True  # a text without words pools its padding
    return real


def _threshold(logit: np.ndarray, target: np.ndarray) -> float:
    """The middle of the gap with fewest errors at either side."""
    order = np.argsort(logit)
    values = logit[order]
    errors = np.cumsum(target[order]) + (1 - target[order]).sum() - np.cumsum(1 - target[order])
    gaps = np.diff(values, append=values[-1] + 1)
    best = max(range(len(values)), key=lambda i: (-errors[i], gaps[i]))
    return float(values[best] + gaps[best] / 2)


class Scorer:
    """Scores texts, remembering words' gate inputs."""

    def __init__(self, net: Net) -> None:
        self.net = net
        self._forget()

    def _forget(self) -> None:
        self.names: dict[str, int] = {}
        self.gates = np.repeat(self.net.p["b"], 1024, axis=1)
        self.known = 1

    def _places(self, words: list[list[str]]) -> list[list[int]]:
        if len(self.names) > _REMEMBERED:
            self._forget()
        names = self.names
        new = [w for w in set(chain.from_iterable(words)) if w not in names]
        if new:
            for w in new:
                names[w] = len(names) + 1
            while self.gates.shape[1] < len(names) + 1:
                self.gates = np.concatenate([self.gates, np.zeros_like(self.gates)], axis=1)
            for i in range(0, len(new), 50_000):
                part = new[i : i + 50_000]
                self.gates[:, self.known : self.known + len(part)] = self.net.projected(self.net.inputs(part)[0])
                self.known += len(part)
        return [list(map(names.__getitem__, w)) for w in words]

    def logits(self, texts: Iterable[str | None]) -> list[float]:
        """Each text's largest logit over its windows; windows of many texts, or of a part of a long one, go through together."""
        out: list[float] = []
        held: list[list[str]] = []
        whose: list[int] = []
        rows: list[list[int]] = []
        owner: list[int] = []

        def run() -> None:
            at = np.array(rows, dtype=np.int64)
            logit = self.net.forward(self.gates, at, _real(at))[0]
            for k, v in zip(owner, logit.tolist()):
                out[k] = max(out[k], v)
            rows.clear()
            owner.clear()

        def flush() -> None:
            for k, ids in zip(whose, self._places(held)):
                for s in windows(len(ids)):
                    part = ids[s : s + LENGTH]
                    rows.append(part + [0] * (LENGTH - len(part)))
                    owner.append(k)
                    if len(rows) >= _WINDOWS:
                        run()
            if rows:
                run()
            held.clear()
            whose.clear()

        size = 0
        for text in texts:
            out.append(-np.inf)
            for part in parts_of(text):
                held.append(part)
                whose.append(len(out) - 1)
                size += len(part)
                if size > _WORDS:
                    flush()
                    size = 0
        if held:
            flush()
        return out


def held_out(doc_id: Column) -> Column:
    """Rows kept from training: crc32 of the id as text, modulo 5, is 0. A null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Net:
    """A net trained on the driver on at most ``sample`` labelled rows of each class, none of them held out.

    Twice as many ids of each class are picked from the labels alone, those of the least hashes of the id: only ids under a bound on the hash, by the class's
    count, are looked at, so no task and not the driver sees more of a class than a few times ``sample``. Their texts are looked up whole, however long they
    are (a broadcast of four times ``sample`` ids at most, and no shuffle of other texts), and written; the first ``sample`` of each class by the hash are brought to the driver, as
    texts only. An id that is labelled both ways counts as toxic; of an id with several texts the least counts. Rows without label or text are no training rows.
    """
    open_ = labels.filter(F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull())
    open_ = open_.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    open_ = written(open_.withColumn("pick", F.xxhash64("doc_id", F.lit(SEED))), "labelled")
    below = F.lit(False)
    for r in open_.groupBy("toxic").agg(F.count("*").alias("n")).collect():
        bound = F.lit(min((1 << 63) - 1, -(1 << 63) + (1 << 64) * 4 * sample // r.n))  # about four times ``sample`` hashes lie below: twice what is looked for
        below |= (F.col("toxic") == r.toxic) & (F.col("pick") <= bound)
    drawn = sorted(open_.filter(below).collect(), key=lambda r: (r.pick, r.doc_id))
    picked = [r for label in (0, 1) for r in [r for r in drawn if r.toxic == label][: 2 * sample]]
    if not picked:
        return train([], [])
    chosen = docs.sparkSession.createDataFrame(picked, "doc_id long, toxic int, pick long")
    texts = docs.filter(F.length("text") > 0).select(F.col("doc_id").cast("long"), "text")
    found = written(texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic", "pick").agg(F.min("text").alias("text")), "labelled-texts")
    ids = sorted(found.select("doc_id", "toxic", "pick").collect(), key=lambda r: (r.pick, r.doc_id))
    taken = [r for label in (0, 1) for r in [r for r in ids if r.toxic == label][:sample]]
    wanted = docs.sparkSession.createDataFrame([(r.doc_id,) for r in taken], "doc_id long")
    texts = {r.doc_id: r.text for r in found.join(F.broadcast(wanted), "doc_id", "left_semi").select("doc_id", "text").collect()}
    net = train([texts[r.doc_id] for r in taken], [int(r.toxic) for r in taken])
    give_back()  # the driver lives on, too
    return net


def score(docs: DataFrame, net: Net, keep: list[str] | None = None) -> DataFrame:
    """Every row as ``row`` (its columns ``keep``; all by default) with ``score`` (0 to 1): all overlapping windows of the whole text.

    Null and empty texts are scored as one window of padding. Repeated rows get equal scores; other columns are never looked at
    and cannot clash, as they stay inside ``row``.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)  # fixed size: the net's parameters

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens.forget()
        scorer = Scorer(shared.value)
        for batch in batches:
            logit = np.array(scorer.logits(t.as_py() for t in batch.column(1)), dtype=np.float64)
            found = pa.array(1 / (1 + np.exp(-np.clip(logit, -30, 30))), pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), found], names=["row", "score"])
        del scorer
        give_back()

    whole = docs.select(F.struct(*(keep or ["*"])).alias("row"), F.col("text").alias("_text"))
    return whole.mapInArrow(run, whole.select("row", F.lit(0.0).alias("score")).schema)
