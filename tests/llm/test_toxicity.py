"""The chain against a slow version: features by plain counting, weights by Newton steps, folds and order one by one."""

import collections
import hashlib
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.llm import toxicity
from tests.conftest import DATA

def chain():
    return {"low_quality": F.col("quality") == 0, "toxic": F.col("toxic") == 1}


def slow_terms(text):
    words = {w for w in re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower())}
    return words | {w[:k] + b"*" for w in words for k in (5, 6, 7) if len(w) > k}


def slow_shape(text):
    n = max(1, len(text))
    words = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower())
    return [1.0, min(1.0, 10 * sum(chr(b) in "#*$%&|<>!" for b in text) / n), sum(65 <= b <= 90 for b in text) / n, float(len(words) < 50)]


def newton(x, y):
    """Ridge logistic regression to convergence; the constant is not penalised."""
    w = np.zeros(x.shape[1])
    if not len(y) or y.min() == y.max():
        rate = (y.sum() + 0.5) / (len(y) + 1)
        w[0] = math.log(rate / (1 - rate))
        return w
    ridge = np.diag([0.0] + [toxicity.RIDGE] * (x.shape[1] - 1))
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= np.linalg.solve((x.T * (p * (1 - p) + 1e-12)) @ x + ridge, x.T @ (p - y) + ridge @ w)
    return w


def slow_chain(rows):
    """rows: (text, y0, y1) -> words, weights, and predict(text)."""
    once = {}
    for text, *ys in rows:
        h = hashlib.sha256(text).digest()
        have = once.get(h)
        once[h] = (text, *ys) if have is None else (text, *(max(a, b) for a, b in zip(have[1:], ys, strict=True)))
    got = [once[h] for h in sorted(once)]
    folds = np.array([int.from_bytes(h[:8], "big") % 3 for h in sorted(once)])
    labels = np.array([g[1:] for g in got], dtype=float)
    held = [slow_terms(g[0]) for g in got]
    n, counts = len(got), collections.Counter(t for h in held for t in h)
    best = []
    for t, c in counts.items():
        if c < toxicity.MIN_DOCS:
            continue
        score = 0.0
        for j in range(2):
            share = labels[:, j].sum() / n
            expected = c * share
            seen = sum(labels[i, j] for i in range(n) if t in held[i])
            below = expected * (1 - share) * (1 - c / (n + 1))
            score = max(score, (seen - expected) ** 2 / below if below else 0.0)
        if score >= toxicity.MIN_CHI2:
            best.append((-score, t))
    words = sorted(t for _, t in sorted(best)[: toxicity.MAX_WORDS])
    x = np.array([slow_shape(g[0]) + [float(t in h) for t in words] for g, h in zip(got, held, strict=True)])
    weights = []
    for j in range(2):
        weights.append(newton(x, labels[:, j]))
        out = np.zeros(n)
        for f in range(3):
            w = newton(x[folds != f], labels[folds != f, j])
            out[folds == f] = 1 / (1 + np.exp(-x[folds == f] @ w))
        x = np.column_stack([x, out])

    def predict(text):
        row, out = slow_shape(text) + [float(t in slow_terms(text)) for t in words], []
        for w in weights:
            out.append(1 / (1 + math.exp(-float(np.dot(w, row)))))
            row = [*row, out[-1]]
        return out

    return words, weights, predict


def test_chain_against_slow_version(spark):
    rng = np.random.default_rng(3)
    words = [f"word{k}x" for k in range(60)]
    rows = []
    for i in range(240):
        toxic, poor = int(i % 4 == 0), int(i % 4 == 0 or i % 5 == 0)
        body = [words[k] for k in rng.integers(0, 60, 30)] + ["moronic", "TRASHY!"] * toxic + ["###", "blah"] * poor
        rows.append((i, " ".join(rng.permutation(body).tolist()), 1 - poor, toxic))
    rows += [(300, rows[0][1], 1, 0), (301, rows[1][1], 0, 1)]  # copies that disagree
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int, toxic int")
    labels = df.drop("text").unionByName(spark.createDataFrame([(5, 0, 1), (6, None, 1)], "doc_id long, quality int, toxic int"))
    model = toxicity.train(df, labels, chain())
    by_id = {r[0]: r for r in rows}
    facts = {i: [int(q == 0), int(t == 1)] for i, _, q, t in rows}
    facts[5] = [1, 1]
    want_words, weights, predict = slow_chain([(by_id[i][1].encode(), *y) for i, y in facts.items()])
    assert sorted(model.ids, key=model.ids.get) == want_words and len(want_words) >= 4
    for got, want in zip(model.weights, weights, strict=True):
        assert got == pytest.approx(want, abs=0.02)
    for r in toxicity.predict(df, model, ["doc_id", "text"]).collect():
        assert [r["p_low_quality"], r["p_toxic"]] == pytest.approx(predict(r["text"].encode()), abs=0.01)
    assert model.weights[1][-1] == pytest.approx(weights[1][-1], abs=0.02)  # of the earlier category's probability


def test_model_does_not_follow_partitions(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{n}.parquet") for n in ("documents", "labels"))
    a = toxicity.train(docs, labels, chain())
    b = toxicity.train(docs.repartition(7), labels.repartition(3), chain())
    assert a.ids == b.ids and all(np.array_equal(x, y) for x, y in zip(a.weights, b.weights, strict=True))
