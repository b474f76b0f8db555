"""Toxicity by a classifier chain of linear models.

Categories are predicted in order; the model of each category sees the word features and the probabilities of the
earlier categories. In training those probabilities are out-of-fold (`FOLDS` folds by text); in prediction they
come from the models fitted on all training rows. Training takes a bounded sample of labelled rows
(`TRAIN_ROWS` ids, lowest hash first; one row for each text, told apart by sha256; where rows of one id or of one text
disagree, the label is true if any says so). Features are the presence of the words and word
beginnings (`PREFIX_BYTES` long) most associated with any category (`MAX_WORDS` at most, chi-square of at least
`MIN_CHI2` in `MIN_DOCS` texts), and four shape features. Prediction covers all rows and whole texts.

Edge cases: null text counts as empty; rows without labels are only predicted; null labels are left out of
training; with no labelled rows, or one class, the category has its smoothed base rate; repeated rows are predicted
alike; an empty table gives an empty result; only the columns named are read, so extra columns cannot clash.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import alnum_words, stored, utf8

TRAIN_ROWS, MAX_WORDS, MIN_DOCS, MIN_CHI2, FOLDS, RIDGE, STEPS = 6000, 1000, 5, 24.0, 3, 2.0, 300
PREFIX_BYTES = (5, 6, 7)
SYMBOLS = b"#*$%&|<>!"


def terms(words: list[bytes]) -> set[bytes]:
    """Distinct words and their beginnings, these marked by a star."""
    once = set(words)
    out = set(once)
    for k in PREFIX_BYTES:
        out.update([w[:k] + b"*" for w in once if len(w) > k])
    return out


def shape_features(raw: bytes, n_words: int) -> list[float]:
    size = max(1, len(raw))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    upper = len(raw) - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    return [1.0, min(1.0, 10 * symbols / size), upper / size, float(n_words < 50)]


def fold(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "big") % FOLDS


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ridge logistic regression by accelerated gradient steps; the first column is the unpenalised constant."""
    w = np.zeros(x.shape[1])
    if not len(y) or y.min() == y.max():
        rate = (y.sum() + 0.5) / (len(y) + 1)
        w[0] = np.log(rate / (1 - rate))
        return w
    penalty = np.full(x.shape[1], RIDGE)
    penalty[0] = 0
    probe = np.random.default_rng(5).standard_normal(x.shape[1])
    for _ in range(20):
        probe = x.T @ (x @ (probe / np.linalg.norm(probe)))
    step, ahead = 1 / (np.linalg.norm(probe) / 4 + RIDGE), w.copy()
    for k in range(STEPS):
        new = ahead - step * (x.T @ (sigmoid(x @ ahead) - y) + penalty * ahead)
        ahead = new + (k / (k + 3)) * (new - w)
        w = new
    return w


class Chain:
    """Word ids, and a weight vector for each category: shape features, words, earlier probabilities."""

    def __init__(self, names: list[str], words: list[bytes]):
        self.names, self.ids = names, {w: i for i, w in enumerate(words)}
        self.keys = frozenset(self.ids)
        self.weights: list[np.ndarray] = []

    def fit(self, shapes: np.ndarray, present: list[list[int]], labels: np.ndarray, folds: np.ndarray) -> Chain:
        x = np.zeros((len(present), shapes.shape[1] + len(self.ids)))
        if len(present):
            x[:, : shapes.shape[1]] = shapes
        for i, got in enumerate(present):
            x[i, [shapes.shape[1] + k for k in got]] = 1
        for j in range(len(self.names)):
            y = labels[:, j]
            self.weights.append(logistic(x, y))
            out = np.zeros(len(y))
            for f in range(FOLDS):
                out[folds == f] = sigmoid(x[folds == f] @ logistic(x[folds != f], y[folds != f]))
            x = np.column_stack([x, out])
        return self

    def predict(self, raw: bytes) -> list[float]:
        words = alnum_words(raw)
        shape = np.array(shape_features(raw, len(words)))
        got = [len(shape) + self.ids[w] for w in self.keys.intersection(terms(words))]
        out: list[float] = []
        for w in self.weights:
            z = float(w[: len(shape)] @ shape) + float(w[got].sum())
            first = len(shape) + len(self.ids)
            z += sum(float(w[first + k]) * p for k, p in enumerate(out))
            out.append(1 / (1 + float(np.exp(-min(30.0, max(-30.0, z))))))
        return out


def train(df: DataFrame, labels: DataFrame, chain: dict[str, Column], doc_id: str = "doc_id", text: str = "text", rows: int = TRAIN_ROWS) -> Chain:
    """labels: doc_id and the columns that the chain's boolean expressions use."""
    names = list(chain)
    wanted = labels.select(F.col(doc_id).alias("i"), *(chain[n].cast("int").alias(f"y{j}") for j, n in enumerate(names))).dropna()
    wanted = wanted.groupBy("i").agg(*(F.max(f"y{j}").alias(f"y{j}") for j in range(len(names))))
    share = min(1.0, 1.2 * rows / max(1, wanted.count()))  # of the hash range: the sort sees few rows more than it keeps
    most = min(int(share * 2**64) - 2**63, 2**63 - 1)
    chosen = wanted.where(F.xxhash64("i") <= most).orderBy(F.xxhash64("i"), "i").limit(rows)
    texts = df.select(F.col(doc_id).alias("i"), F.col(text).alias("t"))

    def features(batches):
        for batch in batches:
            raws = [x or b"" for x in utf8(batch, "t")]
            split = [alnum_words(x) for x in raws]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([hashlib.sha256(x).digest() for x in raws], pa.binary()),
                    pa.array([shape_features(x, len(w)) for x, w in zip(raws, split, strict=True)], pa.list_(pa.float64())),
                    pa.array([sorted(terms(w)) for w in split], pa.list_(pa.binary())),
                    *(batch.column(f"y{j}") for j in range(len(names))),
                ],
                names=["h", "shape", "words", *(f"y{j}" for j in range(len(names)))],
            )

    ys = [f"y{j}" for j in range(len(names))]
    schema = "h binary, shape array<double>, words array<binary>, " + ", ".join(f"{y} int" for y in ys)
    joined = texts.join(F.broadcast(chosen), "i").select("t", *ys)
    once = joined.mapInArrow(features, schema).groupBy("h").agg(F.first("shape").alias("shape"), F.first("words").alias("words"), *(F.max(y).alias(y) for y in ys))
    sample = stored(once, "labelled")
    total = sample.agg(F.count("*").alias("n"), *(F.sum(y).alias(y) for y in ys)).first()
    by_word = sample.select(F.explode("words").alias("w"), *ys).groupBy("w").agg(F.count("*").alias("n"), *(F.sum(y).alias(y) for y in ys)).where(F.col("n") >= MIN_DOCS)
    n, score = F.lit(float(total["n"] or 1)), F.lit(0.0)
    for y in ys:
        share = (total[y] or 0) / (total["n"] or 1)
        expected = F.col("n") * share
        score = F.greatest(score, F.coalesce(F.try_divide((F.col(y) - expected) * (F.col(y) - expected), expected * (1 - share) * (1 - F.col("n") / (n + 1))), F.lit(0.0)))
    words = [bytes(r["w"]) for r in by_word.select("w", score.alias("x")).where(F.col("x") >= MIN_CHI2).orderBy(F.desc("x"), "w").limit(MAX_WORDS).collect()]
    model = Chain(names, sorted(words))
    keys = F.array(*(F.lit(bytearray(w)) for w in words)) if words else F.array().cast("array<binary>")
    got = sorted(sample.select("h", "shape", F.array_intersect("words", keys).alias("words"), *ys).collect(), key=lambda r: bytes(r["h"]))
    return model.fit(
        np.array([r["shape"] for r in got]).reshape(len(got), 4),
        [[model.ids[bytes(w)] for w in r["words"]] for r in got],
        np.array([[r[y] for y in ys] for r in got], dtype=float).reshape(len(got), len(ys)),
        np.array([fold(bytes(r["h"])) for r in got]),
    )


def predict(df: DataFrame, model: Chain, keep: list[str], text: str = "text") -> DataFrame:
    """`keep` columns and p_<category> for each category of the chain."""
    from siltstone.llm.common import per_row

    shared = df.sparkSession.sparkContext.broadcast(model)
    return per_row(df, keep, text, ", ".join(f"p_{n} double" for n in model.names), lambda raw: tuple(shared.value.predict(raw)))
