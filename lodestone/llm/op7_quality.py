"""Quality classifier from positive and unlabelled text.

Trusted positives are documents that ``labels`` marks as good; unlabelled text is a sample of documents
without a label. Labels of bad documents are not used. A small network on style features is trained on the
non-negative risk estimate of Kiryo et al. (2017): the negative part, unlabelled risk less the share that
positives account for, is not allowed below zero. The class prior comes from best-bin estimation (Garg et
al., 2021): a first classifier tells positives from unlabelled text, and on its other half of the sample
the smallest ratio of upper tails, with a confidence term, bounds the prior.

Both samples are bounded (``POSITIVES``, ``UNLABELLED`` documents with the smallest hashes of their ids, one
text of at most 1 MB for each); scoring is one pass over all whole texts without a shuffle. Inputs are features of the text alone.

Defined cases: a null text scores as an empty one; a null doc_id is not held out; rows with one doc_id
score each; without positives or unlabelled text every score is 0.5; other columns are not read.
"""

from __future__ import annotations

from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.common import adam, held_out, labelled_sample, mapped_texts, one_text, table

POSITIVES, UNLABELLED, HIDDEN, STEPS, SEED = 6000, 12000, 12, 400, 11
THRESHOLD = 0.3
N_FEATURES = 20
_SYMBOLS = b"#*$%&|<>"


def features(text: str) -> np.ndarray:
    """Style of a whole text: shares of kinds of characters, words and lines, and logarithms of counts."""
    raw = text.encode("utf-8", "surrogatepass")
    words = text.split()
    n, size = max(1, len(words)), max(1, len(raw))
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    lines = [x for x in text.split("\n") if x.strip()]
    symbols = count[list(_SYMBOLS)]
    letters = max(1, count[65:91].sum() + count[97:123].sum())
    return np.array([
        count[65:91].sum() / letters, symbols.sum() / size, count[ord("|")] / n, count[ord("!")] / n, count[48:58].sum() / size,
        count[ord(".")] / n, count[ord(",")] / n, count[128:].sum() / size, sum(map(eq, words, words[1:])) / n, len(set(words)) / n,
        min(1.0, size / n / 20), np.log1p(len(words)) / 10, np.log1p(len(lines)) / 10, len(set(lines)) / max(1, len(lines)), min(1.0, len(words) / max(1, len(lines)) / 100),
        (count[:32].sum() - count[10]) / size, count[ord("@")] / n, (count[ord("/")] + count[ord(":")]) / n, sum(map(str.isupper, words)) / n, min(1.0, symbols.sum() / n),
    ])


def _feature_rows(batches):
    for batch in batches:
        rows = [features(x or "").tobytes() for x in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("positive"), pa.array(rows, pa.binary())], ["positive", "features"])


def _forward(params: list, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    w, b, v, c = params
    hidden = np.tanh(x @ w + b)
    return hidden, hidden @ v + c[0]


def _backward(params: list, x: np.ndarray, hidden: np.ndarray, slope: np.ndarray) -> list:
    w, b, v, c = params
    inner = np.outer(slope, v) * (1 - hidden * hidden)
    return [x.T @ inner + 1e-4 * w, inner.sum(0), hidden.T @ slope + 1e-4 * v, np.array([slope.sum()])]


def _fresh(seed: int) -> list:
    r = np.random.default_rng(seed)
    return [r.normal(0, 0.3, (N_FEATURES, HIDDEN)), np.zeros(HIDDEN), r.normal(0, 0.3, HIDDEN), np.zeros(1)]


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, delta: float = 0.1, gamma: float = 0.01) -> float:
    """Share of positives in unlabelled rows by best-bin estimation."""
    p, u = positive[::2], unlabelled[::2]
    x = np.vstack([p, u])
    y = np.r_[np.ones(len(p)), np.zeros(len(u))]
    weight = np.r_[np.full(len(p), 0.5 / len(p)), np.full(len(u), 0.5 / len(u))]

    def gradient(params, _):
        hidden, z = _forward(params, x)
        return _backward(params, x, hidden, weight * (_sigmoid(z) - y))

    fitted = adam(_fresh(SEED), gradient, STEPS // 2, 0.02)
    p, u = _forward(fitted, positive[1::2])[1], _forward(fitted, unlabelled[1::2])[1]
    if not len(p) or not len(u):
        return 0.5
    cuts = np.unique(p)
    above_p = 1 - np.searchsorted(np.sort(p), cuts) / len(p)
    above_u = 1 - np.searchsorted(np.sort(u), cuts) / len(u)
    slack = (1 + gamma) * (np.sqrt(np.log(4 / delta) / (2 * len(u))) + np.sqrt(np.log(4 / delta) / (2 * len(p))))
    best = np.argmin((above_u + slack) / np.maximum(above_p, 1e-9))
    return float(np.clip(above_u[best] / max(above_p[best], 1e-9), 0.01, 0.99))


def fit(positive: np.ndarray, unlabelled: np.ndarray) -> dict:
    """Standardisation and weights of the classifier; ``prior`` is the estimated share of positives."""
    both = np.vstack([positive, unlabelled])
    mean, scale = both.mean(0), both.std(0) + 1e-3
    p, u = np.clip((positive - mean) / scale, -8, 8), np.clip((unlabelled - mean) / scale, -8, 8)
    prior = estimate_prior(p, u)
    x, n = np.vstack([p, u]), len(p)

    def gradient(params, _):
        hidden, z = _forward(params, x)
        s = _sigmoid(z)
        negative = np.logaddexp(0, z)  # loss of a row taken as negative
        slope = np.zeros(len(x))
        rest = negative[n:].mean() - prior * negative[:n].mean()
        sign = 1.0 if rest >= 0 else -1.0  # below zero: step back along the negative part alone
        slope[n:] = sign * s[n:] / len(u)
        slope[:n] = -sign * prior * s[:n] / n
        if rest >= 0:
            slope[:n] += prior * (s[:n] - 1) / n
        return _backward(params, x, hidden, slope)

    return {"mean": mean, "scale": scale, "params": adam(_fresh(SEED + 1), gradient, STEPS, 0.02), "prior": prior}


def train(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> dict | None:
    """The model, from bounded samples of the training fold and of documents without labels; None if either is empty."""
    good = labelled_sample(docs, labels, "quality", {1: positives}).select("text", F.lit(1).alias("positive"))
    free = docs.where("doc_id is not null").select("doc_id").join(labels.select("doc_id"), "doc_id", "left_anti").orderBy(F.xxhash64("doc_id"), "doc_id").limit(unlabelled)
    web = one_text(docs, free.distinct(), 1 << 20).select("text", F.lit(0).alias("positive"))
    rows = good.unionByName(web).mapInArrow(_feature_rows, "positive int, features binary").collect()
    sides = [np.frombuffer(b"".join(sorted(bytes(r.features) for r in rows if r.positive == kind)), "<f8").reshape(-1, N_FEATURES) for kind in (1, 0)]
    if min(map(len, sides)) < 2:
        return None
    order = np.random.default_rng(SEED)
    return fit(*[order.permutation(x) for x in sides])


def _scorer(model: dict | None):
    def score(texts):
        if model is None or not len(texts):
            return [pa.array(np.full(len(texts), 0.5))]
        x = np.clip((np.array([features(t or "") for t in texts.to_pylist()]) - model["mean"]) / model["scale"], -8, 8)
        return [pa.array(_sigmoid(_forward(model["params"], x)[1]))]

    return score


def score(docs: DataFrame, model: dict | None, keep: list[str], name: str = "score") -> DataFrame:
    """Columns ``keep`` of docs and, as ``name``, the quality of each whole text from 0 to 1."""
    return mapped_texts(docs, keep, [T.StructField(name, T.DoubleType())], _scorer(model))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")), ["doc_id"])
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
