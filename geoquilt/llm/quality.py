"""Quality: positive-unlabelled learning on measures of whole texts.

Trusted positives are labelled texts of class 1; the unlabelled side is a sample
of all texts, whatever they are.  The share of positives among them, the class
prior, is estimated from how much denser trusted positives are than unlabelled
texts where positives lie.  A small network then minimises the non-negative
unbiased risk: prior times the risk on positives, plus the unlabelled risk less
the positives' part of it, which is kept from falling below zero.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoquilt.llm.labelled import sampled, training_texts

MEASURES = 22
UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]")
DIGIT = re.compile(r"[0-9]")
SENTENCE = re.compile(r"[.!?…][\s]")
MARKS = "!?.,;:|#%&*$@=+<>{}[]()\\/_~^\"'-"


def measures(text: str) -> list[float]:
    """Shape, repetition and punctuation of a whole text; an empty one has zeros."""
    words = text.split()
    n, size = len(words), len(text)
    if not n:
        return [0.0] * MEASURES
    counts = Counter(words)
    top = counts.most_common(3)
    lengths = np.fromiter(map(len, words), float, n)
    lines = [x for x in text.split("\n") if x]
    line_counts = Counter(lines)
    marks = {c: text.count(c) for c in MARKS}
    n_marks = sum(marks.values())
    symbols = sum(marks[c] for c in "|#%&*$@=+<>{}[]\\/_~^")
    runs = sum(a == b for a, b in zip(words, words[1:], strict=False))
    head = len({w[:3] for w in counts})
    p = np.fromiter(counts.values(), float, len(counts)) / n
    return [
        math.log1p(n), math.log1p(size / n), lengths.mean(), lengths.std(), min(lengths.max(), 100.0) / 10,
        len(counts) / n, math.log1p(len(counts)) / math.log1p(n), top[0][1] / n, sum(c for _, c in top) / n, runs / n,
        float(-(p * np.log(p)).sum()) / math.log1p(n), len(UPPER.findall(text)) / size, len(DIGIT.findall(text)) / size,
        n_marks / size, symbols / size, marks["!"] / n, (marks["."] + marks[","]) / n, len(SENTENCE.findall(text)) / n,
        sum(c for c in line_counts.values() if c > 1) / max(1, len(lines)), math.log1p(n / max(1, len(lines))),
        sum(c == 1 for c in counts.values()) / n, head / max(1, len(counts)),
    ]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * np.clip(x, -60, 60)))


@dataclass(frozen=True)
class QualityModel:
    """Standardised measures, one hidden layer, a score; and the class prior it was trained with."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    prior: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return _sigmoid(np.maximum(z @ self.w1 + self.b1, 0) @ self.w2 + self.b2)


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, steps: int = 30) -> float:
    """Share of positives among the unlabelled rows, from standardised measures.

    A logistic model tells trusted positives from unlabelled rows.  Where there
    are only positives, its odds times n_unlabelled / n_positive are the ratio of
    the two densities, one over the prior; the median over every second positive,
    which the fit does not see, is taken, and held between 0.05 and 0.95.
    """
    fit, judge = positive[::2], positive[1::2] if len(positive) > 1 else positive
    x = np.column_stack([np.vstack([fit, unlabelled]), np.ones(len(fit) + len(unlabelled))])
    y = np.r_[np.ones(len(fit)), np.zeros(len(unlabelled))]
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = _sigmoid(x @ w)
        w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.eye(len(w)), x.T @ (p - y) + w)
    p = np.clip(_sigmoid(np.column_stack([judge, np.ones(len(judge))]) @ w), 1e-6, 1 - 1e-6)
    ratio = p / (1 - p) * len(unlabelled) / len(fit)
    return float(np.clip(1 / np.median(ratio), 0.05, 0.95))


def risk_and_gradients(values: list[np.ndarray], p: np.ndarray, u: np.ndarray, prior: float) -> tuple[float, list[np.ndarray]]:
    """Non-negative PU risk of positives ``p`` and unlabelled ``u`` with the sigmoid loss, and the step's gradients.

    Where the unlabelled part is below zero it has over-fitted; the step climbs back.
    """
    x = np.vstack([p, u])
    act = np.maximum(x @ values[0] + values[1], 0)
    s = _sigmoid(act @ values[2] + values[3][0])
    slope = s * (1 - s)  # of the loss sigmoid(-g) of a negative target; the positive's is its negative
    k = len(p)
    negative = s[k:].mean() - prior * s[:k].mean()
    d_g = np.zeros(len(x))
    if negative >= 0:
        d_g[:k] = -2 * prior * slope[:k] / k
        d_g[k:] = slope[k:] / len(u)
    else:
        d_g[:k] = prior * slope[:k] / k
        d_g[k:] = -slope[k:] / len(u)
    d_act = d_g[:, None] * values[2][None] * (act > 0)
    risk = prior * (1 - s[:k]).mean() + max(0.0, negative)
    return float(risk), [x.T @ d_act, d_act.sum(0), act.T @ d_g, np.array([d_g.sum()])]


def train(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None = None, hidden: int = 24, epochs: int = 60, seed: int = 11) -> QualityModel:
    """Minimise the non-negative PU risk with the sigmoid loss by Adam on paired batches."""
    both = np.vstack([positive, unlabelled])
    mean, scale = both.mean(0), both.std(0) + 1e-6
    P, U = (np.clip((x - mean) / scale, -6, 6) for x in (positive, unlabelled))
    prior = estimate_prior(P, U) if prior is None else prior
    rng = np.random.default_rng(seed)
    d = both.shape[1]
    values = [rng.normal(0, (2 / d) ** 0.5, (d, hidden)), np.zeros(hidden), rng.normal(0, 0.3, hidden), np.zeros(1)]
    first, second = ([np.zeros_like(v) for v in values] for _ in range(2))
    step = 0
    for _ in range(epochs):
        deal = rng.permutation(len(U))
        for i in range(0, len(deal), 256):
            u = U[deal[i : i + 256]]
            _, grads = risk_and_gradients(values, P[rng.integers(0, len(P), 128)], u, prior)
            step += 1
            for j, g in enumerate(grads):
                g = g + 1e-4 * values[j]
                first[j] = 0.9 * first[j] + 0.1 * g
                second[j] = 0.999 * second[j] + 0.001 * g * g
                values[j] = values[j] - 3e-3 * (first[j] / (1 - 0.9**step)) / (np.sqrt(second[j] / (1 - 0.999**step)) + 1e-8)
    return QualityModel(mean, scale, values[0], values[1], values[2], float(values[3][0]), prior)


def _measured(text: Column) -> Column:
    @F.arrow_udf("array<double>")
    def rows(column: pa.Array) -> pa.Array:
        return pa.array([measures(t.as_py() or "") for t in column], pa.list_(pa.float64()))

    return rows(text)


def fit(docs: DataFrame, labels: DataFrame, max_positive: int = 4000, max_unlabelled: int = 8000) -> QualityModel | None:
    """Train on about ``max_positive`` labelled positives and ``max_unlabelled`` rows of all texts.

    Only ids that are not held out give positives; the unlabelled sample takes
    texts of any id and looks at no label.  None if there are fewer than two of
    either.
    """
    positive = training_texts(docs, labels.where("quality = 1"), "quality", max_positive).where("y = 1")
    unlabelled = sampled(docs.where("text IS NOT NULL"), F.xxhash64("doc_id", "text"), max_unlabelled)
    P, U = (np.array([r["x"] for r in df.select(_measured(F.col("text")).alias("x")).collect()]) for df in (positive, unlabelled))
    return train(P, U) if len(P) > 1 and len(U) > 1 else None


def quality(text: Column, model: QualityModel | None) -> Column:
    """Score of a whole text in [0, 1]; a null text is empty, without a model all get 0.5.

    Repeated rows score the same, texts of any length are measured whole, and no
    other column is looked at, whatever its name.
    """

    @F.arrow_udf("double")
    def score(column: pa.Array) -> pa.Array:
        if model is None:
            return pa.array([0.5] * len(column), pa.float64())
        x = np.array([measures(t.as_py() or "") for t in column]).reshape(-1, MEASURES)
        return pa.array(model.scores(x), pa.float64())

    return score(text)
