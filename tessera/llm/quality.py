"""Quality scores by positive-unlabelled learning.

The classifier learns from trusted positives (documents that labels call good) and
unlabelled documents; labels that call a document bad are never read.
It minimises the non-negative unbiased risk

    prior * R_p(+) + max(0, R_u(-) - prior * R_p(-))

with the sigmoid loss, where R_p and R_u are mean losses over positives and unlabelled
documents. Where the second term turns negative, its gradient is reversed, as the
published method does. The model is a network with one hidden layer over document statistics,
fitted in numpy with full-batch Adam.

The class prior is estimated from positives against unlabelled documents: a logistic model tells the two apart, and
the prior is the least ratio of the unlabelled documents' share above a threshold to the positives' share above it,
over the thresholds that a fair share of the positives pass. Above a threshold that only positives pass, that ratio is the prior.

R_u is over all documents of the training folds. They are summed in Spark into cells, by which of their statistics lie above the mean
(at most 2**18 cells of 18 statistics, whatever the corpus), and a cell counts with its number of documents at its mean statistics.
Fitting takes at most about ``most_labels`` positives; the means and deviations are taken over all documents,
and all documents are scored.

Defined results: a null or empty text is scored from its statistics (all zero), a very long text or word from its
whole counts; rows that repeat are scored alike; without positive labels every score is 0.5; columns other than doc_id and text,
however they are called, are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialize, tidy
from tessera.llm.features import COUNTS, counts_of, document_statistics, ratios
from tessera.llm.samples import training_labels


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class PuModel:
    """Weights of the network; with no weights it scores the constant."""

    mean: np.ndarray
    scale: np.ndarray
    weights: list[np.ndarray]
    constant: float = 0.5

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.weights:
            return np.full(len(x), self.constant)
        w1, b1, w2, b2 = self.weights
        h = np.tanh(np.clip((x - self.mean) / self.scale, -8, 8) @ w1 + b1)
        return _sigmoid(h @ w2 + b2)


def fit_pu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, mean: np.ndarray, scale: np.ndarray, weight: np.ndarray | None = None, hidden: int = 16, steps: int = 600, rate: float = 0.02, decay: float = 1e-4, seed: int = 7) -> PuModel:
    """Minimise the non-negative PU risk; weight: how many documents a row of unlabelled stands for."""
    if not len(positive) or not len(unlabelled):
        return PuModel(mean, scale, [], 0.5)
    rng = np.random.default_rng(seed)
    x = np.clip((np.vstack((positive, unlabelled)) - mean) / scale, -8, 8)
    n_p = len(positive)
    w_p = np.full(n_p, prior / n_p)
    w_u = np.ones(len(unlabelled)) if weight is None else weight.astype(np.float64)
    w_u = w_u / w_u.sum()
    params = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(1)]
    m1, m2 = [np.zeros_like(q) for q in params], [np.zeros_like(q) for q in params]
    for t in range(1, steps + 1):
        h = np.tanh(x @ params[0] + params[1])
        g = h @ params[2] + params[3]
        s = _sigmoid(g)
        d = s * (1 - s)  # slope of the sigmoid loss: the loss of label + is 1 - s, of label - it is s
        negative = w_u @ s[n_p:] - w_p @ s[:n_p]
        side = np.concatenate((-w_p * d[:n_p], w_u * d[n_p:]))  # slope of the negative part
        dg = (side if negative >= 0 else -side) + np.concatenate(((-w_p * d[:n_p]) if negative >= 0 else np.zeros(n_p), np.zeros(len(w_u))))
        dh = np.outer(dg, params[2]) * (1 - h * h)
        grads = [x.T @ dh + decay * params[0], dh.sum(0), h.T @ dg + decay * params[2], np.array([dg.sum()])]
        step = rate * (1 - t / (steps + 1))
        for k, gr in enumerate(grads):
            m1[k] = 0.9 * m1[k] + 0.1 * gr
            m2[k] = 0.999 * m2[k] + 0.001 * gr * gr
            params[k] = params[k] - step * (m1[k] / (1 - 0.9**t)) / (np.sqrt(m2[k] / (1 - 0.999**t)) + 1e-9)
    return PuModel(mean, scale, params, prior)


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, weight: np.ndarray, mean: np.ndarray, scale: np.ndarray, least_pass: float = 0.8) -> float:
    """The share of positives among the unlabelled documents, from the two sets alone."""
    if not len(positive) or not len(unlabelled):
        return 0.5
    p, u = (np.clip((x - mean) / scale, -8, 8) for x in (positive, unlabelled))
    a = np.column_stack((np.vstack((p, u)), np.ones(len(p) + len(u))))
    y = np.concatenate((np.ones(len(p)), np.zeros(len(u))))
    w = np.concatenate((np.full(len(p), 0.5 / len(p)), 0.5 * weight / weight.sum()))
    theta = np.zeros(a.shape[1])
    for _ in range(30):  # Newton steps
        q = _sigmoid(a @ theta)
        hess = (a * (w * np.maximum(q * (1 - q), 1e-6))[:, None]).T @ a + 1e-3 * np.eye(len(theta))
        theta -= np.linalg.solve(hess, a.T @ (w * (q - y)) + 1e-3 * theta)
    score = a @ theta
    order = np.argsort(-score, kind="stable")
    pass_p = np.cumsum(np.where(y[order] == 1, 1 / len(p), 0.0))
    pass_u = np.cumsum(np.where(y[order] == 0, w[order] * 2, 0.0))
    able = pass_p >= least_pass
    return float(np.clip((pass_u[able] / pass_p[able]).min(), 0.02, 0.98))


def unlabelled_cells(stats: DataFrame, mean: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(mean statistics, number of documents) of every cell, a cell being a combination of statistics above and below the mean; summed per batch and then per cell."""
    width = len(mean)
    bits = 1 << np.arange(width, dtype=np.int64)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = ratios(counts_of(batch))
            code, at, n = np.unique((x > mean) @ bits, return_inverse=True, return_counts=True)
            total = np.column_stack([np.bincount(at.ravel(), x[:, k], len(code)) for k in range(width)])
            yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(n), *[pa.array(c) for c in total.T]], names=["code", "n", *[f"s{k}" for k in range(width)]])

    schema = "code long, n long, " + ", ".join(f"s{k} double" for k in range(width))
    cells = stats.select(*COUNTS).mapInArrow(tidy(sums), schema).groupBy("code").agg(F.sum("n").alias("n"), *[F.sum(f"s{k}").alias(f"s{k}") for k in range(width)])
    got = np.asarray([tuple(r) for r in cells.orderBy("code").select("n", *[f"s{k}" for k in range(width)]).collect()], dtype=np.float64).reshape(-1, width + 1)
    return got[:, 1:] / got[:, :1], got[:, 0]


def fit_on(stats: DataFrame, labels: DataFrame, in_fold: Column, target: str = "quality", most_labels: int = 20_000) -> PuModel:
    """Fit from written statistics; the bounded sample of positives, the cells and the moments reach the driver."""
    known = training_labels(labels.filter(F.col(target) == 1), target, in_fold, most_labels)
    positive = ratios(np.asarray([tuple(r) for r in stats.join(known, "doc_id").select(*COUNTS).collect()], dtype=np.int64).reshape(-1, len(COUNTS)))
    mean, scale = _moments(stats)
    # held-out rows take no part, not even unlabelled
    cells, weight = unlabelled_cells(stats.filter(in_fold), mean)
    return fit_pu(positive, cells, estimate_prior(positive, cells, weight, mean, scale), mean, scale, weight)


def _moments(stats: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Means and deviations of the ratios over all documents, from sums made in the tasks."""
    width = len(ratios(np.zeros((1, len(COUNTS)), np.int64))[0])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, a, b = 0, np.zeros(width), np.zeros(width)
        for batch in batches:
            x = ratios(counts_of(batch))
            n, a, b = n + len(x), a + x.sum(0), b + (x * x).sum(0)
        yield pa.RecordBatch.from_pydict({"k": pa.array(range(width), pa.int32()), "n": pa.array([n] * width, pa.int64()), "a": pa.array(a), "b": pa.array(b)})

    got = stats.select(*COUNTS).mapInArrow(sums, "k int, n long, a double, b double").groupBy("k").agg(F.sum("n").alias("n"), F.sum("a").alias("a"), F.sum("b").alias("b")).orderBy("k").collect()
    n = max(1, got[0]["n"]) if got else 1
    mean = np.asarray([r["a"] / n for r in got]) if got else np.zeros(width)
    square = np.asarray([r["b"] / n for r in got]) if got else np.ones(width)
    return mean, np.sqrt(np.maximum(square - mean**2, 1e-12)) + 1e-6


def score_quality(docs: DataFrame, labels: DataFrame, held_out: Column, threshold: float = 0.5, **options) -> DataFrame:
    """doc_id, held_out, score, predicted of every document; labels of held-out rows are not used.

    held_out is an expression of doc_id.
    """
    stats = materialize(document_statistics(docs), "statistics")
    model = docs.sparkSession.sparkContext.broadcast(fit_on(stats, labels, ~held_out, **options))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = model.value.score(ratios(counts_of(batch)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s)], names=["doc_id", "score"])

    scored = stats.mapInArrow(score, f"doc_id {stats.schema['doc_id'].dataType.simpleString()}, score double")
    return scored.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
