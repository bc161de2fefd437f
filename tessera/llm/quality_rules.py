"""Quality rules: fixed limits, then gradient-boosted trees over document statistics.

The trees are grown on a bounded sample of labelled rows with the logistic loss, over
binned statistics, and flattened into numpy node arrays (feature, threshold, left,
right, value), so that a batch of documents walks all trees level by level at once.
Statistics that can only speak against a document (symbols, repeated lines, words
and windows) are constrained: the score never rises with them. A split that breaks
the order is not taken, and the middle of its children bounds all leaves below.

A document is kept if it passes the fixed limits and its score is at least
``threshold``. All documents are scored, and the counts are of whole texts.

Defined results: a null or empty text has no words and fails the limits; rows that
repeat get the same verdict; without labels of both kinds the trees keep all that
pass the limits; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialize
from tessera.llm.features import COUNTS, RATIOS, counts_of, document_statistics, ratios
from tessera.llm.samples import training_labels

#: -1: the score must not rise with the statistic.
MONOTONE = {"symbols_per_word": -1, "dup_lines": -1, "repeat_words": -1, "marked_words": -1, "same_next": -1}


@dataclass
class Trees:
    """All trees' nodes, one after the other. A leaf has feature -1."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    base: float = 0.0

    def margin(self, x: np.ndarray) -> np.ndarray:
        if not len(self.roots):
            return np.full(len(x), self.base)
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        while True:
            f = self.feature[at]
            inner = f >= 0
            if not inner.any():
                break
            go_left = x[rows, np.maximum(f, 0)] <= self.threshold[at]
            at = np.where(inner, np.where(go_left, self.left[at], self.right[at]), at)
        return self.base + self.value[at].sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.margin(x), -30, 30)))


@dataclass
class _Grower:
    """Grows one tree after the other into shared node lists."""

    binned: np.ndarray
    cuts: list[np.ndarray]
    signs: np.ndarray
    depth: int
    rate: float
    l2: float = 1.0
    least: int = 20
    nodes: list[list] = field(default_factory=list)

    def leaf(self, g: float, h: float, lo: float, hi: float) -> float:
        return float(np.clip(-g / (h + self.l2), lo, hi))

    def grow(self, rows: np.ndarray, g: np.ndarray, h: np.ndarray, out: np.ndarray, level: int = 0, lo: float = -np.inf, hi: float = np.inf) -> int:
        me = len(self.nodes)
        self.nodes.append([-1, 0.0, -1, -1, 0.0])
        total_g, total_h = g[rows].sum(), h[rows].sum()
        best = self.best_split(rows, g, h, total_g, total_h, lo, hi) if level < self.depth and len(rows) >= 2 * self.least else None
        if best is None:
            v = self.rate * self.leaf(total_g, total_h, lo, hi)
            self.nodes[me][4] = v
            out[rows] = v
            return me
        feature, b, left_v, right_v = best
        side = self.binned[rows, feature] <= b
        mid, sign = (left_v + right_v) / 2, self.signs[feature]
        bounds = ((mid, hi), (lo, mid)) if sign < 0 else ((lo, mid), (mid, hi)) if sign > 0 else ((lo, hi), (lo, hi))
        l = self.grow(rows[side], g, h, out, level + 1, *bounds[0])
        r = self.grow(rows[~side], g, h, out, level + 1, *bounds[1])
        self.nodes[me] = [feature, float(self.cuts[feature][b]), l, r, 0.0]
        return me

    def best_split(self, rows, g, h, total_g, total_h, lo, hi):
        best, gain = None, 1e-6
        gain_of = lambda a, b: a * a / (b + self.l2)
        for f, cuts in enumerate(self.cuts):
            if not len(cuts):
                continue
            col = self.binned[rows, f]
            n = len(cuts) + 1
            sg, sh = np.cumsum(np.bincount(col, g[rows], n))[:-1], np.cumsum(np.bincount(col, h[rows], n))[:-1]
            cnt = np.cumsum(np.bincount(col, minlength=n))[:-1]
            gains = gain_of(sg, sh) + gain_of(total_g - sg, total_h - sh) - gain_of(total_g, total_h)
            left, right = np.clip(-sg / (sh + self.l2), lo, hi), np.clip(-(total_g - sg) / (total_h - sh + self.l2), lo, hi)
            gains[(cnt < self.least) | (len(rows) - cnt < self.least) | (self.signs[f] * (right - left) < 0)] = -1
            k = int(np.argmax(gains))
            if gains[k] > gain:
                best, gain = (f, k, left[k], right[k]), gains[k]
        return best


def fit_trees(x: np.ndarray, y: np.ndarray, monotone: dict[str, int] | None = None, names: tuple[str, ...] = RATIOS, trees: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 48) -> Trees:
    none = np.zeros(0)
    if not len(y) or y.min() == y.max():
        return Trees(none, none, none, none, none, np.zeros(0, np.int64), 10.0 if not len(y) or y.max() else -10.0)
    signs = np.asarray([(monotone or {}).get(k, 0) for k in names])
    # a cut lies midway between two values that occur
    cuts = []
    for c in x.T:
        u = np.unique(np.quantile(c, np.linspace(0, 1, bins + 1), method="nearest"))
        cuts.append((u[1:] + u[:-1]) / 2)
    binned = np.column_stack([np.searchsorted(c, col, side="left") for c, col in zip(cuts, x.T, strict=True)])
    base = float(np.log(y.mean() / (1 - y.mean())))
    margin = np.full(len(y), base)
    grower, roots = _Grower(binned, cuts, signs, depth, rate), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        out = np.zeros(len(y))
        roots.append(grower.grow(np.arange(len(y)), p - y, np.maximum(p * (1 - p), 1e-9), out))
        margin += out
    cols = list(zip(*grower.nodes, strict=True))
    return Trees(np.asarray(cols[0]), np.asarray(cols[1]), np.asarray(cols[2]), np.asarray(cols[3]), np.asarray(cols[4]), np.asarray(roots), base)


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < 20) | (100 * n_repeat_words > 30 * n_words)


def judge_documents(docs: DataFrame, labels: DataFrame, target: str = "quality", in_fold: Column | None = None, most_labels: int = 20_000, threshold: float = 0.5) -> DataFrame:
    """doc_id, the base counts, base_failed, tree_score and kept of every document."""
    stats = materialize(document_statistics(docs), "statistics")
    known = training_labels(labels, target, F.lit(True) if in_fold is None else in_fold, most_labels)
    rows = np.asarray([tuple(r) for r in stats.join(known, "doc_id").select(*COUNTS, "y").collect()], dtype=np.int64).reshape(-1, len(COUNTS) + 1)
    model = docs.sparkSession.sparkContext.broadcast(fit_trees(ratios(rows[:, :-1]), rows[:, -1].astype(np.float64), MONOTONE))
    base = COUNTS[:5]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = model.value.score(ratios(counts_of(batch)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[batch.column(batch.schema.get_field_index(c)) for c in base], pa.array(s)], names=["doc_id", *base, "tree_score"])

    scored = stats.mapInArrow(score, f"doc_id {stats.schema['doc_id'].dataType.simpleString()}, {', '.join(f'{c} long' for c in base)}, tree_score double")
    failed = base_failed(F.col("n_words"), F.col("n_repeat_words"))
    return scored.select("*", failed.alias("base_failed"), (~failed & (F.col("tree_score") >= threshold)).alias("kept"))
