"""Likeness of texts by the blocks they have in common, and joins on it.

The blocks of two texts are found from the longest one outwards: the longest stretch that both hold (the first in the one text, and then in the other),
and then the same to the left and to the right of it. A text's likeness to another is twice the characters in such blocks over all characters of both.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tessera.functions.scalars import folded
from tessera.plans.tables import written


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


#: Cells of the table in which lengths of stretches are kept for the pairs that are compared at once.
TABLE_CELLS = 1 << 17


def _longest(a: np.ndarray, b: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begin in a, begin in b, length) of the longest common stretch of each pair of rows, of which ``sizes`` characters count; lengths of stretches that end at each place of b are kept for one place of a."""
    rows = np.arange(len(a))
    i, j, n = (np.zeros(len(a), np.int64) for _ in range(3))
    inside = np.arange(b.shape[1]) < sizes[:, 1:]
    run = np.zeros((len(a), b.shape[1] + 1), np.int32)
    for k in range(a.shape[1]):
        run[:, 1:] = (run[:, :-1] + 1) * ((b == a[:, k : k + 1]) & inside)
        at = run.argmax(1)
        length = run[rows, at]
        more = (length > n) & (k < sizes[:, 0])
        i[more], j[more], n[more] = k + 1 - length[more], at[more] - length[more], length[more]
    return i, j, n


def _rows(codes: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Stretches of codes as rows, filled up with what follows."""
    return codes[np.minimum(begin[:, None] + np.arange(size.max()), len(codes) - 1)]


def blocks_of_pairs(pairs: list[tuple[str, str]]) -> list[list[tuple[int, int, int]]]:
    """common_blocks of many pairs: stretches of like sizes that are still to be searched are rows of one table, and each round looks left and right of what the last one found."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in pairs]
    open_ = []
    for k, (one, other) in enumerate(pairs):
        whole = (one.find(other), 0, len(other)) if len(other) <= len(one) else (0, other.find(one), len(one))
        if whole[2] and min(whole) >= 0:  # the one holds the other
            out[k].append(whole)
        elif whole[2]:
            open_.append(k)
    if not open_:
        return out
    a, b = (_codes("".join(pairs[k][side] for k in open_)) for side in (0, 1))
    sizes = np.array([[len(x) for x in pairs[k]] for k in open_])
    begins = np.cumsum(sizes, 0) - sizes
    pair, todo = np.arange(len(open_)), np.stack([begins, begins + sizes], 2)  # of each stretch to search: sides by (begin, end)
    while len(pair):
        size = todo[:, :, 1] - todo[:, :, 0]
        order = np.lexsort([size[:, 0], size[:, 1]])
        pair, todo, size = pair[order], todo[order], size[order]
        new, at = [], 0
        while at < len(pair):
            end = at + max(1, int(np.searchsorted(size[at:, 1] * np.arange(1, len(pair) - at + 1), TABLE_CELLS, "right")))
            p, t, z = pair[at:end], todo[at:end], size[at:end]
            i, j, n = _longest(_rows(a, t[:, 0, 0], z[:, 0]), _rows(b, t[:, 1, 0], z[:, 1]), z)
            i, j = i + t[:, 0, 0], j + t[:, 1, 0]
            for k, x, y, m in zip(p.tolist(), (i - begins[p, 0]).tolist(), (j - begins[p, 1]).tolist(), n.tolist(), strict=True):
                if m:
                    out[open_[k]].append((x, y, m))
            for left in (True, False):
                rest = np.stack([np.stack([t[:, 0, 0], i], 1), np.stack([t[:, 1, 0], j], 1)], 1) if left else np.stack([np.stack([i + n, t[:, 0, 1]], 1), np.stack([j + n, t[:, 1, 1]], 1)], 1)
                keep = (n > 0) & (rest[:, :, 1] > rest[:, :, 0]).all(1)
                new.append((p[keep], rest[keep]))
            at = end
        pair, todo = np.concatenate([x for x, _ in new]), np.concatenate([x for _, x in new])
    return [sorted(x) for x in out]


def common_blocks(one: str, other: str) -> list[tuple[int, int, int]]:
    """(begin in one, begin in other, length) of the blocks, in order."""
    return blocks_of_pairs([(one, other)])[0]


def _similarity(one: str, other: str, shared: int) -> float:
    whole = len(one) + len(other)
    return 2.0 * shared / whole if whole else 1.0


def _cover(one: str, other: str, shared: int) -> float:
    return shared / len(other) if other else 0.0


def _scored(score: Callable[[str, str, int], float], pairs: list[tuple[str | None, str | None]]) -> list[float]:
    filled = [(x or "", y or "") for x, y in pairs]
    return [score(x, y, sum(n for *_, n in blocks)) for (x, y), blocks in zip(filled, blocks_of_pairs(filled), strict=True)]


def similarity(one: str | None, other: str | None) -> float:
    """1.0 for two empty texts."""
    return _scored(_similarity, [(one, other)])[0]


def cover_ratio(one: str | None, other: str | None) -> float:
    """The share of the other text's characters that lie in blocks."""
    return _scored(_cover, [(one, other)])[0]


def _of_pairs(score: Callable[[str, str, int], float]) -> Callable[[Column, Column], Column]:
    """A function of two text columns; null for two nulls."""

    @F.pandas_udf(DoubleType())
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        told = ~(x.isna() & y.isna())
        out = pd.Series(np.nan, x.index, float).astype(object).where(told, None)
        out[told] = _scored(score, list(zip(x[told], y[told], strict=True)))
        return out.astype("Float64")

    return run


def fuzzy_cover(a: Column, b: Column) -> Column:
    return _of_pairs(_cover)(a, b)


def line_span(words: Column, line: Column) -> Column:
    """struct<until, cover>: when the last character of a line that is heard in words (array<struct<text, until>>) has been said, and the line's share that is heard.

    Letters, digits and CJK are compared. Without any word or line both are 0; with no character in common, until is the last word's.
    """

    @F.pandas_udf("struct<until:double,cover:double>")
    def run(heard: pd.Series, ends: pd.Series, wanted: pd.Series) -> pd.DataFrame:
        out = []
        said = [[] if texts is None else list(texts) for texts in heard]
        found = blocks_of_pairs([(want or "", "".join(texts)) for want, texts in zip(wanted, said, strict=True)])
        for texts, until, want, blocks in zip(said, ends, wanted, found, strict=True):
            at = np.repeat(np.asarray([] if until is None else until, float), [len(x) for x in texts]) if texts else np.zeros(0)
            if not len(at) or not want:
                out.append((0.0, 0.0))
            else:
                out.append((float(at[blocks[-1][1] + blocks[-1][2] - 1]) if blocks else float(at[-1]), sum(n for *_, n in blocks) / len(want)))
        return pd.DataFrame(out, columns=["until", "cover"])

    plain = lambda c: folded(F.coalesce(c, F.lit("")))
    return run(F.transform(words, lambda w: plain(w["text"])), F.transform(words, lambda w: w["until"]), plain(line))


def _counts(text: Column) -> Column:
    """How often each of a text's characters stands in it."""
    kinds = F.array_distinct(F.filter(F.split(text, ""), lambda c: c != ""))
    return F.map_from_entries(F.transform(kinds, lambda c: F.struct(c.alias("c"), (F.length(text) - F.length(F.replace(text, c, F.lit("")))).alias("n"))))


def _shared(a: str, b: str) -> Column:
    """How many characters two texts have in common, wherever they stand, from their counts."""
    return F.aggregate(F.map_keys(a), F.lit(0), lambda n, c: n + F.least(F.element_at(a, c), F.coalesce(F.try_element_at(F.col(b), c), F.lit(0))))


def not_planned(lines: DataFrame, plan: DataFrame, keys: list[str], text: str = "text", cut: float = 0.6) -> DataFrame:
    """Lines of a group that neither contain, nor are contained in, nor are as like as ``cut`` to a line of the group's plan.

    A null or empty line contains nothing and is like nothing; empty lines of a plan don't count, and lines of the plan that repeat are one. Lines and plan meet in a join on the
    keys, so a large group is dealt out by rows of lines, and no group comes together in a task. A pair is compared character by character only if its lengths, and then the characters it has at all, allow the
    likeness; null keys are equal.
    """
    names = [f"_key{i}" for i in range(len(keys))]
    known = plan.filter(F.length(text) > 0).select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], F.col(text).alias("_p")).distinct()
    known = known.withColumn("_pc", _counts(F.col("_p")))
    rows = written(lines.select("*", F.monotonically_increasing_id().alias("_row")))  # the numbers must not change
    mine = rows.filter(F.length(text) > 0).select(*keys, "_row", F.col(text).alias("_t")).withColumn("_tc", _counts(F.col("_t")))
    pairs = mine.join(known, [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, names, strict=True)])
    a, b = F.length("_t"), F.length("_p")
    inside = F.contains("_t", F.col("_p")) | F.contains("_p", F.col("_t"))
    # a filter does not keep pairs from Python, which is asked before it; those that can't be as like go there as nulls
    may = ~F.col("_in") & (2 * F.least(a, b) >= cut * (a + b)) & (2 * _shared("_tc", "_pc") >= cut * (a + b))
    pairs = pairs.withColumn("_in", inside).withColumn("_may", may)
    like = _of_pairs(_similarity)(F.when(F.col("_may"), F.col("_t")), F.when(F.col("_may"), F.col("_p")))
    found = pairs.withColumn("_like", like).filter(F.col("_in") | (F.col("_may") & (F.col("_like") >= cut))).select("_row").distinct()
    return rows.join(found, "_row", "left_anti").drop("_row")
