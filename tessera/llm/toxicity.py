"""Toxicity: Levenshtein automata over a lexicon trie, with context-window scores.

The lexicon is learnt from labelled training rows: words and word beginnings (stems)
that stand in toxic documents far more often than in others. It is kept as a trie.
Each distinct word of a text becomes a Levenshtein automaton, whose states are (letters
read, edits left), and is intersected with the trie: both advance letter by letter, and a
branch is left as soon as no state can go on. So misspelled
terms (one edit in terms of five letters or more) are found without a list of
misspellings; two neighbouring letters swapped are one edit too. A word that neither begins with the first half of
a term (as it is, or with the letters at the middle swapped) nor ends with its second half
is more than one edit away from it, and skips the automaton.

Each hit is weighed by its window of words: quotation marks around it and words of
reporting speak for a quotation, other hits nearby for abuse. Words of reporting are learnt too
(``learn_reporting``): those that stand in the windows of hits in clean documents far more often than in toxic ones;
where clean documents never hold a term, there are none. A logistic model over these
scores, fitted on the same bounded sample, gives the document's score.

Defined results: a null or empty text has no hits and gets the score of a text without
hits; a very long text is read whole, and a very long word is one word; rows that repeat are scored alike; without toxic labels in the training rows the
lexicon is empty and every score is the share of toxic labels; an empty table gives an
empty result; extra columns, however they are called, are ignored by score_toxicity and kept by score_with, but for
its own toxicity_score and toxicity_hits.
"""

from __future__ import annotations

import uuid
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Memory, kept, materialize, rows_of, tidy
from tessera.llm.samples import training_labels

STEMS = (4, 5, 6, 7)
_EDGE = " \t\n\r\v\f.,;:!?()[]{}<>*#$%&|+=~^_/\\\"'`«»„“”‚‘’‹›—–-"
_QUOTES = "\"«»„“”‚‘’‹›"
SCORES = ("exact", "fuzzy", "stem", "rate", "clustered", "quoted", "unquoted", "distinct")


def plain(word: str) -> str:
    return word.strip(_EDGE).lower()


@dataclass
class Trie:
    """Nodes as dictionaries of letters; a term's end holds (term, whole) under the empty key. whole is False for stems."""

    root: dict = field(default_factory=dict)
    heads: dict[str, set[int]] = field(default_factory=dict)
    tails: dict[str, set[int]] = field(default_factory=dict)
    sizes: tuple[int, ...] = ()
    fuzzy_from: int = 5

    @classmethod
    def of(cls, terms: list[tuple[str, bool]], fuzzy_from: int = 5) -> Trie:
        t = cls(fuzzy_from=fuzzy_from)
        sizes = set()
        for term, whole in terms:
            node = t.root
            for ch in term:
                node = node.setdefault(ch, {})
            node[""] = (term, whole or node.get("", ("", False))[1])
            if whole and len(term) >= fuzzy_from:
                half = len(term) // 2
                near = {len(term) - 1, len(term), len(term) + 1}
                t.heads.setdefault(term[:half], set()).update(near)
                # letters swapped across the middle leave neither half as it was
                t.heads.setdefault(term[: half - 1] + term[half], set()).add(len(term))
                t.tails.setdefault(term[half:], set()).update(near)
                sizes |= {half, len(term) - half}
        t.sizes = tuple(sorted(sizes))
        return t

    def may_be_near(self, word: str) -> bool:
        """Whether some term of about its length begins or ends like the word."""
        n, none = len(word), ()
        return any(n in self.heads.get(word[:k], none) or n in self.tails.get(word[-k:], none) for k in self.sizes)

    def exact(self, word: str) -> str | None:
        """The term that is the word, or the longest stem that begins it ("stem*")."""
        node, stem = self.root, None
        for k, ch in enumerate(word):
            node = node.get(ch)
            if node is None:
                break
            if (end := node.get("")) is not None:
                if end[1] and k == len(word) - 1:
                    return end[0]
                if not end[1] or end[0] + "*" == stem:
                    stem = end[0] + "*"
        return stem

    def fuzzy(self, word: str, edits: int = 1) -> str | None:
        """A whole term within so many edits: the word's Levenshtein automaton intersected with the trie."""
        n, best = len(word), None
        # states (trie node, letters of the word read, edits left); equal letters cost nothing
        stack = [(self.root, 0, edits)]
        while stack:
            node, i, left = stack.pop()
            if i == n and (end := node.get("")) is not None and end[1] and len(end[0]) >= self.fuzzy_from:
                found = (edits - left, end[0])
                best = found if best is None or found < best else best
            if i < n and (child := node.get(word[i])) is not None:
                stack.append((child, i + 1, left))
            if left:
                if i < n:
                    stack.append((node, i + 1, left - 1))  # a letter too many
                if i + 1 < n and (child := node.get(word[i + 1])) is not None and (child := child.get(word[i])) is not None:
                    stack.append((child, i + 2, left - 1))  # two letters swapped
                for ch, child in node.items():
                    if ch:
                        stack.append((child, i, left - 1))  # a letter left out
                        if i < n and ch != word[i]:
                            stack.append((child, i + 1, left - 1))  # another letter
        return best[1] if best else None


@dataclass
class ToxicityModel:
    terms: list[tuple[str, bool]]
    reporting: frozenset[str] = frozenset()
    weights: np.ndarray | None = None
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    base: float = 0.0
    window: int = 8


class Scorer:
    """Finds hits with a bounded memory of words it has met."""

    def __init__(self, model: ToxicityModel, most_bytes: int = 32 << 20):
        self.model, self.trie = model, Trie.of(model.terms)
        self.known = Memory(most_bytes)

    def look_up(self, raw: str) -> tuple[str, str] | None:
        """(kind, term) of a word as it stands in the text."""
        word = plain(raw)
        hit = None
        if word:
            if (term := self.trie.exact(word)) is not None:
                hit = ("stem" if term.endswith("*") else "exact", term)
            elif len(word) >= self.trie.fuzzy_from - 1 and self.trie.may_be_near(word) and (term := self.trie.fuzzy(word)) is not None:
                hit = ("fuzzy", term)
        self.known.keep(raw, hit)
        return hit

    def hits(self, text: str | None) -> tuple[list[tuple[int, str, str]], list[str]]:
        """[(word number, kind, term)] and the text's words."""
        words = (text or "").split()
        known, out = self.known, []
        for i, w in enumerate(words):
            h = known.get(w, 0)
            if h == 0:
                h = self.look_up(w)
            if h is not None:
                out.append((i, *h))
        return out, words

    def scores(self, found: list[tuple[int, str, str]], words: list[str]) -> list[float]:
        """The document's context-window scores from its hits, in the order of SCORES."""
        if not found:
            return [0.0] * len(SCORES)
        at = [i for i, *_ in found]
        w, quoted, clustered = self.model.window, 0, 0
        for i in at:
            clustered += bisect_left(at, i + w + 1) - bisect_left(at, i - w) > 1
            before, after = words[max(0, i - w) : i + 1], words[i : i + w + 1]
            opened = any(q in x[:1] for x in before for q in _QUOTES) and any(q in x[-2:] for x in after for q in _QUOTES)
            said = bool(self.model.reporting) and any(plain(x) in self.model.reporting for x in before + after)
            quoted += opened or said
        kinds = Counter(k for _, k, _ in found)
        n = len(found)
        return [np.log1p(kinds["exact"]), np.log1p(kinds["fuzzy"]), np.log1p(kinds["stem"]), np.log1p(1000 * n / len(words)), clustered / n, quoted / n, np.log1p(n - quoted), np.log1p(len({t for *_, t in found}))]


def learn_reporting(rows: DataFrame, model: ToxicityModel, least_docs: int = 3, times: float = 3.0) -> frozenset[str]:
    """Words in the windows around hits, without the terms themselves, that stand there in at least least_docs clean documents of rows (text, y), and in a share of them so many times that of the toxic ones with hits."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        w = shared.value.window
        for batch in batches:
            found: Counter = Counter()
            for text, y in rows_of(batch):
                hits, words = scorer.hits(text)
                at = {i for i, *_ in hits}
                if at:
                    around = {k for i in at for k in range(max(0, i - w), min(len(words), i + w + 1))} - at
                    found.update({(p, y) for k in around if (p := plain(words[k]))} | {("", y)})
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in found], pa.string()), pa.array([k[1] for k in found], pa.int32()), pa.array(list(found.values()), pa.int64())], names=["word", "y", "n"])

    counts = rows.select("text", F.col("y").cast("int").alias("y")).mapInArrow(tidy(near), "word string, y int, n long").groupBy("word").agg(F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("t"), F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("c"))
    counts = materialize(counts, "near-hits")
    total = counts.filter("word = ''").first()
    if total is None or not total["c"]:
        return frozenset()
    share = lambda n, of: (n + 0.5) / (of + 1)
    kept = counts.filter((F.col("word") != "") & (F.col("c") >= least_docs) & (share(F.col("c"), total["c"]) >= times * share(F.col("t"), total["t"])))
    return frozenset(r["word"] for r in kept.select("word").collect())


def _units(text: str | None) -> set[str]:
    """Distinct words of a text, and their beginnings marked with a star."""
    words = {p for x in (text or "").split() if (p := plain(x)) and not p.isdigit()}
    return words | {x[:k] + "*" for x in words for k in STEMS if len(x) > k}


def learn_lexicon(rows: DataFrame, least_docs: int = 3, least_weight: float = 8.0) -> list[tuple[str, bool]]:
    """Terms that toxic documents of rows (text, y) use far more often than others.

    A unit's weight is the logarithm of how many times more often, times the root of its toxic
    documents; least_weight leaves out what chance would put there. Counting runs in Spark with partial counts per task; the units that are left reach the driver, and
    are bounded by the sample's size.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in batches:
            for text, y in rows_of(batch):
                tally[1 if y else 0].update(_units(text))
                if len(tally[0]) + len(tally[1]) > 200_000:
                    yield _tally(tally)
                    tally = (Counter(), Counter())
        yield _tally(tally)

    n = {int(r["y"]): r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    toxic, clean = n.get(1, 0), n.get(0, 0)
    if not toxic:
        return []
    counts = rows.select("text", "y").mapInArrow(tidy(count), "unit string, in_toxic long, in_clean long").groupBy("unit").agg(F.sum("in_toxic").alias("t"), F.sum("in_clean").alias("c"))
    p_t, p_c = (F.col("t") + 0.5) / (toxic + 1), (F.col("c") + 0.5) / (clean + 1)
    weight = F.log(p_t / p_c) * F.sqrt("t")
    # in one toxic document of fifty or more, and at least ten times as often as in clean ones
    kept = counts.filter((F.col("t") >= max(least_docs, toxic // 50)) & (p_t >= 10 * p_c)).withColumn("weight", weight).filter(F.col("weight") >= least_weight)
    units = [(r["unit"], r["t"], r["c"]) for r in kept.select("unit", "t", "c").collect()]
    stems = {u[:-1] for u, *_ in units if u.endswith("*")}
    # the shortest stem says it all; a word that a stem covers isn't needed either unless it is as strong alone
    stems = {s for s in stems if not any(s[:k] in stems for k in range(min(STEMS), len(s)))}
    share = {u: t for u, t, _ in units}
    whole = [u for u, *_ in units if not u.endswith("*")]
    # a stem that stands for one word only is that word
    single = {s for s in stems if any(u.startswith(s) and share[u] >= 0.8 * share[s + "*"] for u in whole)}
    stems -= single
    return [(s, False) for s in sorted(stems)] + [(u, True) for u in sorted(whole) if not any(u[:k] in stems for k in STEMS)]


def _tally(tally: tuple[Counter, Counter]) -> pa.RecordBatch:
    clean, toxic = tally
    # a unit that no toxic document of this task holds may still be common in clean ones elsewhere, so all are counted
    units = list(clean.keys() | toxic.keys())
    return pa.RecordBatch.from_pydict({"unit": pa.array(units, pa.string()), "in_toxic": pa.array([toxic[u] for u in units], pa.int64()), "in_clean": pa.array([clean[u] for u in units], pa.int64())})


def _logistic(x: np.ndarray, y: np.ndarray, steps: int = 40, l2: float = 1e-2) -> np.ndarray:
    a = np.column_stack((x, np.ones(len(x))))
    w = np.zeros(a.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ a / len(y) + l2 * np.eye(len(w))
        w -= np.linalg.solve(h, a.T @ (p - y) / len(y) + l2 * np.r_[w[:-1], 0])
    return w


def fit_toxicity(docs: DataFrame, labels: DataFrame, in_fold: Column, target: str = "toxic", most_labels: int = 12_000, broadcast_rows: int = 100_000) -> ToxicityModel:
    """Learn lexicon, reporting words and weights from at most about most_labels labelled rows."""
    spark = docs.sparkSession
    known = training_labels(labels, target, in_fold, most_labels)
    chosen = F.broadcast(known) if most_labels <= broadcast_rows else known
    rows = materialize(docs.select("doc_id", "text").join(chosen, "doc_id").select("text", "y"), "toxic-sample")
    model = ToxicityModel(learn_lexicon(rows))
    model.reporting = learn_reporting(rows, model)
    shared = spark.sparkContext.broadcast(model)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            x = [scorer.scores(*scorer.hits(t)) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_pydict({"x": pa.array(x, pa.list_(pa.float64())), "y": batch.column(1)})

    got = rows.mapInArrow(tidy(measure), "x array<double>, y int").collect()
    y = np.asarray([r["y"] for r in got], dtype=np.float64)
    model.base = float(y.mean()) if len(y) else 0.0
    if len(y) and 0 < y.mean() < 1:
        x = np.asarray([r["x"] for r in got])
        model.mean, model.scale = x.mean(0), x.std(0) + 1e-6
        model.weights = _logistic((x - model.mean) / model.scale, y)
    return model


def score_with(docs: DataFrame, model: ToxicityModel, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The kept columns (but for any called like the new ones), toxicity_score, and toxicity_hits (word number, kind, term) of every whole text."""
    names = docs.columns
    keep = [c for c in (names if keep is None else keep) if c not in ("toxicity_score", "toxicity_hits")]
    shared, name = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex
    hit = pa.list_(pa.struct([("word", pa.int32()), ("kind", pa.string()), ("term", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        scorer = kept(("toxicity", name), lambda: Scorer(m))
        for batch in batches:
            measured, found = [], []
            for (t,) in rows_of(batch.select([text])):
                h, words = scorer.hits(t)
                measured.append(scorer.scores(h, words))
                found.append([{"word": i, "kind": k, "term": term} for i, k, term in h])
            if m.weights is None:
                s = np.full(len(found), m.base)
            else:
                x = (np.asarray(measured).reshape(-1, len(SCORES)) - m.mean) / m.scale
                s = 1 / (1 + np.exp(-np.clip(np.column_stack((x, np.ones(len(x)))) @ m.weights, -30, 30)))
            yield pa.RecordBatch.from_arrays([*[batch.column(names.index(c)) for c in keep], pa.array(s), pa.array(found, hit)], names=[*keep, "toxicity_score", "toxicity_hits"])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema] + ["toxicity_score double", "toxicity_hits array<struct<word:int,kind:string,term:string>>"])
    return docs.mapInArrow(tidy(run, keeps=True), schema)


def score_toxicity(docs: DataFrame, labels: DataFrame, held_out: Column, threshold: float = 0.3, **options) -> DataFrame:
    """doc_id, held_out, score, predicted of every document; labels of held-out rows are not used."""
    model = fit_toxicity(docs, labels, ~held_out, **options)
    scored = score_with(docs.select("doc_id", "text"), model, keep=["doc_id"])
    return scored.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col("toxicity_score").alias("score"), (F.col("toxicity_score") >= threshold).cast("int").alias("predicted"))
