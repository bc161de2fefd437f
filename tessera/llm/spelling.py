"""Spelling variants: words one edit apart, each with its commonest near word as its form.

Two words of one edit distance agree exactly in the first half of either or in its second half. So each word is looked for
twice: in a minimal automaton of words that share its first half, and in one of reversed words that share its second half;
the other half is completed with one inserted, deleted or replaced code point. A pair that both halves find is taken
from the first. The automata number their words by perfect hashing, which is how counts of near words are found.

Words meet by (length of the search, half), so an automaton holds the words of some halves; a half that more than
``most_words`` words share is dealt to several automata, and searches for it go to all of these. What leaves a task is a
row per search, not per pair.

Defined results: a null text has no words; a null id counts as the empty string; words are counted over all rows, also over
rows that repeat; words of any length are handled whole; ties between forms go to the first in code-point order; an empty
table, or one without a word that is frequent enough, gives an empty table. Other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.automata import Automaton, Words
from tessera.llm.common import ASCII_LOWER, materialize, tidy

#: Distinct words a task counts before it passes its counts on.
COUNTED_AT_ONCE = 200_000


def slipped_words(doc_id: object, text: str | None, slip: int, least_chars: int) -> Counter:
    """Counts of a text's words with slips of the pen: where ``slip`` divides the crc32 of "<doc_id>:<word>", the word loses the code point at that crc32 modulo its length."""
    out: Counter = Counter()
    if not text:
        return out
    lower = text.encode("utf-8", "surrogatepass").translate(ASCII_LOWER).decode("utf-8", "surrogatepass")
    began = crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for word, k in Counter(_runs(least_chars).findall(lower)).items():
        h = crc32(word.encode(), began)
        if h % slip == 0:
            at = h % len(word)
            word = word[:at] + word[at + 1 :]
            if len(word) < least_chars:
                continue
        out[word] += k
    return out


def _runs(least_chars: int) -> re.Pattern:
    return re.compile(f"[a-zÀ-ÿ]{{{least_chars},}}")


def word_counts(docs: DataFrame, text: str = "text", key: str = "doc_id", slip: int = 199, least_chars: int = 6, least_n: int = 5) -> DataFrame:
    """word, n: lower-cased runs of letters (A to Z and U+00C0 to U+00FF) with slips, of least_chars code points and least_n occurrences at least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: Counter = Counter()

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(told.keys(), pa.string()), pa.array(told.values(), pa.int64())], names=["word", "n"])
            told.clear()
            return batch

        for batch in batches:
            for i in range(batch.num_rows):
                for word, k in slipped_words(batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), slip, least_chars).items():
                    told[word] += k
            if len(told) >= COUNTED_AT_ONCE:
                yield out()
        if told:
            yield out()

    counted = docs.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").cast("string").alias("t")).mapInArrow(tidy(run), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_n)


def near_in(table: pa.Table, times: int) -> pa.Table:
    """For each search of the table: how many words are near, by its half, and the best form among them.

    Columns: back (whether the second half is exact), word, n, chars (length of the search), entry and search (whether the
    row is a word of the automaton, and whether it is looked for).
    """
    back = table.column("back")[0].as_py()
    words, n = table.column("word").to_pylist(), table.column("n").to_numpy()
    entry, search = (np.asarray(table.column(c).to_numpy(zero_copy_only=False), bool) for c in ("entry", "search"))
    held = {words[i]: int(n[i]) for i in np.flatnonzero(entry)}
    names = sorted(held)
    spelled = sorted((w[::-1], i) for i, w in enumerate(names)) if back else [(w, i) for i, w in enumerate(names)]
    place = np.asarray([i for _, i in spelled], np.int64)  # of a word number among names
    counts = np.asarray([held[w] for w in names], np.int64)
    asked = np.flatnonzero(search)
    whole = Words([words[i] for i in asked])
    first_half = whole.length // 2
    query = Words([words[i][::-1] for i in asked]) if back else whole
    q, number = Automaton([w for w, _ in spelled]).within_one(query, whole.length - first_half if back else first_half)
    its = place[number] if len(number) else number
    if back and len(q):
        again = whole.same_prefix(q, Words(names), its, first_half[q])
        q, its = q[~again], its[~again]
    near = np.bincount(q, minlength=len(asked))
    form, form_n = np.full(len(asked), -1), np.zeros(len(asked), np.int64)
    fit = counts[its] >= times * n[asked[q]] if len(q) else np.zeros(0, bool)
    a, b = q[fit], its[fit]
    order = np.lexsort((b, -counts[b], a))
    a, b = a[order], b[order]
    first = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]])) if len(a) else np.zeros(0, np.int64)
    form[a[first]], form_n[a[first]] = b[first], counts[b[first]]
    return pa.table({
        "word": pa.array([words[i] for i in asked], pa.string()), "n": pa.array(n[asked], pa.int64()), "near": pa.array(near, pa.int64()),
        "form": pa.array([names[i] if i >= 0 else None for i in form], pa.string()), "form_n": pa.array(form_n, pa.int64(), mask=form < 0),
    })


def near_words(counts: DataFrame, times: int = 5, most_words: int = 60_000) -> DataFrame:
    """word, n, n_near, form, form_n: for each row of (word, n), how many other words are one edit away, and the commonest of them with times * n occurrences or more."""
    chars = F.char_length("word")
    sides = F.explode(F.expr("flatten(transform(array(false, true), b -> transform(array(-1, 0, 1), d -> named_struct('back', b, 'd', d))))"))
    rows = counts.select("word", "n", sides.alias("x")).select("word", "n", F.col("x.back").alias("back"), (chars + F.col("x.d")).cast("int").alias("chars"), (F.col("x.d") == 0).alias("search"))
    half = F.expr("if(back, right(word, chars - chars div 2), left(word, chars div 2))")
    rows = rows.filter("chars > 0").withColumn("half", F.xxhash64("back", "chars", half))
    n_words = counts.count()
    buckets = max(1, math.ceil(3 * n_words / most_words))
    one = F.pmod(F.col("half"), F.lit(buckets))
    if n_words > most_words:  # else no half can have more
        large = rows.groupBy("half").count().filter(F.col("count") > most_words).select("half", F.ceil(F.col("count") / most_words).cast("int").alias("parts"))
        rows = rows.join(large, "half", "left")
        own = F.pmod(F.xxhash64("word", F.lit(11)), F.col("parts")).cast("int")
        parts = F.when(F.col("parts").isNull(), F.array(F.lit(0))).when(F.col("search"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(own))
        bucket = F.when(F.col("parts").isNull(), one).otherwise(F.col("half"))
        rows = rows.select("back", bucket.alias("bucket"), F.explode(parts).alias("part"), "word", "n", "chars", "search", (F.col("parts").isNull() | (F.col("part") == own)).alias("entry"))
    else:
        rows = rows.select("back", one.alias("bucket"), F.lit(0).alias("part"), "word", "n", "chars", "search", F.lit(True).alias("entry"))
    found = rows.groupBy("back", "bucket", "part").applyInArrow(tidy(lambda t: near_in(t, times)), "word string, n long, near long, form string, form_n long")
    best = F.min(F.when(F.col("form").isNotNull(), F.struct((-F.col("form_n")).alias("less"), F.col("form").alias("form"))))
    found = found.groupBy("word").agg(F.max("n").alias("n"), F.sum("near").alias("n_near"), best.alias("best"))
    return found.select("word", "n", "n_near", F.col("best.form").alias("form"), (-F.col("best.less")).alias("form_n"))


def with_roots(found: DataFrame, times: int = 5) -> DataFrame:
    """found (of near_words, written) with root: the last word that forms lead to; the word itself if it has none.

    A form is ``times`` as frequent as its word, so chains are short; each round follows them twice as far.
    """
    links = found.filter(F.col("form").isNotNull()).select("word", F.col("form").alias("root"))
    most = links.join(found.select(F.col("word").alias("root"), "n"), "root").agg(F.max("n")).first()[0]
    steps = math.log(max(most or 1, times)) / math.log(max(times, 2))
    for _ in range(math.ceil(math.log2(max(steps, 1)))):
        far = links.select(F.col("word").alias("root"), F.col("root").alias("far"))
        links = materialize(links.join(far, "root", "left").select("word", F.coalesce("far", "root").alias("root")), "roots")
    return found.join(links, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, slip: int = 199, least_chars: int = 6, least_n: int = 5, times: int = 5, most_words: int = 60_000) -> DataFrame:
    """word, form, root, n, n_near, form_n of all frequent words of docs."""
    counts = materialize(word_counts(docs, slip=slip, least_chars=least_chars, least_n=least_n), "words")
    return with_roots(materialize(near_words(counts, times, most_words), "near"), times)
