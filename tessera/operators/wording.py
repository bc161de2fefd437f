"""Word and phrase boundaries in timed characters, and parts of lines moved to legal cuts."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.lexicon import Paths, Words, codes, few_at_a_time, lists

#: Marks after which a phrase ends.
MARKS = "，,。.!！？?；;：:、…~—－·　\"'“”‘’()（）【】[]{}《》<>"
_MARK = "[" + "".join("\\" + c if c in r"[]\^-&" else c for c in MARKS) + "]"
#: Characters that always stay together, unless a caller says otherwise: Latin words and numbers.
JOINED = "[A-Za-z0-9]+"
#: Fixed value: from how many characters on an uncovered stretch is cut in two.
LONG_GAP = 14
#: Up to so many words a dictionary goes to all executors, for stretches of up to so many characters; otherwise slices and blocks of both meet by shuffle.
SENT_WORDS, SENT_CHARS = 500_000, 1_000_000
#: So many words are in a block at most, and so many characters in a slice, or half as many where there are several blocks; so many words go in one row.
BLOCK_WORDS, SLICE_CHARS, PACK_WORDS = 3_000_000, 16_000_000, 20_000


def verified_marks(chars: Column, text: Column) -> Column:
    """array<int>: after which characters (counted from 0) the text has a mark; null unless the text without marks and white space is exactly the characters."""
    bare = F.regexp_replace(text, r"\s", "")

    def marks(pieces: Column) -> Column:
        ends = F.aggregate(pieces, F.array().cast("array<int>"), lambda a, p: F.concat(a, F.array(F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(-1)) + F.length(p))))
        found = F.array_distinct(F.filter(F.slice(ends, 1, F.greatest(F.lit(0), F.size(ends) - 1)), lambda e: e >= 0))
        same = (F.length(text) > 0) & (F.array_join(pieces, "") == F.array_join(chars, ""))
        return F.when(F.coalesce(same, F.lit(False)), found)

    return F.get(F.transform(F.array(F.split(bare, f"{_MARK}+", -1)), marks), F.lit(0))  # the pieces are found once, and used three times


def best_path(n: int, edges: list[tuple[int, int, int]], single: int) -> list[int]:
    """Ends of the words of the best path through 0..n. edges: (begin, length, weight); any one character is a word of weight ``single``, too.

    The heaviest path counts; of equally heavy ones the one whose earlier words are longer.
    """
    begins: dict[int, list[tuple[int, int]]] = {}
    for begin, length, weight in edges:
        begins.setdefault(begin, []).append((length, weight))
    score, step = np.zeros(n + 1, np.int64), np.ones(n + 1, np.int64)
    for i in range(n - 1, -1, -1):
        options = [(single + score[i + 1], 1), *[(w + score[i + k], k) for k, w in begins.get(i, ())]]
        score[i], step[i] = max(options)
    out, at = [], 0
    while at < n:
        at += int(step[at])
        out.append(at)
    return out


def word_weights(words: DataFrame, word: str = "word", n: str = "n") -> DataFrame:
    """word, weight, total: a millionth's logarithm of each word's share of all; words that repeat are added up."""
    counts = words.filter((F.length(word) > 0) & (F.col(n) > 0)).groupBy(F.col(word).alias("word")).agg(F.sum(n).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))  # one row
    return counts.crossJoin(F.broadcast(total)).select("word", F.bround(F.log(F.col("n") / F.col("total")) * 1_000_000).cast("long").alias("weight"), "total")


def _by_join(stretches: DataFrame, weights: DataFrame, longest: int, single: int) -> DataFrame:
    """_s, _ends: the last characters of the words of each different stretch, its parts joined to words that are sent to all executors."""
    n = F.length("_s")
    # equal stretches have equal words: one stands for all of them
    different = stretches.groupBy("_s").agg(F.min(F.struct("_id", "_at")).alias("_r")).select("_r._id", "_r._at", "_s")
    starts = different.select("*", F.explode(F.sequence(F.lit(1), n)).alias("_i"))
    # what a word that begins here can hold; the stretch itself stays behind
    starts = starts.select("_id", "_at", "_i", F.substring("_s", F.col("_i"), F.lit(longest)).alias("_rest")).withColumn("_head", F.substring("_rest", 1, 3))
    heads = weights.filter(F.length("word") > 2).groupBy(F.substring("word", 1, 3).alias("_head")).agg(F.max(F.length("word")).alias("_most"))
    starts = starts.join(F.broadcast(heads), "_head", "left")  # no word is longer than those that begin alike
    cut = starts.select("_id", "_at", (F.col("_i") - 1).alias("_i"), F.explode(F.sequence(F.lit(1), F.least(F.coalesce("_most", F.lit(2)), F.length("_rest")))).alias("_k"), "_rest")
    cut = cut.select("_id", "_at", "_i", "_k", F.substring("_rest", F.lit(1), F.col("_k")).alias("word"))
    edges = cut.join(F.broadcast(weights.select("word", "weight")), "word").groupBy("_id", "_at").agg(F.collect_list(F.struct(F.col("_i").alias("i"), F.col("_k").alias("k"), F.col("weight").alias("w"))).alias("_e"))

    @F.pandas_udf("array<int>")
    def ends(size: pd.Series, i: pd.Series, k: pd.Series, w: pd.Series) -> pd.Series:
        out = []
        for m, x0, x1, x2 in zip(size, i, k, w, strict=True):
            found = [] if x0 is None else list(zip(map(int, x0), map(int, x1), map(int, x2), strict=True))
            out.append([e - 1 for e in best_path(m, found, single)])
        return pd.Series(out)

    field = lambda c: F.transform("_e", lambda e: e[c])
    return different.join(edges, ["_id", "_at"], "left").select("_s", ends(n, field("i"), field("k"), field("w")).alias("_ends"))


def _by_slices(stretches: DataFrame, weights: DataFrame, n_chars: int, n_words: int, n_letters: int, single: int) -> DataFrame:
    """_s, _ends, as _by_join has them: slices of the different stretches meet blocks of the dictionary, so that what is shuffled is stretches and words, and not their parts.

    One block is searched and solved in one go. Of several, the words that each has found in a stretch are put together before its best path is looked for.
    """
    blocks = max(0, n_words - 1) // BLOCK_WORDS + 1
    # each slice gets all words: there are as many as double what is shuffled, more where they would be large, and fewer where they would be tiny
    slices = max(n_chars * min(blocks, 2) // SLICE_CHARS, min(n_chars // SENT_CHARS, n_chars // n_letters)) + 1
    packs = blocks * (n_words // (blocks * PACK_WORDS) + 1)
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = stretches.select("_s").distinct().select("_s", deal("_s", slices).alias("_slice"), every(blocks).alias("_block"))
    right = weights.groupBy(deal("word", packs).alias("_pack")).agg(F.collect_list("word").alias("_words"), F.collect_list("weight").alias("_weights"))
    right = right.select("_words", "_weights", (F.col("_pack") % blocks).alias("_block"), every(slices).alias("_slice"))

    columns = ["_ends"] if blocks == 1 else ["_i", "_k", "_w"]
    schema = pa.schema([("_s", pa.string()), *[(c, pa.list_(pa.int32())) for c in columns]])

    def search(some: pa.Table, dictionary: pa.Table) -> pa.Table:
        s = some["_s"].combine_chunks()
        flat = lambda c: pc.list_flatten(dictionary[c].combine_chunks())
        words = Words(flat("_words"), flat("_weights").to_numpy())
        size, out = pc.utf8_length(s).to_numpy().astype(np.int64), []
        for few in few_at_a_time(size, len(words.lengths)):
            at = s.take(pa.array(few))
            paths = Paths(size[few], sorted(words.lengths))
            paths.search(codes(at)[0], words)
            if blocks == 1:
                out.append([at, lists(*paths.best(single))])
                continue
            stretch, *found = paths.found()
            out.append([at, *[lists(x, np.bincount(stretch, minlength=len(few))) for x in found]])
        return pa.concat_tables([schema.empty_table(), *[pa.Table.from_arrays(x, schema=schema) for x in out]])

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s, (i, k, w) = batch.column("_s"), [batch.column(c) for c in ("_i", "_k", "_w")]
            size = pc.utf8_length(s).to_numpy().astype(np.int64)
            lengths = sorted(pc.unique(pc.list_flatten(k)).to_pylist())
            for few in few_at_a_time(size, len(lengths)):
                rows = pa.array(few)
                paths = Paths(size[few], lengths)
                x, y, z = [pc.list_flatten(c.take(rows)).to_numpy() for c in (i, k, w)]
                stretch = np.repeat(np.arange(len(few)), pc.list_value_length(k.take(rows)).to_numpy())
                for n in paths.lengths:
                    own = y == n
                    paths.put(n, paths.at[paths.size[stretch[own]] - x[own]] + stretch[own], z[own])
                yield pa.RecordBatch.from_arrays([s.take(rows), lists(*paths.best(single))], ["_s", "_ends"])

    key, ends = ["_slice", "_block"], "_s string, _ends array<int>"
    met = left.groupBy(*key).cogroup(right.groupBy(*key))
    if blocks == 1:
        return met.applyInArrow(search, ends)
    found = met.applyInArrow(search, "_s string, _i array<int>, _k array<int>, _w array<int>").groupBy("_s")
    return found.agg(*[F.flatten(F.collect_list(c)).alias(c) for c in ("_i", "_k", "_w")]).mapInArrow(solve, ends)


def word_breaks(streams: DataFrame, words: DataFrame, keys: list[str], chars: str = "chars", text: str = "text", joined: str | None = JOINED) -> DataFrame:
    """streams with punct and brk, arrays of the characters after which a phrase, or a word, ends; the last one ends both.

    A stream is a row: its characters (array<string>), and the text they were heard as, with marks. Where text and characters agree all through, its marks
    are phrase ends, and words are looked for between marks; otherwise no mark is used and words are looked for in the characters alone, as far as the first that is
    a mark or white space. Words are the best path through all words of the dictionary ``words`` (word, n) that the stretch holds; white space ends a word; runs
    of ``joined`` characters are not cut. Each different stretch meets the dictionary once: a small dictionary is sent to all executors and joined to the parts of
    few stretches, and otherwise slices of the stretches meet blocks of the dictionary, so either side may be of any size.
    A null text, and one of another stream, agrees with nothing; a stream without characters has no breaks. keys tell streams apart, and null is equal to null.
    """
    from tessera.plans.tables import written

    weights = written(word_weights(words))
    size = weights.agg(F.count("*").alias("n"), F.coalesce(F.max(F.length("word")), F.lit(1)).alias("longest"), F.coalesce(F.sum(F.length("word")), F.lit(1)).alias("letters")).first()
    few = size["n"] <= SENT_WORDS
    own = F.struct(*keys)
    x = streams.select(own.alias("_id"), F.coalesce(chars, F.array().cast("array<string>")).alias("_chars"), F.col(text).alias("_text"))
    x = x.withColumn("_marks", verified_marks(F.col("_chars"), F.col("_text"))).withColumn("_heard", F.array_join("_chars", ""))
    clean = F.regexp_extract("_heard", rf"^(?:(?!{_MARK})\S)*", 0)
    x = x.withColumn("_spoken", F.when(F.col("_marks").isNotNull(), F.split("_text", rf"(?:{_MARK}|\s)+", -1)).otherwise(F.array(clean)))
    x = x.withColumn("_begun", F.aggregate("_spoken", F.array(F.lit(0)), lambda a, p: F.concat(a, F.array(F.element_at(a, -1) + F.length(p)))))
    parts = F.filter(F.arrays_zip(F.col("_spoken").alias("s"), F.slice("_begun", F.lit(1), F.size("_spoken")).alias("b")), lambda z: z["s"] != "")
    # written, as each later use would look for marks and stretches again
    x = written(x.select("_id", F.size("_chars").alias("_size"), "_marks", parts.alias("_parts")).dropDuplicates(["_id"]))
    stretches = x.select("_id", F.explode("_parts").alias("_p")).select("_id", F.col("_p.b").alias("_at"), F.col("_p.s").alias("_s"))
    one = weights.select("total").limit(1).first()
    single = -int(round(float(np.log(one[0])) * 1_000_000)) if one else 0
    heard = stretches.agg(F.coalesce(F.sum(F.length("_s")), F.lit(0)).alias("n")).first()["n"]
    if size["n"] <= SENT_WORDS and heard <= SENT_CHARS:
        known = _by_join(stretches, weights, size["longest"], single)
    else:
        known = _by_slices(stretches, weights, heard, size["n"], size["letters"], single)
    found = stretches.join(known, "_s").select("_id", "_s", "_at", F.transform("_ends", lambda e: e + F.col("_at")).alias("_ends"))
    if joined:  # a cut between two characters of one run is none
        runs = F.transform(F.sequence(F.lit(1), F.length("_s")), lambda i: F.concat(F.substring("_s", i, F.lit(1)), F.substring("_s", i + 1, F.lit(1))).rlike(f"^(?:{joined.rstrip('+')}){{2}}$"))
        found = found.withColumn("_inside", runs).withColumn("_ends", F.filter("_ends", lambda e: ~F.get("_inside", e - F.col("_at"))))
    found = found.groupBy("_id").agg(F.flatten(F.collect_list("_ends")).alias("_words"))
    x = x.join(found, "_id", "left")
    last = F.filter(F.array(F.col("_size") - 1), lambda e: e >= 0)
    none = F.array().cast("array<int>")
    punct = F.array_sort(F.array_union(F.coalesce("_marks", none), last))
    marked = x.select("_id", punct.alias("punct"), F.array_sort(F.array_union(F.array_union(F.coalesce("_words", none), F.coalesce("_marks", none)), last)).alias("brk"))
    return streams.alias("l").join(marked.alias("r"), F.struct(*[F.col(f"l.{k}") for k in keys]).eqNullSafe(F.col("r._id")), "left").select("l.*", "r.punct", "r.brk")


def legal_cut(cuts: list[int], target: int, low: int, high: int) -> int | None:
    """The one of sorted cuts in [low, high) nearest to target, the smaller of two; None if there is none."""
    at = bisect_left(cuts, target)
    near = [c for c in cuts[max(0, at - 1) : at + 1] if low <= c < high]
    if not near:  # the target lies outside of the bounds
        k = bisect_left(cuts, low) if target < low else bisect_left(cuts, high) - 1
        near = [c for c in cuts[max(k, 0) : k + 1] if low <= c < high]
    return min(near, key=lambda c: (abs(c - target), c), default=None)


def _pieces(begin: int, end: int, cuts: list[int]) -> list[tuple[int, int]]:
    """An uncovered stretch, cut at the legal place nearest its middle if it is long and has one."""
    cut = legal_cut(cuts, begin + (end - begin + 1) // 2 - 1, begin, end - 1) if end - begin > LONG_GAP else None
    return [] if begin >= end else [(begin, end)] if cut is None else [(begin, cut + 1), (cut + 1, end)]


def cover(n: int, cuts: list[int], parts: list[tuple[int, int, str]], role: str) -> list[tuple[int, int, str]]:
    """Parts of all n characters with borders at legal cuts; see covered_parts."""
    ends = [0, *[b for _, b, _ in parts]]
    gaps = [[(a, b, role) for a, b in _pieces(end, begin, cuts)] for end, begin in zip(ends, [*[a for a, _, _ in parts], n], strict=True)]
    whole = [x for k, gap in enumerate(gaps) for x in (*gap, *parts[k : k + 1])]
    if not cuts:
        return whole
    begins, roles = [], []  # of the parts so far; the last one ends where the next is to begin
    legal = set(cuts)
    for k, (a, b, kind) in enumerate(whole):
        border = a
        if begins and whole[k - 1][1] == a and a - 1 not in legal:
            cut = legal_cut(cuts, a - 1, begins[-1], b - 1)
            if cut is None:
                roles[-1] = kind if b - a > a - begins[-1] else roles[-1]
                continue
            border = cut + 1
        begins.append(border)
        roles.append(kind)
    ends = [*begins[1:], whole[-1][1]] if whole else []
    return list(zip(begins, ends, roles, strict=True))


#: Lines whose parts are Python objects at one time, whatever the size of a batch.
FEW_LINES = 256


def covered_parts(lines: DataFrame, parts: str = "parts", n: str = "n", cuts: str = "cuts", role: str = "narration") -> DataFrame:
    """lines whose parts (array<struct<a, b, role>>, in order and apart, in characters [a, b) of n) cover all characters, and begin and end at legal cuts.

    Stretches that no part covers become parts of the given role. Then, from left to right, a border that is not behind one of ``cuts`` (a cut c lies behind character c) moves to the nearest cut inside
    of the two parts it divides (the first of two). Where there is none the two are one, with the role of the longer one, the first of equals. Cuts at or beyond the last
    character don't count; a line without cuts keeps its borders. Null parts, and null cuts, are none. A line is one row.
    """

    kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("role", pa.string())]))
    schema = ", ".join(f"`{f.name}` {'array<struct<a:int,b:int,role:string>>' if f.name == parts else f.dataType.simpleString()}" for f in lines.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, FEW_LINES):
                few = batch.slice(at, FEW_LINES)
                out = []
                for m, c, ps in zip(*[few.column(x).to_pylist() for x in (n, cuts, parts)], strict=True):
                    m = int(m or 0)
                    legal = sorted({int(x) for x in c or () if 0 <= x < m - 1})
                    rows = [(int(p["a"]), int(p["b"]), p["role"]) for p in ps or ()]
                    out.append([{"a": a, "b": b, "role": r} for a, b, r in cover(m, legal, rows, role)])
                yield pa.RecordBatch.from_arrays([pa.array(out, kind) if c == parts else few.column(c) for c in lines_columns], lines_columns)

    lines_columns = lines.columns
    return lines.mapInArrow(run, schema)
