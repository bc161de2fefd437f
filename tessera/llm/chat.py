"""Transcript parsing with a hidden Markov model, and canonical rendering of turns.

A transcript is a sequence of text chunks (conv_id, seq, text), each of one or more
lines; chunks need not end where turns do. The model's states are the speaker roles. A line shows a speaker
marker (such as "User:") or none, and features of its form: its length, a question, a list or code line.
All probabilities, of the first role, of the next line's role with and without a marker, of markers and of
features, are counts over labelled conversations (``learn_roles``), summed in Spark over every row given.
Viterbi decoding over all lines of a conversation gives each line its role, also where
speakers have left no marker; a marker or a change of role opens a turn, the marker is cut off, and turns are
put together across chunks and rendered in one format.

A conversation may hold any share of all rows, so it is cut into blocks of chunks:

1. each block's lines become one matrix, the best log-probability from every role
   before it to every role at its end (products of matrices in which sum and maximum
   take the places of product and sum);
2. the blocks' matrices of a conversation are chained, and traced back to the best role
   at each block border; that is one small row per ``block`` chunks;
3. each block is decoded on its own, between its two border roles; the turns that begin in the blocks before it,
   again one number a block, tell which turns its lines belong to.

The result is that of one Viterbi pass over the whole conversation.

Defined results: a null or empty text is one empty line; a null conv_id is a conversation
of its own; chunks with the same seq (a null seq is 0), and rows that repeat, are ordered by their text and lie
in one block; a very long text is as many lines as it has, a very long line one line; of two
roles that are equally likely the one named first in ROLES is taken; roles other than ROLES, and null roles, teach nothing;
an empty table gives an empty result; other columns, however they are called, are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tessera.llm.common import materialize, rows_of, tidy

ROLES = ("system", "user", "assistant")
_MARKER = re.compile(r"\s*(?:\*\*|\[|<\|?|#+\s*)?(system|user|human|customer|assistant|ai|bot|model)(?:\*\*|\]|\|?>)?\s*[:：]\s*", re.IGNORECASE)
_OF = {"system": 0, "user": 1, "human": 1, "customer": 1, "assistant": 2, "ai": 2, "bot": 2, "model": 2}
_LISTED = re.compile(r"\s*(?:[-*•]|\d+[.)]|```|    )")
LENGTHS = 14
#: Sizes of the tables of counts: a marker's kind, a line's length class, a question, a list or code line.
FEATURES = {"marker": 4, "length": LENGTHS, "question": 2, "listed": 2}


def line_features(line: str) -> tuple[dict[str, int], int]:
    """The line's feature values and the marker's length; marker 3 is none, length classes are powers of the root of two from 8 on."""
    m = _MARKER.match(line)
    body = line[m.end() :] if m else line
    length = int(np.clip(np.floor(2 * np.log2(max(len(body), 1) / 8)) + 1, 0, LENGTHS - 1))
    return {"marker": _OF[m[1].lower()] if m else 3, "length": length, "question": int(body.rstrip().endswith("?")), "listed": int(_LISTED.match(body) is not None)}, m.end() if m else 0


@dataclass
class RoleModel:
    """Log-probabilities: of the first line's role, of the next line's role after a marker and without one, and of each feature (role, value)."""

    start: np.ndarray
    turn: np.ndarray
    stay: np.ndarray
    features: dict[str, np.ndarray] = field(default_factory=dict)

    @classmethod
    def of(cls, counts: dict[tuple[str, int, int], int]) -> RoleModel:
        """From counts by (table, role, value); one is added to each, so nothing is impossible."""

        def table(name: str, columns: int) -> np.ndarray:
            c = np.array([[counts.get((name, r, v), 0) + 1.0 for v in range(columns)] for r in range(3)])
            return np.log(c / c.sum(axis=1, keepdims=True))

        first = np.array([counts.get(("start", r, 0), 0) + 1.0 for r in range(3)])
        return cls(np.log(first / first.sum()), table("turn", 3), table("stay", 3), {k: table(k, n) for k, n in FEATURES.items()})

    def line(self, text: str) -> tuple[np.ndarray, bool, int]:
        """Log-probabilities of the line under each role, whether it opens with a marker, and the marker's length."""
        values, cut = line_features(text)
        return sum(self.features[k][:, v] for k, v in values.items()), values["marker"] < 3, cut

    def step(self, marked: bool) -> np.ndarray:
        return self.turn if marked else self.stay

    def transfer(self, lines: list[str], first: bool) -> np.ndarray:
        """Best log-probability from each role before the lines to each role at their end; the first block starts anew in every row."""
        best: np.ndarray | None = None
        for text in lines:
            emit, marked, _ = self.line(text)
            if best is None:
                best = (np.tile(self.start, (3, 1)) if first else self.step(marked)) + emit
            else:
                best = (best[:, :, None] + self.step(marked)[None]).max(axis=1) + emit
        return best

    def decode(self, lines: list[str], entry: int, leave: int | None, first: bool) -> list[int]:
        """Viterbi roles of the lines between two known roles."""
        delta, back = None, []
        for text in lines:
            emit, marked, _ = self.line(text)
            if delta is None:
                delta = (self.start if first else self.step(marked)[entry]) + emit
            else:
                cand = delta[:, None] + self.step(marked)
                back.append(cand.argmax(axis=0))
                delta = cand.max(axis=0) + emit
        at = int(delta.argmax()) if leave is None else leave
        path = [at]
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        return path[::-1]


#: Places of chunks that a pair of turns has in a transcript's order; more than an array can hold.
PAIR = 1 << 32


def split_lines(text: str | None) -> list[str]:
    return (text or "").split("\n")


def learn_roles(turns: DataFrame, block: int = 256) -> RoleModel:
    """A model from labelled turns (conv_id, seq, role, text with the markers that transcripts have). Only sums of counts reach the driver, some 100 numbers.

    Turns are counted in blocks of so many seq values; a block knows the role that the turn before it has. A turn of unknown role is neither counted nor followed by a
    change, and only the first turn of a conversation is a start.
    """
    seq = F.coalesce(F.col("seq").cast("long"), F.lit(0))
    rows = turns.select("conv_id", F.floor(seq / block).cast("long").alias("b"), seq.alias("seq"), "role", "text")
    order = Window.partitionBy("conv_id").orderBy("b")  # a row for each block
    ends = rows.groupBy("conv_id", "b").agg(F.max_by(F.struct("role"), F.struct("seq", "text")).alias("e"))
    ends = ends.select("conv_id", "b", F.coalesce(F.lag("e.role").over(order), F.lit("")).alias("entry"), (F.row_number().over(order) == 1).alias("begins"))
    rows = rows.alias("r").join(ends.alias("e"), F.expr("r.conv_id <=> e.conv_id AND r.b = e.b")).select("r.conv_id", "r.b", "r.seq", "r.role", "r.text", "e.entry", "e.begins")
    rows = rows.repartition("conv_id", "b").sortWithinPartitions("conv_id", "b", "seq", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[str, int, int], int] = {}
        where, before, begins = None, None, False

        def add(*key) -> None:
            counts[key] = counts.get(key, 0) + 1

        for batch in batches:
            for conv_id, b, _, role, text, entry, first in rows_of(batch):
                if (conv_id, b) != where:
                    where, before, begins = (conv_id, b), ROLES.index(entry) if entry in ROLES else None, first
                if role not in ROLES:
                    before, begins = None, False
                    continue
                r = ROLES.index(role)
                for line in split_lines(text):
                    values, _ = line_features(line)
                    for k, v in values.items():
                        add(k, r, v)
                    if before is not None:
                        add("turn" if values["marker"] < 3 else "stay", before, r)
                    elif begins:
                        add("start", r, 0)
                    before, begins = r, False
        names = list(counts)
        yield pa.RecordBatch.from_arrays([pa.array([k[i] for k in names], t) for i, t in enumerate((pa.string(), pa.int32(), pa.int32()))] + [pa.array([counts[k] for k in names], pa.int64())], names=["name", "role", "value", "n"])

    got = rows.mapInArrow(tidy(count), "name string, role int, value int, n long").groupBy("name", "role", "value").agg(F.sum("n").alias("n")).collect()
    return RoleModel.of({(r["name"], r["role"], r["value"]): r["n"] for r in got})


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Consecutive rows with equal keys, from sorted batches."""
    key, rows = None, []
    for batch in batches:
        for row in rows_of(batch):
            if row[:keys] != key and rows:
                yield key, rows
                rows = []
            key = row[:keys]
            rows.append(row)
    if rows:
        yield key, rows


def _tables(rows: Iterator[tuple], schema: list[tuple[str, pa.DataType]], at_once: int = 2000) -> Iterator[pa.RecordBatch]:
    """Rows as record batches, some at a time."""
    out = []
    make = lambda: pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, (_, t) in enumerate(schema)], names=[n for n, _ in schema])
    for row in rows:
        out.append(row)
        if len(out) == at_once:
            yield make()
            out = []
    if out:
        yield make()


def parse_transcripts(chunks: DataFrame, model: RoleModel, block: int = 256) -> DataFrame:
    """conv_id, turn_no (from 0), role, n_lines, content, rendered: the turns of each conversation, in order."""
    kind = chunks.schema["conv_id"].dataType
    conv, arrow = kind.simpleString(), to_arrow_type(kind)
    shared = chunks.sparkSession.sparkContext.broadcast(model)
    rows = chunks.select("conv_id", F.floor(F.coalesce(F.col("seq").cast("long"), F.lit(0)) / block).cast("long").alias("block"), F.col("seq").cast("long").alias("seq"), "text")

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value

        def made() -> Iterator[tuple]:
            for (conv_id, b), group in _runs(batches, 2):
                lines = [x for r in group for x in split_lines(r[3])]
                yield conv_id, b, m.transfer(lines, False).ravel().tolist(), m.transfer(lines, True).ravel().tolist()

        yield from _tables(made(), [("conv_id", arrow), ("block", pa.int64()), ("m", pa.list_(pa.float64())), ("m0", pa.list_(pa.float64()))])

    def borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> Iterator[tuple]:
            for (conv_id,), group in _runs(batches, 1):
                delta, back = np.asarray(group[0][3]).reshape(3, 3)[0], []
                for r in group[1:]:
                    cand = delta[:, None] + np.asarray(r[2]).reshape(3, 3)
                    back.append(cand.argmax(axis=0))
                    delta = cand.max(axis=0)
                ends = [int(delta.argmax())]
                for b in reversed(back):
                    ends.append(int(b[ends[-1]]))
                ends.reverse()
                yield from ((conv_id, r[1], ends[k - 1] if k else -1, ends[k]) for k, r in enumerate(group))

        yield from _tables(made(), [("conv_id", arrow), ("block", pa.int64()), ("entry", pa.int32()), ("leave", pa.int32())])

    blocks = rows.select("conv_id", "block").distinct().groupBy("conv_id").agg(F.count("*").alias("blocks"))
    long_ = blocks.filter("blocks > 1")
    # conversations of one block need no borders
    many = rows.join(long_.select("conv_id"), rows["conv_id"].eqNullSafe(long_["conv_id"]), "left_semi").repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "seq", "text")
    many = materialize(many.mapInArrow(tidy(matrices), f"conv_id {conv}, block long, m array<double>, m0 array<double>"), "matrices")
    edge = materialize(many.repartition("conv_id").sortWithinPartitions("conv_id", "block").mapInArrow(tidy(borders), f"conv_id {conv}, block long, entry int, leave int"), "borders")
    same = rows["conv_id"].eqNullSafe(edge["conv_id"]) & (rows["block"] == edge["block"])
    told = rows.join(edge, same, "left").select(rows["conv_id"], rows["block"], "seq", "text", "entry", "leave")
    told = told.repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "seq", "text")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value

        def made() -> Iterator[tuple]:
            for (conv_id, b), group in _runs(batches, 2):
                lines = [x for r in group for x in split_lines(r[3])]
                entry, leave = group[0][4], group[0][5]
                first = entry is None or entry < 0
                roles = m.decode(lines, max(0, entry or 0), leave, first)
                held: list[str] = []
                before, begins, k = (None if first else entry), False, 0
                for line, role in zip(lines, roles, strict=True):
                    _, marked, cut = m.line(line)
                    if marked or role != before:
                        if held:
                            yield conv_id, b, k, begins, ROLES[before], len(held), "\n".join(held)
                            k += 1
                        held, begins = [line[cut:]], True
                    else:
                        held.append(line)
                    before = role
                yield conv_id, b, k, begins, ROLES[before], len(held), "\n".join(held)

        yield from _tables(made(), [("conv_id", arrow), ("block", pa.int64()), ("k", pa.int32()), ("begins", pa.bool_()), ("role", pa.string()), ("n_lines", pa.int32()), ("content", pa.string())], 500)

    found = materialize(told.mapInArrow(tidy(pieces), f"conv_id {conv}, block long, k int, begins boolean, role string, n_lines int, content string"), "pieces")
    # turns that begin before a block: one row a block
    per = found.groupBy("conv_id", "block").agg(F.count_if("begins").alias("_n"))
    upto = F.coalesce(F.sum("_n").over(Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per = per.withColumn("_before", upto).drop("_n")
    own = F.count_if("begins").over(Window.partitionBy("conv_id", "block").orderBy("k").rowsBetween(Window.unboundedPreceding, 0))
    numbered = found.withColumn("_own", own).alias("f").join(per.alias("p"), F.expr("f.conv_id <=> p.conv_id AND f.block = p.block"))
    numbered = numbered.select("f.conv_id", "f.block", "k", "role", "n_lines", "content", (F.col("_before") + F.col("_own") - 1).alias("turn_no"))
    parts = F.array_sort(F.collect_list(F.struct("block", "k", "content")))
    turns = numbered.groupBy("conv_id", "turn_no").agg(F.first("role").alias("role"), F.sum("n_lines").alias("n_lines"), F.array_join(F.transform(parts, lambda p: p["content"]), "\n").alias("content"))
    return turns.withColumn("rendered", rendered(F.col("role"), F.col("content")))


def rendered(role: Column, content: Column) -> Column:
    return F.concat(F.lit("<|"), role, F.lit("|>\n"), F.trim(content), F.lit("<|end|>\n"))


def with_markers(conversations: DataFrame, unmarked: int = 3) -> DataFrame:
    """conv_id, seq, role, text: turns as speakers leave them, with a marker before each but for every unmarked-th, chosen by a hash of conversation and turn (0: none is left out)."""
    left_out = F.pmod(F.xxhash64("conv_id", "turn"), F.lit(unmarked)) == 0 if unmarked else F.lit(False)
    marker = F.when(F.col("role").isNull() | left_out, F.lit("")).otherwise(F.concat(F.initcap("role"), F.lit(": ")))
    return conversations.select("conv_id", F.col("turn").alias("seq"), "role", F.concat(marker, F.coalesce("text", F.lit(""))).alias("text"))


def as_transcript(turns: DataFrame, lines: int = 4) -> DataFrame:
    """conv_id, seq, text: the turns' lines in chunks of so many, which begin and end wherever they do; only pairs of turns are kept apart, so that no conversation has to come together in one place."""
    pair = F.floor(F.coalesce(F.col("seq").cast("long"), F.lit(0)) / 2)
    both = turns.groupBy("conv_id", pair.alias("pair")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), "\n").alias("text"))
    all_ = F.split("text", "\n")
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / lines).cast("int")), lambda k: F.array_join(F.slice(all_, k * lines + 1, F.lit(lines)), "\n"))
    return both.select("conv_id", "pair", F.posexplode(cut).alias("k", "text")).select("conv_id", (F.col("pair") * PAIR + F.col("k")).alias("seq"), "text")
