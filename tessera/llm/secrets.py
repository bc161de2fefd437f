"""Secret scans: base patterns, and multipart credentials linked by an interval join.

The base kinds (assign, access, hex) are reported as they stand. Access identifiers,
bare secrets and endpoints are weak on their own: a 40-character string may be a
checksum and a host name is no secret. They are parts, found by shape. ``link_parts``
joins secrets with identifiers and endpoints that stand in the same paragraph, less than
``most_lines`` lines apart, wherever in the paragraph that is; paragraphs end at blank
lines. Only parts that complete one another are reported, as kinds secret, id and
endpoint; base spans are never dropped.

The join is one on intervals of line numbers inside one document: both sides are sorted,
so it takes a binary search for each part, and no rows are shuffled.

Defined results: a null text is the empty text, with no spans; spans are code points,
end exclusive, ordered by start and then by kind; rows that repeat are scanned each on
its own; extra columns are kept.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import tidy

KINDS = ("assign", "access", "hex", "secret", "id", "endpoint")
SPANS = "array<struct<start:int,end:int,kind:string>>"

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
#: Parts: a bare random string, an account or key identifier, and where to use them.
_SECRET_PART = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{32,}+={0,2}+(?![A-Za-z0-9+/_=-])")
_ID_PART = re.compile(r"(?<![A-Za-z0-9])(?:A[KS]IA[A-Z0-9]{12,}|(?:client|tenant|account|key|user)[_-]?(?:id|name)[\"']?\x20?[:=]\x20?[\"']?[A-Za-z0-9_.@-]{3,})", re.ASCII | re.IGNORECASE)
_ENDPOINT_PART = re.compile(r"(?:https?|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb(?:\+srv)?|redis|amqp|s3|ftp)://[^\s\"'<>]{4,}|(?<![\w.@-])(?:[a-z0-9-]+\.)+(?:internal|amazonaws\.com|example\.com)(?::\d+)?(?![\w.-])", re.ASCII)
_BLANK = re.compile(r"\n[ \t\r]*\n")

Span = tuple[int, int, str]


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each base kind; those too short are dropped."""
    out = [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return out + [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]


def random_looking(s: str) -> bool:
    """At least 3.5 bits a character, and both digits and letters."""
    n = len(s)
    if not (any(c.isdigit() for c in s) and any(c.isalpha() for c in s)):
        return False
    return -sum(c / n * math.log2(c / n) for c in Counter(s).values()) >= 3.5


def parts(text: str) -> list[Span]:
    out = [(m.start(), m.end(), "secret") for m in _SECRET_PART.finditer(text) if random_looking(m[0])]
    if not out:
        return out  # nothing to complete
    out += [(m.start(), m.end(), "id") for m in _ID_PART.finditer(text)]
    return out + [(m.start(), m.end(), "endpoint") for m in _ENDPOINT_PART.finditer(text)]


def places(text: str, found: list[Span]) -> list[tuple[int, int]]:
    """(paragraph, line) of each part; a part lies in one line."""
    ends, blanks = [m.start() for m in re.finditer("\n", text)], [m.start() for m in _BLANK.finditer(text)]
    return [(bisect_right(blanks, s), bisect_right(ends, s)) for s, *_ in found]


def link_parts(found: list[Span], at: list[tuple[int, int]], most_lines: int) -> list[Span]:
    """Interval join on line numbers: the parts that have a complementary part in their paragraph, less than most_lines lines away."""
    secret, other = (sorted(p for (*_, k), p in zip(found, at, strict=True) if (k == "secret") == is_secret) for is_secret in (True, False))

    def linked(kind: str, paragraph: int, line: int) -> bool:
        those = other if kind == "secret" else secret
        k = bisect_right(those, (paragraph, line - most_lines))
        return k < len(those) and those[k][0] == paragraph and those[k][1] < line + most_lines

    return sorted(p for p, (paragraph, line) in zip(found, at, strict=True) if linked(p[2], paragraph, line))


def scan(text: str | None, most_lines: int = 12) -> list[Span]:
    """Base spans and linked parts, by start and then by kind."""
    if not text:
        return []
    spans = base_spans(text)
    weak = parts(text)
    if len(weak) > 1:
        spans += link_parts(weak, places(text, weak), most_lines)
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def find_secrets(docs: DataFrame, text: str = "text", keep_text: bool = True, most_lines: int = 12) -> DataFrame:
    """docs with secret_spans: every span found in the whole text."""
    names = [c for c in docs.columns if c != "secret_spans"]
    kept = [c for c in names if keep_text or c != text]
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[{"start": s, "end": e, "kind": k} for s, e, k in scan(t, most_lines)] for t in batch.column(names.index(text)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(names.index(c)) for c in kept], pa.array(found, kind)], names=[*kept, "secret_spans"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*kept).schema)
    return docs.select(*names).mapInArrow(tidy(run), f"{schema}, secret_spans {SPANS}")


def masked(text: str | None, spans: list[Span]) -> str | None:
    """The text with every span's characters replaced by its kind in brackets; overlapping spans are masked as one."""
    if not text or not spans:
        return text
    out, at = [], 0
    merged: list[list] = []
    for s, e, k in sorted(spans):
        if merged and s < merged[-1][1]:
            merged[-1][1] = max(e, merged[-1][1])
        else:
            merged.append([s, e, k])
    for s, e, k in merged:
        out += [text[at:s], f"[{k}]"]
        at = e
    return "".join([*out, text[at:]])


def redact_secrets(docs: DataFrame, text: str = "text", length: str | None = "n_chars", most_lines: int = 12) -> DataFrame:
    """docs with every found span masked, and the length column, if there is one, brought up to date."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = names.index(text)
            new = [masked(t, sp) if (sp := scan(t, m)) else t for t, m in zip(batch.column(at).to_pylist(), repeat(most_lines))]
            yield pa.RecordBatch.from_arrays([pa.array(new, pa.string()) if i == at else c for i, c in enumerate(batch.columns)], names=names)

    out = docs.mapInArrow(tidy(run), docs.schema)
    if length in names:
        # a length that was null stays null
        out = out.withColumn(length, F.when(F.col(length).isNotNull(), F.length(text)).cast(docs.schema[length].dataType))
    return out.select(*names)
