"""Statistics of whole documents, for the quality classifier and the quality rules.

Words are maximal runs of characters other than the space and U+0009 to U+000D.
A null text counts as the empty text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm.common import tidy

#: Whole numbers of a document, in the order of document_counts().
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_chars_all", "n_upper", "n_letters_ascii", "n_digits", "n_commas", "n_stops", "n_marks", "n_pipes", "n_distinct", "n_same_next", "n_top_word", "n_upper_words", "n_marked_words", "n_long_words")
#: Ratios that a model sees, in the order of ratios().
RATIOS = ("log_words", "mean_word", "symbols_per_word", "dup_lines", "repeat_words", "words_per_line", "upper", "digits", "commas", "stops", "marks", "pipes", "distinct", "same_next", "top_word", "upper_words", "marked_words", "long_words")

_SPACES = " \t\n\v\f\r"
_UPPER = bytes(range(65, 91))
_LETTERS = _UPPER + bytes(range(97, 123))
_DIGITS = b"0123456789"
#: Two capitals before any other ASCII character; no part of the pattern gives back what it has taken, so it is linear.
_TWO_CAPITALS = re.compile(rb"[\x80-\xff]*+[A-Z][\x80-\xff]*+[A-Z]")
_MARKED = re.compile(rb"([*#$%&!])\1(?![^ \t-\r])")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def repeated_words(ids: np.ndarray, window: int = 8) -> int:
    """Words that lie in a window of that many words which is found twice or more in the text."""
    n = len(ids)
    if n <= window:
        return 0
    base = _scramble((ids.astype(np.uint64) + np.uint64(1)) * _MIX)
    h = base[: n - window + 1].copy()
    for k in range(1, window):
        h = h * _MIX + base[k : n - window + 1 + k]
    order = np.argsort(h, kind="stable")
    s = h[order]
    same = s[1:] == s[:-1]
    if not same.any():
        return 0
    again = np.zeros(len(h), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    edge = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(again)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def document_counts(text: str | None) -> tuple[int, ...]:
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    lines = [x for x in text.split("\n") if x.strip(_SPACES)]
    counts = np.bincount(ids) if n else np.zeros(1, np.int64)
    upper = len(raw) - len(raw.translate(None, _UPPER))
    return (
        n, len(text) - sum(text.count(c) for c in _SPACES), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), repeated_words(ids),
        len(lines), len(text), upper, len(raw) - len(raw.translate(None, _LETTERS)), len(raw) - len(raw.translate(None, _DIGITS)),
        raw.count(b","), raw.count(b"."), raw.count(b"!") + raw.count(b"?"), raw.count(b"|"), len(seen),
        int((ids[1:] == ids[:-1]).sum()), int(counts.max()), sum(int(counts[i]) for w, i in seen.items() if w.isupper() and _TWO_CAPITALS.match(w)), len(_MARKED.findall(raw)), int((counts[[i for i, w in enumerate(seen) if len(w) > 24]]).sum()) if n else 0,
    )


def document_statistics(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns and one long column per count; the text stays behind."""
    source = docs.select(*keep, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.asarray([document_counts(t) for t in batch.column(len(keep)).to_pylist()], dtype=np.int64).reshape(-1, len(COUNTS))
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(keep))], *[pa.array(rows[:, j]) for j in range(len(COUNTS))]], names=[*keep, *COUNTS])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema] + [f"{c} long" for c in COUNTS])
    return source.mapInArrow(tidy(run), schema)


def ratios(counts: np.ndarray) -> np.ndarray:
    """Model inputs, one row per document, from rows of counts."""
    c = {k: counts[:, i].astype(np.float64) for i, k in enumerate(COUNTS)}
    w = np.maximum(c["n_words"], 1)
    chars = np.maximum(c["n_chars_all"], 1)
    lines = np.maximum(c["n_lines"], 1)
    return np.column_stack([
        np.log1p(c["n_words"]), c["word_chars"] / w, c["n_symbols"] / w, c["n_dup_lines"] / lines, c["n_repeat_words"] / w, np.log1p(c["n_words"] / lines),
        c["n_upper"] / np.maximum(c["n_letters_ascii"], 1), c["n_digits"] / chars, c["n_commas"] / w, c["n_stops"] / w, c["n_marks"] / w, c["n_pipes"] / w,
        c["n_distinct"] / w, c["n_same_next"] / w, c["n_top_word"] / w, c["n_upper_words"] / w, c["n_marked_words"] / w, c["n_long_words"] / w,
    ])


def counts_of(batch: pa.RecordBatch) -> np.ndarray:
    return np.column_stack([batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in COUNTS]).astype(np.int64)
