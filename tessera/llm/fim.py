"""Fill-in-the-middle arrangements of whole texts, in Spark SQL functions alone.

A text is cut into units, two cuts are drawn from a hash of its id, and what lies between them goes to the end, behind
sentinels: prefix, suffix, middle ("psm") or suffix, prefix, middle ("spm"). ``restored`` parses the sentinels and puts
the text together again.

Defined results: a null text is the empty text; an empty text, and one that holds a sentinel, stays as it is ("plain");
a null id is hashed as the empty string; rows that repeat an id get the same cuts in as far as their texts have the same
number of units; both cuts may be equal, and any part may be empty; texts of any length are one row and are handled whole;
an empty table gives an empty table. Columns of the input stay, but for those called like a result, which it replaces.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import fresh

#: Lines with their line feed, and the last one without.
LINES = r"[^\n]*\n|[^\n]+"
#: Marks before prefix, suffix and middle.
SENTINELS = ("<P>", "<S>", "<M>")
RESULTS = ("n_units", "form", "prefix_chars", "middle_chars", "output")


def _checked(sentinels: tuple[str, str, str]) -> tuple[str, str, str]:
    """A sentinel's first character stands in no other place of any, so that no sentinel arises across a seam."""
    if len(set(sentinels)) < 3 or not all(sentinels) or any(s[0] in x[1:] for s in sentinels for x in sentinels):
        raise ValueError(f"three different sentinels whose first characters occur nowhere else in them, not {sentinels}")
    return sentinels


def fill_in_middle(docs: DataFrame, text: str = "text", key: str = "doc_id", seed: int = 7, fim_percent: int = 100, spm_percent: int = 50, units: str = LINES, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """docs with RESULTS: units of the text, its form (plain, psm or spm), code points of prefix and middle (null if plain) and the arranged text.

    The first three groups of 32 bits of sha256("<seed>:<key>") draw the cuts and whether the text is arranged at all, the fourth its order.
    ``units`` is a Java pattern whose matches make up the whole text.
    """
    p, s, m = _checked(sentinels)
    mine = {name.lower() for name in RESULTS}
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in mine]
    whole_, units_, digest_, n_, lo_, hi_, form_, prefix_, middle_, suffix_ = fresh(docs, "whole", "units", "digest", "n", "lo", "hi", "form", "prefix", "middle", "suffix")
    whole = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{key}`").cast("string"), F.lit(""))), 256)
    rows = docs.select(*kept, whole.alias(whole_), F.regexp_extract_all(whole, F.lit(units), F.lit(0)).alias(units_), digest.alias(digest_))

    def drawn(k: int) -> Column:
        return F.conv(F.substring(digest_, 8 * k + 1, 8), 16, 10).cast("long")

    n = F.size(units_).cast("long")
    cuts = [drawn(k) % (n + 1) for k in (0, 1)]
    plain = (F.col(whole_) == "") | (drawn(2) % 100 >= fim_percent)
    for mark in sentinels:
        plain = plain | F.contains(whole_, F.lit(mark))
    form = F.when(plain, "plain").when(drawn(3) % 100 < spm_percent, "spm").otherwise("psm")
    rows = rows.select(*kept, whole_, units_, n.alias(n_), F.least(*cuts).cast("int").alias(lo_), F.greatest(*cuts).cast("int").alias(hi_), form.alias(form_))
    part = lambda start, length: F.array_join(F.slice(units_, start, length), "")
    lo, hi = F.col(lo_), F.col(hi_)
    rows = rows.select(*kept, whole_, n_, form_, part(F.lit(1), lo).alias(prefix_), part(lo + 1, hi - lo).alias(middle_), part(hi + 1, F.size(units_) - hi).alias(suffix_))
    arranged = (
        F.when(F.col(form_) == "psm", F.concat(F.lit(p), prefix_, F.lit(s), suffix_, F.lit(m), middle_))
        .when(F.col(form_) == "spm", F.concat(F.lit(s), suffix_, F.lit(p), prefix_, F.lit(m), middle_))
        .otherwise(F.col(whole_))
    )
    chars = lambda c: F.when(F.col(form_) != "plain", F.length(c).cast("long"))
    return rows.select(*kept, F.col(n_).alias("n_units"), F.col(form_).alias("form"), chars(prefix_).alias("prefix_chars"), chars(middle_).alias("middle_chars"), arranged.alias("output"))


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that an output of fill_in_middle was made of; a plain one is the text itself."""
    between = F.split(output, "|".join(re.escape(x) for x in _checked(sentinels)), -1)
    at = lambda k: F.get(between, F.lit(k))
    return F.when(form == "psm", F.concat(at(1), at(3), at(2))).when(form == "spm", F.concat(at(2), at(3), at(1))).otherwise(output)
