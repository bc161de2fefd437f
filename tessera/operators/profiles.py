"""What the captions of a video have in common: a style for each kind of caption, and how much of the time they cover."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import scalars as S
from tessera.operators.intervals import covered_length

#: Which style a caption's role counts to (any other: narration), and from which covered share on captions are dense.
BUCKETS = {"narration": "narration", "emphasis": "emphasis", "hook": "emphasis", "highlight": "highlight", "label": "label"}
FULL_DENSITY = 0.55
#: Fixed values of a style that no caption shows.
DEFAULTS = {"fill": "#FFFFFF", "outline": "#101010", "fill_hint": "#FFFFFF", "outline_hint": "#101010", "size": "normal", "vertical": "bottom", "horizontal": "center"}


def bucket_of(role: Column) -> Column:
    kinds = F.create_map(*[F.lit(x) for kv in BUCKETS.items() for x in kv])
    return F.coalesce(F.try_element_at(kinds, F.coalesce(role, F.lit(""))), F.lit("narration"))


def style_profiles(captions: DataFrame, video: str, order: str) -> DataFrame:
    """One row per video and style: n, share, fill, outline, calib_share, the commonest hints, size, position and slant, and effects.

    captions: video, order, role, fill_hint, outline_hint, fill_calib, outline_calib, confidence, vertical, horizontal, size, slant, effects. A colour is the calibrated one where that is
    trusted. Of values that are equally common the one seen first counts; empty ones don't. slant is whether half of the captions or more are slanted. Every video has a style for
    narration, empty if it has no such caption, with the fixed defaults. Each value is counted before it comes together, so a video with any number of captions is a few rows by then; all kinds of values are counted in one pass.
    """
    key = [video, "style"]
    x = captions.withColumns({"style": bucket_of(F.col("role")), "_fill": S.trusted_color(F.col("fill_calib"), F.col("confidence"), F.col("fill_hint")), "_outline": S.trusted_color(F.col("outline_calib"), F.col("confidence"), F.col("outline_hint"))["value"]})
    shown = {"fill": F.col("_fill.value"), "outline": F.col("_outline"), "fill_hint": F.col("fill_hint"), "outline_hint": F.col("outline_hint"), "size": F.col("size"), "vertical": F.col("vertical"), "horizontal": F.col("horizontal")}
    one = lambda kind, value, p=F.lit(0): F.struct(F.lit(kind).alias("kind"), value.cast("string").alias("v"), p.alias("p"))
    flags = F.concat(F.when(F.col("_fill.source") == "calibrated", "c").otherwise(""), F.when(F.col("slant"), "s").otherwise(""))
    listed = F.transform(F.coalesce("effects", F.array().cast("array<string>")), lambda v, p: one("effects", v, p))
    rows = x.select(*key, F.col(order).alias("_o"), F.explode_outer(F.concat(F.array(one("caption", flags), *[one(k, c) for k, c in shown.items()]), listed)).alias("_x"))
    # an outer explode, as from a plain one the optimizer makes a filter that works out all colours again; a caption is counted by its flags; empty values are no values, but for effects
    rows = rows.select(*key, "_o", "_x.*").filter(F.col("v").isNotNull() & ((F.col("v") != "") | F.col("kind").isin("caption", "effects")))
    counted = rows.groupBy(*key, "kind", "v", "p").agg(F.count("*").alias("_n"), F.min("_o").alias("_at"))  # plain buffers, so rows are hashed and not sorted
    of = lambda kind, c: F.when(F.col("kind") == kind, c)
    having = lambda flag: F.coalesce(F.sum(of("caption", F.when(F.contains("v", F.lit(flag)), F.col("_n")).otherwise(0))), F.lit(0))
    commonest = [F.max_by("v", of(k, F.struct("_n", -F.col("_at")))).alias(k) for k in shown]
    base = counted.groupBy(*key).agg(F.sum(of("caption", F.col("_n"))).alias("n"), having("c").alias("_calib"), having("s").alias("_slant"), *commonest, F.collect_list(of("effects", F.struct("_at", "p", "v"))).alias("_e"))
    base = base.withColumns({"calib_share": F.round(F.col("_calib") / F.col("n"), 3), "slant": 2 * F.col("_slant") >= F.col("n"), "effects": F.array_distinct(F.transform(F.array_sort("_e"), lambda e: e["v"]))}).drop("_calib", "_slant", "_e")
    # a video's few styles come together: the sum of their captions, and narration where it is missing
    styles = base.groupBy(video).agg(F.sum("n").alias("_total"), F.collect_list(F.struct(*[c for c in base.columns if c != video])).alias("_s"))
    none = {"style": F.lit("narration"), "n": F.lit(0).cast("long"), "calib_share": F.lit(0.0), "slant": F.lit(False)}
    empty = F.struct(*[none.get(c, F.lit(None)).cast(base.schema[c].dataType).alias(c) for c in base.columns if c != video])
    every = F.when(F.exists("_s", lambda r: r["style"] == "narration"), F.col("_s")).otherwise(F.concat("_s", F.array(empty)))
    out = styles.select(video, "_total", F.explode(every).alias("_r")).select(video, "_total", "_r.*")
    filled = {c: F.coalesce(F.col(c), F.lit(v)) for c, v in DEFAULTS.items()}
    return out.select(
        *key, "n", F.round(F.col("n") / F.col("_total"), 3).alias("share"), *[filled[c].alias(c) for c in ("fill", "outline", "fill_hint", "outline_hint", "size")], "calib_share",
        (S.position_code(filled["vertical"], filled["horizontal"])).cast("int").alias("position"), "slant", F.coalesce("effects", F.array().cast("array<string>")).alias("effects"),
    )


def caption_density(captions: DataFrame, videos: DataFrame, video: str, duration: str, start: str = "start", end: str = "end") -> DataFrame:
    """video, covered (seconds of the union of its captions), density: full from FULL_DENSITY of the duration on, else sparse; a video without captions, or without a duration, is sparse."""
    covered = covered_length(captions, [video], start, end)
    x = videos.select(video, duration).join(covered, video, "left").withColumn("covered", F.round(F.coalesce("covered", F.lit(0.0)), 2))
    full = (F.col(duration) > 0) & (F.col("covered") / F.col(duration) >= FULL_DENSITY)
    return x.select(video, "covered", F.when(F.coalesce(full, F.lit(False)), "full").otherwise("sparse").alias("density"))


def collapsed_states(steps: DataFrame, keys: list[str], order: list[str], lacks: str = "lacks", url: str = "url") -> DataFrame:
    """keys, place (start, end, or null for an only step), steps, always_lacks and the columns of a group's first and last step: a run of assembly steps told by its two ends.

    What lacks from the first step to the last is always_lacks, in the first step's order. Steps without a url don't count. Of two ends with one url the first is told. Only the two
    ends and counts come together, so a group may have any number of steps.
    """
    shown = steps.filter(F.coalesce(F.col(url), F.lit("")) != "")
    rank, row = F.struct(*order), F.struct(*[c for c in shown.columns if c not in keys])
    ends = shown.groupBy(*keys).agg(F.min_by(row, rank).alias("_first"), F.max_by(row, rank).alias("_last"), F.count("*").alias("steps"))
    items = shown.select(*keys, F.explode(F.array_distinct(lacks)).alias("_item")).groupBy(*keys, "_item").agg(F.count("*").alias("_n"))
    common = items.join(ends.select(*keys, "steps"), keys).filter("_n = steps").groupBy(*keys).agg(F.collect_set("_item").alias("_common"))
    x = ends.join(common, keys, "left")
    kind = shown.schema[lacks].dataType.simpleString()
    always = F.filter(f"_first.{lacks}", lambda v: F.array_contains(F.coalesce("_common", F.array().cast(kind)), v))
    both = F.when(F.col("steps") == 1, F.array(F.struct(F.lit(None).cast("string").alias("place"), F.col("_first").alias("s")))).when(F.col(f"_first.{url}") == F.col(f"_last.{url}"), F.array(F.struct(F.lit("start").alias("place"), F.col("_first").alias("s")))).otherwise(F.array(F.struct(F.lit("start").alias("place"), F.col("_first").alias("s")), F.struct(F.lit("end").alias("place"), F.col("_last").alias("s"))))
    y = x.select(*keys, "steps", always.alias("always_lacks"), F.explode(both).alias("_b"))
    return y.select(*keys, F.col("_b.place").alias("place"), "steps", "always_lacks", "_b.s.*")
