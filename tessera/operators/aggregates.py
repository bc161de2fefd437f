"""Aggregations with defined ties and three-valued logic."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def mode_first_seen(df: DataFrame, keys: list[str], value: str, order: str, name: str = "mode") -> DataFrame:
    """keys, mode: the most frequent filled value; of equals the one seen first. Two partial aggregations."""
    filled = df.filter(F.col(value).isNotNull() & (F.col(value).cast("string") != ""))
    counted = filled.groupBy(*keys, value).agg(F.count("*").alias("_n"), F.min(order).alias("_first"))
    return counted.groupBy(*keys).agg(F.max_by(value, F.struct("_n", -F.col("_first"))).alias(name))


#: Rows up to which medians are taken by an aggregate that keeps a group's distinct values in memory.
FEW_ROWS = 200_000


def median_vector(df: DataFrame, keys: list[str], vector: str, name: str = "median", few_rows: int = FEW_ROWS, block_rows: int = 2_000_000) -> DataFrame:
    """keys, median: element-wise; an even count takes the mean of the middle two. Nulls don't count; a place with nothing else is null.

    A table of more rows is dealt out by range of (keys, place, value): counts of blocks say which one or two blocks hold a place's middle values, and only these are ranked, so a group
    may be of any size.
    """
    parts = df.select(*keys, F.posexplode(vector).alias("_i", "_v"))
    rows = df.count()
    if rows <= few_rows:
        med = parts.groupBy(*keys, "_i").agg(F.expr("percentile(_v, 0.5)").alias("_m"))
    else:
        med = _medians(parts, keys, math.ceil(rows * 8 / block_rows))
    return med.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_m"))), lambda s: s["_m"]).alias(name))


def _medians(parts: DataFrame, keys: list[str], blocks: int) -> DataFrame:
    """keys, _i, _m: medians of _v by the ranks of the middle rows."""
    from tessera.plans.tables import written

    group = [*keys, "_i"]
    cut = written(parts.repartitionByRange(blocks, *group, "_v").withColumn("_block", F.spark_partition_id()))
    sizes = cut.groupBy(*group, "_block").agg(F.count("_v").alias("_n"))  # a row for each block and place
    every = Window.partitionBy(*group)
    before = F.coalesce(F.sum("_n").over(every.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    held = sizes.select(*group, "_block", "_n", before.alias("_before"), F.sum("_n").over(every).alias("_all"))
    low, high = F.floor((F.col("_all") - 1) / 2), F.floor(F.col("_all") / 2)
    inside = lambda r: (r >= F.col("_before")) & (r < F.col("_before") + F.col("_n"))
    wanted = written(held.filter(inside(low) | inside(high)).select(*[F.col(c).alias(f"_of_{c}") for c in [*group, "_block"]], "_before", low.alias("_low"), high.alias("_high")))
    own = F.row_number().over(Window.partitionBy(*group, "_block").orderBy("_v")) - 1
    near = cut.filter(F.col("_v").isNotNull()).join(wanted, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in [*group, "_block"]])
    ranked = near.withColumn("_r", own + F.col("_before"))
    middle = ranked.groupBy(*group).agg((0.5 * F.min(F.when(F.col("_r") == F.col("_low"), F.col("_v"))) + 0.5 * F.min(F.when(F.col("_r") == F.col("_high"), F.col("_v")))).alias("_m"))
    places = held.select(*group).distinct()
    found = middle.select(*[F.col(c).alias(f"_of_{c}") for c in group], "_m")
    return places.join(found, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in group], "left").select(*group, "_m")


def union_distinct(df: DataFrame, keys: list[str], value: str, order: str, name: str = "values") -> DataFrame:
    """keys, values: distinct values in the order they are first seen; grouped by value first, so repeats never pile up."""
    firsts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.min(order).alias("_o"))
    return firsts.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_o", value))), lambda s: s[value]).alias(name))


def tristate_any(flag: Column) -> Column:
    """Any True: True; all False: False; else null, also for no rows."""
    return F.when(F.bool_or(flag), True).when((F.count_if(flag.isNull()) == 0) & (F.count(F.lit(1)) > 0), False)


def bucket_profile(df: DataFrame, bucket: str, flag: Column, value: str, order: str, buckets: list[str]) -> DataFrame:
    """bucket, n, share, majority, dominant; buckets that don't occur are added empty."""
    spark = df.sparkSession
    base = df.groupBy(bucket).agg(F.count("*").alias("n"), F.count_if(flag).alias("_true"))
    dom = mode_first_seen(df, [bucket], value, order, "dominant")
    total = df.agg(F.count("*").alias("_total"))
    every = spark.createDataFrame([(b,) for b in buckets], f"{bucket} string")
    # the total is one row
    out = every.join(base, bucket, "left").join(dom, bucket, "left").join(F.broadcast(total))
    n = F.coalesce("n", F.lit(0))
    return out.select(bucket, n.alias("n"), F.when(F.col("_total") > 0, n / F.col("_total")).otherwise(0.0).alias("share"), (2 * F.coalesce("_true", F.lit(0)) >= F.greatest(n, F.lit(1))).alias("majority"), "dominant")


def best_of_tiers(tiers: list[DataFrame], keys: list[str], score: str, tie: str, k: int = 3) -> DataFrame:
    """The k best rows per group of the first tier that has any."""
    every = None
    for t, df in enumerate(tiers):
        x = df.withColumn("tier", F.lit(t))
        every = x if every is None else every.unionByName(x)
    w = Window.partitionBy(*keys).orderBy("tier", F.desc(score), tie)
    first = F.min("tier").over(Window.partitionBy(*keys))
    return every.withColumn("rank", F.row_number().over(w)).withColumn("_t", first).filter((F.col("tier") == F.col("_t")) & (F.col("rank") <= k)).drop("_t")


def usage_summary(df: DataFrame, keys: list[str], hit: Column, user: Column) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count("*").alias("n"), F.count_if(hit).alias("hits"), F.count_if(user).alias("used"),
        (F.count_if(hit) / F.greatest(F.count("*"), F.lit(1))).alias("hit_rate"),
    )


def collapse_runs(df: DataFrame, keys: list[str], run: str, start: str, end: str, step: Column | float) -> DataFrame:
    """keys, run, start, end, frames."""
    return df.groupBy(*keys, run).agg(F.min(start).alias("start"), (F.max(end) + step).alias("end"), F.count("*").alias("frames"))


def never_present(df: DataFrame, keys: list[str], lack: str, order: str) -> DataFrame:
    """keys, never: what every step of the group lacks, in the first step's order."""
    steps = df.groupBy(*keys).agg(F.count("*").alias("_steps"))
    items = df.select(*keys, order, F.posexplode(F.array_distinct(lack)).alias("_p", "_item"))
    common = items.groupBy(*keys, "_item").agg(F.count("*").alias("_n"), F.min(F.struct(order, "_p")).alias("_o")).join(steps, keys).filter("_n = _steps")
    return common.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_o", "_item"))), lambda s: s["_item"]).alias("never"))


def summarize_runs(df: DataFrame, keys: list[str], run: str, start: str, end: str, step: Column | float, modes: dict[str, str], medians: dict[str, str], unions: dict[str, str], order: str) -> DataFrame:
    """collapse_runs() with, per run, first-seen modes, medians and ordered unions of columns (result: column).

    Modes and unions are counted by value first, so a run of any length is a few rows by the time it comes together.
    """
    g = [*keys, run]
    out = df.groupBy(*g).agg(F.min(start).alias("start"), (F.max(end) + step).alias("end"), F.count("*").alias("frames"), *[F.expr(f"percentile(`{c}`, 0.5)").alias(n) for n, c in medians.items()])
    for name, column in modes.items():
        out = out.join(mode_first_seen(df, g, column, order, name), g, "left")
    for name, column in unions.items():
        out = out.join(union_distinct(df, g, column, order, name), g, "left")
    return out


def segment_lists(df: DataFrame, keys: list[str], ids: str, item: Column, order: list[str]) -> DataFrame:
    """keys, ids (distinct, sorted), items (in order): what a segment holds."""
    rows = F.array_sort(F.collect_list(F.struct(*[F.col(c).alias(f"_o{k}") for k, c in enumerate(order)], item.alias("item"))))
    return df.groupBy(*keys).agg(F.array_sort(F.collect_set(ids)).alias("ids"), F.transform(rows, lambda r: r["item"]).alias("items"))


def assemble(df: DataFrame, keys: list[str], position: str, text: str, between: str = "\n") -> DataFrame:
    """keys, body, parts, complete: a segment's parts put together in order; complete if no position between the first and the last is missing."""
    rows = F.array_sort(F.collect_list(F.struct(position, text)))
    n = F.countDistinct(position)
    return df.groupBy(*keys).agg(F.array_join(F.transform(rows, lambda r: r[text]), between).alias("body"), F.count("*").alias("parts"), (n == F.max(position) - F.min(position) + 1).alias("complete"))


def assemble_pieces(df: DataFrame, keys: list[str], position: str, piece: str, kind: str, mode: str, error: str, label: str) -> DataFrame:
    """keys, pieces, mode, error, mixed: a segment's pieces in order, or what went wrong with any of them.

    One failed piece fails the segment: error tells label and error of each that failed, in order, and there are no pieces then. Pieces of several kinds make a mixed
    segment; else its mode is that of the first. A row without a piece (null) is a segment's own: a segment that has nothing else has no usable piece.
    """
    bad = F.col(piece).isNotNull() & (F.coalesce(F.col(error), F.lit("")) != "")
    rows = F.array_sort(F.collect_list(F.when(F.col(piece).isNotNull(), F.struct(position, F.col(piece).alias("p"), F.col(kind).alias("k"), F.col(mode).alias("m"), F.when(bad, F.concat_ws(" ", label, error)).alias("e")))))
    x = df.groupBy(*keys).agg(rows.alias("_r"), F.count_if(bad).alias("_bad"), F.count_distinct(F.when(F.col(piece).isNotNull(), F.col(kind))).alias("_kinds"))
    failed = F.when(F.size("_r") == 0, F.lit("这一段没有可用的片")).when(F.col("_bad") > 0, F.array_join(F.filter(F.transform("_r", lambda r: r["e"]), lambda e: e.isNotNull()), "；"))
    x = x.withColumn("error", failed)
    good = F.col("error").isNull()
    told = F.when(F.col("_kinds") > 1, "mix_user_ai").otherwise(F.try_element_at("_r", F.lit(1))["m"])
    return x.select(*keys, F.when(good, F.transform("_r", lambda r: r["p"])).alias("pieces"), F.when(good, told).alias("mode"), "error", F.when(good, F.col("_kinds") > 1).alias("mixed"))
