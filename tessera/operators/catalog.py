"""Content catalogs: prioritised unions, hidden sets, lookups and caches by fingerprint."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_source_wins(sources: list[DataFrame], digest: str, order: str) -> DataFrame:
    """Union of sources in order of priority; of equal digests the earliest source's earliest row stays."""
    every = None
    for k, df in enumerate(sources):
        x = df.withColumn("priority", F.lit(k))
        every = x if every is None else every.unionByName(x, allowMissingColumns=True)
    return first_by_digest(every, digest, ["priority", order])


def first_by_digest(df: DataFrame, digest: str, order: list[str]) -> DataFrame:
    """One row per digest, the first by order; rows without a digest all stay.

    An aggregation and not a window, so copies are dropped before they are shuffled.
    """
    cols = [c for c in df.columns if c not in order]
    known = df.filter(F.col(digest).isNotNull())
    best = known.groupBy(F.col(digest).alias("_d")).agg(F.min(F.struct(*order, *cols)).alias("_r")).select("_r.*").select(*df.columns)
    return best.unionByName(df.filter(F.col(digest).isNull()))


def not_hidden(df: DataFrame, hidden: DataFrame, path: str, digest: str) -> DataFrame:
    """Rows that are hidden neither by path nor by digest."""
    by_path = hidden.filter(F.col(path).isNotNull()).select(path).distinct()
    by_digest = hidden.filter(F.col(digest).isNotNull()).select(digest).distinct()
    return df.join(by_path, path, "left_anti").join(by_digest, digest, "left_anti")


def lookup_digest(df: DataFrame, wanted: DataFrame, content: str, size: str, digest: str) -> DataFrame:
    """Rows whose content is wanted: sizes are compared first, and only those rows are hashed."""
    sizes = wanted.select(F.col(size)).distinct()
    near = df.join(sizes, size, "left_semi").withColumn(digest, F.md5(content))
    return near.join(wanted.select(size, digest).distinct(), [size, digest], "left_semi")


def cache_misses(df: DataFrame, cache: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that the cache does not hold under the same key, fingerprint and version."""
    return df.join(cache.select(*keys).distinct(), keys, "left_anti")


def casefold_groups(df: DataFrame, name: str, description: str, item: str, order: str) -> DataFrame:
    """name, description, n, items: names that differ in case are one group; the first name and filled description stay."""
    key = F.lower(F.trim(name))
    filled = F.nullif(F.col(description), F.lit(""))
    g = df.groupBy(key.alias("group_key")).agg(F.min_by(name, order).alias("name"), F.min(F.when(filled.isNotNull(), F.struct(F.col(order), filled.alias("d")))).alias("_d"), F.count("*").alias("n"), F.array_sort(F.collect_set(item)).alias("items"))
    return g.select("group_key", "name", F.col("_d.d").alias("description"), "n", "items")


def unique_names(df: DataFrame, name: str, order: str, out: str = "unique_name") -> DataFrame:
    """name, name_2, name_3 in order."""
    k = F.row_number().over(Window.partitionBy(name).orderBy(order))
    return df.withColumn("_k", k).withColumn(out, F.when(F.col("_k") == 1, F.col(name)).otherwise(F.concat_ws("_", name, "_k"))).drop("_k")


def head_tail_fingerprint(content: Column, edge: int = 1 << 20) -> Column:
    """Size and the first and last bytes, hashed."""
    return F.md5(F.concat(F.octet_length(content).cast("string").cast("binary"), F.substring(content, 1, edge), F.substring(content, -edge, edge)))


def merge_urls(df: DataFrame, keys: list[str], url: str, order: str, most: int = 9) -> DataFrame:
    """keys, urls: the first so many distinct URLs in order; repeats collapse before they are collected."""
    first = df.groupBy(*keys, url).agg(F.min(order).alias("_o"))
    w = Window.partitionBy(*keys).orderBy("_o", url)
    top = first.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= most)
    return top.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_o", url))), lambda s: s[url]).alias("urls"))


def url_labels(df: DataFrame, labels: DataFrame, url: str, label: str, order: str) -> DataFrame:
    """df with the label of its URL, compared without query strings; of several labels the first by order."""
    key = F.substring_index(url, "?", 1)
    index = labels.groupBy(key.alias("_u")).agg(F.min_by(label, order).alias(label))
    return df.withColumn("_u", key).join(index, "_u", "left").drop("_u")
