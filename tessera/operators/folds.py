"""Folds over ordered rows of a key, in blocks whose carried states settle.

A key's rows are folded left to right with a small state. A key may hold any share of all rows, so the rows are cut into
blocks by range of (keys, order), one task each. Which state a block begins with depends on the block before; all blocks of
a key run at once, first from the empty state, and those whose beginning turned out another run again, until none does. States
that forget (an open line, the last place in a source) settle after a round or two; at worst a round settles one block more.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.plans.tables import written

#: (rows of a block in order, state or None at a key's first row) -> (result, state). The state must be JSON.
Step = Callable[[pd.DataFrame, object], tuple[pd.DataFrame, object]]


def _meet(left: DataFrame, right: DataFrame, names: list[str], how: str, take: list[str]) -> DataFrame:
    """left joined with right where names are equal, null being equal to null; with the columns ``take`` of right."""
    on = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in names]
    return left.alias("l").join(right.alias("r"), on, how).select("l.*", *[F.col(f"r.{c}") for c in take])


def fold_in_blocks(df: DataFrame, keys: list[str], order: list[str], step: Step, results: str, block_rows: int = 200_000, many: Callable[[DataFrame], DataFrame] | None = None, ready: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """step's result, with the schema ``results``, over all rows of df: each key's rows in order, from its first to its last.

    Keys of up to block_rows rows are folded as they are, and only larger ones in blocks. Rows with equal (keys, order) lie in one block. Null keys are a key. An empty table gives an empty one.
    ``many`` gives the results of rows of any number of such smaller keys, where there is a quicker way than a key at a time; ``ready`` adds to the rows of larger ones what step needs.
    """
    own = [f"_key{i}" for i in range(len(keys))]
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}

    def ordered(pdf: pd.DataFrame) -> tuple[pd.DataFrame, object]:
        state = json.loads(pdf["_state"].iloc[0]) if "_state" in pdf and pdf["_state"].iloc[0] else None
        rows = pdf.sort_values(order, kind="stable", ignore_index=True)
        return step(rows.drop(columns=["_state", "_block", *own], errors="ignore"), state)

    def result(pdf: pd.DataFrame) -> pd.DataFrame:
        return ordered(pdf)[0]

    def ending(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf[[*own, "_block"]].head(1).assign(_end=json.dumps(ordered(pdf)[1]))

    sizes = df.groupBy(*keys).agg(F.count("*").alias("_size")).filter(F.col("_size") > block_rows)
    large = written(sizes.select(*[F.col(k).alias(o) for k, o in zip(keys, own, strict=True)], "_size"))  # one key for each block_rows rows at most
    blocks = math.ceil((large.agg(F.sum("_size")).first()[0] or 0) / block_rows)
    many = many or (lambda rows: rows.groupBy(*keys).applyInPandas(result, results))
    if not blocks:
        return many(df)
    mine = df.withColumns(dict(zip(own, map(F.col, keys), strict=True)))
    small = many(_meet(mine, F.broadcast(large), own, "left_anti", []).drop(*own))
    df = ready(_meet(mine, F.broadcast(large), own, "left_semi", []).drop(*own))
    cut = df.repartitionByRange(blocks, *keys, *order).withColumn("_block", F.spark_partition_id())
    cut = written(cut.withColumns(dict(zip(own, map(F.col, keys), strict=True))))
    mine = Window.partitionBy(*own)
    pieces = cut.select(*own, "_block").distinct()
    pieces = pieces.select(*own, "_block", F.count("*").over(mine).alias("_n"), F.row_number().over(mine.orderBy("_block")).alias("_no"))
    pieces = written(pieces.filter("_n > 1").drop("_n"))  # of keys that go on from block to block: two for each block at most
    piece = [*own, "_block"]
    states = todo = written(pieces.withColumn("_state", F.lit(None).cast("string")))
    ends, ended = None, ", ".join(f"{o} {kinds[k]}" for o, k in zip(own, keys, strict=True)) + ", _block int, _end string"
    while not todo.isEmpty():
        ran = _meet(cut, todo, piece, "inner", ["_state"]).groupBy(*piece).applyInPandas(ending, ended)
        ends = written(ran if ends is None else _meet(ends, todo, piece, "left_anti", []).unionByName(ran))
        before = _meet(pieces, ends, piece, "inner", ["_end"]).select(*own, (F.col("_no") + 1).alias("_no"), "_end")
        new = written(_meet(states.drop("_state"), before, [*own, "_no"], "left", ["_end"]).withColumnRenamed("_end", "_state"))
        was = states.select(*piece, F.col("_state").alias("_was"))
        todo = written(_meet(new, was, piece, "inner", ["_was"]).filter(~F.col("_state").eqNullSafe(F.col("_was"))).drop("_was"))
        states = new
    return small.unionByName(_meet(cut, states, piece, "left", ["_state"]).groupBy(*piece).applyInPandas(result, results))
