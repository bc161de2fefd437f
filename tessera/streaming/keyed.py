"""Streaming forms: gap sessions that are given out when they are over, and the keyed window allocator with its state in maps."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Fixed value: seconds that are always taken of a source.
LEAST_TAKE = 0.4
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def map_state(spark: SparkSession) -> Iterator[None]:
    """Streams started within keep their state in RocksDB, which map states and expiry need; the session's own setting comes back after it."""
    was = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, was)


def session_windows(events: DataFrame, key: str, t: str, gap: str, late: str) -> DataFrame:
    """Sessions of events at most gap apart, with data up to ``late`` behind the newest. In append mode each comes out once, when the watermark has passed its end, and its state goes."""
    s = F.session_window(F.col(t), gap)
    return events.withWatermark(t, late).groupBy(key, s.alias("s")).agg(F.count("*").alias("n")).select(key, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


class Allocator(StatefulProcessor):
    """One source's cursor and what each key was granted. Rows of a micro-batch are taken in order; a grant that is not asked for again expires with its time to live."""

    def __init__(self, key: str, need: str, order: str, total: float, kind: str, keep_ms: int | None):
        self.key, self.need, self.order, self.total, self.kind, self.keep_ms = key, need, order, max(LEAST_TAKE, total), kind, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.cursor = handle.getValueState("cursor", "upto double")
        self.granted = handle.getMapState("granted", f"k {self.kind}", "at double", ttlDurationMs=self.keep_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        begun = self.cursor.exists()
        upto = self.cursor.get()[0] if begun else 0.0
        calls = pd.concat(list(rows)).sort_values(self.order, kind="stable")
        out, granted, asked = [], {}, set()  # of the keys of this batch: each is read once and written once
        for name, want in zip(calls[self.key].tolist(), calls[self.need].tolist(), strict=True):
            if name not in granted and begun and self.granted.containsKey((name,)):
                granted[name] = self.granted.getValue((name,))[0]
            known = name in granted
            room = self.total - upto >= min(want, 1.0)
            at = granted.setdefault(name, upto if room else 0.0)
            if not known or self.keep_ms:
                asked.add(name)
            take = max(LEAST_TAKE, min(want, self.total - at))
            out.append((key[0], name, at, take, not known and not room and upto > 0))
            upto = max(upto, at + take)
        for name in asked:
            self.granted.updateValue((name,), (granted[name],))
        self.cursor.update((upto,))
        yield pd.DataFrame(out)

    def close(self) -> None:
        pass


def stream_allocator(calls: DataFrame, source: str, key: str, need: str, order: str, total: float, keep_ms: int | None = None) -> DataFrame:
    """source, key, offset, take, wrapped: the allocator of tessera.operators.sequences over a stream.

    The state of a source is its cursor and a map of grants, row by row in the state store, so a call reads and writes its own key alone. It
    goes on from micro-batch to micro-batch and over restarts. keep_ms lets grants expire that were not asked for so long. Start it within map_state().
    """
    kinds = {f.name: f.dataType.simpleString() for f in calls.schema}
    schema = f"{source} {kinds[source]}, {key} {kinds[key]}, offset double, take double, wrapped boolean"
    return calls.groupBy(source).transformWithStateInPandas(Allocator(key, need, order, total, kinds[key], keep_ms), schema, "append", "ProcessingTime" if keep_ms else "None")
