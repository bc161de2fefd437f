import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import signals as G


def test_difference_hash():
    up = bytes(range(9)) * 8
    assert G.difference_hash(up) == -1 and G.difference_hash(bytes(reversed(range(9))) * 8) == 0
    assert G.difference_hash(b"x") is None and G.difference_hash(None) is None


def test_flatness_tells_noise_from_a_tone():
    rng = np.random.default_rng(0)
    t = np.arange(16000) / 16000
    assert G.flatness_median(np.sin(2 * np.pi * 440 * t)) < 0.05 < 0.35 < G.flatness_median(rng.normal(0, 0.3, 16000))
    assert G.flatness_median(np.zeros(100)) is None and G.flatness_median(np.zeros(5000)) == 1.0


def test_columns(spark):
    red, blue = bytes([255, 0, 0]), bytes([0, 0, 255])
    df = spark.createDataFrame([(red * 30 + blue * 10, [0.1] * 10, bytes(range(9)) * 8)], "p binary, s array<double>, g binary")
    r = df.select(G.color_clusters(F.col("p")).alias("c"), G.level_db(F.col("s")).alias("db"), G.frame_hash(F.col("g")).alias("h"), G.spectral_flatness(F.col("s")).alias("f")).first()
    assert sum(c.share for c in r.c) == pytest.approx(1.0) and r.c[0].color == "#ff0000"
    assert r.db == pytest.approx(-20.0) and r.h == -1 and r.f is None


def test_grid(spark):
    df = spark.createDataFrame([(1.0, [0.25, 0.5, 7.0])], "d double, x array<double>")
    assert [r.t for r in G.sample_grid(df, "d", 2.0, "x").collect()] == [0.0, 0.25, 0.5]


def test_source_choice(spark):
    rows = [(1, "a", True, 8.0, True), (1, "b", False, 3.0, True), (2, "a", True, 5.0, True), (2, "b", False, 0.0, True), (3, "b", False, 1.0, False)]
    df = spark.createDataFrame(rows, "shot int, src string, windowed boolean, mean_dist double, hit boolean")
    assert {r.shot: r.src for r in G.best_source(df, "shot").collect()} == {1: "b", 2: "a", 3: "b"}


def test_gaps_and_cuts(spark):
    df = spark.createDataFrame([(1, 1, 2, 5), (1, 2, 6, 8)], "g int, o int, start int, end int").withColumn("total", F.lit(10))
    got = sorted((r.start, r.end) for r in G.fill_gaps(df, ["g"], "o", "total").filter("filled").collect())
    assert got == [(0, 2), (5, 6), (8, 10)]
    cut = spark.createDataFrame([(4, [3, 5]), (9, [])], "at int, cuts array<int>")
    assert [r["at"] for r in G.snap_to_cuts(cut, "cuts", "at").collect()] == [3, 9]


def test_windows_and_cascade(spark):
    df = spark.createDataFrame([(1, 0.0, 100.0), (2, 5.0, None), (3, 9.0, 110.0)], "o int, start double, placed double").withColumn("k", F.lit(1))
    r = G.neighbour_window(df, ["k"], "o", "placed", "start").filter("o = 2").first()
    assert (r.lo, r.hi) == (97.0, 114.0)
    c = df.select(G.cascade(("hash", F.col("placed")), ("speech", F.when(F.col("o") == 2, F.lit(1.0))))["locator"]).collect()
    assert [x[0] for x in c] == ["hash", "speech", "hash"]
    a = spark.createDataFrame([(1, []), (2, [1]), (3, [9])], "id int, shots array<int>")
    assert {r.id for r in G.relevant(a, F.array(F.lit(1), F.lit(2))).collect()} == {1, 2}
