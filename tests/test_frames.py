"""Content boxes, fingerprint series and caption colours against plain Python."""

import colorsys
import random
from statistics import median

import numpy as np
from pyspark.sql import functions as F

from tessera.operators import frames as V
from tessera.operators.signals import median_cut

FRAMES = "source string, frame int, width int, height int, gray binary"


def area_mean(picture, y0, y1, x0, x1):
    """Mean of a rectangle with borders inside of pixels."""
    total = weight = 0.0
    for y in range(int(y0), min(int(np.ceil(y1)), len(picture))):
        for x in range(int(x0), min(int(np.ceil(x1)), len(picture[0]))):
            part = (min(y + 1, y1) - max(y, y0)) * (min(x + 1, x1) - max(x, x0))
            total, weight = total + part * picture[y][x], weight + part
    return total / weight


def brute_shrink(picture, h, w):
    a, b = len(picture) / h, len(picture[0]) / w
    return [[area_mean(picture, i * a, (i + 1) * a, j * b, (j + 1) * b) for j in range(w)] for i in range(h)]


def brute_span(levels):
    peak, runs, begin = max(levels), [], None
    if peak <= 0:
        return 0, len(levels)
    for i, x in enumerate([*levels, -1.0]):
        if x >= peak * 0.18 and begin is None:
            begin = i
        elif x < peak * 0.18 and begin is not None:
            runs.append((begin, i))
            begin = None
    longest = max(b - a for a, b in runs)
    return next((a, b - a) for a, b in runs if b - a == longest)


def pictures(seed=1):
    """Letterboxed with a title in the bar, pillarboxed, whole, black, and one with broken frames."""
    rng = np.random.default_rng(seed)
    out = []
    for source, n, (w, h), (x0, x1, y0, y1) in (("letter", 30, (36, 64), (0, 36, 20, 44)), ("pillar", 7, (64, 36), (16, 48, 0, 36)), ("whole", 1, (40, 30), (0, 40, 0, 30)), ("black", 3, (10, 10), (0, 0, 0, 0)), ("odd", 4, (37, 23), (3, 30, 2, 23))):
        for k in range(n):
            p = np.zeros((h, w), np.uint8)
            p[y0:y1, x0:x1] = rng.integers(60, 255, (y1 - y0, x1 - x0))
            if source == "letter":
                p[5:8] = 120
            out.append((source, k, w, h, bytearray(p.tobytes())))
    return [*out, ("broken", 0, 9, 9, bytearray(b"123")), ("broken", 1, 9, 9, None)]


def test_shrink_takes_means_of_areas():
    rng = np.random.default_rng(3)
    for h, w in ((8, 9), (17, 5), (64, 64), (3, 2)):
        p = rng.integers(0, 255, (13, 21)).astype(np.uint8)
        assert np.allclose(V.shrink(p, h, w), brute_shrink(p.tolist(), h, w))


def brute_boxes(rows):
    out = {}
    for source in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == source]
        n = max(r[1] for r in mine) + 1
        chosen = {k * n // 12 for k in range(12)}
        grids = [np.asarray(brute_shrink(np.frombuffer(bytes(g), np.uint8).reshape(h, w).tolist(), 64, 64)) for _, k, w, h, g in mine if k in chosen and g is not None and len(g) == w * h]
        if not grids:
            out[source] = (0.0, 0.0, 1.0, 1.0)
            continue
        mean = np.mean(grids, axis=0)
        (top, high), (left, wide) = brute_span(mean.mean(axis=1).tolist()), brute_span(mean.mean(axis=0).tolist())
        out[source] = (left / 64, top / 64, wide / 64, high / 64)
    return out


def brute_series(rows, boxes):
    inner = {s: (x + w * 0.08, y + h * 0.06, w * 0.84, h * 0.72) for s, (x, y, w, h) in boxes.items()}
    size = {r[0]: (r[2], r[3]) for r in rows}
    target = min(c[2] * size[s][0] / max(1e-6, c[3] * size[s][1]) for s, c in inner.items())
    out = {}
    for s, (x, y, w, h) in inner.items():
        vw, vh = size[s]
        now = w * vw / (h * vh)
        if now > target * 1.05:
            new = target * (h * vh) / vw
            x, w = x + (w - new) / 2, new
        elif now * 1.05 < target:
            new = w * vw / target / vh
            y, h = y + (h - new) / 2, new
        for _, k, _, _, g in (r for r in rows if r[0] == s):
            if g is None or len(g) != vw * vh:
                out[s, k] = None
                continue
            p = np.frombuffer(bytes(g), np.uint8).reshape(vh, vw)[int(vh * y) : int(vh * y) + int(vh * h), int(vw * x) : int(vw * x) + int(vw * w)]
            grid = np.rint(np.round(brute_shrink(p.tolist(), 8, 9), 9)) if p.size else None
            bits = 0
            for i in range(8):
                for j in range(8):
                    bits = bits * 2 + int(grid[i][j + 1] > grid[i][j])
            out[s, k] = bits - (1 << 64 if bits >> 63 else 0)
    return out


def test_series_equal_brute_force_and_grow(spark, tmp_path):
    rows = pictures()
    boxes = brute_boxes(rows)
    frames = spark.createDataFrame(rows, FRAMES)
    got = {r["source"]: tuple(r["box"]) for r in V.content_boxes(frames).collect()}
    assert got == boxes and boxes["letter"][1] > 0.25 and boxes["black"] == (0.0, 0.0, 1.0, 1.0)
    sources = spark.createDataFrame([(s, 1, 2) for s in boxes], "source string, size int, modified int")
    want = brute_series(rows, boxes)
    plain = V.fingerprint_series(frames, sources, 4.0).collect()
    assert {(r["source"], r["pos"]): r["bits"] for r in plain} == want
    assert all(r["t"] == r["pos"] / 4 for r in plain)
    # a store: the second call decodes nothing, a changed source is hashed anew
    store = f"file://{tmp_path}/store"
    first = V.fingerprint_series(frames, sources, 4.0, store=store)
    assert {(r["source"], r["pos"]): r["bits"] for r in first.collect()} == want
    again = V.fingerprint_series(frames.limit(0), sources, 4.0, store=store)
    assert {(r["source"], r["pos"]): r["bits"] for r in again.collect()} == want
    n = spark.read.parquet(f"{store}/series").count()
    changed = sources.withColumn("modified", F.when(F.col("source") == "odd", 3).otherwise(F.col("modified")))
    assert V.fingerprint_series(frames, changed, 4.0, store=store).count() == len(rows)
    assert spark.read.parquet(f"{store}/series").count() == n + 4


def hls(c):
    return colorsys.rgb_to_hls(*(int(c[i : i + 2], 16) / 255 for i in (1, 3, 5)))


def far(a, b):
    d = abs(a - b) % 1.0
    return min(d, 1 - d)


def brute_pick(clusters, hint):
    cands = [c for c in clusters if c[1] >= 0.04] or clusters[:1]
    if not cands:
        return None, None, 0.0
    vivid = [c for c in cands if hls(c[0])[2] >= 0.55 and 0.18 <= hls(c[0])[1] <= 0.85]
    if hint and hls(hint)[2] <= 0.18 and hls(hint)[1] >= 0.6:
        fill = max(vivid, key=lambda c: hls(c[0])[2] * 0.55 + c[1] * 0.45) if vivid else max(cands, key=lambda c: hls(c[0])[1] * (1 - hls(c[0])[2]))
    elif hint:
        like = [c for c in cands if far(hls(c[0])[0], hls(hint)[0]) <= 0.12 and hls(c[0])[2] >= 0.25]
        fill = max(like or vivid or cands, key=lambda c: hls(c[0])[2] * 0.6 + c[1] * 0.4)
    else:
        fill = max(vivid or cands, key=lambda c: (hls(c[0])[2], c[1]))
    rest = [c for c in clusters if c[1] >= 0.04]
    dark = [c for c in rest if hls(c[0])[1] < hls(fill[0])[1] - 0.12]
    outline = min(dark or rest, key=lambda c: hls(c[0])[1])[0] if rest else None
    sure = min(1.0, fill[1] * 2.2)
    if hint and hls(hint)[2] > 0.18 and hls(fill[0])[2] > 0.25 and far(hls(hint)[0], hls(fill[0])[0]) > 0.12:
        sure *= 0.5
    return fill[0].upper(), outline and outline.upper(), round(sure, 3)


def test_caption_colours_equal_brute_force(spark):
    rng = random.Random(5)
    rows = []
    for k in range(60):
        colours = [bytes(rng.randrange(256) for _ in range(3)) for _ in range(rng.randrange(1, 6))]
        flat = [rng.choice(colours) for _ in range(24 * 16)]
        hint = rng.choice([None, "#ffffff", "#eeeeee", "#ff2010", "#102080", "#202020"])
        rows += [(k, bytearray(b"".join(flat)), hint) for _ in range(rng.randrange(1, 4))]
    rows += [(100, None, "#ffffff"), (101, bytearray(b""), None)]
    got = {r["cap"]: r for r in V.calibrated_colors(spark.createDataFrame(rows, "cap int, pixels binary, hint string"), ["cap"]).collect()}
    for k in {r[0] for r in rows}:
        picked = [brute_pick(median_cut(np.frombuffer(bytes(p or b""), np.uint8).reshape(-1, 3)), h) for c, p, h in rows if c == k]
        mid = lambda cs: None if not cs else "#" + "".join("%02X" % round(median(int(c[i : i + 2], 16) for c in cs)) for i in (1, 3, 5))
        fills, lines = [p[0] for p in picked if p[0]], [p[1] for p in picked if p[1]]
        sure = round(sum(p[2] for p in picked if p[0]) / len(fills), 3) if fills else 0.0
        assert (got[k]["fill"], got[k]["outline"]) == (mid(fills), mid(lines)) and abs(got[k]["confidence"] - sure) < 2e-3
    assert got[100]["trusted"] is False and any(r["trusted"] for r in got.values())


def test_pictures_are_decoded_for_boxes_once(spark):
    """Without a store, the plan of the series holds one pass over the pictures for fingerprints, and none for boxes."""
    frames = spark.createDataFrame(pictures(), FRAMES)
    sources = frames.select("source").distinct().select("source", F.lit(1).alias("size"), F.lit(1).alias("modified"))
    plan = V.fingerprint_series(frames, sources, 4.0)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_hues_at_the_limit_of_likeness_fall_as_in_sql(spark):
    df = spark.createDataFrame([([("#c8abce", 0.5), ("#31939a", 0.25), ("#fd09ff", 0.25)], "#1939af")], "clusters array<struct<color:string,share:double>>, hint string")
    got = V.pick_colors(df, "clusters", "hint").first()
    assert (got["fill"], got["outline"], got["confidence"]) == ("#FD09FF", "#31939A", 0.275)


def test_caption_pixels_leave_the_rim_out(spark):
    whole = bytes(range(256)) * 3  # 16 x 16
    rows = [(1, bytearray(whole), 16, 16, (0.0, 0.0, 1.0, 1.0)), (2, bytearray(whole), 16, 16, (0.4, 0.4, 0.5, 0.5)), (3, None, 16, 16, (0.0, 0.0, 1.0, 1.0)), (4, bytearray(whole), 9, 9, (0.0, 0.0, 1.0, 1.0))]
    x = spark.createDataFrame(rows, "k int, p binary, w int, h int, b struct<x0:double,y0:double,x1:double,y1:double>")
    got = {r["k"]: r["c"] for r in x.select("k", V.caption_pixels(F.col("p"), F.col("w"), F.col("h"), F.col("b")).alias("c")).collect()}
    cube = np.frombuffer(whole, np.uint8).reshape(16, 16, 3)
    assert bytes(got[1]) == cube[2:14, 2:14].tobytes() and got[2] is None and got[3] is None and got[4] is None
