"""Fingerprint series of videos from their decoded grey frames, and colours of captions in their pixels.

Frames come as rows (source, frame, width, height, gray), gray being the bytes of all rows of pixels. Only the resampling of a picture is Python; boxes,
crops, choices and what is new are column expressions and joins.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from tessera.functions import scalars as S
from tessera.operators.signals import color_clusters

#: How many frames show where the content is, the grid they are reduced to, and the share of the brightest row or column below which one is a bar.
BOX_FRAMES, BOX_GRID, BAR = 12, 64, 0.18
#: Shares of the content that are left out for captions and marks: at each side, at the top and at the bottom.
SIDE, TOP, BOTTOM = 0.08, 0.06, 0.22
#: A fingerprint's grid, and how far aspects may differ unchanged.
HASH_WIDTH, HASH_HEIGHT, SAME_ASPECT = 9, 8, 1.05
#: Fixed values of caption colours: the least share of a colour, the largest difference of hues that are alike, and what is white and what vivid (of the HLS model).
LEAST_SHARE, LIKE_HUE, WHITE_SATURATION, WHITE_LIGHT, VIVID, VIVID_LIGHT = 0.04, 0.12, 0.18, 0.60, 0.55, (0.18, 0.85)
#: Fixed value: how much of a caption's box is left out at each side.
INSET = 0.12


def shrink(picture: np.ndarray, height: int, width: int) -> np.ndarray:
    """Means of the areas that a grid of height x width cuts a picture into, along one axis after the other; pixels on a border count in part."""
    out = picture.astype(np.float64)
    for axis, n in ((0, height), (1, width)):
        out = np.moveaxis(out, axis, 0)
        upto = np.concatenate([np.zeros((1, out.shape[1])), np.cumsum(out, axis=0)])
        at = np.linspace(0, out.shape[0], n + 1)
        low = np.minimum(at.astype(int), out.shape[0] - 1)
        until = upto[low] + (at - low)[:, None] * out[low]
        out = np.moveaxis(np.diff(until, axis=0) / (out.shape[0] / n), 0, axis)
    return out


def _picture(gray: bytes | None, width: int, height: int) -> np.ndarray | None:
    return np.frombuffer(gray, np.uint8).reshape(height, width) if gray is not None and width > 0 and height > 0 and len(gray) == width * height else None


def _longest_bright(levels: Column) -> Column:
    """struct<at, n>: the longest run of levels that are no bar (the first of equally long ones); everything in the dark."""
    peak = F.array_max(levels)
    # the limit goes along, or it would be found anew at each level
    none = F.struct(F.lit(0).alias("i"), F.lit(0).alias("run"), F.lit(0).alias("at"), F.lit(0).alias("n"), (peak * BAR).alias("least"))

    def step(a: Column, x: Column) -> Column:
        run = F.when(x >= a["least"], a["run"] + 1).otherwise(F.lit(0))
        longer = run > a["n"]
        return F.struct((a["i"] + 1).alias("i"), run.alias("run"), F.when(longer, a["i"] + 1 - run).otherwise(a["at"]).alias("at"), F.when(longer, run).otherwise(a["n"]).alias("n"), a["least"].alias("least"))

    found = F.aggregate(levels, none, step, lambda a: F.struct(a["at"].alias("at"), a["n"].alias("n")))
    return F.when(peak <= 0, F.struct(F.lit(0).alias("at"), F.size(levels).alias("n"))).otherwise(found)


def _mean_of(profiles: str, part: str) -> Column:
    """array<double>: level by level the mean of one part of all profiles."""
    total = F.aggregate(profiles, F.array_repeat(F.lit(0.0), BOX_GRID), lambda a, p: F.zip_with(a, p[part], lambda x, y: x + y))
    return F.transform(total, lambda x: x / F.size(profiles))


def content_boxes(frames: DataFrame) -> DataFrame:
    """source, width, height, box (x, y, w, h as shares): the part of the picture without bars, from the mean brightness of rows and columns of a few frames.

    A title or a line of small print in a bar is cut off with it, as the longest bright stretch counts. A source of which no frame is whole has the whole
    picture. Frames are numbered from 0.
    """
    n = frames.groupBy("source").agg((F.max("frame") + 1).alias("_n"))
    chosen = frames.join(n, "source").filter(F.ceil(F.col("frame") * BOX_FRAMES / F.col("_n")) * F.col("_n") < (F.col("frame") + 1) * BOX_FRAMES)

    @F.pandas_udf("struct<rows:array<double>,cols:array<double>>")
    def profile(gray: pd.Series, width: pd.Series, height: pd.Series) -> pd.DataFrame:
        out = []
        for g, w, h in zip(gray, width, height, strict=True):
            picture = _picture(g, w, h)
            small = None if picture is None else shrink(picture, BOX_GRID, BOX_GRID)
            out.append((None, None) if small is None else (small.mean(axis=1), small.mean(axis=0)))
        return pd.DataFrame(out, columns=["rows", "cols"])

    p = chosen.select("source", "frame", "width", "height", profile("gray", "width", "height").alias("p"))
    size = p.groupBy("source").agg(F.first("width").alias("width"), F.first("height").alias("height"))
    # a source has few chosen frames, so their profiles come together as they are, not level by level
    whole = p.filter("p.rows is not null").groupBy("source").agg(F.array_sort(F.collect_list(F.struct("frame", "p.rows", "p.cols"))).alias("_p"))
    levels = whole.select("source", _mean_of("_p", "rows").alias("row"), _mean_of("_p", "cols").alias("col"))
    spans = levels.select("source", _longest_bright(F.col("row")).alias("r"), _longest_bright(F.col("col")).alias("c"))
    share = lambda c, whole: F.coalesce(c / BOX_GRID, F.lit(float(whole)))
    box = F.struct(share(F.col("c.at"), 0).alias("x"), share(F.col("r.at"), 0).alias("y"), share(F.col("c.n"), 1).alias("w"), share(F.col("r.n"), 1).alias("h"))
    return size.join(spans, "source", "left").select("source", "width", "height", box.alias("box"))


def _inner(box: Column) -> Column:
    return F.struct((box["x"] + box["w"] * SIDE).alias("x"), (box["y"] + box["h"] * TOP).alias("y"), (box["w"] * (1 - 2 * SIDE)).alias("w"), (box["h"] * (1 - TOP - BOTTOM)).alias("h"))


def aspect(boxes: DataFrame) -> Column:
    """Width to height of what is compared of a source, in pixels."""
    c = _inner(F.col("box"))
    return c["w"] * F.col("width") / F.greatest(F.lit(1e-6), c["h"] * F.col("height"))


def crops(boxes: DataFrame, target: Column | None = None) -> DataFrame:
    """boxes with crop: the box without its margins, its middle cut to the aspect ``target`` where it differs."""
    c, w, h = _inner(F.col("box")), F.col("width"), F.col("height")
    if target is None:
        return boxes.withColumn("crop", c)
    wide, high = c["w"] * w, c["h"] * h
    narrow = target * high / w
    low = wide / target / h
    usable = (wide > 0) & (high > 0) & (target > 0)
    cut = (
        F.when(usable & (wide / high > target * SAME_ASPECT), F.struct((c["x"] + (c["w"] - narrow) / 2).alias("x"), c["y"].alias("y"), narrow.alias("w"), c["h"].alias("h")))
        .when(usable & (wide / high * SAME_ASPECT < target), F.struct(c["x"].alias("x"), (c["y"] + (c["h"] - low) / 2).alias("y"), c["w"].alias("w"), low.alias("h")))
        .otherwise(c)
    )
    return boxes.withColumn("crop", cut)


def crop_hash(gray: Column, width: Column, height: Column, crop: Column) -> Column:
    """64 bits of the cropped picture on the fingerprint's grid: each area against its left neighbour, row by row; null for a picture that isn't whole or an empty crop."""

    @F.pandas_udf(LongType())
    def run(g: pd.Series, w: pd.Series, h: pd.Series, c: pd.DataFrame) -> pd.Series:
        out = []
        for pixels, x, y, (left, top, wide, high) in zip(g, w, h, zip(c["x"], c["y"], c["w"], c["h"], strict=True), strict=True):
            picture = _picture(pixels, x, y)
            part = None if picture is None else picture[int(y * top) : int(y * top) + int(y * high), int(x * left) : int(x * left) + int(x * wide)]
            if part is None or not part.size:
                out.append(None)
                continue
            grid = np.rint(shrink(part, HASH_HEIGHT, HASH_WIDTH))
            out.append(int(np.packbits(grid[:, 1:] > grid[:, :-1]).view(">i8")[0]))
        return pd.Series(out, dtype="Int64")

    return run(gray, width, height, crop)


def _stored(spark: SparkSession, path: str | None) -> DataFrame | None:
    """The Parquet table at a path, or None before its first row is written."""
    if path is None:
        return None
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return spark.read.parquet(path) if place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place) else None


def fingerprint_series(frames: DataFrame, sources: DataFrame, fps: float, one_aspect: bool = True, store: str | None = None) -> DataFrame:
    """source, pos, t, bits: the fingerprint of each frame, over the content that all sources have in common.

    sources: source, size, modified. With a store (a folder), boxes and series are kept there, under what they depend on: the source's name, size and time, and for a series
    the frames a second and the crop. Only frames of sources that aren't in the store are decoded again, and what was found is added to it. With one_aspect all
    sources are cut to the narrowest aspect among them.
    """
    from tessera.plans.tables import written

    spark = frames.sparkSession
    file = F.concat_ws("-", "source", F.col("size").cast("string"), F.col("modified").cast("string"))
    sources = sources.select("source", file.alias("file"))
    boxes = _stored(spark, store and f"{store}/boxes")
    wanted = sources if boxes is None else sources.join(boxes.select("file"), "file", "left_anti")
    new = content_boxes(frames.join(wanted.select("source"), "source", "left_semi")).join(wanted, "source")
    if store:
        new.select("file", "width", "height", "box").write.mode("append").parquet(f"{store}/boxes")
        new = spark.read.parquet(f"{store}/boxes")
        boxes = sources.join(new, "file")
    else:
        boxes = written(new)  # it is read several times, and each would decode all pictures again
    target = boxes.agg(F.min(aspect(boxes)).alias("_t"))  # one row
    boxes = crops(boxes.crossJoin(F.broadcast(target)), F.col("_t")) if one_aspect else crops(boxes)
    shown = F.concat_ws("-", *[F.format_string("%.4f", F.col(f"crop.{c}")) for c in "xywh"])
    boxes = boxes.select("source", "crop", F.concat_ws("-", "file", F.lit(f"{fps:.2f}"), F.lit(f"{HASH_WIDTH}-{HASH_HEIGHT}"), shown).alias("series"))
    known = _stored(spark, store and f"{store}/series")
    todo = boxes if known is None else boxes.join(known.select("series").distinct(), "series", "left_anti")
    hashed = frames.join(todo, "source").select("series", F.col("frame").alias("pos"), crop_hash(F.col("gray"), F.col("width"), F.col("height"), F.col("crop")).alias("bits"))
    if store:
        hashed.write.mode("append").parquet(f"{store}/series")
        hashed = spark.read.parquet(f"{store}/series")
    return hashed.join(boxes.select("series", "source"), "series").select("source", "pos", (F.col("pos") / fps).alias("t"), "bits")


def _light(color: Column) -> Column:
    r, g, b = (c / 255.0 for c in S.hex_channels(color))
    return (F.greatest(r, g, b) + F.least(r, g, b)) / 2


def pick_colors(df: DataFrame, clusters: str, hint: str) -> DataFrame:
    """df with fill, outline and confidence of a caption, from its clusters (array<struct<color, share>>, largest first) and a guess at its fill colour (or null).

    Colours with too small a share don't count. A white guess gives way to a vivid colour, and is else the lightest and greyest; a coloured guess asks for its own hue; without a
    guess the most saturated of the vivid colours, or of all. The outline is the darkest of those clearly darker than the fill, or of all. Confidence is 2.2 times the
    fill's share, 1 at most, and half of it where guess and fill are coloured and their hues differ. Of equals the first counts.
    """
    first = lambda *pools: F.coalesce(*[F.when(F.size(p) > 0, F.col(p)) for p in pools])
    best = lambda pool, *score: F.array_max(F.transform(pool, lambda c: F.struct(*[s(c).alias(f"s{k}") for k, s in enumerate(score)], c["no"].alias("no"), c.alias("c"))))["c"]
    guess = F.col(hint)
    facts = F.transform(clusters, lambda c, i: F.struct(c["color"].alias("color"), c["share"].alias("share"), S.hue(c["color"]).alias("hue"), S.saturation(c["color"]).alias("sat"), _light(c["color"]).alias("light"), (-i).alias("no")))
    x = df.select("*", facts.alias("_facts"), F.struct(S.hue(guess).alias("hue"), S.saturation(guess).alias("sat"), _light(guess).alias("light")).alias("_hint"))
    x = x.withColumn("_enough", F.filter("_facts", lambda c: c["share"] >= LEAST_SHARE))
    x = x.withColumn("_cands", F.when(F.size("_enough") > 0, F.col("_enough")).otherwise(F.slice("_facts", 1, 1)))
    vivid = F.filter("_cands", lambda c: (c["sat"] >= VIVID) & (c["light"] >= VIVID_LIGHT[0]) & (c["light"] <= VIVID_LIGHT[1]))
    like = F.filter("_cands", lambda c: (S.hue_distance(c["hue"], F.col("_hint.hue")) <= LIKE_HUE) & (c["sat"] >= 0.25))
    x = x.withColumns({"_vivid": vivid, "_like": like})
    white = (F.col("_hint.sat") <= WHITE_SATURATION) & (F.col("_hint.light") >= WHITE_LIGHT)
    fill = (
        F.when(guess.isNull(), best(first("_vivid", "_cands"), lambda c: c["sat"], lambda c: c["share"]))
        .when(white & (F.size("_vivid") > 0), best(F.col("_vivid"), lambda c: c["sat"] * 0.55 + c["share"] * 0.45))
        .when(white, best(F.col("_cands"), lambda c: c["light"] * (1.0 - c["sat"])))
        .otherwise(best(first("_like", "_vivid", "_cands"), lambda c: c["sat"] * 0.6 + c["share"] * 0.4))
    )
    x = x.withColumn("_fill", fill)
    x = x.withColumn("_darker", F.filter("_enough", lambda c: c["light"] < F.col("_fill.light") - 0.12))
    x = x.withColumn("_line", best(first("_darker", "_enough"), lambda c: -c["light"]))
    differs = (F.col("_hint.sat") > WHITE_SATURATION) & (F.col("_fill.sat") > 0.25) & (S.hue_distance(F.col("_hint.hue"), F.col("_fill.hue")) > LIKE_HUE)
    sure = F.least(F.lit(1.0), F.col("_fill.share") * 2.2) * F.when(F.coalesce(differs, F.lit(False)), 0.5).otherwise(1.0)
    return x.select(*df.columns, F.upper("_fill.color").alias("fill"), F.upper("_line.color").alias("outline"), F.when(F.col("_fill").isNull(), F.lit(0.0)).otherwise(F.bround(sure, 3)).alias("confidence"))


def caption_pixels(rgb: Column, width: Column, height: Column, box: Column) -> Column:
    """Packed pixels of a caption's box (struct<x0, y0, x1, y1> as shares) without its rim; null where less than 2 x 2 or 8 pixels are left."""

    @F.pandas_udf("binary")
    def run(p: pd.Series, w: pd.Series, h: pd.Series, b: pd.DataFrame) -> pd.Series:
        out = []
        for pixels, wide, high, edges in zip(p, w, h, b.itertuples(index=False), strict=True):
            if pixels is None or len(pixels) != 3 * wide * high or pd.isna(list(edges)).any():
                out.append(None)
                continue
            dx, dy = (edges.x1 - edges.x0) * INSET, (edges.y1 - edges.y0) * INSET
            ends = [max(1, min(round(v * n), n)) if end else max(0, min(round(v * n), n - 1)) for v, n, end in ((edges.x0 + dx, wide, 0), (edges.x1 - dx, wide, 1), (edges.y0 + dy, high, 0), (edges.y1 - dy, high, 1))]
            x0, x1, y0, y1 = ends
            cut = np.frombuffer(pixels, np.uint8).reshape(high, wide, 3)[y0:y1, x0:x1]
            out.append(cut.tobytes() if x1 - x0 >= 2 and y1 - y0 >= 2 and cut.size >= 24 else None)
        return pd.Series(out)

    return run(rgb, width, height, box)


def calibrated_colors(samples: DataFrame, keys: list[str]) -> DataFrame:
    """keys, fill, outline, confidence, trusted: of each caption's samples (pixels, hint), the median of each channel of their colours and the mean confidence.

    A sample without pixels counts for nothing; a caption without any has no colour and confidence 0. trusted says whether the fill is coloured and sure enough to stand
    instead of the guess.
    """
    x = pick_colors(samples.select(*keys, "hint", color_clusters(F.col("pixels")).alias("clusters")), "clusters", "hint")
    channels = lambda c: [F.expr(f"percentile(cast(conv(substring({c}, {p}, 2), 16, 10) as int), 0.5)") for p in (2, 4, 6)]
    made = lambda ms: F.when(ms[0].isNotNull(), F.concat(F.lit("#"), *[F.lpad(F.hex(F.bround(m).cast("long")), 2, "0") for m in ms]))
    agg = x.groupBy(*keys).agg(made(channels("fill")).alias("fill"), made(channels("outline")).alias("outline"), F.coalesce(F.bround(F.avg(F.when(F.col("fill").isNotNull(), F.col("confidence"))), 3), F.lit(0.0)).alias("confidence"))
    return agg.withColumn("trusted", F.coalesce(S.trusted_color(F.col("fill"), F.col("confidence"), F.lit("#000000"))["source"] == "calibrated", F.lit(False)))
