"""Queries for tracing shots, placing them in order, fingerprint series, word boundaries and snapped parts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import frames as V
from tessera.operators import tracing as R
from tessera.operators import wording as X
from tessera.plans.queries import query, sign_bits, t

SPEED_LIST = ", ".join(f"{s}" for s in R.SPEEDS)


def _series(spark, d):
    """Each label's embeddings as a series of fingerprints."""
    return sign_bits(spark, d).select(F.col("label").alias("source"), (F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1).cast("long").alias("pos"), "bits")


def _cut_video(spark, d):
    """shots, ref, pairs: of each label a video of three shots of 1.2 and 2.8 seconds, taken from its series at speeds 1.0, 1.25 and 0.8; each is looked for in two series, the first in a window."""
    index = _series(spark, d)
    labels = index.select(F.col("source").alias("ref_id")).distinct()
    shots = labels.select("ref_id", F.explode(F.expr("array(0, 1, 2)")).alias("shot")).select("ref_id", "shot", (F.col("shot") * 3.0).alias("start"), (F.col("shot") * 3.0 + F.when(F.col("shot") == 0, 1.2).otherwise(2.8)).alias("end"))
    frames = shots.select("ref_id", "shot", F.explode(F.sequence(F.lit(0), F.lit(29))).alias("k"))
    speed = F.when(F.col("shot") == 1, 1.25).when(F.col("shot") == 2, 0.8).otherwise(1.0)
    at = (F.col("shot") * 12 + F.bround(F.col("k") * 0.4 * speed)).cast("long")
    frames = frames.select(F.col("ref_id").alias("source"), (F.col("shot") * 30 + F.col("k")).cast("long").alias("frame"), at.alias("pos"))
    ref = frames.join(index, ["source", "pos"]).select(F.col("source").alias("ref_id"), F.col("frame").alias("pos"), "bits")
    pairs = shots.select("ref_id", "shot", F.explode(F.array(F.col("ref_id"), (F.col("ref_id") + 1) % 10)).alias("source"), F.when(F.col("shot") == 0, 0.0).alias("lo"), F.when(F.col("shot") == 0, 3.0).alias("hi"))
    return shots, ref, index, pairs


TRACES = f"""
i AS (SELECT label AS source, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS pos, list_transform(embedding, lambda x: x > 0) AS e FROM embeddings), z AS (SELECT source, count(*) AS frames FROM i GROUP BY 1),
s AS (SELECT DISTINCT source AS ref_id, unnest([0, 1, 2]) AS shot FROM i), t AS (SELECT ref_id, shot, shot * 3.0::DOUBLE AS b, CASE WHEN shot = 0 THEN 1.2 ELSE 2.8 END::DOUBLE AS dur FROM s),
p AS (SELECT *, least(12, greatest(3, round_even(dur * 4, 0)))::INT AS taps, b + dur * 0.12 AS lo, b + dur - dur * 0.12 - 0.1 AS hi FROM t),
k AS (SELECT *, unnest(range(0, taps)) AS k FROM p), f AS (SELECT *, k * ((hi - lo) / (taps - 1)) AS step, greatest(0, ceil((lo + step) * 10 - 0.5))::INT AS frame FROM k),
q AS (SELECT f.*, e AS qe FROM f JOIN i ON source = ref_id AND pos = shot * 12 + round_even((frame - shot * 30) * 0.4 * CASE shot WHEN 1 THEN 1.25 WHEN 2 THEN 0.8 ELSE 1.0 END, 0)::INT),
n AS (SELECT *, generate_subscripts(sp, 1) - 1 AS no, unnest(sp) AS speed FROM (SELECT [{SPEED_LIST}]::DOUBLE[] AS sp)), l AS (SELECT ref_id, shot, max(step) AS reach FROM q GROUP BY 1, 2),
w AS (SELECT ref_id, shot, z.source, frames, reach, CASE WHEN shot = 0 THEN 0 END AS wa, CASE WHEN shot = 0 THEN least(frames, ceil((3.0 + reach * 2.0) * 4)) + 1 END AS wb FROM l JOIN z ON z.source IN (ref_id, (ref_id + 1) % 10)),
y AS (SELECT w.*, taps, lo - b AS lead, dur, coalesce(wb - wa >= taps + 2, false) AS windowed, CASE WHEN windowed THEN wa ELSE 0 END AS fr, CASE WHEN windowed THEN least(wb, frames) ELSE frames END AS upto FROM w JOIN p USING (ref_id, shot)),
m AS (SELECT y.ref_id, y.shot, y.source, no, i.pos - round_even(q.step * speed * 4, 0) AS base, list_sum(list_transform(range(1, 65), lambda x: (i.e[x] != qe[x])::INT)) AS dist FROM y JOIN q ON q.ref_id = y.ref_id AND q.shot = y.shot CROSS JOIN n JOIN i ON i.source = y.source
  WHERE base >= fr AND base < upto - round_even(reach * speed * 4, 0)),
d AS (SELECT ref_id, shot, source, no, base, sum(dist)::BIGINT AS d FROM m GROUP BY ALL), o AS (SELECT ref_id, shot, source, no, min({{'d': d, 'base': base}}) AS b FROM d GROUP BY ALL),
g AS (SELECT ref_id, shot, source, list({{'d': b.d / taps, 'no': no, 'base': b.base}} ORDER BY no) FILTER (no = 0 OR dur >= 1.5) AS c FROM o JOIN y USING (ref_id, shot, source) GROUP BY ALL),
h AS (SELECT *, {{'d': round_even(c[1].d, 2), 'no': 0::BIGINT, 'base': c[1].base}} AS one, CASE WHEN c[1].d <= 12 THEN one ELSE list_reduce(list_prepend(one, c[2:]), lambda a, x: CASE WHEN x.d < a.d THEN {{'d': round_even(x.d, 2), 'no': x.no, 'base': x.base}} ELSE a END) END AS best FROM g),
c AS (SELECT *, CASE WHEN one.d - best.d < 1.5 THEN one ELSE best END AS u FROM h), v AS (SELECT c.*, y.taps, y.lead, y.windowed, speed FROM c JOIN y USING (ref_id, shot, source) JOIN n ON n.no = c.u.no),
r AS (SELECT ref_id, shot, source, u.d <= 12 AS hit, round_even(greatest(0, u.base / 4.0 - lead * speed), 2) AS src_start, u.d AS mean_dist, taps, speed, windowed FROM v)"""


@query(f"WITH {TRACES} SELECT * FROM r")
def traced_shots(spark, d):
    """Where each shot lies in each of two sources, at which speed."""
    return R.trace_shots(*_cut_video(spark, d))


@query(f"WITH {TRACES} SELECT ref_id, shot, source, hit, src_start, mean_dist, speed FROM r QUALIFY row_number() OVER (PARTITION BY ref_id, shot ORDER BY NOT hit, mean_dist, source) = 1")
def best_traces(spark, d):
    """The best source of each shot; no window here is so bad that the whole source is searched again with another result."""
    return R.best_traces(*_cut_video(spark, d)).select("ref_id", "shot", "source", "hit", "src_start", "mean_dist", "speed")


@query("""
WITH RECURSIVE k AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
x AS (SELECT user_id, event_id, k, k * 10.0::DOUBLE AS s, k * 10.0 + 1 + event_id % 8 AS e, event_type = 'purchase' AS direct, event_type = 'signup' AS anchored,
  list_transform([0, 1, 2, 3], lambda j: {'source': 's' || ((event_id + j) % 2), 'at': k * 7.0 + (event_id * (j + 3) * 13) % 60 - 30, 'votes': (event_id * (j + 1)) % 5}) AS spots FROM k),
r AS (SELECT user_id, NULL::BIGINT AS event_id, 0::BIGINT AS k, NULL::VARCHAR AS source, NULL::DOUBLE AS src, NULL::DOUBLE AS on0, NULL::DOUBLE AS on1, NULL::VARCHAR AS locator FROM (SELECT DISTINCT user_id FROM events)
  UNION ALL SELECT user_id, event_id, k, source, src, CASE WHEN source = 's0' THEN src + d ELSE on0 END, CASE WHEN source = 's1' THEN src + d ELSE on1 END, CASE WHEN direct THEN 'direct' WHEN source IS NOT NULL THEN 'window' END FROM (
    SELECT *, CASE WHEN direct THEN 's' || (event_id % 2) WHEN c0 IS NOT NULL THEN 's0' WHEN c1 IS NOT NULL THEN 's1' END AS source, CASE WHEN direct THEN k * 7.0 WHEN c0 IS NOT NULL THEN round(greatest(0, c0."at"), 2) WHEN c1 IS NOT NULL THEN round(greatest(0, c1."at"), 2) END AS src FROM (
      SELECT *, list_min(list_transform(list_filter(spots, lambda p: p.source = 's0' AND lo0 IS NOT NULL AND p."at" BETWEEN greatest(0, lo0) AND greatest(0, lo0, hi0)), lambda p: {'less': -p.votes, 'at': p."at"})) AS c0,
        list_min(list_transform(list_filter(spots, lambda p: p.source = 's1' AND on1 IS NOT NULL AND p."at" BETWEEN greatest(0, on1 - 8) AND greatest(0, on1 - 8, on1 + 2 * d + 16)), lambda p: {'less': -p.votes, 'at': p."at"})) AS c1 FROM (
        SELECT x.*, e - s AS d, r.on0, r.on1, CASE WHEN anchored THEN x.k * 7.0 - 5 ELSE r.on0 - 8 END AS lo0, CASE WHEN anchored THEN x.k * 7.0 + 5 ELSE r.on0 + 2 * d + 16 END AS hi0 FROM r JOIN x ON x.user_id = r.user_id AND x.k = r.k + 1))))
SELECT user_id, event_id, source, src AS src_start, locator FROM r WHERE k > 0""")
def running_places(spark, d):
    """Each user's events as shots of two sources: purchases are matched, signups have an anchor, and the rest have four spots each, of which the last places so far choose."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    x = t(spark, d, "events").select("user_id", "event_id", "event_type", F.row_number().over(w).alias("k"))
    e, k = F.col("event_id"), F.col("k")
    spot = lambda j: F.struct(F.concat(F.lit("s"), ((e + j) % 2).cast("string")).alias("source"), (k * 7.0 + (e * (j + 3) * 13) % 60 - 30).cast("double").alias("at"), ((e * (j + 1)) % 5).alias("votes"))
    direct = F.when(F.col("event_type") == "purchase", F.struct(F.concat(F.lit("s"), (e % 2).cast("string")).alias("source"), (k * 7.0).alias("src_start"), F.lit(1.0).alias("speed")))
    windows = F.when(F.col("event_type") == "signup", F.array(F.struct(F.lit("s0").alias("source"), (k * 7.0 - 5).alias("lo"), (k * 7.0 + 5).alias("hi"))))
    x = x.select("user_id", "event_id", (k * 10.0).alias("start"), (k * 10.0 + 1 + e % 8).alias("end"), direct.alias("direct"), windows.alias("windows"), F.array(*[spot(j) for j in range(4)]).alias("spots"))
    return R.place_in_order(x, ["user_id"], "event_id").select("user_id", "event_id", "source", "src_start", "locator")


@query(None)
def fingerprint_series(spark, d):
    """Four frames of 40 x 30 grey pixels of each document, every second one with bars above and below; tests hold the operator against plain Python."""
    x = t(spark, d, "documents").select(F.col("doc_id").cast("string").alias("source"), F.coalesce("text", F.lit("")).alias("text"), "doc_id")
    frames = x.select("source", "doc_id", "text", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("frame"))
    digits = F.concat(*[F.sha2(F.concat_ws("-", "text", "frame", F.lit(str(k))), 512) for k in range(19)])
    bars = F.concat(F.repeat(F.lit("00"), 240), F.substring(digits, 1, 1440), F.repeat(F.lit("00"), 240))
    frames = frames.select("source", "frame", F.lit(40).alias("width"), F.lit(30).alias("height"), F.unhex(F.when(F.col("doc_id") % 2 == 0, bars).otherwise(F.substring(digits, 1, 2400))).alias("gray"))
    sources = x.select("source", F.length("text").alias("size"), F.crc32("text").alias("modified"))
    return V.fingerprint_series(frames, sources, 4.0).select("source", "pos", "bits")


HLS = """SELECT *, (hi + lo) / 2 AS l, CASE WHEN hi = lo THEN 0.0 WHEN (hi + lo) / 2 <= 0.5 THEN (hi - lo) / (hi + lo) ELSE (hi - lo) / (2 - hi - lo) END AS s,
    CASE WHEN hi = lo THEN 0.0 ELSE (CASE WHEN r = hi THEN (g - b) / (hi - lo) WHEN g = hi THEN 2 + (b - r) / (hi - lo) ELSE 4 + (r - g) / (hi - lo) END / 6.0 + 1) % 1 END AS h
  FROM (SELECT *, greatest(r, g, b) AS hi, least(r, g, b) AS lo FROM (SELECT *, ('0x' || c[2:3])::INT / 255.0::DOUBLE AS r, ('0x' || c[4:5])::INT / 255.0::DOUBLE AS g, ('0x' || c[6:7])::INT / 255.0::DOUBLE AS b FROM ({source})))"""


@query(f"""
WITH t AS (SELECT doc_id, md5(coalesce(text, '')) AS m, CASE doc_id % 5 WHEN 0 THEN NULL WHEN 1 THEN '#ffffff' WHEN 2 THEN '#' || md5(coalesce(text, ''))[8:13] WHEN 3 THEN '#ff2010' ELSE '#303030' END AS hint FROM documents),
k AS ({HLS.format(source="SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY share DESC, c) - 1 AS no FROM (SELECT doc_id, '#' || m[1 + 6 * i:6 + 6 * i] AS c, share FROM t, (VALUES (0, 0.5::DOUBLE), (1, 0.25::DOUBLE), (2, 0.25::DOUBLE)) v(i, share))")}),
q AS ({HLS.format(source="SELECT doc_id, hint AS c FROM t WHERE hint IS NOT NULL")}),
j AS (SELECT k.*, q.c AS hint, q.h AS qh, q.s AS qs, q.l AS ql, k.s >= 0.55 AND k.l BETWEEN 0.18 AND 0.85 AS vivid, coalesce(least(abs(k.h - q.h), 1 - abs(k.h - q.h)) <= 0.12 AND k.s >= 0.25, false) AS alike FROM k LEFT JOIN q USING (doc_id)),
w AS (SELECT *, bool_or(vivid) OVER p AS any_vivid, bool_or(alike) OVER p AS any_alike, coalesce(qs <= 0.18 AND ql >= 0.6, false) AS white FROM j WINDOW p AS (PARTITION BY doc_id)),
s AS (SELECT *, CASE WHEN hint IS NULL THEN vivid OR NOT any_vivid WHEN white THEN vivid OR NOT any_vivid WHEN any_alike THEN alike ELSE vivid OR NOT any_vivid END AS pool,
  CASE WHEN hint IS NULL THEN s WHEN white AND any_vivid THEN s * 0.55 + share * 0.45 WHEN white THEN l * (1.0 - s) ELSE s * 0.6 + share * 0.4 END AS score FROM w),
f AS (SELECT doc_id, max({{'score': score, 'second': CASE WHEN hint IS NULL THEN share ELSE 0 END, 'no': -no, 'c': c, 'share': share, 'h': h, 's': s, 'l': l}}) FILTER (pool) AS f, any_value(qh) AS qh, any_value(qs) AS qs FROM s GROUP BY 1),
o AS (SELECT doc_id, coalesce(min({{'l': k.l, 'no': no, 'c': k.c}}) FILTER (k.l < f.f.l - 0.12), min({{'l': k.l, 'no': no, 'c': k.c}})) AS o FROM k JOIN f USING (doc_id) GROUP BY 1)
SELECT doc_id, upper(f.f.c) AS fill, upper(o.o.c) AS outline, round_even(least(1.0, f.f.share * 2.2) * CASE WHEN qs > 0.18 AND f.f.s > 0.25 AND least(abs(qh - f.f.h), 1 - abs(qh - f.f.h)) > 0.12 THEN 0.5 ELSE 1.0 END, 3) AS confidence FROM f JOIN o USING (doc_id)""")
def caption_colors(spark, d):
    """Captions of three colours of 192, 96 and 96 pixels, with guesses that are absent, white, one of the colours, another, or dark."""
    m = F.md5(F.coalesce("text", F.lit("")).cast("binary"))
    hint = F.when(F.col("doc_id") % 5 == 1, "#ffffff").when(F.col("doc_id") % 5 == 2, F.concat(F.lit("#"), F.substring("m", 8, 6))).when(F.col("doc_id") % 5 == 3, "#ff2010").when(F.col("doc_id") % 5 == 4, "#303030")
    pixels = F.unhex(F.concat(F.repeat(F.substring("m", 1, 6), 192), F.repeat(F.substring("m", 7, 6), 96), F.repeat(F.substring("m", 13, 6), 96)))
    x = t(spark, d, "documents").select("doc_id", m.alias("m")).select("doc_id", pixels.alias("pixels"), hint.alias("hint"))
    return V.calibrated_colors(x, ["doc_id"]).select("doc_id", "fill", "outline", "confidence")


@query(r"""
WITH RECURSIVE u AS (SELECT unnest(regexp_extract_all(lower(text), '[a-zà-öø-ÿ]+')) AS word FROM conversations), c AS (SELECT word, count(*) AS n FROM u GROUP BY 1), w AS (SELECT word, round_even(ln(n / (sum(n) OVER ())) * 1000000, 0)::BIGINT AS weight FROM c), one AS (SELECT -round_even(ln(sum(n)) * 1000000, 0)::BIGINT AS single FROM c),
t AS (SELECT conv_id, turn, regexp_replace(lower(text), '\s', '', 'g') AS heard FROM conversations),
p AS (SELECT *, regexp_split_to_array(heard, '[^a-zà-öø-ÿ]+') AS parts FROM t),
s AS (SELECT conv_id, turn, unnest(range(1, len(parts) + 1)) AS k, parts, unnest(parts) AS s FROM p), y AS (SELECT conv_id, turn, k, s, length(s) AS n, coalesce(list_sum(list_transform(parts[1:k - 1], lambda z: length(z))), 0)::BIGINT AS b FROM s WHERE s <> ''),
e AS (SELECT conv_id, turn, k, i, list({'w': weight, 'len': len}) AS opts FROM (SELECT conv_id, turn, k, i, len, s[i:i + len - 1] AS word FROM (SELECT *, unnest(range(1, least((SELECT max(length(word)) FROM w), n - i + 1) + 1)) AS len FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM y))) JOIN w USING (word) GROUP BY ALL),
l AS (SELECT y.conv_id, y.turn, y.k, y.n, y.b, list(opts ORDER BY i) AS opts FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM y) y LEFT JOIN e USING (conv_id, turn, k, i) GROUP BY ALL),
r AS (SELECT conv_id, turn, k, n, b, opts, n AS i, [0::BIGINT] AS best, []::BIGINT[] AS steps FROM l
  UNION ALL SELECT conv_id, turn, k, n, b, opts, i - 1, list_prepend(m.v, best), list_prepend(m.len, steps) FROM (
    SELECT *, list_max(list_prepend({'v': (SELECT single FROM one) + best[1], 'len': 1::BIGINT}, coalesce(list_transform(opts[i], lambda o: {'v': o.w + best[o.len], 'len': o.len}), []))) AS m FROM r WHERE i > 0)),
g AS (SELECT conv_id, turn, k, n, b, steps, steps[1] AS pos FROM r WHERE i = 0 UNION ALL SELECT conv_id, turn, k, n, b, steps, pos + steps[pos + 1] FROM g WHERE pos < n)
SELECT conv_id, turn, md5(array_to_string(list_sort(list(DISTINCT b + pos - 1)), ',')) AS words, count(DISTINCT b + pos - 1) AS n FROM g GROUP BY 1, 2""")
def word_breaks(spark, d):
    """Words of turns without white space, found again by the words of all turns; every character but letters counts as a mark."""
    x = t(spark, d, "conversations").select("conv_id", "turn", F.regexp_replace(F.lower("text"), r"\s", "").alias("heard"))
    words = t(spark, d, "conversations").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-zà-öø-ÿ]+"), F.lit(0))).alias("word")).select("word", F.lit(1).alias("n"))
    text = F.regexp_replace("heard", "[^a-zà-öø-ÿ]+", ",")
    x = x.select("conv_id", "turn", text.alias("text"), F.filter(F.split(F.regexp_replace("heard", "[^a-zà-öø-ÿ]+", ""), ""), lambda c: c != "").alias("chars"))
    y = X.word_breaks(x, words, ["conv_id", "turn"], joined=None).filter(F.size("brk") > 0)
    return y.select("conv_id", "turn", F.md5(F.array_join(F.col("brk").cast("array<string>"), ",")).alias("words"), F.size("brk").cast("long").alias("n"))


GAP = "CASE WHEN {b} <= {a} THEN [] WHEN {b} - {a} > 14 AND len(list_filter(cuts, lambda c: c >= {a} AND c < {b} - 1)) > 0 THEN [{{'a': {a}, 'b': {near} + 1, 'role': 'narration'}}, {{'a': {near} + 1, 'b': {b}, 'role': 'narration'}}] ELSE [{{'a': {a}, 'b': {b}, 'role': 'narration'}}] END"


def _gap(a: str, b: str) -> str:
    near = f"list_min(list_transform(list_filter(cuts, lambda c: c >= {a} AND c < {b} - 1), lambda c: {{'far': abs(c - {a} + 1 - ({b} - {a} + 1) // 2), 'c': c}})).c"
    return GAP.format(a=a, b=b, near=near)


@query(f"""
WITH RECURSIVE x AS (SELECT conv_id, turn, length(text) AS n, list_filter(range(0, length(text) - 1), lambda i: regexp_matches(text[i + 1], '[ ,.;!?]')) AS cuts,
  list_filter(list_transform(range(0, length(text) // 40 + 1), lambda k: {{'a': 40 * k + (k * 7 + turn) % 11, 'b': least(length(text), 40 * k + 25 + (k * 5) % 16), 'role': CASE (k + turn) % 3 WHEN 0 THEN 'emphasis' WHEN 1 THEN 'highlight' ELSE 'label' END}}), lambda p: p.a < p.b) AS parts FROM conversations),
f AS (SELECT conv_id, turn, n, cuts, list_concat(flatten(list_transform(range(1, len(parts) + 1), lambda i: list_concat({_gap("(CASE WHEN i = 1 THEN 0 ELSE parts[i - 1].b END)", "parts[i].a")}, [parts[i]]))), {_gap("coalesce(parts[-1].b, 0)", "n")}) AS parts FROM x),
r AS (SELECT conv_id, turn, cuts, parts, 1::BIGINT AS i, parts[1:1] AS done FROM f WHERE len(parts) > 0
  UNION ALL SELECT conv_id, turn, cuts, parts, i + 1, CASE WHEN len(cuts) = 0 OR last.b <> p.a OR list_contains(cuts, last.b - 1) THEN list_append(done, p) WHEN near IS NOT NULL THEN list_concat(done[:-2], [{{'a': last.a, 'b': near + 1, 'role': last.role}}, {{'a': near + 1, 'b': p.b, 'role': p.role}}])
    ELSE list_append(done[:-2], {{'a': last.a, 'b': p.b, 'role': CASE WHEN p.b - p.a > last.b - last.a THEN p.role ELSE last.role END}}) END FROM (
    SELECT *, list_min(list_transform(list_filter(cuts, lambda c: c >= last.a AND c < p.b - 1), lambda c: {{'far': abs(c - last.b + 1), 'c': c}})).c AS near FROM (SELECT *, done[-1] AS last, parts[i + 1] AS p FROM r WHERE i < len(parts)))),
g AS (SELECT conv_id, turn, done, unnest(range(1, len(done) + 1)) AS k FROM r WHERE i = len(parts))
SELECT conv_id, turn, k::INT AS part_no, done[k].a::INT AS a, done[k].b::INT AS b, done[k].role AS role FROM g""")
def covered_parts(spark, d):
    """Turns with parts that leave characters out and end inside of words."""
    n, turn = F.length("text"), F.col("turn")
    made = lambda k: F.struct((40 * k + (k * 7 + turn) % 11).cast("int").alias("a"), F.least(n, 40 * k + 25 + (k * 5) % 16).cast("int").alias("b"), F.when((k + turn) % 3 == 0, "emphasis").when((k + turn) % 3 == 1, "highlight").otherwise("label").alias("role"))
    parts = F.filter(F.transform(F.sequence(F.lit(0), F.floor(n / 40).cast("int")), made), lambda p: p["a"] < p["b"])
    cuts = F.filter(F.transform(F.split(F.substring("text", F.lit(1), n - 1), ""), lambda c, i: F.when(c.rlike("[ ,.;!?]"), i)), lambda i: i.isNotNull())
    x = t(spark, d, "conversations").filter(n > 0).select("conv_id", "turn", n.alias("n"), cuts.alias("cuts"), parts.alias("parts"))
    y = X.covered_parts(x).select("conv_id", "turn", F.posexplode("parts").alias("k", "p"))
    return y.select("conv_id", "turn", (F.col("k") + 1).alias("part_no"), "p.a", "p.b", "p.role")
