"""Scalar expressions: built-in column functions, which stay inside generated code, but for the mending of broken JSON."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, MapType, StringType, StructType

# Words read as true and as false.
TRUE_WORDS = ("true", "1", "是", "有", "yes", "y")
FALSE_WORDS = ("false", "0", "否", "无", "没有", "not", "no", "n")
# Transitions between pictures that belong together, and cuts.
SOFT_WORDS = ("叠化", "溶解", "运镜衔接", "匹配剪辑", "转场衔接", "无缝", "遮罩转场", "划像", "闪白", "闪黑", "同镜")
HARD_WORDS = ("硬切", "切换", "直切", "跳切", "无")


def first_filled(*names: Column) -> Column:
    """The first value that is neither null nor empty, else the empty text; the number 0 counts as filled."""
    return F.coalesce(*[F.nullif(c.cast("string"), F.lit("")) for c in names], F.lit(""))


def tristate(value: Column) -> Column:
    """True, False, or null where a text says neither."""
    t = F.lower(F.trim(value.cast("string")))
    return F.when(t.isin(*TRUE_WORDS), True).when(t.isin(*FALSE_WORDS), False)


def score_01(value: Column) -> Column:
    """A number clamped to 0..1; 0 where it is none."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(value.cast("string").try_cast("double"), F.lit(0.0))))


def ordinal(value: Column) -> Column:
    """A sort key: the whole number, or 2^30 so that others sort last."""
    return F.coalesce(value.cast("string").try_cast("int"), F.lit(1 << 30))


def seconds_or(value: Column, default: float = 2.0, least: float = 0.1) -> Column:
    d = value.cast("string").try_cast("double")
    return F.coalesce(F.greatest(F.lit(least), d), F.lit(default))


def parse_timecode(text: Column, failed: float = -1.0) -> Column:
    """Seconds of "h:m:s", "m:s" or "s" (base 60); failed where a part is no number."""
    parts = F.transform(F.split(F.trim(text), ":"), lambda p: F.trim(p).try_cast("double"))
    total = F.aggregate(parts, F.lit(0.0), lambda a, v: a * 60 + v)
    return F.when(text.isNull() | F.exists(parts, lambda p: p.isNull()) | (F.size(parts) > 3), F.lit(failed)).otherwise(total)


def _clock(seconds: Column, units: int) -> tuple[Column, Column, Column, Column]:
    """Hours, minutes, seconds and the rest in 1/units, from a rounded total."""
    t = F.round(F.greatest(seconds, F.lit(0.0)) * units).cast("long")
    return F.floor(t / (3600 * units)), F.floor(t / (60 * units)) % 60, F.floor(t / units) % 60, t % units


def format_mmss(seconds: Column) -> Column:
    """mm:ss.s"""
    t = F.round(F.greatest(seconds, F.lit(0.0)) * 10).cast("long")
    return F.format_string("%02d:%02d.%d", F.floor(t / 600), F.floor(t / 10) % 60, t % 10)


def format_srt(seconds: Column) -> Column:
    """HH:MM:SS,mmm"""
    return F.format_string("%02d:%02d:%02d,%03d", *_clock(seconds, 1000))


def format_ass(seconds: Column) -> Column:
    """h:mm:ss.cc"""
    return F.format_string("%d:%02d:%02d.%02d", *_clock(seconds, 100))


def json_object_in(text: Column) -> Column:
    """From the first brace to the last; null without one."""
    return F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit(""))


_JSON_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*+("|\\?\Z)|[{}\[\]:,]|[^\s{}\[\]:,"]+', re.S)


def closed_json(text: str | None) -> str | None:
    """A JSON object that was cut off or has lost commas or closing brackets, made whole; null where that can't be.

    A stack of open brackets is kept while the tokens are read. Whatever is complete stays: a value that was cut off inside of a text ends there, a key without value
    and a comma without anything behind it go. A closing bracket that doesn't fit closes those inside, too.
    """
    out: list[str] = []
    stack: list[str] = []  # what closes each open bracket
    wants, safe = "value", 0  # what may come next; how much of out is complete
    for m in _JSON_TOKEN.finditer(text or ""):
        token = m[0]
        if token in "}]":
            if token not in stack or (wants in ("value", "colon") and out[-1] not in "[,"):
                del out[safe:]  # a key without a value
            if token not in stack:
                continue
            if out[-1] == ",":
                out.pop()
            while True:
                out.append(stack.pop())
                if out[-1] == token:
                    break
            wants, safe = "comma", len(out)
            if not stack:
                break
            continue
        if wants == "comma" and token != ",":
            out.append(",")
            wants = "key" if stack[-1] == "}" else "value"
        if token in "{[":
            if wants == "key":
                return None
            out.append(token)
            stack.append("}" if token == "{" else "]")
            wants, safe = "key" if token == "{" else "value", len(out)
        elif token == ":" and wants == "colon":
            out.append(token)
            wants = "value"
        elif token == ",":
            if wants == "comma":
                out.append(token)
                wants = "key" if stack[-1] == "}" else "value"
        elif wants == "key":
            if token[0] != '"' or m[1] != '"':
                break
            out.append(token)
            wants = "colon"
        elif wants == "value":
            token = _ended(token) if token[0] == '"' and m[1] != '"' else token
            if token[0] != '"' and not _is_value(token):
                break
            out.append(token)
            wants, safe = "comma", len(out)
        else:
            return None
    whole = "".join(out[:safe]) + "".join(reversed(stack))
    return whole if whole[:1] == "{" and _is_value(whole) else None


def _ended(cut: str) -> str:
    """A text that ends without its quotation mark, ended; half an escape goes."""
    return re.sub(r"(?<!\\)((?:\\\\)*)\\(u[0-9a-fA-F]{0,3})?\Z", r"\1", cut) + '"'


def _is_value(token: str) -> bool:
    try:
        json.loads(token)
    except (ValueError, RecursionError):
        return False
    return True


def json_repaired(text: Column) -> Column:
    """The JSON object in a noisy text, mended if it is broken; null without one."""

    @F.pandas_udf(StringType())
    def mend(broken: pd.Series) -> pd.Series:
        return broken.map(closed_json, na_action="ignore").astype(object)

    raw = json_object_in(text)
    sound = F.try_parse_json(raw).isNotNull()
    return F.when(sound, raw).otherwise(mend(F.when(~sound, raw)))


def item_objects(items: Column, key: str) -> Column:
    """array<string> of the JSON objects of a JSON list: texts and numbers come as {key: value}, blanks, booleans, nulls and lists go; null for what is no list."""
    kind = lambda v: F.schema_of_variant(v)
    found = F.try_variant_get(F.try_parse_json(items), "$", "array<variant>")
    bare = lambda v: F.to_json(F.struct(v.alias(key)))
    text = lambda v: F.try_variant_get(v, "$", "string")
    wrap = lambda v: F.when(kind(v).startswith("OBJECT"), F.to_json(v)).when(kind(v).isin("BOOLEAN", "VOID") | kind(v).startswith("ARRAY") | (F.trim(text(v)) == ""), F.lit(None)).otherwise(bare(v))
    return F.filter(F.transform(found, wrap), lambda x: x.isNotNull())


def told_value(value: Column, kind: DataType) -> Column:
    """A nested value as text: lists by "、", fields as name and value by "，", at any depth; null is "None" and booleans begin with a capital."""
    if isinstance(kind, ArrayType):
        return F.array_join(F.transform(value, lambda x: told_value(x, kind.elementType)), "、")
    if isinstance(kind, StructType):
        return F.concat_ws("，", *[F.concat(F.lit(f.name), told_value(value[f.name], f.dataType)) for f in kind.fields])
    if isinstance(kind, MapType):
        return F.array_join(F.transform(F.map_entries(value), lambda e: F.concat(e["key"].cast("string"), told_value(e["value"], kind.valueType))), "，")
    told = F.initcap(value.cast("string")) if isinstance(kind, BooleanType) else value.cast("string")
    return F.coalesce(told, F.lit("None"))


def nested_brief(df: DataFrame, fields: dict[str, str]) -> Column:
    """"name：value" of the columns of df that are filled, by "；". Empty texts and lists, null and "无" are left out; lists and structs are told at any depth."""
    told = []
    for name, column in fields.items():
        kind, value = df.schema[column].dataType, F.col(column)
        empty = value.isNull()
        if isinstance(kind, ArrayType):
            empty = empty | (F.size(value) == 0)
        elif isinstance(kind, StringType):
            empty = empty | value.isin("", "无")
        told.append(F.when(~empty, F.concat(F.lit(f"{name}："), told_value(value, kind))))
    return F.concat_ws("；", *told)


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def contains_any(text: Column, words: tuple[str, ...]) -> Column:
    return F.coalesce(F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(F.lower(text), w)), F.lit(False))


def hard_cut(text: Column) -> Column:
    """Whether a shot begins with a cut: a blank text or a word for a cut says so, unless a soft word stands there too; other texts don't."""
    blank = F.trim(F.coalesce(text, F.lit(""))) == ""
    return ~contains_any(text, SOFT_WORDS) & (contains_any(text, HARD_WORDS) | blank)


def strip_marks(text: Column) -> Column:
    """Without bracketed stage directions, white space squeezed."""
    return squeeze(F.regexp_replace(text, r"\([^)]*\)|（[^）]*）|【[^】]*】|\[[^\]]*\]", " "))


def sound_effects(text: Column) -> Column:
    """The clauses in round brackets only, joined by a space: what is heard but not spoken."""
    inside = F.transform(F.regexp_extract_all(text, F.lit(r"[(（]([^)）]*)[)）]"), 1), lambda s: F.trim(s))
    return F.array_join(F.filter(inside, lambda x: x != ""), " ")


def strip_music(text: Column) -> Column:
    """Without angle-bracketed marks that speak of music; other tags are kept."""
    return squeeze(F.regexp_replace(text, r"(?i)<[^<>]*(?:music|bgm|音乐|配乐)[^<>]*>", " "))


def strip_role(text: Column) -> Column:
    """Without a short speaker name and colon at the start."""
    return F.regexp_replace(text, r"^\s*[^:：\s]{1,12}[:：]\s*", "")


def folded(text: Column) -> Column:
    """Lower case, letters, digits and CJK only."""
    return F.regexp_replace(F.lower(text), r"[^0-9a-z一-鿿]", "")


def slug(text: Column, most: int = 80) -> Column:
    s = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^0-9A-Za-z_]+", "_"), r"^_+|_+$", "")
    return F.substring(s, 1, most)


def display_width(text: Column) -> Column:
    """Columns a text takes: characters from U+2E80 on two, others one."""
    return F.length(text) + F.length(F.regexp_replace(text, r"[^\x{2E80}-\x{10FFFF}]", ""))


def split_sentences(text: Column, commas: bool = False) -> Column:
    """Sentences with their closing mark; blank ones are left out. With commas, clauses."""
    marks = "。！？；…!?;" + ("，,、" if commas else "")
    return F.filter(F.transform(F.split(text, rf"(?<=[{marks}])"), lambda s: F.trim(s)), lambda s: s != "")


def hex_channels(color: Column) -> tuple[Column, Column, Column]:
    h = F.regexp_replace(color, "^#", "")
    return tuple(F.conv(F.substring(h, p, 2), 16, 10).cast("int") for p in (1, 3, 5))


def ass_color(color: Column) -> Column:
    """#RRGGBB as &H00BBGGRR."""
    h = F.upper(F.regexp_replace(color, "^#", ""))
    return F.concat(F.lit("&H00"), F.substring(h, 5, 2), F.substring(h, 3, 2), F.substring(h, 1, 2))


def worked_out_once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use of a value that stands in it more than once; a plain expression would be worked out again at each place within conditions."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def saturation(color: Column) -> Column:
    """Of the HLS model, 0..1."""

    def of(c: Column) -> Column:
        hi, lo = c["hi"], c["lo"]
        light = (hi + lo) / 2
        return F.when(hi == lo, F.lit(0.0)).when(light <= 0.5, (hi - lo) / (hi + lo)).otherwise((hi - lo) / (2 - hi - lo))

    ends = lambda c: F.struct(F.array_max(c).alias("hi"), F.array_min(c).alias("lo"))
    channels = worked_out_once(color, lambda c: F.array(*[x / 255.0 for x in hex_channels(c)]))
    return worked_out_once(worked_out_once(channels, ends), of)


def hue(color: Column) -> Column:
    """Of the HLS model, 0..1; a turn is added before it is taken off, so distances round alike on both sides of red."""
    r, g, b = (c / 255.0 for c in hex_channels(color))
    hi, lo = F.greatest(r, g, b), F.least(r, g, b)
    d = hi - lo
    h = F.when(r == hi, (g - b) / d).when(g == hi, 2 + (b - r) / d).otherwise(4 + (r - g) / d)
    return F.when(d == 0, F.lit(0.0)).otherwise((h / 6.0 + 1) % F.lit(1.0))


def hue_distance(a: Column, b: Column) -> Column:
    d = F.abs(a - b)
    return F.least(d, 1 - d)


def trusted_color(calibrated: Column, confidence: Column, hint: Column) -> Column:
    """(value, source): the calibrated colour if it is saturated (0.45) and sure (0.40) enough, else the hint."""
    ok = calibrated.isNotNull() & (saturation(calibrated) >= 0.45) & (confidence >= 0.40)
    return worked_out_once(ok, lambda ok: F.struct(F.when(ok, calibrated).otherwise(hint).alias("value"), F.when(ok, F.lit("calibrated")).otherwise(F.lit("hint")).alias("source")))


def position_code(vertical: Column, horizontal: Column) -> Column:
    """Number pad: bottom 1-3, middle 4-6, top 7-9; bottom centre where unknown."""
    row = F.when(vertical == "top", 6).when(vertical == "middle", 3).otherwise(0)
    col = F.when(horizontal == "left", 1).when(horizontal == "right", 3).otherwise(2)
    return row + col


def listed(items: Column) -> Column:
    """Texts of a list, white space squeezed, each once in the order they are first seen; nulls and blanks go."""
    return F.array_distinct(F.filter(F.transform(items, lambda x: squeeze(x.cast("string"))), lambda x: x != ""))


def brief(parts: dict[str, Column], between: str = "；") -> Column:
    """"label: value" of the parts that are filled."""
    told = [F.when(F.trim(c.cast("string")) != "", F.concat(F.lit(f"{k}: "), F.trim(c.cast("string")))) for k, c in parts.items()]
    return F.concat_ws(between, *told)


def contained_in(path: Column, root: Column) -> Column:
    """Whether a path lies below a root, without any step up."""
    base = F.concat(F.regexp_replace(root, "/+$", ""), F.lit("/"))
    return F.coalesce(F.startswith(path, base) & ~path.rlike(r"(^|/)\.\.(/|$)"), F.lit(False))


def near_black(color: Column, most: int = 40) -> Column:
    return F.greatest(*hex_channels(color)) <= most


def squeeze_time(at: Column, old_start: Column, old_end: Column, start: Column, end: Column) -> Column:
    """A time inside [old_start, old_end] moved in proportion into [start, end]."""
    span = old_end - old_start
    return F.when(span > 0, start + (at - old_start) * (end - start) / span).otherwise(start)


def normal_box(box: Column) -> Column:
    """[x0, y0, x1, y1] within 0..1, corners in order, four digits; null if flat or not four numbers."""
    top = F.array_max(F.transform(box, lambda v: F.abs(v)))
    v = F.transform(box, lambda x: F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.when(top > 1.5, x / top).otherwise(x))))
    at = lambda k: F.try_element_at(v, F.lit(k))
    x0, x1, y0, y1 = F.least(at(1), at(3)), F.greatest(at(1), at(3)), F.least(at(2), at(4)), F.greatest(at(2), at(4))
    ok = (F.size(box) == 4) & (x1 - x0 >= 1e-3) & (y1 - y0 >= 1e-3)
    return F.when(ok, F.transform(F.array(x0, y0, x1, y1), lambda x: F.round(x, 4)))


def loudness_gain(db: Column, target: float = -20.0, most: float = 6.0, least: float = 0.8, silent: float = -45.0) -> Column:
    """Decibels to add: clamped, and 0 where silent or too small to matter."""
    gain = F.greatest(F.lit(-most), F.least(F.lit(most), target - db))
    return F.when(db.isNull() | (db <= silent) | (F.abs(gain) < least), F.lit(0.0)).otherwise(gain)



def url_key(url: Column) -> Column:
    return F.substring_index(url, "?", 1)


def safe_identifier(text: Column) -> Column:
    return F.coalesce(text.rlike(r"^[\w-]+$"), F.lit(False))
