"""Decision tables and measured gates as data.

A table's rows are tried from the top and the first hit wins. A field that a row leaves
out is a wildcard; a null fact meets wildcards only; (lo, hi) means lo <= x < hi. A small
table becomes one CASE WHEN, so deciding is a projection; a large one, or one that is
itself a DataFrame, is joined.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from itertools import product
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class DecisionTable:
    name: str
    fields: tuple[str, ...]
    rows: tuple[tuple[dict[str, Any], str], ...]

    def __post_init__(self):
        if not self.rows or any(v is not None for v in self.rows[-1][0].values()):
            raise ValueError(f"{self.name}: the last row must be unconditional")
        unknown = {f for when, _ in self.rows for f in when} - set(self.fields)
        if unknown:
            raise ValueError(f"{self.name}: unknown fields {sorted(unknown)}")

    def hit(self, k: int, facts: dict[str, Column]) -> Column:
        """Whether row k fits; never null."""
        test = F.lit(True)
        for f, want in self.rows[k][0].items():
            if want is None:
                continue
            x = facts[f]
            if isinstance(want, tuple):
                x = x.cast("double")
                test = test & F.coalesce((x >= want[0]) & (x < want[1]), F.lit(False))
            else:
                test = test & F.coalesce(x == F.lit(want), F.lit(False))
        return test

    def decide(self, facts: dict[str, Column], blocked: Column | None = None, blocked_action: str | None = None) -> Column:
        """struct<action, hit_row, facts>; blocked (a gate that is False) decides first, with hit_row -1."""
        told = F.create_map(*[x for f in self.fields for x in (F.lit(f), facts[f].cast("string"))])
        case = lambda k, action: F.struct(F.lit(action).alias("action"), F.lit(k).alias("hit_row"), told.alias("facts"))
        out = None
        if blocked is not None:
            out = F.when(F.coalesce(blocked, F.lit(False)), case(-1, blocked_action))
        for k, (_, action) in enumerate(self.rows[:-1]):
            out = F.when(self.hit(k, facts), case(k, action)) if out is None else out.when(self.hit(k, facts), case(k, action))
        last = case(len(self.rows) - 1, self.rows[-1][1])
        return last if out is None else out.otherwise(last)

    def markdown(self) -> str:
        """The table as a document, for people."""
        cell = lambda v: "*" if v is None else f"[{v[0]}, {v[1]})" if isinstance(v, tuple) else str(v)
        head = [*self.fields, "action"]
        body = [[*[cell(when.get(f)) for f in self.fields], action] for when, action in self.rows]
        return "\n".join("| " + " | ".join(r) + " |" for r in [head, ["---"] * len(head), *body])


# The tables' rows and limits.
CLIP = DecisionTable("clip_handling", ("on_camera_speech", "speech_match", "has_bgm"), (
    ({"on_camera_speech": False}, "mute_and_dub"),
    ({"on_camera_speech": True, "speech_match": False}, "mute_and_dub"),
    ({"on_camera_speech": True, "speech_match": True, "has_bgm": False}, "keep_original"),
    ({"on_camera_speech": True, "speech_match": True, "has_bgm": True}, "separate_voice"),
    ({}, "mute_and_dub"),
))
GAP = DecisionTable("gap_fill", ("needs_model", "have_model", "multi_need"), (
    ({"needs_model": False}, "direct"),
    ({"needs_model": True, "have_model": True}, "derive_from_footage"),
    ({"needs_model": True, "have_model": False, "multi_need": True}, "shared_reference"),
    ({"needs_model": True, "have_model": False, "multi_need": False}, "text_only"),
    ({}, "direct"),
))
STRATEGY = DecisionTable("match_strategy", ("score",), (({"score": (0.80, 1.01)}, "direct_cut"), ({"score": (0.55, 0.80)}, "edit"), ({}, "regenerate")))
AUDIO = DecisionTable("reference_audio", ("user_bgm", "ref_bgm", "ref_speech", "bgm_is_music"), (
    ({"user_bgm": True}, "user"),
    ({"user_bgm": False, "ref_bgm": False}, "none"),
    ({"user_bgm": False, "ref_bgm": True, "bgm_is_music": False}, "none"),
    ({"user_bgm": False, "ref_bgm": True, "ref_speech": False}, "whole_track"),
    ({"user_bgm": False, "ref_bgm": True, "ref_speech": True}, "separated"),
    ({}, "none"),
))
SUBTITLES = DecisionTable("subtitles", ("config", "ref_has_caps", "has_ref", "style_tool"), (
    ({"config": "off"}, "none"),
    ({"config": "follow", "ref_has_caps": False}, "none"),
    ({"has_ref": True, "style_tool": True}, "clone"),
    ({}, "basic"),
))
NARRATION = DecisionTable("narration", ("ref_has_speech",), (({"ref_has_speech": False}, "no_lines"), ({}, "write_lines")))
TABLES = (CLIP, GAP, STRATEGY, AUDIO, SUBTITLES, NARRATION)
VOICE_PRIORITY = ("user_original", "ai_piece", "user_muted")


def decide_by_join(df: DataFrame, rules: DataFrame, key: str, fields: list[str], most: int = 100_000) -> DataFrame:
    """The same semantics for a table of rules (rule_row, action, and per field f the columns f, or f_lo and f_hi).

    The rules are broadcast up to ``most`` rows; beyond, Spark picks the join. Rows of df are
    told apart by key, which must be unique. A row that no rule fits has nulls.
    """
    r = F.broadcast(rules) if rules.count() <= most else rules
    r = r.select([F.col(c).alias(f"_r_{c}") for c in rules.columns])
    test = F.lit(True)
    for f in fields:
        if f in rules.columns:
            test = test & (F.col(f"_r_{f}").isNull() | F.coalesce(F.col(f"_r_{f}") == F.col(f), F.lit(False)))
        else:
            lo, hi = F.col(f"_r_{f}_lo"), F.col(f"_r_{f}_hi")
            test = test & (lo.isNull() | F.coalesce((F.col(f) >= lo) & (F.col(f) < hi), F.lit(False)))
    hit = df.select(key, *fields).join(r, test).groupBy(key).agg(F.min(F.struct(F.col("_r_rule_row"), F.col("_r_action"))).alias("_hit"))
    return df.join(hit, key, "left").select(*df.columns, F.col("_hit._r_rule_row").alias("hit_row"), F.col("_hit._r_action").alias("action"))


def pick_by_priority(available: Column, order: tuple[str, ...] = VOICE_PRIORITY, otherwise: str = "all_ai") -> Column:
    """struct<action, hit_row>: the first of order that the array holds, else otherwise with -1."""
    out = None
    for k, name in enumerate(order):
        case = F.struct(F.lit(name).alias("action"), F.lit(k).alias("hit_row"))
        test = F.coalesce(F.array_contains(available, name), F.lit(False))
        out = F.when(test, case) if out is None else out.when(test, case)
    return out.otherwise(F.struct(F.lit(otherwise).alias("action"), F.lit(-1).alias("hit_row")))


def coverage_holes(spark, table: DecisionTable) -> DataFrame:
    """Combinations of the values a table names (and null) that reach only its last row.

    Tables with ranges have none. The product of a table's own few values is all there is.
    """
    ranges = any(isinstance(v, tuple) for when, _ in table.rows for v in when.values())
    values = {f: sorted({str(when[f]) for when, _ in table.rows if when.get(f) is not None}) for f in table.fields}
    domains = [[("true" if v == "True" else "false" if v == "False" else v) for v in values[f]] + (["false"] if values[f] == ["True"] else ["true"] if values[f] == ["False"] else []) for f in table.fields]
    combos = [] if ranges else list(product(*domains))
    df = spark.createDataFrame(combos or [tuple([None] * len(table.fields))], ", ".join(f"`{f}` string" for f in table.fields)).limit(len(combos))
    facts = {f: (F.col(f).cast("boolean") if set(domains[i]) <= {"true", "false"} else F.col(f)) for i, f in enumerate(table.fields)}
    return df.withColumn("d", table.decide(facts)).filter(F.col("d.hit_row") == len(table.rows) - 1).select(F.lit(table.name).alias("table"), F.to_json(F.struct(*table.fields)).alias("facts"))


def observed_holes(df: DataFrame, table: DecisionTable, facts: dict[str, Column]) -> DataFrame:
    """table, facts, n: which facts that rows of df have meet no row of the table but the last, and how many rows have them. Facts are told by name, null as null."""
    told = F.concat_ws(", ", *[F.concat(F.lit(f"{f}="), F.coalesce(facts[f].cast("string"), F.lit("null"))) for f in table.fields])
    met = df.select(table.decide(facts)["hit_row"].alias("_hit"), told.alias("facts"))
    return met.filter(F.col("_hit") == len(table.rows) - 1).groupBy("facts").agg(F.count("*").alias("n")).select(F.lit(table.name).alias("table"), "facts", "n")


# The gates' limits.
SILENT_DB, VOICE_MIN_DB, MUSIC_COVER, MUSIC_RUN, MUSIC_FLATNESS = -45.0, -38.0, 0.5, 5.0, 0.35


def has_sound(db: Column) -> Column:
    return db > SILENT_DB


def clone_base(db: Column) -> Column:
    return db > VOICE_MIN_DB


def is_music(active_ratio: Column, longest_run: Column, flatness: Column, duration: Column) -> Column:
    return (active_ratio >= MUSIC_COVER) & (longest_run >= F.least(F.lit(MUSIC_RUN), 0.6 * duration)) & (flatness <= MUSIC_FLATNESS)


def gate_report(name: str, passed: Column, policy: str, metrics: dict[str, Column], used: Column | None = None) -> Column:
    """struct<gate, passed, policy, ok, used, metrics>: passed keeps null, ok folds it by the policy."""
    return F.struct(
        F.lit(name).alias("gate"), passed.alias("passed"), F.lit(policy).alias("policy"), F.coalesce(passed, F.lit(policy == "pass")).alias("ok"),
        (F.lit(True) if used is None else used).alias("used"), F.create_map(*[x for k, v in metrics.items() for x in (F.lit(k), v.cast("double"))]).alias("metrics"),
    )


def told_gate(gate: Column, criterion: Column, missing: Column, failed: Column | None = None) -> Column:
    """A gate's report with criterion (what was measured against what limit) and reason (why nothing was).

    Where ``missing`` names an object that is not there, or ``failed`` says why a probe failed (120 characters of it), the gate is undecided: it has no metrics and no
    criterion, and is folded by its policy.
    """
    broken = F.lit(None).cast("string") if failed is None else F.concat(F.lit("探测失败："), F.substring(failed, 1, 120))
    reason = F.when(missing.isNotNull(), F.concat(F.lit("文件不存在："), F.when(missing == "", "(空)").otherwise(missing))).otherwise(broken)
    open_ = reason.isNotNull()
    passed = F.when(~open_, gate["passed"])
    return F.struct(
        gate["gate"].alias("gate"), passed.alias("passed"), gate["policy"].alias("policy"), F.coalesce(passed, gate["policy"] == "pass").alias("ok"), gate["used"].alias("used"),
        F.when(~open_, gate["metrics"]).alias("metrics"), F.when(~open_, criterion).alias("criterion"), reason.alias("reason"),
    )


def loudness_criterion(db: Column, limit: float, name: str) -> Column:
    return F.format_string(f"平均响度 %.1f dB（{name} %.0f）", db.cast("double"), F.lit(limit))


def music_criterion(active_ratio: Column, longest_run: Column, flatness: Column, duration: Column) -> Column:
    run = F.least(F.lit(MUSIC_RUN), 0.6 * duration)
    return F.format_string("占比%.2f≥%.2f、连续%.1fs≥%.1fs、平坦度%.2f≤%.2f", active_ratio, F.lit(MUSIC_COVER), longest_run, run, flatness, F.lit(MUSIC_FLATNESS))


def gate_violations(df: DataFrame, *gates: str) -> DataFrame:
    """Rows of df, one per gate that failed (not undecided) and was used all the same."""
    exploded = df.withColumn("_gate", F.explode(F.array(*[F.col(g) for g in gates])))
    return exploded.filter(~F.col("_gate.passed") & F.col("_gate.used"))


def override_parameters(verdict: Column, note: Column) -> Column:
    """The verdict with forced dubbing; the action it had stays in the trace."""
    return verdict.withField("forced_from", verdict["action"]).withField("action", F.lit("mute_and_dub")).withField("note", note)


def nested_violations(df: DataFrame, document: str) -> DataFrame:
    """df with path: one row per object in a JSON document, at any depth, whose "passed" is false and whose "used" is true.

    The document is walked as a VARIANT, a level of all rows at a time, until no row has anything below. Each level is written before the next is made from it, so
    a level is parsed once however deep the documents are. Paths name fields, and [] stands for any place in a list.
    """
    from tessera.plans.tables import written

    names = [c for c in df.columns if c != "path"]
    told = [F.col(f"`{c}`") for c in names]
    level = df.select(*told, F.try_parse_json(document).cast("string").alias("_v"), F.lit("").alias("path"))
    found = []
    while True:
        level = written(level.select(*told, "_v", "path"))
        if level.isEmpty():
            break
        v = F.try_parse_json("_v")
        flag = lambda name: F.try_variant_get(v, f"$.{name}", "boolean")  # noqa: E731, B023
        found.append(level.filter((~flag("passed")) & flag("used")).select(*told, F.regexp_replace("path", "^[.]", "").alias("path")))
        fields = F.transform(F.map_entries(F.try_variant_get(v, "$", "map<string,variant>")), lambda e: F.struct(F.concat(F.lit("."), e["key"]).alias("step"), F.to_json(e["value"]).alias("v")))
        places = F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda e: F.struct(F.lit("[]").alias("step"), F.to_json(e).alias("v")))
        below = level.select(*told, "path", F.explode(F.coalesce(fields, places)).alias("_e"))
        nested = F.substring(F.ltrim("_e.v"), 1, 1).isin("{", "[")
        level = below.filter(nested).select(*told, F.col("_e.v").alias("_v"), F.concat("path", F.col("_e.step")).alias("path"))
    return reduce(DataFrame.unionByName, found) if found else df.select(*told, F.lit("").alias("path")).limit(0)


def assemble_facts(rows: DataFrame, sources: list[DataFrame], keys: list[str], facts: dict[str, list[str]]) -> DataFrame:
    """rows with one column per fact: the first filled of its columns, in order, over rows and the sources joined to them; null where none knows.

    Each source has one row per key at most. A column that several hold is told apart by its place: "0.name" is that of the first source.
    """
    x = rows
    for k, source in enumerate(sources):
        x = x.join(source.select(*keys, *[F.col(c).alias(f"_{k}_{c}") for c in source.columns if c not in keys]), keys, "left")
    of = lambda c: F.col("_" + c.replace(".", "_", 1)) if c[:1].isdigit() else F.col(c)
    return x.select(*rows.columns, *[F.coalesce(*[of(c) for c in cs]).alias(name) for name, cs in facts.items()])
