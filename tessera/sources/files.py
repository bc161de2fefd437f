"""Readers and writers for the documents around a timeline: JSON records, media files, subtitles and reports.

All readers go through Spark's own sources, so any file system Spark knows will do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.functions.scalars import format_ass, format_srt, parse_timecode

# What counts as which kind of media.
MEDIA = {"video": ("mp4", "mov", "mkv", "webm", "avi", "m4v"), "image": ("jpg", "jpeg", "png", "webp", "bmp"), "audio": ("mp3", "wav", "m4a", "aac", "flac", "ogg")}


def read_json_documents(spark: SparkSession, path: str, schema: StructType, bad: str = "_corrupt") -> DataFrame:
    """One row per JSON file, with its path; a file that is no such document has nulls and its text in ``bad``."""
    s = StructType([*schema.fields]).add(bad, "string")
    return spark.read.schema(s).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", bad).json(path).withColumn("path", F.input_file_name())


def read_json_lines(spark: SparkSession, path: str, schema: StructType, bad: str = "_corrupt") -> DataFrame:
    """One row per line of JSON; a line that is no such document has nulls and its text in ``bad``."""
    s = StructType([*schema.fields]).add(bad, "string")
    return spark.read.schema(s).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", bad).json(path)


def write_json_documents(df: DataFrame, path: str) -> None:
    """The committer publishes all files or none."""
    df.write.mode("overwrite").json(path)


def task_catalog(records: DataFrame, columns: list[str], most: int = 50) -> DataFrame:
    """The newest records by path; unreadable ones are skipped."""
    return records.filter("_corrupt is null").orderBy(F.desc("path")).limit(most).select(*columns)


def scan_media(spark: SparkSession, path: str) -> DataFrame:
    """path, name, media, size, modified of every media file below path; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).drop("content")
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    kind = F.coalesce(*[F.when(ext.isin(*e), F.lit(k)) for k, e in MEDIA.items()])
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), kind.alias("media"), F.col("length").alias("size"), F.col("modificationTime").alias("modified")).filter("media is not null")


#: Parts of a sound file that are looked through; real files have a handful.
MOST_CHUNKS = 1000


def _number(content: Column, at: Column, size: int) -> Column:
    """The unsigned number of so many bytes, the low one first, at a place counted from 0; null behind the end."""
    h = F.hex(F.substring(content, (at + 1).cast("int"), F.lit(size)))
    bytes_ = F.concat(*[F.substring(h, 2 * k + 1, 2) for k in reversed(range(size))])
    return F.when(F.length(h) == 2 * size, F.conv(bytes_, 16, 10).cast("long"))


def wav_duration(content: Column) -> Column:
    """Seconds of a WAV file, from its format and data chunks; null where one is missing, the rate is 0 or the file is none.

    Plain PCM has as many frames as the data chunk says; of other formats the data that is there counts, by the bytes a second. The chunks are walked inside of
    Spark, so the samples never leave it.
    """
    end = F.octet_length(content)
    begin = F.struct(F.lit(12).cast("long").alias("at"), F.lit(None).cast("long").alias("fmt"), F.lit(None).cast("long").alias("data"), F.lit(None).cast("long").alias("size"))

    def walk(a: Column, _: Column) -> Column:
        size = _number(content, a["at"] + 4, 4)
        kind = F.hex(F.substring(content, (a["at"] + 1).cast("int"), F.lit(4)))
        seen = a["data"].isNotNull() | (a["at"] + 8 > end)
        fmt = F.when(~seen & (kind == F.hex(F.lit("fmt "))), a["at"] + 8).otherwise(a["fmt"])
        data = ~seen & (kind == F.hex(F.lit("data"))) & fmt.isNotNull()
        return F.struct(F.when(seen, a["at"]).otherwise(a["at"] + 8 + size + size % 2).alias("at"), fmt.alias("fmt"), F.when(data, a["at"] + 8).otherwise(a["data"]).alias("data"), F.when(data, size).otherwise(a["size"]).alias("size"))

    steps = F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.lit(MOST_CHUNKS), F.floor(end / 8).cast("int"))))

    def told(a: Column) -> Column:
        kind, rate, per_second = _number(content, a["fmt"], 2), _number(content, a["fmt"] + 4, 4), _number(content, a["fmt"] + 8, 4)
        frame = _number(content, a["fmt"] + 2, 2) * F.floor((_number(content, a["fmt"] + 14, 2) + 7) / 8)
        plain = F.floor(F.try_divide(a["size"], frame)) / F.nullif(rate, F.lit(0).cast("long"))
        return F.when(kind == 1, plain).otherwise(F.least(a["size"], end - a["data"]) / F.nullif(per_second, F.lit(0).cast("long")))

    riff = (F.hex(F.substring(content, 1, 4)) == F.hex(F.lit("RIFF"))) & (F.hex(F.substring(content, 9, 4)) == F.hex(F.lit("WAVE")))
    return F.when(riff, F.aggregate(steps, begin, walk, told))


def probe_duration(text: Column) -> Column:
    """Seconds from a media tool's "Duration: h:mm:ss.cc"."""
    d = F.regexp_extract(text, r"Duration:\s*([0-9:.]+)", 1)
    return F.when(d == "", F.lit(None).cast("double")).otherwise(parse_timecode(d))


def probe_media(text: Column) -> Column:
    """struct<seconds, has_audio, width, height> from a media tool's text; what it doesn't say is null, but no audio stream is false."""
    size = lambda k: F.regexp_extract(text, r"Video:[^\n]*?\b(\d{2,5})x(\d{2,5})\b", k).try_cast("int")
    return F.struct(probe_duration(text).alias("seconds"), F.coalesce(text.rlike(r"Stream [^\n]*Audio:"), F.lit(False)).alias("has_audio"), size(1).alias("width"), size(2).alias("height"))


def read_subtitle_events(spark: SparkSession, path: str) -> DataFrame:
    """path, name, start, end, text of the Dialogue lines of styled-subtitle files; style tags go, line breaks become spaces, an empty name is null."""
    lines = spark.read.text(path).select(F.input_file_name().alias("path"), "value").filter(F.col("value").startswith("Dialogue:"))
    part = F.split(F.substring_index("value", "Dialogue:", -1), ",", 10)
    text = F.trim(F.regexp_replace(F.regexp_replace(F.try_element_at(part, F.lit(10)), r"\{[^}]*\}", ""), r"\\[Nn]", " "))
    return lines.select("path", F.nullif(F.trim(F.try_element_at(part, F.lit(5))), F.lit("")).alias("name"), parse_timecode(F.trim(part[1])).alias("start"), parse_timecode(F.trim(part[2])).alias("end"), text.alias("text")).filter("text is not null")


def srt_cues(df: DataFrame, keys: list[str]) -> DataFrame:
    """keys, cue: SRT text of each row (cue_no, start, end, text)."""
    stamp = F.concat(format_srt(F.col("start")), F.lit(" --> "), format_srt(F.col("end")))
    return df.select(*keys, "cue_no", F.concat_ws("\n", F.col("cue_no").cast("string"), stamp, F.regexp_replace("text", r"\n\s*\n", "\n"), F.lit("")).alias("cue"))


def ass_events(df: DataFrame, keys: list[str], style: str = "Default", name: str | None = None) -> DataFrame:
    """keys, event: Dialogue lines, with braces and line breaks of the text escaped. Their name is what the column ``name`` has, with spaces for commas, so the lines of many recordings can share a file."""
    named = F.regexp_replace(F.coalesce(F.col(name).cast("string"), F.lit("")), r"[,\n]", " ") if name else F.lit("")
    body = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", r"\\", "/"), r"[{}]", ""), "\n", r"\\\\N")
    return df.select(*keys, "start", F.concat_ws(",", F.lit("Dialogue: 0"), format_ass(F.col("start")), format_ass(F.col("end")), F.lit(style), named, F.lit("0"), F.lit("0"), F.lit("0"), F.lit(""), body).alias("event"))


def file_rows(df: DataFrame, line: str, order: list[str], by: str) -> DataFrame:
    """by, value: the text file of each value as a row, its lines in order. For many small files: rows of one table are written and listed at once, and a folder for each file is not."""
    lines = F.array_sort(F.collect_list(F.struct(*order, F.col(line).alias("_line"))))
    return df.groupBy(by).agg(F.concat(F.array_join(F.transform(lines, lambda r: r["_line"]), "\n"), F.lit("\n")).alias("value"))


def write_lines(df: DataFrame, path: str, line: str, order: list[str], by: str | None = None) -> None:
    """Text files in order: range-sorted, so the part files in turn are the whole; with ``by`` a folder per value, each in order."""
    if by:
        df.repartition(by).sortWithinPartitions(by, *order).select(by, F.col(line).alias("value")).write.partitionBy(by).mode("overwrite").text(path)
    else:
        df.orderBy(*order).select(F.col(line).alias("value")).write.mode("overwrite").text(path)


def markdown_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """line: rows of a Markdown table; a table's head is markdown_head()."""
    cell = [F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"[|\n]", " ") for c in columns]
    return df.select("*", F.concat(F.lit("| "), F.concat_ws(" | ", *cell), F.lit(" |")).alias("line"))


def markdown_head(columns: list[str]) -> str:
    return "| " + " | ".join(columns) + " |\n| " + " | ".join("---" for _ in columns) + " |"


def provenance_reports(sections: DataFrame, key: str, unread: str | None = None) -> DataFrame:
    """key, report: one Markdown document for each task from its sections (key, section_no, title, lines, error), in order of number.

    A section with an error is a line that says so (160 characters of it), and costs none of the others; sections without lines and error are left out. Where the column ``unread``
    holds an error of reading the task itself, the report is that alone (300 characters). Trailing white space goes, and the document ends with a line break.
    """
    failed = F.concat(F.lit("> （"), F.col("title"), F.lit(" 章节生成失败："), F.substring("error", 1, 160), F.lit("）"))
    lines = F.when(F.col("error").isNotNull(), F.array(F.lit(""), failed)).otherwise(F.coalesce("lines", F.array().cast("array<string>")))
    whole = F.array_join(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("section_no", lines.alias("l")))), lambda s: s["l"])), "\n", "")
    text = F.concat(F.rtrim(F.regexp_replace(whole, r"\s+$", "")), F.lit("\n"))
    if unread:
        why = F.min(unread)
        text = F.when(why.isNotNull(), F.concat(F.lit("# 任务报告 "), F.first(F.col(key).cast("string")), F.lit("\n\n> 读取任务产物失败："), F.substring(why, 1, 300), F.lit("\n"))).otherwise(text)
    return sections.groupBy(key).agg(text.alias("report"))
