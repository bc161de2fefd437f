"""WARC archives with revisit records, and a merged index of all captures.

``write_archive`` finds equal payloads by their SHA-1 digest, writes a response record
for one capture of each and revisit records for the others, in archive files of about 64 MB.
``read_archive`` reads the files back. ``capture_index`` is the external index merge:
each archive file yields a run of index entries, sorted by URL key and timestamp, and the runs
are written. They are then dealt out by ranges of (URL key, timestamp, record) of about
``range_rows`` entries, and each range merges with a loser tree the sorted stretches that reach
it. Nothing is sorted again: a shuffle delivers each run's part as it was written, so a new
stretch begins only where an entry is smaller than the one before. The ranges in order, with the
number of entries before each, give every capture its place in the whole archive. A URL
captured very often is split over ranges, as the timestamp and the record id are part of the key.

Records are plain WARC/1.1, one after the other. The text sink writes a task's record
chunks byte by byte; each chunk leaves its last line feed to the sink.

Defined results: a null html is an empty payload; null url and page_id are written as
empty fields and read back as null; where rows repeat the winning page_id, each of
them is a response, and equal entries keep the order of their files; a very long html is one
record of its own chunk; columns other than page_id, url and html, however they are called, are
ignored; an empty table writes no records.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from datetime import UTC, datetime, timedelta

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import materialize, rows_of, shared_dir, tidy

EPOCH = datetime(2024, 1, 1, tzinfo=UTC)
RECORD = "page_id long, url string, urlkey string, date string, record_type string, refers_to long, payload_digest string, payload_bytes long, file string, offset long, length long"
INDEX_KEYS = ("urlkey", "date", "page_id")


def url_key(url: str | None) -> str:
    """The sortable form of a URL: host labels reversed, no scheme, www, port, user or fragment; path and query in lower case."""
    if not url:
        return ""
    m = re.match(r"(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://(?:[^/@?#]*@)?([^/:?#]*)(?::\d+)?)?([^#]*)", url)
    host, rest = (m[1] or "").lower(), (m[2] or "/").lower()
    host = host.removeprefix("www.")
    return ",".join(reversed(host.split("."))) + ")" + (rest if rest.startswith("/") else "/" + rest)


def base32_digest(sha1_hex: str) -> str:
    return base64.b32encode(bytes.fromhex(sha1_hex)).decode("ascii")


def record_bytes(page_id: int | None, url: str | None, date: str, kind: str, refers_to: int | None, digest: str, n_bytes: int, payload: bytes) -> bytes:
    """One WARC record; a revisit keeps the payload's length in its HTTP header and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()
    body = http if kind == "revisit" else http + payload
    target = "" if url is None else re.sub(r"[\r\n]", lambda m: f"%{ord(m[0]):02X}", url)
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {date}",
        f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}",
    ]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + body + b"\r\n\r\n"


def records_of(data: bytes) -> Iterator[tuple[dict[str, str], bytes, int, int]]:
    """(header fields, block, offset, length) of each record in an archive file."""
    at = 0
    while at < len(data):
        stop = data.index(b"\r\n\r\n", at)
        version, *lines = data[at:stop].decode("utf-8", "surrogatepass").split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"no record at {at}")
        head = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines)
        begin = stop + 4
        end = begin + int(head["Content-Length"])
        yield head, data[begin:end], at, end + 4 - at
        at = end + 4


def write_archive(pages: DataFrame, path: str, least_bytes: int = 0, chunk_bytes: int = 8 << 20, file_chunks: int = 8, broadcast_copies: int = 300_000) -> None:
    """Write page_id, url, html as WARC files; payloads of at least least_bytes are stored once.

    The digests that occur more than once are broadcast up to broadcast_copies of them (20 MB),
    so that payloads stay where they were read; beyond, both sides are shuffled. A file is closed
    after file_chunks chunks, so the largest is about as large as its chunks, or as its largest record.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload")).withColumn("sha1", F.sha1("payload")).withColumn("n_bytes", F.octet_length("payload").cast("long"))
    # page_ids only, and counted before they are shuffled
    copies = rows.filter(F.col("n_bytes") >= least_bytes).groupBy("sha1").agg(F.max("page_id").alias("first_id"), F.count("*").alias("n")).filter("n > 1").select("sha1", "first_id")
    copies = materialize(copies, "copies")
    copies = F.broadcast(copies) if copies.count() <= broadcast_copies else copies
    kinds = rows.join(copies, "sha1", "left")
    # each file holds pages of all ranges of URLs, as a crawler would write them
    kinds = kinds.select("page_id", "url", "payload", "sha1", "n_bytes", F.when(F.col("first_id") > F.col("page_id"), F.col("first_id")).alias("refers_to"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[bytes] = []
        held = 0

        def chunk() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([b"".join(out)[:-1]], pa.binary())], names=["chunk"])

        for batch in batches:
            for page_id, url, body, sha1, n, refers in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                date = (EPOCH + timedelta(seconds=(page_id or 0) % (1 << 31))).strftime("%Y-%m-%dT%H:%M:%SZ")
                record = record_bytes(page_id, url, date, "response" if refers is None else "revisit", refers, base32_digest(sha1), n, body)
                out.append(record)
                held += len(record)
                if held >= chunk_bytes:
                    yield chunk()
                    out, held = [], 0
        if out:
            yield chunk()

    kinds.mapInArrow(tidy(write), "chunk binary").select(F.col("chunk").cast("string").alias("value")).write.option("maxRecordsPerFile", file_chunks).text(path)


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """One row per record: its fields, and where it lies. Both digest and length are of the full payload."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def number(field: str) -> int | None:
        m = re.fullmatch(r"<urn:page:(-?\d+)>", field)
        return int(m[1]) if m else None

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in rows_of(batch, 1):
                rows = []
                for head, block, offset, length in records_of(data):
                    if (kind := head["WARC-Type"]) == "revisit":
                        n = int(re.search(rb"(?im)^content-length: (\d+)", block)[1])
                    else:
                        n = len(block) - block.index(b"\r\n\r\n") - 4
                    url = head["WARC-Target-URI"]
                    rows.append((number(head["WARC-Record-ID"]), url or None, url_key(url), head["WARC-Date"], kind, number(head.get("WARC-Refers-To", "")), head["WARC-Payload-Digest"].removeprefix("sha1:"), n, name.rsplit("/", 1)[-1], offset, length))
                # an archive file's entries are one run, in the order of the index
                rows.sort(key=lambda r: (r[2], r[3], r[0] is not None, r[0] or 0))
                for lo in range(0, len(rows), 5000):
                    yield _records(rows[lo : lo + 5000])

    return files.mapInArrow(tidy(read), RECORD)


def _records(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string()}
    fields = [f.split() for f in RECORD.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[t]) for i, (_, t) in enumerate(fields)], names=[n for n, _ in fields])


class LoserTree:
    """Merges sorted runs; each step replays one path of about log2(k) matches."""

    def __init__(self, runs: list[list[tuple]]):
        self.runs, self.k = runs, max(1, len(runs))
        self.at = [0] * self.k
        self.loser = [-1] * self.k
        self.winner = self._build(1) if runs else -1

    def _head(self, run: int) -> tuple | None:
        return self.runs[run][self.at[run]] if self.at[run] < len(self.runs[run]) else None

    def _beats(self, a: int, b: int) -> bool:
        x, y = self._head(a), self._head(b)
        return y is None or x is not None and (x, a) <= (y, b)

    def _build(self, node: int) -> int:
        if node >= self.k:
            return node - self.k
        a, b = self._build(2 * node), self._build(2 * node + 1)
        win, self.loser[node] = (a, b) if self._beats(a, b) else (b, a)
        return win

    def __iter__(self) -> Iterator[tuple]:
        while self.runs and (head := self._head(self.winner)) is not None:
            yield head
            run = self.winner
            self.at[run] += 1
            node = (run + self.k) // 2
            while node:
                if not self._beats(run, self.loser[node]):
                    run, self.loser[node] = self.loser[node], run
                node //= 2
            self.winner = run


def sorted_stretches(rows: Iterator[tuple]) -> list[list[tuple]]:
    """The rows (key, ...) cut wherever a key is smaller than the one before."""
    out: list[list[tuple]] = []
    for row in rows:
        if out and out[-1][-1][0] <= row[0]:
            out[-1].append(row)
        else:
            out.append([row])
    return out


def capture_index(records: DataFrame, range_rows: int = 50_000) -> DataFrame:
    """records, which must be cheap to read twice (a written table), with position: each capture's place in the order of URL key, timestamp and page_id, from 0."""
    ranges = max(1, -(-records.count() // range_rows))
    names = [f.split()[0] for f in RECORD.split(", ")]
    at = {n: i for i, n in enumerate(names)}
    dealt = records.select(*names).repartitionByRange(ranges, *[F.col(c).asc_nulls_first() for c in (*INDEX_KEYS, "file", "offset")])

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for row in rows_of(batch, 5000):
                page_id = row[at["page_id"]]
                yield (row[at["urlkey"]], row[at["date"]], page_id is not None, page_id or 0, row[at["file"]], row[at["offset"]]), row

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        where, n, out = TaskContext.get().partitionId(), 0, []
        for _, row in LoserTree(sorted_stretches(keyed(batches))):
            out.append((*row, where, n))
            n += 1
            if len(out) == 5000:
                yield _indexed(out)
                out = []
        if out:
            yield _indexed(out)

    def _indexed(rows: list[tuple]) -> pa.RecordBatch:
        body = _records([r[:-2] for r in rows])
        return pa.RecordBatch.from_arrays([*body.columns, pa.array([r[-2] for r in rows], pa.int32()), pa.array([r[-1] for r in rows], pa.int64())], names=[*names, "range_no", "place"])

    merged = materialize(dealt.mapInArrow(tidy(merge), f"{RECORD}, range_no int, place long"), "merged")
    # one row per range of range_rows captures
    sizes = merged.groupBy("range_no").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("range_no", before.alias("_before"))
    starts = F.broadcast(starts) if ranges <= 500_000 else starts
    return merged.join(starts, "range_no").select(*names, (F.col("_before") + F.col("place")).alias("position"))


def archive_pages(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write the archive into the shared folder, read it back and merge its index."""
    spark = pages.sparkSession
    path = shared_dir(spark, "warc")
    write_archive(pages, path, least_bytes)
    return capture_index(materialize(read_archive(spark, path), "captures"))
