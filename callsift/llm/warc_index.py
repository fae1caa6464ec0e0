"""WARC archives with payload revisits, and a globally ordered capture index.

Writing: every page is one WARC/1.1 record, built as text and written by
Spark's own writer (gzip), so any store and a lost executor are handled by its
commit protocol. A response record holds the HTTP head and the payload; a
revisit record (equal payload of at least MIN_BYTES bytes, seen at a smaller
id) holds the HTTP head alone, whose Content-Length tells the payload's size.

Reading: archive files are parsed record by record. Each file gives a capture
run, sorted by (URL key, timestamp, id).

Index merge: runs are range-partitioned by that whole key (so one hot URL is
split, too); each range merges its slices of the k runs with a loser tree. The
ranges in order are the global capture history.

Defined results: a null html is an empty payload; a null url is a record
without a target; a null id is a record of its own that is never the smallest
of a group unless all ids are null (then all are responses); rows with the same
smallest id are all responses; a very large payload makes archives of fewer
records (each is read back as one value, so one page may have up to 1 GB); an
empty table gives no rows.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import re
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callsift.llm.work import Work

MIN_BYTES = 100
# An archive holds at most so many records, and fewer if the largest of them
# could make it larger than ARCHIVE_BYTES: files are read back as one value.
RECORDS_PER_FILE = 10_000
ARCHIVE_BYTES = 1 << 30
RANGE_CAPTURES = 200_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CAPTURE = ("url_key string, captured_at string, page_id long, url string, record_type string, payload_digest string, "
           "payload_bytes long, refers_to long, archive string, place long")


def records(pages: DataFrame, captured_at: Column) -> DataFrame:
    """(value): the text of each page's record, without the blank lines that end it."""
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                     F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"),
                     F.date_format(captured_at, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("at"))
    p = p.withColumn("digest", F.sha2("html", 256)).withColumn("bytes", F.octet_length("html"))
    first = (p.filter(F.col("bytes") >= MIN_BYTES).groupBy("digest")
             .agg(F.min("page_id").alias("low"), F.count(F.lit(1)).alias("c")).filter("c > 1 AND low IS NOT NULL")
             .select("digest", "low"))
    p = p.join(first, "digest", "left")
    revisit = F.col("low").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("low"))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                    F.col("bytes").cast("string"), F.lit("\r\n\r\n"))
    p = p.withColumn("block", F.when(revisit, head).otherwise(F.concat(head, F.col("html"))))
    # a header line cannot hold white space at its ends or control characters
    target = F.when(F.col("url").isNull(), "").otherwise(F.concat(
        F.lit("WARC-Target-URI: "), F.regexp_replace("url", r"[\x00-\x20\x7f]", "%20"), F.lit("\r\n")))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">\r\n"))
    return p.select(F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: "), urn(F.col("page_id")),
        F.lit("WARC-Date: "), F.col("at"), F.lit("\r\n"), target,
        F.lit("WARC-Payload-Digest: sha256:"), F.col("digest"), F.lit("\r\n"),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), urn(F.col("low")),
                                 F.lit(f"WARC-Profile: {PROFILE}\r\n"))).otherwise(""),
        F.lit("Content-Type: application/http;msgtype=response\r\nContent-Length: "),
        F.octet_length("block").cast("string"), F.lit("\r\n\r\n"), F.col("block")).alias("value"))


def write_archives(pages: DataFrame, captured_at: Column, path: str, records_per_file: int = RECORDS_PER_FILE) -> None:
    largest = pages.agg(F.max(F.octet_length(F.col("html").cast("string")) + 3 * F.coalesce(
        F.octet_length(F.col("url").cast("string")), F.lit(0)))).first()[0] or 0
    records_per_file = max(1, min(records_per_file, ARCHIVE_BYTES // (largest + 2048)))
    (records(pages, captured_at).write.option("lineSep", "\r\n\r\n").option("compression", "gzip")
     .option("maxRecordsPerFile", records_per_file).text(path))


def parse(stream: Any):
    """(offset, header fields, block) of every record of an archive, in order."""
    at = 0
    while True:
        line = stream.readline()
        if not line:
            return
        if line != b"WARC/1.1\r\n":
            raise ValueError(f"no WARC record at byte {at}")
        size, fields = len(line), {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            size += len(line)
            name, _, value = line.decode().partition(":")
            fields[name.strip().lower()] = value.strip()
        n = int(fields["content-length"])
        block = stream.read(n)
        if len(block) != n or stream.read(4) != b"\r\n\r\n":
            raise ValueError(f"the WARC record at byte {at} is cut off")
        yield at, fields, block
        at += size + len(line) + n + 4


def url_key(url: str | None) -> str:
    """The URL with its host reversed, for sorting: com,example)/path."""
    m = re.match(r"[^:/?#]*://([^/?#]*)(.*)", url or "", re.S)
    if not m:
        return url or ""
    return ",".join(reversed(m[1].lower().split("."))) + ")" + m[2]


def _number(urn: str | None) -> int | None:
    m = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
    return int(m[1]) if m else None


def capture(offset: int, fields: dict, block: bytes, archive: str) -> dict:
    """The index entry of a record; a response's payload is hashed anew."""
    head, _, payload = block.partition(b"\r\n\r\n")
    digest = fields["warc-payload-digest"].removeprefix("sha256:")
    if fields["warc-type"] == "response":
        size = len(payload)
        if hashlib.sha256(payload).hexdigest() != digest:
            raise ValueError(f"payload of the record at byte {offset} of {archive} does not match its digest")
    else:
        size = int(re.search(rb"(?im)^content-length:\s*(\d+)", head)[1])
    url = fields.get("warc-target-uri")
    return {"url_key": url_key(url), "captured_at": fields["warc-date"], "page_id": _number(fields["warc-record-id"]),
            "url": url, "record_type": fields["warc-type"], "payload_digest": digest, "payload_bytes": size,
            "refers_to": _number(fields.get("warc-refers-to")), "archive": archive, "place": offset}


def sort_key(c: dict) -> tuple:
    return (c["url_key"], c["captured_at"], c["page_id"] is not None, c["page_id"] or 0, c["archive"], c["place"])


def read_runs(df: DataFrame) -> DataFrame:
    """Captures of archive files (path, content), each file a sorted run."""
    def run(batches):
        for b in batches:
            for path, content in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
                name = path.rsplit("/", 1)[-1]
                with gzip.GzipFile(fileobj=io.BytesIO(content.as_buffer())) as f:
                    found = sorted((capture(at, h, block, name) for at, h, block in parse(f)), key=sort_key)
                if found:
                    yield pa.RecordBatch.from_pydict(
                        {k: pa.array([c[k] for c in found], pa.int64() if isinstance(found[0][k], int) or k in (
                            "page_id", "refers_to") else pa.string()) for k in found[0]})

    return df.select("path", "content").mapInArrow(run, CAPTURE)


class LoserTree:
    """Merges k sorted runs: inner nodes hold the losers of the matches below,
    so the next smallest entry costs one match per level."""

    def __init__(self, runs: list[list[tuple]]):
        self.runs, self.at = runs, [0] * len(runs)
        self.tree = [-1] * max(1, len(runs))
        for i in range(len(runs)):
            self._play(i)

    def _beats(self, a: int, b: int) -> bool:
        """Whether run a's next entry comes before run b's; ended runs lose."""
        if self.at[a] >= len(self.runs[a]):
            return False
        if self.at[b] >= len(self.runs[b]):
            return True
        x, y = self.runs[a][self.at[a]], self.runs[b][self.at[b]]
        return x < y or (x == y and a < b)

    def _play(self, i: int) -> None:
        node = (i + len(self.runs)) // 2
        while node > 0:
            other = self.tree[node]
            if other == -1:  # the first to arrive waits for its match
                self.tree[node] = i
                return
            if self._beats(other, i):
                self.tree[node], i = i, other
            node //= 2
        self.tree[0] = i

    def __iter__(self):
        for _ in range(sum(map(len, self.runs))):
            i = self.tree[0]
            yield self.runs[i][self.at[i]]
            self.at[i] += 1
            self._play(i)


def merge_runs(captures: DataFrame, ranges: int) -> DataFrame:
    """All captures in global order: range by range, each merged from its
    slices of the archives' runs."""
    names = captures.columns

    def merge(batches):
        runs: dict[str, list[tuple]] = {}
        for b in batches:
            for c in b.to_pylist():
                runs.setdefault(c["archive"], []).append((sort_key(c), tuple(c[k] for k in names)))
        for own in runs.values():
            own.sort()  # fetched blocks may arrive out of order; sorted slices cost one pass
        rows = []
        for _, row in LoserTree([runs[k] for k in sorted(runs)]) if runs else ():
            rows.append(row)
            if len(rows) == 5000:
                yield batch(rows)
                rows = []
        yield batch(rows)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True)) or [()] * len(names)
        kinds = [pa.int64() if k in ("page_id", "payload_bytes", "refers_to", "place") else pa.string() for k in names]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    return captures.repartitionByRange(
        ranges, "url_key", "captured_at", F.col("page_id").asc_nulls_first(), "archive", "place").mapInArrow(merge, CAPTURE)


def archive_and_index(pages: DataFrame, captured_at: Column, records_per_file: int = RECORDS_PER_FILE,
                      range_captures: int = RANGE_CAPTURES, work: Work | None = None) -> DataFrame:
    """Write the archives, read them back, and return the merged index, one
    row per page: url_key, captured_at, page_id, url, record_type,
    payload_digest, payload_bytes, refers_to, archive, place (byte offset in
    the uncompressed archive)."""
    spark = pages.sparkSession
    work = work or Work(spark, "warc")
    write_archives(pages, captured_at, work.path("archives"), records_per_file)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(work.path("archives"))
    runs = work.table(read_runs(files), "runs")
    return merge_runs(runs, max(1, -(-runs.count() // range_captures)))
