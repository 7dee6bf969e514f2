"""WARC archives of captured pages and a merged index of their histories.

Writing: one WARC/1.0 record a row; of records with equal payloads of at least
`least_bytes` bytes that of the largest page_id is a response, the others are
revisits of it without a body. Archives are gzipped files written by Spark's own
committer, by class of payload size: those of up to 64 KB so many a file as their
mean size asks for, larger ones so many as their largest does, so that an archive has
about `ARCHIVE_BYTES` and one of large records no more, but for single records of that size. An offset counts the bytes of the unpacked archive.

Reading: every archive is unpacked as a stream and parsed record by record by
Content-Length, payload digests are computed from the bytes read, and the
archive's captures come out sorted by URL key and time: one run. The runs are
dealt out by ranges of (URL key, time, page_id, archive, offset) of about
`RANGE_CAPTURES` rows, and each range merges its parts of the runs with a loser
tree that is fed from iterators over the runs' batches. So the whole is ordered by
URL and time across ranges, and no URL, host or task is held as rows.

Defined cases: a null html is an empty payload; a null url gives a record
without target and an empty URL key; of a null page_id and others with the same
payload the others win; rows that tie for the largest page_id are responses all;
without a page_id the capture time is the epoch of the archive; capture times are
UTC and stay within the years 1 to 9999; no rows give no rows. Only page_id, url
and html are read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
from collections.abc import Iterator
from itertools import islice
from typing import BinaryIO
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lookup, scratch_path, table, written

RECORDS_A_FILE = 5000
ARCHIVE_BYTES = 64 << 20
HEADER_BYTES = 400
#: Payload bytes up to which records share archives, and how many records of the class an archive has (None: by their mean size).
CLASSES = ((64 << 10, None), (1 << 20, 64), (16 << 20, 4), (1 << 62, 1))
RANGE_CAPTURES = 100_000
HELD_ROWS = 1000
LEAST_BYTES = 0
EPOCH = 1704067200  # 2024-01-01: captures are one second apart by page_id
FIRST_SECOND, LAST_SECOND = -62135596800, 253402300799  # of the years 1 and 9999
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
HEX32, BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(data: Column) -> Column:
    """Upper-case base32 of the SHA-1: five hex digits are four of base 32."""
    digest = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(digest, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), HEX32, BASE32)


def typed(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> tuple[DataFrame, list[tuple[int, int, int]]]:
    """page_id, url, html, bytes, digest and refers_to (null: a response); and of each class that has records its bytes (over, up to) and records an archive."""
    html = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html"))
    rows = rows.withColumn("bytes", F.octet_length("html").cast("long")).withColumn("digest", base32_sha1(F.col("html").cast("binary")))
    told = written(rows.select("page_id", "bytes", "digest"), "digests")
    kind = F.coalesce(*[F.when(F.col("bytes") <= most, i) for i, (most, _) in enumerate(CLASSES)])
    means = {r["kind"]: r["mean"] + HEADER_BYTES for r in told.groupBy(kind.alias("kind")).agg(F.avg("bytes").alias("mean")).collect()}  # a row a class
    classes = [(CLASSES[i - 1][0] if i else -1, CLASSES[i][0], CLASSES[i][1] or int(max(1, min(RECORDS_A_FILE, ARCHIVE_BYTES // mean)))) for i, mean in sorted(means.items())]
    first = told.filter(F.col("bytes") >= least_bytes).groupBy("digest", "bytes").agg(F.max("page_id").alias("largest"), F.count(F.lit(1)).alias("n"))
    first = written(first.filter("n > 1").drop("n"), "repeated")
    rows = lookup(rows, first, ["digest", "bytes"], "left")
    rows = rows.withColumn("refers_to", F.when(F.coalesce(F.col("page_id") != F.col("largest"), F.col("largest").isNotNull()), F.col("largest"))).drop("largest")
    return rows, classes


def utc(seconds: Column) -> Column:
    """A WARC date of seconds since 1970, whatever the session's time zone."""
    day = F.floor(seconds / 86400)
    clock = [F.floor(F.pmod(seconds, F.lit(86400)) / 3600), F.floor(F.pmod(seconds, F.lit(3600)) / 60), F.pmod(seconds, F.lit(60))]
    return F.concat(F.date_from_unix_date(day.cast("int")).cast("string"), F.lit("T"), F.concat_ws(":", *[F.lpad(c.cast("string"), 2, "0") for c in clock]), F.lit("Z"))


def write_archives(rows: DataFrame, folder: str, records_a_file: int) -> None:
    line = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))
    revisit = F.col("refers_to").isNotNull()
    since = F.greatest(F.lit(FIRST_SECOND - EPOCH), F.least(F.lit(LAST_SECOND - EPOCH), F.coalesce("page_id", F.lit(0))))
    when = utc(since + EPOCH)
    body = F.when(revisit, F.lit("")).otherwise(F.col("html"))
    record = F.concat(
        F.lit("WARC/1.0\r\n"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.col("page_id").cast("string"), F.lit(">"))),
        line("WARC-Target-URI", F.translate("url", "\r\n", "")),
        line("WARC-Date", when),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("refers_to").cast("string"), F.lit(">"))),
        line("WARC-Profile", F.when(revisit, PROFILE)),
        line("X-Payload-Length", F.when(revisit, F.col("bytes").cast("string"))),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.octet_length(body).cast("string")),
        F.lit("\r\n"),
        body,
        F.lit("\r\n\r"),  # the text writer adds the last line feed
    )
    rows.select(record.alias("value")).write.option("maxRecordsPerFile", records_a_file).option("compression", "gzip").mode("append").text(folder)


def url_key(url: str | None) -> str:
    """Host labels reversed and comma-joined, then `)` and the path with its query; no scheme, port or www."""
    if not url:
        return ""
    try:
        parts = urlsplit(url)
        host = (parts.hostname or "").removeprefix("www.")
    except ValueError:
        return url.lower()
    return f"{','.join(reversed(host.split('.')))}){parts.path or '/'}{'?' + parts.query if parts.query else ''}".lower()


def records(stream: BinaryIO) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """Offset, headers and body of each record of an unpacked archive."""
    at = 0
    while line := stream.readline():
        if line != b"WARC/1.0\r\n":
            raise ValueError(f"no WARC record at byte {at}")
        headers, read = {}, len(line)
        while (line := stream.readline()) != b"\r\n":
            if not line:
                raise ValueError(f"the record at byte {at} ends in its headers")
            name, value = line[:-2].decode().split(": ", 1)
            headers[name] = value
            read += len(line)
        length = int(headers["Content-Length"])
        body, tail = stream.read(length), stream.read(4)
        if len(body) < length or tail != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} is cut")
        yield at, headers, body
        at += read + 2 + length + 4


CAPTURE = "url_key string, captured string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, offset long"
ORDER = ("url_key", "captured", "page_id", "archive", "offset")
_KINDS = {"string": pa.string(), "long": pa.int64()}


def _schema() -> pa.Schema:
    return pa.schema([(n, _KINDS[k]) for n, k in (x.split() for x in CAPTURE.split(", "))])


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number = lambda x: int(x[len("<urn:page:") : -1]) if x else None
    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
            run = []
            for at, h, body in records(gzip.GzipFile(fileobj=pa.BufferReader(content.as_buffer()))):
                digest = h["WARC-Payload-Digest"].removeprefix("sha1:")
                size = len(body)
                if h["WARC-Type"] == "response":
                    if base64.b32encode(hashlib.sha1(body).digest()).decode() != digest:
                        raise ValueError(f"{path}: the payload at byte {at} doesn't match its digest")
                else:
                    size = int(h["X-Payload-Length"])
                key = url_key(h.get("WARC-Target-URI"))
                run.append((key, h["WARC-Date"], number(h.get("WARC-Record-ID")), size, digest, h["WARC-Type"], number(h.get("WARC-Refers-To")), path.rsplit("/", 1)[-1], at))
            run.sort(key=rank)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*run, strict=True) if run else [[]] * 9, _schema(), strict=True)], schema=_schema())


def rank(row: tuple) -> tuple:
    return row[0], row[1], row[2] is not None, row[2] or 0, row[7:]


class LoserTree:
    """Merges sorted iterators; each step replays one path of the tournament and only heads are held."""

    def __init__(self, runs: list[Iterator[tuple]]) -> None:
        self.runs = [iter(r) for r in runs]
        self.size = 1 << max(0, len(runs) - 1).bit_length()
        self.row: list[tuple | None] = [None] * self.size
        self.key: list[tuple] = [(1,)] * self.size  # an ended run is larger than all
        for run in range(len(runs)):
            self._advance(run)
        self.loser = [-1] * self.size
        self.winner = self._play(1)

    def _advance(self, run: int) -> None:
        self.row[run] = next(self.runs[run], None)
        self.key[run] = (1,) if self.row[run] is None else (0, rank(self.row[run]), run)

    def _play(self, node: int) -> int:
        if node >= self.size:
            return node - self.size
        a, b = self._play(2 * node), self._play(2 * node + 1)
        won, lost = (a, b) if self.key[a] <= self.key[b] else (b, a)
        self.loser[node] = lost
        return won

    def __iter__(self) -> Iterator[tuple]:
        while self.row[self.winner] is not None:
            run = self.winner
            yield self.row[run]
            self._advance(run)
            node = (run + self.size) // 2
            while node:
                if self.key[self.loser[node]] < self.key[run]:
                    self.loser[node], run = run, self.loser[node]
                node //= 2
            self.winner = run


def _rows(batches: list[pa.RecordBatch]) -> Iterator[tuple]:
    """The rows of a run, unpacked HELD_ROWS at a time."""
    for batch in batches:
        for first in range(0, len(batch), HELD_ROWS):
            yield from zip(*(c.to_pylist() for c in batch.slice(first, HELD_ROWS).columns), strict=True)


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    runs: dict[str, list[pa.RecordBatch]] = {}  # a range's captures, as columns
    for batch in batches:
        names = batch.column("archive").to_pylist()
        cuts = [0, *[i for i in range(1, len(names)) if names[i] != names[i - 1]], len(names)]
        for first, last in zip(cuts[:-1], cuts[1:], strict=True):
            if last > first:
                runs.setdefault(names[first], []).append(batch.slice(first, last - first))
    merged = iter(LoserTree([_rows(own) for own in runs.values()]))
    while held := list(islice(merged, HELD_ROWS)):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), _schema(), strict=True)], schema=_schema())


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """Captures of all archives in a folder, a sorted run an archive."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(folder).select("path", "content")
    return files.mapInArrow(_parsed, CAPTURE)


def merge_runs(captures: DataFrame, range_captures: int = RANGE_CAPTURES) -> DataFrame:
    """Captures (a written table) in global order of URL key and time."""
    ranges = max(captures.sparkSession.sparkContext.defaultParallelism, -(-captures.count() // range_captures))
    ranged = captures.repartitionByRange(ranges, *ORDER).sortWithinPartitions("archive", *ORDER)
    return ranged.mapInArrow(_merged, CAPTURE)


def op7_warc_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "archives")
    rows, classes = typed(table(spark, sf_dir, "pages"))
    for over, most, records_a_file in classes:
        write_archives(rows.filter((F.col("bytes") > over) & (F.col("bytes") <= most)) if len(classes) > 1 else rows, folder, records_a_file)
    if not classes:
        write_archives(rows, folder, 1)
    merged = merge_runs(written(read_archives(spark, folder), "runs"))
    return merged.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured")
