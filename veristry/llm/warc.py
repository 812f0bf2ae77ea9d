"""WARC archives written and read by Spark, and a merged index of their captures.

Writing: a record is one string whose end mark, two line breaks, is the text
sink's line separator, so Spark's own writer makes the archive files on any
file system.  Records of equal payload refer to the one with the smallest id.

Reading: each archive is unpacked and parsed as a stream; its size is bounded
when it is written.  Its captures form a run that is sorted by URL key and
time.  All runs are written to the shared folder and cut at the borders of
Spark's range partitions, as many as keep a partition's rows bounded; Spark
sorts a partition's rows by run, and a loser tree merges the runs' parts, so
the partitions in order hold the capture history of all archives.
"""

from __future__ import annotations

import gzip
import hashlib
import io
from collections.abc import Iterator
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import new_folder, parts, stored

_END = "\r\n\r\n"
#: Payloads of fewer bytes are never replaced by a reference.
LEAST_BYTES = 100
#: Bytes of payload that an archive has on average, and captures that a task merges.
ARCHIVE_BYTES, MERGE_ROWS = 64 << 20, 200_000
#: Second 0 of the capture times that are made from page ids, 2024-01-01.
_EPOCH = 1_704_067_200


def with_originals(pages: DataFrame) -> DataFrame:
    """Adds payload, payload_bytes, payload_digest and original, the smallest page_id of equal payloads of enough bytes.

    Originals are found from digests alone and joined by page, so payloads are
    shuffled once and evenly, however many pages have the same one; into as
    many parts as bound the bytes of each.
    """
    p = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("payload"))
    total = p.agg(F.coalesce(F.sum(F.octet_length("payload")), F.lit(0)).alias("n")).first()["n"]
    p = p.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("payload_digest", F.sha2("payload", 256))
    p = p.withColumn("_page", F.concat_ws("/", F.coalesce(F.col("page_id").cast("string"), F.lit("-")), "payload_digest"))
    seen = p.where(F.col("payload_bytes") >= LEAST_BYTES).select("_page", "page_id", "payload_digest")
    same = seen.groupBy("payload_digest").agg(F.min("page_id").alias("original"), F.count("*").alias("_n")).where("_n > 1").select("payload_digest", "original")
    found = seen.select("_page", "payload_digest").distinct().join(same, "payload_digest").select("_page", "original")
    n = max(parts(pages.sparkSession), -(-total // ARCHIVE_BYTES))
    return p.repartition(n, "_page").join(found, "_page", "left").drop("_page")


def records(pages: DataFrame) -> DataFrame:
    """One WARC record (string, without its end mark) per row of ``with_originals``."""
    revisit = F.col("original").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("original"))
    identity = lambda c: F.concat(F.lit("<urn:sha1:"), F.sha1(F.coalesce(c.cast("string"), F.lit("-"))), F.lit(">"))
    line = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))
    url = F.regexp_replace("url", r"[\x00-\x20\x7f]", "%20")
    when = F.date_format(F.timestamp_seconds(F.lit(_EPOCH) + F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(1 << 31))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", identity(F.col("page_id"))),
        line("WARC-Target-URI", url),
        line("WARC-Date", when),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "payload_digest")),
        line("X-Payload-Bytes", F.col("payload_bytes").cast("string")),
        line("X-Page", F.col("page_id").cast("string")),
        line("WARC-Profile", F.when(revisit, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        line("WARC-Refers-To", F.when(revisit, identity(F.col("original")))),
        line("X-Refers-To-Page", F.when(revisit, F.col("original").cast("string"))),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("payload_bytes").cast("string"))),
        F.lit("\r\n"),
    )
    return pages.select(F.concat(head, F.when(revisit, F.lit("")).otherwise(F.col("payload"))).alias("record"))


def write_archives(pages: DataFrame, folder: str, compression: str = "gzip") -> None:
    """Writes pages (page_id integer, url string, html string) as WARC files.

    With ``compression`` none, a record's offset and length in the capture
    index are those of its bytes in the file; with gzip, an archive is one
    stream, and they are those in the unpacked archive.
    """
    rows = records(with_originals(pages))
    rows.write.option("lineSep", _END).option("compression", compression).text(folder)


def parse(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], int, int, bytes]]:
    """Headers, offset, length and block of each record of an unpacked archive."""
    at = 0
    while True:
        line = stream.readline()
        if not line:
            return
        if line != b"WARC/1.1\r\n":
            raise ValueError(f"no record starts at byte {at}")
        size, head = len(line), {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            size += len(line)
            name, _, value = line.decode().partition(":")
            head[name] = value.strip()
        n = int(head["Content-Length"])
        block = stream.read(n)
        end = stream.read(4)
        if len(block) != n or end != _END.encode():
            raise ValueError(f"the record at byte {at} is cut off")
        size += 2 + n
        yield head, at, size, block
        at += size + 4


def url_key(url: str | None) -> str:
    """Host labels from the last to the first, then path and query, all lower case; scheme, www and fragment don't count."""
    if not url:
        return ""
    try:
        u = urlsplit(url)
        host = (u.hostname or "").removeprefix("www.")
    except ValueError:
        return url.lower()
    return f"{','.join(reversed(host.split('.')))}){u.path or '/'}{'?' + u.query if u.query else ''}".lower()


_ENTRY = [("url_key", pa.string()), ("captured_at", pa.string()), ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("run", pa.string()), ("record_offset", pa.int64()), ("record_length", pa.int64())]
_ENTRY_SQL = "url_key string, captured_at string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, run string, record_offset long, record_length long"


def _order(row: dict) -> tuple:
    return row["url_key"], row["captured_at"], row["page_id"] is not None, row["page_id"] or 0, row["run"], row["record_offset"]


def _index(batches):
    """Archive files (path, content) -> the sorted run of each; a payload's digest is taken anew."""
    for batch in batches:
        for path, content in zip(batch.column(0), batch.column(1), strict=True):
            rows = []
            content = io.BytesIO(content.as_buffer())
            packed = content.getbuffer()[:2] == b"\x1f\x8b"
            with gzip.GzipFile(fileobj=content) if packed else content as f:
                for head, at, size, block in parse(io.BufferedReader(f)):
                    digest = head["WARC-Payload-Digest"].removeprefix("sha256:")
                    if head["WARC-Type"] == "response" and hashlib.sha256(block).hexdigest() != digest:
                        raise ValueError(f"the payload at byte {at} of {path} isn't what was written")
                    n = len(block) if head["WARC-Type"] == "response" else int(head["X-Payload-Bytes"])
                    number = lambda name: int(head[name]) if name in head else None  # noqa: B023, E731
                    rows.append({"url_key": url_key(head.get("WARC-Target-URI")), "captured_at": head["WARC-Date"], "page_id": number("X-Page"), "payload_bytes": n, "payload_digest": digest, "record_type": head["WARC-Type"], "refers_to": number("X-Refers-To-Page"), "run": path.as_py().rsplit("/", 1)[-1], "record_offset": at, "record_length": size})
            rows.sort(key=_order)
            for i in range(0, len(rows), 5000):
                yield pa.RecordBatch.from_pylist(rows[i : i + 5000], pa.schema(_ENTRY))


class LoserTree:
    """Merges k sorted iterators; each step replays one leaf's path to the root, about log2(k) comparisons."""

    def __init__(self, runs: list[Iterator], key):
        self._runs, self._key, self._k = runs, key, max(1, len(runs))
        self._head: list = [None] * self._k
        self._at: list = [None] * self._k
        for i in range(len(runs)):
            self._pull(i)
        self._loser = [-1] * self._k
        for i in range(self._k - 1, -1, -1):
            self._play(i)

    def _pull(self, i: int) -> None:
        row = next(self._runs[i], None) if i < len(self._runs) else None
        self._head[i], self._at[i] = row, None if row is None else (self._key(row), i)

    def _beats(self, a: int, b: int) -> bool:
        return self._at[b] is None or (self._at[a] is not None and self._at[a] < self._at[b])

    def _play(self, leaf: int) -> None:
        """Sends a leaf up: at each node the loser stays, the winner goes on; an empty node keeps the first to come."""
        winner, node = leaf, (leaf + self._k) // 2
        while node > 0:
            if self._loser[node] == -1:
                self._loser[node] = winner
                return
            if self._beats(self._loser[node], winner):
                winner, self._loser[node] = self._loser[node], winner
            node //= 2
        self._loser[0] = winner

    def __iter__(self):
        while self._head[top := self._loser[0]] is not None:
            yield self._head[top]
            self._pull(top)
            self._play(top)


def _merge(batches):
    """A range partition's captures, sorted by run -> in order, with their place in it."""
    t = pa.Table.from_batches(list(batches), pa.schema(_ENTRY)).combine_chunks()
    if not t.num_rows:
        return
    keys = [t.column(c).to_pylist() for c in ("url_key", "captured_at", "page_id", "run", "record_offset")]

    def run(a: int, b: int):
        for k in range(a, b):
            url, at, page, name, offset = (x[k] for x in keys)
            yield (url, at, page is not None, page or 0, name, offset), k

    names = np.asarray(t.column("run").combine_chunks().dictionary_encode().indices)
    cuts = [0, *(np.flatnonzero(np.diff(names)) + 1), len(names)]
    order = np.fromiter((k for _, k in LoserTree([run(a, b) for a, b in zip(cuts, cuts[1:], strict=False)], lambda row: row[0])), np.int64, len(names))
    part = TaskContext.get().partitionId()
    for a in range(0, len(order), 5000):
        own = t.take(pa.array(order[a : a + 5000])).combine_chunks()
        n = own.num_rows
        yield pa.RecordBatch.from_arrays([*(c.chunk(0) for c in own.columns), pa.array(np.full(n, part, np.int32)), pa.array(np.arange(a, a + n))], names=[*own.schema.names, "merged_part", "merged_pos"])


def capture_index(spark: SparkSession, folder: str) -> DataFrame:
    """Reads the archives below ``folder``: a row per record, ordered by (merged_part, merged_pos).

    That order is by URL key, capture time and page_id over all archives.
    Columns: url_key, captured_at, page_id, payload_bytes, payload_digest,
    record_type, refers_to, run (the archive's name), record_offset and
    record_length (in the unpacked archive), merged_part, merged_pos.  An
    empty folder gives no rows; a damaged archive fails the job.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("path", "content")
    entries = stored(files.mapInArrow(_index, _ENTRY_SQL), "captures")
    n = max(parts(spark), -(-entries.count() // MERGE_ROWS))
    ranged = entries.repartitionByRange(n, "url_key", "captured_at", "page_id").sortWithinPartitions("run", "url_key", "captured_at", "page_id", "record_offset")
    return ranged.mapInArrow(_merge, f"{_ENTRY_SQL}, merged_part int, merged_pos long")


def archive(pages: DataFrame, compression: str = "gzip") -> DataFrame:
    """Writes ``pages`` to a new folder of archives, reads them back and returns their capture index.

    ``pages`` has page_id (integer), url and html (string); other columns are
    not used, whatever their names.  Payloads of any length are written whole.
    Null html is an empty payload, a null url has the key ''; a row
    with null page_id is archived too and is never an original unless all
    equal payloads have none.  Rows that repeat the smallest page_id are all
    responses.  An empty table gives no rows.
    """
    spark = pages.sparkSession
    folder = new_folder(spark, "warc")
    write_archives(pages, folder, compression)
    return capture_index(spark, folder)


def with_place(index: DataFrame) -> DataFrame:
    """Adds place long, from 1: where a capture lies in the merged order of all archives, from its part's place and the sizes of the parts before."""
    merged = stored(index, "merged")
    sizes = merged.groupBy("merged_part").agg(F.count("*").alias("_n"))
    before = sizes.select("merged_part", (F.sum("_n").over(Window.orderBy("merged_part")) - F.col("_n")).alias("_before"))  # one row a part
    return merged.join(F.broadcast(before), "merged_part").withColumn("place", F.col("_before") + F.col("merged_pos") + 1).drop("_before")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = with_place(archive(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "place")


OP10_SQL = r"""
WITH p AS (
  SELECT page_id, regexp_replace(coalesce(url, ''), '#.*$', '') AS u, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT payload_digest, min(page_id) AS o FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest
), h AS (
  SELECT page_id, regexp_replace(regexp_extract(u, '^[a-z]+://([^/?:]*)', 1), '^www\.', '') AS host, regexp_extract(u, '^[a-z]+://[^/?]*([^?]*)', 1) AS path, regexp_extract(u, '\?(.+)$', 1) AS query FROM p
), k AS (
  SELECT page_id, lower(array_to_string(list_reverse(string_split(host, '.')), ',') || ')' || CASE path WHEN '' THEN '/' ELSE path END || CASE query WHEN '' THEN '' ELSE '?' || query END) AS url_key FROM h
)
SELECT p.page_id, url_key, row_number() OVER (ORDER BY url_key, p.page_id % 2147483648, p.page_id) AS place, payload_bytes, p.payload_digest,
  CASE WHEN o IS NOT NULL AND o <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN o <> p.page_id THEN o END AS refers_to
FROM p JOIN k ON k.page_id = p.page_id LEFT JOIN f ON p.payload_digest = f.payload_digest
"""
