"""WARC archives of pages and a capture index merged from the archives' sorted runs.

Every task sorts its records by URL key and time and writes them as one file: a sorted run. Reading the files back gives
index entries; entries are dealt out by ranges of (key, time, record), and each range merges the pieces of all runs with a
loser tree. The ranges follow each other, so the index as a whole is in order and every URL's captures are its history.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowbench.llm.common import written
from flowbench.llm.url_filters import host_of
from flowbench.session import shared_folder

# Records without a capture time are dated from here, a second for each id.
EPOCH = 1_700_000_000
# A file holds at most so many records.
FILE_RECORDS = 20_000
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"  # fixed value
_CRLF = "\r\n"
_END = "\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"  # fixed value

ENTRY = "url_key string, captured string, page_id {id}, url string, payload_bytes long, payload_digest string, record_type string, refers_to {id}, file string, at long, length long"


def payload_digest(payload: Column) -> Column:
    """Bare upper-case base32 of the payload's SHA-1."""
    sha = F.sha1(payload)
    chars = []
    for i in range(8):  # five hex digits are four base32 digits
        n = F.conv(F.substring(sha, 5 * i + 1, 5), 16, 10).cast("int")
        chars += [F.substring(F.lit(_BASE32), F.shiftright(n, shift).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for shift in (15, 10, 5, 0)]
    return F.concat(*chars)


def url_key(url: Column) -> Column:
    """Host labels from the right, comma-joined, ``)``, then path and query without fragment; a url without host is its own key."""
    host = host_of(url)
    rest = F.regexp_extract(url, r"://[^/?#]*([^#]*)", 1)
    return F.when(host == "", F.coalesce(url, F.lit(""))).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), rest))


def _line(url: Column) -> Column:
    """A url as it may stand in a header line: control characters are percent-encoded."""
    for code in (9, 10, 13):
        url = F.replace(url, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    return url


def write_archives(pages: DataFrame, folder: str, least: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", time_col: str | None = None) -> None:
    """Writes one WARC record per row below ``folder``, as gzip files that are each sorted by URL key, time and id.

    The payload is the html in UTF-8 (null: empty). Of records with equal payloads of at least ``least`` bytes the one with the largest id is a
    response (all rows with that id, if ids repeat; all, if every id is null) and the others are revisits that refer to it and carry no
    payload. ``time_col`` is the capture time in UTC; without it, or where it is null, a time is made from the id, with null as 0.
    """
    html, key = F.coalesce(F.col(f"`{html_col}`"), F.lit("")), F.col(f"`{id_col}`")
    made = F.timestamp_seconds(F.lit(EPOCH) + F.coalesce(F.abs(F.xxhash64(key.cast("string"))) % 100_000_000 if dict(pages.dtypes)[id_col] == "string" else key.cast("long"), F.lit(0)))
    time = F.coalesce(F.col(f"`{time_col}`").cast("timestamp"), made) if time_col else made
    rows = pages.select(
        key.alias("id"), _line(F.coalesce(F.col(f"`{url_col}`"), F.lit(""))).alias("url"), html.alias("html"),
        F.octet_length(html).alias("n"), payload_digest(html).alias("digest"), F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("captured"),
    )
    rows = rows.withColumn("url_key", url_key(F.col("url")))
    last = rows.groupBy("digest").agg(F.max("id").alias("last"))
    rows = rows.join(last, "digest").withColumn("again", (F.col("n") >= least) & F.coalesce(F.col("id") != F.col("last"), F.col("last").isNotNull()))
    header = F.concat(F.lit(f"HTTP/1.1 200 OK{_CRLF}Content-Type: text/html; charset=utf-8{_CRLF}Content-Length: "), F.col("n").cast("string"), F.lit(_END))
    block = F.when(F.col("again"), header).otherwise(F.concat(header, "html"))
    name = lambda c: F.concat(F.lit("<urn:x-page:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(F.col("again"), "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), name("id")),
        F.concat(F.lit("WARC-Date: "), F.col("captured")),
        F.concat(F.lit("WARC-Target-URI: "), F.col("url")),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
        F.when(F.col("again"), F.concat(F.lit(f"WARC-Profile: {_PROFILE}{_CRLF}WARC-Refers-To: "), name("last"))),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    ]
    record = F.concat(F.concat_ws(_CRLF, *lines), F.lit(_END), block)  # the writer adds the two empty lines after each record
    (
        rows.sortWithinPartitions("url_key", "captured", "id")
        .select(record.alias("value"))
        .write.option("lineSep", _END)
        .option("compression", "gzip")
        .option("maxRecordsPerFile", FILE_RECORDS)
        .text(folder)
    )


def read_archives(spark: SparkSession, folder: str, id_type: str = "bigint") -> DataFrame:
    """An index entry (``ENTRY``) for each record below ``folder``, checked against the record.

    ``at`` and ``length`` are the record's place in the unpacked file. A response whose payload does not have the digest or length that its
    header names is an error. Files are unpacked as streams.
    """
    files = spark.read.format("binaryFile").load(folder).select("path", "content")
    schema = ENTRY.format(id=id_type)
    text = files.mapInArrow(_entries, ENTRY.format(id="string"))
    return text.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in spark.createDataFrame([], schema).schema.fields])


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ("url_key", "captured", "page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "file", "at", "length")
    kinds = {"payload_bytes": pa.int64(), "at": pa.int64(), "length": pa.int64()}
    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
            rows = []
            for at, length, head, payload in records(_unpacked(memoryview(content.as_buffer()))):
                inner, _, body = payload.partition(b"\r\n\r\n")
                size = int(_headers(inner)["content-length"])
                digest = head["warc-payload-digest"].removeprefix("sha1:")
                if head["warc-type"] == "response" and (len(body) != size or base64.b32encode(hashlib.sha1(body).digest()).decode() != digest):
                    raise ValueError(f"{path}: the record at {at} is damaged")
                url = head["warc-target-uri"]
                rows.append((_key(url), head["warc-date"], _page(head["warc-record-id"]), url, size, digest, head["warc-type"], _page(head.get("warc-refers-to", "")), path, at, length))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, kinds.get(n, pa.string())) for n, c in zip(names, zip(*rows))], names=list(names))


def _unpacked(content: memoryview) -> Iterator[bytes]:
    """The bytes of all gzip members of a file, one after the other: archives often hold a member for each record."""
    stream = zlib.decompressobj(31)
    for i in range(0, len(content), 1 << 20):
        left = content[i : i + (1 << 20)]
        while len(left):
            if stream.eof:
                stream = zlib.decompressobj(31)
            yield stream.decompress(left)
            left = stream.unused_data
    if not stream.eof and len(content):
        raise ValueError("the archive ends within a gzip member")


def records(chunks: Iterator[bytes]) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """Place, length, header and block of each record of an unpacked archive that comes in pieces."""
    held, at = bytearray(), 0

    def fill(n: int) -> bool:
        while len(held) < n:
            piece = next(chunks, None)
            if piece is None:
                return False
            held.extend(piece)
        return True

    while True:
        while (end := held.find(b"\r\n\r\n")) < 0:
            if not fill(len(held) + 1):
                if held.strip():
                    raise ValueError(f"the archive ends within a record at {at}")
                return
        head = _headers(bytes(held[:end]))
        size = int(head["content-length"])
        whole = end + 4 + size + 4
        if not fill(whole):
            raise ValueError(f"the archive ends within a record at {at}")
        yield at, whole, head, bytes(held[end + 4 : end + 4 + size])
        del held[:whole]
        at += whole


def _headers(lines: bytes) -> dict[str, str]:
    pairs = (line.split(":", 1) for line in lines.decode().split("\r\n")[1:])
    return {k.lower(): v.strip() for k, v in pairs}


def _page(name: str) -> str | None:
    return name.removeprefix("<urn:x-page:").removesuffix(">") or None


def _key(url: str) -> str:
    _, found, rest = url.partition("://")
    cut = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    host = rest[:cut]
    if not found or not host:
        return url
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    return ",".join(reversed(host.split("."))) + ")" + rest[cut:].partition("#")[0]


class LoserTree:
    """Merges sorted runs: inner nodes hold the loser of their match, so the next winner needs one path of matches."""

    def __init__(self, runs: list[list]):
        self.runs, self.at, k = runs, [0] * len(runs), len(runs)
        self.losers = [-1] * k
        for run in range(k):
            self._replay(run, filling=True)

    def _ahead(self, a: int, b: int) -> bool:
        """Whether run ``a`` comes before run ``b``; runs that are used up come last, ties go to the lower run."""
        if self.at[a] >= len(self.runs[a]):
            return False
        if self.at[b] >= len(self.runs[b]):
            return True
        x, y = self.runs[a][self.at[a]], self.runs[b][self.at[b]]
        return x < y or (x == y and a < b)

    def _replay(self, run: int, filling: bool = False) -> None:
        node = (run + len(self.runs)) // 2
        while node > 0:
            if self.losers[node] < 0:
                if filling:
                    self.losers[node] = run
                    return
            elif self._ahead(self.losers[node], run):
                self.losers[node], run = run, self.losers[node]
            node //= 2
        self.losers[0] = run

    def __iter__(self):
        while self.runs and self.at[self.losers[0]] < len(self.runs[self.losers[0]]):
            run = self.losers[0]
            yield self.runs[run][self.at[run]]
            self.at[run] += 1
            self._replay(run)


def merged_index(entries: DataFrame) -> DataFrame:
    """The entries in order of URL key, time and page id (null first), with ``capture``: the place in its URL's history within the range.

    Ranges are cut by sampled quantiles over all three, so that a URL with very many captures spans several ranges. A range is held by one task;
    more ranges (``spark.sql.shuffle.partitions``) make it smaller.
    """
    order = ["url_key", "captured", F.asc_nulls_first("page_id")]
    kept = written(entries, "warc-entries")  # range bounds are sampled from it before it is dealt out
    ranges = kept.repartitionByRange(*order).sortWithinPartitions("file", "at")
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept.schema.fields)
    return ranges.mapInArrow(_merge, fields)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = list(batches)
    if not held:
        return
    table = pa.Table.from_batches(held)
    keys = [(k, t, p is not None, p) if p is not None else (k, t, False, 0) for k, t, p in zip(*(table.column(c).to_pylist() for c in ("url_key", "captured", "page_id")))]
    runs, last = [], None
    for i, (file, key) in enumerate(zip(table.column("file").to_pylist(), keys)):
        if file != last:
            runs.append([])
            last = file
        runs[-1].append((key, i))
    order = pa.array([i for _, i in LoserTree(runs)], pa.int64())
    yield from table.take(order).combine_chunks().to_batches(max_chunksize=10_000)


def capture_index(pages: DataFrame, least: int = 0, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", time_col: str | None = None) -> DataFrame:
    """Writes pages as archives (below ``folder``, else a new shared folder), reads them back and merges their index.

    Returns the merged entries with the id under its own name: one per input row, in the order of the histories. Urls and ids may be null (an empty url), pages empty or
    very long, rows repeated; extra columns are ignored. An empty table gives no entry.
    """
    spark = pages.sparkSession
    folder = folder or shared_folder(spark, "warc")
    kind = pages.schema[id_col].dataType.simpleString()
    write_archives(pages, folder, least, id_col, url_col, html_col, time_col)
    return merged_index(read_archives(spark, folder, kind)).withColumnRenamed("page_id", id_col)
