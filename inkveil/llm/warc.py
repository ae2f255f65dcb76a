"""WARC archives of pages, and the merged index of their captures.

Each page is a record: of the pages with equal payloads the one with the largest page_id is a response, the others
revisit it. Records are written by Spark's text sink, whose separator of rows is the two line breaks that end a WARC
record, and compressed by gzip. Reading an archive back gives its captures, sorted by URL key and time: a run. Runs
are cut at key boundaries and the pieces of each range are merged by a tree of losers, so that ranges in order hold
the histories of all captures in order. Boundaries come from a bounded sample of keys that hold the page_id too, so a
URL with very many captures spreads over several ranges.

Cases: a null html is an empty payload; a null URL gives a record without target and an empty key; null page_ids never
are what others refer to; rows with equal page_id and payload are all responses if theirs is the largest page_id;
payloads below `min_bytes` are responses; an empty table gives no captures. Payloads that hold line breaks or text
like a record's are read by their length. Characters of URLs that no header can hold are percent-encoded. Further
columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkveil.llm.common import joined_spread, remove_written, scratch_path, written

#: Records in an archive at most: what a run holds.
FILE_RECORDS = 4000
#: Bytes of payloads in an archive at most, unless a single one has more.
FILE_BYTES = 1 << 29
#: Captures of a merged range on average; keys sampled to find a range's boundary, and in all, at most; characters of a key in a boundary.
RANGE_ROWS, RANGE_SAMPLE, MAX_SAMPLE, KEY_CHARS = 20_000, 32, 1_000_000, 200
#: Time of capture where none is given: this second plus the page_id.
FIRST_SECOND = 1_704_067_200

CAPTURE = "page_id long, url string, url_key string, captured string, record_type string, payload_bytes long, payload_digest string, refers_to long"
NAMES = [x.split()[0] for x in CAPTURE.split(", ")]


def base32_sha1(payload: Column) -> Column:
    """SHA-1 in upper-case base 32: 5 hex digits are 4 digits of base 32."""
    digest = F.sha1(payload)
    parts = [F.lpad(F.upper(F.conv(F.substring(digest, 5 * k + 1, 5), 16, 32)), 4, "0") for k in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def prepared(pages: DataFrame, second: Column | None = None) -> DataFrame:
    """page_id, url, payload, stamp, digest, n (bytes)."""
    second = F.coalesce(second if second is not None else F.lit(FIRST_SECOND) + F.pmod("page_id", F.lit(1 << 28)), F.lit(FIRST_SECOND))
    stamp = F.date_format(F.to_utc_timestamp(F.timestamp_seconds(second), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"), stamp.alias("stamp"))
    return own.withColumn("n", F.octet_length("payload")).withColumn("digest", base32_sha1(F.col("payload").cast("binary")))


def with_kept(own: DataFrame, copies: DataFrame) -> DataFrame:
    """own with `kept`, the page_id that its copies refer to, or null for a payload without copies."""
    return joined_spread(own, copies, ("digest", "n"), F.xxhash64("page_id", "url"))


def records(own: DataFrame) -> DataFrame:
    """value: the text of each page's record, without the line breaks at its end; own: as with_kept() gives it."""
    revisit = F.coalesce(F.col("page_id") != F.col("kept"), F.col("kept").isNotNull())
    uri = F.regexp_replace("url", "[\\x00-\\x20\\x7F]", "%20")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n"), F.lit("\r\n\r\n"))
    body = F.when(revisit, F.lit("")).otherwise(F.col("payload"))
    size = F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("n"))
    ident = lambda c: F.concat(F.lit("<urn:x-page:"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">"))
    head = F.concat_ws(
        "\r\n",
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), ident(F.col("page_id"))),
        F.concat(F.lit("WARC-Date: "), "stamp"),
        F.concat(F.lit("WARC-Target-URI: "), uri),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), "digest"),
        F.when(revisit, F.concat(F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: "), ident(F.col("kept")))),
        F.lit("Content-Type: application/http;msgtype=response"),
        F.concat(F.lit("Content-Length: "), size),
    )
    return own.select(F.concat(head, F.lit("\r\n\r\n"), http, body).alias("value"))


def write_archives(pages: DataFrame, path: str, file_records: int = FILE_RECORDS, min_bytes: int = 0, second: Column | None = None, file_bytes: int = FILE_BYTES) -> None:
    """Archives of at most file_records records, and of at most file_bytes bytes of payloads or a single record."""
    own, above, most = prepared(pages, second), -1, max(1, file_bytes // file_records)
    groups = own.groupBy("digest", "n").agg(F.max(F.when(F.col("n") >= min_bytes, F.col("page_id"))).alias("kept"), F.count("*").alias("rows"))
    copies = written(groups.where((F.col("rows") > 1) | (F.col("n") > most)), "warc-copies")
    longest = copies.agg(F.max("n").alias("n")).first().n or 0
    while True:
        # Pages of one class of lengths: longer ones go to archives of fewer records.
        last = longest <= most or file_records == 1
        part = own.where(F.col("n") > above) if above >= 0 else own
        part = part if last else part.where(F.col("n") <= most)
        records(with_kept(part, copies)).write.mode("append").option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", file_records).text(path)
        if last:
            break
        above, file_records = most, max(1, file_records // 4)
        most = max(most + 1, file_bytes // file_records)
    remove_written(copies)


def read_archive(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of a gzip file of any number of members."""
    held, at = bytearray(), 0

    def inflated():
        rest = data
        while rest:
            unpack = zlib.decompressobj(31)
            for k in range(0, len(rest), 1 << 20):
                yield unpack.decompress(rest[k : k + (1 << 20)])
                if unpack.eof:
                    rest = unpack.unused_data + rest[k + (1 << 20) :]
                    break
            else:
                yield unpack.flush()
                return

    parts = inflated()

    def more() -> bool:
        nonlocal held, at
        part = next(parts, None)
        held = held[at:] + (part or b"")
        at = 0
        return part is not None

    while True:
        while (end := held.find(b"\r\n\r\n", at)) < 0:
            if not more():
                return
        first, *lines = held[at:end].decode().split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"no record: {first[:40]!r}")
        head = dict(x.split(": ", 1) for x in lines)
        size, at = int(head["Content-Length"]), end + 4
        while len(held) - at < size + 4 and more():
            pass
        yield head, bytes(held[at : at + size])
        at += size + 4


def url_key(url: str) -> str:
    """Host labels from the last to the first, then the path: keys of a domain's pages stand together."""
    rest = url.partition("://")[2] or url
    ends = [k for k in map(rest.find, "/?#") if k >= 0]
    host, path = (rest[: min(ends)], rest[min(ends) :]) if ends else (rest, "")
    return ",".join(reversed(host.lower().split("."))) + ")" + (path or "/") if url else ""


def capture(head: dict[str, str], block: bytes) -> tuple:
    """A row of CAPTURE; a response's payload is held against its digest."""
    page = lambda x: None if x in (None, "<urn:x-page:none>") else int(x[len("<urn:x-page:") : -1])
    http, _, payload = block.partition(b"\r\n\r\n")
    digest, revisit = head["WARC-Payload-Digest"].removeprefix("sha1:"), head["WARC-Type"] == "revisit"
    size = int(next(x[16:] for x in http.split(b"\r\n") if x.startswith(b"Content-Length: ")))
    if not revisit and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError(f"the payload of {head['WARC-Record-ID']} doesn't fit its digest")
    url = head.get("WARC-Target-URI")
    return page(head["WARC-Record-ID"]), url, url_key(url or ""), head["WARC-Date"], head["WARC-Type"], size, digest, page(head.get("WARC-Refers-To"))


def order_of(row: tuple) -> tuple:
    return row[2], row[3], row[0] is None, row[0] or 0, row[6], row[4]


def runs(spark: SparkSession, path: str) -> DataFrame:
    """The captures of each archive, sorted within it."""

    def read(batches):
        for batch in batches:
            for name, data in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                rows = sorted((capture(*x) for x in read_archive(data.as_py())), key=order_of)
                for k in range(0, len(rows), 4096):
                    part = rows[k : k + 4096]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(part)), *_columns(part)], ["run", *NAMES])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(read, "run string, " + CAPTURE)


_TYPES = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64()]


def _columns(rows: list[tuple]) -> list[pa.Array]:
    return [pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else [()] * len(_TYPES), _TYPES, strict=True)]


def merge(sorted_runs: list[list], key=order_of) -> Iterator:
    """The rows of sorted lists in order, by a tree of losers: inner nodes hold the run that lost there, the top the next winner."""
    n = len(sorted_runs)
    if not n:
        return
    at = [0] * n
    keys = [(False, key(r[0])) if r else (True,) for r in sorted_runs]  # an ended run loses to any other
    losers = [0] * n

    def play(node: int) -> int:
        if node >= n:
            return node - n
        a, b = play(2 * node), play(2 * node + 1)
        winner, losers[node] = (a, b) if (keys[a], a) <= (keys[b], b) else (b, a)
        return winner

    winner = play(1) if n > 1 else 0
    while keys[winner] != (True,):
        run = sorted_runs[winner]
        yield run[at[winner]]
        at[winner] += 1
        keys[winner] = (False, key(run[at[winner]])) if at[winner] < len(run) else (True,)
        node = (winner + n) // 2
        while node:
            other = losers[node]
            if (keys[other], other) < (keys[winner], winner):
                winner, losers[node] = other, winner
            node //= 2


def histories(sorted_runs: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """CAPTURE and order: over all captures it ascends with URL key, time and page_id."""
    keyed = sorted_runs.select("url_key", "captured", "page_id")
    count = keyed.count()
    wanted = -(-count // range_rows)
    share = min(1.0, min(MAX_SAMPLE, RANGE_SAMPLE * wanted) / max(1, count))
    chosen = keyed.where(F.pmod(F.xxhash64("url_key", "captured", "page_id"), F.lit(1 << 30)) < round(share * (1 << 30))) if wanted > 1 else keyed.limit(0)
    # The beginning of a key is a boundary as good as the key.
    sample = chosen.select(F.substring("url_key", 1, KEY_CHARS).alias("url_key"), "captured", "page_id").collect()
    keys = sorted((r.url_key, r.captured, r.page_id is None, r.page_id or 0) for r in sample)
    ranges = min(len(keys), wanted) or 1
    bounds = [keys[k * len(keys) // ranges] for k in range(1, ranges)]

    def cut(batches):
        for batch in batches:
            rows = list(zip(*(batch.column(k).to_pylist() for k in range(batch.num_columns)), strict=True))
            start = 0
            for k in range(1, len(rows) + 1):
                # A piece ends with its run or its range.
                if k == len(rows) or rows[k][0] != rows[start][0] or place(rows[k]) != place(rows[start]):
                    part = rows[start:k]
                    arrays = [pa.array([c.to_pylist()], pa.list_(t)) for c, t in zip(_columns([r[1:] for r in part]), _TYPES, strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array([place(part[0])], pa.int32()), *arrays], ["range", *NAMES])
                    start = k

    def place(row: tuple) -> int:
        return bisect_right(bounds, order_of(row[1:])[:4])

    def merged(table: pa.Table) -> pa.Table:
        pieces = [list(zip(*(table.column(n)[k].as_py() for n in NAMES), strict=True)) for k in range(table.num_rows)]
        rows = list(merge(pieces))
        first = table.column("range")[0].as_py() << 32
        return pa.Table.from_arrays([*_columns(rows), pa.array(range(first, first + len(rows)), pa.int64())], [*NAMES, "order"])

    lists = ", ".join(f"{n} array<{t}>" for n, t in (x.split() for x in CAPTURE.split(", ")))
    return sorted_runs.mapInArrow(cut, "range int, " + lists).groupBy("range").applyInArrow(merged, CAPTURE + ", order long")


def round_trip(pages: DataFrame, **options) -> DataFrame:
    """Writes the archives, reads them back and merges their captures."""
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write_archives(pages, path, **options)
    return histories(written(runs(spark, path), "warc-runs"))
