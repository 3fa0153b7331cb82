"""WARC archives of web pages with a two-level capture index.

``write_archives`` turns every page into a WARC 1.1 record (gzipped by itself, so it can be read
alone) and packs records into archives of about ``ARCHIVE_BYTES``. Of pages with equal payloads the
one with the largest page_id becomes a response, the others revisits that refer to it and carry no
payload. Which page is kept is settled on digests alone; the records, compressed, then move once, a
payload's rows spread over ``SALTS`` tasks, and those that turn out as revisits leave their payload.

``write_index`` sorts all captures by reversed-host key into compressed blocks of ``BLOCK_LINES``.
Above the blocks stands the directory, one row per range of the sort with its blocks' first keys.
``lookup`` finds a URL's range and block by binary search, reads that block alone, and from it the
record's archive, offset and length; ``read_records`` then cuts just those bytes out of the archive.

Archives, blocks and directory are tables written by Spark in the shared folder, archives as binary
cells in buckets by name, so that reading moves captures only: any store Spark can write will do,
and a lost executor's files are written again. A cell is loaded whole by the task that reads from
it; only the wanted bytes are decompressed and handed on.

Edge cases: a null html is an empty payload, a null url an empty one, control characters in urls are
percent-encoded; rows that repeat the largest page_id of a payload are all responses; a null page_id
counts as smallest; an empty table gives empty archives; other columns are ignored.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import re
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsgraph.tables import materialize, materialize_bucketed

ARCHIVE_BYTES = 4 << 20
BLOCK_LINES = 1000
RANGE_LINES = 64 * BLOCK_LINES
MAX_RANGES = 4096
# Tasks over which the rows of one payload, and the urls asked of one range or block, are spread.
SALTS, ASKED_PARTS = 16, 8
RECORD_DATE = "2024-01-01T00:00:00Z"
_ID = re.compile(r"<urn:page:(-?[0-9]*)>")
_CONTROL = re.compile(r"[\x00-\x20\x7f]")
_SCHEME = re.compile(r"^[A-Za-z][A-Za-z0-9+.-]*://")


def reversed_host_key(url: str | None) -> str:
    """Sort key: host labels from the last to the first, then path and query."""
    clean = _CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", url or "")
    try:
        parts = urlsplit(clean if _SCHEME.match(clean) else f"http://{clean}")
        host, port = (parts.hostname or ""), parts.port
    except ValueError:
        return f"){clean}"
    host = host.removeprefix("www.")
    place = f":{port}" if port not in (None, 80, 443) else ""
    return ",".join(reversed(host.split("."))) + f"{place})" + (parts.path or "/") + (f"?{parts.query}" if parts.query else "")


def record(page_id: int | None, uri: str, digest: str, length: int, payload: bytes | None, refers_to: int | None = None) -> bytes:
    """One gzipped record; without a payload it is a revisit."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % length
    block = http + (payload or b"")
    name = lambda i: f"<urn:page:{'' if i is None else i}>"
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if payload is None else 'response'}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {RECORD_DATE}",
        f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if payload is None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {name(refers_to)}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}", "", ""]
    squeeze = zlib.compressobj(4, zlib.DEFLATED, 31)
    return squeeze.compress("\r\n".join(head).encode("utf-8") + block + b"\r\n\r\n") + squeeze.flush()


def parse(data: bytes) -> dict:
    """Header fields of one gzipped record, its payload (None for a revisit) and the payload's length."""
    raw = zlib.decompress(data, 31)
    end = raw.index(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in raw[:end].decode("utf-8").split("\r\n")[1:])
    block = raw[end + 4 : end + 4 + int(fields["Content-Length"])]
    http_end = block.index(b"\r\n\r\n")
    length = int(re.search(rb"Content-Length: ([0-9]+)", block[:http_end])[1])
    return fields | {"payload": block[http_end + 4 :] if fields["WARC-Type"] == "response" else None, "length": length}


def _columns(rows: list[tuple], **kinds: pa.DataType) -> pa.RecordBatch:
    """Rows as a batch of the named columns."""
    values = zip(*rows, strict=True) if rows else [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds.values(), strict=True)], names=list(kinds))


def _responses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every page as a response, compressed; its digest is text in base 32."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            rows = []
            for page_id, url, html, salt in zip(*(c.to_pylist() for c in batch.slice(at, 256).columns), strict=True):
                payload, uri = html.encode("utf-8"), _CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", url or "")
                digest = hashlib.sha1(payload).digest()
                rows.append((page_id, uri, reversed_host_key(url), salt, digest, len(payload), record(page_id, uri, base64.b32encode(digest).decode(), len(payload), payload)))
            yield _columns(rows, page_id=pa.int64(), uri=pa.string(), key=pa.string(), salt=pa.int32(), digest=pa.binary(), size=pa.int64(), record=pa.binary())


def with_responses(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``page_id, uri, key, digest, size, refers_to, record``: the record is null and refers_to set (or the page_id null) for revisits."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    light = rows.select("page_id", F.unhex(F.sha1(F.encode("html", "UTF-8"))).alias("digest"))
    repeated = light.groupBy("digest").agg(F.max("page_id").alias("kept"), F.count("*").alias("n")).filter("n > 1").drop("n")
    repeated = repeated.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"))
    packed = salted.mapInArrow(_responses, "page_id long, uri string, key string, salt int, digest binary, size long, record binary")
    packed = packed.join(repeated.hint("shuffle_hash"), ["digest", "salt"], "left")
    revisit = (F.col("size") >= min_bytes) & F.coalesce(F.col("page_id") != F.col("kept"), F.col("kept").isNotNull())
    return packed.select("page_id", "uri", "key", "digest", "size", F.when(revisit, F.col("kept")).alias("refers_to"), F.when(~revisit, F.col("record")).alias("record"))


def _write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, number, records, captures, size = TaskContext.get().partitionId(), 0, [], [], 0
    kind = pa.list_(pa.struct([("key", pa.string()), ("page_id", pa.int64()), ("offset", pa.int64()), ("length", pa.int64())]))

    def archive() -> pa.RecordBatch:
        return _columns([(f"pages-{part:06d}-{number:05d}.warc.gz", b"".join(records), captures)], archive=pa.string(), data=pa.binary(), captures=kind)

    for batch in batches:
        for page_id, uri, key, digest, length, refers_to, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if data is None:
                data = record(page_id, uri, base64.b32encode(digest).decode(), length, None, refers_to)
            captures.append({"key": key, "page_id": page_id, "offset": size, "length": len(data)})
            records.append(data)
            size += len(data)
            if size >= ARCHIVE_BYTES:
                yield archive()
                number, records, captures, size = number + 1, [], [], 0
    if records:
        yield archive()


def _buckets(df: DataFrame) -> int:
    """Buckets of archives: as many as a shuffle of this session has partitions."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def write_archives(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Archives as a written table: ``archive, data, captures``."""
    written = with_responses(pages, min_bytes).mapInArrow(_write, "archive string, data binary, captures array<struct<key:string,page_id:long,offset:long,length:long>>")
    return materialize_bucketed(written, "warc", _buckets(pages), "archive")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, number, first, lines = TaskContext.get().partitionId(), 0, "", []

    def block() -> pa.RecordBatch:
        data = zlib.compress("\n".join(lines).encode("utf-8"), 6)
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([number], pa.int64()), pa.array([first]), pa.array([data], pa.binary())], names=["range", "block", "first_key", "data"])

    for batch in batches:
        for key, archive, page_id, offset, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            first = first if lines else key
            lines.append(json.dumps([key, archive, page_id, offset, length], ensure_ascii=False))
            if len(lines) >= BLOCK_LINES:
                yield block()
                number, lines = number + 1, []
    if lines:
        yield block()


def write_index(archives: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(blocks, directory): ``range, block, first_key, data`` and ``range, first_keys`` in order of blocks."""
    captures = archives.select("archive", F.explode("captures").alias("c")).select("c.key", "archive", "c.page_id", "c.offset", "c.length")
    ranges = min(MAX_RANGES, max(1, -(-captures.count() // RANGE_LINES)))
    ordered = captures.repartitionByRange(ranges, "key", "page_id").sortWithinPartitions("key", "page_id", "archive", "offset")
    blocks = materialize(ordered.mapInArrow(_blocks, "range long, block long, first_key string, data binary"), "warc-blocks")
    directory = blocks.groupBy("range").agg(F.array_sort(F.collect_list(F.struct("block", "first_key"))).alias("b")).select("range", F.col("b.first_key").alias("first_keys"))
    return blocks, materialize(directory, "warc-directory")


def _lines(data: bytes) -> list[list]:
    return [json.loads(line) for line in zlib.decompress(data).decode("utf-8").split("\n")]


def lookup(urls: DataFrame, blocks: DataFrame, directory: DataFrame) -> DataFrame:
    """Captures of the given urls (column ``url``): ``url, archive, page_id, offset, length``."""
    # One first key per range, MAX_RANGES at most.
    tops = sorted((r["k"], r["range"]) for r in directory.select("range", F.col("first_keys")[0].alias("k")).toLocalIterator())
    keys, numbers = [k for k, _ in tops], [n for _, n in tops]

    def to_range(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for url in batch.column("url").to_pylist():
                key = reversed_host_key(url)
                # Captures of one key may run over several ranges; all that can hold it are asked.
                last = bisect.bisect_right(keys, key)
                out += [(url, key, numbers[i]) for i in range(max(0, bisect.bisect_left(keys, key) - 1), last)]
            yield _columns(out, url=pa.string(), key=pa.string(), range=pa.int64())

    def to_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for number, asked, first in zip(*(batch.column(n).to_pylist() for n in ("range", "asked", "first_keys")), strict=True):
                for q in asked:
                    out += [(q["url"], q["key"], number, i) for i in range(max(0, bisect.bisect_left(first, q["key"]) - 1), bisect.bisect_right(first, q["key"]))]
            yield _columns(out, url=pa.string(), key=pa.string(), range=pa.int64(), block=pa.int64())

    def to_captures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for asked, data in zip(batch.column("asked").to_pylist(), batch.column("data").to_pylist(), strict=True):
                out, lines = [], _lines(data)
                for q in asked:
                    at = bisect.bisect_left(lines, q["key"], key=lambda line: line[0])
                    while at < len(lines) and lines[at][0] == q["key"]:
                        out.append((q["url"], *lines[at][1:]))
                        at += 1
                yield _columns(out, url=pa.string(), archive=pa.string(), page_id=pa.int64(), offset=pa.int64(), length=pa.int64())

    def asked(rows: DataFrame, *by: str) -> DataFrame:
        """The urls asked of each range or block together, in parts, so that it is opened a few times only."""
        part = F.pmod(F.xxhash64("url"), F.lit(ASKED_PARTS))
        return rows.groupBy(*by, part.alias("part")).agg(F.collect_list(F.struct("url", "key")).alias("asked")).drop("part")

    ranged = urls.select(F.col("url").cast("string").alias("url")).distinct().mapInArrow(to_range, "url string, key string, range long")
    blocked = asked(ranged, "range").join(directory, "range").mapInArrow(to_block, "url string, key string, range long, block long")
    met = asked(blocked, "range", "block").join(blocks, ["range", "block"]).select("asked", "data")
    return met.mapInArrow(to_captures, "url string, archive string, page_id long, offset long, length long")


def read_records(captures: DataFrame, archives: DataFrame) -> DataFrame:
    """``page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload`` of the captures, each place once.

    Places go to the archives, whose bytes stay where they were written; each record's range is cut out before it is read.
    """
    places = captures.select("archive", "offset", "length").repartition(_buckets(archives), "archive")
    wanted = places.groupBy("archive").agg(F.array_sort(F.collect_set(F.struct("offset", "length"))).alias("places"))

    def number(name: str | None) -> int | None:
        found = _ID.match(name or "")
        return int(found[1]) if found and found[1] else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for data in batch.column("record").to_pylist():
                r = parse(data)
                digest = r["WARC-Payload-Digest"].removeprefix("sha1:")
                if r["payload"] is not None and base64.b32encode(hashlib.sha1(r["payload"]).digest()).decode() != digest:
                    raise ValueError(f"payload of {r['WARC-Record-ID']} doesn't match its digest")
                rows.append((number(r["WARC-Record-ID"]), r["WARC-Target-URI"], r["length"], digest, r["WARC-Type"], number(r.get("WARC-Refers-To")), r["payload"]))
            yield _columns(rows, page_id=pa.int64(), url=pa.string(), payload_bytes=pa.int64(), payload_digest=pa.string(), record_type=pa.string(), refers_to=pa.int64(), payload=pa.binary())

    each = wanted.join(archives.select("archive", "data"), "archive").select("data", F.explode("places").alias("at"))
    cut = each.select(F.substring("data", (F.col("at.offset") + 1).cast("int"), F.col("at.length").cast("int")).alias("record"))
    return cut.mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")
