"""WARC archives of pages, and a two-level capture index over them.

Writing: payloads are grouped by SHA-1 over slim rows; of equal payloads the one with the smallest page_id is the
response, the others revisit it. Pages are shuffled once, by (page_id, digest), so that neither a common payload
nor a common host makes a large task, and each task writes gzip-per-record WARC/1.1 files.

Index: the captures' reversed-host URL keys are range-sorted (host, path and page_id, so a common host is split)
into compressed blocks; a sparse directory has the first key and id, file, offset and length of each block. A lookup
binary-searches the directory, reads one run of blocks and then only the ranges of the records it wants. The query looks
up every page by its key and id, and reads the records it is led to.

Edge cases: a null html is an empty payload; a null page_id ranks last and has no id header; a null url has the key
'' and no target header; rows equal in page_id and payload are each a capture, of which those with the least url
are responses; extra columns are ignored; an empty table gives empty archives. Payloads are kept whole.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import uuid
import zlib
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import filesystem, fresh, put_file, small_batches, table, tidy, written

DATE = "1970-01-01T00:00:00Z"
FILE_BYTES = 1 << 30
BLOCK_LINES = 3000
SPACE = uuid.UUID("5d3f9a52-3f0b-4b1e-9f0c-7a6f1c2b8e11")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def url_key(url: str | None) -> str:
    """Reversed host, then path and query: ``com,example,blog)/a?b=1``. Scheme, user, default port, leading www
    and fragment are dropped; the host is lower case."""
    if not url:
        return ""
    try:
        parts = urlsplit(url if "//" in url else f"//{url}")
        host, port = (parts.hostname or "").rstrip("."), parts.port
    except ValueError:
        return url
    labels = [x for x in host.split(".") if x]
    labels = labels[1:] if len(labels) > 2 and labels[0] == "www" else labels
    tail = f":{port}" if port and port not in (80, 443) else ""
    return f"{','.join(reversed(labels))}{tail}){parts.path or '/'}{'?' + parts.query if parts.query else ''}"


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def _record(kind: str, page_id, url, payload: bytes, digest: str, refers_to, refers_url) -> bytes:
    name = lambda i: f"<urn:uuid:{uuid.uuid5(SPACE, f'{i}:{digest}')}>"
    safe = lambda u: quote(u or "", safe="".join(map(chr, range(33, 127))))
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}"]
    head += [f"WARC-Target-URI: {safe(url)}"] * bool(url) + [f"X-Page-Id: {page_id}"] * (page_id is not None)
    if kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {name(refers_to)}"] + [f"WARC-Refers-To-Target-URI: {safe(refers_url)}"] * bool(refers_url) + [f"X-Refers-To-Page-Id: {refers_to}"] * (refers_to is not None)
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(raw: bytes) -> bytes:
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(raw) + pack.flush()


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower case) and block of one gzip member."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    fields = {k.lower(): v for k, v in fields.items()}
    return fields, rest[: int(fields["content-length"])]


CAPTURES = "key string, page_id bigint, path string, offset bigint, length bigint"


def _write_archives(folder: str):
    def run(batches):
        # one file is open at a time; a file's captures leave once it is whole
        part, pending = TaskContext.get().partitionId(), None
        rows = (r for b in batches for at in range(0, b.num_rows, 256) for r in b.slice(at, 256).to_pylist())
        number = 0
        while True:
            uri, held = f"{folder}/{part:06d}-{number:04d}.warc.gz", []

            def members():
                nonlocal pending
                at = 0
                while at < FILE_BYTES:
                    row, pending = (pending or next(rows, None)), None
                    if row is None:
                        return
                    payload = (row["html"] or "").encode()
                    kind = "revisit" if row["is_revisit"] else "response"
                    raw = gzip_member(_record(kind, row["page_id"], row["url"], payload, base32(bytes.fromhex(row["digest"])), row["refers_to"], row["refers_url"]))
                    held.append((url_key(row["url"]), row["page_id"], uri, at, len(raw)))
                    at += len(raw)
                    yield raw

            pending = next(rows, None)
            if pending is None:
                return
            put_file(uri, members())
            kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
            for at in range(0, len(held), 10_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held[at : at + 10_000], strict=True), kinds, strict=True)], names=["key", "page_id", "path", "offset", "length"])
            number += 1

    return run


def roles(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, digest and url of every revisit, with the capture it refers to; slim rows only."""
    body = F.coalesce(F.col("html"), F.lit(""))
    slim = pages.select("page_id", "url", F.sha1(F.encode(body, "UTF-8")).alias("digest"), F.octet_length(body).alias("_size")).filter(F.col("_size") >= min_bytes)
    rank = F.struct(F.col("page_id").isNull().alias("a"), F.col("page_id").alias("b"), F.coalesce("url", F.lit("")).alias("c"))
    first = slim.groupBy("digest").agg(F.min(rank).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest", "first")
    return slim.join(first, "digest").filter(rank != F.col("first")).select("page_id", "url", "digest", F.col("first.b").alias("refers_to"), F.col("first.c").alias("refers_url")).distinct()


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0) -> DataFrame:
    """Writes the archives; the captures' keys and places, as a table in the shared folder."""
    whole = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    body = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    revisits = roles(whole, min_bytes).select(F.col("page_id").alias("_p"), F.col("url").alias("_u"), F.col("digest").alias("_d"), "refers_to", "refers_url", F.lit(True).alias("_revisit"))
    kept = whole.withColumn("digest", F.sha1(body))
    both = kept.join(revisits, kept["page_id"].eqNullSafe(F.col("_p")) & (kept["digest"] == F.col("_d")) & kept["url"].eqNullSafe(F.col("_u")), "left")
    dealt = both.select("page_id", "url", "html", "digest", "refers_to", "refers_url", F.coalesce("_revisit", F.lit(False)).alias("is_revisit"))
    small_batches(pages.sparkSession)
    return written(dealt.mapInArrow(tidy(_write_archives(folder)), CAPTURES), "captures")


def _write_index(folder: str):
    def run(batches):
        uri, places, offset = f"{folder}/{TaskContext.get().partitionId():06d}.idx", [], 0

        def blocks():
            nonlocal offset
            lines = []

            def ended():
                nonlocal offset
                raw = gzip_member(b"".join(lines))
                places.append((*json.loads(lines[0])[:2], uri, offset, len(raw), len(lines)))
                offset += len(raw)
                return raw

            for batch in batches:
                for row in zip(*[batch.column(c).to_pylist() for c in ("key", "page_id", "path", "offset", "length")], strict=True):
                    lines.append(json.dumps(row).encode() + b"\n")
                    if len(lines) == BLOCK_LINES:
                        yield ended()
                        lines = []
            if lines:
                yield ended()

        put_file(uri, blocks())
        if places:
            kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*places, strict=True), kinds, strict=True)], names=["first_key", "first_id", "path", "offset", "length", "lines"])

    return run


def write_index(captures: DataFrame, folder: str) -> DataFrame:
    """Sorts the captures into compressed blocks; the sparse directory, as a table in the shared folder."""
    ordered = captures.repartitionByRange("key", "page_id").sortWithinPartitions("key", "page_id", "path", "offset")
    return written(ordered.mapInArrow(_write_index(folder), "first_key string, first_id bigint, path string, offset bigint, length bigint, lines bigint"), "directory")


def _range(uri: str, at: int, length: int) -> bytes:
    store, path = filesystem(uri)
    with store.open_input_file(path) as f:
        f.seek(at)
        return f.read(length)


def _read_blocks(batches):
    for batch in batches:
        for uri, at, length in zip(batch.column("path").to_pylist(), batch.column("offset").to_pylist(), batch.column("length").to_pylist(), strict=True):
            rows = [json.loads(x) for x in zlib.decompress(_range(uri, at, length), 31).split(b"\n")[:-1]]
            kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["key", "page_id", "path", "offset", "length"])


def capture_of(member: bytes) -> tuple:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of one record."""
    fields, block = parse(member)
    number = lambda name: int(fields[name]) if name in fields else None
    kind, digest, size = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha1:"), number("x-payload-length")
    if kind == "response":
        payload = block.partition(b"\r\n\r\n")[2]
        if (len(payload), base32(hashlib.sha1(payload).digest())) != (size, digest):
            raise ValueError("a record's payload doesn't match its headers")
    return number("x-page-id"), size, digest, kind, number("x-refers-to-page-id")


def _read_records(batches):
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    name, file = None, None
    for batch in batches:
        held = []
        for uri, at, length in zip(batch.column("path").to_pylist(), batch.column("offset").to_pylist(), batch.column("length").to_pylist(), strict=True):
            if uri != name:
                store, path = filesystem(uri)
                name, file = uri, store.open_input_file(path)
            file.seek(at)
            held.append(capture_of(file.read(length)))
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])


def read_index(directory: DataFrame) -> DataFrame:
    """All lines of the index."""
    return directory.select("path", "offset", "length").mapInArrow(_read_blocks, CAPTURES)


def read_archives(captures: DataFrame) -> DataFrame:
    """Every capture's record, by range reads in file order."""
    placed = captures.select("path", "offset", "length").repartitionByRange("path", "offset").sortWithinPartitions("path", "offset")
    return placed.mapInArrow(_read_records, "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint")


def _place(key: str, page_id: int | None) -> tuple:
    """The index's order: Spark puts nulls first."""
    return key, page_id is not None, page_id or 0


class CaptureIndex:
    """Lookups by URL, or by key and page, over the sparse directory."""

    def __init__(self, directory: list):
        self.blocks = sorted((_place(r["first_key"], r["first_id"]), r["path"], r["offset"], r["length"]) for r in directory)
        self.firsts = [b[0] for b in self.blocks]
        self.held: dict[int, tuple[list, list]] = {}

    def _lines(self, i: int) -> tuple[list, list]:
        """(places, lines) of a block; the last two are kept, for lookups that come in order."""
        if i not in self.held:
            self.held = {k: v for k, v in self.held.items() if k == i - 1}
            lines = [json.loads(x) for x in zlib.decompress(_range(*self.blocks[i][1:]), 31).split(b"\n")[:-1]]
            self.held[i] = [_place(*x[:2]) for x in lines], lines
        return self.held[i]

    def _between(self, low: tuple, high: tuple):
        """Lines whose places lie in [low, high]: a binary search of the directory, then of each block of the run."""
        i = max(0, bisect.bisect_left(self.firsts, low) - 1)
        while i < len(self.blocks) and self.firsts[i] <= high:
            places, lines = self._lines(i)
            yield from lines[bisect.bisect_left(places, low) : bisect.bisect_right(places, high)]
            i += 1

    def captures(self, key: str, page_id: int | None):
        """Index lines of a page under its URL's key."""
        return self._between(place := _place(key, page_id), place)

    def find(self, url: str) -> list[list]:
        """Index lines of the captures of a URL."""
        return list(self._between((key := url_key(url), False, 0), (key, True, float("inf"))))

    def read(self, url: str) -> list[tuple[dict[str, str], bytes]]:
        return [parse(_range(path, at, length)) for _, _, path, at, length in self.find(url)]


def _keys(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array(map(url_key, batch.column("url").to_pylist()), pa.string()), batch.column("page_id")], names=["key", "page_id"])


def look_up(pages: DataFrame, directory: DataFrame) -> DataFrame:
    """The captures of every page, each page found by its URL's key and id in the two-level index. The directory has a row
    for some thousand captures and goes to all tasks; lookups come in the index's order, so that a task reads a block once."""
    blocks = [r.asDict() for r in directory.collect()]

    def run(batches):
        index, last = CaptureIndex(blocks), None
        kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        for batch in batches:
            held = []
            for wanted in zip(batch.column("key").to_pylist(), batch.column("page_id").to_pylist(), strict=True):
                if wanted != last:  # repeated rows are found together
                    held += index.captures(*wanted)
                last = wanted
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=["key", "page_id", "path", "offset", "length"])

    wanted = pages.select(F.col("url").cast("string").alias("url"), F.col("page_id").cast("long").alias("page_id")).mapInArrow(_keys, "key string, page_id bigint")
    return wanted.repartitionByRange("key", "page_id").sortWithinPartitions("key", "page_id").mapInArrow(run, CAPTURES)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, pages = fresh(spark, "warc"), table(spark, sf_dir, "pages")
    directory = write_index(write_archives(pages, folder), f"{folder}-index")
    return read_archives(look_up(pages, directory))


_FIVE = "('0x' || substr(h, {0}, 5))::INTEGER"
_LETTERS = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (({_FIVE.format(1 + 5 * g)} >> {shift}) & 31) + 1, 1)" for g in range(8) for shift in (15, 10, 5, 0))
ORACLE = {"op7_warc": f"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, payload_bytes, {_LETTERS} AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM f"""}
