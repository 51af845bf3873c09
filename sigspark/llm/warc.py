"""WARC archives with a two-level capture index.

The store is one that only Spark reaches, so an archive is a row: its number
and its bytes, gzip members one after another, one for each record. The index
holds a line for each record, sorted by the reversed host of its address and
cut into compressed blocks; a sparse directory holds the first key of each block.
"""
from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigspark.llm.common import record, stored

#: Payloads of fewer bytes are never referred to.
LEAST_SHARED = 1000
#: Bytes at which an archive is closed.
ARCHIVE_BYTES = 8 << 20
#: Lines of an index block; more where the directory would pass DIRECTORY_ENTRIES.
BLOCK_LINES = 1000
DIRECTORY_ENTRIES = 1 << 16
_KEEP = 200  # characters of a key that the directory keeps
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # fixed value: the namespace of addresses
_DATE = "2024-01-01T00:00:00Z"


def surt(url: str | None) -> str:
    """Sort key of an address: host labels reversed and comma-joined, then the path."""
    try:
        parts = urlsplit((url or "").strip())
        host, port = (parts.hostname or "").rstrip("."), parts.port
    except ValueError:
        return ")/" + (url or "")
    labels = host.split(".")
    if len(labels) > 1 and labels[0].rstrip("0123456789") == "www":
        labels = labels[1:]
    at = "" if port in (None, 80, 443) else f":{port}"
    query = f"?{parts.query}" if parts.query else ""
    return ",".join(reversed(labels)) + at + ")" + (parts.path or "/") + query


def line_key(url: str | None, page_id: int | None) -> str:
    """Address and page: a line of the index has a key of its own, however many captures an address has."""
    clean = "".join(c if c > " " else "%%%02X" % ord(c) for c in surt(url))
    return f"{clean} {-1 if page_id is None else page_id:020d}"


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'page:{page_id}')}>"


def write_record(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    """One record; a revisit has the response's headers and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    target = "".join(c if c > " " else "%%%02X" % ord(c) for c in url or "")
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Date: {_DATE}", f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}", "Content-Type: application/http; msgtype=response",
        f"X-Page-Number: {'' if page_id is None else page_id}",
    ]
    if refers_to is not None:
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page-Number: {refers_to}",
        ]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _fields(lines: bytes) -> dict[str, str]:
    pairs = (line.split(":", 1) for line in lines.decode("utf-8", "replace").split("\r\n")[1:] if ":" in line)
    return {k.strip().lower(): v.strip() for k, v in pairs}


def read_record(data: bytes) -> dict:
    """Fields of a record, its payload, and whether the payload has the stated digest."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = _fields(head)
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    digest = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
    revisit = fields["warc-type"] == "revisit"
    number = lambda k: int(fields[k]) if fields.get(k) else None
    return {
        "page_id": number("x-page-number"), "url": fields["warc-target-uri"], "record_type": fields["warc-type"],
        "refers_to": number("x-refers-to-page-number"), "payload_digest": digest,
        "payload_bytes": int(_fields(http)["content-length"]), "payload": None if revisit else payload,
        "intact": revisit or hashlib.sha1(payload).hexdigest() == digest,
    }


def squeezed(data: bytes) -> bytes:
    """A gzip member that does not depend on the clock."""
    c = zlib.compressobj(4, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def with_responses(pages: DataFrame) -> DataFrame:
    """Adds payload, digest and ``refers_to``: the largest page_id of equal payloads, null at that page itself.

    Digests are counted before they are joined, so a payload that a third of all pages share is one row there.
    """
    body = F.coalesce("html", F.lit("")).cast("binary")
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", body.alias("payload"))
    own = own.select("*", F.sha1("payload").alias("digest"))
    shared = own.filter(F.length("payload") >= LEAST_SHARED).groupBy("digest").agg(F.max("page_id").alias("_last"), F.count(F.lit(1)).alias("_n"))
    out = own.join(shared.filter("_n > 1").drop("_n"), "digest", "left")
    refers = F.when((F.col("_last") != F.coalesce("page_id", F.lit(-1))) & (F.length("payload") >= LEAST_SHARED), F.col("_last"))
    return out.select("page_id", "url", "payload", "digest", refers.alias("refers_to"))


def write_archives(pages: DataFrame) -> DataFrame:
    """(archive, content, lines): the archives of all pages, stored, with the index lines of their records.

    Needs ``page_id``, ``url`` and ``html``. Null html is an empty payload, a
    null url an empty address. Empty tables give no archive. Pages of equal
    page_id and payload become responses of their own.
    """
    schema = pa.schema([("archive", pa.string()), ("content", pa.binary()), ("keys", pa.list_(pa.string())), ("offsets", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64()))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        members, keys, held = [], [], 0

        def closed():
            content = b"".join(members)
            name = hashlib.sha1(content).hexdigest()[:16] + hashlib.sha1("\n".join(keys).encode("utf-8", "replace")).hexdigest()[:16]
            sizes = [len(m) for m in members]
            return record(schema, [name], [content], [keys], [list(accumulate(sizes[:-1], initial=0))], [sizes])

        for batch in batches:
            for page_id, url, payload, digest, refers in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "refers_to"))):
                members.append(squeezed(write_record(page_id, url, payload, digest, refers)))
                keys.append(line_key(url, page_id))
                held += len(members[-1])
                if held >= ARCHIVE_BYTES:
                    yield closed()
                    members, keys, held = [], [], 0
        if members:
            yield closed()

    made = with_responses(pages).mapInArrow(work, "archive string, content binary, keys array<string>, offsets array<long>, sizes array<long>")
    return stored(made, "archives")


def index_lines(archives: DataFrame) -> DataFrame:
    """(key, archive, offset, size) of every record."""
    lines = archives.select("archive", F.explode(F.arrays_zip("keys", "sizes", "offsets")).alias("l"))
    return lines.select(F.col("l.keys").alias("key"), "archive", F.col("l.offsets").alias("offset"), F.col("l.sizes").alias("size"))


def build_index(lines: DataFrame, block_lines: int = BLOCK_LINES) -> tuple[DataFrame, list[str]]:
    """Stored blocks (block, first, content) and the directory of their first keys.

    Lines are dealt out by ranges of their keys, sorted, and cut into blocks of
    ``block_lines``, or of as many lines as keep the directory within
    DIRECTORY_ENTRIES. The directory keeps the first characters of a key.
    """
    lines = stored(lines, "lines")
    count = lines.count()
    per = max(block_lines, -(-2 * count // DIRECTORY_ENTRIES))
    schema = pa.schema([("first", pa.string()), ("content", pa.binary())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[str] = []

        def block(some):
            return record(schema, [some[0].partition("\t")[0]], [zlib.compress("\n".join(some).encode("utf-8", "surrogatepass"))])

        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("key", "archive", "offset", "size")]
            rows += ["\t".join(map(str, r)) for r in zip(*cols)]
            while len(rows) >= per:
                yield block(rows[:per])
                rows = rows[per:]
        if rows:
            yield block(rows)

    parts = max(1, min(DIRECTORY_ENTRIES // 2, -(-count // (per * 4))))
    laid = lines.repartitionByRange(parts, "key").sortWithinPartitions("key", "archive", "offset")
    blocks = stored(laid.mapInArrow(work, "first string, content binary"), "blocks")
    # Bounded by DIRECTORY_ENTRIES, and each key by its first characters.
    directory = sorted(r[0] for r in blocks.select(F.substring("first", 1, _KEEP)).collect())
    return blocks, directory


def find(keys: DataFrame, blocks: DataFrame, directory: list[str]) -> DataFrame:
    """(key, archive, offset, size) of all index lines with the wanted keys.

    A key is looked up in the directory by binary search, goes to the blocks
    that may hold it, and is searched by halves in the opened block. Equal keys
    are looked up once.
    """
    shared = keys.sparkSession.sparkContext.broadcast(directory)
    to = pa.schema([("first", pa.string()), ("key", pa.string())])

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = shared.value
        for batch in batches:
            firsts, wanted = [], []
            for key in batch.column("key").to_pylist():
                short = key[:_KEEP]
                for i in sorted({d[j] for j in range(max(0, bisect_left(d, short) - 1), bisect_right(d, short))}):
                    firsts.append(i)
                    wanted.append(key)
            yield record(to, firsts, wanted)

    asked = keys.select("key").distinct().mapInArrow(places, "first string, key string")
    out = pa.schema([("key", pa.string()), ("archive", pa.string()), ("offset", pa.int64()), ("size", pa.int64())])

    def search(wanted: pa.Table, found: pa.Table) -> pa.Table:
        hits = []
        for content in found.column("content").to_pylist():
            rows = zlib.decompress(content).decode("utf-8", "surrogatepass").split("\n")
            for key in wanted.column("key").to_pylist():
                i = bisect_left(rows, key + "\t")
                while i < len(rows) and rows[i].startswith(key + "\t"):
                    hits.append(rows[i].split("\t"))
                    i += 1
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*[(k, a, int(o), int(n)) for k, a, o, n in hits]) if hits else [[]] * 4, out)], schema=out)

    own = blocks.select(F.substring("first", 1, _KEEP).alias("first"), "content")
    return asked.groupBy("first").cogroup(own.groupBy("first")).applyInArrow(search, "key string, archive string, offset long, size long")


def read_ranges(places: DataFrame, archives: DataFrame) -> DataFrame:
    """The records at (archive, offset, size), read back from the archives' bytes."""
    wanted = places.groupBy("archive").agg(F.collect_set(F.struct("offset", "size")).alias("ranges"))  # at most the records of an archive
    schema = pa.schema([
        ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_digest", pa.string()),
        ("payload_bytes", pa.int64()), ("payload", pa.binary()), ("intact", pa.bool_()),
    ])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                content = memoryview(batch.column("content")[i].as_buffer())
                ranges = sorted((r["offset"], r["size"]) for r in batch.column("ranges")[i].as_py())
                for s in range(0, len(ranges), 256):
                    got = [read_record(zlib.decompress(content[o : o + n], 31)) for o, n in ranges[s : s + 256]]
                    yield record(schema, *([g[f.name] for g in got] for f in schema))

    text = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary, intact boolean"
    return archives.select("archive", "content").join(wanted, "archive").select("content", "ranges").mapInArrow(work, text)


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes all pages, indexes the archives, looks every page up by its address and reads its record.

    A repeated page (same id, address and payload) comes back as often as it was written.
    """
    schema = pa.schema([("key", pa.string())])

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield record(schema, [line_key(u, p) for u, p in zip(batch.column("url").to_pylist(), batch.column("page_id").to_pylist())])

    archives = write_archives(pages)
    blocks, directory = build_index(index_lines(archives))
    wanted = pages.select(F.col("page_id").cast("long").alias("page_id"), "url").mapInArrow(keyed, "key string")
    return read_ranges(find(wanted, blocks, directory), archives)
