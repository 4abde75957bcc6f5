"""WARC archives of web pages with a two-level capture index.

Writing: a record per page, gzip members one after the other, a file per task.  Of pages with
equal payloads (HTML in UTF-8) of at least ``LEAST_PAYLOAD`` bytes one is a response, the
others are revisits without the payload: digests are grouped without the pages, and only
groups of several are looked up again, broadcast up to a checked number of rows, else by a
shuffled join.  A task that fails leaves a file that no table names; the table of records is
written by Spark, so it names the files of finished tasks only.

Index: the table of records, ordered over the cluster by reversed-host key, is packed into compressed
blocks of ``LINES`` lines; the directory has a row per block with its first and last key.  A lookup
searches the directory by bisection, reads the block's range, searches in it by bisection, and
reads the records' ranges, neighbours at once.  The directory is broadcast up to a checked number of
blocks; beyond, the blocks are unpacked by tasks and join the keys.

Nulls: a null html is the empty payload, a null url has the key "", a null page_id stands after all
others.  Ties: of rows with one page_id the smallest url (null last) is the response; rows that repeat
both and the payload are records of their own, one of them the response.  Extra columns are not looked
at.  A very long page is one record, in memory once at a time.  Empty tables give empty results.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, scratch, steps, table, written

LEAST_PAYLOAD, LEVEL, DATE = 100, 3, "1970-01-01T00:00:00Z"
#: Lines of an index block, bytes that one range read takes where records stand next to each other, bytes of a file that one task reads.
LINES, WINDOW, STRETCH = 1000, 4 << 20, 64 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = b"\r\n\r\n"


def place(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system and the path in it."""
    local = re.sub(r"^file:/+", "/", path)
    return (pafs.LocalFileSystem(), local) if local.startswith("/") else pafs.FileSystem.from_uri(path)


def capture_key(url: str | None) -> str:
    """The host's parts reversed, then port, path and query: ``org,example,www)/a?b``; ASCII without blanks."""
    found = re.match(r"(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)([^#]*)", url or "", re.S)
    if not found:
        return quote((url or "").partition("#")[0], safe="!$%&'()*+,/:;=?@[]~")
    host, _, port = found[1].rpartition("@")[2].lower().partition(":")
    parts = host.split(".")
    name = host if all(x.isdigit() for x in parts) else ",".join(reversed(parts))
    return quote(name + (f":{port}" if port not in ("", "80", "443") else "") + ")" + (found[2] or "/"), safe="!$%&'()*+,/:;=?@[]~")


def record_id(*parts: object) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(repr(parts).encode()).digest())}>"


def record(page_id: int | None, url: str | None, payload: bytes | None, size: int, digest: str, refers: tuple | None, ident: str) -> bytes:
    """One record as a gzip member; ``refers`` (page_id, url) makes it a revisit."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if refers else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if refers else 'response'}", f"WARC-Record-ID: {ident}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=chr(33) + '#$%&()*+,/:;=?@[]~' + chr(39))}")
    if page_id is not None:
        head.append(f"X-Page: {page_id}")
    if refers:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(*refers, digest)}"]
        if refers[1] is not None:
            head.append(f"WARC-Refers-To-Target-URI: {quote(refers[1], safe=chr(33) + '#$%&()*+,/:;=?@[]~' + chr(39))}")
        if refers[0] is not None:
            head.append(f"X-Refers-To-Page: {refers[0]}")
    head += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return gzip.compress("\r\n".join(head).encode() + END + block + END, LEVEL, mtime=0)


def parsed(member: bytes) -> dict:
    """A record from its bytes: page_id, payload_bytes, payload_digest, record_type, refers_to, html (None for a revisit).

    Sizes and digest of a response are those of the payload that is there; they must agree with the header.
    """
    data = zlib.decompress(member, wbits=31)
    head, _, rest = data.partition(END)
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    if len(rest) != len(block) + len(END) or not rest.endswith(END):
        raise ValueError(f"record {fields['WARC-Record-ID']} is cut")
    http, _, payload = block.partition(END)
    size, digest = int(re.search(rb"Content-Length: ([0-9]+)", http)[1]), fields["WARC-Payload-Digest"].removeprefix("sha256:")
    number = lambda name: int(fields[name]) if name in fields else None
    revisit = fields["WARC-Type"] == "revisit"
    if not revisit:
        if len(payload) != size or hashlib.sha256(payload).hexdigest() != digest:
            raise ValueError(f"payload of record {fields['WARC-Record-ID']} differs from its digest")
    return {"page_id": number("X-Page"), "payload_bytes": size, "payload_digest": digest, "record_type": fields["WARC-Type"], "refers_to": number("X-Refers-To-Page") if revisit else None, "html": None if revisit else payload.decode()}


def _html() -> Column:
    return F.coalesce(F.col("html").cast("string"), F.lit(""))


def records(pages: DataFrame) -> DataFrame:
    """What is written for each page: page_id, url, html (null for a revisit), n_bytes, digest, revisit, best (page_id, url of the response)."""
    digest = F.unhex(F.sha2(_html().cast("binary"), 256))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), _html().alias("html"), F.octet_length(_html()).cast("long").alias("n_bytes"), digest.alias("digest"))
    same = rows.where(F.col("n_bytes") >= LEAST_PAYLOAD).groupBy("digest", "page_id", "url", "n_bytes").agg(F.count("*").alias("times"))
    order = F.struct(F.col("page_id").isNull(), "page_id", F.col("url").isNull(), "url")
    groups = same.groupBy("digest", "n_bytes").agg(F.min_by(F.struct("page_id", "url", "times"), order).alias("best"), F.sum("times").alias("n")).where("n > 1")
    groups = written(groups.select("digest", "best", "n_bytes"), "payload-groups")
    few = groups.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    found = rows.join(F.broadcast(groups.drop("n_bytes")) if few else groups.drop("n_bytes"), "digest", "left")
    own = F.col("page_id").eqNullSafe(F.col("best.page_id")) & F.col("url").eqNullSafe(F.col("best.url"))
    found = found.withColumn("revisit", F.col("best").isNotNull() & ~own)
    if groups.where("best.times > 1").limit(1).count():  # rows that repeat everything: one response, revisits from the table of groups
        many = ~F.col("revisit") & (F.coalesce(F.col("best.times"), F.lit(1)) > 1)
        more = groups.where("best.times > 1").select("best.page_id", "best.url", F.lit(None).cast("string").alias("html"), "n_bytes", "digest", "best", F.lit(True).alias("revisit"), F.explode(F.expr("sequence(2, best.times)")).alias("i")).drop("i")
        found = found.where(~many).unionByName(found.where(many).dropDuplicates(["digest"])).unionByName(more)
    html = F.when(~F.col("revisit"), F.col("html"))
    return found.select("page_id", "url", html.alias("html"), "n_bytes", F.lower(F.hex("digest")).alias("digest"), "revisit", F.struct("best.page_id", "best.url").alias("best"))


CAPTURES = "key string, page_id long, file string, offset long, length long"


def _captures(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 5
    kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in CAPTURES.split(", ")])


@dataclass
class Archive:
    """Archives in a folder: the directory of the index is a table; the table of records isn't needed to read."""

    folder: str
    directory: DataFrame  # first, last, file, offset, length


def write_archive(pages: DataFrame, folder: str | None = None) -> Archive:
    """Writes the records and the index."""
    folder = folder or scratch(pages.sparkSession, "warc")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, sink, at = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz", None, 0
        try:
            for batch in batches:
                for part in steps(batch, "html"):
                    out = []
                    for r in part.to_pylist():
                        refers = (r["best"]["page_id"], r["best"]["url"]) if r["revisit"] else None
                        ident = record_id(name, at) if refers else record_id(r["page_id"], r["url"], r["digest"])
                        member = record(r["page_id"], r["url"], (r["html"] or "").encode(), r["n_bytes"], r["digest"], refers, ident)
                        if sink is None:
                            fs, path = place(f"{folder}/records")
                            fs.create_dir(path)
                            sink = fs.open_output_stream(f"{path}/{name}", compression=None)
                        sink.write(member)
                        out.append((capture_key(r["url"]), r["page_id"], name, at, len(member)))
                        at += len(member)
                    yield _captures(out)
        finally:
            if sink is not None:
                sink.close()

    return Archive(folder, build_index(written(records(pages).mapInArrow(write, CAPTURES), "captures"), folder))


DIRECTORY = "first string, last string, file string, offset long, length long"


def build_index(captures: DataFrame, folder: str) -> DataFrame:
    """Ordered captures in compressed blocks; a row per block."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, sink, at, held = f"index-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.gz", None, 0, []

        def block() -> pa.RecordBatch:
            nonlocal sink, at
            if sink is None:
                fs, path = place(f"{folder}/index")
                fs.create_dir(path)
                sink = fs.open_output_stream(f"{path}/{name}", compression=None)
            lines = held[:LINES]
            data = gzip.compress("".join("\t".join("" if x is None else str(x) for x in r) + "\n" for r in lines).encode(), mtime=0)
            sink.write(data)
            row = (lines[0][0], lines[-1][0], name, at, len(data))
            at += len(data)
            del held[:LINES]
            kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names=[x.split()[0] for x in DIRECTORY.split(", ")])

        try:
            for batch in batches:
                held += zip(*(c.to_pylist() for c in batch.columns), strict=True)
                while len(held) >= LINES:
                    yield block()
            if held:
                yield block()
        finally:
            if sink is not None:
                sink.close()

    order = ("key", "page_id", "file", "offset")
    return written(captures.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(pack, DIRECTORY), "directory")


def _lines(folder: str, file: str, offset: int, length: int) -> list[list[str]]:
    """The lines of a block, read as one range."""
    fs, path = place(f"{folder}/index/{file}")
    with fs.open_input_file(path) as source:
        return [x.split("\t") for x in zlib.decompress(source.read_at(length, offset), wbits=31).decode().splitlines()]


def _capture(x: list[str]) -> tuple:
    return x[0], int(x[1]) if x[1] else None, x[2], int(x[3]), int(x[4])


def keys_of(urls: DataFrame) -> DataFrame:
    """The distinct keys of a column ``url``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([capture_key(x) for x in batch.column(0).to_pylist()], pa.string())], names=["key"])

    return urls.select(F.col("url").cast("string")).mapInArrow(run, "key string").distinct()


def lookup(archive: Archive, keys: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """All captures of the distinct ``keys``: key, page_id, file, offset, length."""
    folder = archive.folder
    if archive.directory.limit(most + 1).count() > most:

        def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for b in batch.to_pylist():
                    yield _captures([_capture(x) for x in _lines(folder, b["file"], b["offset"], b["length"])])

        return archive.directory.repartition("file", "offset").mapInArrow(unpack, CAPTURES).join(keys, "key")
    blocks = archive.directory.orderBy("first", "last", "file", "offset").collect()  # at most ``most``
    shared = keys.sparkSession.sparkContext.broadcast(([b["first"] for b in blocks], [b["last"] for b in blocks], [(b["file"], b["offset"], b["length"]) for b in blocks]))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, last, where = shared.value
        for batch in batches:
            out = []
            for key in batch.column(0).to_pylist():
                at = bisect_left(last, key)  # the first block that reaches the key, and all further ones that begin with it
                while at < len(first) and first[at] <= key:
                    out.append((key, None, *where[at]))
                    at += 1
            yield _captures(out)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, lines, names = None, [], []
        for batch in batches:
            out = []
            for w in batch.to_pylist():
                if now != (w["file"], w["offset"]):
                    now, lines = (w["file"], w["offset"]), _lines(folder, w["file"], w["offset"], w["length"])
                    names = [x[0] for x in lines]
                at = bisect_left(names, w["key"])
                while at < len(names) and names[at] == w["key"]:
                    out.append(_capture(lines[at]))
                    at += 1
            yield _captures(out)

    wanted = keys.select("key").mapInArrow(search, CAPTURES)
    return wanted.repartition("file", "offset").sortWithinPartitions("file", "offset", "key").mapInArrow(read, CAPTURES)


def read_records(archive: Archive, captures: DataFrame, html: bool = True) -> DataFrame:
    """The records at the captures: page_id, payload_bytes, payload_digest, record_type, refers_to and, if asked for, html."""
    folder = archive.folder
    kinds = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64()} | ({"html": pa.string()} if html else {})

    def batch_of(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], k) for c, k in kinds.items()], names=list(kinds))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, source, low, window = None, None, 0, b""
        try:
            for batch in batches:
                out, held = [], 0
                for file, at, length in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length")), strict=True):
                    if file != name:
                        if source is not None:
                            source.close()
                        fs, path = place(f"{folder}/records/{file}")
                        name, source, window = file, fs.open_input_file(path), b""
                    if not (low <= at and at + length <= low + len(window)):
                        low, window = at, source.read_at(max(length, WINDOW), at)
                    out.append(parsed(window[at - low : at - low + length]))
                    held += out[-1]["payload_bytes"]
                    if held >= WINDOW:
                        yield batch_of(out)
                        out, held = [], 0
                yield batch_of(out)
        finally:
            if source is not None:
                source.close()

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + (", html string" if html else "")
    near = captures.withColumn("stretch", F.expr(f"offset div {STRETCH}"))
    return near.repartition("file", "stretch").sortWithinPartitions("file", "offset").mapInArrow(read, schema)


def pages_at(archive: Archive, urls: DataFrame) -> DataFrame:
    """The records of all captures of a column ``url``."""
    return read_records(archive, lookup(archive, keys_of(urls)))


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    archive = write_archive(pages)
    return read_records(archive, lookup(archive, keys_of(pages)), html=False)


SQL = """
WITH p AS (
  SELECT page_id, url, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
m AS (
  SELECT *, row_number() OVER g > 1 AND payload_bytes >= 100 AS revisit, first_value(page_id) OVER g AS best
  FROM p WINDOW g AS (PARTITION BY payload_digest ORDER BY page_id NULLS LAST, url NULLS LAST))
SELECT page_id, payload_bytes, payload_digest, CASE WHEN revisit THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN revisit THEN best END AS refers_to FROM m
"""
