"""Operator 2: WARC archives of pages, read back through a two-level capture index.

Writing: every page becomes one gzip member of an archive file in the shared
folder.  Of pages with equal payloads of at least LEAST_REVISIT bytes the one
with the smallest id is a response and the others are revisits of it, without a
payload of their own.  Archive names are unique per attempt, and the table of
record places is committed by Spark, so files of failed attempts are never read.

Index: record places, sorted by reversed-host URL key and page id, are cut into
compressed blocks of BLOCK_LINES lines; each index shard has a sparse directory
(first key, offset and length of every block); a list of the shards (at most
one per shuffle partition) is the upper level.

Reading: a key is binary-searched in the list of shards, in the shard's
directory and in the block, then the record's byte range is read and parsed.

Defined cases: null html is an empty payload; a null or odd url is kept as it
is under an empty host; rows that repeat an id each have their record, and all
rows of the smallest id are responses; a null page_id is the largest; an empty
table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import bisect
import hashlib
import uuid
import zlib
from collections import OrderedDict

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from covercost.llm.base import shared_dir, stage, table

LEAST_REVISIT = 100
#: Bytes after which a new archive file is begun, and lines of an index block.
ARCHIVE_BYTES, BLOCK_LINES = 256 << 20, 1000
PLACE = "key string, file string, offset long, length long"
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def store(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder (a path or any URI that Arrow knows) and the path in it."""
    if uri.startswith("file:") or "://" not in uri:
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri)


def url_key(url: str) -> F.Column:
    """Host labels reversed and joined by commas, ")", then path and query; white space is escaped."""
    u = F.coalesce(F.col(url).cast("string"), F.lit(""))
    authority = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*"
    host = F.lower(F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)", 1))
    rest = F.regexp_replace(F.regexp_replace(u, authority, ""), "#.*$", "")
    return F.regexp_replace(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), rest), r"[\x00-\x20]", "%20")


def captures(pages: DataFrame) -> DataFrame:
    """page_id, url, key, payload, digest, and the page that each revisit refers to."""
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                     F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8").alias("payload"))
    p = p.withColumn("digest", F.sha2("payload", 256))
    p = p.withColumn("key", F.concat_ws(" ", url_key("url"), F.coalesce(F.col("page_id").cast("string"), F.lit("-"))))
    large = p.where(F.octet_length("payload") >= LEAST_REVISIT)
    copies = large.groupBy("digest").agg(F.min("page_id").alias("_first"), F.count("*").alias("_n")).where("_n > 1 and _first is not null")
    p = p.join(copies.select(F.col("digest").alias("_digest"), "_first"), F.col("digest") == F.col("_digest"), "left")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("_first")), F.col("_first"))
    return p.select("page_id", "url", "key", "payload", "digest", refers.alias("refers_to"))


def record(page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record as a gzip member."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    uri = url.replace("\r", "%0D").replace("\n", "%0A")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
            f"WARC-Target-URI: {uri}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha256:{digest}",
            *([] if refers_to is None else [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]),
            "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n") + pack.flush()


def parse(raw: bytes) -> tuple[int | None, int, str, str, int | None]:
    """(page_id, payload bytes, payload digest, type, refers_to) of a record; a response's figures are taken from its payload."""
    data = zlib.decompress(raw, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    page = lambda name: int(x) if (x := fields[name][len("<urn:page:"):-1]) else None
    http, _, payload = rest[:int(fields["Content-Length"])].partition(b"\r\n\r\n")
    if fields["WARC-Type"] == "response":
        return page("WARC-Record-ID"), len(payload), hashlib.sha256(payload).hexdigest(), "response", None
    size = next(int(line[16:]) for line in http.split(b"\r\n") if line.startswith(b"Content-Length: "))
    return page("WARC-Record-ID"), size, fields["WARC-Payload-Digest"].removeprefix("sha256:"), "revisit", page("WARC-Refers-To")


def write(spark: SparkSession, pages: DataFrame, folder: str) -> DataFrame:
    """Write the archives under ``folder``; the committed places of their records."""

    def archive(batches):
        system, top = store(folder)
        system.create_dir(top, recursive=True)
        out, name, at = None, "", 0
        for batch in batches:
            rows = []
            for page_id, url, key, payload, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None or at >= ARCHIVE_BYTES:
                    if out is not None:
                        out.close()
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = system.open_output_stream(f"{top}/{name}", compression=None)
                raw = record(page_id, url or "", payload, digest, refers_to)
                out.write(raw)
                rows.append((key, name, at, len(raw)))
                at += len(raw)
            if rows:
                yield pa.record_batch([pa.array(c) for c in zip(*rows, strict=True)], names=["key", "file", "offset", "length"])
        if out is not None:
            out.close()

    return stage(spark, captures(pages).mapInArrow(archive, PLACE), "warc-places")


def build_index(places: DataFrame, folder: str, block_lines: int = BLOCK_LINES) -> list[tuple[str, str]]:
    """Write the index shards; (first key, shard name) of each, sorted."""

    def shard(batches):
        system, top = store(folder)
        system.create_dir(top, recursive=True)
        name, out, at, first, directory, lines = uuid.uuid4().hex, None, 0, None, [], []

        def flush():
            nonlocal at, lines
            if lines:
                packed = zlib.compress("\n".join("\t".join(map(str, x)) for x in lines).encode())
                out.write(packed)
                directory.append(f"{lines[0][0]}\t{at}\t{len(packed)}")
                at, lines = at + len(packed), []

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    first, out = row[0], system.open_output_stream(f"{top}/{name}.blocks")
                lines.append(row)
                if len(lines) == block_lines:
                    flush()
        if out is not None:
            flush()
            out.close()
            with system.open_output_stream(f"{top}/{name}.directory") as d:
                d.write("\n".join(directory).encode())
            yield pa.record_batch([[first], [name]], names=["first", "name"])

    parts = int(places.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = places.repartitionByRange(parts, "key").sortWithinPartitions("key", "file", "offset")
    found = stage(places.sparkSession, spread.mapInArrow(shard, "first string, name string"), "warc-shards")
    # at most one row per shuffle partition; in the byte order that Spark sorts by
    return sorted(((r.first, r.name) for r in found.select("first", "name").toLocalIterator()), key=lambda x: x[0].encode())


class Reader:
    """Looks keys up in the index under ``folder``; keeps the last directories, blocks and open archives."""

    def __init__(self, folder: str, shards: list[tuple[str, str]]):
        self.system, self.top = store(folder)
        self.firsts, self.names = [k.encode() for k, _ in shards], [n for _, n in shards]
        self.kept: OrderedDict = OrderedDict()

    def keep(self, name, make, most: int = 16):
        if name not in self.kept:
            self.kept[name] = make()
            if len(self.kept) > most:
                self.kept.popitem(last=False)
        self.kept.move_to_end(name)
        return self.kept[name]

    def file(self, name: str):
        return self.keep(name, lambda: self.system.open_input_file(f"{self.top}/{name}"))

    def directory(self, shard: str):
        def load():
            with self.system.open_input_file(f"{self.top}/{shard}.directory") as f:
                rows = [x.rsplit(b"\t", 2) for x in f.read().split(b"\n")]
            return [k for k, _, _ in rows], [(int(a), int(n)) for _, a, n in rows]
        return self.keep(f"{shard} directory", load)

    def block(self, shard: str, at: int, length: int):
        def load():
            lines = [x.split(b"\t") for x in zlib.decompress(self.range(f"{shard}.blocks", at, length)).split(b"\n")]
            return [x[0] for x in lines], lines
        return self.keep((shard, at), load)

    def range(self, name: str, at: int, length: int) -> bytes:
        return self.file(name).read_at(length, at)

    def records(self, key: str):
        """The raw records of a key."""
        want = key.encode()
        s = bisect.bisect_right(self.firsts, want) - 1
        if s < 0:
            return
        firsts, places = self.directory(self.names[s])
        b = max(0, bisect.bisect_left(firsts, want) - 1)
        while b < len(firsts) and firsts[b] <= want:
            keys, lines = self.block(self.names[s], *places[b])
            for line in lines[bisect.bisect_left(keys, want):bisect.bisect_right(keys, want)]:
                yield self.range(line[1].decode(), int(line[2]), int(line[3]))
            b += 1


def look_up(keys: DataFrame, folder: str, shards: list[tuple[str, str]]) -> DataFrame:
    """The records of every distinct key in ``keys`` (key)."""

    def read(batches):
        reader = Reader(folder, shards)
        for batch in batches:
            rows = [parse(raw) for key in batch.column(0).to_pylist() for raw in reader.records(key)]
            if rows:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True)],
                                      names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    parts = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return keys.distinct().repartitionByRange(parts, "key").sortWithinPartitions("key").mapInArrow(read, RECORD)


def round_trip(spark: SparkSession, pages: DataFrame, folder: str | None = None, block_lines: int = BLOCK_LINES) -> DataFrame:
    """Archive ``pages`` (page_id, url, html) under ``folder`` and look every page up again."""
    folder = folder or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    shards = build_index(write(spark, pages, folder), folder, block_lines)
    keys = pages.select(F.concat_ws(" ", url_key("url"), F.coalesce(F.col("page_id").cast("long").cast("string"), F.lit("-"))).alias("key"))
    return look_up(keys, folder, shards)


def op2_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(spark, table(spark, sf_dir, "pages"))


def oracle() -> str:
    return f"""
    with p as (select page_id, coalesce(html, '') h from pages),
    d as (select page_id, strlen(h) payload_bytes, sha256(h) payload_digest,
                 case when strlen(h) >= {LEAST_REVISIT} then min(page_id) over (partition by sha256(h)) end first from p)
    select page_id, payload_bytes, payload_digest,
           case when first is null or page_id is not distinct from first then 'response' else 'revisit' end record_type,
           case when page_id is distinct from first then first end refers_to
    from d"""
