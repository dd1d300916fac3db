"""WARC archives with a two-level capture index.

Archives are gzip files with one member per record, written by Spark's text writer (so
any Hadoop file system works): a record's bytes go out as the "line" and the last
byte of a gzip member of less than 16 MiB, always zero, is the line separator; a
larger record is followed by an empty member that ends in zero.

Index: captures are sorted by reversed-host URL key, packed into compressed blocks of
BLOCK_LINES lines, and a sparse directory keeps the first key, file, offset and length
of each block.  A lookup binary-searches the directory, range-reads one block (or the
few that share the key), binary-searches its lines and range-reads the record.

Defined results: null html is an empty payload; a null url has the key "-"; repeated
rows are records of their own; payloads under `least` bytes are never revisits; an
empty table writes an index without entries.  Other columns are ignored.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinreel.llm.common import bounded_batches, new_path, parts_for, settle

BLOCK_LINES = 3000
#: Index blocks whose directory is broadcast at most (100 bytes or so each).
BROADCAST_BLOCKS = 500_000
#: Ranges this near to each other are read at once, up to so many bytes; records of one such stretch of an archive go to one task.
GAP, READ, STRETCH = 1 << 16, 8 << 20, 1 << 20
#: Copies of one payload are dealt over this many keys where they meet their response.
SALTS = 32
#: Payloads with copies that are broadcast at most (a digest and an id each), and captures whose places are (16 bytes each).
BROADCAST_PAYLOADS, BROADCAST_CAPTURES = 500_000, 4_000_000
EMPTY = zlib.compressobj(9, zlib.DEFLATED, 31).flush()
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CAPTURE = "key string, page_id long, record_type string, payload_digest string, payload_bytes long, refers_to long, file string, offset long, length long"
RECORD = "page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, payload binary"


def url_key(url: str | None) -> str:
    """Reversed-host key: http://www.example.org/a?b -> org,example,www)/a?b ; spaces and controls are escaped."""
    if url is None:
        return "-"
    rest = url.split("://", 1)[-1]
    m = re.match(r"[^/?#]*", rest)
    host, path = m[0].lower(), rest[m.end() :]
    return re.sub(r"[\x00-\x20\x7f]", lambda c: f"%{ord(c[0]):02X}", f"{','.join(reversed(host.split('.')))}){path or '/'}")


def member(data: bytes) -> bytes:
    """A gzip member without its last byte, which is zero."""
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    out = z.compress(data) + z.flush()
    return (out if out[-1] == 0 else out + EMPTY)[:-1]


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, response: int | None) -> bytes:
    """The bytes of a WARC record; a revisit (response given) has the HTTP header but no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if response is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if response is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\r\n]", lambda c: f"%{ord(c[0]):02X}", url))
    head.append("WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(digest)).decode())
    if response is not None:
        head += [f"WARC-Refers-To: <urn:page:{response}>", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """Fields of one WARC record; the digest and size of a response are taken from its payload itself."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    page = fields["WARC-Record-ID"][10:-1]
    out = {"page_id": int(page) if page else None, "url": fields.get("WARC-Target-URI"), "record_type": fields["WARC-Type"], "refers_to": None, "payload": payload}
    if out["record_type"] == "revisit":
        size = int(re.search(rb"Content-Length: (\d+)", http)[1])
        return out | {"refers_to": int(fields["WARC-Refers-To"][10:-1]), "payload_digest": base64.b32decode(fields["WARC-Payload-Digest"][5:]).hex(), "payload_bytes": size, "payload": None}
    return out | {"payload_digest": hashlib.sha1(payload).hexdigest(), "payload_bytes": len(payload)}


def members(content: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, data) of each gzip member that holds data."""
    view, pos, step = memoryview(content), 0, 1 << 16
    while pos < len(view):
        z, at, out = zlib.decompressobj(31), pos, []
        while not z.eof and at < len(view):
            out.append(z.decompress(view[at : at + step]))
            at += step
        end = min(at, len(view)) - len(z.unused_data)
        if data := b"".join(out):
            yield pos, end - pos, data
        pos = end


def _write(rows: DataFrame, path: str) -> None:
    """rows(value binary): one gzip member each, less its last byte."""
    rows.select(F.col("value").cast("string").alias("value")).write.option("lineSep", "\0").text(path)


def write_archives(pages: DataFrame, path: str, least: int = 1000) -> None:
    """A WARC record for each page: of equal payloads of at least `least` bytes, the one with the largest page_id is stored."""
    spark = pages.sparkSession
    bounded_batches(spark)
    html = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    digest = F.sha1(html)
    long_ = F.length(html) >= least
    copies = pages.where(long_).groupBy(digest.alias("_digest2")).agg(F.max("page_id").alias("_response"), F.count("*").alias("_n")).where(F.col("_n") > 1)
    copies = settle(copies.select("_digest2", "_response"), "copies")
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("payload"), digest.alias("digest"), F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int").alias("_salt"))
    same = F.col("digest") == F.col("_digest2")
    if copies.count() <= BROADCAST_PAYLOADS:  # pages stay where they are read
        copies = F.broadcast(copies)
    else:
        copies = copies.withColumn("_salt2", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        same &= F.col("_salt") == F.col("_salt2")
    typed = base.join(copies, same, "left").select(
        "page_id", "url", "payload", "digest", F.when(F.col("_response") != F.coalesce("page_id", F.lit(-1)), F.col("_response")).alias("response")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "response")))
            yield pa.RecordBatch.from_arrays([pa.array([member(record(*r)) for r in rows], pa.binary())], ["value"])

    _write(typed.mapInArrow(run, "value binary"), path)


def _files(spark: SparkSession, path: str) -> DataFrame:
    """path, content of the files Spark wrote there."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")


def captures(spark: SparkSession, path: str) -> DataFrame:
    """A row for each record of the archives, from reading them."""
    names = [x.split(" ")[0] for x in CAPTURE.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, content in zip(b.column("path").to_pylist(), b.column("content")):
                rows = [parse_record(data) | {"file": file, "offset": at, "length": n} for at, n, data in members(content.as_buffer())]
                for r in rows:
                    r["key"] = url_key(r["url"])
                yield pa.RecordBatch.from_pydict({n: pa.array([r[n] for r in rows], pa.string() if n in ("key", "record_type", "payload_digest", "file") else pa.int64()) for n in names})

    bounded_batches(spark, 1)
    return _files(spark, path).mapInArrow(run, CAPTURE)


def write_index(spark: SparkSession, archives: str, path: str) -> None:
    """The two-level index of the archives: `path`/blocks and `path`/directory."""
    found = settle(captures(spark, archives), "captures")
    line = F.concat_ws("\t", "key", F.coalesce(F.col("page_id").cast("string"), F.lit("-")), "file", "offset", "length")
    ordered = found.select("key", "page_id", line.alias("line")).repartitionByRange("key", "page_id").sortWithinPartitions("key", "page_id").select("line")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines: list[str] = []
        for b in batches:
            lines += b.column("line").to_pylist()
            while len(lines) >= BLOCK_LINES:
                yield pa.RecordBatch.from_arrays([pa.array([member("\n".join(lines[:BLOCK_LINES]).encode())], pa.binary())], ["value"])
                lines = lines[BLOCK_LINES:]
        if lines:
            yield pa.RecordBatch.from_arrays([pa.array([member("\n".join(lines).encode())], pa.binary())], ["value"])

    _write(ordered.mapInArrow(pack, "value binary"), f"{path}/blocks")

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, content in zip(b.column("path").to_pylist(), b.column("content")):
                rows = [(data.split(b"\t", 1)[0].decode(), file, at, n) for at, n, data in members(content.as_buffer())]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows) if rows else [()] * 4, (pa.string(), pa.string(), pa.int64(), pa.int64()))], ["first_key", "file", "offset", "length"])

    bounded_batches(spark, 1)
    _files(spark, f"{path}/blocks").mapInArrow(first, "first_key string, file string, offset long, length long").write.parquet(f"{path}/directory")


def _range(spark: SparkSession, file: str, offset: int, length: int) -> bytes:
    """A range read through the Hadoop file system."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(file)
    stream = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(path)
    try:
        stream.seek(offset)
        return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream, length))
    finally:
        stream.close()


class CaptureIndex:
    """Lookups by URL.  The directory has one entry for each BLOCK_LINES captures."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.directory = sorted(tuple(r) for r in spark.read.parquet(f"{path}/directory").collect())
        self.firsts = [r[0] for r in self.directory]

    def lookup(self, url: str | None) -> list[dict]:
        """The records of a url, in order of page_id."""
        key, out = url_key(url), []
        at = max(0, bisect.bisect_left(self.firsts, key) - 1)
        while at < len(self.firsts) and self.firsts[at] <= key:
            _, file, offset, length = self.directory[at]
            lines = zlib.decompress(_range(self.spark, file, offset, length), 31).decode().split("\n")
            keys = [x.split("\t", 1)[0] for x in lines]
            for x in lines[bisect.bisect_left(keys, key) : bisect.bisect_right(keys, key)]:
                _, _, warc, start, size = x.split("\t")
                out.append(parse_record(zlib.decompress(_range(self.spark, warc, int(start), int(size)), 31)))
            at += 1
        return out


def read_records(spark: SparkSession, index: str, archives: str) -> DataFrame:
    """Every indexed record, read from its archive at the offset the index has for it."""
    names = [x.split(" ")[0] for x in RECORD.split(", ")]

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column("content"):
                for _, _, data in members(content.as_buffer()):
                    rows = [x.split("\t") for x in data.decode().split("\n")]
                    yield pa.RecordBatch.from_arrays([pa.array([r[2] for r in rows]), pa.array([int(r[3]) for r in rows], pa.int64()), pa.array([int(r[4]) for r in rows], pa.int64())], ["file", "offset", "length"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content, at in zip(b.column("content"), b.column("at").to_pylist()):
                view = memoryview(content.as_buffer())
                for i in range(0, len(at), 500):
                    rows = [parse_record(zlib.decompress(view[x["offset"] : x["offset"] + x["length"]], 31)) for x in at[i : i + 500]]
                    yield pa.RecordBatch.from_pydict({n: pa.array([r[n] for r in rows], {"payload": pa.binary(), "page_id": pa.int64(), "payload_bytes": pa.int64(), "refers_to": pa.int64()}.get(n, pa.string())) for n in names})

    bounded_batches(spark, 1)
    at = _files(spark, f"{index}/blocks").mapInArrow(lines, "file string, offset long, length long").groupBy("file").agg(F.array_sort(F.collect_list(F.struct("offset", "length"))).alias("at"))
    at = settle(at, "places")
    few = at.agg(F.coalesce(F.sum(F.size("at")), F.lit(0))).first()[0] <= BROADCAST_CAPTURES
    return _files(spark, archives).join(F.broadcast(at) if few else at, F.col("path") == F.col("file")).select("content", "at").mapInArrow(read, RECORD)


def _open(file: str):
    """A file for range reads on executors."""
    if file.startswith("file:"):
        return pafs.LocalFileSystem().open_input_file(re.sub("^file:/+", "/", file))
    fs, path = pafs.FileSystem.from_uri(file)
    return fs.open_input_file(path)


def range_readable(spark: SparkSession, path: str) -> bool:
    """Whether executors can read ranges of files there: local (shared) folders, and stores that pyarrow knows."""
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    uri = jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(jpath).toString()
    if uri.startswith("file:"):
        return True
    try:
        pafs.FileSystem.from_uri(uri)
    except Exception:  # an unknown scheme, or a store whose library is absent
        return False
    return True


def ranges(places: list[tuple[str, int, int]]) -> Iterator[tuple[str, int, int, list[tuple[int, int]]]]:
    """(file, start, end, records) for records in order: near ones are one range."""
    now = None
    for file, at, n in places:
        if now and now[0] == file and 0 <= at - now[2] <= GAP and at + n - now[1] <= READ:
            now[2] = at + n
            now[3].append((at, n))
            continue
        if now:
            yield tuple(now)
        now = [file, at, at + n, [(at, n)]]
    if now:
        yield tuple(now)


def lookup(spark: SparkSession, index: str, urls: DataFrame) -> DataFrame | None:
    """The records of all the urls(url), each capture once; None if the directory is over BROADCAST_BLOCKS entries.

    The directory is binary-searched for each distinct key, the keys of one block meet in one task, which reads the
    block's range and binary-searches its lines; then the records' ranges are read, in order, by stretch of archive.
    """
    directory = spark.read.parquet(f"{index}/directory")
    if directory.count() > BROADCAST_BLOCKS:
        return None
    entries = sorted(tuple(r) for r in directory.collect())
    shared = spark.sparkContext.broadcast((entries, [r[0] for r in entries]))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, firsts = shared.value
        for b in batches:
            keys, blocks = [], []
            for key in {url_key(u) for u in b.column("url").to_pylist()}:
                at = max(0, bisect.bisect_left(firsts, key) - 1)
                while at < len(firsts) and firsts[at] <= key:
                    keys.append(key)
                    blocks.append(at)
                    at += 1
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(blocks, pa.int64())], ["key", "block"])

    def in_block(table: pa.Table) -> pa.Table:
        _, file, offset, length = shared.value[0][table.column("block")[0].as_py()]
        with _open(file) as f:
            lines = zlib.decompress(f.read_at(length, offset), 31).decode().split("\n")
        keys, rows = [x.split("\t", 1)[0] for x in lines], []
        for key in table.column("key").to_pylist():
            rows += [x.split("\t")[2:5] for x in lines[bisect.bisect_left(keys, key) : bisect.bisect_right(keys, key)]]
        return pa.table({"file": pa.array([r[0] for r in rows], pa.string()), "offset": pa.array([int(r[1]) for r in rows], pa.int64()), "length": pa.array([int(r[2]) for r in rows], pa.int64())})

    types = {"payload": pa.binary(), "page_id": pa.int64(), "payload_bytes": pa.int64(), "refers_to": pa.int64()}
    names = [x.split(" ")[0] for x in RECORD.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, start, end, at in ranges(list(zip(*(b.column(c).to_pylist() for c in ("file", "offset", "length"))))):
                with _open(file) as f:
                    view = memoryview(f.read_at(end - start, start))
                rows = [parse_record(zlib.decompress(view[o - start : o - start + n], 31)) for o, n in at]
                yield pa.RecordBatch.from_pydict({c: pa.array([r[c] for r in rows], types.get(c, pa.string())) for c in names})

    bounded_batches(spark)
    asked = urls.select("url").distinct().mapInArrow(find, "key string, block long").distinct()
    places = settle(asked.groupBy("block").applyInArrow(in_block, "file string, offset long, length long"), "places")
    # a place is a few bytes, the record behind it thousands: tasks by what they will read
    size = places.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    dealt = places.repartition(parts_for(size, READ), "file", F.floor(F.col("offset") / STRETCH)).sortWithinPartitions("file", "offset")
    return dealt.mapInArrow(read, RECORD)


def archive(pages: DataFrame, least: int = 1000) -> DataFrame:
    """Write the pages to archives in shared storage, index them, and look every url up in the index.

    Where executors cannot read ranges of the shared store, or the directory is too large to broadcast, the archives
    are scanned whole and cut at the places the index has.
    """
    spark = pages.sparkSession
    archives, index = new_path(spark, "warc"), new_path(spark, "cdx")
    write_archives(pages, archives, least)
    write_index(spark, archives, index)
    found = lookup(spark, index, pages) if range_readable(spark, index) else None
    return read_records(spark, index, archives) if found is None else found
