"""Web archives (WARC 1.1, one gzip member a record) as a Spark data source, written and read in parallel.

Writing: each task writes a file of its own; the names of the finished files reach the driver as commit messages and
go into a list, so files of lost or repeated tasks are never read.

Reading is splittable although gzip files are not: a task gets a range of bytes, looks for gzip's magic number, and
holds a place for a record when the bytes there decode to a record header.  It owns the records that start inside its
range and reads the last of them past the range's end.  After a record the next one starts where it ends, so what looks
like a record inside another one's bytes is passed over.  Only the first candidate of a range needs more care, as an
archive can lie inside a record: deflate stores bytes in pieces of at most 65,535, so such an inner archive can't be
followed further than that without an error.  A candidate counts once it has been followed past that distance, or to
the end of the file.

``WARC-Date`` is fixed unless given, so that reruns write the same bytes.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from ..session import reliable

SCHEMA = "record_id string, record_type string, target_uri string, payload binary, payload_bytes bigint, payload_digest string, refers_to string"
MAGIC = b"\x1f\x8b\x08"
MANIFEST = "_files.json"
#: Largest piece of bytes that deflate stores as they are.
STORED = 65_535
HEADER_LIMIT, CHUNK = 1 << 20, 1 << 18
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


# records

def _field(name: str, value: str | None) -> str:
    """A header line; line breaks and NUL in a value are percent-encoded. No line for a null."""
    if value is None:
        return ""
    for c in "\r\n\0":
        value = value.replace(c, f"%{ord(c):02X}")
    return f"{name}: {value}\r\n"


def record(kind: str, record_id: str, uri: str | None = None, payload: bytes | None = None, n_bytes: int = 0, digest: str | None = None, refers_to: str | None = None,
           date: str = "1970-01-01T00:00:00Z") -> bytes:
    """One record, not compressed. A revisit has the HTTP header of the full payload and no payload."""
    if kind == "warcinfo":
        block = b"format: WARC File Format 1.1\r\n"
    else:
        block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode() + (payload or b"")
    head = "".join([
        "WARC/1.1\r\n", _field("WARC-Type", kind), _field("WARC-Record-ID", f"<{record_id}>"), _field("WARC-Date", date), _field("WARC-Target-URI", uri),
        _field("Content-Type", "application/warc-fields" if kind == "warcinfo" else "application/http; msgtype=response"),
        _field("WARC-Block-Digest", f"sha1:{base32_sha1(block)}"), _field("WARC-Payload-Digest", digest and f"sha1:{digest}"),
        _field("WARC-Profile", REVISIT if kind == "revisit" else None), _field("WARC-Refers-To", refers_to and f"<{refers_to}>"),
        _field("Content-Length", str(len(block))), "\r\n"])
    return head.encode() + block + b"\r\n\r\n"


def member(data: bytes, level: int) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _fields(head: bytes) -> dict[str, str]:
    out = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if colon:
            out.setdefault(name.strip().lower(), value.strip())
    return out


def parsed(data: bytes) -> tuple:
    """The row of SCHEMA for a whole record; digests and lengths that don't agree raise a ValueError."""
    cut = data.index(b"\r\n\r\n")
    f = _fields(data[:cut])
    block = data[cut + 4:cut + 4 + int(f["content-length"])]
    if len(block) != int(f["content-length"]) or f.get("warc-block-digest", "sha1:" + base32_sha1(block)) != "sha1:" + base32_sha1(block):
        raise ValueError(f"record {f.get('warc-record-id')}: the block is not what its header says")
    kind, payload, n, digest = f["warc-type"], None, None, f.get("warc-payload-digest", "").removeprefix("sha1:") or None
    if "application/http" in f.get("content-type", ""):
        http = block.index(b"\r\n\r\n")
        payload = block[http + 4:]
        n = len(payload)
        if kind == "revisit":
            payload, n = None, int(_fields(block[:http]).get("content-length", 0))
        elif digest != base32_sha1(payload):
            raise ValueError(f"record {f.get('warc-record-id')}: the payload is not what its digest says")
    plain = lambda v: v and v.removeprefix("<").removesuffix(">")
    return plain(f.get("warc-record-id")), kind, f.get("warc-target-uri"), payload, n, digest, plain(f.get("warc-refers-to"))


# byte ranges

class Window:
    """Bytes of an open file by offset, in chunks; only the chunk last read is held."""

    def __init__(self, file, size: int):
        self.file, self.size, self.at, self.data = file, size, 0, b""

    def read(self, at: int) -> bytes:
        """Some bytes from ``at`` on; none at the end of the file."""
        if not self.at <= at < self.at + len(self.data):
            self.file.seek(at)
            self.at, self.data = at, self.file.read(CHUNK)
        return self.data[at - self.at:]


def find_magic(w: Window, at: int, end: int) -> int | None:
    """The first place of the magic number in [at, end)."""
    while at < end:
        piece = w.read(at)
        while len(piece) < len(MAGIC) and (more := w.read(at + len(piece))):
            piece += more
        k = piece.find(MAGIC)
        if k >= 0:
            return at + k if at + k < end else None
        if len(piece) < len(MAGIC):
            return None
        at += len(piece) - len(MAGIC) + 1
    return None


def starts_record(w: Window, at: int) -> bool:
    """Whether a gzip member at ``at`` decodes to a whole record header."""
    z, head = zlib.decompressobj(31), b""
    try:
        while len(head) < HEADER_LIMIT and not z.eof:
            if not (piece := w.read(at)):
                return False
            head += z.decompress(piece, HEADER_LIMIT)
            at += len(piece)
            if not b"WARC/1."[:len(head)] == head[:7]:
                return False
            if b"\r\n\r\n" in head:
                return True
    except zlib.error:
        return False
    return False


def inflated(w: Window, at: int, keep: bool = True) -> tuple[bytes, int]:
    """The content of the member at ``at`` (empty unless kept) and the place after it."""
    z, out = zlib.decompressobj(31), []
    while not z.eof:
        piece = w.read(at)
        if not piece:
            raise zlib.error("the file ends inside a member")
        got = z.decompress(piece)
        if keep:
            out.append(got)
        at += len(piece) - len(z.unused_data)
    return b"".join(out), at


def holds(w: Window, at: int) -> bool:
    """Whether records follow each other from ``at`` to beyond what a stored piece of another record can hold."""
    here = at
    while here < w.size and here - at <= STORED + 1:
        if not starts_record(w, here):
            return False
        try:
            here = inflated(w, here, keep=False)[1]
        except zlib.error:
            return False
    return True


def owned(w: Window, start: int, end: int) -> Iterator[bytes]:
    """The records whose members start in [start, end), in order.

    A file that starts with anything but a record, or goes on with anything but a record after one, raises an error.
    """
    at: int | None = start
    if start > 0:
        at = find_magic(w, start, end)
        while at is not None and not (starts_record(w, at) and holds(w, at)):
            at = find_magic(w, at + 1, end)
    while at is not None and at < min(end, w.size):
        if not starts_record(w, at):
            raise ValueError(f"no record at byte {at}")
        data, at = inflated(w, at)
        yield data


# the data source

@dataclass
class Split(InputPartition):
    path: str
    size: int
    start: int
    end: int


@dataclass
class Written(WriterCommitMessage):
    name: str
    size: int


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.split = options["path"], int(options.get("split_bytes", 32 << 20))
        self.payload = str(options.get("payload", "true")).lower() == "true"

    def partitions(self) -> list[Split]:
        store, root = fs.FileSystem.from_uri(self.path)
        if store.get_file_info(f"{root}/{MANIFEST}").type == fs.FileType.NotFound:
            files = [(x.path, x.size) for x in store.get_file_info(fs.FileSelector(root, recursive=True)) if x.path.endswith(".warc.gz")]
        else:
            with store.open_input_stream(f"{root}/{MANIFEST}") as f:
                files = [(f"{root}/{name}", size) for name, size in json.loads(f.read())]
        return [Split(p, n, a, min(a + self.split, n)) for p, n in sorted(files) for a in range(0, n, self.split)] or [Split("", 0, 0, 0)]

    def read(self, partition: Split) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        kinds = [pa.string(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string()]
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        store, _ = fs.FileSystem.from_uri(self.path)
        with store.open_input_file(partition.path) as file:
            rows, held = [], 0
            for data in owned(Window(file, partition.size), partition.start, partition.end):
                row = parsed(data)
                rows.append(row if self.payload else (*row[:3], None, *row[4:]))
                held += len(data) if self.payload else 0
                if held > 8 << 20 or len(rows) == 4096:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.level, self.overwrite = options["path"], int(options.get("level", 3)), overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, root = fs.FileSystem.from_uri(self.path)
        store.create_dir(root, recursive=True)
        name = f"part-{uuid.uuid4()}.warc.gz"
        with store.open_output_stream(f"{root}/{name}", compression=None) as out:
            out.write(member(record("warcinfo", f"urn:uuid:{uuid.UUID(int=0)}"), self.level))
            for b in iterator:
                for x in b.to_pylist():
                    data = record(x["record_type"], x["record_id"], x["target_uri"], x["payload"], x["payload_bytes"], x["payload_digest"], x["refers_to"])
                    out.write(member(data, self.level))
            size = out.tell()
        return Written(name, size)

    def commit(self, messages: list) -> None:
        store, root = fs.FileSystem.from_uri(self.path)
        store.create_dir(root, recursive=True)
        before = []
        if not self.overwrite and store.get_file_info(f"{root}/{MANIFEST}").type != fs.FileType.NotFound:
            with store.open_input_stream(f"{root}/{MANIFEST}") as f:
                before = json.loads(f.read())
        with store.open_output_stream(f"{root}/{MANIFEST}") as f:
            f.write(json.dumps([*before, *[[m.name, m.size] for m in messages if m]]).encode())

    def abort(self, messages: list) -> None:
        store, root = fs.FileSystem.from_uri(self.path)
        for m in messages:
            if m:
                store.delete_file(f"{root}/{m.name}")


class WarcSource(DataSource):
    """``spark.read.format("warc")`` and ``df.write.format("warc")``; rows have the columns of SCHEMA.

    The folder may be in any store that pyarrow's file systems open. Options: ``split_bytes`` (reading), ``payload``
    (false leaves payloads out, after their digests are checked), ``level`` (of gzip, writing).
    """

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(dict(self.options), overwrite)


# equal payloads

def base32_of_hex(digest: Column) -> Column:
    """A hexadecimal SHA-1 in base32: five hexadecimal digits are four letters."""
    part = [F.lpad(F.conv(F.substring(digest, 5 * k + 1, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*part), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _id(page: Column, url: Column, copy: Column | None = None) -> Column:
    """The page id, the payload's digest and the hash of the url: what tells rows apart. Rows equal in these are numbered."""
    own = F.concat(F.lit("urn:page:"), F.coalesce(page.cast("string"), F.lit("null")), F.lit(":"), F.col("payload_digest"), F.lit(":"), F.lower(F.hex(url)))
    return own if copy is None else F.concat(own, F.when(copy > 1, F.concat(F.lit(";"), copy.cast("string"))).otherwise(F.lit("")))


def page_of(record_id: Column) -> Column:
    """The page id in a record id; null where the page has none."""
    text = F.regexp_extract(record_id, "^urn:page:(-?[0-9]+):", 1)
    return F.when(text != "", text.cast("long"))


def records_of(pages: DataFrame, least: int = 0, broadcast_rows: int = 250_000, hot_share: float = 0.005) -> DataFrame:
    """A record for each row of ``pages`` (page_id, url, html; other columns are ignored).

    Of rows with equal payloads of at least ``least`` bytes the one with the largest page_id is the response and the
    others revisit it.  A null html is an empty payload and a null page_id the smallest.  Of rows that repeat a page_id
    and a payload one is the response (largest hash of the url); ids of the others end in their number.

    Payloads that occur once are not looked at again.  Facts of the others, some 100 bytes a payload, are broadcast
    while they are at most ``broadcast_rows``; beyond that payloads that fill ``hot_share`` of all rows are (at most
    1 / hot_share of them) and the rest are joined by digest, which no payload then fills.
    """
    key = ["_digest", "_size"]
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", "url", F.sha1(html).alias("_digest"), F.octet_length(html).cast("long").alias("_size"), F.xxhash64("url").alias("_url"), html.alias("_html"))
    own = reliable(rows.groupBy(*key, "page_id", "_url").agg(F.count(F.lit(1)).alias("_n"), F.min("url").alias("url")))
    groups = own.groupBy(*key).agg(F.sum("_n").alias("_copies"), F.max(F.struct("page_id", "_url", "_n")).alias("_top"))
    shared = reliable(groups.where((F.col("_copies") > 1) & (F.col("_size") >= least)))
    small = shared.count() <= broadcast_rows
    if not small:
        total = own.agg(F.sum("_n")).first()[0]
        hot, cold = (shared.where(f"{c} (_copies >= {hot_share * total})") for c in ("", "not"))
    first = F.col("page_id").eqNullSafe(F.col("_top.page_id")) & (F.col("_url") == F.col("_top._url"))

    def joined(left: DataFrame, narrow: bool) -> DataFrame:
        """``left`` with ``_top`` of its payload, null for payloads that occur once; not narrow: responses only."""
        pick = F.lit(True) if narrow else F.col("_top").isNull() | first
        if small:
            return left.join(F.broadcast(shared), key, "left").where(pick)
        out = left.join(F.broadcast(hot), key, "left").where(pick)
        if narrow:  # hot rows stay where they are
            return out.where("_top is not null").unionByName(out.where("_top is null").drop("_copies", "_top").join(cold, key, "left"))
        late = cold.select(*key, F.col("_copies").alias("_copies2"), F.col("_top").alias("_top2"))
        out = out.join(late, key, "left").withColumns({"_top": F.coalesce("_top", "_top2"), "_copies": F.coalesce("_copies", "_copies2")}).drop("_top2", "_copies2")
        return out.where(pick)

    wide = joined(rows, False).withColumn("_again", F.coalesce(F.col("_top._n") > 1, F.lit(False)))  # rows that repeat
    wide = wide.where(~F.col("_again")).unionByName(wide.where("_again").dropDuplicates(key))
    narrow = joined(own, True)
    # of rows that repeat the response all but one, of others all
    number = F.when(first, F.sequence(F.lit(2), F.greatest(F.col("_n"), F.lit(2)))).otherwise(F.sequence(F.lit(1), F.col("_n")))
    again = narrow.where("_top is not null").where(~first | (F.col("_n") > 1)).withColumn("_copy", F.explode(number))
    wide, again = (x.withColumn("payload_digest", base32_of_hex(F.col("_digest"))) for x in (wide, again))
    size = F.col("_size").alias("payload_bytes")
    responses = wide.select(_id(F.col("page_id"), F.col("_url")).alias("record_id"), F.lit("response").alias("record_type"), F.col("url").alias("target_uri"), F.col("_html").cast("binary").alias("payload"),
                            size, "payload_digest", F.lit(None).cast("string").alias("refers_to"))
    revisits = again.select(_id(F.col("page_id"), F.col("_url"), F.col("_copy")).alias("record_id"), F.lit("revisit").alias("record_type"), F.col("url").alias("target_uri"), F.lit(None).cast("binary").alias("payload"),
                            size, "payload_digest", _id(F.col("_top.page_id"), F.col("_top._url")).alias("refers_to"))
    return responses.unionByName(revisits)


def written(records: DataFrame, path: str, **options) -> str:
    records.sparkSession.dataSource.register(WarcSource)
    records.write.format("warc").options(**options).mode("append").save(path)
    return path


def read(spark: SparkSession, path: str, **options) -> DataFrame:
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").options(**options).load(path)
