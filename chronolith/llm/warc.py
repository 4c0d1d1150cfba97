"""WARC archives as a PySpark Python data source, and the round trip of web pages through them.

``pages_to_warc`` finds equal payloads by digest in Spark, marks each page's record as ``response`` or
``revisit`` and writes one gzip member per record, one archive per task, with an index of the records' places
beside it. ``WarcSource`` reads archives back, these and others: a file or a folder of ``.warc.gz`` and ``.warc``
files, with records of any type. It plans partitions over byte ranges of the files. A range starts at the first
gzip member in it that holds a record, found by an index if there is one and else by the members' first bytes; an
uncompressed file is one range, read by jumping over its blocks. Equality and IN predicates on header columns are
taken over: a record's headers are parsed first, and its payload is decoded only where it passes them and a payload
column is asked for. Blocks that aren't wanted are never held.

Columns of other archives: ``page_id`` is null, ``refers_to`` is the id as written; a payload is what follows the HTTP
headers of a response, and the whole block of a record that isn't HTTP. Transfer and content encodings stay.

Defined cases: a null html is an empty payload; a null url leaves its header out; of several rows that share
the smallest page_id of a payload each is a response; null page_ids come last, and count as the smallest only
where no other exists; an empty table gives an empty archive folder; other columns are ignored. A file that ends
inside a record, or a record without the end of its headers, fails the read.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, IsNotNull, WriterCommitMessage

from .common import new_path, small_batches, written

SCHEMA = "record_id string, page_id string, record_type string, target_uri string, payload_digest string, payload_bytes long, refers_to string, payload binary"
COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]
RANGE_BYTES = 32 << 20
_HEAD, _PIECE = 4096, 1 << 16
_MEMBER = b"\x1f\x8b\x08"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: str | None, url: str | None, payload: bytes, refers_to: str | None) -> bytes:
    """One WARC/1.1 record, uncompressed. A record with ``refers_to`` is a revisit and has no payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    fields = [
        ("WARC-Type", "revisit" if refers_to is not None else "response"),
        ("WARC-Record-ID", f"<urn:page:{page_id}>" if page_id is not None else "<urn:page>"),
        ("WARC-Date", "2020-01-01T00:00:00Z"),
        ("WARC-Payload-Digest", f"sha1:{digest(payload)}"),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    if url is not None:
        fields.append(("WARC-Target-URI", quote(url, safe="".join(map(chr, range(0x21, 0x7F))).replace("%", ""))))
    if refers_to is not None:
        fields += [("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    fields.append(("Content-Length", str(len(block))))
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def headers(raw: bytes) -> dict[str, str]:
    lines = raw.decode("utf-8", "replace").split("\r\n")
    return {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:] if x)}


def _urn(value: str | None) -> str | None:
    return value[len("<urn:page:") : -1] if value and value.startswith("<urn:page:") else None


class _Bytes:
    """Part of a file from a place on, inflated if it is gzip: one member after another, a bounded piece at a time."""

    def __init__(self, file: pa.NativeFile, at: int, packed: bool, piece: int = _PIECE):
        self._file, self._packed, self._piece = file, packed, piece
        self._next, self._raw, self._left, self._z = at, bytearray(), b"", None
        self.member = at  # where the member of the byte at hand starts

    def _more(self) -> bool:
        """One more piece in the buffer; False at the end of the file."""
        if not self._packed:
            new = self._file.read_at(self._piece, self._next)
            self._next += len(new)
            self._raw += new
            return bool(new)
        while True:
            if not self._left:
                self._left = self._file.read_at(self._piece, self._next)
                self._next += len(self._left)
                if not self._left:
                    if self._z is not None:
                        raise ValueError("an archive that ends inside a record")
                    return False
            if self._z is None:
                if self._raw:
                    return True  # the new member's bytes come once those of the last one are taken
                self._z, self.member = zlib.decompressobj(31), self._next - len(self._left)
            new = self._z.decompress(self._left, self._piece)
            self._left = self._z.unconsumed_tail or self._z.unused_data
            if self._z.eof:
                self._z = None
            if new:
                self._raw += new
                return True

    def until(self, mark: bytes, most: int = 1 << 20) -> bytes | None:
        """What comes before a mark, which is taken as well; None at the end of the file."""
        at = 0
        while (end := self._raw.find(mark, at)) < 0:
            at, held = max(0, len(self._raw) - len(mark)), len(self._raw)
            if held > most or not self._more() or len(self._raw) == held:
                if bytes(self._raw).strip():
                    raise ValueError("a record without the end of its headers")
                return None
        out = bytes(self._raw[:end])
        del self._raw[: end + len(mark)]
        return out

    def take(self, n: int, keep: bool) -> bytes:
        out = bytearray()
        while n:
            if not self._raw and not self._more():
                raise ValueError("an archive that ends inside a record")
            part = self._raw[:n]
            del self._raw[:n]
            n -= len(part)
            if keep:
                out += part
        return bytes(out)

    def skip(self, n: int) -> None:
        """Without reading what isn't compressed."""
        if self._packed or n <= len(self._raw):
            self.take(n, False)
        else:
            self._next += n - len(self._raw)
            self._raw.clear()

    def blank(self) -> bool:
        """Take line ends; False if nothing is left."""
        while True:
            while self._raw and self._raw[0] in b"\r\n":
                del self._raw[0]
            if self._raw:
                return True
            if not self._more():
                return False


def row(fields: dict[str, str], block: bytes | None) -> list:
    """The columns of a record from its headers and, if it is at hand, its block."""
    kind = fields.get("warc-type")
    http = fields.get("content-type", "").startswith("application/http")
    own = fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
    target, to = fields.get("warc-target-uri"), fields.get("warc-refers-to")
    out = [fields.get("warc-record-id"), _urn(fields.get("warc-record-id")), kind, None if target is None else unquote(target.strip("<>")), own, None, _urn(to) or to, None]
    if block is not None and http and kind in ("response", "revisit"):
        head, _, body = block.partition(b"\r\n\r\n")
        length = headers(head).get("content-length", "")
        out[5] = int(length) if length.isdigit() else None
        if kind == "response":
            out[4], out[5], out[7] = digest(body), len(body), body
    elif block is not None and kind != "revisit":
        out[5], out[7] = len(block), block
    return out


@dataclass
class Range(InputPartition):
    file: str
    places: list  # which of how many equal parts of the file


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


class WarcReader(DataSourceReader):
    def __init__(self, path: str, payload: bool, range_bytes: int):
        self.path, self.payload, self.range_bytes, self.tests = path, payload, range_bytes, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """Predicates on header columns are kept for ``read``; the others go back to Spark."""
        for f in filters:
            name = getattr(f, "attribute", ())
            if len(name) == 1 and name[0] in ("record_type", "page_id", "record_id", "target_uri", "refers_to") and isinstance(f, (EqualTo, In, IsNotNull)):
                allowed = None if isinstance(f, IsNotNull) else {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.tests.append((COLUMNS.index(name[0]), allowed))
            else:
                yield f

    def partitions(self) -> list[Range]:
        """Ranges of about ``range_bytes``; only the file list is made here, the tasks find the records."""
        files, root = _open(self.path)
        at = files.get_file_info(root)
        found = [at] if at.is_file else files.get_file_info(fs.FileSelector(root, allow_not_found=True, recursive=True))
        out = []
        for info in sorted((i for i in found if i.is_file and i.path.endswith((".warc.gz", ".warc"))), key=lambda i: i.path):
            n = max(1, -(-info.size // self.range_bytes)) if info.path.endswith(".gz") else 1
            out += [Range(info.path, [k, n]) for k in range(n)]
        return out or [Range("", [0, 1])]

    def _passes(self, fields: dict[str, str]) -> bool:
        if not self.tests:
            return True
        cells = row(fields, None)
        return all(cells[i] is not None if allowed is None else cells[i] in allowed for i, allowed in self.tests)

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(c, pa.int64() if c == "payload_bytes" else pa.binary() if c == "payload" else pa.string()) for c in COLUMNS])
        if not partition.file:
            return
        files, _ = _open(self.path)
        rows, held = [], 0
        with files.open_input_file(partition.file) as f:
            size = f.size()
            part, parts = partition.places
            lo, hi = -(-size * part // parts), -(-size * (part + 1) // parts)
            index = partition.file.removesuffix(".warc.gz") + ".idx"
            known = partition.file.endswith(".gz") and files.get_file_info(index).is_file
            for cells in self._indexed(files, index, f, lo, hi) if known else self._scanned(f, lo, hi, partition.file.endswith(".gz")):
                rows.append(cells)
                held += len(cells[7] or b"")
                if len(rows) >= 500 or held >= 4 << 20:
                    yield _batch(rows, schema)
                    rows, held = [], 0
        if rows:
            yield _batch(rows, schema)

    def _indexed(self, files: fs.FileSystem, index: str, f: pa.NativeFile, lo: int, hi: int) -> Iterator[list]:
        """By the index: each record of the range is opened at its place, so nothing but heads is read of those that don't pass."""
        kinds = next((allowed for i, allowed in self.tests if COLUMNS[i] == "record_type" and allowed is not None), None)
        with files.open_input_stream(index) as x:
            places = [json.loads(line) for line in x.read().splitlines()]
        for at, size, kind in places:
            if lo <= at < hi and (kinds is None or kind in kinds):
                yield from self._records(_Bytes(f, at, True, min(size, _HEAD)), at + 1)

    def _scanned(self, f: pa.NativeFile, lo: int, hi: int, packed: bool) -> Iterator[list]:
        """Without an index: from the range's first member that holds a record, up to the first one beyond the range."""
        at = self._first_member(f, lo, hi) if packed else 0
        if at is not None:
            yield from self._records(_Bytes(f, at, packed), hi)

    def _first_member(self, f: pa.NativeFile, lo: int, hi: int) -> int | None:
        while lo < hi:
            piece = f.read_at(min(_PIECE, hi - lo) + len(_MEMBER) - 1, lo)
            at = piece.find(_MEMBER)
            while at >= 0:
                try:
                    if zlib.decompressobj(31).decompress(f.read_at(512, lo + at), 5) == b"WARC/":
                        return lo + at
                except zlib.error:
                    pass
                at = piece.find(_MEMBER, at + 1)
            lo += _PIECE
        return None

    def _records(self, data: _Bytes, end: int) -> Iterator[list]:
        """The records that start in members before ``end`` and pass the predicates."""
        while data.blank() and (data.member < end or not data._packed):
            head = data.until(b"\r\n\r\n")
            if head is None:
                return
            fields = headers(head)
            n = int(fields["content-length"])
            if not self._passes(fields):
                if data._packed and end == data.member + 1:
                    return  # an indexed record has a member of its own
                data.skip(n)
            elif self.payload:
                yield row(fields, data.take(n, True))
            else:
                yield row(fields, None)
                if data._packed and end == data.member + 1:
                    return
                data.skip(n)


def _batch(rows: list[list], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


@dataclass
class Written(WriterCommitMessage):
    name: str


class WarcWriter(DataSourceWriter):
    """Rows (page_id, target_uri, payload, refers_to) -> an archive and its index for each task.

    Names hold the write job's id and the task attempt. At the end files of this job's attempts that weren't
    committed are removed; those of other jobs stay.
    """

    def __init__(self, path: str):
        self.path, self.job = path, uuid.uuid4().hex

    def write(self, rows: Iterator) -> Written:
        files, root = _open(self.path)
        files.create_dir(root, recursive=True)
        task = TaskContext.get()
        name = f"pages-{self.job}-{task.partitionId():06d}-{task.taskAttemptId()}"
        index, at = [], 0
        with files.open_output_stream(f"{root}/{name}.warc.gz", compression=None) as out:
            for r in rows:
                z = zlib.compressobj(4, zlib.DEFLATED, 31)
                packed = z.compress(record(r["page_id"], r["target_uri"], bytes(r["payload"]), r["refers_to"])) + z.flush()
                out.write(packed)
                index.append(json.dumps([at, len(packed), "response" if r["refers_to"] is None else "revisit"]))
                at += len(packed)
        with files.open_output_stream(f"{root}/{name}.idx", compression=None) as out:
            out.write("\n".join(index).encode())
        return Written(name)

    def commit(self, messages: list[Written | None]) -> None:
        files, root = _open(self.path)
        kept = {m.name for m in messages if m}
        for info in files.get_file_info(fs.FileSelector(root, allow_not_found=True)):
            if info.base_name.startswith(f"pages-{self.job}-") and info.base_name.split(".")[0] not in kept:
                files.delete_file(info.path)

    def abort(self, messages: list[Written | None]) -> None:
        self.commit([])


class WarcSource(DataSource):
    """``spark.read.format("chronolith_warc").option("payload", "false").load(path)``; option ``range_bytes``; writing appends archives."""

    @classmethod
    def name(cls) -> str:
        return "chronolith_warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options["path"], self.options.get("payload", "true") != "false", int(self.options.get("range_bytes", RANGE_BYTES)))

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def pages_to_warc(pages: DataFrame, path: str, min_bytes: int = 0) -> None:
    """Write a record per row.

    The smallest page_id of each digest is an aggregate of ids and digests, so a payload that a third of all
    pages share is reduced before that shuffle. It is written before pages join their digest's row: both sides are
    then plain shuffles, of which Spark can split the part of a frequent digest.
    """
    spark = pages.sparkSession
    register(spark)
    small_batches(spark, 500)
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    p = pages.select("page_id", F.col("url").alias("target_uri"), body.alias("payload"))
    key: Column = F.unhex(F.sha1("payload"))
    first = p.filter(F.length("payload") >= min_bytes).select("page_id", key.alias("k")).groupBy("k").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    copies = written(first.filter("n > 1").select("k", "first"), "warc-copies")
    rows = p.withColumn("k", F.when(F.length("payload") >= min_bytes, key)).join(copies, "k", "left")
    refers = F.when(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first").cast("string"))
    out = rows.select(F.col("page_id").cast("string").alias("page_id"), "target_uri", "payload", refers.alias("refers_to"))
    out.write.format("chronolith_warc").mode("append").save(path)


def read_warc(spark: SparkSession, path: str, payload: bool = True, range_bytes: int = RANGE_BYTES) -> DataFrame:
    register(spark)
    return spark.read.format("chronolith_warc").option("payload", str(payload).lower()).option("range_bytes", range_bytes).load(path)


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write the pages to new archives in the shared folder and describe each record read back from there."""
    spark = pages.sparkSession
    kind = pages.schema["page_id"].dataType
    path = new_path(spark, "warc")
    pages_to_warc(pages, path, min_bytes)
    back = read_warc(spark, path)
    return back.select(F.col("page_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))
