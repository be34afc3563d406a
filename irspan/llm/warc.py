"""WARC archives: a PySpark data source that reads and writes them, and the plan of revisits.

Writing (``df.write.format("warc").save(folder)``) takes rows with the columns of :data:`WRITTEN` and
gives each task's records in files of their own, one gzip member a record.  A member says in its
extra field how long it is (the ``sl`` subfield of the format's recommendations), so a reader can pass
over it.  Only files in a committed manifest count: a lost task's files are never read.

Reading plans partitions of whole files; ``.schema(...)`` names the columns wanted.  Filters on the
record type and other header columns are pushed down (:func:`read` turns that on): headers are parsed
first, and the payload of a record that is filtered out, or whose payload column isn't asked for, is
neither decompressed nor decoded.  Folders without a manifest are read whole, ``.warc`` files too.

:func:`plan_records` decides what is stored: of rows with equal payloads of at least
:data:`LEAST_REVISIT` bytes, that with the largest id is a response and the others revisit it.

Defined cases: a null payload counts as empty; rows that repeat the largest id are all responses; a
null id stays null and neither is nor makes a revisit; a null URL writes no target header.  An empty
table writes no record; a very long payload is one record, held whole by one task.  Extra columns,
whatever their names, are not looked at.
"""

from __future__ import annotations

import base64
import gzip
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, StringContains, StringEndsWith, StringStartsWith, WriterCommitMessage
from pyspark.sql.types import StructType

from irspan.llm import common

#: Payloads from so many bytes on may be revisited.
LEAST_REVISIT = 1000
#: Bytes of a file after which a task begins another, and of files that one task reads.
FILE_BYTES, PARTITION_BYTES = 128 << 20, 64 << 20
BATCH_BYTES = 4 << 20
#: Repeated digests that are broadcast to the pages (some 60 bytes each); beyond, Spark joins by a shuffle.
BROADCAST_ROWS = 200_000

WRITTEN = "record_id string, warc_type string, target_uri string, warc_date string, payload_digest string, refers_to string, payload_length long, payload binary"
READ = "record_id string, warc_type string, target_uri string, warc_date string, payload_digest string, refers_to string, content_type string, content_length long, payload_length long, headers map<string,string>, payload binary"
_NAMES = {"record_id": "WARC-Record-ID", "warc_type": "WARC-Type", "target_uri": "WARC-Target-URI", "warc_date": "WARC-Date", "payload_digest": "WARC-Payload-Digest", "refers_to": "WARC-Refers-To", "content_type": "Content-Type"}
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _line(name: str, value: str | None) -> str:
    return "" if value is None else f"{name}: {value.replace(chr(13), '%0D').replace(chr(10), '%0A')}\r\n"


def record(row: dict) -> bytes:
    """One WARC record; a revisit keeps the HTTP header and leaves the payload out."""
    payload = row["payload"] or b""
    revisit = row["warc_type"] == "revisit"
    length = row["payload_length"] if row["payload_length"] is not None else len(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = "WARC/1.1\r\n" + "".join(_line(header, row[column]) for column, header in _NAMES.items() if column in row and column != "content_type")
    head += _line("WARC-Profile", _PROFILE if revisit else None) + _line("Content-Type", "application/http; msgtype=response") + _line("Content-Length", str(len(block)))
    return head.encode() + b"\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """A gzip member whose extra field holds its own length and that of the data."""
    z = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = z.compress(data) + z.flush()
    total = 12 + 12 + len(body) + 8
    extra = b"sl" + struct.pack("<HII", 8, total & 0xFFFFFFFF, len(data) & 0xFFFFFFFF)
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", len(extra)) + extra + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def _system(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


@dataclass
class _Files(WriterCommitMessage):
    names: list[str]


class WarcWriter(DataSourceArrowWriter):
    """Writes each task's records to its own files; a manifest names those of the tasks that count."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        system, folder = _system(self.path)
        system.create_dir(folder, recursive=True)
        names: list[str] = []
        out = None
        for batch in iterator:
            for row in batch.to_pylist():
                if out is None:
                    names.append(f"part-{uuid.uuid4().hex}.warc.gz")
                    out, size = system.open_output_stream(f"{folder}/{names[-1]}", compression=None), 0
                data = member(record(row))
                out.write(data)
                size += len(data)
                if size >= FILE_BYTES:
                    out.close()
                    out = None
        if out is not None:
            out.close()
        return _Files(names)

    def commit(self, messages: list) -> None:
        system, folder = _system(self.path)
        system.create_dir(folder, recursive=True)
        old = [f.path for f in system.get_file_info(fs.FileSelector(folder)) if f.base_name.startswith("_manifest-")] if self.overwrite else []
        names = [n for m in messages if m is not None for n in m.names]
        with system.open_output_stream(f"{folder}/_manifest-{uuid.uuid4().hex}.json", compression=None) as out:
            out.write(json.dumps(names).encode())
        for path in old:
            system.delete_file(path)

    def abort(self, messages: list) -> None:
        system, folder = _system(self.path)
        for name in (n for m in messages if m is not None for n in m.names):
            system.delete_file(f"{folder}/{name}")


@dataclass
class _Part(InputPartition):
    paths: list[str]

    def __post_init__(self) -> None:
        super().__init__(self.paths)


class _Bytes:
    """A file's records: what is asked for is decompressed, the rest is passed over.

    Members without a length in their extra field are read through one decompressed stream.
    """

    def __init__(self, stream, gz: bool):
        self.stream, self.held = stream, b""
        self.sized = False
        if gz:
            head = stream.read(16)
            stream.seek(0)
            self.sized = len(head) == 16 and head[3] == 4 and head[12:14] == b"sl"
            if not self.sized:
                self.stream = gzip.GzipFile(fileobj=stream)

    def start(self) -> bool:
        """Go to the next record; false at the end."""
        if not self.sized:
            while True:
                self.held = self.held.lstrip(b"\r\n")
                if self.held:
                    return True
                self.held = self.stream.read(4096)
                if not self.held:
                    return False
        head = self.stream.read(24)
        if len(head) < 24:
            return False
        if head[:4] != b"\x1f\x8b\x08\x04" or head[12:14] != b"sl":
            raise ValueError("a gzip member without its length among others that have one")
        self.left = struct.unpack("<I", head[16:20])[0] - 24
        self.z, self.held = zlib.decompressobj(-15), b""
        return True

    def _more(self, n: int) -> bytes:
        raw = self.stream.read(min(n, self.left) if self.sized else n)
        if not self.sized:
            return raw
        self.left -= len(raw)
        return self.z.decompress(raw) if raw else b""

    def until(self, mark: bytes) -> bytes:
        while mark not in self.held and (b := self._more(4096)):
            self.held += b
        head, _, self.held = self.held.partition(mark)
        return head

    def take(self, n: int) -> bytes:
        parts, size = [self.held], len(self.held)
        while size < n and (b := self._more(self.left if self.sized else n - size)):
            parts.append(b)
            size += len(b)
        data = b"".join(parts)
        self.held = data[n:]
        return data[:n]

    def end(self, rest: int) -> None:
        """Pass over what wasn't taken; rest: bytes of the block that weren't."""
        if self.sized:
            self.stream.seek(self.left, 1)
        elif rest > len(self.held):
            self.stream.seek(rest - len(self.held), 1)
            self.held = b""
        else:
            self.held = self.held[rest:]


def _headers(text: bytes) -> dict[str, str]:
    pairs = (line.partition(":") for line in text.decode("utf-8", "replace").split("\r\n")[1:])
    return {k.strip(): v.strip() for k, colon, v in pairs if colon}


_TESTS = {
    EqualTo: lambda x, v: x is not None and x == v,
    In: lambda x, v: x is not None and x in v,
    GreaterThan: lambda x, v: x is not None and x > v,
    GreaterThanOrEqual: lambda x, v: x is not None and x >= v,
    LessThan: lambda x, v: x is not None and x < v,
    LessThanOrEqual: lambda x, v: x is not None and x <= v,
    StringStartsWith: lambda x, v: x is not None and x.startswith(v),
    StringEndsWith: lambda x, v: x is not None and x.endswith(v),
    StringContains: lambda x, v: x is not None and v in x,
    IsNotNull: lambda x, v: x is not None,
    IsNull: lambda x, v: x is None,
}


class WarcReader(DataSourceReader):
    """Reads whole files, headers first."""

    def __init__(self, path: str, schema: StructType):
        self.path, self.asked, self.columns = path, schema, schema.names
        self.tests: list[tuple[str, type, object]] = []

    def pushFilters(self, filters: list) -> Iterator:  # noqa: N802
        for f in filters:
            if type(f) in _TESTS and len(f.attribute) == 1 and (f.attribute[0] in _NAMES or f.attribute[0] == "content_length"):
                self.tests.append((f.attribute[0], type(f), getattr(f, "value", None)))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        system, folder = _system(self.path)
        found = {f.base_name: f for f in system.get_file_info(fs.FileSelector(folder)) if f.type == fs.FileType.File}
        manifests = [n for n in found if n.startswith("_manifest-")]
        if manifests:
            names = []
            for n in manifests:
                with system.open_input_stream(found[n].path, compression=None) as s:
                    names += json.loads(s.read())
        else:
            names = [n for n in found if n.endswith((".warc", ".warc.gz"))]
        parts, size = [[]], 0
        for n in sorted(names):
            if parts[-1] and size + found[n].size > PARTITION_BYTES:
                parts.append([])
                size = 0
            parts[-1].append(found[n].path)
            size += found[n].size
        return [_Part(p) for p in parts]

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(self.asked)
        system, _ = _system(self.path)
        rows, size = [], 0
        for path in partition.paths:
            with system.open_input_file(path) as stream:
                for row in self._records(stream, path.endswith(".gz")):
                    rows.append(row)
                    size += len(row.get("payload") or b"") + 500
                    if size >= BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    def _records(self, stream, gz: bool) -> Iterator[dict]:
        data = _Bytes(stream, gz)
        wanted = set(self.columns)
        while data.start():
            headers = _headers(data.until(b"\r\n\r\n"))
            row: dict = {column: headers.get(name) for column, name in _NAMES.items()}
            rest = row["content_length"] = int(headers.get("Content-Length", 0))
            if all(_TESTS[kind](row[column], value) for column, kind, value in self.tests):
                row["headers"] = list(headers.items())
                http = (row["content_type"] or "").startswith("application/http")
                if wanted & {"payload", "payload_length"} and http:
                    head = data.until(b"\r\n\r\n")
                    rest -= len(head) + 4
                    row["payload_length"] = int(_headers(head).get("Content-Length", rest))
                else:
                    row["payload_length"] = rest
                if "payload" in wanted and row["warc_type"] != "revisit":
                    row["payload"] = data.take(rest)
                    rest = 0
                yield {c: row.get(c) for c in self.columns}
            data.end(rest)


class WarcSource(DataSource):
    """The format ``warc``."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return READ

    def reader(self, schema: StructType) -> DataSourceReader:
        return WarcReader(self.options["path"], schema)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return WarcWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    """Make the format known, and let its filters be pushed down."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def read(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Records of a folder; ``columns`` of :data:`READ`, all when not given."""
    register(spark)
    full = StructType.fromDDL(READ)
    return spark.read.format("warc").schema(StructType([full[c] for c in columns or full.names])).load(path)


def base32_digest(hex_digest):
    """``sha1:`` and base 32 from a bare hexadecimal digest, in batches."""

    @F.pandas_udf("string")
    def run(x):
        return x.map(lambda h: "sha1:" + base64.b32encode(bytes.fromhex(h)).decode())

    return run(hex_digest)


def hex_digest(digest):
    @F.pandas_udf("string")
    def run(x):
        return x.map(lambda d: base64.b32decode(d.removeprefix("sha1:")).hex())

    return run(digest)


def plan_records(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html", date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Rows to write, with the columns of :data:`WRITTEN`; ids become ``urn:page:`` names."""
    rows = pages.select(F.col(id_column).cast("long").alias("id"), F.col(url_column).alias("target_uri"), F.coalesce(F.col(html_column), F.lit("")).cast("binary").alias("payload"))
    rows = rows.select("*", F.sha1("payload").alias("sha"), F.octet_length("payload").cast("long").alias("payload_length"))
    long = F.col("payload_length") >= LEAST_REVISIT
    again = rows.where(long).groupBy("sha", "payload_length").agg(F.max("id").alias("kept"), F.count("*").alias("n")).where("n > 1 and kept is not null").drop("n")
    again = common.written(again, "again")
    few = again.count() <= BROADCAST_ROWS
    # Payloads that cannot be revisited are never moved, others only where too many digests repeat.
    short = rows.where(~long).withColumn("kept", F.lit(None).cast("long"))
    rows = rows.where(long).join(F.broadcast(again) if few else again, ["sha", "payload_length"], "left").select(short.columns).unionByName(short)
    revisit = F.coalesce(F.col("id") < F.col("kept"), F.lit(False))
    name = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    return rows.select(
        F.coalesce(name(F.col("id")), F.lit("<urn:page:>")).alias("record_id"),
        F.when(revisit, "revisit").otherwise("response").alias("warc_type"),
        "target_uri",
        F.lit(date).alias("warc_date"),
        base32_digest(F.col("sha")).alias("payload_digest"),
        F.when(revisit, name(F.col("kept"))).alias("refers_to"),
        "payload_length",
        F.when(~revisit, F.col("payload")).alias("payload"),
    )


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write every page to archives and read them back: responses whole, revisits by their headers."""
    register(spark)
    common.small_batches(spark)
    path = common.shared_folder(spark, "warc")
    plan_records(common.table(spark, sf_dir, "pages")).write.format("warc").mode("append").save(path)
    number = lambda c: F.expr(f"try_cast(regexp_extract({c}, '<urn:page:(-?[0-9]+)>', 1) as bigint)")
    whole = read(spark, path, ["record_id", "warc_type", "payload"]).where("warc_type = 'response'")
    short = read(spark, path, ["record_id", "warc_type", "payload_digest", "refers_to", "payload_length"]).where("warc_type = 'revisit'")
    return whole.select(
        number("record_id").alias("page_id"), F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"), F.col("warc_type").alias("record_type"), F.lit(None).cast("long").alias("refers_to")
    ).unionByName(
        short.select(number("record_id").alias("page_id"), F.col("payload_length").alias("payload_bytes"), hex_digest(F.col("payload_digest")).alias("payload_digest"), F.col("warc_type").alias("record_type"), number("refers_to").alias("refers_to"))
    )


QUERIES = {"op9_warc": op9_warc}

ORACLES = {
    "op9_warc": f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n FROM pages),
d AS (SELECT page_id, n, sha1(html) AS digest FROM p),
m AS (SELECT *, CASE WHEN n >= {LEAST_REVISIT} THEN max(page_id) OVER (PARTITION BY digest) END AS kept FROM d)
SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest,
  CASE WHEN page_id < kept THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id < kept THEN kept END AS refers_to
FROM m""",
}
