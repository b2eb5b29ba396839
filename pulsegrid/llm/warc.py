"""WARC archives as a Spark data source.

Writing: every task writes one archive; a file counts once the driver's commit has
listed it in the manifest, so a lost or repeated task leaves nothing behind.
Reading: partitions come from the manifest (or, without one, from the folder) and are
cut at record starts, predicates on record type, target and page id are taken from
Spark, and headers are parsed first: a record that they rule out, or whose payload no
column asks for, is skipped by its Content-Length without being decoded.

Payloads are HTTP bodies with ``Content-Encoding: gzip``; headers stay plain, which is
what makes them cheap to skip.  Archives with a gzip member per record are read too.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, WriterCommitMessage

MANIFEST = "_manifest"
SPLIT_BYTES = 32 << 20
BATCH_ROWS, BATCH_BYTES = 2000, 16 << 20
RECORD_ID, TARGET, PROFILE = "<urn:page:{}>", "WARC-Target-URI", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

SCHEMA = T.StructType(
    [
        T.StructField("record_type", T.StringType()),
        T.StructField("target_uri", T.StringType()),
        T.StructField("page_id", T.LongType()),
        T.StructField("refers_to", T.LongType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload", T.BinaryType()),
    ]
)
_ARROW = pa.schema([("record_type", pa.string()), ("target_uri", pa.string()), ("page_id", pa.int64()), ("refers_to", pa.int64()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary())])


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _clean(value: str) -> str:
    return value.replace("\r", "%0D").replace("\n", "%0A")


def record(row: dict) -> bytes:
    """A response with its payload, or a revisit that points to the response."""
    revisit = row["record_type"] == "revisit"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    block = http + b"\r\n" if revisit else http + b"Content-Encoding: gzip\r\n\r\n" + packer.compress(row["payload"]) + packer.flush()
    head = [
        "WARC/1.1",
        f"WARC-Type: {row['record_type']}",
        f"WARC-Record-ID: {RECORD_ID.format('' if row['page_id'] is None else row['page_id'])}",
        "WARC-Date: 2024-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{row['payload_digest']}",
        f"X-Payload-Length: {row['payload_bytes']}",
        "Content-Type: application/http; msgtype=response",
    ]
    if row["target_uri"] is not None:
        head.append(f"{TARGET}: {_clean(row['target_uri'])}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {RECORD_ID.format(row['refers_to'])}"]
    return "\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


@dataclass
class Written(WriterCommitMessage):
    """Archive name, and where its splits start and stop."""

    name: str
    splits: list[tuple[int, int]]


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        task = TaskContext.get()
        name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}.warc"
        store, folder = fs.FileSystem.from_uri(self.path)
        at, cuts = 0, [0]
        with store.open_output_stream(f"{folder}/{name}", compression=None) as out:
            for batch in iterator:
                for row in batch.to_pylist():
                    data = record(row)
                    out.write(data)
                    at += len(data)
                    if at - cuts[-1] >= SPLIT_BYTES:
                        cuts.append(at)
        return Written(name, [(a, b) for a, b in zip(cuts, [*cuts[1:], at], strict=True) if b > a])

    def commit(self, messages: list[Written | None]) -> None:
        store, folder = fs.FileSystem.from_uri(self.path)
        listed = {m.name: m.splits for m in messages if m is not None}
        # a manifest for every write, so that appending keeps what was there
        with store.open_output_stream(f"{folder}/{MANIFEST}-{uuid.uuid4().hex}.json", compression=None) as out:
            out.write(json.dumps(listed).encode())

    def abort(self, messages: list[Written | None]) -> None:
        store, folder = fs.FileSystem.from_uri(self.path)
        for m in messages:
            if m is not None:
                store.delete_file(f"{folder}/{m.name}")


def read_headers(stream) -> dict[str, str] | None:
    """Header fields of the record at hand, by lower-case name; None at the end."""
    line = stream.readline()
    while line in (b"\r\n", b"\n"):
        line = stream.readline()
    if not line:
        return None
    if not line.startswith(b"WARC/"):
        raise ValueError(f"no WARC record starts with {line[:40]!r}")
    found = {"version": line.strip().decode()}
    while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
        name, _, value = line.decode("utf-8", "replace").partition(":")
        found[name.strip().lower()] = value.strip()
    return found


def _page(value: str | None) -> int | None:
    digits = (value or "").removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits.lstrip("-").isdigit() else None


def from_headers(head: dict[str, str]) -> dict:
    length = head.get("x-payload-length")
    return {
        "record_type": head.get("warc-type"),
        "target_uri": head.get(TARGET.lower()),
        "page_id": _page(head.get("warc-record-id")),
        "refers_to": _page(head.get("warc-refers-to")),
        "payload_digest": (head.get("warc-payload-digest") or "").removeprefix("sha1:") or None,
        "payload_bytes": None if length is None else int(length),
        "payload": None,
    }


def body_of(block: bytes) -> bytes:
    """Payload of an HTTP message, with its transfer form undone."""
    head, _, body = block.partition(b"\r\n\r\n")
    fields = head.lower()
    return zlib.decompress(body, 47) if b"content-encoding: gzip" in fields or b"content-encoding: deflate" in fields else body


def records(stream, wanted, with_payload: bool) -> Iterator[dict]:
    """Rows that pass ``wanted``; other blocks are skipped, not read."""
    while (head := read_headers(stream)) is not None:
        row, length = from_headers(head), int(head.get("content-length", 0))
        if not wanted(row):
            stream.seek(length, io.SEEK_CUR)
        elif with_payload and row["record_type"] == "response":
            row["payload"] = body_of(stream.read(length))
            # what is reported is what was read, not what the header claims
            row["payload_bytes"], row["payload_digest"] = len(row["payload"]), sha1_base32(row["payload"])
            yield row
        else:
            stream.seek(length, io.SEEK_CUR)
            yield row


class _Bounded(io.RawIOBase):
    """A range of a seekable file as a stream."""

    def __init__(self, source, start: int, stop: int):
        self.source, self.at, self.stop = source, start, stop

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def seek(self, offset: int, whence: int = io.SEEK_SET) -> int:
        self.at = offset if whence == io.SEEK_SET else (self.at if whence == io.SEEK_CUR else self.stop) + offset
        return self.at

    def tell(self) -> int:
        return self.at

    def readinto(self, buffer) -> int:
        size = max(0, min(len(buffer), self.stop - self.at))
        if not size:
            return 0
        self.source.seek(self.at)
        data = self.source.read(size)
        buffer[: len(data)] = data
        self.at += len(data)
        return len(data)


@dataclass
class Split(InputPartition):
    name: str
    start: int
    stop: int


class WarcReader(DataSourceReader):
    """Takes equality and membership predicates on header columns from Spark."""

    HEADER_COLUMNS = ("record_type", "target_uri", "page_id", "refers_to")

    def __init__(self, path: str, payloads: bool, split_bytes: int):
        self.path, self.payloads, self.split_bytes = path, payloads, split_bytes
        self.wanted: dict[str, set] = {}

    def pushFilters(self, filters: list[Filter]):  # noqa: N802
        for f in filters:
            if isinstance(f, EqualTo | In) and len(f.attribute) == 1 and f.attribute[0] in self.HEADER_COLUMNS:
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                name = f.attribute[0]
                self.wanted[name] = self.wanted[name] & values if name in self.wanted else values
            else:
                yield f

    def partitions(self) -> list[Split]:
        store, folder = fs.FileSystem.from_uri(self.path)
        found = store.get_file_info(fs.FileSelector(folder))
        listed: dict[str, list] = {}
        for x in found:
            if x.is_file and x.base_name.startswith(MANIFEST):
                with store.open_input_stream(x.path, compression=None) as f:
                    listed |= json.loads(f.read())
        if listed:
            return [Split(name, a, b) for name, cuts in sorted(listed.items()) for a, b in cuts]
        return [Split(x.base_name, 0, x.size) for x in found if x.is_file and x.base_name.endswith((".warc", ".warc.gz"))]

    def read(self, partition: Split) -> Iterator[pa.RecordBatch]:
        if partition is None:  # an archive folder without records
            return
        wanted = lambda row: all(row[k] in v for k, v in self.wanted.items())
        store, folder = fs.FileSystem.from_uri(self.path)
        rows, held = [], 0
        with store.open_input_file(f"{folder}/{partition.name}") as source:
            stream = io.BufferedReader(_Bounded(source, partition.start, partition.stop), 1 << 16)
            if partition.name.endswith(".gz"):
                import gzip

                stream = io.BufferedReader(gzip.GzipFile(fileobj=stream))
            for row in records(stream, wanted, self.payloads):
                rows.append(row)
                held += len(row["payload"] or b"")
                if len(rows) >= BATCH_ROWS or held >= BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)


class WarcDataSource(DataSource):
    """``warc``: options ``path`` and ``payloads`` (false: headers only)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> T.StructType:
        return SCHEMA

    def reader(self, schema: T.StructType) -> WarcReader:
        return WarcReader(self.options["path"], self.options.get("payloads", "true").lower() != "false", int(self.options.get("split_bytes", SPLIT_BYTES)))

    def writer(self, schema: T.StructType, overwrite: bool) -> WarcWriter:
        store, folder = fs.FileSystem.from_uri(self.options["path"])
        if overwrite:
            store.delete_dir_contents(folder, missing_dir_ok=True)
        store.create_dir(folder, recursive=True)
        return WarcWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


def to_records(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Rows of the data source from ``page_id``, ``url`` and ``html``.

    Of equal payloads of at least ``least_bytes`` the one with the smallest page_id is
    the response (all rows with that id, if it repeats; a null id comes last) and the
    others revisit it.  Smaller payloads and payloads of one page are responses.  A
    null html is the empty payload.  Only digests with several ids are joined back, so
    a payload that a third of the pages share meets one row per salt.
    """
    salts = 32
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").alias("target_uri"), payload.alias("payload"))
    rows = rows.withColumn("sha1", F.unhex(F.sha1("payload"))).withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    shared = (
        rows.where(F.col("payload_bytes") >= least_bytes)
        .groupBy("sha1")
        .agg(F.min("page_id").alias("first_id"), F.count("*").alias("n"), F.max("page_id").alias("last_id"), F.count("page_id").alias("n_ids"))
        .where("first_id is not null and (first_id < last_id or n_ids < n)")
        .select("sha1", "first_id", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    )
    salt = F.pmod(F.xxhash64("page_id"), F.lit(salts)).cast("int")
    joined = rows.withColumn("salt", salt).join(shared, ["sha1", "salt"], "left")
    revisit = F.col("first_id").isNotNull() & (F.col("payload_bytes") >= least_bytes) & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return joined.select(
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        "target_uri",
        "page_id",
        F.when(revisit, F.col("first_id")).alias("refers_to"),
        _base32("sha1").alias("payload_digest"),
        "payload_bytes",
        F.when(~revisit, F.col("payload")).alias("payload"),
    )


def _base32(column: str):
    """Base32 of a 20-byte binary, five bits at a time."""
    bits = F.concat(*[F.lpad(F.conv(F.hex(F.substring(column, 1 + 5 * k, 5)), 16, 2), 40, "0") for k in range(4)])
    return F.translate(F.concat(*[F.conv(F.substring(bits, 1 + 5 * k, 5), 2, 32) for k in range(32)]), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def write(pages: DataFrame, path: str, least_bytes: int = 0) -> None:
    register(pages.sparkSession)
    to_records(pages, least_bytes).write.format("warc").mode("append").option("path", path).save()


def read(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("payloads", str(payloads)).load(path)


def digest(pages: DataFrame, path: str) -> DataFrame:
    """Writes all pages to archives under ``path`` and returns what the archives say.

    Null is the empty page; of equal payloads the smallest page_id is the response and the
    others revisit it; repeated rows are records of their own; other columns don't matter."""
    write(pages, path)
    return read(pages.sparkSession, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
