"""WARC archives: a writer and a Python data source (operator 8).

The writer lays out records as text whose line ends are the blank lines that
end a record, so Spark's own file writer puts them into any store and commits
them like any table. The reader plans a partition for each file, takes
predicates on the record type and other header fields, parses a record's
headers first, and passes over a payload that nothing asks for.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
from collections.abc import Iterable, Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull
from pyspark.sql.types import StructType

from .common import materialize, new_folder

#: Fixed values of the format.
VERSION, PROFILE = "WARC/1.1", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Column of the source -> header field.
FIELDS = {"record_type": "WARC-Type", "record_id": "WARC-Record-ID", "target_uri": "WARC-Target-URI", "payload_digest": "WARC-Payload-Digest", "refers_to": "WARC-Refers-To"}
SCHEMA = "record_type string, record_id string, target_uri string, payload_digest string, refers_to string, payload_bytes long, payload binary"
BATCH_BYTES = 8 << 20


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _clean(value: str) -> str:
    return "".join(c if c > " " else f"%{ord(c):02X}" for c in value)


def record(kind: str, record_id: str, uri: str, payload: str, refers_to: str | None, date: str) -> str:
    """A record without the blank lines that end it."""
    raw = payload.encode("utf-8", "replace")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(raw)}\r\n\r\n"
    lines = [VERSION, f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {date}", f"WARC-Target-URI: {_clean(uri)}", f"WARC-Payload-Digest: sha1:{digest(raw)}", f"X-Payload-Length: {len(raw)}", "Content-Type: application/http; msgtype=response"]
    if kind == "revisit":
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{refers_to}>"]
    body = http if kind == "revisit" else http + payload
    lines.append(f"Content-Length: {len(body.encode('utf-8', 'replace'))}")
    return "\r\n".join(lines) + "\r\n\r\n" + body


def write_warc(pages: DataFrame, path: str, least_bytes: int = 0, id_col: str = "page_id", uri_col: str = "url", text_col: str = "html", date: str = "2024-01-01T00:00:00Z") -> None:
    """A record for each row. Of equal payloads of least_bytes or more the row with the largest id is the response, the others revisit it."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.coalesce(F.col(uri_col).cast("string"), F.lit("")).alias("url"), F.coalesce(F.col(text_col), F.lit("")).alias("html"))
    rows = rows.withColumn("key", F.unhex(F.sha2(F.encode("html", "utf-8"), 256)))
    heads = rows.where(F.octet_length("html") >= least_bytes).groupBy("key").agg(F.max("page_id").alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1 and head is not null").select("key", "head")
    heads = materialize(heads, "heads")  # on disk its size is known, so the engine broadcasts it only if it is small
    out = rows.join(heads, "key", "left").select("page_id", "url", "html", "head")

    def laid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                made = []
                for page, url, html, head in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "head")), strict=True):
                    kind = "revisit" if head is not None and page != head else "response"
                    made.append(record(kind, f"urn:page:{'' if page is None else page}", url, html, f"urn:page:{head}", date))
                yield pa.RecordBatch.from_arrays([pa.array(made, pa.string())], ["value"])

    out.mapInArrow(laid, "value string").write.option("lineSep", "\r\n\r\n").text(path)


def _open_store(path: str):
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    if "://" not in path:
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path)


class File(InputPartition):
    def __init__(self, path: str):
        self.path = path


def _line_headers(stream: BinaryIO) -> dict[str, str] | None:
    """The next record's header fields; None at the end."""
    line = stream.readline()
    while line in (b"\r\n", b"\n"):
        line = stream.readline()
    if not line:
        return None
    if not line.startswith(b"WARC/"):
        raise ValueError(f"not a WARC record: {line[:40]!r}")
    out: dict[str, str] = {}
    while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
        name, _, value = line.decode("utf-8", "replace").partition(":")
        out[name.strip().lower()] = value.strip()
    return out


class WarcReader(DataSourceReader):
    """Records of files whose header fields hold one of the given values; a partition for each file."""

    def __init__(self, path: str, with_payload: bool, only: dict[str, Iterable[str]] | None = None):
        self.path, self.with_payload = path, with_payload
        self.only = {n: set(v) for n, v in (only or {}).items()}
        self.present: set[str] = set()

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        store, root = _open_store(self.path)
        info = store.get_file_info(root)
        files = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(root, recursive=True))
        scheme = self.path.partition("://")[0] + "://" if "://" in self.path and not self.path.startswith("file:") else ""
        found = [File(scheme + f.path) for f in files if f.type == fs.FileType.File and f.size and f.base_name[0] not in "._"]
        return found or [File("")]

    def read(self, partition: File) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        names = [*FIELDS, "payload_bytes", "payload"]
        schema = pa.schema([(n, pa.int64() if n == "payload_bytes" else pa.binary() if n == "payload" else pa.string()) for n in names])
        store, path = _open_store(partition.path)
        rows, held = [], 0
        with store.open_input_file(path) as raw:
            stream = io.BufferedReader(gzip.GzipFile(fileobj=raw) if path.endswith(".gz") else raw, 1 << 20)
            while (head := _line_headers(stream)) is not None:
                length = int(head["content-length"])
                fields = {n: head.get(h.lower()) for n, h in FIELDS.items()}
                for n in ("record_id", "refers_to"):
                    fields[n] = fields[n] and fields[n].strip("<>")
                fields["payload_digest"] = fields["payload_digest"] and fields["payload_digest"].removeprefix("sha1:")
                if any(fields[n] not in v for n, v in self.only.items()) or any(fields[n] is None for n in self.present):
                    stream.seek(length, io.SEEK_CUR)  # an unwanted block is not read
                    continue
                size, payload = head.get("x-payload-length"), None
                if fields["record_type"] == "response" and self.with_payload:
                    block = stream.read(length)
                    payload = block.partition(b"\r\n\r\n")[2] if head.get("content-type", "").startswith("application/http") else block
                    size = len(payload)
                    held += size
                else:
                    stream.seek(length, io.SEEK_CUR)
                rows.append({**fields, "payload_bytes": None if size is None else int(size), "payload": payload})
                if held >= BATCH_BYTES or len(rows) >= 10_000:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)


class PushedWarcReader(WarcReader):
    """The same where the session lets Python sources take predicates."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if isinstance(f, EqualTo) and name in FIELDS:
                self.only[name] = self.only.get(name, {f.value}) & {f.value}
            elif isinstance(f, In) and name in FIELDS:
                self.only[name] = self.only.get(name, set(f.value)) & set(f.value)
            elif isinstance(f, IsNotNull) and name in FIELDS:
                self.present.add(name)
            else:
                yield f


class WarcSource(DataSource):
    """spark.read.format("warc").option("payload", "false").load(folder)"""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        kind = PushedWarcReader if self.options.get("pushdown", "false").lower() == "true" else WarcReader
        return kind(self.options["path"], self.options.get("payload", "true").lower() == "true", json.loads(self.options.get("only", "{}")))


def read_warc(spark: SparkSession, path: str, payload: bool = True, **only: str | list[str]) -> DataFrame:
    """Records of the archives below a path; only: values of columns that are header fields, which the reader looks at before anything else.

    Filters of the engine reach the reader as well where the session's
    spark.sql.python.filterPushdown.enabled is set; it is left as it is.
    """
    spark.dataSource.register(WarcSource)
    wanted = json.dumps({n: [v] if isinstance(v, str) else list(v) for n, v in only.items()})
    pushdown = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    return spark.read.format("warc").option("payload", str(payload).lower()).option("pushdown", pushdown).option("only", wanted).load(path)


def archived(pages: DataFrame, least_bytes: int = 0, id_col: str = "page_id", uri_col: str = "url", text_col: str = "html") -> DataFrame:
    """Write pages as archives in the shared folder and read them back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    A null text counts as empty. payload_bytes and payload_digest are of the
    full payload: of a response as read, of a revisit as its headers say. A row
    with a null id is a revisit if another row with an id has its payload. Repeated rows
    are written as often as they come; those that repeat the response's id are
    responses too. Extra columns are not read; an empty table gives an empty result.
    """
    spark = pages.sparkSession
    path = new_folder(spark, "warc")
    write_warc(pages, path, least_bytes, id_col, uri_col, text_col)
    back = read_warc(spark, path, record_type=["response", "revisit"])

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for said, payload in zip(batch.column("payload_digest"), batch.column("payload"), strict=True):
                if payload.is_valid and digest(payload.as_py()) != said.as_py():
                    raise ValueError("a payload does not have the digest that its headers say")
            yield batch.select(["record_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    back = back.select("record_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload").mapInArrow(checked, "record_id string, payload_bytes long, payload_digest string, record_type string, refers_to string")

    def page(c: str):
        return F.expr(f"try_cast(nullif(substring({c}, 10), '') as bigint)")

    return back.select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"))
