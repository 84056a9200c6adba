"""WARC archives as a Spark data source written in Python.

``spark.read.format("warc").load(path)`` plans one partition per archive file, pushes
predicates on the record type and on other header fields down to the reader, and parses a
record's headers before anything else.  Where a predicate fails, or ``payload`` is
``false``, the block is skipped by seeking over its Content-Length; only wanted payloads
are decompressed and decoded.

``df.write.format("warc").save(path)`` writes records to files of about ``file_bytes``.
Each task writes files of its own name and each commit adds a listing of those of successful tasks, so
a task that ran twice, or whose executor was lost, leaves nothing that is read, and an append
keeps what earlier commits listed; overwriting removes it.  Payloads
are stored as gzip-encoded HTTP bodies; records with ``refers_to`` become revisits without
one.  A file, or a folder without a listing, is read as archives of others: all its ``.warc`` and
``.warc.gz`` files (blocks of the latter are skipped by decompressing over them).

Paths are any that pyarrow's file systems open (local, HDFS, object stores).

Rows: page_id (null: a record without one, or with an id of others), url, record_type, refers_to, payload_bytes,
payload_digest (SHA-1 of the whole payload, lower-case hex; as the header has it in archives of others), payload (null for revisits
and where not read; the whole block of records that hold no HTTP message) and record_id, the id as it stands in the header.  Null payloads are written as empty ones.
Very long payloads are one record each, held once per task; repeated rows are records of their own;
extra columns are not written.  An empty table gives an archive without files.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, WriterCommitMessage

from foretide.settings import materialise

SCHEMA = (
    "page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string, payload binary, record_id string"
)
_ARROW = pa.schema(
    [
        ("page_id", pa.int64()),
        ("url", pa.string()),
        ("record_type", pa.string()),
        ("refers_to", pa.int64()),
        ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()),
        ("payload", pa.binary()),
        ("record_id", pa.string()),
    ]
)
#: Header fields behind the columns that predicates may use.
HEADER = ("record_type", "page_id", "url", "refers_to", "payload_digest", "payload_bytes", "record_id")
LISTING = re.compile(r"_archives-[0-9a-f]+\.json")
OWN_ID = re.compile(r"<urn:page:(-?[0-9]+)>")
_BATCH = 8 << 20


def _files(path: str):
    from pyarrow import fs

    if path.startswith("file:/") and not path.startswith("file:///"):
        path = "file://" + path[5:]
    return fs.FileSystem.from_uri(path)


def _number(urn: str | None) -> int | None:
    """The page of an id that :func:`record` wrote."""
    own = OWN_ID.fullmatch(urn or "")
    return int(own[1]) if own else None


def _listings(files, root: str) -> list[str]:
    """Names of the listings under ``root``, none where it is no folder."""
    from pyarrow import fs

    if files.get_file_info(root).type != fs.FileType.Directory:
        return []
    return sorted(i.base_name for i in files.get_file_info(fs.FileSelector(root)) if LISTING.fullmatch(i.base_name))


def _listed(files, root: str, names: list[str]) -> list[list]:
    out = []
    for name in names:
        with files.open_input_stream(f"{root}/{name}") as f:
            out += json.loads(f.read())
    return out


def record(page_id, url, refers_to, payload: bytes | None, payload_bytes: int, digest: str, level: int = 1) -> bytes:
    """One WARC record: headers, a blank line, an HTTP message, two line ends."""
    kind = "response" if refers_to is None else "revisit"
    http = ["HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8"]
    body = b""
    if kind == "response":
        body = zlib.compress(payload or b"", level, wbits=31)
        http += ["Content-Encoding: gzip", f"Content-Length: {len(body)}"]
    block = ("\r\n".join(http) + "\r\n\r\n").encode() + body
    head = ["WARC/1.1", f"WARC-Type: {kind}", "WARC-Date: 1970-01-01T00:00:00Z"]
    if page_id is not None:
        head.append(f"WARC-Record-ID: <urn:page:{page_id}>")
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    head += [f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Payload-Length: {payload_bytes}"]
    if kind == "revisit":
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return ("\r\n".join(head) + "\r\n\r\n").encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def _lines(stream) -> Iterator[str]:
    """Header lines up to the blank one."""
    while (line := stream.readline()) not in (b"\r\n", b""):
        yield line.decode("utf-8", "surrogatepass").rstrip("\r\n")


def records(stream, wanted, payload: bool) -> Iterator[tuple]:
    """Rows of one archive.  ``wanted`` sees the header fields; unwanted blocks are not read."""
    while True:
        version = stream.readline()
        if not version:
            return
        if not version.strip():
            continue
        if not version.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {version[:40]!r}")
        head = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in _lines(stream))}
        length = int(head["content-length"])
        row = {
            "page_id": _number(head.get("warc-record-id")),
            "url": head.get("warc-target-uri"),
            "record_type": head["warc-type"],
            "refers_to": _number(head.get("warc-refers-to")),
            "payload_bytes": int(head["warc-payload-length"]) if "warc-payload-length" in head else None,
            "payload_digest": head.get("warc-payload-digest", "").removeprefix("sha1:"),
            "payload": None,
            "record_id": head.get("warc-record-id"),
        }
        if not wanted(row) or not payload or row["record_type"] == "revisit":
            stream.seek(length, 1)
            if wanted(row):
                yield row
            continue
        row["payload"] = _payload(stream.read(length))
        yield row


def _payload(block: bytes) -> bytes:
    """The body of an HTTP message, decompressed; any other block as it is."""
    at = block.find(b"\r\n\r\n")
    if not block.startswith(b"HTTP/") or at < 0:
        return block
    body = block[at + 4 :]
    return zlib.decompress(body, wbits=31) if b"\r\ncontent-encoding: gzip" in block[:at].lower() else body


class Archive(InputPartition):
    def __init__(self, path: str, size: int):
        self.path, self.size = path, size


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = options["path"]
        self.payload = str(options.get("payload", "true")).lower() == "true"
        self.tests: list[tuple[str, frozenset]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Take over equality and membership tests on header fields; hand back the rest."""
        for f in filters:
            if isinstance(f, EqualTo) and len(f.attribute) == 1 and f.attribute[0] in HEADER:
                self.tests.append((f.attribute[0], frozenset([f.value])))
            elif isinstance(f, In) and len(f.attribute) == 1 and f.attribute[0] in HEADER:
                self.tests.append((f.attribute[0], frozenset(f.value)))
            else:
                yield f

    def partitions(self) -> Sequence[InputPartition]:
        files, root = _files(self.root)
        names = _listings(files, root)
        if names:
            return [Archive(f"{root}/{name}", size) for name, size in _listed(files, root, names)] or [Archive("", 0)]
        return self._others(files, root) or [Archive("", 0)]

    @staticmethod
    def _others(files, root: str) -> list[InputPartition]:
        from pyarrow import fs

        info = files.get_file_info(root)
        found = [info] if info.type == fs.FileType.File else files.get_file_info(fs.FileSelector(root, recursive=True))
        return [Archive(i.path, i.size) for i in found if i.type == fs.FileType.File and i.base_name.endswith((".warc", ".warc.gz"))]

    def read(self, partition: Archive) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        files, _ = _files(self.root)
        tests = self.tests

        def wanted(row: dict) -> bool:
            return all(row[c] in values for c, values in tests)

        held, size = [], 0
        with files.open_input_file(partition.path) as raw:
            stream = gzip.GzipFile(fileobj=raw) if partition.path.endswith(".gz") else _Forward(raw)
            for row in records(stream, wanted, self.payload):
                held.append(row)
                size += 200 + len(row["payload"] or b"")
                if size >= _BATCH:
                    yield pa.RecordBatch.from_pylist(held, schema=_ARROW)
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=_ARROW)


class _Forward:
    """Line reads, block reads and skips over a random-access file, through one small buffer."""

    def __init__(self, raw, chunk: int = 1 << 16):
        self.raw, self.chunk, self.at, self.base, self.data = raw, chunk, 0, 0, b""
        self.size = raw.size()

    def _fill(self, need: int) -> None:
        have = self.base + len(self.data) - self.at
        if have < need and self.base + len(self.data) < self.size:
            rest = self.data[self.at - self.base :] if have > 0 else b""
            start = self.at + len(rest)
            self.data = rest + self.raw.read_at(max(need - len(rest), self.chunk), start)
            self.base = self.at

    def readline(self) -> bytes:
        need = 512
        while True:
            self._fill(need)
            view = self.data[self.at - self.base :]
            end = view.find(b"\n")
            if end >= 0 or self.base + len(self.data) >= self.size:
                line = view[: end + 1] if end >= 0 else view
                self.at += len(line)
                return line
            need = 2 * max(need, len(view))

    def read(self, n: int) -> bytes:
        self._fill(n)
        out = self.data[self.at - self.base : self.at - self.base + n]
        self.at += len(out)
        return out

    def seek(self, n: int, _whence: int) -> None:
        self.at += n
        if self.at - self.base >= len(self.data):
            self.base, self.data = self.at, b""


class Written(WriterCommitMessage):
    def __init__(self, files: list):
        self.files = files


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.root = options["path"]
        self.file_bytes = int(options.get("file_bytes", 64 << 20))
        self.overwrite = overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        files, root = _files(self.root)
        files.create_dir(root, recursive=True)
        done, out, name, size = [], None, "", 0
        try:
            for batch in iterator:
                columns = {c: batch.column(c) for c in ("page_id", "url", "refers_to", "payload")}
                for i in range(batch.num_rows):
                    page_id, url, refers_to, payload = (columns[c][i].as_py() for c in ("page_id", "url", "refers_to", "payload"))
                    payload = payload or b""
                    data = record(page_id, url, refers_to, payload, len(payload), hashlib.sha1(payload).hexdigest())
                    if out is None:
                        name, size = f"part-{uuid.uuid4().hex}.warc", 0
                        out = files.open_output_stream(f"{root}/{name}")
                    out.write(data)
                    size += len(data)
                    if size >= self.file_bytes:
                        out.close()
                        out = None
                        done.append([name, size])
        finally:
            if out is not None:
                out.close()
        if out is not None:
            done.append([name, size])
        return Written(done)

    def commit(self, messages: list) -> None:
        files, root = _files(self.root)
        files.create_dir(root, recursive=True)
        old = _listings(files, root) if self.overwrite else []
        replaced = _listed(files, root, old)
        with files.open_output_stream(f"{root}/_archives-{uuid.uuid4().hex}.json") as f:
            f.write(json.dumps([x for m in messages if m is not None for x in m.files]).encode())
        for name in old:
            files.delete_file(f"{root}/{name}")
        for name, _ in replaced:
            files.delete_file(f"{root}/{name}")

    def abort(self, messages: list) -> None:
        files, root = _files(self.root)
        for name, _ in (x for m in messages if m is not None for x in m.files):
            files.delete_file(f"{root}/{name}")


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return WarcReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return WarcWriter(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    """Make the format known; predicates reach Python sources only with this option on."""
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def with_revisits(pages: DataFrame, least: int = 1_000) -> DataFrame:
    """(page_id, url, refers_to, payload): repeats of a payload of ``least`` bytes or more refer to its last page.

    Of equal payloads the rows with the largest page_id stay responses, the others refer to
    it; a group without any page_id has responses only.
    """
    rows = pages.select("page_id", "url", F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload")).withColumn("_d", F.sha1("payload"))
    big = rows.where(F.octet_length("payload") >= least).groupBy("_d").agg(F.count("*").alias("_n"), F.max("page_id").alias("_last")).where("_n > 1 and _last is not null")
    # Written, so Spark knows its size: broadcast where small, skew-split join where not.
    repeated = materialise(big.select(F.col("_d").alias("_same"), "_last"), "warc-repeated")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("_last")), F.col("_last"))
    return rows.join(repeated, F.col("_d") == F.col("_same"), "left").select("page_id", "url", refers.alias("refers_to"), "payload")


def write_pages(pages: DataFrame, path: str, least: int = 1_000) -> None:
    """Archive ``pages`` (page_id, url, html)."""
    register(pages.sparkSession)
    with_revisits(pages, least).write.format("warc").mode("append").save(path)


def read(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)
