"""A WARC data source in Python, and pages written to archives and read back with it.

Reading: files are cut into partitions at record starts (from the index that the writer leaves beside an archive;
files without one are a partition each). Filters on the columns of headers (equality, lists, nulls, prefixes) are pushed
down; Spark hands over no filters on the map `headers`, so other headers are asked for by options ("header.WARC-Profile" = value).
A record's headers are parsed first; its block is skipped by its length, unread, unless the record passes
and the option "payload" is on. Only then is the HTTP message taken apart and the payload decoded. Archives of gzip members
(.warc.gz) are read, too: a skipped block is inflated past in pieces and never held.

Writing: each task writes an archive of its own under a fresh name; a commit lists the archives of the tasks
that succeeded in a manifest of its own, so what a lost executor or a second attempt left is never read and appends add up; an
overwrite removes the manifests before it, then their archives. Responses hold HTTP messages, so other tools read the archives. Files
are opened through pyarrow's file systems by the URI given, so shared stores work as well as local folders.

Columns: record_type, record_id, target_uri, refers_to, payload_digest, payload_length, headers (map of
lower-case names to values), payload (null where skipped or absent).

Null headers are left out. A null payload is written as an empty one. Malformed records raise with
their file and place. An empty table makes archives without records, which read as no rows.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from datetime import datetime, timezone

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, Filter, In, InputPartition, IsNotNull, IsNull, StringStartsWith, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema

from fieldbook.llm.common import fresh_path, partitions, saved

SCHEMA = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("record_type", "record_id", "target_uri", "refers_to", "payload_digest")]
    + [T.StructField("payload_length", T.LongType()), T.StructField("headers", T.MapType(T.StringType(), T.StringType())), T.StructField("payload", T.BinaryType())]
)
#: The headers behind the columns.
HEADERS = {"record_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "refers_to": "warc-refers-to", "payload_digest": "warc-payload-digest", "payload_length": "x-payload-length"}
CHUNK, BATCH, PIECE = 8 << 20, 2 << 20, 1 << 16
ENDING = b"\r\n\r\n"


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def encoded(headers: dict[str, str | None], payload: bytes | None) -> bytes:
    """A record. A response holds an HTTP message, with its payload deflated; the payload's own length is in X-Payload-Length."""
    block = b""
    if headers.get("WARC-Type") == "response":
        body = zlib.compress(payload, 1) if payload else b""
        lines = ["HTTP/1.1 200 OK", "Content-Type: text/html;charset=utf-8", *(["Content-Encoding: deflate"] if payload else []), f"Content-Length: {len(body)}"]
        block = "\r\n".join(lines).encode() + ENDING + body
    elif payload:
        block = payload
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in headers.items() if v is not None), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + ENDING + block + ENDING


def parsed(head: bytes) -> tuple[str, dict[str, str]]:
    """First line and headers (lower-case names) of a record or message."""
    first, *lines = head.decode("utf-8", "replace").split("\r\n")
    return first, {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


def payload_of(headers: dict[str, str], block: bytes) -> bytes:
    """The payload of a record's block: of an HTTP message its body, decoded; else the block."""
    if not block.startswith(b"HTTP/"):
        return block
    head, _, body = block.partition(ENDING)
    coding = parsed(head)[1].get("content-encoding", "")
    if coding in ("gzip", "x-gzip"):
        return zlib.decompress(body, 47)
    if coding == "deflate" and body:
        try:
            return zlib.decompress(body)
        except zlib.error:  # some servers leave out the zlib header
            return zlib.decompress(body, -15)
    return body


class Plain:
    """Reads a file from a place on, and skips by seeking."""

    def __init__(self, f: pa.NativeFile, at: int) -> None:
        self.f, self.at, self.held = f, at, b""
        f.seek(at)

    def head(self) -> bytes | None:
        """Up to the empty line; None at the end of the file."""
        while (cut := self.held.find(ENDING)) < 0:
            more = self.more(1024)
            if not more:
                if self.held.strip():
                    raise ValueError(f"no end of headers after byte {self.at}")
                return None
            self.held += more
        head, self.held = self.held[:cut], self.held[cut + 4 :]
        self.at += cut + 4
        return head

    def more(self, n: int) -> bytes:
        return self.f.read(n)

    def block(self, length: int) -> bytes:
        while len(self.held) < length:
            more = self.more(length - len(self.held))
            if not more:
                raise ValueError(f"block cut short after byte {self.at}")
            self.held += more
        out, self.held = self.held[:length], self.held[length:]
        self.at += length
        return out

    def skip(self, length: int) -> None:
        self.at += length
        if length <= len(self.held):
            self.held = self.held[length:]
        else:
            self.held = b""
            self.f.seek(self.at)


class Gzip(Plain):
    """The same over gzip members; places count inflated bytes."""

    def __init__(self, f: pa.NativeFile) -> None:
        super().__init__(f, 0)
        self.inflate, self.raw = zlib.decompressobj(31), b""

    def more(self, n: int) -> bytes:
        while True:
            if self.inflate.eof:
                self.raw, self.inflate = self.inflate.unused_data, zlib.decompressobj(31)
            self.raw = self.raw or self.inflate.unconsumed_tail or self.f.read(PIECE)
            if not self.raw:  # the file's end; the inflater may still hold something
                return b"" if self.inflate.eof else self.inflate.decompress(b"", PIECE)
            out = self.inflate.decompress(self.raw, PIECE)
            self.raw = self.inflate.unconsumed_tail
            if out:
                return out

    def skip(self, length: int) -> None:
        while length > 0:
            if not self.held and not (more := self.more(PIECE)):
                raise ValueError(f"block cut short after byte {self.at}")
            self.held = self.held or more
            n = min(length, len(self.held))
            self.held, self.at, length = self.held[n:], self.at + n, length - n


@dataclass
class Part(InputPartition):
    """The records that start in [start, end) of a file; end None: up to its end."""

    path: str
    start: int
    end: int | None


@dataclass
class Written(WriterCommitMessage):
    name: str
    starts: list[int]
    size: int


class WarcReader(DataSourceReader):
    def __init__(self, path: str, payload: bool, headers: dict[str, str]) -> None:
        self.path, self.payload = path.rstrip("/"), payload
        self.wanted: list[tuple[str, Callable[[str | None], bool]]] = [(k.lower(), lambda x, v=v: x == v) for k, v in headers.items()]

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes all filters on single headers; the rest stays with Spark."""
        for f in filters:
            name = HEADERS.get(f.attribute[0]) if len(f.attribute) == 1 and f.attribute[0] != "payload_length" else None
            if name is None:
                yield f
            elif isinstance(f, EqualTo | EqualNullSafe):
                self.wanted.append((name, lambda x, v=f.value: x == v))
            elif isinstance(f, In):
                self.wanted.append((name, lambda x, v=frozenset(f.value) - {None}: x in v))
            elif isinstance(f, IsNull | IsNotNull):
                self.wanted.append((name, lambda x, null=isinstance(f, IsNull): (x is None) == null))
            elif isinstance(f, StringStartsWith):
                self.wanted.append((name, lambda x, v=f.value: x is not None and x.startswith(v)))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        fs, root = opened(self.path)
        if fs.get_file_info(root).type == pafs.FileType.File:
            return [Part(root, 0, None)]
        files = [x.path for x in fs.get_file_info(pafs.FileSelector(root, recursive=True)) if x.type == pafs.FileType.File]
        manifests = sorted(x for x in files if is_manifest(x))
        if manifests:
            found = [x for m in manifests for x in archives(fs, m)]
            return [Part(f"{root}/{x['name']}", a, b) for x in found for a, b in zip(x["starts"], [*x["starts"][1:], x["size"]], strict=True)]
        return [Part(p, 0, None) for p in sorted(files) if p.endswith((".warc", ".warc.gz"))]

    def read(self, partition: Part | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # there is no archive
            return
        schema = to_arrow_schema(SCHEMA)
        fs, _ = opened(self.path)
        rows: list[dict] = []
        held = 0
        with fs.open_input_file(partition.path) as f:
            source = Gzip(f) if partition.path.endswith(".gz") else Plain(f, partition.start)
            while partition.end is None or source.at < partition.end:
                at = source.at
                try:
                    head = source.head()
                    if head is None:
                        break
                    version, headers = parsed(head)
                    if not version.startswith("WARC/"):
                        raise ValueError(f"no record at byte {at}")
                    length = int(headers["content-length"])
                    if not all(test(headers.get(name)) for name, test in self.wanted):
                        source.skip(length + 4)
                        continue
                    payload = None
                    if self.payload and length:
                        payload = payload_of(headers, source.block(length))
                        source.skip(4)
                    else:
                        source.skip(length + 4)
                except (ValueError, KeyError, zlib.error) as e:
                    raise ValueError(f"{partition.path}, record at byte {at}: {e}") from e
                row = {c: headers.get(h) for c, h in HEADERS.items()}
                row["payload_length"] = int(row["payload_length"]) if row["payload_length"] else length
                rows.append(row | {"headers": list(headers.items()), "payload": payload or None})
                held += len(payload or b"") + len(head)
                if held > BATCH:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)


def is_manifest(path: str) -> bool:
    return path.rpartition("/")[2].startswith("manifest-") and path.endswith(".json")


def archives(fs: pafs.FileSystem, manifest: str) -> list[dict]:
    with fs.open_input_stream(manifest) as f:
        return json.loads(f.read())


class WarcWriter(DataSourceArrowWriter):
    """Writes rows (headers map, payload binary)."""

    def __init__(self, path: str, overwrite: bool = False) -> None:
        self.path, self.overwrite = path.rstrip("/"), overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, root = opened(self.path)
        fs.create_dir(root, recursive=True)
        name, at, starts, f = f"{uuid.uuid4().hex}.warc", 0, [], None
        try:
            for b in iterator:
                for headers, payload in zip(b.column(b.schema.get_field_index("headers")), b.column(b.schema.get_field_index("payload")), strict=True):
                    f = f or fs.open_output_stream(f"{root}/{name}", buffer_size=1 << 20)  # tasks without rows leave no file
                    if not starts or at - starts[-1] >= CHUNK:
                        starts.append(at)
                    record = encoded(dict(headers.as_py() or []), payload.as_py())
                    f.write(record)
                    at += len(record)
        finally:
            if f:
                f.close()
        return Written(name, starts, at)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, root = opened(self.path)
        fs.create_dir(root, recursive=True)
        old = [x.path for x in fs.get_file_info(pafs.FileSelector(root)) if is_manifest(x.path)] if self.overwrite else []
        name = f"{root}/manifest-{uuid.uuid4().hex}.json"
        with fs.open_output_stream(f"{name}.part") as f:
            f.write(json.dumps([{"name": m.name, "starts": m.starts, "size": m.size} for m in messages if m and m.starts]).encode())
        fs.move(f"{name}.part", name)
        for m in old:
            gone = archives(fs, m)
            fs.delete_file(m)
            for x in gone:
                fs.delete_file(f"{root}/{x['name']}")

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, root = opened(self.path)
        for m in messages:
            if m and m.starts:
                fs.delete_file(f"{root}/{m.name}")


class WarcDataSource(DataSource):
    """format("warc"): option path; payload = false to skip all payloads; header.<name> = value to read only records with it."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> T.StructType:
        return SCHEMA

    def reader(self, schema: T.StructType) -> DataSourceReader:
        headers = {k[len("header.") :]: v for k, v in self.options.items() if k.lower().startswith("header.")}
        return WarcReader(self.options["path"], self.options.get("payload", "true").lower() != "false", headers)

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceArrowWriter:
        return WarcWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


def page_records(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 100, date: datetime | None = None) -> DataFrame:
    """headers and payload of a record for each page; `date` is when they were captured, now if not given.

    Of pages with equal payloads of `least` bytes or more the one with the smallest id is the response; the
    others revisit it and carry no payload. Of rows that share that id, too, all are responses, so nothing is lost.
    A page without an id is never revisited. Equal payloads are found on digests and ids alone. Payloads that more than half a
    partition's share of pages have are few; they are told to all tasks, and other pages meet by digest.
    """
    stamp = (date or datetime.now(timezone.utc)).strftime("%Y-%m-%dT%H:%M:%SZ")
    own = pages.select(F.col(id_col).cast("string").alias("id"), F.col(id_col).alias("nr"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.encode(F.col(html_col), "UTF-8"), F.lit(b"")).alias("payload"))
    own = own.withColumn("digest", F.sha2("payload", 256)).withColumn("bytes", F.octet_length("payload").cast("bigint"))
    twice = saved(own.where(F.col("bytes") >= least).select("digest", "nr").groupBy("digest").agg(F.min("nr").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null"))
    most = (twice.agg(F.sum("n")).first()[0] or 0) / (2 * partitions(pages.sparkSession))
    hot, cold = (twice.where(test).select(F.col("digest").alias(f"_{k}"), F.col("first").alias(f"first_{k}")) for k, test in (("hot", F.col("n") > most), ("cold", F.col("n") <= most)))
    long = F.when(F.col("bytes") >= least, F.col("digest"))
    rows = own.join(F.broadcast(hot), long == F.col("_hot"), "left")
    # pages that can't match any more get keys of their own, so that they spread
    alone = F.concat(F.lit("~"), F.xxhash64("nr", "url").cast("string"))
    known = F.col("first_hot").isNotNull()
    rows = rows.withColumn("_key", F.when(known, alone).otherwise(F.coalesce(long, alone))).withColumn("payload", F.when(known & ~F.col("nr").eqNullSafe(F.col("first_hot")), None).otherwise(F.col("payload")))
    rows = rows.join(cold, F.col("_key") == F.col("_cold"), "left").withColumn("first", F.coalesce("first_hot", "first_cold"))
    revisit = F.col("first").isNotNull() & ~F.col("nr").eqNullSafe(F.col("first"))
    headers = {
        "WARC-Type": F.when(revisit, "revisit").otherwise("response"),
        "WARC-Record-ID": F.coalesce(F.concat(F.lit("<urn:page:"), "id", F.lit(">")), F.concat(F.lit("<urn:uuid:"), F.uuid(), F.lit(">"))),
        "WARC-Date": F.lit(stamp),
        "WARC-Target-URI": F.regexp_replace("url", r"[\x00-\x20]+", "%20"),
        "WARC-Refers-To": F.when(revisit, F.concat(F.lit("<urn:page:"), F.col("first").cast("string"), F.lit(">"))),
        "WARC-Profile": F.when(revisit, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
        "WARC-Payload-Digest": F.concat(F.lit("sha256:"), "digest"),
        "Content-Type": F.when(~revisit, "application/http;msgtype=response"),
        "X-Payload-Length": F.col("bytes").cast("string"),
    }
    table = F.map_from_entries(F.array_compact(F.array(*[F.when(v.isNotNull(), F.struct(F.lit(k).alias("key"), v.alias("value"))) for k, v in headers.items()])))
    return rows.select(table.alias("headers"), F.when(~revisit, F.col("payload")).alias("payload"))


def write_archives(records: DataFrame, path: str, mode: str = "append") -> None:
    register(records.sparkSession)
    records.write.format("warc").mode(mode).option("path", path).save()


def read_archives(spark: SparkSession, path: str, *, payload: bool = True, headers: dict[str, str] | None = None) -> DataFrame:
    """The records; with `headers` only those that have these values."""
    register(spark)
    return spark.read.format("warc").options(payload=str(payload).lower(), **{f"header.{k}": v for k, v in (headers or {}).items()}).load(path)


def page_of(column: str) -> Column:
    return F.regexp_extract(F.col(column), r"<urn:page:(-?\d+)>", 1)


def archived_pages(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes a record for each page and reads the archives back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Responses are read with their payloads, which give bytes and digest; revisits by their headers alone. The
    record type is pushed down, so either pass skips the other's blocks.
    """
    spark = pages.sparkSession
    path = fresh_path(spark, "warc")
    write_archives(page_records(pages, id_col=id_col, url_col=url_col, html_col=html_col), path)
    body = F.coalesce("payload", F.lit(b""))
    full = read_archives(spark, path).where("record_type = 'response'").select("record_id", "record_type", "refers_to", F.octet_length(body).cast("bigint").alias("payload_bytes"), F.sha2(body, 256).alias("payload_digest"))
    again = read_archives(spark, path, payload=False).where("record_type = 'revisit'").select("record_id", "record_type", "refers_to", F.col("payload_length").alias("payload_bytes"), F.regexp_replace("payload_digest", "^sha256:", "").alias("payload_digest"))
    out = full.unionByName(again)
    return out.select(page_of("record_id").try_cast("bigint").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page_of("refers_to").try_cast("bigint").alias("refers_to"))
