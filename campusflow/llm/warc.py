"""WARC archives as a Spark data source: ``spark.read.format("warc")`` and ``df.write.format("warc")``.

Archives are ``*.warc.gz`` files with a gzip member per record (or for a few); uncompressed ``*.warc`` files and
damaged records are errors, other files are not read.  The reader cuts files into byte ranges; a
task looks for gzip magic from the start of its range, takes a member as real once it decodes to a WARC header,
and owns the records that start inside its range (the last may end beyond it).  The writer's tasks write under
``_temporary`` and only the files of tasks that the job committed are moved into place, so that lost executors
and repeated tasks leave no half or double records.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import uuid
import zlib
from urllib.parse import quote

from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from campusflow.llm.shared import persisted

# Fixed values of the format.
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
MAGIC = b"\x1f\x8b\x08"

SCHEMA = ("record_id string, record_type string, target_uri string, refers_to string, "
          "payload_digest string, payload_bytes long, payload binary")
#: Bytes of a range, and after which a task begins another file.
SPLIT_BYTES, FILE_BYTES = 64 << 20, 1 << 30
READ_BYTES = 1 << 16


def _filesystem(path: str):
    """(file system, path on it) of a URI or an absolute path."""
    if path.startswith("file:"):
        path = "/" + path[len("file:"):].lstrip("/")
    return pafs.FileSystem.from_uri(path)


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def payload_digest(payload: Column) -> Column:
    """Bare upper-case base32 SHA-1: each five hex digits make four base32 digits."""
    hexed = F.sha1(payload)
    digits = [F.lpad(F.conv(F.substring(hexed, i, 5), 16, 32), 4, "0") for i in range(1, 41, 5)]
    return F.translate(F.upper(F.concat(*digits)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32)


def encode_record(row, date: str) -> bytes:
    """One gzip member: a response with its payload, or a revisit, whose block ends after the HTTP header."""
    revisit = row["record_type"] == "revisit"
    payload = b"" if revisit else bytes(row["payload"] or b"")
    block = (b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
             % row["payload_bytes"]) + payload
    headers = [("WARC-Type", row["record_type"]), ("WARC-Record-ID", f"<{row['record_id']}>"), ("WARC-Date", date),
               ("WARC-Payload-Digest", f"sha1:{row['payload_digest']}"),
               ("Content-Type", "application/http; msgtype=response")]
    if row["target_uri"] is not None:  # control characters would end the header
        headers.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f%]", lambda m: quote(m.group(), safe=""),
                                                  row["target_uri"])))
    if revisit:
        headers += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<{row['refers_to']}>")]
    headers.append(("Content-Length", str(len(block))))
    head = VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers).encode() + b"\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(head + block + b"\r\n\r\n") + packer.flush()


def _fields(lines: bytes) -> dict[str, str]:
    pairs = (line.split(":", 1) for line in lines.decode("utf-8", "replace").split("\r\n")[1:] if ":" in line)
    return {k.strip().lower(): v.strip() for k, v in pairs}


def decode_record(raw: bytes) -> tuple:
    """A row of SCHEMA from a decompressed record; raises ValueError if it is none."""
    head, cut, rest = raw.partition(b"\r\n\r\n")
    if not cut or not head.startswith(b"WARC/"):
        raise ValueError("not a WARC record")
    fields = _fields(head)
    length = int(fields.get("content-length", 0))
    block = rest[:length]
    if len(block) < length:
        raise ValueError(f"record {fields.get('warc-record-id')} is shorter than it says")
    uri, kind = fields.get("warc-target-uri"), fields.get("warc-type")
    uri = re.sub(r"%([01][0-9A-F]|20|25|7F)", lambda m: chr(int(m.group(1), 16)), uri) if uri is not None else None
    stated = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    refers = fields.get("warc-refers-to")
    http, _, payload = block.partition(b"\r\n\r\n")
    if kind == "revisit":
        size, payload = int(_fields(http).get("content-length", 0)), None
    else:
        size = len(payload)
        found = base32_sha1(payload)
        if stated and found != stated:
            raise ValueError(f"payload of {fields.get('warc-record-id')} does not match its digest")
        stated = found
    return (fields.get("warc-record-id", "").strip("<>"), kind, uri, refers.strip("<>") if refers else None,
            stated, size, payload)


def _after(raw: bytes) -> bytes:
    """What follows the first record of a decompressed member, if that is another one."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    return rest[int(_fields(head).get("content-length", 0)):].lstrip(b"\r\n")


def _member(file, offset: int, least: bytes = b"") -> tuple[bytes, int] | None:
    """(content, end) of the gzip member at ``offset``; None if none is there or it does not begin with ``least``.

    A member that begins with ``least`` and then breaks off or does not decode is damaged: that is an error.
    """
    file.seek(offset)
    unpacker, out, read, found = zlib.decompressobj(31), b"", 0, not least
    parts = []
    try:
        while not unpacker.eof:
            chunk = file.read(READ_BYTES)
            if not chunk:
                break
            read += len(chunk)
            while not found and not unpacker.eof:  # a few bytes at a time, so that what comes before a fault is seen
                step = unpacker.decompress(chunk, len(least) - len(out))
                out, chunk = out + step, unpacker.unconsumed_tail
                if not least.startswith(out):
                    return None
                found = out == least
                if not step and not chunk:
                    break
            if found and not unpacker.eof:
                parts.append(unpacker.decompress(chunk))
    except zlib.error as fault:
        if found and least:
            raise ValueError(f"damaged record at {offset}: {fault}") from fault
        return None
    if not unpacker.eof:
        if found and least:
            raise ValueError(f"damaged record at {offset}: the member breaks off")
        return None
    return (out + b"".join(parts), offset + read - len(unpacker.unused_data)) if found else None


def _next_magic(file, offset: int, end: int) -> int | None:
    """The first gzip magic that starts in [offset, end)."""
    while offset < end:
        file.seek(offset)
        chunk = file.read(min(1 << 20, end - offset) + len(MAGIC) - 1)
        at = chunk.find(MAGIC)
        if at >= 0:
            return offset + at if offset + at < end else None
        if len(chunk) < len(MAGIC):
            return None
        offset += len(chunk) - len(MAGIC) + 1
    return None


def read_range(file, start: int, end: int):
    """Rows of the records that start in [start, end)."""
    offset = start
    while (offset := _next_magic(file, offset, end)) is not None:
        found = _member(file, offset, b"WARC/")
        if found is None:  # compressed bytes that look like magic
            offset += 1
            continue
        content, offset = found
        while content:  # a member may hold several records
            yield decode_record(content)
            content = _after(content)


class _Range(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.root, self.split = options["path"], int(options.get("splitbytes", SPLIT_BYTES))

    def partitions(self):
        files, root = _filesystem(self.root)
        infos = files.get_file_info(pafs.FileSelector(root))
        plain = [i.path for i in infos if i.is_file and i.path.endswith(".warc")]
        if plain:
            raise ValueError(f"only archives with a gzip member per record are read: {plain[0]}")
        infos = sorted((i for i in infos if i.is_file and i.path.endswith(".warc.gz")), key=lambda i: i.path)
        return [_Range(i.path, low, min(low + self.split, i.size))
                for i in infos for low in range(0, i.size, self.split)]

    def read(self, partition):
        if partition is None:  # no archives, no ranges
            return
        files, _ = _filesystem(self.root)
        with files.open_input_file(partition.path) as raw:
            yield from read_range(io.BufferedReader(raw, 1 << 20), partition.start, partition.end)


class _Written(WriterCommitMessage):
    def __init__(self, files: list[str]):
        self.files = files


class _Writer(DataSourceWriter):
    def __init__(self, options):
        self.root, self.date = options["path"], options.get("date", "1970-01-01T00:00:00Z")
        self.limit, self.job = int(options.get("filebytes", FILE_BYTES)), uuid.uuid4().hex

    def write(self, iterator):
        files, root = _filesystem(self.root)
        folder, written, out, size = f"{root}/_temporary/{self.job}", [], None, 0
        files.create_dir(folder, recursive=True)
        for row in iterator:
            if out is None or size >= self.limit:
                if out is not None:
                    out.close()
                name = f"{uuid.uuid4().hex}.warc.gz"
                out, size = files.open_output_stream(f"{folder}/{name}", compression=None), 0
                written.append(name)
            member = encode_record(row, self.date)
            out.write(member)
            size += len(member)
        if out is not None:
            out.close()
        return _Written(written)

    def commit(self, messages):
        files, root = _filesystem(self.root)
        files.create_dir(root, recursive=True)
        for message in messages:
            for name in message.files if message else []:
                files.move(f"{root}/_temporary/{self.job}/{name}", f"{root}/{name}")
        self._clear(files, root)

    def abort(self, messages):
        self._clear(*_filesystem(self.root))

    def _clear(self, files, root):
        if files.get_file_info(f"{root}/_temporary/{self.job}").type == pafs.FileType.Directory:
            files.delete_dir(f"{root}/_temporary/{self.job}")


class WarcDataSource(DataSource):
    """Options: path (folder), splitbytes (reader), filebytes and date (writer)."""

    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options)

    def writer(self, schema, overwrite):
        return _Writer(self.options)


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
            min_bytes: int = 0) -> DataFrame:
    """Rows of SCHEMA for pages: of equal payloads of ``min_bytes`` or more the page with the smallest id is the
    response and the others revisit it; smaller ones are all responses.

    Null payloads count as empty, null urls have no target.  Rows that repeat the smallest id are responses
    too; a row without an id revisits a numbered page with its payload if there is one.
    """
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    p = pages.select(F.col(id_col).cast("long").alias("page"), F.col(url_col).alias("target_uri"), payload.alias("payload"))
    p = p.withColumn("payload_digest", payload_digest(F.col("payload"))).withColumn(
        "payload_bytes", F.length("payload").cast("long"))
    again = persisted(p.filter(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest", "payload_bytes")
                      .agg(F.min("page").alias("first"), F.count("*").alias("n")).filter("n > 1 and first is not null")
                      .select(F.col("payload_digest").alias("d"), F.col("payload_bytes").alias("b"), "first"))
    joined = p.join(again, (F.col("payload_digest") == F.col("d")) & (F.col("payload_bytes") == F.col("b")), "left")
    revisit = F.col("first").isNotNull() & ~F.col("page").eqNullSafe(F.col("first"))
    name = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(c.cast("string"), F.lit("")))
    return joined.select(
        name(F.col("page")).alias("record_id"), F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        "target_uri", F.when(revisit, name(F.col("first"))).alias("refers_to"), "payload_digest", "payload_bytes",
        F.when(~revisit, F.col("payload")).alias("payload"))


def write_warc(df: DataFrame, path: str, **options) -> None:
    """Append records (rows of SCHEMA) to the archives in ``path``."""
    df.sparkSession.dataSource.register(WarcDataSource)
    df.write.format("warc").mode("append").options(**options).save(path)


def read_warc(spark: SparkSession, path: str, **options) -> DataFrame:
    spark.dataSource.register(WarcDataSource)
    return spark.read.format("warc").options(**options).load(path)


def delete_archives(path: str) -> None:
    files, root = _filesystem(path)
    files.delete_dir(root)


def page_of(record_id: Column) -> Column:
    """The page id in a record id that ``records`` gave."""
    return F.nullif(F.substring(record_id, len("urn:page:") + 1, 20), F.lit("")).cast("long")
