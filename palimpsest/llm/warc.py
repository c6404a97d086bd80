"""WARC archives as a Spark data source, and writing a table of pages as archives and reading it back."""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timezone

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull,
                                    StringStartsWith, WriterCommitMessage)

from palimpsest.llm.common import folder, heavy, join_unique, materialize, registry, table

QUERIES, SQL, query = registry()

#: Payloads below this many bytes are stored whole even if they repeat.
LEAST_BYTES = 0
#: Compressed bytes of archives that one read task takes (a larger file is a task of its own).
TASK_BYTES = 32 << 20
#: A new archive begins after so many bytes.
FILE_BYTES = 64 << 20

COLUMNS = ("record_id string, record_type string, target_uri string, date string, refers_to string, content_type string, "
           "content_length long, payload_length long, payload_digest string, payload binary")
#: Column by WARC header.
HEADERS = {"warc-record-id": "record_id", "warc-type": "record_type", "warc-target-uri": "target_uri", "warc-date": "date",
           "warc-refers-to": "refers_to", "content-type": "content_type"}
_URN = "urn:x-page:"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()


def _open_fs(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI or a plain path."""
    if re.match(r"file:/[^/]", path):
        path = "file://" + path[5:]
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


class _Members:
    """Bytes of an archive, plain or with one gzip member a record, that can be read or passed over."""

    def __init__(self, stream, packed: bool):
        self.stream, self.packed = stream, packed
        self.unpack = zlib.decompressobj(31) if packed else None
        self.held, self.pending, self.done = bytearray(), b"", False

    def _more(self) -> bool:
        raw = self.pending or self.stream.read(1 << 16)
        self.pending = b""
        if not raw:
            self.done = True
            return False
        if not self.packed:
            self.held += raw
            return True
        self.held += self.unpack.decompress(raw, 1 << 20)
        if self.unpack.eof:
            self.pending, self.unpack = self.unpack.unused_data, zlib.decompressobj(31)
        else:
            self.pending = self.unpack.unconsumed_tail
        return True

    def until(self, mark: bytes) -> bytes | None:
        """What comes up to ``mark``, which is passed over; None at the end."""
        start = 0
        while (at := self.held.find(mark, start)) < 0:
            start = max(0, len(self.held) - len(mark) + 1)
            if not self._more():
                return None
        out = bytes(self.held[:at])
        del self.held[: at + len(mark)]
        return out

    def take(self, n: int) -> bytes:
        while len(self.held) < n and self._more():
            pass
        if len(self.held) < n:
            raise EOFError("an archive ends inside a record")
        out = bytes(self.held[:n])
        del self.held[:n]
        return out

    def skip(self, n: int) -> None:
        """Pass over ``n`` bytes: a plain archive is not even read there."""
        if n > len(self.held) and not self.packed and not self.pending:
            self.stream.seek(n - len(self.held), 1)
            self.held.clear()
            return
        while n > 0:
            if not self.held and not self._more():
                raise EOFError("an archive ends inside a record")
            gone = min(n, len(self.held))
            del self.held[:gone]
            n -= gone

    def blank(self) -> bool:
        """Pass over line ends between records; False at the end."""
        while True:
            while self.held[:1] in (b"\r", b"\n"):
                del self.held[:1]
            if self.held:
                return True
            if not self._more():
                return False


def _fields(head: bytes) -> dict[str, str]:
    out, last = {}, ""
    for line in head.decode("utf-8", "replace").split("\r\n"):
        if line[:1] in (" ", "\t") and last:
            out[last] += " " + line.strip()
        elif ":" in line:
            last, _, value = line.partition(":")
            last = last.strip().lower()
            out[last] = value.strip()
    return out


def records(members: _Members, wanted=lambda row: True, payloads: bool = True) -> Iterator[dict]:
    """Records of an archive as rows.  Headers come first; the body of an unwanted record is passed over undecoded."""
    while members.blank():
        head = members.until(b"\r\n\r\n")
        if head is None:
            raise EOFError("an archive ends inside a header")
        version, _, rest = head.partition(b"\r\n")
        if not version.startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        fields = _fields(rest)
        length = int(fields.get("content-length", "0"))
        row = {c: fields.get(h) for h, c in HEADERS.items()} | {"content_length": length}
        for c in ("record_id", "refers_to"):
            row[c] = row[c].strip("<>") if row[c] else None
        stated = fields.get("warc-payload-digest")
        row["payload_digest"] = stated.rpartition(":")[2] if stated else None
        row["payload_length"] = row["payload"] = None
        if not wanted(row):
            members.skip(length)
            continue
        if (row["content_type"] or "").startswith("application/http"):
            block = members.take(length) if row["record_type"] == "revisit" or payloads else None
            if block is None:
                members.skip(length)
            else:
                http, _, body = block.partition(b"\r\n\r\n")
                size = _fields(http.partition(b"\r\n")[2]).get("content-length")
                row["payload_length"] = int(size) if row["record_type"] == "revisit" and size else len(body)
                row["payload"] = None if row["record_type"] == "revisit" else body
        elif payloads:
            row["payload"] = members.take(length)
            row["payload_length"] = length
        else:
            members.skip(length)
        yield row


@dataclass
class Archives(InputPartition):
    """Archives that one task reads."""

    paths: tuple[str, ...]

    def __init__(self, paths):
        self.paths = tuple(paths)
        super().__init__(self.paths)


class WarcReader(DataSourceReader):
    def __init__(self, path: str, names: list[str], schema: pa.Schema):
        self.path, self.names, self.schema, self.tests = path, names, schema, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """Take equality, membership, prefix and presence tests on header columns; hand back the rest."""
        known = {*HEADERS.values(), "payload_digest"}
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if name in known and isinstance(f, EqualTo):
                self.tests.append((name, "in", (f.value,)))
            elif name in known and isinstance(f, In):
                self.tests.append((name, "in", tuple(f.value)))
            elif name in known and isinstance(f, StringStartsWith):
                self.tests.append((name, "starts", f.value))
            elif name in known and isinstance(f, IsNotNull):
                self.tests.append((name, "there", None))
            else:
                yield f

    def _wanted(self, row: dict) -> bool:
        for name, kind, value in self.tests:
            x = row[name]
            if x is None or kind == "in" and x not in value or kind == "starts" and not x.startswith(value):
                return False
        return True

    def partitions(self) -> list[Archives]:
        system, path = _open_fs(self.path)
        found = system.get_file_info(fs.FileSelector(path, recursive=True)) if system.get_file_info(path).type == fs.FileType.Directory else [system.get_file_info(path)]
        out, held, size = [], [], 0
        for info in sorted((i for i in found if i.is_file and re.search(r"\.warc(\.gz)?$", i.path)), key=lambda i: i.path):
            if held and size + info.size > TASK_BYTES:
                out.append(Archives(held))
                held, size = [], 0
            held.append(info.path)
            size += info.size
        return [*out, Archives(held)]

    def read(self, partition: Archives) -> Iterator[pa.RecordBatch]:
        system, _ = _open_fs(self.path)
        rows, size = [], 0
        for path in partition.paths:
            with system.open_input_file(path) as stream:
                for row in records(_Members(stream, path.endswith(".gz")), self._wanted, "payload" in self.names or "payload_length" in self.names):
                    rows.append({c: row[c] for c in self.names})
                    size += 200 + len(row["payload"] or b"")
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, self.schema)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, self.schema)


@dataclass
class Written(WriterCommitMessage):
    paths: list[str]


class WarcWriter(DataSourceArrowWriter):
    """Writes rows ``record_id, record_type, target_uri, refers_to, payload_length, payload_digest, payload`` as archives."""

    def __init__(self, path: str, packed: bool, names: list[str]):
        self.path, self.packed, self.names = path, packed, names

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        context = TaskContext.get()
        system, path = _open_fs(self.path)
        system.create_dir(path, recursive=True)
        date = datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
        name = f"{path}/part-{context.partitionId():05d}-{context.taskAttemptId()}"
        done: list[str] = []
        out, size = None, 0
        try:
            for batch in iterator:
                for row in batch.to_pylist():
                    if out is None or size > FILE_BYTES:
                        if out is not None:
                            out.close()
                        done.append(f"{name}-{len(done):04d}.warc{'.gz' if self.packed else ''}")
                        out, size = system.open_output_stream(done[-1], compression=None), 0
                    raw = record(row, date)
                    if self.packed:
                        press = zlib.compressobj(5, zlib.DEFLATED, 31)
                        raw = press.compress(raw) + press.flush()
                    out.write(raw)
                    size += len(raw)
        finally:
            if out is not None:
                out.close()
        return Written(done)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        """Remove what attempts have left that did not end well."""
        system, path = _open_fs(self.path)
        kept = {p for m in messages if m is not None for p in m.paths}
        if system.get_file_info(path).type == fs.FileType.Directory:
            for info in system.get_file_info(fs.FileSelector(path)):
                if info.is_file and info.path not in kept:
                    system.delete_file(info.path)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        system, _ = _open_fs(self.path)
        for m in messages:
            for p in m.paths if m is not None else ():
                system.delete_file(p)


def record(row: dict, date: str) -> bytes:
    """The bytes of one record: an HTTP response, or a revisit that has its headers only."""
    payload = row["payload"] or b""
    revisit = row["record_type"] == "revisit"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_length']}\r\n\r\n".encode()
    block = http if revisit else http + payload
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", row["target_uri"] or "")
    lines = ["WARC/1.1", f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: <{row['record_id']}>", f"WARC-Date: {date}"]
    if uri:
        lines.append(f"WARC-Target-URI: {uri}")
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{row['refers_to']}>"]
    lines += [f"WARC-Payload-Digest: sha1:{row['payload_digest']}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class WarcDataSource(DataSource):
    """``spark.read.format("warc").load(path)`` and ``df.write.format("warc").mode("append").save(path)``.

    Reading: a schema with some of :data:`COLUMNS` reads only these; without
    ``payload`` and ``payload_length`` no body is read.  Files ending in
    ``.warc`` or ``.warc.gz`` below the path are dealt to tasks by size.
    """

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return COLUMNS

    def reader(self, schema) -> WarcReader:
        from pyspark.sql.pandas.types import to_arrow_schema

        return WarcReader(self.options["path"], schema.names, to_arrow_schema(schema))

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"], self.options.get("compression", "gzip") == "gzip", schema.names)


def register(spark: SparkSession) -> None:
    """Make the format known to the session and let it have filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


def read_warc(spark: SparkSession, path: str, columns: str = COLUMNS) -> DataFrame:
    """Archives below ``path``; filters on header columns and the choice of ``columns`` reach the source."""
    register(spark)
    return spark.read.format("warc").schema(columns).load(path)


def archive_rows(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", least: int = LEAST_BYTES) -> DataFrame:
    """The records for ``pages``: of equal payloads of at least ``least`` bytes that with the largest key is the response.

    A null html is an empty payload.  Rows that repeat payload and key are all
    responses, or revisit the same other record.  A null key is the smallest.
    """
    body = F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8")
    rows = pages.select(F.col(key).alias("_key"), F.col(url).alias("_url"), body.alias("payload"))
    rows = rows.withColumn("_same", F.sha2("payload", 256)).withColumn("payload_length", F.octet_length("payload").cast("long"))
    slim = materialize(rows.where(F.col("payload_length") >= least).groupBy("_same", "_key").agg(F.count(F.lit(1)).alias("_n")), "warc-keys")
    sets = slim.groupBy("_same").agg(F.sum("_n").alias("_n"), F.max("_key").alias("_first"))
    total = slim.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    sets = materialize(sets.where("_n > 1"), "warc-sets")
    marked = join_unique(rows, sets, ["_same"], heavy(sets, "_n", total))
    ident = F.concat(F.lit(_URN), F.coalesce(F.col("_key").cast("string"), F.lit("null")))
    out = marked.withColumn("_other", F.col("_n").isNotNull() & ~F.col("_key").eqNullSafe(F.col("_first")))
    revisit = F.col("_other")
    return out.select(
        ident.alias("record_id"), F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.col("_url").alias("target_uri"),
        F.when(revisit, F.concat(F.lit(_URN), F.coalesce(F.col("_first").cast("string"), F.lit("null")))).alias("refers_to"), "payload_length",
        base32_sha1(F.col("payload")).alias("payload_digest"), F.when(~revisit, F.col("payload")).alias("payload"))


def base32_sha1(payload):
    """Bare upper-case base32 of the SHA-1, five hexadecimal digits at a time."""
    letters = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    bits = F.sha1(payload)

    def four(i):
        n = F.conv(F.substring(bits, i * 5 + 1, 5), 16, 10).cast("long")
        return F.concat(*[F.substring(letters, (F.shiftright(n, s).bitwiseAND(31) + 1).cast("int"), F.lit(1)) for s in (15, 10, 5, 0)])

    return F.concat(*[four(i) for i in range(8)])


def write_warc(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", html: str = "html", least: int = LEAST_BYTES,
               compression: str = "gzip") -> None:
    """Write ``pages`` as archives below ``path``, a record a row; null html as an empty payload, equal payloads once."""
    register(pages.sparkSession)
    archive_rows(pages, key, url, html, least).write.format("warc").option("compression", compression).mode("append").save(path)


def page_digests(archives: DataFrame) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` of archives that :func:`write_warc` wrote.

    Digest and length of a response are those of the payload as read; a
    revisit has them in its headers.
    """
    def page(c: str):
        return F.regexp_extract(c, rf"^{_URN}(-?[0-9]+)$", 1).try_cast("long")

    return archives.select(
        page("record_id").alias("page_id"), F.col("payload_length").alias("payload_bytes"),
        F.when(F.col("payload").isNull(), F.col("payload_digest")).otherwise(base32_sha1(F.col("payload"))).alias("payload_digest"),
        "record_type", page("refers_to").alias("refers_to"))


_B32 = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, {5 * i + 1}, 5))::BIGINT >> {s}) & 31)::BIGINT + 1, 1)"
                   for i in range(8) for s in (15, 10, 5, 0))


@query("op3_warc", f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS b, sha1(coalesce(html, '')) AS h FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY b) AS first FROM p)
SELECT page_id, strlen(b)::BIGINT AS payload_bytes, {_B32} AS payload_digest, CASE WHEN page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to FROM m""")
def warc(spark, sf):
    path = folder(spark, "warc")
    write_warc(table(spark, sf, "pages"), path)
    return page_digests(read_warc(spark, path, "record_id string, record_type string, refers_to string, payload_length long, payload_digest string, payload binary"))
