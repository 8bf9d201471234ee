"""WARC archives as a Spark data source: `spark.read.format("warc")` and `df.write.format("warc")`.

Reading plans partitions from the file listing (small files together, a file is never cut), takes record-type and
header predicates from Spark, and parses a record's headers before anything else. A record that the predicates turn
down is passed over by its Content-Length; a payload is read and decoded only where the wanted columns hold it.

Writing makes files of whole records, rolled at a size, under names of their own per task attempt. The files of the
attempts that count are listed in a manifest that the driver writes last; readers of a folder with manifests see no
others, so files of lost executors never count.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition,
    IsNotNull, IsNull, LessThan, LessThanOrEqual, Not, StringContains, StringEndsWith, StringStartsWith, WriterCommitMessage,
)
from pyspark.sql.types import StructType

from .common import blank_if_null, located, stored

# Columns that a record's headers alone give: by header name. Predicates on these are pushed down.
HEADERS = {
    "record_id": "warc-record-id", "record_type": "warc-type", "target_uri": "warc-target-uri", "date": "warc-date",
    "content_type": "content-type", "refers_to": "warc-refers-to", "payload_digest": "warc-payload-digest",
}
SCHEMA = ", ".join(f"{c} string" for c in HEADERS) + ", headers map<string,string>, payload_bytes long, payload binary"
KINDS = {"headers": pa.map_(pa.string(), pa.string()), "payload_bytes": pa.int64(), "payload": pa.binary()}
LONGEST_LINE = 1 << 20
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _place(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI; a path without a scheme is local."""
    return fs.FileSystem.from_uri(path.replace("file:///", "/", 1) if path.startswith("file:///") else path)


def _hex_digest(value: str | None) -> str | None:
    """`sha1:` digests, base 32 by custom, as bare lower-case hex; others as they are."""
    kind, _, digits = (value or "").partition(":")
    if kind.lower() != "sha1":
        return value
    return base64.b32decode(digits.upper()).hex() if len(digits) == 32 else digits.lower()


def _bare_id(value: str | None) -> str | None:
    return value.strip().removeprefix("<").removesuffix(">") if value is not None else None


CLEANED: dict[str, Callable] = {"record_id": _bare_id, "refers_to": _bare_id, "payload_digest": _hex_digest}


def predicate(wanted: Filter) -> tuple[str, Callable[[str | None], bool]] | None:
    """Column and test of a filter that headers alone decide; None for any other."""
    if isinstance(wanted, Not):
        inner = predicate(wanted.child)
        # NULL is neither equal nor different, so only tests that say yes or no to NULL turn round.
        if inner is None or not isinstance(wanted.child, (EqualNullSafe, IsNull, IsNotNull)):
            return (inner[0], lambda v, t=inner[1]: v is not None and not t(v)) if inner else None
        return inner[0], lambda v, t=inner[1]: not t(v)
    name = wanted.attribute[0] if len(getattr(wanted, "attribute", ())) == 1 else None
    if name not in HEADERS:
        return None
    x = getattr(wanted, "value", None)
    tests = {
        EqualTo: lambda v: v == x, EqualNullSafe: lambda v: v == x, In: lambda v: v in x, GreaterThan: lambda v: v > x, GreaterThanOrEqual: lambda v: v >= x,
        LessThan: lambda v: v < x, LessThanOrEqual: lambda v: v <= x, StringStartsWith: lambda v: v.startswith(x), StringEndsWith: lambda v: v.endswith(x),
        StringContains: lambda v: x in v, IsNull: lambda v: v is None, IsNotNull: lambda v: v is not None,
    }
    if type(wanted) not in tests:
        return None
    test = tests[type(wanted)]
    return name, test if isinstance(wanted, (EqualNullSafe, IsNull)) else lambda v: v is not None and bool(test(v))


@dataclass
class WarcFiles(InputPartition):
    """Files that one task reads."""

    paths: list[str]


@dataclass
class Written(WriterCommitMessage):
    """Files that one task wrote."""

    paths: list[str]


class WarcDataSource(DataSource):
    """Options: `path`; reading `maxPartitionBytes`, `pushdown` (see `read`); writing `maxFileBytes`, `compression` (`none` or `gzip`), `date`."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        kind = SelectiveReader if self.options.get("pushdown") == "true" else WarcReader
        return kind(dict(self.options), schema.names)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return WarcWriter(dict(self.options), overwrite)


class WarcReader(DataSourceReader):
    """Record columns that the schema names; without `payload` no payload is read."""

    def __init__(self, options: dict, columns: list[str]):
        unknown = set(columns) - set(HEADERS) - set(KINDS)
        if unknown:
            raise ValueError(f"no such columns of a WARC record: {sorted(unknown)}")
        self.path, self.most, self.columns = options["path"], int(options.get("maxpartitionbytes", 128 << 20)), columns
        self.wanted: list[Filter] = []

    def partitions(self) -> list[InputPartition]:
        """Files in order of name, as many together as stay under the size; one empty partition where there are none."""
        where, folder = _place(self.path)
        found = where.get_file_info(folder)
        listed = [found] if found.is_file else [f for f in where.get_file_info(fs.FileSelector(folder)) if f.is_file] if found.type == fs.FileType.Directory else []
        manifests = [f.path for f in listed if f.base_name.startswith("_manifest-")]
        if manifests:
            kept = {name for m in manifests for name in json.loads(where.open_input_stream(m).read())}
            listed = [f for f in listed if f.base_name in kept]
        files = sorted((f.path, f.size or 0) for f in listed if f.base_name.endswith((".warc", ".warc.gz")))
        parts: list[list[str]] = [[]]
        held = 0
        for path, size in files:
            if parts[-1] and held + size > self.most:
                parts.append([])
                held = 0
            parts[-1].append(path)
            held += size
        return [WarcFiles(p) for p in parts]

    def read(self, partition: WarcFiles) -> Iterator[pa.RecordBatch]:
        tests = [predicate(f) for f in self.wanted]
        where, _ = _place(self.path)
        rows: list[tuple] = []
        held = 0
        for path in partition.paths:
            with where.open_input_file(path) as raw:
                stream = io.BufferedReader(raw, 1 << 20)
                if path.endswith(".gz"):
                    # Every record is a member of its own; together they read as one stream.
                    stream = io.BufferedReader(gzip.GzipFile(fileobj=stream), 1 << 20)
                for row in records(stream, self.columns, tests, path):
                    rows.append(row)
                    held += len(row[-1] or b"")
                    if len(rows) >= 1000 or held >= 16 << 20:
                        yield self._batch(rows)
                        rows, held = [], 0
        if rows:
            yield self._batch(rows)

    def _batch(self, rows: list[tuple]) -> pa.RecordBatch:
        # The last item of a row is its payload, for counting; columns come before it.
        columns = [pa.array(c, KINDS.get(n, pa.string())) for n, c in zip(self.columns, zip(*rows))]
        return pa.RecordBatch.from_arrays(columns, self.columns)


class SelectiveReader(WarcReader):
    """A reader that takes over every predicate that headers decide."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            if predicate(f) is None:
                yield f
            else:
                self.wanted.append(f)


def _line(stream: io.BufferedReader, path: str) -> bytes:
    line = stream.readline(LONGEST_LINE)
    if len(line) == LONGEST_LINE:
        raise ValueError(f"{path}: a header line of over {LONGEST_LINE} bytes")
    return line


def _fields(stream: io.BufferedReader, path: str) -> tuple[list[tuple[str, str]], int]:
    """Header fields up to the blank line, and the bytes they took."""
    out: list[tuple[str, str]] = []
    taken = 0
    while line := _line(stream, path):
        taken += len(line)
        text = line.decode("utf-8", "replace").rstrip("\r\n")
        if not text:
            break
        if text[0] in " \t" and out:
            out[-1] = (out[-1][0], f"{out[-1][1]} {text.strip()}")
        else:
            name, _, value = text.partition(":")
            out.append((name.strip(), value.strip()))
    return out, taken


def records(stream: io.BufferedReader, columns: list[str], tests: list[tuple[str, Callable]], path: str) -> Iterator[tuple]:
    """The wanted columns of each record that passes all tests, and its payload once more where that is read."""
    inside = {"payload", "payload_bytes"} & set(columns)
    while line := _line(stream, path):
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"{path}: a record starts with {line[:40]!r}")
        fields, _ = _fields(stream, path)
        named = {name.lower(): value for name, value in fields}
        length = int(named["content-length"])
        value = {c: CLEANED.get(c, lambda v: v)(named.get(h)) for c, h in HEADERS.items()}
        if not all(test(value[c]) for c, test in tests):
            _pass_over(stream, length, path)
            continue
        payload = None
        if inside:
            size = length
            if (value["content_type"] or "").startswith("application/http") and length:
                head, taken = _fields(stream, path)
                size = length - taken
                # A revisit keeps the answer's head only, which tells the size of what it leaves out.
                told = {name.lower(): v for name, v in head}.get("content-length", "")
                value["payload_bytes"] = int(told) if value["record_type"] == "revisit" and told.isdigit() else size
            else:
                value["payload_bytes"] = size
            if "payload" in inside:
                payload = stream.read(size)
                if len(payload) < size:
                    raise ValueError(f"{path}: the last record is cut short")
            else:
                _pass_over(stream, size, path)
        else:
            _pass_over(stream, length, path)
        value["payload"], value["headers"] = payload, fields
        yield *(value[c] for c in columns), payload


def _pass_over(stream: io.BufferedReader, n: int, path: str) -> None:
    """Go on by `n` bytes without reading them; the last of them must be there."""
    if n:
        stream.seek(n - 1, io.SEEK_CUR)
        if not stream.read(1):
            raise ValueError(f"{path}: the last record is cut short")


class WarcWriter(DataSourceArrowWriter):
    """Rows with `record_id`, `record_type`, `payload`, and any of `target_uri`, `date`, `refers_to`, `payload_bytes`, `payload_digest` (hex SHA-1)."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        self.most, self.date = int(options.get("maxfilebytes", 1 << 30)), options.get("date", "1970-01-01T00:00:00Z")
        self.gz = options.get("compression", "none") == "gzip"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        where, folder = _place(self.path)
        where.create_dir(folder, recursive=True)
        names: list[str] = []
        out = None
        try:
            for batch in iterator:
                for row in _rows(batch):
                    if out is None or out.tell() >= self.most:
                        if out is not None:
                            out.close()
                        names.append(f"part-{uuid.uuid4().hex}.warc{'.gz' if self.gz else ''}")
                        out = where.open_output_stream(f"{folder}/{names[-1]}", compression=None)
                    record = self.record(row)
                    out.write(gzip.compress(record, 6, mtime=0) if self.gz else record)
        finally:
            if out is not None:
                out.close()
        return Written(names)

    def record(self, row: dict) -> bytes:
        """One record: its headers, an HTTP head and, unless it is a revisit, the payload."""
        revisit, payload = row["record_type"] == "revisit", row.get("payload") or b""
        size = row.get("payload_bytes") if row.get("payload_bytes") is not None else len(payload)
        head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {size}\r\n\r\n".encode()
        block = head if revisit else head + payload
        digest = bytes.fromhex(row["payload_digest"]) if row.get("payload_digest") else hashlib.sha1(payload).digest()
        fields = [
            ("WARC-Type", row["record_type"]), ("WARC-Record-ID", f"<{row['record_id']}>"), ("WARC-Date", row.get("date") or self.date),
            ("WARC-Target-URI", row.get("target_uri")), ("WARC-Payload-Digest", f"sha1:{base64.b32encode(digest).decode()}"),
            ("WARC-Profile", IDENTICAL if revisit else None), ("WARC-Refers-To", f"<{row['refers_to']}>" if row.get("refers_to") else None),
            ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block))),
        ]
        # A line end in a value would start a header of its own.
        lines = [f"{k}: {v.replace(chr(13), '%0D').replace(chr(10), '%0A')}" for k, v in fields if v is not None]
        return "\r\n".join(["WARC/1.1", *lines, "", ""]).encode() + block + b"\r\n\r\n"

    def commit(self, messages: list[Written | None]) -> None:
        where, folder = _place(self.path)
        where.create_dir(folder, recursive=True)
        earlier = [f for f in where.get_file_info(fs.FileSelector(folder)) if f.is_file] if self.overwrite else []
        names = [n for m in messages if m is not None for n in m.paths]
        with where.open_output_stream(f"{folder}/_manifest-{uuid.uuid4().hex}", compression=None) as out:
            out.write(json.dumps(names).encode())
        for f in earlier:
            if f.base_name not in names:
                where.delete_file(f.path)

    def abort(self, messages: list[Written | None]) -> None:
        where, folder = _place(self.path)
        for name in (n for m in messages if m is not None for n in m.paths):
            where.delete_file(f"{folder}/{name}")


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    names = batch.schema.names
    for i in range(batch.num_rows):
        yield {n: batch.column(k)[i].as_py() for k, n in enumerate(names)}


def register(spark: SparkSession) -> SparkSession:
    """Make the `warc` format known; Spark hands predicates to Python sources only where that is switched on."""
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark


def read(spark: SparkSession, path: str, columns: str = SCHEMA, where: str | Column | None = None) -> DataFrame:
    """Records of a file or folder that meet `where`; `columns` (DDL) names the columns, and so what is parsed and decoded.

    What headers decide of `where` is pushed down. Spark keeps the predicates that a Python source took with the source,
    not with the scan, so two branches of one frame would read by the predicates of the last one planned. Therefore only
    `where` reaches the source: every call loads a source of its own, and the observed metric, which Spark pushes no
    predicate through, holds back those that are put on the frame later.
    """
    source = register(spark).read.format("warc").schema(columns)
    if where is None:
        return source.load(path)
    found = source.option("pushdown", "true").load(path).where(where)
    return found.observe(f"warc-{uuid.uuid4().hex}", F.count(F.lit(1)).alias("records"))


def _record_id(key: Column, file: Column, row: Column) -> Column:
    """A page's key and, since keys may repeat, where its row lies."""
    return F.concat(F.lit("urn:page:"), F.coalesce(F.url_encode(key.cast("string")), F.lit("")), F.lit(":"), F.lower(F.hex(F.xxhash64(file, row))))


def page_key(record_id: Column) -> Column:
    """The key in a record's identifier; NULL where the page had none."""
    return F.url_decode(F.nullif(F.split_part(record_id, F.lit(":"), F.lit(3)), F.lit("")))


def page_records(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", least: int = 1000) -> DataFrame:
    """A record per row of `pages`: record_id, record_type, target_uri, refers_to, payload_bytes, payload_digest, payload.

    The payload is the text in UTF-8; NULL is empty. Of equal payloads (by length, SHA-1 and SHA-256) of at least `least`
    bytes the row with the largest key (NULL is the least), then the last place in the table, is the response, and the
    others are revisits without payload. Every other row is a response. An empty table gives no records. Columns that
    aren't named are ignored.
    """
    rows = located(pages.select(F.col(f"`{key}`").alias("key"), F.col(f"`{url}`").cast("string").alias("target_uri"), F.col(f"`{html}`").alias("html")))
    payload = F.encode(blank_if_null("html"), "utf-8")
    rows = rows.select("key", "target_uri", "__file", "__row", payload.alias("payload"))
    rows = rows.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha1("payload"), "strong": F.sha2("payload", 256)})
    same = ["payload_bytes", "payload_digest", "strong"]
    # A payload that a third of all rows share is one row of each task, and one row beside its copies.
    last = F.max(F.struct(F.col("key").isNotNull().alias("known"), "key", "__file", "__row")).alias("last")
    shared = rows.where(F.col("payload_bytes") >= least).groupBy(*same).agg(last, F.count(F.lit(1)).alias("copies")).where("copies > 1")
    shared = stored(shared.select(*same, F.col("last.key").alias("l_key"), F.col("last.__file").alias("l_file"), F.col("last.__row").alias("l_row")), "warc-shared")
    joined = rows.join(shared, same, "left")
    revisit = F.col("l_file").isNotNull() & ~((F.col("__file") == F.col("l_file")) & (F.col("__row") == F.col("l_row")))
    return joined.select(
        _record_id(F.col("key"), F.col("__file"), F.col("__row")).alias("record_id"), F.when(revisit, "revisit").otherwise("response").alias("record_type"), "target_uri",
        F.when(revisit, _record_id(F.col("l_key"), F.col("l_file"), F.col("l_row"))).alias("refers_to"), "payload_bytes", "payload_digest",
        F.when(~revisit, F.col("payload")).alias("payload"),
    )


def write(found: DataFrame, path: str, mode: str = "append", **options: str) -> None:
    """Write records to a folder."""
    register(found.sparkSession)
    found.write.format("warc").options(**options).mode(mode).save(path)
