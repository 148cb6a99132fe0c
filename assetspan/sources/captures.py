"""Landed captures as a Spark data source: what was fetched, with its URL, content type and time, in numbered batches.

    path/batch=000000000007/<shard>.bodies    the contents, one after the other
    path/batch=000000000007/<shard>.index     a JSON line per capture: where its content stands in the bodies, and what was said of it
    path/batch=000000000007/done.json         the shards that count; written last

A task that lands captures writes a shard, so that there are as many files as tasks and not as captures, and what a task that failed has left counts for
nothing.  A batch that is landed again under its number replaces what it was.  A reader's partition is a run of lines of one shard, and a
stream's offset the number of the last batch it has read, so that a query that starts again at an offset reads the same captures.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceStreamWriter, DataSourceWriter, InputPartition, WriterCommitMessage

FORMAT = "landed_captures"
SCHEMA = "url string, final_url string, content_type string, captured_at timestamp, content binary, batch long"
#: Bytes of contents that one partition reads at most, unless one content is larger, and that one record batch holds.
PARTITION_BYTES, BATCH_BYTES = 64 << 20, 4 << 20


@dataclass
class Shard(InputPartition):
    """Lines of a shard's index from first on, and how many."""

    batch: int
    name: str
    first: int
    lines: int


@dataclass
class Landed(WriterCommitMessage):
    """A shard that a task has written, and the lines at which a new partition of it begins."""

    name: str
    starts: list[int]
    lines: int


class _Folder:
    def __init__(self, path: str):
        self.fs, self.path = arrow_fs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (arrow_fs.LocalFileSystem(), path)

    def batch(self, number: int) -> str:
        return f"{self.path}/batch={number:012d}"

    def done(self) -> list[int]:
        """Numbers of the complete batches."""
        found = self.fs.get_file_info(arrow_fs.FileSelector(self.path, allow_not_found=True))
        numbers = [int(f.base_name[6:]) for f in found if f.base_name.startswith("batch=")]
        info = self.fs.get_file_info([f"{self.batch(n)}/done.json" for n in numbers])
        return sorted(n for n, f in zip(numbers, info) if f.type == arrow_fs.FileType.File)

    def shards(self, number: int) -> list[Shard]:
        with self.fs.open_input_stream(f"{self.batch(number)}/done.json") as f:
            landed = json.loads(f.read())
        return [Shard(number, x["name"], a, b - a) for x in landed for a, b in zip(x["starts"], [*x["starts"][1:], x["lines"]])]

    def read(self, shard: Shard) -> Iterator[pa.RecordBatch]:
        base = f"{self.batch(shard.batch)}/{shard.name}"
        with self.fs.open_input_stream(f"{base}.index") as f:
            lines = f.read().splitlines()[shard.first : shard.first + shard.lines]
        rows, size = [], 0
        with self.fs.open_input_file(f"{base}.bodies") as bodies:
            for x in map(json.loads, lines):
                content = bodies.read_at(x["length"], x["offset"]) if x["length"] is not None else None
                if content is not None and hashlib.sha256(content).hexdigest() != x["sha256"]:
                    raise ValueError(f"content of {x['url']} in {base} is damaged")
                at = None if x["captured_at"] is None else dt.datetime.fromisoformat(x["captured_at"])
                rows.append((x["url"], x["final_url"], x["content_type"], at, content, shard.batch))
                size += len(content or b"")
                if size >= BATCH_BYTES:
                    yield _rows(rows)
                    rows, size = [], 0
        if rows:
            yield _rows(rows)

    def land(self, number: int, rows: Iterator) -> Landed:
        name, starts, lines, offset, since = uuid.uuid4().hex, [0], 0, 0, 0
        self.fs.create_dir(self.batch(number), recursive=True)
        base = f"{self.batch(number)}/{name}"
        with self.fs.open_output_stream(f"{base}.bodies") as bodies, self.fs.open_output_stream(f"{base}.index") as index:
            for r in rows:
                content = None if r["content"] is None else bytes(r["content"])
                n = len(content or b"")
                if since and since + n > PARTITION_BYTES:
                    starts.append(lines)
                    since = 0
                at = None if r["captured_at"] is None else r["captured_at"].astimezone(dt.UTC).isoformat()
                said = {"url": r["url"], "final_url": r["final_url"], "content_type": r["content_type"], "captured_at": at, "offset": offset, "length": None if content is None else n, "sha256": None if content is None else hashlib.sha256(content).hexdigest()}
                index.write((json.dumps(said) + "\n").encode())
                bodies.write(content or b"")
                lines, offset, since = lines + 1, offset + n, since + n
        return Landed(name, starts if lines else [], lines)

    def finish(self, number: int, landed: list[Landed | None]) -> None:
        draft = f"{self.batch(number)}/{uuid.uuid4().hex}.draft"
        self.fs.create_dir(self.batch(number), recursive=True)
        with self.fs.open_output_stream(draft) as f:
            f.write(json.dumps([{"name": x.name, "starts": x.starts, "lines": x.lines} for x in landed if x is not None]).encode())
        self.fs.move(draft, f"{self.batch(number)}/done.json")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.string(), pa.timestamp("us", tz="UTC"), pa.binary(), pa.int64()]
    names = ["url", "final_url", "content_type", "captured_at", "content", "batch"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


class LandedCaptures(DataSource):
    """spark.read and spark.readStream.format("landed_captures"), option startingBatch for the first batch that counts; df.write with option batch,
    df.writeStream, which lands its batches under their own numbers, from 1 on."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options)

    def streamWriter(self, schema, overwrite: bool) -> DataSourceStreamWriter:
        return _StreamWriter(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path, self.first = options["path"], int(options.get("startingBatch", 0))

    def partitions(self) -> list[Shard]:
        folder = _Folder(self.path)
        return [s for n in folder.done() if n >= self.first for s in folder.shards(n)]

    def read(self, partition) -> Iterator[pa.RecordBatch]:
        return iter(()) if partition is None else _Folder(self.path).read(partition)


class _StreamReader(DataSourceStreamReader):
    def __init__(self, options):
        self.path, self.first = options["path"], int(options.get("startingBatch", 0))

    def initialOffset(self) -> dict:
        return {"batch": self.first - 1}

    def latestOffset(self) -> dict:
        return {"batch": max([self.first - 1, *_Folder(self.path).done()])}

    def partitions(self, start: dict, end: dict) -> list[Shard]:
        folder = _Folder(self.path)
        return [s for n in folder.done() if start["batch"] < n <= end["batch"] for s in folder.shards(n)]

    def read(self, partition) -> Iterator[pa.RecordBatch]:
        return iter(()) if partition is None else _Folder(self.path).read(partition)


class _Writer(DataSourceWriter):
    def __init__(self, options):
        self.path, self.number = options["path"], int(options["batch"])

    def write(self, iterator) -> Landed:
        return _Folder(self.path).land(self.number, iterator)

    def commit(self, messages) -> None:
        _Folder(self.path).finish(self.number, messages)


class _StreamWriter(DataSourceStreamWriter):
    """A shard is written before the batch's number is known, and named by it when it is committed."""

    def __init__(self, options):
        self.path = options["path"]

    def write(self, iterator) -> Landed:
        return _Folder(self.path + "/drafts").land(0, iterator)

    def commit(self, messages, batchId: int) -> None:
        folder, drafts = _Folder(self.path), _Folder(self.path + "/drafts").batch(0)
        folder.fs.create_dir(folder.batch(batchId + 1), recursive=True)
        for m in messages:
            for kind in ("bodies", "index") if m is not None else ():
                source = f"{drafts}/{m.name}.{kind}"
                if folder.fs.get_file_info(source).type == arrow_fs.FileType.File:  # else a commit that was cut short has moved it
                    folder.fs.move(source, f"{folder.batch(batchId + 1)}/{m.name}.{kind}")
        folder.finish(batchId + 1, messages)


def register(spark: SparkSession) -> SparkSession:
    spark.dataSource.register(LandedCaptures)
    return spark


def land(captures: DataFrame, path: str, batch: int) -> None:
    """Land captures (url, content, and final_url, content_type, captured_at where there are such columns) as the batch of that number."""
    kinds = {"url": "string", "final_url": "string", "content_type": "string", "captured_at": "timestamp", "content": "binary"}
    row = captures.select(*(((F.col(c) if c in captures.columns else F.lit(None)).cast(k).alias(c)) for c, k in kinds.items()))
    register(captures.sparkSession)
    row.withColumn("batch", F.lit(batch).cast("long")).write.format(FORMAT).option("path", path).option("batch", batch).mode("append").save()


def opened(captures: DataFrame) -> DataFrame:
    """Landed captures with media (application/pdf or text/html), html, and reject_reason for what is neither.

    A content that begins as a PDF document does is one whatever its type says; one that is said to be a PDF and does not is none; HTML is what is said to
    be, or begins with a tag.
    """
    head = F.ltrim(F.regexp_replace(F.decode(F.substring("content", 1, 1024), "ISO-8859-1"), r"^[\s\x0B]+", ""))
    said = F.lower(F.coalesce("content_type", F.lit("")))
    is_pdf = head.startswith("%PDF-")
    empty = F.coalesce(F.octet_length("content") == 0, F.lit(True))
    is_html = said.contains("html") | head.startswith("<")
    reason = (
        F.when(empty, "document is empty")
        .when(is_pdf, F.lit(None).cast("string"))
        .when(said.contains("pdf"), "PDF response did not contain a PDF document")
        .when(~is_html, "document format is neither PDF nor HTML")
    )
    media = F.when(empty, F.lit(None).cast("string")).when(is_pdf, "application/pdf").when(~said.contains("pdf") & is_html, "text/html")
    return captures.withColumns({"media": media, "reject_reason": reason}).withColumn("html", F.when(F.col("media") == "text/html", _as_text("content")))


def _as_text(column: str) -> Column:
    """UTF-8, or Latin-1 where the bytes are no UTF-8."""
    return F.when(F.is_valid_utf8(F.col(column).cast("string")), F.col(column).cast("string")).otherwise(F.decode(column, "ISO-8859-1"))


def read_captures(spark: SparkSession, path: str, starting_batch: int = 0) -> DataFrame:
    return opened(register(spark).read.format(FORMAT).option("path", path).option("startingBatch", starting_batch).load())


def stream_captures(spark: SparkSession, path: str, starting_batch: int = 0) -> DataFrame:
    return opened(register(spark).readStream.format(FORMAT).option("path", path).option("startingBatch", starting_batch).load())
