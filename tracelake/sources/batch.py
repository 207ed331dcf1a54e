"""Batch jobs as a data source: a folder with request files, a job file, and, once the job is done, result files.

    folder/batch_info.json                 status, count, model, files and whatever else the job is described by
    folder/requests/part-00000.jsonl ...   one request a line
    folder/results/*.jsonl                 one result a line, put there by the service

Requests are written by tasks beside the final place and moved there when all tasks are done; only then does the job file
appear. A failed write leaves nothing behind. Results are read a file per task, and only from a job that is completed. Folders are
shared paths, or URIs of a store that Arrow knows.
"""

from __future__ import annotations

import json
import os
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, InputPartition, IsNotNull, WriterCommitMessage

INFO = "batch_info.json"
RESULT = "custom_id string, status string, error string, content string"
_ARROW = pa.schema([(c, pa.string()) for c in ("custom_id", "status", "error", "content")])


def place(path: str) -> tuple[arrow_fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if "://" in path and not path.startswith("file:"):
        fs, at = arrow_fs.FileSystem.from_uri(path)
        return fs, at.rstrip("/")
    return arrow_fs.LocalFileSystem(), os.path.abspath(re.sub(r"^file:/+", "/", path))


def job_info(path: str) -> dict:
    """What the job file says; empty if there is none."""
    fs, at = place(path)
    if fs.get_file_info(f"{at}/{INFO}").type != arrow_fs.FileType.File:
        return {}
    with fs.open_input_stream(f"{at}/{INFO}") as f:
        return json.loads(f.read())


def update_job(path: str, **values) -> dict:
    """Set entries of the job file; the file is replaced as a whole."""
    info, (fs, at) = job_info(path) | values, place(path)
    fs.create_dir(at, recursive=True)
    part = f"{at}/.{INFO}-{uuid.uuid4().hex}"
    with fs.open_output_stream(part) as f:
        f.write(json.dumps(info, indent=2, ensure_ascii=False).encode())
    fs.move(part, f"{at}/{INFO}")
    return info


def _result(line: str) -> tuple[str | None, str, str | None, str | None]:
    """(custom_id, status, error, content) of a result line: status is ok, failed (the service names an error) or malformed."""
    own = None
    try:
        item = json.loads(line)
        own = item.get("custom_id")
        if item.get("error"):
            return own, "failed", json.dumps(item["error"], ensure_ascii=False), None
        return own, "ok", None, item["response"]["body"]["choices"][0]["message"]["content"]
    except (ValueError, LookupError, TypeError, AttributeError) as e:
        return own, "malformed", f"{type(e).__name__}: {e}", None


@dataclass
class _File(InputPartition):
    path: str


class _Results(DataSourceReader):
    def __init__(self, path: str):
        self.path, self.only = path, None

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("status",):
                self.only = f.value if self.only in (None, f.value) else ""
            elif not (isinstance(f, IsNotNull) and f.attribute == ("status",)):  # a status is never null
                yield f

    def partitions(self) -> list[InputPartition]:
        """One per result file of a completed job; otherwise none, and no result file is opened."""
        if job_info(self.path).get("status") != "completed":
            return []
        fs, at = place(self.path)
        found = fs.get_file_info(arrow_fs.FileSelector(f"{at}/results", allow_not_found=True))
        return [_File(f.path) for f in sorted(found, key=lambda f: f.path) if f.is_file and f.base_name.endswith(".jsonl")]

    def read(self, partition: InputPartition | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # a source without partitions is read once
            return
        fs, _ = place(self.path)
        rows, size = [], 0
        with pa.input_stream(fs.open_input_file(partition.path)) as f:
            for line in _lines(f):
                got = _result(line)
                if self.only is None or got[1] == self.only:
                    rows.append(got)
                    size += len(line)
                if size > 4 << 20 or len(rows) >= 10_000:
                    yield _columns(rows)
                    rows, size = [], 0
        yield _columns(rows)


def _lines(stream, block: int = 1 << 20) -> Iterator[str]:
    """Lines that are not blank, of a stream read in blocks."""
    rest = b""
    while more := stream.read(block):
        *whole, rest = (rest + more).split(b"\n")
        yield from (x.decode("utf-8", "replace") for x in whole if x.strip())
    if rest.strip():
        yield rest.decode("utf-8", "replace")


def _columns(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(4)], schema=_ARROW)


@dataclass
class _Written(WriterCommitMessage):
    task: int
    path: str
    rows: int


class _Requests(DataSourceArrowWriter):
    def __init__(self, path: str, info: dict):
        self.path, self.info, self.stage = path, info, f".requests-{uuid.uuid4().hex}"
        fs, at = place(path)
        fs.create_dir(f"{at}/{self.stage}", recursive=True)  # tasks make no folders: what is late for an abort finds none

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        fs, at = place(self.path)
        path, n = f"{at}/{self.stage}/{task:05d}-{uuid.uuid4().hex}", 0
        try:
            with fs.open_output_stream(path) as f:
                for batch in iterator:
                    f.write("".join(x + "\n" for x in batch.column(0).to_pylist()).encode())
                    n += batch.num_rows
        except BaseException:
            if fs.get_file_info(path).is_file:
                fs.delete_file(path)
            raise
        return _Written(task, path, n)

    def commit(self, messages: list[WriterCommitMessage]) -> None:
        fs, at = place(self.path)
        done = sorted((m for m in messages if m and m.rows), key=lambda m: m.task)
        fs.create_dir(f"{at}/requests", recursive=True)
        fs.delete_dir_contents(f"{at}/requests")
        files = [f"part-{i:05d}.jsonl" for i in range(len(done))]
        for m, name in zip(done, files):
            fs.move(m.path, f"{at}/requests/{name}")
        self._clear(fs, at)
        update_job(self.path, **self.info, status="prepared", count=sum(m.rows for m in done), files=files)

    def abort(self, messages: list[WriterCommitMessage]) -> None:
        self._clear(*place(self.path))

    def _clear(self, fs: arrow_fs.FileSystem, at: str) -> None:
        for again in range(5):  # a task may just be writing there
            if fs.get_file_info(f"{at}/{self.stage}").type != arrow_fs.FileType.Directory:
                return
            try:
                fs.delete_dir(f"{at}/{self.stage}")
            except OSError:
                if again == 4:
                    raise


class BatchJob(DataSource):
    """Options: path, and for writing info, the job file's further entries as JSON."""

    @classmethod
    def name(cls) -> str:
        return "batch_job"

    def schema(self) -> str:
        return RESULT

    def reader(self, schema) -> DataSourceReader:
        return _Results(self.options["path"])

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Requests(self.options["path"], json.loads(self.options.get("info", "{}")))


def submit(requests: DataFrame, path: str, order: Column | str | None = None, **info) -> dict:
    """Write requests (as ``planning.requests`` makes them) as a batch job and return its job file: status prepared, count,
    files and info. order: sort by it, so that lines follow it across files. An earlier job in the folder is replaced."""
    spark = requests.sparkSession
    spark.dataSource.register(BatchJob)
    rows = requests.orderBy(order) if order is not None else requests
    lines = rows.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in requests.columns]), {"ignoreNullFields": "false"}).alias("value"))
    lines.write.format("batch_job").option("info", json.dumps(info)).mode("append").save(path)
    return job_info(path)


def results(spark: SparkSession, path: str) -> DataFrame:
    """custom_id, status (ok, failed, malformed), error, content of a completed job; no rows before that.

    A condition on status is applied while files are read; for that the session option for filters of such sources is set.
    """
    spark.dataSource.register(BatchJob)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("batch_job").load(path)
