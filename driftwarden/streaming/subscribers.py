"""Results of a stream for any number of subscribers, each served by itself.

Tasks write a micro-batch once, to files that all subscribers share. On commit every subscriber gets a note of the batch in its own folder: a list
of the files, written whole or not at all, under the batch's number. A micro-batch that Spark repeats finds its note there and delivers
nothing again. A subscriber whose folder cannot be written is dropped, with the reason kept; the others and the stream go on.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamArrowWriter, WriterCommitMessage
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from driftwarden.session import ship
from driftwarden.streaming.records import filesystem, read_json, write_json


def subscribe(registry: str, name: str, folder: str) -> None:
    """Serves ``folder`` from the next micro-batch on."""
    write_json(f"{registry}/active/{name}.json", {"name": name, "folder": folder})


def _named(registry: str, state: str) -> list[dict]:
    fs, path = filesystem(f"{registry}/{state}")
    if fs.get_file_info(path).type == pafs.FileType.NotFound:
        return []
    return [read_json(f"{registry}/{state}/{f.base_name}") for f in sorted(fs.get_file_info(pafs.FileSelector(path)), key=lambda f: f.path) if f.base_name.endswith(".json")]


def active(registry: str) -> list[dict]:
    return _named(registry, "active")


def dropped(registry: str) -> list[dict]:
    return _named(registry, "dropped")


def drop(registry: str, name: str, batch: int, reason: str) -> None:
    write_json(f"{registry}/dropped/{name}.json", {"name": name, "batch": batch, "reason": reason})
    fs, path = filesystem(f"{registry}/active/{name}.json")
    fs.delete_file(path)


@dataclass
class Written(WriterCommitMessage):
    files: list[str]
    rows: int


class SubscriberSink(DataSource):
    """``writeStream.format("subscribers")`` with options registry and staging."""

    @classmethod
    def name(cls) -> str:
        return "subscribers"

    def streamWriter(self, schema: StructType, overwrite: bool) -> DataSourceStreamArrowWriter:  # noqa: N802
        return SubscriberWriter({k.lower(): v for k, v in self.options.items()})


class SubscriberWriter(DataSourceStreamArrowWriter):
    def __init__(self, options: dict[str, str]):
        self.registry, self.staging = options["registry"], options["staging"]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        writer, file, rows = None, f"{self.staging.rstrip('/')}/{uuid.uuid4().hex}.parquet", 0
        fs, path = filesystem(file)
        for b in iterator:
            if b.num_rows:
                if writer is None:
                    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
                    writer = pq.ParquetWriter(path, b.schema, filesystem=fs)
                writer.write_batch(b)
                rows += b.num_rows
        if writer is not None:
            writer.close()
        return Written([file] if rows else [], rows)

    def commit(self, messages: list[Written | None], batchId: int) -> None:  # noqa: N803
        files = sorted(f for m in messages if m for f in m.files)
        rows = sum(m.rows for m in messages if m)
        for one in active(self.registry):
            try:
                note = f"{one['folder'].rstrip('/')}/batch-{batchId:012d}.json"
                if read_json(note) is None:
                    write_json(note, {"batch": batchId, "rows": rows, "files": files})
            except Exception as e:  # one subscriber's failure is its own
                drop(self.registry, one["name"], batchId, f"{type(e).__name__}: {e}")

    def abort(self, messages: list[Written | None], batchId: int) -> None:  # noqa: N803
        for file in (f for m in messages if m for f in m.files):
            fs, path = filesystem(file)
            if fs.get_file_info(path).type != pafs.FileType.NotFound:
                fs.delete_file(path)


def serve(results: DataFrame, registry: str, staging: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Starts the stream to all subscribers of ``registry``."""
    spark = ship(results.sparkSession)
    spark.dataSource.register(SubscriberSink)
    return results.writeStream.format("subscribers").option("registry", registry).option("staging", staging).option("checkpointLocation", checkpoint).outputMode("append").trigger(**(trigger or {"availableNow": True})).start()


def received(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    """Everything a subscriber has been given; the list of files is read from its notes by Spark."""
    notes = spark.read.schema("batch long, rows long, files array<string>").json(f"{folder.rstrip('/')}/batch-*.json")
    files = [r.file for r in notes.selectExpr("explode(files) AS file").distinct().collect()]
    return spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)
