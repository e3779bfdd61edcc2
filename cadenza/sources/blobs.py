"""Files out of rows (name, content): a sink of Spark that writes them all or none.

A task writes below a stage of its job, under a folder of its own attempt; the driver moves what the attempts that count have
written to one folder and renames that to the target, which must not exist.  So an attempt that fails, or that is run
again or twice, leaves nothing, and nobody sees half of the files.

Paths are local ones or such as Arrow's file systems open (file, hdfs, s3, gs); executors and driver have to share them.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

FORMAT = "cadenza_files"


@dataclass
class Written(WriterCommitMessage):
    folder: str
    names: list[str]


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path, and the path there.  `file:/a` is what Hadoop calls file:///a."""
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path.removeprefix("file:")
    return pafs.FileSystem.from_uri(path)


def bad_name(name: str | None) -> bool:
    return not name or name.startswith(("/", "_", ".")) or ".." in name.split("/")


class FilesWriter(DataSourceArrowWriter):
    def __init__(self, path: str, schema: StructType):
        if [f.name for f in schema.fields] != ["name", "content"]:
            raise ValueError("files are written out of columns name and content")
        self.path, self.stage = path, f"{path.rstrip('/')}.stage-{uuid.uuid4().hex}"
        files, stage = opened(self.stage)
        files.create_dir(stage, recursive=True)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, stage = opened(self.stage)
        folder, names = uuid.uuid4().hex, []
        # not with its parents: a task that outlives an aborted job finds no stage, and makes none
        files.create_dir(f"{stage}/{folder}", recursive=False)
        for batch in iterator:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                if bad_name(name) or not content.is_valid:
                    raise ValueError(f"not a file to write: {name!r}")
                if "/" in name:
                    files.create_dir(f"{stage}/{folder}/{name.rpartition('/')[0]}", recursive=True)
                with files.open_output_stream(f"{stage}/{folder}/{name}") as out:
                    out.write(content.as_buffer())
                names.append(name)
        return Written(folder, names)

    def commit(self, messages: list[Written | None]) -> None:
        files, stage = opened(self.stage)
        target = opened(self.path)[1]
        done = [m for m in messages if m is not None]
        names = [n for m in done for n in m.names]
        try:
            if len(names) != len(set(names)):
                raise ValueError("two rows have the same file name")
            if files.get_file_info(target).type != pafs.FileType.NotFound:
                raise FileExistsError(target)
            files.create_dir(f"{stage}/all", recursive=True)
            for folder in {n.rpartition("/")[0] for n in names if "/" in n}:
                files.create_dir(f"{stage}/all/{folder}", recursive=True)
            with ThreadPoolExecutor(16) as pool:
                list(pool.map(lambda mn: files.move(f"{stage}/{mn[0].folder}/{mn[1]}", f"{stage}/all/{mn[1]}"), [(m, n) for m in done for n in m.names]))
            files.move(f"{stage}/all", target)
        finally:
            self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        files, stage = opened(self.stage)
        if files.get_file_info(stage).type != pafs.FileType.NotFound:
            files.delete_dir(stage)


class Files(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema: StructType, overwrite: bool) -> FilesWriter:
        return FilesWriter(self.options["path"], schema)


def write_files(rows: DataFrame, name: Column, content: Column, path: str) -> None:
    """Writes a file for each row below `path`, which must not exist: all of them or none."""
    rows.sparkSession.dataSource.register(Files)
    rows.select(name.alias("name"), content.alias("content")).write.format(FORMAT).mode("append").save(path)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """name, content of the files below `path`."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return rows.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "content")
