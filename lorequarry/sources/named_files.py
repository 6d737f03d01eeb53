"""A sink of many named files, written by executors and published at once.

Rows are ``path, content``. Tasks write below a folder of the run; only when all have ended is that folder renamed to the
target, so readers see the old files or the new ones, and a job that fails leaves the old. A task that is run again writes
the same names.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage


@dataclass
class Written(WriterCommitMessage):
    files: int


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


class NamedFilesWriter(DataSourceWriter):
    def __init__(self, root: str, run: str):
        self.root, self.folder = root.rstrip("/"), f"{root.rstrip('/')}.{run}"

    def write(self, iterator: Iterator[Row]) -> Written:
        system, folder = _open(self.folder)
        made, n = set(), 0
        for path, content in iterator:
            if path.startswith("/") or ".." in path.split("/"):
                raise ValueError(f"a file would lie outside: {path}")
            parent = f"{folder}/{path}".rpartition("/")[0]
            if parent not in made:
                system.create_dir(parent, recursive=True)
                made.add(parent)
            with system.open_output_stream(f"{folder}/{path}") as out:
                out.write(content.encode() if isinstance(content, str) else bytes(content))
            n += 1
        return Written(n)

    def commit(self, messages: list[Written | None]) -> None:
        system, folder = _open(self.folder)
        system.create_dir(folder, recursive=True)
        with system.open_output_stream(f"{folder}/_SUCCESS") as out:
            out.write(f"{sum(m.files for m in messages if m)}\n".encode())
        _, target = _open(self.root)
        old = f"{target}.old"
        if system.get_file_info(target).type != fs.FileType.NotFound:
            system.move(target, old)
        system.move(folder, target)
        if system.get_file_info(old).type != fs.FileType.NotFound:
            system.delete_dir(old)

    def abort(self, messages: list[Written | None]) -> None:
        system, folder = _open(self.folder)
        if system.get_file_info(folder).type != fs.FileType.NotFound:
            system.delete_dir(folder)


class NamedFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "named_files"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        # the options are all that a source is given again on its way to the tasks
        return NamedFilesWriter(self.options["path"], self.options["run"])


def write(spark: SparkSession, files: DataFrame, root: str) -> str:
    """``files(path, content)`` as files below ``root``, an URI; paths must differ, and what was there goes."""
    spark.dataSource.register(NamedFiles)
    files.select("path", "content").write.format("named_files").mode("overwrite").option("path", root).option("run", uuid.uuid4().hex).save()
    return root
