"""A stream of the files of a folder as they are added and edited: ``spark.readStream.format("file_changes")``.

An offset is a time and a path: every file whose (time of change, path) comes after the last offset is read, so an edited file
arrives again, which a stream of new files alone misses. Files are listed and read by the file system of the path's scheme. A
file that is gone when it is read has no row.

Options: ``path``; ``suffix`` (all files without it); ``files`` (files of a task, 100).
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "path string, modified_ns long, content string"


class Files(InputPartition):
    def __init__(self, some: list[tuple[int, str]]):
        self.some = some


class Changes(DataSourceStreamReader):
    def __init__(self, path: str, suffix: str, files: int):
        self.path, self.suffix, self.files = path, suffix, files

    def _system(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)

    def _listed(self) -> list[tuple[int, str]]:
        from pyarrow import fs

        system, root = self._system()
        found = system.get_file_info(fs.FileSelector(root, allow_not_found=True, recursive=True))
        return sorted((x.mtime_ns, x.path) for x in found if x.is_file and x.path.endswith(self.suffix))

    def initialOffset(self) -> dict:
        return {"time": -1, "path": ""}

    def latestOffset(self) -> dict:
        listed = self._listed()
        return {"time": listed[-1][0], "path": listed[-1][1]} if listed else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        low, high = (start["time"], start["path"]), (end["time"], end["path"])
        new = [x for x in self._listed() if low < x <= high]
        return [Files(new[at : at + self.files]) for at in range(0, len(new), self.files)]

    def read(self, partition: Files) -> Iterator[tuple]:
        system, _ = self._system()
        for time, path in partition.some:
            try:
                with system.open_input_stream(path) as file:
                    yield path, time, file.read().decode("utf-8", "replace")
            except FileNotFoundError:
                continue


class FileChanges(DataSource):
    @classmethod
    def name(cls) -> str:
        return "file_changes"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> Changes:
        return Changes(self.options["path"], self.options.get("suffix", ""), int(self.options.get("files", 100)))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FileChanges)
