"""A data source of file heads and hashes for files too large for one cell.

``spark.read.format("file_heads").option("path", folder)`` gives path, length, head (the first ``head_bytes``, 512 by default), sha256 and
md5. Files are read in blocks of 64 KB on executors, through pyarrow's file systems; hashes are computed only where ``hash`` is true.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

BLOCK = 1 << 16
ROWS = 1000
SCHEMA = "path string, length bigint, head binary, sha256 string, md5 string"
NAMES, TYPES = ["path", "length", "head", "sha256", "md5"], [pa.string(), pa.int64(), pa.binary(), pa.string(), pa.string()]


class Files(InputPartition):
    def __init__(self, names: list[tuple[str, int]]):
        self.names = names


class HeadReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder = options["path"]
        self.head_bytes = int(options.get("head_bytes", "512"))
        self.hashed = options.get("hash", "true").lower() == "true"
        self.per_partition = int(options.get("partition_bytes", str(128 << 20)))

    def _files(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.folder) if "://" in self.folder or self.folder.startswith("file:") else (fs.LocalFileSystem(), self.folder)

    def partitions(self) -> list[Files]:
        """Files in name order, some MB to a partition; a large file is a partition of its own."""
        from pyarrow import fs

        files, top = self._files()
        out, size = [[]], 0
        for f in sorted(files.get_file_info(fs.FileSelector(top, recursive=True)), key=lambda f: f.path):
            if f.type == fs.FileType.File:
                if out[-1] and size + f.size > self.per_partition:
                    out.append([])
                    size = 0
                out[-1].append((f.path, f.size))
                size += f.size
        return [Files(names) for names in out if names] or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        files, _ = self._files()
        for lo in range(0, len(partition.names), ROWS):
            rows = [self._row(files, *named) for named in partition.names[lo:lo + ROWS]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), TYPES)], names=NAMES)

    def _row(self, files, name: str, size: int) -> tuple:
        sha, md5, head, seen = hashlib.sha256(), hashlib.md5(), b"", 0
        with files.open_input_stream(name, compression=None) as f:
            while data := f.read(BLOCK if self.hashed else self.head_bytes - seen):
                if len(head) < self.head_bytes:
                    head += data[: self.head_bytes - len(head)]
                seen += len(data)
                if not self.hashed and seen >= self.head_bytes:
                    break
                sha.update(data)
                md5.update(data)
        return name, size, head, sha.hexdigest() if self.hashed else None, md5.hexdigest() if self.hashed else None


class FileHeads(DataSource):
    @classmethod
    def name(cls) -> str:
        return "file_heads"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> HeadReader:
        return HeadReader(self.options)


def register(spark: SparkSession) -> None:
    from verisift.sources.session import ship

    ship(spark)
    spark.dataSource.register(FileHeads)
