"""Content hashes of files of any size, as a data source: a partition a file, read in pieces.

``spark.read.format("content_hash").load(path)`` gives path, bytes and sha256 of the files
under path (a file, a folder with all below it, or a pattern of names in a folder). A task
holds one piece of one file; the hash runs on from piece to piece. Paths are local ones or
URIs of a store that Arrow's file systems know.

Cases: names that start with ``_`` or ``.`` are passed over, as Spark's readers do; an empty
file has the hash of nothing; a path with no file has no rows; a missing path fails.
"""

from __future__ import annotations

import fnmatch
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes of a piece.
PIECE = 8 << 20


def _opened(path: str):
    """The file system of a path, the path in it, and what stands before it in a URI."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    if "://" not in path:
        return fs.LocalFileSystem(), path, ""
    store, inner = fs.FileSystem.from_uri(path)
    return store, inner, path[: path.index(inner)] if inner in path else ""


def _files(path: str) -> list[tuple[str, int]]:
    from pyarrow import fs

    store, inner, prefix = _opened(path.rstrip("/"))
    if any(c in inner for c in "*?["):
        folder, _, pattern = inner.rpartition("/")
        found = [f for f in store.get_file_info(fs.FileSelector(folder)) if fnmatch.fnmatch(f.base_name, pattern)]
    else:
        found = [store.get_file_info(inner)]
        if found[0].type == fs.FileType.NotFound:
            raise FileNotFoundError(path)
    inside = [g for f in found for g in ([f] if f.type == fs.FileType.File else store.get_file_info(fs.FileSelector(f.path, recursive=True)))]
    root = len(inner.split("/"))
    shown = [f for f in inside if f.type == fs.FileType.File and not any(p[:1] in "_." for p in f.path.split("/")[root - 1 :])]
    return sorted((prefix + f.path, f.size) for f in shown)


@dataclass
class OneFile(InputPartition):
    path: str
    size: int


class ContentHashReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[OneFile]:
        return [OneFile(p, n) for p, n in _files(self.path)] or [OneFile("", -1)]

    def read(self, partition: OneFile) -> Iterator[tuple]:
        if partition.size < 0:
            return
        store, inner, _ = _opened(partition.path)
        digest, read = hashlib.sha256(), 0
        with store.open_input_stream(inner, buffer_size=0) as f:
            while piece := f.read(PIECE):
                digest.update(piece)
                read += len(piece)
        yield partition.path, read, digest.hexdigest()


class ContentHashes(DataSource):
    @classmethod
    def name(cls) -> str:
        return "content_hash"

    def schema(self) -> str:
        return "path string, bytes long, sha256 string"

    def reader(self, schema) -> ContentHashReader:
        return ContentHashReader(self.options["path"])


def content_hashes(spark: SparkSession, path: str) -> DataFrame:
    """path, bytes, sha256 of the files under path."""
    spark.dataSource.register(ContentHashes)
    return spark.read.format("content_hash").load(path)
