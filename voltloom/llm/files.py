"""Files that tasks write into a shared folder: temporary names, then a move to the final name.

Paths are URIs of a file system that executors reach (spark.checkpoint.dir or a folder given).
A task that runs twice writes the same bytes under the same final name.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from voltloom.session import shared_folder


def new_folder(spark: SparkSession, name: str) -> str:
    top = shared_folder(spark)
    return f"{top}/voltloom/{name}-{uuid.uuid4().hex}"


def discard(staged: DataFrame) -> None:
    """Delete a stage table that nothing reads any more."""
    files = staged.inputFiles()
    if files:
        fs, path = opened(files[0].rsplit("/", 1)[0])
        fs.delete_dir(path)


def opened(uri: str):
    """The file system of a URI and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


class Shard:
    """One file on its way: write(), then commit() moves it to its name."""

    def __init__(self, folder: str, name: str):
        self.fs, top = opened(folder)
        self.fs.create_dir(top, recursive=True)
        self.final, self.size = f"{top}/{name}", 0
        self.temporary = f"{top}/.{name}.{uuid.uuid4().hex}.tmp"
        self.out = self.fs.open_output_stream(self.temporary, compression=None)

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def commit(self) -> None:
        self.out.close()
        self.fs.move(self.temporary, self.final)

    def abandon(self) -> None:
        """Remove what a failed task has written."""
        self.out.close()
        self.fs.delete_file(self.temporary)
