"""Files by path from executors and driver: local ones, and those of file systems that Arrow or Hadoop know."""

from __future__ import annotations

import io
import os
import shutil
from typing import BinaryIO

from pyarrow import fs
from pyspark.sql import SparkSession


def _inside(path: str) -> tuple[fs.FileSystem, str] | None:
    """The file system and the path in it; none of a local path."""
    return fs.FileSystem.from_uri(path) if "://" in path and not path.startswith("file:") else None


def local(path: str) -> str:
    return "/" + path.removeprefix("file:").lstrip("/") if path.startswith("file:") else path


def opened(path: str) -> BinaryIO:
    at = _inside(path)
    return at[0].open_input_file(at[1]) if at else open(local(path), "rb")


def size_of(path: str) -> int:
    at = _inside(path)
    return at[0].get_file_info(at[1]).size if at else os.path.getsize(local(path))


def exists(path: str) -> bool:
    at = _inside(path)
    return at[0].get_file_info(at[1]).type != fs.FileType.NotFound if at else os.path.exists(local(path))


def _put(source: BinaryIO, path: str) -> None:
    """Writes a file at once: a task that is run again, or dies, leaves no half file."""
    if at := _inside(path):
        with at[0].open_output_stream(at[1]) as f:  # object stores show a file only when it is closed
            shutil.copyfileobj(source, f, 1 << 20)
        return
    path = local(path)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    part = f"{path}.{os.getpid()}.part"
    with open(part, "wb") as f:
        shutil.copyfileobj(source, f, 1 << 20)
    os.replace(part, path)


def save(path: str, data: bytes) -> None:
    _put(io.BytesIO(data), path)


def copy(source: str, to: str) -> None:
    with opened(source) as f:
        _put(f, to)


class Folder:
    """A folder of a Hadoop file system, seen from the driver."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.jvm, self.conf, self.path = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), path.rstrip("/")
        self.fs = self.at().getFileSystem(self.conf)

    def at(self, *steps: str):
        return self.jvm.org.apache.hadoop.fs.Path("/".join([self.path, *steps]))

    def names(self) -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.at())) if self.fs.exists(self.at()) else []

    def make(self) -> None:
        self.fs.mkdirs(self.at())

    def delete(self, *steps: str) -> None:
        self.fs.delete(self.at(*steps), True)

    def join_parts(self, parts: str, to: str, before: str = "", after: str = "") -> None:
        """The part files of a folder in it as one file, streamed, never held."""
        out = self.fs.create(self.at(to), True)
        out.write(bytearray(before.encode()))
        for s in sorted(str(s.getPath()) for s in self.fs.listStatus(self.at(parts)) if s.getPath().getName().startswith("part-")):
            src = self.fs.open(self.jvm.org.apache.hadoop.fs.Path(s))
            self.jvm.org.apache.hadoop.io.IOUtils.copyBytes(src, out, 1 << 16, False)
            src.close()
        out.write(bytearray(after.encode()))
        out.close()
        self.delete(parts)
