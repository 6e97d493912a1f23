"""Reading files by offset and length in tasks, so that no file is held whole."""

from __future__ import annotations

import re
from functools import lru_cache

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession


def files(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """(URI, bytes) of the files that path names (a pattern or a folder counts as its files); one row a file."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out: list[tuple[str, int]] = []
    todo = list(store.globStatus(p) or [])
    while todo:
        s = todo.pop()
        if s.isDirectory():
            todo += list(store.listStatus(s.getPath()))
        else:
            out.append((s.getPath().toString(), s.getLen()))
    if not out:
        raise FileNotFoundError(path)
    return sorted(out)


def table(spark: SparkSession, path: str) -> DataFrame:
    """path, length: a row and a partition a file."""
    got = files(spark, path)
    return spark.createDataFrame(got, "path string, length long").repartition(len(got), "path")


@lru_cache(maxsize=64)
def _store(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", uri))


def read(uri: str, offset: int, n: int) -> bytes:
    """n bytes at offset (fewer at the file's end)."""
    store, path = _store(uri)
    with store.open_input_file(path) as f:
        return f.read_at(n, offset)


def stream(uri: str):
    """The file from its beginning, as a binary file object without seeking."""
    store, path = _store(uri)
    return store.open_input_stream(path, compression=None)


class Window:
    """A file's bytes by slices and struct codes; blocks of `size` bytes are read as they are needed, the last few kept."""

    def __init__(self, fetch, size: int = 1 << 20, most: int = 16):
        self.fetch, self.size, self.most, self.held = fetch, size, most, {}

    def bytes(self, at: int, n: int) -> bytes:
        if n > self.size:
            return self.fetch(at, n)
        out = b""
        for k in range(at // self.size, (at + max(n, 1) - 1) // self.size + 1):
            if k not in self.held:
                if len(self.held) >= self.most:
                    self.held.pop(next(iter(self.held)))
                self.held[k] = self.fetch(k * self.size, self.size)
            out += self.held[k][max(0, at - k * self.size) : at + n - k * self.size]
        return out


def window(source) -> Window:
    """Of a URI, or of bytes at hand."""
    if isinstance(source, str):
        return Window(lambda at, n: read(source, at, n))
    return Window(lambda at, n: bytes(source[at : at + n]))
