"""Single files of any store that Spark can reach: whether they are there, what matches a pattern, reading and writing small texts.

Paths are resolved by the session's Hadoop file systems, so a folder on a shared store is as good as a local one, and a path that
can't be reached raises instead of looking empty.
"""

from __future__ import annotations

from typing import Any

from py4j.java_gateway import JavaObject
from pyspark.sql import SparkSession


def _place(path: str) -> tuple[JavaObject, JavaObject]:
    """The file system of a path and the path for it."""
    spark = SparkSession.active()
    at = spark._jvm.org.apache.hadoop.fs.Path(str(path))
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(path: Any) -> bool:
    system, at = _place(path)
    return bool(system.exists(at))


def matching(pattern: str) -> list[str]:
    """The paths that match a glob pattern, in order; none if its folder is not there."""
    system, at = _place(pattern)
    found = system.globStatus(at)
    return sorted(str(s.getPath()) for s in found) if found is not None else []


def make_folder(path: Any) -> None:
    system, at = _place(path)
    system.mkdirs(at)


def read_text(path: Any) -> str:
    system, at = _place(path)
    stream = system.open(at)
    try:
        return SparkSession.active()._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_bytes(content: bytes, path: Any) -> None:
    """A small file, its folders made, an older one replaced."""
    system, at = _place(path)
    stream = system.create(at, True)
    try:
        stream.write(bytearray(content))
    finally:
        stream.close()


def write_text(text: str, path: Any) -> None:
    write_bytes(text.encode("utf-8"), path)
