"""Paths by the file system that they belong to: local, distributed, or an object store."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession


def _place(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    if not path:
        return False
    fs, p = _place(spark, path)
    return fs.exists(p)


def is_file(spark: SparkSession, path: str) -> bool:
    if not exists(spark, path):
        return False
    fs, p = _place(spark, path)
    return fs.getFileStatus(p).isFile()


def delete(spark: SparkSession, path: str) -> bool:
    """Delete a file, or a folder with all that is in it; was there one?"""
    fs, p = _place(spark, path)
    return fs.delete(p, True)


def absolute(spark: SparkSession, path: str) -> str:
    """The full address of a path, scheme and all."""
    fs, p = _place(spark, path)
    return str(fs.makeQualified(p).toString())


def swap(spark: SparkSession, path: str, write: Callable[[str], None]) -> None:
    """Let write() fill a new folder, and put it in the place of path. Readers see the old table or the new one; a failure
    before the exchange leaves the old one, and one during it leaves it under path.old."""
    new, old = f"{path}.new-{uuid.uuid4().hex[:8]}", f"{path}.old"
    write(new)
    fs, p = _place(spark, path)
    to = lambda x: _place(spark, x)[1]
    fs.delete(to(old), True)
    if fs.exists(p) and not fs.rename(p, to(old)):
        raise OSError(f"cannot move {path} aside")
    if not fs.rename(to(new), p):
        raise OSError(f"cannot put {new} in the place of {path}")
    fs.delete(to(old), True)
