"""Paths on whatever storage Spark is configured for, through its own file
system layer (local folders, object stores and HDFS alike)."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def _fs(spark: SparkSession, path: str):
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()), jpath


def exists(spark: SparkSession, path: str) -> bool:
    """Whether ``path`` is there. A storage error is raised, never read as 'no'."""
    fs, p = _fs(spark, path)
    return bool(fs.exists(p))


def glob(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match a pattern, sorted; empty when nothing does."""
    fs, p = _fs(spark, pattern)
    found = fs.globStatus(p)
    return sorted(s.getPath().toString() for s in found) if found is not None else []


def make_folder(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.mkdirs(p)


def size(spark: SparkSession, path: str) -> int:
    """Bytes of a file or of everything below a folder."""
    fs, p = _fs(spark, path)
    return int(fs.getContentSummary(p).getLength())


def read_text(spark: SparkSession, path: str) -> str:
    """A small text file."""
    fs, p = _fs(spark, path)
    stream = fs.open(p)
    try:
        return bytes(spark._jvm.org.apache.hadoop.io.IOUtils.readFullyToByteArray(stream)).decode()
    finally:
        stream.close()


def write_new_text(spark: SparkSession, path: str, text: str) -> None:
    """A small text file that appears whole or not at all: written under another
    name and renamed. An error if it is there already."""
    fs, p = _fs(spark, path)
    _, draft = _fs(spark, f"{path}.{uuid.uuid4().hex}.draft")
    stream = fs.create(draft, False)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    if fs.exists(p) or not fs.rename(draft, p):
        fs.delete(draft, False)
        raise FileExistsError(path)
