"""Small driver-side file operations on any Hadoop file system: listings, one-line files, and
creating a file only where none is there, which the commit protocols build on."""

from __future__ import annotations

import os
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder, in order; none where the folder isn't there."""
    fs, p = _path(spark, folder)
    if not fs.exists(p):
        return []
    return sorted(s.getPath().getName() for s in fs.listStatus(p))


def modified(spark: SparkSession, folder: str) -> dict[str, int]:
    """Time of last change of every data file below a folder, by path relative to it."""
    fs, p = _path(spark, folder)
    found, files = {}, fs.listFiles(p, True)
    root = fs.makeQualified(p).toUri().getPath()
    while files.hasNext():
        f = files.next()
        rel = f.getPath().toUri().getPath()[len(root):].lstrip("/")
        if not any(part.startswith(("_", ".")) for part in rel.split("/")):
            found[rel] = f.getModificationTime()
    return found


def partition_columns(spark: SparkSession, folder: str) -> tuple[str, ...]:
    """Columns that the folders of a table's first data file name."""
    fs, p = _path(spark, folder)
    root, files = fs.makeQualified(p).toUri().getPath(), fs.listFiles(p, True)
    while files.hasNext():
        parts = files.next().getPath().toUri().getPath()[len(root):].strip("/").split("/")
        if not any(part.startswith(("_", ".")) for part in parts):
            return tuple(part.split("=")[0] for part in parts[:-1])
    return ()


def first_line(spark: SparkSession, path: str, charset: str = "UTF-8") -> str | None:
    """First line of the first non-empty data file of a folder, or of the file itself."""
    fs, p = _path(spark, path)
    for status in sorted(fs.globStatus(p) or [], key=lambda s: s.getPath().toString()):
        files = [status] if status.isFile() else sorted(fs.listStatus(status.getPath()), key=lambda s: s.getPath().getName())
        for f in files:
            if f.isFile() and f.getLen() and not f.getPath().getName().startswith(("_", ".")):
                jvm = spark.sparkContext._jvm
                codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(
                    spark.sparkContext._jsc.hadoopConfiguration()).getCodec(f.getPath())
                stream = fs.open(f.getPath())
                reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(
                    codec.createInputStream(stream) if codec else stream, charset))
                try:
                    return reader.readLine()
                finally:
                    reader.close()
    return None


def remove(spark: SparkSession, path: str) -> bool:
    """Deletes a file or a whole folder; False where there is none."""
    fs, p = _path(spark, path)
    return fs.delete(p, True)


def read_text(spark: SparkSession, path: str) -> str:
    return first_line(spark, path) or ""


def create_if_absent(spark: SparkSession, path: str, line: str) -> bool:
    """Creates a one-line file, whole from the moment it is seen; False where it is there already.

    The file is written under another name and given its own by an operation that fails where
    the name is taken: a hard link on a local file system, a rename without overwriting elsewhere."""
    fs, p = _path(spark, path)
    fs.mkdirs(p.getParent())
    jvm = spark.sparkContext._jvm
    draft = jvm.org.apache.hadoop.fs.Path(p.getParent(), f".{p.getName()}.{uuid.uuid4().hex}")
    out = fs.create(draft, False)
    try:
        out.write(bytearray(line.encode()))
    finally:
        out.close()
    try:
        if fs.getUri().getScheme() == "file":
            try:
                os.link(draft.toUri().getPath(), p.toUri().getPath())
                return True
            except FileExistsError:
                return False
        options = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
        try:
            context.rename(draft, fs.makeQualified(p), options)
            return True
        except Py4JJavaError as exc:
            if "FileAlreadyExists" in exc.java_exception.getClass().getName():
                return False
            raise
    finally:
        if fs.exists(draft):
            fs.delete(draft, False)
