"""Files and folders that driver and executors share, by way of the cluster's file systems."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession, what: str) -> str:
    """A new folder under spark.checkpoint.dir; where that is unset, a local one if all runs on this machine, an error if not."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = found.get() if found.isDefined() else None
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="graphloom-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def file_system(spark: SparkSession, path: str):
    """The path as the cluster's file system sees it, and that system."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = file_system(spark, path)
    return fs.exists(p)


def remove(spark: SparkSession, path: str) -> None:
    p, fs = file_system(spark, path)
    fs.delete(p, True)


def listing(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """Name and size of every data file below a folder, in order; cheap, nothing is read."""
    p, fs = file_system(spark, path)
    if not fs.exists(p):
        return []
    files, out = fs.listFiles(p, True), []
    while files.hasNext():
        f = files.next()
        if f.getPath().getName().startswith("part-"):
            out.append((f.getPath().toString().rsplit(path.rstrip("/").rsplit("/", 1)[-1], 1)[-1], f.getLen()))
    return sorted(out)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    p, fs = file_system(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str | None:
    """A file's text; None where there is no file."""
    p, fs = file_system(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()
