"""Tables in the folder that the driver and all executors share, and what they were made from."""

from __future__ import annotations

import hashlib
import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. A local session without it gets a folder of its own; on a cluster it must be set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found is None:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='shared-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has yet."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _at(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    at, fs = _at(spark, path)
    return fs.exists(at)


def fingerprint(spark: SparkSession, *paths: str) -> str:
    """A digest of the names, sizes and times of all files below the paths: another one once any changes."""
    found = []
    for path in paths:
        at, fs = _at(spark, path)
        files = fs.listFiles(at, True)
        while files.hasNext():
            f = files.next()
            found.append(f"{f.getPath()}\x1f{f.getLen()}\x1f{f.getModificationTime()}")
    return hashlib.sha256("\n".join(sorted(found)).encode()).hexdigest()[:24]


def built_once(spark: SparkSession, name: str, sources: list[str], build: Callable[[str], object]) -> str:
    """The path of something made from files: built where these files, as they are now, haven't been used yet. It
    comes into place whole, by one renaming; of two builders the later one's work is left aside."""
    path = f"{shared_folder(spark)}/{name}-{fingerprint(spark, *sources)}"
    if not exists(spark, path):
        made = fresh(spark, f"{name}-building")
        build(made)
        if not exists(spark, path):
            (a, fs), (b, _) = _at(spark, made), _at(spark, path)
            fs.rename(a, b)
    return path


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
