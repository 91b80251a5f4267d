"""Small files and existence of paths on whatever file system the session reads: local, HDFS or an object store."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession


def _target(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there."""
    fs, p = _target(spark, path)
    return fs.exists(p)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file by the driver: reports, manifests, indexes."""
    fs, p = _target(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str:
    """A small file."""
    return "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())


def read_json(spark: SparkSession, path: str) -> dict:
    """The object in a small JSON file."""
    value = json.loads(read_text(spark, path))
    if not isinstance(value, dict):
        raise ValueError(f"{path} does not hold an object")
    return value
