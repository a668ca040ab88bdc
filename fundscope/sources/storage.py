"""Small steps on the shared file system (through Hadoop's FileSystem, so any store that Spark writes to): does a path
exist, list a folder, drop a folder, publish a small file in one step."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def _path(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def _system(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    return _system(spark, path).exists(_path(spark, path))


def names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, sorted; none if there is no such folder."""
    if not exists(spark, path):
        return []
    return sorted(s.getPath().getName() for s in _system(spark, path).listStatus(_path(spark, path)))


def drop(spark: SparkSession, path: str) -> bool:
    return _system(spark, path).delete(_path(spark, path), True)


def _context(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.FileContext.getFileContext(_path(spark, path).toUri(), spark.sparkContext._jsc.hadoopConfiguration())


def move(spark: SparkSession, old: str, new: str) -> None:
    """Renames a file or folder; fails if the new name is there."""
    none = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename, 0)
    _context(spark, new).rename(_path(spark, old), _path(spark, new), none)


def publish(spark: SparkSession, path: str, text: str) -> None:
    """Makes the file ``path`` with ``text`` in one step: written under another name, then renamed. Fails if ``path``
    is there, so of two writers one wins."""
    part = f"{path.rsplit('/', 1)[0]}/_part-{uuid.uuid4().hex}"
    out = _system(spark, path).create(_path(spark, part))
    try:
        out.write(bytearray(text, "utf-8"))
    finally:
        out.close()
    move(spark, part, path)


def read(spark: SparkSession, path: str) -> str:
    """The text of a small file."""
    return "\n".join(r[0] for r in spark.read.text(path).collect())
