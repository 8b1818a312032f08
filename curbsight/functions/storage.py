"""Small files and whole folders in the shared folder, through the file systems Spark knows."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def _path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    where, store = _path(spark, path)
    return store.exists(where)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file or folder; nothing happens if there is none."""
    where, store = _path(spark, path)
    store.delete(where, True)


def publish(spark: SparkSession, draft: str, final: str) -> bool:
    """Give a finished folder its name in one step; False, and no change, if the name is taken."""
    source, store = _path(spark, draft)
    target, _ = _path(spark, final)
    store.mkdirs(target.getParent())
    if store.exists(target):
        return False
    return store.rename(source, target)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Replace a small file in one step: readers see the old text or the new one."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target, store = _path(spark, path)
    draft, _ = _path(spark, f"{path}.{uuid.uuid4().hex}")
    store.mkdirs(target.getParent())
    out = store.create(draft, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    fs = jvm.org.apache.hadoop.fs
    options = spark.sparkContext._gateway.new_array(fs.Options.Rename, 1)
    options[0] = fs.Options.Rename.OVERWRITE
    context = fs.FileContext.getFileContext(store.getUri(), conf)
    context.rename(store.makeQualified(draft), store.makeQualified(target), options)


def read_text(spark: SparkSession, path: str) -> str | None:
    """The text of a small file, or None if there is none."""
    where, store = _path(spark, path)
    if not store.exists(where):
        return None
    stream = store.open(where)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()
