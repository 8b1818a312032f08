"""Cutting lineage in iterative jobs, on storage that outlives an executor."""

from __future__ import annotations

import contextlib
import contextvars
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from curbsight.functions import storage

# Tables written since the innermost ``scratch`` began; None outside of any.
_written: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("written", default=None)


def shared_folder(spark: SparkSession) -> str:
    """The folder for checkpoints and stage tables.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session without that
    setting gets a temporary folder; a cluster session without it is an error, because a
    folder of one machine is lost with that machine.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="curbsight-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def new_table_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder for one written table."""
    path = f"{shared_folder(spark)}/curbsight/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    written = _written.get()
    if written is not None:
        written.append(path)
    return path


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete the tables written inside, also after an error. Results must be written elsewhere.

    Threads take part if they run in a copy of the context (``contextvars.copy_context``).
    """
    written: list[str] = []
    before = _written.set(written)
    try:
        yield
    finally:
        _written.reset(before)
        for path in written:
            storage.remove(spark, path)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    A later round then neither recomputes nor re-plans it, survives lost executors, reads
    only the columns it needs, and joins against a table of known size.
    """
    spark = df.sparkSession
    path = new_table_path(spark, "cut")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
