"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from curbsight.functions.lineage import new_table_path

PACKAGE_HOME = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
LOWEST = -(1 << 63)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def kept(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder, tightly compressed, and read it back."""
    path = new_table_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def packed(docs: DataFrame, *used: str) -> DataFrame:
    """The columns ``used``, and all others inside one struct, where no name can clash."""
    others = [c for c in docs.columns if c not in used]
    return docs.select(*used, *([F.struct(*others).alias("extra")] if others else []))


def unpacked(columns: list[str], *used: str) -> list[Column]:
    """The original ``columns`` of a table that went through ``packed``."""
    return [F.col(c) if c in used else F.col("extra").getField(c).alias(c) for c in columns]


def in_tasks(df: DataFrame, fn: Callable, schema: str | T.StructType) -> DataFrame:
    """``mapInArrow`` whose workers can import this package from where the driver has it.

    On a cluster the package is shipped as usual (``--py-files`` or an installed wheel). Workers live
    on after a task; what Arrow holds unused by then goes back.
    """
    def lean(batches):
        yield from fn(batches)
        pa.default_memory_pool().release_unused()

    env = df.sparkSession.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if PACKAGE_HOME not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, PACKAGE_HOME])
    return df.mapInArrow(lean, schema)


def portions(batches: Iterator[pa.RecordBatch], column: str,
             limit: int = 4 << 20) -> Iterator[dict[str, list]]:
    """The rows as column lists, at most about ``limit`` bytes of ``column`` at a time.

    A single longer value is a portion of its own, so memory is bounded by the longest value.
    """
    for batch in batches:
        at = batch.schema.get_field_index(column)
        sizes = np.asarray(pc.fill_null(
            pc.binary_length(batch.column(at)), 0), dtype=np.int64)
        begin, held = 0, 0
        for i, size in enumerate(sizes.tolist()):
            if held and held + size > limit:
                yield batch.slice(begin, i - begin).to_pydict()
                begin, held = i, 0
            held += size + 64
        if begin < batch.num_rows:
            yield batch.slice(begin).to_pydict()


def record_batch(schema: pa.Schema, columns: dict[str, list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)


def row_key(doc_id: str = "doc_id", text: str = "text") -> list[Column]:
    """Two columns that are equal only for rows with the same id and text; never null."""
    return [F.coalesce(F.col(doc_id).cast("long"), F.lit(LOWEST)).alias("_id"),
            F.xxhash64(F.coalesce(F.col(text), F.lit("")), F.col(text).isNull()).alias("_txt")]


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of the id written as text, modulo ``folds``; -1 without an id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds, F.lit(-1))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit words that spreads every input bit (a public integer finaliser)."""
    x = np.asarray(x).astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Rolling:
    """Polynomial hashes of byte ranges, modulo 2^64, from one running sum.

    Every byte value stands for a fixed random 64-bit number; two different ranges of equal
    length collide with a probability near 2^-64.
    """

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.value = rng.integers(0, 1 << 64, 256, dtype=np.uint64)
        self.base = int(rng.integers(0, 1 << 62)) * 4 + 3
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            back = pow(self.base, -1, 1 << 64)
            for name, factor in (("up", self.base), ("down", back)):
                steps = np.full(size, factor, dtype=np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))

    def sums(self, data: np.ndarray) -> np.ndarray:
        self._powers(len(data) + 1)
        out = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(self.value[data] * self.up[:len(data)], out=out[1:])
        return out

    def ranges(self, sums: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (sums[end] - sums[begin]) * self.down[begin]
