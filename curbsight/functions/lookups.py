"""Joining values per key to a wide table whose keys may be few and hot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from curbsight.functions.lineage import cut

HOT_ROWS = 100_000
SALTS = 64


def join_by_key(df: DataFrame, values: DataFrame, key: str, rows: str, spread: Column,
                hot_rows: int = HOT_ROWS, salts: int = SALTS) -> DataFrame:
    """``df`` with the other columns of ``values``, which has one row per key; a left join.

    ``rows`` is the column of ``values`` that counts the rows of ``df`` with the key. Keys of more
    than ``hot_rows`` rows (at most a ``hot_rows``-th of the rows of ``df``) are joined with a salt
    drawn from ``spread``, then the others on the key alone, where rows of hot keys and rows
    without a key go to places of their own. Both sides of values are written first, so Spark
    knows their size and sends a small one to all tasks by itself, without moving ``df``. Rows
    whose key is null or not in ``values`` get nulls. The columns of ``df`` keep their order.
    """
    added = [c for c in values.columns if c != key]
    named = cut(values.filter(F.col(key).isNotNull()))
    packed = F.struct(*added)
    hot = cut(named.filter(F.col(rows) > hot_rows).select(
        F.col(key).alias("_key"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt"),
        packed.alias("_hot")))
    rest = cut(named.filter(F.col(rows) <= hot_rows).select(
        F.col(key).alias("_key"), F.lit(0).alias("_place"), packed.alias("_rest")))
    place = F.xxhash64(spread)
    salted = df.withColumns({"_key": F.col(key), "_salt": F.pmod(place, F.lit(salts)).cast("int")})
    found = salted.join(hot, ["_key", "_salt"], "left").withColumn(
        # Place 0 is the one of the written values; settled rows are spread over all others.
        "_place", F.when(F.col("_hot").isNull() & F.col("_key").isNotNull(), F.lit(0)).otherwise(
            (F.pmod(place, F.lit(1 << 30)) + 1).cast("int"))).withColumn("_key", F.coalesce("_key", F.lit("")))
    return found.join(rest, ["_key", "_place"], "left").select(
        *df.columns, *[F.coalesce(f"_hot.{c}", f"_rest.{c}").alias(c) for c in added])
