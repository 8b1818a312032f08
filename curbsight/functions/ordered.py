"""Exact order statistics and running totals without one task holding all rows.

Both work on value counts: equal values are merged first, with map-side aggregation, so hot
values cost one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def value_counts(df: DataFrame, keys: list[str], value: str, weight: str | None = None) -> DataFrame:
    return df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(
        (F.sum(weight) if weight else F.count(F.lit(1))).alias("copies"))


def quantiles(counts: DataFrame, keys: list[str], value: str, probs: dict[str, float],
              width: float) -> DataFrame:
    """Exact linear-interpolation quantiles per key, one column per entry of ``probs``.

    ``counts`` is the result of ``value_counts``. Step one counts buckets of ``width`` and
    finds those that hold a wanted rank; step two ranks only the values of these buckets. The
    number of buckets depends on the range of the values, not on the number of rows.
    """
    bucketed = counts.withColumn("bucket", F.floor(F.col(value) / width))
    totals = bucketed.groupBy(*keys, "bucket").agg(F.sum("copies").alias("held"))
    whole = Window.partitionBy(*keys)
    before = whole.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = totals.withColumns({
        "upto": F.sum("held").over(before), "n": F.sum("held").over(whole)})
    ranks = F.array(*[
        F.struct(F.lit(name).alias("name"), F.lit(p).alias("p"),
                 ((F.col("n") - 1) * F.lit(p)).alias("r"))
        for name, p in probs.items()])
    wanted = (
        totals.withColumn("q", F.explode(ranks))
        .withColumn("side", F.explode(F.array(F.lit(0), F.lit(1))))
        .withColumn("rank", F.when(F.col("side") == 0, F.floor("q.r")).otherwise(F.ceil("q.r")))
        .filter((F.col("rank") >= F.col("upto") - F.col("held")) & (F.col("rank") < F.col("upto")))
        .select(*keys, "bucket", "q.name", F.col("q.r").alias("r"), "side", "rank",
                (F.col("upto") - F.col("held")).alias("skipped"))
    )
    inside = Window.partitionBy(*keys, "bucket").orderBy(value).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    hit = (
        bucketed.join(wanted.select(*keys, "bucket").distinct(), [*keys, "bucket"], "left_semi")
        .withColumn("ends", F.sum("copies").over(inside))
        .join(wanted, [*keys, "bucket"])
        .filter((F.col("rank") >= F.col("skipped") + F.col("ends") - F.col("copies"))
                & (F.col("rank") < F.col("skipped") + F.col("ends")))
    )
    at = {}
    for name in probs:
        low = F.max(F.when((F.col("name") == name) & (F.col("side") == 0), F.col(value)))
        high = F.max(F.when((F.col("name") == name) & (F.col("side") == 1), F.col(value)))
        part = F.max(F.when(F.col("name") == name, F.col("r") - F.floor("r")))
        at[name] = (low + (high - low) * part).cast("double")
    return hit.groupBy(*keys).agg(*[c.alias(name) for name, c in at.items()])


def running_totals(df: DataFrame, by: str, sums: list[str], buckets: int = 128) -> DataFrame:
    """Cumulative sums over ``by`` from high to low; ``by`` is distinct per row.

    Approximate quantiles split the rows into even buckets. Totals of the buckets are summed
    in a table of at most ``buckets + 1`` rows, and each bucket adds up its own rows. Adds
    ``cum_<name>`` per column.
    """
    cuts = df.agg(F.percentile_approx(
        by, [i / buckets for i in range(1, buckets)], 10_000).alias("cuts"))
    split = df.withColumn("_cuts", cuts.scalar()).withColumn(
        "bucket", F.size(F.filter("_cuts", lambda b: b < F.col(by)))).drop("_cuts")
    totals = split.groupBy("bucket").agg(*[F.sum(c).alias(f"in_{c}") for c in sums])
    above = Window.orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("bucket", *[
        F.coalesce(F.sum(f"in_{c}").over(above), F.lit(0)).alias(f"above_{c}") for c in sums])
    own = Window.partitionBy("bucket").orderBy(F.desc(by)).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    return (
        split.withColumns({f"own_{c}": F.sum(c).over(own) for c in sums})
        .join(offsets, "bucket")
        .withColumns({f"cum_{c}": F.col(f"own_{c}") + F.col(f"above_{c}") for c in sums})
        .drop("bucket", *[f"own_{c}" for c in sums], *[f"above_{c}" for c in sums])
    )


def row_numbers(df: DataFrame, keys: list[str], by: str, name: str, buckets: int = 128) -> DataFrame:
    """Adds ``name``: the place of a row among its ``keys`` by ``by``, from 0.

    Values of ``by`` are distinct per key. Approximate quantiles of all rows split them into even
    ranges; rows are numbered within a range and get the number of rows in the ranges before, from
    a table of at most ``buckets`` rows per key. ``df`` is read three times: pass a written table.
    """
    cuts = df.agg(F.percentile_approx(
        by, [i / buckets for i in range(1, buckets)], 10_000).alias("cuts"))
    split = df.withColumn("_cuts", cuts.scalar()).withColumn(
        "_bucket", F.size(F.filter("_cuts", lambda b: b < F.col(by)))).drop("_cuts")
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    held = split.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_held")).select(
        *keys, "_bucket", F.coalesce(F.sum("_held").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*keys, "_bucket").orderBy(by)
    return split.withColumn("_place", F.row_number().over(inside) - 1).join(
        held, [*keys, "_bucket"]).withColumn(
        name, (F.col("_before") + F.col("_place")).cast("long")).drop("_bucket", "_before", "_place")


def column_or(df: DataFrame, name: str, default: Column) -> Column:
    return F.col(name) if name in df.columns else default
