"""Numbers over ranges and joins of values per key, on data where one key holds a third of the rows."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from curbsight.functions.lookups import join_by_key
from curbsight.functions.ordered import row_numbers


@pytest.fixture(scope="module")
def wide(spark):
    return spark.range(3000).select(
        F.col("id"), F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 == 1, None)
        .otherwise(F.concat(F.lit("k"), F.col("id") % 40)).alias("k"), (F.col("id") * 2).alias("other"))


def _plan(df):
    return df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


@pytest.mark.parametrize("threshold", ["10485760", "-1"])
def test_join_by_key_equals_a_plain_join(spark, wide, threshold):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        values = wide.groupBy("k").agg(F.count("id").alias("n"), F.max("other").alias("top"))
        values = values.filter("k IS NULL OR k <> 'k7'")
        joined = join_by_key(wide, values, "k", "n", F.col("id"), hot_rows=500, salts=8)
        assert joined.columns == ["id", "k", "other", "n", "top"]
        plain = wide.join(values, "k", "left").select(*joined.columns)
        assert Counter(map(tuple, joined.collect())) == Counter(map(tuple, plain.collect()))
        plan = _plan(joined)
        # Small values go to the tasks and the wide table stays; large ones meet on key and salt.
        assert ("BroadcastHashJoin" in plan) == (threshold != "-1")
        assert ("hashpartitioning(_key" in plan) == (threshold == "-1")
        assert threshold != "-1" or "_salt" in plan.split("hashpartitioning(_key", 1)[1][:40]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_join_by_key_of_empty_tables(spark, wide):
    values = wide.groupBy("k").agg(F.count("id").alias("n"))
    assert join_by_key(wide.limit(0), values, "k", "n", F.col("id")).count() == 0
    none = join_by_key(wide, values.limit(0), "k", "n", F.col("id"))
    assert none.count() == 3000 and none.filter("n IS NOT NULL").count() == 0


@pytest.mark.parametrize("buckets", [2, 16, 128])
def test_row_numbers_over_ranges(spark, buckets):
    rows = spark.range(2000).select(
        F.when(F.col("id") % 3 == 0, "a").otherwise(F.concat(F.lit("l"), F.col("id") % 5)).alias("layer"),
        (F.col("id") * 7919 % 2003).alias("root"))
    expected = {}
    for layer, root in sorted(map(tuple, rows.collect())):
        expected[layer, root] = sum(1 for x in expected if x[0] == layer)
    numbered = row_numbers(rows, ["layer"], "root", "number", buckets)
    assert {(r.layer, r.root): r.number for r in numbered.collect()} == expected
    assert row_numbers(rows.limit(0), ["layer"], "root", "number").count() == 0
