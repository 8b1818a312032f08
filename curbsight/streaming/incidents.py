"""The incident log as a stream: cleaning with scoring, deduplication, daily counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from curbsight import settings as S
from curbsight.functions import columns as C, storage
from curbsight.learning.scoring import enrich_requests, score, validate_requests
from curbsight.operators import cleaning, features

LATENESS = "1 day"
BATCH = "_batch"


def read_slices(spark: SparkSession, path: str, schema: StructType,
                files_per_batch: int = 100) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option(
        "maxFilesPerTrigger", files_per_batch).parquet(path)


def clean_stream(raw: DataFrame, as_of: Column) -> DataFrame:
    """The cleaning steps that need only the row; areas not reported become ``unknown``."""
    return raw.transform(cleaning.prepare, as_of).transform(cleaning.fill_unknown)


def feature_stream(raw: DataFrame, as_of: Column, loads: DataFrame, cells: DataFrame) -> DataFrame:
    """Features of new incidents. ``loads`` and ``cells`` are tables of the last batch run and
    are joined as static sides."""
    return (
        clean_stream(raw, as_of).transform(features.row_features)
        .join(loads, "corridor", "left").join(cells, "geo_cell", "left")
    )


def score_stream(raw: DataFrame, as_of: Column, loads: DataFrame, cells: DataFrame,
                 runs: dict[str, dict]) -> DataFrame:
    return score(feature_stream(raw, as_of, loads, cells), runs)


def dedupe_stream(cleaned: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """First report, the one with the lowest ordinal, per (place, start, cause), as the batch keeps it.

    For update mode: a key comes again when an earlier report of it arrives. State holds one row per
    key and goes when the watermark passes the start; reports older than that are dropped.
    """
    rest = [c for c in cleaned.columns if c not in S.DEDUPE_KEY]
    order = F.col("ordinal") if "ordinal" in rest else F.lit(0)
    return cleaned.withColumn("event_time", event_time()).withWatermark("event_time", lateness).groupBy(
        "event_time", *S.DEDUPE_KEY).agg(F.min_by(F.struct(F.lit(0).alias("_"), *rest), order).alias("first")
                                         ).select(*S.DEDUPE_KEY, *[F.col(f"first.{c}").alias(c) for c in rest])


def event_time() -> Column:
    """The start as an instant; watermarks need one. Independent of the session zone."""
    return F.timestamp_micros(C.micros(F.col("start_datetime")))


def local_event_time() -> Column:
    """Local wall clock written as an instant, so that a one-day window is a local day."""
    return F.timestamp_micros(C.micros(C.local_time(F.col("start_datetime"))))


def daily_counts_stream(cleaned: DataFrame, by: str = "zone", lateness: str = LATENESS) -> DataFrame:
    """(date, area, n) per local day; for update mode, so that open days come out with their count so far."""
    counts = cleaned.withColumn("local_time", local_event_time()).withWatermark(
        "local_time", lateness).groupBy(F.window("local_time", "1 day"), by).agg(
        F.count(F.lit(1)).alias("n"))
    day = F.date_add(F.lit("1970-01-01").cast("date"), (
        F.unix_micros("window.start") / F.lit(86_400_000_000)).cast("int"))
    return counts.select(day.alias("date"), by, "n")


def _batch_folder(output: str, number: int) -> str:
    return f"{output}/{BATCH}={number}"


def start(stream: DataFrame, output: str, checkpoint: str) -> StreamingQuery:
    """Write the updates of every micro-batch to a folder of its own; restartable from the checkpoint.

    A batch that is repeated after a failure overwrites its folder, so nothing counts twice.
    """
    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(_batch_folder(output, number))

    return stream.writeStream.foreachBatch(put).outputMode("update").option(
        "checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, output: str, schema: StructType, keys: list[str] | None = None) -> DataFrame:
    """The written updates; with ``keys`` only the last one of each key."""
    if not storage.exists(spark, output):
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(StructType([*schema.fields, StructField(BATCH, LongType())])).parquet(output)
    if keys:
        rest = [c for c in schema.names if c not in keys]
        rows = rows.groupBy(*keys).agg(F.max_by(F.struct(F.lit(0).alias("_"), *rest), BATCH).alias("last")).select(
            *keys, *[F.col(f"last.{c}").alias(c) for c in rest])
    return rows.select(*schema.names)


def run_to_end(stream: DataFrame, output: str, checkpoint: str, keys: list[str] | None = None) -> DataFrame:
    """Run over all that is there now, and read the result."""
    start(stream, output, checkpoint).awaitTermination()
    return latest(stream.sparkSession, output, stream.schema, keys)


def score_requests(requests: DataFrame, lookups: Callable[[], tuple[DataFrame, DataFrame]],
                   runs: dict[str, dict], scored: str, quarantine: str, checkpoint: str) -> StreamingQuery:
    """Scores of accepted requests to ``scored``, rejected ones with their reason to ``quarantine``.

    Every micro-batch is read once for both. It asks ``lookups`` for the corridor loads and cell counts of
    that moment, and features and fallbacks are those of a batch of requests, so a request gets the same
    score either way.
    """
    def put(batch: DataFrame, number: int) -> None:
        judged = validate_requests(batch).persist()
        try:
            judged.filter(~F.col("accepted")).write.mode("overwrite").parquet(_batch_folder(quarantine, number))
            score(enrich_requests(judged.filter("accepted"), *lookups()), runs).write.mode(
                "overwrite").parquet(_batch_folder(scored, number))
        finally:
            judged.unpersist()

    return requests.writeStream.foreachBatch(put).option(
        "checkpointLocation", checkpoint).trigger(availableNow=True).start()
