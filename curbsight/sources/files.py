"""Reading dirty CSV logs, manifests of what was read, and the table sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from curbsight import settings as S
from curbsight.functions.lineage import cut

EXTRA = "_extra"
ORIGIN = ["_file", "_block", "_line"]
# Hex digits of a line's hash that are summed as one number, so that sums of many lines stay exact.
WORD = 15


def header_of(spark: SparkSession, path: str, multi_line: bool = False) -> list[str]:
    """The column names of the first file; all files must have the same ones in the same order."""
    return spark.read.option("header", True).option("multiLine", multi_line).option(
        "escape", '"').csv(path).columns


def _all_lines(spark: SparkSession, path: str, multi_line: bool) -> DataFrame:
    """All lines as text, with their position; ``_header`` marks the header lines."""
    options = {"multiLine": multi_line, "escape": '"', "encoding": "UTF-8"}
    names = header_of(spark, path, multi_line)
    written = spark.read.options(header=False, **options).csv(path).head()
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*names, EXTRA]])
    header = F.col(EXTRA).isNull()
    for name, word in zip(names, written or ()):
        header = header & F.col(name).eqNullSafe(F.lit(word))
    return spark.read.schema(schema).options(header=False, **options).csv(path).select(
        *names, EXTRA, F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_line"), header.alias("_header"))


def read_csv_text(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """All columns as text, with the position of each row and one column for surplus fields.

    Short rows are padded with null. ``multi_line`` allows line breaks inside quotes, but such
    a file cannot be split; leave it off for large well-formed files. A missing path raises.
    """
    return _all_lines(spark, path, multi_line).filter(~F.col("_header")).drop("_header")


def na_tokens(df: DataFrame) -> DataFrame:
    """The missing-value words become null in every text column (exact match)."""
    return df.select(*[
        (F.when(~F.col(c).isin(S.NA_TOKENS), F.col(c)) if kind == "string" else F.col(c)).alias(c)
        for c, kind in df.dtypes])


def good_lines(read: DataFrame) -> DataFrame:
    """Rows without surplus fields."""
    return read.filter(F.col(EXTRA).isNull()).drop(EXTRA)


def bad_lines(read: DataFrame) -> DataFrame:
    """Number of skipped rows (more fields than the header) per file."""
    return read.groupBy("_file").agg(
        F.count_if(F.col(EXTRA).isNotNull()).alias("skipped"), F.count(F.lit(1)).alias("read"))


def with_ordinal(snapshot: DataFrame) -> DataFrame:
    """Number the rows in input order: files by name, blocks by offset, rows as read.

    Dropped lines leave gaps, so that no number repeats. Only the line spans of the blocks are
    ordered, one row per file block; the rows stay where they are. ``snapshot`` must be a written table, so that the positions cannot change.
    """
    blocks = snapshot.groupBy("_file", "_block").agg(
        F.min("_line").alias("first"),
        (F.max("_line") - F.min("_line") + 1).alias("n"))
    before = Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select("_file", "_block", "first",
                            F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    return snapshot.join(offsets, ["_file", "_block"]).withColumn(
        "ordinal", F.col("offset") + F.col("_line") - F.col("first")).drop(
        *ORIGIN, "first", "offset")


def ingest(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """CSV -> text table with nulls and ``ordinal``, from a Parquet snapshot of the input.

    All files must have the same header; a file with other columns or another order raises.
    """
    snapshot = cut(na_tokens(good_lines(_all_lines(spark, path, multi_line))))
    other = snapshot.groupBy("_file").agg(F.max("_header").alias("known")).filter(~F.col("known")).limit(5).collect()
    if other:
        raise ValueError(f"header differs from the other files: {sorted(r['_file'] for r in other)}")
    return with_ordinal(snapshot.filter(~F.col("_header")).drop("_header"))


def file_sizes(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, modificationTime) of the files; their content is not read."""
    return spark.read.format("binaryFile").load(path).select(
        _plain("path").alias("path"), "length", "modificationTime")


def listing_version(spark: SparkSession, path: str) -> str:
    """Changes when a file is added, removed or written again; reads no content."""
    one = F.sha2(F.concat_ws("|", "path", F.col("length").cast("string"),
                             F.unix_micros("modificationTime").cast("string")), 256)
    return file_sizes(spark, path).agg(F.sha2(F.concat_ws(",", F.array_sort(F.collect_list(one))), 256)).first()[0]


def _plain(path: str):
    return F.regexp_replace(path, "^file:/+", "file:/")


def file_fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256, n_bytes) per file: one hash for files of any size, made by many tasks per file.

    Every line is hashed (SHA-256) together with its number, the hashes are added up word by word, and
    the digest is that of the sums, the number of lines and the size. Sums merge in any order, and the
    numbers keep the order of lines, so the digest does not depend on how Spark splits the file. No task
    holds more than a line at a time. It is not the SHA-256 of the file itself. Spark does not list empty
    files; they have no row.
    """
    read = spark.read.option("lineSep", "\n").text(path).select(
        _plain("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_line"), "value")
    # Lines are counted per block first; their numbers need the blocks before.
    blocks = read.groupBy("_file", "_block").agg(F.min("_line").alias("first"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = cut(blocks.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n"))
    number = F.col("offset") + F.col("_line") - F.col("first")
    line = read.join(starts, ["_file", "_block"]).select("_file", F.sha2(
        F.concat(number.cast("string"), F.lit(":"), F.col("value")), 256).alias("h"))
    words = [F.sum(F.conv(F.substring("h", 1 + i * WORD, WORD), 16, 10).cast("decimal(20,0)")).cast("string")
             for i in range(4)]
    summed = line.groupBy("_file").agg(F.count(F.lit(1)).alias("n"), F.concat_ws(",", *words).alias("sums"))
    return file_sizes(spark, path).join(summed.withColumnRenamed("_file", "path"), "path", "left").select(
        "path", F.sha2(F.concat_ws("|", F.coalesce("n", F.lit(0)).cast("string"), F.col("length").cast("string"),
                                   F.coalesce("sums", F.lit(""))), 256).alias("sha256"),
        F.col("length").alias("n_bytes"))


def ingest_manifest(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """One row per file: name, fingerprint, size, rows, columns, load time (UTC) and column names."""
    names = header_of(spark, path, multi_line)
    rows = good_lines(read_csv_text(spark, path, multi_line)).groupBy(
        _plain("_file").alias("path")).agg(F.count(F.lit(1)).alias("n_rows"))
    return file_fingerprints(spark, path).join(rows, "path", "left").select(
        F.element_at(F.split("path", "/"), -1).alias("source_file"), "sha256", "n_bytes",
        F.coalesce("n_rows", F.lit(0)).alias("n_rows"), F.lit(len(names)).alias("n_cols"),
        F.current_timestamp().alias("loaded_at"),
        F.array(*[F.lit(c) for c in names]).alias("column_names"))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A table written by ``write_csv``; a missing path raises."""
    return spark.read.schema(schema).option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def read_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)
