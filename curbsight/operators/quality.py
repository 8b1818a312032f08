"""Data-quality gates over a raw incident table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from curbsight import settings as S
from curbsight.functions import columns as C

CHECK_COLUMNS = ["name", "severity", "message", "details"]


def _as_number(df: DataFrame, name: str) -> Column:
    kind = dict(df.dtypes)[name]
    return C.to_number(F.col(name)) if kind == "string" else F.col(name).cast("double")


def _as_time(df: DataFrame, name: str) -> Column:
    kind = dict(df.dtypes)[name]
    return C.to_utc(F.col(name)) if kind == "string" else F.col(name)


def _key_counts(df: DataFrame, key: str) -> DataFrame:
    """Rows beyond the first per key value; a null key equals a null key."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("c")).agg(
        F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).alias("duplicates"))


def domain_counts(df: DataFrame) -> DataFrame:
    """(column, value, n) for the domain columns, in one pass."""
    names = [c for c in S.DOMAIN_COLUMNS if c in df.columns]
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in names
    ])).alias("p")).select("p.*")
    return long.filter(F.col("value").isNotNull()).groupBy("column", "value").agg(
        F.count(F.lit(1)).alias("n"))


def domain_top5(df: DataFrame) -> DataFrame:
    ranked = Window.partitionBy("column").orderBy(F.desc("n"), "value")
    return domain_counts(df).withColumn(
        "rank", F.row_number().over(ranked)).filter("rank <= 5")


def checks(df: DataFrame, as_of: Column) -> DataFrame:
    """One row per check: name, severity, message, details (a map of text).

    The row checks are one aggregate pass; uniqueness and domain counts need a shuffle by
    their own key and are counted per key, not per row.
    """
    have = set(df.columns)
    missing = [c for c in S.REQUIRED_COLUMNS if c not in have]
    aggs = {"n_rows": F.count(F.lit(1))}
    for name in S.MAX_MISSING_PCT:
        if name in have:
            aggs[f"null_{name}"] = C.tally(F.col(name).isNull())
    if {"latitude", "longitude"} <= have:
        lat, lon, box = _as_number(df, "latitude"), _as_number(df, "longitude"), S.BBOX
        aggs["out_of_box"] = C.tally(
            F.coalesce((lat < box["lat_min"]) | (lat > box["lat_max"]), F.lit(True))
            | F.coalesce((lon < box["lon_min"]) | (lon > box["lon_max"]), F.lit(True)))
    if "start_datetime" in have:
        start = _as_time(df, "start_datetime")
        aggs["unparsed"] = C.tally(start.isNull())
        aggs["future"] = C.tally(F.coalesce(start > as_of, F.lit(False)))
    stats = df.agg(*[c.alias(n) for n, c in aggs.items()])

    n = F.col("n_rows")
    text = lambda c: c.cast("string")
    share = lambda c: F.coalesce(F.try_divide(c * F.lit(100.0), n), F.lit(0.0))
    two = lambda c: F.format_string("%.2f", c)
    rows = []

    def add(name, severity, message, **details):
        flat = [x for k, v in details.items() for x in (F.lit(k), text(v))]
        detail = F.create_map(*flat) if flat else F.create_map().cast("map<string,string>")
        rows.append(F.struct(
            F.lit(name).alias("name"), severity.alias("severity"), message.alias("message"),
            detail.alias("details")))

    def level(error: Column, warn: Column | None = None) -> Column:
        out = F.when(error, "ERROR")
        out = out.when(warn, "WARN") if warn is not None else out
        return out.otherwise("OK")

    if missing:
        add("schema.required_columns", F.lit("ERROR"),
            F.lit(f"Missing required columns: {', '.join(missing)}"),
            missing=F.lit(",".join(missing)))
    else:
        add("schema.required_columns", F.lit("OK"), F.lit("All required columns present."))
    few = n < S.MIN_ROWS
    add("volume.min_rows", level(few),
        F.when(few, F.format_string(f"Only %d rows (< {S.MIN_ROWS}).", n))
        .otherwise(F.format_string("%d rows.", n)), rows=n)
    for name, limit in S.MAX_MISSING_PCT.items():
        if name in have:
            pct = share(F.col(f"null_{name}"))
            add(f"missing.{name}", level(pct > limit),
                F.concat(F.lit(f"{name}: "), two(pct), F.lit(f"% missing (max {limit}%).")),
                pct=two(pct))
    if "out_of_box" in aggs:
        pct = share(F.col("out_of_box"))
        add("geo.in_bbox", level(pct >= 5, pct > 0),
            F.concat(text(F.col("out_of_box")), F.lit(" ("), two(pct),
                     F.lit("%) primary coords outside city bbox.")),
            out_of_box=F.col("out_of_box"))
    if "unparsed" in aggs:
        add("temporal.start_datetime",
            level(F.lit(False), (F.col("unparsed") > 0) | (F.col("future") > 0)),
            F.concat(text(F.col("unparsed")), F.lit(" unparseable, "), text(F.col("future")),
                     F.lit(" future-dated start times.")),
            unparsed=F.col("unparsed"), future=F.col("future"))
    out = stats.select(F.explode(F.array(*rows)).alias("r")).select("r.*")

    if S.UNIQUE_KEY in have:
        d = F.col("duplicates")
        out = out.unionByName(_key_counts(df, S.UNIQUE_KEY).select(
            F.lit("uniqueness.primary_key").alias("name"),
            level(d > 0).alias("severity"),
            F.concat(text(d), F.lit(f" duplicate '{S.UNIQUE_KEY}' values.")).alias("message"),
            F.create_map(F.lit("duplicates"), text(d)).alias("details")))
    if have & set(S.DOMAIN_COLUMNS):
        wanted = [c for c in S.DOMAIN_COLUMNS if c in have]
        names = df.sparkSession.createDataFrame([(c,) for c in wanted], "column string")
        counts = domain_top5(df).groupBy("column").agg(
            F.sort_array(F.collect_list(F.struct("rank", "value", "n"))).alias("top"))
        card = domain_counts(df).groupBy("column").agg(F.count(F.lit(1)).alias("cardinality"))
        size = F.coalesce(F.col("cardinality"), F.lit(0))
        top = F.concat_ws(", ", F.transform(
            F.col("top"), lambda r: F.concat_ws("=", r["value"], r["n"].cast("string"))))
        out = out.unionByName(
            names.join(counts, "column", "left").join(card, "column", "left").select(
                F.concat(F.lit("domain."), F.col("column"), F.lit(".cardinality")).alias("name"),
                F.lit("OK").alias("severity"),
                F.concat(F.col("column"), F.lit(" has "), text(size), F.lit(" distinct values."))
                .alias("message"),
                F.create_map(F.lit("cardinality"), text(size), F.lit("top"),
                             F.coalesce(top, F.lit(""))).alias("details")))
    return out


def summary(report: DataFrame) -> DataFrame:
    """passed, n_errors, n_checks."""
    error = F.col("severity") == "ERROR"
    return report.agg(
        (~F.coalesce(F.max(error), F.lit(False))).alias("passed"),
        C.tally(error).alias("n_errors"), F.count(F.lit(1)).alias("n_checks"))


def severity_counts(report: DataFrame) -> DataFrame:
    return report.groupBy("severity").agg(F.count(F.lit(1)).alias("n"))


def require_passed(report: DataFrame) -> None:
    """Raise if any check has severity ERROR (the report has some dozen rows)."""
    errors = report.filter(F.col("severity") == "ERROR").count()
    if errors:
        raise ValueError(f"validation failed with {errors} error(s)")


def completeness(df: DataFrame, keep: int = 25) -> DataFrame:
    """Share of values per column; the ``keep`` most complete columns, ascending."""
    shares = df.agg(*[
        F.avg(F.col(c).isNotNull().cast("double")).alias(c) for c in df.columns])
    long = shares.unpivot([], df.columns, "column", "share")
    return (
        long.select("column", C.half_even(F.col("share"), 4).alias("completeness"))
        .orderBy(F.desc("completeness"), F.desc("column")).limit(keep)
        .orderBy("completeness", "column")
    )
