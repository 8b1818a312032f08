"""Road health per segment: an explainable 0-100 score for each corridor and zone."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from curbsight import settings as S
from curbsight.functions import columns as C

CAUSES = list(S.ROAD_HEALTH_WEIGHTS)


def present_weights(df: DataFrame) -> DataFrame:
    """(cause, present, weight): configured weights of the causes that occur, summing to 1."""
    flags = df.agg(*[
        F.coalesce(F.max(F.col("event_cause") == c), F.lit(False)).alias(c) for c in CAUSES])
    total = reduce(lambda a, b: a + b, [
        F.when(F.col(c), F.lit(w)).otherwise(F.lit(0.0)) for c, w in S.ROAD_HEALTH_WEIGHTS.items()])
    rows = [F.struct(F.lit(c).alias("cause"), F.col(c).alias("present"),
                     F.when(F.col(c), F.lit(w) / total).otherwise(F.lit(0.0)).alias("weight"))
            for c, w in S.ROAD_HEALTH_WEIGHTS.items()]
    return flags.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def data_weights(df: DataFrame) -> DataFrame:
    """(cause, present, weight) learned from how often a cause shares a cell with accidents.

    Pearson correlation of two 0/1 flags per geo cell from four counts. Without any accident
    the configured weights apply.
    """
    flag = {c: f"has_{c}" for c in CAUSES}
    cells = df.groupBy("geo_cell").agg(*[
        F.coalesce(F.max(F.col("event_cause") == c), F.lit(False)).cast("long").alias(flag[c])
        for c in CAUSES])
    acc = F.col(flag["accident"])
    sums = cells.agg(
        F.count(F.lit(1)).cast("double").alias("n"),
        *[F.sum(flag[c]).cast("double").alias(f"s_{c}") for c in CAUSES],
        *[F.sum(F.col(flag[c]) * acc).cast("double").alias(f"b_{c}") for c in CAUSES])
    n, sa = F.col("n"), F.col("s_accident")

    def raw(c: str) -> Column:
        if c == "accident":
            return F.lit(S.ROAD_HEALTH_WEIGHTS[c])
        s, b = F.col(f"s_{c}"), F.col(f"b_{c}")
        r = F.try_divide(n * b - s * sa, F.sqrt((n * s - s * s) * (n * sa - sa * sa)))
        return F.greatest(F.lit(0.0), F.coalesce(r, F.lit(0.0))) + F.lit(0.05)

    present = {c: F.col(f"s_{c}") > 0 for c in CAUSES}
    learned = {c: F.when(present[c], raw(c)).otherwise(F.lit(0.0)) for c in CAUSES}
    config = {c: F.when(present[c], F.lit(S.ROAD_HEALTH_WEIGHTS[c])).otherwise(F.lit(0.0))
              for c in CAUSES}
    use = {c: F.when(sa > 0, learned[c]).otherwise(config[c]) for c in CAUSES}
    total = reduce(lambda a, b: a + b, use.values())
    rows = [F.struct(F.lit(c).alias("cause"), present[c].alias("present"),
                     F.when(present[c], use[c] / total).otherwise(F.lit(0.0)).alias("weight"))
            for c in CAUSES]
    return sums.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def segment_counts(df: DataFrame, levels: list[str] | None = None) -> DataFrame:
    """Incidents and incidents per cause for each segment of every level, in one pass."""
    levels = levels or S.ROAD_HEALTH_LEVELS
    for level in levels:
        if level not in df.columns:
            raise KeyError(f"no grouping column '{level}'")
    named = F.array(*[F.struct(F.lit(v).alias("level"), F.col(v).alias("segment")) for v in levels])
    return (
        df.select("id", "event_cause", F.explode(named).alias("s"))
        .select("id", "event_cause", "s.*")
        .filter(F.col("segment").isNotNull() & (F.col("segment") != S.UNKNOWN))
        .groupBy("level", "segment")
        .agg(F.count("id").alias("total_events"), *[
            F.count(F.when(F.col("event_cause") == c, F.col("id"))).alias(f"n_{c}")
            for c in CAUSES])
    )


def category(score: Column) -> Column:
    names = list(S.ROAD_HEALTH_CATEGORIES.items())
    out = F.when(score <= names[0][1], names[0][0])
    for name, bound in names[1:-1]:
        out = out.when(score <= bound, name)
    return out.otherwise(names[-1][0])


def road_health(df: DataFrame, levels: list[str] | None = None,
                weights: DataFrame | None = None) -> DataFrame:
    """One row per (level, segment) with the score, its category and the points lost per cause.

    The columns of a cause that does not occur are 0, so that the schema is fixed.
    """
    weights = present_weights(df) if weights is None else weights
    # Six weights: one scalar subquery, evaluated once for the whole plan.
    wide = weights.agg(F.struct(*[
        F.max(F.when((F.col("cause") == c) & F.col("present"), F.col("weight"))).alias(c)
        for c in CAUSES])).scalar()
    counts = segment_counts(df, levels)
    for c in CAUSES:
        counts = counts.withColumn(
            f"share_{c}",
            F.col(f"n_{c}") / (F.col("total_events") + S.ROAD_HEALTH_SMOOTHING))
    # Ranges per level; the join key is the level, the table has one row per level.
    ranges = counts.groupBy("level").agg(*[
        f(f"{kind}_{c}").alias(f"{kind}_{c}_{name}")
        for c in CAUSES for kind in ("share", "n") for name, f in (("lo", F.min), ("hi", F.max))])
    parts = counts.join(ranges, "level")
    contribution = {}
    for c in CAUSES:
        share = C.min_max(F.col(f"share_{c}"), F.col(f"share_{c}_lo"), F.col(f"share_{c}_hi"))
        volume = C.min_max(F.col(f"n_{c}").cast("double"), F.col(f"n_{c}_lo").cast("double"),
                           F.col(f"n_{c}_hi").cast("double"))
        contribution[f"contrib_{c}"] = (share * 0.5 + volume * 0.5) * F.coalesce(wide[c], F.lit(0.0))
    parts = parts.withColumns(contribution)
    degradation = reduce(lambda a, b: a + b, [F.col(k) for k in contribution])
    scored = parts.withColumns({
        **{f"points_lost_{c}": C.half_even(F.col(f"contrib_{c}") * 100, 2) for c in CAUSES},
        "degradation_index": C.half_even(C.clip(degradation, 0.0, 1.0), 4),
    }).withColumn(
        "health_score", C.half_even((F.lit(1.0) - F.col("degradation_index")) * 100, 1))
    points = {c: F.when(wide[c].isNotNull(), F.col(f"points_lost_{c}")) for c in CAUSES}
    most = F.greatest(*points.values())
    top = reduce(lambda acc, c: acc.when(points[c] == most, c), CAUSES[1:],
                 F.when(points[CAUSES[0]] == most, CAUSES[0]))
    return scored.select(
        "level", "segment", "total_events",
        *[x for c in CAUSES for x in (f"n_{c}", f"points_lost_{c}")],
        "degradation_index", "health_score",
        category(F.col("health_score")).alias("health_category"), top.alias("top_factor"),
    )


def ranked(scores: DataFrame) -> DataFrame:
    return scores.orderBy("health_score", "segment")


def summary(scores: DataFrame) -> DataFrame:
    """Segments, mean score and number of critical segments per level."""
    return scores.groupBy("level").agg(
        F.count(F.lit(1)).alias("segments"),
        C.half_even(C.fixed_mean(F.col("health_score"), 1), 4).alias("mean_score"),
        C.tally(F.col("health_category") == "Critical").alias("n_critical"))
