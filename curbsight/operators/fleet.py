"""Allocation of a fixed fleet over zones by weighted need.

All tables here have one row per zone (or zone and resource); events are only touched by the
first aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from curbsight import settings as S
from curbsight.functions import columns as C
from curbsight.functions.lineage import cut

CAUSE_SIGNALS = {
    "breakdown": "vehicle_breakdown", "accident": "accident", "congestion": "congestion",
    "pot_holes": "pot_holes", "water_logging": "water_logging",
}
SIGNALS = [*CAUSE_SIGNALS, "risk", "road_health", "hotspot"]
RESOURCES = list(S.FLEET)


def zone_signals(df: DataFrame, zone_health: DataFrame | None = None,
                 hotspots: DataFrame | None = None, zone: str = "zone") -> DataFrame:
    """Raw need signals per zone. Missing health or hotspots count as 0."""
    known = df.filter(F.col(zone).isNotNull() & (F.col(zone) != S.UNKNOWN))
    signals = known.groupBy(F.col(zone).alias("zone")).agg(
        F.count("id").alias("total_events"),
        *[F.count(F.when(F.col("event_cause") == cause, F.col("id"))).alias(name)
          for name, cause in CAUSE_SIGNALS.items()],
        F.coalesce(C.fixed_mean(F.col("risk_score"), 2), F.lit(0.0)).alias("risk"))
    if zone_health is not None:
        signals = signals.join(zone_health.select(
            F.col("segment").alias("zone"), (F.lit(100.0) - F.col("health_score")).alias("road_health")),
            "zone", "left")
    else:
        signals = signals.withColumn("road_health", F.lit(0.0))
    if hotspots is not None:
        sums = hotspots.groupBy(F.col("top_zone").alias("zone")).agg(
            (C.fixed_sum(F.col("risk_score"), 1) / 10).alias("hotspot"))
        signals = signals.join(sums, "zone", "left")
    else:
        signals = signals.withColumn("hotspot", F.lit(0.0))
    return signals.fillna(0.0, subset=["road_health", "hotspot"])


def zone_demand(signals: DataFrame) -> DataFrame:
    """(zone, resource, demand): weighted sum of the signals, each scaled over the zones."""
    ranges = signals.agg(F.struct(*[
        f(F.col(s).cast("double")).alias(f"{s}_{n}")
        for s in SIGNALS for n, f in (("lo", F.min), ("hi", F.max))])).scalar()
    scaled = {s: C.min_max(F.col(s).cast("double"), ranges[f"{s}_lo"], ranges[f"{s}_hi"])
              for s in SIGNALS}

    def demand(resource: str) -> Column:
        total = F.lit(0.0)
        for driver, weight in S.FLEET_DRIVERS[resource].items():
            total = total + scaled[driver] * weight
        return total

    rows = F.array(*[
        F.struct(F.lit(r).alias("resource"), demand(r).alias("demand")) for r in RESOURCES])
    return signals.select("zone", F.explode(rows).alias("d")).select("zone", "d.*")


def largest_remainder(demand: DataFrame, fleet: dict[str, int] | None = None,
                      floors: dict[str, int] | None = None) -> DataFrame:
    """(zone, resource, demand, units): whole units that add up to the fleet.

    Every zone gets its floor. The rest is shared by demand; what rounding leaves over goes
    to the largest fractions, then by zone name. Without demand the rest goes round by round.
    If the floors alone exceed the fleet, nothing is left to share and the total exceeds it.
    """
    fleet, floors = fleet or S.FLEET, floors or S.FLEET_FLOORS
    pick = lambda table: F.coalesce(F.try_element_at(F.create_map(
        *[F.lit(x) for item in table.items() for x in item]), F.col("resource")), F.lit(0))
    each = Window.partitionBy("resource")
    sized = demand.withColumns({
        "n": F.count(F.lit(1)).over(each), "total": F.sum("demand").over(
            each.orderBy("zone").rowsBetween(
                Window.unboundedPreceding, Window.unboundedFollowing)),
        "floor": pick(floors)}).withColumn(
        "rest", F.greatest(F.lit(0), pick(fleet) - F.col("floor") * F.col("n")))
    quota = F.when(F.col("total") > 0, F.col("demand") / F.col("total") * F.col("rest")).otherwise(
        F.lit(0.0))
    shared = sized.withColumn("quota", quota).withColumns({
        "whole": F.floor("quota").cast("long"), "part": F.col("quota") - F.floor("quota")})
    by_part = each.orderBy(F.desc("part"), "zone")
    by_demand = each.orderBy(F.desc("demand"), "zone")
    left = shared.withColumns({
        "left": F.col("rest") - F.sum("whole").over(each),
        "place": F.when(F.col("total") > 0, F.row_number().over(by_part)).otherwise(
            F.row_number().over(by_demand))})
    turns = F.floor(F.col("left") / F.col("n")) + (
        F.col("place") <= F.col("left") % F.col("n")).cast("long")
    return left.select("zone", "resource", "demand",
                       (F.col("whole") + turns + F.col("floor")).cast("long").alias("units"))


def _rationale() -> Column:
    count = lambda c, word: F.when(
        F.col(c) > 0, F.concat(F.col(c).cast("long").cast("string"), F.lit(f" {word}")))
    why = F.concat_ws(
        ", ", count("breakdown", "breakdowns"), count("accident", "accidents"),
        F.when(F.col("road_health") > 50, "poor road health"),
        F.when(F.col("hotspot") > 0, "active hotspots"))
    return F.format_string(
        "Tow %d, Police %d, Maint %d - driven by %s.", "tow_trucks", "traffic_police",
        "maintenance_teams", F.when(why == "", "baseline coverage").otherwise(why))


def allocate(signals: DataFrame) -> DataFrame:
    """One row per zone: units, demand per resource, rank, raw signals and the reason.

    The signals are used several times; writing their one row per zone first keeps the event
    table from being aggregated again for each use.
    """
    signals = cut(signals)
    shares = largest_remainder(zone_demand(signals))
    wide = shares.groupBy("zone").agg(*[
        F.max(F.when(F.col("resource") == r, F.col(c))).alias(a)
        for r in RESOURCES for c, a in (("units", r), ("demand", f"raw_{r}"))])
    total = F.lit(0.0)
    for r in RESOURCES:
        total = total + F.col(f"raw_{r}")
    joined = wide.withColumn("total_demand", C.half_even(total, 3)).join(signals, "zone")
    shown = joined.withColumns({s: C.half_even(F.col(s), 2)
                                for s in ("risk", "road_health", "hotspot")})
    # One row per zone: the only unpartitioned ranking, on a table of areas.
    rank = F.rank().over(Window.orderBy(F.desc("total_demand")))
    return shown.select(
        "zone", *[x for r in RESOURCES for x in (
            C.half_even(F.col(f"raw_{r}"), 3).alias(f"demand_{r}"), r)],
        "total_demand", rank.cast("int").alias("priority_rank"), "total_events", "breakdown",
        "accident", "risk", "road_health", "hotspot", _rationale().alias("rationale"))


def ranked(plan: DataFrame) -> DataFrame:
    return plan.orderBy("priority_rank", "zone")


def allocate_resources(df: DataFrame, zone_health: DataFrame | None = None,
                       hotspots: DataFrame | None = None) -> DataFrame:
    return ranked(allocate(zone_signals(df, zone_health, hotspots)))


def allocation_long(plan: DataFrame) -> DataFrame:
    return plan.select("zone", *RESOURCES).unpivot("zone", RESOURCES, "resource", "units")


def allocation_totals(plan: DataFrame) -> DataFrame:
    """Units given out per resource next to the configured fleet."""
    size = F.create_map(*[F.lit(x) for item in S.FLEET.items() for x in item])
    return allocation_long(plan).groupBy("resource").agg(
        F.sum("units").alias("allocated"), F.count(F.lit(1)).alias("zones")).withColumn(
        "fleet", F.element_at(size, F.col("resource")).cast("long"))


def top_zone(plan: DataFrame) -> DataFrame:
    return ranked(plan).limit(1)
