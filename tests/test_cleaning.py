import datetime as dt

import pytest
from pyspark.sql import functions as F

from curbsight.operators import cleaning, features, quality, road_health
from curbsight.sources.incidents import as_of_column, load_incidents


def rows_of(df, *names):
    return [tuple(r) for r in df.select(*names).collect()]


def test_numbers_and_times(spark):
    words = ["12.5", " 1e1 ", "1.0d", "Infinity", "", "nan", ".5", "1.", None]
    df = spark.createDataFrame([(w, "2024-01-02 03:04:05") for w in words],
                               "latitude string, start_datetime string")
    got = [r[0] for r in cleaning.coerce_types(df).select("latitude").collect()]
    assert got == [12.5, 10.0, None, None, None, None, 0.5, 1.0, None]


def test_formats_do_not_depend_on_the_session_zone(spark):
    from curbsight.functions import columns as C

    zone = spark.conf.get("spark.sql.session.timeZone")
    df = spark.createDataFrame([("10/03/2024 02:30",)], "x string")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        got = df.select(C.to_utc(F.col("x"), ["dd/MM/yyyy HH:mm", "MM/dd/yyyy HH:mm"])).first()[0]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert got == dt.datetime(2024, 3, 10, 2, 30) and dt.datetime(2024, 10, 3) != got


def test_times_do_not_depend_on_the_session_zone(spark):
    words = ["2024-01-02 03:04:05", "2024-01-02T03:04:05Z", "2024-01-02 08:34:05+05:30",
             "2024-01-02 03:04:05.250000+00", "2024-01-02", "soon", None]
    df = spark.createDataFrame([(w,) for w in words], "start_datetime string")
    before = spark.conf.get("spark.sql.session.timeZone")
    seen = []
    try:
        for zone in ("UTC", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            seen.append([r[0] for r in cleaning.coerce_types(df).collect()])
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    t = dt.datetime(2024, 1, 2, 3, 4, 5)
    assert seen[0] == seen[1] == [
        t, t, t, t.replace(microsecond=250000), dt.datetime(2024, 1, 2), None, None]


def test_geo_cases(spark):
    rows = [(1, 0.0, 77.6, None, None), (2, 14.0, 77.6, None, None), (3, None, 80.0, None, None),
            (4, 12.9, 77.6, 12.9, None), (5, 12.9, 77.6, 12.9, 77.6)]
    df = spark.createDataFrame(
        rows, "id int, latitude double, longitude double, endlatitude double, endlongitude double")
    got = rows_of(cleaning.fix_geo(df).orderBy("id"), "latitude", "longitude", "is_segment_event")
    assert got == [(None, 77.6, False), (None, None, False), (None, None, False),
                   (12.9, 77.6, False), (12.9, 77.6, True)]


def test_time_cases(spark):
    t = dt.datetime(2024, 1, 1)
    h = lambda x: t + dt.timedelta(hours=x)
    rows = [(1, None, None, None), (2, t, h(-1), None), (3, t, dt.datetime(2024, 5, 3), None),
            (4, t, h(5), h(-1)), (5, t, h(0), None), (6, t, h(720), None),
            (7, t, h(720) + dt.timedelta(seconds=1), None)]
    df = spark.createDataFrame(
        rows, "id int, start_datetime timestamp_ntz, end_datetime timestamp_ntz, closed_datetime timestamp_ntz")
    out = cleaning.resolution_hours(cleaning.fix_temporal(df, as_of_column())).orderBy("id")
    assert rows_of(out, "id", "resolution_hours") == [
        (2, None), (3, None), (4, None), (5, 0.0), (6, 720.0), (7, None)]


def test_cause_cases(spark):
    df = spark.createDataFrame(
        [("Debris",), ("Fog / Low Visibility",), (" Fog / Low Visibility",), ("\tAccident \n",), (None,)],
        "event_cause string")
    assert [r[0] for r in cleaning.normalise_categoricals(df).collect()] == [
        "debris", "fog", "fog / low visibility", "accident", None]


def test_spans_do_not_depend_on_the_session_zone(spark, sf):
    before = spark.conf.get("spark.sql.session.timeZone")
    seen = []
    try:
        for zone in ("UTC", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            rows = features.temporal_features(
                cleaning.prepare(load_incidents(spark, sf), as_of_column()))
            seen.append(sorted((r.id, r.resolution_hours, r.hour, str(r.date)) for r in rows.select(
                "id", F.coalesce("resolution_hours", F.lit(-1.0)).alias("resolution_hours"), "hour",
                "date").collect()))
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert seen[0] == seen[1]


@pytest.mark.parametrize("parts", [2, 7])
def test_dedupe_keeps_the_first_and_limits_before_the_shuffle(spark, parts):
    rows = [(i, None, None, None, "a" if i % 2 else "b") for i in range(9, 0, -1)]
    df = spark.createDataFrame(
        rows, "ordinal long, latitude double, longitude double, start_datetime timestamp_ntz, event_cause string"
    ).repartition(parts)
    out = cleaning.dedupe(df)
    assert sorted(r.ordinal for r in out.collect()) == [1, 2]
    plan = out._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_optional_columns_may_be_missing(spark, sf):
    df = load_incidents(spark, sf).drop("zone", "corridor", "endlatitude", "endlongitude", "veh_type")
    out = cleaning.clean(df, as_of_column())
    assert out.count() == 1000 and "is_segment_event" not in out.columns


def test_half_even_cells_and_missing_places(spark):
    df = spark.createDataFrame([(12.9725, 77.5945), (None, None)], "latitude double, longitude double")
    assert rows_of(features.geo_features(df), "geo_cell") == [("12.972_77.594",), ("nan_nan",)]


def test_duration_without_any_hours(spark):
    df = spark.createDataFrame([(None,), (None,)], "resolution_hours double")
    assert rows_of(features.duration_norm(df), "duration_norm") == [(0.3,), (0.3,)]


def test_missing_column_is_an_error_row(spark, sf):
    report = quality.checks(load_incidents(spark, sf).drop("priority"), as_of_column())
    bad = report.filter("severity = 'ERROR'").collect()
    assert [r.name for r in bad] == ["schema.required_columns"]
    with pytest.raises(ValueError):
        quality.require_passed(report)


def test_one_flat_segment_without_accidents(spark):
    df = spark.createDataFrame(
        [("1", "Z", "C", "pot_holes", "g"), ("2", "Z", "C", "pot_holes", "g")],
        "id string, zone string, corridor string, event_cause string, geo_cell string")
    row = road_health.road_health(df, ["zone"]).first()
    assert row.health_score == 100.0 and row.top_factor == "pot_holes"
    weights = {r.cause: r.weight for r in road_health.data_weights(df).collect()}
    assert weights["pot_holes"] == 1.0 and weights["accident"] == 0.0


def test_category_bounds(spark):
    df = spark.createDataFrame([(x,) for x in (20.0, 20.1, 40.0, 60.0, 80.0, 80.1)], "s double")
    assert [r[0] for r in df.select(road_health.category(F.col("s"))).collect()] == [
        "Critical", "Poor", "Poor", "Moderate", "Good", "Excellent"]
