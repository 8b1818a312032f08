"""Column expressions shared by the operators; all run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

from curbsight import settings as S

BLANKS = " \t\n\r\f\u000b"
# Plain decimal notation only: Spark's own cast also takes '1.0d' and 'Infinity'.
NUMBER_PATTERN = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
OFFSET_PATTERN = r"([zZ]|UTC|[+-]\d{2}(:?\d{2})?)$"
EPOCH = "timestamp_ntz'1970-01-01 00:00:00'"


def half_even(x: Column, places: int) -> Column:
    """Round half to even at ``places`` decimals (Spark's ``round`` is half-up)."""
    scale = F.lit(float(10 ** places))
    return F.rint(x * scale) / scale + F.lit(0.0)


def clip(x: Column, low: float, high: float) -> Column:
    """Clamp to [low, high]; a null stays null."""
    return F.when(x < low, F.lit(low)).when(x > high, F.lit(high)).otherwise(x)


def strip(x: Column) -> Column:
    """Remove all ASCII white space at both ends, tabs and newlines included."""
    return F.btrim(x, F.lit(BLANKS))


def to_number(x: Column) -> Column:
    return F.when(x.rlike(NUMBER_PATTERN), strip(x).try_cast("double"))


def to_utc(x: Column, formats: list[str] | None = None) -> Column:
    """Parse text to a UTC wall-clock ``TIMESTAMP_NTZ``; what cannot be parsed is null.

    Text without an offset counts as UTC. The result does not depend on the session
    time zone. ``formats`` are tried in order after the ISO forms.
    """
    text = strip(x)
    zoned = F.when(text.rlike(OFFSET_PATTERN) & text.rlike(r"\d:\d"), text).otherwise(
        F.concat(F.when(text.rlike(r"\d:\d"), text).otherwise(
            F.concat(text, F.lit(" 00:00:00"))), F.lit("+00:00")))
    parsed = zoned.try_cast("timestamp")
    utc = ntz_from_micros(F.unix_micros(parsed))
    if formats:
        # Wall-clock formats get the offset of UTC, so the session zone has no say.
        utc = F.coalesce(utc, *[ntz_from_micros(F.unix_micros(F.try_to_timestamp(
            F.concat(text, F.lit(" +00:00")), F.lit(f"{f} XXX")))) for f in formats])
    return utc


def ntz_from_micros(micros: Column) -> Column:
    return F.timestamp_add("MICROSECOND", micros, F.expr(EPOCH))


def micros_between(start: Column, end: Column) -> Column:
    """Microseconds from ``start`` to ``end``, both UTC wall clock.

    ``timestamp_diff`` would read them in the session zone, with its clock changes; the
    difference of two wall-clock timestamps does not.
    """
    span = (end - start).cast(T.DayTimeIntervalType(3, 3)).cast(T.DecimalType(20, 6))
    return (span * 1_000_000).cast("long")


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a UTC wall-clock timestamp."""
    return micros_between(F.expr(EPOCH), ts)


def local_time(ts: Column) -> Column:
    return F.convert_timezone(F.lit("UTC"), F.lit(S.LOCAL_ZONE), ts)


def haversine_term(lat1, lon1, lat2, lon2) -> Column:
    """The haversine 'a' in [0, 1]; it grows with the great-circle distance."""
    dlat = F.radians(lat2 - lat1) / 2
    dlon = F.radians(lon2 - lon1) / 2
    return (F.sin(dlat) * F.sin(dlat)
            + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(dlon) * F.sin(dlon))


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    return F.lit(S.EARTH_RADIUS_M / 1000) * 2 * F.asin(
        F.sqrt(haversine_term(lat1, lon1, lat2, lon2)))


def lookup(x: Column, table: dict[str, float], default: float) -> Column:
    pairs = [F.lit(v) for item in table.items() for v in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), x), F.lit(default))


def min_max(x: Column, low: Column, high: Column) -> Column:
    """Scale to [0, 1]; a flat range gives 0."""
    span = high - low
    return F.when(span < S.FLAT_RANGE, F.lit(0.0)).otherwise((x - low) / span)


def fixed_sum(x: Column, places: int) -> Column:
    """Sum of ``x`` at a fixed number of decimals, as scaled whole units.

    Integer addition has no rounding, so the sum does not change with the partitioning
    or the order of the rows, and DECIMAL(38) leaves no room for overflow.
    """
    units = F.rint(x * F.lit(float(10 ** places))).cast("long").cast(T.DecimalType(20, 0))
    return F.sum(units).cast("double")


def fixed_mean(x: Column, places: int) -> Column:
    return fixed_sum(x, places) / F.count(x) / F.lit(float(10 ** places))


def tally(condition: Column) -> Column:
    """Number of rows where the condition holds."""
    return F.count_if(condition)


def spread(frame_key: Column, seed: int) -> Column:
    """Seeded pseudo-random order that stays the same under repartitioning."""
    return F.xxhash64(frame_key, F.lit(seed))
