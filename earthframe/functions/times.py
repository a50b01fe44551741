"""Time helpers that do not depend on the session time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: An ISO-8601 instant; group 2 is its zone designator, empty when it has none.
ISO_INSTANT = (
    r"^(\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d{1,6})?)?)?)"
    r"(Z|[+-]\d{2}:?\d{2})?$"
)


def epoch_micros(ts_ntz: Column) -> Column:
    """Microseconds since 1970 of a zone-less timestamp, read as UTC."""
    origin = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_diff("MICROSECOND", origin, ts_ntz)


def zone_aware(text: Column) -> Column:
    """Whether an ISO text states its zone; NULL when it is not an instant."""
    return F.when(
        text.rlike(ISO_INSTANT) & instant_local(text).isNotNull(),
        F.regexp_extract(text, ISO_INSTANT, 2) != "",
    )


def instant_local(text: Column) -> Column:
    """The wall-clock part of an ISO text, NULL when it names no real moment."""
    return F.regexp_extract(text, ISO_INSTANT, 1).try_cast("timestamp_ntz")


def instant_micros(text: Column) -> Column:
    """The UTC instant of an ISO text in microseconds; a naive one counts as UTC."""
    zone = F.regexp_replace(F.regexp_extract(text, ISO_INSTANT, 2), ":", "")
    sign = F.when(zone.startswith("-"), F.lit(-1)).otherwise(F.lit(1))
    minutes = (
        F.substring(zone, 2, 2).try_cast("int") * 60
        + F.substring(zone, 4, 2).try_cast("int")
    )
    shift = F.when(zone.isin("", "Z"), F.lit(0)).otherwise(sign * minutes)
    return F.when(
        text.rlike(ISO_INSTANT),
        epoch_micros(instant_local(text)) - shift.cast("bigint") * F.lit(60_000_000),
    )


def separation_days(a: Column, b: Column) -> Column:
    """|a - b| in days of two ISO texts; NULL if either is unknown or zones are mixed."""
    same_kind = zone_aware(a) == zone_aware(b)
    return F.when(
        same_kind, F.abs(instant_micros(a) - instant_micros(b)) / F.lit(86_400_000_000.0)
    )
