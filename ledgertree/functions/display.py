"""Human-readable sizes, ages and durations."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ledgertree.schema import CREATED, DELETED, RENAMED


def human_size(size: Column) -> Column:
    """1536 -> "1.50 KB"; exact halves round to even."""
    out = F.concat(size.cast("string"), F.lit(" B"))
    for power, unit in enumerate(["KB", "MB", "GB", "TB"], start=1):
        scale = 1024**power
        out = F.when(
            size >= scale,
            F.concat(F.format_string("%.2f", F.bround(size.cast("double") / F.lit(float(scale)), 2)), F.lit(" " + unit)),
        ).otherwise(out)
    return out


def human_delta(delta: Column) -> Column:
    return (
        F.when(delta > 0, F.concat(F.lit("+"), human_size(delta)))
        .when(delta < 0, F.concat(F.lit("-"), human_size(-delta)))
        .otherwise(F.lit("0 B"))
    )


def exact_delta(delta: Column) -> Column:
    sign = F.when(delta > 0, F.lit("+")).otherwise(F.lit(""))
    return F.concat(sign, delta.cast("string"), F.lit(" B"))


def relative_age(at: Column, now: Column) -> Column:
    """"just now", "5m ago", "3h ago", "12d ago"."""
    secs = F.unix_timestamp(now) - F.unix_timestamp(at)

    def ago(unit: int, letter: str) -> Column:
        return F.concat(F.floor(secs / unit).cast("string"), F.lit(f"{letter} ago"))

    return (
        F.when(secs < 60, F.lit("just now"))
        .when(secs < 3600, ago(60, "m"))
        .when(secs < 86400, ago(3600, "h"))
        .otherwise(ago(86400, "d"))
    )


# Unit spellings -> seconds. "m" is a month of 30 days.
DURATION_UNITS = {
    1: ["s", "sec", "second", "seconds"],
    60: ["min", "minute", "minutes"],
    3600: ["h", "hr", "hour", "hours"],
    86400: ["", "d", "day", "days"],
    604800: ["w", "week", "weeks"],
    2592000: ["m", "mo", "month", "months"],
    31536000: ["y", "year", "years"],
}
# Shortest and longest retention, in seconds.
RETENTION_MIN, RETENTION_MAX = 3600, 3650 * 86400


def duration_seconds(text: Column) -> Column:
    """Seconds of "30d", "24h", "1min"; NULL when it is not a positive duration."""
    norm = F.lower(F.trim(text))
    number = F.regexp_extract(norm, r"^([0-9]+)\s*[^0-9]*$", 1)
    unit = F.trim(F.regexp_extract(norm, r"^[0-9]+([^0-9]*)$", 1))
    scale = F.lit(None).cast("long")
    for seconds, names in DURATION_UNITS.items():
        scale = F.when(unit.isin(names), F.lit(seconds).cast("long")).otherwise(scale)
    secs = F.when(number != "", number).try_cast("long") * scale
    return F.when(secs > 0, secs)


def duration_problem(text: Column) -> Column:
    """Why ``text`` is no valid retention; NULL when it is."""
    norm = F.lower(F.trim(text))
    secs = duration_seconds(text)
    return (
        F.when(norm.isNull() | (norm == ""), F.lit("empty"))
        .when(~norm.rlike("[0-9]"), F.lit("no number"))
        .when(norm.rlike("[^0-9][0-9]"), F.lit("digit after unit"))
        .when(norm.rlike("^0+[^0-9]*$"), F.lit("not positive"))
        .when(secs.isNull(), F.lit("unknown unit"))
        .when((secs < RETENTION_MIN) | (secs > RETENTION_MAX), F.lit("out of range"))
    )


def displayable(kind: Column, delta: Column) -> Column:
    """Creations, deletions and renames always show; other rows need two bytes of change."""
    return kind.isin(CREATED, DELETED, RENAMED) | (F.abs(delta) >= 2)
