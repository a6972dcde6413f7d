"""Column helpers: exact decimals, ordered and accumulated reasons, ranks, ISO weeks, identities.

All are Catalyst expressions; none needs a Python worker.
"""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def dec(text: Column | str) -> Column:
    """Text as an exact decimal(38,30), or null: not a number, not finite, or more than 30 fractional digits (never rounded)."""
    c = F.col(text) if isinstance(text, str) else text
    return F.when(F.regexp_extract(c, r"\.([0-9]*)", 1).rlike("^[0-9]{0,30}$"), c.try_cast("decimal(38,30)"))


def finite(c: Column) -> Column:
    """Not null, not NaN, not infinite."""
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def first_reason(*rules: tuple[Column, str]) -> Column:
    """The name of the first rule that holds, or null."""
    out = None
    for condition, name in rules:
        out = F.when(condition, name) if out is None else out.when(condition, name)
    return out


def all_reasons(*rules: tuple[Column, str]) -> Column:
    """The names of all rules that hold, joined by semicolons in their order."""
    return F.concat_ws(";", *[F.when(condition, F.lit(name)) for condition, name in rules])


def strip(c: Column) -> Column:
    """Without leading and trailing white space of any kind."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def rank_pct(value: Column, *partition: str) -> Column:
    """The percentile rank in (0, 1]; ties share the average of their places."""
    w = Window.partitionBy(*partition).orderBy(value)
    same, everyone = Window.partitionBy(*partition, value), Window.partitionBy(*partition)
    return (F.rank().over(w) + (F.count("*").over(same) - 1) / 2) / F.count("*").over(everyone)


def iso_week(ts: Column) -> Column:
    """YYYY-Www by the ISO year."""
    return F.format_string("%d-W%02d", F.extract(F.lit("YEAROFWEEK"), ts).cast("int"), F.weekofyear(ts))


def period(hour: Column) -> Column:
    """night 20-4, dawn 5-8, day 9-16, dusk 17-19."""
    return F.when((hour >= 5) & (hour <= 8), "dawn").when((hour >= 9) & (hour <= 16), "day").when((hour >= 17) & (hour <= 19), "dusk").otherwise("night")


def micros(ts: Column | str) -> Column:
    """Microseconds of a timestamp without zone, whatever the session's zone is."""
    name = ts if isinstance(ts, str) else ts._jc.toString()
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {name})")


def short_hash(c: Column, digits: int = 24) -> Column:
    """The first hexadecimal digits of SHA-256."""
    return F.substring(F.sha2(c, 256), 1, digits)


def logical_id(year: Column, site: Column, stamp: Column, path: Column) -> Column:
    """The identity of a recording; a path whose name has no valid time keeps to itself."""
    return short_hash(F.concat_ws("|", year.cast("string"), site, F.coalesce(stamp, F.concat(F.lit("unparsed:"), path))))


def clamp(c: Column, low, high) -> Column:
    return F.greatest(F.lit(low), F.least(c, F.lit(high)))


def safe_path(path: Column) -> Column:
    """A relative path without backslashes, empty, dot or double-dot parts."""
    return (path != "") & ~path.startswith("/") & ~path.contains("\\") & ~path.rlike(r"(^|/)(\.|\.\.|)(/|$)")
