"""Scalar helpers, inside code generation except for ``number_list``."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def parse_bool(c: Column) -> Column:
    """Text truth: true, 1 or yes in any case, trimmed; null is false."""
    return F.coalesce(F.lower(F.trim(c.cast("string"))).isin("true", "1", "yes"), F.lit(False))


def review_flag(c: Column) -> Column:
    """Three-valued truth of a review flag: empty, null or anything else than a truth word stays unknown."""
    word = F.lower(F.trim(c.cast("string")))
    return F.when(word.isin("true", "1", "1.0", "yes"), F.lit(True)).when(word.isin("false", "0", "0.0", "no"), F.lit(False))


def iso_format(c: Column, zone: str = "UTC") -> Column:
    """An instant as ISO 8601 text with the offset of ``zone`` at that instant."""
    local = F.from_utc_timestamp(c, zone)
    minutes = ((F.unix_seconds(local) - F.unix_seconds(c)) / 60).cast("int")
    offset = F.format_string("%s%02d:%02d", F.when(minutes < 0, "-").otherwise("+"), F.floor(F.abs(minutes) / 60).cast("int"), F.abs(minutes) % 60)
    return F.concat(F.date_format(F.to_utc_timestamp(local, "UTC"), "yyyy-MM-dd'T'HH:mm:ss"), offset)


def category_label(number: Column, name: Column) -> Column:
    """``name (number)``, whichever of the two is known, or ``uncategorised``."""
    both = F.when(name.isNotNull() & number.isNotNull(), F.format_string("%s (%d)", name, number))
    return F.coalesce(both, name, F.when(number.isNotNull(), F.format_string("category %d", number)), F.lit("uncategorised"))


def finite(c: Column) -> Column:
    """The number, or null if it can't be read or isn't finite."""
    x = F.try_cast(c, "double") if hasattr(F, "try_cast") else c.try_cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == F.lit(float("inf"))), F.lit(None)).otherwise(x)


def binary_round(x: Column, places: int) -> Column:
    """Rounded as DuckDB does: x * 10**places to the nearest whole number, halves away from zero.

    Spark's own round takes halves of the decimal text: 43.472812499999996, whose product is 43472812.5, goes down there.
    """
    y = x * F.lit(float(10**places))
    return F.when(F.abs(y) < F.lit(float("inf")), F.signum(y) * F.round(F.abs(y)) / F.lit(float(10**places))).otherwise(x)


@F.pandas_udf(StringType())
def number_list(lists: pd.Series) -> pd.Series:
    """Lists of doubles as DuckDB writes them.  Digits and exponents are those of repr; a cast has exponents from 1e7 on
    and, before Java 19, now and then a digit too many."""
    return lists.map(lambda a: f"[{', '.join(map(repr, a.tolist()))}]")


def stable_hex(c: Column) -> Column:
    """First 16 hex digits of SHA-256: their order is that of the 64-bit number."""
    return F.substring(F.sha2(c.cast("string"), 256), 1, 16)


def stable_number(c: Column) -> Column:
    return F.conv(stable_hex(c), 16, 10).cast("decimal(20,0)")


def event_id(*parts: Column, prefix: str | None = None) -> Column:
    """First 16 hex digits of SHA-1 over the parts joined by ``|``."""
    cols = ([F.lit(prefix)] if prefix else []) + [p.cast("string") for p in parts]
    return F.substring(F.sha1(F.concat_ws("|", *cols)), 1, 16)


def json_length(c: Column) -> Column:
    return F.coalesce(F.json_array_length(c), F.lit(0))


def json_or(c: Column, schema: str, default: Column) -> Column:
    return F.coalesce(F.from_json(c, schema), default)


def device_of(series: Column) -> Column:
    return F.regexp_extract(series, r"^(.+)_(\d+)$", 1)


def channel_of(series: Column) -> Column:
    return F.regexp_extract(series, r"^(.+)_(\d+)$", 2).try_cast("int")


def soft_threshold(x: Column, t) -> Column:
    return F.signum(x) * F.greatest(F.abs(x) - t, F.lit(0.0))


def flag_label(flag: Column) -> Column:
    """normal, anomaly or unavailable; unknown is not normal."""
    return F.when(flag.isNull(), "unavailable").when(flag, "anomaly").otherwise("normal")


def calendar(day: Column) -> list[Column]:
    """Sine and cosine of day of year and of weekday (Monday 0)."""
    doy, dow = 2 * F.pi() * F.dayofyear(day) / F.lit(365.25), 2 * F.pi() * F.weekday(day) / F.lit(7)
    return [F.sin(doy).alias("sin_doy"), F.cos(doy).alias("cos_doy"), F.sin(dow).alias("sin_dow"), F.cos(dow).alias("cos_dow")]
