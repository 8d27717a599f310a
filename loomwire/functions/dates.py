"""Dates of feeds, all read as UTC where they name no zone; what can't be read is null and drops out of every window."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_PATTERNS = ("d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm:ss z", "d MMM yyyy HH:mm:ss", "d MMM yyyy HH:mm Z", "yyyy-MM-dd HH:mm:ss")


def feed_date(c: Column) -> Column:
    """RFC 822 with or without a zone, or ISO 8601."""
    iso = F.try_to_timestamp(F.trim(c))
    mail = F.regexp_replace(F.trim(c), r"^[A-Za-z]{3,9},?\s+", "")
    return F.coalesce(*(F.try_to_timestamp(mail, F.lit(p)) for p in _PATTERNS[:4]), iso, F.try_to_timestamp(F.trim(c), F.lit(_PATTERNS[4])))


def stamp_in_url(url: Column, zone: str = "Asia/Hong_Kong") -> Column:
    """The local time of a breaking-news URL, `/yyyyMMdd/bkn-yyyyMMddHHmmss...`, as UTC."""
    return F.to_utc_timestamp(F.try_to_timestamp(F.regexp_extract(url, r"/\d{8}/bkn-(\d{14})", 1), F.lit("yyyyMMddHHmmss")), zone)


def strict_date(c: Column) -> Column:
    """yyyy-m-d, padded or not; slashes are refused."""
    return F.when(F.trim(c).rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), F.try_to_date(F.trim(c), "yyyy-M-d"))


def rfc822(c: Column) -> Column:
    return F.concat(F.date_format(c, "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" +0000"))


def relative(ts: Column, now: Column) -> Column:
    """Age in rounded minutes below 60, in rounded hours below 48, else in rounded days; empty for no date."""
    s = F.greatest(F.lit(0.0), (F.unix_micros(now.cast("timestamp")) - F.unix_micros(ts.cast("timestamp"))) / 1e6)
    whole = lambda unit: F.floor(s / unit + 0.5)
    told = lambda unit, name: F.concat(whole(unit).cast("string"), F.lit(f" {name}"))
    return F.when(ts.isNull(), "").when(s < 60, "just now").when(whole(60) < 60, told(60, "min")).when(whole(3600) < 48, told(3600, "h")).otherwise(told(86400, "d"))
