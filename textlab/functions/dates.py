"""Twitter time stamps and the bi-week key."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textlab.functions.clean import _c

# Day names cannot be parsed by Spark's pattern letter E, so the leading
# "Tue " is cut off and the rest parsed; the zone is fixed at +0000.
TWITTER_FORMAT_NO_DAY = "MMM dd HH:mm:ss Z yyyy"
# Fixed: the same stamp in strptime letters.
TWITTER_SQL_FORMAT = "%a %b %d %H:%M:%S +0000 %Y"
TWITTER_FORMAT_OUT = "EEE MMM dd HH:mm:ss '+0000' yyyy"


def parse_twitter_time(col) -> Column:
    """``Tue Apr 27 19:49:05 +0000 2021`` -> timestamp (null if malformed)."""
    return F.try_to_timestamp(F.substring(_c(col), 5, 1 << 20), F.lit(TWITTER_FORMAT_NO_DAY))


def format_twitter_time(col) -> Column:
    return F.date_format(_c(col), TWITTER_FORMAT_OUT)


def biweek_key(ts, iso_year: bool = False) -> Column:
    """``{year}-{ISO week // 2}``.  The reference pairs the calendar year with
    the ISO week (2021-01-01 -> ``2021-26``); ``iso_year=True`` uses the ISO
    week-based year instead."""
    t = _c(ts)
    week = F.weekofyear(t)
    year = F.year(t)
    if iso_year:
        # ISO year = year of the Thursday of the same ISO week.
        year = F.year(F.date_add(F.to_date(t), 4 - ((F.dayofweek(t) + 5) % 7 + 1)))
    return F.concat(year.cast("string"), F.lit("-"), F.floor(week / 2).cast("string"))
