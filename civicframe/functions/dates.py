"""Date functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .missing import _col


# Names of the months.
MONTHS = [
    "january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december",
]
#: Month as number or name, day, year; between them anything but letters and digits.
_PARTED = r"^\s*([0-9]{1,2}|[A-Za-z]{3,9})[^0-9A-Za-z]+([0-9]{1,2})(?:st|nd|rd|th)?[^0-9A-Za-z]+([0-9]{4}|[0-9]{2})\s*$"
#: The same without anything between: two digits each, four or two for the year.
_SOLID = r"^\s*([0-9]{2})([0-9]{2})([0-9]{4}|[0-9]{2})\s*$"


def month_day_year(c: Column | str) -> Column:
    """Date from text in the order month, day, year; text that holds no such date gives missing.

    Takes ``3/6/2021``, ``03-06-2021``, ``3.6.21``, ``March 6, 2021``, ``Mar 6th 2021`` and ``03062021``. Years of two digits
    from 69 on are of the last century, others of this one. A month's name may be cut to three letters.
    """
    text = _col(c).cast("string")
    solid = text.rlike(_SOLID)

    def part(n: int) -> Column:
        return F.when(solid, F.regexp_extract(text, _SOLID, n)).otherwise(F.regexp_extract(text, _PARTED, n))

    named = F.lower(part(1))
    month = F.coalesce(
        *(F.when(named.isin(name, name[:3]), F.lit(i)) for i, name in enumerate(MONTHS, 1)), F.expr("CAST(NULL AS INT)")
    )
    month = F.coalesce(month, part(1).try_cast("int"))
    year = part(3).try_cast("int")
    century = F.when(F.length(part(3)) > 2, 0).when(year < 69, 2000).otherwise(1900)
    return F.try_to_date(F.concat_ws("-", F.lpad((year + century).cast("string"), 4, "0"), month.cast("string"), part(2)), "yyyy-M-d")


def month_floor(c: Column | str) -> Column:
    """First instant of the month."""
    return F.date_trunc("month", _col(c))


def epoch_seconds(c: Column | str) -> Column:
    return F.unix_timestamp(_col(c).cast("timestamp"))


def from_epoch_seconds(c: Column | str) -> Column:
    return F.timestamp_seconds(_col(c))
