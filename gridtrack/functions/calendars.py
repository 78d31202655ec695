"""Calendar arithmetic on hour numbers, for calendars that Spark has no type for."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Days before each month of a year without a leap day.
NOLEAP_STARTS = (0, 31, 59, 90, 120, 151, 181, 212, 243, 273, 304, 334)


def parts(hour: Column, calendar: str, first_year: int) -> dict[str, Column]:
    """year, month, day and hour of hours since 1 January of first_year; calendar: noleap or 360_day."""
    day = F.floor(hour / 24)
    if calendar == "360_day":
        of_year = F.pmod(day, F.lit(360))
        year, month, mday = F.floor(day / 360) + first_year, F.floor(of_year / 30) + 1, of_year % 30 + 1
    elif calendar == "noleap":
        of_year = F.pmod(day, F.lit(365))
        year = F.floor(day / 365) + first_year
        starts = F.array(*map(F.lit, NOLEAP_STARTS))
        month = F.size(F.filter(starts, lambda s: s <= of_year))
        mday = of_year - F.get(starts, month - 1) + 1
    else:
        raise ValueError(f"calendar {calendar!r}: use timestamps for the standard one")
    return {"year": year.cast("int"), "month": month.cast("int"), "day": mday.cast("int"), "hour": F.pmod(hour, F.lit(24)).cast("int")}
