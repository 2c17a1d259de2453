"""Clock arithmetic on an integer microsecond key, and calendar helpers."""

from __future__ import annotations

import calendar
import math
from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

CHICAGO = "America/Chicago"
WEEKDAY_NAMES = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")


@dataclass(frozen=True)
class Clock:
    """The bar spacing: one unit in microseconds and the suffix used in column names."""

    micros: int
    suffix: str

    def span(self, units: int) -> int:
        return units * self.micros

    def name(self, prefix: str, units: int) -> str:
        return f"{prefix}_{units}{self.suffix}"


MINUTE = Clock(60_000_000, "m")
HOUR = Clock(3_600_000_000, "h")
DAY = Clock(86_400_000_000, "d")


def micros(ts: Column) -> Column:
    """Microseconds since the epoch (UTC session time zone assumed for zone-less input)."""
    return F.unix_micros(ts.cast("timestamp"))


def floor_div(value: Column, divisor: int) -> Column:
    """Floor division for bigint columns, also right for negative values."""
    return F.call_function("div", value - F.pmod(value, F.lit(divisor)), F.lit(divisor))


def local_clock_columns(ts: Column, zone: str = CHICAGO) -> dict[str, Column]:
    """Local hour, minute, weekday (Monday = 0) and their sine/cosine positions."""
    local = F.from_utc_timestamp(ts, zone)
    hour, minute, weekday = F.hour(local), F.minute(local), F.weekday(local)
    day_angle = (hour.cast("double") * 60.0 + minute.cast("double")) * (2 * math.pi) / 1440
    week_angle = weekday.cast("double") * (2 * math.pi) / 7
    return {
        "chicago_timestamp": local,
        "chicago_hour": hour,
        "chicago_minute": minute,
        "chicago_day_of_week": weekday,
        "hour_sin": F.sin(day_angle),
        "hour_cos": F.cos(day_angle),
        "day_of_week_sin": F.sin(week_angle),
        "day_of_week_cos": F.cos(week_angle),
    }


def weekday_name(weekday: Column) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in WEEKDAY_NAMES]), weekday.cast("int") + 1)


def months_before(day: date, months: int) -> date:
    """Whole calendar months earlier, clamped to the last day of the target month."""
    year, month0 = divmod(day.year * 12 + day.month - 1 - months, 12)
    return date(year, month0 + 1, min(day.day, calendar.monthrange(year, month0 + 1)[1]))


def years_before(day: Column, years: Column) -> Column:
    """Whole years earlier; 29 February becomes 28 February."""
    return F.add_months(day, -12 * years)
