"""Date and time methods of expressions, over timestamps without a zone.

Truncation to multiples of a unit counts from 1970-01-01 (weeks from the Monday before).
"""

from __future__ import annotations

import datetime
import re
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.durations import UNITS, offset_parts, to_timedelta
from tessera.functions.nulls import literal

EPOCH = datetime.datetime(1970, 1, 1)
MONDAY = datetime.datetime(1969, 12, 29)
#: Format codes of strftime and the patterns that Spark has for them.
CODES = {
    "Y": "yyyy", "y": "yy", "m": "MM", "d": "dd", "H": "HH", "I": "hh", "M": "mm", "S": "ss", "f": "SSSSSS",
    "j": "DDD", "b": "MMM", "B": "MMMM", "a": "EEE", "A": "EEEE", "p": "a", "F": "yyyy-MM-dd", "T": "HH:mm:ss",
    "D": "MM/dd/yy", "R": "HH:mm", "z": "xx", "Z": "zzz", "n": "\n", "t": "\t", "%": "%",
}
CALENDAR = {"months": 1, "quarters": 3, "years": 12}
PARTS = {
    "YEAR": "year", "MONTH": "month", "DAY": "day", "HOUR": "hour", "MINUTE": "minute", "SECOND": "second",
    "MILLISECOND": "millisecond", "MICROSECOND": "microsecond", "NANOSECOND": "nanosecond", "QUARTER": "quarter",
    "DAY_OF_YEAR": "day_of_year", "WEEKDAY": "day_of_week", "WEEK": "week_of_year", "ISO_YEAR": "iso_year",
    "UNIX_TIME": "unix_timestamp", "TIMEZONE_OFFSET": "timezone_offset",
}


def java_pattern(format: str) -> str:
    """A strftime format as a Spark pattern; other letters are quoted."""
    out = ""
    for code, plain in re.findall(r"%(.?)|([^%]+)", format, re.DOTALL):
        if plain:
            quoted = plain.replace("'", "''")
            out += f"'{quoted}'" if re.search("[A-Za-z']", plain) else plain
        elif code in CODES:
            out += CODES[code]
        else:
            raise ValueError(f"unknown format code in {format!r}")
    return out


def _micros(c: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", F.lit(EPOCH).cast("timestamp_ntz"), c.cast("timestamp_ntz"))


def _unit(unit: str) -> tuple[int, str]:
    text = unit.strip().lower()
    parts = offset_parts(text if text[:1].isdigit() else "1" + _code(text))
    if len(parts) != 1 or parts[0][0] < 1:
        raise ValueError(f"{unit!r} isn't one positive unit")
    return parts[0]


def _code(name: str) -> str:
    for unit, (spellings, code, _) in UNITS.items():
        if name in (unit, *spellings):
            return code
    raise ValueError(f"unknown time unit {name!r}")


class DateTimeMethods:
    """Reached as expr.dt.year() or expr.year(); round, ceil and floor to a unit only as expr.dt."""

    def __init__(self, expr: Any):
        self._expr, self._c = expr, expr.column

    def _s(self, column: Column):
        return self._expr._with(column)

    # ---- parts

    def year(self):
        return self._s(F.year(self._c))

    def month(self):
        return self._s(F.month(self._c))

    def day(self):
        return self._s(F.dayofmonth(self._c))

    def hour(self):
        return self._s(F.hour(self._c))

    def minute(self):
        return self._s(F.minute(self._c))

    def second(self):
        return self._s(F.second(self._c))

    def millisecond(self):
        """Within the second, as microsecond and nanosecond."""
        return self._s(F.floor(F.pmod(_micros(self._c), F.lit(1_000_000)) / 1000))

    def microsecond(self):
        return self._s(F.pmod(_micros(self._c), F.lit(1_000_000)))

    def nanosecond(self):
        return self._s(F.pmod(_micros(self._c), F.lit(1_000_000)) * 1000)

    def quarter(self):
        return self._s(F.quarter(self._c))

    def day_of_year(self):
        return self._s(F.dayofyear(self._c))

    def day_of_week(self):
        """1 is Monday, 7 is Sunday."""
        return self._s(F.weekday(self._c) + 1)

    def week_of_year(self):
        return self._s(F.weekofyear(self._c))

    def iso_year(self):
        return self._s(F.extract(F.lit("YEAROFWEEK"), self._c))

    def unix_timestamp(self):
        return self._s(F.floor(_micros(self._c) / 1_000_000))

    def timezone_offset(self):
        """Seconds; a timestamp without a zone has none."""
        return self._s(F.when(self._c.isNotNull(), F.lit(0)))

    def extract(self, component: str):
        if component.upper() not in PARTS:
            raise ValueError(f"unknown component {component!r}; known: {', '.join(PARTS)}")
        return getattr(self, PARTS[component.upper()])()

    def extract_boolean(self, component: str, timezone: str | None = None):
        if component.upper() == "IS_LEAP_YEAR":
            return self.is_leap_year()
        if component.upper() == "IS_DST":
            return self.is_dst(timezone)
        raise ValueError("component is IS_LEAP_YEAR or IS_DST")

    def is_leap_year(self):
        y = F.year(self._c)
        return self._expr._bool(((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0))

    def is_dst(self, timezone: str | None = None):
        """Whether a local time in the zone is ahead of the zone's least offset of that year; False without a zone."""
        if timezone is None:
            return self._expr._bool(F.when(self._c.isNotNull(), F.lit(False)))

        def offset(c: Column) -> Column:
            return F.timestamp_diff("MINUTE", F.to_utc_timestamp(c.cast("timestamp"), timezone), c.cast("timestamp"))

        start = F.date_trunc("year", self._c)
        return self._expr._bool(offset(self._c) > F.least(offset(start), offset(F.timestamp_add("MONTH", F.lit(6), start))))

    def date(self):
        return self._s(F.to_date(self._c))

    def time(self):
        return self._s(F.date_format(self._c, "HH:mm:ss.SSSSSS"))

    # ---- shifts

    def _add(self, unit: str, n: Any):
        return self._s(F.timestamp_add(unit, literal(n), self._c.cast("timestamp_ntz")))

    def add_years(self, years: Any):
        return self._add("YEAR", years)

    def add_months(self, months: Any):
        return self._add("MONTH", months)

    def add_days(self, days: Any):
        return self._add("DAY", days)

    def add_hours(self, hours: Any):
        return self._add("HOUR", hours)

    def add_minutes(self, minutes: Any):
        return self._add("MINUTE", minutes)

    def add_seconds(self, seconds: Any):
        return self._add("SECOND", seconds)

    def add_milliseconds(self, milliseconds: Any):
        return self._add("MILLISECOND", milliseconds)

    def add_microseconds(self, microseconds: Any):
        return self._add("MICROSECOND", microseconds)

    def offset_by(self, offset: str):
        """By a duration such as "1d2h" or "-3mo"."""
        out = self._c.cast("timestamp_ntz")
        for n, unit in offset_parts(offset):
            out = F.timestamp_add(unit[:-1].upper(), F.lit(n), out)
        return self._s(out)

    # ---- differences

    def diff_years(self, other: Any):
        """Of calendar years, as diff_months of calendar months; the others count whole units elapsed."""
        return self._s(F.year(self._c) - F.year(literal(other)))

    def diff_months(self, other: Any):
        o = literal(other)
        return self._s((F.year(self._c) - F.year(o)) * 12 + F.month(self._c) - F.month(o))

    def _diff(self, unit: str, other: Any):
        return self._s(F.timestamp_diff(unit, literal(other).cast("timestamp_ntz"), self._c.cast("timestamp_ntz")))

    def diff_days(self, other: Any):
        return self._diff("DAY", other)

    def diff_hours(self, other: Any):
        return self._diff("HOUR", other)

    def diff_minutes(self, other: Any):
        return self._diff("MINUTE", other)

    def diff_seconds(self, other: Any):
        return self._diff("SECOND", other)

    def diff_milliseconds(self, other: Any):
        return self._diff("MILLISECOND", other)

    # ---- rounding to a unit

    def _start(self, n: int, unit: str) -> Column:
        c = self._c.cast("timestamp_ntz")
        if unit in CALENDAR:
            size = n * CALENDAR[unit]
            months = F.year(c) * 12 + F.month(c) - 1 - 1970 * 12
            return F.timestamp_add("MONTH", (F.floor(months / size) * size).cast("int"), F.lit(EPOCH).cast("timestamp_ntz"))
        base = F.lit(MONDAY if unit == "weeks" else EPOCH).cast("timestamp_ntz")
        size = F.lit(n * int(datetime.timedelta(**UNITS[unit][2]) / datetime.timedelta(microseconds=1)))
        past = F.timestamp_diff("MICROSECOND", base, c)
        return F.timestamp_add("MICROSECOND", past - F.pmod(past, size), base)

    def _next(self, n: int, unit: str, start: Column) -> Column:
        return F.timestamp_add(unit[:-1].upper(), F.lit(n), start)

    def truncate(self, unit: str):
        return self._s(self._start(*_unit(unit)))

    floor = truncate

    def ceil(self, unit: str):
        start = self._start(*_unit(unit))
        return self._s(F.when(start == self._c.cast("timestamp_ntz"), start).otherwise(self._next(*_unit(unit), start)))

    def round(self, unit: str):
        """To the nearer end of the unit; halves go up."""
        start = self._start(*_unit(unit))
        end, c = self._next(*_unit(unit), start), self._c.cast("timestamp_ntz")
        return self._s(F.when(F.timestamp_diff("MICROSECOND", start, c) * 2 >= F.timestamp_diff("MICROSECOND", start, end), end).otherwise(start))

    def month_start(self):
        return self._s(F.date_trunc("month", self._c.cast("timestamp_ntz")))

    def month_end(self):
        """The month's last day, at the same time of day."""
        c = self._c.cast("timestamp_ntz")
        return self._s(F.timestamp_add("DAY", F.dayofmonth(F.last_day(c)) - F.dayofmonth(c), c))

    def days_in_month(self):
        return self._s(F.dayofmonth(F.last_day(self._c)))

    # ---- zones and formats

    def assume_timezone(self, timezone: str):
        """The instant of a local time in the zone."""
        return self._s(F.convert_timezone(F.lit(timezone), F.lit("UTC"), self._c.cast("timestamp_ntz")))

    def to_timezone(self, timezone: str):
        """A UTC time as local time in the zone."""
        return self._s(F.convert_timezone(F.lit("UTC"), F.lit(timezone), self._c.cast("timestamp_ntz")))

    local_timestamp = to_timezone

    def strftime(self, format: str):
        return self._s(F.date_format(self._c, java_pattern(format)))

    # ---- against the present: the query's own time in the session's zone, the same for every row

    def _ago(self, duration: str, sign: int = -1) -> Column:
        return F.localtimestamp() + F.lit(sign * to_timedelta(duration))

    def within_last(self, duration: str):
        return self._expr._bool(self._c > self._ago(duration))

    def older_than(self, duration: str):
        return self._expr._bool(self._c < self._ago(duration))

    newer_than = within_last

    def within_next(self, duration: str):
        return self._expr._bool((self._c >= F.localtimestamp()) & (self._c <= self._ago(duration, 1)))

    def between_last(self, older: str, newer: str):
        return self._expr._bool((self._c > self._ago(older)) & (self._c <= self._ago(newer)))
