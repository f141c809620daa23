"""Durations in words ("3 days") and codes ("1d2h"), parsed on the driver."""

from __future__ import annotations

import re
from datetime import datetime, timedelta

#: unit -> spellings, code, timedelta arguments for one (months are 30 days, years 365).
UNITS = {
    "microseconds": (("us", "microsecond"), "us", {"microseconds": 1}),
    "milliseconds": (("ms", "millisecond"), "ms", {"milliseconds": 1}),
    "seconds": (("s", "sec", "secs", "second"), "s", {"seconds": 1}),
    "minutes": (("m", "min", "mins", "minute"), "m", {"minutes": 1}),
    "hours": (("h", "hr", "hrs", "hour"), "h", {"hours": 1}),
    "days": (("d", "day"), "d", {"days": 1}),
    "weeks": (("w", "week"), "w", {"weeks": 1}),
    "months": (("mo", "month"), "mo", {"days": 30}),
    "quarters": (("q", "quarter"), "q", {"days": 91}),
    "years": (("y", "yr", "year"), "y", {"days": 365}),
}
_SPELT = {s: unit for unit, (spellings, _, _) in UNITS.items() for s in (unit, *spellings)}
_CODES = {code: unit for unit, (_, code, _) in UNITS.items()}


def parse_time_expression(text: str) -> tuple[int, str]:
    """("3 minutes" or "2h") -> (3, "minutes") or (2, "hours")."""
    found = re.match(r"(\d+)\s*([a-z]+)", text.strip().lower())
    if not found:
        raise ValueError(f"cannot read {text!r} as a time such as '3 minutes' or '2h'")
    if found[2] not in _SPELT:
        raise ValueError(f"unknown time unit {found[2]!r}; known: {', '.join(UNITS)}")
    return int(found[1]), _SPELT[found[2]]


def to_timedelta(text: str) -> timedelta:
    amount, unit = parse_time_expression(text)
    return timedelta(**{k: v * amount for k, v in UNITS[unit][2].items()})


def to_offset_string(text: str) -> str:
    amount, unit = parse_time_expression(text)
    return f"{amount}{UNITS[unit][1]}"


def parse_combined_duration(text: str) -> list[str]:
    """"-1d2h" -> ["-1d", "-2h"]; the sign holds for all parts."""
    sign, body = ("-", text[1:]) if text.startswith("-") else ("", text)
    parts = re.findall(r"(\d+)(mo|ms|us|[ywdhmsq])", body.lower())
    if not parts or "".join(n + u for n, u in parts) != body.lower().replace(" ", ""):
        raise ValueError(f"cannot read {text!r} as a duration such as '1d2h' or '-3mo'")
    return [f"{sign}{n}{u}" for n, u in parts]


def offset_parts(text: str) -> list[tuple[int, str]]:
    """Signed amounts and unit names of a combined duration."""
    out = []
    for part in parse_combined_duration(text):
        amount, code = re.fullmatch(r"(-?\d+)([a-z]+)", part).groups()
        out.append((int(amount), _CODES[code]))
    return out


def time_ago(text: str) -> datetime:
    return datetime.now() - to_timedelta(text)


def since(text: str, reference: datetime | None = None) -> datetime:
    return (reference or datetime.now()) - to_timedelta(text)
