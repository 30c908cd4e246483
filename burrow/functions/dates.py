"""Date math: NOW, offsets and rounding, such as NOW/DAY-5MINUTES, resolved once before a query runs."""

from __future__ import annotations

import re
from datetime import UTC, datetime, timedelta

UNITS = ("YEAR", "MONTH", "DAY", "HOUR", "MINUTE", "SECOND")
STEP = re.compile(r"([+-])(\d+)(YEAR|MONTH|DAY|HOUR|MINUTE|SECOND)S?|/(YEAR|MONTH|DAY|HOUR|MINUTE|SECOND)S?")


def resolve(expression: str, now: datetime | None = None) -> datetime:
    """The moment that an expression names, as a time without a zone in UTC."""
    head = re.match(r"NOW|\d{4}-\d\d-\d\d(?:T\d\d:\d\d:\d\d(?:\.\d+)?)?Z?", expression)
    if not head:
        raise ValueError(f"no date: {expression}")
    if head[0] == "NOW":
        moment = (now or datetime.now(UTC)).replace(tzinfo=None)
    else:
        moment = datetime.fromisoformat(head[0].removesuffix("Z"))
    at = head.end()
    while at < len(expression):
        step = STEP.match(expression, at)
        if not step:
            raise ValueError(f"no date math: {expression[at:]}")
        moment = _rounded(moment, step[4]) if step[4] else _moved(moment, int(step[1] + step[2]), step[3])
        at = step.end()
    return moment


def _rounded(moment: datetime, unit: str) -> datetime:
    fields = ("year", "month", "day", "hour", "minute", "second")
    kept = {f: getattr(moment, f) for f in fields[: UNITS.index(unit) + 1]}
    return datetime(**({"month": 1, "day": 1} | kept))


def _moved(moment: datetime, count: int, unit: str) -> datetime:
    if unit in ("YEAR", "MONTH"):
        months = moment.year * 12 + moment.month - 1 + count * (12 if unit == "YEAR" else 1)
        year, month = months // 12, months % 12 + 1
        days = [31, 29 if year % 4 == 0 and (year % 100 or year % 400 == 0) else 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31]
        return moment.replace(year=year, month=month, day=min(moment.day, days[month - 1]))
    return moment + timedelta(**{unit.lower() + "s": count})


def gap(text: str) -> tuple[int, str]:
    """+1DAY or 5MINUTES as (count, unit)."""
    found = re.fullmatch(r"\+?(\d+)(YEAR|MONTH|DAY|HOUR|MINUTE|SECOND)S?", text)
    if not found or not int(found[1]):
        raise ValueError(f"no gap: {text}")
    return int(found[1]), found[2]
