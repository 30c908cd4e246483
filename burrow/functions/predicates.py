"""Filters as small building blocks that become native Columns, so that Catalyst pushes them into the scan.

A block knows the fields' types by the schema it meets: a term on a list is membership, on a full-text field a word.
Filters are two-valued: a document without the field doesn't match, and a negation matches it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F, types as T

from burrow.functions import dates, geo
from burrow.functions.text import joined_parts, words
from burrow.functions.types import check_filter, field_type


@dataclass(frozen=True)
class Filter:
    """A condition on documents: & and | combine, ~ negates."""

    column: Callable[[T.StructType], Column]

    def on(self, df: DataFrame) -> Column:
        return self.column(df.schema)

    def __and__(self, other: Filter) -> Filter:
        return Filter(lambda schema: self.column(schema) & other.column(schema))

    def __or__(self, other: Filter) -> Filter:
        return Filter(lambda schema: self.column(schema) | other.column(schema))

    def __invert__(self) -> Filter:
        return Filter(lambda schema: ~F.coalesce(self.column(schema), F.lit(False)))


def everything() -> Filter:
    return Filter(lambda schema: F.lit(True))


def column(condition: Column) -> Filter:
    """Any Column as a filter."""
    return Filter(lambda schema: condition)


def _on_values(name: str, test: Callable[[Column], Column], text: Callable[[Column], Column] | None = None) -> Filter:
    """test on a field's value, or on any value of a list; text on the words of a full-text field."""
    check_filter(name)

    def build(schema: T.StructType) -> Column:
        if name not in schema.names:
            return F.lit(False)
        field, kind = F.col(f"`{name}`"), field_type(name)
        if text and kind and kind.name.startswith("text"):
            return text(words(field))
        return F.exists(field, test) if isinstance(schema[name].dataType, T.ArrayType) else test(field)

    return Filter(build)


def term(name: str, value) -> Filter:
    """The field has this value; a full-text field has this word, or these words somewhere."""
    return _on_values(name, lambda x: x == F.lit(value), lambda found: F.forall(words(F.lit(str(value))), lambda w: F.array_contains(found, w)))


def analysed(name: str, value: str, stem: bool = True, synonyms: dict[str, list[str]] | None = None) -> Filter:
    """A full-text field has each of these words, or one of its synonyms, by stems and also in words written in parts (wi-fi)."""

    def found(schema: T.StructType) -> Column:
        c = F.col(f"`{name}`")
        held = F.concat(words(c, stem), joined_parts(c))
        tests = []
        for word in value.lower().split():
            kinds = [word, *(synonyms or {}).get(word, [])]
            tests.append(F.arrays_overlap(held, F.concat(*[words(F.lit(w), stem) for w in kinds], F.array(*map(F.lit, kinds)))))
        return reduce(and_, tests, F.lit(True)) & c.isNotNull()

    check_filter(name)
    return Filter(found)


def phrase(name: str, value: str) -> Filter:
    """These words in this order, without others between; equality on other fields."""

    def in_order(found: Column) -> Column:
        gapless = lambda ws: F.concat(F.lit(" "), F.array_join(ws, " "), F.lit(" "))
        return F.contains(gapless(found), gapless(words(F.lit(value))))

    return _on_values(name, lambda x: x == F.lit(value), in_order)


def starts(name: str, prefix: str) -> Filter:
    return _on_values(name, lambda x: x.startswith(prefix), lambda found: F.exists(found, lambda w: w.startswith(prefix.lower())))


def wildcard(name: str, pattern: str) -> Filter:
    """* stands for any characters, ? for one; \\ takes the next as it is."""
    out, literal = "", False
    for c in pattern:
        if literal or c not in "*?\\":
            out += f"\\{c}" if c in "%_\\" else c
        elif c != "\\":
            out += "%" if c == "*" else "_"
        literal = not literal and c == "\\"
    return _on_values(name, lambda x: x.like(out), lambda found: F.exists(found, lambda w: w.like(out.lower())))


def between(name: str, low=None, high=None, with_low: bool = True, with_high: bool = True) -> Filter:
    """A range with open or closed ends; None is no bound, so between(name) means that the field exists."""

    def test(x: Column) -> Column:
        found = x.isNotNull()
        if low is not None:
            found = x >= F.lit(low) if with_low else x > F.lit(low)
        if high is not None:
            above = x <= F.lit(high) if with_high else x < F.lit(high)
            found = above if low is None else found & above
        return found

    return _on_values(name, test)


def exists(name: str) -> Filter:
    return between(name)


def during(name: str, low: str | None = None, high: str | None = None, now: datetime | None = None) -> Filter:
    """A range of times with date math, such as during("ts_dt", None, "NOW-5MINUTES")."""
    moment = lambda x: None if x is None else F.lit(dates.resolve(x, now)).cast("timestamp_ntz")
    return between(name, moment(low), moment(high))


def like_word(name: str, value: str, edits: int = 2) -> Filter:
    """At most so many edits away."""
    near = lambda x: F.levenshtein(x, F.lit(value)) <= edits
    return _on_values(name, near, lambda found: F.exists(found, lambda w: F.levenshtein(w, F.lit(value.lower())) <= edits))


def near(name: str, lat: float, lon: float, radius_km: float, circle: bool = False) -> Filter:
    """A place in the box around a circle, or in the circle."""
    check_filter(name)

    def build(schema: T.StructType) -> Column:
        at = (F.col(f"`{name}`.lat"), F.col(f"`{name}`.lon"))
        box = geo.in_box(*at, lat, lon, radius_km)
        return box & (geo.distance_km(*at, lat, lon) <= radius_km) if circle else box

    return Filter(build)
