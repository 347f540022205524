"""Predicates on scopes: groups that may be null, and bot personas with three-valued filters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def in_group(column: Column, group: str | None) -> Column:
    """Null stands for private chat and equals null."""
    return column.eqNullSafe(F.lit(group).cast("string"))


def persona(column: Column, wanted: str | None, include_legacy: bool = True) -> Column:
    """None: no filter; '': rows without a persona; a name: its rows and, by default, those without one."""
    if wanted is None:
        return F.lit(True)
    if wanted == "":
        return column.isNull()
    own = column == wanted
    return own | column.isNull() if include_legacy else own


def any_contains(columns: list[Column], needle: str) -> Column:
    low = F.lit(needle.lower())
    return reduce(lambda a, b: a | b, (F.contains(F.lower(c), low) for c in columns))


def optional(column: Column, wanted: str | None) -> Column:
    """Equal to a parameter, if it is given."""
    return F.lit(True) if wanted is None else column == wanted


def in_days(ts: Column, first: str | None, last: str | None = None) -> Column:
    """From the start of a day to the end of another, both included; the first day alone if there is no other; all without one."""
    if first is None:
        return F.lit(True)
    start, end = (F.lit(d).cast("date") for d in (first, last or first))
    return ts.between(start.cast("timestamp_ntz"), F.date_add(end, 1).cast("timestamp_ntz"))
