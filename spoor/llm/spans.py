"""Matches of a pattern with their places, in plain SQL functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPANS = "array<struct<start:int,end:int,value:string>>"


def pieces(text: Column, pattern: str) -> Column:
    """What stands before, between and after the matches; one more than there are matches."""
    return F.split(text, pattern, -1)


def matches(text: Column, pattern: str) -> Column:
    """The leftmost non-overlapping matches."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def spans(text: Column, found: Column, pattern: str) -> Column:
    """Matches as (start, end, value): code points, the end exclusive.

    ``found`` are the matches of ``pattern`` in ``text``. Places are running sums over the
    lengths of the matches and of what stands between them.
    """
    before = F.slice(pieces(text, pattern), F.lit(1), F.size(found))
    steps = F.zip_with(
        before, found, lambda b, m: F.struct(F.length(b).alias("gap"), m.alias("value"))
    )
    empty = F.struct(F.lit(0).alias("at"), F.array().cast(_SPANS).alias("out"))

    def step(state, x):
        start = state["at"] + x["gap"]
        end = start + F.length(x["value"])
        one = F.struct(start.alias("start"), end.alias("end"), x["value"].alias("value"))
        return F.struct(end.alias("at"), F.concat(state["out"], F.array(one)).alias("out"))

    return F.when(F.size(found) == 0, F.array().cast(_SPANS)).otherwise(
        F.aggregate(steps, empty, step, lambda state: state["out"])
    )
