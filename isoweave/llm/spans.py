"""Positions of regex matches as column expressions (code points, end exclusive), without user functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space between words, as a regex set.
BLANK = r"[\x20\x09-\x0D]+"


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once for all its uses."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(items: Column, first: Column, step: Callable[[Column, Column], Column], out: Callable[[Column, Column], Column], out_type: str) -> Column:
    """array of ``out(state, item)`` (of ``out_type``), where the state is the fold of ``step`` over the items before.

    The fold goes by blocks of about the square root of the items, so that appending costs n ** 1.5 copied references
    and not n ** 2.
    """

    def blocks(x: Column) -> Column:
        size = F.greatest(F.lit(64), F.ceil(F.sqrt(F.size(x))).cast("int"))
        numbers = F.filter(F.sequence(F.lit(0), F.floor(F.size(x) / size).cast("int")), lambda b: b * size < F.size(x))
        return F.transform(numbers, lambda b: F.slice(x, b * size + 1, size))

    def inner(block: Column, state: Column) -> Column:
        start = F.struct(state.alias("state"), F.expr(f"CAST(array() AS array<{out_type}>)").alias("done"))
        return F.aggregate(block, start, lambda acc, x: F.struct(step(acc["state"], x).alias("state"), F.concat(acc["done"], F.array(out(acc["state"], x))).alias("done")))

    start = F.struct(first.alias("state"), F.expr(f"CAST(array() AS array<array<{out_type}>>)").alias("done"))
    return F.aggregate(
        bind(items, blocks), start, lambda acc, b: bind(inner(b, acc["state"]), lambda r: F.struct(r["state"].alias("state"), F.concat(acc["done"], F.array(r["done"])).alias("done"))), lambda acc: F.flatten(acc["done"])
    )


def match_spans(text: Column, pattern: Column, group: int | None = None) -> Column:
    """array<struct<start:int, end:int, size:int, value:string>> of the leftmost non-overlapping matches.

    The gaps between matches (a split by the pattern) and the matches themselves tile the text, so running sums of
    their lengths are the positions. ``size`` is the length of ``group``, or of the match. The pattern must not match
    the empty string.
    """
    found = F.arrays_zip(
        F.split(text, pattern, -1).alias("gap"),
        F.regexp_extract_all(text, pattern, F.lit(0)).alias("value"),
        F.regexp_extract_all(text, pattern, F.lit(group or 0)).alias("part"),
    )

    def span(at: Column, x: Column) -> Column:
        start = at + F.length(x["gap"])
        return F.struct(start.alias("start"), (start + F.length(x["value"])).alias("end"), F.length(x["part"]).alias("size"), x["value"].alias("value"))

    matches = F.filter(found, lambda x: x["value"].isNotNull())  # the gap after the last match has none
    return running(matches, F.lit(0), lambda at, x: at + F.length(x["gap"]) + F.length(x["value"]), span, "struct<start:int,end:int,size:int,value:string>")


def words_of(text: Column, blank: str = BLANK) -> Column:
    """The words between blanks; none for a null text."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), blank), "")


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
