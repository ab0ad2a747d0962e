"""Column helpers for the operators that stay inside Spark's own functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Word separators: blank, tab, line feed, VT, FF, CR.
BLANKS = r"[\x20\x09-\x0D]+"
NOT_BLANK = r"[^\x20\x09-\x0D]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    """The words of a text in order. Only the first and last part of the split can be empty."""
    return F.array_remove(F.split(text, BLANKS, -1), "")


def running(values: Column, join: Callable[[Column, Column], Column], zero: Column) -> Column:
    """Running results of an associative join over an array, itself included.

    Spark copies an array that a fold appends to; so the array is folded in parts of about its root's length, and what the
    parts come to is folded once more: n**1.5 steps in place of n**2.
    """

    def scan(xs: Column, start: Column) -> Column:
        none = F.filter(F.array(start), lambda _: F.lit(False))
        last = lambda a: F.coalesce(F.get(a, F.size(a) - 1), start)
        return F.aggregate(xs, none, lambda a, x: F.concat(a, F.array(join(last(a), x))))

    def split(xs: Column) -> Column:
        part = F.greatest(F.ceil(F.sqrt(F.size(xs).cast("double"))).cast("int"), F.lit(1))
        parts = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(xs) / part).cast("int") - 1, F.lit(0))), lambda k: scan(F.slice(xs, k * part + 1, part), zero))

        def whole(ps: Column) -> Column:
            ends = scan(F.transform(ps, lambda p: F.coalesce(F.get(p, F.size(p) - 1), zero)), zero)
            return let(ends, lambda es: F.flatten(F.transform(ps, lambda p, k: let(F.coalesce(F.get(es, k - 1), zero), lambda before: F.transform(p, lambda x: join(before, x))))))

        return let(parts, whole)

    return let(values, split)


def positions(text: Column, pattern: str, keep: Callable[[Column], Column] | None = None) -> Column:
    """Leftmost non-overlapping matches of a pattern as array<struct<s int, e int, m string>>, in code points.

    Spark has no function for the places of all matches; they follow from the lengths of the matches and of what lies
    between them. keep: a condition on a match; what fails it is dropped after the scan.
    """

    def walk(gaps: Column, found: Column) -> Column:
        ends = running(F.transform(found, lambda m, k: F.length(F.get(gaps, k)) + F.length(m)), lambda a, b: a + b, F.lit(0))
        places = let(ends, lambda es: F.transform(found, lambda m, k: F.struct((F.get(es, k) - F.length(m)).alias("s"), F.get(es, k).alias("e"), m.alias("m"))))
        return F.filter(places, lambda x: keep(x["m"])) if keep else places

    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return let(F.split(text, pattern, -1), lambda gaps: let(found, lambda f: walk(gaps, f)))
