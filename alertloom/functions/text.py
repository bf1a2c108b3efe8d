"""Small Column helpers shared by the other function modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The Unicode white-space characters, for trimming.
WHITESPACE = (
    "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008"
    "\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def as_col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def strip(col: Column | str) -> Column:
    """Trim all Unicode white space on both sides (``trim`` alone only drops spaces)."""
    return F.trim(as_col(col), F.lit(WHITESPACE))


def is_blank(col: Column | str) -> Column:
    return F.coalesce(strip(col), F.lit("")) == ""


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once and use it many times inside ``body``.

    Inside a lambda a repeated sub-expression is evaluated per use, because there is no common
    sub-expression elimination there; a bound lambda variable is evaluated once per row.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def first_or_null(array: Column) -> Column:
    return F.try_element_at(array, F.lit(1))


def distinct_ignore_case(values: Column) -> Column:
    """Distinct array elements ignoring case; the first spelling and its position win.

    Sort by (folded, position), keep the head of each run, restore the order: n log n per row,
    where a nested search would be quadratic.
    """
    tagged = F.array_sort(
        F.transform(values, lambda v, i: F.struct(F.lower(v).alias("k"), i.alias("i"), v.alias("v")))
    )
    heads = let(tagged, _run_heads)
    ordered = F.array_sort(F.transform(heads, lambda e: F.struct(e["i"].alias("i"), e["v"].alias("v"))))
    return F.transform(ordered, lambda e: e["v"])


def sorted_set_ignore_case(values: Column) -> Column:
    """Distinct ignoring case, ordered by the upper-cased text; the first spelling wins."""
    tagged = F.array_sort(
        F.transform(values, lambda v, i: F.struct(F.upper(v).alias("k"), i.alias("i"), v.alias("v")))
    )
    return F.transform(let(tagged, _run_heads), lambda e: e["v"])


def _run_heads(tagged: Column) -> Column:
    return F.filter(tagged, lambda e, i: (i == 0) | (F.get(tagged, i - 1)["k"] != e["k"]))


def truncate(col: Column | str, limit: int | None, suffix: str = "") -> Column:
    """Cut at ``limit`` characters (code points) and append ``suffix`` only when cut; no limit, no cut."""
    text = as_col(col)
    if limit is None:
        return text
    cut = F.substring(text, 1, limit)
    if suffix:
        cut = F.concat(cut, F.lit(suffix))
    return F.when(F.length(text) > limit, cut).otherwise(text)


def round_half_even(col: Column, digits: int) -> Column:
    """Banker's rounding on doubles; ``round`` would go half up."""
    scale = float(10**digits)
    return F.rint(col * scale) / scale


def clamp(col: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), col))


def nonblank(values: Column) -> Column:
    """Drop null and blank strings from an array."""
    return F.filter(values, lambda v: ~is_blank(v))


def compact(*values: Column) -> Column:
    """Array of the non-null values."""
    return F.array_compact(F.array(*values))


def compact_names(*values: Column) -> Column:
    """Array of the non-null names, for names without the unit separator.

    Same result as ``compact`` for strings, but made of functions that take part in code generation:
    the conditions stay compiled and share their common parts, which inside an array filter they do not.
    """
    joined = F.concat_ws("\x1f", *values)
    return F.when(joined == "", F.array().cast("array<string>")).otherwise(F.split(joined, "\x1f"))
