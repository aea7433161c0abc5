"""Shares, drops and ladders shared by the reports.

All ratios are computed in double and a zero denominator gives NULL, also under
ANSI mode, where a plain ``/`` would fail the query.
"""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def ratio(top: Column, bottom: Column) -> Column:
    return F.try_divide(top.cast("double"), bottom.cast("double"))


def percent(part: Column, whole: Column) -> Column:
    """``100 * part / whole``, unrounded."""
    return F.try_divide(F.lit(100.0) * part, whole.cast("double"))


def percent_drop(previous: Column, current: Column) -> Column:
    return percent(previous - current, previous)


def over_all(total: Column) -> Column:
    """A grand total beside each row. Only for results that are already one row per group."""
    return total.over(Window.partitionBy())


def above(value: Column, ladder) -> Column:
    """Label of the first rung that ``value`` exceeds."""
    return _climb(ladder, lambda cut: value > cut)


def at_least(value: Column, ladder) -> Column:
    """Label of the first rung that ``value`` reaches."""
    return _climb(ladder, lambda cut: value >= cut)


def _climb(ladder, test) -> Column:
    rungs, default = ladder
    label = F.lit(default)
    for cut, name in reversed(rungs):
        label = F.when(test(F.lit(cut)), F.lit(name)).otherwise(label)
    return label


PRICE_TYPE = "decimal(10,2)"
MOST = "99999999.99"
NUMBER_AT_START = r"^[\t-\r ]*([+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)"


def number_prefix(text: Column) -> Column:
    """The number that a text begins with, blanks aside; empty if it begins with none."""
    return F.regexp_extract(text.cast("string"), NUMBER_AT_START, 1)


def typed_price(text: Column, by_prefix: bool = False) -> Column:
    """A price as ``decimal(10,2)``, rounded half away from zero.

    What is no number is NULL. ``by_prefix`` reads it as MySQL casts it: the number the text
    begins with, 0 if there is none, and the nearest bound beyond the type's range.
    """
    if not by_prefix:
        return text.try_cast(PRICE_TYPE)
    number = number_prefix(text)
    tiny = number.rlike("[eE]-")
    bound = F.when(tiny, F.lit("0")).when(number.startswith("-"), F.lit("-" + MOST)).otherwise(F.lit(MOST))
    read = F.coalesce(number.try_cast(PRICE_TYPE), bound.cast(PRICE_TYPE))
    return F.when(text.isNull(), None).when(number == "", F.lit("0").cast(PRICE_TYPE)).otherwise(read)
