"""What is missing or unreadable in the sources: reported, never dropped."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmetrics.functions.numbers import number_prefix, typed_price
from shelfmetrics.settings import Settings
from shelfmetrics.sources.tables import SourceTables


def _missing(number: str) -> Column:
    value = F.col(number)
    return value.isNull() | F.isnan(value.cast("double"))


def _blank(text: str) -> Column:
    value = F.col(text)
    return value.isNull() | (F.trim(value.cast("string")) == "")


def _counts(table: DataFrame, name: str, rules: dict[str, Column]) -> DataFrame:
    """``table_name, rule, n_rows``: one scan of the table, one line per rule."""
    counted = table.agg(*[F.count_if(rule).alias(rule_name) for rule_name, rule in rules.items()])
    lines = [
        F.struct(F.lit(name).alias("table_name"), F.lit(rule).alias("rule"), F.col(rule).alias("n_rows"))
        for rule in rules
    ]
    return counted.select(F.inline(F.array(*lines)))


def data_quality(sources: SourceTables, settings: Settings = Settings()) -> DataFrame:
    """Rows per table and rule that the cleaning cannot type.

    A transaction whose price or quantity is missing (NULL or NaN) matches none of the
    flags and counts as clean; a competitor price that is not a number becomes NULL. With
    ``settings.numeric_prefix`` it becomes the number it begins with: then those are unreadable
    that begin with none, and those cut short have a line of their own.
    """
    price = F.col("price")
    whole = typed_price(price).isNotNull()
    if settings.numeric_prefix:
        none = number_prefix(price) == ""
        extra = {"price cut short": ~_blank("price") & ~none & ~whole}
        unreadable_price = ~_blank("price") & none
    else:
        extra, unreadable_price = {}, ~_blank("price") & ~whole
    unreadable_time = F.col("timestamp").isNotNull() & F.col("timestamp").try_cast("date").isNull()
    parts = [
        _counts(
            sources.transactions,
            "transactions",
            {"price missing": _missing("price"), "quantity missing": _missing("quantity")},
        ),
        _counts(
            sources.competitor_pricing,
            "competitor_pricing",
            {
                "price blank": _blank("price"),
                "price unreadable": unreadable_price,
                **extra,
                "time unreadable": unreadable_time,
            },
        ),
    ]
    return reduce(DataFrame.unionByName, parts).orderBy("table_name", "rule")
