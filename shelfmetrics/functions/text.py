"""Blank handling and delimited lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def renamed(value: Column, fixes: dict[str, str]) -> Column:
    """Replace known spellings; anything else, NULL included, passes through."""
    result = value
    for wrong, right in fixes.items():
        result = F.when(value == wrong, F.lit(right)).otherwise(result)
    return result


def unless(value: Column, unwanted: str) -> Column:
    """The value, or NULL where it is ``unwanted``."""
    return F.when(value != unwanted, value)


def blank_to_null(value: Column) -> Column:
    return unless(F.trim(value), "")


def split_list(value: Column) -> Column:
    """Trimmed entries of a comma-separated list, however many.

    Empty entries are kept; a NULL list gives NULL, which ``explode`` drops.
    """
    return F.transform(F.split(value, ","), lambda entry: F.trim(entry))


def has_entry(value: Column, entry: str) -> Column:
    """Whether ``entry`` is among the entries of the list, once trimmed."""
    return F.array_contains(split_list(value), entry)


def literal_rows(spark: SparkSession, columns: tuple[str, ...], rows) -> DataFrame:
    """A small fixed table of text."""
    lines = [
        F.struct(*[F.lit(text).alias(name) for name, text in zip(columns, row)]) for row in rows
    ]
    return spark.range(1).select(F.inline(F.array(*lines)))
