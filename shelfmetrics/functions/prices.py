"""Price bands: the five named buckets, the fine bins, and the search slices."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfmetrics.settings import (
    ENTRY_MASS_BELOW,
    PREMIUM_LUXURY_FROM,
    PRICE_BIN_EDGES,
    PRICE_BUCKETS,
)


LAST_SLICE = 2**63 - 1


def price_bucket(price: Column) -> Column:
    """Named bucket of a price; a negative price is entry level, NULL stays NULL."""
    (_, lowest), *rest = PRICE_BUCKETS
    label = F.when(price.isNotNull(), F.lit(lowest))
    for edge, name in rest:
        label = F.when(price >= edge, F.lit(name)).otherwise(label)
    return label


def bin_number(price: Column) -> Column:
    """1-based number of the fine bin; NULL for a negative or missing price."""
    number = F.lit(None).cast("int")
    for position, edge in enumerate(PRICE_BIN_EDGES, start=1):
        number = F.when(price >= edge, F.lit(position)).otherwise(number)
    return number


def bin_label(number: Column) -> Column:
    lows = PRICE_BIN_EDGES
    names = [f"${low}–{high}" for low, high in zip(lows, lows[1:])] + [f"${lows[-1]}+"]
    label = F.lit(None).cast("string")
    for position, name in enumerate(names, start=1):
        label = F.when(number == position, F.lit(name)).otherwise(label)
    return label


def in_band(price: Column, low, high) -> Column:
    return (price >= low) if high is None else (price >= low) & (price < high)


def entry_or_mass(price: Column) -> Column:
    return price < ENTRY_MASS_BELOW


def premium_or_luxury(price: Column) -> Column:
    return price >= PREMIUM_LUXURY_FROM


def value_slice(value: Column, per_efold: int) -> Column:
    """Number of the slice of the value axis that holds ``value``.

    Slices are even on a signed ``log1p`` scale, so their number is bounded by
    the range of a double whatever the data look like: a few hundred between a
    cent and a thousand dollars at 64 per factor of e. The mapping never
    decreases with ``value``, and a power-of-two multiple of ``per_efold``
    splits every slice into whole parts. NULL stays NULL; NaN, which sorts above
    infinity, has the last slice to itself.
    """
    value = value.cast("double")
    slice_ = F.floor(F.signum(value) * F.log1p(F.abs(value)) * F.lit(float(per_efold)))
    return (
        F.when(F.isnan(value), F.lit(LAST_SLICE))
        .when(slice_ == LAST_SLICE, F.lit(LAST_SLICE - 1))
        .otherwise(slice_)
    )
