"""Exact nearest-rank percentiles per group, for groups of any size.

The percentile at ``p`` is the smallest value whose share of rows at or below it
reaches ``p``. It is always a value of the data, never an interpolation. Missing
values take part in the shares, below every number; NaN is above every number.

``percentile_disc`` and windows hold the distinct values of a group in one task.
``ranks_by_slices`` does not. It searches the value axis in three steps, each of which
aggregates before it shuffles:

1. count the rows of each (group, slice), with few, bounded slices per group;
2. count the distinct values inside the few slices that hold a wanted rank;
3. find the sub-slices that hold the ranks and walk the values of those only.

It reads its input twice, each time only the group and value columns, and both
intermediate results are written: they are small, read more than once, and their
known size lets Spark choose between broadcasting and shuffling them.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from shelfmetrics.functions.prices import value_slice
from shelfmetrics.plans.workspace import Workspace

COARSE = 64
FINE = COARSE * 4096

def slice_counts(
    rows: DataFrame, keys: list[str], value: str, measures: dict[str, Column]
) -> DataFrame:
    """Step 1: rows per (group, slice), with any additive ``measures`` beside them."""
    return rows.groupBy(*keys, value_slice(F.col(value), COARSE).alias("slice")).agg(
        F.count(F.lit(1)).alias("n"), *[m.alias(name) for name, m in measures.items()]
    )


def ranks_by_slices(
    rows: DataFrame,
    slices: DataFrame,
    keys: list[str],
    value: str,
    percentiles: dict[str, float],
    workspace: Workspace,
    min_rows: int = 0,
) -> DataFrame:
    """Steps 2 and 3: one row per group with the wanted percentiles of ``value``.

    ``slices`` is the written result of ``slice_counts`` over the same ``rows``.
    Group keys must not be NULL. Groups below ``min_rows`` are left out, as are
    groups without any value.
    """
    wanted = list(percentiles.values())
    counted = slices.select(
        *keys,
        "slice",
        "n",
        F.sum("n").over(Window.partitionBy(*keys)).alias("total"),
        F.lit(0).cast("long").alias("base"),
    ).filter(F.col("total") >= min_rows)
    coarse = _holding(counted, keys, "slice", wanted)

    values = workspace.save(
        rows.select(*keys, value, value_slice(F.col(value), COARSE).alias("slice"))
        .join(coarse, [*keys, "slice"])
        .groupBy(*keys, "slice", "base", "total", value)
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("part", value_slice(F.col(value), FINE)),
        "values",
    )
    parts = values.groupBy(*keys, "slice", "base", "total", "part").agg(F.sum("n").alias("n"))
    fine = _holding(parts, [*keys, "slice"], "part", wanted)

    place = [*keys, "slice", "part"]
    walked = values.select(*place, value, "n").join(fine, place)
    upto = F.col("base") + F.sum("n").over(_upward(place, value))
    shares = walked.select(*keys, value, (upto / F.col("total")).alias("share"))
    return shares.groupBy(*keys).agg(
        *[
            F.min(F.when(F.col("share") >= p, F.col(value))).alias(name)
            for name, p in percentiles.items()
        ]
    )


def _upward(groups: list[str], by: str) -> WindowSpec:
    ordered = Window.partitionBy(*groups).orderBy(F.col(by).asc_nulls_first())
    return ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _holding(counts: DataFrame, groups: list[str], by: str, wanted: list[float]) -> DataFrame:
    """Slices in which a wanted rank falls; ``base`` becomes the rows before the slice.

    A rank that falls among the missing values belongs to the first slice after
    them, so that slice counts as starting from zero.
    """
    ordered = Window.partitionBy(*groups).orderBy(F.col(by).asc_nulls_first())
    before = F.lag(F.when(F.col(by).isNotNull(), F.col("upto"))).over(ordered)
    at, below = F.col("upto") / F.col("total"), F.col("before") / F.col("total")
    holds = reduce(or_, [(below < p) & (at >= p) for p in wanted])
    return (
        counts.withColumn("upto", F.col("base") + F.sum("n").over(_upward(groups, by)))
        .withColumn("before", F.coalesce(before, F.lit(0)))
        .filter(F.col(by).isNotNull() & holds)
        .select(*groups, by, (F.col("upto") - F.col("n")).alias("base"), "total")
    )
