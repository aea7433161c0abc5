"""The group profile: the one shape behind most reports.

Per group: row count, additive measures and exact percentiles of the price.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import cached_property, reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmetrics.functions.prices import entry_or_mass, premium_or_luxury, value_slice
from shelfmetrics.operators.ranks import COARSE, ranks_by_slices, slice_counts
from shelfmetrics.plans.workspace import Workspace

PRICE = "price"

MEASURES = {
    "price_sum": lambda: F.sum(PRICE),
    "priced_rows": lambda: F.count(PRICE),
    "revenue_sum": lambda: F.sum("revenue"),
    "entry_mass_rows": lambda: F.count_if(entry_or_mass(F.col(PRICE))),
    "premium_luxury_rows": lambda: F.count_if(premium_or_luxury(F.col(PRICE))),
}


def _first(found: Iterable[DataFrame | None]) -> DataFrame | None:
    return next((one for one in found if one is not None), None)


def _present(keys: list[str]) -> Column:
    return reduce(and_, [F.col(key).isNotNull() for key in keys])


#: What the shared search looks for, whichever of them a report asks for.
SHARED_PERCENTILES = {"p50": 0.5, "p75": 0.75, "p90": 0.9}


class SharedSlices:
    """Slice counts and percentiles of several key lists over one table, from two scans of it.

    One aggregate over grouping sets, written once, holds rows and all measures per
    (key list, group, price slice). It is small: its size follows the number of groups
    and slices, not the number of rows. The percentiles of all key lists are searched
    together: in the second scan a row meets the wanted slices of all its groups at once.
    """

    def __init__(self, workspace: Workspace, rows: DataFrame, key_lists: tuple[tuple[str, ...], ...]):
        self.workspace = workspace
        self.rows = rows
        self.key_lists = key_lists
        self.columns = list(dict.fromkeys(key for keys in key_lists for key in keys))

    def _number(self, keys: tuple[str, ...]) -> int:
        """What ``grouping_id`` is for a key list: a bit for every column it leaves out."""
        places = [*self.columns, "slice"]
        present = {*keys, "slice"}
        return sum(1 << (len(places) - 1 - at) for at, name in enumerate(places) if name not in present)

    @cached_property
    def table(self) -> DataFrame:
        sliced = self.rows.select(
            *self.columns, PRICE, "revenue", value_slice(F.col(PRICE), COARSE).alias("slice")
        )
        sets = [[*keys, "slice"] for keys in self.key_lists]
        counted = sliced.groupingSets(sets, *self.columns, "slice").agg(
            F.grouping_id().alias("key_list"),
            F.count(F.lit(1)).alias("n"),
            *[measure().alias(name) for name, measure in MEASURES.items()],
        )
        return self.workspace.save(counted, "shared_slices")

    @property
    def _group(self) -> list[str]:
        return ["key_list", *self.columns]

    def _blank(self, column: str) -> Column:
        """No text, under the column's own collation."""
        return F.lit("").cast(self.rows.schema[column].dataType)

    def _in_groups(self, rows: DataFrame) -> DataFrame:
        """Each row once for every key list that it has all keys of; other columns are blank."""
        groups = [
            F.when(
                _present([*keys]),
                F.struct(
                    F.lit(self._number(keys)).cast("long").alias("key_list"),
                    *[(F.col(c) if c in keys else self._blank(c)).alias(c) for c in self.columns],
                ),
            )
            for keys in self.key_lists
        ]
        each = rows.select(PRICE, F.explode(F.array(*groups)).alias("group"))
        return each.filter(F.col("group").isNotNull()).select("group.*", PRICE)

    @cached_property
    def ranks(self) -> DataFrame:
        """The shared percentiles per (key list, group)."""
        whole = [
            (F.col("key_list") == self._number(keys)) & _present([*keys]) for keys in self.key_lists
        ]
        slices = self.table.filter(reduce(or_, whole)).select(
            F.col("key_list").cast("long").alias("key_list"),
            *[F.coalesce(F.col(c), self._blank(c)).alias(c) for c in self.columns],
            "slice",
            "n",
        )
        found = ranks_by_slices(
            self._in_groups(self.rows), slices, self._group, PRICE, SHARED_PERCENTILES, self.workspace
        )
        return self.workspace.save(found, "shared_ranks")

    def ranks_of(self, rows: DataFrame, keys: list[str], percentiles: dict[str, float]) -> DataFrame | None:
        """The wanted percentiles of ``rows`` by ``keys``, if they are among the shared ones."""
        names = {p: name for name, p in SHARED_PERCENTILES.items()}
        if not self._shares(rows, keys) or not names.keys() >= set(percentiles.values()):
            return None
        own = self.ranks.filter(F.col("key_list") == self._number(tuple(keys)))
        return own.select(*keys, *[F.col(names[p]).alias(name) for name, p in percentiles.items()])

    def _shares(self, rows: DataFrame, keys: list[str]) -> bool:
        return tuple(keys) in self.key_lists and rows.sameSemantics(self.rows)

    def of(self, rows: DataFrame, keys: list[str]) -> DataFrame | None:
        """The slice counts of ``rows`` by ``keys``, if they are among the shared ones."""
        if not self._shares(rows, keys):
            return None
        own = self.table.filter(F.col("key_list") == self._number(tuple(keys)))
        return own.filter(_present(keys)).select(*keys, "slice", "n", *MEASURES)


class Profiler:
    """Makes group profiles, in the same way for tables of any size.

    A profile takes two narrow reads: the first sums up per (group, price slice), which
    answers every additive measure and tells which slices the percentiles lie in; the
    second looks only into those. Key lists that are asked for together share both. What a profile has
    written is kept, so asking again writes nothing.
    """

    def __init__(self, workspace: Workspace, *shared: SharedSlices):
        self.workspace = workspace
        self.shared = shared
        self._made: list[tuple[DataFrame, tuple, DataFrame]] = []

    def profile(
        self,
        rows: DataFrame,
        keys: list[str],
        percentiles: dict[str, float],
        measures: tuple[str, ...] = (),
        min_rows: int = 0,
    ) -> DataFrame:
        """One row per group: ``keys``, ``n_transactions``, ``measures``, ``percentiles``.

        Rows with a NULL key belong to no group. Groups below ``min_rows`` are left out.
        """
        wanted = (*keys, *percentiles.items(), *measures, min_rows)
        for known, request, made in self._made:
            if request == wanted and known.sameSemantics(rows):
                return made
        made = self._profile(rows, keys, percentiles, measures, min_rows)
        self._made.append((rows, wanted, made))
        return made

    def _profile(
        self,
        rows: DataFrame,
        keys: list[str],
        percentiles: dict[str, float],
        measures: tuple[str, ...],
        min_rows: int,
    ) -> DataFrame:
        keyed = rows.filter(_present(keys))
        slices = _first(shared.of(rows, keys) for shared in self.shared)
        if slices is None:
            sums = {name: MEASURES[name]() for name in measures}
            slices = self.workspace.save(slice_counts(keyed, keys, PRICE, sums), "slices")
        totals = (
            slices.groupBy(*keys)
            .agg(F.sum("n").alias("n_transactions"), *[F.sum(m).alias(m) for m in measures])
            .filter(F.col("n_transactions") >= min_rows)
        )
        ranks = _first(shared.ranks_of(rows, keys, percentiles) for shared in self.shared)
        if ranks is None:
            ranks = ranks_by_slices(keyed, slices, keys, PRICE, percentiles, self.workspace, min_rows)
        return totals.join(ranks, keys, "left")
