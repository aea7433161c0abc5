"""Connected components of a link table, by star contraction.

Every round turns each node's links towards the least node it knows, first from the larger
neighbours (``large``), then from the smaller ones (``small``). The links end as stars around the least
node of each component. A round is two aggregates (combined before the shuffle) and two
joins; a hub with any number of links is split by adaptive execution like any skewed join key.
Rounds grow with the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmetrics.llm.stages import Stages


def _turned(links: DataFrame) -> DataFrame:
    """One round on ``(a, b)`` with ``b < a``."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy(F.col("a").alias("at")).agg(F.min("b").alias("m"))
    large = (
        both.where(F.col("b") > F.col("a"))
        .join(least, F.col("a") == F.col("at"))
        .select(F.col("b").alias("a"), F.least("a", "m").alias("b"))
        .distinct()
    )
    down = large.groupBy(F.col("a").alias("at")).agg(F.min("b").alias("m"))
    small = (
        large.join(down, F.col("a") == F.col("at"))
        .where(F.col("b") != F.col("m"))
        .select(F.col("b").alias("a"), F.col("m").alias("b"))
    )
    return small.unionByName(down.select(F.col("at").alias("a"), F.col("m").alias("b"))).distinct()


def _settled(links: DataFrame) -> bool:
    """Whether the links ``(a, b)`` are stars: no ``a`` has two centres, and no centre is an ``a``."""
    several = links.groupBy("a").agg(F.min("b").alias("low"), F.max("b").alias("high"))
    if not several.where(F.col("low") != F.col("high")).isEmpty():
        return False
    centres = links.select(F.col("b").alias("centre")).distinct()
    return links.join(centres, F.col("a") == F.col("centre"), "left_semi").isEmpty()


def components(stages: Stages, links: DataFrame) -> DataFrame:
    """``(node, component)``: the least node of its component, for every node that has a link.

    ``links`` has two columns of one type, ``a`` and ``b``, in any order; loops, repeats and
    missing ends are ignored.
    """
    ordered = (
        links.where(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    current = stages.write(ordered, "links")
    while not _settled(current):
        turned = stages.write(_turned(current), "links")
        stages.drop(current)
        current = turned
    roots = current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)


def joined(stages: Stages, labels: DataFrame, more: DataFrame) -> DataFrame:
    """``labels`` after further links ``(a, b)``, found on the contracted graph alone."""
    left = labels.select(F.col("node").alias("l_node"), F.col("component").alias("l_component"))
    right = labels.select(F.col("node").alias("r_node"), F.col("component").alias("r_component"))
    contracted = (
        more.join(left, F.col("a") == F.col("l_node"), "left")
        .join(right, F.col("b") == F.col("r_node"), "left")
        .select(F.coalesce("l_component", "a").alias("a"), F.coalesce("r_component", "b").alias("b"))
    )
    found = components(stages, contracted)
    roots = found.select(F.col("node").alias("f_node"), F.col("component").alias("f_component"))
    moved = labels.join(roots, F.col("component") == F.col("f_node"), "left").select(
        "node", F.coalesce("f_component", "component").alias("component")
    )
    fresh = found.join(labels.select(F.col("node").alias("k_node")), F.col("node") == F.col("k_node"), "left_anti")
    return moved.unionByName(fresh)
