"""How demand falls as price rises: overall, by band and by customer segment.

Every function takes the clean rows of the master table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfmetrics.functions.numbers import above, over_all, percent, percent_drop, ratio
from shelfmetrics.functions.prices import bin_label, bin_number, in_band
from shelfmetrics.functions.text import literal_rows
from shelfmetrics.operators.profile import Profiler
from shelfmetrics.settings import (
    AGE_GROUPS,
    BIN_CLIFFS,
    BUCKET_CLIFFS,
    PERSONA_CLIFFS,
    PRICE_BUCKETS,
    PRICE_THRESHOLDS,
    THRESHOLD_BANDS,
    UNKNOWN_PERSONA,
)


def transactions() -> Column:
    return F.col("n_transactions")


def rounded(name: str, digits: int = 2) -> Column:
    return F.round(F.col(name), digits).alias(name)


def share_of_rows(part: str) -> Column:
    return F.round(percent(F.col(part), transactions()), 1)


def average_price() -> Column:
    return F.round(ratio(F.col("price_sum"), F.col("priced_rows")), 2)


def listed_order(column: str, names: tuple[str, ...]) -> Column:
    """Sort position of a value in a fixed list; values not listed come first."""
    return F.array_position(F.array(*[F.lit(name) for name in names]), F.col(column))


def demand_by_bucket(clean: DataFrame, profiler: Profiler) -> DataFrame:
    """Volume against revenue per named price bucket."""
    return bucket_report(
        profiler.profile(
            clean,
            ["price_bucket"],
            {"median_price": 0.5},
            ("price_sum", "priced_rows", "revenue_sum"),
        )
    )


def bucket_report(profile: DataFrame) -> DataFrame:
    """Shares, revenue per transaction and the efficiency index all start from
    the revenue as printed, that is already rounded to whole units."""
    profile = profile.withColumn("total_revenue", F.round("revenue_sum", 0))
    revenue = F.col("total_revenue")
    demand_share = percent(transactions(), over_all(F.sum(transactions())))
    revenue_share = percent(revenue, over_all(F.sum(revenue)))
    return profile.select(
        "price_bucket",
        "n_transactions",
        F.round(demand_share, 1).alias("pct_of_demand"),
        average_price().alias("avg_price"),
        rounded("median_price"),
        "total_revenue",
        F.round(revenue_share, 1).alias("pct_of_revenue"),
        F.round(ratio(revenue, transactions()), 2).alias("revenue_per_txn"),
        F.round(F.try_divide(revenue_share, demand_share), 2).alias("revenue_efficiency_idx"),
    ).orderBy("price_bucket")


def bucket_counts(clean: DataFrame) -> DataFrame:
    return clean.groupBy("price_bucket").agg(F.count(F.lit(1)).alias("n_transactions"))


def demand_cliffs(counts: DataFrame) -> DataFrame:
    """Loss of volume from each bucket to the next, from ``bucket_counts``."""
    drop = percent_drop(F.col("prev_bucket_n"), transactions())
    in_order = Window.orderBy("price_bucket")
    return (
        counts.withColumn("prev_bucket_n", F.lag("n_transactions").over(in_order))
        .filter(F.col("prev_bucket_n").isNotNull())
        .select(
            "price_bucket",
            "n_transactions",
            "prev_bucket_n",
            F.round(drop, 1).alias("pct_demand_drop"),
            above(drop, BUCKET_CLIFFS).alias("threshold_classification"),
        )
        .orderBy("price_bucket")
    )


def bin_counts(clean: DataFrame) -> DataFrame:
    return clean.groupBy(bin_number(F.col("price")).alias("bin_order")).agg(
        F.count(F.lit(1)).alias("n")
    )


def demand_by_bin(counts: DataFrame) -> DataFrame:
    """Volume per fine price bin, from ``bin_counts``; rows outside all bins come first."""
    prev = F.lag("n").over(Window.orderBy("bin_order"))
    drop = percent_drop(F.col("prev_n"), F.col("n"))
    return (
        counts.withColumn("prev_n", prev)
        .withColumn("pct_demand", F.round(percent(F.col("n"), over_all(F.sum("n"))), 1))
        .orderBy("bin_order")
        .select(
            bin_label(F.col("bin_order")).alias("price_bin"),
            "n",
            "pct_demand",
            F.round(drop, 1).alias("pct_drop_from_prev"),
            above(drop, BIN_CLIFFS).alias("flag"),
        )
    )


def persona_bucket_counts(clean: DataFrame) -> DataFrame:
    known = clean.filter(F.col("persona") != UNKNOWN_PERSONA)
    return known.groupBy("persona", "price_bucket").agg(F.count(F.lit(1)).alias("n_transactions"))


def persona_sensitivity(counts: DataFrame) -> DataFrame:
    """Price mix per persona, from ``persona_bucket_counts``."""
    names = ("entry", "mass", "mid", "premium", "luxury")
    mix = counts.groupBy("persona").agg(
        F.sum("n_transactions").alias("total_txns"),
        *[
            F.sum(F.when(F.col("price_bucket") == label, transactions()).otherwise(0)).alias(name)
            for name, (_, label) in zip(names, PRICE_BUCKETS)
        ],
    )
    total = F.col("total_txns")
    cheap, dear = F.col("entry") + F.col("mass"), F.col("premium") + F.col("luxury")
    return mix.select(
        "persona",
        "total_txns",
        *[F.round(percent(F.col(name), total), 1).alias(f"pct_{name}") for name in names],
        F.round(ratio(cheap, dear), 2).alias("sensitivity_score"),
        F.round(percent(dear, total), 1).alias("premium_tolerance_pct"),
    ).orderBy(F.desc("sensitivity_score"), "persona")


def persona_cliffs(counts: DataFrame) -> DataFrame:
    """Loss of volume from bucket to bucket within each persona."""
    prev = F.lag("n_transactions").over(Window.partitionBy("persona").orderBy("price_bucket"))
    drop = percent_drop(F.col("prev_bucket_n"), transactions())
    return (
        counts.withColumn("prev_bucket_n", prev)
        .filter(F.col("prev_bucket_n").isNotNull())
        .select(
            "persona",
            F.col("price_bucket").alias("transition_to"),
            "n_transactions",
            "prev_bucket_n",
            F.round(drop, 1).alias("pct_drop"),
            above(drop, PERSONA_CLIFFS).alias("cliff_severity"),
        )
        .orderBy("persona", "transition_to")
    )


def income_sensitivity(clean: DataFrame, profiler: Profiler) -> DataFrame:
    profile = profiler.profile(
        clean,
        ["income_bracket"],
        {"median_price": 0.5},
        ("price_sum", "priced_rows", "entry_mass_rows", "premium_luxury_rows"),
    )
    return profile.select(
        "income_bracket",
        "n_transactions",
        rounded("median_price"),
        share_of_rows("entry_mass_rows").alias("pct_in_entry_mass"),
        share_of_rows("premium_luxury_rows").alias("pct_in_premium_luxury"),
        average_price().alias("avg_price"),
    ).orderBy(F.desc("avg_price"), "income_bracket")


def channel_tolerance(clean: DataFrame, profiler: Profiler) -> DataFrame:
    profile = profiler.profile(
        clean,
        ["channel"],
        {"median_price": 0.5, "p75_price": 0.75, "p90_price": 0.9},
        ("price_sum", "priced_rows", "entry_mass_rows", "premium_luxury_rows", "revenue_sum"),
    )
    return profile.orderBy(F.desc("median_price"), "channel").select(
        "channel",
        "n_transactions",
        average_price().alias("avg_price"),
        rounded("median_price"),
        rounded("p75_price"),
        rounded("p90_price"),
        share_of_rows("entry_mass_rows").alias("pct_in_entry_mass"),
        share_of_rows("premium_luxury_rows").alias("pct_in_premium_luxury"),
        F.round("revenue_sum", 0).alias("total_revenue"),
    )


def category_tolerance(clean: DataFrame, profiler: Profiler) -> DataFrame:
    """Unlike the bucket report, the revenue share starts from the unrounded sum."""
    profile = profiler.profile(
        clean,
        ["category"],
        {"median_price": 0.5, "p75_price": 0.75},
        ("entry_mass_rows", "premium_luxury_rows", "revenue_sum"),
    )
    revenue = F.col("revenue_sum")
    return profile.select(
        "category",
        "n_transactions",
        rounded("median_price"),
        rounded("p75_price"),
        share_of_rows("entry_mass_rows").alias("pct_entry_mass"),
        share_of_rows("premium_luxury_rows").alias("pct_premium_luxury"),
        F.round(percent(revenue, over_all(F.sum(revenue))), 1).alias("revenue_share_pct"),
    ).orderBy(F.desc("pct_premium_luxury"), "category")


def age_sensitivity(clean: DataFrame, profiler: Profiler) -> DataFrame:
    profile = profiler.profile(
        clean,
        ["age_group"],
        {"median_price": 0.5},
        ("entry_mass_rows", "premium_luxury_rows"),
    )
    return profile.select(
        "age_group",
        "n_transactions",
        rounded("median_price"),
        share_of_rows("entry_mass_rows").alias("pct_entry_mass"),
        share_of_rows("premium_luxury_rows").alias("pct_premium_luxury"),
    ).orderBy(listed_order("age_group", AGE_GROUPS), "age_group")


def threshold_decisions(clean: DataFrame) -> DataFrame:
    """The threshold advice with the drop that this data shows at each price.

    One pass counts the rows on both sides of every threshold; the single row of
    counts then unfolds into one row per threshold.
    """
    price = F.col("price")
    counts, lines = [], []
    for at, (threshold, kind, _, advice) in enumerate(PRICE_THRESHOLDS):
        below, beyond, wording = THRESHOLD_BANDS[threshold]
        counts.append(F.count_if(in_band(price, *below)).alias(f"below_{at}"))
        counts.append(F.count_if(in_band(price, *beyond)).alias(f"beyond_{at}"))
        drop = F.round(percent_drop(F.col(f"below_{at}"), F.col(f"beyond_{at}")), 0).cast("bigint")
        lines.append(
            F.struct(
                F.lit(threshold).alias("threshold_price"),
                F.lit(kind).alias("threshold_type"),
                F.concat(drop.cast("string"), F.lit(f"% {wording}")).alias("pct_demand_lost"),
                F.lit(advice).alias("recommendation"),
            )
        )
    unfolded = clean.agg(*counts).select(F.inline(F.array(*lines)))
    return unfolded.orderBy("threshold_price")


def published_thresholds(spark: SparkSession) -> DataFrame:
    """The threshold advice as published, with the drops it was based on."""
    columns = ("threshold_price", "threshold_type", "pct_demand_lost", "recommendation")
    return literal_rows(spark, columns, PRICE_THRESHOLDS).orderBy("threshold_price")
