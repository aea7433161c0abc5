"""Where a higher price holds: by claim, place, occasion and category.

Every function takes the clean rows of the master table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfmetrics.functions.numbers import at_least, over_all, percent, ratio
from shelfmetrics.functions.text import has_entry, literal_rows, split_list
from shelfmetrics.operators.profile import Profiler
from shelfmetrics.operators.sensitivity import (
    average_price,
    listed_order,
    rounded,
    share_of_rows,
    transactions,
)
from shelfmetrics.settings import (
    ARCHETYPE_RULES,
    CITY_TIERS,
    CLAIM_VERDICTS,
    COMPARED_TIERS,
    CUT_VERDICT,
    ELASTICITIES,
    HOLD_VERDICT,
    MATRIX_CLAIMS,
    OCCASION_VERDICTS,
    RAISE_VERDICT,
    SKU_PLAYBOOK,
    STATE_TIERS,
    Settings,
)

PLAYBOOK_COLUMNS = (
    "sku_archetype",
    "recommended_price_range",
    "target_channel",
    "target_geo",
    "target_occasion",
    "evidence",
)


def per_transaction() -> Column:
    """Mean revenue, from the unrounded sum."""
    return F.round(ratio(F.col("revenue_sum"), transactions()), 2)


def per_claim(clean: DataFrame, *columns: str) -> DataFrame:
    """One row per transaction and claim of its product, with ``columns`` or all."""
    return clean.select(F.explode(split_list(F.col("claims"))).alias("claim"), *(columns or ("*",)))


def claim_premium_power(clean: DataFrame, profiler: Profiler) -> DataFrame:
    return claim_report(
        profiler.profile(
            per_claim(clean),
            ["claim"],
            {"median_price": 0.5, "p75_price": 0.75},
            ("premium_luxury_rows", "revenue_sum"),
        )
    )


def claim_report(profile: DataFrame) -> DataFrame:
    """The verdict goes by the share as printed."""
    premium = share_of_rows("premium_luxury_rows")
    return profile.select(
        "claim",
        "n_transactions",
        rounded("median_price"),
        rounded("p75_price"),
        premium.alias("pct_premium_luxury"),
        per_transaction().alias("revenue_per_txn"),
        at_least(premium, CLAIM_VERDICTS).alias("claim_premium_verdict"),
    ).orderBy(F.desc("pct_premium_luxury"), "claim")


def claim_category_matrix(
    clean: DataFrame, profiler: Profiler, settings: Settings = Settings()
) -> DataFrame:
    """Some claims, of which the groups are picked from those of all claims."""
    focus = [settings.claim(name) for name in MATRIX_CLAIMS]
    profile = profiler.profile(
        per_claim(clean),
        ["claim", "category"],
        {"median_price": 0.5},
        ("premium_luxury_rows",),
        min_rows=settings.min_claim_category_rows,
    )
    return profile.filter(F.col("claim").isin(*focus)).select(
        "claim",
        "category",
        transactions().alias("n"),
        rounded("median_price"),
        share_of_rows("premium_luxury_rows").alias("pct_premium_luxury"),
    ).orderBy(F.desc("pct_premium_luxury"), "claim", "category")


def state_pricing(clean: DataFrame, profiler: Profiler) -> DataFrame:
    return state_report(
        profiler.profile(
            clean,
            ["state"],
            {"median_price": 0.5},
            ("price_sum", "priced_rows", "premium_luxury_rows", "revenue_sum"),
        )
    )


def state_report(profile: DataFrame) -> DataFrame:
    """The tier goes by the unrounded median."""
    return profile.orderBy(F.desc("median_price"), "state").select(
        "state",
        "n_transactions",
        rounded("median_price"),
        average_price().alias("avg_price"),
        share_of_rows("premium_luxury_rows").alias("pct_premium_luxury"),
        F.round("revenue_sum", 0).alias("total_revenue"),
        per_transaction().alias("revenue_per_txn"),
        at_least(F.col("median_price"), STATE_TIERS).alias("state_pricing_tier"),
    )


def city_tier_pricing(clean: DataFrame, profiler: Profiler) -> DataFrame:
    profile = profiler.profile(
        clean,
        ["city_tier"],
        {"median_price": 0.5},
        ("price_sum", "priced_rows", "entry_mass_rows", "premium_luxury_rows", "revenue_sum"),
    )
    return profile.select(
        "city_tier",
        "n_transactions",
        rounded("median_price"),
        average_price().alias("avg_price"),
        share_of_rows("entry_mass_rows").alias("pct_entry_mass"),
        share_of_rows("premium_luxury_rows").alias("pct_premium_luxury"),
        per_transaction().alias("revenue_per_txn"),
    ).orderBy(listed_order("city_tier", CITY_TIERS), "city_tier")


def occasion_power(clean: DataFrame, profiler: Profiler) -> DataFrame:
    return occasion_report(
        profiler.profile(
            clean,
            ["occasion"],
            {"median_price": 0.5},
            ("price_sum", "priced_rows", "entry_mass_rows", "premium_luxury_rows", "revenue_sum"),
        )
    )


def occasion_report(profile: DataFrame) -> DataFrame:
    """The revenue share starts from the revenue as printed, the mean does not."""
    profile = profile.withColumn("total_revenue", F.round("revenue_sum", 0))
    revenue = F.col("total_revenue")
    share = percent(revenue, over_all(F.sum(revenue)))
    return (
        profile.withColumn("pct_of_total_revenue", F.round(share, 1))
        .orderBy(F.desc("median_price"), "occasion")
        .select(
            "occasion",
            "n_transactions",
            rounded("median_price"),
            average_price().alias("avg_price"),
            share_of_rows("entry_mass_rows").alias("pct_entry_mass"),
            share_of_rows("premium_luxury_rows").alias("pct_premium_luxury"),
            per_transaction().alias("revenue_per_txn"),
            "total_revenue",
            "pct_of_total_revenue",
            at_least(F.col("median_price"), OCCASION_VERDICTS).alias("occasion_pricing_verdict"),
        )
    )


def category_revenue(clean: DataFrame) -> DataFrame:
    return clean.groupBy("category").agg(
        F.count(F.lit(1)).alias("n_transactions"),
        F.round(F.avg("price"), 2).alias("avg_price"),
        F.round(F.sum("revenue"), 0).alias("current_revenue"),
    )


def price_change_simulation(base: DataFrame) -> DataFrame:
    """Revenue after a 10% raise or cut, from ``category_revenue``.

    Volume answers by the category's elasticity. Categories without one drop
    out. The volume factor is computed in decimal, so it stays exact.
    """
    elasticity = F.coalesce(
        *[
            F.when(F.col("category") == name, F.lit(value).cast("decimal(2,1)"))
            for name, value in ELASTICITIES.items()
        ]
    )
    response = F.col("elasticity") / F.lit(10).cast("decimal(3,0)")
    now = F.col("current_revenue")
    raised = now * F.lit(1.1) * (F.lit(1).cast("decimal(3,0)") - response).cast("double")
    cut = now * F.lit(0.9) * (F.lit(1).cast("decimal(3,0)") + response).cast("double")
    return (
        base.withColumn("elasticity", elasticity)
        .filter(F.col("elasticity").isNotNull())
        .select(
            "category",
            "n_transactions",
            "avg_price",
            "current_revenue",
            F.col("elasticity").cast("double").alias("elasticity"),
            F.round(raised, 0).alias("revenue_if_raise_10pct"),
            F.round(raised - now, 0).alias("rev_delta_raise"),
            F.round(cut, 0).alias("revenue_if_cut_10pct"),
            F.round(cut - now, 0).alias("rev_delta_cut"),
            F.when(raised > now, RAISE_VERDICT)
            .when(cut > now, CUT_VERDICT)
            .otherwise(HOLD_VERDICT)
            .alias("pricing_verdict"),
        )
        .orderBy(F.desc("rev_delta_raise"), "category")
    )


def state_occasion_matrix(
    clean: DataFrame, profiler: Profiler, settings: Settings = Settings()
) -> DataFrame:
    """The top combinations by median price; ties go by name."""
    profile = profiler.profile(
        clean,
        ["state", "occasion"],
        {"median_price": 0.5},
        ("premium_luxury_rows", "revenue_sum"),
        min_rows=settings.min_state_occasion_rows,
    )
    return (
        profile.orderBy(F.desc("median_price"), "state", "occasion")
        .limit(settings.state_occasion_top)
        .select(
            "state",
            "occasion",
            "n_transactions",
            rounded("median_price"),
            share_of_rows("premium_luxury_rows").alias("pct_premium"),
            per_transaction().alias("revenue_per_txn"),
        )
    )


def tier_occasion_mix(clean: DataFrame, profiler: Profiler) -> DataFrame:
    return mix_report(
        profiler.profile(
            clean, ["city_tier", "occasion"], {"median_price": 0.5}, ("revenue_sum",)
        ).filter(F.col("city_tier").isin(*COMPARED_TIERS))
    )


def mix_report(profile: DataFrame) -> DataFrame:
    tier_total = F.sum(transactions()).over(Window.partitionBy("city_tier"))
    return profile.select(
        "city_tier",
        "occasion",
        "n_transactions",
        F.round(percent(transactions(), tier_total), 1).alias("pct_within_tier"),
        rounded("median_price"),
        per_transaction().alias("revenue_per_txn"),
    ).orderBy("city_tier", F.desc("pct_within_tier"), "occasion")


def sku_playbook(
    clean: DataFrame, profiler: Profiler, settings: Settings = Settings()
) -> DataFrame:
    """The SKU playbook, each line beside what this data shows for its archetype.

    ``n_transactions``, ``median_price`` and ``pct_premium_luxury`` are measured
    on the rows that the archetype describes; a row may belong to several.
    """
    matches = []
    for name, (claim, categories, late_night) in ARCHETYPE_RULES.items():
        rule = F.col("category").isin(*categories)
        if claim is not None:
            rule = rule & has_entry(F.col("claims"), settings.claim(claim))
        if late_night:
            rule = rule & (F.col("occasion") == settings.late_night)
        matches.append(F.when(rule, F.lit(name)))
    member = F.explode(F.array(*matches)).alias("sku_archetype")
    profile = profiler.profile(
        clean.select(member, "price"),
        ["sku_archetype"],
        {"median_price": 0.5},
        ("premium_luxury_rows",),
    )
    measured = profile.select(
        "sku_archetype",
        "n_transactions",
        rounded("median_price"),
        share_of_rows("premium_luxury_rows").alias("pct_premium_luxury"),
    )
    # at most one measured row per line of the fixed playbook
    lines = published_playbook(clean.sparkSession)
    return lines.join(F.broadcast(measured), "sku_archetype", "left")


def published_playbook(spark: SparkSession) -> DataFrame:
    """The playbook as published, without measurements."""
    return literal_rows(spark, PLAYBOOK_COLUMNS, SKU_PLAYBOOK)
