"""Every report by name, as a function of the pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from shelfmetrics.operators import context, master, quality, sensitivity
from shelfmetrics.plans.pipeline import Pipeline
from shelfmetrics.settings import BULK, REFUND, SLICE_PERSONAS

Report = Callable[[Pipeline], DataFrame]

CLEANING: dict[str, Report] = {
    "clean_product_metadata": lambda p: p.products,
    "clean_consumer_insights": lambda p: p.consumers,
    "clean_geography": lambda p: p.geography,
    "dedup_transactions": lambda p: p.deduped,
    "category_price_bounds": lambda p: p.bounds,
    "flag_transactions": lambda p: p.flagged.select(*master.FLAGGED_COLUMNS),
    "master_sales": lambda p: p.master,
    "clean_competitor_pricing": lambda p: p.competitors,
    "flag_distribution": lambda p: master.flag_distribution(p.master),
    "core_clean_slice": lambda p: master.core_clean_slice(p.master),
    "geo_enriched_slice": lambda p: master.geo_enriched_slice(p.master),
    "persona_slice": lambda p: master.persona_slice(p.master, SLICE_PERSONAS),
    "returns_slice": lambda p: master.flag_slice(p.master, REFUND),
    "bulk_slice": lambda p: master.flag_slice(p.master, BULK),
    "data_quality": lambda p: quality.data_quality(p.sources, p.settings),
}

SENSITIVITY: dict[str, Report] = {
    "demand_by_bucket": lambda p: sensitivity.demand_by_bucket(p.clean, p.profiler),
    "demand_cliffs": lambda p: sensitivity.demand_cliffs(sensitivity.bucket_counts(p.clean)),
    "demand_by_bin": lambda p: sensitivity.demand_by_bin(sensitivity.bin_counts(p.clean)),
    "persona_sensitivity": lambda p: sensitivity.persona_sensitivity(
        sensitivity.persona_bucket_counts(p.clean)
    ),
    "persona_cliffs": lambda p: sensitivity.persona_cliffs(
        sensitivity.persona_bucket_counts(p.clean)
    ),
    "income_sensitivity": lambda p: sensitivity.income_sensitivity(p.clean, p.profiler),
    "channel_tolerance": lambda p: sensitivity.channel_tolerance(p.clean, p.profiler),
    "category_tolerance": lambda p: sensitivity.category_tolerance(p.clean, p.profiler),
    "age_sensitivity": lambda p: sensitivity.age_sensitivity(p.clean, p.profiler),
    "threshold_decisions": lambda p: sensitivity.threshold_decisions(p.clean),
}

CONTEXT: dict[str, Report] = {
    "claim_premium_power": lambda p: context.claim_premium_power(p.clean, p.profiler),
    "claim_category_matrix": lambda p: context.claim_category_matrix(
        p.clean, p.profiler, p.settings
    ),
    "state_pricing": lambda p: context.state_pricing(p.clean, p.profiler),
    "city_tier_pricing": lambda p: context.city_tier_pricing(p.clean, p.profiler),
    "occasion_power": lambda p: context.occasion_power(p.clean, p.profiler),
    "price_change_simulation": lambda p: context.price_change_simulation(
        context.category_revenue(p.clean)
    ),
    "state_occasion_matrix": lambda p: context.state_occasion_matrix(
        p.clean, p.profiler, p.settings
    ),
    "tier_occasion_mix": lambda p: context.tier_occasion_mix(p.clean, p.profiler),
    "sku_playbook": lambda p: context.sku_playbook(p.clean, p.profiler, p.settings),
}

REPORTS: dict[str, Report] = {**CLEANING, **SENSITIVITY, **CONTEXT}
