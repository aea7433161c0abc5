from __future__ import annotations

import datetime as dt

import pytest
from helpers import rows
from pyspark.sql import functions as F

from shelfmetrics.operators import master
from shelfmetrics.settings import Settings
from shelfmetrics.sources.tables import SCHEMAS

NOON = dt.datetime(2025, 1, 1, 12)


@pytest.fixture
def products(frame):
    return frame(
        [("p1", "Bars", "vegan", None, "Single"), ("p2", None, None, None, "Single")],
        SCHEMAS["product_metadata"],
    )


def sold(frame, lines):
    """(order_id, price, quantity[, product_id]) as transactions."""
    return frame(
        [
            (order, f"u{order}", rest[0] if rest else "p1", price, quantity, NOON, "App")
            for order, price, quantity, *rest in lines
        ],
        SCHEMAS["transactions"],
    )


def flags(frame, products, lines, places=()):
    bounds = frame([("Bars", 30.0)], "category string, upper_bound double")
    geography = frame(
        [(order, "Texas", "Tier 1", "gym") for order in places], SCHEMAS["geography_occasion"]
    )
    located = master.locate(sold(frame, lines), geography)
    placed = master.every_place(located, master.several_places(geography, master.repeated_orders(located)))
    flagged = master.flag_transactions(placed, products, bounds)
    return sorted((r.order_id, r.data_flag) for r in flagged.collect())


def test_each_flag_and_their_priority(frame, products):
    lines = [
        ("a", -5.0, -1),  # refund
        ("b", -5.0, 2),  # negative price alone is no refund
        ("c", 0.0, 30),  # zero price before bulk
        ("d", 99.0, 21),  # bulk before outlier
        ("e", 99.0, 20),  # outlier before missing place
        ("f", 30.0, 1),  # on the fence is no outlier
        ("g", 5.0, 1),
        ("h", None, 1),  # missing price fails every test
        ("i", -5.0, -30, "p2"),
        ("j", 999.0, 1, "p2"),  # no bounds without a category
    ]
    assert flags(frame, products, lines, places="bfhj") == [
        ("a", "return_refund"),
        ("b", "clean"),
        ("c", "zero_price"),
        ("d", "bulk_order"),
        ("e", "price_outlier_high"),
        ("f", "clean"),
        ("g", "no_geo"),
        ("h", "clean"),
        ("i", "return_refund"),
        ("j", "clean"),
    ]


def test_unknown_product_drops_out_and_places_may_repeat(frame, products):
    lines = [("a", 5.0, 1), ("b", 5.0, 1, "p9")]
    assert flags(frame, products, lines, places="aa") == [("a", "clean"), ("a", "clean")]


def test_bounds_ignore_refunds_and_free_items(frame, products, profiler):
    lines = [("a", 1.0, 1), ("b", 2.0, 1), ("c", 3.0, 1), ("d", 4.0, 1)]
    lines += [("x", -9.0, -1), ("y", 0.0, 1), ("z", 500.0, -1), ("n", 7.0, 1, "p2")]
    prices = master.valid_prices(sold(frame, lines), products)
    bounds = master.category_price_bounds(prices, profiler).orderBy("category")
    assert rows(bounds) == [
        (None, 7.0, 7.0, 0.0, 7.0, 7.0),
        ("Bars", 1.0, 3.0, 2.0, -2.0, 6.0),
    ]
    narrow = master.category_price_bounds(prices, profiler, Settings(fence=0.5))
    bars = narrow.filter("category = 'Bars'").select("lower_bound", "upper_bound")
    assert rows(bars) == [(0.0, 4.0)]


def test_master_adds_revenue_and_bucket_and_needs_the_consumer(frame, products):
    geography = frame([("a", "Texas", None, "gym")], SCHEMAS["geography_occasion"])
    consumers = frame(
        [("ua", "budget", "t", "18-24", "g", "Low", "none")], SCHEMAS["consumer_insights"]
    )
    bounds = frame([("Bars", 300.0)], "category string, upper_bound double")
    located = master.locate(sold(frame, [("a", -12.0, -2), ("b", 40.0, 2)]), geography)
    built = master.build_master(located, products, bounds, consumers)
    assert built.columns == list(master.MASTER_COLUMNS)
    assert rows(built.select("order_id", "revenue", "price_bucket", "state", "city_tier")) == [
        ("a", 24.0, "A: <10 (entry)", "Texas", None)
    ]


def test_flag_distribution_and_slices(frame):
    table = frame(
        [("clean", "Texas", "Tier 1", "budget")] * 2
        + [("clean", None, None, "casual"), ("clean", "Texas", None, None)]
        + [("bulk_order", None, None, "budget"), ("return_refund", None, None, "budget")],
        "data_flag string, state string, city_tier string, persona string",
    )
    assert rows(master.flag_distribution(table)) == [
        ("clean", 4, 66.7),
        ("bulk_order", 1, 16.7),
        ("return_refund", 1, 16.7),
    ]
    assert master.core_clean_slice(table).count() == 4
    assert master.geo_enriched_slice(table).count() == 2
    assert master.persona_slice(table, ("budget", "fitness")).count() == 2
    assert master.flag_slice(table, "bulk_order").count() == 1


def test_flags_are_exclusive_and_cover_everything(spark, frame, products):
    lines = spark.range(500).select(
        F.col("id").cast("string").alias("order_id"),
        F.lit("u").alias("user_id"),
        F.lit("p1").alias("product_id"),
        (F.col("id") % 50 - 5).cast("double").alias("price"),
        (F.col("id") % 27 - 3).cast("int").alias("quantity"),
        F.lit(NOON).alias("timestamp"),
        F.lit("App").alias("channel"),
    )
    bounds = frame([("Bars", 30.0)], "category string, upper_bound double")
    located = master.locate(lines, frame([], SCHEMAS["geography_occasion"]))
    flagged = master.flag_transactions(located, products, bounds)
    counts = {r.data_flag: r["count"] for r in flagged.groupBy("data_flag").count().collect()}
    assert sum(counts.values()) == 500
    assert set(counts) == {
        "return_refund",
        "zero_price",
        "bulk_order",
        "price_outlier_high",
        "no_geo",
    }


def test_an_order_in_two_places_counts_once_for_the_bounds(frame, products, profiler):
    geography = frame(
        [
            ("d", "Texas", "Tier 1", "gym"),
            ("d", "Texas", "Tier 1", "gym"),
            ("d", "Ohio", None, "gym"),
            ("a", None, None, None),
            (None, "Ohio", None, "run"),
        ],
        SCHEMAS["geography_occasion"],
    )
    lines = sold(frame, [("a", 1.0, 1), ("b", 2.0, 1), ("c", 3.0, 1), ("d", 4.0, 1)])
    located = master.locate(lines, geography)
    assert sorted(rows(located.select("order_id", "places"))) == [
        ("a", 1),
        ("b", None),
        ("c", None),
        ("d", 3),
    ]
    prices = master.valid_prices(located, products)
    bounds = master.category_price_bounds(prices, profiler)
    assert rows(bounds.select("q1", "q3")) == [(1.0, 3.0)]
    placed = master.every_place(located, master.several_places(geography, master.repeated_orders(located)))
    flagged = master.flag_transactions(placed, products, bounds)
    found = flagged.orderBy("order_id", "state").collect()
    assert [(r.order_id, r.state, r.city_tier, r.data_flag) for r in found] == [
        ("a", None, None, "clean"),
        ("b", None, None, "no_geo"),
        ("c", None, None, "no_geo"),
        ("d", "Ohio", None, "clean"),
        ("d", "Texas", "Tier 1", "clean"),
        ("d", "Texas", "Tier 1", "clean"),
    ]
