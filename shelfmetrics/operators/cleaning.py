"""Row-level cleaning of the source tables. Every step is a narrow projection or filter."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfmetrics.functions.numbers import typed_price
from shelfmetrics.functions.text import blank_to_null, renamed, unless
from shelfmetrics.settings import CATEGORY_FIXES, STATE_FIXES, UNKNOWN_PERSONA, UNKNOWN_TIER, Settings

TRANSACTION_COLUMNS = (
    "order_id",
    "user_id",
    "product_id",
    "price",
    "quantity",
    "timestamp",
    "channel",
)


def clean_product_metadata(products: DataFrame) -> DataFrame:
    return products.select(
        "product_id",
        renamed(F.trim("category"), CATEGORY_FIXES).alias("category"),
        "claims",
        blank_to_null(F.col("ingredient_tags")).alias("ingredient_tags"),
        "pack_size",
    )


def clean_consumer_insights(consumers: DataFrame) -> DataFrame:
    return consumers.select(
        "user_id",
        renamed(F.trim("persona"), {"": UNKNOWN_PERSONA}).alias("persona"),
        "trend_affinity",
        "age_group",
        "gender_identity",
        "income_bracket",
        "dietary_restriction",
    )


def clean_geography(geography: DataFrame) -> DataFrame:
    return geography.select(
        "order_id",
        renamed(F.col("state"), STATE_FIXES).alias("state"),
        unless(F.col("city_tier"), UNKNOWN_TIER).alias("city_tier"),
        "occasion",
    )


def clean_competitor_pricing(prices: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Drop rows without a price, then type what is left. Days may repeat.

    A price or time that cannot be read stays as a row with a NULL; ``data_quality`` counts
    them. With ``settings.numeric_prefix`` a price is what the text begins with, as in MySQL.
    """
    priced = F.col("price").isNotNull() & (F.trim(F.col("price").cast("string")) != "")
    return prices.filter(priced).select(
        "competitor_product_id",
        typed_price(F.col("price"), settings.numeric_prefix).alias("price"),
        F.col("timestamp").try_cast("date").alias("price_date"),
    )


def dedup_transactions(transactions: DataFrame, tie_break: tuple[str, ...] = ()) -> DataFrame:
    """Keep the earliest row of each order.

    Rows of the same time are told apart by ``tie_break`` and then by all other columns, so
    every evaluation keeps the same row. Spark limits each order to its first row inside
    each input partition and again after the shuffle: an order with very many copies neither
    travels nor piles up in one task. What comes out is partitioned and sorted by order,
    which the joins on the order go on from.
    """
    first = ["timestamp", *tie_break]
    rest = [name for name in transactions.columns if name not in ("order_id", *first)]
    place = F.row_number().over(Window.partitionBy("order_id").orderBy(*first, *rest))
    kept = transactions.withColumn("__place", place).filter(F.col("__place") == 1)
    return kept.select(*transactions.columns)


def buyer_per_order(headers: DataFrame) -> DataFrame:
    """One buyer per order, should a header come in several copies."""
    return headers.groupBy("order_id").agg(F.min("user_id").alias("user_id"))
