"""Outlier bounds, quality flags and the master table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmetrics.functions.numbers import over_all, percent
from shelfmetrics.functions.prices import price_bucket
from shelfmetrics.operators.cleaning import TRANSACTION_COLUMNS
from shelfmetrics.operators.profile import Profiler
from shelfmetrics.settings import BULK, CLEAN, NO_GEO, OUTLIER, REFUND, ZERO, Settings

PLACE_COLUMNS = ("state", "city_tier", "occasion")

FLAGGED_COLUMNS = (*TRANSACTION_COLUMNS, "category", *PLACE_COLUMNS, "data_flag")

MASTER_COLUMNS = (
    "order_id",
    "user_id",
    "product_id",
    "timestamp",
    "channel",
    "data_flag",
    "price",
    "quantity",
    "revenue",
    "price_bucket",
    "category",
    "claims",
    "ingredient_tags",
    "pack_size",
    "persona",
    "trend_affinity",
    "age_group",
    "income_bracket",
    "dietary_restriction",
    "state",
    "city_tier",
    "occasion",
)


def valid_prices(transactions: DataFrame, products: DataFrame) -> DataFrame:
    """Category and price of the rows the outlier bounds are computed from."""
    sold = transactions.filter((F.col("price") > 0) & (F.col("quantity") > 0))
    return sold.join(products.select("product_id", "category"), "product_id").select(
        "category", "price"
    )


def category_price_bounds(
    prices: DataFrame, profiler: Profiler, settings: Settings = Settings()
) -> DataFrame:
    """Quartiles per category and the fences around them.

    Products without a category form a group of their own here, so the group key
    carries whether there is one.
    """
    category = F.col("category")
    keyed = prices.select(
        category.isNotNull().alias("named"), F.coalesce(category, F.lit("")).alias("name"), "price"
    )
    quartiles = profiler.profile(keyed, ["named", "name"], {"q1": 0.25, "q3": 0.75})
    q1, q3 = F.col("q1"), F.col("q3")
    reach = F.lit(settings.fence) * (q3 - q1)
    return quartiles.select(
        F.when(F.col("named"), F.col("name")).alias("category"),
        "q1",
        "q3",
        (q3 - q1).alias("iqr"),
        (q1 - reach).alias("lower_bound"),
        (q3 + reach).alias("upper_bound"),
    )


def locate(transactions: DataFrame, geography: DataFrame) -> DataFrame:
    """Each transaction once, with a place and occasion and the number of ``places``.

    The places are reduced to one row per order before they are shuffled, and the
    join works on the ``order_id`` partitioning that deduplication leaves behind:
    the transactions do not move for it.
    """
    per_order = geography.groupBy("order_id").agg(
        F.min(F.struct(*PLACE_COLUMNS)).alias("place"), F.count(F.lit(1)).alias("places")
    )
    return transactions.join(per_order, "order_id", "left").select(
        *transactions.columns, "place.*", "places"
    )


def repeated_orders(located: DataFrame) -> DataFrame:
    """The orders that ``locate`` has found several places for: few, and usually none."""
    return located.filter(F.col("places") > 1).select("order_id")


def several_places(geography: DataFrame, repeated: DataFrame) -> DataFrame:
    """The places of the orders in ``repeated``.

    That is the written result of ``repeated_orders``, so Spark knows its size: a short one is
    broadcast and the places are read once without a shuffle.
    """
    return geography.join(repeated, "order_id", "left_semi").select("order_id", *PLACE_COLUMNS)


def every_place(located: DataFrame, repeated: DataFrame) -> DataFrame:
    """``locate`` with a row for each place of the orders that have several.

    ``repeated`` is the written result of ``several_places``, so Spark knows its size.
    Orders with one place pass; the others join their places again, in an inner join,
    which adaptive execution can split should one order have very many.
    """
    single = F.coalesce(F.col("places"), F.lit(1)) == 1
    several = located.filter(F.col("places") > 1).drop(*PLACE_COLUMNS)
    return located.filter(single).unionByName(several.join(repeated, "order_id"))


def flag_transactions(
    located: DataFrame,
    products: DataFrame,
    bounds: DataFrame,
    settings: Settings = Settings(),
) -> DataFrame:
    """Give every transaction of a known product its first matching quality flag.

    All columns of ``located`` and of the products ride along, so the master needs
    no second product join.
    """
    price, quantity = F.col("price"), F.col("quantity")
    flag = (
        F.when((price < 0) & (quantity < 0), REFUND)
        .when(price == 0, ZERO)
        .when(quantity > settings.bulk_above, BULK)
        .when(price > F.col("upper_bound"), OUTLIER)
        .when(F.col("places").isNull(), NO_GEO)
        .otherwise(CLEAN)
    )
    return (
        located.join(products, "product_id")
        .join(bounds.select("category", "upper_bound"), "category", "left")
        .withColumn("data_flag", flag)
        .drop("places", "upper_bound")
    )


def build_master(
    located: DataFrame,
    products: DataFrame,
    bounds: DataFrame,
    consumers: DataFrame,
    settings: Settings = Settings(),
) -> DataFrame:
    """The wide analysis table: flagged transactions of known consumers.

    Consumers, the larger of the two dimensions, join first: where that takes a
    shuffle, the rows are still narrow.
    """
    known = located.join(consumers, "user_id")
    return (
        flag_transactions(known, products, bounds, settings)
        .withColumn("revenue", F.col("price") * F.col("quantity"))
        .withColumn("price_bucket", price_bucket(F.col("price")))
        .select(*MASTER_COLUMNS)
    )


def flag_distribution(master: DataFrame) -> DataFrame:
    counted = master.groupBy("data_flag").agg(F.count(F.lit(1)).alias("n_rows"))
    share = percent(F.col("n_rows"), over_all(F.sum("n_rows")))
    return counted.withColumn("pct", F.round(share, 1)).orderBy(F.desc("n_rows"), "data_flag")


def core_clean_slice(master: DataFrame) -> DataFrame:
    return flag_slice(master, CLEAN)


def geo_enriched_slice(master: DataFrame) -> DataFrame:
    clean = flag_slice(master, CLEAN)
    return clean.filter(F.col("state").isNotNull() & F.col("city_tier").isNotNull())


def persona_slice(master: DataFrame, personas: tuple[str, ...]) -> DataFrame:
    return flag_slice(master, CLEAN).filter(F.col("persona").isin(*personas))


def flag_slice(master: DataFrame, flag: str) -> DataFrame:
    return master.filter(F.col("data_flag") == flag)
