"""Derive the five source tables from an order star schema.

The star schema (``lineitem orders part customer nation region events``) has no
dirty values of its own, so fixed rules on its columns plant the refunds, zero
prices, misspellings, blanks and gaps that the cleaning steps are there for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmetrics.settings import Settings
from shelfmetrics.sources.tables import SourceTables

# --------------------------------------------------------------------------
# The staging rules the expected results were computed with.
# --------------------------------------------------------------------------
CHANNELS = ("App", "Retail", "Gym Kiosk", "Website", "Marketplace")
STATES = (
    "New York",
    "California",
    "Texas",
    "Florida",
    "Colorado",
    "Illinois",
    "Georgia",
    "Washington",
)
AGE_GROUPS = ("18-24", "25-34", "35-44", "45-54", "55+")
PLAIN_CATEGORIES = {
    "ECONOMY": "Electrolyte Drink",
    "MEDIUM": "Meal Replacement",
    "LARGE": "Healthy Snack",
}
PERSONAS = {
    "BUILDING": "budget",
    "FURNITURE": "casual",
    "MACHINERY": "fitness",
    "HOUSEHOLD": "premium",
}
TIERS = {"AFRICA": "Tier 1", "AMERICA": "Tier 1", "ASIA": "Tier 2", "EUROPE": "Tier 3"}
TREND_AFFINITY = ("early-adopter", "mainstream", "traditional")
GENDERS = ("female", "male", "non-binary", "undisclosed")
DIETS = ("none", "vegetarian", "vegan", "gluten-free", "lactose-free", "halal")

# the star schema's product words and priorities stand in for claims and occasions
STAR_SETTINGS = Settings(
    claim_tokens={
        "vegan": "red",
        "high-protein": "small",
        "keto-friendly": "hot",
        "clean-label": "widget",
        "low-sugar": "ring",
        "halal": "plate",
    },
    late_night="1-URGENT",
)

TIE_BREAK = ("line_number", "product_id", "supplier_id", "list_price")


def star_sources(spark: SparkSession, root: str) -> SourceTables:
    def table(name: str) -> DataFrame:
        return spark.read.parquet(f"{root}/{name}.parquet")

    orders = table("orders")
    return SourceTables(
        transactions=_transactions(table("lineitem")),
        order_headers=orders.select(
            F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("user_id")
        ),
        tie_break=TIE_BREAK,
        product_metadata=_products(table("part")),
        consumer_insights=_consumers(table("customer")),
        geography_occasion=_geography(orders, table("customer"), table("nation"), table("region")),
        competitor_pricing=_competitors(table("events")),
    )


def _pick(names: tuple[str, ...], number: Column) -> Column:
    return _lookup(dict(enumerate(names)), (number % len(names)).cast("int"))


def _lookup(table: dict, key: Column) -> Column:
    pairs = [F.lit(entry) for pair in table.items() for entry in pair]
    return F.element_at(F.create_map(*pairs), key)


def _transactions(lineitem: DataFrame) -> DataFrame:
    c = F.col
    refund = (c("l_linenumber") == 7) & (c("l_returnflag") == "R")
    free = (c("l_linenumber") == 6) & (c("l_discount") == 0.0)
    sign = F.when(refund, -1).when(free, 0).otherwise(1)
    units = F.ceil(c("l_quantity") / F.lit(2.4)).cast("bigint")
    unit_price = F.try_divide(c("l_extendedprice"), c("l_quantity")) / 100
    return lineitem.select(
        c("l_orderkey").alias("order_id"),
        c("l_partkey").alias("product_id"),
        (sign * unit_price).alias("price"),
        (F.when(refund, -1).otherwise(1) * units).alias("quantity"),
        c("l_shipdate").alias("timestamp"),
        _pick(CHANNELS, c("l_suppkey")).alias("channel"),
        c("l_linenumber").alias("line_number"),
        c("l_suppkey").alias("supplier_id"),
        c("l_extendedprice").alias("list_price"),
    )


def _products(part: DataFrame) -> DataFrame:
    kind, size = F.col("p_type"), F.col("p_size")
    even = size % 2 == 0
    category = (
        F.when(kind == "STANDARD", F.when(even, "Proten Shake").otherwise("Protein Shake"))
        .when(kind == "SMALL", F.when(even, "Protein bar ").otherwise("Protein Bar"))
        .when(kind == "PROMO", F.when(size % 10 == 0, "").otherwise("Supplement"))
        .otherwise(_lookup(PLAIN_CATEGORIES, kind))
    )
    pack = F.when(size % 5 < 3, "Single").when(size % 5 == 3, "4-Pack").otherwise("12-Pack")
    return part.select(
        F.col("p_partkey").alias("product_id"),
        category.alias("category"),
        F.replace(F.col("p_name"), F.lit(" "), F.lit(", ")).alias("claims"),
        F.when(size % 13 == 0, "").otherwise(F.col("p_brand")).alias("ingredient_tags"),
        pack.alias("pack_size"),
    )


def _consumers(customer: DataFrame) -> DataFrame:
    key, segment, balance = F.col("c_custkey"), F.col("c_mktsegment"), F.col("c_acctbal")
    persona = F.when(
        segment == "AUTOMOBILE", F.when(key % 4 == 0, " ").otherwise("casual")
    ).otherwise(_lookup(PERSONAS, segment))
    income = F.when(balance < 2500, "Low").when(balance < 7500, "Medium").otherwise("High")
    return customer.select(
        key.alias("user_id"),
        persona.alias("persona"),
        _pick(TREND_AFFINITY, key).alias("trend_affinity"),
        _pick(AGE_GROUPS, key).alias("age_group"),
        _pick(GENDERS, key).alias("gender_identity"),
        income.alias("income_bracket"),
        _pick(DIETS, key).alias("dietary_restriction"),
    )


def _geography(
    orders: DataFrame, customer: DataFrame, nation: DataFrame, region: DataFrame
) -> DataFrame:
    nation_key = F.col("n_nationkey")
    state = (
        F.when(nation_key == 0, "NY")
        .when(nation_key == 1, "Calfornia")
        .otherwise(_pick(STATES, nation_key))
    )
    missing = (F.col("o_orderstatus") == "P") & (F.col("o_orderpriority") == "5-LOW")
    places = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        nation_key,
        state.alias("state"),
        F.coalesce(_lookup(TIERS, F.col("r_name")), F.lit("Unknown")).alias("city_tier"),
    )
    buyers = customer.join(places, F.col("c_nationkey") == nation_key).select(
        "c_custkey", "state", "city_tier"
    )
    return (
        orders.filter(~missing)
        .join(buyers, F.col("o_custkey") == F.col("c_custkey"))
        .select(
            F.col("o_orderkey").alias("order_id"),
            "state",
            "city_tier",
            F.col("o_orderpriority").alias("occasion"),
        )
    )


def _competitors(events: DataFrame) -> DataFrame:
    return events.select(
        F.concat(F.lit("COMP"), F.col("user_id").cast("string")).alias("competitor_product_id"),
        F.when(F.col("event_type") != "error", F.col("value")).alias("price"),
        F.col("ts").alias("timestamp"),
    )
