"""The five source tables: schemas, readers and the bundle handed to the pipeline."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_S, _D, _I, _TS = T.StringType(), T.DoubleType(), T.IntegerType(), T.TimestampNTZType()


def _schema(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


SCHEMAS = {
    "transactions": _schema(
        order_id=_S, user_id=_S, product_id=_S, price=_D, quantity=_I, timestamp=_TS, channel=_S
    ),
    "product_metadata": _schema(
        product_id=_S, category=_S, claims=_S, ingredient_tags=_S, pack_size=_S
    ),
    "consumer_insights": _schema(
        user_id=_S,
        persona=_S,
        trend_affinity=_S,
        age_group=_S,
        gender_identity=_S,
        income_bracket=_S,
        dietary_restriction=_S,
    ),
    "geography_occasion": _schema(order_id=_S, state=_S, city_tier=_S, occasion=_S),
    # price stays text until blanks are dropped
    "competitor_pricing": _schema(competitor_product_id=_S, price=_S, timestamp=_S),
}


@dataclass(frozen=True)
class SourceTables:
    """One deployment's source tables.

    ``order_headers`` is for feeds that keep the buyer on the order instead of
    on each transaction: ``order_id`` and ``user_id``, of which one row per order
    counts. It is attached after deduplication, when every order is down to one row.
    ``tie_break`` names the transaction columns that order the rows of one order
    that share a timestamp.
    """

    transactions: DataFrame
    product_metadata: DataFrame
    consumer_insights: DataFrame
    geography_occasion: DataFrame
    competitor_pricing: DataFrame
    order_headers: DataFrame | None = None
    tie_break: tuple[str, ...] = ()


def collated(sources: SourceTables, collation: str) -> SourceTables:
    """The same tables with all text under ``collation``.

    Spark then joins, groups, sorts and compares by it wherever a column is used: under
    ``UTF8_LCASE``, ``ny`` is ``NY``. Of spellings that are one group any may be shown.
    """

    def table(rows: DataFrame) -> DataFrame:
        text = [f.name for f in rows.schema.fields if isinstance(f.dataType, T.StringType)]
        return rows.withColumns({name: F.collate(F.col(name), collation) for name in text})

    held = {f.name: getattr(sources, f.name) for f in fields(sources)}
    return replace(sources, **{k: table(v) for k, v in held.items() if isinstance(v, DataFrame)})


def read_csv_table(spark: SparkSession, name: str, path: str) -> DataFrame:
    """Read one source table from CSV, with a header line and the declared schema.

    Spark reads an empty field as NULL, but the cleaning rules speak of blank
    text, so text columns get their blanks back.
    """
    schema = SCHEMAS[name]
    text = [f.name for f in schema.fields if isinstance(f.dataType, T.StringType)]
    rows = spark.read.csv(path, schema=schema, header=True, enforceSchema=False, escape='"')
    return rows.fillna("", subset=text)


def read_parquet_table(spark: SparkSession, name: str, path: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(path)


def read_sources(spark: SparkSession, root: str, file_format: str = "parquet") -> SourceTables:
    """All five tables from ``root``, one file or folder per table."""
    reader = {"csv": read_csv_table, "parquet": read_parquet_table}[file_format]
    return SourceTables(
        **{name: reader(spark, name, f"{root}/{name}.{file_format}") for name in SCHEMAS}
    )
