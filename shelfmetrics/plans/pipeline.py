"""From source tables to the master table, each stage written at most once."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from shelfmetrics.operators import cleaning, context, master
from shelfmetrics.operators.profile import Profiler, SharedSlices
from shelfmetrics.plans.workspace import Workspace
from shelfmetrics.settings import CLEAN, Settings
from shelfmetrics.sources.tables import SourceTables, collated


#: The key lists of the reports on plain columns; their slice counts come from one scan.
PLAIN_KEYS = (
    ("price_bucket",),
    ("income_bracket",),
    ("channel",),
    ("category",),
    ("age_group",),
    ("state",),
    ("city_tier",),
    ("occasion",),
    ("state", "occasion"),
    ("city_tier", "occasion"),
)
#: Those of the reports on a row per claim.
CLAIM_KEYS = (("claim",), ("claim", "category"))


class Pipeline:
    """The stages shared by all reports, each written once on first use.

    Written are: the deduplicated transactions with their place, so that bounds and
    master see the same choice of rows; the orders that have several places, and these;
    the bounds (one row per category); the master table, partitioned by flag so that
    reports on clean rows skip the rest; and what the profiles search percentiles in.
    ``close`` removes them.
    """

    def __init__(
        self, sources: SourceTables, workspace: Workspace, settings: Settings = Settings()
    ):
        self.sources = collated(sources, settings.collation) if settings.collation else sources
        self.workspace = workspace
        self.settings = settings

    @cached_property
    def products(self) -> DataFrame:
        return cleaning.clean_product_metadata(self.sources.product_metadata)

    @cached_property
    def consumers(self) -> DataFrame:
        return cleaning.clean_consumer_insights(self.sources.consumer_insights)

    @cached_property
    def geography(self) -> DataFrame:
        return cleaning.clean_geography(self.sources.geography_occasion)

    @cached_property
    def competitors(self) -> DataFrame:
        return cleaning.clean_competitor_pricing(self.sources.competitor_pricing, self.settings)

    @cached_property
    def located(self) -> DataFrame:
        """One row per order, from a single shuffle of the transactions.

        Order headers and places join on the key that deduplication has already
        partitioned by, after the copies are gone.
        """
        kept = cleaning.dedup_transactions(self.sources.transactions, self.sources.tie_break)
        if self.sources.order_headers is not None:
            kept = kept.join(cleaning.buyer_per_order(self.sources.order_headers), "order_id")
        sold = kept.select(*cleaning.TRANSACTION_COLUMNS)
        return self.workspace.save(master.locate(sold, self.geography), "located")

    @cached_property
    def deduped(self) -> DataFrame:
        return self.located.select(*cleaning.TRANSACTION_COLUMNS)

    @cached_property
    def placed(self) -> DataFrame:
        orders = self.workspace.save(master.repeated_orders(self.located), "repeated_orders")
        if orders.isEmpty():
            return self.located
        places = self.workspace.save(
            master.several_places(self.geography, orders), "several_places"
        )
        return master.every_place(self.located, places)

    @cached_property
    def bounds(self) -> DataFrame:
        prices = master.valid_prices(self.deduped, self.products)
        bounds = master.category_price_bounds(prices, Profiler(self.workspace), self.settings)
        return self.workspace.save(bounds, "bounds")

    @cached_property
    def flagged(self) -> DataFrame:
        return master.flag_transactions(
            self.placed, self.products, self.bounds, self.settings
        )

    @cached_property
    def master(self) -> DataFrame:
        built = master.build_master(
            self.placed, self.products, self.bounds, self.consumers, self.settings
        )
        return self.workspace.save(built, "master", partition_by="data_flag")

    @cached_property
    def clean(self) -> DataFrame:
        return master.flag_slice(self.master, CLEAN)

    @cached_property
    def profiler(self) -> Profiler:
        return Profiler(
            self.workspace,
            SharedSlices(self.workspace, self.clean, PLAIN_KEYS),
            SharedSlices(self.workspace, context.per_claim(self.clean), CLAIM_KEYS),
        )

    def register_views(self) -> None:
        """Make the stages available to ``spark.sql`` under their names."""
        for name, stage in {
            "clean_product_metadata": self.products,
            "clean_consumer_insights": self.consumers,
            "clean_geography": self.geography,
            "deduped_transactions": self.deduped,
            "category_price_bounds": self.bounds,
            "flagged_transactions": self.flagged.select(*master.FLAGGED_COLUMNS),
            "master_sales": self.master,
            "clean_competitor_pricing": self.competitors,
        }.items():
            stage.createOrReplaceTempView(name)

    def close(self) -> None:
        """Remove the written stages; DataFrames that read them end with this."""
        self.workspace.close()


_pipelines: dict[tuple, tuple[tuple, Pipeline]] = {}


def input_state(spark: SparkSession, root: str) -> tuple:
    """Path, size and time of change of every file below ``root``.

    A folder's own time says nothing of its files, least of all in an object store, so the files
    themselves are listed, as Spark does when it reads them.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(path, True)
    held = []
    while files.hasNext():
        one = files.next()
        held.append((one.getPath().toUri().getPath(), one.getLen(), one.getModificationTime()))
    return tuple(sorted(held))


def pipeline_for(
    spark: SparkSession, root: str, sources, settings: Settings, scratch: str | None = None
) -> Pipeline:
    """The pipeline of this session over ``root``, so that its stages are shared.

    ``sources`` is called with the session and ``root`` on first use, and again once a file
    below ``root`` has changed; the stages made from what was there before are then removed. A
    new Spark application starts afresh.
    """
    key = (spark.sparkContext.applicationId, root.rstrip("/"), repr(settings))
    state = input_state(spark, root)
    if key not in _pipelines or _pipelines[key][0] != state:
        if key in _pipelines:
            _pipelines.pop(key)[1].close()
        pipeline = Pipeline(sources(spark, root), Workspace(spark, scratch), settings)
        _pipelines[key] = state, pipeline
    return _pipelines[key][1]
