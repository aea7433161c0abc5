"""Retail pricing analytics on Spark DataFrames."""

from shelfmetrics.plans.pipeline import Pipeline, pipeline_for
from shelfmetrics.plans.reports import REPORTS
from shelfmetrics.settings import Settings
from shelfmetrics.sources.tables import SourceTables

__all__ = ["Pipeline", "pipeline_for", "REPORTS", "Settings", "SourceTables"]
