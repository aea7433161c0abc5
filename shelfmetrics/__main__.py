"""Build the pipeline over a folder of source tables and export its results.

    python -m shelfmetrics SOURCES OUT [--format csv|parquet] [--only NAME ...] [--scratch FOLDER]
"""

from __future__ import annotations

import argparse

from shelfmetrics.plans.pipeline import Pipeline
from shelfmetrics.plans.reports import CLEANING, REPORTS
from shelfmetrics.plans.workspace import Workspace
from shelfmetrics.session import build_session
from shelfmetrics.sinks.files import write_master, write_report_csv, write_table_csv
from shelfmetrics.sources.tables import read_sources


def export(pipeline: Pipeline, folder: str, names: list[str]) -> None:
    """One folder per result: reports and cleaned tables as CSV, the master as Parquet."""
    for name in names:
        rows, path = REPORTS[name](pipeline), f"{folder}/{name}"
        if name == "master_sales":
            write_master(rows, path)
        elif name in CLEANING and name != "flag_distribution":
            write_table_csv(rows, path)
        else:
            write_report_csv(rows, path)


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="shelfmetrics")
    parser.add_argument("sources")
    parser.add_argument("out")
    parser.add_argument("--format", choices=("csv", "parquet"), default="parquet")
    parser.add_argument("--only", nargs="+", choices=sorted(REPORTS), default=list(REPORTS))
    parser.add_argument("--scratch", help="local folder for stages, where the session names none")
    chosen = parser.parse_args(arguments)
    spark = build_session()
    sources = read_sources(spark, chosen.sources, chosen.format)
    pipeline = Pipeline(sources, Workspace(spark, chosen.scratch))
    try:
        export(pipeline, chosen.out, chosen.only)
    finally:
        pipeline.close()


if __name__ == "__main__":
    main()
