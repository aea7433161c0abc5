"""Every registered query against DuckDB."""

from __future__ import annotations

import dataclasses
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as contract
from shelfmetrics import Pipeline
from shelfmetrics.plans.reports import REPORTS
from shelfmetrics.sources.orders_star import STAR_SETTINGS, star_sources

DATA = Path("/root/testdata/sf0.01")
TYPES = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE"}

pytestmark = pytest.mark.skipif(not DATA.is_dir(), reason="needs the generated tables")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in DATA.glob("*.parquet"):
        connection.execute(f"CREATE VIEW {table.stem} AS FROM '{table}'")
    return connection


def expected(duck, name):
    relation = duck.sql(contract.oracle_sql()[name])
    types = dict(zip(relation.columns, map(str, relation.types)))
    order = [relation.columns.index(c) for c in sorted(relation.columns)]
    return types, [tuple(row[i] for i in order) for row in relation.fetchall()]


def test_every_report_is_registered_with_its_counterpart():
    assert set(REPORTS) <= set(contract.queries())
    assert set(REPORTS) <= set(contract.oracle_sql()) <= set(contract.queries())
    assert len(REPORTS) == 34


@pytest.mark.parametrize("name", REPORTS)
def test_registered_query(spark, duck, name):
    found = contract.queries()[name](spark, str(DATA))
    types, wanted = expected(duck, name)
    assert {f.name: TYPES[f.dataType.simpleString()] for f in found.schema} == types
    got = [tuple(row) for row in found.select(*sorted(found.columns)).collect()]
    assert sorted(got, key=repr) == sorted(wanted, key=repr)
    assert wanted


@pytest.mark.parametrize(
    "name", [n for n in REPORTS if n.startswith(("demand", "persona_c", "state", "occasion"))]
)
def test_reports_come_sorted(spark, duck, name):
    found = contract.queries()[name](spark, str(DATA))
    _, wanted = expected(duck, name)
    assert [tuple(row) for row in found.select(*sorted(found.columns)).collect()] == wanted


def test_entry(spark):
    found = contract.entry(spark)
    assert found.columns == ["data_flag", "n_rows", "pct"] and found.count() > 0


def test_copies_of_transactions_change_nothing(spark, workspace):
    small = str(DATA.with_name("sf0.001"))
    sources = star_sources(spark, small)
    copies = dataclasses.replace(
        sources,
        transactions=sources.transactions.union(sources.transactions.repartition(7)),
        order_headers=sources.order_headers.union(sources.order_headers),
    )
    once, copied = (Pipeline(s, workspace, STAR_SETTINGS) for s in (sources, copies))
    assert once.master.count() > 0
    assert once.master.exceptAll(copied.master).isEmpty()
    assert copied.master.exceptAll(once.master).isEmpty()
    assert once.bounds.exceptAll(copied.bounds).isEmpty()
