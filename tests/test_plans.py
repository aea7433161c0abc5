"""What the plans must look like to hold at scale."""

from __future__ import annotations

import datetime as dt
import os
import re
from pathlib import Path

import pytest

from shelfmetrics import Pipeline, pipeline_for
from shelfmetrics.operators.cleaning import dedup_transactions
from shelfmetrics.operators.master import every_place, locate, repeated_orders, several_places
from shelfmetrics.operators.ranks import slice_counts
from shelfmetrics.plans.pipeline import PLAIN_KEYS
from shelfmetrics.plans.reports import REPORTS
from shelfmetrics.plans.workspace import Workspace, shared_folder
from shelfmetrics.settings import Settings
from shelfmetrics.sources.tables import SCHEMAS, SourceTables


def plan_of(frame_, capsys) -> str:
    capsys.readouterr()
    frame_.explain("formatted")
    return capsys.readouterr().out


@pytest.fixture(scope="module")
def pipeline(spark, workspace):
    sold = ("o", "u", "p", 9.0, 1, dt.datetime(2025, 1, 1), "App")
    one_row = {
        "transactions": sold,
        "product_metadata": ("p", "Protein Bar", "vegan", "", "Single"),
        "consumer_insights": ("u", "budget", "t", "55+", "g", "Low", "none"),
        "geography_occasion": ("o", "Texas", "Tier 1", "gym"),
        "competitor_pricing": ("c", "1.00", "2025-01-01 00:00:00"),
    }
    tables = {n: spark.createDataFrame([row], SCHEMAS[n]) for n, row in one_row.items()}
    return Pipeline(SourceTables(**tables), workspace, Settings())


def test_copies_are_dropped_before_the_shuffle(spark, capsys):
    empty = spark.createDataFrame([], SCHEMAS["transactions"])
    plan = plan_of(dedup_transactions(empty), capsys)
    tree = plan.split("\n\n")[0]
    assert tree.count("WindowGroupLimit") == 2 and tree.count("Exchange") == 1
    assert tree.index("WindowGroupLimit") < tree.index("Exchange") < tree.rindex("WindowGroupLimit")
    assert "Partial" in plan and "Aggregate" not in tree


def test_places_join_without_another_shuffle_of_the_transactions(spark, capsys):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        sold = spark.createDataFrame([], SCHEMAS["transactions"])
        places = spark.createDataFrame([], SCHEMAS["geography_occasion"])
        tree = plan_of(locate(dedup_transactions(sold), places), capsys).split("\n\n")[0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in tree and tree.count("Exchange") == 2
    # each side is sorted before and after its own shuffle, and neither again for the join
    assert tree.count("Sort (") == 4


@pytest.mark.parametrize("name", REPORTS)
def test_no_pairwise_joins_and_no_python(pipeline, capsys, name):
    plan = plan_of(REPORTS[name](pipeline), capsys)
    for unwanted in ("CartesianProduct", "NestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"):
        assert unwanted not in plan


def test_profile_reads_only_its_columns_of_the_clean_rows(pipeline, capsys):
    plan = plan_of(slice_counts(pipeline.clean, ["channel"], "price", {}), capsys)
    assert "ReadSchema: struct<channel:string,price:double>" in plan
    assert re.search(r"PartitionFilters: \[.*data_flag.* = clean", plan)


def test_slice_counts_shuffle_after_combining(pipeline, capsys):
    tree = plan_of(slice_counts(pipeline.clean, ["channel"], "price", {}), capsys).split("\n\n")[0]
    assert tree.index("HashAggregate") < tree.index("Exchange") < tree.rindex("HashAggregate")
    assert tree.count("Exchange") == 1 and "ObjectHash" not in tree and "Sort" not in tree


def test_no_report_gathers_the_values_of_a_group(pipeline, capsys):
    for name in REPORTS:
        assert "percentile_disc" not in plan_of(REPORTS[name](pipeline), capsys)


def test_plain_reports_share_one_scan_of_the_clean_rows(pipeline, capsys):
    shared, _ = pipeline.profiler.shared
    for keys in PLAIN_KEYS:
        own = plan_of(shared.of(pipeline.clean, list(keys)), capsys)
        assert "shared_slices" in own and "/master-" not in own
    assert shared.of(pipeline.master, ["state"]) is None
    assert shared.of(pipeline.clean, ["claims"]) is None


def test_plain_reports_share_the_search_for_percentiles(pipeline, capsys):
    """Two scans of the clean rows answer all of them: what they read is what was written."""
    shared, _ = pipeline.profiler.shared
    for keys in PLAIN_KEYS:
        own = plan_of(shared.ranks_of(pipeline.clean, list(keys), {"middle": 0.5, "high": 0.9}), capsys)
        assert "shared_ranks" in own and "/master-" not in own
    for name in ("income_sensitivity", "channel_tolerance", "state_pricing", "tier_occasion_mix", "claim_premium_power", "claim_category_matrix"):
        assert "/master-" not in plan_of(REPORTS[name](pipeline), capsys)
    assert shared.ranks_of(pipeline.clean, ["state"], {"low": 0.1}) is None
    assert shared.ranks_of(pipeline.master, ["state"], {"middle": 0.5}) is None


def test_places_of_repeated_orders_are_read_once_and_not_shuffled(spark, tmp_path, frame, capsys):
    places = [(f"o{k}", "Texas", "Tier 1", "gym") for k in range(50)] + [("o7", "Ohio", "Tier 2", "gym")]
    frame(places, SCHEMAS["geography_occasion"]).write.parquet(str(tmp_path / "places"))
    geography = spark.read.parquet(str(tmp_path / "places"))
    sold = frame([("o7", "u", "p", 9.0, 1, dt.datetime(2025, 1, 1), "App")], SCHEMAS["transactions"])
    space = Workspace(spark, str(tmp_path))
    located = space.save(locate(sold, geography), "located")
    orders = space.save(repeated_orders(located), "repeated_orders")
    several = several_places(geography, orders)
    tree = plan_of(several, capsys).split("\n\n")[0]
    assert tree.count("places") == 0 and tree.count("Scan parquet") == 2
    assert "BroadcastHashJoin" in tree and "Exchange hashpartitioning" not in tree
    assert sorted(r.state for r in every_place(located, space.save(several, "several")).collect()) == ["Ohio", "Texas"]


def test_asking_again_writes_nothing(pipeline, workspace):
    def written():
        return {p.name for p in Path(workspace.folder).iterdir()}

    REPORTS["state_pricing"](pipeline).collect()
    before = written()
    assert REPORTS["state_pricing"](pipeline).collect() is not None
    assert written() == before


def test_several_places_start_no_job(pipeline, spark):
    pipeline.placed
    group = "several places"
    spark.sparkContext.setJobGroup(group, group)
    try:
        every_place(pipeline.located, pipeline.geography)
        assert not spark.sparkContext.statusTracker().getJobIdsForGroup(group)
    finally:
        spark.sparkContext._jsc.clearJobGroup()


def test_rows_do_not_move_to_be_written_by_folder(spark, tmp_path):
    """One stage writes all folders, from tasks that meet every value in turn; the session's setting is as before."""
    setting, group = "spark.sql.maxConcurrentOutputFileWriters", "by folder"
    before = spark.conf.get(setting, None)
    rows = spark.range(9_000, numPartitions=3).selectExpr("id", "nullif(concat('flag', id % 20), 'flag7') AS flag")
    spark.sparkContext.setJobGroup(group, group)
    try:
        saved = Workspace(spark, str(tmp_path)).save(rows, "flags", partition_by="flag")
        tracker = spark.sparkContext.statusTracker()
        stages = [s for job in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(job).stageIds]
    finally:
        spark.sparkContext._jsc.clearJobGroup()
    assert len(stages) == 1 and spark.conf.get(setting, None) == before
    assert sorted(saved.collect(), key=lambda r: r.id) == rows.collect()


def test_without_repeated_orders_places_are_read_once(spark, pipeline):
    assert pipeline.located.where("places > 1").isEmpty()
    assert pipeline.placed is pipeline.located


def test_closing_removes_what_was_written(spark, tmp_path, frame):
    space = Workspace(spark, str(tmp_path))
    space.save(frame([(1,)], "x int"), "one")
    assert Path(space.folder).is_dir()
    space.close()
    assert not Path(space.folder).exists()


def test_changed_inputs_are_read_again(spark, tmp_path, frame):
    frame([(1,)], "x int").write.parquet(str(tmp_path / "in" / "t.parquet"))
    made = []

    def sources(session, root):
        made.append(root)
        return None

    def ask():
        return pipeline_for(spark, str(tmp_path / "in"), sources, Settings(), str(tmp_path))

    assert ask() is ask() and len(made) == 1
    frame([(2,), (3,)], "x int").write.mode("overwrite").parquet(str(tmp_path / "in" / "t.parquet"))
    old = ask()
    assert len(made) == 2
    old.workspace.save(frame([(1,)], "x int"), "stage")
    folder = Path(old.workspace.folder.removeprefix("file:"))
    assert list(folder.rglob("*.parquet"))
    # one part file is replaced by one of the same size: neither folder nor length tells
    part = next((tmp_path / "in" / "t.parquet").glob("part-*"))
    was = part.stat()
    os.utime(part, (was.st_atime + 9, was.st_mtime + 9))
    assert ask() is not old and len(made) == 3 and not folder.exists()
    # a file in a nested folder
    frame([(4,)], "x int").write.parquet(str(tmp_path / "in" / "t.parquet" / "day=2"))
    assert ask() and len(made) == 4


def test_top_list_is_a_bounded_sort(pipeline, capsys):
    assert "TakeOrderedAndProject" in plan_of(REPORTS["state_occasion_matrix"](pipeline), capsys)


class FakeSession:
    """Just enough of a session to ask where written tables go."""

    def __init__(self, master: str, configured: str | None = None, set_later: str | None = None):
        self.conf = {"spark.checkpoint.dir": configured} if configured else {}
        self.sparkContext = type(
            "Context", (), {"master": master, "getCheckpointDir": staticmethod(lambda: set_later)}
        )


def test_written_tables_go_to_the_folder_the_cluster_names():
    assert shared_folder(FakeSession("spark://host:1", "hdfs://shared/x")) == "hdfs://shared/x"
    assert shared_folder(FakeSession("yarn", None, "hdfs://y")) == "hdfs://y"
    with pytest.raises(ValueError):
        shared_folder(FakeSession("yarn"), "/tmp/own")
    with pytest.raises(ValueError):
        shared_folder(FakeSession("local[2]"))
    assert shared_folder(FakeSession("local[2]"), "/tmp/own") == "/tmp/own"
