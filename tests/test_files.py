from __future__ import annotations

import datetime as dt
from pathlib import Path

import pytest
from helpers import rows

from shelfmetrics import Pipeline, Settings
from shelfmetrics.operators.cleaning import clean_competitor_pricing, clean_product_metadata
from shelfmetrics.plans.reports import REPORTS
from shelfmetrics.sinks import files
from shelfmetrics.sources.tables import SCHEMAS, read_csv_table, read_sources


def text_of(folder: Path) -> str:
    return "".join(
        part.read_bytes().decode() for part in sorted(folder.glob("part-*"))
    )


def test_csv_blanks_stay_blank_and_quotes_are_read(spark, tmp_path):
    source = tmp_path / "products.csv"
    source.write_text(
        "product_id,category,claims,ingredient_tags,pack_size\n"
        'P1,,"nut-free, clean-label","whey, oats",Single\n'
        "P2,Proten Shake,vegan,,4-Pack\n"
    )
    table = read_csv_table(spark, "product_metadata", str(source))
    assert rows(table)[0] == ("P1", "", "nut-free, clean-label", "whey, oats", "Single")
    assert rows(clean_product_metadata(table)) == [
        ("P1", "Unknown", "nut-free, clean-label", "whey, oats", "Single"),
        ("P2", "Protein Shake", "vegan", None, "4-Pack"),
    ]


def test_competitor_csv_to_cleaned_export(spark, tmp_path):
    source = tmp_path / "competitors.csv"
    source.write_text(
        "competitor_product_id,price,timestamp\n"
        "rival-a,,2031-01-05 08:30:00.5\n"
        "rival-a,7.25,2031-02-06 08:30:00.5\n"
        "rival-b,31.40,2031-03-07 08:30:00.5\n"
    )
    cleaned = clean_competitor_pricing(read_csv_table(spark, "competitor_pricing", str(source)))
    files.write_table_csv(cleaned, str(tmp_path / "out"))
    assert text_of(tmp_path / "out") == (
        '"competitor_product_id";"price";"price_date"\r\n'
        '"rival-a";7.25;"2031-02-06"\r\n'
        '"rival-b";31.40;"2031-03-07"\r\n'
    )


def test_table_export_quotes_text_and_nothing_else(frame, tmp_path):
    """Separators, quotes, line breaks, blanks, missing values and odd names, read back by a CSV reader."""
    import csv
    import io

    given = [
        (" a;b ", 'say "no"', 1, 2.5, dt.datetime(2031, 1, 2, 3, 4, 5), True),
        ("", None, None, None, None, None),
        ("two\nlines", "\\ back", -7, 1e9, dt.datetime(2031, 1, 2), False),
    ]
    table = frame(given, "`a b` string, `c;\"d` string, n int, x double, at timestamp, ok boolean").coalesce(1)
    files.write_table_csv(table, str(tmp_path / "out"))
    text = text_of(tmp_path / "out")
    lines = text.split("\r\n")
    assert lines[0] == '"a b";"c;""d";"n";"x";"at";"ok"'
    assert lines[1] == '" a;b ";"say ""no""";1;2.5;"2031-01-02 03:04:05";true'
    assert lines[2] == '"";;;;;' and lines[-1] == ""
    two = table.repartition(2)
    files.write_table_csv(two, str(tmp_path / "two"))
    heads = [part.read_bytes().split(b"\r\n")[0] for part in (tmp_path / "two").glob("part-*") if part.stat().st_size]
    assert heads and {head.decode() for head in heads} == {lines[0]}
    read = list(csv.reader(io.StringIO(text, newline=""), delimiter=";"))
    assert read[3][:3] == ["two\nlines", "\\ back", "-7"] and len(read) == 4


def test_master_files_follow_the_bytes(spark, tmp_path):
    """Many tasks that each meet every flag leave a few files per flag."""
    rows = spark.range(20_000, numPartitions=40).selectExpr(
        "id", "if(id % 100 < 97, 'clean', concat('flag', id % 100)) AS data_flag", "uuid() AS text"
    )
    files.write_master(rows, str(tmp_path / "small"))
    counts = {p.name: len(list(p.glob("part-*"))) for p in (tmp_path / "small").glob("data_flag=*")}
    assert len(counts) == 4 and max(counts.values()) <= 2
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    try:
        files.write_master(rows, str(tmp_path / "split"))
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    parts = len(list((tmp_path / "split" / "data_flag=clean").glob("part-*")))
    assert 4 <= parts <= 40
    assert spark.read.parquet(str(tmp_path / "split")).count() == 20_000


def test_report_csv_spells_missing_values(frame, tmp_path):
    report = frame(
        [("$0–5", 314, None, ""), ("a, b", 1, 2.5, "◄ THRESHOLD")],
        "price_bin string, n long, pct double, flag string",
    ).coalesce(1)
    files.write_report_csv(report, str(tmp_path / "out"))
    assert text_of(tmp_path / "out").splitlines() == [
        "price_bin,n,pct,flag",
        "$0–5,314,NULL,",
        '"a, b",1,2.5,◄ THRESHOLD',
    ]


def test_master_export_has_a_folder_per_flag(spark, frame, tmp_path):
    master = frame([("clean", 1.0), ("bulk_order", 2.0)], "data_flag string, price double")
    files.write_master(master, str(tmp_path / "master"))
    assert {p.name for p in (tmp_path / "master").glob("data_flag=*")} == {
        "data_flag=clean",
        "data_flag=bulk_order",
    }
    assert spark.read.parquet(str(tmp_path / "master")).count() == 2


CSV_TABLES = {
    "transactions": (
        "o1,u1,p1,12.5,2,2025-01-01 10:00:00,App\n"
        "o1,u1,p1,12.5,2,2025-01-01 10:00:00,App\n"
        "o2,u2,p1,-9,-1,2025-01-02 10:00:00,Retail\n"
        "o3,u1,p2,8,1,2025-01-03 10:00:00,App\n"
    ),
    "product_metadata": 'p1,Protein bar ,"vegan, halal",,Single\np2,,kosher,soy,4-Pack\n',
    "consumer_insights": "u1,,t,18-24,f,Low,none\nu2,budget,t,55+,m,High,none\n",
    "geography_occasion": "o1,NY,Tier 1,gym\no2,Texas,Unknown,gym\n",
    "competitor_pricing": "c1,,2025-05-26 20:07:07\n",
}


def write_csv_sources(folder):
    for name, body in CSV_TABLES.items():
        header = ",".join(SCHEMAS[name].names)
        (folder / f"{name}.csv").write_text(f"{header}\n{body}")


@pytest.mark.parametrize("file_format", ["csv", "parquet"])
def test_whole_pipeline_from_files(spark, workspace, tmp_path, file_format):
    write_csv_sources(tmp_path)
    sources = read_sources(spark, str(tmp_path), "csv")
    if file_format == "parquet":
        for name in SCHEMAS:
            files.write_table_parquet(getattr(sources, name), str(tmp_path / f"{name}.parquet"))
        sources = read_sources(spark, str(tmp_path))
    pipeline = Pipeline(sources, workspace, Settings())
    found = pipeline.master.select("order_id", "data_flag", "category", "persona", "state")
    assert sorted(rows(found)) == [
        ("o1", "clean", "Protein Bar", "unknown", "New York"),
        ("o2", "return_refund", "Protein Bar", "budget", "Texas"),
        ("o3", "no_geo", "Unknown", "unknown", None),
    ]
    for name, report in REPORTS.items():
        assert report(pipeline).columns, name


def test_export_from_the_command_line(spark, tmp_path):
    from shelfmetrics.__main__ import main

    write_csv_sources(tmp_path)
    names = ["master_sales", "clean_competitor_pricing", "flag_distribution", "demand_by_bin"]
    main([str(tmp_path), str(tmp_path / "out"), "--format", "csv", "--scratch", str(tmp_path / "own"), "--only", *names])
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == sorted(names)
    assert text_of(tmp_path / "out" / "flag_distribution").splitlines() == [
        "data_flag,n_rows,pct",
        "clean,1,33.3",
        "no_geo,1,33.3",
        "return_refund,1,33.3",
    ]


def test_stages_as_views(spark, workspace, tmp_path):
    write_csv_sources(tmp_path)
    Pipeline(read_sources(spark, str(tmp_path), "csv"), workspace).register_views()
    found = spark.sql(
        "SELECT m.category, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 1)"
        " FROM master_sales m JOIN category_price_bounds USING (category)"
        " WHERE data_flag <> 'bulk_order' GROUP BY m.category ORDER BY n DESC"
    )
    assert [(r[0], r[1], float(r[2])) for r in rows(found)] == [
        ("Protein Bar", 2, 66.7),
        ("Unknown", 1, 33.3),
    ]
