"""The registered queries of the package: SQL counterparts and the pipeline."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as contract
import corpus_pipeline
from shelfmetrics.llm.queries import ORACLE_SQL, QUERIES

DATA = Path("/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not DATA.is_dir(), reason="needs the generated tables")


def test_every_operator_is_registered():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(contract.queries())
    assert set(ORACLE_SQL) <= set(contract.oracle_sql())


@pytest.mark.parametrize("name", ORACLE_SQL)
def test_query_against_sql(spark, name):
    duck = duckdb.connect()
    for table in DATA.glob("*.parquet"):
        duck.execute(f"CREATE VIEW {table.stem} AS FROM '{table}'")
    relation = duck.sql(ORACLE_SQL[name])
    found = QUERIES[name](spark, str(DATA))
    columns = sorted(found.columns)
    assert columns == sorted(relation.columns)
    wanted = relation.select(*(duckdb.ColumnExpression(c) for c in columns)).fetchall()
    got = [tuple(row) for row in found.select(*columns).collect()]
    assert sorted(got, key=repr) == sorted(wanted, key=repr) and got


def test_pipeline(spark, tmp_path):
    words = [f"{a}{b}{c}" for a in "bdfg" for b in "aeiou" for c in "lmnrs"]

    def text(seed, count=60):
        return " ".join(words[(seed * 37 + k * k * 11 + k * seed) % len(words)] for k in range(count))

    item = " ".join(words[k] for k in range(0, 60, 3))
    rows = [(k, text(k), "en", "ab"[k % 2], 300) for k in range(60)]
    rows += [(100 + k, text(k).upper().replace(" ", "!! "), "en", "a", 400) for k in range(30)]
    own = " ".join(word[::-1] for word in text(91).split())  # similar to no other line
    changed = text(7).split()
    changed[30] = "other"
    rows += [
        (200, text(5) + "\n" + own, "en", "a", 700),
        (201, " ".join(changed), "en", "a", 300),
        (202, text(70, 20) + " " + item + " " + text(71, 20), "en", "b", 400),
        (203, None, None, None, None),
    ]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(k, 1, 0) for k in range(60)] + [(100 + k, 0, 0) for k in range(30)]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(
        str(tmp_path / "labels.parquet")
    )
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(
        str(tmp_path / "benchmark.parquet")
    )
    from shelfmetrics.llm.stages import Stages

    stages, docs, ids = Stages(spark), spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for name, stage in corpus_pipeline.STAGES:
        docs = stages.write(stage(spark, docs, str(tmp_path)), name)
        ids.append({r.doc_id for r in docs.collect()})
        if name != "mixing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        if name == "lines":
            left = docs.where("doc_id = 200").collect()[0]
            assert left.text == own and left.n_chars == len(left.text)
    quality, lines, near, clean, mixed = ids
    assert quality == {r[0] for r in rows if not 100 <= r[0] < 130}
    assert near <= lines <= quality and 201 not in near and {5, 7, 200, 202, 203} <= near
    assert clean == near - {202} and mixed <= clean
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == docs.count()
