"""The epsilon grid join against all pairs."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrameWriter

from shelfmetrics.llm import embeddings

SCHEMA = "vec_id bigint, embedding array<double>"


def expected(rows):
    usable = {}
    for at, (_, vector) in enumerate(rows):
        if vector and all(v is not None and np.isfinite(v) for v in vector) and any(vector):
            usable[at] = np.array(vector, float) / np.abs(vector).max()
    links = {at: set() for at in range(len(rows))}
    for a, x in usable.items():
        for b, y in usable.items():
            if a != b and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.9:
                links[a].add(b)
    out = []
    for at, (vec, _) in enumerate(rows):
        seen, todo = {at}, [at]
        while todo:
            for other in links[todo.pop()] - seen:
                seen.add(other)
                todo.append(other)
        least = min((rows[k][0] for k in seen if rows[k][0] is not None), default=vec)
        out.append((vec, len(links[at]), least, vec == least))
    return sorted(out, key=repr)


def check(spark, rows, **settings):
    found = embeddings.similar_vectors(spark.createDataFrame(rows, SCHEMA), embeddings.Settings(**settings))
    assert sorted(map(tuple, found.collect()), key=repr) == expected(rows)


def test_matches_all_pairs(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(25, 12))
    rows = [
        (int(k), (centres[rng.integers(25)] + rng.normal(scale=0.35, size=12)).tolist()) for k in rng.permutation(400)
    ]
    rows += [(1000 + k, rows[k % 5][1]) for k in range(20)]
    check(spark, rows, block_bytes=8 * 12 * 16, fan_out_bits=2)


def test_defined_cases(spark):
    rows = [
        (1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]),
        (9, [1.0, 2.0]), (8, [2.0, 4.0]), (7, [1.0, 2.0, 0.0]), (8, [1.0, 2.1]), (None, [1e300, 2e300]),
        (11, [-1.0, -2.0]), (12, [1e-300, 2e-300]),
    ]
    check(spark, rows)
    check(spark, rows[:6])
    check(spark, rows[6:7])
    extra = spark.createDataFrame([(1, [1.0], "x")], "vec_id bigint, embedding array<float>, cid string")
    assert embeddings.similar_vectors(extra).collect()[0].n_links == 0
    assert embeddings.similar_vectors(extra.limit(0)).count() == 0


def test_local_roots():
    root = embeddings.local_roots(6, np.array([4, 3, 1]), np.array([3, 1, 5]))
    assert root.tolist() == [0, 1, 2, 1, 1, 1]


def test_vectors_keep_their_precision():
    single = np.array([0.5, -0.1, 1e-42, 0.0], np.float32).astype(float)
    for vector in (single, np.array([0.5, 0.1]), np.array([0.5, 1e-60]), np.array([])):
        assert np.array_equal(embeddings.unpacked(embeddings.packed(vector), len(vector)), vector)
    assert len(embeddings.packed(single)) == 16


def test_single_precision_rules_no_link_out():
    """Rows whose cosines lie around the bound, closer than single precision tells; few of them and nearly all."""
    rng = np.random.default_rng(9)
    base = rng.normal(size=48)
    base /= np.linalg.norm(base)
    for near, far in ((60, 400), (200, 10)):
        across = rng.normal(size=(near, 48))
        across -= np.outer(across @ base, base)
        across /= np.linalg.norm(across, axis=1, keepdims=True)
        cosines = 0.9 + rng.normal(scale=1e-7, size=near)
        rows = cosines[:, None] * base + np.sqrt(1 - cosines**2)[:, None] * across
        y = np.vstack([rows * rng.uniform(0.1, 9, (near, 1)), rng.normal(size=(far, 48))])
        a, b = embeddings._linked(base[None] * 3, y, 0.9)
        assert not a.any() and b.tolist() == [k for k in range(near) if cosines[k] >= 0.9 and cosines[k] - 0.9 > 1e-14]


def test_blocks_are_not_shuffled_to_be_compared(spark, monkeypatch):
    """Every block has a pair with every other one: what is on disk must not grow with the pairs."""
    plans = []

    def parquet(self, path, *args, write=DataFrameWriter.parquet, **more):
        plans.append(self._df._jdf.queryExecution().executedPlan().toString())
        return write(self, path, *args, **more)

    monkeypatch.setattr(DataFrameWriter, "parquet", parquet)
    rng = np.random.default_rng(10)
    rows = [(k, rng.normal(size=6).tolist()) for k in range(200)]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        for held in (4, 64):
            check(spark, rows, block_bytes=8 * 6 * 10, held_bytes=8 * 6 * 10 * held)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    compared = [plan for plan in plans if "x_vectors" in plan and "y_vectors" in plan]
    assert compared and not any("hashpartitioning" in plan for plan in compared)
