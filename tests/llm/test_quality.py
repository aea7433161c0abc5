"""The factorisation machine and its use on Spark."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pyarrow as pa

from shelfmetrics.llm import quality

SMALL = quality.Settings(fit_rows=300, hash_bits=10, rank=4, steps=120, batch=32)


def test_linear_time_identity():
    rng = np.random.default_rng(0)
    model = quality.Model(0.3, rng.normal(size=40), rng.normal(size=(40, 3)), 4)
    numbers, values = np.array([1, 5, 9, 30, 2, 7]), rng.normal(size=6)
    margin, _, _ = quality._margin(model, numbers, values, np.array([0, 4, 6]))
    for at, (a, b) in enumerate([(0, 4), (4, 6)]):
        wanted = 0.3 + sum(model.linear[numbers[i]] * values[i] for i in range(a, b))
        for i in range(a, b):
            for j in range(i + 1, b):
                pair = model.factors[numbers[i]] @ model.factors[numbers[j]]
                wanted += pair * values[i] * values[j]
        assert np.isclose(margin[at], wanted)


def test_features_do_not_depend_on_the_batch():
    texts = ["One two two", None, "!!! ### |", "é " * 50, ""]
    whole = quality.features(pa.array(texts), pa.array([5, None, 3, 100, 0], pa.int64()), 8)
    first, numbers, values, begins = next(whole)
    assert first == 0 and len(begins) == 6
    for k, text in enumerate(texts):
        alone = pa.array([[5, None, 3, 100, 0][k]], pa.int64())
        _, n, v, b = next(quality.features(pa.array([text], pa.string()), alone, 8))
        assert numbers[begins[k] : begins[k + 1]].tolist() == n.tolist()
        assert np.allclose(values[begins[k] : begins[k + 1]], v)


def corpus(rng, count):
    words = ["river", "stone", "light", "green", "walks", "seven", "under"]
    rows, labels = [], []
    for k in range(count):
        good = k % 4 != 0
        text = " ".join(rng.choices(words, k=rng.randint(5, 40)))
        rows.append((k, text if good else text.upper().replace(" ", "!! "), len(text), "x"))
        labels.append((k, int(good)))
    return rows, labels


def test_held_out_documents_are_told_apart(spark):
    rows, labels = corpus(random.Random(1), 240)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_chars bigint, score string")
    marks = spark.createDataFrame(labels, "doc_id bigint, quality int")
    found = quality.classify(docs, marks, settings=SMALL).collect()
    assert len(found) == 240
    truth = dict(labels)
    for row in found:
        assert row.held_out == (zlib.crc32(str(row.doc_id).encode()) % 5 == 0)
        assert row.predicted == int(row.score >= 0.3) == truth[row.doc_id]
    kept = quality.keep_good(docs, marks, SMALL)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [k for k, good in labels if good]


def test_defined_cases(spark):
    rows = [(1, None, None), (1, "a b", 3), (1, "a b", 3), (None, "", 0), (2, "x" * 300_000, -5)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_chars bigint")
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    odd = spark.createDataFrame([(1, None), (2, 7), (None, 1)], "doc_id bigint, quality int")
    for labels in (none, odd):
        found = quality.classify(docs, labels, settings=SMALL).collect()
        assert [r.score for r in found] == [0.5] * 5 and all(r.predicted == 1 for r in found)
    assert quality.classify(docs.limit(0), none, settings=SMALL).count() == 0
    one = spark.createDataFrame([(1, 1), (2, 1)], "doc_id bigint, quality int")
    assert all(0.5 < r.score <= 1 for r in quality.classify(docs, one, settings=SMALL).collect())
    assert quality.classify(docs.drop("n_chars"), none, settings=SMALL).count() == 5
