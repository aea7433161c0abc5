"""The recurrent network: gradients, learning, defined cases."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pyarrow as pa

from shelfmetrics.llm import language
from shelfmetrics.llm.words import slices

QUICK = language.Settings(fit_docs=80, fit_words=20, hidden=6, steps=150, batch=64)


def test_gradients_against_differences():
    rng = np.random.default_rng(0)
    weights = [
        rng.normal(0, 0.3, (256, 9)), rng.normal(0, 0.3, (256, 9)),
        rng.normal(0, 0.5, (3, 9)), rng.normal(0, 0.5, (3, 9)), rng.normal(0, 0.5, (6, 2)), rng.normal(0, 0.1, 2),
    ]
    rows, lengths = rng.integers(97, 101, (4, 5)).astype(np.uint8), np.array([5, 3, 1, 4])
    target, order = np.array([0, 1, 1, 0]), np.array([0, 3, 1, 2])

    def loss():
        model = language.Model(["a", "b"], weights[:2], weights[2:4], weights[4], weights[5])
        found = language.label_positions(model, rows[order], lengths[order])
        inside = np.arange(5) < lengths[order][:, None]
        return -(found[np.arange(4)[:, None], np.arange(5), target[order][:, None]] * inside).sum() / inside.sum()

    grads = language._gradients(weights, rows, lengths, target)
    for weight, grad in zip(weights, grads):
        for _ in range(4):
            place = tuple(rng.integers(0, n) for n in weight.shape)
            if weight.shape[0] == 256:
                place = (int(rng.integers(97, 101)), place[1])
            weight[place] += 1e-3
            above = loss()
            weight[place] -= 2e-3
            below = loss()
            weight[place] += 1e-3
            assert abs((above - below) / 2e-3 - grad[place]) < 3e-4


def test_segments_cover_every_word():
    text = "short " + "x" * 60 + "\nlast"
    part = next(slices(pa.array([text, None, "two words"])))
    starts, ends, firsts = language.segments(part, 24)
    found = [part.data[a:b].tobytes().decode() for a, b in zip(starts, ends)]
    assert found == ["short", "x" * 24, "x" * 24, "x" * 12, "last", "two", "words"]
    assert firsts.tolist() == [0, 5, 5, 7]


def corpus(rng, count):
    speech = {"aa": ["thing", "other", "which"], "bb": ["nicht", "ueber", "durch"], "cc": ["cosa", "otra", "para"]}
    rows = []
    for k in range(count):
        lang = rng.choice(list(speech))
        rows.append((k, " ".join(rng.choices(speech[lang], k=rng.randint(1, 30))), lang if k % 7 else None, lang))
    return rows


def test_held_out_documents_are_labelled(spark):
    rows = corpus(random.Random(6), 160)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, score string")
    found = {r.doc_id: r for r in language.identify(docs, settings=QUICK).collect()}
    assert len(found) == 160
    for doc, _, _, lang in rows:
        assert found[doc].held_out == (zlib.crc32(str(doc).encode()) % 4 == 2)
        assert found[doc].lang_pred == lang and 0 < found[doc].score <= 1


def test_defined_cases(spark):
    rows = [(1, None, "aa"), (2, "", "aa"), (3, "12 34 !!", "aa"), (4, "word", "aa"), (4, "word", "aa"), (None, "é" * 5000, "aa")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    found = language.identify(docs, settings=QUICK).collect()
    assert [r.lang_pred for r in found] == ["und", "und", "und", "aa", "aa", "aa"]
    assert all(r.score == (0 if r.lang_pred == "und" else 1) for r in found)
    unlabelled = docs.withColumn("lang", docs.lang.substr(9, 0)).where("false").unionByName(docs.limit(0))
    assert language.identify(unlabelled, settings=QUICK).count() == 0
    none = spark.createDataFrame([(1, "word", None)], "doc_id bigint, text string, lang string")
    assert language.identify(none, settings=QUICK).collect()[0].lang_pred == "und"
