"""Pivotal rounding: targets, conservation of words, defined cases."""

from __future__ import annotations

from collections import defaultdict

import pytest

from shelfmetrics.llm import mixing

SCHEMA = "doc_id bigint, text string, source string, size string, copies string"


def made(spark, rows):
    return spark.createDataFrame([(i, t, s, "x", "y") for i, t, s in rows], SCHEMA)


def targets(sizes: dict, weights=(5, 2, 1), most=3) -> dict:
    """Water filling as stated: cap, share the excess by weight, again until none is above."""
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    total, full = sum(sizes.values()), set()
    while True:
        left = [s for s in order if s not in full]
        rest = total - sum(most * sizes[s] for s in full)
        share = {s: rest * weight[s] / sum(weight[x] for x in left) for s in left}
        above = {s for s in left if share[s] > most * sizes[s]}
        if not above:
            return share | {s: float(most * sizes[s]) for s in full}
        full |= above


def test_targets_and_words(spark):
    rows = [
        (k, " ".join(["w"] * (1 + (k * 7) % 23)), ["a", "b", "c", "d", None][min(k % 9, 4)])
        for k in range(600)
    ]
    rows += [(1000 + k, "one two", "tiny") for k in range(3)]
    found = mixing.mix_report(made(spark, rows)).collect()
    sizes, taken = defaultdict(int), defaultdict(int)
    for row in found:
        sizes[row.source] += row.size
        taken[row.source] += row.taken
        assert row.taken == row.copies * row["size"] and 0 <= row.copies <= 3
    wanted = targets(sizes)
    for row in found:
        assert row.source_size == sizes[row.source]
        assert row.target == pytest.approx(wanted[row.source])
    for source, target in wanted.items():
        assert abs(taken[source] - target) <= 23
    again = mixing.mix_report(made(spark, rows).repartition(3)).collect()
    assert sorted(map(tuple, found), key=repr) == sorted(map(tuple, again), key=repr)


def test_expected_copies_are_kept(spark):
    """Over many seeds a document gets its share on average."""
    rows = [(k, "w " * (1 + k % 5), "a" if k < 40 else "b") for k in range(80)]
    docs = made(spark, rows)
    total, runs = defaultdict(float), 6
    for seed in range(runs):
        for row in mixing.mix_report(docs, seed=seed).collect():
            total[row.source] += row.copies / runs / 40
    report = {r.source: r.target / r.source_size for r in mixing.mix_report(docs).collect()}
    for source, share in report.items():
        assert total[source] == pytest.approx(share, abs=0.08)


def test_defined_cases(spark):
    rows = [(1, None, "a"), (2, " \t\n", "a"), (3, "x y", "a"), (3, "x y", "a"), (None, "z", None), (4, "z", "b")]
    found = mixing.mix_report(made(spark, rows)).collect()
    assert len(found) == len(rows)
    assert all(r.taken == 0 for r in found if r["size"] == 0)
    assert {r.source for r in found} == {"a", "b", None}
    assert mixing.mix_report(made(spark, rows[:0])).count() == 0
    assert mixing.mix_report(made(spark, rows[:2])).collect()[0].target == 0


def test_mixed_rows_repeat_as_reported(spark):
    rows = [(k, "w " * (1 + k % 4), "ab"[k % 2]) for k in range(30)] + [(0, "w ", "a")] * 2
    docs = made(spark, rows)
    wanted = defaultdict(int)
    for row in mixing.mix_report(docs).collect():
        wanted[row.doc_id] += row.copies
    got = defaultdict(int)
    mixed = mixing.mix(docs)
    assert mixed.columns == [*docs.columns, "copy"]
    for row in mixed.collect():
        got[row.doc_id] += 1
    assert got == {k: n for k, n in wanted.items() if n}
