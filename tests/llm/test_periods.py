"""Periodic runs against every period at every place."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from fractions import Fraction

import pytest

from shelfmetrics.llm import periods
from shelfmetrics.llm.periods import find_runs, rebuilt, run_report, solve_tile, z_function
from shelfmetrics.llm.queries import op12_periods

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def plain_rebuilt(doc_id, words):
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a, out = g % n, []
    p = 1 + (n - a) // (3 + g % 8)
    for i in range(n):
        out.append(words[i] if i < a else words[a + (i - a) % p])
    return out


def plain_runs(words):
    """Every stretch where words p apart agree, for every p; the smallest period of equal stretches."""
    n, best = len(words), {}
    for p in range(1, n // 4 + 1):
        at = 0
        while at + p < n:
            if words[at] != words[at + p]:
                at += 1
                continue
            end = at
            while end + p < n and words[end] == words[end + p]:
                end += 1
            if end + p - at >= max(6, 4 * p):
                best.setdefault((at, end + p - at), p)
            at = end
    return sorted((start, length, p) for (start, length), p in best.items())


def expected(doc_id, text, change):
    words = WORD.findall((text or "").encode())
    if change:
        words = plain_rebuilt(doc_id, words)
    runs = sorted(plain_runs(words), key=lambda r: (r[0], r[2]))
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    lines = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    top = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None,) * 3
    share = 1000 * top[1] // top[2] if runs else None
    return (doc_id, len(runs), *top, share, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def check(frame, rows, change):
    found = sorted(map(tuple, frame.collect()), key=repr)
    wanted = sorted((expected(doc, text, change) for doc, text in rows), key=repr)
    assert found == wanted
    return wanted


def random_text(rng, vocabulary):
    """Stretches with periods of all sizes, some cut short or with one word changed."""
    out = []
    for _ in range(rng.randrange(6)):
        block = [rng.choice(vocabulary) for _ in range(rng.choice([1, 1, 2, 3, 5, 8, 13, 24]))]
        times = rng.choice([1, 2, 4, 5, 9])
        some = (block * times)[: max(1, len(block) * times - rng.randrange(len(block) + 1))]
        if rng.random() < 0.3:
            some[rng.randrange(len(some))] = rng.choice(vocabulary)
        out += some
    return rng.choice([" ", "  ", " \n", "\t"]).join(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_against_every_period(spark, seed):
    rng = random.Random(seed)
    rows = [(k, random_text(rng, "ab" if k % 3 else [f"w{i}" for i in range(40)])) for k in range(500)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    wanted = check(run_report(docs), rows, False)
    assert sum(row[1] for row in wanted) > 300
    check(run_report(docs, rebuilt), rows, True)


def test_long_runs_through_many_tiles(spark, monkeypatch):
    monkeypatch.setattr(periods, "TILES_TOGETHER", 2)
    monkeypatch.setattr(periods, "TILES_AT_ONCE", 3)
    rng = random.Random(9)
    same = "x " * 1_500
    periodic = " ".join([f"w{k}" for k in range(170)] * 9)
    nested = " ".join((["a", "b"] * 12 + ["c"]) * 30)
    mixed = " ".join(rng.choice("abcdefgh") for _ in range(2_000))
    rows = [(1, same), (2, mixed + " " + periodic + " " + mixed), (3, nested), (4, mixed), (5, periodic + " " + same)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    check(run_report(docs), rows, False)


def test_z_function_and_tiles():
    rng = random.Random(3)
    for _ in range(200):
        s = [rng.randrange(2) for _ in range(rng.randrange(1, 30))]
        plain = [next((k for k in range(len(s) - i) if s[k] != s[i + k]), len(s) - i) for i in range(len(s))]
        assert z_function(s) == plain
    assert solve_tile([7] * 8, 3, 1) == [(1, 3, 3)]
    assert solve_tile([7] * 16, 6, 2) == []  # a multiple of a smaller period
    assert solve_tile([1], 1, 1) == [] and solve_tile([], 0, 1) == []


def test_defined_cases(spark):
    schema = "doc_id bigint, text string, words string, first int, tile int, period int, text_hash string"
    run = "go on " * 5
    rows = [(1, None), (2, ""), (3, " \n "), (None, run), (None, run), (7, run), (7, "other"), (7, run), (8, "one")]
    docs = spark.createDataFrame([(*r, "w", 1, 2, 3, "h") for r in rows], schema)
    check(run_report(docs), rows, False)
    check(run_report(docs, rebuilt), rows, True)
    assert run_report(docs.limit(0)).count() == 0
    exotic = [(1, "a b " * 8), (2, "x\u001cy\vz\f" * 7), (3, "é É " * 6)]
    check(run_report(spark.createDataFrame(exotic, "doc_id bigint, text string")), exotic, False)
    named = spark.createDataFrame([("k", run)], "doc_id string, text string")
    assert run_report(named).collect()[0][:5] == ("k", 1, 0, 10, 2)
    _, runs = find_runs(named)
    assert [(r.start, r.length, r.period) for r in runs.collect()] == [(0, 10, 2)]


def test_registered_query(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect() if len(r.text) < 8_000]
    kept = {row[0] for row in rows}
    found = sorted((tuple(r) for r in op12_periods(spark, folder).collect() if r.doc_id in kept), key=repr)
    assert found == sorted((expected(doc, text, True) for doc, text in rows), key=repr)
    assert sum(row[1] > 0 for row in found) > 5
