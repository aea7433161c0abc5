"""The prefix trie against dictionaries of whole sequences."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest

from shelfmetrics.llm import trie as module
from shelfmetrics.llm.trie import trie, trie_report, turn_lists

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def conversations_of(rows):
    out = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            out.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    # rows that tie in turn and role would be ordered by digest; the fixtures have none that differ
    return {conv: [t[2:] for t in sorted(turns)] for conv, turns in out.items()}


def plain_rebuilt(own):
    out = {}
    for conv, turns in own.items():
        h = zlib.crc32(str(conv).encode()) % 9
        out[conv] = own.get(conv - conv % 5, [])[:h] + turns[h:]
    return out


def plain_trie(sequences):
    members, ends = {}, {}
    for conv, turns in sequences.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(conv)
        ends.setdefault(tuple(turns), []).append(conv)
    out = []
    for node, some in members.items():
        below = [other for other in members if other[: len(node)] == node]
        saved = sum((len(members[o]) - 1) * len(o[-1][1].encode()) for o in below if o)
        leaves = sum(not any(len(c) == len(o) + 1 and c[: len(o)] == o for c in below) for o in below)
        children = sum(len(other) == len(node) + 1 for other in below)
        parent = min(members[node[:-1]]) if node else None
        text = ",".join(map(str, sorted(ends.get(node, []))))
        digest = hashlib.sha256(text.encode()).hexdigest()
        out.append((min(some), len(node), parent, len(some), children, leaves, saved, digest))
    return sorted(out, key=repr)


def check(found, sequences):
    got = sorted(map(tuple, found.collect()), key=repr)
    assert got == plain_trie(sequences)
    return got


def random_rows(rng, n):
    rows = []
    for conv in range(n):
        for turn in range(rng.randrange(1, 7)):
            role = rng.choice(["user", "assistant", None]) if turn > 1 else "user"
            rows.append((conv - 3, turn or None, role, rng.choice(["hi", "héllo", "", None, "ok ok"])))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_against_dictionaries(spark, seed):
    rows = random_rows(random.Random(seed), 120)
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    positive = [row for row in rows if row[0] >= 0]
    check(trie(turn_lists(frame)), conversations_of(rows))
    frame = spark.createDataFrame(positive, SCHEMA).repartition(5)
    check(trie_report(frame), plain_rebuilt(conversations_of(positive)))


@pytest.mark.parametrize("many", [1, 1_000_000])
def test_both_ways_to_parents(spark, monkeypatch, many):
    """All parents through one join or through the other."""
    monkeypatch.setattr(module, "MANY", many)
    rows = random_rows(random.Random(7), 60)
    check(trie(turn_lists(spark.createDataFrame(rows, SCHEMA))), conversations_of(rows))


def test_many_ends_in_small_chunks(spark, monkeypatch):
    """One sequence of a third of all conversations, its ids hashed piece by piece in numeric order."""
    monkeypatch.setattr(module, "CHUNK_BYTES", 40)
    rows = [(k, 0, "user", "same" if k % 3 == 0 else f"own {k}") for k in range(1, 700)]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(7)
    found = check(trie(turn_lists(frame)), conversations_of(rows))
    assert max(row[3] for row in found if row[1]) == 233


def test_rounds_follow_shared_turns(spark):
    """A long conversation of its own costs no rounds; one that another repeats in part does."""
    rows = [(1, k, "user", f"t{k}") for k in range(60)] + [(2, k, "user", f"t{k}") for k in range(7)]
    rows += [(3, k, "user", f"t{k}" if k < 5 else f"other {k}") for k in range(40)]
    sequences = conversations_of(rows)
    check(trie(turn_lists(spark.createDataFrame(rows, SCHEMA))), sequences)
    written = []
    stages = module.Stages(spark)
    stages.write_to = lambda r, path, *a, w=stages.write_to: written.append(path) or w(r, path, *a)
    lists = turn_lists(spark.createDataFrame(rows, SCHEMA))
    paths = lists.select("conv_id", module._chained(module.F.col("turns")).alias("turns"))
    module.peeled(stages, module._entering(stages, paths))
    assert len([path for path in written if "level=" in path]) == 8


def test_defined_cases(spark):
    wide = SCHEMA + ", turns int, key string, n_turns int, h int"
    rows = [
        (None, 0, "user", "nobody's"),
        (1, 1, "user", "b"),
        (1, None, "user", "a"),
        (2, None, None, None),
        (3, 0, "user", "x" * 50_000),
        (3, 0, "user", "x" * 50_000),
        (10, 0, "user", "a"),
        (10, 1, "user", "b"),
    ]
    frame = spark.createDataFrame([(*r, 1, "k", 2, 3) for r in rows], wide)
    check(trie(turn_lists(frame)), conversations_of(rows))
    check(trie_report(frame), plain_rebuilt(conversations_of(rows)))
    assert trie_report(frame.limit(0)).count() == 0
    # a role and a text that run together like another pair stay apart
    close = [(1, 0, "us", "er"), (2, 0, "user", ""), (3, 0, None, "user")]
    assert trie(turn_lists(spark.createDataFrame(close, SCHEMA))).count() == 4
    # ties in turn: the order in the file does not matter
    tied = [(1, 0, "user", "a"), (1, 0, "user", "b")]
    there = [(2, 0, "user", "b"), (2, 0, "user", "a")]
    assert trie(turn_lists(spark.createDataFrame(tied + there, SCHEMA))).count() == 3
    # a turnless conversation is a member of the root alone
    empty = [(4, 0, "user", f"t{zlib.crc32(b'4') % 9}")]
    assert zlib.crc32(b"4") % 9 > 0
    assert [tuple(r)[:6] for r in trie_report(spark.createDataFrame(empty, SCHEMA)).collect()] == [(4, 0, None, 1, 0, 1)]
