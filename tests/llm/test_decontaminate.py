"""Contamination against exact containment of all pairs."""

from __future__ import annotations

import random
import re

from shelfmetrics.llm import decontaminate


def shingles(text):
    words = re.findall(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", (text or "").lower())
    if 0 < len(words) < 5:
        return {tuple(words)}
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)}


def expected(docs, items):
    out = []
    for doc, text in docs:
        held = shingles(text)
        for item, wanted in items:
            need = shingles(wanted)
            if need and 100 * len(need & held) >= 80 * len(need):
                out.append((doc, item, len(need & held), len(need)))
    return sorted(out, key=repr)


def test_matches_exact_containment(spark):
    rng = random.Random(9)

    def words(n):
        return [f"w{rng.randrange(400)}" for _ in range(n)]

    items = [(k, " ".join(words(rng.choice([6, 14, 30, 60, 300])))) for k in range(30)]
    docs = []
    for doc in range(120):
        text = words(rng.choice([3, 50, 2000]))
        if doc % 2:
            passage = rng.choice(items)[1].upper().split()
            if doc % 3 == 0:
                passage[len(passage) // 2] = "changed"
            at = rng.randrange(len(text))
            text[at:at] = [w + rng.choice(["", ",", "."]) for w in passage]
        docs.append((doc, " ".join(text)))
    found = decontaminate.report(
        spark.createDataFrame(docs, "doc_id bigint, text string"),
        spark.createDataFrame(items, "item_id bigint, text string"),
        decontaminate.Settings(block=7),
    )
    got = sorted((tuple(r)[:4] for r in found.collect()), key=repr)
    wanted = expected(docs, items)
    assert got == wanted and len(wanted) > 30


def test_defined_cases(spark):
    passage = "one two three four five six seven"
    docs = [(1, None), (2, ""), (3, "Two words"), (4, passage), (4, passage), (None, "so " + passage)]
    items = [(1, passage), (1, passage), (2, "two, words!"), (3, None), (4, "..."), (None, "words two")]
    frame = spark.createDataFrame([(*d, 0, "x") for d in docs], "doc_id bigint, text string, item_id int, n_item string")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    found = decontaminate.report(frame, bench)
    assert sorted((r[:2] for r in map(tuple, found.collect())), key=repr) == [(3, 2), (4, 1), (4, 1), (None, 1)]
    clean = decontaminate.remove_contaminated(frame, bench)
    assert clean.columns == frame.columns and sorted(r.doc_id for r in clean.collect()) == [1, 2]
    assert decontaminate.report(frame.limit(0), bench).count() == 0
    assert decontaminate.report(frame, bench.limit(0)).count() == 0
    assert decontaminate.remove_contaminated(frame, bench.limit(0)).count() == len(docs)
