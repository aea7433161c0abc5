"""Min-max hashing against all pairs."""

from __future__ import annotations

import random
import re

import numpy as np

from shelfmetrics.llm import minhash

WIDE = minhash.Settings(width=2)


def shingles(text: str | None, width: int) -> set:
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    if 0 < len(words) < width:
        return {tuple(words)}
    return {tuple(words[k : k + width]) for k in range(len(words) - width + 1)}


def expected(rows, width):
    sets = [shingles(text, width) for _, text in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x in range(len(rows)):
        for y in range(x):
            common = len(sets[x] & sets[y])
            if sets[x] and sets[y] and 100 * common >= 80 * len(sets[x] | sets[y]):
                root[find(x)] = find(y)
    least = {}
    for x, (doc, _) in enumerate(rows):
        least[find(x)] = min(least.get(find(x), doc), doc)
    return sorted((doc, len(sets[x]), least[find(x)], doc == least[find(x)]) for x, (doc, _) in enumerate(rows))


def families(rng, count):
    """Texts, copies with a few words changed, and copies of those."""
    rows = []
    for family in range(count):
        base = [rng.choice("abcdefghijklmnop") + rng.choice("aeiou") + str(family) for _ in range(rng.randint(6, 50))]
        for _ in range(rng.randint(1, 7)):
            copy = [w if rng.random() > 0.03 else f"x{rng.randint(0, 99)}" for w in base]
            rows.append((len(rows) * 3 % 1009, " ".join(copy)))
            if rng.random() < 0.3:
                base = copy
    return rows


def test_components_match_all_pairs(spark):
    rows = families(random.Random(5), 40)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = sorted(map(tuple, minhash.near_duplicates(docs, WIDE).collect()))
    assert found == expected(rows, 2)


def test_defined_cases(spark):
    long = " ".join(f"w{k}" for k in range(30_000))
    rows = [(1, None), (2, ""), (3, " \n"), (4, "One"), (5, "one"), (6, "a b"), (6, "a b"), (7, long), (8, long + " z")]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id bigint, text string, n_shingles int, kept string")
    found = sorted(map(tuple, minhash.near_duplicates(docs, WIDE).collect()))
    assert found == expected(rows, 2)
    missing = spark.createDataFrame([(None, "p q r"), (9, "P q r")], "doc_id bigint, text string")
    assert sorted(map(tuple, minhash.near_duplicates(missing, WIDE).collect()), key=repr) == [
        (9, 2, 9, True),
        (None, 2, 9, False),
    ]
    assert minhash.near_duplicates(docs.limit(0), WIDE).count() == 0


def test_one_of_each(spark):
    text = " ".join(f"w{k}" for k in range(40))
    rows = [(3, text), (2, text + " more"), (2, text + " more"), (5, "other words here"), (6, ""), (7, None)]
    docs = spark.createDataFrame([(*r, "s") for r in rows], "doc_id bigint, text string, row string")
    kept = minhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [2, 5, 6, 7]


def test_one_of_each_whatever_the_ids_are(spark):
    """Near copies whose ids are all missing or all the same: one stays, the same one in every run."""
    text = " ".join(f"w{k}" for k in range(60))
    group = [text, text + " more", text + " and more", text]
    for ids in ([None] * 4, [4] * 4, [None, 4, 4, None]):
        rows = [*zip(ids, group, strict=True), (4, "other words in a row"), (None, None), (None, "")]
        docs = spark.createDataFrame(rows, "doc_id bigint, text string")
        kept = [tuple(r) for r in minhash.one_of_each(docs).collect()]
        near = [r for r in kept if r[1] and r[1].startswith(text)]
        assert len(near) == 1 and near[0][0] == (4 if 4 in ids else None) and len(kept) == 4
        assert kept and sorted(kept, key=repr) == sorted(map(tuple, minhash.one_of_each(docs.repartition(3)).collect()), key=repr)


def test_sketches_bound_the_difference():
    rng = np.random.default_rng(2)
    x = np.unique(rng.integers(0, 1 << 64, 300, dtype=np.uint64))
    y = np.unique(np.concatenate([x[:200], rng.integers(0, 1 << 64, 80, dtype=np.uint64)]))
    both = np.concatenate([x, y])
    sketch = minhash.parity_sketch(both, np.array([0, len(x)]), 16).view(np.uint64)
    apart = int(np.bitwise_count(sketch[0] ^ sketch[1]).sum())
    assert 0 < apart <= len(np.setxor1d(x, y))


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(4)
    shared = rng.integers(0, 1 << 64, 800, dtype=np.uint64)
    x = np.concatenate([shared, rng.integers(0, 1 << 64, 100, dtype=np.uint64)])
    y = np.concatenate([shared, rng.integers(0, 1 << 64, 100, dtype=np.uint64)])
    found = minhash.signatures(np.concatenate([x, y]), np.array([0, len(x)]), minhash.Settings(permutations=400))
    assert abs((found[0] == found[1]).mean() - 0.8) < 0.05
