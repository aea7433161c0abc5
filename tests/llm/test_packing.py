"""Packing: exact token round trip, gapless sequences, and few of them."""

from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from shelfmetrics.llm import packing
from shelfmetrics.llm.packing import Settings, WordIds, pack_report, sequences, sum_of_squares

TOKENIZER = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def ids_of(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids + [1]


def check(rows, found, capacity):
    """Every document's pieces in order, every sequence gapless; returns the number of sequences."""
    expected = []
    for doc, text in rows:
        ids = ids_of(text)
        for number, at in enumerate(range(0, len(ids), capacity)):
            held = ids[at : at + capacity]
            expected.append((doc, number, at, len(held), zlib.crc32(np.array(held, "<u4").tobytes())))
    got = [(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found]
    assert sorted(got, key=repr) == sorted(expected, key=repr)
    by_sequence = {}
    for r in found:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in by_sequence.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_sequence)


def words(rng, n):
    return " ".join(rng.choice(["pear", "Apple", "fig", "übung", "naïve", "it's", "42", "one\ntwo"]) for _ in range(n))


def test_round_trip_and_count(spark):
    rng = random.Random(4)
    rows = [(k, words(rng, int(rng.paretovariate(0.8) * 4) % 900)) for k in range(600)]
    rows += [(None, "none"), (7, None), (7, ""), (8, "same"), (8, "same"), (9, words(rng, 2_000))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    settings = Settings(capacity=256, shard_rows=150)
    found = pack_report(docs, settings).collect()
    n = check(rows, found, 256)
    total = sum(len(ids_of(text)) for _, text in rows)
    assert n <= 1.02 * -(-total // 256)


def test_several_rounds_of_merging(spark):
    """Shards so small that most sequences are open at first; two rounds and more join them."""
    rng = random.Random(8)
    rows = [(k, words(rng, rng.choice([3, 5, 11]))) for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = pack_report(docs, Settings(capacity=512, shard_rows=8)).collect()
    total = sum(len(ids_of(text)) for _, text in rows)
    assert check(rows, found, 512) <= 1.1 * -(-total // 512) + 1


def test_sequences_hold_the_ids(spark):
    rng = random.Random(5)
    rows = [(k, words(rng, rng.randrange(0, 90))) for k in range(120)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    settings = Settings(capacity=128, shard_rows=40)
    held = sorted(sum((r.ids for r in sequences(docs, settings).collect()), []))
    assert held == sorted(sum((ids_of(text) for _, text in rows), []))
    assert max(len(r.ids) for r in sequences(docs, settings).collect()) <= 128


def plain_sum_of_squares(lengths, capacity):
    """The rule read literally: try every open bin, square every count."""
    bins = []

    def squares(levels):
        gaps = [capacity - level for level in levels if level < capacity]
        return sum(gaps.count(g) ** 2 for g in set(gaps))

    for item in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        options = []
        for at, level in enumerate(bins):
            if level + lengths[item] <= capacity:
                after = bins[:at] + [level + lengths[item]] + bins[at + 1 :]
                options.append((squares(after), capacity - level - lengths[item], at))
        if not options:
            bins.append(0)
            options = [(0, 0, len(bins) - 1)]
        bins[min(options)[2]] += lengths[item]
    return sorted(bins)


def test_rule_by_brute_force():
    rng = random.Random(6)
    for _ in range(40):
        lengths = np.array([rng.randrange(1, 20) for _ in range(rng.randrange(1, 60))])
        opener, offset = sum_of_squares(lengths, 20)
        levels = np.bincount(opener, lengths)
        assert sorted(levels[levels > 0].astype(int)) == plain_sum_of_squares(list(lengths), 20)
        assert all(offset[k] == 0 for k in set(opener))


def test_words_give_the_ids_of_whole_texts():
    """Any characters, combining marks and odd spaces included, and a small memory of words."""
    rng = random.Random(7)
    odd = "aB é\u0301\u00a0\u2028 \t\v\f\x1c'sİΣς한中١½<|endoftext|>-_.  \n\ré\u0300"
    texts = ["".join(rng.choice(odd) for _ in range(rng.randrange(120))) for _ in range(200)]
    texts += [words(rng, 5_000) + "x" * 3_000, "", "<|endoftext|> a<|startoftext|>"]
    word_ids = WordIds(TOKENIZER, Settings(known_words=50))
    for some in (texts[:90], texts[90:], texts[:5], []):
        ids, bounds = word_ids.of_texts([text.encode() for text in some])
        assert [list(ids[a:b]) for a, b in zip(bounds[:-1], bounds[1:])] == [ids_of(text) for text in some]


def test_defined_cases(spark):
    schema = "doc_id string, text string, uid string, shard int, bin string, length int, offset int"
    docs = spark.createDataFrame([("a", "one two", "u", 1, "b", 2, 3), (None, None, None, None, None, None, None)], schema)
    found = pack_report(docs).collect()
    assert {r.doc_id: r.length for r in found} == {"a": len(ids_of("one two")), None: 1}
    assert len({r.sequence_id for r in found}) == 1
    assert pack_report(docs.limit(0)).count() == 0 and sequences(docs.limit(0)).count() == 0
    exact = spark.range(3).select(F.col("id").alias("doc_id"), F.lit("pear " * 7).alias("text"))
    full = pack_report(exact, Settings(capacity=8)).collect()
    assert len({r.sequence_id for r in full}) == 3 and {r.offset for r in full} == {0}
    assert packing.Settings().capacity == 4096
