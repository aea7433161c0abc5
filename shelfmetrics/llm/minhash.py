"""Near-duplicate documents by min-max hashing.

A document is the set of its distinct word shingles. Under each of ``permutations`` random
permutations both the least and the greatest element are kept, so 100 permutations give a signature
of 200 values; ``rows`` of them make a band. Documents that agree in a band are candidates, and a
candidate pair is a link when ``100 * |A and B| >= 80 * |A or B|`` on the full sets. With 40
bands of 5 values a pair at similarity 0.8 escapes all bands about once in ten million.

Documents with equal sets form a class, and only classes are compared. In a bucket classes are not
paired with each other but with the bucket's hub, the class that meets most others in all
its buckets; what that links is contracted, and only classes of a bucket that are still apart meet
pair by pair. So a group of copies costs about its size, and no link that joins two
components is lost.

Before any pair is made, a sketch of 1024 parity bits rules out what cannot be a link: two sets
differ in at least as many shingles as their sketches differ in bits, and a link may differ
in no more than (100 - 80) / (100 + 80) of the two sizes together. That is exact, not an estimate.

Defined cases: a missing text or one without words has no shingles and is linked with nothing; a
text shorter than a shingle is one shingle; rows that repeat an id share its result; a
missing id is never the least one; an empty table gives an empty result. Only ``doc_id`` and
``text`` are read.
"""

from __future__ import annotations

import operator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmetrics.llm.graph import components, joined
from shelfmetrics.llm.shipping import ship
from shelfmetrics.llm.stages import Stages
from shelfmetrics.llm.words import distinct_sorted, mix64, shingle_hashes, slices, word_hashes


@dataclass(frozen=True)
class Settings:
    width: int = 5
    percent: int = 80
    permutations: int = 100
    rows: int = 5
    seed: int = 99
    sketch_words: int = 16

    @property
    def bands(self) -> int:
        return 2 * self.permutations // self.rows


def shingle_sets(texts: pa.Array, width: int):
    """Per slice: its first document, the sorted distinct shingles, where each document begins."""
    for part in slices(texts):
        words, firsts = word_hashes(part)
        yield part.first, *distinct_sorted(*shingle_hashes(words, firsts, width))


def _codes(settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(settings.seed)
    flips = rng.integers(0, 1 << 32, settings.permutations, dtype=np.uint32)
    factors = rng.integers(0, 1 << 32, settings.permutations, dtype=np.uint32) | np.uint32(1)
    return flips, factors


def signatures(shingles: np.ndarray, begins: np.ndarray, settings: Settings) -> np.ndarray:
    """Min and max under every permutation, one row per (non-empty) document."""
    flips, factors = _codes(settings)
    short = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.empty((2 * settings.permutations, len(begins)), np.uint32)
    for k in range(settings.permutations):
        placed = (short ^ flips[k]) * factors[k]
        np.minimum.reduceat(placed, begins, out=out[2 * k])
        np.maximum.reduceat(placed, begins, out=out[2 * k + 1])
    return out.T


def band_keys(signature: np.ndarray, settings: Settings) -> np.ndarray:
    grouped = signature[:, : settings.bands * settings.rows].reshape(-1, settings.bands, settings.rows)
    keys = np.broadcast_to(np.arange(settings.bands, dtype=np.uint64), grouped.shape[:2]).copy()
    for k in range(settings.rows):
        keys = mix64((keys << np.uint64(7)) ^ mix64(keys + grouped[:, :, k].astype(np.uint64)))
    return keys.view(np.int64)


def parity_sketch(shingles: np.ndarray, begins: np.ndarray, words: int) -> np.ndarray:
    """Bit b of a set's sketch: whether an odd number of its shingles falls on b."""
    place = (shingles >> np.uint64(7)) % np.uint64(64 * words)
    bit = np.uint64(1) << (place % np.uint64(64))
    word = place // np.uint64(64)
    columns = [np.bitwise_xor.reduceat(np.where(word == k, bit, np.uint64(0)), begins) for k in range(words)]
    return np.stack(columns, 1).view(np.int64)


def _signed(docs: DataFrame, settings: Settings) -> DataFrame:
    """Per row: its id, text hash, and the size, 128-bit digest and band keys of its set."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id")
            for first, shingles, begins in shingle_sets(batch.column("text"), settings.width):
                count = np.diff(begins)
                some = np.flatnonzero(count)
                high, low = np.zeros(len(count), np.uint64), np.zeros(len(count), np.uint64)
                offsets = np.zeros(len(count) + 1, np.int32)
                sketch_offsets = np.zeros(len(count) + 1, np.int32)
                keys = np.zeros((0, settings.bands), np.int64)
                sketch = np.zeros((0, settings.sketch_words), np.int64)
                if len(some):
                    starts = begins[some]
                    high[some] = np.add.reduceat(shingles, starts)
                    low[some] = np.add.reduceat(mix64(shingles ^ np.uint64(0x5DEECE66D)), starts)
                    keys = band_keys(signatures(shingles, starts, settings), settings)
                    sketch = parity_sketch(shingles, starts, settings.sketch_words)
                    offsets[1:] = np.cumsum(np.where(count > 0, settings.bands, 0))
                    sketch_offsets[1:] = np.cumsum(np.where(count > 0, settings.sketch_words, 0))
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(first, len(count)),
                        batch.column("text_hash").slice(first, len(count)),
                        pa.array(count.astype(np.int64)),
                        pa.array(high.view(np.int64)),
                        pa.array(low.view(np.int64)),
                        pa.ListArray.from_arrays(offsets, pa.array(keys.ravel())),
                        pa.ListArray.from_arrays(sketch_offsets, pa.array(sketch.ravel())),
                    ],
                    ["doc_id", "text_hash", "n_shingles", "high", "low", "bands", "sketch"],
                )

    sizes = "n_shingles bigint, high bigint, low bigint, bands array<bigint>, sketch array<bigint>"
    return _hashed(docs).mapInArrow(run, f"doc_id {id_type}, text_hash bigint, {sizes}")


def _hashed(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("text_hash"))


def _sets(docs: DataFrame, wanted: DataFrame, settings: Settings) -> DataFrame:
    """``cid, shingles``: the full sets of the wanted classes, from texts with their hash."""

    def run(batches):
        for batch in batches:
            cid = batch.column("cid")
            for first, shingles, begins in shingle_sets(batch.column("text"), settings.width):
                held = [shingles[a:b].tobytes() for a, b in zip(begins[:-1], begins[1:], strict=True)]
                low = np.zeros(len(held), np.uint64)
                some = np.flatnonzero(np.diff(begins))
                if len(some):
                    low[some] = np.add.reduceat(mix64(shingles ^ np.uint64(0x5DEECE66D)), begins[some])
                asked = batch.column("low").slice(first, len(held)).to_numpy()
                same = low.view(np.int64) == asked  # another text may have the same hash
                part = pa.RecordBatch.from_arrays(
                    [cid.slice(first, len(held)), pa.array(held, pa.binary())], ["cid", "shingles"]
                )
                yield part.filter(pa.array(same))

    texts = _hashed(docs).select("text", F.col("text_hash").alias("t_hash"))
    found = texts.join(wanted, F.col("t_hash") == F.col("text_hash"))
    return (
        found.select("cid", "low", "text")
        .mapInArrow(run, "cid bigint, shingles binary")
        .dropDuplicates(["cid"])
    )


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` whose full sets are similar enough."""

    def run(batches):
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            left, right = batch.column("left"), batch.column("right")
            for k in range(batch.num_rows):
                x = np.frombuffer(left[k].as_buffer(), np.uint64)
                y = np.frombuffer(right[k].as_buffer(), np.uint64)
                at = np.searchsorted(y, x)
                common = int((y[np.minimum(at, len(y) - 1)] == x).sum())
                keep[k] = 100 * common >= percent * (len(x) + len(y) - common)
            yield pa.RecordBatch.from_arrays(
                [batch.column("a"), batch.column("b")], ["a", "b"]
            ).filter(pa.array(keep))

    left = sets.select(F.col("cid").alias("l_cid"), F.col("shingles").alias("left"))
    right = sets.select(F.col("cid").alias("r_cid"), F.col("shingles").alias("right"))
    return (
        pairs.join(left, F.col("a") == F.col("l_cid"))
        .join(right, F.col("b") == F.col("r_cid"))
        .select("a", "b", "left", "right")
        .mapInArrow(run, "a bigint, b bigint")
    )


def _may_link(settings: Settings) -> Column:
    """Whether sizes and sketches of the classes ``x_`` and ``y_`` leave room for a link."""
    both = F.col("x_n_shingles") + F.col("y_n_shingles")
    bits = [
        F.bit_count(F.col("x_sketch")[k].bitwiseXOR(F.col("y_sketch")[k]))
        for k in range(settings.sketch_words)
    ]
    least = F.greatest(F.abs(F.col("x_n_shingles") - F.col("y_n_shingles")), reduce(operator.add, bits))
    return least * (100 + settings.percent) <= both * (100 - settings.percent)


def _side(rows: DataFrame, name: str) -> DataFrame:
    return rows.select(*(F.col(c).alias(f"{name}_{c}") for c in rows.columns))


def link_classes(stages: Stages, classes: DataFrame, docs: DataFrame, settings: Settings) -> DataFrame:
    """``(node, component)`` for every class that is linked with another."""
    banded = classes.select("cid", F.explode("bands").alias("band"))
    shared = stages.write(
        banded.groupBy("band")
        .agg(F.min("cid").alias("first"), F.max("cid").alias("last"), F.count(F.lit(1)).alias("size"))
        .where(F.col("first") != F.col("last"))
        .select(F.col("band").alias("s_band"), "size"),
        "shared",
    )
    met = stages.write(
        banded.join(shared, F.col("band") == F.col("s_band")).select("band", "cid", "size"), "met"
    )
    support = met.groupBy(F.col("cid").alias("u_cid")).agg(F.sum("size").alias("support"))
    sketches = classes.select(F.col("cid").alias("k_cid"), "n_shingles", "sketch")
    supported = met.join(support, F.col("cid") == F.col("u_cid")).select("band", "cid", "support")
    hubs = supported.groupBy(F.col("band").alias("h_band")).agg(F.max_by("cid", "support").alias("hub"))
    members = stages.write(supported.join(hubs, F.col("band") == F.col("h_band")).drop("h_band"), "members")

    wanted = members.select(F.col("cid").alias("w_cid")).distinct()
    sources = classes.join(wanted, F.col("cid") == F.col("w_cid")).select("cid", "low", "text_hash")
    sets = stages.write(_sets(docs, sources, settings), "sets")
    # 1. every class with the hubs of its buckets
    spokes = members.where(F.col("cid") != F.col("hub")).select("hub", "cid").distinct()
    x, y = _side(sketches, "x"), _side(sketches, "y")
    possible = spokes.join(x, F.col("hub") == F.col("x_k_cid")).join(
        y, (F.col("cid") == F.col("y_k_cid")) & _may_link(settings)
    )
    first = stages.write(_ordered(possible, "hub", "cid"), "pairs")
    found = stages.write(_verified(first, sets, settings.percent), "found")
    labels = stages.write(components(stages, found), "labels")

    # 2. what is still apart in a bucket, pair by pair
    known = labels.select(F.col("node").alias("n_node"), "component")
    labelled = members.select("band", "cid").join(known, F.col("cid") == F.col("n_node"), "left")
    labelled = labelled.select("band", "cid", F.coalesce("component", "cid").alias("label"))
    mixed = (
        labelled.groupBy("band")
        .agg(F.min("label").alias("first"), F.max("label").alias("last"))
        .where(F.col("first") != F.col("last"))
        .select(F.col("band").alias("m_band"))
    )
    left = labelled.join(mixed, F.col("band") == F.col("m_band")).drop("m_band")
    left = stages.write(left.join(sketches, F.col("cid") == F.col("k_cid")).drop("k_cid"), "apart")
    pairs = _side(left, "x").join(
        _side(left, "y"),
        (F.col("x_band") == F.col("y_band"))
        & (F.col("x_label") != F.col("y_label"))
        & (F.col("x_cid") < F.col("y_cid"))
        & _may_link(settings),
    )
    rest = _ordered(pairs, "x_cid", "y_cid").join(first, ["a", "b"], "left_anti")
    more = stages.write(_verified(stages.write(rest, "pairs"), sets, settings.percent), "found")
    return labels if more.isEmpty() else stages.write(joined(stages, labels, more), "labels")


def _ordered(pairs: DataFrame, one: str, other: str) -> DataFrame:
    """Each pair once, as ``a < b``."""
    return pairs.select(F.least(one, other).alias("a"), F.greatest(one, other).alias("b")).distinct()


def _judged(docs: DataFrame, settings: Settings) -> DataFrame:
    """``doc_id, text_hash, n_shingles, component_id, kept`` for every row of ``docs``."""
    ship(docs.sparkSession)
    stages = Stages(docs.sparkSession)
    signed = stages.write(_signed(docs, settings), "signed")
    grouped = (
        signed.where(F.col("n_shingles") > 0)
        .groupBy("high", "low", "n_shingles")
        .agg(
            F.min("doc_id").alias("doc_id"),
            F.min("text_hash").alias("text_hash"),
            F.first("bands").alias("bands"),
            F.first("sketch").alias("sketch"),
        )
        .withColumn("cid", F.monotonically_increasing_id())
    )
    classes = stages.write(grouped, "classes")
    labels = link_classes(stages, classes, docs, settings)
    rooted = classes.select("high", "low", "cid", F.col("doc_id").alias("c_id")).join(
        labels, F.col("cid") == F.col("node"), "left"
    )
    rooted = rooted.select("high", "low", "c_id", F.coalesce("component", "cid").alias("root"))
    least = rooted.groupBy(F.col("root").alias("l_root")).agg(F.min("c_id").alias("component_id"))
    placed = rooted.join(least, F.col("root") == F.col("l_root")).select(
        F.col("high").alias("p_high"), F.col("low").alias("p_low"), "component_id", "root"
    )
    rows = signed.drop("bands", "sketch").join(
        placed,
        (F.col("n_shingles") > 0) & (F.col("high") == F.col("p_high")) & (F.col("low") == F.col("p_low")),
        "left",
    )
    component = F.coalesce("component_id", "doc_id")
    return rows.select(
        "doc_id",
        "text_hash",
        "n_shingles",
        component.alias("component_id"),
        F.col("doc_id").eqNullSafe(component).alias("kept"),
        "root",
    )


def near_duplicates(docs: DataFrame, settings: Settings | None = None) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs``."""
    return _judged(docs, settings or Settings()).drop("text_hash", "root")


def one_of_each(docs: DataFrame, settings: Settings | None = None) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates: the one with the least id.

    A missing id comes last, and of rows with one id the text decides, so exactly one stays whatever
    the ids are. Rows without shingles all stay; of rows that repeat id and text one stays.
    """
    judged = _judged(docs, settings or Settings())
    rows = judged.groupBy(F.col("doc_id").alias("j_id"), F.col("text_hash").alias("j_hash")).agg(
        F.min("root").alias("root"), F.max("n_shingles").alias("n_shingles"), F.count(F.lit(1)).alias("times")
    )
    place = F.struct(F.col("j_id").isNull().alias("unnamed"), "j_id", "j_hash", "times", "n_shingles")
    chosen = rows.where(F.col("n_shingles") > 0).groupBy("root").agg(F.min(place).alias("least"))
    columns = ["j_id", "j_hash", "times", "n_shingles"]
    stays = chosen.select(*(F.col(f"least.{c}").alias(c) for c in columns)).unionByName(
        rows.where(F.col("n_shingles") == 0).select(*columns)
    )
    packed = docs.select(
        F.struct("*").alias("row"),
        F.col("doc_id").alias("r_id"),
        F.xxhash64(F.col("text").cast("string")).alias("r_hash"),
    )
    held = packed.join(
        stays, F.col("r_id").eqNullSafe(F.col("j_id")) & (F.col("r_hash") == F.col("j_hash"))
    )
    repeated = (F.col("times") > 1) & (F.col("n_shingles") > 0)
    single = held.where(~repeated).select("row")
    first = held.where(repeated).dropDuplicates(["r_id", "r_hash"]).select("row")
    return single.unionByName(first).select("row.*")
