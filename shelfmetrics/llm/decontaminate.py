"""Find benchmark items inside documents by size-partitioned MinHash containment search.

Words are runs of letters and digits (A-Z read as a-z, other ASCII characters part words), a text
is its five-word shingles, and a document is contaminated by an item when it holds at least 80 %
of the item's distinct shingles.

Jaccard similarity says little about a short item in a long document, so sizes are made alike:
items are partitioned by length into classes of (B/2, B] shingles, and for each class a
document is cut into windows of 2B shingles, one every B. A passage of the item's length lies
wholly in one window, at a Jaccard similarity of 0.19 or more. Item and window are
candidates if they agree in any of 64 minima (a band of one row), so a whole passage is missed about
once in a million. Candidates are verified on the full shingle sets of item and document.

Items go through in blocks of at most ``block`` items. A block's minima, a fixed number of bytes
per item whatever its length, are the only thing broadcast; shingle sets meet in a join.

Defined cases: a text of fewer than five words is one shingle, so such an item is found only
in a document that is just those words; items and documents without words match nothing; equal
items with one id are one item; rows of ``docs`` that repeat each give their own pairs; an
empty table gives an empty result. Only ``doc_id``, ``item_id`` and ``text`` are read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmetrics.llm.shipping import ship
from shelfmetrics.llm.stages import Stages, numbered
from shelfmetrics.llm.words import NO_WORD, distinct_sorted, mix64, shingle_hashes, slices, word_hashes


@dataclass(frozen=True)
class Settings:
    width: int = 5
    percent: int = 80
    hashes: int = 64
    block: int = 4096
    seed: int = 11


FILTER_BITS = 20


def _codes(settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(settings.seed)
    flips = rng.integers(0, 1 << 32, settings.hashes, dtype=np.uint32)
    factors = rng.integers(0, 1 << 32, settings.hashes, dtype=np.uint32) | np.uint32(1)
    return flips, factors


def _shingles(texts: pa.Array, width: int):
    for part in slices(texts):
        words, firsts = word_hashes(part, NO_WORD)
        yield part.first, *shingle_hashes(words, firsts, width)


def _keys(minima: np.ndarray, which: int) -> np.ndarray:
    """The minimum under hash ``which`` as a 64-bit key."""
    return mix64((minima.astype(np.uint64) << np.uint64(8)) | np.uint64(which))


def size_class(count: np.ndarray) -> np.ndarray:
    """The least c with count <= 2 ** c."""
    return np.ceil(np.log2(np.maximum(count, 1))).astype(np.int64)


def _item_rows(items: DataFrame, settings: Settings) -> DataFrame:
    flips, factors = _codes(settings)

    def run(batches):
        for batch in batches:
            for first, shingles, before in _shingles(batch.column("text"), settings.width):
                count = np.diff(before)
                some = np.flatnonzero(count)
                if not len(some):
                    continue
                short = (shingles >> np.uint64(32)).astype(np.uint32)
                keys = np.stack(
                    [
                        _keys(np.minimum.reduceat((short ^ flips[k]) * factors[k], before[some]), k)
                        for k in range(settings.hashes)
                    ],
                    1,
                )
                sets, begins = distinct_sorted(shingles, before)
                spans = [sets[begins[i] : begins[i + 1]] for i in some]
                rows = pa.RecordBatch.from_arrays(
                    [
                        batch.column("item").take(pa.array(first + some)),
                        pa.array(size_class(count[some])),
                        pa.array([row.tobytes() for row in keys], pa.binary()),
                        pa.array([len(span) for span in spans], pa.int64()),
                        pa.array([span.tobytes() for span in spans], pa.binary()),
                    ],
                    ["item", "size_class", "keys", "n_item", "item_set"],
                )
                yield rows

    schema = "item bigint, size_class bigint, keys binary, n_item bigint, item_set binary"
    return items.select("item", "text").mapInArrow(run, schema)


class Lookup:
    """A block's minima: per size class the sorted keys, their items, and a bit filter before them."""

    def __init__(self, rows: list[tuple[int, int, bytes]]):
        self.classes: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for c in sorted({size for _, size, _ in rows}):
            members = [(item, np.frombuffer(keys, np.uint64)) for item, size, keys in rows if size == c]
            keys = np.concatenate([k for _, k in members])
            items = np.repeat([item for item, _ in members], [len(k) for _, k in members])
            order = np.argsort(keys, kind="stable")
            seen = np.zeros(1 << FILTER_BITS, bool)
            seen[keys >> np.uint64(64 - FILTER_BITS)] = True
            self.classes[c] = keys[order], items[order], seen

    def search(self, c: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``keys`` with a match, and the item of each match."""
        held, items, seen = self.classes[c]
        likely = np.flatnonzero(seen[keys >> np.uint64(64 - FILTER_BITS)])
        left = np.searchsorted(held, keys[likely], "left")
        runs = np.searchsorted(held, keys[likely], "right") - left
        at = np.repeat(left, runs) + np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs)
        return np.repeat(likely, runs), items[at]


def candidates(
    shingles: np.ndarray, before: np.ndarray, lookup: Lookup, settings: Settings
) -> tuple[np.ndarray, np.ndarray]:
    """Documents and items that share a minimum in some window; each pair once."""
    flips, factors = _codes(settings)
    short = (shingles >> np.uint64(32)).astype(np.uint32)
    count = np.diff(before)
    owners, found = [], []
    levels = []  # per size class: starts of its blocks in the finer level, first block of each document
    fine_before, fine_count = before, count
    step = 0
    for c in sorted(lookup.classes):
        size = 1 << (c - step)
        blocks = -(-fine_count // size)
        block_before = np.concatenate([[0], np.cumsum(blocks)])
        place = np.arange(block_before[-1]) - np.repeat(block_before[:-1], blocks)
        starts = np.repeat(fine_before[:-1], blocks) + place * size
        owner = np.repeat(np.arange(len(count)), blocks)
        has_next = np.zeros(len(owner), bool)
        has_next[:-1] = owner[1:] == owner[:-1]
        levels.append((c, starts, owner, has_next))
        fine_before, fine_count, step = block_before, blocks, c
    if not len(short):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    for k in range(settings.hashes):
        minima = (short ^ flips[k]) * factors[k]
        for c, starts, owner, has_next in levels:
            minima = np.minimum.reduceat(minima, starts)
            window = minima.copy()
            following = np.flatnonzero(has_next)
            window[following] = np.minimum(minima[following], minima[following + 1])
            place, item = lookup.search(c, _keys(window, k))
            owners.append(owner[place])
            found.append(item)
    pairs = np.unique(np.stack([np.concatenate(owners), np.concatenate(found)]), axis=1)
    return pairs[0], pairs[1]


def _search_block(docs: DataFrame, rows: list[tuple[int, int, bytes]], settings: Settings) -> DataFrame:
    """Candidate pairs of all documents with one block of items, with the documents' full sets."""
    context = docs.sparkSession.sparkContext
    shared = context.broadcast(Lookup(rows))
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        lookup = shared.value
        for batch in batches:
            ids, hashes = batch.column("doc_id"), batch.column("text_hash")
            for first, shingles, before in _shingles(batch.column("text"), settings.width):
                owner, item = candidates(shingles, before, lookup, settings)
                sets = {}
                for i in np.unique(owner):
                    sets[i] = np.unique(shingles[before[i] : before[i + 1]]).tobytes()
                at = pa.array(first + owner)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(at),
                        hashes.take(at),
                        pa.array(item.astype(np.int64)),
                        pa.array([sets[i] for i in owner], pa.binary()),
                    ],
                    ["doc_id", "text_hash", "c_item", "doc_set"],
                )

    text = F.col("text").cast("string")
    given = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("text_hash"))
    return given.mapInArrow(
        run, f"doc_id {id_type}, text_hash bigint, c_item bigint, doc_set binary"
    )


def _contained(pairs: DataFrame, id_type: str, item_type: str, percent: int) -> DataFrame:
    """Exact shingle containment of each candidate pair."""

    def run(batches):
        for batch in batches:
            shared = np.zeros(batch.num_rows, np.int64)
            total = batch.column("n_item").to_numpy()
            docs, items = batch.column("doc_set"), batch.column("item_set")
            for k in range(batch.num_rows):
                x = np.frombuffer(items[k].as_buffer(), np.uint64)
                y = np.frombuffer(docs[k].as_buffer(), np.uint64)
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                shared[k] = int((y[at] == x).sum())
            names = ["doc_id", "text_hash", "item_id", "n_shared", "n_item"]
            out = pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("text_hash"),
                    batch.column("item_id"),
                    pa.array(shared),
                    batch.column("n_item"),
                ],
                names,
            )
            yield out.filter(pa.array(100 * shared >= percent * total))

    return pairs.select("doc_id", "text_hash", "item_id", "n_item", "doc_set", "item_set").mapInArrow(
        run, f"doc_id {id_type}, text_hash bigint, item_id {item_type}, n_shared bigint, n_item bigint"
    )


def contaminated(docs: DataFrame, benchmark: DataFrame, settings: Settings | None = None) -> DataFrame:
    """``doc_id, text_hash, item_id, n_shared, n_item`` for every document and item it contains."""
    settings = settings or Settings()
    ship(docs.sparkSession)
    stages = Stages(docs.sparkSession)
    distinct = benchmark.select("item_id", F.col("text").cast("string").alias("text")).distinct()
    order = [F.col("item_id").asc_nulls_last(), F.xxhash64("text")]
    items = stages.write(numbered(stages, distinct, order, "item"), "items")
    sets = stages.write(_item_rows(items, settings), "item-sets")
    named = sets.join(items.select(F.col("item").alias("i_item"), "item_id"), F.col("item") == F.col("i_item"))

    id_type = docs.schema["doc_id"].dataType.simpleString()
    item_type = items.schema["item_id"].dataType.simpleString()
    found = None
    for block in range(-(-items.count() // settings.block)):
        low, high = block * settings.block, (block + 1) * settings.block
        # at most ``block`` rows of fixed size
        rows = [
            (row.item, row.size_class, bytes(row["keys"]))
            for row in sets.where(F.col("item").between(low, high - 1))
            .select("item", "size_class", "keys")
            .collect()
        ]
        if rows:
            pairs = _search_block(docs, rows, settings)
            found = pairs if found is None else found.unionByName(pairs)
    if found is None:
        nothing = f"doc_id {id_type}, text_hash bigint, item_id {item_type}, n_shared bigint, n_item bigint"
        return docs.sparkSession.createDataFrame([], nothing)
    joined = found.join(
        named.select("item", "item_id", "n_item", "item_set"), F.col("c_item") == F.col("item")
    )
    return _contained(joined, id_type, item_type, settings.percent)


def report(docs: DataFrame, benchmark: DataFrame, settings: Settings | None = None) -> DataFrame:
    """``doc_id, item_id, n_shared, n_item, containment`` for every contamination."""
    found = contaminated(docs, benchmark, settings)
    share = F.col("n_shared") / F.col("n_item")
    return found.select("doc_id", "item_id", "n_shared", "n_item", share.alias("containment"))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, settings: Settings | None = None) -> DataFrame:
    """The documents that hold no item, with their columns."""
    found = contaminated(docs, benchmark, settings)
    marked = found.select(F.col("doc_id").alias("m_id"), F.col("text_hash").alias("m_hash")).distinct()
    packed = docs.select(
        F.struct("*").alias("row"),
        F.col("doc_id").alias("r_id"),
        F.xxhash64(F.col("text").cast("string")).alias("r_hash"),
    )
    clean = packed.join(
        marked,
        F.col("r_id").eqNullSafe(F.col("m_id")) & (F.col("r_hash") == F.col("m_hash")),
        "left_anti",
    )
    return clean.select(*(F.col("row")[name].alias(name) for name in docs.columns))
