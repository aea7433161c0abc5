"""Remove every byte of a repeated passage, by a run-length suffix index.

A byte goes when it is covered by a string of ``length`` bytes that also starts somewhere else in the
corpus. The question is decided for every window of that length:

1.  Windows are routed by content. A window's minimiser is its least k-gram (leftmost in a tie),
    so equal windows have equal minimisers. Consecutive windows with one minimiser make a
    segment. A minimiser with a single segment in the corpus proves its windows unique; those
    segments are dropped, which leaves the repetitive part of the corpus.
2.  Segments that are equal as a whole are counted; all their windows are repeated. Each
    distinct segment goes, once, to the shard of its minimiser.
3.  A shard sorts the suffixes of its segments into a Burrows-Wheeler transform and keeps its
    runs. Matching statistics are streamed from samples at run ends: where a run begins (ends), the
    match with the suffix before (after) is measured; at any other text position it is one
    shorter than at the position before. A window is repeated if a match has its full length.
4.  Runs of repeated windows go back to their documents, which drop the bytes they cover.

Shards take whole minimisers until they hold ``shard_bytes``. A minimiser whose distinct
segments are larger than that is not gathered: its windows are counted by their hashes instead.

Defined cases: a missing text is empty; equal texts (of ``length`` bytes or more) go entirely, also when
a row is repeated with its id; matches never cross texts; a text is taken as UTF-8 bytes; an empty
table gives an empty result. Texts are known by 64-bit hash and size. Only ``doc_id`` and
``text`` are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmetrics.llm.shipping import ship
from shelfmetrics.llm.stages import Stages
from shelfmetrics.llm.words import Slice, slices, span_hashes

PIECE = 1 << 22  # a longer text is searched for minimisers in pieces of this size
POSITION_BITS = 24
RUN_BITS = 16  # a segment's number of windows, beside its start in one long


@dataclass(frozen=True)
class Settings:
    length: int = 200
    gram: int = 40
    shard_bytes: int = 1 << 20
    most_bytes: int = 8 << 20


# --- segments -----------------------------------------------------------------------------------


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Least value of every ``width`` consecutive ones."""
    count = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(values)] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, 1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(behind[:count], ahead[width - 1 : width - 1 + count])


def _piece_segments(data: np.ndarray, bounds: np.ndarray, settings: Settings):
    """Starts, numbers of windows and minimisers of the segments of some texts end to end."""
    length, gram = settings.length, settings.gram
    nothing = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    if len(data) < length:
        return nothing
    at = np.arange(len(data) - gram + 1)
    hashes = span_hashes(data, at, at + gram)
    low = np.uint64(POSITION_BITS)
    keyed = (hashes >> low << low) | at.astype(np.uint64)
    least = (_sliding_least(keyed, length - gram + 1) & np.uint64((1 << POSITION_BITS) - 1)).astype(np.int64)
    change = np.zeros(len(least) + 1, np.int64)
    first, last = bounds[:-1], bounds[1:] - length + 1
    whole = last > first
    np.add.at(change, first[whole], 1)
    np.add.at(change, last[whole], -1)
    inside = np.cumsum(change[:-1]) > 0
    opens = inside.copy()
    opens[1:] &= ~inside[:-1] | (least[1:] != least[:-1])
    opens[first[whole]] = True
    starts = np.flatnonzero(opens)
    if not len(starts):
        return nothing
    closes = np.append(starts[1:], len(least))
    ends_inside = np.minimum(closes, last[np.searchsorted(bounds, starts, "right") - 1])
    return starts, ends_inside - starts, hashes[least[starts]]


def segments(part: Slice, settings: Settings):
    """As above for a slice, however long its one text is, and the text each segment is in."""
    if part.size > 1 or len(part.data) <= PIECE:
        starts, windows, minimisers = _piece_segments(part.data, part.bounds, settings)
        owner = np.searchsorted(part.bounds, starts, "right") - 1
        return owner, starts - part.bounds[owner], windows, minimisers
    found = []
    for at in range(0, len(part.data) - settings.length + 1, PIECE):
        piece = part.data[at : at + PIECE + settings.length - 1]
        starts, windows, minimisers = _piece_segments(piece, np.array([0, len(piece)]), settings)
        found.append((starts + at, windows, minimisers))
    starts, windows, minimisers = (np.concatenate(parts) for parts in zip(*found, strict=True))
    return np.zeros(len(starts), np.int64), starts, windows, minimisers


# --- the index of a shard -----------------------------------------------------------------------


class RunLengthIndex:
    """Suffix order, Burrows-Wheeler runs and matching statistics of some strings."""

    WORD = 7  # symbols of nine bits in the first sorting key

    def __init__(self, strings: list[bytes]):
        lengths = np.array([len(s) for s in strings], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(lengths)])
        data = np.frombuffer(b"".join(strings), np.uint8)
        self.size = len(data)
        self.ends = np.repeat(self.starts[1:], lengths)  # where each position's string ends
        self.string = np.repeat(np.arange(len(strings)), lengths)
        self.data = data
        self._sort(int(lengths.max(initial=0)))
        self._runs()

    def _next(self, ranks: np.ndarray, step: int) -> np.ndarray:
        """The rank ``step`` further in the same string, 0 past its end."""
        place = np.arange(self.size) + step
        return np.where(place < self.ends, ranks[np.minimum(place, self.size - 1)], 0)

    def _sort(self, longest: int) -> None:
        symbols = self.data.astype(np.int64) + 1
        key = symbols.copy()
        for k in range(1, self.WORD):
            key = (key << 9) | self._next(symbols, k)
        self.levels: list[tuple[int, np.ndarray]] = []
        step = self.WORD
        while True:
            order = np.argsort(key)
            ordered = key[order]
            fresh = np.ones(self.size, np.int64)
            fresh[1:] = ordered[1:] != ordered[:-1]
            ranks = np.empty(self.size, np.int64)
            ranks[order] = np.cumsum(fresh)
            self.levels.append((step, ranks.astype(np.int32)))
            if step >= longest or fresh.all():
                break
            key = ranks * (self.size + 1) + self._next(ranks, step)
            step *= 2
        # what is equal to the end of both strings is ordered by the strings' numbers
        self.order = np.lexsort((self.string, ranks)) if not fresh.all() else order

    def _runs(self) -> None:
        """The transform's symbols in suffix order and where its runs begin."""
        before = np.where(np.isin(self.order, self.starts), -1 - self.string[self.order], 0)
        inner = before == 0
        before[inner] = self.data[self.order[inner] - 1]
        self.run_start = np.ones(self.size, bool)
        self.run_start[1:] = before[1:] != before[:-1]

    def _match(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Length of the common prefix of the suffixes at x and y."""
        room = np.minimum(self.ends[x] - x, self.ends[y] - y)
        total = np.zeros(len(x), np.int64)
        for step, ranks in reversed(self.levels):
            a, b = x + total, y + total
            open_ = total < room
            a, b = np.where(open_, a, x), np.where(open_, b, y)
            total += np.where(open_ & (ranks[a] == ranks[b]), step, 0)
        total = np.minimum(total, room)
        # at most WORD - 1 symbols are left to compare
        for _ in range(self.WORD - 1):
            open_ = total < room
            a, b = np.where(open_, x + total, x), np.where(open_, y + total, y)
            total += open_ & (self.data[a] == self.data[b])
        return total

    def _stream(self, sampled: np.ndarray, other: np.ndarray) -> np.ndarray:
        """Matches of all text positions from those at sampled places of the suffix order."""
        known = np.zeros(self.size, bool)
        value = np.zeros(self.size, np.int64)
        here = self.order[sampled]
        there = other >= 0
        known[here] = True
        value[here[there]] = self._match(here[there], self.order[other[there]])
        # the first position of a string never continues a match
        known[self.starts[:-1][self.starts[:-1] < self.size]] = True
        last = np.maximum.accumulate(np.where(known, np.arange(self.size), 0))
        return np.maximum(value[last] - (np.arange(self.size) - last), 0)

    def matching_statistics(self) -> np.ndarray:
        """For each position, the longest match with a suffix that starts elsewhere."""
        if not self.size:
            return np.zeros(0, np.int64)
        heads = np.flatnonzero(self.run_start)
        tails = np.append(heads[1:] - 1, self.size - 1)
        with_before = self._stream(heads, heads - 1)
        with_after = self._stream(tails, np.where(tails + 1 < self.size, tails + 1, -1))
        return np.maximum(with_before, with_after)


# --- on Spark -----------------------------------------------------------------------------------


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(
        "doc_id",
        text.alias("text"),
        F.xxhash64(text).alias("text_hash"),
        F.octet_length(text).cast("long").alias("n_bytes"),
    )


def _routed(docs: DataFrame, settings: Settings) -> DataFrame:
    """``minimiser, text_hash, n_bytes, place`` for every segment; place: start and windows."""

    def run(batches):
        for batch in batches:
            hashes, sizes = batch.column("text_hash").to_numpy(), batch.column("n_bytes").to_numpy()
            for part in slices(batch.column("text")):
                owner, starts, windows, minimisers = segments(part, settings)
                owner = owner + part.first
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(minimisers.view(np.int64)),
                        pa.array(hashes[owner]),
                        pa.array(sizes[owner]),
                        pa.array((starts << RUN_BITS) | windows),
                    ],
                    ["minimiser", "text_hash", "n_bytes", "place"],
                )

    return (
        docs.where(F.col("n_bytes") >= settings.length)
        .select("text", "text_hash", "n_bytes")
        .mapInArrow(run, "minimiser bigint, text_hash bigint, n_bytes bigint, place bigint")
    )


def _cut(touched: DataFrame, settings: Settings) -> DataFrame:
    """``minimiser, text_hash, n_bytes, place, segment`` of the texts that are left."""
    extra = settings.length - 1

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                text = memoryview(batch.column("text")[row].as_buffer())
                key = batch.column("text_hash")[row].as_py(), batch.column("n_bytes")[row].as_py()
                spots = batch.column("spots")[row].values
                place = spots.field("place").to_numpy()
                minimiser = spots.field("minimiser")
                for at in range(0, len(place), 4096):
                    some = place[at : at + 4096]
                    start = some >> RUN_BITS
                    stop = np.minimum(start + (some & ((1 << RUN_BITS) - 1)) + extra, len(text))
                    cut = [text[a:b].tobytes() for a, b in zip(start, stop, strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [
                            minimiser.slice(at, len(some)),
                            pa.array(np.full(len(some), key[0], np.int64)),
                            pa.array(np.full(len(some), key[1], np.int64)),
                            pa.array(some),
                            pa.array(cut, pa.binary()),
                        ],
                        ["minimiser", "text_hash", "n_bytes", "place", "segment"],
                    )

    return touched.select("text", "text_hash", "n_bytes", "spots").mapInArrow(
        run, "minimiser bigint, text_hash bigint, n_bytes bigint, place bigint, segment binary"
    )


RUNS = "text_hash bigint, n_bytes bigint, start bigint, windows bigint"


def _runs_of(marked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate([[0], marked.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _indexed(distinct: DataFrame, settings: Settings) -> DataFrame:
    """Runs of repeated windows in the segments that occur once; rows come sorted by minimiser."""
    length = settings.length

    def judge(rows: list[tuple]) -> pa.RecordBatch:
        index = RunLengthIndex([row[1] for row in rows])
        repeated = index.matching_statistics() >= length
        keys, starts, windows = [], [], []
        for k, (_, _, copies, text_hash, n_bytes, place) in enumerate(rows):
            if copies == 1:
                own = repeated[index.starts[k] : index.starts[k + 1] - length + 1]
                for a, b in zip(*_runs_of(own), strict=True):
                    keys.append((text_hash, n_bytes))
                    starts.append((place >> RUN_BITS) + int(a))
                    windows.append(int(b - a))
        return pa.RecordBatch.from_arrays(
            [
                pa.array([k[0] for k in keys], pa.int64()),
                pa.array([k[1] for k in keys], pa.int64()),
                pa.array(starts, pa.int64()),
                pa.array(windows, pa.int64()),
            ],
            ["text_hash", "n_bytes", "start", "windows"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard: list[tuple] = []
        group: list[tuple] = []
        size = 0

        def close_group() -> None:
            nonlocal size
            if len(group) > 1:
                shard.extend(group)
                size += sum(len(row[1]) for row in group)
            group.clear()

        names = ("minimiser", "segment", "copies", "text_hash", "n_bytes", "place")
        for batch in batches:
            for row in zip(*(batch.column(name).to_pylist() for name in names), strict=True):
                if group and group[0][0] != row[0]:
                    close_group()
                    if size >= settings.shard_bytes:
                        yield judge(shard)
                        shard, size = [], 0
                group.append(row)
        close_group()
        if shard:
            yield judge(shard)

    wanted = ["minimiser", "segment", "copies", "text_hash", "n_bytes", "place"]
    spread = distinct.select(*wanted).repartition("minimiser").sortWithinPartitions("minimiser")
    return spread.mapInArrow(run, RUNS)


def _counted(distinct: DataFrame, settings: Settings) -> DataFrame:
    """The same for minimisers too large to gather: windows are counted by 128-bit hash."""
    length = settings.length

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                data = np.frombuffer(batch.column("segment")[row].as_buffer(), np.uint8)
                at = np.arange(len(data) - length + 1)
                start = (batch.column("place")[row].as_py() >> RUN_BITS) + at
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(span_hashes(data, at, at + length).view(np.int64)),
                        pa.array(span_hashes(data, at + length // 3, at + length).view(np.int64)),
                        pa.array(np.full(len(at), batch.column("copies")[row].as_py(), np.int64)),
                        pa.array(np.full(len(at), batch.column("text_hash")[row].as_py(), np.int64)),
                        pa.array(np.full(len(at), batch.column("n_bytes")[row].as_py(), np.int64)),
                        pa.array(start),
                    ],
                    ["high", "low", "copies", "text_hash", "n_bytes", "start"],
                )

    kinds = "high bigint, low bigint, copies bigint, text_hash bigint, n_bytes bigint, start bigint"
    windows = distinct.select("segment", "copies", "text_hash", "n_bytes", "place").mapInArrow(run, kinds)
    repeated = (
        windows.groupBy(F.col("high").alias("r_high"), F.col("low").alias("r_low"))
        .agg(F.sum("copies").alias("times"))
        .where(F.col("times") > 1)
    )
    single = windows.where(F.col("copies") == 1)
    return single.join(
        repeated, (F.col("high") == F.col("r_high")) & (F.col("low") == F.col("r_low")), "left_semi"
    ).select("text_hash", "n_bytes", "start", F.lit(1).cast("long").alias("windows"))


def repeated_runs(stages: Stages, touched: DataFrame, settings: Settings) -> DataFrame:
    """``text_hash, n_bytes, start, windows``: runs of repeated windows."""
    cut = _cut(touched, settings)
    distinct = stages.write(
        cut.groupBy("minimiser", "segment").agg(
            F.count(F.lit(1)).alias("copies"),
            F.min("text_hash").alias("text_hash"),
            F.min("n_bytes").alias("n_bytes"),
            F.min("place").alias("place"),
        ),
        "segments",
    )
    weights = distinct.groupBy(F.col("minimiser").alias("w_minimiser")).agg(
        F.sum(F.octet_length("segment")).alias("bytes")
    )
    large = stages.write(weights.where(F.col("bytes") > settings.most_bytes), "large")
    on_large = F.col("minimiser") == F.col("w_minimiser")
    runs = _indexed(distinct.join(large, on_large, "left_anti"), settings).unionByName(
        _counted(distinct.join(large, on_large, "left_semi"), settings)
    )
    # segments that occur several times: all their windows, wherever they are
    several = distinct.where(F.col("copies") > 1).select(*_segment_hash("s_"))
    places = cut.select("text_hash", "n_bytes", "place", *_segment_hash(""))
    whole = places.join(
        several, (F.col("high") == F.col("s_high")) & (F.col("low") == F.col("s_low")), "left_semi"
    ).select(
        "text_hash",
        "n_bytes",
        F.shiftright("place", RUN_BITS).alias("start"),
        F.col("place").bitwiseAND(F.lit((1 << RUN_BITS) - 1)).alias("windows"),
    )
    return runs.unionByName(whole)


def _segment_hash(prefix: str) -> list[Column]:
    return [
        F.xxhash64("segment").alias(f"{prefix}high"),
        F.xxhash64(F.lit("low"), F.col("segment")).alias(f"{prefix}low"),
    ]


def covered(starts: np.ndarray, windows: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal byte runs covered by windows; neighbours that touch are one run."""
    order = np.argsort(starts, kind="stable")
    begin, end = starts[order], starts[order] + windows[order] + length - 1
    reach = np.maximum.accumulate(end)
    fresh = np.ones(len(begin), bool)
    fresh[1:] = begin[1:] > reach[:-1]
    first = np.flatnonzero(fresh)
    return begin[first], np.maximum.reduceat(end, first) if len(first) else end


def _removed(marked: DataFrame, settings: Settings) -> DataFrame:
    """Per text: bytes and spans removed, hash of what is kept, and what is kept."""
    length = settings.length

    def run(batches):
        for batch in batches:
            removed, spans, digests, kept = [], [], [], []
            for row in range(batch.num_rows):
                text = batch.column("text")[row].as_buffer().to_pybytes()
                runs = batch.column("runs")[row].values
                begin, end = covered(runs.field("start").to_numpy(), runs.field("windows").to_numpy(), length)
                edges = np.concatenate([[0], np.stack([begin, end], 1).ravel(), [len(text)]])
                rest = b"".join(text[a:b] for a, b in edges.reshape(-1, 2))
                removed.append(len(text) - len(rest))
                spans.append(len(begin))
                digests.append(hashlib.sha256(rest).hexdigest())
                kept.append(rest)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("text_hash"),
                    batch.column("n_bytes"),
                    pa.array(removed, pa.int64()),
                    pa.array(spans, pa.int64()),
                    pa.array(digests, pa.string()),
                    pa.array(kept, pa.binary()),
                ],
                ["c_hash", "c_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
            )

    kinds = "c_hash bigint, c_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary"
    return marked.select("text_hash", "n_bytes", "text", "runs").mapInArrow(run, kinds)


def remove_repeats(docs: DataFrame, settings: Settings | None = None) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept`` for every row; kept: null if unchanged."""
    settings = settings or Settings()
    ship(docs.sparkSession)
    stages = Stages(docs.sparkSession)
    keyed = _keyed(docs)

    routed = stages.write(_routed(keyed, settings), "routed")
    occurrence = F.xxhash64("text_hash", "n_bytes", "place")
    shared = stages.write(
        routed.groupBy(F.col("minimiser").alias("s_minimiser"))
        .agg(F.min(occurrence).alias("one"), F.max(occurrence).alias("other"))
        .where(F.col("one") != F.col("other"))
        .select("s_minimiser"),
        "shared",
    )
    spots = (
        routed.join(shared, F.col("minimiser") == F.col("s_minimiser"))
        .groupBy(F.col("text_hash").alias("p_hash"), F.col("n_bytes").alias("p_bytes"))
        .agg(F.collect_set(F.struct("place", "minimiser")).alias("spots"))
    )
    texts = keyed.groupBy("text_hash", "n_bytes").agg(
        F.first("text").alias("text"), F.count(F.lit(1)).alias("copies")
    )
    same = (F.col("text_hash") == F.col("p_hash")) & (F.col("n_bytes") == F.col("p_bytes"))
    touched = stages.write(
        texts.join(spots, same).select("text_hash", "n_bytes", "text", "spots", "copies"), "touched"
    )
    stages.drop(routed)
    runs = repeated_runs(stages, touched.where(F.col("spots").isNotNull()), settings)
    listed = runs.groupBy(F.col("text_hash").alias("l_hash"), F.col("n_bytes").alias("l_bytes")).agg(
        F.collect_set(F.struct("start", "windows")).alias("runs")
    )
    marked = touched.join(
        listed, (F.col("text_hash") == F.col("l_hash")) & (F.col("n_bytes") == F.col("l_bytes"))
    )
    changed = _removed(marked, settings)

    copies = (
        keyed.where(F.col("n_bytes") >= settings.length)
        .groupBy(F.col("text_hash").alias("k_hash"), F.col("n_bytes").alias("k_bytes"))
        .agg(F.count(F.lit(1)).alias("copies"))
        .where(F.col("copies") > 1)
    )
    rows = keyed.select("doc_id", "text_hash", "n_bytes", F.sha2("text", 256).alias("own_sha256"))
    joined = rows.join(
        copies, (F.col("text_hash") == F.col("k_hash")) & (F.col("n_bytes") == F.col("k_bytes")), "left"
    ).join(changed, (F.col("text_hash") == F.col("c_hash")) & (F.col("n_bytes") == F.col("c_bytes")), "left")
    copied = F.col("copies").isNotNull()
    empty = hashlib.sha256(b"").hexdigest()
    return joined.select(
        "doc_id",
        "n_bytes",
        F.when(copied, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(copied, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copied, F.lit(empty)).otherwise(F.coalesce("kept_sha256", "own_sha256")).alias("kept_sha256"),
        F.when(copied, F.lit(b"")).otherwise(F.col("kept")).alias("kept"),
    )
