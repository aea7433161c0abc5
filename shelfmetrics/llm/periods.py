"""Periodic runs of words, found in tiles scaled to the period.

A run is a stretch of words with smallest period q, of length at least ``max(6, 4 q)``, that no
neighbouring word extends. With period p in the octave [P, 2 P) its words equal those p places on
over at least 3 P consecutive places, so that stretch of matches holds a multiple c of 3 P.

1. Every document is cut, per octave, into overlapping tiles: one around each such c, from
   3 P words before it to 5 P behind it. A tile can matter only if the block of 1.5 P words that
   begins or ends at c is there again p places on, and not if all of it repeats a period of a
   lower octave. Hashes say so for all tiles at once, and only tiles that pass become rows. These
   are dealt out by document, octave and neighbourhood, so a very long document is worked on by
   many tasks.
2. Each tile is solved on its own: two Z-functions give, for every p, how far the matches reach
   behind and before c, up to 3 P words. Stretches of 3 P and more are fragments, unless the period is
   a multiple of one that holds all over the fragment: then it holds all over the run as well.
   Fragments of neighbouring tiles that touch are joined before the shuffle.
3. Fragments are shuffled by document and period and stitched: those that touch make up the whole
   stretch of matches. Of equal stretches of words the smallest period stays.

Documents without a tile that passed are finished in the first step and never shuffled; the words
of the others are written once and meet their runs in the last step. Words are told apart
exactly: tiles hold numbers given to distinct words of a slice.

Defined cases: a missing text has no words; rows that repeat both id and text share their runs and
are reported one by one; a missing id is kept, and ``rebuilt`` leaves its words as they are;
an empty table gives an empty result. Only ``doc_id`` and ``text`` are read; other columns may have
any name.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfmetrics.llm.shipping import ship
from shelfmetrics.llm.stages import Stages
from shelfmetrics.llm.words import mix64, slices

LEAST_LENGTH, LEAST_PERIODS = 6, 4
TILES_TOGETHER = 64  # neighbouring tiles that go to one task
TILES_AT_ONCE = 1 << 12
COMPARED_AT_ONCE = 1 << 18
_BASE = 0x9E3779B97F4A7C15
_U = np.uint64

#: What becomes of a document's words before the search: (doc_id, words) -> words.
Prepare = Callable[[object, list[bytes]], list[bytes]]


def rebuilt(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The contract's documents: one in ten becomes periodic from some word on."""
    if doc_id is None or not words:
        return words
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + k % p] for k in range(n - a)]


def octaves(most_words: int) -> Iterator[int]:
    """The first period of every octave that can hold a run in so many words."""
    first = 1
    while max(LEAST_LENGTH, LEAST_PERIODS * first) <= most_words:
        yield first
        first *= 2


def prefix_sums(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running polynomial sums over the words' random codes, and the powers of their base."""
    powers = np.full(len(codes) + 1, _BASE, _U)
    powers[0] = 1
    np.cumprod(powers, out=powers, dtype=_U)
    sums = np.zeros(len(codes) + 1, _U)
    np.cumsum(mix64(codes.astype(_U) + _U(1)) * powers[:-1], out=sums[1:])
    return sums, powers


def passing_tiles(
    codes: np.ndarray, sums: np.ndarray, powers: np.ndarray, firsts: np.ndarray, first: int
) -> tuple[np.ndarray, np.ndarray]:
    """Document and centre of all tiles of an octave in which a block at the centre is met again."""
    count = np.diff(firsts)
    block, step = max(2, 3 * first // 2), 3 * first
    tiles = np.where(count >= max(LEAST_LENGTH, LEAST_PERIODS * first), -(-count // step), 0)
    owner = np.repeat(np.arange(len(count)), tiles)
    centre = (np.arange(len(owner)) - np.repeat(np.cumsum(tiles) - tiles, tiles)) * step
    hashes = sums[block:] - sums[:-block]
    periods = np.arange(first, 2 * first)
    passed = np.zeros(len(owner), bool)
    together = max(1, COMPARED_AT_ONCE // first)
    for low in range(0, len(owner), together):
        some = slice(low, low + together)
        at = (firsts[owner[some]] + centre[some])[:, None]
        end = firsts[owner[some] + 1][:, None]
        for back, inside in ((0, at + periods + block <= end), (block, at + periods <= end)):
            if back:
                inside &= centre[some][:, None] >= block
            here = np.minimum(np.maximum(at - back, 0), len(hashes) - 1)
            there = np.minimum(np.maximum(at - back + periods, 0), len(hashes) - 1)
            passed[some] |= (inside & (hashes[here] * powers[periods] == hashes[there])).any(axis=1)
    owner, centre = owner[passed], centre[passed]
    low = firsts[owner] + np.maximum(centre - 3 * first, 0)
    high = np.minimum(firsts[owner] + centre + 5 * first, firsts[owner + 1])
    fresh = np.ones(len(owner), bool)
    for period in range(1, first):  # a tile that repeats a smaller period throughout finds nothing new
        some = np.flatnonzero(fresh & (high - low >= 2 * period))
        here = (sums[high[some] - period] - sums[low[some]]) * powers[period]
        for k in some[here == sums[high[some]] - sums[low[some] + period]]:
            held = codes[low[k] : high[k]]
            fresh[k] = not np.array_equal(held[period:], held[:-period])
    return owner[fresh], centre[fresh]


def z_function(s: list[int]) -> list[int]:
    """For every place, how many values from there on equal those from the beginning."""
    n = len(s)
    z = [0] * n
    z[0] = n
    low = high = 0
    for k in range(1, n):
        reach = min(high - k, z[k - low]) if k < high else 0
        if k + reach >= high:
            while k + reach < n and s[reach] == s[k + reach]:
                reach += 1
            low, high = k, k + reach
        z[k] = reach
    return z


def _prime_factors(n: int) -> list[int]:
    out, k = [], 2
    while k * k <= n:
        if n % k == 0:
            out.append(k)
            while n % k == 0:
                n //= k
        k += 1
    return out + [n] if n > 1 else out


def solve_tile(words: list[int], before: int, first: int) -> list[tuple[int, int, int]]:
    """``(period, behind, ahead)``: matches reach from ``behind`` words before the centre to ``ahead`` after.

    ``words`` are those of the tile, of which ``before`` come before the centre.
    """
    reach = 3 * first
    right = words[before:]
    ahead = z_function(right) if right else []
    most = min(2 * first, len(right)) - 1
    if most < first:
        return []
    mirrored = words[before + most - 1 :: -1] if before + most else []
    back = words[before - 1 :: -1] if before else []
    # behind(p): common suffix of the words before c and of those before c + p
    z = z_function([*back, -1, *mirrored])
    origin = before + 1 + most

    def behind(p: int) -> int:
        return z[origin - p] if before else 0

    out = []
    for p in range(first, most + 1):
        b, a = min(behind(p), reach), min(ahead[p], reach)
        if b + a < reach:
            continue
        smaller = any(behind(q) >= b and ahead[q] >= a + p - q for q in (p // r for r in _prime_factors(p)))
        if not smaller:
            out.append((p, b, a))
    return out


def _digest(parts: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(parts)).hexdigest()


def _cut(docs: DataFrame, prepare: Prepare | None) -> DataFrame:
    """Step 1. Rows with ``first`` missing are documents, the others tiles."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            ids, hashes = batch.column("doc_id"), batch.column("text_hash")
            for part in slices(batch.column("text")):
                data, bounds = part.data.tobytes(), part.bounds
                keys = ids.slice(part.first, part.size).to_pylist()
                words = [data[a:b].split() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                if prepare:
                    words = [prepare(key, some) for key, some in zip(keys, words, strict=True)]
                firsts = np.concatenate([[0], np.cumsum([len(some) for some in words])]).astype(np.int64)
                numbers: dict[bytes, int] = defaultdict(lambda: len(numbers))
                codes = np.fromiter((numbers[w] for some in words for w in some), np.int32, int(firsts[-1]))
                sums, powers = prefix_sums(codes)
                tiles = []
                for first in octaves(int(np.diff(firsts).max(initial=0))):
                    found = passing_tiles(codes, sums, powers, firsts, first)
                    tiles += [(k, first, c) for k, c in zip(*found, strict=True)]
                touched = {int(k) for k, _, _ in tiles}
                yield _document_rows(part, ids, hashes, words, touched)
                for at in range(0, len(tiles), TILES_AT_ONCE):
                    yield _tile_rows(part, ids, hashes, codes, firsts, tiles[at : at + TILES_AT_ONCE])

    schema = (
        f"doc_id {id_type}, text_hash bigint, n_words bigint, collapsed_sha256 string, words string,"
        " first int, centre bigint, before int, tile binary"
    )
    text = F.col("text").cast("string")
    read = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("text_hash"))
    return read.mapInArrow(run, schema)


_NAMES = ["doc_id", "text_hash", "n_words", "collapsed_sha256", "words", "first", "centre", "before", "tile"]


def _document_rows(part, ids, hashes, words, touched) -> pa.RecordBatch:
    n = part.size
    columns = [
        ids.slice(part.first, n),
        hashes.slice(part.first, n),
        pa.array([len(some) for some in words], pa.int64()),
        pa.array([None if k in touched else _digest(some) for k, some in enumerate(words)], pa.string()),
        pa.array([b" ".join(some) if k in touched else None for k, some in enumerate(words)], pa.string()),
        *(pa.nulls(n, kind) for kind in (pa.int32(), pa.int64(), pa.int32(), pa.binary())),
    ]
    return pa.RecordBatch.from_arrays(columns, _NAMES)


def _tile_rows(part, ids, hashes, codes, firsts, tiles) -> pa.RecordBatch:
    n = len(tiles)
    owner = pa.array([part.first + int(k) for k, _, _ in tiles], pa.int64())
    before, held = [], []
    for k, first, centre in tiles:
        at = int(firsts[k]) + int(centre)
        low, high = max(int(firsts[k]), at - 3 * first), min(int(firsts[k + 1]), at + 5 * first)
        before.append(at - low)
        held.append(codes[low:high].tobytes())
    columns = [
        ids.take(owner),
        hashes.take(owner),
        *(pa.nulls(n, kind) for kind in (pa.int64(), pa.string(), pa.string())),
        pa.array([first for _, first, _ in tiles], pa.int32()),
        pa.array([int(centre) for _, _, centre in tiles], pa.int64()),
        pa.array(before, pa.int32()),
        pa.array(held, pa.binary()),
    ]
    return pa.RecordBatch.from_arrays(columns, _NAMES)


def _solved(batches):
    """Step 2, a batch of tiles at a time; fragments that touch are joined here already."""
    for batch in batches:
        found: dict[tuple, list[tuple[int, int, int]]] = {}
        columns = [batch.column(name).to_pylist() for name in ("first", "centre", "before", "tile")]
        keys = zip(batch.column("doc_id").to_pylist(), batch.column("text_hash").to_pylist(), strict=True)
        for row, (key, first, centre, before, tile) in enumerate(zip(keys, *columns, strict=True)):
            words = np.frombuffer(tile, np.int32).tolist()
            for period, behind, ahead in solve_tile(words, before, first):
                found.setdefault((*key, period), []).append((centre - behind, centre + ahead, row))
        rows, periods, lows, highs = [], [], [], []
        for (*_, period), spans in found.items():
            open_low = open_high = open_row = None
            for low, high, row in sorted(spans):
                if open_high is not None and low <= open_high:
                    open_high = max(open_high, high)
                    continue
                if open_high is not None:
                    rows.append(open_row), periods.append(period), lows.append(open_low), highs.append(open_high)
                open_low, open_high, open_row = low, high, row
            rows.append(open_row), periods.append(period), lows.append(open_low), highs.append(open_high)
        owner = pa.array(rows, pa.int64())
        columns = [batch.column("doc_id").take(owner), batch.column("text_hash").take(owner)]
        columns += [pa.array(some, pa.int64()) for some in (periods, lows, highs)]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "period", "low", "high"])


def _stitched(fragments: DataFrame) -> DataFrame:
    """Step 3: ``doc_id, text_hash, start, length, period`` of all runs."""
    document = ["doc_id", "text_hash"]
    order = Window.partitionBy(*document, "period").orderBy("low", "high")
    reached = F.max("high").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(F.col("low") <= reached, 0).otherwise(1)
    number = F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    whole = (
        fragments.withColumn("opens", opens)
        .withColumn("island", number)
        .groupBy(*document, "period", "island")
        .agg(F.min("low").alias("start"), F.max("high").alias("high"))
        .withColumn("length", F.col("high") - F.col("start") + F.col("period"))
        .where(F.col("length") >= F.greatest(F.lit(LEAST_LENGTH), LEAST_PERIODS * F.col("period")))
    )
    return whole.groupBy(*document, "start", "length").agg(F.min("period").alias("period"))


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run ``(start, length, period)`` contains after its first period."""
    if not runs:
        return words
    depth = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        depth[start + period] += 1
        depth[start + length] -= 1
    stays = np.cumsum(depth[:-1]) == 0
    return [word for word, stay in zip(words, stays, strict=True) if stay]


def _greatest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int]:
    """The run of greatest length / period; ties: least start, then least period."""
    best = runs[0]
    for run in runs[1:]:
        more = run[1] * best[2] - best[1] * run[2]
        if more > 0 or (more == 0 and (run[0], run[2]) < (best[0], best[2])):
            best = run
    return best


def find_runs(
    docs: DataFrame, prepare: Prepare | None = None, stages: Stages | None = None
) -> tuple[DataFrame, DataFrame]:
    """All documents with their words (kept as text where runs are possible), and the runs.

    ``(doc_id, text_hash, n_words, collapsed_sha256, words)`` and
    ``(doc_id, text_hash, start, length, period)``.
    """
    stages = stages or Stages(docs.sparkSession)
    ship(docs.sparkSession)
    cut = stages.write(_cut(docs, prepare), "tiles")
    documents = cut.where(F.col("first").isNull()).select(*_NAMES[:5])
    tiles = cut.where(F.col("first").isNotNull()).select("doc_id", "text_hash", "first", "centre", "before", "tile")
    near = F.floor(F.col("centre") / (3 * TILES_TOGETHER * F.col("first")))
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = tiles.repartition(tasks, F.xxhash64("doc_id", "text_hash", "first", near))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    fragments = dealt.mapInArrow(
        _solved, f"doc_id {id_type}, text_hash bigint, period bigint, low bigint, high bigint"
    )
    return documents, stages.write(_stitched(fragments), "runs")


def run_report(docs: DataFrame, prepare: Prepare | None = None) -> DataFrame:
    """Per document its runs' number and digest, its greatest run and the digest of what is left."""
    documents, runs = find_runs(docs, prepare)
    whole = F.struct("start", "length", "period")
    listed = runs.groupBy("doc_id", "text_hash").agg(F.collect_list(whole).alias("runs")).select(
        F.col("doc_id").alias("r_id"), F.col("text_hash").alias("r_hash"), "runs"
    )
    same = F.col("doc_id").eqNullSafe(F.col("r_id")) & (F.col("text_hash") == F.col("r_hash"))
    # the runs grow with the corpus: one plan at every size
    touched = documents.where(F.col("words").isNotNull()).join(listed.hint("merge"), same, "left")
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def report(batches):
        for batch in batches:
            digests, counts, best, left = [], [], [], []
            for text, found in zip(batch.column("words").to_pylist(), batch.column("runs").to_pylist(), strict=True):
                words = text.encode().split()
                some = sorted((r["start"], r["length"], r["period"]) for r in found or [])
                some.sort(key=lambda run: (run[0], run[2]))
                counts.append(len(some))
                digests.append(hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in some).encode()).hexdigest())
                best.append(_greatest(some) if some else (None, None, None))
                left.append(_digest(collapsed(words, some)))
            starts, lengths, periods = zip(*best, strict=True) if best else ((), (), ())
            share = [1000 * n // p if n else None for n, p in zip(lengths, periods, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    *(pa.array(some, pa.int64()) for some in (counts, starts, lengths, periods, share)),
                    pa.array(digests, pa.string()),
                    pa.array(left, pa.string()),
                ],
                ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"],
            )

    schema = (
        f"doc_id {id_type}, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint,"
        " runs_sha256 string, collapsed_sha256 string"
    )
    none = F.lit(None).cast("bigint")
    plain = documents.where(F.col("words").isNull()).select(
        "doc_id",
        F.lit(0).cast("bigint").alias("n_runs"),
        none.alias("start"),
        none.alias("length"),
        none.alias("period"),
        none.alias("exponent_milli"),
        F.sha2(F.lit("").cast("binary"), 256).alias("runs_sha256"),
        "collapsed_sha256",
    )
    return plain.unionByName(touched.select("doc_id", "words", "runs").mapInArrow(report, schema))
