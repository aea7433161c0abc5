"""The prefix trie of conversations by truncation peeling.

A node is a distinct sequence of the first d turns of some conversation; its members are the
conversations that begin with it. Nodes are found and aggregated in one pass from the deepest
level up: level d is what the conversations that end at d turns and the nodes of level d + 1, their
last turn stripped, make when they are grouped by what is left. A group's least conversation,
members, children, leaves and tokens saved are sums and minima over these two kinds of rows, so
they combine before the shuffle, and a first turn that a third of all conversations share arrives
as one row per input partition. A node met at one level is a single row at the next.

Turns that a conversation shares with no other are peeled at once, since below the last shared node
all its nodes have one member: an aggregate over all sequences finds those that are met
once, and their least depth per conversation is where its tail begins. The rounds are as many as
the longest sequence that two conversations share has turns.

A sequence is known by a chain of MD5 digests, one per turn, over role and text; a row carries the
chain of its turns with their sizes, and stripping drops the last link. Texts are digested where
they are read and never shuffled.

What needs more than sums:

- ``parent_conv_id`` comes from a join of nodes with their parents (in a tail it is the conversation itself). Nodes with at least a thousandth of
  all nodes as children (there are at most a thousand of these) are broadcast; the
  others join by key, where no key has many rows.
- ``ends_sha256`` hashes the members that end at a node in numeric order. Ended conversations are
  range-partitioned by node and id, which splits a node with any number of them; every
  partition writes the ids of a node as a few long texts, and only these are brought together,
  streamed in order through one hash.

Each level is written, so a lost executor costs the running round only. The digests of one
conversation's turns travel as one row.

Defined cases: a missing turn number comes first; rows with equal turn numbers are ordered by role,
then by digest, so their order in the file does not matter; a missing role or text is empty; rows
without ``conv_id`` belong to no conversation; an empty table gives an empty result, not even a
root. Only ``conv_id, turn, role, text`` are read; other columns may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmetrics.llm.shipping import ship
from shelfmetrics.llm.stages import Stages

ROOT = ""  # the key of the empty sequence
MANY = 1_000  # a parent of more than 1 / MANY of all nodes is broadcast
CHUNK_BYTES = 1 << 16
GROUP, MOST_SHARED = 5, 9
TURNS = "array<struct<digest:string,bytes:bigint>>"


def turn_lists(conversations: DataFrame) -> DataFrame:
    """``conv_id, turns``: digests and sizes of a conversation's turns in order."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    whole = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    turns = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.struct(
            F.col("turn").isNotNull().alias("numbered"),
            F.col("turn").alias("turn"),
            role.alias("role"),
            F.md5(whole.cast("binary")).alias("digest"),
            F.octet_length(text).cast("bigint").alias("bytes"),
        ).alias("turn"),
    )
    in_order = F.sort_array(F.collect_list("turn"))
    short = F.transform(in_order, lambda t: F.struct(t["digest"].alias("digest"), t["bytes"].alias("bytes")))
    return turns.groupBy("conv_id").agg(short.alias("turns"))


def rebuilt(lists: DataFrame) -> DataFrame:
    """The contract's conversations: the first turns come from the least one of a group of five."""
    shared = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(MOST_SHARED)).cast("int")
    base = lists.where(F.col("conv_id") % GROUP == 0).select(
        F.col("conv_id").alias("b_id"), F.slice("turns", 1, MOST_SHARED - 1).alias("b_turns")
    )
    own = lists.withColumn("h", shared).withColumn("base", F.col("conv_id") - F.col("conv_id") % GROUP)
    begin = F.slice(F.coalesce("b_turns", F.array().cast(TURNS)), F.lit(1), F.col("h"))
    rest = F.expr("slice(turns, h + 1, size(turns))")
    return own.join(base, F.col("base") == F.col("b_id"), "left").select(
        "conv_id", F.concat(begin, rest).alias("turns")
    )


def _chained(turns: Column) -> Column:
    """Every turn's digest replaced by that of the whole sequence up to it."""

    def step(done: Column, turn: Column) -> Column:
        before = F.coalesce(F.try_element_at(done, F.lit(-1))["digest"], F.lit(ROOT))
        link = F.struct(
            F.md5(F.concat(before, turn["digest"]).cast("binary")).alias("digest"), turn["bytes"].alias("bytes")
        )
        return F.concat(done, F.array(link))

    return F.aggregate(turns, F.array().cast(TURNS), step)


def _last(field: str) -> Column:
    return F.try_element_at(F.col("turns"), F.lit(-1))[field]


def _level(entering: DataFrame, deeper: DataFrame | None) -> DataFrame:
    """One round: what enters here, and the nodes of the level below with their last turn stripped.

    A conversation that ``ended`` enters where it ends; another one at the last node it shares, as a
    child with its tail below.
    """
    none, zero = F.lit(None).cast("bigint"), F.lit(0).cast("bigint")
    ended, below = F.col("ended").cast("bigint"), (~F.col("ended")).cast("bigint")
    rows = entering.select(
        "turns",
        F.col("conv_id").alias("conv"),
        F.lit(1).cast("bigint").alias("members"),
        ended.alias("ends"),
        F.when(F.col("ended"), F.col("conv_id")).alias("end_conv"),
        below.alias("child"),
        below.alias("leaves"),
        zero.alias("saved"),
    )
    if deeper is not None:
        stripped = F.expr("slice(turns, 1, size(turns) - 1)")
        rows = rows.unionByName(
            deeper.select(
                stripped.alias("turns"),
                F.col("conv_id").alias("conv"),
                F.col("n_convs").alias("members"),
                zero.alias("ends"),
                none.alias("end_conv"),
                F.lit(1).cast("bigint").alias("child"),
                F.col("n_leaves").alias("leaves"),
                F.col("saved_tokens").alias("saved"),
            )
        )
    grouped = rows.groupBy(F.coalesce(_last("digest"), F.lit(ROOT)).alias("key")).agg(
        F.first("turns").alias("turns"),
        F.min("conv").alias("conv_id"),
        F.sum("members").alias("n_convs"),
        F.sum("ends").alias("n_ends"),
        F.min("end_conv").alias("end_conv"),
        F.sum("child").alias("n_children"),
        F.sum("leaves").alias("leaves"),
        F.sum("saved").alias("saved"),
    )
    own = (F.col("n_convs") - 1) * F.coalesce(_last("bytes"), F.lit(0))
    return grouped.select(
        "key",
        F.coalesce(F.try_element_at("turns", F.lit(-2))["digest"], F.lit(ROOT)).alias("parent"),
        F.size("turns").cast("bigint").alias("depth"),
        "turns",
        "conv_id",
        "n_convs",
        "n_ends",
        "end_conv",
        "n_children",
        F.when(F.col("n_children") == 0, 1).otherwise(F.col("leaves")).alias("n_leaves"),
        (F.col("saved") + own).alias("saved_tokens"),
    )


def peeled(stages: Stages, entering: DataFrame) -> DataFrame:
    """All shared nodes and the root, level by level from the deepest; ``entering`` has ``level``."""
    deepest = entering.agg(F.max("level")).first()[0]
    folder, level = stages.folder("levels"), None
    for depth in range(-1 if deepest is None else deepest, -1, -1):
        rows = _level(entering.where(F.col("level") == depth), level)
        level = stages.write_to(rows, f"{folder}/level={depth}")
    if level is None:
        return _level(entering, None).drop("turns")
    return stages.spark.read.schema(level.schema).parquet(folder).drop("turns", "level")


def _with_parents(nodes: DataFrame, shared: DataFrame) -> DataFrame:
    """``nodes`` with ``parent_conv_id``; the root has none, and tails below their first node know it."""
    known = nodes.where((F.col("depth") == 0) | F.col("parent_conv_id").isNotNull())
    inner = nodes.where((F.col("depth") > 0) & F.col("parent_conv_id").isNull()).drop("parent_conv_id")
    total = inner.count()
    parents = shared.where(F.col("n_children") > 0).select(
        F.col("key").alias("p_key"), F.col("conv_id").alias("p_conv"), "n_children"
    )
    many = F.col("n_children") * MANY >= total
    large = F.broadcast(parents.where(many).select("p_key", F.col("p_conv").alias("l_conv")))
    found = inner.join(large, F.col("parent") == F.col("p_key"), "left").drop("p_key")
    small = parents.where(~many).select("p_key", F.col("p_conv").alias("s_conv"))
    rest = found.where(F.col("l_conv").isNull()).drop("l_conv")
    joined = rest.join(small, F.col("parent") == F.col("p_key"), "left").drop("p_key")
    done = found.where(F.col("l_conv").isNotNull()).withColumnRenamed("l_conv", "parent_conv_id")
    return joined.withColumnRenamed("s_conv", "parent_conv_id").unionByName(done).unionByName(known)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows in order of node and id: the ids of a node as texts of bounded length."""
    names = ["key", "first_id", "ids"]
    out: list[tuple[str, int, str]] = []
    key, first, parts, size = None, 0, [], 0

    def packed() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True))
        kinds = (pa.string(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    for batch in batches:
        for node, conv in zip(batch.column("key").to_pylist(), batch.column("conv_id").to_pylist(), strict=True):
            if parts and (node != key or size >= CHUNK_BYTES):
                out.append((key, first, ",".join(parts)))
                parts, size = [], 0
            if not parts:
                key, first = node, conv
            parts.append(str(conv))
            size += len(parts[-1]) + 1
        if out:
            yield packed()
            out.clear()
    if parts:
        out.append((key, first, ",".join(parts)))
        yield packed()


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From chunks in order of node and id: one digest per node, with one chunk in memory."""
    key, running = None, None

    def packed(done: list[tuple[str, str]]) -> pa.RecordBatch:
        keys, digests = zip(*done, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(digests, pa.string())], ["e_key", "e_sha"])

    for batch in batches:
        done = []
        for node, ids in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            if running is not None and node == key:
                running.update(b",")
            else:
                if running is not None:
                    done.append((key, running.hexdigest()))
                key, running = node, hashlib.sha256()
            running.update(ids.encode())
        if done:
            yield packed(done)
    if running is not None:
        yield packed([(key, running.hexdigest())])


def ends_digests(entering: DataFrame, several: DataFrame) -> DataFrame:
    """``e_key, e_sha`` of the nodes at which more than one conversation ends."""
    ended = entering.where("ended").select(F.coalesce(_last("digest"), F.lit(ROOT)).alias("key"), "conv_id")
    tasks = int(entering.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = ended.repartitionByRange(tasks, "key", "conv_id").sortWithinPartitions("key", "conv_id")
    chunks = ordered.mapInArrow(_chunks, "key string, first_id bigint, ids string")
    wanted = chunks.join(several.select(F.col("key").alias("w_key")), F.col("key") == F.col("w_key"), "left_semi")
    together = wanted.repartition(tasks, "key").sortWithinPartitions("key", "first_id")
    return together.mapInArrow(_hashes, "e_key string, e_sha string")


def _tails(paths: DataFrame) -> DataFrame:
    """``t_id, tail``: the least depth from which on a conversation shares its sequence with no other."""
    met = paths.select("conv_id", F.posexplode("turns").alias("at", "turn")).select(
        "conv_id", "at", F.col("turn.digest").alias("key")
    )
    counted = met.groupBy("key").agg(
        F.min("conv_id").alias("t_id"), F.max("conv_id").alias("other"), F.min("at").alias("at")
    )
    alone = counted.where(F.col("t_id") == F.col("other"))
    return alone.groupBy("t_id").agg((F.min("at") + 1).alias("tail"))


def _entering(stages: Stages, paths: DataFrame) -> DataFrame:
    """Every conversation where the peeling meets it, one folder per level, so that a round reads its own."""
    joined = paths.join(_tails(paths), F.col("conv_id") == F.col("t_id"), "left").drop("t_id")
    level = F.coalesce(F.col("tail") - 1, F.size("turns"))
    cut = joined.withColumn("ended", F.col("tail").isNull()).withColumn("level", level)
    return stages.write(cut.withColumn("turns", F.expr("slice(turns, 1, level)")), "entering", ["level"])


def _tail_nodes(paths: DataFrame, entering: DataFrame) -> DataFrame:
    """The nodes of one member below the last shared one."""
    tails = entering.where(F.col("tail").isNotNull()).select(F.col("conv_id").alias("t_id"), "tail")
    sizes = paths.select("conv_id", F.size("turns").alias("n"), "turns").join(tails, F.col("conv_id") == F.col("t_id"))
    above = F.coalesce(F.expr("try_element_at(turns, tail - 1)")["digest"], F.lit(ROOT))
    first = F.when(F.col("tail") > 1, above).otherwise(F.lit(ROOT))
    each = sizes.select("conv_id", "n", "tail", first.alias("above"), F.explode(F.sequence("tail", "n")).alias("d"))
    one, last, none = F.lit(1).cast("bigint"), F.col("d") == F.col("n"), F.lit(None).cast("bigint")
    return each.select(
        F.lit(None).cast("string").alias("key"),
        F.when(F.col("d") == F.col("tail"), F.col("above")).alias("parent"),
        F.col("d").cast("bigint").alias("depth"),
        "conv_id",
        one.alias("n_convs"),
        last.cast("bigint").alias("n_ends"),
        F.when(last, F.col("conv_id")).alias("end_conv"),
        (~last).cast("bigint").alias("n_children"),
        one.alias("n_leaves"),
        F.lit(0).cast("bigint").alias("saved_tokens"),
        F.when(F.col("d") > F.col("tail"), F.col("conv_id")).otherwise(none).alias("parent_conv_id"),
    )


def trie(lists: DataFrame) -> DataFrame:
    """The nodes of conversations given as ``conv_id, turns`` (see ``turn_lists``)."""
    ship(lists.sparkSession)
    stages = Stages(lists.sparkSession)
    paths = stages.write(lists.select("conv_id", _chained(F.col("turns")).alias("turns")), "paths")
    entering = _entering(stages, paths)
    shared = peeled(stages, entering)
    digests = ends_digests(entering, shared.where(F.col("n_ends") > 1))
    parentless = shared.withColumn("parent_conv_id", F.lit(None).cast("bigint"))
    nodes = _with_parents(parentless.unionByName(_tail_nodes(paths, entering)), shared)
    one = F.sha2(F.col("end_conv").cast("string").cast("binary"), 256)
    none = F.sha2(F.lit("").cast("binary"), 256)
    return nodes.join(digests, (F.col("key") == F.col("e_key")) & (F.col("n_ends") > 1), "left").select(
        "conv_id",
        "depth",
        "parent_conv_id",
        "n_convs",
        "n_children",
        "n_leaves",
        "saved_tokens",
        F.when(F.col("n_ends") > 1, F.col("e_sha")).when(F.col("n_ends") == 1, one).otherwise(none).alias("ends_sha256"),
    )


def trie_report(conversations: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations."""
    return trie(rebuilt(turn_lists(conversations)))
