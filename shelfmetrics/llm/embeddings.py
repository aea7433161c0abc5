"""Cosine similarity join of vectors by epsilon grid order.

For unit vectors a cosine of at least t is a distance of at most ``eps = sqrt(2 - 2 t)``. Vectors are
projected on a few principal axes, which never lengthens a distance, and sorted by the cells of a
grid of side eps, lexicographically. The sorted sequence is cut into blocks; blocks are
the leaves of a tree of intervals, each with its bounding box. The join starts with the whole
sequence against itself and goes down the tree, a level per step: a pair of intervals whose boxes
are farther apart than eps is dropped with all below it. Each step is an equi-join on
the parent's number, so no interval list is ever in one place. Block pairs that remain are compared
exactly: dot product over the product of norms, in double precision, for all that single precision
does not rule out.

The comparison moves no block through a shuffle: a few blocks at a time are broadcast, and all blocks
that have a pair with them are read past them where they lie. What is on disk is the vectors and the
links, however many the pairs are. Vectors that single precision holds exactly are written in it.

Equal vectors form a class, and classes are compared. A block pair gives, for each linked class, the
number of vectors it is linked with and one link into its local component, so a group of near
copies costs its size in rows although every pair is looked at.

Defined cases: vectors that are null, empty, zero, or hold a null or a value that is not finite link
with nothing; vectors of different lengths do not link; rows that repeat an id are
separate vectors; a missing id is never the least one; an empty table gives an empty
result. Only ``vec_id`` and ``embedding`` are read.
"""

from __future__ import annotations

from bisect import bisect_left
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmetrics.llm.graph import components
from shelfmetrics.llm.shipping import ship
from shelfmetrics.llm.stages import Stages, numbered
from shelfmetrics.llm.words import mix64

LINK = "a bigint, b bigint, n bigint"
SLICE = 1 << 20  # numbers of candidate pairs that are compared at a time


@dataclass(frozen=True)
class Settings:
    cosine: float = 0.9
    axes: int = 8
    sample: int = 4096  # vectors that the axes are fitted on; they steer pruning, not results
    block_bytes: int = 512 << 10
    held_bytes: int = 16 << 20  # blocks that are broadcast at a time,
    held_pairs: int = 1 << 20  # and their pairs at most
    fan_out_bits: int = 3
    seed: int = 5

    @property
    def eps(self) -> float:
        return float(np.sqrt(max(2 - 2 * self.cosine, 0.0)))


# --- vectors ------------------------------------------------------------------------------------


def _vectors(column: pa.Array):
    """The usable vectors of a column, scaled by a power of two, and which rows they come from."""
    for row, value in enumerate(column):
        values = value.values
        if values is None or not len(values) or values.null_count:
            continue
        vector = values.to_numpy(zero_copy_only=False).astype(np.float64)
        largest = np.abs(vector).max()
        if largest > 0 and np.isfinite(largest):
            yield row, np.ldexp(vector, -int(np.frexp(largest)[1]))


def _digest(vector: np.ndarray) -> tuple[int, int]:
    bits = (vector + 0.0).view(np.uint64)
    place = np.arange(1, len(bits) + 1, dtype=np.uint64)
    first = mix64(bits ^ mix64(place))
    return int(first.sum().view(np.int64)), int(mix64(first + place).sum().view(np.int64))


def _keyed(table: DataFrame) -> DataFrame:
    """``vec_id, high, low, dim, vector`` with a null digest where the vector links with nothing."""
    id_type = table.schema["vec_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            high, low, dim, vectors = [None] * n, [None] * n, [None] * n, [None] * n
            for row, vector in _vectors(batch.column("embedding")):
                high[row], low[row] = _digest(vector)
                dim[row], vectors[row] = len(vector), packed(vector)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id"),
                    pa.array(high, pa.int64()),
                    pa.array(low, pa.int64()),
                    pa.array(dim, pa.int32()),
                    pa.array(vectors, pa.binary()),
                ],
                ["vec_id", "high", "low", "dim", "vector"],
            )

    return table.select("vec_id", "embedding").mapInArrow(
        run, f"vec_id {id_type}, high bigint, low bigint, dim int, vector binary"
    )


def packed(vectors: np.ndarray) -> bytes:
    """In single precision if that loses nothing."""
    with np.errstate(over="ignore", under="ignore"):
        single = vectors.astype(np.float32)
    return (single if np.array_equal(single, vectors) else vectors).tobytes()


def unpacked(content, count: int) -> np.ndarray:
    """``count`` doubles of what ``packed`` gave."""
    size = memoryview(content).nbytes
    return np.frombuffer(content, np.float32 if size == 4 * count else np.float64).astype(np.float64)


def _padded(vectors: pa.Array, dims: pa.Array, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width))
    for k, (value, dim) in enumerate(zip(vectors, dims.to_pylist(), strict=True)):
        out[k, :dim] = unpacked(value.as_buffer(), dim)
    return out


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def principal_axes(classes: DataFrame, width: int, settings: Settings) -> np.ndarray:
    """Leading principal axes of a bounded sample of unit vectors, as columns."""
    order = F.xxhash64(F.lit(settings.seed), "high", "low")
    rows = classes.orderBy(order).limit(settings.sample).select("vector", "dim").collect()
    sample = np.zeros((len(rows), width))
    for k, row in enumerate(rows):
        sample[k, : row.dim] = unpacked(row.vector, row.dim)
    centred = _unit(sample)
    centred -= centred.mean(0)
    _, vectors = np.linalg.eigh(centred.T @ centred)
    return vectors[:, ::-1][:, : settings.axes]


# --- blocks and their tree ----------------------------------------------------------------------


def _projected(classes: DataFrame, axes: np.ndarray, settings: Settings) -> DataFrame:
    """Classes with the grid cells of their projections."""
    width, used = axes.shape
    eps = settings.eps

    def run(batches):
        for batch in batches:
            spots = _unit(_padded(batch.column("vector"), batch.column("dim"), width)) @ axes
            cells = np.floor(spots / eps).astype(np.int32) if batch.num_rows else np.zeros((0, used), np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(name) for name in ("cid", "copies", "dim", "vector")]
                + [pa.array(np.ascontiguousarray(cells[:, k])) for k in range(used)],
                ["cid", "copies", "dim", "vector", *(f"c{k}" for k in range(used))],
            )

    cells = ", ".join(f"c{k} int" for k in range(used))
    return classes.select("cid", "copies", "dim", "vector").mapInArrow(
        run, f"cid bigint, copies bigint, dim int, vector binary, {cells}"
    )


def _blocks(sorted_rows: DataFrame, axes: np.ndarray, settings: Settings) -> DataFrame:
    """Consecutive rows of the sorted sequence, with the bounding box of their projections."""
    width, used = axes.shape
    most = max(1, settings.block_bytes // (8 * width))

    def run(batches):
        part, place, held = TaskContext.get().partitionId(), 0, []

        def block(rows: pa.Table) -> pa.RecordBatch:
            nonlocal place
            vectors = _padded(rows.column("vector").combine_chunks(), rows.column("dim"), width)
            spots = _unit(vectors) @ axes
            place += 1
            columns = {
                "part": pa.array([part], pa.int32()),
                "place": pa.array([place], pa.int32()),
                "cids": pa.array([rows.column("cid").to_numpy().astype(np.int64).tobytes()], pa.binary()),
                "copies": pa.array([rows.column("copies").to_numpy().astype(np.int64).tobytes()], pa.binary()),
                "dims": pa.array([rows.column("dim").to_numpy().astype(np.int32).tobytes()], pa.binary()),
                "vectors": pa.array([packed(vectors)], pa.binary()),
            }
            for k in range(used):
                columns[f"lo{k}"] = pa.array([spots[:, k].min()])
                columns[f"hi{k}"] = pa.array([spots[:, k].max()])
            return pa.RecordBatch.from_pydict(columns)

        for batch in batches:
            held.append(batch.select(["cid", "copies", "dim", "vector"]))
            rows = pa.Table.from_batches(held)
            while rows.num_rows >= most:
                yield block(rows.slice(0, most))
                rows = rows.slice(most)
            held = rows.to_batches()
        if sum(batch.num_rows for batch in held):
            yield block(pa.Table.from_batches(held))

    boxes = ", ".join(f"lo{k} double, hi{k} double" for k in range(used))
    return sorted_rows.mapInArrow(
        run, f"part int, place int, cids binary, copies binary, dims binary, vectors binary, {boxes}"
    )


def _near(used: int, eps: float):
    """Whether the boxes ``x_`` and ``y_`` are within eps (and a little, for rounding)."""

    def gap(k: int):
        return F.greatest(
            F.lit(0.0),
            F.col(f"x_lo{k}") - F.col(f"y_hi{k}"),
            F.col(f"y_lo{k}") - F.col(f"x_hi{k}"),
        )

    return reduce(lambda a, b: a + b, (gap(k) * gap(k) for k in range(used))) <= eps * eps + 1e-9


def block_pairs(stages: Stages, leaves: DataFrame, used: int, settings: Settings) -> DataFrame:
    """Pairs ``(x, y)``, ``x <= y``, of leaves that may hold a link."""
    count, bits = leaves.count(), settings.fan_out_bits
    top = 0
    while count > 1 << (bits * top):
        top += 1
    boxes = [F.min(f"lo{k}").alias(f"lo{k}") for k in range(used)]
    boxes += [F.max(f"hi{k}").alias(f"hi{k}") for k in range(used)]

    def level(at: int, name: str) -> DataFrame:
        nodes = leaves.groupBy(F.shiftright("leaf", bits * at).alias("node")).agg(*boxes)
        parent = F.shiftright("node", bits).alias(f"{name}_parent")
        named = [F.col(c).alias(f"{name}_{c}") for c in nodes.columns]
        return nodes.select(*named, parent)

    pairs = leaves.sparkSession.createDataFrame([(0, 0)], "x bigint, y bigint")
    for at in range(max(top, 1) - 1, -1, -1):
        x, y = level(at, "x"), level(at, "y")
        below = pairs.select(F.col("x").alias("up_x"), F.col("y").alias("up_y"))
        met = below.join(x, F.col("up_x") == F.col("x_parent")).join(
            y,
            (F.col("up_y") == F.col("y_parent"))
            & (F.col("x_node") <= F.col("y_node"))
            & _near(used, settings.eps),
        )
        pairs = stages.write(met.select(F.col("x_node").alias("x"), F.col("y_node").alias("y")), "pairs")
    return pairs


# --- exact comparison ---------------------------------------------------------------------------


def local_roots(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The least node of each node's component, for links (x, y) among n nodes."""
    root = np.arange(n)
    while True:
        before = root.copy()
        low = np.minimum(root[x], root[y])
        np.minimum.at(root, x, low)
        np.minimum.at(root, y, low)
        np.minimum.at(root, before, root)
        root = root[root]
        if np.array_equal(root, before):
            return root


def _linked(x: np.ndarray, y: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """The places of all pairs of a row of ``x`` and one of ``y`` of at least this cosine, in double precision.

    Single precision is wrong by less than the slack, whatever the order of its sums.
    """
    norms = [np.sqrt((p * p).sum(1)) for p in (x, y)]
    single = [(p / n[:, None]).astype(np.float32) for p, n in zip((x, y), norms, strict=True)]
    slack = (x.shape[1] + 4) * 2.0**-23
    near = single[0] @ single[1].T >= np.float32(cosine - slack)
    a, b = np.nonzero(near)
    if len(a) > near.size >> 4:
        return np.nonzero((x @ y.T) / np.outer(*norms) >= cosine)
    step = max(1, SLICE // x.shape[1])
    sure = np.zeros(len(a), bool)
    for at in range(0, len(a), step):
        i, j = a[at : at + step], b[at : at + step]
        sure[at : at + step] = np.einsum("ij,ij->i", x[i], y[j]) / (norms[0][i] * norms[1][j]) >= cosine
    return a[sure], b[sure]


def compare(one: dict, other: dict | None, width: int, cosine: float):
    """Class numbers, their local roots and how many vectors each is linked with."""
    both = [one] if other is None else [one, other]
    cids = [np.frombuffer(b["cids"], np.int64) for b in both]
    parts = [unpacked(b["vectors"], len(c) * width).reshape(-1, width) for b, c in zip(both, cids, strict=True)]
    cids = np.concatenate(cids)
    copies = [np.frombuffer(b["copies"], np.int64) for b in both]
    dims = [np.frombuffer(b["dims"], np.int32) for b in both]
    x, y = _linked(parts[0], parts[-1], cosine)
    links = dims[0][x] == dims[-1][y]
    if other is None:
        links &= x != y
    x, y = x[links], y[links]
    shift = 0 if other is None else len(parts[0])
    number = np.bincount(x, copies[-1][y], len(cids))
    if other is not None:
        number += np.bincount(y + shift, copies[0][x], len(cids))
    touched = np.flatnonzero(number)
    root = local_roots(len(cids), x, y + shift)
    return cids[touched], cids[root[touched]], number[touched].astype(np.int64)


def _links(stages: Stages, pairs: DataFrame, blocks: DataFrame, leaves: DataFrame, width: int, settings: Settings) -> DataFrame:
    """``a, b, n``: a class, the root of its component in one block pair, and its links there.

    Of a pair, one block is held (broadcast) and the other read. Which one it is alternates, so that
    every pass has all blocks to read. The blocks of a part follow each other, and a pass reads only the
    parts between the first and the last that it needs.
    """
    content = ("cids", "copies", "dims", "vectors")
    cosine = settings.cosine

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                sides = [
                    {c: batch.column(f"{s}_{c}")[k].as_buffer() for c in content} for s in ("x", "y")
                ]
                same = batch.column("x")[k].as_py() == batch.column("y")[k].as_py()
                a, b, n = compare(sides[0], None if same else sides[1], width, cosine)
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(n)], ["a", "b", "n"])

    # a row for each task that wrote blocks
    parts = leaves.groupBy("part").agg(F.min(F.col("leaf") - F.col("place")).alias("before"), F.max("leaf").alias("last"))
    parts = sorted((r.last, r.part, r.before) for r in parts.collect())
    before = blocks.sparkSession.createDataFrame([(p, n) for _, p, n in parts], "l_part int, before bigint")
    placed = blocks.join(F.broadcast(before), F.col("part") == F.col("l_part")).withColumn("leaf", F.col("before") + F.col("place"))

    def side(name: str, first: int, last: int) -> DataFrame:
        low, high = (parts[bisect_left(parts, (leaf,))][1] for leaf in (first, last))
        near = placed.where(F.col("part").between(low, high) & F.col("leaf").between(first, last))
        return near.select(F.col("leaf").alias(f"{name}_leaf"), *(F.col(c).alias(f"{name}_{c}") for c in content))

    count = parts[-1][0] + 1
    held = max(1, min(settings.held_bytes // settings.block_bytes, settings.held_pairs // count))
    odd = (F.col("x") + F.col("y")) % 2 == 1
    turned = pairs.select(F.when(odd, F.col("y")).otherwise(F.col("x")).alias("x"), F.when(odd, F.col("x")).otherwise(F.col("y")).alias("y"))
    turned = turned.withColumn("pass", F.floor(F.col("y") / held))
    passes = turned.groupBy("pass").agg(*(f(c).alias(f"{n}_{c}") for n, f in (("min", F.min), ("max", F.max)) for c in "xy"))
    wanted = ["x", "y", *(f"{s}_{c}" for s in ("x", "y") for c in content)]
    links = stages.folder("links")
    for one in passes.orderBy("pass").collect():
        of_pass = turned.where(F.col("pass") == one["pass"]).select("x", "y")
        met = (
            side("x", one.min_x, one.max_x)
            .join(F.broadcast(of_pass), F.col("x") == F.col("x_leaf"))
            .join(F.broadcast(side("y", one.min_y, one.max_y)), F.col("y") == F.col("y_leaf"))
        )
        met.select(*wanted).mapInArrow(run, LINK).write.mode("append").parquet(links)
        stages.free_shuffles()
    return blocks.sparkSession.read.schema(LINK).parquet(links)


def similar_vectors(table: DataFrame, settings: Settings | None = None) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row."""
    settings = settings or Settings()
    ship(table.sparkSession)
    stages = Stages(table.sparkSession)
    vectors = stages.write(_keyed(table), "vectors")
    classes = stages.write(
        vectors.where(F.col("high").isNotNull())
        .groupBy("high", "low", "dim")
        .agg(
            F.min("vec_id").alias("least"),
            F.count(F.lit(1)).alias("copies"),
            F.first("vector").alias("vector"),
        )
        .withColumn("cid", F.monotonically_increasing_id()),
        "classes",
    )
    keyed = stages.write(vectors.drop("vector"), "keyed")
    stages.drop(vectors)
    stages.free_shuffles()
    width = classes.agg(F.max("dim")).first()[0]
    if width is None:
        return keyed.select(
            "vec_id",
            F.lit(0).cast("long").alias("n_links"),
            F.col("vec_id").alias("component_id"),
            F.lit(True).alias("kept"),
        )
    axes = principal_axes(classes, width, settings)
    used = axes.shape[1]
    order = [*(F.col(f"c{k}") for k in range(used)), F.col("cid")]
    projected = _projected(classes, axes, settings)
    cut = _blocks(projected.repartitionByRange(*order).sortWithinPartitions(*order), axes, settings)
    blocks = stages.write(cut, "blocks")
    members = stages.write(classes.drop("vector"), "members")
    stages.drop(classes)
    stages.free_shuffles()
    boxes = [f"{end}{k}" for k in range(used) for end in ("lo", "hi")]
    places = numbered(
        stages, blocks.select("part", "place", *boxes), [F.col("part"), F.col("place")], "leaf"
    )
    leaves = stages.write(places, "leaves")
    pairs = block_pairs(stages, leaves, used, settings)
    links = _links(stages, pairs, blocks, leaves, width, settings)
    stages.drop(blocks)

    labels = components(stages, links.select("a", "b"))
    counts = links.groupBy(F.col("a").alias("n_cid")).agg(F.sum("n").alias("n"))
    rooted = (
        members.join(labels, F.col("cid") == F.col("node"), "left")
        .join(counts, F.col("cid") == F.col("n_cid"), "left")
        .withColumn("root", F.coalesce("component", "cid"))
    )
    least = rooted.groupBy(F.col("root").alias("l_root")).agg(F.min("least").alias("component_id"))
    placed = rooted.join(least, F.col("root") == F.col("l_root")).select(
        F.col("high").alias("p_high"),
        F.col("low").alias("p_low"),
        F.col("dim").alias("p_dim"),
        (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"),
        "component_id",
    )
    joined = keyed.join(
        placed,
        (F.col("high") == F.col("p_high")) & (F.col("low") == F.col("p_low")) & (F.col("dim") == F.col("p_dim")),
        "left",
    )
    component = F.coalesce("component_id", "vec_id")
    return joined.select(
        "vec_id",
        F.coalesce("n", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"),
    )
