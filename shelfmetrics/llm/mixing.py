"""Mix sources to target weights by pivotal rounding of fractional copies.

Every document of a source is owed ``target / source_size`` copies. The whole part is
given; the fraction is settled in pairs: words move from one document of a pair to the
other, in a random direction with the odds that keep each expectation, until one of the
two owes a whole copy. Words are conserved, and the last open document of a source takes
the nearest whole number, so a source's total misses its target by half that document at most.

Pairs are settled in a tree: hash buckets of some hundred documents, largest first, each fold
to one open document; those are bucketed again, until one is left per source.

Defined cases: a missing text or one of white space has size 0 and takes nothing; missing
sources form one source, sorted last; rows that agree in source, id and size are one unit
of several rows, which share the unit's copies evenly; an empty table gives an empty
result. Only the named columns are read; others may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmetrics.llm.stages import Stages, numbered

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
BUCKET = 128
SEED = 20260
OPEN = 1e-9  # a fraction nearer to a whole number than this is whole


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(
    stages: Stages,
    units: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    most_copies: int = MOST_COPIES,
) -> DataFrame:
    """Per source: its number in sort order, size, number of units and target.

    ``target = least(most_copies * size, level * weight)``. The level rises until the targets add
    up to all words; each step needs two sums only.
    """
    sources = units.groupBy("source").agg(
        F.sum(F.col("size") * F.col("rows")).alias("source_size"),
        F.count(F.lit(1)).alias("units"),
    )
    ranked = numbered(stages, sources, [F.col("source").asc_nulls_last()], "sid")
    cycle = F.array(*(F.lit(w) for w in weights))
    weight = F.element_at(cycle, (F.col("sid") % len(weights) + 1).cast("int"))
    weighted = stages.write(ranked.withColumn("weight", weight), "sources")

    limit = F.col("source_size") * most_copies
    total = weighted.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    level = 0.0
    while True:
        full = limit <= F.lit(level) * F.col("weight")
        bound, open_weight = weighted.agg(
            F.coalesce(F.sum(F.when(full, limit)), F.lit(0)),
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0)),
        ).first()
        if not open_weight:
            break
        raised = (total - bound) / open_weight
        if raised <= level:
            break
        level = raised
    return weighted.withColumn("target", F.least(limit.cast("double"), F.lit(level) * F.col("weight")))


def _uniform(*parts: Column) -> Column:
    bits = F.shiftrightunsigned(F.xxhash64(*parts), 11)
    return bits.cast("double") / F.lit(float(1 << 53))


def _settle(level: int, seed: int):
    """One pivotal step: the carried document against the next."""

    def step(carried: Column, unit: Column) -> Column:
        give_up = (1 - carried["frac"]) * carried["size"]
        give_down = carried["frac"] * carried["size"]
        unit_up = (1 - unit["frac"]) * unit["size"]
        unit_down = unit["frac"] * unit["size"]
        up, down = F.least(give_up, unit_down), F.least(give_down, unit_up)
        draw = _uniform(F.lit(seed + level), carried["doc_id"], unit["doc_id"], unit["size"])
        rises = draw * (up + down) < down
        moved = F.when(rises, up).otherwise(-down)
        ends = F.when(rises, give_up <= unit_down).otherwise(give_down <= unit_up)
        whole = F.when(ends, rises).otherwise(~rises).cast("int")

        def pick(name: str, from_unit: Column) -> Column:
            return F.when(from_unit, unit[name]).otherwise(carried[name]).alias(name)

        frac = F.when(ends, unit["frac"] - moved / unit["size"]).otherwise(
            carried["frac"] + moved / carried["size"]
        )
        settled = F.struct(pick("doc_id", ~ends), pick("size", ~ends), whole.alias("up"))
        return F.struct(
            pick("doc_id", ends),
            pick("size", ends),
            F.least(F.greatest(frac, F.lit(0.0)), F.lit(1.0)).alias("frac"),
            F.concat(carried["done"], F.array(settled)).alias("done"),
        )

    return step


def pivotal_rounding(stages: Stages, open_units: DataFrame, most: int, bucket: int, seed: int) -> DataFrame:
    """``(sid, doc_id, size, up)`` for every open unit; ``most``: units of the largest source."""
    id_type = open_units.schema["doc_id"].dataType.simpleString()
    done_type = f"array<struct<doc_id:{id_type},size:bigint,up:int>>"
    current, level, settled = open_units, 0, []
    while True:
        most = -(-most // bucket)
        current = current.withColumn("units", F.ceil(F.col("units") / bucket))
        place = F.pmod(F.xxhash64(F.lit(seed + level), "doc_id", "size"), F.col("units"))
        gathered = current.groupBy("sid", "units", place.alias("place")).agg(
            F.sort_array(
                F.collect_list(
                    F.struct(
                        (-F.col("size")).alias("order"),
                        F.xxhash64(F.lit(seed), "doc_id").alias("tie"),
                        "doc_id",
                        "size",
                        "frac",
                    )
                )
            ).alias("members")
        )
        first = F.element_at("members", 1)
        start = F.struct(
            first["doc_id"].alias("doc_id"),
            first["size"].alias("size"),
            first["frac"].alias("frac"),
            F.array().cast(done_type).alias("done"),
        )
        rest = F.slice("members", F.lit(2), F.greatest(F.size("members") - 1, F.lit(0)))
        folded = stages.write(
            gathered.select(
                "sid", "units", F.aggregate(rest, start, _settle(level, seed)).alias("carried")
            ),
            f"settled{level}",
        )
        settled.append(folded.select("sid", F.inline("carried.done")))
        current = folded.select("sid", "units", "carried.doc_id", "carried.size", "carried.frac")
        level += 1
        if most <= 1:
            break
    nearest = (F.col("frac") >= 0.5).cast("int")
    settled.append(current.select("sid", "doc_id", "size", nearest.alias("up")))
    result = settled[0]
    for more in settled[1:]:
        result = result.unionByName(more)
    return result


def mix_units(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    most_copies: int = MOST_COPIES,
    bucket: int = BUCKET,
    seed: int = SEED,
) -> DataFrame:
    """Per distinct ``(source, doc_id, size)``: its rows, the copies they share, the source's figures."""
    stages = Stages(docs.sparkSession)
    sized = docs.select("source", "doc_id", word_count(F.col("text")).alias("size"))
    units = stages.write(
        sized.groupBy("source", "doc_id", "size").agg(F.count(F.lit(1)).alias("rows")), "units"
    )
    sources = stages.write(source_targets(stages, units, weights, most_copies), "targets")
    per_row = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    owed = F.when(F.col("size") > 0, F.col("rows") * per_row).otherwise(0.0)
    renamed = sources.withColumnRenamed("source", "s_source")
    joined = (
        units.join(renamed, F.col("source").eqNullSafe(F.col("s_source")))
        .drop("s_source", "weight")
        .withColumn("owed", owed)
        .withColumn("whole", F.floor(F.col("owed") + OPEN))
        .withColumn("frac", F.greatest(F.col("owed") - F.col("whole"), F.lit(0.0)))
    )
    open_units = joined.where(F.col("frac") > OPEN).select("sid", "units", "doc_id", "size", "frac")
    most = sources.agg(F.coalesce(F.max("units"), F.lit(0))).first()[0]
    decided = pivotal_rounding(stages, open_units, most, bucket, seed)
    up = decided.select(
        F.col("sid").alias("d_sid"), F.col("doc_id").alias("d_id"), F.col("size").alias("d_size"), "up"
    )
    return (
        joined.join(
            up,
            (F.col("sid") == F.col("d_sid"))
            & F.col("doc_id").eqNullSafe(F.col("d_id"))
            & (F.col("size") == F.col("d_size")),
            "left",
        )
        .withColumn("copies", F.col("whole") + F.coalesce("up", F.lit(0)))
        .select("source", "doc_id", "size", "rows", "source_size", "target", "copies")
    )


def _share(row: Column) -> Column:
    """Copies of the ``row``-th (from 1) of a unit's equal rows."""
    even = F.floor(F.col("copies") / F.col("rows"))
    return even + (row <= F.col("copies") % F.col("rows")).cast("long")


def mix_report(docs: DataFrame, **settings) -> DataFrame:
    """One line per row of ``docs``: size, its source's size and target, copies and words taken."""
    lines = mix_units(docs, **settings).withColumn(
        "row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows")))
    )
    copies = _share(F.col("row"))
    return lines.select(
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        copies.alias("copies"),
        (copies * F.col("size")).alias("taken"),
    )


def mix(docs: DataFrame, **settings) -> DataFrame:
    """The mixed corpus: every row as often as it is taken, with ``copy`` counting from 1."""
    units = mix_units(docs, **settings).select(
        F.col("source").alias("u_source"),
        F.col("doc_id").alias("u_id"),
        F.col("size").alias("u_size"),
        "rows",
        "copies",
    )
    packed = docs.select(
        F.struct("*").alias("row"),
        F.col("source").alias("r_source"),
        F.col("doc_id").alias("r_id"),
        word_count(F.col("text")).alias("r_size"),
    )
    matched = packed.join(
        units.where(F.col("copies") > 0),
        F.col("u_source").eqNullSafe(F.col("r_source"))
        & F.col("u_id").eqNullSafe(F.col("r_id"))
        & (F.col("u_size") == F.col("r_size")),
    )
    single = matched.where(F.col("rows") == 1).withColumn("share", F.col("copies"))
    place = F.expr("row_number() over (partition by r_id, r_source, r_size order by xxhash64(row))")
    several = matched.where(F.col("rows") > 1).withColumn("at", place)
    shared = several.withColumn("share", _share(F.col("at"))).drop("at")
    taken = single.unionByName(shared).where(F.col("share") > 0)
    copy = F.explode(F.sequence(F.lit(1).cast("long"), F.col("share")))
    names = [F.col("row")[name].alias(name) for name in docs.columns if name != "copy"]
    return taken.select("row", copy.alias("copy")).select(*names, "copy")
