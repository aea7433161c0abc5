"""Replace personal data by keyed surrogates, the same for an entity throughout the corpus.

Entities are e-mail addresses, phone numbers, payment cards, IBANs, IPv4 addresses, social security
numbers, credentials, and the words of names that follow a title (and their later mentions in
the text). An entity is known by type and normal form. Its surrogate is drawn from a
keyed hash and keeps type, format, check digits, script and gender; the spelling of each mention
(separators, capitals) is kept too.

Collision checks: no two entities of the corpus share a surrogate, and no surrogate is itself an
entity of the corpus. The entities whose draw breaks a rule draw again, all at once, until none
does; of two that meet, the one with fewer attempts (then the lesser value) stays. Every round is two
aggregates and two joins on the table of distinct entities. Draws from a crowded space widen
(``entities.surrogate``), so rounds are few; numbers of fixed length whose space the corpus fills
end the job with a message after ``MOST_ROUNDS`` draws instead of going on for ever.

Defined cases: a missing text stays missing, a text without entities is unchanged; rows that repeat are
treated alike; an empty table gives an empty result. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmetrics.llm import entities
from shelfmetrics.llm.shipping import ship
from shelfmetrics.llm.stages import Stages

MOST_ROUNDS = 48


def _mentions(texts: DataFrame) -> DataFrame:
    """``doc_id, text_hash, kind, value`` for the distinct entities of each text."""

    def run(batches):
        for batch in batches:
            at, kinds, values = [], [], []
            for row, text in enumerate(batch.column("text").to_pylist()):
                for kind, value in dict.fromkeys((m.kind, m.value) for m in entities.find(text)):
                    at.append(row)
                    kinds.append(kind)
                    values.append(value)
            rows = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(rows),
                    batch.column("text_hash").take(rows),
                    pa.array(kinds, pa.string()),
                    pa.array(values, pa.string()),
                ],
                ["doc_id", "text_hash", "kind", "value"],
            )

    id_type = texts.schema["doc_id"].dataType.simpleString()
    return texts.select("doc_id", "text_hash", "text").mapInArrow(
        run, f"doc_id {id_type}, text_hash bigint, kind string, value string"
    )


def _drawn(rows: DataFrame, key: bytes) -> DataFrame:
    """``kind, value, attempt`` with the surrogate of that attempt."""

    def run(batches):
        for batch in batches:
            columns = [batch.column(name).to_pylist() for name in ("kind", "value", "attempt")]
            drawn = [entities.surrogate(key, *row) for row in zip(*columns, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(name) for name in ("kind", "value", "attempt")), pa.array(drawn, pa.string())],
                ["kind", "value", "attempt", "surrogate"],
            )

    return rows.select("kind", "value", "attempt").mapInArrow(
        run, "kind string, value string, attempt int, surrogate string"
    )


def assign(stages: Stages, found: DataFrame, key: bytes) -> DataFrame:
    """``kind, value, surrogate``: distinct, and none an entity of the corpus."""
    current = found.select("kind", "value").distinct().withColumn("attempt", F.lit(0))
    current = stages.write(_drawn(current, key), "drawn")
    for _ in range(MOST_ROUNDS):
        originals = current.select(F.col("kind").alias("o_kind"), F.col("value").alias("o_value"))
        winners = current.groupBy(F.col("kind").alias("w_kind"), F.col("surrogate").alias("w_surrogate")).agg(
            F.min(F.struct("attempt", "value")).alias("winner")
        )
        judged = (
            current.join(
                winners, (F.col("kind") == F.col("w_kind")) & (F.col("surrogate") == F.col("w_surrogate"))
            )
            .join(originals, (F.col("kind") == F.col("o_kind")) & (F.col("surrogate") == F.col("o_value")), "left")
            .select(
                "kind",
                "value",
                "attempt",
                "surrogate",
                (F.col("o_kind").isNotNull() | (F.col("winner.value") != F.col("value"))).alias("again"),
            )
        )
        judged = stages.write(judged, "judged")
        if judged.where("again").isEmpty():
            return judged.select("kind", "value", "surrogate")
        redrawn = _drawn(judged.where("again").withColumn("attempt", F.col("attempt") + 1), key)
        kept = judged.where(~F.col("again")).drop("again")
        current = stages.write(kept.unionByName(redrawn), "drawn")
    crowded = sorted(row.kind for row in judged.where("again").select("kind").distinct().collect())
    raise ValueError(f"no surrogates are left for some values of: {', '.join(crowded)}")


def pseudonymise(docs: DataFrame, key: bytes) -> DataFrame:
    """``doc_id, text, n_entities`` for every row; ``n_entities``: distinct ones replaced.

    ``key`` (1 to 64 bytes) decides all surrogates: whoever has it can test guesses.
    """
    if not 1 <= len(key) <= 64:
        raise ValueError("a key of 1 to 64 bytes is needed")
    ship(docs.sparkSession)
    stages = Stages(docs.sparkSession)
    text = F.col("text").cast("string")
    keyed = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("text_hash"))
    may_hold = F.coalesce(F.col("text").rlike(entities.MAY_HOLD), F.lit(False))
    likely, plain = keyed.where(may_hold), keyed.where(~may_hold)

    found = stages.write(_mentions(likely), "mentions")
    assigned = assign(stages, found, key).select(
        F.col("kind").alias("a_kind"), F.col("value").alias("a_value"), "surrogate"
    )
    pairs = found.join(assigned, (F.col("kind") == F.col("a_kind")) & (F.col("value") == F.col("a_value")))
    listed = pairs.groupBy(F.col("doc_id").alias("l_id"), F.col("text_hash").alias("l_hash")).agg(
        F.collect_set(F.struct("kind", "value", "surrogate")).alias("known")
    )
    same = F.col("doc_id").eqNullSafe(F.col("l_id")) & (F.col("text_hash") == F.col("l_hash"))
    joined = likely.join(listed, same, "left")

    def run(batches):
        for batch in batches:
            texts = []
            known = batch.column("known").to_pylist()
            for text, rows in zip(batch.column("text").to_pylist(), known, strict=True):
                mapping = {(row["kind"], row["value"]): row["surrogate"] for row in rows or ()}
                texts.append(entities.replace(text, mapping) if mapping else text)
            counts = [len(rows or ()) for rows in known]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(texts, pa.string()), pa.array(counts, pa.int32())],
                ["doc_id", "text", "n_entities"],
            )

    id_type = docs.schema["doc_id"].dataType.simpleString()
    replaced = joined.select("doc_id", "text", "known").mapInArrow(
        run, f"doc_id {id_type}, text string, n_entities int"
    )
    return replaced.unionByName(plain.select("doc_id", "text", F.lit(0).alias("n_entities")))
