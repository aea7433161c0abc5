"""Quality classifier: a factorisation machine over hashed words, structure and metadata.

Features of a text: its distinct words, hashed (weight ``log(1 + count)``, scaled to length 1), bins
of about a dozen byte and word statistics, and a bin of the recorded length ``n_chars``.
The score is the logistic of ``bias + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j``; the pair sum is
``(|sum v_i x_i|^2 - sum |v_i x_i|^2) / 2``, so scoring is linear in the text.

Fitting reads at most ``Settings.fit_rows`` labelled documents, those with the least hash of
their id. Scoring reads every whole text.

Defined cases: a missing text scores as an empty one; a missing or absent ``n_chars`` has a
bin of its own; labels other than 0 and 1 are ignored, and a document that is labelled more
than once has the label most of its rows give (1 in a tie). Without any label every score is 0.5.
Repeated rows get equal scores; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmetrics.llm.shipping import ship
from shelfmetrics.llm.words import Slice, slices, span_hashes, word_bounds

STATISTIC_WEIGHT = 0.4
BINS = 12


@dataclass(frozen=True)
class Settings:
    fit_rows: int = 4000
    hash_bits: int = 15
    rank: int = 8
    steps: int = 400
    batch: int = 128
    rate: float = 0.05
    shrink: float = 1e-5
    seed: int = 7
    threshold: float = 0.3


@dataclass
class Model:
    bias: float
    linear: np.ndarray
    factors: np.ndarray
    hash_bits: int


# --- features -----------------------------------------------------------------------------------

_CLASSES = {
    "upper": range(65, 91),
    "lower": range(97, 123),
    "digit": range(48, 58),
    "space": (0x20, 0x09, 0x0B, 0x0C, 0x0D),
    "line": (0x0A,),
    "stop": tuple(b".,;:'\"()-?"),
    "bang": tuple(b"!"),
    "bar": tuple(b"|"),
    "symbol": tuple(b"#$%&*+/<=>@[\\]^_`{}~"),
    "wide": range(128, 256),
}


_CLASS_OF = np.zeros(256, np.int64)
for _number, _values in enumerate(_CLASSES.values()):
    _CLASS_OF[list(_values)] = _number
_CLASS_OF[[b for b in range(128) if not any(b in values for values in _CLASSES.values())]] = len(_CLASSES)


def _rate_bin(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """0 for a rate of 0, then a bin for each halving, the largest for a rate near 1."""
    rate = part / np.maximum(whole, 1)
    return np.where(part > 0, np.clip(BINS + np.floor(np.log2(rate + 1e-9)), 1, BINS - 1), 0)


def _size_bin(count: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(np.log2(count + 1.0)), 0, BINS - 1)


def _statistics(
    part: Slice, spans: tuple[np.ndarray, np.ndarray], firsts: np.ndarray, distinct: np.ndarray, top: np.ndarray
) -> np.ndarray:
    """One row per document, one column per statistic: the number of its bin."""
    size = np.diff(part.bounds)
    words = np.diff(firsts)
    kinds = len(_CLASSES) + 1
    cell = _CLASS_OF[part.data] + np.repeat(np.arange(part.size) * kinds, size)
    table = np.bincount(cell, minlength=part.size * kinds).reshape(part.size, kinds)
    counts = {name: table[:, k] for k, name in enumerate(_CLASSES)}
    letters = counts["upper"] + counts["lower"] + counts["wide"]
    starts, ends = spans
    owner = np.repeat(np.arange(part.size), words)
    long_words = np.bincount(owner[(ends - starts) > 12], minlength=part.size)
    columns = [
        _rate_bin(counts["upper"], letters),
        _rate_bin(counts["wide"], letters),
        *(_rate_bin(counts[name], size) for name in ("digit", "line", "stop", "bang", "bar", "symbol")),
        _rate_bin(size - letters, size),
        _size_bin((size - counts["space"] - counts["line"]) / np.maximum(words, 1)),
        _rate_bin(words - distinct, words),
        _rate_bin(top, words),
        _rate_bin(long_words, words),
        _size_bin(words),
    ]
    return np.stack(columns, 1).astype(np.int64)


STATISTICS = 14
_META_BINS = 24


def width(hash_bits: int) -> int:
    return (1 << hash_bits) + STATISTICS * BINS + _META_BINS


def features(
    texts: pa.Array, n_chars: pa.Array, hash_bits: int
) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Per slice: first document, feature numbers, their values, where each document begins."""
    recorded = np.array([-1 if x is None else x for x in n_chars.to_pylist()], np.int64)
    for part in slices(texts):
        spans = word_bounds(part)
        hashes = span_hashes(part.data, *spans)
        firsts = np.searchsorted(spans[0], part.bounds)
        owner = np.repeat(np.arange(part.size), np.diff(firsts))
        # one number for a word of a document: slices have far fewer than 2 ** 20 documents
        joint = (owner.astype(np.uint64) << np.uint64(44)) | (hashes >> np.uint64(20))
        joint, count = np.unique(joint, return_counts=True)
        who, word = (joint >> np.uint64(44)).astype(np.int64), joint << np.uint64(20)
        distinct = np.bincount(who, minlength=part.size)
        begins = np.searchsorted(who, np.arange(part.size + 1))
        top = np.zeros(part.size, np.int64)
        if len(who):
            some = np.flatnonzero(distinct)
            top[some] = np.maximum.reduceat(count, begins[some])
        number = (word >> np.uint64(64 - hash_bits)).astype(np.int64)
        value = np.log1p(count)
        length = np.sqrt(np.bincount(who, value * value, part.size))
        value = value / np.maximum(length[who], 1e-9)

        bins = _statistics(part, spans, firsts, distinct, top)
        base = (1 << hash_bits) + np.arange(STATISTICS) * BINS
        meta = recorded[part.first : part.first + part.size]
        meta_bin = np.where(meta < 0, 0, np.clip(np.log2(np.maximum(meta, 0) + 1.0) + 1, 1, _META_BINS - 1))
        fixed = np.concatenate(
            [bins + base, (width(hash_bits) - _META_BINS + meta_bin.astype(np.int64))[:, None]], 1
        )
        extra = fixed.shape[1]
        numbers = np.empty(len(who) + fixed.size, np.int64)
        values = np.full(len(numbers), STATISTIC_WEIGHT)
        place = np.arange(len(who)) + extra * who
        numbers[place], values[place] = number, value
        begins = begins + extra * np.arange(part.size + 1)
        numbers[begins[1:, None] - extra + np.arange(extra)] = fixed
        yield part.first, numbers, values, begins


# --- the model ----------------------------------------------------------------------------------


def _margin(model: Model, numbers: np.ndarray, values: np.ndarray, begins: np.ndarray):
    """Margins and, for the gradient, the sums of the factors; every document has a feature."""
    weighted = model.factors[numbers]
    weighted *= values[:, None]
    sums = np.add.reduceat(weighted, begins[:-1], axis=0)
    squares = np.add.reduceat(weighted * weighted, begins[:-1], axis=0)
    line = np.add.reduceat(model.linear[numbers] * values, begins[:-1])
    return model.bias + line + 0.5 * (sums * sums - squares).sum(1), sums, weighted


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], settings: Settings) -> Model:
    """Stochastic gradient descent with per-weight rates (AdaGrad) on the logistic loss."""
    n = width(settings.hash_bits)
    rng = np.random.default_rng(settings.seed)
    model = Model(0.0, np.zeros(n), rng.normal(0, 0.05, (n, settings.rank)), settings.hash_bits)
    if not rows:
        return Model(0.0, model.linear, np.zeros_like(model.factors), settings.hash_bits)
    labels = np.array([label for _, _, label in rows], float)
    share = (labels.sum() + 1) / (len(labels) + 2)
    model.bias = float(np.log(share / (1 - share)))
    seen_linear, seen_factors = np.full(n, 1e-2), np.full((n, settings.rank), 1e-2)
    shuffled = np.concatenate(
        [rng.permutation(len(rows)) for _ in range(-(-settings.steps * settings.batch // len(rows)))]
    )
    for step in range(settings.steps):
        chosen = shuffled[step * settings.batch : (step + 1) * settings.batch]
        numbers = np.concatenate([rows[i][0] for i in chosen])
        values = np.concatenate([rows[i][1] for i in chosen])
        lengths = np.array([len(rows[i][0]) for i in chosen])
        begins = np.concatenate([[0], np.cumsum(lengths)])
        margin, sums, weighted = _margin(model, numbers, values, begins)
        error = _logistic(margin) - labels[chosen]
        owner = np.repeat(np.arange(len(chosen)), lengths)
        scale = error[owner] * values
        touched, slot = np.unique(numbers, return_inverse=True)
        linear = np.bincount(slot, scale, len(touched)) + settings.shrink * model.linear[touched]
        each = scale[:, None] * (sums[owner] - weighted)
        factors = np.stack(
            [np.bincount(slot, each[:, f], len(touched)) for f in range(settings.rank)], 1
        )
        factors += settings.shrink * model.factors[touched]
        seen_linear[touched] += linear**2
        seen_factors[touched] += factors**2
        model.linear[touched] -= settings.rate * linear / np.sqrt(seen_linear[touched])
        model.factors[touched] -= settings.rate * factors / np.sqrt(seen_factors[touched])
    return model


# --- on Spark -----------------------------------------------------------------------------------


def held_out_by_id(doc_id: Column, parts: int, held: int) -> Column:
    text = F.coalesce(doc_id.cast("string"), F.lit(""))
    return F.crc32(text) % parts == held


def _inputs(docs: DataFrame) -> DataFrame:
    recorded = F.col("n_chars").cast("long") if "n_chars" in docs.columns else F.lit(None).cast("long")
    return docs.select("doc_id", F.col("text").cast("string").alias("text"), recorded.alias("n_chars"))


def train(docs: DataFrame, labels: DataFrame, learn_from: Column, settings: Settings) -> Model:
    """Fit on at most ``fit_rows`` labelled documents for which ``learn_from`` holds."""
    ship(docs.sparkSession)
    voted = (
        labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & learn_from)
        .groupBy("doc_id")
        .agg((F.avg("quality") >= 0.5).cast("int").alias("label"))
    )
    order = F.xxhash64(F.lit(settings.seed), F.col("doc_id"))
    sample = voted.orderBy(order, "doc_id").limit(settings.fit_rows)
    known = sample.withColumnRenamed("doc_id", "l_id")
    joined = (
        _inputs(docs)
        .join(F.broadcast(known), F.col("doc_id") == F.col("l_id"))  # at most fit_rows narrow rows
        .drop("l_id")
        .dropDuplicates(["doc_id"])
    )
    bits = settings.hash_bits

    def extract(batches):
        for batch in batches:
            label = batch.column("label").to_pylist()
            ids = batch.column("doc_id").to_pylist()
            for first, numbers, values, begins in features(batch.column("text"), batch.column("n_chars"), bits):
                count = len(begins) - 1
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": pa.array(ids[first : first + count], batch.column("doc_id").type),
                        "label": pa.array(label[first : first + count], pa.int32()),
                        "numbers": _binary(numbers.astype(np.int32), begins),
                        "values": _binary(values.astype(np.float32), begins),
                    }
                )

    id_type = docs.schema["doc_id"].dataType.simpleString()
    sparse = joined.mapInArrow(extract, f"doc_id {id_type}, label int, numbers binary, values binary")
    rows = [
        (np.frombuffer(row.numbers, np.int32), np.frombuffer(row["values"], np.float32).astype(float), row.label)
        for row in sorted(sparse.collect(), key=lambda row: row.doc_id)
    ]
    return fit(rows, settings)


def _binary(values: np.ndarray, begins: np.ndarray) -> pa.Array:
    return pa.array([values[a:b].tobytes() for a, b in zip(begins[:-1], begins[1:], strict=True)], pa.binary())


def score(docs: DataFrame, model: Model, settings: Settings) -> DataFrame:
    """``doc_id, score, predicted`` for every row."""
    ship(docs.sparkSession)
    threshold = settings.threshold

    def run(batches):
        for batch in batches:
            scores = np.full(batch.num_rows, 0.5)
            for first, numbers, values, begins in features(
                batch.column("text"), batch.column("n_chars"), model.hash_bits
            ):
                margin, _, _ = _margin(model, numbers, values, begins)
                scores[first : first + len(margin)] = _logistic(margin)
            predicted = (scores >= threshold).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(scores), pa.array(predicted)],
                ["doc_id", "score", "predicted"],
            )

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return _inputs(docs).mapInArrow(run, f"doc_id {id_type}, score double, predicted int")


def classify(
    docs: DataFrame, labels: DataFrame, hold_out: tuple[int, int] = (5, 0), settings: Settings | None = None
) -> DataFrame:
    """Score all of ``docs`` by a model that has not seen labels of the held-out ids."""
    settings = settings or Settings()
    held = held_out_by_id(F.col("doc_id"), *hold_out)
    model = train(docs, labels, ~held, settings)
    return score(docs, model, settings).select("doc_id", held.alias("held_out"), "score", "predicted")


def keep_good(docs: DataFrame, labels: DataFrame, settings: Settings | None = None) -> DataFrame:
    """The documents that the classifier accepts, with their columns."""
    settings = settings or Settings()
    held = held_out_by_id(F.col("doc_id"), 5, 0)
    model = train(docs, labels, ~held, settings)
    threshold = settings.threshold
    names = docs.columns

    def run(batches):
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for first, numbers, values, begins in features(
                batch.column("__text"), batch.column("__n_chars"), model.hash_bits
            ):
                margin, _, _ = _margin(model, numbers, values, begins)
                keep[first : first + len(margin)] = _logistic(margin) >= threshold
            yield batch.filter(pa.array(keep)).select(names)

    recorded = F.col("n_chars").cast("long") if "n_chars" in names else F.lit(None).cast("long")
    given = docs.withColumn("__text", F.col("text").cast("string")).withColumn("__n_chars", recorded)
    return given.mapInArrow(run, docs.schema)
