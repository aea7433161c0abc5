"""Language of a text by a bidirectional gated recurrent network over its bytes.

The network reads a segment of bytes in both directions, labels every byte with language
probabilities, and a document's probabilities pool the log-probabilities of all its bytes. A
segment is a word (a run without white space), and every ``most`` bytes of a longer one. The
state starts anew with each segment, so equal segments have equal labels: a batch runs each
distinct segment once and weighs it by how often each document has it.

Fitting reads at most ``fit_docs`` labelled documents, those with the least hash of id and text, and
at most ``fit_words`` random segments of each; backpropagation through time runs in numpy, and
the learned languages are the labels it met. Labelling reads every whole text.

Defined cases: a missing text, or one without a letter, is ``und`` with score 0; without any
labelled document every text is ``und``; texts in which languages tie get the first in
alphabetical order; repeated rows get equal answers; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmetrics.llm.shipping import ship
from shelfmetrics.llm.words import Slice, slices, span_hashes, word_bounds

UNDETERMINED = "und"
EDGE = 0x20  # what stands before and after a segment


@dataclass(frozen=True)
class Settings:
    fit_docs: int = 1500
    fit_words: int = 60
    most: int = 24
    hidden: int = 12
    batch: int = 256
    steps: int = 900
    rate: float = 0.01
    seed: int = 3


@dataclass
class Model:
    """Per direction: input table (256 x 3H), recurrent weights (H x 3H); then the output layer."""

    languages: list[str]
    tables: list[np.ndarray]
    recurrent: list[np.ndarray]
    output: np.ndarray
    bias: np.ndarray


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _step(table_rows: np.ndarray, recurrent: np.ndarray, state: np.ndarray):
    """One GRU step: gates update and reset, then the candidate."""
    h = state.shape[1]
    gates = _sigmoid(table_rows[:, : 2 * h] + state @ recurrent[:, : 2 * h])
    update, reset = gates[:, :h], gates[:, h:]
    pulled = state @ recurrent[:, 2 * h :]
    candidate = np.tanh(table_rows[:, 2 * h :] + reset * pulled)
    return state + update * (candidate - state), update, reset, pulled, candidate


# --- segments -----------------------------------------------------------------------------------


def segments(part: Slice, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all segments, and how many precede each document."""
    starts, ends = word_bounds(part)
    pieces = -(-(ends - starts) // most)
    word = np.repeat(np.arange(len(starts)), pieces)
    place = np.arange(len(word)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    begin = starts[word] + place * most
    return begin, np.minimum(begin + most, ends[word]), np.searchsorted(begin, part.bounds)


def matrix(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, most: int) -> np.ndarray:
    """Segments as rows of bytes, padded at the end."""
    at = starts[:, None] + np.arange(most)
    inside = at < ends[:, None]
    return np.where(inside, data[np.minimum(at, max(len(data) - 1, 0))], EDGE).astype(np.uint8)


def label_positions(model: Model, rows: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Log-probabilities of every language at every byte: rows x positions x languages.

    Rows must be ordered from long to short: each step runs only the rows that are still inside.
    """
    n, width = rows.shape
    hidden = model.recurrent[0].shape[0]
    out = np.zeros((n, width, len(model.languages)), np.float32)
    logits = np.broadcast_to(model.bias, out.shape).astype(np.float32)
    active = np.searchsorted(-lengths, -np.arange(width), "left")
    for side, weights in ((0, model.output[:hidden]), (1, model.output[hidden:])):
        state = np.zeros((n, hidden), np.float32)
        for t in range(width) if side == 0 else range(width - 1, -1, -1):
            live = active[t]
            if live:
                new = _step(model.tables[side][rows[:live, t]], model.recurrent[side], state[:live])[0]
                state[:live] = new
                logits[:live, t] += new @ weights
    logits -= logits.max(2, keepdims=True)
    return logits - np.log(np.exp(logits).sum(2, keepdims=True))


def segment_scores(model: Model, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, most: int) -> np.ndarray:
    """Summed log-probabilities of each segment's bytes."""
    lengths = ends - starts
    order = np.argsort(-lengths, kind="stable")
    out = np.zeros((len(starts), len(model.languages)))
    for at in range(0, len(order), 4096):
        chosen = order[at : at + 4096]
        width = int(lengths[chosen[0]])
        rows = matrix(data, starts[chosen], ends[chosen], width)
        labels = label_positions(model, rows, lengths[chosen])
        inside = np.arange(width) < lengths[chosen][:, None]
        out[chosen] = (labels * inside[:, :, None]).sum(1)
    return out


# --- fitting ------------------------------------------------------------------------------------


def fit(examples: list[tuple[bytes, str]], settings: Settings) -> Model:
    """Cross-entropy at every byte, backpropagated through time in both directions, Adam."""
    languages = sorted({lang for _, lang in examples})
    rng = np.random.default_rng(settings.seed)
    h, k = settings.hidden, len(languages)
    tables = [rng.normal(0, 0.3, (256, 3 * h)) for _ in range(2)]
    recurrent = [rng.normal(0, 1 / np.sqrt(h), (h, 3 * h)) for _ in range(2)]
    output, bias = rng.normal(0, 0.3, (2 * h, k)), np.zeros(k)
    weights = [*tables, *recurrent, output, bias]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    if k > 1:
        target = np.array([languages.index(lang) for _, lang in examples])
        lengths = np.array([len(word) for word, _ in examples])
        rows = np.array(
            [list(word.ljust(settings.most, bytes([EDGE]))) for word, _ in examples], np.uint8
        )
        # examples of like length share a batch, so that little of it is padding
        order = np.argsort(lengths + rng.uniform(0, 1, len(lengths)))
        for step in range(1, settings.steps + 1):
            at = rng.integers(0, max(len(order) - settings.batch, 0) + 1)
            chosen = order[at : at + settings.batch]
            grads = _gradients(weights, rows[chosen], lengths[chosen], target[chosen])
            rate = settings.rate * min(1.0, 2.0 * (1 - step / (settings.steps + 1)))
            for i, grad in enumerate(grads):
                first[i] = 0.9 * first[i] + 0.1 * grad
                second[i] = 0.99 * second[i] + 0.01 * grad * grad
                ready = first[i] / (1 - 0.9**step)
                weights[i] -= rate * ready / (np.sqrt(second[i] / (1 - 0.99**step)) + 1e-8)
    small = [w.astype(np.float32) for w in weights]
    return Model(languages, small[:2], small[2:4], small[4], small[5])


def _gradients(weights: list[np.ndarray], rows: np.ndarray, lengths: np.ndarray, target: np.ndarray):
    tables, recurrent, output, bias = weights[:2], weights[2:4], weights[4], weights[5]
    n, width = rows.shape[0], int(lengths.max())
    h = recurrent[0].shape[0]
    inside = np.arange(width) < lengths[:, None]
    sides = []
    for side in range(2):
        state, steps, states = np.zeros((n, h)), {}, np.zeros((n, width, h))
        for t in range(width) if side == 0 else range(width - 1, -1, -1):
            new, *parts = _step(tables[side][rows[:, t]], recurrent[side], state)
            steps[t] = (state, *parts)
            state = np.where(inside[:, t, None], new, state)
            states[:, t] = state
        sides.append((states, steps))
    both = np.concatenate([sides[0][0], sides[1][0]], 2)
    logits = both @ output + bias
    odds = np.exp(logits - logits.max(2, keepdims=True))
    error = odds / odds.sum(2, keepdims=True)
    error[np.arange(n), :, target] -= 1
    error *= inside[:, :, None] / inside.sum()
    d_output = np.einsum("ntd,ntk->dk", both, error)
    d_bias = error.sum((0, 1))
    d_both = error @ output.T
    d_tables, d_recurrent = [], []
    for side in range(2):
        steps = sides[side][1]
        d_states = d_both[:, :, side * h : (side + 1) * h]
        d_table, d_rec = np.zeros_like(tables[side]), np.zeros_like(recurrent[side])
        carried = np.zeros((n, h))
        for t in range(width - 1, -1, -1) if side == 0 else range(width):
            before, update, reset, pulled, candidate = steps[t]
            live = inside[:, t, None]
            total = carried + d_states[:, t]
            d_new = np.where(live, total, 0)
            d_candidate = d_new * update * (1 - candidate**2)
            d_update = d_new * (candidate - before) * update * (1 - update)
            d_reset = d_candidate * pulled * reset * (1 - reset)
            d_gates = np.concatenate([d_update, d_reset], 1)
            d_pulled = d_candidate * reset
            np.add.at(d_table, rows[:, t], np.concatenate([d_gates, d_candidate], 1))
            d_rec[:, : 2 * h] += before.T @ d_gates
            d_rec[:, 2 * h :] += before.T @ d_pulled
            back = d_new * (1 - update) + d_gates @ recurrent[side][:, : 2 * h].T
            back += d_pulled @ recurrent[side][:, 2 * h :].T
            carried = np.where(live, back, carried)
        d_tables.append(d_table)
        d_recurrent.append(d_rec)
    return [*d_tables, *d_recurrent, d_output, d_bias]


# --- on Spark -----------------------------------------------------------------------------------


def train(docs: DataFrame, learn_from: Column, settings: Settings) -> Model:
    """Fit on a bounded sample of the labelled documents for which ``learn_from`` holds."""
    order = F.xxhash64(F.lit(settings.seed), "doc_id", "text")
    known = docs.where(learn_from & F.col("lang").isNotNull() & F.col("text").isNotNull())
    least = known.select(order.alias("order")).distinct().orderBy("order").limit(settings.fit_docs)
    chosen = least.agg(F.max("order")).first()[0]
    if chosen is None:
        return fit([], settings)
    sample = (
        known.where(order <= chosen)
        .select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
        .dropDuplicates(["text"])
    )
    most, count, seed = settings.most, settings.fit_words, settings.seed

    def extract(batches):
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for part in slices(batch.column("text")):
                starts, ends, firsts = segments(part, most)
                rank = span_hashes(part.data, starts, ends) + np.uint64(seed)
                words, owners = [], []
                for i in range(part.size):
                    own = np.arange(firsts[i], firsts[i + 1])
                    own = own[np.argsort(rank[own] ^ np.uint64(i), kind="stable")][:count]
                    words += [part.data[starts[j] : ends[j]].tobytes() for j in own]
                    owners += [langs[part.first + i]] * len(own)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(words, pa.binary()), pa.array(owners, pa.string())], ["word", "lang"]
                )

    rows = sample.mapInArrow(extract, "word binary, lang string").collect()
    return fit(sorted((bytes(row.word), row.lang) for row in rows), settings)


def label_documents(part: Slice, model: Model, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Per document of a slice: the language's number and its share of the pooled probability."""
    starts, ends, firsts = segments(part, most)
    hashes = span_hashes(part.data, starts, ends)
    _, sample, group = np.unique(hashes, return_index=True, return_inverse=True)
    scores = segment_scores(model, part.data, starts[sample], ends[sample], most)
    total = np.concatenate([np.zeros((1, scores.shape[1])), np.cumsum(scores[group], 0)])
    pooled = total[firsts[1:]] - total[firsts[:-1]]
    size = np.maximum(np.diff(part.bounds), 1)[:, None]
    best = pooled.argmax(1)
    mean = np.exp((pooled - pooled.max(1, keepdims=True)) * np.minimum(1, 20 / size))
    return best, (mean / mean.sum(1, keepdims=True))[np.arange(len(best)), best]


def predict(docs: DataFrame, model: Model, settings: Settings) -> DataFrame:
    """``doc_id, lang_pred, score`` for every row."""
    ship(docs.sparkSession)
    most = settings.most

    def run(batches):
        for batch in batches:
            names = np.full(batch.num_rows, UNDETERMINED, object)
            scores = np.zeros(batch.num_rows)
            spoken = batch.column("has_letter").to_numpy(zero_copy_only=False).astype(bool)
            for part in slices(batch.column("text")) if model.languages else ():
                best, share = label_documents(part, model, most)
                rows = np.arange(part.first, part.first + part.size)
                own = spoken[rows]
                names[rows[own]] = np.array(model.languages, object)[best[own]]
                scores[rows[own]] = share[own]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(names, pa.string()), pa.array(scores)],
                ["doc_id", "lang_pred", "score"],
            )

    id_type = docs.schema["doc_id"].dataType.simpleString()
    text = F.col("text").cast("string")
    letters = F.coalesce(text.rlike(r"\p{L}"), F.lit(False))
    given = docs.select("doc_id", text.alias("text"), letters.alias("has_letter"))
    return given.mapInArrow(run, f"doc_id {id_type}, lang_pred string, score double")


def identify(docs: DataFrame, hold_out: tuple[int, int] = (4, 2), settings: Settings | None = None) -> DataFrame:
    """Label all of ``docs`` by a network that has not seen the held-out ids."""
    settings = settings or Settings()
    ship(docs.sparkSession)
    parts, held_part = hold_out
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % parts == held_part
    model = train(docs, ~held, settings)
    return predict(docs, model, settings).select("doc_id", held.alias("held_out"), "lang_pred", "score")
