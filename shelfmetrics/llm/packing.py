"""Sum-of-squares packing of tokenised documents into sequences of a fixed length.

A document's ids are cut into pieces of ``capacity`` tokens; the last one may be shorter. A full
piece is a sequence of its own. The others are packed: let N(g) be the number of open sequences with
g free places. Pieces come longest first, and each goes where the sum of N(g) squared becomes
smallest: taking it from N(g) to N(g - s) changes the sum by 2 (N(g - s) - N(g)) + 2, and
filling a sequence to the end by 1 - 2 N(g). Equal changes take the tightest fit; a new sequence
opens only when no open one has room, since sequences are what is to be saved.

Distribution: pieces are dealt by a hash into shards of about ``shard_rows``, each packed
on its own, whatever the lengths are. The sequences that a shard leaves open are the pieces of the next
round, in shards of the same size, until one shard holds them or a round saves next to
nothing. So no task holds more than a shard, and one document or length that makes up a third of
all rows is spread like any other. A sequence is named by the piece that opened it.

Texts are tokenised once, in slices. No token of the vocabulary spans white space, so a text's ids are those
of its words in a row: each task tokenises a word when it first meets it and copies its ids from
then on (``Settings.known_words`` bounds what it remembers). The vocabulary file is read on the
driver and broadcast (a few MB).

Defined cases: a missing text counts as empty and is the closing id alone; rows that repeat are packed
one by one; a missing id stays missing; an empty table gives an empty result. Only ``doc_id``
and ``text`` are read; other columns may have any name.
"""

from __future__ import annotations

import os
import zlib
from dataclasses import dataclass
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmetrics.llm.shipping import ship
from shelfmetrics.llm.stages import Stages
from shelfmetrics.llm.words import slices

_PLAIN = np.array([b < 128 and chr(b).isalnum() for b in range(256)])
_PUNCTUATION = np.array([32 < b < 127 and not chr(b).isalnum() for b in range(256)])


@dataclass(frozen=True)
class Settings:
    capacity: int = 4096
    closing_id: int = 1
    shard_rows: int = 8192
    least_saving: float = 0.01  # share of its items that a round must save for another one
    vocabulary: str = ""  # a file of the tokenizers library; "" is the public word vocabulary
    known_words: int = 1 << 19  # words whose ids a task remembers

    def vocabulary_text(self) -> str:
        name = self.vocabulary
        if not name:
            import public_tokenizers

            name = public_tokenizers.path("word_bpe_49k.json")
        return Path(name).read_text(encoding="utf-8")


class WordIds:
    """The ids of whole texts, word by word.

    Words end at ASCII white space and before punctuation that follows an ASCII letter or digit; the
    vocabulary's tokens never span either. Fresh words of letters alone are tokenised as one
    text: each then ends with its first token that closes a word, and if there are not as many
    such tokens as words, one by one like all others.
    """

    def __init__(self, tokenizer, settings: Settings):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one Spark task, one core
        self._tokenizer, self._settings = tokenizer, settings
        closing = [tokenizer.id_to_token(k) or "" for k in range(tokenizer.get_vocab_size())]
        self._closes = np.array([token.endswith("</w>") for token in closing])
        self._forget()

    def _forget(self) -> None:
        self._codes: dict[bytes, int] = {}
        self._ids = np.zeros(0, np.uint32)
        self._starts = np.zeros(1, np.int64)

    def _encoded(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return np.array([i for ids in found for i in ids], np.uint32), sizes

    def _letters(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids, _ = self._encoded([" ".join(texts)])
        ends = np.flatnonzero(self._closes[ids]) + 1
        if len(ends) != len(texts):
            return self._encoded(texts)
        return ids, np.diff(ends, prepend=0)

    def _learn(self, words: set[bytes]) -> None:
        if len(self._codes) + len(words) > self._settings.known_words:
            self._forget()
        fresh = words - self._codes.keys()
        texts = [word.decode("utf-8") for word in fresh]
        letters, others = [t for t in texts if t.isalpha()], [t for t in texts if not t.isalpha()]
        chunks = [self._letters(letters[k : k + 512]) for k in range(0, len(letters), 512)]
        chunks.append(self._encoded(others))
        for word in letters + others:
            self._codes[word.encode("utf-8")] = len(self._codes)
        sizes = np.concatenate([sizes for _, sizes in chunks])
        self._ids = np.concatenate([self._ids, *(ids for ids, _ in chunks)])
        self._starts = np.concatenate([self._starts, self._starts[-1] + np.cumsum(sizes)])

    @staticmethod
    def _words(text: bytes) -> list[bytes]:
        if b"<|" in text:  # may hold the strings of special tokens, which count as written
            return text.split()
        lower = text.lower()
        data = np.frombuffer(lower, np.uint8)
        cuts = np.flatnonzero(_PLAIN[data[:-1]] & _PUNCTUATION[data[1:]]) + 1
        return np.insert(data, cuts, 32).tobytes().split() if len(cuts) else lower.split()

    def of_texts(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids end to end, each text followed by the closing id, and how many precede each text."""
        split = [self._words(text) for text in texts]
        words = [word for some in split for word in some]
        self._learn(set(words))
        codes = np.fromiter(map(self._codes.__getitem__, words), np.int64, len(words))
        starts, sizes = self._starts[codes], np.diff(self._starts)[codes]
        counts = np.fromiter(map(len, split), np.int64, len(split))
        before = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(counts)])]
        bounds = before + np.arange(len(before))
        shift = starts - (np.cumsum(sizes) - sizes)
        plain = self._ids[np.repeat(shift, sizes) + np.arange(int(sizes.sum()))]
        return np.insert(plain, before[1:], np.uint32(self._settings.closing_id)), bounds


@lru_cache(maxsize=1)
def _word_ids(vocabulary: str, settings: Settings) -> WordIds:
    """One per Python worker: later tasks go on with the words it knows."""
    from tokenizers import Tokenizer

    return WordIds(Tokenizer.from_str(vocabulary), settings)


def pieces(docs: DataFrame, settings: Settings | None = None, keep_ids: bool = True) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` and, if wanted, ``ids`` for every piece."""
    settings = settings or Settings()
    spark = docs.sparkSession
    ship(spark)
    vocabulary = spark.sparkContext.broadcast(settings.vocabulary_text())
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        word_ids = _word_ids(vocabulary.value, settings)
        for batch in batches:
            doc_ids = batch.column("doc_id")
            for part in slices(batch.column("text")):
                owner, piece, start, length, crc, chunks = [], [], [], [], [], []
                data, bounds = part.data.tobytes(), part.bounds
                texts_here = [data[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                all_ids, firsts = word_ids.of_texts(texts_here)
                for k in range(part.size):
                    ids = all_ids[firsts[k] : firsts[k + 1]]
                    for number, at in enumerate(range(0, len(ids), settings.capacity)):
                        held = ids[at : at + settings.capacity].astype("<u4")
                        owner.append(part.first + k)
                        piece.append(number)
                        start.append(at)
                        length.append(len(held))
                        crc.append(zlib.crc32(held.tobytes()))
                        if keep_ids:
                            chunks.append(held)
                columns = [
                    doc_ids.take(pa.array(owner, pa.int64())),
                    pa.array(piece, pa.int32()),
                    pa.array(start, pa.int64()),
                    pa.array(length, pa.int64()),
                    pa.array(crc, pa.int64()),
                ]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if keep_ids:
                    ends = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(ends, np.concatenate(chunks).astype(np.int32)))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"doc_id {id_type}, piece int, start bigint, length bigint, ids_crc32 bigint"
    read = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return read.mapInArrow(run, schema + (", ids array<int>" if keep_ids else ""))


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """For each length (all below ``capacity``): the item that opened its bin, and its place there."""
    open_bins = np.zeros(capacity + 1, np.int64)
    named: list[list[int]] = [[] for _ in range(capacity + 1)]
    opener, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    none = np.iinfo(np.int64).max
    for item in np.argsort(-lengths, kind="stable"):
        size = int(lengths[item])
        there = open_bins[size:capacity]
        change = np.where(there > 0, 2 * (open_bins[: capacity - size] - there) + 2, none)
        if there[0]:
            change[0] = 1 - 2 * there[0]
        left = int(change.argmin())
        if change[left] == none:
            left, holder, gap = capacity - size, int(item), capacity
        else:
            gap = left + size
            holder = named[gap].pop()
            open_bins[gap] -= 1
        opener[item], offset[item] = holder, capacity - gap
        if left:
            open_bins[left] += 1
            named[left].append(holder)
    return opener, offset


def _packed_shards(items: DataFrame, rows: int, salt: int, settings: Settings) -> tuple[DataFrame, int]:
    """``items`` (``uid, length, ...``) with ``bin``, ``offset`` and the bin's ``level``; the shards."""
    shards = -(-max(rows, 1) // settings.shard_rows)
    keyed = items.withColumn("shard", F.pmod(F.xxhash64(F.lit(salt), "uid"), F.lit(shards)))

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by("uid")
        lengths, uid = table["length"].to_numpy(), table["uid"].to_numpy()
        opener, offset = sum_of_squares(lengths, settings.capacity)
        level = np.bincount(opener, lengths, len(lengths)).astype(np.int64)[opener]
        table = table.append_column("bin", pa.array(uid[opener]))
        table = table.append_column("offset", pa.array(offset))
        return table.append_column("level", pa.array(level)).drop_columns("shard")

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema.fields)
    schema = f"{fields}, bin bigint, offset bigint, level bigint"
    return keyed.groupBy("shard").applyInArrow(pack, schema), shards


def packed(found: DataFrame, settings: Settings | None = None, stages: Stages | None = None) -> DataFrame:
    """The rows of a piece table with ``sequence_id`` and ``offset``; ``uid`` must number them."""
    settings = settings or Settings()
    stages = stages or Stages(found.sparkSession)
    full = found.where(F.col("length") == settings.capacity)
    part = found.where(F.col("length") < settings.capacity)
    rows = part.count()
    first, shards = _packed_shards(part, rows, 0, settings)
    first = stages.write(first, "packed")
    current, moves, salt = first, None, 1
    while shards > 1:
        left = current.where((F.col("uid") == F.col("bin")) & (F.col("level") < settings.capacity))
        left = left.select("uid", F.col("level").alias("length"))
        rows = left.count()
        current, shards = _packed_shards(left, rows, salt, settings)
        current = stages.write(current, "repacked")
        step = current.where(F.col("offset") > 0).select(
            F.col("uid").alias("m_bin"), F.col("bin").alias("m_to"), F.col("offset").alias("m_by")
        )
        saved = step.count()
        moves = step if moves is None else _followed(moves, step)
        salt += 1
        if saved < settings.least_saving * rows:
            break
    whole = full.withColumn("sequence_id", F.col("uid")).withColumn("offset", F.lit(0).cast("long"))
    if moves is None:
        placed = first.withColumnRenamed("bin", "sequence_id").drop("level")
    else:
        kept = [F.col(c) for c in found.columns]
        placed = first.join(moves, F.col("bin") == F.col("m_bin"), "left").select(
            *kept,
            F.coalesce("m_to", "bin").alias("sequence_id"),
            (F.col("offset") + F.coalesce("m_by", F.lit(0))).alias("offset"),
        )
    return placed.unionByName(whole)


def _followed(moves: DataFrame, step: DataFrame) -> DataFrame:
    """Moves of earlier rounds, carried on by those of a later one, and the later ones themselves."""
    later = step.select(
        F.col("m_bin").alias("n_bin"), F.col("m_to").alias("n_to"), F.col("m_by").alias("n_by")
    )
    carried = moves.join(later, F.col("m_to") == F.col("n_bin"), "left").select(
        "m_bin",
        F.coalesce("n_to", "m_to").alias("m_to"),
        (F.col("m_by") + F.coalesce("n_by", F.lit(0))).alias("m_by"),
    )
    return carried.unionByName(step)


def _numbered_pieces(stages: Stages, docs: DataFrame, settings: Settings, keep_ids: bool) -> DataFrame:
    found = pieces(docs, settings, keep_ids).withColumn("uid", F.monotonically_increasing_id())
    return stages.write(found, "pieces")


def pack_report(docs: DataFrame, settings: Settings | None = None) -> DataFrame:
    """Where every piece of every document goes, with a checksum of its ids."""
    settings = settings or Settings()
    stages = Stages(docs.sparkSession)
    return packed(_numbered_pieces(stages, docs, settings, False), settings, stages).drop("uid")


def sequences(docs: DataFrame, settings: Settings | None = None) -> DataFrame:
    """``sequence_id, ids``: the packed sequences themselves; only numbers travel to be packed."""
    settings = settings or Settings()
    stages = Stages(docs.sparkSession)
    held = _numbered_pieces(stages, docs, settings, True)
    places = packed(held.select("uid", "length"), settings, stages).select(
        F.col("uid").alias("p_uid"), "sequence_id", "offset"
    )
    joined = held.join(places, F.col("uid") == F.col("p_uid"))
    in_order = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return joined.groupBy("sequence_id").agg(F.flatten(F.transform(in_order, lambda x: x["ids"])).alias("ids"))
