"""The registered queries of this package and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from shelfmetrics.llm import (
    decontaminate,
    embeddings,
    language,
    lines,
    minhash,
    periods,
    substrings,
    surrogates,
)
from shelfmetrics.llm.mixing import mix_report
from shelfmetrics.llm.packing import pack_report
from shelfmetrics.llm.quality import classify
from shelfmetrics.llm.trie import trie_report
from shelfmetrics.llm.warc import archive_report


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_embeddings(spark: SparkSession, folder: str) -> DataFrame:
    return embeddings.similar_vectors(_table(spark, folder, "embeddings"))


#: Where a deployment puts the key of its surrogates; the invented test data needs no secret.
SURROGATE_KEY = "spark.shelfmetrics.surrogates.key"


def op2_surrogates(spark: SparkSession, folder: str) -> DataFrame:
    key = spark.conf.get(SURROGATE_KEY, "key for invented data")
    return surrogates.pseudonymise(_table(spark, folder, "documents"), key.encode("utf-8"))


def op3_lines(spark: SparkSession, folder: str) -> DataFrame:
    return lines.line_report(_table(spark, folder, "documents"))


def op4_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.report(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def op5_quality(spark: SparkSession, folder: str) -> DataFrame:
    return classify(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op6_mixing(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mix_report(_table(spark, folder, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies")


def op7_substrings(spark: SparkSession, folder: str) -> DataFrame:
    return substrings.remove_repeats(_table(spark, folder, "documents")).drop("kept")


def op8_language(spark: SparkSession, folder: str) -> DataFrame:
    return language.identify(_table(spark, folder, "documents"))


def op9_warc(spark: SparkSession, folder: str) -> DataFrame:
    return archive_report(_table(spark, folder, "pages"))


def op10_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, folder, "documents"), minhash.Settings(width=2))


def op11_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack_report(_table(spark, folder, "documents"))


def op12_periods(spark: SparkSession, folder: str) -> DataFrame:
    return periods.run_report(_table(spark, folder, "documents"), periods.rebuilt)


def op13_trie(spark: SparkSession, folder: str) -> DataFrame:
    return trie_report(_table(spark, folder, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_embeddings": op1_embeddings,
    "op2_surrogates": op2_surrogates,
    "op3_lines": op3_lines,
    "op4_decontaminate": op4_decontaminate,
    "op5_quality": op5_quality,
    "op6_mixing": op6_mixing,
    "op7_substrings": op7_substrings,
    "op8_language": op8_language,
    "op9_warc": op9_warc,
    "op10_minhash": op10_minhash,
    "op11_packing": op11_packing,
    "op12_periods": op12_periods,
    "op13_trie": op13_trie,
}

WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"

PLAIN_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+')"
FIVE_WORDS = """CASE
    WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END"""

ORACLE_SQL: dict[str, str] = {
    "op1_embeddings": """
        WITH RECURSIVE vectors AS (
            SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
            WHERE len(embedding) > 0
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), usable AS (
            SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS norm FROM vectors
            WHERE list_dot_product(e, e) > 0
        ), links AS (
            SELECT x.vec_id AS a, y.vec_id AS b
            FROM usable x JOIN usable y ON x.vec_id <> y.vec_id AND len(x.e) = len(y.e)
            WHERE list_dot_product(x.e, y.e) / (x.norm * y.norm) >= 0.9
        ), reach AS (
            SELECT vec_id AS a, vec_id AS b FROM embeddings
            UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
        ), least_reached AS (
            SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a
        ), counts AS (
            SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a
        )
        SELECT vec_id, coalesce(n, 0) AS n_links, component_id, component_id = vec_id AS kept
        FROM embeddings JOIN least_reached USING (vec_id) LEFT JOIN counts USING (vec_id)
    """,
    "op4_decontaminate": f"""
        WITH item_words AS (
            SELECT DISTINCT item_id, text, {PLAIN_WORDS} AS w FROM benchmark
        ), item_shingles AS (
            SELECT DISTINCT item_id, unnest({FIVE_WORDS}) AS s FROM item_words
        ), item_sizes AS (
            SELECT item_id, count(*) AS n_item FROM item_shingles GROUP BY item_id
        ), doc_words AS (
            SELECT doc_id, {PLAIN_WORDS} AS w FROM documents
        ), doc_shingles AS (
            SELECT DISTINCT doc_id, unnest({FIVE_WORDS}) AS s FROM doc_words
        )
        SELECT doc_id, item_id, count(*) AS n_shared, n_item, count(*) / n_item AS containment
        FROM doc_shingles JOIN item_shingles USING (s) JOIN item_sizes USING (item_id)
        GROUP BY doc_id, item_id, n_item
        HAVING 100 * count(*) >= 80 * n_item
    """,
    "op10_minhash": f"""
        WITH RECURSIVE words AS (
            SELECT doc_id, {WORDS} AS w FROM documents
        ), shingles AS (
            SELECT DISTINCT doc_id, unnest(CASE
                WHEN len(w) >= 2 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])
                WHEN len(w) = 1 THEN w ELSE [] END) AS s
            FROM words
        ), sizes AS (
            SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
        ), keys AS (
            SELECT s, row_number() OVER (ORDER BY count(*), s) AS rank FROM shingles GROUP BY s
        ), numbered AS (
            SELECT doc_id, rank, n, row_number() OVER (PARTITION BY doc_id ORDER BY rank) AS place
            FROM shingles JOIN keys USING (s) JOIN sizes USING (doc_id)
        ), heads AS (
            SELECT * FROM numbered WHERE place <= n - ceil(0.8 * n) + 1
        ), candidates AS (
            SELECT DISTINCT x.doc_id AS a, y.doc_id AS b, x.n AS na, y.n AS nb
            FROM heads x JOIN heads y ON x.rank = y.rank AND x.doc_id < y.doc_id
            WHERE 100 * least(x.n, y.n) >= 80 * greatest(x.n, y.n)
        ), links AS (
            SELECT a, b FROM candidates
            JOIN numbered x ON x.doc_id = a JOIN numbered y ON y.doc_id = b AND x.rank = y.rank
            GROUP BY a, b, na, nb HAVING 100 * count(*) >= 80 * (na + nb - count(*))
        ), both_ways AS (
            SELECT a, b FROM links UNION ALL SELECT b, a FROM links
        ), reach AS (
            SELECT doc_id AS a, doc_id AS b FROM documents
            UNION SELECT reach.a, both_ways.b FROM reach JOIN both_ways ON reach.b = both_ways.a
        ), least_reached AS (
            SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a
        )
        SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, component_id = doc_id AS kept
        FROM documents JOIN least_reached USING (doc_id) LEFT JOIN sizes USING (doc_id)
    """,
    "op13_trie": """
        WITH own AS (
            SELECT conv_id, list({'role': r, 'text': t} ORDER BY turn NULLS FIRST, r, t) AS turns
            FROM (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations)
            WHERE conv_id IS NOT NULL GROUP BY conv_id
        ), hashed AS (
            SELECT conv_id, turns, xor(4294967295, list_reduce(
                list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT),
                lambda crc, byte: list_reduce(range(8), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)), xor(crc, byte)),
                4294967295::BIGINT)) % 9 AS h
            FROM own
        ), rebuilt AS (
            SELECT own.conv_id, list_concat(coalesce(base.turns[1:own.h], []), own.turns[own.h + 1:]) AS turns
            FROM hashed AS own LEFT JOIN hashed AS base ON base.conv_id = own.conv_id - own.conv_id % 5
        ), prefixes AS (
            SELECT conv_id, turns[1:depth] AS path, depth, depth = len(turns) AS ends
            FROM (SELECT conv_id, turns, unnest(range(len(turns) + 1)) AS depth FROM rebuilt)
        ), nodes AS (
            SELECT path, depth, path[1:depth - 1] AS parent, min(conv_id) AS conv_id, count(*) AS n_convs,
                   sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
            FROM prefixes GROUP BY path, depth
        ), children AS (
            SELECT parent AS path, depth - 1 AS depth, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL
        ), counted AS (
            SELECT nodes.*, coalesce(n_children, 0) AS n_children,
                   CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) * octet_length(encode(path[depth].text)) END AS saved
            FROM nodes LEFT JOIN children USING (path, depth)
        ), above AS (
            SELECT path[1:top] AS path, top AS depth, (n_children = 0)::INT AS leaf, saved
            FROM (SELECT *, unnest(range(depth + 1)) AS top FROM counted)
        ), subtrees AS (
            SELECT path, depth, sum(leaf)::BIGINT AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM above GROUP BY ALL
        )
        SELECT x.conv_id, x.depth, up.conv_id AS parent_conv_id, x.n_convs, x.n_children, n_leaves, saved_tokens,
               x.ends_sha256
        FROM counted AS x JOIN subtrees USING (path, depth)
        LEFT JOIN nodes AS up ON x.depth > 0 AND up.depth = x.depth - 1 AND up.path = x.parent
    """,
    "op9_warc": """
        WITH payloads AS (
            SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes,
                   sha1(coalesce(html, '')) AS payload_digest
            FROM pages
        ), shared AS (
            SELECT payload_digest AS digest, max(page_id) AS response
            FROM payloads WHERE payload_bytes >= 1000
            GROUP BY payload_digest
        )
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN response <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN response <> page_id THEN response END AS refers_to
        FROM payloads LEFT JOIN shared ON payload_digest = digest AND payload_bytes >= 1000
    """,
}
