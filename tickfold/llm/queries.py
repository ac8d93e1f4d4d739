"""The operators on the given tables, and the same answers in SQL where it can."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickfold.llm import (
    chat,
    exact_dedup,
    lines,
    near_dedup,
    negatives,
    packing,
    pieces,
    pii,
    quality,
    spelling,
    toxicity,
    urls,
    vectors,
)
from tickfold.llm.common import table


def op1_quality(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return quality.quality(docs, quality.train(docs, table(spark, d, "labels"))).drop("_row")


def op2_packing(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(table(spark, d, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op3_exact_dedup(spark: SparkSession, d: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, d, "documents")).drop("_row")


def op4_chat(spark: SparkSession, d: str) -> DataFrame:
    return chat.format_chats(table(spark, d, "conversations"))


def op5_near_vectors(spark: SparkSession, d: str) -> DataFrame:
    return vectors.near_vectors(table(spark, d, "embeddings"))


def op6_url_filter(spark: SparkSession, d: str) -> DataFrame:
    weights = urls.train(spark.createDataFrame(urls.SEEDS, "url string, label int"))
    return urls.filter_urls(table(spark, d, "pages"), weights)


def op7_toxicity(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return toxicity.score_texts(docs, toxicity.learn(docs, table(spark, d, "labels")))


def op8_pii(spark: SparkSession, d: str) -> DataFrame:
    return pii.scan(table(spark, d, "documents"))


def op9_near_dedup(spark: SparkSession, d: str) -> DataFrame:
    return near_dedup.near_dedup(table(spark, d, "documents")).drop("_row")


def op10_pieces(spark: SparkSession, d: str) -> DataFrame:
    return pieces.encode(table(spark, d, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op11_negatives(spark: SparkSession, d: str) -> DataFrame:
    # Whole steps of 1/256; what is null or not finite stays null.
    steps = F.transform("embedding", lambda x: 256 * F.when(F.abs(x) < float("inf"), x.cast("double")))
    whole = F.transform(steps, lambda y: F.when(F.abs(y) < 2.0**53, F.floor(y).cast("double")).otherwise(y))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, d, "embeddings").select(
        F.col("vec_id").alias("id"), label.alias("label"), whole.alias("v")
    )
    return negatives.hard_negatives(rows, F.col("id") % 100 == 0)


def op12_lines(spark: SparkSession, d: str) -> DataFrame:
    return lines.drop_repeated_lines(table(spark, d, "documents")).drop("kept_text")


def op13_spelling(spark: SparkSession, d: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, d, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality, op2_packing, op3_exact_dedup, op4_chat, op5_near_vectors,
        op6_url_filter, op7_toxicity, op8_pii, op9_near_dedup, op10_pieces,
        op11_negatives, op12_lines, op13_spelling,
    )
}

SQL = {
    "op3_exact_dedup": r"""
        WITH t AS (
            SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body
            FROM documents
        )
        SELECT doc_id,
               min(doc_id) OVER same AS keep_id,
               count(*) OVER same AS group_size,
               doc_id = min(doc_id) OVER same AS kept,
               sha256(body) AS text_sha256
        FROM t WINDOW same AS (PARTITION BY body)
    """,
    "op4_chat": r"""
        WITH turns AS (
            SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
            FROM conversations
        ), placed AS (
            SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS k,
                   count(*) OVER (PARTITION BY conv_id) AS n
            FROM turns
        ), prefixes AS (
            SELECT conv_id, k, n,
                   list({'role': role, 'text': text}) OVER (PARTITION BY conv_id ORDER BY k) AS said
            FROM placed
        ), whole AS (
            SELECT min(conv_id) AS conv_id, count(*) AS n_copies, n, said
            FROM prefixes WHERE k = n GROUP BY n, said
        ), proper AS (
            SELECT DISTINCT k, said FROM prefixes WHERE k < n
        )
        SELECT conv_id, CAST(0 AS INTEGER) AS part, n AS n_turns, n_copies,
               array_to_string(['<|im_start|>' || s.role || chr(10)
                   || replace(s.text, '<|im_', '< |im_') || '<|im_end|>' || chr(10) for s in said], '') AS text
        FROM whole
        WHERE NOT EXISTS (SELECT 1 FROM proper p WHERE p.k = whole.n AND p.said = whole.said)
    """,
    "op11_negatives": r"""
        WITH v AS (
            SELECT vec_id,
                   CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                   list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
            FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), scored AS (
            SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
                   CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
            FROM v a JOIN v b ON a.vec_id <> b.vec_id
            WHERE a.vec_id % 100 = 0
        ), positives AS (
            SELECT anchor_id, other_id AS positive_id, score AS positive_score
            FROM scored WHERE same
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
        )
        SELECT anchor_id, positive_id,
               CAST(row_number() OVER best AS INTEGER) AS rank,
               other_id AS negative_id, positive_score, score AS negative_score
        FROM positives JOIN scored USING (anchor_id)
        WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
        WINDOW best AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id)
        QUALIFY row_number() OVER best <= 10
    """,
    "op12_lines": r"""
        WITH split AS (
            SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS all_lines FROM documents
        ), l AS (
            SELECT doc_id, unnest(all_lines) AS line, generate_subscripts(all_lines, 1) AS i FROM split
        ), keyed AS (
            SELECT *, translate(
                regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
            FROM l
        ), repeated AS (
            SELECT key, max(doc_id) AS keep_id FROM keyed WHERE length(key) >= 20
            GROUP BY key HAVING count(DISTINCT doc_id) >= 3
        ), judged AS (
            SELECT doc_id, line, i, coalesce(keep_id <> doc_id, false) AS gone
            FROM keyed LEFT JOIN repeated USING (key)
        )
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
        FROM judged GROUP BY doc_id
    """,
    "op13_spelling": r"""
        WITH RECURSIVE steps AS (
            SELECT list_transform(range(256), lambda b: list_reduce(list_concat([b], range(8)),
                lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t
        ), runs AS (
            SELECT doc_id, run, count(*) AS n FROM (
                SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''),
                    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                    '[a-z\x{00C0}-\x{00FF}]+')) AS run
                FROM documents
            ) GROUP BY ALL
        ), bytes AS (
            SELECT run, n, hex(encode(CAST(doc_id AS VARCHAR) || ':' || run)) AS x FROM runs WHERE length(run) >= 7
        ), hashed AS (
            SELECT run, n, xor(4294967295, list_reduce(
                list_concat([4294967295], list_transform(range(len(x) // 2),
                    lambda j: CAST('0x' || substr(x, CAST(2 * j + 1 AS INTEGER), 2) AS BIGINT))),
                lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) AS h
            FROM bytes, steps
        ), altered AS (
            SELECT n, CASE WHEN h % 31 = 0
                THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word
            FROM hashed
        ), words AS (
            SELECT word, CAST(sum(n) AS BIGINT) AS n FROM altered
            WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2
        ), places AS (
            SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words
        ), masked AS (
            SELECT word, n, i, substr(word, 1, i - 1) || '?' || substr(word, i + 1) AS mask FROM places
        ), shorter AS (
            SELECT DISTINCT word, n, substr(word, 1, i - 1) || substr(word, i + 1) AS other FROM places
        ), near AS (
            SELECT a.word, b.word AS other, b.n AS other_n
            FROM masked a JOIN masked b ON a.mask = b.mask AND a.word <> b.word
            UNION ALL
            SELECT s.word, w.word, w.n FROM shorter s JOIN words w ON s.other = w.word
            UNION ALL
            SELECT w.word, s.word, s.n FROM shorter s JOIN words w ON s.other = w.word
        ), best AS (
            SELECT word, count(*) AS n_near, min({'less': -other_n, 'form': other}) AS b FROM near GROUP BY word
        ), forms AS (
            SELECT word, n, coalesce(n_near, 0) AS n_near,
                   CASE WHEN -b.less >= 10 * n THEN b.form END AS form,
                   CASE WHEN -b.less >= 10 * n THEN -b.less END AS form_n
            FROM words LEFT JOIN best USING (word)
        ), ways AS (
            SELECT word, word AS root FROM forms
            UNION ALL
            SELECT ways.word, f.form FROM ways JOIN forms f ON f.word = ways.root WHERE f.form IS NOT NULL
        )
        SELECT f.word, f.form, ways.root, f.n, f.n_near, f.form_n
        FROM forms f JOIN ways ON ways.word = f.word
        JOIN forms last ON last.word = ways.root AND last.form IS NULL
    """,
}
