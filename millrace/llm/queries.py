"""The registered queries of the corpus operators, each over its whole table, and their SQL twins where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import (bpe, chat, chunks, decontaminate, hard_negatives, jaccard_join, language, line_rules, quality,
                          severity, token_counts, url_filter, vector_codes)
from millrace.llm.common import bounded
from millrace.session import read_table

URL_RULES = [
    ("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"), ("net", "/fr/", "block"),
]


def op1_quality_classifier(spark: SparkSession, root: str) -> DataFrame:
    return quality.classify(read_table(spark, root, "documents"))


def op2_token_counts(spark: SparkSession, root: str,
                     vocabulary: str = public_tokenizers.path("piece_bpe_32k.model")) -> DataFrame:
    return token_counts.count_tokens(read_table(spark, root, "documents"), token_counts.read_vocabulary(vocabulary))


def op3_ngram_jaccard_join(spark: SparkSession, root: str) -> DataFrame:
    return jaccard_join.join(read_table(spark, root, "documents"), 3, 9, 10, parts=3, spare=1).select(
        "doc_id", "n_shingles", "component_id", "n_links")


def op4_language_mixture(spark: SparkSession, root: str) -> DataFrame:
    docs = read_table(spark, root, "documents")
    train = docs.filter(F.col("doc_id").isNotNull() & ~language.held_out(F.col("doc_id")))
    return language.identify(docs, language.fit(train))


def op5_substring_dedup(spark: SparkSession, root: str) -> DataFrame:
    found = chunks.dedup(read_table(spark, root, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.col("_n_words").alias("n_words"), F.size("_spans").cast("long").alias("n_cut"),
                        F.col("_spans").alias("cut_spans"), F.sha2("text", 256).alias("text_sha256"), "text")


def op6_decontamination(spark: SparkSession, root: str) -> DataFrame:
    return decontaminate.report(read_table(spark, root, "documents"), read_table(spark, root, "benchmark"))


def op7_url_filter(spark: SparkSession, root: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, action string")
    return url_filter.judge(read_table(spark, root, "pages"), rules)


def op8_toxicity(spark: SparkSession, root: str) -> DataFrame:
    docs = read_table(spark, root, "documents")
    labels = read_table(spark, root, "labels").select("doc_id", F.col("toxic").alias("grade"))
    return severity.grade(docs, severity.fit(docs, labels, grades=3))


def op9_line_quality(spark: SparkSession, root: str) -> DataFrame:
    docs = read_table(spark, root, "documents")
    return line_rules.judge(docs, line_rules.fit(docs, read_table(spark, root, "labels")))


def op10_bpe(spark: SparkSession, root: str, path: str = public_tokenizers.path("word_bpe_49k.json")) -> DataFrame:
    return bpe.encode_documents(read_table(spark, root, "documents"), bpe.read_tokenizer(path), full=False)


def op11_vector_codes(spark: SparkSession, root: str) -> DataFrame:
    rows = read_table(spark, root, "embeddings")
    books = vector_codes.fit(rows)
    return vector_codes.with_label_errors(vector_codes.encode(rows, books)).select(
        "vec_id", F.lower(F.hex("codes")).alias("code"), "error", "label_error",
        F.lit(books.digest()).alias("codebooks_sha256"))


def op12_chat_formatting(spark: SparkSession, root: str) -> DataFrame:
    """The table's turns as an event log (answers streamed, regenerated once; others edited once), rebuilt, formatted, and
    read back."""
    turns = read_table(spark, root, "conversations").select(
        "conv_id", "turn", F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    more = turns.sparkSession.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(ODD_TEXT).alias("text"))
    done = chat.format_log(chat.log_of(turns.unionByName(more)))
    said = done.select("conv_id", "formatted", chat.read_turns(F.col("formatted")).alias("turns"),
                       chat.read_loss(F.col("segments")).alias("loss"))
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return said.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))


def op13_hard_negatives(spark: SparkSession, root: str) -> DataFrame:
    rows = read_table(spark, root, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long"))
    return hard_negatives.mine(rows.withColumn("label", moved))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    fn.__name__: bounded(fn) for fn in (
        op1_quality_classifier, op2_token_counts, op3_ngram_jaccard_join, op4_language_mixture, op5_substring_dedup,
        op6_decontamination, op7_url_filter, op8_toxicity, op9_line_quality, op10_bpe, op11_vector_codes,
        op12_chat_formatting, op13_hard_negatives)
}

ODD_TEXT = "\\### Assistant: </turn> ok"

_ASCII = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

# a part's nearest entry: distance and number in one number, so that the smallest has the lower number among equals
_NEAR = "256 * CAST(list_dot_product(x, x) + list_dot_product(c, c) - 2 * list_dot_product(x, c) AS BIGINT) + k"
_ROUND = f"""
        near{{i}} AS (SELECT vec_id, p, any_value(x) AS x, min({_NEAR}) % 256 AS k FROM parts JOIN book{{i}} USING (p) GROUP BY vec_id, p),
        mean{{i}} AS (SELECT p, k, nth, floor(sum(x[nth]) / count(*)) AS c FROM (
                        SELECT p, k, x, unnest(range(1, len(x) + 1)) AS nth FROM near{{i}}) GROUP BY p, k, nth),
        moved{{i}} AS (SELECT p, k, list(c ORDER BY nth) AS c FROM mean{{i}} GROUP BY p, k),
        book{{j}} AS MATERIALIZED (SELECT p, k, coalesce(m.c, b.c) AS c FROM book{{i}} b LEFT JOIN moved{{i}} m USING (p, k))"""

ORACLES: dict[str, str] = {
    "op3_ngram_jaccard_join": rf"""
        WITH RECURSIVE docs AS MATERIALIZED (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_ASCII}), '[^\x20\x09-\x0D]+') AS w
            FROM documents),
        sets AS MATERIALIZED (
            SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                ELSE list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)]) END AS s
            FROM docs),
        classes AS MATERIALIZED (
            SELECT min(doc_id) AS head, any_value(len(s)) AS n, list_sort(s) AS k, any_value(s) AS s
            FROM sets WHERE len(s) > 0 GROUP BY list_sort(s)),
        grams AS MATERIALIZED (SELECT head, n, unnest(s) AS g FROM classes),
        links AS MATERIALIZED (
            SELECT a.head AS u, b.head AS v FROM grams a JOIN grams b ON a.g = b.g AND a.head <> b.head
            GROUP BY a.head, b.head, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
        reach(u, v) AS (SELECT head, head FROM classes UNION SELECT r.u, l.v FROM reach r JOIN links l ON r.v = l.u),
        roots AS (SELECT u, min(v) AS root FROM reach GROUP BY u),
        degree AS (SELECT u, count(*) AS n_links FROM links GROUP BY u)
        SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, coalesce(r.root, s.doc_id) AS component_id,
               coalesce(d.n_links, 0) AS n_links
        FROM sets s LEFT JOIN classes c ON c.k = list_sort(s.s) LEFT JOIN roots r ON r.u = c.head
        LEFT JOIN degree d ON d.u = c.head""",
    "op6_decontamination": rf"""
        WITH pattern AS (SELECT '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+' AS p),
        docs AS MATERIALIZED (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_ASCII}), p) AS w FROM documents, pattern),
        items AS (
            SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), {_ASCII}), p) AS w FROM benchmark, pattern),
        windows AS MATERIALIZED (
            SELECT DISTINCT item_id, array_to_string(w[i:i + 12], ' ') AS x, least(len(w), 13) AS size
            FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 11, 2))) AS i FROM items WHERE len(w) > 0)),
        places AS (
            SELECT doc_id, i, size, array_to_string(w[i:i + size - 1], ' ') AS x
            FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM docs), (SELECT DISTINCT size FROM windows)
            WHERE i + size - 1 <= len(w)),
        found AS MATERIALIZED (SELECT doc_id, i, p.size, item_id FROM places p JOIN windows v ON p.x = v.x AND p.size = v.size),
        hits AS (SELECT doc_id, count(DISTINCT k) AS n_hit
                 FROM (SELECT doc_id, unnest(range(i, i + size)) AS k FROM found) GROUP BY doc_id),
        named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
                  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(ids, '')) AS items_sha256,
               coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
        FROM docs LEFT JOIN hits USING (doc_id) LEFT JOIN named USING (doc_id)""",
    "op11_vector_codes": f"""
        WITH kept AS MATERIALIZED (
            SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        parts AS MATERIALIZED (
            SELECT vec_id, label, p, v[p * len(v) // 4 + 1:(p + 1) * len(v) // 4] AS x FROM kept, range(4) t(p)),
        seeds AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS k FROM kept QUALIFY k < 256),
        book0 AS MATERIALIZED (SELECT p, k, x AS c FROM parts JOIN seeds USING (vec_id)),
        {",".join(_ROUND.format(i=i, j=i + 1) for i in range(4))},
        final AS MATERIALIZED (SELECT vec_id, label, p, min({_NEAR}) AS near FROM parts JOIN book4 USING (p) GROUP BY ALL),
        rows AS (SELECT vec_id, any_value(label) AS label,
                        string_agg(format('{{:02x}}', CAST(near % 256 AS BIGINT)), '' ORDER BY p) AS code,
                        CAST(sum(near // 256) AS BIGINT) AS error FROM final GROUP BY vec_id),
        digest AS (SELECT sha256(string_agg(array_to_string(list_transform(c, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ','),
                                            ',' ORDER BY p, k)) AS codebooks_sha256 FROM book4)
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
        FROM rows, digest""",
    "op12_chat_formatting": f"""
        WITH turns AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '{ODD_TEXT}' UNION ALL SELECT -7, 1, 'assistant', '{ODD_TEXT}')
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
               CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
               CAST(sum(17 + length(role || text) + length(regexp_replace(role || text, '[^<>\\\\]', '', 'g'))) AS BIGINT)
                   AS formatted_chars
        FROM turns GROUP BY conv_id""",
    "op13_hard_negatives": """
        WITH kept AS MATERIALIZED (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                   list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
            WHERE embedding IS NOT NULL AND label IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        scores AS MATERIALIZED (
            SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same,
                   CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
            FROM kept a JOIN kept b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
        positives AS (
            SELECT anchor_id, other AS positive_id, score AS positive_score FROM scores WHERE same
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
        SELECT anchor_id, positive_id,
               CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) AS INTEGER) AS rank,
               other AS negative_id, positive_score, score AS negative_score
        FROM positives JOIN scores USING (anchor_id)
        WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
        QUALIFY rank <= 3""",
}
