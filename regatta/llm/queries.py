"""Queries of the operators over whole tables, with SQL where it can state the same rows."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regatta.llm import (
    html_blocks,
    language_id,
    near_vectors,
    packing,
    piece_codec,
    pii,
    quality_rules,
    secrets,
    simhash,
    token_alignment,
    token_counts,
    vector_codes,
    warc_index,
)
from regatta.llm.common import read

TOKENIZER = "word_bpe_49k.json"
BYTE_TOKENIZER = "byte_bpe_50k.json"


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge_documents(
        read(spark, sf_dir, "documents", "doc_id", "text"),
        read(spark, sf_dir, "labels", "doc_id", "quality"),
    )
    return judged.select("doc_id", *quality_rules.BASE, "base_failed", "kept", "rule")


def op2_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors.near_duplicate_vectors(read(spark, sf_dir, "embeddings", "vec_id", "embedding"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(read(spark, sf_dir, "documents", "doc_id", "text"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    model = public_tokenizers.path("piece_bpe_32k.model")
    return piece_codec.encode_documents(docs, model).drop("ids")


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(read(spark, sf_dir, "documents", "doc_id", "text"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every capture from the index; ids divisible by 20 are also looked up, ``looked_up`` if found and sound."""
    pages = read(spark, sf_dir, "pages", "page_id", "url", "html")
    archives, index = warc_index.archive_pages(pages)
    asked = pages.where(F.col("page_id") % 20 == 0).select("page_id", "url")
    answers = warc_index.look_up(spark, archives, index, warc_index.directory_of(index), asked)
    found = answers.groupBy("page_id").agg(F.every("sound").alias("_sound"))
    rows = warc_index.read_index(spark, index).join(found, "page_id", "left")
    return rows.select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key",
        F.coalesce("_sound", F.lit(False)).alias("looked_up"),
    )


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    return packing.pack_documents(docs, public_tokenizers.path(TOKENIZER))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language_id.identify(read(spark, sf_dir, "documents", "doc_id", "text", "lang"))
    return found.select(
        "doc_id", language_id.is_held_out(F.col("doc_id")).alias("held_out"),
        F.col("_llm_pred").alias("lang_pred"), F.col("_llm_score").alias("score"),
    )


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = simhash.near_duplicate_classes(read(spark, sf_dir, "documents", "doc_id", "text"))
    return classes.select(
        "doc_id", simhash.hex_of(F.col("fp")).alias("fingerprint"),
        F.col("rep")["doc_id"].alias("component_id"),
    )


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = html_blocks.extract(read(spark, sf_dir, "pages", "page_id", "url", "html"), to="text")
    return pages.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.code_report(read(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    paths = public_tokenizers.path(BYTE_TOKENIZER), public_tokenizers.path("piece_bpe_32k.model")
    return token_alignment.alignment_report(docs, *paths)


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    return token_counts.count_tokens(docs, public_tokenizers.path(BYTE_TOKENIZER))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_quality_rules, op2_near_vectors, op3_pii, op4_sentencepiece, op5_secrets, op6_warc, op7_packing,
        op8_language_id, op9_simhash, op10_html, op11_vector_codes, op12_token_alignment, op13_token_counts,
    )
}


def _op11_round(n: int) -> str:
    """SQL of the assignment to book ``n`` (distance and entry in one number) and of the book behind it."""
    return f"""
near{n} AS (
    SELECT p.row, p.part, min(64 * list_sum([
        (p.v[i] - b.v[i]) * (p.v[i] - b.v[i]) FOR i IN range(1, len(p.v) + 1)
    ])::BIGINT + b.entry) AS best
    FROM parts p JOIN book{n} b USING (part) GROUP BY p.row, p.part
),
mean{n} AS (
    SELECT part, entry, list(mean ORDER BY i) AS v FROM (
        SELECT part, entry, i, floor(sum(x) / count(*))::BIGINT AS mean FROM (
            SELECT p.part, n.best % 64 AS entry, unnest(p.v) AS x, unnest(range(1, len(p.v) + 1)) AS i
            FROM parts p JOIN near{n} n USING (row, part)
        ) GROUP BY part, entry, i
    ) GROUP BY part, entry
),
book{n + 1} AS (
    SELECT part, entry, coalesce(m.v, b.v) AS v FROM book{n} b LEFT JOIN mean{n} m USING (part, entry)
)"""


OP11_SQL = f"""
WITH kept AS (
    SELECT vec_id, label, [floor(256 * x::DOUBLE)::BIGINT FOR x IN embedding] AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
),
ranked AS (SELECT *, row_number() OVER (ORDER BY vec_id, v) AS row FROM kept),
parts AS (
    SELECT row, part, v[part * (len(v) // 16) + 1 : (part + 1) * (len(v) // 16)] AS v
    FROM ranked, range(16) t(part)
),
book0 AS (SELECT part, row - 1 AS entry, v FROM parts WHERE row <= 64),
{_op11_round(0)},
{_op11_round(1)},
last AS (
    SELECT p.row, p.part, min(64 * list_sum([
        (p.v[i] - b.v[i]) * (p.v[i] - b.v[i]) FOR i IN range(1, len(p.v) + 1)
    ])::BIGINT + b.entry) AS best
    FROM parts p JOIN book2 b USING (part) GROUP BY p.row, p.part
),
coded AS (
    SELECT row, string_agg(format('{{:02x}}', best % 64), '' ORDER BY part) AS code,
           sum(best // 64)::BIGINT AS error
    FROM last GROUP BY row
),
books AS (
    SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) AS digest FROM book2
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
       digest AS codebooks_sha256
FROM ranked JOIN coded USING (row), books
"""

# The bits of a SHA-1, five to a letter; hosts in reverse without "www.", then path and sorted query.
OP6_SQL = """
WITH rows AS (
    SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS payload FROM pages
),
digests AS (
    SELECT payload, array_to_string([
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[
            (('0x' || sha1(payload)[5 * (i // 4) + 1 : 5 * (i // 4) + 5])::BIGINT >> (15 - 5 * (i % 4))) % 32 + 1
        ] FOR i IN range(32)], '') AS digest, min(page_id) AS first
    FROM rows GROUP BY payload
),
parts AS (
    SELECT page_id, payload,
           regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]*)', 1)), '^www[.]', '') AS host,
           regexp_extract(url, '^[A-Za-z]+://[^/?#:]*:([0-9]+)', 1) AS port,
           lower(rtrim(regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), '/')) AS path,
           lower(regexp_extract(url, '[?]([^#]*)', 1)) AS query
    FROM rows
)
SELECT page_id, octet_length(encode(payload))::BIGINT AS payload_bytes, digest AS payload_digest,
       CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to,
       array_to_string(list_reverse(string_split(host, '.')), ',')
       || CASE WHEN port IN ('', '80', '443') THEN '' ELSE ':' || port END || ')'
       || CASE WHEN path = '' THEN '/' ELSE path END
       || CASE WHEN query = '' THEN '' ELSE '?' || array_to_string(list_sort(string_split(query, '&')), '&') END
       AS url_key,
       page_id % 20 = 0 AS looked_up
FROM parts JOIN digests USING (payload)
"""

OP2_SQL = """
WITH RECURSIVE good AS MATERIALIZED (
    SELECT vec_id, v, sqrt(list_sum([x * x FOR x IN v])) AS length
    FROM (
        SELECT vec_id, CASE WHEN len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
                            THEN embedding::DOUBLE[] END AS v
        FROM embeddings WHERE embedding IS NOT NULL
    ) WHERE v IS NOT NULL AND list_sum([x * x FOR x IN v]) > 0
),
links AS MATERIALIZED (
    SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.vec_id <> b.vec_id
    WHERE list_dot_product(a.v, b.v) / (a.length * b.length) >= 0.95
),
reach AS (
    SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b
),
least_of AS (SELECT a, min(b) AS least FROM reach GROUP BY a),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, least(vec_id, coalesce(least, vec_id)) AS component_id,
       least(vec_id, coalesce(least, vec_id)) = vec_id AS kept
FROM embeddings LEFT JOIN counts c ON c.a = vec_id LEFT JOIN least_of l ON l.a = vec_id
"""

ORACLES: dict[str, str] = {"op2_near_vectors": OP2_SQL, "op6_warc": OP6_SQL, "op11_vector_codes": OP11_SQL}
