"""Registered queries of this subpackage: name -> (function, DuckDB SQL or None)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ann import nearest
from .chat import DEMO_SCHEMAS, calls_of_conversations, link_tool_calls
from .common import read_table
from .exact_dedup import exact_classes
from .lexical import lexical_ranking
from .mixing import mix_sources
from .packing import pack_documents
from .quality_rules import quality_verdicts
from .secrets import secret_report
from .simhash import near_duplicates
from .token_files import token_file_digest
from .tokens import public_vocabulary
from .toxicity import toxicity_scores
from .warc import archive_digest
from .whitening import whiten


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read_table(spark, sf_dir, "documents"), public_vocabulary())


def op2_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_tool_calls(*calls_of_conversations(read_table(spark, sf_dir, "conversations")), DEMO_SCHEMAS)


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_file_digest(read_table(spark, sf_dir, "documents"), public_vocabulary())


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_report(read_table(spark, sf_dir, "documents"))


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(read_table(spark, sf_dir, "documents"))


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_digest(read_table(spark, sf_dir, "pages"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_classes(read_table(spark, sf_dir, "documents"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_ranking(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(read_table(spark, sf_dir, "embeddings"))


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_verdicts(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


QUERIES = {
    "op2_tool_calls": op2_tool_calls,
    "op4_toxicity": op4_toxicity,
    "op7_nearest": op7_nearest,
    "op5_secrets": op5_secrets,
    "op6_mix_sources": op6_mix_sources,
    "op9_warc": op9_warc,
    "op1_best_fit_packing": op1_best_fit_packing,
    "op3_token_files": op3_token_files,
    "op8_simhash": op8_simhash,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_lexical_search": op11_lexical_search,
    "op12_whitening": op12_whitening,
    "op13_quality_rules": op13_quality_rules,
}

ORACLE_SQL = {
    "op2_tool_calls": """
        WITH RECURSIVE t AS (
            SELECT conv_id, turn, role, coalesce(text, '') AS content, length(coalesce(text, '')) AS size FROM conversations
        ), calls AS (
            SELECT conv_id, turn, content, size, concat('call_', turn) AS call_id,
                   CASE size % 4 WHEN 0 THEN 'search' WHEN 1 THEN 'summarise' WHEN 2 THEN 'translate' ELSE 'archive' END AS name
            FROM t WHERE role = 'user'
        ), depths AS (
            SELECT conv_id, turn, 0 AS depth FROM calls AS c
            WHERE NOT EXISTS (SELECT 1 FROM calls AS b WHERE b.conv_id = c.conv_id AND b.turn = c.turn - 2)
            UNION ALL
            SELECT c.conv_id, c.turn, d.depth + 1 FROM depths AS d JOIN calls AS c ON c.conv_id = d.conv_id AND c.turn = d.turn + 2
        ), results AS (
            SELECT conv_id, turn, content, concat('call_', turn - 1) AS call_id FROM t WHERE role = 'assistant'
        )
        SELECT c.conv_id, d.depth * 2 AS level, c.turn, 'call' AS kind, c.call_id,
               CASE WHEN EXISTS (SELECT 1 FROM results AS r WHERE r.conv_id = c.conv_id AND r.call_id = c.call_id)
                    THEN 'linked' ELSE 'unanswered' END AS status,
               CASE c.name
                    WHEN 'archive' THEN 'unknown tool'
                    WHEN 'search' THEN concat_ws(',', CASE WHEN c.size = 0 OR c.size > 250 THEN 'query out of range' END,
                        CASE WHEN c.size % 60 NOT BETWEEN 1 AND 50 THEN 'limit out of range' END,
                        CASE WHEN c.size % 3 = 0 THEN 'unexpected lang' END)
                    WHEN 'summarise' THEN concat_ws(',', CASE WHEN c.size < 20 THEN 'query out of range' END,
                        CASE WHEN c.size % 60 NOT BETWEEN 5 AND 40 THEN 'limit out of range' END,
                        CASE WHEN c.size % 3 = 0 THEN 'unexpected lang' END)
                    ELSE concat_ws(',', CASE WHEN c.size = 0 THEN 'query out of range' END,
                        CASE WHEN c.size % 3 <> 0 THEN 'lang missing' END, 'unexpected limit')
               END AS errors,
               concat('{"arguments":{', CASE WHEN c.size % 3 = 0 THEN '"lang":"en",' ELSE '' END, '"limit":', c.size % 60,
                      ',"query":', CAST(to_json(c.content) AS VARCHAR), '},"id":"', c.call_id, '","name":"', c.name, '","type":"tool_call"}') AS json
        FROM calls AS c JOIN depths AS d ON d.conv_id = c.conv_id AND d.turn = c.turn
        UNION ALL
        SELECT r.conv_id, coalesce(d.depth * 2 + 1, 0), r.turn, 'result', r.call_id,
               CASE WHEN d.depth IS NULL THEN 'orphan' ELSE 'linked' END, '',
               concat('{"content":', CAST(to_json(r.content) AS VARCHAR), ',"id":"', r.call_id, '","type":"tool_result"}')
        FROM results AS r LEFT JOIN depths AS d ON d.conv_id = r.conv_id AND d.turn = r.turn - 1
        UNION ALL
        SELECT conv_id, 0, turn, 'message', NULL, 'plain', '',
               concat('{"content":', CAST(to_json(content) AS VARCHAR), ',"role":', CAST(to_json(coalesce(role, '')) AS VARCHAR), ',"type":"message"}')
        FROM t WHERE role IS NULL OR role NOT IN ('user', 'assistant')
    """,
    "op6_mix_sources": """
        WITH masses AS (
            SELECT source, sum(coalesce(length(text), 0)) AS mass FROM documents GROUP BY source
        ), weighed AS (
            SELECT source, mass, sqrt(mass) AS weight FROM masses
        ), rates AS (
            SELECT source, CASE WHEN mass > 0 THEN weight / (SELECT sum(weight) FROM weighed)
                   * (SELECT sum(mass) FROM weighed) / mass ELSE 1.0 END AS rate
            FROM weighed
        ), steps AS (
            SELECT source, rate / greatest(ceil(rate / 16), 1) AS mean, CAST(greatest(ceil(rate / 16), 1) AS BIGINT) AS n
            FROM rates
        ), terms AS (
            SELECT source, n, k, sum(exp(k * ln(mean) - mean - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS below
            FROM steps, (SELECT unnest(range(100)) AS k) AS ks
        ), draws AS (
            SELECT d.doc_id, d.source, j.j,
                   CAST(concat('0x', substr(md5(concat(d.doc_id, ':', j.j, ':mix')), 1, 13)) AS BIGINT) / 4503599627370496.0 AS u
            FROM documents AS d JOIN steps AS s ON d.source IS NOT DISTINCT FROM s.source
            JOIN (SELECT unnest(range(1, 200)) AS j) AS j ON j.j <= s.n
        ), counts AS (
            SELECT r.doc_id, count(*) AS copies
            FROM draws AS r JOIN terms AS t ON r.source IS NOT DISTINCT FROM t.source AND t.below <= r.u
            GROUP BY r.doc_id
        ), copied AS (
            SELECT doc_id, copies, unnest(range(copies)) AS copy FROM counts
        )
        SELECT d.*, c.copy, c.copies,
               CAST(concat('0x', substr(md5(concat(c.doc_id, ':', c.copy, ':mix:order')), 1, 13)) AS BIGINT) / 4503599627370496.0
               AS shuffle_key
        FROM documents AS d JOIN copied AS c ON d.doc_id = c.doc_id
    """,
    "op9_warc": """
        SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, payload_digest,
               CASE WHEN page_id = max(page_id) OVER w THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id < max(page_id) OVER w THEN max(page_id) OVER w END AS refers_to
        FROM (
            SELECT *, (SELECT string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(
                (CAST(concat('0x', substr(sha1(coalesce(html, '')), 1 + 5 * (i // 4), 5)) AS BIGINT)
                 // CAST(power(32, 3 - i % 4) AS BIGINT)) % 32 AS INTEGER), 1), '' ORDER BY i)
                FROM (SELECT unnest(range(32)) AS i) AS digits) AS payload_digest
            FROM pages
        ) AS p
        WINDOW w AS (PARTITION BY coalesce(html, ''))
    """,
    "op10_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
    """,
    "op11_lexical_search": r"""
        WITH items AS (
            SELECT item_id, term, count(*) AS times
            FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                         '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) AS i
            GROUP BY item_id, term
        ), words AS (
            SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                   '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents
        ), counts AS (
            SELECT doc_id, term, count(*) AS tf FROM words GROUP BY doc_id, term
        ), sizes AS (
            SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM counts GROUP BY doc_id
        ), totals AS (
            SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM sizes
        ), weights AS (
            SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM counts, totals GROUP BY term, n_docs
        ), scores AS (
            SELECT i.item_id, c.doc_id,
                   sum(i.times * w.w * ((1000000000 * c.tf) // (1000 * c.tf + 12 * (75 + (25 * s.n * t.n_docs) // t.n_terms)))) AS score
            FROM items AS i JOIN counts AS c ON c.term = i.term JOIN weights AS w ON w.term = i.term JOIN sizes AS s ON s.doc_id = c.doc_id, totals AS t
            GROUP BY i.item_id, c.doc_id
        )
        SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, CAST(score AS BIGINT) AS score
        FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0) AS r
        WHERE rank <= 20
    """,
}
