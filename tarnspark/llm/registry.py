"""Queries of the training-data operators: each runs over its whole table with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnspark.llm import bpe, cube, fixity, knn, line_templates, near_dedup, order_minhash, pii, quality, tool_calls
from tarnspark.llm.common import table


def op1_boosted_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(table(spark, sf_dir, "documents")))


def op2_merkle_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return fixity.audit_warc(fixity.warc(pages), fixity.warc(fixity.damaged(pages)))


def op3_tool_call_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tool_calls.link(*tool_calls.from_conversations(table(spark, sf_dir, "conversations")), tool_calls.TURN_SCHEMAS)


def op4_block_matrix_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op5_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.fingerprint_documents(table(spark, sf_dir, "documents"))


def op6_template_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_templates.report(table(spark, sf_dir, "documents"))


def op7_cube_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cube.mix(table(spark, sf_dir, "documents"))


def op8_tensored_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), k=3, percent=85)


def op9_chunked_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), "byte_bpe_multi_50k.tiktoken", public_tokenizers.PATTERN, keep_ids=False)


def op10_weak_label_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scored(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_boosted_pii, op2_merkle_fixity, op3_tool_call_linking, op4_block_matrix_knn, op5_order_minhash, op6_template_tree, op7_cube_mix, op8_tensored_minhash, op9_chunked_bpe, op10_weak_label_quality)}

ORACLES: dict[str, str] = {
    "op2_merkle_fixity": """
        WITH r AS (
            SELECT page_id, url, CASE WHEN page_id % 101 = 13 THEN coalesce(html, '') || '?' ELSE html END AS html, 2 AS side
            FROM pages WHERE page_id IS NULL OR page_id % 211 <> 29
            UNION ALL SELECT -page_id - 1, url, html, 2 FROM pages WHERE page_id % 307 = 7
            UNION ALL SELECT page_id, url, html, 1 FROM pages),
        w AS (
            SELECT page_id, side, 'WARC/1.1' || e || 'WARC-Type: resource' || e || 'WARC-Record-ID: <urn:page:' || page_id || '>' || e || coalesce('WARC-Target-URI: ' || url || e, '')
                   || CASE WHEN html IS NULL THEN 'WARC-Truncated: unspecified' || e ELSE '' END || 'WARC-Payload-Digest: sha256:' || sha256(coalesce(html, '')) || e
                   || 'Content-Type: text/html' || e || 'Content-Length: ' || strlen(coalesce(html, '')) || e || e || coalesce(html, '') || e || e AS record
            FROM r, (SELECT chr(13) || chr(10) AS e)),
        h AS (
            SELECT page_id, side, sha256(strlen(record) || ':' || record) AS hash, CAST(strlen(record) AS BIGINT) AS byte_length,
                   CAST(sum(strlen(record)) OVER (PARTITION BY side ORDER BY page_id) - strlen(record) AS BIGINT) AS byte_offset FROM w),
        x AS (
            SELECT page_id, max(hash) FILTER (side = 1) AS a, max(hash) FILTER (side = 2) AS b, arg_min(byte_offset, side) AS byte_offset, arg_min(byte_length, side) AS byte_length FROM h GROUP BY page_id)
        SELECT page_id, CASE WHEN b IS NULL THEN 'missing' WHEN a IS NULL THEN 'extra' ELSE 'altered' END AS status,
               a AS primary_hash, b AS replica_hash, byte_offset, byte_length,
               CAST(floor(page_id / 256.0) AS BIGINT) * 256 AS range_start, CAST(floor(page_id / 256.0) AS BIGINT) * 256 + 256 AS range_end
        FROM x WHERE a IS DISTINCT FROM b
    """,
    "op3_tool_call_linking": """
        WITH c AS (
            SELECT conv_id, 'turn_' || turn AS call_id, turn, role AS name, text, coalesce(length(text), 0) % 13 AS k,
                   CASE WHEN turn >= 2 THEN 'turn_' || (turn - 2) END AS parent_id
            FROM conversations WHERE role <> 'assistant' OR role IS NULL),
        r AS (
            SELECT conv_id, 'turn_' || (turn - 1) AS call_id, turn AS result_turn, text AS result FROM conversations WHERE role = 'assistant'),
        up AS (
            WITH RECURSIVE w AS (
                SELECT c.conv_id, c.call_id, 0 AS depth FROM c LEFT JOIN c p ON c.conv_id = p.conv_id AND c.parent_id = p.call_id WHERE p.call_id IS NULL
                UNION ALL
                SELECT c.conv_id, c.call_id, w.depth + 1 FROM w JOIN c ON c.conv_id = w.conv_id AND c.parent_id = w.call_id)
            SELECT * FROM w),
        o AS (
            SELECT conv_id, call_id, depth, row_number() OVER (PARTITION BY conv_id ORDER BY depth, turn NULLS FIRST, call_id) AS position FROM c JOIN up USING (conv_id, call_id)),
        j AS (
            SELECT conv_id, call_id, o.depth, o.position, c.turn, c.name, c.text, c.k, c.parent_id, r.result_turn, r.result,
                   c.call_id IS NOT NULL AS called, r.call_id IS NOT NULL AS answered,
                   c.parent_id IS NOT NULL AND p.call_id IS NULL AS lost
            FROM c JOIN o USING (conv_id, call_id) LEFT JOIN (SELECT conv_id, call_id AS parent_id, call_id FROM c) p USING (conv_id, parent_id)
            FULL JOIN r USING (conv_id, call_id)),
        e AS (
            SELECT *, concat_ws(';',
                       CASE WHEN NOT called THEN NULL WHEN k = 5 THEN 'arguments:not object' WHEN name = 'system' THEN 'scope:missing' WHEN name <> 'user' THEN 'tool:unknown' END,
                       CASE WHEN called AND k <> 5 AND name IN ('user', 'system') AND text IS NULL THEN 'text:missing' END,
                       CASE WHEN k = 7 AND name IN ('user', 'system') THEN 'turn:not bigint' END,
                       CASE WHEN k = 9 AND name IN ('user', 'system') THEN 'more:unknown' END,
                       CASE WHEN lost THEN 'parent:missing' END) AS errors,
                   CASE WHEN called AND k <> 5 THEN '{' || CASE WHEN k = 9 THEN '"more":[100,2.5],' ELSE '' END || '"text":' || to_json(text)
                       || ',"turn":' || CASE WHEN k = 7 THEN '"' || turn || '"' ELSE '' || turn END || '}' END AS canonical FROM j)
        SELECT conv_id, call_id, CAST(depth AS BIGINT) AS depth, position, CAST(turn AS BIGINT) AS turn, name,
               CASE WHEN NOT called THEN 'orphan' WHEN k = 5 THEN 'bad_json' WHEN errors <> '' THEN 'invalid' WHEN NOT answered THEN 'unanswered' ELSE 'linked' END AS status,
               errors, canonical, CAST(result_turn AS BIGINT) AS result_turn, result,
               CAST(called AS BIGINT) AS n_calls, CAST(answered AS BIGINT) AS n_results,
               '{"arguments":' || coalesce(canonical, 'null') || ',"id":' || to_json(call_id) || ',"name":' || coalesce(to_json(name), 'null')
                   || ',"result":' || coalesce(to_json(result), 'null') || '}' AS message
        FROM e
    """,
    "op4_block_matrix_knn": """
        WITH v AS (
            SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len(embedding) > 0
              AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
              AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        d AS (
            SELECT q.vec_id AS query_id, c.vec_id,
                   sqrt(list_sum(list_transform(list_zip(q.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))) AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 100 = 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM d)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
    """,
    "op6_template_tree": r"""
        WITH l AS (
            SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line, unnest(string_split(text, chr(10))) AS s
            FROM documents WHERE text <> ''),
        v AS (SELECT doc_id, line, list_filter(regexp_split_to_array(s, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS raw FROM l),
        t AS (
            SELECT doc_id, line, len(raw) AS n,
                   CASE WHEN len(raw) < 3 AND len(list_filter(raw, lambda x: regexp_matches(x, '[0-9@]|^[a-z]+://'))) = len(raw) THEN raw
                        ELSE list_transform(raw, lambda x: CASE WHEN regexp_matches(x, '[0-9@]|^[a-z]+://') THEN '<*>' ELSE x END) END AS w
            FROM v WHERE len(raw) > 0),
        d AS (SELECT doc_id, sum(n) AS words, count(*) AS solid FROM t GROUP BY doc_id),
        k AS (
            SELECT doc_id, line, n, unnest(
                ['0 ' || n || ' ' || array_to_string(w, ' '), '2 ' || n || ' ' || array_to_string(w[1:3], ' '), '3 ' || n || ' ' || array_to_string(w[greatest(1, n - 2):], ' ')]
                || CASE WHEN n >= 12 THEN list_transform([0, 1, 2, 3], lambda j:
                        '1 ' || n || ' ' || j || ' ' || array_to_string(w[1:3 + (n - 3) * j // 4] || ['<gap>'] || w[4 + (n - 3) * (j + 1) // 4:], ' '))
                   WHEN n >= 6 THEN list_transform(range(2, n - 1), lambda i:
                        '1 ' || n || ' ' || i || ' ' || array_to_string(w[1:i] || ['<gap>'] || w[i + 3:], ' '))
                   ELSE [] END) AS key
            FROM t),
        c AS (SELECT key, count(DISTINCT doc_id) AS docs, min({'d': doc_id, 'l': line}) AS first FROM k GROUP BY key HAVING count(DISTINCT doc_id) > 1),
        h AS (
            SELECT k.*, docs, first, key[1] AS kind, doc_id = first.d AND line = first.l AS is_first,
                   CASE WHEN n >= 50 AND key[1] = '0' THEN 2 WHEN n >= 20 THEN 3 ELSE 8 END AS need FROM k JOIN c USING (key)),
        b AS (
            SELECT h.doc_id, words, line, n, arg_min(first.d, kind) AS f_doc FROM h JOIN d ON h.doc_id = d.doc_id
            WHERE kind IN ('2', '3') AND solid > 1 GROUP BY ALL),
        own AS (SELECT doc_id FROM b GROUP BY doc_id, words HAVING words - sum(n) < 8 OR words - sum(n) < 0.05 * words),
        m AS (SELECT doc_id, f_doc, row_number() OVER (PARTITION BY doc_id ORDER BY sum(n) DESC, f_doc) AS r FROM b SEMI JOIN own USING (doc_id) GROUP BY doc_id, f_doc),
        a AS (SELECT doc_id, f_doc AS copied FROM m WHERE r = 1),
        r AS (
            SELECT key FROM h LEFT JOIN a USING (doc_id) WHERE kind IN ('0', '1') AND docs >= need
            GROUP BY key, need HAVING count(DISTINCT coalesce(copied, doc_id)) >= need),
        x AS (
            SELECT doc_id, line FROM h LEFT JOIN r ON h.key = r.key WHERE kind IN ('0', '1')
            GROUP BY doc_id, line HAVING count(r.key) > 0 AND count(*) FILTER (is_first AND (kind = '0' OR r.key IS NOT NULL)) = 0),
        y AS (
            SELECT doc_id, count(*) AS n_lines, count(x.line) AS n_dropped,
                   coalesce(string_agg(s, chr(10) ORDER BY line) FILTER (x.line IS NULL), '') AS text
            FROM l LEFT JOIN x USING (doc_id, line) GROUP BY doc_id)
        SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped, coalesce(y.text, documents.text) AS text
        FROM documents LEFT JOIN y USING (doc_id)
    """,
    "op8_tensored_minhash": r"""
        WITH w AS (
            SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
            FROM documents),
        s AS (
            SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                                           ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s FROM w),
        n AS (SELECT doc_id, count(*) AS n, md5(string_agg(s, chr(10) ORDER BY s)) AS sig FROM s GROUP BY doc_id),
        c AS (SELECT sig, min(doc_id) AS rep, min(n) AS n FROM n GROUP BY sig),
        i AS (SELECT rep, n, s FROM c JOIN s ON rep = doc_id),
        p AS (
            SELECT x.rep AS a, y.rep AS b FROM i x JOIN i y ON x.s = y.s AND x.rep < y.rep AND 100 * least(x.n, y.n) >= 85 * greatest(x.n, y.n)
            GROUP BY x.rep, y.rep, x.n, y.n HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))),
        e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
        r AS (
            WITH RECURSIVE t AS (SELECT rep AS a, rep AS b FROM c UNION SELECT t.a, e.b FROM t JOIN e ON t.b = e.a)
            SELECT a AS rep, min(b) AS component_id FROM t GROUP BY a)
        SELECT documents.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(r.component_id, documents.doc_id) AS component_id,
               documents.doc_id = coalesce(r.component_id, documents.doc_id) AS kept, coalesce(c.rep, documents.doc_id) AS class_id
        FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN c USING (sig) LEFT JOIN r USING (rep)
    """,
}
