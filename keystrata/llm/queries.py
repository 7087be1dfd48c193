"""The queries of the training-data operators: each applies its operator to its whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from keystrata.llm import htmltext, kdsearch, langid, mixing, mixlm, neardup, packing, passages, secrets, webp_lossless
from keystrata.llm.common import table


def op1_webp_lossless(spark, sf_dir):
    return webp_lossless.store_and_read(table(spark, sf_dir, "documents"))


def op2_kd_topk(spark, sf_dir):
    return kdsearch.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op3_near_duplicates(spark, sf_dir):
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op4_secret_scan(spark, sf_dir):
    return secrets.scan(table(spark, sf_dir, "documents"))


def op5_mix(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents"))


def op6_pack(spark, sf_dir):
    import public_tokenizers

    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op7_repeated_passages(spark, sf_dir):
    return passages.remove_repeats(table(spark, sf_dir, "documents"))


def op8_html_text(spark, sf_dir):
    return htmltext.extract(table(spark, sf_dir, "pages"))


def op9_context_mixing_score(spark, sf_dir):
    return mixlm.score_documents(table(spark, sf_dir, "documents"))


def op10_language_id(spark, sf_dir):
    return langid.identify(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_webp_lossless": op1_webp_lossless,
    "op2_kd_topk": op2_kd_topk,
    "op3_near_duplicates": op3_near_duplicates,
    "op4_secret_scan": op4_secret_scan,
    "op5_mix": op5_mix,
    "op6_pack": op6_pack,
    "op7_repeated_passages": op7_repeated_passages,
    "op8_html_text": op8_html_text,
    "op9_context_mixing_score": op9_context_mixing_score,
    "op10_language_id": op10_language_id,
}

ORACLE_SQL: dict[str, str] = {
    "op2_kd_topk": """
WITH v AS (
    SELECT vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE) FOR x IN embedding] AS e
    FROM embeddings
    WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
    SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
    FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e)
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10""",
    "op3_near_duplicates": r"""
WITH RECURSIVE w AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
    FROM documents
), s AS (
    SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (
    SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
), e AS (
    SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * common >= 75 * (a.n + b.n - common)
), r AS (
    SELECT doc_id AS node, doc_id AS reach FROM documents
    UNION
    SELECT r.node, l.y FROM r JOIN (SELECT x, y FROM e UNION ALL SELECT y, x FROM e) l ON r.reach = l.x
)
SELECT d.doc_id, coalesce(max(n.n), 0) AS n_shingles, min(reach) AS component_id, d.doc_id = min(reach) AS kept
FROM documents d JOIN r ON d.doc_id = r.node LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id""",
    "op5_mix": r"""
WITH d AS (
    SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
        CAST('0x' || md5(CAST(doc_id AS VARCHAR))[1:15] AS BIGINT) AS h
    FROM documents
), a AS (
    SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS code FROM d GROUP BY source
), b AS (
    SELECT *, CAST([5, 2, 1][code % 3 + 1] AS DOUBLE) AS w, 2.0 * source_size AS cap, 1.5 * sum(source_size) OVER () AS wanted FROM a
), c AS (
    SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / w, code ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cap_before,
        sum(w) OVER (ORDER BY cap / w, code ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_from
    FROM b
), f AS (SELECT *, CAST((wanted - cap_before) / w_from AS DOUBLE) AS own FROM c),
t AS (
    SELECT code, source, source_size,
        coalesce(least(CAST(cap AS DOUBLE), (SELECT own FROM f WHERE own * w <= cap ORDER BY cap / w, code LIMIT 1) * w), cap) AS target
    FROM f
), u AS (
    SELECT *, CAST(round(sum(target) OVER (ORDER BY code) / sum(target) OVER () * 2147483648) AS BIGINT) AS high FROM t
), v AS (SELECT *, coalesce(lag(high) OVER (ORDER BY code), 0) AS low FROM u),
j AS (
    SELECT (i % 2147483648 * 1327217885) % 2147483648 AS point
    FROM range(CAST((SELECT ceil(sum(size) * 1.5 / 64) FROM d) AS BIGINT)) g(i)
), k AS (SELECT code, count(*) AS slots FROM v JOIN j ON point >= low AND point < high GROUP BY code),
o AS (
    SELECT doc_id, size, v.code, v.source_size, v.target, sum(size) OVER (PARTITION BY v.code
        ORDER BY (h >> 8) % greatest(64, (SELECT count(*) FROM d) // 1000), h, doc_id, size) - size AS start
    FROM d JOIN v ON d.source IS NOT DISTINCT FROM v.source
)
SELECT doc_id, size, source_size, target, CAST(greatest(0, least(start + size, coalesce(slots, 0) * 64) - start)
    + greatest(0, least(start + source_size + size, coalesce(slots, 0) * 64) - start - source_size) AS BIGINT) AS taken
FROM o LEFT JOIN k ON o.code = k.code""",
    "op7_repeated_passages": r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
p AS (
    SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w WHERE len(ws) > 12)
), f AS (SELECT g, min(doc_id) AS first FROM p GROUP BY g),
c AS (SELECT DISTINCT doc_id, i + k AS j FROM p JOIN f ON p.g = f.g AND f.first < p.doc_id CROSS JOIN range(13) r(k)),
x AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS j, unnest(ws) AS word FROM w),
y AS (
    SELECT x.doc_id, count(*) AS n_words, count(c.j) AS n_removed, string_agg(word, ' ' ORDER BY x.j) FILTER (c.j IS NULL) AS kept
    FROM x LEFT JOIN c ON c.doc_id = x.doc_id AND c.j = x.j GROUP BY x.doc_id
)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN y ON y.doc_id = d.doc_id""",
}
