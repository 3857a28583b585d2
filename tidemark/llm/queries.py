"""The registered queries of this subpackage, each over its whole table, and their SQL where SQL can say it."""

from __future__ import annotations

from . import bpe, embedding_dedup, lines, packing, pii, sharding, simhash, substring, topk, toxicity

QUERIES = {
    "op1_embedding_near_dedup": embedding_dedup.op1,
    "op2_packing": packing.op2,
    "op3_pii": pii.op3,
    "op4_sharding": sharding.op4,
    "op5_exact_top_k": topk.op5,
    "op6_substring_dedup": substring.op6,
    "op7_simhash_near_dedup": simhash.op7,
    "op8_byte_level_bpe": bpe.op8,
    "op9_line_dedup": lines.op9,
    "op10_toxicity": toxicity.op10,
}

ORACLES = {
    "op1_embedding_near_dedup": """
        WITH RECURSIVE v AS (
            SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
            WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
              AND len(list_filter(embedding, lambda x: x <> 0)) > 0
        ), links AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b
              ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.93
        ), reach(a, b) AS (
            SELECT vec_id, vec_id FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
        ), least AS (SELECT a, min(b) AS c FROM reach GROUP BY a), counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
        SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, coalesce(c, vec_id) AS component_id, coalesce(c, vec_id) = vec_id AS kept
        FROM embeddings LEFT JOIN least ON vec_id = least.a LEFT JOIN counts ON vec_id = counts.a
    """,
    "op5_exact_top_k": """
        WITH q AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
            FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), scored AS (
            SELECT a.vec_id AS query_id, b.vec_id AS vec_id,
                   CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
            FROM q a JOIN q b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id
        ), ranked AS (
            SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
        )
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
    """,
    "op6_substring_dedup": r"""
        WITH words AS (
            SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
        ), windows AS (
            SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h
            FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM words WHERE len(w) >= 50)
        ), earliest AS (
            SELECT h, min(doc_id) AS first_id FROM windows GROUP BY h
        ), starts AS (
            SELECT doc_id, list(i) AS s FROM windows JOIN earliest USING (h) WHERE doc_id > first_id GROUP BY doc_id
        ), covered AS (
            SELECT doc_id, list(DISTINCT p) AS gone
            FROM (SELECT doc_id, unnest(range(i, i + 50)) AS p FROM (SELECT doc_id, unnest(s) AS i FROM starts)) GROUP BY doc_id
        ), numbered AS (
            SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM words
        ), gone AS (
            SELECT doc_id, unnest(gone) AS p FROM covered
        ), kept AS (
            SELECT n.doc_id, string_agg(n.word, ' ' ORDER BY n.p) AS t, count(*) AS n
            FROM numbered n ANTI JOIN gone g ON n.doc_id = g.doc_id AND n.p = g.p GROUP BY n.doc_id
        )
        SELECT words.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(kept.n, 0) AS BIGINT) AS n_removed,
               sha256(coalesce(kept.t, '')) AS kept_sha256
        FROM words LEFT JOIN kept ON words.doc_id = kept.doc_id
    """,
}
