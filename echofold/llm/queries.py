"""The queries of this package, for registration by name."""

from __future__ import annotations

from echofold.llm.bpe import op8_chunk_reuse_bpe
from echofold.llm.hard_negatives import op13_blocked_gemm_negatives
from echofold.llm.language_id import op7_evidence_fusion_language_id
from echofold.llm.media import op2_netpbm_media
from echofold.llm.minhash import op4_circulant_minhash
from echofold.llm.mixing import op3_block_source_mixing
from echofold.llm.periodic_runs import op12_block_match_runs
from echofold.llm.piece_merges import op11_score_agenda_sentencepiece
from echofold.llm.quality_model import op5_random_indexing_quality
from echofold.llm.quality_rules import op6_suffix_array_repetition
from echofold.llm.sharding import op1_balanced_label_propagation
from echofold.llm.substring_dedup import op10_run_length_substring_dedup
from echofold.llm.url_filter import op9_link_graph_url_filter

QUERIES = {
    f.__name__: f
    for f in (
        op1_balanced_label_propagation,
        op2_netpbm_media,
        op3_block_source_mixing,
        op4_circulant_minhash,
        op5_random_indexing_quality,
        op6_suffix_array_repetition,
        op7_evidence_fusion_language_id,
        op8_chunk_reuse_bpe,
        op9_link_graph_url_filter,
        op10_run_length_substring_dedup,
        op11_score_agenda_sentencepiece,
        op12_block_match_runs,
        op13_blocked_gemm_negatives,
    )
}
#: Walks of 120 steps, by when 0.85 to that power is below 1e-8.
_LINK = r"""(?i)<a\s[^>]*href\s*=\s*["'']?[a-z][a-z0-9+.-]*://([^/?#"''\s>]+)"""
_RULES = """CASE WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/' WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/' WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/' WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END"""
_OP9 = f"""WITH RECURSIVE p AS (SELECT page_id, html, coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host, coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
r AS (SELECT page_id, html, host, path, {_RULES} AS rule FROM p), v AS (SELECT *, CASE rule WHEN 'net/' THEN 'block' WHEN 'example.com/de/' THEN 'block' WHEN 'example.net/en/' THEN 'allow' WHEN 'org/fr/' THEN 'allow' END AS by_rule FROM r),
s AS (SELECT host, count(*) AS pages, CAST(count(*) FILTER (by_rule = 'allow') AS DOUBLE) AS trust, CAST(count(*) FILTER (by_rule = 'block') AS DOUBLE) AS distrust FROM v GROUP BY 1),
l AS (SELECT host AS src, translate(unnest(regexp_extract_all(html, '{_LINK}', 1)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS dst FROM v UNION ALL SELECT DISTINCT host, regexp_replace(host, '^[^.]*[.]', '') FROM v WHERE contains(host, '.')),
e AS (SELECT src, dst, count(*) AS n FROM l WHERE src <> dst AND src <> '' AND dst <> '' GROUP BY 1, 2), w AS (SELECT src, dst, n / sum(n) OVER (PARTITION BY src) AS w FROM e),
b AS MATERIALIZED (SELECT src AS a, dst AS z, w AS f, w / sum(w) OVER (PARTITION BY dst) AS g FROM w),
t AS MATERIALIZED (SELECT host, trust, distrust FROM s),
walk AS (SELECT 0 AS step, host, trust, distrust FROM t UNION ALL SELECT step, host, sum(trust), sum(distrust) FROM (
 SELECT k.step + 1 AS step, b.z AS host, 0.85 * k.trust * b.f AS trust, 0.0 AS distrust FROM walk k JOIN b ON b.a = k.host WHERE k.step < 120
 UNION ALL SELECT k.step + 1, b.a, 0.0, 0.85 * k.distrust * b.g FROM walk k JOIN b ON b.z = k.host WHERE k.step < 120
 UNION ALL SELECT k.step + 1, t.host, 0.15 * t.trust, 0.15 * t.distrust FROM (SELECT DISTINCT step FROM walk WHERE step < 120) k, t) GROUP BY 1, 2),
q AS (SELECT host, trust * (SELECT sum(trust) FROM t) / nullif((SELECT sum(trust) FROM walk WHERE step = 120), 0) AS trust, distrust * (SELECT sum(distrust) FROM t) / nullif((SELECT sum(distrust) FROM walk WHERE step = 120), 0) AS distrust FROM walk WHERE step = 120)
SELECT v.page_id, v.host, v.path, v.rule, coalesce(v.by_rule, CASE WHEN round(coalesce(q.distrust, 0) - coalesce(q.trust, 0), 6) > 0.25 * s.pages THEN 'block' ELSE 'allow' END) AS verdict FROM v JOIN s ON s.host = v.host LEFT JOIN q ON q.host = v.host"""


def _covered(k: int) -> str:
    """Words in windows of k words that occur twice or more in a text."""
    windows = f"SELECT doc_id, i, md5(array_to_string(ws[i:i + {k} - 1], ' ')) AS h FROM w, LATERAL (SELECT unnest(range(1, len(ws) - {k} + 2)) AS i) WHERE len(ws) >= {k}"
    starts = f"SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, h) AS m FROM ({windows})) WHERE m > 1"
    return f"c{k} AS (SELECT doc_id, sum(least({k}, coalesce(nxt - i, {k}))) AS n FROM ({starts}) GROUP BY 1)"


_OP6 = f"""WITH w AS (SELECT row_number() OVER () AS doc_id, doc_id AS id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
{_covered(8)}, {_covered(5)}, {_covered(101)}, b AS (SELECT doc_id, id, len(ws) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
 list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM w),
m AS (SELECT b.*, len(ls) - len(list_distinct(ls)) AS n_dup_lines, CAST(coalesce(c8.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(c5.n, 0) AS BIGINT) AS n_span_words, c101.n IS NOT NULL AS long FROM b LEFT JOIN c8 USING (doc_id) LEFT JOIN c5 USING (doc_id) LEFT JOIN c101 USING (doc_id)),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m) SELECT id AS doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND n_span_words <= 0.3 * n_words AND NOT long AS kept, n_span_words FROM f"""
#: Each anchor with every other row, then windows of ranks.
_OP13 = """WITH r AS (SELECT row_number() OVER () AS rid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.rid, a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score FROM r a JOIN r b ON b.vec_id <> a.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT rid, anchor_id, id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY rid ORDER BY score DESC, id) AS k FROM s WHERE same QUALIFY k <= 5),
n AS (SELECT p.anchor_id, p.positive_id, p.positive_score, s.id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.rid, p.k ORDER BY s.score DESC, s.id) AS rank FROM p JOIN s ON s.rid = p.rid AND NOT s.same AND 80 * p.positive_score <= 100 * s.score AND s.score <= p.positive_score QUALIFY rank <= 5)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n"""
ORACLE_SQL: dict[str, str] = {"op13_blocked_gemm_negatives": _OP13, "op9_link_graph_url_filter": _OP9, "op6_suffix_array_repetition": _OP6}
