"""The registered queries of the subpackage and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, divergence, edit_embedding, filter_audit, html_text, lm, mixing, near_vectors, ngram_join, quality, top_k, url_filter, warc
from .common import read

#: Capture time of the given pages, which carry none.
WARC_DATE = "2024-01-01T00:00:00Z"
TOKENIZER_FILE = "byte_bpe_50k.tiktoken"

#: Verdict and site of the list rules.
SITES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER_FILE)


def op1_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k.top_k(read(spark, sf_dir, "embeddings"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(read(spark, sf_dir, "documents"), tokenizer_path())


def op3_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(read(spark, sf_dir, "documents"))


def op4_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.scores(read(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.groups(read(spark, sf_dir, "documents"))


def op7_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    responses = warc.responses(read(spark, sf_dir, "pages"), WARC_DATE)
    return warc.derivatives(responses)


def op8_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors.near_duplicates(read(spark, sf_dir, "embeddings"))


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(read(spark, sf_dir, "pages"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(read(spark, sf_dir, "pages"), SITES)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op12_edit_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_embedding.neighbours(read(spark, sf_dir, "documents"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_top_k": op1_top_k,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_mix": op3_mix,
    "op4_lm_scores": op4_lm_scores,
    "op5_quality": op5_quality,
    "op6_ngram_join": op6_ngram_join,
    "op7_warc_derivatives": op7_warc_derivatives,
    "op8_near_vectors": op8_near_vectors,
    "op9_main_text": op9_main_text,
    "op10_url_filter": op10_url_filter,
    "op11_filter_audit": op11_filter_audit,
    "op12_edit_fingerprints": op12_edit_fingerprints,
    "op13_source_divergence": op13_source_divergence,
}

_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_WORDS = "|".join(url_filter.UNWANTED)

ORACLE: dict[str, str] = {
    "op1_top_k": """
WITH v AS (SELECT vec_id, min(embedding) AS e FROM embeddings WHERE embedding IS NOT NULL GROUP BY vec_id),
c AS (SELECT vec_id, generate_subscripts(e, 1) AS i, CAST(floor(1024 * CAST(unnest(e) AS DOUBLE)) AS BIGINT) AS x FROM v),
s AS (SELECT q.vec_id AS query_id, p.vec_id, CAST(sum(q.x * p.x) AS BIGINT) AS score
  FROM c q JOIN c p ON q.i = p.i AND q.vec_id <> p.vec_id WHERE q.vec_id % 100 = 0 GROUP BY 1, 2),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""",
    "op6_ngram_join": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS t FROM documents),
s AS (SELECT doc_id, CASE WHEN len(t) = 0 THEN [] WHEN len(t) < 5 THEN [array_to_string(t, ' ')]
  ELSE list_distinct([array_to_string(t[i:i + 4], ' ') FOR i IN range(1, len(t) - 3)]) END AS g FROM w),
e AS (SELECT doc_id, len(g) AS n, unnest(g) AS x FROM s),
p AS (SELECT a.doc_id AS x, b.doc_id AS y FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n
  HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
reach AS (SELECT doc_id AS x, doc_id AS y FROM s UNION SELECT r.x, p.y FROM reach r JOIN p ON r.y = p.x),
c AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x)
SELECT s.doc_id, len(g) AS n_shingles, component_id FROM s JOIN c ON s.doc_id = c.x""",
    "op8_near_vectors": """
WITH RECURSIVE v AS (SELECT vec_id, min(embedding)::DOUBLE[] AS e FROM embeddings GROUP BY vec_id),
g AS (SELECT * FROM v WHERE e IS NOT NULL AND list_sum(e) IS NOT NULL AND list_dot_product(e, e) > 0),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM g a JOIN g b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95),
reach AS (SELECT vec_id AS x, vec_id AS y FROM v UNION SELECT r.x, l.y FROM reach r JOIN l ON r.y = l.x),
c AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x),
n AS (SELECT x, count(*) AS n_links FROM l GROUP BY x)
SELECT v.vec_id, coalesce(n_links, 0) AS n_links, component_id, component_id = v.vec_id AS kept
FROM v JOIN c ON v.vec_id = c.x LEFT JOIN n ON v.vec_id = n.x""",
    "op10_url_filter": f"""
WITH rest AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
raw AS (SELECT page_id, r, regexp_extract(r, '^[^/?#]*') AS h FROM rest),
parts AS (SELECT page_id, translate(h, {_LOWER}) AS host, regexp_extract(substr(r, length(h) + 1), '^[^?#]*') AS path FROM raw),
ruled AS (SELECT *, CASE
  WHEN ends_with('.' || host, '.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
  WHEN ends_with('.' || host, '.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
  WHEN ends_with('.' || host, '.net') AND starts_with(path, '/es/') THEN 'net/es/'
  WHEN ends_with('.' || host, '.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
  WHEN ends_with('.' || host, '.com') AND starts_with(path, '/') THEN 'com/' END AS rule,
  (SELECT min(w) FROM unnest({list(url_filter.UNWANTED)}) AS t(w) WHERE regexp_matches(host, '(^|[^a-z0-9])' || w || '([^a-z0-9]|$)')) AS word FROM parts)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL OR word IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict,
  CASE WHEN rule IS NULL THEN word END AS reason FROM ruled""",
    "op11_filter_audit": r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY t) AS first FROM d),
x AS (SELECT part, (len(w) < 50)::INT + 2 * (100 * list_unique(w) < 65 * len(w))::INT
    + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t))::INT + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(doc_id > first, false)::INT AS mask,
  doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND doc_id IS NOT NULL) AS good, doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id IS NOT NULL) AS toxic FROM w),
m AS (SELECT part, mask, count(*) AS n, count(*) FILTER (WHERE good) AS g, count(*) FILTER (WHERE toxic) AS x FROM x GROUP BY ALL),
f AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(l, bit)),
o AS (SELECT a.l || b.l || c.l || d.l || e.l AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits FROM f a, f b, f c, f d, f e
  WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5),
s AS (SELECT filter_order, i AS step, bits[i] AS bit, CAST(coalesce(list_sum(bits[1:i - 1]), 0) AS INT) AS before FROM o, range(1, 6) r(i)),
c AS (SELECT part, filter_order, CAST(step AS INT) AS step, bit, coalesce(sum(n) FILTER (WHERE mask & (before | bit) = 0), 0) AS kept,
  coalesce(sum(n) FILTER (WHERE mask & bit > 0 AND mask & before = 0), 0) AS removed, coalesce(sum(n) FILTER (WHERE mask & bit > 0 AND mask & before > 0), 0) AS redundant,
  coalesce(sum(n) FILTER (WHERE mask = bit), 0) AS unique_fails, coalesce(sum(g) FILTER (WHERE mask & bit > 0 AND mask & before = 0), 0) AS good_lost,
  coalesce(sum(x) FILTER (WHERE mask & bit > 0 AND mask & before = 0), 0) AS toxic_lost FROM m, s GROUP BY ALL)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
  good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM c""",
    "op13_source_divergence": r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS t FROM documents),
k AS (SELECT r, lang, source, translate(unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d),
l AS (SELECT lang, term, count(*)::HUGEINT AS c FROM k GROUP BY ALL HAVING count(DISTINCT r) >= 3),
n AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM k SEMI JOIN l USING (lang, term) GROUP BY ALL),
v AS (SELECT lang, count(*)::HUGEINT AS v, sum(c)::HUGEINT AS nl FROM l GROUP BY lang),
g AS (SELECT x.lang, x.source, coalesce(any_value(v.v), 0) AS v, coalesce(any_value(v.nl), 0) AS nl, coalesce(sum(n.n), 0)::HUGEINT AS ng
  FROM (SELECT DISTINCT lang, source FROM d) x LEFT JOIN v USING (lang) LEFT JOIN n ON n.lang = x.lang AND n.source = x.source GROUP BY ALL),
p AS (SELECT g.lang, g.source, l.term, coalesce(n.n, 0) AS n, 1 + (1000000000 * (coalesce(n.n, 0) + 1)) // (ng + g.v) AS p, 1 + (1000000000 * (l.c + 1)) // (nl + g.v) AS q
  FROM g JOIN l USING (lang) LEFT JOIN n ON n.lang = g.lang AND n.source = g.source AND n.term = l.term),
pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(any_value(s.value), 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // y.p) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) s
  ON s.lang = a.lang AND s.source = a.source AND s.item = b.source GROUP BY ALL),
term AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // q)::BIGINT AS value FROM p WHERE n > 0 AND p > q),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank FROM (SELECT * FROM pair UNION ALL SELECT * FROM term))
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 200""",
}
