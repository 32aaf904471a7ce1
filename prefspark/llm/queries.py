"""The registered queries of this folder: each operator on its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prefspark.llm.bpe_automaton import codec_digests
from prefspark.llm.common import table
from prefspark.llm.conversation_repair import damaged_and_repaired
from prefspark.llm.elias_fano import token_file_index
from prefspark.llm.importance import resample
from prefspark.llm.kd_search import top_inner_products
from prefspark.llm.kmeans_tree import nearest
from prefspark.llm.lm_score import lm_scores
from prefspark.llm.mixing import mix_sources
from prefspark.llm.ngram_join import ngram_join
from prefspark.llm.quality import fit_quality, quality_scores
from prefspark.llm.substring_dedup import substring_dedup
from prefspark.llm.suffix_dedup import suffix_dedup
from prefspark.llm.token_counts import token_counts

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query of this folder."""

    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


@query(
    "op1_substring_dedup",
    r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\v\f\r]+'), lambda x: x <> '') AS ws
  FROM documents),
windows AS (
  SELECT doc_id, s, md5(array_to_string(list_slice(ws, s, s + 19), ' ')) AS h
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS s FROM w)),
earliest AS (SELECT h, min(doc_id) AS d, arg_min(s, (doc_id, s)) AS s FROM windows GROUP BY h),
covered AS (
  SELECT DISTINCT w.doc_id, unnest(range(w.s, w.s + 20)) AS p
  FROM windows w JOIN earliest e ON e.h = w.h WHERE e.d < w.doc_id OR e.d = w.doc_id AND e.s < w.s),
gone AS (SELECT doc_id, list(p) AS ps FROM covered GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(len(ps), 0)::BIGINT AS n_removed,
  sha256(array_to_string(CASE WHEN ps IS NULL THEN ws ELSE
    list_transform(list_filter(list_zip(ws, range(1, len(ws) + 1)), lambda x: NOT list_contains(ps, x[2])), lambda x: x[1]) END, ' '))
    AS kept_sha256
FROM w LEFT JOIN gone g ON g.doc_id = w.doc_id""",
)
def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"))


@query("op3_token_counts")
def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))


@query("op6_token_files")
def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_file_index(table(spark, sf_dir, "documents"))


@query("op9_bpe_codec")
def op9_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codec_digests(table(spark, sf_dir, "documents"))


@query(
    "op10_ngram_join",
    r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\v\f\r]+'), lambda x: x <> '') AS ws
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, md5(array_to_string(list_slice(ws, p, p + 3), ' ')) AS g
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 2))) AS p FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (
  SELECT x, y FROM shared JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * i >= 85 * (a.n + b.n - i)),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM reach r JOIN link l ON l.x = r.y)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id
JOIN (SELECT x, min(y) AS component_id FROM reach GROUP BY x) c ON c.x = d.doc_id""",
)
def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents"))


@query("op4_quality_classifier")
def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_scores(docs, fit_quality(docs, table(spark, sf_dir, "labels")))


@query("op5_mix_sources")
def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


@query("op7_nearest_neighbours")
def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))


@query(
    "op8_top_inner_products",
    """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.q::DOUBLE[], b.q::DOUBLE[])::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p)
WHERE rank <= 5""",
)
def op8_top_inner_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_inner_products(table(spark, sf_dir, "embeddings"))


@query(
    "op2_lm_scores",
    r"""
WITH RECURSIVE w AS (
  SELECT *, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\v\f\r]+'), lambda x: x <> '') AS ws
  FROM (SELECT 0 AS target, doc_id AS id, text FROM documents UNION ALL SELECT 1, row_number() OVER (), text FROM benchmark)),
token AS (SELECT target, id, p, ws[p] AS word, CASE WHEN p > 1 THEN ws[p - 1] END AS before
  FROM (SELECT *, unnest(range(1, len(ws) + 1)) AS p FROM w)),
counts AS (SELECT word, sum(target) AS t, sum(1 - target) AS b FROM token GROUP BY word),
vocabulary AS (SELECT * FROM counts),
total AS (SELECT sum(t)::DOUBLE AS t, sum(b)::DOUBLE AS b FROM counts),
start AS (SELECT sum(target)::DOUBLE AS t, sum(1 - target)::DOUBLE AS b FROM w WHERE len(ws) > 0),
unigram AS (
  SELECT word, t::DOUBLE AS t, b::DOUBLE AS b FROM vocabulary
  UNION ALL SELECT ' other', (SELECT t FROM total) - sum(t), (SELECT b FROM total) - sum(b) FROM vocabulary
  UNION ALL SELECT ' start', t, b FROM start),
gram AS (
  SELECT k.target, k.id, CASE WHEN k.p = 1 THEN ' start' ELSE coalesce(x.word, ' other') END AS before,
    coalesce(y.word, ' other') AS word
  FROM token k LEFT JOIN vocabulary x ON x.word = k.before LEFT JOIN vocabulary y ON y.word = k.word),
pair AS (SELECT before, word, sum(target)::DOUBLE AS t, sum(1 - target)::DOUBLE AS b FROM gram GROUP BY ALL),
loss AS (
  SELECT p.before, p.word,
    ln(CASE WHEN h.b > 0 THEN 0.7e0 * p.b / h.b ELSE 0e0 END + 0.29e0 * u.b / greatest(n.b, 1e0) + 0.01e0 / s.n)
    - ln(CASE WHEN h.t > 0 THEN 0.7e0 * p.t / h.t ELSE 0e0 END + 0.29e0 * u.t / greatest(n.t, 1e0) + 0.01e0 / s.n) AS d
  FROM pair p JOIN unigram h ON h.word = p.before JOIN unigram u ON u.word = p.word, total n,
    (SELECT count(*) + 1 AS n FROM vocabulary) s)
SELECT w.id AS doc_id, len(w.ws)::BIGINT AS n_words, round(l.score, 6) + 0e0 AS score
FROM w LEFT JOIN (
  SELECT g.id, avg(l.d) AS score FROM gram g JOIN loss l ON l.before = g.before AND l.word = g.word
  WHERE g.target = 0 GROUP BY g.id) l ON l.id = w.id
WHERE w.target = 0""",
)
def op2_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lm_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), vocabulary=None)
    return scored.withColumn("score", F.round("score", 6) + F.lit(0.0))


@query("op11_importance_resampling")
def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query(
    "op12_suffix_dedup",
    r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
windows AS (
  SELECT doc_id, s, md5(substr(x, 2 * s + 1, 400)) AS h
  FROM (SELECT doc_id, x, unnest(range(0, len(x) // 2 - 199)) AS s FROM d)),
twice AS (SELECT h FROM windows GROUP BY h HAVING count(*) > 1),
covered AS (
  SELECT doc_id, s, coalesce(s > lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 200, TRUE)::INT AS new
  FROM windows SEMI JOIN twice USING (h)),
span AS (
  SELECT doc_id, min(s) AS a, max(s) + 200 AS b
  FROM (SELECT doc_id, s, sum(new) OVER (PARTITION BY doc_id ORDER BY s) AS n FROM covered) GROUP BY doc_id, n),
before AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS last FROM span),
kept AS (
  SELECT doc_id, sum(b - a) AS removed, count(*) AS spans, max(b) AS e,
    string_agg(substr(x, 2 * last + 1, 2 * (a - last)), '' ORDER BY a) AS head
  FROM before JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, (len(x) // 2)::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(head, '') || substr(x, 2 * coalesce(e, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)""",
)
def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents"))


@query(
    "op13_conversation_repair",
    r"""
WITH RECURSIVE k AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
crc AS (
  SELECT *, xor(4294967295, list_reduce(list_concat([4294967295], list_transform(range(1, len(k) + 1), lambda p: ascii(k[p]))),
    lambda c, b: list_reduce(list_concat([xor(c, b)], range(8)),
      lambda x, y: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END)))) % 20 AS kind FROM k),
r AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM crc),
o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, left(role, 1) AS ini,
    regexp_replace(text, '[ \t\n\v\f\r]+$', '') AS body FROM r),
f AS (
  SELECT *, body = '' AS blank, body <> '' AND again AS dup, body <> '' AND NOT again AND right(body, 1) NOT IN ('.', '!', '?') AS trunc
  FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
    lag(ini) OVER (PARTITION BY conv_id ORDER BY i) AS prev FROM o)),
walk AS (
  SELECT conv_id, 0::BIGINT AS i, {'c': 0::BIGINT, 'a': '', 't': ''} AS s0, {'c': 1000000000::BIGINT, 'a': '', 't': ''} AS s1,
    {'c': 1000000000::BIGINT, 'a': '', 't': ''} AS s2, {'c': 1000000000::BIGINT, 'a': '', 't': ''} AS s3
  FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL
  SELECT conv_id, i, {'c': s0.c + 2, 'a': s0.a || 'D', 't': s0.t},
    list_min([{'c': s1.c + 2, 'a': s1.a || 'D', 't': s1.t}, {'c': s0.c + keep + CASE WHEN ini = 's' THEN 0 ELSE 1000000000 END, 'a': s0.a || 'K', 't': s0.t || own}]),
    list_min([{'c': u.c + 2, 'a': u.a || 'D', 't': u.t}, {'c': b.c + keep + CASE WHEN ini = 'u' THEN 0 ELSE 1000000000 END, 'a': b.a || 'K', 't': b.t || own},
      {'c': b.c + keep + 1, 'a': b.a || 'R', 't': b.t || chr(10) || 'user:' || text}]),
    list_min([{'c': e.c + 2, 'a': e.a || 'D', 't': e.t}, {'c': u.c + keep + CASE WHEN ini = 'a' THEN 0 ELSE 1000000000 END, 'a': u.a || 'K', 't': u.t || own},
      {'c': u.c + keep + 1, 'a': u.a || 'R', 't': u.t || chr(10) || 'assistant:' || text}])
  FROM (
    SELECT w.conv_id, f.i, f.ini, f.text, s0, s1, u, e, list_min([s0, s1, e]) AS b, chr(10) || f.role || ':' || f.text AS own,
      CASE WHEN f.blank OR f.dup THEN 1000000000 WHEN f.trunc THEN 5 ELSE 0 END AS keep
    FROM (
      SELECT *, list_min([s3, {'c': u.c + 5, 'a': u.a || 'I', 't': u.t || chr(10) || 'assistant:'}]) AS e
      FROM (SELECT *, list_min([s2, {'c': m.c + 5, 'a': m.a || 'I', 't': m.t || chr(10) || 'user:'}]) AS u
        FROM (SELECT *, list_min([s0, s1, s3]) AS m FROM walk))) w
    JOIN f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i + 1)),
ends AS (
  SELECT conv_id, arg_max(list_min([s0, s3, {'c': s2.c + 5, 'a': s2.a || 'I', 't': s2.t || chr(10) || 'assistant:'},
    {'c': s1.c + 10, 'a': s1.a || 'II', 't': s1.t || chr(10) || 'user:' || chr(10) || 'assistant:'}]), i) AS best
  FROM walk GROUP BY conv_id),
facts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(blank) AS blank,
    count_if(dup) AS duplicate, count_if(trunc) AS truncated, count_if(prev IS NOT NULL AND prev || ini NOT IN ('su', 'ua', 'au')) AS illegal
  FROM f GROUP BY conv_id)
SELECT e.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
  coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, best.c AS cost, best.a AS audit,
  sha256(substr(best.t, 2)) AS repaired_sha256
FROM ends e LEFT JOIN facts ON facts.conv_id IS NOT DISTINCT FROM e.conv_id""",
)
def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return damaged_and_repaired(table(spark, sf_dir, "conversations"))
