"""Queries over the test tables, one per operator: thin, whole tables, production parameters.

``oracle`` SQL is given where DuckDB can express the result; the others are tested against
brute force, an exact round trip or held-out accuracy in ``tests/llm``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from rvpanel.llm import centroid_tree, langid, latent_decontam, license_index, mil_quality, multiset_hash, phrases, rans, suffix_dedup, tensor_minhash, token_counts, topk, transducer


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_rans_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole corpus written as rANS blocks of token ids and read back."""
    docs = _table(spark, sf_dir, "documents")
    path = rans.write(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return rans.read(spark, path)


def op3_transducer_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded texts of the whole corpus through the lexicon automaton."""
    docs = _table(spark, sf_dir, "documents")
    path = public_tokenizers.path("word_bpe_49k.json")
    return transducer.encode_decode(docs, path, transducer.build_lexicon(docs, path))


def op2_mil_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learned from labels outside the held-out third."""
    found = mil_quality.rate_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return found.select("doc_id", "held_out", "score", "predicted")


def op4_license_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and templates in every document."""
    return license_index.scan(_table(spark, sf_dir, "documents")).drop("places")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without its repeated 200-byte strings."""
    return suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents"))


def op6_subword_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from labelled rows outside the held-out quarter."""
    found = langid.identify(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "held_out", "lang_pred", "score", "rejected")


def op7_tensor_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate component of every document."""
    return tensor_minhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op8_latent_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, with the item."""
    return latent_decontam.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_blockmax_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten best documents by BM25 for every document whose id is divisible by 100, as a whole-text query."""
    docs = _table(spark, sf_dir, "documents")
    queries = docs.where("doc_id % 100 = 0").withColumnRenamed("doc_id", "query_id")
    return topk.search(docs, queries, k=10)


def op10_pretoken_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, counted through its pre-tokens."""
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op11_centroid_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster of every vector after three rounds, and its distance."""
    return centroid_tree.cluster(_table(spark, sf_dir, "embeddings"))


def op12_multiset_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and how alike they and the next document's are."""
    return multiset_hash.fingerprints(_table(spark, sf_dir, "documents"))


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2,000 best phrases of every language."""
    return phrases.mine(_table(spark, sf_dir, "documents"))


_ALL = (op1_rans_tokens, op2_mil_quality, op3_transducer_bpe, op4_license_index, op5_suffix_dedup, op6_subword_langid, op7_tensor_minhash, op8_latent_decontam, op9_blockmax_topk, op10_pretoken_counts, op11_centroid_tree, op12_multiset_hash, op13_phrases)
LLM_QUERIES = {f.__name__: f for f in _ALL}

def _cluster_sql(k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64) -> str:
    """Every round compares all vectors with all centroids."""
    assigned = """a{i} AS (
  SELECT vec_id, x, arg_min(c, (d, c)) AS cluster, min(d) AS distance FROM (
    SELECT vec_id, x, c, list_sum([CAST((p[1] - p[2]) * (p[1] - p[2]) AS BIGINT) FOR p IN list_zip(x, y)]) AS d FROM v, c{i}) GROUP BY 1, 2)"""
    moved = f"""c{{j}} AS (
  SELECT c, coalesce(z, y) AS y FROM c{{i}} LEFT JOIN (
    SELECT cluster, list(CAST(floor(s / n) AS BIGINT) ORDER BY j) AS z FROM (
      SELECT cluster, j, sum(x[j]) AS s, count(*) AS n FROM a{{i}}, range(1, {dims + 1}) AS r(j) GROUP BY 1, 2) GROUP BY 1) ON cluster = c)"""
    steps = [assigned.format(i=0)]
    for i in range(rounds):
        steps += [moved.format(i=i, j=i + 1), assigned.format(i=i + 1)]
    return f"""WITH v AS (
  SELECT vec_id, [CAST(floor({scale} * CAST(e AS DOUBLE)) AS BIGINT) FOR e IN embedding] AS x FROM embeddings
  WHERE len(embedding) = {dims} AND len([1 FOR e IN embedding IF e IS NULL OR NOT isfinite(e)]) = 0),
c0 AS (
  SELECT row_number() OVER (ORDER BY h) - 1 AS c, x AS y FROM (SELECT x, sha256('1:' || vec_id) AS h FROM v ORDER BY h LIMIT {k})),
{", ".join(steps)}
SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, CAST(distance AS BIGINT) AS distance,
  CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(y, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} ON c = cluster"""


_PHRASE_SQL = r"""WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
split AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM pieces),
total AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM split GROUP BY 1),
grams AS (SELECT lang, k, unnest([array_to_string(ws[i : i + k - 1], ' ') FOR i IN range(1, len(ws) - k + 2)]) AS p
  FROM split, range(1, 5) AS r(k) WHERE len(ws) >= k),
f AS MATERIALIZED (SELECT lang, p, k, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 30),
cand AS (SELECT lang, p, k, f AS a, string_split(p, ' ') AS ws FROM f WHERE k > 1),
parts AS (
  SELECT *, array_to_string(ws[1 : j], ' ') AS head, array_to_string(ws[j + 1 :], ' ') AS tail FROM cand, range(1, 4) AS s(j) WHERE j < k),
cuts AS (
  SELECT c.lang, c.p, c.a, j, h.f AS l, t.f AS r, CAST(2000000 * CAST(c.a AS HUGEINT) // (h.f + t.f) AS BIGINT) AS score
  FROM parts c JOIN f h ON h.lang = c.lang AND h.p = c.head JOIN f t ON t.lang = c.lang AND t.p = c.tail),
worst AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, j) = 1),
inner_ AS (SELECT lang, unnest([array_to_string(ws[i : i + m - 1], ' ') FOR i IN range(1, k - m + 2)]) AS p, a FROM cand, range(2, 4) AS r(m) WHERE m < k),
longer AS (SELECT lang, p, max(a) AS longer FROM inner_ GROUP BY 1, 2)
SELECT * FROM (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(p)) AS rank, p AS phrase, a, l, r, n, score
  FROM worst LEFT JOIN longer USING (lang, p) JOIN total USING (lang)
  WHERE longer IS NULL OR 100 * CAST(longer AS HUGEINT) < 80 * CAST(a AS HUGEINT)) WHERE rank <= 2000"""

_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""


# Both texts are hashed whole here; the operator adds up what stays and what is new.
_FINGERPRINT_SQL = r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n FROM documents),
o AS (
  SELECT *, coalesce(lead(doc_id) OVER w, first_value(doc_id) OVER w) AS next_id, coalesce(lead(text) OVER w, first_value(text) OVER w) AS next_text
  FROM d WINDOW w AS (ORDER BY doc_id)),
e AS (SELECT doc_id, next_id, n, text, left(text, n - n // 4) || left(next_text, n // 4) AS edited FROM o),
both_ AS (SELECT doc_id, 0 AS kind, text AS t FROM e UNION ALL SELECT doc_id, 1, edited FROM e),
u AS (SELECT doc_id, kind, unnest(regexp_extract_all(t, '[^.,;:!?\n]*[.,;:!?\n]|[^.,;:!?\n]+')) AS u FROM both_),
h AS (
  SELECT doc_id, kind, substr(sha256(u), 1, 63) || substr(sha256('1' || u), 1, 63) AS w, CAST('0x' || substr(md5(u), 1, 15) AS BIGINT) AS m FROM u),
values_ AS (
  SELECT doc_id, kind, j AS lane, sum(CAST('0x' || substr(w, 9 * j + 1, 9) AS BIGINT)) % 68719476736 AS s FROM h, range(14) AS r(j) GROUP BY ALL
  UNION ALL SELECT doc_id, kind, 14 + v * 24 + (m >> 12) % 24, sum((m >> 36) % 31 + 1) % 65536 FROM (
    SELECT *, CASE WHEN m & 3 <> 0 THEN 0 WHEN m & 12 <> 0 THEN 1 WHEN m & 48 <> 0 THEN 2 WHEN m & 192 <> 0 THEN 3 WHEN m & 768 <> 0 THEN 4 ELSE 5 END AS v
    FROM h) GROUP BY ALL),
counts AS (SELECT doc_id, kind, count(u) AS n FROM both_ LEFT JOIN u USING (doc_id, kind) GROUP BY ALL),
lanes AS (
  SELECT doc_id, kind, lane, CAST(coalesce(s, 0) AS BIGINT) AS s FROM (SELECT doc_id, kind, lane FROM both_, range(158) AS r(lane)) LEFT JOIN values_ USING (doc_id, kind, lane)),
whole AS (
  SELECT doc_id, kind, n, string_agg(CASE WHEN lane < 14 THEN printf('%09x', s) ELSE printf('%04x', s) END, '' ORDER BY lane) || '-' || any_value(n) AS fp
  FROM lanes JOIN counts USING (doc_id, kind) GROUP BY ALL),
pairs AS (SELECT doc_id, doc_id AS other, 1 AS kind FROM e UNION ALL SELECT doc_id, next_id, 0 FROM e),
apart AS (
  SELECT p.doc_id, p.kind, (a.lane - 14) // 24 AS v, count(*) FILTER (WHERE a.s <> b.s) AS d
  FROM pairs p JOIN lanes a ON a.doc_id = p.doc_id AND a.kind = 0 JOIN lanes b ON b.doc_id = p.other AND b.kind = p.kind AND b.lane = a.lane
  WHERE a.lane >= 14 GROUP BY ALL),
opened AS (SELECT *, coalesce(min(v) FILTER (WHERE d <= 20) OVER (PARTITION BY doc_id, kind), 5) AS first FROM apart),
guess AS (
  SELECT doc_id, kind, sum(round(-24 * ln(1 - least(d, 23) / 24.0::DOUBLE), 9)) FILTER (WHERE v >= first) * pow(4.0::DOUBLE, min(first)) AS g FROM opened GROUP BY 1, 2),
near AS (
  SELECT p.doc_id, p.kind, round(CASE WHEN a.fp = b.fp THEN 1 ELSE greatest(0, 1 - greatest(g, abs(a.n - b.n), 1) / greatest(a.n + b.n, 1)) END, 6) AS near
  FROM pairs p JOIN guess USING (doc_id, kind) JOIN whole a ON a.doc_id = p.doc_id AND a.kind = 0 JOIN whole b ON b.doc_id = p.other AND b.kind = p.kind)
SELECT e.doc_id, CAST(e.n AS BIGINT) AS n_chars, sha256(edited) AS edited_sha256, a.fp AS fingerprint, b.fp AS edited_fingerprint,
  x.near + 0.0::DOUBLE AS near_edited, y.near + 0.0::DOUBLE AS near_next
FROM e JOIN whole a ON a.doc_id = e.doc_id AND a.kind = 0 JOIN whole b ON b.doc_id = e.doc_id AND b.kind = 1
JOIN near x ON x.doc_id = e.doc_id AND x.kind = 1 JOIN near y ON y.doc_id = e.doc_id AND y.kind = 0"""

LLM_ORACLES: dict[str, str] = {
    "op9_blockmax_topk": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
s AS (SELECT count(*) AS n, sum(len(ws)) / count(*) AS mean FROM d),
p AS (SELECT doc_id, len(ws) AS dl, unnest(ws) AS w FROM d),
tf AS (SELECT doc_id, dl, w, count(*) AS tf FROM p GROUP BY ALL),
df AS (SELECT w, count(*) AS df FROM tf GROUP BY w),
x AS (
  SELECT q.doc_id AS query_id, t.doc_id,
         sum(floor(ln(1.0 + (n - df + 0.5) / (df + 0.5)) * (tf.tf * 2.2 / (tf.tf + 1.2 * (0.25 + 0.75 * tf.dl / mean))) * 65536 + 0.5)) AS units
  FROM (SELECT doc_id, w FROM tf WHERE doc_id % 100 = 0) q JOIN tf USING (w) JOIN df USING (w)
       CROSS JOIN s CROSS JOIN LATERAL (SELECT tf.doc_id) t
  GROUP BY ALL)
SELECT * FROM (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY units DESC, doc_id) AS rank, doc_id, CAST(units AS DOUBLE) / 65536 AS score
  FROM x) WHERE rank <= 10
""",
    "op11_centroid_tree": _cluster_sql(),
    "op12_multiset_hash": _FINGERPRINT_SQL,
    "op13_phrases": _PHRASE_SQL,
}
