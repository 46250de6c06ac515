"""The registered queries of the training-data operators, each over its whole table, and their SQL where there is one."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .backoff_lm import score
from .common import table
from .fill_in_middle import fim_digests
from .html_extract import extract_main_text
from .language_id import identify
from .licenses import scan_licenses
from .line_dedup import dedup_lines
from .mixing import mix_sources
from .near_dedup import near_duplicates
from .pieces import piece_digests
from .resampling import resample
from .simhash import edited_fingerprints
from .token_counts import count_tokens
from .topk import top_k

WORD_VOCABULARY = "word_bpe_49k.json"
PIECE_VOCABULARY = "piece_bpe_32k.model"
TOKEN_LIMIT = 2048
WEIGHTS, MOST = (1, 2, 3), 3
QUERY_EVERY = 50
NEIGHBOURS, FACTOR = 5, 256
#: The contract of the near-duplicate query; the operator's own default is five words.
SHINGLE_WORDS = 3


def op1_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_VOCABULARY), TOKEN_LIMIT)


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"), WEIGHTS, MOST).drop("p")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(table(spark, sf_dir, "documents"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_digests(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECE_VOCABULARY))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_chunks_removed", "n_lines_removed")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def op8_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % QUERY_EVERY == 0, NEIGHBOURS, FACTOR)


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), SHINGLE_WORDS)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums to a millionth."""
    return score(table(spark, sf_dir, "documents")).withColumns({c: F.round(c, 6) for c in ("base_score", "score")})


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim_digests(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_html_main_text,
        op2_token_counts,
        op3_mix_sources,
        op4_simhash,
        op5_sentencepiece,
        op6_line_dedup,
        op7_license_scan,
        op8_exact_topk,
        op9_simhash_near_dedup,
        op10_language_id,
        op11_importance_resampling,
        op12_lm_scores,
        op13_fill_in_middle,
    )
}

ORACLE_SQL = {
    # Targets by lifting one level until the caps are met; samples by walking down each source's order a document at a time.
    "op3_mix_sources": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT + 0.5::DOUBLE) / 281474976710656.0::DOUBLE AS u
  FROM documents
), o AS (
  SELECT *, floor(u / (u + (1 - u) * sqrt(pow(2.0::DOUBLE, length(bin(size))))) * 281474976710656.0::DOUBLE)::BIGINT AS rank FROM d
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         1 + (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 AS weight
  FROM d GROUP BY source
), l AS (
  SELECT *, 3 * source_size AS cap,
         (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (ORDER BY (3 * source_size)::DOUBLE / weight, source NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
         / (sum(weight) OVER (ORDER BY (3 * source_size)::DOUBLE / weight, source NULLS FIRST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
  FROM s
), f AS (
  SELECT *, min(CASE WHEN level * weight < cap THEN (3 * source_size)::DOUBLE / weight END) OVER () AS first_free FROM l
), g AS (
  SELECT source, source_size, weight, cap,
         CASE WHEN cap::DOUBLE / weight >= first_free
              THEN (SELECT min(level) FROM f f2 WHERE f2.cap::DOUBLE / f2.weight = f.first_free) END AS common
  FROM f
), t AS (
  SELECT source, source_size, coalesce(least(cap::DOUBLE, common * weight), cap::DOUBLE) AS target FROM g
), c AS (
  SELECT *, target - copies * source_size AS lacking, target * 0.001::DOUBLE AS slack
  FROM (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS copies FROM t)
), r AS (
  SELECT source, rank, size, sum(size)::BIGINT AS words, row_number() OVER (PARTITION BY source ORDER BY rank, size) AS n
  FROM o WHERE size > 0 GROUP BY source, rank, size
), walk AS (
  SELECT source, lacking, slack, 0::BIGINT AS n, 0::BIGINT AS total, false AS took FROM c WHERE lacking > slack
  UNION ALL
  SELECT w.source, w.lacking, w.slack, r.n, CASE WHEN w.total <= w.lacking - w.slack AND w.total + r.words <= w.lacking THEN w.total + r.words ELSE w.total END,
         w.total <= w.lacking - w.slack AND w.total + r.words <= w.lacking
  FROM walk w JOIN r ON r.n = w.n + 1 AND r.source IS NOT DISTINCT FROM w.source
), ends AS (
  SELECT source, lacking, slack, max(total) AS total FROM walk GROUP BY source, lacking, slack
), extra AS (
  SELECT r.source, arg_min(r.n, (r.size, r.rank)) AS n
  FROM r JOIN ends e ON r.source IS NOT DISTINCT FROM e.source JOIN walk w ON w.n = r.n AND w.source IS NOT DISTINCT FROM r.source
  WHERE NOT w.took AND e.total <= e.lacking - e.slack AND r.words < 2 * (e.lacking - e.total) GROUP BY r.source
), chosen AS (
  SELECT r.source, r.rank, r.size FROM r JOIN walk w ON w.n = r.n AND w.source IS NOT DISTINCT FROM r.source WHERE w.took
  UNION ALL
  SELECT r.source, r.rank, r.size FROM r JOIN extra x ON x.n = r.n AND x.source IS NOT DISTINCT FROM r.source
)
SELECT o.doc_id, o.size, c.source_size, c.target, (c.copies + CASE WHEN h.rank IS NULL THEN 0 ELSE 1 END) * o.size AS taken,
       c.copies + CASE WHEN h.rank IS NULL THEN 0 ELSE 1 END AS copies, o.rank
FROM o JOIN c ON o.source IS NOT DISTINCT FROM c.source
LEFT JOIN chosen h ON h.source IS NOT DISTINCT FROM o.source AND h.rank = o.rank AND h.size = o.size
""",
    "op8_exact_topk": """
WITH v AS (
  SELECT vec_id, row_number() OVER () AS own, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
), p AS (
  SELECT a.own, a.vec_id AS query_id, b.vec_id, list_inner_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.own <> b.own AND len(a.q) = len(b.q) WHERE a.vec_id % 50 = 0
), r AS (
  SELECT query_id, row_number() OVER (PARTITION BY own ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM p
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
""",
    # Runs of one to three words by their places; checksums bit by bit over the runs' bytes.
    "op11_importance_resampling": r"""
WITH texts AS (
  SELECT 'd' AS side, doc_id AS key, row_number() OVER () AS own, text FROM documents
  UNION ALL SELECT 'b', NULL, -row_number() OVER (), text FROM benchmark
), words AS (
  SELECT side, key, own, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts
), runs AS (
  SELECT side, own, unnest(list_concat(w, list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i + 1]),
                                       list_transform(range(1, greatest(len(w) - 1, 1)), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS run FROM words
), counted AS (
  SELECT side, own, run, count(*) AS n FROM runs GROUP BY ALL
), sums AS (
  SELECT run, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(8 * strlen(run)), lambda i: (('0x' || substr(hex(encode(run)), 2 * (i // 8) + 1, 2))::BIGINT >> (i % 8)::BIGINT) & 1)),
                              lambda c, b: xor(c >> 1, 3988292384 * (xor(c, b) & 1))), 4294967295) % 10000 AS bucket
  FROM (SELECT DISTINCT run FROM runs)
), buckets AS (
  SELECT bucket, coalesce(sum(n) FILTER (side = 'd'), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (side = 'b'), 0)::DOUBLE AS t FROM counted JOIN sums USING (run) GROUP BY bucket
), gains AS (
  SELECT bucket, floor(1000 * ln((t + 1) * (sum(s) OVER () + 10000) / ((s + 1) * (sum(t) OVER () + 10000))))::BIGINT AS gain FROM buckets
), weights AS (
  SELECT own, sum(n * gain)::BIGINT AS weight, sum(n)::BIGINT AS n_features FROM counted JOIN sums USING (run) JOIN gains USING (bucket) WHERE side = 'd' GROUP BY own
), scored AS (
  SELECT key AS doc_id, d.own, len(w) AS n_words, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
         (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || coalesce(key::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE))))::BIGINT AS score
  FROM words d LEFT JOIN weights USING (own) WHERE side = 'd'
), drawn AS (
  SELECT own, row_number() OVER (ORDER BY score DESC, doc_id ASC NULLS LAST) AS rank, count(*) OVER () AS n FROM scored WHERE n_words >= 20
)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 5 * n // 100 THEN rank END AS rank FROM scored LEFT JOIN drawn USING (own)
""",
    # Pairs of neighbouring tokens, the beginning in front; sums with compensation.
    "op12_lm_scores": r"""
WITH d AS (
  SELECT row_number() OVER () AS own, doc_id,
         xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(8 * strlen(k)), lambda i: (ord(k[i // 8 + 1])::BIGINT >> (i % 8)::BIGINT) & 1)), lambda c, b: xor(c >> 1, 3988292384 * (xor(c, b) & 1))), 4294967295) % 7 = 2 AS held_out,
         list_append(list_prepend(' <', regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')), ' >') AS w
  FROM (SELECT *, coalesce(doc_id::VARCHAR, '') AS k FROM documents)
), t AS (
  SELECT own, held_out, unnest(w[2:]) AS word, unnest(w[:-2]) AS before FROM d
), words AS (
  SELECT word, count(*) FILTER (NOT held_out) AS c FROM t GROUP BY word
), n AS (
  SELECT sum(c)::BIGINT AS tokens, count(*) FILTER (c > 0) AS types FROM words
), histories AS (
  SELECT before, count(*) FILTER (NOT held_out) AS c FROM t GROUP BY before
), pairs AS (
  SELECT before, word, count(*) FILTER (NOT held_out) AS c FROM t GROUP BY before, word
), likely AS (
  SELECT p.before, p.word, w.c AS known, (w.c + 1)::DOUBLE / (n.tokens + n.types + 1) AS base, h.c AS h, p.c FROM pairs p JOIN words w USING (word) JOIN histories h USING (before), n
), scores AS (
  SELECT own, count(*) AS n_tokens, count(*) FILTER (known > 0) AS n_known, fsum(log10(base)) AS base_score, fsum(log10((c + 50.0::DOUBLE * base) / (h + 50.0::DOUBLE))) AS score
  FROM t JOIN likely USING (before, word) GROUP BY own
)
SELECT doc_id, held_out, n_tokens, n_known, coalesce(tokens, 0)::BIGINT AS train_tokens, round(base_score, 6) AS base_score, round(score, 6) AS score FROM d JOIN scores USING (own), n
""",
    "op13_fill_in_middle": r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
), n AS (
  SELECT *, len(u)::BIGINT AS n, ('0x' || substr(h, 1, 8))::BIGINT % (len(u) + 1) AS a, ('0x' || substr(h, 9, 8))::BIGINT % (len(u) + 1) AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR ('0x' || substr(h, 17, 8))::BIGINT % 100 >= 100 THEN 'plain'
              WHEN ('0x' || substr(h, 25, 8))::BIGINT % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM d
), p AS (
  SELECT *, array_to_string(u[1 : least(a, b)], '') AS pre, array_to_string(u[least(a, b) + 1 : greatest(a, b)], '') AS mid, array_to_string(u[greatest(a, b) + 1 :], '') AS suf FROM n
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
       sha256(CASE form WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid WHEN 'spm' THEN '<S>' || suf || '<P>' || pre || '<M>' || mid ELSE t END) AS output_sha256, sha256(t) AS restored_sha256
FROM p
""",
}
