"""Registered queries of the training-data operators: each runs its operator over
the whole table with production parameters. Where SQL can express the result,
``ORACLE`` holds it; the other queries are tested against brute force, exact
round trips or held-out accuracy in ``tests/llm``."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bitpack, dartminhash, fertility, fmindex, lloyd, negatives, pieces, pq, secrets, suffixsort, toxicity, urlfilter, warc
from .common import prepare, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        prepare(spark)
        return fn(spark, sf_dir)
    QUERIES[fn.__name__] = run
    return fn


def tokenizer_file(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


@query
def op1_product_quantisation(spark, sf_dir):
    return pq.near_duplicates(table(spark, sf_dir, "embeddings"))


@query
def op2_fm_index_decontamination(spark, sf_dir):
    return fmindex.digests(fmindex.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


@query
def op3_dart_minhash(spark, sf_dir):
    return dartminhash.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op4_prefix_merge_sort(spark, sf_dir):
    return suffixsort.digests(suffixsort.remove_repeats(table(spark, sf_dir, "documents")))


@query
def op5_assignment_secrets(spark, sf_dir):
    return secrets.digests(secrets.find_secrets(table(spark, sf_dir, "documents")))


@query
def op6_boosted_url_filter(spark, sf_dir):
    return urlfilter.judge_urls(table(spark, sf_dir, "pages"))


@query
def op7_kneser_ney_toxicity(spark, sf_dir):
    return toxicity.judged(toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


@query
def op8_warc_dictionary(spark, sf_dir):
    return warc.read_archives(warc.write_archives(table(spark, sf_dir, "pages"))).drop("url", "payload")


@query
def op9_bit_packed_tokens(spark, sf_dir):
    manifest = bitpack.write_token_files(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), end_id=2)
    return bitpack.digests(bitpack.read_token_files(manifest))


@query
def op10_sentencepiece_backtracking(spark, sf_dir):
    return pieces.digests(pieces.encode_and_decode(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model")))


@query
def op11_tokeniser_fertility(spark, sf_dir):
    return fertility.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"),
                                   tokenizer_file("byte_bpe_50k.tiktoken"), tokenizer_file("piece_bpe_32k.model"))


@query
def op12_active_lloyd(spark, sf_dir):
    return lloyd.digests(*lloyd.compress(table(spark, sf_dir, "embeddings")))


@query
def op13_threshold_negatives(spark, sf_dir):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, sf_dir, "embeddings").withColumn("label", label)
    return negatives.hard_negatives(vectors, F.col("vec_id") % 100 == 0)


ORACLE["op1_product_quantisation"] = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND list_aggregate(list_transform(embedding, lambda x: abs(x)), 'sum') > 0),
links AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
reach(x, y) AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
n AS (SELECT x, count(*) AS n_links FROM links GROUP BY x),
c AS (SELECT x, min(y) AS low FROM reach GROUP BY x)
SELECT e.vec_id, coalesce(n.n_links, 0)::BIGINT AS n_links, least(e.vec_id, coalesce(c.low, e.vec_id)) AS component_id,
       e.vec_id = least(e.vec_id, coalesce(c.low, e.vec_id)) AS kept
FROM embeddings e LEFT JOIN n ON e.vec_id = n.x LEFT JOIN c ON e.vec_id = c.x
"""


_GOOD = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"


def _lloyd_sql(parts: int = lloyd.PARTS, entries: int = lloyd.ENTRIES, rounds: int = lloyd.ROUNDS) -> str:
    steps = []
    for k in range(rounds + 1):
        steps.append(f"""
a{k} AS MATERIALIZED (
  SELECT vec_id, part, min(d) AS d, arg_min(entry, (d, entry)) AS entry FROM (
    SELECT x.vec_id, x.part, b.entry,
           list_sum(list_transform(range(1, len(x.v) + 1), lambda i: (x.v[i] - b.v[i]) * (x.v[i] - b.v[i])))::BIGINT AS d
    FROM parts x JOIN b{k} b USING (part)) GROUP BY vec_id, part)""")
        if k < rounds:
            steps.append(f"""
s{k} AS (SELECT a.part, a.entry, i, sum(x.v[i]) AS t, count(*) AS n
  FROM a{k} a JOIN parts x USING (vec_id, part), unnest(range(1, len(x.v) + 1)) AS u(i) GROUP BY ALL),
b{k + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(c.v, b.v) AS v FROM b{k} b LEFT JOIN (
  SELECT part, entry, list(((t - ((t % n) + n) % n) // n)::BIGINT ORDER BY i) AS v FROM s{k} GROUP BY part, entry) c
  USING (part, entry))""")
    return f"""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding::DOUBLE[], lambda x: floor({lloyd.SCALE} * x)::BIGINT) AS q
  FROM embeddings WHERE {_GOOD}),
parts AS MATERIALIZED (SELECT vec_id, p AS part, q[p * (len(q) // {parts}) + 1:(p + 1) * (len(q) // {parts})] AS v
  FROM kept, unnest(range(0, {parts})) AS u(p)),
b0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, v FROM parts
  QUALIFY entry < {entries}),{','.join(steps)},
rows_ AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error
  FROM a{rounds} GROUP BY vec_id)
SELECT r.vec_id, r.code, r.error, (sum(r.error) OVER (PARTITION BY k.label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) FROM b{rounds}) AS codebooks_sha256
FROM rows_ r JOIN kept k USING (vec_id)
"""


ORACLE["op12_active_lloyd"] = _lloyd_sql()

ORACLE["op13_threshold_negatives"] = f"""
WITH v AS MATERIALIZED (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding::DOUBLE[], lambda x: floor({negatives.SCALE} * x)) AS q
  FROM embeddings WHERE label IS NOT NULL AND {_GOOD}),
s AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, list_inner_product(a.q, r.q)::BIGINT AS score
  FROM v a JOIN v r ON a.vec_id <> r.vec_id AND len(a.q) = len(r.q) WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {negatives.POSITIVES})
SELECT p.anchor_id, p.positive_id,
  (row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id))::INTEGER AS rank,
  s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same
  AND {negatives.LEAST} * p.positive_score <= {negatives.WHOLE} * s.score
  AND {negatives.WHOLE} * s.score <= {negatives.MOST} * p.positive_score
QUALIFY rank <= {negatives.NEGATIVES}
"""
