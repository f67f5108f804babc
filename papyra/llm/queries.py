"""Registered queries of the training-data operators and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, embedding_dedup, filter_audit, lines, pseudonyms, ranked_search, repetition, sharding, simhash, substrings, token_files, toxicity
from .common import documents

# The registered query's key is fixed so that its result can be checked; a
# production run passes its own secret.
PSEUDONYM_KEY = "registered-query"

Query = Callable[[SparkSession, str], DataFrame]


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
                                public_tokenizers.PATTERN, with_ids=False)


def op2_repetition_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.quality_rules(documents(spark, sf_dir))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir), shingle_words=4, max_bits=4)
    return found.select("doc_id", simhash.hex_fingerprint().alias("fingerprint"), "component_id")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaks = decontaminate.find_leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return leaks.drop("text_hash")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = token_files.write_token_files(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
    return token_files.token_index(spark, path).drop("file")


def op6_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return pseudonyms.pseudonymise(docs, key=PSEUDONYM_KEY)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = lines.dedup_lines(documents(spark, sf_dir), min_chars=40, min_docs=5)
    return done.select("doc_id", "n_lines", "n_dropped",
                       F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op8_shuffle_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_digest(documents(spark, sf_dir), n_shards=16, seed=42)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score_documents(docs, model).select("doc_id", "held_out", "score", "predicted")


def op10_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(documents(spark, sf_dir), length=200, with_text=False)


def op11_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every embedding; edge rows as in
    ``embedding_dedup.near_duplicates``."""
    return embedding_dedup.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), threshold=0.98)


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures of all 120 orders of the five filters for every source; edge
    rows as in ``filter_audit.filter_masks``."""
    return filter_audit.audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of every benchmark item; edge rows as in
    ``ranked_search.ranked_search``."""
    return ranked_search.ranked_search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), k=10)


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    op1_bpe, op2_repetition_quality, op3_simhash, op4_decontaminate,
    op5_token_files, op6_pseudonyms, op7_line_dedup, op8_shuffle_shards,
    op9_toxicity, op10_substrings, op11_embeddings, op12_filter_audit, op13_ranked_search)}

ORACLES: dict[str, str] = {
    "op7_line_dedup": r"""
WITH line AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM line),
common AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
judged AS (
  SELECT k.doc_id, k.pos, k.line, c.key IS NOT NULL AND k.doc_id <> c.keeper AS dropped
  FROM keyed k LEFT JOIN common c ON k.key = c.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM judged GROUP BY doc_id""",

    "op11_embeddings": r"""
WITH RECURSIVE usable AS (
  SELECT vec_id, label, [x::DOUBLE FOR x IN embedding] AS v FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND list_bool_and([x IS NOT NULL AND isfinite(x) FOR x IN embedding])
    AND list_bool_or([x <> 0 FOR x IN embedding])),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
reach(vec_id, low) AS (
  SELECT vec_id, vec_id FROM embeddings
  UNION
  SELECT l.b, r.low FROM reach r JOIN links l ON l.a = r.vec_id WHERE r.low < l.b),
counts AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT r.vec_id, coalesce(any_value(n), 0) AS n_links, min(low) AS component_id, min(low) = r.vec_id AS kept
FROM reach r LEFT JOIN counts USING (vec_id) GROUP BY r.vec_id""",

    "op12_filter_audit": r"""
WITH words AS (
  SELECT *, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
failing AS (
  SELECT doc_id, coalesce(source, '') AS part,
         (len(w) < 50)::INT + 2 * (100 * len(list_distinct(w)) < 65 * len(w))::INT
         + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t))::INT
         + 8 * regexp_matches(t, '[#$%&*|]')::INT
         + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)::INT AS mask
  FROM words),
marks AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
counts AS (
  SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
  FROM failing LEFT JOIN marks USING (doc_id) GROUP BY part, mask),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM f a, f b, f c, f d, f e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (
  SELECT filter_order, s AS step, 1 << (ascii(filter_order[s]) - 65) AS bit,
         list_sum([0] || list_transform(range(1, s), lambda i: 1 << (ascii(filter_order[i]) - 65))) AS prior
  FROM orders, range(1, 6) AS r(s)),
figures AS (
  SELECT part, filter_order, step, bit,
         coalesce(sum(n) FILTER (WHERE mask & (prior | bit) = 0), 0) AS kept,
         coalesce(sum(n) FILTER (WHERE mask & bit <> 0 AND mask & prior = 0), 0) AS removed,
         coalesce(sum(n) FILTER (WHERE mask & bit <> 0 AND mask & prior <> 0), 0) AS redundant,
         coalesce(sum(n) FILTER (WHERE mask = bit), 0) AS unique_fails,
         coalesce(sum(good) FILTER (WHERE mask & bit <> 0 AND mask & prior = 0), 0) AS good_lost,
         coalesce(sum(toxic) FILTER (WHERE mask & bit <> 0 AND mask & prior = 0), 0) AS toxic_lost
  FROM counts, (SELECT filter_order, step, bit::INT AS bit, prior::INT AS prior FROM steps)
  GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed,
       redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost,
       toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM figures""",

    "op13_ranked_search": r"""
WITH held AS (
  SELECT row_number() OVER () AS doc, doc_id,
         unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                   '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
tf AS (SELECT doc, any_value(doc_id) AS doc_id, term, count(*) AS tf FROM held GROUP BY doc, term),
size AS (SELECT doc, sum(tf)::BIGINT AS n FROM tf GROUP BY doc),
corpus AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM size),
df AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
       FROM tf, corpus GROUP BY term, n_docs),
asked AS (
  SELECT DISTINCT row, item_id, term FROM (
    SELECT row_number() OVER () AS row, item_id,
           unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark)),
scored AS (
  SELECT row, any_value(item_id) AS item_id, tf.doc, any_value(doc_id) AS doc_id,
         sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM asked JOIN tf USING (term) JOIN df USING (term) JOIN size ON size.doc = tf.doc, corpus
  GROUP BY row, tf.doc),
ranked AS (SELECT *, row_number() OVER (PARTITION BY row ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM ranked WHERE rank <= 10""",
}
