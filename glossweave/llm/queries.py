"""The queries of the operators of this package and, where it can be said in SQL, what
they must return."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossweave.llm import frequency, language, leakage, names, neighbours, packing, split, topn

#: Where the files of the public tokenizers lie, unless the caller says so.
TOKENIZERS = os.environ.get("GLOSSWEAVE_TOKENIZERS", "/opt/tokenizers")


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = topn.strongest(_read(spark, sf_dir, "encoded_samples"), "chunk_id", "begin_spans", "cand_entities", "cand_entities_scores", n=5)
    return best.select(F.col("key").alias("chunk_id"), F.col("slot").alias("begin_span"), F.col("item").alias("entity_id"))


P1_SQL = """
WITH spans AS (
  SELECT chunk_id, begin_spans[j] AS begin_span, cand_entities[j] AS ents, cand_entities_scores[j] AS scores
  FROM (SELECT *, unnest(range(1, len(cand_entities) + 1)) AS j FROM encoded_samples)),
offers AS (
  SELECT chunk_id, begin_span, ents[k] AS entity_id, scores[k] AS score
  FROM (SELECT *, unnest(range(1, len(ents) + 1)) AS k FROM spans)),
best AS (
  SELECT chunk_id, begin_span, entity_id, max(score) AS score FROM offers
  WHERE chunk_id IS NOT NULL AND begin_span IS NOT NULL AND entity_id <> 0 AND score IS NOT NULL AND NOT isnan(score) GROUP BY ALL)
SELECT chunk_id, begin_span, entity_id FROM best
QUALIFY row_number() OVER (PARTITION BY chunk_id, begin_span ORDER BY score DESC, entity_id) <= 5
"""


def _enders(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = _read(spark, sf_dir, "vocab_maps").where("kind = 'word'")
    return terms.where(F.col("term").rlike("^[.!?…”»'\"]+$") & F.col("term").rlike("[.!?…]")).select("term_id")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = split.split_long(_read(spark, sf_dir, "encoded_samples"), "chunk_id", "words", _enders(spark, sf_dir), limit=128, overlap=16)
    return pieces.select(F.col("key").alias("chunk_id"), F.col("begin").alias("piece_begin"), F.col("end").alias("piece_end"))


P2_SQL = """
WITH RECURSIVE enders AS (
  SELECT list(DISTINCT term_id) AS ids FROM vocab_maps
  WHERE kind = 'word' AND regexp_full_match(term, '[.!?…”»''"]+') AND regexp_matches(term, '[.!?…]')),
chunks AS (
  SELECT chunk_id, len(w) AS n, list_filter(range(1, len(w) + 1), lambda i: list_contains(ids, w[i])) AS cuts
  FROM (SELECT chunk_id, max(words) AS w FROM encoded_samples WHERE len(words) > 128 AND chunk_id IS NOT NULL GROUP BY chunk_id), enders),
pieces AS (
  SELECT chunk_id, n, cuts, 0::BIGINT AS b,
         CASE WHEN n <= 128 THEN n ELSE coalesce(list_max(list_filter(cuts, lambda c: c > 16 AND c <= 128)), 128) END AS e FROM chunks
  UNION ALL
  SELECT chunk_id, n, cuts, e - 16,
         CASE WHEN n - (e - 16) <= 128 THEN n ELSE coalesce(list_max(list_filter(cuts, lambda c: c > e AND c <= e - 16 + 128)), e - 16 + 128) END
  FROM pieces WHERE e < n)
SELECT chunk_id, b AS piece_begin, e::BIGINT AS piece_end FROM pieces
"""


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = _read(spark, sf_dir, "vocab_counter")
    marked = frequency.marked_terms(counted, "doc_name", {"word_freq": "word", "char_freq": "char"}, ["dataset", "counted_at"], rare_below=10, common_share=0.5)
    return marked.where("mark is not null").select("kind", "term", "mark")


P3_SQL = """
WITH docs AS (SELECT DISTINCT doc_name, dataset, word_freq, char_freq, counted_at FROM vocab_counter),
flat AS (
  SELECT doc_name, 'word' AS kind, unnest(map_entries(word_freq)) AS e FROM docs
  UNION ALL SELECT doc_name, 'char', unnest(map_entries(char_freq)) FROM docs),
terms AS (SELECT doc_name, kind, trim(e.key, chr(32) || chr(9) || chr(13) || chr(10)) AS term, e.value AS n FROM flat WHERE e.value > 0),
counts AS (
  SELECT kind, term, sum(n) AS occ, count(DISTINCT doc_name) AS recs FROM terms
  WHERE term <> '' AND doc_name IS NOT NULL AND NOT regexp_matches(term, '^(DOCSTART_|DOCEND|MMSTART_|MMEND|\\*NL\\*)') GROUP BY ALL)
SELECT kind, term, CASE WHEN occ < 10 THEN 'rare' ELSE 'common' END AS mark FROM counts
WHERE occ < 10 OR recs > 0.5 * (SELECT count(DISTINCT doc_name) FROM vocab_counter)
"""


def p3_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences and chunks of all runs of up to three words, unknown words apart."""
    passes = _read(spark, sf_dir, "encoded_samples").groupBy("chunk_id", "sample_mode").agg(F.max("words").alias("words"))
    known = F.transform("words", lambda w: F.when(w != 0, w))
    return frequency.ngram_counts(passes.select("chunk_id", known.alias("words")), "chunk_id", "words", 3)


P3_NGRAMS_SQL = """
WITH c AS (SELECT chunk_id, list_transform(max(words), lambda w: nullif(w, 0)) AS w FROM encoded_samples GROUP BY chunk_id, sample_mode),
p AS (SELECT chunk_id, unnest(range(1, len(w) + 1)) AS i, w FROM c WHERE chunk_id IS NOT NULL),
g AS (SELECT chunk_id, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM p WHERE w[i] IS NOT NULL),
s AS (SELECT chunk_id, a, NULL AS b, NULL AS c FROM g UNION ALL SELECT chunk_id, a, b, NULL FROM g WHERE b IS NOT NULL UNION ALL SELECT chunk_id, a, b, c FROM g WHERE b IS NOT NULL AND c IS NOT NULL)
SELECT a::VARCHAR AS t1, b::VARCHAR AS t2, c::VARCHAR AS t3, count(*) AS occ, count(DISTINCT chunk_id) AS recs FROM s GROUP BY a, b, c
"""


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _read(spark, sf_dir, "fp_weak_log")
    near = neighbours.nearest(log, "log_id", "entity_embeddings", dim=64, k=3, least=0.9 - 1e-7)
    pairs = near.where("similarity >= 0.9").select(F.least("key", "neighbour").alias("log_id_a"), F.greatest("key", "neighbour").alias("log_id_b"))
    return pairs.distinct()


P4_SQL = """
WITH v AS (
  SELECT log_id, any_value(list_transform(entity_embeddings, lambda x: x::DOUBLE)) AS e FROM fp_weak_log
  WHERE len(entity_embeddings) = 64 AND len(list_filter(entity_embeddings, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(entity_embeddings, lambda x: x <> 0)) > 0 GROUP BY log_id),
s AS (SELECT a.log_id AS a, b.log_id AS b, round(list_cosine_similarity(a.e, b.e), 7) AS c FROM v a JOIN v b ON a.log_id <> b.log_id),
k AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY a ORDER BY c DESC, b) <= 3)
SELECT DISTINCT least(a, b) AS log_id_a, greatest(a, b) AS log_id_b FROM k WHERE c >= 0.9
"""


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    typed = _read(spark, sf_dir, "annotations")
    meant = names.mapped(typed, "annotation_id", "wikiName", "mention", _read(spark, sf_dir, "entity_names"), "name", "entity_id", _read(spark, sf_dir, "redirects"), "old_title", "new_title")
    # A redelivered row counts once.
    return meant.where("not as_listed").select(F.col("key").alias("annotation_id"), F.col("entry_id").alias("entity_id")).distinct()


def p6_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = packing.packed_texts(_read(spark, sf_dir, "documents"), "doc_id", "text", f"{TOKENIZERS}/byte_bpe_50k.tiktoken", capacity=2048)
    return rows.withColumnRenamed("key", "doc_id")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = leakage.leaked(_read(spark, sf_dir, "documents"), "doc_id", "text", _read(spark, sf_dir, "eval_items"), "item_id", "text")
    return pairs.select(F.col("key").alias("doc_id"), F.col("item").alias("item_id"))


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    profiles = language.learned(_read(spark, sf_dir, "lang_samples"), docs, "text", "lang")
    labelled = docs.select("doc_id", "text", language.label_language(F.col("lang")).alias("label"))
    return language.segment_languages(labelled, "doc_id", "text", profiles, keep=["label"])


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _judged(spark, sf_dir)
    wrong = lines.where("n_words >= 8 and lang is not null and not (lang <=> label)")
    return wrong.select(F.col("key").alias("doc_id"), "line_no", "lang")


def p8_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: its label's language, its own and how sure that is."""
    first = _judged(spark, sf_dir).where("line_no = 0")
    return first.select(F.col("key").alias("doc_id"), "label", F.col("doc_lang").alias("lang"), F.col("doc_confidence").alias("confidence"))


QUERIES = {"p1_found": p1_found, "p2_found": p2_found, "p3_found": p3_found, "p3_ngrams": p3_ngrams, "p4_found": p4_found, "p5_found": p5_found, "p6_packed": p6_packed, "p7_found": p7_found, "p8_found": p8_found, "p8_documents": p8_documents}
SQL = {"p1_found": P1_SQL, "p2_found": P2_SQL, "p3_found": P3_SQL, "p3_ngrams": P3_NGRAMS_SQL, "p4_found": P4_SQL}
