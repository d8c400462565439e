"""The flagship plan: a corpus annotated with a dictionary made from annotations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossweave.functions import text
from glossweave.operators import decode, dictionary, scoring, spans
from glossweave.plans import tables


def mention_dictionary(links: DataFrame, names: DataFrame, k: int = 30) -> DataFrame:
    """(mention, entity, p, rank) from (mention, name) links to known entities."""
    known = names.groupBy("name").agg(F.min("entity_id").alias("entity"))
    tokens = F.array_join(text.tokens(F.col("mention")), " ")
    pairs = links.select(tokens.alias("mention"), F.col("name")).where("mention <> ''").join(known, "name").select("mention", "entity")
    return dictionary.ranked(dictionary.conditional(dictionary.mention_counts(pairs)), "p", k)


def annotate(docs: DataFrame, key: str, body: str, pem: DataFrame, threshold: float = 0.05) -> DataFrame:
    """(doc, begin, end, entity, score): spans that are mentions, the likeliest entity of
    each, the best spans that don't overlap, those above the threshold."""
    wanted = docs.where(F.col(body).isNotNull()).select(key, body)
    cores = docs.sparkSession.sparkContext.defaultParallelism
    # A scan of fewer pieces than cores, as of one small file, would leave most of them idle.
    if wanted.rdd.getNumPartitions() < cores:
        wanted = wanted.repartition(cores, key)
    chunked = spans.chunks(wanted, key, body, by="document")
    found = spans.spotted(chunked, pem.select("mention"))
    best = scoring.prior_score(pem).where("rank = 1").select(F.col("mention").alias("span"), "entity", "score")
    scored = found.join(best, "span").select(F.col("key").alias("doc"), "begin", "end", "entity", "score")
    chosen = decode.greedy(scored)
    return decode.above(chosen, threshold).select("doc", "begin", "end", "entity", F.round("score", 6).alias("score"))


def annotate_corpus(spark: SparkSession, d: str) -> DataFrame:
    links = tables.annotations(spark, d).select("mention", F.col("wikiName").alias("name"))
    pem = mention_dictionary(links, tables.read(spark, d, "entity_names"))
    return annotate(tables.read(spark, d, "documents"), "doc_id", "text", pem)


def annotate_response(spark: SparkSession, d: str) -> DataFrame:
    """(doc, response): the annotations of every text of the corpus as [start, length,
    title] lists in characters."""
    found = annotate_corpus(spark, d)
    offsets = spans.token_offsets(tables.read(spark, d, "documents"), "doc_id", "text")
    names = tables.read(spark, d, "entity_names").groupBy(F.col("entity_id").alias("entity")).agg(F.replace(F.max("name"), F.lit(" "), F.lit("_")).alias("title"))
    return decode.responses(decode.word_to_char(found, offsets).join(names, "entity"))
