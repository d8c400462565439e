"""Annotation requests answered: texts alone, or texts with the spans to be resolved."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossweave.functions import text
from glossweave.operators import decode, spans
from glossweave.plans import annotate as flagship
from glossweave.plans import tables
from glossweave.sources import readers


def answers(requests: DataFrame, key: str, value: str, pem: DataFrame, names: DataFrame, threshold: float = 0.05) -> DataFrame:
    """(key, response): the JSON answer to every JSON request.

    A request without spans is annotated; one with spans gets the likeliest entity of each
    span whose tokens are a known mention, at the span as given.  Requests that are no
    JSON or have no text get no answer, those without annotations an empty list.
    ``names``: (entity, title).
    """
    asked = readers.requests(requests.select(F.col(key).cast("string").alias("doc"), F.col(value).alias("value"))).where("text is not null")
    free = asked.where("spans is null").select("doc", "text")
    found = flagship.annotate(free, "doc", "text", pem, threshold)
    placed = decode.word_to_char(found, spans.token_offsets(free, "doc", "text")).select("doc", "start", "length", "entity")
    given = asked.where("spans is not null").select("doc", "text", F.explode("spans").alias("s"))
    best = pem.where("rank = 1").select("mention", "entity")
    words = F.array_join(text.tokens(F.substr("text", F.col("s.start") + 1, F.col("s.length"))), " ")
    linked = given.select("doc", F.col("s.start").alias("start"), F.col("s.length").alias("length"), words.alias("mention")).join(best, "mention").select("doc", "start", "length", "entity")
    titled = placed.unionByName(linked).join(names, "entity")
    out = asked.select("doc").join(decode.responses(titled, "doc"), "doc", "left")
    return out.select("doc", F.coalesce("response", F.lit("[]")).alias("response"))


def prepared(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The dictionary and the titles made from the tables of a folder."""
    links = tables.annotations(spark, d).select("mention", F.col("wikiName").alias("name"))
    pem = flagship.mention_dictionary(links, tables.read(spark, d, "entity_names"))
    names = tables.read(spark, d, "entity_names").groupBy(F.col("entity_id").alias("entity")).agg(F.replace(F.max("name"), F.lit(" "), F.lit("_")).alias("title"))
    return pem, names
