"""The test tables as the relations that the operators work on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def part_counts(spark: SparkSession, d: str, status: str) -> DataFrame:
    """Mention counts of a source: part names as mentions of their brands."""
    lines = read(spark, d, "lineitem").where(F.col("l_linestatus") == status)
    parts = read(spark, d, "part")
    return lines.join(parts, lines["l_partkey"] == parts["p_partkey"]).groupBy(F.col("p_name").alias("mention"), F.col("p_brand").alias("entity")).agg(F.count("*").alias("n"))


def part_counts_sql(status: str) -> str:
    return f"SELECT p_name AS mention, p_brand AS entity, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_linestatus = '{status}' GROUP BY ALL"


def annotations(spark: SparkSession, d: str) -> DataFrame:
    """Annotations, redelivered rows once."""
    return read(spark, d, "annotations").drop("ingested_at").distinct()


ANNOTATIONS = "SELECT DISTINCT annotation_id, doc, mention, wikiName, m_offset, m_length, annotated_at FROM annotations"

_SAMPLE = ["chunk_id", "sample_mode", "pass_no", "words", "begin_spans", "end_spans", "cand_entities", "cand_entities_scores", "ground_truth", "begin_gm", "end_gm", "encoded_at"]


def samples(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Encoded samples, redelivered rows once, with ``doc`` naming the chunk's pass.

    A pass is encoded once, so its key and time and the asked columns tell rows apart, and
    only those are read and shuffled.
    """
    rows = read(spark, d, "encoded_samples").select("chunk_id", "sample_mode", "pass_no", "encoded_at", *columns).distinct()
    return rows.withColumn("doc", F.concat_ws("/", "chunk_id", "sample_mode", F.col("pass_no").cast("string")))


SAMPLES = f"SELECT *, concat_ws('/', chunk_id, sample_mode, pass_no::VARCHAR) AS doc FROM (SELECT DISTINCT {', '.join(_SAMPLE)} FROM encoded_samples)"


def span_candidates(spark: SparkSession, d: str) -> DataFrame:
    """(doc, span, begin, end, pos, entity, score) of all samples."""
    at = lambda c, i: F.get(c, i)
    rows = samples(spark, d, "begin_spans", "end_spans", "cand_entities", "cand_entities_scores")
    spans = rows.select("doc", F.explode(F.transform("begin_spans", lambda b, j: F.struct(j.alias("span"), b.alias("begin"), at("end_spans", j).alias("end"), at("cand_entities", j).alias("es"), at("cand_entities_scores", j).alias("ss")))).alias("s")).select("doc", "s.*")
    cands = spans.select("doc", "span", "begin", "end", "ss", F.posexplode("es").alias("pos", "entity"))
    return cands.select("doc", F.col("span").cast("bigint").alias("span"), "begin", "end", F.col("pos").cast("bigint").alias("pos"), "entity", F.get("ss", F.col("pos")).cast("double").alias("score"))


CANDIDATES = f"""
SELECT doc, span, b AS "begin", e AS "end", p - 1 AS pos, ents[p] AS entity, sc[p]::DOUBLE AS score
FROM (SELECT *, unnest(range(1, len(ents) + 1)) AS p FROM (
  SELECT doc, j - 1 AS span, begin_spans[j] AS b, end_spans[j] AS e, cand_entities[j] AS ents, cand_entities_scores[j] AS sc
  FROM (SELECT *, unnest(range(1, len(begin_spans) + 1)) AS j FROM ({SAMPLES}))))
"""


def gold(spark: SparkSession, d: str) -> DataFrame:
    """(doc, begin, end, entity) of all samples' gold mentions."""
    rows = samples(spark, d, "ground_truth", "begin_gm", "end_gm").select("doc", F.explode(F.transform("ground_truth", lambda g, j: F.struct(F.get("begin_gm", j).alias("begin"), F.get("end_gm", j).alias("end"), g.alias("entity")))).alias("g"))
    return rows.select("doc", "g.*").where("begin is not null and end is not null and entity is not null")


GOLD = f"""
SELECT doc, begin_gm[j] AS "begin", end_gm[j] AS "end", ground_truth[j] AS entity
FROM (SELECT *, unnest(range(1, len(ground_truth) + 1)) AS j FROM ({SAMPLES}))
WHERE begin_gm[j] IS NOT NULL AND end_gm[j] IS NOT NULL AND ground_truth[j] IS NOT NULL
"""

PREDICTIONS = f"""
SELECT doc, "begin", "end", entity, score FROM (
  SELECT * FROM ({CANDIDATES}) WHERE score IS NOT NULL AND NOT isnan(score)
  QUALIFY row_number() OVER (PARTITION BY doc, span ORDER BY score DESC, pos) = 1)
WHERE entity <> 0
"""


def vector_candidates(spark: SparkSession, d: str) -> DataFrame:
    """(doc, span, cand, p, local, vec): four candidates for every vector as a mention,
    ten mentions a document."""
    e = read(spark, d, "embeddings")
    n = e.agg((F.max("vec_id") + 1).alias("n"))
    rows = e.select("vec_id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("j")).join(F.broadcast(n))
    cand = F.pmod(7 * F.col("vec_id") + 13 * F.col("j"), F.col("n")).cast("bigint")
    rows = rows.select(F.floor(F.col("vec_id") / 10).cast("bigint").alias("doc"), F.col("vec_id").alias("span"), cand.alias("cand"), (F.lit(1.0) / (F.col("j") + 2)).alias("p"))
    vecs = e.select(F.col("vec_id").alias("cand"), F.transform("embedding", lambda x: x.cast("double")).alias("vec"))
    return rows.join(vecs, "cand").select("doc", "span", "cand", "p", F.col("p").alias("local"), "vec")


VECTOR_CANDIDATES = """
SELECT m.vec_id // 10 AS doc, m.vec_id AS span, c.vec_id AS cand, 1.0::DOUBLE / (j + 2) AS p, 1.0::DOUBLE / (j + 2) AS local, list_transform(c.embedding, lambda x: x::DOUBLE) AS vec
FROM (SELECT vec_id, unnest(range(0, 4)) AS j FROM embeddings) m
JOIN embeddings c ON c.vec_id = (7 * m.vec_id + 13 * j) % (SELECT max(vec_id) + 1 FROM embeddings)
"""
