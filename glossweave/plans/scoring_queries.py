"""Queries of the vector, scoring, ranking and reporting operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossweave.functions import text, vectors
from glossweave.operators import metrics, records, reports, scoring, vector_ops
from glossweave.plans import tables
from glossweave.plans.tables import CANDIDATES, GOLD, VECTOR_CANDIDATES, read, vector_candidates

QUERIES: dict = {}
SQL: dict = {}
DIM = 64


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _dot(a: str, b: str) -> str:
    return f"list_dot_product(list_transform({a}, lambda x: x::DOUBLE), list_transform({b}, lambda x: x::DOUBLE))"


def _vectors(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")


@query(f"SELECT vec_id AS id, round(sqrt({_dot('embedding', 'embedding')}), 6) AS norm FROM embeddings")
def vec_norm(s, d):
    return _vectors(s, d).select("id", F.round(vectors.norm(F.col("vec")), 6).alias("norm"))


@query(f"""
SELECT a.vec_id AS query, b.vec_id AS item, round({_dot('a.embedding', 'b.embedding')}, 6) AS product, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_dot('a.embedding', 'b.embedding')} DESC, b.vec_id) AS rank
FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0 QUALIFY rank <= 5""")
def pairwise_dot_topk(s, d):
    """The stated query set (ids divisible by 20) against all rows."""
    rows = _vectors(s, d).select("id", "vec")
    return vector_ops.top_products(rows.where("id % 20 = 0"), rows, 5).select("query", "item", F.round("product", 6).alias("product"), "rank")


@query(f"""
SELECT a.vec_id AS query, b.vec_id AS item, round({_dot('a.embedding', 'b.embedding')} / (sqrt({_dot('a.embedding', 'a.embedding')}) * sqrt({_dot('b.embedding', 'b.embedding')})), 6) AS cosine
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def entity_cosine(s, d):
    rows = _vectors(s, d)
    other = rows.select((F.col("id") - 1).alias("id"), F.col("id").alias("item"), F.col("vec").alias("other"))
    return rows.join(other, "id").select(F.col("id").alias("query"), "item", F.round(vectors.cosine(F.col("vec"), F.col("other")), 6).alias("cosine"))


@query(f"""
SELECT label AS "group", [{', '.join(f'round(avg(embedding[{i + 1}]::DOUBLE), 6)' for i in range(DIM))}] AS vec FROM embeddings GROUP BY 1""")
def mean_pool(s, d):
    rows = _vectors(s, d)
    pooled = vector_ops.mean_pooled(rows, rows, "label", "id", DIM)
    return pooled.select("group", F.transform("vec", lambda x: F.round(x, 6)).alias("vec"))


@query(f"""
WITH t AS (SELECT {', '.join(f'sum(embedding[{i + 1}]::DOUBLE) AS s{i}' for i in range(DIM))} FROM embeddings),
u AS (SELECT [{', '.join(f's{i}' for i in range(DIM))}] AS v FROM t)
SELECT vec_id AS id, round({_dot('embedding', 'v')}, 4) AS total FROM embeddings, u""")
def partition_sums(s, d):
    rows = _vectors(s, d)
    return vector_ops.partition_sums(rows, rows, DIM).withColumn("total", F.round("total", 4))


@query("""
WITH c AS (SELECT chunk_id || '/' || span_num AS mention, cand_entity AS cand, max(1.0::DOUBLE / (cand_pos + 1)) AS p, max(final_score)::DOUBLE AS ctx FROM fp_weak_log
  WHERE chunk_id IS NOT NULL AND span_num IS NOT NULL AND cand_entity IS NOT NULL AND cand_pos IS NOT NULL AND final_score IS NOT NULL AND NOT isnan(final_score) GROUP BY ALL),
a AS (SELECT *, row_number() OVER (PARTITION BY mention ORDER BY ctx DESC, cand) <= 3 AS by_context FROM c),
b AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY mention ORDER BY by_context DESC, p DESC, cand) <= 7)
SELECT mention, cand, round(p, 6) AS p, by_context, row_number() OVER (PARTITION BY mention ORDER BY p DESC, cand) AS rank FROM b""")
def rerank_union_fill(s, d):
    rows = read(s, d, "fp_weak_log").where("chunk_id is not null and span_num is not null and cand_entity is not null and cand_pos is not null and final_score is not null and not isnan(final_score)")
    cands = rows.groupBy(F.concat_ws("/", "chunk_id", F.col("span_num").cast("string")).alias("mention"), F.col("cand_entity").alias("cand")).agg(F.max(1.0 / (F.col("cand_pos") + 1)).alias("p"), F.max("final_score").cast("double").alias("ctx"))
    return vector_ops.reranked(cands, 3, 7).select("mention", "cand", F.round("p", 6).alias("p"), "by_context", "rank")


@query(f"""
WITH c AS ({VECTOR_CANDIDATES}), w AS (SELECT vec_id // 10 AS doc, vec_id AS pos, embedding AS wvec FROM embeddings),
x AS (SELECT c.doc, c.span, c.cand, w.pos, {_dot('c.vec', 'w.wvec')} AS s FROM c JOIN w ON w.doc = c.doc AND w.pos <> c.span),
u AS (SELECT doc, span, pos, max(s) AS u FROM x GROUP BY ALL),
k AS (SELECT * FROM u WHERE u >= 0 QUALIFY row_number() OVER (PARTITION BY doc, span ORDER BY u DESC, pos) <= 5),
e AS (SELECT *, exp(u) / sum(exp(u)) OVER (PARTITION BY doc, span) AS w FROM k)
SELECT x.doc, x.span, x.cand, round(sum(w * s), 6) AS score FROM x JOIN e ON e.doc = x.doc AND e.span = x.span AND e.pos = x.pos GROUP BY ALL""")
def hard_attention_scores(s, d):
    cands = vector_candidates(s, d)
    words = read(s, d, "embeddings").select(F.floor(F.col("vec_id") / 10).cast("bigint").alias("doc"), F.col("vec_id").alias("pos"), F.col("embedding").alias("wvec"))
    spans = cands.select("doc", "span").distinct().join(words, "doc").where("pos <> span")
    return scoring.attention(cands, spans, keep=5).withColumn("score", F.round("score", 6))


def _votes(voting: str) -> str:
    """SQL of the votes, vectors summed position by position."""
    return f"""
WITH c AS ({VECTOR_CANDIDATES}), v AS ({voting}),
f AS (SELECT doc, span, i, sum(vec[i] * weight) AS x FROM (SELECT *, unnest(range(1, {DIM + 1})) AS i FROM v) GROUP BY ALL),
a AS (SELECT doc, i, sum(x) AS x FROM f GROUP BY ALL),
k AS (SELECT DISTINCT doc, span FROM c),
o AS (SELECT k.doc, k.span, list(a.x - coalesce(f.x, 0) ORDER BY a.i) AS o FROM k JOIN a ON a.doc = k.doc LEFT JOIN f ON f.doc = k.doc AND f.span = k.span AND f.i = a.i GROUP BY ALL)
SELECT c.doc, c.span, c.cand, round(coalesce(list_dot_product(vec, o) / CASE WHEN list_dot_product(o, o) > 0 THEN sqrt(list_dot_product(o, o)) ELSE 1 END, 0), 6) AS vote FROM c LEFT JOIN o ON o.doc = c.doc AND o.span = c.span"""


def _voted(s: SparkSession, d: str, voting) -> DataFrame:
    cands = vector_candidates(s, d)
    return scoring.global_votes(cands, voting(cands), DIM).select("doc", "span", "cand", F.round("vote", 6).alias("vote"))


@query(_votes("SELECT *, 1.0::DOUBLE AS weight FROM c WHERE local >= 0.3"))
def global_voting(s, d):
    return _voted(s, d, lambda c: scoring.voters(c, threshold=0.3))


@query(_votes("SELECT *, 1.0::DOUBLE AS weight FROM c QUALIFY row_number() OVER (PARTITION BY doc, span ORDER BY local DESC, cand) <= 2"))
def global_voting_topk(s, d):
    return _voted(s, d, lambda c: scoring.voters(c, top=2))


@query(_votes("SELECT *, exp(local) / sum(exp(local)) OVER (PARTITION BY doc, span) AS weight FROM c"))
def voter_mask_variants(s, d):
    return _voted(s, d, scoring.softmax_voters)


@query(f"SELECT doc, span, cand, round(ln(least(1.0::DOUBLE, greatest(1e-6::DOUBLE, p))) * 0.5 + local * 2.0 + 0.25, 6) AS score FROM ({VECTOR_CANDIDATES})")
def score_combine(s, d):
    rows = vector_candidates(s, d).withColumn("log_p", scoring.log_prior("p"))
    return rows.select("doc", "span", "cand", F.round(scoring.combined({"log_p": 0.5, "local": 2.0}, 0.25), 6).alias("score"))


@query(f"""
SELECT c.doc, round(sum(CASE WHEN g.entity IS NOT NULL THEN greatest(0.0::DOUBLE, 0.2 - score) ELSE greatest(0.0::DOUBLE, score) END), 4) AS loss
FROM ({CANDIDATES}) c LEFT JOIN (SELECT DISTINCT * FROM ({GOLD})) g ON g.doc = c.doc AND g."begin" = c."begin" AND g."end" = c."end" AND g.entity = c.entity
WHERE score IS NOT NULL AND NOT isnan(score) GROUP BY 1""")
def hinge_loss(s, d):
    gold = tables.gold(s, d).distinct().withColumn("hit", F.lit(True))
    rows = tables.span_candidates(s, d).where("score is not null and not isnan(score)").join(gold, ["doc", "begin", "end", "entity"], "left")
    loss = scoring.hinge_loss(F.col("score"), F.coalesce("hit", F.lit(False)))
    return rows.groupBy("doc").agg(F.round(F.sum(loss), 4).alias("loss"))


def _belief_sql(rounds: int) -> str:
    """The rounds one after the other, every message a row."""
    steps = [f"""
WITH v AS MATERIALIZED ({VECTOR_CANDIDATES}), n AS (SELECT doc, count(DISTINCT span) AS n FROM v GROUP BY 1),
x AS MATERIALIZED (SELECT a.doc, a.span AS i, a.cand AS ic, b.span AS j, b.cand AS jc, b.local + 2.0 / n * list_dot_product(a.vec, b.vec) AS s FROM v a JOIN v b ON a.doc = b.doc JOIN n ON n.doc = a.doc),
m0 AS MATERIALIZED (SELECT DISTINCT doc, i, ic, j, 0.0::DOUBLE AS q FROM x)"""]
    for r in range(rounds):
        steps.append(f"""
g{r} AS MATERIALIZED (SELECT doc, i AS j, ic AS jc, sum(q) AS g FROM m{r} GROUP BY ALL),
w{r} AS MATERIALIZED (SELECT x.doc, i, ic, x.j, max(s + g) AS w FROM x JOIN g{r} g ON g.doc = x.doc AND g.j = x.j AND g.jc = x.jc GROUP BY ALL),
l{r} AS MATERIALIZED (SELECT doc, i, j, ln(sum(exp(w))) AS l FROM w{r} GROUP BY ALL),
m{r + 1} AS MATERIALIZED (SELECT w.doc, w.i, w.ic, w.j, ln(0.5 * exp(m.q) + 0.5 * CASE WHEN w.i = w.j THEN 1.0 ELSE exp(w.w - l.l) END) AS q
  FROM w{r} w JOIN m{r} m ON m.doc = w.doc AND m.i = w.i AND m.ic = w.ic AND m.j = w.j JOIN l{r} l ON l.doc = w.doc AND l.i = w.i AND l.j = w.j)""")
    steps.append(f"""
b AS (SELECT v.doc, v.span, v.cand, v.local + g AS b FROM v JOIN (SELECT doc, i, ic, sum(q) AS g FROM m{rounds} GROUP BY ALL) m ON m.doc = v.doc AND m.i = v.span AND m.ic = v.cand)
SELECT doc, span, cand, round(b - ln(sum(exp(b)) OVER (PARTITION BY doc, span)), 6) AS belief FROM b""")
    return ",".join(steps)


@query(_belief_sql(10))
def lbp_marginals(s, d):
    return scoring.loopy_beliefs(vector_candidates(s, d)).withColumn("belief", F.round("belief", 6))


@query(f"""
SELECT string_split(doc, '/')[1] AS chunk, span, entity, round(avg(score), 6) AS score FROM ({CANDIDATES}) WHERE score IS NOT NULL AND NOT isnan(score) GROUP BY ALL""")
def ensemble_mean(s, d):
    """The encoder's two modes as two runs over the same chunks."""
    rows = tables.span_candidates(s, d).where("score is not null and not isnan(score)").withColumns({"chunk": F.get(F.split("doc", "/"), 0), "mode": F.get(F.split("doc", "/"), 1)})
    runs = [rows.where(F.col("mode") == m) for m in ("gmonly", "allspans")]
    return scoring.ensemble(runs, ["chunk", "span", "entity"]).withColumn("score", F.round("score", 6))


RANKING = "SELECT l_orderkey AS q, l_partkey AS item, max(l_extendedprice) AS score, max((l_returnflag = 'R')::INT)::BIGINT AS label FROM lineitem GROUP BY ALL"


def _ranking(s: SparkSession, d: str) -> DataFrame:
    rows = read(s, d, "lineitem")
    return rows.groupBy(F.col("l_orderkey").alias("q"), F.col("l_partkey").alias("item")).agg(F.max("l_extendedprice").alias("score"), F.max((F.col("l_returnflag") == "R").cast("bigint")).alias("label"))


@query(f"SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, item) AS rank FROM ({RANKING})")
def rank_by_similarity(s, d):
    return metrics.ranked(_ranking(s, d), "q", "item", "score").withColumn("rank", F.col("rank").cast("bigint"))


@query(f"""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, item) AS rank FROM ({RANKING})),
p AS (SELECT *, sum(label) OVER (PARTITION BY q ORDER BY rank) / rank AS pr FROM r)
SELECT q AS query, round(avg(pr), 6) AS ap FROM p WHERE label > 0 GROUP BY 1""")
def map_metric(s, d):
    return metrics.average_precision(_ranking(s, d), "q", "item", "score", "label").withColumn("ap", F.round("ap", 6))


@query(f"""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, item) AS rank, row_number() OVER (PARTITION BY q ORDER BY label DESC, item) AS ideal FROM ({RANKING})),
g AS (SELECT q, sum(CASE WHEN rank <= 5 THEN label / log2(greatest(2, rank)) END) AS dcg, sum(CASE WHEN ideal <= 5 THEN label / log2(greatest(2, ideal)) END) AS idcg FROM r GROUP BY 1)
SELECT q AS query, round(coalesce(dcg / nullif(idcg, 0), 0.0::DOUBLE), 6) AS ndcg FROM g""")
def ndcg_at_k(s, d):
    return metrics.ndcg(_ranking(s, d), "q", "item", "score", "label", 5).withColumn("ndcg", F.round("ndcg", 6))


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1")
def best_run_per_group(s, d):
    return reports.best_runs(read(s, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), "o_custkey", "o_totalprice", "o_orderkey")


@query("""
WITH RECURSIVE d AS (SELECT step, score, row_number() OVER (ORDER BY step) AS n FROM (SELECT ts::DATE AS step, avg(value) AS score FROM events GROUP BY 1)),
r AS (SELECT n, step, score, score AS best, 0::BIGINT AS since FROM d WHERE n = 1
  UNION ALL SELECT d.n, d.step, d.score, CASE WHEN d.score >= r.best + 0.1 THEN d.score ELSE r.best END, CASE WHEN d.score >= r.best + 0.1 THEN 0 ELSE r.since + 1 END FROM r JOIN d ON d.n = r.n + 1)
SELECT step, round(score, 6) AS score, round(best, 6) AS best, since FROM r""")
def early_stop_report(s, d):
    days = read(s, d, "events").groupBy(F.to_date("ts").alias("day")).agg(F.avg("value").alias("score"))
    return metrics.since_improvement(days, "day", "score", 0.1).withColumns({"score": F.round("score", 6), "best": F.round("best", 6)})


@query("""
SELECT name, round(avg(v), 6) AS mean, round(stddev_pop(v), 4) AS std, min(v) AS least, max(v) AS greatest FROM (
  SELECT 'l_quantity' AS name, l_quantity AS v FROM lineitem UNION ALL SELECT 'l_discount', l_discount FROM lineitem UNION ALL SELECT 'l_tax', l_tax FROM lineitem) GROUP BY 1""")
def param_summary(s, d):
    out = reports.summary(read(s, d, "lineitem"), ["l_quantity", "l_discount", "l_tax"])
    return out.withColumns({"mean": F.round("mean", 6), "std": F.round("std", 4)})


@query("SELECT sample_mode, count(*) AS samples, sum(len(words))::BIGINT AS words, count(*) FILTER (WHERE len(list_filter(cand_entities, lambda c: len(c) > 0)) > 0) AS with_cands FROM encoded_samples GROUP BY 1")
def dataset_counts(s, d):
    has = F.exists("cand_entities", lambda c: F.coalesce(F.size(c) > 0, F.lit(False)))
    return read(s, d, "encoded_samples").groupBy("sample_mode").agg(F.count("*").alias("samples"), F.sum(F.when(F.col("words").isNotNull(), F.size("words"))).alias("words"), F.count(F.when(has, 1)).alias("with_cands"))


@query(f"SELECT round(avg((entity IS NULL OR entity NOT IN (SELECT entity_id FROM entity_names))::INT), 6) AS unknown_ratio FROM ({CANDIDATES})")
def unknown_ratio(s, d):
    known = read(s, d, "entity_names").select(F.col("entity_id").alias("entity"), F.lit(1).alias("k")).distinct()
    rows = tables.span_candidates(s, d).join(known, "entity", "left")
    return rows.agg(F.round(F.avg(F.col("k").isNull().cast("int")), 6).alias("unknown_ratio"))


@query(f"""
WITH n AS (SELECT a.label AS entity, CAST(b.vec_id AS VARCHAR) AS word FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0
  QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY {_dot('a.embedding', 'b.embedding')} DESC, b.vec_id) <= 5),
t AS (SELECT label AS entity, CAST(vec_id AS VARCHAR) AS word, 1 + vec_id % 3 AS tf FROM embeddings)
SELECT * FROM t WHERE tf >= 2 AND (entity, word) NOT IN (SELECT (entity, word) FROM n)""")
def entity_neighbours_missing_words(s, d):
    rows = _vectors(s, d)
    near = vector_ops.top_products(rows.select("id", "vec").where("id % 20 = 0"), rows.select("id", "vec"), 5)
    labelled = near.join(rows.select(F.col("id").alias("query"), "label"), "query").select(F.col("label").alias("entity"), F.col("item").cast("string").alias("word")).distinct()
    freq = rows.select(F.col("label").alias("entity"), F.col("id").cast("string").alias("word"), (1 + F.col("id") % 3).alias("tf"))
    return vector_ops.missing_words(labelled, freq, 2)


@query(r"""
SELECT doc_id, CASE WHEN text[1] = 'ß' THEN 'SS' ELSE upper(substr(text, 1, 1)) END || substr(text, 2) AS capital, regexp_replace(text, '[^A-Za-z0-9]', '', 'g') AS letters,
  array_to_string(list_filter(regexp_split_to_array(text, '[ ,]'), lambda t: t <> ''), '|') AS fields, lower(text) AS low, len(regexp_extract_all(text, '[A-Za-z0-9]+')) AS words
FROM documents WHERE text IS NOT NULL""")
def text_functions(s, d):
    t = F.col("text")
    rows = read(s, d, "documents").where("text is not null")
    return rows.select("doc_id", text.first_upper(t).alias("capital"), F.regexp_replace(t, "[^A-Za-z0-9]", "").alias("letters"), F.array_join(text.split_nonempty(t, " ,"), "|").alias("fields"), F.lower(t).alias("low"), F.size(text.alnum_words(t)).cast("bigint").alias("words"))


@query(f"""
WITH v AS (SELECT * FROM ({VECTOR_CANDIDATES}) WHERE local >= 0.3)
SELECT doc, count(*) AS voters, count(*)::DOUBLE AS weight, list(cand ORDER BY cand) AS cands FROM v GROUP BY 1""")
def voter_report(s, d):
    return reports.voter_report(scoring.voters(vector_candidates(s, d), threshold=0.3))


@query(f"""
WITH v AS MATERIALIZED ({VECTOR_CANDIDATES}), w AS MATERIALIZED (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY doc, span ORDER BY local DESC, cand) = 1)
SELECT w.doc, w.span, w.cand, v.span AS voter_span, v.cand AS voter, round({_dot('w.vec', 'v.vec')}, 6) AS product FROM w JOIN v ON v.doc = w.doc AND v.span <> w.span AND v.local >= 0.5""")
def voter_products(s, d):
    cands = vector_candidates(s, d)
    out = reports.voter_products(scoring.voters(cands, top=1), scoring.voters(cands, threshold=0.5))
    return out.withColumn("product", F.round("product", 6))


@query(f"""
WITH v AS MATERIALIZED ({VECTOR_CANDIDATES}),
b AS MATERIALIZED (SELECT a.doc, a.span, a.cand, o.span AS os, max({_dot('a.vec', 'o.vec')}) AS m FROM v a JOIN v o ON o.doc = a.doc AND o.span <> a.span GROUP BY ALL),
t AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY doc, span, cand ORDER BY m DESC) <= 3)
SELECT doc, span, cand, round(avg(m), 6) AS vote FROM t GROUP BY ALL""")
def pairwise_votes(s, d):
    return scoring.pairwise_votes(vector_candidates(s, d), 3).withColumn("vote", F.round("vote", 6))


@query(f"SELECT doc, span, cand, CASE WHEN p >= 0.5 THEN 0.3 WHEN p >= 0.3 THEN 0.2 WHEN p >= 0.25 THEN 0.1 ELSE -0.5 END::DOUBLE AS bias FROM ({VECTOR_CANDIDATES})")
def prior_bucket_bias(s, d):
    return vector_candidates(s, d).select("doc", "span", "cand", scoring.bucket_bias(F.col("p"), [0.25, 0.3, 0.5], [-0.5, 0.1, 0.2, 0.3]).alias("bias"))


@query()
def training_pairs(s, d):
    """Each brand's part names as positive words, negatives drawn by their frequency."""
    parts = read(s, d, "part")
    words = parts.select(F.col("p_brand").alias("entity"), F.explode(F.split("p_name", " ")).alias("word")).distinct()
    freq = parts.select(F.explode(F.split("p_name", " ")).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    intervals = reports.sample_intervals(freq, "word", "n", 0.6)
    total = intervals.agg(F.max("hi")).collect()[0][0] or 1.0
    return records.training_pairs(words, intervals, 5, total, max(total / 64, 1.0))


@query(f"""
WITH n AS (SELECT a.label AS entity, b.vec_id::VARCHAR AS word, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_dot('a.embedding', 'b.embedding')} DESC, b.vec_id) AS rank FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0 QUALIFY rank <= 5),
t AS (SELECT label AS entity, vec_id::VARCHAR AS word, 1 + vec_id % 3 AS tf FROM embeddings)
SELECT n.entity, n.word, n.rank, coalesce(tf, 0) AS tf FROM n LEFT JOIN t USING (entity, word)""")
def entity_neighbours_annotated(s, d):
    """The stated query set (ids divisible by 20) against all rows, with the words' counts."""
    rows = _vectors(s, d)
    near = vector_ops.top_products(rows.select("id", "vec").where("id % 20 = 0"), rows.select("id", "vec"), 5)
    labelled = near.join(rows.select(F.col("id").alias("query"), "label"), "query").select(F.col("label").alias("entity"), F.col("item").cast("string").alias("word"), "rank")
    freq = rows.select(F.col("label").alias("entity"), F.col("id").cast("string").alias("word"), (1 + F.col("id") % 3).alias("tf"))
    return vector_ops.annotated_neighbours(labelled, freq)


@query(f"""
WITH t AS (SELECT {', '.join(f'sum(embedding[{i + 1}]::DOUBLE) AS s{i}' for i in range(DIM))} FROM embeddings), u AS (SELECT [{', '.join(f's{i}' for i in range(DIM))}] AS v FROM t),
p AS (SELECT vec_id AS key, {_dot('embedding', 'v')} AS value FROM embeddings, u),
r AS (SELECT *, row_number() OVER (ORDER BY value DESC, key) AS a, row_number() OVER (ORDER BY value, key) AS b FROM p)
SELECT 'top' AS "end", a AS rank, key, round(value, 4) AS value FROM r WHERE a <= 10 UNION ALL SELECT 'bottom', b, key, round(value, 4) FROM r WHERE b <= 10""")
def partition_sum_extremes(s, d):
    """The report of the ten words of the highest and the lowest sums."""
    rows = _vectors(s, d)
    sums = vector_ops.partition_sums(rows, rows, DIM)
    return vector_ops.extremes(sums, "total", "id", 10).withColumn("value", F.round("value", 4))


@query(_votes("SELECT *, 1.0::DOUBLE AS weight FROM c QUALIFY count(*) OVER (PARTITION BY doc, span) = 1 OR local >= 0.5"))
def voters_above(s, d):
    """Candidates of spans with a single one, and those of a high local score, vote."""

    def voting(c):
        return scoring.voters(c, unambiguous=True).unionByName(scoring.voters(c, threshold=0.5)).dropDuplicates(["doc", "span", "cand"])

    return _voted(s, d, voting)


PAIRS = f"""
SELECT m.vec_id AS id, list({_dot('m.embedding', 'c.embedding')} ORDER BY j) AS s, list(ln(1.0::DOUBLE / (j + 2)) ORDER BY j) AS lp
FROM (SELECT vec_id, embedding, unnest(range(0, 4)) AS j FROM embeddings) m JOIN embeddings c ON c.vec_id = (7 * m.vec_id + 13 * j) % (SELECT max(vec_id) + 1 FROM embeddings) GROUP BY 1"""


@query(f"""
WITH p AS ({PAIRS}), z AS (SELECT *, list_transform(range(1, 5), lambda i: s[i] - lp[i]) AS zi, list_transform(range(1, 5), lambda i: s[i] - lp[i] - ln(3.0::DOUBLE)) AS zn FROM p)
SELECT id, round(list_sum(list_transform(range(2, 5), lambda i: greatest(0.0::DOUBLE, 0.1 - s[1] + s[i]))) / 4, 6) AS maxm,
  round((ln(1 + exp(-s[1])) + list_sum(list_transform(range(2, 5), lambda i: ln(1 + exp(s[i]))))) / 4, 6) AS neg,
  round((ln(1 + exp(-zn[1])) + list_sum(list_transform(range(2, 5), lambda i: ln(1 + exp(zn[i]))))) / 4, 6) AS nce,
  round(ln(list_sum(list_transform(zi, lambda v: exp(v)))) - zi[1], 6) AS "is" FROM z""")
def sampling_losses(s, d):
    """Each vector's products with four others, the first as its positive word."""
    cands = vector_candidates(s, d).withColumn("j", F.round(1 / F.col("p") - 2).cast("int"))
    own = _vectors(s, d).select(F.col("id").alias("span"), F.col("vec").alias("own"))
    rows = cands.join(own, "span").select("span", F.struct("j", vectors.dot(F.col("own"), F.col("vec")).alias("s"), F.ln("p").alias("lp")).alias("x"))
    lists = rows.groupBy(F.col("span").alias("id")).agg(F.array_sort(F.collect_list("x")).alias("xs")).select("id", F.transform("xs", lambda x: x["s"]).alias("s"), F.transform("xs", lambda x: x["lp"]).alias("lp"))
    return lists.select("id", *(F.round(scoring.sampling_loss(k, F.col("s"), F.col("lp")), 6).alias(k) for k in ("maxm", "neg", "nce", "is")))


@query(f"""
WITH c0 AS ({VECTOR_CANDIDATES}), c AS MATERIALIZED (SELECT doc, span, cand, p, ln(least(1.0::DOUBLE, greatest(1e-6::DOUBLE, p))) AS local, vec FROM c0), v AS (SELECT *, 1.0::DOUBLE AS weight FROM c WHERE local >= -1.2),
f AS (SELECT doc, span, i, sum(vec[i] * weight) AS x FROM (SELECT *, unnest(range(1, {DIM + 1})) AS i FROM v) GROUP BY ALL),
a AS (SELECT doc, i, sum(x) AS x FROM f GROUP BY ALL), k AS (SELECT DISTINCT doc, span FROM c),
o AS (SELECT k.doc, k.span, list(a.x - coalesce(f.x, 0) ORDER BY a.i) AS o FROM k JOIN a ON a.doc = k.doc LEFT JOIN f ON f.doc = k.doc AND f.span = k.span AND f.i = a.i GROUP BY ALL)
SELECT c.doc, c.span, c.cand, round(local + coalesce(list_dot_product(vec, o) / CASE WHEN list_dot_product(o, o) > 0 THEN sqrt(list_dot_product(o, o)) ELSE 1 END, 0), 6) AS score FROM c LEFT JOIN o ON o.doc = c.doc AND o.span = c.span""")
def assembled_scores(s, d):
    """The scorer named by its components: prior and global votes."""
    return scoring.assembled("pem_global", vector_candidates(s, d), dim=DIM, threshold=-1.2).select("doc", "span", "cand", F.round("score", 6).alias("score"))
