"""Queries of the span, context, matching and quality operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from glossweave.operators import coreference, decode, metrics, reports, spans
from glossweave.plans import annotate as flagship
from glossweave.plans import service, tables
from glossweave.plans.dictionary_queries import TOKENS
from glossweave.plans.tables import ANNOTATIONS, CANDIDATES, GOLD, PREDICTIONS, SAMPLES, read
from glossweave.sources import readers
from glossweave.streaming import stream

QUERIES: dict = {}
SQL: dict = {}
EPS = "1e-6::DOUBLE"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def predictions(s: SparkSession, d: str) -> DataFrame:
    best = decode.best_candidates(tables.span_candidates(s, d), ["doc", "span"], "score", "pos")
    return best.where("entity <> 0").select("doc", "begin", "end", "entity", "score")


@query(f"""
WITH e AS (SELECT DISTINCT mention, wikiName AS name, annotation_id FROM ({ANNOTATIONS})),
l AS (SELECT array_to_string(regexp_extract_all(mention, {TOKENS}), ' ') AS mention, i.entity FROM e JOIN (SELECT name, min(entity_id) AS entity FROM entity_names GROUP BY 1) i USING (name) WHERE mention IS NOT NULL),
c AS (SELECT mention, entity, count(*) AS n FROM l WHERE mention <> '' GROUP BY ALL),
pem AS (SELECT mention, entity, n / sum(n) OVER (PARTITION BY mention) AS p FROM c),
top AS (SELECT * FROM pem QUALIFY row_number() OVER (PARTITION BY mention ORDER BY p DESC, entity) = 1),
w AS (SELECT doc_id::VARCHAR AS doc, regexp_extract_all(text, {TOKENS}) AS ws FROM documents WHERE text IS NOT NULL),
b AS (SELECT doc, ws, unnest(range(0, len(ws))) AS b FROM w),
sp AS (SELECT doc, b, b + k AS e, array_to_string(ws[b + 1 : b + k], ' ') AS span FROM (SELECT *, unnest(range(1, least(10, len(ws) - b) + 1)) AS k FROM b)),
x AS (SELECT doc, list(DISTINCT struct_pack(s := p, b := b, e := e, i := entity)) AS xs FROM sp JOIN top ON mention = span WHERE NOT contains(mention, '.') GROUP BY 1),
y AS (SELECT doc, list_reduce(list_transform(list_reverse_sort(xs), lambda v: [v]), lambda acc, v: CASE WHEN len(list_filter(acc, lambda t: t.b < v[1].e AND v[1].b < t.e)) > 0 THEN acc ELSE list_concat(acc, v) END) AS ys FROM x),
z AS (SELECT doc, unnest(ys) AS t FROM y)
SELECT doc, t.b AS "begin", t.e AS "end", t.i AS entity, round(t.s, 6) AS score FROM z WHERE t.s >= 0.05""")
def annotate_corpus(s, d):
    return flagship.annotate_corpus(s, d)


@query(f"""
SELECT doc_id::VARCHAR || '&*' || (i - 1) AS chunk_id, regexp_extract_all(lines[i], {TOKENS}) AS words
FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents))
WHERE len(regexp_extract_all(lines[i], {TOKENS})) > 0""")
def chunk_paragraphs(s, d):
    return spans.chunks(read(s, d, "documents"), "doc_id", "text", by="paragraph")


@query(f"""
WITH p AS (SELECT doc_id, i - 1 AS par, regexp_extract_all(lines[i], {TOKENS}) AS w FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents))),
t AS (SELECT doc_id, par, unnest(range(1, len(w) + 1)) AS pos, unnest(w) AS tok FROM p),
n AS (SELECT *, coalesce(sum(CASE WHEN tok = '.' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, par ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS sent FROM t)
SELECT doc_id::VARCHAR || '&*' || par || '&*' || sent AS chunk_id, list(tok ORDER BY pos) AS words FROM n GROUP BY doc_id, par, sent""")
def chunk_sentences(s, d):
    return spans.chunks(read(s, d, "documents"), "doc_id", "text", by="sentence")


@query(f"""
WITH w AS (SELECT doc_id::VARCHAR AS key, regexp_extract_all(text, {TOKENS}) AS ws FROM documents),
t AS (SELECT key, unnest(range(0, len(ws))) AS b, unnest(ws) AS tok, len(ws) AS n FROM w),
s AS (SELECT key, b, tok, coalesce(min(CASE WHEN tok = '.' THEN b END) OVER (PARTITION BY key ORDER BY b ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), n) AS stop FROM t)
SELECT key, b AS "begin", least(stop, b + 10) - b AS spans, least(stop, b + 10) AS last_end FROM s WHERE tok <> '.' """)
def all_spans_bounded(s, d):
    """All spans of the corpus, told by their begins: how many there are and the last end."""
    made = spans.all_spans(spans.chunks(read(s, d, "documents"), "doc_id", "text", by="document"))
    return made.groupBy("key", "begin").agg(F.count("*").alias("spans"), F.max("end").alias("last_end"))


@query(f"""
WITH w AS (SELECT doc_id, regexp_extract_all(text, {TOKENS}) AS ws FROM documents WHERE text IS NOT NULL),
t AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS pos, unnest(ws) AS tok FROM w),
r AS (SELECT doc_id, tok, sum(CASE WHEN tok = '.' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM t),
l AS (SELECT doc_id, run, count(*) AS n FROM r WHERE tok <> '.' GROUP BY ALL)
SELECT doc_id::VARCHAR AS key, sum(CASE WHEN n >= 10 THEN 10 * n - 45 ELSE n * (n + 1) // 2 END)::BIGINT AS spans FROM l GROUP BY 1""")
def all_spans_count(s, d):
    made = spans.all_spans(spans.chunks(read(s, d, "documents"), "doc_id", "text", by="document"))
    return made.groupBy("key").agg(F.count("*").alias("spans"))


@query("""
WITH e AS (SELECT user_id, ts, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos FROM events),
f AS (SELECT *, CASE WHEN event_type IS NOT DISTINCT FROM lag(event_type) OVER w THEN 0 ELSE 1 END AS new FROM e WINDOW w AS (PARTITION BY user_id ORDER BY pos)),
g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY pos) AS island FROM f)
SELECT user_id AS key, event_type AS kind, min(pos) AS "begin", max(pos) + 1 AS "end" FROM g GROUP BY user_id, island, event_type""")
def bio_to_spans(s, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = read(s, d, "events").withColumn("pos", (F.row_number().over(w) - 1).cast("bigint"))
    return spans.tag_spans(rows.withColumn("tag", F.concat(F.lit("I-"), "event_type")), "user_id", "pos", "tag")


@query(f"""
SELECT doc, "begin", "end", entity, words[greatest("begin" - 100, 0) + 1 : "begin"] AS left_words, words["end" + 1 : "end" + 100] AS right_words
FROM (SELECT DISTINCT * FROM ({GOLD})) JOIN ({SAMPLES}) s USING (doc) WHERE s.words IS NOT NULL""")
def context_window(s, d):
    rows = tables.gold(s, d).distinct().join(tables.samples(s, d, "words").select("doc", "words"), "doc").where("words is not null")
    left, right = spans.contexts(F.col("words"), F.col("begin"), F.col("end"), 100)
    return rows.select("doc", "begin", "end", "entity", left.alias("left_words"), right.alias("right_words"))


@query(f"""
WITH r AS (SELECT doc, "begin", "end", entity, list_filter(words[1 : "begin"], lambda w: w <> 0) AS l, list_filter(words["end" + 1 :], lambda w: w <> 0) AS r
FROM (SELECT DISTINCT * FROM ({GOLD})) JOIN ({SAMPLES}) s USING (doc) WHERE s.words IS NOT NULL)
SELECT doc, "begin", "end", entity, l[greatest(len(l) - 10, 0) + 1 :] AS left_words, r[1 : 10] AS right_words FROM r""")
def packed_context(s, d):
    rows = tables.gold(s, d).distinct().join(tables.samples(s, d, "words").select("doc", "words"), "doc").where("words is not null")
    left, right = spans.packed_context(F.col("words"), F.col("begin"), F.col("end"), lambda w: w != 0, 10)
    return rows.select("doc", "begin", "end", "entity", left.alias("left_words"), right.alias("right_words"))


@query(f"""
WITH t AS (SELECT doc_id, unnest(range(0, len(ws))) AS pos, unnest(ws) AS token FROM (SELECT doc_id, regexp_extract_all(text, {TOKENS}) AS ws FROM documents WHERE text IS NOT NULL)),
v AS (SELECT token, row_number() OVER (ORDER BY count(*) DESC, token) AS id FROM t GROUP BY 1 HAVING count(*) >= 3)
SELECT doc_id AS key, pos, coalesce(v.id, 0)::BIGINT AS token_id FROM t LEFT JOIN v USING (token)""")
def vocab_encode(s, d):
    rows = spans.token_rows(read(s, d, "documents"), "doc_id", "text")
    return spans.encoded(rows, spans.vocabulary(rows, least=3)).select("key", "pos", "token_id")


@query(f"""
SELECT c.doc, c.span, c.pos, c.entity, (g.entity IS NOT NULL)::BIGINT AS label
FROM ({CANDIDATES}) c LEFT JOIN (SELECT DISTINCT * FROM ({GOLD})) g ON g.doc = c.doc AND g."begin" = c."begin" AND g."end" = c."end" AND g.entity = c.entity""")
def label_candidates(s, d):
    gold = tables.gold(s, d).distinct().withColumn("hit", F.lit(1))
    rows = tables.span_candidates(s, d).join(gold, ["doc", "begin", "end", "entity"], "left")
    return rows.select("doc", "span", "pos", "entity", F.coalesce("hit", F.lit(0)).cast("bigint").alias("label"))


@query(f"""
SELECT doc, count(*) AS cands, count(*) FILTER (WHERE entity IN (SELECT entity_id FROM entity_names)) AS kept FROM ({CANDIDATES}) GROUP BY 1""")
def universe_filter(s, d):
    known = read(s, d, "entity_names").select(F.col("entity_id").alias("entity"), F.lit(1).alias("k")).distinct()
    rows = tables.span_candidates(s, d).join(known, "entity", "left")
    return rows.groupBy("doc").agg(F.count("*").alias("cands"), F.count("k").alias("kept"))


@query("""
WITH l AS (SELECT doc_id, i - 1 AS line_no, lines[i] AS line FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents))),
m AS (SELECT doc_id, line_no, line, unnest(regexp_extract_all(line, 'MMSTART_(\\d+)', 1))::BIGINT AS e FROM l)
SELECT DISTINCT doc_id, line_no, regexp_replace(line, 'MM(START_\\d+|END) ?', '', 'g') AS clean FROM m WHERE e IN (SELECT entity_id FROM entity_names)""")
def relevance_filter(s, d):
    lines = read(s, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    marks = F.transform(F.regexp_extract_all("line", F.lit(r"MMSTART_(\d+)"), F.lit(1)), lambda m: m.cast("bigint"))
    ids = lines.select("doc_id", F.col("line_no").cast("bigint").alias("line_no"), "line", F.explode(marks).alias("entity_id"))
    kept = ids.join(read(s, d, "entity_names").select("entity_id").distinct(), "entity_id", "left_semi")
    return kept.select("doc_id", "line_no", F.regexp_replace("line", r"MM(START_\d+|END) ?", "").alias("clean")).distinct()


@query(f"""
SELECT doc, span, "begin", "end", entity, score FROM ({CANDIDATES}) WHERE score IS NOT NULL AND NOT isnan(score)
QUALIFY row_number() OVER (PARTITION BY doc, span ORDER BY score DESC, pos) = 1""")
def argmax_candidate(s, d):
    best = decode.best_candidates(tables.span_candidates(s, d), ["doc", "span"], "score", "pos")
    return best.select("doc", "span", "begin", "end", "entity", "score")


@query(f"""
WITH x AS (SELECT doc, list(DISTINCT struct_pack(s := score, b := "begin", e := "end", i := entity)) AS xs FROM ({PREDICTIONS}) GROUP BY 1),
y AS (SELECT doc, list_reduce(list_transform(list_reverse_sort(xs), lambda v: [v]), lambda acc, v: CASE WHEN len(list_filter(acc, lambda t: t.b < v[1].e AND v[1].b < t.e)) > 0 THEN acc ELSE list_concat(acc, v) END) AS ys FROM x),
z AS (SELECT doc, unnest(ys) AS t FROM y)
SELECT doc, t.s AS score, t.b AS "begin", t.e AS "end", t.i AS entity FROM z""")
def greedy_non_overlap(s, d):
    return decode.greedy(predictions(s, d))


P, G = f"p AS ({PREDICTIONS})", f"g AS (SELECT DISTINCT * FROM ({GOLD}))"
WEAK = 'EXISTS (SELECT 1 FROM g WHERE g.doc = p.doc AND g.entity = p.entity AND g."begin" < p."end" AND p."begin" < g."end")'
STRONG = 'EXISTS (SELECT 1 FROM g WHERE g.doc = p.doc AND g.entity = p.entity AND g."begin" = p."begin" AND p."end" = g."end")'
GSCORE = """gs AS (SELECT g.doc, g."begin", g."end", g.entity, coalesce(max(p.score), -10000.0::DOUBLE) AS score FROM g LEFT JOIN p ON g.doc = p.doc AND g.entity = p.entity AND g."begin" < p."end" AND p."begin" < g."end" GROUP BY ALL)"""


@query(f"WITH {P}, {G} SELECT *, {STRONG} AS matched FROM p")
def strong_match(s, d):
    return metrics.strong_matched(predictions(s, d), tables.gold(s, d))


@query(f"WITH {P}, {G} SELECT *, {WEAK} AS matched FROM p")
def weak_overlap_match(s, d):
    return metrics.weak_matched(predictions(s, d), tables.gold(s, d))


@query(f"WITH {P}, {G}, {GSCORE} SELECT * FROM gs")
def fn_best_score(s, d):
    return metrics.gold_scores(predictions(s, d), tables.gold(s, d))


CONF = f"""{P}, {G}, {GSCORE}, c AS (
  SELECT doc, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn FROM (
    SELECT doc, m::INT AS tp, (NOT m)::INT AS fp, 0 AS fn FROM (SELECT doc, {WEAK} AS m FROM p WHERE score >= 0.2)
    UNION ALL SELECT doc, 0, 0, 1 FROM gs WHERE score < 0.2) GROUP BY 1)"""


@query(f"WITH {CONF} SELECT * FROM c")
def doc_confusion(s, d):
    return metrics.confusion(predictions(s, d), tables.gold(s, d), 0.2)


@query(f"""
WITH {P}, {G}, {GSCORE}
SELECT doc, "begin", "end", entity, score, CASE WHEN {WEAK} THEN 'tp' ELSE 'fp' END AS outcome FROM p WHERE score >= 0.2
UNION ALL SELECT doc, "begin", "end", entity, score, 'fn' FROM gs WHERE score < 0.2""")
def prediction_report(s, d):
    preds, gold = predictions(s, d), tables.gold(s, d)
    return reports.prediction_report(metrics.weak_matched(preds, gold), metrics.gold_scores(preds, gold), 0.2)


def _f1_sql(by: str = "") -> str:
    group, head = (f"GROUP BY {by}", f"{by}, ") if by else ("", "")
    return f"""
SELECT {head}tp, fp, fn, round(macro_p, 6) AS macro_p, round(macro_r, 6) AS macro_r, round(micro_p, 6) AS micro_p, round(micro_r, 6) AS micro_r,
  round(2 * micro_p * micro_r / (micro_p + micro_r + {EPS}), 6) AS micro_f1, round(2 * macro_p * macro_r / (macro_p + macro_r + {EPS}), 6) AS macro_f1
FROM (SELECT *, tp / (tp + fp + {EPS}) AS micro_p, tp / (tp + fn + {EPS}) AS micro_r FROM (
  SELECT {head}sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn, avg(tp / (tp + fp + {EPS})) AS macro_p, avg(tp / (tp + fn + {EPS})) AS macro_r FROM c {group}))"""


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in df.columns if c[:5] in ("macro", "micro")})


@query(f"WITH {CONF} {_f1_sql()}")
def micro_macro_f1(s, d):
    return _rounded(metrics.micro_macro(doc_confusion(s, d)))


SWEEP = f"""
WITH {P}, {G}, {GSCORE}, m AS (SELECT score, {WEAK} AS m FROM p),
st AS (SELECT score, sum(t) AS t, sum(f) AS f, sum(g) AS g FROM (
  SELECT score, m::INT AS t, (NOT m)::INT AS f, 0 AS g FROM m UNION ALL SELECT score, 0, 0, 1 FROM gs) GROUP BY 1),
sw AS (SELECT score AS threshold, (sum(t) OVER w)::BIGINT AS tp, (sum(f) OVER w)::BIGINT AS fp, (sum(g) OVER () - sum(g) OVER w)::BIGINT AS fn FROM st WINDOW w AS (ORDER BY score DESC)),
f AS (SELECT *, tp / (tp + fp + {EPS}) AS pr, tp / (tp + fn + {EPS}) AS rc FROM sw)
SELECT threshold, tp, fp, fn, round(2 * pr * rc / (pr + rc + {EPS}), 6) AS f1 FROM f"""


@query(SWEEP)
def threshold_sweep(s, d):
    return metrics.threshold_sweep(predictions(s, d), tables.gold(s, d)).withColumn("f1", F.round("f1", 6))


VALID = "string_split(doc, '/')[3] = '0'"


@query(f"""
WITH t AS (SELECT threshold FROM ({SWEEP.replace('WITH ' + P, f'WITH p AS (SELECT * FROM ({PREDICTIONS}) WHERE {VALID})', 1).replace(G, f'g AS (SELECT DISTINCT * FROM ({GOLD}) WHERE {VALID})', 1).replace("round(2 * pr * rc / (pr + rc + " + EPS + "), 6)", "2 * pr * rc / (pr + rc + " + EPS + ")")}) ORDER BY f1 DESC, threshold DESC LIMIT 1),
{CONF.replace(P, f'p AS (SELECT * FROM ({PREDICTIONS}) WHERE NOT {VALID})', 1).replace(G, f'g AS (SELECT DISTINCT * FROM ({GOLD}) WHERE NOT {VALID})', 1).replace("0.2", "(SELECT threshold FROM t)").replace("c AS (", "c0 AS (", 1)},
c AS (SELECT *, string_split(doc, '/')[2] AS dataset FROM c0)
SELECT *, round((SELECT threshold FROM t), 6) AS threshold FROM ({_f1_sql('dataset')})""")
def metrics_per_dataset(s, d):
    """The first pass over the chunks chooses the threshold, the others are evaluated."""
    part = F.split("doc", "/")
    rows = metrics.per_dataset(predictions(s, d), tables.gold(s, d), F.get(part, 1), F.get(part, 2) == "0")
    return _rounded(rows).withColumn("threshold", F.round("threshold", 6))


@query(f"SELECT * FROM ({SWEEP}) ORDER BY f1 DESC, threshold DESC LIMIT 1")
def optimal_threshold(s, d):
    swept = metrics.threshold_sweep(predictions(s, d), tables.gold(s, d)).withColumn("f1", F.round("f1", 6))
    return swept.orderBy(F.desc("f1"), F.desc("threshold")).limit(1)


RECALL = f"""
WITH c AS ({CANDIDATES}), {G}
SELECT g.*, CASE WHEN NOT EXISTS (SELECT 1 FROM c WHERE c.doc = g.doc AND c."begin" = g."begin" AND c."end" = g."end") THEN 'no_span'
  WHEN NOT EXISTS (SELECT 1 FROM c WHERE c.doc = g.doc AND c."begin" = g."begin" AND c."end" = g."end" AND c.entity = g.entity) THEN 'no_entity' ELSE 'hit' END AS outcome, g."end" - g."begin" > 10 AS too_wide FROM g"""


@query(RECALL)
def recall_miss_listing(s, d):
    return metrics.candidate_recall(tables.gold(s, d), tables.span_candidates(s, d))


@query(f"SELECT outcome, count(*) AS mentions, count_if(too_wide)::BIGINT AS too_wide, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM ({RECALL}) GROUP BY 1")
def candidate_recall(s, d):
    rows = recall_miss_listing(s, d)
    total = rows.agg(F.count("*").alias("t"))
    return rows.groupBy("outcome").agg(F.count("*").alias("mentions"), F.count_if("too_wide").alias("too_wide")).join(F.broadcast(total)).select("outcome", "mentions", "too_wide", F.round(F.col("mentions") / F.col("t"), 6).alias("share"))


LOGGED = """SELECT DISTINCT log_id, chunk_id, span_num, cand_pos, cand_entity, gt_entity, final_score FROM fp_weak_log
WHERE cand_entity IS NOT NULL AND gt_entity IS NOT NULL AND cand_pos IS NOT NULL"""


def _logged(s: SparkSession, d: str) -> DataFrame:
    rows = read(s, d, "fp_weak_log").select("log_id", "chunk_id", "span_num", "cand_pos", "cand_entity", "gt_entity", "final_score").distinct()
    return rows.where("cand_entity is not null and gt_entity is not null and cand_pos is not null")


@query(f"""
SELECT bucket, count(*) AS mentions, sum(r)::BIGINT AS "right", round(sum(r) / count(*), 6) AS accuracy FROM (
  SELECT ((1.0 / (cand_pos + 1) >= 0.2)::INT + (1.0 / (cand_pos + 1) >= 0.4)::INT + (1.0 / (cand_pos + 1) >= 0.9)::INT)::BIGINT AS bucket, (cand_entity = gt_entity)::INT AS r FROM ({LOGGED})) GROUP BY 1""")
def prior_buckets(s, d):
    rows = _logged(s, d).select((1.0 / (F.col("cand_pos") + 1)).alias("p"), (F.col("cand_entity") == F.col("gt_entity")).alias("ok"))
    return reports.bucket_accuracy(rows, "p", [0.2, 0.4, 0.9], "ok").withColumn("accuracy", F.round("accuracy", 6))


@query(f"""
WITH l AS ({LOGGED}), f AS (SELECT gt_entity, count(*) AS n FROM l GROUP BY 1)
SELECT bucket, count(*) AS mentions, sum(r)::BIGINT AS "right", round(sum(r) / count(*), 6) AS accuracy FROM (
  SELECT ((n >= 1)::INT + (n >= 2)::INT + (n >= 6)::INT + (n >= 11)::INT + (n >= 51)::INT)::BIGINT AS bucket, (cand_entity = l.gt_entity)::INT AS r FROM l JOIN f USING (gt_entity)) GROUP BY 1""")
def freq_buckets(s, d):
    rows = _logged(s, d)
    freq = rows.groupBy("gt_entity").agg(F.count("*").alias("n"))
    marked = rows.join(freq, "gt_entity").select("n", (F.col("cand_entity") == F.col("gt_entity")).alias("ok"))
    return reports.bucket_accuracy(marked, "n", [1, 2, 6, 11, 51], "ok").withColumn("accuracy", F.round("accuracy", 6))


@query(f"""
WITH c AS ({CANDIDATES}), g AS (SELECT DISTINCT * FROM ({GOLD})), w AS (SELECT doc, "begin", "end", entity, max(score) >= 0.2 AS kept FROM ({PREDICTIONS}) GROUP BY ALL),
m AS (SELECT g.doc, g."begin", g."end", g.entity, min(pos) AS pos FROM g JOIN c ON c.doc = g.doc AND c."begin" = g."begin" AND c."end" = g."end" AND c.entity = g.entity GROUP BY ALL),
b AS (SELECT CASE WHEN pos <= 0 THEN 0 WHEN pos <= 1 THEN 1 WHEN pos <= 2 THEN 2 WHEN pos <= 7 THEN 7 WHEN pos <= 200 THEN 200 END::BIGINT AS upto, w.kept FROM m LEFT JOIN w USING (doc, "begin", "end", entity))
SELECT upto, count(*) AS mentions, round(avg(coalesce(kept, false)::INT), 6) AS solved, round(avg((kept IS NOT NULL)::INT), 6) AS winner FROM b WHERE upto IS NOT NULL GROUP BY 1""")
def gold_position_buckets(s, d):
    won = predictions(s, d).select("doc", "begin", "end", "entity", (F.col("score") >= 0.2).alias("kept"))
    out = metrics.gold_position_buckets(tables.gold(s, d), tables.span_candidates(s, d), won, [0, 1, 2, 7, 200])
    return out.withColumns({"solved": F.round("solved", 6), "winner": F.round("winner", 6)})


SPANWISE = """
SELECT chunk_id, span_num, max(gt_entity) AS gold, max_by(cand_entity, struct_pack(s := coalesce(final_score, -1e9::FLOAT), p := -cand_pos, i := -log_id)) FILTER (WHERE ok) AS system, max_by(cand_entity, struct_pack(p := -cand_pos, i := -log_id)) FILTER (WHERE ok) AS base, count_if(ok) > 0 AS has
FROM (SELECT *, cand_entity IS NOT NULL AND cand_entity <> 0 AND cand_pos IS NOT NULL AND (final_score IS NULL OR NOT isnan(final_score)) AS ok FROM (SELECT DISTINCT log_id, chunk_id, span_num, cand_pos, cand_entity, gt_entity, final_score FROM fp_weak_log WHERE gt_entity IS NOT NULL)) GROUP BY chunk_id, span_num"""


@query(f"""
WITH m AS (SELECT *, coalesce(system = gold, false) AS r, coalesce(base = gold, false) AS b FROM ({SPANWISE})),
a AS (SELECT count_if(r) AS "right", count_if(has) AS with_cands, count(*) AS total, count_if(r AND b) AS "both", count_if(r AND NOT b) AS system_only, count_if(b AND NOT r) AS baseline_only, count_if(NOT r AND NOT b) AS neither FROM m)
SELECT "right"::BIGINT AS "right", with_cands::BIGINT AS with_cands, total, "both"::BIGINT AS "both", system_only::BIGINT AS system_only, baseline_only::BIGINT AS baseline_only, neither::BIGINT AS neither,
  round("right" / with_cands, 6) AS "precision", round("right" / total, 6) AS recall, round(2 * ("right" / with_cands) * ("right" / total) / nullif("right" / with_cands + "right" / total, 0), 6) AS f1 FROM a""")
def baseline_agreement(s, d):
    """Logged spans; those whose candidates are all unknown have none."""
    log = read(s, d, "fp_weak_log").select("log_id", "chunk_id", "span_num", "cand_pos", "cand_entity", "gt_entity", "final_score").distinct().where("gt_entity is not null")
    ok = F.expr("cand_entity is not null and cand_entity <> 0 and cand_pos is not null and (final_score is null or not isnan(final_score))")
    score = F.struct(F.coalesce("final_score", F.lit(-1e9).cast("float")), -F.col("cand_pos"), -F.col("log_id"))
    rows = log.withColumns({"ok": ok, "by_score": F.when(ok, score), "by_place": F.when(ok, F.struct(-F.col("cand_pos"), -F.col("log_id")))})
    by_span = rows.groupBy("chunk_id", "span_num").agg(F.max("gt_entity").alias("gold"), F.max_by("cand_entity", "by_score").alias("system"), F.max_by("cand_entity", "by_place").alias("base"), F.max("ok").alias("has"))
    out = metrics.mention_accuracy(by_span, "system", "gold", "has", "base")
    return out.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


@query(f"""
WITH {P}, {G}, j AS (SELECT p.*, g."begin" AS given_begin, g."end" AS given_end, abs(p."begin" - g."begin") + abs(p."end" - g."end") AS distance FROM (SELECT DISTINCT * FROM p) p JOIN (SELECT DISTINCT doc, "begin", "end" FROM g) g ON g.doc = p.doc)
SELECT * FROM j QUALIFY row_number() OVER (PARTITION BY doc, "begin", "end", entity, score ORDER BY distance, given_begin, given_end) = 1""")
def nearest_boundary(s, d):
    return decode.nearest_given(predictions(s, d).distinct(), tables.gold(s, d).select("doc", "begin", "end").distinct())


@query(f'WITH {P} SELECT DISTINCT * FROM p QUALIFY row_number() OVER (PARTITION BY doc, entity ORDER BY "begin", "end", score DESC) = 1')
def response_once_per_entity(s, d):
    rows = predictions(s, d).withColumn("neg", -F.col("score"))
    return decode.first_of_each(rows, ["doc", "entity"], ["begin", "end", "neg"]).drop("neg")


@query('''
SELECT item_id, text, length(text)::BIGINT AS chars, '[[0,' || least(5, length(text)) || ',"' || item_id || '"]]' AS response FROM eval_items WHERE text IS NOT NULL''')
def request_json_roundtrip(s, d):
    items = read(s, d, "eval_items").where("text is not null")
    asked = items.select("item_id", F.to_json(F.struct("text", F.array(F.struct(F.lit(0).alias("start"), F.least(F.lit(5), F.length("text")).alias("length"))).alias("spans"))).alias("value"))
    got = readers.requests(asked)
    given = got.select("item_id", F.explode("spans").alias("s")).select("item_id", "s.start", "s.length", F.col("item_id").cast("string").alias("title"))
    return got.select("item_id", "text", F.length("text").cast("bigint").alias("chars")).join(decode.responses(given, "item_id"), "item_id")


PIECES = r"'[\p{L}\p{N}]+|[^\s\p{L}\p{N}]|\s+'"
OFFSETS = f'''
SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY i) - 1 AS pos, stop - length(t) AS start, stop FROM (
  SELECT *, sum(length(t)) OVER (PARTITION BY doc ORDER BY i) AS stop FROM (SELECT doc, unnest(range(1, len(ps) + 1)) AS i, unnest(ps) AS t FROM (SELECT doc_id::VARCHAR AS doc, regexp_extract_all(text, {PIECES}) AS ps FROM documents)))
WHERE NOT regexp_matches(t, '^\\s')'''


@query(f'''
WITH a AS ({SQL["annotate_corpus"]}), o AS MATERIALIZED ({OFFSETS}), n AS (SELECT entity_id, max(name) AS name FROM entity_names GROUP BY 1),
r AS (SELECT a.doc, f.start::BIGINT AS s, (l.stop - f.start)::BIGINT AS n, replace(n.name, ' ', '_') AS t FROM a JOIN o f ON f.doc = a.doc AND f.pos = a."begin" JOIN o l ON l.doc = a.doc AND l.pos = a."end" - 1 JOIN n ON n.entity_id = a.entity)
SELECT doc, '[' || string_agg('[' || s || ',' || n || ',' || to_json(t) || ']', ',' ORDER BY s, n, t) || ']' AS response FROM r GROUP BY 1''')
def annotate_response(s, d):
    '''The answer to each text: [start, length, title] in characters of every annotation.'''
    return flagship.annotate_response(s, d)


@query(f'''
WITH a AS ({SQL["annotate_response"].replace("documents", "(SELECT item_id AS doc_id, text FROM eval_items WHERE item_id % 2 = 0)")}), i AS (SELECT item_id::VARCHAR AS doc, item_id, text FROM eval_items WHERE text IS NOT NULL),
l AS (SELECT DISTINCT mention, wikiName, annotation_id FROM ({ANNOTATIONS}) WHERE mention IS NOT NULL), n AS (SELECT name, min(entity_id) AS entity FROM entity_names GROUP BY 1),
c AS (SELECT array_to_string(regexp_extract_all(mention, {TOKENS}), ' ') AS mention, entity, count(*) AS k FROM l JOIN n ON name = wikiName GROUP BY ALL), top AS (SELECT * FROM c WHERE mention <> '' QUALIFY row_number() OVER (PARTITION BY mention ORDER BY k DESC, entity) = 1),
g AS (SELECT doc, s, n, array_to_string(regexp_extract_all(text[s + 1 : s + n], {TOKENS}), ' ') AS mention FROM (SELECT doc, text, unnest([4, 0]) AS s, unnest([8, 20]) AS n FROM i WHERE item_id % 2 = 1)),
t AS (SELECT g.doc, s, n, replace(max(e.name), ' ', '_') AS t FROM g JOIN top USING (mention) JOIN entity_names e ON e.entity_id = top.entity GROUP BY ALL),
b AS (SELECT doc, '[' || string_agg('[' || s || ',' || n || ',' || to_json(t) || ']', ',' ORDER BY s, n, t) || ']' AS response FROM t GROUP BY 1)
SELECT i.doc, coalesce(a.response, b.response, '[]') AS response FROM i LEFT JOIN a ON a.doc = i.doc LEFT JOIN b ON b.doc = i.doc''')
def request_answers(s, d):
    '''Requests of both kinds, by turns: texts alone, and texts with two spans to resolve.'''
    given = F.expr("array(named_struct('start', 4, 'length', 8), named_struct('start', 0, 'length', 20))")
    items = read(s, d, "eval_items").where("text is not null")
    asked = items.select("item_id", F.to_json(F.struct("text", F.when(F.col("item_id") % 2 == 1, given).alias("spans"))).alias("value"))
    return service.answers(asked, "item_id", "value", *service.prepared(s, d))


@query(f'''
WITH o AS ({OFFSETS.replace("doc_id::VARCHAR AS doc", "item_id::VARCHAR AS doc").replace("FROM documents", "FROM eval_items")}), g AS (SELECT item_id::VARCHAR AS doc, unnest([3, 9, 20]) AS edge FROM eval_items),
c AS (SELECT o.*, list_sort(list_concat([start::BIGINT], coalesce((SELECT list(DISTINCT edge::BIGINT) FROM g WHERE g.doc = o.doc AND edge > start AND edge < stop), []), [stop::BIGINT])) AS b FROM o),
p AS (SELECT doc, b[i] AS start, b[i + 1] AS stop FROM (SELECT *, unnest(range(1, len(b))) AS i FROM c))
SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY start) - 1 AS pos, start, stop FROM p''')
def tokens_split_at_spans(s, d):
    '''Tokens of the passages, cut where a given span begins or ends inside one.'''
    items = read(s, d, "eval_items")
    given = items.select(F.col("item_id").cast("string").alias("doc"), F.explode(F.expr("array(named_struct('s', 3L, 'n', 6L), named_struct('s', 9L, 'n', 11L))")).alias("g")).select("doc", F.col("g.s").alias("start"), F.col("g.n").alias("length"))
    return spans.split_at(spans.token_offsets(items, "item_id", "text"), given).select("doc", "pos", F.col("start").cast("bigint").alias("start"), F.col("stop").cast("bigint").alias("stop"))


@query(f'''
WITH r AS (SELECT doc, "begin", "end", entity, words, list_concat(range("begin" - 5, "begin"), range("end", "end" + 5)) AS i FROM (SELECT DISTINCT * FROM ({GOLD})) JOIN ({SAMPLES}) s USING (doc) WHERE s.words IS NOT NULL)
SELECT doc, "begin", "end", entity, list_transform(i, lambda x: greatest(0, least(x, len(words) - 1))) AS places, list_transform(i, lambda x: x >= 0 AND x < len(words)) AS mask FROM r''')
def attention_window(s, d):
    rows = tables.gold(s, d).distinct().join(tables.samples(s, d, "words").select("doc", "words"), "doc").where("words is not null")
    places, mask = spans.window_mask(F.col("words"), F.col("begin"), F.col("end"), 5)
    return rows.select("doc", "begin", "end", "entity", places.alias("places"), mask.alias("mask"))


@query(f'''
WITH r AS (SELECT doc, "begin", "end", entity, words[1 : "begin"] AS l, words["end" + 1 :] AS r FROM (SELECT DISTINCT * FROM ({GOLD})) JOIN ({SAMPLES}) s USING (doc) WHERE s.words IS NOT NULL),
k AS (SELECT doc, "begin", "end", entity, list_filter(l, lambda w, i: w <> 0 OR i = 1) AS l, list_filter(r, lambda w, i: w <> 0 OR i = len(r)) AS r FROM r)
SELECT doc, "begin", "end", entity, l[greatest(len(l) - 10, 0) + 1 :] AS left_words, r[1 : 10] AS right_words FROM k''')
def packed_context_boundary(s, d):
    '''Unknown words are passed over, but for the first and the last word of the text.'''
    rows = tables.gold(s, d).distinct().join(tables.samples(s, d, "words").select("doc", "words"), "doc").where("words is not null")
    left, right = spans.packed_context(F.col("words"), F.col("begin"), F.col("end"), lambda w: w != 0, 10, boundary=True)
    return rows.select("doc", "begin", "end", "entity", left.alias("left_words"), right.alias("right_words"))


@query(f"""
WITH m AS (SELECT doc, mention, wikiName AS entity, count(*) AS n FROM ({ANNOTATIONS}) WHERE doc IS NOT NULL AND mention <> '' AND wikiName IS NOT NULL GROUP BY ALL),
c AS (SELECT doc, mention, entity, n / sum(n) OVER (PARTITION BY doc, mention) AS p FROM m),
t AS (SELECT *, first_value(entity) OVER (PARTITION BY doc, mention ORDER BY p DESC, entity) NOT LIKE '%(%' AS person FROM c),
l AS (SELECT DISTINCT doc, mention AS holder FROM t WHERE person AND contains(mention, ' ')),
k AS (SELECT DISTINCT s.doc, s.mention, l.holder FROM (SELECT DISTINCT doc, mention FROM t) s JOIN l ON l.doc = s.doc AND (starts_with(l.holder, s.mention || ' ') OR ends_with(l.holder, ' ' || s.mention))),
u AS (SELECT k.doc, k.mention, t.entity, sum(t.p) / max(h.n) AS p FROM k JOIN t ON t.doc = k.doc AND t.mention = k.holder JOIN (SELECT doc, mention, count(*) AS n FROM k GROUP BY ALL) h ON h.doc = k.doc AND h.mention = k.mention GROUP BY ALL),
a AS (SELECT doc, mention, entity, p FROM t WHERE (doc, mention) NOT IN (SELECT (doc, mention) FROM k) UNION ALL SELECT * FROM u)
SELECT doc, mention, entity, round(p, 6) AS p FROM a QUALIFY row_number() OVER (PARTITION BY doc, mention ORDER BY p DESC, entity) <= 100""")
def coref_merge_setbased(s, d):
    rows = tables.annotations(s, d).where("doc is not null and mention <> '' and wikiName is not null")
    n = rows.groupBy("doc", "mention", F.col("wikiName").alias("entity")).agg(F.count("*").alias("n"))
    whole = Window.partitionBy("doc", "mention")
    cands = n.withColumn("p", F.col("n") / F.sum("n").over(whole)).withColumn("person", ~F.first("entity").over(whole.orderBy(F.desc("p"), "entity")).contains("("))
    return coreference.by_document(cands.select("doc", "mention", "entity", "p", "person")).withColumn("p", F.round("p", 6))


@query()
def coref_sequential(s, d):
    rows = tables.annotations(s, d).where("doc is not null and mention is not null and wikiName is not null and m_offset is not null and m_length is not null")
    one = rows.groupBy("doc", F.col("m_offset").alias("begin"), (F.col("m_offset") + F.col("m_length")).alias("end"), "mention").agg(F.min("wikiName").alias("id"))
    cands = F.array(F.struct("id", F.lit(1.0).alias("p"), (~F.col("id").contains("(")).alias("person")))
    out = coreference.sequential(one.select("doc", "begin", "end", "mention", cands.alias("cands")))
    return out.select("doc", "begin", "end", "mention", "super", F.transform("cands", lambda c: c["id"]).alias("ids"))


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY AS window_end, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def q_str_tumbling(s, d):
    return stream.tumbling(read(s, d, "events"), "ts", "1 day", ["event_type"], "value").withColumn("total", F.round("total", 4))


@query("""
SELECT b AS window_start, b + INTERVAL 2 DAY AS window_end, event_type, count(*) AS n, round(sum(value), 4) AS total FROM (
  SELECT *, time_bucket(INTERVAL 1 DAY, ts) - (k * INTERVAL 1 DAY) AS b FROM (SELECT *, unnest([0, 1]) AS k FROM events)) GROUP BY ALL""")
def q_str_sliding(s, d):
    return stream.sliding(read(s, d, "events"), "ts", "2 days", "1 day", ["event_type"], "value").withColumn("total", F.round("total", 4))


@query("""
WITH f AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM f)
SELECT min(ts) AS session_start, max(ts) + INTERVAL 6 HOUR AS session_end, user_id, count(*) AS n, round(sum(value), 4) AS total FROM g GROUP BY user_id, k""")
def q_str_session(s, d):
    return stream.sessions(read(s, d, "events"), "ts", "6 hours", ["user_id"], "value").withColumn("total", F.round("total", 4))


@query("""
SELECT count(*) AS "rows", count_if(mention IS NULL)::BIGINT AS no_mention, count_if(wikiName IS NULL OR trim(wikiName) = '')::BIGINT AS no_name, count_if(m_length IS NULL)::BIGINT AS no_length,
  count_if(coalesce(length(mention) <> m_length, false))::BIGINT AS wrong_length FROM annotations""")
def quality_counters(s, d):
    checks = {"no_mention": F.col("mention").isNull(), "no_name": F.col("wikiName").isNull() | (F.trim("wikiName") == ""), "no_length": F.col("m_length").isNull(), "wrong_length": F.length("mention") != F.col("m_length")}
    return reports.quality_counters(read(s, d, "annotations"), checks)

