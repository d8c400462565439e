"""Queries of the readers and writers: a format is written from the test tables and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossweave.functions import text
from glossweave.operators import dictionary as D
from glossweave.operators import lookup, records, reports, spans
from glossweave.plans import dictionary_queries, span_queries, tables
from glossweave.plans.dictionary_queries import ENT_TITLE, LINK_COUNTS, O, RECORDS, TITLE, TOKENS
from glossweave.plans.tables import GOLD, SAMPLES, part_counts, read
from glossweave.sources import readers, writers
from glossweave.streaming.shared import shared_folder

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _folder(s: SparkSession) -> str:
    return f"{shared_folder(s)}/format-{uuid.uuid4().hex}"


def _written(rows: DataFrame, *fields: str | F.Column) -> str:
    """The folder of a tab-separated file of the fields."""
    path = _folder(rows.sparkSession)
    rows.select(F.concat_ws("\t", *fields).alias("value")).write.text(path)
    return path


def _names_file(s: SparkSession, d: str) -> str:
    """name⇥id in line order, with a line of three fields and one whose id is no number."""
    rows = read(s, d, "entity_names").select("line_no", "name", F.col("entity_id").cast("string").alias("i"))
    bad = s.createDataFrame([(10**12, "three fields", "1\tmore"), (10**12 + 1, "no number", "x")], "line_no bigint, name string, i string")
    return _written(rows.where("name is not null and i is not null").unionByName(bad).orderBy("line_no"), "name", "i")


KEPT_NAMES = "SELECT name, entity_id, row_number() OVER (ORDER BY line_no) - 1 AS n FROM entity_names WHERE name IS NOT NULL AND entity_id IS NOT NULL"


@query("SELECT old_title, new_title FROM redirects WHERE old_title IS NOT NULL AND new_title IS NOT NULL")
def src_redirects(s, d):
    rows = read(s, d, "redirects").where("old_title is not null and new_title is not null")
    bad = s.createDataFrame([("one field", None), ("three\tfields", "here")], "old_title string, new_title string")
    return readers.redirects(s, _written(rows.unionByName(bad), "old_title", "new_title"))


@query(f"SELECT count(*) + 2 AS lines, 1::BIGINT AS bad_arity, 1::BIGINT AS bad_id, (count(*) - count(DISTINCT name))::BIGINT AS repeated FROM ({KEPT_NAMES})")
def src_line_counters(s, d):
    return readers.line_counters(s, _names_file(s, d), (2,), 1)


@query("SELECT entity_id, name AS title FROM entity_names WHERE name IS NOT NULL AND entity_id IS NOT NULL")
def src_disambiguations(s, d):
    rows = read(s, d, "entity_names").where("name is not null and entity_id is not null")
    return readers.disambiguations(s, _written(rows, F.col("entity_id").cast("string"), "name"))


@query(f"SELECT name, max_by(entity_id, n) AS entity_id FROM ({KEPT_NAMES}) WHERE entity_id NOT IN (SELECT cand_entity FROM fp_weak_log WHERE cand_entity IS NOT NULL) GROUP BY 1")
def src_names(s, d):
    excluded = read(s, d, "fp_weak_log").select(F.col("cand_entity").alias("entity_id")).where("entity_id is not null")
    return readers.names(s, _names_file(s, d), excluded).select("name", "entity_id")


@query(f"SELECT entity_id, max_by(name, n) AS name FROM ({KEPT_NAMES}) GROUP BY 1")
def src_names_by_id(s, d):
    return readers.names_by_id(s, _names_file(s, d))


def _persons(s: SparkSession, d: str) -> tuple[str, DataFrame]:
    typed = read(s, d, "annotations").select("mention").where("mention is not null")
    return _written(typed, "mention"), read(s, d, "entity_names").select("name", "entity_id").distinct()


@query(r"SELECT DISTINCT n.name, n.entity_id FROM (SELECT DISTINCT regexp_replace(mention, '^\s+|\s+$', '', 'g') AS name FROM annotations WHERE mention IS NOT NULL) m JOIN entity_names n USING (name) WHERE m.name <> ''")
def src_persons(s, d):
    return readers.persons(s, *_persons(s, d))


@query(r"SELECT DISTINCT regexp_replace(mention, '^\s+|\s+$', '', 'g') AS name FROM annotations WHERE mention IS NOT NULL AND regexp_replace(mention, '^\s+|\s+$', '', 'g') NOT IN (SELECT name FROM entity_names WHERE name IS NOT NULL) AND regexp_replace(mention, '^\s+|\s+$', '', 'g') <> ''")
def src_unknown_persons(s, d):
    return readers.unknown_persons(s, *_persons(s, d))


@query(f"""
WITH c AS (SELECT mention, replace(entity, 'Brand#', '')::BIGINT AS entity_id, replace(entity, ' ', '_') AS name, n FROM ({O}))
SELECT mention, (sum(n) OVER (PARTITION BY mention))::BIGINT AS total, row_number() OVER (PARTITION BY mention ORDER BY n DESC, entity_id, name) - 1 AS pos, entity_id, n::DOUBLE AS score, name FROM c""")
def src_dictionary(s, d):
    path = _folder(s)
    rows = part_counts(s, d, "O").select("mention", F.regexp_replace("entity", "Brand#", "").cast("bigint").alias("entity_id"), F.col("entity").alias("name"), "n")
    writers.write_dictionary(rows, path, "n", 1000)
    return readers.dictionary(s, path)


@query(f"""
WITH c AS (SELECT mention, replace(entity, 'Brand#', '')::BIGINT AS entity_id, replace(entity, ' ', '_') AS name FROM ({O}))
SELECT mention, count(*) OVER (PARTITION BY mention) AS total, row_number() OVER (PARTITION BY mention ORDER BY entity_id, name) - 1 AS pos, entity_id, name FROM c""")
def src_dictionary_unscored(s, d):
    path = _folder(s)
    rows = part_counts(s, d, "O").select("mention", F.regexp_replace("entity", "Brand#", "").cast("bigint").alias("entity_id"), F.col("entity").alias("name"))
    writers.write_dictionary(rows, path, None, 1000)
    return readers.dictionary(s, path, scored=False).drop("score")


@query(f"""
WITH m AS (SELECT {ENT_TITLE.format(x='new_title')} AS s, translate(replace(replace(old_title, '&amp;', '&'), '&quot;', '"'), '_' || chr(160), '  ') AS mention FROM redirects WHERE old_title IS NOT NULL AND new_title IS NOT NULL)
SELECT mention, upper(s[1]) || s[2:] AS name FROM m""")
def src_means(s, d):
    rows = read(s, d, "redirects").where("old_title is not null and new_title is not null")
    return readers.means(s, _written(rows, F.concat(F.lit('"'), F.col("old_title"), F.lit('"')), "new_title"))


DUMP_LINES = "SELECT doc_id, doc_name, unnest(range(1, len(ls) + 1)) AS i, ls FROM (SELECT doc_id, doc_name, string_split(regexp_replace(text, '\\r', '', 'g'), chr(10)) AS ls FROM documents WHERE text IS NOT NULL)"


@query(f"SELECT doc_id, nullif(replace(coalesce(doc_name, ''), '\"', ''), '') AS title, ls[i] AS line FROM ({DUMP_LINES}) WHERE NOT regexp_matches(ls[i], '^</?doc[ >]')")
def src_wiki_dump(s, d):
    """The corpus as a dump of many files, each of many documents."""
    docs = read(s, d, "documents").where("text is not null")
    title = F.regexp_replace(F.coalesce("doc_name", F.lit("")), '"', "")
    head = F.concat(F.lit('<doc id="'), F.col("doc_id").cast("string"), F.lit('" url="" title="'), title, F.lit('">'))
    path = _folder(s)
    docs.select(F.concat_ws("\n", head, F.regexp_replace("text", "\r", ""), F.lit("</doc>")).alias("value")).write.text(path)
    return readers.wiki_dump(s, path).select("doc_id", "title", "line")


@query(f"SELECT doc_id, title, i - 1 AS place, line FROM (SELECT doc_id, nullif(replace(coalesce(doc_name, ''), '\"', ''), '') AS title, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS i, ls[i] AS line FROM ({DUMP_LINES}) WHERE NOT regexp_matches(ls[i], '^</?doc[ >]'))")
def src_wiki_dump_order(s, d):
    """The dump's lines in their order."""
    from pyspark.sql.window import Window

    docs = read(s, d, "documents").where("text is not null")
    title = F.regexp_replace(F.coalesce("doc_name", F.lit("")), '"', "")
    head = F.concat(F.lit('<doc id="'), F.col("doc_id").cast("string"), F.lit('" url="" title="'), title, F.lit('">'))
    path = _folder(s)
    docs.select(F.concat_ws("\n", head, F.regexp_replace("text", "\r", ""), F.lit("</doc>")).alias("value")).write.text(path)
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("line_no")) - 1
    return readers.wiki_dump(s, path).select("doc_id", "title", place.cast("bigint").alias("place"), "line")


@query(f"""
SELECT sample_id::VARCHAR AS doc, unnest(range(0, len(ws))) AS pos, unnest(ws) AS word, 'O' AS bio FROM (SELECT sample_id, regexp_extract_all(text, {TOKENS}) AS ws FROM lang_samples)""")
def src_conll(s, d):
    """Token rows of one column, a document after the other."""
    rows = read(s, d, "lang_samples").select(F.concat_ws("\n", F.concat(F.lit("-DOCSTART- ("), F.col("sample_id").cast("string"), F.lit(")")), F.lit(""), F.array_join(text.tokens(F.col("text")), "\n")).alias("value"))
    path = _folder(s)
    rows.write.text(path)
    return readers.conll(s, path).select("doc", "pos", "word", "bio")


@query(f"""
WITH g AS (SELECT doc, min(struct_pack(b := "begin", e := "end", i := entity)) AS m FROM (SELECT * FROM ({GOLD}) WHERE "begin" < "end") GROUP BY 1)
SELECT s.doc, list_transform(words, lambda w: w::VARCHAR) AS words, g.m.b AS gold_begin, g.m.e AS gold_end, g.m.i::VARCHAR AS gold_entity
FROM ({SAMPLES}) s JOIN g ON g.doc = s.doc WHERE words IS NOT NULL AND len(words) >= g.m.e""")
def src_token_stream(s, d):
    """Samples as token streams with their first gold mention, written and read back."""
    gold = tables.gold(s, d).where("begin < end").groupBy("doc").agg(F.min(F.struct("begin", "end", "entity")).alias("m"))
    docs = tables.samples(s, d, "words").select("doc", "words").where("words is not null").join(gold, "doc").where(F.size("words") >= F.col("m.end"))
    rows = docs.select("doc", F.transform("words", lambda w: w.cast("string")).alias("words"), F.array(F.struct(F.col("m.begin").alias("begin"), F.col("m.end").alias("end"), F.col("m.entity").cast("string").alias("entity"))).alias("gold"))
    path = _folder(s)
    writers.write_token_stream(rows, path)
    back = spans.parsed_stream(readers.token_stream(s, path))
    return back.select("doc", "words", F.get("gold", 0)["begin"].alias("gold_begin"), F.get("gold", 0)["end"].alias("gold_end"), F.get("gold", 0)["entity"].alias("gold_entity"))


@query("SELECT vec_id AS word, embedding AS vec FROM embeddings")
def src_text_vectors(s, d):
    path = _folder(s)
    writers.vectors_as_text(read(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))).write.text(path)
    return readers.text_vectors(s, path, "bigint")


@query("SELECT DISTINCT span_num AS q, cand_entity AS e1, gt_entity AS e2, (cand_entity = gt_entity)::INT AS label FROM fp_weak_log WHERE span_num IS NOT NULL AND cand_entity IS NOT NULL AND gt_entity IS NOT NULL AND span_num >= 0 AND cand_entity >= 0 AND gt_entity >= 0")
def src_relatedness(s, d):
    rows = read(s, d, "fp_weak_log").where("span_num >= 0 and cand_entity >= 0 and gt_entity >= 0").select("span_num", "cand_entity", "gt_entity").distinct()
    line = F.format_string("%d qid:%d 1:0.5 2:0.25 # %d-%d and more", (F.col("cand_entity") == F.col("gt_entity")).cast("int"), "span_num", "cand_entity", "gt_entity")
    path = _folder(s)
    rows.select(line.alias("value")).write.text(path)
    return readers.relatedness(s, path)


IDS = "SELECT DISTINCT entity_id FROM entity_names WHERE entity_id IS NOT NULL"


@query(f"SELECT CASE WHEN entity_id = 1 THEN 0 ELSE entity_id END AS entity_id, row_number() OVER (ORDER BY entity_id) - 1 AS row FROM ({IDS})")
def src_id_map(s, d):
    from glossweave.operators import ordered

    ids = read(s, d, "entity_names").select("entity_id").where("entity_id is not null").distinct().withColumn("one", F.lit(1).cast("bigint"))
    path = _folder(s)
    writers.write_id_maps(ordered.running(ids, [F.col("entity_id")], {"row": "one"}).select("entity_id", (F.col("row") - 1).alias("row")), path)
    return readers.id_map(s, f"{path}/by_id")


@query("SELECT DISTINCT cand_entity AS id FROM fp_weak_log WHERE cand_entity IS NOT NULL")
def src_universe(s, d):
    path = _folder(s)
    writers.write_table(read(s, d, "fp_weak_log").select("cand_entity", "log_id").where("cand_entity is not null"), path)
    return readers.universe(s, path)


@query("SELECT sample_mode AS mode, pass_no::VARCHAR AS dataset, count(*) AS n, sum(len(words))::BIGINT AS words FROM encoded_samples WHERE sample_mode IS NOT NULL AND pass_no IS NOT NULL GROUP BY ALL")
def snk_samples(s, d):
    """Samples written by mode and data set and counted from what was written."""
    path = _folder(s)
    rows = read(s, d, "encoded_samples").where("sample_mode is not null and pass_no is not null")
    writers.write_samples(rows.withColumns({"mode": F.col("sample_mode"), "dataset": F.concat(F.lit("p"), F.col("pass_no").cast("string"))}), path)
    back = s.read.parquet(path)
    return back.groupBy("mode", F.substr("dataset", F.lit(2)).alias("dataset")).agg(F.count("*").alias("n"), F.sum(F.when(F.col("words").isNotNull(), F.size("words"))).alias("words"))


@query(f"SELECT entity, sum(n)::BIGINT AS freq FROM ({LINK_COUNTS}) GROUP BY 1 HAVING sum(n) >= 2")
def snk_frequency_table(s, d):
    path = _folder(s)
    writers.frequency_table(D.entity_frequency(D.mention_counts(dictionary_queries._links(s, d))), path, "freq", 2)
    return readers.frequency_table(s, path).select(F.col("name").alias("entity"), F.col("n").alias("freq"))


@query("SELECT annotation_id::VARCHAR AS doc, m_offset AS \"begin\", m_offset + m_length AS \"end\", mention AS anchor, 'http://e/' || annotation_id AS ref FROM (SELECT DISTINCT annotation_id, mention, m_offset, m_length FROM annotations WHERE mention IS NOT NULL AND m_offset IS NOT NULL AND m_length IS NOT NULL)")
def snk_nif(s, d):
    rows = read(s, d, "annotations").select("annotation_id", "mention", "m_offset", "m_length").distinct().where("mention is not null and m_offset is not null and m_length is not null")
    own = rows.select(F.col("annotation_id").cast("string").alias("doc"), F.col("m_offset").alias("begin"), (F.col("m_offset") + F.col("m_length")).alias("end"), F.col("mention").alias("anchor"), F.concat(F.lit("http://e/"), F.col("annotation_id").cast("string")).alias("ref"))
    path = _folder(s)
    writers.nif_lines(own).select("value").write.text(path)
    return readers.nif(s, path).select(F.regexp_extract("subject", "^(.*)#char=", 1).alias("doc"), "begin", "end", "anchor", "ref")


@query("SELECT vec_id::VARCHAR AS token, row_number() OVER (ORDER BY n DESC, vec_id::VARCHAR) AS id FROM (SELECT vec_id, 1 + vec_id % 7 AS n FROM embeddings)")
def snk_vocabulary(s, d):
    path = _folder(s)
    tokens = read(s, d, "embeddings").select(F.col("vec_id").cast("string").alias("token"), F.explode(F.sequence(F.lit(0), F.col("vec_id") % 7)))
    writers.write_vocabulary(spans.vocabulary(tokens), path)
    return s.read.parquet(path).select("token", "id")


@query("""
SELECT doc_id::VARCHAR AS key, CASE WHEN length(text) >= 13 THEN ' MMSTART_7 ' || text[1:5] || ' MMEND ' || text[6:10] || ' MMSTART_8 ' || text[11:13] || ' MMEND ' || text[14:]
  WHEN length(text) >= 5 THEN ' MMSTART_7 ' || text[1:5] || ' MMEND ' || text[6:] ELSE text END AS inline FROM documents WHERE text IS NOT NULL""")
def splice_inline(s, d):
    """Three annotations a text: one at its begin, one that overlaps it, one further on."""
    docs = read(s, d, "documents").select(F.col("doc_id").cast("string").alias("doc"), "text")
    marks = F.expr("array(named_struct('s', 0, 'n', 5, 'e', '7'), named_struct('s', 3, 'n', 4, 'e', '9'), named_struct('s', 10, 'n', 3, 'e', '8'))")
    given = docs.select("doc", F.explode(marks).alias("m")).select("doc", "m.s", "m.n", "m.e")
    # Where the first leaves the text, the second may fit: it is kept out by the same test.
    given = given.join(docs.select("doc", F.length("text").alias("_n")), "doc").where("_n >= 5 or s = 0").drop("_n")
    return spans.spliced(docs, "doc", "text", given, "s", "n", "e")


@query(f"SELECT log, gold, coalesce(nullif(list_position(list_transform(cands, lambda c: c.id), gold), 0), -1)::BIGINT AS gold_pos FROM ({RECORDS})")
def gold_rank(s, d):
    return records.with_gold_position(dictionary_queries.mention_records(s, d)).select("log", "gold", "gold_pos")


LOG = "SELECT user_id::VARCHAR AS run, count(*) AS n, round(avg(value), 2) AS p, round(max(value), 2) AS r, round(min(value), 2) AS f FROM events WHERE user_id IS NOT NULL GROUP BY 1"


def _log(s: SparkSession, d: str) -> DataFrame:
    """Training logs, one file a user: an evaluation with its threshold and figures."""
    e = read(s, d, "events").where("user_id is not null").groupBy(F.col("user_id").cast("string").alias("run")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 2).alias("p"), F.round(F.max("value"), 2).alias("r"), F.round(F.min("value"), 2).alias("f"))
    num = lambda c: F.format_string("%.2f", F.abs(c))
    figures = F.concat(F.lit("micro P: "), num("p"), F.lit(" R: "), num("r"), F.lit(" F1: "), num("f"))
    body = F.array(F.lit("starting"), F.concat(F.lit("args.eval_cnt =  "), F.col("n").cast("string")), F.lit("Evaluating EL datasets"), F.concat(F.lit("Best validation threshold = "), num("p"), F.lit(" with F1="), num("f")), F.lit("set-one"), figures, F.regexp_replace(figures, "micro", "macro"))
    path = _folder(s)
    e.select("run", F.array_join(body, "\n").alias("value")).write.partitionBy("run").text(path)
    return readers.lines(s, path).withColumn("run", F.regexp_extract("file", r"run=([^/]+)/", 1))


@query(f"""
SELECT run, n AS eval_cnt, 'EL' AS mode, 'set-one' AS dataset, unnest(['micro', 'macro']) AS average, abs(p) AS p, abs(r) AS r, abs(f) AS f1 FROM ({LOG})""")
def experiment_log_scan(s, d):
    return reports.experiment_rows(_log(s, d))


@query(f"SELECT run, abs(p) AS threshold, abs(f) AS f1 FROM ({LOG})")
def threshold_log_scan(s, d):
    return reports.thresholds(_log(s, d)).select("run", "threshold", "f1")


@query(f"""
WITH n AS (SELECT name, max(entity_id) AS id FROM entity_names GROUP BY 1), l AS (SELECT lower(name) AS name, max(entity_id) AS id FROM entity_names GROUP BY 1),
w AS (SELECT DISTINCT upper(name) AS typed, string_split(upper(name), '') AS cs FROM entity_names WHERE name IS NOT NULL), t AS (SELECT typed, {TITLE.format(x='cs')} AS title FROM w)
SELECT typed, coalesce(n0.id, n1.id, l.id) AS entity_id FROM t LEFT JOIN n n0 ON n0.name = typed LEFT JOIN n n1 ON n1.name = title LEFT JOIN l ON l.name = lower(typed)""")
def name_fallback_chain(s, d):
    """Names in capitals: as they are, in title case, at last in lower case."""
    names = read(s, d, "entity_names")
    typed = names.where("name is not null").select(F.upper("name").alias("typed")).distinct()
    none = s.createDataFrame([], "old_title string, new_title string")
    return lookup.resolved(typed, "typed", names, none).select("typed", "entity_id")


@query(f"""
WITH p AS (SELECT DISTINCT wikiName AS uri FROM annotations WHERE wikiName IS NOT NULL), s AS (SELECT uri, {ENT_TITLE.format(x="regexp_extract(url_decode(uri), '([^/]*)$', 1)")} AS s FROM p)
SELECT uri, upper(s[1]) || s[2:] AS title FROM s""")
def uri_titles(s, d):
    rows = read(s, d, "annotations").select(F.col("wikiName").alias("uri")).where("uri is not null").distinct()
    return rows.select("uri", text.uri_title(F.col("uri")).alias("title"))


@query(f"""
WITH o AS (SELECT item_id::VARCHAR AS doc, unnest(range(1, len(ps) + 1)) AS i, unnest(ps) AS t FROM (SELECT item_id, regexp_extract_all(text, {span_queries.PIECES}) AS ps FROM eval_items)),
p AS (SELECT doc, t, sum(length(t)) OVER (PARTITION BY doc ORDER BY i) - length(t) AS start, i FROM o)
SELECT doc, list(start::INT ORDER BY i) AS places FROM p WHERE NOT regexp_matches(t, '^\\s') GROUP BY 1""")
def token_places(s, d):
    """Where the words of every passage begin in its text."""
    return read(s, d, "eval_items").select(F.col("item_id").cast("string").alias("doc"), text.token_places(text.tokens(F.col("text")), F.col("text")).alias("places")).where(F.size("places") > 0)


@query("""
WITH s AS (SELECT chunk_id, sample_mode, pass_no, min(words) AS w FROM encoded_samples WHERE words IS NOT NULL AND len(words) > 0 AND chunk_id IS NOT NULL GROUP BY ALL),
n AS (SELECT *, row_number() OVER (ORDER BY chunk_id, sample_mode, pass_no) - 1 AS i FROM s), b AS (SELECT *, i // 16 AS batch, max(len(w)) OVER (PARTITION BY i // 16) AS m FROM n)
SELECT batch, i % 16 AS place, chunk_id, sample_mode, pass_no, len(w)::INT AS length, list_concat(w, list_transform(range(0, m - len(w)), lambda x: 0)) AS words FROM b""")
def padded_batches(s, d):
    rows = read(s, d, "encoded_samples").where("words is not null and size(words) > 0 and chunk_id is not null").groupBy("chunk_id", "sample_mode", "pass_no").agg(F.min("words").alias("words"))
    return records.padded_batches(rows, ["chunk_id", "sample_mode", "pass_no"], "words", 16)


@query(f"SELECT doc, string_agg(CASE outcome WHEN 'tp' THEN '+' WHEN 'fp' THEN '!' ELSE '-' END || ' [' || \"begin\" || ',' || \"end\" || ') ' || entity, chr(10) ORDER BY \"begin\", \"end\", entity, outcome) AS value FROM ({span_queries.SQL['prediction_report']}) GROUP BY 1")
def prediction_report_text(s, d):
    return writers.report_text(span_queries.prediction_report(s, d))


@query("SELECT old_title, max(new_title) AS new_title FROM redirects WHERE old_title IN (SELECT old_title FROM redirects GROUP BY 1 HAVING count(DISTINCT new_title) = 1) GROUP BY 1")
def reversed_redirects(s, d):
    """The map of new titles turned round, of those old titles that have a single one."""
    rows = read(s, d, "redirects").where("old_title is not null")
    single = rows.groupBy("old_title").agg(F.count_distinct("new_title").alias("n")).where("n = 1")
    return lookup.reversed_map(rows.join(single, "old_title", "left_semi"), "new_title", "old_title")


@query("SELECT item_id, text AS surface, 0 AS \"offset\", 'http://e/' || item_id AS uri FROM eval_items WHERE text IS NOT NULL")
def src_annotator_answers(s, d):
    """Answers of an annotator in its two shapes, by turns."""
    items = read(s, d, "eval_items").where("text is not null")
    one = F.to_json(F.struct(F.array(F.struct(F.concat(F.lit("http://e/"), F.col("item_id").cast("string")).alias("@URI"), F.col("text").alias("@surfaceForm"), F.lit("0").alias("@offset"), F.lit("").alias("@types"))).alias("Resources")))
    uri = F.struct(F.concat(F.lit("http://e/"), F.col("item_id").cast("string")).alias("@uri"), F.lit("").alias("@types"))
    two = F.to_json(F.struct(F.struct(F.array(F.struct(F.col("text").alias("@name"), F.lit("0").alias("@offset"), uri.alias("resource"))).alias("surfaceForm")).alias("annotation")))
    rows = items.select(F.when(F.col("item_id") % 2 == 0, one).otherwise(two).alias("value"))
    return readers.annotator_answers(rows).select(F.regexp_extract("uri", r"(\d+)$", 1).cast("bigint").alias("item_id"), "surface", "offset", "uri")


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50")
def best_runs_listing(s, d):
    """The fifty best runs, in order."""
    return reports.ordered_runs(read(s, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey").limit(50)


