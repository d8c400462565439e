"""Queries of the dictionary, lookup and frequency operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossweave.functions import text
from glossweave.operators import dictionary as D
from glossweave.operators import lookup, records, reports
from glossweave.plans import tables
from glossweave.plans.tables import ANNOTATIONS, part_counts, part_counts_sql, read
from glossweave.sources import readers, writers

QUERIES: dict = {}
SQL: dict = {}
O, W = part_counts_sql("O"), part_counts_sql("F")
TOKENS = r"'[\p{L}\p{N}]+|[^\s\p{L}\p{N}]'"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _links(s: SparkSession, d: str) -> DataFrame:
    return tables.annotations(s, d).select("mention", F.col("wikiName").alias("entity"))


LINKS = f"SELECT mention, wikiName AS entity FROM ({ANNOTATIONS})"
LINK_COUNTS = f"SELECT mention, entity, count(*) AS n FROM ({LINKS}) WHERE mention IS NOT NULL AND entity IS NOT NULL GROUP BY ALL"
TITLE = "array_to_string(list_transform(range(1, len({x}) + 1), lambda i: CASE WHEN i = 1 OR NOT regexp_matches({x}[i - 1], '\\p{{L}}') THEN upper({x}[i]) ELSE lower({x}[i]) END), '')"


@query(LINK_COUNTS)
def mention_entity_counts(s, d):
    return D.mention_counts(_links(s, d))


@query(f"SELECT mention, entity, round(n / sum(n) OVER (PARTITION BY mention), 6) AS p FROM ({O})")
def conditional_prior(s, d):
    return D.conditional(part_counts(s, d, "O")).withColumn("p", F.round("p", 6))


@query(f"""
WITH u AS (SELECT mention, entity, sum(n)::BIGINT AS n FROM (({O}) UNION ALL ({W})) GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY mention ORDER BY n DESC, entity) AS rank FROM u QUALIFY rank <= 3)
SELECT mention, entity, n, rank, round(n / sum(n) OVER (PARTITION BY mention), 6) AS p FROM k""")
def merge_top_k_renorm(s, d):
    out = D.merged_counts([part_counts(s, d, "O"), part_counts(s, d, "F")], k=3)
    return out.withColumn("p", F.round("p", 6))


@query("SELECT mention, entity, round(1.0::DOUBLE / count(*) OVER (PARTITION BY mention), 6) AS p FROM (SELECT DISTINCT p_name AS mention, p_brand AS entity FROM part)")
def uniform_prior(s, d):
    return D.uniform(read(s, d, "part").select(F.col("p_name").alias("mention"), F.col("p_brand").alias("entity"))).withColumn("p", F.round("p", 6))


def _p(counts: str) -> str:
    return f"SELECT mention, entity, n / sum(n) OVER (PARTITION BY mention) AS p FROM ({counts})"


@query(f"SELECT mention, entity, round(least(1.0::DOUBLE, coalesce(a.p, 0) + coalesce(b.p, 0)), 6) AS p FROM ({_p(O)}) a FULL JOIN ({_p(W)}) b USING (mention, entity)")
def outer_merge_cap(s, d):
    a, b = (D.conditional(part_counts(s, d, x)) for x in "OF")
    return D.outer_merged(a, b).withColumn("p", F.round("p", 6))


@query(f"SELECT array_to_string(regexp_extract_all(mention, {TOKENS}), ' ') AS mention, entity, sum(n)::BIGINT AS n FROM ({LINK_COUNTS}) GROUP BY ALL")
def retokenize_merge(s, d):
    return D.rekeyed(D.mention_counts(_links(s, d)), F.array_join(text.tokens(F.col("mention")), " "))


@query(f"""
SELECT mention, r AS retokenised, r <> mention AS changed FROM (
  SELECT mention, CASE WHEN len(string_split(mention, ' ')) > 1 THEN array_to_string(regexp_extract_all(mention, {TOKENS}), ' ') ELSE mention END AS r
  FROM (SELECT DISTINCT mention FROM annotations WHERE mention IS NOT NULL))""")
def retokenize_keys(s, d):
    return D.retokenised(read(s, d, "annotations").select("mention").where("mention is not null").distinct())


@query("""
WITH l AS (SELECT p_name AS mention, month(l_shipdate)::BIGINT AS line_no, count(*) AS freq, min(p_brand) AS entity FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)
SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY mention ORDER BY freq DESC, line_no) = 1""")
def dedup_mention_max_freq(s, d):
    rows = read(s, d, "lineitem").join(read(s, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    lists = rows.groupBy(F.col("p_name").alias("mention"), F.month("l_shipdate").cast("bigint").alias("line_no")).agg(F.count("*").alias("freq"), F.min("p_brand").alias("entity"))
    return D.one_list_a_mention(lists, "freq", "line_no")


@query(f"""
WITH p AS ({_p(LINK_COUNTS)}),
low AS (SELECT lower(mention) AS mention, entity, max(p) AS p FROM p WHERE lower(mention) NOT IN (SELECT mention FROM p) GROUP BY ALL)
SELECT mention, entity, round(p, 6) AS p, row_number() OVER (PARTITION BY mention ORDER BY p DESC, entity) AS rank FROM low QUALIFY rank <= 30""")
def lowercase_dictionary(s, d):
    return D.lowercase(D.conditional(D.mention_counts(_links(s, d))), 30).withColumn("p", F.round("p", 6))


@query(f"SELECT entity, sum(n)::BIGINT AS freq FROM ({LINK_COUNTS}) GROUP BY 1 HAVING sum(n) >= 10")
def entity_freq_having(s, d):
    return D.entity_frequency(D.mention_counts(_links(s, d)), 10)


@query(f"""
WITH f AS (SELECT entity, sum(n)::BIGINT AS freq FROM ({LINK_COUNTS}) GROUP BY 1)
SELECT entity, freq FROM f WHERE freq >= 2 ORDER BY freq DESC, entity LIMIT 20 OFFSET 1""")
def most_frequent_entities(s, d):
    return D.most_frequent(D.entity_frequency(D.mention_counts(_links(s, d))), top=20, least=2, skip=1)


@query(f"""
WITH f AS (SELECT sum(n) AS freq FROM ({LINK_COUNTS}) GROUP BY entity),
b AS (SELECT CASE WHEN freq >= 50 THEN 50.0 WHEN freq >= 20 THEN 20.0 WHEN freq >= 10 THEN 10.0 WHEN freq >= 5 THEN 5.0 WHEN freq >= 2 THEN 2.0 ELSE 1.0 END::DOUBLE AS edge, count(*) AS n FROM f GROUP BY 1)
SELECT edge, n, (sum(n) OVER (ORDER BY edge DESC))::BIGINT AS at_least, round(sum(n) OVER (ORDER BY edge DESC) / sum(n) OVER (), 6) AS share FROM b""")
def freq_histogram_cum(s, d):
    freq = D.entity_frequency(D.mention_counts(_links(s, d)))
    return reports.histogram(freq, "freq", [1.0, 2.0, 5.0, 10.0, 20.0, 50.0]).withColumn("share", F.round("share", 6))


@query(f"""
WITH a AS ({_p(O)}), b AS ({_p(W)})
SELECT mention, entity, round(a.p, 6) AS p_a, round(b.p, 6) AS p_b,
  CASE WHEN b.p IS NULL THEN 'only_a' WHEN a.p IS NULL THEN 'only_b' WHEN abs(a.p - b.p) > 1e-6 THEN 'differs' ELSE 'same' END AS status
FROM a FULL JOIN b USING (mention, entity)""")
def dict_compare(s, d):
    a, b = (D.conditional(part_counts(s, d, x)) for x in "OF")
    return D.compared(a, b, 1e-6).withColumns({"p_a": F.round("p_a", 6), "p_b": F.round("p_b", 6)})


@query(f"""
WITH c AS ({O}), t AS (SELECT mention, sum(n)::BIGINT AS total FROM c GROUP BY 1),
e AS (SELECT mention, string_agg(replace(entity, 'Brand#', '') || ',' || n || ',' || replace(entity, ' ', '_'), chr(9) ORDER BY n DESC, replace(entity, 'Brand#', '')::BIGINT, entity) AS es FROM c GROUP BY 1)
SELECT mention || chr(9) || total || chr(9) || es AS value FROM t JOIN e USING (mention)""")
def dictionary_lines(s, d):
    rows = part_counts(s, d, "O").select("mention", F.regexp_replace("entity", "Brand#", "").cast("bigint").alias("entity_id"), F.col("entity").alias("name"), "n")
    return writers.dictionary_lines(rows, "n", 1000)


@query(f"""
SELECT token AS term, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, {TOKENS})) AS token FROM documents) GROUP BY 1""")
def word_freq(s, d):
    return read(s, d, "documents").select(F.explode(text.tokens(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))


@query("SELECT c AS term, count(*) AS n FROM (SELECT unnest(string_split(text, '')) AS c FROM documents) WHERE c <> '' GROUP BY 1")
def char_freq(s, d):
    return read(s, d, "documents").select(F.explode(text.chars(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))


@query(f"SELECT doc_id AS id, doc_name AS name, array_to_string(regexp_extract_all(text, {TOKENS}), ' ') AS words FROM documents WHERE len(regexp_extract_all(text, {TOKENS})) > 0")
def page_words(s, d):
    docs = read(s, d, "documents")
    words = docs.select(F.col("doc_id").alias("id"), F.posexplode(text.tokens(F.col("text"))).alias("pos", "word"))
    return writers.canonical_words(words, docs.select(F.col("doc_id").alias("id"), F.col("doc_name").alias("name")))[0]


@query(f"SELECT doc_id AS id, doc_name AS name FROM documents WHERE text IS NULL OR len(regexp_extract_all(text, {TOKENS})) = 0")
def empty_pages(s, d):
    docs = read(s, d, "documents")
    words = docs.select(F.col("doc_id").alias("id"), F.posexplode(text.tokens(F.col("text"))).alias("pos", "word"))
    return writers.canonical_words(words, docs.select(F.col("doc_id").alias("id"), F.col("doc_name").alias("name")))[1]


STOPS = ", ".join(f"'{w}'" for w in text.STOP_WORDS)


@query(f"""
SELECT doc_id, word, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9]+')) AS word FROM documents)
WHERE len(word) > 1 AND TRY_CAST(word AS DOUBLE) IS NULL AND lower(word) NOT IN ({STOPS}) GROUP BY ALL""")
def term_freq_no_stop(s, d):
    words = read(s, d, "documents").select("doc_id", F.explode(text.alnum_words(F.col("text"))).alias("word"))
    return words.where(text.is_content_word(F.col("word"))).groupBy("doc_id", "word").agg(F.count("*").alias("tf"))


@query(f"""
WITH t AS (SELECT token, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, {TOKENS})) AS token FROM documents) GROUP BY 1),
p AS (SELECT token, n, n / (SELECT sum(n) FROM t) AS p FROM t)
SELECT token AS term, n, round(p, 9) AS p, round(ln(p), 6) AS log_p, round(pow(p, 0.75), 9) AS p_power FROM p""")
def unigram_prob(s, d):
    out = reports.unigram(word_freq(s, d))
    return out.withColumns({"p": F.round("p", 9), "log_p": F.round("log_p", 6), "p_power": F.round("p_power", 9)})


@query(f"""
WITH f AS (SELECT entity, sum(n) AS freq FROM ({LINK_COUNTS}) GROUP BY 1),
c AS (SELECT entity, pow(greatest(freq, 5)::DOUBLE, 0.6) AS s, sum(pow(greatest(freq, 5)::DOUBLE, 0.6)) OVER (ORDER BY entity ROWS UNBOUNDED PRECEDING) AS hi FROM f)
SELECT entity, round(hi - s, 4) AS lo, round(hi, 4) AS hi FROM c""")
def prefix_intervals(s, d):
    freq = D.entity_frequency(D.mention_counts(_links(s, d)))
    return reports.sample_intervals(freq, "entity", "freq", 0.6, 5).withColumns({"lo": F.round("lo", 4), "hi": F.round("hi", 4)})


@query(f"""
WITH f AS (SELECT entity, sum(n) AS freq FROM ({O}) GROUP BY 1),
c AS (SELECT entity, sum(freq) OVER (ORDER BY entity ROWS UNBOUNDED PRECEDING) - freq AS lo, sum(freq) OVER (ORDER BY entity ROWS UNBOUNDED PRECEDING) AS hi FROM f)
SELECT event_id, entity FROM events JOIN c ON (event_id * 7919) % (SELECT sum(freq) FROM f) >= lo AND (event_id * 7919) % (SELECT sum(freq) FROM f) < hi""")
def weighted_lookup(s, d):
    freq = D.entity_frequency(part_counts(s, d, "O"))
    total = freq.agg(F.sum("freq").alias("total"))
    draws = read(s, d, "events").join(F.broadcast(total)).select("event_id", ((F.col("event_id") * 7919) % F.col("total")).cast("double").alias("at"))
    return reports.drawn(draws, reports.sample_intervals(freq, "entity", "freq"), "entity", "at", 1000.0).select("event_id", "entity")


@query(f"""
WITH pairs AS (SELECT DISTINCT string_split(doc, '_')[1] AS name, mention AS item FROM annotations WHERE doc IS NOT NULL AND mention IS NOT NULL)
SELECT a.name AS a, b.name AS b, count(*) AS "both" FROM pairs a JOIN pairs b ON a.item = b.item AND a.name < b.name GROUP BY ALL""")
def split_intersection(s, d):
    sets = read(s, d, "annotations").where("doc is not null and mention is not null").select(F.get(F.split("doc", "_"), 0).alias("name"), F.col("mention").alias("item"))
    return reports.overlap(sets, "name", "item")


@query("""
SELECT DISTINCT e AS entity FROM (
  SELECT unnest(flatten(cand_entities)) AS e FROM encoded_samples UNION ALL SELECT unnest(ground_truth) FROM encoded_samples) WHERE e IS NOT NULL""")
def universe_union(s, d):
    rows = read(s, d, "encoded_samples")
    # A null list inside makes flatten null, so it is taken for an empty one.
    lists = F.transform("cand_entities", lambda c: F.coalesce(c, F.array().cast("array<bigint>")))
    both = rows.select(F.explode(F.flatten(lists)).alias("entity")).union(rows.select(F.explode("ground_truth")))
    return both.where("entity is not null").distinct()


@query("""
SELECT DISTINCT e AS entity FROM (SELECT unnest(flatten(cand_entities)) AS e FROM encoded_samples)
WHERE e IS NOT NULL AND e NOT IN (SELECT cand_entity FROM fp_weak_log WHERE cand_entity IS NOT NULL)""")
def universe_extension(s, d):
    lists = F.transform("cand_entities", lambda c: F.coalesce(c, F.array().cast("array<bigint>")))
    all_ids = read(s, d, "encoded_samples").select(F.explode(F.flatten(lists)).alias("entity")).where("entity is not null").distinct()
    return writers.extension(all_ids, read(s, d, "fp_weak_log").select(F.col("cand_entity").alias("entity")), "entity")


@query("SELECT DISTINCT e AS id FROM (SELECT cand_entity AS e FROM fp_weak_log UNION SELECT gt_entity FROM fp_weak_log) WHERE e IS NOT NULL")
def relatedness_entities(s, d):
    log = read(s, d, "fp_weak_log")
    return log.select(F.col("cand_entity").alias("id")).union(log.select("gt_entity")).where("id is not null").distinct()


ENT_TITLE = "regexp_replace(translate(replace(replace({x}, '&amp;', '&'), '&quot;', '\"'), '_' || chr(160), '  '), '^\\s+|\\s+$', '', 'g')"


@query(f"""
WITH n AS (SELECT name, max(entity_id) AS id FROM entity_names GROUP BY 1), l AS (SELECT lower(name) AS name, max(entity_id) AS id FROM entity_names GROUP BY 1),
r AS (SELECT old_title, max(new_title) AS new_title FROM redirects GROUP BY 1),
w AS (SELECT DISTINCT wikiName AS typed, {ENT_TITLE.format(x='wikiName')} AS s FROM annotations WHERE wikiName IS NOT NULL),
v AS (SELECT typed, upper(s[1]) || s[2:] AS link, string_split(upper(s[1]) || s[2:], '') AS cs FROM w),
t AS (SELECT typed, link, {TITLE.format(x='cs')} AS title FROM v)
SELECT typed, link, coalesce(n0.id, n1.id, l.id) AS entity_id FROM t
LEFT JOIN r r0 ON r0.old_title = link LEFT JOIN n n0 ON n0.name = coalesce(r0.new_title, link)
LEFT JOIN r r1 ON r1.old_title = title LEFT JOIN n n1 ON n1.name = coalesce(r1.new_title, title)
LEFT JOIN l ON l.name = lower(link)""")
def redirect_resolve(s, d):
    typed = read(s, d, "annotations").where("wikiName is not null").select(F.col("wikiName").alias("typed")).distinct()
    rows = typed.withColumn("link", text.entity_title(F.col("typed")))
    return lookup.resolved(rows, "link", read(s, d, "entity_names"), read(s, d, "redirects")).select("typed", "link", "entity_id")


@query("""
WITH n AS (SELECT name, max(entity_id) AS id FROM entity_names GROUP BY 1), k AS (SELECT DISTINCT entity_id FROM entity_names),
a AS (SELECT DISTINCT annotation_id, wikiName FROM annotations)
SELECT annotation_id, wikiName, coalesce(k.entity_id, n.id) AS resolved_id FROM a LEFT JOIN k ON k.entity_id = annotation_id LEFT JOIN n ON n.name = wikiName""")
def id_or_name_resolve(s, d):
    rows = read(s, d, "annotations").select("annotation_id", "wikiName").distinct()
    return lookup.id_or_name(rows, "annotation_id", "wikiName", read(s, d, "entity_names"))


@query("SELECT name, max_by(entity_id, line_no) AS entity_id, max(line_no) AS line_no FROM entity_names GROUP BY 1")
def last_line_wins(s, d):
    return lookup.last_line_wins(read(s, d, "entity_names"), "name")


LISTS = f"""f AS (SELECT mention, sum(n)::BIGINT AS freq FROM ({LINK_COUNTS}) GROUP BY 1), pem AS ({_p(LINK_COUNTS)})"""


@query(f"""
WITH {LISTS}, sp AS (SELECT DISTINCT name AS span, string_split(name, '') AS cs, lower(name) AS low FROM entity_names WHERE name IS NOT NULL UNION SELECT DISTINCT lower(name), string_split(lower(name), ''), lower(name) FROM entity_names WHERE name IS NOT NULL),
k AS (SELECT span, low, CASE WHEN coalesce(f0.freq, 0) > coalesce(f1.freq, 0) THEN span WHEN coalesce(f1.freq, 0) > 0 THEN title WHEN coalesce(f2.freq, 0) > 0 THEN low END AS key
  FROM (SELECT *, {TITLE.format(x='cs')} AS title FROM sp) LEFT JOIN f f0 ON f0.mention = span LEFT JOIN f f1 ON f1.mention = title LEFT JOIN f f2 ON f2.mention = low)
SELECT span, key AS matched, entity, round(p, 6) AS p, row_number() OVER (PARTITION BY span ORDER BY p DESC, entity) AS rank FROM k JOIN pem ON pem.mention = key QUALIFY rank <= 30""")
def candidate_lookup(s, d):
    counts = D.mention_counts(_links(s, d))
    freq = counts.groupBy("mention").agg(F.sum("n").alias("freq"))
    names = read(s, d, "entity_names").select(F.col("name").alias("span"))
    spans = names.union(names.select(F.lower("span")))
    return lookup.candidates(spans, "span", D.conditional(counts), freq).withColumn("p", F.round("p", 6))


@query(f"""
WITH {LISTS}, low AS (SELECT lower(mention) AS low, max(mention) AS same FROM f GROUP BY 1),
m AS (SELECT mention, CASE WHEN mention = upper(mention) THEN array_to_string(list_transform(regexp_extract_all(mention, '[A-Za-z0-9]+'), lambda w: upper(w[1]) || lower(w[2:])), ' ') ELSE mention END AS cap FROM (SELECT DISTINCT upper(name) AS mention FROM entity_names UNION SELECT mention FROM f))
SELECT m.mention, CASE WHEN fc.freq IS NOT NULL AND fc.freq >= coalesce(f0.freq, 0) THEN cap WHEN f0.freq IS NOT NULL THEN m.mention ELSE same END AS key
FROM m LEFT JOIN f f0 ON f0.mention = m.mention LEFT JOIN f fc ON fc.mention = cap LEFT JOIN low ON low.low = lower(m.mention)""")
def mention_normalise(s, d):
    counts = D.mention_counts(_links(s, d))
    freq = counts.groupBy("mention").agg(F.sum("n").alias("freq"))
    asked = read(s, d, "entity_names").select(F.upper("name").alias("mention")).union(freq.select("mention"))
    return lookup.normalised_mentions(asked, "mention", freq)


@query("""
WITH a AS (SELECT doc_id, range(1, len(x) + 1) AS js, x, y FROM (
  SELECT doc_id, regexp_extract_all(text, '<a href="([^"<>]*)">([^<>]*)</a>', 1) AS x, regexp_extract_all(text, '<a href="([^"<>]*)">([^<>]*)</a>', 2) AS y FROM documents)),
b AS (SELECT doc_id, unnest(js) AS j, x, y FROM a),
c AS (SELECT doc_id, j - 1 AS anchor_no, y[j] AS mention, regexp_replace(translate(replace(replace(regexp_replace(url_decode(x[j]), '^wikt:', ''), '&amp;', '&'), '&quot;', '"'), '_' || chr(160), '  '), '^\\s+|\\s+$', '', 'g') AS t FROM b)
SELECT doc_id, anchor_no, mention, upper(t[1]) || t[2:] AS target FROM c
WHERE mention <> '' AND t <> '' AND NOT regexp_matches(mention, '[Ww]ikipedia') AND NOT t LIKE 'List of %' AND NOT t LIKE 'list of %' AND NOT contains(t, '#')""")
def anchor_extract(s, d):
    return readers.anchors(read(s, d, "documents"), "text", "doc_id")


@query("""SELECT doc_id, regexp_replace(text, '<a href="([^"<>]*)">([^<>]*)</a>', '\\2', 'g') AS clean FROM documents""")
def anchor_text(s, d):
    return read(s, d, "documents").select("doc_id", readers.without_anchors("text").alias("clean"))


@query("""
SELECT log_id, cand_entity AS entity, name FROM (SELECT DISTINCT log_id, cand_entity FROM fp_weak_log)
LEFT JOIN (SELECT entity_id, max(name) AS n FROM entity_names GROUP BY 1) ON entity_id = cand_entity, LATERAL (SELECT coalesce(n, 'NIL') AS name)""")
def names_of_ids(s, d):
    names = read(s, d, "entity_names").groupBy(F.col("entity_id").alias("entity")).agg(F.max("name").alias("name"))
    log = read(s, d, "fp_weak_log").select("log_id", F.col("cand_entity").alias("entity")).distinct()
    return log.join(names, "entity", "left").withColumn("name", F.coalesce("name", F.lit("NIL")))


@query("""
WITH t AS (SELECT DISTINCT k AS term FROM (SELECT unnest(map_keys(word_freq)) AS k FROM vocab_counter))
SELECT term FROM t WHERE term IN (SELECT term FROM vocab_maps WHERE kind = 'word') AND lower(term) NOT IN (%s)""" % STOPS)
def vocabulary_overlap(s, d):
    seen = read(s, d, "vocab_counter").select(F.explode(F.map_keys("word_freq")).alias("term")).distinct()
    stops = s.createDataFrame([(w,) for w in text.STOP_WORDS], "stop string")
    known = seen.join(read(s, d, "vocab_maps").where("kind = 'word'").select("term"), "term", "left_semi")
    return known.join(stops, F.lower("term") == F.col("stop"), "left_anti")


RECORDS = """
SELECT log, list(struct_pack(id := cand_entity, p := p) ORDER BY p DESC, cand_entity) AS cands, max(gt) AS gold FROM (
  SELECT chunk_id || '/' || span_num AS log, cand_entity, max(1.0::DOUBLE / (cand_pos + 1)) AS p, max(gt_entity) AS gt FROM fp_weak_log
  WHERE chunk_id IS NOT NULL AND span_num IS NOT NULL AND cand_entity IS NOT NULL AND cand_pos IS NOT NULL GROUP BY ALL) GROUP BY 1"""


def mention_records(s: SparkSession, d: str) -> DataFrame:
    """(log, cands, gold): the logged candidates of every span, best prior first."""
    rows = read(s, d, "fp_weak_log").where("chunk_id is not null and span_num is not null and cand_entity is not null and cand_pos is not null")
    one = rows.groupBy(F.concat_ws("/", "chunk_id", F.col("span_num").cast("string")).alias("log"), F.col("cand_entity").alias("id")).agg(F.max(1.0 / (F.col("cand_pos") + 1)).alias("p"), F.max("gt_entity").alias("gt"))
    lists = one.groupBy("log").agg(F.array_sort(F.collect_list(F.struct((-F.col("p")).alias("q"), "id"))).alias("c"), F.max("gt").alias("gold"))
    return lists.select("log", F.transform("c", lambda c: F.struct(c["id"].alias("id"), (-c["q"]).alias("p"))).alias("cands"), "gold")


@query(f"""
WITH r AS ({RECORDS}), g AS (SELECT *, coalesce(list_position(list_transform(cands, lambda c: c.id), gold), 0) AS gp FROM r),
k AS (SELECT log, gold, CASE WHEN gp > 2 THEN list_concat(cands[1:1], cands[gp:gp]) ELSE cands[1:2] END AS cands FROM g)
SELECT log, gold, list_transform(cands, lambda c: c.id) AS ids, CASE WHEN coalesce(list_position(list_transform(cands, lambda c: c.id), gold), 0) > 0 THEN list_position(list_transform(cands, lambda c: c.id), gold)::BIGINT ELSE -1 END AS gold_pos FROM k""")
def record_parse_reinsert_gold(s, d):
    return records.cut(mention_records(s, d), 2, training=True).select("log", "gold", F.transform("cands", lambda c: c["id"]).alias("ids"), "gold_pos")


@query(f"""
WITH r AS ({RECORDS}), u AS (SELECT list(DISTINCT gt_entity) AS us FROM fp_weak_log WHERE gt_entity IS NOT NULL),
k AS (SELECT log, gold, list_filter(list_transform(cands, lambda c: c.id), lambda i: list_contains(us, i)) AS ids FROM r, u WHERE list_contains(us, gold))
SELECT log, gold, ids, CASE WHEN coalesce(list_position(ids, gold), 0) > 0 THEN list_position(ids, gold)::BIGINT ELSE -1 END AS gold_pos FROM k""")
def record_restrict(s, d):
    universe = read(s, d, "fp_weak_log").where("gt_entity is not null").select(F.col("gt_entity").alias("id")).distinct()
    out = records.restricted(mention_records(s, d), universe, "log")
    return out.select("log", "gold", F.transform("cands", lambda c: c["id"]).alias("ids"), "gold_pos")
