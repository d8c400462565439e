"""Readers of the pipeline's text formats.

Each gives rows with an explicit schema; lines that don't fit a format are dropped and
can be counted with the ``bad`` companion where one is named.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from glossweave.functions import text


def _blocks(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, at, line): the lines of text files, of any size, by the stretch of
    the file that a task read; ``at`` grows within a stretch."""
    rows = spark.read.option("lineSep", "\n").text(path)
    where = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")]
    return rows.select(*where, F.monotonically_increasing_id().alias("at"), F.regexp_replace("value", "\r$", "").alias("line"))


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, line_no, line) of text files, numbered from 0 in each.

    A file is read in stretches by many tasks; each numbers its own lines, and the lines
    of the stretches before it, one number a stretch, are added.
    """
    rows = _blocks(spark, path)
    inside = Window.partitionBy("file", "block").orderBy("at")
    counts = rows.groupBy("file", "block").agg(F.count("*").alias("n"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("file", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    numbered = rows.withColumn("_n", F.row_number().over(inside) - 1).join(offsets, ["file", "block"])
    return numbered.select("file", "block", (F.col("_n") + F.col("_before")).alias("line_no"), "line")


def carried(rows: DataFrame, values: dict[str, Column]) -> DataFrame:
    """Rows of ``lines`` with the last value of each expression at or above the line that
    is not null: within its stretch, or else the last one of those before."""
    rows = rows.withColumns({f"_{n}": c for n, c in values.items()})
    inside = Window.partitionBy("file", "block").orderBy("line_no")
    last = rows.groupBy("file", "block").agg(*(F.max_by(f"_{n}", F.when(F.col(f"_{n}").isNotNull(), F.col("line_no"))).alias(f"_last_{n}") for n in values))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    above = last.select("file", "block", *(F.last(f"_last_{n}", ignorenulls=True).over(before).alias(f"_above_{n}") for n in values))
    own = rows.withColumns({n: F.last(f"_{n}", ignorenulls=True).over(inside) for n in values}).join(above, ["file", "block"])
    return own.withColumns({n: F.coalesce(n, f"_above_{n}") for n in values}).drop(*(f"{x}{n}" for n in values for x in ("_", "_above_")))


def _fields(spark: SparkSession, path: str, n: int | None = None) -> DataFrame:
    rows = spark.read.text(path).select(F.split("value", "\t").alias("f"))
    return rows.where(F.size("f") == n) if n else rows


def line_counters(spark: SparkSession, path: str, fields: tuple[int, ...], id_field: int | None = None) -> DataFrame:
    """(lines, bad_arity, bad_id, repeated): lines of a tab-separated file, those that have
    another number of fields, those whose id is no number, and how many repeat the first
    field of another."""
    f = F.split("value", "\t")
    good = F.size(f).isin(*fields)
    bad_id = good & F.get(f, id_field).try_cast("bigint").isNull() if id_field is not None else F.lit(False)
    rows = spark.read.text(path).select(good.alias("good"), bad_id.alias("bad_id"), F.get(f, 0).alias("name"))
    by_name = rows.groupBy("good", "bad_id", "name").agg(F.count("*").alias("n"))
    usable = F.col("good") & ~F.col("bad_id")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    return by_name.agg(total(F.col("n")).alias("lines"), total(F.when(~F.col("good"), F.col("n"))).alias("bad_arity"), total(F.when(F.col("bad_id"), F.col("n"))).alias("bad_id"), total(F.when(usable, F.col("n") - 1)).alias("repeated"))


def redirects(spark: SparkSession, path: str, lowercase: bool = False) -> DataFrame:
    """``old⇥new`` lines."""
    low = F.lower if lowercase else (lambda c: c)
    return _fields(spark, path, 2).select(low(F.get("f", 0)).alias("old_title"), low(F.get("f", 1)).alias("new_title"))


def disambiguations(spark: SparkSession, path: str) -> DataFrame:
    """``id⇥title`` lines."""
    rows = _fields(spark, path, 2).select(F.get("f", 0).try_cast("bigint").alias("entity_id"), F.get("f", 1).alias("title"))
    return rows.where("entity_id is not null")


def names(spark: SparkSession, path: str, excluded: DataFrame | None = None, lowercase: bool = False) -> DataFrame:
    """``name⇥id`` lines as (name, entity_id, line_no); of a repeated name the last line."""
    f = F.split("line", "\t")
    name = F.lower(F.get(f, 0)) if lowercase else F.get(f, 0)
    rows = lines(spark, path).where(F.size(f) == 2).select(name.alias("name"), F.get(f, 1).try_cast("bigint").alias("entity_id"), "line_no").where("entity_id is not null")
    if excluded is not None:
        rows = rows.join(excluded.select("entity_id").distinct(), "entity_id", "left_anti")
    best = rows.groupBy("name").agg(F.max(F.struct("line_no", "entity_id")).alias("b"))
    return best.select("name", "b.entity_id", "b.line_no")


def names_by_id(spark: SparkSession, path: str, excluded: DataFrame | None = None) -> DataFrame:
    """The reverse map: of lines that repeat an id the last one, (entity_id, name)."""
    f = F.split("line", "\t")
    rows = lines(spark, path).where(F.size(f) == 2).select(F.get(f, 1).try_cast("bigint").alias("entity_id"), F.get(f, 0).alias("name"), "line_no").where("entity_id is not null")
    if excluded is not None:
        rows = rows.join(excluded.select("entity_id").distinct(), "entity_id", "left_anti")
    return rows.groupBy("entity_id").agg(F.max_by("name", "line_no").alias("name"))


def persons(spark: SparkSession, path: str, known: DataFrame) -> DataFrame:
    """One title a line, those that are known entities."""
    return _titles(spark, path).join(known.select("name", "entity_id"), "name")


def unknown_persons(spark: SparkSession, path: str, known: DataFrame) -> DataFrame:
    """The titles that are no known entity."""
    return _titles(spark, path).join(known.select("name"), "name", "left_anti")


def _titles(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(text.strip(F.col("value")).alias("name")).where("name <> ''").distinct()


def dictionary(spark: SparkSession, path: str, scored: bool = True) -> DataFrame:
    """``mention⇥total⇥id,score,name⇥...`` lines as (mention, total, pos, entity_id, score,
    name); without scores the entries are ``id,name`` and the score is null."""
    f = F.split("value", "\t")
    rows = spark.read.text(path).where(F.size(f) >= 2).select(F.get(f, 0).alias("mention"), F.get(f, 1).try_cast("bigint").alias("total"), F.posexplode(F.slice(f, F.lit(3), F.size(f))).alias("pos", "e"))
    e = F.split("e", ",", 3 if scored else 2)
    out = rows.select("mention", "total", F.col("pos").cast("bigint").alias("pos"), F.get(e, 0).try_cast("bigint").alias("entity_id"), (F.get(e, 1).try_cast("double") if scored else F.lit(None).cast("double")).alias("score"), F.get(e, 2 if scored else 1).alias("name"))
    return out.where("entity_id is not null and total is not null")


def means(spark: SparkSession, path: str) -> DataFrame:
    """``"mention"⇥entity`` lines with escapes resolved: (mention, name)."""
    mention = F.regexp_replace(F.get("f", 0), '^"|"$', "")
    name = text.entity_title(F.coalesce(text.unicode_unescaped(F.get("f", 1)), F.get("f", 1)))
    return _fields(spark, path, 2).select(text.unescaped(mention).alias("mention"), name.alias("name"))


_ANCHOR = r'<a href="([^"<>]*)">([^<>]*)</a>'


def anchors(df: DataFrame, column: str, *keys: str) -> DataFrame:
    """(keys, anchor_no, mention, target) of the links in a text.

    Targets are percent-decoded entity titles without ``wikt:``; mentions or targets that
    are empty, name the encyclopedia itself, are lists or fragments are left out.
    """
    pairs = F.arrays_zip(F.regexp_extract_all(column, F.lit(_ANCHOR), F.lit(1)).alias("t"), F.regexp_extract_all(column, F.lit(_ANCHOR), F.lit(2)).alias("m"))
    rows = df.select(*keys, F.posexplode(pairs).alias("anchor_no", "a"))
    raw = F.coalesce(text.percent_decoded(F.col("a.t")), F.col("a.t"))
    target = text.entity_title(F.regexp_replace(raw, "^wikt:", ""))
    out = rows.select(*keys, F.col("anchor_no").cast("bigint").alias("anchor_no"), F.col("a.m").alias("mention"), target.alias("target"))
    return out.where("mention <> '' and target <> '' and not mention rlike '[Ww]ikipedia' and not target like 'List of %' and instr(target, '#') = 0")


def without_anchors(column: str):
    """The text with every link replaced by its mention."""
    return F.regexp_replace(column, _ANCHOR, "$2")


def wiki_dump(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, title, line_no, line) of a dump with ``<doc id= title=>`` headers; the last
    document of a file counts like any other."""
    got = lambda what: F.nullif(F.regexp_extract("line", f'^<doc [^>]*{what}="([^"]*)"', 1), F.lit(""))
    header = F.when(F.col("line").rlike("^<doc "), F.struct(got("id").try_cast("bigint").alias("id"), got("title").alias("title")))
    rows = carried(lines(spark, path), {"doc": header})
    return rows.where("doc.id is not null and not line rlike '^</?doc[ >]'").select(F.col("doc.id").alias("doc_id"), "doc.title", "line_no", "line")


def tokenised_dump(spark: SparkSession, path: str) -> DataFrame:
    """A dump whose tokens are separated by no-break spaces inside tags: (file, line_no,
    tokens)."""
    return lines(spark, path).select("file", "line_no", F.filter(F.split("line", "[ \\s]+"), lambda t: t != "").alias("tokens"))


def conll(spark: SparkSession, path: str) -> DataFrame:
    """(file, doc, pos, word, bio, mention, url, entity_id) of annotated token rows.

    Rows have 7 columns (word, B/I, mention, name, url, id, mid), 6 without the last, 4
    for mentions of no entity, 1 for other words; blank lines only end sentences.
    """
    f = F.split("line", "\t")
    doc = F.nullif(F.regexp_extract("line", r"^-DOCSTART- \((.*)\)", 1), F.lit(""))
    rows = carried(lines(spark, path), {"doc": doc}).where("line <> '' and not line like '-DOCSTART-%' and doc is not null").where(F.size(f).isin(1, 4, 6, 7))
    pos = F.row_number().over(Window.partitionBy("file", "doc").orderBy("line_no")) - 1
    wide = F.size(f) >= 6
    return rows.select("file", "doc", pos.cast("bigint").alias("pos"), F.get(f, 0).alias("word"), F.coalesce(F.get(f, 1), F.lit("O")).alias("bio"), F.get(f, 2).alias("mention"), F.when(wide, F.get(f, 4)).alias("url"), F.when(wide, F.get(f, 5).try_cast("bigint")).alias("entity_id"))


def split_of(df: DataFrame, doc: str = "doc") -> DataFrame:
    """Adds ``split``: test documents carry ``testb`` in their name, development ones
    ``testa``, all others train."""
    name = F.col(doc)
    return df.withColumn("split", F.when(name.contains("testb"), "test").when(name.contains("testa"), "dev").otherwise("train"))


def standoff_xml(spark: SparkSession, path: str, texts: DataFrame) -> DataFrame:
    """(doc, mention, name, offset, length, text) of annotation files and their raw texts
    (doc, text)."""
    schema = "_docName string, annotation array<struct<mention string, wikiName string, offset int, length int>>"
    docs = spark.read.format("xml").option("rowTag", "document").schema(schema).load(path)
    rows = docs.select(F.col("_docName").alias("doc"), F.explode("annotation").alias("a"))
    return rows.select("doc", "a.mention", F.col("a.wikiName").alias("name"), "a.offset", "a.length").join(texts, "doc")


def raw_texts(spark: SparkSession, path: str) -> DataFrame:
    """(doc, text): whole files by their names."""
    return spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("doc"), F.col("value").alias("text"))


def raw_records(spark: SparkSession, path: str) -> DataFrame:
    """Records of a header, a ``text:`` line, a count and ``start_z_length_z_[uris]`` lines
    as (doc, text, annotations)."""
    doc = F.when(F.col("line").startswith("DOCSTART_"), F.substr("line", F.lit(10)))
    rows = carried(lines(spark, path), {"doc": doc}).where("doc is not null")
    ann = r"^(\d+)_z_(\d+)_z_\[(.*)\]$"
    a = F.when(F.col("line").rlike(ann), F.struct(F.regexp_extract("line", ann, 1).cast("int").alias("start"), F.regexp_extract("line", ann, 2).cast("int").alias("length"), F.split(F.regexp_extract("line", ann, 3), r",\s*").alias("uris")))
    body = F.max(F.when(F.col("line").startswith("text: "), F.substr("line", F.lit(7))))
    return rows.groupBy("file", "doc").agg(body.alias("text"), F.sort_array(F.collect_list(a)).alias("annotations")).drop("file")


def nif(spark: SparkSession, path: str) -> DataFrame:
    """(file, subject, begin, end, anchor, ref) of the annotations of Turtle files, one
    subject block each."""
    whole = spark.read.text(path, wholetext=True).withColumn("file", F.input_file_name())
    blocks = whole.select("file", F.explode(F.split("value", r"(?m)\s\.\s*$")).alias("b"))
    got = lambda re: F.nullif(F.regexp_extract("b", re, 1), F.lit(""))
    out = blocks.select("file", got(r"(?m)^\s*<([^>]+)>").alias("subject"), got(r'nif:beginIndex\s+"(\d+)"').cast("int").alias("begin"), got(r'nif:endIndex\s+"(\d+)"').cast("int").alias("end"), got(r'nif:anchorOf\s+"((?:[^"\\]|\\.)*)"').alias("anchor"), got(r"itsrdf:taIdentRef\s+<([^>]+)>").alias("ref"))
    return out.where("ref is not null").withColumn("anchor", F.regexp_replace("anchor", r"\\\\(.)", "$1"))


def token_stream(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, line) of a normalised token stream, for ``spans.parsed_stream``."""
    return lines(spark, path)


def binary_vectors(spark: SparkSession, path: str, batch: int = 4096) -> DataFrame:
    """(word, vec) of word2vec binaries: an ASCII header ``words dim``, then each word, a
    space and its 32-bit floats.  A file is parsed by one task and given on in batches."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column(0).to_pylist():
                head, _, rest = data.partition(b"\n")
                count, dim = map(int, head.split())
                at, words, vecs = 0, [], []
                for _ in range(count):
                    end = rest.index(b" ", at)
                    words.append(rest[at:end].lstrip(b"\n").decode("utf-8", "replace"))
                    vecs.append(list(struct.unpack_from(f"<{dim}f", rest, end + 1)))
                    at = end + 1 + 4 * dim
                    if len(words) == batch:
                        yield pa.record_batch([pa.array(words), pa.array(vecs, pa.list_(pa.float32()))], names=["word", "vec"])
                        words, vecs = [], []
                if words:
                    yield pa.record_batch([pa.array(words), pa.array(vecs, pa.list_(pa.float32()))], names=["word", "vec"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(parse, "word string, vec array<float>")


def text_vectors(spark: SparkSession, path: str, id_type: str = "string") -> DataFrame:
    """(word, vec) of lines of a word or id and its numbers."""
    f = F.split("value", r"\s+")
    rows = spark.read.text(path).select(text.strip(F.col("value")).alias("value")).where(F.size(f) > 2)
    return rows.select(F.get(f, 0).cast(id_type).alias("word"), F.slice(f, F.lit(2), F.size(f)).cast("array<float>").alias("vec"))


def relatedness(spark: SparkSession, path: str) -> DataFrame:
    """(q, e1, e2, label) of ``label qid:q ... # e1-e2 ...`` lines."""
    re = r"^(\d+)\s+qid:(\d+).*#\s*(\d+)-(\d+)"
    g = lambda i, t: F.regexp_extract("value", re, i).cast(t)
    return spark.read.text(path).where(F.col("value").rlike(re)).select(g(2, "int").alias("q"), g(3, "bigint").alias("e1"), g(4, "bigint").alias("e2"), g(1, "int").alias("label"))


def id_map(spark: SparkSession, path: str) -> DataFrame:
    """``wiki id⇥row`` lines, rows from 1, as (entity_id, row) with rows from 0; the id 1
    stands for the unknown entity and becomes 0."""
    rows = _fields(spark, path, 2).select(F.get("f", 0).try_cast("bigint").alias("i"), F.get("f", 1).try_cast("bigint").alias("n"))
    return rows.where("i is not null and n is not null").select(F.when(F.col("i") == 1, F.lit(0)).otherwise(F.col("i")).cast("bigint").alias("entity_id"), (F.col("n") - 1).alias("row"))


def extended_map(base: DataFrame, extension: DataFrame) -> DataFrame:
    """The map with the extension's new ids on the rows after its last."""
    last = base.agg((F.max("row") + 1).alias("_next"))
    new = extension.join(base.select("entity_id"), "entity_id", "left_anti")
    return base.unionByName(new.join(F.broadcast(last)).select("entity_id", (F.col("row") + F.coalesce("_next", F.lit(0))).alias("row")))


def renamed_map(base: DataFrame, extension: DataFrame) -> DataFrame:
    """Like ``extended_map``, but ids that the base has already come in under new ones, the
    negatives of their own, so that every row of the extension's matrix has an id."""
    last = base.agg((F.max("row") + 1).alias("_next"))
    known = base.select("entity_id", F.lit(True).alias("_known"))
    new = extension.join(known, "entity_id", "left").join(F.broadcast(last))
    renamed = F.when(F.col("_known"), -F.col("entity_id")).otherwise(F.col("entity_id"))
    return base.unionByName(new.select(renamed.alias("entity_id"), (F.col("row") + F.coalesce("_next", F.lit(0))).alias("row")))


def universe(spark: SparkSession, path: str) -> DataFrame:
    """First column of a tab-separated list, as ids."""
    return _fields(spark, path).select(F.get("f", 0).try_cast("bigint").alias("id")).where("id is not null").distinct()


def frequency_table(spark: SparkSession, path: str) -> DataFrame:
    """``name⇥count`` lines, as ``writers.frequency_table`` makes them: (name, n)."""
    f = _fields(spark, path, 2)
    return f.select(text.field_unescaped(F.get("f", 0)).alias("name"), F.get("f", 1).cast("bigint").alias("n"))


def endless(first: Callable[[], Iterable[DataFrame]], times: int, then: Callable[[], Iterable[DataFrame]]) -> Iterator[DataFrame]:
    """The parts of a table ``times`` over, then those of another one without end; each
    round opens its table anew."""
    for _ in range(times):
        yield from first()
    while True:
        yield from then()


def epochs(first: DataFrame, times: int, then: DataFrame | None = None) -> DataFrame:
    """A table ``times`` over with its epoch number, then another one."""
    out = first.withColumn("epoch", F.explode(F.sequence(F.lit(1), F.lit(times))))
    return out if then is None else out.unionByName(then.withColumn("epoch", F.lit(times + 1)))


def files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, size, modified) of a directory tree."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return rows.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


REQUEST = "text string, spans array<struct<start:int,length:int>>"


def requests(df: DataFrame, column: str = "value") -> DataFrame:
    """JSON requests ``{"text", "spans"}`` parsed; those that aren't JSON have nulls."""
    return df.withColumn("_r", F.from_json(column, REQUEST)).select(*df.columns, "_r.text", "_r.spans")


#: Prefixes of type names in annotator answers.
PREFIXES = {"DBpedia": "http://dbpedia.org/ontology/", "Schema": "http://schema.org/", "Freebase": "http://rdf.freebase.com/ns"}


def _full_types(types: Column) -> Column:
    """A list of types separated by commas, their prefixes written out."""
    known = F.create_map(*(F.lit(x) for kv in PREFIXES.items() for x in kv))
    full = lambda t: F.concat(F.coalesce(F.try_element_at(known, F.get(F.split(t, ":", 2), 0)), F.concat(F.get(F.split(t, ":", 2), 0), F.lit(":"))), F.get(F.split(t, ":", 2), 1))
    return F.transform(F.filter(F.split(types, ","), lambda t: t.contains(":")), full)


def annotator_answers(df: DataFrame, column: str = "value") -> DataFrame:
    """(surface, offset, uri, types) of an annotator's JSON, type prefixes written out.

    Both shapes are read: ``Resources`` with one entity a span, and ``annotation`` with
    ``surfaceForm`` entries and, if disambiguated, their ``resource``; other JSON gives
    nothing.
    """
    schema = "Resources array<struct<`@URI`:string,`@surfaceForm`:string,`@offset`:string,`@types`:string>>, annotation struct<surfaceForm:array<struct<`@name`:string,`@offset`:string,resource:struct<`@uri`:string,`@types`:string>>>>"
    parsed = df.select(F.from_json(column, schema).alias("j"))
    one = F.transform("j.Resources", lambda r: F.struct(r["@surfaceForm"].alias("s"), r["@offset"].alias("o"), r["@URI"].alias("u"), r["@types"].alias("t")))
    two = F.transform("j.annotation.surfaceForm", lambda r: F.struct(r["@name"].alias("s"), r["@offset"].alias("o"), r["resource"]["@uri"].alias("u"), r["resource"]["@types"].alias("t")))
    none = F.array().cast("array<struct<s:string,o:string,u:string,t:string>>")
    rows = parsed.select(F.explode(F.concat(F.coalesce(one, none), F.coalesce(two, none))).alias("r"))
    return rows.select(F.col("r.s").alias("surface"), F.col("r.o").try_cast("int").alias("offset"), text.percent_decoded(F.col("r.u")).alias("uri"), _full_types(F.col("r.t")).alias("types"))


def settings(title: str, defaults: dict[str, str]) -> dict[str, str]:
    """``key=value`` pairs separated by ``|``, over the defaults."""
    return defaults | dict(p.split("=", 1) for p in title.split("|") if "=" in p)


def stored_settings(spark: SparkSession, path: str, defaults: dict[str, str]) -> dict[str, str]:
    """The settings of a run, kept as (key, value) rows by ``writers.write_settings``; those
    it lacks have their defaults."""
    return defaults | {r["key"]: r["value"] for r in spark.read.parquet(path).collect()}


def kept(spark: SparkSession, path: str, make) -> DataFrame:
    """The table at ``path``, written by ``make`` first if there is none."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    where = hadoop.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(hadoop.Path(path + "/_SUCCESS")):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
