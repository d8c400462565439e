"""Writers of the pipeline's formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossweave.functions import text


def token_stream_lines(docs: DataFrame) -> DataFrame:
    """(doc, value): the lines of a document (doc, words, gold) in its token stream, with
    markers at the mentions' word positions."""
    n = F.size("words")
    at = lambda i: F.filter("gold", lambda g: g["begin"] == i)
    closing = lambda i: F.filter("gold", lambda g: g["end"] == i)
    word = lambda i: F.concat(F.transform(closing(i), lambda g: F.lit("MMEND")), F.transform(at(i), lambda g: F.concat(F.lit("MMSTART_"), g["entity"])), F.filter(F.array(F.get("words", i)), lambda w: w.isNotNull()))
    body = F.flatten(F.transform(F.sequence(F.lit(0), n), word))
    whole = F.concat(F.array(F.concat(F.lit("DOCSTART_"), F.col("doc"))), body, F.array(F.lit("DOCEND")))
    return docs.select("doc", F.array_join(whole, "\n").alias("value"))


def write_token_stream(docs: DataFrame, path: str) -> None:
    token_stream_lines(docs).select("value").write.mode("overwrite").text(path)


def dictionary_lines(dictionary: DataFrame, score: str | None = "n", k: int = 100) -> DataFrame:
    """``mention⇥total⇥id,score,name⇥...`` lines of (mention, entity_id, name, score), the
    best ``k``; names with underscores.  Without a score the entries are ``id,name``."""
    by = F.col(score) if score else F.lit(0)
    lists = dictionary.groupBy("mention").agg(F.array_sort(F.collect_list(F.struct((-by).alias("s"), "entity_id", "name"))).alias("c"), (F.sum(score) if score else F.count("*")).alias("total"))
    name = lambda c: F.replace(c["name"], F.lit(" "), F.lit("_"))
    entry = (lambda c: F.concat_ws(",", c["entity_id"].cast("string"), (-c["s"]).cast("string"), name(c))) if score else (lambda c: F.concat_ws(",", c["entity_id"].cast("string"), name(c)))
    return lists.select(F.concat_ws("\t", "mention", F.col("total").cast("string"), F.array_join(F.transform(F.slice("c", 1, k), entry), "\t")).alias("value"))


def write_dictionary(dictionary: DataFrame, path: str, score: str | None = "n", k: int = 100) -> None:
    dictionary_lines(dictionary, score, k).write.mode("overwrite").text(path)


def write_samples(samples: DataFrame, path: str, by: tuple[str, ...] = ("mode", "dataset")) -> None:
    """Nested samples, one directory for every mode and dataset; a large one is written by
    many tasks, in files of limited size."""
    samples.write.option("maxRecordsPerFile", 1_000_000).mode("overwrite").partitionBy(*by).parquet(path)


def write_settings(settings: dict[str, str], spark: SparkSession, path: str) -> None:
    spark.createDataFrame(sorted(settings.items()), "key string, value string").write.mode("overwrite").parquet(path)


def write_id_maps(ids: DataFrame, path: str) -> None:
    """An id map (entity_id, row) in both directions, below ``by_id`` and ``by_row``; rows
    are written from 1."""
    rows = ids.select("entity_id", (F.col("row") + 1).alias("row"))
    write_table(rows, f"{path}/by_id")
    write_table(rows.select("row", "entity_id"), f"{path}/by_row")


def report_text(report: DataFrame) -> DataFrame:
    """(doc, value): a prediction report (doc, begin, end, entity, outcome) as text, one
    line a span in order, with a legend's mark before it."""
    mark = F.when(F.col("outcome") == "tp", "+").when(F.col("outcome") == "fp", "!").otherwise("-")
    line = F.concat(mark, F.lit(" ["), F.col("begin").cast("string"), F.lit(","), F.col("end").cast("string"), F.lit(") "), F.col("entity").cast("string"))
    lists = report.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("begin", "end", "entity", line.alias("line")))).alias("l"))
    return lists.select("doc", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("value"))


def write_vocabulary(vocab: DataFrame, path: str) -> None:
    vocab.write.mode("overwrite").parquet(path)


def extension(universe: DataFrame, known: DataFrame, on: str = "id") -> DataFrame:
    """Entities of a universe that are not known yet."""
    return universe.join(known.select(on).distinct(), on, "left_anti")


def write_table(df: DataFrame, path: str) -> None:
    """Tab-separated lines of a table's columns; tabs and line breaks in them are escaped."""
    df.select(F.concat_ws("\t", *(text.field_escaped(F.col(c).cast("string")) for c in df.columns)).alias("value")).write.mode("overwrite").text(path)


def frequency_table(freq: DataFrame, path: str, n: str, least: int = 10) -> None:
    """Rows of at least ``least``, the most frequent first."""
    write_table(freq.where(F.col(n) >= least).orderBy(F.desc(n), *[c for c in freq.columns if c != n]), path)


def canonical_words(words: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``id⇥name⇥words`` rows of pages (id, name), their words (id, pos, word) in order, and
    the pages without any."""
    lists = words.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("pos", "word"))).alias("w"))
    rows = pages.join(lists, "id").select("id", "name", F.array_join(F.transform("w", lambda x: x["word"]), " ").alias("words"))
    return rows, pages.join(lists, "id", "left_anti")


def vectors_as_text(table: DataFrame) -> DataFrame:
    return table.select(F.concat_ws(" ", F.col("id").cast("string"), F.array_join(F.transform("vec", lambda x: x.cast("string")), " ")).alias("value"))


def nif_lines(annotations: DataFrame, doc: str = "doc") -> DataFrame:
    """Turtle of (doc, begin, end, anchor, ref) annotations, one block each."""
    body = F.format_string('<%s#char=%d,%d>\n  nif:anchorOf "%s" ;\n  nif:beginIndex "%d" ;\n  nif:endIndex "%d" ;\n  itsrdf:taIdentRef <%s> .', doc, "begin", "end", F.replace(F.replace("anchor", F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), "begin", "end", "ref")
    return annotations.select(doc, body.alias("value"))


def given_spans_xml(spans: DataFrame, doc: str = "doc") -> DataFrame:
    """A request's ``annotation`` element with its spans, for annotators that only
    disambiguate: (doc, xml)."""
    quoted = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))
    item = F.struct("start", F.format_string('<surfaceForm name="%s" offset="%d"/>', quoted(F.col("mention")), "start").alias("x"))
    lists = spans.groupBy(doc).agg(F.sort_array(F.collect_list(item)).alias("s"), F.max("text").alias("text"))
    return lists.select(doc, F.concat(F.lit('<annotation text="'), quoted(F.col("text")), F.lit('">'), F.array_join(F.transform("s", lambda x: x["x"]), ""), F.lit("</annotation>")).alias("xml"))


def single_strings(tokens: DataFrame) -> DataFrame:
    """(doc, text): the words (doc, pos, word) of a document in one string, for tokenisers
    that take whole texts."""
    lists = tokens.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("pos", "word"))).alias("w"))
    return lists.select("doc", F.array_join(F.transform("w", lambda x: x["word"]), " ").alias("text"))
