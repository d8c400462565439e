"""Token streams, chunks, spans and context windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from glossweave.functions import text
from glossweave.operators import ordered
from glossweave.sources import readers

#: Control markers of the token stream.
MARKERS = ("DOCSTART_", "DOCEND", "MMSTART_", "MMEND", "*NL*")


def token_rows(df: DataFrame, key: str, column: str) -> DataFrame:
    """(key, pos, token): one row for every token of a text."""
    return df.select(F.col(key).alias("key"), F.posexplode(text.tokens(F.col(column))).alias("pos", "token")).select("key", F.col("pos").cast("bigint").alias("pos"), "token")


def token_offsets(df: DataFrame, key: str, column: str) -> DataFrame:
    """(doc, pos, token, start, stop): every token of a text with its range of characters."""
    pieces = F.regexp_extract_all(column, F.lit(text.PIECES), F.lit(0))
    rows = df.select(F.col(key).cast("string").alias("doc"), F.posexplode(pieces).alias("at", "token"))
    upto = Window.partitionBy("doc").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    is_word = ~F.col("token").rlike(r"^\s")
    rows = rows.withColumns({"stop": F.sum(F.length("token")).over(upto), "pos": F.sum(is_word.cast("bigint")).over(upto) - 1})
    return rows.where(is_word).select("doc", "pos", "token", (F.col("stop") - F.length("token")).alias("start"), "stop")


def split_at(tokens: DataFrame, given: DataFrame) -> DataFrame:
    """Tokens (doc, pos, token, start, stop) cut where a given span (doc, start, length)
    begins or ends inside one, numbered anew.

    A token meets only the boundaries inside it: both sides are looked up by character,
    a token once for each of its own.
    """
    edges = given.select("doc", F.explode(F.array(F.col("start"), F.col("start") + F.col("length"))).alias("at")).distinct()
    inner = tokens.where(F.col("stop") - F.col("start") > 1).select("doc", "pos", F.explode(F.sequence(F.col("start") + 1, F.col("stop") - 1)).alias("at"))
    cuts = inner.join(edges, ["doc", "at"]).groupBy("doc", "pos").agg(F.sort_array(F.collect_list("at")).alias("cuts"))
    rows = tokens.join(cuts, ["doc", "pos"], "left")
    bounds = F.concat(F.array("start"), F.coalesce("cuts", F.array().cast("array<bigint>")), F.array("stop"))
    parts = text.let(bounds, lambda b: F.transform(F.slice(b, F.lit(2), F.size(b)), lambda e, i: F.struct(F.get(b, i).alias("start"), e.alias("stop"))))
    cut = rows.select("doc", "token", F.col("start").alias("_s"), F.explode(parts).alias("p"))
    order = Window.partitionBy("doc").orderBy("p.start")
    piece = F.substr("token", (F.col("p.start") - F.col("_s") + 1).cast("int"), (F.col("p.stop") - F.col("p.start")).cast("int"))
    return cut.select("doc", (F.row_number().over(order) - 1).cast("bigint").alias("pos"), piece.alias("token"), "p.start", "p.stop")


def chunks(df: DataFrame, key: str, column: str, by: str = "paragraph", separator: str = ".") -> DataFrame:
    """A text's tokens in chunks: the document, its paragraphs, or its sentences.

    Result: (chunk_id, words); the chunk id is the key, with ``&*`` and the paragraph's
    and the sentence's number.  A sentence keeps its separator; chunks without words are
    left out.
    """
    doc = F.col(key).cast("string")
    if by == "document":
        out = df.select(doc.alias("chunk_id"), text.tokens(F.col(column)).alias("words"))
    else:
        paragraphs = df.select(doc.alias("doc"), F.posexplode(F.split(column, "\n")).alias("par", "line"))
        words = text.tokens(F.col("line"))
        if by == "paragraph":
            out = paragraphs.select(F.concat_ws("&*", "doc", F.col("par").cast("string")).alias("chunk_id"), words.alias("words"))
        else:

            def pieces(w: Column) -> Column:
                ends = F.filter(F.sequence(F.lit(1), F.size(w)), lambda i: F.element_at(w, i) == separator)
                cuts = F.array_distinct(F.concat(F.array(F.lit(0)), ends, F.array(F.size(w))))
                return text.let(cuts, lambda c: F.transform(F.slice(c, F.lit(2), F.size(c)), lambda e, i: F.slice(w, F.get(c, i) + 1, e - F.get(c, i))))

            made = text.let(words, lambda w: F.when(F.size(w) > 0, pieces(w)))
            rows = paragraphs.select("doc", "par", F.posexplode(made).alias("sent", "words"))
            out = rows.select(F.concat_ws("&*", "doc", F.col("par").cast("string"), F.col("sent").cast("string")).alias("chunk_id"), "words")
    return out.where(F.size("words") > 0)


def parsed_stream(lines: DataFrame) -> DataFrame:
    """A token stream (line_no, line) of one or many files (column ``file``) as chunks.

    Markers take no word position.  Result: (doc, words, gold), ``gold`` with the
    half-open word range and entity of every mention; mentions that are not closed end
    with the document.
    """
    doc = F.when(F.col("line").startswith("DOCSTART_"), F.substr("line", F.lit(10)))
    stretches = lines if "block" in lines.columns else lines.withColumn("block", F.lit(0))
    marked = readers.carried(stretches, {"doc": doc}).where("doc is not null")
    is_marker = F.lit(False)
    for m in MARKERS:
        is_marker = is_marker | F.col("line").startswith(m)
    by_doc = Window.partitionBy("file", "doc").orderBy("line_no")
    marked = marked.withColumn("is_word", ~is_marker).withColumn("before", F.sum(F.col("is_word").cast("int")).over(by_doc) - F.col("is_word").cast("int"))
    opens = F.when(F.col("line").startswith("MMSTART_"), F.substr("line", F.lit(9)))
    marked = marked.withColumn("entity", opens)
    ahead = by_doc.rowsBetween(1, Window.unboundedFollowing)
    closing = F.first(F.when(F.col("line") == "MMEND", F.col("before")), ignorenulls=True).over(ahead)
    total = F.sum(F.col("is_word").cast("int")).over(Window.partitionBy("file", "doc"))
    marked = marked.withColumn("end", F.coalesce(closing, total))
    words = F.array_sort(F.collect_list(F.when(F.col("is_word"), F.struct("before", "line"))))
    gold = F.array_sort(F.collect_list(F.when(F.col("entity").isNotNull(), F.struct(F.col("before").alias("begin"), "end", "entity"))))
    return marked.groupBy("file", "doc").agg(F.transform(words, lambda w: w["line"]).alias("words"), gold.alias("gold"))


def all_spans(chunked: DataFrame, key: str = "chunk_id", words: str = "words", width: int = 10, separator: str = ".") -> DataFrame:
    """(key, begin, end): all half-open spans of up to ``width`` words without separator.

    Runs between separators bound the spans, so no span is made to be thrown away.
    """
    rows = separator_runs(chunked, key, words, separator).select("key", "lo", (F.col("lo") + F.size("ws")).alias("hi"))
    begins = rows.select("key", F.explode(F.sequence(F.col("lo"), F.col("hi") - 1)).alias("begin"), "hi")
    made = begins.select("key", "begin", F.explode(F.sequence(F.col("begin") + 1, F.least("hi", F.col("begin") + width))).alias("end"))
    return made.select("key", F.col("begin").cast("bigint").alias("begin"), F.col("end").cast("bigint").alias("end"))


def span_texts(chunked: DataFrame, key: str = "chunk_id", words: str = "words", width: int = 10, separator: str = ".") -> DataFrame:
    """(key, begin, end, span): the spans with their words, joined by spaces.

    Made from the words in place, without a join: each chunk's row is exploded once.
    """
    def made(ws: Column) -> Column:
        n = F.size(ws)
        at = lambda b: F.transform(F.sequence(F.lit(1), F.least(F.lit(width), n - b)), lambda k: F.struct(b.cast("bigint").alias("begin"), (b + k).cast("bigint").alias("end"), F.slice(ws, b + 1, k).alias("w")))
        return F.flatten(F.transform(F.sequence(F.lit(0), n - 1), at))

    rows = chunked.where(F.size(words) > 0).select(F.col(key).alias("key"), F.explode(text.let(F.col(words), made)).alias("s"))
    return rows.where(~F.array_contains("s.w", separator)).select("key", "s.begin", "s.end", F.array_join("s.w", " ").alias("span"))


def tag_spans(tagged: DataFrame, key: str, pos: str, tag: str) -> DataFrame:
    """Half-open spans of B/I/O tags: a B or a change of kind begins one, other tags end
    it.  Tags are ``B-kind``, ``I-kind`` or anything else."""
    order = Window.partitionBy(key).orderBy(pos)
    kind = F.when(F.col(tag).rlike("^[BI]-"), F.substr(tag, F.lit(3)))
    rows = tagged.select(F.col(key).alias("key"), F.col(pos).alias("pos"), kind.alias("kind"), F.col(tag).startswith("B-").alias("b"))
    order = Window.partitionBy("key").orderBy("pos")
    opens = F.col("b") | ~F.lag("kind").over(order).eqNullSafe(F.col("kind"))
    rows = rows.withColumn("island", F.sum(opens.cast("int")).over(order)).where("kind is not null")
    return rows.groupBy("key", "island", "kind").agg(F.min("pos").alias("begin"), (F.max("pos") + 1).alias("end")).drop("island")


def runs(df: DataFrame, key: str, order_by: list[str], value: str) -> DataFrame:
    """Runs of equal neighbouring values: (key, run, value, length)."""
    order = Window.partitionBy(key).orderBy(*order_by)
    rows = df.withColumn("_new", (~F.lag(value).over(order).eqNullSafe(F.col(value)) | (F.row_number().over(order) == 1)).cast("int"))
    rows = rows.withColumn("run", F.sum("_new").over(order))
    return rows.groupBy(F.col(key).alias("key"), "run", F.col(value).alias("value")).agg(F.count("*").alias("length"))


def spliced(texts: DataFrame, key: str, body: str, spans: DataFrame, start: str, length: str, entity: str) -> DataFrame:
    """Standoff annotations written into their text: (key, inline), each mention between
    ``MMSTART_<entity>`` and ``MMEND``.  Annotations that overlap an earlier one (by
    start, then longest, then entity) or leave the text are left out."""
    own = spans.select(F.col(key), F.struct(F.col(start).cast("int").alias("s"), (-F.col(length)).cast("int").alias("neg"), F.col(entity).cast("string").alias("e")).alias("m"))
    lists = own.where("m.s >= 0 and m.neg < 0 and m.e is not null").groupBy(key).agg(F.sort_array(F.collect_set("m")).alias("ms"))
    rows = texts.join(lists, key, "left")
    b = F.col(body)

    def step(acc: Column, m: Column) -> Column:
        end = m["s"] - m["neg"]
        good = (m["s"] >= acc["at"]) & (end <= F.length(b))
        piece = F.concat(acc["out"], F.substr(b, acc["at"] + 1, m["s"] - acc["at"]), F.lit(" MMSTART_"), m["e"], F.lit(" "), F.substr(b, m["s"] + 1, -m["neg"]), F.lit(" MMEND "))
        return F.struct(F.when(good, end).otherwise(acc["at"]).alias("at"), F.when(good, piece).otherwise(acc["out"]).alias("out"))

    start_state = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    done = F.aggregate(F.coalesce("ms", F.array().cast("array<struct<s:int,neg:int,e:string>>")), start_state, step, lambda acc: F.concat(acc["out"], F.substr(b, acc["at"] + 1, F.length(b) - acc["at"])))
    return rows.where(b.isNotNull()).select(F.col(key).alias("key"), done.alias("inline"))


def contexts(words: Column, begin: Column, end: Column, size: int = 100) -> tuple[Column, Column]:
    """Up to ``size`` words left and right of a span, the first and last words of it."""
    left = F.slice(words, F.greatest(begin - size, F.lit(0)).cast("int") + 1, F.least(begin, F.lit(size)).cast("int"))
    right = F.slice(words, end.cast("int") + 1, F.lit(size))
    return left, right


def window_mask(words: Column, begin: Column, end: Column, size: int) -> tuple[Column, Column]:
    """The positions from ``size`` before a span to ``size`` behind it, without its own,
    each clamped to the text, and a mask of those that are in it."""
    around = F.concat(F.sequence(begin - size, begin - 1), F.sequence(end, end + size - 1))
    last = F.size(words) - 1
    return F.transform(around, lambda i: F.greatest(F.lit(0), F.least(i, last)).cast("bigint")), F.transform(around, lambda i: (i >= 0) & (i <= last))


def packed_context(words: Column, begin: Column, end: Column, known: Callable[[Column], Column], size: int, boundary: bool = False) -> tuple[Column, Column]:
    """The ``size`` nearest known words on either side; unknown ones are passed over, but
    for the first and the last word of the text if ``boundary`` words always count."""
    if boundary:
        first = F.slice(words, F.lit(1), F.greatest(begin, F.lit(0)).cast("int"))
        rest = F.slice(words, end.cast("int") + 1, F.size(words))
        left = F.filter(first, lambda w, i: known(w) | (i == 0))
        right = text.let(rest, lambda r: F.filter(r, lambda w, i: known(w) | (i == F.size(r) - 1)))
        return F.slice(left, F.greatest(F.size(left) - size, F.lit(0)) + 1, F.lit(size)), F.slice(right, F.lit(1), F.lit(size))
    left = F.filter(F.slice(words, F.lit(1), F.greatest(begin, F.lit(0)).cast("int")), known)
    right = F.filter(F.slice(words, end.cast("int") + 1, F.size(words)), known)
    return F.slice(left, F.greatest(F.size(left) - size, F.lit(0)) + 1, F.lit(size)), F.slice(right, F.lit(1), F.lit(size))


def separator_runs(chunked: DataFrame, key: str = "chunk_id", words: str = "words", separator: str = ".") -> DataFrame:
    """(key, lo, ws): the runs of words between separators and where they begin."""

    def cuts(w: Column) -> Column:
        n = F.size(w)
        stops = F.filter(F.sequence(F.lit(0), n), lambda i: (i == n) | (F.get(w, i) == separator))
        bounds = lambda s: F.transform(s, lambda e, i: F.struct(F.when(i == 0, F.lit(0)).otherwise(F.get(s, i - 1) + 1).alias("lo"), e.alias("hi")))
        return F.transform(F.filter(text.let(stops, bounds), lambda r: r["lo"] < r["hi"]), lambda r: F.struct(r["lo"].alias("lo"), F.slice(w, r["lo"] + 1, r["hi"] - r["lo"]).alias("ws")))

    return chunked.where(F.size(words) > 0).select(F.col(key).alias("key"), F.explode(text.let(F.col(words), cuts)).alias("r")).select("key", "r.lo", "r.ws")


def spotted(chunked: DataFrame, mentions: DataFrame, key: str = "chunk_id", words: str = "words", width: int = 10, broadcast_rows: int = 200_000, separator: str = ".") -> DataFrame:
    """(key, begin, end, span): the spans without separator that are a known mention.

    ``mentions``: (mention), tokens joined by spaces.  Only where a mention's first word
    stands are spans made, and only of the lengths such mentions have, so the corpus is
    not multiplied by the width before the lookup.  The table of first words is broadcast
    while it has at most ``broadcast_rows``; beyond that the words are shuffled to it.
    """
    known = mentions.select("mention").where("mention <> ''").distinct().withColumn("_w", F.split("mention", " ")).where(F.size("_w") <= width)
    firsts = known.groupBy(F.get("_w", 0).alias("first")).agg(F.collect_set(F.size("_w")).alias("sizes"))
    if firsts.limit(broadcast_rows + 1).count() <= broadcast_rows:
        firsts = F.broadcast(firsts)
    ahead = lambda w: F.transform(w, lambda x, i: F.struct(x.alias("first"), F.slice(w, i + 1, F.lit(width)).alias("ahead")))
    runs = separator_runs(chunked, key, words, separator)
    begins = runs.select("key", "lo", F.posexplode(text.let(F.col("ws"), ahead)).alias("at", "x"))
    begins = begins.select("key", (F.col("lo") + F.col("at")).alias("begin"), "x.first", "x.ahead").join(firsts, "first")
    spans = begins.select("key", "begin", "ahead", F.explode("sizes").alias("n")).where(F.size("ahead") >= F.col("n"))
    spans = spans.select("key", F.col("begin").cast("bigint").alias("begin"), (F.col("begin") + F.col("n")).cast("bigint").alias("end"), F.array_join(F.slice("ahead", F.lit(1), F.col("n")), " ").alias("span"))
    return spans.join(known.select(F.col("mention").alias("span")), "span", "left_semi").select("key", "begin", "end", "span")


def vocabulary(token_table: DataFrame, token: str = "token", least: int = 1, reserved: int = 1) -> DataFrame:
    """(token, id): the more frequent token first, then by spelling; ids begin after the
    ``reserved`` ones."""
    freq = token_table.groupBy(F.col(token).alias("token")).agg(F.count("*").alias("n")).where(F.col("n") >= least)
    down = freq.withColumn("_one", F.lit(1).cast("bigint"))
    return ordered.running(down, [F.desc("n"), F.col("token")], {"_id": "_one"}).select("token", "n", (F.col("_id") + (reserved - 1)).alias("id"))


def encoded(token_table: DataFrame, vocab: DataFrame, token: str = "token") -> DataFrame:
    """Token rows with their ids, 0 for unknown ones."""
    ids = vocab.select(F.col("token").alias(token), F.col("id").alias("token_id"))
    return token_table.join(ids, token, "left").withColumn("token_id", F.coalesce("token_id", F.lit(0)).cast("bigint"))
