from __future__ import annotations

import struct

import pytest
from pyspark.sql import functions as F

from glossweave.sources import readers, writers


@pytest.fixture
def put(tmp_path):
    def write(name, body):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(body if isinstance(body, bytes) else body.encode())
        return str(path)

    return write


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_maps(spark, put):
    p = put("names.txt", "Paris\t1\nParis\t2\nbroken line\nRome\t3\nDis\t9\nx\ty\n")
    dis = readers.disambiguations(spark, put("dis.txt", "9\tDis\nbad\n"))
    got = readers.names(spark, p, dis)
    assert rows(got.select("name", "entity_id")) == [("Paris", 2), ("Rome", 3)]
    assert rows(readers.redirects(spark, put("r.txt", "Old\tNew\nonly one\n"), lowercase=True)) == [("old", "new")]
    known = readers.persons(spark, put("p.txt", "Paris \nNobody\n\n"), got)
    assert rows(known.select("name", "entity_id")) == [("Paris", 2)]
    base = readers.id_map(spark, put("ids.txt", "1\t1\n500\t2\n"))
    assert rows(base) == [(0, 0), (500, 1)]
    ext = readers.id_map(spark, put("ext.txt", "500\t1\n600\t2\n"))
    assert rows(readers.extended_map(base, ext)) == [(0, 0), (500, 1), (600, 3)]
    assert rows(readers.universe(spark, put("u.txt", "5\ta\nx\tb\n5\tc\n"))) == [(5,)]


def test_dictionary_roundtrip(spark, put, tmp_path):
    p = put("pem.txt", "ny\t10\t1,7,New_York\t2,3,York,_New\nbad\n")
    got = readers.dictionary(spark, p)
    assert rows(got.select("mention", "total", "pos", "entity_id", "score", "name")) == [("ny", 10, 0, 1, 7.0, "New_York"), ("ny", 10, 1, 2, 3.0, "York,_New")]
    writers.write_dictionary(got.select("mention", "entity_id", F.replace("name", F.lit("_"), F.lit(" ")).alias("name"), F.col("score").cast("int").alias("n")), str(tmp_path / "out"))
    assert rows(readers.dictionary(spark, str(tmp_path / "out"))) == rows(got)
    yago = readers.dictionary(spark, put("yago.txt", "ny\t2\t1,New_York\t2,York,_New\n"), scored=False)
    assert rows(yago.select("entity_id", "name")) == [(1, "New_York"), (2, "York,_New")]
    means = readers.means(spark, put("means.tsv", '"N &amp; Y"\tcaf\\u00e9_one\n'))
    assert rows(means) == [("N & Y", "Café one")]


def test_dump_and_anchors(spark, put):
    body = '<doc id="12" url="u" title="A">\nsee <a href="New_York">NY</a> and <a href="List%20of%20x">l</a>\n<a href="open">broken\n</doc>\n<doc id="13" url="u" title="B">\nlast <a href="t%C3%B6th#x">f</a><a href="wikt:rome">R</a>\n'
    dump = readers.wiki_dump(spark, put("dump.txt", body))
    assert rows(dump.select("doc_id", "title").distinct()) == [(12, "A"), (13, "B")]
    assert rows(readers.anchors(dump, "line", "doc_id").select("doc_id", "mention", "target")) == [(12, "NY", "New york".title().replace("York", "York")), (13, "R", "Rome")]
    plain = [r[0] for r in dump.where("line_no = 1").select(readers.without_anchors("line")).collect()]
    assert plain == ["see NY and l"]
    tok = readers.tokenised_dump(spark, put("tok.txt", "a b  c\n"))
    assert tok.collect()[0]["tokens"] == ["a", "b", "c"]


def test_conll(spark, put):
    body = "-DOCSTART- (1 testa X)\nEU\tB\tEU\tEuropean_Union\thttp://x/European_Union\t9317\t/m/02jxk\nrejects\nGerman\tB\tGerman\t--NME--\n\n.\n-DOCSTART- (2 testb Y)\nx\nbad\tcolumns\n"
    got = readers.split_of(readers.conll(spark, put("aida.tsv", body)))
    assert rows(got.select("doc", "pos", "word", "bio", "entity_id", "split")) == sorted(
        [("1 testa X", 0, "EU", "B", 9317, "dev"), ("1 testa X", 1, "rejects", "O", None, "dev"), ("1 testa X", 2, "German", "B", None, "dev"), ("1 testa X", 3, ".", "O", None, "dev"), ("2 testb Y", 0, "x", "O", None, "test")]
    )


def test_benchmarks(spark, put):
    xml = put("a.xml", '<x><document docName="d1"><annotation><mention>NY</mention><wikiName>New York</wikiName><offset>0</offset><length>2</length></annotation></document></x>')
    texts = readers.raw_texts(spark, put("raw/d1", "NY is big"))
    assert rows(readers.standoff_xml(spark, xml, texts)) == [("d1", "NY", "New York", 0, 2, "NY is big")]
    raw = put("raw.txt", "DOCSTART_a\ntext: hello world\n2\n0_z_5_z_[http://x, http://y]\n6_z_5_z_[]\nDOCSTART_b\ntext: none\n0\n")
    got = {r["doc"]: (r["text"], [(a["start"], a["length"], a["uris"]) for a in r["annotations"]]) for r in readers.raw_records(spark, raw).collect()}
    assert got == {"a": ("hello world", [(0, 5, ["http://x", "http://y"]), (6, 5, [""])]), "b": ("none", [])}
    nif = put("x.ttl", '@prefix nif: <n> .\n<http://e/1#char=0,2>\n a nif:Phrase ;\n nif:anchorOf "NY" ;\n nif:beginIndex "0"^^xsd:int ;\n nif:endIndex "2"^^xsd:int ;\n itsrdf:taIdentRef <http://w/New_York> .\n')
    assert [tuple(r)[1:] for r in readers.nif(spark, nif).collect()] == [("http://e/1#char=0,2", 0, 2, "NY", "http://w/New_York")]
    back = writers.nif_lines(spark.createDataFrame([("http://e/1", 0, 2, "NY", "http://w/New_York")], "doc string, begin int, end int, anchor string, ref string"))
    assert rows(readers.nif(spark, put("y.ttl", back.collect()[0]["value"] + "\n")).select("begin", "end", "anchor", "ref")) == [(0, 2, "NY", "http://w/New_York")]


def test_vectors(spark, put):
    data = b"2 3\n" + b"one " + struct.pack("<3f", 1, 2, 3) + b"\ntwo " + struct.pack("<3f", 4, 5, 6) + b"\n"
    assert {r["word"]: r["vec"] for r in readers.binary_vectors(spark, put("w.bin", data)).collect()} == {"one": [1, 2, 3], "two": [4, 5, 6]}
    assert {r["word"]: r["vec"] for r in readers.text_vectors(spark, put("g.txt", "a 1 2.5\nb 0 1\n")).collect()} == {"a": [1, 2.5], "b": [0, 1]}
    table = spark.createDataFrame([(7, [1.0, 2.5])], "id bigint, vec array<float>")
    assert writers.vectors_as_text(table).collect()[0][0] == "7 1.0 2.5"
    assert rows(readers.relatedness(spark, put("rel.txt", "1 qid:3 1:0 # 10-20 x\nbad\n"))) == [(3, 10, 20, 1)]


def test_messages(spark):
    df = spark.createDataFrame([('{"text":"ab","spans":[{"start":0,"length":1}]}',), ("no json",)], "value string")
    got = {r["text"]: r["spans"] for r in readers.requests(df).collect()}
    assert got["ab"][0]["length"] == 1 and got[None] is None
    answer = '{"Resources":[{"@URI":"http://x/N%C3%BC","@surfaceForm":"N","@offset":"4","@types":"DBpedia:Place,Schema:City"}]}'
    r = readers.annotator_answers(spark.createDataFrame([(answer,)], "value string")).collect()[0]
    assert (r["surface"], r["offset"], r["uri"], r["types"]) == ("N", 4, "http://x/Nü", ["http://dbpedia.org/ontology/Place", "http://schema.org/City"])
    spans = spark.createDataFrame([("d", 'a<"b', 0, 'a<'), ("d", 'a<"b', 3, "b")], "doc string, text string, start int, mention string")
    assert writers.given_spans_xml(spans).collect()[0]["xml"] == '<annotation text="a&lt;&quot;b"><surfaceForm name="a&lt;" offset="0"/><surfaceForm name="b" offset="3"/></annotation>'
    assert readers.settings("a=1|b=2|junk", {"a": "0", "c": "9"}) == {"a": "1", "b": "2", "c": "9"}


def test_files_tables_epochs(spark, put, tmp_path):
    put("tree/a/x.txt", "1")
    put("tree/b/y.txt", "22")
    assert sorted(r["size"] for r in readers.files(spark, str(tmp_path / "tree"), "*.txt").collect()) == [1, 2]
    calls = []
    make = lambda: calls.append(1) or spark.range(3)
    assert readers.kept(spark, str(tmp_path / "kept"), make).count() == readers.kept(spark, str(tmp_path / "kept"), make).count() == 3
    assert len(calls) == 1
    assert readers.epochs(spark.range(2), 3, spark.range(1)).count() == 7
    writers.frequency_table(spark.createDataFrame([("a", 12), ("b", 3)], "w string, n int"), str(tmp_path / "freq"), "n")
    assert [r[0] for r in spark.read.text(str(tmp_path / "freq")).collect()] == ["a\t12"]
    samples = spark.createDataFrame([("el", "x", [1]), ("ed", "y", [2])], "mode string, dataset string, words array<int>")
    writers.write_samples(samples, str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).where("mode = 'el'").count() == 1


def test_single_strings(spark):
    df = spark.createDataFrame([("d", 1, "b"), ("d", 0, "a")], "doc string, pos int, word string")
    assert rows(writers.single_strings(df)) == [("d", "a b")]


def test_frequency_table_keeps_names_with_tabs_and_line_breaks(spark, tmp_path):
    names = ["plain", "end\t", "a\tb", "two\nlines", "c\r\nd", "back\\slash", "not a tab\\t", "\\\\t\t\\", "\\", ""]
    table = spark.createDataFrame([(w, 10 + i) for i, w in enumerate(names)] + [("rare\t", 9)], "w string, n int")
    writers.frequency_table(table, str(tmp_path / "freq"), "n")
    assert rows(readers.frequency_table(spark, str(tmp_path / "freq"))) == sorted((w, 10 + i) for i, w in enumerate(names))


def test_frequency_query_with_repeated_odd_names(spark, tmp_path):
    from glossweave.plans import format_queries

    kinds = "annotation_id bigint, doc string, mention string, wikiName string, m_offset int, m_length int, annotated_at timestamp, ingested_at timestamp"
    odd = ["Pexthas\t", "Pexthas\t", "a\nb", "a\nb", "a\nb", "once\t", "plain", "plain"]
    spark.createDataFrame([(i, "d", "m", w, 0, 1, None, None) for i, w in enumerate(odd)], kinds).write.parquet(str(tmp_path / "annotations.parquet"))
    assert rows(format_queries.snk_frequency_table(spark, str(tmp_path)).select("entity", "freq")) == [("Pexthas\t", 2), ("a\nb", 3), ("plain", 2)]
