from __future__ import annotations

import os

import numpy as np
import pytest

from glossweave.llm import language

SAMPLES = "/root/testdata/sf0.001/lang_samples.parquet"
pytestmark = pytest.mark.skipif(not os.path.exists(SAMPLES), reason="no samples here")


@pytest.fixture(scope="module")
def samples(spark):
    return spark.read.parquet(SAMPLES)


@pytest.fixture(scope="module")
def profiles(spark, samples):
    return language.learned(samples, spark.createDataFrame([], "doc_id bigint, text string, lang string"), "text", "lang")


def test_table_is_the_product_of_vectors():
    dim, seed = 256, 3
    counts = np.stack([language.counted([t]) for t in ("the cat sat on the mat", "der hund lief um das haus")])
    p = language.fitted(counts, ("a", "b"), dim, seed)
    third = language.letter_vectors(dim, seed)
    share = np.sqrt(counts / counts.sum(1, keepdims=True))
    bundle = lambda c: sum(c[g] * np.roll(third[g >> 10], 2) * np.roll(third[(g >> 5) & 31], 1) * third[g & 31] for g in np.flatnonzero(c))
    protos = np.stack([bundle(s) for s in share])
    protos /= np.linalg.norm(protos, axis=1, keepdims=True)
    protos -= protos.mean(0)
    text = language.counted(["the dog"])
    text[0] = 0
    want = protos @ bundle(text) / np.sqrt(dim)
    got = (p.table * text).sum(1)
    assert np.allclose(got, want, atol=1e-3)


def test_held_out_accuracy(samples):
    rows = [(r["lang"], r["text"]) for r in samples.collect()]
    langs = tuple(sorted({x for x, _ in rows}))
    right = 0
    for fold in range(3):
        train = [r for i, r in enumerate(rows) if i % 3 != fold]
        test = [r for i, r in enumerate(rows) if i % 3 == fold]
        p = language.fitted(np.stack([language.counted([t for x, t in train if x == n]) for n in langs]), langs)
        _, _, _, lang, _ = language.line_languages([t.replace("\n", " ") for _, t in test], p)
        right += sum(langs[g] == x for g, (x, _) in zip(lang, test))
    assert right / len(rows) > 0.97


def test_lines_and_documents(spark, samples, profiles):
    by = {}
    for r in samples.collect():
        by.setdefault(r["lang"], []).append(r["text"].replace("\n", " "))
    en, de, fr = (" ".join(by[x][:3]) for x in ("en", "de", "fr"))
    rows = [(1, "German", f"{en}\n\n{de}", "x"), (2, None, f"{fr} {fr} {en}", "x"), (3, "en", None, "x"), (4, "en", "", "x"), (5, "fr", "123 456 !!", "x"), (6, "en", en.upper(), "x"), (7, "en", (en + " ") * 300, "x"), (7, "en", (en + " ") * 300, "x")]
    df = spark.createDataFrame(rows, "doc bigint, label string, text string, lang string")
    out = language.segment_languages(df.withColumn("label", language.label_language(df["label"])), "doc", "text", profiles, keep=["label"]).collect()
    got = {(r["key"], r["line_no"]): r["lang"] for r in out}
    assert got == {(1, 0): "en", (1, 1): None, (1, 2): "de", (2, 0): "fr", (4, 0): None, (5, 0): None, (6, 0): "en", (7, 0): "en"}
    assert sum(r["key"] == 7 for r in out) == 2
    assert all(0 <= r["confidence"] <= 1 for r in out)
    assert {r["label"] for r in out if r["key"] == 1} == {"de"}
    assert next(r["doc_lang"] for r in out if r["key"] == 2) == "fr"
    assert next(r["n_words"] for r in out if r["key"] == 1) == len(en.split())


def test_labels(spark):
    cases = {"en": "en", "EN": "en", "eng": "en", "English": "en", "en_US": "en", "de-DE": "de", "ger": "de", " nl ": "nl", "dut": "nl", "und": None, "": None, "??": None, None: None, "n/a": None, "Italian": "it", "es-MX": "es", "fre": "fr"}
    df = spark.createDataFrame([(k,) for k in cases], "l string")
    got = {r["l"]: r["c"] for r in df.select("l", language.label_language(df["l"]).alias("c")).collect()}
    assert got == cases


def test_empty(spark, profiles):
    df = spark.createDataFrame([], "doc bigint, text string")
    assert language.segment_languages(df, "doc", "text", profiles).count() == 0


def test_every_sample_counts(spark, samples):
    """Samples of one language, however many come first, don't push out the others."""
    en = samples.where("lang = 'en'").select("lang", "text")
    many = en.crossJoin(spark.range(2000).select()).unionByName(samples.select("lang", "text")).coalesce(1)
    none = spark.createDataFrame([], "doc_id bigint, text string, lang string")
    p = language.learned(many, none, "text", "lang")
    assert p.langs == ("de", "en", "es", "fr", "it", "nl")
    counts = {(r["lang"], r["gram"]): r["n"] for r in language.trigram_counts(samples, "lang", "text").collect()}
    whole = language.counted([r["text"] for r in samples.where("lang = 'de'").collect()])
    assert {g: n for (x, g), n in counts.items() if x == "de"} == {int(g): int(whole[g]) for g in np.flatnonzero(whole)}


def test_copies_do_not_fill_the_sample(spark):
    from glossweave.llm._spark import hash_sample

    rows = spark.range(30_000).selectExpr("if(id < 20000, 7, id) AS k", "repeat('x', cast(id >= 20000 as int)) AS t")
    got = hash_sample(rows, 500)
    assert got.count() == got.distinct().count() == 500
    assert sorted(got.collect()) == sorted(hash_sample(rows.repartition(7), 500).collect())
