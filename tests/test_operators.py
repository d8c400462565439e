from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from glossweave.operators import coreference, decode, lookup, metrics, records, reports, scoring, spans


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_candidates_by_frequency_of_spelling(spark):
    pem = spark.createDataFrame([("new york", 1, 0.9), ("New York", 2, 0.8), ("usa", 3, 0.5), ("Usa", 4, 0.4)], "mention string, entity int, p double")
    freq = spark.createDataFrame([("new york", 10), ("New York", 10), ("usa", 7), ("Usa", 2)], "mention string, freq int")
    asked = spark.createDataFrame([("new york",), ("usa",), ("USA",), ("NOWHERE",), (None,)], "s string")
    got = {r["span"]: r["matched"] for r in lookup.candidates(asked, "s", pem, freq).collect()}
    # Equal counts: the title case; more for the surface: the surface.
    assert got == {"new york": "New York", "usa": "usa", "USA": "Usa"}
    low = spark.createDataFrame([("nowhere", 9, 1.0)], "mention string, entity int, p double")
    got = {r["span"]: r["entity"] for r in lookup.candidates(asked, "s", pem, freq, low).collect()}
    assert got["NOWHERE"] == 9


def test_greedy_against_a_loop(spark):
    rng = random.Random(0)
    data = [(f"d{rng.randrange(4)}", round(rng.random(), 1), b := rng.randrange(30), b + rng.randrange(1, 5), rng.randrange(0, 5)) for _ in range(200)]
    want = []
    for d in {x[0] for x in data}:
        taken = set()
        for _, s, b, e, i in sorted({x for x in data if x[0] == d}, reverse=True, key=lambda x: x[1:]):
            if i and not taken & set(range(b, e)):
                taken |= set(range(b, e))
                want.append((d, s, b, e, i))
    df = spark.createDataFrame(data, "doc string, score double, begin int, end int, entity int")
    assert rows(decode.greedy(df)) == sorted(want)
    assert decode.greedy(df.where("false")).count() == 0


def test_overlap_join_equals_all_pairs(spark):
    rng = random.Random(1)
    make = lambda n: [("d", b := rng.randrange(12), b + rng.randrange(1, 4), rng.randrange(3)) for _ in range(n)]
    p, g = make(40), make(15)
    want = sorted((*x, any(y[3] == x[3] and y[1] < x[2] and x[1] < y[2] for y in g)) for x in p)
    schema = "doc string, begin int, end int, entity int"
    got = metrics.weak_matched(spark.createDataFrame(p, schema), spark.createDataFrame(g, schema))
    assert rows(got.select("doc", "begin", "end", "entity", "matched")) == want


def test_sweep_agrees_with_the_evaluator(spark):
    rng = random.Random(2)
    p = [("d%d" % rng.randrange(5), b := rng.randrange(40), b + 2, rng.randrange(4), rng.randrange(20) / 20) for _ in range(150)]
    g = [("d%d" % rng.randrange(5), b := rng.randrange(40), b + 2, rng.randrange(4)) for _ in range(60)]
    preds = spark.createDataFrame(p, "doc string, begin int, end int, entity int, score double")
    gold = spark.createDataFrame(sorted(set(g)), "doc string, begin int, end int, entity int")
    best = metrics.best_threshold(preds, gold).collect()[0]
    total = metrics.micro_macro(metrics.confusion(preds, gold, best["threshold"])).collect()[0]
    assert (total["tp"], total["fp"], total["fn"]) == (best["tp"], best["fp"], best["fn"])
    assert total["micro_f1"] == pytest.approx(best["f1"])
    assert all(0 <= total[c] <= 1 for c in ("micro_p", "micro_r", "macro_p", "macro_r"))


def test_ideal_ranking_is_perfect(spark):
    df = spark.createDataFrame([(q, i, float(i < 3), int(i < 3)) for q in range(5) for i in range(10)], "q int, item int, score double, label int")
    assert {r["ap"] for r in metrics.average_precision(df, "q", "item", "score", "label").collect()} == {1.0}
    assert {round(r["ndcg"], 9) for r in metrics.ndcg(df, "q", "item", "score", "label", 5).collect()} == {1.0}
    assert {r["ndcg"] for r in metrics.ndcg(df.withColumn("label", F.lit(0)), "q", "item", "score", "label", 5).collect()} == {0.0}


def test_spans_never_cross_a_separator(spark):
    df = spark.createDataFrame([("a", ["x", "y", ".", "z"]), ("b", ["."]), ("c", []), ("d", None)], "chunk_id string, words array<string>")
    want = [("a", 0, 1), ("a", 0, 2), ("a", 1, 2), ("a", 3, 4)]
    assert rows(spans.all_spans(df, width=2)) == want
    assert rows(spans.span_texts(df, width=2).select("key", "begin", "end")) == want


def test_token_stream_roundtrip(spark):
    from glossweave.sources import writers

    docs = spark.createDataFrame([("d1", ["a", "b", "c"], [(0, 2, "7"), (2, 3, "8")]), ("d2", ["x"], [])], "doc string, words array<string>, gold array<struct<begin:int,end:int,entity:string>>")
    text = writers.token_stream_lines(docs)
    lines = text.select(F.lit("f").alias("file"), "doc", F.posexplode(F.split("value", "\n")).alias("p", "line"))
    lines = lines.select("file", (F.when(F.col("doc") == "d1", 0).otherwise(100) + F.col("p")).alias("line_no"), "line")
    got = {r["doc"]: (r["words"], [tuple(g) for g in r["gold"]]) for r in spans.parsed_stream(lines).collect()}
    assert got == {"d1": (["a", "b", "c"], [(0, 2, "7"), (2, 3, "8")]), "d2": (["x"], [])}


def test_tags(spark):
    tags = ["O", "B-P", "I-P", "B-P", "I-L", "O", "I-L"]
    df = spark.createDataFrame([("d", i, t) for i, t in enumerate(tags)], "doc string, pos int, tag string")
    got = rows(spans.tag_spans(df, "doc", "pos", "tag").select("begin", "end", "kind"))
    assert got == [(1, 3, "P"), (3, 4, "P"), (4, 5, "L"), (6, 7, "L")]


def test_splice(spark):
    texts = spark.createDataFrame([("d", "New York is big"), ("e", "plain"), ("f", None)], "doc string, text string")
    anns = spark.createDataFrame([("d", 0, 8, "1"), ("d", 4, 4, "2"), ("d", 12, 3, "3"), ("d", 12, 90, "4"), ("d", None, 2, "5")], "doc string, o int, n int, e string")
    got = {r["key"]: r["inline"] for r in spans.spliced(texts, "doc", "text", anns, "o", "n", "e").collect()}
    assert got == {"d": " MMSTART_1 New York MMEND  is  MMSTART_3 big MMEND ", "e": "plain"}


def test_sequential_coreference(spark):
    p = lambda i, person=True: [(i, 1.0, person)]
    data = [("d", 0, 2, "John Smith", p(1)), ("d", 5, 6, "Smith", p(2)), ("d", 8, 9, "Smit", p(3)), ("d", 10, 12, "Mary Smith", p(4)), ("d", 14, 15, "Smith", p(5)), ("d", 20, 22, "Paris Smith", p(6, False)), ("d", 25, 26, "Jo", p(7)), ("e", 0, 1, "Smith", p(8))]
    df = spark.createDataFrame(data, "doc string, begin int, end int, mention string, cands array<struct<id:int,p:double,person:boolean>>")
    got = {(r["doc"], r["begin"]): (r["super"], sorted(c["id"] for c in r["cands"])) for r in coreference.sequential(df).collect()}
    assert got[("d", 5)] == ("John Smith", [1, 2])
    assert got[("d", 8)] == (None, [3])
    assert got[("d", 14)] == ("Mary Smith", [4, 5])
    assert got[("e", 0)] == (None, [8])


def test_beliefs_favour_agreement(spark):
    data = [("d", s, c, 0.0, v) for s, c, v in [(0, 0, [1.0, 0.0]), (0, 1, [0.0, 1.0]), (1, 0, [1.0, 0.0]), (1, 1, [0.0, -1.0]), (2, 0, [1.0, 0.0])]]
    df = spark.createDataFrame(data, "doc string, span int, cand int, local double, vec array<double>")
    got = {(r["span"], r["cand"]): r["belief"] for r in scoring.loopy_beliefs(df).collect()}
    assert got[0, 0] > got[0, 1] and got[1, 0] > got[1, 1]
    assert np.exp(got[0, 0]) + np.exp(got[0, 1]) == pytest.approx(1)


def test_votes_leave_the_own_span_out(spark):
    data = [("d", 0, 0, 1.0, [1.0, 0.0]), ("d", 1, 1, 1.0, [0.0, 2.0]), ("d", 1, 2, 0.0, [1.0, 0.0]), ("e", 0, 3, 1.0, [1.0, 1.0])]
    df = spark.createDataFrame(data, "doc string, span int, cand int, local double, vec array<double>")
    got = {r["cand"]: r["vote"] for r in scoring.global_votes(df, scoring.voters(df, threshold=0.5), 2).collect()}
    assert got == {0: 0.0, 1: 0.0, 2: 1.0, 3: 0.0}


def test_networks(spark):
    df = spark.createDataFrame([([[1.0, 0.0], [0.0, 1.0], [2.0, 2.0]], [0.0, 0.0, 5.0])], "w array<array<double>>, s array<double>")
    emb = df.select(scoring.span_embedding(F.col("w"), F.lit(0), F.lit(2), F.col("s"))).collect()[0][0]
    assert emb == pytest.approx([1, 0, 0, 1, 0.5, 0.5])
    out = df.select(scoring.feed_forward(F.col("s"), [([[1, 1, 1], [-1, -1, -1]], [0, 0]), ([[1, 1]], [1])])).collect()[0][0]
    assert out == [6.0]


def test_records_roundtrip(spark):
    df = spark.createDataFrame([("d", "NY", ["in"], [], [(1, 0.5, "New York"), (2, 0.25, "New, York")], 2), ("d", "LA", [], ["x", "y"], [], 9)], "doc string, mention string, left array<string>, right array<string>, cands array<struct<id:bigint,p:double,name:string>>, gold bigint")
    full = records.with_gold_position(df)
    back = {r["mention"]: r.asDict(True) for r in records.parsed(records.lines(full)).collect()}
    assert back["NY"]["cands"] == [{"id": 1, "p": 0.5, "name": "New York"}, {"id": 2, "p": 0.25, "name": "New, York"}]
    assert (back["NY"]["gold_pos"], back["NY"]["gold"]) == (2, 2)
    assert (back["LA"]["gold_pos"], back["LA"]["gold"], back["LA"]["cands"], back["LA"]["right"]) == (-1, 9, [], ["x", "y"])
    assert records.lines(full, training=True).count() == 1
    kept = {r["mention"]: [c["id"] for c in r["cands"]] for r in records.cut(df, 1, training=True).collect()}
    assert kept == {"NY": [2], "LA": []}


def test_weighted_draw_is_binned(spark):
    freq = spark.createDataFrame([("a", 3), ("b", 1), ("c", 6)], "k string, n int")
    at = spark.createDataFrame([(float(i),) for i in range(10)], "at double")
    got = reports.drawn(at, reports.sample_intervals(freq, "k", "n"), "k", "at", 2.0).groupBy("k").count()
    assert rows(got) == [("a", 3), ("b", 1), ("c", 6)]


def test_experiment_log(spark):
    log = ["args.eval_cnt =  3", "Evaluating EL datasets", "aida_dev", "micro P: 81.5  R: 80.0  F1: 80.7", "macro P: 79.0  R: 78.0  F1: 78.5", "args.eval_cnt =  4", "aida_dev", "micro P: 85.0  R: 84.0  F1: 84.5"]
    df = spark.createDataFrame([("r1", i, x) for i, x in enumerate(log)], "run string, line_no int, line string")
    got = reports.experiment_rows(df)
    assert rows(got.where("average = 'micro'").select("eval_cnt", "mode", "dataset", "f1")) == [(3, "EL", "aida_dev", 80.7), (4, "EL", "aida_dev", 84.5)]
    best = reports.best_runs(got.where("average = 'micro'"), "run", "f1", "eval_cnt").collect()[0]
    assert best["eval_cnt"] == 4
    files = spark.createDataFrame([("m-3.ckpt",), ("m-12.ckpt",), ("other",)], "file string")
    assert reports.latest_checkpoint(files).collect()[0][0] == 12


def test_early_stop(spark):
    df = spark.createDataFrame([(i, s) for i, s in enumerate([1.0, 1.05, 1.2, 1.25, 1.29, 1.35])], "step int, score double")
    got = [r["since"] for r in metrics.since_improvement(df, "step", "score", 0.1).orderBy("step").collect()]
    assert got == [0, 1, 0, 1, 2, 0]


def test_training_pairs_repeat_and_follow_frequency(spark):
    freq = spark.createDataFrame([("a", 90), ("b", 10)], "word string, n int")
    pos = spark.createDataFrame([(i, "w") for i in range(200)], "entity int, word string")
    make = lambda: rows(records.training_pairs(pos, reports.sample_intervals(freq, "word", "n"), 5, 100.0, 10.0))
    got = make()
    assert got == make() and len(got) == 1000
    assert 0.85 < sum(r[3] == "a" for r in got) / 1000 < 0.95


def test_epochs_have_orders_of_their_own(spark):
    df = spark.range(50)
    got = [r["id"] for r in records.shuffled_epochs(df, "id", 2, 7).collect()]
    assert sorted(got[:50]) == sorted(got[50:]) == list(range(50)) and got[:50] != got[50:]
    assert got == [r["id"] for r in records.shuffled_epochs(df, "id", 2, 7).collect()]


def test_losses(spark):
    df = spark.createDataFrame([(0.5, 0.2), (0.1, 0.2)], "p double, n double")
    out = df.select(*(c.alias(k) for k, c in scoring.margin_losses(F.col("p"), F.col("n")).items())).collect()
    assert [round(r["maxm"], 9) for r in out] == [0.0, 0.2]
    assert out[0]["nce"] == pytest.approx(np.log1p(np.exp(-0.5)) + np.log1p(np.exp(0.2)))
