"""Operators that work by ranges, stretches and ordered streams, against plain loops."""

from __future__ import annotations

import itertools
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from glossweave.functions import text
from glossweave.operators import coreference, decode, lookup, metrics, ordered, records, reports, scoring, spans, vector_ops
from glossweave.sources import readers, writers


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_tokens_of_all_scripts_and_spans_within_sentences(spark):
    df = spark.createDataFrame([("d", "Töth lived in the U.S. He moved. né à Œuvre_2 東京")], "k string, t string")
    words = df.select(text.tokens(F.col("t"))).first()[0]
    assert words == ["Töth", "lived", "in", "the", "U", ".", "S", ".", "He", "moved", ".", "né", "à", "Œuvre", "_", "2", "東京"]
    known = spark.createDataFrame([("U . S",), ("the U",), ("S",), ("moved . né",), ("Töth lived",), ("",), (None,)], "mention string")
    got = spans.spotted(spans.chunks(df, "k", "t", by="document"), known)
    assert rows(got) == [("d", 0, 2, "Töth lived"), ("d", 3, 5, "the U"), ("d", 6, 7, "S")]
    made = spans.all_spans(spans.chunks(df, "k", "t", by="document"), width=3).collect()
    assert all("." not in words[r["begin"] : r["end"]] for r in made)
    want = {(b, e) for b in range(len(words)) for e in range(b + 1, min(b + 3, len(words)) + 1) if "." not in words[b:e]}
    assert {(r["begin"], r["end"]) for r in made} == want


def test_token_offsets_and_places(spark):
    texts = ["  Ab, c\n\tdé “x”", "", "   ", "a"]
    df = spark.createDataFrame(list(enumerate(texts)) + [(9, None)], "k int, t string")
    for r in spans.token_offsets(df, "k", "t").collect():
        assert texts[int(r["doc"])][r["start"] : r["stop"]] == r["token"]
    quoted = spark.createDataFrame([(["He", "said", '"', "so", '"', "gone", "!"], "He said “so'' !")], "w array<string>, t string")
    assert quoted.select(text.token_places(F.col("w"), F.col("t"))).first()[0] == [0, 3, 8, 9, 11, -1, 14]


def test_tokens_split_at_given_spans(spark):
    df = spark.createDataFrame([("d", "unbreakable things"), ("e", "as is")], "k string, t string")
    given = spark.createDataFrame([("d", 2, 5), ("d", 12, 6), ("f", 0, 3)], "doc string, start bigint, length bigint")
    out = spans.split_at(spans.token_offsets(df, "k", "t"), given)
    assert [(r["doc"], r["pos"], r["token"]) for r in out.orderBy("doc", "pos").collect()] == [("d", 0, "un"), ("d", 1, "break"), ("d", 2, "able"), ("d", 3, "things"), ("e", 0, "as"), ("e", 1, "is")]


def test_running_sums(spark):
    data = [(i, (i * 37) % 11, 1.5) for i in range(300)]
    df = spark.createDataFrame(data, "k int, v int, w double").repartition(7)
    out = ordered.running(df, [F.desc("v"), F.col("k")], {"n": "v", "x": "w"}).collect()
    total, want = 0, {}
    for i, (k, v, _) in enumerate(sorted(data, key=lambda r: (-r[1], r[0])), 1):
        total += v
        want[k] = (total, 1.5 * i)
    assert {r["k"]: (r["n"], r["x"]) for r in out} == want
    assert ordered.running(df.where("false"), [F.col("k")], {"n": "v"}).count() == 0


def test_lines_of_files_in_stretches(spark, tmp_path):
    body = [f"<doc id=\"{i // 9}\" title=\"t{i // 9}\">" if i % 9 == 0 else "</doc>" if i % 9 == 8 else f"line {i} " + "x" * (i % 40) for i in range(400)]
    (tmp_path / "a.txt").write_text("\n".join(body) + "\n")
    (tmp_path / "b.txt").write_bytes(b"one\r\n\r\nthree")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        got = readers.lines(spark, str(tmp_path)).collect()
        assert len({(r["file"], r["block"]) for r in got}) > 5
        by = {n: [r["line"] for r in sorted((r for r in got if r["file"].endswith(n)), key=lambda r: r["line_no"])] for n in ("a.txt", "b.txt")}
        assert by == {"a.txt": body, "b.txt": ["one", "", "three"]}
        assert sorted(r["line_no"] for r in got if r["file"].endswith("a.txt")) == list(range(400))
        dump = readers.wiki_dump(spark, str(tmp_path / "a.txt")).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert {(r["doc_id"], r["title"], r["line_no"], r["line"]) for r in dump} == {(i // 9, f"t{i // 9}", i, body[i]) for i in range(400) if i % 9 not in (0, 8)}


def test_counters(spark, tmp_path):
    (tmp_path / "n.tsv").write_text("a\t1\nb\t2\na\t3\nbad\nc\tx\nd\t4\t5\n")
    assert readers.line_counters(spark, str(tmp_path), (2,), 1).first().asDict() == {"lines": 6, "bad_arity": 2, "bad_id": 1, "repeated": 1}
    assert rows(readers.names_by_id(spark, str(tmp_path))) == [(1, "a"), (2, "b"), (3, "a")]


def brute_coref(items):
    seen, out = [], []
    for m, cands in items:
        hit = None
        if len(m) >= 3:
            hit = next((s for s in reversed(seen) if len(s[0]) > len(m) and re.search(r"(?<![^\W\d_])" + re.escape(m) + r"(?![^\W\d_])", s[0])), None)
        if hit is None and len(m) >= 3 and cands[0][2]:
            seen.append((m, cands))
        out.append((m, hit[0] if hit else None, sorted(c[0] for c in cands + (hit[1] if hit else []))))
    return out


def test_sequential_coreference_against_a_loop(spark):
    rng = random.Random(5)
    names = ["John Smith", "Smith", "John", "J. Smith", "Ann-Mary Lee", "Lee", "Mary", "Ann-Mary", "Jo", "Smiths", "Möller Jr.", "Möller", "...", "A.B.C.D", "B.C"]
    data, want = [], {}
    for d in range(6):
        items = [(rng.choice(names), [(rng.randrange(100), 0.5, rng.random() < 0.7)]) for _ in range(40)]
        data += [(f"d{d}", i * 10, i * 10 + 5, m, c) for i, (m, c) in enumerate(items)]
        want[f"d{d}"] = brute_coref(items)
    df = spark.createDataFrame(data, "doc string, begin int, end int, mention string, cands array<struct<id:int,p:double,person:boolean>>")
    out = coreference.sequential(df).orderBy("doc", "begin").collect()
    got = {d: [(r["mention"], r["super"], sorted(c["id"] for c in r["cands"])) for r in out if r["doc"] == d] for d in want}
    assert got == want


def test_nearest_given_against_all_pairs(spark):
    rng = random.Random(6)
    make = lambda n: [(f"d{rng.randrange(3)}", b := rng.randrange(60), b + rng.randrange(1, 9)) for _ in range(n)]
    p, g = [(*x, i, 0.5) for i, x in enumerate(make(80))], [x for x in make(12) if x[0] != "d2"]
    want = []
    for d, b, e, i, s in p:
        near = min(((abs(b - x) + abs(e - y), x, y) for dd, x, y in g if dd == d), default=None)
        if near:
            want.append((d, b, e, i, s, *near))
    got = decode.nearest_given(spark.createDataFrame(p, "doc string, begin int, end int, entity int, score double"), spark.createDataFrame(g, "doc string, begin int, end int"))
    assert rows(got) == sorted(want, key=str)


def test_hot_overlaps(spark):
    p = [("d", i, i + 40, 1) for i in range(0, 400, 3)]
    g = [("d", i, i + 70, 1) for i in range(5, 400, 50)]
    schema = "doc string, begin int, end int, entity int"
    out = metrics.weak_matched(spark.createDataFrame(p, schema), spark.createDataFrame(g, schema))
    assert out.count() == len(p)
    assert {(r["begin"], r["matched"]) for r in out.collect()} == {(b, any(x < e and b < y for _, x, y, _ in g)) for _, b, e, _ in p}


def brute_beliefs(cands, rounds, damping, c):
    spans_of = sorted({s for s, *_ in cands})
    n = len(spans_of)
    q = {(s, k, j): 0.0 for s, k, *_ in cands for j in spans_of}
    soft = lambda d: {k: v - math.log(sum(math.exp(x) for x in d.values())) for k, v in d.items()}
    for _ in range(rounds):
        g = {(s, k): sum(q[s, k, j] for j in spans_of) for s, k, *_ in cands}
        new = {}
        for i, j in itertools.product(spans_of, spans_of):
            raw = {k: max(u2 + 2 / n * float(np.array(v) @ c @ np.array(v2)) + g[s2, k2] for s2, k2, u2, v2 in cands if s2 == j) for s, k, _, v in cands if s == i}
            for k, m in soft(raw).items():
                new[i, k, j] = math.log((1 - damping) * math.exp(q[i, k, j]) + damping * (1.0 if i == j else math.exp(m)))
        q = new
    out = {}
    for i in spans_of:
        out |= {(i, k): b for k, b in soft({k: u + sum(q[i, k, j] for j in spans_of) for s, k, u, _ in cands if s == i}).items()}
    return out


def test_beliefs_against_plain_loops(spark):
    rng = np.random.default_rng(8)
    cands = [(s, k, float(rng.normal()), rng.normal(size=3).tolist()) for s, n in enumerate((2, 3, 1, 4)) for k in range(n)]
    df = spark.createDataFrame([("d", *c) for c in cands] + [("e", 0, 0, None, [1.0, 0.0, 0.0]), ("e", 1, 0, 0.1, None)], "doc string, span int, cand int, local double, vec array<double>")
    c = rng.normal(size=(3, 3))
    for rounds, damping, weights in ((3, 0.2, c), (10, 0.5, None), (0, 0.9, c)):
        got = {(r["span"], r["cand"]): r["belief"] for r in scoring.loopy_beliefs(df, rounds, damping, None if weights is None else weights.tolist()).collect()}
        want = brute_beliefs(cands, rounds, damping, np.eye(3) if weights is None else c)
        assert got == pytest.approx(want, abs=1e-9)


def test_sampling_losses(spark):
    s, lp = [0.4, 0.35, -0.2], [-1.0, -2.0, -3.0]
    df = spark.createDataFrame([(s, lp)], "s array<double>, lp array<double>")
    got = df.select(*(scoring.sampling_loss(k, F.col("s"), F.col("lp")).alias(k) for k in ("maxm", "neg", "nce", "is"))).first()
    soft = lambda x: (math.log1p(math.exp(-x[0])) + sum(math.log1p(math.exp(v)) for v in x[1:])) / len(x)
    z = [a - b for a, b in zip(s, lp)]
    assert got["maxm"] == pytest.approx((0.1 - 0.4 + 0.35) / 3)
    assert got["neg"] == pytest.approx(soft(s)) and got["nce"] == pytest.approx(soft([x - math.log(2) for x in z]))
    assert got["is"] == pytest.approx(math.log(sum(map(math.exp, z))) - z[0])
    with pytest.raises(ValueError):
        scoring.sampling_loss("other", F.col("s"))


def test_components(spark):
    df = spark.createDataFrame([("d", 0, 0, 0.5, [1.0, 0.0])], "doc string, span int, cand int, p double, vec array<double>")
    assert scoring.assembled("pem", df, dim=2).first()["score"] == pytest.approx(math.log(0.5))
    for bad in ("", "pem_lstm", "attention"):
        with pytest.raises(ValueError):
            scoring.assembled(bad, df, dim=2)


def test_products_by_another_similarity(spark):
    x = np.random.default_rng(2).normal(size=(60, 4))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(None, [1.0] * 4), (99, None)], "id int, vec array<double>")
    near = lambda a, b: -((a[:, None] - b[None]) ** 2).sum(2)
    got = {(r["query"], r["item"], r["rank"]) for r in vector_ops.top_products(df.where("id < 7"), df, 3, query_rows=3, similarity=near).collect()}
    want = {(q, int(j), r + 1) for q in range(7) for r, j in enumerate(sorted((j for j in range(60) if j != q), key=lambda j: (((x[q] - x[j]) ** 2).sum(), j))[:3])}
    assert got == want
    assert vector_ops.top_products(df.where("false"), df, 3).count() == 0


def test_maps_and_settings(spark, tmp_path):
    base = spark.createDataFrame([(5, 0), (6, 1)], "entity_id bigint, row bigint")
    more = spark.createDataFrame([(6, 0), (7, 1)], "entity_id bigint, row bigint")
    assert rows(readers.renamed_map(base, more)) == [(-6, 2), (5, 0), (6, 1), (7, 3)]
    assert rows(lookup.reversed_map(base, "entity_id", "row")) == [(0, 5), (1, 6)]
    with pytest.raises(Exception, match="several keys"):
        lookup.reversed_map(base.withColumn("row", F.lit(1)), "entity_id", "row").collect()
    writers.write_settings({"lr": "0.1"}, spark, str(tmp_path / "s"))
    assert readers.stored_settings(spark, str(tmp_path / "s"), {"lr": "1", "dim": "3"}) == {"lr": "0.1", "dim": "3"}
    parts = readers.endless(lambda: ["a", "b"], 2, lambda: ["c"])
    assert list(itertools.islice(parts, 7)) == ["a", "b", "a", "b", "c", "c", "c"]


def test_padded_batches_and_masks(spark):
    df = spark.createDataFrame([(i, list(range(i))) for i in range(1, 6)], "k int, w array<bigint>")
    got = {r["k"]: (r["batch"], r["place"], r["w"]) for r in records.padded_batches(df, ["k"], "w", 2).collect()}
    assert got[1] == (0, 0, [0, 0]) and got[3] == (1, 0, [0, 1, 2, 0]) and got[5] == (2, 0, [0, 1, 2, 3, 4])
    one = spark.createDataFrame([([7, 8, 9], 1, 2)], "w array<int>, b int, e int")
    places, mask = spans.window_mask(F.col("w"), F.col("b"), F.col("e"), 2)
    assert tuple(one.select(places, mask).first()) == ([0, 0, 2, 2], [False, True, True, False])


def test_thresholds_in_logs(spark):
    df = spark.createDataFrame([("r", 1, "Best validation threshold = -0.25 with F1=71.5"), ("r", 2, "other")], "run string, line_no int, line string")
    assert rows(reports.thresholds(df)) == [("r", 1, -0.25, 71.5)]
