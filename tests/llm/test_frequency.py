from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np

from glossweave.llm import frequency


def brute(rows, n_max):
    occ, recs = Counter(), defaultdict(set)
    for key, terms in rows:
        if key is None or terms is None:
            continue
        for n in range(1, n_max + 1):
            for i in range(len(terms) - n + 1):
                g = tuple(terms[i : i + n])
                if None not in g:
                    occ[g] += 1
                    recs[g].add(key)
    return {g: (c, len(recs[g])) for g, c in occ.items()}


def test_ngrams_against_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = [(f"d{i}", [str(x) for x in rng.integers(0, 3, rng.integers(0, 40))]) for i in range(60)]
    rows += [("hot", ["0"] * 500), ("hot", ["0", None, "1"]), (None, ["0"]), ("n", None), ("e", []), rows[0]]
    df = spark.createDataFrame(rows, "id string, ts array<string>")
    for n in (1, 3, 4):
        out = frequency.ngram_counts(df, "id", "ts", n).collect()
        got = {tuple(r[f"t{i}"] for i in range(1, n + 1) if r[f"t{i}"] is not None): (r["occ"], r["recs"]) for r in out}
        assert len(got) == len(out)
        assert got == brute(rows, n)


def test_intervals_across_parts(spark):
    # More parts than records: every interval is on a border somewhere.
    rows = [(f"d{i % 7}", ["a", "b"] * 5) for i in range(40)]
    df = spark.createDataFrame(rows, "id string, ts array<string>").repartition(16)
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        out = frequency.ngram_counts(df, "id", "ts", 2).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert {tuple(x for x in (r["t1"], r["t2"]) if x): (r["occ"], r["recs"]) for r in out} == brute(rows, 2)


def test_marks(spark):
    rows = [
        ("a", {"x": 12, " y ": 1, "y": 2, "DOCSTART_a": 99, "*NL*": 4, "  ": 3}, {"c": 5}, 1),
        ("a", {"x": 12, " y ": 1, "y": 2, "DOCSTART_a": 99, "*NL*": 4, "  ": 3}, {"c": 5}, 2),  # redelivered
        ("b", {"x": 1, "z": None, "X": 30}, None, 1),
        ("c", None, {"c": 0, "k": 20}, 1),
        ("d", {}, {}, 1),
    ]
    df = spark.createDataFrame(rows, "doc string, w map<string,bigint>, c map<string,bigint>, ingested int").withColumnRenamed("ingested", "part")
    out = frequency.marked_terms(df, "doc", {"w": "word", "c": "char"}, []).collect()
    got = {(r["kind"], r["term"]): (r["occ"], r["recs"], r["mark"]) for r in out}
    assert got == {("word", "x"): (13, 2, None), ("word", "y"): (3, 1, "rare"), ("word", "X"): (30, 1, None), ("char", "c"): (5, 1, "rare"), ("char", "k"): (20, 1, None)}


def test_empty(spark):
    df = spark.createDataFrame([], "doc string, w map<string,bigint>")
    assert frequency.marked_terms(df, "doc", {"w": "word"}, []).count() == 0
