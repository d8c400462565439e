from __future__ import annotations

import random
import re

import numpy as np

from glossweave.llm import leakage

RNG = random.Random(8)
WORDS = ["".join(RNG.choice("bdfgklmnprst") + RNG.choice("aeiou") for _ in range(RNG.randint(2, 4))) for _ in range(400)]
STOCK = "it was linked to the wrong page by many readers of the old town".split()


def passage(n=80):
    out = []
    while len(out) < n:
        out += RNG.sample(STOCK, 4) if RNG.random() < 0.2 else [RNG.choice(WORDS)]
    return out[:n]


ITEMS = [" ".join(passage()) for _ in range(12)]


def disturbed(words):
    out = []
    for w in words:
        r = RNG.random()
        out += [] if r < 0.03 else [w, RNG.choice(WORDS)] if r < 0.06 else [RNG.choice(WORDS)] if r < 0.09 else [w.upper()] if r < 0.2 else [f'<a href="{w}">{w}</a>'] if r < 0.25 else [w + ","]
    return out


def docs():
    texts, want = [], set()
    for i, item in enumerate(ITEMS):
        w = item.split()
        noise = lambda n: passage(n)
        for body in (w, disturbed(w), disturbed(w[:56]), [*w[:32], *noise(150), *w[40:74]], [*w[40:74], *noise(60), *w[:32]]):
            want.add((len(texts), i))
            texts.append(" ".join([*noise(70), *body, *noise(90)]))
        texts.append(" ".join([*noise(50), *w[20:34], *noise(50)]))
        broken = re.sub(r"(\w{4})(?=\w\w)", lambda m: m[0] + (" " if RNG.random() < 0.4 else ""), item)
        want.add((len(texts), i))
        texts.append(broken)
    return texts, want


def test_found_and_not_found(spark):
    texts, want = docs()
    rows = [(i, t, "x", 1.0) for i, t in enumerate(texts)] + [(9000, None, "x", 1.0), (9001, "", "x", 1.0), (9002, " \n ", "x", 1.0)]
    df = spark.createDataFrame(rows, "doc bigint, text string, key string, share double")
    items = spark.createDataFrame([*enumerate(ITEMS), (500, None), (501, "too short")], "item bigint, text string")
    for a_pass in (20_000, 5):
        out = leakage.leaked(df, "doc", "text", items, "item", "text", items_a_pass=a_pass).collect()
        assert {(r["key"], r["item"]) for r in out} == want
        assert len(out) == len(want)


def test_passes_do_not_change_shares(spark):
    rng = random.Random(21)
    word = lambda: rng.choice(WORDS)
    stock = [word() for _ in range(26)]
    # Every item quotes the stock text, and that is all most documents share with it.
    texts = [" ".join([*(word() for _ in range(30)), *stock, *(word() for _ in range(14))]) for _ in range(12)]
    broken = re.sub(r"(\w{4})(?=\w\w)", lambda m: m[0] + (" " if rng.random() < 0.4 else ""), " ".join(stock))
    docs = [" ".join([*(word() for _ in range(40)), *stock]), " ".join(word() for _ in range(40)) + " " + broken, " ".join(texts[4].split()[:40]), texts[7]]
    df = spark.createDataFrame(list(enumerate(docs)), "doc bigint, text string")
    items = spark.createDataFrame([*enumerate(texts), (100, texts[2])], "item bigint, text string")
    got = []
    for a_pass in (20_000, 5, 1):
        out = leakage.leaked(df, "doc", "text", items, "item", "text", items_a_pass=a_pass).collect()
        got.append(sorted((r["key"], r["item"], round(r["share"], 9)) for r in out))
    assert {(d, i) for d, i, _ in got[0]} == {(2, 4), (3, 7)}
    assert got[1] == got[0] and got[2] == got[0]


def test_search_equals_scan():
    (p,) = leakage.compiled([" ".join(passage(30)) for _ in range(40)])
    rng = np.random.default_rng(0)
    words = rng.integers(-1, len(p.vocabulary), 6000)
    for g in p.grams[::7]:
        at = rng.integers(0, 5990)
        words[at : at + 4] = g
    begins, ends = np.array([0, 1000, 1003, 4000]), np.array([1000, 1003, 4000, 6000])
    known = {tuple(g): i for i, g in enumerate(p.grams.tolist())}
    want = {(i, known[tuple(words[i : i + 4])]) for b, e in zip(begins, ends) for i in range(b, e - 3) if tuple(words[i : i + 4]) in known}
    for stretch in (1, 7, 192):
        at, pattern = leakage.occurrences(words, begins, ends, p, stretch)
        assert set(zip(at.tolist(), pattern.tolist())) == want


def test_empty(spark):
    df = spark.createDataFrame([], "doc bigint, text string")
    items = spark.createDataFrame([(1, ITEMS[0])], "item bigint, text string")
    assert leakage.leaked(df, "doc", "text", items, "item", "text").count() == 0
    some = spark.createDataFrame([(1, ITEMS[0])], "doc bigint, text string")
    assert leakage.leaked(some, "doc", "text", items.where("false"), "item", "text").count() == 0


def test_long_text():
    p = leakage.compiled(ITEMS)
    text = " ".join(passage(60_000)) + " " + ITEMS[3]
    t, i, _ = leakage.leaks([text], p)
    assert list(zip(t, i)) == [(0, 3)]


def test_short_items_and_scripts_without_spaces(spark):
    items = ["東京都は日本の首都であり世界最大の都市圏です", "three short words", "Xylograph", "pale harbour", "", " \n", "ภาษาไทยไม่มีช่องว่างระหว่างคำ"]
    texts = ["前文。東京都は日本の首都であり、世界最大の都市圏です。後文", "here are THREE short words, indeed", "a xylograph", "the pale harbour", "harbour, pale", "", None, "นี่คือภาษาไทยไม่มีช่องว่างระหว่างคำนะ", "日本の首都"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc bigint, text string")
    own = spark.createDataFrame(list(enumerate(items)), "item bigint, text string")
    out = leakage.leaked(df, "doc", "text", own, "item", "text").collect()
    assert {(r["key"], r["item"]) for r in out} == {(0, 0), (1, 1), (2, 2), (3, 3), (7, 6)}


def test_words_by_definition():
    """Three fifths of the words in one passage or two, but not in three, nor twice the same."""
    rng = random.Random(4)
    item = [f"w{rng.randint(0, 9999)}x{i}" for i in range(100)]
    noise = lambda n: [f"n{rng.randint(0, 99999)}" for _ in range(n)]
    (p,) = leakage.compiled([" ".join(item)])
    cases = [(item[10:70], True), (item[10:64], False), ([*item[:30], *noise(80), *item[60:90]], True), ([*item[:25], *noise(80), *item[30:55], *noise(80), *item[70:95]], False), ([*item[:40], *noise(80), *item[:40]], False), (sorted(item), False)]
    for words, want in cases:
        t, _, share = leakage.leaks([" ".join([*noise(20), *words, *noise(20)])], [p])
        assert (len(t) == 1) == want
        assert all(s >= 0.57 for s in share)


def test_hidden_characters():
    (p,) = leakage.compiled([ITEMS[2]])
    hidden = re.sub(r"(\w{3})(?=\w)", lambda m: m[0] + "\u00ad", ITEMS[2])
    assert leakage.leaks([hidden], [p])[2].tolist() == [1.0]


def test_memory_of_passes(spark):
    """Only one pass of items is held by the driver's Python, and plans carry none."""
    df = spark.createDataFrame([(1, ITEMS[0])], "doc bigint, text string")
    items = spark.createDataFrame(list(enumerate(ITEMS)), "item bigint, text string")
    out = leakage.leaked(df, "doc", "text", items, "item", "text", items_a_pass=1)
    assert {r["item"] for r in out.collect()} == {0}


def test_batches_do_not_matter():
    texts, _ = docs()
    p = leakage.compiled(ITEMS)
    t, i, share = leakage.leaks(texts, p)
    whole = sorted(zip(t.tolist(), i.tolist(), share.tolist()))
    alone = []
    for k, text in enumerate(texts):
        _, i, share = leakage.leaks([text], p)
        alone += [(k, *x) for x in zip(i.tolist(), share.tolist())]
    assert sorted(alone) == whole
