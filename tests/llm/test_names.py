from __future__ import annotations

import random

from hypothesis import given, settings
from hypothesis import strategies as st

from glossweave.llm import names


def osa(a, b):
    d = [[max(i, j) if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("abc", min_size=1, max_size=8), min_size=1, max_size=12), st.lists(st.text("abc", min_size=1, max_size=8), min_size=1, max_size=4), st.integers(0, 3), st.sampled_from(["", "z" * 70]))
def test_automaton_equals_edit_distance(words, typed, most, tail):
    """One name or many at once, in 64 bits or, behind a long tail, in more."""
    words, typed = [w + tail for w in words], [t + tail for t in typed]
    trie = names.Trie(words)
    for t, found in zip(typed, trie.within(typed, most, at_once=2), strict=True):
        want = sorted((d, w) for w in set(words) if (d := osa(t[:8] if not tail else t[: -60], w[:8] if not tail else w[: -60])) <= most)
        assert sorted((d, trie.keys[n]) for n, d in found.items()) == want


LIST = [("Peikelkquin Stathskomzar", 1), ("Lake Dondpulund", 2), ("The Letuholt Chronicle", 3), ("Maehummiasvik (film)", 4), ("Zickskiakaer & Sons", 5), ("Töthliackwick University", 6), ("Upper Kliamgloum", 7), ("Keinnomora F.C.", 8)]
#: Words that recur in the list, so that names may shorten them.
RECURRING = [(f"{w.format(x)}", 100 + 10 * i + n) for i, w in enumerate(("The {} Chronicle", "{} University", "Upper {}", "{} F.C.", "{} & Sons", "{} United")) for n, x in enumerate(("Oorvaxmel", "Hruspiddon", "Yalcombrix", "Vintrossa", "Qwelpadur", "Jemmarholt", "Zufbrindle", "Exkorvane"))]
OLD = [("WKDR", "Lake Dondpulund"), ("Gone Town", "Not Listed"), ("Lake Dondpulund", "Not Listed")]
CASES = {
    "peikelkquin_stathskomzar": 1,
    "Stathskomzar Peikelkquin": 1,
    "Stathskomzar, Peikelkquin": 1,
    "P. Stathskomzar": 1,
    "Dr. Peikelkquin Stathskomzar": 1,
    "[[Lake Dondpulund]]": 2,
    "Lake Dondpulund#History": 2,
    "Lake Dondpuulund": 2,
    "Lake Dоndpulund": 2,
    "wkdr": 2,
    "Letuholt Chron.": 3,
    "Maehummiasvik_%28film%29": 4,
    "Zickskiakaer and Sons": 5,
    "Tothliackwick Uni": 6,
    "/wiki/Zickskiakaer & Sons": 5,
    "Up. Kliamgloum": 7,
    "keinnomora football club": 8,
    "Hruspiddon Utd": 151,
    "jemmarholt univ": 115,
    "Vintrosa Chron.": 103,
    "Gone Town": -1,
    "Nothing Like It": -1,
    "*null*": -1,
}


def frames(spark, rows):
    typed = spark.createDataFrame(rows, "aid bigint, typed_name string, hint string, key string, ids int")
    return typed, spark.createDataFrame(LIST + LIST[:2] + RECURRING + [(None, 9)], "name string, entity_id bigint"), spark.createDataFrame(OLD, "old string, new string")


def test_cases(spark):
    rows = [(i, t, None, "x", 1) for i, t in enumerate(CASES)] + [(900, None, None, "x", 1), (901, "  ", None, "x", 1), (902, "Lake Dondpulund", None, "x", 1), (903, "x" * 5000, None, "x", 1)]
    for size in (500_000, 3):
        typed, listed, old = frames(spark, rows)
        out = names.mapped(typed, "aid", "typed_name", "hint", listed, "name", "entity_id", old, "old", "new", entries_a_pass=size)
        got = {r["key"]: (r["entry_id"], r["as_listed"]) for r in out.collect()}
        assert {t: got[i][0] for i, t in enumerate(CASES)} == CASES
        assert 900 not in got and 901 not in got
        assert got[902] == (2, True) and got[903] == (-1, False)


def test_empty(spark):
    typed, listed, old = frames(spark, [])
    assert names.mapped(typed, "aid", "typed_name", "hint", listed, "name", "entity_id", old, "old", "new").count() == 0
    some, _, _ = frames(spark, [(1, "abc", None, "x", 1)])
    out = names.mapped(some, "aid", "typed_name", "hint", listed.where("false"), "name", "entity_id", old.where("false"), "old", "new").collect()
    assert [r["entry_id"] for r in out] == [-1]


def test_old_title_letter_for_letter_is_not_as_listed(spark):
    typed, listed, old = frames(spark, [(1, "WKDR", None, "x", 1), (2, "Lake Dondpulund", None, "x", 1), (3, "Gone Town", None, "x", 1)])
    for size in (500_000, 3):
        out = names.mapped(typed, "aid", "typed_name", "hint", listed, "name", "entity_id", old, "old", "new", entries_a_pass=size).collect()
        assert {r["key"]: (r["entry_id"], r["as_listed"]) for r in out} == {1: (2, False), 2: (2, True), 3: (-1, False)}


def test_hint_decides(spark):
    listed = spark.createDataFrame([("Aaxbbycc North", 1), ("Aaxbbzcc North", 2)], "name string, entity_id bigint")
    typed = spark.createDataFrame([(1, "Aaxbbwcc North", "Aaxbbzcc North", "x", 1), (2, "Aaxbbwcc North", "it", "x", 1)], "aid bigint, typed_name string, hint string, key string, ids int")
    _, _, old = frames(spark, [])
    out = names.mapped(typed, "aid", "typed_name", "hint", listed, "name", "entity_id", old, "old", "new").collect()
    assert {r["key"]: r["entry_id"] for r in out} == {1: 2, 2: -1}


def test_passes_do_not_change_results(spark):
    near = [(f"Aaxbbycc {w} North", i) for i, w in enumerate(("Bam", "Ban", "Bat", "Bal"), 20)]
    crossed = [("Kelmor Duntas", 1), ("Duntas Kelmor", 2), ("Fostrin Galbey", 3), ("Galbey Fostrin", 4), ("P. Wuntak", 5), ("Pordel Wuntak", 6), ("Pirnas Wuntak", 7)]
    listed = spark.createDataFrame([*near, *crossed], "name string, entity_id bigint")
    old = spark.createDataFrame([("Aaxbbycc-Bam-North", "Aaxbbycc Bam North")], "old string, new string")
    rows = [(None, "kelmor duntas", "it"), (None, "kelmor duntas", "it"), (1, "fostrin galbey", None), (2, "p wuntak", None), (2, "p wuntak", None), (3, "Aaxbbycc Bax North", "Aaxbbycc Bat North"), (None, "Aaxbbycc Bax North", "Aaxbbycc Bal North"), (4, "Aaxbbycc Bax North", "it"), (5, "aaxbbycc bam north", None)]
    typed = spark.createDataFrame(rows, "aid bigint, typed_name string, hint string")
    want = sorted([(None, 1), (None, 1), (1, 3), (2, -1), (2, -1), (3, 22), (None, 23), (4, -1), (5, 20)], key=str)
    for size in (500_000, 6, 3, 1):
        out = names.mapped(typed, "aid", "typed_name", "hint", listed, "name", "entity_id", old, "old", "new", entries_a_pass=size).collect()
        assert sorted([(r["key"], r["entry_id"]) for r in out], key=str) == want, size


def test_typos_are_found():
    rng = random.Random(4)
    words = ["".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(6)) for _ in range(400)]
    m = names.Matcher([(w.title(), i) for i, w in enumerate(words)])
    for i, w in enumerate(words):
        at = rng.randrange(1, len(w) - 1)
        typo = rng.choice([w[:at] + w[at + 1 :], w[:at] + "x" + w[at:], w[:at] + "x" + w[at + 1 :], w[: at - 1] + w[at] + w[at - 1] + w[at + 1 :]])
        assert i in m.best([typo])[0].ids


def test_abbreviations_come_from_the_list():
    assert [w for w in ("university", "united", "unit", "uni") if names.abbreviates("uni", w)] == ["university", "united", "unit"]
    assert names.abbreviates("rly", "railway") and names.abbreviates("utd", "united") and not names.abbreviates("rd", "round") and not names.abbreviates("xyz", "railway")
    r = names.Recurring([("university", False), ("united", False), ("fc", True), ("of", False)])
    assert set(r.readings("Uni of Xa")) == {"united of Xa", "university of Xa"}
    assert r.readings("Xa Football Club") == ["Xa fc"] and r.readings("Xa of Za") == []


def test_hot_names_and_large_tables(spark):
    """A name in a third of the rows, with results too large for a broadcast."""
    rows = [(i, "Lake Dondpuulund" if i % 3 else f"nothing like {i}", None, "x", 1) for i in range(300)]
    typed, listed, old = frames(spark, rows)
    out = names.mapped(typed, "aid", "typed_name", "hint", listed, "name", "entity_id", old, "old", "new", broadcast_bytes=10).collect()
    assert len(out) == 300 and all(r["entry_id"] == (2 if r["key"] % 3 else -1) for r in out)


def test_all_readings_of_a_name_count():
    """The readings of many shortened words, found along the trie, are those of brute force."""
    rng = random.Random(6)
    longs = {k: [k + e + c for e in ("versity", "ted") for c in "ae"] for k in ("uni", "nat", "col", "soc", "dep")}
    recurring = [(w, False) for ws in longs.values() for w in ws] + [("fc", True), ("abcdef", True)]
    entries = [("A.B.C.D.E.F. Korvin", 900), ("Natteda Coltede Universitye Soctede Depversitye Lummox", 901)]
    for i in range(100):
        words = [rng.choice(longs[rng.choice(list(longs))]).title() for _ in range(rng.randrange(3, 5))]
        entries.append((" ".join([*words, rng.choice(["Xalmon", "Yortrip", "Q. Zastem"])]), i))
    m, brute = names.Matcher(entries, recurring), names.Matcher(entries, recurring)
    brute.recurring.most = 1 << 40
    typed = ["Nat Col Uni Soc Dep Lummox", "Lummox, Nat Col Uni Soc. Dep", "Nat Col Uni Soc Dep Lumox", "Dr. Nat Col Uni Lummox"]
    for n, _ in entries[2:12]:
        words = n.split(" ")
        short = [w[:3] if w[:3].lower() in longs else w for w in words]
        at = rng.randrange(1, len(words))
        typed += [" ".join(short), " ".join([*short[:-1], short[-1][:-1]]), ", ".join([" ".join(short[at:]), " ".join(short[:at])]), "K. " + " ".join(short)]
    got = m.best(typed)
    assert got == brute.best(typed)
    assert got[0] == names.Hit(50, 0, [901]) and got[1].ids == got[2].ids == [901]
    assert m.best(["Anton Berta Cesar Dora Emil Friedrich Korvin"])[0].ids == [900]
    assert m.best(["Nat Col Uni Soc Dep " * 40])[0].ids == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("abc", min_size=1, max_size=7), min_size=1, max_size=8), st.lists(st.text("abc", min_size=1, max_size=6), min_size=1, max_size=4), st.integers(0, 2))
def test_beginnings_within_errors(words, typed, most):
    got = names.Trie(words).begin(typed, most, at_once=2)
    assert got == [any(osa(t, w[:n]) <= most for w in words for n in range(len(w) + 1)) for t in typed]


def test_words_of_eight_names_recur_in_any_list(spark):
    listed = spark.createDataFrame([(f"{c * 6} Observatory", i) for i, c in enumerate("bdfgklmn")] + [(f"{c}{d}zzqqx", 100 + i) for i, (c, d) in enumerate((c, d) for c in "bdfgklmn" for d in "rstvw")], "name string, entity_id bigint")
    typed, _, old = frames(spark, [(1, "Gggggg Obs.", None, "x", 1)])
    for one_in, want in ((2000, 3), (4, -1), (0, 3)):
        out = names.mapped(typed, "aid", "typed_name", "hint", listed, "name", "entity_id", old.where("false"), "old", "new", one_in=one_in).collect()
        assert [r["entry_id"] for r in out] == [want]
