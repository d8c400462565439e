from __future__ import annotations

import json

import numpy as np
import pytest

from glossweave import cli
from glossweave.operators import recurrent
from glossweave.plans import service


def test_answers_of_both_kinds(spark):
    pem = spark.createDataFrame([("New York", 1, 0.9, 1), ("New York", 2, 0.1, 2), ("Köln", 3, 1.0, 1)], "mention string, entity bigint, p double, rank bigint")
    names = spark.createDataFrame([(1, "New_York"), (3, 'K"öln')], "entity bigint, title string")
    asked = [{"text": "in New York, or Köln"}, {"text": "in New York, or Köln", "spans": [{"start": 16, "length": 4}, {"start": 0, "length": 2}]}, {"text": "nothing"}, {"text": "x", "spans": []}]
    rows = [(i, json.dumps(a, ensure_ascii=False)) for i, a in enumerate(asked)] + [(8, "no json"), (9, None)]
    out = service.answers(spark.createDataFrame(rows, "i int, v string"), "i", "v", pem, names)
    got = {r["doc"]: json.loads(r["response"]) for r in out.collect()}
    assert got == {"0": [[3, 8, "New_York"], [16, 4, 'K"öln']], "1": [[16, 4, 'K"öln']], "2": [], "3": []}


def test_command_line(capsys):
    cli.main(["queries"])
    assert "annotate_corpus" in capsys.readouterr().out.split()
    with pytest.raises(SystemExit):
        cli.main(["run", "no_such_query", "a", "b"])


def step(x, h, c, layer, forget=1.0):
    z = np.concatenate([x, h]) @ layer["kernel"] + layer["bias"]
    u = len(h)
    sig = lambda v: 1 / (1 + np.exp(-v))
    c = c * sig(z[2 * u : 3 * u] + forget) + sig(z[:u]) * np.tanh(z[u : 2 * u])
    return np.tanh(c) * sig(z[3 * u :]), c


def plain(xs, layer):
    u = len(layer["bias"]) // 4
    h, c, out = np.zeros(u), np.zeros(u), []
    for x in xs:
        h, c = step(x, h, c, layer)
        out.append(h)
    return out, h


def test_context_vectors_against_plain_loops(spark):
    rng = np.random.default_rng(3)
    layer = lambda n, u: {"kernel": rng.normal(size=(n + u, 4 * u)), "bias": rng.normal(size=4 * u)}
    word_table, char_table = rng.normal(size=(5, 3)), rng.normal(size=(4, 2))
    letters, context = (layer(2, 2), layer(2, 2)), (layer(7, 3), layer(7, 3))
    data = [("a", [1, 2, 3], [[1, 2], [3], []]), ("b", [4], [[1, 1, 1]]), ("c", [], []), ("d", None, None), ("e", [9, None], [[7, None]])]
    df = spark.createDataFrame(data, "k string, w array<int>, c array<array<int>>")
    got = {r["key"]: r["vecs"] for r in recurrent.context_vectors(df, "k", "w", "c", (word_table, char_table), letters, context, at_once=2).collect()}
    assert got["c"] == got["d"] == []
    for k, words, chars in data:
        if not words:
            continue
        fix = lambda i, n: i if i is not None and i < n else 0
        chars = [[fix(x, 4) for x in own] for own in chars] + [[]] * (len(words) - len(chars))
        x = [np.concatenate([word_table[fix(w, 5)], plain([char_table[i] for i in own], letters[0])[1], plain([char_table[i] for i in own[::-1]], letters[1])[1]]) for w, own in zip(words, chars)]
        forward, backward = plain(x, context[0])[0], plain(x[::-1], context[1])[0][::-1]
        assert np.allclose(got[k], [np.concatenate(p) for p in zip(forward, backward)])


def test_training_and_evaluation_by_turns():
    from glossweave.plans import loop

    ticks, steps, kept = iter(range(1000)), [], []
    scores = [1.0, 1.05, 2.0, 1.9, 2.05, 2.09]
    got = loop.alternating(lambda: steps.append(1), lambda n: scores[n - 1], 3, 3, keep=kept.append, clock=lambda: next(ticks))
    assert [(e.score, e.best, e.since) for e in got] == [(1.0, 1.0, 0), (1.05, 1.0, 1), (2.0, 2.0, 0), (1.9, 2.0, 1), (2.05, 2.0, 2), (2.09, 2.0, 3)]
    assert kept == [1, 3] and got[-1].steps == len(steps) == 18
