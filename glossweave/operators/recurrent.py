"""Recurrent layers of a trained model, run over batches of sequences.

Weights are given; a layer is a dictionary of ``kernel`` ((inputs + units), 4 units) and
``bias`` (4 units), gates in the order input, candidate, forget, output, with ``forget``
added to the forget gate.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

Layer = dict[str, np.ndarray]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def lstm(x: np.ndarray, lens: np.ndarray, layer: Layer, forget: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Outputs (rows, steps, units) and last states (rows, units) of sequences (rows,
    steps, inputs); steps at and beyond a sequence's length give 0 and change nothing."""
    rows, steps, _ = x.shape
    units = len(layer["bias"]) // 4
    c, h = np.zeros((rows, units)), np.zeros((rows, units))
    out = np.zeros((rows, steps, units))
    for t in range(steps):
        i, j, f, o = np.split(np.concatenate([x[:, t], h], axis=1) @ layer["kernel"] + layer["bias"], 4, axis=1)
        new_c = c * _sigmoid(f + forget) + _sigmoid(i) * np.tanh(j)
        new_h = np.tanh(new_c) * _sigmoid(o)
        alive = (t < lens)[:, None]
        c, h = np.where(alive, new_c, c), np.where(alive, new_h, h)
        out[:, t] = np.where(alive, h, 0)
    return out, h


def reversed_sequences(x: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Each sequence backwards, its padding left behind it."""
    at = np.arange(x.shape[1])[None, :]
    at = np.where(at < lens[:, None], lens[:, None] - 1 - at, at)
    return np.take_along_axis(x, at[:, :, None], axis=1)


def both_ways(x: np.ndarray, lens: np.ndarray, forward: Layer, backward: Layer) -> tuple[np.ndarray, np.ndarray]:
    """Outputs and last states of a layer over the sequences and one over them backwards,
    side by side."""
    out_f, h_f = lstm(x, lens, forward)
    out_b, h_b = lstm(reversed_sequences(x, lens), lens, backward)
    return np.concatenate([out_f, reversed_sequences(out_b, lens)], axis=2), np.concatenate([h_f, h_b], axis=1)


def _padded(table: np.ndarray, ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    lens = np.array([len(i) for i in ids], np.int64)
    at = np.zeros((len(ids), max(int(lens.max(initial=0)), 1)), np.int64)
    for row, own in enumerate(ids):
        at[row, : len(own)] = own
    return table[at], lens


def word_embeddings(words: list[int], chars: list[list[int]], word_table: np.ndarray, char_table: np.ndarray, forward: Layer, backward: Layer) -> np.ndarray:
    """Vectors of words: that of the word, and the last states over its letters."""
    x, lens = _padded(char_table, chars)
    return np.concatenate([word_table[np.array(words, np.int64)], both_ways(x, lens, forward, backward)[1]], axis=1)


def context_vectors(df: DataFrame, key: str, words: str, chars: str, tables: tuple[np.ndarray, np.ndarray], letters: tuple[Layer, Layer], context: tuple[Layer, Layer], at_once: int = 64) -> DataFrame:
    """(key, vecs): the vectors of a sequence's words in their context.

    ``words`` is a list of word ids, ``chars`` one list of letter ids for each word; ids
    beyond the tables and null ones are id 0.  Word vectors are joined with the last
    states of a layer over their letters, both ways, and go through one over the words,
    both ways.  Sequences of similar length are computed together, ``at_once`` at most.
    Null or empty sequences give an empty list; a word without letters has those of none.
    """
    word_table, char_table = tables
    context_of = df.sparkSession.sparkContext.broadcast((word_table, char_table, letters, context))
    known = lambda ids, n: [i if i is not None and 0 <= i < n else 0 for i in ids or []]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word_table, char_table, letters, context = context_of.value
        for batch in batches:
            ids = [known(w, len(word_table)) for w in batch.column(1).to_pylist()]
            spelled = [[known(c, len(char_table)) for c in (own or [])] for own in batch.column(2).to_pylist()]
            out: list[list[list[float]]] = [[] for _ in ids]
            order = sorted((i for i in range(len(ids)) if ids[i]), key=lambda i: len(ids[i]))
            for a in range(0, len(order), at_once):
                some = order[a : a + at_once]
                flat_words = [w for i in some for w in ids[i]]
                flat_chars = [c for i in some for c in (spelled[i] + [[]] * len(ids[i]))[: len(ids[i])]]
                vecs = word_embeddings(flat_words, flat_chars, word_table, char_table, *letters)
                lens = np.array([len(ids[i]) for i in some])
                x = np.zeros((len(some), int(lens.max()), vecs.shape[1]))
                x[np.arange(x.shape[1])[None, :] < lens[:, None]] = vecs
                made, _ = both_ways(x, lens, *context)
                for row, i in enumerate(some):
                    out[i] = made[row, : lens[row]].tolist()
            yield pa.record_batch([batch.column(0), pa.array(out, pa.list_(pa.list_(pa.float64())))], names=["key", "vecs"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, words, chars).mapInArrow(run, f"key {kind}, vecs array<array<double>>")


