"""Languages of documents and of their lines by hyperdimensional profiles.

Every letter has a random vector of +1 and -1.  A trigram's vector binds (multiplies) its
letters' vectors, each permuted (rolled) by its place; a text's vector bundles (adds)
those of its trigrams, and a language's prototype is the bundle of known text.  A text is
compared with the prototypes by cosine.  Both bundling and the dot product are linear, so
the products of all trigram vectors with the prototypes are made once, as a table of
fixed size, and the dot product of any stretch of text with the prototypes is the sum of
its trigrams' products.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossweave.llm._spark import hash_sample

LETTERS = 32  # 0: no letter, 1..26: a..z, 27: any other letter

#: What labels may call a language besides its two-letter code.
NAMES = {
    "en": ("en", "eng", "english"),
    "de": ("de", "deu", "ger", "german"),
    "fr": ("fr", "fra", "fre", "french"),
    "es": ("es", "spa", "spanish"),
    "it": ("it", "ita", "italian"),
    "nl": ("nl", "nld", "dut", "dutch"),
}

MARKUP = re.compile(r"<[^<>\n]*>|MMSTART_\S*|DOCSTART_\S*|MMEND|DOCEND|\*NL\*|https?://\S+|&#?\w{1,8};")


def label_language(label: Column) -> Column:
    """Two-letter code that a label names, null if it names none of ``NAMES``."""
    base = F.regexp_extract(F.lower(F.trim(label)), r"^([a-z]+)(?:[-_][a-z]{2,4})?$", 1)
    named = F.create_map(*(F.lit(x) for code, all_names in NAMES.items() for n in all_names for x in (n, code)))
    return F.try_element_at(named, base)


@lru_cache(maxsize=1)
def _letter_of() -> np.ndarray:
    """Letter number of every code point below 0x3000, without case and accents."""
    table = np.zeros(0x3000, np.uint8)
    for cp in range(0x3000):
        ch = chr(cp)
        if ch.isalpha():
            base = unicodedata.normalize("NFKD", ch.lower())[:1]
            table[cp] = ord(base) - 96 if "a" <= base <= "z" else 27
    return table


@lru_cache(maxsize=1)
def _is_space() -> np.ndarray:
    table = np.zeros(0x3001, bool)
    for cp in range(0x3001):
        table[cp] = chr(cp).isspace()
    return table


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def letters(cps: np.ndarray) -> np.ndarray:
    return np.where(cps < 0x3000, _letter_of()[np.minimum(cps, 0x2FFF)], 27)


def spaces(cps: np.ndarray) -> np.ndarray:
    return (cps <= 0x3000) & _is_space()[np.minimum(cps, 0x3000)]


def without_markup(text: str) -> str:
    """The text with markup blanked out, of the same length."""
    return MARKUP.sub(lambda m: "\x01" * (m.end() - m.start()), text)


def trigrams(sym: np.ndarray) -> np.ndarray:
    """Number of the trigram that ends at each position; 0 for the first two."""
    out = sym.astype(np.int32)
    out[1:] += sym[:-1].astype(np.int32) << 5
    out[2:] += sym[:-2].astype(np.int32) << 10
    out[:2] = 0
    return out


@dataclass(frozen=True)
class Profiles:
    """Dot products of all trigram vectors with the centred prototypes, by language."""

    langs: tuple[str, ...]
    table: np.ndarray


def letter_vectors(dim: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).choice(np.array([-1.0, 1.0], np.float32), (LETTERS, dim))


def prototypes(counts: np.ndarray, dim: int, seed: int) -> np.ndarray:
    """Bundles of the trigrams counted for each language, made unit vectors and centred."""
    third = letter_vectors(dim, seed)
    first, second = np.roll(third, 2, axis=1), np.roll(third, 1, axis=1)
    out = np.zeros((len(counts), dim), np.float32)
    for n, own in enumerate(counts.reshape(len(counts), LETTERS, LETTERS, LETTERS)):
        for a in range(LETTERS):
            if own[a].any():
                out[n] += first[a] * ((own[a].T.astype(np.float32) @ second) * third).sum(0)
    out /= np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)
    return out - out.mean(0)


def fitted(counts: np.ndarray, langs: tuple[str, ...], dim: int = 8192, seed: int = 17) -> Profiles:
    """Profiles from trigram counts, (languages, 32**3).  A trigram's share of a language's
    text counts by its square root, so that the commonest ones don't drown the rest."""
    share = np.sqrt(counts / np.maximum(counts.sum(1, keepdims=True), 1))
    protos = prototypes(share, dim, seed)
    third = letter_vectors(dim, seed)
    first, second = np.roll(third, 2, axis=1), np.roll(third, 1, axis=1)
    table = np.zeros((LETTERS, LETTERS, LETTERS, len(langs)), np.float32)
    for n in range(len(langs)):
        for a in range(LETTERS):
            table[a, :, :, n] = (second * (first[a] * protos[n])) @ third.T
    table = table.reshape(-1, len(langs)) / np.sqrt(dim)
    table[0] = 0
    return Profiles(langs, np.ascontiguousarray(table.T))


def counted(texts: list[str]) -> np.ndarray:
    sym = letters(code_points(without_markup("  " + "  ".join(texts) + "  ")))
    return np.bincount(trigrams(sym), minlength=LETTERS**3).astype(np.float64)


def line_languages(texts: list[str], profiles: Profiles, window: int = 8, with_votes: bool = False) -> tuple[np.ndarray, ...]:
    """(text, line number, words, language or -1, share) of every line of the texts, and
    if asked for the words of each language.

    Every word's language is that of the ``window`` words to either side within its line;
    a line has the language of most of its words, and that part of them is its share.
    """
    n_lang = len(profiles.langs)
    joined = "\n".join(texts) + "\n"
    cps = code_points(joined)
    sym = letters(code_points(without_markup(joined)))
    gap = spaces(cps)
    begins = np.flatnonzero(~gap & np.concatenate([[True], gap[:-1]]))
    feeds = np.flatnonzero(cps == 10)
    line_start = np.concatenate([[0], feeds[:-1] + 1])
    line_of_word = np.searchsorted(feeds, begins)
    n_words = np.bincount(line_of_word, minlength=len(feeds))
    text_len = np.array([len(t) + 1 for t in texts], np.int64)
    text_start = np.concatenate([[0], np.cumsum(text_len)])
    text_of_line = np.searchsorted(text_start, line_start, side="right") - 1
    first_line = np.searchsorted(line_start, text_start[:-1])
    line_no = np.arange(len(feeds)) - first_line[text_of_line]
    lang, share = np.full(len(feeds), -1, np.int64), np.zeros(len(feeds))
    votes = np.zeros((len(feeds), n_lang), np.int64)
    if not len(begins):
        return (text_of_line, line_no, n_words, lang, share, votes)[: 5 + with_votes]
    # Similarity and letters of every word (with the gap that follows it).
    grams = trigrams(sym)
    sims = np.stack([np.add.reduceat(row[grams], begins, dtype=np.float64) for row in profiles.table], axis=1)
    size = np.add.reduceat((sym > 0).astype(np.int64), begins)
    # Sums over the window around each word, within its line.
    w = np.arange(len(begins))
    first = np.concatenate([[0], np.cumsum(n_words)])[line_of_word]
    lo, hi = np.maximum(w - window, first), np.minimum(w + window + 1, first + n_words[line_of_word])
    run = np.concatenate([np.zeros((1, n_lang)), np.cumsum(sims, axis=0)])
    around = run[hi] - run[lo]
    speaks = size > 0
    votes = np.bincount(line_of_word[speaks] * n_lang + around.argmax(1)[speaks], minlength=len(feeds) * n_lang).reshape(-1, n_lang)
    total = votes.sum(1)
    lang = np.where(total > 0, votes.argmax(1), -1)
    share = np.where(total > 0, votes.max(1) / np.maximum(total, 1), 0.0)
    return (text_of_line, line_no, n_words, lang, share, votes)[: 5 + with_votes]


def trigram_counts(df: DataFrame, lang: str, text: str) -> DataFrame:
    """(lang, gram, n): how often every trigram occurs in the texts of each language; at
    most 32**3 rows a language, summed in the tasks first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column(0).to_pylist()
            by_lang: dict[str, list[str]] = {}
            for n, t in zip(langs, batch.column(1).to_pylist(), strict=True):
                by_lang.setdefault(n, []).append(t)
            for n, texts in by_lang.items():
                for _, some in portions(texts):
                    sums[n] = sums.get(n, 0) + counted(some)
        for n, c in sums.items():
            at = np.flatnonzero(c)
            yield pa.record_batch([pa.array([n] * len(at), pa.string()), pa.array(at), pa.array(c[at].astype(np.int64))], names=["lang", "gram", "n"])

    rows = df.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    return rows.mapInArrow(count, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _as_matrix(counts: DataFrame, langs: tuple[str, ...] | None = None) -> tuple[tuple[str, ...], np.ndarray]:
    table = counts.toArrow()
    names = table["lang"].to_pylist()
    langs = langs or tuple(sorted(set(names)))
    number = {n: i for i, n in enumerate(langs)}
    out = np.zeros((len(langs), LETTERS**3))
    np.add.at(out, (np.array([number[n] for n in names], np.int64), table["gram"].to_numpy()), table["n"].to_numpy())
    return langs, out


def learned(samples: DataFrame, labelled: DataFrame, text: str, lang: str, sample_rows: int = 3000, agree: float = 0.9, dim: int = 8192, seed: int = 17) -> Profiles:
    """Profiles of the languages of ``samples``, all of which count.

    They are refined on a bounded sample of ``labelled`` documents: of the
    ``sample_rows`` distinct ones whose content has the smallest hashes, the lines of at
    least 8 words that the first profiles give, by a share of ``agree``, the language of
    the label.  Only trigram counts come to the driver, at most 32**3 for a language.
    """
    langs, base = _as_matrix(trigram_counts(samples, lang, text))
    if not langs:
        raise ValueError("no samples of known language")
    first = fitted(base, langs, dim, seed)
    named = labelled.select(label_language(F.col(lang)).alias("lang"), F.col(text).alias("text"))
    rows = hash_sample(named.where(F.col("text").isNotNull() & F.col("lang").isin(*langs)), sample_rows)
    # The sample lies in one piece; its judging is spread again.
    spread = rows.repartition(max(1, min(16, sample_rows // 100)), F.xxhash64("text"))

    def confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for begin, some in portions(texts):
                of, no, words, got, share = line_languages(some, first)
                lines = [t.split("\n") for t in some]
                good = [(langs[g], lines[t][n]) for t, n, w, g, s in zip(of, no, words, got, share, strict=True) if w >= 8 and g >= 0 and s >= agree and langs[g] == names[begin + t]]
                yield pa.record_batch([pa.array([x for x, _ in good], pa.string()), pa.array([y for _, y in good], pa.string())], names=["lang", "text"])

    _, more = _as_matrix(trigram_counts(spread.mapInArrow(confirmed, "lang string, text string"), "lang", "text"), langs)
    return fitted(base + more, langs, dim, seed)


def segment_languages(df: DataFrame, key: str, text: str, profiles: Profiles, keep: list[str] | None = None, window: int = 8) -> DataFrame:
    """Language and confidence of every line of every document, and of the document.

    Result: (key, kept columns, line_no, n_words, lang, confidence, doc_lang,
    doc_confidence), one row for each line (the text split at line feeds, from 0).
    ``confidence`` is the share of the line's words, among those with a language, that
    have the line's; the document has the language of most of its words.  Lines without
    letters have null language and confidence 0.  A null text gives no rows, an empty one
    a line without words; equal texts and repeated rows are judged each for itself.

    Nothing is shuffled: every document is judged whole where it is read, by a table of
    fixed size.
    """
    keep = keep or []
    rows = df.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text"), *(F.col(c).alias(f"k{i}") for i, c in enumerate(keep)))
    types = [rows.schema[f"k{i}"].dataType.simpleString() for i in range(len(keep))]
    n_lang = len(profiles.langs)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array([*profiles.langs, None], pa.string())
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for first, some in portions(texts):
                of, no, words, lang, share, votes = line_languages(some, profiles, window, with_votes=True)
                by_doc = np.stack([np.bincount(of, weights=votes[:, n], minlength=len(some)) for n in range(n_lang)], axis=1)
                total = by_doc.sum(1)
                doc_lang = np.where(total > 0, by_doc.argmax(1), n_lang)
                doc_share = by_doc.max(1) / np.maximum(total, 1)
                at = pa.array(of + first)
                kept = [batch.column(i).take(at) for i in (0, *range(2, batch.num_columns))]
                made = [pa.array(no), pa.array(words), names.take(pa.array(np.where(lang < 0, n_lang, lang))), pa.array(share), names.take(pa.array(doc_lang[of])), pa.array(doc_share[of])]
                yield pa.record_batch([*kept, *made], names=["key", *(f"k{i}" for i in range(len(keep))), "line_no", "n_words", "lang", "confidence", "doc_lang", "doc_confidence"])

    schema = ", ".join([f"key {rows.schema['key'].dataType.simpleString()}", *(f"k{i} {t}" for i, t in enumerate(types)), "line_no bigint, n_words bigint, lang string, confidence double, doc_lang string, doc_confidence double"])
    out = rows.mapInArrow(judge, schema)
    return out.toDF("key", *keep, *out.columns[1 + len(keep) :])


def portions(texts: list[str], most_chars: int = 1_000_000) -> Iterator[tuple[int, list[str]]]:
    """Consecutive texts, with the number of the first, of about ``most_chars`` in all."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most_chars:
            yield first, texts[first:i]
            first, size = i, 0
        size += len(t)
    if first < len(texts):
        yield first, texts[first:]
