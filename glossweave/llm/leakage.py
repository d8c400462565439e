"""Documents that carry passages of held-out evaluation items.

Texts are compared as words without case, accents, punctuation and markup; letters of
scripts that are written without spaces are words of their own.  The patterns are all runs
of ``m`` consecutive words of the items.  They are searched as by Wu and Manber: a table
tells for every block of two words how far the window may move on before a pattern can end
there; where it may not, the block's bucket selects the patterns that end in it, and
comparison of all words confirms an occurrence.  Documents are cut into stretches that
overlap by ``m - 1`` words, and the windows of all stretches of a batch move in lockstep,
so that one numpy step moves thousands of windows.  The occurrences of an item's patterns
are then put in order: a document carries the item if they cover three fifths of its words
in one or two passages.
"""

from __future__ import annotations

import math
import re
import unicodedata
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossweave.llm._arrow import ranges
from glossweave.llm._spark import once_a_worker
from glossweave.llm.language import code_points, portions, without_markup

_PRIME = np.uint64(0x9E3779B97F4A7C15)

#: First and last code points of scripts written without spaces between words
#: (Thai and Lao, Tibetan, Burmese, Khmer, Kana, Han and its extensions, half-width Kana).
UNSPACED = ((0x0E00, 0x0EFF), (0x0F00, 0x0FFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0xFF66, 0xFF9D), (0x20000, 0x323AF))


@lru_cache(maxsize=1)
def _folded() -> np.ndarray:
    """Letters and digits below 0x10000 without case and accents; 0 for the rest, and 1
    for characters that are not there for the reader (soft hyphens, joiners, marks)."""
    table = np.zeros(0x10000, np.uint32)
    for cp in range(0x10000):
        ch = chr(cp)
        kind = unicodedata.category(ch)
        if kind[0] in "LN":
            base = unicodedata.normalize("NFKD", ch.lower())
            accented = len(base) > 1 and all(unicodedata.combining(c) for c in base[1:])
            table[cp] = ord(base) if len(base) == 1 else ord(base[0]) if accented else ord(ch.lower()[0])
        elif kind == "Cf" or 0x300 <= cp <= 0x36F:
            table[cp] = 1
    return table


@lru_cache(maxsize=1)
def _powers() -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(np.full(64, _PRIME, np.uint64))


#: Lead characters of letters whose UTF-8 bytes were read as Latin-1.
_BROKEN = re.compile("[Â-Å][\u0080-¿ŒœŠšŸŽžƒˆ˜–-›€™]")


def _mended(m: re.Match) -> str:
    try:
        return m[0].encode("cp1252").decode("utf-8")
    except UnicodeError:
        try:
            return m[0].encode("latin-1").decode("utf-8")
        except UnicodeError:
            return m[0]


@dataclass(frozen=True)
class Words:
    """The words of many texts, in order, and their letters as one run."""

    text: np.ndarray  # text of every word
    hash: np.ndarray
    letters: np.ndarray  # all letters and digits, without anything between the words
    letter_at: np.ndarray  # where in ``letters`` every word begins, and their end


def words_of(texts: list[str]) -> Words:
    """Words are runs of letters and digits, without case, accents and markup."""
    texts = [_BROKEN.sub(_mended, t) if "Â" <= max(t, default="") and _BROKEN.search(t) else t for t in texts]
    cps = code_points(without_markup("\n".join(texts) + "\n"))
    sym = np.where(cps < 0x10000, _folded()[np.minimum(cps, 0xFFFF)], cps)
    ends = np.cumsum([len(t) + 1 for t in texts])
    mark = sym == 1
    if mark.any():
        cps, sym, ends = cps[~mark], sym[~mark], np.cumsum(~mark)[ends - 1]
    alone = np.zeros(len(cps), bool)
    if len(cps) and cps.max() >= UNSPACED[0][0]:
        for lo, hi in UNSPACED:
            alone |= (cps >= lo) & (cps <= hi)
        alone &= sym > 0
    inside = sym > 0
    before = np.concatenate([[False], (inside & ~alone)[:-1]])
    begin = np.flatnonzero(inside & (~before | alone))
    if not len(begin):
        return Words(np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint32), np.zeros(1, np.int64))
    lens = np.diff(np.concatenate([[0], begin, [len(sym)]]))
    at = np.arange(len(sym)) - np.repeat(np.concatenate([[0], begin]), lens)
    with np.errstate(over="ignore"):
        h = np.add.reduceat(sym.astype(np.uint64) * _powers()[at & 63], begin)
        h ^= h >> np.uint64(29)
        h *= _PRIME
    run = np.cumsum(inside)
    return Words(np.searchsorted(ends, begin, side="right"), h, sym[inside].astype(np.uint32), np.append(run[begin] - 1, run[-1]))


def run_hashes(symbols: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` symbols."""
    if len(symbols) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(symbols) - n + 1, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(n):
            out = (out ^ symbols[j : j + len(out)].astype(np.uint64)) * _PRIME
            out ^= out >> np.uint64(31)
    return out


@dataclass(frozen=True)
class LetterRuns:
    """Runs of letters of every item, for a closer look at doubtful pairs."""

    run: int
    size: np.ndarray  # letters of every item
    known: list[tuple[np.ndarray, np.ndarray]]  # sorted hashes of its runs, and where they begin

    @classmethod
    def of(cls, symbols: np.ndarray, edges: np.ndarray, run: int) -> LetterRuns:
        known = []
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            hashes = run_hashes(symbols[a:b], run)
            order = np.argsort(hashes, kind="stable")
            known.append((hashes[order], order))
        return cls(run, np.diff(edges), known)


@dataclass(frozen=True)
class Patterns:
    """All runs of ``m`` words of some items, with the tables of the search."""

    m: int
    vocabulary: np.ndarray  # sorted word hashes
    size: np.ndarray  # words of every item
    shift: np.ndarray  # by block number; the last is that of unknown blocks
    blocks: np.ndarray  # sorted block keys
    bucket: np.ndarray  # by block: first pattern that ends in it
    grams: np.ndarray  # (patterns, m) word numbers, sorted by their last block
    post_start: np.ndarray  # postings of every pattern
    post_item: np.ndarray
    post_at: np.ndarray
    runs: np.ndarray  # patterns of every item
    common: np.ndarray  # postings that are among the item's commonest
    letters: LetterRuns  # runs of twelve letters


def run_length(size: int, least: float = 0.6, most: int = 4) -> int:
    """Words of the patterns of an item: so few that the longer of two passages that make
    up ``least`` of it holds one, two at least, ``most`` for all but short items."""
    return min(most, size, max(2, math.ceil(math.ceil(least * size) / 2)))


def compiled(texts: list[str], least: float = 0.6, most: int = 4, doubt: float = 0.25) -> list[Patterns]:
    """Patterns of the items' texts, one set for each length of runs; an item without
    words has none."""
    words = words_of(texts)
    size = np.bincount(words.text, minlength=len(texts))
    runs = np.array([run_length(n, least, most) if n else 0 for n in size])
    return [_patterns(words, size, runs == m, int(m), doubt) for m in np.unique(runs) if m]


def _patterns(words: Words, size: np.ndarray, own: np.ndarray, m: int, doubt: float) -> Patterns:
    mine = own[words.text]
    owner, h = words.text[mine], words.hash[mine]
    vocabulary = np.unique(h)
    number = np.searchsorted(vocabulary, h)
    # Runs begin at every word but the last m - 1 of an item.
    last = np.cumsum(np.where(own, size, 0))
    begin = np.flatnonzero(np.arange(len(h)) + m <= last[owner])
    rows = np.stack([number[begin + j] for j in range(m)], axis=1)
    item, at = owner[begin], begin - (last - size)[owner[begin]]
    order = np.lexsort((*(rows[:, j] for j in range(m - 2)), rows[:, m - 1], rows[:, max(m - 2, 0)]))
    rows, item, at = rows[order], item[order], at[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]).any(1)
    grams = rows[new]
    post_start = np.concatenate([np.flatnonzero(new), [len(rows)]])
    n_words = len(vocabulary)
    # How far a pattern may still be ahead when its block ends the window.
    all_blocks = [grams[:, j] * n_words + grams[:, j + 1] for j in range(m - 1)] or [grams[:, 0]]
    blocks = np.unique(np.concatenate(all_blocks))
    shift = np.full(len(blocks) + 1, max(m - 1, 1), np.int64)
    for j, b in enumerate(all_blocks):
        np.minimum.at(shift, np.searchsorted(blocks, b), len(all_blocks) - 1 - j)
    bucket = np.searchsorted(np.searchsorted(blocks, all_blocks[-1]), np.arange(len(blocks) + 1))
    # An item's patterns from the one that most items hold down.
    held = np.repeat(np.diff(post_start), np.diff(post_start))
    n_runs = np.bincount(item, minlength=len(size))
    by_held = np.lexsort((at, -held, item))
    rank = np.zeros(len(item), np.int64)
    rank[by_held] = ranges(n_runs)
    common = rank + 1 <= doubt / 2 * n_runs[item]
    edge = np.concatenate([[0], np.cumsum(size)])
    return Patterns(m, vocabulary, size, shift, blocks, bucket, grams, post_start, item, at, n_runs, common, LetterRuns.of(words.letters, words.letter_at[edge], 12))


def occurrences(words: np.ndarray, begins: np.ndarray, ends: np.ndarray, p: Patterns, stretch: int = 192) -> tuple[np.ndarray, np.ndarray]:
    """(position of the first word, pattern) of all occurrences within [begin, end) runs
    of word numbers (-1: not in the vocabulary)."""
    if not len(words):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # Number of the block that ends at each word; a block is a single word if patterns are.
    if p.m == 1:
        key = words
    else:
        key = np.full(len(words), -1, np.int64)
        both = (words[1:] >= 0) & (words[:-1] >= 0)
        key[1:][both] = (words[:-1] * len(p.vocabulary) + words[1:])[both]
    block = np.searchsorted(p.blocks, key)
    block[block == len(p.blocks)] = 0
    unknown = len(p.blocks)
    block = np.where(p.blocks[block] == key, block, unknown)
    # Stretches of window ends: every possible end lies in exactly one of them.
    n_ends = np.maximum(ends - begins - p.m + 1, 0)
    pieces = -(-n_ends // stretch)
    at = np.repeat(begins + p.m - 1, pieces) + ranges(pieces) * stretch
    stop = np.minimum(at + stretch, np.repeat(ends, pieces))
    hits_at, hits_block = [], []
    while len(at):
        b = block[at]
        s = p.shift[b]
        hit = s == 0
        if hit.any():
            hits_at.append(at[hit])
            hits_block.append(b[hit])
        at = at + np.maximum(s, 1)
        go = at < stop
        if not go.all():
            at, stop = at[go], stop[go]
    if not hits_at:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at, b = np.concatenate(hits_at), np.concatenate(hits_block)
    # Every pattern of the block's bucket is compared; the rest of the words decide.
    n = p.bucket[b + 1] - p.bucket[b]
    pattern = np.repeat(p.bucket[b], n) + ranges(n)
    at = np.repeat(at, n)
    for j in range(p.m - 2):
        same = words[at - (p.m - 1) + j] == p.grams[pattern, j]
        at, pattern = at[same], pattern[same]
    return at - (p.m - 1), pattern


def covered(begins: np.ndarray, group: np.ndarray, m: int, gap: int) -> np.ndarray:
    """Words that runs of ``m`` cover, by group; up to ``gap`` words between two runs count
    as disturbed ones of the same passage.  Rows are sorted by (group, begin)."""
    step = np.full(len(begins), m)
    ahead = begins[1:] - begins[:-1]
    step[:-1] = np.where(group[1:] == group[:-1], np.where(ahead <= m + gap, ahead, m), m)
    return np.bincount(group, weights=step).astype(np.int64)


def passages(pair: np.ndarray, item_at: np.ndarray, pos: np.ndarray, size: np.ndarray, m: int, gap: int, bits: int, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(pair, share, whether it is enough, the most it may be, first and last position) of
    the best one or two passages of pairs.

    Runs of ``m`` at ``item_at`` of the item and ``pos`` of the text belong to a passage
    if their distances differ by up to 2 ** ``bits``: two neighbouring bands of distances
    make one.  Two passages count by their union, as they may hold the same part of the
    item; it is looked at only where it may reach ``least`` of the pair's ``size``.  A
    single passage may lack ``m`` - 1, as they go unseen at a disturbed end.
    """
    band = (item_at - pos + (1 << 30)) >> bits
    window = np.concatenate([(pair << 32) | band, (pair << 32) | (band - 1)])
    begin, place = np.concatenate([item_at, item_at]), np.concatenate([pos, pos])
    order = np.lexsort((begin, window))
    window, begin, place = window[order], begin[order], place[order]
    first = np.flatnonzero(np.concatenate([[True], window[1:] != window[:-1]]))
    stop = np.append(first[1:], len(window))
    group = np.repeat(np.arange(len(first)), stop - first)
    words = covered(begin, group, m, gap)
    name = window[first]
    of = name >> 32
    pairs, start = np.unique(of, return_index=True)
    last = np.append(start[1:], len(of))
    rank = np.repeat(np.arange(len(pairs)), last - start)
    top = np.lexsort((-words, of))[start]
    apart = np.abs(name - name[top][rank]) > 1
    second = np.zeros(len(pairs), np.int64)
    np.maximum.at(second, rank[apart], words[apart])
    # The last words of a passage are not seen where one of them is disturbed.
    found = words[top] >= least * size[pairs] - (m - 1) - 1e-6
    share = words[top] / size[pairs]
    lo, hi = np.minimum.reduceat(place, first), np.maximum.reduceat(place, first)
    seen_lo, seen_hi = lo[top], hi[top]
    enough = least * size[pairs] - 1e-6
    for k in np.flatnonzero(~found & (words[top] + second >= enough)):
        own = begin[first[top[k]] : stop[top[k]]]
        for g in range(start[k], last[k]):
            if apart[g] and words[g] + words[top[k]] >= enough[k]:
                both = np.unique(np.concatenate([own, begin[first[g] : stop[g]]]))
                share[k] = max(share[k], covered(both, np.zeros(len(both), np.int64), m, gap)[0] / size[pairs[k]])
        found[k] = share[k] >= least - 1e-6
    near = np.flatnonzero(apart & (words == second[rank]) & (second[rank] > 0))
    np.minimum.at(seen_lo, rank[near], lo[near])
    np.maximum.at(seen_hi, rank[near], hi[near])
    return pairs, np.minimum(share, 1.0), found, (words[top] + second) / size[pairs], seen_lo, seen_hi


def leaks(texts: list[str], groups: list[Patterns], least: float = 0.6, gap: int = 2, doubt: float = 0.25) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, item, share) of the texts that carry ``least`` of an item's words.

    The share is that of the item's words in the one or two passages of the text that
    hold most of it.  In a passage the words keep the item's order and, within about
    thirty words, their distance; up to ``gap`` words between two undisturbed runs of
    ``m`` count as disturbed and carried.  Looked at are the pairs that have ``doubt`` of
    the item's patterns.  Those that have two thirds of ``least`` but not all of it are looked
    at closer, by runs of twelve letters, as words that were broken up or run together
    still have theirs.
    """
    w = words_of(texts)
    count = np.bincount(w.text, minlength=len(texts))
    out = [_leaks(w, count, p, least, gap, doubt) for p in groups] if len(w.text) else []
    return tuple(np.concatenate(c) if c else np.zeros(0, t) for c, t in zip(list(zip(*out, strict=True)) or [(), (), ()], (np.int64, np.int64, float), strict=True))


def _leaks(w: Words, count: np.ndarray, p: Patterns, least: float, gap: int, doubt: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n_items = len(p.size)
    at = np.minimum(np.searchsorted(p.vocabulary, w.hash), len(p.vocabulary) - 1)
    number = np.where(p.vocabulary[at] == w.hash, at, -1)
    end = np.cumsum(count)
    pos, pattern = occurrences(number, end - count, end, p)
    n = p.post_start[pattern + 1] - p.post_start[pattern]
    post = np.repeat(p.post_start[pattern], n) + ranges(n)
    pos = np.repeat(pos, n)
    pair = w.text[pos] * n_items + p.post_item[post]
    # Pairs that have ``doubt`` of the item's patterns; half of these must then lie outside
    # the ``doubt`` / 2 of them that most items hold.
    space = len(count) * n_items
    enough = np.bincount(pair, minlength=space) >= doubt * p.runs[np.arange(space) % n_items]
    enough &= np.bincount(pair[~p.common[post]], minlength=space) >= doubt / 2 * p.runs[np.arange(space) % n_items]
    kept = enough[pair]
    pair, pos, item_at = pair[kept], pos[kept], p.post_at[post[kept]]
    if not len(pair):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    known, code = np.unique(pair, return_inverse=True)
    # Distances count from the text's first word, so its neighbours in the batch don't matter.
    start = end - count
    codes, share, good, bound, lo, hi = passages(code, item_at, pos - start[pair // n_items], p.size[known % n_items], p.m, gap, 4, least)
    text, item = known[codes] // n_items, known[codes] % n_items
    doubtful = np.flatnonzero(~good & (bound >= least * 2 / 3))
    if len(doubtful):
        spare = 2 * p.size[item[doubtful]]
        begin = np.maximum(lo[doubtful] - spare, 0) + start[text[doubtful]]
        stop = np.minimum(hi[doubtful] + spare + start[text[doubtful]], end[text[doubtful]])
        by_letters, enough = _closer(w.letters, p.letters, item[doubtful], w.letter_at[begin], w.letter_at[stop], 6, 6, least)
        share[doubtful] = np.maximum(share[doubtful], by_letters)
        good[doubtful] = enough
    return text[good], item[good], share[good]


def _closer(symbols: np.ndarray, short: LetterRuns, item: np.ndarray, begin: np.ndarray, stop: np.ndarray, gap: int, bits: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Shares of the items' letters, and whether they are enough, that the stretches [begin, stop) have in order."""
    hashes = run_hashes(symbols, short.run)
    owner, item_at, pos = [], [], []
    for k, (i, b, e) in enumerate(zip(item, begin, stop, strict=True)):
        known, at = short.known[i]
        there = hashes[b : max(e - short.run + 1, b)]
        lo = np.searchsorted(known, there)
        hit = np.flatnonzero(lo < len(known))
        hit = hit[known[lo[hit]] == there[hit]]
        n = np.searchsorted(known, there[hit], side="right") - lo[hit]
        owner.append(np.full(int(n.sum()), k))
        item_at.append(at[np.repeat(lo[hit], n) + ranges(n)])
        pos.append(np.repeat(hit, n))
    owner, item_at, pos = (np.concatenate(x).astype(np.int64) for x in (owner, item_at, pos))
    out, found = np.zeros(len(item)), np.zeros(len(item), bool)
    if len(owner):
        known, code = np.unique(owner, return_inverse=True)
        codes, share, good, _, _, _ = passages(code, item_at, pos, short.size[item[known]], short.run, gap, bits, least)
        out[known[codes]], found[known[codes]] = share, good
    return out, found


def leaked(df: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str, least: float = 0.6, items_a_pass: int = 20_000) -> DataFrame:
    """Pairs of a document and an evaluation item that it carries, wholly or in part.

    Result: (key, item, share); ``share`` is the part of the item's words that the
    document's one or two passages hold, ``least`` or more, in a single passage but for
    three words at a disturbed end.  Null and empty texts carry
    nothing; items of null or without words are never found; equal documents and equal
    items are reported each by its key, repeated rows repeatedly.  Items of fewer than 14
    words are searched by shorter runs, a single word by itself.

    No document is shuffled: the items, held-out material of limited size, are broadcast
    in passes of ``items_a_pass``, one held by the driver at a time and compiled once by
    each worker, and whole documents are searched where they are read, once a pass.
    """
    kind, item_kind = df.schema[key].dataType.simpleString(), items.schema[item_key].dataType.simpleString()
    wanted = items.where(F.col(item_text).isNotNull()).select(F.col(item_key).alias("item"), F.col(item_text).alias("text"))
    passes = max(1, -(-wanted.count() // items_a_pass))
    docs = df.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text"))
    own_pass = F.pmod(F.xxhash64("item", "text"), F.lit(passes))
    out = None
    for number in range(passes):
        own = df.sparkSession.sparkContext.broadcast(wanted.where(own_pass == number).orderBy("item", "text").toArrow().combine_chunks())
        found = docs.mapInArrow(_search(uuid.uuid4().hex, own, least), f"key {kind}, item {item_kind}, share double")
        out = found if out is None else out.unionByName(found)
    return out


def _ready(items: pa.Table, least: float) -> tuple[pa.Array, list[Patterns]]:
    return items["item"], compiled(items["text"].to_pylist(), least)


def _search(name: str, items: Broadcast, least: float):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, patterns = once_a_worker(name, items, _ready, least)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            for first, some in portions(texts):
                t, i, share = leaks(some, patterns, least)
                yield pa.record_batch([keys.take(pa.array(t + first)), names.take(pa.array(i)).combine_chunks(), pa.array(share)], names=["key", "item", "share"])

    return search
