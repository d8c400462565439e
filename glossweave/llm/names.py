"""Mapping freely typed names to the entries of a reference list.

The entries' names and their aliases are written into a trie by their keys (letters and
digits without case, accents and look-alike letters of other scripts).  A typed name is
first cleaned of what its form adds (escapes, links, underscores, quotes, fragments), and
the trie is then walked together with a Levenshtein automaton of its key, kept as one bit
set for each number of errors; that gives all entries within a distance that depends on
the key's length.  The trie lies in flat arrays and many names walk it in lockstep, one
letter a step.

Words of a typed name that shorten a word which recurs in the reference list (its
beginning, or its first and last letter with some between, or initials) lead to alias
paths with that word; no list of abbreviations is kept.  Where a name's shortened words
allow many readings, they are put together word by word, and those that no entry begins
like, within the errors, are left.
"""

from __future__ import annotations

import html
import itertools
import math
import re
import unicodedata
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossweave.llm._arrow import ranges
from glossweave.llm._spark import checkpointed, once_a_worker

#: Letters of other scripts that look like Latin ones.
LOOK_ALIKES = str.maketrans("авекмнорстухіјѕһԁԛԝАВЕКМНОРСТУХІЈЅαεικνορτυχΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "abekmhopctyxijshdqwABEKMHOPCTYXIJSaeikvoptuxABEZHIKMNOPTYX")

_SPACE = re.compile(r"[\s_ ]+")
_HIDDEN = re.compile("[­​-‏‪-‮⁠-⁤﻿]")
_ESCAPED = re.compile(r"%[0-9A-Fa-f]{2}")


_WIKI = re.compile(r"^(?:https?://\S*?)?/?wiki/|^[a-z]{2,3}:(?=\S)", re.IGNORECASE)
_INITIALS = re.compile(r"(?:\w\.)+\w\.?")


def cleaned(name: str) -> str:
    """The name without escapes, links, quotes, fragments and odd white space."""
    if _ESCAPED.search(name):
        name = unquote(name)
    name = unicodedata.normalize("NFKC", html.unescape(name))
    name = _HIDDEN.sub("", name).translate(LOOK_ALIKES)
    name = name.replace("[[", " ").replace("]]", " ").split("|")[0].split("#")[0].replace("&", " and ")
    name = _WIKI.sub("", _SPACE.sub(" ", name).strip())
    return name.strip(" \"'“”„«»‘’`.,;:!?*-")


#: Between an initial and the rest: no run of errors can make or remove it.
_INITIAL = "\x00" * 4


def key_of(name: str) -> str:
    """Letters and digits of the name, without case, accents and anything between."""
    plain = unicodedata.normalize("NFKD", name.casefold())
    return "".join(c for c in plain if c.isalnum())


def forms(plain: str) -> list[str]:
    """Keys under which a cleaned name may be found: as it is, or with its first word as
    an initial, and turned at its comma."""
    out = [key_of(plain)]
    first, _, rest = plain.partition(" ")
    if rest and len(first.rstrip(".")) == 1 and first[0].isalpha():
        out = [key_of(first) + _INITIAL + key_of(rest)]
    before, comma, after = plain.partition(",")
    if comma and before.strip() and after.strip():
        out.append(key_of(after + before))
    return [k for k in out if k]


def aliases(name: str) -> list[str]:
    """Keys that stand for an entry: its name, without article, its words turned round,
    its first word as an initial."""
    plain = cleaned(name)
    out = [key_of(plain)]
    words = plain.split(" ")
    if len(words) > 2 and words[0].casefold() == "the":
        out.append(key_of("".join(words[1:])))
    if len(words) == 2 and all(w.isalpha() for w in words):
        out.append(key_of(words[1] + words[0]))
    if len(words) > 1 and words[0].isalpha() and words[0].casefold() != "the":
        out.append(key_of(words[0][0]) + _INITIAL + key_of("".join(words[1:])))
    return [k for k in out if k]


def words_of(name: str) -> list[tuple[str, bool]]:
    """(key, whether dots set its letters apart) of the words of a name."""
    return [(key_of(w), _INITIALS.fullmatch(w) is not None) for w in cleaned(name).split(" ") if key_of(w)]


def abbreviates(short: str, word: str) -> bool:
    """Whether ``short`` is the beginning of ``word``, or its first and last letter with
    some of those between in their order."""
    if not 2 <= len(short) < len(word):
        return False
    if word.startswith(short):
        return True
    if len(short) < 3 or len(short) > len(word) - 2 or short[0] != word[0] or short[-1] != word[-1]:
        return False
    rest = iter(word)
    return all(c in rest for c in short)


def key_parts(choices: list[list[str]]) -> list[list[list[str]]]:
    """The keys that ``forms`` gives of all names whose words are one of each choice, as
    runs of parts, each with its alternatives."""
    parts = [[key_of(w) for w in c] for c in choices]
    first = choices[0][0]
    if len(choices) > 1 and len(choices[0]) == 1 and len(first.rstrip(".")) == 1 and first[0].isalpha():
        out = [[[key_of(first) + _INITIAL], *parts[1:]]]
    else:
        out = [parts]
    # A word with a comma has no alternatives, as these are keys.
    comma = next((i for i, c in enumerate(choices) if "," in c[0]), None)
    if comma is not None:
        before, _, after = choices[comma][0].partition(",")
        if (comma or before.strip()) and (after.strip() or comma + 1 < len(choices)):
            out.append([[key_of(after)], *parts[comma + 1 :], *parts[:comma], [key_of(before)]])
    return out


class Recurring:
    """Words that recur in the reference list, and the readings that they give a name."""

    def __init__(self, words: list[tuple[str, bool]], most: int = 16):
        #: Names with more readings are not read one by one but along the trie.
        self.most = most
        self.initials = {w for w, dotted in words if dotted}
        self.runs = sorted({len(w) for w in self.initials if len(w) > 1}, reverse=True)
        self.plain = {w for w, dotted in words if not dotted}
        self.by_letter: dict[str, list[str]] = {}
        for w in sorted(self.plain):
            self.by_letter.setdefault(w[0], []).append(w)

    def choices(self, plain: str) -> list[list[str]]:
        """For each word, or run of words, of the name what it may stand for: shortened
        words are written out, words whose initials recur are shortened to them."""
        words = plain.split(" ")
        choices: list[list[str]] = []
        i = 0
        while i < len(words):
            run = next((n for n in self.runs if i + n <= len(words) and "".join(key_of(w)[:1] for w in words[i : i + n]) in self.initials), 0)
            if run and all(len(key_of(w)) > 1 for w in words[i : i + run]):
                choices.append(["".join(key_of(w)[:1] for w in words[i : i + run])])
                i += run
                continue
            k = key_of(words[i])
            longer = [] if not k or k in self.plain else [w for w in self.by_letter.get(k[0], []) if abbreviates(k, w)]
            choices.append(longer or [words[i]])
            i += 1
        return choices

    def untitled(self, plain: str) -> list[str]:
        """The name without a shortened word before it: such a word, as a person's title,
        may stand for none of the list's."""
        first, _, rest = plain.partition(" ")
        return [rest] if rest and first.endswith(".") and len(key_of(first)) > 1 else []

    def readings(self, plain: str) -> list[str]:
        """The name in every way that the list's words allow."""
        out = [" ".join(c) for c in itertools.product(*self.choices(plain))]
        return [r for r in out + self.untitled(plain) if r != plain]


class Trie:
    """Keys in a trie of flat arrays, searched within an edit distance by many at once."""

    def __init__(self, keys: list[str]):
        self.keys = sorted(set(keys))
        self.forward = _Tree(self.keys)
        turned = [k[::-1] for k in self.keys]
        order = sorted(range(len(turned)), key=turned.__getitem__)
        self.turned_at = np.array(order, np.int64)
        self.backward = _Tree([turned[i] for i in order])

    def within(self, asked: list[str], most: int, at_once: int = 1000) -> list[dict[int, int]]:
        """For every asked key the numbers of the keys within ``most`` insertions,
        deletions, replacements and swaps of neighbours, with their distances.

        Of two halves of a key one has at most half of the errors.  So the tree of the
        keys is walked with few errors allowed in the first half, and that of the keys
        from behind with few in the second, which leaves most branches early.
        """
        found: list[dict[int, int]] = [{} for _ in asked]
        by_size = sorted(range(len(asked)), key=lambda i: len(asked[i]))
        for a in range(0, len(by_size), at_once):
            some = by_size[a : a + at_once]
            keys = [asked[i] for i in some]
            walks = [(self.forward, keys, [len(k) // 2 for k in keys], None)]
            if most:
                walks.append((self.backward, [k[::-1] for k in keys], [len(k) - len(k) // 2 for k in keys], self.turned_at))
            for tree, own, half, number in walks:
                for q, key, d in zip(*tree.walk(own, half, most), strict=True):
                    n = int(key if number is None else number[key])
                    if d < found[some[q]].get(n, most + 1):
                        found[some[q]][n] = d
        return found


    def begin(self, asked: list[str], most: int, at_once: int = 100) -> list[bool]:
        """Whether a beginning of any key is within ``most`` errors of each asked one."""
        found = np.array([len(k) <= most for k in asked], bool)
        for a in range(0, len(asked), at_once):
            hit, _, _ = self.forward.walk(asked[a : a + at_once], None, most)
            found[a + np.array(hit, np.int64)] = True
        return found.tolist()


class _Tree:
    """A trie over sorted keys, by levels: the children of a node lie side by side."""

    def __init__(self, keys: list[str]):
        size = np.array([len(k) for k in keys], np.int64)
        deepest = int(size.max(initial=0))
        cps = np.zeros((len(keys), deepest), np.uint32)
        for i, k in enumerate(keys):
            cps[i, : len(k)] = np.frombuffer(k.encode("utf-32-le", "surrogatepass"), np.uint32)
        letters, parents, ends = [np.zeros(1, np.uint32)], [np.zeros(0, np.int64)], [np.full(1, -1)]
        if len(keys) and not size[0]:
            ends[0][0] = 0
        at = np.zeros(len(keys), np.int64)  # node of every key so far
        same = np.concatenate([[False], np.ones(max(len(keys) - 1, 0), bool)])[: len(keys)]
        nodes = 1
        for d in range(deepest):
            same[1:] &= cps[1:, d] == cps[:-1, d]
            there = size > d
            rows = np.flatnonzero(there & ~same)
            number = nodes - 1 + np.cumsum(there & ~same)
            letters.append(cps[rows, d])
            parents.append(at[rows])
            end = np.full(len(rows), -1)
            last = np.flatnonzero(size == d + 1)
            end[number[last] - nodes] = last
            ends.append(end)
            at = np.where(there, number, at)
            nodes += len(rows)
        self.letter, self.end = np.concatenate(letters), np.concatenate(ends)
        self.children = np.bincount(np.concatenate(parents), minlength=nodes)
        self.first = 1 + np.cumsum(self.children) - self.children
        self.alphabet, self.code = np.unique(self.letter, return_inverse=True)

    def walk(self, asked: list[str], half: list[int] | None, most: int) -> tuple[list[int], list[int], list[int]]:
        """(asked, key, distance) of keys within ``most`` errors, of which at most half
        before ``half``; without ``half``, of any beginning of a key the first found.

        The automaton's states are one bit set for each number of errors: bit i means
        that the asked key's first i letters are matched by those on the way from the root.
        """
        kind = np.uint64 if max(map(len, asked), default=0) < 60 else object
        whole = lambda values: np.array(values, kind) if kind is object else np.array(values, np.uint64)
        bit = [whole(1 << i)[()] for i in range(3)]
        number = {int(c): i for i, c in enumerate(self.alphabet)}
        has = np.zeros((len(asked), len(self.alphabet)), kind)
        for q, key in enumerate(asked):
            for i, c in enumerate(key):
                n = number.get(ord(c))
                if n is not None:
                    has[q, n] |= whole(1 << i)[()]
        full = whole([(1 << (len(k) + 1)) - 1 for k in asked])
        late = whole([((1 << (len(k) + 1)) - 1) & ~((1 << h) - 1) for k, h in zip(asked, half or [0] * len(asked), strict=True)])
        accept = whole([1 << len(k) for k in asked])
        allowed = [full if half is None or d <= most // 2 else late for d in range(most + 1)]
        q, node = np.arange(len(asked)), np.zeros(len(asked), np.int64)
        states = [whole([(1 << (d + 1)) - 1] * len(asked)) & allowed[d] for d in range(most + 1)]
        before, last = [np.zeros(len(asked), kind) for _ in states], np.zeros(len(asked), kind)
        out: tuple[list[int], list[int], list[int]] = ([], [], [])
        one, two = bit[1] - bit[0], bit[1]
        while len(q):
            n = self.children[node]
            up = np.repeat(np.arange(len(q)), n)
            node = np.repeat(self.first[node], n) + ranges(n)
            q, old, earlier, swapped = q[up], [s[up] for s in states], [s[up] for s in before], last[up] >> one
            own = has[q, self.code[node]]
            now = [(old[0] & own) << one]
            for d in range(1, most + 1):
                nxt = ((old[d] & own) << one) | old[d - 1] | (old[d - 1] << one) | (now[d - 1] << one) | ((earlier[d - 1] & own & swapped) << two)
                now.append(nxt & allowed[d][q])
            alive = now[0] != 0
            for s in now[1:]:
                alive |= s != 0
            q, node, states, before, last = q[alive], node[alive], [s[alive] for s in now], [s[alive] for s in old], own[alive]
            ends = np.flatnonzero(self.end[node] >= 0) if half is not None else np.arange(len(q))
            if len(ends):
                errors = np.full(len(ends), most + 1)
                for d in range(most, -1, -1):
                    errors[(states[d][ends] & accept[q[ends]]) != 0] = d
                good = errors <= most
                for column, values in zip(out, (q[ends], self.end[node[ends]], errors), strict=True):
                    column.extend(values[good].tolist())
                if half is None:
                    left = ~np.isin(q, q[good])
                    q, node, states, before, last = q[left], node[left], [s[left] for s in states], [s[left] for s in before], last[left]
        return out


def most_errors(length: int) -> int:
    """Errors that a key of this length may have."""
    return 0 if length < 5 else 1 if length < 7 else 2


#: Errors that any key may have at most.
_MOST_ERRORS = most_errors(1 << 20)

#: Rank of a name with no entry in reach, after all others.
_NO_HIT = 1 << 20


@dataclass
class Hit:
    """The best entries for a typed name: a name as such comes before its turned or
    shortened forms, then readings of shortened words, then all that differ."""

    rank: int = _NO_HIT
    distance: int = -1
    ids: list[int] = field(default_factory=list)


class Matcher:
    """Finds the entries meant by typed names, among entries (name, id) and aliases."""

    def __init__(self, entries: list[tuple[str, int]], recurring: list[tuple[str, bool]] | None = None):
        self.own: dict[str, list[int]] = {}
        self.alias: dict[str, list[int]] = {}
        self.own_keys: dict[int, list[str]] = {}
        for n, i in entries:
            k = key_of(cleaned(n))
            self.own_keys.setdefault(i, []).append(k)
            for table, keys in ((self.own, [k]), (self.alias, aliases(n))):
                for k in keys:
                    if i not in table.setdefault(k, []):
                        table[k].append(i)
        self.trie = Trie(list(self.alias))
        self.recurring = Recurring(recurring or [])

    def best(self, names: list[str]) -> list[Hit]:
        out: list[Hit | None] = []
        open_keys: dict[int, list[tuple[int, int, str]]] = {0: [], 1: [], 2: []}
        for at, name in enumerate(names):
            plain = cleaned(name)
            own, read = forms(plain), self._read_keys(plain)
            hit = self._exact(own, 0) or self._exact(read, 50)
            out.append(hit)
            if hit is None:
                for rank, keys in ((100, own), (200, read)):
                    for k in dict.fromkeys(keys):
                        open_keys[most_errors(len(k.replace("\x00", "")))].append((at, rank, k))
        near: dict[int, Hit] = {}
        for most, asked in open_keys.items():
            for (at, rank, _), found in zip(asked, self.trie.within([k for _, _, k in asked], most) if most else [{}] * len(asked), strict=True):
                for n, d in found.items():
                    hit = near.setdefault(at, Hit())
                    if rank + d < hit.rank:
                        hit.rank, hit.distance, hit.ids = rank + d, d, []
                    if rank + d == hit.rank:
                        hit.ids = sorted({*hit.ids, *self.alias[self.trie.keys[n]]})
        return [hit or near.get(at, Hit()) for at, hit in enumerate(out)]

    def _read_keys(self, plain: str) -> list[str]:
        """Keys of the name's readings; where these are many, of all that can be within
        reach of an entry."""
        choices = self.recurring.choices(plain)
        if math.prod(map(len, choices)) <= self.recurring.most:
            return [k for r in self.recurring.readings(plain) for k in forms(r)]
        out = [k for r in self.recurring.untitled(plain) for k in forms(r)]
        for parts in key_parts(choices):
            begun = [""]
            for alternatives in parts:
                begun = list(dict.fromkeys(b + k for b in begun for k in alternatives))
                if len(begun) > self.recurring.most:
                    # What no beginning of a key is near to leads to no key.
                    begun = [b for b, near in zip(begun, self.trie.begin(begun, _MOST_ERRORS), strict=True) if near]
            out += [k for k in begun if k]
        return out

    def _exact(self, keys: list[str], rank: int) -> Hit | None:
        """The first key that is an entry's own, else the first that is an alias; of the
        readings of shortened words all that are."""
        for table in (self.own, self.alias):
            ids: set[int] = set()
            for k in keys:
                if k in table:
                    ids |= set(table[k])
                    if rank < 50:
                        break
                rank += rank < 50
            if ids:
                return Hit(rank, 0, sorted(ids))
        return None


def mapped(df: DataFrame, key: str, typed: str, hint: str, entries: DataFrame, name: str, entry_id: str, old_names: DataFrame, old: str, new: str, entries_a_pass: int = 50_000, broadcast_bytes: int = 32 << 20, one_in: int = 2000) -> DataFrame:
    """The entry that every typed name means.

    ``old_names`` (old, new) are further names of entries; an old name whose new one is
    no entry means none.  Of several nearest entries the one whose name the ``hint``
    column holds is meant, or else none, as the typed name doesn't tell.  Result: (key,
    typed, entry_id, distance, as_listed), one row for each row with a typed name that is
    neither null nor blank: ``entry_id`` -1 if no entry is meant, ``distance`` that of the
    nearest entry (-1: none in reach), ``as_listed`` for names that are an entry's letter
    for letter; an old name, however exact, is none of these.  Repeated rows give repeated results.

    Each distinct name is looked up once, whatever the number of rows that have it.  The
    reference list is broadcast in passes of ``entries_a_pass`` names, one held by the
    driver at a time and built into a trie once by each worker; the best hits of the
    passes are then put together.  What the names mean goes back to the rows by a
    broadcast up to ``broadcast_bytes``; beyond that only names that fill a 64th of the
    rows do, the others by a shuffle.

    Words recur, and may be shortened, that eight names hold and one of ``one_in``, which
    bounds how many reach the driver; with 0, all that eight names hold.
    """
    listed = entries.where(F.col(name).isNotNull() & F.col(entry_id).isNotNull()).groupBy(F.col(name).alias("n")).agg(F.min(entry_id).cast("bigint").alias("i"))
    renamed = old_names.where(F.col(old).isNotNull()).select(F.col(old).alias("o"), F.col(new).alias("n")).join(listed, "n", "left").groupBy(F.col("o").alias("n")).agg(F.coalesce(F.max("i"), F.lit(-1)).alias("i"))
    both = checkpointed(listed.withColumn("listed", F.lit(True)).unionByName(renamed.join(listed, "n", "left_anti").withColumn("listed", F.lit(False))))
    n_names = both.count()
    words = _recurring(both, max(8, n_names // one_in) if one_in else 8)
    rows = df.where(F.col(typed).isNotNull() & F.regexp_like(F.col(typed), F.lit("\\S"))).select(F.col(key).alias("key"), F.col(typed).alias("typed"), F.col(hint).alias("hint"))
    asked = checkpointed(rows.groupBy("typed").agg(F.count("*").alias("n")))
    passes = max(1, -(-n_names // entries_a_pass))
    schema = "typed string, rank bigint, distance bigint, ids array<bigint>, own array<struct<id:bigint,k:string>>, as_listed boolean"
    found = None
    for number in range(passes):
        own = df.sparkSession.sparkContext.broadcast(both.where(F.pmod(F.xxhash64("n"), F.lit(passes)) == number).orderBy("n").toArrow().combine_chunks())
        part = asked.select("typed").mapInArrow(_lookup(uuid.uuid4().hex, own, words, passes > 1), schema)
        found = part if found is None else found.unionByName(part)
    if passes > 1:
        best = F.min("rank").alias("rank"), F.max("as_listed").alias("as_listed"), F.collect_list(F.struct("rank", "distance", "ids", "own")).alias("all")
        at_best = lambda c: F.flatten(F.transform(F.filter("all", lambda x: x["rank"] == F.col("rank")), lambda x: x[c]))
        distance = F.get(F.filter("all", lambda x: x["rank"] == F.col("rank")), 0)["distance"]
        found = found.groupBy("typed").agg(*best).select("typed", distance.alias("distance"), F.array_distinct(at_best("ids")).alias("ids"), F.array_distinct(at_best("own")).alias("own"), "as_listed")
    found = found.select("typed", "distance", "ids", "own", "as_listed")
    size, total = asked.agg(F.sum(F.octet_length("typed") + 100), F.sum("n")).first()
    if (size or 0) <= broadcast_bytes:
        met = rows.join(F.broadcast(found), "typed")
    else:
        hot = asked.where(F.col("n") > total // 64).select("typed")
        met = rows.join(F.broadcast(found.join(F.broadcast(hot), "typed")), "typed").unionByName(rows.join(F.broadcast(hot), "typed", "left_anti").join(found, "typed"))
    known = met.where(F.size("ids") <= 1).select("key", "typed", F.coalesce(F.get("ids", 0), F.lit(-1)).alias("entry_id"), "distance", "as_listed")
    kind = df.schema[key].dataType.simpleString()
    open_rows = met.where(F.size("ids") > 1).select("key", "typed", "hint", "own", "distance", "as_listed")
    return known.unionByName(open_rows.mapInArrow(_by_hint, f"key {kind}, typed string, entry_id bigint, distance bigint, as_listed boolean"))


def _recurring(names: DataFrame, least: int) -> list[tuple[str, bool]]:
    """Words that at least ``least`` names hold."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [w for n in batch.column(0).to_pylist() for w in set(words_of(n))]
            yield pa.record_batch([pa.array([w for w, _ in words], pa.string()), pa.array([d for _, d in words], pa.bool_())], names=["w", "dotted"])

    counted = names.select("n").mapInArrow(split, "w string, dotted boolean").groupBy("w", "dotted").count()
    return sorted((r["w"], r["dotted"]) for r in counted.where(F.col("count") >= least).collect())


def _ready(entries: pa.Table, words: tuple[tuple[str, bool], ...]) -> tuple[Matcher, set[str]]:
    names, ids, listed = (entries[c].to_pylist() for c in ("n", "i", "listed"))
    return Matcher(list(zip(names, ids, strict=True)), list(words)), {n for n, own in zip(names, listed, strict=True) if own}


def _lookup(name: str, entries: Broadcast, words: list[tuple[str, bool]], several: bool):
    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            matcher, listed = once_a_worker(name, entries, _ready, tuple(words))
            typed = batch.column(0).to_pylist()
            hits = matcher.best(typed)
            own = [[{"id": i, "k": k} for i in h.ids for k in matcher.own_keys.get(i, [])] if several or len(h.ids) > 1 else [] for h in hits]
            made = [pa.array([h.rank for h in hits], pa.int64()), pa.array([h.distance for h in hits], pa.int64()), pa.array([h.ids for h in hits], pa.list_(pa.int64()))]
            yield pa.record_batch([batch.column(0), *made, pa.array(own, pa.list_(pa.struct([("id", pa.int64()), ("k", pa.string())]))), pa.array([t in listed for t in typed])], names=["typed", "rank", "distance", "ids", "own", "as_listed"])

    return look


def _by_hint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of several entries the only one that has the hint for a name, else none."""
    for batch in batches:
        meant = []
        for hint, own in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            key = key_of(cleaned(hint)) if hint else ""
            ids = {x["id"] for x in own if x["k"] == key}
            meant.append(ids.pop() if key and len(ids) == 1 else -1)
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(meant, pa.int64()), batch.column(4), batch.column(5)], names=["key", "typed", "entry_id", "distance", "as_listed"])
