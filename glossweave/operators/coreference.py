"""Person names that repeat in part: a later, shorter mention takes the candidates of an
earlier, longer one."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


#: A run of letters.
_LETTERS = re.compile(r"[^\W\d_]+")


def sequential(mentions: DataFrame, n: int = 30) -> DataFrame:
    """Adds ``super`` and the merged ``cands`` to mentions (doc, begin, end, mention, cands).

    In order of begin and length, a mention of at least 3 characters is looked up, newest
    first, among the earlier person mentions of its document; one that holds it between
    non-letters lends its candidates: both lists are joined, sorted by (p, id) downwards
    and cut to ``n``, repeats kept.  A mention is remembered if it found none itself, its
    first candidate is a person (``cands.person``) and it has at least 3 characters.

    Whether a mention is remembered depends on those before it, so a document's mentions
    come to a task in order and are looked at as they stream by.  The names remembered
    are indexed by their words: one that holds a mention has its first word as a whole.
    """
    rows = mentions.where("mention is not null").select("doc", "begin", "end", "mention", "cands")
    kind = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, seen, first = None, _Seen(), True
        for batch in batches:
            supers, lent = [], []
            for d, mention, cands in zip(*(batch.column(c).to_pylist() for c in (0, 3, 4)), strict=True):
                if first or d != at:
                    at, seen, first = d, _Seen(), False
                found = seen.holder(mention) if len(mention) >= 3 else None
                if found is None and len(mention) >= 3 and cands and cands[0] and cands[0]["person"]:
                    seen.add(mention, cands)
                supers.append(None if found is None else found[0])
                lent.append(None if found is None else found[1])
            yield pa.record_batch([*batch.columns, pa.array(supers, pa.string()), pa.array(lent, batch.column(4).type)], names=["doc", "begin", "end", "mention", "cands", "super", "lent"])

    order = ["doc", "begin", F.col("end") - F.col("begin"), "end", "mention", "cands"]
    schema = ", ".join([*(f"{c} {kind[c]}" for c in ("doc", "begin", "end", "mention", "cands")), f"super string, lent {kind['cands']}"])
    done = rows.repartition("doc").sortWithinPartitions(*order).mapInArrow(look, schema)
    ranked = F.transform(F.concat("cands", "lent"), lambda c: F.struct(c["p"].alias("p"), c["id"].alias("id"), c["person"].alias("person")))
    merged = F.transform(F.slice(F.sort_array(ranked, asc=False), 1, n), lambda c: F.struct(c["id"].alias("id"), c["p"].alias("p"), c["person"].alias("person")))
    own = F.transform("cands", lambda c: F.struct(c["id"].alias("id"), c["p"].alias("p"), c["person"].alias("person")))
    return done.select("doc", "begin", "end", "mention", "super", F.when(F.col("super").isNotNull(), merged).otherwise(own).alias("cands"))


class _Seen:
    """The remembered names of a document, by their words."""

    def __init__(self) -> None:
        self.names: list[tuple[str, list]] = []
        self.by_word: dict[str, list[int]] = {}

    def add(self, mention: str, cands: list) -> None:
        for w in set(_LETTERS.findall(mention)):
            self.by_word.setdefault(w, []).append(len(self.names))
        self.names.append((mention, cands))

    def holder(self, mention: str) -> tuple[str, list] | None:
        """The newest name that is longer and holds the mention between non-letters."""
        word = _LETTERS.search(mention)
        for i in reversed(self.by_word.get(word[0], []) if word else range(len(self.names))):
            name = self.names[i][0]
            at = name.find(mention) if len(name) > len(mention) else -1
            while at >= 0:
                end = at + len(mention)
                if not (at and name[at - 1].isalpha()) and not (end < len(name) and name[end].isalpha()):
                    return self.names[i]
                at = name.find(mention, at + 1)
        return None


def by_document(mentions: DataFrame, n: int = 100) -> DataFrame:
    """(doc, mention, entity, p): candidates replaced by the mean over the document's
    longer person mentions that begin or end with the mention; mentions without such keep
    theirs.  ``mentions``: (doc, mention, entity, p, person) candidate rows, ``person`` for
    those whose mention's first candidate is a person.

    Every longer mention offers its proper word prefixes and suffixes as keys, so this is
    an equi-join, not a comparison of all pairs.
    """
    longer = mentions.where("person").select("doc", "mention").distinct()
    words = F.split("mention", " ")
    parts = F.flatten(F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda i: F.array(F.array_join(F.slice(words, F.lit(1), i), " "), F.array_join(F.slice(words, i + 1, F.size(words) - i), " "))))
    keys = longer.where(F.size(words) > 1).select("doc", F.col("mention").alias("holder"), F.explode(F.array_distinct(parts)).alias("mention"))
    short = mentions.select("doc", "mention").distinct().join(keys, ["doc", "mention"])
    many = short.groupBy("doc", "mention").agg(F.count("*").alias("_n"))
    lent = short.join(mentions.select("doc", F.col("mention").alias("holder"), "entity", "p"), ["doc", "holder"])
    mean = lent.groupBy("doc", "mention", "entity").agg(F.sum("p").alias("_s")).join(many, ["doc", "mention"]).select("doc", "mention", "entity", (F.col("_s") / F.col("_n")).alias("p"))
    own = mentions.select("doc", "mention", "entity", "p").join(many, ["doc", "mention"], "left_anti")
    order = Window.partitionBy("doc", "mention").orderBy(F.desc("p"), "entity")
    return own.unionByName(mean).withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= n).drop("_r")
