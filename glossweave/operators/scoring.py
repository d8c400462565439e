"""Scores of candidates: priors, similarity, attention over context, voting, propagation.

Candidates are rows (doc, span, cand, p, vec): ``span`` numbers the mentions of a
document and ``vec`` is the candidate's vector.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from glossweave.functions import text, vectors


def prior_score(cands: DataFrame) -> DataFrame:
    """The prior as the score."""
    return cands.withColumn("score", F.col("p"))


def combined(weights: dict[str, float], bias: float = 0.0) -> Column:
    """Linear combination of score columns."""
    out = F.lit(float(bias))
    for name, w in weights.items():
        out = out + F.lit(float(w)) * F.col(name)
    return out


def log_prior(p: str = "p", zero: float = 1e-6) -> Column:
    return text.clamped_log(F.col(p), zero)


def similarity(a: str, b: str) -> Column:
    return vectors.dot(F.col(a), F.col(b))


def attention(cands: DataFrame, context: DataFrame, keep: int = 30, zero: float = 0.0) -> DataFrame:
    """(doc, span, cand, score): similarity to an attended context.

    ``context``: (doc, span, pos, wvec).  A context word weighs by its highest similarity
    to any candidate of the span; the best ``keep`` of at least ``zero`` share softmax
    weights, and a candidate's score is its product with the weighted sum of their
    vectors.  Products distribute over that sum, so no vector is summed: each candidate
    adds up weighted products.
    """
    pairs = cands.select("doc", "span", "cand", "vec").join(context, ["doc", "span"]).select("doc", "span", "cand", "pos", vectors.dot(F.col("vec"), F.col("wvec")).alias("s"))
    word = Window.partitionBy("doc", "span", "pos")
    top = pairs.groupBy("doc", "span", "pos").agg(F.max("s").alias("u"))
    order = Window.partitionBy("doc", "span").orderBy(F.desc("u"), "pos")
    kept = top.withColumn("r", F.row_number().over(order)).where((F.col("r") <= keep) & (F.col("u") >= zero))
    whole = Window.partitionBy("doc", "span")
    kept = kept.withColumn("e", F.exp(F.col("u") - F.max("u").over(whole)))
    kept = kept.select("doc", "span", "pos", (F.col("e") / F.sum("e").over(whole)).alias("w"))
    del word
    return pairs.join(kept, ["doc", "span", "pos"]).groupBy("doc", "span", "cand").agg(F.sum(F.col("w") * F.col("s")).alias("score"))


def voters(cands: DataFrame, threshold: float | None = None, top: int | None = None, unambiguous: bool = False) -> DataFrame:
    """The candidates that vote: by local score, by rank in the span, or only those of
    spans with a single candidate.  Adds ``weight`` 1."""
    out = cands
    if threshold is not None:
        out = out.where(F.col("local") >= threshold)
    whole = Window.partitionBy("doc", "span")
    if unambiguous:
        out = out.withColumn("_n", F.count("*").over(whole)).where("_n = 1").drop("_n")
    if top is not None:
        out = out.withColumn("_r", F.row_number().over(whole.orderBy(F.desc("local"), "cand"))).where(F.col("_r") <= top).drop("_r")
    return out.withColumn("weight", F.lit(1.0))


def softmax_voters(cands: DataFrame) -> DataFrame:
    """All candidates vote, by their softmax share in the span."""
    whole = Window.partitionBy("doc", "span")
    e = F.exp(F.col("local") - F.max("local").over(whole))
    return cands.withColumn("_e", e).withColumn("weight", F.col("_e") / F.sum("_e").over(whole)).drop("_e")


def global_votes(cands: DataFrame, voting: DataFrame, dim: int, normalise: bool = True) -> DataFrame:
    """Candidates with ``vote``: the product of their vector with the (unit) sum of the
    voters of the document's other spans.

    That sum is the document's less the span's own, two aggregates by position, never the
    pairs of spans.
    """
    weighted = voting.select("doc", "span", vectors.scaled(F.col("vec"), F.col("weight")).alias("v"))
    names = [f"_{i}" for i in range(dim)]
    by_span = weighted.groupBy("doc", "span").agg(*(F.sum(F.get("v", i)).alias(n) for i, n in enumerate(names)))
    by_doc = by_span.groupBy("doc").agg(*(F.sum(n).alias(n) for n in names)).select("doc", F.array(*names).alias("_all"))
    by_span = by_span.select("doc", "span", F.array(*names).alias("_own"))
    rows = cands.join(by_doc, "doc", "left").join(by_span, ["doc", "span"], "left")
    others = F.when(F.col("_own").isNull(), F.col("_all")).otherwise(vectors.minus(F.col("_all"), F.col("_own")))
    rows = rows.withColumn("_o", others)
    toward = vectors.unit(F.col("_o")) if normalise else F.col("_o")
    return rows.withColumn("vote", F.coalesce(vectors.dot(F.col("vec"), toward), F.lit(0.0))).drop("_all", "_own", "_o")


def hinge_loss(score: Column, is_gold: Column, margin: float = 0.2) -> Column:
    """Gold scores below the margin and other scores above 0 cost their distance."""
    return F.when(is_gold, F.greatest(F.lit(0.0), F.lit(margin) - score)).otherwise(F.greatest(F.lit(0.0), score))


def loopy_beliefs(cands: DataFrame, rounds: int = 10, damping: float = 0.5, weights: list[list[float]] | None = None) -> DataFrame:
    """(doc, span, cand, belief) by damped max-product message passing.

    A candidate's message from another span is the best, over that span's candidates, of
    their local score, their product with it (by ``weights``, a matrix between the
    vectors; none is the identity) times 2 / spans, and the sum of the messages they got
    themselves; it is made a log-softmax over the span's candidates.  The new message
    counts by ``damping``, the old one by the rest, as probabilities; a span sends itself
    0.  Messages begin at 0; beliefs are the local score and all messages, normalised.

    A document's candidates lie in one task, its products only for a block of spans at a
    time.
    """
    kind = {f.name: f.dataType.simpleString() for f in cands.schema.fields}
    between = None if weights is None else np.array(weights, float)

    def propagate(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["span", "cand"]).reset_index(drop=True)
        span = pd.factorize(pdf["span"])[0]
        begins = np.flatnonzero(np.r_[True, span[1:] != span[:-1]])
        n, rows = len(begins), len(pdf)
        x = np.stack(pdf["vec"].to_numpy()).astype(float)
        y = (x if between is None else x @ between.T).T * (2.0 / n)
        unary = pdf["local"].to_numpy(float)

        def normalised(m: np.ndarray) -> np.ndarray:
            m = m - np.maximum.reduceat(m, begins)[span]
            return m - np.log(np.add.reduceat(np.exp(m), begins))[span]

        messages = np.zeros((rows, n))  # messages[c, j]: from span j to candidate c
        block = max(1, 4_000_000 // max(rows, 1))
        for _ in range(rounds):
            sent = unary + messages.sum(1)
            new = np.empty_like(messages)
            for a in range(0, rows, block):
                new[a : a + block] = np.maximum.reduceat(x[a : a + block] @ y + sent, begins, axis=1)
            new = normalised(new)
            new[np.arange(rows), span] = 0
            messages = np.log((1 - damping) * np.exp(messages) + damping * np.exp(new))
        return pdf[["doc", "span", "cand"]].assign(belief=normalised(unary + messages.sum(1)))

    good = cands.where("vec is not null and local is not null").select("doc", "span", "cand", "local", "vec")
    return good.groupBy("doc").applyInPandas(propagate, f"doc {kind['doc']}, span {kind['span']}, cand {kind['cand']}, belief double")


def span_embedding(words: Column, begin: Column, end: Column, scores: Column) -> Column:
    """First word, last word and softmax-weighted sum of a span's word vectors, joined.

    ``words`` is a list of vectors, ``scores`` one number for each word.
    """
    own = F.slice(words, begin.cast("int") + 1, (end - begin).cast("int"))
    share = vectors.softmax(F.slice(scores, begin.cast("int") + 1, (end - begin).cast("int")))
    parts = F.zip_with(own, share, lambda v, s: vectors.scaled(v, s))
    head = F.aggregate(F.slice(parts, F.lit(2), F.size(parts)), F.element_at(parts, 1), vectors.added)
    as_double = lambda v: F.transform(v, lambda x: x.cast("double"))
    return F.concat(as_double(F.element_at(own, 1)), as_double(F.element_at(own, -1)), head)


def feed_forward(v: Column, layers: list[tuple[list[list[float]], list[float]]]) -> Column:
    """Layers of weights and bias with a rectifier between them."""
    for i, (w, b) in enumerate(layers):
        v = vectors.linear(v, w, b)
        if i < len(layers) - 1:
            v = vectors.relu(v)
    return v


def inferred(df: DataFrame, predict, schema: str) -> DataFrame:
    """Hook for a trained model: ``predict`` maps a pandas batch to one of ``schema``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield predict(batch)

    return df.mapInPandas(run, schema)


def ensemble(runs: list[DataFrame], on: list[str], score: str = "score") -> DataFrame:
    """Mean score of several runs over the rows that any of them has."""
    both = runs[0].select(*on, score)
    for r in runs[1:]:
        both = both.unionByName(r.select(*on, score))
    return both.groupBy(*on).agg(F.avg(score).alias(score))


def bucket_bias(p: Column, bounds: list[float], biases: list[float]) -> Column:
    """The learned bias of the bucket that a prior falls into; one bias more than bounds."""
    assert len(biases) == len(bounds) + 1
    return F.element_at(F.array(*(F.lit(float(b)) for b in biases)), text.bucket(p, bounds) + 1)


def pairwise_votes(cands: DataFrame, top: int) -> DataFrame:
    """(doc, span, cand, vote): the mean, over the ``top`` other spans that speak most for
    a candidate, of its best product with one of the span's candidates; 0 without others.

    A document's products stay one matrix in a task; no pair becomes a row.
    """
    kind = {f.name: f.dataType.simpleString() for f in cands.schema.fields}

    def vote(pdf: pd.DataFrame) -> pd.DataFrame:
        span = pd.factorize(pdf["span"], sort=True)[0]
        x = np.stack(pdf["vec"].to_numpy()).astype(float)
        order = np.argsort(span, kind="stable")
        begins = np.flatnonzero(np.r_[True, np.diff(span[order]) > 0])
        best = np.maximum.reduceat(x @ x[order].T, begins, axis=1)
        best[np.arange(len(x)), span] = -np.inf
        take = min(top, best.shape[1] - 1)
        votes = np.sort(best, axis=1)[:, ::-1][:, :take].mean(1) if take else np.zeros(len(x))
        return pdf[["doc", "span", "cand"]].assign(vote=votes)

    good = cands.where("vec is not null").select("doc", "span", "cand", "vec")
    return good.groupBy("doc").applyInPandas(vote, f"doc {kind['doc']}, span {kind['span']}, cand {kind['cand']}, vote double")


def margin_losses(positive: Column, negative: Column, margin: float = 0.1) -> dict[str, Column]:
    """Losses of a pair of similarities: max-margin, and the logistic one of noise
    contrast."""
    logistic = lambda x: -F.ln(1 / (1 + F.exp(-x)))
    return {"maxm": F.greatest(F.lit(0.0), F.lit(margin) - positive + negative), "nce": logistic(positive) + logistic(-negative)}


def sampling_loss(kind: str, scores: Column, log_p: Column | None = None, margin: float = 0.1) -> Column:
    """Loss of a list of similarities, that of the positive word first and those of drawn
    words behind it.

    ``maxm``: mean shortfall of the positive against each drawn one by ``margin``;
    ``neg``: mean soft margin, the positive towards 1 and the others towards -1; ``nce``:
    the same less the log of how often each is drawn, ``log_p`` times the draws; ``is``:
    cross entropy of the positive among all, less ``log_p``.
    """
    n = F.size(scores)
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)
    if kind == "maxm":
        first = F.get(scores, 0)
        return total(F.transform(scores, lambda x, i: F.when(i > 0, F.greatest(F.lit(0.0), F.lit(margin) - first + x)).otherwise(0.0))) / n
    if kind in ("nce", "is"):
        assert log_p is not None
        scores = F.zip_with(scores, log_p, lambda s, p: s - p - (F.ln(n - F.lit(1.0)) if kind == "nce" else F.lit(0.0)))
    if kind == "is":
        return F.ln(total(F.transform(scores, F.exp))) - F.get(scores, 0)
    if kind in ("neg", "nce"):
        return total(F.transform(scores, lambda x, i: F.ln(1 + F.exp(F.when(i == 0, -x).otherwise(x))))) / n
    raise ValueError(f"no loss {kind}")


def assembled(components: str, cands: DataFrame, context: DataFrame | None = None, dim: int = 64, threshold: float = 0.0) -> DataFrame:
    """Scores by the components named in a string, such as ``pem_attention_global``.

    ``pem`` adds the log prior, ``attention`` the similarity to the attended context and
    ``global`` the vote of the other spans' candidates whose local score so far reaches
    ``threshold``; each counts alike.  Result: the candidates with ``local`` and ``score``.
    """
    known = {"pem", "attention", "global"}
    parts = [c for c in components.split("_") if c]
    if not parts or set(parts) - known:
        raise ValueError(f"components are {sorted(known)}, got {components!r}")
    rows = cands.drop("local").withColumn("local", log_prior("p") if "pem" in parts else F.lit(0.0))
    if "attention" in parts:
        if context is None:
            raise ValueError("attention needs a context")
        attended = attention(rows, context).withColumnRenamed("score", "_a")
        rows = rows.join(attended, ["doc", "span", "cand"], "left").withColumn("local", F.col("local") + F.coalesce("_a", F.lit(0.0))).drop("_a")
    if "global" not in parts:
        return rows.withColumn("score", F.col("local"))
    voted = global_votes(rows, voters(rows, threshold=threshold), dim)
    return voted.withColumn("score", F.col("local") + F.col("vote")).drop("vote")
