"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic examples are the positives P; other text, whose labels aren't
looked at, is the unlabelled set U, a mixture in which toxic text has the share
``prior``. With a loss l of a linear score g the risk of a classifier is

    prior * E_P[l(g)] + max(0, E_U[l(-g)] - prior * E_P[l(-g)])

where the bracket estimates the risk on clean text; where it falls below zero
the model has begun to fit noise, and the step goes against that term instead
(Kiryo et al., 2017). Features are the words of a text, found by one tokenizer
in training and scoring. Words that tell P from U are chosen by document
counts, those of U over the whole corpus. Several classifiers are trained in
numpy, each without one fold; the scores that each gives the fold it hasn't
seen calibrate the final one, by the same risk in two parameters (which is
convex, and makes the mean probability over U equal to the prior). Labels of
clean documents serve for one number only, the prior, where none is given.

Training reads at most ``max_positive`` and ``max_unlabelled`` documents,
chosen by a hash of their ids; counting and scoring read every whole text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheaf.llm._shared import Scratch, held_out, table, text_or_empty, tidy

WORD = re.compile(r"\w+")
FOLDS = 3


@dataclass
class Sample:
    """Sparse rows (word positions of the chosen words in each document)."""

    rows: np.ndarray
    cols: np.ndarray
    n: int
    width: int

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.rows, w[self.cols], self.n) if len(self.rows) else np.zeros(self.n)

    def t_dot(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.cols, g[self.rows], self.width) if len(self.rows) else np.zeros(self.width)

    def take(self, mask: np.ndarray) -> Sample:
        at = np.cumsum(mask) - 1
        keep = mask[self.rows] if len(self.rows) else np.zeros(0, bool)
        return Sample(at[self.rows[keep]], self.cols[keep], int(mask.sum()), self.width)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def pu_risk(pos: Sample, unl: Sample, prior: float, w: np.ndarray, b: float) -> tuple[float, float, np.ndarray, np.ndarray]:
    """Risk on toxic text, estimated risk on clean text, and the gradients of both by (w, b); logistic loss."""
    gp, gu = pos.dot(w) + b, unl.dot(w) + b
    toxic = prior * float(np.mean(np.logaddexp(0, -gp)))
    clean = float(np.mean(np.logaddexp(0, gu)) - prior * np.mean(np.logaddexp(0, gp)))
    # derivative of l(g) = log(1 + e^-g) is -sigmoid(-g); of l(-g) it is sigmoid(g)
    dt, du, dp = -prior * _sigmoid(-gp) / pos.n, _sigmoid(gu) / unl.n, -prior * _sigmoid(gp) / pos.n
    return toxic, clean, np.append(pos.t_dot(dt), dt.sum()), np.append(unl.t_dot(du) + pos.t_dot(dp), du.sum() + dp.sum())


def train_nnpu(pos: Sample, unl: Sample, prior: float, steps: int = 200, rate: float = 0.1, l2: float = 1e-3, slack: float = 0.0) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative risk; Adam, full batches."""
    w, b = np.zeros(pos.width), float(np.log(prior / (1 - prior)))
    m, v = np.zeros(pos.width + 1), np.zeros(pos.width + 1)
    for step in range(1, steps + 1):
        _, clean, d_toxic, d_clean = pu_risk(pos, unl, prior, w, b)
        grad = d_toxic + d_clean if clean >= -slack else -d_clean
        grad[:-1] += l2 * w
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return w, b


def calibrate(pos: np.ndarray, unl: np.ndarray, prior: float, ridge: float = 1e-3, steps: int = 100) -> tuple[float, float]:
    """Slope and offset of the log odds of scores, from positives, unlabelled rows and the prior.

    The risk of log odds a s + b is E_U[log(1 + e^(a s + b))] - prior * E_P[a s + b]: convex, solved by Newton steps.
    """
    a, b = 1.0, 0.0
    x = np.column_stack([unl, np.ones(len(unl))])
    target = prior * np.array([pos.mean(), 1.0])
    for _ in range(steps):
        p = _sigmoid(a * unl + b)
        grad = x.T @ p / len(unl) - target + ridge * np.array([a - 1, 0.0])
        hess = (x * (p * (1 - p))[:, None]).T @ x / len(unl) + np.diag([ridge, 1e-9])
        step = np.linalg.solve(hess, grad)
        step *= min(1.0, 1.0 / (np.abs(step).max() + 1e-12))
        a, b = max(a - step[0], 1e-3), b - step[1]
    return float(a), float(b)


def words(text: str) -> set[str]:
    """The features of a text, in training and scoring."""
    return set(WORD.findall(text.lower()))


@dataclass
class ToxicityModel:
    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -20.0
    prior: float = 0.0

    def score_texts(self, texts) -> np.ndarray:
        known, get = self.weights.keys(), self.weights.__getitem__
        g = np.fromiter((sum(map(get, sorted(known & words(t)))) for t in texts), float, len(texts))
        return _sigmoid(g + self.bias)

    def score(self, text: Column) -> Column:
        """Probability that a text is toxic; a null text counts as empty."""
        model = self

        @F.pandas_udf(T.DoubleType())
        @tidy
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for texts in batches:
                yield pd.Series(model.score_texts(texts))

        return run(F.coalesce(text, F.lit("")))


def corpus_counts(docs: DataFrame, chosen: list[str], text_col: str) -> dict[str, int]:
    """In how many of all documents each of some words stands."""
    if not chosen:
        return {}
    known = frozenset(chosen)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: Counter[str] = Counter()
        for pdf in batches:
            for t in pdf["t"]:
                total.update(known & words(t))
        yield pd.DataFrame({"word": np.array(list(total), object), "n": np.array(list(total.values()), np.int64)})

    counted = docs.select(text_or_empty(text_col).alias("t")).mapInPandas(tidy(run), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {r["word"]: r["n"] for r in counted.collect()}


def _spread(in_p: np.ndarray, n_p: int, in_u: np.ndarray, n_u: int) -> np.ndarray:
    """How many standard errors the share of positives with a word is above the unlabelled share."""
    p, u = in_p / n_p, in_u / n_u
    return (p - u) / np.sqrt(np.maximum(u, 1 / n_u) * (1 / n_p + 1 / n_u))


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    max_positive: int = 4_000,
    max_unlabelled: int = 12_000,
    max_words: int = 2_000,
    seed: int = 5,
    prior: float | None = None,
) -> ToxicityModel:
    """Train on documents and labels outside the held-out fold.

    Null labels and ids, and labels without a document, are left out; a
    document that is labelled both ways counts as toxic; of rows that repeat
    an id the least text trains. ``prior`` is the share of toxic documents, by
    default that among the labelled ones. Without positives the model scores
    every text near 0.
    """
    usable = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).alias("k")).agg(F.max(F.col(label_col).cast("int")).alias("y"))
    if prior is None:
        prior = float(usable.agg(F.avg("y")).first()[0] or 0.0)
    if not prior:
        return ToxicityModel()
    prior = min(prior, 0.9)
    # ids of the bounded sample: at most max_positive + max_unlabelled
    chosen = (
        usable.where("y = 1").select("k", F.xxhash64(F.lit(seed), "k").alias("h")).orderBy("h", "k").limit(max_positive).select("k", F.lit(1).alias("p"), F.lit(0).alias("u"))
        .union(
            docs.where(F.col(id_col).isNotNull() & ~held_out(id_col)).select(F.col(id_col).alias("k")).distinct()
            .orderBy(F.xxhash64(F.lit(seed + 1), F.col("k")), "k").limit(max_unlabelled).select("k", F.lit(0).alias("p"), F.lit(1).alias("u"))
        )
        .groupBy("k").agg(F.max("p").alias("p"), F.max("u").alias("u"))
    )
    kind = docs.schema[id_col].dataType.simpleString()

    def bags(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf[["k", "p", "u"]].assign(bag=[sorted(words(t)) for t in pdf["t"]])

    scratch = Scratch(docs.sparkSession, "toxicity")
    source = docs.select(F.col(id_col).alias("k"), text_or_empty(text_col).alias("t")).join(F.broadcast(chosen), "k").groupBy("k", "p", "u").agg(F.min("t").alias("t"))
    sample = scratch.keep(source.mapInPandas(tidy(bags), f"k {kind}, p int, u int, bag array<string>"), "sample")
    n_p, n_u, n = sample.agg(F.coalesce(F.sum("p"), F.lit(0)), F.coalesce(F.sum("u"), F.lit(0)), F.count(F.lit(1))).first()
    if not n_p or not n_u:
        return ToxicityModel(prior=prior)
    # candidates by the sample, four times as many as can be taken; the choice by the whole corpus
    in_p, in_u = F.col("in_p") / n_p, F.col("in_u") / n_u
    z = F.abs((in_p - in_u) / F.sqrt(F.greatest(in_u, F.lit(1.0 / n_u)) * (1.0 / n_p + 1.0 / n_u)))
    found = (
        sample.select(F.explode("bag").alias("word"), "p", "u").groupBy("word").agg(F.sum("p").alias("in_p"), F.sum("u").alias("in_u"))
        .where((F.col("in_p") >= 3) | (F.col("in_u") >= 8)).select("word", "in_p", z.alias("z")).where("z >= 3").orderBy(F.desc("z"), "word").limit(4 * max_words).collect()
    )
    in_corpus = corpus_counts(docs, [r["word"] for r in found], text_col)
    spread = _spread(np.array([r["in_p"] for r in found], float), n_p, np.array([in_corpus.get(r["word"], 0) for r in found], float), docs.count())
    chosen_words = [found[i]["word"] for i in sorted(range(len(found)), key=lambda i: (-abs(spread[i]), found[i]["word"])) if abs(spread[i]) >= 4][:max_words]
    hits = F.array_intersect("bag", F.lit(chosen_words)) if chosen_words else F.array().cast("array<string>")
    rows = sorted((r["k"], r["p"], r["u"], r["hits"]) for r in sample.select("k", "p", "u", hits.alias("hits")).collect())
    scratch.drop("sample")
    at = {w: i for i, w in enumerate(chosen_words)}
    x = Sample(
        np.repeat(np.arange(n), [len(r[3]) for r in rows]).astype(np.int64),
        np.fromiter((at[w] for r in rows for w in r[3]), np.int64),
        n,
        len(chosen_words),
    )
    p, u = np.array([r[1] for r in rows], bool), np.array([r[2] for r in rows], bool)
    fold = np.arange(n) % FOLDS
    unseen = np.zeros(n)
    for f in range(FOLDS):
        if (p & (fold != f)).any() and (u & (fold != f)).any():
            w, b = train_nnpu(x.take(p & (fold != f)), x.take(u & (fold != f)), prior)
            test = fold == f
            unseen[test] = x.take(test).dot(w) + b
    w, b = train_nnpu(x.take(p), x.take(u), prior)
    slope, offset = calibrate(unseen[p], unseen[u], prior)
    return ToxicityModel({t: slope * float(v) for t, v in zip(chosen_words, w, strict=True)}, slope * b + offset, prior)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity, by a model that never saw the held-out labels."""
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", held_out().alias("held_out"), model.score(F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def drop_toxic(docs: DataFrame, model: ToxicityModel, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, all columns kept."""
    name = "_sheaf_toxicity"
    return docs.withColumn(name, model.score(F.col(text_col))).where(F.col(name) < threshold).drop(name)
