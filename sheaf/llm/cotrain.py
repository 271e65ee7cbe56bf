"""Quality scores by co-training a text view and a metadata view.

The text view sees what a text is made of: all its words and its shapes
(letters as ``a``, digits as ``9``, marks as they are). The metadata view sees
what the page's record says and nothing of the text: language, source and
stated size, alone and in pairs. Each view has a logistic classifier in numpy.
In every round each view labels the rows of an unlabelled pool that it is most
sure of, in the proportion of the classes, and hands them to the other view's
training set. At last both views are calibrated on labelled rows they weren't
trained on, and a logistic combination of the two calibrated log odds scores
all documents.

Fitting reads at most ``max_labelled`` labelled and ``max_pool`` other
documents, chosen by a hash of the id; scoring reads every whole text.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.llm._shared import held_out, table, text_or_empty, tidy

LETTERS, DIGITS, WORD = re.compile(r"[^\W\d_]+"), re.compile(r"\d+"), re.compile(r"\w+")
#: Slots that the names of features hash to.
WIDTH = 1 << 15
FOLDS = 3
ROWS_AT_ONCE = 1000


def _slot(name: str) -> int:
    return zlib.crc32(name.encode("utf-8", "surrogatepass")) % WIDTH


def _unit(values: dict[int, float]) -> tuple[np.ndarray, np.ndarray]:
    cols, vals = np.fromiter(values, np.int64, len(values)), np.fromiter(values.values(), float, len(values))
    size = math.sqrt(float(vals @ vals))
    return cols, vals / size if size else vals


def text_view(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Sparse unit vector of a text's shapes and words."""
    shapes = Counter(DIGITS.sub("9", LETTERS.sub("a", text)).split())
    n = max(1, sum(shapes.values()))
    out: dict[int, float] = Counter()
    for s, c in shapes.items():
        out[_slot("s" + s)] += math.sqrt(c / n)
    for w, c in Counter(WORD.findall(text.lower())).items():
        out[_slot("w" + w)] += 0.5 * math.sqrt(c / n)
    return _unit(out)


def metadata_view(lang: str | None, source: str | None, size: float | None) -> tuple[np.ndarray, np.ndarray]:
    """Sparse unit vector of a page's record; a null is a value of its own."""
    step = None if size is None or size != size else int(2 * math.log2(max(size, 0) + 1))
    names = [f"lang={lang}", f"source={source}", f"size={step}", f"lang={lang}&source={source}", f"lang={lang}&size={step}", f"source={source}&size={step}"]
    return _unit(dict.fromkeys(map(_slot, names), 1.0))


class Rows:
    """Sparse rows of one view."""

    def __init__(self, parts: list[tuple[np.ndarray, np.ndarray]]):
        self.n = len(parts)
        self.rows = np.repeat(np.arange(self.n), [len(c) for c, _ in parts])
        self.cols = np.concatenate([c for c, _ in parts]) if parts else np.zeros(0, np.int64)
        self.vals = np.concatenate([v for _, v in parts]) if parts else np.zeros(0)

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.rows, w[self.cols] * self.vals, self.n) if self.n else np.zeros(0)

    def fit(self, y: np.ndarray, weight: np.ndarray, steps: int = 120, rate: float = 0.2, l2: float = 1e-4) -> np.ndarray:
        """Weighted logistic regression by Adam; the last weight is the bias."""
        w, m, v = np.zeros(WIDTH + 1), np.zeros(WIDTH + 1), np.zeros(WIDTH + 1)
        mass = max(weight.sum(), 1e-9)
        used = weight[self.rows] > 0
        rows, cols, vals = self.rows[used], self.cols[used], self.vals[used]
        for k in range(1, steps + 1):
            g = np.bincount(rows, w[cols] * vals, self.n) + w[-1]
            e = weight * (0.5 * (1 + np.tanh(0.5 * g)) - y) / mass
            grad = np.append(np.bincount(cols, e[rows] * vals, WIDTH) + l2 * w[:-1], e.sum())
            m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
            w -= rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
        return w

    def odds(self, w: np.ndarray) -> np.ndarray:
        return self.dot(w[:-1]) + w[-1]


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """A few Newton steps of ridge logistic regression; x has a column of ones last."""
    w = np.zeros(x.shape[1])
    for _ in range(40):
        p = 0.5 * (1 + np.tanh(0.5 * np.clip(x @ w, -60, 60)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (p - y) + ridge * w)
        w -= step * min(1.0, 2.0 / (np.abs(step).max() + 1e-12))
    return w


def cotrain(views: tuple[Rows, Rows], y: np.ndarray, rounds: int, share: float) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Weights of both views, and the labels each was trained on at last; ``y`` is 1, 0 or -1 for the unlabelled pool."""
    known = [y.copy(), y.copy()]
    rate = float((y == 1).sum() / max(1, (y >= 0).sum()))
    batch = max(2, int(share * (y == -1).sum()))
    weights = [v.fit(np.maximum(k, 0), (k >= 0).astype(float)) for v, k in zip(views, known, strict=True)]
    for _ in range(rounds):
        for teacher in (0, 1):
            pupil = 1 - teacher
            odds = views[teacher].odds(weights[teacher])
            free = np.nonzero(known[pupil] == -1)[0]
            order = free[np.argsort(odds[free], kind="stable")]
            n1 = min(max(1, round(batch * rate)), len(order) // 2)
            n0 = min(max(1, batch - n1), len(order) // 2)
            low, high = order[:n0], order[len(order) - n1 :]
            known[pupil][low[odds[low] < -1]] = 0
            known[pupil][high[odds[high] > 1]] = 1
        # pseudo-labels weigh half of true ones
        weights = [v.fit(np.maximum(k, 0), np.where(y >= 0, 1.0, np.where(k >= 0, 0.5, 0.0))) for v, k in zip(views, known, strict=True)]
    return weights, known


@dataclass
class QualityModel:
    weights: list[np.ndarray]
    mix: np.ndarray

    def score_rows(self, texts, langs, sources, sizes) -> np.ndarray:
        views = Rows([text_view(t) for t in texts]), Rows([metadata_view(*x) for x in zip(langs, sources, sizes, strict=True)])
        x = np.column_stack([np.clip(v.odds(w), -20, 20) for v, w in zip(views, self.weights, strict=True)] + [np.ones(views[0].n)])
        return 0.5 * (1 + np.tanh(0.5 * (x @ self.mix)))

    def score(self, text: Column, lang: Column, source: Column, size: Column) -> Column:
        """Probability of good quality; a null text counts as empty, nulls of the others as values of their own."""
        model = self

        @F.pandas_udf("double")
        @tidy
        def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            for t, a, b, n in batches:
                parts = (slice(k, k + ROWS_AT_ONCE) for k in range(0, len(t), ROWS_AT_ONCE))
                yield pd.Series(np.concatenate([np.zeros(0), *(model.score_rows(t[k].tolist(), a[k].tolist(), b[k].tolist(), n[k].tolist()) for k in parts)]))

        return run(F.coalesce(text, F.lit("")), lang.cast("string"), source.cast("string"), size.cast("double"))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", size_col: str = "n_chars", label_col: str = "quality", max_labelled: int = 4_000, max_pool: int = 4_000, rounds: int = 4, share: float = 0.1, seed: int = 7) -> QualityModel:
    """Train outside the held-out fold.

    Null labels and ids are left out; an id with both labels counts as good;
    of rows that repeat an id the least (text, language, source, size) trains.
    Without labels of both classes every document scores the share of good labels
    (0.5 without any).
    """
    order = F.xxhash64(F.lit(seed), "k")
    good = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).alias("k")).agg(F.max(F.col(label_col).cast("int")).alias("y"))
    chosen = (
        good.orderBy(order, "k").limit(max_labelled)
        .union(docs.where(F.col(id_col).isNotNull() & ~held_out(id_col)).select(F.col(id_col).alias("k")).distinct().orderBy(F.xxhash64(F.lit(seed + 1), "k"), "k").limit(max_pool).select("k", F.lit(-1).alias("y")))
        .groupBy("k").agg(F.max("y").alias("y"))
    )

    def views(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            a, b = [text_view(t) for t in pdf["t"]], [metadata_view(*x) for x in zip(pdf["lang"], pdf["source"], pdf["size"], strict=True)]
            yield pd.DataFrame({"k": pdf["k"], "y": pdf["y"], "tc": [c for c, _ in a], "tv": [v for _, v in a], "mc": [c for c, _ in b], "mv": [v for _, v in b]})

    row = F.struct(text_or_empty(text_col).alias("t"), F.col(lang_col).cast("string").alias("lang"), F.col(source_col).cast("string").alias("source"), F.col(size_col).cast("double").alias("size"))
    one = docs.select(F.col(id_col).alias("k"), row.alias("row")).join(F.broadcast(chosen), "k").groupBy("k", "y").agg(F.min("row").alias("row")).select("k", "y", "row.*")
    kind = docs.schema[id_col].dataType.simpleString()
    got = one.mapInPandas(tidy(views), f"k {kind}, y int, tc array<long>, tv array<double>, mc array<long>, mv array<double>").toPandas().sort_values("k", kind="stable")
    y = got["y"].to_numpy()
    rate = float((y == 1).sum() / max(1, (y >= 0).sum())) if len(y) else 0.5
    if not (y == 1).any() or not (y == 0).any():
        rate = min(max(rate if (y >= 0).any() else 0.5, 1e-3), 1 - 1e-3)
        return QualityModel([np.zeros(WIDTH + 1)] * 2, np.array([0.0, 0.0, math.log(rate / (1 - rate))]))
    both = tuple(Rows([(np.asarray(c, np.int64), np.asarray(v)) for c, v in zip(got[f"{k}c"], got[f"{k}v"], strict=True)]) for k in "tm")
    fold = np.arange(len(y)) % FOLDS
    unseen = np.zeros((len(y), 2))
    for f in range(FOLDS):
        hidden = np.where(fold == f, -2, y)  # -2: neither labelled nor in the pool
        if (hidden == 1).any() and (hidden == 0).any():
            for k, w in enumerate(cotrain(both, hidden, rounds, share)[0]):
                unseen[fold == f, k] = both[k].odds(w)[fold == f]
    x = np.column_stack([np.clip(unseen, -20, 20), np.ones(len(y))])[y >= 0]
    # each view calibrated alone, then the two calibrated log odds combined
    slopes = [_logistic(x[:, [k, 2]], y[y >= 0].astype(float)) for k in (0, 1)]
    z = np.column_stack([x[:, [k, 2]] @ slopes[k] for k in (0, 1)] + [np.ones(len(x))])
    top = _logistic(z, y[y >= 0].astype(float))
    mix = np.array([top[0] * slopes[0][0], top[1] * slopes[1][0], top[2] + top[0] * slopes[0][1] + top[1] * slopes[1][1]])
    return QualityModel(cotrain(both, y, rounds, share)[0], mix)


def op7_cotraining_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality; the held-out labels were never seen."""
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", held_out().alias("held_out"), model.score(F.col("text"), F.col("lang"), F.col("source"), F.col("n_chars")).alias("score"))
    return scored.withColumn("kept", F.col("score") >= 0.5).withColumn("predicted", F.col("kept").cast("int"))
