"""Benchmark decontamination by a BM25 inverted index with block-max WAND.

The test items are the indexed documents, every passage of training text is a
query. Impacts (a term's BM25 weight in an item) are divided by the item's
score for itself, so one threshold suits items of any length: a passage that
holds the whole item scores 1. A term's postings (items in order, with their
impacts) stand in blocks of neighbouring items; the index has the largest
impact of each list and of each of its blocks.

A passage is answered in three steps; the first two for all passages of a
batch at once. Its lists are sorted by their upper bounds: the longest run of
least ones that stays below the threshold together can't lift an item over
it alone, so only blocks in which one of the other lists has postings are
visited at all, and passages without such lists are done. The largest impacts
of those lists in a block, with the sum of the run, bound what any item of the
block scores; the run's bounds are then replaced, the greatest first, by what
its lists have in the block, and a block that falls below the threshold is
skipped whole. In the blocks that are left cursors run over the postings: they are kept in order of their items,
the pivot is the first item at which the sum of block maxima reaches the
threshold, cursors before it skip to it, and an item is scored only where they
meet. Every passage at or above the threshold is retrieved, and is a leak if
the text around it also holds the item's question and answer (five-word
shingles, 0.8 or more).

Passages are windows of two half-windows; a half is as long as the longest
item, so each occurrence of an item lies whole in some window. Item count,
mean length, the half and document frequencies are those of the whole
benchmark, also where it is too large for one index.
"""

from __future__ import annotations

import math
import pickle
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheaf.llm._shared import ship, table, text_or_empty, tidy

WORD = re.compile(r"\w+")
K1, B = 1.2, 0.75
SHINGLE = 5
#: Words whose windows are bounded together; items of a block; item text of one index.
WORDS_AT_ONCE = 100_000
BLOCK_ITEMS = 4
#: Windows times blocks up to which sums go into a dense table.
MOST_CELLS = 1 << 21
MOST_INDEX_BYTES = 8 << 20
#: Bounds are sums in another order than scores.
SLACK = 1e-9


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def question_answer(text: str) -> tuple[list[str], list[str]]:
    """An item's words but those of its last sentence, and those of it; a single sentence is all question."""
    parts = [w for p in re.split(r"[.?!\n]+", text) if (w := words(p))]
    return (sum(parts[:-1], []), parts[-1]) if len(parts) > 1 else (sum(parts, []), [])


def shingles(ws: list[str]) -> set[tuple[str, ...]]:
    return {tuple(ws[i : i + SHINGLE]) for i in range(max(1, len(ws) - SHINGLE + 1))} if ws else set()


def held(part: list[str], around: list[str]) -> float:
    """Share of the shingles of ``part`` in ``around``; of a shorter part, whether it is there in one piece."""
    if not part:
        return 1.0
    n = min(SHINGLE, len(part))
    want = shingles(part)
    there = {tuple(around[i : i + n]) for i in range(len(around) - n + 1)}
    return len(want & there) / len(want)


@dataclass
class Statistics:
    """Of all items of a benchmark: how many, their mean and greatest length, and in how many each word stands."""

    items: int
    mean: float
    longest: int
    df: dict[str, int]

    @classmethod
    def of(cls, bags: list[list[str]]) -> Statistics:
        return cls(len(bags), sum(map(len, bags)) / max(1, len(bags)), max(map(len, bags), default=1), Counter(w for b in bags for w in set(b)))


def _sums(place: np.ndarray, value: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The places that occur, sorted, and the sum of the values at each."""
    if size <= MOST_CELLS:
        hit = np.bincount(place, minlength=size)
        there = np.nonzero(hit)[0]
        return there, np.bincount(place, value, size)[there].astype(float)  # of no places it makes integers
    there, inverse = np.unique(place, return_inverse=True)
    return there, np.bincount(inverse, value, len(there)).astype(float)


class Index:
    """Inverted index of the items: postings in blocks, with upper bounds of lists and blocks."""

    def __init__(self, items: list[tuple[int | None, str]], stats: Statistics | None = None, block_items: int = BLOCK_ITEMS):
        items = sorted(((i, t) for i, t in items if words(t or "")), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        self.ids, self.texts = [i for i, _ in items], [t for _, t in items]
        bags = [words(t) for t in self.texts]
        stats = stats or Statistics.of(bags)
        self.half = stats.longest
        self.term = {w: k for k, w in enumerate(sorted({w for b in bags for w in b}))}
        rows: list[tuple[int, int, float]] = []
        for n, bag in enumerate(bags):
            own = {w: math.log(1 + (stats.items - stats.df[w] + 0.5) / (stats.df[w] + 0.5)) * c * (K1 + 1) / (c + K1 * (1 - B + B * len(bag) / stats.mean)) for w, c in Counter(bag).items()}
            total = math.fsum(own.values())
            rows += [(self.term[w], n, x / total) for w, x in own.items()]
        rows.sort()
        term, self.item, self.impact = (np.array(c, kind) for c, kind in zip(zip(*rows, strict=True) if rows else ([], [], []), (np.int64, np.int64, float), strict=True))
        self.blocks = -(-len(items) // block_items)
        # one entry per list and block: its key, where its postings begin and end, and their largest impact
        key = term * max(1, self.blocks) + self.item // block_items
        self.start = np.nonzero(np.r_[True, key[1:] != key[:-1]])[0] if len(key) else np.zeros(0, np.int64)
        self.end = np.r_[self.start[1:], len(key)] if len(key) else self.start
        self.key = key[self.start]
        self.most = np.maximum.reduceat(self.impact, self.start) if len(key) else np.zeros(0)
        # entries of each list, and its upper bound
        self.first = np.searchsorted(self.key, np.arange(len(self.term) + 1) * max(1, self.blocks))
        self.bound = np.maximum.reduceat(self.most, self.first[:-1]) if len(key) else np.zeros(0)

    def retrieve(self, texts: list[str], threshold: float) -> Iterator[tuple[int, int, float, int, list[str]]]:
        """(text, item, score, first word of the window, the text's words) of all windows at or above the threshold.

        By text and item, those of the highest score first.
        """
        if not self.ids:
            return
        start = 0
        bags: list[list[str]] = []
        size = 0
        for k, t in enumerate(texts):
            bags.append(words(t))
            size += len(bags[-1])
            if size >= WORDS_AT_ONCE or k == len(texts) - 1:
                found = []
                begin = np.concatenate([[0], np.cumsum([max(1, -(-len(b) // self.half)) for b in bags])])
                for window, n, score in self._search(*self._windows(bags, begin), threshold):
                    i = int(np.searchsorted(begin, window, "right")) - 1
                    found.append((i, n, -score, int(window - begin[i]) * self.half))
                for i, n, score, word in sorted(found):
                    yield start + i, n, -score, word, bags[i]
                start, bags, size = k + 1, [], 0

    def _windows(self, bags: list[list[str]], begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sorted pairs (window, term), each once; a window begins with every half of a text and takes the next one too."""
        get = self.term.get
        term = np.fromiter((get(w, -1) for b in bags for w in b), np.int64)
        half = np.concatenate([begin[i] + np.arange(len(b)) // self.half for i, b in enumerate(bags)])
        term, half = term[term >= 0], half[term >= 0]
        inner = ~np.isin(half, begin)  # all but the first halves also end a window
        pair = np.unique(np.r_[half * len(self.term) + term, (half[inner] - 1) * len(self.term) + term[inner]])
        return pair // len(self.term), pair % len(self.term)

    def _search(self, window: np.ndarray, term: np.ndarray, threshold: float) -> Iterator[tuple[int, int, float]]:
        """(window, item, score) at or above the threshold."""
        if not len(window):
            return
        low = threshold - SLACK
        bound = self.bound[term]
        order = np.lexsort((bound, window))
        window, term, bound = window[order], term[order], bound[order]
        first = np.nonzero(np.r_[True, window[1:] != window[:-1]])[0]
        times = np.diff(np.r_[first, len(window)])
        total = np.cumsum(bound)
        total -= np.repeat(total[first] - bound[first], times)
        needed = total >= low  # of each window the lists after the run of least bounds
        skipped = times - np.add.reduceat(needed, first)  # lists of the run, and their sum
        run = np.maximum.reduceat(np.where(needed, 0.0, total), first)
        # entries of the needed lists, summed by window and block
        t, of = term[needed], np.repeat(np.arange(len(first)), times)[needed]
        size = self.first[t + 1] - self.first[t]
        entry = np.repeat(self.first[t] - np.cumsum(size) + size, size) + np.arange(size.sum())
        spot, most = _sums(np.repeat(of, size) * self.blocks + self.key[entry] % self.blocks, self.most[entry], len(first) * self.blocks)
        w, block = spot // self.blocks, spot % self.blocks
        most += run[w]
        # what the lists of the run have in the block instead of their bounds, the greatest first
        step = 0
        while True:
            live = most >= low
            w, block, most = w[live], block[live], most[live]
            open_ = np.nonzero(step < skipped[w])[0]
            if not len(open_):
                break
            row = first[w[open_]] + skipped[w[open_]] - 1 - step
            most[open_] += self._block_most(term[row], block[open_]) - bound[row]
            step += 1
        for k, b in zip(w.tolist(), block.tolist(), strict=True):
            terms = np.sort(term[first[k] : first[k] + times[k]])  # by term, so that sums don't depend on bounds
            at = self._entries(terms, np.full(len(terms), b))
            for n, score in self._wand(at[at >= 0], threshold):
                yield int(window[first[k]]), n, score

    def _entries(self, term: np.ndarray, block: np.ndarray) -> np.ndarray:
        """Entry of each list and block, -1 where the list has no postings there."""
        want = term * self.blocks + block
        at = np.minimum(np.searchsorted(self.key, want), len(self.key) - 1)
        return np.where(self.key[at] == want, at, -1)

    def _block_most(self, term: np.ndarray, block: np.ndarray) -> np.ndarray:
        at = self._entries(term, block)
        return np.where(at >= 0, self.most[at], 0.0)

    def _wand(self, entries: np.ndarray, threshold: float) -> Iterator[tuple[int, float]]:
        """(item, score) at or above the threshold, over the postings of some entries of one block."""
        lists = [(self.item[a:b].tolist(), self.impact[a:b].tolist(), m) for a, b, m in zip(self.start[entries], self.end[entries], self.most[entries].tolist(), strict=True)]
        cursors = [(items[0], k, 0) for k, (items, _, _) in enumerate(lists)]  # (item, list, position)
        while cursors:
            cursors.sort()
            sum_ = 0.0
            pivot = None
            for item, k, _ in cursors:
                sum_ += lists[k][2]
                if sum_ >= threshold - SLACK:
                    pivot = item
                    break
            if pivot is None:
                return
            meet = [c for c in cursors if c[0] == pivot]
            if cursors[0][0] == pivot:
                score = math.fsum(lists[k][1][at] for _, k, at in meet)
                if score >= threshold:
                    yield pivot, score
                moved = {k: at + 1 for _, k, at in meet}
            else:
                moved = {k: bisect_left(lists[k][0], pivot, at) for item, k, at in cursors if item < pivot}
            cursors = [c for c in cursors if c[1] not in moved] + [(lists[k][0][at], k, at) for k, at in moved.items() if at < len(lists[k][0])]

    def leaks(self, texts: list[str], threshold: float, overlap: float) -> Iterator[tuple[int, int | None, float, int, float, float]]:
        """(text, item id, score, first word, question overlap, answer overlap) of verified pairs, of each the first window that is verified."""
        done = None
        for k, n, score, word, bag in self.retrieve(texts, threshold):
            if (k, n) == done:
                continue
            around = bag[max(0, word - self.half) : word + 3 * self.half]
            parts = _parts(self.texts[n])
            question, answer = (held(p, around) for p in parts)
            if question >= overlap and answer >= overlap or held(parts[0] + parts[1], around) >= overlap:
                done = (k, n)
                yield k, self.ids[n], score, word, question, answer


@lru_cache(maxsize=256)
def _parts(text: str) -> tuple[list[str], list[str]]:
    return question_answer(text)


def build_indexes(benchmark: DataFrame, max_index_bytes: int = MOST_INDEX_BYTES, id_col: str = "item_id", text_col: str = "text") -> Iterator[Index]:
    """Indexes of about ``max_index_bytes`` of item text each, with the statistics of the whole benchmark."""
    items = benchmark.select(F.col(id_col).cast("long").alias("i"), text_or_empty(text_col).alias("t")).dropDuplicates(["i", "t"])
    slices = -(-(items.agg(F.sum(F.octet_length("t"))).first()[0] or 0) // max_index_bytes) or 1
    if slices == 1:
        yield Index([(r["i"], r["t"]) for r in items.collect()])
        return

    def bags(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [words(t) for t in pdf["t"]]
            yield pd.DataFrame({"part": pdf["part"], "n": [len(b) for b in found], "ws": [sorted(set(b)) for b in found]})

    items = items.withColumn("part", F.pmod(F.xxhash64("t"), F.lit(slices)))
    bag = items.mapInPandas(tidy(bags), "part long, n long, ws array<string>").where("n > 0")
    count, mean, longest = bag.agg(F.count(F.lit(1)), F.avg("n"), F.max("n")).first()
    held_by = bag.select("part", F.explode("ws").alias("w"))
    df = held_by.groupBy("w").agg(F.count(F.lit(1)).alias("df"))
    for k in range(slices):
        own = {r["w"]: r["df"] for r in df.join(held_by.where(F.col("part") == k).select("w").distinct(), "w").collect()}
        yield Index([(r["i"], r["t"]) for r in items.where(F.col("part") == k).select("i", "t").collect()], Statistics(count or 0, mean or 1.0, longest or 1, own))


def _ship(spark: SparkSession, benchmark: DataFrame, max_index_bytes: int) -> list[str]:
    """The indexes as files on the executors."""
    return [ship(spark, pickle.dumps(index), "bm25") for index in build_indexes(benchmark, max_index_bytes)]


class _Opened:
    """The shipped indexes in turn; a single one is read once a task, of several only one is held at a time."""

    def __init__(self, names: list[str]):
        self.names, self.one = names, None

    def __iter__(self) -> Iterator[Index]:
        for name in self.names:
            if self.one is not None:
                yield self.one
                continue
            with open(SparkFiles.get(name), "rb") as f:
                index = pickle.load(f)
            if len(self.names) == 1:
                self.one = index
            yield index


def find_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.5, overlap: float = 0.8, id_col: str = "doc_id", text_col: str = "text", max_index_bytes: int = MOST_INDEX_BYTES) -> DataFrame:
    """One row per (document, item) that leaks: doc_id, item_id, score, first_word, question_overlap, answer_overlap.

    One pass over the documents, however many indexes the items take. Null or
    empty texts and items without words leak nothing; items with a null id
    count like others, and their item_id is null; items that repeat an id with
    another text are items of their own; repeated rows of documents give
    repeated results; other columns aren't read; empty tables give no rows.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, item_id long, score double, first_word long, question_overlap double, answer_overlap double"
    names = _ship(docs.sparkSession, benchmark, max_index_bytes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        indexes = _Opened(names)
        for pdf in batches:
            texts = pdf["t"].tolist()
            found = [f for index in indexes for f in index.leaks(texts, threshold, overlap)]
            keys = pdf["doc_id"].array.take([f[0] for f in found])
            cols = list(zip(*found, strict=True))[1:] if found else [[]] * 5
            out = pd.DataFrame({"doc_id": keys, **dict(zip(("item_id", "score", "first_word", "question_overlap", "answer_overlap"), map(list, cols), strict=True))})
            yield out.assign(item_id=pd.array(list(cols[0]), dtype="Int64"))

    return docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("t")).mapInPandas(tidy(run), schema)


def drop_leaking(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.5, overlap: float = 0.8, text_col: str = "text", max_index_bytes: int = MOST_INDEX_BYTES) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, all columns kept."""
    names = _ship(docs.sparkSession, benchmark, max_index_bytes)

    @F.pandas_udf(T.BooleanType())
    @tidy
    def leaks(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        indexes = _Opened(names)
        for batch in batches:
            texts = batch.tolist()
            hit = np.zeros(len(texts), bool)
            for index in indexes:
                for k, *_ in index.leaks(texts, threshold, overlap):
                    hit[k] = True
            yield pd.Series(hit)

    return docs.where(~leaks(F.coalesce(F.col(text_col), F.lit(""))))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all benchmark items."""
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
