"""Near-duplicate texts by Order MinHash, confirmed by banded alignment.

A text is the sequence of its five-word k-mers. Each k-mer is labelled with
its occurrence number, so a repeated one counts as often as it stands there.
A sketch samples, under each of ``tables`` hash functions, the ``minima``
labelled k-mers of least hash and keeps them in text order; two texts share a
bucket of a table if those short sequences are equal, which needs the same
k-mers in the same order. That makes the sketch sensitive to edit similarity
and not just to shared vocabulary (Marcais et al., 2019).

Two texts are near duplicates if their words align and enough k-mers are
shared: s = L / max(n, m) is 0.8 or more for texts of n and m words with a
longest common subsequence of L words, and the Jaccard index of their labelled
k-mers is 0.5 or more. Repeated words and k-mers count as often as they stand
there, so a text isn't like itself written twice. The alignment measures
likeness by edits: a copy with one word in ten changed keeps s = 0.9, while
its five-word shingles fall to a Jaccard index near 0.5, which is as far as
the sketch reaches. L >= s max(n, m) bounds how far off the diagonal an
alignment can go, so only that band is searched, by bit-parallel rows.

Texts with equal word sequences are one class from the start. Members of a
bucket are compared with three representatives of the bucket (least and
greatest under one hash order, least under another that differs by table),
never all with all: the comparisons of a bucket grow linearly with it. Buckets
of up to three texts are compared in full. Links close into components;
then, in further rounds, members of a bucket that spans several components are
compared with the bucket's hubs in other components (the member with most
links, and the one most alike to what it links with), which joins most groups
cheaply. What is left is exact: the members of every bucket of more than three
texts that still spans components meet in one task, which counts the labelled
k-mers and words that each shares with the others; members of the
bucket's largest component needn't meet each other. Only pairs with k-mers and
words enough in common (bounds that no near duplicate fails) leave the task,
each from its first bucket, and are aligned. Large buckets come in parts, each
pair of which is a task's work, so memory is bounded. No pair of different
components that shares a bucket is left out.

A text class is known by the number it got when its table was written, its
place in hash orders by the digest of its words: neither depends on ids, which
may repeat or be of any type that has an order.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.llm._shared import Scratch, spread_join, table, task_cache, text_or_empty, tidy
from sheaf.llm.components import components

WORD = re.compile(r"\w+")
K = 5
TABLES, MINIMA = 24, 3
#: Least part of the words that align, and least Jaccard index of the k-mers.
SIMILARITY, OVERLAP = 0.8, 0.5
#: Bins of the one-permutation sketch that sorts out hopeless candidates.
BINS = 256
_MIX1, _MIX2, _STEP = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(0x9E3779B97F4A7C15)
#: Words of a part of a large bucket that spans components; slots that labelled k-mers and words are counted by there:
#: two may share one, which costs candidates but no link.
WORDS_TO_MEET = 1_000_000
SLOTS = 1 << 20
#: Labelled k-mers times tables that are hashed at once; texts whose sketches are handed on together;
#: words of aligned texts that a task remembers.
CELLS_AT_ONCE = 1 << 18
ROWS_AT_ONCE = 1000
WORDS_KEPT = 2_000_000


class _WordHash(dict):
    """Digest of each word met, forgotten when too many."""

    def __missing__(self, word: str) -> int:
        if len(self) > 100_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_HASH = task_cache(_WordHash())


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _MIX1
    x = (x ^ (x >> np.uint64(29))) * _MIX2
    return x ^ (x >> np.uint64(32))


def digests(words: list[str]) -> np.ndarray:
    return np.fromiter(map(_HASH.__getitem__, words), np.uint64, len(words))


def kmers(h: np.ndarray) -> np.ndarray:
    """Digest of every k-mer in text order, given its words'; of a shorter text, one of all its words."""
    if not len(h):
        return np.zeros(0, np.uint64)
    n = max(1, len(h) - K + 1)
    out = np.zeros(n, np.uint64)
    for i in range(min(K, len(h))):
        out = _mix(out * _STEP + h[i : i + n])
    return out


def occurrences(x: np.ndarray) -> np.ndarray:
    """How often each element stood before."""
    order = np.argsort(x, kind="stable")
    s = x[order]
    new = np.r_[True, s[1:] != s[:-1]]
    if new.all():
        return np.zeros(len(x), np.uint64)
    first = np.maximum.accumulate(np.where(new, np.arange(len(x)), 0))
    out = np.empty(len(x), np.uint64)
    out[order] = np.arange(len(x)) - first
    return out


def labelled(x: np.ndarray) -> np.ndarray:
    """The k-mers with their occurrence numbers mixed in: no two are equal."""
    return _mix(x + occurrences(x) * _STEP)


def sketch(x: np.ndarray, tables: int = TABLES, minima: int = MINIMA) -> np.ndarray:
    """One bucket key per table."""
    if not len(x):
        return np.zeros(0, np.int64)
    own = labelled(x)
    keys = np.empty(tables, np.uint64)
    few = min(minima, len(x))
    at_once = max(1, CELLS_AT_ONCE // len(x))
    for a in range(0, tables, at_once):
        seeds = (np.arange(a + 1, min(tables, a + at_once) + 1, dtype=np.uint64) * _STEP)[:, None]
        h = (own[None, :] ^ seeds) * _MIX1
        h ^= h >> np.uint64(31)
        h *= _MIX2
        at = np.argpartition(h, few - 1, axis=1)[:, :few] if few < len(x) else np.tile(np.arange(len(x)), (len(seeds), 1))
        at.sort(axis=1)  # text order
        key = seeds[:, 0]
        for i in range(few):
            key = _mix(key * _STEP + x[at[:, i]])
        keys[a : a + len(seeds)] = key
    return keys.view(np.int64)


def signature(x: np.ndarray) -> bytes:
    """One-permutation sketch: per bin of the labelled k-mers one byte of the least; 0 for an empty bin."""
    out = np.zeros(BINS, np.uint8)
    if len(x):
        h = np.sort(_mix(labelled(x) ^ _STEP))
        bins = (h >> np.uint64(56)).astype(np.int64)
        first = np.r_[True, bins[1:] != bins[:-1]]
        out[bins[first]] = (h[first] % np.uint64(255)).astype(np.uint8) + 1
    return out.tobytes()


def hopeful(a: list[bytes], b: list[bytes], overlap: float) -> np.ndarray:
    """False where the sketches are four standard errors below ``overlap``."""
    if not a:
        return np.zeros(0, bool)
    x, y = (np.frombuffer(b"".join(s), np.uint8).reshape(-1, BINS) for s in (a, b))
    used = ((x > 0) | (y > 0)).sum(axis=1)
    equal = ((x == y) & (x > 0)).sum(axis=1)
    error = np.sqrt(overlap * (1 - overlap) / np.maximum(used, 1))
    return equal >= (overlap - 4 * error) * used


def common_subsequence(a: np.ndarray, b: np.ndarray, band: int) -> int:
    """Length of the longest common subsequence that stays within ``band`` of the diagonal."""
    n, m = len(a), len(b)
    short = min(n, m)
    differ = np.nonzero(a[:short] != b[:short])[0]
    head = int(differ[0]) if len(differ) else short
    differ = np.nonzero(a[n - short + head :][::-1] != b[m - short + head :][::-1])[0]
    tail = int(differ[0]) if len(differ) else short - head
    a, b = a[head : n - tail].tolist(), b[head : m - tail].tolist()
    found, n = head + tail, len(a)
    if not n or not b:
        return found
    # rows of bits, one per position of a; a zero marks a step of the common subsequence
    places: dict[int, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    live, base, width = (1 << n) - 1, 0, n
    for j, x in enumerate(b):
        low = j - band
        if low - base >= 4096:  # positions that left the band won't change any more
            cut = min(low - base, width)
            found += cut - (live & ((1 << cut) - 1)).bit_count()
            live >>= cut
            base, width = base + cut, width - cut
            if not width:
                return found
        hits = places.get(x, 0)
        if not hits:
            continue
        hits >>= base
        if low > base:
            hits = hits >> (low - base) << (low - base)
        hits &= (1 << max(0, j + band + 1 - base)) - 1
        both = live & hits
        live = ((live + both) | (live & ~hits)) & ((1 << width) - 1)
    return found + width - live.bit_count()


def similarity_of(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY, overlap: float = OVERLAP) -> float:
    """Part of the words (digests) that align if it is ``least`` or more and the k-mers overlap enough, else 0."""
    n, m = len(a), len(b)
    longer = max(n, m)
    if not n or not m or min(n, m) < least * longer:
        return 0.0
    x, y = labelled(kmers(a)), labelled(kmers(b))
    both = len(np.intersect1d(x, y, assume_unique=True))
    if both < overlap * (len(x) + len(y) - both) - 1e-9:
        return 0.0
    need = math.ceil(least * longer - 1e-9)
    common = common_subsequence(a, b, n + m - 2 * need)
    return common / longer if common >= need else 0.0


def _words(text: str) -> np.ndarray:
    return digests(WORD.findall(text.lower()))


def sketches(docs: DataFrame, id_col: str, text_col: str, tables: int = TABLES, minima: int = MINIMA) -> DataFrame:
    """(doc, row, d1, d2, n, sig, keys) of every row: digest of its text and of its words, number of words, both sketches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), ROWS_AT_ONCE):
                part = pdf.iloc[at : at + ROWS_AT_ONCE]
                rows = []
                for t in part["t"]:
                    words = WORD.findall(t.lower())
                    x = kmers(digests(words))
                    d = xxhash.xxh3_128_digest(" ".join(words))
                    rows.append((int.from_bytes(d[:8], signed=True), int.from_bytes(d[8:], signed=True), len(words), signature(x), sketch(x, tables, minima)))
                out = pd.DataFrame(rows, columns=["d1", "d2", "n", "sig", "keys"])
                out.insert(0, "row", part["row"].to_numpy())
                out.insert(0, "doc", part["doc"].array)
                yield out

    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("doc"), F.xxhash64(text_col).alias("row"), text_or_empty(text_col).alias("t"))
    return source.mapInPandas(tidy(run), f"doc {kind}, row long, d1 long, d2 long, n int, sig binary, keys array<long>")


def verified(pairs: DataFrame, texts: DataFrame, similarity: float, overlap: float, scratch: Scratch) -> DataFrame:
    """(a, b, similarity) of the pairs (a, b) that are near duplicates; both are written tables.

    ``texts``: (id, text) or (id, text, sig); sketches come with the texts, so
    that a pair is joined once, and sort out the hopeless ones before any work.
    """
    one, two = (texts.select(F.col("id").alias(end), *[F.col(c).alias(f"{c}_{end}") for c in texts.columns if c != "id"]) for end in ("a", "b"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[int, np.ndarray] = {}
        size = 0
        for pdf in batches:
            if "sig_a" in pdf:
                pdf = pdf[hopeful(pdf["sig_a"].tolist(), pdf["sig_b"].tolist(), overlap)]
            s = []
            for a, b, ta, tb in zip(pdf["a"], pdf["b"], pdf["text_a"], pdf["text_b"], strict=True):
                if size > WORDS_KEPT:
                    known.clear()
                    size = 0
                for k, t in ((a, ta), (b, tb)):
                    if k not in known:
                        known[k] = _words(t)
                        size += len(known[k])
                s.append(similarity_of(known[a], known[b], similarity, overlap))
            out = pd.DataFrame({"a": pdf["a"], "b": pdf["b"], "similarity": np.array(s, float)})
            yield out[out["similarity"] > 0]

    left = spread_join(pairs.select("a", "b"), one, ["a"], "b", scratch)
    return left.join(two, "b").mapInPandas(tidy(run), "a long, b long, similarity double")


def _slots(x: np.ndarray) -> np.ndarray:
    """Places of the elements in a table of marks: two texts have no fewer of these in common than elements."""
    return (x % np.uint64(SLOTS)).astype(np.uint32)


class _Cell:
    """Members of a bucket, or of two parts of a large one, with the slots of their labelled k-mers and words."""

    def __init__(self, part: list[int], ids: list[int], component: list[int], xs: list[bytes], ws: list[bytes], keys: list[bytes]):
        self.part, self.ids = np.array(part), np.array(ids)
        self.component = np.unique(component, return_inverse=True)[1]
        self.kmers, self.words = ([np.frombuffer(x, np.uint32) for x in c] for c in (xs, ws))
        self.size, self.n = (np.fromiter(map(len, c), np.int64, len(c)) for c in (self.kmers, self.words))
        self.keys = np.array([np.frombuffer(k, np.int64) for k in keys])
        self.marks = np.zeros(SLOTS, np.int8)

    def _common(self, sets: list[np.ndarray], q: int, some: np.ndarray) -> np.ndarray:
        """How many of the elements of each of ``some`` are among those of ``q``, at least."""
        self.marks[sets[q]] = 1
        lengths = np.fromiter((len(sets[k]) for k in some), np.int64, len(some))
        out = np.add.reduceat(self.marks[np.concatenate([sets[k] for k in some])], np.cumsum(lengths) - lengths, dtype=np.int64)
        self.marks[sets[q]] = 0
        return out

    def pairs(self, t: int, similarity: float, overlap: float) -> Iterator[tuple[int, int]]:
        """Pairs of different components (and parts, if there are two) that may have enough k-mers and words in common.

        Members of the largest component needn't meet each other, so only the
        others look for partners. What shares an earlier bucket was met there.
        """
        others = self.component != np.bincount(self.component).argmax()
        place = np.arange(len(self.ids))
        two = self.part.min() != self.part.max()
        for q in np.nonzero(others)[0].tolist():
            fits = (self.component != self.component[q]) & (~others | (place > q)) & (np.minimum(self.n, self.n[q]) >= similarity * np.maximum(self.n, self.n[q]) - 1e-9)
            if two:
                fits &= self.part != self.part[q]
            some = np.nonzero(fits)[0]
            before = self.keys[q, :t]
            some = some[~((self.keys[some, :t] == before) & (before != 0)).any(axis=1)]
            if len(some):
                both = self._common(self.kmers, q, some)
                some = some[both >= overlap * (self.size[some] + self.size[q] - both) - 1e-9]
            if len(some):
                some = some[self._common(self.words, q, some) >= similarity * np.maximum(self.n[some], self.n[q]) - 1e-9]
            for k in some.tolist():
                yield min(self.ids[q], self.ids[k]), max(self.ids[q], self.ids[k])


def meetings(texts: DataFrame, tables: int, similarity: float, overlap: float) -> DataFrame:
    """(a, b), a < b: the pairs of different components that share an open bucket, enough k-mers and enough words.

    ``texts``: (id, component, text, open), a written table; ``open`` has
    (t, key, parts) of the text's buckets that span components. A bucket of
    many words comes in parts, each pair of which is a cell of its own.
    """

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), ROWS_AT_ONCE // 10):
                rows = []
                for i, component, text, buckets in pdf.iloc[at : at + ROWS_AT_ONCE // 10][["id", "component", "text", "open"]].itertuples(index=False):
                    h = _words(text)
                    x, w = _slots(labelled(kmers(h))).tobytes(), _slots(labelled(h)).tobytes()
                    keys = np.zeros(tables, np.int64)
                    for b in buckets:
                        keys[b["t"]] = b["key"]
                    for b in buckets:
                        own = int(_mix(np.array([i], np.int64).view(np.uint64))[0] % np.uint64(b["parts"]))
                        rows += [(b["t"], b["key"], min(own, k), max(own, k), own, i, component, x, w, keys.tobytes()) for k in range(b["parts"])]
                yield pd.DataFrame(rows, columns=["t", "key", "i", "j", "part", "id", "component", "x", "w", "keys"])

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cell, held = None, []

        def found() -> pd.DataFrame:
            part, component = [r[4] for r in held], [r[6] for r in held]
            if min(component) == max(component) or cell[2] < cell[3] and min(part) == max(part):
                return pd.DataFrame({"a": [], "b": []}, dtype=np.int64)
            return pd.DataFrame(_Cell(part, [r[5] for r in held], component, *zip(*(r[7:] for r in held), strict=True)).pairs(cell[0], similarity, overlap), columns=["a", "b"], dtype=np.int64)

        for pdf in batches:
            for r in pdf.itertuples(index=False, name=None):
                if r[:4] != cell:
                    if held:
                        yield found()
                    cell, held = r[:4], []
                held.append(r)
        if held:
            yield found()

    cells = texts.mapInPandas(tidy(place), "t int, key long, i int, j int, part int, id long, component long, x binary, w binary, keys binary")
    cells = cells.repartition("t", "key", "i", "j").sortWithinPartitions("t", "key", "i", "j")
    return cells.mapInPandas(tidy(meet), "a long, b long").distinct()


def near_duplicates(
    docs: DataFrame,
    similarity: float = SIMILARITY,
    id_col: str = "doc_id",
    text_col: str = "text",
    tables: int = TABLES,
    minima: int = MINIMA,
    rounds: int = 3,
    overlap: float = OVERLAP,
) -> tuple[DataFrame, DataFrame]:
    """Membership (doc_id, class_id, text_class, kept) per row, and links (a, b, similarity) of text classes' doc_ids.

    ``class_id`` is the least doc_id of all texts reachable by links,
    ``text_class`` the least one with the same words. ``kept`` marks the class's
    first row: least id, of equal ids the least digest of the text. Case and
    anything but word characters don't count. Null texts are empty; texts
    without words are one class; texts of fewer than five words link only with
    equal ones. A row with a null id is a class of its own (class_id null) and
    kept. Rows that repeat an id each belong to their own text's class; rows
    that repeat id and text are marked alike. An empty table gives no rows.
    ``rounds`` (of comparisons with hubs) only decides how much is left for
    the exact step.
    """
    members, links, _ = _near_duplicates(docs, similarity, id_col, text_col, tables, minima, rounds, overlap)
    return members.select("doc_id", "class_id", "text_class", "kept"), links


def _near_duplicates(docs: DataFrame, similarity: float, id_col: str, text_col: str, tables: int = TABLES, minima: int = MINIMA, rounds: int = 3, overlap: float = OVERLAP) -> tuple[DataFrame, DataFrame, Scratch]:
    spark = docs.sparkSession
    scratch = Scratch(spark, "near")
    rows = scratch.keep(sketches(docs, id_col, text_col, tables, minima), "sketches")
    classes = scratch.keep(
        rows.where(F.col("doc").isNotNull())
        .groupBy("d1", "d2").agg(F.min(F.struct("doc", "row")).alias("first"), F.first("n").alias("n"), F.first("sig").alias("sig"), F.first("keys").alias("keys"))
        .withColumn("id", F.monotonically_increasing_id()), "classes"
    )
    buckets = classes.select("id", "d1", "n", F.posexplode("keys").alias("t", "key"))
    # two representatives by an order that all tables share, so that a group meets the same ones, and one by the table's own
    shared_order, own_order = (F.struct(h.alias("h"), "id", "n") for h in (F.xxhash64(F.lit(11), "d1"), F.xxhash64(F.lit(12), "t", "d1")))
    shared = (
        buckets.groupBy("t", "key")
        .agg(F.count(F.lit(1)).alias("size"), F.min(shared_order).alias("r0"), F.max(shared_order).alias("r1"), F.min(own_order).alias("r2"))
        .where("size > 1")
    )
    reps = F.array_distinct(F.transform(F.array("r0", "r1", "r2"), lambda r: F.struct(r["id"].alias("id"), r["n"].alias("n"))))
    met = scratch.keep(buckets.drop("d1").join(shared.select("t", "key", reps.alias("reps")), ["t", "key"]), "met")
    small, large = F.least("n", "m"), F.greatest("n", "m")
    tried = scratch.keep(
        met.select("id", "n", F.explode("reps").alias("r")).select("id", "n", F.col("r.id").alias("other"), F.col("r.n").alias("m"))
        .where((F.col("id") != F.col("other")) & (small >= similarity * large))
        .select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct(), "tried0"
    )
    # texts of the classes that share a bucket with another, once
    involved = classes.join(met.select("id").distinct(), "id", "left_semi").select("id", "sig", F.col("first.doc").alias("doc"), F.col("first.row").alias("row"))
    source = docs.select(F.col(id_col).alias("doc"), F.xxhash64(text_col).alias("row"), text_or_empty(text_col).alias("text"))
    texts = scratch.keep(source.join(involved, ["doc", "row"]).select("id", "text", "sig").dropDuplicates(["id"]), "texts")

    def links_of(pairs: DataFrame, tag: str) -> DataFrame:
        return scratch.keep(verified(pairs, texts, similarity, overlap, scratch), tag)

    def groups_of(links: DataFrame, tag: str) -> DataFrame:
        return scratch.keep(components(links.select(F.col("a").alias("u"), F.col("b").alias("v")), scratch, f"cc_{tag}_"), f"groups_{tag}")

    links = links_of(tried, "links0")
    groups = groups_of(links, "0")
    for k in range(1, rounds + 1):
        ends = links.select(F.col("a").alias("id"), "similarity").union(links.select(F.col("b").alias("id"), "similarity"))
        ends = ends.groupBy("id").agg(F.count(F.lit(1)).alias("degree"), F.avg("similarity").alias("mean"))
        state = (
            classes.select("id").join(ends, "id", "left").join(groups, F.col("id") == F.col("node"), "left")
            .select("id", F.coalesce("degree", F.lit(0)).alias("degree"), F.when(F.col("degree") >= 3, F.col("mean")).otherwise(F.lit(0.0)).alias("mean"), F.coalesce("component", "id").alias("component"))
        )
        placed = scratch.keep(met.select("t", "key", "id", "n").join(state, "id"), f"placed{k}")
        # the hubs of each bucket that spans components: the member with most links, and the one that is most alike to its own
        hubs = (
            placed.groupBy("t", "key")
            .agg(F.max(F.struct("degree", "id", "n", "component")).alias("h0"), F.max(F.struct("mean", "id", "n", "component")).alias("h1"), F.min("component").alias("lo"), F.max("component").alias("hi"))
            .where("lo <> hi")
            .select("t", "key", F.array(*[F.struct(f"{h}.id", f"{h}.n", f"{h}.component") for h in ("h0", "h1")]).alias("hubs"))
        )
        # sorted out before the explode: most members are in the hubs' own component, and no row is made for those
        apart = F.filter("hubs", lambda h: (h["component"] != F.col("component")) & (F.least("n", h["n"]) >= similarity * F.greatest("n", h["n"])))
        fresh = (
            spread_join(placed, hubs, ["t", "key"], "id", scratch).select("id", F.explode(apart).alias("hub"))
            .select(F.least("id", "hub.id").alias("a"), F.greatest("id", "hub.id").alias("b")).distinct()
        )
        fresh = scratch.keep(fresh.join(tried, ["a", "b"], "left_anti"), f"fresh{k}")
        scratch.drop(f"placed{k}")
        new = links_of(fresh, f"links{k}")
        if new.isEmpty():
            break
        tried = scratch.keep(tried.union(fresh), f"tried{k}")
        links = links.union(new)
        groups = groups_of(links, str(k))
    # buckets of up to three texts were compared in full; of larger ones, pairs between components may be left
    state = classes.select("id").join(groups, F.col("id") == F.col("node"), "left").select("id", F.coalesce("component", "id").alias("component"))
    open_ends = scratch.keep(met.select("t", "key", "id", "n").join(state, "id"), "ends")
    spans = open_ends.groupBy("t", "key").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("words"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("size > 3 and lo <> hi")
    spans = spans.select("t", "key", F.ceil(F.col("words") / WORDS_TO_MEET).cast("int").alias("parts"))
    rest = spread_join(open_ends, spans, ["t", "key"], "id", scratch).groupBy("id", "component").agg(F.collect_list(F.struct("t", "key", "parts")).alias("open"))
    texts = texts.drop("sig")  # pairs of the exact step were counted
    rest = scratch.keep(texts.join(rest, "id"), "rest")
    left = scratch.keep(meetings(rest, tables, similarity, overlap).join(tried, ["a", "b"], "left_anti"), "left")
    new = scratch.keep(verified(left, texts, similarity, overlap, scratch), "links_left")
    if not new.isEmpty():
        links = links.union(new)
        groups = groups_of(links, "left")
    for tag in ("met", "ends", "rest", "texts"):
        scratch.drop(tag)
    placed = classes.select("id", "d1", "d2", "first").join(groups, F.col("id") == F.col("node"), "left").select("d1", "d2", "id", "first", "component")
    heads = placed.where(F.col("component").isNotNull()).groupBy("component").agg(F.min("first").alias("head"))
    by_class = placed.join(heads, "component", "left").select("d1", "d2", F.col("first.doc").alias("text_class"), F.coalesce("head", "first").alias("head"))
    by_class = scratch.keep(by_class, "by_class")
    named = F.col("doc").isNotNull()
    members = spread_join(rows.select("doc", "row", "d1", "d2"), by_class, ["d1", "d2"], "doc", scratch, "left").select(
        F.col("doc").alias("doc_id"), F.when(named, F.col("head.doc")).alias("class_id"), F.when(named, F.col("text_class")).alias("text_class"),
        (~named | (F.struct("doc", "row") == F.col("head"))).alias("kept"), "row",
    )
    names = classes.select("id", F.col("first.doc").alias("doc"))
    named_links = links.join(names.select(F.col("id").alias("a"), F.col("doc").alias("da")), "a").join(names.select(F.col("id").alias("b"), F.col("doc").alias("db")), "b")
    return members, named_links.select(F.least("da", "db").alias("a"), F.greatest("da", "db").alias("b"), "similarity"), scratch


def op2_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: class, text class and whether the document stays."""
    return near_duplicates(table(spark, sf_dir, "documents"))[0]


def keep_one(docs: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of near duplicates (the class's first), all columns kept.

    Rows with a null id stay. Of rows that agree in id and text one stays,
    whichever; rows that only share an id are judged by their texts.
    """
    members, _, scratch = _near_duplicates(docs, similarity, id_col, text_col)
    names = ("_sheaf_doc", "_sheaf_row")
    kept = members.where("kept and doc_id is not null").groupBy(F.col("doc_id").alias(names[0]), F.col("row").alias(names[1])).agg(F.count(F.lit(1)).alias("_sheaf_n"))
    kept = scratch.keep(kept, "kept")

    def of(keys: DataFrame) -> DataFrame:
        return docs.join(keys, (docs[f"`{id_col}`"] == keys[names[0]]) & (F.xxhash64(docs[f"`{text_col}`"]) == keys[names[1]]), "left_semi")

    out = of(kept.where("_sheaf_n = 1")).unionByName(docs.where(F.col(f"`{id_col}`").isNull()))
    repeated = kept.where("_sheaf_n > 1")
    return out if repeated.isEmpty() else out.unionByName(of(repeated).dropDuplicates([id_col, text_col]))
