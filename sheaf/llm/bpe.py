"""Byte-level BPE by DuckDB recursive queries, inside each Spark partition.

A vocabulary of ranked byte strings gives a merge table: (left, right) to
merged for every token that splits into two others; it is built once, on the
driver, and shipped. Each distinct word (match of the split pattern) of a
slice of texts becomes token-position rows, at first one per byte. The
recursive query joins neighbouring rows to the merge table, picks each word's
leftmost pair of least rank, contracts it, and goes on with the words that
still had a pair, until none has. A text's ids are those of its words in
order; they are decoded by an ordered aggregation of the ids' byte strings,
text by text.

Encoding a text is the concatenation of its words' encodings, so the recursive
query meets a word once; a cache of bounded bytes keeps words between slices
of a task, and everything goes when the task ends. A word of over
``LONG_WORD`` bytes would need that many rounds of that many rows; such a word
is contracted by a heap instead, with the same rule and result.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections.abc import Callable, Iterator
from functools import lru_cache, partial

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.llm._shared import ship, table, text_or_empty, tidy

LONG_WORD = 200
#: Token-position rows that one recursive query makes at most, all rounds together; words that go to a query
#: at once; ids that are decoded at once; bytes of words and ids that a task remembers.
CHUNK_ROWS = 2_000_000
CHUNK_WORDS = 20_000
CHUNK_IDS = 250_000
CACHE_BYTES = 48 << 20
#: What a cached word takes beside its characters and digits.
WORD_BYTES = 200

#: Code points with the Unicode property White_Space. Fixed values.
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


#: Letters and numbers among the code points up to U+00FF. Fixed values.
LATIN_LETTERS, LATIN_NUMBERS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe"


def _ranges(prop: str) -> str:
    """The body of a character class with the code points that the tokenizer library has in ``prop``.

    Unicode versions differ between regex engines, so that library is asked:
    a split pattern of the class alone lets just its members through.
    """
    engine = tiktoken.Encoding("class", pat_str=prop, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
    everything = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    points = np.frombuffer(engine.decode(engine.encode_ordinary(everything)).encode("utf-32-le"), "<u4")
    breaks = np.nonzero(np.diff(points) != 1)[0]
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(points[np.r_[0, breaks + 1]], points[np.r_[breaks, len(points) - 1]], strict=True))


def _spelled(pattern: str, letters: str, numbers: str) -> str:
    out = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{SPACES}{letters}{numbers}]")
    return out.replace(r"\p{L}", f"[{letters}]").replace(r"\p{N}", f"[{numbers}]").replace(r"\s", f"[{SPACES}]").replace(r"\S", f"[^{SPACES}]")


@lru_cache(maxsize=4)
def splitter(pattern: str) -> Callable[[str], list[str]]:
    """findall of ``pattern``, with the classes that the tokenizer's regex engine has.

    Those classes differ from Python's (``\\s`` has no U+001C to U+001F), so
    they are spelled out; texts of Latin-1 code points take a shorter form.
    """
    short = re.compile(_spelled(pattern, LATIN_LETTERS, LATIN_NUMBERS)).findall
    whole = re.compile(_spelled(pattern, _ranges(r"\p{L}"), _ranges(r"\p{N}"))).findall

    def split(text: str) -> list[str]:
        if text.isascii():
            return short(text)
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return whole(text)
        return short(text)

    return split


def _ranks(blob: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, blob.splitlines())}


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return _ranks(f.read())


def merge_table(ranks: dict[bytes, int]) -> np.ndarray:
    """Rows (left, right, merged) of all tokens that split into two others."""
    pairs = [(ranks[t[:i]], ranks[t[i:]], m) for t, m in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
    return np.array(pairs, np.int32).reshape(-1, 3)


class Merger:
    """Vocabulary, merge table and the two queries, in one DuckDB connection."""

    def __init__(self, ranks: dict[bytes, int], merges: np.ndarray | None = None, memory: str = "150MB"):
        self.ranks = ranks
        self.merges = merge_table(ranks) if merges is None else merges
        self._by_pair: dict[tuple[int, int], int] | None = None
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": memory, "temp_directory": ""})  # chunks are bounded: nothing spills
        left, right, merged = self.merges.T
        self._load("merges", pa.table({"pair": (left.astype(np.int64) << 32) | right, "m": np.ascontiguousarray(merged)}))
        self._load("vocab", pa.table({"id": np.fromiter(ranks.values(), np.int32, len(ranks)), "hex": [t.hex() for t in ranks]}))

    def close(self) -> None:
        self.con.close()

    @property
    def by_pair(self) -> dict[tuple[int, int], int]:
        """The merge table as a dictionary, made when the first long word comes."""
        if self._by_pair is None:
            self._by_pair = {(a, b): m for a, b, m in self.merges.tolist()}
        return self._by_pair

    def _load(self, name: str, rows: pa.Table) -> None:
        self.con.register("_new", rows)
        self.con.execute(f"create or replace table {name} as select * from _new")
        self.con.unregister("_new")

    def encode(self, words: list[bytes]) -> list[list[int]]:
        """Token ids of each word."""
        return [list(map(int, ids.split())) for ids in self.spelled(words)]

    def spelled(self, words: list[bytes]) -> list[str]:
        """Token ids of each word, decimal, a space before each."""
        out = [""] * len(words)
        todo = []
        for i, w in enumerate(words):
            if (whole := self.ranks.get(w)) is not None:
                out[i] = f" {whole}"
            elif len(w) > LONG_WORD:
                out[i] = "".join(f" {x}" for x in self._encode_long(w))
            elif w:
                todo.append(i)
        part: list[int] = []
        rows = 0
        for k, i in enumerate(todo):
            part.append(i)
            rows += len(words[i]) ** 2  # a round for each byte at most, of a row for each
            if rows >= CHUNK_ROWS or len(part) == CHUNK_WORDS or k == len(todo) - 1:
                for j, ids in zip(part, self._encode_rows([words[j] for j in part]), strict=True):
                    out[j] = ids
                part, rows = [], 0
        return out

    def _encode_rows(self, words: list[bytes]) -> list[str]:
        """``spelled`` for words by the recursive query: one window over all of them, cut where the word changes."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        rows = pa.table(
            {
                "w": np.repeat(np.arange(len(words), dtype=np.int32), lengths),
                "pos": np.arange(int(lengths.sum()), dtype=np.int32),
                "tok": self.byte_ids[np.frombuffer(b"".join(words), np.uint8)],
            }
        )
        self.con.register("start_rows", rows)
        found = self.con.sql(
            """
            with recursive s(w, pos, tok, round) as (
              select w, pos, tok, 0 from start_rows
              union all
              (with pairs as (
                 select w, pos, (tok::bigint << 32) | lead(tok) over word as pair, lead(pos) over word as next_pos, lead(w) over word as next_w
                 from s window word as (order by pos)),
               best as (
                 select p.w, min((m::bigint << 32) | p.pos) as pick, arg_min(p.next_pos, (m::bigint << 32) | p.pos) as gone
                 from pairs p join merges using (pair) where next_w = p.w group by p.w)
               select s.w, s.pos, case when s.pos = pick & 4294967295 then (pick >> 32)::int else tok end, round + 1
               from s join best using (w) where s.pos <> gone)
            )
            select s.w, tok from s join (select w, max(round) as round from s group by w) using (w, round) order by pos
            """
        ).to_arrow_table()
        self.con.unregister("start_rows")
        starts = np.searchsorted(found.column("w").to_numpy(), np.arange(len(words) + 1)).astype(np.int32)
        ids = found.column("tok").combine_chunks().cast(pa.string())
        return pc.binary_join_element_wise("", pc.binary_join(pa.ListArray.from_arrays(starts, ids), " "), " ").to_pylist()

    def _encode_long(self, word: bytes) -> list[int]:
        """Leftmost pair of least rank first, by a heap over a linked list."""
        toks = self.byte_ids[np.frombuffer(word, np.uint8)].tolist()
        n = len(toks)
        after, ahead, live = [*range(1, n + 1)], [*range(-1, n - 1)], [True] * n
        pair = lambda i: self.by_pair.get((toks[i], toks[after[i]])) if after[i] < n else None
        heap = [(m, i) for i in range(n) if (m := pair(i)) is not None]
        heapq.heapify(heap)
        while heap:
            m, i = heapq.heappop(heap)
            if not live[i] or pair(i) != m:
                continue
            gone = after[i]
            toks[i], live[gone], after[i] = m, False, after[gone]
            if after[i] < n:
                ahead[after[i]] = i
            for k in (ahead[i], i):
                if k >= 0 and (m := pair(k)) is not None:
                    heapq.heappush(heap, (m, k))
        return [toks[i] for i in range(n) if live[i]]

    def decode(self, seqs: list[np.ndarray]) -> list[bytes]:
        """Bytes of each sequence of ids; an id without an entry is an error.

        At most ``CHUNK_IDS`` ids go to a query: many short sequences, or a part of a long one.
        """
        out: list[list[bytes]] = [[] for _ in seqs]
        part: list[np.ndarray] = []
        owner: list[int] = []
        size = 0
        for k, ids in enumerate(seqs):
            for at in range(0, len(ids), CHUNK_IDS):
                piece = ids[at : at + CHUNK_IDS]
                if size + len(piece) > CHUNK_IDS:
                    self._decode_into(out, owner, part)
                    part, owner, size = [], [], 0
                part.append(piece)
                owner.append(k)
                size += len(piece)
        if part:
            self._decode_into(out, owner, part)
        return [b"".join(x) for x in out]

    def _decode_into(self, out: list[list[bytes]], owner: list[int], part: list[np.ndarray]) -> None:
        for k, made in zip(owner, self._decode_rows(part), strict=True):
            out[k].append(made)

    def _decode_rows(self, seqs: list[np.ndarray]) -> list[bytes]:
        flat = np.concatenate(seqs)
        lengths = np.fromiter(map(len, seqs), np.int64, len(seqs))
        self.con.register("ids", pa.table({"w": np.repeat(np.arange(len(seqs), dtype=np.int32), lengths), "pos": np.arange(len(flat), dtype=np.int64), "id": flat}))
        got = self.con.execute("select w, count(hex) as n, string_agg(hex, '' order by pos) as hex from ids left join vocab using (id) group by w").fetchall()
        self.con.unregister("ids")
        made = [b""] * len(seqs)
        for w, n, text in got:
            if n != lengths[w]:
                raise ValueError("an id is not in the vocabulary")
            made[w] = bytes.fromhex(text)
        return made


class Codec:
    """Texts to ids and back, with the words met before kept in a cache of bounded size."""

    def __init__(self, merger: Merger, pattern: str = public_tokenizers.PATTERN, cache_bytes: int = CACHE_BYTES):
        self.merger, self.split, self.cache_bytes = merger, splitter(pattern), cache_bytes
        self.known: dict[str, str] = {}  # ids of a word, decimal, a space before each
        self.held = 0

    def learn(self, pieces: list[list[str]]) -> None:
        """Encode the words that aren't known."""
        met = set()
        for p in pieces:
            met.update(p)
        new = [w for w in met if w not in self.known]
        if self.held > self.cache_bytes:
            self.known = {w: self.known[w] for w in met if w in self.known}
            self.held = sum(len(w) + len(i) + WORD_BYTES for w, i in self.known.items())
        for at in range(0, len(new), CHUNK_WORDS):
            part = new[at : at + CHUNK_WORDS]
            for w, ids in zip(part, self.merger.spelled([w.encode("utf-8", "surrogatepass") for w in part]), strict=True):
                self.known[w] = ids
                self.held += len(w) + len(ids) + WORD_BYTES

    def ids(self, pieces: list[str]) -> str:
        """Decimal ids joined by one space."""
        return "".join(map(self.known.__getitem__, pieces))[1:]

    def encoded(self, texts: list[str]) -> list[str]:
        """``ids`` of each text."""
        pieces = [self.split(t) for t in texts]
        self.learn(pieces)
        return [self.ids(p) for p in pieces]


def numbers(ids: str) -> np.ndarray:
    return np.fromstring(ids, np.int32, sep=" ") if ids else np.zeros(0, np.int32)


def _ship(spark: SparkSession, vocabulary: str | None) -> tuple[str, str]:
    """Send the vocabulary file and its merge table (a few MB each) to the executors; their names there."""
    with open(vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        blob = f.read()
    return ship(spark, blob, "bpe"), ship(spark, merge_table(_ranks(blob)).tobytes(), "merges")


def _codec(files: tuple[str, str], pattern: str) -> Codec:
    merges = np.fromfile(SparkFiles.get(files[1]), np.int32).reshape(-1, 3)
    return Codec(Merger(load_ranks(SparkFiles.get(files[0])), merges), pattern)


#: Characters of text that one call of the codec takes at most, beyond a single long text.
BATCH_CHARS = 1_000_000


def _slices(texts: pa.Array) -> Iterator[list[str]]:
    """The texts in lists of bounded size."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    start = done = 0
    while start < len(texts):
        stop = max(start + 1, int(np.searchsorted(ends, done + BATCH_CHARS, "right")))
        yield texts.slice(start, stop - start).to_pylist()
        start, done = stop, ends[stop - 1]


def _mapped(docs: DataFrame, vocabulary: str | None, pattern: str, id_col: str, text_col: str, schema: str, row: Callable) -> DataFrame:
    files = _ship(docs.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(files, pattern)
        try:
            for batch in batches:
                at = 0
                for texts in _slices(batch.column(1)):
                    yield row(batch.column(0).slice(at, len(texts)), codec.encoded(texts), codec.merger)
                    at += len(texts)
        finally:
            codec.merger.close()

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("t")).mapInArrow(tidy(run), f"doc_id {kind}, {schema}")


def encode(docs: DataFrame, vocabulary: str | None = None, pattern: str = public_tokenizers.PATTERN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) of every whole text, without special tokens.

    A null or empty text has no ids. Repeated rows give repeated results;
    other columns aren't read; an empty table gives no rows.
    """

    def row(keys, coded, merger):
        return pa.record_batch([keys, pa.array([numbers(i) for i in coded], pa.list_(pa.int32()))], ["doc_id", "ids"])

    return _mapped(docs, vocabulary, pattern, id_col, text_col, "ids array<int>", row)


def decode(coded: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, decoded binary) of arrays of ids, by ordered aggregation.

    A null array, and a null within one, decodes to nothing; an id that isn't
    in the vocabulary is an error.
    """
    files = _ship(coded.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(files, public_tokenizers.PATTERN)
        try:
            for batch in batches:
                seqs = [np.array([i for i in s or () if i is not None], np.int32) for s in batch.column(1).to_pylist()]
                yield pa.record_batch([batch.column(0), pa.array(codec.merger.decode(seqs), pa.binary())], ["doc_id", "decoded"])
        finally:
            codec.merger.close()

    kind = coded.schema[id_col].dataType.simpleString()
    return coded.select(F.col(id_col).alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids")).mapInArrow(tidy(run), f"doc_id {kind}, decoded binary")


def _both_ways(keys: pa.Array, coded: list[str], merger: Merger, with_ids: bool) -> pa.RecordBatch:
    seqs = [numbers(i) for i in coded]
    columns = {
        "doc_id": keys,
        "n_tokens": pa.array([len(s) for s in seqs], pa.int64()),
        "token_ids": pa.array(seqs, pa.list_(pa.int32())) if with_ids else None,
        "ids_sha256": pa.array([hashlib.sha256(i.encode()).hexdigest() for i in coded], pa.string()),
        "decoded_sha256": pa.array([hashlib.sha256(b).hexdigest() for b in merger.decode(seqs)], pa.string()),
    }
    return pa.record_batch({k: v for k, v in columns.items() if v is not None})


def round_trip(docs: DataFrame, vocabulary: str | None = None, pattern: str = public_tokenizers.PATTERN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): the text's ids, and the digest of what those ids decode to.

    Null and empty texts have no tokens and the digests of empty strings.
    """
    return _mapped(docs, vocabulary, pattern, id_col, text_col, "n_tokens long, ids_sha256 string, decoded_sha256 string", partial(_both_ways, with_ids=False))


def encode_and_check(docs: DataFrame, vocabulary: str | None = None, pattern: str = public_tokenizers.PATTERN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, token_ids array<int>, ids_sha256, decoded_sha256), as ``encode`` and ``round_trip`` give them."""
    return _mapped(docs, vocabulary, pattern, id_col, text_col, "n_tokens long, token_ids array<int>, ids_sha256 string, decoded_sha256 string", partial(_both_ways, with_ids=True))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents`` encoded by the 50k ranks, and its ids decoded again."""
    return round_trip(table(spark, sf_dir, "documents"))
