"""URL rules and block lists kept as a memory-mapped, sorted digest array.

Every entry (a host with a path prefix, hence also a bare host) is stored
under the xxh64 digest of its string. The file is, in this order: a header,
the digests sorted as unsigned 64-bit integers, the offsets of the strings, a
verdict byte per entry and the strings. Executors map the file into memory, so
all Python workers of a machine share one copy of it in the page cache. A URL
is looked up by all strings that a rule fitting it could have; a batch of
those is digested and found by one vectorised binary search, and each hit is
confirmed against the full stored string, so colliding digests do no harm.

Entries may come as a table. Its digests are computed and sorted by the
executors and streamed into the file; a list beyond ``max_index_bytes`` gets
several files, one for each range of digests, so the driver never holds more
than one of them, and a digest is looked up in the file of its range.
"""

from __future__ import annotations

import math
import mmap
import struct
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.llm._shared import ship, table, tidy

MAGIC = b"SHEAFURL"
BLOCK, ALLOW = 0, 1
VERDICTS = ("block", "allow")

#: Rules of the query, as (verdict, host/path prefix). Fixed values.
RULES = (
    ("block", "com/en/"),
    ("allow", "example.com/en/7"),
    ("allow", "net/de/"),
    ("block", "example.net/de/8"),
    ("block", "org/es/"),
)

#: Hosts that the query blocks, subdomains included, where no rule fits.
BLOCKED_HOSTS = (
    "ads-track.example.com",
    "free-bets.example.net",
    "cheap-pills.example.com",
    "cheap-pills.example.net",
    "spam-farm.example.org",
    "casino-win.example.net",
    "adult-x.example.com",
)


class DigestArray:
    """Sorted digests with verdicts and full strings, in memory or mapped."""

    def __init__(self, buffer):
        if bytes(buffer[:8]) != MAGIC:
            raise ValueError("not a digest array")
        n, text_bytes = struct.unpack_from("<QQ", buffer, 8)
        self.n = n
        at = 24
        self.digests = np.frombuffer(buffer, dtype="<u8", count=n, offset=at)
        at += 8 * n
        self.offsets = np.frombuffer(buffer, dtype="<u8", count=n + 1, offset=at)
        at += 8 * (n + 1)
        self.verdicts = np.frombuffer(buffer, dtype=np.uint8, count=n, offset=at)
        at += n
        self.lengths = np.frombuffer(buffer, dtype="<u4", count=n, offset=at + (-at) % 4) if n else np.zeros(0, "<u4")
        at += (-at) % 4 + 4 * n
        self.text = memoryview(buffer)[at : at + text_bytes]
        #: Lengths of path prefixes that any entry has.
        self.path_lengths = np.unique(self.lengths)

    @staticmethod
    def pack(rows: Iterable[tuple[int, str, int]]) -> bytes:
        """The file's bytes; ``rows``: (digest, string, verdict), sorted, each string once."""
        digests, offsets, verdicts, lengths, text = array("Q"), array("Q", [0]), bytearray(), array("I"), bytearray()
        for d, s, v in rows:
            digests.append(d)
            text += s.encode("utf-8", "surrogatepass")
            offsets.append(len(text))
            verdicts.append(v)
            lengths.append(len(s) - s.find("/") if "/" in s else 0)
        head = MAGIC + struct.pack("<QQ", len(digests), len(text))
        parts = [head, digests.tobytes(), offsets.tobytes(), bytes(verdicts)]
        return b"".join([*parts, b"\0" * (-sum(map(len, parts)) % 4), lengths.tobytes(), bytes(text)])

    @classmethod
    def build(cls, entries: Iterable[tuple[str, str]], digest=xxhash.xxh64_intdigest) -> bytes:
        """The file's bytes. An entry that comes twice keeps its last verdict."""
        return cls.pack(sorted((digest(s), s, VERDICTS.index(v)) for s, v in {s: v for v, s in entries}.items()))

    @classmethod
    def open(cls, path: str) -> DigestArray:
        with open(path, "rb") as f:
            return cls(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))

    def find(self, strings: list[str], digests: np.ndarray) -> np.ndarray:
        """Index of the entry equal to each string, else -1."""
        found = np.full(len(strings), -1, np.int64)
        if not self.n or not len(strings):
            return found
        at = np.searchsorted(self.digests, digests)
        hit = np.nonzero((at < self.n) & (self.digests[np.minimum(at, self.n - 1)] == digests))[0]
        for i in hit:
            want, j = strings[i].encode("utf-8", "surrogatepass"), int(at[i])
            while j < self.n and self.digests[j] == digests[i]:  # entries that share a digest stand side by side
                if self.text[int(self.offsets[j]) : int(self.offsets[j + 1])] == want:
                    found[i] = j
                    break
                j += 1
        return found


def candidates(host: str, path: str, path_lengths) -> Iterator[str]:
    """Strings of all entries that could fit, longest host and path first."""
    at = 0
    cuts = [int(n) for n in path_lengths if n <= len(path)][::-1]
    while True:
        tail = host[at:]
        for n in cuts:
            yield tail + path[:n]
        dot = host.find(".", at)
        if dot < 0:
            return
        at = dot + 1


def url_host(url: Column) -> Column:
    """Between the first ``://`` and the next ``/``, ``?``, ``#`` or end, A-Z lower-cased."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


#: Seed of Spark's xxhash64, which digests the entries.
SEED = 42


def _entries(spark: SparkSession, rules, blocked_hosts) -> DataFrame:
    """(s, v, d) of all entries: kind letter and string, verdict, digest."""

    def as_table(given, schema: str) -> DataFrame:
        return given if isinstance(given, DataFrame) else spark.createDataFrame(list(given), schema)

    rules = as_table(rules, "verdict string, entry string").select(F.col("verdict").alias("v"), F.concat(F.lit("r"), "entry").alias("s"))
    hosts = as_table([(h,) for h in blocked_hosts] if not isinstance(blocked_hosts, DataFrame) else blocked_hosts, "entry string").select(F.lit("block").alias("v"), F.concat(F.lit("h"), "entry").alias("s"))
    both = rules.union(hosts).where(F.col("s").isNotNull())
    # an entry that is listed both ways blocks
    return both.groupBy("s").agg(F.when(F.max((F.col("v") == "block").cast("int")) == 1, BLOCK).otherwise(ALLOW).alias("v")).withColumn("d", F.xxhash64("s"))


def _ship_index(spark: SparkSession, entries: DataFrame, max_index_bytes: int) -> tuple[list[str], int]:
    """Names of the index's files, by digest range, and how many leading bits of a digest tell its file."""
    total = entries.agg(F.sum(F.octet_length("s") + 21)).first()[0] or 0
    bits = max(0, math.ceil(math.log2(max(1, total / max_index_bytes))))
    part = F.shiftrightunsigned("d", 64 - bits) if bits else F.lit(0)
    names = []
    for k in range(1 << bits):
        rows = entries.where(part == k).orderBy(F.col("d") < 0, "d", "s").toLocalIterator()  # unsigned order
        names.append(ship(spark, DigestArray.pack((r["d"] % (1 << 64), r["s"], r["v"]) for r in rows), "urls"))
    return names, bits


def judge(
    pages: DataFrame,
    rules: Iterable[tuple[str, str]] | DataFrame = RULES,
    blocked_hosts: Iterable[str] | DataFrame = BLOCKED_HOSTS,
    url_col: str = "url",
    default: str = "allow",
    max_index_bytes: int = 128 << 20,
) -> DataFrame:
    """``pages`` with host, path, rule, entry and verdict of each URL.

    ``rules`` are (verdict, string) pairs or a table (verdict, entry),
    ``blocked_hosts`` strings or a table (entry). A rule or entry fits its host
    and all subdomains if the path starts with its path; the longest string
    wins, of equally long ones the one with the longer host. ``rule`` is the
    winning rule's string, null where none fits; then ``verdict`` is block if a
    blocked host fits and ``default`` otherwise. A null URL or one without
    ``://`` has empty host and path and fits only rules with an empty host.
    Null entries are left out; one listed both ways blocks. Repeated rows are
    judged alike, long URLs whole; an empty table gives no rows. Columns of
    ``pages`` that clash with the new ones are replaced.
    """
    spark = pages.sparkSession
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "entry", "verdict")]
    parsed = pages.withColumns({"host": url_host(F.col(url_col)), "path": url_path(F.col(url_col))}).select(*kept, "host", "path")
    names, bits = _ship_index(spark, _entries(spark, rules, blocked_hosts), max_index_bytes)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parsed.schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files = [DigestArray.open(SparkFiles.get(n)) for n in names]
        lengths = np.unique(np.concatenate([f.path_lengths for f in files]))
        for pdf in batches:
            strings, owner = [], []
            for i, (host, path) in enumerate(zip(pdf["host"], pdf["path"], strict=True)):
                for s in candidates(host, path, lengths):
                    strings += ("r" + s, "h" + s)
                    owner += (i, i)
            digests = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in strings), np.uint64, len(strings))
            which = (digests >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(digests), np.int64)
            won: dict[tuple[int, str], tuple[int, int, str]] = {}
            for k in np.unique(which):
                rows = np.nonzero(which == k)[0]
                found = files[k].find([strings[j] for j in rows], digests[rows])
                for j, at in zip(rows[found >= 0].tolist(), found[found >= 0].tolist(), strict=True):
                    key = (owner[j], strings[j][0])
                    # candidates come longest host first
                    won[key] = max(won.get(key, (0, 0, "")), (len(strings[j]), -j, VERDICTS[files[k].verdicts[at]]))
            rule, entry, verdict = [None] * len(pdf), [None] * len(pdf), [default] * len(pdf)
            for kind in ("h", "r"):  # a rule overrides a block list entry
                for (i, k), (_, j, v) in won.items():
                    if k == kind:
                        (rule if kind == "r" else entry)[i] = strings[-j][1:]
                        verdict[i] = v
            yield pdf.assign(rule=rule, entry=entry, verdict=verdict)

    return parsed.mapInPandas(tidy(run), f"{fields}, rule string, entry string, verdict string")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every URL of ``pages`` judged by the rules, then by the blocked hosts."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages).select("page_id", "host", "path", "rule", "verdict")


_HOST = "translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_RULE_ROWS = ", ".join(f"('{s[: s.find('/')]}', '{s[s.find('/') :]}', '{v}')" for v, s in RULES)
_HOST_ROWS = ", ".join(f"('{h}')" for h in BLOCKED_HOSTS)
OP1_SQL = f"""
with u as (select page_id, {_HOST} as host, regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) as path from pages),
rules(h, p, v) as (values {_RULE_ROWS}),
hosts(h) as (values {_HOST_ROWS})
select page_id, host, path,
  (select h || p from rules where (host = h or ends_with(host, '.' || h)) and starts_with(path, p) order by length(h || p) desc limit 1) as rule,
  coalesce((select v from rules where (host = h or ends_with(host, '.' || h)) and starts_with(path, p) order by length(h || p) desc limit 1),
           case when exists (select 1 from hosts where host = h or ends_with(host, '.' || h)) then 'block' else 'allow' end) as verdict
from u
"""
