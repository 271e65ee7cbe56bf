"""Secret scan: fixed base patterns plus guess-cost estimates of credential values.

The base patterns find long assigned values, access keys and hex runs. Every
value that stands in a credential context (also a short one, also after words
that the base pattern doesn't know, such as ``pwd`` or ``passphrase``, also
one that base spans cover) is further priced by how many guesses an attacker
would need: a dynamic program finds the cheapest segmentation of the value
into dictionary words, dates, repeats, keyboard walks and brute-force spans. A
value whose cost reaches ``min_log10_guesses`` is a secret that was generated
rather than written, and gets a span of the kind ``guess``; one below it is
reported with its cost, but has no such span.

The dictionary is ranked: some words that passwords like, then the whole words
of a public tokenizer's vocabulary, whose merge ranks follow how common they
are.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.llm._shared import table, text_or_empty, tidy
from sheaf.llm.bpe import load_ranks

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
#: A run of the class is matched whole by ``+``; asking for its least length at once finds the same runs.
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
#: Contexts of the guess-cost method; the value is anything up to white space or a quote.
CONTEXT = re.compile(
    r"""(?<![A-Za-z])(?:password|passwd|passphrase|pass|pwd|secret|token|api_?key|credentials?|auth|private_?key)["']?\x20*[:=]\x20*["']?([^\s"'`<>]+)""",
    re.ASCII | re.IGNORECASE,
)
_HINT = re.compile(r"pass|pwd|secret|token|key|cred|auth", re.ASCII | re.IGNORECASE)
KINDS = ("assign", "access", "hex", "guess")
BASE = KINDS[:3]

#: Words that passwords like, by rank: position times two is the number of guesses. Fixed values.
WORDS = """password admin welcome login secret user test letmein monkey dragon master hello change default root guest token
key the and for you that with this have from not are was but all can his her one our out day get has him how man new now old see
two way who boy did its let put say she too use love home work time year name good first last long great little own other right
big high small large next early young few public bad same able summer winter spring autumn sunshine princess football baseball
shadow superman michael jordan hunter freedom whatever computer internet server system service office company example sample
demo temp temporary database oracle mysql postgres spark hadoop cloud azure google amazon apple orange banana flower purple
yellow green blue black white silver golden diamond cookie pepper ginger summer monday tuesday wednesday thursday friday
saturday sunday january february march april june july august september october november december your my is in to of a""".split()
#: Rows of a common keyboard, for walks. Fixed values.
KEYBOARD = ("1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
LEET = str.maketrans("@4301!5$7", "aaeoiisst")

_WHERE = {c: (r, i) for r, row in enumerate(KEYBOARD) for i, c in enumerate(row)}
_DATE = re.compile(r"(?:(?:19|20)\d\d(?:[-/.]?(?:0[1-9]|1[0-2])(?:[-/.]?(?:0[1-9]|[12]\d|3[01]))?)?|(?:0[1-9]|[12]\d|3[01])[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:19|20)\d\d)")


def _neighbours(a: str, b: str) -> bool:
    x, y = _WHERE.get(a), _WHERE.get(b)
    return bool(x and y) and abs(x[0] - y[0]) <= 1 and abs(x[1] - y[1]) <= 1 and x != y


def _runs(n: int, holds) -> list[int]:
    """For each of n positions, at how many in a row from it on ``holds`` is true."""
    out = [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        if holds(i):
            out[i] = out[i + 1] + 1
    return out[:n]


@lru_cache(maxsize=2)
def dictionary(vocabulary: str | None = None, least: int = 4, most: int = 8_000) -> dict[str, int]:
    """Rank of each word: the fixed ones, then the vocabulary's whole words of ``least`` letters or more."""
    tokens = load_ranks(vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken"))
    whole = re.compile(rb" ([a-z]{%d,})" % least)
    found = (m[1].decode() for t in sorted(tokens, key=tokens.__getitem__) if (m := whole.fullmatch(t)))
    out: dict[str, int] = {}
    for w in (*WORDS, *found):
        if len(out) == most:
            break
        out.setdefault(w, len(out) + 1)
    return out


def brute_cost(value: str) -> float:
    """log10 of the guesses for one character of ``value`` by brute force."""
    sizes = (26, any("a" <= c <= "z" for c in value)), (26, any("A" <= c <= "Z" for c in value)), (10, any(map(str.isdigit, value))), (33, not value.isalnum())
    return math.log10(max(10, sum(size for size, there in sizes if there)))


def segments(value: str, ranks: dict[str, int]) -> Iterator[tuple[int, int, float, str]]:
    """(start, end, log10 guesses, kind) of all spans that are cheaper than brute force may be, by start.

    Only spans of bounded length are tried for words and dates; repeats and
    walks extend as far as they go, to ends found in one pass, so the work is
    linear in the value's length.
    """
    n, low = len(value), value.lower()
    plain = low.translate(LEET) if low.isascii() else low
    longest, brute = max(map(len, ranks), default=0), brute_cost(value)
    if len(low) != n:  # case folding changed positions
        low = plain = value
    # how long each position repeats what stands ``period`` before, where walks end, and turns of walks up to a position
    again = {period: _runs(n, lambda i, period=period: i + period < n and value[i] == value[i + period]) for period in (1, 2, 3, 4)}
    near = _runs(n, lambda i: i + 1 < n and _neighbours(low[i], low[i + 1]))
    steps = {step: _runs(n, lambda i, step=step: i + 1 < n and ord(value[i + 1]) - ord(value[i]) == step) for step in (1, -1)}
    turned = [0]
    for i in range(n - 1):
        turned.append(turned[-1] + (near[i] > 0 and _WHERE[low[i]][0] != _WHERE[low[i + 1]][0]))
    for i in range(n):
        for j in range(i + 1, min(n, i + longest) + 1):
            rank = ranks.get(low[i:j])
            if rank is not None:
                yield i, j, math.log10(2 * rank * (1 if value[i:j].islower() else 4)), "word"
            elif (rank := ranks.get(plain[i:j])) is not None:
                yield i, j, math.log10(2 * rank * 16), "word"
        if m := _DATE.match(value, i):
            yield i, m.end(), math.log10(365 * 120), "date"
        for period in (1, 2, 3, 4):
            j = i + period + again[period][i] // period * period
            if j > i + period and j - i >= 3:
                yield i, j, period * brute + math.log10((j - i) / period + 1), "repeat"
        j = i + 1 + near[i]
        if j - i >= 4:
            turns = turned[j - 1] - turned[i]
            yield i, j, math.log10(47 * (j - i)) + (turns + 1) * math.log10(4), "walk"
        length = 1 + max(steps[1][i], steps[-1][i])
        if length >= 3:
            yield i, i + length, math.log10(62 * length), "walk"


#: Each further segment costs the attacker a factor of two for not knowing where it begins.
JOIN = math.log10(2)


def guess_cost(value: str, ranks: dict[str, int] | None = None) -> tuple[float, list[tuple[str, int, int]]]:
    """log10 of the guesses that ``value`` needs, and the cheapest segmentation.

    Costs add over segments, with ``JOIN`` between them. Going on with a
    brute-force span is free of ``JOIN``, so each position has two states: the
    least cost of what ends there in such a span, and in any other.
    """
    n, brute = len(value), brute_cost(value)
    spanned: list[tuple[float, int]] = [(math.inf, 0)] * (n + 1)  # ends in brute force: cost, where that span began
    other: list[tuple[float, int, str]] = [(0.0, 0, "")] + [(math.inf, 0, "")] * n
    done = 0

    def reach(to: int) -> None:
        """Brute force from all positions before ``to``, whose other states are final."""
        nonlocal done
        for i in range(done, to):
            spanned[i + 1] = min((spanned[i][0] + brute, spanned[i][1]), (other[i][0] + brute + (JOIN if i else 0.0), i))
        done = max(done, to)

    for i, j, cost, kind in segments(value, ranks if ranks is not None else dictionary()):
        reach(i)
        cost += min(spanned[i][0], other[i][0]) + (JOIN if i else 0.0)
        if cost < other[j][0]:
            other[j] = (cost, i, kind)
    reach(n)
    parts, at, free = [], n, False
    while at:
        if spanned[at][0] <= other[at][0] and not free:
            parts.append(("brute", spanned[at][1], at))
            at, free = spanned[at][1], True  # a span before it would have been the same one
        else:
            parts.append((other[at][2], other[at][1], at))
            at, free = other[at][1], False
    return min(spanned[n][0], other[n][0]), parts[::-1]


def find_spans(text: str, min_log10_guesses: float = 11.0, ranks: dict[str, int] | None = None) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]], list[tuple[int, int, float]]]:
    """Base spans, all spans (by start, then kind), and (start, end, cost) of every value in a credential context.

    Positions are code points, ends exclusive; a base span is its pattern's
    whole match, an added one the value itself.
    """
    base: list[tuple[str, int, int]] = []
    hinted = _HINT.search(text) is not None
    if hinted:
        base += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 12]
    if "AKIA" in text:
        base += [("access", *m.span()) for m in ACCESS.finditer(text)]
    base += [("hex", *m.span()) for m in HEX.finditer(text)]
    priced = []
    if hinted:
        for m in CONTEXT.finditer(text):
            if value := m.group(1).rstrip(".,;:!?)]}"):
                priced.append((m.start(1), m.start(1) + len(value), guess_cost(value, ranks)[0]))
    added = [("guess", a, b) for a, b, cost in priced if cost >= min_log10_guesses]
    order = lambda s: (s[1], KINDS.index(s[0]), s[2])
    base.sort(key=order)
    return base, sorted(base + added, key=order), priced


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_log10_guesses: float = 11.0, vocabulary: str | None = None) -> DataFrame:
    """Counts, digest and spans of the secrets in every whole text.

    One row per row of ``docs``: doc_id, n_assign, n_access, n_hex, n_guess,
    base_sha256, spans, n_contexts (values in credential contexts), costs
    (start:end:log10 guesses:verdict of each, comma-joined) and top_cost (the
    dearest, null without any). Null and empty texts have no spans; repeated
    rows give repeated results; other columns aren't read; an empty table
    gives no rows; a value is priced whole, however long.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    ranks = dictionary(vocabulary)  # some 100 kB

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for text in pdf["t"]:
                base, spans, priced = find_spans(text, min_log10_guesses, ranks)
                count = [sum(k == kind for k, _, _ in spans) for kind in KINDS]
                costs = ",".join(f"{a}:{b}:{cost:.3f}:{'secret' if cost >= min_log10_guesses else 'guessable'}" for a, b, cost in priced)
                rows.append((*count, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), len(priced), costs, max((c for *_, c in priced), default=None)))
            out = pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "n_guess", "base_sha256", "spans", "n_contexts", "costs", "top_cost"])
            out["top_cost"] = out["top_cost"].astype("float64")
            out.insert(0, "doc_id", pdf["i"].array)
            yield out

    return docs.select(F.col(id_col).alias("i"), text_or_empty(text_col).alias("t")).mapInPandas(
        tidy(run), f"doc_id {kind}, n_assign long, n_access long, n_hex long, n_guess long, base_sha256 string, spans string, n_contexts long, costs string, top_cost double"
    )


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every whole text of ``documents``."""
    return scan(table(spark, sf_dir, "documents"))
