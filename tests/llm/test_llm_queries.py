"""The registered queries over whole test tables: against their SQL in DuckDB, else against brute force."""

import hashlib
import zlib
from pathlib import Path

import duckdb
import public_tokenizers
import pytest
import tiktoken
from test_operators import brute_classes
from test_pure import _base

import __spark_entry__ as entry
from sheaf.llm import bpe, decontaminate, queries, toxicity

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="test tables aren't here")


def table(spark, name):
    return spark.read.parquet(f"{DATA}/{name}.parquet")


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] or "" for r in table(spark, "documents").collect()}


def run(spark, start):
    [name] = [n for n in queries.QUERIES if n.startswith(start)]
    return queries.QUERIES[name](spark, str(DATA)).collect()


def in_fold(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def test_registered():
    known = entry.queries()
    assert set(queries.QUERIES) <= set(known) and "pipeline" in known and sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "benchmark", "labels"):
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    found = con.execute(queries.ORACLE_SQL[name])
    columns = sorted(d[0] for d in found.description)
    at = [[d[0] for d in found.description].index(c) for c in columns]
    frame = queries.QUERIES[name](spark, str(DATA))
    assert set(columns) <= set(frame.columns)
    assert sorted(repr(tuple(r[c] for c in columns)) for r in frame.collect()) == sorted(repr(tuple(r[i] for i in at)) for r in found.fetchall())


def test_op2(spark, texts):
    got = {r["doc_id"]: r["class_id"] for r in run(spark, "op2_")}
    assert got == brute_classes(list(texts.items()))


def test_op4(spark, texts):
    rows = {r["doc_id"]: r for r in run(spark, "op4_")}
    assert set(rows) == set(texts)
    assert all(r["held_out"] == in_fold(i) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for i, r in rows.items())
    # the same scores by hand, from the model's words alone
    model = toxicity.fit(table(spark, "documents"), table(spark, "labels"))
    for i, t in texts.items():
        odds = model.bias + sum(model.weights[w] for w in toxicity.words(t) if w in model.weights)
        assert rows[i]["score"] == pytest.approx(1 / (1 + 2.718281828459045 ** -odds), abs=1e-9)


def test_op6(spark, texts):
    for r in run(spark, "op6_"):
        base = _base(texts[r["doc_id"]])
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(k == kind for k, _, _ in base) for kind in ("assign", "access", "hex"))
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        spans = [tuple(s.split(":")) for s in r["spans"].split(",") if s]
        assert {(k, str(a), str(b)) for k, a, b in base} <= set(spans) and sum(k == "guess" for k, *_ in spans) == r["n_guess"] <= r["n_contexts"]


def test_op7(spark, texts):
    rows = {r["doc_id"]: r for r in run(spark, "op7_")}
    assert set(rows) == set(texts)
    assert all(r["held_out"] == in_fold(i) and 0 <= r["score"] <= 1 and r["kept"] == (r["score"] >= 0.5) for i, r in rows.items())
    truth = {r["doc_id"]: r["quality"] for r in table(spark, "labels").where("quality is not null").collect()}
    held = [i for i in truth if in_fold(i) and i in rows]
    assert sum(rows[i]["kept"] == bool(truth[i]) for i in held) >= 0.8 * len(held)


def test_op8(spark, texts):
    items = {r["item_id"]: decontaminate.shingles(decontaminate.words(r["text"])) for r in table(spark, "benchmark").collect()}
    want = {(i, k) for i, t in texts.items() for there in [decontaminate.shingles(decontaminate.words(t))] for k, item in items.items() if len(item & there) >= 0.8 * len(item)}
    assert {(r["doc_id"], r["item_id"]) for r in run(spark, "op8_")} == want


def test_op9(spark, texts):
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    rows = run(spark, "op9_")
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode_ordinary(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_decoding_is_of_the_ids(spark):
    """Other ids than the text's decode to another text: nothing is taken from the source."""
    coded = spark.createDataFrame([(1, [31373, None, 995]), (2, None), (3, [])], "doc_id long, ids array<int>")
    assert {r["doc_id"]: bytes(r["decoded"]) for r in bpe.decode(coded).collect()} == {1: b"hello world", 2: b"", 3: b""}


ROWS = {1: 4, 2: 6, 3: 6, 4: 6, 5: 8, 6: 6, 7: 6, 8: 3, 9: 6, 10: 6}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_odd_tables(spark, odd_tables, name):
    assert len(queries.QUERIES[name](spark, odd_tables).collect()) == ROWS[int(name[2:].split("_")[0])]


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_empty_tables(spark, empty_tables, name):
    assert queries.QUERIES[name](spark, empty_tables).collect() == []
