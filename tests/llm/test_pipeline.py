"""The stages of the corpus pipeline on the smallest tables, each against its own input."""

import hashlib
import re
from pathlib import Path

import pytest
import public_tokenizers
import tiktoken
from test_operators import brute_classes, brute_lines

import corpus_pipeline
from sheaf.llm import bpe, decontaminate

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="test tables aren't here")


def test_pipeline(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    kept = {"start": docs}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(DATA)).write.parquet(str(tmp_path / name))
        kept[name] = docs = spark.read.parquet(str(tmp_path / name))
    order = [n for n, _ in corpus_pipeline.STAGES]
    for name in order[:-1]:
        assert kept[name].columns == kept["start"].columns
    texts = {n: {r["doc_id"]: r["text"] for r in f.collect()} for n, f in kept.items() if n != order[-1]}
    source = {r["doc_id"]: r["source"] for r in kept["start"].collect()}
    toxic = {r["doc_id"] for r in spark.read.parquet(f"{DATA}/labels.parquet").where("toxic = 1").collect()}
    clean = [i for i, t in texts["start"].items() if i not in toxic and not re.search("idiot|moron|stupid|scum|loser|pathetic|worthless|trash|clown|disgusting", t)]
    assert sum(i in texts["toxicity"] for i in clean) >= 0.97 * len(clean)
    before = [(i, t, source[i]) for i, t in texts["toxicity"].items()]
    assert texts["line_dedup"] == brute_lines(before, 3)
    classes = brute_classes(sorted(texts["line_dedup"].items()))
    assert set(texts["near_dedup"]) == set(classes.values())
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    leaking = set()
    for i, t in texts["near_dedup"].items():
        there = decontaminate.shingles(decontaminate.words(t))
        if any(len(decontaminate.shingles(decontaminate.words(x)) & there) >= 0.8 * len(decontaminate.shingles(decontaminate.words(x))) for _, x in items):
            leaking.add(i)
    assert set(texts["decontamination"]) == set(texts["near_dedup"]) - leaking
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    for r in kept["tokens"].collect():
        text = texts["decontamination"][r["doc_id"]]
        assert r["token_ids"] == library.encode_ordinary(text) and r["n_tokens"] == len(r["token_ids"])
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_pipeline_of_odd_tables(spark, odd_tables):
    """Nulls in any column, repeated rows and ids, a very long word, clashing names: one row of each text stays, the benchmark's goes."""
    rows = corpus_pipeline.run(spark, odd_tables).collect()
    # two null or empty texts are one class; the item's text goes wherever it stands
    assert sorted((r["doc_id"], r["n_tokens"] > 0) for r in rows) == [(1, False), (2, True)]


def test_pipeline_of_empty_tables(spark, empty_tables):
    assert corpus_pipeline.run(spark, empty_tables).collect() == []


def test_stages_keep_clashing_columns(spark, odd_tables):
    docs = spark.read.parquet(f"{odd_tables}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, odd_tables).columns == docs.columns
