import pytest

ODD = [(1, None, None, None, None), (1, "", "en", "s", 3), (2, "x" * 200_000 + " password=" + "Zq7#" * 400, "en", None, 7), (None, "some words that stand here alone", None, "s", None), (3, "some words that stand here alone", "de", "s", 5), (3, "some words that stand here alone", "de", "s", 5)]


@pytest.fixture
def odd_tables(spark, tmp_path):
    """Nulls in every column, repeated rows and ids, a very long word, a further column with a clashing name."""
    def write(name, rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))

    write("documents", [(*r, "clash", 1) for r in ODD], "doc_id long, text string, lang string, source string, n_chars long, row string, t int")
    write("labels", [(1, 1, 0), (3, 0, 1), (None, 1, 1), (7, None, None), (3, None, 1), *((100 + k, 1, 0) for k in range(60))], "doc_id long, quality int, toxic int")
    write("benchmark", [(1, None), (None, "some words that stand here alone"), (2, ""), (2, "..."), (None, None)], "item_id long, text string")
    write("pages", [(1, None, None), (None, "http://a.com/en/", "x"), (2, "", None), (2, "http://" + "a." * 2000 + "com/en/" + "y" * 20_000, None)], "page_id long, url string, html string")
    write("embeddings", [(1, None, None), (None, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (2, [0.0, 1.0], 1), (3, [2.0, 0.0], None), (3, [2.0, 0.0], 0), (4, [float("nan"), 1.0], 2), (5, [], 1)], "vec_id long, embedding array<float>, label int")
    return str(tmp_path)


@pytest.fixture
def empty_tables(spark, tmp_path):
    for t, schema in (
        ("documents", "doc_id long, text string, lang string, source string, n_chars long"), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string"),
        ("pages", "page_id long, url string, html string"), ("embeddings", "vec_id long, embedding array<float>, label int"),
    ):
        spark.createDataFrame([], schema).write.parquet(str(tmp_path / f"{t}.parquet"))
    return str(tmp_path)
