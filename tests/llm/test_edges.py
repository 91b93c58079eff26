"""Empty tables, clashing column names, nulls, repeated rows and one very long text, for every operator and stage."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from aeris.llm import (chat, decontaminate, exact_dedup, html_text, jaccard_join, lang_id, licenses, packing, queries,
                       repeats, warc)
from aeris.llm.common import ship

DOC = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ["key", "row", "root", "sha", "doc", "item", "part", "piece", "length", "h", "conv", "pos", "n", "size", "score", "_mark"]


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship(spark)


def rows(df):
    return sorted((repr(tuple(r)) for r in df.collect()))


def documents():
    rng = random.Random(4)
    words = ["".join(rng.choice("aeinorst") for _ in range(rng.randint(2, 7))) for _ in range(80)]
    text = [" ".join(rng.choice(words) for _ in range(60)) for _ in range(6)]
    out = [(i, t, "xx", "s", len(t)) for i, t in enumerate(text)]
    long = " ".join(rng.choice(words) for _ in range(60_000))
    return out + [(10, text[0], "xx", "s", 1), (10, text[0], "xx", "s", 1), (11, text[1] + " more", None, None, None), (12, None, None, "s", 0),
                  (13, "", "xx", None, 0), (None, text[2], "xx", "s", 1), (14, long, "xx", "s", len(long)), (15, " \t\n", None, None, 3), (16, "123 !", "yy", "s", 5)]


def clashing(df):
    for k, c in enumerate(CLASH):
        if c not in df.columns:
            df = df.withColumn(c, F.lit(f"clash {k}"))
    return df


OPERATORS = {
    "licenses": lambda d, b: licenses.license_scan(d).drop("spans"),
    "jaccard": lambda d, b: jaccard_join.jaccard_join(d),
    "exact": lambda d, b: exact_dedup.exact_dedup(d),
    "packing": lambda d, b: packing.pack(d, queries.tokenizer_path()).drop("sequence_id", "offset"),
    "language": lambda d, b: lang_id.language_id(d),
    "repeats": lambda d, b: repeats.remove_repeats(d),
    "decontaminate": lambda d, b: decontaminate.matches(d, b),
}


@pytest.fixture(scope="module")
def benchmark(spark):
    text = documents()[3][1]
    return spark.createDataFrame([(1, " ".join(text.split()[10:40])), (2, None), (3, "")], "item_id long, text string")


@pytest.mark.parametrize("name", OPERATORS)
def test_documents(spark, benchmark, name):
    run = OPERATORS[name]
    df = spark.createDataFrame(documents(), DOC).repartition(3)
    plain = rows(run(df, benchmark))
    assert rows(run(clashing(df), clashing(benchmark))) == plain
    if name != "decontaminate":
        assert len(plain) >= len(documents())
    else:
        assert len(plain) == 1
    assert run(df.limit(0), benchmark.limit(0)).count() == 0


def test_pages(spark):
    html = "<html><body><p>" + "one two three " * 40 + "</p></body></html>"
    data = [(1, "http://a", html), (2, "http://b", html), (2, "http://b", html), (3, None, None), (None, "http://c", html), (4, "x", ""), (5, "y", html * 300)]
    df = spark.createDataFrame(data, "page_id long, url string, html string")
    for run in (html_text.extract, warc.warc_round_trip):
        plain = rows(run(df))
        assert rows(run(clashing(df))) == plain and len(plain) == len(data)
        assert run(df.limit(0)).count() == 0


def test_conversations(spark):
    data = [(1, 0, "user", "a"), (1, 1, "bot", "b"), (2, 0, "user", "a"), (2, 1, "bot", "b"), (2, 2, "user", "c"), (2, 2, "user", "c"), (3, None, None, None),
            (None, 0, "user", "x"), (4, 0, "user", "long " * 200_000)]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string")
    plain = rows(chat.collapse(df))
    assert rows(chat.collapse(clashing(df))) == plain and len(plain) == 3
    assert chat.collapse(df.limit(0)).count() == 0


@pytest.mark.parametrize("odd", [False, True])
def test_pipeline_stages(spark, benchmark, tmp_path, odd):
    benchmark.write.parquet(str(tmp_path / "benchmark.parquet"))
    df = spark.createDataFrame(documents(), DOC)
    docs = clashing(df) if odd else df.limit(0)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    left = {r.doc_id for r in docs.select("doc_id").distinct().collect()}
    # 10 is a copy of 0, 11 a near copy of 1, 3 holds the item, texts without a letter have no language
    assert left == ({0, 1, 2, 4, 5, 14} if odd else set())
