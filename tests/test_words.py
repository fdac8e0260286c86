"""Words cut in the tasks (F11, F12, F13, F17, F18, F20, F21): equal to the JVM's
patterns, and no row, lambda or join a word."""

import hashlib

import pytest
from pyspark.sql import functions as F

from quarry.functions.text import WORD_1PLUS, WORD_2PLUS, word_tokens
from quarry.functions.words import word_lists, words_source
from quarry.operators import bm25, models
from quarry.operators.passages import containing_documents

TEXTS = ["", " ", "a", "é", "_", "aé b 12 x", "Straße ÀÉ naïve_9", "İx i", "ΑΣ Σ b", "中文 字", "x’y zz", "a" * 50,
         "".join(map(chr, range(1, 0x300))), None, "ab\ncd-ef"]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("pattern", [WORD_1PLUS, WORD_2PLUS, "[a-z]+"])
def test_words_equal_the_pattern(spark, pattern):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "i long, t string")
    low = F.lower(F.coalesce("t", F.lit("")))
    rows = df.select(words_source(low, pattern).alias("s"), word_tokens("t", pattern).alias("w")).toArrow().combine_chunks()
    source, want = rows["s"].chunk(0), rows["w"].to_pylist()
    assert word_lists(source, pattern).to_pylist() == want
    assert word_lists(source.slice(3, 7), pattern).to_pylist() == want[3:10]


def test_hash_encoder_sums_digits_without_a_lambda_a_word(spark):
    df = spark.createDataFrame([(1, "Aa bb aa c"), (2, None), (3, "中文 aa")], "doc_id long, content string")
    for dims in (1, 5, 8):
        out = models.embed_documents(df, models.HashEncoder(dims))
        assert "lambda" not in plan(out)
        for d, words in ((1, ["aa", "bb", "aa"]), (2, []), (3, ["中文", "aa"])):
            digits = [[int(c, 16) for c in hashlib.md5(w.encode()).hexdigest()[:dims]] for w in words]
            want = [float(sum(x)) for x in zip(*digits, strict=True)] if words else [0.0] * dims
            assert out.filter(F.col("doc_id") == d).first()["embedding"] == want


def test_counts_in_the_tasks_equal_the_join(spark):
    docs = spark.createDataFrame([(1, "aa bb aa"), (2, "bb 中文"), (2, "bb"), (3, None), (4, "")], "doc_id long, content string")
    terms = spark.createDataFrame([("aa",), ("bb",), ("中文",), ("none",)], "term string")
    few, many = (bm25.corpus_counts(docs, terms, max_broadcast_rows=n) for n in (100, 0))
    assert "Generate" not in plan(few)
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, many.collect())) == [
        ("", 4, 6), ("aa", 1, 3), ("bb", 3, 6), ("中文", 1, 2)]


def test_passages_of_all_lengths_read_the_texts_once(spark):
    docs = spark.createDataFrame([(1, "zero one two three four five six seven eight nine ten"), (2, "one two"),
                                  (3, "xone two threey"), (4, None), (5, "ero one two three 中文 four")],
                                 "doc_id long, content string")
    passages = spark.createDataFrame(
        [(1, "ero one two thr"), (2, "one two three four five six seven eight nine te"), (3, "one two"),
         (4, "two three 中文 fo"), (5, "no such words here"), (6, None)], "query_id long, passage string")
    want = [(1, 1), (1, 5), (2, 1), (3, 1), (3, 2), (3, 3), (3, 5), (4, 5)]
    for rows in (100, 0):
        out = containing_documents(docs, passages, max_broadcast_rows=rows)
        assert sorted(map(tuple, out.collect())) == want
