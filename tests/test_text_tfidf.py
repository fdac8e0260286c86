"""Tokenizers, TF-IDF and word-vector goldens."""

from pyspark.sql import functions as F

from quarry.functions.text import (bigrams, clean_words, explode_values, render_prompt,
                                   strip_punctuation, vectorizer_terms, word_tokens)
from quarry.operators import tfidf, vectors


def test_clean_words_awkward(spark):
    df = spark.createDataFrame([("Hello, world! a_b c\\d x2y 42 naïve  Übung",)], "t string")
    words = df.select(clean_words("t").alias("w")).first().w
    # punctuation (not the backslash) -> space, digit words dropped, lower-cased
    assert words == ["hello", "world", "a", "b", "c\\d", "naïve", "übung"]


def test_punctuation_keeps_backslash(spark):
    df = spark.createDataFrame([("a\\b;c",)], "t string")
    assert df.select(strip_punctuation("t").alias("x")).first().x == "a\\b c"


def test_word_tokens_two_plus(spark):
    df = spark.createDataFrame([("I am a Robot_X, ça va?",)], "t string")
    assert df.select(word_tokens("t").alias("x")).first().x == ["am", "robot_x", "ça", "va"]


def test_vectorizer_terms_and_bigrams(spark):
    df = spark.createDataFrame([(1, "the robot robot vision system"), (2, "one"), (3, None)],
                               "doc_id long, content string")
    got = {r.doc_id: r.terms for r in vectorizer_terms(df).collect()}
    assert got[1] == ["robot", "robot", "vision", "system", "robot robot", "robot vision", "vision system"]
    assert got[2] == ["one"]
    assert got[3] == []
    one = spark.createDataFrame([(["x"],)], "a array<string>")
    assert one.select(bigrams("a").alias("b")).first().b == []


def test_explode_values_skips_empty(spark):
    df = spark.createDataFrame([(1, ["a", "b"]), (2, [])], "id long, a array<string>")
    rows = explode_values(df, "a", "v", keep=["id"], pos="pos").collect()
    assert [(r.id, r.pos, r.v) for r in rows] == [(1, 0, "a"), (1, 1, "b")]


def test_smooth_idf_golden(spark, toy_docs):
    tf = tfidf.term_frequency(toy_docs)
    idf = {r.term: round(r.idf, 6) for r in tfidf.smooth_idf(tf, 3).collect()}
    assert idf["robot"] == 1.287682
    assert idf["vision"] == 1.693147


def test_tfidf_row_golden(spark, toy_docs):
    w = {r.term: round(r.weight, 6) for r in tfidf.tfidf(toy_docs).filter("doc_id = 2").collect()}
    assert w["robot"] == 0.562443
    for t in ["vision", "system", "robot robot", "robot vision", "vision system"]:
        assert w[t] == 0.369772


def test_word_vector_mean_golden(spark, toy_docs):
    wv = spark.createDataFrame([("robot", [1.0, 0.0]), ("vision", [0.0, 1.0]), ("system", [2.0, 2.0])],
                               "word string, vector array<double>")
    emb = {r.doc_id: [round(x, 5) for x in r.embedding]
           for r in vectors.word_vector_embed(toy_docs, wv, stop_words=[]).collect()}
    assert emb[2] == [1.0, 0.59499]
    assert emb[3] == [0.0, 0.0]        # no word in the model: zeros


def test_prompt(spark):
    df = spark.createDataFrame([("Why?",)], "q string")
    p = df.select(render_prompt("q").alias("p")).first().p
    assert p.endswith("Question: Why?    Paragraph:")


def _plain_tfidf(rows):
    """Weights term by term, for (id, terms) rows; the rows of an id count together."""
    import math
    from collections import Counter, defaultdict

    tf = defaultdict(Counter)
    for i, terms in rows:
        tf[i].update(terms)
    df = Counter(t for c in tf.values() for t in c)
    w = {(i, t): n * (math.log((len(rows) + 1) / (df[t] + 1)) + 1) for i, c in tf.items() for t, n in c.items()}
    norm = {i: math.sqrt(sum(w[i, t] ** 2 for t in c)) for i, c in tf.items()}
    return {k: round(v / norm[k[0]], 9) for k, v in w.items()}


def test_tfidf_in_blocks_ships_no_pairs(spark):
    words = ["robot", "vision", "leaf", "solar", "arm", "zebra"]
    rows = [(i // 2 if i < 6 else i, " ".join(words[(i * k + k) % 6] for k in range(1, 9))) for i in range(30)]
    rows += [(None, "robot leaf"), (None, "leaf leaf"), (77, None), (78, ""), (79, "only here")]
    docs = spark.createDataFrame(rows, "doc_id long, content string").repartition(3)
    terms = [(r.doc_id, r.terms) for r in tfidf.doc_terms(docs, stop_words=[]).collect()]
    want = _plain_tfidf(terms)
    for block_bytes in (1 << 20, 100):
        out = tfidf.tfidf(docs, stop_words=[], block_bytes=block_bytes)
        got = out.collect()
        assert {(r.doc_id, r.term): round(r.weight, 9) for r in got} == want and len(got) == len(want)
    # Shuffled are the texts and a row for each block and term, never (doc, term) rows.
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Generate" not in plan and "Aggregate" not in plan


def test_counts_inside_the_row(spark):
    docs = spark.createDataFrame([(1, "bb aa bb"), (2, "cc"), (3, ""), (4, None)], "doc_id long, content string")
    out = tfidf.term_frequency(docs, ngrams=False, stop_words=[])
    assert sorted(map(tuple, out.collect())) == [(1, "aa", 1), (1, "bb", 2), (2, "cc", 1)]
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    # Rows of one id, or of none, count together.
    twice = docs.unionByName(docs).unionByName(spark.createDataFrame([(None, "aa"), (None, "aa")], docs.schema))
    got = tfidf.term_frequency(twice, ngrams=False, stop_words=[]).collect()
    assert sorted((str(r.doc_id), r.term, r.tf) for r in got) == [
        ("1", "aa", 2), ("1", "bb", 4), ("2", "cc", 2), ("None", "aa", 2)]
