"""CSV round trip, pages, prep, validation, passages, store reuse."""

from pyspark.sql import functions as F

from quarry.operators import models, prep
from quarry.operators.passages import containing_documents
from quarry.plans.search import get_or_create_embeddings
from quarry.session import shared_dir
from quarry.sources import files, pages


def test_awkward_csv_roundtrip(spark):
    rows = [("Title, with \"quote\"", "line1\nline2", "http://h/1/", None),
            ("Missing", None, "http://h/2/", "http://h/doc.pdf"),
            ("  padded  ", "  spaces kept  ", "http://h/3/", None)]
    df = spark.createDataFrame(rows, files.PAPERS_SCHEMA)
    path = shared_dir(spark, "test_csv")
    files.write_papers(df, path)
    files.write_papers(df.limit(1), path)        # exists: skipped
    back = files.read_papers(spark, path)
    assert sorted(map(tuple, back.collect()), key=str) == sorted(rows, key=str)


def test_unique_and_filters(spark):
    df = spark.createDataFrame([("t1", "b"), ("t1", "a"), ("t2", None), ("t3", "c")],
                               "title string, abstract string")
    kept = prep.drop_missing(df, "abstract")
    first = prep.unique_by(kept, ["title"], ["abstract"])
    assert sorted(map(tuple, first.collect())) == [("t1", "a"), ("t3", "c")]
    assert prep.keep_in(df, "title", ["t2", "t3"]).count() == 2
    vals = spark.createDataFrame([("t3",)], "v string")
    assert prep.keep_in(df, "title", vals).count() == 1


def test_validate_documents(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c"), (3, " \t\n "), (4, None)],
                                 "doc_id long, content string")
    emb = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0]), (3, [0.0, 1.0]), (4, None)],
                                "doc_id long, embedding array<float>")
    got = {r.rule: r.n for r in prep.validate_documents(docs, emb).collect()}
    assert got == {"null_id": 1, "null_or_blank_content": 2, "duplicate_id": 2, "wrong_length_vector": 2}


def test_select_method_unknown(spark):
    df = spark.createDataFrame([("a", 1)], "method string, x int")
    try:
        prep.select_method(df, "b")
        raise AssertionError("expected ValueError")
    except ValueError:
        pass


def test_extract_pages(spark):
    html = ('<html><head><script>var t="</p>";</script></head><body><!-- c --><article>'
            '<h1> Hello &amp; world\r\n</h1><p>first<p>second &quot;x&quot;\r\ny</p><p>third'
            '<a href="https://h/files/9/doc.pdf">d</a></article></body></html>')
    df = spark.createDataFrame([(1, "https://h/a/b?c", html), (2, "http://h/x", "<article><h1>T</h1><p>only</article>")],
                               "page_id long, url string, html string")
    got = {r.page_id: r for r in pages.extract_pages(df).collect()}
    assert got[1].title == "Hello & world"
    assert got[1].abstract == 'second "x" y'
    assert got[1].document_url == "https://h/files/9/doc.pdf"
    assert got[1].webpage_url == "https://h/1/"
    assert got[2].abstract is None and got[2].document_url is None
    links = pages.extract_links(df).collect()
    assert [(r.pos, r.target_id) for r in links] == [(0, "9")]


def test_containing_documents(spark):
    docs = spark.createDataFrame([(1, "xx the quick brown fox jumps yy"), (2, "the quick brown cat"),
                                  (3, "prefix-the quick brown fox jumps")], "doc_id long, content string")
    ps = spark.createDataFrame([(10, "he quick brown fox jump")], "query_id long, passage string")
    got = sorted(tuple(r) for r in containing_documents(docs, ps).collect())
    assert got == [(10, 1), (10, 3)]


def test_store_reuse(spark):
    enc = models.hash_encoder()
    path = shared_dir(spark, "test_store")
    docs = spark.createDataFrame([(1, "alpha beta"), (2, "gamma")], "doc_id long, content string")
    first = get_or_create_embeddings(docs, enc, path, "hash")
    assert {r.doc_id: r.reused for r in first.collect()} == {1: False, 2: False}
    docs2 = spark.createDataFrame([(1, "alpha beta"), (2, "changed"), (3, "new")], "doc_id long, content string")
    second = {r.doc_id: r.reused for r in get_or_create_embeddings(docs2, enc, path, "hash").collect()}
    assert second == {1: True, 2: False, 3: False}
    forced = {r.doc_id: r.reused for r in get_or_create_embeddings(docs2, enc, path, "hash", force=True).collect()}
    assert forced == {1: False, 2: False, 3: False}


def test_store_rejects_duplicate_ids(spark):
    rows = spark.createDataFrame([("m", 1, "h", [1.0]), ("m", 1, "h2", [2.0])],
                                 "method string, doc_id long, content_hash string, embedding array<float>")
    try:
        files.save_embeddings(rows, shared_dir(spark, "test_dup"))
        raise AssertionError("expected ValueError")
    except ValueError:
        pass


def test_dedup_by_content(spark):
    docs = spark.createDataFrame([(5, "same"), (2, "same"), (3, "other"), (4, None), (1, "Same")],
                                 "doc_id long, content string")
    got = sorted(map(tuple, prep.dedup_by_content(docs).collect()))
    assert got == [(1, "Same"), (2, "same"), (3, "other")]
