"""Operators 4 and 7: ids against the tokenizer, exact read-back, packing laws."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quarry.llm import packing as P
from quarry.llm import token_files as T
from quarry.llm.tokens import WordTokenizer, word_tokenizer
from quarry.session import shared_dir

PLAIN = Tokenizer.from_file(public_tokenizers.path(T.TOKENIZER))
ODD = ["", " ", "Σσς ΑΣ á <|endoftext|> x<|startoftext|>y 'S don't I'LL ½²³ ªº İstanbul ǅ 日本語 🎉!!", "It's 12,345.67 it'd",
       "a b\x85c\x1cd\x1fe­x µªǅ\x00 .,., ... 's., a.'t", ".", "x.́ y", " a b"]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=40), st.text(alphabet="aZ.,'s tsé1 \n<|", max_size=40)), max_size=6))
def test_ids_are_the_tokenizers(texts):
    ids, counts = word_tokenizer(T.TOKENIZER).encode(pa.array(texts, pa.string()))
    want = [PLAIN.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == (want or [[]])


def test_small_cache_gives_the_same():
    texts = pa.array(ODD * 3)
    a, b = WordTokenizer(T.TOKENIZER, cache_words=2), word_tokenizer(T.TOKENIZER)
    for _ in range(2):
        assert a.encode(texts)[0].tolist() == b.encode(texts)[0].tolist()


def corpus(spark):
    real = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
            .select("doc_id", "text").limit(60).collect()]
    rows = real + [(1000 + i, t) for i, t in enumerate(ODD)] + [(2000, None), (None, "no id"), (2001, "word " * 9000),
                                                              (2001, "word " * 9000), (2002, "a " * 4095), (2003, "a " * 4096)]
    return rows, spark.createDataFrame([(i, t, 7, "x") for i, t in rows],
                                       "doc_id long, text string, piece int, ids string").repartition(5)


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_token_files_read_back(spark, encoding):
    rows, df = corpus(spark)
    path = T.write_token_files(df, shared_dir(spark, "tok"), encoding=encoding)
    got = [tuple(r) for r in T.read_documents(spark, path).mapInArrow(
        T._digest, "doc_id long, start long, n_tokens long, ids_crc32 long").orderBy("start").collect()]
    ids = {}
    for i, t in rows:
        ids.setdefault(i, []).append(PLAIN.encode(t or "", add_special_tokens=False).ids + [T.END_ID])
    at, want = 0, []
    for i in sorted(ids, key=lambda i: -1 if i is None else i):
        for x in ids[i]:
            want.append((i, at, len(x), crc(x)))
            at += len(x)
    assert got == want
    one = T.read_tokens(spark, path, [1003]).collect()
    assert [list(r["token_ids"]) for r in one] == ids[1003]
    plan = T.read_tokens(spark, path, [1003])._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "doc_id" in plan
    assert T.read_documents(spark, T.write_token_files(df.limit(0), shared_dir(spark, "tok"))).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 24), min_size=1, max_size=9))
def test_bound_and_best_fit(sizes):
    sizes = np.array(sizes)
    bins, offsets, free = P.best_fit_decreasing(sizes, 24)
    for b in range(len(free)):
        mine = sorted(zip(offsets[bins == b], sizes[bins == b], strict=True))
        assert [o for o, _ in mine] == list(np.cumsum([0] + [s for _, s in mine])[:-1])
        assert 24 - sum(s for _, s in mine) == free[b] >= 0
    assert P.lower_bound(np.bincount(sizes, minlength=25), 24) <= fewest(tuple(sorted(sizes, reverse=True)), 24) <= len(free)


def fewest(sizes, capacity, rooms=()):
    """Exact bin count by trying every bin for each item."""
    if not sizes:
        return len(rooms)
    best = fewest(sizes[1:], capacity, (*rooms, capacity - sizes[0]))
    for room in {r for r in rooms if r >= sizes[0]}:
        left = list(rooms)
        left.remove(room)
        best = min(best, fewest(sizes[1:], capacity, tuple(sorted([*left, room - sizes[0]]))))
    return best


def test_packing_laws(spark):
    rows, df = corpus(spark)
    pieces = P.pinned(P.cut_pieces(df), "pieces")
    for size in (P.PARTITION_PIECES, 20):
        packed = P.packed_pieces(pieces, partition_pieces=size).collect()
        by_doc, by_seq = {}, {}
        for r in packed:
            by_seq.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
            by_doc.setdefault(r["doc_id"], []).append((r["piece"], r["start"], list(r["ids"])))
        assert all(o == sum(n for _, n in sorted(s)[:k]) for s in by_seq.values() for k, (o, _) in enumerate(sorted(s)))
        assert max(sum(n for _, n in s) for s in by_seq.values()) <= P.CAPACITY
        for i, t in rows:
            if i == 2001 or i is None and t is None:
                continue
            found = sorted(by_doc[i])
            assert sum((x for _, _, x in found), []) == PLAIN.encode(t or "", add_special_tokens=False).ids + [P.END_ID]
            assert [(k, s) for k, s, _ in found] == [(k, k * P.CAPACITY) for k in range(len(found))]
            assert all(len(x) == P.CAPACITY for _, _, x in found[:-1])
        assert len(by_doc[2001]) == 6
        counts = np.bincount([r["length"] for r in packed], minlength=P.CAPACITY + 1)
        assert len(by_seq) <= P.lower_bound(counts, P.CAPACITY) + 1
    assert P.pack_documents(df.limit(0)).count() == 0


def test_other_tokenizer_files_encode_whole_texts():
    from tokenizers import Tokenizer, models, pre_tokenizers

    import quarry.llm.tokens as K
    assert K.follows_rules(PLAIN)
    other = Tokenizer(models.BPE({"a": 0, "b": 1, "ab": 2}, [("a", "b")]))
    other.pre_tokenizer = pre_tokenizers.Whitespace()
    assert not K.follows_rules(other)
    words = K.WordTokenizer("word_bpe_49k.json")
    words.tokenizer, words.by_word = other, False
    ids, counts = words.encode(pa.array(["ab a", None, "b ab"]))
    assert ids.tolist() == [2, 0, 1, 2] and counts.tolist() == [2, 0, 2]


def test_tasks_forget_the_tokenizer_but_for_token_tasks():
    from quarry.llm import common, tokens

    tokens.word_tokenizer("word_bpe_49k.json")
    list(common.lean(lambda b: b, tokens=True)(iter([])))
    assert tokens._LOADED
    list(common.lean(lambda b: b)(iter([])))
    assert not tokens._LOADED


def test_token_file_footers(spark):
    """Row groups, page indexes and encodings are those asked for, and a filter on ids reads pages, not files."""
    import glob

    import pyarrow.parquet as pq

    from quarry.llm import token_files as F4
    from quarry.session import shared_dir
    rows = [(i, " ".join(f"word{(i * j) % 97}" for j in range(60))) for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for encoding, wanted in (("dictionary", "RLE_DICTIONARY"), ("delta", "DELTA_BINARY_PACKED")):
        path = F4.write_token_files(df, shared_dir(spark, f"footer_{encoding}"), encoding=encoding, row_group_bytes=200_000, page_rows=100)
        files = [pq.ParquetFile(f).metadata for f in sorted(glob.glob(f"{path}/part-*.parquet"))]
        assert sum(m.num_rows for m in files) == 4000 and max(m.num_row_groups for m in files) > 1
        for m in files:
            for g in range(m.num_row_groups):
                columns = {m.row_group(g).column(c).path_in_schema.split(".")[0]: m.row_group(g).column(c) for c in range(m.num_columns)}
                found = set(columns["token_ids"].encodings)
                assert wanted in found or (wanted == "RLE_DICTIONARY" and "PLAIN_DICTIONARY" in found)
                assert columns["doc_id"].has_column_index and columns["token_ids"].has_offset_index
                stats = columns["doc_id"].statistics
                assert stats.has_min_max and stats.max - stats.min < 4000
        got = F4.read_tokens(spark, path, [7, 3999])
        assert "PushedFilters: [In(doc_id" in got._jdf.queryExecution().executedPlan().toString().replace("isnotnull(doc_id), ", "")
        assert {r["doc_id"]: list(r["token_ids"]) for r in got.collect()} == {
            i: [*PLAIN.encode(rows[i][1], add_special_tokens=False).ids, F4.END_ID] for i in (7, 3999)}
