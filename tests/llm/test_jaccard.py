"""Operator 5 against all pairs of exact shingle sets."""

import random

import pytest

from quarry.llm import components as CC
from quarry.llm import jaccard_join as J
from quarry.llm.shingles import spelt_shingles, words_of


def find(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


def brute(rows):
    sets = [(i, spelt_shingles(words_of(t))) for i, t in rows]
    ids = sorted({i for i, _ in sets if i is not None})
    parent = {i: i for i in ids}
    named = [(i, s) for i, s in sets if i is not None and s]
    for x, (a, s) in enumerate(named):
        for b, t in named[:x]:
            if 4 * min(len(s), len(t)) >= 3 * max(len(s), len(t)):
                both = len(s & t)
                if 4 * both >= 3 * (len(s) + len(t) - both):
                    ra, rb = find(parent, a), find(parent, b)
                    parent[max(ra, rb)] = min(ra, rb)
    return sorted(((i, len(s), find(parent, i) if i is not None else None) for i, s in sets), key=str)


def corpus(seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    prose = lambda n: [rng.choice(vocab) for _ in range(n)]
    rows, line = [], prose(60)
    bases = [prose(rng.choice([3, 6, 20, 60, 150])) for _ in range(25)]
    big = prose(90)
    for i in range(420):
        kind = rng.random()
        if kind < 0.3:  # one large group of near copies, chained by edits
            w = list(big)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
        elif kind < 0.6:
            w = list(rng.choice(bases))
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
        elif kind < 0.8:  # mostly a common passage
            w = prose(rng.randint(0, 25)) + line + prose(rng.randint(0, 5))
        else:
            w = prose(rng.randint(0, 120))
        rows.append((i, rng.choice([" ", "\n", "  "]).join(w)))
    rows += [(500, rows[0][1]), (0, rows[0][1]), (None, rows[0][1]), (501, None), (502, ""), (503, " \t"), (504, "A"),
             (505, "a"), (506, "É a"), (507, "é a"), (508, "w1 w2 w3 w4"), (509, "w1 W2 w3 w4")]
    rows.append((510, " ".join(prose(20_000))))
    return rows


@pytest.mark.parametrize(("seed", "few"), [(1, J.OPEN_PAIRS_PER_ROW), (2, 0.01)])
def test_matches_all_pairs(spark, monkeypatch, seed, few):
    monkeypatch.setattr(J, "OPEN_PAIRS_PER_ROW", few)
    monkeypatch.setattr(J, "PER_PIVOT", 16)
    rows = corpus(seed)
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, n int, component int")
    got = J.jaccard_classes(df.repartition(4)).select("doc_id", "n_shingles", "component_id").collect()
    want = brute(rows)
    assert len({c for _, _, c in want}) < 250
    assert sorted((tuple(r) for r in got), key=str) == want


def test_id_with_two_texts_and_empty(spark):
    rows = [(1, "a b c d e f"), (1, "u v w x y z"), (2, "a b c d e f"), (3, "u v w x y z"), (4, "other")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"], r["component_id"]) for r in J.jaccard_classes(df).collect())
    assert got == [(1, 1), (1, 1), (2, 1), (3, 1), (4, 4)]
    assert J.jaccard_classes(df.limit(0)).count() == 0


def test_texts_of_one_id_link_in_any_row_order(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(40)) for x in "ab")
    near = b.rsplit(" ", 1)[0] + " edited"
    for rows in ([(1, a), (1, b), (2, near)], [(1, b), (1, a), (2, near)]):
        df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
        assert {r["component_id"] for r in J.jaccard_classes(df).collect()} == {1}


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 140)] + [(9, 9), (300, 200), (200, 300)]
    df = spark.createDataFrame(links, "a long, b long")
    got = dict(tuple(r) for r in CC.components(df).collect())
    assert got == {i: 0 for i in range(61)} | {i: 100 for i in range(100, 140)} | {200: 200, 300: 200}


def test_prefix_rows_are_narrow_and_unpack(spark):
    """op5's disk: a prefix row is three numbers on its way to its group."""
    import numpy as np
    import pyarrow as pa

    from quarry.llm import jaccard_join as J
    from quarry.llm.shingles import distinct_sets

    words = " ".join(f"w{i}" for i in range(40))
    counts = np.ones(1 << J.BUCKET_BITS, np.int64)
    sets = distinct_sets(pa.array([words]))[0]
    counts[J._bucket(sets[-1:])] = 9
    buckets = spark.sparkContext.broadcast((counts, 4.0))
    batch = pa.RecordBatch.from_pydict({"doc_id": [7, 8], "text": [words, words]})
    out = pa.Table.from_batches(J._prefixes(buckets, distinct_sets)(iter([batch])))
    assert out.column_names == ["token", "id", "place"] and max(out["token"].to_pylist()) < 1 << J.TOKEN_BITS
    rows = J._groups(spark.createDataFrame(out.to_pandas())).collect()
    length = len(sets) - (3 * len(sets) + 3) // 4 + 1
    assert sorted((r["id"], r["n"], r["pos"]) for r in rows) == [(i, len(sets), p) for i in (7, 8) for p in range(length)]
    # A hot shingle's row stays even when its group has no other document.
    hot = spark.createDataFrame([(5, 1, ~((3 << 32) | 2)), (6, 1, (3 << 32) | 1)], "token long, id long, place long")
    assert [tuple(r) for r in J._groups(hot).collect()] == [(5, 1, 3, 2)]


def test_documents_meet_on_the_first_shingles_they_share(spark):
    """The pipeline's check: a group's pairs came up once for each shingle they share."""
    # Documents 1 to 6 share prefix shingles 100 to 109, in place 5 to 14; 1 and 2 have 50 too.
    rows = [(t, i, 80, t - 95) for i in range(1, 7) for t in range(100, 110)] + [(50, 1, 80, 3), (50, 2, 80, 4)]
    df = spark.createDataFrame(rows, "token long, id long, n int, pos int")
    listed = J.pinned(J._listed(df), "listed")
    needed = J.pinned(J._needed(listed), "needed")
    assert sorted({r["token"] for r in needed.collect()}) == [50, 100]
    once = {(r["id"], r["token"]): r["earlier"] for r in J._once(needed).collect()}
    assert once[1, 50] == [] and once[1, 100] == [50] == once[2, 100] and once[3, 100] == []


@pytest.mark.parametrize("few", [0.01, 1e9])
def test_families_of_far_copies_match_all_pairs(spark, monkeypatch, few):
    monkeypatch.setattr(J, "OPEN_PAIRS_PER_ROW", few)
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(3000)]
    rows = []
    for _ in range(6):  # few edits link, more do not; lengths from 3/4 to 4/3 of the base
        base = [rng.choice(vocab) for _ in range(rng.choice([30, 120, 300]))]
        for _ in range(40):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 18))):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            cut = rng.randint(0, len(w) // 3)
            w = w[cut:] if rng.random() < 0.3 else w + [rng.choice(vocab) for _ in range(cut if rng.random() < 0.3 else 0)]
            rows.append((len(rows) if rng.random() < 0.8 else rng.randrange(240), " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for by_length in (False, True):
        got = J.jaccard_classes(df.repartition(4), by_length=by_length).select("doc_id", "n_shingles", "component_id")
        want = brute(rows)
        assert 20 < len({c for _, _, c in want}) < 200
        assert sorted((tuple(r) for r in got.collect()), key=str) == want
