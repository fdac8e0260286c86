"""Operator 10 against exact containment of every item in every document."""

import random

from quarry.llm import decontaminate as D
from quarry.llm.shingles import spelt_shingles, words_of


def brute(docs, items):
    out = []
    for d, text in docs:
        words = words_of(text)
        for i, item in items:
            w = words_of(item)
            want = spelt_shingles(w)
            have = spelt_shingles(words, min(len(w), 5)) if w else set()
            n = len(want & have)
            if want and 4 * n >= 3 * len(want):
                out.append((d, i, len(want), n, n / len(want)))
    return sorted(out, key=str)


def tables():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdE") for _ in range(rng.randint(1, 3)))
    prose = lambda n: " ".join(word() for _ in range(n))
    items = [(i, prose(rng.randint(1, 70))) for i in range(60)]
    items += [(100, items[3][1]), (101, ""), (102, None), (103, " \t\n"), (None, prose(30)), (104, "Ä ö x É word")]
    docs = []
    for d in range(250):
        parts = [prose(rng.choice([0, 1, 5, 40, 300]))]
        for _ in range(rng.randint(0, 3)):
            w = (rng.choice(items)[1] or "").split()
            for _ in range(rng.randint(0, 4)):  # near copies on both sides of the threshold
                if w:
                    w[rng.randrange(len(w))] = word()
            parts += [" ".join(w).upper(), prose(rng.randint(0, 9))]
        docs.append((d, rng.choice([" ", "\n", "\r\n\t"]).join(parts)))
    docs += [(5, docs[5][1]), (None, items[10][1]), (900, None), (901, ""), (902, prose(60_000) + " " + items[20][1])]
    return docs, items


def test_matches_brute_force(spark):
    docs, items = tables()
    d = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, item_id int").repartition(3)
    b = spark.createDataFrame([(i, t, 2) for i, t in items], "item_id long, text string, doc_id int")
    want = brute(docs, items)
    assert len(want) > 100 and any(r[4] < 1 for r in want)
    for block in (D.BLOCK_BYTES, 2000):
        assert sorted((tuple(r) for r in D.find_items(d, b, block_bytes=block).collect()), key=str) == want
    hit = {r[0] for r in want}
    kept = D.remove_contaminated(d, b, block_bytes=2000)
    assert kept.columns == d.columns
    assert sorted((str(r["doc_id"]) for r in kept.collect())) == sorted(str(i) for i, _ in docs if i not in hit)


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    b = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert D.find_items(d.limit(0), b).count() == 0 and D.find_items(d, b.limit(0)).count() == 0
    assert D.remove_contaminated(d, b.limit(0)).count() == 1 and D.remove_contaminated(d, b).count() == 0
