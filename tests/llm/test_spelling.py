"""Operator 12 against every edit of every word."""

import random
import re
import zlib
from collections import Counter

import pytest

from quarry.llm import spelling as S


def is_near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + (len(a) == len(b)):] == b[i + 1:]


def brute_words(docs):
    counts = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{doc_id}:{run}".encode())
            if doc_id is not None and h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def brute(words):
    near = {w: [v for v in words if is_near(w, v)] for w in words}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-words[v], v), default=None)
        if best is not None and words[best] >= 10 * words[w]:
            form[w] = best
    out = []
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, len(near[w]), words[form[w]] if w in form else None))
    return sorted(out)


def corpus():
    rng = random.Random(12)
    stems = ["".join(rng.choice("abÀéÿZ") for _ in range(rng.randint(6, 9))) for _ in range(25)]
    def word():
        w = stems[min(int(rng.expovariate(0.4)), 24)]
        for _ in range(rng.choice([0, 0, 0, 0, 1, 1, 2])):
            i = rng.randrange(len(w))
            w = rng.choice([w[:i] + w[i + 1:], w[:i] + rng.choice("abÀéÿ") + w[i:], w[:i] + rng.choice("abÀé") + w[i + 1:]])
        return w
    docs = [(i, rng.choice([" ", "\n", "7", "_Ā"]).join(word() for _ in range(rng.choice([0, 3, 80])))) for i in range(120)]
    long = "".join(rng.choice("ab") for _ in range(30_000))
    return docs + [(500, long), (501, long[:100] + long[101:]), (502, long), (503, long[:100] + long[101:]),
                   (5, docs[5][1]), (None, docs[7][1]), (900, None), (901, ""), (902, "aaaaaaaa aaaaaaa aaaaaaaa aaaaaaa aaaaaaaaa " * 3)]


@pytest.mark.parametrize("tasks", [1, 5])
def test_variants_match_brute_force(spark, tasks):
    rows = corpus()
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, word string, n int").repartition(tasks)
    want = brute(brute_words(rows))
    assert sum(r[1] is not None for r in want) > 20 and any(r[1] != r[2] and r[1] for r in want)
    got = S.spelling_variants(S.corpus_words(docs, typo_every=31))
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert sorted(map(tuple, got.collect())) == want


def test_near_words_over_many_partitions(spark):
    rng = random.Random(3)
    words = {"".join(rng.choice("ab") for _ in range(rng.randint(0, 8))) for _ in range(250)} | {"", "a", "\U0001f600a", "\U0001f600"}
    rows = [(w, 1) for w in words] + [("abab", 4), (None, 3)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "17")
    try:
        got = S.near_words(spark.createDataFrame(rows, "word string, n long")).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    words |= {"abab"}
    want = sorted((a, b) for a in words for b in words if is_near(a, b))
    assert sorted(map(tuple, got)) == want and len(want) > 300


def test_one_letter_words_in_one_group_and_empty_table(spark):
    words = spark.createDataFrame([(chr(97 + i), 10 ** (i % 3)) for i in range(26)], "word string, n long")
    got = {r["word"]: r for r in S.spelling_variants(words).collect()}
    assert all(r["n_near"] == 25 for r in got.values())
    assert got["a"]["form"] == got["a"]["root"] == "c" and got["c"]["form"] is None
    assert S.spelling_variants(words.limit(0)).count() == 0
