"""Operator 13 against a search of every period at every word."""

import hashlib
import random
import zlib

import numpy as np

from quarry.llm import periodic as P


def runs_of(words):
    """All runs by comparing every word with the word q further on."""
    n, spans = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(12, 2 * q):
                spans.setdefault((i, j + q - i), q)   # the smallest period comes first
            i = max(j, i + 1)
    return sorted((s, k, q) for (s, k), q in spans.items())


def brute(doc_id, text):
    words = (text or "").encode().split()
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if doc_id is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = runs_of(words)
    gone = {i for s, k, q in runs for i in range(s + q, s + k)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
            hashlib.sha256("".join(f"{s},{k},{q}\n" for s, k, q in runs).encode()).hexdigest(),
            hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in gone)).hexdigest())


def texts():
    rng = random.Random(13)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randint(1, 3)))
    prose = lambda n, k=60: [f"w{rng.randrange(k)}" if rng.random() < .8 else word() for _ in range(n)]
    out = []
    for _ in range(260):
        words = prose(rng.choice([0, 3, 12, 40, 200]))
        for _ in range(rng.randint(0, 4)):
            unit = prose(rng.choice([1, 1, 2, 3, 5, 7, 8, 9, 16, 31, 33, 64, 100]), rng.choice([2, 3, 60]))
            words += unit * rng.choice([1, 2, 3, 7]) + unit[:rng.randrange(len(unit) + 1)] + prose(rng.choice([0, 1, 5]))
        out.append(rng.choice([" ", "\n", " \t", "\x0b\x0c", "\r\n"]).join(words))
    fib = ["a", "b"]
    while len(fib[-1]) < 400:
        fib.append(fib[-1] + fib[-2])
    thue = ["ab"[bin(i).count("1") & 1] for i in range(512)]
    out += [" ".join(fib[-1]), " ".join(thue), "x " * 11, "x " * 12, " x" * 13, "a b " * 6, "a b " * 5 + "a",
            "x " * 700, ("x " * 12 + "y ") * 9, "", " \n\t ", None, "A a " * 12, "a b " * 13]
    return out


def test_matches_brute_force(spark):
    rows = [(i, t) for i, t in enumerate(texts())]
    rows += [(None, "q r " * 9), (5, "x " * 40), (5, "y " * 41), (7, rows[7][1]), (7, rows[7][1])]
    docs = spark.createDataFrame([(d, t, 1, "z") for d, t in rows],
                                 "doc_id long, text string, period int, runs string").repartition(3)
    want = sorted((brute(d, t) for d, t in rows), key=str)
    assert sum(r[1] > 1 for r in want) > 50 and any(r[1] == 0 for r in want)
    got = P.collapse_runs(docs, P.repeat_plan)
    assert got.columns[:8] == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli",
                               "runs_sha256", "collapsed_sha256"]
    assert sorted((tuple(r)[:8] for r in got.collect()), key=str) == want


def test_shuffled_texts_join_without_broadcast(spark, monkeypatch):
    docs = spark.createDataFrame(list(enumerate(texts()[:40])), "doc_id long, text string").repartition(2)
    monkeypatch.setattr(P, "BROADCAST_RUNS", 0)
    got = sorted((tuple(r)[:8] for r in P.collapse_runs(docs, P.repeat_plan).collect()), key=str)
    assert got == sorted((brute(d, t) for d, t in enumerate(texts()[:40])), key=str)


def test_small_chunks_and_fragments_across_tiles():
    """Tiles solved by themselves give the same intervals however they are dealt."""
    rng = random.Random(4)
    unit = [rng.randrange(3) for _ in range(37)]
    words = np.array([7, 8] + unit * 9 + unit[:5] + [9] + [1] * 90, np.int64)
    s = P.Sequence(words, np.array([len(words)]))
    doc, q, low, high = P.fragments(s)
    got = {(int(a), int(b + c - a), int(c)) for c, a, b in zip(q, low, high)}
    assert {(s, k, p) for s, k, p in runs_of(list(words))} <= got


def test_stitch_joins_touching_fragments_only(spark):
    rows = [(1, 3, 0, 9), (1, 3, 9, 15), (1, 3, 30, 41), (1, 4, 9, 15), (1, 6, 0, 12), (2, 3, 10, 12)]
    got = P.stitch(spark.createDataFrame(rows, "doc_id long, period long, low long, high long"))
    assert sorted(map(tuple, got.collect())) == [(1, 0, 18, 3), (1, 30, 14, 3)]


def test_very_long_text_and_empty_table(spark):
    unit = " ".join(f"u{i}" for i in range(20_000))
    docs = spark.createDataFrame([(1, unit + " " + unit + " " + "z " * 60_000)], "doc_id long, text string")
    row = P.collapse_runs(docs).first()
    assert (row["n_runs"], row["length"], row["period"], row["n_kept"]) == (2, 60_000, 1, 20_001)
    assert P.collapse_runs(docs.limit(0)).count() == 0
