"""Operator 11 against signatures read word by word and plain set similarity."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa

from quarry.llm import spotsigs as S


def chains(text):
    """The signatures of one text as tuples of words."""
    words = [re.sub(r"^[\W_]+|[\W_]+$", "", w) for w in re.split("[ \t-\r]+", (text or "").lower())]
    words = [w for w in words if w]
    out = set()
    for i, w in enumerate(words):
        if w in S.COMMON_WORDS:
            content = [v for v in words[i + 1:i + 60] if v not in S.COMMON_WORDS][:S.CHAIN]
            if len(content) == S.CHAIN:
                out.add((w, *content))
    return out or ({tuple(words)} if words else set())


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def texts(n=220, seed=11):
    rng = random.Random(seed)
    common = S.COMMON_WORDS[:12] + ["für", "más"]
    word = lambda: "".join(rng.choice("abcdéÉX") for _ in range(rng.randint(1, 4)))
    prose = lambda n: [rng.choice(common) if rng.random() < .4 else word() + rng.choice(["", "", ",", "."])
                       for _ in range(n)]
    out = []
    for _ in range(n):
        words = prose(rng.choice([0, 1, 2, 5, 40, 300]))
        if out and rng.random() < .3:
            words = rng.choice(out).split()
            for _ in range(rng.randint(0, 3)):
                if words:
                    words[rng.randrange(len(words))] = word()
        out.append(rng.choice([" ", "\n", "\t "]).join(words))
    return out + [None, "", " \n", "| | &&&", "zq", "the", "the zq", "THE zq. qz!", out[5], out[5]]


def brute(rows):
    out = []
    for i, (doc_id, text) in enumerate(rows):
        text, after = text or "", rows[(i + 1) % len(rows)][1] or ""
        half = len(text) // 2
        edited = text[:len(text) - half] + after[:half]
        sets = chains(text), chains(edited), chains(after)
        out.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), len(sets[0]), len(sets[1]),
                    round(jaccard(sets[0], sets[1]), 9), round(jaccard(sets[0], sets[2]), 9)))
    return out


def digest(df):
    return [(r["doc_id"], r["n_chars"], r["edited_sha256"], len(r["fingerprint"]) // 8, len(r["edited_fingerprint"]) // 8,
             round(r["near_edited"], 9), round(r["near_next"], 9)) for r in df.collect()]


def test_matches_brute_force_over_ranges(spark):
    rows = [(7 * i - 300, t) for i, t in enumerate(texts())]
    docs = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id int, text string, part int, k string").repartition(3)
    want = sorted(brute(rows))
    assert sum(0 < r[5] < 1 for r in want) > 50
    for range_bytes in (S.RANGE_BYTES, 4000, 300):
        got = S.compare_in_order(docs, range_bytes=range_bytes)
        assert got.columns[:7] == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
                                   "near_edited", "near_next"]
        assert sorted(digest(got)) == want
    by_text = {}
    for r, (_, t) in zip(sorted(got.collect()), rows, strict=True):
        assert by_text.setdefault(t or "", r["fingerprint"]) == r["fingerprint"]
    assert len(set(by_text.values())) > 0.9 * len({frozenset(chains(t)) for t in by_text})


def test_edited_fingerprint_is_that_of_the_edited_text(spark):
    docs = spark.createDataFrame([(1, "the cat sat of mats "), (2, "to run fast and win big")], "doc_id long, text string")
    first, second = sorted(S.compare_in_order(docs).collect())
    edited = ["the cat sat of mats "[:10] + "to run fast and win big"[:10], "to run fast and win big"[:12] + "the cat sat of mats "[:11]]
    assert [first["edited_fingerprint"], second["edited_fingerprint"]] == [
        S.spelt(s) for s in S.signature_sets(pa.array(edited))]


def test_repeated_and_null_ids_one_row_and_empty_table(spark):
    rows = [(None, "the ab cd"), (1, "of ab cd"), (1, "of ab cd"), (1, "to x y"), (None, None)] + [(2, "in the mid dle")] * 200
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = S.compare_in_order(docs, range_bytes=20)
    assert got.count() == len(rows)
    same = [r["near_next"] for r in got.filter("doc_id = 2").collect()]
    assert sorted(same)[1:] == [1.0] * 199
    one = S.compare_in_order(docs.filter("text = 'to x y'")).first()
    assert one["near_next"] == 1.0 and one["edited_sha256"] == hashlib.sha256(b"to to ").hexdigest()
    assert S.compare_in_order(docs.limit(0)).count() == 0


def test_likeness_partitions_and_prunes():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 60, rng.integers(0, 90)).astype(np.uint64)) for _ in range(400)]
    left, right = sets[:200], sets[200:]
    want = np.array([jaccard(set(a.tolist()), set(b.tolist())) for a, b in zip(left, right, strict=True)])
    assert np.allclose(S.likeness(left, right), want)
    assert np.allclose(S.likeness(left, right, 0.5), np.where(want >= 0.5, want, 0))
    assert len(S.likeness([], [])) == 0


def test_classes_match_all_pairs(spark):
    rng = random.Random(8)
    common, rows = S.COMMON_WORDS[:15], []
    for c in range(25):
        words = [rng.choice(common) if rng.random() < .4 else f"w{rng.randrange(4000)}" for _ in range(rng.choice([8, 40, 150, 400]))]
        for _ in range(rng.randint(1, 8)):
            rows.append((len(rows), " ".join(words)))
            words = list(words)
            for _ in range(rng.choice([0, 1, 2, 4])):
                words[rng.randrange(len(words))] = f"e{rng.randrange(9999)}"
    rows += [(900, None), (901, ""), (902, "zq"), (903, "zq.")]
    sets = {i: chains(t) for i, t in rows}
    root = {i: i for i in sets}
    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in sets:
        for j in sets:
            if i < j and sets[i] & sets[j] and 4 * len(sets[i] & sets[j]) >= 3 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["n_signatures"], r["class_id"]) for r in S.spot_classes(docs).collect()}
    assert got == {i: (len(s), find(i)) for i, s in sets.items()}
    assert len({c for _, c in got.values()}) < len(rows) - 20


def test_very_long_text(spark):
    long = "the " + "word of thing " * 60_000
    docs = spark.createDataFrame([(1, long), (2, "the end is near")], "doc_id long, text string")
    row = S.compare_in_order(docs).filter("doc_id = 1").first()
    assert row["n_chars"] == len(long) and row["n_signatures"] == len(chains(long[:2000]))
