"""Operator 1 against a plain Python scan (re, window by window entropy)."""

import hashlib
import math
import random
import re
from collections import Counter

from quarry.llm import secrets as S

PY = [("assign", re.compile(r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?"
                            r"([A-Za-z0-9+/_.=-]+)")),
      ("access", re.compile(r"AKIA[A-Z0-9]+")), ("hex", re.compile(r"[0-9a-f]+"))]


def base_spans(text):
    out = []
    for m in PY[0][1].finditer(text):
        if len(m.group(2)) >= 6:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in PY[1][1].finditer(text) if len(m.group()) >= 20]
    out += [(m.start(), 2, m.end()) for m in PY[2][1].finditer(text) if len(m.group()) >= 24]
    return sorted(out)


def entropy_spans(text):
    rest = list(text)
    spans = [m.span() for m in PY[0][1].finditer(text)]
    spans += [(a, e) for a, k, e in base_spans(text) if k]
    for a, e in spans:
        rest[a:e] = " " * (e - a)
    out = []
    for m in re.finditer(S.CANDIDATE, "".join(rest)):
        c = m.group()
        if re.fullmatch("[0-9]+", c) or any(re.search(p, c) for p in S.SHAPES):
            continue
        kind = ("entropy_hex" if re.fullmatch("[0-9a-f]+|[0-9A-F]+", c)
                else "entropy_letters" if re.fullmatch("[A-Za-z]+", c) else "entropy_mixed")
        hot = []
        for i in range(len(c) - S.WINDOW + 1):
            n = Counter(c[i:i + S.WINDOW]).values()
            h = -sum(x / S.WINDOW * math.log2(x / S.WINDOW) for x in n)
            if h >= S.THRESHOLDS[kind] - 1e-7:
                hot.append(i)
        if hot and not any(re.search(p, c[hot[0]:hot[-1] + S.WINDOW]) for p in S.ALLOW):
            out.append((m.start() + hot[0], S.KINDS.index(kind), m.start() + hot[-1] + S.WINDOW))
    return out


def expected(text):
    base, extra = base_spans(text or ""), entropy_spans(text or "")
    write = lambda xs: ",".join(f"{S.KINDS[k]}:{a}:{e}" for a, k, e in sorted(xs))
    return hashlib.sha256(write(base).encode()).hexdigest(), write(base + extra)


def texts():
    rng = random.Random(5)
    b64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-="
    rand = lambda n, a=b64: "".join(rng.choice(a) for _ in range(n))
    out = [None, "", " ", "password: token: abcdefgh", "token=token=abcdef", "API_KEY = 'x.y-z=/+9' apikey:12345",
           "Passwd\" : \"é", "pässword=abcdefgh 🎉 secret:abcdefg🎉", "AKIAAKIA" + "A" * 16, "AKIA" + "B" * 15,
           "f" * 24 + "g" + "0" * 23, "token=" + "a1b2c3d4" * 4, "tokeN:  \"" + "ab" * 20 + "\" " + "cd" * 12,
           "123e4567-e89b-12d3-a456-426614174000", "ABCDEFABCDEF0123456789AB"[::-1] + " 0123456789" * 3,
           "Xexample" + rand(30), "a" * 5000, "path/to/some/long/directory", "9" * 40,
           "a" * 30 + rand(40), rand(40) + "a" * 40 + "sample" + "a" * 20, "sample" + "0" * 20 + rand(30), rand(25) + "sample" + rand(25),
           "é" * 30 + rand(60) + "ñ" + rand(25) + "\n" + rand(19)]
    for _ in range(60):
        parts = [rand(rng.randint(1, 70), rng.choice([b64, "0123456789abcdef", "0123456789ABCDEF", "abcdefg"]))
                 for _ in range(rng.randint(1, 6))]
        out.append(rng.choice([" ", "\n", "é", "= "]).join(
            rng.choice(["", "token=", "secret: ", "AKIA", "🎉"]) + p for p in parts))
    out.append(" ".join(rand(40, "0123456789abcdef") + " é" for _ in range(3000)))  # many matches in one text
    out.append(rand(40_000))  # one very long candidate
    return out


def test_matches_plain_scan(spark):
    rows = list(enumerate(texts())) + [(None, "password=abcdefgh")] * 2
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, base string")
    df = df.repartition(4)
    got = S.scan_secrets(df).select(
        "doc_id", S.F.sha2(S._written(S.F.col("base")), 256), S._written(S.F.concat("base", "extra"))).collect()
    want = sorted(((i, *expected(t)) for i, t in rows), key=str)
    assert sorted((tuple(r) for r in got), key=str) == want
    assert sum("entropy" in w[2] for w in want) > 20


def test_allowed_strings_and_empty_table(spark):
    word = "q9Zr7LmX2vTb8KpW4sYd"
    df = spark.createDataFrame([(1, f"see {word} here")], "doc_id long, text string")
    assert len(S.scan_secrets(df).first()["extra"]) == 1
    assert len(S.scan_secrets(df, allow_strings=(word,)).first()["extra"]) == 0
    assert S.scan_secrets(df.limit(0)).count() == 0


def test_allowed_word_beside_a_key_does_not_hide_it(spark):
    key = "q9Zr7LmX2vTb8KpW4sYdH1cF"
    texts = [key, f"sample{'a' * 20}{key}", f"{key}{'=' * 30}example", f"{key[:12]}sample{key[12:]}"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [[t[s["start"]:s["end"]] for s in r["extra"]] for t, r in zip(texts, S.scan_secrets(df).orderBy("doc_id").collect())]
    assert got[0] == [key] and got[3] == []
    assert [len(x) for x in got[1:3]] == [1, 1] and "sample" not in got[1][0] and "example" not in got[2][0]


def test_paths_of_many_segments(spark):
    texts = ["a/" * 50_000, "/" + "Ab/" * 20_000 + "c", "a/" * 9 + "/" + "a/" * 20_000, "a/" * 20_000 + "1",
             "abcdefghijklmnopqrst/", "/abcdefghijklmnopqrst/", "/a/bcdefghijklmnopqrstu", "a/b/cdefghijklmnopqrstu",
             "a//b/cdefghijklmnopqrstu", "//a/b/cdefghijklmnopqrstu", "a/" * 20_000 + "q9Zr7LmX2vTb8KpW4sYd", "qZrXLmBvTb/KpWnsYdGhJ/cF", "qZrXLmBvTb//KpWnsYdGhJ/cF"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r[0]: r[1] for r in S.scan_secrets(df).select("doc_id", S._written(S.F.concat("base", "extra"))).collect()}
    assert got == {i: expected(t)[1] for i, t in enumerate(texts)}
    assert [i for i, spans in got.items() if spans] == [10, 12] and all(p in S.SHAPES for p in S.FLAT)


def test_no_shuffle_no_python(spark):
    df = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    plan = S.scan_secrets(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
