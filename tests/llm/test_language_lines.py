"""Operators 2 and 3: held-out accuracy and fusion; chunks against a plain walk."""

import hashlib
import math
import random

import pyarrow as pa
from pyspark.sql import functions as F

from quarry.llm import language as L
from quarry.llm import line_dedup as D
from quarry.llm.common import TEXT_BATCH_ROWS, pinned

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy_and_unknown(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("half", F.pmod(F.xxhash64("text"), F.lit(2)))
    model = L.train(docs.filter("half = 0"))
    rng = random.Random(2)
    noise = ["".join(chr(rng.randint(0x2500, 0x9000)) for _ in range(300)) for _ in range(20)]
    rows = L.document_evidence(docs.filter("half = 1").withColumn("lang", F.lit(None).cast("string")))
    junk = spark.createDataFrame([(10_000 + i, t, "xx", "src1") for i, t in enumerate(noise)],
                                 "doc_id long, text string, lang string, source string")
    got = L.identify(rows.unionByName(L.document_evidence(junk)), model).join(
        docs.select("doc_id", "lang", F.length("text").alias("size")), "doc_id", "left").collect()
    known = [r for r in got if r["doc_id"] < 10_000]
    assert sum(r["language"] == r["lang"] for r in known) >= 0.98 * len(known)
    assert all(r["kept"] for r in known)
    assert not any(r["kept"] for r in got if r["doc_id"] >= 10_000)


def test_every_label_is_a_class(spark):
    # 70 languages of ten words each, the later the rarer, each in a script of its own.
    rng = random.Random(6)
    words = [["".join(chr(0x1000 + 64 * k + rng.randrange(40)) for _ in range(6)) for _ in range(10)] for k in range(70)]
    rows = [(100 * k + i, " ".join(rng.choices(words[k], k=30)), f"l{k:02}", "s")
            for k in range(70) for i in range(3 if k >= 60 else 10)]
    schema = "doc_id long, text string, lang string, source string"
    docs = spark.createDataFrame(rows, schema).repartition(3)
    model = L.train(docs)
    assert model[0] == [f"l{k:02}" for k in range(70)] + [L.UNKNOWN]
    bare = L.document_evidence(docs.withColumn("lang", F.lit(None).cast("string")))
    got = {r["doc_id"]: r for r in L.identify(bare, model).collect()}
    assert [(got[i]["language"], got[i]["kept"]) for i, *_ in rows] == [(lang, True) for _, _, lang, _ in rows]
    assert L.keep_identified(docs).count() == len(rows)


def test_training_starts_no_workers_but_the_tasks(spark, monkeypatch):
    docs = [(i, f"word{i % 2} text of lang{i % 2}", f"l{i % 2}") for i in range(40)]
    docs = spark.createDataFrame(docs, "doc_id long, text string, lang string").localCheckpoint()

    def refused(*_):
        raise AssertionError("a table of rows pickled through Python workers")
    monkeypatch.setattr("pyspark.core.rdd.RDD._to_java_object_rdd", refused)
    assert L.train(docs)[0] == ["l0", "l1", L.UNKNOWN]


def test_text_batches_are_bounded(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    rows, before = spark.range(5_000, numPartitions=1).mapInArrow(sizes, "n long"), spark.conf.get(key)
    found = [r["n"] for r in pinned(rows, "sizes", TEXT_BATCH_ROWS).collect()]
    assert sum(found) == 5_000 and max(found) <= TEXT_BATCH_ROWS
    assert [r["n"] for r in pinned(rows, "sizes").collect()] == [5_000]
    assert spark.conf.get(key) == before
    spark.conf.set(key, "700")          # a smaller setting stays
    try:
        assert max(r["n"] for r in pinned(rows, "sizes", TEXT_BATCH_ROWS).collect()) == 700
    finally:
        spark.conf.set(key, before)


def test_rare_label_keeps_its_training_rows(spark, monkeypatch):
    rare = [(i, f"kvæði um skáld og ljóð {i}", "is") for i in range(20)]
    common = [(100 + i, f"the poem of the poet {i}", "en") for i in range(3000)]
    few, many = (spark.createDataFrame(rare + common[:n], "doc_id long, text string, lang string").repartition(3)
                 for n in (30, 3000))
    few, many = L.train(few, 50)[1], L.train(many, 50)[1]
    assert (few[1] == many[1]).all() and few[1].std() > 0
    # Labels sent on one by one give the same sums.
    monkeypatch.setattr(L, "HELD_LABELS", 1)
    docs = spark.createDataFrame(rare + common, "doc_id long, text string, lang string").repartition(3)
    assert (L.train(docs, 50)[1] == many).all()


def test_evidence_decides_without_text(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(600)
    model = L.train(docs)
    base = docs.filter("lang IN ('de', 'fr')").select("doc_id", "text", "lang", F.lit("q").alias("source"))
    host = base.withColumn("source", F.when(F.col("lang") == "de", "host1").otherwise("host2"))
    odd = spark.createDataFrame([(-1, None, "de", "q"), (-2, "", "fr", "q"), (-3, "", None, "host1"), (-4, "", None, "host2"),
                                 (None, None, None, None), (None, None, None, None)],
                                "doc_id long, text string, lang string, source string")
    got = L.identify(L.document_evidence(host.unionByName(odd).repartition(3)), model).collect()
    lang = {r["doc_id"]: r["language"] for r in got}
    assert [lang[i] for i in (-1, -2, -3, -4)] == ["de", "fr", "de", "fr"]
    assert len(got) == host.count() + 6 and sum(r["doc_id"] is None for r in got) == 2


def grams(text):
    raw = [b + 32 if 65 <= b <= 90 else b for b in (text or "").encode()]
    letter = [97 <= b <= 122 or b >= 128 for b in raw]
    raw = [b if k else 32 for b, k in zip(raw, letter, strict=True)]
    return [((raw[i] << 16 | raw[i + 1] << 8 | raw[i + 2]) * 0x9E3779B1 % 2 ** 32) >> (32 - L.GRAM_BITS)
            for i in range(len(raw) - 2) if sum(letter[i:i + 3]) >= 2]


def softmax(scores):
    e = [math.exp(x - max(scores)) for x in scores]
    return [x / sum(e) for x in e]


def fused(rows, classes, table):
    """Class and posterior of each (text, declared, host, domain, suffix, address), row by row."""
    n = len(classes)
    lls = [[L.TEMPER * sum(float(table[c][g]) for g in grams(r[0])) for c in range(n)] for r in rows]
    ps = [softmax(x) for x in lls]

    def total(which):
        return [sum(ps[i][c] for i in which) for c in range(n)]

    def prior(key, above, which):
        s = total(which)
        return [(s[c] + L.STRENGTH * above[c]) / (len(which) + L.STRENGTH) for c in range(n)]

    every, out = range(len(rows)), []
    world = [(s + 1) / (len(rows) + n) for s in total(every)]
    for i, row in enumerate(rows):
        suffix = prior(row[4], world, [j for j in every if rows[j][4] == row[4]])
        domain = prior(row[3], suffix, [j for j in every if rows[j][3:5] == row[3:5]])
        host = prior(row[2], domain, [j for j in every if rows[j][2:5] == row[2:5] and j != i])
        scores = [lls[i][c] + math.log(host[c]) for c in range(n)]
        for k in (1, 5):
            same, values = total([j for j in every if rows[j][k] == row[k]]), len({r[k] for r in rows})
            for c, t in enumerate(total(every)):
                scores[c] += math.log((same[c] + L.SMOOTH) / (t + L.SMOOTH * values))
        p = softmax(scores)
        out.append((classes[p.index(max(p))], max(p)))
    return out


def test_model_and_fusion_match_brute_force(spark):
    rng = random.Random(9)
    words = {"de": "der die und nicht Straße über", "fr": "le la et pas été où", "en": "the of and not was where"}
    rows = []
    for i in range(90):
        lang = rng.choice(list(words))
        text = rng.choice([None, "", "12 !?", "q", *[" ".join(rng.choices(words[lang].split(), k=rng.randint(1, 9))) for _ in range(8)]])
        host = f"{rng.choice('ab')}.{rng.choice(['x', 'y'])}.{rng.choice([lang, 'com'])}"
        rows.append((i, text, rng.choice([lang, lang, "", "xx"]), host, host[2:], host.split(".")[-1],
                     rng.choice([f"/{lang}", ".com"]), lang if i % 3 else None, f"p{i}", i * 0.5))
    df = spark.createDataFrame(rows, "doc_id long, text string, declared string, host string, domain string, suffix string, "
                                     "address string, lang string, p string, ll double").repartition(5)
    df = df.withColumns({"sums": F.lit(1), "rows": F.lit(2), "above": F.lit("c"), "given": F.lit("g"), "kept": F.lit("no")})
    classes, table = L.train(df)
    assert classes == ["de", "en", "fr", L.UNKNOWN]
    for c, lang in enumerate(classes[:-1]):
        n = [L.SMOOTH] * (1 << L.GRAM_BITS)
        for r in rows:
            for g in grams(r[1]) if r[7] == lang else ():
                n[g] += 1
        whole = sum(n)
        assert max(abs(math.log((1 - L.MIXED) * x / whole + L.MIXED / len(n)) - t) for x, t in zip(n, table[c], strict=False)) < 1e-5
    got = sorted(L.identify(df, (classes, table)).collect())
    want = fused([r[1:7] for r in rows], classes, table)
    assert [(r["doc_id"], r["p"], r["ll"], r["above"], r["given"]) for r in got] == [(r[0], r[8], r[9], "c", "g") for r in rows]
    assert [r["language"] for r in got] == [w[0] for w in want]
    assert max(abs(r["posterior"] - w[1]) for r, w in zip(got, want, strict=True)) < 1e-6
    assert [r["kept"] for r in got] == [w[0] != L.UNKNOWN for w in want]


def test_a_rejected_row_does_not_take_its_like(spark, monkeypatch):
    # Rows of one id and text, judged apart by their sources.
    docs = spark.createDataFrame([(1, "t", None, "good", "h"), (1, "t", None, "bad", "h"), (None, None, None, "bad", None),
                                  (None, None, None, None, None)],
                                 "doc_id long, text string, lang string, source string, __row_hash string")
    monkeypatch.setattr(L, "identify", lambda rows, model: rows.withColumn("kept", F.col("host") != "bad"))
    kept = L.keep_identified(docs)
    assert kept.columns == docs.columns
    assert sorted(kept.collect(), key=str) == sorted([docs.collect()[0], docs.collect()[3]], key=str)


def test_line_dedup_keeps_clashing_columns(spark):
    text = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(1, text + "\na", "x"), (2, "b\n" + text, "y")], "doc_id long, text string, __all string")
    docs = docs.withColumns({c: F.col("__all") for c in ("__text_hash", "__kept", "__gone", "__doc_id", "__lines")})
    got = D.remove_repeated(docs, "n", "went").orderBy("doc_id").collect()
    assert [(r["text"], r["n"], r["went"]) for r in got] == [(text + "\na", 2, 0), ("b", 2, 1)]
    assert all(r[c] == r["__all"] == "xy"[i] for i, r in enumerate(got) for c in docs.columns[2:])


def test_hot_chunk_is_dealt_over_salts(spark, monkeypatch):
    hot, rows = "one\ntwo", [(i, f"one\ntwo\n{'x' * i}\nend {i}") for i in range(60)]
    rows += [(100 + i, hot) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    whole = sorted(D.repeated_chunks(docs).collect())
    monkeypatch.setattr(D, "SALT_ROWS", 7)
    assert sorted(D.repeated_chunks(docs).collect()) == whole and len(whole) >= 199


def test_unlabelled_and_empty(spark):
    df = spark.createDataFrame([(1, "a b", None, "s"), (1, "a b", None, "s")], "doc_id long, text string, lang string, source string")
    assert [r["language"] for r in L.identify(L.document_evidence(df), L.train(df)).collect()] == [None, None]
    assert L.keep_identified(df).collect() == df.collect() and L.keep_identified(df.limit(0)).count() == 0


def test_page_evidence(spark):
    rows = [(1, "https://u@M.Example.DE:80/fr?x", "<HTML class=a lang='DE-at'><style>p{}</style><p>Hallo &amp; Welt<!-- x -->"),
            (2, None, None), (3, "nonsense", "<html lang=>x")]
    got = [tuple(r) for r in L.page_evidence(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()]
    assert got[0] == (1, " Hallo Welt ", "de", "m.example.de", "example.de", "de", "/fr")
    assert got[1][2:] == ("", "", "", "", ".") and got[2][2] == ""


def line_hash(line):
    return int(hashlib.md5(line.encode()).hexdigest()[:8], 16)


def chunks(lines):
    n, h, out, first = len(lines), [line_hash(x) for x in lines], [], 0
    cut = [i >= 1 and ((h[i - 1] % D.MODULUS) * D.BASE + h[i]) % D.MODULUS % D.MEAN_LINES == 0 for i in range(n)]
    for i in range(n):
        if i == n - 1 or 1 <= i <= n - 3 and cut[i] and not cut[i - 1]:
            if i > first:
                out.append((first, i + 1 - first))
            first = i + 1
    return out + [(i, 1) for i, x in enumerate(lines) if x.count(" ") >= D.LONG_WORDS]


def brute(rows):
    """(doc_id, lines, removed, text) of each row."""
    first = {}
    for i, t in rows:
        if t is not None:
            lines = t.split("\n")
            for a, n in chunks(lines):
                place = (i is not None, i or 0, a)
                text = "\n".join(lines[a:a + n])
                first[text] = min(first.get(text, place), place)
    out = []
    for i, t in rows:
        lines = [] if t is None else t.split("\n")
        gone = {k for a, n in chunks(lines) for k in range(a, a + n)
                if first["\n".join(lines[a:a + n])] != (i is not None, i or 0, a)}
        text = None if t is None else "\n".join(x for k, x in enumerate(lines) if k not in gone)
        out.append((i, len(lines), len(gone), text))
    return sorted(out, key=str)


def test_line_dedup_matches_plain_walk(spark, monkeypatch):
    rng = random.Random(4)
    pool = [f"line {i} é" for i in range(60)]
    passage = [f"shared {i}" for i in range(12)]
    long = " ".join(f"w{i}" for i in range(70))
    rows = []
    for i in range(200):
        lines = [f"own {i} {j}" for j in range(rng.randint(0, 6))]
        if i % 3 == 0:
            lines += passage + [f"tail {i}"]
        lines += [rng.choice(pool) for _ in range(rng.randint(0, 5))]
        if i % 5 == 0:
            lines.insert(rng.randint(0, len(lines)), long)
        rows.append((i, "\n".join(lines)))
    rows += [(500, rows[0][1]), (0, rows[0][1]), (None, rows[3][1]), (501, None), (502, ""), (503, "\n\n\n\n"), (504, long),
             (505, "\n".join(f"deep {j}" for j in range(5000))), (506, "\n".join(f"deep {j}" for j in range(2, 5000)))]
    df = spark.createDataFrame([(i, t, "h", 1) for i, t in rows], "doc_id long, text string, h string, first int").repartition(4)
    want = brute(rows)
    assert sum(r[2] for r in want) > 3000
    for bound in (D.BROADCAST_ROWS, 1):
        monkeypatch.setattr(D, "BROADCAST_ROWS", bound)
        out = D.remove_repeated(df)
        assert out.columns == [*df.columns, "__lines", "__removed"]
        got = [(r["doc_id"], r["__lines"], r["__removed"], r["text"]) for r in out.collect()]
        assert sorted(got, key=str) == want
    assert D.remove_repeated(df.limit(0)).count() == 0
    plan = D.remove_repeated(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
