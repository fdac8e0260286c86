"""The pipeline against the stages' brute-force versions, and awkward tables."""

import random

import corpus_pipeline as P
import test_decontaminate as decon
import test_jaccard as jaccard
import test_language_lines as lines
from test_tokens_packing import PLAIN, crc

from quarry.llm.packing import CAPACITY, END_ID
from quarry.session import shared_dir

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def tables(spark):
    rng = random.Random(9)
    real = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
    rows = list(enumerate(real))
    for i in range(40):
        w = rng.choice(real).split(" ")
        w[rng.randrange(len(w))] = "edited"
        rows.append((1000 + i, " ".join(w)))
    rows += [(2000 + i, f"{rng.choice(real)}\n{rng.choice(bench)[1]}") for i in range(20)]
    rows += [(3000 + i, real[5]) for i in range(10)] + [(4000, None), (4001, ""), (4002, "ok"), (5, real[5])]
    rows += [(5000, " ".join(chr(rng.randint(0x2500, 0x9000)) * 3 for _ in range(300)))]
    df = spark.createDataFrame([(i, t, "en" if i < 5000 else None, f"src{i % 3}", len(t or "")) for i, t in rows], SCHEMA)
    path = shared_dir(spark, "pipeline_tables")
    df.repartition(5).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, rows, bench


def test_run_matches_brute_force(spark):
    path, rows, bench = tables(spark)
    got = P.run(spark, path).collect()
    kept = [(i, t) for i, t in rows if i != 5000]  # no known language
    kept = [(i, t) for i, n, gone, t in lines.brute(kept) if not gone or gone < n]
    classes = {(i, c) for i, _, c in jaccard.brute(kept)}
    kept = {i: t for i, t in kept if (i, i) in classes}
    hit = {d for d, *_ in decon.brute(list(kept.items()), bench)}
    assert hit and 5000 not in kept
    kept = {i: t for i, t in kept.items() if i not in hit}
    by_doc, by_seq = {}, {}
    for r in got:
        by_doc.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
        by_seq.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    want = {}
    for i, t in kept.items():
        ids = PLAIN.encode(t or "", add_special_tokens=False).ids + [END_ID]
        want[i] = [(k, a, len(ids[a:a + CAPACITY]), crc(ids[a:a + CAPACITY]))
                   for k, a in enumerate(range(0, len(ids), CAPACITY))]
    assert {i: sorted(p) for i, p in by_doc.items()} == want
    for seq in by_seq.values():
        seq.sort()
        assert [o for o, _ in seq] == [sum(n for _, n in seq[:k]) for k in range(len(seq))]
        assert sum(n for _, n in seq) <= CAPACITY
    total = sum(r["length"] for r in got)
    assert len(by_seq) <= -(-total // CAPACITY) + 1


def test_stages_keep_columns_and_take_empty_tables(spark):
    path, _, _ = tables(spark)
    docs = P.read_table(spark, path, "documents")
    empty = docs.limit(0)
    for _, stage in P.STAGES[:-1]:
        out = stage(spark, empty, path)
        assert out.columns == docs.columns and out.count() == 0
    assert P.STAGES[-1][1](spark, empty, path).count() == 0
    assert [n for n, _ in P.STAGES] == ["language_id", "line_dedup", "jaccard_join", "decontamination", "packing"]
