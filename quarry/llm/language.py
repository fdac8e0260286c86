"""Operator 2: language identification by Bayesian evidence fusion.

Classes are all languages of the labelled rows and ``UNKNOWN``. For a row with
text, declared language, host, domain, suffix and address mark,

    log P(class | row) = TEMPER * sum over byte trigrams log P(trigram | class)
                       + log P(declared | class) + log P(address | class)
                       + log P(class | host)

* Trigram likelihoods are counted on a sample of labelled rows, bounded label
  by label (TRAIN_ROWS each, chosen by the hash of the id), so a rare language
  keeps all its rows at every table size. They are mixed with the even
  distribution, which is ``UNKNOWN``'s. Only trigrams of letters count. Trigrams
  overlap, so their sum is tempered. A language takes 131 KB of the table that
  each task holds, and 16 bytes of each row's scores.
* P(declared | class) and P(address | class) are estimated over all rows from
  their text posteriors: grouped sums, smoothed.
* Host priors are smoothed level by level, global -> suffix -> domain -> host:
  each level's counts are joined with STRENGTH rows of the level above. They too
  are grouped sums over all rows, and a row's own share is left out of its host.

Each sum is a partial aggregate, so a host with a third of the rows sends one
row per task. A row is rejected when ``UNKNOWN`` is the likeliest class.

Defined cases: null texts are empty and are judged by the other evidence; null
evidence is the value "" (its own category); ties go to the first class in
alphabetical order, languages before ``UNKNOWN``; without labelled rows nothing
is rejected and the language is null; each input row gives one row; extra
columns of the input are kept, whatever their names, but for ``language``,
``posterior`` and ``kept``, which the result replaces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.common import (
    TEXT_BATCH_ROWS, arrow_batches, join_null_safe, lean, let, pinned, read_table, small_side, text_slices, unused)

UNKNOWN = "und"
#: Rows of each label that the trigram counts are taken from: all of them, or
#: about this many of a label with more.
TRAIN_ROWS = 20_000
#: Labels that a training task counts at once (256 KB each) before it sends them on.
HELD_LABELS = 64
#: Text bytes looked at at once; a task holds about 30 bytes for each.
GRAM_SLICE_BYTES = 512 << 10
GRAM_BITS = 15
TEMPER = 0.25
STRENGTH = 5.0
SMOOTH = 0.5
#: Share of the even distribution in every language's trigrams.
MIXED = 0.2
#: Rows of a prior or evidence table that are broadcast; beyond it a shuffle join.
BROADCAST_ROWS = 200_000
EVIDENCE = ("declared", "host", "domain", "suffix", "address")


def _grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(trigram bucket at each byte, first and last-plus-one of each row's).
    Digits, marks and spaces are one symbol, and trigrams with fewer than two
    letter bytes have the bucket ``1 << GRAM_BITS``, which says nothing."""
    lower = pc.ascii_lower(pc.fill_null(texts, ""))
    offsets = np.frombuffer(lower.buffers()[1], np.int32)[lower.offset:lower.offset + len(lower) + 1].astype(np.int64)
    data = lower.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]].astype(np.uint32) if data else np.zeros(0, np.uint32)
    raw = np.concatenate([raw, np.zeros(2, np.uint32)])
    letter = ((raw >= 97) & (raw <= 122)) | (raw >= 128)
    raw[~letter] = 32
    code = (raw[:-2] << 16) | (raw[1:-1] << 8) | raw[2:]
    code = (code * np.uint32(0x9E3779B1)) >> np.uint32(32 - GRAM_BITS)
    letters = letter.view(np.uint8)
    code[letters[:-2] + letters[1:-1] + letters[2:] < 2] = 1 << GRAM_BITS
    first = offsets[:-1] - offsets[0]
    return code, first, np.maximum(offsets[1:] - offsets[0] - 2, first)


def train(labelled: DataFrame, train_rows: int = TRAIN_ROWS) -> tuple[list[str], np.ndarray]:
    """``labelled`` (doc_id, text, lang) -> (classes, log P(trigram | class))."""
    labelled = labelled.select("doc_id", "text", "lang").filter("lang IS NOT NULL AND lang <> ''")
    by_label = sorted(labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect())
    classes = [lang for lang, _ in by_label]
    if not classes:
        return [], np.zeros((1, 1 << GRAM_BITS), np.float32)
    shares = [(lang, c, int(min(1.0, train_rows / n) * (1 << 30))) for c, (lang, n) in enumerate(by_label)]
    # From Arrow: a list of rows would start Python workers of its own, which stay beside those of the tasks.
    shares = labelled.sparkSession.createDataFrame(pa.table(
        [pa.array(values, kind) for values, kind in zip(zip(*shares), (pa.string(), pa.int64(), pa.int64()))],
        ["lang", "c", "share"]))
    sample = labelled.join(F.broadcast(shares), "lang").filter(
        F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.col("share")).select("c", "text")

    def written(sums: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for c, row in sums.items():
            g = np.flatnonzero(row[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(g), c)), pa.array(g), pa.array(row[g])], ["c", "g", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {}
        for batch in batches:
            for part in text_slices(batch, "text", GRAM_SLICE_BYTES):
                code, first, last = _grams(part.column("text"))
                for c, a, b in zip(part.column("c").to_pylist(), first, last, strict=True):
                    if c not in sums:
                        if len(sums) == HELD_LABELS:
                            yield from written(sums)
                            sums = {}
                        sums[c] = np.zeros((1 << GRAM_BITS) + 1, np.int64)
                    sums[c] += np.bincount(code[a:b], minlength=len(sums[c]))
        yield from written(sums)

    # At most classes * 2**GRAM_BITS rows.
    found = sample.mapInArrow(lean(count), "c long, g long, n long").groupBy("c", "g").agg(F.sum("n").alias("n"))
    with arrow_batches(labelled.sparkSession, TEXT_BATCH_ROWS):
        found = found.toArrow()
    c, g, n = (found.column(x).to_numpy() for x in ("c", "g", "n"))
    order = np.argsort(c, kind="stable")
    c, g, n = c[order], g[order], n[order]
    ends = np.searchsorted(c, np.arange(len(classes) + 1))
    # UNKNOWN's row is even; the last column is that of trigrams that say nothing.
    table = np.full((len(classes) + 1, (1 << GRAM_BITS) + 1), -np.log(1 << GRAM_BITS), np.float32)
    for j, (a, b) in enumerate(zip(ends, ends[1:])):
        counts = np.full(1 << GRAM_BITS, SMOOTH)
        counts[g[a:b]] += n[a:b]
        # A trigram new to a language costs it little against UNKNOWN.
        table[j, :-1] = np.log((1 - MIXED) * counts / counts.sum() + MIXED / len(counts))
    table[:, -1] = 0
    return [*classes, UNKNOWN], table


def _scorer(table):
    """Adds ``ll``, the tempered log likelihoods of the classes, and drops the text."""
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text", GRAM_SLICE_BYTES):
                code, first, last = _grams(part.column("text"))
                lls = np.empty((part.num_rows, len(table.value)))
                for j, logs in enumerate(table.value):
                    sums = np.concatenate([[0.0], np.cumsum(logs[code], dtype=np.float64)])
                    lls[:, j] = TEMPER * (sums[last] - sums[first])
                bounds = pa.array(np.arange(0, lls.size + 1, lls.shape[1], dtype=np.int32))
                rest = [n for n in part.schema.names if n != "text"]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(n) for n in rest), pa.ListArray.from_arrays(bounds, pa.array(lls.ravel()))],
                    [*rest, "ll"])
    return score


def _softmax(scores: Column) -> Column:
    return let(F.array_max(scores), lambda top: let(
        F.transform(scores, lambda s: F.exp(s - top)),
        lambda e: let(F.aggregate(e, F.lit(0.0), lambda a, x: a + x), lambda total: F.transform(e, lambda x: x / total))))


def _sums(rows: DataFrame, keys: list[str], n: int) -> DataFrame:
    return rows.groupBy(*keys).agg(F.array(*[F.sum(F.get("p", F.lit(i))) for i in range(n)]).alias("sums"),
                                   F.count(F.lit(1)).cast("double").alias("rows"))


def _smoothed(sums: Column, rows: Column, above: Column) -> Column:
    return F.zip_with(sums, above, lambda s, a: (s + STRENGTH * a) / (rows + STRENGTH))


def host_priors(rows: DataFrame, n: int) -> DataFrame:
    """(suffix, domain, host, sums, rows, above): each host's soft counts and the
    smoothed prior of the level above it, from ``rows`` with text posteriors ``p``."""
    total = rows.agg(F.array(*[F.coalesce(F.sum(F.get("p", F.lit(i))), F.lit(0.0)) for i in range(n)]), F.count(F.lit(1))).first()
    world = F.array(*[F.lit((s + 1.0) / (total[1] + n)) for s in total[0]])
    suffix = _sums(rows, ["suffix"], n).select("suffix", _smoothed(F.col("sums"), F.col("rows"), world).alias("prior"))
    domain = _sums(rows, ["suffix", "domain"], n).join(suffix, "suffix").select(
        "suffix", "domain", _smoothed(F.col("sums"), F.col("rows"), F.col("prior")).alias("above"))
    return _sums(rows, ["suffix", "domain", "host"], n).join(domain, ["suffix", "domain"])


def evidence_table(rows: DataFrame, column: str, n: int) -> DataFrame:
    """(column, log P(value | class)) from the text posteriors."""
    sums = pinned(_sums(rows, [column], n), f"evidence_{column}")
    all_sums = sums.agg(*[F.sum(F.get("sums", F.lit(i))) for i in range(n)], F.count(F.lit(1))).first()
    values = all_sums[n]
    per_class = F.array(*[F.lit((s or 0.0) + SMOOTH * values) for s in all_sums[:n]])
    return sums.select(column, F.zip_with("sums", per_class, lambda s, t: F.log((s + SMOOTH) / t)).alias(f"log_{column}"))


def identify(rows: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """``rows`` with text and EVIDENCE columns -> the same rows without the text,
    plus language, posterior and kept."""
    classes, table = model
    n = len(classes)
    names = [c for c in rows.columns if c not in ("text", "language", "posterior", "kept")]
    if not classes:
        return rows.select(*names).withColumns({
            "language": F.lit(None).cast("string"), "posterior": F.lit(None).cast("double"), "kept": F.lit(True)})
    # The input's columns travel in one struct, so none meets a column made here.
    rows = rows.withColumns({c: F.coalesce(F.col(c), F.lit("")) for c in EVIDENCE})
    rows = rows.select(F.struct(*names).alias("given"), *EVIDENCE, "text")
    schema = T.StructType([f for f in rows.schema if f.name != "text"]).add("ll", T.ArrayType(T.DoubleType()))
    scored = rows.mapInArrow(lean(_scorer(rows.sparkSession.sparkContext.broadcast(table))), schema)
    scored = pinned(scored.withColumn("p", _softmax(F.col("ll"))), "language_text", TEXT_BATCH_ROWS)
    priors = pinned(host_priors(scored, n), "host_priors")
    out = scored.join(small_side(priors, BROADCAST_ROWS), ["suffix", "domain", "host"])
    for c in ("declared", "address"):
        out = out.join(small_side(pinned(evidence_table(scored, c, n), f"log_{c}"), BROADCAST_ROWS), c)
    # The row's own share is taken out of its host's counts.
    prior = _smoothed(F.zip_with("sums", "p", lambda s, p: F.greatest(s - p, F.lit(0.0))), F.col("rows") - 1, F.col("above"))
    parts = F.transform(F.arrays_zip(F.col("ll").alias("t"), F.col("log_declared").alias("d"), F.col("log_address").alias("a"),
                                     prior.alias("h")), lambda z: z["t"] + z["d"] + z["a"] + F.log(z["h"]))
    out = out.withColumn("p", _softmax(parts))
    best = F.array_position("p", F.array_max("p"))
    return out.select("given.*", F.element_at(F.array(*map(F.lit, classes)), best.cast("int")).alias("language"),
                      F.array_max("p").alias("posterior"), (best < n).alias("kept"))


def declared_code(value: Column) -> Column:
    """The primary subtag of a declared language, or "" (a closed set of codes)."""
    return F.regexp_extract(F.lower(F.coalesce(value, F.lit(""))), r"^\s*([a-z]{2,3})(?:[-_]|\s*$)", 1)


def page_evidence(pages: DataFrame) -> DataFrame:
    """``pages`` (page_id, url, html) as rows to identify."""
    html = F.coalesce("html", F.lit(""))
    visible = F.regexp_replace(html, r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>|<!--.*?-->", " ")
    visible = F.regexp_replace(F.regexp_replace(visible, r"(?s)<[^>]*>|&[#a-zA-Z0-9]+;", " "), r"\s+", " ")
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1))
    path = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[^:]*://[^/]+/([A-Za-z]{2})(?:[/?#]|$)", 1))
    suffix = F.regexp_extract(host, r"\.([^.]+)$", 1)
    return pages.select(
        "page_id", visible.alias("text"),
        declared_code(F.regexp_extract(html, r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z_-]+)", 1)).alias("declared"),
        host.alias("host"), F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1).alias("domain"), suffix.alias("suffix"),
        F.when(path != "", F.concat(F.lit("/"), path)).otherwise(F.concat(F.lit("."), suffix)).alias("address"))


def _row_hash() -> Column:
    """Hash of all that decides on a document; a null is unlike any value."""
    return F.xxhash64(*[F.coalesce(c, F.lit("\0")) for c in ("text", "lang", "source")])


def document_evidence(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text, lang, source) as rows to identify: the source is the
    host, its letters the domain, the label the declared language."""
    source = F.coalesce("source", F.lit(""))
    return docs.select(
        "doc_id", _row_hash().alias("row_hash"), "text", declared_code(F.col("lang")).alias("declared"),
        source.alias("host"), F.regexp_replace(source, r"[0-9]+$", "").alias("domain"), F.lit("").alias("suffix"),
        F.lit("").alias("address"))


def keep_identified(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows whose language is unknown; all columns kept."""
    judged, key = identify(document_evidence(docs), train(docs)), unused(docs, "__row_hash")
    gone = pinned(judged.filter("NOT kept").select("doc_id", F.col("row_hash").alias(key)).distinct(), "rejected")
    keyed = docs.withColumn(key, _row_hash())
    return join_null_safe(keyed, small_side(gone, BROADCAST_ROWS), ["doc_id", key], "left_anti").drop(key)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages and all documents, each with the evidence it has."""
    docs, pages = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "pages")
    model, none = train(docs), F.lit(None).cast("long")
    out = ["page_id", "doc_id", "declared", "host", "language", F.round("posterior", 6).alias("posterior"), "kept"]
    of_pages = identify(page_evidence(pages), model).withColumn("doc_id", none)
    of_docs = identify(document_evidence(docs), model).withColumn("page_id", none)
    return of_pages.select(*out).unionByName(of_docs.select(*out))
