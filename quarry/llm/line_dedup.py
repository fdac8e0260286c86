"""Operator 3 [native]: repeated chunks of lines, removed over the whole corpus.

A text is cut into chunks of lines where its content says so. Every line gets a
hash, a rolling hash runs over each ``WINDOW`` of successive line hashes, and
a cut falls after a window whose rolling hash is 0 modulo ``MEAN_LINES``. A cut
directly after another is ignored, as are cuts that would leave one line at
either end, so chunks have two lines or more. A cut depends on the lines just
before it alone, so an inserted line shifts no cut behind it. A line of over 50
words is also a chunk on its own, whatever stands around it.

Of equal chunks the one with the smallest (doc_id, line) stays and the others
go. Hashes only nominate: chunks are grouped and joined by their bytes.

All expressions are built in. Chunk hashes are counted as narrow rows; texts
move only for chunks whose hash occurs twice, and never as whole documents
unless a side outgrows its broadcast bound.

Defined cases: a null text stays null and has no lines; an empty text is one
empty line; texts of one line lose it only when it has over 50 words; rows that
share id and text are one document (all of them keep or lose a chunk); null ids
come first; an empty table gives no rows; ``remove_repeated`` keeps all columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import join_null_safe, let, pinned, read_table, small_side, unused
from quarry.plans.joins import salted_hot_join

WINDOW = 2
MEAN_LINES = 3
LONG_WORDS = 50
# Fixed values of the rolling hash: 32-bit line hashes, base and modulus.
BASE, MODULUS = 1_000_003, 2_147_483_647
#: Rows of a narrow side that may be broadcast; beyond it a shuffle join.
BROADCAST_ROWS = 1_000_000
#: Rows of one repeated chunk that one task compares with its first at least.
SALT_ROWS = 1_000


def _line_hash(line: Column) -> Column:
    return F.conv(F.substring(F.md5(line.cast("binary")), 1, 8), 16, 10).cast("bigint")


def _rolling(hashes: Column, i: Column, window: int) -> Column:
    """Rolling hash of the ``window`` lines that end at line ``i`` (from 0)."""
    out = F.lit(0).cast("bigint")
    for back in range(window - 1, -1, -1):
        out = (out * F.lit(BASE) + F.get(hashes, i - back)) % F.lit(MODULUS)
    return out


def chunk_spans(lines: Column, window: int = WINDOW, mean_lines: int = MEAN_LINES) -> Column:
    """array<struct<first, n>>: the chunks of an array of lines, from line 0, and
    the long lines by themselves."""
    n = F.size(lines)
    none = F.array().cast("array<int>")

    def ends(hashes: Column) -> Column:  # last lines of the chunks
        def cut(i: Column) -> Column:
            return (i >= window - 1) & (_rolling(hashes, i, window) % mean_lines == 0)
        inner = F.when(n >= 4, F.filter(F.sequence(F.lit(1), n - 3), lambda i: cut(i) & ~F.coalesce(
            cut(i - 1), F.lit(False)))).otherwise(none)
        return F.concat(inner, F.array(n - 1))

    def spans(last: Column) -> Column:
        return F.filter(F.transform(last, lambda e, k: let(
            F.when(k > 0, F.get(last, k - 1) + 1).otherwise(0), lambda first: F.struct(
                first.alias("first"), (e - first + 1).alias("n")))), lambda s: s["n"] > 1)

    long = F.filter(F.transform(lines, lambda s, i: F.struct(
        i.alias("first"), F.when(F.length(s) - F.length(F.replace(s, F.lit(" "))) >= LONG_WORDS, 1).otherwise(0)
        .alias("n"))), lambda s: s["n"] > 0)
    return F.concat(let(F.transform(lines, _line_hash), lambda h: let(ends(h), spans)), long)


def _chunks(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, first, n, chunk, h): one row per chunk."""
    cut = docs.filter("text IS NOT NULL").select(
        "doc_id", F.xxhash64("text").alias("text_hash"), F.split("text", "\n", -1).alias("lines"))
    cut = cut.select("doc_id", "text_hash", "lines", F.explode(chunk_spans(F.col("lines"))).alias("s"))
    out = cut.select("doc_id", "text_hash", "s.first", "s.n", F.array_join(
        F.slice("lines", F.col("s.first") + 1, F.col("s.n")), "\n").alias("chunk"))
    return out.withColumn("h", F.xxhash64("chunk"))


def repeated_chunks(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, first, n) of every chunk that repeats an earlier one."""
    docs = docs.select("doc_id", "text")
    twice = pinned(_chunks(docs).groupBy("h").agg(F.count(F.lit(1)).alias("m")).filter("m > 1"), "twice")
    found = pinned(_chunks(docs).join(small_side(twice.select("h"), BROADCAST_ROWS), "h"), "repeated")
    # Grouping and joining by the chunk's text compares its bytes.
    place = F.struct("doc_id", "first", "text_hash")
    first = found.groupBy("h", "chunk").agg(F.min(place).alias("origin"), F.max(place).alias("final"))
    first = first.filter(~F.col("origin").eqNullSafe(F.col("final"))).select("h", F.col("chunk").alias("same"), "origin")
    # A chunk that very many documents share is dealt over many tasks.
    later = salted_hot_join(found, first, "h", ["doc_id", "text_hash", "first"],
                            twice.select("h", F.col("m").alias("n")), salt_rows=SALT_ROWS)
    later = later.filter((F.col("chunk") == F.col("same")) & ~F.col("origin").eqNullSafe(place))
    return later.select("doc_id", "text_hash", "first", "n")


def remove_repeated(docs: DataFrame, lines: str = "__lines", removed: str = "__removed") -> DataFrame:
    """``docs`` with repeated chunks taken out of ``text``; two columns are added (or
    replaced), ``lines`` and ``removed``: the lines it had and how many went."""
    names = {c: unused(docs, f"__{c}") for c in ("text_hash", "all", "kept", "gone")}
    key, whole, left, went = names.values()
    gone = pinned(repeated_chunks(docs).groupBy("doc_id", "text_hash").agg(
        F.collect_set(F.struct("first", "n")).alias("gone")), "gone")
    keyed = docs.withColumn(key, F.xxhash64("text"))
    # The side holds spans of chunks: count these, not the documents.
    spans = gone.agg(F.sum(F.size("gone"))).first()[0] or 0
    gone = gone.withColumnsRenamed({"text_hash": key, "gone": went})
    marked = join_null_safe(keyed, F.broadcast(gone) if spans <= BROADCAST_ROWS else gone,
                            ["doc_id", key], "left").drop(key)
    marked = marked.withColumn(whole, F.split("text", "\n", -1))
    numbers = F.flatten(F.transform(went, lambda s: F.sequence(s["first"], s["first"] + s["n"] - 1)))
    kept = F.array_except(F.sequence(F.lit(0), F.size(whole) - 1), numbers)
    marked = marked.withColumn(left, F.when(F.col(went).isNotNull(), kept))
    text = F.when(F.col(left).isNull(), F.col("text")).otherwise(
        F.array_join(F.transform(left, lambda i: F.get(whole, i)), "\n"))
    return marked.withColumns({
        "text": text, lines: F.coalesce(F.size(whole), F.lit(0)).cast("long"),
        removed: F.when(F.col(left).isNull(), 0).otherwise(F.size(whole) - F.size(left)).cast("long"),
    }).drop(whole, left, went)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeated(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("__lines").alias("n_lines"), F.col("__removed").alias("n_removed"),
                      F.md5(F.col("text").cast("binary")).alias("text_md5"))


ORACLE = f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
    generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i, len(string_split(text, chr(10))) AS n
  FROM documents WHERE text IS NOT NULL
),
hashed AS (
  SELECT *, lag(h) OVER w AS h1 FROM (SELECT *, CAST('0x' || substr(md5(line), 1, 8) AS BIGINT) AS h FROM lines)
  WINDOW w AS (PARTITION BY doc_id ORDER BY i)
),
cuts AS (
  SELECT *, coalesce(((h1 % {MODULUS}) * {BASE} + h) % {MODULUS} % {MEAN_LINES} = 0, false) AS cut FROM hashed
),
ends AS (
  SELECT *, i = n - 1 OR (i >= 1 AND i <= n - 3 AND cut AND NOT coalesce(lag(cut) OVER w, false)) AS last
  FROM cuts WINDOW w AS (PARTITION BY doc_id ORDER BY i)
),
numbered AS (
  SELECT *, coalesce(sum(CAST(last AS INT)) OVER (PARTITION BY doc_id ORDER BY i
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k FROM ends
),
chunks AS (
  SELECT doc_id, min(i) AS first, count(*) AS m, string_agg(line, chr(10) ORDER BY i) AS chunk
  FROM numbered GROUP BY doc_id, k HAVING count(*) > 1
  UNION ALL
  SELECT doc_id, i, 1, line FROM lines WHERE length(line) - length(replace(line, ' ', '')) >= {LONG_WORDS}
),
later AS (
  SELECT doc_id, first, m FROM chunks
  QUALIFY row_number() OVER (PARTITION BY chunk ORDER BY doc_id, first) > 1
),
gone AS (
  SELECT DISTINCT doc_id, unnest(generate_series(first, first + m - 1)) AS i FROM later
)
SELECT d.doc_id, coalesce(len(string_split(d.text, chr(10))), 0) AS n_lines,
  coalesce(g.removed, 0) AS n_removed, md5(CASE WHEN g.removed IS NULL THEN d.text ELSE coalesce(k.text, '') END) AS text_md5
FROM documents d
LEFT JOIN (SELECT doc_id, count(*) AS removed FROM gone GROUP BY 1) g USING (doc_id)
LEFT JOIN (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS text FROM lines
           ANTI JOIN gone USING (doc_id, i) GROUP BY 1) k USING (doc_id)
"""
