"""Text scalar functions as Column expressions.

All patterns are Java regex (Spark) and are also valid RE2 (the DuckDB
oracle uses the same strings). No backreferences, no lookaround.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference's behaviour)
# ---------------------------------------------------------------------------
# ASCII punctuation, except the backslash (the reference's character class
# escapes ']' with it, so the backslash itself is kept).
PUNCTUATION = r"[!-/:-@\[\]^_`{-~]"
# A word (Python's \w) that holds a decimal digit.
DIGIT_WORD = r"[\p{L}\p{N}_]*\p{Nd}[\p{L}\p{N}_]*"
# What Python's str.split() treats as whitespace.
WHITESPACE = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}]+"
# Tokens of two or more word characters: the vectorizer's and the in-memory
# BM25 store's default token pattern.
WORD_2PLUS = r"[\p{L}\p{N}_]{2,}"
# Any run of word characters.
WORD_1PLUS = r"[\p{L}\p{N}_]+"
# The hypothetical-document prompt, slot written as {question}.
HYDE_PROMPT = "Write one paragraph that could stand in a text answering this:    Question: {question}    Paragraph:"
# ---------------------------------------------------------------------------


@lru_cache(maxsize=1)
def english_stop_words() -> tuple[str, ...]:
    """Default stop list: Spark ML's English list (a known deviation from the
    reference's vectorizer list, see README)."""
    from pyspark.ml.feature import StopWordsRemover

    return tuple(StopWordsRemover.loadDefaultStopWords("english"))


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value, use) -> Column:
    """``use(value)`` with ``value`` computed once per row."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def explode_values(df, col, out: str, keep=(), pos: str | None = None):
    """One row per element of the array ``col`` (no row for an empty array).

    Uses explode_outer plus a filter on the output: a plain explode makes the
    optimizer add ``size(col) > 0`` below the projection, which evaluates the
    whole array expression (tokenizer included) a second time."""
    keep = list(keep)
    if pos is None:
        return (df.select(*keep, F.explode_outer(col).alias(out))
                .filter(F.col(out).isNotNull()))
    return (df.select(*keep, F.posexplode_outer(col).alias(pos, out))
            .filter(F.col(out).isNotNull())
            .withColumn(pos, F.col(pos).cast("int")))


def counted(values) -> Column:
    """Array of (value, n) of an array of strings, each value once: sorted inside the
    row and cut where it changes, so nothing is shuffled or hashed to count."""
    def runs(a: Column) -> Column:
        begins = F.filter(F.sequence(F.lit(0), F.size(a) - 1),
                          lambda i: (i == 0) | (F.get(a, i) != F.get(a, i - 1)))
        return let(begins, lambda b: F.transform(b, lambda at, j: F.struct(
            F.get(a, at).alias("value"),
            (F.coalesce(F.get(b, j + 1), F.size(a)) - at).cast("long").alias("n"))))
    return let(F.sort_array(values), lambda a: F.when(F.size(a) > 0, runs(a)))


def strip_punctuation(c) -> Column:
    """Punctuation -> space."""
    return F.regexp_replace(_c(c), PUNCTUATION, " ")


def drop_digit_words(c) -> Column:
    """Delete every word that holds a digit."""
    return F.regexp_replace(_c(c), DIGIT_WORD, "")


def split_words(c) -> Column:
    """Lower-case and split on whitespace, no empty words."""
    return F.filter(F.split(F.lower(_c(c)), WHITESPACE), lambda x: x != F.lit(""))


def clean_words(c) -> Column:
    """O43 -> O44 -> O45, the word-vector embedder's own tokenizer."""
    return split_words(drop_digit_words(strip_punctuation(c)))


def word_tokens(c, pattern: str = WORD_2PLUS) -> Column:
    """Lower-case, then every match of ``pattern`` (group 0)."""
    return F.regexp_extract_all(F.lower(F.coalesce(_c(c), F.lit(""))), F.lit(pattern), 0)


def remove_stop_words(tokens, stop_words=None) -> Column:
    """Drop stop words, keep order and repeats (array_except would dedupe)."""
    stops = list(stop_words if stop_words is not None else english_stop_words())
    if not stops:
        return _c(tokens)
    return F.filter(_c(tokens), lambda x: ~x.isin(stops))


def bigrams(tokens) -> Column:
    """O49 (n=2): adjacent pairs joined by one space; empty below two tokens.

    Pass a column (not a costly expression): it is referenced a few times."""
    t = _c(tokens)
    n = F.size(t)
    pairs = F.zip_with(F.slice(t, 1, n - 1), F.slice(t, 2, n - 1),
                       lambda a, b: F.concat_ws(" ", a, b))
    return F.when(n >= 2, pairs).otherwise(F.array().cast("array<string>"))


def unigrams(c, stop_words=None) -> Column:
    """O46 + O48: the vectorizer's words, stop words removed."""
    return remove_stop_words(word_tokens(c, WORD_2PLUS), stop_words)


def vectorizer_terms(df, col: str = "content", out: str = "terms", stop_words=None):
    """O46 + O48 + O49 on a DataFrame: adds ``out`` = unigrams then bigrams.

    The unigram array is materialised as its own column first, so the
    tokenizer and stop-word filter run once per row."""
    tmp = "__unigrams"
    return (df.withColumn(tmp, unigrams(col, stop_words))
            .withColumn(out, F.concat(F.col(tmp), bigrams(tmp))).drop(tmp))


def strip_crlf(c) -> Column:
    """O50 (part): CRLF -> one space."""
    return F.replace(_c(c), F.lit("\r\n"), F.lit(" "))


def url_second_last_segment(c) -> Column:
    """The path segment before the trailing one (NULL if absent)."""
    return F.try_element_at(F.split(_c(c), "/"), F.lit(-2))


def render_prompt(question, template: str = HYDE_PROMPT) -> Column:
    """``template`` with the question in its slot {question} (a null question
    leaves it empty)."""
    before, slot, after = template.partition("{question}")
    if not slot:
        raise ValueError("a prompt template needs the slot {question}")
    return F.concat(F.lit(before), F.coalesce(_c(question), F.lit("")), F.lit(after))
