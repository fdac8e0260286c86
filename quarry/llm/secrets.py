"""Operator 1 [native]: secret scan.

Three pattern kinds (assign, access, hex) and entropy spans over the rest of
the text, all in built-in expressions inside the row: no shuffle, no Python.

Positions: ``split`` and ``regexp_extract_all`` walk the same matches, so a
match ends at the running sum of (text before it, itself).

Entropy: outside the pattern spans, runs of 20 or more token characters are
candidates. Each has a character class (hex, letters, mixed) with its own
threshold; digits alone never count. A window of 20 characters slides along
the candidate. Its entropy is log2(20) - S / 20 with S the sum of n * log2(n)
over the character counts n; when a character leaves or enters, only its own
count changes, so S moves by the difference of two table entries. The table
holds whole numbers (2**-30 steps), so S is exact however long the candidate.
The span runs from the first window over the threshold to the last. Candidates
on the allow list (patterns, or given strings) are suppressed.

Defined cases: a null text is empty; a text without spans has the digest of the
empty string and empty ``spans``; each input row gives one row, repeated or
null ids included; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import let, read_table, running_sums

# The patterns of the three kinds, in the order they are listed.
ASSIGN = (r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?"
          r"([A-Za-z0-9+/_.=-]+)")
ASSIGN_LEAST = 6
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_letters", "entropy_mixed")

CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
WINDOW = 20
#: Bits per character that a window must reach, by character class.
THRESHOLDS = {"entropy_hex": 3.0, "entropy_letters": 4.1, "entropy_mixed": 3.8}
#: The characters of a candidate, each with a place for its count.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Whole candidates that look random but are not secrets.
SHAPES = (
    r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",  # UUID
    r"^/?([A-Za-z]+/){2,}[A-Za-z]*$",  # path
)
#: What no span of a secret holds.
ALLOW = (
    r"(?i)example|sample|placeholder|changeme|your[-_]?(key|token)",
    r"(?i)abcdefgh|ghijklmn|12345678|qwertyui",
    r"(.)\1{5}",
)
#: What Java matches instead: its engine recurses once per turn of a repeated
#: group, so a long path would end the stack. Possessive turns are a plain loop
#: and match the same paths, as letters and slashes exclude each other.
FLAT = {r"^/?([A-Za-z]+/){2,}[A-Za-z]*$": r"^/?([A-Za-z]++/){2,}+[A-Za-z]*+$"}
_STEP = 1 << 30


def _matches(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def _lengths(strings: Column) -> Column:
    return F.transform(strings, lambda s: F.length(s).cast("bigint"))


def _spans(text: Column, pattern: str, found: Column) -> Column:
    """array<struct<start, end>> of the matches ``found`` of ``pattern`` in ``text``."""
    between = F.slice(F.split(text, pattern, -1), 1, F.size(found))
    ends = running_sums(F.zip_with(_lengths(between), _lengths(found), lambda a, b: a + b))
    return F.when(F.size(found) > 0, F.zip_with(
        ends, _lengths(found), lambda e, n: F.struct((e - n).alias("start"), e.alias("end")))
    ).otherwise(F.array().cast("array<struct<start:bigint,end:bigint>>"))


def _masked(text: Column, pattern: str) -> Column:
    """``text`` with every match blanked out, all positions kept."""
    return F.array_join(F.zip_with(
        F.split(text, pattern, -1), _matches(text, pattern),
        lambda s, m: F.concat(s, F.repeat(F.lit(" "), F.length(F.coalesce(m, F.lit("")))))), "")


def _blanker(has: Column, pattern: str) -> Callable[[Column], Column]:
    return lambda text: F.when(has, _masked(text, pattern)).otherwise(text)


def _hot_windows(candidate: Column, most: Column, window: int) -> Column:
    """struct<first, last>: the stretch (from 0, end exclusive) from the first to
    the last window (of up to 200 characters) whose S is at most ``most``; null without one."""
    table = F.array(*[F.lit(round(n * math.log2(n) * _STEP) if n else 0).cast("bigint") for n in range(window + 2)])
    zero = ord("0")

    def gain(n: Column) -> Column:  # S for a count from n to n + 1
        return F.get(table, n + 1) - F.get(table, n)

    def state(s: Column, counts: Column, first: Column, last: Column) -> Column:
        return F.struct(s.alias("s"), counts.alias("counts"), first.alias("first"), last.alias("last"))

    def moved(acc: Column, place: Column, by: int) -> Column:
        """``acc`` once the character with this place in the alphabet entered (1) or left (-1)."""
        count = F.ascii(F.substring(acc["counts"], place, F.lit(1))) - zero
        return let(count, lambda n: state(
            acc["s"] + (gain(n) if by > 0 else -gain(n - 1)),
            F.overlay(acc["counts"], F.char(n + (zero + by)), place, F.lit(1)), acc["first"], acc["last"]))

    def scan(places: Column) -> Column:
        def step(acc: Column, q: Column) -> Column:
            # Character q - window leaves the window [q - window, q - 1], then q enters.
            less = F.when(q > window, moved(acc, F.get(places, q - window - 1), -1)).otherwise(acc)
            return let(let(less, lambda a: moved(a, F.get(places, q - 1), 1)), lambda a: F.when(
                (q >= window) & (a["s"] <= most),
                state(a["s"], a["counts"], F.coalesce(a["first"], q - window), q)).otherwise(a))

        start = state(F.lit(0).cast("bigint"), F.lit("0" * len(ALPHABET)), F.lit(None).cast("int"), F.lit(None).cast("int"))
        return F.aggregate(F.sequence(F.lit(1), F.size(places)), start, step,
                           lambda a: F.when(a["first"].isNotNull(), F.struct(a["first"], a["last"])))

    return let(F.transform(F.split(candidate, ""), lambda c: F.instr(F.lit(ALPHABET), c)), scan)


def _entropy_kind(candidate: Column) -> Column:
    return (F.when(candidate.rlike("^[0-9]+$"), F.lit(None))
            .when(candidate.rlike("^([0-9a-f]+|[0-9A-F]+)$"), "entropy_hex")
            .when(candidate.rlike("^[A-Za-z]+$"), "entropy_letters")
            .otherwise("entropy_mixed"))


def _most(kind: Column, window: int) -> Column:
    """Largest S at which a window of this class reaches its threshold."""
    out = F.lit(-1).cast("bigint")
    for name, bits in THRESHOLDS.items():
        out = F.when(kind == name, F.lit(int(window * (math.log2(window) - bits) * _STEP)).cast("bigint")).otherwise(out)
    return out


def _tagged(spans: Column, kind: Column) -> Column:
    """array<struct<start, rank, end>>: rank is the kind's place in the list."""
    return F.transform(spans, lambda s: F.struct(
        s["start"].alias("start"), kind.alias("rank"), s["end"].alias("end")))


def _written(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(
        ":", F.get(names, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _any(text: Column, patterns: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for pattern in patterns:
        out |= text.rlike(FLAT.get(pattern, pattern))
    return out


def scan_secrets(docs: DataFrame, window: int = WINDOW, allow: tuple[str, ...] = ALLOW,
                 shapes: tuple[str, ...] = SHAPES, allow_strings: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` (doc_id, text) -> doc_id, base, extra: arrays of spans
    struct<start, rank, end>, ``rank`` numbering ``KINDS``, ``end`` exclusive,
    both in code points."""
    text = F.col("__text")
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("__text")).select(
        "doc_id", text, _matches(text, ASSIGN).alias("__assign"),
        _matches(text, ACCESS).alias("__access"), _matches(text, HEX).alias("__hex"))
    values = F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(1))
    assign = F.transform(F.filter(
        F.arrays_zip(_spans(text, ASSIGN, F.col("__assign")).alias("span"), values.alias("value")),
        lambda z: F.length(z["value"]) >= ASSIGN_LEAST), lambda z: z["span"])
    none = F.array().cast("array<struct<start:bigint,rank:int,end:bigint>>")
    some = [F.size(c) > 0 for c in ("__assign", "__access", "__hex")]
    base = F.concat(
        F.when(some[0], _tagged(assign, F.lit(0))).otherwise(none),
        F.when(some[1], _tagged(_spans(text, ACCESS, F.col("__access")), F.lit(1))).otherwise(none),
        F.when(some[2], _tagged(_spans(text, HEX, F.col("__hex")), F.lit(2))).otherwise(none))
    rest = F.when(some[0], _masked(text, ASSIGN)).otherwise(text)
    for has, pattern in zip(some[1:], (ACCESS, HEX), strict=True):
        rest = let(rest, _blanker(has, pattern))
    based = found.select("doc_id", base.alias("base"), rest.alias("__rest"))
    based = based.select("doc_id", "base", "__rest", _matches(F.col("__rest"), CANDIDATE).alias("__found"))

    def judged(span: Column, candidate: Column) -> Column:
        known = candidate.isin(*allow_strings) if allow_strings else F.lit(False)

        def hot(kind: Column) -> Column:
            rank = F.array_position(F.array(*map(F.lit, KINDS)), kind).cast("int") - 1
            windows = let(_most(kind, window), lambda most: _hot_windows(candidate, most, window))
            return F.when(kind.isNotNull(), let(windows, lambda h: F.when(
                h.isNotNull() & ~_any(F.substring(candidate, h["first"] + 1, h["last"] - h["first"]), allow), F.struct(
                    (span["start"] + h["first"]).alias("start"), rank.alias("rank"),
                    (span["start"] + h["last"]).alias("end")))))
        return F.when(~(known | _any(candidate, shapes)), let(_entropy_kind(candidate), hot))

    spans = F.zip_with(_spans(F.col("__rest"), CANDIDATE, F.col("__found")), F.col("__found"), judged)
    extra = F.when(F.size("__found") > 0, F.filter(spans, lambda s: s.isNotNull())).otherwise(none)
    return based.select("doc_id", "base", extra.alias("extra"))


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(read_table(spark, sf_dir, "documents"))

    def count(column: str, ranks: list[int]) -> Column:
        return F.size(F.filter(F.col(column), lambda s: s["rank"].isin(ranks))).cast("long")
    return found.select(
        "doc_id", count("base", [0]).alias("n_assign"), count("base", [1]).alias("n_access"),
        count("base", [2]).alias("n_hex"), F.sha2(_written(F.col("base")), 256).alias("base_sha256"),
        _written(F.concat("base", "extra")).alias("spans"),
        F.size("extra").cast("long").alias("n_entropy"))
