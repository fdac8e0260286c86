"""Join strategy helpers.

* ``bounded_broadcast``: broadcast a side only after proving it is small by
  counting it. Beyond the bound the side is
  left to a shuffle join (AQE may still turn it into a broadcast at runtime,
  from measured sizes).
* ``salted_hot_join``: a join in which a key may be hot on one side or on both:
  hot keys (a provably bounded set) are salted on the big side and replicated
  (hot rows only) on the other.
* ``skew_join``: the same as a lookup join (one row per key on the small side).
* ``lookup_join``: broadcast when bounded, else ``skew_join``.
* ``join_small_to_big``: attach a small pinned result (a top-k run, judged
  ids) to the corpus by broadcasting it into the corpus scan when bounded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Rows a side may have to be broadcast (each side here is a few narrow columns).
DEFAULT_BROADCAST_ROWS = 2_000_000
# A key is hot when it holds at least 1/DEFAULT_MAX_HOT_KEYS of the rows.
DEFAULT_MAX_HOT_KEYS = 10_000
# Rows of a hot key that one task of a salted join takes at least.
SALT_ROWS = 100_000
# Parts over which rows without a key are dealt in a left join.
NULL_SALTS = 1_024


def is_bounded(df: DataFrame, max_rows: int) -> bool:
    """True when ``df`` has at most ``max_rows`` rows. A plain count: partial
    counts per task, so no task gathers rows to answer it."""
    return df.count() <= max_rows


def bounded_broadcast(df: DataFrame, max_rows: int = DEFAULT_BROADCAST_ROWS) -> DataFrame:
    return F.broadcast(df) if is_bounded(df, max_rows) else df


def _hot_keys(key_counts: DataFrame, on: str, max_hot: int, salts: int | None, salt_rows: int) -> DataFrame:
    """(on, __salts) of the keys to split. A hot key holds at least 1/max_hot of
    the rows, so there are at most ``max_hot`` of them (pigeonhole); its rows are
    split into parts of that share, or of ``salt_rows`` when that is more."""
    total = key_counts.select(F.sum("n")).scalar()
    part = F.greatest(total / F.lit(float(max_hot)), F.lit(float(salt_rows)))
    wanted = F.lit(salts) if salts is not None else F.ceil(F.col("n") / part).cast("int")
    return (key_counts.filter(F.col(on).isNotNull() & (F.col("n") * F.lit(int(max_hot)) >= total))
            .select(on, wanted.alias("__salts")).filter("__salts > 1"))


def salted_hot_join(big: DataFrame, other: DataFrame, on: str, salt_from: list[str],
                    key_counts: DataFrame | None = None, salts: int | None = None,
                    max_hot: int = DEFAULT_MAX_HOT_KEYS, how: str = "inner",
                    salt_rows: int = SALT_ROWS) -> DataFrame:
    """Join where a key may be hot on ``big``, or on both sides (e.g. a common
    word shared by many queries and many documents).

    Hot keys are salted: big's rows get a salt from ``salt_from`` and the hot rows
    of ``other`` are replicated once per salt, each key as often as its count
    asks. It is one shuffle join on (key, salt) and no union of a hot and a cold
    part, so a later group or window on another key is always dealt anew.
    Nothing is collected into lists."""
    if how not in ("inner", "left"):
        raise ValueError(f"salted_hot_join supports inner/left; got {how!r}")
    if key_counts is None:
        key_counts = big.groupBy(on).agg(F.count(F.lit(1)).alias("n"))
    hot = F.broadcast(_hot_keys(key_counts, on, max_hot, salts, salt_rows))
    parts = F.coalesce("__salts", F.lit(1))
    # Rows without a key meet nothing; in a left join they are dealt by their salt.
    parts_big = F.when(F.col(on).isNull(), F.lit(NULL_SALTS)).otherwise(parts)
    salted = (big.join(hot, on, "left")
              .withColumn("__salt", F.pmod(F.xxhash64(*salt_from), parts_big).cast("int")).drop("__salts"))
    copies = (other.join(hot, on, "left")
              .withColumn("__salt", F.explode(F.sequence(F.lit(0), parts - 1))).drop("__salts"))
    return salted.join(copies, [on, "__salt"], how).drop("__salt")


def skew_join(big: DataFrame, small: DataFrame, on: str, how: str = "inner",
              key_counts: DataFrame | None = None, max_hot: int = DEFAULT_MAX_HOT_KEYS,
              salt_rows: int = SALT_ROWS) -> DataFrame:
    """Lookup join (``small`` has one row per key) where one key may hold a large
    share of ``big``, e.g. a common word: its few lookup rows are replicated.

    ``key_counts`` (key, n) may be given when already known (e.g. document
    frequency); otherwise it is a partial aggregate of ``big``."""
    return salted_hot_join(big, small, on, [c for c in big.columns if c != on] or [on], key_counts,
                           max_hot=max_hot, how=how, salt_rows=salt_rows)


def join_small_to_big(small: DataFrame, big: DataFrame, on, how: str = "inner",
                      max_rows: int = DEFAULT_BROADCAST_ROWS) -> DataFrame:
    """Join a small result (a top-k run, a set of judged ids) to a big table.

    When ``small`` is provably bounded it is broadcast and ``big`` is only
    scanned, never shuffled; otherwise a shuffle join. ``small`` should be
    pinned (checkpointed) by the caller, so the size check does not
    recompute it. ``how`` is from the small side: inner or left_semi-like
    uses keep only big rows that match."""
    if how not in ("inner", "left_semi"):
        raise ValueError(f"join_small_to_big supports inner/left_semi; got {how!r}")
    if is_bounded(small, max_rows):
        return big.join(F.broadcast(small), on, how)
    return big.join(small, on, how)


def lookup_join(big: DataFrame, small: DataFrame, on: str, how: str = "inner",
                max_broadcast_rows: int = DEFAULT_BROADCAST_ROWS,
                max_hot: int = DEFAULT_MAX_HOT_KEYS) -> DataFrame:
    """Broadcast ``small`` when provably small, else a hot-key split join."""
    if is_bounded(small, max_broadcast_rows):
        return big.join(F.broadcast(small), on, how)
    return skew_join(big, small, on, how, max_hot=max_hot)
