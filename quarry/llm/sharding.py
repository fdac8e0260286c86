"""Operator 6: minimax contiguous sharding.

Documents with equal texts form one atomic group. Groups lie in the order of
their 64-bit text hash, and the hash range is cut into at most ``shards``
contiguous runs: the smallest feasible shard capacity is found by binary
search, each trial being a greedy fill over the running sums, and the cuts are
made under that capacity (of the cuts it allows, those whose smallest shard is
largest).

A group larger than an equal share of the rest cannot be split, so it leaves
the order and takes a shard of its own. There are fewer such groups than
shards; they are found among the few hash cells heavy enough to hold one. A
group of very many rows, however few its bytes (null and empty texts), is set
apart too, as a unit of the order.

The order is summed on a fixed grid of hash cells, so the driver handles a
bounded table whatever the corpus. Cells into which a cut may fall are split by
further bits of the hash, round by round, until whole units allow the very
capacity that single groups would: the capacity is the smallest over the groups.
(The largest smallest shard is looked for among the cuts between units.) A group
set apart but not alone stands at the end of its cell.

Rows are numbered inside a shard by (unit, document): each unit's first slot is
a running count, and rows are ranked only inside a unit. Heavy groups are
dealt over many sub-units, so no task ranks a whole hot group.

Defined cases: a null text has size 16, the CRC of no bytes and is grouped with
empty texts; equal (doc_id, text) rows get slots of their own; fewer groups
than shards leave shards empty; an empty table gives no rows; other columns of
the input are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import pinned, read_table

SHARDS = 40
ROW_BYTES = 16
#: Bits of the hash that number a cell.
CELL_BITS = 18
#: Further bits that number the parts of a cell into which a cut falls.
SPLIT_BITS = 6
#: Capacities that a round of splitting tries between the bounds it has.
TRIALS = 16
#: Sub-units over which a heavy group's rows are dealt.
SALTS = 256
#: The least signed number, as which the unsigned hash 0 is ordered.
FIRST = -(1 << 63)
#: A unit: its cell, whether it is a group set apart, the first place in it, the bits
#: of the hash that it leaves open, and whether it may hold more than one group.
UNIT = np.dtype([("cell", "i8"), ("apart", "?"), ("at", "i8"), ("shift", "i8"), ("bytes", "i8"), ("n", "i8"), ("many", "?")])


def greedy_cuts(before: np.ndarray, capacity: int, shards: int) -> list[int] | None:
    """Ends of greedily filled runs over units with running sums ``before``
    (n + 1 values); None when they need more than ``shards`` runs."""
    cuts, at, n = [], 0, len(before) - 1
    for _ in range(shards):
        at = int(np.searchsorted(before, before[at] + capacity, side="right")) - 1
        cuts.append(at)
        if at == n:
            return cuts
    return None


def smallest_capacity(sizes: np.ndarray, shards: int) -> int:
    """Least capacity under which the ordered units fill at most ``shards`` runs."""
    before = np.concatenate([[0], np.cumsum(sizes)])
    low, high = max(int(sizes.max(initial=0)), -(-int(before[-1]) // shards)), int(before[-1])
    while low < high:
        middle = (low + high) // 2
        if greedy_cuts(before, middle, shards):
            high = middle
        else:
            low = middle + 1
    return low


def _layers(before: np.ndarray, capacity: int, floor: int, shards: int) -> list[np.ndarray] | None:
    """For each k the unit ends that k runs can reach when every run holds from
    ``floor`` to ``capacity``; None when ``shards`` runs can't take all units."""
    low = np.searchsorted(before, before - capacity, side="left")
    high = np.searchsorted(before, before - floor, side="right")
    reach = [np.arange(len(before)) == 0]
    for _ in range(shards):
        seen = np.concatenate([[0], np.cumsum(reach[-1])])
        reach.append(seen[np.maximum(high, low)] > seen[low])
    return reach if reach[-1][-1] else None


def contiguous_shards(sizes: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each ordered unit. No shard is over the smallest capacity, and
    of such cuts these have the largest smallest shard (binary search again)."""
    n, capacity = len(sizes), smallest_capacity(sizes, shards)
    before = np.concatenate([[0], np.cumsum(sizes)])
    low, high = 0, int(before[-1]) // shards
    while low < high:
        middle = (low + high + 1) // 2
        if _layers(before, capacity, middle, shards):
            low = middle
        else:
            high = middle - 1
    reach, out, at = _layers(before, capacity, low, shards), np.zeros(n, np.int32), n
    for k in range(shards - 1, -1, -1):
        start = int(np.searchsorted(before, before[at] - capacity, side="left"))
        end = int(np.searchsorted(before, before[at] - low, side="right"))
        begin = start + int(np.flatnonzero(reach[k][start:end])[-1])
        out[begin:at], at = k, begin
    return out


def fluid_greedy(before: np.ndarray, many: np.ndarray, capacity: int, shards: int) -> list[int] | None:
    """Units that greedily filled runs are cut in when a unit of many groups may
    be cut anywhere; None when even so they need more than ``shards`` runs."""
    at, n, cuts = 0, len(many), []
    for _ in range(shards):
        i = int(np.searchsorted(before, at + capacity, side="right")) - 1
        if i == n:
            return cuts
        at = at + capacity if many[i] else int(before[i])
        cuts.append(i)
    return None


def undecided(units: np.ndarray, shards: int) -> np.ndarray:
    """Units to split before the smallest capacity of their groups is known; none
    when it is that of the units. A capacity that whole units allow is enough for
    their groups, and one that fails with units cut anywhere is too small for them;
    between the two, capacities are tried and the units that such cuts fall into are split."""
    before, many = np.concatenate([[0], np.cumsum(units["bytes"])]), units["many"]
    high = smallest_capacity(units["bytes"], shards)
    low, top = max(int(units["bytes"][~many].max(initial=0)), -(-int(before[-1]) // shards)), high
    while low < top:
        middle = (low + top) // 2
        if fluid_greedy(before, many, middle, shards) is None:
            low = middle + 1
        else:
            top = middle
    hit = set()
    for capacity in {low + (high - low) * t // TRIALS for t in range(TRIALS)} if low < high else ():
        hit.update(fluid_greedy(before, many, capacity, shards))
    return np.array(sorted(i for i in hit if many[i]), np.int64)


def split_units(rows: DataFrame, units: np.ndarray, which: np.ndarray) -> np.ndarray:
    """``units`` with those of ``which`` split by the next SPLIT_BITS of the hash."""
    opened = pa.table({"cell": pa.array(units["cell"][which].astype(np.int32)), "first": pa.array(units["at"][which]),
                       "shift": pa.array(units["shift"][which].astype(np.int32)),
                       "next": pa.array(np.maximum(units["shift"][which] - SPLIT_BITS, 0).astype(np.int32))})
    found = (rows.filter("heavy IS NULL").join(F.broadcast(rows.sparkSession.createDataFrame(opened)), "cell")
             .filter("shiftleft(shiftright(place, shift), shift) = first")
             .groupBy("cell", F.expr("shiftleft(shiftright(place, next), next)").alias("at"), "next")
             .agg(F.sum("size"), F.count(F.lit(1)), F.min("place") < F.max("place")).collect())
    parts = np.array([(r[0], False, *r[1:]) for r in found], UNIT)
    return np.sort(np.concatenate([np.delete(units, which), parts]), order=["cell", "apart", "at"])


def alone_groups(groups: list, total: int, shards: int) -> list:
    """Of the ``(cell, h, bytes)`` those larger than an equal share of the rest."""
    alone = []
    for group in sorted(groups, key=lambda g: -g["bytes"]):
        if len(alone) < shards - 1 and group["bytes"] * (shards - len(alone)) > total:
            alone.append(group)
            total -= group["bytes"]
    return alone


def heavy_groups(rows: DataFrame, cells: dict[int, tuple[int, int]], shards: int) -> list:
    """(cell, h, bytes) of the groups with over a quarter of a fair share of all
    bytes or of all rows: at most 8 * shards of them."""
    least = [sum(v) / (4 * shards) for v in zip(*cells.values(), strict=True)]
    wide = [c for c, v in cells.items() if v[0] > least[0] or v[1] > least[1]]
    if not wide:
        return []
    return rows.filter(F.col("cell").isin(wide)).groupBy("cell", "h").agg(
        F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")).filter(
        (F.col("bytes") > least[0]) | (F.col("n") > least[1])).collect()


def shard_documents(docs: DataFrame, shards: int = SHARDS, cell_bits: int = CELL_BITS) -> DataFrame:
    """``docs`` (doc_id, text) -> doc_id, size, text_crc32, shard, slot."""
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    rows = pinned(docs.select(
        "doc_id", (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("h")), "shard_rows")
    # ``place`` orders the unsigned hashes as signed numbers.
    rows = rows.withColumns({"cell": F.shiftrightunsigned("h", 64 - cell_bits).cast("int"),
                             "place": F.col("h").bitwiseXOR(F.lit(FIRST))})
    # At most 2**cell_bits rows reach the driver.
    found = rows.groupBy("cell").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"),
                                     (F.min("h") < F.max("h")).alias("many")).collect()
    cells = {r["cell"]: (r["bytes"], r["n"]) for r in found}
    heavy = heavy_groups(rows, cells, shards)
    keys = sorted(r["h"] for r in heavy)
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")
    rows = rows.withColumn("heavy", F.when(F.col("h").isin(keys), F.col("h"))).withColumn(
        "salt", F.when(F.col("heavy").isNotNull(), salt).otherwise(-1)) if keys else rows.withColumns(
        {"heavy": F.lit(None).cast("long"), "salt": F.lit(-1)})
    dealt = [] if not keys else rows.filter(F.col("heavy").isNotNull()).groupBy("cell", "heavy", "salt").agg(
        F.count(F.lit(1)).alias("n")).collect()

    alone = alone_groups(heavy, sum(b for b, _ in cells.values()), shards)
    shard_of = {r["h"]: i for i, r in enumerate(alone)}
    plain = {r["cell"]: [r["bytes"], r["n"], r["many"]] for r in found}
    for r in heavy:
        plain[r["cell"]][0] -= r["bytes"]
        plain[r["cell"]][1] -= r["n"]
    shift = 64 - cell_bits
    units = [(c, False, (c << shift) + FIRST, shift, b, n, many) for c, (b, n, many) in plain.items() if n]
    units += [(r["cell"], True, r["h"] ^ FIRST, 0, r["bytes"], r["n"], False) for r in heavy if r["h"] not in shard_of]
    units, left = np.sort(np.array(units, UNIT), order=["cell", "apart", "at"]), shards - len(alone)
    while len(units) and len(which := undecided(units, left)):
        units = split_units(rows, units, which)
    placed = len(alone) + contiguous_shards(units["bytes"], left)
    shard_of |= {int(at) ^ FIRST: int(s) for at, s in zip(units["at"][units["apart"]], placed[units["apart"]], strict=True)}

    # Plain rows learn their shard from the first place in each shard: at most ``shards`` numbers.
    ordinary, shard = units[~units["apart"]], placed[~units["apart"]]
    firsts = ordinary["at"][1:][np.diff(shard) > 0].tolist()
    part = np.searchsorted(np.array(firsts, np.int64), ordinary["at"], side="right")
    counts, shards_of = {}, {}
    for cell, p, s, n in zip(ordinary["cell"].tolist(), part.tolist(), shard.tolist(), ordinary["n"].tolist(), strict=True):
        counts[cell, None, -1, p] = counts.get((cell, None, -1, p), 0) + n
        shards_of[cell, None, -1, p] = s
    for r in dealt:
        key = r["cell"], r["heavy"], r["salt"], -1
        counts[key], shards_of[key] = r["n"], shard_of[r["heavy"]]
    table, filled = [], [0] * shards
    for key in sorted(counts, key=lambda k: (k[0], k[1] is not None, k[1] or 0, k[2:])):
        table.append((*key, shards_of[key], filled[shards_of[key]]))
        filled[shards_of[key]] += counts[key]
    names = ["cell", "heavy", "salt", "part", "shard", "first_slot"]
    types = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64()]
    columns = zip(*table, strict=True) if table else [[]] * 6
    units_df = spark.createDataFrame(pa.table(
        {n: pa.array(list(v), t) for n, v, t in zip(names, columns, types, strict=True)}))
    passed = sum(((F.col("place") >= F.lit(first)).cast("int") for first in firsts), F.lit(0))
    rows = rows.withColumn("part", F.when(F.col("heavy").isNull(), passed).otherwise(-1))
    place = Window.partitionBy("cell", "heavy", "salt", "part").orderBy("doc_id", "h", "size")
    # The unit table is bounded by the cells, their cuts and 8 * shards * SALTS sub-units.
    u = F.broadcast(units_df)
    ranked = rows.withColumn("__rank", F.row_number().over(place))
    return ranked.join(u, (ranked["cell"] == u["cell"]) & ranked["heavy"].eqNullSafe(u["heavy"])
                       & (ranked["salt"] == u["salt"]) & (ranked["part"] == u["part"])).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("first_slot") + F.col("__rank") - 1).alias("slot"))


def op6_minimax_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))
