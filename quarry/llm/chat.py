"""Operator 9: chat formatting of reply trees.

``reply_paths`` enumerates the root-to-leaf paths of reply trees by iterative
self-joins with doubling pointers: ``jump[k]`` holds each node's ancestor
2**k replies up, and joining the paths found so far with ``jump[k]`` doubles
their length, so a tree of depth d takes about log2(d) rounds. Every row is one
node of one path; nothing is gathered until a chosen path becomes a text.

Branches are ranked by the sum of their nodes' scores (ties: smaller leaf) and
the best ``branches`` of each tree are kept, all of them with None.

Template: each turn is ``<|turn|>role``, a line break, the text, ``<|end|>`` and
a line break. Control strings inside roles and texts are escaped so that none
survives: a backslash becomes ``\\e``, the ``<`` or ``[`` that opens a control
string becomes ``\\l`` or ``\\b``, and a line break in a role ``\\n``. ``unescape`` is
the exact inverse. The loss mask lists the code-point spans of the assistant's
texts in the formatted string.

Defined cases: a null text or role is empty; rows that share a (tree, turn) are
consecutive turns ordered by role and text; a null tree id is a tree; a parent
that does not exist makes a root; nodes above which replies run in a circle
have no root and give no path; an empty table gives no rows; extra columns are
ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import join_null_safe, pinned, read_table, running_sums

TURN, END = "<|turn|>", "<|end|>\n"
# Strings that chat templates use as control marks.
CONTROL = ("<|", "<s>", "</s>", "<<SYS>>", "<</SYS>>", "[INST]", "[/INST]")
_OPEN = {"<": "l", "[": "b"}
_BACK = {"e": "\\", "l": "<", "b": "[", "n": "\n"}
ASSISTANT = "assistant"


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\e"))
    for mark in CONTROL:
        out = F.replace(out, F.lit(mark), F.lit("\\" + _OPEN[mark[0]] + mark[1:]))
    return out


def unescape(text: str) -> str:
    return re.sub(r"\\([elbn])", lambda m: _BACK[m[1]], text)


def reply_paths(nodes: DataFrame) -> DataFrame:
    """``nodes`` (tree, node, parent) -> (tree, leaf, node, above): one row for
    each node of each root-to-leaf path, ``above`` replies over its leaf."""
    nodes = nodes.select("tree", "node", "parent")
    parents = nodes.select("tree", F.col("node").alias("up"))
    jump = pinned(join_null_safe(nodes.filter("parent IS NOT NULL").withColumnRenamed("parent", "up"),
                                 parents, ["tree", "up"]), "jump_0")
    size, jumps = nodes.count(), []
    leaves = join_null_safe(nodes.select("tree", "node"), jump.select("tree", F.col("up").alias("node")),
                            ["tree", "node"], "left_anti")
    while not jump.isEmpty():
        if 1 << len(jumps) > size:  # only below a circle can a path be longer than the table
            leaves = join_null_safe(leaves, jump.select("tree", "node"), ["tree", "node"], "left_anti")
            break
        jumps.append(jump)
        onward = jump.select("tree", F.col("node").alias("up"), F.col("up").alias("further"))
        jump = pinned(join_null_safe(jump, onward, ["tree", "up"]).select(
            "tree", "node", F.col("further").alias("up")), f"jump_{len(jumps)}")
    paths = leaves.select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("above"))
    for k, jump in enumerate(jumps):
        longer = join_null_safe(paths, jump, ["tree", "node"]).select(
            "tree", "leaf", F.col("up").alias("node"), (F.col("above") + (1 << k)).alias("above"))
        paths = pinned(paths.unionByName(longer), f"paths_{k}")
    return paths


def best_paths(nodes: DataFrame, paths: DataFrame, branches: int | None = 1) -> DataFrame:
    """(tree, leaf, path_rank, path_score) of the chosen paths. With a number of
    branches each task keeps only that many before rows meet."""
    scored = join_null_safe(paths, nodes.select("tree", "node", "score"), ["tree", "node"])
    scored = scored.groupBy("tree", "leaf").agg(F.sum(F.coalesce("score", F.lit(0.0))).alias("path_score"))
    best = Window.partitionBy("tree").orderBy(F.desc("path_score"), "leaf")
    out = scored.withColumn("path_rank", F.row_number().over(best))
    return out if branches is None else out.filter(F.col("path_rank") <= branches)


def format_conversations(nodes: DataFrame, branches: int | None = 1) -> DataFrame:
    """``nodes`` (tree, node, parent, role, text, score) -> one row per chosen path:
    tree, leaf, path_rank, path_score, formatted, mask array<struct<start, end>>."""
    paths = reply_paths(nodes)
    chosen = best_paths(nodes, paths, branches)
    kept = join_null_safe(paths, chosen, ["tree", "leaf"])
    texts = nodes.select("tree", "node", F.coalesce("role", F.lit("")).alias("role"),
                         F.coalesce("text", F.lit("")).alias("text"))
    turns = join_null_safe(kept, texts, ["tree", "node"]).select(
        "tree", "leaf", "path_rank", "path_score", F.struct(
            (-F.col("above")).alias("at"), (F.col("role") == ASSISTANT).alias("loss"),
            F.concat(F.lit(TURN), F.replace(escape(F.col("role")), F.lit("\n"), F.lit("\\n")), F.lit("\n")).alias("head"),
            escape(F.col("text")).alias("body")).alias("turn"))
    # A path's turns meet in one row, which is what the path's text is.
    out = turns.groupBy("tree", "leaf", "path_rank", "path_score").agg(
        F.array_sort(F.collect_list("turn")).alias("turns"))
    size = len(END)
    ends = running_sums(F.transform("turns", lambda t: (
        F.length(t["head"]) + F.length(t["body"]) + size).cast("bigint")))
    spans = F.filter(F.zip_with("turns", ends, lambda t, e: F.struct(
        t["loss"].alias("loss"), (e - size - F.length(t["body"])).alias("start"), (e - size).alias("end"))),
        lambda s: s["loss"])
    return out.select(
        "tree", "leaf", "path_rank", "path_score",
        F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(END))), "").alias("formatted"),
        F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))).alias("mask"))


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted conversation."""
    turns = []
    for block in formatted.split(END)[:-1]:
        role, _, text = block[len(TURN):].partition("\n")
        turns.append((unescape(role), unescape(text)))
    return turns


def conversation_nodes(rows: DataFrame) -> DataFrame:
    """Turns of linear conversations as nodes: each replies to the one before."""
    place = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    node = F.row_number().over(place).cast("long")
    return (rows.select("conv_id", "turn", "role", "text").select(
        F.col("conv_id").alias("tree"), node.alias("node"), "role", "text")
        .withColumn("parent", F.when(F.col("node") > 1, F.col("node") - 1))
        .withColumn("score", F.lit(0.0)))


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    for batch in batches:
        out = []
        for conv, text, mask in zip(*(batch.column(c).to_pylist() for c in ("tree", "formatted", "mask")), strict=True):
            turns = parse(text)
            loss = "".join(unescape(text[s["start"]:s["end"]]) for s in mask)
            said = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
            out.append((conv, len(turns), said, len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
        if out:
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(v), t) for v, t in zip(zip(*out, strict=True), types, strict=True)], names)


PROBE = "</s>[INST] ok [/INST]"


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-1, 0, "user", PROBE), (-1, 1, "assistant", PROBE)], rows.schema)
    nodes = pinned(conversation_nodes(rows.unionByName(probe)), "chat_nodes")
    return format_conversations(nodes).mapInArrow(
        _read_back, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
                    "formatted_chars long")


def oracle(control: tuple[str, ...] = CONTROL) -> str:
    """DuckDB SQL for op9_chat_formatting."""
    escaped = "replace({c}, '\\', '\\e')"
    for mark in control:
        escaped = f"replace({escaped}, '{mark}', '\\{_OPEN[mark[0]]}{mark[1:]}')"
    role = f"replace({escaped.format(c='role')}, chr(10), '\\n')"
    return f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{PROBE}' UNION ALL SELECT -1, 1, 'assistant', '{PROBE}'
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = '{ASSISTANT}' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = '{ASSISTANT}' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  CAST(sum(length({role}) + length({escaped.format(c='text')}) + {len(TURN) + 1 + len(END)}) AS BIGINT) AS formatted_chars
FROM rows GROUP BY conv_id"""
