"""Operator 9: trees against a recursive walk, exact round trip of texts."""

from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.llm import chat as C


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet="\\elbn<>|[/]INST sS\nY🎉é", max_size=30), min_size=1, max_size=12))
def test_texts_come_back(spark, texts):
    texts = [t for t in texts] + [C.PROBE, "<|turn|>user\n", "<|end|>\n", "<<SYS>>\\e", "\\l<|"]
    rows = [(1, i, t if i % 3 else "assistant", t) for i, t in enumerate(texts)] + [(2, 0, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["tree"]: r for r in C.format_conversations(C.conversation_nodes(df)).collect()}
    said = [(r or "", t or "") for c, _, r, t in rows if c == 1]
    assert C.parse(got[1]["formatted"]) == said and C.parse(got[2]["formatted"]) == [("", "")]
    loss = [C.unescape(got[1]["formatted"][s["start"]:s["end"]]) for s in got[1]["mask"]]
    assert loss == [t for r, t in said if r == "assistant"]
    body = got[1]["formatted"]
    assert body.count("<|") == 2 * len(said) and not any(m in body for m in C.CONTROL[1:])


def test_tree_paths_and_ranks(spark):
    # tree 1: 0 -> (1 -> (3, 4), 2); tree 2: a chain of 40; 3: a circle with a branch; null tree; lost parent
    rows = [(1, 0, None, 1.0), (1, 1, 0, 2.0), (1, 2, 0, 5.0), (1, 3, 1, 1.0), (1, 4, 1, None)]
    rows += [(2, i, i - 1 if i else None, 0.0) for i in range(40)]
    rows += [(3, 0, 1, 0.0), (3, 1, 0, 0.0), (3, 2, 1, 0.0), (None, 0, None, 0.0), (None, 1, 0, 0.0), (4, 5, 99, 0.0)]
    df = spark.createDataFrame(rows, "tree long, node long, parent long, score double")
    paths = {}
    for r in C.reply_paths(df).collect():
        paths.setdefault((r["tree"], r["leaf"]), {})[r["above"]] = r["node"]
    got = {k: [n for _, n in sorted(v.items(), reverse=True)] for k, v in paths.items()}
    assert got == {(1, 2): [0, 2], (1, 3): [0, 1, 3], (1, 4): [0, 1, 4], (2, 39): list(range(40)),
                   (None, 1): [0, 1], (4, 5): [5]}
    best = C.best_paths(df, C.reply_paths(df), None).filter("tree = 1").orderBy("path_rank").collect()
    assert [(r["leaf"], r["path_score"]) for r in best] == [(2, 6.0), (3, 4.0), (4, 3.0)]
    assert C.best_paths(df, C.reply_paths(df), 2).filter("tree = 1").count() == 2


def test_ties_extra_columns_empty(spark):
    df = spark.createDataFrame([(1, 0, "user", "b", 9), (1, 0, "user", "a", 9), (None, 3, "assistant", "x", 9)],
                               "conv_id long, turn long, role string, text string, node int")
    got = {r["tree"]: C.parse(r["formatted"]) for r in C.format_conversations(C.conversation_nodes(df)).collect()}
    assert got == {1: [("user", "a"), ("user", "b")], None: [("assistant", "x")]}
    assert C.format_conversations(C.conversation_nodes(df.limit(0))).count() == 0
