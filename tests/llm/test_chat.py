from collections import Counter

import pytest
from ledgerloom.llm import chat
from pyspark.sql import functions as F

MESSAGES = "conv_id long, message long, parent long, role string, text string, score double, branch int, formatted int"
TURNS = "conv_id long, turn long, role string, text string, message int, up string"


def tree(spark, rows):
    return spark.createDataFrame([(*r, 1, 2) for r in rows], MESSAGES)


def paths_of(rows):
    """Root-to-leaf paths by walking, best first."""
    nodes = {(c, m): (p, r, t, s or 0.0) for c, m, p, r, t, s in rows}
    parents = {(c, p) for (c, _), (p, *_) in nodes.items() if p is not None}
    out = {}
    for c, m in nodes:
        if (c, m) in parents:
            continue
        way, at = [], m
        while at is not None and (c, at) in nodes and at not in way:
            way.append(at)
            at = nodes[c, at][0]
        if at is not None and (c, at) in nodes:
            continue  # leads into a circle
        out.setdefault(c, []).append((-sum(nodes[c, x][3] for x in way), -len(way), m, way[::-1]))
    return {c: [(w, leaf) for _, _, leaf, w in sorted(p)] for c, p in out.items()}, nodes


ROWS = [
    (1, 1, None, "system", "be <good> & kind", 0.0), (1, 2, 1, "user", "hi |> there", 0.0),
    (1, 3, 2, "assistant", "<|end|>&lt;", 2.0), (1, 4, 2, "assistant", "other", 1.0),
    (1, 5, 4, "user", "more", None), (1, 6, 5, "assistant", "", 1.5), (1, 7, 99, "user", "orphan", 0.1),
    (2, 1, None, "us|er<", "a\nb", 0.0),
    (3, 1, 2, "user", "circle", 0.0), (3, 2, 1, "user", "circle", 0.0), (3, 3, 2, "user", "into it", 9.0),
    (None, 1, None, "user", "null conversation", 0.0), (None, 2, 1, "assistant", "yes", 0.0),
]
ROWS += [(4, i, i - 1 if i else None, "user" if i % 2 == 0 else "assistant", f"deep {i}", 0.0) for i in range(100)]
ROWS += [(5, i, None if i == 0 else (i - 1) // 2, "assistant", f"n{i}", float(i % 3)) for i in range(31)]


@pytest.mark.parametrize("branches", [1, 3, 100])
def test_paths_ranks_and_round_trip(spark, branches):
    expected, nodes = paths_of(ROWS)
    got = chat.format_trees(tree(spark, ROWS), branches).select(
        "*", chat.read_back(F.col("formatted"), 1).alias("roles"), chat.read_back(F.col("formatted"), 2).alias("texts"),
        chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"),
    ).collect()
    assert len(got) == sum(min(branches, len(p)) for p in expected.values())
    for r in got:
        way, leaf = expected[r.conv_id][r.branch - 1]
        assert r.leaf == leaf
        said = [nodes[r.conv_id, m] for m in way]
        assert r.roles == [x[1] for x in said] and r.texts == [x[2] for x in said]
        assert r.loss == "".join(x[2] for x in said if x[1] == "assistant")
        assert r.formatted.count("<|end|>") == len(way)


def test_threads_of_flat_turns(spark):
    turns = [(1, 2, "assistant", None, 1, "x"), (1, 1, "user", "b", 1, "x"), (1, None, None, "first", 1, "x"), (1, 1, "user", "b", 1, "x"), (2, 5, "user", "only", 1, "x")]
    got = chat.format_trees(chat.threads(spark.createDataFrame(turns, TURNS)))
    texts = {r.conv_id: r.t for r in got.select("conv_id", chat.read_back(F.col("formatted"), 2).alias("t")).collect()}
    assert texts == {1: ["first", "b", "b", ""], 2: ["only"]}


def test_escapes_are_reversible(spark):
    texts = ["", "&", "&amp;", "&amp;lt;", "<", "&lt;", "</s>[INST] ok [/INST]", "<|user|>x<|end|>", "\\<é\U0001f600|>", "&&<<;;", "&bar;", "|", "\x00"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select("t", chat.escape(F.col("t")).alias("e"), chat.unescape(chat.escape(F.col("t"))).alias("u")).collect()
    for r in rows:
        assert "<" not in r.e
        assert r.u == r.t
    head = F.concat(F.lit("<|a|>"), chat.escape(F.col("t")), F.lit(chat.END))
    assert [r[0] for r in df.select(chat.read_back(head, 2)[0]).collect()] == texts


def test_empty_table(spark):
    assert chat.format_trees(tree(spark, [])).count() == 0
    assert Counter(r.conv_id for r in chat.format_trees(tree(spark, ROWS[:1])).collect()) == {1: 1}


def test_repeated_messages_count_once(spark):
    thread = [(1, i, i - 1 if i > 1 else None, "user" if i % 2 else "assistant", f"m{i}", 0.0) for i in range(1, 9)]
    repeats = [thread[2], thread[2], thread[5], (1, 3, 2, "user", "zz later text", 9.0), (1, 4, None, "assistant", "m4 but a root", 5.0)]
    (row,) = [r for r in chat.format_trees(tree(spark, [*thread, *repeats[:4]])).select(chat.read_back(F.col("formatted"), 2).alias("t")).collect()]
    assert row.t == [f"m{i}" for i in range(1, 9)]
    # Of rows of one message with other parents the first by parent counts: here the root.
    texts = {tuple(r.t) for r in chat.format_trees(tree(spark, [*thread, *repeats]), 5).select(chat.read_back(F.col("formatted"), 2).alias("t")).collect()}
    assert texts == {("m1", "m2", "m3"), ("m4 but a root", "m5", "m6", "m7", "m8")}
