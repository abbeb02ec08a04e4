"""Chat formatting of reply trees.

Messages point to the message they answer.  Root-to-leaf paths come from iterative
self-joins that double the reach each round: after k rounds every message knows its
ancestor 2**k steps up, and every leaf its path's last 2**k messages, so a thread of n
messages takes about log2(n) rounds.  Branches of a conversation are ranked by score
and each chosen path is formatted as one conversation.

Format: each turn is ``<|role|>`` + escaped text + ``<|end|>``.  ``&`` and ``<`` inside
roles and texts become ``&amp;`` and ``&lt;``, and ``|`` inside roles ``&bar;``; so no
text can hold a control string and the output can be read back exactly.  The loss mask
covers each assistant's text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import staged

END = "<|end|>"
TURN = r"<\|([^<|]*)\|>([^<]*)<\|end\|>"


def _replace(column: Column, *pairs: tuple[str, str]) -> Column:
    for old, new in pairs:
        column = F.replace(column, F.lit(old), F.lit(new))
    return column


def escape(column: Column) -> Column:
    return _replace(column, ("&", "&amp;"), ("<", "&lt;"))


def unescape(column: Column) -> Column:
    return _replace(column, ("&lt;", "<"), ("&bar;", "|"), ("&amp;", "&"))


def read_back(formatted: Column, group: int) -> Column:
    """Roles (1) or texts (2) of all turns, in order, unescaped."""
    return F.transform(F.regexp_extract_all(formatted, F.lit(TURN), F.lit(group)), unescape)


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    cut = F.transform(spans, lambda s: unescape(F.substring(formatted, s["begin"] + 1, s["end"] - s["begin"])))
    return F.concat_ws("", cut)


def threads(turns: DataFrame) -> DataFrame:
    """Messages of flat conversations: each row answers the row before it.

    Rows are ordered by turn, null turns first, then role and text; repeated rows are
    turns of their own.  Roles that are null are empty.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    numbered = rows.withColumn("message", F.row_number().over(order).cast("long"))
    return numbered.select(
        "conv_id", "message", F.when(F.col("message") > 1, F.col("message") - 1).alias("parent"), "role", "text",
        F.lit(0.0).alias("score"),
    )


def leaf_paths(messages: DataFrame) -> DataFrame:
    """(conv_id, leaf, message, up): every message on the way from each leaf, and its
    distance from the leaf.

    A parent that is missing makes a root.  Messages in a circle of replies have no
    leaf and are in no path; a branch that leads into a circle has no root and is left
    out.
    """
    own = messages.select(F.col("conv_id").alias("_c"), F.col("message").alias("_m"))
    links = messages.select("conv_id", "message", "parent")
    links = links.join(
        own, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("parent") == F.col("_m")), "left"
    ).select("conv_id", "message", F.col("_m").alias("above"))
    links = staged(links, "chat-links")
    answered = links.where("above is not null").select(F.col("conv_id").alias("_c"), F.col("above").alias("_m")).distinct()
    leaves = links.join(
        answered, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("message") == F.col("_m")), "left_anti"
    )
    paths = leaves.select("conv_id", F.col("message").alias("leaf"), "message", F.lit(0).cast("long").alias("up"))
    roots = links.where("above is null").select(F.col("conv_id").alias("_rc"), F.col("message").alias("_rm"))
    jump, step = links, 1
    longest = messages.groupBy("conv_id").count().agg(F.max("count")).first()[0] or 0
    while step < longest:
        hop = jump.where("above is not null").select(F.col("conv_id").alias("_c"), F.col("message").alias("_m"), "above")
        on = F.col("conv_id").eqNullSafe(F.col("_c"))
        further = paths.join(hop, on & (F.col("message") == F.col("_m"))).select(
            "conv_id", "leaf", F.col("above").alias("message"), (F.col("up") + step).alias("up")
        )
        paths = staged(paths.unionByName(further), "chat-paths")
        if 2 * step < longest:
            next_ = hop.select(F.col("_c").alias("conv_id"), F.col("_m").alias("message"), F.col("above").alias("_via"))
            far = hop.select("_c", "_m", F.col("above").alias("_far"))
            jump = staged(
                next_.join(far, on & (F.col("_via") == F.col("_m"))).select("conv_id", "message", F.col("_far").alias("above")),
                "chat-jumps",
            )
        step *= 2
    ended = paths.join(
        roots, F.col("conv_id").eqNullSafe(F.col("_rc")) & (F.col("message") == F.col("_rm"))
    ).select(F.col("conv_id").alias("_c"), F.col("leaf").alias("_l"))
    return paths.join(ended, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("leaf") == F.col("_l")), "left_semi")


def once(messages: DataFrame) -> DataFrame:
    """``messages`` with one row of each (conv_id, message): the first by parent (nulls
    first), role, text and score."""
    columns = ("parent", "role", "text", "score")
    first = messages.groupBy("conv_id", "message").agg(F.min(F.struct(*columns)).alias("m"))
    return first.select("conv_id", "message", *(F.col(f"m.{c}").alias(c) for c in columns))


def format_trees(messages: DataFrame, branches: int = 1, unique: bool = False) -> DataFrame:
    """One row per chosen path: conv_id, branch (rank from 1), leaf, formatted, loss_spans.

    ``messages`` has conv_id, message, parent, role, text and score.  Of repeated
    (conv_id, message) one row counts, see ``once``; ``unique`` says that there are none.
    A path's score is the sum of its messages' scores; ties go to the longer
    path, then to the smaller leaf.  loss_spans are (begin, end) in code points of each
    assistant text inside ``formatted``.  Only the chosen paths' texts are moved.
    """
    messages = messages if unique else once(messages)
    paths = leaf_paths(messages)
    scores = messages.select(F.col("conv_id").alias("_sc"), F.col("message").alias("_sm"), F.coalesce("score", F.lit(0.0)).alias("_score"))
    totals = (
        paths.join(scores, F.col("conv_id").eqNullSafe(F.col("_sc")) & (F.col("message") == F.col("_sm")))
        .groupBy("conv_id", "leaf").agg(F.sum("_score").alias("_total"), F.count(F.lit(1)).alias("_length"))
    )
    best = Window.partitionBy("conv_id").orderBy(F.desc("_total"), F.desc("_length"), "leaf")
    chosen = (
        totals.withColumn("branch", F.row_number().over(best)).where(F.col("branch") <= branches)
        .select(F.col("conv_id").alias("_c"), F.col("leaf").alias("_l"), "branch")
    )
    kept = paths.join(chosen, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("leaf") == F.col("_l"))).drop("_c", "_l")
    said = messages.select(F.col("conv_id").alias("_tc"), F.col("message").alias("_tm"), "role", "text")
    turns = kept.join(said, F.col("conv_id").eqNullSafe(F.col("_tc")) & (F.col("message") == F.col("_tm")))
    head = F.concat(F.lit("<|"), _replace(escape(F.col("role")), ("|", "&bar;")), F.lit("|>"))
    body = escape(F.col("text"))
    turns = turns.select(
        "conv_id", "branch", "leaf",
        F.struct((-F.col("up")).alias("at"), head.alias("head"), body.alias("body"), (F.col("role") == "assistant").alias("loss")).alias("t"),
    )
    rows = turns.groupBy("conv_id", "branch", "leaf").agg(F.array_sort(F.collect_list("t")).alias("_turns"))
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<begin:int,end:int>>").alias("spans"))

    def onward(state: Column, t: Column) -> Column:
        first = state["at"] + F.length(t["head"])
        last = first + F.length(t["body"])
        span = F.array(F.struct(first.alias("begin"), last.alias("end")))
        return F.struct(
            (last + len(END)).alias("at"),
            F.when(t["loss"], F.concat(state["spans"], span)).otherwise(state["spans"]).alias("spans"),
        )

    return rows.select(
        "conv_id", "branch", "leaf",
        F.concat_ws("", F.transform("_turns", lambda t: F.concat(t["head"], t["body"], F.lit(END)))).alias("formatted"),
        F.aggregate("_turns", begin, onward)["spans"].alias("loss_spans"),
    )
