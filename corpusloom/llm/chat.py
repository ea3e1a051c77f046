"""Chat formatting of reply trees.

Messages form trees by their parents. Self-joins double the distance that every
message sees upwards until all of them see their root, which gives each leaf
its depth and the score of its branch. A tree's branches are ranked by score and
the chosen ones are walked back up by the same doubled links. So a thread of n
replies takes log2(n) joins, and a message that thousands reply to stays one row.

Each chosen path is written as one conversation::

    <|turn|>role<|text|>text<|end|>\\n

Backslashes inside roles and texts are doubled and a backslash is put into every
control string after its first character, so no marker can stand inside a text
and reading back restores it exactly. The loss mask is a list of spans, in code
points, one per text of a trained role.

Defined results: a null role or text is empty; a null score is 0; a null
conversation is one like any other. A message whose parent isn't there begins a
tree of its own. Equal scores: the longer branch goes first, then the smaller
leaf. Message ids must be unique within a conversation and never null; a cycle
of parents is an error. Empty tables give no conversations. Only the columns
asked for are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.session import materialize

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>\n"
# Markers of this and other common templates; a text may hold any of them.
CONTROL = r"([<\[])(?=\||/?s>|</?SYS>>|/?INST\])"
TRAINED = ("assistant",)


def escape(text: Column) -> Column:
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, CONTROL, r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def chains(
    rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """Rows by turn as messages: each replies to the one before. Rows of one turn follow each other by role and text."""
    picked = rows.select(
        F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text")
    )
    order = Window.partitionBy("conv").orderBy("turn", "role", "text")
    numbered = picked.withColumn("msg", F.row_number().over(order).cast("long"))
    return numbered.select(
        "conv", "msg", F.when(F.col("msg") > 1, F.col("msg") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score")
    )


def _same(a: str, b: str, left: str, right: str) -> Column:
    return F.col(f"{a}.conv").eqNullSafe(F.col(f"{b}.conv")) & (F.col(f"{a}.{left}") == F.col(f"{b}.{right}"))


def _doubled(links: DataFrame) -> list[DataFrame]:
    """Tables ``(conv, msg, up, depth, total)``; in the k-th, ``up`` is the ancestor 2^k above or null.

    ``depth`` and ``total`` count and sum the scores of the messages from the
    message to below ``up``; in the last table all are at their root. Messages
    that see their root aren't joined again.
    """
    steps = [links]
    rounds = max(links.count(), 1).bit_length() + 1
    while True:
        now = steps[-1]
        if not now.where("up is not null").take(1):
            return steps
        if len(steps) > rounds:
            raise ValueError("The parents of some messages form a cycle")
        a, b = now.where("up is not null").alias("a"), now.alias("b")
        joined = a.join(b, _same("a", "b", "up", "msg")).select(
            "a.conv", "a.msg", "b.up", (F.col("a.depth") + F.col("b.depth")).alias("depth"), (F.col("a.total") + F.col("b.total")).alias("total")
        )
        steps.append(materialize(joined.unionByName(now.where("up is null")), "reply-links"))


def best_paths(messages: DataFrame, branches: int = 1) -> DataFrame:
    """``(conv, path, score, pos, msg)``: messages of each conversation's best branches, ``pos`` from the leaf up.

    ``messages`` has ``(conv, msg, parent, score)``. ``path`` ranks the
    conversation's branches by score from 1 to ``branches``.
    """
    facts = messages.select("conv", "msg", "parent", F.coalesce("score", F.lit(0.0)).cast("double").alias("score"))
    a, b = facts.alias("a"), facts.alias("b")
    known = a.join(b, _same("a", "b", "parent", "msg"), "left").select(
        "a.conv", "a.msg", F.col("b.msg").alias("up"), F.lit(1).cast("long").alias("depth"), F.col("a.score").alias("total")
    )
    links = materialize(known, "reply-links")
    steps = _doubled(links)
    answered = links.where("up is not null").alias("b")
    leaves = steps[-1].alias("a").join(answered, _same("a", "b", "msg", "up"), "left_anti")
    rank = Window.partitionBy("conv").orderBy(F.desc("total"), F.desc("depth"), "msg")
    chosen = leaves.withColumn("path", F.row_number().over(rank)).where(F.col("path") <= branches)
    path = materialize(
        chosen.select("conv", "path", F.col("total").alias("score"), F.lit(0).cast("long").alias("pos"), "msg"), "reply-paths"
    )
    for k, step in enumerate(steps[:-1]):
        a, b = path.alias("a"), step.where("up is not null").alias("b")
        above = a.join(b, _same("a", "b", "msg", "msg")).select(
            "a.conv", "a.path", "a.score", (F.col("a.pos") + (1 << k)).alias("pos"), F.col("b.up").alias("msg")
        )
        path = materialize(path.unionByName(above), "reply-paths")
    return path


def format_paths(messages: DataFrame, paths: DataFrame, trained: tuple[str, ...] = TRAINED) -> DataFrame:
    """``(conv, path, score, formatted, loss)`` of every path; ``loss`` holds ``(start, end)`` in code points."""
    a, b = paths.alias("a"), messages.alias("b")
    turns = a.join(b, _same("a", "b", "msg", "msg")).select(
        "a.conv",
        "a.path",
        "a.score",
        (-F.col("a.pos")).alias("at"),
        escape(F.coalesce("b.role", F.lit(""))).alias("role"),
        escape(F.coalesce("b.text", F.lit(""))).alias("text"),
        F.coalesce(F.col("b.role").isin(*trained), F.lit(False)).alias("trained"),
    )
    piece = F.concat(F.lit(TURN), "role", F.lit(TEXT), "text", F.lit(END))
    before = Window.partitionBy("conv", "path").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    placed = turns.withColumn("piece", piece).withColumn("before", F.coalesce(F.sum(F.length("piece")).over(before), F.lit(0)))
    start = F.col("before") + len(TURN) + F.length("role") + len(TEXT)
    spans = placed.withColumn("start", start).withColumn("end", F.col("start") + F.length("text"))
    whole = spans.groupBy("conv", "path").agg(
        F.max("score").alias("score"),
        F.sort_array(F.collect_list(F.struct("at", "piece", "start", "end", "trained"))).alias("turns"),
    )
    loss = F.transform(F.filter("turns", lambda x: x["trained"]), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))
    return whole.select(
        "conv", "path", "score", F.array_join(F.transform("turns", lambda x: x["piece"]), "").alias("formatted"), loss.alias("loss")
    )


def format_conversations(messages: DataFrame, branches: int = 1, trained: tuple[str, ...] = TRAINED) -> DataFrame:
    """The best branches of ``(conv, msg, parent, role, text, score)``, each as one conversation."""
    messages = materialize(messages, "messages")
    return format_paths(messages, best_paths(messages, branches), trained)


def read_turns(formatted: Column) -> Column:
    """Array of ``(role, text)`` that the formatted conversation holds."""
    ended = F.filter(F.split(formatted, r"<\|end\|>\n", -1), lambda x: x != "")

    def turn(piece: Column) -> Column:
        head = F.substring_index(piece, TEXT, 1)
        return F.struct(
            unescape(F.substring_index(head, TURN, -1)).alias("role"), unescape(F.substring_index(piece, TEXT, -1)).alias("text")
        )

    return F.transform(ended, turn)


def read_loss(formatted: Column, loss: Column) -> Column:
    """Array of the texts under the loss mask."""
    return F.transform(
        loss, lambda x: unescape(formatted.substr((x["start"] + 1).cast("int"), (x["end"] - x["start"]).cast("int")))
    )
