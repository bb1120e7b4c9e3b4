r"""Reply trees to training conversations, in DataFrame operations.

Messages form trees by their parent. Every message's distance from its root and
the score of the path to it come from self-joins that double the reach each time,
so a tree of depth d takes log2(d) rounds. The leaves of a tree are its branches;
they are ranked by score, and the messages of each chosen branch are enumerated
by going down the same jump tables from the leaf. A branch is formatted as one
conversation:

    <|im_start|>role\ntext<|im_end|>\n

Control strings inside texts can't be mistaken for marks: a backslash is doubled
and ``<|`` becomes ``<\|``, which ``unescape`` takes back; a role's line feed
becomes ``<\n`` in letters. The loss mask is a list of spans (start and length in
code points) over the formatted text that covers the assistant's texts.

Defined results: a null text or role is empty; a null conversation id is an id of
its own; a parent that isn't in the conversation makes a root; messages in a
parent cycle hang on no root and are left out; equal scores go to the smaller
leaf; columns other than those named are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pointloom.llm._util import cut_lineage

START, END = "<|im_start|>", "<|im_end|>\n"
ASSISTANT = "assistant"
_MAX_ROUNDS = 40


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("<\\n"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("<\\n"), F.lit("\n")))


def _right(df: DataFrame, **names: str) -> DataFrame:
    """``df`` with the conversation as c2 and other columns renamed, for the right side of a join."""
    return df.select(F.col("conv").alias("c2"), *(F.col(old).alias(new) for new, old in names.items()))


def _on(left: str, right: str) -> Column:
    return F.col("conv").eqNullSafe(F.col("c2")) & (F.col(left) == F.col(right))


def reply_paths(nodes: DataFrame, top_k: int = 1) -> DataFrame:
    """(conv, branch, leaf, depth, node): the messages of each tree's best ``top_k`` branches.

    ``nodes`` has conv, node, parent (null or unknown: a root) and score.
    ``branch`` counts from 1 in a conversation, the best one first.
    """
    own = cut_lineage(nodes.select("conv", "node", "parent", F.coalesce("score", F.lit(0.0)).alias("score")))
    root = F.col("up").isNull()
    at = cut_lineage(
        own.join(_right(own, up="node"), _on("parent", "up"), "left").select(
            "conv",
            "node",
            "up",
            F.when(root, 0).otherwise(1).cast("long").alias("depth"),
            F.col("score").alias("total"),
            F.when(root, F.col("node")).alias("tree"),
        )
    )
    # (up, depth, total): the highest message reached so far, the steps to it, and the score below it
    jumps = []
    state = at
    while len(jumps) < _MAX_ROUNDS:
        open_ones = state.where("up IS NOT NULL")
        left = open_ones.count()
        if left == 0 or (jumps and left == jumps[-1][1]):
            break
        jumps.append((open_ones.select("conv", "node", "up"), left))
        further = _right(state, n2="node", up2="up", d2="depth", t2="total", tree2="tree")
        climbed = open_ones.join(further, _on("up", "n2")).select(
            "conv",
            "node",
            F.col("up2").alias("up"),
            (F.col("depth") + F.col("d2")).alias("depth"),
            (F.col("total") + F.col("t2")).alias("total"),
            F.coalesce("tree", "tree2").alias("tree"),
        )
        state = cut_lineage(state.where("up IS NULL").union(climbed))
    done = state.where("up IS NULL")
    has_reply = _right(at.where("up IS NOT NULL"), n2="up").distinct()
    leaves = done.join(has_reply, _on("node", "n2"), "left_anti")
    in_tree = Window.partitionBy("conv", "tree").orderBy(F.desc("total"), "node")
    in_conv = Window.partitionBy("conv").orderBy(F.desc("total"), "node")
    best = leaves.withColumn("rank", F.row_number().over(in_tree)).where(F.col("rank") <= top_k)
    best = best.withColumn("branch", F.row_number().over(in_conv)).select("conv", "branch", F.col("node").alias("leaf"), F.col("node"))
    reached = best
    for table, _ in reversed(jumps):
        up = reached.join(_right(table, n2="node", up="up"), _on("node", "n2")).select("conv", "branch", "leaf", F.col("up").alias("node"))
        reached = cut_lineage(reached.union(up))
    return reached.join(_right(done, n2="node", depth="depth"), _on("node", "n2")).select("conv", "branch", "leaf", "depth", "node")


def format_conversations(messages: DataFrame, top_k: int = 1) -> DataFrame:
    """(conv, branch, formatted, loss_spans) from ``messages``: conv, node, parent, role, text, score."""
    paths = reply_paths(messages, top_k)
    said = messages.select("conv", "node", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = paths.join(_right(said, n2="node", role="role", text="text"), _on("node", "n2"))
    head = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"))
    turns = turns.select("conv", "branch", "depth", "role", head.alias("head"), escape(F.col("text")).alias("body"))
    before = Window.partitionBy("conv", "branch").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    size = F.length("head") + F.length("body") + F.lit(len(END))
    start = F.coalesce(F.sum(size.cast("long")).over(before), F.lit(0)) + F.length("head")
    span = F.when(F.col("role") == ASSISTANT, F.struct(start.cast("long").alias("start"), F.length("body").cast("long").alias("length")))
    placed = turns.select("conv", "branch", "depth", F.concat("head", "body", F.lit(END)).alias("turn"), span.alias("span"))
    ordered = F.array_sort(F.collect_list(F.struct("depth", "turn", "span")))  # one branch
    return placed.groupBy("conv", "branch").agg(ordered.alias("t")).select(
        "conv",
        "branch",
        F.array_join(F.transform("t", lambda x: x["turn"]), "").alias("formatted"),
        F.filter(F.transform("t", lambda x: x["span"]), lambda s: s.isNotNull()).alias("loss_spans"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation, as an array of (role, text)."""
    parts = F.split(formatted, r"<\|im_start\|>")
    parts = F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))

    def turn(part: Column) -> Column:
        role = F.substring_index(part, "\n", 1)
        body = F.substring(part, F.length(role) + 2, F.length(part) - F.length(role) - 1 - len(END))
        return F.struct(unescape_role(role).alias("role"), unescape(body).alias("text"))

    return F.transform(parts, turn)


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")


def linear_messages(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as messages: each replies to the one before it.

    Turns that are equal or null are ordered by role and text, nulls first.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    return conversations.select(F.col("conv_id").alias("conv"), F.row_number().over(order).cast("long").alias("node"), "role", "text").select(
        "conv", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(1.0).alias("score")
    )


def chat_report(conversations: DataFrame) -> DataFrame:
    """Per conversation, read back from its formatted text: turns, loss text, and sizes."""
    chats = format_conversations(cut_lineage(linear_messages(conversations)))
    read = chats.withColumn("turns", read_turns(F.col("formatted"))).withColumn("loss", loss_text(F.col("formatted"), F.col("loss_spans")))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        F.col("conv").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
