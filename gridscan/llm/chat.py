"""Chat formatting of reply trees, in DataFrame functions only.

Messages point at the message they answer.  Ancestors are found by self-joins that double their reach, so a
chain of n messages takes log2(n) of them; they also add up the scores of each branch.  Branches of a tree
are ranked by score, and the messages of a chosen branch are marked by the same doubling steps, hence one
row a message, never one row for each pair of a message and its ancestors.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from gridscan.llm.common import written
from gridscan.plans.ordering import position_in_bins, value_position

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
# Control strings of common chat templates; inside a text each gets a backslash after its first character.
CONTROL = (OPEN, CLOSE, "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
TURNS_PER_BIN = 256


def escaped(text: Column, line: bool = False) -> Column:
    """Backslashes doubled and control strings broken; in a `line`, line feeds get a backslash too."""
    quoted = lambda s: "".join(f"\\{c}" if not c.isalnum() and c != "_" else c for c in s)
    broken = "|".join(f"{quoted(c[0])}(?={quoted(c[1:])})" for c in CONTROL)
    out = F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), broken, r"$0\\")
    return F.regexp_replace(out, "\n", "\\\\\n") if line else out


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def branches(nodes: DataFrame, per_tree: int = 1) -> DataFrame:
    """(tree, leaf, path_rank, node, depth) for the messages on the `per_tree` best branches of every tree.

    `nodes` has tree, node (unique in its tree, not null), parent (null, or unknown in the tree: a root) and
    score (null: 0).  The score of a branch is the mean of its messages' scores; ties go to the smaller leaf.
    Messages on a cycle of parents have no root and are on no branch.
    """
    known = nodes.select("tree", F.col("node").alias("parent"), F.lit(True).alias("found"))
    step = (nodes.join(known, ["tree", "parent"], "left")
            .select("tree", "node", F.when(F.col("found"), F.col("parent")).alias("up"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("total"), F.lit(1).cast("long").alias("depth")))
    # One table a round: its `up` is 2^k messages above the node.
    steps, rows = [written(step, "reply-steps")], None
    while not steps[-1].where("up IS NOT NULL").isEmpty():
        if rows is None:
            rows = steps[0].count()
        if 1 << (len(steps) - 1) > rows:
            break
        last = steps[-1]
        above = last.select("tree", F.col("node").alias("up"), F.col("up").alias("up2"), F.col("total").alias("total2"), F.col("depth").alias("depth2"))
        # Messages that have met their root wait; only the others go on.
        joined = last.where("up IS NOT NULL").join(above, ["tree", "up"], "left")
        joined = joined.select("tree", "node", F.col("up2").alias("up"), (F.col("total") + F.coalesce("total2", F.lit(0.0))).alias("total"), (F.col("depth") + F.coalesce("depth2", F.lit(0))).alias("depth"))
        steps.append(written(joined.union(last.where("up IS NULL").select("tree", "node", "up", "total", "depth")), "reply-steps"))
    reached = steps[-1].where("up IS NULL").select("tree", "node", "depth", (F.col("total") / F.col("depth")).alias("mean"))
    answered = steps[0].where("up IS NOT NULL").select("tree", F.col("up").alias("node")).distinct()
    leaves = reached.join(answered, ["tree", "node"], "left_anti").withColumnRenamed("node", "leaf")
    chosen = value_position(leaves, ["tree"], "mean", ["leaf"], "path_rank", descending=True).where(F.col("path_rank") <= per_tree)
    marked = written(chosen.select("tree", "leaf", "path_rank", F.col("depth").alias("length"), F.col("leaf").alias("node")), "branches")
    whole = []
    for k, step in enumerate(steps):
        # The messages less than 2^k above the leaf are marked; shorter branches are done and set aside.
        whole.append(marked.where(F.col("length") <= 1 << k))
        going = marked.where(F.col("length") > 1 << k)
        if going.isEmpty():
            break
        both = going.join(step.select("tree", "node", "up"), ["tree", "node"], "left")
        marked = written(both.select("tree", "leaf", "path_rank", "length", F.explode(F.filter(F.array("node", "up"), lambda x: x.isNotNull())).alias("node")), "branches")
    else:
        whole.append(marked)
    marked = reduce(DataFrame.union, whole).drop("length")
    return marked.join(reached.select("tree", "node", "depth"), ["tree", "node"])


def format_branches(nodes: DataFrame, per_tree: int = 1, learn_from: str = "assistant") -> DataFrame:
    """One row a chosen branch: tree, path_rank, formatted, segments (text, loss).

    `nodes` as for `branches`, with role and text (null: empty).  The segments joined give `formatted`; loss is
    true for the texts of role `learn_from` alone, not for the marks around them.  The row of a branch holds
    its whole text.  Other columns of `nodes` are ignored; an empty table gives an empty one.
    """
    said = nodes.select("tree", "node", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = branches(nodes, per_tree).join(said, ["tree", "node"])
    turn = F.struct("depth", F.concat(F.lit(OPEN), escaped(F.col("role"), line=True), F.lit("\n")).alias("head"), escaped(F.col("text")).alias("body"), (F.col("role") == learn_from).alias("loss"))
    paths = turns.groupBy("tree", "path_rank", "leaf").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    no = F.lit(False)
    segment = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    segments = F.flatten(F.transform("turns", lambda t: F.array(segment(t["head"], no), segment(t["body"], t["loss"]), segment(F.lit(CLOSE + "\n"), no))))
    return (paths.select("tree", "path_rank", segments.alias("segments"))
            .withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), "")))


def read_back(formatted: Column) -> Column:
    """array<struct<role, text>> of a formatted conversation."""
    parts = F.split(formatted, CLOSE.replace("|", "\\|") + "\n")
    head = F.lit(len(OPEN))

    def turn(t: Column) -> Column:
        role = F.regexp_extract(t, r"(?s)^[^>]*+>([^\\\n]*+(?:\\.[^\\\n]*+)*+)" + "\n", 1)
        return F.struct(unescaped(role).alias("role"), unescaped(F.substring(t, head + F.length(role) + 2, F.length(t))).alias("text"))

    return F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), turn)


def conversation_nodes(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as reply trees: each message answers the one before it.

    Messages go by turn, null turns first, ties by role and text, so repeated rows follow each other.  A null
    conv_id is a conversation of its own.  `tree` is conv_id as text ('' for null); other columns are dropped.
    """
    rows = conversations.select(F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("tree"), F.col("turn").cast("long").alias("turn"), "role", "text")
    bins = F.coalesce(F.floor(F.col("turn") / TURNS_PER_BIN).cast("long"), F.lit(-(1 << 62)))
    numbered = position_in_bins(rows, ["tree"], bins, ["turn", "role", "text"], "node")
    return numbered.select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))
