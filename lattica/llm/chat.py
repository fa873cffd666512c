"""Reply trees formatted as conversations, with DataFrame operations only.

Self-joins double the distance of each message's known ancestor until all reach their root;
that gives depths and branch scores in log2(depth) joins, without a list of ancestors in any
row. The best-scored leaves of a tree are chosen, their paths marked by walking the same
joins from the longest distance down, and each path is formatted as one string.

Template: <|im_start|>ROLE<|im_sep|>TEXT<|im_end|> for each turn. In roles and texts a
backslash is doubled, and the control strings below get one after their first character, so
none is left; dropping each backslash and keeping the character after it restores the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: First characters of control strings and what follows them.
CONTROL = r"(<)(?=\||/?s>|<SYS>>|</SYS>>)|(\[)(?=/?INST\])"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), CONTROL, r"$1$2\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def chosen_paths(messages: DataFrame, paths: int = 1) -> DataFrame:
    """messages (conv_id, node, parent, score) -> (conv_id, leaf, rank, node, depth): the
    messages of each conversation's `paths` best root-to-leaf paths. A path's score is the
    sum of its messages' (null: 0); ties go to the smaller leaf. depth is 0 at the root.
    A parent that isn't in the conversation makes its message a root. Messages on a cycle
    have no root and are left out. Nodes must be distinct and not null in a conversation.
    """
    own = messages.select("conv_id", "node", "parent", F.coalesce("score", F.lit(0)).cast("double").alias("score"))
    is_node = own.select(F.col("conv_id").alias("_c"), F.col("node").alias("_p"))
    level = cut(own.join(is_node, (F.col("conv_id") == F.col("_c")) & (F.col("parent") == F.col("_p")), "left").select("conv_id", "node", F.col("_p").alias("up"), F.lit(1).cast("long").alias("dist"), "score"))
    nodes, jumps = level.select("conv_id", "node", "up"), []
    limit = max(1, level.count()).bit_length() + 1
    done, open_ = level.where("up is null"), level.where("up is not null")
    while not open_.isEmpty() and len(jumps) < limit:  # only what hasn't reached its root is joined again
        jumps.append(open_.select("conv_id", "node", "up"))
        above = done.unionByName(open_).select(F.col("conv_id").alias("_c"), F.col("node").alias("_n"), F.col("up").alias("_up"), F.col("dist").alias("_d"), F.col("score").alias("_s"))
        level = cut(open_.join(above, (F.col("conv_id") == F.col("_c")) & (F.col("up") == F.col("_n"))).select("conv_id", "node", F.col("_up").alias("up"), (F.col("dist") + F.col("_d")).alias("dist"), (F.col("score") + F.col("_s")).alias("score")))
        done, open_ = done.unionByName(level.where("up is null")), level.where("up is not null")
    rooted = done.select("conv_id", "node", (F.col("dist") - 1).alias("depth"), "score")
    inner = nodes.where("up is not null").select("conv_id", F.col("up").alias("node")).distinct()
    best = Window.partitionBy("conv_id").orderBy(F.desc("score"), "node")
    leaves = rooted.join(inner, ["conv_id", "node"], "left_anti").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= paths)
    marked = leaves.select("conv_id", F.col("node").alias("leaf"), "rank", "node")
    for jump in reversed(jumps):
        up = marked.join(jump, ["conv_id", "node"]).select("conv_id", "leaf", "rank", F.col("up").alias("node"))
        marked = cut(marked.unionByName(up))
    return marked.distinct().join(rooted.select("conv_id", "node", "depth"), ["conv_id", "node"])


def format_paths(paths: DataFrame, messages: DataFrame) -> DataFrame:
    """chosen paths and messages (conv_id, node, role, text) -> (conv_id, leaf, formatted,
    loss_spans): spans (from 1, length; in characters) hold the assistant's texts as written
    in formatted. Null roles and texts count as empty."""
    said = messages.select("conv_id", "node", F.coalesce("role", F.lit("")).alias("role"), escape(F.coalesce("text", F.lit(""))).alias("text"))
    turn = paths.join(said, ["conv_id", "node"]).withColumn("head", F.concat(F.lit(START), escape(F.col("role")), F.lit(SEP)))
    size = F.length("head") + F.length("text") + len(END)
    before = Window.partitionBy("conv_id", "leaf").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    turn = turn.withColumn("start", F.coalesce(F.sum(size).over(before), F.lit(0)) + F.length("head") + 1)
    whole = turn.groupBy("conv_id", "leaf").agg(F.sort_array(F.collect_list(F.struct("depth", F.concat("head", "text", F.lit(END)).alias("turn"), F.struct(F.col("start").cast("long").alias("start"), F.length("text").cast("long").alias("size")).alias("span"), (F.col("role") == "assistant").alias("learn")))).alias("turns"))
    return whole.select("conv_id", "leaf", F.array_join(F.col("turns.turn"), "").alias("formatted"), F.transform(F.filter("turns", lambda t: t["learn"]), lambda t: t["span"]).alias("loss_spans"))


def read_turns(formatted: Column) -> Column:
    """formatted -> array<struct<role, text>>, unescaped."""
    parts = F.split(formatted, r"<\|im_end\|>", -1)
    cells = F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda p: F.split(p, r"<\|im_sep\|>", 2))
    return F.transform(cells, lambda c: F.struct(unescape(F.substr(c[0], F.lit(len(START) + 1))).alias("role"), unescape(c[1]).alias("text")))


#: Stands for a null conv_id inside, where joins need a value.
NO_ID = -(2**63)


def linear(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) -> messages that each reply to the one before.

    Order is by turn, then role and text; nulls come first. Repeated rows are turns of their
    own. A message's score is its length. Rows without a conv_id are one conversation, of conv_id NO_ID
    (as would be rows of that very id).
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = rows.select(F.coalesce("conv_id", F.lit(NO_ID)).alias("conv_id"), "turn", "role", "text").withColumn("node", F.row_number().over(order).cast("long"))
    return rows.select("conv_id", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), F.coalesce(F.length("text"), F.lit(0)).cast("double").alias("score"), "role", "text")
