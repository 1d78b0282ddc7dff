r"""Chat formatting of reply trees, with DataFrame functions only.

A reply tree is a table of messages with their parents.  Iterative self-joins
double the reach of every message's ancestor pointer, and sum the scores on the
way.  Going back from the farthest to the nearest pointer, every leaf first adds
up its path in one row; branches of a tree are ranked by the mean score of their
messages, and only the best then collect their messages by the same pointers.  A
path of n messages takes about log2(n) joins for each of the three.  Each chosen
root-to-leaf path is formatted as one conversation.

Template of a turn: ``<|im_start|>role<|im_sep|>text<|im_end|>``.  Inside roles
and texts a backslash is doubled, and one is set after the first character of
anything that could be read as a control string (``<|``, ``<s>``, ``</s>``,
``[INST]``, ``[/INST]``); dropping each backslash that precedes a character
undoes both.  The loss mask lists (start, length) in code points of the escaped
texts of assistant turns.

Edge cases: null roles and texts are empty; a message whose parent is missing is
a root; messages on or below a cycle are on no path and left out; a path longer
than 2 ** 40 messages raises; ties of branch
scores go to the longer path, then to the smaller leaf; null scores count 0; one
conversation is one row, however long; an empty table gives no rows; columns
beyond those named are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.llm import scratch

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
CONTROL = r"([<\[])(?=\||/?s>|/?INST\])"


def escape(text: Column) -> Column:
    doubled = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, CONTROL, r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def pointers(messages: DataFrame, most_rounds: int = 40) -> tuple[list[DataFrame], DataFrame]:
    """(node, up, total) of all ancestors 1, 2, 4 ... steps above, and the leaves that end a path.

    ``total`` is the sum of scores from the node to just below ``up``.
    """
    nodes = messages.select("node", "parent", F.coalesce("score", F.lit(0.0)).alias("score"))
    known = nodes.select(F.col("node").alias("parent"))
    jump = scratch.store(nodes.where(F.col("parent").isNotNull()).join(known, "parent", "left_semi").select("node", F.col("parent").alias("up"), F.col("score").alias("total")), "chat-jump")
    jumps, count, tangled = [], jump.count(), None
    while count:
        if len(jumps) == most_rounds:
            raise RuntimeError(f"paths of over 2 ** {most_rounds} messages")
        jumps.append(jump)
        above = jump.select(F.col("node").alias("up"), F.col("up").alias("farther"), F.col("total").alias("more"))
        farther = jump.join(above, "up").select("node", F.col("farther").alias("up"), (F.col("total") + F.col("more")).alias("total"))
        jump, before = scratch.store(farther, "chat-jump"), count
        count = jump.count()
        if count == before:
            tangled = jump  # only cycles keep their number
            break
    parents = nodes.select(F.col("parent").alias("node")).where(F.col("node").isNotNull())
    leaves = nodes.select("node").join(parents, "node", "left_anti")
    if tangled is not None:
        leaves = leaves.join(tangled.select("node"), "node", "left_anti")
    return jumps, leaves.select(F.col("node").alias("leaf"))


def ranked(messages: DataFrame, jumps: list[DataFrame], leaves: DataFrame, branches: int) -> DataFrame:
    """(leaf, tree, branch) of the best branches of every tree."""
    at = leaves.select("leaf", F.col("leaf").alias("node"), F.lit(0.0).alias("sum"), F.lit(1).cast("long").alias("depth"))
    for k in reversed(range(len(jumps))):
        far = F.col("up").isNotNull()
        steps = F.when(far, F.lit(1 << k)).otherwise(F.lit(0)).cast("long")
        at = at.join(jumps[k], "node", "left").select("leaf", F.coalesce("up", "node").alias("node"), (F.col("sum") + F.coalesce("total", F.lit(0.0))).alias("sum"), (F.col("depth") + steps).alias("depth"))
    ended = at.join(messages.select("node", F.coalesce("score", F.lit(0.0)).alias("last")), "node")
    scored = ended.select("leaf", "depth", ((F.col("sum") + F.col("last")) / F.col("depth")).alias("score"))
    placed = scored.join(messages.select(F.col("node").alias("leaf"), "tree"), "leaf")
    best = Window.partitionBy("tree").orderBy(F.col("score").desc(), F.col("depth").desc(), "leaf")
    return placed.withColumn("branch", F.row_number().over(best)).where(F.col("branch") <= branches).select("leaf", "tree", "branch")


def paths(jumps: list[DataFrame], leaves: DataFrame) -> DataFrame:
    """(leaf, node, back): every message on the path of the leaves, ``back`` steps above it."""
    found = leaves.select("leaf", F.col("leaf").alias("node"), F.lit(0).cast("long").alias("back"))
    for k in reversed(range(len(jumps))):
        joined = found.join(jumps[k].select("node", "up"), "node", "left")
        here = F.struct("node", "back")
        there = F.struct(F.col("up").alias("node"), (F.col("back") + F.lit(1 << k)).alias("back"))
        both = F.when(F.col("up").isNull(), F.array(here)).otherwise(F.array(here, there))
        found = joined.select("leaf", F.explode(both).alias("m")).select("leaf", "m.node", "m.back")
    return found


def conversations(messages: DataFrame, branches: int = 1) -> DataFrame:
    """Format the best branches: tree, leaf, branch, formatted, loss.

    ``messages`` has tree, node (unique), parent, role, text, score.
    """
    jumps, leaves = pointers(messages)
    chosen = scratch.store(ranked(messages, jumps, scratch.store(leaves, "chat-leaves"), branches), "chat-branches")
    turns = paths(jumps, chosen).join(chosen, "leaf").join(messages.select("node", "role", "text"), "node")
    head = F.concat(F.lit(START), escape(F.col("role")), F.lit(SEP))
    text = escape(F.col("text"))
    turns = turns.select("tree", "leaf", "branch", (-F.col("back")).alias("place"), F.coalesce(F.col("role") == "assistant", F.lit(False)).alias("loss"), head.alias("head"), text.alias("said"))
    before = Window.partitionBy("leaf").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    size = F.length("head") + F.length("said") + len(END)
    turns = turns.withColumn("start", F.coalesce(F.sum(size).over(before), F.lit(0)) + F.length("head"))
    turn = F.struct("place", F.concat("head", "said", F.lit(END)).alias("piece"), "loss", F.col("start").cast("long").alias("start"), F.length("said").cast("long").alias("length"))
    whole = turns.groupBy("leaf").agg(F.first("tree").alias("tree"), F.first("branch").alias("branch"), F.array_sort(F.collect_list(turn)).alias("turns"))
    return whole.select(
        "tree",
        "leaf",
        "branch",
        F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("formatted"),
        F.transform(F.filter("turns", lambda t: t["loss"]), lambda t: F.struct(t["start"].alias("start"), t["length"].alias("length"))).alias("loss"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """Turns and loss text parsed from formatted conversations alone."""
    pieces = F.filter(F.split("formatted", r"<\|im_end\|>"), lambda p: p != "")
    parts = F.transform(pieces, lambda p: F.split(F.substr(p, F.lit(len(START) + 1)), r"<\|im_sep\|>"))
    turns = F.transform(parts, lambda p: F.struct(unescape(p[0]).alias("role"), unescape(p[1]).alias("text")))
    under = F.transform("loss", lambda s: unescape(F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    return formatted.withColumn("turns", turns).withColumn("loss_text", F.array_join(under, ""))


def chains(rows: DataFrame) -> DataFrame:
    """Linear conversations as reply trees: every row answers the one before it."""
    order = Window.partitionBy("extra", "conv_id").orderBy("turn", "role", "text")
    numbered = rows.withColumn("n", F.row_number().over(order))
    name = F.concat(F.when(F.col("extra"), "x").otherwise(""), F.coalesce(F.col("conv_id").cast("string"), F.lit("-")), F.lit(":"))
    return numbered.select(
        F.struct("extra", "conv_id").alias("tree"),
        F.concat(name, F.col("n")).alias("node"),
        F.when(F.col("n") > 1, F.concat(name, F.col("n") - 1)).alias("parent"),
        "role",
        "text",
        F.lit(0.0).alias("score"),
    )


def report(rows: DataFrame) -> DataFrame:
    """All conversations and conversation -1, formatted and read back."""
    spark = rows.sparkSession
    said = "</s>[INST] ok [/INST]"
    probe = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"), F.lit(True).alias("extra"))
    own = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text", F.lit(False).alias("extra"))
    messages = scratch.store(chains(own.unionByName(probe)), "chat-messages")
    out = read_back(scratch.store(conversations(messages), "chat-formatted"))
    flat = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        F.col("tree.conv_id").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(flat, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


ORACLE = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, length(regexp_replace(regexp_replace(replace(text, '\', '\\'), '<(\||/?s>)', '<\\\1', 'g'), '\[(/?INST\])', '[\\\1', 'g')) AS t_len,
         length(regexp_replace(regexp_replace(replace(role, '\', '\\'), '<(\||/?s>)', '<\\\1', 'g'), '\[(/?INST\])', '[\\\1', 'g')) AS r_len
  FROM c
)
SELECT conv_id::BIGINT AS conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(32 + r_len + t_len)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
