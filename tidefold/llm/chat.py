"""Chat formatting of reply trees.

Paths are found on keys alone, by joins of the reply relation with itself that
double the distance each time; texts are joined once, to the chosen paths.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import scratch, stored

#: What the template is made of. Roles outside NAMES are written with a leading @.
HEAD, TAIL = "### ", "</turn>\n"
NAMES = {"system": "System", "user": "User", "assistant": "Assistant"}


def escaped(text: Column, more: dict[str, str] | None = None) -> Column:
    r"""Reversibly free of template marks: \, # and < become \b, \h and \l."""
    for mark, letter in {"\\": "b", "#": "h", "<": "l", **(more or {})}.items():
        text = F.replace(text, F.lit(mark), F.lit("\\" + letter))
    return text


def unescaped(text: Column, more: dict[str, str] | None = None) -> Column:
    marks = {"#": "h", "<": "l", **(more or {}), "\\": "b"}  # every backslash begins a pair, so the order is free but for \b
    for mark, letter in marks.items():
        text = F.replace(text, F.lit("\\" + letter), F.lit(mark))
    return text


def turn_text(role: Column, text: Column) -> Column:
    """One formatted turn: ### Role: text</turn>, with roles and texts escaped."""
    name = F.concat(F.lit("@"), escaped(role, {":": "c"}))
    for plain, shown in NAMES.items():
        name = F.when(role == plain, F.lit(shown)).otherwise(name)
    return F.concat(F.lit(HEAD), name, F.lit(": "), escaped(text), F.lit(TAIL))


def read_back(formatted: Column) -> Column:
    """Array of (role, text) of a formatted conversation."""
    pieces = F.array_remove(F.split(formatted, TAIL), "")

    def turn(piece: Column) -> Column:
        body = F.substring(piece, F.lit(len(HEAD) + 1), F.length(piece))
        at = F.instr(body, ": ")
        name = F.substring(body, F.lit(1), at - 1)
        role = unescaped(F.substring(name, F.lit(2), F.length(name)), {":": "c"})
        for plain, shown in NAMES.items():
            role = F.when(name == shown, F.lit(plain)).otherwise(role)
        return F.struct(role.alias("role"), unescaped(F.substring(body, at + 2, F.length(body))).alias("text"))

    return F.transform(pieces, turn)


def linear_replies(turns: DataFrame, span: int = 512) -> DataFrame:
    """(tree, node, parent, role, text) of conversations given by rows (conv_id, turn, role, text).

    Each turn answers the one before it. Null turns come first; turns of the
    same number are in order of role and text, so repeated rows follow each
    other. A node is (turn, place among its equals). The order is taken within
    spans of `span` turn numbers, and the first of a span is joined to the last
    of the span before, so a long conversation is not ordered in one task.
    """
    tree = F.struct(F.col("conv_id").isNull().alias("none"), F.coalesce("conv_id", F.lit(0)).cast("long").alias("id"))
    text, role = F.coalesce(F.col("text"), F.lit("")), F.coalesce(F.col("role"), F.lit(""))
    df = turns.select(tree.alias("tree"), F.coalesce(F.col("turn").cast("long"), F.lit(-(2**62))).alias("turn"), role.alias("role"), text.alias("text"))
    tie = F.row_number().over(Window.partitionBy("tree", "turn").orderBy("role", "text"))
    df = df.withColumn("node", F.struct(F.col("turn"), tie.alias("tie"))).withColumn("span", F.floor(F.col("turn") / span))
    before = F.lag("node").over(Window.partitionBy("tree", "span").orderBy("node"))
    df = df.withColumn("parent", before)
    spans = df.groupBy("tree", "span").agg(F.max("node").alias("last"))
    spans = spans.select("tree", "span", F.lag("last").over(Window.partitionBy("tree").orderBy("span")).alias("last"))
    df = df.join(spans, ["tree", "span"])
    return df.select("tree", "node", F.coalesce("parent", "last").alias("parent"), "role", "text")


def ranked_paths(replies: DataFrame, score: Column, per_tree: int = 1) -> DataFrame:
    """(tree, leaf, path_rank, path_score, node, depth): the nodes of the `per_tree` best root-to-leaf paths of each tree.

    A path's score is the mean of its nodes' scores; null scores count as 0,
    ties go to the longer path, then to the smaller leaf. Nodes whose parent
    is missing are roots. Self-joins double how far each node sees: after k
    rounds it knows its 2^k-th ancestor and the sum of the scores up to there,
    so a path of n nodes takes log2(n) rounds and every round has one row per
    node still on its way. Chosen leaves then walk the same ancestors back,
    farthest first. A cycle of replies has no root and thus no path.
    """
    with scratch():
        nodes = replies.select("tree", "node", "parent", F.coalesce(score.cast("double"), F.lit(0.0)).alias("s"))
        known = nodes.select("tree", F.col("node").alias("parent"), F.lit(True).alias("known"))
        nodes = nodes.join(known.distinct(), ["tree", "parent"], "left")
        nodes = stored(nodes.select("tree", "node", F.when(F.col("known"), F.col("parent")).alias("up"), "s", F.lit(1).cast("long").alias("n")), "nodes")
        steps, done, now = [], nodes.where(F.col("up").isNull()), nodes.where(F.col("up").isNotNull())
        size = nodes.count()
        while now.take(1):
            if 2 ** len(steps) > size:
                break  # only cycles go on for longer than there are nodes
            now = stored(now, "steps")
            steps.append(now)
            everything = done.unionByName(now)
            above = everything.select("tree", F.col("node").alias("up"), F.col("up").alias("up2"), F.col("s").alias("s2"), F.col("n").alias("n2"))
            joined = now.join(above, ["tree", "up"]).select("tree", "node", F.col("up2").alias("up"), (F.col("s") + F.col("s2")).alias("s"), (F.col("n") + F.col("n2")).alias("n"))
            joined = stored(joined, "joined")
            done = done.unionByName(joined.where(F.col("up").isNull()))
            now = joined.where(F.col("up").isNotNull())
        parents = nodes.where(F.col("up").isNotNull()).select("tree", F.col("up").alias("node")).distinct()
        leaves = done.join(parents, ["tree", "node"], "left_anti").select("tree", F.col("node").alias("leaf"), (F.col("s") / F.col("n")).alias("path_score"), F.col("n").alias("length"))
        best = Window.partitionBy("tree").orderBy(F.desc("path_score"), F.desc("length"), "leaf")
        leaves = leaves.withColumn("path_rank", F.row_number().over(best)).where(F.col("path_rank") <= per_tree)
        found = stored(leaves.select("tree", "leaf", "path_rank", "path_score", F.col("leaf").alias("node"), F.col("length").alias("depth")), "paths")
        for k in reversed(range(len(steps))):
            up = steps[k].select("tree", "node", "up")
            more = found.join(up, ["tree", "node"]).withColumn("node", F.col("up")).withColumn("depth", F.col("depth") - 2**k).drop("up")
            found = found.unionByName(more)
            if k % 4 == 3:
                found = stored(found, "paths")
        return stored(found, "paths", apart=True)


def formatted(replies: DataFrame, score: Column, per_tree: int = 1) -> DataFrame:
    """(tree, path_rank, path_score, formatted, mask): one row per chosen path.

    `formatted` is the conversation in the template; `mask` lists (start,
    length) in code points of the parts under the loss, which are the escaped
    texts of assistant turns. A path is one value, so a conversation must fit
    in a row; nothing but its own turns is gathered for it.
    """
    paths = ranked_paths(replies, score, per_tree)
    text = replies.select("tree", "node", F.col("role"), turn_text(F.col("role"), F.col("text")).alias("piece"), F.length(escaped(F.col("text"))).alias("own"))
    turns = paths.join(text, ["tree", "node"])
    turns = turns.groupBy("tree", "leaf", "path_rank", "path_score").agg(F.sort_array(F.collect_list(F.struct("depth", "role", "piece", "own"))).alias("turns"))
    ends = F.aggregate(
        "turns",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("mask")),
        lambda acc, x: F.struct(
            (acc["at"] + F.length(x["piece"])).alias("at"),
            F.when((x["role"] == "assistant") & (x["own"] > 0), F.concat(acc["mask"], F.array(F.struct((acc["at"] + F.length(x["piece"]) - len(TAIL) - x["own"]).alias("start"), x["own"].alias("length"))))).otherwise(acc["mask"]).alias("mask"),
        ),
        lambda acc: acc["mask"],
    )
    return turns.select("tree", "path_rank", "path_score", F.array_join(F.transform("turns", lambda x: x["piece"]), "").alias("formatted"), ends.alias("mask"))


def loss_text(text: Column, mask: Column) -> Column:
    """What is under the mask, unescaped, in order."""
    return F.array_join(F.transform(mask, lambda m: unescaped(F.substring(text, m["start"] + 1, m["length"]))), "")


FORMATTED_SQL = r"""
WITH t AS (
  SELECT conv_id, coalesce(turn, -4611686018427387904) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, * FROM (VALUES (0, 'user', '\### Assistant: </turn> ok'), (1, 'assistant', '\### Assistant: </turn> ok'))
), e AS (
  SELECT *, replace(replace(replace(text, '\', '\b'), '#', '\h'), '<', '\l') AS esc,
         CASE WHEN role IN ('system', 'user', 'assistant') THEN role
              ELSE '@' || replace(replace(replace(replace(role, '\', '\b'), '#', '\h'), '<', '\l'), ':', '\c') END AS name FROM t
), a AS (
  SELECT conv_id, count(*) AS n_turns,
         string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS plain,
         coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
         sum(4 + length(name) + 2 + length(esc) + 8)::BIGINT AS formatted_chars
  FROM e GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(plain) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM a
"""
