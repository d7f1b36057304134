"""Reply trees to training conversations: path enumeration, ranking, template, loss mask.

All of it is DataFrame work.  Jump tables (node to its 2**r-th ancestor) come from
self-joins that double the reach each round, so a tree of depth d takes log2(d)
rounds; path scores are summed on the way.  Leaves are ranked within their tree,
and the jump tables, applied from the longest to the shortest, list the nodes of
each chosen path once.  Only ids and scores go through these joins; texts join
the chosen paths at the end.

Template: ``<|role|>text</s>`` per turn.  Inside texts and roles ``\\``, ``<`` and
``[`` (in roles also ``|``) are written as ``\\e``, ``\\l``, ``\\b`` (``\\p``), so no
control string can stand in a text, and the way back is exact.

Defined results: null role or text: empty; null tree id: one tree of its own; a
parent that does not exist: the node is a root; nodes on a cycle of parents have
no root and so no path; repeated node ids: each repeat is a turn of the path; ties
of score: the smaller leaf id; an empty table gives no conversations.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bindlattice.llm.common import quoted, read, stage

OPEN, SHUT, END = "<|", "|>", "</s>"
_ESCAPES = (("\\", "\\e"), ("<", "\\l"), ("[", "\\b"))
MOST_DOUBLINGS = 40


def _text(s: str) -> Column:
    return F.lit(s)


def escape(column: Column) -> Column:
    for plain, coded in _ESCAPES:
        column = F.replace(column, _text(plain), _text(coded))
    return column


def unescape(column: Column) -> Column:
    for plain, coded in reversed(_ESCAPES):
        column = F.replace(column, _text(coded), _text(plain))
    return column


def _escape_role(column: Column) -> Column:
    return F.replace(escape(column), _text("|"), _text("\\p"))


def _unescape_role(column: Column) -> Column:
    return unescape(F.replace(column, _text("\\p"), _text("|")))


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def reply_paths(nodes: DataFrame, branches: int = 1) -> DataFrame:
    """Rows (tree, leaf, node, back) of the ``branches`` best root-to-leaf paths of each tree.

    ``nodes`` has tree, node, parent (null at roots) and score (null: 0); back
    counts from the leaf, which has 0.  Paths rank by their mean score.
    """
    once = nodes.groupBy("tree", "node").agg(F.min("parent").alias("parent"), F.sum(F.coalesce(F.col("score").cast("double"), F.lit(0.0))).alias("score"))
    known = once.select(F.col("tree").alias("t"), F.col("node").alias("n"))
    now = stage(
        once.join(known, _same("tree", "t") & (F.col("parent") == F.col("n")), "left").select(
            "tree", "node", F.col("n").alias("above"), "score", F.lit(1).cast("long").alias("depth")
        ),
        "jump0",
    )
    jumps, total, done = [], now.count(), []
    for r in range(1, MOST_DOUBLINGS):
        done.append(now.where("above is null"))
        jumps.append(now.where("above is not null"))
        if 1 << (r - 1) > total or jumps[-1].isEmpty():
            break
        # Only nodes that have not reached their root go on.
        upper = reduce(DataFrame.unionByName, done, jumps[-1])
        upper = upper.select(F.col("tree").alias("t"), F.col("node").alias("n"), F.col("above").alias("next"), F.col("score").alias("more"), F.col("depth").alias("levels"))
        now = stage(
            jumps[-1].join(upper, _same("tree", "t") & (F.col("above") == F.col("n")), "left").select(
                "tree", "node", F.col("next").alias("above"), (F.col("score") + F.coalesce("more", F.lit(0.0))).alias("score"), (F.col("depth") + F.coalesce("levels", F.lit(0))).alias("depth")
            ),
            f"jump{r}",
        )
    now = reduce(DataFrame.unionByName, done)
    parents = jumps[0].select(F.col("tree").alias("t"), F.col("above").alias("n")).distinct()
    leaves = now.join(parents, _same("tree", "t") & (F.col("node") == F.col("n")), "left_anti")
    rank = F.row_number().over(Window.partitionBy("tree").orderBy((F.col("score") / F.col("depth")).desc(), "node"))
    paths = leaves.withColumn("rank", rank).where(F.col("rank") <= branches).select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("back"))
    for r in range(len(jumps) - 1, -1, -1):
        up = jumps[r].select(F.col("tree").alias("t"), F.col("node").alias("n"), "above")
        here = F.struct("node", "back")
        there = F.struct(F.col("above").alias("node"), (F.col("back") + (1 << r)).alias("back"))
        both = F.when(F.col("above").isNull(), F.array(here)).otherwise(F.array(here, there))
        paths = paths.join(up, _same("tree", "t") & (F.col("node") == F.col("n")), "left").select("tree", "leaf", F.explode(both).alias("step"))
        paths = paths.select("tree", "leaf", "step.node", "step.back")
    return paths


def format_conversations(messages: DataFrame, branches: int = 1) -> DataFrame:
    """tree, leaf, formatted, loss_spans (start, end in code points) of each chosen path.

    ``messages`` has tree, node, parent, score, role and text.
    """
    paths = reply_paths(messages.select("tree", "node", "parent", "score"), branches)
    said = messages.select(
        F.col("tree").alias("t"), F.col("node").alias("n"),
        _escape_role(F.coalesce("role", _text(""))).alias("role"), escape(F.coalesce("text", _text(""))).alias("text"),
    )
    turns = paths.join(said, _same("tree", "t") & (F.col("node") == F.col("n"))).select(
        "tree", "leaf", (-F.col("back")).alias("at"), "role", "text", F.concat(_text(OPEN), "role", _text(SHUT)).alias("head")
    )
    turns = turns.withColumn("size", (F.length("head") + F.length("text") + len(END)).cast("long"))
    order = Window.partitionBy("tree", "leaf").orderBy("at", "role", "text").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    turns = turns.withColumn("till", F.sum("size").over(order)).withColumn("start", F.col("till") - F.length("text") - len(END))
    turn = F.struct(
        "till", F.concat("head", "text", _text(END)).alias("piece"), F.col("role").eqNullSafe("assistant").alias("learns"), "start", (F.col("till") - len(END)).alias("end")
    )
    grouped = turns.groupBy("tree", "leaf").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    spans = F.transform(F.filter("turns", lambda t: t["learns"]), lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end")))
    return grouped.select("tree", "leaf", F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("formatted"), spans.alias("loss_spans"))


def read_back(conversations: DataFrame) -> DataFrame:
    """Adds turns (role, text) and loss_text, both read from formatted and loss_spans alone."""
    pieces = F.filter(F.split("formatted", END), lambda p: p != "")

    def turn(piece: Column) -> Column:
        role = F.substring_index(F.substr(piece, F.lit(len(OPEN) + 1)), SHUT, 1)
        text = F.substr(piece, F.length(role) + len(OPEN) + len(SHUT) + 1)
        return F.struct(_unescape_role(role).alias("role"), unescape(text).alias("text"))

    learned = F.transform("loss_spans", lambda s: F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))
    return conversations.withColumns({"turns": F.transform(pieces, turn), "loss_text": unescape(F.array_join(learned, ""))})


def as_reply_trees(rows: DataFrame) -> DataFrame:
    """Turns of linear conversations as reply trees: each row answers the one before it."""
    at = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("long")
    return rows.select(F.col("conv_id").cast("long").alias("tree"), at.alias("node"), F.when(at > 1, at - 1).alias("parent"), F.lit(0.0).alias("score"), "role", "text")


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(probe).alias("text")
    )
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    back = read_back(format_conversations(stage(as_reply_trees(rows), "trees")))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], _text("\n"), t["text"], _text("\n"))), "")
    return back.select(
        F.col("tree").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP9_SQL = r"""
WITH m AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, length(role) + length(replace(replace(replace(text, '\', '\e'), '<', '\l'), '[', '\b')) + 8 AS chars FROM m
), g AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS told,
    coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS learned,
    CAST(sum(chars) AS BIGINT) AS formatted_chars
  FROM e GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(told) AS turns_sha256, CAST(length(learned) AS BIGINT) AS loss_chars, sha256(learned) AS loss_sha256, formatted_chars FROM g
"""
