"""Chat formatting: reply trees, their paths, and a template that can be read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from impactlens.llm.shared import whole
from impactlens.session import materialise

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
#: The escapes in use: the escape sign itself, the first letter of a control string, the line end of a role.
ESCAPES = (("%", "%25"), ("<", "%3C"), ("[", "%5B"), ("\n", "%0A"))
#: Strings that common chat templates and tokenizers read as control, without their first letter.
AFTER_ANGLE, AFTER_BRACKET = r"(?=/?s>|\|[^|<>\n]{1,40}\|>|</?SYS>>)", r"(?=/?INST\])"


def escape(text: Column) -> Column:
    """Hides the first letter of each control string; ``unescape`` gives the same text back."""
    text = F.replace(text, F.lit("%"), F.lit("%25"))
    return F.regexp_replace(F.regexp_replace(text, "<" + AFTER_ANGLE, "%3C"), r"\[" + AFTER_BRACKET, "%5B")


def unescape(text: Column) -> Column:
    for letter, code in reversed(ESCAPES):
        text = F.replace(text, F.lit(code), F.lit(letter))
    return text


def _at(left: str, right: str) -> Column:
    """Joins on a tree, which may be null, and a node."""
    return F.col("tree").eqNullSafe(F.col("_t")) & (F.col(left) == F.col(right))


def _jumps(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame | None]:
    """Tables (tree, node, up) of the ancestors 1, 2, 4, ... steps up, by self-joins; and, if parents run in circles, where to cut them."""
    largest = nodes.groupBy("tree").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    known = nodes.select(F.col("tree").alias("_t"), F.col("node").alias("_n"))
    step = materialise(nodes.join(known, _at("parent", "_n")).select("tree", "node", F.col("parent").alias("up"), F.least("node", "parent").alias("low")))
    out: list[DataFrame] = []
    while not step.isEmpty():
        if 2 ** len(out) > largest:
            # Longer than any tree: what is reached now lies on circles, and each is cut at its smallest node.
            on_circle = step.select("tree", F.col("up").alias("node")).distinct()
            return out, on_circle.join(step.filter("node = low").select("tree", "node"), ["tree", "node"], "left_semi")
        out.append(step.drop("low"))
        above = step.select(F.col("tree").alias("_t"), F.col("node").alias("_n"), F.col("up").alias("_up"), F.col("low").alias("_low"))
        step = materialise(step.join(above, _at("up", "_n")).select("tree", "node", F.col("_up").alias("up"), F.least("low", "_low").alias("low")))
    return out, None


def path_steps(messages: DataFrame) -> DataFrame:
    """(tree, leaf, place, node): every root-to-leaf path of the messages (tree, node, parent), a row per step, places from 0 at the root.

    Rounds of self-joins double the length of all open paths, so their number grows with the logarithm of the depth; only ids
    travel, and the rows of all rounds together are those of the result. A parent that does not exist makes its child a root.
    Parents that run in a circle are cut at its smallest node, which becomes a root. Rows that repeat a node count once.
    """
    nodes = materialise(messages.groupBy("tree", "node").agg(F.min("parent").alias("parent")))
    jumps, circle = _jumps(nodes)
    if circle is not None:
        cut = circle.select(F.col("tree").alias("_t"), F.col("node").alias("_n"))
        nodes = materialise(nodes.join(cut, _at("node", "_n"), "left").select("tree", "node", F.when(F.col("_n").isNull(), F.col("parent")).alias("parent")))
        jumps, _ = _jumps(nodes)
    answered = nodes.select(F.col("tree").alias("_t"), F.col("parent").alias("_n")).filter("_n IS NOT NULL").distinct()
    rows = nodes.join(answered, _at("node", "_n"), "left_anti").select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("up"))
    for k, jump in enumerate(jumps):
        higher = jump.select(F.col("tree").alias("_t"), F.col("node").alias("_n"), F.col("up").alias("_up"))
        further = rows.join(higher, _at("node", "_n")).select("tree", "leaf", F.col("_up").alias("node"), (F.col("up") + 2**k).alias("up"))
        rows = materialise(rows.unionByName(further))
    depth = rows.groupBy(F.col("tree").alias("_t"), F.col("leaf").alias("_l")).agg(F.max("up").alias("_depth"))
    return rows.join(depth, _at("leaf", "_l")).select("tree", "leaf", (F.col("_depth") - F.col("up")).cast("int").alias("place"), "node")


def tree_paths(messages: DataFrame) -> DataFrame:
    """(tree, leaf, path): the paths as arrays of nodes."""
    ordered = F.sort_array(F.collect_list(F.struct("place", "node")))
    return path_steps(messages).groupBy("tree", "leaf").agg(F.transform(ordered, lambda s: s["node"]).alias("path"))


def ranked_paths(messages: DataFrame, per_tree: int | None = 1) -> DataFrame:
    """The best ``per_tree`` paths of every tree (None: all), by the mean score of their messages, null scores as 0, ties to the smaller leaf.

    ``messages``: (tree, node, parent, role, text, score). Returns (tree, leaf, rank, turns), turns as (place, role, text).
    """
    steps = path_steps(messages)
    scores = messages.select(F.col("tree").alias("_t"), F.col("node").alias("_n"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    means = steps.join(scores, _at("node", "_n")).groupBy("tree", "leaf").agg(F.avg("score").alias("mean"))
    ranked = means.withColumn("rank", F.row_number().over(W.partitionBy("tree").orderBy(F.desc("mean"), "leaf")))
    best = ranked if per_tree is None else ranked.filter(F.col("rank") <= per_tree)
    best = best.select(F.col("tree").alias("_t"), F.col("leaf").alias("_l"), "rank")
    chosen = steps.join(best, _at("leaf", "_l")).select("tree", "leaf", "rank", "place", "node")
    said = messages.select(F.col("tree").alias("_t"), F.col("node").alias("_n"), "role", "text")
    full = chosen.join(said, _at("node", "_n"))
    # One path is one conversation, the unit of the output.
    return full.groupBy("tree", "leaf", "rank").agg(F.sort_array(F.collect_list(F.struct("place", "role", "text"))).alias("turns"))


def formatted(paths: DataFrame, learn: str = "assistant") -> DataFrame:
    """Adds ``formatted`` and ``loss_spans``, the (start, length) in code points of each ``learn`` text in it."""
    parts = F.transform("turns", lambda t: F.struct(
        F.concat(F.lit(OPEN), F.replace(escape(whole(t["role"])), F.lit("\n"), F.lit("%0A")), F.lit("\n")).alias("head"),
        escape(whole(t["text"])).alias("body"), F.coalesce(t["role"] == learn, F.lit(False)).alias("learn"),
    ))
    # Lengths first: summing them is linear where growing one string is not.
    sized = paths.withColumn("_parts", parts).withColumn("_tail", F.lit(CLOSE + "\n"))
    starts = F.aggregate(
        "_parts",
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:long,length:long>>").alias("spans")),
        lambda s, p: F.struct(
            (s["at"] + F.length(p["head"]) + F.length(p["body"]) + len(CLOSE) + 1).alias("at"),
            F.when(p["learn"], F.concat(s["spans"], F.array(F.struct((s["at"] + F.length(p["head"])).alias("start"), F.length(p["body"]).cast("long").alias("length")))))
            .otherwise(s["spans"]).alias("spans"),
        ),
        lambda s: s["spans"],
    )
    text = F.array_join(F.transform("_parts", lambda p: F.concat(p["head"], p["body"], F.lit(CLOSE + "\n"))), "")
    return sized.withColumn("formatted", text).withColumn("loss_spans", starts).drop("_parts", "_tail")


def read_turns(text: Column) -> Column:
    """The (role, text) turns of a formatted conversation."""
    blocks = F.filter(F.split(text, r"<\|im_start\|>"), lambda b: b != "")
    return F.transform(blocks, lambda b: F.struct(
        unescape(F.substring_index(b, "\n", 1)).alias("role"),
        unescape(F.substring(b, F.instr(b, "\n") + 1, F.length(b) - F.instr(b, "\n") - (len(CLOSE) + 1))).alias("text"),
    ))


def read_loss(text: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(text, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")


def turn_chain(rows: DataFrame, tree: str, turn: str, role: str, text: str) -> DataFrame:
    """Linear conversations as reply trees: each row answers the one before it by turn (ties: by role, then text)."""
    keyed = rows.select(F.col(tree).alias("tree"), F.col(turn).alias("_turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    order = W.partitionBy("tree").orderBy(F.col("_turn").asc_nulls_last(), "role", "text")
    numbered = keyed.withColumn("node", F.row_number().over(order).cast("long"))
    return numbered.select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))
