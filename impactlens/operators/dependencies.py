"""Task dependencies: levels, closures, fork trees and plan checks, for all jobs at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from impactlens.session import materialise


def order_waves(tasks: DataFrame, deps: DataFrame) -> DataFrame:
    """(job_id, seq, wave): a task runs after its dependencies and never beside one on the same file.

    ``tasks`` has (job_id, seq, target_file), ``deps`` (job_id, seq, needs). Tasks of a cycle, and those that wait for a
    task that does not exist, have wave NULL. Each task carries the number of its open dependencies; a round takes the lowest
    ready task of each file by an aggregate, so a file with very many tasks is never gathered, and finished jobs drop out.
    """
    needs = materialise(deps.select("job_id", "seq", "needs").distinct())
    counted = needs.groupBy("job_id", "seq").agg(F.count(F.lit(1)).alias("open"))
    remaining = materialise(tasks.select("job_id", "seq", "target_file").distinct().join(counted, ["job_id", "seq"], "left").fillna(0, ["open"]))
    waves: list[DataFrame] = []
    while True:
        ready = remaining.filter("open = 0").groupBy("job_id", "target_file").agg(F.min("seq").alias("seq"))
        wave = materialise(ready.select("job_id", "seq").distinct())
        if wave.isEmpty():
            left = remaining.select("job_id", "seq", F.lit(None).cast("int").alias("wave"))
            return reduce(DataFrame.unionByName, [*waves, left])
        waves.append(wave.withColumn("wave", F.lit(len(waves) + 1)))
        freed = needs.join(wave.withColumnRenamed("seq", "needs"), ["job_id", "needs"]).groupBy("job_id", "seq").agg(F.count(F.lit(1)).alias("freed"))
        rest = remaining.join(wave, ["job_id", "seq"], "left_anti").join(freed, ["job_id", "seq"], "left")
        remaining = materialise(rest.select("job_id", "seq", "target_file", (F.col("open") - F.coalesce("freed", F.lit(0))).alias("open")))


def _onward(walks: DataFrame, paths: DataFrame, near: list[str], far: list[str]) -> DataFrame:
    """Each of ``walks`` with each of ``paths`` that starts where it ends."""
    after = paths.select("job_id", F.col("seq").alias("needs"), F.col("needs").alias("_far"), *[F.col(c).alias(f"_{c}") for c in far])
    return walks.select("job_id", "seq", "needs", *near).join(after, ["job_id", "needs"]).select(
        "job_id", "seq", F.col("_far").alias("needs"), *near, *[F.col(f"_{c}").alias(c) for c in far]
    )


def _walk(edges: DataFrame, near: list[str], far: list[str]) -> DataFrame:
    """All (job_id, seq, needs) that can be reached; ``near`` columns stay with seq, ``far`` ones with needs.

    Path doubling: a walk of 2^r + d steps is one of exactly 2^r and one of d, so the walks of exactly 2^r steps are extended by
    all pairs found, and a pair with one walk is found once. Rounds grow with the logarithm of the depth; where a round finds
    nothing new, no longer walk does, so cycles end too.
    """
    pair = ["job_id", "seq", "needs"]
    whole = paths = materialise(edges.select(*pair, *near, *far).dropDuplicates(pair))
    while not whole.isEmpty():
        fresh = materialise(_onward(whole, paths, near, far).dropDuplicates(pair).join(paths, pair, "left_anti").select(*paths.columns))
        if fresh.isEmpty():
            break
        whole = materialise(_onward(whole, whole, near, far).dropDuplicates(pair))
        paths = paths.unionByName(fresh)
    return paths


def closure(deps: DataFrame) -> DataFrame:
    """(job_id, seq, needs): every transitive dependency."""
    return _walk(deps, [], [])


def dependency_closure(tasks: DataFrame, deps: DataFrame) -> DataFrame:
    """Verified dependencies of each task, transitively, on files other than its own.

    The walk runs through discarded dependencies as well; they are only left out of the answer. Files and states are joined to the
    direct dependencies once and travel with the pairs. Where a task is listed twice, its first file in order counts.
    """
    known = tasks.groupBy("job_id", "seq").agg(F.min(F.struct("target_file", "state")).alias("_t"))
    own = known.select("job_id", "seq", F.col("_t.target_file").alias("own_file"))
    other = known.select("job_id", F.col("seq").alias("needs"), F.col("_t.target_file").alias("target_file"), (F.col("_t.state") == "verified").alias("verified"))
    edges = deps.select("job_id", "seq", "needs").distinct().join(own, ["job_id", "seq"], "left").join(other, ["job_id", "needs"], "left")
    paths = _walk(edges, ["own_file"], ["target_file", "verified"])
    return paths.filter(F.col("verified") & (F.col("own_file") != F.col("target_file"))).select("job_id", "seq", "needs", "target_file")


def fork_tree(nodes: DataFrame) -> DataFrame:
    """(job_id, node, root, depth, children) of a parent forest, by pointer jumping.

    ``nodes`` has (job_id, node, parent); a parent that is no node makes its child a root.
    """
    ids = nodes.select("job_id", F.col("node").alias("parent"), F.lit(True).alias("_known"))
    up = nodes.join(ids, ["job_id", "parent"], "left").select(
        "job_id", "node", F.when(F.col("_known"), F.col("parent")).alias("above")
    )
    children = up.filter(F.col("above").isNotNull()).groupBy("job_id", F.col("above").alias("node")).agg(
        F.count(F.lit(1)).alias("children")
    )
    state = materialise(up.select(
        "job_id", "node", "above", F.coalesce("above", "node").alias("root"),
        F.when(F.col("above").isNull(), 0).otherwise(1).alias("depth"),
    ))
    while not state.filter(F.col("above").isNotNull()).isEmpty():
        jump = state.select(
            "job_id", F.col("node").alias("above"), F.col("above").alias("next"), F.col("root").alias("next_root"),
            F.col("depth").alias("more"),
        )
        state = materialise(
            state.join(jump, ["job_id", "above"], "left").select(
                "job_id", "node", F.col("next").alias("above"), F.coalesce("next_root", "root").alias("root"),
                (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"),
            )
        )
    return state.select("job_id", "node", "root", "depth").join(children, ["job_id", "node"], "left").fillna(0, ["children"])


def plan_violations(tasks: DataFrame, deps: DataFrame, radius: DataFrame, max_tasks: int) -> DataFrame:
    """(job_id, rule, seq): one row per broken rule; seq is NULL for rules about the whole plan.

    ``radius`` has (job_id, target_file).
    """
    def tagged(df: DataFrame, rule: str, seq: str | None = "seq") -> DataFrame:
        return df.select("job_id", F.lit(rule).alias("rule"), (F.col(seq) if seq else F.lit(None)).cast("int").alias("seq"))

    twice = tasks.groupBy("job_id", "seq").count().filter("count > 1")
    too_many = tasks.groupBy("job_id").count().filter(F.col("count") > max_tasks)
    outside = tasks.join(radius.select("job_id", "target_file").distinct(), ["job_id", "target_file"], "left_anti")
    known = tasks.select("job_id", F.col("seq").alias("needs")).distinct()
    unknown = deps.join(known, ["job_id", "needs"], "left_anti").distinct()
    inner = deps.join(known, ["job_id", "needs"], "left_semi")
    on_cycle = cycles(inner)
    return reduce(DataFrame.unionByName, [
        tagged(twice, "duplicate seq"), tagged(too_many, "too many tasks", None),
        tagged(outside.select("job_id", "seq").distinct(), "outside radius"),
        tagged(unknown.select("job_id", "seq").distinct(), "unknown dependency"),
        tagged(on_cycle, "cycle"),
    ])


def _core(edges: DataFrame) -> DataFrame:
    """The edges (job_id, seq, needs) that neither hang off the end of a chain nor start one: those on cycles and on paths between cycles."""
    size = edges.count()
    while size:
        waiting, waited = edges.select("job_id", F.col("seq").alias("needs")).distinct(), edges.select("job_id", F.col("needs").alias("seq")).distinct()
        edges = materialise(edges.join(waiting, ["job_id", "needs"], "left_semi").join(waited, ["job_id", "seq"], "left_semi"))
        before, size = size, edges.count()
        if size == before:
            break
    return edges


def _coloured(edges: DataFrame) -> DataFrame:
    """(job_id, seq, colour): the largest task of the job from which one is reached, itself included; only changed colours go on."""
    ends = edges.select("job_id", "seq").union(edges.select("job_id", "needs")).distinct()
    state = materialise(ends.withColumn("colour", F.col("seq")).withColumn("_changed", F.lit(True)))
    while not state.filter("_changed").isEmpty():
        told = state.filter("_changed").join(edges, ["job_id", "seq"]).groupBy("job_id", F.col("needs").alias("seq")).agg(F.max("colour").alias("_told"))
        state = materialise(state.join(told, ["job_id", "seq"], "left").select(
            "job_id", "seq", F.greatest("colour", "_told").alias("colour"), F.coalesce(F.col("_told") > F.col("colour"), F.lit(False)).alias("_changed")
        ))
    return state.drop("_changed")


def cycles(deps: DataFrame) -> DataFrame:
    """(job_id, seq) of the tasks on a cycle, by forward-backward colouring; what only leads into a cycle or out of one is not named.

    Ends of chains are peeled from both sides. A colour is the largest task that reaches one; the tasks of a colour that reach its
    namesake are one strongly connected component, and no component has two colours. So edges between colours and the components
    found go, and the rest is coloured again. A task that needs itself is on a cycle; rows with a null count as no dependency. A
    peeling or colouring takes a round per step of the longest chain it follows, for all jobs at once.
    """
    left = materialise(deps.select("job_id", "seq", "needs").dropna().distinct())
    found = [left.filter("seq = needs").select("job_id", "seq")]
    left = _core(materialise(left.filter("seq <> needs")))
    while not left.isEmpty():
        colours = _coloured(left)
        of_need = colours.select("job_id", F.col("seq").alias("needs"), F.col("colour").alias("_colour"))
        inner = materialise(left.join(colours, ["job_id", "seq"]).join(of_need, ["job_id", "needs"]).filter("colour = _colour").select("job_id", "seq", "needs"))
        fresh = component = materialise(colours.filter("seq = colour").select("job_id", "seq"))
        while not fresh.isEmpty():
            onward = fresh.withColumnRenamed("seq", "needs").join(inner, ["job_id", "needs"]).select("job_id", "seq").distinct()
            fresh = materialise(onward.join(component, ["job_id", "seq"], "left_anti"))
            component = component.unionByName(fresh)
        # A namesake that no other task of its colour leads back to is alone.
        back = inner.join(component, ["job_id", "seq"], "left_semi").join(component.withColumnRenamed("seq", "needs"), ["job_id", "needs"], "left_semi")
        found.append(materialise(back.select("job_id", "seq").distinct()))
        rest = inner.join(component, ["job_id", "seq"], "left_anti").join(component.withColumnRenamed("seq", "needs"), ["job_id", "needs"], "left_anti")
        left = _core(materialise(rest))
    return reduce(DataFrame.unionByName, found).distinct()
