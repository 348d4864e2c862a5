"""What a change left behind: private definitions nothing names, and imports nothing reads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def references(facts: DataFrame) -> DataFrame:
    """(graph_id, path, name, in_code): names used; the dotted parts of a literal count as weak uses."""
    code = facts.filter("fact = 'ref'").select("graph_id", "path", "name", F.lit(True).alias("in_code"))
    whole = F.array("name")
    parts = F.filter(F.split(F.replace("name", F.lit(":"), F.lit(".")), r"\."), lambda p: p != "")
    strings = facts.filter("fact = 'literal'").select("graph_id", "path", F.explode(F.array_union(whole, parts)).alias("name"), F.lit(False).alias("in_code"))
    return code.unionByName(strings).distinct()


def private_definitions(facts: DataFrame) -> DataFrame:
    """Functions and classes of a module's own level (they start at column 0) whose name has one leading underscore."""
    return facts.filter(
        (F.col("fact") == "def") & F.col("kind").isin("function", "class") & (F.col("position") == 0)
        & F.startswith("name", F.lit("_")) & ~F.startswith("name", F.lit("__"))
    ).select("graph_id", "path", "name").distinct()


def orphaned_symbols(
    defs: DataFrame, refs: DataFrame, exported: DataFrame, covered: DataFrame, loose_names: DataFrame, errors: DataFrame
) -> DataFrame:
    """(graph_id, path, name) of definitions that nothing names, exports, tests or may dispatch to.

    A literal in the defining file is no use of the name. One unparseable file voids its whole graph.
    """
    # One row per name: does code anywhere use it, and do literals of more than one file hold it?
    uses = refs.groupBy("graph_id", "name").agg(
        F.bool_or("in_code").alias("in_code"), F.min("path").alias("first_path"), F.max("path").alias("last_path")
    )
    key = ["graph_id", "path", "name"]
    unused = defs.join(uses, ["graph_id", "name"], "left").filter(
        F.col("in_code").isNull()
        | (~F.col("in_code") & (F.col("first_path") == F.col("path")) & (F.col("last_path") == F.col("path")))
    )
    return (
        unused.select(*key)
        .join(errors.select("graph_id").distinct(), "graph_id", "left_anti")
        .join(exported.select(*key), key, "left_anti")
        .join(covered.select(*key), key, "left_anti")
        .join(loose_names.select("graph_id", "name").distinct(), ["graph_id", "name"], "left_anti")
    )


def unused_imports(bindings: DataFrame, refs: DataFrame, exported: DataFrame, unknowable: DataFrame) -> DataFrame:
    """(graph_id, path, name) bound by an import, never read and not re-exported.

    ``unknowable`` lists files with a star import or a parse error: they yield nothing.
    """
    key = ["graph_id", "path", "name"]
    return (
        bindings.select(*key).distinct().filter(~F.startswith("name", F.lit("_")))
        .join(unknowable.select("graph_id", "path").distinct(), ["graph_id", "path"], "left_anti")
        .join(refs.select(*key).distinct(), key, "left_anti")
        .join(exported.select(*key), key, "left_anti")
    )


def cleanup_tasks(facts: DataFrame, touched: DataFrame, covered: DataFrame, loose_names: DataFrame) -> dict[str, DataFrame]:
    """Both passes over the facts of an integrated tree, confined to touched files."""
    refs = references(facts)
    exported = facts.filter("fact = 'dunder_all'").select("graph_id", "path", F.explode("names").alias("name"))
    errors = facts.filter("fact = 'parse_error'").select("graph_id", "path")
    inside = touched.select("graph_id", "path").distinct()
    imports = facts.filter("fact IN ('import', 'future_import')")
    stars = imports.filter(F.col("symbol") == "*").select("graph_id", "path")
    bound = imports.select("graph_id", "path", "name").join(inside, ["graph_id", "path"], "left_semi")
    defs = private_definitions(facts).join(inside, ["graph_id", "path"], "left_semi")
    return {
        "orphans": orphaned_symbols(defs, refs, exported, covered, loose_names, errors),
        "unused_imports": unused_imports(bound, refs, exported, stars.unionByName(errors)),
    }


def coverage_gaps(files: DataFrame, symbols: DataFrame, test_edges: DataFrame) -> DataFrame:
    """(graph_id, path, tests, status): uncovered, generated only, or covered."""
    home = symbols.select("graph_id", "path", F.col("fqn").alias("symbol")).distinct()
    generated = F.col("source") == "characterisation"
    edges = home.join(test_edges, ["graph_id", "symbol"]).groupBy("graph_id", "path").agg(
        F.countDistinct("nodeid").alias("tests"), F.bool_and(generated).alias("only_generated")
    )
    status = F.when(F.col("tests").isNull(), "uncovered").when(F.col("only_generated"), "generated only").otherwise("covered")
    return files.select("graph_id", "path").distinct().join(edges, ["graph_id", "path"], "left").select(
        "graph_id", "path", F.coalesce("tests", F.lit(0)).alias("tests"), status.alias("status")
    )


def needs_safety_net(targets: DataFrame, test_edges: DataFrame, threshold: int = 1) -> DataFrame:
    """Targets with fewer distinct covering tests than the threshold."""
    n = test_edges.groupBy("graph_id", "symbol").agg(F.countDistinct("nodeid").alias("tests"))
    return targets.select("graph_id", "symbol").join(n, ["graph_id", "symbol"], "left").fillna(0, ["tests"]).filter(
        F.col("tests") < threshold
    )


def moved_total(cleanups: DataFrame, keys: list[str]) -> DataFrame:
    """Orphans found in all, and removed by verified cleanups only."""
    return cleanups.groupBy(*keys).agg(
        F.sum("orphans").alias("orphans_found"),
        F.sum(F.when(F.col("state") == "verified", F.col("orphans")).otherwise(0)).alias("removed"),
    )
