"""Edge tables: building test edges, and set-valued lookups over calls, imports and tests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from impactlens.operators.resolve import (
    attach_caller, local_bindings, module_aliases, name_index, resolve_calls, resolve_imports, unique_by_name,
)
from impactlens.session import materialise

LINES_PER_BUCKET = 64


def build_edges(files: DataFrame, symbols: DataFrame, imports: DataFrame, calls: DataFrame) -> dict[str, DataFrame]:
    """Second pass of a graph build: import, call and import-derived test edges."""
    resolved = materialise(resolve_imports(imports, files, symbols))
    index, unique = materialise(name_index(symbols)), unique_by_name(symbols, files)
    bindings = materialise(local_bindings(symbols, resolved))
    calls = resolve_calls(calls, bindings, module_aliases(imports, files), index, unique)
    return {
        "import_edge": resolved.select(
            "graph_id", "path", "symbol_name", "local_name", "source_module", "resolved_symbol", "resolved_path", "line"
        ),
        "call_edge": attach_caller(calls, index).select(
            "graph_id", "caller", "callee", "callee_name", "path", "line", "confidence", "dynamic"
        ),
        "test_edge": import_test_edges(bindings, files, symbols),
    }


def import_test_edges(bindings: DataFrame, files: DataFrame, symbols: DataFrame) -> DataFrame:
    """A test file reaches every symbol it binds that is defined in another file."""
    home = symbols.select("graph_id", "fqn", F.col("path").alias("home")).distinct()
    tests = files.filter("is_test").select("graph_id", "path")
    return (
        bindings.join(tests, ["graph_id", "path"], "left_semi")
        .join(home, ["graph_id", "fqn"])
        .filter(F.col("home") != F.col("path"))
        .select(
            "graph_id", F.col("path").alias("test_path"), F.col("fqn").alias("symbol"),
            F.col("path").alias("nodeid"), F.lit("import").alias("source"),
        )
    )


def range_hits(
    lines: DataFrame, ranges: DataFrame, keys: list[str], start: str, end: str, line: str = "line",
    width: int = LINES_PER_BUCKET,
) -> DataFrame:
    """Lines joined to the ranges that hold them, by buckets of ``width`` lines.

    One path with very many lines is spread over its buckets.
    """
    first, last = F.floor(F.col(start) / width), F.floor(F.col(end) / width)
    spread = ranges.filter(F.col(start) <= F.col(end)).withColumn("_bucket", F.explode(F.sequence(first, last)))
    placed = lines.withColumn("_bucket", F.floor(F.col(line) / width))
    return placed.join(spread, [*keys, "_bucket"]).filter(F.col(line).between(F.col(start), F.col(end))).drop("_bucket")


def coverage_test_edges(contexts: DataFrame, symbols: DataFrame, files: DataFrame) -> DataFrame:
    """A test that executed a line inside a symbol covers the symbol."""
    tests = files.filter("is_test").select("graph_id", F.col("path").alias("test_path"))
    known = contexts.select("graph_id", "path", "line", "nodeid", "test_path").distinct().join(
        tests, ["graph_id", "test_path"], "left_semi"
    )
    ranges = symbols.select("graph_id", "path", F.col("fqn").alias("symbol"), "line_start", "line_end")
    hits = range_hits(known, ranges, ["graph_id", "path"], "line_start", "line_end")
    return hits.select("graph_id", "test_path", "symbol", "nodeid", F.lit("coverage").alias("source")).distinct()


def generated_test_edges(sources: DataFrame, symbol: str = "symbol") -> DataFrame:
    """Test functions of a generated source, as edges of their own source kind."""
    names = F.regexp_extract_all("text", F.lit(r"(?m)^def (test_\w+)"), F.lit(1))
    return sources.select("graph_id", "path", symbol, F.explode(F.array_distinct(names)).alias("_t")).select(
        "graph_id", F.col("path").alias("test_path"), F.col(symbol).alias("symbol"),
        F.concat_ws("::", "path", "_t").alias("nodeid"), F.lit("characterisation").alias("source"),
    )


def overlay(baseline: DataFrame, patched: DataFrame, keys: list[str]) -> DataFrame:
    """Patched text wins per path, every other file stays; ``replaced`` says which."""
    after = patched.select(*keys, F.col("text").alias("_after"), F.lit(True).alias("replaced"))
    return baseline.select(*keys, "text").join(after, keys, "full").select(
        *keys, F.when(F.col("replaced"), F.col("_after")).otherwise(F.col("text")).alias("text"),
        F.coalesce("replaced", F.lit(False)).alias("replaced"),
    )


def missing_patches(touched: DataFrame, patched: DataFrame, keys: list[str]) -> DataFrame:
    return touched.select(*keys).distinct().join(patched.select(*keys), keys, "left_anti")


# ------------------------------------------------------------------ lookups --


def callers_of(edges: DataFrame, frontier: DataFrame) -> DataFrame:
    """Edges whose callee is in a set of (graph_id, symbol)."""
    return edges.join(frontier.select("graph_id", F.col("symbol").alias("callee")).distinct(), ["graph_id", "callee"], "left_semi")


def unresolved_matching(edges: DataFrame, names: DataFrame) -> DataFrame:
    """Edges without a callee whose bare name is in a set of (graph_id, callee_name)."""
    return edges.filter(F.col("callee").isNull()).join(
        names.select("graph_id", "callee_name").distinct(), ["graph_id", "callee_name"], "left_semi"
    )


def importers_of(imports: DataFrame, symbols: DataFrame) -> DataFrame:
    wanted = symbols.select("graph_id", F.col("symbol").alias("resolved_symbol")).distinct()
    return imports.join(wanted, ["graph_id", "resolved_symbol"], "left_semi").select("graph_id", "path").distinct()


def importers_of_files(imports: DataFrame, files: DataFrame) -> DataFrame:
    wanted = files.select("graph_id", F.col("path").alias("resolved_path")).distinct()
    return imports.join(wanted, ["graph_id", "resolved_path"], "left_semi").select("graph_id", "path").distinct()


def calls_in(edges: DataFrame, paths: DataFrame, kind: Column) -> DataFrame:
    """Edges of one kind (dynamic, or static) inside a set of (graph_id, path)."""
    return edges.filter(kind).join(paths.select("graph_id", "path").distinct(), ["graph_id", "path"], "left_semi")


def in_files(rows: DataFrame, paths: DataFrame) -> DataFrame:
    """Symbols, flags or anything else with a path, for a set of files."""
    return rows.join(paths.select("graph_id", "path").distinct(), ["graph_id", "path"], "left_semi")


def tests_covering(test_edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """Distinct (symbol, source, nodeid): measured and guessed coverage are kept apart."""
    wanted = symbols.select("graph_id", "symbol").distinct()
    return test_edges.join(wanted, ["graph_id", "symbol"], "left_semi").select(
        "graph_id", "symbol", "source", "test_path", "nodeid"
    ).distinct()


def tests_by_source(test_edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """(graph_id, symbol, by_source) of every symbol asked for: a map from each source to its distinct tests in order.

    A symbol without tests has an empty map.
    """
    key = ["graph_id", "symbol"]
    tests = F.sort_array(F.collect_set("nodeid")).alias("tests")
    kept = tests_covering(test_edges, symbols).groupBy(*key, "source").agg(tests)
    maps = kept.groupBy(*key).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("source", "tests")))).alias("_m"))
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<array<string>>"))
    return symbols.select(*key).distinct().join(maps, key, "left").select(*key, F.coalesce("_m", none).alias("by_source"))


def select_tests(
    changed: DataFrame, symbols: DataFrame, test_edges: DataFrame, include_generated: bool = False
) -> DataFrame:
    """(graph_id, path, nodeid, source, full_suite): tests for each changed file.

    Coverage edges if the file has any, else import edges, else one row asking for the full suite.
    """
    order = ["coverage", "import"] + (["characterisation"] if include_generated else [])
    rank = F.array_position(F.array(*[F.lit(s) for s in order]), F.col("source"))
    home = symbols.select("graph_id", "path", F.col("fqn").alias("symbol")).distinct()
    files = changed.select("graph_id", "path").distinct()
    edges = (
        files.join(home, ["graph_id", "path"])
        .join(test_edges.filter(F.col("source").isin(*order)).select("graph_id", "symbol", "nodeid", "source"), ["graph_id", "symbol"])
        .select("graph_id", "path", "nodeid", "source").distinct()
        .withColumn("rank", F.least(rank, F.lit(2)) if include_generated else rank)
    )
    best = edges.groupBy("graph_id", "path").agg(F.min("rank").alias("rank"))
    chosen = edges.join(best, ["graph_id", "path", "rank"]).drop("rank")
    return files.join(chosen, ["graph_id", "path"], "left").withColumn("full_suite", F.col("nodeid").isNull())


def consumers(symbols: DataFrame, edges: DataFrame, files: DataFrame) -> DataFrame:
    """(graph_id, path, name, consumer): non-test files that call each function."""
    functions = symbols.select("graph_id", "path", "name", F.col("fqn").alias("callee"))
    outside = files.filter(~F.col("is_test")).select("graph_id", F.col("path").alias("consumer"))
    sites = edges.filter(F.col("callee").isNotNull()).select("graph_id", "callee", F.col("path").alias("consumer")).distinct()
    return (
        sites.join(outside, ["graph_id", "consumer"], "left_semi")
        .join(functions, ["graph_id", "callee"])
        .select("graph_id", "path", "name", "consumer").distinct()
    )


def graph_stats(tables: dict[str, DataFrame]) -> DataFrame:
    """Row counts per graph of every table, heuristic edges and files that did not parse apart, in one row per graph that any table has."""
    n = F.count(F.lit(1))
    parts = [
        tables["file"].groupBy("graph_id").agg(n.alias("files")),
        tables["symbol"].groupBy("graph_id").agg(n.alias("symbols")),
        tables["import_edge"].groupBy("graph_id").agg(n.alias("import_edges")),
        tables["call_edge"].groupBy("graph_id").agg(
            n.alias("call_edges"), F.count_if(F.col("confidence") == "heuristic").alias("heuristic_edges")
        ),
        tables["test_edge"].groupBy("graph_id").agg(n.alias("test_edges")),
    ]
    if "parse_error" in tables:
        parts.append(tables["parse_error"].groupBy("graph_id").agg(F.countDistinct("path").alias("parse_errors")))
    # Counts side by side, then one sum per graph: no table has to know every graph.
    total = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return total.groupBy("graph_id").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in total.columns if c != "graph_id"])


def third_party_imports(imports: DataFrame, files: DataFrame, package: Column, inside: DataFrame | None = None) -> DataFrame:
    """(graph_id, package, lang, files): packages imported but not provided, by how many files."""
    open_imports = imports.filter(F.col("resolved_path").isNull() & F.col("resolved_symbol").isNull())
    if inside is not None:
        open_imports = in_files(open_imports, inside)
    own = files.select("graph_id", F.explode(F.split("path", "/")).alias("_part")).select(
        "graph_id", F.split_part("_part", F.lit("."), F.lit(1)).alias("package")
    ).distinct()
    named = open_imports.join(files.select("graph_id", "path", "lang"), ["graph_id", "path"]).withColumn("package", package)
    return (
        named.filter(F.col("package").isNotNull())
        .join(own, ["graph_id", "package"], "left_anti")
        .groupBy("graph_id", "package", "lang")
        .agg(F.countDistinct("path").alias("files"))
    )


def script_versions(manifests: DataFrame, packages: DataFrame) -> DataFrame:
    """Adds version to packages (graph_id, package): the first number of its entry in a script manifest (graph_id, text), by section order."""
    # The sections of a manifest, in the order in which they answer.
    sections = ("dependencies", "devDependencies", "peerDependencies")
    body = F.from_json("text", ", ".join(f"{s} MAP<STRING, STRING>" for s in sections))
    entries = manifests.select("graph_id", body.alias("_m")).select("graph_id", F.posexplode(F.array(*[F.col(f"_m.{s}") for s in sections])).alias("section", "_e"))
    named = entries.select("graph_id", "section", F.explode("_e").alias("package", "spec"))
    first = named.groupBy("graph_id", "package").agg(F.min_by("spec", "section").alias("spec"))
    version = F.nullif(F.regexp_extract("spec", r"\d[\w.]*", 0), F.lit(""))
    return packages.join(first, ["graph_id", "package"], "left").withColumn("version", version).drop("spec")


def declared_versions(manifest_lines: DataFrame, packages: DataFrame) -> DataFrame:
    """First pinned or floored version of each package in manifest order (path, line_no)."""
    def canonical(c: Column) -> Column:
        return F.lower(F.regexp_replace(c, "[-_.]", "-"))

    # Fixed value: a requirement with a pinned or lowest version.
    pattern = r"""^\s*["']?([A-Za-z0-9][A-Za-z0-9._-]*)\s*(?:\[[^\]]*\])?\s*(?:==|~=|>=)\s*(\d[\w.]*)"""
    found = manifest_lines.select(
        "graph_id", "path", "line_no", canonical(F.regexp_extract("text", pattern, 1)).alias("key"),
        F.regexp_extract("text", pattern, 2).alias("version"),
    ).filter(F.col("version") != "")
    # Requirement lists come before the project file, as their names sort.
    last = F.endswith("path", F.lit("pyproject.toml"))
    first = found.groupBy("graph_id", "key").agg(F.min_by("version", F.struct(last, "path", "line_no")).alias("version"))
    return packages.withColumn("key", canonical(F.col("package"))).join(first, ["graph_id", "key"], "left").drop("key")
