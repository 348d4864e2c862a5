import random

import pytest
from pyspark.sql import functions as F

from impactlens.operators import cleanup, edges, interface, linediff, radius, trees
from impactlens.operators import findings as rules
from impactlens.plans.build import build_graph
from impactlens.plans.skew import hot_keys, spread_join
from impactlens.sources import tree
from tests import corpus


@pytest.fixture(scope="module")
def graph(spark, tmp_path_factory):
    root = corpus.write(tmp_path_factory.mktemp("tree"))
    return build_graph(tree.scan_tree(spark, root, "g", max_files=100))


def test_scan_keeps_package_files_and_skips_folders(spark, graph, tmp_path, rows):
    paths = [r[0] for r in rows(graph["file"], "path")]
    assert "src/store/__init__.py" in paths and "node_modules/skip.py" not in paths and "README.md" not in paths
    assert rows(graph["file"].filter("is_test"), "path") == [("tests/test_box.py",)]
    flagged = tree.scan_tree(spark, corpus.write(tmp_path), "g", max_files=2)
    assert {r.over_limit for r in flagged.collect()} == {True} and flagged.count() == len(paths)


def test_symbols(graph, rows):
    got = {r.fqn: r for r in graph["symbol"].collect()}
    assert got["src.store.box.Box.open"].kind == "method" and got["src.store.box.Box.open"].parent == "Box"
    assert got["src.store.box.LIMIT"].kind == "const" and not got["src.store.box.LIMIT"].exported
    assert got["src.store.box.pack"].exported and got["src.store.box.pack"].signature == "def pack(item, size=LIMIT)"
    assert (got["src.store.box.Box"].line_start, got["src.store.box.Box"].line_end) == (5, 7)
    assert "src.broken.oops" not in got
    assert rows(graph["facts"].filter("fact = 'parse_error'"), "path") == [("src/broken.py",)]


def test_imports_resolve_to_symbols_and_files(graph, rows):
    got = {(r.path, r.local_name): (r.resolved_symbol, r.resolved_path) for r in graph["import_edge"].collect()}
    assert got["src/app/orders.py", "pack"] == ("src.store.box.pack", "src/store/box.py")
    assert got["src/app/orders.py", "crate"] == (None, "src/store/box.py")
    assert got["src/app/alias.py", "wrap"] == ("src.store.box.pack", "src/store/box.py")
    assert got["src/app/orders.py", "osp"] == (None, None)


def test_calls_carry_their_confidence(graph):
    got = {(r.path, r.line, r.callee_name): (r.caller, r.callee, r.confidence, r.dynamic) for r in graph["call_edge"].collect()}
    pack = "src.store.box.pack"
    assert got["src/app/orders.py", 7, "pack"] == ("src.app.orders.order", pack, "static", False)
    assert got["src/app/orders.py", 11, "pack"] == ("src.app.orders.reorder", pack, "static", False)
    assert got["src/app/alias.py", 5, "wrap"][1:3] == (pack, "static")
    assert got["src/app/orders.py", 15, "open"][1:3] == ("src.store.box.Box.open", "heuristic")
    assert got["src/lookup.py", 7, "<dynamic>"] == ("src.lookup.call", None, "heuristic", True)
    assert got["src/lookup.py", 8, "handler"][3] is True
    # The literal names its symbol, so the guess points somewhere.
    assert got["src/lookup.py", 12, "pack"][1:] == (pack, "heuristic", True)


def _radius(graph, **options):
    target = radius.find_target(graph["symbol"], "src.store.box.pack")
    return radius.blast_radius(
        target, graph["symbol"], graph["call_edge"], graph["import_edge"], graph["file"], graph["test_edge"], **options
    )


def test_radius(graph, rows):
    got = _radius(graph)
    assert rows(got.files, "path") == [("src/app/alias.py",), ("src/app/orders.py",), ("src/lookup.py",), ("src/store/box.py",)]
    assert rows(got.tests, "nodeid") == [("tests/test_box.py",)]
    status = got.status.first()
    assert (status.files, status.test_files, status.status) == (4, 1, "ok")
    listed = {(r.file, r.line, r.name) for r in got.unresolved.collect()}
    assert {("src/lookup.py", 7, "<dynamic>"), ("src/lookup.py", 8, "handler"), ("src/lookup.py", 12, "pack")} <= listed


def test_recall_is_complete(spark, graph, rows):
    got = _radius(graph)
    sites = got.call_sites.select("graph_id", "file", "line", "confidence").unionByName(
        got.unresolved.select("graph_id", "file", "line", F.lit("heuristic").alias("confidence"))
    )
    truth = spark.createDataFrame([("g", *t) for t in corpus.TRUTH], "graph_id STRING, file STRING, line INT, static BOOLEAN")
    rates, missed = radius.recall(sites, truth)
    assert rates.first()[3:] == (1.0, 1.0, 1.0) and missed.isEmpty()
    none, lost = radius.recall(sites.limit(0), truth)
    assert none.first().recall == 0.0 and lost.count() == 5


def test_cap_is_reported_never_cut(graph):
    assert _radius(graph, cap=2).status.first().status == "RADIUS_TOO_LARGE"
    assert _radius(graph, cap=2).files.count() == 4
    with pytest.raises(Exception, match="RADIUS_TOO_LARGE"):
        _radius(graph, cap=2, on_cap="raise").status.collect()


def test_importers_seed_takes_one_level(graph, rows):
    got = _radius(graph, seed="importers")
    assert rows(got.files, "path") == [("src/app/alias.py",), ("src/app/orders.py",), ("src/lookup.py",), ("src/store/box.py",)]
    assert got.call_sites.isEmpty()


def test_unknown_target(graph):
    with pytest.raises(ValueError, match="TARGET_NOT_FOUND"):
        radius.require_target(radius.find_target(graph["symbol"], "no_such"), "no_such")


def test_wildcards_in_names_are_literal(graph):
    assert radius.find_symbols(graph["symbol"], "p_ck").isEmpty() and radius.find_symbols(graph["symbol"], "%").isEmpty()


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("hot_rows", [1, 10**9])
def test_reach_equals_plain_search(spark, seed, hot_rows):
    rng = random.Random(seed)
    pairs = [(f"n{rng.randrange(40)}", f"n{rng.choice([0, rng.randrange(40)])}") for _ in range(120)]
    targets = ["n0", "n7"]
    expected = {}
    for target in targets:
        level, seen = {target}, {target: 0}
        for depth in range(1, 4):
            level = {a for a, b in pairs if b in level} - seen.keys()
            seen |= dict.fromkeys(level, depth)
        expected |= {(target, node): d for node, d in seen.items()}
    edges_df = spark.createDataFrame([("g", a, b) for a, b in pairs], "graph_id STRING, caller STRING, callee STRING")
    got = radius.reach(spark.createDataFrame([("g", t) for t in targets], "graph_id STRING, target STRING"), edges_df, 3, hot_rows)
    assert {(r.target, r.node): r.depth for r in got.collect()} == expected


def test_salted_join_finds_every_match_once(spark, rows):
    right = spark.createDataFrame([(i % 3 if i % 2 else 0, i) for i in range(200)], "k INT, v INT")
    left = spark.createDataFrame([(0, "a"), (0, "b"), (1, "c"), (9, "d")], "k INT, w STRING")
    hot = hot_keys(right, ["k"], 50)
    assert rows(hot) == [(0, 3)]
    assert rows(spread_join(left, right, ["k"], hot, F.col("v")), "k", "w", "v") == rows(left.join(right, "k"), "k", "w", "v")
    assert hot_keys(right, ["k"], 500).isEmpty()


def test_coverage_edges(spark, graph, rows):
    contexts = spark.createDataFrame(
        [("g", "src/store/box.py", 7, "tests/test_box.py::test_pack", "tests/test_box.py"), ("g", "src/store/box.py", 11, "elsewhere.py::x", "elsewhere.py")],
        "graph_id STRING, path STRING, line INT, nodeid STRING, test_path STRING",
    )
    got = rows(edges.coverage_test_edges(contexts, graph["symbol"], graph["file"]), "symbol", "nodeid", "source")
    assert got == [("src.store.box.Box", "tests/test_box.py::test_pack", "coverage"), ("src.store.box.Box.open", "tests/test_box.py::test_pack", "coverage")]


def test_import_edges_of_tests(graph, rows):
    assert rows(graph["test_edge"], "symbol", "nodeid") == [
        ("src.app.orders.order", "tests/test_box.py"), ("src.store.box.pack", "tests/test_box.py"),
    ]


def test_selected_tests_fall_back(spark, graph, rows):
    changed = spark.createDataFrame([("g", "src/store/box.py"), ("g", "src/lookup.py")], "graph_id STRING, path STRING")
    covered = graph["test_edge"].unionByName(spark.createDataFrame(
        [("g", "tests/test_box.py", "src.store.box.pack", "t::p", "coverage"), ("g", "t2.py", "src.lookup.call", "t::g", "characterisation")], graph["test_edge"].schema))
    got = rows(edges.select_tests(changed, graph["symbol"], covered), "path", "nodeid", "full_suite")
    assert got == [("src/lookup.py", None, True), ("src/store/box.py", "t::p", False)]
    more = rows(edges.select_tests(changed, graph["symbol"], covered, include_generated=True), "path", "nodeid")
    assert ("src/lookup.py", "t::g") in more


def test_generated_edges_and_versions(spark, rows):
    source = spark.createDataFrame([("g", "tests/x.py", "def test_a():\n  pass\ndef helper(): pass\ndef test_b(): pass", "m.f")], "graph_id STRING, path STRING, text STRING, symbol STRING")
    assert rows(edges.generated_test_edges(source), "nodeid", "source") == [("tests/x.py::test_a", "characterisation"), ("tests/x.py::test_b", "characterisation")]
    lines = spark.createDataFrame(
        [("g", "pyproject.toml", 1, '"my-lib>=9"'), ("g", "requirements.txt", 2, "my_lib[extra] == 1.2"), ("g", "requirements.txt", 3, "other>1")],
        "graph_id STRING, path STRING, line_no INT, text STRING",
    )
    wanted = spark.createDataFrame([("g", "my.lib"), ("g", "other")], "graph_id STRING, package STRING")
    assert rows(edges.declared_versions(lines, wanted), "package", "version") == [("my.lib", "1.2"), ("other", None)]


def test_overlay(spark, rows):
    base = spark.createDataFrame([("a", "1"), ("b", "2")], "path STRING, text STRING")
    new = spark.createDataFrame([("b", "3"), ("c", None)], "path STRING, text STRING")
    assert rows(edges.overlay(base, new, ["path"])) == [("a", "1", False), ("b", "3", True), ("c", None, True)]
    assert rows(edges.missing_patches(base, new, ["path"])) == [("a",)]


def test_cleanup(spark, graph, rows):
    touched = graph["file"].select("graph_id", "path")
    nothing = spark.createDataFrame([], "graph_id STRING, path STRING, name STRING")
    clean = graph["facts"].filter("path <> 'src/broken.py'")
    got = cleanup.cleanup_tasks(clean, touched, nothing, nothing)
    assert rows(got["orphans"], "path", "name") == [("src/store/box.py", "_unused")]
    assert ("src/app/orders.py", "osp") in rows(got["unused_imports"], "path", "name")
    assert ("src/app/orders.py", "json") not in rows(got["unused_imports"], "path", "name")
    assert cleanup.cleanup_tasks(graph["facts"], touched, nothing, nothing)["orphans"].isEmpty()


def test_stale_references(spark, graph, rows):
    removed = spark.createDataFrame([("g", "src.store.box", "pack")], "graph_id STRING, module STRING, name STRING")
    got = rows(interface.stale_references(graph["facts"], removed), "path", "line", "strength")
    assert ("src/lookup.py", 12, "strong") in got and ("src/lookup.py", 3, "medium") in got


def test_stale_references_of_two_names_on_one_line(spark, rows):
    facts = spark.createDataFrame(
        [("g", "src/a.py", 1, 1, "import", "x", "plain", "lib", None, None), ("g", "src/a.py", 2, 2, "import", "lib", "plain", "lib", None, None),
         ("g", "src/a.py", 3, 3, "import", "y", "renamed", "lib", None, None), ("g", "src/a.py", 4, 4, "lookup", "f", None, None, None, "y"),
         ("g", "src/a.py", 4, 5, "lookup", "f", None, None, None, "lib")],
        "graph_id STRING, path STRING, line INT, ord INT, fact STRING, name STRING, kind STRING, module STRING, symbol STRING, receiver STRING",
    )
    removed = spark.createDataFrame([("g", "lib", "f")], "graph_id STRING, module STRING, name STRING")
    assert rows(interface.stale_references(facts, removed), "path", "line", "strength") == [("src/a.py", 4, "strong")]


def test_graph_stats_and_replace(spark, graph, tmp_path):
    stats = edges.graph_stats(graph).first()
    assert (stats.files, stats.test_edges) == (graph["file"].count(), 2)
    for _ in range(2):
        tree.replace_graph({"symbol": graph["symbol"]}, str(tmp_path))
    assert spark.read.parquet(f"{tmp_path}/symbol").count() == graph["symbol"].count()
    wanted = spark.createDataFrame([("g",), ("h",)], "graph_id STRING")
    assert [r.graph_id for r in tree.graphs_to_build(wanted, graph["symbol"]).collect()] == ["h"]


def test_tree_levels(spark, graph, rows):
    assert rows(trees.tree_level(graph["file"], "src"), "name", "kind", "files") == [
        ("__init__.py", "file", 1), ("app", "dir", 2), ("broken.py", "file", 1), ("lookup.py", "file", 1), ("store", "dir", 2)]
    short = trees.tree_level(graph["file"], "src", limit=2).collect()
    assert len(short) == 2 and short[0].total == 5 and short[0].truncated
    assert trees.tree_level(graph["file"], "nowhere").first().kind == "missing"
    assert rows(trees.tree_level(graph["file"], "src/lookup.py"), "name", "kind") == [("lookup.py", "file")]


def test_findings_of_files(spark, rows):
    files = spark.createDataFrame([("g", "a.py", "x = 1\npassword = 'Tr0ub4dor&3x'\n"), ("g", "b.txt", "nothing")], "graph_id STRING, path STRING, text STRING")
    assert rows(rules.scan_sources(files, ["graph_id"]), "path", "line", "rule") == [("a.py", 2, "secret.hardcoded_credential")]


def _facts(spark, **sources):
    from impactlens.sources.facts import extract_code_facts

    files = spark.createDataFrame([("g", "m.py", text) for text in sources.values()], "graph_id STRING, path STRING, text STRING")
    return extract_code_facts(files).filter("fact = 'param'").select("graph_id", "symbol", "kind", "name", "position", "required", "signature")


BREAKS = [
    ("def f(a, b=1): pass", "def f(a, b=1): pass", None), ("def f(a): pass", "def f(a, b=1): pass", False), ("def f(a): pass", "def f(a, b): pass", True),
    ("def f(a, b): pass", "def f(b, a): pass", True), ("def f(a, b=1): pass", "def f(a, *, b=1): pass", True), ("def f(a, b): pass", "def f(a, **k): pass", True),
    ("def f(a, b=1): pass", "def f(a, *b, **k): pass", False), ("def f(a): pass", "def f(a, *, c): pass", True), ("def f(a): pass", "def f(x): pass", True),
]


@pytest.mark.parametrize(("before", "after", "breaking"), BREAKS)
def test_signature_changes(spark, before, after, breaking):
    got = interface.signature_changes(_facts(spark, a=before), _facts(spark, b=after), ["graph_id", "symbol"]).first()
    assert got.changed is (breaking is not None) and got.breaking is bool(breaking)


CALLS = [
    ((1, [], False, False), None), ((3, [], False, False), "3 arguments by position, 2 taken"),
    ((1, ["a"], False, False), "'a' bound twice, by position and by name"), ((1, ["z"], False, False), "no parameter is named 'z'"),
    ((0, ["b"], False, False), "'a' is not given"), ((0, [], True, False), None), ((1, [], False, True), "calls a name that was removed"),
]


def test_call_compat(spark):
    params = _facts(spark, a="def f(a, b=1, *, c=2): pass")
    calls = spark.createDataFrame([("g", "f", i, *c) for i, (c, _) in enumerate(CALLS)], "graph_id STRING, symbol STRING, call_id INT, n_pos INT, keywords ARRAY<STRING>, starred BOOLEAN, removed BOOLEAN")
    got = {r.call_id: r.reason for r in interface.call_compat(calls, params, ["graph_id", "symbol"]).collect()}
    assert got == {i: why for i, (_, why) in enumerate(CALLS)}
    kw = _facts(spark, a="def f(*, c): pass")
    assert interface.call_compat(calls.filter("call_id = 5").withColumn("starred", F.lit(False)), kw, ["graph_id", "symbol"]).first().reason == "keyword-only 'c' is not given"


def test_tests_of_a_symbol_are_kept_apart_by_source(spark):
    met = [("g", "t1", "p", "t1::b", "coverage"), ("g", "t1", "p", "t1::a", "coverage"), ("g", "t2", "p", "t1::a", "coverage"), ("g", "t1", "p", "t1::a", "import"), ("g", "t1", "q", "t1::a", "import"), ("h", "t1", "p", "t1::z", "import")]
    test_edges = spark.createDataFrame(met, "graph_id STRING, test_path STRING, symbol STRING, nodeid STRING, source STRING")
    asked = spark.createDataFrame([("g", "p"), ("g", "p"), ("g", "none"), ("h", "q")], "graph_id STRING, symbol STRING")
    got = {(r.graph_id, r.symbol): r.by_source for r in edges.tests_by_source(test_edges, asked).collect()}
    assert got == {("g", "p"): {"coverage": ["t1::a", "t1::b"], "import": ["t1::a"]}, ("g", "none"): {}, ("h", "q"): {}}


def test_changed_lines(spark, rows):
    before = "def f(x):\n    if x > 10:\n        return x\n    return 0"
    after = before.replace("return x", "return x + 1")
    pairs = spark.createDataFrame([("p", before, after), ("q", "a\nb\nc", "c\na\nb"), ("r", "same", "same")], "path STRING, before STRING, after STRING")
    assert rows(linediff.changed_lines(pairs, ["path"])) == [("p", "after", 3), ("p", "before", 3), ("q", "after", 1), ("q", "before", 3)]
    from impactlens.functions.text import lines_of

    def side(c):
        return lines_of(pairs.select("path", F.col(c).alias("text")))

    # Moves count as unchanged here.
    assert rows(linediff.line_delta(side("before"), side("after"), ["path"])) == [("p", "after", 3), ("p", "before", 3)]
