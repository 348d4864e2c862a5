"""Reachability, lookups, trees and dependencies on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from impactlens.functions.text import is_test_path, join_name, module_name, request_key
from impactlens.operators import dependencies as dep
from impactlens.operators import edges as ed
from impactlens.operators import radius as rad
from impactlens.operators import resolve as res
from impactlens.operators import trees
from impactlens.plans import bindings as b
from impactlens.plans.registry import query
from impactlens.session import materialise

TARGET = "s1"

REACH = f"""
WITH RECURSIVE {b.CALL_EDGE}, {b.SYMBOL}, reach(node, depth) AS (
  SELECT fqn, 0 FROM symbol WHERE fqn = '{TARGET}'
  UNION SELECT e.caller, r.depth + 1 FROM reach r JOIN call_edge e ON e.callee = r.node WHERE r.depth < 3
), level AS (SELECT node, min(depth) AS depth FROM reach GROUP BY node)"""


def _targets(spark, d):
    found = rad.find_target(b.symbol(spark, d), TARGET)
    return found.select("graph_id", F.col("fqn").alias("target"))


@query(f"""{REACH}, entry AS (
  SELECT e.caller AS node, l.depth + 1 AS depth, count(*) AS sites, bool_or(e.confidence = 'static') AS proved
  FROM level l JOIN call_edge e ON e.callee = l.node GROUP BY 1, 2)
SELECT l.node, l.depth, e.sites, e.proved FROM level l LEFT JOIN entry e ON l.node = e.node AND l.depth = e.depth""")
def blast_radius(spark, d):
    edges = materialise(b.call_edge(spark, d))
    reached = rad.reach(rad.require_target(_targets(spark, d), TARGET), edges)
    return reached.select("node", "depth", "sites", "proved")


@query(f"""WITH RECURSIVE {b.CALL_EDGE}, aim AS (SELECT 's' || s_suppkey AS target FROM supplier WHERE s_nationkey = 3),
reach(target, node, depth) AS (
  SELECT target, target, 0 FROM aim UNION SELECT r.target, e.caller, r.depth + 1 FROM reach r JOIN call_edge e ON e.callee = r.node WHERE r.depth < 2),
level AS (SELECT target, node, min(depth) AS depth FROM reach GROUP BY 1, 2),
entry AS (SELECT l.target, e.caller AS node, l.depth + 1 AS depth, count(*) AS sites, bool_or(e.confidence = 'static') AS proved FROM level l JOIN call_edge e ON e.callee = l.node GROUP BY 1, 2, 3)
SELECT l.target, l.node, l.depth, e.sites, e.proved FROM level l LEFT JOIN entry e ON l.target = e.target AND l.node = e.node AND l.depth = e.depth""")
def blast_radius_many(spark, d):
    aims = b.table(spark, d, "supplier").filter(F.col("s_nationkey") == 3).select(b.graph(), b.tag("s", "s_suppkey").alias("target"))
    return rad.reach(aims, materialise(b.call_edge(spark, d)), max_depth=2).drop("graph_id")


@query(f"{REACH} SELECT path, count(*) AS nodes, min(depth) AS depth FROM level JOIN symbol ON fqn = node GROUP BY path")
def radius_files(spark, d):
    reached = rad.reach(_targets(spark, d), materialise(b.call_edge(spark, d)))
    homes = b.symbol(spark, d).select("graph_id", F.col("fqn").alias("node"), "path")
    return reached.join(homes, ["graph_id", "node"]).groupBy("path").agg(
        F.count(F.lit(1)).alias("nodes"), F.min("depth").alias("depth")
    )


@query(f"""{REACH} SELECT count(DISTINCT path) AS files, CASE WHEN count(DISTINCT path) > 40 THEN 'RADIUS_TOO_LARGE' ELSE 'ok' END AS status
FROM level JOIN symbol ON fqn = node""")
def radius_cap(spark, d):
    reached = rad.reach(_targets(spark, d), materialise(b.call_edge(spark, d)))
    homes = b.symbol(spark, d).select("graph_id", F.col("fqn").alias("node"), "path")
    files = reached.join(homes, ["graph_id", "node"]).select("graph_id", "target", "path").distinct()
    return rad.within_cap(files, ["graph_id", "target"], cap=40).select("files", "status")


FULL = f"""
WITH RECURSIVE {b.SYMBOL}, {b.SITE}, {b.IMPORT_EDGE}, {b.TEST_EDGE},
home AS (SELECT fqn, path FROM symbol),
step AS (
  SELECT DISTINCT callee AS src, caller AS dst, 3 AS cost FROM site WHERE callee IS NOT NULL
  UNION ALL SELECT fqn, 'home:' || path, 1 FROM home
  UNION ALL SELECT DISTINCT 'home:' || resolved_path, 'file:' || path, 1 FROM import_edge
  UNION ALL SELECT DISTINCT resolved_symbol, 'file:' || path, 2 FROM import_edge
  UNION ALL SELECT 'file:' || path, fqn, 1 FROM home),
walk(node, d) AS (SELECT 'p1', 0 UNION SELECT s.dst, w.d + s.cost FROM walk w JOIN step s ON s.src = w.node WHERE w.d + s.cost <= 9),
first AS (SELECT node, min(d) AS d FROM walk GROUP BY node),
seen AS (SELECT node AS fqn, d // 3 AS depth FROM first WHERE node NOT LIKE 'home:%' AND node NOT LIKE 'file:%'),
hit AS (SELECT s.path, s.line, s.callee_name, s.confidence, s.callee = 'p1' AS direct FROM site s JOIN seen ON seen.fqn = s.callee WHERE seen.depth < 3),
named AS (SELECT path, line, callee_name FROM site WHERE callee IS NULL AND callee_name = (SELECT name FROM symbol WHERE fqn = 'p1')),
inside AS (SELECT path FROM symbol WHERE fqn = 'p1' UNION SELECT substr(node, 6) FROM first WHERE node LIKE 'file:%' UNION SELECT path FROM hit UNION SELECT path FROM named),
loose AS (SELECT path, line, callee_name FROM hit WHERE confidence = 'heuristic' UNION SELECT path, line, callee_name FROM named
  UNION SELECT path, line, callee_name FROM site WHERE dynamic AND path IN (SELECT path FROM inside)),
tests AS (SELECT DISTINCT nodeid, test_path FROM test_edge JOIN seen ON seen.fqn = symbol)
SELECT (SELECT count(*) FROM inside WHERE path NOT IN (SELECT 'nation/' || n_nationkey FROM nation WHERE n_regionkey = 4)) AS files, (SELECT count(DISTINCT nodeid) FROM tests) AS tests,
  (SELECT count(DISTINCT test_path) FROM tests) AS test_files, (SELECT count(*) FROM hit) AS call_sites, (SELECT count_if(direct) FROM hit) AS target_sites,
  (SELECT count(*) FROM loose) AS unresolved, (SELECT max(depth) FROM seen) AS deepest"""


@query(FULL)
def radius_full(spark, d):
    symbols, sites = materialise(b.symbol(spark, d)), materialise(b.call_site(spark, d))
    nation = b.table(spark, d, "nation").select(
        b.graph(), F.concat(F.lit("nation/"), F.col("n_nationkey").cast("string")).alias("path"), (F.col("n_regionkey") == 4).alias("is_test")
    )
    imports = materialise(b.import_edge(spark, d))
    tests = materialise(b.test_edge(spark, d))
    radius = rad.blast_radius(rad.find_target(symbols, "p1"), symbols, sites, imports, nation, tests)
    return radius.status.drop("graph_id", "target", "status")


@query(f"""WITH {b.SYMBOL}, {b.SITE}, {b.IMPORT_EDGE}, {b.TEST_EDGE}, own AS (SELECT path FROM symbol WHERE fqn = 'p1'),
inside AS (SELECT path FROM own UNION SELECT path FROM import_edge WHERE resolved_symbol = 'p1' OR resolved_path IN (SELECT path FROM own)),
loose AS (SELECT DISTINCT path, line, callee_name FROM site WHERE dynamic AND path IN (SELECT path FROM inside)),
tests AS (SELECT DISTINCT nodeid, test_path FROM test_edge WHERE symbol = 'p1')
SELECT (SELECT count(*) FROM inside WHERE path NOT IN (SELECT 'nation/' || n_nationkey FROM nation WHERE n_regionkey = 4)) AS files, (SELECT count(DISTINCT nodeid) FROM tests) AS tests,
  (SELECT count(DISTINCT test_path) FROM tests) AS test_files, 0 AS call_sites, 0 AS target_sites, (SELECT count(*) FROM loose) AS unresolved, 0 AS deepest""")
def importers_radius(spark, d):
    symbols, sites = materialise(b.symbol(spark, d)), materialise(b.call_site(spark, d))
    nation = b.table(spark, d, "nation").select(
        b.graph(), F.concat(F.lit("nation/"), F.col("n_nationkey").cast("string")).alias("path"), (F.col("n_regionkey") == 4).alias("is_test")
    )
    imports = materialise(b.import_edge(spark, d))
    radius = rad.blast_radius(rad.find_target(symbols, "p1"), symbols, sites, imports, nation, b.test_edge(spark, d), seed="importers")
    return radius.status.drop("graph_id", "target", "status")


@query("""SELECT 'p' || p_partkey AS fqn, p_brand AS path,
  row_number() OVER (ORDER BY length(p_brand) - length(replace(p_brand, '/', '')), p_brand, p_partkey) = 1 AS is_target
FROM part WHERE p_name = 'red widget'""")
def find_symbol(spark, d):
    part = b.table(spark, d, "part")
    symbols = part.select(
        b.graph(), F.concat_ws(".", "p_brand", F.col("p_partkey").cast("string"), "p_name").alias("fqn"), F.col("p_name").alias("name"),
        F.col("p_brand").alias("path"), F.lit("function").alias("kind"), "p_partkey",
    )
    found = rad.find_symbols(symbols, "red widget", "function")
    # Names tie on the path alone, so the key decides as in the twin.
    first = found.groupBy("graph_id").agg(F.min(F.struct("path", "p_partkey"))["p_partkey"].alias("best"))
    return found.join(first, "graph_id").select(
        b.tag("p", "p_partkey").alias("fqn"), "path", (F.col("p_partkey") == F.col("best")).alias("is_target")
    )


@query(f"WITH {b.CALL_EDGE} SELECT caller, callee, confidence FROM call_edge WHERE callee IN (SELECT 'p' || p_partkey FROM part WHERE p_brand = 'Brand#1')")
def callers_of(spark, d):
    frontier = b.table(spark, d, "part").filter(F.col("p_brand") == "Brand#1").select(b.graph(), b.tag("p", "p_partkey").alias("symbol"))
    return ed.callers_of(b.call_edge(spark, d), frontier).select("caller", "callee", "confidence")


@query(f"""WITH {b.SITE} SELECT caller, callee_name, path, line FROM site
WHERE callee IS NULL AND callee_name IN (SELECT p_name FROM part WHERE p_type = 'SMALL')""")
def unresolved_calls(spark, d):
    names = b.table(spark, d, "part").filter(F.col("p_type") == "SMALL").select(b.graph(), F.col("p_name").alias("callee_name"))
    return ed.unresolved_matching(b.call_site(spark, d), names).select("caller", "callee_name", "path", "line")


@query(f"""WITH {b.SITE} SELECT path, line, callee_name, confidence, count(*) AS sites FROM site
WHERE dynamic AND path IN (SELECT 'nation/' || n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'ASIA')
GROUP BY ALL""")
def dynamic_calls(spark, d):
    nations = b.table(spark, d, "nation").join(
        b.table(spark, d, "region").filter(F.col("r_name") != "ASIA"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    paths = nations.select(b.graph(), F.concat(F.lit("nation/"), F.col("n_nationkey").cast("string")).alias("path"))
    return ed.calls_in(b.call_site(spark, d), paths, F.col("dynamic")).groupBy("path", "line", "callee_name", "confidence").agg(
        F.count(F.lit(1)).alias("sites")
    )


@query(f"""WITH {b.IMPORT_EDGE}, poor AS (SELECT * FROM supplier WHERE s_acctbal < 1000)
SELECT DISTINCT path, 'symbol' AS how FROM import_edge WHERE resolved_symbol IN (SELECT 's' || s_suppkey FROM poor)
UNION ALL SELECT DISTINCT path, 'file' FROM import_edge WHERE resolved_path IN (SELECT 'nation/' || s_nationkey FROM poor)""")
def importers(spark, d):
    poor = b.table(spark, d, "supplier").filter(F.col("s_acctbal") < 1000)
    imports = b.import_edge(spark, d)
    symbols = poor.select(b.graph(), b.tag("s", "s_suppkey").alias("symbol"))
    files = poor.select(b.graph(), F.concat(F.lit("nation/"), F.col("s_nationkey").cast("string")).alias("path"))
    by_symbol = ed.importers_of(imports, symbols).select("path", F.lit("symbol").alias("how"))
    return by_symbol.unionByName(ed.importers_of_files(imports, files).select("path", F.lit("file").alias("how")))


@query(f"WITH {b.TEST_EDGE} SELECT symbol, source, count(DISTINCT nodeid) AS tests FROM test_edge GROUP BY 1, 2")
def covering_by_source(spark, d):
    parts = b.table(spark, d, "part").select(b.graph(), b.tag("p", "p_partkey").alias("symbol"))
    tests = ed.tests_by_source(b.test_edge(spark, d), parts).select("symbol", F.explode("by_source").alias("source", "nodeids"))
    return tests.select("symbol", "source", F.size("nodeids").cast("long").alias("tests"))


@query(f"""WITH {b.TEST_EDGE}, file AS (SELECT 'p' || p_partkey AS path FROM part),
usable AS (SELECT symbol AS path, nodeid, CASE source WHEN 'coverage' THEN 1 ELSE 2 END AS rank, source FROM test_edge WHERE source <> 'characterisation'),
best AS (SELECT path, min(rank) AS rank FROM usable GROUP BY path)
SELECT f.path, u.nodeid, u.source, u.nodeid IS NULL AS full_suite
FROM file f LEFT JOIN (SELECT DISTINCT u.path, u.nodeid, u.source FROM usable u JOIN best b ON u.path = b.path AND u.rank = b.rank) u ON f.path = u.path""")
def select_fallback(spark, d):
    parts = b.table(spark, d, "part").select(b.graph(), b.tag("p", "p_partkey").alias("path"))
    return ed.select_tests(parts, parts.withColumn("fqn", F.col("path")), b.test_edge(spark, d)).select(
        "path", "nodeid", "source", "full_suite"
    )


@query(f"""WITH {b.SITE} SELECT DISTINCT 'brand/' || p_brand AS path, p_name AS name, s.path AS consumer
FROM site s JOIN part ON s.callee = 'p' || p_partkey JOIN nation ON s.path = 'nation/' || n_nationkey WHERE n_regionkey <> 4""")
def consumers(spark, d):
    symbols = b.symbol(spark, d).filter(F.startswith("path", F.lit("brand/")))
    files = b.table(spark, d, "nation").select(
        b.graph(), F.concat(F.lit("nation/"), F.col("n_nationkey").cast("string")).alias("path"), (F.col("n_regionkey") == 4).alias("is_test")
    )
    return ed.consumers(symbols, b.call_site(spark, d), files).select("path", "name", "consumer")


@query("""WITH pair AS (SELECT user_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS line, event_type, event_id FROM events)
SELECT CAST(user_id AS VARCHAR) AS file, line, event_type AS name, min(event_id) AS stage,
  sha256('{"kind":"' || event_type || '","line":' || line || '}') AS request_key FROM pair GROUP BY user_id, line, event_type""")
def dedupe_first(spark, d):
    rows = b.event(spark, d).select(
        b.graph(), F.col("job_id").alias("file"), F.get_json_object("payload", "$.k").cast("int").alias("line"),
        F.col("kind").alias("name"), F.col("seq").alias("stage"),
    )
    key = request_key(F.col("name").alias("kind"), "line")
    return rad.dedupe_unresolved(rows, ["graph_id"]).select("file", "line", "name", "stage", key.alias("request_key"))


@query(f"""WITH RECURSIVE {b.PART_DEP}, path AS (
  SELECT seq, needs FROM part_dep UNION SELECT p.seq, d.needs FROM path p JOIN part_dep d ON d.seq = p.needs)
SELECT a.p_partkey AS seq, n.p_partkey AS needs, n.p_name AS target_file FROM path JOIN part a ON a.p_partkey = path.seq JOIN part n ON n.p_partkey = path.needs
WHERE n.p_size >= 10 AND a.p_name <> n.p_name""")
def closure(spark, d):
    tasks = b.table(spark, d, "part").select(
        F.lit("parts").alias("job_id"), F.col("p_partkey").alias("seq"), F.col("p_name").alias("target_file"),
        F.when(F.col("p_size") >= 10, "verified").otherwise("discarded").alias("state"),
    )
    return dep.dependency_closure(tasks, b.part_dep(spark, d)).select("seq", "needs", "target_file")


@query("""WITH RECURSIVE node AS (SELECT p_partkey AS node, p_partkey // 3 AS parent FROM part WHERE p_partkey > 0),
up AS (SELECT node, parent, node AS root, 0 AS depth FROM node WHERE parent = 0 UNION ALL
       SELECT n.node, n.parent, u.root, u.depth + 1 FROM node n JOIN up u ON n.parent = u.node),
kids AS (SELECT parent AS node, count(*) AS children FROM node GROUP BY parent)
SELECT u.node, u.root, u.depth, coalesce(k.children, 0) AS children FROM up u LEFT JOIN kids k ON k.node = u.node""")
def fork_tree(spark, d):
    nodes = b.table(spark, d, "part").filter(F.col("p_partkey") > 0).select(
        F.lit("parts").alias("job_id"), F.col("p_partkey").alias("node"), F.floor(F.col("p_partkey") / 3).alias("parent")
    )
    return dep.fork_tree(nodes).select("node", "root", "depth", "children")


@query(f"""WITH RECURSIVE task AS (
  SELECT l_orderkey AS job, l_linenumber AS seq, min(l_suppkey) AS file FROM lineitem GROUP BY 1, 2),
plan AS (SELECT job, list({{'seq': seq, 'file': file}} ORDER BY seq) AS tasks FROM task GROUP BY job),
step AS (
  SELECT job, 0 AS wave, CAST([] AS INTEGER[]) AS done, CAST([] AS INTEGER[]) AS now FROM plan
  UNION ALL
  SELECT job, wave + 1, list_concat(done, fresh), fresh FROM (
    SELECT s.job, s.wave, s.done, list_transform(list_filter(ready, lambda t: len(list_filter(ready, lambda u: u.file = t.file AND u.seq < t.seq)) = 0), lambda t: t.seq) AS fresh
    FROM (SELECT s.job, s.wave, s.done,
            list_filter(p.tasks, lambda t: NOT list_contains(s.done, t.seq) AND (t.seq = 1 OR list_contains(s.done, t.seq // 2))) AS ready
          FROM step s JOIN plan p ON s.job = p.job) s) WHERE len(fresh) > 0),
placed AS (SELECT job, wave, unnest(now) AS seq FROM step)
SELECT 'o' || t.job AS job_id, t.seq, p.wave FROM task t LEFT JOIN placed p ON t.job = p.job AND t.seq = p.seq""")
def waves(spark, d):
    tasks = b.table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_suppkey").alias("file")).select(
        b.tag("o", "l_orderkey").alias("job_id"), F.col("l_linenumber").alias("seq"), b.tag("s", "file").alias("target_file")
    )
    return dep.order_waves(tasks, b.task_dep(spark, d))


# Tasks 1 to 3 wait for each other in a ring, 5 and 6 for each other; 4 leads from the second ring to the first, 7 and up into the second.
RING = """CASE WHEN l_linenumber <= 3 THEN l_linenumber % 3 + 1 WHEN l_linenumber = 4 THEN 3 WHEN l_linenumber IN (5, 6) THEN 11 - l_linenumber ELSE l_linenumber - 1 END"""


@query(f"""WITH RECURSIVE need AS (SELECT DISTINCT l_orderkey AS o, l_linenumber AS seq, {RING} AS needs FROM lineitem
  UNION SELECT l_orderkey, 5, 4 FROM lineitem WHERE l_linenumber = 5 UNION SELECT l_orderkey, l_linenumber, l_linenumber FROM lineitem WHERE l_suppkey % 50 = 0),
reach AS (SELECT o, seq, needs FROM need UNION SELECT r.o, r.seq, n.needs FROM reach r JOIN need n ON n.o = r.o AND n.seq = r.needs)
SELECT 'o' || o AS job_id, seq FROM reach WHERE seq = needs""")
def plan_cycles(spark, d):
    lines = b.table(spark, d, "lineitem").select(b.tag("o", "l_orderkey").alias("job_id"), F.col("l_linenumber").alias("seq"), F.expr(RING).alias("ring"), "l_suppkey")
    ring = lines.select("job_id", "seq", F.col("ring").alias("needs"))
    bridge = lines.filter("seq = 5").select("job_id", "seq", F.lit(4).alias("needs"))
    own = lines.filter("l_suppkey % 50 = 0").select("job_id", "seq", F.col("seq").alias("needs"))
    return dep.cycles(ring.union(bridge).union(own))


@query(f"""WITH {b.RUN_TASK}, {b.TASK_DEP}, raw AS (SELECT 'o' || l_orderkey AS job_id, l_linenumber AS seq, 'p' || l_partkey AS target_file FROM lineitem)
SELECT job_id, 'duplicate seq' AS rule, seq FROM raw GROUP BY job_id, seq HAVING count(*) > 1
UNION ALL SELECT job_id, 'too many tasks', NULL FROM raw GROUP BY job_id HAVING count(*) > 7
UNION ALL SELECT DISTINCT job_id, 'outside radius', seq FROM raw JOIN part ON target_file = 'p' || p_partkey WHERE p_size < 5
UNION ALL SELECT DISTINCT d.job_id, 'unknown dependency', d.seq FROM task_dep d LEFT JOIN raw r ON d.job_id = r.job_id AND d.needs = r.seq WHERE r.seq IS NULL""")
def plan_violations(spark, d):
    lines = b.table(spark, d, "lineitem").select(
        b.tag("o", "l_orderkey").alias("job_id"), F.col("l_linenumber").alias("seq"), b.tag("p", "l_partkey").alias("target_file")
    )
    inside = b.table(spark, d, "part").filter(F.col("p_size") >= 5).select(b.tag("p", "p_partkey").alias("target_file"))
    radius = lines.select("job_id", "target_file").join(inside, "target_file", "left_semi")
    return dep.plan_violations(lines, b.task_dep(spark, d), radius, max_tasks=7)


@query(f"""WITH file AS (SELECT string_split({b.URL_PATH}, '/') AS parts FROM pages),
level AS (SELECT parts, unnest(range(1, len(parts) + 1)) AS i FROM file),
entry AS (SELECT array_to_string(parts[1:i - 1], '/') AS prefix, parts[i] AS name, CASE WHEN i = len(parts) THEN 'file' ELSE 'dir' END AS kind, count(*) AS files
          FROM level GROUP BY ALL),
placed AS (SELECT *, row_number() OVER (PARTITION BY prefix ORDER BY kind <> 'dir', name) AS rn, count(*) OVER (PARTITION BY prefix) AS total FROM entry)
SELECT prefix, name, kind, files, total, total > 60 AS truncated FROM placed WHERE rn <= 60""")
def tree_level(spark, d):
    entries = trees.tree_all(b.page_file(spark, d), ["graph_id"])
    return trees.bounded_tree(entries, ["graph_id"]).drop("graph_id")


@query(f"""WITH {b.LINE}, found AS (SELECT doc_id, lang || '.d' || doc_id || '.' || source AS fqn FROM documents WHERE source = 'src3'),
placed AS (SELECT *, row_number() OVER (ORDER BY CAST(doc_id AS VARCHAR), fqn) AS rn, count(*) OVER () AS total FROM found)
SELECT p.fqn, p.total, p.total > 5 AS truncated, string_agg(l.text, chr(10) ORDER BY l.line_no) FILTER (WHERE l.line_no <= 400) AS source, count(*) AS total_lines, count(*) > 400 AS source_truncated
FROM placed p JOIN line l ON l.doc_id = p.doc_id WHERE rn <= 5 GROUP BY ALL""")
def entity(spark, d):
    symbols, lines = _text_symbols(spark, d)
    return trees.entity(symbols, lines, "src3").select("fqn", "total", "truncated", "source", "total_lines", "source_truncated")


@query(f"""WITH {b.LINE}, found AS (SELECT doc_id, lang || '.d' || doc_id || '.' || source AS fqn, count(*) OVER (PARTITION BY lang) AS total FROM documents WHERE source = 'src4')
SELECT p.fqn, p.total, false AS truncated, string_agg(l.text, chr(10) ORDER BY l.line_no) AS source, count(*) AS total_lines, false AS source_truncated
FROM found p JOIN line l ON l.doc_id = p.doc_id GROUP BY ALL""")
def entity_whole(spark, d):
    # Each language is a graph; no symbol and no line is left out.
    symbols, lines = _text_symbols(spark, d, F.col("lang").alias("graph_id"))
    return trees.entity(symbols, lines, "src4", limit=None, cap=None).select("fqn", "total", "truncated", "source", "total_lines", "source_truncated")


def _text_symbols(spark, d, graph=None):
    """Every text as one file with one symbol, and the lines of the texts."""
    symbols = b.table(spark, d, "documents").select(
        b.graph() if graph is None else graph, F.concat(F.col("lang"), F.lit(".d"), F.col("doc_id").cast("string"), F.lit("."), F.col("source")).alias("fqn"),
        F.col("source").alias("name"), F.col("doc_id").cast("string").alias("path"), F.lit(1).alias("line_start"), F.lit(2**31 - 1).alias("line_end"),
    )
    return symbols, b.line(spark, d).select(b.graph() if graph is None else graph, F.col("doc_id").cast("string").alias("path"), "line_no", "text")


@query(f"""WITH {b.LINE}, hit AS (SELECT *, line_no BETWEEN 2 AND 4 AS inside FROM line)
SELECT doc_id, 2 AS start, max(line_no) FILTER (WHERE inside) AS "end", true AS truncated, true AS found, count(*) AS total_lines,
  coalesce(string_agg(text, chr(10) ORDER BY line_no) FILTER (WHERE inside), '') AS text FROM hit GROUP BY doc_id
UNION ALL SELECT -1 - item_id, 2, NULL, true, false, 0, '' FROM benchmark""")
def read_span(spark, d):
    # Benchmark items stand for files that are not there.
    ids = b.table(spark, d, "documents").select("doc_id").unionByName(b.table(spark, d, "benchmark").select((-1 - F.col("item_id")).alias("doc_id")))
    spans = ids.select("doc_id", F.lit(2).alias("start"), F.lit(6).alias("end"))
    return trees.read_span(b.line(spark, d).select("doc_id", "line_no", "text"), spans, ["doc_id"], cap=3)


@query(f"""WITH {b.LINE}, span AS (SELECT doc_id, unnest([1, 3]) AS start FROM documents UNION ALL SELECT -1 - item_id, 1 FROM benchmark)
SELECT s.doc_id, s.start, max(l.line_no) FILTER (WHERE l.line_no >= s.start) AS "end", false AS truncated, count(l.line_no) > 0 AS found, count(l.line_no) AS total_lines,
  coalesce(string_agg(l.text, chr(10) ORDER BY l.line_no) FILTER (WHERE l.line_no >= s.start), '') AS text
FROM span s LEFT JOIN line l ON l.doc_id = s.doc_id GROUP BY s.doc_id, s.start""")
def read_span_whole(spark, d):
    # Each text from its first line on and from its third, to the end and uncut.
    ids = b.table(spark, d, "documents").select("doc_id", F.explode(F.array(F.lit(1), F.lit(3))).alias("start"))
    absent = b.table(spark, d, "benchmark").select((-1 - F.col("item_id")).alias("doc_id"), F.lit(1).alias("start"))
    spans = ids.unionByName(absent).withColumn("end", F.lit(2**31 - 1))
    return trees.read_span(b.line(spark, d).select("doc_id", "line_no", "text"), spans, ["doc_id"], cap=None)


@query("""WITH node AS (SELECT c_custkey, n_regionkey AS r FROM customer JOIN nation ON c_nationkey = n_nationkey),
o AS (SELECT o_orderkey, r FROM orders JOIN node ON o_custkey = c_custkey),
l AS (SELECT r, l_returnflag, l_linestatus FROM lineitem JOIN o ON l_orderkey = o_orderkey)
SELECT 'r' || r_regionkey AS graph_id, (SELECT count(*) FROM nation WHERE n_regionkey = r_regionkey) AS files,
 (SELECT count(*) FROM node WHERE r = r_regionkey) AS symbols, (SELECT count(*) FROM o WHERE r = r_regionkey) AS import_edges,
 (SELECT count(*) FROM l WHERE r = r_regionkey) AS call_edges, (SELECT count(*) FROM l WHERE r = r_regionkey AND l_returnflag <> 'N') AS heuristic_edges,
 (SELECT count(*) FROM l WHERE r = r_regionkey AND l_linestatus = 'F') AS test_edges,
 (SELECT count(*) FROM nation WHERE n_regionkey = r_regionkey AND n_nationkey % 3 = 0) AS parse_errors FROM region""")
def graph_stats(spark, d):
    nation = b.table(spark, d, "nation").select(F.col("n_nationkey"), b.tag("r", "n_regionkey").alias("graph_id"))
    customer = b.table(spark, d, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "graph_id")
    orders = b.table(spark, d, "orders").join(customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "graph_id")
    lines = b.table(spark, d, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        "graph_id", F.when(F.col("l_returnflag") == "N", "static").otherwise("heuristic").alias("confidence"), "l_linestatus"
    )
    return ed.graph_stats({
        "file": nation, "symbol": customer, "import_edge": orders, "call_edge": lines,
        "test_edge": lines.filter(F.col("l_linestatus") == "F"),
        "parse_error": nation.filter(F.col("n_nationkey") % 3 == 0).withColumn("path", F.col("n_nationkey")),
    })


# --------------------------------------------------------------- resolution --


@query("""WITH file AS (
  SELECT n_name, CASE n_regionkey WHEN 0 THEN 'src/' || n_name || '.py' WHEN 1 THEN 'lib/' || n_name || '/__init__.py' WHEN 2 THEN n_name || '.py' WHEN 3 THEN n_name || '/__init__.py' ELSE 'app/' || n_name || '.py' END AS path FROM nation),
imp AS (SELECT c_custkey, 'app/c' || c_custkey || '.py' AS importer, n_name AS module, c_mktsegment AS name FROM customer JOIN nation ON c_nationkey = n_nationkey),
cand AS (SELECT c_custkey, importer, name, unnest([module || '.py', module || '/__init__.py', 'src/' || module || '.py', 'src/' || module || '/__init__.py',
   'lib/' || module || '.py', 'lib/' || module || '/__init__.py', 'app/' || module || '.py', 'app/' || module || '/__init__.py']) AS path,
   unnest(range(8)) AS pos FROM imp),
known AS (SELECT c.*, f.n_name FROM cand c JOIN file f USING (path)),
sym AS (SELECT DISTINCT f.path, c_mktsegment AS name FROM supplier JOIN file f ON f.n_name = 'NATION_' || s_nationkey JOIN customer ON c_nationkey = s_nationkey WHERE s_acctbal > 0)
SELECT i.importer AS path, (SELECT arg_min(k.path, pos) FROM known k WHERE k.c_custkey = i.c_custkey) AS resolved_path,
  (SELECT arg_min(replace(replace(replace(k.path, '/__init__.py', ''), '.py', ''), '/', '.') || '.' || k.name, pos) FROM known k JOIN sym s ON s.path = k.path AND s.name = k.name WHERE k.c_custkey = i.c_custkey) AS resolved_symbol
FROM imp i""")
def resolve_first(spark, d):
    nation, customer = b.table(spark, d, "nation"), b.table(spark, d, "customer")
    r, n = F.col("n_regionkey"), F.col("n_name")
    module_file = (
        F.when(r == 0, F.concat(F.lit("src/"), n, F.lit(".py"))).when(r == 1, F.concat(F.lit("lib/"), n, F.lit("/__init__.py")))
        .when(r == 2, F.concat(n, F.lit(".py"))).when(r == 3, F.concat(n, F.lit("/__init__.py")))
        .otherwise(F.concat(F.lit("app/"), n, F.lit(".py")))
    )
    modules = nation.select("n_nationkey", "n_name", module_file.alias("path"))
    own = F.concat(F.lit("app/c"), F.col("c_custkey").cast("string"), F.lit(".py"))
    files = modules.select(b.graph(), "path", F.lit("python").alias("lang"), F.lit(False).alias("is_test")).unionByName(
        customer.select(b.graph(), own.alias("path"), F.lit("python").alias("lang"), F.lit(False).alias("is_test"))
    )
    imports = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        b.graph(), own.alias("path"), F.col("c_mktsegment").alias("symbol_name"), F.col("c_mktsegment").alias("local_name"),
        F.col("n_name").alias("source_module"), F.lit(1).alias("line"), F.lit(0).alias("ord"),
    )
    solvent = b.table(spark, d, "supplier").filter(F.col("s_acctbal") > 0).select(F.col("s_nationkey").alias("n_nationkey")).distinct()
    named = customer.select(F.col("c_nationkey").alias("n_nationkey"), F.col("c_mktsegment").alias("name")).distinct()
    symbols = modules.join(solvent, "n_nationkey").join(named, "n_nationkey").select(
        b.graph(), join_name(module_name("path"), "name").alias("fqn"), "name", "path", F.lit(1).alias("line_start"), F.lit(None).cast("string").alias("parent")
    )
    return res.resolve_imports(imports, files, symbols).select("path", "resolved_path", "resolved_symbol")


@query("""WITH b AS (SELECT user_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS name, event_type, value > 50 AS rank, event_id FROM events)
SELECT CAST(user_id AS VARCHAR) AS path, name, event_type AS fqn FROM b QUALIFY row_number() OVER (PARTITION BY user_id, name ORDER BY rank DESC, event_id DESC) = 1""")
def last_wins(spark, d):
    rows = b.event(spark, d).select(
        F.col("job_id").alias("path"), F.get_json_object("payload", "$.k").cast("int").alias("name"), F.col("kind").alias("fqn"),
        (F.col("value") > 50).alias("rank"), F.col("seq").alias("ord"),
    )
    return res.last_wins(rows, ["path", "name"], ["rank", "ord"]).select("path", "name", "fqn")


@query(f"""WITH {b.SITE}, alias AS (SELECT 'nation/' || s_nationkey AS path, 'Brand#' || (s_suppkey % 25 + 1) AS alias, 'brand/Brand#' || (s_suppkey % 25 + 1) AS file FROM supplier GROUP BY ALL),
idx AS (SELECT 'brand/' || p_brand AS file, p_name AS name, 'p' || max(p_partkey) AS fqn FROM part GROUP BY ALL),
own AS (SELECT 'nation/' || s_nationkey AS path, p_name AS name, 's' || max(s_suppkey) AS fqn FROM supplier JOIN part ON p_partkey = s_suppkey GROUP BY ALL),
uniq AS (SELECT p_name AS name, 'p' || min(p_partkey) AS fqn FROM part WHERE p_brand <> 'Brand#1' AND p_size > 45 GROUP BY p_name),
call AS (SELECT 'o' || l_orderkey AS caller, 'nation/' || c_nationkey AS path, l_linenumber AS line, p_name AS name, CASE WHEN l_linestatus = 'F' THEN p_brand END AS receiver, l_returnflag = 'R' AS computed
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey),
found AS (SELECT c.*, i.fqn AS by_module, o.fqn AS by_local, u.fqn AS by_name FROM call c
  LEFT JOIN alias a ON a.path = c.path AND a.alias = c.receiver LEFT JOIN idx i ON i.file = a.file AND i.name = c.name
  LEFT JOIN own o ON o.path = c.path AND o.name = c.name LEFT JOIN uniq u ON u.name = c.name),
pick AS (SELECT *, CASE WHEN computed THEN NULL WHEN receiver IS NULL THEN by_local ELSE by_module END AS proved FROM found)
SELECT caller, path, line, name AS callee_name, coalesce(proved, by_name) AS callee, CASE WHEN proved IS NULL THEN 'heuristic' ELSE 'static' END AS confidence,
  computed OR (coalesce(proved, by_name) IS NULL AND receiver IS NULL) AS dynamic FROM pick""")
def resolve_cascade(spark, d):
    part, supplier = b.table(spark, d, "part"), b.table(spark, d, "supplier")
    lines, orders, customer = (b.table(spark, d, t) for t in ("lineitem", "orders", "customer"))
    nation = F.concat(F.lit("nation/"), F.col("s_nationkey").cast("string"))
    brand = F.concat(F.lit("Brand#"), (F.col("s_suppkey") % 25 + 1).cast("string"))
    aliases = supplier.select(b.graph(), nation.alias("path"), brand.alias("alias"), F.concat(F.lit("brand/"), brand).alias("target_file")).distinct()
    index = part.groupBy("p_brand", "p_name").agg(F.max("p_partkey").alias("k")).select(
        b.graph(), F.concat(F.lit("brand/"), "p_brand").alias("path"), F.col("p_name").alias("name"), b.tag("p", "k").alias("fqn")
    )
    own = supplier.join(part, F.col("p_partkey") == F.col("s_suppkey")).groupBy(nation.alias("path"), F.col("p_name").alias("name")).agg(
        F.max("s_suppkey").alias("k")
    ).select(b.graph(), "path", "name", b.tag("s", "k").alias("fqn"))
    unique = part.filter((F.col("p_brand") != "Brand#1") & (F.col("p_size") > 45)).groupBy(F.col("p_name").alias("name")).agg(
        F.min("p_partkey").alias("k")
    ).select(b.graph(), "name", b.tag("p", "k").alias("fqn"))
    calls = (
        lines.join(part, F.col("l_partkey") == F.col("p_partkey")).join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .select(
            b.graph(), b.tag("o", "l_orderkey").alias("caller"), F.concat(F.lit("nation/"), F.col("c_nationkey").cast("string")).alias("path"),
            F.col("l_linenumber").alias("line"), F.col("p_name").alias("callee_name"),
            F.when(F.col("l_linestatus") == "F", F.col("p_brand")).alias("receiver"), (F.col("l_returnflag") == "R").alias("dynamic"),
        )
    )
    return res.resolve_calls(calls, own, aliases, index, unique).select(
        "caller", "path", "line", "callee_name", "callee", "confidence", "dynamic"
    )


@query("""WITH last AS (SELECT p_brand, p_name, max(p_partkey) AS k FROM part GROUP BY ALL)
SELECT p_name AS name, 'p' || k AS fqn FROM last
QUALIFY row_number() OVER (PARTITION BY p_name ORDER BY p_brand LIKE '%2', 'brand/' || p_brand) = 1""")
def best_by_name(spark, d):
    part = b.table(spark, d, "part")
    path = F.concat(F.lit("brand/"), "p_brand")
    symbols = part.select(
        b.graph(), path.alias("path"), F.col("p_name").alias("name"), b.tag("p", "p_partkey").alias("fqn"),
        F.col("p_partkey").alias("line_start"), F.lit(None).cast("string").alias("parent"),
    )
    files = part.select(b.graph(), path.alias("path"), F.endswith("p_brand", F.lit("2")).alias("is_test")).distinct()
    return res.unique_by_name(symbols, files).select("name", "fqn")


@query("""WITH span AS (SELECT o_custkey AS c, min(CAST(o_orderdate AS DATE)) AS lo, max(CAST(o_orderdate AS DATE)) AS hi FROM orders GROUP BY 1),
cov AS (SELECT DISTINCT o_custkey AS c, CAST(l_shipdate AS DATE) AS day, l_suppkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT DISTINCT 'c' || s.c AS symbol, 's' || l_suppkey AS test_path, 's' || l_suppkey || '::ship' AS nodeid, 'coverage' AS source
FROM span s JOIN cov ON cov.c = s.c AND day BETWEEN lo AND hi""")
def range_hits(spark, d):
    orders, lines = b.table(spark, d, "orders"), b.table(spark, d, "lineitem")
    day = F.date_diff(F.to_date("o_orderdate"), F.lit("1970-01-01").cast("date"))
    symbols = orders.groupBy("o_custkey").agg(F.min(day).alias("line_start"), F.max(day).alias("line_end")).select(
        b.graph(), b.tag("c", "o_custkey").alias("path"), b.tag("c", "o_custkey").alias("fqn"), "line_start", "line_end"
    )
    contexts = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        b.graph(), b.tag("c", "o_custkey").alias("path"),
        F.date_diff(F.to_date("l_shipdate"), F.lit("1970-01-01").cast("date")).alias("line"),
        F.concat(b.tag("s", "l_suppkey"), F.lit("::ship")).alias("nodeid"), b.tag("s", "l_suppkey").alias("test_path"),
    )
    files = b.table(spark, d, "supplier").select(b.graph(), b.tag("s", "s_suppkey").alias("path"), F.lit(True).alias("is_test"))
    return ed.coverage_test_edges(contexts, symbols, files).drop("graph_id")


@query(f"""WITH page AS (SELECT page_id, {b.URL_PATH} AS path FROM pages),
hit AS (SELECT path, regexp_matches(path, '(^|/)(tests?|__tests__|testing)(/|$)') OR regexp_matches(path, '(^|/)(test_[^/]+|[^/]+_test|[^/]+\\.test|[^/]+\\.spec)\\.[a-z]+$') AS is_test FROM page)
SELECT path, is_test FROM hit""")
def test_paths(spark, d):
    return b.page_file(spark, d).select("path", is_test_path("path").alias("is_test"))
