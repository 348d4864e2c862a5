"""Reports, replies and small rules, fed with records that Spark builds from the whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from impactlens.functions import reports, text as tx
from impactlens.operators import checks, cleanup, edges, interface, ledger, resolve, trees
from impactlens.plans import bindings as b
from impactlens.plans.registry import ORACLES, query
from impactlens.plans.run_queries import PARAMS, params_of
from impactlens.plans.skew import dealt
from impactlens.sources import diffs
from impactlens.sources.tree import file_table

FILE_PATH = """CASE WHEN source = 'src3' THEN 'tests/' ELSE 'src/' END || source || '/d' || doc_id || CASE lang WHEN 'en' THEN '.py' WHEN 'fr' THEN '.ts' ELSE '.txt' END"""


@query(f"""SELECT {FILE_PATH} AS path, CASE lang WHEN 'en' THEN 'python' WHEN 'fr' THEN 'typescript' END AS lang, sha256(text) AS sha256, source = 'src3' AS is_test FROM documents""")
def file_rows(spark, d):
    suffix = F.when(F.col("lang") == "en", ".py").when(F.col("lang") == "fr", ".ts").otherwise(".txt")
    folder = F.when(F.col("source") == "src3", "tests/").otherwise("src/")
    path = F.concat(folder, F.col("source"), F.lit("/d"), F.col("doc_id").cast("string"), suffix)
    return file_table(b.documents(spark, d).select(b.graph(), path.alias("path"), F.encode("text", "UTF-8").alias("content"))).drop("graph_id")


@query("""SELECT c_custkey, CASE WHEN c_nationkey < 5 THEN c_custkey % 3 = 0 ELSE c_custkey % 2 = 0 END AS exported FROM customer""")
def exported_names(spark, d):
    key = F.col("c_custkey")
    name = F.concat(F.when(key % 2 == 1, "_c").otherwise("c"), key.cast("string"))
    listed = F.when(F.col("c_nationkey") < 5, F.when(key % 3 == 0, F.array(name)).otherwise(F.array(F.lit("other"))))
    return b.table(spark, d, "customer").select("c_custkey", tx.exported(name, listed).alias("exported"))


@query("""SELECT p_partkey, CASE WHEN p_size >= 10 THEN list_sort(list_distinct([p_brand, p_type, p_name])) ELSE list_sort(list_distinct([p_brand, p_name])) END AS names FROM part""")
def merged_names(spark, d):
    second = F.when(F.col("p_size") >= 10, F.array("p_type", "p_brand"))
    return b.table(spark, d, "part").select("p_partkey", tx.merged_names(F.array("p_brand", "p_name"), second).alias("names"))


@query("SELECT doc_id, greatest(1, length(text) // 3) AS tokens FROM documents")
def token_estimate(spark, d):
    return b.documents(spark, d).select("doc_id", tx.estimate_tokens("text").alias("tokens"))


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN o_custkey WHEN 'O' THEN o_custkey END AS collected FROM orders")
def collected_tests(spark, d):
    n = F.col("o_custkey").cast("string")
    said = F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("took 1s\n"), n, F.lit(" tests collected"))).when(
        F.col("o_orderstatus") == "O", F.concat(F.lit(" "), n, F.lit("\n"))).otherwise("no tests ran in 2 s")
    return b.table(spark, d, "orders").select("o_orderkey", tx.collected_count(said).alias("collected"))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_custkey % 3 <> 0 END AS comparable FROM orders")
def comparable_runs(spark, d):
    first = F.to_json(F.create_map(F.lit("model"), F.col("o_orderpriority"), F.lit("seed"), F.col("o_orderstatus")))
    other = F.when(F.col("o_custkey") % 3 == 0, "another").otherwise(F.col("o_orderpriority"))
    second = F.to_json(F.create_map(F.lit("seed"), F.col("o_orderstatus"), F.lit("model"), other))
    same = ledger.tunables_equal(first, F.when(F.col("o_orderstatus") != "P", second))
    return b.table(spark, d, "orders").select("o_orderkey", same.alias("comparable"))


@query("""SELECT DISTINCT 'tests/d' || doc_id || '.py' AS test_path, source AS symbol, 'tests/d' || doc_id || '.py::test_' || n AS nodeid
FROM (SELECT doc_id, source, unnest([lang, source]) AS n FROM documents)""")
def generated_tests(spark, d):
    code = F.concat(F.lit("def test_"), F.col("lang"), F.lit("():\n    pass\n# "), F.regexp_replace("text", "\n", " "), F.lit("\ndef test_"), F.col("source"), F.lit("(x):\n"))
    sources = b.documents(spark, d).select(b.graph(), F.concat(F.lit("tests/d"), F.col("doc_id").cast("string"), F.lit(".py")).alias("path"), F.col("source").alias("symbol"), code.alias("text"))
    return edges.generated_test_edges(sources).select("test_path", "symbol", "nodeid")


@query("SELECT c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 2")
def symbols_in_files(spark, d):
    nation = F.concat(F.lit("nation/"), F.col("c_nationkey").cast("string"))
    paths = b.table(spark, d, "nation").filter(F.col("n_regionkey") == 2).select(b.graph(), F.concat(F.lit("nation/"), F.col("n_nationkey").cast("string")).alias("path"))
    return edges.in_files(b.table(spark, d, "customer").select(b.graph(), nation.alias("path"), "c_custkey"), paths).select("c_custkey")


@query("""SELECT l_suppkey, sum(l_linenumber) AS orphans_found, sum(CASE WHEN l_returnflag = 'N' THEN l_linenumber ELSE 0 END) AS removed FROM lineitem GROUP BY l_suppkey""")
def cleanup_totals(spark, d):
    rows = b.table(spark, d, "lineitem").select("l_suppkey", F.col("l_linenumber").alias("orphans"), F.when(F.col("l_returnflag") == "N", "verified").otherwise("discarded").alias("state"))
    return cleanup.moved_total(rows, ["l_suppkey"])


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_custkey % 5 = o_orderkey % 5 END AS same FROM orders""")
def test_counts(spark, d):
    before = F.when(F.col("o_orderstatus") != "P", F.col("o_custkey") % 5)
    return b.table(spark, d, "orders").select("o_orderkey", checks.test_count_ok(before, F.col("o_orderkey") % 5).alias("same"))


@query("""SELECT o.c AS symbol, coalesce(n, 0) AS tests FROM (SELECT c_custkey AS c FROM customer) o LEFT JOIN (SELECT o_custkey AS c, count(DISTINCT o_orderpriority) AS n FROM orders GROUP BY 1) t ON t.c = o.c
WHERE coalesce(n, 0) < 4""")
def thin_cover(spark, d):
    tests = b.table(spark, d, "orders").select(b.graph(), F.col("o_custkey").alias("symbol"), F.col("o_orderpriority").alias("nodeid"))
    targets = b.table(spark, d, "customer").select(b.graph(), F.col("c_custkey").alias("symbol"))
    return cleanup.needs_safety_net(targets, tests, 4).select("symbol", "tests")


# ------------------------------------------------------------------ reports --


@query("""SELECT l_orderkey, 'scanner.' || CASE WHEN l_tax > 0.06 THEN 'unknown' ELSE l_returnflag END AS rule, 'src/s' || l_suppkey AS path, l_linenumber AS line, l_linestatus AS message FROM lineitem""")
def scanner_rows(spark, d):
    one = F.struct(
        F.when(F.col("l_tax") <= 0.06, F.col("l_returnflag")).alias("check_id"), F.concat(F.lit("./work/src/s"), F.col("l_suppkey").cast("string")).alias("path"),
        F.struct(F.col("l_linenumber").alias("line")).alias("start"), F.struct(F.concat(F.col("l_linestatus"), F.lit(" ")).alias("message")).alias("extra"),
    )
    per = b.table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.to_json(F.struct(F.collect_list(one).alias("results"))).alias("report"))
    return reports.scanner_findings(per).select("l_orderkey", "rule", "path", "line", "message")


COVER = "cover AS (SELECT l_orderkey, l_suppkey, l_linenumber AS line, bool_or(l_returnflag = 'N') AS executed FROM lineitem GROUP BY ALL)"


@query(f"WITH {COVER} SELECT l_orderkey, 's' || l_suppkey || '.py' AS path, line, executed FROM cover")
def coverage_rows(spark, d):
    lines = b.table(spark, d, "lineitem")
    lines = dealt(lines.select("l_orderkey", "l_suppkey", "l_linenumber", (F.col("l_returnflag") == "N").alias("ran")), ["l_orderkey"], lines.count())
    per_file = lines.groupBy("l_orderkey", "l_suppkey").agg(
        F.collect_list(F.when(F.col("ran"), F.col("l_linenumber"))).alias("executed_lines"), F.collect_list(F.when(~F.col("ran"), F.col("l_linenumber"))).alias("missing_lines")
    )
    entry = F.struct(F.concat(F.lit("./s"), F.col("l_suppkey").cast("string"), F.lit(".py")), F.struct("executed_lines", "missing_lines"))
    per = per_file.groupBy("l_orderkey").agg(F.to_json(F.struct(F.map_from_entries(F.collect_list(entry)).alias("files"))).alias("coverage"))
    return reports.coverage_lines(per)


RUN = "run AS (SELECT l_orderkey, count_if(l_returnflag = 'N') AS passed, count_if(l_returnflag = 'R') AS failed, count_if(l_returnflag = 'A') AS errors, count(*) AS collected FROM lineitem GROUP BY 1)"


def _test_report(spark, d):
    flag = F.col("l_returnflag")
    outcome = F.when(flag == "N", "passed").when(flag == "R", "failed").otherwise("error")
    message = F.concat(F.lit("line one of "), F.col("l_linestatus"))
    one = F.struct(
        F.col("l_linenumber").alias("n"), F.concat(F.lit("tests/t.py::t"), F.col("l_linenumber").cast("string"), F.lit("_"), F.col("l_suppkey").cast("string")).alias("nodeid"), outcome.alias("outcome"),
        F.struct(message.alias("longrepr")).alias("call"),
    )
    counts = [F.count_if(flag == v).alias(k) for k, v in (("passed", "N"), ("failed", "R"), ("error", "A"))]
    per = b.table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.struct(*counts, F.count(F.lit(1)).alias("collected")).alias("summary"), F.array_sort(F.collect_list(one)).alias("tests"))
    # Every tenth run left no report behind.
    silent = F.col("l_orderkey") % 10 == 0
    return per.select("l_orderkey", F.when(~silent, F.to_json(F.struct("summary", "tests"))).alias("report"), F.when(silent, 1).otherwise(0).alias("exit_code"))


@query(f"""WITH {RUN} SELECT l_orderkey, l_orderkey % 10 <> 0 AS has_report, CASE WHEN l_orderkey % 10 = 0 THEN 0 ELSE passed END AS passed, CASE WHEN l_orderkey % 10 = 0 THEN 0 ELSE failed END AS failed,
  CASE WHEN l_orderkey % 10 = 0 THEN 1 ELSE errors END AS errors, CASE WHEN l_orderkey % 10 <> 0 THEN collected END AS collected, CASE WHEN l_orderkey % 10 = 0 THEN 0 ELSE failed + errors END AS failing FROM run""")
def report_counts(spark, d):
    return reports.test_report(_test_report(spark, d)).select("l_orderkey", "has_report", "passed", "failed", "errors", "collected", F.size("failing").alias("failing"))


@query("""WITH bad AS (SELECT l_orderkey, string_agg('tests/t.py::t' || l_linenumber || '_' || l_suppkey || chr(10) || 'line one of ' || l_linestatus, chr(10) || chr(10) ORDER BY l_linenumber, 'tests/t.py::t' || l_linenumber || '_' || l_suppkey,
  CASE l_returnflag WHEN 'R' THEN 'failed' ELSE 'error' END, l_linestatus) AS t FROM lineitem WHERE l_returnflag <> 'N' AND l_orderkey % 10 <> 0 GROUP BY 1)
SELECT o.l_orderkey, coalesce(bad.t, 'raw output') AS excerpt FROM (SELECT DISTINCT l_orderkey FROM lineitem) o LEFT JOIN bad ON bad.l_orderkey = o.l_orderkey""")
def failure_text(spark, d):
    runs = _test_report(spark, d).withColumn("stdout", F.lit("raw output"))
    return runs.select("l_orderkey", reports.failure_excerpt("report", "stdout").alias("excerpt"))


# Where a test of a line crashed: inside a package, under either path style, in test tooling, or in the own sources.
CRASH = """CASE l_suppkey % 5 WHEN 0 THEN '/v/site-packages/lib' || (l_suppkey % 7) || '/core/__init__.py' WHEN 1 THEN 'C:' || chr(92) || 'site-packages' || chr(92) || 'net' || chr(92) || 'p' || (l_suppkey % 3) || '.py'
  WHEN 2 THEN '/v/dist-packages/pluggy/hooks.py' WHEN 3 THEN '/repo/src/own.py' ELSE '/v/dist-packages/lib' || (l_suppkey % 7) || '.py' END"""
MODULE = """CASE l_suppkey % 5 WHEN 0 THEN 'lib' || (l_suppkey % 7) || '.core' WHEN 1 THEN 'net.p' || (l_suppkey % 3) WHEN 4 THEN 'lib' || (l_suppkey % 7) END"""
MESSAGE = """CASE l_linenumber % 3 WHEN 0 THEN 'lib.Oops: no' || chr(10) || 'Second: line' WHEN 1 THEN 'not an exception: x' ELSE 'ValueError' END"""


@query(f"""WITH t AS (SELECT l_orderkey, l_linenumber, l_suppkey, {MODULE} AS module, CASE l_linenumber % 3 WHEN 0 THEN 'lib.Oops' WHEN 2 THEN 'ValueError' END AS exception FROM lineitem
  WHERE l_returnflag <> 'N'),
hit AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey) AS rn FROM t WHERE module IS NOT NULL AND exception IS NOT NULL)
SELECT o.l_orderkey, h.module, string_split(h.module, '.')[1] AS package, h.exception FROM (SELECT DISTINCT l_orderkey FROM lineitem) o LEFT JOIN hit h ON h.l_orderkey = o.l_orderkey AND h.rn = 1""")
def failure_signature(spark, d):
    crash = F.struct(F.struct(F.expr(CRASH.replace("chr(92)", "char(92)")).alias("path"), F.expr(MESSAGE).alias("message")).alias("crash"))
    outcome = F.when(F.col("l_returnflag") == "N", "passed").when(F.col("l_returnflag") == "R", "failed").otherwise("error")
    # Tests of odd lines crash when they are called, the others when they are set up.
    called = F.col("l_linenumber") % 2 == 1
    one = F.struct("l_linenumber", "l_suppkey", outcome.alias("outcome"), F.when(called, crash).alias("call"), F.when(~called, crash).alias("setup"))
    runs = b.table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.to_json(F.struct(F.array_sort(F.collect_list(one)).alias("tests"))).alias("report"))
    return runs.select("l_orderkey", reports.failure_signature("report").alias("s")).select("l_orderkey", "s.*")


# ----------------------------------------------------- diffs and names in text --

# One reply an order: a hunk of its lines. Some have no closing mark, some two blocks, some a header that counts wrong.
HUNK_LINES = """changed AS (SELECT l_orderkey AS o, l_linenumber AS n, l_suppkey AS s, CASE min(l_returnflag) WHEN 'N' THEN ' ' WHEN 'R' THEN '-' ELSE '+' END AS op,
  CASE WHEN l_suppkey % 5 = 0 THEN '-- S' ELSE 'S' END || l_suppkey AS text FROM lineitem GROUP BY 1, 2, 3),
placed AS (SELECT *, row_number() OVER w AS rn, count(*) FILTER (WHERE op <> '+') OVER w AS olds, count(*) FILTER (WHERE op <> '-') OVER w AS news FROM changed WINDOW w AS (PARTITION BY o ORDER BY n, s)),
reply AS (SELECT o, arg_max(op, rn) AS last_op FROM placed GROUP BY 1),
verdict AS (SELECT o, CASE WHEN o % 7 = 0 THEN 'no diff block' WHEN o % 11 = 0 THEN 'more than one diff block' WHEN o % 5 = 0 AND last_op <> ' ' THEN 'hunk shorter or longer than its header' END AS reason FROM reply)"""


def _replies(spark, d):
    op = F.when(F.min("l_returnflag") == "N", " ").when(F.min("l_returnflag") == "R", "-").otherwise("+")
    text = F.concat(F.when(F.col("l_suppkey") % 5 == 0, "-- S").otherwise("S"), F.col("l_suppkey").cast("string"))
    lines = b.table(spark, d, "lineitem")
    lines = dealt(lines.select(F.col("l_orderkey").alias("o"), "l_linenumber", "l_suppkey", "l_returnflag"), ["o"], lines.count())
    changed = lines.groupBy("o", "l_linenumber", "l_suppkey").agg(op.alias("op")).withColumn("text", text)
    whole = changed.groupBy("o").agg(
        F.count_if(F.col("op") != "+").alias("olds"), F.count_if(F.col("op") != "-").alias("news"),
        F.array_sort(F.collect_list(F.struct("l_linenumber", "l_suppkey", F.concat("op", "text").alias("t")))).alias("lines"),
    )
    path = F.concat(F.lit("src/o"), F.col("o").cast("string"), F.lit(".py"))
    said = F.col("olds") + F.when(F.col("o") % 5 == 0, 1).otherwise(0)
    # Every third file is deleted.
    after = F.when(F.col("o") % 3 == 0, F.lit("/dev/null")).otherwise(F.concat(F.lit("b/"), path))
    head = F.format_string("--- a/%s\n+++ %s\n@@ -10,%d +20,%d @@\n", path, after, said, F.col("news"))
    block = F.concat(F.lit("<<<DIFF\n"), head, F.array_join(F.transform("lines", lambda x: x["t"]), "\n"), F.lit("\n"), F.when(F.col("o") % 7 == 0, "").otherwise("DIFF>>>\n"))
    return whole.select("o", F.concat(F.lit("Here it is.\n"), block, F.when(F.col("o") % 11 == 0, block).otherwise("")).alias("text"))


@query(f"""WITH {HUNK_LINES} SELECT o, CASE WHEN reason IS NULL THEN 'ok' ELSE 'unparseable' END AS verdict, reason,
  CASE WHEN o % 7 <> 0 AND o % 11 <> 0 THEN 'src/o' || o || '.py' END AS paths FROM verdict""")
def diff_verdicts(spark, d):
    return diffs.read_diffs(_replies(spark, d), "o")[0].withColumn("paths", F.array_join("paths", ","))


@query(f"""WITH {HUNK_LINES} SELECT p.o, 1 AS hunk_id, 2 + rn AS pos, 'src/o' || p.o || '.py' AS path, op, text,
  CASE WHEN op <> '+' THEN 9 + olds END AS old_no, CASE WHEN op <> '-' THEN 19 + news END AS new_no FROM placed p JOIN verdict v ON v.o = p.o WHERE v.reason IS NULL""")
def diff_lines(spark, d):
    return diffs.read_diffs(_replies(spark, d), "o")[1]


@query("""WITH code AS (SELECT 'src/o' || l_orderkey || '.py' AS path, l_linenumber AS n, l_suppkey AS s, min(l_returnflag) AS flag FROM lineitem WHERE l_orderkey % 20 <> 0 GROUP BY 1, 2, 3),
imp AS (SELECT path, s % 4 AS head, arg_max(CASE WHEN s % 3 < 2 THEN 'lib.m' || (s % 5) ELSE 'h' || (s % 4) END, n * 1000000 + s) AS bound FROM code WHERE flag = 'A' AND s % 17 <> 0 GROUP BY 1, 2),
look AS (SELECT c.path, n AS line, CASE WHEN n % 2 = 0 THEN 'f' || (s % 6) END AS name, bound || CASE WHEN s % 8 >= 4 THEN '.sub' ELSE '' END AS module
  FROM code c JOIN imp i ON i.path = c.path AND i.head = s % 4 WHERE flag = 'R'),
removed AS (SELECT DISTINCT 'lib.m' || (s_suppkey % 5) || CASE WHEN s_suppkey % 2 = 1 THEN '.sub' ELSE '' END AS module, 'f' || (s_suppkey % 4) AS name FROM supplier),
strong AS (SELECT DISTINCT l.path, l.line, l.name, l.module FROM look l JOIN removed r ON r.module = l.module AND r.name = l.name),
medium AS (SELECT DISTINCT c.path, c.n AS line, r.name, r.module FROM code c JOIN removed r ON r.name = 'f' || (c.s % 6) JOIN look k ON k.path = c.path AND k.module = r.module AND k.name IS NULL WHERE c.flag = 'N')
SELECT *, 'strong' AS strength FROM strong UNION ALL SELECT *, 'medium' FROM (SELECT * FROM medium EXCEPT SELECT * FROM strong)""")
def stale_references(spark, d):
    # Lines that were added import, those that were removed look a name up, the others hold it as a string. Tests do not count.
    s, n, flag = F.col("l_suppkey"), F.col("l_linenumber"), F.col("flag")
    lines = b.table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber", "l_suppkey").agg(F.min("l_returnflag").alias("flag"))
    head, word, lib = b.tag("h", s % 4), b.tag("f", s % 6), b.tag("m", s % 5)
    facts = lines.select(
        b.graph(), F.concat(F.when(F.col("l_orderkey") % 20 == 0, "src/tests/o").otherwise("src/o"), F.col("l_orderkey").cast("string"), F.lit(".py")).alias("path"),
        n.alias("line"), (n * 1000000 + s).alias("ord"), F.when(flag == "A", "import").when(flag == "R", "lookup").otherwise("literal").alias("fact"),
        F.when(flag == "A", head).when((flag == "R") & (n % 2 == 1), F.lit(None)).otherwise(word).alias("name"),
        F.when(s % 3 == 0, "member").when(s % 3 == 1, "renamed").otherwise("plain").alias("kind"),
        F.concat(F.when(s % 17 == 0, ".").otherwise(""), F.when(s % 3 == 0, F.lit("lib")).when(s % 3 == 1, F.concat(F.lit("lib."), lib)).otherwise(head)).alias("module"),
        F.when(s % 3 == 0, lib).alias("symbol"), F.concat(head, F.when(s % 8 >= 4, ".sub").otherwise("")).alias("receiver"),
    )
    gone = b.table(spark, d, "supplier").select(
        b.graph(), F.concat(b.tag("lib.m", F.col("s_suppkey") % 5), F.when(F.col("s_suppkey") % 2 == 1, ".sub").otherwise("")).alias("module"), b.tag("f", F.col("s_suppkey") % 4).alias("name")
    ).distinct()
    return interface.stale_references(facts, gone).drop("graph_id")


# ------------------------------------------------------------------ replies --

TRIMMED = rf"regexp_replace(regexp_replace(text, '^{tx.SPACE}', ''), '{tx.SPACE}$', '')"


@query(f"""SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'import_error' ELSE 'other' END AS kind, {TRIMMED} || chr(10) AS block, CASE WHEN turn % 3 = 0 THEN {TRIMMED} ELSE {TRIMMED} || ' tail' END AS reply FROM conversations""")
def mined_replies(spark, d):
    said = b.table(spark, d, "conversations")
    kind = F.when(F.col("turn") % 2 == 0, "Kind: Import_Error\n").otherwise("KIND: nothing known\n")
    fenced = F.concat(kind, F.lit("```\nx\n```\nand\n```python\n"), F.col("text"), F.lit("\n```\n"))
    whole = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("```text\n"), F.col("text"), F.lit("\n```"))).otherwise(F.concat(F.lit("\n"), F.regexp_replace("text", f"^{tx.SPACE}|{tx.SPACE}$", ""), F.lit(" tail")))
    return said.select("conv_id", "turn", tx.declared_kind(fenced).alias("kind"), tx.longest_block(fenced).alias("block"), tx.strip_fence(whole).alias("reply"))


# -------------------------------------------------------------------- trees --


@query("""WITH f AS (SELECT 'src/' || source || '/' || lang || '.txt' AS path, doc_id FROM documents)
SELECT 'src/src3/en.txt' AS prefix, 'd' || doc_id AS name, 'symbol' AS kind, 1 AS line_start, doc_id AS line_end FROM f WHERE path = 'src/src3/en.txt'""")
def tree_of_file(spark, d):
    path = F.concat(F.lit("src/"), F.col("source"), F.lit("/"), F.col("lang"), F.lit(".txt"))
    docs = b.documents(spark, d)
    symbols = docs.select(b.graph(), path.alias("path"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("fqn"), F.lit(1).alias("line_start"), F.col("doc_id").alias("line_end"))
    files = docs.select(b.graph(), path.alias("path")).distinct()
    return trees.tree_level(files, "src/src3/en.txt", symbols=symbols).select("prefix", "name", "kind", "line_start", "line_end")


# --------------------------------------------------------------- interfaces --


@query(f"""WITH change AS ({ORACLES["schema_break"]}), usage AS (SELECT DISTINCT l_orderkey AS symbol, l_suppkey FROM lineitem),
per AS (SELECT symbol, count(*) AS consumers, count_if(s_acctbal IS NULL OR s_acctbal <= 0) AS untouched FROM usage LEFT JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1)
SELECT c.symbol, c.breaking, coalesce(p.consumers, 0) AS consumers, coalesce(p.untouched, 0) AS untouched, c.breaking AND coalesce(p.untouched, 0) > 0 AS warn FROM change c LEFT JOIN per p ON p.symbol = c.symbol""")
def interface_users(spark, d):
    keys = ["graph_id", "symbol"]
    consumers = b.table(spark, d, "lineitem").select(b.graph(), F.col("l_orderkey").alias("symbol"), b.tag("s", "l_suppkey").alias("consumer"))
    touched = b.table(spark, d, "supplier").filter(F.col("s_acctbal") > 0).select(b.graph(), b.tag("s", "s_suppkey").alias("path"))
    changes = interface.interface_changes(params_of(spark, d, "before"), params_of(spark, d, "after"), consumers, touched, keys)
    return changes.filter(F.col("before").isNotNull() & F.col("after").isNotNull()).select("symbol", "breaking", "consumers", "untouched", "warn")


@query(f"""WITH {PARAMS}, change AS ({ORACLES["schema_break"]}), t AS (SELECT o_orderkey AS symbol, CASE o_orderpriority WHEN '3-MEDIUM' THEN 'class' WHEN '2-HIGH' THEN 'method' ELSE 'function' END AS kind, o_custkey % 50 AS file,
  o_custkey % 7 = 0 AS script, EXISTS (SELECT 1 FROM bp WHERE bp.o = o_orderkey) AS old, EXISTS (SELECT 1 FROM ap WHERE ap.o = o_orderkey) AS new FROM orders)
SELECT t.symbol, CASE WHEN kind = 'class' THEN 'unchecked kind' WHEN script THEN 'unchecked language' WHEN NOT old OR (file < 30 AND file % 5 = 4) THEN 'uncheckable'
  WHEN NOT new AND t.symbol % 2 = 0 THEN 'aliased' WHEN NOT new THEN 'removed' WHEN c.symbol IS NULL THEN 'unchanged' WHEN c.breaking THEN 'changed, breaking' ELSE 'changed' END AS status,
  CASE WHEN kind = 'class' OR script THEN 'warn' WHEN NOT old OR (file < 30 AND file % 5 = 4) THEN 'block' END AS severity FROM t LEFT JOIN change c ON c.symbol = t.symbol""")
def target_sides(spark, d):
    file = F.col("o_custkey") % 50
    path = F.concat(F.lit("f"), file.cast("string"), F.when(F.col("o_custkey") % 7 == 0, ".ts").otherwise(".py"))
    kind = F.when(F.col("o_orderpriority") == "3-MEDIUM", "class").when(F.col("o_orderpriority") == "2-HIGH", "method").otherwise("function")
    targets = b.table(spark, d, "orders").select(b.graph(), F.col("o_orderkey").alias("symbol"), kind.alias("kind"), path.alias("path"), file.alias("file"))
    parsed, touched = targets.filter(F.col("file") % 5 != 4), targets.filter(F.col("file") < 30)
    named = targets.filter(F.col("symbol") % 2 == 0)
    return interface.target_sides(
        targets.drop("file"), params_of(spark, d, "before"), params_of(spark, d, "after"), parsed, named, touched, ["graph_id", "symbol"]
    ).select("symbol", "status", "severity")


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN NULL WHEN s_suppkey % 4 = 1 THEN s_nationkey || '.2' ELSE CAST(s_nationkey AS VARCHAR) END AS version FROM supplier""")
def script_versions(spark, d):
    key, nation = F.col("s_suppkey"), F.col("s_nationkey").cast("string")
    name = b.tag("pkg", "s_suppkey")
    none = F.create_map().cast("map<string,string>")
    first = F.when(key % 4 == 1, F.create_map(name, F.concat(F.lit("^"), nation, F.lit(".2")))).otherwise(none)
    dev = F.when(key % 4 > 0, F.create_map(name, F.concat(F.lit("~"), nation))).otherwise(none)
    peer = F.when(key % 4 == 0, F.create_map(name, F.lit("*"))).otherwise(none)
    rows = b.table(spark, d, "supplier").select(name.alias("graph_id"), name.alias("package"), "s_suppkey", F.to_json(F.struct(first.alias("dependencies"), dev.alias("devDependencies"), peer.alias("peerDependencies"))).alias("text"))
    return edges.script_versions(rows.select("graph_id", "text"), rows.select("graph_id", "package", "s_suppkey")).select("s_suppkey", "version")


@query("SELECT l_orderkey, 's' || l_suppkey AS key, l_linenumber AS exit_code FROM lineitem WHERE l_returnflag <> 'A'")
def exit_codes(spark, d):
    said = F.when(F.col("l_returnflag") == "A", F.lit("step took 3 s")).otherwise(F.concat(F.lit(" s"), F.col("l_suppkey").cast("string"), F.lit("\t"), F.col("l_linenumber").cast("string"), F.lit(" ")))
    per = b.table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.collect_list(said), "\n").alias("text"))
    return reports.exit_lines(per)


# -------------------------------------------------------------- resolution --


@query("""WITH own AS (SELECT 'b' || p_brand AS path, p_name AS name, 'p' || max(p_partkey) AS fqn FROM part GROUP BY ALL),
imp AS (SELECT 'b' || p_brand AS path, p_name AS name, arg_max('x' || p_partkey, p_partkey) AS fqn FROM part WHERE p_size > 45 GROUP BY ALL)
SELECT own.path, own.name, coalesce(imp.fqn, own.fqn) AS fqn FROM own LEFT JOIN imp ON imp.path = own.path AND imp.name = own.name""")
def bindings_of_files(spark, d):
    part = b.table(spark, d, "part").withColumn("path", F.concat(F.lit("b"), F.col("p_brand")))
    symbols = part.select(b.graph(), "path", F.col("p_name").alias("name"), b.tag("p", "p_partkey").alias("fqn"), F.col("p_partkey").alias("line_start"), F.lit(None).cast("string").alias("parent"))
    imported = part.filter(F.col("p_size") > 45).select(
        b.graph(), "path", F.col("p_name").alias("local_name"), b.tag("x", "p_partkey").alias("resolved_symbol"), F.col("p_partkey").alias("ord")
    )
    return resolve.local_bindings(symbols, imported).select("path", "name", "fqn")


@query("""WITH sym AS (SELECT p_brand AS path, p_name AS name, 'p' || max(p_partkey) AS fqn FROM part GROUP BY ALL)
SELECT l_orderkey, l_linenumber, l_suppkey, sym.fqn AS caller FROM lineitem JOIN part ON p_partkey = l_partkey LEFT JOIN sym ON sym.path = p_brand AND sym.name = CASE WHEN l_returnflag = 'A' THEN NULL ELSE p_name END""")
def callers_attached(spark, d):
    part = b.table(spark, d, "part")
    index = part.groupBy("p_brand", "p_name").agg(F.max("p_partkey").alias("k")).select(b.graph(), F.col("p_brand").alias("path"), F.col("p_name").alias("name"), b.tag("p", "k").alias("fqn"))
    calls = b.table(spark, d, "lineitem").join(part, F.col("p_partkey") == F.col("l_partkey")).select(
        b.graph(), F.col("p_brand").alias("path"), F.when(F.col("l_returnflag") != "A", F.col("p_name")).alias("enclosing"), "l_orderkey", "l_linenumber", "l_suppkey"
    )
    return resolve.attach_caller(calls, index).select("l_orderkey", "l_linenumber", "l_suppkey", "caller")


@query("""SELECT DISTINCT 't' || o_custkey AS test_path, 'p' || l_partkey AS symbol, 't' || o_custkey AS nodeid FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey
WHERE c_acctbal > 0""")
def import_tests(spark, d):
    lines = b.table(spark, d, "lineitem").join(b.table(spark, d, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    bindings = lines.select(b.graph(), b.tag("t", "o_custkey").alias("path"), b.tag("p", "l_partkey").alias("fqn")).distinct()
    files = b.table(spark, d, "customer").select(b.graph(), b.tag("t", "c_custkey").alias("path"), (F.col("c_acctbal") > 0).alias("is_test"))
    symbols = b.table(spark, d, "part").select(b.graph(), b.tag("p", "p_partkey").alias("fqn"), F.col("p_brand").alias("path"))
    return edges.import_test_edges(bindings, files, symbols).select("test_path", "symbol", "nodeid")
