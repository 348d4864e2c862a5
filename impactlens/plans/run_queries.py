"""Run records, scores, outcomes and checks on the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from impactlens.functions import codes
from impactlens.operators import checks, cleanup, interface, ledger as led, outcome as out, score, timeline
from impactlens.operators import radius as rad
from impactlens.plans import bindings as b
from impactlens.plans.registry import ORACLES, query
from impactlens.plans.skew import dealt
from impactlens.session import materialise
from impactlens.sources.events import events_since

# --------------------------------------------------------------- predicates --

TOUCHED = """
touched AS (
  SELECT DISTINCT 'o' || l_orderkey AS diff_id, CASE WHEN l_suppkey % 10 = 7 THEN 'tests/' WHEN l_suppkey % 10 = 8 THEN '../' ELSE 'src/' END
    || CASE WHEN l_suppkey % 10 = 9 THEN 'setup.py' ELSE 's' || l_suppkey || '.py' END AS path FROM lineitem WHERE l_returnflag <> 'N'
), target AS (SELECT 'o' || o_orderkey AS diff_id, 'src/s' || l.s || '.py' AS target_file FROM orders LEFT JOIN (SELECT l_orderkey, min(l_suppkey) AS s FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1) l ON l_orderkey = o_orderkey)"""


def _touched(spark, d):
    lines = b.table(spark, d, "lineitem").filter(F.col("l_returnflag") != "N")
    digit = F.col("l_suppkey") % 10
    folder = F.when(digit == 7, "tests/").when(digit == 8, "../").otherwise("src/")
    file = F.when(digit == 9, "setup.py").otherwise(F.concat(b.tag("s", "l_suppkey"), F.lit(".py")))
    return lines.select(F.lit("j").alias("job_id"), b.tag("o", "l_orderkey").alias("diff_id"), F.concat(folder, file).alias("path")).distinct()


@query(f"""WITH {TOUCHED}, flag AS (
  SELECT t.diff_id, bool_or(list_contains(string_split(p.path, '/'), '..')) AS traversal, bool_or(p.path <> t.target_file) AS elsewhere, count(p.path) AS paths,
    bool_or(p.path LIKE 'tests/%') AS test, bool_or(p.path LIKE '%setup.py') AS manifest, bool_or(r.path IS NULL) AS outside
  FROM target t LEFT JOIN touched p ON p.diff_id = t.diff_id
  LEFT JOIN (SELECT 'src/s' || s_suppkey || '.py' AS path FROM supplier WHERE s_acctbal > 5000) r ON r.path = p.path GROUP BY t.diff_id)
SELECT diff_id, CASE WHEN traversal THEN 'path traversal' WHEN elsewhere THEN 'outside task file' WHEN paths = 0 THEN 'no files' WHEN test THEN 'test file'
  WHEN manifest THEN 'manifest' WHEN outside THEN 'outside radius' ELSE 'ok' END AS rule FROM flag""")
def scope_verdict(spark, d):
    first = b.table(spark, d, "lineitem").filter(F.col("l_returnflag") != "N").groupBy("l_orderkey").agg(F.min("l_suppkey").alias("s"))
    tasks = b.table(spark, d, "orders").join(first, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(
        F.lit("j").alias("job_id"), b.tag("o", "o_orderkey").alias("diff_id"), F.concat(b.tag("src/s", "s"), F.lit(".py")).alias("target_file")
    )
    radius = b.table(spark, d, "supplier").filter(F.col("s_acctbal") > 5000).select(
        F.lit("j").alias("job_id"), F.concat(b.tag("src/s", "s_suppkey"), F.lit(".py")).alias("path")
    )
    return checks.scope_check(tasks, _touched(spark, d), radius).select("diff_id", "rule")


RUN = """
run AS (SELECT event_id, CASE event_type WHEN 'error' THEN 1 WHEN 'purchase' THEN 124 WHEN 'signup' THEN 90 ELSE 0 END AS code,
  CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, value, event_type FROM events),
verdict AS (SELECT event_id, event_type, CASE WHEN code = 90 THEN 'syntax' WHEN value < 2 OR (k < 40 AND code = 124) THEN 'infrastructure'
  WHEN code = 0 AND k % 5 <> 0 THEN 'ok' ELSE 'red' END AS verdict FROM run)"""


def _verdicts(spark, d):
    code = F.when(F.col("kind") == "error", 1).when(F.col("kind") == "purchase", 124).when(F.col("kind") == "signup", 90).otherwise(0)
    rows = b.event(spark, d).select("seq", "kind", "value", code.alias("code"), F.get_json_object("payload", "$.k").cast("int").alias("k"))
    failed = (F.col("k") % 5 == 0).cast("int")
    verdict = codes.run_verdict("code", failed, F.lit(0), F.col("k") >= 40, F.col("value") < 2)
    return rows.withColumn("verdict", verdict)


@query(f"WITH {RUN} SELECT event_id, verdict FROM verdict")
def run_verdict(spark, d):
    return _verdicts(spark, d).select(F.col("seq").alias("event_id"), "verdict")


@query(f"WITH {RUN} SELECT event_type AS kind, count_if(verdict = 'ok') AS passed, count_if(verdict = 'red') AS failed, count_if(verdict = 'infrastructure') AS inconclusive FROM verdict GROUP BY 1")
def run_summary(spark, d):
    v = F.col("verdict")
    return _verdicts(spark, d).groupBy("kind").agg(
        F.count_if(v == "ok").alias("passed"), F.count_if(v == "red").alias("failed"), F.count_if(v == "infrastructure").alias("inconclusive")
    )


RETRY = ", ".join(f"'{c}'" for c in codes.RETRYABLE)
INFRA = ", ".join(f"'{c}'" for c in codes.INFRASTRUCTURE)
CODE_SQL = "CASE event_type WHEN 'error' THEN 'GATE_TESTS_RED' WHEN 'click' THEN 'SANDBOX_TIMEOUT' WHEN 'view' THEN 'SANDBOX_FORBIDDEN' WHEN 'signup' THEN 'GATE_SCOPE' ELSE 'SOMETHING_NEW' END"


def _code():
    k = F.col("kind")
    return (
        F.when(k == "error", "GATE_TESTS_RED").when(k == "click", "SANDBOX_TIMEOUT").when(k == "view", "SANDBOX_FORBIDDEN")
        .when(k == "signup", "GATE_SCOPE").otherwise("SOMETHING_NEW")
    )


@query(f"""WITH c AS (SELECT {CODE_SQL} AS code FROM events)
SELECT code, code IN ({RETRY}) AS retryable, code IN ({INFRA}) AS infrastructure, code <> 'SOMETHING_NEW' AS known, count(*) AS n FROM c GROUP BY code""")
def error_class(spark, d):
    rows = b.event(spark, d).withColumn("code", _code())
    return rows.groupBy("code").agg(F.count(F.lit(1)).alias("n")).select(
        "code", codes.is_retryable("code").alias("retryable"), codes.is_infrastructure("code").alias("infrastructure"),
        codes.is_known("code").alias("known"), "n",
    )


@query("""WITH e AS (SELECT CAST(user_id AS VARCHAR) AS job_id, event_id AS seq, event_type, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)
SELECT job_id, min(seq) AS seq FROM e WHERE (event_type = 'error' AND k > 95) OR (event_type = 'purchase' AND k > 90) GROUP BY job_id""")
def terminal_events(spark, d):
    k = F.get_json_object("payload", "$.k").cast("int")
    kind = F.when((F.col("kind") == "error") & (k > 95), "job.stopped").when(F.col("kind") == "purchase", "job.state").otherwise(F.col("kind"))
    state = F.when(k > 97, "NoPR").when(k > 90, "Done").otherwise("Executing")
    events = b.event(spark, d).select("job_id", "seq", kind.alias("kind"), F.to_json(F.struct(state.alias("state"))).alias("payload"))
    return timeline.terminal_events(events)


@query("""SELECT 'o' || o_orderkey AS attempt_id, o_orderpriority AS kind FROM orders WHERE o_totalprice > 100000 AND o_orderstatus = 'P'""")
def open_attempts(spark, d):
    attempts = b.table(spark, d, "orders").select(
        b.tag("o", "o_orderkey").alias("attempt_id"), F.col("o_orderpriority").alias("kind"),
        F.when(F.col("o_totalprice") > 100000, F.col("o_custkey")).alias("operation_id"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("verdict"),
    )
    return led.live_operations(attempts).select("attempt_id", "kind")


# ------------------------------------------------------------------- checks --

NATIONS = """
pair AS (SELECT DISTINCT 'c' || o_custkey AS job_id, 'nation/' || s_nationkey AS path, l_returnflag AS flag
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey)"""


def _pairs(spark, d):
    lines, orders, supplier = (b.table(spark, d, t) for t in ("lineitem", "orders", "supplier"))
    return (
        lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .select(b.tag("c", "o_custkey").alias("job_id"), b.tag("nation/", "s_nationkey").alias("path"), F.col("l_returnflag").alias("flag"))
        .distinct()
    )


@query(f"""WITH {NATIONS}, e AS (SELECT DISTINCT job_id, path FROM pair WHERE flag = 'N'), a AS (SELECT DISTINCT job_id, path FROM pair WHERE flag = 'R')
SELECT *, 'unexpected' AS side FROM (SELECT * FROM a EXCEPT SELECT * FROM e) UNION ALL SELECT *, 'untouched' FROM (SELECT * FROM e EXCEPT SELECT * FROM a)""")
def scope_diff(spark, d):
    pairs = _pairs(spark, d)
    return checks.scope_diff(pairs.filter(F.col("flag") == "N"), pairs.filter(F.col("flag") == "R"), ["job_id", "path"])


@query(f"""WITH {NATIONS} SELECT job_id, path FROM pair WHERE flag = 'R' INTERSECT SELECT job_id, path FROM pair WHERE flag = 'A'""")
def set_intersect(spark, d):
    pairs = _pairs(spark, d)

    def side(flag):
        return pairs.filter(F.col("flag") == flag).select("job_id", "path")

    return side("R").intersect(side("A"))


@query("""WITH f AS (SELECT DISTINCT 'o' || l_orderkey AS job_id, 'src/S' || l_suppkey || '.py' AS path, l_returnflag AS flag FROM lineitem),
call AS (SELECT DISTINCT job_id, path FROM f), planned AS (SELECT DISTINCT job_id, path FROM f WHERE flag = 'A'), gone AS (SELECT DISTINCT job_id, path FROM f WHERE flag = 'R'),
note AS (SELECT job_id, lower(string_agg('Left ' || replace(path, 'src/', '') || ' alone', ' ')) AS notes FROM f WHERE flag = 'N' GROUP BY job_id),
open AS (SELECT c.* FROM call c ANTI JOIN planned p ON c.job_id = p.job_id AND c.path = p.path),
told AS (SELECT o.*, coalesce(contains(notes, lower(replace(path, 'src/', ''))), false) AS told FROM open o LEFT JOIN note n ON n.job_id = o.job_id)
SELECT job_id, path, CASE WHEN told THEN 'call_site_declined' ELSE 'incomplete_plan' END AS kind, CASE WHEN told THEN 'info' ELSE 'block' END AS severity FROM told
UNION ALL SELECT g.job_id, g.path, 'unmigrated_call_site', 'warn' FROM gone g""")
def plan_gaps(spark, d):
    rows = b.table(spark, d, "lineitem").select(
        b.tag("o", "l_orderkey").alias("job_id"), F.concat(b.tag("src/S", "l_suppkey"), F.lit(".py")).alias("path"), F.col("l_returnflag").alias("flag")
    ).distinct()
    base = F.element_at(F.split("path", "/"), -1)
    notes = rows.filter(F.col("flag") == "N").select("job_id", F.concat(F.lit("Left "), base, F.lit(" alone")).alias("note"))
    return checks.plan_gaps(rows, rows.filter(F.col("flag") == "A"), notes, rows.filter(F.col("flag") == "R"))


@query("""WITH l AS (SELECT p_brand AS g, l_partkey AS path, l_linenumber AS line, l_returnflag AS flag, l_linestatus AS st, p_size FROM lineitem JOIN part ON l_partkey = p_partkey),
cov AS (SELECT g, path, line, bool_or(st = 'F') AS executed FROM l WHERE g NOT IN ('Brand#3', 'Brand#4') AND flag <> 'A' GROUP BY 1, 2, 3),
site AS (SELECT DISTINCT g, path, line FROM l WHERE flag = 'R')
SELECT s.g AS graph_id, s.path, s.line, CASE WHEN s.g IN (SELECT g FROM cov) THEN coalesce(c.executed, false) END AS exercised
FROM site s LEFT JOIN cov c ON c.g = s.g AND c.path = s.path AND c.line = s.line""")
def exercised(spark, d):
    rows = b.table(spark, d, "lineitem").join(b.table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("p_brand").alias("graph_id"), F.col("l_partkey").alias("path"), F.col("l_linenumber").alias("line"),
        F.col("l_returnflag").alias("flag"), (F.col("l_linestatus") == "F").alias("executed"), F.lit("x").alias("name"),
    )
    coverage = rows.filter(~F.col("graph_id").isin("Brand#3", "Brand#4") & (F.col("flag") != "A"))
    return checks.dynamic_paths_exercised(rows.filter(F.col("flag") == "R"), coverage).drop("name")


PARAMS = """
param AS (SELECT l_orderkey AS o, 's' || l_suppkey AS name, min(l_linenumber) AS n, bool_or(l_tax < 0.02) AS required, bool_or(l_discount > 0.08) AS kw,
    bool_or(l_returnflag <> 'R') AS b, bool_or(l_returnflag <> 'A') AS a FROM lineitem GROUP BY 1, 2),
bp AS (SELECT o, name, required, CASE WHEN NOT kw THEN row_number() OVER (PARTITION BY o, kw ORDER BY n, name) - 1 END AS pos FROM param WHERE b),
ap AS (SELECT o, name, required, CASE WHEN NOT kw THEN row_number() OVER (PARTITION BY o, kw ORDER BY n, name) - 1 END AS pos, row_number() OVER (PARTITION BY o, kw ORDER BY n, name) - 1 AS ord FROM param WHERE a),
star AS (SELECT o_orderkey AS o, o_orderpriority = '5-LOW' AS vararg, o_orderpriority = '1-URGENT' AS kwarg FROM orders)"""


def params_of(spark, d, side: str):
    lines = b.table(spark, d, "lineitem").groupBy("l_orderkey", b.tag("s", "l_suppkey").alias("name")).agg(
        F.min("l_linenumber").alias("n"), F.bool_or(F.col("l_tax") < 0.02).alias("required"),
        F.bool_or(F.col("l_discount") > 0.08).alias("kw"), F.bool_or(F.col("l_returnflag") != ("R" if side == "before" else "A")).alias("here"),
    ).filter("here")
    at = F.row_number().over(W.partitionBy("l_orderkey", "kw").orderBy("n", "name")) - 1
    named = lines.select(
        b.graph(), F.col("l_orderkey").alias("symbol"), F.when(F.col("kw"), "kwonly").otherwise("plain").alias("kind"), "name",
        at.alias("position"), "required", F.lit(None).cast("string").alias("signature"),
    )
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("kw", "n", "name", "required"))), lambda s: F.to_json(s)), ",")
    heads = lines.groupBy("l_orderkey").agg(text.alias("signature")).select(
        b.graph(), F.col("l_orderkey").alias("symbol"), F.lit("header").alias("kind"), F.lit(None).cast("string").alias("name"),
        F.lit(-1).alias("position"), F.lit(None).cast("boolean").alias("required"), "signature",
    )
    orders = b.table(spark, d, "orders")

    def star(kind, priority):
        return orders.filter(F.col("o_orderpriority") == priority).select(
            b.graph(), F.col("o_orderkey").alias("symbol"), F.lit(kind).alias("kind"), F.lit("rest").alias("name"),
            F.lit(None).cast("int").alias("position"), F.lit(None).cast("boolean").alias("required"), F.lit(None).cast("string").alias("signature"),
        )

    return materialise(named.unionByName(heads).unionByName(star("vararg", "5-LOW")).unionByName(star("kwarg", "1-URGENT")))


@query(f"""WITH {PARAMS},
names AS (SELECT coalesce(bp.o, ap.o) AS o, bool_or(ap.name IS NULL) AS lost, bool_or(bp.name IS NULL AND ap.required) AS fresh, bool_or(bp.pos <> ap.pos) AS moved,
  bool_or(bp.pos IS NOT NULL AND ap.name IS NOT NULL AND ap.pos IS NULL) AS kwonly, count(bp.pos) AS bn, count(ap.pos) AS an, count(bp.name) AS nb, count(ap.name) AS na,
  bool_or(bp.name IS NULL OR ap.name IS NULL) AS differ FROM bp FULL JOIN ap ON bp.o = ap.o AND bp.name = ap.name GROUP BY 1)
SELECT n.o AS symbol, (lost AND NOT kwarg) OR coalesce(fresh, false) OR coalesce(moved, false) OR coalesce(kwonly, false) OR (an < bn AND NOT vararg) AS breaking
FROM names n JOIN star USING (o) WHERE nb > 0 AND na > 0 AND differ""")
def schema_break(spark, d):
    key = ["graph_id", "symbol"]
    changes = interface.signature_changes(params_of(spark, d, "before"), params_of(spark, d, "after"), key)
    # A star alone is no definition: both sides need their header.
    return changes.filter(F.col("before").isNotNull() & F.col("after").isNotNull() & F.col("changed")).select("symbol", "breaking")


@query(f"""WITH {PARAMS}, call AS (SELECT o_orderkey AS o, CAST(floor(o_totalprice / 100000) AS INTEGER) AS n_pos, o_orderstatus = 'P' AS starred, o_custkey % 10 = 0 AS removed,
   CASE WHEN o_orderstatus = 'F' THEN ['s' || (o_custkey % 10)] ELSE [] END AS keywords FROM orders),
head AS (SELECT o, count(pos) AS accepts FROM ap GROUP BY o),
live AS (SELECT c.*, h.accepts, vararg, kwarg FROM call c JOIN head h USING (o) JOIN star USING (o) WHERE NOT removed AND NOT starred),
hit AS (SELECT o, 0 AS rule, 0 AS place, 'calls a name that was removed' AS reason FROM call WHERE removed
  UNION ALL SELECT o, 1, 0, n_pos || ' arguments by position, ' || accepts || ' taken' FROM live WHERE n_pos > accepts AND NOT vararg
  UNION ALL SELECT l.o, 2, 0, CASE WHEN ap.pos < n_pos THEN '''' || keywords[1] || ''' bound twice, by position and by name' ELSE 'no parameter is named ''' || keywords[1] || '''' END
    FROM live l LEFT JOIN ap ON ap.o = l.o AND ap.name = l.keywords[1] WHERE len(keywords) > 0 AND (coalesce(ap.pos < n_pos, false) OR (ap.name IS NULL AND NOT kwarg))
  UNION ALL SELECT l.o, CASE WHEN pos IS NULL THEN 4 ELSE 3 END, CASE WHEN pos IS NULL THEN ord ELSE pos END, CASE WHEN pos IS NULL THEN 'keyword-only ''' || name || ''' is not given' ELSE '''' || name || ''' is not given' END
    FROM live l JOIN ap ON ap.o = l.o WHERE required AND (pos IS NULL OR pos >= n_pos) AND NOT list_contains(keywords, name)),
first AS (SELECT o, reason FROM hit QUALIFY row_number() OVER (PARTITION BY o ORDER BY rule, place, reason) = 1)
SELECT c.o AS symbol, f.reason FROM call c LEFT JOIN first f ON f.o = c.o""")
def call_compat(spark, d):
    orders = b.table(spark, d, "orders")
    keywords = F.when(F.col("o_orderstatus") == "F", F.array(b.tag("s", F.col("o_custkey") % 10))).otherwise(F.array().cast("array<string>"))
    calls = orders.select(
        b.graph(), F.col("o_orderkey").alias("symbol"), F.col("o_orderkey").alias("call_id"), F.floor(F.col("o_totalprice") / 100000).cast("int").alias("n_pos"),
        keywords.alias("keywords"), (F.col("o_orderstatus") == "P").alias("starred"), (F.col("o_custkey") % 10 == 0).alias("removed"),
    )
    params = params_of(spark, d, "after")
    defined = params.filter(F.col("kind") == "header").select("graph_id", "symbol")
    known = params.join(defined, ["graph_id", "symbol"], "left_semi")
    return interface.call_compat(calls, known, ["graph_id", "symbol"]).select("symbol", "reason")


@query("""WITH t AS (SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'function' WHEN 'MACHINERY' THEN 'method' WHEN 'HOUSEHOLD' THEN 'function' WHEN 'AUTOMOBILE' THEN 'method' ELSE 'class' END AS kind,
  CASE WHEN c_nationkey = 3 THEN 'a.ts' ELSE 'a.py' END AS path, CASE WHEN c_acctbal > 0 THEN 'x' || (c_custkey % 4) END AS b, CASE WHEN c_nationkey > 4 THEN 'x' || (c_custkey % 3) END AS a,
  c_nationkey < 20 AS touched, c_nationkey % 5 <> 4 AS parsed, c_custkey % 2 = 0 AS named FROM customer)
SELECT c_custkey, CASE WHEN kind = 'class' THEN 'unchecked kind' WHEN path = 'a.ts' THEN 'unchecked language' WHEN b IS NULL OR (touched AND NOT parsed) THEN 'uncheckable'
  WHEN a IS NULL AND named THEN 'aliased' WHEN a IS NULL THEN 'removed' WHEN a = b THEN 'unchanged' WHEN named THEN 'changed, breaking' ELSE 'changed' END AS status,
  CASE WHEN kind = 'class' OR path = 'a.ts' THEN 'warn' WHEN b IS NULL OR (touched AND NOT parsed) THEN 'block' END AS severity FROM t""")
def target_status(spark, d):
    seg = F.col("c_mktsegment")
    even = F.col("c_custkey") % 2 == 0
    targets = b.table(spark, d, "customer").select(
        "c_custkey",
        F.when(seg.isin("BUILDING", "HOUSEHOLD"), "function").when(seg.isin("MACHINERY", "AUTOMOBILE"), "method").otherwise("class").alias("kind"),
        F.when(F.col("c_nationkey") == 3, "a.ts").otherwise("a.py").alias("path"),
        F.when(F.col("c_acctbal") > 0, b.tag("x", F.col("c_custkey") % 4)).alias("before"),
        F.when(F.col("c_nationkey") > 4, b.tag("x", F.col("c_custkey") % 3)).alias("after"),
        (F.col("c_nationkey") < 20).alias("touched"), (F.col("c_nationkey") % 5 != 4).alias("parsed_after"),
        even.alias("still_named"), even.alias("breaking"),
    )
    return interface.target_interface(targets).select("c_custkey", "status", "severity")


EXPORTS = """
exp AS (SELECT DISTINCT p_brand AS path, p_brand || '.p' || p_partkey AS fqn, 'p' || p_partkey AS name, l_returnflag AS flag FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity > 25),
decl AS (SELECT DISTINCT 'p' || p_partkey AS name FROM part WHERE p_size > 40)"""


def _exports(spark, d):
    return b.table(spark, d, "lineitem").filter(F.col("l_quantity") > 25).join(b.table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).select(
        b.graph(), F.col("p_brand").alias("path"), F.concat_ws(".", F.col("p_brand"), b.tag("p", "p_partkey")).alias("fqn"), b.tag("p", "p_partkey").alias("name"), F.col("l_returnflag").alias("flag")
    ).distinct()


def _declared(spark, d):
    return b.table(spark, d, "part").filter(F.col("p_size") > 40).select(b.graph(), b.tag("p", "p_partkey").alias("name"))


@query(f"""WITH {EXPORTS} SELECT path, fqn FROM exp WHERE flag = 'N' AND name NOT IN (SELECT name FROM decl) EXCEPT SELECT path, fqn FROM exp WHERE flag = 'R'""")
def removed_undeclared(spark, d):
    rows = _exports(spark, d)
    gone = checks.undeclared_removals(rows.filter(F.col("flag") == "N"), rows.filter(F.col("flag") == "R"), _declared(spark, d), ["graph_id"])
    return gone.select("path", "fqn")


@query(f"""WITH {EXPORTS} SELECT DISTINCT name FROM decl WHERE name IN (SELECT name FROM exp WHERE flag = 'R' AND path = 'Brand#2')""")
def moved(spark, d):
    exports = _exports(spark, d).filter((F.col("flag") == "R") & (F.col("path") == "Brand#2"))
    return checks.moved_symbols(_declared(spark, d), exports, ["graph_id"]).select("name")


@query("""WITH s AS (SELECT p_brand, p_name, 100.0 * count_if(l_returnflag = 'A') / count(*) AS b, 100.0 * count_if(l_returnflag = 'N') / count(*) AS a FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)
SELECT p_brand, p_name, round(b, 6) AS before, round(a, 6) AS after FROM s WHERE a < b AND p_brand IN (SELECT p_brand FROM part WHERE p_size = 50)""")
def coverage_drops(spark, d):
    rows = b.table(spark, d, "lineitem").join(b.table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    key = ["p_brand", "p_name"]

    def share(flag):
        return rows.groupBy(*key).agg((100.0 * F.count_if(F.col("l_returnflag") == flag) / F.count(F.lit(1))).alias("percent"))

    large = b.table(spark, d, "part").filter(F.col("p_size") == 50).select("p_brand").distinct()
    touched = rows.select(*key).distinct().join(large, "p_brand", "left_semi")
    drops = checks.coverage_drops(share("A"), share("N"), touched, key)
    return drops.select(*key, F.round("before", 6).alias("before"), F.round("after", 6).alias("after"))


@query("""WITH f AS (SELECT DISTINCT lang, source FROM documents), e AS (SELECT lang, source, count(DISTINCT doc_id) AS tests, bool_and(quality = 0) AS generated FROM documents JOIN labels USING (doc_id) WHERE quality = 1 OR toxic = 1 GROUP BY 1, 2)
SELECT f.lang AS graph_id, f.source AS path, coalesce(tests, 0) AS tests, CASE WHEN tests IS NULL THEN 'uncovered' WHEN generated THEN 'generated only' ELSE 'covered' END AS status
FROM f LEFT JOIN e ON f.lang = e.lang AND f.source = e.source""")
def coverage_gaps(spark, d):
    docs = b.table(spark, d, "documents").select(F.col("lang").alias("graph_id"), F.col("source").alias("path"), F.col("doc_id").alias("fqn"))
    labels = b.table(spark, d, "labels").filter((F.col("quality") == 1) | (F.col("toxic") == 1))
    edges = docs.join(labels, F.col("fqn") == F.col("doc_id")).select(
        "graph_id", F.col("fqn").alias("symbol"), F.col("fqn").alias("nodeid"), F.when(F.col("quality") == 1, "coverage").otherwise("characterisation").alias("source")
    )
    return cleanup.coverage_gaps(docs, docs, edges)


@query("""WITH site AS (SELECT p_brand AS g, l_partkey AS file, l_linenumber AS line, bool_or(l_returnflag = 'A') AS proved FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag <> 'N' GROUP BY 1, 2, 3),
truth AS (SELECT p_brand AS g, l_partkey AS file, l_linenumber AS line, bool_and(l_linestatus = 'F') AS static FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3),
j AS (SELECT t.g, static, CASE WHEN static THEN coalesce(proved, false) ELSE proved IS NOT NULL END AS hit FROM truth t LEFT JOIN site s ON s.g = t.g AND s.file = t.file AND s.line = t.line)
SELECT g AS graph_id, count(*) AS total, count_if(hit) AS found, round(count_if(hit) / count(*), 6) AS recall, round(coalesce(count_if(static AND hit) / nullif(count_if(static), 0), 1), 6) AS static_recall,
  round(coalesce(count_if(NOT static AND hit) / nullif(count_if(NOT static), 0), 1), 6) AS heuristic_recall FROM j GROUP BY g""")
def recall(spark, d):
    rows = b.table(spark, d, "lineitem").join(b.table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("p_brand").alias("graph_id"), F.col("l_partkey").alias("file"), F.col("l_linenumber").alias("line"), "l_returnflag", "l_linestatus"
    )
    sites = rows.filter(F.col("l_returnflag") != "N").withColumn("confidence", F.when(F.col("l_returnflag") == "A", "static").otherwise("heuristic"))
    truth = rows.groupBy("graph_id", "file", "line").agg(F.bool_and(F.col("l_linestatus") == "F").alias("static"))
    rates, _ = rad.recall(sites, truth)
    return rates.select("graph_id", "total", "found", *[F.round(c, 6).alias(c) for c in ("recall", "static_recall", "heuristic_recall")])


# ------------------------------------------------------------- event records --


@query(f"WITH {b.EVENT} SELECT job_id, kind, seq, payload FROM event QUALIFY row_number() OVER (PARTITION BY job_id, kind ORDER BY seq DESC) = 1")
def latest_per_key(spark, d):
    return out.latest_per_kind(b.event(spark, d))


@query("""WITH w AS (SELECT 'o' || l_orderkey AS job_id, l_linenumber AS seq, min(l_returnflag) AS f FROM lineitem GROUP BY 1, 2),
art AS (SELECT 'o' || l_orderkey AS job_id, l_linenumber AS seq, 'd' || l_suppkey AS path, l_shipdate, l_suppkey FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_suppkey DESC) = 1)
SELECT w.job_id, w.seq, a.path FROM w JOIN art a ON a.job_id = w.job_id AND a.seq = w.seq WHERE w.f = 'A'""")
def winning_diffs(spark, d):
    lines = b.table(spark, d, "lineitem")
    attempt = F.concat_ws("-", b.tag("o", "l_orderkey"), F.col("l_linenumber").cast("string"), F.lit("a"))
    artifacts = lines.select(
        attempt.alias("attempt_id"), F.lit("diff").alias("kind"), b.tag("d", "l_suppkey").alias("path"),
        F.col("l_shipdate").alias("created_at"), F.col("l_suppkey").alias("artifact_id"),
    )
    return score.winning_diffs(b.run_task(spark, d), artifacts).drop("attempt_id")


@query(f"""WITH {b.EVENT}, g AS (SELECT job_id, CASE kind WHEN 'view' THEN 'searched' WHEN 'click' THEN 'skipped' END AS kind, CAST(json_extract_string(payload, '$.k') AS INTEGER) < 30 AS cached FROM event WHERE kind IN ('view', 'click'))
SELECT job_id, count_if(kind = 'searched') AS searches, count_if(kind = 'skipped') AS skipped, count_if(kind = 'searched' AND NOT cached) AS provider_requests FROM g GROUP BY job_id""")
def event_split(spark, d):
    kind = F.when(F.col("kind") == "view", "grounding.searched").when(F.col("kind") == "click", "grounding.skipped").otherwise(F.col("kind"))
    cached = F.get_json_object("payload", "$.k").cast("int") < 30
    return led.grounding_record(b.event(spark, d).select("job_id", kind.alias("kind"), F.to_json(F.struct(cached.alias("cached"))).alias("payload")))


@query(f"""WITH {b.EVENT}, p AS (SELECT job_id, seq, ts, kind, lead(ts) OVER (PARTITION BY job_id ORDER BY seq) AS nxt FROM event)
SELECT job_id, kind AS state, count(*) AS visits, CAST(sum(epoch_us(nxt) - epoch_us(ts)) AS BIGINT) AS micros FROM p WHERE nxt IS NOT NULL GROUP BY 1, 2""")
def phase_durations(spark, d):
    return timeline.phase_durations(b.event(spark, d), F.col("kind"))


@query(f"""WITH {b.EVENT}, p AS (SELECT seq, lag(seq) OVER (ORDER BY seq) AS prev FROM event WHERE kind <> 'view')
SELECT prev + 1 AS first, seq - 1 AS last FROM p WHERE seq - prev > 1""")
def seq_gaps(spark, d):
    return timeline.seq_gaps(b.event(spark, d).filter(F.col("kind") != "view"), [])


@query("SELECT 'o' || o_orderkey AS job_id, o_orderpriority AS goal FROM orders ORDER BY o_orderdate DESC, 'o' || o_orderkey DESC LIMIT 50")
def top_recent(spark, d):
    return timeline.recent_jobs(b.run_job(spark, d)).select("job_id", "goal")


@query(f"WITH {b.EVENT} SELECT seq, job_id, kind, payload FROM event WHERE seq > 500 ORDER BY seq LIMIT 100")
def events_page(spark, d):
    return events_since(b.event(spark, d), 500, 100).select("seq", "job_id", "kind", "payload")


# ------------------------------------------------------------------- ledger --

ATTEMPT = """
attempt AS (SELECT 'o' || l_orderkey AS job_id, CASE WHEN l_returnflag = 'A' THEN 'ok' WHEN l_returnflag = 'R' THEN 'red' WHEN l_linestatus = 'F' THEN 'infrastructure' ELSE 'unfinished' END AS verdict,
  CAST(l_quantity AS BIGINT) AS prompt, CAST(l_linenumber AS BIGINT) AS completion, l_discount AS cost FROM lineitem)"""


def _attempts(spark, d):
    flag = F.col("l_returnflag")
    number = F.concat_ws("-", b.tag("o", "l_orderkey"), F.col("l_linenumber").cast("string"))
    return b.table(spark, d, "lineitem").select(
        b.tag("o", "l_orderkey").alias("job_id"), number.alias("task_id"), F.concat_ws("-", number, b.tag("s", "l_suppkey"), b.tag("p", "l_partkey")).alias("attempt_id"),
        F.col("l_linenumber").alias("n"), F.when(flag == "A", "ok").when(flag == "R", "red").when(F.col("l_linestatus") == "F", "infrastructure").alias("verdict"),
        F.when(flag == "R", "tests").alias("gate"), F.col("l_quantity").cast("long").alias("duration_ms"),
        F.col("l_quantity").cast("long").alias("prompt_tokens"), F.col("l_linenumber").cast("long").alias("completion_tokens"), F.col("l_discount").alias("cost"),
    )


@query(f"""WITH {ATTEMPT}, v AS (SELECT job_id, verdict, count(*) AS n FROM attempt GROUP BY 1, 2)
SELECT a.job_id, sum(prompt)::BIGINT AS prompt_tokens, sum(completion)::BIGINT AS completion_tokens, CAST(nullif(sum(CAST(cost AS DECIMAL(38,6))), 0) AS DOUBLE) AS cost, count(*) AS attempts,
  (SELECT '{{' || string_agg('"' || verdict || '":' || n, ',' ORDER BY verdict) || '}}' FROM v WHERE v.job_id = a.job_id) AS attempts_by_verdict FROM attempt a GROUP BY a.job_id""")
def usage(spark, d):
    return led.usage(_attempts(spark, d)).withColumn("attempts_by_verdict", F.to_json("attempts_by_verdict"))


def _calls(spark, d):
    c = b.model_call(spark, d)
    return c.withColumns({
        "prompt_tokens": F.floor(F.length("text") / 4), "completion_tokens": F.col("billed_tokens") - F.floor(F.length("text") / 4),
        "from_cache": F.col("billed_tokens") < 60, "cached_prompt_tokens": F.when(F.col("role") == "user", F.floor(F.length("text") / 8)),
    })


@query(f"""WITH {b.CALL} SELECT job_id, role, tier, model, count(*) AS calls, sum(length(text) // 4)::BIGINT AS prompt_tokens, sum(billed_tokens - length(text) // 4)::BIGINT AS completion_tokens,
  sum(billed_tokens)::BIGINT AS billed_tokens, count_if(billed_tokens < 60) AS cached, sum(CASE WHEN role = 'user' THEN length(text) // 8 END)::BIGINT AS cached_prompt_tokens FROM call GROUP BY 1, 2, 3, 4""")
def ledger(spark, d):
    return led.ledger_by_role(_calls(spark, d))


@query(f"""WITH {b.CALL}, spent AS (SELECT job_id, sum(greatest(billed_tokens, 20))::BIGINT AS tokens_spent FROM call GROUP BY 1)
SELECT c.job_id, any_value(tokens_spent) AS tokens_spent, count(*) AS calls, sum(billed_tokens)::BIGINT AS attributed_tokens, (any_value(tokens_spent) - sum(billed_tokens))::BIGINT AS unattributed_tokens,
  any_value(tokens_spent) = sum(billed_tokens) AS balanced FROM call c JOIN spent s ON c.job_id = s.job_id GROUP BY c.job_id""")
def ledger_gap(spark, d):
    calls = _calls(spark, d)
    jobs = calls.groupBy("job_id").agg(F.sum(F.greatest("billed_tokens", F.lit(20))).alias("tokens_spent"))
    return led.reconcile(calls, jobs)


@query(f"""WITH {b.CALL}, r AS (SELECT job_id, seq, role, billed_tokens, sum(billed_tokens) OVER (PARTITION BY job_id ORDER BY seq, role, text ROWS UNBOUNDED PRECEDING)::BIGINT AS spent FROM call)
SELECT job_id, seq, role, billed_tokens, spent, spent > 400 AS over, spent > 400 AND spent - billed_tokens <= 400 AS first_breach FROM r""")
def running_spend(spark, d):
    calls = b.model_call(spark, d)
    placed = led.running_spend(calls, F.lit(400), [F.col("seq"), F.col("role"), F.col("text")])
    return placed.select("job_id", "seq", "role", "billed_tokens", "spent", "over", "first_breach")


# ------------------------------------------------------------------- scores --

ARM = """
run AS (SELECT o_orderpriority AS arm, 'o' || o_orderkey AS task_id, o_orderstatus = 'F' AS verified,
  CASE WHEN o_orderstatus = 'O' AND o_totalprice <= 200000 THEN 'GATE_TESTS_RED' WHEN o_orderstatus = 'P' AND o_totalprice <= 100000 THEN 'SANDBOX_TIMEOUT' WHEN o_orderstatus = 'P' AND o_totalprice <= 250000 THEN 'SOMETHING_NEW' END AS error_code,
  CASE WHEN o_orderstatus = 'F' THEN 'VERIFIED' WHEN o_orderstatus = 'O' AND o_totalprice > 200000 THEN 'UNVERIFIED' WHEN o_orderstatus = 'P' AND o_totalprice > 250000 THEN 'ERROR' ELSE 'FAILED' END AS outcome,
  CASE WHEN o_custkey % 2 = 0 THEN 'caveats' ELSE 'no_candidate' END AS cause, o_totalprice AS duration_s, CAST(floor(o_totalprice) AS BIGINT) AS tokens, o_custkey % 3 AS failed_attempts,
  o_totalprice / 10000 AS sandbox_cost, CASE WHEN o_custkey % 3 <> 0 THEN o_custkey % 7 <> 0 END AS oracle FROM orders),
bucketed AS (SELECT *, CASE WHEN verified THEN 'verified' WHEN error_code IS NULL AND outcome = 'UNVERIFIED' AND cause = 'caveats' THEN 'unverified' WHEN outcome = 'ERROR' OR coalesce(error_code = 'SANDBOX_TIMEOUT', false) THEN 'infrastructure' ELSE 'merit' END AS bucket FROM run)"""


def _outcomes(spark, d):
    status, price, cust = F.col("o_orderstatus"), F.col("o_totalprice"), F.col("o_custkey")
    return b.table(spark, d, "orders").select(
        F.col("o_orderpriority").alias("arm"), b.tag("o", "o_orderkey").alias("task_id"), (status == "F").alias("verified"),
        F.when((status == "O") & (price <= 200000), "GATE_TESTS_RED").when((status == "P") & (price <= 100000), "SANDBOX_TIMEOUT")
        .when((status == "P") & (price <= 250000), "SOMETHING_NEW").alias("error_code"),
        F.when(status == "F", "VERIFIED").when((status == "O") & (price > 200000), "UNVERIFIED").when((status == "P") & (price > 250000), "ERROR").otherwise("FAILED").alias("outcome"),
        F.when(cust % 2 == 0, "caveats").otherwise("no_candidate").alias("cause"), price.alias("duration_s"), F.floor(price).alias("tokens"),
        (cust % 3).alias("failed_attempts"), (price / 10000).alias("sandbox_cost"), F.when(cust % 3 != 0, cust % 7 != 0).alias("oracle"),
    )


@query(f"""WITH {ARM} SELECT arm, count(*) AS attempted, count_if(bucket = 'verified') AS verified, count_if(bucket = 'unverified') AS unverified, count_if(bucket = 'merit') AS failed_on_merit,
  count_if(bucket = 'infrastructure') AS excluded_infrastructure, round_even(count_if(bucket = 'verified') / nullif(count_if(bucket <> 'infrastructure'), 0), 3) AS verified_rate,
  count_if(bucket = 'verified' AND NOT oracle) || '/' || count_if(bucket = 'verified' AND oracle IS NOT NULL) AS false_accepts,
  CAST(round_even(sum(tokens) / nullif(count_if(bucket = 'verified'), 0), 0) AS BIGINT) AS tokens_per_verified, round_even(sum(failed_attempts) / nullif(count_if(bucket = 'verified'), 0), 1) AS failed_attempts_per_verified,
  round_even(median(duration_s) FILTER (bucket = 'verified'), 1) AS median_time_to_verified_s, round_even(CAST(nullif(sum(CAST(sandbox_cost AS DECIMAL(30,6))), 0) AS DOUBLE), 4) AS sandbox_cost,
  round_even(CAST(sum(CAST(duration_s AS DECIMAL(30,6))) AS DOUBLE), 1) AS wall_clock_s FROM bucketed GROUP BY arm""")
def arm_score(spark, d):
    return score.score_arms(_outcomes(spark, d))


@query(f"WITH {ARM} SELECT arm, task_id, coalesce(error_code, '') AS code FROM bucketed WHERE bucket = 'infrastructure'")
def arm_excluded(spark, d):
    return score.exclusions(_outcomes(spark, d))


@query(f"WITH {ARM} SELECT task_id, oracle AS accepted, coalesce(NOT oracle, false) AS false_accept FROM run WHERE verified")
def false_accepts(spark, d):
    rows = _outcomes(spark, d)
    check = rows.filter(F.col("oracle").isNotNull()).select("task_id", F.col("oracle").alias("accepted"))
    return score.false_accepts(rows.select("task_id", "verified"), check, ["task_id"]).select("task_id", "accepted", "false_accept")


@query(f"""WITH {b.RUN_TASK}, r AS (SELECT job_id, CASE WHEN count_if(state IN ('verified', 'discarded')) = 0 THEN 0.0 ELSE count_if(state = 'discarded') / count(*) END AS ratio FROM task GROUP BY job_id)
SELECT job_id, round(ratio, 6) AS ratio, ratio > 0.34 AS over_cap FROM r""")
def discard_ratio(spark, d):
    return score.discard_ratio(b.run_task(spark, d), ["job_id"], 0.34).withColumn("ratio", F.round("ratio", 6))


@query("""WITH r AS (SELECT source, CASE WHEN quality = 1 THEN 1 WHEN toxic = 1 THEN 0 ELSE 2 END AS code FROM documents JOIN labels USING (doc_id)),
c AS (SELECT source, count_if(code = 1) AS detected, count_if(code = 0) AS survived, count_if(code = 2) AS incompetent FROM r GROUP BY source)
SELECT source, detected, survived, incompetent, round(detected / nullif(detected + survived, 0), 6) AS score, CASE WHEN detected + survived = 0 THEN 'no_mutants' ELSE 'measured' END AS status,
  coalesce(detected / nullif(detected + survived, 0) < 0.9, false) AS below_floor FROM c""")
def fault_score(spark, d):
    code = F.when(F.col("quality") == 1, 1).when(F.col("toxic") == 1, 0).otherwise(2)
    rows = b.table(spark, d, "documents").select("doc_id", "source").join(b.table(spark, d, "labels"), "doc_id").withColumn("exit_code", code)
    return score.fault_score(rows, ["source"], 0.9).withColumn("score", F.round("score", 6))


@query(f"""WITH {b.RUN_TASK}, {b.RUN_JOB}, c AS (SELECT job_id, count(*) AS tasks, count_if(state = 'verified') AS verified, count_if(state = 'discarded') AS discarded, count_if(state = 'pending') AS open FROM task GROUP BY 1),
r AS (SELECT 'o' || l_orderkey AS job_id, count(DISTINCT l_suppkey) AS files, count(DISTINCT l_partkey) AS tests FROM lineitem GROUP BY 1)
SELECT j.job_id, j.state, coalesce(tasks, 0) AS tasks, coalesce(verified, 0) AS verified, coalesce(discarded, 0) AS discarded, coalesce(open, 0) AS open, CAST(r.files AS INTEGER) AS radius_files, CAST(r.tests AS INTEGER) AS radius_tests,
  CASE WHEN r.files IS NOT NULL THEN 0 END AS radius_unresolved FROM job j LEFT JOIN c ON c.job_id = j.job_id LEFT JOIN r ON r.job_id = j.job_id""")
def job_status(spark, d):
    # The radius of one order: a handful of suppliers and parts.
    sets = b.table(spark, d, "lineitem").groupBy(b.tag("o", "l_orderkey").alias("job_id")).agg(
        F.collect_set(b.tag("s", "l_suppkey")).alias("files"), F.collect_set(b.tag("p", "l_partkey")).alias("tests")
    )
    payloads = sets.select("job_id", F.to_json(F.struct("files", "tests")).alias("payload"))
    return score.job_status(b.run_job(spark, d), b.run_task(spark, d), payloads)


@query(f"""WITH e AS (SELECT user_id || '/' || event_type AS task_id, event_id, event_type, value, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
win AS (SELECT task_id, arg_min(event_id, event_id) AS attempt_id FROM e WHERE value > 90 GROUP BY 1),
fail AS (SELECT task_id, event_id, CASE WHEN event_type = 'error' THEN -1 WHEN k < 20 THEN 0 WHEN k > 60 THEN 2 ELSE 1 END AS worth FROM e WHERE value <= 90 AND task_id NOT IN (SELECT task_id FROM win))
SELECT task_id, attempt_id, 'won' AS how FROM win UNION ALL
SELECT task_id, event_id, 'repair' FROM fail QUALIFY row_number() OVER (PARTITION BY task_id ORDER BY worth DESC, event_id DESC) = 1""")
def first_success(spark, d):
    k = F.get_json_object("payload", "$.k").cast("int")
    attempts = b.event(spark, d).select(
        F.concat_ws("/", "job_id", "kind").alias("task_id"), F.col("seq").alias("attempt_id"), F.col("seq").alias("finished"), (F.col("value") > 90).alias("green"),
        F.when(F.col("kind") == "error", "infrastructure").otherwise("red").alias("verdict"), F.when(k >= 20, k > 60).alias("has_report"),
    )
    winners, failures = score.first_success(attempts)
    return winners.select("task_id", "attempt_id", F.lit("won").alias("how")).unionByName(
        failures.select("task_id", "attempt_id", F.lit("repair").alias("how"))
    )


# ----------------------------------------------------------------- outcomes --

GATE_EVENT = """
gate AS (SELECT 'o' || o_orderkey AS job_id,
  CASE o_orderpriority WHEN '1-URGENT' THEN [{'severity': 'block', 'kind': 'dangling_call', 'detail': 'c' || o_custkey || ' is gone'}] WHEN '2-HIGH' THEN [{'severity': 'block', 'kind': 'uncheckable', 'detail': 'c' || o_custkey || ' does not parse'}]
    WHEN '3-MEDIUM' THEN [{'severity': 'warn', 'kind': 'stale_reference', 'detail': 'c' || o_custkey || ' is still named'}, {'severity': 'info', 'kind': 'note', 'detail': 'fine'}] ELSE [] END AS findings,
  o_totalprice > 300000 AS weak, o_totalprice > 200000 AND o_totalprice <= 250000 AS insecure, o_totalprice > 100000 AND o_totalprice <= 150000 AS apart FROM orders)"""


def _gate_events(spark, d):
    """Gate results of every order, each preceded by an older one that must not count."""
    price, priority = F.col("o_totalprice"), F.col("o_orderpriority")
    cust = b.tag("c", "o_custkey")

    def finding(severity, kind, detail):
        return F.struct(F.lit(severity).alias("severity"), F.lit(kind).alias("kind"), detail.alias("detail"))

    none = F.array().cast("array<struct<severity:string,kind:string,detail:string>>")
    findings = (
        F.when(priority == "1-URGENT", F.array(finding("block", "dangling_call", F.concat(cust, F.lit(" is gone")))))
        .when(priority == "2-HIGH", F.array(finding("block", "uncheckable", F.concat(cust, F.lit(" does not parse")))))
        .when(priority == "3-MEDIUM", F.array(finding("warn", "stale_reference", F.concat(cust, F.lit(" is still named"))), finding("info", "note", F.lit("fine"))))
        .otherwise(none)
    )
    payloads = {
        "impact.result": F.to_json(F.struct(findings.alias("findings"))),
        "strength.result": F.when(price > 300000, '{"below_floor": true, "detected": 1, "survived": 7, "score": 0.125, "floor": 0.6}'),
        "security.result": F.when((price > 200000) & (price <= 250000), '{"introduced": [{"rule": "secret.jwt", "message": "found", "path": "a.py", "line": 7}]}'),
        "integration.result": F.when((price > 100000) & (price <= 150000), '{"pass": false, "failing": ["t::a", "t::b"]}').otherwise('{"pass": true}'),
    }
    rows = F.array(*[F.struct(F.lit(k).alias("kind"), p.alias("payload"), F.lit(1).alias("at")) for k, p in payloads.items()],
                   *[F.struct(F.lit(k).alias("kind"), F.lit("not json").alias("payload"), F.lit(0).alias("at")) for k in payloads])
    orders = b.table(spark, d, "orders")
    # An order meets its job before it gives eight events.
    placed = dealt(orders.select(b.tag("o", "o_orderkey").alias("job_id"), "o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority"), ["job_id"], orders.count())
    exploded = placed.select("job_id", "o_orderkey", F.explode(rows).alias("_e"))
    return exploded.filter(F.col("_e.payload").isNotNull()).select(
        "job_id", (F.col("o_orderkey") * 2 + F.col("_e.at")).alias("seq"), F.col("_e.kind").alias("kind"), F.col("_e.payload").alias("payload")
    )


def _signals(spark, d, tasks=None):
    parts = b.table(spark, d, "part").select(b.graph(), b.tag("p", "p_partkey").alias("path"), b.tag("p", "p_partkey").alias("fqn"))
    return out.gather_signals(b.run_job(spark, d), b.run_task(spark, d) if tasks is None else tasks, _gate_events(spark, d), parts, b.test_edge(spark, d))


SIGNAL = f"""{b.RUN_JOB}, {b.RUN_TASK}, {b.TEST_EDGE}, {GATE_EVENT},
counts AS (SELECT job_id, count_if(state = 'verified') AS verified, count_if(state = 'discarded') AS discarded, count_if(state = 'discarded' AND discard_reason LIKE 'infrastructure (%') AS infra FROM task GROUP BY 1),
cover AS (SELECT symbol, bool_and(source = 'characterisation') AS generated FROM test_edge GROUP BY 1),
touched AS (SELECT DISTINCT t.job_id, t.target_file FROM task t JOIN job j ON j.job_id = t.job_id WHERE t.state = 'verified' AND j.state = 'Done'),
risk AS (SELECT job_id, list(target_file ORDER BY target_file) FILTER (c.symbol IS NULL) AS uncovered, list(target_file ORDER BY target_file) FILTER (c.generated) AS generated
  FROM touched t LEFT JOIN cover c ON c.symbol = t.target_file GROUP BY 1),
signal AS (SELECT j.*, coalesce(verified, 0) AS verified, coalesce(discarded, 0) AS discarded, coalesce(infra, 0) AS infra, coalesce(uncovered, []) AS uncovered, coalesce(generated, []) AS generated, findings, weak, insecure, apart
  FROM job j JOIN gate g ON g.job_id = j.job_id LEFT JOIN counts c ON c.job_id = j.job_id LEFT JOIN risk r ON r.job_id = j.job_id)"""


@query(f"""WITH {SIGNAL} SELECT job_id, state, verified AS verified_tasks, discarded AS discarded_tasks, infra AS infrastructure_discards, array_to_string(uncovered, ',') AS uncovered, array_to_string(generated, ',') AS characterisation_only,
  len(list_filter(findings, lambda f: f.severity = 'block')) > 0 AS blocked, weak AS has_strength, insecure AS has_security FROM signal""")
def job_signals(spark, d):
    return _signals(spark, d).select(
        "job_id", "state", "verified_tasks", "discarded_tasks", "infrastructure_discards",
        F.array_join("uncovered", ",").alias("uncovered"), F.array_join("characterisation_only", ",").alias("characterisation_only"),
        F.contains("impact", F.lit('"block"')).alias("blocked"), (F.col("strength") != "not json").alias("has_strength"), (F.col("security") != "not json").alias("has_security"),
    )


@query(f"""WITH {SIGNAL}, c AS (SELECT *, list_filter(findings, lambda f: f.severity = 'block') AS blocks, list_filter(findings, lambda f: f.severity = 'block' AND f.kind <> 'uncheckable') AS defects,
   coalesce(stop_reason, 'stopped without a verified change') AS reason,
   list_concat(list_concat(list_transform(list_filter(findings, lambda f: f.severity = 'warn'), lambda f: f.detail),
     list_filter([CASE WHEN weak THEN 'weak tests: 1 of 8 injected faults detected, score 12%, floor 60%' END, CASE WHEN discarded - infra > 0 THEN (discarded - infra) || ' task(s) not verified, partial migration' END,
       CASE WHEN infra > 0 THEN infra || ' task(s) not evaluated by the platform, partial migration' END], lambda x: x IS NOT NULL)),
     list_concat(list_transform(uncovered, lambda p: p || ': modified, no test covers it'), list_transform(generated, lambda p: p || ': covered by a generated test only'))) AS caveats FROM signal),
v AS (SELECT job_id, pr_url, caveats, CASE
  WHEN state = 'Executing' THEN NULL
  WHEN state = 'Aborted' THEN {{'outcome': 'ERROR', 'cause': 'aborted', 'reasons': [coalesce(stop_reason, 'the run aborted')]}}
  WHEN state = 'NoSafetyNet' THEN {{'outcome': 'UNVERIFIED', 'cause': 'no_safety_net', 'reasons': [coalesce(stop_reason, 'no reliable test to measure against')]}}
  WHEN state = 'NoPR' THEN CASE
    WHEN reason = 'cancelled' THEN {{'outcome': 'UNVERIFIED', 'cause': 'cancelled', 'reasons': ['stopped on request']}}
    WHEN len(defects) > 0 THEN {{'outcome': 'FAILED', 'cause': 'impact', 'reasons': list_transform(defects, lambda f: f.detail)}}
    WHEN apart THEN {{'outcome': 'FAILED', 'cause': 'integration', 'reasons': ['failing: t::a, t::b']}}
    WHEN insecure THEN {{'outcome': 'FAILED', 'cause': 'security', 'reasons': ['secret.jwt: found (a.py:7)']}}
    WHEN len(blocks) > 0 THEN {{'outcome': 'UNVERIFIED', 'cause': 'uncheckable', 'reasons': list_transform(blocks, lambda f: f.detail)}}
    WHEN discarded > 0 AND infra >= discarded AND verified = 0 THEN {{'outcome': 'ERROR', 'cause': 'infrastructure', 'reasons': [reason]}}
    ELSE {{'outcome': 'UNVERIFIED', 'cause': CASE WHEN verified = 0 THEN 'no_candidate' ELSE 'incomplete' END, 'reasons': [reason]}} END
  WHEN coalesce(stop_reason = 'dry_run', false) OR verified = 0 THEN {{'outcome': 'UNVERIFIED', 'cause': 'plan_only', 'reasons': ['nothing was generated or tested']}}
  WHEN len(caveats) = 0 THEN {{'outcome': 'VERIFIED', 'cause': 'clean', 'reasons': CAST([] AS VARCHAR[])}}
  ELSE {{'outcome': 'UNVERIFIED', 'cause': 'caveats', 'reasons': caveats}} END AS v FROM c)
SELECT job_id, v.outcome AS outcome, v.cause AS cause, array_to_string(v.reasons, '|') AS reasons,
  v.outcome || ': ' || v.cause || CASE WHEN len(v.reasons) > 0 THEN '; ' || array_to_string(v.reasons[1:3], '; ') || CASE WHEN len(v.reasons) > 3 THEN ' (+' || (len(v.reasons) - 3) || ' more)' ELSE '' END ELSE '' END AS headline,
  CASE WHEN v IS NOT NULL THEN v.cause IN ('clean', 'caveats') AND coalesce(pr_url, '') <> '' END AS pr_offered FROM v""")
def outcome(spark, d):
    return out.outcome(_signals(spark, d)).select(
        "job_id", "outcome", "cause", F.array_join("reasons", "|").alias("reasons"), "headline", "pr_offered"
    )


@query(f"""WITH {b.RUN_JOB} SELECT job_id, CASE o_orderpriority WHEN '3-MEDIUM' THEN 'live' WHEN '4-NOT SPECIFIED' THEN 'local' ELSE 'unknown' END AS sandbox,
  CASE WHEN o_orderpriority IN ('3-MEDIUM', '4-NOT SPECIFIED') THEN 'live' ELSE 'unknown' END AS inference, o_orderpriority = '3-MEDIUM' AS live FROM job""")
def provenance(spark, d):
    return b.run_job(spark, d).select("job_id", out.provenance("tunables").alias("_p")).select("job_id", "_p.*")


def _evidence(spark, d):
    artifacts = b.table(spark, d, "lineitem").select(
        b.tag("o", "l_orderkey").alias("job_id"), b.tag("d", "l_suppkey").alias("artifact_id"), F.lit("diff").alias("kind"),
        b.tag("patches/", "l_suppkey").alias("path"), F.sha2(F.col("l_partkey").cast("string"), 256).alias("sha256"), (F.col("l_linenumber") % 2 == 0).alias("present"),
    )
    kind = F.when(F.col("kind") == "click", "grounding.searched").when(F.col("kind") == "view", "grounding.skipped").otherwise(F.col("kind"))
    events = b.event(spark, d).withColumn("kind", kind)
    # Three parts read the tasks; they are grouped once.
    tasks = materialise(b.run_task(spark, d))
    return out.evidence(b.run_job(spark, d), tasks, _attempts(spark, d), artifacts, _signals(spark, d, tasks), events, _calls(spark, d))


#: The fields of each section that the query reads back from the documents.
FACTS = {
    "job": ("state", "goal", "stop_reason", "pr_url"), "provenance": ("provenance.sandbox", "provenance.inference"), "tunables": ("tunables",), "repeat": ("repo_url", "goal"),
    "outcome": ("outcome", "cause", "headline"), "gates": ("strength", "integration"), "usage": ("attempts", "prompt_tokens", "completion_tokens", "tokens_spent"),
    "task": ("seq", "target_file", "state", "discard_reason"), "attempt": ("attempt_id", "n", "verdict", "prompt_tokens"), "artifact": ("artifact_id", "path", "present"),
    "ledger": ("role", "tier", "model", "calls", "billed_tokens"), "grounding": ("seq", "kind", "record"),
}
DOCUMENT = "provenance STRUCT<sandbox: STRING, inference: STRING>, " + ", ".join(sorted({f"{f} STRING" for fields in FACTS.values() for f in fields if "." not in f}))


@query(f"""WITH {SIGNAL}, {ATTEMPT}, {b.CALL}, {b.EVENT}, verdict AS ({ORACLES["outcome"]}), spend AS (SELECT job_id, count(*) AS n, sum(prompt)::BIGINT AS p, sum(completion)::BIGINT AS c FROM attempt GROUP BY 1)
SELECT job_id, 'job' AS section, concat_ws('|', state, goal, stop_reason, pr_url) AS facts FROM job
UNION ALL SELECT job_id, 'provenance', CASE o_orderpriority WHEN '3-MEDIUM' THEN 'live|live' WHEN '4-NOT SPECIFIED' THEN 'local|live' ELSE 'unknown|unknown' END FROM job
UNION ALL SELECT job_id, 'tunables', coalesce(tunables, '') FROM job UNION ALL SELECT job_id, 'repeat', 'https://forge.example/repo|' || goal FROM job
UNION ALL SELECT job_id, 'outcome', concat_ws('|', outcome, cause, headline) FROM verdict
UNION ALL SELECT job_id, 'gates', CASE WHEN weak THEN '{{"below_floor": true, "detected": 1, "survived": 7, "score": 0.125, "floor": 0.6}}' ELSE 'not json' END || '|' ||
  CASE WHEN apart THEN '{{"pass": false, "failing": ["t::a", "t::b"]}}' ELSE '{{"pass": true}}' END FROM signal
UNION ALL SELECT s.job_id, 'usage', concat_ws('|', n, p, c, tokens_spent) FROM spend s JOIN job j ON j.job_id = s.job_id
UNION ALL SELECT job_id, 'task', concat_ws('|', seq, target_file, state, discard_reason) FROM task
UNION ALL SELECT 'o' || l_orderkey, 'attempt', concat_ws('|', 'o' || l_orderkey || '-' || l_linenumber || '-s' || l_suppkey || '-p' || l_partkey, l_linenumber,
  CASE WHEN l_returnflag = 'A' THEN 'ok' WHEN l_returnflag = 'R' THEN 'red' WHEN l_linestatus = 'F' THEN 'infrastructure' END, CAST(l_quantity AS BIGINT)) FROM lineitem
UNION ALL SELECT 'o' || l_orderkey, 'artifact', concat_ws('|', 'd' || l_suppkey, 'patches/' || l_suppkey, CASE WHEN l_linenumber % 2 = 0 THEN 'true' ELSE 'false' END) FROM lineitem
UNION ALL SELECT job_id, 'ledger', concat_ws('|', role, tier, model, count(*), sum(billed_tokens)::BIGINT) FROM call GROUP BY job_id, role, tier, model
UNION ALL SELECT job_id, 'grounding', concat_ws('|', seq, CASE kind WHEN 'click' THEN 'searched' ELSE 'skipped' END, payload) FROM event WHERE kind IN ('click', 'view')""")
def evidence(spark, d):
    # A document is parsed once, whatever the number of its fields.
    parsed = _evidence(spark, d).withColumn("_d", F.from_json("document", DOCUMENT))
    facts = F.coalesce(*[
        F.when(F.col("section") == name, F.concat_ws("|", *[F.col(f"_d.{f}") for f in fields])) for name, fields in FACTS.items()
    ])
    return parsed.select("job_id", "section", facts.alias("facts"))


@query(f"""WITH {b.EVENT} SELECT job_id, seq, CASE kind WHEN 'click' THEN 'searched' ELSE 'skipped' END AS kind, payload AS record FROM event WHERE kind IN ('click', 'view')""")
def grounding_rows(spark, d):
    kind = F.when(F.col("kind") == "click", "grounding.searched").when(F.col("kind") == "view", "grounding.skipped").otherwise(F.col("kind"))
    return led.grounding_events(b.event(spark, d).withColumn("kind", kind))


@query("""WITH j AS (SELECT o_orderkey FROM orders), l AS (SELECT l_orderkey, count(*) AS n, count(DISTINCT l_linenumber) AS t FROM lineitem GROUP BY 1)
SELECT 'o' || o_orderkey AS job_id, unnest(['job', 'provenance', 'tunables', 'repeat', 'outcome', 'gates']) AS section, 1 AS items FROM j
UNION ALL SELECT 'o' || l_orderkey, 'usage', 1 FROM l UNION ALL SELECT 'o' || l_orderkey, 'task', t FROM l
UNION ALL SELECT 'o' || l_orderkey, unnest(['attempt', 'artifact']), n FROM l""")
def evidence_sections(spark, d):
    rows = _evidence(spark, d).filter(~F.col("section").isin("ledger", "grounding"))
    return rows.groupBy("job_id", "section").agg(F.count("document").alias("items"))
