import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from impactlens.operators import checks, dependencies, ledger, outcome, sampling, score, search
from impactlens.operators import edges
from impactlens.plans import ordering
from impactlens.schemas import checked, conform, schema_of


def frame(spark, ddl, *values):
    return spark.createDataFrame([v if isinstance(v, tuple) else (v,) for v in values], ddl)


# ------------------------------------------------------------- dependencies --


def plain_waves(tasks, deps):
    done, left, out, wave = set(), dict(tasks), {}, 0
    while left:
        ready = sorted(t for t in left if all(n in done for n in deps.get(t, ())))
        if not ready:
            return out | dict.fromkeys(left)
        wave, claimed = wave + 1, {}
        for t in ready:
            claimed.setdefault(left[t], t)
        for t in claimed.values():
            out[t] = wave
            done.add(t)
            del left[t]
    return out


@pytest.mark.parametrize("seed", range(3))
def test_waves_equal_plain_levelling(spark, seed):
    rng = random.Random(seed)
    tasks, deps, expected = [], [], {}
    for job in ("j1", "j2", "j3"):
        files = {s: f"f{rng.randrange(5)}" for s in range(1, 13)}
        needs = {s: {rng.randrange(1, s) for _ in range(rng.randrange(3))} for s in range(2, 13)}
        if job == "j3":
            needs[4] = {9} | needs[4]
            needs[9] = {4}
            needs[6] = {99}
        tasks += [(job, s, f) for s, f in files.items()]
        deps += [(job, s, n) for s, ns in needs.items() for n in ns]
        expected |= {(job, s): w for s, w in plain_waves(files, needs).items()}
    got = dependencies.order_waves(
        spark.createDataFrame(tasks, "job_id STRING, seq INT, target_file STRING"), spark.createDataFrame(deps, "job_id STRING, seq INT, needs INT")
    )
    assert {(r.job_id, r.seq): r.wave for r in got.collect()} == expected


def test_closure_skips_discarded_and_own_file(spark, rows):
    tasks = frame(spark, "job_id STRING, seq INT, target_file STRING, state STRING",
                  ("j", 1, "a", "verified"), ("j", 2, "b", "discarded"), ("j", 3, "c", "verified"), ("j", 4, "a", "verified"))
    deps = frame(spark, "job_id STRING, seq INT, needs INT", ("j", 2, 1), ("j", 3, 2), ("j", 4, 3))
    assert rows(dependencies.dependency_closure(tasks, deps), "seq", "needs") == [(2, 1), (3, 1), (4, 3)]


def test_fork_tree_and_plan_checks(spark, rows):
    nodes = frame(spark, "job_id STRING, node STRING, parent STRING", ("j", "a", None), ("j", "b", "a"), ("j", "c", "b"), ("j", "d", "b"), ("j", "x", "gone"))
    assert rows(dependencies.fork_tree(nodes), "node", "root", "depth", "children") == [
        ("a", "a", 0, 1), ("b", "a", 1, 2), ("c", "a", 2, 0), ("d", "a", 2, 0), ("x", "x", 0, 0)]
    tasks = frame(spark, "job_id STRING, seq INT, target_file STRING", ("j", 1, "a"), ("j", 1, "a"), ("j", 2, "z"), ("j", 3, "a"))
    deps = frame(spark, "job_id STRING, seq INT, needs INT", ("j", 2, 3), ("j", 3, 2), ("j", 1, 8))
    radius = frame(spark, "job_id STRING, target_file STRING", ("j", "a"))
    got = rows(dependencies.plan_violations(tasks, deps, radius, 3), "rule", "seq")
    assert got == [("cycle", 2), ("cycle", 3), ("duplicate seq", 1), ("outside radius", 2), ("too many tasks", None), ("unknown dependency", 1)]


def test_closure_of_cycles_and_chains(spark):
    rng = random.Random(4)
    jobs = {
        "two cycles and tails": [(1, 2), (2, 3), (3, 1), (4, 1), (3, 5), (5, 6), (6, 7), (7, 6), (8, 8), (7, 9), (10, 4)],
        "chain": [(i, i + 1) for i in range(12)], "ring": [(i, (i + 1) % 15) for i in range(15)], "dice": [(rng.randrange(30), rng.randrange(30)) for _ in range(45)],
    }
    deps = spark.createDataFrame([(j, a, b) for j, es in jobs.items() for a, b in es * 2], "job_id STRING, seq INT, needs INT")
    pairs = {(r.job_id, r.seq, r.needs) for r in dependencies.closure(deps).collect()}
    for job, es in jobs.items():
        hops = set(es)
        while more := {(a, d) for a, b in hops for c, d in es if b == c} - hops:
            hops |= more
        assert {(a, b) for j, a, b in pairs if j == job} == hops


# ----------------------------------------------------------------- ordering --


@pytest.mark.parametrize("bounded", [False, True])
def test_ordering_is_the_same_both_ways(spark, rows, bounded):
    rng = random.Random(5)
    data = [(rng.choice("aab"), i, rng.randrange(100)) for i in range(300)]
    df = spark.createDataFrame(data, "k STRING, seq INT, v INT").repartition(5)
    got = ordering.numbered(df, ["k"], [F.col("seq")], F.col("v"), bounded)
    expected, sums, counts = [], {}, {}
    total = {k: sum(1 for d in data if d[0] == k) for k in "ab"}
    for k, seq, v in data:
        sums[k], counts[k] = sums.get(k, 0) + v, counts.get(k, 0) + 1
        expected.append((k, seq, v, counts[k], total[k], sums[k]))
    assert rows(got, "k", "seq", "v", "rn", "n", "running") == sorted(expected, key=repr)
    prev, want = {}, []
    for k, seq, _ in data:
        want.append((k, seq, prev.get(k)))
        prev[k] = seq
    assert rows(ordering.with_previous(df, ["k"], [F.col("seq")], ["seq"], bounded), "k", "seq", "prev_seq") == sorted(want, key=repr)
    whole = ordering.numbered(df, [], [F.col("seq")], bounded=bounded)
    assert rows(whole, "seq", "rn") == sorted(((i, i + 1) for i in range(300)), key=repr)
    medians = dict(rows(ordering.exact_median(df, ["k"], "v", bounded)))
    for k in "ab":
        values = sorted(v for kk, _, v in data if kk == k)
        n = len(values)
        assert medians[k] == (values[(n - 1) // 2] + values[n // 2]) / 2


@pytest.mark.parametrize(("n", "k"), [(10, 4), (7, 3), (5, 5), (3, 9), (9, 1), (6, 0), (12, 5), (8, 4)])
def test_even_sample(spark, rows, n, k):
    got = rows(sampling.even_sample(spark.range(n).withColumn("g", F.lit(1)), ["g"], [F.col("id")], k), "id")
    want = list(range(n)) if k >= n else [] if k <= 0 else [0] if k == 1 else sorted({round(i * (n - 1) / (k - 1)) for i in range(k)})
    assert got == sorted(((i,) for i in want), key=repr)


def test_runs_quotas_and_samples(spark, rows):
    lines = frame(spark, "path STRING, line INT", ("a", 1), ("a", 2), ("a", 4), ("b", 9), ("a", 2))
    assert rows(sampling.line_runs(lines, ["path"])) == [("a", 1, 2), ("a", 4, 4), ("b", 9, 9)]
    shares = sampling.quotas(frame(spark, "k INT, f STRING", (1, "a"), (1, "b"), (1, "c")), ["k"], [F.col("f")], 20)
    assert rows(shares, "f", "share") == [("a", 7), ("b", 7), ("c", 6)]
    changed = spark.range(100).select(F.lit("j").alias("job"), F.when(F.col("id") < 90, "big").otherwise("small").alias("path"), (F.col("id") % 90 + 1).cast("int").alias("line"))
    got = sampling.sample_changed(changed, ["job"], 20).groupBy("path").count()
    assert rows(got) == [("big", 10), ("small", 10)]


# ------------------------------------------------------------------- scores --

OUTCOME = (
    "task_id STRING, arm STRING, verified BOOLEAN, error_code STRING, outcome STRING, cause STRING, duration_s DOUBLE, tokens BIGINT, "
    "failed_attempts INT, sandbox_cost DOUBLE, oracle BOOLEAN"
)


def test_arm_scores(spark):
    got = {r.arm: r for r in score.score_arms(frame(
        spark, OUTCOME,
        ("1", "C", True, None, "VERIFIED", "clean", 100.0, 10, 1, 0.0, False), ("2", "C", True, None, "VERIFIED", "clean", 300.0, 20, 0, 0.0, True),
        ("3", "C", False, "GATE_BEHAVIOUR", "FAILED", "x", 9999.0, 5, 2, 0.0, None), ("4", "C", False, "SANDBOX_OP_FAILED", "", "", 1.0, 5, 0, 0.0, None),
        ("5", "B", False, None, "UNVERIFIED", "caveats", 1.0, 5, 0, 0.5, None), ("6", "B", True, None, "VERIFIED", "clean", 1.0, 5, 0, 0.0, None),
        ("7", "A", False, "NEVER_SEEN", "", "", 1.0, 5, 0, 0.0, None), ("8", "A", False, None, "UNVERIFIED", "no_candidate", 1.0, 5, 0, 0.0, None),
    )).collect()}
    c, b, a = got["C"], got["B"], got["A"]
    assert (c.verified, c.failed_on_merit, c.excluded_infrastructure, c.verified_rate, c.false_accepts, c.median_time_to_verified_s) == (2, 1, 1, 0.667, "1/2", 200.0)
    assert (b.verified, b.unverified, b.verified_rate, b.false_accepts, b.sandbox_cost) == (1, 1, 0.5, None, 0.5)
    assert (a.failed_on_merit, a.verified_rate, a.tokens_per_verified, a.sandbox_cost) == (2, 0.0, None, None)


def test_faults_discards_and_winners(spark, rows):
    results = frame(spark, "file STRING, exit_code INT", ("a", 0), ("a", 1), ("a", 1), ("b", 2), ("c", 0))
    got = {r.file: (r.detected, r.survived, r.incompetent, r.status, r.below_floor) for r in score.fault_score(results, ["file"], 0.6).collect()}
    assert got == {"a": (2, 1, 0, "measured", False), "b": (0, 0, 1, "no_mutants", False), "c": (0, 1, 0, "measured", True)}
    tasks = frame(spark, "job_id STRING, state STRING", ("x", "verified"), ("x", "discarded"), ("x", "pending"), ("y", "pending"))
    assert rows(score.discard_ratio(tasks, ["job_id"], 0.3)) == [("x", 1 / 3, True), ("y", 0.0, False)]
    attempts = frame(spark, "task_id STRING, attempt_id STRING, finished INT, green BOOLEAN, verdict STRING, has_report BOOLEAN",
                     ("t", "a", 5, True, "ok", True), ("t", "b", 3, True, "ok", True), ("u", "c", 1, False, "red", True), ("u", "d", 2, False, "scope", None),
                     ("u", "e", 3, False, "red", True), ("v", "f", 1, False, "infrastructure", True), ("v", "g", 1, False, "scope", None))
    winners, failures = score.first_success(attempts)
    assert rows(winners) == [("t", "b")] and rows(failures, "task_id", "attempt_id") == [("u", "e"), ("v", "g")]


def test_ledger(spark, rows):
    call = '{"role": "%s", "tier": "t", "model": "m", "prompt_tokens": 100, "completion_tokens": 40, "billed_tokens": 155, "from_cache": %s}'
    events = frame(spark, "job_id STRING, seq INT, kind STRING, payload STRING",
                   *[("j", i, "model.call", call % (role, cached)) for i, (role, cached) in enumerate([("coder", "false"), ("coder", "true"), ("planner", "false")])],
                   ("j", 9, "other", "{}"))
    calls = ledger.model_calls(events)
    got = {r.role: r for r in ledger.ledger_by_role(calls).collect()}
    assert (got["coder"].calls, got["coder"].billed_tokens, got["coder"].cached, got["coder"].cached_prompt_tokens) == (2, 310, 1, None)
    gap = ledger.reconcile(calls, frame(spark, "job_id STRING, tokens_spent BIGINT", ("j", 465), ("k", 1))).collect()
    assert len(gap) == 1 and gap[0].balanced and gap[0].attributed_tokens == 465
    spend = ledger.running_spend(calls, F.lit(200), [F.col("seq")])
    assert rows(spend, "spent", "first_breach") == [(155, False), (310, True), (465, False)]
    attempts = frame(spark, "job_id STRING, verdict STRING, prompt_tokens BIGINT, completion_tokens BIGINT, cost DOUBLE", ("j", None, 1, 2, None), ("j", "ok", 3, None, 0.0))
    used = ledger.usage(attempts).first()
    assert (used.prompt_tokens, used.completion_tokens, used.cost, used.attempts_by_verdict) == (4, 2, None, {"ok": 1, "unfinished": 1})
    same = frame(spark, "a STRING, b STRING", ('{"x": 1, "y": 2}', '{"y": 2, "x": 1}'), ('{"x": 1}', '{"x": 2}'), ('{"x": 1}', None))
    assert [r[0] for r in same.select(ledger.tunables_equal(F.col("a"), F.col("b"))).collect()] == [True, False, None]


# ----------------------------------------------------------------- outcomes --

SIGNALS = (
    "job_id STRING, state STRING, stop_reason STRING, pr_url STRING, verified_tasks INT, discarded_tasks INT, infrastructure_discards INT, "
    "characterise STRING, integration STRING, security STRING, impact STRING, strength STRING, uncovered ARRAY<STRING>, characterisation_only ARRAY<STRING>"
)


def signal(state, stop=None, pr=None, counts=(0, 0, 0), integration=None, security=None, impact=None, strength=None, uncovered=(), generated=()):
    return ("j", state, stop, pr, *counts, None, integration, security, impact, strength, list(uncovered), list(generated))


BLOCK = '{"findings": [{"severity": "block", "kind": "%s", "detail": "d"}]}'
CASES = [
    *[(signal(s), (None, None)) for s in ("Created", "Ingesting", "Mapping", "Planning", "Executing", "Integrating")],
    (signal("Done", pr="u", counts=(3, 0, 0)), ("VERIFIED", "clean")), (signal("Done", "dry_run", counts=(3, 0, 0)), ("UNVERIFIED", "plan_only")),
    (signal("Done"), ("UNVERIFIED", "plan_only")), (signal("Done", pr="u", counts=(2, 1, 0)), ("UNVERIFIED", "caveats")),
    (signal("Done", counts=(1, 0, 0), uncovered=["a.py"]), ("UNVERIFIED", "caveats")), (signal("Aborted", "boom"), ("ERROR", "aborted")),
    (signal("NoSafetyNet"), ("UNVERIFIED", "no_safety_net")), (signal("NoPR", "cancelled", impact=BLOCK % "x"), ("UNVERIFIED", "cancelled")),
    (signal("NoPR", impact=BLOCK % "dangling_call", integration='{"pass": false}'), ("FAILED", "impact")),
    (signal("NoPR", integration='{"pass": false, "coverage_ok": false}', impact=BLOCK % "uncheckable"), ("FAILED", "integration")),
    (signal("NoPR", security='{"introduced": [{"rule": "r", "message": "m", "path": "p", "line": 1}]}'), ("FAILED", "security")),
    (signal("NoPR", impact=BLOCK % "uncheckable"), ("UNVERIFIED", "uncheckable")), (signal("NoPR", counts=(0, 2, 2)), ("ERROR", "infrastructure")),
    (signal("NoPR", counts=(0, 2, 1)), ("UNVERIFIED", "no_candidate")), (signal("NoPR", counts=(1, 2, 2)), ("UNVERIFIED", "incomplete")),
]


def test_outcomes(spark):
    df = spark.createDataFrame([(str(i), *c[0][1:]) for i, c in enumerate(CASES)], SIGNALS)
    got = {int(r.job_id): r for r in outcome.outcome(df).collect()}
    assert {i: (got[i].outcome, got[i].cause) for i in got} == {i: c[1] for i, c in enumerate(CASES)}
    done = got[6]
    assert done.reasons == [] and done.pr_offered and done.repository_changed and got[0].pr_offered is None
    assert got[15].reasons == ["a changed file is covered less than before"]


def test_caveats_keep_their_order_and_are_counted(spark):
    strength = '{"below_floor": true, "detected": 1, "survived": 7, "score": 0.125, "floor": 0.6}'
    impact = '{"findings": [{"severity": "warn", "kind": "k", "detail": "w"}]}'
    row = signal("Done", pr="u", counts=(1, 3, 1), impact=impact, strength=strength, uncovered=["a"], generated=["b"])
    got = outcome.outcome(spark.createDataFrame([row], SIGNALS)).first()
    assert len(got.reasons) == 6 and got.reasons[0] == "w" and "score 12%" in got.reasons[1] and got.reasons[2].startswith("2 task(s)")
    assert got.headline.endswith("(+3 more)")


def test_provenance(spark):
    df = frame(spark, "t STRING", '{"execution_provenance": {"sandbox": "live", "inference": "live"}}', '{"execution_provenance": {"sandbox": "local", "inference": "live"}}', "{}", None)
    got = [tuple(r[0]) for r in df.select(outcome.provenance("t")).collect()]
    assert got == [("live", "live", True), ("local", "live", False), ("unknown", "unknown", False), ("unknown", "unknown", False)]


def test_evidence_keeps_every_section_as_rows(spark):
    jobs = frame(spark, "job_id STRING, repo_url STRING, commit_sha STRING, goal STRING, target_fqn STRING, state STRING, stop_reason STRING, pr_url STRING, tunables STRING, "
                 "tokens_spent BIGINT, token_budget BIGINT", ("j", "r", "c", "g", "t", "Done", None, "u", None, 5, 9))
    tasks = frame(spark, "job_id STRING, seq INT, target_file STRING, state STRING, winning_attempt_id STRING, discard_reason STRING", ("j", 1, "a", "verified", "w", None), ("j", 2, "b", "pending", None, None))
    attempts = frame(spark, "job_id STRING, attempt_id STRING, task_id STRING, n INT, verdict STRING, gate STRING, duration_ms BIGINT, prompt_tokens BIGINT, completion_tokens BIGINT, cost DOUBLE",
                     ("j", "w", "t1", 1, "ok", None, 3, 1, 2, 0.5))
    artifacts = frame(spark, "job_id STRING, artifact_id STRING, kind STRING, path STRING, sha256 STRING", ("j", "x", "diff", "p", "h"))
    signals = spark.createDataFrame([signal("Done", pr="u", counts=(1, 0, 0))], SIGNALS)
    got = outcome.evidence(jobs, tasks, attempts, artifacts, signals).collect()
    assert sorted(r.section for r in got) == ["artifact", "attempt", "gates", "job", "outcome", "provenance", "repeat", "task", "task", "tunables", "usage"]
    assert '"outcome":"VERIFIED"' in next(r.document for r in got if r.section == "outcome")


# ------------------------------------------------------------------- checks --


def test_scope_rules_in_order(spark):
    tasks = frame(spark, "job_id STRING, diff_id INT, target_file STRING", *[("j", i, "src/a.py") for i in range(5)], ("j", 5, "tests/t.py"), ("j", 6, "setup.py"), ("j", 7, "x.py"))
    touched = frame(spark, "job_id STRING, diff_id INT, path STRING", ("j", 0, "src/a.py"), ("j", 1, "../a"), ("j", 2, "src/b.py"), ("j", 3, "src/a.py"), ("j", 3, "src/b.py"),
                    ("j", 5, "tests/t.py"), ("j", 6, "setup.py"), ("j", 7, "x.py"))
    got = {r.diff_id: r.rule for r in checks.scope_check(tasks, touched, frame(spark, "job_id STRING, path STRING", ("j", "src/a.py"))).collect()}
    assert got == {0: "ok", 1: "path traversal", 2: "outside task file", 3: "outside task file", 4: "no files", 5: "test file", 6: "manifest", 7: "outside radius"}


def test_findings_are_differential(spark, rows):
    ddl = "job_id STRING, path STRING, line INT, rule STRING, snippet STRING"
    before = frame(spark, ddl, ("j", "a", 1, "r", 'x = "one"'))
    after = frame(spark, ddl, ("j", "a", 50, "r", "x  = 'two'"), ("j", "a", 2, "r", "y = 1"), ("j", "b", 2, "r", "y = 1"))
    fresh = checks.new_findings(before, after, ["job_id"], frame(spark, "job_id STRING, path STRING", ("j", "a")))
    assert rows(fresh, "path", "line") == [("a", 2)]
    scanned = frame(spark, "job_id STRING, side STRING", ("j", "before"), ("j", "after"), ("k", "after"))
    assert rows(checks.findings_status(scanned, before, after, fresh, ["job_id"]), "job_id", "verdict") == [("j", "security"), ("k", "inconclusive")]


def test_coverage_checks(spark, rows):
    pct = "path STRING, percent DOUBLE"
    drops = checks.coverage_drops(frame(spark, pct, ("a", 80.0), ("b", 80.0), ("c", 9.0), ("d", 5.0)), frame(spark, pct, ("a", 79.0), ("b", 80.0), ("c", 1.0)), frame(spark, "path STRING", "a", "b", "d"), ["path"])
    assert rows(drops) == [("a", 80.0, 79.0)]
    sites = frame(spark, "graph_id STRING, path STRING, line INT, name STRING", ("g", "a", 1, "n"), ("g", "a", 2, "n"), ("h", "a", 1, "n"))
    cov = frame(spark, "graph_id STRING, path STRING, line INT, executed BOOLEAN", ("g", "a", 1, True), ("g", "a", 2, False))
    assert rows(checks.dynamic_paths_exercised(sites, cov), "graph_id", "line", "exercised") == [("g", 1, True), ("g", 2, False), ("h", 1, None)]
    gaps = checks.unexecuted_changed_lines(frame(spark, "path STRING, line INT", ("a", 1), ("a", 2), ("a", 3)), cov.select("path", "line", "executed"), ["path"])
    assert rows(gaps) == [("a", 2)]
    counts = frame(spark, "a INT, b INT", (1, 1), (1, 2), (None, 2)).select(checks.test_count_ok(F.col("a"), F.col("b")))
    assert [r[0] for r in counts.collect()] == [True, False, None]


def test_removals_and_moves(spark, rows):
    ddl = "job_id STRING, path STRING, fqn STRING"
    before = frame(spark, ddl, ("j", "a", "m.keep"), ("j", "a", "m.gone"), ("j", "a", "m.told"), ("j", "a", "m.full"))
    after = frame(spark, ddl, ("j", "a", "m.keep"), ("j", "b", "n.told"))
    declared = frame(spark, "job_id STRING, name STRING", ("j", "told"), ("j", "m.full"))
    assert rows(checks.undeclared_removals(before, after, declared, ["job_id"]), "fqn") == [("m.gone",)]
    assert rows(checks.moved_symbols(declared, after, ["job_id"]), "name") == [("told",)]


def test_cycles_of_random_plans(spark, rows):
    draw = random.Random(11)
    deps = [(f"j{j}", draw.randrange(12), draw.randrange(12)) for j in range(40) for _ in range(draw.randrange(2, 18))]
    # Two rings with a path between them, a tail into the first and one out of the second, a task that needs itself, rows with nulls.
    deps += [("two", 1, 2), ("two", 2, 1), ("two", 2, 3), ("two", 3, 4), ("two", 4, 5), ("two", 5, 4), ("two", 9, 8), ("two", 8, 1), ("two", 5, 6), ("two", 6, 7)]
    deps += [("own", 3, 3), ("own", 4, 3), ("gap", None, 1), ("gap", 1, None), (None, 1, 1)]
    want = set()
    for job in {d[0] for d in deps if None not in d}:
        reach = {(a, b) for j, a, b in deps if j == job and a is not None and b is not None}
        while more := {(a, d) for a, b in reach for c, d in reach if b == c} - reach:
            reach |= more
        want |= {(job, a) for a, b in reach if a == b}
    assert {("two", 1), ("two", 5), ("own", 3)} <= want and not {("two", 3), ("two", 8), ("two", 6)} & want
    assert rows(dependencies.cycles(frame(spark, "job_id STRING, seq INT, needs INT", *deps)), "job_id", "seq") == sorted(want, key=repr)
    assert dependencies.cycles(frame(spark, "job_id STRING, seq INT, needs INT", ("j", 2, 1), ("j", 3, 2))).isEmpty()


def test_plan_gaps(spark, rows):
    files = frame(spark, "job_id STRING, path STRING", ("j", "src/A.py"), ("j", "src/b.py"), ("j", "src/c.py"))
    got = checks.plan_gaps(files, frame(spark, "job_id STRING, path STRING", ("j", "src/c.py")), frame(spark, "job_id STRING, note STRING", ("j", "skip a.PY"), ("j", "x"), ("j", None)),
                           frame(spark, "job_id STRING, path STRING", ("j", "src/c.py"), ("j", "src/z.py")))
    assert rows(got, "path", "kind") == [("src/A.py", "call_site_declined"), ("src/b.py", "incomplete_plan"), ("src/c.py", "unmigrated_call_site")]


def test_names_in_ten_thousand_notes_of_one_job(spark, rows):
    from collections import defaultdict
    from random import Random

    draw = Random(5)
    names = [("j", draw.choice(("mod", "é", "x")) + str(draw.randrange(30_000)) + ".py") for _ in range(2_000)]
    names += [("j", n) for n in ("a", "zz", "", "q.", "ü", "mod7.py", "long12.py", "long13.py", "long14.py")] + [("k", "mod7.py"), ("k", ""), ("none", "x1.py"), ("j", None)]
    notes = [("j", f"left {draw.choice(('mod', 'é', 'xx'))}{draw.randrange(30_000)}.py alone") for _ in range(10_000)] + [("k", "mod7.p"), ("j", None), ("j", ""), ("j", "über"), ("j", "-" * 40 + "long12.py" + "-" * 90 + "long13.py")]
    of_job = defaultdict(list)
    for job, note in notes:
        of_job[job] += [note] if note is not None else []
    want = {(job, name) for job, name in names if name is not None and any(name in note for note in of_job[job])}
    named = frame(spark, "job_id STRING, name STRING", *names)
    pieces = checks.note_pieces(named, frame(spark, "job_id STRING, note STRING", *notes), block=20)
    got = named.distinct().join(pieces, ["job_id", "name"], "left_semi")
    assert rows(got, "job_id", "name") == sorted(want, key=repr) and len(want) > 100


def test_third_party_imports(spark, rows):
    files = frame(spark, "graph_id STRING, path STRING, lang STRING", ("g", "src/own/a.py", "python"), ("g", "src/b.py", "python"))
    imports = frame(spark, "graph_id STRING, path STRING, source_module STRING, resolved_path STRING, resolved_symbol STRING",
                    ("g", "src/b.py", "own.x", None, None), ("g", "src/b.py", "lib.y", None, None), ("g", "src/own/a.py", "lib", None, None), ("g", "src/b.py", "done", "x.py", None))
    assert rows(edges.third_party_imports(imports, files, F.split_part("source_module", F.lit("."), F.lit(1)))) == [("g", "lib", "python", 2)]


# ---------------------------------------------------------------- retrieval --


def test_lexical_search_equals_brute_force(spark):
    import math
    import re
    from collections import Counter

    texts = {1: "alpha beta beta gamma", 2: "alpha delta delta", 3: "beta epsilon gamma", 4: "delta epsilon zeta", 5: "zzz yyy", 6: "alpha beta"}
    asked = {10: "alpha beta", 11: "delta zeta", 12: "nothing known"}
    words = {k: Counter(re.findall(r"[A-Za-z_][A-Za-z0-9_]{2,}", v.lower())) for k, v in {**texts, **asked}.items()}
    df = Counter(w for k in texts for w in words[k])
    idf = {w: math.log(len(texts) / (1 + c)) + 1 for w, c in df.items() if 1 < c < max(2, 0.8 * len(texts))}

    def vector(k):
        return {w: n * idf[w] for w, n in words[k].items() if w in idf}

    def norm(v):
        return math.sqrt(sum(x * x for x in v.values()))

    expected = {}
    for q in asked:
        qv = vector(q)
        if qv:
            scored = []
            for k in texts:
                dv = vector(k)
                dot = sum(x * qv.get(w, 0) for w, x in dv.items())
                scored.append((-round(dot / (norm(dv) * norm(qv)) if dv else 0.0, 6), k))
            expected[q] = [(k, -s) for s, k in sorted(scored)[:3]]
    docs = spark.createDataFrame(list(texts.items()), "doc INT, text STRING")
    got = search.similar_docs(docs, spark.createDataFrame(list(asked.items()), "q INT, text STRING"), "doc", "q", k=3)
    found = {}
    for r in sorted(got.collect(), key=lambda r: (r.q, -r.score, r.doc)):
        found.setdefault(r.q, []).append((r.doc, r.score))
    assert found == expected


def test_dense_search_in_blocks(spark, monkeypatch, rows):
    import numpy as np

    rng = np.random.default_rng(1)
    m = rng.normal(size=(40, 4))
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "id INT, embedding ARRAY<DOUBLE>").repartition(3)
    whole = rows(search.similar_vectors(df, df.withColumnRenamed("id", "q"), "id", "q", k=3))
    monkeypatch.setattr(search, "BLOCK_ROWS", 7)
    monkeypatch.setattr(search, "CELLS", 35)
    assert rows(search.similar_vectors(df, df.withColumnRenamed("id", "q"), "id", "q", k=3)) == whole
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    best = np.argsort(-np.round(unit @ unit.T, 6), axis=1, kind="stable")[:, :3]
    assert {(r[0], r[1]) for r in whole} == {(q, int(i)) for q in range(40) for i in best[q]}


def test_dense_search_holds_the_best_of_each_query_only(spark, monkeypatch):
    import tracemalloc

    class Vectors:
        """Takes the tasks' function instead of running it."""

        dtypes = [("id", "bigint"), ("score", "double")]

        def mapInPandas(self, run, schema):
            self.run = run
            return self

        def drop(self, *names):
            return self

    monkeypatch.setattr(search, "first_rows", lambda df, *_: df)
    queries = spark.range(1000).selectExpr("id AS q")
    # Scores of 0 to 96; the lower ids come last, so that ties must replace what is held.
    scores = lambda batch, block: ((batch["id"].to_numpy()[:, None] * 31 + block["q"].to_numpy()[None, :]) % 97).astype(float)
    task = search._top_k(Vectors(), queries, "id", "q", 3, scores)
    ids = np.arange(1500)[::-1].reshape(150, 10)
    tracemalloc.start()
    got = pd.concat(task.run(pd.DataFrame({"id": part}) for part in ids))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # 1,000 queries have 3,000 best answers, 72 kB, whatever the number of batches.
    assert peak < 4_000_000
    every = np.arange(1500)
    for q, best in got.groupby("q"):
        order = np.lexsort((every, -((every * 31 + q) % 97)))[:3]
        assert list(best["id"]) == list(order)
    assert len(got) == 3000


@pytest.mark.parametrize("most", [1, 50, 10_000])
def test_dense_search_sends_on_what_it_cannot_hold(spark, monkeypatch, rows, most):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(60, 4)))], "id INT, embedding ARRAY<DOUBLE>").repartition(2)
    whole = rows(search.similar_vectors(df, df.withColumnRenamed("id", "q"), "id", "q", k=2))
    monkeypatch.setattr(search, "BLOCK_ROWS", 7)
    monkeypatch.setattr(search, "CELLS", 35)
    monkeypatch.setattr(search, "HELD_ROWS", most)
    assert rows(search.similar_vectors(df, df.withColumnRenamed("id", "q"), "id", "q", k=2)) == whole and len(whole) == 120


def test_embedder_of_the_caller(spark, rows):
    docs = spark.createDataFrame([(1, "ab"), (2, None)], "id INT, text STRING")
    got = search.embed(docs, lambda texts: [[float(len(t)), 1.0] for t in texts])
    assert rows(got, "id", "embedding") == [(1, [2.0, 1.0]), (2, [0.0, 1.0])]


# ------------------------------------------------------------------ schemas --


def test_schemas_evolve_and_check(spark):
    old = frame(spark, "task_id STRING, job_id STRING, seq INT", ("t", "j", 1))
    new = conform(old, "task")
    assert new.schema.fieldNames() == schema_of("task").fieldNames() and new.first().kind == "refactor"
    bad = frame(spark, "graph_id STRING, test_path STRING, symbol STRING, nodeid STRING, source STRING", ("g", "t", "s", "n", "hearsay"))
    with pytest.raises(Exception, match="hearsay"):
        checked(bad, "test_edge").collect()


def test_common_terms_are_added_up_in_slices():
    import tracemalloc

    # 200 documents and 200 queries share 200 terms: 8 million meetings, 40,000 cells.
    drawn = np.random.default_rng(1).random((400, 200)) + 0.1
    rows = pd.DataFrame({"at": [np.arange(200)] * 400, "w": list(drawn)})
    tracemalloc.start()
    got = search.cosines(rows[:200], rows[200:])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    unit = drawn / np.sqrt((drawn * drawn).sum(axis=1))[:, None]
    assert np.allclose(got, unit[:200] @ unit[200:].T)
    assert peak < 60_000_000


def test_retrieval_shuffles_texts_not_their_terms(spark, rows):
    docs = spark.createDataFrame([(1, "apple pear apple"), (2, "pear plum"), (3, None), (4, "apple plum plum"), (4, "plum"), (5, "of")] + [(i, "w%d" % i) for i in range(6, 12)], "doc INT, text STRING")
    counted = search._counted(docs, "doc")
    got = {r.doc: (sorted(r.tf), r.copies) for r in counted.collect()}
    assert got[1] == ([1, 2], 1) and got[3] == ([], 1) and got[4] == ([1, 3], 2) and len(got) == 11
    plan = search._counted(docs, "doc")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1
    top = rows(search.similar_docs(docs, spark.createDataFrame([(1, "plum"), (2, "zzz")], "q INT, text STRING"), "doc", "q", k=2), "q", "doc")
    assert top == [(1, 4), (1, 4)]


def test_frequent_and_rare_terms_score_alike(monkeypatch):
    # Terms in two of three rows and terms in few rows; every way of adding them up gives the plain products.
    rng = np.random.default_rng(3)
    held = [np.flatnonzero(np.r_[rng.random(30) < 0.7, rng.random(400) < 0.02]) for _ in range(90)]
    rows = pd.DataFrame({"at": held, "w": [rng.random(len(a)) + 0.1 for a in held]})
    rows.loc[4, "at"], rows.loc[4, "w"] = np.zeros(0, np.int64), np.zeros(0)
    whole = np.zeros((90, 430))
    for i, (a, w) in enumerate(zip(rows["at"], rows["w"], strict=True)):
        whole[i, a] = w / np.sqrt(w @ w) if len(w) else w
    for dense, columns, hits in ((2, 512, 50), (0, 7, 50), (1 / 10, 11, 1000)):
        monkeypatch.setattr(search, "DENSE", dense)
        monkeypatch.setattr(search, "COLUMNS", columns)
        monkeypatch.setattr(search, "HITS", hits)
        assert np.allclose(search.cosines(rows[:50], rows[50:]), whole[:50] @ whole[50:].T)


def test_a_block_of_queries_is_read_once_for_a_batch(spark, monkeypatch):
    class Vectors:
        dtypes = [("id", "bigint")]

        def mapInPandas(self, run, schema):
            self.run = run
            return self

        def drop(self, *names):
            return self

    made = []

    def ready(rows):
        made.append(len(rows))
        return rows

    monkeypatch.setattr(search, "first_rows", lambda df, *_: df)
    monkeypatch.setattr(search, "BLOCK_ROWS", 10)
    monkeypatch.setattr(search, "CELLS", 50)
    blocks = [pd.DataFrame({"q": np.arange(i, i + 10)}) for i in range(0, 100, 10)]
    monkeypatch.setattr(search, "_blocks", lambda path: iter(blocks))
    task = search._top_k(Vectors(), spark.range(1).selectExpr("id AS q"), "id", "q", 1, lambda a, b: -np.abs(a["id"].to_numpy()[:, None] - b["q"].to_numpy()[None, :]).astype(float), ready)
    got = pd.concat(task.run(iter([pd.DataFrame({"id": np.arange(100)})])))
    assert list(got["id"]) == list(got["q"]) == list(range(100))
    # 20 parts of the batch; the ten blocks (and nine to see that they are too many) once, not once a part.
    assert len(made) == 20 + 10 + 9


def test_equal_texts_are_scored_once_and_all_answer(spark, rows, monkeypatch):
    import math
    from collections import Counter

    texts = ["apple pear", "pear apple", "plum fig fig", "apple pear", "fig plum fig", "apple plum", "pear fig kiwi", "kiwi apple", "apple pear", ""]
    docs = [(i * 5 % 31, texts[i % 10]) for i in range(30)] + [(35, "apple pear"), (35, ""), (36, "apple fig")]
    asked = [(100 + i, docs[i][1], docs[i][0]) for i in range(0, 30, 2)] + [(200, "kiwi", None), (201, "apple pear", 35)]
    by_key = {}
    for i, t in docs:
        by_key.setdefault(i, []).extend(t.split())
    n, df = len(docs), Counter(w for ws in by_key.values() for w in set(ws))
    idf = {w: math.log(n / (1 + c)) + 1 for w, c in df.items() if 1 < c < max(2, 0.8 * n)}

    def unit(words):
        v = {w: c * idf[w] for w, c in Counter(words).items() if w in idf}
        return {w: x / math.sqrt(sum(y * y for y in v.values())) for w, x in v.items()}

    want = []
    for q, text, own in asked:
        qv = unit(text.split())
        scored = sorted((-round(sum(x * qv.get(w, 0) for w, x in unit(by_key[i]).items()), 6), i) for i, _ in docs if i != own)
        want += [(q, i, -s) for s, i in scored[:3]] if qv else []
    df_docs, df_asked = spark.createDataFrame(docs, "doc INT, text STRING"), spark.createDataFrame(asked, "q INT, text STRING, own INT")
    tables, top_k = [], search._top_k
    monkeypatch.setattr(search, "_top_k", lambda vectors, queries, *rest: tables.append((vectors.count(), queries.count())) or top_k(vectors, queries, *rest))
    got = rows(search.similar_docs(df_docs, df_asked, "doc", "q", k=3, exclude="own"), "q", "doc", "score")
    assert [(q, i, round(s, 6) + 0.0) for q, i, s in sorted(got)] == sorted((q, i, s + 0.0) for q, i, s in want)
    bags = {tuple(sorted(words)) for words in by_key.values()}
    assert tables == [(len(bags), len({tuple(sorted(t.split())) for _, t, _ in asked if unit(t.split())}))] and len(bags) == 7
