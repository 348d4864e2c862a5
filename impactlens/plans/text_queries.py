"""Texts, findings, line changes and retrieval on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from impactlens.functions import secrets as sec
from impactlens.functions import text as tx
from impactlens.operators import checks, cleanup, edges, linediff, sampling, search
from impactlens.plans import bindings as b
from impactlens.plans.registry import query
from impactlens.sources import artifacts
from impactlens.sources.tree import graph_key as key_of

SPACE = r"[\t\n\x0B\f\r\x{85}\p{Z}]+"


@query("SELECT doc_id, sha256(text) AS digest, lang || '/' || source || '/' || doc_id || '.txt' AS path FROM documents")
def doc_digest(spark, d):
    return b.documents(spark, d).select(
        "doc_id", F.sha2("text", 256).alias("digest"),
        F.concat(F.concat_ws("/", "lang", "source", F.col("doc_id").cast("string")), F.lit(".txt")).alias("path"),
    )


@query("SELECT DISTINCT substr(sha256(source || '@' || lang), 1, 24) AS graph_id, source, lang FROM documents")
def graph_key(spark, d):
    docs = b.documents(spark, d).select("source", "lang").distinct()
    return docs.select(key_of("source", "lang").alias("graph_id"), "source", "lang")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def json_props(spark, d):
    return b.table(spark, d, "events").select("event_id", F.from_json("props", "k INT")["k"].alias("k"))


@query(rf"""WITH cut AS (SELECT doc_id, instr(text, 'token') AS spot, text FROM documents),
rest AS (SELECT doc_id, spot, substr(text, spot + 5) AS rest FROM cut)
SELECT doc_id, CASE WHEN spot = 0 THEN '' ELSE regexp_replace(regexp_replace(
  CASE WHEN instr(rest, '###') > 0 THEN substr(rest, 1, instr(rest, '###') - 1) ELSE rest END, '^{SPACE}', ''), '{SPACE}$', '') END AS block FROM rest""")
def fenced_block(spark, d):
    return b.documents(spark, d).select("doc_id", tx.fenced_block("text", "token", "###").alias("block"))


@query("""WITH idx AS (SELECT doc_id, sha256(replace(text, ' the ', ' that ')) AS sha256 FROM documents),
stored AS (SELECT doc_id, sha256(text) AS found FROM documents WHERE lang <> 'de')
SELECT i.doc_id, s.found IS NOT NULL AS present, coalesce(s.found = i.sha256, false) AS intact FROM idx i LEFT JOIN stored s ON i.doc_id = s.doc_id""")
def artifact_intact(spark, d):
    docs = b.documents(spark, d)
    index = docs.select("doc_id", F.sha2(F.replace("text", F.lit(" the "), F.lit(" that ")), 256).alias("sha256"))
    files = docs.filter(F.col("lang") != "de").select("doc_id", F.encode("text", "UTF-8").alias("content"))
    return artifacts.artifact_manifest(index, files, ["doc_id"]).drop("sha256")


@query(r"""WITH h AS (SELECT page_id, regexp_extract_all(html, '<a[^>]*[ \t\n]href="([^"]*)"', 1) AS hrefs FROM pages)
SELECT page_id, unnest(hrefs) AS href, CAST(unnest(range(len(hrefs))) AS INTEGER) AS ord FROM h""")
def page_links(spark, d):
    return artifacts.page_links(b.table(spark, d, "pages"), "page_id")


@query(f"""WITH f AS (SELECT page_id, {b.URL_PATH} AS path FROM pages),
stem AS (SELECT page_id, regexp_replace(path, '([^/.][^/]*)\\.[^./]*$', '\\1') AS stem FROM f)
SELECT page_id, array_to_string(list_filter([replace(regexp_replace(stem, '(^|/)__init__$', ''), '/', '.'), 'page' || page_id], lambda x: x <> ''), '.') AS fqn FROM stem""")
def dotted_name(spark, d):
    name = b.tag("page", "page_id")
    return b.page_file(spark, d).select("page_id", tx.join_name(tx.module_name("path"), F.lit(""), name).alias("fqn"))


@query(r"""WITH p AS (SELECT page_id, CASE WHEN url LIKE 'https%' THEN './work/' ELSE '..\work\' END || replace(regexp_replace(url, '^[a-z]+:', ''), '//', '\') AS raw FROM pages)
SELECT page_id, regexp_replace(regexp_replace(replace(raw, '\', '/'), '^[./]+', ''), '^work/', '') AS path FROM p""")
def norm_path(spark, d):
    head = F.when(F.startswith("url", F.lit("https")), "./work/").otherwise("..\\work\\")
    raw = F.concat(head, F.replace(F.regexp_replace("url", "^[a-z]+:", ""), F.lit("//"), F.lit("\\")))
    return b.table(spark, d, "pages").select("page_id", tx.normalise_path(raw).alias("path"))


@query(rf"""SELECT doc_id, rtrim(trim(regexp_replace(text, '{SPACE}', ' ', 'g'), ' '), '{{:( ') AS signature FROM documents""")
def norm_text(spark, d):
    return b.documents(spark, d).select("doc_id", tx.signature_text("text").alias("signature"))


@query(r"""SELECT page_id, lower(trim(regexp_replace(url, '[^\p{L}\p{N}]', '_', 'g'), '_')) AS slug FROM pages""")
def slug(spark, d):
    return b.table(spark, d, "pages").select("page_id", tx.slug("url").alias("slug"))


TITLE = r"regexp_extract(html, '<title>([^<]*)</title>', 1)"


@query(rf"""WITH t AS (SELECT page_id, url, regexp_replace(trim(regexp_replace(regexp_replace({TITLE}, '[\[\]()<>`|\\@]', '', 'g'), '{SPACE}', ' ', 'g'), ' '), '([*_])', '\\\1', 'g') AS title FROM pages)
SELECT page_id, CASE WHEN regexp_matches(url, '^https?://[^\s()<>\[\]`]+$') THEN '[' || CASE WHEN title = '' THEN 'untitled' ELSE title END || '](' || url || ')'
  ELSE CASE WHEN title = '' THEN 'untitled' ELSE title END || ' [no http(s) address]' END AS link FROM t""")
def safe_link(spark, d):
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    return b.table(spark, d, "pages").select("page_id", tx.safe_link(title, "url").alias("link"))


@query(r"""WITH m AS (SELECT DISTINCT split_part(regexp_replace(url, '^[a-z]+://', ''), '?', 1) AS m FROM pages)
SELECT m AS module, CASE WHEN split_part(m, '/', 1) NOT IN ('http', 'url', 'path', 'net', 'os', 'fs') THEN split_part(m, '/', 1) END AS package FROM m""")
def package_of(spark, d):
    module = F.split_part(F.regexp_replace("url", "^[a-z]+://", ""), F.lit("?"), F.lit(1))
    return b.table(spark, d, "pages").select(module.alias("module")).distinct().select(
        "module", tx.package_of("module", "typescript").alias("package")
    )


@query(rf"""WITH h AS (SELECT page_id, regexp_extract_all(html, '<a[^>]*[ \t\n]href="([^"]*)"', 1) AS hrefs FROM pages),
link AS (SELECT page_id, unnest(hrefs) AS href FROM h),
pkg AS (SELECT page_id, CASE WHEN regexp_matches(href, '^([./~#]|@/)') OR href LIKE '%:%' OR href = '' THEN NULL ELSE split_part(href, '/', 1) END AS package FROM
  (SELECT page_id, regexp_replace(regexp_replace(href, '^https?://', ''), '^/', '') AS href FROM link)),
own AS (SELECT DISTINCT split_part(part, '.', 1) AS package FROM (SELECT unnest(string_split({b.URL_PATH}, '/')) AS part FROM pages))
SELECT package, count(DISTINCT page_id) AS files FROM pkg WHERE package IS NOT NULL AND package NOT IN (SELECT package FROM own)
  AND package NOT IN ('assert','buffer','child_process','crypto','dns','events','fs','http','https','net','os','path','process','readline','stream','timers','tls','url','util','worker_threads','zlib')
GROUP BY package""")
def rare_hosts(spark, d):
    # Every page is a file of its own, though two may share a path: its number, as an ending, tells them apart and adds no part.
    ending = F.concat(F.coalesce("path", F.lit("")), F.lit("."), F.col("page_id").cast("string"))
    pages = b.page_file(spark, d).withColumn("path", ending)
    links = artifacts.page_links(b.table(spark, d, "pages"), "page_id").join(pages.select("page_id", "path"), "page_id")
    module = F.regexp_replace(F.regexp_replace("href", "^https?://", ""), "^/", "")
    none = F.lit(None).cast("string")
    imports = links.select(b.graph(), "path", module.alias("source_module"), none.alias("resolved_path"), none.alias("resolved_symbol"))
    files = pages.select("graph_id", "path", F.lit("typescript").alias("lang"))
    found = edges.third_party_imports(imports, files, tx.package_of("source_module", "typescript"))
    return found.select("package", "files")


# ----------------------------------------------------------------- findings --

ASSIGN = sec.ASSIGNMENT.replace("'", "''")
PLACEHOLDERS = ", ".join(f"'{p}'" for p in sec.PLACEHOLDERS)
SHAPED = " UNION ALL ".join(
    f"SELECT doc_id, lang, source, line_no, '{rule}' AS rule, '{sec.SHAPED_MESSAGE}' AS message, text FROM line WHERE regexp_matches(text, '{shape}')"
    for rule, shape in sec.TOKEN_SHAPES
)
SECRET = rf"""{b.LINE},
assigned AS (SELECT *, regexp_extract(text, '{ASSIGN}', 2) || regexp_extract(text, '{ASSIGN}', 3) AS value, regexp_extract(text, '{ASSIGN}', 1) AS key FROM line WHERE regexp_matches(text, '{ASSIGN}')),
letter AS (SELECT value, unnest(string_split(value, '')) AS ch FROM (SELECT DISTINCT value FROM assigned)),
share AS (SELECT value, ch, count(*) * 1.0 / length(value) AS p FROM letter GROUP BY value, ch),
entropy AS (SELECT value, -sum(p * log2(p)) AS bits FROM share GROUP BY value),
secret AS (
  {SHAPED}
  UNION ALL
  SELECT doc_id, lang, source, line_no, 'secret.hardcoded_credential', '{sec.ASSIGNED_MESSAGE}' || key, text FROM assigned JOIN entropy USING (value)
  WHERE round(bits, 9) >= 3.0 AND lower(trim(value)) NOT IN ({PLACEHOLDERS}) AND NOT (value LIKE '%{{%' AND value LIKE '%}}%') AND NOT regexp_matches(lower(trim(value)), '^[a-z_]+$')
)"""
SNIPPET = r"regexp_replace(regexp_replace(text, '^[\t-\r\x{85}\p{Z}]+', ''), '[\t-\r\x{85}\p{Z}]+$', '')"
BLANKED = rf"""regexp_replace(trim(regexp_replace({SNIPPET}, '{SPACE}', ' ', 'g'), ' '), '''[^''\n]*''|"[^"\n]*"', '''''', 'g')"""


def _finding_sql(rows: str, path: str) -> str:
    return f"SELECT *, substr(sha256(rule || ':' || {path} || ':' || {BLANKED}), 1, 16) AS fingerprint FROM {rows}"


@query(f"WITH {SECRET} SELECT doc_id, line_no, rule, message, {SNIPPET} AS snippet FROM secret")
def secrets(spark, d):
    return sec.secret_rules(b.line(spark, d)).select("doc_id", "line_no", "rule", "message", "snippet")


@query(f"WITH {b.LINE} SELECT doc_id, line_no, fingerprint FROM ({_finding_sql('(SELECT *, $$text.line$$ AS rule FROM line)', 'lang')})")
def fingerprint(spark, d):
    return b.line(spark, d).select(
        "doc_id", "line_no", sec.fingerprint(F.lit("text.line"), "lang", sec.squash_ends(F.col("text"))).alias("fingerprint")
    )


def _findings(lines, digits):
    """Secrets, and every line that holds a digit, as findings whose path is the language."""
    columns = ["lang", "source", "doc_id", "line_no", "rule", "snippet"]
    numbers = lines.filter(F.col("text").rlike(digits)).withColumn("rule", F.lit("text.digits")).withColumn(
        "snippet", sec.squash_ends(F.col("text"))
    )
    return sec.secret_rules(lines).select(*columns).unionByName(numbers.select(*columns)).withColumn("path", F.col("lang"))


OLD_SOURCE = "CAST(substr(source, 4) AS INTEGER) < 10"


@query(f"""WITH {SECRET}, found AS (
  SELECT doc_id, lang, source, line_no, rule, text FROM secret UNION ALL SELECT doc_id, lang, source, line_no, 'text.digits', text FROM line WHERE regexp_matches(text, '[0-9]')),
printed AS ({_finding_sql('found', 'lang')})
SELECT doc_id, line_no, rule, fingerprint FROM printed WHERE NOT ({OLD_SOURCE})
  AND fingerprint NOT IN (SELECT fingerprint FROM printed WHERE {OLD_SOURCE})""")
def new_findings(spark, d):
    found = _findings(b.line(spark, d), "[0-9]").withColumn("graph_id", F.lit(b.GRAPH))
    old = F.substring("source", F.lit(4), F.length("source")).cast("int") < 10
    fresh = checks.new_findings(found.filter(old), found.filter(~old), ["graph_id"])
    return fresh.select("doc_id", "line_no", "rule", "fingerprint")


@query(f"""WITH {SECRET}, found AS (
  SELECT doc_id, lang, source, line_no, rule, text FROM secret UNION ALL SELECT doc_id, lang, source, line_no, 'text.digits', text FROM line WHERE regexp_matches(text, '[0-9]')),
printed AS ({_finding_sql('found', 'lang')}),
fresh AS (SELECT lang FROM printed p WHERE NOT ({OLD_SOURCE}) AND NOT EXISTS (SELECT 1 FROM printed q WHERE {OLD_SOURCE.replace('source', 'q.source')} AND q.lang = p.lang AND q.fingerprint = p.fingerprint)),
side AS (SELECT lang, count_if({OLD_SOURCE}) AS files_before, count_if(NOT ({OLD_SOURCE})) AS files_after FROM documents GROUP BY lang)
SELECT lang, files_before, files_after, (SELECT count(*) FROM printed p WHERE p.lang = s.lang AND {OLD_SOURCE}) AS baseline_findings,
  (SELECT count(*) FROM printed p WHERE p.lang = s.lang AND NOT ({OLD_SOURCE})) AS result_findings, (SELECT count(*) FROM fresh f WHERE f.lang = s.lang) AS introduced,
  CASE WHEN files_before = 0 OR files_after = 0 THEN 'inconclusive' WHEN (SELECT count(*) FROM fresh f WHERE f.lang = s.lang) > 0 THEN 'security' ELSE 'ok' END AS verdict
FROM side s""")
def findings_status(spark, d):
    found = _findings(b.line(spark, d), "[0-9]")
    old = F.substring("source", F.lit(4), F.length("source")).cast("int") < 10
    before, after = found.filter(old), found.filter(~old)
    scanned = b.documents(spark, d).select("lang", F.when(old, "before").otherwise("after").alias("side"))
    return checks.findings_status(scanned, before, after, checks.new_findings(before, after, ["lang"]), ["lang"])


@query("""WITH letter AS (SELECT doc_id, length(text) AS n, unnest(string_split(text, '')) AS ch FROM documents),
share AS (SELECT doc_id, ch, count(*) * 1.0 / any_value(n) AS p FROM letter GROUP BY doc_id, ch)
SELECT doc_id, round(-sum(p * log2(p)), 6) AS bits FROM share GROUP BY doc_id""")
def entropy(spark, d):
    bits = sec.text_entropy(b.documents(spark, d), ["doc_id"])
    return bits.select("doc_id", F.round("bits", 6).alias("bits"))


@query(f"""WITH {b.LINE}, sev AS (SELECT lang, source, CASE WHEN regexp_matches(text, '@') THEN 'block' WHEN regexp_matches(text, '[0-9]') THEN 'warn' ELSE 'info' END AS severity FROM line)
SELECT lang, source, count_if(severity = 'block') AS blocks, count_if(severity = 'warn') AS warnings, count(*) AS findings, bool_or(severity = 'block') AS blocked FROM sev GROUP BY 1, 2""")
def severity(spark, d):
    kind = F.when(F.contains("text", F.lit("@")), "block").when(F.col("text").rlike("[0-9]"), "warn").otherwise("info")
    return checks.severity_counts(b.line(spark, d).withColumn("severity", kind), ["lang", "source"])


# ------------------------------------------------------------- line changes --

DELTA = f"""{b.LINE}, {b.NEW_LINE},
o AS (SELECT doc_id, text, line_no, row_number() OVER (PARTITION BY doc_id, text ORDER BY line_no) AS copy FROM line),
n AS (SELECT doc_id, text, line_no, row_number() OVER (PARTITION BY doc_id, text ORDER BY line_no) AS copy FROM new_line),
delta AS (SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, CASE WHEN n.doc_id IS NULL THEN 'before' ELSE 'after' END AS side, coalesce(o.line_no, n.line_no) AS line
  FROM o FULL JOIN n ON o.doc_id = n.doc_id AND o.text = n.text AND o.copy = n.copy WHERE o.doc_id IS NULL OR n.doc_id IS NULL)"""


def _delta(spark, d):
    return linediff.line_delta(
        b.line(spark, d).select("doc_id", "line_no", "text"), b.new_line(spark, d).select("doc_id", "line_no", "text"), ["doc_id"]
    )


@query(f"WITH {DELTA} SELECT doc_id, side, line FROM delta")
def line_delta(spark, d):
    return _delta(spark, d)


@query(f"""WITH {DELTA}, chg AS (SELECT DISTINCT doc_id, line FROM delta WHERE side = 'after'),
isl AS (SELECT doc_id, line, line - row_number() OVER (PARTITION BY doc_id ORDER BY line) AS g FROM chg)
SELECT doc_id, min(line) AS first, max(line) AS last FROM isl GROUP BY doc_id, g""")
def line_runs(spark, d):
    changed = _delta(spark, d).filter(F.col("side") == "after")
    return sampling.line_runs(changed, ["doc_id"], bounded=True)


@query("""WITH g AS (SELECT lang, source FROM documents GROUP BY 1, 2),
p AS (SELECT lang, source, row_number() OVER (PARTITION BY lang ORDER BY source) AS rn, count(*) OVER (PARTITION BY lang) AS n FROM g)
SELECT lang, source, 50 // n + CASE WHEN rn <= 50 % n THEN 1 ELSE 0 END AS share FROM p""")
def quotas(spark, d):
    groups = b.documents(spark, d).select("lang", "source").distinct()
    return sampling.quotas(groups, ["lang"], [F.col("source")], 50)


@query(f"""WITH {b.LINE}, p AS (SELECT doc_id, line_no, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) - 1 AS spot, count(*) OVER (PARTITION BY doc_id) AS n FROM line)
SELECT doc_id, line_no FROM p WHERE n <= 5 OR len(list_filter(range(5), lambda i: round_even(i * (n - 1) / 4.0, 0) = spot)) > 0""")
def even_sample(spark, d):
    lines = b.line(spark, d).select("doc_id", "line_no")
    return sampling.even_sample(lines, ["doc_id"], [F.col("line_no")], 5, bounded=True)


# Numbers of an even sample of k out of n rows in order, from 0.
SPOTS = "CASE WHEN {k} >= {n} THEN range(CAST({n} AS BIGINT)) ELSE list_transform(range(CAST({k} AS BIGINT)), lambda i: CAST(round_even(i * ({n} - 1) / greatest({k} - 1, 1.0), 0) AS BIGINT)) END"


@query(f"""WITH {DELTA}, chg AS (SELECT DISTINCT g.lang, g.source, d.doc_id AS path, d.line FROM delta d JOIN documents g ON g.doc_id = d.doc_id WHERE d.side = 'after'),
f AS (SELECT lang, source, path, row_number() OVER w - 1 AS spot, count(*) OVER (PARTITION BY lang, source) AS n FROM (SELECT DISTINCT lang, source, path FROM chg) WINDOW w AS (PARTITION BY lang, source ORDER BY path)),
drawn AS (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY path) AS k, count(*) OVER (PARTITION BY lang, source) AS m FROM f WHERE list_contains({SPOTS.format(n='n', k=30)}, spot)),
share AS (SELECT path, 30 // m + CASE WHEN k <= 30 % m THEN 1 ELSE 0 END AS share FROM drawn),
isl AS (SELECT *, line - row_number() OVER (PARTITION BY path ORDER BY line) AS run FROM chg),
per AS (SELECT i.*, s.share, count(DISTINCT run) OVER (PARTITION BY i.path) AS runs, row_number() OVER (PARTITION BY i.path, run ORDER BY line) - 1 AS spot, count(*) OVER (PARTITION BY i.path, run) AS n FROM isl i JOIN share s ON s.path = i.path),
given AS (SELECT lang, source, path, line, share FROM per WHERE list_contains({SPOTS.format(n='n', k='greatest(1, share // runs)')}, spot)),
cut AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY line) - 1 AS spot, count(*) OVER (PARTITION BY path) AS n FROM given)
SELECT lang, source, path, line FROM cut WHERE list_contains({SPOTS.format(n='n', k='share')}, spot)""")
def sample_changed(spark, d):
    # Languages and sources stand for jobs, texts for their files; 30 lines of each.
    homes = b.documents(spark, d).select("doc_id", "lang", "source").distinct()
    changed = _delta(spark, d).filter(F.col("side") == "after").join(homes, "doc_id").select("lang", "source", F.col("doc_id").alias("path"), "line")
    return sampling.sample_changed(changed, ["lang", "source"], 30)


@query(f"""WITH {DELTA}, chg AS (SELECT DISTINCT doc_id, line FROM delta WHERE side = 'before'), site AS (SELECT doc_id, line_no AS line FROM line WHERE regexp_matches(text, 'the'))
SELECT s.doc_id, count(*) AS sites, count(c.line) AS changed FROM site s LEFT JOIN chg c ON c.doc_id = s.doc_id AND c.line = s.line GROUP BY s.doc_id""")
def sites_changed(spark, d):
    sites = b.line(spark, d).filter(F.contains("text", F.lit("the"))).select("doc_id", F.col("line_no").alias("line"))
    changed = _delta(spark, d).filter(F.col("side") == "before")
    return checks.call_sites_changed(sites, changed, ["doc_id"]).groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("sites"), F.count_if("changed").alias("changed")
    )


@query(f"""WITH {DELTA}, cov AS (SELECT doc_id, line_no AS line, regexp_matches(text, 'w') AS executed FROM new_line WHERE length(text) > 40)
SELECT DISTINCT x.doc_id, x.line FROM delta x JOIN cov ON cov.doc_id = x.doc_id AND cov.line = x.line WHERE side = 'after' AND NOT executed""")
def unexecuted_lines(spark, d):
    coverage = b.new_line(spark, d).filter(F.length("text") > 40).select(
        "doc_id", F.col("line_no").alias("line"), F.contains("text", F.lit("w")).alias("executed")
    )
    return checks.unexecuted_changed_lines(_delta(spark, d).filter(F.col("side") == "after"), coverage, ["doc_id"])


@query("""SELECT doc_id, CASE WHEN lang <> 'es' THEN replace(text, ' the ', ' that ') ELSE text END AS text, lang <> 'es' AS replaced FROM documents""")
def overlay(spark, d):
    docs = b.documents(spark, d)
    patched = docs.filter(F.col("lang") != "es").select("doc_id", F.replace("text", F.lit(" the "), F.lit(" that ")).alias("text"))
    return edges.overlay(docs, patched, ["doc_id"])


WORDS = r"regexp_extract_all(lower(text), '[A-Za-z_][A-Za-z0-9_]{2,}')"


@query(f"""WITH {b.LINE}, word AS (SELECT doc_id, lang, source, line_no, unnest({WORDS}) AS name FROM line),
def AS (SELECT DISTINCT lang, source AS path, name FROM word WHERE line_no = 1),
ref AS (SELECT lang, source AS path, name, line_no % 2 = 0 AS in_code FROM word WHERE line_no > 1),
uses AS (SELECT lang, name, bool_or(in_code) AS in_code, min(path) AS lo, max(path) AS hi FROM ref GROUP BY 1, 2),
pub AS (SELECT DISTINCT unnest({WORDS}) AS name FROM benchmark),
cov AS (SELECT DISTINCT w.lang, w.source AS path, w.name FROM word w JOIN labels l USING (doc_id) WHERE quality = 1 AND line_no = 1),
loose AS (SELECT DISTINCT unnest({WORDS}) AS name FROM conversations WHERE role = 'system')
SELECT d.lang AS graph_id, d.path, d.name FROM def d LEFT JOIN uses u ON u.lang = d.lang AND u.name = d.name
WHERE (u.name IS NULL OR (NOT u.in_code AND u.lo = d.path AND u.hi = d.path)) AND d.name NOT IN (SELECT name FROM pub) AND d.name NOT IN (SELECT name FROM loose)
  AND NOT EXISTS (SELECT 1 FROM cov c WHERE c.lang = d.lang AND c.path = d.path AND c.name = d.name) AND d.lang <> 'fr'""")
def orphans(spark, d):
    words = b.line(spark, d).select("doc_id", F.col("lang").alias("graph_id"), F.col("source").alias("path"), "line_no", F.explode(tx.tokenise("text")).alias("name"))
    defs = words.filter(F.col("line_no") == 1).select("graph_id", "path", "name").distinct()
    refs = words.filter(F.col("line_no") > 1).select("graph_id", "path", "name", (F.col("line_no") % 2 == 0).alias("in_code"))
    public = b.table(spark, d, "benchmark").select(F.explode(tx.tokenise("text")).alias("name")).distinct()
    loose = b.table(spark, d, "conversations").filter(F.col("role") == "system").select(F.explode(tx.tokenise("text")).alias("name")).distinct()
    good = b.table(spark, d, "labels").filter(F.col("quality") == 1).select("doc_id").distinct()
    covered = words.filter(F.col("line_no") == 1).join(good, "doc_id", "left_semi").select("graph_id", "path", "name").distinct()
    exported = defs.join(public, "name", "left_semi")
    loose_here = defs.join(loose, "name", "left_semi").select("graph_id", "name")
    errors = b.documents(spark, d).filter(F.col("lang") == "fr").select(F.col("lang").alias("graph_id"))
    return cleanup.orphaned_symbols(defs, refs, exported, covered, loose_here, errors).select("graph_id", "path", "name")


@query(f"""WITH {b.LINE}, word AS (SELECT doc_id, line_no, unnest({WORDS}) AS name FROM line),
bound AS (SELECT DISTINCT doc_id, name FROM word WHERE line_no = 1), used AS (SELECT DISTINCT doc_id, name FROM word WHERE line_no > 1)
SELECT CAST(doc_id AS VARCHAR) AS path, name FROM (SELECT * FROM bound EXCEPT SELECT * FROM used)
WHERE name NOT LIKE '\\_%' ESCAPE '\\' AND doc_id IN (SELECT doc_id FROM documents WHERE text NOT LIKE '%###%')""")
def unused_imports(spark, d):
    words = b.line(spark, d).select(b.graph(), F.col("doc_id").cast("string").alias("path"), "line_no", F.explode(tx.tokenise("text")).alias("name"))
    stars = b.documents(spark, d).filter(F.contains("text", F.lit("###"))).select(b.graph(), F.col("doc_id").cast("string").alias("path"))
    bound, refs = words.filter(F.col("line_no") == 1), words.filter(F.col("line_no") > 1)
    return cleanup.unused_imports(bound, refs, words.limit(0), stars).select("path", "name")


# ---------------------------------------------------------------- retrieval --


@query(rf"""WITH word AS (SELECT DISTINCT doc_id, unnest({WORDS}) AS term FROM documents)
SELECT term, count(*) AS df FROM word GROUP BY term""")
def doc_freq(spark, d):
    return search.doc_freq(search.term_counts(b.documents(spark, d), "doc_id"))


@query(rf"""WITH tok AS (SELECT doc_id, unnest({WORDS}) AS term FROM documents), tf AS (SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY 1, 2),
n AS (SELECT count(*) AS n FROM documents),
vocab AS (SELECT term, ln(n / (1.0 + df)) + 1.0 AS idf FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), n WHERE df > 1 AND df < greatest(2, n * 0.8)),
w AS (SELECT doc_id, term, tf * idf AS w FROM tf JOIN vocab USING (term)), dn AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM w GROUP BY 1),
qt AS (SELECT item_id, unnest({WORDS}) AS term FROM benchmark), q AS (SELECT item_id, term, count(*) * any_value(idf) AS qw FROM qt JOIN vocab USING (term) GROUP BY 1, 2),
qn AS (SELECT item_id, sqrt(sum(qw * qw)) AS qnorm FROM q GROUP BY 1),
dot AS (SELECT item_id, doc_id, sum(w * qw) AS dot FROM w JOIN q USING (term) GROUP BY 1, 2),
score AS (SELECT qn.item_id, d.doc_id, round(coalesce(dot / (norm * qnorm), 0), 6) AS score FROM qn CROSS JOIN documents d LEFT JOIN dn USING (doc_id) LEFT JOIN dot ON dot.item_id = qn.item_id AND dot.doc_id = d.doc_id)
SELECT item_id, doc_id, score FROM score QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 2""")
def tfidf_topk(spark, d):
    docs, asked = b.documents(spark, d).select("doc_id", "text"), b.table(spark, d, "benchmark")
    return search.similar_docs(docs, asked, "doc_id", "item_id", k=2)


@query(rf"""WITH tok AS (SELECT doc_id, unnest({WORDS}) AS term FROM documents), tf AS (SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY 1, 2),
n AS (SELECT count(*) AS n FROM documents),
vocab AS (SELECT term, ln(n / (1.0 + df)) + 1.0 AS idf FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), n WHERE df > 1 AND df < greatest(2, n * 0.8)),
w AS (SELECT doc_id, term, tf * idf AS w FROM tf JOIN vocab USING (term)), dn AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM w GROUP BY 1),
dot AS (SELECT q.doc_id AS query_id, w.doc_id, sum(w.w * q.w) AS dot FROM w q JOIN w USING (term) WHERE q.doc_id % 20 = 0 AND q.doc_id <> w.doc_id GROUP BY 1, 2),
score AS (SELECT qn.doc_id AS query_id, d.doc_id, round(coalesce(dot / (dn.norm * qn.norm), 0), 6) AS score FROM dn qn CROSS JOIN documents d LEFT JOIN dn ON dn.doc_id = d.doc_id
  LEFT JOIN dot ON dot.query_id = qn.doc_id AND dot.doc_id = d.doc_id WHERE qn.doc_id % 20 = 0 AND qn.doc_id <> d.doc_id)
SELECT query_id, doc_id, score FROM score QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) <= 2""")
def tfidf_exclude(spark, d):
    docs = b.documents(spark, d).select("doc_id", "text")
    # The stated query set: every id divisible by 20, each against all other documents.
    asked = docs.filter(F.col("doc_id") % 20 == 0).select(F.col("doc_id").alias("query_id"), "text", F.col("doc_id").alias("own"))
    return search.similar_docs(docs, asked, "doc_id", "query_id", k=2, exclude="own")


@query("""WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
n AS (SELECT vec_id, label, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM v),
score AS (SELECT q.vec_id AS query_id, n.vec_id, round(list_sum(list_transform(list_zip(q.e, n.e), lambda z: z[1] * z[2])) / (q.norm * n.norm), 6) AS score FROM n q, n WHERE q.vec_id % 20 = 0)
SELECT query_id, vec_id, score FROM score QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 3""")
def vector_topk(spark, d):
    vectors = b.table(spark, d, "embeddings").select("vec_id", "embedding")
    # The stated query set: every id divisible by 20, each against all vectors.
    asked = vectors.filter(F.col("vec_id") % 20 == 0).withColumnRenamed("vec_id", "query_id")
    return search.similar_vectors(vectors, asked, "vec_id", "query_id", k=3)
