"""One schema per table, and the checks applied when a table is written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_DDL = {
    "graph": "graph_id STRING, repo STRING, commit STRING, built_at TIMESTAMP",
    "file": "graph_id STRING, path STRING, lang STRING, sha256 STRING, is_test BOOLEAN",
    "symbol": (
        "graph_id STRING, fqn STRING, name STRING, kind STRING, path STRING, line_start INT, "
        "line_end INT, signature STRING, exported BOOLEAN"
    ),
    "import_edge": (
        "graph_id STRING, path STRING, symbol_name STRING, local_name STRING, source_module STRING, "
        "resolved_symbol STRING, resolved_path STRING, line INT"
    ),
    "call_edge": (
        "graph_id STRING, caller STRING, callee STRING, callee_name STRING, path STRING, line INT, "
        "confidence STRING, dynamic BOOLEAN"
    ),
    "test_edge": "graph_id STRING, test_path STRING, symbol STRING, nodeid STRING, source STRING",
    "job": (
        "job_id STRING, repo_url STRING, commit_sha STRING, goal STRING, target_fqn STRING, "
        "state STRING, graph_id STRING, token_budget BIGINT, tokens_spent BIGINT, tunables STRING, "
        "routine STRING, pr_url STRING, created_at TIMESTAMP, finished_at TIMESTAMP, stop_reason STRING"
    ),
    "task": (
        "task_id STRING, job_id STRING, seq INT, target_file STRING, "
        "declared_removals ARRAY<STRING>, depends_on ARRAY<INT>, state STRING, "
        "winning_attempt_id STRING, discard_reason STRING, kind STRING"
    ),
    "attempt": (
        "attempt_id STRING, task_id STRING, job_id STRING, n INT, kind STRING, model STRING, "
        "temperature DOUBLE, parent_image STRING, result_image STRING, operation_id STRING, "
        "verdict STRING, gate STRING, exit_code INT, duration_ms BIGINT, prompt_tokens BIGINT, "
        "completion_tokens BIGINT, cost DOUBLE"
    ),
    "artifact": (
        "artifact_id STRING, job_id STRING, attempt_id STRING, kind STRING, path STRING, "
        "sha256 STRING, created_at TIMESTAMP"
    ),
    "event": "seq BIGINT, job_id STRING, ts TIMESTAMP, kind STRING, payload STRING",
    "line": "graph_id STRING, path STRING, line_no INT, text STRING",
    "finding": "rule STRING, path STRING, line INT, message STRING, snippet STRING",
}


def schema_of(table: str) -> StructType:
    return StructType.fromDDL(_DDL[table])


# The closed enumerations of the data model.
ENUMS = {
    ("file", "lang"): ("python", "typescript"),
    ("call_edge", "confidence"): ("static", "heuristic"),
    ("test_edge", "source"): ("import", "coverage", "characterisation"),
}

# What a column added after the first version of a table reads as in older data.
DEFAULTS = {
    ("call_edge", "dynamic"): False,
    ("task", "kind"): "refactor",
    ("attempt", "kind"): "coder",
    ("job", "routine"): "interface_evolution",
}


def conform(df: DataFrame, table: str) -> DataFrame:
    """Additive evolution: absent columns appear as NULL or as their declared default."""
    out: list[Column] = []
    for field in schema_of(table).fields:
        value = F.col(field.name) if field.name in df.columns else F.lit(None)
        default = DEFAULTS.get((table, field.name))
        if default is not None:
            value = F.coalesce(value, F.lit(default))
        out.append(value.cast(field.dataType).alias(field.name))
    return df.select(*out)


def checked(df: DataFrame, table: str) -> DataFrame:
    """Conform, then fail the write on a value outside a closed enumeration."""
    out = conform(df, table)
    for (name, column), allowed in ENUMS.items():
        if name == table:
            bad = F.col(column).isNotNull() & ~F.col(column).isin(*allowed)
            out = out.withColumn(
                column,
                F.when(bad, F.raise_error(F.concat(F.lit(f"{table}.{column}: "), F.col(column)))).otherwise(
                    F.col(column)
                ),
            )
    return out
