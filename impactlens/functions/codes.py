"""Closed lists of codes, and the verdict of a test run."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every error code, then those worth a retry, then those that say nothing of the patch.
ERROR_CODES = (
    "CONFIG_MISSING", "MODEL_ID_UNKNOWN", "SANDBOX_FORBIDDEN", "BASELINE_RED", "BASELINE_INSTALL_FAILED",
    "RADIUS_TOO_LARGE", "TARGET_NOT_FOUND", "DEPENDENCY_CYCLE", "PLAN_INVALID", "DIFF_UNPARSEABLE",
    "GATE_SCOPE", "GATE_SYNTAX", "GATE_TESTS_RED", "GATE_BEHAVIOUR", "GATE_SECURITY", "INTEGRATION_CONFLICT",
    "NO_SAFETY_NET", "MODEL_EMPTY_RESPONSE", "MODEL_PROTOCOL_REJECTED", "MODEL_RATE_LIMITED",
    "BUDGET_EXHAUSTED", "SANDBOX_TIMEOUT", "SANDBOX_OP_FAILED", "PUBLISH_FAILED",
)
RETRYABLE = (
    "BASELINE_INSTALL_FAILED", "PLAN_INVALID", "GATE_TESTS_RED", "INTEGRATION_CONFLICT",
    "MODEL_EMPTY_RESPONSE", "MODEL_RATE_LIMITED", "SANDBOX_TIMEOUT", "SANDBOX_OP_FAILED", "PUBLISH_FAILED",
)
INFRASTRUCTURE = (
    "SANDBOX_TIMEOUT", "SANDBOX_OP_FAILED", "SANDBOX_FORBIDDEN", "MODEL_EMPTY_RESPONSE", "MODEL_RATE_LIMITED",
)

# Exit statuses of a process stopped from outside, and of a patch that did not apply.
KILLED_EXITS = (124, 137, 143)
APPLY_FAILED_EXIT = 90
CONFLICT_EXIT = 91

# Dependency manifests a patch may not touch.
MANIFESTS = (
    "pyproject.toml", "setup.py", "setup.cfg", "poetry.lock", "Pipfile", "Pipfile.lock", "package.json",
    "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "requirements.txt", "requirements-dev.txt",
    "test-requirements.txt", "Cargo.toml", "Cargo.lock", "go.mod", "go.sum",
)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_retryable(code: Column | str) -> Column:
    return F.coalesce(_col(code).isin(*RETRYABLE), F.lit(False))


def is_infrastructure(code: Column | str) -> Column:
    """An unknown code counts against the patch, so it is not infrastructure."""
    return F.coalesce(_col(code).isin(*INFRASTRUCTURE), F.lit(False))


def is_known(code: Column | str) -> Column:
    return F.coalesce(_col(code).isin(*ERROR_CODES), F.lit(False))


def run_verdict(
    exit_code: Column | str,
    failed: Column | str,
    errors: Column | str,
    has_report: Column | str,
    timed_out: Column | str,
    apply_failed: Column | None = None,
) -> Column:
    """syntax, infrastructure, ok or red; a killed run is inconclusive only without a report."""
    code, report = _col(exit_code), _col(has_report)
    unapplied = code == APPLY_FAILED_EXIT
    if apply_failed is not None:
        unapplied = unapplied | apply_failed
    cut_short = _col(timed_out) | (~report & code.isin(*KILLED_EXITS))
    silent_failure = ~report & (code != 0) & (_col(failed) == 0)
    clean = (code == 0) & (_col(failed) == 0) & (_col(errors) == 0) & ~silent_failure
    return (
        F.when(unapplied, "syntax").when(cut_short, "infrastructure").when(clean, "ok").otherwise("red")
    )
