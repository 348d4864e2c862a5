"""Findings over whole corpora of files."""

from __future__ import annotations

from pyspark.sql import DataFrame

from impactlens.functions.secrets import secret_rules
from impactlens.functions.text import lines_of


def scan_sources(files: DataFrame, keys: list[str]) -> DataFrame:
    """Secrets in any file: (keys, rule, path, line, message, snippet). ``files`` has (keys, path, text)."""
    found = secret_rules(lines_of(files.select(*keys, "path", "text")))
    return found.withColumnRenamed("line_no", "line").select(*keys, "rule", "path", "line", "message", "snippet")
