"""From raw files to the tables of a graph."""

from __future__ import annotations

from pyspark.sql import DataFrame

from impactlens.operators.edges import build_edges
from impactlens.session import materialise
from impactlens.sources.facts import call_rows, extract_code_facts, import_rows, symbol_rows
from impactlens.sources.tree import file_table, text_of


def build_graph(raw: DataFrame) -> dict[str, DataFrame]:
    """Both passes over scanned files (graph_id, path, content), for all graphs present at once."""
    files = materialise(file_table(raw))
    facts = materialise(extract_code_facts(text_of(raw)))
    symbols = materialise(symbol_rows(facts))
    edges = build_edges(files, symbols, import_rows(facts), call_rows(facts))
    return {"file": files, "symbol": symbols, "facts": facts, **{k: materialise(v) for k, v in edges.items()}}
