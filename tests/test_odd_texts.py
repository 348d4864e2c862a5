"""Queries over lines against their SQL where texts are empty, null or end their lines in other ways."""

import os

import pandas as pd
import pytest

from impactlens.plans.catalog import ORACLES, QUERIES
from tests.oracle import TABLES, compare
from tests.test_plans import SF

TEXTS = ["", None, "\n", "\n\n", "a@\n1\n", "a@\r\n1\r\nc\r\n", "x1\ry@\rz", "\r", "1\n2\n3\n4\n5\n6\n7\r8\n9", "in the sea\rof the sun\r\nto the end\n"]


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    """The smallest tables, with other documents."""
    folder = tmp_path_factory.mktemp("odd")
    for t in set(TABLES) - {"documents"}:
        os.symlink(f"{SF}/{t}.parquet", folder / f"{t}.parquet")
    docs = pd.DataFrame({"doc_id": range(len(TEXTS)), "text": TEXTS, "lang": "en", "source": ["src1", "src3"] * 5, "n_chars": [len(t or "") for t in TEXTS]})
    docs.to_parquet(folder / "documents.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["even_sample", "severity", "line_delta", "read_span_whole", "sites_changed"])
def test_lines_end_where_the_sql_ends_them(spark, odd, name):
    got = compare(spark, name, QUERIES[name], ORACLES[name], odd)
    assert got["ok"], got
