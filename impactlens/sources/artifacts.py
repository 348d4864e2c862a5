"""Artifacts and pages: what is stored, what is intact, what links where."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def artifact_manifest(index: DataFrame, files: DataFrame, keys: list[str]) -> DataFrame:
    """Index joined to the stored bytes (keys, content): present, and intact when the hash agrees."""
    stored = files.select(*keys, F.sha2("content", 256).alias("_found"))
    return index.join(stored, keys, "left").select(
        *index.columns, F.col("_found").isNotNull().alias("present"),
        F.coalesce(F.col("_found") == F.col("sha256"), F.lit(False)).alias("intact"),
    )


def page_links(pages: DataFrame, key: str) -> DataFrame:
    """(key, href, ord): link targets of each page in order, as import edges of a document graph."""
    hrefs = F.regexp_extract_all("html", F.lit(r"""<a[^>]*\shref="([^"]*)\""""), F.lit(1))
    return pages.select(key, F.posexplode(hrefs).alias("ord", "href"))
