"""One query per operator, over its whole table, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from impactlens.llm import chat, contamination, exact, fingerprint, licenses, lines, mixing, near, packing, periodic, quality, spelling, warc
from impactlens.llm.registry import ORACLES, QUERIES, query
from impactlens.llm.shared import read

__all__ = ["ORACLES", "QUERIES"]


@query()
def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken_per_document(mixing.mix(read(spark, sf_dir, "documents")))


@query()
def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_classes(read(spark, sf_dir, "documents"))


@query()
def op3_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.without_repeated_lines(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "removed_lines", F.sha2("text", 256).alias("text_sha256"))


@query()
def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.compare_edits(read(spark, sf_dir, "documents"))


@query()
def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    fixed = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", fixed), (-1, 1, "assistant", fixed)], said.schema)
    messages = chat.turn_chain(said.unionByName(extra), "conv_id", "turn", "role", "text")
    done = chat.formatted(chat.ranked_paths(messages))
    back = done.select("tree", "formatted", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    said_again = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        F.col("tree").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(said_again, 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


OP6_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
g AS (SELECT text, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(text) AS text_sha256 FROM d JOIN g USING (text)
"""


@query(OP6_SQL)
def op6_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(read(spark, sf_dir, "documents"))


@query()
def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read(spark, sf_dir, "documents"))


@query()
def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"))


@query()
def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query()
def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(read(spark, sf_dir, "pages"))


@query()
def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spelling.count_words(read(spark, sf_dir, "documents"), slip_every=spelling.SLIP_EVERY)
    return spelling.variants(words)


@query()
def op12_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination.contaminated_spans(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return contamination.report(found).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated"
    )


@query()
def op13_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.digest_columns(periodic.collapse_runs(periodic.planted(read(spark, sf_dir, "documents"))))
