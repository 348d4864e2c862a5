"""Texts that are one long run of one kind of character, sources whose rows share an id, and the bound on labelled rows."""

from __future__ import annotations

from collections import Counter

import pytest

from impactlens.llm import mixing, packing, quality


@pytest.mark.parametrize("text", [" " * 2_000_000, "x" + "\n" * 2_000_000 + "y", "\t" * 2_000_000, " \n\t" * 700_000 + "z", "x" * 2_000_000, "a" + " " * 9_999 + "b" + " " * 10_001])
def test_runs_of_one_character_have_the_tokenizers_ids(text):
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(packing.default_tokenizer())
    assert list(packing.encoder(packing.default_tokenizer())(text)) == coder.encode(text, add_special_tokens=False).ids


def test_blank_texts_are_packed(spark):
    docs = spark.createDataFrame([(1, " " * 1_000_000), (2, "x" + "\n" * 1_000_000 + "y")], "doc_id LONG, text STRING")
    rows = packing.pack(docs).collect()
    per = Counter()
    for r in rows:
        per[r.doc_id] += r.length
    assert per == {1: 1_000_001, 2: 500_004}


@pytest.mark.parametrize("words, whole", [(143, 14), (147, 15), (150, 15)])
def test_texts_of_one_id_keep_their_own_copies(spark, words, whole):
    rows = [(None, " ".join(f"w{i}x{j}" for j in range(10)), "a") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING, source STRING")
    mixed = mixing.mixed_documents(docs, share=words / 300).collect()
    assert len(mixed) == whole and set(map(tuple, mixed)) <= set(rows) and max(Counter(mixed).values()) == 1


def test_equal_rows_share_their_copies(spark):
    rows = [(7, "one two three four", "a", n) for n in range(20)] + [(i, f"p{i} q r s", "b", 0) for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING, source STRING, n INT").repartition(3)
    mixed = Counter(tuple(r) for r in mixing.mixed_documents(docs, weights=(1, 1), share=0.5).collect())
    # Each source is due 25 words: 7 copies of 20 rows (6 and a part below half a copy), and 6 of 5 documents.
    assert sum(n for r, n in mixed.items() if r[0] == 7) == 6 and sum(n for r, n in mixed.items() if r[0] != 7) == 6
    assert max(n for r, n in mixed.items() if r[0] == 7) == 1


def test_training_rows_are_bounded(spark, monkeypatch):
    docs = [(1, f"good prose number {i} of many") for i in range(5_000)] + [(i, f"text {i} $$ ##" * (i % 7 + 1)) for i in range(2, 400)]
    labels = [(1, 1)] + [(i, i % 2) for i in range(2, 400)]
    taken = []
    real = quality.bradley_terry
    monkeypatch.setattr(quality.np, "stack", lambda rows, stack=quality.np.stack: taken.append(len(rows)) or stack(rows))
    monkeypatch.setattr(quality, "bradley_terry", lambda *a: real(*a))
    table = spark.createDataFrame([(str(i), t) for i, t in docs * 2], "doc_id STRING, text STRING")
    known = spark.createDataFrame([(str(i), y) for i, y in labels], "doc_id STRING, quality INT")
    rows = quality.classify(table, known, sample=200).collect()
    assert len(rows) == 2 * len(docs) and 100 < taken[0] < 300


def test_scratch_tables_are_packed_tightly(spark):
    import pyarrow.dataset as ds

    from impactlens.session import store

    files = ds.dataset(store(spark.range(1000)).removeprefix("file:"), format="parquet").get_fragments()
    assert {f.metadata.row_group(0).column(0).compression for f in files} == {"ZSTD"}
