"""Spelling variants, benchmark windows and periodic runs against plain versions of their contracts."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from impactlens.llm import contamination, periodic, spelling
from impactlens.llm.queries import QUERIES
from tests.llm import plain
from tests.llm.test_queries import SF, table

SCHEMA = "doc_id LONG, text STRING, n LONG, word STRING, _row STRING, _found STRING, runs STRING, items STRING, id LONG"


def wide(spark, rows):
    return spark.createDataFrame([(i, t, 1, "w", "r", "f", "u", "m", 2) for i, t in rows], SCHEMA)


# Spelling variants


@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.01"])
def test_variants(spark, sf):
    want = plain.variants(plain.counted_words(table(spark, "documents", "doc_id", "text", sf=sf)))
    rows = QUERIES["op11_spelling"](spark, sf).collect()
    assert {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows} == want and len(rows) == len(want)
    assert any(r.form for r in rows) and any(r.form != r.root for r in rows if r.form)


def test_variants_of_odd_words(spark):
    rng = random.Random(3)
    words = {"".join(rng.choice("abé") for _ in range(rng.randrange(5, 9))): rng.randrange(3, 40) for _ in range(400)}
    long = ["".join(rng.choice("abcd") for _ in range(n)) for n in (254, 255, 256, 700)]
    for w in long:
        for i in (0, 1, len(w) // 2, len(w) - 1):
            words[w[:i] + "z" + w[i + 1 :]] = 5
            words[w[:i] + w[i + 1 :]] = 5
            words[w[:i] + w[i] + w[i:]] = 4
        words[w] = 10
    words |= {"aaaaa": 3, "aaaaaa": 6, "aaaaaaa": 12, "aaaaaaaa": 24, "bbbbb": 7, "bbbbc": 7, "ÿÿÿÿÿ": 5, "÷×÷×÷": 3}
    got = spelling.variants(spark.createDataFrame(list(words.items()), "word STRING, n LONG").repartition(3))
    assert {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in got.collect()} == plain.variants(words)


def test_word_counts_of_odd_texts(spark):
    texts = [None, "", "   ", "Plain PLAIN plain ÉTÉÉÉ étéÉÉ", "Ünïcode naïveté İstanbul straße ŒUVRES", "漢字words漢字words words", "y" * 200_000, "tail\x00tail_tails9tails tails", "x" * 200_000 + " " + "\n" * 100_000]
    rows = [(i if i % 3 else None, t) for i, t in enumerate(texts * 3)]
    got = {r.word: r.n for r in spelling.count_words(wide(spark, rows), slip_every=3).collect()}
    assert got == plain.counted_words(rows, slip_every=3) and "y" * 200_000 in got
    assert spelling.count_words(wide(spark, []), slip_every=3).count() == 0
    assert spelling.variants(spark.createDataFrame([], "word STRING, n LONG")).count() == 0


def test_groups_run_over_batches(spark):
    words = {f"{c}{w}": 3 + i for i, c in enumerate("abcdefghijklmnopqrstuvwxyz") for w in ("start", "other")} | {"start": 9}
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = spelling.variants(spark.createDataFrame(list(words.items()), "word STRING, n LONG"))
        assert {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in got.collect()} == plain.variants(words)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


# Benchmark windows


def contaminated(df):
    cols = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.01"])
def test_contamination(spark, sf):
    want = plain.contaminated(table(spark, "documents", "doc_id", "text", sf=sf), table(spark, "benchmark", "item_id", "text", sf=sf))
    got = contaminated(QUERIES["op12_contamination"](spark, sf))
    assert got == sorted(want, key=repr) and any(r[5] for r in got) and not all(r[5] for r in got)


ITEMS = [(1, "one two three four five six seven eight nine ten eleven twelve"), (2, "Short Item"), (3, None), (4, "..."), (5, "ZÉRO und zéro"), (None, "a b c d e f g h i j"), (1, "lone")]
PASSAGE = "One, two; three\nfour five SIX seven eight nine ten eleven twelve"
TEXTS = [
    (1, f"before {PASSAGE} after"), (2, PASSAGE.rsplit(" ", 3)[0]), (3, "a short  item; another short item"), (None, None), (4, ""), (4, ""), (5, "zÉro und zéro"),
    (None, "so a b c d e f g h i j k"), (6, "lone lone"), (7, "one " * 50_000 + PASSAGE), (8, "." * 300_000), (9, "a b c d e f g h i x"), (None, "short"),
]


@pytest.mark.parametrize("most", [1 << 20, 1])
def test_odd_texts_and_many_sets(spark, most):
    docs, items = wide(spark, TEXTS).repartition(3), spark.createDataFrame(ITEMS, "item_id INT, text STRING")
    found = contamination.contaminated_spans(docs, items, max_windows=most)
    report = contamination.report(found).withColumn("n_items", F.size("items")).withColumn("items_sha256", F.sha2(F.array_join("items", ","), 256))
    assert contaminated(report) == sorted(plain.contaminated(TEXTS, ITEMS), key=repr)
    clean = contamination.without_documents(found)
    assert clean.columns == docs.columns and sorted((r.doc_id or -1) for r in clean.collect()) == [-1, -1, 2, 4, 4, 8, 9]
    cut = contamination.without_spans(found)
    assert cut.columns == docs.columns and cut.count() == len(TEXTS)
    texts = {r.doc_id: r.text for r in cut.collect() if r.doc_id}
    assert texts[1] == "before  after" and texts[3] == "a ; another " and texts[9] == TEXTS[-2][1] and texts[7] == "one " * 50_000
    assert None in [r.text for r in cut.collect()]


def test_long_items_and_empty_tables(spark, monkeypatch):
    monkeypatch.setattr(contamination, "PIECE", 4)
    words = [f"w{i}" for i in range(40)]
    docs = [(i, " ".join(["x", *words[i : i + 11], "y"])) for i in range(28)]
    items = spark.createDataFrame([(7, " ".join(words))], "item_id INT, text STRING")
    got = contamination.report(contamination.contaminated_spans(wide(spark, docs), items, max_windows=5)).collect()
    assert all(r.n_hit == 11 and [tuple(s) for s in r.spans] == [(1, 11)] and r["items"] == ["7"] for r in got) and len(got) == 28
    none = contamination.contaminated_spans(wide(spark, docs), items.limit(0))
    assert contamination.without_documents(none).count() == 28
    assert contamination.contaminated_spans(wide(spark, []), items).count() == 0


# Periodic runs


def test_periodic(spark):
    docs = table(spark, "documents", "doc_id", "text")
    got = {r.doc_id: tuple(r)[1:] for r in QUERIES["op13_periodic"](spark, SF).collect()}
    want = {doc: plain.periodic(doc, text) for doc, text in docs}
    assert got == want and sum(r[0] > 0 for r in got.values()) > 10


def test_runs_of_random_sequences():
    rng = random.Random(11)
    texts = []
    for _ in range(250):
        words: list[bytes] = []
        while len(words) < rng.randrange(5, 700):
            unit = [rng.choice((b"a", b"b", b"c", b"%d" % rng.randrange(50))) for _ in range(rng.choice((1, 2, 3, 5, 8, 9, 10, 13, 14, 21, 22, 34, 60, 61)))]
            words += (unit * 9)[: rng.randrange(1, min(9 * len(unit), 4 * len(unit) + 30) + 1)]
        texts.append(words[:700])
    texts += [[b"a"] * 500, [b"a", b"b"] * 12, [b"a", b"b"] * 11 + [b"a"], [b"x"] * 23, [b"x"] * 24, [], [b"one"], ([b"a"] * 30 + [b"b"]) * 9]
    thue = [b"ab"[bin(i).count("1") % 2 :][:1] for i in range(300)]
    texts += [thue * 3, thue * 2 + thue[:299]]
    got = periodic.runs_of_texts(texts)
    assert got == [plain.runs(t) for t in texts] and sum(map(len, got)) > 100


def test_every_period_is_found():
    x = np.arange(4000)
    for q in range(1, 700):
        size = max(24, 3 * q)
        y = np.concatenate((10_000 + x[:50], x[np.arange(size) % q], 20_000 + x[:50]))
        assert periodic.find_runs(y, len(y)) == [(50, size, q)], q
        assert periodic.find_runs(np.delete(y, 50 + size - 1), len(y)) == [], q


def test_odd_texts(spark):
    texts = [None, "", " \n", "a " * 20_000, " ".join(["a"] * 50), "b c\x1dd " * 30, "x" * 500_000, ("p q r s t u v w x\n" * 1500)]
    rows = [(i if i % 2 else None, t) for i, t in enumerate(texts + texts)]
    got = periodic.digest_columns(periodic.collapse_runs(wide(spark, rows))).collect()
    assert sorted(map(repr, (tuple(r) for r in got))) == sorted(repr((i, *plain.periodic(None, t))) for i, t in rows)
    assert periodic.collapse_runs(wide(spark, [])).count() == 0
    kept = {r.doc_id: (r.n_words, r.text) for r in periodic.collapse_runs(wide(spark, rows)).collect()}
    assert kept[3] == (20_000, "a") and kept[7] == (13_500, "p q r s t u v w x")
