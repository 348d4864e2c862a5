"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for every operator and stage."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from impactlens.llm import chat, exact, fingerprint, licenses, lines, mixing, near, packing, quality, warc
from tests.llm import plain

SCHEMA = "doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG, size INT, kept STRING, `_text` STRING, score DOUBLE"
LONG = " ".join(f"word{i} and{i % 7}" for i in range(60_000))
PROSE = " ".join(f"plain{i % 50} prose{i % 31} number{i}" for i in range(120))
NEAR = PROSE.replace("number7 ", "changed ")
ROWS = [
    (1, PROSE), (2, PROSE), (3, NEAR), (4, None), (5, ""), (6, "   \n\t"), (7, LONG), (8, "one two"), (8, "one two"), (None, PROSE), (None, None),
    (9, "a\n\nb\n\nthe MIT  License\nLicensed under the Apache License, Version 2.0."), (10, "é ü 漢字 \U0001f600 <|endoftext|> </s>"), (11, "x" * 5000),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None if n % 4 == 0 else "en", [None, "b", "B", "ä"][n % 4], None, n, "yes", "other", 0.5) for n, (i, t) in enumerate(ROWS)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.limit(0)


def key(row):
    return repr(tuple(row))


def test_mixing(docs, nothing):
    rows = mixing.taken_per_document(mixing.mix(docs)).collect()
    assert len(rows) == len(ROWS) and all(0 <= r.taken <= 3 * r.size for r in rows)
    want = plain.mix_targets([(i, [None, "b", "B", "ä"][n % 4], t) for n, (i, t) in enumerate(ROWS)])
    assert sorted({(r.source_size, round(r.target, 6)) for r in rows}) == sorted({(s, round(t, 6)) for s, t in want.values()})
    assert mixing.mix(nothing).count() == 0 and mixing.mixed_documents(nothing).count() == 0
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns and set(map(key, mixed.distinct().collect())) <= set(map(key, docs.collect()))


def test_word_counts(spark):
    texts = ["", " ", "a", " a b ", "\x0ba\x0cb\r\n", "a b c", " x"]
    got = spark.createDataFrame([(t,) for t in texts], "t STRING").select(mixing.word_count(F.col("t"))).collect()
    assert [r[0] for r in got] == [len(plain.WORD.findall(t)) for t in texts]


def test_near(docs, nothing):
    rows = near.near_classes(docs).collect()
    assert len(rows) == len(ROWS)
    classes = {(r.doc_id, r.class_id) for r in rows}
    assert {(1, 1), (2, 1), (3, 1), (None, 1), (4, 4), (5, 4), (6, 6), (7, 7), (8, 8)} <= classes and (None, 4) in classes
    assert Counter((r.doc_id, r.class_id) for r in rows if r.kept)[(1, 1)] == 1
    assert near.near_classes(nothing).count() == 0
    kept = near.without_near_copies(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {1, 4, 6, 7, 8, 9, 10, 11}


def test_near_copies_of_one_id(spark):
    other, third = LONG[:3000], PROSE.upper().replace("PLAIN", "solid")
    rows = [(1, PROSE), (None, NEAR), (None, other), (None, third), (5, third + " more"), (5, "one two three")]
    table = spark.createDataFrame(rows, "doc_id LONG, text STRING")
    assert {tuple(r) for r in near.without_near_copies(table).collect()} == {(1, PROSE), (None, other), (5, third + " more"), (5, "one two three")}


def test_repeats_do_not_part_near_texts():
    import random

    rng = random.Random(5)
    texts = []
    for _ in range(300):
        words = [f"w{rng.randrange(10**6)}" for _ in range(314)]
        said, rest, new = words[:130], words[130:260], words[260:]
        texts += [" ".join(said + rest + new), " ".join(said * 10 + rest)]
    assert all(0.8 <= s < 0.82 for s in near.similarities(texts[::2], texts[1::2]))
    keys, _ = near.band_keys(texts)
    assert sum(not (a == b).any() for a, b in zip(keys[::2], keys[1::2])) <= 1


def test_lines(spark, docs, nothing):
    rows = lines.without_repeated_lines(docs).collect()
    assert len(rows) == len(ROWS) and lines.without_repeated_lines(nothing).count() == 0
    body = [f"line {i} of a passage that many documents share" for i in range(30)]
    texts = ["\n".join(body), "\n".join(["mine", *body, "mine too"]), "\n".join(["other"] * 3)]
    got = lines.without_repeated_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id LONG, text STRING")).orderBy("doc_id").collect()
    assert got[0].text == texts[0] and got[0].removed_lines == 0
    assert got[1].removed_lines == 30 and got[1].text == "mine\nmine too" and got[2].text == texts[2]


def test_line_passages_in_other_surroundings(spark):
    """Passages of over 50 words in one to sixty lines go whole wherever they stand; long runs of one line and light texts end no job."""
    rng = random.Random(5)
    passages = [[" ".join(f"p{k}w{i}" for i in range(x, x + 60 // n + 1)) for x in range(0, 60, 60 // n)] for k, n in enumerate([1, 2, 3, 4, 5, 10, 20, 60] * 5)]
    texts = ["\n".join(p) for p in passages]
    texts += ["\n".join([*(f"{k} own {rng.random()}" for _ in range(k % 4)), *p, *(f"{k} mine" for _ in range(k % 3))]) for k, p in enumerate(passages)]
    texts += ["\n" * 20_000, "x\n" * 20_000, "word " * 200_000]
    got = lines.without_repeated_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id LONG, text STRING")).collect()
    for r in got[:]:
        if len(passages) <= r.doc_id < 2 * len(passages):
            k = r.doc_id - len(passages)
            assert r.removed_lines >= len(passages[k]) and not set(r.text.split("\n")) & set(passages[k])
        elif r.doc_id < len(passages):
            assert r.removed_lines == 0


def test_boundaries_do_not_shift():
    body = [f"line {i}" for i in range(200)]
    ends = lambda pre: {end - len(pre) for end in lines.boundaries(pre + body)}
    assert {e for e in ends([]) if e > 2} == {e for e in ends(["a", "b", "c"]) if e > 2} and 20 < len(ends([])) < 100


def test_fingerprints(docs, nothing):
    rows = fingerprint.compare_edits(docs).collect()
    assert len(rows) == len(ROWS) and fingerprint.compare_edits(nothing).count() == 0
    prints = {}
    for r in rows:
        prints.setdefault(r.doc_id, set()).add(r.fingerprint)
    assert prints[1] == prints[2] and prints[4] == prints[5] and prints[5] != prints[6]
    one = fingerprint.compare_edits(docs.filter("doc_id = 9")).first()
    assert one.near_next == 1.0 and 0 < one.near_edited < 1 and one.first_section == 2


def test_likeness_and_branches_of_an_edit(spark):
    """One word put into a paragraph leaves the rest alike; every differing branch is returned, moved ones are equal."""
    words = [f"word{i * 7919 % 1000}" for i in range(300)]
    old = "\n\n".join(["first section\nits second line", " ".join(words), "third", "fourth\nlast"])
    edits = [" ".join([*words[:at], "new", *words[at:]]) for at in (0, 150, 300)] + ["x " * 300, None]
    rows = [(i, " ".join(words), e) for i, e in enumerate(edits)]
    trees = spark.createDataFrame(rows, "k INT, a STRING, b STRING").withColumn("b", F.coalesce("b", F.lit("")))
    near = fingerprint.with_leaves(trees, la=F.col("a"), lb=F.col("b")).select("k", fingerprint.likeness(F.col("a"), F.col("la"), F.col("b"), F.col("lb")).alias("s"))
    got = {r.k: r.s for r in near.collect()}
    assert all(0.9 <= got[k] < 1 for k in (0, 1, 2)) and got[3] == got[4] == 0
    new = "\n\n".join(["fourth\nlast", "first section\nits 2nd line", " ".join(words), "third", "fifth"])
    pair = spark.createDataFrame([(None, old, new), (1, old, None), (2, old, old)], "k INT, a STRING, b STRING")
    found = {(r.k, r.side, r.section, r.paragraph) for r in fingerprint.differing_branches(pair, "k", "a", "b").collect()}
    assert {x[1:] for x in found if x[0] is None} == {("a", 0, 1), ("b", 1, 1), ("b", 4, 0)}
    assert {x[1:] for x in found if x[0] == 1} == {("a", 0, 0), ("a", 0, 1), ("a", 1, 0), ("a", 2, 0), ("a", 3, 0), ("a", 3, 1), ("b", 0, 0)} and not any(x[0] == 2 for x in found)


def test_chat(spark):
    said = [(1, 0, "user", "a<s>[INST] %3C %"), (1, 1, "assistant", None), (1, None, None, "\n<|im_end|>\n<|im_start|>user\n"), (None, 1, "assistant", "x"), (None, 1, "assistant", "x"), (2, 5, "a\nb", "<<SYS>>")]
    table = spark.createDataFrame(said, "conv_id LONG, turn LONG, role STRING, text STRING")
    done = chat.formatted(chat.ranked_paths(chat.turn_chain(table, "conv_id", "turn", "role", "text")))
    got = {r.tree: ([tuple(t) for t in r.turns], r.loss) for r in done.select("tree", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()}
    assert got == {
        1: ([("user", "a<s>[INST] %3C %"), ("assistant", ""), ("", "\n<|im_end|>\n<|im_start|>user\n")], ""),
        None: ([("assistant", "x")] * 2, "xx"), 2: ([("a\nb", "<<SYS>>")], ""),
    }
    assert chat.formatted(chat.ranked_paths(chat.turn_chain(table.limit(0), "conv_id", "turn", "role", "text"))).count() == 0


def test_reply_trees(spark):
    rows = [
        (1, 1, None, 0.1), (1, 2, 1, 0.9), (1, 3, 1, 0.2), (1, 4, 2, None), (1, 5, 3, 0.95), (1, 6, 99, 0.3),  # branches and an orphan
        (2, 1, 3, 0.0), (2, 2, 1, 0.0), (2, 3, 2, 0.0), (2, 4, 3, 0.5),  # a circle with one answer
        *[(3, i, i - 1 if i else None, 0.0) for i in range(40)],
    ]
    messages = spark.createDataFrame([(t, n, p, "user", f"m{n}", s) for t, n, p, s in rows], "tree INT, node LONG, parent LONG, role STRING, text STRING, score DOUBLE")
    paths = {(r.tree, r.leaf): r.path for r in chat.tree_paths(messages).collect()}
    assert paths == {(1, 4): [1, 2, 4], (1, 5): [1, 3, 5], (1, 6): [6], (2, 4): [1, 2, 3, 4], (3, 39): list(range(40))}
    best = {r.tree: (r.leaf, r["rank"], [t.text for t in r.turns]) for r in chat.ranked_paths(messages).collect()}
    assert best[1] == (5, 1, ["m1", "m3", "m5"])
    assert chat.ranked_paths(messages, per_tree=None).count() == 5


def test_exact(spark, docs, nothing):
    rows = exact.exact_groups(docs).collect()
    got = Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in rows)
    assert got[(2, 2, 3, True)] == 1 and got[(1, 2, 3, False)] == 1 and got[(None, 2, 3, False)] == 1
    assert got[(5, 5, 3, True)] == 1 and got[(8, 8, 2, True)] == 1 and got[(8, 8, 2, False)] == 1 and got[(7, 7, 1, True)] == 1
    assert exact.exact_groups(nothing).count() == 0
    kept = exact.without_copies(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3, 5, 6, 7, 8, 9, 10, 11]


def test_cuckoo_filter():
    live = exact.CuckooFilter(2)
    keys = [k * 0x9E3779B97F4A7C15 % (1 << 63) for k in range(1, 5001)]
    for k in keys:
        live.insert(k)
    assert all(k in live for k in keys) and live.resized > 0
    assert sum((k + 1) in live for k in keys) < 50
    for k in keys[::2]:
        live.delete(k)
    assert all(k in live for k in keys[1::2]) and sum(k in live for k in keys[::2]) < 50
    live.insert(keys[1], 2)
    live.delete(keys[1])
    assert keys[1] in live and live.keys[keys[1]] == 2
    live.delete(12345)


def test_cuckoo_index_grows_and_shrinks(spark):
    rows = spark.createDataFrame([(k,) for k in [1, 2, 2, 3, 4]], "key LONG")
    index = exact.update_index(None, exact.keys_of(rows), 3)
    index = exact.update_index(index, exact.keys_of(spark.createDataFrame([(2,), (3,)], "key LONG"), -1), 3)
    asked = spark.createDataFrame([(k,) for k in [1, 2, 3, 4, 77]], "key LONG")
    assert sorted(r.key for r in exact.probe(index, asked, 3).collect()) == [1, 2, 4]


def test_licenses(docs, nothing):
    rows = licenses.scan(docs).collect()
    assert len(rows) == len(ROWS) and licenses.scan(nothing).count() == 0
    hit = next(r for r in rows if r.doc_id == 9)
    assert (hit.n_base, hit.first_word, hit.last_word, hit.base_labels, hit.score, hit.matched_blocks) == (2, 3, 8, "apache,mit", 1.0, 1)
    assert all(r.labels == "" and r.score == 0 for r in rows if r.doc_id != 9)


def test_containment_join_is_exact(spark):
    import random

    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(30)]
    templates = [(f"t{i}", " ".join(rng.sample(vocabulary, rng.randrange(1, 9)))) for i in range(25)]
    blocks = [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(0, 25))) for _ in range(400)]
    counts = Counter(w for b in blocks for w in set(b.split()))
    known = licenses.Templates(templates, counts, 0.8)
    for block in blocks:
        have = set(block.split())
        want = {label for label, text in templates if len(set(text.split()) & have) / len(set(text.split())) >= 0.8}
        assert {label for label, _ in known.matches(have)} == want


def test_wrapped_notices():
    import random

    known = licenses.Templates(licenses.TEMPLATES, {}, licenses.CONTAINMENT)
    found = lambda text: {(label, *run) for label, _, runs in known.matched_runs([licenses.words_of(x) for x in text.split("\n")]) for run in runs}
    wrapped = "x\n# Redistribution and use in source and binary forms, with or without\n# modification, are permitted\n\nso"
    assert found(wrapped) == {("bsd", 1, 2)}
    assert {label for label, *_ in found("It is licensed\nunder CC\nBY-NC\n4.0.")} >= {"cc-by-nc"}
    rng = random.Random(2)
    for label, text in licenses.TEMPLATES:
        cut = "\n".join(" ".join(part) for part in (text.split()[i : i + 4] for i in range(0, len(text.split()), 4)))
        assert label in {x for x, *_ in found(f"some words\n{cut}\nother words")}
    for _ in range(300):
        vocabulary = [f"w{i}" for i in range(8)]
        templates = [("t", " ".join(rng.choices(vocabulary, k=rng.randrange(1, 9))))]
        size, tokens = len(templates[0][1].split()), set(templates[0][1].split())
        lines = [rng.choices([*vocabulary, "x", "y", "z"], k=rng.randrange(0, 5)) for _ in range(rng.randrange(1, 12))]
        shares = {
            (i, j): len(tokens & {w for line in lines[i : j + 1] for w in line}) / len(tokens)
            for i in range(len(lines)) for j in range(i, len(lines)) if j == i or sum(map(len, lines[i + 1 : j])) < size - 1
        }
        good = {run for run, share in shares.items() if share >= 0.8}
        tight = {(i, j) for i, j in good if (i + 1, j) not in good and (i, j - 1) not in good}
        got = list(licenses.Templates(templates, {}, 0.8).matched_runs(lines))
        assert [(best, runs) for _, best, runs in got] == ([(max(shares.values()), tight)] if tight else [])


def test_packing(docs, nothing):
    rows = packing.pack(docs).collect()
    assert packing.pack(nothing).count() == 0
    assert Counter(r.piece for r in rows)[0] == len(ROWS) and all(0 < r.length <= 2048 for r in rows)
    seats = {}
    for r in rows:
        seats.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for bin_ in seats.values():
        bin_.sort()
        assert bin_[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(bin_, bin_[1:])) and sum(bin_[-1]) <= 2048


def test_special_tokens_keep_their_ids():
    from tokenizers import Tokenizer

    path = packing.default_tokenizer()
    coder, encode = Tokenizer.from_file(path), packing.encoder(path)
    for _, text in ROWS:
        if text and len(text) < 10_000:
            assert list(encode(text)) == coder.encode(text, add_special_tokens=False).ids


def test_fullest_bins():
    import random

    rng = random.Random(1)
    for _ in range(60):
        counts = Counter(rng.randrange(1, 12) for _ in range(rng.randrange(0, 9)))
        space = rng.randrange(1, 30)
        sums = {0}
        for n in counts.elements():
            sums |= {s + n for s in sums if s + n <= space}
        got = packing.fullest(sorted(counts, reverse=True), counts, space)
        assert sum(got) == max(sums) and all(Counter(got)[n] <= counts[n] for n in got)
        patterns = packing.bin_patterns(dict(counts), 30)
        assert Counter(n for lengths, times in patterns for n in lengths * times) == counts


def test_quality(spark, docs, nothing):
    labels = spark.createDataFrame([(1, 1, 0), (7, 0, None), (3, None, 0), (None, 1, 1), (2, 7, 0), (2, 1, 0), (2, 0, 0)], "doc_id LONG, quality INT, toxic INT")
    rows = quality.classify(docs, labels).collect()
    assert len(rows) == len(ROWS) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    same = {r.score for r in rows if r.doc_id in (1, 2)}
    assert len(same) == 1
    for table in (labels.limit(0), labels.filter("quality = 1")):
        assert {(r.score, r.predicted) for r in quality.classify(docs, table).collect()} == {(0.3, 1)}
        assert quality.good_documents(docs, table).count() == len(ROWS)
    assert quality.classify(nothing, labels).count() == 0
    assert quality.good_documents(docs, labels).columns == docs.columns


def test_archives(spark):
    pages = [(1, "http://a/\r\nX: y", "<p>same</p>"), (2, None, "<p>same</p>"), (3, "http://c", None), (4, "http://d", ""), (None, "http://e", "<p>same</p>"), (5, "u", "é" * 300_000), (6, "v", "a\r\n\r\nb")]
    table = spark.createDataFrame(pages, "page_id LONG, url STRING, html STRING").withColumn("refers_to", F.lit("x")).repartition(2)
    got = {r.page_id: (r.payload_bytes, r.record_type, r.refers_to, r.problem) for r in warc.archive_round_trip(table).collect()}
    assert got == {
        1: (11, "response", None, None), 2: (11, "revisit", 1, None), None: (11, "revisit", 1, None), 3: (0, "response", None, None), 4: (0, "revisit", 3, None),
        5: (600_000, "response", None, None), 6: (6, "response", None, None),
    }
    assert warc.archive_round_trip(table.limit(0)).count() == 0


def test_archive_frames_and_faults():
    import struct

    import zstandard

    samples = [f"page {i % 17} of a site with number {i}".encode() * 20 for i in range(400)]
    shared = zstandard.train_dictionary(4096, samples).as_bytes()
    coder = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(shared))
    body = b"<p>hi</p>"
    records = [warc.record(str(i), "http://x", body, warc.sha1_base32(body), None) for i in range(3)]
    for held in (shared, zstandard.ZstdCompressor().compress(shared)):
        data = struct.pack("<II", warc.DICTIONARY_MAGIC, len(held)) + held + b"".join(coder.compress(r) for r in records)
        assert list(warc.frames(data)) == records
        with pytest.raises(ValueError, match="cut"):
            list(warc.frames(data[:-3]))
    whole = records[0]
    assert warc.parse(whole)["problem"] is None
    assert warc.parse(whole.replace(b"WARC/1.1", b"WARC/9"))["problem"] == "version"
    assert warc.parse(whole.replace(b"WARC-Date: 2025-01-01T00:00:00Z\r\n", b""))["problem"] == "missing warc-date"
    assert warc.parse(whole[:-2])["problem"] == "length"
    assert warc.parse(whole.replace(b"hi", b"ho"))["problem"] == "digest"


@pytest.mark.parametrize("stage", corpus_pipeline.STAGES, ids=lambda s: s[0])
def test_stages(spark, docs, nothing, stage):
    name, run = stage
    out = run(spark, docs, "/root/testdata/sf0.001")
    assert run(spark, nothing, "/root/testdata/sf0.001").count() == 0
    if name != "packing":
        assert out.columns == docs.columns and out.count() > 0
