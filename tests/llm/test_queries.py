"""Every registered query against its contract in plain Python, on whole small tables."""

from __future__ import annotations

import itertools
import math
import zlib
from collections import Counter, defaultdict

import pytest

from impactlens.llm import licenses, lines
from impactlens.llm.queries import ORACLES, QUERIES
from tests.llm import plain
from tests.oracle import compare

SF = "/root/testdata/sf0.001"


def table(spark, name, *columns, sf=SF):
    return [tuple(r) for r in spark.read.parquet(f"{sf}/{name}.parquet").select(*columns).collect()]


def test_mixing_meets_every_target(spark):
    docs = table(spark, "documents", "doc_id", "source", "text")
    want = plain.mix_targets(docs)
    source = {d: s for d, s, _ in docs}
    size = {d: len(plain.WORD.findall(t or "")) for d, _, t in docs}
    rows = QUERIES["op1_mixing"](spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(size)
    taken = defaultdict(int)
    for r in rows:
        assert r.size == size[r.doc_id] and 0 <= r.taken <= 3 * r.size
        assert r.source_size == want[source[r.doc_id]][0] and r.target == pytest.approx(want[source[r.doc_id]][1], rel=1e-9)
        taken[source[r.doc_id]] += r.taken
    for s, (_, target) in want.items():
        assert abs(taken[s] - target) <= 1
    again = QUERIES["op1_mixing"](spark, SF).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.01"])
def test_near_classes_are_those_of_all_pairs(spark, sf):
    want = plain.near_classes(table(spark, "documents", "doc_id", "text", sf=sf))
    rows = QUERIES["op2_minhash"](spark, sf).collect()
    assert {r.doc_id: r.class_id for r in rows} == want
    assert all(r.kept == (r.doc_id == r.class_id) for r in rows)


def test_fingerprints(spark):
    want = plain.edited(table(spark, "documents", "doc_id", "text"))
    rows = {r.doc_id: r for r in QUERIES["op4_fingerprints"](spark, SF).collect()}
    assert rows.keys() == want.keys()
    prints = {}
    for doc, (text, edited, after) in want.items():
        r = rows[doc]
        assert r.n_chars == len(text) and r.edited_sha256 == plain.sha(edited)
        assert prints.setdefault(text, r.fingerprint) == r.fingerprint
        assert prints.setdefault(edited, r.edited_fingerprint) == r.edited_fingerprint
        assert r.near_edited == pytest.approx(plain.likeness(text, edited)) and r.near_next == pytest.approx(plain.likeness(text, after))
        assert 0 <= r.near_edited <= 1 and (r.near_next == 1) == (text == after)
    assert len(set(prints.values())) == len(prints)
    assert sum(r.near_edited for r in rows.values()) / len(rows) > 0.35 > 0.1 > sum(r.near_next for r in rows.values()) / len(rows)


def test_chats_read_back(spark):
    fixed = "</s>[INST] ok [/INST]"
    said = table(spark, "conversations", "conv_id", "turn", "role", "text") + [(-1, 0, "user", fixed), (-1, 1, "assistant", fixed)]
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in QUERIES["op5_chat"](spark, SF).collect()}
    assert got == plain.chats(said)


def test_exact_groups(spark):
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in QUERIES["op6_exact"](spark, SF).collect()}
    assert got == plain.exact(table(spark, "documents", "doc_id", "text"))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql_twins(spark, name):
    assert compare(spark, name, QUERIES[name], ORACLES[name], SF)["ok"]


def test_repeated_lines(spark):
    sf = "/root/testdata/sf0.01"
    docs = sorted(table(spark, "documents", "doc_id", "text", sf=sf))
    first, count = {}, Counter()
    for doc, text in docs:
        rows = text.split("\n")
        for start, n in lines.cut_lines(rows):
            body = "\n".join(rows[start : start + n])
            first.setdefault(body, (doc, start))
            count[body] += 1
    want = {}
    for doc, text in docs:
        rows, gone = text.split("\n"), set()
        for start, n in lines.cut_lines(rows):
            if first["\n".join(rows[start : start + n])] != (doc, start):
                gone.update(range(start, start + n))
        want[doc] = len(rows), len(gone), plain.sha("\n".join(x for i, x in enumerate(rows) if i not in gone))
    got = {r.doc_id: (r.n_lines, r.removed_lines, r.text_sha256) for r in QUERIES["op3_lines"](spark, sf).collect()}
    assert got == want and max(count.values()) > 1


def test_repeated_runs_of_lines(spark):
    """Against pairs of lines alone: nearly every line of a run of over 50 words that stood in smaller ids goes, and every line keeps a first place."""
    sf = "/root/testdata/sf0.01"
    docs = {doc: text.split("\n") for doc, text in sorted(table(spark, "documents", "doc_id", "text", sf=sf))}
    before, kept, runs, missed, n_lines, lost = set(), set(), 0, 0, 0, 0
    out = {r.doc_id: r.text.split("\n") for r in lines.without_repeated_lines(spark.read.parquet(f"{sf}/documents.parquet")).collect()}
    for doc, rows in docs.items():
        left = Counter(out[doc])
        again = [pair in before for pair in zip(rows, rows[1:], strict=False)]
        for repeated, stretch in itertools.groupby(range(len(again)), again.__getitem__):
            places = [*stretch]
            run = rows[places[0] : places[-1] + 2]
            if repeated and sum(len(line.split()) for line in run) > 50:
                stay = sum(left[line] > 0 for line in run)
                runs, missed, n_lines, lost = runs + 1, missed + (stay == len(run)), n_lines + len(run), lost + stay
        before.update(zip(rows, rows[1:], strict=False))
        kept.update(out[doc])
        assert set(rows) <= kept | {""}
    assert runs > 50 and missed <= 0.02 * runs and lost <= 0.05 * n_lines


def test_licenses(spark):
    docs = dict(table(spark, "documents", "doc_id", "text", sf="/root/testdata/sf0.01"))
    sets = [(label, set(licenses.words_of(text))) for label, text in licenses.TEMPLATES]
    for r in QUERIES["op7_licenses"](spark, "/root/testdata/sf0.01").collect():
        have = [set(licenses.words_of(line)) for line in docs[r.doc_id].split("\n")]
        more = {label for label, tokens in sets if any(len(tokens & h) >= 0.8 * len(tokens) for h in have)}
        assert set(filter(None, r.labels.split(","))) == more | set(filter(None, r.base_labels.split(",")))
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == plain.licenses(docs[r.doc_id])
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1


def test_packing(spark):
    from tokenizers import Tokenizer

    from impactlens.llm.packing import default_tokenizer

    coder = Tokenizer.from_file(default_tokenizer())
    want = plain.pieces(table(spark, "documents", "doc_id", "text"), lambda t: coder.encode(t, add_special_tokens=False).ids)
    rows = QUERIES["op8_packing"](spark, SF).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for seats in bins.values():
        end = 0
        for offset, length in sorted(seats):
            assert offset == end
            end += length
        assert end <= 2048
    assert len(bins) <= math.ceil(sum(w[1] for w in want.values()) / 2048) + 1


def test_quality_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    label = dict(table(spark, "labels", "doc_id", "quality", sf=sf))
    rows = QUERIES["op9_quality"](spark, sf).collect()
    assert len(rows) == 10_000
    held = [r for r in rows if r.doc_id in label and r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in rows)
    hits = [r.predicted == label[r.doc_id] for r in held]
    good = [r.predicted for r in held if label[r.doc_id]]
    bad = [1 - r.predicted for r in held if not label[r.doc_id]]
    assert sum(hits) / len(hits) > 0.97 and sum(good) / len(good) > 0.97 and sum(bad) / len(bad) > 0.9


def test_archives(spark):
    pages = table(spark, "pages", "page_id", "html")
    rows = QUERIES["op10_warc"](spark, SF).collect()
    assert {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows} == plain.warc(pages)
    assert not any(r.problem for r in rows)
