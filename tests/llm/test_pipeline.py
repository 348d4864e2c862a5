"""The pipeline against its contract in plain Python, stage by stage."""

from __future__ import annotations

from collections import Counter, defaultdict

import corpus_pipeline
from impactlens.llm.queries import QUERIES
from tests.llm import plain

SF = "/root/testdata/sf0.01"


def rows(df):
    return [tuple(r) for r in df.select("doc_id", "source", "text").collect()]


def test_stages_one_by_one(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    good = {r.doc_id for r in QUERIES["op9_quality"](spark, SF).filter("predicted = 1").collect()}
    before = rows(docs)
    outputs = []
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(number)))
        docs = spark.read.parquet(str(tmp_path / str(number)))
        outputs.append(docs)
    kept = [r for r in before if r[0] in good]
    assert sorted(rows(outputs[0])) == sorted(kept)
    groups = plain.exact([(d, t) for d, _, t in kept])
    kept = [r for r in kept if groups[r[0]][2]]
    assert sorted(rows(outputs[1])) == sorted(kept)
    classes = plain.near_classes([(d, t) for d, _, t in kept])
    kept = [r for r in kept if classes[r[0]] == r[0]]
    assert sorted(rows(outputs[2])) == sorted(kept)
    mixed = rows(outputs[3])
    assert set(mixed) <= set(kept) and max(Counter(mixed).values()) <= 3
    taken = defaultdict(int)
    for _, source, text in mixed:
        taken[source] += len(plain.WORD.findall(text))
    longest = defaultdict(int)
    for _, source, text in kept:
        longest[source] = max(longest[source], len(plain.WORD.findall(text)))
    for source, (_, target) in plain.mix_targets(kept).items():
        assert abs(taken[source] - target) <= longest[source]
    packed = outputs[4].collect()
    assert Counter(r.doc_id for r in packed if r.piece == 0) == Counter(d for d, _, _ in mixed)
    seats = defaultdict(list)
    for r in packed:
        seats[r.sequence_id].append((r.offset, r.length))
    for bin_ in seats.values():
        bin_.sort()
        assert bin_[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(bin_, bin_[1:])) and sum(bin_[-1]) <= 2048


def test_run_is_the_stages_together(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and out.count() > 800
