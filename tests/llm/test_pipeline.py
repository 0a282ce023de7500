from __future__ import annotations

from collections import Counter

import brute
import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from loomlens.llm import bpe_chunks, near_dedup, quality
from loomlens.llm.common import null_safe, written

SF = "/root/testdata/sf0.001"


def good(spark, rows):
    """The ids of rows (doc_id, text, lang, source) that pass: statistics and base rules in plain Python, distances in
    numpy; only the estimates of the groups, which have a test against a search, are the library's."""
    vectors, fails = {}, set()
    for i, t, *_ in rows:
        n, chars, symbols, dup, repeat = brute.statistics(t)
        lines = sum(1 for x in (t or "").split("\n") if brute.words(x))
        vectors[i] = np.array([np.log((chars + 100) / (n + 20)), np.sqrt(symbols / (n + 20)), np.sqrt(dup / (lines + 5)), np.sqrt(repeat / (n + 20))])
        if n < 20 or 100 * repeat > 30 * n:
            fails.add(i)
    groups = {i: (f"L{lang}", f"S{source}/{lang}") for i, _, lang, source in rows}
    table = [(g, *map(float, vectors[i])) for i in vectors if i not in fails for g in groups[i]]
    states = {s.group: s for s in quality.robust_estimates(spark.createDataFrame(table, "group string, x0 double, x1 double, x2 double, x3 double")).collect()}
    values = [f"m{i}" for i in range(4)] + [f"c{i}{j}" for i in range(4) for j in range(i + 1)]
    kept = set()
    for i in vectors.keys() - fails:
        lang, both = (states[g] for g in groups[i])
        v = {k: (both[k] * both.n + lang[k] * 50) / (both.n + 50) for k in values}
        c = np.array([[v[f"c{max(a, b)}{min(a, b)}"] for b in range(4)] for a in range(4)]) + np.diag(np.square(quality.FLOORS))
        d = vectors[i] - [v[f"m{k}"] for k in range(4)]
        if d @ np.linalg.inv(c) @ d <= quality.CUTOFF:
            kept.add(i)
    return kept


def test_stages_against_plain_python(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    rows = {r.doc_id: r.text for r in docs.collect()}
    known = [(r.doc_id, r.text, r.lang, r.source) for r in docs.collect()]
    sources = {r[0]: r[3] for r in known}
    verdict = good(spark, known)
    stages = dict(corpus_pipeline.STAGES)
    assert len(stages) == 5
    one = written(stages["quality rules"](spark, docs, SF))
    left = {i: t for i, t in rows.items() if i in verdict}
    assert one.columns == names and {r.doc_id: r.text for r in one.collect()} == left
    two = written(stages["exact dedup"](spark, one, SF))
    left = {i: left[i] for i, _, _, kept, _ in brute.exact(list(left.items())) if kept}
    assert two.columns == names and {r.doc_id: r.text for r in two.collect()} == left
    three = written(stages["MinHash near-dedup"](spark, two, SF))
    left = {i: left[i] for i, _, _, kept in brute.near(list(left.items())) if kept}
    assert three.columns == names and {r.doc_id: r.text for r in three.collect()} == left
    four = written(stages["mixing sources to target weights"](spark, three, SF))
    taken = {i: (t, n) for i, _, n, t in brute.mix([(i, t, sources[i]) for i, t in left.items()])}
    copies = Counter(r.doc_id for r in four.collect())
    assert four.columns == names and copies == Counter({i: int(a / b + 0.5) for i, (a, b) in taken.items() if b and int(a / b + 0.5)})
    five = stages["BPE encoding and decoding"](spark, four, SF)
    encoder = bpe_chunks.ChunkEncoder(bpe_chunks.default_tokenizer())
    expected = Counter()
    for i, n in copies.items():
        ids = encoder.tokenizer.encode(left[i], add_special_tokens=False).ids
        expected[(i, len(ids), brute.sha(" ".join(map(str, ids))))] += n
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256) for r in five.collect()) == expected
    assert near_dedup.near_groups(four.dropDuplicates(["doc_id"])).where("not kept").count() == 0


def test_stages_on_awkward_rows(spark, docs):
    """Nulls, empty and blank texts, repeated rows and ids, ties, clashing columns: each stage gives its defined result."""
    name = lambda df: Counter((r.id, r.h) for r in df.select(null_safe("doc_id").alias("id"), F.xxhash64("text").alias("h")).collect())
    stages, at = dict(corpus_pipeline.STAGES), docs
    every = name(docs)
    for stage in list(stages)[:4]:
        before, after = at, written(stages[stage](spark, at, SF))
        assert after.columns == docs.columns
        if stage != "mixing sources to target weights":
            assert name(after) <= name(before) <= every
        at = after
    last = stages["BPE encoding and decoding"](spark, at, SF)
    assert last.count() == at.count() > 0
    two = written(stages["exact dedup"](spark, docs, SF))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert two.count() == len({x[4] for x in brute.exact(rows)})
    three = written(stages["MinHash near-dedup"](spark, docs, SF))
    shingled = [x for x in brute.near(rows) if x[1]]
    assert three.where(F.col("text").rlike(r"[^\x20\x09-\x0D]")).count() == len({x[2] for x in shingled})
    four = Counter(r.doc_id for r in stages["mixing sources to target weights"](spark, docs, SF).select("doc_id").collect())
    expected = Counter()
    for i, _, n, t in brute.mix([(r.doc_id, r.text, r.source) for r in docs.collect()]):
        expected[i] += int(t / n + 0.5) if n else 0
    assert four == +expected


def test_stages_on_an_empty_table(spark, none):
    at = none
    for _, stage in corpus_pipeline.STAGES:
        at = written(stage(spark, at, SF))
        assert at.count() == 0
    assert set(at.columns) == {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"}


def test_run_is_the_stages(spark):
    found = corpus_pipeline.run(spark, SF)
    assert set(found.columns) == {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"} and found.count() > 0


def test_every_numbered_operator_is_registered():
    import __spark_entry__ as entry

    for n in range(1, 11):
        assert sum(q.startswith(f"op{n}_") for q in entry.queries()) == 1
    assert "pipeline" in entry.queries()
