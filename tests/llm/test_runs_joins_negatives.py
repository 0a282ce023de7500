"""Periodic runs, the Jaccard join and hard negatives against their definitions."""

from __future__ import annotations

import random
from collections import Counter

import brute
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomlens.llm import hard_negatives, jaccard_join, periodic_runs, queries

RUNS = ("doc_id", "n_words", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def found(df, *columns):
    return Counter(tuple(r[c] for c in columns) for r in df.select(*columns).collect())


# ---- periodic runs ----
@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=40), st.lists(st.integers(0, 3), min_size=1, max_size=9), st.integers(0, 9), st.integers(0, 8), st.lists(st.integers(0, 2), max_size=20))
def test_runs_of_words_that_repeat(before, block, times, cut, after):
    w = before + block * times + block[:cut] + after
    for least in (3, 24):
        expected = brute.runs(w, least)
        assert [(s, e - s, q) for s, e, q in periodic_runs.find_runs(np.array(w, np.int64), least).tolist()] == expected


def test_runs_of_long_sequences():
    r = random.Random(2)
    for _ in range(40):
        w = [r.randrange(4) for _ in range(r.randrange(500))]
        a = r.randrange(len(w) + 1)
        w = w[:a] + (w[a : a + 1 + (len(w) - a) // (3 + r.randrange(8))] * 99)[: len(w) - a] + w[:a] * r.randrange(4)
        assert [(s, e - s, q) for s, e, q in periodic_runs.find_runs(np.array(w, np.int64), 12).tolist()] == brute.runs(w, 12)


def test_strongest_run_is_exact():
    assert periodic_runs._strongest(np.array([[9, 39, 10], [5, 35, 10], [5, 20, 5]])).tolist() == [5, 20, 5]
    assert periodic_runs._strongest(np.array([[0, 30_000_001, 10_000_000], [50, 50 + 30_000_002, 10_000_000]])).tolist() == [50, 50 + 30_000_002, 10_000_000]


@pytest.mark.parametrize("alter", [None, periodic_runs.with_period])
def test_collapsed_runs(spark, docs, rows, none, alter):
    df = periodic_runs.collapsed_runs(docs, alter=alter)
    assert found(df, *RUNS) == Counter(brute.periodic(r[0], r[1], alter is not None) for r in rows)
    assert periodic_runs.collapsed_runs(none).count() == 0


def test_collapsed_texts(spark):
    texts = spark.createDataFrame([(1, "x " + "la di da  " * 20 + "end"), (2, None), (3, "a b " * 5), (None, "z " * 24)], "doc_id long, text string")
    out = {r.doc_id: r for r in periodic_runs.collapsed_runs(texts, texts=True).collect()}
    assert out[1].collapsed_text == "x la di da end" and [tuple(x) for x in out[1].runs] == [(1, 60, 3)]
    assert out[2].collapsed_text == "" and out[2].runs == [] and out[3].collapsed_text == "a b " .strip() + " a b" * 4
    assert out[None].collapsed_text == "z" and (out[None].period, out[None].exponent_milli) == (1, 24000)


# ---- Jaccard join ----
JOIN = ("doc_id", "n_shingles", "component_id")


def linked(docs):
    return Counter(x[:3] for x in brute.near(docs, 80))


@pytest.mark.parametrize("leaf", [1024, 6])
def test_jaccard_join(docs, rows, none, leaf):
    assert found(jaccard_join.joined_components(docs, leaf=leaf, bucket_bytes=30_000), *JOIN) == linked([(r[0], r[1]) for r in rows])
    assert jaccard_join.joined_components(none).count() == 0


def test_jaccard_join_splits_regions(spark, monkeypatch):
    """Families of near copies about the limit, a chain, and sets at exactly the limit from each other and from a pivot."""
    r, texts = random.Random(5), []
    vocabulary = [f"w{i}" for i in range(400)]
    for _ in range(3):
        base = r.choices(vocabulary, k=110)
        for _ in range(40):
            w = list(base)
            for _ in range(r.randrange(9)):
                w[r.randrange(len(w))] = r.choice(vocabulary)
            texts.append(" ".join(w))
    base = r.choices(vocabulary, k=90)
    for _ in range(40):
        base = base[2:] + r.choices(vocabulary, k=2)
        texts.append(" ".join(base))
    a, b = [f"a{i}" for i in range(84)], [f"b{i}" for i in range(20)]
    texts += [" ".join(a), " ".join(a + b), " ".join(a[80:] + b)]
    r.shuffle(texts)
    docs = list(enumerate(texts))
    splits, split = [], jaccard_join._split
    monkeypatch.setattr(jaccard_join, "_split", lambda *x: splits.append(1) or split(*x))
    out = jaccard_join.joined_components(spark.createDataFrame(docs, "doc_id long, text string"), leaf=8, bucket_bytes=20_000)
    assert found(out, *JOIN) == linked(docs) and splits


def test_prefixes_drop_documents_that_hold_enough_of_their_own(spark):
    """A passage in all documents makes no candidates as long as each has more than a fifth of its own."""
    r = random.Random(1)
    passage = " ".join(f"p{i}" for i in range(70))
    texts = [passage + " " + " ".join(f"{r.random()}" for _ in range(70)) for _ in range(300)]
    texts[7] = texts[3].replace("p1 ", "")
    kept = jaccard_join.candidates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 80, 20_000)
    assert {x.doc_id for x in kept.where("prefix is not null").collect()} == {3, 7}


def test_windows_hold_every_pair_within_reach():
    """Of two points within reach, one stands in the other's home region, whatever the pivots."""
    r = np.random.default_rng(3)
    for _ in range(60):
        sets = [frozenset(r.choice(14, r.integers(1, 11), replace=False).tolist()) for _ in range(60)]
        sets += [s | {20} for s in sets[:20]]
        gap = lambda a, b: 1 - len(a & b) / len(a | b)
        distance = np.array([[gap(s, p) for p in sets[:5]] for s in sets])
        row, region, home = jaccard_join.voronoi(distance, 0.2)
        inside, homes = set(zip(row.tolist(), region.tolist(), strict=True)), dict(zip(row[home].tolist(), region[home].tolist(), strict=True))
        assert sorted(homes) == list(range(len(sets)))
        for i, a in enumerate(sets):
            for j in range(i):
                if 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                    assert (i, homes[j]) in inside or (j, homes[i]) in inside


# ---- hard negatives ----
@settings(max_examples=100, deadline=None)
@given(st.integers(1, 20), st.integers(0, 7), st.integers(0, 7), st.sampled_from([1, 5, 300, 1 << 27]), st.integers(0, 99))
def test_scores_are_inner_products(dims, n_anchors, n_rows, most, seed):
    r = np.random.default_rng(seed)
    anchors, rows = r.integers(-most, most + 1, (n_anchors, dims)), r.integers(-most, most + 1, (n_rows, dims))
    planes = hard_negatives.bit_planes(rows)
    tables = hard_negatives._narrow(hard_negatives.subset_sums(anchors), planes)
    assert (hard_negatives.scores(tables, planes) == rows @ anchors.T).all()


MINED = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


@pytest.mark.parametrize("sizes", [(1024, 8192), (2, 16)])
def test_hard_negatives(spark, sizes):
    r = random.Random(4)
    vectors = [[r.choice([0.5, -0.25, 0.0, 1.0]) + r.random() / 8 for _ in range(12)] for _ in range(260)]
    table = [(i, v, r.choice([0, 0, 0, 1, 2])) for i, v in enumerate(vectors)]
    table += [(i + 300, vectors[3], k % 3) for i, k in enumerate(range(30))]  # ties
    table += [(50, vectors[50], table[50][2]), (61, vectors[61], table[61][2]), (61, vectors[62], 1), (None, vectors[5], 0), (None, vectors[6], 1)]
    table += [(400, None, 1), (450, vectors[9], None), (401, [None, *vectors[1][1:]], 1), (402, [float("nan"), *vectors[1][1:]], 1), (403, [float("inf")] * 12, 0), (404, [], 0), (405, vectors[8][:5], 1)]
    df = spark.createDataFrame([(*x, 1, "a") for x in table], "vec_id long, embedding array<double>, label int, anchor long, score string")
    rows = hard_negatives.whole_numbers(hard_negatives.relabelled(df))
    expected = Counter(set(brute.negatives(table)))
    assert found(hard_negatives.mine(rows, sizes=sizes).distinct(), *MINED) == expected and len(expected) > 50
    assert hard_negatives.mine(rows.limit(0)).count() == 0


# ---- the registered queries against their SQL ----
@pytest.mark.parametrize("name", ["op11_periodic_runs", "op12_jaccard_join", "op13_hard_negatives"])
def test_query_equals_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    out = con.execute(queries.ORACLES[name])
    columns = [c[0] for c in out.description]
    assert found(queries.QUERIES[name](spark, "/root/testdata/sf0.001"), *columns) == Counter(out.fetchall())
