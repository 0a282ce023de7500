from __future__ import annotations

import math
import zlib
from collections import Counter

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from loomlens.llm import bpe_chunks, exact_dedup, line_dedup, mixing, near_dedup, quality, sharding, substring_dedup, token_lengths, toxicity


def rows_of(df, *columns):
    return Counter(tuple(r[c] for c in columns) for r in df.select(*columns).collect())


def pairs(rows):
    return [(r[0], r[1]) for r in rows]


def test_token_lengths(docs, rows, none):
    encode = token_lengths._encoding(*token_lengths.default_vocabulary()).encode_ordinary
    lengths = [len(encode(r[1] or "")) for r in rows]
    counts = token_lengths.with_token_counts(docs)
    found = {r.n_tokens: r for r in token_lengths.length_histogram(counts, block=64).collect()}
    assert sorted(found) == sorted(set(lengths))
    for n, r in found.items():
        assert r.n_docs == lengths.count(n) and r.total_tokens == sum(lengths)
        assert r.n_longer_docs == sum(x > n for x in lengths) and r.tokens_from == sum(x for x in lengths if x >= n)
        assert r.truncated_total == sum(min(x, n) for x in lengths) and r.lost_tokens == sum(max(0, x - n) for x in lengths)
        assert r.share_up_to == pytest.approx(sum(x <= n for x in lengths) / len(lengths))
    histogram = token_lengths.length_histogram(counts)
    for r in token_lengths.at_limits(histogram, [0, 7, 10**6]).collect():
        assert r.truncated_total == sum(min(x, r.context_limit) for x in lengths) and r.n_longer_docs == sum(x > r.context_limit for x in lengths)
    for r in token_lengths.quantiles(histogram, [0.1, 0.5, 1.0]).collect():
        assert r.n_tokens == sorted(lengths)[max(0, -(-int(r.share * 1000 * len(lengths)) // 1000) - 1)]
    assert token_lengths.length_histogram(token_lengths.with_token_counts(none)).count() == 0


def test_mixing(docs, rows, none):
    found = mixing.mix_sources(docs).collect()
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len(brute.words(r[1]))
    names = sorted(s for s in sizes if s is not None) + [None]
    weight = dict(zip(names, (5.0, 2.0, 1.0) * 9, strict=False))
    left, open_, target = 1.5 * sum(sizes.values()), set(names), {}
    while True:  # reshare until no source is above twice its size
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * sizes[s]}
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        open_ -= over
    by_id = {r[0]: r[3] for r in rows}
    taken = Counter()
    for r in found:
        assert 0 <= r.taken <= 2 * r.size
        taken[by_id[r.doc_id] if r.doc_id is not None else "?"] += r.taken
    assert Counter((r.doc_id, r.size) for r in found) == Counter((r[0], len(brute.words(r[1]))) for r in rows)
    one = {(r.source_size, round(r.target, 6)) for r in found}
    assert one == {(sizes[s], round(target[s], 6)) for s in names}
    assert sum(taken.values()) == pytest.approx(1.5 * sum(sizes.values()), abs=8 * len(names) + 8)
    expected = Counter((i, n, t) for i, _, n, t in brute.mix([(r[0], r[1], r[3]) for r in rows]))
    assert rows_of(mixing.mix_sources(docs), "doc_id", "size", "taken") == expected
    # Again, dealt otherwise, and with shards laid out in many ranges.
    assert rows_of(mixing.mix_sources(docs.repartition(5), group_rows=1), "doc_id", "size", "taken") == expected
    assert mixing.mix_sources(none).count() == 0
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns and max(mixed.groupBy("doc_id", "text").count().where("doc_id <> 8").select(F.max("count")).first()) <= 4


def test_sainte_lague_gives_highest_quotients(spark):
    r = np.random.default_rng(3)
    parties = [(g, p, float(r.integers(1, 10**6)) if p else 0.0, int(s)) for g, s in (("a", 0), ("b", 7), ("c", 1001)) for p in range(12)]
    df = spark.createDataFrame(parties, "g string, p int, w double, seats long")
    found = {(x.g, x.p): x.quota for x in mixing.sainte_lague(df, ["g"], "w", "seats", ["p"]).collect()}
    for g, seats in (("a", 0), ("b", 7), ("c", 1001)):
        own = [(p, w) for h, p, w, _ in parties if h == g]
        best = sorted(((-w / (2 * k + 1), p, k) for p, w in own for k in range(seats + 1)))[:seats]
        assert {p: sum(1 for _, q, _ in best if q == p) for p, _ in own} == {p: found[g, p] for p, _ in own}


def test_sharding(docs, rows, none):
    found = sharding.shard_documents(docs).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32, r.shard, r.grown_shard, r.law) for r in found) == Counter(
        (r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode()), brute.jump(r[0] or 0, 16), brute.jump(r[0] or 0, 17), "key") for r in rows
    )
    for s in range(16):
        slots = sorted(r.slot for r in found if r.shard == s)
        assert slots == list(range(len(slots)))
    assert sharding.shard_documents(none).count() == 0


def test_jump_hash_moves_rows_only_to_the_new_shard(spark):
    ids = spark.createDataFrame([(x,) for x in [0, 1, -1, 2**62, -(2**63), *range(10**6, 10**6 + 500)]], "k long")
    for n in (1, 2, 9, 40):
        for r in ids.select("k", sharding.jump_hash(F.col("k"), n).alias("a"), sharding.jump_hash(F.col("k"), n + 1).alias("b")).collect():
            assert r.a == brute.jump(r.k % (1 << 64), n) and r.b in (r.a, n)


@pytest.mark.parametrize("bucket_bytes", [2_000, 8_000_000])
def test_substring_dedup(docs, rows, none, bucket_bytes):
    found = substring_dedup.without_repeated_passages(docs, bucket_bytes=bucket_bytes)
    assert rows_of(found, "doc_id", "n_words", "n_removed", "kept_sha256") == Counter(brute.passages(pairs(rows)))
    assert substring_dedup.without_repeated_passages(none).count() == 0


def test_substring_dedup_spreads_rows_without_an_id(spark):
    """Null ids, one repeated id, and copies of one row are dealt to many buckets."""
    texts = [f"w{i} " * 20 for i in range(200)]
    rows = [(None, t) for t in texts] + [(5, t) for t in texts] + [(None, "the same words again " * 9)] * 200
    dealt = substring_dedup.bucketed(spark.createDataFrame(rows, "doc_id long, text string").repartition(40), 30)
    assert dealt.groupBy("_bucket").count().agg(F.max("count")).first()[0] < 90
    few = rows[:3] + rows[200:203] + rows[-4:] + [(1, texts[1]), (9, "the same words again " * 9)]
    found = substring_dedup.without_repeated_passages(spark.createDataFrame(few, "doc_id long, text string").repartition(5), bucket_bytes=300)
    assert rows_of(found, "doc_id", "n_words", "n_removed", "kept_sha256") == Counter(brute.passages(few))


def test_substring_dedup_texts(docs):
    r = substring_dedup.without_repeated_passages(docs, texts=True).where("doc_id = 9").first()
    assert brute.sha(r.kept_text) == r.kept_sha256 and "changed" in r.kept_text


@pytest.mark.parametrize("counters", [1, 4, 1024])
def test_exact_dedup(docs, rows, none, counters):
    found = exact_dedup.exact_groups(docs, counters=counters)
    assert rows_of(found, "doc_id", "keep_id", "group_size", "kept", "text_sha256") == Counter(brute.exact(pairs(rows)))
    assert exact_dedup.exact_groups(none).count() == 0
    left = exact_dedup.deduplicated(docs, counters=counters)
    assert left.columns == docs.columns and left.count() == len({r[4] for r in brute.exact(pairs(rows))})


def test_misra_gries_keeps_every_frequent_value():
    values = ["a"] * 40 + ["b"] * 30 + [f"x{i}" for i in range(60)]
    np.random.default_rng(1).shuffle(values)
    found = exact_dedup.misra_gries(values[65:], 5, exact_dedup.misra_gries(values[:65], 5))
    assert {"a", "b"} <= set(found) and len(found) <= 5
    assert all(values.count(k) - len(values) / 6 <= v <= values.count(k) for k, v in found.items())


def test_quality_statistics(docs, rows, none):
    found = quality.quality_verdicts(docs)
    assert rows_of(found, "doc_id", *quality.STATISTICS) == Counter((r[0], *brute.statistics(r[1])) for r in rows)
    for r in found.collect():
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) and not (r.base_failed and r.kept)
    assert quality.quality_verdicts(none).count() == 0
    good = quality.good_documents(docs)
    assert good.columns == docs.columns and rows_of(good, "doc_id") == rows_of(found.where("kept"), "doc_id")


def test_quality_distances_against_numpy(spark):
    """The estimates of two groups, one small, hold against a search in numpy; the distances follow from them."""
    r = np.random.default_rng(8)
    rows = []
    for i in range(140):
        words = ["".join(r.choice(list("abcdefgh"), max(1, int(r.normal(5, 2))))) for _ in range(int(r.integers(25, 90)))]
        words += ["#$"] * int(r.integers(0, 3)) * (i % 5 == 0)
        lines = [" ".join(words[k : k + 9]) for k in range(0, len(words), 9)]
        rows.append((i, "\n".join(lines + lines[:1] * (i % 7 == 0)), "en", "big" if i % 10 else "small"))
    found = {x.doc_id: x for x in quality.quality_verdicts(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    x, fails = np.zeros((140, 4)), np.zeros(140, bool)
    for i, t, *_ in rows:
        n, chars, symbols, dup, repeat = brute.statistics(t)
        fails[i] = n < 20 or 100 * repeat > 30 * n
        x[i] = np.log((chars + 100) / (n + 20)), np.sqrt(symbols / (n + 20)), np.sqrt(dup / (len(t.split("\n")) + 5)), np.sqrt(repeat / (n + 20))

    def squared(v, m, c):
        d = v - m
        return (d @ np.linalg.inv(c + np.diag(np.square(quality.FLOORS))) * d).sum(axis=1)

    def step(v, m, c):
        bins = np.floor(8 * np.log2(squared(v, m, c) + 1e-6))
        near = v[bins <= np.sort(bins)[int(np.ceil(len(v) * 0.75)) - 1]]
        return near.mean(axis=0), np.cov(near.T, bias=True) * quality.CONSISTENT

    volume = lambda c: np.linalg.slogdet(c + np.diag(np.square(quality.FLOORS)))[1]
    triangle = [(i, j) for i in range(4) for j in range(i + 1)]

    def matrix(state):
        c = np.zeros((4, 4))
        for i, j in triangle:
            c[i, j] = c[j, i] = state[f"c{i}{j}"]
        return np.array([state[f"m{i}"] for i in range(4)]), c

    small = np.array([i % 10 == 0 for i in range(140)])
    groups = {"all": ~fails, "small": small & ~fails, "big": ~small & ~fails}
    table = [(g, *map(float, x[i])) for g, of in groups.items() for i in np.flatnonzero(of)]
    states = {s.group: s for s in quality.robust_estimates(spark.createDataFrame(table, "group string, x0 double, x1 double, x2 double, x3 double")).collect()}
    for g, of in groups.items():
        v, (m, c) = x[of], matrix(states[g])
        assert states[g].n == len(v) and states[g].volume == pytest.approx(volume(c), rel=1e-6)
        assert volume(step(v, m, c)[1]) >= states[g].volume - 2e-6  # it has converged
        best = np.inf
        for _ in range(300):  # a search of its own, from random subsets
            few = v[r.choice(len(v), 8, replace=False)]
            state = few.mean(axis=0), np.cov(few.T, bias=True)
            for _ in range(12):
                state = step(v, *state)
                best = min(best, volume(state[1]))
        assert states[g].volume <= best + 0.15, g
    whole = matrix(states["all"])
    for g, group in (("small", small), ("big", ~small)):
        n = int(groups[g].sum())
        m, c = ((a * n + b * 50) / (n + 50) for a, b in zip(matrix(states[g]), whole, strict=True))
        for i, d in zip(np.flatnonzero(group), squared(x[group], m, c), strict=True):
            assert found[i].distance == pytest.approx(d, rel=1e-4) and found[i].kept == (not fails[i] and d <= quality.CUTOFF)


def test_quality_rejects_outliers_and_keeps_clean(spark):
    r = np.random.default_rng(5)
    clean = [" ".join("".join(r.choice(list("abcdefgh"), max(1, int(r.normal(5, 2))))) for _ in range(120)) for _ in range(150)]
    junk = [" ".join(w + "###" for w in c.split()) for c in clean[:12]] + [" | ".join(c.split()) for c in clean[12:20]]
    df = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(clean + junk)], "doc_id long, text string, lang string, source string")
    kept = {x.doc_id for x in quality.quality_verdicts(df).where("kept").collect()}
    assert len(kept & set(range(150))) >= 148 and not kept & set(range(150, 170))


@pytest.mark.parametrize("heavy_share", [3, 1024])
def test_line_dedup(docs, rows, none, heavy_share):
    found = line_dedup.line_report(docs, heavy_share=heavy_share)
    expected = Counter(brute.lines_left(pairs(rows)))
    assert sum(x[2] for x in expected) > 0
    assert rows_of(found, "doc_id", "n_lines", "n_dropped", "kept_sha256") == expected
    assert line_dedup.line_report(none).count() == 0


def test_line_dedup_of_many_lines(spark):
    line = "a long line that stands in all of the documents here"
    texts = ["\n".join([f"{i} {j}" for j in range(200)] + [line] + [line] * (i % 3)) for i in range(7)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert rows_of(line_dedup.line_report(df), "doc_id", "n_lines", "n_dropped", "kept_sha256") == Counter(brute.lines_left(list(enumerate(texts))))


def test_near_dedup(docs, rows, none):
    found = near_dedup.near_groups(docs)
    assert rows_of(found, "doc_id", "n_shingles", "component_id", "kept") == Counter(brute.near(pairs(rows)))
    assert near_dedup.near_groups(none).count() == 0
    left = near_dedup.near_deduplicated(docs)
    components = {(x[2], x[0] if not x[1] else None) for x in brute.near(pairs(rows))}
    assert left.columns == docs.columns and left.count() == len(components)


def test_near_dedup_of_a_large_group(spark):
    """More near copies than a small node holds, a chain of links, and texts that only share a passage."""
    r = np.random.default_rng(2)
    base = [f"w{x}" for x in r.integers(0, 5000, 200)]
    texts = []
    for _ in range(90):
        own = list(base)
        for p in r.integers(0, 200, 3):
            own[p] = f"z{r.integers(0, 10**6)}"
        texts.append(" ".join(own))
    chain = [f"c{x}" for x in range(400)]
    texts += [" ".join(chain[12 * i : 12 * i + 200]) for i in range(9)]
    texts += [" ".join(base[:30] + [f"y{x}" for x in r.integers(0, 10**6, 150)]) for _ in range(60)]
    docs = list(enumerate(texts))
    found = near_dedup.near_groups(spark.createDataFrame(docs, "doc_id long, text string"))
    assert rows_of(found, "doc_id", "n_shingles", "component_id", "kept") == Counter(brute.near(docs))


def test_near_dedup_of_rows_without_or_with_one_id(spark):
    """Null and repeated ids link nothing: unlike texts stay, and near copies of different rows aren't joined by them."""
    r = np.random.default_rng(4)
    text = lambda: [f"n{x}" for x in r.integers(0, 10**6, 60)]
    near = lambda t: " ".join([*t[:-1], "changed"])
    a, b, c, d, e, f = (text() for _ in range(6))
    say = " ".join
    docs = [(None, say(a)), (None, say(b)), (None, say(c)), (None, near(c)), (1, near(a)), (2, near(b)), (3, say(d)), (3, say(e)), (4, near(e)), (None, ""), (None, None), (None, say(f)), (None, say(f))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    found = near_dedup.near_groups(df)
    ids = {(i, t): x for i, t, x in ((r.doc_id, r._text, r.component_id) for r in found.collect())}
    hashes = {t: h for t, h in df.select("text", F.xxhash64("text")).distinct().collect()}
    assert {(i, t): ids[i, hashes[t]] for i, t in docs} == {(i, t): {say(a): 1, say(b): 2}.get(t, i if i != 4 else 3) for i, t in docs}
    left = Counter((r.doc_id, r.text) for r in near_dedup.near_deduplicated(df).collect())
    assert sum(left.values()) == 8 and set(left.values()) == {1}
    assert {(1, near(a)), (2, near(b)), (3, say(d)), (3, say(e)), (None, ""), (None, None), (None, say(f))} <= set(left)
    assert len({(None, say(c)), (None, near(c))} & set(left)) == 1
    assert found.where("doc_id is null and kept").count() == 5


@pytest.mark.parametrize("leaf", [4, 25])
def test_near_dedup_of_large_nodes(spark, docs, rows, leaf, monkeypatch):
    """With small groups: centres, children, blocks; texts that resemble each other and mostly aren't linked; long ones compared by parts."""
    monkeypatch.setattr(near_dedup, "WHOLE", 64)
    monkeypatch.setattr(near_dedup, "CENTRES", 2)
    r = np.random.default_rng(leaf)
    base, long = ([f"w{x}" for x in r.integers(0, 5000, n)] for n in (150, 900))
    texts = []
    for k in range(130):
        own = list(base if k % 3 else long)
        for p in r.integers(0, len(own), int(r.integers(1, 12 if k % 3 else 70))):
            own[p] = f"z{r.integers(0, 10**6)}"
        texts.append(" ".join(own))
    table = list(enumerate(texts))
    found = near_dedup.near_groups(spark.createDataFrame(table, "doc_id long, text string"), leaf=leaf)
    expected = Counter(brute.near(table))
    assert 10 < sum(x[3] for x in expected) < 110
    assert rows_of(found, "doc_id", "n_shingles", "component_id", "kept") == expected
    assert rows_of(near_dedup.near_groups(docs, leaf=leaf), "doc_id", "n_shingles", "component_id", "kept") == Counter(brute.near(pairs(rows)))


def test_near_dedup_joining():
    """The links of groups give the components of brute force, and never more links than sets."""
    r = np.random.default_rng(3)
    sets, path = [], []
    for group in range(30):
        base = r.integers(0, 2**63, 60).astype(np.uint64)
        for _ in range(int(r.integers(1, 9))):
            own = base.copy()
            own[r.integers(0, 60, int(r.integers(0, 14)))] = r.integers(0, 2**63)
            sets.append(np.unique(own))
            path.append(group)
    n = len(sets)
    links = list(near_dedup.joining(np.array(path), sets, np.zeros(n, np.int64), np.arange(n), np.ones(n, bool), 75))
    assert len(links) < n and all(g == 2 for _, _, g in links)

    def components(edges):
        at = list(range(n))
        for a, b in edges:
            old, new = at[a], at[b]
            at = [new if x == old else x for x in at]
        return {frozenset(i for i in range(n) if at[i] == c) for c in at}

    like = lambda a, b: 100 * len(a & b) >= 75 * len(a | b)
    every = [set(s.tolist()) for s in sets]
    assert components([x[:2] for x in links]) == components([(a, b) for a in range(n) for b in range(a) if path[a] == path[b] and like(every[a], every[b])])


def test_near_dedup_loss():
    """The chance to lose a pair at 0.75, counted exactly over how many of the sketch's coordinates agree."""
    n, s, choose = near_dedup.SKETCH, 0.75, math.comb
    missed = 0.0
    for same in range(n + 1):
        lost = 0.0  # of a pair that meets in a node: in none of its children that lead to a comparison
        for m in reversed(near_dedup.BRANCH):
            lost = sum(choose(same, j) * choose(n - same, m - j) / choose(n, m) * lost**j for j in range(m + 1))
        trees = sum(choose(same, j) * choose(n - same, near_dedup.TREES - j) / choose(n, near_dedup.TREES) * lost**j for j in range(near_dedup.TREES + 1))
        missed += choose(n, same) * s**same * (1 - s) ** (n - same) * trees
    p = (1 - s) * (1 - 0.5 ** len(near_dedup.PLANES))
    unlike = sum(choose(n, i) * p**i * (1 - p) ** (n - i) for i in range(near_dedup.differing(75) + 1, n + 1))
    assert missed + unlike < 1e-9


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 105), (105, 101)]
    found = {x.node: x.component for x in near_dedup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(41)} | {100: 100, 101: 100, 105: 100}


@pytest.mark.parametrize("mean_bytes", [7, 512])
def test_bpe_chunks(docs, rows, none, mean_bytes):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe_chunks.default_tokenizer())
    expected = Counter()
    for r in rows:
        ids = library.encode(r[1] or "", add_special_tokens=False).ids
        expected[(r[0], len(ids), brute.sha(" ".join(map(str, ids))), brute.sha(library.decode(ids, skip_special_tokens=False)))] += 1
    found = bpe_chunks.encode_documents(docs, mean_bytes=mean_bytes)
    assert rows_of(found, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == expected
    assert bpe_chunks.encode_documents(none).count() == 0


def test_bpe_chunks_of_odd_texts_and_small_stores():
    encoder = bpe_chunks.ChunkEncoder(bpe_chunks.default_tokenizer(), mean_bytes=5, word_store=3, chunk_bytes=100)
    odd = ["", " ", "Hello HELLO hello", "A.B, C. d, e.", "can't won't I'LL", "Σας ΣΑΣ ﬁ Å Å", "x\u0085y z", "<|startoftext|> a<|endoftext|>", "a < | b", "é ́e", "12 3,4. 5", "👍🏽 ok", "a,́ b., c", "K. K,", "--- ... ,,, ."] * 3
    for text, (n, ids, decoded) in zip(odd, encoder.encode_all([t.encode() for t in odd]), strict=True):
        own = encoder.tokenizer.encode(text, add_special_tokens=False).ids
        assert (n, ids, decoded) == (len(own), " ".join(map(str, own)), encoder.tokenizer.decode(own, skip_special_tokens=False)), text


def test_bpe_chunks_of_random_texts():
    """Random strings of awkward pieces, cut every few bytes, are encoded as the library does."""
    r = np.random.default_rng(12)
    pieces = ["a", "B", "word", "Words", "don't", "'s", "12", "3", ".", ",", "...", "!?", "#", "é", "E\u0301", "\u0301", "Σ", "ς", "İ", "ß", "日本", "👍🏽", "\u200d", "<|endoftext|>", "<|", "|>", "_", "-"]
    gaps = ["", "", "", " ", " ", "  ", "\n", "\t", "\r\n", "\x0b", "\x0c", "\xa0", "\u2003", "\x85", "\x00", "\x1c"]
    texts = ["".join(pieces[r.integers(len(pieces))] + gaps[r.integers(len(gaps))] for _ in range(int(r.integers(1, 60)))) for _ in range(1500)]
    for mean_bytes in (6, 64):
        encoder = bpe_chunks.ChunkEncoder(bpe_chunks.default_tokenizer(), mean_bytes=mean_bytes)
        for text, (n, ids, decoded) in zip(texts, encoder.encode_all([t.encode() for t in texts]), strict=True):
            own = encoder.tokenizer.encode(text, add_special_tokens=False).ids
            assert (n, ids, decoded) == (len(own), " ".join(map(str, own)), encoder.tokenizer.decode(own, skip_special_tokens=False)), repr(text)


def test_bpe_chunks_refuses_tokenizers_that_keep_white_space():
    import public_tokenizers

    with pytest.raises(ValueError, match="white space"):
        bpe_chunks.ChunkEncoder(public_tokenizers.path("byte_bpe_50k.json"))


def test_a_join_that_disagrees_is_repaired():
    """With a store that claims a wrong word, the check at the joins sends the text back as a whole."""
    encoder = bpe_chunks.ChunkEncoder(bpe_chunks.default_tokenizer(), mean_bytes=5)
    text = " ".join(f"number{i} words" for i in range(30)).encode()
    right = encoder.encode_all([text])[0]
    wrong = (1, "7", "x")
    encoder.words = {w: wrong for w in encoder.words}
    encoder.chunks.clear()
    encoder.sound.clear()
    assert encoder.encode_all([text])[0] == right


def test_chunks_shared_across_texts_are_encoded_once():
    encoder = bpe_chunks.ChunkEncoder(bpe_chunks.default_tokenizer(), mean_bytes=64)
    passage = " ".join(f"word{i}" for i in range(400)).encode()
    encoder.encode_all([b"start here " + passage])
    assert len(encoder.chunks) > 20
    before = encoder.encoded_bytes
    encoder.encode_all([b"another beginning of a text " + passage])
    assert encoder.encoded_bytes - before < 0.1 * len(passage)


def test_toxicity_gradients():
    texts = toxicity.Texts([b"a bb ccc dddd a bb zz yy", b"x yy a", b"q"])
    net = toxicity.Network(np.unique(texts.hashes)[:5], 1)
    net.p = {k: v.astype(np.float64) * 3 for k, v in net.p.items()}
    first, y = np.cumsum(texts.counts) - texts.counts, np.array([1.0, 0, 1])
    _, grads = net.gradients(texts, first, texts.counts, y)
    for k, g in grads.items():
        flat, at = net.p[k].reshape(-1), int(np.abs(g).argmax())
        old, sides = flat[at], []
        for d in (1e-3, -1e-3):
            flat[at] = old + d
            sides.append(net.gradients(texts, first, texts.counts, y)[0])
        flat[at] = old
        assert (sides[0] - sides[1]) / 2e-3 == pytest.approx(g.reshape(-1)[at], rel=2e-2, abs=1e-4), k


def test_toxicity(spark, docs, rows, none):
    r = np.random.default_rng(4)
    plain = lambda n: [f"w{x}" for x in r.integers(0, 300, n)]
    texts, labels = [], []
    for i in range(400):
        words = plain(int(r.integers(10, 200)))
        if i % 4 == 0:
            words[int(r.integers(len(words)))] = "vilething"
        texts.append((i, " ".join(words)))
        labels.append((i, int(i % 4 == 0)))
    df, known = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    net = toxicity.fit(df, known)
    found = {x.doc_id: x for x in toxicity.score_documents(df, net).collect()}
    held = [i for i, x in found.items() if x.held_out]
    assert all(x.held_out == (toxicity.fold(i) == 0) for i, x in found.items()) and len(held) > 40
    assert np.mean([found[i].predicted == labels[i][1] for i in held]) > 0.97
    every = toxicity.score_documents(docs, net).collect()
    assert len(every) == len(rows) and all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.5) for x in every)
    assert toxicity.score_documents(none, net).count() == 0
    untrained = toxicity.fit(docs, known.limit(0))
    assert {x.predicted for x in toxicity.score_documents(docs, untrained).collect()} == {0}


def test_toxicity_windows_cover_all_words():
    t = toxicity.Texts([b"a " * n for n in (0, 1, 63, 64, 65, 96, 97, 1000)])
    text, first, size = t.windows()
    begin = np.cumsum(t.counts) - t.counts
    for i, n in enumerate(t.counts):
        covered = {w for d, f, s in zip(text, first, size, strict=True) if d == i for w in range(f - begin[i], f - begin[i] + s)}
        assert covered == set(range(n)) and all(1 <= s <= toxicity.WINDOW for s in size)


def test_toxicity_scores_against_loops(rows):
    """Every score is that of the definition, and the same when a text is scored in stretches."""
    r = np.random.default_rng(6)
    texts = [t or "" for t in dict.fromkeys(x[1] for x in rows) if len(t or "") < 5000] + [" ".join(f"w{x}" for x in r.integers(0, 90, n)) for n in (31, 64, 65, 97, 300)]
    net = toxicity.Network(np.unique(toxicity.Texts([t.encode() for t in texts]).hashes)[::3], 2)
    net.p = {k: (v * 4).astype(np.float32) for k, v in net.p.items()}
    found = net.scores([t.encode() for t in texts])
    assert found == pytest.approx([brute.toxic(net, t) for t in texts], abs=2e-5) and found.std() > 0.01


def test_toxicity_of_a_long_text(monkeypatch):
    r = np.random.default_rng(7)
    text = " \n".join(f"w{x}" for x in r.integers(0, 900, 30_000)).encode()
    net = toxicity.Network(np.unique(toxicity.Texts([text]).hashes), 3)
    net.p = {k: (v * 4).astype(np.float32) for k, v in net.p.items()}
    whole = net.scores([b"a", text, b""])
    for windows in (1, 7, 10**6):
        parts = list(toxicity.stretches(toxicity.plain(text), windows))
        assert sum(len(toxicity.Texts([p]).windows()[0]) for p in parts) == len(toxicity.Texts([text]).windows()[0])
    monkeypatch.setattr(toxicity, "AT_ONCE", 5000)
    monkeypatch.setattr(toxicity, "STRETCH", 10)
    assert net.scores([b"a", text, b""]) == pytest.approx(whole, abs=1e-6)
