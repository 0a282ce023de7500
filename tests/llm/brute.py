"""Plain-Python forms of the operators, straight from their definitions."""

from __future__ import annotations

import hashlib
import heapq
import math
import re
import zlib
from collections import defaultdict
from fractions import Fraction

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SPACES = " \t\n\x0b\x0c\r"
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text):
    return WORD.findall(text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def order(doc_id):
    return float("inf") if doc_id is None else doc_id


def passages(docs, window=13):
    """{row: (n_words, n_removed, kept_sha256)} for rows (doc_id, text)."""
    first = {}
    for i, t in docs:
        w = words(t)
        for j in range(len(w) - window + 1):
            k = tuple(w[j : j + window])
            first[k] = min(first.get(k, float("inf")), order(i))
    out = []
    for i, t in docs:
        w = words(t)
        gone = set()
        for j in range(len(w) - window + 1):
            if first[tuple(w[j : j + window])] < order(i):
                gone.update(range(j, j + window))
        kept = [x for j, x in enumerate(w) if j not in gone]
        out.append((i, len(w), len(gone), sha(" ".join(kept))))
    return out


def exact(docs):
    groups = defaultdict(list)
    bare = [re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t in docs]
    for n, b in enumerate(bare):
        groups[b].append(n)
    out = []
    for n, (i, t) in enumerate(docs):
        best = min(groups[bare[n]], key=lambda m: (-len(docs[m][1] or ""), order(docs[m][0])))
        same = docs[best][0] == i and len(docs[best][1] or "") == len(t or "")
        out.append((i, docs[best][0], len(groups[bare[n]]), same, sha(bare[n])))
    return out


def statistics(text):
    t = text or ""
    w = words(t)
    lines = [x for x in t.split("\n") if words(x)]
    at = defaultdict(list)
    for i in range(len(w) - 7):
        at[tuple(w[i : i + 8])].append(i)
    twice = {j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(twice)


def lines_left(docs, min_chars=40, min_docs=5):
    key = lambda line: line.strip(SPACES).translate(LOWER)
    found = defaultdict(set)
    for i, t in docs:
        for line in (t or "").split("\n"):
            found[key(line)].add((i, t))
    out = []
    for i, t in docs:
        kept = []
        every = (t or "").split("\n")
        for line in every:
            k = key(line)
            last = max((d for d, _ in found[k] if d is not None), default=None)
            if not (len(k) >= min_chars and len(found[k]) >= min_docs and i != last):
                kept.append(line)
        out.append((i, len(every), len(every) - len(kept), sha("\n".join(kept))))
    return out


def shingles(text, n=5):
    w = words((text or "").translate(LOWER))
    return {tuple(w[j : j + n]) for j in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def near(docs, percent=75):
    sets = [shingles(t) for _, t in docs]
    big = float("inf")
    root = {order(i): order(i) for i, _ in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(docs)):
        for b in range(a):
            if sets[a] and sets[b]:
                common = len(sets[a] & sets[b])
                if 100 * common >= percent * len(sets[a] | sets[b]):
                    x, y = find(order(docs[a][0])), find(order(docs[b][0]))
                    root[max(x, y)] = min(x, y)
    out = []
    for (i, _), s in zip(docs, sets, strict=True):
        c = find(order(i)) if s else order(i)
        c = None if c == big else c
        out.append((i, len(s), c, i == c))
    return out


def jump(key, shards):
    at, b = 0, -1
    while at < shards:
        b = at
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        at = int((b + 1) * (float(1 << 31) / ((key >> 33) + 1)))
    return b


def toxic(net, text, window=64, step=32, trigrams=1 << 14):
    """The score of a text by loops over windows, words and gates, from a network's weights."""
    from loomlens.llm import toxicity

    p = {k: v.astype(float).tolist() for k, v in net.p.items()}
    data = b"\n" + toxicity.plain((text or "").encode()) + b"\n"
    spans = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", data)]
    own = {h: i for i, h in enumerate(net.vocabulary.tolist())}
    hidden = len(p["hf"])
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    columns = {k: list(zip(*p[k], strict=True)) for k in ("xf", "hf", "xb", "hb")}
    sigmoid = lambda v: 1 / (1 + math.exp(-v))

    def word(a, b):
        found = own.get(int(toxicity.word_hashes([data[a:b]])[0][0]), len(own))
        total = [0.0] * len(p["gram"][0])
        for i in range(a, b):
            code = (data[i - 1] * 0x9E3779B1 + data[i] * 0x85EBCA77 + data[i + 1] * 0xC2B2AE3D) % (1 << 32)
            total = [t + g for t, g in zip(total, p["gram"][(code ^ code >> 15) % trigrams], strict=True)]
        return p["word"][found] + [t / (b - a) for t in total]

    def states(xs, d):
        h, out = [0.0] * hidden, []
        for x in xs if d == "f" else reversed(xs):
            given = [dot(x, c) + bias for c, bias in zip(columns["x" + d], p["c" + d], strict=True)]
            past = [dot(h, c) for c in columns["h" + d]]
            z = [sigmoid(given[k] + past[k]) for k in range(hidden)]
            q = [sigmoid(given[k] + past[k]) for k in range(hidden, 2 * hidden)]
            n = [math.tanh(given[2 * hidden + k] + q[k] * past[2 * hidden + k]) for k in range(hidden)]
            h = [(1 - z[k]) * n[k] + z[k] * h[k] for k in range(hidden)]
            out.append(h)
        return out if d == "f" else out[::-1]

    inputs, best, at = [word(*s) for s in spans], -math.inf, 0
    while at == 0 or at + step < len(inputs):
        xs = inputs[at : at + window]
        if not xs:
            return sigmoid(p["b"][0])
        s = [f + b for f, b in zip(states(xs, "f"), states(xs, "b"), strict=True)]
        e = [math.exp(dot(v, p["u"])) for v in s]
        pooled = [sum(w * v[k] for w, v in zip(e, s, strict=True)) / sum(e) for k in range(len(s[0]))]
        best, at = max(best, dot(pooled, p["v"]) + p["b"][0]), at + step
    return sigmoid(best)


def mix(docs, weights=(5.0, 2.0, 1.0), share=1.5, most=2, block=8, shards=128):
    """[(id, source, size, taken)] for rows (id, text, source), from the definition: targets by resharing, whole blocks to
    sources and then to shards by highest quotients, each shard filled in hash order, and once more when all are taken."""
    rows = [(i, s, len(words(t)), hashlib.md5(f"0|{'null' if i is None else i}".encode()).hexdigest()) for i, t, s in docs]
    size = defaultdict(int)
    for _, s, n, _ in rows:
        size[s] += n
    names = sorted(s for s in size if s is not None) + [None] * (None in size)
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    target, left, free = {}, share * sum(size.values()), set(names)
    while True:
        part = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if part[s] > most * size[s]}
        if not over:
            target |= part
            break
        target |= {s: float(most * size[s]) for s in over}
        left, free = left - sum(target[s] for s in over), free - over

    def highest(parties, seats):
        heap = [(-w, p, 0, w) for p, w in parties.items() if w > 0]
        heapq.heapify(heap)
        quota = dict.fromkeys(parties, 0)
        for _ in range(seats if heap else 0):
            _, p, k, w = heap[0]
            quota[p] += 1
            heapq.heapreplace(heap, (-w / (2 * k + 3), p, k + 1, w))
        return quota

    blocks = highest({(s is not None, s or ""): target[s] for s in names}, math.floor(sum(target.values()) / block + 0.5))
    out = []
    for s in names:
        shard = defaultdict(list)
        for row in (r for r in rows if r[1] == s):
            shard[int(row[3][:8], 16) % shards].append(row)
        sizes = {k: sum(r[2] for r in own) for k, own in shard.items()}
        quota = highest(sizes, blocks[s is not None, s or ""])
        for k, own in shard.items():
            take, at = min(quota[k] * block, most * sizes[k]), 0
            for i, _, n, _ in sorted(own, key=lambda r: (r[3], order(r[0]), r[2])):
                whole = take // sizes[k] if sizes[k] else 0
                out.append((i, s, n, whole * n + max(0, min(n, take - whole * sizes[k] - at))))
                at += n
    return out


def runs(words, min_words=24, min_periods=3):
    """(start, length, smallest period) of all maximal runs, by trying every period."""
    found = []
    for q in range(1, len(words) // min_periods + 1):
        start = None
        for i in range(len(words) - q + 1):
            same = i + q < len(words) and words[i] == words[i + q]
            if same and start is None:
                start = i
            if not same and start is not None:
                if i - start + q >= max(min_words, min_periods * q):
                    found.append((start, i + q - start, q))
                start = None
    inside = lambda a, b: b[2] < a[2] and b[0] <= a[0] and b[0] + b[1] >= a[0] + a[1]
    return sorted((x for x in found if not any(inside(x, y) for y in found)), key=lambda x: (x[0], x[2]))


def periodic(doc_id, text, plant=True):
    w = [x.encode() for x in words(text)]
    n = len(w)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if plant and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = runs(w)
    gone = {i for s, m, q in found for i in range(s + q, s + m)}
    best = min(found, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]), default=(None, None, None))
    return (
        doc_id, n, len(found), *best, 1000 * best[1] // best[2] if found else None,
        sha("".join(f"{s},{m},{q}\n" for s, m, q in found)), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest(),
    )


def negatives(rows, most_positives=5, most_negatives=3):
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of rows (vec_id, embedding, label)."""
    big = float("inf")
    fine = [(i, None if lab is None else (lab + 1) % 10 if i is not None and i % 7 == 0 else lab, v) for i, v, lab in rows]
    fine = [(i, lab, [math.floor(256 * x) for x in v]) for i, lab, v in fine if lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    anchors = {(i, lab, tuple(v)) for i, lab, v in fine if i is not None and i % 50 == 0}
    out = []
    for i, lab, v in anchors:
        scored = sorted(((-sum(a * b for a, b in zip(v, w, strict=False)), big if j is None else j, kind) for j, kind, w in fine))
        for minus, j, kind in [x for x in scored if x[2] == lab and x[1] != i][:most_positives]:
            low = [x for x in scored if x[2] != lab and 50 * -minus <= 100 * -x[0] <= 95 * -minus]
            out += [(i, None if j == big else j, k + 1, None if x[1] == big else x[1], -minus, -x[0]) for k, x in enumerate(low[:most_negatives])]
    return out
