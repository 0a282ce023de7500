"""Toxicity scores from a bidirectional gated recurrent network with attention pooling.

A word's input is a learned vector of the word (one for all that training rarely saw) and the mean of learned vectors of its
character trigrams (hashed). A forward and a backward GRU run over windows of 64 words, every window
overlapping the next by half; attention pools the states of a window to one score, and a
text's score is that of its highest window. All weights start at random. Training, in numpy on the driver, uses a bounded
sample of labelled rows (`sample_rows` of each class, texts of up to `sample_bytes`); scoring covers all words
of all texts, in Arrow batches without a shuffle, some 0.4 MB of text at a time: a longer text goes through
the network in stretches that have the same windows. The only input is the text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlens.llm.common import slices
from loomlens.llm.rolling import word_hashes

WINDOW, STEP = 64, 32
#: Bytes of text that are scored at once, and windows of a stretch of a longer text.
AT_ONCE, STRETCH = 400_000, 1000
TRIGRAMS, DW, DC, H = 1 << 14, 8, 4, 8
D = DW + DC
_PLAIN = bytes(32 if chr(b) in "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~'" else b for b in range(256))


def plain(text: bytes) -> bytes:
    """ASCII letters in lower case, ASCII punctuation as space."""
    return text.lower().translate(_PLAIN)


@dataclass
class Texts:
    """Words of a batch of texts: word hashes, trigram inputs, and the windows over them."""

    texts: list[bytes]
    hashes: np.ndarray = field(init=False)
    counts: np.ndarray = field(init=False)
    grams: np.ndarray = field(init=False)
    gram_ends: np.ndarray = field(init=False)

    def __post_init__(self):
        clean = [plain(t) for t in self.texts]
        hashes, self.counts = word_hashes(clean)
        self.hashes = hashes
        data = np.frombuffer(b"\n".join([b"", *clean, b""]), np.uint8).astype(np.uint32)
        inner = data[1:-1] if len(data) > 1 else data
        code = data[:-2] * np.uint32(0x9E3779B1) + inner * np.uint32(0x85EBCA77) + data[2:] * np.uint32(0xC2B2AE3D) if len(data) > 2 else np.zeros(0, np.uint32)
        code = ((code ^ (code >> np.uint32(15))) % np.uint32(TRIGRAMS)).astype(np.int64)
        letter = ~np.isin(inner, (32, 9, 10, 11, 12, 13)) if len(data) > 2 else np.zeros(0, bool)
        self.grams = code[letter]  # one for each byte of each word, in order
        edge = np.flatnonzero(np.diff(letter, prepend=False, append=False))
        self.gram_ends = np.cumsum(edge[1::2] - edge[::2])

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, first word, number of words) of every window."""
        begin = np.cumsum(self.counts) - self.counts
        n = np.where(self.counts > 0, np.maximum(1, -(-(self.counts - STEP) // STEP)), 0)
        text = np.repeat(np.arange(len(n)), n)
        at = (np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)) * STEP
        return text, begin[text] + at, np.minimum(WINDOW, self.counts[text] - at)


def stretches(text: bytes, windows: int = STRETCH) -> Iterator[bytes]:
    """Parts of a plain text, each with the next `windows` of its windows, the white space on their sides included."""
    data = np.frombuffer(text, np.uint8)
    gap = np.isin(data, (32, 9, 10, 11, 12, 13))
    starts = np.flatnonzero(~gap & np.append(True, gap[:-1]))
    for at in range(0, max(1, len(starts) - STEP), windows * STEP):
        low = max(0, int(starts[at]) - 1) if at else 0
        after = at + windows * STEP + STEP
        yield text[low : int(starts[after])] if after < len(starts) else text[low:]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return np.reciprocal(1 + np.exp(-x))


class Network:
    def __init__(self, vocabulary: np.ndarray, seed: int = 0):
        """vocabulary: sorted hashes of the words with vectors of their own."""
        r = np.random.default_rng(seed)
        f = lambda *s, scale=0.1: (r.standard_normal(s) * scale).astype(np.float32)
        self.vocabulary = vocabulary
        self.p = {"word": f(len(vocabulary) + 1, DW, scale=0.3), "gram": f(TRIGRAMS, DC), "v": f(2 * H, scale=0.3), "u": f(2 * H, scale=0.3), "b": np.zeros(1, np.float32)}
        for d in "fb":
            self.p |= {f"x{d}": f(D, 3 * H, scale=0.3), f"h{d}": f(H, 3 * H, scale=0.3), f"c{d}": np.zeros(3 * H, np.float32)}

    def known(self, hashes: np.ndarray) -> np.ndarray:
        """The row of each word's vector; the last for words outside the vocabulary."""
        v = self.vocabulary
        if not len(v):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(v, hashes), len(v) - 1)
        return np.where(v[at] == hashes, at, len(v))

    def inputs(self, t: Texts) -> np.ndarray:
        """The input vector of each word."""
        x = np.empty((len(t.hashes), D), np.float32)
        x[:, :DW] = self.p["word"][self.known(t.hashes)]
        if len(t.hashes):
            lengths = np.diff(t.gram_ends, prepend=0)
            x[:, DW:] = np.add.reduceat(self.p["gram"][t.grams], t.gram_ends - lengths) / lengths[:, None]
        return x

    def given(self, x: np.ndarray) -> dict[str, np.ndarray]:
        """What the inputs add to the gates, for both directions."""
        return {d: x @ self.p[f"x{d}"] + self.p[f"c{d}"] for d in "fb"}

    def _run(self, given: np.ndarray, first: np.ndarray, size: np.ndarray, d: str, keep: list | None) -> np.ndarray:
        """States (window, step, H) of one direction; size must not increase. keep gets the gates."""
        weights, h = self.p[f"h{d}"], np.zeros((len(first), H), np.float32)
        out = np.zeros((len(first), int(size[0]) if len(size) else 0, H), np.float32)
        active = np.searchsorted(-size, -np.arange(out.shape[1]), side="left")
        for t in range(out.shape[1]):
            k = active[t]
            at = first[:k] + (t if d == "f" else size[:k] - 1 - t)
            g, before = given[at], h[:k]
            m = before @ weights
            zr = _sigmoid(g[:, : 2 * H] + m[:, : 2 * H])
            z, q = zr[:, :H], zr[:, H:]
            n = np.tanh(g[:, 2 * H :] + q * m[:, 2 * H :])
            after = n + z * (before - n)
            if keep is not None:
                keep.append((at, before.copy(), z, q, n, m[:, 2 * H :]))
            h[:k] = after
            out[np.arange(k), t if d == "f" else size[:k] - 1 - t] = after
        return out

    def logits(self, given: dict[str, np.ndarray], first: np.ndarray, size: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """One score (before the sigmoid) for each window; size must not increase."""
        gates = {d: [] if keep is not None else None for d in "fb"}
        steps = int(size[0]) if len(size) else 0
        inside = np.arange(steps) < size[:, None]
        s = np.concatenate([self._run(given[d], first, size, d, gates[d]) for d in "fb"], axis=2)
        e = np.where(inside, s @ self.p["u"], -np.inf)
        a = np.exp(e - e.max(axis=1, keepdims=True)) if steps else e
        a /= a.sum(axis=1, keepdims=True)
        pooled = np.einsum("bt,btd->bd", a, s)
        if keep is not None:
            keep |= {"gates": gates, "s": s, "a": a, "pooled": pooled, "inside": inside}
        return pooled @ self.p["v"] + self.p["b"]

    def gradients(self, t: Texts, first: np.ndarray, size: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy of the windows against y and its gradient; size must not increase, and no
        two windows may share a word."""
        x, k = self.inputs(t), {}
        p = _sigmoid(self.logits(self.given(x), first, size, k))
        loss = float(-np.mean(np.where(y > 0, np.log(p + 1e-9), np.log(1 - p + 1e-9))))
        g = {n: np.zeros_like(v) for n, v in self.p.items()}
        dl = ((p - y) / len(y)).astype(np.float32)
        g["b"][0], g["v"][:] = dl.sum(), dl @ k["pooled"]
        dp = dl[:, None] * self.p["v"]
        da = np.einsum("btd,bd->bt", k["s"], dp)
        de = k["a"] * (da - (k["a"] * da).sum(axis=1, keepdims=True))
        g["u"][:] = np.einsum("bt,btd->d", de, k["s"])
        ds = k["a"][:, :, None] * dp[:, None, :] + de[:, :, None] * self.p["u"]
        dx = np.zeros_like(x)
        steps = k["inside"].shape[1]
        for d, low in (("f", 0), ("b", H)):
            dh, w = np.zeros((len(first), H), np.float32), self.p[f"h{d}"]
            dgiven = np.zeros((len(x), 3 * H), np.float32)
            for step in range(steps - 1, -1, -1):
                at, before, z, q, n, mn = k["gates"][d][step]
                m = len(at)
                back = dh[:m] + ds[np.arange(m), at - first[:m], low : low + H]
                dn = back * (1 - z) * (1 - n * n)
                dz = back * (before - n) * z * (1 - z)
                dq = dn * mn * q * (1 - q)
                dm = np.concatenate([dz, dq, dn * q], axis=1)
                dgiven[at] = np.concatenate([dz, dq, dn], axis=1)
                g[f"h{d}"] += before.T @ dm
                dh[:m] = back * z + dm @ w.T
            g[f"x{d}"] += x.T @ dgiven
            g[f"c{d}"] += dgiven.sum(axis=0)
            dx += dgiven @ self.p[f"x{d}"].T
        lengths = np.diff(t.gram_ends, prepend=0)
        known, owner = self.known(t.hashes), np.repeat(np.arange(len(x)), lengths)
        for c in range(DW):
            g["word"][:, c] = np.bincount(known, dx[:, c], len(g["word"]))
        for c in range(DC):
            g["gram"][:, c] = np.bincount(t.grams, (dx[:, DW + c] / lengths)[owner], TRIGRAMS)
        return loss, g

    def window_scores(self, t: Texts, batch: int = 1024) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text, first, size, score before the sigmoid) of every window of t."""
        text, first, size = t.windows()
        x, out = self.inputs(t), np.zeros(len(text), np.float32)
        given = self.given(x)
        order = np.argsort(-size, kind="stable")
        for i in range(0, len(order), batch):
            o = order[i : i + batch]
            out[o] = self.logits(given, first[o], size[o])
        return text, first, size, out

    def _raise(self, best: np.ndarray, own: list[int], parts: list[bytes]) -> None:
        """Raise each text's best score to that of the highest window of its parts."""
        text, _, _, out = self.window_scores(Texts(parts))
        np.maximum.at(best, np.array(own, np.int64)[text], out)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """0 to 1 for each text: its highest window; a text without words scores the bias alone."""
        best, own, parts, held = np.full(len(texts), -np.inf), [], [], 0
        for i, text in enumerate(texts):
            for part in [text] if len(text) <= AT_ONCE else stretches(plain(text)):
                if held and held + len(part) > AT_ONCE:
                    self._raise(best, own, parts)
                    own, parts, held = [], [], 0
                own.append(i)
                parts.append(part)
                held += len(part)
        self._raise(best, own, parts)
        return _sigmoid(np.where(np.isfinite(best), best, float(self.p["b"][0])))


def train(texts: list[bytes], labels: np.ndarray, *, min_texts: int = 3, epochs: int = 6, steps: int = 400, averaged: int = 2, batch: int = 32, rate: float = 0.01, unknown: float = 0.15, seed: int = 0) -> Network:
    """Fit to texts with labels 0 and 1. The first epoch takes the window of each text whose words have the greatest sum of
    log odds (smoothed, less two standard errors), as random weights can't choose; the second and then every other one takes
    every text's highest window (that of the score), which the next keeps. A share `unknown` of the words is taken as outside the vocabulary, so that trigrams learn too.
    Small samples take more epochs, until there are `steps` steps. The result is the mean of the weights over the steps of the
    last `averaged` epochs."""
    random = np.random.default_rng(seed)
    if not len(texts) or labels.min() == labels.max():
        net = Network(np.zeros(0, np.uint64), seed)
        net.p["v"][:] = 0
        net.p["b"][0] = 5.0 if len(texts) and labels.max() == 1 else -5.0
        return net
    whole = Texts(texts)
    words, at = np.unique(whole.hashes, return_inverse=True)
    pairs = np.unique(np.repeat(np.arange(len(texts)), whole.counts) * len(words) + at)
    del whole, at
    seen = [np.bincount(pairs[labels[pairs // len(words)] == c] % len(words), minlength=len(words)) for c in (0, 1)]
    often = np.flatnonzero(seen[0] + seen[1] >= min_texts)
    net = Network(words[often], seed)
    seen = [np.append(c[often], 0) for c in seen]
    odds = np.log((seen[1] + 0.5) / (labels.sum() + 1)) - np.log((seen[0] + 0.5) / ((1 - labels).sum() + 1))
    doubt = 2 * np.sqrt(1 / (seen[0] + 0.5) + 1 / (seen[1] + 0.5))
    lean = np.sign(odds) * np.clip(np.abs(odds) - doubt, 0, 8) * (seen[0] + seen[1] > 0)
    net.p["b"][0] = -1.0
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    s = {k: np.zeros_like(v) for k, v in net.p.items()}
    mean = {k: np.zeros(v.shape) for k, v in net.p.items()}
    step, n_mean = 0, 0
    epochs = max(epochs, -(-steps // -(-len(texts) // batch)))
    parts = [range(i, min(i + 200, len(texts))) for i in range(0, len(texts), 200)]
    for epoch in range(epochs):
        if epoch == 0 or epoch % 2:
            best = []  # (text, first word in it, words) of each text's highest window
            for part in parts:
                t = Texts([texts[i] for i in part])
                if epoch:
                    text, first, size, out = net.window_scores(t)
                else:
                    text, first, size = t.windows()
                    total = np.append(0, np.cumsum(lean[net.known(t.hashes)]))
                    out = total[first + size] - total[first]
                begin = np.cumsum(t.counts) - t.counts
                order = np.lexsort((-out, text))
                for j in order[np.unique(text[order], return_index=True)[1]]:
                    best.append((part[text[j]], int(first[j] - begin[text[j]]), int(size[j])))
        random.shuffle(best)
        for i in range(0, len(best), batch):
            pick = sorted(best[i : i + batch], key=lambda w: -w[2])
            own = Texts([b" ".join(plain(texts[d]).split()[at : at + n]) for d, at, n in pick])
            own.hashes = np.where(random.random(len(own.hashes)) < unknown, np.uint64(0), own.hashes)
            _, g = net.gradients(own, np.cumsum(own.counts) - own.counts, own.counts, labels[[w[0] for w in pick]].astype(np.float32))
            step += 1
            for k in net.p:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                s[k] = 0.99 * s[k] + 0.01 * g[k] * g[k]
                net.p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.99**step)) + 1e-6)
            if epoch >= epochs - averaged:
                n_mean += 1
                for k in net.p:
                    mean[k] += net.p[k]
    if n_mean:  # 0 if no text has a word
        net.p = {k: (v / n_mean).astype(np.float32) for k, v in mean.items()}
    return net


def fold(doc_id) -> int | None:
    """crc32 of the id as text modulo 5; 0 is held out."""
    return None if doc_id is None else zlib.crc32(str(doc_id).encode()) % 5


def fit(docs: DataFrame, labels: DataFrame, *, sample_rows: int = 1500, sample_bytes: int = 50_000, seed: int = 0) -> Network:
    """Train on labelled rows outside fold 0: at most `sample_rows` of each class, by hash of the id.

    Rows without id or label are left out; of several labels of an id the largest counts, of several texts the
    first in order, so no more than 2 x sample_rows rows reach the driver. Null and longer texts are left out.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % 5 != 0)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    some = [known.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(sample_rows) for c in (0, 1)]
    chosen = F.broadcast(some[0].unionByName(some[1]))  # 2 x sample_rows rows
    rows = docs.where(F.octet_length("text") <= sample_bytes).select("doc_id", "text").join(chosen, "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).collect()
    rows.sort(key=lambda r: r.doc_id)
    return train([r.text.encode() for r in rows], np.array([r.toxic for r in rows], np.int64), seed=seed)


def score_documents(docs: DataFrame, net: Network) -> DataFrame:
    """doc_id, held_out, score and predicted of each row of docs.

    Null and empty texts, and texts without words, score the network's bias. A null doc_id counts as
    held out. Repeated rows score alike; an empty table gives no rows; other columns don't matter. All windows
    of a very long text count, in memory that doesn't grow with their number but for 10 bytes a word.
    """
    spread = docs.sparkSession.sparkContext.broadcast(net)  # its size is bounded by the sample's
    fold_of = F.crc32(F.col("doc_id").cast("string")) % 5
    own = docs.select("doc_id", F.coalesce(fold_of == 0, F.lit(True)).alias("held_out"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network = spread.value
        for whole in batches:
            for batch in slices(whole, ("_text",), AT_ONCE, 300):
                scores = network.scores(batch.column("_text").to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(scores, pa.float64()), pa.array(scores >= 0.5).cast(pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    return own.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int")
