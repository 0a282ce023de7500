"""Periodic runs of words by a dictionary of basic factors.

A basic factor is a stretch of 2^k words. The dictionary names the factors of each length so that equal ones of a
document share a name; a factor of twice the length is the pair of its halves' names. Only positions whose factor
occurs again are carried on, as one that is alone stays alone when it grows, so in prose the dictionary is soon empty.

For each length m, positions whose next occurrence of the same factor is at a distance q with m/2 < q <= m propose the
period q: inside a window of twice the length such occurrences are an arithmetic progression. In a run of smallest period q and
at least 3 q words, every position from its start to its end less m + q words has its next occurrence at exactly q
(a nearer one would make the period's words equal to a rotation of themselves, hence the period not the smallest), so neighbouring
positions with equal q are one proposal. Proposals are extended to both sides, and equal runs of several proposals are kept once.

A document is never split: a task holds slices of some 4 MB of text, or one longer text, and its words. No shuffle.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlens.llm.common import slices

_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _successors(names: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(at, names, gap) of the positions whose name comes twice or more, by position: dense names, and the distance
    to the next position with the same name (0 for the last)."""
    order = np.argsort(names, kind="stable")
    ranked, place = names[order], at[order]
    new = np.append(True, ranked[1:] != ranked[:-1]) if len(ranked) else np.zeros(0, bool)
    last = np.append(new[1:], True) if len(ranked) else new
    gap = np.zeros(len(place), np.int64)
    gap[:-1] = np.where(last[:-1], 0, place[1:] - place[:-1])
    alive = ~(new & last)
    back = np.argsort(place[alive], kind="stable")
    return place[alive][back], (np.cumsum(new) - 1)[alive][back], gap[alive][back]


def _proposed(at: np.ndarray, gap: np.ndarray, m: int) -> np.ndarray:
    """Rows (start, end, period) of neighbouring positions with one distance q, m/2 < q <= m."""
    fits = (2 * gap > m) & (gap <= m)
    at, gap = at[fits], gap[fits]
    if not len(at):
        return np.zeros((0, 3), np.int64)
    new = np.append(True, (np.diff(at) != 1) | (np.diff(gap) != 0))
    first, last = np.flatnonzero(new), np.append(np.flatnonzero(new)[1:], len(at)) - 1
    return np.stack([at[first], at[last] + m + gap[first], gap[first]], axis=1)


def _extended(runs: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Runs (start, end, period) grown while the neighbouring words keep the period; keys differ between documents."""
    runs, n = runs.copy(), len(keys)
    for side, step in ((0, -1), (1, 1)):
        growing = np.arange(len(runs))
        while len(growing):
            start, end, q = runs[growing].T
            new, old = (start - 1, start - 1 + q) if side == 0 else (end, end - q)
            inside = (new >= 0) & (new < n)
            ok = inside & (keys[np.where(inside, new, 0)] == keys[np.where(inside, old, 0)])
            growing = growing[ok]
            runs[growing, side] += step
    return runs


def find_runs(keys: np.ndarray, min_words: int = 24, min_periods: int = 3) -> np.ndarray:
    """Rows (start, end, period), by start and period, of all maximal runs in an array of integers: at least min_words
    and min_periods (3 or more) times the smallest period long. Documents in one array must not share a key."""
    _, names = np.unique(keys, return_inverse=True)
    at, names, gap = _successors(names.astype(np.int64), np.arange(len(keys)))
    held, m, found = np.full(len(keys), -1, np.int64), 1, [np.zeros((0, 3), np.int64)]
    while len(at):
        found.append(_proposed(at, gap, m))
        held[at] = names
        other = at + m
        fits = other < len(keys)
        second = np.where(fits, held[np.where(fits, other, 0)], -1)
        held[at] = -1
        pair = second >= 0
        at, names, gap = _successors(names[pair] * (len(keys) + 1) + second[pair], at[pair])
        m *= 2
    runs = np.unique(_extended(np.concatenate(found), keys), axis=0)
    length = runs[:, 1] - runs[:, 0]
    runs = runs[length >= np.maximum(min_words, min_periods * runs[:, 2])]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def _strongest(runs: np.ndarray) -> np.ndarray:
    """The run with the greatest length / period, then smallest start and period: quotients of integers below 2^26
    that differ also differ as doubles."""
    start, end, q = runs.T
    return runs[np.lexsort((q, start, -((end - start) / q)))[0]]


def collapsed_runs(docs: DataFrame, *, min_words: int = 24, min_periods: int = 3, alter: Callable[[int | None, list[bytes]], list[bytes]] | None = None, texts: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_runs; of the strongest run start, length, period, exponent_milli (null
    without a run); runs_sha256 and collapsed_sha256; with texts also runs (an array) and collapsed_text.

    A run is a maximal stretch of at least min_words words with smallest period q and at least min_periods q words. Collapsing
    drops a run's words after its first q. alter(doc_id, words), if given, changes a document's words first.
    Null, empty and blank texts have no words and no run: the digests of the empty string. Null and repeated doc_ids, ties and repeated
    rows are like any others, as no row meets another. A very long text is held by one task with all its words.
    An empty table gives no rows; other columns don't matter.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    schema = "doc_id long, n_words long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
    schema += ", runs array<struct<start: long, length: long, period: long>>, collapsed_text string" * texts

    def one(words: list[bytes], low: int, runs: np.ndarray, drop: np.ndarray | None) -> dict:
        kept = b" ".join(words if drop is None else [w for w, gone in zip(words, drop.tolist(), strict=True) if not gone])
        listed = [(s - low, e - s, q) for s, e, q in runs.tolist()]
        row = {"n_words": len(words), "n_runs": len(listed), "start": None, "length": None, "period": None, "exponent_milli": None}
        if listed:
            start, end, q = _strongest(runs).tolist()
            row |= {"start": start - low, "length": end - start, "period": q, "exponent_milli": 1000 * (end - start) // q}
        row |= {"runs_sha256": hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in listed).encode()).hexdigest(), "collapsed_sha256": hashlib.sha256(kept).hexdigest()}
        return row | ({"runs": [{"start": s, "length": n, "period": q} for s, n, q in listed], "collapsed_text": kept.decode()} if texts else {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, ("text",), 4_000_000, 2000):
                ids = batch.column("doc_id").to_pylist()
                words = [t.split() for t in batch.column("text").to_pylist()]
                if alter is not None:
                    words = [alter(i, w) for i, w in zip(ids, words, strict=True)]
                counts = np.array([len(w) for w in words], np.int64)
                ends = np.cumsum(counts)
                named = pa.array([x for w in words for x in w], pa.binary()).dictionary_encode()
                keys = named.indices.to_numpy(zero_copy_only=False).astype(np.int64) + np.repeat(np.arange(len(words)), counts) * max(1, len(named.dictionary))
                runs = find_runs(keys, min_words, min_periods)
                change = np.zeros(len(keys) + 1, np.int64)
                np.add.at(change, runs[:, 0] + runs[:, 2], 1)
                np.add.at(change, runs[:, 1], -1)
                drop = np.cumsum(change)[:-1] > 0
                cut = np.searchsorted(runs[:, 0], [0, *ends])
                rows = []
                for k, (i, w, end) in enumerate(zip(ids, words, ends.tolist(), strict=True)):
                    low, mine = end - len(w), runs[cut[k] : cut[k + 1]]
                    rows.append({"doc_id": i} | one(w, low, mine, drop[low:end] if len(mine) else None))
                kinds = {n: pa.int64() for n in ("doc_id", "n_words", "n_runs", "start", "length", "period", "exponent_milli")} | {n: pa.string() for n in ("runs_sha256", "collapsed_sha256")} | ({"runs": _RUNS, "collapsed_text": pa.string()} if texts else {})
                yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], kind) for n, kind in kinds.items()], list(kinds))

    return own.mapInArrow(run, schema)


def with_period(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words of a tenth of the documents (by crc32 of the id) with a tail that repeats its first words; a null id has no crc32."""
    h, n = (zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * ((n - a) // p + 1))[: n - a]


#: Every pair of equal words of a document proposes its distance; islands of neighbours are runs. crc32 bit by bit from its polynomial.
ORACLE = r"""
WITH RECURSIVE crc_bits AS (
  SELECT i AS n, i AS c, 0 AS step FROM range(256) t(i)
  UNION ALL SELECT n, CASE WHEN c % 2 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, step + 1 FROM crc_bits WHERE step < 8),
crc_table AS (SELECT list(c ORDER BY n) AS t FROM crc_bits WHERE step = 8),
split AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
hashed AS (
  SELECT doc_id, w, len(w) AS n, xor(4294967295, list_reduce(list_transform(range(1, len(doc_id::VARCHAR) + 1), lambda i: ascii(substr(doc_id::VARCHAR, i, 1))::BIGINT),
    lambda c, x: xor(c >> 8, t[(xor(c & 255, x) + 1)::INT]), 4294967295)) AS h FROM split, crc_table),
tail AS (SELECT doc_id, w, n, h, (h // 10) % greatest(n, 1) AS a, 1 + (n - (h // 10) % greatest(n, 1)) // (3 + (h // 10) % 8) AS p FROM hashed),
changed AS (SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: w[(1 + CASE WHEN i >= a THEN a + (i - a) % p ELSE i END)::INT]) ELSE w END AS w FROM tail),
word AS (SELECT doc_id, n, unnest(w) AS x, unnest(range(n)) AS pos FROM changed),
pair AS (SELECT a.doc_id, a.pos, b.pos - a.pos AS q FROM word a JOIN word b ON a.doc_id = b.doc_id AND a.x = b.x AND b.pos > a.pos AND 3 * (b.pos - a.pos) <= a.n),
island AS (SELECT doc_id, q, min(pos) AS s, max(pos) + 1 + q AS e FROM (SELECT *, pos - row_number() OVER (PARTITION BY doc_id, q ORDER BY pos) AS g FROM pair) GROUP BY doc_id, q, g HAVING count(*) + q >= greatest(24, 3 * q)),
run AS (SELECT doc_id, s, e - s AS len, q FROM island x WHERE NOT EXISTS (SELECT 1 FROM island y WHERE y.doc_id = x.doc_id AND y.q < x.q AND y.s <= x.s AND y.e >= x.e)),
gone AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + len)) AS pos FROM run),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY pos) AS text FROM (SELECT w.doc_id, w.x, w.pos FROM word w ANTI JOIN gone g ON w.doc_id = g.doc_id AND w.pos = g.pos) GROUP BY doc_id),
per AS (SELECT doc_id, count(*) AS k, first(struct_pack(s, len, q) ORDER BY len / q DESC, s, q) AS b, string_agg(concat(s, ',', len, ',', q, chr(10)), '' ORDER BY s, q) AS listed FROM run GROUP BY doc_id)
SELECT c.doc_id, c.n::BIGINT AS n_words, coalesce(k, 0)::BIGINT AS n_runs, b.s::BIGINT AS start, b.len::BIGINT AS length, b.q::BIGINT AS period, (1000 * b.len // b.q)::BIGINT AS exponent_milli,
       sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
FROM changed c LEFT JOIN per ON per.doc_id = c.doc_id LEFT JOIN kept ON kept.doc_id = c.doc_id
"""
