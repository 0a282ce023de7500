"""Substring dedup with fixed-block anchors.

Reference side: every document's non-overlapping blocks of 7 words, at 0, 7, 14 ... Any window of 13
words contains one of its document's blocks whole. Probe side: every rolling window of 7 words of
every document. Where a probe meets a block of another document, the windows of 13 words around the
anchor on both sides are compared, which extends the hit to the maximal exact repeat (a repeat is the
union of its windows). Words in a window that also starts in a document with a smaller id go.

Documents are dealt to buckets of some megabytes by a hash, and buckets exchange sorted,
distinct window hashes with hash ranges ("parts"). A passage that a third of all documents share
is one hash per bucket, so it fills neither a task nor a message. The text is shuffled once (the three
passes over the buckets use the same exchange); each anchor costs 4 bytes, each window near a hit 16.
There is a message for each bucket and part, half the square of the buckets: so buckets grow with the square root of
the text beyond 2 GB, up to 64 MB, and the messages with the text itself (50 GB: 2,500 buckets of 20 MB, 3 million
messages). Beyond 500 GB they grow with its square again; executors with more memory can take larger buckets.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlens.llm.rolling import inside, window_hashes, word_hashes

_NO_ID = np.iinfo(np.int64).max


def _binary(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a).tobytes()


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, end) of each run of equal values of a sorted array."""
    first = np.flatnonzero(np.diff(keys, prepend=keys[:1] + np.uint64(1))) if len(keys) else np.zeros(0, np.int64)
    return first, np.append(first[1:], len(keys)).astype(np.int64)


def _messages(kind: dict[str, np.ndarray], keys: np.ndarray, parts: int, bucket: int) -> pa.Table:
    """One row per part that has keys: the sorted keys' columns as bytes."""
    part = (keys % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    edges = np.searchsorted(part[order], np.arange(parts + 1))
    full = [p for p in range(parts) if edges[p] < edges[p + 1]]
    columns = {"part": pa.array(full, pa.int32()), "bucket": pa.array([bucket] * len(full), pa.int32())}
    for name, values in kind.items():
        dealt = values[order]
        columns[name] = pa.array([_binary(dealt[edges[p] : edges[p + 1]]) for p in full], pa.binary())
    return pa.table(columns)


class _Bucket:
    """The documents of one bucket: ids (null as the largest), texts, word hashes."""

    def __init__(self, table: pa.Table):
        self.ids = np.array([_NO_ID if x is None else x for x in table.column("doc_id").to_pylist()], np.int64)
        self.rows = table.column("doc_id")
        self.texts = [t or b"" for t in table.column("_text").to_pylist()]
        self.number = table.column("_bucket")[0].as_py() if table.num_rows else None
        self.words, self.counts = word_hashes(self.texts)
        self.doc = np.repeat(np.arange(len(self.texts)), self.counts)

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        hashes = window_hashes(self.words, size)
        return hashes, inside(self.counts, size, len(hashes))

    def offsets(self) -> np.ndarray:
        """The position of each word in its document."""
        return np.arange(len(self.words)) - np.repeat(np.cumsum(self.counts) - self.counts, self.counts)


def _anchor_messages(block: int, parts: int):
    """Each distinct rolling window of the bucket, with a bit for 'is a reference block here' and
    one for 'in several documents here', in 32 bits (30 of the hash besides the part)."""

    def send(table: pa.Table) -> pa.Table:
        b = _Bucket(table)
        hashes, ok = b.windows(block)
        aligned = (b.offsets()[: len(hashes)] % block == 0)[ok]
        keys, doc = _anchor_keys(hashes[ok], parts), b.doc[: len(hashes)][ok]
        order = np.argsort(keys, kind="stable")
        keys, doc, aligned = keys[order], doc[order], aligned[order]
        first, end = _runs(keys)
        flags = np.zeros(len(first), np.uint32)
        if len(first):
            flags = np.logical_or.reduceat(aligned, first).astype(np.uint32) | ((b.ids[doc[first]] != b.ids[doc[end - 1]]) | (doc[first] != doc[end - 1])).astype(np.uint32) << np.uint32(1)
        short = (keys[first] // np.uint64(parts)).astype(np.uint32) << np.uint32(2) | flags
        return _messages({"keys": short}, keys[first], parts, b.number)

    return send


def _anchor_keys(hashes: np.ndarray, parts: int) -> np.ndarray:
    """The part and 30 bits more of each hash; keys % parts is the part."""
    return (hashes >> np.uint64(34)) * np.uint64(parts) + (hashes & np.uint64(0xFFFFFFFF)) % np.uint64(parts)


def _anchor_hits(table: pa.Table) -> pa.Table:
    """For one part: tell each bucket which of its windows are anchors: a block in some document and
    present in a document besides."""
    sent = [np.frombuffer(k, np.uint32) for k in table.column("keys").to_pylist()]
    buckets = table.column("bucket").to_pylist()
    keys = np.concatenate(sent)
    order = np.argsort(keys >> np.uint32(2), kind="stable")
    flags, values = keys[order] & np.uint32(3), (keys[order] >> np.uint32(2)).astype(np.uint64)
    first, end = _runs(values)
    is_block = np.logical_or.reduceat(flags & 1 == 1, first)
    shared = np.logical_or.reduceat(flags & 2 == 2, first) | (end - first > 1)
    hot = np.empty(len(keys), bool)
    hot[order] = np.repeat(is_block & shared, end - first)
    edges = np.cumsum([0, *map(len, sent)])
    found = [(b, _binary(keys[x:y][hot[x:y]] >> np.uint32(2))) for b, x, y in zip(buckets, edges, edges[1:], strict=False) if hot[x:y].any()]
    part = table.column("part")[0].as_py()
    return pa.table({"_bucket": pa.array([b for b, _ in found], pa.int32()), "part": pa.array([part] * len(found), pa.int32()), "keys": pa.array([k for _, k in found], pa.binary())})


def _window_messages(block: int, window: int, parts: int):
    """The windows around the bucket's anchors: each distinct hash with its smallest document here."""

    def send(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"part": pa.array([], pa.int32()), "bucket": pa.array([], pa.int32()), "keys": pa.array([], pa.binary()), "ids": pa.array([], pa.binary())})
        b = _Bucket(left)
        hot = np.concatenate([np.frombuffer(k, np.uint32).astype(np.uint64) * np.uint64(parts) + np.uint64(p) for k, p in zip(right.column("keys").to_pylist(), right.column("part").to_pylist(), strict=True)])
        hot.sort()
        hashes, ok = b.windows(block)
        keys = _anchor_keys(hashes, parts)
        at = np.minimum(np.searchsorted(hot, keys), len(hot) - 1)
        met = np.concatenate([[0], np.cumsum((hot[at] == keys) & ok)])
        wide, fits = b.windows(window)
        near = fits & (met[window - block + 1 :][: len(wide)] > met[: len(wide)])
        keys, ids = wide[near], b.ids[b.doc[: len(wide)][near]]
        order = np.lexsort((ids, keys))
        first, _ = _runs(keys[order])
        return _messages({"keys": keys[order][first], "ids": ids[order][first]}, keys[order][first], parts, b.number)

    return send


def _window_owners(table: pa.Table) -> pa.Table:
    """For one part: tell each bucket of which of its windows a smaller document elsewhere has."""
    sent = [np.frombuffer(k, np.uint64) for k in table.column("keys").to_pylist()]
    keys, ids = np.concatenate(sent), np.concatenate([np.frombuffer(k, np.int64) for k in table.column("ids").to_pylist()])
    order = np.lexsort((ids, keys))
    first, end = _runs(keys[order])
    least = np.empty(len(keys), np.int64)
    least[order] = np.repeat(ids[order][first], end - first)
    smaller = least < ids
    edges = np.cumsum([0, *map(len, sent)])
    rows = [(b, keys[x:y][smaller[x:y]], least[x:y][smaller[x:y]]) for b, x, y in zip(table.column("bucket").to_pylist(), edges, edges[1:], strict=False) if smaller[x:y].any()]
    return pa.table({"_bucket": pa.array([r[0] for r in rows], pa.int32()), "keys": pa.array([_binary(r[1]) for r in rows], pa.binary()), "ids": pa.array([_binary(r[2]) for r in rows], pa.binary())})


def _remove(window: int, texts: bool):
    def settle(left: pa.Table, right: pa.Table) -> pa.Table:
        b = _Bucket(left)
        wide, fits = b.windows(window)
        at = np.flatnonzero(fits)
        keys, ids = wide[at], b.ids[b.doc[at]]
        order = np.argsort(keys, kind="stable")
        first, end = _runs(keys[order])
        least = np.empty(len(keys), np.int64)
        if len(keys):
            least[order] = np.repeat(np.minimum.reduceat(ids[order], first), end - first)
        if right.num_rows:
            told = np.concatenate([np.frombuffer(k, np.uint64) for k in right.column("keys").to_pylist()])
            owner = np.concatenate([np.frombuffer(k, np.int64) for k in right.column("ids").to_pylist()])
            by = np.argsort(told)
            told, owner = told[by], owner[by]
            spot = np.minimum(np.searchsorted(told, keys), len(told) - 1)
            least = np.where(told[spot] == keys, np.minimum(least, owner[spot]), least)
        change = np.zeros(len(b.words) + window + 1, np.int64)
        gone = at[least < ids]
        np.add.at(change, gone, 1)
        np.add.at(change, gone + window, -1)
        keep = np.cumsum(change)[: len(b.words)] == 0
        gone_before, ends = np.concatenate([[0], np.cumsum(~keep)]), np.cumsum(b.counts)
        removed = gone_before[ends] - gone_before[ends - b.counts]
        kept, start = [], 0
        for text, n, k in zip(b.texts, b.counts.tolist(), removed.tolist(), strict=True):
            words = text.split()
            kept.append(b" ".join(compress(words, keep[start : start + n].tolist()) if k else words))
            start += n
        columns = {"doc_id": b.rows, "n_words": pa.array(b.counts, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())}
        if texts:
            columns["kept_text"] = pa.array([k.decode() for k in kept], pa.string())
        return pa.table(columns)

    return settle


def bucketed(docs: DataFrame, buckets: int) -> DataFrame:
    """doc_id, _text and _bucket of each row. The hash takes the text too, so that rows with a null or one repeated id spread, and the
    partition, so that copies of such a row do."""
    bucket = F.pmod(F.xxhash64("doc_id", "text", F.spark_partition_id()), F.lit(buckets)).cast("int")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("_text"), bucket.alias("_bucket"))


def without_repeated_passages(docs: DataFrame, *, window: int = 13, bucket_bytes: int | None = None, texts: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_removed, kept_sha256 (and kept_text with texts).

    Windows are judged on the input. A null or empty text has no words. A null doc_id is larger than
    any other. Rows with the same doc_id don't remove each other's words, whether equal or not. Texts
    of fewer than `window` words stay. An empty table gives no rows; other columns don't matter. A very long text
    is one row of one bucket, which its task holds whole.
    """
    block = (window + 1) // 2
    total = docs.select(F.sum(F.octet_length("text"))).first()[0] or 0
    bucket_bytes = bucket_bytes or int(min(64_000_000, 4_000_000 * max(1.0, total / 2e9) ** 0.5))
    buckets = int(max(1, -(-total // bucket_bytes)))
    parts = max(1, buckets // 2)
    dealt = bucketed(docs, buckets)
    anchors = dealt.groupBy("_bucket").applyInArrow(_anchor_messages(block, parts), "part int, bucket int, keys binary")
    hits = anchors.groupBy("part").applyInArrow(_anchor_hits, "_bucket int, part int, keys binary")
    windows = dealt.groupBy("_bucket").cogroup(hits.groupBy("_bucket")).applyInArrow(_window_messages(block, window, parts), "part int, bucket int, keys binary, ids binary")
    owners = windows.groupBy("part").applyInArrow(_window_owners, "_bucket int, keys binary, ids binary")
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * texts
    return dealt.groupBy("_bucket").cogroup(owners.groupBy("_bucket")).applyInArrow(_remove(window, texts), schema)


ORACLE = r"""
WITH split AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (
  SELECT doc_id, unnest(range(1, greatest(len(w) - 11, 1))) AS pos,
         unnest(list_transform(range(1, greatest(len(w) - 11, 1)), lambda i: array_to_string(w[i : i + 12], ' '))) AS seq FROM split),
first AS (SELECT seq, min(doc_id) AS owner FROM windows GROUP BY seq),
repeated AS (SELECT w.doc_id, w.pos FROM windows w JOIN first f USING (seq) WHERE f.owner < w.doc_id),
gone AS (SELECT DISTINCT doc_id, pos + k AS pos FROM repeated, range(13) t(k)),
word AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS pos FROM split),
kept AS (
  SELECT doc_id, count(*) FILTER (g.pos IS NOT NULL) AS n_removed,
         string_agg(x, ' ' ORDER BY word.pos) FILTER (g.pos IS NULL) AS text
  FROM word LEFT JOIN gone g USING (doc_id, pos) GROUP BY doc_id)
SELECT s.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM split s LEFT JOIN kept USING (doc_id)
"""
