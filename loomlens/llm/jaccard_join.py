"""Exact n-gram Jaccard join in the metric space of the Jaccard distance.

A distance is 1 to every document with which nothing is shared, so pivots drawn from a whole corpus split nothing: nearly all
documents would stand at distance 1 from nearly all of them. The join therefore starts from regions that hold all links between
them by the prefix rule: of two sets at the similarity, the first n - ceil(percent n / 100) + 1 tokens share one, in any order that
all documents follow. Here tokens of one document come first, then rare ones: so a document whose own tokens fill that prefix is linked with
nothing, whatever common passages it holds, and the others are joined to regions by the tokens of their prefixes. Only the order depends on the
counts: they are of all documents and decide what is compared, never what is linked.

A region of more than `leaf` sets is split by pivots. Every set goes to the Voronoi region of its nearest pivot (to a far region
if none is nearer than 1 - r), and also to each region with a smaller number whose pivot is at most 2 r farther than its own: by the
triangle inequality, of two sets at distance r or less that have different homes one stands in such a window of the other's home. Sets at r or
less from a pivot are linked with it at once. Regions are joined recursively: those whose sets are one component by now are done, the others are split again or
compared exactly on whole sets. Where windows would hold most of a region (equidistant families), it is
compared block by block instead; only sets outside its largest component ask. No pair at the similarity is lost.

Work: each text is shuffled once; buckets tell hash ranges their distinct tokens (32 bits besides the range) and get back those that come
twice or more. There are never more messages than tokens. Only sets that may have a partner travel again, with their whole sets. What a task
holds is a bucket, a range, or a group of at most twice `leaf` sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomlens.llm import near_dedup as near
from loomlens.llm.common import written

LEAF, PIVOTS, LEVELS = 1024, 16, 6
_TABLE = "path long, node long, size long, a long, b long"


def _tokens(hashes: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """(part, 32 bits more) of each hash."""
    return (hashes & np.uint64(0xFFFFFFFF)) % np.uint64(parts), (hashes >> np.uint64(32)).astype(np.uint32)


def _distinct(texts: list[bytes]) -> tuple[list[np.ndarray], list[bytes], list[int]]:
    """(sets, keys, rows that are the first with their set) of a bucket; texts without words have an empty key."""
    sets, seen = near.shingle_sets(texts), {}
    keys = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else b"" for s in sets]
    for i, k in enumerate(keys):
        if k:
            seen.setdefault(k, i)
    return sets, keys, list(seen.values())


def _told(parts: int):
    """For each part the bucket's distinct tokens, sorted, with the number of its sets that hold them (255 at most)."""

    def send(table: pa.Table) -> pa.Table:
        sets, _, first = _distinct([t or b"" for t in table.column("_text").to_pylist()])
        flat = np.concatenate([sets[i] for i in first] or [np.zeros(0, np.uint64)])
        part, short = _tokens(flat, parts)
        keys, counts = np.unique(part << np.uint64(32) | short, return_counts=True)
        edges = np.searchsorted(keys, np.arange(parts + 1, dtype=np.uint64) << np.uint64(32))
        full = [p for p in range(parts) if edges[p] < edges[p + 1]]
        piece = lambda values, p: np.ascontiguousarray(values[edges[p] : edges[p + 1]]).tobytes()
        short, counts = keys.astype(np.uint32), np.minimum(counts, 255).astype(np.uint8)
        bucket = table.column("_bucket")[0].as_py()
        return pa.table({"part": pa.array(full, pa.int32()), "bucket": pa.array([bucket] * len(full), pa.int32()), "keys": pa.array([piece(short, p) for p in full], pa.binary()), "counts": pa.array([piece(counts, p) for p in full], pa.binary())})

    return send


def _shared(table: pa.Table) -> pa.Table:
    """For one part: tell each bucket which of its tokens are in two sets or more, and how common they are (logarithmic, in a byte)."""
    sent = [np.frombuffer(k, np.uint32) for k in table.column("keys").to_pylist()]
    keys, counts = np.concatenate(sent), np.concatenate([np.frombuffer(k, np.uint8) for k in table.column("counts").to_pylist()])
    order = np.argsort(keys, kind="stable")
    first = np.flatnonzero(np.append(True, np.diff(keys[order]) != 0))
    total = np.empty(len(keys), np.int64)
    total[order] = np.repeat(np.add.reduceat(counts[order].astype(np.int64), first), np.diff(first, append=len(keys)))
    common = np.minimum(255, 8 * np.log2(total)).astype(np.uint8)
    edges, out = np.cumsum([0, *map(len, sent)]), []
    for b, x, y in zip(table.column("bucket").to_pylist(), edges, edges[1:], strict=False):
        hit = total[x:y] > 1
        if hit.any():
            out.append((b, keys[x:y][hit].tobytes(), common[x:y][hit].tobytes()))
    part = table.column("part")[0].as_py()
    return pa.table({"_bucket": pa.array([o[0] for o in out], pa.int32()), "part": pa.array([part] * len(out), pa.int32()), "keys": pa.array([o[1] for o in out], pa.binary()), "common": pa.array([o[2] for o in out], pa.binary())})


def _kept(parts: int, percent: int):
    """Every document with the size and key of its set; the first with a set that may have a partner also with its prefix and shingles."""

    def keep(left: pa.Table, right: pa.Table) -> pa.Table:
        sets, keys, first = _distinct([t or b"" for t in left.column("_text").to_pylist()])
        prefixes, shingles = [None] * len(sets), [None] * len(sets)
        if right.num_rows:
            known = np.concatenate([np.frombuffer(k, np.uint32).astype(np.uint64) | np.uint64(p << 32) for k, p in zip(right.column("keys").to_pylist(), right.column("part").to_pylist(), strict=True)])
            common = np.concatenate([np.frombuffer(k, np.uint8) for k in right.column("common").to_pylist()])
            order = np.argsort(known)
            known, common = known[order], common[order]
            for i in first:
                part, short = _tokens(sets[i], parts)
                own = part << np.uint64(32) | short
                at = np.minimum(np.searchsorted(known, own), len(known) - 1)
                hit = known[at] == own
                n, others = len(own), int(hit.sum())
                need = n - (percent * n + 99) // 100 + 1 - (n - others)
                if need > 0 and others:
                    own, rank = own[hit], common[at[hit]]
                    prefixes[i] = np.unique(own[np.lexsort((own, rank))[:need]]).view(np.int64)
                    shingles[i] = sets[i].tobytes()
        return pa.table({"doc_id": left.column("doc_id"), "n_shingles": pa.array([len(s) for s in sets], pa.int64()), "set_key": pa.array(keys, pa.binary()), "prefix": pa.array(prefixes, pa.list_(pa.int64())), "shingles": pa.array(shingles, pa.binary())})

    return keep


def candidates(docs: DataFrame, percent: int, bucket_bytes: int | None = None) -> DataFrame:
    """doc_id, n_shingles, set_key of every row of docs, and prefix and shingles where the set may have a partner."""
    total = docs.select(F.sum(F.octet_length("text"))).first()[0] or 0
    bucket_bytes = bucket_bytes or int(min(64_000_000, 4_000_000 * max(1.0, total / 2e9) ** 0.5))
    buckets = int(max(1, -(-total // bucket_bytes)))
    parts = max(1, buckets // 2)
    # The partition in the hash deals rows that are equal in id and text.
    bucket = F.pmod(F.xxhash64("doc_id", "text", F.spark_partition_id()), F.lit(buckets)).cast("int")
    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("_text"), bucket.alias("_bucket"))
    told = dealt.groupBy("_bucket").applyInArrow(_told(parts), "part int, bucket int, keys binary, counts binary")
    shared = told.groupBy("part").applyInArrow(_shared, "_bucket int, part int, keys binary, common binary")
    return dealt.groupBy("_bucket").cogroup(shared.groupBy("_bucket")).applyInArrow(_kept(parts, percent), "doc_id long, n_shingles long, set_key binary, prefix array<long>, shingles binary")


def prefix_regions(prefixes: DataFrame) -> DataFrame:
    """(path, node): nodes (node, prefix) joined to regions by common tokens."""
    tokens = written(prefixes.select(F.explode("prefix").alias("token"), "node").distinct())
    least = tokens.groupBy("token").agg(F.min("node").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    edges = tokens.join(least, "token").where("a <> node").select("a", F.col("node").alias("b")).distinct()
    return near.components(edges).select(F.col("component").alias("path"), "node")


def voronoi(distance: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, region, home) of rows x pivots of distances: a row's home is its nearest pivot (the first of them), or the far region, numbered
    after the pivots, if none is nearer than 1 - reach; and its windows are the regions with smaller numbers that may hold sets within reach of it."""
    rows, pivots = distance.shape
    home, slack = distance.argmin(axis=1), 1e-9
    nearest = distance[np.arange(rows), home]
    home = np.where(nearest < 1 - reach - slack, home, pivots)
    # To a pivot's region from another's; from the far region to those whose sets may stand just inside.
    most = np.where(home < pivots, nearest + 2 * reach, 1.0) + slack
    window = (distance <= most[:, None]) & (np.arange(pivots)[None, :] < home[:, None])
    # A set at distance 1 reaches none that is nearer than 1 - reach.
    window &= distance < 1
    row, region = np.nonzero(window)
    return np.concatenate([np.arange(rows), row]), np.concatenate([home, region]), np.concatenate([np.ones(rows, bool), np.zeros(len(row), bool)])


def _split(rows: DataFrame, sets: DataFrame, percent: int, leaf: int, level: int) -> DataFrame:
    """Two kinds of rows: (path: the region's, node: the child's path, size: the number of the child, a: the set) and links (a, b) with a pivot."""
    reach = 1 - percent / 100
    rank = F.row_number().over(Window.partitionBy("path").orderBy(F.xxhash64("node", "path", F.lit(level))))
    blocks = F.ceil(F.col("size") / leaf).cast("int")
    pivots = rows.withColumn("rank", rank).where(F.col("rank") <= PIVOTS).withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = rows.withColumns({"rank": F.lit(0), "block": F.pmod(F.xxhash64("node", F.lit("voronoi")), blocks).cast("int")})
    both = dealt.unionByName(pivots).select(F.xxhash64("path", "block").alias("path"), F.col("path").alias("region"), "node", "rank")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in near._groups(batches):
            path = table.column("path").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(path)) + 1), len(path)]
            for low, high in zip(edges, edges[1:], strict=False):
                yield from _placed(table.slice(low, high - low), percent, reach).to_batches()

    return near._together(both.join(sets, "node")).mapInArrow(run, _TABLE)


def _placed(group: pa.Table, percent: int, reach: float) -> pa.Table:
    group = group.sort_by("rank")
    rank, node = group.column("rank").to_numpy(), group.column("node").to_numpy()
    sets = [np.frombuffer(x, np.uint64) for x in group.column("shingles").to_pylist()]
    n_rows = int((rank == 0).sum())
    rows, pivots, names = sets[:n_rows], sets[n_rows:], node[n_rows:]
    if not rows:
        return pa.table({c: pa.array([], pa.int64()) for c in ("path", "node", "size", "a", "b")})
    sizes = np.array([len(s) for s in rows])
    flat, starts = np.concatenate(rows), np.cumsum(sizes) - sizes
    common = np.stack([np.add.reduceat((p[np.minimum(np.searchsorted(p, flat), len(p) - 1)] == flat).astype(np.int64), starts) for p in pivots], axis=1)
    both = sizes[:, None] + np.array([len(p) for p in pivots])[None, :] - common
    row, child, _ = voronoi(1 - common / both, reach)
    linked, pivot = np.nonzero((100 * common >= percent * both) & (node[:n_rows, None] != names[None, :]))
    region = group.column("region")[0].as_py()
    nothing = lambda n: pa.nulls(n, pa.int64())
    return pa.table({
        "path": pa.concat_arrays([pa.array(np.full(len(row), region)), nothing(len(linked))]), "node": pa.concat_arrays([pa.array(node[:n_rows][row]), nothing(len(linked))]),
        "size": pa.concat_arrays([pa.array(child.astype(np.int64)), nothing(len(linked))]), "a": pa.concat_arrays([nothing(len(row)), pa.array(node[linked])]), "b": pa.concat_arrays([nothing(len(row)), pa.array(names[pivot])]),
    })


def _open(rows: DataFrame) -> DataFrame:
    """rows (path, node, component) of the regions that aren't one component, with size, most (their largest component) and others (the sets outside it)."""
    parts = rows.groupBy("path", "component").agg(F.count(F.lit(1)).alias("k"))
    nodes = parts.groupBy("path").agg(F.sum("k").alias("size"), F.max(F.struct("k", "component")).alias("top")).where(F.col("size") > F.col("top.k"))
    return rows.join(written(nodes.select("path", "size", F.col("top.component").alias("most"), (F.col("size") - F.col("top.k")).alias("others"))), "path")


def region_links(regions: DataFrame, sets: DataFrame, percent: int, leaf: int = LEAF) -> DataFrame:
    """(a, b): links that join the components of all regions (path, node); sets: (node, shingles)."""
    sets = sets.withColumn("bits", F.lit(0).cast("long"))
    rows, links = regions.withColumn("component", F.col("node")), None
    for level in range(LEVELS + 1):
        met = written(_open(rows))
        thick = (F.col("size") > leaf) & (F.col("others") > leaf / 8)
        deep = met.where(thick) if level < LEVELS else met.limit(0)
        now = near._joins(near._compared(met.where(~thick) if level < LEVELS else met, leaf), sets, percent).select("a", "b")
        any_deep = level < LEVELS and deep.limit(1).count() > 0
        if any_deep:
            split = written(_split(deep.select("path", "node", "size"), sets, percent, leaf, level))
            now = now.unionByName(split.where("a is not null").select("a", "b"))
        links = written(now if links is None else links.unionByName(now))
        if not any_deep:
            break
        labels = near.components(links)
        placed = split.where("a is null").select("path", "node", F.col("size").alias("child"))
        # A region whose windows hold more than it does is not split but compared, block by block.
        grown = written(placed.groupBy("path").agg(F.count(F.lit(1)).alias("rows")).join(deep.select("path", "size").distinct(), "path").select("path", (F.col("rows") <= 3 * F.col("size")).alias("fits")))
        children = placed.join(grown.where("fits"), "path").select(F.xxhash64("path", "child", F.lit(level)).alias("path"), "node")
        again = deep.select("path", "node", "component").join(grown.where("not fits").select("path"), "path")
        stuck = _open(near._labelled(again, labels))
        links = written(links.unionByName(near._joins(near._compared(stuck, leaf), sets, percent).select("a", "b")))
        rows = written(near._labelled(children.withColumn("component", F.col("node")), labels))
    return links.distinct()


def joined_components(docs: DataFrame, *, percent: int = 80, leaf: int = LEAF, bucket_bytes: int | None = None) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id (the smallest doc_id reachable by links, its own included).

    A set holds a text's distinct 5-word shingles, A-Z in lower case; with fewer words the whole sequence is one. Null, empty and blank texts have none and
    are linked with nothing. Equal sets are always linked, unequal ones at percent or more. Rows that share a doc_id, or have none, are linked only by their
    texts. A null doc_id is larger than any other; a component of none but such rows has a null component_id. An empty table gives no
    rows; other columns don't matter. A very long text is held whole by its bucket's task, and its set by each group it is compared in.
    """
    rows = written(candidates(docs, percent, bucket_bytes).withColumn("node", F.when(F.col("n_shingles") > 0, F.xxhash64("set_key"))))
    regions = written(prefix_regions(rows.where("prefix is not null").select("node", "prefix").dropDuplicates(["node"])))
    sets = written(rows.where("shingles is not null").select("node", "shingles").join(regions.select("node").distinct(), "node").dropDuplicates(["node"]))
    named = near.components(region_links(regions, sets, percent, leaf))
    own = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"))
    classes = rows.where("n_shingles > 0").groupBy("node").agg(F.min(own).alias("own"))
    classes = written(classes.join(named, "node", "left").withColumn("component", F.coalesce("component", "node")))
    best = classes.groupBy("component").agg(F.min("own").alias("best"))
    found = classes.join(best, "component").select(F.col("node").alias("_node"), F.col("best.id").alias("component_id"))
    out = rows.select("doc_id", "n_shingles", "node").join(found, F.col("node") == F.col("_node"), "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


#: As that of the near-duplicates, at 80 and without the row that stays.
ORACLE = near.ORACLE.replace("75 *", "80 *").replace(", s.doc_id = component_id AS kept", "")
