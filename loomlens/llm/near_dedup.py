"""MinHash near-dedup by a chosen-path set similarity join.

Each distinct shingle set gets a sketch of minwise hashes. A tree deals the sets to nodes by their minwise token
at one chosen coordinate; a large node is dealt to children by further coordinates that follow from its path
(BRANCH of them at each level, so that a similar pair nearly surely meets in a child) until few enough are left
to compare exhaustively. Independent trees are repeated to reach the recall.

A node of up to `leaf` sets is a group, compared in one task: first the nodes of FIRST trees, then those of all
others but for sets that are joined already. A larger node first compares all its sets with some of
them, its centres, in groups of bounded size: that settles groups of near copies of any size in linear time. If
few sets stand outside the node's largest component then, these meet all others, again in groups. Else the node
branches, if it has over DIRECT leaves; smaller ones, and what is large after the last level, are compared block by block. No pair of a compared node is left out.

A comparison has three steps. By sizes and signatures (four bits of 64 coordinates) each set learns whether its group
holds one that it might resemble; most don't and go no further. The others are told apart by long signatures (two bits of LONG more
coordinates), which pass next to no pair below 0.5. What is left meets once more with the shingles:
the whole set up to WHOLE shingles, else those whose hashes end in enough zeros. What comes out are not
pairs but the links that join the group's components, fewer than its sets. Only links that rest on
a part of a large set are confirmed on the full texts; where the part leaves doubt, all of the doubtful are.

Chances to lose a pair at similarity 0.75, with minwise tokens as independent draws: at the 17 root coordinates
6e-11; where all nodes it shares branch down to the last level, 6.8e-10 (the trees draw on one sketch of 64, which
is counted); by the signature 3e-11, by the long one 2e-11, exact binomial tails; by the part of a large set under 1e-10.

Shuffled: a sketch per document, 17 slim rows per distinct set, the texts once, the shingles of those that pass
the first step once for each group. Copies with equal sets are one set from the start. Documents without an id, or
with one id, share nothing but it. Components are found by joins, never on the driver.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomlens.llm.common import null_safe, slices, written
from loomlens.llm.rolling import mixed, window_hashes, word_hashes

SKETCH, TREES, BRANCH = 64, 17, (4, 4, 2)
#: Bits of each coordinate in a signature.
PLANES = ("p", "q", "r", "s")
#: Sets of a group that is compared in one task, centres of a larger node, shingles of a set that are compared as a whole.
LEAF, CENTRES, WHOLE = 2048, 16, 2048
#: Coordinates of the long signature, two bits each; large nodes up to DIRECT times the leaf are compared as they are.
LONG, DIRECT = 512, 8
#: Trees whose small nodes are compared before the others.
FIRST = 3
_LAST = 9223372036854775807


@lru_cache(maxsize=2)
def _functions(count: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    random = np.random.default_rng(seed)
    return random.integers(1, 1 << 31, count).astype(np.uint32) * np.uint32(2) + np.uint32(1), random.integers(0, 1 << 32, count, dtype=np.uint64).astype(np.uint32)


def shingle_sets(texts: list[bytes], words: int = 5) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's shingles (A-Z in lower case); a text with fewer
    words is one shingle, one without words has none."""
    hashes, counts = word_hashes([t.lower() for t in texts])
    windows = window_hashes(hashes, words)
    sets, start = [], 0
    for n in counts.tolist():
        if n >= words:
            sets.append(np.unique(windows[start : start + n - words + 1]))
        else:
            sets.append(window_hashes(hashes[start : start + n], n) if n else np.zeros(0, np.uint64))
        start += n
    return sets


def sketches(sets: list[np.ndarray], count: int = SKETCH, seed: int = 9) -> np.ndarray:
    """`count` minwise hashes (32 bits) of each set; zeros for an empty one."""
    out = np.zeros((len(sets), count), np.uint32)
    full = [i for i, s in enumerate(sets) if len(s)]
    if full:
        flat = np.concatenate([sets[i] for i in full])
        flat = (flat >> np.uint64(32)).astype(np.uint32) ^ flat.astype(np.uint32)
        starts = np.cumsum([0, *[len(sets[i]) for i in full[:-1]]])
        for k, (a, b) in enumerate(zip(*_functions(count, seed), strict=True)):
            out[full, k] = np.minimum.reduceat(flat * a + b, starts)
    return out


def sketched(docs: DataFrame) -> DataFrame:
    """doc_id, _text (hash), n_shingles, set_key (of the whole set), sig (planes of bits) and sketch of each row."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("_text"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, ("text",), 4_000_000, 500):
                sets = shingle_sets(batch.column("text").to_pylist())
                found = sketches(sets)
                sigs = []
                for shift in range(16, 16 + len(PLANES)):
                    bits = (found >> np.uint32(shift)) & np.uint32(1)
                    sigs.append(pa.array((bits.astype(np.uint64) << np.arange(SKETCH, dtype=np.uint64)).sum(axis=1, dtype=np.uint64).view(np.int64), pa.int64()))
                keys = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("_text"), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), pa.StructArray.from_arrays(sigs, list(PLANES)), pa.ListArray.from_arrays(pa.array(np.arange(0, (len(sets) + 1) * SKETCH, SKETCH), pa.int32()), pa.array(found.view(np.int32).ravel(), pa.int32()))],
                    ["doc_id", "_text", "n_shingles", "set_key", "sig", "sketch"],
                )

    return own.mapInArrow(run, "doc_id long, _text long, n_shingles long, set_key binary, sig struct<" + ", ".join(f"{x}: long" for x in PLANES) + ">, sketch array<int>")


def long_signatures(sets: list[np.ndarray]) -> list[bytes]:
    """Two bits of LONG minwise hashes of each set: all first bits, then all second ones."""
    found = sketches(sets, LONG, 10)
    planes = [np.packbits((found >> np.uint32(shift) & np.uint32(1)).astype(np.uint8), axis=1) for shift in (16, 17)]
    return [x.tobytes() for x in np.concatenate(planes, axis=1)]


@lru_cache(maxsize=16)
def differing(percent: int, loss: float = 1e-10, count: int = SKETCH, bits: int = len(PLANES)) -> int:
    """The most of `count` coordinates that may differ in their bits: a pair at the similarity exceeds it with a chance under loss."""
    p = (1 - percent / 100) * (1 - 0.5**bits)
    for k in range(count):
        tail = sum(math.comb(count, i) * p**i * (1 - p) ** (count - i) for i in range(k + 1, count + 1))
        if tail < loss:
            return k
    return count


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole groups from batches sorted by path; a group may reach over several batches."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = table if held is None else pa.concat_tables([held, table])
        path = table.column("path").to_numpy()
        cut = int(np.searchsorted(path, path[-1]))
        if cut:
            yield table.slice(0, cut)
        held = table.slice(cut)
    if held is not None:
        yield held


def _together(rows: DataFrame) -> DataFrame:
    return rows.repartition("path").sortWithinPartitions("path")


def _promising(rows: DataFrame, percent: int) -> DataFrame:
    """The rows in whose group stands a set of another component that may reach the similarity, by sizes and
    signatures, where one of the two asks: path, node, n, PLANES, component, asks and tree."""
    most, names = differing(percent), ["path", "node", "n", *PLANES, "component", "asks", "tree"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches):
            path, n, component, asks, *planes = (table.column(c).to_numpy() for c in ("path", "n", "component", "asks", *PLANES))
            hit, i, step = np.zeros(len(path), bool), np.arange(len(path)), 0
            while len(i):
                step += 1
                i = i[i + step < len(path)]
                i = i[path[i] == path[i + step]]
                j = i + step
                ok = (asks[i] | asks[j]) & (component[i] != component[j]) & (100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j]))
                a, b = i[ok], j[ok]
                unlike = np.bitwise_or.reduce([x[a] ^ x[b] for x in planes]).view(np.uint64)
                near = np.bitwise_count(unlike) <= most
                hit[a[near]] = hit[b[near]] = True
            yield from table.filter(pa.array(hit)).to_batches()

    rows = _together(rows.select(*names))
    return rows.mapInArrow(run, rows.schema)


def alike(long: np.ndarray, i: int, others: np.ndarray, percent: int) -> np.ndarray:
    """Which of the others (rows of 64-bit words, long signatures) may reach the similarity to row i."""
    unlike = np.bitwise_count((long[others] ^ long[i])[:, : LONG // 64] | (long[others] ^ long[i])[:, LONG // 64 :]).sum(axis=1, dtype=np.int64)
    return unlike <= differing(percent, 1e-11, LONG, 2)


def _similar(rows: DataFrame, shingles: DataFrame, percent: int) -> DataFrame:
    """Of rows (path, node, n, component, asks, tree) those in whose group stands a set of another component that may reach
    the similarity by the long signatures, where one of the two asks."""
    names = ["path", "node", "component", "asks", "n", "tree"]
    rows = rows if "twice" in rows.columns else rows.withColumn("twice", F.lit(False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches):
            path, n, component, asks, twice = (table.column(c).to_numpy() for c in ("path", "n", "component", "asks", "twice"))
            long = np.frombuffer(b"".join(table.column("long").to_pylist()), np.uint64).reshape(len(path), -1)
            words, few = LONG // 64, LONG // 256  # a quarter of the coordinates tells for most pairs
            planes = [np.ascontiguousarray(long[:, k]) for k in (*range(few), *range(words, words + few))]
            most, hit = differing(percent, 1e-11, LONG // 4, 2), np.zeros(len(path), bool)
            edges = [0, *(np.flatnonzero(np.diff(path)) + 1), len(path)]
            for low, high in zip(edges, edges[1:], strict=False):
                order = low + np.argsort(~asks[low:high], kind="stable")  # those that ask come first
                own = [x[order] for x in planes]
                sizes, labels = n[order], component[order]
                asking = int(asks[low:high].sum())
                for i in range(asking):
                    j = asking if twice[order[i]] else i + 1
                    unlike = sum(np.bitwise_count((x[j:] ^ x[i]) | (y[j:] ^ y[i])) for x, y in zip(own[:few], own[few:], strict=True))
                    others = j + np.flatnonzero((unlike <= most) & (labels[j:] != labels[i]))
                    others = others[100 * np.minimum(sizes[others], sizes[i]) >= percent * np.maximum(sizes[others], sizes[i])]
                    if len(others):
                        near = order[others[alike(long, order[i], order[others], percent)]]
                        if len(near):
                            hit[near] = hit[order[i]] = True
            yield from table.select(names).filter(pa.array(hit)).to_batches()

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return _together(rows.select(*names, "twice").join(shingles.select("node", "long"), "node")).mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in names))


def joining(path: np.ndarray, sets: list[np.ndarray], bits: np.ndarray, component: np.ndarray, asks: np.ndarray, percent: int) -> Iterator[tuple[int, int, int]]:
    """(i, j, grade): links that join the components of each group; path is sorted, and a set with bits holds only the
    hashes that end in so many zero bits. Grade 2 rests on both whole sets, 1 on parts that leave no doubt, 0 is doubtful."""
    sizes, component = np.array([len(s) for s in sets]), component.copy()
    fewer = np.array([np.count_nonzero(s & np.uint64((2 << int(b)) - 1) == 0) for s, b in zip(sets, bits, strict=True)])
    edges = np.flatnonzero(np.diff(path)) + 1
    of_group = np.repeat(np.arange(len(edges) + 1), np.diff(edges, prepend=0, append=len(path)))
    flat, owner = np.concatenate(sets) ^ np.repeat(mixed(of_group.astype(np.uint64) + np.uint64(1)), sizes), np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(flat, kind="stable")
    ranked, owners = flat[order], owner[order]
    begins = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1]))
    lengths = np.diff(begins, append=len(ranked))
    start, length = np.empty(len(flat), np.int64), np.empty(len(flat), np.int64)
    start[order], length[order] = np.repeat(begins, lengths), np.repeat(lengths, lengths)
    at, share = np.cumsum(sizes) - sizes, percent / 100
    for low, high in zip([0, *edges], [*edges, len(path)], strict=True):
        own = component[low:high]
        for i in np.flatnonzero(asks[low:high]) + low:
            if (own == own[0]).all():
                break
            s, k = start[at[i] : at[i] + sizes[i]], length[at[i] : at[i] + sizes[i]]
            s, k = s[k > 1], k[k > 1]
            met = owners[np.repeat(s - (np.cumsum(k) - k), k) + np.arange(k.sum())]
            common = np.bincount(met - low, minlength=high - low)
            j = np.flatnonzero((common > 0) & (own != component[i]))
            common, top = common[j], np.maximum(bits[i], bits[low + j])
            both = np.where(top > bits[i], fewer[i], sizes[i]) + np.where(top > bits[low + j], fewer[low + j], sizes[low + j]) - common
            whole = top == 0
            doubt = np.where(whole, 0.0, 6.5 * np.sqrt(share * (1 - share) * both))
            linked = np.where(whole, 100 * common >= percent * both, common >= share * both + doubt)
            labels = own[j]
            for label in np.unique(labels[linked]):
                first = np.flatnonzero(linked & (labels == label))
                first = first[np.argmax(whole[first])]
                yield i, low + j[first], 2 if whole[first] else 1
            own[np.isin(own, labels[linked])] = component[i]
            for m in np.flatnonzero(~whole & ~linked & (common >= share * both - doubt) & (own[j] != component[i])):
                yield i, low + j[m], 0


def _joins(rows: DataFrame, shingles: DataFrame, percent: int) -> DataFrame:
    """(a, b, grade): links of rows (path, node, component, asks), as few as join the components of each group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches):
            node, path, bits, component, asks = (table.column(c).to_numpy() for c in ("node", "path", "bits", "component", "asks"))
            sets = [np.frombuffer(x, np.uint64) for x in table.column("shingles").to_pylist()]
            found = list(joining(path, sets, bits, component, asks, percent))
            ends = node[np.array([x[:2] for x in found], np.int64).reshape(-1, 2)]
            yield pa.RecordBatch.from_arrays([pa.array(ends.min(axis=1)), pa.array(ends.max(axis=1)), pa.array([x[2] for x in found], pa.int32())], ["a", "b", "grade"])

    rows = rows.select("path", "node", "component", "asks")
    return _together(rows.join(shingles.select("node", "bits", "shingles"), "node")).mapInArrow(run, "a long, b long, grade int").groupBy("a", "b").agg(F.max("grade").alias("grade"))


def _shingles(texts: DataFrame) -> DataFrame:
    """(node, bits, shingles, long) of (node, text): the set's hashes, or a part of them once it has over WHOLE, and its long signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, ("text",), 4_000_000, 500):
                sets = shingle_sets(batch.column("text").to_pylist())
                bits = [max(0, math.ceil(math.log2(len(s) / WHOLE))) if len(s) else 0 for s in sets]
                parts = [s[s & np.uint64((1 << b) - 1) == 0].tobytes() for s, b in zip(sets, bits, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(bits, pa.int64()), pa.array(parts, pa.binary()), pa.array(long_signatures(sets), pa.binary())], ["node", "bits", "shingles", "long"])

    return texts.mapInArrow(run, "node long, bits long, shingles binary, long binary")


def _texts(nodes: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, text): the text of one document of each set."""
    at = F.coalesce("doc_id", F.lit(_LAST)).alias("_at")
    asked = nodes.select("node").distinct().join(classes.select("node", F.col("own.id").alias("doc_id"), F.col("own.text").alias("_text")), "node").select("node", at, "_text")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("_text"), F.col("text").cast("binary").alias("text")).select(at, "_text", "text")
    return texts.join(asked, ["_at", "_text"]).dropDuplicates(["node"]).select("node", "text")


def confirmed(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets reach the similarity."""
    left, right = texts.select(F.col("node").alias("a"), F.col("text").alias("left")), texts.select(F.col("node").alias("b"), F.col("text").alias("right"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, ("left", "right"), 4_000_000, 200):
                sides = [batch.column(c).to_pylist() for c in ("left", "right")]
                distinct = list({t for side in sides for t in side})
                sets = dict(zip(distinct, shingle_sets(distinct), strict=True))
                keep = []
                for x, y in zip(*sides, strict=True):
                    common = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                    keep.append(100 * common >= percent * (len(sets[x]) + len(sets[y]) - common))
                yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(left, "a").join(right, "b").select("a", "b", "left", "right").mapInArrow(run, "a long, b long").distinct()


def _nodes(rows: DataFrame) -> DataFrame:
    """rows (path, node, ...) of paths that hold at least two, with their number as size."""
    # A table, so that the join can split a path that holds many of the rows.
    sizes = written(rows.groupBy("path").agg(F.count(F.lit(1)).alias("size")).where("size > 1"))
    return rows.join(sizes, "path")


def _children(rows: DataFrame, sets: DataFrame, level: int) -> DataFrame:
    """rows of the nodes' children at BRANCH coordinates that follow from node and level."""
    start = F.pmod(F.xxhash64("path", F.lit(level)), F.lit(SKETCH)).cast("int")
    choice = lambda k: (start + F.lit(k * SKETCH // BRANCH[level])) % SKETCH
    child = lambda k: F.xxhash64("path", F.lit(level), choice(k), F.get("sketch", choice(k)))
    paths = F.array(*[child(k) for k in range(BRANCH[level])])
    return rows.join(sets.select("node", "sketch"), "node").select(F.explode(paths).alias("path"), "node", "n", *PLANES, "component", "tree")


def _block(name: str, blocks: Column | str) -> Column:
    return F.pmod(F.xxhash64("node", F.lit(name)), blocks).cast("int")


def _stars(large: DataFrame, leaf: int) -> DataFrame:
    """Groups in which CENTRES sets of each node ask the others, `leaf` of them at a time."""
    blocks = F.ceil(F.col("size") / leaf)
    rank = F.row_number().over(Window.partitionBy("path").orderBy(F.xxhash64("node", "path")))
    centres = large.withColumn("rank", rank).where(F.col("rank") <= CENTRES).withColumn("block", F.explode(F.sequence(F.lit(0), blocks.cast("int") - 1)))
    rows = large.withColumn("block", _block("star", blocks)).withColumn("asks", F.lit(False)).unionByName(centres.drop("rank").withColumn("asks", F.lit(True)))
    return rows.withColumn("path", F.xxhash64("path", F.lit("star"), "block"))


def _compared(rows: DataFrame, leaf: int) -> DataFrame:
    """Groups in which all sets outside a node's largest component meet all of the node: rows with size,
    others (how many are outside) and most (the largest component)."""
    asking, asked = F.ceil(F.col("others") / leaf).cast("int"), F.ceil(F.col("size") / leaf).cast("int")
    outside = F.col("component") != F.col("most")
    to = lambda i, j: F.xxhash64("path", F.lit("all"), i, j)
    one = (asking == 1) & (asked == 1)
    asks = rows.where(outside).withColumn("path", F.explode(F.transform(F.sequence(F.lit(0), asked - 1), lambda j: to(_block("asks", asking), j)))).withColumn("asks", F.lit(True))
    meets = rows.where(~(outside & one)).withColumn("path", F.explode(F.transform(F.sequence(F.lit(0), asking - 1), lambda i: to(i, _block("asked", asked))))).withColumn("asks", F.lit(False))
    # In several groups whoever asks is met as asked too, and needn't meet the others that ask with it.
    return asks.withColumn("twice", ~one).unionByName(meets.withColumn("twice", F.lit(False)))


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """rows with the components that links made so far."""
    return rows.drop("component").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))


def _promising_below(rows: DataFrame, sets: DataFrame, shingles: DataFrame, percent: int, leaf: int) -> DataFrame:
    """What is left to compare in large nodes between the components of rows. Nodes of up to DIRECT leaves are compared block by block
    by their long signatures, larger ones branch first."""
    found = None
    for level in range(len(BRANCH) + 1):
        parts = rows.groupBy("path", "component").agg(F.count(F.lit(1)).alias("k"))
        nodes = parts.groupBy("path").agg(F.sum("k").alias("size"), F.max(F.struct("k", "component")).alias("top")).where(F.col("size") > F.col("top.k"))
        nodes = written(nodes.select("path", "size", F.col("top.component").alias("most"), (F.col("size") - F.col("top.k")).alias("others")))
        met = written(rows.drop("size").join(nodes, "path"))
        last = level == len(BRANCH)
        direct = (F.col("others") <= leaf) | (F.col("size") <= DIRECT * leaf)
        here = _similar(_compared(met if last else met.where(direct), leaf), shingles, percent)
        found = here if found is None else found.unionByName(here)
        deep = met.where(~direct)
        if last or not deep.limit(1).count():
            break
        rows = written(_children(deep, sets, level))
    return found


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for every node that edges (a, b) touch.

    Each round names every node by its smallest neighbour, follows names twice, and draws the edges anew between
    names: most vanish at once, and the number of rounds grows with the logarithm of a component's width. The
    smallest node keeps its name to the end. Only whether edges are left reaches the driver.
    """
    links, names = written(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()), None
    while names is None or links.limit(1).count():
        both = links.union(links.select("b", "a"))
        near = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("name")))
        for _ in range(2):
            near = _renamed(near, near, "name")
        near = written(near)
        links = _renamed(_renamed(links, near, "a"), near, "b").where("a <> b")
        links = written(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        names = near if names is None else written(_renamed(names, near, "name"))
    return names.withColumnRenamed("name", "component")


def _renamed(rows: DataFrame, names: DataFrame, column: str) -> DataFrame:
    """rows with the names (node, name) of the nodes in the column; nodes without one stay."""
    others = names.select(F.col("node").alias("_node"), F.col("name").alias("_name"))
    found = rows.join(others, F.col(column) == F.col("_node"), "left").withColumn(column, F.coalesce("_name", column))
    return found.drop("_node", "_name")


def _links(slim: DataFrame, docs: DataFrame, percent: int, leaf: int) -> DataFrame:
    """(set_key, best: id and text of the first document of the set's component, null ids last).

    Nodes are the distinct sets, named by a 64-bit hash; documents only name the component they are in.
    """
    own = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("_text").alias("text"))
    first = F.struct(F.xxhash64("set_key").alias("node"), F.col("n_shingles").alias("n"), "sig", "sketch")
    classes = written(slim.where("n_shingles > 0").groupBy("set_key").agg(F.min(first).alias("c"), F.min(own).alias("own")).select("set_key", "c.*", "own"))
    roots = F.array(*[F.xxhash64(F.lit(t), F.col("sketch")[t * (SKETCH // TREES)]) for t in range(TREES)])
    rows = classes.select(F.posexplode(roots).alias("tree", "path"), "node", "n", "sig.*", F.col("node").alias("component"))
    shared = written(_nodes(rows))
    small = written(_promising(shared.where(F.col("size") <= leaf).withColumn("asks", F.lit(True)), percent))
    large = shared.where(F.col("size") > leaf)
    # Only sets that may resemble another, or stand in a large node, are fetched with their texts.
    shingles = written(_shingles(_texts(small.select("node").union(large.select("node")), classes, docs)))
    some = _joins(_similar(small.where(F.col("tree") < FIRST), shingles, percent), shingles, percent)
    any_large = large.limit(1).count() > 0
    if any_large:
        some = some.unionByName(_joins(_similar(_promising(_stars(large, leaf), percent), shingles, percent), shingles, percent))
    some = written(some)
    labels = components(some.where("grade > 0"))
    rest = _similar(_promising(_labelled(small.where(F.col("tree") >= FIRST), labels), percent), shingles, percent)
    if any_large:
        rest = rest.unionByName(_promising_below(_labelled(large, labels), classes, shingles, percent, leaf))
    links = written(some.unionByName(_joins(rest, shingles, percent)))
    sure, unsure = links.where("grade = 2").select("a", "b"), links.where("grade < 2").select("a", "b").distinct()
    if unsure.limit(1).count():
        long = docs.where(F.octet_length("text") > 2 * WHOLE)
        texts = written(_texts(unsure.select(F.explode(F.array("a", "b")).alias("node")), classes, long))
        sure = sure.union(confirmed(unsure, texts, percent))
    named = components(sure).join(classes.select("node", "own"), "node")
    best = named.groupBy("component").agg(F.min("own").alias("best"))
    named = named.join(best, "component").select("node", "best")
    return classes.select("set_key", "node", "own").join(named, "node", "left").select("set_key", F.coalesce("best", "own").alias("best"))


def _grouped(docs: DataFrame, percent: int, leaf: int) -> DataFrame:
    """doc_id, n_shingles, _text and best of each row; best is null where there are no shingles."""
    slim = written(sketched(docs))
    return slim.select("doc_id", "_text", "n_shingles", "set_key").join(_links(slim, docs, percent, leaf), "set_key", "left").drop("set_key")


def near_groups(docs: DataFrame, *, percent: int = 75, leaf: int = LEAF) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept (and _text, its text's hash).

    Null and empty texts, and texts without words, have no shingles and are linked with nothing; a
    text of one to four words is one shingle. Equal sets are always linked. Only texts link: rows that
    share a doc_id, or have none, are linked when their texts are. A component has the id of its smallest
    doc_id. A null doc_id is larger than any other and comes back as null; where a component has no other
    id, the rows with its least text hash say kept. An empty table gives no rows; other columns don't matter.
    Very long texts are read whole, in batches of some 4 MB of text (a longer text alone); when sets are
    compared, one takes at most WHOLE hashes, and only a pair to confirm is put side by side in full.
    """
    rows = _grouped(docs, percent, leaf)
    component = F.when(F.col("n_shingles") > 0, F.col("best.id")).otherwise(F.col("doc_id"))
    rows = rows.withColumn("component_id", component)
    one = F.col("doc_id").isNotNull() | (F.col("n_shingles") == 0) | (F.col("_text") == F.col("best.text"))
    return rows.select("doc_id", "n_shingles", "component_id", (F.col("doc_id").eqNullSafe(F.col("component_id")) & one).alias("kept"), "_text")


def near_deduplicated(docs: DataFrame, *, percent: int = 75, leaf: int = LEAF) -> DataFrame:
    """The rows of docs that stay, with docs' columns: of each component the first by doc_id (null last)
    and text hash. Rows without shingles all stay, once for each doc_id and text."""
    first = F.col("doc_id").eqNullSafe(F.col("best.id")) & (F.col("_text") == F.col("best.text"))
    stay = _grouped(docs, percent, leaf).where((F.col("n_shingles") == 0) | first).select(null_safe("doc_id").alias("_id"), "_text")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("_text"))
    rows = rows.select("_row", null_safe("doc_id").alias("_id"), "_text")
    return rows.join(stay, ["_id", "_text"], "left_semi").dropDuplicates(["_id", "_text"]).select("_row.*")


ORACLE = r"""
WITH RECURSIVE split AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingle AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) END) AS s FROM split),
size AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM shingle a JOIN shingle b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT x, y FROM common JOIN size p ON p.doc_id = x JOIN size q ON q.doc_id = y WHERE 100 * k >= 75 * (p.n + q.n - k)),
edge AS (SELECT x, y FROM link UNION SELECT y, x FROM link),
reach AS (SELECT doc_id AS x, doc_id AS y FROM split UNION SELECT r.x, e.y FROM reach r JOIN edge e ON r.y = e.x),
component AS (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x)
SELECT s.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, s.doc_id = component_id AS kept
FROM split s JOIN component USING (doc_id) LEFT JOIN size USING (doc_id)
"""
