"""k-center coresets of groups of any size: no task holds more than `rows` rows, nor all centers of a large group.

- A group of up to `rows` rows is one task's exact greedy.
- While a group's centers fit half a task, or it has more than eight rows for each center, parts of about `rows` rows, dealt by hash, each keep
  a `shrink`-th of their rows (or the number of centers, if that is more) by greedy choice, until it fits. Two rounds of it
  are at most four times off the best radius where parts keep the number of centers (Malkomes et al., 2015).
- What is larger then has more centers than half a task. It is dealt to the Voronoi cells of pivots, and large cells again, until all fit a task.
  Each cell lists centers by greedy choice with the distance at which each was chosen; the centers with the largest distances
  over all cells are taken, which gives each cell its quota. With r the last distance taken, all rows are within r of a center of their cell, and centers of
  a cell are at least r apart. So r is at most twice the best radius that K / m centers could reach, where a ball of that radius meets at most m cells.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomlens.operators.graph import shared_table
from loomlens.operators.neighbours import _beside, _cells, matrix
from loomlens.operators.ranking import running_sums

#: Pivots of a cell that is split; rows for each center above which a group is thinned first.
PIVOTS, SPARSE = 256, 8


def greedy_order(features: np.ndarray, keep: int, first: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows in order of choice, distance to those before at which each was chosen, final squared distances of all rows,
    -1 for the chosen): repeatedly the row farthest from those chosen, the first such row on ties. Each row is chosen once at most."""
    keep = max(1, min(keep, len(features)))
    chosen, gaps = [first], [np.inf]
    nearest = ((features - features[first]) ** 2).sum(axis=1)
    nearest[first] = -1
    while len(chosen) < keep:
        far = int(nearest.argmax())
        chosen.append(far)
        gaps.append(float(nearest[far]) ** 0.5)
        nearest = np.minimum(nearest, ((features - features[far]) ** 2).sum(axis=1))
        nearest[far] = -1
    return np.array(chosen), np.array(gaps), nearest


def lazy_order(features: np.ndarray, keep: int, first: int) -> tuple[list[int], list[float]]:
    """(rows in order of choice, distance to those before at which each was chosen), as greedy_order: distances only fall, so a row's old
    one is a bound, and only rows that come to the top of the heap are compared with the centers chosen since."""
    keep = max(1, min(keep, len(features)))
    chosen, gaps = [first], [np.inf]
    centers = np.empty((keep, features.shape[1]))
    centers[0] = features[first]
    bound = ((features - features[first]) ** 2).sum(axis=1)
    seen = np.ones(len(features), np.int64)
    heap = [(-float(b), i) for i, b in enumerate(bound) if i != first]
    heapq.heapify(heap)
    while len(chosen) < keep:
        far, i = heap[0]
        if seen[i] == len(chosen):
            heapq.heappop(heap)
            centers[len(chosen)] = features[i]
            chosen.append(i)
            gaps.append(float(-far) ** 0.5)
        else:
            near = float(((centers[seen[i] : len(chosen)] - features[i]) ** 2).sum(axis=1).min())
            seen[i] = len(chosen)
            heapq.heapreplace(heap, (max(far, -near), i))
    return chosen, gaps


def start_order(seed: int, key: Column | str = "patch_id") -> Column:
    return F.md5(F.concat(F.lit(f"{seed}|"), (F.col(key) if isinstance(key, str) else key).cast("string")))


def _first(table: pa.Table) -> int:
    return int(np.argmin(np.array(table.column("_start").to_pylist())))


def greedy(keep_of, key: str):
    """The rows of a table with columns key, feature and _start that greedy choice keeps, with their rank."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by(key)
        chosen, _ = lazy_order(matrix(table, "feature"), keep_of(table.num_rows), _first(table))
        return table.take(pa.array(chosen)).drop_columns(["_start"]).append_column("rank", pa.array(np.arange(len(chosen)), pa.int32()))

    return run


def _counted(rows: DataFrame, by: str, name: str) -> DataFrame:
    return _beside(rows.drop(name), rows.groupBy(by).agg(F.count(F.lit(1)).alias(name)), [by])


def coreset_distributed(patches: DataFrame, keep: int | None = None, seed: int = 0, group: str = "category", key: str = "patch_id", ratio: float | str = 0.1, rows: int = 20_000, shrink: int = 4) -> DataFrame:
    """(group, key, feature, rank): `keep` rows of each group, or max(1, floor(n ratio)); ratio may name a column. A smaller number of them is
    the prefix by rank. Groups of at most `rows` rows are those of the exact greedy choice. Null groups count as a group; key is unique in a group."""
    share = F.col(ratio).cast("double") if isinstance(ratio, str) else F.lit(float(ratio))
    n_keep = F.lit(keep).cast("long") if keep is not None else F.greatest(F.lit(1).cast("long"), F.floor(F.col("_n") * F.col("_share")))
    held = _counted(patches.select(group, key, "feature", share.alias("_share")), group, "_n").withColumn("_keep", n_keep).drop("_share")
    kinds = {f.name: f.dataType.simpleString() for f in held.schema}
    columns = f"{group} {kinds[group]}, {key} {kinds[key]}, feature {kinds['feature']}"
    few = F.col("_keep") <= rows / 2

    def some(table: pa.Table) -> pa.Table:
        own = table.column("_keep")[0].as_py()
        most = max(own if own <= rows / 2 else 1, -(-table.num_rows // shrink))
        return greedy(lambda n: most, key)(table.drop_columns(["_part"])).drop_columns(["rank"])

    dense = (F.col("_n") > rows) & (few | (F.col("_n") > SPARSE * F.col("_keep")))
    while held.where(dense).limit(1).count():
        thin = held.where(dense).withColumns({"_start": start_order(seed, key), "_part": F.pmod(F.xxhash64(key, "_n"), F.ceil(F.col("_n") / rows)).cast("int")})
        left = thin.groupBy(group, "_part").applyInArrow(some, f"{columns}, _n long, _keep long")
        held = shared_table(_counted(held.where(~dense).unionByName(left), group, "_n"))
    small, large = held.where(F.col("_n") <= rows), held.where(F.col("_n") > rows)
    last = lambda t: greedy(lambda n: t.column("_keep")[0].as_py(), key)(t).drop_columns(["_keep", "_n"])
    found = small.withColumn("_start", start_order(seed, key)).groupBy(group).applyInArrow(last, f"{columns}, rank int")
    if large.limit(1).count():
        found = found.unionByName(_by_quotas(fitting_cells(large, group, key, rows), group, key, seed))
    return found


def fitting_cells(held: DataFrame, group: str, key: str, rows: int) -> DataFrame:
    """(path, own: group, key and _keep, feature, size): rows dealt to Voronoi cells of at most `rows` rows, cells in cells. What pivots
    don't split (a cell that keeps more than nine tenths of its rows, such as copies of one vector) is dealt by hash."""
    own = F.struct(F.col(group).alias("g"), F.col(key).alias("k"), F.col("_keep").alias("keep"))
    left = shared_table(_counted(held.select(F.concat_ws("|", F.lit("g"), F.xxhash64(group).cast("string")).alias("path"), F.col("feature").alias("_vector"), own.alias("_dealt")), "path", "size"))
    done = None
    while True:
        fits = left.where(F.col("size") <= rows)
        done = fits if done is None else done.unionByName(fits)
        left = left.where(F.col("size") > rows)
        if not left.limit(1).count():
            return done.withColumnsRenamed({"_vector": "feature", "_dealt": "own"})
        rank = F.row_number().over(Window.partitionBy("path").orderBy(F.xxhash64("path", "_dealt")))
        pivots = left.withColumn("_cell", (rank - 1).cast("long")).where((F.col("_cell") < PIVOTS) & (F.col("_cell") < F.ceil(4 * F.col("size") / rows)))
        placed = _cells(left.select("path", "_vector", "_dealt"), shared_table(pivots.select("path", "_cell", F.col("_vector").alias("_pivot"))), "path", rows)
        placed = _beside(placed, left.groupBy("path").agg(F.first("size").alias("_before")), ["path"])
        placed = _counted(placed.withColumn("_path", F.concat_ws(".", "path", F.col("_cell").cast("string"))), "_path", "size")
        stuck = F.col("size") > 0.9 * F.col("_before")
        by_hash = F.concat_ws("#", "_path", F.pmod(F.xxhash64("_dealt", "_path"), F.ceil(2 * F.col("size") / rows)).cast("string"))
        left = placed.select(F.when(stuck, by_hash).otherwise(F.col("_path")).alias("path"), "_vector", "_dealt")
        left = shared_table(_counted(left.withColumn("size", F.lit(0)), "path", "size"))


def _listed(cells: DataFrame, seed: int) -> DataFrame:
    """(path, own, feature, no, gap, left) of the first `most` centers of each cell: order and distance of choice; left is what remains."""
    kinds = {f.name: f.dataType.simpleString() for f in cells.schema}

    def run(table: pa.Table) -> pa.Table:
        table = table.take(pa.array(sorted(range(table.num_rows), key=lambda i: table.column("_start")[i].as_py())))
        chosen, gaps, nearest = greedy_order(matrix(table, "feature"), table.column("most")[0].as_py(), 0)
        n, out = len(chosen), table.take(pa.array(chosen)).select(["path", "own", "feature"])
        rest = max(0.0, float(nearest.max())) ** 0.5 if n < table.num_rows else -1.0
        return out.append_column("no", pa.array(np.arange(n), pa.int64())).append_column("gap", pa.array(gaps, pa.float64())).append_column("left", pa.array(np.full(n, rest), pa.float64()))

    dealt = cells.withColumn("_start", start_order(seed, F.col("own.k")))
    return dealt.groupBy("path").applyInArrow(run, f"path {kinds['path']}, own {kinds['own']}, feature {kinds['feature']}, no long, gap double, left double")


def _by_quotas(cells: DataFrame, group: str, key: str, seed: int) -> DataFrame:
    """Of all cells' centers, each group's `keep` with the largest distances of choice."""
    g, keep = F.xxhash64("own.g").alias("_g"), F.col("own.keep").alias("_keep")  # never null, as running sums join by it
    totals = shared_table(cells.groupBy(g).agg(F.count(F.lit(1)).alias("_n"), F.first(keep).alias("_keep")))
    cells = _beside(cells.withColumn("_g", g), totals, ["_g"])
    cells = shared_table(cells.withColumn("most", F.least("size", F.ceil(2 * F.col("_keep") * F.col("size") / F.col("_n")) + 1)).drop("_n", "_keep", "_g"))
    listed = shared_table(_listed(cells, seed))
    while True:
        counts = listed.groupBy(g, "gap").agg(F.count(F.lit(1)).alias("n"))
        sums = shared_table(_beside(running_sums(counts, ["_g"], "gap", ["n"], descending=True), totals, ["_g"]))
        cut = sums.where(F.col("n_upto") >= F.col("_keep")).groupBy("_g").agg(F.max("gap").alias("_cut"))
        ends = listed.groupBy("path", g).agg(F.first("left").alias("_left"))
        # A cell that stopped above the cut (or at it, before it ran out) may owe more; so may all of a group without a cut.
        short = shared_table(_beside(ends, cut, ["_g"], "left").where((F.col("_left") >= 0) & (F.col("_left") > F.coalesce("_cut", F.lit(-1.0)))).select("path"))
        if not short.limit(1).count():
            break
        again = cells.join(short, "path").withColumn("most", F.least("size", 2 * F.col("most")))
        cells = shared_table(again.unionByName(cells.join(short, "path", "left_anti")))
        listed = shared_table(_listed(cells.join(short, "path"), seed).unionByName(listed.join(short, "path", "left_anti")))
    # Rank by distance, then cell, then order of choice: offsets by counts of each distance, then of each cell.
    in_cell = listed.groupBy(g, "gap", "path").agg(F.count(F.lit(1)).alias("_k"))
    before = Window.partitionBy("_g", "gap").orderBy("path").rowsBetween(Window.unboundedPreceding, -1)
    offsets = _beside(in_cell.withColumn("_before", F.coalesce(F.sum("_k").over(before), F.lit(0))), sums.select("_g", "gap", (F.col("n_upto") - F.col("n")).alias("_above"), "_keep"), ["_g", "gap"])
    inside = F.row_number().over(Window.partitionBy("path", "gap").orderBy("no"))
    ranked = _beside(listed.withColumns({"_in": inside, "_g": g}), offsets.drop("_k"), ["_g", "gap", "path"])
    ranked = ranked.withColumn("rank", (F.col("_above") + F.col("_before") + F.col("_in") - 1).cast("int")).where(F.col("rank") < F.col("_keep"))
    return ranked.select(F.col("own.g").alias(group), F.col("own.k").alias(key), "feature", "rank")
