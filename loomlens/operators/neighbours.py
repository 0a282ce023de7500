"""Exact nearest-neighbour distances by Voronoi cells and the triangle inequality.

Groups whose queries and bank fit a task are compared as they are. Else a group's bank is dealt to the Voronoi cells of
pivots drawn from it. A query first meets the bank rows of its own cell; that bounds its k-th distance, and only cells that
may hold something nearer are met then. With p the query's nearest pivot and q that of another cell of radius R, no row of
the cell is nearer than d(x, q) - R, nor nearer than (d(x, q)^2 - d(x, p)^2) / (2 d(p, q)), the way to the plane between them.

Queries travel to cells; a cell's bank rows are sent once for each block of queries that need it. Cells or blocks of more than `rows` rows are split,
so a task compares at most about rows x rows pairs at a time, by matrix products, and computes the distances of the nearest few anew from differences.

Neighbours by buckets (`knn_marked`) are those of one mark in common. Buckets that fit a task are compared as they are. Where all buckets of a
group hold as many pairs as the group, or it fits a task, the group is compared once and the marks of the nearest are checked, so its rows travel
once, not once for each mark. Large buckets and groups are packed to blocks, and every block of queries meets every block of the bank by a
cartesian join of partitions: the pairs grow with the square, what is shuffled and written with the rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomlens.operators.graph import shared_table

#: Pivots of a group at most: what a task holds of them is bounded, larger groups have larger cells, which are split.
PIVOTS = 1024


def matrix(table: pa.Table, column: str) -> np.ndarray:
    values = table.column(column).combine_chunks()
    return values.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(table.num_rows, -1)


def nearest(x: np.ndarray, y: np.ndarray, most: int, spare: int = 2) -> np.ndarray:
    """The `most` smallest distances of each row of x to the rows of y (infinity where y has fewer)."""
    about = (y * y).sum(axis=1) - 2 * (x @ y.T)  # the squared distance less |x|^2, which orders alike
    few = min(len(y), most + spare)
    near = np.argpartition(about, few - 1, axis=1)[:, :few] if few < len(y) else np.broadcast_to(np.arange(len(y)), about.shape)
    exact = np.sqrt(((y[near] - x[:, None, :]) ** 2).sum(axis=2)) if len(y) else np.zeros((len(x), 0))
    padded = np.concatenate([exact, np.full((len(x), most), np.inf)], axis=1)
    return np.sort(padded, axis=1)[:, :most]


def gaps(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances of all rows of x to all rows of y; exact to some 1e-7 of their lengths, which `slack` covers."""
    return np.sqrt(np.maximum(0, (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None, :] - 2 * (x @ y.T)))


def _best(x: np.ndarray, right: pa.Table, most: int) -> np.ndarray:
    best = np.full((len(x), most), np.inf)
    for at in range(0, right.num_rows, 4096):
        y = matrix(right.slice(at, 4096), "_vector")
        for row in range(0, len(x), 1024):
            d = nearest(x[row : row + 1024], y, most)
            best[row : row + 1024] = np.sort(np.concatenate([best[row : row + 1024], d], axis=1), axis=1)[:, :most]
    return best


def _same(left: DataFrame, right: DataFrame, names: Sequence[str]) -> Column:
    on = F.lit(True)
    for n in names:
        on = on & F.col(n).eqNullSafe(F.col(f"_r{n}"))
    return on


def _beside(rows: DataFrame, other: DataFrame, names: Sequence[str], how: str = "inner") -> DataFrame:
    """rows with the other columns of a table with one row per names (null is a name like any other)."""
    renamed = other.withColumnsRenamed({n: f"_r{n}" for n in names})
    return rows.join(renamed, _same(rows, renamed, names), how).drop(*[f"_r{n}" for n in names])


def _every(n: str) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col(n), F.lit(1)).cast("long") - 1))


def _compared(queries: DataFrame, bank: DataFrame, keys: Sequence[str], key: str, most: int, rows: int | None) -> DataFrame:
    """(keys, key, _near, _met): the smallest distances of each query to the bank rows with its keys, and how many it met.

    queries: (keys, key, feature); bank: (keys, _vector, _dealt). With rows, keys of more are dealt to blocks and pieces.
    """
    kinds = {f.name: f.dataType.simpleString() for f in queries.schema}
    by, own = list(keys), [f"_b{n}" for n in keys]
    if rows is not None:
        count = lambda df, n: df.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / rows).alias(n))
        blocks, pieces = count(queries, "_blocks"), count(bank, "_pieces")
        queries = _beside(_beside(queries, blocks, by), pieces, by, "left").withColumn("_block", F.pmod(F.xxhash64(key), F.col("_blocks"))).withColumn("_piece", _every("_pieces")).drop("_blocks", "_pieces")
        bank = _beside(_beside(bank, blocks, by), pieces, by).withColumn("_piece", F.pmod(F.xxhash64("_dealt"), F.col("_pieces"))).withColumn("_block", _every("_blocks")).drop("_blocks", "_pieces")
        by, own = [*by, "_block", "_piece"], [*own, "_bblock", "_bpiece"]
    bank = bank.select(*[F.col(n).alias(o) for n, o in zip(by, own, strict=True)], "_vector")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        best = _best(matrix(left, "feature"), right, most) if left.num_rows else np.zeros((0, most))
        return pa.table({n: left.column(n) for n in dict.fromkeys([*keys, key])} | {"_near": pa.array(list(best), pa.list_(pa.float64())), "_met": pa.array(np.full(left.num_rows, right.num_rows), pa.int64())})

    schema = ", ".join(f"{n} {kinds[n]}" for n in dict.fromkeys([*keys, key]))
    return queries.groupBy(*by).cogroup(bank.groupBy(*own)).applyInArrow(run, f"{schema}, _near array<double>, _met long")


def _placed(rows: DataFrame, pivots: DataFrame, group: str, block: int, columns: str, place) -> DataFrame:
    """rows dealt to blocks that meet all pivots of their group: place(rows, pivots) for each."""
    counts = rows.groupBy(group).agg(F.ceil(F.count(F.lit(1)) / block).alias("_blocks"))
    dealt = _beside(rows, counts, [group]).withColumn("_block", F.pmod(F.xxhash64("_dealt"), F.col("_blocks"))).drop("_blocks")
    met = _beside(pivots, counts, [group]).withColumn("_at", _every("_blocks")).drop("_blocks").withColumnRenamed(group, "_of")
    return dealt.groupBy(group, "_block").cogroup(met.groupBy("_of", "_at")).applyInArrow(place, columns)


def _cells(rows: DataFrame, pivots: DataFrame, group: str, block: int) -> DataFrame:
    """(group, _cell, _vector, _dealt, _gap) of bank rows: their nearest pivot and the distance to it."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def place(left: pa.Table, right: pa.Table) -> pa.Table:
        d = gaps(matrix(left, "_vector"), matrix(right.sort_by("_cell"), "_pivot")) if left.num_rows else np.zeros((0, 1))
        cell = d.argmin(axis=1)
        return left.select([group, "_vector", "_dealt"]).append_column("_cell", pa.array(cell, pa.int64())).append_column("_gap", pa.array(d[np.arange(len(d)), cell], pa.float64()))

    return _placed(rows, pivots, group, block, f"{group} {kinds[group]}, _vector {kinds['_vector']}, _dealt {kinds['_dealt']}, _cell long, _gap double", place)


def reachable(d: np.ndarray, pivots: np.ndarray, radius: np.ndarray, slack: float) -> tuple[np.ndarray, np.ndarray]:
    """(home, bound) of rows x pivots of distances: the nearest pivot, and no row of a cell is nearer than its bound."""
    rows = np.arange(len(d))
    home = d.argmin(axis=1)
    own = d[rows, home]
    between = gaps(pivots, pivots)[home]
    plane = np.divide(d**2 - own[:, None] ** 2, 2 * between, out=np.zeros_like(d), where=between > slack)
    return home, np.maximum(0, np.maximum(d - radius[None, :], plane) - slack)


def _homes(rows: DataFrame, pivots: DataFrame, group: str, key: str, block: int) -> DataFrame:
    """(group, key, feature, _cell, _others) of queries: the cell of the nearest pivot, and each other with its bound."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    names = list(dict.fromkeys([group, key, "feature"]))

    def place(left: pa.Table, right: pa.Table) -> pa.Table:
        home, lists, flat, bounds = np.zeros(left.num_rows, np.int64), np.zeros(left.num_rows + 1, np.int32), np.zeros(0, np.int32), np.zeros(0)
        if left.num_rows and right.num_rows:
            x, right = matrix(left, "feature"), right.sort_by("_cell")
            p, radius = matrix(right, "_pivot"), right.column("_radius").to_numpy()
            slack = 1e-6 * (1 + max(np.abs(x).max(initial=0), np.abs(p).max(initial=0)) * x.shape[1] ** 0.5)
            home, bound = reachable(gaps(x, p), p, radius, slack)
            there = np.isfinite(radius)[None, :] & (np.arange(len(p))[None, :] != home[:, None])
            flat, bounds, lists = np.nonzero(there)[1], bound[there], np.concatenate([[0], np.cumsum(there.sum(axis=1))])
        others = pa.StructArray.from_arrays([pa.array(flat, pa.int32()), pa.array(bounds, pa.float64())], ["cell", "bound"])
        return left.select(names).append_column("_cell", pa.array(home, pa.int64())).append_column("_others", pa.ListArray.from_arrays(pa.array(lists, pa.int32()), others))

    return _placed(rows, pivots, group, block, ", ".join(f"{n} {kinds[n]}" for n in names) + ", _cell long, _others array<struct<cell: int, bound: double>>", place)


def knn_distances(queries: DataFrame, bank: DataFrame, k: Sequence[int] = (1,), group: str = "category", key: str = "patch_id", rows: int = 4096, compared: bool = False) -> DataFrame:
    """(group, key, d_k for each k): mean of the k smallest Euclidean distances to the group's bank; with compared also
    n_compared, the bank rows that the query was compared with.

    key is unique in queries. Fewer than k bank rows give the mean over those; a group without a bank gives null.
    Null is a group like any other. `rows` bounds what a task compares at a time, and sets the number of cells.
    """
    most = max(k)
    q = queries.select(*dict.fromkeys([group, key, "feature"]))
    # Names of their own: queries and bank may come from one table.
    b = bank.select(F.col(group).alias("_bank"), F.col("feature").alias("_vector"), F.col(key if key in bank.columns else "feature").alias("_dealt"))
    b = b.select(F.col("_bank").alias(group), "_vector", "_dealt")
    count = lambda df: df.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    largest = count(q).select("n").unionAll(count(b).select("n")).agg(F.max("n")).first()[0] or 0
    if largest <= rows:
        found = _compared(q, b, [group], key, most, None)
    else:
        found = _by_cells(q, b, group, key, most, rows)
    near = F.slice(F.sort_array(F.flatten(F.collect_list(F.filter("_near", lambda d: d < float("inf"))))), 1, most)
    merged = found.groupBy(*dict.fromkeys([group, key])).agg(near.alias("_near"), F.sum("_met").alias("n_compared"))
    mean = lambda n: F.when(F.size("_near") > 0, F.aggregate(F.slice("_near", 1, n), F.lit(0.0), lambda x, d: x + d) / F.least(F.lit(n), F.size("_near")))
    return merged.select(*dict.fromkeys([group, key]), *[mean(n).alias(f"d{n}") for n in k], *["n_compared"] * compared)


def _by_cells(q: DataFrame, b: DataFrame, group: str, key: str, most: int, rows: int) -> DataFrame:
    sizes = b.groupBy(group).agg(F.least(F.lit(PIVOTS).cast("long"), F.ceil(F.count(F.lit(1)) / rows)).alias("_n"))
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.xxhash64("_dealt", "_vector")))
    pivots = _beside(b.withColumn("_cell", (rank - 1).cast("long")).where(F.col("_cell") < PIVOTS), sizes, [group]).where(F.col("_cell") < F.col("_n"))
    pivots = shared_table(pivots.select(group, "_cell", F.col("_vector").alias("_pivot")))
    held = shared_table(_cells(b, pivots, group, rows))
    stats = shared_table(held.groupBy(group, "_cell").agg(F.max("_gap").alias("_radius")))
    # A cell without rows (of equal pivots the first takes all) holds nothing to meet.
    around = _beside(pivots, stats, [group, "_cell"], "left").withColumn("_radius", F.coalesce("_radius", F.lit(float("inf"))))
    asked = shared_table(_homes(q.withColumn("_dealt", F.col(key)), around, group, key, rows))
    names = list(dict.fromkeys([group, key]))
    homes = _compared(asked.select(*dict.fromkeys([group, "_cell", key, "feature"])), held, [group, "_cell"], key, most, rows)
    near = F.slice(F.sort_array(F.flatten(F.collect_list("_near"))), 1, most)
    first = shared_table(homes.groupBy(*names).agg(near.alias("_near"), F.sum("_met").alias("_met")))
    reach = F.element_at("_near", most)
    wanted = _beside(asked.drop("_cell"), first, names).withColumn("_cell", F.explode(F.filter("_others", lambda o: o["bound"] <= reach)["cell"]))
    wanted = wanted.withColumn("_cell", F.col("_cell").cast("long")).select(*dict.fromkeys([group, "_cell", key, "feature"]))
    others = _compared(wanted, held, [group, "_cell"], key, most, rows)
    return first.unionByName(others.select(*names, "_near", "_met"))


def nearest_marked(x: np.ndarray, x_marks: np.ndarray, y: np.ndarray, y_marks: np.ndarray, spare: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """For each row of x the smallest distance to the rows of y that share a mark with it (infinity: none), and to all of them."""
    about = (y * y).sum(axis=1) - 2 * (x @ y.T)
    rows, few = np.arange(len(x)), min(len(y), 1 + spare)
    take = lambda a: np.argpartition(a, few - 1, axis=1)[:, :few]
    exact = lambda x, near: np.sqrt(((y[near] - x[:, None, :]) ** 2).sum(axis=2))
    near = take(about)
    d = exact(x, near)
    first = d.argmin(axis=1)
    free = d[rows, first]
    shared, left = free.copy(), np.flatnonzero(~(x_marks == y_marks[near[rows, first]]).any(axis=1))
    if len(left):
        fits = np.zeros((len(left), len(y)), bool)
        for t in range(x_marks.shape[1]):
            fits |= x_marks[left, t][:, None] == y_marks[None, :, t]
        near = take(np.where(fits, about[left], np.inf))
        shared[left] = np.where(np.take_along_axis(fits, near, axis=1), exact(x[left], near), np.inf).min(axis=1)
    return shared, free


def _best_marked(x: np.ndarray, x_marks: np.ndarray, y: np.ndarray, y_marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    best = np.full((2, len(x)), np.inf)
    for at in range(0, len(y), 4096):
        for row in range(0, len(x), 1024):
            here, there = slice(row, row + 1024), slice(at, at + 4096)
            best[:, here] = np.minimum(best[:, here], nearest_marked(x[here], x_marks[here], y[there], y_marks[there]))
    return best[0], best[1]


_BUCKET = ["_group", "_table", "_mark"]


def _bucketed(rows: DataFrame, whole: DataFrame) -> DataFrame:
    """rows (_group, _marks, ...) once for each of their marks as _table and _mark; those of a group in `whole` once, with table -1."""
    one = F.array(F.struct(F.lit(-1).alias("_table"), F.lit(0.0).alias("_mark")))
    each = F.transform("_marks", lambda m, i: F.struct(i.alias("_table"), m.alias("_mark")))
    held = _beside(rows, whole, ["_group"], "left").withColumn("_b", F.explode(F.when(F.col("_whole"), one).otherwise(each)))
    return held.select(*rows.columns, "_b._table", "_b._mark")


def _cogrouped(left: DataFrame, right: DataFrame, kind: str) -> DataFrame:
    """(_key, _shared, _free) of buckets that fit a task."""
    own = [f"_r{n}" for n in _BUCKET]
    right = right.select(*[F.col(n).alias(o) for n, o in zip(_BUCKET, own, strict=True)], "_vector", "_marks")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left if right.num_rows else left.slice(0, 0)
        found = _best_marked(*[matrix(t, c) for t in (left, right) for c in ("_vector", "_marks")]) if left.num_rows else [np.zeros(0)] * 2
        return pa.table({"_key": left.column("_key"), "_shared": found[0], "_free": found[1]})

    return left.select(*_BUCKET, "_key", "_vector", "_marks").groupBy(*_BUCKET).cogroup(right.groupBy(*own)).applyInArrow(run, f"_key {kind}, _shared double, _free double")


def _crossed(left: DataFrame, right: DataFrame, parts: tuple[int, int], kind: str) -> DataFrame:
    """(_key, _shared, _free) of blocks (bucket, rows) of both sides: each partition of one meets each of the other, where buckets are equal."""
    left, right = left.repartition(parts[0]), right.withColumnsRenamed({n: f"_r{n}" for n in _BUCKET} | {"_rows": "_others"}).repartition(parts[1])
    pairs = left.join(right.hint("shuffle_replicate_nl"), _same(left, right, _BUCKET)).select("_rows", "_others")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                sides = [pa.Table.from_batches([pa.RecordBatch.from_struct_array(batch.column(c)[i].values)]) for c in ("_rows", "_others")]
                found = _best_marked(*[matrix(t, c) for t in sides for c in ("_vector", "_marks")])
                yield pa.RecordBatch.from_arrays([sides[0].column("_key").combine_chunks(), *map(pa.array, found)], ["_key", "_shared", "_free"])

    return pairs.mapInArrow(run, f"_key {kind}, _shared double, _free double")


def knn_marked(queries: DataFrame, bank: DataFrame, group: str = "category", key: str = "patch_id", marks: str = "marks", rows: int = 4096) -> tuple[DataFrame, DataFrame]:
    """((key, d1), groups): the distance to the nearest bank row of the group with which the query shares a mark, and the groups (a column
    named as `group`) compared as a whole, where queries without a shared mark have the distance to the nearest of all; in others they have no row.

    marks holds equally many numbers in all rows; one is shared that both have in the same place. Null is a group like any other, key is
    unique in queries. Read queries and bank from tables: they are gone through several times.
    """
    kind = queries.schema[key].dataType.simpleString()
    shaped = lambda df, id: df.select(F.col(group).alias("_group"), F.col(marks).alias("_marks"), id.alias("_key"), F.col("feature").alias("_vector"))
    q, b = shaped(queries, F.col(key)), shaped(bank, F.xxhash64(key, "feature"))
    each = lambda df, n, m: df.select("_group", F.posexplode("_marks").alias("_table", "_mark"), F.lit(n).alias("_q"), F.lit(m).alias("_b"))
    counts = shared_table(each(q, 1, 0).unionByName(each(b, 0, 1)).groupBy(*_BUCKET).agg(F.sum("_q").alias("_q"), F.sum("_b").alias("_b")))
    all_of = lambda n: F.sum(F.when(F.col("_table") == 0, F.col(n)).otherwise(0)).alias(n)
    pairs, large = F.col("_q") * F.col("_b"), F.greatest("_q", "_b") > rows
    whole = counts.groupBy("_group").agg(all_of("_q"), all_of("_b"), F.sum(pairs).alias("_pairs"))
    whole = shared_table(whole.where((pairs > 0) & (~large | (F.col("_pairs") >= pairs))).select("_group", "_q", "_b", F.lit(True).alias("_whole")))
    names = whole.select("_group", "_whole")
    apart = _beside(counts, names, ["_group"], "left").where(F.col("_whole").isNull() & (pairs > 0)).select(*_BUCKET, "_q", "_b")
    sizes = shared_table(whole.select("_group", F.lit(-1).alias("_table"), F.lit(0.0).alias("_mark"), "_q", "_b").unionByName(apart))
    q, b = _bucketed(q, names), _bucketed(b, names)
    small = sizes.where(~large).select(*_BUCKET)
    found = _cogrouped(_beside(q, small, _BUCKET), _beside(b, small, _BUCKET), kind)
    blocks = [F.ceil(F.col(n) / rows) for n in ("_q", "_b")]
    n_left, n_right = sizes.where(large).agg(*[F.sum(n) for n in blocks]).first()
    if n_left:
        packed = lambda df, n: _beside(df, sizes.where(large).select(*_BUCKET, n.alias("_blocks")), _BUCKET).withColumn("_block", F.pmod(F.xxhash64("_key"), F.col("_blocks"))).groupBy(*_BUCKET, "_block").agg(F.collect_list(F.struct("_key", "_vector", "_marks")).alias("_rows")).drop("_block")
        # Tasks of some 8 x 32 blocks, in smaller jobs as many as there are cores.
        parts = max(-(-n_left // 8), min(n_left, q.sparkSession.sparkContext.defaultParallelism)), -(-n_right // 32)
        found = found.unionByName(_crossed(packed(q, blocks[0]), packed(b, blocks[1]), parts, kind))
    best = found.groupBy(F.col("_key").alias(key)).agg(F.min("_shared").alias("_shared"), F.min("_free").alias("_free"))
    return best.select(key, F.when(F.col("_shared") < float("inf"), F.col("_shared")).otherwise(F.col("_free")).alias("d1")), names.select(F.col("_group").alias(group))
