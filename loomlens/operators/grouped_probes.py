"""Linear probes of all groups in one job: categories, outer folds and inner folds are keys, not loops.

Rows are packed to blocks of a group once. A group of one block (16384 rows at most) is minimised where it lies. For all larger groups each round joins the blocks with their group's parameters, adds up losses and gradients per group with
map-side sums, and takes one quasi-Newton step for every group in parallel: limited-memory updates on top of the curvature bound
(X'WX / 2 + penalty), whose sums per group are taken in the first round. A step that raises a group's loss is halved. What goes to the
driver is only whether groups are left. The minimum is that of multinomial logistic regression with a penalised slope.

A calibrated probe is, as in deployment, a member per inner fold with calibrators fitted on the fold that it hasn't seen; a row's
probabilities are the mean over members. Calibrators are sigmoids of the probability, against targets drawn in by the class counts
(Platt, 1999), so they are finite on separable rows too.

Rows of equal features, class and fold are counted before any fit and stand there once, with their number as weight, which leaves every sum as
it is. Folds and inner folds both follow from a row's number in its class, so rows are dealt once, whatever the number of models.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomlens.operators.graph import shared_table
from loomlens.operators.ranking import hash_numbered, hash_offsets

BLOCK, MEMORY = 16384, 12
_STATE = "model string, reg double, mean array<double>, scale array<double>, classes int, present array<double>, at array<double>, trial array<double>, loss double, slope array<double>, moves array<double>, turns array<double>, metric array<double>, left boolean"
_PROBE = "struct<coef: array<double>, mean: array<double>, scale: array<double>, classes: int, present: array<double>, a: array<double>, b: array<double>>"


def _model(by: Sequence[str]) -> Column:
    """One string for the values of the keys; null is a value."""
    return F.to_json(F.array(*[F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("null")) for c in by])).alias("model")


def _blocks(rows: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """(model, rows: array of structs of columns, blocks: of the model) of about BLOCK rows each."""
    counts = rows.groupBy(F.col("model").alias("_m")).agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    dealt = rows.join(counts, F.col("model") == F.col("_m")).withColumn("_block", F.pmod(F.xxhash64(key), F.col("blocks")))
    return dealt.groupBy("model", "blocks", "_block").agg(F.collect_list(F.struct(*columns)).alias("rows")).drop("_block")


def _matrix(values: pa.Array) -> np.ndarray:
    return values.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(values), -1)


def _design(x: np.ndarray, mean: Sequence[float], scale: Sequence[float]) -> np.ndarray:
    """Standardised features and a column of ones; a feature that doesn't vary is 0."""
    scale = np.asarray(scale, float)
    z = np.divide(x - np.asarray(mean, float), scale, out=np.zeros_like(x), where=scale > 0)
    return np.concatenate([z, np.ones((len(x), 1))], axis=1)


def _softmax(z: np.ndarray, coef: np.ndarray, present: np.ndarray) -> np.ndarray:
    logits = np.where(present[None, :], z @ coef.T, -np.inf)
    e = np.exp(logits - logits.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _parts(rows: pa.Scalar, s: dict) -> np.ndarray:
    """Loss, weight and gradient of a block's rows at the trial; without a metric yet also X'WX."""
    rows = rows.values
    z, target, w = _design(_matrix(rows.field("features")), s["mean"], s["scale"]), _matrix(rows.field("target")), rows.field("weight").to_numpy(zero_copy_only=False)
    return _evaluated(z, target, w, s)


def _evaluated(z: np.ndarray, target: np.ndarray, w: np.ndarray, s: dict) -> np.ndarray:
    p = _softmax(z, np.asarray(s["trial"]).reshape(s["classes"], -1), np.asarray(s["present"]) > 0)
    loss = -(w[:, None] * target * np.log(np.where(target > 0, np.maximum(p, 1e-300), 1.0))).sum()
    return np.concatenate([[loss, w.sum()], ((w[:, None] * (p - target)).T @ z).ravel()] + [((w[:, None] * z).T @ z).ravel()] * (s["metric"] is None))


def _sums(blocks: DataFrame, state: DataFrame) -> DataFrame:
    """(model, sums): loss, weight and gradient of the trial over all blocks, in the first round also X'WX."""
    columns = ["mean", "scale", "classes", "present", "trial", "metric"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            states = batch.select(columns).to_pylist()
            out = [_parts(rows, s) for rows, s in zip(batch.column("rows"), states, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("model"), pa.array(out, pa.list_(pa.float64()))], ["model", "sums"])

    found = blocks.join(state.select("model", *columns), "model").mapInArrow(run, "model string, sums array<double>")
    return found.groupBy("model").agg(vector_to_array(Summarizer.sum(array_to_vector("sums"))).alias("sums"))


def _advance(s: dict, sums: np.ndarray, tolerance: float) -> dict:
    """The state after the trial's loss and gradient are known: a new trial, or the end."""
    k, p = s["classes"], len(s["trial"])
    loss, total, grad = sums[0], sums[1], sums[2 : 2 + p].copy()
    trial, reg = np.array(s["trial"]), s["reg"]
    wide = p // k
    penalty = trial.reshape(k, wide).copy()
    penalty[:, -1] = 0
    loss, grad = loss / total + reg / 2 * (penalty**2).sum(), grad / total + reg * penalty.ravel()
    if s["metric"] is None:
        bound = sums[2 + p :].reshape(wide, wide) / total / 2
        bound[np.arange(wide - 1), np.arange(wide - 1)] += reg
        s["metric"] = np.linalg.pinv(bound + 1e-12 * np.eye(wide)).ravel()
    moves, turns = (np.array(s[c]).reshape(-1, p) for c in ("moves", "turns"))
    if s["loss"] is not None and loss > s["loss"] + 1e-14 * abs(s["loss"]):
        trial = (np.array(s["at"]) + trial) / 2
        return s | {"trial": trial, "left": bool(np.abs(trial - np.array(s["at"])).max() > 1e-13)}
    if s["loss"] is not None:
        move, turn = trial - np.array(s["at"]), grad - np.array(s["slope"])
        if move @ turn > 1e-300:
            moves, turns = np.concatenate([moves, [move]])[-MEMORY:], np.concatenate([turns, [turn]])[-MEMORY:]
    q, alphas = grad.copy(), []
    for m, t in zip(moves[::-1], turns[::-1], strict=True):
        alphas.append((m @ q) / (m @ t))
        q -= alphas[-1] * t
    step = (q.reshape(k, wide) @ np.asarray(s["metric"]).reshape(wide, wide)).ravel()
    for m, t, a in zip(moves, turns, alphas[::-1], strict=True):
        step += m * (a - (t @ step) / (m @ t))
    done = bool(np.abs(grad).max(initial=0) < tolerance)
    return s | {"at": trial, "loss": float(loss), "slope": grad, "moves": moves.ravel(), "turns": turns.ravel(), "trial": trial if done else trial - step, "left": not done}


def _minimised(rows: DataFrame, key: str, reg: DataFrame, max_iter: int, tolerance: float) -> DataFrame:
    """(model, probe) of rows (model, key, features, target, weight, n) and penalties (model, reg); a row stands for n equal ones."""
    vec, total, squares = array_to_vector(F.col("features").cast("array<double>")), F.sum("n"), F.sum(F.col("n").cast("double") * F.col("n"))
    facts = Summarizer.metrics("mean", "variance", "min", "max").summary(vec, F.col("n").cast("double"))
    held = rows.groupBy("model").agg(facts.alias("s"), total.alias("_all"), squares.alias("_squares"), F.max(F.size("target")).alias("classes"), vector_to_array(Summarizer.sum(array_to_vector("target"))).alias("present"))
    # The deviation of all rows, n of each: the summarizer takes the weights for other than counts. A feature that doesn't vary has 0.
    factor = F.when(F.col("_all") > 1, (F.col("_all") - F.col("_squares") / F.col("_all")) / (F.col("_all") - 1)).otherwise(F.lit(0.0))
    ends = F.arrays_zip(vector_to_array("s.variance").alias("v"), vector_to_array("s.min").alias("lo"), vector_to_array("s.max").alias("hi"))
    scale = F.transform(ends, lambda e: F.when(e["lo"] == e["hi"], F.lit(0.0)).otherwise(F.sqrt(e["v"] * F.col("_factor"))))
    held = held.withColumn("_factor", factor).select("model", "classes", "present", vector_to_array("s.mean").alias("mean"), scale.alias("scale"))
    rows = rows.withColumn("weight", F.col("weight") * F.col("n"))
    none, zeros = F.lit(None).cast("array<double>"), F.array_repeat(F.lit(0.0), F.col("classes") * (F.size("mean") + 1))
    state = held.join(reg, "model").select("model", "reg", "mean", "scale", "classes", "present")
    state = state.select("*", zeros.alias("at"), zeros.alias("trial"), F.lit(None).cast("double").alias("loss"), none.alias("slope"), F.array().cast("array<double>").alias("moves"), F.array().cast("array<double>").alias("turns"), none.alias("metric"), F.lit(True).alias("left"))
    state, blocks = shared_table(state), shared_table(_blocks(rows, key, ["features", "target", "weight"]))
    names = [c.split()[0] for c in _STATE.split(", ")]
    listed = lambda r: {c: v.tolist() if isinstance(v, np.ndarray) else v for c, v in r.items()}

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for rows, s in zip(batch.column("rows"), batch.select(names).to_pylist(), strict=True):
                z, target, w = _design(_matrix(rows.values.field("features")), s["mean"], s["scale"]), _matrix(rows.values.field("target")), rows.values.field("weight").to_numpy(zero_copy_only=False)
                for _ in range(max_iter):
                    s = _advance(s, _evaluated(z, target, w, s), tolerance)
                    if not s["left"]:
                        break
                out.append(listed(s))
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([batch.schema.field(c) for c in names]))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [listed(_advance({c: r[c] for c in names}, np.array(r["sums"]), tolerance)) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([batch.schema.field(c) for c in names]))

    done = shared_table(blocks.where("blocks = 1").drop("blocks").join(state, "model").mapInArrow(whole, _STATE))
    blocks = blocks.where("blocks > 1").drop("blocks")
    state = shared_table(state.join(blocks.select("model").distinct(), "model", "left_semi"))
    for _ in range(max_iter):
        if not state.limit(1).count():
            break
        state = shared_table(state.join(_sums(blocks, state), "model").mapInArrow(step, _STATE))
        done, state = done.unionByName(state.where("not left")), state.where("left")
    probe = F.struct(F.col("at").alias("coef"), "mean", "scale", "classes", "present", F.lit(None).cast("array<double>").alias("a"), F.lit(None).cast("array<double>").alias("b"))
    return shared_table(done.unionByName(state).select("model", probe.cast(_PROBE).alias("probe")))


def fit_probes(rows: DataFrame, by: Sequence[str], classes: int, *, key: str = "id", c: float = 1.0, max_iter: int = 300, tolerance: float = 1e-9, n: str | None = None) -> DataFrame:
    """(model, probe): for each value of the keys `by` multinomial logistic regression on rows (by, key, features, y) with balanced weights
    and an L2 penalty of 1 / (c n); features are standardised by the model's own rows. Classes that a model's rows lack get 0. A column n
    says for how many equal rows a row stands."""
    if n is None:
        rows = rows.select(_model(by), key, "features", "y", F.lit(1).cast("long").alias("n"))
    else:
        rows, key = shared_table(rows.groupBy(_model(by), "features", "y").agg(F.sum(n).alias("n"))), "features"
    counts = rows.groupBy("model", "y").agg(F.sum("n").alias("_n"))
    totals = counts.groupBy("model").agg(F.sum("_n").alias("_all"), F.count(F.lit(1)).alias("_k"))
    weights = counts.join(totals, "model").select("model", "y", (F.col("_all") / (F.col("_k") * F.col("_n"))).alias("weight"))
    target = F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda i: (i == F.col("y")).cast("double"))
    reg = totals.select("model", (1 / (c * F.col("_all"))).alias("reg"))
    weighted = rows.join(F.broadcast(weights), ["model", "y"]).withColumn("target", target)  # a row per model and class
    return _minimised(weighted.select(*dict.fromkeys(["model", key, "features", "target", "weight", "n"])), key, reg, max_iter, tolerance)


def probabilities(rows: DataFrame, probes: DataFrame, by: Sequence[str], key: str = "id") -> DataFrame:
    """rows (by, key, features, ...) with proba: of its model's probe, or the mean over them where it has several members. Rows of keys
    without a probe are left out. probes: (model, probe)."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    packed = _blocks(rows.withColumn("model", _model(by)), key, rows.columns).drop("blocks")
    members = probes.groupBy("model").agg(F.collect_list("probe").alias("members"))

    @F.arrow_udf("array<array<double>>")
    def score(blocks: pa.Array, members: pa.Array) -> pa.Array:
        out = []
        for i in range(len(blocks)):
            x, found = _matrix(blocks[i].values.field("features")), []
            for m in members[i].as_py():
                p = _softmax(_design(x, m["mean"], m["scale"]), np.array(m["coef"]).reshape(m["classes"], -1), np.array(m["present"]) > 0)
                if m["a"] is not None:
                    q = 1 / (1 + np.exp(-(p * np.array(m["a"]) + np.array(m["b"]))))
                    total = q.sum(axis=1, keepdims=True)
                    p = np.divide(q, total, out=np.full_like(q, 1 / q.shape[1]), where=total > 0)
                found.append(p)
            out.append(list(np.mean(found, axis=0)))
        return pa.array(out, pa.list_(pa.list_(pa.float64())))

    scored = packed.join(members, "model").select("rows", score("rows", "members").alias("_p"))
    zipped = scored.select(F.explode(F.arrays_zip("rows", "_p")).alias("r"))
    return zipped.select(*[F.col(f"r.rows.{c}").cast(kinds[c]).alias(c) for c in rows.columns], F.col("r._p").alias("proba"))


class GroupedProbes:
    """Probes (model, probe) of keys `by` as an estimator: transform gives rows with `features` and the keys their probabilities."""

    def __init__(self, probes: DataFrame, by: Sequence[str]):
        self.probes, self.by = probes, list(by)

    def transform(self, rows: DataFrame) -> DataFrame:
        deal = F.xxhash64(*[c for c in rows.columns if c != "features"])  # only deals rows to blocks
        return probabilities(rows.withColumn("_deal", deal), self.probes, self.by, "_deal").drop("_deal")


def _dealt(rows: DataFrame, by: Sequence[str], key: str, most: int, seed: int) -> DataFrame:
    """rows with _no (from 0, by seeded hash inside the class and keys), _folds and _within: the inner folds of what each fold leaves.
    Rows of keys whose smallest class has one row are left out."""
    offsets = hash_offsets(rows, [*by, "y"], key, seed)
    sizes = offsets.groupBy(*by, "y").agg(F.first("_all").alias("_n")).groupBy(F.struct(*by).alias("_of")).agg(F.collect_list("_n").alias("_ns"))
    sizes = sizes.withColumn("_folds", F.least(F.lit(most).cast("long"), F.array_min("_ns"))).where("_folds >= 2")
    within = F.expr(f"transform(sequence(0L, _folds - 1), o -> least({most}L, array_min(transform(_ns, n -> n - (n - o + _folds - 1) div _folds))))")
    offsets = offsets.withColumn("_of", F.struct(*by)).join(sizes.select("_of", "_folds", within.alias("_within")), "_of").drop("_of")
    return hash_numbered(rows, offsets, [*by, "y"], key, seed).withColumn("_no", F.col("_no") - 1)


def stratified(rows: DataFrame, by: Sequence[str], key: str = "id", most: int = 5, seed: int = 0, name: str = "fold") -> DataFrame:
    """rows with the fold of each: its number by seeded hash inside its class and keys, modulo the number of folds, min(most, rows of
    the smallest class); rows of keys whose smallest class has one row have none and are left out."""
    return _dealt(rows, by, key, most, seed).withColumn(name, (F.col("_no") % F.col("_folds")).cast("int")).drop("_no", "_folds", "_within")


#: A row's fold among the rows that each outer fold leaves, which are dealt by the same order; -1 for its own, and where those can't be dealt.
_INNERS = """transform(_within, (f, o) -> if(_no % _folds = o or f < 2, -1L,
    (_no - if(_no > o, (_no - o + _folds - 1) div _folds, 0L)) % f))"""


def _others(rows: DataFrame, fold: str, name: str) -> DataFrame:
    """Each row once for every other fold of its keys, which `name` holds: the rows that the fold's model may see."""
    return rows.withColumn(name, F.explode(F.array_except(F.col("_every"), F.array(fold))))


def _with_every(rows: DataFrame, by: Sequence[str], fold: str) -> DataFrame:
    every = rows.groupBy(_model(by)).agg(F.collect_set(fold).alias("_every")).withColumnRenamed("model", "_m")
    return rows.join(every, _model(by) == F.col("_m")).drop("_m")


def fit_calibrated(rows: DataFrame, by: Sequence[str], classes: int, *, key: str = "id", folds: int = 5, **options) -> DataFrame:
    """(model, probe): a member for each inner fold of the keys, fitted on the other folds, with its calibrators' a and b."""
    folded = stratified(rows.select(*by, key, "features", "y"), by, key, folds, name="_inner")
    return _members(shared_table(folded.groupBy(*by, "features", "y", "_inner").agg(F.count(F.lit(1)).alias("_count"))), by, classes, **options)


def _members(counted: DataFrame, by: Sequence[str], classes: int, **options) -> DataFrame:
    """As fit_calibrated, of rows (by, features, y, _inner, _count)."""
    inner = [*by, "_member"]
    folded = _with_every(counted, by, "_inner")
    probes = fit_probes(_others(folded, "_inner", "_member"), inner, classes, n="_count", **options)
    judged = shared_table(probabilities(counted.withColumn("_member", F.col("_inner")), probes, inner, "features"))
    one = judged.select(*inner, "y", "_count", F.posexplode("proba").alias("_class", "_x"))
    hits = lambda hit: F.sum(F.when(hit, F.col("_count")).otherwise(0))
    counts = one.groupBy(_model([*inner, "_class"])).agg(hits(F.col("y") == F.col("_class")).alias("_pos"), hits(F.col("y") != F.col("_class")).alias("_neg"))
    t = F.when(F.col("y") == F.col("_class"), (F.col("_pos") + 1) / (F.col("_pos") + 2)).otherwise(1 / (F.col("_neg") + 2))
    soft = one.withColumn("model", _model([*inner, "_class"])).join(F.broadcast(counts), "model").select("model", _model(inner).alias("_of"), "_class", F.array("_x").alias("features"), F.array(1 - t, t).alias("target"), F.lit(1.0).alias("weight"), F.col("_count").alias("n"))
    soft = shared_table(soft)
    free = soft.select("model").distinct().withColumn("reg", F.lit(0.0))
    sigmoids = _minimised(soft, "features", free, 200, 1e-9).join(soft.select("model", "_of", "_class").distinct(), "model")
    # Two classes of slope and intercept on the standardised probability, as one sigmoid of the probability itself.
    get = lambda i: F.element_at("probe.coef", i)
    scale = F.element_at("probe.scale", 1)
    slope = F.when(scale > 0, (get(3) - get(1)) / scale).otherwise(F.lit(0.0))
    line = F.struct("_class", slope.alias("a"), (get(4) - get(2) - slope * F.element_at("probe.mean", 1)).alias("b"))
    lines = sigmoids.groupBy("_of").agg(F.sort_array(F.collect_list(line)).alias("_l"))
    member = F.struct(*[F.col(f"probe.{c}").alias(c) for c in ("coef", "mean", "scale", "classes", "present")], F.col("_l.a").alias("a"), F.col("_l.b").alias("b")).cast(_PROBE)
    owners = judged.select(_model(inner).alias("_inner_model"), _model(by).alias("_owner")).distinct()
    found = probes.join(lines, F.col("model") == F.col("_of")).join(owners, F.col("model") == F.col("_inner_model"))
    return shared_table(found.select(F.col("_owner").alias("model"), member.alias("probe")))


def out_of_fold(rows: DataFrame, by: Sequence[str], classes: int, *, key: str = "id", folds: int = 5, calibrate: bool = True, **options) -> DataFrame:
    """rows (by, key, features, y) with fold and proba from the estimator fitted on the other folds of the keys: the raw probe, or the
    calibrated one with inner folds of its own. All keys and folds are fitted together. Rows of a fold with equal features are scored once."""
    outer, count = [*by, "_asked"], F.count(F.lit(1)).alias("_count")
    dealt = _dealt(rows.select(*by, key, "features", "y"), by, key, folds, 0)
    fold = (F.col("_no") % F.col("_folds")).cast("int").alias("fold")
    folded = shared_table(dealt.select(*by, key, "features", "y", fold, *[F.expr(_INNERS).cast("array<int>").alias("_inners")] * calibrate))
    if calibrate:
        counted = folded.groupBy(*by, "features", "y", "_inners").agg(count)
        counted = counted.select(*by, "features", "y", F.posexplode("_inners").alias("_asked", "_inner"), "_count").where("_inner >= 0")
        probes = _members(shared_table(counted.groupBy(*outer, "features", "y", "_inner").agg(F.sum("_count").alias("_count"))), outer, classes, **options)
    else:
        counted = shared_table(folded.groupBy(*by, "features", "y", "fold").agg(count))
        probes = fit_probes(_others(_with_every(counted, by, "fold"), "fold", "_asked"), outer, classes, n="_count", **options)
    folded = folded.drop("_inners").withColumn("_asked", F.col("fold"))
    scored = shared_table(probabilities(folded.select(*outer, "features").distinct(), probes, outer, "features"))
    scored = scored.select(F.struct(*outer).alias("_of"), F.col("features").alias("_x"), "proba")
    found = folded.withColumn("_g", F.struct(*outer)).join(scored, (F.col("_g") == F.col("_of")) & (F.col("features") == F.col("_x")))
    return found.drop("_g", "_of", "_x", "_asked")


def save_probes(probes: DataFrame, path: str, labels: Sequence[str], threshold: float | None = None) -> None:
    """Probes with members and calibrators, and a row of what belongs to them, under path."""
    probes.write.mode("overwrite").parquet(f"{path}/probes")
    settings = probes.sparkSession.createDataFrame([(list(labels), threshold)], "labels array<string>, threshold double")
    settings.write.mode("overwrite").parquet(f"{path}/settings")


def load_probes(spark, path: str) -> tuple[DataFrame, list[str], float | None]:
    """(probes, labels, threshold)."""
    row = spark.read.parquet(f"{path}/settings").first()
    return spark.read.parquet(f"{path}/probes"), row.labels, row.threshold
