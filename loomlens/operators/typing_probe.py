"""Naming defects: a linear probe on pooled features that may abstain."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from loomlens.operators.evaluate import stratified_folds
from loomlens.operators.graph import shared_table

UNKNOWN = "unknown"


def standardised(rows: DataFrame, keys: Sequence[str], channel: str = "channel", value: str = "value") -> DataFrame:
    """Per channel (value - mean) / population deviation; a deviation of 0 counts as 1."""
    stats = rows.groupBy(channel).agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"))
    scaled = (F.col(value) - F.col("_m")) / F.when(F.col("_s") == 0, F.lit(1.0)).otherwise(F.col("_s"))
    return rows.join(stats, channel).select(*keys, channel, scaled.alias(value))


def class_weights(rows: DataFrame, label: str = "y") -> DataFrame:
    """(label, n, weight): n / (classes * n of the class). One row per class, so the totals are broadcast."""
    counts = rows.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    totals = counts.agg(F.sum("n").alias("_all"), F.count(F.lit(1)).alias("_k"))
    return counts.join(F.broadcast(totals)).select(label, "n", (F.col("_all") / (F.col("_k") * F.col("n"))).alias("weight"))


def label_index(rows: DataFrame, label: str = "defect_type") -> DataFrame:
    """(label, y, n): indices in alphabetical order."""
    from pyspark.sql import Window

    return rows.groupBy(label).agg(F.count(F.lit(1)).alias("n")).withColumn("y", F.row_number().over(Window.orderBy(label)) - 1)


def train_probe(rows: DataFrame, c: float = 1.0, max_iter: int = 2000) -> PipelineModel:
    """Multinomial logistic regression on rows (features array, y) with balanced weights and an L2
    penalty of 1 / (c n). Features are standardised by the rows' own means and deviations. The fit sees
    equal rows once, with their number as weight."""
    scale = StandardScaler(inputCol="vec", outputCol="scaled", withMean=True, withStd=True).fit(_with_vec(rows.select("features")))
    counted = shared_table(rows.groupBy("features", "y").agg(F.count(F.lit(1)).alias("n")))
    per = counted.groupBy("y").agg(F.sum("n").alias("_own"))
    totals = per.agg(F.sum("_own").alias("_all"), F.count(F.lit(1)).alias("_k"))
    weights = per.join(F.broadcast(totals)).select("y", "_all", (F.col("_all") / (F.col("_k") * F.col("_own"))).alias("_each"))
    n = counted.agg(F.sum("n")).first()[0] or 0
    weighted = _with_vec(counted.join(F.broadcast(weights), "y").withColumn("weight", F.col("_each") * F.col("n")))  # a row per class
    fit = LogisticRegression(featuresCol="scaled", labelCol="y", weightCol="weight", family="multinomial", regParam=1.0 / (c * max(1, n)), maxIter=max_iter, standardization=False, probabilityCol="probability")
    return PipelineModel([scale, fit.fit(scale.transform(weighted))])


def _with_vec(rows: DataFrame) -> DataFrame:
    return rows.withColumn("vec", array_to_vector(F.col("features").cast("array<double>")))


def probabilities(model: PipelineModel, rows: DataFrame) -> DataFrame:
    scored = model.transform(_with_vec(rows))
    return scored.withColumn("proba", vector_to_array("probability")).drop("vec", "scaled", "rawPrediction", "probability", "prediction")


def inner_folds(rows: DataFrame, key: str = "id") -> DataFrame:
    """rows with fold for calibration: as many folds as rows of the smallest class, 2 to 5."""
    least = rows.groupBy("y").count().agg(F.min("count")).first()[0] or 0
    rows = rows.drop("fold")
    return stratified_folds(rows, key, "y") if least >= 2 else rows.withColumn("fold", F.pmod(F.xxhash64(F.col(key)), F.lit(2)).cast("int"))


class CalibratedProbe:
    """A probe per inner fold, fitted on the other folds, with calibrators fitted on the fold that it hasn't
    seen; a row's probabilities are the mean over them. So no calibrator sees rows that its probe was fitted on."""

    def __init__(self, rows: DataFrame, classes: int, method: str = "sigmoid", key: str = "id", **options):
        """rows: (key, features, y)."""
        self.classes, self.members = classes, []
        folded = shared_table(inner_folds(rows, key))
        for k in range(folded.agg(F.max("fold")).first()[0] + 1):
            probe = train_probe(folded.where(F.col("fold") != k), **options)
            judged = shared_table(probabilities(probe, folded.where(F.col("fold") == k)).select(key, "y", "proba"))
            self.members.append((probe, fit_calibrators(judged, classes, method)))

    def transform(self, rows: DataFrame) -> DataFrame:
        """rows with proba, the mean of the members'."""
        for i, (probe, calibrators) in enumerate(self.members):
            rows = apply_calibrators(calibrators, probabilities(probe, rows), self.classes).withColumnRenamed("proba", f"_proba{i}")
        n = len(self.members)
        mean = F.array(*[sum(F.col(f"_proba{i}")[k] for i in range(n)) / n for k in range(self.classes)])
        return rows.withColumn("proba", mean).drop(*[f"_proba{i}" for i in range(n)])


def out_of_fold(rows: DataFrame, folds: int, classes: int | None = None, method: str | None = None, **options) -> DataFrame:
    """rows (features, y, fold) with proba from the estimator fitted on the other folds: the raw probe, or with a
    method the calibrated one that deployment uses, with inner folds of its own (classes and a column id needed)."""
    out = None
    for k in range(folds):
        known, asked = rows.where(F.col("fold") != k), rows.where(F.col("fold") == k)
        part = probabilities(train_probe(known, **options), asked) if method is None else CalibratedProbe(known, classes, method, **options).transform(asked)
        out = part if out is None else out.unionByName(part)
    return out


def fit_calibrators(rows: DataFrame, classes: int, method: str = "sigmoid", n: str | None = None) -> list:
    """One calibrator per class, against the rest, of rows (y, proba): logistic regression on the probability
    (sigmoid) or isotonic regression. Equal rows are fitted once, with their number as weight; a column n says for how many a row stands."""
    from pyspark.ml.regression import IsotonicRegression

    found = []
    for k in range(classes):
        own = F.sum(F.lit(1.0) if n is None else F.col(n).cast("double")).alias("_w")
        one = rows.groupBy(F.col("proba")[k].alias("_x"), (F.col("y") == k).cast("double").alias("_t")).agg(own)
        if method == "isotonic":
            found.append(IsotonicRegression(featuresCol="_x", labelCol="_t", weightCol="_w", predictionCol=f"_c{k}").fit(one))
        else:
            found.append(LogisticRegression(featuresCol="_v", labelCol="_t", weightCol="_w", probabilityCol="_p", predictionCol="_d", rawPredictionCol="_r").fit(one.withColumn("_v", array_to_vector(F.array("_x")))))
    return found


def apply_calibrators(calibrators: Sequence, rows: DataFrame, classes: int) -> DataFrame:
    """rows with proba calibrated one class against the rest and renormalised; all zeros become even."""
    out = rows
    for k, model in enumerate(calibrators):
        one = out.withColumn("_x", F.col("proba")[k])
        if model.hasParam("isotonic"):
            out = model.transform(one).drop("_x")
        else:
            out = model.transform(one.withColumn("_v", array_to_vector(F.array("_x")))).withColumn(f"_c{k}", vector_to_array("_p")[1]).drop("_x", "_v", "_p", "_d", "_r")
    parts = [F.col(f"_c{k}") for k in range(classes)]
    total = sum(parts)
    even = F.array(*[F.lit(1.0 / classes)] * classes)
    return out.withColumn("proba", F.when(total > 0, F.transform(F.array(*parts), lambda p: p / total)).otherwise(even)).drop(*[f"_c{k}" for k in range(classes)])


def calibrated(rows: DataFrame, classes: int, method: str = "sigmoid", n: str | None = None) -> DataFrame:
    """rows (y, proba; n as in fit_calibrators) with proba calibrated. With a column fold, each fold by calibrators fitted on the others;
    without one, all rows by calibrators fitted on them: for deployment, not to be judged on the same rows."""
    if "fold" not in rows.columns:
        return apply_calibrators(fit_calibrators(rows, classes, method, n), rows, classes)
    out = None
    for k in range(rows.agg(F.max("fold")).first()[0] + 1):
        part = apply_calibrators(fit_calibrators(rows.where(F.col("fold") != k), classes, method, n), rows.where(F.col("fold") == k), classes)
        out = part if out is None else out.unionByName(part)
    return out


def save_probe(model: PipelineModel, path: str, labels: Sequence[str], threshold: float | None = None, calibrate: str | None = None) -> None:
    """The model, and a row of what belongs to it, under path."""
    model.write().overwrite().save(f"{path}/model")
    settings = SparkSession.active().createDataFrame([(list(labels), threshold, calibrate)], "labels array<string>, threshold double, calibrate string")
    settings.write.mode("overwrite").parquet(f"{path}/settings")


def load_probe(path: str) -> tuple[PipelineModel, Row]:
    """(model, row of labels, threshold and calibrate)."""
    return PipelineModel.load(f"{path}/model"), SparkSession.active().read.parquet(f"{path}/settings").first()


def predicted_type(proba: Column, labels: Sequence[str], threshold: Column | float | None = None) -> tuple[Column, Column]:
    """(type, confidence rounded half up to 2): the first largest class, 'unknown' below the threshold; a null
    threshold never abstains."""
    conf = F.array_max(proba)
    name = F.element_at(F.array(*[F.lit(x) for x in labels]), F.array_position(proba, conf).cast("int"))
    limit = threshold if isinstance(threshold, Column) else F.lit(threshold).cast("double")
    return F.when(conf < limit, F.lit(UNKNOWN)).otherwise(name), F.floor(conf * 100 + F.lit(0.5)) / 100
