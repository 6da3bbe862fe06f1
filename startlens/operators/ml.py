"""Outcome models (M1-M19): labels, split, features, four classifiers,
cross-validation, comparison, importance, batch prediction.

Everything trains with MLlib on DataFrames: each fit is a series of
distributed jobs (one per tree level / optimiser iteration), and the
feature encoders are fitted inside the pipeline on the training split only.
Row-level Python appears once: the random-Fourier-feature map of the kernel
SVM, a vectorised numpy matmul per Arrow batch.
"""

from __future__ import annotations

import math
import time
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import (
    GBTClassificationModel,
    GBTClassifier,
    LinearSVC,
    LinearSVCModel,
    LogisticRegression,
    LogisticRegressionModel,
    RandomForestClassificationModel,
    RandomForestClassifier,
)
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StandardScaler, StandardScalerModel, StringIndexer, VectorAssembler, VectorSlicer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from startlens.functions import params as P
from startlens.operators import metrics as MT
from startlens.session import in_scope, materialize

LABEL = "label"


# --- labels and split ------------------------------------------------------

def label_outcomes(df: DataFrame, include_operating: bool = False, status_col: str = "status") -> DataFrame:
    """M1: success 1 (acquired/ipo), 0 (closed), -1 otherwise; unknowns
    dropped unless ``include_operating``."""
    s = F.col(status_col)
    lab = F.when(s.isin(P.SUCCESS_STATUSES), 1).when(s.isin(P.FAILURE_STATUSES), 0).otherwise(-1)
    out = df.withColumn("success", lab)
    if not include_operating:
        out = out.where(F.col("success") != -1)
    return out.withColumn(LABEL, F.col("success").cast("double"))


def label_distribution(df: DataFrame, status_col: str = "status") -> DataFrame:
    """Companies per label (1/0/-1) and each label's share."""
    lab = label_outcomes(df, include_operating=True, status_col=status_col)
    total = lab.select(F.count(F.lit(1))).scalar()
    return lab.groupBy("success").agg(F.count(F.lit(1)).alias("companies")).withColumn("share", F.col("companies") / total)


def success_rate(df: DataFrame, status_col: str = "status") -> DataFrame:
    """Known outcomes, successes and the success rate among them (one row)."""
    lab = label_outcomes(df, include_operating=False, status_col=status_col)
    return lab.agg(
        F.count(F.lit(1)).alias("known_outcomes"),
        F.count_if(F.col("success") == 1).alias("successes"),
        F.avg(F.col("success").cast("double")).alias("success_rate"),
    )


def hash_unit(key: str | Column, salt: str) -> Column:
    """32 bits of md5(key:salt) as a number in [0, 1) (same in DuckDB)."""
    k = F.col(key) if isinstance(key, str) else key
    h = F.substring(F.md5(F.concat(k.cast("string"), F.lit(":"), F.lit(salt))), 1, 8)
    return F.conv(h, 16, 10).cast("double") / F.lit(float(2**32))


def split_column(key: str = "id", seed: int = 42, test_fraction: float = 0.2) -> Column:
    """M6: deterministic hash split; True for the test side.

    A row's side depends only on its key, so the split is reproducible,
    needs no shuffle and is stratified in expectation.
    """
    if not 0.0 <= test_fraction <= 1.0:
        raise ValueError(f"test_fraction must be within 0 and 1, not {test_fraction}")
    return hash_unit(key, str(seed)) < F.lit(float(test_fraction))


def proportional_allocation(class_counts: dict, n_draws: int) -> dict:
    """Split ``n_draws`` over classes in proportion to their counts: the
    floor of each share, then one more for the largest remainders (ties by
    class order; the common stratified-split rule breaks them at random)."""
    keys = sorted(class_counts)
    total = sum(class_counts.values())
    cont = {k: class_counts[k] / total * n_draws for k in keys}
    out = {k: math.floor(cont[k]) for k in keys}
    need = int(n_draws - sum(out.values()))
    for k in sorted(keys, key=lambda k: (-(cont[k] - out[k]), k))[:need]:
        out[k] += 1
    return out


def stratified_split(df: DataFrame, label: str = "success", key: str = "id", test_fraction: float = 0.2, seed: int = 42) -> DataFrame:
    """M6 (exact mode): add ``is_test`` with exactly proportional class
    counts.

    n_test = ceil(fraction x n); the train counts per class are allocated
    first and the test counts from what remains, as the common stratified
    split does. Inside a class, rows are taken in md5(key:seed) order. The
    per-class position comes from ``prefix_sums`` (range-partitioned), so a
    class holding most rows is still spread over many tasks. Only the
    per-class counts (one row per class) reach the driver.
    """
    from startlens.functions.columns import lookup
    from startlens.operators.stats import prefix_sums

    counts = {r[0]: r[1] for r in df.groupBy(label).count().collect()}
    n = sum(counts.values())
    n_test = math.ceil(test_fraction * n)
    train_alloc = proportional_allocation(counts, n - n_test)
    test_alloc = proportional_allocation({k: counts[k] - train_alloc[k] for k in counts}, n_test)
    h = F.md5(F.concat(F.col(key).cast("string"), F.lit(":"), F.lit(str(seed))))
    pos = prefix_sums(df.withColumn("__h", h).withColumn("__one", F.lit(1)), ["__h", key], ["__one"], [label])
    is_test = F.col("__one_before") < lookup(test_alloc, label)
    return pos.withColumn("is_test", is_test).drop("__h", "__one", "__one_before", "__one_total")


def stratified_folds(df: DataFrame, label: str = "success", key: str = "id", k: int = 5, seed: int = 42, fold_col: str = "fold") -> DataFrame:
    """M15 (exact mode): folds 0..k-1 whose sizes differ by at most one, also
    within each class.

    Each class is laid in md5(key:folds:seed) order, the classes one after the other,
    and rows are dealt to the folds in turn, so a class begins where the one
    before it stopped. Positions come from ``prefix_sums`` (range-partitioned),
    so a class with most rows is spread over many tasks; a row per class
    is joined back. Rows without a label form a class of their own, the last.
    """
    from startlens.operators.joins import join_group_table
    from startlens.operators.stats import prefix_sums

    if k < 1:
        raise ValueError(f"k must be at least 1, not {k}")
    h = F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit("folds"), F.lit(str(seed))))
    pos = prefix_sums(df.withColumn("__h", h).withColumn("__one", F.lit(1)), ["__h", key], ["__one"], [label])
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("__size"))
    before = Window.orderBy(F.col(label).asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(label, F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__start"))  # a row per class
    out = join_group_table(pos, starts, [label], how="inner")
    fold = F.pmod(F.col("__start") + F.col("__one_before"), F.lit(k)).cast("int")
    return out.withColumn(fold_col, fold).drop("__h", "__one", "__one_before", "__one_total", "__start")


def fold_column(key: str = "id", k: int = 5, seed: int = 42) -> Column:
    """Fold 0..k-1 from a hash of the key."""
    h = F.conv(F.substring(F.md5(F.concat(F.col(key).cast("string"), F.lit(":fold:"), F.lit(str(seed)))), 1, 8), 16, 10)
    return F.pmod(h.cast("long"), F.lit(k)).cast("int")


# --- features --------------------------------------------------------------

def _fill_stage(numerics: list[str]) -> SQLTransformer:
    cols = ", ".join(f"coalesce(CAST({c} AS DOUBLE), 0.0) AS {c}__f" for c in numerics)
    return SQLTransformer(statement=f"SELECT *, {cols} FROM __THIS__")


def fit_features(train: DataFrame, drop_first: bool = False, numerics: list[str] | None = None,
                 categoricals: list[str] | None = None) -> PipelineModel:
    """Fill numerics with 0, one-hot categoricals, assemble.

    Categories are indexed alphabetically and NULL/unseen values map to an
    all-zero vector. ``drop_first`` drops each column's alphabetically first
    category (M3); otherwise all are kept (M4). Fitted on ``train`` only.
    """
    numerics = numerics or list(P.NUMERIC_FEATURES)
    cats = categoricals or list(P.CATEGORICAL_FEATURES)
    fill = _fill_stage(numerics)
    # one multi-column indexer: all vocabularies in a single pass
    idx = StringIndexer(inputCols=cats, outputCols=[f"{c}__idx" for c in cats], stringOrderType="alphabetAsc", handleInvalid="keep")
    ohe = OneHotEncoder(inputCols=[f"{c}__idx" for c in cats], outputCols=[f"{c}__ohe" for c in cats], dropLast=True)
    enc = Pipeline(stages=[fill, idx, ohe]).fit(train)
    stages = list(enc.stages)
    vec_cols = [f"{c}__ohe" for c in cats]
    if drop_first:
        sliced = []
        for c, labels in zip(cats, enc.stages[1].labelsArray):
            n = len(labels)
            if n > 1:
                stages.append(VectorSlicer(inputCol=f"{c}__ohe", outputCol=f"{c}__dfo", indices=list(range(1, n))))
                sliced.append(f"{c}__dfo")
        vec_cols = sliced
    stages.append(VectorAssembler(inputCols=[f"{c}__f" for c in numerics] + vec_cols, outputCol="features", handleInvalid="keep"))
    return PipelineModel(stages=stages)


def feature_names(df: DataFrame, col: str = "features") -> list[str]:
    meta = df.schema[col].metadata.get("ml_attr", {}).get("attrs", {})
    named = [(a["idx"], a.get("name", str(a["idx"]))) for group in meta.values() for a in group]
    out = []
    for _, n in sorted(named):
        for c in P.CATEGORICAL_FEATURES:
            for mark in ("__ohe_", "__dfo_"):
                if n.startswith(c + mark):
                    n = f"{c}_{n[len(c + mark):]}"
        out.append(n.removesuffix("__f") if n.removesuffix("__f") in P.NUMERIC_FEATURES else n)
    return out


# --- the four models -------------------------------------------------------

def class_weights(train: DataFrame, label: str = LABEL) -> tuple[dict[int, float], int]:
    """Balanced weights n / (2 n_class) per class, and n, in one aggregate."""
    n1, n0 = train.agg(F.count_if(F.col(label) == 1), F.count_if(F.col(label) == 0)).first()
    n = n1 + n0
    return {1: n / (2.0 * n1) if n1 else 0.0, 0: n / (2.0 * n0) if n0 else 0.0}, n


class RandomFourierFeatures(Transformer):
    """z(x) = sqrt(2/D) cos(W x + b), W ~ N(0, 2 gamma), b ~ U(0, 2 pi)
    (Rahimi & Recht, 2007): an explicit map whose inner products
    approximate the RBF kernel exp(-gamma |x - y|^2). The directions of W are
    orthogonal in blocks of the input's width, with the lengths of Gaussian
    rows (Yu et al., 2016), which lowers the error at equal size."""

    def __init__(self, input_col: str, output_col: str, dim_in: int, n_components: int, gamma: float, seed: int = 42):
        super().__init__()
        rng = np.random.default_rng(seed)
        blocks = []
        for at in range(0, n_components, dim_in):
            q, r = np.linalg.qr(rng.normal(size=(dim_in, dim_in)))
            lengths = np.sqrt(rng.chisquare(dim_in, size=dim_in))
            blocks.append((q * np.sign(np.diag(r))) * lengths)  # columns are directions
        self.w = math.sqrt(2.0 * gamma) * np.concatenate(blocks, axis=1)[:, :n_components]
        self.b = rng.uniform(0.0, 2.0 * math.pi, size=n_components)
        self.input_col, self.output_col = input_col, output_col

    def _transform(self, df: DataFrame) -> DataFrame:
        w, b = self.w, self.b
        scale = math.sqrt(2.0 / w.shape[1])

        @F.pandas_udf(T.ArrayType(T.DoubleType()))
        def rff(arrs: pd.Series) -> pd.Series:
            x = np.stack(arrs.to_numpy()) if len(arrs) else np.zeros((0, w.shape[0]))
            z = scale * np.cos(x @ w + b)
            return pd.Series(list(z))

        return df.withColumn(self.output_col, array_to_vector(rff(vector_to_array(self.input_col))))


def kernel_error(rff: RandomFourierFeatures, table: DataFrame, gamma: float, rows: int = 300, key: str = "id", seed: int = 42) -> float:
    """The largest error of the map's inner products against the exact
    kernel, over all pairs of the ``rows`` rows of ``table`` with the least md5(key:kernel:seed)."""
    h = F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit("kernel"), F.lit(str(seed))))
    got = rff.transform(table.orderBy(h).limit(rows)).select(vector_to_array(rff.input_col).alias("x"), vector_to_array(rff.output_col).alias("z")).toArrow()
    if not len(got):
        return 0.0
    x, z = np.array(got["x"].to_pylist()), np.array(got["z"].to_pylist())
    square = (x * x).sum(axis=1)
    exact = np.exp(-gamma * np.maximum(0.0, square[:, None] + square[None, :] - 2.0 * x @ x.T))
    return float(np.abs(z @ z.T - exact).max())


def logistic_gradient(fitted: "FittedModel", train: DataFrame) -> DataFrame:
    """M8: (feature, coefficient, gradient): the gradient of the fitted logistic
    model's objective at its coefficients, over all training rows, in one
    aggregate. The objective is the weighted mean loss plus |beta|^2 / (2 n); it is
    strictly convex in beta, so a gradient near 0 certifies the optimum.

    A row contributes weight * (probability - label) * value for its
    entries that are not zero; sums are combined before the shuffle.
    """
    weights, n = class_weights(train)
    x = fitted.scaler.transform(fitted.features.transform(train))
    names = feature_names(x)
    scored = fitted.model.transform(x).withColumn("__p", vector_to_array("probability")[1])
    weight = F.when(F.col(LABEL) == 1, weights[1]).otherwise(weights[0]).cast("double")
    v = F.unwrap_udt("scaled")
    entries = F.when(v["type"] == 0, F.arrays_zip(v["indices"].alias("pos"), v["values"].alias("value"))).otherwise(
        F.transform(v["values"], lambda e, i: F.struct(i.alias("pos"), e.alias("value")))
    )
    entries = F.array_append(entries, F.struct(F.lit(len(names)).alias("pos"), F.lit(1.0).alias("value")))
    long = scored.select(weight.alias("w"), (weight * (F.col("__p") - F.col(LABEL))).alias("r"), F.inline(entries).alias("pos", "value"))
    sums = long.groupBy("pos").agg(F.sum(F.col("r") * F.col("value")).alias("s"))
    beta = [*zip(names, fitted.model.coefficients.toArray().tolist()), ("intercept", float(fitted.model.intercept))]
    known = train.sparkSession.createDataFrame([(i, f, c) for i, (f, c) in enumerate(beta)], "pos int, feature string, coefficient double")
    ridge = F.when(F.col("pos") < len(names), F.col("coefficient") / float(n)).otherwise(0.0)
    out = known.join(sums, "pos", "left")
    # the weights of a balanced fit sum to n
    return out.select("feature", "coefficient", (F.coalesce("s", F.lit(0.0)) / float(n) + ridge).alias("gradient"))


@dataclass
class FittedModel:
    name: str
    features: PipelineModel
    scaler: object | None
    model: object
    rff: RandomFourierFeatures | None = None
    platt: object | None = None
    fit_seconds: float = 0.0

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds ``prediction`` (0/1) and ``success_probability``."""
        out = self.features.transform(df)
        feat = "features"
        if self.scaler is not None:
            out = self.scaler.transform(out)
            feat = "scaled"
        if self.rff is not None:
            out = self.rff.transform(out)
            out = self.model.transform(out)
            out = out.withColumn("margin", vector_to_array("rawPrediction")[1])
            if self.platt is None:
                return out.drop("rawPrediction")
            out = self.platt.transform(out.drop("probability", "rawPrediction").withColumn("platt_in", array_to_vector(F.array("margin"))))
            return out.withColumn("success_probability", vector_to_array("probability")[1])
        out = self.model.transform(out)
        return out.withColumn("success_probability", vector_to_array("probability")[1])


CALIBRATION_FOLDS = 3
MODEL_NAMES = ["Logistic Regression", "Random Forest", "Gradient Boosting", "Support Vector Machine"]


def _timed(estimator, table: DataFrame) -> tuple[object, float]:
    t0 = time.time()
    model = estimator.fit(table)
    return model, time.time() - t0


def _margin(model, table: DataFrame) -> DataFrame:
    out = model.transform(table).withColumn("platt_in", array_to_vector(F.array(vector_to_array("rawPrediction")[1])))
    return out.drop("probability", "rawPrediction", "prediction")


#: Rows that one task of a fit takes. A boosted or gradient fit is hundreds of short jobs, whose cost is the
#: tasks' start until a task has this many rows; the forest's jobs are few and long, so it keeps all tasks.
TASK_ROWS = {"Logistic Regression": 50_000, "Gradient Boosting": 25_000, "Support Vector Machine": 25_000}


def deal_rows(table: DataFrame, rows: int, per_task: int) -> DataFrame:
    """``table`` of ``rows`` rows in tasks of about ``per_task``: fewer tasks
    without a shuffle if they are small, at least the cores' number if rows suffice."""
    now = table.rdd.getNumPartitions()
    want = min(max(1, math.ceil(rows / per_task)), max(now, table.sparkSession.sparkContext.defaultParallelism))
    if want < now:
        return table.coalesce(want)
    return table.repartition(want) if want > now else table


def fit_model(name: str, train: DataFrame, seed: int = 42, drop_first: bool = False, rff_components: int = 300,
              calibrate: bool = True, key: str = "id") -> FittedModel:
    """Fit one of the four models on a labelled table.

    ``fit_seconds`` is the time of the estimator's own fit. The SVM's
    probabilities are calibrated on the margins of held-out folds
    (``calibrate=False`` leaves them out where only labels are needed).
    """
    feats = fit_features(train, drop_first)
    weights, n = class_weights(train)
    x = feats.transform(deal_rows(train, n, TASK_ROWS[name]) if name in TASK_ROWS else train)
    if name == "Random Forest":
        rf = RandomForestClassifier(labelCol=LABEL, featuresCol="features", numTrees=100, maxDepth=10, minInstancesPerNode=10,
                                    featureSubsetStrategy="sqrt", seed=seed)
        model, sec = _timed(rf, x)
        return FittedModel(name, feats, None, model, fit_seconds=sec)
    if name == "Gradient Boosting":
        gbt = GBTClassifier(labelCol=LABEL, featuresCol="features", maxIter=100, stepSize=0.1, maxDepth=5, minInstancesPerNode=10, seed=seed)
        model, sec = _timed(gbt, x)
        return FittedModel(name, feats, None, model, fit_seconds=sec)
    # Not centred, so one-hot vectors stay sparse: the intercept takes up the
    # means in the logistic model, and distances in the kernel have none.
    scaler = StandardScaler(inputCol="features", outputCol="scaled", withMean=False, withStd=True).fit(x)
    weight = F.when(F.col(LABEL) == 1, weights[1]).otherwise(weights[0]).cast("double")
    xs = scaler.transform(x).withColumn("class_weight", weight)
    if name == "Logistic Regression":
        lr = LogisticRegression(labelCol=LABEL, featuresCol="scaled", weightCol="class_weight", maxIter=1000, regParam=1.0 / n,
                                elasticNetParam=0.0, standardization=False, tol=1e-10)
        model, sec = _timed(lr, xs)
        return FittedModel(name, feats, scaler, model, fit_seconds=sec)
    if name == "Support Vector Machine":
        stats = xs.select(Summarizer.metrics("variance").summary(F.col("scaled")).alias("s")).first()["s"]
        var = np.asarray(stats["variance"].toArray())
        d = len(var)
        # variance of all entries of the centred matrix (population), as the 'scale' rule uses
        total_var = float(np.mean(var * (n - 1) / n))
        gamma = 1.0 / (d * total_var) if total_var > 0 else 1.0 / d
        rff = RandomFourierFeatures("scaled", "rff", d, rff_components, gamma, seed)
        z = rff.transform(xs)
        # the penalty applies to the map's own features, which share one scale
        svc = LinearSVC(labelCol=LABEL, featuresCol="rff", weightCol="class_weight", regParam=1.0 / n, maxIter=200, standardization=False)
        model, sec = _timed(svc, z)
        platt = None
        if calibrate:
            fold = fold_column(key, CALIBRATION_FOLDS, seed + 1)
            held = [_margin(svc.fit(z.where(fold != f)), z.where(fold == f)) for f in range(CALIBRATION_FOLDS)]
            platt = LogisticRegression(labelCol=LABEL, featuresCol="platt_in", regParam=0.0, maxIter=100,
                                       predictionCol="platt_prediction", rawPredictionCol="platt_raw").fit(
                reduce(DataFrame.unionByName, held)
            )
        return FittedModel(name, feats, scaler, model, rff, platt, sec)
    raise ValueError(f"unknown model {name}")


#: Scores that one task orders for the ROC area.
AUC_ROWS = 50_000


def evaluate(fitted: FittedModel, test: DataFrame) -> dict:
    """M12/M13 metrics of a fitted model on a test table (one row each);
    the model scores it once."""
    score = "margin" if fitted.rff is not None else "success_probability"
    pred = materialize(fitted.transform(test).select(LABEL, "prediction", score), "scored_test")
    m = MT.binary_metrics(pred, LABEL, "prediction").first()
    most = int(test.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = min(most, math.ceil(sum(m[c] for c in ("tn", "fp", "fn", "tp")) / AUC_ROWS) or 1)
    auc = MT.roc_auc(pred, LABEL, score, parts).first()["roc_auc"]
    return {"accuracy": m["accuracy"], "precision": m["precision"], "recall": m["recall"], "f1": m["f1"], "roc_auc": auc,
            "tn": m["tn"], "fp": m["fp"], "fn": m["fn"], "tp": m["tp"]}


def _fold_f1(name: str, folded: DataFrame, f: int, seed: int) -> float:
    fit = fit_model(name, folded.where(F.col("__fold") != f), seed, calibrate=False)
    pred = fit.transform(folded.where(F.col("__fold") == f))
    return MT.binary_metrics(pred, LABEL, "prediction").first()["f1"]


def _with_folds(train: DataFrame, key: str, k: int, seed: int, exact: bool) -> DataFrame:
    if exact:
        return materialize(stratified_folds(train, "success", key, k, seed, "__fold"), "folds")
    return train.withColumn("__fold", fold_column(key, k, seed))


def cross_val_f1(name: str, train: DataFrame, k: int = 5, seed: int = 42, key: str = "id", parallelism: int = 1,
                 exact_stratified: bool = False) -> tuple[float, float]:
    """K-fold F1 on the training table; mean and population std.

    Folds are independent Spark jobs; ``parallelism`` > 1 submits them
    concurrently from driver threads (as ``CrossValidator`` does).
    """
    folded = _with_folds(train, key, k, seed, exact_stratified)
    if parallelism > 1:
        with ThreadPoolExecutor(max_workers=parallelism) as pool:
            scores = list(pool.map(in_scope(lambda f: _fold_f1(name, folded, f, seed)), range(k)))
    else:
        scores = [_fold_f1(name, folded, f, seed) for f in range(k)]
    return float(np.mean(scores)), float(np.std(scores))


COMPARISON_SCHEMA = T.StructType([
    T.StructField("Model", T.StringType()),
    T.StructField("Accuracy", T.DoubleType()),
    T.StructField("Precision", T.DoubleType()),
    T.StructField("Recall", T.DoubleType()),
    T.StructField("F1-Score", T.DoubleType()),
    T.StructField("ROC-AUC", T.DoubleType()),
    T.StructField("CV F1 (mean)", T.DoubleType()),
    T.StructField("CV F1 (std)", T.DoubleType()),
    T.StructField("Training Time (s)", T.DoubleType()),
])


def compare_models(labelled: DataFrame, models: list[str] | None = None, seed: int = 42, test_fraction: float = 0.2,
                   cv_folds: int = 5, key: str = "id", parallelism: int = 8, exact_stratified: bool = False) -> DataFrame:
    """One row per model -- test metrics, CV F1 and fit time.

    The labelled table is written once to the checkpoint folder and
    hash-split on the key (``exact_stratified``: exactly proportional class
    counts in the split and the folds, see ``stratified_split`` and ``stratified_folds``). The main fits run one at a time so that their
    fit times are not inflated; the k x models cross-validation fits are
    independent and run as concurrent Spark jobs (``parallelism``).
    """
    names = models or MODEL_NAMES
    if exact_stratified:
        marked = stratified_split(labelled, "success", key, test_fraction, seed).withColumnRenamed("is_test", "__test")
    else:
        marked = labelled.withColumn("__test", split_column(key, seed, test_fraction))
    split = materialize(marked)
    train = split.where(~F.col("__test")).drop("__test")
    test = split.where(F.col("__test")).drop("__test")
    results = {}
    for name in names:
        fitted = fit_model(name, train, seed, calibrate=False, key=key)
        results[name] = (evaluate(fitted, test), fitted.fit_seconds)
    cv = {}
    if cv_folds and cv_folds > 1:
        folded = _with_folds(train, key, cv_folds, seed, exact_stratified)
        jobs = [(n, f) for n in names for f in range(cv_folds)]
        with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
            f1s = list(pool.map(in_scope(lambda nf: _fold_f1(nf[0], folded, nf[1], seed)), jobs))
        for (n, _f), v in zip(jobs, f1s):
            cv.setdefault(n, []).append(v)
    rows = []
    for name in names:
        m, fit_sec = results[name]
        scores = cv.get(name)
        cv_mean, cv_std = (float(np.mean(scores)), float(np.std(scores))) if scores else (None, None)
        rows.append((name, m["accuracy"], m["precision"], m["recall"], m["f1"], m["roc_auc"], cv_mean, cv_std, fit_sec))
    return labelled.sparkSession.createDataFrame(rows, COMPARISON_SCHEMA)


def best_by_metric(comparison: DataFrame, metrics: list[str] | None = None, models: list[str] | None = None) -> DataFrame:
    """The best model per metric; of equal ones the first in the
    order of ``models`` (unlisted names after them, by name)."""
    order = F.coalesce(F.array_position(F.array(*[F.lit(m) for m in (models or MODEL_NAMES)]), F.col("Model")), F.lit(0))
    place = F.struct(F.when(order > 0, order).otherwise(1 << 30).alias("at"), F.col("Model").alias("name"))
    metrics = metrics or ["Accuracy", "Precision", "Recall", "F1-Score", "ROC-AUC"]
    long = comparison.select(
        "Model", place.alias("place"), F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"`{m}`").alias("value")) for m in metrics]))
    )
    return long.groupBy("metric").agg(
        F.min_by("Model", F.struct(-F.col("value"), F.col("place"))).alias("best_model"), F.max("value").alias("value")
    )


def feature_importance(fitted: FittedModel, sample: DataFrame, top_n: int = 15) -> DataFrame:
    """M14 + D16: top-N importances of a tree model with their names and
    the cumulative share (bounded by the feature count)."""
    names = feature_names(fitted.features.transform(sample.limit(1)))
    imp = fitted.model.featureImportances.toArray().tolist()
    rows = sorted(zip(names, imp), key=lambda r: -r[1])
    spark = sample.sparkSession
    df = spark.createDataFrame(rows, "feature string, importance double")
    w = Window.orderBy(F.desc("importance"), F.asc("feature"))
    out = df.withColumn("rank", F.row_number().over(w)).withColumn(
        "cumulative", F.sum("importance").over(w.rowsBetween(Window.unboundedPreceding, 0))
    )
    return out.where(F.col("rank") <= top_n)


def predict_success(fitted: FittedModel, df: DataFrame) -> DataFrame:
    """Batch probability of success (class 1) for any feature table."""
    return fitted.transform(df)


def save_model(fitted: FittedModel, path: str) -> None:
    """The feature pipeline, scaler, model and calibrator in MLlib's own
    format, and the model's name and random map as a one-row table."""
    parts = {"features": fitted.features, "model": fitted.model, "scaler": fitted.scaler, "calibrator": fitted.platt}
    for name, part in parts.items():
        if part is not None:
            part.write().overwrite().save(f"{path}/{name}")
    m = fitted.rff
    row = (fitted.name, fitted.scaler is not None, fitted.platt is not None,
           m.w.shape[0] if m else None, m.w.ravel().tolist() if m else None, m.b.tolist() if m else None)
    spark = SparkSession.active()
    schema = "name string, scaled boolean, calibrated boolean, dim_in int, w array<double>, b array<double>"
    spark.createDataFrame([row], schema).coalesce(1).write.mode("overwrite").parquet(f"{path}/about")


def load_model(path: str) -> FittedModel:
    """A model saved by ``save_model``, whichever of the four it is."""
    about = SparkSession.active().read.parquet(f"{path}/about").first()
    kinds = {"Random Forest": RandomForestClassificationModel, "Gradient Boosting": GBTClassificationModel,
             "Logistic Regression": LogisticRegressionModel, "Support Vector Machine": LinearSVCModel}
    rff = None
    if about["w"] is not None:
        rff = RandomFourierFeatures("scaled", "rff", about["dim_in"], len(about["b"]), 1.0)
        rff.w, rff.b = np.array(about["w"]).reshape(about["dim_in"], -1), np.array(about["b"])
    return FittedModel(
        about["name"], PipelineModel.load(f"{path}/features"), StandardScalerModel.load(f"{path}/scaler") if about["scaled"] else None,
        kinds[about["name"]].load(f"{path}/model"), rff, LogisticRegressionModel.load(f"{path}/calibrator") if about["calibrated"] else None,
    )
