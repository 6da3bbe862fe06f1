"""Cost of training that must not grow with tasks, levels or trees."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from startlens.operators import forest, ml


@pytest.fixture
def train(spark):
    df = spark.range(0, 400, 1, 8).select(
        "id", *[(F.col("id") * (i + 3) % 17).cast("double").alias(c) for i, c in enumerate(ml.P.NUMERIC_FEATURES)],
        *[F.concat(F.lit("v"), (F.col("id") % 3).cast("string")).alias(c) for c in ml.P.CATEGORICAL_FEATURES],
        (F.col("id") % 5 < 3).cast("int").alias("success"),
    )
    return df.withColumn("label", F.col("success").cast("double"))


@pytest.mark.parametrize("name", sorted(ml.TASK_ROWS) if hasattr(ml, "TASK_ROWS") else ["Logistic Regression"])
def test_small_fit_has_one_task(train, name, monkeypatch):
    seen = []

    def noted(estimator, table):
        seen.append((table.rdd.getNumPartitions(), table.count()))
        raise InterruptedError

    monkeypatch.setattr(ml, "_timed", noted)
    with pytest.raises(InterruptedError):
        ml.fit_model(name, train, rff_components=10)
    assert seen == [(1, 400)]


def test_rows_are_dealt_by_their_number(spark, train):
    cores = spark.sparkContext.defaultParallelism
    for per_task in (400, 100, 1):
        dealt = ml.deal_rows(train, 400, per_task)
        assert dealt.rdd.getNumPartitions() == min(400 // per_task, max(8, cores))
        assert sorted(r[0] for r in dealt.select("id").collect()) == [*range(400)]
    assert ml.deal_rows(train.coalesce(1), 400, 1).rdd.getNumPartitions() == max(1, cores)
    assert ml.deal_rows(train.where("id < 0"), 0, 10).rdd.getNumPartitions() == 1


def test_evaluation_scores_each_row_once(spark, train):
    rows = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def score(i):
        rows.add(1)
        return (i % 7) / 7.0

    class Stub:
        rff = None

        def transform(self, df):
            return df.withColumn("success_probability", score("id")).withColumn("prediction", (F.col("id") % 2).cast("double"))

    got = ml.evaluate(Stub(), train)
    assert rows.value == 400
    y, s = [i % 5 < 3 for i in range(400)], [(i % 7) / 7.0 for i in range(400)]
    pairs = [(a > b) + (a == b) / 2 for a, p in zip(s, y) if p for b, q in zip(s, y) if not q]
    assert got["roc_auc"] == pytest.approx(sum(pairs) / len(pairs))
    assert (got["tp"], got["fn"]) == (sum(p and i % 2 for i, p in enumerate(y)), sum(p and not i % 2 for i, p in enumerate(y)))


def test_draws_hash_once_each(spark, train):
    weights = forest.bootstrap_weights("id", 5, 42)
    plan = train.select(weights.alias("w"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("md5(") == 1
    for i, w in train.select("id", weights).collect():
        hashes = [int(hashlib.md5(f"{i}:{t}:42".encode()).hexdigest()[:8], 16) for t in range(5)]
        assert w == [sum(h >= x for x in forest.POISSON_LIMITS) for h in hashes]


def test_walk_keeps_held_rows_at_the_level():
    grown = forest._Grown(2, 3)
    grown.feature[0, 1], grown.bin[0, 1] = 1, 2
    grown.feature[0, 3], grown.bin[0, 3] = 0, 0
    bins = np.array([[0, 5], [1, 5], [1, 2]], np.int16)
    copies = np.array([[1, 1], [2, 0], [1, 1]])
    assert [x.tolist() for x in grown.walk(bins, copies, 0)] == [[0, 0, 1, 2, 2], [0, 1, 0, 0, 1], [1] * 5]
    assert [x.tolist() for x in grown.walk(bins, copies, 2)] == [[0, 1], [0, 0], [6, 7]]
