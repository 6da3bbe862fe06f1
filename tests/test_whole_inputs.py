"""Whole inputs, exact splits, scratch scopes, prospect text, saved models."""

import threading

import pytest
from pyspark.sql import functions as F

from startlens.functions import params as P
from startlens.operators import ml, rank, report
from startlens.operators import prospects as X
from startlens.session import materialize, scratch_tables
from startlens.sources import fixtures
from startlens.sources.tables import read_csv, read_table, write_table
from startlens.streaming.prospects import read_prospect_stream

SF = "/root/testdata/sf0.001"


def test_fixtures_keep_every_row(spark):
    orders = spark.read.parquet(f"{SF}/orders.parquet").count()
    lines = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    assert fixtures.funding_rounds(spark, SF).count() == orders and fixtures.investments(spark, SF).count() == lines
    companies = fixtures.objects(spark, SF)
    assert companies.join(fixtures.funding_rounds(spark, SF), companies["id"] == F.col("object_id"), "left_anti").count() > 0


def test_appended_rows_are_read(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    spark.range(10).write.parquet(path)
    assert read_table(spark, str(tmp_path), "t").count() == 10
    spark.range(10).write.mode("append").parquet(path)
    assert read_table(spark, str(tmp_path), "t").count() == 20


def test_csv_files_are_split(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.range(20_000).select(F.col("id"), F.lit('a, quoted "text"').alias("t"))
    write_table(rows.coalesce(1), path, fmt="csv")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        df = read_csv(spark, path)
        assert df.rdd.getNumPartitions() > 4 and df.count() == 20_000
        assert df.select("t").distinct().collect()[0][0] == 'a, quoted "text"'
        assert read_csv(spark, path, multi_line=True).rdd.getNumPartitions() == 1
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


@pytest.mark.parametrize("fraction", [0.0, 0.2, 0.5, 1.0])
def test_split_fraction(spark, fraction):
    df = spark.range(4000)
    n = df.where(ml.split_column("id", 42, fraction)).count()
    assert n == 4000 * fraction if fraction in (0.0, 1.0) else abs(n / 4000 - fraction) < 0.03


def test_split_refuses_other_fractions():
    with pytest.raises(ValueError):
        ml.split_column("id", 42, 1.5)


def test_scratch_scopes_of_two_runs(spark):
    opened, done, out = threading.Event(), threading.Event(), {}

    def short():
        with scratch_tables(spark) as paths:
            materialize(spark.range(3))
            opened.wait(60)
            out["short"] = len(paths)
        done.set()

    t = threading.Thread(target=short)
    t.start()
    with scratch_tables(spark) as paths:
        mine = materialize(spark.range(5))
        opened.set()
        done.wait(60)
        assert mine.count() == 5  # the other run's end left it alone
        with scratch_tables(spark):
            inner = materialize(spark.range(2))
            inner_path = inner.inputFiles()[0]
        assert len(paths) == 1
    t.join()
    assert out["short"] == 1
    with pytest.raises(Exception):
        spark.read.parquet(inner_path).count()


def test_prospect_text_is_read_or_refused(spark):
    raw = spark.createDataFrame(
        [("1", "1000000", "Seed", "14.0", "2011.0"), ("2", "1e6", "Seed", "", None), ("3", "abc", "Seed", "2.5", "x"), ("4", "NaN", None, "-1", "2011")],
        "prospect_id string, funding_amount string, stage string, investors_count string, founded_year string",
    )
    got = {r["prospect_id"]: r for r in X.score_prospects(X.read_inputs(raw)).collect()}
    assert (got["1"]["investors_count"], got["1"]["founded_year"], got["1"]["is_valid"]) == (14, 2011, True)
    d = P.PROSPECT_DEFAULTS
    assert (got["2"]["investors_count"], got["2"]["founded_year"], got["2"]["sector"]) == (d["investors_count"], d["founded_year"], d["sector"])
    assert got["3"]["is_valid"] is False
    assert [x for x in got["3"]["reject_reasons"] if x.startswith(X.REJECT_UNREADABLE)] == [
        X.REJECT_UNREADABLE + c for c in ("funding_amount", "investors_count", "founded_year")
    ]
    assert X.REJECT_INVESTORS in got["4"]["reject_reasons"] and X.REJECT_UNREADABLE + "funding_amount" in got["4"]["reject_reasons"]


def test_stream_reads_all_new_files_by_default(spark, tmp_path):
    assert read_prospect_stream(spark, str(tmp_path)).isStreaming
    assert read_prospect_stream(spark, str(tmp_path), max_files_per_trigger=2).isStreaming


def _labelled(spark, n=300):
    r = F.rand(7)
    df = spark.range(n).select("id", *[(F.rand(k) * 100).alias(c) for k, c in enumerate(P.NUMERIC_FEATURES)])
    first = F.col(P.NUMERIC_FEATURES[0])
    for c in P.CATEGORICAL_FEATURES:
        df = df.withColumn(c, F.when(F.col("id") % 3 == 0, "a__f").otherwise("b__ohe_c"))
    return materialize(df.withColumn("label", (first + r * 20 > 60).cast("double")))


@pytest.mark.parametrize("name", ml.MODEL_NAMES)
def test_saved_models_predict_the_same(spark, tmp_path, name):
    df = _labelled(spark)
    fitted = ml.fit_model(name, df, rff_components=20)
    assert fitted.name == name and fitted.fit_seconds > 0
    ml.save_model(fitted, str(tmp_path / "m"))
    loaded = ml.load_model(str(tmp_path / "m"))
    cols = ["id", "prediction", "success_probability"]
    a = fitted.transform(df).select(cols).orderBy("id").collect()
    assert a == loaded.transform(df).select(cols).orderBy("id").collect() and loaded.name == name
    assert all(0 <= r["success_probability"] <= 1 for r in a)
    right = fitted.transform(df).select(F.avg((F.col("prediction") == F.col("label")).cast("int"))).first()[0]
    assert right > 0.8


def test_feature_names_keep_marks_inside_values(spark):
    df = _labelled(spark)
    names = ml.feature_names(ml.fit_features(df).transform(df))
    c = P.CATEGORICAL_FEATURES[0]
    assert names[: len(P.NUMERIC_FEATURES)] == list(P.NUMERIC_FEATURES) and f"{c}_a__f" in names and f"{c}_b__ohe_c" in names


def test_class_weights_in_one_aggregate(spark):
    df = spark.createDataFrame([(1.0,)] * 3 + [(0.0,)] * 1, "label double")
    assert ml.class_weights(df) == ({1: 4 / 6, 0: 2.0}, 4)


def test_best_model_of_equal_ones_is_the_first(spark):
    rows = [(m, 0.5, 0.5 + 0.1 * (m == "Gradient Boosting")) for m in reversed(ml.MODEL_NAMES)]
    got = ml.best_by_metric(spark.createDataFrame(rows, "Model string, Accuracy double, Recall double"), ["Accuracy", "Recall"]).collect()
    assert {r["metric"]: r["best_model"] for r in got} == {"Accuracy": ml.MODEL_NAMES[0], "Recall": "Gradient Boosting"}


def test_rank_of_company_equals_full_rank(spark):
    df = spark.createDataFrame([(1, "a", 5.0), (2, "b", None), (3, "b", 5.0), (4, "c", 9.0), (5, "d", None)], "id long, company string, investment_score double")
    full = {(r["id"]): r["rank"] for r in rank.rank_rows(df).collect()}
    for name, best in (("a", 1), ("b", 3), ("c", 4), ("d", 5)):
        r = rank.rank_of_company(df, name).first()
        assert (r["id"], r["rank"]) == (best, full[best])
    assert rank.rank_of_company(df, "none").count() == 0


def test_distributions_in_one_pass(spark):
    df = spark.createDataFrame([("a", 1), ("a", None), (None, 1)], "x string, y int")
    got = {(r["dimension"], r["value"]): (r["companies"], round(r["share"], 3)) for r in report.distributions(df, ["x", "y"]).collect()}
    assert got == {("x", "a"): (2, 0.667), ("x", None): (1, 0.333), ("y", "1"): (2, 0.667), ("y", None): (1, 0.333)}
    plan = report.distributions(df, ["x", "y"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan ExistingRDD") + plan.count("LocalTableScan") == 1
