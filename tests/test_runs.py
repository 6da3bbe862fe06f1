"""End-to-end ranking from three CSV files equals the registered pipeline."""

import uuid

from pyspark.sql import functions as F

from conftest import SF_SMALL


def test_run_ranking_from_csv_files(spark):
    from startlens.plans import runs, startups
    from startlens.session import ensure_checkpoint_dir
    from startlens.sources import fixtures
    from startlens.sources.tables import write_table

    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/test-runs/{uuid.uuid4().hex}"
    for name, df in (("objects", fixtures.objects(spark, SF_SMALL)), ("funding_rounds", fixtures.funding_rounds(spark, SF_SMALL)),
                     ("investments", fixtures.investments(spark, SF_SMALL))):
        write_table(df, f"{base}/in/{name}.csv", fmt="csv")
    paths = runs.run_ranking(spark, f"{base}/in", f"{base}/out", fmt="csv", out_format="parquet", top=10,
                             snapshot_year=fixtures.SNAPSHOT_YEAR_FIXTURE)
    got = spark.read.parquet(paths["scored"])
    want = startups.scored_companies(spark, SF_SMALL)
    g = {int(r.id): r.investment_score for r in got.select("id", "investment_score").collect()}
    w = {r.id: r.investment_score for r in want.select("id", "investment_score").collect()}
    assert g == w
    ranks = sorted(r["rank"] for r in got.select("rank").collect())
    assert ranks == list(range(1, len(w) + 1))
    top = spark.read.parquet(paths["top"])
    assert top.count() == 10 and top.agg(F.max("rank")).first()[0] == 10
    assert spark.read.parquet(paths["kpi_summary"]).count() == 7 and spark.read.parquet(paths["score_bands"]).count() == 5
    one = spark.read.parquet(paths["score_summary"]).first()
    assert one["count"] == len(w) and one["max"] == max(w.values())
    best = spark.read.parquet(paths["top_breakdown"])
    assert best.select("id").distinct().count() == 1 and abs(best.agg(F.sum("contribution")).first()[0] - max(w.values())) < 0.01
    # the missing-data run on the same files
    missing = runs.run_missing(spark, f"{base}/in", f"{base}/missing")
    test = spark.read.parquet(missing["missingness_test"]).first()
    known = want.where("investors_count is null").count()
    assert (test["missing_count"], test["present_count"]) == (known, len(w) - known) and 0 <= test["p_value"] <= 1
    assert spark.read.parquet(missing["missing_by_stage"]).count() > 1


def test_load_run_writes_canonical_columns(spark, tmp_path):
    import pytest

    from startlens.plans import runs
    from startlens.sources import fixtures
    from startlens.sources.tables import read_csv, write_table

    write_table(fixtures.generic_extract(spark, SF_SMALL), str(tmp_path / "in.csv"), fmt="csv")
    out = read_csv(spark, runs.run_load(spark, str(tmp_path / "in.csv"), str(tmp_path / "out")))
    assert {"company", "stage", "country", "sector", "funding_amount"} <= set(out.columns) and out.count() > 0
    write_table(fixtures.generic_extract(spark, SF_SMALL).limit(0), str(tmp_path / "none.csv"), fmt="csv")
    with pytest.raises(Exception):
        runs.run_load(spark, str(tmp_path / "none.csv"), str(tmp_path / "out2"))


def test_train_then_predict_prospects_from_files(spark):
    from startlens.plans import runs, startups
    from startlens.session import ensure_checkpoint_dir
    from startlens.sources import fixtures
    from startlens.sources.tables import write_table

    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/test-runs/{uuid.uuid4().hex}"
    write_table(startups.scored_companies(spark, SF_SMALL), f"{base}/scored", fmt="csv")
    paths = runs.run_training(spark, f"{base}/scored", f"{base}/models", cv_folds=0, models=["Random Forest"], fmt="csv", test_size=0.3)
    counts = spark.read.parquet(paths["evaluation"]).first()
    share = sum(counts[c] for c in ("tn", "fp", "fn", "tp")) / startups.scored_companies(spark, SF_SMALL).where("status in ('acquired', 'ipo', 'closed')").count()
    assert 0.1 < share < 0.5 and 0 <= counts["roc_auc"] <= 1
    assert spark.read.parquet(paths["classification_report"]).count() >= 4
    cmp = spark.read.parquet(paths["model_comparison"]).collect()
    assert [r.Model for r in cmp] == ["Random Forest"]
    write_table(fixtures.prospects(spark, SF_SMALL), f"{base}/prospects.csv", fmt="csv")
    out = runs.run_prospect_scoring(spark, paths["model"], f"{base}/prospects.csv", f"{base}/pred", fmt="csv")
    pred = spark.read.parquet(out)
    assert pred.count() == fixtures.prospects(spark, SF_SMALL).count()
    # accepted prospects, and only these, have a probability
    assert pred.where(F.col("is_valid") & ~F.coalesce(F.col("success_probability").between(0, 1), F.lit(False))).count() == 0
    assert pred.where(~F.col("is_valid") & (F.col("success_probability").isNotNull() | F.col("recommendation").isNotNull())).count() == 0
    assert pred.where("is_valid").count() > 0
    exact = runs.run_training(spark, f"{base}/scored", f"{base}/exact", cv_folds=2, models=["Random Forest"], fmt="csv", exact_stratified=True)
    counts = spark.read.parquet(exact["evaluation"]).first()
    known = startups.scored_companies(spark, SF_SMALL).where("status in ('acquired', 'ipo', 'closed')").count()
    assert sum(counts[c] for c in ("tn", "fp", "fn", "tp")) == -(-known // 5)


def test_scratch_tables_are_deleted(spark):
    import os

    from startlens.session import materialize, scratch_tables

    with scratch_tables(spark) as made:
        df = materialize(spark.range(100), "scratch-test")
        assert df.count() == 100
    assert len(made) == 1
    local = made[0].replace("file:", "")
    assert not os.path.exists(local)
    kept = materialize(spark.range(3), "kept-test")  # outside a scope: kept
    assert kept.count() == 3
