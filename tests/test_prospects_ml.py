"""Prospect KPIs against a plain-Python brute force; split/fold/feature
invariants; one small model end to end."""

import math

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from startlens.functions import params as P
from startlens.operators import ml, prospects


def _brute(funding, stage, investors, year, current=2025):
    burn_p, rev_m, r40b, w = P.PROSPECT_STAGE_PARAMS.get(stage, P.PROSPECT_STAGE_PARAMS["Series A"])
    age = max(1, current - year)
    rev = funding * rev_m
    ce = min(1.0, rev / funding if funding > 0 else 0)
    burn = funding / burn_p
    runway = min(24, (funding * 0.5) / burn if burn > 0 else 0)
    bm = min(10, max(0.3, (burn * 12) / rev if rev > 0 else 10))
    tr = min(100, (math.log10(max(100000, funding)) * investors * w) / age)
    r40 = max(0, min(150, r40b + (ce - 0.30) * 50))
    bn = min(100, (1 / bm) * 50 if bm > 0 else 0)
    score = min(100, r40) * 0.25 + tr * 0.25 + ce * 100 * 0.20 + bn * 0.15 + (runway / 24) * 100 * 0.15
    return ce, runway, bm, tr, r40, score


def test_prospect_kpis_match_brute_force(spark):
    rows = [(1, 5e6, "Seed", 3, 2020), (2, -2e4, "Series B", 0, 2024), (3, 3e7, "Pre-Seed", 7, 1995), (4, 1e5, "Series D+", 12, 2025)]
    df = spark.createDataFrame(rows, "prospect_id long, funding_amount double, stage string, investors_count int, founded_year int")
    got = {r.prospect_id: r for r in prospects.prospect_kpis(df).collect()}
    for pid, f, st, inv, yr in rows:
        ce, rw, bm, tr, r40, sc = _brute(f, st, inv, yr)
        g = got[pid]
        assert (g.capital_efficiency, g.runway_months, g.burn_multiple, g.traction_index, g.rule_of_40) == pytest.approx((ce, rw, bm, tr, r40))
        assert g.investment_score == pytest.approx(sc)


def test_prospect_defaults_validation_and_interpretation(spark):
    rows = [(1, 3e6, None, None, None, 0, None), (2, -5.0, "Pre-Seed", " Fintech ", "gbr", -1, 1980)]
    df = spark.createDataFrame(rows, "prospect_id long, funding_amount double, stage string, sector string, country string, investors_count int, founded_year int")
    got = {r.prospect_id: r for r in prospects.score_prospects(df).collect()}
    a, b = got[1], got[2]
    assert (a.stage, a.sector, a.country, a.investors_count, a.founded_year) == ("Series A", "saas", "USA", 0, 2020)
    assert a.is_valid and a.reject_reasons == []
    assert "Limited investor validation (0 investors)" in a.concerns
    assert (b.sector, b.country) == ("fintech", "GBR")
    assert not b.is_valid and len(b.reject_reasons) == 4


def test_probability_bands(spark):
    df = spark.createDataFrame([(0.85,), (0.7,), (0.5,), (0.1,), (None,)], "success_probability double")
    got = [(r.confidence, r.recommendation, r.percentile_context) for r in prospects.with_probability_bands(df).collect()]
    assert got[0] == ("HIGH", "STRONG INVEST - High success probability", "top 5%")
    assert got[1] == ("MEDIUM", "CONSIDER - Above average potential", "top 15%")
    assert got[2] == ("LOW", "CAUTIOUS - Average risk/reward", "above median")
    assert got[3] == ("HIGH", "PASS - Below average probability", "below median")
    assert got[4] == (None, None, None)


def test_split_disjoint_complete_and_folds(spark):
    df = spark.range(5000).withColumnRenamed("id", "id")
    s = df.withColumn("t", ml.split_column("id", 42, 0.2)).withColumn("f", ml.fold_column("id", 5, 42))
    counts = {r.t: r["count"] for r in s.groupBy("t").count().collect()}
    assert counts[True] + counts[False] == 5000
    assert 0.17 < counts[True] / 5000 < 0.23
    train = s.where(~F.col("t")).select("id")
    test = s.where(F.col("t")).select("id")
    assert train.intersect(test).count() == 0
    assert train.union(test).exceptAll(df.select("id")).count() == 0
    assert sorted(r.f for r in s.select("f").distinct().collect()) == [0, 1, 2, 3, 4]


def test_features_and_random_forest_end_to_end(spark):
    from startlens.plans import startups

    lab = ml.label_outcomes(startups.scored_companies(spark, SF_SMALL))
    train = lab.where(~ml.split_column("id"))
    feats = ml.fit_features(train)
    x = feats.transform(lab)
    names = ml.feature_names(x)
    n_stage = train.where("stage IS NOT NULL").select("stage").distinct().count()
    assert names[: len(P.NUMERIC_FEATURES)] == P.NUMERIC_FEATURES
    assert sum(n.startswith("stage_") for n in names) == n_stage
    dropped = ml.fit_features(train, drop_first=True).transform(lab)
    assert sum(n.startswith("stage_") for n in ml.feature_names(dropped)) == n_stage - 1
    fitted = ml.fit_model("Random Forest", train)
    pred = fitted.transform(lab)
    probs = [r.success_probability for r in pred.select("success_probability").collect()]
    assert all(0.0 <= p <= 1.0 for p in probs)
    imp = ml.feature_importance(fitted, lab, 5).collect()
    assert len(imp) == 5 and imp[-1].cumulative <= 1.0 + 1e-9


def test_exact_stratified_split_against_brute_force(spark):
    import hashlib

    rows = [(i, 1 if i % 5 < 3 else 0) for i in range(1, 1001)]
    df = spark.createDataFrame(rows, "id long, success int")
    got = {r.id: r.is_test for r in ml.stratified_split(df, "success", "id", 0.2, 42).collect()}
    counts = {1: 600, 0: 400}
    n_test = math.ceil(0.2 * 1000)
    train = ml.proportional_allocation(counts, 1000 - n_test)
    test = ml.proportional_allocation({k: counts[k] - train[k] for k in counts}, n_test)
    for cls in (0, 1):
        ids = sorted((hashlib.md5(f"{i}:42".encode()).hexdigest(), i) for i, c in rows if c == cls)
        want = {i for _, i in ids[: test[cls]]}
        assert {i for i, c in rows if c == cls and got[i]} == want
    assert sum(got.values()) == n_test


def test_seeded_fit_repeats_and_stream_scorer_with_model(spark):
    from startlens.plans import startups
    from startlens.sources import fixtures
    from startlens.streaming import prospects as SP

    lab = ml.label_outcomes(startups.scored_companies(spark, SF_SMALL))
    train = lab.where(~ml.split_column("id"))
    a = ml.fit_model("Random Forest", train, drop_first=True)
    b = ml.fit_model("Random Forest", train, drop_first=True)
    pa = [r.success_probability for r in a.transform(lab).orderBy("id").select("success_probability").collect()]
    pb = [r.success_probability for r in b.transform(lab).orderBy("id").select("success_probability").collect()]
    assert pa == pb
    scored = SP.score_stream(fixtures.prospects(spark, SF_SMALL), model=a)
    got = scored.select("success_probability", "confidence", "recommendation").collect()
    assert len(got) == fixtures.prospects(spark, SF_SMALL).count()
    assert all(0.0 <= r.success_probability <= 1.0 and r.confidence in ("HIGH", "MEDIUM", "LOW") for r in got)
