"""KPI and score goldens.

Stage goldens follow from the formulas when funding > 0 (the traction
term is left out: ``base`` = score without it). The published golden rows
below are fixed values of the method's output (snapshot 2013, population
traction bounds recovered from that output).
"""

import math

import pytest
from pyspark.sql import functions as F

from startlens.operators import kpi, score

# FIXED VALUES: stage -> (cap_eff, runway, burn_mult, rule_of_40, burn_norm, runway_norm, base)
STAGE_GOLDEN = {
    "Pre-Seed": (0.05, 6, 10.0, 67.5, 0.0, 25.0, 21.6250),
    "Seed": (0.10, 9, 6.6667, 90.0, 1.7241, 37.5, 30.3836),
    "Angel": (0.08, 9, 8.3333, 79.0, 0.6897, 37.5, 27.0784),
    "Series A": (0.30, 12, 1.6667, 100.0, 17.2414, 50.0, 41.0862),
    "Series B": (0.50, 15, 0.8, 90.0, 39.6552, 62.5, 47.8233),
    "Series C": (0.80, 18, 0.4167, 75.0, 79.3103, 75.0, 57.8966),
    "Series D+": (1.00, 18, 0.3333, 75.0, 100.0, 75.0, 65.0000),
    None: (0.20, 12, 2.5, 55.0, 10.3448, 50.0, 26.8017),
}

# FIXED VALUES: published golden rows
# (company, stage, funding, investors, founded_year, traction_index, investment_score)
GOLDEN_ROWS = [
    ("Senesco Technologies", "Series D+", 38425000.0, 14, None, 93.3974478681163, 88.35),
    ("Fab.com", "Series C", 336325000.0, 32, 2011, 100.0, 82.9),
    ("Amp'd Mobile", "Series C", 374000000.0, 15, None, 94.25629176163646, 81.46),
    ("Arno Therapeutics", "Series D+", 46000000.0, 8, None, 53.91464734459983, 78.48),
]
GOLDEN_BOUNDS = (0.04188514, 341.07036603)


def _frame(spark, rows):
    return spark.createDataFrame(rows, "id long, stage string, funding_amount double, investors_count long, founded_year int")


def test_stage_goldens(spark):
    rows = [(i, s, 1_000_000.0, None, None) for i, s in enumerate(STAGE_GOLDEN)]
    df = kpi.calculate_all_kpis(_frame(spark, rows), traction_bounds_override=(0.0, 1e9))
    out = score.normalize_kpis(df).collect()
    for r in out:
        ce, rw, bm, r40, bn, rn, base = STAGE_GOLDEN[r.stage]
        assert r.capital_efficiency == pytest.approx(ce)
        assert r.runway_months == pytest.approx(rw)
        assert r.burn_multiple == pytest.approx(bm, abs=1e-4)
        assert r.rule_of_40 == pytest.approx(r40)
        assert r.burn_multiple_norm == pytest.approx(bn, abs=1e-4)
        assert r.runway_months_norm == pytest.approx(rn)
        no_traction = 0.25 * r.rule_of_40_norm + 0.20 * r.capital_efficiency_norm + 0.15 * bn + 0.15 * rn
        assert no_traction == pytest.approx(base, abs=1e-3)


def test_published_golden_rows(spark):
    rows = [(i, st, f, inv, fy) for i, (_, st, f, inv, fy, _, _) in enumerate(GOLDEN_ROWS)]
    df = kpi.calculate_all_kpis(_frame(spark, rows), snapshot_year=2013, traction_bounds_override=GOLDEN_BOUNDS)
    df = score.calculate_investment_score(df)
    got = {r.id: r for r in df.collect()}
    for i, (_, _, _, _, _, tr, sc) in enumerate(GOLDEN_ROWS):
        assert got[i].traction_index == pytest.approx(tr, rel=1e-7)
        assert got[i].investment_score == pytest.approx(sc, abs=1e-9)


def test_traction_population_bounds_and_missing_year(spark):
    rows = [(1, "Seed", 1000.0, 2, 2010), (2, "Seed", 1000.0, 2, None), (3, "Series A", 10.0, None, 2012)]
    got = {r.id: r for r in kpi.calculate_all_kpis(_frame(spark, rows), snapshot_year=2013).collect()}
    raw = {1: 3 * 2 * 1.0 / 3, 2: 3 * 2 * 1.0 / 1, 3: 1 * 1 * 1.5 / 1}
    lo, hi = min(raw.values()), max(raw.values())
    for k, v in raw.items():
        assert got[k].traction_index == pytest.approx((v - lo) / (hi - lo) * 100)
    # a missing founding year counts as age 1 and raises traction
    assert got[2].traction_index > got[1].traction_index


def test_null_component_makes_null_score(spark):
    rows = [(1, "Seed", None, 3, 2010), (2, "Seed", 5e6, 3, 2010), (3, "Series A", 9e6, 5, 2011)]
    df = score.calculate_investment_score(kpi.calculate_all_kpis(_frame(spark, rows), snapshot_year=2013))
    got = {r.id: r.investment_score for r in df.collect()}
    assert got[1] is None and got[2] is not None and got[3] is not None
    # a single non-null raw traction has equal bounds: 0/0 gives NULL, as in the method
    one = kpi.calculate_all_kpis(_frame(spark, rows[:2]), snapshot_year=2013)
    assert {r.id: r.traction_index for r in one.collect()} == {1: None, 2: None}


def test_score_range_and_funding_scale_invariance(spark):
    rows = [(i, s, 1e5 * (i + 1), i % 4, 2000 + i % 10) for i, s in enumerate(list(STAGE_GOLDEN) * 3)]
    base = kpi.calculate_all_kpis(_frame(spark, rows), snapshot_year=2013)
    scaled = kpi.calculate_all_kpis(_frame(spark, rows).withColumn("funding_amount", F.col("funding_amount") * 7.0), snapshot_year=2013)
    a = {r.id: r for r in base.collect()}
    b = {r.id: r for r in scaled.collect()}
    for k in a:
        for c in ("capital_efficiency", "runway_months", "burn_multiple", "rule_of_40"):
            assert a[k][c] == pytest.approx(b[k][c])
    sc = score.calculate_investment_score(base).collect()
    assert all(0 <= r.investment_score <= 100 for r in sc)
    assert not any(math.isnan(r.investment_score) for r in sc)
