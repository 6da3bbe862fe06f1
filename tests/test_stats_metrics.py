"""Exact percentiles, prefix sums, ROC-AUC and significance tests
against brute force."""

import itertools
import math
import random

import numpy as np
import pytest

from pyspark.sql import functions as F

from startlens.functions.distributions import chi2_p_value, log_gamma_half_ratio, t_test_p_value
from startlens.operators import metrics, missing
from startlens.operators.stats import exact_percentiles, prefix_sums


def test_exact_percentiles_match_numpy_with_null_group(spark):
    rnd = random.Random(3)
    rows = []
    for i in range(2000):
        g = [None, "a", "b"][i % 3]
        v = None if i % 11 == 0 else float(rnd.choice([1, 2, 2, 3, 10, rnd.uniform(0, 50)]))
        rows.append((g, v))
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: (r.q25, r.med, r.q90) for r in exact_percentiles(df, "v", [0.25, 0.5, 0.9], ["g"], ["q25", "med", "q90"], num_partitions=5).collect()}
    for g in (None, "a", "b"):
        vals = [v for gg, v in rows if gg == g and v is not None]
        exp = np.percentile(vals, [25, 50, 90])
        assert got[g] == pytest.approx(tuple(exp))


def test_prefix_sums(spark):
    rows = [(i % 4, i, float(i)) for i in range(500)]
    df = spark.createDataFrame(rows, "g int, o int, c double")
    got = {(r.g, r.o): (r.c_before, r.c_total) for r in prefix_sums(df, ["o"], ["c"], ["g"], num_partitions=6).collect()}
    for g in range(4):
        run = 0.0
        tot = sum(c for gg, o, c in rows if gg == g)
        for gg, o, c in sorted(r for r in rows if r[0] == g):
            assert got[(g, o)] == (run, tot)
            run += c


def test_roc_auc_equals_pairwise_with_ties(spark):
    rnd = random.Random(5)
    rows = [(i, rnd.randint(0, 1), float(rnd.randint(0, 20)) / 20) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, label int, score double")
    pos = [s for _, y, s in rows if y == 1]
    neg = [s for _, y, s in rows if y == 0]
    pair = sum(1.0 if p > n else 0.5 if p == n else 0.0 for p, n in itertools.product(pos, neg)) / (len(pos) * len(neg))
    assert metrics.roc_auc(df).first().roc_auc == pytest.approx(pair)
    pts = metrics.roc_points(df).orderBy("threshold").collect()
    assert pts[0].fpr == pytest.approx(1.0) and pts[0].tpr == pytest.approx(1.0)


def test_binary_metrics_zero_division(spark):
    df = spark.createDataFrame([(0, 0), (0, 0), (1, 0)], "label int, prediction int")
    r = metrics.binary_metrics(df).first()
    assert (r.tn, r.fp, r.fn, r.tp) == (2, 0, 1, 0)
    assert r.precision == 0.0 and r.recall == 0.0 and r.f1 == 0.0
    assert r.accuracy == pytest.approx(2 / 3)


def simpson(f, lo, hi, n=4000):
    h = (hi - lo) / n
    return h / 3 * sum((1 if k in (0, n) else 4 if k % 2 else 2) * f(lo + k * h) for k in range(n + 1))


def t_tail(t, dof):
    """Two-sided tail by quadrature of the density."""
    c = math.exp(math.lgamma((dof + 1) / 2) - math.lgamma(dof / 2)) / math.sqrt(dof * math.pi)
    return 1.0 - 2.0 * simpson(lambda u: c * (1 + u * u / dof) ** (-(dof + 1) / 2), 0.0, abs(t))


def test_t_tail_and_chi2_tail(spark):
    cases = [(t, dof) for t in (0.0, 0.01, 0.5, 1.0, 1.96, -3.5, 6.0) for dof in (1.0, 2.0, 3.5, 10.0, 97.0, 1200.0)]
    # published t statistic and degrees of freedom of the missing-investor test; limits; no test
    cases += [(-14.398, 27872.0), (float("inf"), 5.0), (None, 5.0), (2.0, 0.0), (2.0, None), (float("nan"), 4.0), (1.96, 1e9)]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, t double, dof double")
    got = {r["i"]: r["p"] for r in df.select("i", t_test_p_value(F.col("t"), F.col("dof")).alias("p")).collect()}
    for i, (t, dof) in enumerate(cases[:42]):
        assert got[i] == pytest.approx(t_tail(t, dof), rel=1e-6, abs=1e-9), (t, dof)
    assert got[42] == pytest.approx(7.85e-47, rel=0.01) and got[43] == 0.0
    assert [got[i] for i in range(44, 48)] == [None] * 4
    assert got[48] == pytest.approx(math.erfc(1.96 / math.sqrt(2)), rel=1e-7)  # the normal limit
    xs = [0.0, 1e-9, 0.1, 1.0, 3.841458820694124, 3.999, 4.001, 10.0, 100.0, 1000.0, float("inf")]
    df = spark.createDataFrame([(x, k) for x in xs for k in (0, 1, None)], "x double, k int")
    for r in df.select("*", chi2_p_value(F.col("x"), F.col("k")).alias("p")).collect():
        want = None if r["k"] is None else 1.0 if r["k"] == 0 else math.erfc(math.sqrt(r["x"] / 2))
        assert r["p"] == (None if want is None else pytest.approx(want, rel=1e-11)), r
    df = spark.createDataFrame([(0.5,), (1.0,), (7.25,), (500.0,)], "a double")
    for r in df.select("a", log_gamma_half_ratio(F.col("a")).alias("g")).collect():
        assert r["g"] == pytest.approx(math.lgamma(r["a"] + 0.5) - math.lgamma(r["a"]), rel=1e-11, abs=1e-13)
    assert "Python" not in df.select(t_test_p_value(F.col("a"), F.col("a")), chi2_p_value(F.col("a"), F.col("a")))._jdf.queryExecution().executedPlan().toString()


def test_pooled_t_and_yates_chi2_against_brute_force(spark):
    rnd = random.Random(11)
    rows = []
    for i in range(600):
        inv = None if i % 3 == 0 else rnd.randint(0, 6)
        fund = rnd.uniform(1e5, 5e7) * (0.4 if inv is None else 1.0)
        status = rnd.choice(["acquired", "ipo", "closed", "operating"])
        rows.append((i, inv, fund, status))
    df = spark.createDataFrame(rows, "id long, investors_count long, funding_amount double, status string")
    r = missing.missingness_stats(df).first()
    a = np.array([f for _, i, f, _ in rows if i is None])
    b = np.array([f for _, i, f, _ in rows if i is not None])
    sp = ((len(a) - 1) * a.var(ddof=1) + (len(b) - 1) * b.var(ddof=1)) / (len(a) + len(b) - 2)
    t = (a.mean() - b.mean()) / np.sqrt(sp * (1 / len(a) + 1 / len(b)))
    assert r.t_stat == pytest.approx(t, rel=1e-9)
    assert r.funding_ratio == pytest.approx(b.mean() / a.mean(), rel=1e-12)

    known = [(i, s) for _, i, _, s in rows if s in ("acquired", "ipo", "closed")]
    obs = np.zeros((2, 2))
    for i, s in known:
        obs[int(i is not None and i > 0), int(s in ("acquired", "ipo"))] += 1
    exp = obs.sum(1, keepdims=True) * obs.sum(0, keepdims=True) / obs.sum()
    corr = obs + np.minimum(0.5, np.abs(exp - obs)) * np.sign(exp - obs)
    chi2 = ((corr - exp) ** 2 / exp).sum()
    got = missing.chi_square_test(df).first()
    assert got.chi2 == pytest.approx(chi2, rel=1e-12)
    assert got.p_value == pytest.approx(math.erfc(math.sqrt(chi2 / 2)))


def test_bounded_grid_percentiles_equal_general_path(spark):
    rnd = random.Random(9)
    rows = [(g, round(rnd.uniform(0, 100), 2)) for g in ("x", "y") for _ in range(700)]
    df = spark.createDataFrame(rows, "g string, v double")
    a = {r.g: (r.p1, r.p2) for r in exact_percentiles(df, "v", [0.25, 0.75], ["g"], ["p1", "p2"]).collect()}
    b = {r.g: (r.p1, r.p2) for r in exact_percentiles(df, "v", [0.25, 0.75], ["g"], ["p1", "p2"], bounded_grid=True).collect()}
    assert a.keys() == b.keys()
    for k in a:
        assert a[k] == pytest.approx(b[k], rel=1e-12)


def test_roc_curve_keeps_the_area_and_every_bend(spark):
    rnd = random.Random(6)
    rows = [(int(rnd.random() < s / 40), s / 40) for s in (rnd.randrange(41) for _ in range(600))] + [(1, 1.5)] * 3 + [(1, 1.6), (0, -1.0), (0, -2.0), (0, None)]
    df = spark.createDataFrame(rows, "label int, score double")
    every = sorted((r["fpr"], r["tpr"]) for r in metrics.roc_points(df).collect())
    few = sorted((r["fpr"], r["tpr"]) for r in metrics.roc_curve(df).collect())

    def area(points):
        points = [(0.0, 0.0), *points]
        return sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(points, points[1:]))

    assert set(few) < set(every) and few[-1] == (1.0, 1.0)
    assert area(few) == pytest.approx(area(every)) == pytest.approx(metrics.roc_auc(df).first()["roc_auc"])
    n1, n0 = sum(r[0] for r in rows if r[1] is not None), sum(1 - r[0] for r in rows if r[1] is not None)
    whole = [(0, 0)] + [(round(a * n0), round(b * n1)) for a, b in few]
    for a, b, c in zip(whole, whole[1:], whole[2:]):
        assert (b[0] - a[0]) * (c[1] - b[1]) != (c[0] - b[0]) * (b[1] - a[1])
    assert metrics.roc_curve(df.where("false")).collect() == []
