"""Property tests: column helpers agree with Python on generated inputs.

Each example batch runs as one Spark job (all generated values in one
DataFrame), so the checks stay fast.
"""

import string

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from startlens.functions.columns import py_format_fixed, py_title, strip_ws

ASCII_TEXT = st.text(alphabet=string.ascii_letters + string.digits + " -+'_.\t\n", max_size=24)
SETTINGS = settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


@SETTINGS
@given(st.lists(ASCII_TEXT, min_size=1, max_size=300))
def test_strip_and_title_match_python(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "s string")
    got = df.select(strip_ws("s").alias("a"), py_title(strip_ws("s")).alias("b")).collect()
    assert [r.a for r in got] == [v.strip() for v in values]
    assert [r.b for r in got] == [v.strip().title() for v in values]


FINITE = st.floats(min_value=-1e12, max_value=1e12, allow_nan=False, allow_infinity=False)


@SETTINGS
@given(st.lists(FINITE, min_size=1, max_size=500), st.integers(min_value=0, max_value=3))
def test_fixed_point_format_matches_python(spark, values, digits):
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    got = [r[0] for r in df.select(py_format_fixed("x", digits)).collect()]
    assert got == [f"{float(v):.{digits}f}" for v in values]


SCORES = st.lists(st.one_of(st.none(), st.sampled_from([0.0, 12.5, 42.0, 99.99]), st.floats(0, 100, allow_nan=False)),
                  min_size=1, max_size=400)
FEW = settings(max_examples=3, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


@FEW
@given(SCORES, st.integers(min_value=1, max_value=9))
def test_rank_rows_equals_naive_rank(spark, scores, parts):
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from startlens.operators.rank import rank_rows

    df = spark.createDataFrame(list(enumerate(scores)), "id long, investment_score double")
    got = {r.id: r["rank"] for r in rank_rows(df, num_partitions=parts).collect()}
    w = Window.orderBy(F.col("investment_score").desc_nulls_last(), F.col("id"))
    want = {r.id: r.rn for r in df.withColumn("rn", F.row_number().over(w)).collect()}
    assert got == want


@FEW
@given(st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.one_of(st.none(), st.integers(-50, 50).map(float))),
                min_size=1, max_size=400),
       st.lists(st.floats(0, 1), min_size=1, max_size=3, unique=True))
def test_exact_percentiles_equal_numpy(spark, rows, probs):
    import numpy as np
    import pytest

    from startlens.operators.stats import exact_percentiles

    df = spark.createDataFrame(rows, "g string, v double")
    names = [f"q{i}" for i in range(len(probs))]
    got = {r.g: tuple(r[n] for n in names) for r in exact_percentiles(df, "v", probs, ["g"], names, num_partitions=4).collect()}
    for g in {g for g, _ in rows}:
        vals = [v for gg, v in rows if gg == g and v is not None]
        if not vals:
            assert g not in got
            continue
        assert got[g] == pytest.approx(tuple(np.percentile(vals, [p * 100 for p in probs])), abs=1e-9)


@FEW
@given(st.lists(st.tuples(st.integers(0, 1), st.sampled_from([0.0, 0.1, 0.25, 0.5, 0.75, 1.0])), min_size=2, max_size=300))
def test_roc_auc_equals_pairwise_definition(spark, rows):
    import itertools

    import pytest

    from startlens.operators.metrics import roc_auc

    pos = [s for y, s in rows if y == 1]
    neg = [s for y, s in rows if y == 0]
    df = spark.createDataFrame(rows, "label int, score double")
    got = roc_auc(df).first().roc_auc
    if not pos or not neg:
        assert got is None
        return
    pair = sum(1.0 if p > n else 0.5 if p == n else 0.0 for p, n in itertools.product(pos, neg)) / (len(pos) * len(neg))
    assert got == pytest.approx(pair)
