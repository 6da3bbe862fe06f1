"""Stored and checked inputs, sketches, walk-forward, optimality, kernel error."""

import random
import uuid
from collections import Counter

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from startlens.operators import analysis, enrich, ml, rank
from startlens.operators import sketches as SK
from startlens.sources import company_store, fixtures
from startlens.sources.quarantine import quarantine_summary, read_csv_checked
from startlens.session import ensure_checkpoint_dir


def folder(spark, name):
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/test-stores/{name}-{uuid.uuid4().hex}"


def test_enrichment_on_a_store_has_no_exchange(spark):
    tables = [f(spark, SF_SMALL) for f in (fixtures.objects, fixtures.funding_rounds, fixtures.investments)]
    path = company_store.write_company_store(*tables, folder(spark, "companies"), buckets=5)
    stored = company_store.open_company_store(spark, path)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for kind in ({}, {"filter_funded": False}, {"approximate_investors": True}):
            plan = enrich.enrich_startups(*stored, **kind)._jdf.queryExecution().executedPlan().toString()
            assert "Exchange" not in plan and plan.count("SortMergeJoin") + plan.count("ShuffledHashJoin") == 2, plan
        plain = enrich.enrich_startups(*tables)
        assert "Exchange" in plain._jdf.queryExecution().executedPlan().toString()
        got = enrich.enrich_startups(*stored)
        assert sorted(map(repr, got.collect())) == sorted(map(repr, plain.collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    with pytest.raises(ValueError):
        company_store.write_company_store(*tables, path, buckets=0)


def scanned_rows(df):
    """Rows that the plan's parquet scan gave out when ``df`` ran."""
    df.collect()
    found, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        p = todo.pop()
        name = p.nodeName()
        if name == "AdaptiveSparkPlan":
            todo.append(p.executedPlan())
        elif "QueryStage" in name:
            todo.append(p.plan())
        if name.startswith("Scan parquet"):
            found.append(p.metrics().apply("numOutputRows").value())
        todo += [p.children().apply(i) for i in range(p.children().size())]
    return sum(found)


def test_lookup_in_a_store_reads_few_rows(spark):
    rows = spark.range(60_000).select(
        F.col("id").alias("rank"), F.concat(F.lit("Company "), F.when(F.col("id") % 3 == 0, F.lit("Hot")).otherwise(F.md5(F.col("id").cast("string")))).alias("company"),
        F.sha2(F.col("id").cast("string"), 256).alias("filler"),
    )
    path = company_store.write_lookup_store(rows, folder(spark, "by_name"), files=8, block_bytes=1 << 18)
    stored = spark.read.parquet(path)
    name = rows.where("rank = 31").first()["company"]
    got = rank.lookup_company(stored, name)
    assert [r["rank"] for r in got.collect()] == [31]
    assert 0 < scanned_rows(rank.lookup_company(stored, name)) < 6_000
    assert scanned_rows(rank.lookup_company(stored, "Company nowhere")) < 6_000
    assert rank.lookup_company(stored, "Company Hot").first()["rank"] == 0
    sizes = [r[0] for r in stored.groupBy(F.input_file_name()).count().select("count").collect()]
    assert len(sizes) >= 7 and max(sizes) < 20_000  # a third of the rows under one name lie in several files


CSV = [
    "id,name,amount,day", '1,"Smith, Ltd",2.5,2001-01-31', "2,short,3", "3,long,4,2001-01-01,more", "4,x,n/a,2001-02-30", "5,,,", '6,"open,1,2001-01-01',
    "7, pad , 8 ,2001-01-01 ", "8,é😀,NaN,2001-01-01", "9,x,1e400,2001-01-01", "4,x,n/a,2001-02-30",
]


def test_every_row_is_accepted_or_rejected_with_reasons(spark):
    path = folder(spark, "csv")
    spark.createDataFrame([(x,) for x in CSV], "value string").coalesce(1).write.text(path)
    good, bad = read_csv_checked(spark, path, ["amount"], ["day"], ["name"])
    assert good.columns == ["id", "name", "amount", "day"]
    assert sorted(r["id"] for r in good.collect()) == ["1", "7"]
    assert good.where("id = 1").first()["name"] == "Smith, Ltd"
    got = {(r["line"], tuple(r["reasons"])) for r in bad.collect()}
    assert ("2,short,3", ("fields",)) in got and ("3,long,4,2001-01-01,more", ("fields",)) in got and ('6,"open,1,2001-01-01', ("fields",)) in got
    assert ("4,x,n/a,2001-02-30", ("number:amount", "date:day")) in got and ("5,,,", ("missing:name",)) in got
    assert ("8,é😀,NaN,2001-01-01", ("number:amount",)) in got and ("9,x,1e400,2001-01-01", ("number:amount",)) in got
    assert good.count() + bad.count() == len(CSV) - 1
    counts = {r["reason"]: r["rows"] for r in quarantine_summary(good, bad).collect()}
    assert counts == {"accepted": 2, "rejected": 8, "fields": 3, "number:amount": 4, "date:day": 2, "missing:name": 1}
    with pytest.raises(ValueError):
        read_csv_checked(spark, path, ["nothing"])
    empty = folder(spark, "csv")
    spark.createDataFrame([(CSV[0],)], "value string").coalesce(1).write.text(empty)
    good, bad = read_csv_checked(spark, empty, ["amount"])
    assert good.count() == bad.count() == 0


def test_sketches_merge_to_coarser_groups(spark):
    rng = random.Random(8)
    rows = [(rng.choice("abc"), rng.choice(["x", None]), None if rng.random() < 0.1 else rng.randrange(5000), rng.choice([None, float("nan"), rng.gauss(0, 9)])) for _ in range(30_000)]
    df = spark.createDataFrame(rows, "g string, h string, who int, v double")
    fine = SK.sketch_groups(df, ["g", "h"], ["who"], ["v"])
    for groups in (["g"], ["h"], []):
        got = SK.read_sketches(SK.merge_sketches(fine, groups), [0.1, 0.5, 0.9]).collect()
        assert sum(r["rows"] for r in got) == len(rows)
        for r in got:
            own = [x for x in rows if all(x["gh".index(k)] == r[k] for k in groups)]
            exact = len({x[2] for x in own if x[2] is not None})
            assert abs(r["who_distinct"] - exact) <= 4 * 1.04 / 2 ** (SK.LG_K / 2) * exact
            values = sorted(x[3] for x in own if x[3] is not None and x[3] == x[3])
            for p in (10, 50, 90):
                at = sum(v <= r[f"v_p{p}"] for v in values) / len(values)
                assert abs(at - p / 100) <= 1.7 / SK.KLL_K + 1 / len(values)
    none = SK.read_sketches(SK.sketch_groups(df.withColumn("v", F.lit(None).cast("double")), ["g"], [], ["v"]))
    assert {r["v_p50"] for r in none.collect()} == {None}


def test_walk_forward_equals_a_loop_over_cutoffs(spark):
    rng = random.Random(5)
    rows = [(rng.choice([None, *range(1990, 2000)]), rng.choice(["A", "B", None]), rng.choice([0, 1, 1, None])) for _ in range(300)] + [(2005, "new", 1), (2005, "new", 0)]
    got = {r["cutoff_year"]: tuple(r)[1:] for r in analysis.walk_forward(spark.createDataFrame(rows, "founded_year int, stage string, label int")).collect()}
    known = [r for r in rows if r[0] is not None and r[2] is not None]
    for year in {r[0] for r in known} - {1990}:
        train, test = [r for r in known if r[0] < year], [r for r in known if r[0] == year]
        right = 0
        for _, stage, y in test:
            base = [r[2] for r in train if r[1] == stage] or [r[2] for r in train]
            right += (sum(base) / len(base) >= 0.5) == bool(y)
        want = (len(train), sum(r[2] for r in train), len(test), sum(r[2] for r in test), right)
        assert got.pop(year) == (*want, pytest.approx(right / len(test)))
    assert got == {}


def model_rows(spark, n=300):
    rng = random.Random(2)
    cols = "id long, stage string, sector string, country string, success int, label double, " + ", ".join(f"{c} double" for c in ml.P.NUMERIC_FEATURES)
    rows = []
    for i in range(n):
        y = int(rng.random() < 0.4)
        rows.append((i, rng.choice(["Seed", "Series A", None]), rng.choice(["x", "y"]), "USA", y, float(y), *[rng.gauss(y, 1 + k) for k in range(len(ml.P.NUMERIC_FEATURES))]))
    return spark.createDataFrame(rows, cols)


def test_logistic_gradient_vanishes_only_at_the_optimum(spark):
    train = model_rows(spark)
    fitted = ml.fit_model("Logistic Regression", train)
    rows = ml.logistic_gradient(fitted, train).collect()
    assert len(rows) == len(ml.P.NUMERIC_FEATURES) + 2 + 2 + 1 + 1 and all(abs(r["gradient"]) < 1e-6 for r in rows)
    other = ml.fit_model("Logistic Regression", train.where("id % 3 > 0"))
    assert max(abs(r["gradient"]) for r in ml.logistic_gradient(other, train).collect()) > 1e-3


def test_kernel_error_falls_with_the_map_and_is_lower_when_orthogonal(spark):
    train = model_rows(spark, 120)
    fitted = ml.fit_model("Logistic Regression", train)
    x = fitted.scaler.transform(fitted.features.transform(train))
    d = len(ml.feature_names(x))
    error = {n: sum(ml.kernel_error(ml.RandomFourierFeatures("scaled", "z", d, n, 0.05, seed), x, 0.05, rows=80) for seed in range(3)) / 3 for n in (30, 300, 3000)}
    assert error[30] > error[300] > error[3000] and error[3000] < 0.1
    w = ml.RandomFourierFeatures("scaled", "z", d, d, 0.05).w
    gram = w.T @ w
    assert abs(gram - gram * (gram == gram.max(axis=0))).max() < 1e-9 * gram.max() or abs(gram[0, 1]) < 1e-9
