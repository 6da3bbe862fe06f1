"""The table forest against a plain recursive trainer, its tables, and folds."""

import hashlib
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from startlens.operators import forest as FO
from startlens.operators import ml, prospects

NUMS, CATS = ["size", "age"], ["kind"]
SCHEMA = "id long, size double, age int, kind string, label int"


def rows(seed=1, n=150):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        size, age, kind = rng.choice([None, rng.random() * 9, 3.0]), rng.randrange(6), rng.choice(["x", "y", "é", None])
        out.append((i, size, age, kind, int((size or 0) * 2 + age + (kind == "y") * 3 + rng.random() * 4 > 9)))
    return out


def plain_forest(data, trees, depth, min_leaf, min_split, bins, seed):
    """Nodes by (tree, number): (feature, limit, copies, successes), trained row by row."""
    cats = sorted({r[3] for r in data if r[3] is not None}, key=str.encode)[1:]
    xs = [[round(r[1] or 0.0, 6), round(float(r[2] or 0), 6)] + [float(r[3] == c) for c in cats] for r in data]
    limits = []
    for f in range(2):
        values = sorted(x[f] for x in xs)
        own = {min(v for v in values if bins * sum(u <= v for u in values) >= k * len(values)) for k in range(1, bins)}
        limits.append(sorted(own - {values[-1]}))
    limits += [[0.0]] * len(cats)
    cdf = [math.floor(sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) * 2**32) for k in range(8)]
    nodes = {}

    def gini(n, y):
        return (y * y + (n - y) * (n - y)) / n

    def grow(t, node, level, members):
        n, y = sum(w for _, w in members), sum(w * data[i][4] for i, w in members)
        nodes[t, node] = (None, None, n, y)
        if level == depth or n < min_split or y in (0, n):
            return
        order = sorted(range(len(limits)), key=lambda f: hashlib.md5(f"{t}:{node}:{f}:{seed}".encode()).hexdigest())
        best = None
        for f in sorted(order[: max(1, math.isqrt(len(limits)))]):
            for b in limits[f]:
                left = [(i, w) for i, w in members if xs[i][f] <= b]
                nl, yl = sum(w for _, w in left), sum(w * data[i][4] for i, w in left)
                if nl < min_leaf or n - nl < min_leaf:
                    continue
                s = gini(nl, yl) + gini(n - nl, y - yl)
                if s - gini(n, y) > 0 and (best is None or s > best[0]):
                    best = (s, f, b, left)
        if best:
            _, f, b, left = best
            nodes[t, node] = (f, b, n, y)
            inside = {i for i, _ in left}
            grow(t, 2 * node, level + 1, left)
            grow(t, 2 * node + 1, level + 1, [m for m in members if m[0] not in inside])

    for t in range(trees):
        members = []
        for i, r in enumerate(data):
            h = int(hashlib.md5(f"{r[0]}:{t}:{seed}".encode()).hexdigest()[:8], 16)
            w = sum(h >= c for c in cdf)
            if w:
                members.append((i, w))
        if members:
            grow(t, 1, 0, members)
    return nodes, xs


@pytest.fixture(scope="module")
def grown(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    return df, FO.grow_forest(df, trees=7, max_depth=4, min_leaf=3, min_split=9, bins=8, numerics=NUMS, categoricals=CATS)


def test_nodes_equal_a_plain_trainer(grown):
    want, _ = plain_forest(rows(), 7, 4, 3, 9, 8, 42)
    got = {(r["tree"], r["node"]): (r["feature"], r["limit"], r["weight"], r["positives"]) for r in grown[1].nodes.collect()}
    assert got == want
    assert all(w >= 9 for f, _, w, _ in got.values() if f is not None) and all(w >= 3 for _, _, w, _ in got.values())
    assert {r["name"] for r in grown[1].features.collect()} == {"size", "age", "kind_y", "kind_é"}


def test_scores_and_importance_equal_a_plain_walk(spark, grown, tmp_path):
    df, forest = grown
    nodes, xs = plain_forest(rows(), 7, 4, 3, 9, 8, 42)

    def leaf(t, x):
        node = 1
        while nodes[t, node][0] is not None:
            f, b, _, _ = nodes[t, node]
            node = 2 * node + (x[f] > b)
        return nodes[t, node][3] / nodes[t, node][2]

    forest.write(str(tmp_path / "m"))
    again = FO.read_forest(spark, str(tmp_path / "m"))
    for r in FO.score(again, df).collect():
        want = sum(leaf(t, xs[r["id"]]) for t in range(7)) / 7
        assert r["success_probability"] == pytest.approx(want, abs=1e-9) and r["prediction"] == float(round(want, 9) > 0.5)
    shares = Counter()
    for t in range(7):
        own = Counter()
        for (u, node), (f, _, n, y) in nodes.items():
            if u == t and f is not None:
                g = lambda n, y: (y * y + (n - y) * (n - y)) / n
                kids = [nodes[t, 2 * node], nodes[t, 2 * node + 1]]
                own[f] += sum(g(k[2], k[3]) for k in kids) - g(n, y)
        for f, v in own.items():
            shares[f] += v / sum(own.values())
    names = {r["feature"]: r["name"] for r in forest.features.collect()}
    got = {r["feature"]: r["importance"] for r in FO.importance(again).collect()}
    assert got == pytest.approx({names[f]: shares[f] / sum(shares.values()) for f in names}, abs=1e-9)


def test_partitions_do_not_change_the_forest(grown):
    df, forest = grown
    other = FO.grow_forest(df.repartition(5), trees=7, max_depth=4, min_leaf=3, min_split=9, bins=8, numerics=NUMS, categoricals=CATS)
    key = ["tree", "node"]
    assert other.nodes.orderBy(*key).collect() == forest.nodes.orderBy(*key).collect()


def test_forests_without_rows_or_splits(spark):
    df = spark.createDataFrame(rows(n=8), SCHEMA)
    kinds = {"numerics": NUMS, "categoricals": CATS, "trees": 3}
    empty = FO.grow_forest(df.where("false"), **kinds)
    assert empty.nodes.count() == 0
    assert {r["success_probability"] for r in FO.score(empty, df).collect()} == {None}
    small = FO.grow_forest(df, **kinds)  # fewer rows than a split needs
    assert small.nodes.where("feature is not null").count() == 0 and small.nodes.where("node <> 1").count() == 0
    assert {r["importance"] for r in FO.importance(small).collect()} == {0.0}


def test_one_prospect_as_a_record(spark):
    cols = "id long, stage string, sector string, country string, label int, " + ", ".join(f"{c} double" for c in FO.P.NUMERIC_FEATURES)
    rng = random.Random(3)
    data = [(i, rng.choice(["Seed", "Series A"]), "saas", "USA", i % 2, *[rng.random() * 50 + 40 * (i % 2) for _ in FO.P.NUMERIC_FEATURES]) for i in range(120)]
    forest = FO.grow_forest(spark.createDataFrame(data, cols), trees=5)
    got = prospects.predict_one(forest, spark, 4e6, "Seed", "SaaS ", None, 6, 2021)
    assert got["is_valid"] and 0 <= got["success_probability"] <= 1 and got["confidence"] and got["country"] == "USA" and got["strengths"]
    bad = prospects.predict_one(forest, spark, -1.0, "Seed")
    assert not bad["is_valid"] and bad["reject_reasons"] and bad["success_probability"] is None and bad["recommendation"] is None
    none = prospects.predict_one(forest, spark, None)
    assert not none["is_valid"] and none["success_probability"] is None


@pytest.mark.parametrize("k", [1, 2, 5, 7])
def test_stratified_folds_are_even(spark, k):
    rng = random.Random(k)
    data = [(i, rng.choice([0, 1, 1, 1, None])) for i in range(93)]
    got = ml.stratified_folds(spark.createDataFrame(data, "id long, success int"), k=k).collect()
    assert sorted((r["id"], r["success"]) for r in got if r["success"] is not None) == sorted(d for d in data if d[1] is not None) and len(got) == 93
    sizes = Counter(r["fold"] for r in got)
    assert set(sizes) == set(range(k)) and max(sizes.values()) - min(sizes.values()) <= 1
    for c in (0, 1, None):
        own = [sum(r["fold"] == f and r["success"] == c for r in got) for f in range(k)]
        assert max(own) - min(own) <= 1
    with pytest.raises(ValueError):
        ml.stratified_folds(spark.createDataFrame(data, "id long, success int"), k=0)
