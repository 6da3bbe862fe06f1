"""Random forest as tables.

The forest is grown level by level with DataFrame aggregates, and the result
is two tables: ``features`` (index, name, source column, category) and
``nodes`` (tree, node, depth, feature, limit, left, right, gain, prediction,
weight, positives). MLlib's forest has no minimum split size and keeps its
trees in vectors; here ``min_split`` is honoured, a model is read with any
SQL engine, and equal rows give equal trees in every run and engine.

- **Features.** Numbers (null counts as 0, rounded to ``DIGITS`` decimals,
  so engines agree) and one 0/1 column per category of the training rows, in
  code-point order, the first of each left out with ``drop_first``. Limits of a number
  are at most ``bins`` - 1 of its training values: the least values that
  k / ``bins`` of the rows don't exceed.
- **Bootstrap.** Each row enters each tree 0, 1, 2, ... times by a Poisson(1)
  draw from md5(key:tree:seed) (Oza and Russell, 2001): no row has to know
  the others.
- **Split.** A node considers int(sqrt(number of features)) features, the least by
  md5(tree:node:feature:seed), and takes the limit with the greatest fall in
  weighted Gini impurity; of equal ones the first feature, then the least
  limit. Both sides keep ``min_leaf`` copies; a node of under ``min_split``
  copies, of one class, or at ``max_depth`` is a leaf.
- **Level.** Tasks send every row down the trees grown so far (numpy, whole
  batches) and add it to the counts of (node, feature, bin) at its open
  nodes; only those sums are shuffled. Windows over them find the best split
  of each node. A task holds one array of trees x open nodes x features
  tried x bins counts, at most 2^(depth - 1) nodes per tree, whatever the
  number of rows; the splits of a level, one row a node, reach the driver.
- **Score.** The mean over trees of the reached leaf's share of successes,
  a numpy walk per Arrow batch with the nodes broadcast; their number is
  bounded by trees x 2^(depth + 1).
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from startlens.functions import params as P
from startlens.operators.stats import prefix_sums
from startlens.session import materialize

DIGITS = 6

#: Poisson(1) in 32 bits: a draw is the number of these that the hash reaches.
POISSON_LIMITS = [math.floor(sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) * 2**32) for k in range(8)]

NODE_SCHEMA = ("tree int, node long, depth int, feature int, limit double, left long, right long, gain double, "
               "prediction double, weight long, positives long")
FEATURE_SCHEMA = "feature int, name string, source string, category string"


@dataclass
class TableForest:
    """A trained forest: its two tables."""

    features: DataFrame
    nodes: DataFrame

    def write(self, path: str) -> None:
        """Both tables as parquet."""
        self.features.coalesce(1).write.mode("overwrite").parquet(f"{path}/features")
        self.nodes.write.mode("overwrite").parquet(f"{path}/nodes")


def read_forest(spark: SparkSession, path: str) -> TableForest:
    return TableForest(spark.read.parquet(f"{path}/features"), spark.read.parquet(f"{path}/nodes"))


# --- features ----------------------------------------------------------------

def feature_table(train: DataFrame, drop_first: bool = True, numerics: list[str] | None = None,
                  categoricals: list[str] | None = None) -> list[tuple[int, str, str, str | None]]:
    """(index, name, source, category): numbers in order, then each column's
    categories. A category column is a vocabulary; its distinct values reach the driver."""
    numerics = numerics or list(P.NUMERIC_FEATURES)
    cats = categoricals or list(P.CATEGORICAL_FEATURES)
    rows = [(c, c, None) for c in numerics]
    found = train.select(F.inline(F.array(*[F.struct(F.lit(c).alias("source"), F.col(c).alias("category")) for c in cats])))
    values = found.where("category is not null").distinct().toArrow().to_pylist()
    for c in cats:
        own = sorted((v["category"] for v in values if v["source"] == c), key=str.encode)
        rows += [(f"{c}_{v}", c, v) for v in own[1 if drop_first else 0 :]]
    return [(i, *r) for i, r in enumerate(rows)]


def feature_values(features: list[tuple]) -> Column:
    """The features of a row as array<double>."""
    out = []
    for _, _, source, category in features:
        if category is None:
            out.append(F.round(F.coalesce(F.col(f"`{source}`").cast("double"), F.lit(0.0)), DIGITS))
        else:
            out.append(F.coalesce(F.col(f"`{source}`") == F.lit(category), F.lit(False)).cast("double"))
    return F.array(*out)


def split_limits(train: DataFrame, features: list[tuple], bins: int) -> dict[int, list[float]]:
    """Ascending limits per feature; a value goes left if it is no more than the limit."""
    numbers = [f for f in features if f[3] is None]
    limits = {f[0]: [0.0] for f in features if f[3] is not None}
    long = train.select(F.posexplode(feature_values(numbers)).alias("pos", "value"))
    counts = long.groupBy("pos", "value").agg(F.count(F.lit(1)).alias("n"))
    cum = prefix_sums(counts, ["value"], ["n"], ["pos"])
    # the value at which a k-th part of the rows is first reached, for some k < bins, but not the last value
    before, after = F.col("n_before") * bins, (F.col("n_before") + F.col("n")) * bins
    k = F.floor(after / F.col("n_total"))
    first = (k * F.col("n_total") > before) & (F.col("n_before") + F.col("n") < F.col("n_total"))
    for r in cum.where(first).select("pos", "value").toArrow().to_pylist():
        limits.setdefault(numbers[r["pos"]][0], []).append(r["value"])
    return {f[0]: sorted(limits.get(f[0], [])) for f in features}


# --- growing -----------------------------------------------------------------

def bootstrap_weights(key: str, trees: int, seed: int) -> Column:
    """Copies of a row in each tree, array<tinyint>."""
    # 32 bits as eight hex digits, which order like the number; hashed in an array of their own, since
    # the draw names them once per limit and a lambda's expressions are evaluated each time
    hashes = F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.substring(
        F.md5(F.concat_ws(":", F.col(key).cast("string"), t.cast("string"), F.lit(str(seed)))), 1, 8))
    return F.transform(hashes, lambda h: sum((h >= F.lit(f"{x:08x}")).cast("byte") for x in POISSON_LIMITS).cast("byte"))


def tried_features(tree: int, node: int, n_features: int, seed: int) -> list[int]:
    """The features a node considers, ascending."""
    order = sorted(range(n_features), key=lambda f: hashlib.md5(f"{tree}:{node}:{f}:{seed}".encode()).digest())
    return sorted(order[: max(1, math.isqrt(n_features))])


class _Grown:
    """Splits found so far, by tree and heap number: feature (-1: none) and bin."""

    def __init__(self, trees: int, max_depth: int):
        self.feature = np.full((trees, 1 << (max_depth + 1)), -1, np.int16)
        self.bin = np.zeros((trees, 1 << (max_depth + 1)), np.int16)

    def walk(self, bins: np.ndarray, copies: np.ndarray, levels: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, tree, node) of the rows that a tree holds and that are ``levels`` levels deep in it."""
        row, tree = np.nonzero(copies)
        node = np.ones(len(row), np.int64)
        for _ in range(levels):
            f = self.feature[tree, node]
            on = f >= 0
            if not on.all():  # the others ended in a leaf
                row, tree, node, f = row[on], tree[on], node[on], f[on]
            node = 2 * node + (bins[row, f] > self.bin[tree, node])
        return row, tree, node


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def _level_counts(table: DataFrame, grown: _Grown, level: int, tried: dict[tuple[int, int], list[int]], n_features: int, n_bins: int) -> DataFrame:
    """(tree, node, feature, bin, n, y) over the open nodes of a level."""
    trees = len(grown.feature)
    m = max(len(v) for v in tried.values())
    slots = np.full((trees, 1 << level), -1, np.int32)
    open_nodes = sorted(tried)
    wanted = np.zeros((len(open_nodes), m), np.int64)
    for s, (t, node) in enumerate(open_nodes):
        slots[t, node - (1 << level)] = s
        wanted[s] = tried[t, node]
    shared = table.sparkSession.sparkContext.broadcast((grown, slots, wanted, np.array(open_nodes, np.int64)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, at, features, nodes = shared.value
        sums = np.zeros((m, len(nodes) * n_bins * 2), np.int64)
        for b in batches:
            if not len(b):
                continue
            bins, copies = _matrix(b.column("bins"), n_features), _matrix(b.column("copies"), trees).astype(np.int64)
            y = b.column("label").to_numpy(zero_copy_only=False).astype(np.int64)
            row, tree, node = own.walk(bins, copies, level)
            slot = at[tree, node - (1 << level)]
            is_open = slot >= 0
            row, tree, slot = row[is_open], tree[is_open], slot[is_open].astype(np.int64)
            n, first = copies[row, tree], slot * (2 * n_bins) + y[row]
            for k in range(m):  # in place: a batch costs its rows, not all the nodes' cells
                np.add.at(sums[k], first + 2 * bins[row, features[slot, k]].astype(np.int64), n)
        by_label = sums.reshape(m, -1, 2)
        total = by_label.sum(axis=2)
        k, cell = np.nonzero(total)
        slot = cell // n_bins
        cols = [nodes[slot, 0], nodes[slot, 1], features[slot, k], cell % n_bins, total[k, cell], by_label[k, cell, 1]]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["tree", "node", "feature", "bin", "n", "y"])

    part = table.select("bins", "copies", "label").mapInArrow(count, "tree long, node long, feature long, bin long, n long, y long")
    # one exchange by node also serves the windows and the choice per node; tasks have already combined their rows
    part = part.repartition("tree", "node")
    return part.groupBy("tree", "node", "feature", "bin").agg(F.sum("n").alias("n"), F.sum("y").alias("y"))


def _pure(n: Column, y: Column) -> Column:
    """n times one less than the Gini impurity's complement: greater is purer."""
    return (y * y + (n - y) * (n - y)).cast("double") / n.cast("double")


def _best_splits(counts: DataFrame, min_leaf: int, min_split: int) -> DataFrame:
    """A row per node: its copies and successes, and its best split (null: none)."""
    side = Window.partitionBy("tree", "node", "feature")
    left = side.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    c = counts.withColumns({"nl": F.sum("n").over(left), "yl": F.sum("y").over(left), "nt": F.sum("n").over(side), "yt": F.sum("y").over(side)})
    nl, yl, nt, yt = (F.col(x) for x in ("nl", "yl", "nt", "yt"))
    score = _pure(nl, yl) + _pure(nt - nl, yt - yl)
    fits = (nl >= min_leaf) & (nt - nl >= min_leaf) & (nt >= min_split) & (yt > 0) & (yt < nt)
    c = c.withColumn("score", F.when(fits, score)).withColumn("gain", F.col("score") - _pure(nt, yt))
    place = F.when(F.col("gain") > 0, F.struct((-F.col("score")).alias("s"), "feature", "bin"))
    best = F.min(place)
    return c.groupBy("tree", "node").agg(
        F.max("nt").alias("weight"), F.max("yt").alias("positives"), best["feature"].alias("feature"), best["bin"].alias("bin"),
        F.min_by("gain", place).alias("gain"),
        F.min_by("nl", place).alias("nl"), F.min_by("yl", place).alias("yl"),
    )


def grow_forest(train: DataFrame, label: str = "label", key: str = "id", trees: int = 100, max_depth: int = 10, min_leaf: int = 10,
                min_split: int = 20, bins: int = 32, seed: int = 42, drop_first: bool = True, numerics: list[str] | None = None,
                categoricals: list[str] | None = None) -> TableForest:
    """Train on the rows of ``train`` whose label is 0 or 1. ``key`` must be
    unique: rows of one key would draw the same copies. Without rows the
    forest has no nodes and scores null."""
    spark = train.sparkSession
    train = train.where(F.col(label).isin(0, 1))
    features = feature_table(train, drop_first, numerics, categoricals)
    limits = split_limits(train, features, bins)
    # a value's bin is the number of its feature's limits that it exceeds
    binned = F.array(*[F.aggregate(F.array(*[F.lit(x) for x in limits[i]]), F.lit(0), lambda a, x: a + (F.get("x", F.lit(i)) > x).cast("int"))
                       if limits[i] else F.lit(0) for i in range(len(features))]).cast("array<smallint>")
    table = train.select(F.col(key).alias("key"), F.col(label).cast("int").alias("label"), feature_values(features).alias("x"))
    table = materialize(table.select("label", binned.alias("bins"), bootstrap_weights("key", trees, seed).alias("copies")), "forest_rows")
    grown, rows = _Grown(trees, max_depth), []
    open_nodes = {(t, 1): None for t in range(trees)}
    n_bins = max(len(v) for v in limits.values()) + 1
    for level in range(max_depth + 1):
        if not open_nodes:
            break
        if level == max_depth:  # what is still open ends as leaves, whose counts the parents' splits gave
            rows += [(t, n, level, None, None, None, None, 0.0, w[1] / w[0], *w) for (t, n), w in open_nodes.items()]
            break
        tried = {k: tried_features(*k, len(features), seed) for k in open_nodes}
        counts = _level_counts(table, grown, level, tried, len(features), n_bins)
        best = _best_splits(counts, min_leaf, min_split).toArrow().to_pylist()
        open_nodes = {}
        for r in best:
            t, node, w, y, f = r["tree"], r["node"], r["weight"], r["positives"], r["feature"]
            if f is None:
                rows.append((t, node, level, None, None, None, None, 0.0, y / w, w, y))
                continue
            grown.feature[t, node], grown.bin[t, node] = f, r["bin"]
            rows.append((t, node, level, f, limits[f][r["bin"]], 2 * node, 2 * node + 1, r["gain"], y / w, w, y))
            for child, n, pos in ((2 * node, r["nl"], r["yl"]), (2 * node + 1, w - r["nl"], y - r["yl"])):
                if level + 1 < max_depth and n >= min_split and 0 < pos < n:
                    open_nodes[t, child] = None
                else:
                    rows.append((t, child, level + 1, None, None, None, None, 0.0, pos / n, n, pos))
    names = [c.split(" ")[0] for c in NODE_SCHEMA.split(", ")]
    nodes = pa.table({c: pa.array([r[k] for r in rows], pa.float64() if c in ("limit", "gain", "prediction") else pa.int64()) for k, c in enumerate(names)})
    casts = [F.col(c.split(" ")[0]).cast(c.split(" ")[1]) for c in NODE_SCHEMA.split(", ")]
    about = spark.createDataFrame(features, FEATURE_SCHEMA)
    return TableForest(about, materialize(spark.createDataFrame(nodes).select(*casts), "forest_nodes"))


# --- reading the tables --------------------------------------------------------

def importance(forest: TableForest) -> DataFrame:
    """(feature, importance): each tree's impurity falls by feature, as
    shares of the tree's, averaged over the trees that split and made to sum to 1."""
    split = forest.nodes.where("feature is not null")
    per = split.groupBy("tree", "feature").agg(F.sum("gain").alias("gain"))
    whole = split.groupBy("tree").agg(F.sum("gain").alias("total"))
    shares = per.join(whole, "tree").groupBy("feature").agg(F.sum(F.col("gain") / F.col("total")).alias("s"))
    total = shares.agg(F.sum("s")).scalar()
    out = forest.features.join(shares, "feature", "left")
    return out.select(F.col("name").alias("feature"), F.coalesce(F.col("s") / total, F.lit(0.0)).alias("importance"))


def top_importance(forest: TableForest, top_n: int = 15) -> DataFrame:
    """M14 + D16: the first ``top_n`` features with rank and cumulative share
    (equal shares, to nine decimals, by name). As many rows as features are ordered."""
    w = Window.orderBy(F.desc(F.round("importance", 9)), F.asc("feature"))
    out = importance(forest).withColumn("rank", F.row_number().over(w))
    out = out.withColumn("cumulative", F.sum("importance").over(Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)))
    return out.where(F.col("rank") <= top_n)


def score(forest: TableForest, df: DataFrame, out_col: str = "success_probability") -> DataFrame:
    """``df`` with the mean leaf prediction of all trees, to nine decimals,
    and ``prediction`` 1 where it is above 0.5 (both null for a forest without nodes)."""
    spark = df.sparkSession
    features = [tuple(r.values()) for r in forest.features.orderBy("feature").toArrow().to_pylist()]
    nodes = forest.nodes.orderBy("tree", "node").toArrow()
    if not len(nodes):
        return df.withColumn(out_col, F.lit(None).cast("double")).withColumn("prediction", F.lit(None).cast("double"))
    tree, node = nodes["tree"].to_numpy(), nodes["node"].to_numpy()
    at = {k: i for i, k in enumerate(zip(tree.tolist(), node.tolist()))}
    roots = np.array([at[t, 1] for t in sorted(set(tree.tolist()))])
    feature = np.array([-1 if f is None else f for f in nodes["feature"].to_pylist()])
    left = np.array([at.get((t, n), i) for i, (t, n) in enumerate(zip(tree.tolist(), nodes["left"].to_pylist()))])
    right = np.array([at.get((t, n), i) for i, (t, n) in enumerate(zip(tree.tolist(), nodes["right"].to_pylist()))])
    limit = np.array([0.0 if x is None else x for x in nodes["limit"].to_pylist()])
    prediction, depth, width = nodes["prediction"].to_numpy(), max(nodes["depth"].to_pylist()), len(features)
    shared = spark.sparkContext.broadcast((roots, feature, limit, left, right, prediction))

    @F.arrow_udf("double")
    def walk(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        start, f, lim, lo, hi, pred = shared.value
        for b in batches:
            x = _matrix(b, width)
            i = np.tile(start, (len(x), 1))
            rows = np.arange(len(x))[:, None]
            for _ in range(depth):
                i = np.where(x[rows, np.maximum(f[i], 0)] <= lim[i], lo[i], hi[i])
            yield pa.array(pred[i].mean(axis=1))

    out = df.withColumn(out_col, F.round(walk(feature_values(features)), 9))
    return out.withColumn("prediction", (F.col(out_col) > 0.5).cast("double"))
