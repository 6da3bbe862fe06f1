"""Exact cosine range join of embeddings (operator 3).

Vectors of one label are compared on the unit sphere, where the chord
``d(x, y) = sqrt(2 - 2 cos)`` is a metric and ``cos >= min_cosine`` is ``d <=
r``. Equal vectors of a label form one class with a multiplicity.

1. Every label with more than ``cell`` classes gets pivots, a hash sample of
   its own vectors, about one per ``cell`` classes and at most ``max_pivots``
   for all labels together; they are broadcast.
2. A class belongs to the cell of its nearest pivot. By the triangle
   inequality a vector of cell j within r of x lies no nearer to x's pivot
   than d(x, p_j) - r, so x is also copied to each cell j with
   ``d(x, p_j) <= d(x, p_i) + 2 r`` and ``d(x, p_j) <= radius_j + r``.
3. Cells join independently. A cell's own vectors meet its own and its
   copied ones in blocks of ``block``, one task per pair of blocks, so a
   cell that a third of all vectors fall in is many tasks. A task computes
   double-precision products, returns link counts per class, and joins its
   links to components of its own, of which it returns one link per class:
   links are never written as pairs.
4. Counts are summed, and components come from :mod:`graph`.

A vector links with nothing if its label or vector is null, empty, zero or
holds a null or a non-finite component; vectors of different lengths never
link. Rows that share a vec_id are one node of the components; each is
counted as a vector of its own, with the links of its own vector. A row without a
vec_id (or with one that is no whole number) links with nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from startlens.llm.graph import connected_components, least_ids, same_id_links
from startlens.session import materialize

#: Added to bounds, so that rounding of distances never loses a copy.
SLACK = 1e-9


def _unit(vectors) -> np.ndarray:
    v = np.array(vectors, np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)  # no overflow or underflow of the squares
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _chord(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (x @ y.T)))


def _exact(x: np.ndarray, y: np.ndarray, min_cosine: float) -> np.ndarray:
    """Which pairs reach the cosine; sums near the limit are redone with fsum."""
    cos = x @ y.T
    out = cos >= min_cosine
    for i, j in np.argwhere(np.abs(cos - min_cosine) < 1e-13):
        out[i, j] = math.fsum(x[i] * y[j]) >= min_cosine
    return out


def block_result(table: pa.Table, min_cosine: float) -> tuple[list, list, list]:
    """(class, linked vectors, least class of its component within the block pair)."""
    ids, own, many = table["id"].to_numpy(), table["own"].to_numpy(zero_copy_only=False), table["copies"].to_numpy()
    mine, other = np.flatnonzero(own), np.flatnonzero(table["other"].to_numpy(zero_copy_only=False))
    if not len(mine) or not len(other):
        return [], [], []
    unit = _unit(table["v"].to_pylist())
    link = _exact(unit[mine], unit[other], min_cosine) & (ids[mine][:, None] != ids[other])
    n = link @ many[other]
    row, col = np.nonzero(link)
    label = {int(x): int(x) for x in ids}
    at = np.arange(len(ids))
    root = ids.copy()
    a, b = mine[row], other[col]
    while len(a):  # least label spreads over the links of this pair of blocks
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        if (new == root).all():
            break
        root = new
    touched = np.unique(np.concatenate([mine[n > 0], b])) if len(a) else at[:0]
    count = np.zeros(len(ids), np.int64)
    count[mine] = n
    return ids[touched].tolist(), count[touched].tolist(), root[touched].tolist()


def range_join(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    min_cosine: float = 0.93,
    cell: int = 1000,
    max_pivots: int = 8192,
    block: int = 1024,
) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per row of ``vectors``."""
    spark = vectors.sparkSession
    radius = math.sqrt(2.0 - 2.0 * min_cosine)
    v = F.col(vector_col).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & (F.size(v) > 0) & ~bad & F.exists(v, lambda x: x != 0)
    rows = vectors.select(
        F.col(id_col).alias("id"), F.col(label_col).alias("label"), v.alias("v"), F.coalesce(usable, F.lit(False)).alias("usable")
    )
    # -0.0 and 0.0 are one value
    rows = rows.withColumn("v", F.when(F.col("usable"), F.transform("v", lambda x: x + F.lit(0.0))))
    rows = materialize(rows.withColumn("key", F.when(F.col("usable"), F.sha2(F.to_json(F.struct("label", "v")).cast("binary"), 256))), "vectors")
    classes = rows.where("usable").groupBy("key").agg(
        F.count(F.lit(1)).alias("copies"), F.first("label").alias("label"), F.first("v").alias("v")
    )
    # vectors of another length are another space; ids can repeat on other vectors, so a class goes by
    # a number, which storing the table fixes
    number = F.monotonically_increasing_id().alias("id")
    classes = classes.select("key", number, "copies", F.struct("label", F.size("v").alias("size")).alias("space"), "v")
    classes = materialize(classes, "vector_classes")

    spaces = classes.groupBy("space").agg(F.count(F.lit(1)).alias("n"))
    total = max(1, classes.count())
    share = F.least(F.col("n") / F.lit(float(cell)), F.col("n") * F.lit(max_pivots / 2.0) / F.lit(float(total)))
    draw = (F.pmod(F.xxhash64("key"), F.lit(1 << 40)) / F.lit(float(1 << 40))).alias("u")
    sample = classes.select("space", "v", draw, "key").join(spaces.where(F.col("n") > cell), "space")
    sample = sample.where(F.col("u") < share / F.col("n")).orderBy("u", "key").limit(max_pivots)
    pivots: dict = {}
    for r in sample.select("space", "v").collect():  # at most max_pivots vectors
        pivots.setdefault(tuple(r["space"]), []).append(r["v"])
    shared = spark.sparkContext.broadcast({k: _unit(p) for k, p in pivots.items()})

    @F.arrow_udf("array<struct<cell:int,far:double,gap:double>>")
    def reach(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.struct([("cell", pa.int32()), ("far", pa.float64()), ("gap", pa.float64())]))
        for space, vs in batches:
            keys = [tuple(x.values()) for x in space.to_pylist()]
            out: list = [None] * len(keys)
            groups: dict = {}
            for k, x in enumerate(keys):
                groups.setdefault(x, []).append(k)
            data = vs.to_pylist()
            for x, members in groups.items():
                p = shared.value.get(x)
                if p is None:
                    for k in members:
                        out[k] = [{"cell": 0, "far": 0.0, "gap": 0.0}]
                    continue
                for lo in range(0, len(members), 1024):
                    part = members[lo : lo + 1024]
                    d = _chord(_unit([data[k] for k in part]), p)
                    near = d.argmin(axis=1)
                    for k, row, i in zip(part, d, near):
                        hit = np.flatnonzero(row <= row[i] + 2 * radius + SLACK)
                        # the nearest first
                        cells = [i, *hit[hit != i]]
                        out[k] = [{"cell": int(c), "far": float(row[c]), "gap": float(row[c] - row[i])} for c in cells]
            yield pa.array(out, kind)

    reached = materialize(classes.withColumn("reach", reach("space", "v")), "reach")
    home = F.col("reach")[0]
    cells = reached.groupBy("space", home["cell"].alias("cell")).agg(
        F.max(home["far"]).alias("radius"), F.count(F.lit(1)).alias("n_own")
    )
    spread = reached.select("id", "copies", "space", "v", F.posexplode("reach").alias("pos", "r"))
    spread = spread.select("id", "copies", "space", "v", F.col("r.cell").alias("cell"), (F.col("pos") == 0).alias("own"), F.col("r.far").alias("far"))
    spread = spread.join(cells, ["space", "cell"]).where(F.col("own") | (F.col("far") <= F.col("radius") + F.lit(radius + SLACK)))
    sizes = spread.groupBy("space", "cell").agg(F.count(F.lit(1)).alias("n_all"))
    spread = spread.join(sizes, ["space", "cell"])
    own_blocks, all_blocks = (F.ceil(F.col(c) / F.lit(block)).cast("int") for c in ("n_own", "n_all"))
    mine = F.pmod(F.xxhash64("id"), own_blocks).cast("int")
    other = F.pmod(F.xxhash64("id", F.lit(1)), all_blocks).cast("int")
    as_other = F.transform(F.sequence(F.lit(0), own_blocks - 1), lambda k: F.struct(k.alias("i"), other.alias("j")))
    as_own = F.when(
        F.col("own"), F.transform(F.sequence(F.lit(0), all_blocks - 1), lambda k: F.struct(mine.alias("i"), k.alias("j")))
    ).otherwise(F.array().cast("array<struct<i:int,j:int>>"))
    tasks = spread.withColumns({"__o": other, "__m": mine}).withColumn("t", F.explode(F.array_union(as_own, as_other)))
    tasks = tasks.select(
        "space", "cell", F.col("t.i").alias("i"), F.col("t.j").alias("j"), "id", "copies", "v",
        (F.col("own") & (F.col("t.i") == F.col("__m"))).alias("own"), (F.col("t.j") == F.col("__o")).alias("other"),
    )

    def compare(table: pa.Table) -> pa.Table:
        a, n, b = block_result(table, min_cosine)
        return pa.table({"a": pa.array(a, pa.int64()), "n": pa.array(n, pa.int64()), "b": pa.array(b, pa.int64())})

    found = materialize(tasks.groupBy("space", "cell", "i", "j").applyInArrow(compare, "a long, n long, b long"), "vector_links")
    counts = found.groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("linked"))
    named = classes.select(F.col("key").alias("k"), F.col("id").alias("rep"), "copies").join(counts, "rep", "left")
    out = materialize(rows.select("id", "key").join(named, F.col("key") == F.col("k"), "left"), "counted")
    members = out.where("rep is not null").select("id", F.col("rep").alias("node")).distinct()
    comps = connected_components(found.select("a", "b").unionByName(same_id_links(members)))
    out = out.join(least_ids(members, comps).withColumnRenamed("id", "i"), F.col("id") == F.col("i"), "left")
    component = F.coalesce("component_id", "id")
    return out.select(
        F.col("id").alias("vec_id"),
        (F.coalesce("linked", F.lit(0)) + F.coalesce(F.col("copies") - 1, F.lit(0))).cast("long").alias("n_links"),
        component.cast("long").alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
    )
