"""Distributed exact statistics used by the report and analysis operators.

``exact_percentiles`` computes linear-interpolation percentiles (the
definition of pandas ``quantile``/``median`` and DuckDB ``quantile_cont``)
without holding all values of a group in one task:

1. collapse to distinct (group, value) pairs with their multiplicity -- a
   keyed aggregate with map-side combine, so a value repeated by a third of
   all rows becomes one row early;
2. range-partition the distinct pairs on (group, value) -- the sampled
   bounds split even one huge group over many partitions -- and store them
   once in the checkpoint folder;
3. running counts inside each (partition, group) slice, plus the count of
   the group in all earlier partitions (a table of partitions x groups,
   broadcast back);
4. pick, per group and probability, the values at the floor and ceiling
   positions and interpolate.

Spark's own ``percentile`` keeps a value -> count map per group and merges
all of a group's maps in one task; ``percentile_approx`` is bounded but
approximate. Use ``approximate=True`` for the latter.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from startlens.operators.joins import join_group_table
from startlens.session import materialize


def prefix_sums(
    df: DataFrame,
    order_cols: Sequence[str],
    sum_cols: Sequence[str],
    group_cols: Sequence[str] = (),
    num_partitions: int | None = None,
) -> DataFrame:
    """Running totals in (group, order) order without a one-task window.

    Adds ``<c>_before`` (sum of ``c`` over the group's earlier rows) and
    ``<c>_total`` (sum over the whole group) for every ``c`` in
    ``sum_cols``. Rows are range-partitioned on (group, order) and stored
    once in the checkpoint folder; each row's total is its running sum
    inside its (partition, group) slice plus the group's sum in all earlier
    partitions. The partition table holds at most partitions x groups rows.
    ``order_cols`` should be unique within a group.
    """
    groups = list(group_cols)
    spark = df.sparkSession
    nparts = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col(g) for g in groups] + [F.col(c) for c in order_cols]
    ranged = materialize(
        df.repartitionByRange(nparts, *order).sortWithinPartitions(*order).withColumn("__pid", F.spark_partition_id())
    )
    slice_w = Window.partitionBy("__pid", *groups).orderBy(*order_cols).rowsBetween(Window.unboundedPreceding, -1)
    local = ranged.withColumns({f"__{c}_loc": F.coalesce(F.sum(c).over(slice_w), F.lit(0)) for c in sum_cols})
    part_tot = ranged.groupBy("__pid", *groups).agg(*[F.sum(c).alias(f"__{c}_pt") for c in sum_cols])
    prior_w = (Window.partitionBy(*groups) if groups else Window.partitionBy()).orderBy("__pid").rowsBetween(
        Window.unboundedPreceding, -1
    )
    total_w = Window.partitionBy(*groups) if groups else Window.partitionBy()
    offsets = part_tot.select(
        "__pid",
        *groups,
        *[F.coalesce(F.sum(f"__{c}_pt").over(prior_w), F.lit(0)).alias(f"__{c}_off") for c in sum_cols],
        *[F.sum(f"__{c}_pt").over(total_w).alias(f"{c}_total") for c in sum_cols],
    )
    # NULL is a group of its own: join null-safely on the group keys. Without
    # groups the offset table has a row per partition, a size set by configuration.
    out = join_group_table(local, offsets if groups else F.broadcast(offsets), ["__pid", *groups], how="inner")
    out = out.withColumns({f"{c}_before": F.col(f"__{c}_off") + F.col(f"__{c}_loc") for c in sum_cols})
    return out.drop("__pid", *[f"__{c}_{s}" for c in sum_cols for s in ("loc", "off")])


def exact_percentiles(
    df: DataFrame,
    value_col: str,
    probs: Sequence[float],
    group_cols: Sequence[str] = (),
    names: Sequence[str] | None = None,
    approximate: bool = False,
    num_partitions: int | None = None,
    bounded_grid: bool = False,
) -> DataFrame:
    """One row per group: a column per probability (``names`` or p_<x>).

    NULL values are ignored; a group without values gets no row.

    ``bounded_grid``: the caller guarantees the values lie on a small fixed
    grid (e.g. the investment score: 2 decimals in [0, 100], at most 10,001
    values). Then Spark's exact single-pass ``percentile`` is safe -- its
    value -> count map per group is bounded by the grid -- and is used.
    """
    names = list(names) if names else [f"p_{str(p).replace('.', '_')}" for p in probs]
    groups = list(group_cols)
    v = F.col(value_col).cast("double")
    base = df.select(*groups, v.alias("__v")).where(F.col("__v").isNotNull() & ~F.isnan("__v"))
    if approximate:
        return base.groupBy(*groups).agg(
            *[F.percentile_approx("__v", float(p), 100000).alias(n) for p, n in zip(probs, names)]
        )
    if bounded_grid:
        return base.groupBy(*groups).agg(*[F.percentile("__v", float(p)).alias(n) for p, n in zip(probs, names)])

    distinct = base.groupBy(*groups, "__v").agg(F.count(F.lit(1)).alias("__c"))
    pos = prefix_sums(distinct, ["__v"], ["__c"], groups, num_partitions)
    pos = pos.withColumn("__start", F.col("__c_before")).withColumn("__end", F.col("__c_before") + F.col("__c")).withColumn(
        "__n", F.col("__c_total")
    )

    aggs = []
    for p, n in zip(probs, names):
        h = F.lit(float(p)) * (F.col("__n") - 1)
        lo = F.floor(h)
        hi = F.ceil(h)
        in_lo = (F.col("__start") <= lo) & (lo < F.col("__end"))
        in_hi = (F.col("__start") <= hi) & (hi < F.col("__end"))
        aggs += [
            F.max(F.when(in_lo, F.col("__v"))).alias(f"{n}__lo"),
            F.max(F.when(in_hi, F.col("__v"))).alias(f"{n}__hi"),
            F.max(h - lo).alias(f"{n}__frac"),
        ]
    picked = pos.groupBy(*groups).agg(*aggs)
    out = [F.col(g) for g in groups]
    for n in names:
        lo_v, hi_v, fr = F.col(f"{n}__lo"), F.col(f"{n}__hi"), F.col(f"{n}__frac")
        out.append((lo_v + (hi_v - lo_v) * fr).alias(n))
    return picked.select(*out)
