"""Summary and quality reports.

Every report is one aggregation pass over the input followed by a
``stack``/``unpivot`` into a long table -- never one action per column.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from startlens.functions import params as P
from startlens.operators.kpi import KPI_COLUMNS
from startlens.operators.stats import exact_percentiles

QUALITY_COLUMNS = ["company", "stage", "country", "sector", "funding_amount", "investors_count", "founded_year"]


def quality_grade(pct_col: str = "missing_pct"):
    """A3: complete (0 %) / good (< 20 %) / fair (< 50 %) / poor."""
    c = F.col(pct_col)
    expr = F.when(c == 0, P.QUALITY_GRADES[0][1])
    for bound, label in P.QUALITY_GRADES[1:]:
        expr = expr.when(c < bound, label)
    return expr.otherwise(P.QUALITY_GRADE_WORST)


def _stack(pairs: list[tuple[str, list]], names: list[str]):
    """``stack(n, 'a', x1, y1, 'b', x2, y2, ...)`` as a generator column."""
    args = []
    for label, vals in pairs:
        args.append(F.lit(label))
        args.extend(vals)
    return F.inline(F.array(*[F.struct(*[a.alias(n) for a, n in zip(args[i:i + len(names)], names)])
                              for i in range(0, len(args), len(names))]))


def quality_report(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """A2+A3: (column, missing, missing_pct, grade) for each column, one pass."""
    cols = [c for c in (columns or QUALITY_COLUMNS) if c in df.columns]
    aggs = [F.count(F.lit(1)).alias("__n")] + [F.count_if(F.col(c).isNull()).alias(f"m_{i}") for i, c in enumerate(cols)]
    one = df.agg(*aggs)
    long = one.select(
        "__n",
        _stack([(c, [F.col(f"m_{i}")]) for i, c in enumerate(cols)], ["column", "missing"]),
    )
    pct = F.try_divide(F.col("missing") * F.lit(100.0), F.col("__n"))
    return long.select("column", "missing", pct.alias("missing_pct")).withColumn("grade", quality_grade())


def kpi_summary(df: DataFrame, kpis: Sequence[str] | None = None, approximate_median: bool = False) -> DataFrame:
    """A4: mean, median, sample std, min, max for each KPI (long table)."""
    kpis = [k for k in (kpis or KPI_COLUMNS) if k in df.columns]
    long = df.select(F.explode(F.array(*[F.struct(F.lit(k).alias("kpi"), F.col(k).cast("double").alias("value")) for k in kpis])).alias("kv")).select("kv.*")
    long = long.where(F.col("value").isNotNull())
    moments = long.groupBy("kpi").agg(
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        F.count("value").alias("count"),
    )
    med = exact_percentiles(long, "value", [0.5], ["kpi"], ["median"], approximate=approximate_median)
    return moments.join(med, "kpi", "left").select("kpi", "count", "mean", "median", "std", "min", "max")


def score_summary(df: DataFrame, score_col: str = "investment_score", approximate: bool = False, bounded_grid: bool = False) -> DataFrame:
    """A5: mean, median, std, min, q25, q75, max of the score (one row).

    The investment score is rounded to 2 decimals within [0, 100] (default
    weights), so it takes at most 10,001 values: a caller who knows that may
    pass ``bounded_grid``, and the exact quartiles come from one single-pass
    aggregate. Other scores (custom weights, unrounded) need the default.
    """
    keyed = df.select(F.lit(score_col).alias("metric"), F.col(score_col).cast("double").alias("value"))
    moments = keyed.groupBy("metric").agg(
        F.count("value").alias("count"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    q = exact_percentiles(keyed, "value", [0.25, 0.5, 0.75], ["metric"], ["q25", "median", "q75"], approximate=approximate,
                          bounded_grid=bounded_grid)
    return moments.join(q, "metric", "left").select("metric", "count", "mean", "median", "std", "min", "q25", "q75", "max")


def score_bands(df: DataFrame, score_col: str = "investment_score", close_top: bool = False) -> DataFrame:
    """Count and percent of *all* rows per half-open band [lo, hi).

    One pass with a conditional count per band; empty bands are kept.
    ``close_top`` makes the top band include its upper edge (100).
    """
    s = F.col(score_col)
    aggs = [F.count(F.lit(1)).alias("__n")]
    for i, (lo, hi, _label) in enumerate(P.SCORE_BANDS):
        upper = (s <= hi) if (close_top and i == 0) else (s < hi)
        aggs.append(F.count_if((s >= lo) & upper).alias(f"b_{i}"))
    one = df.agg(*aggs)
    rows = []
    for i, (lo, hi, label) in enumerate(P.SCORE_BANDS):
        rows.append((label, [F.lit(float(lo)), F.lit(float(hi)), F.col(f"b_{i}")]))
    long = one.select("__n", _stack(rows, ["band", "low", "high", "companies"]))
    return long.select("band", "low", "high", "companies",
                       F.try_divide(F.col("companies") * F.lit(100.0), F.col("__n")).alias("pct"))


def stage_counts(df: DataFrame, top: int = 10, col: str = "stage") -> DataFrame:
    """Value counts of a column, descending, NULL dropped, top N."""
    return (
        df.where(F.col(col).isNotNull())
        .groupBy(col)
        .agg(F.count(F.lit(1)).alias("companies"))
        .orderBy(F.desc("companies"), F.asc(col))
        .limit(top)
    )


def distribution(df: DataFrame, col: str) -> DataFrame:
    """Count and share of each value (NULL kept as its own value)."""
    counts = df.groupBy(col).agg(F.count(F.lit(1)).alias("companies"))
    total = df.select(F.count(F.lit(1))).scalar()
    return counts.withColumn("share", F.col("companies") / total)


def distributions(df: DataFrame, cols: list[str]) -> DataFrame:
    """D15 for several columns in one pass: (dimension, value, companies,
    share), NULL kept as its own value."""
    pairs = F.array(*[F.struct(F.lit(c).alias("dimension"), F.col(c).cast("string").alias("value")) for c in cols])
    counts = df.select(F.inline(pairs)).groupBy("dimension", "value").agg(F.count(F.lit(1)).alias("companies"))
    total = F.sum("companies").over(Window.partitionBy("dimension"))
    return counts.withColumn("share", F.col("companies") / total)


def load_funnel(objects: DataFrame, min_funding: float = 0, entity_col: str = "entity_type", funding_col: str = "funding_total_usd") -> DataFrame:
    """Rows kept after each loader step, computed in one pass."""
    is_co = F.col(entity_col) == "Company" if entity_col in objects.columns else F.lit(True)
    funded = is_co & (F.col(funding_col) > 0)
    steps = [("raw", F.count(F.lit(1))), ("companies", F.count_if(is_co)), ("funded", F.count_if(funded))]
    if min_funding and min_funding > 0:
        steps.append(("min_funding", F.count_if(funded & (F.col(funding_col) >= F.lit(float(min_funding))))))
    one = objects.agg(*[e.alias(f"s_{i}") for i, (_, e) in enumerate(steps)])
    long = one.select(_stack([(name, [F.lit(i), F.col(f"s_{i}")]) for i, (name, _) in enumerate(steps)], ["step", "step_no", "rows"]))
    return long.select("step_no", "step", "rows")


def column_bounds(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Whole-column min, max and mean, one row per column."""
    one = df.agg(*[e for i, c in enumerate(cols) for e in (
        F.min(c).cast("double").alias(f"mn_{i}"), F.max(c).cast("double").alias(f"mx_{i}"), F.avg(c).alias(f"av_{i}"))])
    return one.select(_stack([(c, [F.col(f"mn_{i}"), F.col(f"mx_{i}"), F.col(f"av_{i}")]) for i, c in enumerate(cols)],
                             ["column", "min", "max", "mean"]))
