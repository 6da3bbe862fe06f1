"""Analyses described beside the method.

Each is a plain table operation: keyed aggregates joined back on their
key (never a window over a whole group), projections, and a generator for
scenario expansion.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from startlens.functions import params as P
from startlens.operators.joins import join_group_table
from startlens.operators.stats import exact_percentiles


def stage_baseline(train: DataFrame, test: DataFrame, label: str = "label", stage: str = "stage") -> DataFrame:
    """Naive baseline -- each test company gets its stage's training
    success rate (and mean funding); unknown stages get the overall rate.

    The per-stage table has one row per stage value (``join_group_table``).
    """
    per = train.groupBy(stage).agg(
        F.avg(F.col(label).cast("double")).alias("stage_success_rate"),
        F.avg("funding_amount").alias("stage_mean_funding"),
        F.count(F.lit(1)).alias("stage_train_rows"),
    )
    overall = train.select(F.avg(F.col(label).cast("double"))).scalar()
    j = join_group_table(test, per, [stage])
    return j.withColumn("baseline_probability", F.coalesce(F.col("stage_success_rate"), overall))


def time_split(df: DataFrame, cutoff_year: int, year_col: str = "founded_year") -> DataFrame:
    """Train side = founded before ``cutoff_year``; test = from it on;
    rows without a year are set aside."""
    y = F.col(year_col)
    return df.withColumn("time_side", F.when(y < cutoff_year, "train").when(y >= cutoff_year, "test").otherwise("unknown"))


def impute_group_median(df: DataFrame, value: str = "investors_count", groups: Sequence[str] = ("stage", "sector")) -> DataFrame:
    """Fill missing ``value`` with the exact median of its group.

    Groups with no known value keep NULL. The medians are a keyed
    aggregate (distributed exact percentiles) joined back on the group key.
    """
    g = list(groups)
    med = exact_percentiles(df, value, [0.5], g, ["__median"])
    j = join_group_table(df, med, g)
    return j.withColumn(f"{value}_imputed", F.coalesce(F.col(value).cast("double"), F.col("__median"))).drop("__median")


SCENARIOS = [
    ("base", 1.0, 0),
    ("funding -10%", 0.9, 0),
    ("funding +10%", 1.1, 0),
    ("investors -1", 1.0, -1),
    ("investors +1", 1.0, 1),
]


def rolling_time_splits(df: DataFrame, cutoffs: Sequence[int], year_col: str = "founded_year") -> DataFrame:
    """D9 (rolling): walk-forward splits -- for each cutoff year Y, rows
    founded before Y train and rows founded in Y test. Each row is
    expanded over the cutoffs by a literal-array generator (no join); rows
    on neither side of a cutoff are dropped for it."""
    y = F.col(year_col)
    arr = F.array(*[F.lit(int(c)) for c in cutoffs])
    x = df.select("*", F.explode(arr).alias("cutoff_year"))
    side = F.when(y < F.col("cutoff_year"), "train").when(y == F.col("cutoff_year"), "test")
    return x.withColumn("time_side", side).where(F.col("time_side").isNotNull())


def walk_forward(df: DataFrame, label: str = "label", year_col: str = "founded_year", group: str = "stage") -> DataFrame:
    """D8 + D9: every cut-off year at once -- rows founded before it train,
    rows founded in it test -- with the group baseline's accuracy there.

    One aggregate gives rows and successes per (year, group). Running
    totals over years give each cut-off's training counts, and a group's
    running totals its success rate before the cut-off; the baseline
    predicts success where that rate (or, for a group not seen before, the
    overall rate) is at least one half. No row is copied per cut-off: after the aggregate
    there are years x groups rows, and the windows run over these alone.

    Columns: cutoff_year, train_rows, train_successes, test_rows,
    test_successes, correct, accuracy; a cut-off without training rows is
    left out. Rows without a year, or whose label isn't 0 or 1, take no part.
    """
    y = F.col(label).cast("int")
    known = df.where(F.col(year_col).isNotNull() & y.isin(0, 1))
    cells = known.groupBy(F.col(year_col).alias("cutoff_year"), F.col(group).alias("__g")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(y).alias("pos")
    )
    earlier = Window.orderBy("cutoff_year").rangeBetween(Window.unboundedPreceding, -1)
    in_group = Window.partitionBy("__g").orderBy("cutoff_year").rangeBetween(Window.unboundedPreceding, -1)
    none = F.lit(0)
    cells = cells.withColumns({
        "gn": F.coalesce(F.sum("n").over(in_group), none), "gpos": F.coalesce(F.sum("pos").over(in_group), none),
        "tn": F.coalesce(F.sum("n").over(earlier), none), "tpos": F.coalesce(F.sum("pos").over(earlier), none),
    })
    says = F.when(F.col("gn") > 0, 2 * F.col("gpos") >= F.col("gn")).otherwise(2 * F.col("tpos") >= F.col("tn"))
    correct = F.when(says, F.col("pos")).otherwise(F.col("n") - F.col("pos"))
    out = cells.where("tn > 0").groupBy("cutoff_year").agg(
        F.max("tn").alias("train_rows"), F.max("tpos").alias("train_successes"),
        F.sum("n").alias("test_rows"), F.sum("pos").alias("test_successes"), F.sum(correct).alias("correct"),
    )
    return out.withColumn("accuracy", F.col("correct") / F.col("test_rows"))


BENCHMARK_SHIFTS = [-10, 0, 10]


def benchmark_sensitivity(kpis: DataFrame, shifts: Sequence[float] = BENCHMARK_SHIFTS, weights=None) -> DataFrame:
    """Re-score every company with all Rule-of-40 stage benchmarks
    moved by each shift (points). Traction and the other KPIs do not depend
    on the benchmark, so only Rule of 40, its norm and the score change.
    The shifts are a literal array exploded per row (a generator)."""
    from startlens.operators.kpi import rule_of_40
    from startlens.operators.score import calculate_investment_score

    x = kpis.drop("rule_of_40").select("*", F.explode(F.array(*[F.lit(float(v)) for v in shifts])).alias("benchmark_shift"))
    x = rule_of_40(x, benchmark_shift=F.col("benchmark_shift"))
    return calculate_investment_score(x, weights)


def sensitivity(prospects: DataFrame, scenarios: Sequence[tuple[str, float, int]] = SCENARIOS) -> DataFrame:
    """Re-score each prospect under input changes (funding factor,
    investor delta). Scenarios are a fixed literal array exploded per row
    (a generator, not a join)."""
    from startlens.operators.prospects import prospect_kpis

    arr = F.array(*[F.struct(F.lit(n).alias("scenario"), F.lit(float(f)).alias("f"), F.lit(int(d)).alias("d")) for n, f, d in scenarios])
    x = prospects.select("*", F.explode(arr).alias("__s"))
    x = x.withColumns(
        {
            "scenario": F.col("__s.scenario"),
            "funding_amount": F.col("funding_amount") * F.col("__s.f"),
            "investors_count": F.col("investors_count") + F.col("__s.d"),
        }
    ).drop("__s")
    return prospect_kpis(x)


def composite_score(rules_score: str = "investment_score", probability: str = "success_probability", traction: str = "traction_index"):
    """40 % rules score + 40 % model probability (x100) + 20 % traction."""
    return F.col(rules_score) * 0.4 + F.col(probability) * 100 * 0.4 + F.col(traction) * 0.2


def within_group_minmax(df: DataFrame, value: str, group: str = "sector", out: str | None = None) -> DataFrame:
    """Min-max scale ``value`` to 0-100 within each group (versus the
    global bounds). Group bounds come from a keyed aggregate with map-side
    combine, joined back on the group key after a size check; equal bounds
    give 50."""
    out = out or f"{value}_{group}_norm"
    b = df.groupBy(group).agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"))
    j = join_group_table(df, b, [group])
    lo, hi, v = F.col("__lo"), F.col("__hi"), F.col(value)
    scaled = F.when(hi == lo, F.when(v.isNotNull(), F.lit(50.0))).otherwise((v - lo) / (hi - lo) * 100)
    return j.withColumn(out, scaled).drop("__lo", "__hi")


def pivot_counts(df: DataFrame, rows: str = "sector", cols: str = "stage", values: Sequence[str] | None = None) -> DataFrame:
    """Counts of ``rows`` x ``cols`` (heat-map data). Listing the
    column values up front avoids the extra distinct pass of ``pivot``."""
    values = list(values) if values is not None else list(P.STAGE_PARAMS.keys())
    return df.groupBy(rows).pivot(cols, values).agg(F.count(F.lit(1))).na.fill(0, subset=values)


def alternative_labels(df: DataFrame, big_round: float = 10_000_000) -> DataFrame:
    """Outcome proxies -- reached Series B or later; funding above
    ``big_round``."""
    late = ["Series B", "Series C", "Series D+"]
    return df.withColumns(
        {
            "reached_series_b": F.coalesce(F.col("stage").isin(late), F.lit(False)),
            "raised_over_10m": F.coalesce(F.col("funding_amount") > big_round, F.lit(False)),
        }
    )
