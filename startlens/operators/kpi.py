"""Venture KPIs, column (population) definition.

Every KPI is a native column expression. Stage parameters are literal maps
folded into the projection. The only population term is the traction
min-max scaling: its bounds come from one global two-value aggregate used as
a scalar subquery (a single value broadcast to every task), never a window
over the whole table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from startlens.functions import params as P
from startlens.functions.columns import clip, lookup, safe_div

KPI_COLUMNS = [
    "estimated_revenue",
    "capital_efficiency",
    "monthly_burn",
    "runway_months",
    "burn_multiple",
    "traction_index",
    "rule_of_40",
]


def _stage_param(idx: int, stage: str | Column = "stage", default=None) -> Column:
    return lookup({k: v[idx] for k, v in P.STAGE_PARAMS.items()}, stage, default)


def stage_weight(stage="stage") -> Column:
    return _stage_param(0, stage, P.DEFAULT_STAGE_WEIGHT)


def revenue_multiple(stage="stage") -> Column:
    return _stage_param(1, stage, P.DEFAULT_REVENUE_MULTIPLE)


def burn_months(stage="stage") -> Column:
    return _stage_param(2, stage, P.DEFAULT_BURN_MONTHS)


def rule40_base(stage="stage") -> Column:
    return _stage_param(3, stage, P.DEFAULT_RULE40_BASE)


def estimate_revenue(df: DataFrame, funding_col: str = "funding_amount") -> DataFrame:
    """K1: annual revenue = funding x stage revenue multiple (default 0.20)."""
    return df.withColumn("estimated_revenue", F.col(funding_col) * revenue_multiple())


def capital_efficiency(df: DataFrame, revenue_col: str = "estimated_revenue", funding_col: str = "funding_amount") -> DataFrame:
    """K2: revenue / funding, zero funding gives NULL."""
    if revenue_col not in df.columns:
        df = estimate_revenue(df, funding_col)
    return df.withColumn("capital_efficiency", safe_div(revenue_col, funding_col))


def burn_rate(df: DataFrame, funding_col: str = "funding_amount") -> DataFrame:
    """K3: monthly burn = funding / stage burn months (default 24)."""
    return df.withColumn("monthly_burn", F.col(funding_col) / burn_months())


def runway(df: DataFrame, cash_col: str | None = None, burn_col: str = "monthly_burn", funding_col: str = "funding_amount") -> DataFrame:
    """K4: cash / monthly burn; cash defaults to half of total funding."""
    if burn_col not in df.columns:
        df = burn_rate(df, funding_col)
    cash = F.col(cash_col) if cash_col and cash_col in df.columns else F.col(funding_col) * F.lit(P.CASH_SHARE_OF_FUNDING)
    return df.withColumn("runway_months", safe_div(cash, burn_col))


def burn_multiple(df: DataFrame, burn_col: str = "monthly_burn", revenue_col: str = "estimated_revenue") -> DataFrame:
    """K5: annual burn / annual revenue, capped at 10."""
    if burn_col not in df.columns:
        df = burn_rate(df)
    if revenue_col not in df.columns:
        df = estimate_revenue(df)
    return df.withColumn("burn_multiple", clip(safe_div(F.col(burn_col) * 12, revenue_col), hi=P.BURN_MULTIPLE_CAP))


def raw_traction(
    funding_col: str = "funding_amount",
    investors_col: str = "investors_count",
    year_col: str = "founded_year",
    snapshot_year: int = P.SNAPSHOT_YEAR,
) -> Column:
    """log10(max(funding,1)) x max(investors or 1, 1) x stage weight / age.

    A missing founding year counts as age 1.
    """
    funding_score = F.log10(clip(funding_col, lo=1))
    investors_score = clip(F.coalesce(F.col(investors_col).cast("double"), F.lit(1.0)), lo=1)
    age = clip(F.lit(snapshot_year) - F.coalesce(F.col(year_col).cast("double"), F.lit(float(snapshot_year))), lo=1)
    return funding_score * investors_score * stage_weight() * (F.lit(1.0) / age)


def traction_bounds(df: DataFrame, raw: Column) -> Column:
    """Population (min, max) of the raw traction as one scalar subquery."""
    return df.select(F.struct(F.min(raw).alias("lo"), F.max(raw).alias("hi"))).scalar()


def population_traction_bounds(population: DataFrame, snapshot_year: int = P.SNAPSHOT_YEAR) -> Column:
    """(lo, hi) of the raw traction of a population, as a scalar subquery
    struct -- stored bounds for scoring new rows consistently with it."""
    return traction_bounds(population, raw_traction(snapshot_year=snapshot_year))


def traction_index(
    df: DataFrame,
    snapshot_year: int = P.SNAPSHOT_YEAR,
    bounds: tuple[float, float] | Column | None = None,
) -> DataFrame:
    """K6: raw traction min-max scaled to 0-100 over the whole population.

    ``bounds`` lets a caller score new rows against stored bounds (no
    population pass): two numbers, or a struct column with fields lo/hi
    (e.g. :func:`population_traction_bounds` of the training population).
    Equal bounds give NULL (0/0), as in the method.
    """
    raw = raw_traction(snapshot_year=snapshot_year)
    if isinstance(bounds, Column):
        lo, hi = bounds.getField("lo"), bounds.getField("hi")
    elif bounds is not None:
        lo, hi = F.lit(float(bounds[0])), F.lit(float(bounds[1]))
    else:
        b = traction_bounds(df, raw)
        lo, hi = b.getField("lo"), b.getField("hi")
    return df.withColumn("traction_index", F.try_divide(raw - lo, F.nullif(hi - lo, F.lit(0.0))) * 100)


def rule_of_40(df: DataFrame, use_capital_efficiency: bool = True, benchmark_shift: float | Column = 0) -> DataFrame:
    """K7: stage benchmark (+ capital-efficiency adjustment, clipped).

    ``benchmark_shift`` moves every stage benchmark by a number of points
    (a constant or a column), for sensitivity analysis.
    """
    shift = benchmark_shift if isinstance(benchmark_shift, Column) else F.lit(float(benchmark_shift))
    est = rule40_base().cast("double")
    if not (isinstance(benchmark_shift, (int, float)) and benchmark_shift == 0):
        est = est + shift
    if use_capital_efficiency and "capital_efficiency" in df.columns:
        adj = (F.col("capital_efficiency") - F.lit(P.RULE40_EFFICIENCY_PIVOT)) * F.lit(P.RULE40_EFFICIENCY_SLOPE)
        est = clip(est + adj, *P.RULE40_CLIP)
    return df.withColumn("rule_of_40", est)


def calculate_all_kpis(
    df: DataFrame,
    snapshot_year: int = P.SNAPSHOT_YEAR,
    traction_bounds_override: tuple[float, float] | Column | None = None,
) -> DataFrame:
    """K8: revenue, capital efficiency, burn, runway, burn multiple,
    traction, Rule of 40 -- the same formulas as the single-KPI operators
    above, added in three projection levels (each level only uses columns
    of the previous ones)."""
    f = F.col("funding_amount")
    out = df.withColumns(
        {
            "estimated_revenue": f * revenue_multiple(),
            "monthly_burn": f / burn_months(),
        }
    )
    out = out.withColumns(
        {
            "capital_efficiency": safe_div("estimated_revenue", "funding_amount"),
            "runway_months": safe_div(f * F.lit(P.CASH_SHARE_OF_FUNDING), "monthly_burn"),
            "burn_multiple": clip(safe_div(F.col("monthly_burn") * 12, "estimated_revenue"), hi=P.BURN_MULTIPLE_CAP),
        }
    )
    out = traction_index(out, snapshot_year, traction_bounds_override)
    out = rule_of_40(out)
    return out.select(*df.columns, *KPI_COLUMNS)


def kpi_bands(df: DataFrame) -> DataFrame:
    """Interpretation bands documented beside the KPI formulas."""
    ce, bm, r40, tr = (F.col(c) for c in ("capital_efficiency", "burn_multiple", "rule_of_40", "traction_index"))
    return df.withColumns(
        {
            "capital_efficiency_band": F.when(ce > 1.0, "excellent").when(ce >= 0.5, "good").when(ce >= 0.2, "acceptable").when(ce.isNotNull(), "low"),
            "burn_multiple_band": F.when(bm < 1.0, "excellent").when(bm <= 1.5, "good").when(bm <= 3.0, "moderate").when(bm.isNotNull(), "concerning"),
            "rule_of_40_band": F.when(r40 >= 40, "excellent").when(r40 >= 30, "good").when(r40 >= 20, "acceptable").when(r40.isNotNull(), "concerning"),
            "traction_band": F.when(tr >= 60, "exceptional").when(tr >= 40, "strong").when(tr >= 20, "moderate").when(tr.isNotNull(), "early"),
        }
    )
