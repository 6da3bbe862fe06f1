"""Normalisation and the weighted 0-100 investment score."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from startlens.functions import params as P
from startlens.functions.columns import clip, round_half_even

# Score components in the order they are summed.
COMPONENTS = ["rule_of_40", "traction_index", "capital_efficiency", "burn_multiple", "runway_months"]


def normalize_to_100(c: str | Column, lo: float | Column, hi: float | Column) -> Column:
    """(x - lo) / (hi - lo) x 100 clipped to [0, 100].

    Equal bounds give 50 for every row, missing rows included.
    """
    c = F.col(c) if isinstance(c, str) else c
    lo_c = lo if isinstance(lo, Column) else F.lit(float(lo))
    hi_c = hi if isinstance(hi, Column) else F.lit(float(hi))
    scaled = clip((c - lo_c) / F.nullif(hi_c - lo_c, F.lit(0.0)) * 100, 0, 100)
    return F.when(hi_c == lo_c, F.lit(50.0)).otherwise(scaled)


def normalized_columns() -> dict[str, Column]:
    """The five ``*_norm`` columns."""
    inv_burn = F.lit(1.0) / clip("burn_multiple", lo=P.BURN_NORM_FLOOR)
    return {
        "rule_of_40_norm": clip("rule_of_40", 0, 100),
        "traction_index_norm": clip("traction_index", 0, 100),
        "capital_efficiency_norm": clip("capital_efficiency", 0, 1.0) * 100,
        "burn_multiple_norm": normalize_to_100(inv_burn, *P.BURN_NORM_BOUNDS),
        "runway_months_norm": normalize_to_100(clip("runway_months", *P.RUNWAY_NORM_BOUNDS), *P.RUNWAY_NORM_BOUNDS),
    }


def normalize_kpis(df: DataFrame) -> DataFrame:
    """C2 on the KPI columns present in ``df``."""
    cols = {k: v for k, v in normalized_columns().items() if k[: -len("_norm")] in df.columns}
    return df.withColumns(cols)


def weighted_score(weights: Mapping[str, float] | None = None, present: list[str] | None = None) -> Column:
    """0 + sum(norm x weight) in component order; weights not renormalised.

    A NULL component makes the score NULL.
    """
    w = dict(P.DEFAULT_WEIGHTS if weights is None else weights)
    score = F.lit(0.0)
    for comp in COMPONENTS:
        if present is None or f"{comp}_norm" in present:
            score = score + F.col(f"{comp}_norm") * F.lit(float(w.get(comp, 0.0)))
    return score


def calculate_investment_score(df: DataFrame, weights: Mapping[str, float] | None = None) -> DataFrame:
    """Normalised KPIs + ``investment_score`` rounded half-even to 2 places."""
    out = normalize_kpis(df)
    return out.withColumn("investment_score", round_half_even(weighted_score(weights, out.columns), 2))


def score_breakdown(df: DataFrame, weights: Mapping[str, float] | None = None, key: str = "id") -> DataFrame:
    """One row per (company, KPI): raw, normalised, weight, contribution.

    Works for all companies at once (a ``stack`` projection, no shuffle);
    select one company with a filter. The weights shown are the ones used.
    """
    w = dict(P.DEFAULT_WEIGHTS if weights is None else weights)
    parts = []
    for comp in COMPONENTS:
        parts += [F.lit(comp), F.col(comp).cast("double"), F.col(f"{comp}_norm").cast("double"), F.lit(float(w.get(comp, 0.0)))]
    stacked = F.inline(
        F.array(
            *[
                F.struct(parts[i].alias("kpi"), parts[i + 1].alias("raw_value"), parts[i + 2].alias("norm_value"), parts[i + 3].alias("weight"))
                for i in range(0, len(parts), 4)
            ]
        )
    )
    keep = [c for c in (key, "company", "rank", "investment_score", "stage", "country", "sector", "funding_amount", "investors_count") if c in df.columns]
    out = df.select(*keep, stacked)
    return out.withColumn("contribution", F.col("norm_value") * F.col("weight"))
