"""Entry A: companies -> enriched -> KPIs -> scored -> ranked / top-N.

One lazy plan from the three scans to the result; nothing is collected.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from startlens.operators import enrich, kpi, rank, score
from startlens.session import materialize
from startlens.sources import fixtures

# Output column order of the scored table (id first as the row key).
SCORED_COLUMNS = [
    "id", "company", "stage", "country", "sector", "funding_amount", "investors_count",
    "founded_year", "status", "last_funding_date",
    "estimated_revenue", "capital_efficiency", "monthly_burn", "runway_months",
    "burn_multiple", "traction_index", "rule_of_40",
    "rule_of_40_norm", "traction_index_norm", "capital_efficiency_norm",
    "burn_multiple_norm", "runway_months_norm", "investment_score",
]


def enriched_companies(spark: SparkSession, sf_dir: str, min_funding: float = 0) -> DataFrame:
    return enrich.enrich_startups(
        fixtures.objects(spark, sf_dir),
        fixtures.funding_rounds(spark, sf_dir),
        fixtures.investments(spark, sf_dir),
        filter_funded=True,
        min_funding=min_funding,
    )


def companies_with_kpis(
    spark: SparkSession,
    sf_dir: str,
    snapshot_year: int = fixtures.SNAPSHOT_YEAR_FIXTURE,
    checkpoint: bool = True,
) -> DataFrame:
    """KPIs need one population pass (traction bounds) and the row pass.

    With ``checkpoint`` the enriched table (two aggregates + two joins) is
    written once to the shared checkpoint folder, and both passes scan that
    narrow table instead of recomputing the enrichment.
    """
    enriched = enriched_companies(spark, sf_dir)
    if checkpoint:
        enriched = materialize(enriched)
    return kpi.calculate_all_kpis(enriched, snapshot_year=snapshot_year)


def scored_companies(
    spark: SparkSession,
    sf_dir: str,
    weights: Mapping[str, float] | None = None,
    snapshot_year: int = fixtures.SNAPSHOT_YEAR_FIXTURE,
) -> DataFrame:
    df = companies_with_kpis(spark, sf_dir, snapshot_year)
    return score.calculate_investment_score(df, weights).select(*SCORED_COLUMNS)


def ranked_companies(spark: SparkSession, sf_dir: str, weights: Mapping[str, float] | None = None) -> DataFrame:
    return rank.rank_rows(scored_companies(spark, sf_dir, weights), "investment_score", "id")


def top_companies(spark: SparkSession, sf_dir: str, n: int = 100, weights: Mapping[str, float] | None = None) -> DataFrame:
    return rank.top_n(scored_companies(spark, sf_dir, weights), n, "investment_score", "id")
