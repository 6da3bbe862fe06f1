"""Company enrichment: latest funding round, investor counts, cleaning.

Plan shape: two keyed aggregates (rounds by company, investments by
company) and two left joins on the company key. Both aggregates come out
hash-partitioned on the key, so the joins reuse that partitioning; the
company-side filters (entity type, funding) run before the joins and reach
the parquet scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from startlens.functions import params as P
from startlens.functions.columns import lookup, strip_ws


def latest_round(
    rounds: DataFrame,
    key: str = "object_id",
    type_col: str = "funding_round_type",
    date_col: str = "funded_at",
    tiebreak: str | None = "round_id",
) -> DataFrame:
    """Per company: the round type of its most recent typed round and the
    date of its most recent dated round.

    "Most recent" follows an ascending sort on the date with undated rounds
    sorted last, then taking the last non-null value of each column on its
    own. So the type comes from the last round *that has a type* (an undated
    typed round wins), and the date is the latest date. Ties on the date are
    broken by ``tiebreak`` (highest wins).

    ``max_by`` is a declarative aggregate with a map-side partial step, so a
    company holding a large share of all rounds is pre-combined in every map
    task before the shuffle.
    """
    d = F.col(date_col)
    fields = [d.isNull().alias("undated"), d.alias("d")]
    if tiebreak:
        fields.append(F.col(tiebreak).alias("t"))
    order = F.when(F.col(type_col).isNotNull(), F.struct(*fields))
    return rounds.groupBy(key).agg(
        F.max_by(F.col(type_col), order).alias("last_round_type"),
        F.max(d).alias("last_funding_date"),
    )


def round_type_to_stage(c: str | Column) -> Column:
    """Lower-case, strip, map round type to a canonical stage (else NULL)."""
    c = F.col(c) if isinstance(c, str) else c
    return lookup(P.ROUND_TYPE_STAGE_MAP, F.lower(strip_ws(c)))


def investor_counts(
    investments: DataFrame,
    key: str = "funded_object_id",
    investor: str = "investor_object_id",
    approximate: bool = False,
    rsd: float = 0.01,
) -> DataFrame:
    """Distinct investors per company (NULL investors ignored).

    Exact by default: Spark plans it as an aggregate on (company, investor)
    followed by a count per company, so the first shuffle is spread over
    investor pairs even when one company is very hot. ``approximate`` uses
    HyperLogLog++ (one small sketch per company).
    """
    agg = F.approx_count_distinct(investor, rsd) if approximate else F.countDistinct(investor)
    return investments.where(F.col(key).isNotNull()).groupBy(key).agg(agg.alias("investors_count"))


def companies_only(objects: DataFrame, entity_col: str = "entity_type", entity: str = "Company") -> DataFrame:
    """Keep company entities; a table without the column passes unchanged."""
    if entity_col in objects.columns:
        return objects.where(F.col(entity_col) == F.lit(entity))
    return objects


def funded_filter(df: DataFrame, col: str = "funding_amount", min_funding: float = 0) -> DataFrame:
    """Funding strictly positive; also ``>= min_funding`` when that is > 0."""
    out = df.where(F.col(col) > 0)
    if min_funding and min_funding > 0:
        out = out.where(F.col(col) >= F.lit(float(min_funding)))
    return out


def year_from_date_text(c: str | Column, fmt: str = "yyyy-MM-dd") -> Column:
    """Year of an ISO date text; invalid dates (e.g. Feb 30) give NULL."""
    c = F.col(c) if isinstance(c, str) else c
    return F.year(F.try_to_date(c, fmt))


def enrich_startups(
    objects: DataFrame,
    rounds: DataFrame,
    investments: DataFrame,
    filter_funded: bool = True,
    min_funding: float = 0,
    round_tiebreak: str | None = "round_id",
    approximate_investors: bool = False,
) -> DataFrame:
    """Companies + stage of their latest round + distinct investor count.

    Output: id, company, stage, country, sector, funding_amount,
    investors_count, founded_year, status, last_funding_date. ``id`` is kept
    as the unique row key (it breaks ties in rankings).
    """
    comp = companies_only(objects).select(
        F.col("id"),
        F.col("name").cast("string").alias("company"),
        F.col("category_code").cast("string").alias("sector"),
        F.col("country_code").cast("string").alias("country"),
        F.col("founded_at"),
        F.col("funding_total_usd").cast("double").alias("funding_amount"),
        F.col("status").cast("string").alias("status"),
    )
    if filter_funded:
        comp = funded_filter(comp, "funding_amount", min_funding)

    latest = latest_round(rounds, tiebreak=round_tiebreak).select(
        F.col("object_id").alias("id"),
        round_type_to_stage("last_round_type").alias("stage"),
        "last_funding_date",
    )
    inv = investor_counts(investments, approximate=approximate_investors).withColumnRenamed("funded_object_id", "id")

    j = comp.join(latest, "id", "left").join(inv, "id", "left")
    return j.select(
        "id",
        "company",
        "stage",
        "country",
        "sector",
        "funding_amount",
        "investors_count",
        year_from_date_text("founded_at").alias("founded_year"),
        "status",
        "last_funding_date",
    )
