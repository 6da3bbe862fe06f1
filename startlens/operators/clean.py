"""Generic loader: standardise any company extract.

Column names are resolved once on the driver from the schema (metadata,
no action); all value work is native column expressions. Text columns are
read as text and converted with ``try_cast``/``try_to_date`` (ANSI-safe).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from startlens.functions import params as P
from startlens.functions.columns import lookup, nan_to_null, py_title, strip_ws
from startlens.operators.enrich import companies_only, year_from_date_text


def first_present(df: DataFrame, names: list[str]) -> str | None:
    """First candidate column that exists (driver-side schema lookup)."""
    for n in names:
        if n in df.columns:
            return n
    return None


def coalesce_present(df: DataFrame, names: list[str]) -> Column:
    """Row-wise first non-null among the candidate columns present."""
    present = [F.col(n) for n in names if n in df.columns]
    if not present:
        return F.lit(None).cast("string")
    return F.coalesce(*present) if len(present) > 1 else present[0]


def standardize_stage(c: str | Column) -> Column:
    """lower/strip lookup in the generic stage map; unknown text is
    title-cased (Python rules); empty or missing gives NULL."""
    c = F.col(c) if isinstance(c, str) else c
    s = strip_ws(c.cast("string"))
    mapped = lookup(P.GENERIC_STAGE_MAP, F.lower(s))
    return F.when(s.isNull() | (s == ""), F.lit(None).cast("string")).otherwise(F.coalesce(mapped, py_title(s)))


def to_number(c: Column) -> Column:
    """text to double; unparsable gives NULL; NaN becomes NULL."""
    return nan_to_null(c.cast("string").try_cast("double"))


def standardize_startups(df: DataFrame, filter_funded: bool = False) -> DataFrame:
    """Canonical table: company, stage, country, sector, funding_amount,
    investors_count, founded_year.

    Non-company entities are dropped when ``entity_type`` exists. The
    company name comes from the first present of company / organization /
    startup / name; sector and country are taken as is when present, else
    their other candidates are coalesced row by row; each numeric column takes the first present candidate (a
    ``founded_at`` date yields its year). Text is stripped. With
    ``filter_funded`` only funding > 0 is kept.
    """
    df = companies_only(df)
    name_col = first_present(df, P.COMPANY_ALIASES)
    company = F.col(name_col) if name_col else F.lit(None)
    stage = standardize_stage(F.col("stage")) if "stage" in df.columns else F.lit(None).cast("string")
    # an existing canonical column is used as is; only when it is absent
    # are the other candidates coalesced row by row
    sector = F.col("sector") if "sector" in df.columns else coalesce_present(df, P.SECTOR_ALIASES[1:])
    country = F.col("country") if "country" in df.columns else coalesce_present(df, P.COUNTRY_ALIASES[1:])

    def numeric(aliases: list[str]) -> Column:
        c = first_present(df, aliases)
        if c is None:
            return F.lit(None).cast("double")
        if c == "founded_at":
            return year_from_date_text(F.col(c).cast("string")).cast("double")
        return to_number(F.col(c))

    out = df.select(
        strip_ws(company.cast("string")).alias("company"),
        strip_ws(stage).alias("stage"),
        strip_ws(country.cast("string")).alias("country"),
        strip_ws(sector.cast("string")).alias("sector"),
        numeric(P.FUNDING_ALIASES).alias("funding_amount"),
        numeric(P.INVESTORS_ALIASES).alias("investors_count"),
        numeric(P.YEAR_ALIASES).alias("founded_year"),
    )
    if filter_funded:
        out = out.where(F.col("funding_amount") > 0)
    return out


def require_rows(df: DataFrame, what: str = "input") -> DataFrame:
    """S3: fail on an empty input (costs one small action: ``isEmpty``)."""
    if df.isEmpty():
        raise ValueError(f"{what} is empty")
    return df
