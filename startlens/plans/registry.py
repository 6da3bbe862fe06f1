"""Registered queries (one per operator group of the inventory) and their
DuckDB oracle SQL.

Every query reads the given test tables (through the fixture builders) and
runs over whole tables: no id subsets, no row caps except where the limit
is the feature (top-N reports). Results pass through ``present.tidy`` so
that both engines print the same numbers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from startlens.functions import params as _P
from startlens.plans import oracle as O
from startlens.plans import startups
from startlens.plans.present import tidy
from startlens.session import materialize
from startlens.sources import fixtures

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return deco


def _sel(kinds: dict[str, str]) -> str:
    return O.tidy_cols(kinds)


# ---------------------------------------------------------------------------
# Sources (fixtures) -- S2
# ---------------------------------------------------------------------------

_OBJ_KINDS = {"id": "i", "entity_type": "s", "name": "s", "category_code": "s", "country_code": "s",
              "founded_at": "s", "funding_total_usd": "d", "status": "s"}


@register("objects_scan", f"WITH {fixtures.FIXTURE_CTES} SELECT {_sel(_OBJ_KINDS)} FROM objects")
def objects_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(fixtures.objects(spark, sf_dir))


# ---------------------------------------------------------------------------
# Enrichment -- P1, P10-P12, J1-J3, A1
# ---------------------------------------------------------------------------

_ENR_KINDS = {"id": "i", "company": "s", "stage": "s", "country": "s", "sector": "s", "funding_amount": "d",
              "investors_count": "i", "founded_year": "i", "status": "s", "last_funding_date": "date"}


@register("enriched_startups", f"WITH {O.enrich_ctes()} SELECT {_sel(_ENR_KINDS)} FROM enr")
def enriched_startups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(startups.enriched_companies(spark, sf_dir))


# ---------------------------------------------------------------------------
# KPIs -- K1-K8, J4, J6
# ---------------------------------------------------------------------------

_KPI_KINDS = dict(_ENR_KINDS, **{k: "d" for k in ("estimated_revenue", "capital_efficiency", "monthly_burn",
                                                   "runway_months", "burn_multiple", "traction_index", "rule_of_40")})


@register("startup_kpis", f"WITH {O.kpi_ctes()} SELECT {_sel(_KPI_KINDS)} FROM kpis")
def startup_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(startups.companies_with_kpis(spark, sf_dir))


# ---------------------------------------------------------------------------
# Scoring -- C1-C3
# ---------------------------------------------------------------------------

@register("scored_startups", f"WITH {O.score_ctes()} SELECT {_sel(O.SCORED_KINDS)} FROM scored")
def scored_startups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(startups.scored_companies(spark, sf_dir))


# ---------------------------------------------------------------------------
# Ranking -- W1, O1, O2, C5
# ---------------------------------------------------------------------------

_RANKED_KINDS = dict(O.SCORED_KINDS, rank="i")


@register(
    "ranked_startups",
    f"WITH {O.score_ctes()}, r AS (SELECT *, row_number() OVER (ORDER BY investment_score DESC NULLS LAST, id) AS rank FROM scored) "
    f"SELECT {_sel(_RANKED_KINDS)} FROM r",
)
def ranked_startups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(startups.ranked_companies(spark, sf_dir))


@register(
    "top_startups",
    f"WITH {O.score_ctes()}, r AS (SELECT *, row_number() OVER (ORDER BY investment_score DESC NULLS LAST, id) AS rank FROM scored) "
    f"SELECT {_sel(_RANKED_KINDS)} FROM r WHERE rank <= 100",
)
def top_startups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(startups.top_companies(spark, sf_dir, 100))


# ---------------------------------------------------------------------------
# Reports -- A2-A7, A17, C6, C7
# ---------------------------------------------------------------------------

from startlens.operators import missing as M  # noqa: E402
from startlens.operators import report as R  # noqa: E402
from startlens.operators import score as S  # noqa: E402

D = O.d


def _grade_sql(pct: str) -> str:
    return (f"CASE WHEN {pct} = 0 THEN 'complete' WHEN {pct} < 20 THEN 'good' "
            f"WHEN {pct} < 50 THEN 'fair' ELSE 'poor' END")


_QUALITY_SQL = (
    f"WITH {O.enrich_ctes()}, q AS ("
    + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE {c} IS NULL) AS missing, count(*) AS n FROM enr"
        for c in R.QUALITY_COLUMNS
    )
    + f"), p AS (SELECT column_name, missing, CAST(missing AS DOUBLE) * {D(100.0)} / n AS missing_pct FROM q) "
    f"SELECT column_name, CAST(missing AS BIGINT) AS missing, round(missing_pct, 6) AS missing_pct, "
    f"{_grade_sql('missing_pct')} AS grade FROM p"
)


@register("quality_report", _QUALITY_SQL)
def quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = R.quality_report(startups.enriched_companies(spark, sf_dir)).withColumnRenamed("column", "column_name")
    return tidy(out)


_KPIS = ["estimated_revenue", "capital_efficiency", "monthly_burn", "runway_months", "burn_multiple", "traction_index", "rule_of_40"]

_KPI_SUMMARY_SQL = (
    f"WITH {O.kpi_ctes()}, s AS ("
    + " UNION ALL ".join(
        f"SELECT '{k}' AS kpi, count({k}) AS count, avg({k}) AS mean, quantile_cont({k}, 0.5) AS median, "
        f"stddev_samp({k}) AS std, min({k}) AS min, max({k}) AS max FROM kpis"
        for k in _KPIS
    )
    + ") SELECT kpi, CAST(count AS BIGINT) AS count, round(mean, 3) AS mean, round(median, 3) AS median, "
    "round(std, 3) AS std, round(min, 6) AS min, round(max, 6) AS max FROM s"
)


@register("kpi_summary", _KPI_SUMMARY_SQL)
def kpi_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = R.kpi_summary(startups.companies_with_kpis(spark, sf_dir))
    return tidy(out, overrides={"mean": 3, "median": 3, "std": 3})


_SCORE_SUMMARY_SQL = (
    f"WITH {O.score_ctes()} SELECT 'investment_score' AS metric, CAST(count(investment_score) AS BIGINT) AS count, "
    "round(avg(investment_score), 6) AS mean, round(quantile_cont(investment_score, 0.5), 6) AS median, "
    "round(stddev_samp(investment_score), 6) AS std, round(min(investment_score), 6) AS min, "
    "round(quantile_cont(investment_score, 0.25), 6) AS q25, round(quantile_cont(investment_score, 0.75), 6) AS q75, "
    "round(max(investment_score), 6) AS max FROM scored"
)


@register("score_summary", _SCORE_SUMMARY_SQL)
def score_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    # default weights sum to 1 and the score is rounded: at most 10,001 values
    return tidy(R.score_summary(startups.scored_companies(spark, sf_dir), bounded_grid=True))


def _bands_sql() -> str:
    from startlens.functions import params as P

    parts = " UNION ALL ".join(
        f"SELECT '{label}' AS band, {D(float(lo))} AS low, {D(float(hi))} AS high, "
        f"count(*) FILTER (WHERE investment_score >= {lo} AND investment_score < {hi}) AS companies, count(*) AS n FROM scored"
        for lo, hi, label in P.SCORE_BANDS
    )
    return (f"WITH {O.score_ctes()}, b AS ({parts}) SELECT band, round(low, 6) AS low, round(high, 6) AS high, "
            f"CAST(companies AS BIGINT) AS companies, round(CAST(companies AS DOUBLE) * {D(100.0)} / n, 6) AS pct FROM b")


@register("score_bands", _bands_sql())
def score_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(R.score_bands(startups.scored_companies(spark, sf_dir)))


@register(
    "stage_counts",
    f"WITH {O.enrich_ctes()} SELECT stage, CAST(count(*) AS BIGINT) AS companies FROM enr WHERE stage IS NOT NULL "
    "GROUP BY stage ORDER BY companies DESC, stage LIMIT 10",
)
def stage_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(R.stage_counts(startups.enriched_companies(spark, sf_dir), 10))


@register(
    "load_funnel",
    f"WITH {fixtures.FIXTURE_CTES}, c AS (SELECT count(*) AS s0, count(*) FILTER (WHERE entity_type = 'Company') AS s1, "
    "count(*) FILTER (WHERE entity_type = 'Company' AND funding_total_usd > 0) AS s2, "
    "count(*) FILTER (WHERE entity_type = 'Company' AND funding_total_usd > 0 AND funding_total_usd >= 100000) AS s3 FROM objects) "
    "SELECT CAST(0 AS BIGINT) AS step_no, 'raw' AS step, CAST(s0 AS BIGINT) AS rows FROM c UNION ALL "
    "SELECT 1, 'companies', s1 FROM c UNION ALL SELECT 2, 'funded', s2 FROM c UNION ALL SELECT 3, 'min_funding', s3 FROM c",
)
def load_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(R.load_funnel(fixtures.objects(spark, sf_dir), min_funding=100000))


_BREAKDOWN_KINDS = {"id": "i", "company": "s", "investment_score": "d", "stage": "s", "country": "s", "sector": "s",
                    "funding_amount": "d", "investors_count": "i", "kpi": "s", "raw_value": "d", "norm_value": "d",
                    "weight": "d", "contribution": "d"}


def _breakdown_sql() -> str:
    from startlens.functions import params as P

    parts = " UNION ALL ".join(
        f"SELECT id, company, investment_score, stage, country, sector, funding_amount, investors_count, '{k}' AS kpi, "
        f"CAST({k} AS DOUBLE) AS raw_value, {k}_norm AS norm_value, {D(float(P.DEFAULT_WEIGHTS[k]))} AS weight, "
        f"{k}_norm * {D(float(P.DEFAULT_WEIGHTS[k]))} AS contribution FROM scored"
        for k in S.COMPONENTS
    )
    return f"WITH {O.score_ctes()}, b AS ({parts}) SELECT {_sel(_BREAKDOWN_KINDS)} FROM b"


@register("score_breakdown", _breakdown_sql())
def score_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(S.score_breakdown(startups.scored_companies(spark, sf_dir)))


# ---------------------------------------------------------------------------
# Missing-data statistics -- D1-D6, A9-A14
# ---------------------------------------------------------------------------

_MISS_SQL = f"""WITH {O.enrich_ctes()},
a AS (SELECT count(*) AS n_all,
  count(*) FILTER (WHERE investors_count IS NULL) AS missing_count,
  count(*) FILTER (WHERE investors_count IS NOT NULL) AS present_count,
  count(funding_amount) FILTER (WHERE investors_count IS NULL) AS n_m,
  count(funding_amount) FILTER (WHERE investors_count IS NOT NULL) AS n_p,
  avg(funding_amount) FILTER (WHERE investors_count IS NULL) AS mean_m,
  avg(funding_amount) FILTER (WHERE investors_count IS NOT NULL) AS mean_p,
  var_samp(funding_amount) FILTER (WHERE investors_count IS NULL) AS var_m,
  var_samp(funding_amount) FILTER (WHERE investors_count IS NOT NULL) AS var_p FROM enr),
t AS (SELECT *, (mean_m - mean_p) / sqrt(((n_m - 1) * var_m + (n_p - 1) * var_p) / CAST(n_m + n_p - 2 AS DOUBLE)
       * ({D(1.0)} / n_m + {D(1.0)} / n_p)) AS t_stat FROM a)
SELECT CAST(missing_count AS BIGINT) AS missing_count, CAST(present_count AS BIGINT) AS present_count,
  round(CAST(missing_count AS DOUBLE) / n_all, 6) AS missing_rate, round(mean_p / mean_m, 6) AS funding_ratio,
  round(mean_m, 2) AS mean_missing, round(mean_p, 2) AS mean_present, round(t_stat, 6) AS t_stat,
  CAST(n_m + n_p - 2 AS BIGINT) AS dof FROM t"""


@register("missingness_stats", _MISS_SQL)
def missingness_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = M.missingness_stats(startups.enriched_companies(spark, sf_dir))
    return tidy(out, overrides={"mean_missing": 2, "mean_present": 2})


def _half_area(z: str, density: str, source: str) -> str:
    """CTE ``h``: the area of a density from 0 to ``z``, by Simpson's rule."""
    steps = 20000
    u = f"({z} * k / {steps}.0)"
    w = f"CASE WHEN k = 0 OR k = {steps} THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END"
    return f"h AS (SELECT coalesce(sum({w} * {density.format(u=u)} * {z} / {steps * 3}), 0) AS half FROM {source}, range({steps + 1}) r(k))"


def _miss_test_sql() -> str:
    ctes, select = _MISS_SQL.split("\nSELECT ", 1)
    density = "exp(lgamma((v + 1) / 2) - lgamma(v / 2) - (v + 1) / 2 * ln(1 + {u} * {u} / v)) / sqrt(v * pi())"
    return (
        f"{ctes}, z AS (SELECT abs(t_stat) AS z, CAST(n_m + n_p - 2 AS DOUBLE) AS v FROM t), {_half_area('z', density, 'z')} "
        f"SELECT {select}, h".replace(" AS dof FROM t", f" AS dof, round(1 - 2 * half, 6) AS p_value, 1 - 2 * half < {_P.SIGNIFICANCE_LEVEL} AS significant FROM t")
    )


@register("missingness_test", _miss_test_sql())
def missingness_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T statistic, p-value and significance flag."""
    out = M.missingness_test(startups.enriched_companies(spark, sf_dir))
    return tidy(out, overrides={"mean_missing": 2, "mean_present": 2})


@register(
    "funding_profile",
    f"WITH {O.enrich_ctes()} SELECT investors_count IS NULL AS investors_missing, CAST(count(*) AS BIGINT) AS companies, "
    "round(avg(funding_amount), 2) AS mean_funding, round(quantile_cont(funding_amount, 0.5), 2) AS median_funding "
    "FROM enr GROUP BY 1",
)
def funding_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = M.group_funding_profile(materialize(startups.enriched_companies(spark, sf_dir).select("investors_count", "funding_amount")))
    return tidy(out, overrides={"mean_funding": 2, "median_funding": 2})


def _by_group_sql(group: str, min_total: int | None, top: int | None) -> str:
    having = f"WHERE total >= {min_total}" if min_total is not None else ""
    lim = f"ORDER BY missing_pct DESC, {group} LIMIT {top}" if top is not None else ""
    return f"""WITH {O.enrich_ctes()},
g AS (SELECT {group}, count(investors_count) AS total, count(*) AS rows,
        count(*) FILTER (WHERE investors_count IS NULL) AS missing, avg(funding_amount) AS mean_funding
      FROM enr WHERE {group} IS NOT NULL GROUP BY {group}),
h AS (SELECT {group}, total, rows, missing,
        round_even(CAST(missing AS DOUBLE) * {D(100.0)} / rows * 100, 0) / 100 AS missing_pct,
        round_even(mean_funding * 100, 0) / 100 AS mean_funding FROM g)
SELECT {group}, CAST(total AS BIGINT) AS total, CAST(rows AS BIGINT) AS rows, CAST(missing AS BIGINT) AS missing,
  round(missing_pct, 6) AS missing_pct, round(mean_funding, 2) AS mean_funding FROM h {having} {lim}"""


@register("missing_by_stage", _by_group_sql("stage", None, None))
def missing_by_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(M.missing_by_group(startups.enriched_companies(spark, sf_dir), "stage"), overrides={"mean_funding": 2})


@register("missing_by_sector", _by_group_sql("sector", 100, 10))
def missing_by_sector(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = M.missing_by_group(startups.enriched_companies(spark, sf_dir), "sector", min_total=100, top=10)
    return tidy(out, overrides={"mean_funding": 2})


_KNOWN = "status IN ('acquired', 'ipo', 'closed')"
_SUCC = "CASE WHEN status IN ('acquired', 'ipo') THEN 1 ELSE 0 END"


@register(
    "investor_contingency",
    f"WITH {O.enrich_ctes()} SELECT coalesce(investors_count > 0, false) AS has_investors, "
    f"CAST(count(*) FILTER (WHERE {_SUCC} = 0) AS BIGINT) AS failures, "
    f"CAST(count(*) FILTER (WHERE {_SUCC} = 1) AS BIGINT) AS successes FROM enr WHERE {_KNOWN} GROUP BY 1",
)
def investor_contingency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(M.contingency(startups.enriched_companies(spark, sf_dir)))


@register(
    "success_by_presence",
    f"WITH {O.enrich_ctes()}, k AS (SELECT *, CASE WHEN investors_count IS NULL THEN 'missing' "
    f"WHEN investors_count > 0 THEN 'present' END AS investors FROM enr WHERE {_KNOWN}) "
    f"SELECT investors, CAST(count(*) AS BIGINT) AS companies, round(avg({_SUCC}), 6) AS success_rate "
    "FROM k WHERE investors IS NOT NULL GROUP BY investors",
)
def success_by_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(M.success_by_presence(startups.enriched_companies(spark, sf_dir)))


def _chi_sql() -> str:
    cells = {"a": "NOT h AND NOT s", "b": "NOT h AND s", "c": "h AND NOT s", "d": "h AND s"}
    cnt = ", ".join(f"CAST(count(*) FILTER (WHERE {w}) AS DOUBLE) AS {k}" for k, w in cells.items())
    terms = []
    for obs, r, c in (("a", "(a+b)", "(a+c)"), ("b", "(a+b)", "(b+d)"), ("c", "(c+d)", "(a+c)"), ("d", "(c+d)", "(b+d)")):
        e = f"({r} * {c} / (a+b+c+d))"
        corr = f"({obs} + least({D(0.5)}, abs({e} - {obs})) * sign({e} - {obs}))"
        terms.append(f"({corr} - {e}) * ({corr} - {e}) / {e}")
    dof = "CASE WHEN (a+b) = 0 OR (c+d) = 0 OR (a+c) = 0 OR (b+d) = 0 THEN 0 ELSE 1 END"
    return (
        f"WITH {O.enrich_ctes()}, k AS (SELECT coalesce(investors_count > 0, false) AS h, status IN ('acquired','ipo') AS s "
        f"FROM enr WHERE {_KNOWN}), c AS (SELECT {cnt} FROM k) "
        f"SELECT CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b, CAST(c AS BIGINT) AS c, CAST(d AS BIGINT) AS d, "
        f"round(CASE WHEN {dof} = 0 THEN {D(0.0)} ELSE {' + '.join(terms)} END, 6) AS chi2, CAST({dof} AS BIGINT) AS dof FROM c"
    )


@register("chi_square_stats", _chi_sql())
def chi_square_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(M.chi_square_stats(startups.enriched_companies(spark, sf_dir)))


def _chi_test_sql() -> str:
    """The statistic is taken before rounding; with no degree of freedom p is 1."""
    ctes, select = _chi_sql().rsplit(" SELECT CAST(a AS BIGINT)", 1)
    chi2 = select.split("round(", 1)[1].split(", 6) AS chi2", 1)[0]
    density = "exp(-{u} * {u} / 2) / sqrt(2 * pi())"
    return (
        f"{ctes}, z AS (SELECT sqrt({chi2}) AS z FROM c), {_half_area('z', density, 'z')} SELECT CAST(a AS BIGINT){select}, h"
    ).replace(" AS dof FROM c, h", f" AS dof, round(1 - 2 * half, 6) AS p_value, 1 - 2 * half < {_P.SIGNIFICANCE_LEVEL} AS significant FROM c, h")


@register("chi_square_test", _chi_test_sql())
def chi_square_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Yates-corrected chi-square, p-value and significance flag."""
    return tidy(M.chi_square_test(startups.enriched_companies(spark, sf_dir)))


@register(
    "ml_impact",
    f"WITH {O.enrich_ctes()} SELECT CAST(count(*) AS BIGINT) AS total_ml, "
    "CAST(count(*) FILTER (WHERE investors_count IS NULL) AS BIGINT) AS missing_in_ml, "
    f"round(CAST(count(*) FILTER (WHERE investors_count IS NULL) AS DOUBLE) * {D(100.0)} / count(*), 6) AS missing_pct "
    f"FROM enr WHERE {_KNOWN}",
)
def ml_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(M.ml_impact(startups.enriched_companies(spark, sf_dir)))


# ---------------------------------------------------------------------------
# Prospects -- X1-X3, X5-X8
# ---------------------------------------------------------------------------

from startlens.operators import prospects as X  # noqa: E402


def _pfmt(expr: str, digits: int) -> str:
    # DuckDB's printf rounds the exact binary value half-to-even, as Python does
    return f"printf('%.{digits}f', CAST({expr} AS DOUBLE))"


def _prospect_par(i: int) -> str:
    pp = _P.PROSPECT_STAGE_PARAMS
    fb = pp[_P.PROSPECT_FALLBACK_STAGE]
    return O.case_map("stage", {k: v[i] for k, v in pp.items()}, fb[i], as_double=True)


def _prospect_kpi_ctes(src: str) -> str:
    """CTEs p3..p6 computing the prospect KPIs and score from ``src``."""
    par = _prospect_par
    return f"""p3 AS (SELECT *, greatest(1, {_P.PROSPECT_CURRENT_YEAR} - founded_year) AS age,
  funding_amount * {par(1)} AS estimated_revenue, funding_amount / {par(0)} AS monthly_burn, {par(2)} AS r40b, {par(3)} AS w FROM {src}),
p4 AS (SELECT *, least({D(1.0)}, CASE WHEN funding_amount > 0 THEN estimated_revenue / funding_amount ELSE {D(0.0)} END) AS capital_efficiency,
  least({D(24.0)}, CASE WHEN monthly_burn > 0 THEN (funding_amount * {D(0.5)}) / monthly_burn ELSE {D(0.0)} END) AS runway_months,
  least({D(10.0)}, greatest({D(0.3)}, CASE WHEN estimated_revenue > 0 THEN (monthly_burn * 12) / estimated_revenue ELSE {D(10.0)} END)) AS burn_multiple,
  least({D(100.0)}, (log10(greatest({D(float(_P.PROSPECT_MIN_FUNDING_FOR_LOG))}, funding_amount)) * investors_count * w) / age) AS traction_index FROM p3),
p5 AS (SELECT *, greatest({D(0.0)}, least({D(150.0)}, r40b + (capital_efficiency - {D(0.30)}) * 50)) AS rule_of_40 FROM p4),
p6 AS (SELECT *, least({D(100.0)}, rule_of_40) * {D(0.25)} + traction_index * {D(0.25)} + capital_efficiency * 100 * {D(0.20)}
  + least({D(100.0)}, CASE WHEN burn_multiple > 0 THEN ({D(1.0)} / burn_multiple) * 50 ELSE {D(0.0)} END) * {D(0.15)}
  + (runway_months / 24) * 100 * {D(0.15)} AS investment_score FROM p5)"""


def _prospect_input_ctes() -> str:
    d = _P.PROSPECT_DEFAULTS
    return f"""p0 AS (SELECT prospect_id, CAST(funding_amount AS DOUBLE) AS funding_amount, coalesce(stage, {O.q(d['stage'])}) AS stage,
  coalesce(sector, {O.q(d['sector'])}) AS sector, coalesce(country, {O.q(d['country'])}) AS country,
  coalesce(CAST(investors_count AS INT), {d['investors_count']}) AS investors_count,
  coalesce(CAST(founded_year AS INT), {d['founded_year']}) AS founded_year FROM prospects),
p1 AS (SELECT prospect_id, funding_amount, trim(stage) AS stage,
  CASE WHEN lower(trim(sector)) = '' THEN 'other' ELSE lower(trim(sector)) END AS sector,
  CASE WHEN upper(trim(country)) = '' THEN 'USA' ELSE upper(trim(country)) END AS country, investors_count, founded_year FROM p0)"""


def _prospect_sql() -> str:
    d = _P.PROSPECT_DEFAULTS
    pp = _P.PROSPECT_STAGE_PARAMS
    fb = pp[_P.PROSPECT_FALLBACK_STAGE]

    def par(i):
        return O.case_map("stage", {k: v[i] for k, v in pp.items()}, fb[i], as_double=True)

    stages = ", ".join(O.q(s) for s in _P.PROSPECT_STAGES)
    lo, hi = _P.PROSPECT_VALID_YEARS
    fund_str = " ".join(
        f"WHEN stage = {O.q(st)} AND funding_amount > {thr} THEN concat({O.q(lab + ' ($')}, {_pfmt('funding_amount / 1e6', 1)}, 'M)')"
        for st, thr, lab in _P.STRONG_FUNDING_BY_STAGE
    )

    def fmt(tpl, val):
        h, t = tpl.split("{}")
        return f"concat({O.q(h)}, {val}, {O.q(t)})"

    strengths = ", ".join([
        f"CASE {fund_str} END",
        f"CASE WHEN investors_count >= 5 THEN {fmt(X.TXT_INVESTORS_GOOD, 'CAST(investors_count AS VARCHAR)')} END",
        f"CASE WHEN capital_efficiency > 0.40 THEN {fmt(X.TXT_CAPEFF_STRONG, _pfmt('capital_efficiency', 2))} END",
        f"CASE WHEN burn_multiple < 1.5 THEN {fmt(X.TXT_BURN_EFFICIENT, _pfmt('burn_multiple', 1))} END",
        f"CASE WHEN runway_months > 15 THEN {fmt(X.TXT_RUNWAY_HEALTHY, _pfmt('runway_months', 0))} END",
        f"CASE WHEN traction_index > 60 THEN {fmt(X.TXT_TRACTION_STRONG, _pfmt('traction_index', 0))} END",
        f"CASE WHEN investment_score > 70 THEN {fmt(X.TXT_SCORE_HIGH, _pfmt('investment_score', 0))} END",
    ])
    concerns = ", ".join([
        f"CASE WHEN investors_count < 5 AND investors_count <= 2 THEN {fmt(X.TXT_INVESTORS_LIMITED, 'CAST(investors_count AS VARCHAR)')} END",
        f"CASE WHEN capital_efficiency <= 0.40 AND capital_efficiency < 0.20 THEN {fmt(X.TXT_CAPEFF_LOW, _pfmt('capital_efficiency', 2))} END",
        f"CASE WHEN burn_multiple >= 1.5 AND burn_multiple > 3.0 THEN {fmt(X.TXT_BURN_HIGH, _pfmt('burn_multiple', 1))} END",
        f"CASE WHEN runway_months <= 15 AND runway_months < 9 THEN {fmt(X.TXT_RUNWAY_LIMITED, _pfmt('runway_months', 0))} END",
        f"CASE WHEN traction_index <= 60 AND traction_index < 30 THEN {fmt(X.TXT_TRACTION_LOW, _pfmt('traction_index', 0))} END",
        f"CASE WHEN investment_score <= 70 AND investment_score < 40 THEN {fmt(X.TXT_SCORE_LOW, _pfmt('investment_score', 0))} END",
    ])
    kinds = {"prospect_id": "i", "funding_amount": "d", "stage": "s", "sector": "s", "country": "s", "investors_count": "i",
             "founded_year": "i", "is_valid": "s", "reject_reasons": "s", "age": "i", "estimated_revenue": "d",
             "capital_efficiency": "d", "monthly_burn": "d", "runway_months": "d", "burn_multiple": "d",
             "traction_index": "d", "rule_of_40": "d", "investment_score": "d", "strengths": "s", "concerns": "s"}
    return f"""WITH {fixtures.FIXTURE_CTES},
p0 AS (SELECT prospect_id, CAST(funding_amount AS DOUBLE) AS funding_amount, coalesce(stage, {O.q(d['stage'])}) AS stage,
  coalesce(sector, {O.q(d['sector'])}) AS sector, coalesce(country, {O.q(d['country'])}) AS country,
  coalesce(CAST(investors_count AS INT), {d['investors_count']}) AS investors_count,
  coalesce(CAST(founded_year AS INT), {d['founded_year']}) AS founded_year FROM prospects),
p1 AS (SELECT prospect_id, funding_amount, trim(stage) AS stage,
  CASE WHEN lower(trim(sector)) = '' THEN 'other' ELSE lower(trim(sector)) END AS sector,
  CASE WHEN upper(trim(country)) = '' THEN 'USA' ELSE upper(trim(country)) END AS country, investors_count, founded_year FROM p0),
p2 AS (SELECT *, concat_ws('; ',
    CASE WHEN NOT coalesce(funding_amount > 0, false) THEN {O.q(X.REJECT_FUNDING)} END,
    CASE WHEN NOT coalesce(stage IN ({stages}), false) THEN {O.q(X.REJECT_STAGE)} END,
    CASE WHEN NOT coalesce(investors_count >= 0, false) THEN {O.q(X.REJECT_INVESTORS)} END,
    CASE WHEN NOT coalesce(founded_year BETWEEN {lo} AND {hi}, false) THEN {O.q(X.REJECT_YEAR)} END) AS reject_reasons FROM p1),
p2b AS (SELECT *, reject_reasons = '' AS is_valid FROM p2),
{_prospect_kpi_ctes('p2b')},
p7 AS (SELECT *, concat_ws('; ', {strengths}) AS strengths, concat_ws('; ', {concerns}) AS concerns FROM p6)
SELECT {_sel(kinds)} FROM p7"""


@register("prospect_scores", _prospect_sql())
def prospect_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = X.score_prospects(fixtures.prospects(spark, sf_dir))
    out = out.withColumns({
        "is_valid": F.col("is_valid").cast("string"),
        "reject_reasons": F.array_join("reject_reasons", "; "),
        "strengths": F.array_join("strengths", "; "),
        "concerns": F.array_join("concerns", "; "),
    })
    return tidy(out)


def _bands_prob_sql() -> str:
    (h_hi, h_lo), (m_hi, m_lo) = _P.CONFIDENCE_HIGH, _P.CONFIDENCE_MEDIUM
    rec = " ".join(f"WHEN p >= {b} THEN {O.q(t)}" for b, t in _P.RECOMMENDATIONS)
    ctx = " ".join(f"WHEN p >= {b} THEN {O.q(t)}" for b, t in _P.PERCENTILE_CONTEXT)
    return (
        f"WITH {fixtures.FIXTURE_CTES}, s AS (SELECT doc_id, label, score AS p FROM predictions) "
        f"SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(label AS BIGINT) AS label, round(p, 6) AS success_probability, "
        f"CASE WHEN p > {h_hi} OR p < {h_lo} THEN 'HIGH' WHEN p > {m_hi} OR p < {m_lo} THEN 'MEDIUM' WHEN p IS NOT NULL THEN 'LOW' END AS confidence, "
        f"CASE {rec} WHEN p IS NOT NULL THEN {O.q(_P.RECOMMENDATION_ELSE)} END AS recommendation, "
        f"CASE {ctx} WHEN p IS NOT NULL THEN {O.q(_P.PERCENTILE_CONTEXT_ELSE)} END AS percentile_context FROM s"
    )


@register("probability_bands", _bands_prob_sql())
def probability_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = fixtures.predictions(spark, sf_dir).withColumnRenamed("score", "success_probability")
    return tidy(X.with_probability_bands(p))


# ---------------------------------------------------------------------------
# ML: labels, split, features -- M1-M6, A8, U1, U3, P14, P16
# ---------------------------------------------------------------------------


from startlens.operators import metrics as MT  # noqa: E402
from startlens.operators import ml as ML  # noqa: E402

_LAB_CTE = (f"{O.score_ctes()}, lab AS (SELECT *, CASE WHEN status IN ('acquired', 'ipo') THEN 1 WHEN status = 'closed' THEN 0 "
            "ELSE -1 END AS success FROM scored)")
_SPLIT_CTE = (f"{_LAB_CTE}, s AS (SELECT *, CAST(CAST('0x' || substring(md5(concat(CAST(id AS VARCHAR), ':', '42')), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296 < CAST(0.2 AS DOUBLE) AS is_test "
              "FROM lab WHERE success <> -1)")


@register(
    "ml_label_distribution",
    f"WITH {_LAB_CTE} SELECT CAST(success AS BIGINT) AS success, CAST(count(*) AS BIGINT) AS companies, "
    "round(CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM lab), 6) AS share FROM lab GROUP BY success",
)
def ml_label_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(ML.label_distribution(startups.scored_companies(spark, sf_dir)))


@register(
    "ml_split_summary",
    f"WITH {_SPLIT_CTE} SELECT CAST(success AS BIGINT) AS success, CAST(is_test AS VARCHAR) AS is_test, "
    "CAST(count(*) AS BIGINT) AS companies FROM s GROUP BY success, is_test",
)
def ml_split_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    lab = ML.label_outcomes(startups.scored_companies(spark, sf_dir))
    s = lab.withColumn("is_test", ML.split_column("id", 42, 0.2))
    out = s.groupBy("success", "is_test").agg(F.count(F.lit(1)).alias("companies"))
    return tidy(out.withColumn("is_test", F.col("is_test").cast("string")))


def _features_long(spark: SparkSession, sf_dir: str, drop_first: bool) -> DataFrame:
    lab = ML.label_outcomes(startups.scored_companies(spark, sf_dir))
    s = lab.withColumn("is_test", ML.split_column("id", 42, 0.2))
    fm = ML.fit_features(s.where(~F.col("is_test")), drop_first=drop_first)
    x = fm.transform(s)
    names = ML.feature_names(x)
    # only the entries that are not zero: rows x filled features, not rows x vocabulary
    v = F.unwrap_udt("features")
    entries = F.when(v["type"] == 0, F.arrays_zip(v["indices"].alias("pos"), v["values"].alias("value"))).otherwise(
        F.transform(v["values"], lambda e, i: F.struct(i.alias("pos"), e.alias("value")))
    )
    long = x.select("id", "is_test", F.inline(entries).alias("pos", "value")).where("value <> 0")
    out = long.select("id", F.col("is_test").cast("string").alias("is_test"),
                      F.element_at(F.array(*[F.lit(n) for n in names]), F.col("pos") + 1).alias("feature"), "value")
    return tidy(out)


def _features_sql(drop_first: bool) -> str:
    from startlens.functions import params as P

    cats = P.CATEGORICAL_FEATURES
    vocab = " UNION ALL ".join(
        f"SELECT DISTINCT '{c}' AS col, {c} AS v FROM s WHERE NOT is_test AND {c} IS NOT NULL" for c in cats
    )
    keep = "WHERE rn > 1" if drop_first else ""
    nums = " UNION ALL ".join(
        f"SELECT id, is_test, '{c}' AS feature, coalesce(CAST({c} AS DOUBLE), {D(0.0)}) AS value FROM s" for c in P.NUMERIC_FEATURES
    )
    match = " OR ".join(f"(vs.col = '{c}' AND s.{c} = vs.v)" for c in cats)
    return (
        f"WITH {_SPLIT_CTE}, v0 AS ({vocab}), vs AS (SELECT col, v FROM (SELECT *, row_number() OVER (PARTITION BY col ORDER BY v) AS rn "
        f"FROM v0) t {keep}), num AS ({nums}), "
        f"cat AS (SELECT s.id, s.is_test, vs.col || '_' || vs.v AS feature, CASE WHEN {match} THEN {D(1.0)} ELSE {D(0.0)} END AS value "
        f"FROM s CROSS JOIN vs), a AS (SELECT * FROM num UNION ALL SELECT * FROM cat) "
        f"SELECT CAST(id AS BIGINT) AS id, CAST(is_test AS VARCHAR) AS is_test, feature, round(value, 6) AS value FROM a WHERE value <> 0"
    )


@register("ml_features", _features_sql(False))
def ml_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M4/M5: feature matrix (all categories kept) in long form."""
    return _features_long(spark, sf_dir, drop_first=False)


@register("ml_features_drop_first", _features_sql(True))
def ml_features_drop_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M3/M5: feature matrix with each first category dropped, long form."""
    return _features_long(spark, sf_dir, drop_first=True)


@register(
    "majority_baseline",
    f"WITH {_LAB_CTE}, c AS (SELECT count(*) FILTER (WHERE success = 1) AS n1, count(*) FILTER (WHERE success = 0) AS n0 FROM lab) "
    f"SELECT CAST(CASE WHEN n1 >= n0 THEN 1 ELSE 0 END AS BIGINT) AS majority_class, "
    f"round(CAST(greatest(n1, n0) AS DOUBLE) / (n1 + n0), 6) AS baseline_accuracy FROM c",
)
def majority_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Always-predict-the-majority accuracy on known outcomes."""
    lab = ML.label_outcomes(startups.scored_companies(spark, sf_dir))
    return tidy(MT.majority_baseline(lab, "label"))


# ---------------------------------------------------------------------------
# Metric operators on a stored prediction table -- M12, M13
# ---------------------------------------------------------------------------

_PRED_CTE = f"{fixtures.FIXTURE_CTES}, pr AS (SELECT doc_id, label, score, CASE WHEN score >= 0.5 THEN 1 ELSE 0 END AS prediction FROM predictions)"


def _pred_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = fixtures.predictions(spark, sf_dir)
    return p.withColumn("prediction", (F.col("score") >= 0.5).cast("int"))


@register(
    "prediction_metrics",
    f"WITH {_PRED_CTE}, c AS (SELECT count(*) FILTER (WHERE label = 0 AND prediction = 0) AS tn, "
    "count(*) FILTER (WHERE label = 0 AND prediction = 1) AS fp, count(*) FILTER (WHERE label = 1 AND prediction = 0) AS fn, "
    "count(*) FILTER (WHERE label = 1 AND prediction = 1) AS tp FROM pr) "
    "SELECT CAST(tn AS BIGINT) AS tn, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, CAST(tp AS BIGINT) AS tp, "
    "round(coalesce(CAST(tp + tn AS DOUBLE) / nullif(tn + fp + fn + tp, 0), 0), 6) AS accuracy, "
    "round(coalesce(CAST(tp AS DOUBLE) / nullif(tp + fp, 0), 0), 6) AS precision, "
    "round(coalesce(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 0), 6) AS recall, "
    "round(coalesce(CAST(2 * tp AS DOUBLE) / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1 FROM c",
)
def prediction_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(MT.binary_metrics(_pred_df(spark, sf_dir)))


def _report_sql() -> str:
    z = "coalesce({a} / nullif({b}, 0), 0)"
    c0 = {"p": z.format(a="CAST(tn AS DOUBLE)", b="tn + fn"), "r": z.format(a="CAST(tn AS DOUBLE)", b="tn + fp"),
          "f": z.format(a="CAST(2 * tn AS DOUBLE)", b="2 * tn + fn + fp"), "s": "(tn + fp)"}
    c1 = {"p": z.format(a="CAST(tp AS DOUBLE)", b="tp + fp"), "r": z.format(a="CAST(tp AS DOUBLE)", b="tp + fn"),
          "f": z.format(a="CAST(2 * tp AS DOUBLE)", b="2 * tp + fp + fn"), "s": "(tp + fn)"}
    n = "(tn + fp + fn + tp)"

    def w(k):
        return z.format(a=f"({c0[k]} * {c0['s']} + {c1[k]} * {c1['s']})", b=n)

    rows = [
        f"SELECT '0' AS class, {c0['p']} AS precision, {c0['r']} AS recall, {c0['f']} AS f1, {c0['s']} AS support FROM c",
        f"SELECT '1', {c1['p']}, {c1['r']}, {c1['f']}, {c1['s']} FROM c",
        f"SELECT 'macro avg', ({c0['p']} + {c1['p']}) / 2, ({c0['r']} + {c1['r']}) / 2, ({c0['f']} + {c1['f']}) / 2, {n} FROM c",
        f"SELECT 'weighted avg', {w('p')}, {w('r')}, {w('f')}, {n} FROM c",
    ]
    return (
        f"WITH {_PRED_CTE}, c AS (SELECT count(*) FILTER (WHERE label = 0 AND prediction = 0) AS tn, "
        "count(*) FILTER (WHERE label = 0 AND prediction = 1) AS fp, count(*) FILTER (WHERE label = 1 AND prediction = 0) AS fn, "
        f"count(*) FILTER (WHERE label = 1 AND prediction = 1) AS tp FROM pr), r AS ({' UNION ALL '.join(rows)}) "
        "SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, "
        "CAST(support AS BIGINT) AS support FROM r"
    )


@register("classification_report", _report_sql())
def classification_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(MT.classification_report(_pred_df(spark, sf_dir)))


_HIST_CTE = (f"{_PRED_CTE}, h AS (SELECT score, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label = 0) AS neg "
             "FROM pr WHERE score IS NOT NULL GROUP BY score)")


@register(
    "roc_auc",
    f"WITH {_HIST_CTE}, c AS (SELECT *, coalesce(sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) "
    "AS neg_before FROM h) SELECT CAST(sum(pos) AS BIGINT) AS n_pos, CAST(sum(neg) AS BIGINT) AS n_neg, "
    "round(sum(pos * (neg_before + neg / 2.0)) / (CAST(sum(pos) AS DOUBLE) * sum(neg)), 6) AS roc_auc FROM c",
)
def roc_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(MT.roc_auc(_pred_df(spark, sf_dir)))


@register(
    "roc_points",
    f"WITH {_HIST_CTE}, c AS (SELECT *, sum(neg) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cn, "
    "sum(pos) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cp, "
    "sum(neg) OVER () AS tn_all, sum(pos) OVER () AS tp_all FROM h) "
    "SELECT round(score, 6) AS threshold, round(CAST(cn AS DOUBLE) / tn_all, 6) AS fpr, round(CAST(cp AS DOUBLE) / tp_all, 6) AS tpr FROM c",
)
def roc_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(MT.roc_points(_pred_df(spark, sf_dir)))


# ---------------------------------------------------------------------------
# Models -- M7-M11, M14-M19, S6, X4, X9 (rows-only: iterative learners)
# ---------------------------------------------------------------------------

def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ML.label_outcomes(startups.scored_companies(spark, sf_dir))


@register("model_comparison")
def model_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four models: test metrics, 5-fold CV F1, fit time (rows-only)."""
    return ML.compare_models(_labelled(spark, sf_dir), cv_folds=5)


@register("best_model_by_metric")
def best_model_by_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best model per metric over a comparison without CV (rows-only)."""
    return ML.best_by_metric(ML.compare_models(_labelled(spark, sf_dir), cv_folds=0))


from startlens.operators import forest as FO  # noqa: E402


def _forest(spark: SparkSession, sf_dir: str) -> tuple[FO.TableForest, DataFrame]:
    """The single-model training path (M18): one-hot with the first
    category of each column dropped (M3), unlike the comparison (M4)."""
    lab = materialize(_labelled(spark, sf_dir), "labelled")
    return FO.grow_forest(lab.where(~ML.split_column("id", 42, 0.2))), lab


_FOREST_CTE = f"{_SPLIT_CTE}, {O.forest_ctes('s')}"


@register(
    "forest_nodes",
    f"WITH RECURSIVE {_FOREST_CTE} SELECT CAST(n.tree AS BIGINT) AS tree, n.node, CAST(n.depth AS BIGINT) AS depth, fe.name AS feature, "
    'round(s."limit", 6) AS "limit", CASE WHEN s.f IS NOT NULL THEN 2 * n.node END AS "left", CASE WHEN s.f IS NOT NULL THEN 2 * n.node + 1 END AS "right", '
    "round(coalesce(gain, 0), 6) AS gain, round(prediction, 6) AS prediction, CAST(weight AS BIGINT) AS weight, CAST(positives AS BIGINT) AS positives "
    "FROM nodes n LEFT JOIN splits s ON s.tree = n.tree AND s.node = n.node LEFT JOIN fe ON fe.f = s.f",
)
def forest_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trained forest as one table, a row per node."""
    forest, _ = _forest(spark, sf_dir)
    names = forest.features.select("feature", "name")
    out = forest.nodes.join(F.broadcast(names), "feature", "left")
    return tidy(out.select("tree", "node", "depth", F.col("name").alias("feature"), *[c for c in forest.nodes.columns[4:]]))


@register(
    "feature_importance",
    f"WITH RECURSIVE {_FOREST_CTE}, pt AS (SELECT tree, f, sum(gain) / sum(sum(gain)) OVER (PARTITION BY tree) AS share FROM splits GROUP BY tree, f), "
    "pf AS (SELECT name AS feature, coalesce(sum(share), 0) / (SELECT sum(share) FROM pt) AS importance FROM fe LEFT JOIN pt USING (f) GROUP BY name), "
    "r AS (SELECT *, row_number() OVER (ORDER BY round(importance, 9) DESC, feature) AS rank FROM pf) "
    "SELECT feature, round(importance, 6) AS importance, rank, round(sum(importance) OVER (ORDER BY rank), 6) AS cumulative FROM r QUALIFY rank <= 15",
)
def feature_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top-15 importances of the forest with cumulative share."""
    forest, _ = _forest(spark, sf_dir)
    return tidy(FO.top_importance(forest, 15))


def _prospect_predictions_sql() -> str:
    chain = _prospect_sql().rsplit("\nSELECT ", 1)[0].split("\np0 AS", 1)[1]
    bands = _bands_prob_sql().split("AS success_probability, ", 1)[1].removesuffix(" FROM s")
    return (
        f"WITH RECURSIVE {_FOREST_CTE}, p0 AS{chain}, pl AS ({O.feature_long('p7', 'prospect_id')}), {O.forest_scores('prospect_id', 'pl')}, "
        "pp AS (SELECT p7.*, CASE WHEN is_valid THEN scores.p END AS p FROM p7 JOIN scores USING (prospect_id)) "
        "SELECT CAST(prospect_id AS BIGINT) AS prospect_id, stage, sector, country, CAST(is_valid AS VARCHAR) AS is_valid, "
        "round(investment_score, 6) AS investment_score, round(p, 6) AS success_probability, "
        f"round(investment_score * {D(0.4)} + p * 100 * {D(0.4)} + traction_index * {D(0.2)}, 6) AS composite_score, {bands}, strengths, concerns FROM pp"
    )


@register("prospect_predictions", _prospect_predictions_sql())
def prospect_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Train, write and read back the forest's tables, then score every
    prospect: KPIs (X1), features with the trained categories (X4), probability (M19),
    the 40/40/20 composite (D12), confidence, recommendation, context (X5,
    X7, X8). Rejected prospects (X2) get no probability and nothing drawn from it."""
    import uuid

    from startlens.session import ensure_checkpoint_dir

    forest, _ = _forest(spark, sf_dir)
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/models/forest-{uuid.uuid4().hex}"
    forest.write(path)
    pred = X.predict_prospects(FO.read_forest(spark, path), fixtures.prospects(spark, sf_dir))
    out = pred.withColumn("composite_score", AN.composite_score()).select(
        "prospect_id", "stage", "sector", "country", F.col("is_valid").cast("string").alias("is_valid"), "investment_score",
        "success_probability", "composite_score", "confidence", "recommendation", "percentile_context",
        F.array_join("strengths", "; ").alias("strengths"), F.array_join("concerns", "; ").alias("concerns"),
    )
    return tidy(out)


# ---------------------------------------------------------------------------
# Generic loader through a CSV round trip -- S1, S4, P2-P9, F2, F3, F10
# ---------------------------------------------------------------------------

from startlens.operators import analysis as AN  # noqa: E402
from startlens.operators import clean as CL  # noqa: E402
from startlens.sources import tables as TB  # noqa: E402


def _generic_ctes() -> str:
    """CTE chain ending in ``gstd``: the standardised, funded generic extract."""
    from startlens.functions import params as P

    t = "trim(stage)"
    title = ("array_to_string(list_transform(regexp_extract_all(" + t + ", '([\\p{Lu}\\p{Ll}\\p{Lt}]+|[^\\p{Lu}\\p{Ll}\\p{Lt}]+)'), "
             "lambda p: upper(substring(p, 1, 1)) || lower(substring(p, 2))), '')")
    mapped = O.case_map(f"lower({t})", P.GENERIC_STAGE_MAP)
    return (
        f"{fixtures.FIXTURE_CTES}, g AS (SELECT * FROM generic_extract WHERE entity_type = 'Company'), "
        f"c AS (SELECT trim(name) AS company, "
        f"CASE WHEN stage IS NULL OR {t} = '' THEN NULL ELSE coalesce({mapped}, {title}) END AS stage, "
        "trim(country_code) AS country, trim(coalesce(category_code, industry)) AS sector, "
        "TRY_CAST(funding_total_usd AS DOUBLE) AS funding_amount, TRY_CAST(participants AS DOUBLE) AS investors_count, "
        "CAST(year(TRY_CAST(founded_at AS DATE)) AS DOUBLE) AS founded_year FROM g), "
        "gstd AS (SELECT * FROM c WHERE funding_amount > 0)"
    )


def _generic_sql() -> str:
    return (
        f"WITH {_generic_ctes()} SELECT company, stage, country, sector, round(funding_amount, 6) AS funding_amount, "
        "round(investors_count, 6) AS investors_count, round(founded_year, 6) AS founded_year FROM gstd"
    )


@register("generic_loader", _generic_sql())
def generic_loader(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the raw extract as header CSV (sink), read it back as text
    (scan), standardise it and keep funded companies."""
    import uuid

    from startlens.session import ensure_checkpoint_dir

    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/extracts/generic-{uuid.uuid4().hex}"
    TB.write_table(fixtures.generic_extract(spark, sf_dir), path, fmt="csv")
    raw = TB.read_csv(spark, path)
    return tidy(CL.standardize_startups(raw, filter_funded=True))


# ---------------------------------------------------------------------------
# Analyses described beside the method -- D8-D11, D13-D15, D17, D18
# ---------------------------------------------------------------------------

from startlens.operators import kpi as K  # noqa: E402
from startlens.operators import report as RP  # noqa: E402

TIME_SPLIT_CUTOFF = 1995  # test companies are founded 1980-2000


@register(
    "stage_baseline",
    f"WITH {_SPLIT_CTE}, tr AS (SELECT stage, avg(CAST(success AS DOUBLE)) AS r, avg(funding_amount) AS mf, count(*) AS n "
    "FROM s WHERE NOT is_test GROUP BY stage), ov AS (SELECT avg(CAST(success AS DOUBLE)) AS o FROM s WHERE NOT is_test) "
    "SELECT CAST(s.id AS BIGINT) AS id, s.stage, CAST(s.success AS BIGINT) AS label, round(coalesce(tr.r, ov.o), 6) AS baseline_probability, "
    "round(tr.r, 6) AS stage_success_rate, round(tr.mf, 2) AS stage_mean_funding, CAST(tr.n AS BIGINT) AS stage_train_rows "
    "FROM s LEFT JOIN tr ON s.stage IS NOT DISTINCT FROM tr.stage CROSS JOIN ov WHERE s.is_test",
)
def stage_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    lab = ML.label_outcomes(startups.scored_companies(spark, sf_dir)).withColumn("is_test", ML.split_column("id", 42, 0.2))
    out = AN.stage_baseline(lab.where(~F.col("is_test")), lab.where(F.col("is_test")))
    out = out.select("id", "stage", F.col("label").cast("long").alias("label"), "baseline_probability", "stage_success_rate",
                     "stage_mean_funding", "stage_train_rows")
    return tidy(out, overrides={"stage_mean_funding": 2})


@register(
    "time_split_summary",
    f"WITH {_LAB_CTE}, t AS (SELECT CASE WHEN founded_year < {TIME_SPLIT_CUTOFF} THEN 'train' WHEN founded_year >= {TIME_SPLIT_CUTOFF} "
    "THEN 'test' ELSE 'unknown' END AS time_side, success FROM lab WHERE success <> -1) "
    "SELECT time_side, CAST(success AS BIGINT) AS success, CAST(count(*) AS BIGINT) AS companies FROM t GROUP BY time_side, success",
)
def time_split_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    lab = AN.time_split(ML.label_outcomes(startups.scored_companies(spark, sf_dir)), TIME_SPLIT_CUTOFF)
    return tidy(lab.groupBy("time_side", "success").agg(F.count(F.lit(1)).alias("companies")))


@register(
    "investor_imputation",
    f"WITH {O.enrich_ctes()}, m AS (SELECT stage, sector, quantile_cont(investors_count, 0.5) AS med FROM enr "
    "WHERE investors_count IS NOT NULL GROUP BY stage, sector) "
    "SELECT CAST(e.id AS BIGINT) AS id, e.stage, e.sector, CAST(e.investors_count AS BIGINT) AS investors_count, "
    "round(coalesce(CAST(e.investors_count AS DOUBLE), m.med), 6) AS investors_count_imputed "
    "FROM enr e LEFT JOIN m ON e.stage IS NOT DISTINCT FROM m.stage AND e.sector IS NOT DISTINCT FROM m.sector",
)
def investor_imputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = materialize(startups.enriched_companies(spark, sf_dir).select("id", "stage", "sector", "investors_count"))
    return tidy(AN.impute_group_median(e, "investors_count", ["stage", "sector"]))


def _sensitivity_sql() -> str:
    vals = ", ".join(f"({O.q(n)}, {D(float(f))}, {int(d)})" for n, f, d in AN.SCENARIOS)
    kinds = {"prospect_id": "i", "scenario": "s", "funding_amount": "d", "investors_count": "i", "capital_efficiency": "d",
             "runway_months": "d", "burn_multiple": "d", "traction_index": "d", "rule_of_40": "d", "investment_score": "d"}
    return (
        f"WITH {fixtures.FIXTURE_CTES}, {_prospect_input_ctes()}, "
        f"sc(scenario, f, dlt) AS (VALUES {vals}), "
        "px AS (SELECT p1.prospect_id, sc.scenario, p1.funding_amount * sc.f AS funding_amount, p1.stage, p1.sector, p1.country, "
        "p1.investors_count + sc.dlt AS investors_count, p1.founded_year FROM p1 CROSS JOIN sc), "
        f"{_prospect_kpi_ctes('px')} SELECT {_sel(kinds)} FROM p6"
    )


@register("prospect_sensitivity", _sensitivity_sql())
def prospect_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = X.normalize_inputs(X.apply_defaults(fixtures.prospects(spark, sf_dir)))
    out = AN.sensitivity(base)
    return tidy(out.select("prospect_id", "scenario", "funding_amount", "investors_count", "capital_efficiency", "runway_months",
                           "burn_multiple", "traction_index", "rule_of_40", "investment_score"))


@register(
    "sector_normalized_funding",
    f"WITH {O.enrich_ctes()}, b AS (SELECT *, min(funding_amount) OVER (PARTITION BY sector) AS lo, "
    "max(funding_amount) OVER (PARTITION BY sector) AS hi FROM enr) "
    "SELECT CAST(id AS BIGINT) AS id, sector, round(funding_amount, 6) AS funding_amount, "
    f"round(CASE WHEN hi = lo THEN CASE WHEN funding_amount IS NOT NULL THEN {D(50.0)} END "
    "ELSE (funding_amount - lo) / (hi - lo) * 100 END, 6) AS funding_amount_sector_norm FROM b",
)
def sector_normalized_funding(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = startups.enriched_companies(spark, sf_dir).select("id", "sector", "funding_amount")
    return tidy(AN.within_group_minmax(e, "funding_amount", "sector"))


@register(
    "kpi_bands",
    f"WITH {O.kpi_ctes()} SELECT CAST(id AS BIGINT) AS id, "
    "CASE WHEN capital_efficiency > 1.0 THEN 'excellent' WHEN capital_efficiency >= 0.5 THEN 'good' WHEN capital_efficiency >= 0.2 "
    "THEN 'acceptable' WHEN capital_efficiency IS NOT NULL THEN 'low' END AS capital_efficiency_band, "
    "CASE WHEN burn_multiple < 1.0 THEN 'excellent' WHEN burn_multiple <= 1.5 THEN 'good' WHEN burn_multiple <= 3.0 THEN 'moderate' "
    "WHEN burn_multiple IS NOT NULL THEN 'concerning' END AS burn_multiple_band, "
    "CASE WHEN rule_of_40 >= 40 THEN 'excellent' WHEN rule_of_40 >= 30 THEN 'good' WHEN rule_of_40 >= 20 THEN 'acceptable' "
    "WHEN rule_of_40 IS NOT NULL THEN 'concerning' END AS rule_of_40_band, "
    "CASE WHEN traction_index >= 60 THEN 'exceptional' WHEN traction_index >= 40 THEN 'strong' WHEN traction_index >= 20 THEN 'moderate' "
    "WHEN traction_index IS NOT NULL THEN 'early' END AS traction_band FROM kpis",
)
def kpi_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = K.kpi_bands(startups.companies_with_kpis(spark, sf_dir))
    return tidy(k.select("id", "capital_efficiency_band", "burn_multiple_band", "rule_of_40_band", "traction_band"))


def _dist_sql() -> str:
    parts = [
        ("entity_type", "objects", "entity_type"),
        ("status", "enr", "status"),
        ("stage", "enr", "stage"),
        ("country", "enr", "country"),
    ]
    sel = " UNION ALL ".join(
        f"SELECT '{dim}' AS dimension, CAST({col} AS VARCHAR) AS value, count(*) AS companies, "
        f"CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM {tab}) AS share FROM {tab} GROUP BY {col}"
        for dim, tab, col in parts
    )
    return (f"WITH {O.enrich_ctes()}, d AS ({sel}) SELECT dimension, value, CAST(companies AS BIGINT) AS companies, "
            "round(share, 6) AS share FROM d")


@register("distributions", _dist_sql())
def distributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Value counts and shares of entity type, status, stage, country."""
    all_kinds = RP.distributions(fixtures.objects(spark, sf_dir), ["entity_type"])
    return tidy(all_kinds.unionByName(RP.distributions(startups.enriched_companies(spark, sf_dir), ["status", "stage", "country"])))


def _pivot_sql() -> str:
    from startlens.functions import params as P

    cols = ", ".join(f'CAST(count(*) FILTER (WHERE stage = {O.q(s)}) AS BIGINT) AS "{s}"' for s in P.STAGE_PARAMS)
    return f"WITH {O.enrich_ctes()} SELECT sector, {cols} FROM enr GROUP BY sector"


@register("sector_stage_matrix", _pivot_sql())
def sector_stage_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Companies per sector x stage (heat-map data)."""
    return tidy(AN.pivot_counts(startups.enriched_companies(spark, sf_dir), "sector", "stage"))


@register(
    "alternative_labels",
    f"WITH {O.enrich_ctes()} SELECT CAST(id AS BIGINT) AS id, "
    "CAST(coalesce(stage IN ('Series B', 'Series C', 'Series D+'), false) AS VARCHAR) AS reached_series_b, "
    "CAST(coalesce(funding_amount > 10000000, false) AS VARCHAR) AS raised_over_10m FROM enr",
)
def alternative_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = AN.alternative_labels(startups.enriched_companies(spark, sf_dir)).select(
        "id", F.col("reached_series_b").cast("string").alias("reached_series_b"),
        F.col("raised_over_10m").cast("string").alias("raised_over_10m"))
    return tidy(out)


# ---------------------------------------------------------------------------
# Streaming prospect scoring (the interactive loop as a file stream)
# ---------------------------------------------------------------------------

@register("prospect_stream_scores", ORACLE["prospect_scores"])
def prospect_stream_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prospect files stream through the scorer (parquet sink,
    checkpointed); the sink must equal the batch result."""
    import uuid

    from startlens.session import ensure_checkpoint_dir
    from startlens.streaming import prospects as SP

    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/streams/prospects-{uuid.uuid4().hex}"
    src = fixtures.prospects(spark, sf_dir)
    src.write.mode("overwrite").parquet(f"{base}/input")
    q = SP.start_scoring(spark, f"{base}/input", f"{base}/output", f"{base}/_checkpoint")
    q.awaitTermination()
    out = spark.read.schema(SP.score_stream(src).schema).parquet(f"{base}/output")
    cols = ["prospect_id", "funding_amount", "stage", "sector", "country", "investors_count", "founded_year", "is_valid",
            "reject_reasons", "age", "estimated_revenue", "capital_efficiency", "monthly_burn", "runway_months", "burn_multiple",
            "traction_index", "rule_of_40", "investment_score", "strengths", "concerns"]
    return tidy(out.select(*cols).withColumn("is_valid", F.col("is_valid").cast("string")))


# ---------------------------------------------------------------------------
# Point lookup and column bounds -- P15, A16
# ---------------------------------------------------------------------------

from startlens.operators import rank as RK  # noqa: E402

_LOOKUP_KINDS = dict(_RANKED_KINDS)


@register(
    "company_lookup",
    f"WITH {O.score_ctes()}, r AS (SELECT *, row_number() OVER (ORDER BY investment_score DESC NULLS LAST, id) AS rank FROM scored), "
    "n AS (SELECT company FROM r WHERE rank = 1), m AS (SELECT * FROM r WHERE company = (SELECT company FROM n) "
    "ORDER BY rank LIMIT 1) "
    f"SELECT {_sel(_LOOKUP_KINDS)} FROM m",
)
def company_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Look a company up by name (the name of the top-ranked company, taken
    with a scalar subquery): first match by rank."""
    scored = startups.scored_companies(spark, sf_dir)
    top_name = RK.top_n(scored, 1).select("company").scalar()
    return tidy(RK.rank_of_company(scored, top_name))


_BOUND_COLS = ["funding_amount", "investors_count", "founded_year", "investment_score", "traction_index"]


@register(
    "column_bounds",
    f"WITH {O.score_ctes()} "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, round(CAST(min({c}) AS DOUBLE), 6) AS min, round(CAST(max({c}) AS DOUBLE), 6) AS max, "
        f"round(avg({c}), {2 if c == 'funding_amount' else 6}) AS mean FROM scored"
        for c in _BOUND_COLS
    ),
)
def column_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = RP.column_bounds(startups.scored_companies(spark, sf_dir), _BOUND_COLS).withColumnRenamed("column", "column_name")
    out = out.withColumn("mean", F.when(F.col("column_name") == "funding_amount", F.round("mean", 2)).otherwise(F.round("mean", 6)))
    return tidy(out)


# ---------------------------------------------------------------------------
# Exact stratified split -- M6 (exact mode)
# ---------------------------------------------------------------------------

def _alloc_sql(src: str, n_expr: str, name: str) -> str:
    """Proportional allocation of ``n_expr`` draws over (success, cnt) rows
    of ``src``: floor of the share, +1 for the largest remainders."""
    return (
        f"{name}0 AS (SELECT success, cnt, CAST(cnt AS DOUBLE) / (SELECT sum(cnt) FROM {src}) * ({n_expr}) AS cont FROM {src}), "
        f"{name}1 AS (SELECT *, floor(cont) AS fl, row_number() OVER (ORDER BY cont - floor(cont) DESC, success) AS rk FROM {name}0), "
        f"{name} AS (SELECT success, cnt, CAST(fl AS BIGINT) + CASE WHEN rk <= ({n_expr}) - (SELECT sum(fl) FROM {name}1) THEN 1 ELSE 0 END "
        f"AS alloc FROM {name}1)"
    )


_STRAT_SQL = (
    f"WITH {_LAB_CTE}, s AS (SELECT * FROM lab WHERE success <> -1), "
    "c AS (SELECT success, count(*) AS cnt FROM s GROUP BY success), "
    f"t AS (SELECT sum(cnt) AS n, CAST(ceil(CAST(sum(cnt) AS DOUBLE) * {D(0.2)}) AS BIGINT) AS n_test FROM c), "
    + _alloc_sql("c", "(SELECT n - n_test FROM t)", "tr") + ", "
    "rem AS (SELECT success, cnt - alloc AS cnt FROM tr), "
    + _alloc_sql("rem", "(SELECT n_test FROM t)", "te") + ", "
    "r AS (SELECT s.id, s.success, row_number() OVER (PARTITION BY s.success ORDER BY md5(concat(CAST(id AS VARCHAR), ':', '42')), id) - 1 "
    "AS pos FROM s) "
    "SELECT CAST(r.id AS BIGINT) AS id, CAST(r.success AS BIGINT) AS success, CAST(r.pos < te.alloc AS VARCHAR) AS is_test "
    "FROM r JOIN te ON r.success = te.success"
)


@register("ml_stratified_split", _STRAT_SQL)
def ml_stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    lab = ML.label_outcomes(startups.scored_companies(spark, sf_dir))
    s = ML.stratified_split(lab.select("id", "success"), "success", "id", 0.2, 42)
    return tidy(s.select("id", "success", F.col("is_test").cast("string").alias("is_test")))


@register(
    "highest_missing_stage",
    f"SELECT stage, missing_pct FROM ({_by_group_sql('stage', None, None)}) q ORDER BY missing_pct DESC, stage DESC LIMIT 1",
)
def highest_missing_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stage with the highest missing-investor rate."""
    by = M.missing_by_group(startups.enriched_companies(spark, sf_dir), "stage")
    return tidy(M.highest_missing_group(by, "stage"))


# ---------------------------------------------------------------------------
# Rolling time splits (D9) and benchmark sensitivity
# ---------------------------------------------------------------------------

ROLLING_CUTOFFS = list(range(1990, 2001))  # test companies are founded 1980-2000


@register(
    "rolling_time_splits",
    f"WITH {_LAB_CTE}, c(cutoff_year) AS (VALUES {', '.join(f'({y})' for y in ROLLING_CUTOFFS)}), "
    "x AS (SELECT c.cutoff_year, CASE WHEN founded_year < c.cutoff_year THEN 'train' WHEN founded_year = c.cutoff_year THEN 'test' END "
    "AS time_side, success FROM lab CROSS JOIN c WHERE success <> -1) "
    "SELECT CAST(cutoff_year AS BIGINT) AS cutoff_year, time_side, CAST(success AS BIGINT) AS success, CAST(count(*) AS BIGINT) AS companies "
    "FROM x WHERE time_side IS NOT NULL GROUP BY 1, 2, 3",
)
def rolling_time_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    lab = ML.label_outcomes(startups.scored_companies(spark, sf_dir))
    x = AN.rolling_time_splits(lab, ROLLING_CUTOFFS)
    return tidy(x.groupBy("cutoff_year", "time_side", "success").agg(F.count(F.lit(1)).alias("companies")))


def _benchmark_sql() -> str:
    from startlens.functions import params as P

    vals = ", ".join(f"({D(float(v))})" for v in AN.BENCHMARK_SHIFTS)
    base = O.case_map("stage", {k: v[3] for k, v in P.STAGE_PARAMS.items()}, P.DEFAULT_RULE40_BASE, as_double=True)
    r40 = O.clip(f"{base} + benchmark_shift + (capital_efficiency - {D(P.RULE40_EFFICIENCY_PIVOT)}) * {D(float(P.RULE40_EFFICIENCY_SLOPE))}",
                 *P.RULE40_CLIP)
    sc = O.score_ctes()
    # reuse the scored CTE chain, replacing rule_of_40 and the score
    return (
        f"WITH {sc}, sh(benchmark_shift) AS (VALUES {vals}), "
        f"b AS (SELECT scored.* EXCLUDE (rule_of_40, rule_of_40_norm, investment_score), sh.benchmark_shift, {r40} AS rule_of_40 "
        "FROM scored CROSS JOIN sh), "
        f"b2 AS (SELECT *, {O.clip('rule_of_40', 0, 100)} AS rule_of_40_norm FROM b), "
        f"b3 AS (SELECT *, round_even(({D(0.0)} + rule_of_40_norm * {D(0.25)} + traction_index_norm * {D(0.25)} + capital_efficiency_norm * {D(0.2)}"
        f" + burn_multiple_norm * {D(0.15)} + runway_months_norm * {D(0.15)}) * 100, 0) / 100 AS investment_score FROM b2) "
        "SELECT CAST(id AS BIGINT) AS id, round(benchmark_shift, 6) AS benchmark_shift, round(rule_of_40, 6) AS rule_of_40, "
        "round(rule_of_40_norm, 6) AS rule_of_40_norm, round(investment_score, 6) AS investment_score FROM b3"
    )


@register("benchmark_sensitivity", _benchmark_sql())
def benchmark_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every company with the Rule-of-40 benchmarks at -10/0/+10."""
    out = AN.benchmark_sensitivity(startups.companies_with_kpis(spark, sf_dir))
    return tidy(out.select("id", "benchmark_shift", "rule_of_40", "rule_of_40_norm", "investment_score"))


@register(
    "generic_quality_report",
    f"WITH {_generic_ctes()}, q AS ("
    + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE {c} IS NULL) AS missing, count(*) AS n FROM gstd"
        for c in ["company", "stage", "country", "sector", "funding_amount", "investors_count", "founded_year"]
    )
    + f"), p AS (SELECT column_name, missing, CAST(missing AS DOUBLE) * {D(100.0)} / n AS missing_pct FROM q) "
    f"SELECT column_name, CAST(missing AS BIGINT) AS missing, round(missing_pct, 6) AS missing_pct, {_grade_sql('missing_pct')} AS grade FROM p",
)
def generic_quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2/A3 over every canonical column of the generic loader's output."""
    import uuid

    from startlens.session import ensure_checkpoint_dir

    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/extracts/generic-{uuid.uuid4().hex}"
    TB.write_table(fixtures.generic_extract(spark, sf_dir), path, fmt="csv")
    std = CL.standardize_startups(TB.read_csv(spark, path), filter_funded=True)
    return tidy(RP.quality_report(std, std.columns).withColumnRenamed("column", "column_name"))


# ---------------------------------------------------------------------------
# Minimum-funding threshold (P13) and custom score weights (C4)
# ---------------------------------------------------------------------------

MIN_FUNDING = 10_000_000.0
CUSTOM_WEIGHTS = {"rule_of_40": 0.40, "traction_index": 0.30, "capital_efficiency": 0.10, "burn_multiple": 0.10, "runway_months": 0.10}


@register(
    "enriched_min_funding",
    f"WITH {O.enrich_ctes()} SELECT {_sel(_ENR_KINDS)} FROM enr WHERE funding_amount >= {MIN_FUNDING!r}",
)
def enriched_min_funding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Enrichment keeping companies with funding >= 10M (and > 0)."""
    return tidy(startups.enriched_companies(spark, sf_dir, min_funding=MIN_FUNDING))


@register("scored_custom_weights", f"WITH {O.score_ctes(CUSTOM_WEIGHTS)} SELECT {_sel(O.SCORED_KINDS)} FROM scored")
def scored_custom_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Investment score with custom (not renormalised) component weights."""
    return tidy(startups.scored_companies(spark, sf_dir, weights=CUSTOM_WEIGHTS))


# ---------------------------------------------------------------------------
# Prospects served with the population KPI definition (no train/serve skew)
# ---------------------------------------------------------------------------

_PPOP_KINDS = {"prospect_id": "i", "stage": "s", "funding_amount": "d", "investors_count": "i", "founded_year": "i",
               "estimated_revenue": "d", "capital_efficiency": "d", "monthly_burn": "d", "runway_months": "d",
               "burn_multiple": "d", "traction_index": "d", "rule_of_40": "d", "rule_of_40_norm": "d",
               "traction_index_norm": "d", "capital_efficiency_norm": "d", "burn_multiple_norm": "d",
               "runway_months_norm": "d", "investment_score": "d"}


@register(
    "prospect_population_scores",
    f"WITH {O.kpi_ctes()}, bnd AS (SELECT min(raw_traction) AS lo, max(raw_traction) AS hi FROM k1), "
    f"{_prospect_input_ctes()}, "
    f"{O.kpi_chain('p1', fixtures.SNAPSHOT_YEAR_FIXTURE, 'q', 'pkpis', ('(SELECT lo FROM bnd)', '(SELECT hi FROM bnd)'))}, "
    f"{O.score_chain('pkpis', None, 'qn', 'pscored')} "
    f"SELECT {_sel(_PPOP_KINDS)} FROM pscored",
)
def prospect_population_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prospects scored with the KPI definition the models train on, their
    traction scaled by the stored bounds of the company population."""
    population = startups.enriched_companies(spark, sf_dir)
    out = X.score_prospects_population(fixtures.prospects(spark, sf_dir), population, fixtures.SNAPSHOT_YEAR_FIXTURE)
    return tidy(out.select(*_PPOP_KINDS))


@register(
    "generic_loader_unfiltered",
    f"WITH {_generic_ctes()} SELECT company, stage, country, sector, round(funding_amount, 6) AS funding_amount, "
    "round(investors_count, 6) AS investors_count, round(founded_year, 6) AS founded_year FROM c",
)
def generic_loader_unfiltered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The generic loader with its documented default: no funding filter
    (companies with missing, zero or junk funding are kept)."""
    import uuid

    from startlens.session import ensure_checkpoint_dir

    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/extracts/generic-{uuid.uuid4().hex}"
    TB.write_table(fixtures.generic_extract(spark, sf_dir), path, fmt="csv")
    return tidy(CL.standardize_startups(TB.read_csv(spark, path), filter_funded=False))


@register(
    "ml_success_rate",
    f"WITH {_LAB_CTE} SELECT CAST(count(*) AS BIGINT) AS known_outcomes, CAST(count(*) FILTER (WHERE success = 1) AS BIGINT) AS successes, "
    "round(avg(CAST(success AS DOUBLE)), 6) AS success_rate FROM lab WHERE success <> -1",
)
def ml_success_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(ML.success_rate(startups.scored_companies(spark, sf_dir)))


def _forest_evaluation_sql() -> str:
    report = _report_sql().removeprefix(f"WITH {_PRED_CTE}, ").replace(" FROM r", "")
    auc = "(SELECT round(sum(pos * (below + neg / 2.0)) / (sum(pos)::DOUBLE * sum(neg)), 6) FROM h)"
    return (
        f"WITH RECURSIVE {_FOREST_CTE}, tl AS (SELECT id, f, x FROM xl WHERE is_test), {O.forest_scores('id', 'tl')}, "
        "pr AS (SELECT success AS label, (p > 0.5)::INT AS prediction, p FROM scores JOIN s USING (id)), "
        "h AS (SELECT *, coalesce(sum(neg) OVER (ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM "
        "(SELECT p, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label = 0) AS neg FROM pr GROUP BY p)), "
        f"{report}, tn, fp, fn, tp, round((tn + tp) / (tn + fp + fn + tp), 6) AS accuracy, {auc} AS roc_auc FROM r, c"
    )


@register("forest_evaluation", _forest_evaluation_sql())
def forest_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M12/M13 on the single forest's held-out side: per-class precision,
    recall, F1 and support with macro and weighted averages; the confusion
    counts, accuracy and ROC-AUC are attached to every row as scalar
    subqueries."""
    forest, lab = _forest(spark, sf_dir)
    pred = FO.score(forest, lab.where(ML.split_column("id", 42, 0.2)))
    pred = materialize(pred.select(F.col("label").cast("int").alias("label"), F.col("prediction").cast("int").alias("prediction"), "success_probability"), "evaluation")
    counts = MT.binary_metrics(pred)
    auc = MT.roc_auc(pred, "label", "success_probability")
    extra = {c: counts.select(c).scalar() for c in ("tn", "fp", "fn", "tp", "accuracy")}
    extra["roc_auc"] = auc.select("roc_auc").scalar()
    return tidy(MT.classification_report(pred).withColumns(extra))


# ---------------------------------------------------------------------------
# Prospect files, folds, weights, composite and best-of tables
# -- X3, M15, M8, D12, M17
# ---------------------------------------------------------------------------

def _file_scores_sql() -> str:
    """The file has no sector and no country column: defaults apply to all."""
    return _prospect_sql().replace("coalesce(sector, ", "coalesce(CAST(NULL AS VARCHAR), ").replace("coalesce(country, ", "coalesce(CAST(NULL AS VARCHAR), ")


@register("prospect_file_scores", _file_scores_sql())
def prospect_file_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prospects from a text CSV that lacks two columns and writes whole
    numbers as decimals, read, typed and scored."""
    import uuid

    from startlens.session import ensure_checkpoint_dir

    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/extracts/prospects-{uuid.uuid4().hex}"
    src = fixtures.prospects(spark, sf_dir).drop("sector", "country")
    TB.write_table(src.withColumns({c: F.col(c).cast("double").cast("string") for c in ("investors_count", "founded_year")}), path, fmt="csv")
    out = X.score_prospects(X.read_inputs(TB.read_csv(spark, path))).drop("unreadable")
    flat = {c: F.array_join(c, "; ") for c in ("reject_reasons", "strengths", "concerns")}
    return tidy(out.withColumns({"is_valid": F.col("is_valid").cast("string"), "prospect_id": F.col("prospect_id").cast("long"), **flat}))


@register(
    "ml_fold_summary",
    f"WITH {_SPLIT_CTE} SELECT CAST(CAST('0x' || substring(md5(concat(CAST(id AS VARCHAR), ':fold:42')), 1, 8) AS BIGINT) % 5 AS BIGINT) AS fold, "
    "CAST(success AS BIGINT) AS success, CAST(count(*) AS BIGINT) AS companies FROM s WHERE NOT is_test GROUP BY 1, 2",
)
def ml_fold_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Companies per cross-validation fold and class of the training side."""
    train = ML.label_outcomes(startups.scored_companies(spark, sf_dir)).where(~ML.split_column("id", 42, 0.2))
    return tidy(train.withColumn("fold", ML.fold_column("id", 5, 42)).groupBy("fold", "success").agg(F.count(F.lit(1)).alias("companies")))


@register(
    "ml_stratified_folds",
    f"WITH {_LAB_CTE} SELECT CAST(id AS BIGINT) AS id, CAST(success AS BIGINT) AS success, "
    "CAST((row_number() OVER (ORDER BY success, md5(concat_ws(':', id, 'folds', '42')), id) - 1) % 5 AS BIGINT) AS fold FROM lab WHERE success <> -1",
)
def ml_stratified_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every known outcome's fold, dealt in turn within its class."""
    lab = ML.label_outcomes(startups.scored_companies(spark, sf_dir))
    return tidy(ML.stratified_folds(lab.select("id", "success"), "success", "id", 5, 42).select("id", "success", "fold"))


@register(
    "ml_class_weights",
    f"WITH {_SPLIT_CTE} SELECT CAST(success AS BIGINT) AS success, "
    "round((SELECT count(*) FROM s WHERE NOT is_test) / (2.0 * count(*)), 6) AS class_weight FROM s WHERE NOT is_test GROUP BY success",
)
def ml_class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M8: balanced weights of the classes of the training side."""
    weights, _ = ML.class_weights(_labelled(spark, sf_dir).where(~ML.split_column("id", 42, 0.2)))
    return tidy(spark.createDataFrame(sorted(weights.items()), "success long, class_weight double"))


@register(
    "composite_scores",
    _prospect_sql().rsplit("\nSELECT ", 1)[0] + " SELECT CAST(prospect_id AS BIGINT) AS prospect_id, "
    f"round(investment_score * {D(0.4)} + score * 100 * {D(0.4)} + traction_index * {D(0.2)}, 6) AS composite_score "
    "FROM p7 JOIN predictions ON doc_id = prospect_id",
)
def composite_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """40/40/20 composite of prospects that have a stored probability."""
    scored = X.score_prospects(fixtures.prospects(spark, sf_dir))
    stored = fixtures.predictions(spark, sf_dir).select(F.col("doc_id").alias("prospect_id"), F.col("score").alias("success_probability"))
    return tidy(scored.join(stored, "prospect_id").select("prospect_id", AN.composite_score().alias("composite_score")))


def _best_sql() -> str:
    metrics = {
        "Accuracy": "CAST(tp + tn AS DOUBLE) / nullif(tp + tn + fp + fn, 0)",
        "Precision": "CAST(tp AS DOUBLE) / nullif(tp + fp, 0)",
        "Recall": "CAST(tp AS DOUBLE) / nullif(tp + fn, 0)",
        "F1-Score": "CAST(2 * tp AS DOUBLE) / nullif(2 * tp + fp + fn, 0)",
    }
    names = "[" + ", ".join(O.q(m) for m in ML.MODEL_NAMES) + "]"
    long = " UNION ALL ".join(f"SELECT i, model, {O.q(m)} AS metric, coalesce({e}, 0) AS value FROM c" for m, e in metrics.items())
    count = ", ".join(f"count(*) FILTER (WHERE label = {a} AND prediction = {b}) AS {n}" for a, b, n in ((1, 1, "tp"), (0, 0, "tn"), (0, 1, "fp"), (1, 0, "fn")))
    return (
        f"WITH {_PRED_CTE}, c AS (SELECT doc_id % 4 AS i, {names}[doc_id % 4 + 1] AS model, {count} FROM pr GROUP BY 1, 2), l AS ({long}), "
        "r AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY value DESC, i) AS k FROM l) "
        "SELECT metric, model AS best_model, round(value, 6) AS value FROM r WHERE k = 1"
    )


@register("best_of_stored_predictions", _best_sql())
def best_of_stored_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best model per metric, over stored predictions of four models."""
    pred = _pred_df(spark, sf_dir)
    names = ML.MODEL_NAMES
    table = None
    for k, name in enumerate(names):
        m = MT.binary_metrics(pred.where(F.col("doc_id") % 4 == k))
        m = m.select(F.lit(name).alias("Model"), F.col("accuracy").alias("Accuracy"), F.col("precision").alias("Precision"),
                     F.col("recall").alias("Recall"), F.col("f1").alias("F1-Score"))
        table = m if table is None else table.unionByName(m)
    return tidy(ML.best_by_metric(table, ["Accuracy", "Precision", "Recall", "F1-Score"]))


# ---------------------------------------------------------------------------
# Stored and checked inputs, sketches, walk-forward, thinned ROC curve
# -- J1-J3, S1, S3, S5, A1, A4, A5, D8, D9, M13, P15
# ---------------------------------------------------------------------------

from startlens.sources import company_store as CS  # noqa: E402
from startlens.sources import quarantine as QU  # noqa: E402


def _scratch(spark: SparkSession, name: str) -> str:
    import uuid

    from startlens.session import ensure_checkpoint_dir

    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/stores/{name}-{uuid.uuid4().hex}"


@register("enriched_from_store", ORACLE["enriched_startups"])
def enriched_from_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J1-J3 on tables stored in buckets of company ids: joins and aggregates
    without an exchange."""
    from startlens.operators import enrich

    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = CS.write_company_store(
        fixtures.objects(spark, sf_dir), fixtures.funding_rounds(spark, sf_dir), fixtures.investments(spark, sf_dir), _scratch(spark, "companies"), buckets
    )
    return tidy(enrich.enrich_startups(*CS.open_company_store(spark, path), filter_funded=True))


_BAD_LINES = "CASE WHEN id % 17 = 3 THEN 1 WHEN id % 19 = 4 THEN 2 ELSE 0 END"


def _quarantine_sql() -> str:
    return (
        f"WITH {fixtures.FIXTURE_CTES}, g AS (SELECT *, {_BAD_LINES} AS bad, lpad(CAST(id AS VARCHAR), 12, '0') AS code, id % 37 = 5 AS n, "
        "coalesce(founded_at = '1999-02-30', false) AS d, id % 13 = 0 AS m FROM (SELECT CAST(e.id AS BIGINT) AS id, founded_at FROM generic_extract e)) "
        "SELECT id, CAST(bad = 0 AND NOT n AND NOT d AND NOT m AS VARCHAR) AS accepted, CASE WHEN bad > 0 THEN 'fields' ELSE "
        "concat_ws('; ', CASE WHEN n THEN 'number:funding_total_usd' END, CASE WHEN d THEN 'date:founded_at' END, "
        "CASE WHEN m THEN 'missing:participants' END) END AS reasons FROM g"
    )


@register("quarantined_rows", _quarantine_sql())
def quarantined_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A CSV extract of which some lines lack a field, have one too
    many, or hold unreadable numbers and dates: all its rows, accepted or
    rejected with reasons."""
    raw = fixtures.generic_extract(spark, sf_dir)
    cols = ["id", *[c for c in raw.columns if c != "id"]]
    line = F.to_csv(F.struct(*cols), {"emptyValue": ""})
    bad = F.expr(_BAD_LINES.replace("id", "CAST(id AS BIGINT)"))
    # a line without its last field, or with one more
    line = F.when(bad == 1, F.regexp_replace(line, ",[^,]*$", "")).when(bad == 2, F.concat(line, F.lit(",more"))).otherwise(line)
    path = _scratch(spark, "extract")
    raw.select(line.alias("value")).write.text(path)
    accepted, rejected = QU.read_csv_checked(spark, path, ["funding_total_usd"], ["founded_at"], ["participants"], columns=cols)
    out = accepted.select(F.col("id").cast("long").alias("id"), F.lit("true").alias("accepted"), F.lit("").alias("reasons"))
    first = F.split("line", ",")[0].cast("long")
    return tidy(out.unionByName(rejected.select(first.alias("id"), F.lit("false").alias("accepted"), F.array_join("reasons", "; ").alias("reasons"))))


_SKETCH_CTE = (f"{O.enrich_ctes()}, iv AS (SELECT stage, sector, funding_amount, investor_object_id AS investor FROM enr "
               "LEFT JOIN investments ON funded_object_id = id)")


@register(
    "sketch_errors",
    f"WITH {_SKETCH_CTE}, x AS (SELECT sector AS grp, * FROM iv UNION ALL SELECT 'all' AS grp, * FROM iv) "
    "SELECT grp, CAST(count(*) AS BIGINT) AS rows, CAST(count(DISTINCT investor) AS BIGINT) AS investors, 'true' AS distinct_in_bound, "
    "'true' AS median_in_bound FROM x GROUP BY grp",
)
def sketch_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1, A4, A5: sketches per (stage, sector), merged to sectors and to all,
    against exact values: the exact distinct count, whether the estimate is
    within four standard errors of it, and whether the estimated median's
    true rank is within the sketch's rank error of one half."""
    from startlens.operators import sketches as SK

    inv = fixtures.investments(spark, sf_dir).withColumnRenamed("investor_object_id", "investor")
    enr = startups.enriched_companies(spark, sf_dir)
    rows = materialize(enr.join(inv, F.col("id") == F.col("funded_object_id"), "left").select("stage", "sector", "funding_amount", "investor"), "investor_rows")
    fine = materialize(SK.sketch_groups(rows, ["stage", "sector"], ["investor"], ["funding_amount"]), "sketches")
    merged = SK.merge_sketches(fine, ["sector"]).withColumnRenamed("sector", "grp")
    merged = merged.unionByName(SK.merge_sketches(fine).withColumn("grp", F.lit("all")))
    est = materialize(SK.read_sketches(merged, [0.5]), "estimates")
    each = rows.withColumn("grp", F.explode(F.array(F.col("sector"), F.lit("all"))))
    at = each.join(F.broadcast(est.select(F.col("grp").alias("g"), "funding_amount_p50")), F.col("grp").eqNullSafe(F.col("g")))
    exact = at.groupBy("grp").agg(
        F.count_distinct("investor").alias("investors"), F.avg((F.col("funding_amount") < F.col("funding_amount_p50")).cast("double")).alias("lo"),
        F.avg((F.col("funding_amount") <= F.col("funding_amount_p50")).cast("double")).alias("hi"),
    ).withColumnRenamed("grp", "h")
    out = est.join(exact, F.col("grp").eqNullSafe(F.col("h")))
    off = F.abs(F.col("investor_distinct") - F.col("investors")) <= 4 * 1.04 / 2 ** (SK.LG_K / 2) * F.col("investors") + 0.5
    near = (F.col("lo") <= 0.5 + 1.7 / SK.KLL_K) & (F.col("hi") >= 0.5 - 1.7 / SK.KLL_K)
    return tidy(out.select("grp", "rows", "investors", off.cast("string").alias("distinct_in_bound"), near.cast("string").alias("median_in_bound")))


@register(
    "walk_forward_baseline",
    f"WITH {_LAB_CTE}, k AS (SELECT founded_year AS y, stage, success FROM lab WHERE success <> -1 AND founded_year IS NOT NULL), "
    "c AS (SELECT DISTINCT y AS cutoff FROM k), tr AS (SELECT cutoff, count(*) AS n, sum(success) AS pos FROM c JOIN k ON y < cutoff GROUP BY cutoff), "
    "g AS (SELECT cutoff, stage, avg(success) AS rate FROM c JOIN k ON y < cutoff GROUP BY cutoff, stage), "
    "te AS (SELECT tr.cutoff, tr.n, tr.pos, k.success, CASE WHEN coalesce(g.rate, tr.pos / tr.n) >= 0.5 THEN 1 ELSE 0 END AS says FROM tr JOIN k ON k.y = tr.cutoff "
    "LEFT JOIN g ON g.cutoff = tr.cutoff AND g.stage IS NOT DISTINCT FROM k.stage) "
    "SELECT CAST(cutoff AS BIGINT) AS cutoff_year, CAST(any_value(n) AS BIGINT) AS train_rows, CAST(any_value(pos) AS BIGINT) AS train_successes, "
    "CAST(count(*) AS BIGINT) AS test_rows, CAST(sum(success) AS BIGINT) AS test_successes, CAST(sum((says = success)::INT) AS BIGINT) AS correct, "
    "round(sum((says = success)::INT) / count(*), 6) AS accuracy FROM te GROUP BY cutoff",
)
def walk_forward_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Train and test counts and the stage baseline's accuracy at
    every cut-off year, by running totals."""
    return tidy(AN.walk_forward(ML.label_outcomes(startups.scored_companies(spark, sf_dir))))


@register(
    "roc_curve",
    f"WITH {_HIST_CTE}, c AS (SELECT *, sum(neg) OVER w AS cn, sum(pos) OVER w AS cp, sum(neg) OVER () AS tn_all, sum(pos) OVER () AS tp_all, "
    "lead(pos) OVER (ORDER BY score DESC) AS np, lead(neg) OVER (ORDER BY score DESC) AS nn FROM h "
    "WINDOW w AS (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) "
    "SELECT round(score, 6) AS threshold, round(CAST(cn AS DOUBLE) / tn_all, 6) AS fpr, round(CAST(cp AS DOUBLE) / tp_all, 6) AS tpr "
    "FROM c WHERE np IS NULL OR pos * nn <> np * neg",
)
def roc_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ROC curve without collinear points."""
    return tidy(MT.roc_curve(_pred_df(spark, sf_dir)))


@register("company_lookup_from_store", f"WITH {O.score_ctes()}, r AS (SELECT *, row_number() OVER (ORDER BY investment_score DESC NULLS LAST, id) AS rank FROM scored), "
          "m AS (SELECT * FROM r WHERE company = (SELECT company FROM r WHERE rank = 1) ORDER BY rank LIMIT 1) "
          f"SELECT {_sel(_LOOKUP_KINDS)} FROM m")
def company_lookup_from_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P15 on a table clustered by name: the ranked companies stored once, the
    name of the best one looked up in them."""
    ranked = startups.ranked_companies(spark, sf_dir)
    stored = spark.read.parquet(CS.write_lookup_store(ranked, _scratch(spark, "by_name")))
    name = stored.where("rank = 1").select("company").first()["company"]
    return tidy(RK.lookup_company(stored, name))


#: A gradient entry of the logistic fit is the optimum's if it is no larger than this.
OPTIMALITY = 1e-5


@register(
    "logistic_optimality",
    f"WITH {_SPLIT_CTE}, f AS (" + " UNION ALL ".join([f"SELECT {O.q(c)} AS feature" for c in [*_P.NUMERIC_FEATURES, "intercept"]]
    + [f"SELECT DISTINCT '{c}_' || {c} FROM s WHERE NOT is_test AND {c} IS NOT NULL" for c in _P.CATEGORICAL_FEATURES])
    + ") SELECT feature, 'true' AS optimal FROM f",
)
def logistic_optimality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M8: per coefficient of the balanced logistic model, whether the
    training objective's gradient vanishes there (all do at the optimum)."""
    train = materialize(_labelled(spark, sf_dir).where(~ML.split_column("id", 42, 0.2)), "train")
    gradient = ML.logistic_gradient(ML.fit_model("Logistic Regression", train), train)
    return gradient.select("feature", (F.abs("gradient") <= OPTIMALITY).cast("string").alias("optimal"))
