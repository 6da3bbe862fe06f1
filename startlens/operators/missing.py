"""Is missing investor data informative?

All statistics are aggregates over the whole table (algebraic sums with
map-side combine); the test statistics are column arithmetic on the single
aggregated row, and only the tail probabilities use a small pandas UDF on
that one row.

``missing_rule``: ``'null'`` (default) treats a NULL investor count as
missing, which is what the published tables describe; ``'zero'`` tests
``investors_count == 0`` literally.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from startlens.functions import params as P
from startlens.functions.columns import round_half_even
from startlens.functions.distributions import chi2_p_value, t_test_p_value
from startlens.operators.stats import exact_percentiles


def is_missing(rule: str = "null", col: str = "investors_count") -> Column:
    c = F.col(col)
    if rule == "zero":
        return F.coalesce(c == 0, F.lit(False))
    return c.isNull()


def success_label(status_col: str = "status") -> Column:
    """M2: 1 for acquired/ipo, 0 otherwise (apply on known outcomes)."""
    return F.col(status_col).isin(P.SUCCESS_STATUSES).cast("int")


def known_outcomes(df: DataFrame, status_col: str = "status") -> DataFrame:
    """Status in (acquired, ipo, closed)."""
    return df.where(F.col(status_col).isin(P.KNOWN_OUTCOMES))


def missingness_stats(df: DataFrame, value_col: str = "funding_amount", rule: str = "null") -> DataFrame:
    """Counts, rate, funding ratio, pooled two-sample t statistic.

    One aggregation pass computes n, mean and sample variance of the value
    for the missing and the present group.
    """
    m = is_missing(rule)
    v = F.col(value_col).cast("double")
    one = df.agg(
        F.count(F.lit(1)).alias("n_all"),
        F.count_if(m).alias("missing_count"),
        F.count_if(~m).alias("present_count"),
        F.count(F.when(m, v)).alias("n_m"),
        F.count(F.when(~m, v)).alias("n_p"),
        F.avg(F.when(m, v)).alias("mean_m"),
        F.avg(F.when(~m, v)).alias("mean_p"),
        F.var_samp(F.when(m, v)).alias("var_m"),
        F.var_samp(F.when(~m, v)).alias("var_p"),
    )
    dof = F.col("n_m") + F.col("n_p") - 2
    pooled = F.try_divide((F.col("n_m") - 1) * F.col("var_m") + (F.col("n_p") - 1) * F.col("var_p"), dof.cast("double"))
    se = F.sqrt(pooled * (F.lit(1.0) / F.col("n_m") + F.lit(1.0) / F.col("n_p")))
    t = F.try_divide(F.col("mean_m") - F.col("mean_p"), se)
    return one.select(
        "missing_count",
        "present_count",
        F.try_divide(F.col("missing_count").cast("double"), F.col("n_all")).alias("missing_rate"),
        F.try_divide(F.col("mean_p"), F.col("mean_m")).alias("funding_ratio"),
        F.col("mean_m").alias("mean_missing"),
        F.col("mean_p").alias("mean_present"),
        t.alias("t_stat"),
        dof.cast("long").alias("dof"),
    )


def missingness_test(df: DataFrame, value_col: str = "funding_amount", rule: str = "null") -> DataFrame:
    """D1+D2+D5: ``missingness_stats`` plus p-value and significance flag."""
    s = missingness_stats(df, value_col, rule)
    p = t_test_p_value(F.col("t_stat"), F.col("dof").cast("double"))
    return s.withColumn("p_value", p).withColumn("significant", F.col("p_value") < F.lit(P.SIGNIFICANCE_LEVEL))


def group_funding_profile(df: DataFrame, value_col: str = "funding_amount", rule: str = "null") -> DataFrame:
    """Count, mean and median of funding for missing vs present."""
    g = df.select(is_missing(rule).alias("investors_missing"), F.col(value_col).cast("double").alias("v"))
    moments = g.groupBy("investors_missing").agg(F.count(F.lit(1)).alias("companies"), F.avg("v").alias("mean_funding"))
    med = exact_percentiles(g, "v", [0.5], ["investors_missing"], ["median_funding"])
    return moments.join(med, "investors_missing", "left")


def missing_by_group(
    df: DataFrame,
    group_col: str = "stage",
    rule: str = "null",
    min_total: int | None = None,
    top: int | None = None,
) -> DataFrame:
    """Per group total, missing, missing % (of all rows) and mean
    funding, rounded half-even to 2 places, sorted by missing % desc.

    ``total`` is the non-null investor count (what the method's code
    counts); ``rows`` is every row of the group (what its README table
    shows). ``min_total`` keeps groups with ``total >= min_total``.
    ``rule="zero"`` reproduces the literal ``== 0`` test of the method's code.
    """
    m = is_missing(rule)
    g = (
        df.where(F.col(group_col).isNotNull())
        .groupBy(group_col)
        .agg(
            F.count("investors_count").alias("total"),
            F.count(F.lit(1)).alias("rows"),
            F.count_if(m).alias("missing"),
            F.avg("funding_amount").alias("mean_funding"),
        )
    )
    g = g.select(
        group_col,
        "total",
        "rows",
        "missing",
        round_half_even(F.col("missing") * F.lit(100.0) / F.col("rows"), 2).alias("missing_pct"),
        round_half_even("mean_funding", 2).alias("mean_funding"),
    )
    if min_total is not None:
        g = g.where(F.col("total") >= min_total)
    g = g.orderBy(F.desc("missing_pct"), F.asc(group_col))
    return g if top is None else g.limit(top)


def highest_missing_group(by_group: DataFrame, group_col: str = "stage") -> DataFrame:
    """A15 (missing side): the group with the highest missing %."""
    return by_group.agg(F.max_by(F.col(group_col), F.struct(F.col("missing_pct"), F.col(group_col))).alias(group_col),
                        F.max("missing_pct").alias("missing_pct"))


def contingency(df: DataFrame) -> DataFrame:
    """2x2 counts of (investors_count > 0, success) on known outcomes.

    A NULL investor count counts as "no investors" (False).
    """
    k = known_outcomes(df)
    has = F.coalesce(F.col("investors_count") > 0, F.lit(False))
    return k.groupBy(has.alias("has_investors")).agg(
        F.count_if(success_label() == 0).alias("failures"),
        F.count_if(success_label() == 1).alias("successes"),
    )


def success_by_presence(df: DataFrame, rule: str = "null") -> DataFrame:
    """Success rate for missing vs present investors (present = > 0)."""
    k = known_outcomes(df)
    grp = F.when(is_missing(rule), "missing").when(F.col("investors_count") > 0, "present")
    return k.where(grp.isNotNull()).groupBy(grp.alias("investors")).agg(
        F.count(F.lit(1)).alias("companies"), F.avg(success_label()).alias("success_rate")
    )


def chi_square_stats(df: DataFrame) -> DataFrame:
    """D3: Yates-corrected chi-square on the contingency table (one row).

    Closed form on the four cell counts; a table with an empty row or
    column has no degree of freedom (chi2 = 0).
    """
    k = known_outcomes(df)
    has = F.coalesce(F.col("investors_count") > 0, F.lit(False))
    s = success_label() == 1
    one = k.agg(
        F.count_if(~has & ~s).alias("a"),
        F.count_if(~has & s).alias("b"),
        F.count_if(has & ~s).alias("c"),
        F.count_if(has & s).alias("d"),
    )
    a, b, c, d = (F.col(x).cast("double") for x in "abcd")
    n = a + b + c + d
    r0, r1, c0, c1 = a + b, c + d, a + c, b + d
    dof = F.when((r0 == 0) | (r1 == 0) | (c0 == 0) | (c1 == 0), F.lit(0)).otherwise(F.lit(1))
    terms = []
    for obs, rt, ct in ((a, r0, c0), (b, r0, c1), (c, r1, c0), (d, r1, c1)):
        exp = rt * ct / n
        diff = exp - obs
        corr = obs + F.least(F.lit(0.5), F.abs(diff)) * F.signum(diff)
        terms.append((corr - exp) * (corr - exp) / exp)
    chi2 = F.when(dof == 0, F.lit(0.0)).otherwise(terms[0] + terms[1] + terms[2] + terms[3])
    return one.select("a", "b", "c", "d", chi2.alias("chi2"), dof.cast("long").alias("dof"))


def chi_square_test(df: DataFrame) -> DataFrame:
    s = chi_square_stats(df)
    return s.withColumn("p_value", chi2_p_value(F.col("chi2"), F.col("dof").cast("double"))).withColumn(
        "significant", F.col("p_value") < F.lit(P.SIGNIFICANCE_LEVEL)
    )


def ml_impact(df: DataFrame, rule: str = "null") -> DataFrame:
    """Share of known-outcome rows with missing investors."""
    k = known_outcomes(df)
    return k.agg(
        F.count(F.lit(1)).alias("total_ml"),
        F.count_if(is_missing(rule)).alias("missing_in_ml"),
    ).withColumn("missing_pct", F.try_divide(F.col("missing_in_ml") * F.lit(100.0), F.col("total_ml")))
