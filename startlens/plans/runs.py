"""End-to-end runs on real input files (Entries A, B, C; S2, S4, S6).

A user with the three company files -- companies (``objects``), funding
rounds and investments -- runs the whole ranking from a folder:

    python -m startlens.plans.runs rank --data-dir DATA --out OUT [--format csv|parquet]
    python -m startlens.plans.runs train --scored OUT/scored --out MODELS [--format csv]
    python -m startlens.plans.runs missing --data-dir DATA --out OUT
    python -m startlens.plans.runs load --input any_extract.csv --out OUT
    python -m startlens.plans.runs predict --model MODELS/model --prospects prospects.csv --out PRED

Files are read as text by header name (a company extract may carry many
more columns than the few used), the used columns are selected and
converted with ``try_cast``/``try_to_date``, then the lazy plan of
:mod:`startlens.plans.startups` runs and the tables are written: every
company with KPIs, score and rank, the top N, and the summaries.
"""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from startlens.functions import params as P
from startlens.operators import clean, enrich, kpi, missing, rank, report, score
from startlens.session import get_spark, materialize, scratch_tables
from startlens.sources.tables import read_csv, write_table

OBJECT_COLUMNS = ["id", "entity_type", "name", "category_code", "country_code", "founded_at", "funding_total_usd", "status"]


def _read(spark: SparkSession, data_dir: str, name: str, fmt: str) -> DataFrame:
    base = os.path.join(data_dir, name)
    if fmt == "csv":
        return read_csv(spark, base if base.endswith(".csv") else f"{base}.csv")
    return spark.read.parquet(base if base.endswith(".parquet") else f"{base}.parquet")


def load_company_tables(spark: SparkSession, data_dir: str, fmt: str = "csv") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(objects, funding_rounds, investments) with the used columns typed.

    Rounds without a ``round_id`` column get the round's ``id`` (or none:
    ties on a date are then broken by nothing but the date).
    """
    objs = _read(spark, data_dir, "objects", fmt)
    objs = objs.select(
        *[F.col(c).cast("string").alias(c) for c in OBJECT_COLUMNS if c != "funding_total_usd"],
        F.col("funding_total_usd").cast("string").try_cast("double").alias("funding_total_usd"),
    )
    rounds = _read(spark, data_dir, "funding_rounds", fmt)
    rid = "round_id" if "round_id" in rounds.columns else ("id" if "id" in rounds.columns else None)
    rounds = rounds.select(
        *( [F.col(rid).cast("string").alias("round_id")] if rid else [] ),
        F.col("object_id").cast("string").alias("object_id"),
        F.col("funding_round_type").cast("string").alias("funding_round_type"),
        F.try_to_date(F.col("funded_at").cast("string"), "yyyy-MM-dd").alias("funded_at"),
    )
    inv = _read(spark, data_dir, "investments", fmt).select(
        F.col("funded_object_id").cast("string").alias("funded_object_id"),
        F.col("investor_object_id").cast("string").alias("investor_object_id"),
    )
    return objs, rounds, inv


def rank_companies(
    objects: DataFrame,
    rounds: DataFrame,
    investments: DataFrame,
    snapshot_year: int = P.SNAPSHOT_YEAR,
    min_funding: float = 0,
    weights=None,
) -> DataFrame:
    """Entry A on given tables: enrich -> KPIs -> score -> global rank."""
    tiebreak = "round_id" if "round_id" in rounds.columns else None
    enriched = materialize(
        enrich.enrich_startups(objects, rounds, investments, filter_funded=True, min_funding=min_funding, round_tiebreak=tiebreak),
        "enriched",
    )
    scored = score.calculate_investment_score(kpi.calculate_all_kpis(enriched, snapshot_year=snapshot_year), weights)
    return rank.rank_rows(scored, "investment_score", "id")


def run_ranking(
    spark: SparkSession,
    data_dir: str,
    out_dir: str,
    fmt: str = "csv",
    out_format: str = "parquet",
    top: int = 100,
    snapshot_year: int = P.SNAPSHOT_YEAR,
    min_funding: float = 0,
) -> dict[str, str]:
    """Read the three tables, rank every company, and write ``scored``,
    ``top_<n>``, ``kpi_summary``, ``score_summary``, ``score_bands``,
    ``stage_counts`` and ``top_breakdown`` (the best company's score by
    component) under ``out_dir``; returns the written paths."""
    objs, rounds, inv = load_company_tables(spark, data_dir, fmt)
    paths = {"scored": os.path.join(out_dir, "scored"), "top": os.path.join(out_dir, f"top_{top}")}
    with scratch_tables(spark):  # intermediate tables are deleted once the outputs are written
        # rank_rows already reads from its own materialized copy, so the two
        # writes below reuse it instead of recomputing the enrichment
        ranked = rank_companies(objs, rounds, inv, snapshot_year, min_funding)
        write_table(ranked, paths["scored"], fmt=out_format)
        write_table(ranked.where(F.col("rank") <= top).orderBy("rank"), paths["top"], fmt=out_format)
        summaries = {
            "kpi_summary": report.kpi_summary(ranked),
            "score_summary": report.score_summary(ranked),
            "score_bands": report.score_bands(ranked),
            "stage_counts": report.stage_counts(ranked),
            "top_breakdown": score.score_breakdown(ranked.where(F.col("rank") == 1)),
        }
        for name, table in summaries.items():
            paths[name] = os.path.join(out_dir, name)
            write_table(table, paths[name], fmt=out_format)
    return paths


def run_missing(spark: SparkSession, data_dir: str, out_dir: str, fmt: str = "csv", out_format: str = "parquet") -> dict[str, str]:
    """The missing-data analysis of the three tables: the overall test, the
    funding profile, the breakdowns by stage and sector, the contingency
    test and what it means for training. Returns the written paths."""
    objs, rounds, inv = load_company_tables(spark, data_dir, fmt)
    tiebreak = "round_id" if "round_id" in rounds.columns else None
    paths = {}
    with scratch_tables(spark):
        df = materialize(enrich.enrich_startups(objs, rounds, inv, filter_funded=True, round_tiebreak=tiebreak), "enriched")
        tables = {
            "missingness_test": missing.missingness_test(df),
            "funding_profile": missing.group_funding_profile(df),
            "missing_by_stage": missing.missing_by_group(df, "stage"),
            "missing_by_sector": missing.missing_by_group(df, "sector"),
            "chi_square_test": missing.chi_square_test(df),
            "success_by_presence": missing.success_by_presence(df),
            "ml_impact": missing.ml_impact(df),
        }
        for name, table in tables.items():
            paths[name] = os.path.join(out_dir, name)
            write_table(table, paths[name], fmt=out_format)
    return paths


def run_load(spark: SparkSession, input_path: str, out_dir: str, filter_funded: bool = True, out_format: str = "csv") -> str:
    """Any company CSV in, the canonical columns out."""
    table = clean.standardize_startups(clean.require_rows(read_csv(spark, input_path)), filter_funded=filter_funded)
    path = os.path.join(out_dir, "startups")
    write_table(table, path, fmt=out_format)
    return path


def read_scored(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """A scored table as ``run_ranking`` writes it, from parquet or CSV (the
    model's numeric columns and the score become numbers again)."""
    if fmt == "parquet":
        return spark.read.parquet(path)
    raw = read_csv(spark, path)
    numeric = set(P.NUMERIC_FEATURES) | {"investment_score"}
    return raw.select(*[F.col(c).try_cast("double").alias(c) if c in numeric else F.col(c) for c in raw.columns])


def run_training(spark: SparkSession, scored_path: str, out_dir: str, cv_folds: int = 5, seed: int = 42,
                 out_format: str = "parquet", models: list[str] | None = None, fmt: str = "parquet", test_size: float = 0.2,
                 exact_stratified: bool = False) -> dict[str, str]:
    """Entry B: from a scored table (parquet or CSV, e.g. ``run_ranking``'s
    output) train and compare the four models, then train the single forest
    (first category dropped), write its tables, its
    top feature importances, its per-class report and its confusion counts with
    accuracy and AUC on the ``test_size`` share held out. ``exact_stratified``:
    that share holds each class in exact proportion, and so do the folds.
    Returns the written paths."""
    from startlens.operators import forest, metrics, ml

    paths = {k: os.path.join(out_dir, k) for k in ("model_comparison", "feature_importance", "model", "classification_report", "evaluation")}
    with scratch_tables(spark):
        labelled = materialize(ml.label_outcomes(read_scored(spark, scored_path, fmt)), "labelled")
        comparison = ml.compare_models(labelled, models, seed=seed, cv_folds=cv_folds, test_fraction=test_size, exact_stratified=exact_stratified)
        write_table(comparison, paths["model_comparison"], fmt=out_format)
        if exact_stratified:
            labelled = materialize(ml.stratified_split(labelled, "success", "id", test_size, seed), "split")
        else:
            labelled = labelled.withColumn("is_test", ml.split_column("id", seed, test_size))
        model = forest.grow_forest(labelled.where(~F.col("is_test")), seed=seed)
        model.write(paths["model"])
        write_table(forest.top_importance(model, 15), paths["feature_importance"], fmt=out_format)
        test = forest.score(model, labelled.where("is_test")).select(
            F.col("label").cast("int").alias("label"), F.col("prediction").cast("int").alias("prediction"), "success_probability"
        )
        test = materialize(test, "evaluation")
        write_table(metrics.classification_report(test), paths["classification_report"], fmt=out_format)
        auc = metrics.roc_auc(test, "label", "success_probability").select("roc_auc").scalar()
        write_table(metrics.binary_metrics(test).withColumn("roc_auc", auc), paths["evaluation"], fmt=out_format)
    return paths


def run_prospect_scoring(spark: SparkSession, model_dir: str, prospects_path: str, out_dir: str, fmt: str = "csv",
                         out_format: str = "parquet") -> str:
    """Entry C: score a prospects file with a saved forest -- defaults,
    validation, prospect KPIs, probability, bands and explanations. Rejected
    prospects have their reasons and no probability."""
    from startlens.operators import forest
    from startlens.operators import prospects as X

    raw = read_csv(spark, prospects_path) if fmt == "csv" else spark.read.parquet(prospects_path)
    typed = X.read_inputs(raw)
    out = X.predict_prospects(forest.read_forest(spark, model_dir), typed)
    keep = [c for c in typed.columns if c != "unreadable"] + ["is_valid", "reject_reasons", "estimated_revenue", "capital_efficiency", "monthly_burn",
                                         "runway_months", "burn_multiple", "traction_index", "rule_of_40", "investment_score",
                                         "success_probability", "confidence", "recommendation", "percentile_context",
                                         "strengths", "concerns"]
    out = out.select(*dict.fromkeys(keep))
    if out_format == "csv":
        out = out.withColumns({c: F.array_join(c, "; ") for c in ("reject_reasons", "strengths", "concerns")})
    path = os.path.join(out_dir, "prospect_predictions")
    write_table(out, path, fmt=out_format)
    return path


def main(argv: list[str] | None = None) -> None:
    ap = argparse.ArgumentParser(prog="python -m startlens.plans.runs")
    sub = ap.add_subparsers(dest="cmd", required=True)
    r = sub.add_parser("rank", help="rank companies from objects / funding_rounds / investments")
    r.add_argument("--data-dir", required=True)
    r.add_argument("--out", required=True)
    r.add_argument("--format", default="csv", choices=["csv", "parquet"], help="input format")
    r.add_argument("--out-format", default="parquet", choices=["csv", "parquet"])
    r.add_argument("--top", type=int, default=100)
    r.add_argument("--snapshot-year", type=int, default=P.SNAPSHOT_YEAR)
    r.add_argument("--min-funding", type=float, default=0.0)
    t = sub.add_parser("train", help="compare models and save the forest from a scored table")
    t.add_argument("--scored", required=True)
    t.add_argument("--out", required=True)
    t.add_argument("--cv-folds", type=int, default=5)
    t.add_argument("--format", default="parquet", choices=["csv", "parquet"], help="input format")
    t.add_argument("--test-size", type=float, default=0.2)
    t.add_argument("--seed", type=int, default=42)
    t.add_argument("--exact-stratified", action="store_true", help="exact class shares in the held-out side and the folds")
    m = sub.add_parser("missing", help="missing-data analysis of objects / funding_rounds / investments")
    m.add_argument("--data-dir", required=True)
    m.add_argument("--out", required=True)
    m.add_argument("--format", default="csv", choices=["csv", "parquet"])
    m.add_argument("--out-format", default="csv", choices=["csv", "parquet"])
    ld = sub.add_parser("load", help="standardise one company CSV")
    ld.add_argument("--input", required=True)
    ld.add_argument("--out", required=True)
    ld.add_argument("--keep-unfunded", action="store_true")
    p = sub.add_parser("predict", help="score a prospects file with a saved forest")
    p.add_argument("--model", required=True)
    p.add_argument("--prospects", required=True)
    p.add_argument("--out", required=True)
    p.add_argument("--format", default="csv", choices=["csv", "parquet"])
    a = ap.parse_args(argv)
    spark = get_spark()
    if a.cmd == "rank":
        print(run_ranking(spark, a.data_dir, a.out, a.format, a.out_format, a.top, a.snapshot_year, a.min_funding))
    elif a.cmd == "train":
        print(run_training(spark, a.scored, a.out, a.cv_folds, a.seed, fmt=a.format, test_size=a.test_size,
                           exact_stratified=a.exact_stratified))
    elif a.cmd == "missing":
        print(run_missing(spark, a.data_dir, a.out, a.format, a.out_format))
    elif a.cmd == "load":
        print(run_load(spark, a.input, a.out, not a.keep_unfunded))
    else:
        print(run_prospect_scoring(spark, a.model, a.prospects, a.out, a.format))


if __name__ == "__main__":
    main(sys.argv[1:])
