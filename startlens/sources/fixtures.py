"""Domain tables built from the provided TPC-H-style test tables.

These builders only shape rows into the schemas the operators expect
(companies, funding rounds, investments, prospects, scored predictions, a
raw text extract) and inject NULLs, invalid dates, padding and unmapped
values with fixed arithmetic on the keys, so that every null path of the
operators is exercised. They keep every input row and do none of the operators' work; the operators
take nothing from how the rows are made.

Each table is one list of SQL expressions, parsed by both engines: Spark
applies it with ``selectExpr`` on the pruned parquet scans, and
``oracle_sql()`` runs the same text in DuckDB as a CTE. One definition, so
the stand-in input cannot drift between the two sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from startlens.sources.tables import read_table

SNAPSHOT_YEAR_FIXTURE = 2001  # test orders end 2001-08-01

OBJECTS_COLS = [
    "c_custkey AS id",
    "CASE WHEN c_custkey % 25 = 24 THEN 'Person' ELSE 'Company' END AS entity_type",
    "c_name AS name",
    "CASE WHEN c_custkey % 19 = 5 THEN NULL ELSE lower(c_mktsegment) END AS category_code",
    "CASE WHEN c_custkey % 23 = 7 THEN NULL ELSE n_name END AS country_code",
    "CASE WHEN c_custkey % 4 = 1 THEN NULL WHEN c_custkey % 97 = 14 THEN '1999-02-30' "
    "ELSE concat(CAST(1980 + c_custkey % 21 AS STRING), '-06-01') END AS founded_at",
    "CASE WHEN c_custkey % 41 = 3 THEN NULL ELSE c_acctbal * 5000 END AS funding_total_usd",
    "CASE WHEN c_custkey % 5 < 3 THEN 'operating' WHEN c_acctbal + (c_custkey % 7) * 600 > 5600 "
    "THEN CASE WHEN c_custkey % 6 = 0 THEN 'ipo' ELSE 'acquired' END ELSE 'closed' END AS status",
]

ROUNDS_COLS = [
    "o_orderkey AS round_id",
    # a negative id is no company: those companies have no rounds, and the join meets keys without a partner
    "CASE WHEN o_custkey % 9 = 4 THEN -1 - o_custkey ELSE o_custkey END AS object_id",
    "CASE o_orderkey % 16 WHEN 0 THEN 'seed' WHEN 1 THEN 'angel' WHEN 2 THEN 'series-a' WHEN 3 THEN ' Series-A+ ' "
    "WHEN 4 THEN 'series-b' WHEN 5 THEN 'series-b+' WHEN 6 THEN 'series-c' WHEN 7 THEN 'series-c+' "
    "WHEN 8 THEN 'series-d' WHEN 9 THEN 'series-e' WHEN 10 THEN 'series-f' WHEN 11 THEN 'series-g' "
    "WHEN 12 THEN 'VENTURE' WHEN 13 THEN 'private-equity' WHEN 14 THEN 'crowdfunding' ELSE NULL END AS funding_round_type",
    "CASE WHEN o_orderkey % 53 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS funded_at",
]

INVESTMENTS_COLS = [
    "CASE WHEN o_custkey % 3 = 0 THEN -1 - o_custkey ELSE o_custkey END AS funded_object_id",
    "CASE WHEN l_linenumber = 7 THEN NULL ELSE l_suppkey END AS investor_object_id",
]

PROSPECTS_COLS = [
    "c_custkey AS prospect_id",
    "c_acctbal * 2000 AS funding_amount",
    "CASE c_custkey % 8 WHEN 0 THEN 'Seed' WHEN 1 THEN 'Angel' WHEN 2 THEN 'Series A' WHEN 3 THEN 'Series B' "
    "WHEN 4 THEN 'Series C' WHEN 5 THEN 'Series D+' WHEN 6 THEN 'Pre-Seed' ELSE NULL END AS stage",
    "lower(c_mktsegment) AS sector",
    "n_name AS country",
    "CASE WHEN c_custkey % 17 = 2 THEN NULL ELSE CAST(c_custkey % 12 - 1 AS INT) END AS investors_count",
    "CAST(1985 + c_custkey % 45 AS INT) AS founded_year",
]

PREDICTIONS_COLS = [
    "doc_id",
    "quality AS label",
    "CAST(n_chars % 1000 AS DOUBLE) / 1000 AS score",
]

GENERIC_EXTRACT_COLS = [
    "CAST(id AS STRING) AS id",
    "entity_type",
    "name",
    "CASE id % 11 WHEN 0 THEN 'seed' WHEN 1 THEN 'Series A' WHEN 2 THEN ' series b ' WHEN 3 THEN 'SERIES C' "
    "WHEN 4 THEN 'series e' WHEN 5 THEN 'pre-seed' WHEN 6 THEN 'series-g' WHEN 7 THEN '' WHEN 8 THEN 'growth equity' "
    "WHEN 9 THEN 'Angel' ELSE NULL END AS stage",
    "category_code",
    "CASE WHEN id % 2 = 0 THEN concat('industry_', CAST(id % 3 AS STRING)) END AS industry",
    "country_code",
    "CASE WHEN id % 37 = 5 THEN 'n/a' ELSE CAST(funding_total_usd AS STRING) END AS funding_total_usd",
    "CASE WHEN id % 13 = 0 THEN '' ELSE CAST(id % 9 AS STRING) END AS participants",
    "founded_at",
    "status",
]


def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    cust = read_table(spark, sf_dir, "customer", ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"])
    nation = read_table(spark, sf_dir, "nation", ["n_nationkey", "n_name"])
    return cust.join(nation, cust["c_nationkey"] == nation["n_nationkey"]).selectExpr(*OBJECTS_COLS)


def funding_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_table(spark, sf_dir, "orders", ["o_orderkey", "o_custkey", "o_orderdate"])
    return o.selectExpr(*ROUNDS_COLS)


def investments(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem", ["l_orderkey", "l_suppkey", "l_linenumber"])
    o = read_table(spark, sf_dir, "orders", ["o_orderkey", "o_custkey"])
    return li.join(o, li["l_orderkey"] == o["o_orderkey"]).selectExpr(*INVESTMENTS_COLS)


def prospects(spark: SparkSession, sf_dir: str) -> DataFrame:
    cust = read_table(spark, sf_dir, "customer", ["c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment"])
    nation = read_table(spark, sf_dir, "nation", ["n_nationkey", "n_name"])
    return cust.join(nation, cust["c_nationkey"] == nation["n_nationkey"]).selectExpr(*PROSPECTS_COLS)


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, label, score) rows for the metric operators."""
    lab = read_table(spark, sf_dir, "labels", ["doc_id", "quality"])
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "n_chars"])
    return lab.join(docs, "doc_id").selectExpr(*PREDICTIONS_COLS)


def generic_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An all-text company extract with alternative column names (name,
    category_code + industry, country_code, funding_total_usd text with
    junk, participants text with blanks, founded_at) and raw stage text."""
    return objects(spark, sf_dir).selectExpr(*GENERIC_EXTRACT_COLS)


# ---------------------------------------------------------------------------
# The same definitions as DuckDB CTE bodies.
# ---------------------------------------------------------------------------

def _sql(cols: list[str], src: str, where: str | None = None) -> str:
    w = f" WHERE {where}" if where else ""
    return f"SELECT {', '.join(cols)} FROM {src}{w}"


OBJECTS_SQL = _sql(OBJECTS_COLS, "customer JOIN nation ON c_nationkey = n_nationkey")
FUNDING_ROUNDS_SQL = _sql(ROUNDS_COLS, "orders")
INVESTMENTS_SQL = _sql(INVESTMENTS_COLS, "lineitem JOIN orders ON l_orderkey = o_orderkey")
PROSPECTS_SQL = _sql(PROSPECTS_COLS, "customer JOIN nation ON c_nationkey = n_nationkey")
PREDICTIONS_SQL = _sql(PREDICTIONS_COLS, "labels JOIN documents USING (doc_id)")
GENERIC_EXTRACT_SQL = _sql(GENERIC_EXTRACT_COLS, "objects")

FIXTURE_CTES = (
    f"objects AS ({OBJECTS_SQL}),\n"
    f"funding_rounds AS ({FUNDING_ROUNDS_SQL}),\n"
    f"investments AS ({INVESTMENTS_SQL}),\n"
    f"prospects AS ({PROSPECTS_SQL}),\n"
    f"predictions AS ({PREDICTIONS_SQL}),\n"
    f"generic_extract AS ({GENERIC_EXTRACT_SQL})"
)
