"""CSV scan that parts good rows from bad ones.

``read_csv`` turns what it can't read into nulls without a word. Here every
row of the files ends up in one of two tables: the accepted rows, as text
columns whose numbers and dates are known to convert, and the rejected ones
with their text and the reasons. A blank value is missing, not bad, unless
its column is required.

Reasons: ``fields`` (too few or too many fields, or a quote left open),
``number:<column>``, ``date:<column>``, ``missing:<column>``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from startlens.session import materialize

BROKEN = "__broken"


def _blank(c: str) -> Column:
    return F.coalesce(F.trim(F.col(f"`{c}`")) == "", F.lit(True))


def _reasons(numbers: Sequence[str], dates: Sequence[str], required: Sequence[str], date_format: str) -> Column:
    found = []
    for c in numbers:
        x = F.trim(F.col(f"`{c}`")).try_cast("double")
        bad = x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
        found.append(F.when(~_blank(c) & bad, F.lit(f"number:{c}")))
    for c in dates:
        found.append(F.when(~_blank(c) & F.try_to_date(F.trim(F.col(f"`{c}`")), date_format).isNull(), F.lit(f"date:{c}")))
    found += [F.when(_blank(c), F.lit(f"missing:{c}")) for c in required]
    # a broken line's columns are unreliable: it has this reason alone
    return F.when(F.col(BROKEN).isNotNull(), F.array(F.lit("fields"))).otherwise(F.array_compact(F.array(*found)))


def read_csv_checked(
    spark: SparkSession,
    path: str,
    numbers: Sequence[str] = (),
    dates: Sequence[str] = (),
    required: Sequence[str] = (),
    date_format: str = "yyyy-MM-dd",
    columns: Sequence[str] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) rows of CSV files.

    With ``columns`` the files have no header line. ``rejected`` has
    ``line`` (a broken row as it stands in the file, another one as CSV again)
    and ``reasons``. Lines without any character aren't rows. The parsed rows are
    stored once; both tables read that copy, so they always add up.
    """
    options = {"quote": '"', "escape": '"', "mode": "PERMISSIVE", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    if columns is None:
        columns = spark.read.options(header=True, **options).csv(path).columns
        options["header"] = True
    unknown = [c for c in (*numbers, *dates, *required) if c not in columns]
    if unknown:
        raise ValueError(f"no such column: {', '.join(unknown)}")
    schema = ", ".join(f"`{c}` string" for c in [*columns, BROKEN])
    raw = spark.read.options(columnNameOfCorruptRecord=BROKEN, columnPruning=False, **options).schema(schema).csv(path)
    rows = materialize(raw.withColumn("__reasons", _reasons(numbers, dates, required, date_format)), "csv_rows")
    names = [F.col(f"`{c}`") for c in columns]
    accepted = rows.where(F.size("__reasons") == 0).select(*names)
    line = F.coalesce(F.col(BROKEN), F.to_csv(F.struct(*names), {"quote": '"', "escape": '"'}))
    rejected = rows.where(F.size("__reasons") > 0).select(line.alias("line"), F.col("__reasons").alias("reasons"))
    return accepted, rejected


def quarantine_summary(accepted: DataFrame, rejected: DataFrame) -> DataFrame:
    """(reason, rows): accepted rows, and rejected rows per reason and in all.
    A row with two reasons counts under both, and once in ``rejected``."""
    per = rejected.select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("rows"))
    whole = [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("reason"), "rows") for name, df in (("accepted", accepted), ("rejected", rejected))]
    return whole[0].unionByName(whole[1]).unionByName(per)
