"""Company tables stored by company id.

The three input tables are written as parquet, bucketed and sorted by company
id into the same number of buckets. Spark's bucketed scans then give the two
left joins and both aggregates of the enrichment their partitioning: a repeated
run has no exchange at all. What is paid once is the write, one exchange per
table. All rows of a company are in one bucket, so a company holding
a third of all rounds makes one large bucket: for such data use the
plain enrichment, which combines before it shuffles and spreads distinct
investors over tasks.

A store is a folder with ``objects``, ``rounds``, ``investments`` and
``about`` (bucket count and schemas). Opening it defines three tables over
these files in the session's catalog; nothing is copied.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEYS = {"objects": "id", "rounds": "object_id", "investments": "funded_object_id"}


def write_company_store(objects: DataFrame, rounds: DataFrame, investments: DataFrame, path: str, buckets: int = 64) -> str:
    """Write the store; returns its path. ``buckets``: choose it so that a
    bucket of the largest table holds 128 to 256 MB."""
    spark = objects.sparkSession
    if buckets < 1:
        raise ValueError(f"buckets must be at least 1, not {buckets}")
    about = []
    for name, df in {"objects": objects, "rounds": rounds, "investments": investments}.items():
        key, table = KEYS[name], f"store_{name}_{uuid.uuid4().hex}"
        # one task per bucket writes one sorted file, so scans keep the order too
        (df.repartition(buckets, key).write.mode("overwrite").option("path", f"{path}/{name}")
         .bucketBy(buckets, key).sortBy(key).format("parquet").saveAsTable(table))
        spark.sql(f"DROP TABLE {table}")  # the definition only: the files are external
        about.append((name, key, buckets, df.schema.json()))
    spark.createDataFrame(about, "name string, key string, buckets int, schema string").coalesce(1).write.mode("overwrite").parquet(f"{path}/about")
    return path


def open_company_store(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(objects, rounds, investments) of a store as bucketed scans."""
    out = {}
    for r in spark.read.parquet(f"{path}/about").collect():
        table = f"store_{r['name']}_{uuid.uuid4().hex}"
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in T.StructType.fromJson(json.loads(r["schema"])).fields)
        spark.sql(f"CREATE TABLE {table} ({columns}) USING parquet CLUSTERED BY (`{r['key']}`) SORTED BY (`{r['key']}`) "
                  f"INTO {r['buckets']} BUCKETS LOCATION '{path}/{r['name']}'")
        out[r["name"]] = spark.table(table)
    return out["objects"], out["rounds"], out["investments"]


def write_lookup_store(df: DataFrame, path: str, name_col: str = "company", files: int | None = None, block_bytes: int = 8 << 20) -> str:
    """A table clustered by name: range-partitioned and sorted, in small
    row groups with Bloom filters. A lookup then reads the few row groups whose
    bounds and filter may hold the name, instead of all rows."""
    n = files or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # the hash splits a name that a large share of rows carries over several files
    spread = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    (df.repartitionByRange(n, F.col(name_col), spread).sortWithinPartitions(name_col).write.mode("overwrite")
     .option("parquet.block.size", block_bytes).option("parquet.bloom.filter.enabled#" + name_col, "true").parquet(path))
    return path
