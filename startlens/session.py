"""Session construction and lineage cutting.

On a cluster the session comes from the platform: we only read
``spark.checkpoint.dir`` from it. A checkpoint folder is set here only when
the session has none (local tests), never on a cluster.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def get_spark(master: str | None = None, app: str = "startlens", shuffle_partitions: int | None = None) -> SparkSession:
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    b = (
        b.config("spark.ui.enabled", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = b.getOrCreate()
    ensure_checkpoint_dir(spark)
    return spark


def _context(spark: SparkSession):
    """The SparkContext, or None on a session without one (Spark Connect)."""
    try:
        return spark.sparkContext
    except Exception:  # Spark Connect sessions expose no SparkContext
        return None


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's checkpoint folder, setting one only if unset."""
    sc = _context(spark)
    current = sc.getCheckpointDir() if sc is not None else None
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        master = sc.master if sc is not None else spark.conf.get("spark.master", "")
        if not master.startswith("local"):
            # a machine-local folder is not readable by other executors
            raise RuntimeError("spark.checkpoint.dir is not set: name a shared folder (e.g. on the distributed file system)")
        # local runs and tests only
        configured = tempfile.mkdtemp(prefix="startlens-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", configured)
    if sc is not None:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir() or configured
    return configured


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Cut lineage by writing ``df`` once as parquet in the shared
    checkpoint folder and reading it back.

    Unlike ``Dataset.checkpoint`` (which computes an uncached plan twice:
    once to count, once to write) this computes the plan once; the copy is
    columnar, so later scans prune columns and push filters; and it lives
    in the shared ``spark.checkpoint.dir``, so it survives executor loss
    (never a local checkpoint or a machine-local folder).
    """
    spark = df.sparkSession
    base = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{base}/tables/{name}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    scope = _SCOPE.get()
    if scope is not None:
        scope.append(path)
    return spark.read.parquet(path)


#: The tables of the innermost open ``scratch_tables`` block of this context.
_SCOPE: ContextVar[list[str] | None] = ContextVar("scratch_tables", default=None)


def in_scope(fn):
    """``fn`` for a worker thread, with the scratch scope of the calling one."""
    scope = _SCOPE.get()

    def run(*args):
        token = _SCOPE.set(scope)
        try:
            return fn(*args)
        finally:
            _SCOPE.reset(token)

    return run


def delete_paths(spark: SparkSession, paths: list[str]) -> int:
    """Delete folders through the Hadoop FileSystem of each path (works for
    any shared store Spark can write to). Returns how many were deleted."""
    try:
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    except Exception:  # no JVM gateway (Spark Connect): leave them
        return 0
    n = 0
    for p in paths:
        hp = jvm.org.apache.hadoop.fs.Path(p)
        if hp.getFileSystem(conf).delete(hp, True):
            n += 1
    return n


@contextmanager
def scratch_tables(spark: SparkSession) -> Iterator[list[str]]:
    """Delete every table materialized inside the block when it ends.

    A table belongs to the innermost block of the context that wrote it, so
    runs in other threads never delete each other's tables.

    For jobs that write their outputs inside the block (the file-based runs);
    a DataFrame returned out of the block must not depend on them.
    """
    paths: list[str] = []
    token = _SCOPE.set(paths)
    try:
        yield paths
    finally:
        _SCOPE.reset(token)
        delete_paths(spark, paths)
