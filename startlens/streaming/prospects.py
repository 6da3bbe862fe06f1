"""Streaming prospect scoring.

The method scores prospects one at a time in an interactive loop. Here the
loop becomes a Structured Streaming query: new prospect files land in a
folder, each micro-batch is scored with the same operators as the batch
path (defaults, validation, prospect KPIs, interpretation -- and, when a
fitted model is given, the model probability and its bands), and the result
is appended to a parquet sink. Scoring is stateless (no population term),
so no watermark or state store is needed, and the checkpoint location
gives exactly-once output across restarts and executor loss.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from startlens.operators import prospects as X

PROSPECT_SCHEMA = (
    "prospect_id long, funding_amount double, stage string, sector string, country string, "
    "investors_count int, founded_year int"
)


def read_prospect_stream(spark: SparkSession, source_dir: str, schema: str = PROSPECT_SCHEMA, max_files_per_trigger: int | None = None) -> DataFrame:
    """A file-stream of prospects (parquet); the schema is fixed up front. A
    batch takes all new files unless ``max_files_per_trigger`` is given."""
    r = spark.readStream.schema(schema)
    if max_files_per_trigger is not None:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.parquet(source_dir)


def score_stream(stream: DataFrame, model=None) -> DataFrame:
    """Score a (streaming or batch) prospects frame; text lists flattened."""
    out = X.score_prospects(stream)
    if model is not None:
        out = X.with_probability_bands(model.transform(out))
    return out.withColumns(
        {
            "reject_reasons": F.array_join("reject_reasons", "; "),
            "strengths": F.array_join("strengths", "; "),
            "concerns": F.array_join("concerns", "; "),
        }
    )


def start_scoring(
    spark: SparkSession,
    source_dir: str,
    sink_dir: str,
    checkpoint_location: str,
    model=None,
    available_now: bool = True,
    processing_time: str | None = None,
    max_files_per_trigger: int | None = None,
) -> StreamingQuery:
    """Start the scoring stream: append to parquet at ``sink_dir``.

    ``available_now`` processes everything present and stops (batch-like
    catch-up); otherwise the query runs on a ``processing_time`` trigger.
    """
    scored = score_stream(read_prospect_stream(spark, source_dir, max_files_per_trigger=max_files_per_trigger), model)
    w = scored.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint_location)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=processing_time or "30 seconds")
    return w.start(sink_dir)
