"""The prospect stream gives the same rows as batch scoring."""

import uuid

from conftest import SF_SMALL


def test_stream_equals_batch(spark):
    from startlens.session import ensure_checkpoint_dir
    from startlens.sources import fixtures
    from startlens.streaming import prospects as SP

    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/test-streams/{uuid.uuid4().hex}"
    src = fixtures.prospects(spark, SF_SMALL)
    src.repartition(3).write.parquet(f"{base}/input")
    q = SP.start_scoring(spark, f"{base}/input", f"{base}/output", f"{base}/_ckpt")
    q.awaitTermination()
    batch = SP.score_stream(src)
    streamed = spark.read.schema(batch.schema).parquet(f"{base}/output")
    assert streamed.count() == src.count()
    assert streamed.exceptAll(batch).count() == 0 and batch.exceptAll(streamed).count() == 0
