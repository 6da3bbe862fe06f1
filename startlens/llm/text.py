"""Word, shingle and batch helpers shared by the text operators.

Python's ``bytes.split()`` splits on exactly the bytes 0x20 and 0x09-0x0D,
and lower-casing by a 256-byte table touches A-Z alone, so words of
``[^\\x20\\x09-\\x0D]+`` over the lower-cased text are plain byte operations
on its UTF-8 form.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))

#: Lower-cases A-Z; every ASCII byte that is no digit or letter becomes a space.
ALNUM = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


def words(text: str | None) -> list[bytes]:
    """Lower-cased words between ASCII white space; [] for null or empty text."""
    return text.encode().translate(LOWER).split() if text else []


def alnum_words(text: str | None) -> list[bytes]:
    """Lower-cased runs of digits, ASCII letters and non-ASCII characters."""
    return text.encode().translate(ALNUM).split() if text else []


def shingles(ws: list[bytes], n: int) -> set:
    """Distinct n-word shingles; fewer than n words form one shingle."""
    if not ws:
        return set()
    if len(ws) < n:
        return {tuple(ws)}
    return set(zip(*(ws[i:] for i in range(n))))


def doc_bucket(doc_id: str, n: int) -> Column:
    """crc32 of the decimal doc_id modulo n; null for a null id."""
    c = F.col(doc_id)
    return F.when(c.isNotNull(), F.crc32(c.cast("string").cast("binary")) % n)


def small_batches(spark: SparkSession, rows: int = 1000, size: str = "16m") -> None:
    """Hand texts to Python in batches of at most ``rows`` rows and about
    ``size`` bytes, unless the session asks for fewer rows: Spark's default of
    10,000 whole documents is more than a task should hold. The setting holds
    for the session, since a plan reads it when it runs."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name, "10000")) <= rows:
        spark.conf.set(name, str(rows))
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def least_by_hash(table: DataFrame, hashed: Column, limit: int) -> DataFrame:
    """The ``limit`` rows of a stored table that come first by a hash (or all,
    if there are no more), as a table with the hash in ``__u``.

    A count sets a bound of the hash that about twice ``limit`` rows are under,
    so that what is sorted has no more rows when the table has more partitions.
    """
    top = 1 << 40
    out = table.withColumn("__u", F.pmod(hashed, F.lit(top)))
    n = table.count()
    if n > 2 * limit:
        out = out.where(F.col("__u") < F.lit(int(top * 2 * limit / n)))
    return out.orderBy("__u").limit(limit)


def slices(texts, max_bytes: int) -> Iterator[list]:
    """Cut a list of texts into runs of about ``max_bytes`` characters, so the
    arrays that numpy makes of a run stay small whatever the batch holds."""
    out, size = [], 0
    for t in texts:
        out.append(t)
        size += len(t) if t else 1
        if size >= max_bytes:
            yield out
            out, size = [], 0
    if out:
        yield out
