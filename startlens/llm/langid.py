"""Language identification (operator 5): multinomial naive Bayes over hashed
character n-grams.

Text is lower-cased, everything but letters becomes one space, and all 1-,
2- and 3-grams of code points are hashed to ``buckets``. Training counts
cover every labelled row: each task adds its texts into one array per label
and only those arrays are shuffled and summed. The log-probability matrix
(labels x buckets, smoothed, with label priors) is broadcast; its size is
set by the label set and ``buckets``, not by the number of documents, and is
checked. A batch is scored as sparse counts times that matrix in numpy.

A text that is null or has no letter is ``und`` with score 0; so is every
text if nothing could be learned. Ties go to the first label in code-point
order.

The posterior only says which label is best. ``fit`` says whether the text is
like that label at all: its mean log-probability per n-gram, less that of the
label's training n-grams, in standard deviations of these (both moments follow from the
training counts of all labelled rows). It is near 0 for a text of the
language and falls far below for other languages or random letters; null for ``und``.

Every label's log-probabilities are broadcast; labels that need more than
``MAX_MATRIX_BYTES`` (2,048 at the default width) raise a ValueError.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from startlens.llm.text import slices, small_batches
from startlens.session import materialize

ORDERS = (1, 2, 3)
SLICE = 1 << 18
MAX_MATRIX_BYTES = 256 << 20
_MULT = np.uint32(0x9E3779B1)


def letter_table() -> np.ndarray:
    """True for the code points that are letters."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def gram_buckets(texts: list[str | None], letters: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, bucket) of every n-gram of the texts."""
    low = [f" {t.lower()} " if t else " " for t in texts]
    points = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), "<u4")
    doc = np.repeat(np.arange(len(low), dtype=np.int32), [len(t) for t in low])
    is_letter = letters[points]
    # a text begins with its first space and keeps one after each run of letters
    start = np.concatenate((np.ones(len(points[:1]), bool), doc[1:] != doc[:-1]))
    keep = start | is_letter | np.concatenate((np.zeros(len(points[:1]), bool), is_letter[:-1]))
    points = np.where(is_letter, points, np.uint32(32))[keep].astype(np.uint32)
    doc = doc[keep]
    docs, grams = [], []
    h = np.zeros(len(points), np.uint32)
    for n in ORDERS:
        if len(points) < n:
            break
        # rolling hash of n code points, within one text
        h = (h[: len(points) - n + 1] + points[n - 1 :]) * _MULT
        h ^= h >> np.uint32(15)
        whole = doc[: len(points) - n + 1] == doc[n - 1 :]
        if n == 1:
            whole &= points != 32
        docs.append(doc[: len(points) - n + 1][whole])
        grams.append(((h + np.uint32(n)) % np.uint32(buckets)).astype(np.int32)[whole])
    if not docs:
        return np.zeros(0, np.int32), np.zeros(0, np.int32)
    return np.concatenate(docs), np.concatenate(grams)


class LanguageModel:
    """Labels and their log-probabilities; made by :func:`train`."""

    def __init__(self, labels: list[str], log_prob: np.ndarray, log_prior: np.ndarray):
        self.labels, self.log_prob, self.log_prior = labels, log_prob, log_prior
        # moments of a label's log-probability over its own n-grams
        share = np.exp(log_prob)
        self.mean = (share * log_prob).sum(axis=1)
        self.spread = np.sqrt(np.maximum((share * log_prob**2).sum(axis=1) - self.mean**2, 1e-12))

    def score(self, texts: list[str | None], letters: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Best label and its posterior per text."""
        return self.score_and_fit(texts, letters)[:2]

    def score_and_fit(self, texts: list[str | None], letters: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Best label, its posterior and its fit (NaN without one) per text."""
        best, score = ["und"] * len(texts), np.zeros(len(texts))
        if not self.labels:
            return best, score, np.full(len(texts), np.nan)
        buckets = self.log_prob.shape[1]
        doc, gram = gram_buckets(texts, letters, buckets)
        total = np.tile(self.log_prior, (len(texts), 1))
        step = max(1, (1 << 21) // buckets)  # texts whose counts fit in a small dense block
        by = np.argsort(doc, kind="stable")
        doc, gram = doc[by], gram[by]
        for lo in range(0, len(texts), step):
            a, b = np.searchsorted(doc, [lo, lo + step])
            if a == b:
                continue
            counts = np.bincount((doc[a:b] - lo).astype(np.int64) * buckets + gram[a:b])
            cells = np.flatnonzero(counts)
            row, col = cells // buckets, cells % buckets
            part = counts[cells][:, None] * self.log_prob.T[col]
            first = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
            total[lo + row[first]] += np.add.reduceat(part, first, axis=0)
        grams = np.bincount(doc, minlength=len(texts))
        has = grams > 0
        top = total.argmax(axis=1)
        post = 1.0 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
        own = total[np.arange(len(texts)), top] - self.log_prior[top]
        fit = np.where(has, (own / np.maximum(grams, 1) - self.mean[top]) / self.spread[top], np.nan)
        return [self.labels[k] if ok else "und" for k, ok in zip(top, has)], np.where(has, post, 0.0), fit


def train(
    docs: DataFrame, text_col: str = "text", label_col: str = "lang", buckets: int = 1 << 14, alpha: float = 0.1
) -> LanguageModel:
    """Fit on all rows of ``docs`` with a label; rows with a null label teach nothing."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, sums, rows = letter_table(), {}, {}
        for b in batches:
            labels, texts = b.column(1).to_pylist(), b.column(0).to_pylist()
            at = 0
            for part in slices(texts, SLICE):
                own = labels[at : at + len(part)]
                at += len(part)
                names = sorted(set(own))
                code = {x: k for k, x in enumerate(names)}
                doc, gram = gram_buckets(part, letters, buckets)
                key = np.array([code[x] for x in own], np.int64)[doc] * buckets + gram
                found = np.bincount(key, minlength=len(names) * buckets).reshape(len(names), buckets)
                for x in own:
                    rows[x] = rows.get(x, 0) + 1
                for k, x in enumerate(names):
                    sums[x] = sums[x] + found[k] if x in sums else found[k].astype(np.int64)
        for x, s in sums.items():
            at = np.flatnonzero(s)
            # bucket -1 carries the number of rows
            yield pa.RecordBatch.from_arrays(
                [pa.array([x] * (len(at) + 1)), pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(s[at], rows[x]), pa.int64())],
                ["label", "bucket", "n"],
            )

    small_batches(docs.sparkSession)
    labelled = docs.select(F.col(text_col).alias("text"), F.col(label_col).cast("string").alias("label")).where(F.col("label").isNotNull())
    counts = labelled.mapInArrow(count, "label string, bucket int, n long").groupBy("label", "bucket").agg(F.sum("n").alias("n"))
    counts = materialize(counts, "gram_counts")
    n_labels = counts.where("bucket = -1").count()
    if n_labels * buckets * 8 > MAX_MATRIX_BYTES:
        raise ValueError(f"{n_labels} labels x {buckets} buckets are too large to broadcast; lower buckets or merge labels")
    table = counts.toArrow()
    labels = sorted(set(table["label"].to_pylist()), key=str.encode)
    code = {x: k for k, x in enumerate(labels)}
    row = np.array([code[x] for x in table["label"].to_pylist()], np.int64)
    bucket, n = table["bucket"].to_numpy(), table["n"].to_numpy().astype(float)
    grams, prior = np.zeros((len(labels), buckets)), np.zeros(len(labels))
    cell = bucket >= 0
    np.add.at(grams, (row[cell], bucket[cell]), n[cell])
    np.add.at(prior, row[~cell], n[~cell])
    log_prob = np.log(grams + alpha) - np.log(grams.sum(axis=1, keepdims=True) + alpha * buckets) if labels else grams
    return LanguageModel(labels, log_prob, np.log(prior / prior.sum()) if labels else prior)


def predict(spark: SparkSession, model: LanguageModel, text: Column) -> Column:
    """struct(lang_pred, score, fit) of a text column."""
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang_pred:string,score:double,fit:double>")
    def identify(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        letters, own = letter_table(), shared.value
        for b in batches:
            langs, scores, fits = [], [np.zeros(0)], [np.zeros(0)]
            for part in slices(b.to_pylist(), SLICE):
                lang, score, fit = own.score_and_fit(part, letters)
                langs += lang
                scores.append(score)
                fits.append(fit)
            fit = np.concatenate(fits)
            columns = [pa.array(langs, pa.string()), pa.array(np.concatenate(scores)), pa.array(fit, mask=np.isnan(fit))]
            yield pa.StructArray.from_arrays(columns, ["lang_pred", "score", "fit"])

    return identify(text)
