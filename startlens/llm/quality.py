"""Text quality by nearest-neighbour voting in a latent-semantic space (operator 1).

A text becomes hashed counts of short byte-class patterns, of byte trigrams
and of a few whole-text shares (repeated words, distinct words, length). The
latent space is a truncated SVD of the weighted counts (log counts, inverse
document frequency, unit length) of at most ``max_labelled`` labelled rows,
the least by a hash of their id; this bound is the only sample. Their
``rank``-dimensional unit vectors and labels are broadcast: at most
``max_labelled * rank`` doubles at any corpus size.

Every text is projected into that space and its cosines with all labelled
vectors are computed in blocks, exactly. The ``neighbours`` nearest vote
with weight ``cos ** sharpness`` (negative cosines count nothing; of equal
cosines the first rows by hash go first); the score is the weighted share of
label 1, drawn towards the labels' overall share by a weight of ``prior``. A
text without features gets that share, and so does every text if no row is
labelled (share 0.5). Null text is empty. Equal texts get equal scores.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from startlens.llm.text import LOWER, least_by_hash, small_batches
from startlens.session import materialize

CLASS_BUCKETS, GRAM_BUCKETS, SHARES, STEPS = 1024, 1024, 3, 16
N_FEATURES = CLASS_BUCKETS + GRAM_BUCKETS + SHARES * STEPS
SHARE_WEIGHT = 30.0
BLOCK = 256


def byte_classes() -> np.ndarray:
    """Upper, lower, digit, space, line end, other control, non-ASCII, and
    each ASCII sign on its own."""
    out = np.arange(256, dtype=np.uint32) + 8
    out[65:91], out[97:123], out[48:58], out[:32], out[128:] = 1, 2, 3, 6, 7
    out[32], out[10] = 4, 5
    return out


def features(text: str | None, classes: np.ndarray) -> np.ndarray:
    """Hashed counts of one text (the zero vector for an empty one)."""
    out = np.zeros(N_FEATURES, np.float64)
    raw = (text or "").encode()
    if not raw:
        return out
    data = np.frombuffer(raw, np.uint8)
    kind = classes[data]
    # runs of a class count once, twice or three times and more
    start = np.flatnonzero(np.concatenate(([True], kind[1:] != kind[:-1])))
    run = kind[start] * np.uint32(4) + np.minimum(np.diff(np.append(start, len(kind))), 3).astype(np.uint32)
    for n in (1, 2, 3):
        if len(run) >= n:
            h = np.zeros(len(run) - n + 1, np.uint32)
            for k in range(n):
                h = (h * np.uint32(0x01000193)) ^ (run[k : len(run) - n + 1 + k] * np.uint32(0x9E3779B1))
            out[:CLASS_BUCKETS] += np.bincount((h ^ (h >> np.uint32(15))) % np.uint32(CLASS_BUCKETS), minlength=CLASS_BUCKETS)
    low = np.frombuffer(raw.translate(LOWER), np.uint8).astype(np.uint32)
    if len(low) >= 3:
        h = (low[:-2] << np.uint32(16) | low[1:-1] << np.uint32(8) | low[2:]) * np.uint32(0x9E3779B1)
        out[CLASS_BUCKETS : CLASS_BUCKETS + GRAM_BUCKETS] = np.bincount(h >> np.uint32(22), minlength=GRAM_BUCKETS)
    ws = raw.translate(LOWER).split()
    n = len(ws)
    shares = (
        sum(map(bytes.__eq__, ws, ws[1:])) / max(1, n - 1),
        len(set(ws)) / n if n else 0.0,
        min(1.0, np.log1p(n) / 12),
    )
    for k, share in enumerate(shares):
        out[CLASS_BUCKETS + GRAM_BUCKETS + k * STEPS + min(STEPS - 1, int(share * STEPS))] = SHARE_WEIGHT
    return out


class Voter:
    """The latent space and its labelled vectors."""

    def __init__(self, counts: np.ndarray, labels: np.ndarray, rank: int, neighbours: int, sharpness: float, prior: float):
        self.labels, self.neighbours, self.sharpness, self.prior = labels.astype(float), neighbours, sharpness, prior
        self.share = float(self.labels.mean()) if len(labels) else 0.5
        self.idf = np.log((1.0 + len(counts)) / (1.0 + (counts > 0).sum(axis=0))) + 0.1
        weighted = self._weigh(counts)
        if len(counts):
            # the right singular vectors, from the small Gram matrix of features
            _, vectors = np.linalg.eigh(weighted.T @ weighted)
            self.basis = np.ascontiguousarray(vectors[:, ::-1][:, :rank])
        else:
            self.basis = np.zeros((N_FEATURES, 1))
        self.points = self._unit(weighted @ self.basis)

    @staticmethod
    def _unit(x: np.ndarray) -> np.ndarray:
        size = np.sqrt((x * x).sum(axis=1, keepdims=True))
        return np.divide(x, size, out=np.zeros_like(x), where=size > 0)

    def _weigh(self, counts: np.ndarray) -> np.ndarray:
        return self._unit(np.log1p(counts) * self.idf)

    def score(self, counts: np.ndarray) -> np.ndarray:
        """Weighted votes for a block of texts."""
        if not len(self.labels):
            return np.full(len(counts), self.share)
        cos = self._unit(self._weigh(counts) @ self.basis) @ self.points.T
        cos = np.round(cos, 9)  # so that equal labelled rows tie whatever the block
        k = min(self.neighbours, cos.shape[1])
        near = np.argsort(-cos, axis=1, kind="stable")[:, :k] if k == cos.shape[1] else self._nearest(cos, k)
        weight = np.maximum(np.take_along_axis(cos, near, axis=1), 0.0) ** self.sharpness
        votes = (weight * self.labels[near]).sum(axis=1) + self.prior * self.share
        return votes / (weight.sum(axis=1) + self.prior)

    @staticmethod
    def _nearest(cos: np.ndarray, k: int) -> np.ndarray:
        """Places of the k largest of each row; of equal ones the first."""
        limit = -np.partition(-cos, k - 1, axis=1)[:, k - 1 : k]
        above, equal = cos > limit, cos == limit
        room = k - above.sum(axis=1, keepdims=True)
        chosen = above | (equal & (np.cumsum(equal, axis=1) <= room))
        return np.nonzero(chosen)[1].reshape(len(cos), k)


def train(
    docs: DataFrame,
    labels: DataFrame,
    label_col: str = "quality",
    id_col: str = "doc_id",
    text_col: str = "text",
    max_labelled: int = 4000,
    rank: int = 64,
    neighbours: int = 15,
    sharpness: float = 8.0,
    prior: float = 0.05,
) -> Voter:
    """Fit on rows of ``labels`` with a 0/1 label and a document of that id."""
    order = F.xxhash64(F.col(id_col))
    some = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("__label"), order.alias("__h")
    )
    # of rows that repeat an id the least label counts
    some = materialize(some.groupBy("__id", "__h").agg(F.min("__label").alias("__label")), "labelled")
    some = least_by_hash(some, F.col("__h"), max_labelled).select("__id", "__h", "__label")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = byte_classes()
        for b in batches:
            rows = [features(t, classes) for t in b.column(2).to_pylist()]
            at = [np.flatnonzero(r) for r in rows]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0), b.column(1),
                    pa.array([k.astype(np.int32) for k in at], pa.list_(pa.int32())),
                    pa.array([r[k].astype(np.float32) for r, k in zip(rows, at)], pa.list_(pa.float32())),
                ],
                ["h", "label", "at", "n"],
            )

    texts = docs.select(F.col(id_col).alias("__doc"), F.col(text_col).alias("__text"))
    # the sample has at most max_labelled rows
    known = texts.join(F.broadcast(some), F.col("__doc") == F.col("__id")).select("__h", "__label", "__text")
    table = known.mapInArrow(count, "h long, label int, at array<int>, n array<float>").toArrow()
    rows = sorted(zip(table["h"].to_pylist(), table["label"].to_pylist(), table["at"].to_pylist(), table["n"].to_pylist()))
    counts = np.zeros((len(rows), N_FEATURES))
    for k, (_, _, at, n) in enumerate(rows):
        counts[k, at] = n
    return Voter(counts, np.array([r[1] for r in rows]), rank, neighbours, sharpness, prior)


def predict(spark: SparkSession, voter: Voter, text: Column) -> Column:
    """Score of a text column, 0 to 1."""
    small_batches(spark)
    shared = spark.sparkContext.broadcast(voter)

    @F.arrow_udf("double")
    def vote(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model, classes = shared.value, byte_classes()
        for b in batches:
            out = [np.zeros(0)]
            for lo in range(0, len(b), BLOCK):
                counts = np.stack([features(t, classes) for t in b.slice(lo, BLOCK).to_pylist()])
                out.append(np.clip(model.score(counts), 0.0, 1.0))
            yield pa.array(np.concatenate(out))

    return vote(text)
