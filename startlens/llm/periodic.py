"""Periodic run detection in word sequences (operator 11).

A run is a stretch of consecutive words with smallest period q (words q apart
are identical) and length of at least ``max(min_length, min_exponent * q)``
that neither neighbouring word extends. It is a stretch of matches of its
length less q on the diagonal of lag q, which the sparse diagonal DP follows:
going through the words, each one's earlier occurrences increment the match
lengths of the lags they lie at, and a diagonal that isn't incremented ends
and gives a run if it is long enough.

A word that fills a long text has as many earlier occurrences as the text has
words, so the DP goes through the lags by class [s, 2s), s = 1, 2, 4, ..., in
units of s words that begin at multiples of s. A run of a lag in that class
matches at least one whole unit (two from ``min_exponent`` 4 on), and a unit
has at most s lags, so each class costs one comparison per word: n log n in
all, however often words repeat. Units are compared by 64-bit hashes, which
never miss an equal unit; a diagonal that ends with enough units is compared
word by word for its exact ends, so a collision adds nothing either.

Lags that are no smallest period are left out as their diagonals end: if q's
stretch has a smaller period p, then p divides q (Fine and Wilf, 1965), p's
class came before, and p's run holds the whole stretch. These are dropped
before their words are compared, which leaves as many stretches a class as
runs of that size can exist (n / s, up to a constant).

Null, empty and blank texts have no words and no runs. The whole text is read
at once; memory grows with one batch of texts, or the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from startlens.llm.text import slices, small_batches

SLICE = 1 << 20
CELLS = 1 << 20
RUNS_TYPE = "struct<n_words:long,runs:array<struct<start:long,length:long,period:long>>,collapsed:string>"


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of two neighbouring units from their hashes."""
    h = a * np.uint64(0x9E3779B97F4A7C15) + (b ^ (b >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _ended(hashes: np.ndarray, units: np.ndarray, s: int, most: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(lag, first word, end) of the diagonals of lags [s, 2s) that end, in
    whole units; ``most``: the largest lag of each unit's text."""
    step = max(1, CELLS // max(1, len(units)))
    for low in range(s, min(2 * s, int(most.max(initial=0)) + 1), step):
        lags = np.arange(low, min(low + step, 2 * s))
        at = units[None, :] - lags[:, None]
        same = (hashes[units][None, :] == hashes[at]) & (at >= 0) & (lags[:, None] <= most[None, :])
        row, col = np.nonzero(same)
        if not len(row):
            continue
        # an active lag goes on if the next unit increments it too
        on = (row[1:] == row[:-1]) & (units[col[1:]] == units[col[:-1]] + s)
        first = np.concatenate(([True], ~on))
        last = np.concatenate((~on, [True]))
        yield lags[row[first]], units[col[first]], units[col[last]] + s


def runs_of(codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray, min_length: int, min_exponent: int) -> np.ndarray:
    """(start, length, period) rows of all runs in ``codes``, ordered by start
    and period. Texts begin at ``starts`` with ``sizes`` words; each is
    followed by a code that occurs once, so no diagonal crosses two texts:
    a stretch as long as its lag would have to match that code."""
    found: list[tuple[int, int, int]] = []
    hashes = codes.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    hashes ^= hashes >> np.uint64(31)
    lengths = np.repeat(np.append(sizes, 0), np.append(np.diff(np.append(starts, len(codes))), 0))
    s = 1
    reach = np.full(len(codes) + 1, -1, np.int64)  # the farthest end of a run found so far that begins here or before
    while len(sizes) and s <= sizes.max() // min_exponent:
        units = np.arange(0, len(hashes), s)
        units = units[lengths[units] >= min_exponent * s]
        new = []
        for lag, begin, end in _ended(hashes, units, s, lengths[units] // min_exponent):
            need = np.maximum(min_length - lag, (min_exponent - 1) * lag)
            open_ = (end - begin + 2 * (s - 1) >= need) & (reach[begin - lag] < end)
            for q, b, e, m in zip(lag[open_].tolist(), begin[open_].tolist(), end[open_].tolist(), need[open_].tolist()):
                b, e = max(q, b - s + 1), min(len(codes), e + s - 1)
                same = np.concatenate(([False], codes[b:e] == codes[b - q : e - q], [False]))
                edge = np.flatnonzero(same[1:] != same[:-1])
                for x, y in zip(edge[::2].tolist(), edge[1::2].tolist()):
                    if y - x >= m and reach[b + x - q] < b + y:
                        new.append((b + x - q, y - x + q, q))
        for start, length, _ in new:
            reach[start] = max(reach[start], start + length)
        if new:
            found += new
            reach = np.maximum.accumulate(reach)
        if len(hashes) <= s:
            break
        hashes = _mix(hashes[:-s], hashes[s:])
        s *= 2
    out = np.array(sorted(set(found)), np.int64).reshape(-1, 3)
    return out[np.lexsort((out[:, 2], out[:, 0]))]


def repeated(runs: np.ndarray, n: int) -> np.ndarray:
    """True for words that a run contains after its first period."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(edge[:-1]) > 0


def _of_slice(texts: list[bytes | None], min_length: int, min_exponent: int) -> pa.StructArray:
    words = [t.split() if t else [] for t in texts]
    ids: dict[bytes, int] = {}
    codes: list[int] = []
    for k, ws in enumerate(words):
        codes += [ids.setdefault(w, len(ids)) for w in ws]
        codes.append(-1 - k)
    sizes = np.array([len(ws) for ws in words], np.int64)
    starts = np.cumsum(sizes + 1) - sizes - 1
    runs = runs_of(np.array(codes, np.int64), starts, sizes, min_length, min_exponent)
    cut = np.searchsorted(runs[:, 0], np.append(starts, len(codes)))
    kept = []
    for k, ws in enumerate(words):
        own = runs[cut[k] : cut[k + 1]]
        if len(own):
            own[:, 0] -= starts[k]
            ws = [w for w, gone in zip(ws, repeated(own, len(ws)).tolist()) if not gone]
        kept.append(b" ".join(ws))
    items = pa.StructArray.from_arrays([pa.array(runs[:, k]) for k in range(3)], ["start", "length", "period"])
    lists = pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), items)
    collapsed = pa.array(kept, pa.binary()).cast(pa.string())
    return pa.StructArray.from_arrays([pa.array(sizes), lists, collapsed], ["n_words", "runs", "collapsed"])


def find_runs(spark: SparkSession, text: Column, min_length: int = 6, min_exponent: int = 4) -> Column:
    """struct(n_words, runs, collapsed) of a text column.

    ``runs``: (start, length, period) in words from 0, by start and period.
    ``collapsed``: the words left, joined by one space, when every run keeps
    only its first period. Sets the session's Arrow batches to 1,000 rows.
    """
    if min_exponent < 3:
        raise ValueError("min_exponent below 3: a run need not hold a whole unit")
    small_batches(spark)

    @F.arrow_udf(RUNS_TYPE)
    def detect(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            parts = [_of_slice(part, min_length, min_exponent) for part in slices(b.cast(pa.binary()).to_pylist(), SLICE)]
            yield pa.concat_arrays(parts or [_of_slice([], min_length, min_exponent)])

    return detect(text)
