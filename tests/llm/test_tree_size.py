"""What operator 6 stores, exchanges and repeats, and its packed forms."""

import math
import os
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import data
from startlens.llm import pst
from test_models import deep_texts, plain_tree


def frame(spark, texts):
    return data.docs_frame(spark, [(i, t, None, None, 0) for i, t in enumerate(texts)])


def test_only_what_is_read_later_stays_stored(spark):
    tables = spark.sparkContext.getCheckpointDir().removeprefix("file:") + "/tables"
    before = set(os.listdir(tables)) if os.path.isdir(tables) else set()
    got = pst.score_texts(frame(spark, deep_texts()), F.lit(True), shards=3)
    kept = set(os.listdir(tables)) - before
    assert kept and {x.rpartition("-")[0].rstrip("_0123456789") for x in kept} <= {"word_counts", "entries", "deep_entries"}
    assert got.count() == len(deep_texts())


def test_scoring_joins_no_row_per_key(spark):
    got = pst.score_texts(frame(spark, deep_texts()), F.lit(True), shards=3)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "CoGroup" in plan


@pytest.mark.parametrize("first, most", [(None, 1), (1, 9)], ids=["one round", "longer windows"])
def test_few_open_occurrences_take_one_round(spark, monkeypatch, first, most):
    texts, windows, real = deep_texts(), [], pst.deep_levels

    def counted(*args):
        args = list(args)
        if first and not windows:
            args[5] = first
        windows.append(args[5])
        return real(*args)

    monkeypatch.setattr(pst, "deep_levels", counted)
    got = pst.score_texts(frame(spark, texts), F.col("doc_id") % 7 != 1, shards=2).collect()
    assert len(windows) <= most and (not first or len(windows) > 1)
    _, _, _, _, prob = plain_tree([t for i, t in enumerate(texts) if i % 7 != 1], 0.0, 0.0, 2.0)
    for r in got:
        t = data.words(texts[r["doc_id"]]) + [""]
        assert r["score"] == pytest.approx(sum(math.log10(prob(tuple(t[:k]), w)) for k, w in enumerate(t)))


def test_word_hashes_tell_words_of_any_length_apart():
    rng = random.Random(5)
    words = ["".join(rng.choice("abCDé_0") for _ in range(n)) for n in [1, 2, 7, 8, 9, 16, 17, 255, 256, 257, 300, 5000] * 40]
    words += ["q" * n for n in range(1, 600)] + ["Q" * 264, "q" * 263 + "r", "r" + "q" * 263]
    text = (" " + "\t\x0b\n".join(words) + " ").encode()
    hashes, at = pst.WordHashes().of(text)
    low = [w.translate(pst.LOWER) for w in text.split()]
    assert len(hashes) == len(low) and all(text[a : a + len(w)].translate(pst.LOWER) == w for a, w in zip(at.tolist(), low))
    assert len(set(zip(low, hashes.tolist()))) == len(set(low)) == len(set(hashes.tolist()))
    assert (hashes > 1).all() and len(pst.WordHashes().of(b" \n")[0]) == 0


@pytest.mark.parametrize("depth", [1, 2])
def test_short_strings_of_many_words(monkeypatch, depth):
    ids, starts = pst.hash_tokens(deep_texts() + ["", None], pst.WordHashes())
    bits = np.full(1 << (pst.BITS - 3), 255, np.uint8)
    few = pst.short_strings(ids, starts, depth, bits)
    monkeypatch.setattr(pst, "WORD_BITS", 3)
    many = pst.short_strings(ids, starts, depth, bits)
    assert sorted(zip(*(x.tolist() for x in few))) == sorted(zip(*(x.tolist() for x in many)))
    sizes = np.diff(np.append(starts, len(ids)))
    assert few[3].sum() == np.maximum(sizes - depth, 0).sum()


def test_packed_answers_hold_every_key():
    rng = np.random.default_rng(3)
    keys = np.unique(rng.integers(0, 2**64, 5000, dtype=np.uint64))
    a, b = np.arange(len(keys)), np.arange(len(keys)) * 3
    cuts = [(2000, len(keys)), (0, 10), (10, 10), (10, 2000), (1900, 2100)]  # out of order, empty, asked twice
    known = pa.table([pa.array([f(x[i:j]) for i, j in cuts], pa.binary()) for f, x in ((pst.steps, keys), (lambda x: pst.planes(x).tobytes(), a), (lambda x: pst.planes(x).tobytes(), b))], names=["keys", "a", "b"])
    index, other = pst.Answers(known), rng.integers(0, 2**64, 5000, dtype=np.uint64)
    there, x, y = index.of(np.concatenate([keys[::-1], other]))
    assert there.tolist() == [True] * len(keys) + np.isin(other, keys).tolist()
    assert (x[: len(keys)] == a[::-1]).all() and (y[: len(keys)] == b[::-1]).all()
    assert not pst.Answers(known[:0]).of(keys)[0].any()
    assert [len(x) for x in np.split(keys, np.flatnonzero(np.diff(pst.of_range(keys, 7))) + 1)] == np.bincount(pst.of_range(keys, 7)).tolist()
