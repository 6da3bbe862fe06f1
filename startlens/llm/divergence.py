"""Quality rules by distribution divergence (operator 13).

Every text gives two histograms: the characters by class (``CLASSES`` and
``other``, white space left out) and the words by common word (the reference
language's common words and ``other``). Both are held against a reference for each
language by Jensen-Shannon distance (square root of the divergence in bits, 0
to 1), and the nearest language counts. A text fails if the distance of its
characters is above ``max_chars`` or that of its common words above
``max_words``. Short texts spread by chance alone: the two tests ask for
``min_words`` and ``min_common`` words.

References are learned from all rows with a language that pass the base
rules. A reference histogram is the mean of its texts' histograms, so that
long texts weigh no more than others. A word is common in a language if it has
a share of at least ``1 / rarity`` of its words, which at most ``rarity``
words can have. They are found exactly, without a table of all words: the
words are first counted by hash bucket in arrays of fixed size, then only the
words in buckets with that share are counted, as a common word's bucket must
be one of them.

Base rules: at least 50 words, and at most half of them in 3-word windows
that the text holds more than once.

The base measures also count code points in words, characters of
``SYMBOLS`` and lines with a word that equal an earlier line. Null, empty and
blank texts have no words, fail the base rules and have null distances. If no
language was learned, the base rules alone decide.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from startlens.llm.text import LOWER, slices, small_batches
from startlens.session import materialize

SYMBOLS = "#*$%&|<>"

#: Classes of characters, as members of a regular expression's brackets.
CLASSES = {
    "lower": "a-z",
    "upper": "A-Z",
    "digit": "0-9",
    "symbol": SYMBOLS,
    "stop": ".,",
    "mark": "!?;:",
    "letter": "\\x{80}-\\x{10FFFF}",
}

SLICE = 1 << 17
BUCKETS = 1 << 16
MAX_REFERENCE_BYTES = 64 << 20
MEASURES = "n_words long,word_chars long,n_symbols long,n_dup_lines long,n_repeat_words long,base_failed boolean"


def _byte_classes() -> bytes:
    """Class number of each byte of UTF-8; the last is for white space and bytes that go on a character."""
    out = bytearray([len(CLASSES)]) * 256
    members = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", SYMBOLS, ".,", "!?;:"]
    for k, m in enumerate(members):
        for b in m.encode():
            out[b] = k
    out[0xC0:] = bytes([len(members)]) * 64  # a character beyond ASCII begins
    out[0x80:0xC0] = bytes([len(CLASSES) + 1]) * 64
    for b in (9, 10, 11, 12, 13, 32):
        out[b] = len(CLASSES) + 1
    return bytes(out)


_BYTE_CLASSES = _byte_classes()


def _repeated_windows(code: np.ndarray, doc: np.ndarray, n_ids: int, n_docs: int) -> np.ndarray:
    """First positions of the 3-word windows that their text holds more than once."""
    at = np.flatnonzero(doc[2:] == doc[:-2])
    if not len(at):
        return at
    wide, most = max(1, int(n_ids).bit_length()), max(1, int(n_docs).bit_length())
    first, rest, width = code[at], code[at + 2], wide
    if 3 * wide + most > 64:  # a long text of many words: number its word pairs first
        pair = np.unique(code[:-1] * (n_ids + 1) + code[1:], return_inverse=True)[1]
        first, width = pair[at], 0
    one = np.uint64
    key = first.astype(one)
    if width:
        key = (key << one(wide)) | code[at + 1].astype(one)
    key = (((key << one(wide)) | rest.astype(one)) << one(most)) | doc[at].astype(one)
    # windows alone in a bucket of their hash are no repeats; the others are compared in full
    bits = one(64 - min(30, len(at).bit_length() + 2))
    bucket = ((key * one(0x9E3779B97F4A7C15)) >> bits).astype(np.int64)
    maybe = np.flatnonzero(np.bincount(bucket)[bucket] > 1)
    order = maybe[np.argsort(key[maybe], kind="stable")]
    same = key[order[1:]] == key[order[:-1]]
    return at[order[np.concatenate((same, [False])) | np.concatenate(([False], same))]] if len(order) else order


def _numbered(words: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
    """Each word's number among the distinct words, and these."""
    distinct = list(dict.fromkeys(words))
    number = dict(zip(distinct, range(len(distinct))))
    return np.fromiter(map(number.__getitem__, words), np.int64, len(words)), distinct


def _buckets(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % BUCKETS


class Counted:
    """Words and repeated windows of a slice of texts (UTF-8 bytes or None),
    with ``chars`` also characters by class, with ``lines`` repeated lines."""

    def __init__(self, texts: list[bytes | None], chars: bool = True, lines: bool = False):
        texts = [t or b"" for t in texts]
        n = len(texts)
        split = [t.split() for t in texts]
        code, ids = _numbered([w for ws in split for w in ws])
        self.n_words = np.array([len(ws) for ws in split], np.int64)
        doc = np.repeat(np.arange(n), self.n_words)
        if chars:
            size = len(CLASSES) + 1
            self.classes = np.zeros((n, size), np.int64)
            for k, t in enumerate(texts):
                self.classes[k] = np.bincount(np.frombuffer(t.translate(_BYTE_CLASSES), np.uint8), minlength=size + 1)[:size]
            self.word_chars = self.classes.sum(axis=1)
            self.n_symbols = self.classes[:, list(CLASSES).index("symbol")]
        if lines:
            self.n_dup_lines = np.zeros(n, np.int64)
            for k, t in enumerate(texts):
                if b"\n" in t:
                    own = [x for x in t.split(b"\n") if x.strip()]
                    self.n_dup_lines[k] = len(own) - len(set(own))
        again = _repeated_windows(code, doc, len(ids), n)
        covered = np.zeros(len(code) + 2, bool)
        for k in range(3):
            covered[again + k] = True
        self.n_repeat_words = np.bincount(doc[covered[: len(code)]], minlength=n)
        self.base_failed = (self.n_words < 50) | (100 * self.n_repeat_words > 50 * self.n_words)
        # lower-cased words for the common-word histograms
        to_low, self.vocabulary = _numbered(b" ".join(ids).translate(LOWER).split())
        self.doc, self.word = doc, to_low[code] if len(code) else code


class Reference:
    """Histograms of one language: ``classes`` (summing to 1), common words and their shares."""

    def __init__(self, classes: np.ndarray, words: list[bytes], shares: np.ndarray):
        self.classes, self.words, self.shares = classes, words, shares


def distances(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of each row of ``p`` to ``q``."""
    m = (p + q) / 2

    def part(x: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(x > 0, x * np.log2(np.where(x > 0, x / m, 1.0)), 0.0).sum(axis=-1)

    return np.sqrt(np.maximum(0.0, (part(p) + part(np.broadcast_to(q, p.shape))) / 2))


def _rows(columns: dict[str, list], types: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[c], t) for c, t in types.items()], list(types))


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", rarity: int = 200) -> dict[str, Reference]:
    """A reference per language, from all rows with a language that pass the base rules."""
    spark = docs.sparkSession
    small_batches(spark)
    labelled = docs.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).where("lang is not null")

    def parts(batches: Iterator[pa.RecordBatch], chars: bool) -> Iterator[tuple[str, Counted, np.ndarray]]:
        for b in batches:
            texts, langs = b.column(0).cast(pa.binary()).to_pylist(), np.array(b.column(1).to_pylist(), object)
            at = 0
            for part in slices(texts, SLICE):
                own, at = langs[at : at + len(part)], at + len(part)
                counted = Counted(part, chars)
                for lang in sorted(set(own)):
                    yield lang, counted, (own == lang) & ~counted.base_failed

    size = len(CLASSES) + 1
    kinds = {"lang": pa.string(), "bucket": pa.int32(), "n": pa.int64(), "x": pa.float64()}

    def by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Words per bucket; below 0, summed class histograms and at last the number of texts."""
        sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for lang, counted, own in parts(batches, True):
            words, classes = sums.setdefault(lang, (np.zeros(BUCKETS, np.int64), np.zeros(size + 1)))
            words += np.bincount(_buckets(counted.vocabulary)[counted.word[own[counted.doc]]], minlength=BUCKETS)
            classes[:size] += (counted.classes[own] / counted.word_chars[own, None]).sum(axis=0)
            classes[size] += own.sum()
        for lang, (words, classes) in sums.items():
            at = np.flatnonzero(words)
            yield _rows({"lang": [lang] * (len(at) + size + 1), "bucket": [*at, *range(-size - 1, 0)],
                         "n": [*words[at], *[0] * (size + 1)], "x": [*[0.0] * len(at), *classes]}, kinds)

    schema = "lang string, bucket int, n long, x double"
    buckets = labelled.mapInArrow(by_bucket, schema).groupBy("lang", "bucket").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
    buckets = materialize(buckets, "word_buckets")
    totals = buckets.groupBy("lang").agg(F.sum("n").alias("total"))
    languages = totals.count()
    if languages * rarity * 64 > MAX_REFERENCE_BYTES:
        raise ValueError(f"{languages} languages of {rarity} common words are too many to broadcast; lower rarity or merge languages")
    heavy = buckets.where("bucket >= 0").join(totals, "lang").where(F.col("n") * rarity >= F.col("total")).where("total > 0")
    # at most `rarity` buckets a language
    mine: dict[str, list[int]] = {}
    for r in heavy.select("lang", "bucket").toArrow().to_pylist():
        mine.setdefault(r["lang"], []).append(r["bucket"])
    shared = spark.sparkContext.broadcast(mine)
    word_kinds = {"lang": pa.string(), "word": pa.binary(), "n": pa.int64(), "x": pa.float64()}

    def by_word(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Counts and summed shares of the words in a heavy bucket, per slice."""
        for lang, counted, own in parts(batches, False):
            there = np.zeros(BUCKETS, bool)
            there[shared.value.get(lang, [])] = True
            wanted = there[_buckets(counted.vocabulary)]
            use = own[counted.doc] & wanted[counted.word]
            word = counted.word[use]
            n = np.bincount(word, minlength=len(wanted))
            x = np.bincount(word, 1.0 / counted.n_words[counted.doc[use]], minlength=len(wanted))
            at = np.flatnonzero(n)
            yield _rows({"lang": [lang] * len(at), "word": [counted.vocabulary[k] for k in at], "n": n[at], "x": x[at]}, word_kinds)

    words = labelled.mapInArrow(by_word, "lang string, word binary, n long, x double")
    words = words.groupBy("lang", "word").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
    words = words.join(totals, "lang").where(F.col("n") * rarity >= F.col("total")).orderBy("lang", "word")
    classes = buckets.where("bucket < 0").orderBy("lang", "bucket")
    out: dict[str, Reference] = {}
    for r in classes.select("lang", "bucket", "x").toArrow().to_pylist():
        out.setdefault(r["lang"], Reference(np.zeros(size + 1), [], np.zeros(0))).classes[r["bucket"] + size + 1] = r["x"]
    shares: dict[str, list[float]] = {}
    for r in words.select("lang", "word", "x").toArrow().to_pylist():
        out[r["lang"]].words.append(r["word"])
        shares.setdefault(r["lang"], []).append(r["x"])
    for lang in list(out):
        texts = out[lang].classes[size]
        if not texts:
            del out[lang]
            continue
        out[lang].classes = out[lang].classes[:size] / texts
        out[lang].shares = np.array(shares.get(lang, []), float) / texts
    return out


def _distances(counted: Counted, references: dict[str, Reference]) -> tuple[np.ndarray, np.ndarray]:
    """Distances of characters and of common words to the nearest language; NaN without words or languages."""
    n = len(counted.n_words)
    near = np.full((2, n), np.inf)
    has = counted.n_words > 0
    chars = counted.classes[has] / counted.word_chars[has, None]
    common = {w: k for k, w in enumerate(sorted({w for r in references.values() for w in r.words}))}
    which = np.fromiter(map(common.get, counted.vocabulary, repeat(len(common))), np.int64, len(counted.vocabulary))
    which = which[counted.word]
    for lang in references:
        ref = references[lang]
        near[0, has] = np.minimum(near[0, has], distances(chars, ref.classes))
        width = len(ref.words) + 1
        column = np.full(len(common) + 1, width - 1, np.int64)
        column[[common[w] for w in ref.words]] = range(width - 1)
        found = np.bincount(counted.doc * width + column[which], minlength=n * width).reshape(n, width)
        own = np.append(ref.shares, max(0.0, 1.0 - ref.shares.sum()))
        near[1, has] = np.minimum(near[1, has], distances(found[has] / counted.n_words[has, None], own))
    near[np.isinf(near)] = np.nan
    return near[0], near[1]


def assess(
    spark: SparkSession,
    references: dict[str, Reference],
    text: Column,
    max_chars: float = 0.32,
    max_words: float = 0.3,
    min_words: int = 50,
    min_common: int = 80,
) -> Column:
    """struct of the base measures, ``base_failed``, the two distances and ``kept``."""
    small_batches(spark)
    shared = spark.sparkContext.broadcast(references)
    names = [c.split(" ")[0] for c in MEASURES.split(",")]

    @F.arrow_udf(f"struct<{MEASURES.replace(' ', ':')},char_distance:double,word_distance:double,kept:boolean>")
    def rate(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        def one(part: list) -> pa.StructArray:
            c = Counted(part, lines=True)
            chars, words = _distances(c, shared.value)
            far = (c.n_words >= min_words) & (chars > max_chars) | (c.n_words >= min_common) & (words > max_words)
            cols = [pa.array(getattr(c, name)) for name in names]
            cols += [pa.array(x, pa.float64(), mask=np.isnan(x)) for x in (chars, words)] + [pa.array(~c.base_failed & ~far)]
            return pa.StructArray.from_arrays(cols, [*names, "char_distance", "word_distance", "kept"])

        for b in batches:
            yield pa.concat_arrays([one(p) for p in slices(b.cast(pa.binary()).to_pylist(), SLICE)] or [one([])])

    return rate(text)
