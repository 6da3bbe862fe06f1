"""Benchmark decontamination with suffix arrays of the training text (operator 7).

The documents of a task are taken in shards of about ``shard_words`` words.
A shard becomes one array of word numbers (0 for words the benchmark does
not have, and between documents) and its suffix array: the positions sorted
by the words that follow, packed several to a 64-bit key. Every suffix of
every benchmark item is binary-searched in every shard. A hit is a run of
``window`` equal words, or a whole item of fewer; hits on the same diagonal
join to the longest verbatim matches, each with its place in the item and
in the document. The array is ordered by the first ``window`` words of a
suffix alone, and positions where too few words of the benchmark follow each
other are left out, since no match starts there; the diagonal join finds how
far a match goes on.

Where a passage repeats, hits times places could be far more than there are
matches. So only the ends of matches are laid out: a hit and a place begin a
match unless the windows before both are equal, and end one unless those after both are.
Memory grows with the words, the hits and the matches found.

The benchmark is the small side: tasks build blocks of at most
``block_bytes`` of text (and one item more), which are stored; the driver
only hands on a stored block at a time, and the documents meet
the blocks one after the other. So the work is (documents x blocks), with no
join and no shuffle, and a hot passage costs one range of the suffix array.

Words compare exactly (no hashing). Null and empty texts have no words; an
item without words has no windows. A null item_id is listed as the empty
string, and rows that repeat an item_id count as one item.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from startlens.llm.text import alnum_words, small_batches
from startlens.operators.stats import prefix_sums
from startlens.session import materialize

MATCH = "struct<item:string,item_pos:int,doc_pos:int,n_words:int>"
RESULT = f"struct<n_words:long,n_hit:long,items:array<string>,matches:array<{MATCH}>>"


class Block:
    """Words and windows of some benchmark items."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int):
        self.window, self.vocab, self.items = window, {}, []
        number, at, sizes = {}, [], []  # distinct windows; (window number, item, place); the items' window sizes
        for item, text in items:
            ws = [self.vocab.setdefault(w, len(self.vocab) + 1) for w in alnum_words(text)]
            if not ws:
                continue
            size = min(window, len(ws))
            self.items.append(item or "")
            sizes.append(size)
            for j in range(len(ws) - size + 1):
                k = number.setdefault(tuple(ws[j : j + size]), len(number))
                at.append((k, len(self.items) - 1, j))
        self.item_size = np.array(sizes, np.int64)
        self.sizes = np.array([len(w) for w in number], np.int64)
        self.bits = max(1, len(self.vocab).bit_length())
        self.per = 64 // self.bits
        padded = np.zeros((len(number), window), np.uint64)
        filled = np.full((len(number), window), (1 << self.bits) - 1, np.uint64)
        for k, w in enumerate(number):
            padded[k, : len(w)] = filled[k, : len(w)] = w
        self.low, self.high = self._pack(padded), self._pack(filled)
        at = np.array(sorted(at), np.int64).reshape(-1, 3)
        # places by window and by the number of the window before (or after) them in their item, -1 for none
        seq = at[np.lexsort((at[:, 2], at[:, 1]))]
        same = seq[1:, 1] == seq[:-1, 1]
        before, after = np.full(len(seq), -1, np.int64), np.full(len(seq), -1, np.int64)
        before[1:][same], after[:-1][same] = seq[:-1, 0][same], seq[1:, 0][same]
        self.places = {}
        for step, near in ((-1, before), (1, after)):
            key = seq[:, 0] * (len(number) + 1) + near + 1
            order = np.argsort(key, kind="stable")
            self.places[step] = key[order], seq[order, 1], seq[order, 2]
        self.place_start = np.searchsorted(at[:, 0], np.arange(len(number) + 1))

    def _pack(self, words: np.ndarray) -> list[np.ndarray]:
        keys = []
        for lo in range(0, self.window, self.per):
            key = np.zeros(len(words), np.uint64)
            for k in range(lo, min(lo + self.per, self.window)):
                key = (key << np.uint64(self.bits)) | words[:, k]
            keys.append(key)
        return keys

    def suffix_array(self, ids: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Positions in the order of the words that follow, and their packed keys.
        ``ids`` ends with ``window`` zeros."""
        n = len(ids) - self.window
        place = np.arange(n + 1)
        zero = np.minimum.accumulate(np.where(ids[: n + 1] == 0, place, n)[::-1])[::-1]
        at = np.flatnonzero(zero - place >= self.sizes.min())
        keys = []
        for lo in range(0, self.window, self.per):
            key = np.zeros(len(at), np.uint64)
            for k in range(lo, min(lo + self.per, self.window)):
                key = (key << np.uint64(self.bits)) | ids[at + k].astype(np.uint64)
            keys.append(key)
        order = np.lexsort(keys[::-1])
        return at[order], [key[order] for key in keys]

    def hits(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, window number) of all occurrences in a shard."""
        if not len(self.sizes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at, keys = self.suffix_array(ids)
        first, last = _bound(keys, self.low, False), _bound(keys, self.high, True)
        count = np.maximum(last - first, 0)
        which = np.repeat(np.arange(len(count)), count)
        inside = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
        return at[first[which] + inside], which

    def _ends(self, pos: np.ndarray, which: np.ndarray, window_at: np.ndarray, step: int) -> np.ndarray:
        """Rows (item, diagonal, position, place) where matches begin (step -1) or end (1), in that order."""
        key, item, place = self.places[step]
        width = len(self.sizes) + 1
        near = window_at[pos + step + 1]  # one position of padding
        first, last = self.place_start[which], self.place_start[which + 1]
        # places whose neighbour is the same window go on with this match
        lo, hi = np.searchsorted(key, which * width + near + 1, "left"), np.searchsorted(key, which * width + near + 1, "right")
        none = near < 0
        lo, hi = np.where(none, first, lo), np.where(none, first, hi)
        out = []
        for a, b in ((first, lo), (hi, last)):
            count = b - a
            from_hit = np.repeat(np.arange(len(which)), count)
            at = np.arange(len(from_hit)) - np.repeat(np.cumsum(count) - count, count) + a[from_hit]
            out.append(np.stack([item[at], pos[from_hit] - place[at], pos[from_hit], place[at]], axis=1))
        rows = np.concatenate(out)
        return rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]

    def matches(self, ids: np.ndarray) -> np.ndarray:
        """Rows (position, length, item, place in the item) of the longest verbatim matches."""
        pos, which = self.hits(ids)
        # a position has at most one whole window; a shorter item is a single window, without neighbours
        window_at = np.full(len(ids) + 2, -1, np.int64)
        whole = self.sizes[which] == self.window if len(which) else np.zeros(0, bool)
        window_at[pos[whole] + 1] = which[whole]
        begin, end = self._ends(pos, which, window_at, -1), self._ends(pos, which, window_at, 1)
        size = self.item_size[begin[:, 0]]
        return np.stack([begin[:, 2], end[:, 2] - begin[:, 2] + size, begin[:, 0], begin[:, 3]], axis=1)


def _bound(keys: list[np.ndarray], asked: list[np.ndarray], right: bool) -> np.ndarray:
    """Binary search of many packed word strings in the sorted suffixes."""
    n = len(keys[0])
    lo, hi = np.zeros(len(asked[0]), np.int64), np.full(len(asked[0]), n, np.int64)
    while n and (open_ := lo < hi).any():
        mid = (lo + hi) >> 1
        at = np.minimum(mid, n - 1)
        less, equal = np.zeros(len(lo), bool), np.ones(len(lo), bool)
        for key, q in zip(keys, asked):
            k = key[at]
            less |= equal & (k < q)
            equal &= k == q
        up = open_ & (less | (equal if right else False))
        lo, hi = np.where(up, mid + 1, lo), np.where(open_ & ~up, mid, hi)
    return lo


def shard_results(texts: list[str | None], earlier: list[list | None], block: Block) -> list[tuple]:
    """(n_words, n_hit, items, matches) of the texts of one shard; ``earlier``
    are matches with other blocks."""
    get, parts, sizes = block.vocab.get, [], []
    for t in texts:
        ws = alnum_words(t)
        sizes.append(len(ws))
        parts.append(np.fromiter(map(get, ws, repeat(0)), np.int32, len(ws)))
        parts.append(np.zeros(1, np.int32))
    ids = np.concatenate([*parts, np.zeros(block.window, np.int32)])
    starts = np.concatenate([[0], np.cumsum(np.array(sizes, np.int64) + 1)])
    found = block.matches(ids)
    doc = np.searchsorted(starts, found[:, 0], side="right") - 1
    own: dict[int, list] = {}
    for d, (pos, size, item, j) in zip(doc.tolist(), found.tolist()):
        own.setdefault(d, []).append((block.items[item], j, pos - int(starts[d]), size))
    out = []
    for d, n in enumerate(sizes):
        ms = own.get(d, []) + [(m["item"], m["item_pos"], m["doc_pos"], m["n_words"]) for m in earlier[d] or ()]
        if not ms:
            out.append((n, 0, [], []))
            continue
        hit, end = 0, 0
        for lo, hi in sorted((m[2], m[2] + m[3]) for m in ms):
            hit += max(0, hi - max(lo, end))
            end = max(end, hi)
        out.append((n, hit, sorted({m[0] for m in ms}), sorted(ms)))
    return out


def benchmark_blocks(benchmark: DataFrame, item_col: str, text_col: str, window: int, block_bytes: int) -> DataFrame:
    """Stored table (block, state) of pickled blocks, each built in a task from
    whole items of ``block_bytes`` of text and at most one item more."""
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text"))
    items = items.withColumns({"size": F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"), "at": F.xxhash64("text")})
    placed = prefix_sums(items, ["item", "at"], ["size"])
    block = F.floor(F.col("size_before") / F.lit(block_bytes)).cast("long").alias("block")

    def build(table: pa.Table) -> pa.Table:
        made = Block(list(zip(table["item"].to_pylist(), table["text"].to_pylist())), window)
        return pa.table({"block": table["block"].slice(0, 1), "state": pa.array([pickle.dumps(made.__dict__)], pa.binary())})

    return materialize(placed.select(block, "item", "text").groupBy("block").applyInArrow(build, "block long, state binary"), "benchmark_blocks")


def _block(state: bytes) -> Block:
    out = Block.__new__(Block)
    out.__dict__.update(pickle.loads(state))
    return out


def find_matches(
    spark: SparkSession,
    docs: DataFrame,
    benchmark: DataFrame,
    out_col: str = "contamination",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 10,
    block_bytes: int = 16 << 20,
    shard_words: int = 500_000,
) -> DataFrame:
    """``docs`` with ``out_col``: n_words, n_hit (words inside a match), items
    (sorted as strings) and matches (item, item_pos, doc_pos, n_words)."""

    def searcher(shared) -> Column:
        @F.arrow_udf(RESULT)
        def search(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
            block = _block(shared.value)
            for text, earlier in batches:
                rows, texts, before, size = [], [], [], 0
                for t, e in zip(text.to_pylist(), earlier.to_pylist()):
                    texts.append(t)
                    before.append(e)
                    size += len(t or "") // 6 + 1
                    if size >= shard_words:
                        rows += shard_results(texts, before, block)
                        texts, before, size = [], [], 0
                rows += shard_results(texts, before, block) if texts else []
                n, hit, items, matches = zip(*rows) if rows else ((), (), (), ())
                matches = [[dict(zip(("item", "item_pos", "doc_pos", "n_words"), m)) for m in ms] for ms in matches]
                kind = pa.list_(pa.struct([("item", pa.string()), ("item_pos", pa.int32()), ("doc_pos", pa.int32()), ("n_words", pa.int32())]))
                yield pa.StructArray.from_arrays(
                    [pa.array(n, pa.int64()), pa.array(hit, pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array(matches, kind)],
                    ["n_words", "n_hit", "items", "matches"],
                )

        return search

    small_batches(spark)
    earlier = F.lit(None).cast(f"array<{MATCH}>")
    blocks = benchmark_blocks(benchmark, item_col, item_text_col, window, block_bytes)
    numbers = sorted(r["block"] for r in blocks.select("block").collect())  # one number per block_bytes of benchmark
    for k in numbers or [None]:
        state = pickle.dumps(Block([], window).__dict__) if k is None else blocks.where(F.col("block") == k).first()["state"]
        docs = docs.withColumn(out_col, searcher(spark.sparkContext.broadcast(bytes(state)))(F.col(text_col), earlier))
        earlier = F.col(out_col)["matches"]
    return docs
