"""Language-model scoring with a probabilistic suffix tree (operator 6).

Tokens are the lower-cased words of a text and one end token. The tree's root is
the add-half unigram distribution of the training tokens. Its other states
are contexts of preceding words (Ron, Singer and Tishby, 1996):

* a next symbol is listed under a context if the whole string occurs twice, at
  any corpus size. ``min_context`` and ``min_string`` can ask for a share of
  the training tokens besides; they are 0 unless a caller sets them;
* a context is retained if its next-symbol distribution diverges from that
  of its longest retained suffix: count times Kullback-Leibler divergence of
  at least ``cutoff / 2 * (d + 1) * ln(training tokens)`` with d listed
  symbols, the Bayesian information criterion's price of that many parameters
  (Csiszar and Talata, 2006) at ``cutoff`` 1. A bound without d would
  retain contexts of many followers for their sampling noise alone;
* all contexts of one and two words are tested. A longer one is tested if its
  suffix, one word shorter, is retained, and the tree ends at the depth where
  none is. Levels are grown one by one while the retained contexts have many
  occurrences; once ``LOCAL_TOKENS`` or fewer are left, every retained
  context's occurrences, with a window of the words before them, go to one
  task, which grows its whole subtree (a subtree that outgrows the window is grown
  again with a longer one);
* distributions are smoothed: under a context of count C whose d listed
  symbols have count L, ``P(x) = (n(x) + (C - L + d + 1) * P'(x)) / (C + d +
  1)``, with n(x) = 0 for an unlisted symbol and P' that of the longest
  retained proper suffix. It sums to 1.

A text's score is the sum of log10 P of its tokens, each under the longest
retained suffix of the words before it.

All counts cover all training rows. Words, contexts and strings go by 64-bit
hashes. Counts, strings and retained states are stored tables and are never
collected or broadcast: documents are dealt to shards by doc_id, each shard
asks for the entries of its own distinct words, contexts and strings, packed
by range of the key, and texts and entries of a shard meet in one task. Popular
entries cost one answer per shard. What is broadcast is a bitmap of ``BITS`` bits per
table, which only spares asking for keys that the table cannot hold; a fuller
bitmap lets more through and changes no result.

A null text is empty and scores as its end token. Rows without a doc_id are
not learned from and are scored. Rows that repeat are scored each.
"""

from __future__ import annotations

import gc
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from startlens.llm.text import LOWER, slices, small_batches
from startlens.session import delete_paths, materialize

END = np.uint64(1)  # the end token; no word has this hash
WHITE = re.compile(rb"[\x20\x09-\x0D]")
INSIDE = bytes(0 if b == 32 or 9 <= b <= 13 else 1 for b in range(256))
BITS = 27
PIECES = 64
FLUSH_KEYS = 400_000
SLICE = 1 << 18
SHARD_BYTES = 48 << 20
PART_BYTES = 6 << 20
PACK_TOKENS = 1 << 21
WORD_BITS = 21
LOCAL_TOKENS = 200_000
WINDOW_WORDS = 32
BLOBS = ("contexts", "suffixes", "sizes", "symbols", "counts")

_MUL = np.uint64(0xFF51AFD7ED558CCD)
_BACK = np.uint64(0x9E3779B97F4A7C15)
_NEXT = np.uint64(0xC2B2AE3D27D4EB4F)
_REST = np.uint64(0x165667B19E3779F9)
#: In the place of a symbol: the row counts the context itself.
WHOLE = 0


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MUL
    return h ^ (h >> np.uint64(29))


def longer(context: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Key of a context with one more word before it; a one-word context has its word's hash."""
    return _mix(context * _BACK + before)


def string_key(context: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    return _mix(context * _NEXT + symbol)


def rest_key(context: np.ndarray) -> np.ndarray:
    return _mix(context ^ _REST)


class WordHashes:
    """64-bit hashes of the lower-cased words of byte strings, by numpy.

    A word's length is mixed with its bytes, eight at a time for all words
    together. Words of over ``LONG`` bytes mix a sum of their eight bytes, each
    mixed with its place."""

    BLOCK = 1 << 19
    LONG = 256
    KEEP = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)

    def of(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the words and where they start."""
        hashes, starts, lo = [], [], 0
        while lo < len(text):
            hi = min(lo + self.BLOCK, len(text))
            if hi < len(text):  # a block ends at white space
                after = WHITE.search(text, hi)
                hi = after.start() if after else len(text)
            block = text[lo:hi].translate(LOWER)
            inside = np.frombuffer(b"\0" + block.translate(INSIDE) + b"\0", np.uint8)
            edges = np.flatnonzero(inside[1:] != inside[:-1])
            first, size = edges[::2], edges[1::2] - edges[::2]
            eight = np.ndarray((len(block) + 1,), "<u8", block + bytes(8), strides=(1,))
            own = _mix(size.astype(np.uint64) * _BACK + _mix(eight[first] & self.KEEP[np.minimum(size, 8)]))
            done, more = 8, np.flatnonzero((size > 8) & (size <= self.LONG))
            while len(more):
                left = size[more] - done
                own[more] = _mix(own[more] * _NEXT + _mix(eight[first[more] + done] & self.KEEP[np.minimum(left, 8)]))
                done, more = done + 8, more[left > 8]
            for k in np.flatnonzero(size > self.LONG).tolist():
                parts = eight[first[k] : first[k] + size[k] : 8].copy()
                parts[-1] &= self.KEEP[(size[k] - 1) % 8 + 1]
                own[k] = _mix(own[k : k + 1] + _mix(_mix(parts) + np.arange(len(parts), dtype=np.uint64) * _REST).sum())[0]
            hashes.append(np.where(own <= 1, own + np.uint64(2), own))
            starts.append(first + lo)
            lo = hi
        return (np.concatenate(hashes), np.concatenate(starts)) if hashes else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def hash_tokens(texts: list[str | None], hasher: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens and where each text starts."""
    data = [t.encode() if t else b"" for t in texts]
    own, at = hasher.of(b"\n".join(data))
    ends = np.cumsum([len(d) + 1 for d in data])
    sizes = np.diff(np.searchsorted(at, np.concatenate(([0], ends))) if len(data) else [0])
    starts = np.cumsum(sizes + 1) - sizes - 1
    ids = np.full(len(own) + len(data), END, np.uint64)
    ids[np.arange(len(own)) + np.repeat(np.arange(len(data)), sizes)] = own
    return ids, starts


def contexts(ids: np.ndarray, starts: np.ndarray, depth: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For 1 to ``depth`` words: the tokens that have so many words before them, and the keys of these."""
    place = np.arange(len(ids)) - np.repeat(starts, np.diff(np.append(starts, len(ids))))
    at, key = np.flatnonzero(place >= 1), None
    for d in range(1, depth + 1):
        if d == 1:
            key = ids[at - 1]
        else:
            inside = place[at] >= d
            at, key = at[inside], key[inside]
            key = longer(key, ids[at - d])
        yield at, key


def has(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether the bitmap can hold each key."""
    slot = keys & np.uint64((1 << BITS) - 1)
    return (bits[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 > 0


def states(ids: np.ndarray, starts: np.ndarray, depth: int, bits: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For 1 to ``depth`` words: the tokens whose context the bitmap can hold as
    retained, the context and its key. From three words on, the context one
    word shorter must be one too."""
    place = np.arange(len(ids)) - np.repeat(starts, np.diff(np.append(starts, len(ids))))
    at = np.flatnonzero(place >= 1)
    context = ids[at - 1]
    for d in range(1, depth + 1):
        if d > 1:
            inside = place[at] >= d
            at, context = at[inside], context[inside]
            context = longer(context, ids[at - d])
        if not len(at):
            return
        key = rest_key(context)
        there = has(bits, key)
        yield at[there], context[there], key[there]
        if d > 1:
            at, context = at[there], context[there]


def blobs_by_part(part: np.ndarray, columns: list[np.ndarray]) -> Iterator[tuple[int, list[bytes]]]:
    """The columns of each part, which come in order of their part, as bytes."""
    edges = np.concatenate(([0], np.flatnonzero(np.diff(part)) + 1, [len(part)]))
    for a, b in zip(edges[:-1], edges[1:]):
        if a < b:
            yield int(part[a]), [x[a:b].tobytes() for x in columns]


def of_range(keys: np.ndarray, parts: int) -> np.ndarray:
    """Which of ``parts`` equal ranges of 64 bits sorted keys fall in."""
    width = np.uint64((1 << 64) // parts + 1)
    return (keys // width).astype(np.int64)


def planes(x: np.ndarray) -> np.ndarray:
    """64-bit numbers as rows of their eight bytes, the lowest first: zeros come together and compress away."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8).T)


def from_planes(data: bytes, kind: type = np.uint64) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).reshape(-1).view(kind)


def steps(keys: np.ndarray) -> bytes:
    """Sorted keys by what each adds to the one before."""
    return planes(np.diff(keys, prepend=np.uint64(0))).tobytes()


def from_steps(data: bytes) -> np.ndarray:
    return np.cumsum(from_planes(data), dtype=np.uint64)


def bitmap(keys: DataFrame) -> np.ndarray:
    """Bitmap of a long column ``key``: 16 MB, whatever the table's size."""
    width = (1 << BITS) // PIECES

    def pack(found: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        slot = np.unique(np.concatenate(found))
        for p, (x,) in blobs_by_part(slot // width, [(slot % width).astype("<u4")]):
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([x], pa.binary())], ["part", "slots"])

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, size = [], 0
        for b in batches:
            found.append(b.column(0).to_numpy(zero_copy_only=False) & ((1 << BITS) - 1))
            size += len(found[-1])
            if size >= PACK_TOKENS:
                yield from pack(found)
                found, size = [], 0
        if size:
            yield from pack(found)

    def piece(table: pa.Table) -> pa.Table:
        on = np.zeros(width, bool)
        for x in table["slots"].to_pylist():
            on[np.frombuffer(x, "<u4")] = True
        return pa.table({"part": table["part"][:1], "bits": pa.array([np.packbits(on, bitorder="little").tobytes()], pa.binary())})

    out = np.zeros((PIECES, width // 8), np.uint8)
    packed = keys.select("key").mapInArrow(slots, "part int, slots binary")
    for part, b in packed.groupBy("part").applyInArrow(piece, "part int, bits binary").collect():
        out[part] = np.frombuffer(b, np.uint8)
    return out.ravel()


def _longs(keys: np.ndarray) -> pa.Array:
    return pa.array(keys.view(np.int64))


def word_counts(train: DataFrame, parts: int) -> DataFrame:
    """(key, c) over the tokens of the texts."""

    def pack(found: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        key, n = np.unique(np.concatenate(found), return_counts=True)
        for p, (k, c) in blobs_by_part(of_range(key, parts), [key, n.astype("<u4")]):
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([k], pa.binary()), pa.array([c], pa.binary())], ["part", "keys", "counts"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, found, size = WordHashes(), [], 0
        for b in batches:
            for part in slices(b.column(0).to_pylist(), SLICE):
                found.append(hash_tokens(part, hasher)[0])
                size += len(found[-1])
                if size >= PACK_TOKENS:
                    yield from pack(found)
                    found, size = [], 0
        if size:
            yield from pack(found)

    def add_up(table: pa.Table) -> pa.Table:
        keys, n = (np.frombuffer(b"".join(table[c].to_pylist()), t) for c, t in (("keys", "<u8"), ("counts", "<u4")))
        key, at = np.unique(keys, return_inverse=True)
        return pa.table({"key": _longs(key), "c": pa.array(np.bincount(at, n, len(key)).astype(np.int64))})

    return train.mapInArrow(count, "part int, keys binary, counts binary").groupBy("part").applyInArrow(add_up, "key long, c long")


def counted(context: np.ndarray, suffix: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct strings in order of their context, with their numbers."""
    _, first, n = np.unique(string_key(context, symbol), return_index=True, return_counts=True)
    order = np.argsort(context[first], kind="stable")
    return (*(x[first][order] for x in (context, suffix, symbol)), n[order])


def short_strings(ids: np.ndarray, starts: np.ndarray, depth: int, bits: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct (context, suffix, symbol) of one or two words and a symbol, those
    of a context together, with their numbers. ``bits`` holds the words or the
    two-word strings seen twice: a string seen twice consists of such. Strings
    are sorted as one number each, made of their words' numbers among the texts' words."""
    place = np.arange(len(ids)) - np.repeat(starts, np.diff(np.append(starts, len(ids))))
    coded = pa.array(ids).dictionary_encode()
    words, code = coded.dictionary.to_numpy(), coded.indices.to_numpy().astype(np.uint64)
    seen = np.zeros(len(ids), bool)
    if depth == 1:
        seen = has(bits, words)[code.astype(np.int64)]
    else:
        at = np.flatnonzero(place >= 1)
        seen[at] = has(bits, longer(ids[at], ids[at - 1]))
    at = np.flatnonzero(place >= depth)
    at = at[seen[at] & seen[at - 1]]
    if len(words) > 1 << WORD_BITS:  # a text of very many words
        suffix = ids[at - 1]
        return counted(suffix, np.zeros(len(at), np.uint64), ids[at]) if depth == 1 else counted(longer(suffix, ids[at - 2]), suffix, ids[at])
    w, low = np.uint64(WORD_BITS), np.uint64((1 << WORD_BITS) - 1)
    string = code[at - 1] << w | code[at]
    if depth == 2:
        string |= code[at - 2] << (w + w)
    string, n = np.unique(string, return_counts=True)
    last, symbol = words[(string >> w & low).astype(np.int64)], words[(string & low).astype(np.int64)]
    if depth == 1:
        return last, np.zeros(len(n), np.uint64), symbol, n
    return longer(last, words[(string >> (w + w)).astype(np.int64)]), last, symbol, n


def long_strings(ids: np.ndarray, starts: np.ndarray, depth: int, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, suffix, symbol) of three words or more and a symbol.
    ``bits`` holds the retained contexts one word shorter."""
    for at, suffix in contexts(ids, starts, depth - 1):
        pass
    listed = has(bits, suffix)
    at, suffix = at[listed], suffix[listed]
    inside = at - starts[np.searchsorted(starts, at, "right") - 1] >= depth
    at, suffix = at[inside], suffix[inside]
    return longer(suffix, ids[at - depth]), suffix, ids[at]


def string_counts(train: DataFrame, depth: int, open_bits, parts: int) -> DataFrame:
    """(context, suffix, symbol, n): how often each context of ``depth`` words
    is followed by each symbol and, from depth 3 on, by any (symbol ``WHOLE``),
    if twice or more. Tasks add up runs of strings and pack them by part of the
    strings' hash, so no string or context is hot and little is exchanged.
    ``open_bits`` (broadcast) holds the words seen twice (depth 1), the two-word
    strings seen twice (depth 2) or the retained contexts one word shorter. At
    depth 1 no context has a suffix; there ``suffix`` is the key of the string as a context of two words."""

    def pack(found: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        """A row per part: its distinct contexts with their suffixes and number
        of symbols, and the symbols with their counts. A string takes little more than its symbol."""
        if depth <= 2:
            shift = np.cumsum([0] + [len(ids) for ids, _ in found[:-1]])
            ids, starts = np.concatenate([ids for ids, _ in found]), np.concatenate([s + k for (_, s), k in zip(found, shift)])
            context, suffix, symbol, n = short_strings(ids, starts, depth, open_bits.value)
        else:
            context, suffix, symbol = (np.concatenate(x) for x in zip(*found))
            # a context occurs by itself too
            context, suffix, symbol, n = counted(np.tile(context, 2), np.tile(suffix, 2), np.append(symbol, np.full(len(symbol), WHOLE, np.uint64)))
        if not len(n):
            return
        part = string_key(context, symbol) % np.uint64(parts)
        order = np.argsort(part.astype(np.uint16 if parts < 1 << 16 else np.int64), kind="stable")
        part, n = part[order].astype(np.int64), n[order]
        context, suffix, symbol = context[order], suffix[order], symbol[order]
        new = np.flatnonzero(np.concatenate(([True], (context[1:] != context[:-1]) | (part[1:] != part[:-1]))))
        sizes = np.diff(np.append(new, len(part)))
        strings = blobs_by_part(part, [symbol, n.astype("<u4")])
        for (p, one), (_, two) in zip(blobs_by_part(part[new], [context[new], suffix[new], sizes.astype("<u4")]), strings):
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), *(pa.array([x], pa.binary()) for x in one + two)], ["part", *BLOBS])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, found, size = WordHashes(), [], 0
        for b in batches:
            for part in slices(b.column(0).to_pylist(), SLICE):
                found.append(hash_tokens(part, hasher))
                if depth > 2:
                    found[-1] = long_strings(*found[-1], depth, open_bits.value)
                size += len(found[-1][0])
                if size >= PACK_TOKENS:
                    yield from pack(found)
                    found, size = [], 0
        if size:
            yield from pack(found)

    def add_up(table: pa.Table) -> pa.Table:
        context, suffix, sizes, symbol, n = (np.frombuffer(b"".join(table[c].to_pylist()), t) for c, t in zip(BLOBS, ("<u8", "<u8", "<u4", "<u8", "<u4")))
        which = np.repeat(np.arange(len(context)), sizes)
        key = string_key(context[which], symbol)
        # most strings come once: only those that can have come twice are put in order
        in_order = np.sort(key)
        again, low = np.zeros(1 << 20, bool), np.uint64((1 << 20) - 1)
        again[(in_order[1:][in_order[1:] == in_order[:-1]] & low).astype(np.int64)] = True
        some = np.flatnonzero((n > 1) | again[(key & low).astype(np.int64)])
        which, symbol, n = which[some], symbol[some], n[some]
        _, first, at = np.unique(key[some], return_index=True, return_inverse=True)
        total = np.bincount(at, n, len(first)).astype(np.int64)
        often = total > 1
        first = first[often]
        context, suffix, symbol = context[which[first]], suffix[which[first]], symbol[first]
        if depth == 1:
            suffix = longer(symbol, context)
        return pa.table({"context": _longs(context), "suffix": _longs(suffix), "symbol": _longs(symbol), "n": pa.array(total[often])})

    packed = train.mapInArrow(count, "part int, " + ", ".join(f"{c} binary" for c in BLOBS))
    return packed.groupBy("part").applyInArrow(add_up, "context long, suffix long, symbol long, n long")


def subtree(before: list[np.ndarray], symbols: np.ndarray, parents: dict[int, float], key: int, threshold: float,
            least: tuple[float, float] = (2.0, 2.0)) -> tuple[list, int, bool]:
    """All states below a retained context, from its occurrences: the words
    before each (the nearest first) and the symbol after it. ``parents``: P of
    the listed symbols under the context. Returns (key, a, b) entries, the
    number of levels, and whether a state went beyond the words given."""
    entries, levels, cut = [], 0, False
    width = max((len(x) for x in before), default=0)
    words = np.zeros((len(before), width + 1), np.uint64)
    for k, x in enumerate(before):
        words[k, : len(x)] = x
    todo = [(np.arange(len(before)), np.uint64(key), 0, parents)]
    while todo:
        members, context, level, parent = todo.pop()
        own = words[members, level]
        if level >= width:
            cut = True
            continue
        order = np.argsort(own, kind="stable")
        for part in np.split(members[order], np.flatnonzero(np.diff(own[order])) + 1):
            word = words[part[0], level]
            if not word or len(part) < least[0]:  # no word before, or seen once
                continue
            symbol, n = np.unique(symbols[part], return_counts=True)
            symbol, n = symbol[n >= least[1]], n[n >= least[1]].astype(float)
            if not len(n):
                continue
            c, d, l = float(len(part)), len(n), n.sum()
            p = np.array([parent[x] for x in symbol.tolist()])
            left = 1 - l / c
            inner = (n * np.log(n / c / p)).sum() / c + (left * np.log(left / max(1 - p.sum(), 1e-300)) if left > 1e-12 else 0.0)
            if c * inner < threshold * (d + 1):
                continue
            weight = c + d + 1
            rest, child = (c - l + d + 1) / weight, longer(np.array([context]), np.array([word]))
            entries.append((rest_key(child)[0], int(weight), int(c - l + d + 1)))
            entries += [(k, int(x), 0) for k, x in zip(string_key(np.repeat(child, d), symbol), n)]
            levels = max(levels, level + 1)
            todo.append((part, child[0], level + 1, dict(zip(symbol.tolist(), (n / weight + rest * p).tolist()))))
    return entries, levels, cut


def deep_levels(texts: DataFrame, own: DataFrame, kept: DataFrame, depth: int, threshold: float, window: int, least: tuple[float, float]) -> DataFrame:
    """(key, a, b, levels, cut): every state deeper than the retained contexts
    ``kept`` of ``depth`` words, each context's subtree grown by one task."""

    # every retained context occurs twice or more, so these are at most LOCAL_TOKENS / 2 keys
    open_keys = np.sort(kept.select("w").toArrow()["w"].to_numpy().view(np.uint64))
    shared = texts.sparkSession.sparkContext.broadcast(open_keys)

    def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, found = WordHashes(), {}
        for b in batches:
            for part in slices(b.column(0).to_pylist(), SLICE):
                ids, starts = hash_tokens(part, hasher)
                for at, context in contexts(ids, starts, depth):
                    pass
                place = np.minimum(np.searchsorted(shared.value, context), len(shared.value) - 1)
                there = shared.value[place] == context
                at, context = at[there], context[there]
                first = np.repeat(starts, np.diff(np.append(starts, len(ids))))[at]
                for i, f, c in zip(at.tolist(), first.tolist(), context.tolist()):
                    found.setdefault(c, []).append((ids[i], ids[max(f, i - depth - window) : i - depth][::-1]))
        for c, own in found.items():
            sizes = np.array([len(x) for _, x in own], "<u4")
            blobs = (np.array([x for x, _ in own], "<u8"), sizes, np.concatenate([x for _, x in own]).astype("<u8"))
            yield pa.RecordBatch.from_arrays(
                [_longs(np.array([c], np.uint64)), *(pa.array([x.tobytes()], pa.binary()) for x in blobs)], ["context", "symbols", "sizes", "words"]
            )

    def grow(table: pa.Table) -> pa.Table:
        mine, listed = table.filter(table["symbols"].is_valid()), table.filter(table["p"].is_valid())
        parents = dict(zip(listed["symbol"].to_numpy().view(np.uint64).tolist(), listed["p"].to_pylist()))
        symbols, sizes, words = (np.frombuffer(b"".join(mine[c].to_pylist()), t) for c, t in (("symbols", "<u8"), ("sizes", "<u4"), ("words", "<u8")))
        before = np.split(words, np.cumsum(sizes)[:-1]) if len(sizes) else []
        key = table["context"].to_numpy().view(np.uint64)[0]
        found, levels, cut = subtree(before, symbols, parents, key, threshold, least)
        cut = cut and max(map(len, before), default=0) == window
        keys, a, b = zip(*(found or [(0, None, None)]))  # a row at least, for levels and cut
        return pa.table({"key": _longs(np.array(keys, np.uint64)), "a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "levels": pa.array([levels] * len(keys)), "cut": pa.array([cut] * len(keys))})

    found = texts.mapInArrow(occurrences, "context long, symbols binary, sizes binary, words binary")
    found = found.select("*", F.lit(None).cast("long").alias("symbol"), F.lit(None).cast("double").alias("p"))
    none = F.lit(None).cast("binary")
    listed = own.where("listed").select("context", none.alias("symbols"), none.alias("sizes"), none.alias("words"), "symbol", "p")
    return found.unionByName(listed).groupBy("context").applyInArrow(grow, "key long, a long, b long, levels long, cut boolean")


def _keys(table: DataFrame, make, *cols: str) -> DataFrame:
    """``table`` with ``key`` made by numpy of the long columns ``cols``, which come first."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key = make(*(b.column(k).to_numpy(zero_copy_only=False).view(np.uint64) for k in range(len(cols))))
            yield pa.RecordBatch.from_arrays([*b.columns, _longs(key)], [*b.schema.names, "key"])

    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in table.schema)
    return table.mapInArrow(add, f"{kind}, key long")


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the exchanges of finished levels now: their
    results are stored tables, but the driver's garbage collector, which
    tells it so, may not run for long."""
    gc.collect()
    try:
        spark._jvm.System.gc()
    except Exception:  # no JVM gateway (Spark Connect)
        pass


def drop(*tables: DataFrame) -> None:
    """Delete stored tables that nothing reads any more."""
    for t in tables:
        delete_paths(t.sparkSession, sorted({f.rpartition("/")[0] for f in t.inputFiles()}))


def train(texts: DataFrame, counts: DataFrame, total: int, distinct: int, min_context: float, min_string: float, cutoff: float, parts: int) -> tuple[DataFrame | None, int]:
    """Fit on the ``text`` column of ``texts``, whose word counts are
    ``counts``: the table (key, a, b) of the retained contexts, with C + d + 1
    and C - L + d + 1, and of their strings, with n(x) and 0, and the tree's depth."""
    spark = texts.sparkSession
    entries, depth = None, 0
    open_bits = spark.sparkContext.broadcast(bitmap(counts.where("c > 1").select("key")))
    wholes = counts.select(F.col("key").alias("w"), "c")
    # P of the strings one word shorter, under the tree so far
    shorter = counts.select(F.col("key").alias("symbol"), ((F.col("c") + 0.5) / (total + 0.5 * (distinct + 1))).alias("parent"))
    stale: list[DataFrame] = []  # tables that the next level reads last
    while total:
        depth += 1
        least = F.when(F.col("symbol") == WHOLE, 2.0).otherwise(max(2.0, min_string * total))
        found = string_counts(texts, depth, open_bits, parts).where(F.col("n") >= least)
        if depth > 2:
            found = materialize(found, f"strings_{depth}")
            wholes = found.where(F.col("symbol") == WHOLE).select(F.col("context").alias("w"), F.col("n").alias("c"))
        strings = found.where(F.col("symbol") != WHOLE)
        pair = [F.col("suffix").alias("pair")] if depth == 1 else []
        strings = materialize(strings.join(shorter, ["symbol"] if depth == 1 else ["suffix", "symbol"]).select("context", "symbol", "n", "parent", *pair), "parents")
        n, c = F.col("n").cast("double"), F.col("c").cast("double")
        sums = strings.groupBy("context").agg(
            F.sum("n").alias("l"), F.count(F.lit(1)).alias("d"), F.sum(n * F.log(n / F.col("parent"))).alias("a"), F.sum("parent").alias("b")
        )
        left, left_parent = 1 - F.col("l") / c, F.greatest(1 - F.col("b"), F.lit(1e-300))
        inner = (F.col("a") - F.col("l") * F.log(c)) / c + F.when(left > 1e-12, left * F.log(left / left_parent)).otherwise(0.0)
        wholes = wholes.where(F.col("c") >= max(2.0, min_context * total))
        needed = cutoff / 2 * (F.col("d") + 1) * float(np.log(max(total, 2)))
        kept = sums.join(wholes, F.col("context") == F.col("w")).where(c * inner >= needed)
        weight = (F.col("c") + F.col("d") + 1).cast("long")
        kept = materialize(kept.select(F.col("w"), weight.alias("weight"), (weight - F.col("l")).alias("others")), "retained")
        drop(*stale, *([found] if depth > 2 else []))
        stale = [strings, kept]
        if kept.isEmpty():
            if depth > 1:
                drop(*stale)
                break  # nothing extends a context that is not retained
            own = strings.select("context", "symbol", F.col("parent").alias("p"))
        else:
            own = strings.join(kept, F.col("context") == F.col("w"), "left" if depth == 1 else "inner")
            share = F.col("n") / F.col("weight") + F.col("others") / F.col("weight") * F.col("parent")
            own = own.select("context", "symbol", "n", F.coalesce(share, F.col("parent")).alias("p"), F.col("w").isNotNull().alias("listed"))
            own = materialize(own, f"level_{depth}")
            stale.append(own)
            states = _keys(kept.select(F.col("w").alias("context"), F.col("weight").alias("a"), F.col("others").alias("b")), rest_key, "context").select("key", "a", "b")
            listed = _keys(own.where("listed").select("context", "symbol", "n"), string_key, "context", "symbol")
            level = materialize(states.unionByName(listed.select("key", F.col("n").alias("a"), F.lit(0).cast("long").alias("b"))), f"entries_{depth}")
            entries = level if entries is None else entries.unionByName(level)
        if depth == 1:
            # the two-word contexts are the strings of one word and its symbol
            bits, wholes = bitmap(strings.select(F.col("pair").alias("key"))), strings.select(F.col("pair").alias("w"), F.col("n").alias("c"))
        else:
            bits = bitmap(kept.select(F.col("w").alias("key")))
        open_bits.unpersist()
        open_bits = spark.sparkContext.broadcast(bits)
        release(spark)
        rest_tokens = kept.agg(F.sum(F.col("weight"))).first()[0] if depth > 2 else None
        if rest_tokens is not None and rest_tokens <= LOCAL_TOKENS:
            # few occurrences are left: all deeper levels in one round, with longer windows if they are very few
            seen = max(2.0, min_context * total), max(2.0, min_string * total)
            window, price = WINDOW_WORDS * max(1, LOCAL_TOKENS // int(rest_tokens)), cutoff / 2 * float(np.log(max(total, 2)))
            while True:
                found = materialize(deep_levels(texts, own, kept, depth, price, window, seen), "deep_entries")
                levels, cut = found.agg(F.max("levels"), F.max("cut")).first()
                if not cut:
                    break
                drop(found)
                window *= 4
            drop(*stale)
            return entries.unionByName(found.where("a is not null").select("key", "a", "b")), depth + (levels or 0)
        shorter = own.select(F.col("context").alias("suffix"), "symbol", F.col("p").alias("parent"))
    return entries, depth


class Answers:
    """Entries by key: sorted, with the place where each range of keys begins, about one key a range."""

    def __init__(self, known: pa.Table):
        # one copy of each column at a time: the rows are as large as what is kept
        keys = [from_steps(x.as_buffer()) for x in known["keys"] if len(x.as_buffer())]
        rows = [k for k, x in enumerate(known["keys"]) if len(x.as_buffer())]
        order = sorted(range(len(rows)), key=lambda k: keys[k][0])
        self.keys = np.concatenate([np.zeros(0, np.uint64), *(keys[k] for k in order)])
        del keys
        self.a, self.b = (np.concatenate([np.zeros(0, np.int64), *(from_planes(known[c][rows[k]].as_buffer(), np.int64) for k in order)]) for c in ("a", "b"))
        if (self.keys[1:] <= self.keys[:-1]).any():  # a shard asked more than once
            self.keys, first = np.unique(self.keys, return_index=True)
            self.a, self.b = self.a[first], self.b[first]
        bits = max(1, len(self.keys).bit_length())
        self.shift = np.uint64(64 - bits)
        self.begin = np.zeros((1 << bits) + 1, np.int32)
        np.cumsum(np.bincount((self.keys >> self.shift).astype(np.int64), minlength=1 << bits), out=self.begin[1:])

    def of(self, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whether there is an entry, and its numbers or 0."""
        there, a, b = np.zeros(len(asked), bool), np.zeros(len(asked)), np.zeros(len(asked))
        part = (asked >> self.shift).astype(np.int64)
        at, end, todo = self.begin[part], self.begin[part + 1], np.arange(len(asked))
        while len(todo):
            inside = at < end
            at, end, todo = at[inside], end[inside], todo[inside]
            hit = self.keys[at] == asked[todo]
            there[todo[hit]], a[todo[hit]], b[todo[hit]] = True, self.a[at[hit]], self.b[at[hit]]
            at, end, todo = at[~hit] + 1, end[~hit], todo[~hit]
        return there, a, b


def score_texts(
    docs: DataFrame,
    learn: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_context: float = 0.0,
    min_string: float = 0.0,
    cutoff: float = 2.0,
    shards: int | None = None,
) -> DataFrame:
    """Learn from the rows where ``learn`` is true and score all rows:
    (doc_id, n_tokens, n_known, train_tokens, base_score, score)."""
    spark = docs.sparkSession
    small_batches(spark)
    size = docs.agg(F.sum(F.octet_length(F.col(text_col)))).first()[0] or 0
    shards = shards or max(1, -(-size // SHARD_BYTES))  # by bytes: a shard's texts and answers meet in one task
    parts = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")), size // PART_BYTES + 1)
    texts = docs.where(learn).select(F.col(text_col).alias("text"))
    counts = materialize(word_counts(texts, parts), "word_counts")
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    entries, depth = train(texts, counts, total, distinct, min_context, min_string, cutoff, parts)
    release(spark)
    table = counts.select("key", F.col("c").alias("a"), F.lit(0).cast("long").alias("b"))
    if entries is None:
        depth = 0
    else:
        table = table.unionByName(entries)
    bits = spark.sparkContext.broadcast(bitmap(entries) if depth else None)
    # rows without an id go by their text
    place = F.xxhash64(F.col(id_col), F.when(F.col(id_col).isNull(), F.col(text_col)))
    shard = F.pmod(place, F.lit(shards)).cast("int").alias("shard")
    dealt = docs.select(shard, F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).repartition(8 * shards, "shard")  # few shards of one task

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A shard's distinct keys, packed by range."""
        hasher, own, size = WordHashes(), {}, 0

        def compact() -> int:
            for k in own:
                own[k] = [np.unique(np.concatenate(own[k]))]
            return sum(len(x[0]) for x in own.values())

        def flush():
            compact()
            for k, (keys,) in own.items():
                edges = np.searchsorted(of_range(keys, parts), np.arange(parts + 1))
                for p in np.flatnonzero(np.diff(edges)):
                    found = steps(keys[edges[p] : edges[p + 1]])
                    yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([k], pa.int32()), pa.array([found], pa.binary())], ["part", "shard", "keys"])
            own.clear()

        for b in batches:
            by: dict[int, list] = {}
            for k, text in zip(b.column(0).to_pylist(), b.column(2).to_pylist()):
                by.setdefault(k, []).append(text)
            for k, texts in by.items():
                for part in slices(texts, SLICE):
                    ids, starts = hash_tokens(part, hasher)
                    asked = [ids]
                    for at, context, rest in states(ids, starts, depth, bits.value) if depth else ():
                        string = string_key(context, ids[at])
                        asked += [rest, string[has(bits.value, string)]]
                    keys = np.unique(np.concatenate(asked))
                    own.setdefault(k, []).append(keys)
                    size += len(keys)
                    if size > 12 * FLUSH_KEYS:
                        size = compact()
                    if size > 10 * FLUSH_KEYS:
                        yield from flush()
                        size = 0
        yield from flush()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The table's rows by range of their key."""

        def packed(found: list) -> Iterator[pa.RecordBatch]:
            key, a, b = (np.concatenate(x) for x in zip(*found))
            order = np.argsort(key)
            for p, blobs in blobs_by_part(of_range(key[order], parts), [x[order] for x in (key, a, b)]):
                yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), *(pa.array([x], pa.binary()) for x in blobs)], ["part", "keys", "a", "b"])

        found, size = [], 0
        for b in batches:
            found.append([b.column(k).to_numpy(zero_copy_only=False).view(np.uint64) for k in range(3)])
            size += len(found[-1][0])
            if size >= PACK_TOKENS:
                yield from packed(found)
                found, size = [], 0
        if size:
            yield from packed(found)

    def answer(asked: pa.Table, known: pa.Table) -> pa.Table:
        key, a, b = (np.frombuffer(b"".join(known[c].to_pylist()), np.uint64) for c in ("keys", "a", "b"))
        key, first = np.unique(key, return_index=True)  # a key may come twice
        a, b, out = a[first], b[first], []
        for k, data in zip(asked["shard"].to_pylist(), asked["keys"].to_pylist()):
            keys = from_steps(data)
            at = np.minimum(np.searchsorted(key, keys), max(len(key) - 1, 0))
            there = key[at] == keys if len(key) else np.zeros(len(keys), bool)
            at = at[there]
            out.append((k, steps(keys[there]), planes(a[at]).tobytes(), planes(b[at]).tobytes()))
        names = ("shard", "keys", "a", "b")
        return pa.table([pa.array(x, kind) for x, kind in zip(zip(*out) if out else [()] * 4, (pa.int32(), *[pa.binary()] * 3))], names=names)

    # all columns, so that Spark deals the texts once and reads that exchange twice
    asked = dealt.mapInArrow(ask, "part int, shard int, keys binary")
    table = table.mapInArrow(pack, "part int, keys binary, a binary, b binary")
    answers = asked.groupBy("part").cogroup(table.groupBy("part")).applyInArrow(answer, "shard int, keys binary, a binary, b binary")

    def score(texts: pa.Table, known: pa.Table) -> pa.Table:
        hasher, index = WordHashes(), Answers(known)
        out: list = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)], [np.zeros(0)]]
        for part in slices(texts["text"].to_pylist(), SLICE):
            ids, starts = hash_tokens(part, hasher)
            seen, c, _ = index.of(ids)
            root = (c + 0.5) / (total + 0.5 * (distinct + 1))
            p = root.copy()
            for at, context, key in states(ids, starts, depth, bits.value) if depth else ():
                there, weight, others = index.of(key)
                at, weight, others = at[there], weight[there], others[there]
                string = string_key(context[there], ids[at])
                held = has(bits.value, string)
                n = np.zeros(len(at))
                n[held] = index.of(string[held])[1]
                p[at] = n / weight + others / weight * p[at]
            out[0].append(np.diff(np.append(starts, len(ids))))
            out[1].append(np.add.reduceat(seen.astype(np.int64), starts))
            out[2].append(np.add.reduceat(np.log10(root), starts))
            out[3].append(np.add.reduceat(np.log10(p), starts))
        n, seen, base, full = (np.concatenate(x) for x in out)
        return pa.table(
            {
                "doc_id": texts["doc_id"], "n_tokens": pa.array(n, pa.int64()), "n_known": pa.array(seen, pa.int64()),
                "train_tokens": pa.array(np.full(len(n), total, np.int64)), "base_score": pa.array(base), "score": pa.array(full),
            }
        )

    kind = f"doc_id {docs.schema[id_col].dataType.simpleString()}, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return dealt.groupBy("shard").cogroup(answers.groupBy("shard")).applyInArrow(score, kind)
