"""Line dedup over a sharded minimal perfect hash (operator 9).

1. Every text is cut at ``\\n``; a line's key is the line stripped of
   ``[\\x20\\x09-\\x0D]`` at both ends with A-Z lower-cased. Keys of at least
   ``min_chars`` code points are hashed to 128 bits, once per row.
2. A keyed aggregate with map-side combine counts each distinct hash and finds the
   least doc_id that holds it. Hashes are dealt to shards of a fixed
   expected size, so the number of shards grows with the data.
3. One task per shard builds a minimal perfect hash (levels of bit arrays,
   Limasset et al. 2017) and stores a 32-bit fingerprint, a count and an
   owner per slot, in arrays.
4. Documents send (hash, doc_id) probes to the shards and look them up in
   the arrays; no line text is joined or shuffled. A shard that popular lines
   make hot is copied to several tasks in proportion to its probes.
5. What a document must drop comes back as one short list, and the text is
   rewritten in place.

Rows that share a doc_id are one document. A row without a doc_id drops no
line and owns none. A null or empty text is one empty line. The 128-bit hash
stands for the line: two of n distinct lines share one with probability below
n^2 / 2^129.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from startlens.llm.text import LOWER, small_batches
from startlens.session import materialize

_STRIP = b" \t\n\x0b\x0c\r"
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def line_key(line: str) -> bytes:
    return line.encode().strip(_STRIP).translate(LOWER)


def line_hashes(text: str | None, min_chars: int) -> list[bytes | None]:
    """Per line, the 16-byte hash of its key, or None for a short key."""
    out = []
    for line in (text or "").split("\n"):
        if len(line) < min_chars:
            out.append(None)
            continue
        key = line_key(line)
        # at most len(key) code points; count them only where bytes and characters may differ
        short = len(key) < min_chars or (not key.isascii() and len(key.decode()) < min_chars)
        out.append(None if short else xxhash.xxh3_128_digest(key))
    return out


# ---- minimal perfect hash -------------------------------------------------


def _mix(keys: np.ndarray, level: int) -> np.ndarray:
    """64-bit mix of the two halves of 128-bit keys with a level seed."""
    h = keys[:, 0] ^ (keys[:, 1] * np.uint64(2 * level + 1)) ^ np.uint64((level + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    h ^= h >> np.uint64(33)
    h *= _M1
    h ^= h >> np.uint64(33)
    h *= _M2
    return h ^ (h >> np.uint64(33))


def build_mph(keys: np.ndarray, gamma: float = 2.0, max_levels: int = 64) -> list[np.ndarray]:
    """Bit arrays, one per level, over distinct 128-bit ``keys`` (n x 2 uint64).

    A key is placed at the first level where no other remaining key shares
    its position; its slot is the number of set bits before that position.
    """
    levels, rest = [], keys
    while len(rest):
        if len(levels) == max_levels:
            raise ValueError("keys of a minimal perfect hash must be distinct")
        size = max(64, int(gamma * len(rest)))
        at = (_mix(rest, len(levels)) % np.uint64(size)).astype(np.int64)
        alone = np.bincount(at, minlength=size) == 1
        levels.append(alone)
        rest = rest[~alone[at]]
    return levels


def probe_mph(levels: list[np.ndarray], keys: np.ndarray) -> np.ndarray:
    """Slot of each key, -1 where no level holds it (such a key is no member)."""
    slot = np.full(len(keys), -1, np.int64)
    todo, before = np.arange(len(keys)), 0
    for k, bits in enumerate(levels):
        if not len(todo):
            break
        at = (_mix(keys[todo], k) % np.uint64(len(bits))).astype(np.int64)
        rank = np.cumsum(bits) - bits + before
        hit = bits[at]
        slot[todo[hit]] = rank[at[hit]]
        todo, before = todo[~hit], before + int(bits.sum())
    return slot


def _keys(col) -> np.ndarray:
    """16-byte hashes of an Arrow binary column as n x 2 uint64."""
    raw = b"".join(col.to_pylist())
    return np.frombuffer(raw, "<u8").reshape(-1, 2)


# ---- the operator ---------------------------------------------------------


def shared_lines(docs: DataFrame, id_col: str, text_col: str, min_chars: int, shard_keys: int) -> DataFrame:
    """(doc, drop array<binary>): hashes of the lines that a document must
    lose, one row for every document that loses any."""

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, hs = [], []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                own = {h for h in line_hashes(text, min_chars) if h}
                hs += own
                ids += [doc] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(hs, pa.binary())], ["doc", "h"])

    small_batches(docs.sparkSession)
    lines = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    lines = materialize(lines.where(F.col("doc").isNotNull()).mapInArrow(hashes, "doc long, h binary"), "lines")
    distinct = materialize(
        lines.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("doc").alias("owner"), F.max("doc").alias("last")), "line_counts"
    )
    n_shards = max(1, -(-distinct.count() // shard_keys))
    shard = F.pmod(F.xxhash64("h"), F.lit(n_shards)).cast("int").alias("shard")

    def build(table: pa.Table) -> pa.Table:
        keys = _keys(table["h"])
        levels = build_mph(keys)
        slot = probe_mph(levels, keys)
        finger, count, owner = (np.zeros(len(keys), t) for t in ("<u4", "<u4", "<i8"))
        finger[slot] = keys[:, 1] & np.uint64(0xFFFFFFFF)
        n, least, last = (table[c].to_numpy() for c in ("n", "owner", "last"))
        count[slot] = np.where(least == last, 1, np.minimum(n, 0xFFFFFFFF))  # 1: a single document holds it
        owner[slot] = least
        sizes = np.array([len(x) for x in levels], "<i8")
        bits = np.packbits(np.concatenate(levels)) if levels else np.zeros(0, "u1")
        return pa.table(
            {
                "shard": pa.array([table["shard"][0].as_py()], pa.int32()),
                "probes": pa.array([int(n.sum())], pa.int64()),
                "arrays": pa.array([[x.tobytes() for x in (sizes, bits, finger, count, owner)]], pa.list_(pa.binary())),
            }
        )

    index = materialize(
        distinct.select(shard, "h", "n", "owner", "last").groupBy("shard").applyInArrow(build, "shard int, probes long, arrays array<binary>"),
        "line_index",
    )
    # one task serves about twice the even number of probes; hotter shards are copied
    copies = F.greatest(F.lit(1), F.ceil(F.col("probes") / F.lit(4 * shard_keys))).cast("int")
    parts = index.select("shard", "arrays", F.explode(F.sequence(F.lit(0), copies - 1)).alias("part"))
    probes = lines.select(shard, "doc", "h").join(index.select("shard", copies.alias("copies")), "shard")
    probes = probes.select("shard", F.pmod(F.xxhash64("doc"), F.col("copies")).cast("int").alias("part"), "doc", "h")

    def probe(asked: pa.Table, stored: pa.Table) -> pa.Table:
        if not asked.num_rows:
            return pa.table({"doc": pa.array([], pa.int64()), "h": pa.array([], pa.binary())})
        sizes, bits, finger, count, owner = stored["arrays"][0].as_py()
        sizes = np.frombuffer(sizes, "<i8")
        flat = np.unpackbits(np.frombuffer(bits, "u1"), count=int(sizes.sum())).astype(bool)
        levels = np.split(flat, np.cumsum(sizes)[:-1])
        keys = _keys(asked["h"])
        slot = probe_mph(levels, keys)
        if not np.array_equal(np.frombuffer(finger, "<u4")[slot], (keys[:, 1] & np.uint64(0xFFFFFFFF)).astype("<u4")):
            raise ValueError("a probed line is not in its shard")
        drop = (np.frombuffer(count, "<u4")[slot] > 1) & (np.frombuffer(owner, "<i8")[slot] != asked["doc"].to_numpy())
        return asked.filter(pa.array(drop)).select(["doc", "h"])

    found = probes.groupBy("shard", "part").cogroup(parts.groupBy("shard", "part")).applyInArrow(probe, "doc long, h binary")
    return found.groupBy("doc").agg(F.collect_set("h").alias("drop"))


def dedup_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, shard_keys: int = 100_000, prefix: str = ""
) -> DataFrame:
    """``docs`` with ``kept_text``, ``n_lines`` and ``n_dropped`` (after ``prefix``).

    A key found in two documents or more stays only in the least doc_id that
    holds it (with all its lines there). ``kept_text`` is null for a null
    text and empty if every line goes. Other columns pass through, whatever
    their names; columns of ``docs`` by these three names are replaced.
    """
    drops = shared_lines(docs, id_col, text_col, min_chars, shard_keys)

    @F.arrow_udf("struct<kept:string,n_lines:long,n_dropped:long>")
    def rewrite(texts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for text, drop in texts:
            out = []
            for t, d in zip(text.to_pylist(), drop.to_pylist()):
                ls = (t or "").split("\n")
                if not d:
                    out.append((t, len(ls), 0))
                    continue
                gone = set(d)
                kept = [x for x, h in zip(ls, line_hashes(t, min_chars)) if h not in gone]
                out.append(("\n".join(kept), len(ls), len(ls) - len(kept)))
            kept, n, m = zip(*out) if out else ((), (), ())
            yield pa.StructArray.from_arrays(
                [pa.array(kept, pa.string()), pa.array(n, pa.int64()), pa.array(m, pa.int64())], ["kept", "n_lines", "n_dropped"]
            )

    names = [prefix + c for c in ("kept_text", "n_lines", "n_dropped")]
    # the user's columns go as one struct, so that none has the name of one made here
    kept = [c for c in docs.columns if c.lower() not in [n.lower() for n in names] or c in (id_col, text_col)]
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.col(f"`{id_col}`").alias("id"))
    joined = own.join(drops.hint("shuffle_hash"), F.col("id") == F.col("doc"), "left")
    joined = joined.select("row", rewrite(F.col("row").getField(text_col), F.col("drop")).alias("r"))
    return joined.select(
        *[F.col("row").getField(c).alias(c) for c in kept if c not in names],
        *[F.col(f"r.{c}").alias(name) for c, name in zip(("kept", "n_lines", "n_dropped"), names)],
    )


def kept_digest(text: str | None) -> str:
    return hashlib.sha256((text or "").encode()).hexdigest()
