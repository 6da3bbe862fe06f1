"""MinHash near-dedup by an inverted join on signature coordinates (operator 4).

1. Each text's set of distinct ``width``-word shingles gets a signature of
   ``coords`` minima under independent 64-bit hashes. Rows with the same word
   sequence form one class, which has a number of its own.
2. Classes are posted under each (coordinate, value) pair; a keyed count
   with map-side combine gives every pair's frequency. Two sets that agree
   in ``threshold`` of the coordinates share one of the ``coords -
   threshold + 1`` rarest pairs of both (prefix filter), and pairs that one
   class alone has are skipped: they take places in the prefix but are never
   posted. Classes with fewer than ``threshold`` shared pairs go at once.
3. Posting lists of at most ``long_list`` classes give candidate pairs whose
   sizes allow the similarity; their collisions are counted over the whole
   signatures (the skipped, frequent pairs included) and kept from
   ``threshold`` on. Links are confirmed on the full shingle sets.
4. Longer lists never give all pairs. Each class is first held against the
   list's least class; the links found so far join into components, and a
   list that is one component is settled. In the others only classes of
   different components are compared, in blocks of ``block`` classes, each
   pair in the first list it shares, and a block returns one link per class
   and component.
5. Components come from the distributed star algorithm in :mod:`graph`.

The links asked for have ``100 * intersection >= min_percent * union``. With
64 coordinates and a threshold of 32, a pair at similarity 0.8 fails the
match threshold with probability 1.3e-8, one above it with less; this is
the method's only chance of losing a link, and no list or group is capped.
Sets are compared by 64-bit shingle hashes.

A null or empty text, or one without words, has an empty set and links with
nothing. Rows that share a doc_id are one document: all links of their texts
are its own, and they get one component. A row without a doc_id (or with one
that is no whole number) links with nothing and is kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from startlens.llm.graph import connected_components, least_ids, same_id_links
from startlens.llm.text import small_batches, words
from startlens.session import materialize

_MUL = np.uint64(0xFF51AFD7ED558CCD)
CACHE_WORDS = 300_000


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MUL
    return h ^ (h >> np.uint64(29))


def shingle_hashes(ws: list[bytes], width: int, cache: dict[bytes, int]) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a word list."""
    if not ws:
        return np.zeros(0, np.uint64)
    if len(cache) > CACHE_WORDS:
        cache.clear()
    for w in ws:
        if w not in cache:
            cache[w] = xxhash.xxh3_64_intdigest(w)
    h = np.fromiter(map(cache.__getitem__, ws), np.uint64, len(ws))
    width = min(width, len(ws))
    out = _mix(h[: len(h) - width + 1] + np.uint64(width))
    for k in range(1, width):
        out = _mix(out + h[k : len(h) - width + 1 + k])
    return np.unique(out)


def hash_family(coords: int) -> tuple[np.ndarray, np.ndarray]:
    """Fixed odd multipliers and masks, one pair per coordinate."""
    rng = np.random.default_rng(20240229)
    draw = rng.integers(0, 2**64, (2, coords), dtype=np.uint64)
    return draw[0] | np.uint64(1), draw[1]


def signature(hashes: np.ndarray, mul: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Minimum of each hash of the family over a non-empty set."""
    out = np.full(len(mul), np.iinfo(np.uint64).max, np.uint64)
    for lo in range(0, len(hashes), 4096):
        part = (hashes[None, lo : lo + 4096] ^ mask[:, None]) * mul[:, None]
        np.minimum(out, part.min(axis=1), out=out)
    return out


def _sets(docs: DataFrame, width: int, mul: np.ndarray | None, mask: np.ndarray | None) -> DataFrame:
    """(doc, n, key, data): the set's size, the class key, and the signature
    (with a hash family) or the sorted shingle hashes."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[bytes, int] = {}
        for b in batches:
            n, keys, data = [], [], []
            for text in b.column(1).to_pylist():
                ws = words(text)
                s = shingle_hashes(ws, width, cache)
                n.append(len(s))
                keys.append(xxhash.xxh3_128_digest(b" ".join(ws)))
                data.append((s if mul is None else signature(s, mul, mask)).tobytes() if len(s) else b"")
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(data, pa.binary())], ["doc", "n", "key", "data"]
            )

    return docs.mapInArrow(make, "doc long, n long, key binary, data binary")


@F.arrow_udf(T.IntegerType())
def _collisions(a: pa.Array, b: pa.Array) -> pa.Array:
    x, y = (np.frombuffer(b"".join(c.to_pylist()), np.uint64).reshape(len(c), -1) for c in (a, b))
    return pa.array((x == y).sum(axis=1) if len(x) else np.zeros(0), pa.int32())


@F.arrow_udf(T.LongType())
def _common(a: pa.Array, b: pa.Array) -> pa.Array:
    out = []
    for x, y in zip(a.to_pylist(), b.to_pylist()):
        out.append(len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True)))
    return pa.array(out, pa.int64())


def _size_ok(a: str, b: str, min_percent: int):
    return F.least(a, b) * 100 >= F.greatest(a, b) * min_percent


def _with_both(pairs: DataFrame, table: DataFrame, col: str) -> DataFrame:
    """``pairs`` (a, b, ...) with ``col`` of both ends as x and y."""
    left = pairs.join(table.select(F.col("doc").alias("a"), F.col(col).alias("x")), "a")
    return left.join(table.select(F.col("doc").alias("b"), F.col(col).alias("y")), "b")


def _confirmed(pairs: DataFrame, sets: DataFrame, min_percent: int) -> DataFrame:
    """Links (a, b) among candidate pairs (a, b, na, nb), on the full sets."""
    both = _with_both(pairs, sets, "set").withColumn("common", _common("x", "y"))
    return both.where(F.col("common") * 100 >= min_percent * (F.col("na") + F.col("nb") - F.col("common"))).select("a", "b")


def _incidence(columns: np.ndarray, lists: list[np.ndarray]) -> np.ndarray:
    """0/1 matrix: which of the sorted ``columns`` each list holds."""
    out = np.zeros((len(lists), len(columns)), np.float32)
    for k, x in enumerate(lists):
        at = np.searchsorted(columns, x)
        at[at == len(columns)] = 0
        out[k, at[columns[at] == x] if len(columns) else []] = 1
    return out


def _overlaps(rows: list[np.ndarray], cols: list[np.ndarray], step: int = 2048) -> np.ndarray:
    """Sizes of the intersections of all row sets with all column sets."""
    out = np.zeros((len(rows), len(cols)), np.float32)
    if not rows or not cols:
        return out
    both = np.intersect1d(np.unique(np.concatenate(rows)), np.unique(np.concatenate(cols)), assume_unique=True)
    for lo in range(0, len(both), step):
        part = both[lo : lo + step]
        out += _incidence(part, rows) @ _incidence(part, cols).T
    return out


def block_links(table: pa.Table, token: int, min_percent: int) -> list[tuple[int, int]]:
    """Links between classes of different components in one pair of blocks:
    one per class and component, for pairs that share no earlier list."""
    doc, n, comp, side = (table[c].to_numpy() for c in ("doc", "n", "comp", "side"))
    sets = [np.frombuffer(x, np.uint64) for x in table["set"].to_pylist()]
    earlier = []
    for own in table["lists"].to_pylist():
        earlier.append(np.unique(np.array(own[: own.index(token)], np.int64)))
    left, right = np.flatnonzero(side <= 0), np.flatnonzero(side >= 0)
    values, counts = np.unique(comp, return_counts=True)
    main = values[counts.argmax()]
    out = {}
    for rows, cols in ((left[comp[left] != main], right), (left[comp[left] == main], right[comp[right] != main])):
        if not len(rows) or not len(cols):
            continue
        small, large = np.minimum(n[rows][:, None], n[cols]), np.maximum(n[rows][:, None], n[cols])
        open_ = (comp[rows][:, None] != comp[cols]) & (small * 100 >= large * min_percent)
        open_ &= _overlaps([earlier[k] for k in rows], [earlier[k] for k in cols]) == 0
        r, c = np.flatnonzero(open_.any(axis=1)), np.flatnonzero(open_.any(axis=0))
        common = _overlaps([sets[k] for k in rows[r]], [sets[k] for k in cols[c]]).astype(np.int64)
        total = n[rows[r]][:, None] + n[cols[c]] - common
        for i, j in np.argwhere(open_[np.ix_(r, c)] & (100 * common >= min_percent * total)):
            x, y = rows[r[i]], cols[c[j]]
            out.setdefault((int(doc[x]), int(comp[y])), int(doc[y]))
    return [(x, y) for (x, _), y in out.items()]


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 5,
    min_percent: int = 80,
    coords: int = 64,
    threshold: int = 32,
    long_list: int = 64,
    block: int = 1024,
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row per row of ``docs``."""
    small_batches(docs.sparkSession)
    mul, mask = hash_family(coords)
    texts = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    base = materialize(_sets(texts, width, mul, mask), "signatures")
    linkable = base.where(F.col("doc").isNotNull() & (F.col("n") > 0))
    classes = linkable.groupBy("key").agg(F.min("doc").alias("rep"))
    # ids can repeat on other texts, so a class goes by a number; the table is stored, which fixes the numbers
    classes = materialize(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    reps = linkable.withColumnRenamed("doc", "own").join(classes.withColumnRenamed("key", "k"), (F.col("key") == F.col("k")) & (F.col("own") == F.col("rep")))
    reps = materialize(reps.select(F.col("node").alias("doc"), "rep", "n", "key", "data").dropDuplicates(["doc"]), "representatives")
    members = linkable.select(F.col("doc").alias("id"), F.col("key").alias("k")).join(classes.select("key", "node"), F.col("k") == F.col("key"))
    members = materialize(members.select("id", "node").distinct(), "members")

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint64).reshape(-1, coords)
            tokens = (values ^ mask[::-1]).view(np.int64).ravel()  # a value in another coordinate is another token
            doc = np.repeat(b.column(0).to_numpy(), coords)
            for lo in range(0, len(doc), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(tokens[lo : lo + (1 << 16)]), pa.array(doc[lo : lo + (1 << 16)])], ["token", "doc"])

    posts = reps.select("doc", "data").mapInArrow(post, "token long, doc long")
    shared = posts.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    own = posts.join(shared, "token").groupBy("doc").agg(F.collect_list(F.struct("df", "token")).alias("own"))
    # the prefix: the rarest coords - threshold + 1 pairs, of which (coords - size) are the class's alone
    alone = F.lit(coords) - F.size("own")
    prefix = own.where(F.size("own") >= threshold).select(
        "doc", F.explode(F.slice(F.array_sort("own"), 1, F.greatest(F.lit(0), F.lit(coords - threshold + 1) - alone))).alias("p")
    )
    prefix = prefix.select("doc", F.col("p.token").alias("token"))
    prefix = prefix.join(reps.select("doc", "n"), "doc")
    prefix = materialize(prefix, "prefixes")
    lists = prefix.groupBy("token").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("doc", "n")).alias("least")).where("c > 1")
    lists = materialize(prefix.join(lists, "token"), "lists")
    short, long_ = lists.where(F.col("c") <= long_list), lists.where(F.col("c") > long_list)

    a = short.select("token", F.col("doc").alias("a"), F.col("n").alias("na"))
    b = short.select("token", F.col("doc").alias("b"), F.col("n").alias("nb"))
    pairs = a.join(b, "token").where((F.col("a") < F.col("b")) & _size_ok("na", "nb", min_percent)).select("a", "b", "na", "nb").distinct()
    led = long_.select(F.col("least.doc").alias("a"), F.col("doc").alias("b"), F.col("least.n").alias("na"), F.col("n").alias("nb"))
    led = led.where((F.col("a") < F.col("b")) & _size_ok("na", "nb", min_percent)).distinct()
    pairs = _with_both(pairs.unionByName(led).distinct(), reps, "data").withColumn("same", _collisions("x", "y"))
    pairs = materialize(pairs.where(F.col("same") >= threshold).select("a", "b", "na", "nb"), "candidates")

    asked = pairs.select(F.col("a").alias("w")).unionByName(pairs.select(F.col("b").alias("w"))).unionByName(long_.select(F.col("doc").alias("w")))
    asked = asked.distinct().join(reps.select(F.col("doc").alias("w"), "rep"), "w").select("rep").distinct().hint("shuffle_hash")
    wanted = texts.join(asked, F.col("doc") == F.col("rep"))
    sets = _sets(wanted.select("doc", "text"), width, None, None).select(F.col("doc").alias("own"), F.col("key").alias("k"), F.col("data").alias("set"))
    sets = sets.join(reps.select("doc", "rep", "key"), (F.col("own") == F.col("rep")) & (F.col("k") == F.col("key")))
    sets = materialize(sets.select("doc", "set").dropDuplicates(["doc"]), "sets")
    links = materialize(_confirmed(pairs, sets, min_percent).unionByName(same_id_links(members)), "links")
    comps = connected_components(links)

    if not long_.isEmpty():
        named = long_.join(comps.withColumnRenamed("node", "doc"), "doc", "left").withColumn("comp", F.coalesce("component", "doc"))
        open_ = named.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("token")
        named = materialize(named.join(open_, "token").select("token", "doc", "n", "c", "comp"), "open_lists")
        order = named.groupBy("doc").agg(F.transform(F.array_sort(F.collect_list(F.struct("c", "token"))), lambda s: s["token"]).alias("lists"))
        full = named.join(order, "doc").join(sets, "doc")
        blocks = F.ceil(F.col("c") / F.lit(block)).cast("int")
        full = full.withColumn("own", F.pmod(F.xxhash64("doc"), blocks).cast("int"))
        full = full.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        full = full.select(
            "token", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
            F.signum(F.col("own") - F.col("other")).cast("int").alias("side"), "doc", "n", "comp", "lists", "set",
        )

        def compare(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
            found = block_links(table, key[0].as_py(), min_percent)
            return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

        more = materialize(full.groupBy("token", "i", "j").applyInArrow(compare, "a long, b long"), "links")
        if not more.isEmpty():
            comps = connected_components(links.unionByName(more))

    out = base.select("doc", "n").join(least_ids(members, comps), F.col("doc") == F.col("id"), "left")
    component = F.coalesce("component_id", "doc")
    return out.select(
        F.col("doc").alias("doc_id"),
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.coalesce(F.col("doc") == component, F.lit(True)).alias("kept"),
    )
