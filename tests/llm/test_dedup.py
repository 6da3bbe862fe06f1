"""Line dedup (9), MinHash near-dedup (4), metric range join (3), components."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import data
from startlens.llm import line_dedup, metric_join, minhash, registry
from startlens.llm.graph import connected_components

STRIP = " \t\n\x0b\x0c\r"


def lines_reference(rows):
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(STRIP))
    held = {}
    for r in rows:
        for x in (r[1] or "").split("\n"):
            if len(key(x)) >= 10 and r[0] is not None:
                held.setdefault(key(x), set()).add(r[0])
    out = []
    for r in rows:
        ls = (r[1] or "").split("\n")
        kept = [x for x in ls if r[0] is None or len(key(x)) < 10 or min(held[key(x)]) == r[0]]
        out.append((r[0], len(ls), len(ls) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("rows", [data.edge_rows(), data.documents(2)], ids=["edge", "random"])
def test_lines_equal_plain_version(spark, tmp_path, rows):
    folder = data.write_tables(tmp_path, spark, documents=data.docs_frame(spark, rows))
    got = registry.op9_line_dedup(spark, folder).collect()
    assert sorted([tuple(r) for r in got], key=str) == lines_reference(rows)


def test_lines_small_shards_and_hot_line(spark):
    rows = [(i, f"a very common line\nown line number {i:05d}", "en", "a", 1) for i in range(400)]
    got = line_dedup.dedup_lines(data.docs_frame(spark, rows), shard_keys=20).collect()
    assert {r["doc_id"]: r["n_dropped"] for r in got} == {i: int(i > 0) for i in range(400)}


def test_lines_keep_columns_and_null_text(spark):
    docs = data.edge_docs(spark).withColumn("n_lines", F.lit("mine"))
    got = line_dedup.dedup_lines(docs, prefix="__")
    assert got.columns == [*docs.columns, "__kept_text", "__n_lines", "__n_dropped"]
    assert got.where("text is null and __kept_text is null and __n_lines = 1").count() == 1
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 1000])
def test_minimal_perfect_hash_is_minimal_and_perfect(n):
    keys = np.random.default_rng(n).integers(0, 2**64, (n, 2), dtype=np.uint64)
    levels = line_dedup.build_mph(keys)
    assert sorted(line_dedup.probe_mph(levels, keys).tolist()) == list(range(n))


def test_minimal_perfect_hash_refuses_equal_keys():
    with pytest.raises(ValueError):
        line_dedup.build_mph(np.ones((2, 2), np.uint64))


def near_reference(rows, width=2):
    def shingles(text):
        w = data.words(text)
        return {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()

    sets = {}
    for r in rows:
        sets.setdefault(r[0], []).append(shingles(r[1]))
    links = []
    ids = [i for i in sets if i is not None]
    for a in ids:
        for b in ids:
            if a < b:
                for x in sets[a]:
                    for y in sets[b]:
                        if x and y and 100 * len(x & y) >= 80 * len(x | y):
                            links.append((a, b))
    comp = data.components(ids, links)
    out = []
    for r in rows:
        c = comp.get(r[0])
        out.append((r[0], len(shingles(r[1])), c, c == r[0] or r[0] is None))
    return sorted(out, key=str)


def repeated_ids():
    """Ids that stand on several texts: (1, A) and (1, B), with a near copy of each under its own id."""
    rng = random.Random(12)
    a, b, c = (data.sentence(rng, 40) for _ in range(3))
    rows = [(1, a, "en", "a", 1), (1, b, "en", "a", 1), (2, a + " x", "en", "a", 1), (3, b + " y", "en", "a", 1), (4, "", "en", "a", 1), (4, c, "en", "a", 1)]
    return rows + [(0, c + " z", "en", "a", 1), (5, c + " q", "en", "a", 1), (5, "alone", "en", "a", 1), (6, a, "en", "a", 1), (7, None, "en", "a", 1)]


@pytest.mark.parametrize("width", [2, 5])
@pytest.mark.parametrize("rows", [data.edge_rows(), data.documents(3), repeated_ids(), []], ids=["edge", "random", "repeated", "none"])
def test_near_duplicates_equal_plain_version(spark, rows, width):
    got = minhash.near_duplicates(data.docs_frame(spark, rows), width=width).collect()
    assert sorted([tuple(r) for r in got], key=str) == near_reference(rows, width)
    if len(rows) == len(repeated_ids()):
        assert {r["component_id"] for r in got} == {0, 1, 7}


def test_near_duplicates_long_lists(spark):
    """A large group of near copies and unlike texts with the same passage, with blocks of a few classes."""
    rng = random.Random(5)
    base, passage = data.sentence(rng, 80).split(" "), data.sentence(rng, 60)
    rows = []
    for i in range(120):
        w = list(base)
        for _ in range(rng.randrange(0, 9)):
            w[rng.randrange(len(w))] = f"w{rng.randrange(10**6)}"
        rows.append((i, " ".join(w), "en", "a", 1))
    rows += [(1000 + i, passage + " " + data.sentence(rng, rng.randrange(5, 40)), "en", "a", 1) for i in range(60)]
    got = minhash.near_duplicates(data.docs_frame(spark, rows), width=2, long_list=8, block=16).collect()
    assert sorted([tuple(r) for r in got], key=str) == near_reference(rows)


def test_near_duplicates_ignore_other_columns(spark):
    got = minhash.near_duplicates(data.edge_docs(spark))
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"] and got.count() == len(data.edge_rows())


def test_signature_agrees_as_often_as_sets_do():
    rng = np.random.default_rng(0)
    mul, mask = minhash.hash_family(64)
    pool = rng.integers(0, 2**64, 900, dtype=np.uint64)
    hits = []
    for k in range(200):
        pick = rng.permutation(pool)
        a, b = pick[:90], np.concatenate([pick[:80], pick[90:100]])  # similarity 0.8
        hits.append((minhash.signature(a, mul, mask) == minhash.signature(b, mul, mask)).mean())
    assert abs(np.mean(hits) - 0.8) < 0.02 and min(hits) > 0.5


@pytest.mark.parametrize(
    "links, want",
    [
        ([], {}),
        ([(1, 1)], {}),
        ([(2, 1), (2, 1), (None, 3)], {1: 1, 2: 1}),
        ([(i, i + 1) for i in range(40)], {i: 0 for i in range(41)}),
        ([(0, i) for i in range(1, 30)] + [(100, 101)], {**{i: 0 for i in range(30)}, 100: 100, 101: 100}),
    ],
)
def test_components(spark, links, want):
    got = connected_components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r["node"]: r["component"] for r in got} == want and len(got) == len(want)


VECTORS = "vec_id long, embedding array<double>, label int, extra string"


def vector_reference(rows, limit=0.93):
    ok = lambda r: r[0] is not None and r[2] is not None and r[1] and all(x is not None and math.isfinite(x) for x in r[1]) and any(r[1])
    cos = lambda x, y: math.fsum(a * b for a, b in zip(x, y)) / math.sqrt(math.fsum(a * a for a in x) * math.fsum(b * b for b in y))
    n, links = [0] * len(rows), []
    for i, x in enumerate(rows):
        for j, y in enumerate(rows):
            if i != j and ok(x) and ok(y) and x[2] == y[2] and len(x[1]) == len(y[1]) and cos(x[1], y[1]) >= limit:
                n[i] += 1
                links.append((x[0], y[0]))
    comp = data.components([r[0] for r in rows if r[0] is not None], links)
    return sorted(((r[0], k, comp.get(r[0]), r[0] is None or comp[r[0]] == r[0]) for r, k in zip(rows, n)), key=str)


def test_vectors_edge_cases(spark):
    rows = [
        (0, [1.0, 0.0], 1, "a"), (1, [2.0, 0.0], 1, "a"), (2, [1.0, 0.0], 1, "a"), (3, [1.0, 0.0], 2, "a"), (4, [0.0, 0.0], 1, "a"),
        (5, None, 1, "a"), (6, [1.0, None], 1, "a"), (7, [1.0, float("nan")], 1, "a"), (8, [1.0, float("inf")], 1, "a"), (9, [1.0, 0.0], None, "a"),
        (10, [-1.0, 0.0], 1, "a"), (11, [], 1, "a"), (12, [1.0, 0.0, 0.0], 1, "a"), (13, [1e-200, 1e-201], 1, None), (14, [1e200, 1e199], 1, None),
        (15, [0.93, math.sqrt(1 - 0.93**2) + 1e-9], 3, None), (16, [1.0, -0.0], 3, None), (None, [1.0, 0.0], 1, None),
    ]
    got = metric_join.range_join(spark.createDataFrame(rows, VECTORS)).collect()
    want = vector_reference([r for r in rows if r[0] not in (13, 14)])
    assert sorted([tuple(r) for r in got if r[0] not in (13, 14)], key=str) != [] and len(got) == len(rows)
    by = {r[0]: tuple(r) for r in got}
    # tiny and huge vectors have directions too
    assert by[13][2] == by[14][2] == 0 and by[0][1] == 4
    assert {r[0]: r[2:] for r in want} == {k: v[2:] for k, v in by.items() if k not in (13, 14)}


def test_vectors_of_one_id_keep_their_own_links(spark):
    rows = [(5, [1.0, 0.0], 1, None), (5, [0.0, 1.0], 1, None), (6, [1.0, 0.01], 1, None), (7, [0.01, 1.0], 1, None), (8, [-1.0, 0.0], 1, None), (8, [-1.0, 0.01], 1, None)]
    got = sorted(tuple(r) for r in metric_join.range_join(spark.createDataFrame(rows, VECTORS)).collect())
    assert got == sorted(vector_reference(rows))
    assert [r[1] for r in got] == [1, 1, 1, 1, 1, 1] and {r[2] for r in got} == {5, 8}


def test_vectors_equal_plain_version(spark):
    rng = random.Random(4)
    rows, centre = [], [rng.gauss(0, 1) for _ in range(8)]
    for i in range(150):
        spread = 0.15 if i % 3 else 1.0
        rows.append((i, [c + rng.gauss(0, spread) for c in centre], i % 2, None))
    rows += [(200 + i, rows[0][1], 0, None) for i in range(5)]
    # ids that stand on several vectors, equal, near and far
    rows += [(3, rows[40][1], 0, None), (3, rows[3][1], 1, None), (7, [-x for x in centre], 0, None), (7, [1.01 * x for x in centre], 0, None)]
    frame = spark.createDataFrame(rows, VECTORS)
    got = metric_join.range_join(frame, cell=10, block=7).collect()
    assert sorted([tuple(r) for r in got], key=str) == vector_reference(rows)
    assert metric_join.range_join(frame.limit(0)).count() == 0
