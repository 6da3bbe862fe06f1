"""The pipeline: every stage against a plain version on its own input."""

import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
import data
from startlens.llm import langid, line_dedup, pii
from test_dedup import STRIP, near_reference
from test_text_ops import plain_hits

BENCH = "item_id long, text string"


def rows_of(df, columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    rows = data.documents(21, 120) + [(1000 + (r[0] or 0), *r[1:]) if r[0] is not None else r for r in data.edge_rows()]
    rng = random.Random(3)
    # unlearned languages, and texts that share most word pairs but few runs of five
    rows += [(2000 + i, " ".join("".join(rng.choice("wxyzkvjq") for _ in range(6)) for _ in range(40)), "en" if i > 9 else None, "a", 279) for i in range(3)]
    half = " ".join(f"{a} {b}" for a in "abcdef" for b in "abcdef").split()
    rows += [(3000 + i, " ".join(half[k:] + half[:k]), "en", "b", 143) for i, k in enumerate((0, 9, 21, 33))]
    items = [(1, " ".join(rows[3][1].split()[:25])), (2, "never in any text"), (None, None)]
    docs = data.docs_frame(spark, rows).withColumn("r", F.lit("extra")).withColumn("kept", F.lit(1))
    folder = data.write_tables(tmp_path_factory.mktemp("p"), spark, documents=docs, benchmark=spark.createDataFrame(items, BENCH))
    return folder, rows, items


def test_stages_against_plain_versions(spark, world):
    folder, _, items = world
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    now = rows_of(docs, columns)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == columns and out.schema == docs.schema
        got = rows_of(out, columns)
        if name == "language":
            model, letters = langid.train(docs.where("pmod(crc32(cast(cast(doc_id as string) as binary)), 5) <> 0")), langid.letter_table()
            langs, scores, fits = model.score_and_fit([r[1] for r in now], letters)
            want = [r for r, x, s, f in zip(now, langs, scores, fits) if x != "und" and s >= 0.5 and f >= -1.75]
            assert not {2000, 2001, 2002} & {r[0] for r in want}
        elif name == "lines":
            key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(STRIP))
            held = {}
            for r in now:
                for x in (r[1] or "").split("\n"):
                    if r[0] is not None:
                        held.setdefault(key(x), set()).add(r[0])
            want = []
            for r in now:
                ls = (r[1] or "").split("\n")
                kept = [x for x in ls if r[0] is None or len(key(x)) < 10 or min(held[key(x)]) == r[0]]
                if kept:
                    text = r[1] if len(kept) == len(ls) else "\n".join(kept)
                    want.append((r[0], text, r[2], r[3], r[4] if text == r[1] else len(text), *r[5:]))
        elif name == "near_duplicates":
            stays = {x[0] for x in near_reference(now, 5) if x[3]}
            assert len(stays) > len({x[0] for x in near_reference(now, 2) if x[3]})
            want = [r for r in now if r[0] in stays]
        else:
            want = [r for r in now if plain_hits(r[1], items)[1] == 0]
        assert got == sorted(want, key=str), name
        assert 0 < len(got) < len(now), name  # its decisions take effect
        now = got
        docs = spark.createDataFrame(now, docs.schema)
    out = corpus_pipeline.mix(spark, docs, folder).collect()
    assert all(r["copies"] in (1, 2) and r["taken"] == r["copies"] * r["size"] for r in out)
    assert {r["doc_id"] for r in out} <= {r[0] for r in now}


def test_run_and_empty_tables(spark, world, tmp_path):
    folder, rows, items = world
    out = corpus_pipeline.run(spark, folder)
    assert 0 < out.count() < len(rows)
    empty = data.write_tables(
        tmp_path, spark, documents=data.docs_frame(spark, []), benchmark=spark.createDataFrame([], BENCH)
    )
    assert corpus_pipeline.run(spark, empty).count() == 0
    # without a labelled row nothing is dropped for its language
    docs = data.docs_frame(spark, [(1, "some text", None, "a", 9), (2, None, None, None, None)])
    assert corpus_pipeline.language(spark, docs, folder).count() == 2


#: Names that stages and operators use inside, and prefixes that they choose.
INSIDE = ["__language", "__doc", "__drop", "__r", "__gone", "__matches", "__p", "__s", "__email", "__number", "row", "id", "doc", "drop", "r", "key", "fit",
          "node", "component_id", "copies_", "__kept_text", "__n_lines", "__n_dropped", "base", "rep", "w", "a", "p", "best", "__bin", "a.b"]


def test_columns_of_any_name_keep_their_values(spark, world):
    folder, _, _ = world
    docs = spark.read.parquet(f"{folder}/documents.parquet").drop("r", "kept").where("doc_id is not null")
    docs = docs.withColumns({name: F.concat(F.lit(f"{k}:"), F.col("doc_id").cast("string")) for k, name in enumerate(INSIDE)})
    made = {"dedup_lines": lambda d: line_dedup.dedup_lines(d), "find_spans": lambda d: pii.find_spans(d)}
    for stage in [lambda d, f=f: f(spark, d, folder) for _, f in corpus_pipeline.STAGES] + list(made.values()):
        out = stage(docs)
        quoted = [f"`{c}`" for c in INSIDE]
        got = out.select("doc_id", *quoted).collect()
        assert got and all(tuple(r)[1:] == tuple(f"{k}:{r['doc_id']}" for k in range(len(INSIDE))) for r in got)
