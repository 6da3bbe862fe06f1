"""Decontamination (7), source mixing (8), personal data (10)."""

import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import data
from startlens.llm import mixing, pii, registry, suffix_decon

# ---- decontamination ----


def alnum(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def plain_hits(text, items, window=10):
    ws, hit, found = alnum(text), set(), set()
    for item, item_text in items:
        iw = alnum(item_text)
        n = min(window, len(iw))
        wins = {tuple(iw[k : k + n]) for k in range(len(iw) - n + 1)} if n else set()
        for k in range(len(ws) - n + 1 if n else 0):
            if tuple(ws[k : k + n]) in wins:
                hit.update(range(k, k + n))
                found.add("" if item is None else str(item))
    return len(ws), len(hit), sorted(found)


def contaminated(seed=1):
    rng = random.Random(seed)
    items = [(k, data.sentence(rng, rng.choice([3, 9, 10, 11, 30, 50]))) for k in range(12)]
    items += [(20, items[4][1]), (4, "Another text, of the same id!"), (None, data.sentence(rng, 12)), (30, None), (31, "..."), (32, ""), (33, "naïve ÀÉ")]
    rows = list(data.edge_rows())
    for i in range(100, 180):
        parts = [data.sentence(rng, rng.randrange(0, 40))]
        for _ in range(rng.randrange(0, 4)):
            w = re.split(" ", rng.choice(items[:15])[1])
            k = rng.randrange(len(w))
            parts.append(", ".join(w[k:] if rng.random() < 0.5 else w).upper())
        rows.append((i, "\n".join(parts), "en", "a", 1))
    return items, rows


@pytest.mark.parametrize("limits", [{}, {"block_bytes": 200, "shard_words": 50}, {"window": 4}], ids=["plain", "blocks", "short"])
def test_matches_equal_plain_version(spark, limits):
    items, rows = contaminated()
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = suffix_decon.find_matches(spark, data.docs_frame(spark, rows), bench, "c", **limits).select("text", "c").collect()
    assert len(got) == len(rows) and any(r["c"]["n_hit"] for r in got)
    for r in got:
        n, hit, found = plain_hits(r["text"], items, limits.get("window", 10))
        assert (r["c"]["n_words"], r["c"]["n_hit"], r["c"]["items"]) == (n, hit, found)
        ws = alnum(r["text"])
        for m in r["c"]["matches"]:
            texts = [alnum(t) for i, t in items if ("" if i is None else str(i)) == m["item"]]
            part = ws[m["doc_pos"] : m["doc_pos"] + m["n_words"]]
            assert any(t[m["item_pos"] : m["item_pos"] + m["n_words"]] == part for t in texts)


def test_decontamination_query_digest(spark, tmp_path):
    items, rows = contaminated(2)
    folder = data.write_tables(
        tmp_path, spark, documents=data.docs_frame(spark, rows), benchmark=spark.createDataFrame(items, "item_id long, text string")
    )
    got = {r["doc_id"]: r for r in registry.op7_decontamination(spark, folder).collect() if r["doc_id"] is not None and r["doc_id"] >= 100}
    for r in rows[len(data.edge_rows()) :]:
        n, hit, found = plain_hits(r[1], items)
        g = got[r[0]]
        sha = hashlib.sha256(",".join(found).encode()).hexdigest()
        assert (g["n_words"], g["n_hit"], g["n_items"], g["items_sha256"], g["contaminated"]) == (n, hit, len(found), sha, hit > 0)


def test_matches_are_longest(spark):
    words = [f"w{k}" for k in range(40)]
    bench = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x " + " ".join(words[5:30]) + " y " + " ".join(words[:12]))], "doc_id long, text string")
    got = suffix_decon.find_matches(spark, docs, bench, "c").first()["c"]
    assert [tuple(m) for m in got["matches"]] == [("1", 0, 27, 12), ("1", 5, 1, 25)] and got["n_hit"] == 37


def test_decontamination_of_empty_tables(spark):
    items, rows = contaminated()
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = data.edge_docs(spark)
    got = suffix_decon.find_matches(spark, docs, bench.limit(0), "c")
    assert got.columns == [*docs.columns, "c"] and got.agg(F.sum("c.n_hit")).first()[0] == 0
    assert suffix_decon.find_matches(spark, docs.limit(0), bench, "c").count() == 0


# ---- mixing ----


def plain_targets(sizes, weights=(5, 2, 1), share=1.5, most=2):
    order = sorted((s for s in sizes if s is not None), key=str.encode) + ([None] if None in sizes else [])
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    target, left, free = {}, share * sum(sizes.values()), set(order)
    while free:
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if weight[s] * level > most * sizes[s]}
        if not full:
            target.update({s: weight[s] * level for s in free})
            break
        for s in full:
            target[s] = most * sizes[s]
            left -= target[s]
        free -= full
    return target


@pytest.mark.parametrize("rows", [data.edge_rows(), data.documents(11, 300)], ids=["edge", "random"])
def test_mix_targets_and_sums(spark, rows):
    df = data.docs_frame(spark, rows)
    got = mixing.mix_sources(df).collect()
    assert sorted(map(str, (r["doc_id"] for r in got))) == sorted(str(r[0]) for r in rows)
    sizes, taken, short = {}, {}, {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + len(data.words(r[1]))
    target = plain_targets(sizes)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(target[r["source"]])
        assert r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 2
        assert r["copies"] >= int(target[r["source"]] / sizes[r["source"]] + 1e-12 if sizes[r["source"]] else 0)
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        short[r["source"]] = max(short.get(r["source"], 0), r["size"])
    if len(rows) > 100:
        for s in sizes:
            assert abs(taken[s] - target[s]) <= 0.05 * target[s]
    again = mixing.mix_sources(df.repartition(7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_mix_takes_documents_by_their_odds(spark):
    """Equal texts in one source: each is as likely as the source asks."""
    rows = [(i, "three words here", "en", "a" if i % 2 else "b", 1) for i in range(4000)]
    got = mixing.mix_sources(data.docs_frame(spark, rows), bins=64).collect()
    for s in "ab":
        mine = [r for r in got if r["source"] == s]
        assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= 3
        low = [r["copies"] for r in mine if r["doc_id"] < 2000]
        high = [r["copies"] for r in mine if r["doc_id"] >= 2000]
        assert abs(sum(low) / len(low) - sum(high) / len(high)) < 0.1


def plain_level(sizes, classes, goal):
    lo, hi = -200.0, 200.0
    for _ in range(100):
        mid = (lo + hi) / 2
        have = sum(n * 2 ** (mid + k) / (1 + 2 ** (mid + k)) for n, k in zip(sizes, classes))
        lo, hi = (mid, hi) if have < goal else (lo, mid)
    return lo


@pytest.mark.parametrize("bins", [7, 64, 65536])
def test_mix_samples_in_pareto_order_of_unequal_odds(spark, bins):
    """Copies equal those of the ranking by random odds over inclusion odds, and
    each size class is taken as often as its inclusion probability says."""
    lengths = (3, 5, 17, 70)
    rows = [(i, "w " * lengths[i % 4], "en", "only", 1) for i in range(4000)]
    df = data.docs_frame(spark, rows)
    got = mixing.mix_sources(df, bins=bins).collect()
    sizes = [lengths[i % 4] for i in range(4000)]
    classes = [{3: 0, 5: 1, 17: 2, 70: 3}[n] for n in sizes]
    rest = 0.5 * sum(sizes)
    level = plain_level(sizes, classes, rest)
    u = {r["doc_id"]: r["u"] for r in df.select("doc_id", mixing.uniform("doc_id", "mix").alias("u")).collect()}
    p = [2 ** (level + k) / (1 + 2 ** (level + k)) for k in classes]
    rank = sorted(range(4000), key=lambda i: (u[i] / (1 - u[i])) / (p[i] / (1 - p[i])))
    more, total = {}, 0
    for i in rank:
        more[i] = int(total + sizes[i] / 2 <= rest)
        total += sizes[i]
    assert {r["doc_id"]: r["copies"] for r in got} == {i: 1 + more[i] for i in rank}
    for k in range(4):
        mine = [i for i in range(4000) if classes[i] == k]
        assert abs(sum(more[i] for i in mine) / 1000 - p[mine[0]]) < 0.06
    assert p[0] < p[1] < p[2] < p[3]
    found = spark.createDataFrame([([(k, 1000 * n) for k, n in enumerate(lengths)], rest)], "c array<struct<k:int,words:long>>, g double")
    assert found.select(mixing.inclusion_level("c", "g")).first()[0] == pytest.approx(level, abs=1e-6)


def test_mix_takes_given_odds(spark):
    rows = [(i, "three words here", "en", "a", 1) for i in range(2000)]
    docs = data.docs_frame(spark, rows)
    odd = F.when(F.col("doc_id") < 1000, F.when(F.col("doc_id") % 2 == 1, 4)).otherwise(F.col("doc_id") % 2 * 400)
    got = mixing.mix_sources(docs, odds_class=odd).collect()
    taken = {h: sum(r["copies"] - 1 for r in got if (r["doc_id"] < 1000, r["doc_id"] % 2) == h) for h in [(True, 0), (True, 1), (False, 1)]}
    assert taken[True, 0] < 200 < 350 < taken[True, 1] < taken[False, 1] == 500 and sum(r["copies"] - 1 for r in got) == 1000


def test_mix_empty_and_wordless_tables(spark):
    docs = data.edge_docs(spark)
    assert mixing.mix_sources(docs.limit(0)).count() == 0
    got = mixing.mix_sources(docs.withColumn("text", F.lit(None).cast("string"))).agg(F.sum("taken"), F.sum("target")).first()
    assert tuple(got) == (0, 0.0)


def test_mix_keeps_rows(spark):
    docs = data.edge_docs(spark).withColumn("size", F.lit("mine")).withColumn("__bin", F.lit(1))
    got = mixing.mix_sources(docs, keep_rows=True)
    assert got.columns == [*[c for c in docs.columns if c != "size"], "size", "source_size", "target", "copies", "taken"]
    assert got.count() == len(data.edge_rows())


# ---- personal data ----

PLAIN = [
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
]


def luhn(digits):
    return sum(int(c) if k % 2 == 0 else 2 * int(c) - 9 * (int(c) > 4) for k, c in enumerate(reversed(digits))) % 10 == 0


def plain_spans(text):
    out = []
    for k, p in enumerate(PLAIN):
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if [True, k == 1 and all(int(x) <= 255 for x in m[0].split(".")), 12 <= len(d) <= 19 and luhn(d), 9 <= len(d) <= 15][k]:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def joined(spans):
    return ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in spans)


HARD = [
    "a@b.c_d@e.f x@y.z.@q.w", "..@a.b", "1.2.3.4.5.6.7.8 300.1.1.1.1 0000255.1.1.1 999999999999.1.1.1",
    "4111 1111-1111 1111 4111111111111111 41111111111111112 1 2 3 4 5 6 7 8 9 0 1 2 3", "4111-1111-1111-1111@x.yz 4111  1111 1111 1111",
    "+1 (017) 555-7713 +1((((((( +12 +123456789 +1.2.3.4.5.6.7.8.9) ++1 2 3 4 5 6 7 8 9", "é😀 me@x.org 😀 +49 30 1234567", None, "",
    "5" * 30_000, "1 " * 10_000, "1.1." * 3_000, "a" * 30_000 + "@b.c", "+1" + "(" * 20_000, "a@b." * 2_000, "a@b.c " * 1_500,
]


def test_base_spans_equal_plain_version(spark, tmp_path):
    rng = random.Random(3)
    made = ["".join(rng.choice("01 -.+@a(😀") for _ in range(rng.randrange(1, 120))) for _ in range(300)]
    texts = HARD + made
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = registry.op10_personal_data(spark, data.write_tables(tmp_path, spark, documents=df)).collect()
    assert len(got) == len(texts)
    for r in got:
        want = plain_spans(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(joined(want).encode()).hexdigest(), texts[r["doc_id"]]
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [sum(k == j for _, k, _ in want) for j in range(4)]
        assert set(joined(want).split(",")) <= set(r["spans"].split(","))


def test_base_spans_of_documents_and_no_python(spark):
    sf = "/root/testdata/sf0.001"
    out = registry.op10_personal_data(spark, sf)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    texts = {r[0]: r[1] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    for r in out.collect():
        assert r["base_sha256"] == hashlib.sha256(joined(plain_spans(texts[r["doc_id"]])).encode()).hexdigest()


def test_model_adds_likely_spans_only(spark):
    rng = random.Random(8)
    rows = []
    for i in range(400):
        d = "".join(rng.choice("0123456789") for _ in range(15))
        card = next(d + c for c in "0123456789" if luhn(d + c))
        bad = next(d + c for c in "0123456789" if not luhn(d + c))
        rows.append((i, f"mail me{i}@x{i}.org or +1 (555) 555-{i:04d}, card {card} not {bad}, version 1.{i}.3 host 10.0.{i % 256}.7 not 300.1.1.{i}", None))
    rows.append((1000, "write to ann [at] mail [dot] org", None))
    rows.append((1001, f"card {card[:4]}/{card[4:8]}/{card[8:12]}/{card[12:]} or {bad[:4]}/{bad[4:8]}/{bad[8:12]}/{bad[12:]}", None))
    df = spark.createDataFrame(rows, "doc_id long, text string, score double")
    got = {r["doc_id"]: r for r in pii.find_spans(df).select("doc_id", "text", pii.joined(F.col("spans")).alias("s"), pii.redact(F.col("text"), F.col("spans")).alias("clean")).collect()}
    assert got[1000]["s"] == "email:9:32" and got[1000]["clean"] == "write to [PII]"
    assert got[1001]["s"] == "card:5:24"
    assert got[3]["clean"].startswith("mail [PII] or [PII], card [PII] not ") and got[3]["clean"].endswith("host [PII] not 300.1.1.3")


def test_personal_data_edge_rows(spark):
    docs = data.edge_docs(spark)
    got = pii.find_spans(docs)
    assert got.columns == [*docs.columns, "base_spans", "spans"] and got.where("size(spans) = 0").count() == len(data.edge_rows())
    assert pii.find_spans(docs.limit(0)).count() == 0


def test_rare_kind_among_many_numbers_keeps_its_threshold(spark):
    """15 addresses among 20,000 plain numbers, with a sample of 200 proposals."""
    rows = [(i, " ".join(f"{i}.{k} x" for k in range(10))) for i in range(2000)]
    rows += [(5000 + i, f"mail me{i}@host{i}.org now") for i in range(15)] + [(6000, "write to ann [at] mail [dot] org")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = pii.find_spans(df, max_fit=200).where("doc_id = 6000").select(pii.joined(F.col("spans")).alias("s")).first()
    assert got["s"] == "email:9:32"


def ordinary_texts():
    rng = random.Random(5)
    rows = [(i, f"{data.sentence(rng, 20)} mail me{i}@x{i}.org or you@y{i}.com {data.sentence(rng, 5)}") for i in range(300)]
    rows += [(400 + i, f"ask @anna{i} or user{i}@localhost and 3@{i}") for i in range(30)]
    negatives = ["meet [at] noon.today", "rate (at) 3.5", "sold [at] 12.50 each", "look [at] this.thing", "we met (at) night. ok"]
    rows += [(500 + i, t) for i, t in enumerate(negatives)]
    rows += [(600, "write to ann [at] mail [dot] org"), (601, "or bob.b (at) site.com now")]
    return rows


def test_spelled_addresses_need_a_plausible_ending(spark):
    for rows in (ordinary_texts(), [r for r in ordinary_texts() if not 400 <= r[0] < 500]):  # with and without handles
        df = spark.createDataFrame(rows, "doc_id long, text string")
        got = {r["doc_id"]: r["s"] for r in pii.find_spans(df).select("doc_id", pii.joined(F.col("spans")).alias("s")).collect()}
        assert {got[500 + i] for i in range(5)} == {""}
        assert got[600] == "email:9:32" and got[601] == "email:3:22"
        assert all(got.get(400 + i, "") == "" for i in range(30))
    assert pii.common_endings(df, "text") == ["com", "org"]


def plain_proposals(text, endings):
    """(start, end, generator, base, offered, features) by another regular expression engine."""
    import regex

    out = []
    for g, (kind, pattern, needs, _) in pii.GENERATORS.items():
        if not text or not regex.search(needs, text):
            continue
        for m in regex.finditer(pattern, text):
            v, left, right = m[0], text[max(0, m.start() - 24) : m.start()], text[m.end() : m.end() + 1]
            prior = [x.end() for x in regex.finditer(pattern, text) if x.end() <= m.start()]
            left = left[-(m.start() - max(prior, default=0)) :] if m.start() > max(prior, default=0) else ""
            nxt = [x.start() for x in regex.finditer(pattern, text) if x.start() >= m.end()]
            right = right if not nxt or min(nxt) > m.end() else ""
            body = v.lstrip("+")
            digits = re.sub("[^0-9]", "", body)
            groups = [x for x in re.split("[^0-9]+", body) if x]
            octets = bool(re.fullmatch(rf"{pii._OCTET}(?:\.{pii._OCTET}){{3}}", body))
            ending = kind == 0 and g != "handle" and (re.search("([A-Za-z0-9-]+)$", v) or [""])[0].lower() in endings
            base = {"email": True, "ip": octets, "card": luhn(digits), "phone": 9 <= len(digits) <= 15}.get(g, False)
            values = (kind, len(body), len(digits), len(groups), max(map(len, groups), default=0), body.count(" "), body.count("."), body.count("-"),
                      sum(map(body.count, "()")), 12 <= len(digits) <= 19 and luhn(digits), octets, len(re.findall("[A-Za-z]", body)),
                      bool(regex.search(r"\p{L}$", left)), bool(regex.search(r"\p{L}", right)), bool(re.search(pii.CUES, left)), ending)
            offered = ending if g == "spelled_email" else g not in ("number", "handle")
            out.append((m.start(), m.end(), kind, base, offered, [float(x) for x in values]))
    return out


def plain_score(model, f):
    def walk(lines):
        line = lines.pop(0).strip()
        if line.startswith("Predict:"):
            return float(line.split(":")[1])
        at, limit = re.match(r"If \(feature (\d+) <= ([-\d.E]+)\)", line).groups()
        low = walk(lines)
        lines.pop(0)
        high = walk(lines)
        return low if f[int(at)] <= float(limit) else high

    total = sum(w * walk([x for x in t.splitlines() if x.strip()][1:]) for w, t in model.trees)
    return 1 / (1 + math.exp(-2 * total))


def test_added_spans_equal_plain_generators_and_trees(spark):
    rng = random.Random(11)
    rows = ordinary_texts() + [(700 + i, t) for i, t in enumerate(HARD) if t is None or len(t) < 3000]
    for i in range(200):
        d = "".join(rng.choice("0123456789") for _ in range(16))
        rows.append((900 + i, f"call 555-{i:03d}-{i:04d} or +1 (555) 555-{i:04d}, card {d} / {d[:4]}.{d[4:8]}.{d[8:12]}.{d[12:]}, v1.{i}.3 10.0.{i}.7 300.1.1.{i}"))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    model = pii.fit(df, "text", "doc_id", 5000, 6, 3, 0.99)
    added = 0
    for r in pii.find_spans(df).collect():
        found = plain_proposals(r["text"], model.endings)
        base = sorted({(a, k, b) for a, b, k, is_base, _, _ in found if is_base})
        assert [tuple(s) for s in r["base_spans"]] == base
        more = set()
        for a, b, k, is_base, offered, f in found:
            limit = model.thresholds[k]
            if not is_base and offered and limit is not None and plain_score(model, f) >= limit - 1e-12 and not any(x < b and a < y for x, _, y in base):
                more.add((a, k, b))
        assert [tuple(s) for s in r["spans"]] == sorted({*base, *more}), r["text"]
        added += len(more)
    assert added >= 2


def plain_matches(text_words, items, window):
    """Maximal runs of equal words on every diagonal, at least a window (or a whole item) long."""
    out = set()
    for item, iw in items:
        size = min(window, len(iw))
        for d in range(-len(iw) + 1, len(text_words)):
            k = max(0, d)
            while k < len(text_words) and k - d < len(iw):
                j = k
                while j < len(text_words) and j - d < len(iw) and text_words[j] == iw[j - d]:
                    j += 1
                if size and j - k >= size:
                    out.add((k, j - k, item, k - d))
                k = max(k + 1, j)
    return out


def test_matches_of_repeating_texts_equal_every_diagonal():
    rng = random.Random(2)
    for _ in range(150):
        vocab = rng.choice(["a", "ab", "abc"])
        items = [(str(i), [rng.choice(vocab) for _ in range(rng.choice([1, 2, 3, 4, 7, 30]))]) for i in range(rng.randrange(1, 5))]
        texts = [[rng.choice(vocab + "z" * (rng.random() < 0.3)) for _ in range(rng.randrange(0, 60))] for _ in range(3)]
        block = suffix_decon.Block([(i, " ".join(w)) for i, w in items], 4)
        out = suffix_decon.shard_results([" ".join(t) for t in texts], [None] * 3, block)
        for t, (n, hit, found, matches) in zip(texts, out):
            want = plain_matches(t, items, 4)
            assert {(pos, size, item, j) for item, j, pos, size in matches} == want and len(matches) == len(want)
            assert n == len(t) and hit == len({k for pos, size, _, _ in want for k in range(pos, pos + size)}) and found == sorted({m[2] for m in want})


def test_one_word_repeated_needs_little_memory():
    import tracemalloc

    block = suffix_decon.Block([("x", "spam " * 2000)], 10)
    tracemalloc.start()
    ((n, hit, found, matches),) = suffix_decon.shard_results(["spam " * 20_000], [None], block)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (n, hit, found) == (20_000, 20_000, ["x"]) and len(matches) == 20_000 + 2000 - 1 - 2 * 9 and peak < 100 << 20
