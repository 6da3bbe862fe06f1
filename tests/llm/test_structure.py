"""Periodic runs (11), conversation repair (12), divergence rules (13)."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import data
import numpy as np
import pytest
from pyspark.sql import functions as F

from startlens.llm import conversations, divergence, periodic, registry

# ---- periodic runs ----


def plain_runs(ws, min_length=6, min_exponent=4):
    """Every diagonal, then every smaller period, one by one."""
    out = []
    for q in range(1, len(ws) // min_exponent + 1):
        i = q
        while i < len(ws):
            j = i
            while j < len(ws) and ws[j] == ws[j - q]:
                j += 1
            if j - i + q >= max(min_length, min_exponent * q):
                seg = ws[i - q : j]
                if not any(all(seg[t] == seg[t - p] for t in range(p, len(seg))) for p in range(1, q)):
                    out.append((i - q, len(seg), q))
            i = max(i + 1, j)
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_collapsed(ws, runs):
    gone = {k for start, length, q in runs for k in range(start + q, start + length)}
    return " ".join(w for k, w in enumerate(ws) if k not in gone)


def looping_texts(seed, n):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        k = rng.choice([1, 2, 2, 3, 5, 40])
        ws = [f"w{rng.randrange(k)}" for _ in range(rng.randrange(0, rng.choice([10, 60, 200])))]
        for _ in range(rng.randrange(3)):
            p = [f"w{rng.randrange(k)}" for _ in range(rng.randrange(1, 15))]
            at = rng.randrange(len(ws) + 1)
            ws[at:at] = (p * 9)[: rng.randrange(1, 9 * len(p) + 1)]
        out.append(rng.choice([" ", "\n", " \t"]).join(ws))
    return out


def exact_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.mark.parametrize("limits", [(6, 4), (3, 3), (20, 5)], ids=str)
def test_runs_equal_brute_force(spark, limits):
    texts = looping_texts(3, 150) + [r[1] for r in data.edge_rows() if r[0] != 4] + ["a a a b " * 30, "Und und " * 9, "é é é é é é"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "runs long, text string")
    got = df.withColumn("r", periodic.find_runs(spark, F.col("text"), *limits)).collect()
    assert len(got) == len(texts)
    for row in got:
        ws = exact_words(row["text"])
        want = plain_runs(ws, *limits)
        assert [(x["start"], x["length"], x["period"]) for x in row["r"]["runs"]] == want, row["text"]
        assert row["r"]["n_words"] == len(ws) and row["r"]["collapsed"] == plain_collapsed(ws, want)


def test_long_texts_of_few_words_stay_small():
    one = periodic._of_slice([b"x " * 400_000], 6, 4).to_pylist()[0]
    assert one["runs"] == [{"start": 0, "length": 400_000, "period": 1}] and one["collapsed"] == "x"
    rng = random.Random(2)
    ws = [rng.choice("ab") for _ in range(3000)]
    got = periodic._of_slice([" ".join(ws).encode()], 6, 4).to_pylist()[0]["runs"]
    assert [(r["start"], r["length"], r["period"]) for r in got] == plain_runs(ws)
    # equal texts in a row, and texts that continue each other, stay apart
    twice = periodic._of_slice([b"a b c"] * 40, 6, 4).to_pylist()
    assert all(not r["runs"] for r in twice)


def test_runs_do_not_depend_on_how_a_batch_is_cut(monkeypatch):
    texts = [t.encode() for t in looping_texts(9, 40)]
    whole = periodic._of_slice(texts, 6, 4).to_pylist()
    monkeypatch.setattr(periodic, "CELLS", 7)
    assert periodic._of_slice(texts, 6, 4).to_pylist() == whole
    assert [periodic._of_slice([t], 6, 4).to_pylist()[0] for t in texts] == whole


def test_low_exponents_are_refused(spark):
    with pytest.raises(ValueError):
        periodic.find_runs(spark, F.col("text"), min_exponent=2)


def test_periodic_query_equals_plain_version(spark, tmp_path):
    rows = [r for r in data.edge_rows() if r[0] != 4] + data.documents(4, 120) + [(500 + i, t, None, None, 0) for i, t in enumerate(looping_texts(5, 60))]
    folder = data.write_tables(tmp_path, spark, documents=data.docs_frame(spark, rows))
    got = registry.op11_periodic_runs(spark, folder).collect()
    assert len(got) == len(rows)

    def digest(doc_id, text):
        ws = exact_words(text)
        h = data.crc(doc_id) if doc_id is not None else 1
        n, g = len(ws), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            ws = [w if i < a else ws[a + (i - a) % p] for i, w in enumerate(ws)]
        runs = plain_runs(ws)
        best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None,) * 3)
        listed = "".join(f"{s},{k},{q}\n" for s, k, q in runs)
        milli = 1000 * best[1] // best[2] if runs else None
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        return (doc_id, len(runs), *best, milli, sha(listed), sha(plain_collapsed(ws, runs)))

    want = Counter(digest(r[0], r[1]) for r in rows)
    assert Counter(tuple(r) for r in got) == want
    assert sum(r["n_runs"] for r in got) > 20


# ---- conversation repair ----

ROLES = ["system", "user", "assistant", "tool", "", None]
TEXTS = ["Hello there.", "What now?", "no end", "Fine! ", " \n", "", None, "Yes.", "Go on\n", "Sure."]


def chats(seed, n, longest=14):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(rng.randrange(1, longest)):
            if rng.random() < 0.75:
                role, text = ("user", "assistant")[t % 2], f"Line {t} of {c}."
            else:
                role, text = rng.choice(ROLES), rng.choice(TEXTS)
            turn = None if rng.random() < 0.05 else t + rng.randrange(2)
            rows.append((c if c else None, turn, role, text))
    return rows


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        h = data.crc(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}") % 20
        if h == 0:
            continue
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        out += [(conv, turn, "user" if h == 4 else role, text)] * (2 if h == 3 else 1)
    return out


def plain_repair(rows):
    """Cheapest edits by (cost, audit) over rows and states, from the last row."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
    faults, seen = [], set()
    for _, _, role, text in rows:
        end = text.rstrip(" \t\n\x0b\x0c\r")[-1:]
        faults.append("blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end not in ".!?" else None)
        seen.add((role, text))
    none = (10**9, "", "")
    now = {0: (0, "", ""), 1: none, 2: none, 3: (0, "", "")}

    def with_inserts(v):
        v = dict(v)
        for _ in range(3):
            for state, role, to in ((0, "user", 2), (1, "user", 2), (2, "assistant", 3), (3, "user", 2)):
                v[state] = min(v[state], (v[to][0] + 5, "I" + v[to][1], f"{role}:\n" + v[to][2]))
        return v

    now = with_inserts(now)
    for (_, _, role, text), fault in reversed(list(zip(rows, faults))):
        cut, new = 5 if fault == "truncated" else 0, {}
        for state in range(4):
            options = [(now[state][0] + 2, "D" + now[state][1], now[state][2])]
            if fault not in ("blank", "duplicate"):
                to = {"s": 1 if state == 0 else None, "u": None if state == 2 else 2, "a": 3 if state == 2 else None}.get(role[:1])
                if to:
                    options.append((now[to][0] + cut, "K" + now[to][1], f"{role}:{text}\n" + now[to][2]))
                to, other = (3, "assistant") if state == 2 else (2, "user")
                options.append((now[to][0] + 1 + cut, "R" + now[to][1], f"{other}:{text}\n" + now[to][2]))
            new[state] = min(options)
        now = with_inserts(new)
    cost, audit, text = now[0]
    initials = [r[2][:1] for r in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    turns = [r[1] for r in rows if r[1] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    if not rows:
        cost = 0
    counts = [faults.count(k) for k in ("blank", "duplicate", "truncated")]
    return (gaps, *counts, illegal, cost, audit, hashlib.sha256(text[:-1].encode()).hexdigest())


@pytest.mark.parametrize("block", [4096, 5], ids=["whole", "blocks"])
def test_repair_equals_dynamic_programming(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(conversations, "BLOCK", block)
    rows = chats(1, 60, 40 if block < 9 else 14) + [(900, 0, "user", "Alone.")] + [(901, t, "system", "S.") for t in range(3)]
    rows += [(902, t, ("user", "assistant")[t % 2], f"Step {t}.") for t in range(130)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    extra = {c: F.lit(c) for c in ("conv", "row", "block", "fault", "__k", "codes", "audit")}
    folder = data.write_tables(tmp_path, spark, conversations=df.withColumns(extra))
    got = {r["conv_id"]: tuple(r)[1:] for r in registry.op12_conversation_repair(spark, folder).collect()}
    by = defaultdict(list)
    for r in plain_damage(rows):
        by[r[0]].append(r)
    assert len(got) == len({r[0] for r in rows})
    for conv in got:
        assert got[conv] == plain_repair(by[conv]), conv


def test_repaired_rows_are_legal_and_keep_texts(spark):
    rows = [(*r, 1) for r in chats(7, 40)]
    df = spark.createDataFrame(rows, "row long, block long, role string, text string, conv_id long")
    numbered = conversations.numbered(df, "row", "block")
    summary, edits = conversations.repair(numbered)
    by = defaultdict(list)
    for r in edits.collect():
        by[r["conv"]].append(r)
    audits = {r["conv"]: r["audit"] for r in summary.collect()}
    assert set(by) == set(audits) == {r[0] for r in rows}
    for conv, own in by.items():
        own.sort(key=lambda r: (r["row"], r["place"]))
        assert "".join(r["edit"] for r in own) == audits[conv]
        kept = [r for r in own if r["edit"] != "D"]
        assert re.fullmatch("(s?(ua)+)?", "".join(r["role"][0] for r in kept))
        assert all(r["text"].strip() for r in kept if r["edit"] in "KR") and all(r["text"] == "" for r in kept if r["edit"] == "I")


def test_no_rows_and_rows_that_damage_drops(spark, tmp_path):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert registry.op12_conversation_repair(spark, data.write_tables(tmp_path / "a", spark, conversations=empty)).collect() == []
    gone = next(t for t in range(1000) if data.crc(f"5:{t}") % 20 == 0)
    one = spark.createDataFrame([(5, gone, "user", "Hi.")], empty.schema)
    got = registry.op12_conversation_repair(spark, data.write_tables(tmp_path / "b", spark, conversations=one)).collect()
    assert [tuple(r) for r in got] == [(5, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_auction_prices_are_dual_feasible():
    rng = random.Random(4)
    for _ in range(200):
        codes = bytes(rng.randrange(12) for _ in range(rng.randrange(1, 40)))
        prices, traces = conversations.solve(codes)
        for state in range(4):
            labels, end = conversations.follow(traces, state)
            assert sum(s[4] for s in conversations.steps(codes, labels, state)) == prices[state] and end in (0, 3)
            # no arc is cheaper than the fall of the price along it
            rest = conversations.solve(codes[1:])[0]
            for _, _, to, cost in conversations._arcs(codes[0], state):
                assert prices[state] <= cost + rest[to]


# ---- divergence rules ----


def plain_measures(text):
    ws, text = exact_words(text), text or ""
    lines = [x for x in text.split("\n") if exact_words(x)]
    windows = Counter(zip(ws, ws[1:], ws[2:]))
    hit = {k + j for k, w in enumerate(zip(ws, ws[1:], ws[2:])) if windows[w] > 1 for j in range(3)}
    n = len(ws)
    failed = n < 50 or 100 * len(hit) > 50 * n
    return n, sum(map(len, ws)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit), failed


def plain_classes(text):
    out = Counter()
    for c in "".join(exact_words(text)):
        k = next((k for k, m in divergence.CLASSES.items() if k != "letter" and re.match(f"[{m}]", c)), None)
        out[k or ("letter" if ord(c) > 127 else "other")] += 1
    total = sum(out.values())
    return {k: v / total for k, v in out.items()}


def plain_js(p, q):
    out = 0.0
    for k in {*p, *q}:
        a, b = p.get(k, 0), q.get(k, 0)
        out += sum(x * math.log2(x / ((a + b) / 2)) / 2 for x in (a, b) if x > 0)
    return math.sqrt(max(0, out))


def language_rows(seed=2, n=60):
    rng = random.Random(seed)
    common = {"en": ["the", "of", "And", "to"], "de": ["der", "und", "Die", "zu"]}
    rows = []
    for i in range(n):
        lang = rng.choice(["en", "de"])
        ws = [rng.choice(common[lang]) if rng.random() < 0.4 else data.sentence(rng, 1, 4000) + rng.choice(["", ".", "é", "9"]) for _ in range(rng.randrange(20, 240))]
        kind = rng.random()
        ws = [w.upper() + "!!" for w in ws] if kind < 0.1 else [w + "***" for w in ws] if kind < 0.2 else ws
        rows.append((i, "\n".join(" ".join(ws[k : k + 12]) for k in range(0, len(ws), 12)), rng.choice([lang, lang, None]), "s", 1))
    return rows


def test_rules_equal_plain_version(spark):
    rows = language_rows() + data.edge_rows() + [(200, "spam spam spam " * 40, "en", "a", 1), (201, "same line here\n" * 30, "de", "a", 1)]
    docs = data.docs_frame(spark, rows).withColumn("kept", F.lit("x")).withColumn("bucket", F.lit(1))
    found = divergence.learn(docs, rarity=20)
    measured = {r: plain_measures(r[1]) for r in rows}
    refs = {}
    for lang in {r[2] for r in rows if r[2]}:
        own = [r for r in rows if r[2] == lang and not measured[r][-1]]
        counts = Counter(w for r in own for w in data.words(r[1]))
        common = sorted(w for w, c in counts.items() if c * 20 >= sum(counts.values()))
        if own:
            classes = defaultdict(float)
            shares = defaultdict(float)
            for r in own:
                for k, v in plain_classes(r[1]).items():
                    classes[k] += v / len(own)
                for w in data.words(r[1]):
                    if w in common:
                        shares[w] += 1 / measured[r][0] / len(own)
            refs[lang] = classes, shares
    assert {k: sorted(w.decode() for w in v.words) for k, v in found.items()} == {k: sorted(v[1]) for k, v in refs.items()}
    for k, v in found.items():
        assert np.allclose(v.classes, [refs[k][0].get(c, 0) for c in [*divergence.CLASSES, "other"]])
        assert np.allclose(v.shares, [refs[k][1][w.decode()] for w in v.words])
    got = docs.withColumn("r", divergence.assess(spark, found, F.col("text"), max_words=0.4)).collect()
    assert len(got) == len(rows) and {r["kept"] for r in got} == {"x"}
    kept = 0
    by_text = {r[1]: r for r in rows}
    for r in got:
        row, out = by_text[r["text"]], r["r"]
        assert tuple(out)[:6] == measured[row]
        ws = data.words(r["text"])
        if not ws:
            assert out["char_distance"] is None and out["word_distance"] is None and not out["kept"]
            continue
        chars = min(plain_js(plain_classes(r["text"]), c) for c, _ in refs.values())
        far = []
        for _, shares in refs.values():
            p = Counter(w if w in shares else "" for w in ws)
            far.append(plain_js({k: v / len(ws) for k, v in p.items()}, {**shares, "": 1 - sum(shares.values())}))
        assert out["char_distance"] == pytest.approx(chars) and out["word_distance"] == pytest.approx(min(far), abs=1e-7)
        bad = measured[row][-1] or chars > 0.32 or (len(ws) >= 80 and min(far) > 0.4)
        assert out["kept"] == (not bad)
        kept += out["kept"]
    assert 10 < kept < len(rows) - 5


def test_rules_without_languages_or_rows(spark, tmp_path):
    rows = [(1, "a b c d e " * 3 + " ".join(f"w{i}" for i in range(80)), None, None, 1), (2, None, None, None, None)]
    docs = data.docs_frame(spark, rows)
    assert divergence.learn(docs) == {}
    got = registry.op13_quality_rules(spark, data.write_tables(tmp_path / "a", spark, documents=docs))
    assert {r["doc_id"]: (r["base_failed"], r["kept"]) for r in got.collect()} == {1: (False, True), 2: (True, False)}
    none = data.write_tables(tmp_path / "b", spark, documents=docs.where("false"))
    assert registry.op13_quality_rules(spark, none).collect() == []
    assert registry.op11_periodic_runs(spark, none).collect() == []
