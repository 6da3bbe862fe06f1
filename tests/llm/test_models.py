"""Quality (1), token counts (2), language ID (5), suffix tree scores (6)."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import data
from startlens.llm import langid, pst, quality, registry, token_counts

SF = "/root/testdata/sf0.01"


# ---- quality ----


def test_quality_on_held_out_labels(spark):
    got = registry.op1_quality(spark, SF).toPandas()
    assert (got["held_out"] == got["doc_id"].map(lambda i: data.crc(i) % 4 == 2)).all()
    assert got["score"].between(0, 1).all() and ((got["score"] >= 0.7) == (got["predicted"] == 1)).all()
    seen = got[got["held_out"]].merge(spark.read.parquet(f"{SF}/labels.parquet").toPandas(), on="doc_id")
    assert len(seen) > 50 and (seen["predicted"] == seen["quality"]).mean() >= 0.95


def test_quality_votes_equal_plain_version():
    rng = random.Random(1)
    classes = quality.byte_classes()
    texts = [data.sentence(rng, 20) for _ in range(40)] + ["!!! ### " * k for k in range(1, 11)] + ["", ""]
    counts = np.stack([quality.features(t, classes) for t in texts])
    labels = np.array([1] * 40 + [0] * 10 + [1, 0])
    voter = quality.Voter(counts, labels, 16, 5, 4.0, 0.05)
    got = voter.score(counts)
    for k in range(len(texts)):
        w = np.log1p(counts[k]) * voter.idf
        p = (w / max(np.linalg.norm(w), 1e-300)) @ voter.basis
        p = p / max(np.linalg.norm(p), 1e-300)
        cos = [round(float(p @ q), 9) for q in voter.points]
        near = sorted(range(len(cos)), key=lambda j: (-cos[j], j))[:5]
        weight = [max(cos[j], 0.0) ** 4 for j in near]
        want = (sum(a * labels[j] for a, j in zip(weight, near)) + 0.05 * labels.mean()) / (sum(weight) + 0.05)
        assert abs(want - got[k]) < 1e-6


def test_quality_edge_rows(spark):
    docs = data.edge_docs(spark)
    labels = spark.createDataFrame([(4, 1, 0), (8, 1, None), (5, 0, 1), (6, None, 0), (None, 1, 0), (99, 1, 0), (8, 1, 0), (7, 7, 0)], "doc_id long, quality int, toxic int")
    voter = quality.train(docs, labels)
    assert len(voter.labels) == 3
    out = docs.withColumn("q", quality.predict(spark, voter, F.col("text"))).select("doc_id", "q").collect()
    assert len(out) == len(data.edge_rows()) and all(0 <= r["q"] <= 1 for r in out)
    by = {r["doc_id"]: r["q"] for r in out}
    assert by[0] == by[1] == pytest.approx(2 / 3)  # no features: the labels' share
    assert by[4] > by[5]
    none = quality.train(docs, labels.limit(0))
    assert docs.select(quality.predict(spark, none, F.col("text")).alias("q")).agg(F.min("q"), F.max("q")).first()[:] == (0.5, 0.5)
    assert quality.train(docs.limit(0), labels).labels.size == 0


# ---- token counts ----


def plain_cut(pieces: dict, word: bytes) -> int:
    best = [(0.0, 0)] + [(-math.inf, 0)] * len(word)
    for end in range(1, len(word) + 1):
        for start in range(end):
            s = pieces.get(word[start:end])
            if s is not None:
                score, n = best[start][0] + s, best[start][1] + 1
                if score > best[end][0] or (score == best[end][0] and n < best[end][1]):
                    best[end] = (score, n)
    return best[-1][1]


def test_token_counts_equal_plain_version(spark):
    pieces = token_counts.load_pieces(registry.VOCABULARY)
    rows = [r for r in data.documents(6, 40)] + [r for r in data.edge_rows() if len(r[1] or "") < 1000]
    df = data.docs_frame(spark, rows)
    got = df.select("doc_id", "text", token_counts.token_counts(spark, F.col("text"), registry.VOCABULARY).alias("r")).collect()
    assert len(got) == len(rows)
    for r in got:
        pre = token_counts.PRE_TOKEN.findall((r["text"] or "").encode())
        assert b"".join(pre) == (r["text"] or "").encode()
        assert r["r"]["n_pretokens"] == len(pre) and r["r"]["n_tokens"] == sum(plain_cut(pieces, w) for w in pre)


def test_trie_scores_each_prefix_once(monkeypatch):
    pieces = {bytes([b]): -5.0 for b in range(256)} | {b"ab": -1.0, b"abc": -1.5}
    trie, scored = token_counts.PieceTrie(pieces), []
    extend = trie._extend
    monkeypatch.setattr(trie, "_extend", lambda word, end, *rest: (scored.append(word[:end]), extend(word, end, *rest)))
    words = [b"ab", b"abc", b"abcd", b"abd", b"b"]
    assert [trie.insert(w) for w in words] == [1, 1, 2, 2, 1]
    # a task's later batches go down the same trie, in any order
    assert trie.counts({b"abda", b"ab", b"ba", b"a"}) == {b"abda": 3, b"ba": 2, b"a": 1}
    prefixes = {w[:k] for w in [*words, b"abda", b"ba"] for k in range(1, len(w) + 1)}
    assert len(trie) == len(prefixes) == len(scored) and set(scored) == prefixes
    assert trie.terminal == {b"ab": 1, b"abc": 1, b"abcd": 2, b"abd": 2, b"b": 1, b"abda": 3, b"ba": 2, b"a": 1}


def test_long_and_many_pre_tokens_equal_plain_cut(monkeypatch):
    pieces = token_counts.load_pieces(registry.VOCABULARY)
    rng = random.Random(8)
    words = ["".join(rng.choice("etaon inshr") for _ in range(rng.randrange(1, 300))).encode() for _ in range(60)]
    words += [words[0] * 2, words[0] * 2 + b"x", b"abab" * 80, b""]
    want = [plain_cut(pieces, w) for w in words]
    monkeypatch.setattr(token_counts, "SHARED", 150)
    monkeypatch.setattr(token_counts, "MAX_NODES", 2000)
    trie = token_counts.PieceTrie(pieces)
    for w, n in zip(words, want):
        found = trie.counts({w})
        assert (found[w] if w in found else trie.terminal[w]) == n and len(trie) <= 2150
    assert max(map(len, trie.terminal)) <= 150


def test_token_counts_whole_long_texts_and_query(spark):
    rows = [r for r in data.edge_rows() if len(r[1] or "") > 1000]
    got = data.docs_frame(spark, rows).select(token_counts.token_counts(spark, F.col("text"), registry.VOCABULARY).alias("r")).collect()
    assert [r["r"]["n_pretokens"] for r in got] == [40_001, 1] and all(r["r"]["n_tokens"] > 100 for r in got)
    assert registry.op2_token_counts(spark, "/root/testdata/sf0.001").count() == 200


# ---- language ID ----


def test_language_on_held_out_documents(spark):
    got = registry.op5_language_id(spark, SF).toPandas().merge(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").toPandas(), on="doc_id")
    assert (got["held_out"] == got["doc_id"].map(lambda i: data.crc(i) % 5 == 0)).all()
    out = got[got["held_out"]]
    assert (out["lang_pred"] == out["lang"]).mean() >= 0.98 and got["score"].between(0, 1).all()


def plain_grams(text, buckets):
    """n-grams of letters with one space before, between and after runs."""
    marked = " " + "".join(c if c.isalpha() else " " for c in (text or "").lower()) + " "
    while "  " in marked:
        marked = marked.replace("  ", " ")
    return Counter(marked[k : k + n] for n in (1, 2, 3) for k in range(len(marked) - n + 1) if marked[k : k + n] != " ")


def test_gram_counts_equal_plain_version():
    letters = langid.letter_table()
    texts = ["Ab, cd!", "", None, "123", "ñandú 😀 é", "a" * 50, "x1y"]
    doc, gram = langid.gram_buckets(texts, letters, 1 << 14)
    for k, t in enumerate(texts):
        have = sorted(Counter(gram[doc == k].tolist()).values())
        want = plain_grams(t, 1 << 14) if t and any(c.isalpha() for c in t) else Counter()
        assert have == sorted(want.values()), t


def test_language_edge_rows(spark):
    docs = data.edge_docs(spark)
    model = langid.train(docs)
    assert model.labels == ["de", "en", "xx"]
    got = docs.select("doc_id", langid.predict(spark, model, F.col("text")).alias("r")).collect()
    by = {r["doc_id"]: r["r"] for r in got}
    assert len(got) == len(data.edge_rows())
    for k in (0, 1, 2, 10):  # null, empty, blank, no letter
        assert by[k]["lang_pred"] == "und" and by[k]["score"] == 0.0
    assert by[6]["lang_pred"] == "de" and by[4]["lang_pred"] == "en" and 0 <= by[4]["score"] <= 1
    none = langid.train(docs.limit(0))
    assert {r[0]["lang_pred"] for r in docs.select(langid.predict(spark, none, F.col("text"))).collect()} == {"und"}


def test_language_scores_equal_plain_version(spark):
    rows = data.documents(7, 30)
    model = langid.train(data.docs_frame(spark, rows), buckets=256)
    letters = langid.letter_table()
    got, score = model.score([r[1] for r in rows], letters)
    for k, r in enumerate(rows):
        _, gram = langid.gram_buckets([r[1]], letters, 256)
        total = model.log_prior + model.log_prob[:, gram].sum(axis=1)
        assert got[k] == model.labels[int(total.argmax())]
        assert abs(score[k] - 1 / np.exp(total - total.max()).sum()) < 1e-6


# ---- suffix tree ----


def plain_tree(train, min_context, min_string, cutoff):
    """P(word | history) of a suffix tree, from the definition."""
    texts = [data.words(t) + [""] for t in train]
    uni = Counter(w for t in texts for w in t)
    total, distinct = sum(uni.values()), len(uni)
    root = lambda w: (uni[w] + 0.5) / (total + 0.5 * (distinct + 1))
    states = {}

    deepest = [0]

    def prob(history, w, most=None):
        for n in range(min(len(history), deepest[0] if most is None else most), 0, -1):
            s = tuple(history[-n:])
            if s in states:
                count, listed = states[s]
                rest = (count - sum(listed.values()) + len(listed) + 1) / (count + len(listed) + 1)
                return listed.get(w, 0) / (count + len(listed) + 1) + rest * prob(history, w, n - 1)
        return root(w)

    n, new = 0, {}
    while n < 2 or new:  # contexts of one and two words, and longer ones while their suffix is retained
        n += 1
        counts, seen = Counter(), Counter()
        for t in texts:
            for k in range(n, len(t)):
                s = tuple(t[k - n : k])
                if n < 3 or s[1:] in new:
                    counts[s] += 1
                    seen[(*s, t[k])] += 1
        if n == 1:  # a word counts wherever it stands
            counts = Counter({(w,): uni[w] for w in uni if w})
        by = {}
        for s, c in seen.items():
            if c >= max(2.0, min_string * total):
                by.setdefault(s[:-1], {})[s[-1]] = c
        new = {}
        for s, listed in by.items():
            count = counts[s]
            if count < max(2.0, min_context * total):
                continue
            parent = {w: prob(s[1:], w) for w in listed}
            inner = sum(c / count * math.log(c / count / parent[w]) for w, c in listed.items())
            left = 1 - sum(listed.values()) / count
            if left > 1e-12:
                inner += left * math.log(left / max(1 - sum(parent.values()), 1e-300))
            if count * inner >= cutoff / 2 * (len(listed) + 1) * math.log(max(total, 2)):
                new[s] = (count, listed)
        states.update(new)
        deepest[0] = max([deepest[0], *map(len, new)])
    return uni, total, distinct, states, prob


def test_tree_scores_equal_plain_version(spark):
    rows = data.documents(8, 60) + [r for r in data.edge_rows() if r[0] != 4]
    df = data.docs_frame(spark, [(i, *r[1:]) for i, r in enumerate(rows)])
    learn = (F.col("doc_id") % 5) != 1
    got = pst.score_texts(df, learn, min_context=1e-3, min_string=1e-3, cutoff=1.0, shards=3).collect()
    uni, total, distinct, states, prob = plain_tree([r[1] for i, r in enumerate(rows) if i % 5 != 1], 1e-3, 1e-3, 1.0)
    assert {1, 2} <= {len(s) for s in states} and len(got) == len(rows)
    for r in got:
        t = data.words(rows[r["doc_id"]][1]) + [""]
        base = sum(math.log10((uni[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in t)
        want = sum(math.log10(prob(tuple(t[:k]), w)) for k, w in enumerate(t))
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(t), sum(uni[w] > 0 for w in t), total)
        assert r["base_score"] == pytest.approx(base) and r["score"] == pytest.approx(want)


def test_tree_distributions_sum_to_one(spark):
    rows = data.documents(9, 40)
    uni, total, distinct, states, prob = plain_tree([r[1] for r in rows], 1e-3, 1e-3, 1.0)
    for s in list(states)[:20]:
        unseen = 0.5 / (total + 0.5 * (distinct + 1))
        p = sum(prob(s, w) for w in uni)
        rest = prob(s, "never seen")
        assert p + rest == pytest.approx(1.0) and rest <= unseen


def test_tree_beats_the_base_on_held_out_text(spark):
    got = registry.op6_suffix_tree_score(spark, SF).toPandas()
    out = got[got["held_out"]]
    assert (got["held_out"] == got["doc_id"].map(lambda i: data.crc(i) % 5 == 1)).all()
    assert out["score"].sum() > out["base_score"].sum() and np.isfinite(got["score"]).all()


def test_tree_edge_rows_and_nothing_to_learn(spark):
    docs = data.edge_docs(spark)
    got = pst.score_texts(docs, F.col("doc_id").isNotNull())
    assert got.columns == ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    rows = got.collect()
    assert len(rows) == len(data.edge_rows()) and all(r["score"] <= 0 for r in rows)
    assert {r["n_tokens"] for r in rows if r["doc_id"] in (0, 1, 2)} == {1}
    nothing = pst.score_texts(docs, F.lit(False)).collect()
    assert {(r["train_tokens"], r["n_known"], r["base_score"], r["score"]) for r in nothing} == {(0, 0, 0.0, 0.0)}
    assert pst.score_texts(docs.limit(0), F.lit(True)).count() == 0


def test_tree_keeps_rare_and_deep_strings(spark):
    """Strings of five occurrences among many tokens, and one that three words decide."""
    rng = random.Random(4)
    vocab = [f"v{k}" for k in range(40)]
    hot = [" ".join(rng.choice(vocab) for _ in range(1000)) for _ in range(1200)]
    rare = ["quick zebra jumps"] * 5
    deep = [f"{a} {b} {c} {a}{b}" for a in "pq" for b in "rs" for c in "tu" for _ in range(100)]
    rows = [(i, x, None, None, 0) for i, x in enumerate(hot + rare + deep)]
    got = pst.score_texts(data.docs_frame(spark, rows), F.lit(True), shards=3).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == len(rows) and by[0]["train_tokens"] > 1_200_000
    zebra = by[len(hot)]  # five of over a million tokens were under both shares
    assert zebra["score"] > zebra["base_score"] + 9
    for k in (0, len(deep) - 1):
        r = by[len(hot) + len(rare) + k]
        first = math.log10(400.5 / r["train_tokens"])
        # the fourth word has four values after one word, two after two and one after three
        assert r["score"] > first + math.log10(0.5 * 0.5) - 0.1


def deep_texts():
    """Runs of one word, a long shared passage with edits, and texts that five words back decide."""
    rng = random.Random(6)
    noise = [" ".join(rng.choice(["n1", "n2", "n3", "n4"]) for _ in range(rng.randrange(3, 40))) for _ in range(60)]
    runs = ["u " * rng.randrange(1, 60) + "stop" for _ in range(80)]
    passage = [f"p{k}" for k in range(50)]
    near = [" ".join(w if rng.random() > 0.05 else rng.choice(passage) for w in passage) for _ in range(40)]
    # each of the five words before the last halves what it can be
    far = [" ".join(f"{k}{b}" for k, b in zip("abcde", f"{i:05b}")) + f" y{i}" for i in range(32) for _ in range(36)]
    return noise + runs + near + far


@pytest.mark.parametrize("local, window", [(0, 32), (10**9, 32), (10**9, 1)], ids=["levels", "subtrees", "windows"])
def test_tree_of_any_depth_equals_plain_version(spark, monkeypatch, local, window):
    monkeypatch.setattr(pst, "LOCAL_TOKENS", local)
    monkeypatch.setattr(pst, "WINDOW_WORDS", window)
    texts = deep_texts()
    rows = [(i, t, None, None, 0) for i, t in enumerate(texts)]
    got = pst.score_texts(data.docs_frame(spark, rows), F.col("doc_id") % 7 != 1, shards=3).collect()
    uni, total, distinct, states, prob = plain_tree([t for i, t in enumerate(texts) if i % 7 != 1], 0.0, 0.0, 2.0)
    assert max(map(len, states)) >= 5 and len(got) == len(rows)
    for r in got:
        t = data.words(texts[r["doc_id"]]) + [""]
        want = sum(math.log10(prob(tuple(t[:k]), w)) for k, w in enumerate(t))
        assert r["score"] == pytest.approx(want), texts[r["doc_id"]]
