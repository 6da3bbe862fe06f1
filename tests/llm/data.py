"""Small inputs and plain reference versions for the operator tests."""

from __future__ import annotations

import random
import re
import string
import zlib

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sentence(rng: random.Random, n: int, vocab: int = 400) -> str:
    return " ".join("".join(rng.choice(string.ascii_lowercase[:6]) for _ in range(1 + rng.randrange(vocab) % 7)) for _ in range(n))


def edge_rows() -> list[tuple]:
    """Nulls in every column, empty, blank, one-word, very long and repeated texts."""
    long_text = "word " * 40_000 + "end"
    rows = [
        (0, None, None, None, None),
        (1, "", "en", "a", 0),
        (2, " \t\n ", None, "", 4),
        (3, "one", "en", None, 3),
        (4, long_text, "en", "a", len(long_text)),
        (5, "x" * 100_000, "en", "b", 100_000),
        (6, "Straße 😀 ñandú naïve ÀÉ", "de", "b", 23),
        (7, "a line of more than ten\nshort\nA LINE of more than ten  \n", "en", "c", 50),
        (8, "a line of more than ten\nother words follow here", "en", "c", 46),
        (None, "a line of more than ten", "en", "c", 23),
        (9, "same text in two rows", "en", "d", 21),
        (9, "same text in two rows", "en", "d", 21),
        (10, "12345 67890 !!", "xx", "d", 14),
    ]
    return rows


def edge_docs(spark):
    """The rows above, with extra columns whose names the operators use inside."""
    rows = [(*r, i, f"k{i}", float(i)) for i, r in enumerate(edge_rows())]
    return spark.createDataFrame(rows, DOC_SCHEMA + ", doc int, key string, score double")


def documents(seed: int = 1, n: int = 160) -> list[tuple]:
    """Random texts with shared lines, exact and near copies, and several sources."""
    rng = random.Random(seed)
    shared = [sentence(rng, 12) for _ in range(5)]
    rows = []
    for i in range(n):
        parts = [sentence(rng, rng.randrange(3, 60)) for _ in range(rng.randrange(1, 5))]
        if rng.random() < 0.4:
            parts.insert(rng.randrange(len(parts) + 1), rng.choice(shared))
        text = "\n".join(parts)
        if rows and rng.random() < 0.4:
            words = rng.choice(rows)[1].split(" ")
            for _ in range(rng.randrange(0, 5)):
                words[rng.randrange(len(words))] = sentence(rng, 1)
            text = " ".join(words)
        rows.append((i, text, rng.choice(["en", "de"]), rng.choice(["s1", "s2", "s2", "s2", "s3", None]), len(text)))
    return rows


def docs_frame(spark, rows):
    return spark.createDataFrame(rows, DOC_SCHEMA)


def words(text: str | None) -> list[str]:
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low)


def crc(doc_id) -> int:
    return zlib.crc32(str(doc_id).encode())


def components(nodes, links) -> dict:
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def write_tables(folder, spark, **tables):
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return str(folder)
