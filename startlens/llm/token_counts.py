"""Unigram token counts with a shared trie of pre-tokens (operator 2).

The vocabulary is a public file of byte pieces in rank order; a piece of
rank r scores ``-ln(r + 1)`` (Zipf's law), and a pre-token is cut into the
pieces of greatest total score, of equal ones into the fewest. Nothing is
trained.

The best score at a place of a pre-token depends only on the bytes before it,
so pre-tokens that share a prefix share its forward scores. Each task holds a
trie of its distinct pre-tokens: a new one goes down the nodes that are there,
every node that it adds is scored once, from the scores on the way to it, and
the count at its last node, the terminal, is stored for the pre-token. A trie is
begun anew beyond ``MAX_NODES`` nodes. Of a pre-token longer than ``SHARED``
bytes the trie holds that prefix; the forward scores of the rest are its own and
only the last few are held, so a text of one long word needs little memory.

A pre-token is an optional space and a run of other than white space, or a run of
white space before it; together they are the whole text. Every byte is a piece, so
every text can be cut. Null and empty texts have 0 tokens.
"""

from __future__ import annotations

import base64
import math
import re
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from startlens.llm.text import small_batches

PRE_TOKEN = re.compile(rb" ?[^ \t-\r]+|[ \t-\r]+?(?= [^ \t-\r])|[ \t-\r]+")
MAX_NODES = 1 << 20
SHARED = 1024


def load_pieces(path: str) -> dict[bytes, float]:
    """Scores of the pieces of a rank file (base64 piece and rank per line)."""
    with open(path, "rb") as f:
        return {base64.b64decode(piece): -math.log(int(rank) + 1) for piece, rank in map(bytes.split, f)}


class PieceTrie:
    """Trie of pre-tokens whose nodes hold the best cut of their prefix.

    Nodes are numbers, the root is 0: ``child`` finds a node by its parent and
    byte, ``score`` and ``cuts`` hold the score and number of pieces, and
    ``terminal`` the counts of the pre-tokens that were inserted."""

    def __init__(self, pieces: dict[bytes, float]):
        self.pieces = pieces
        self.longest = max(map(len, pieces))
        lengths: list[set] = [set() for _ in range(256)]
        for p in pieces:
            lengths[p[-1]].add(len(p))
        # lengths of the pieces that end in a byte
        self.by_last = [sorted(x) for x in lengths]
        self.clear()

    def clear(self) -> None:
        self.child: dict[int, int] = {}
        self.score, self.cuts = array("d", [0.0]), array("q", [0])
        self.terminal: dict[bytes, int] = {}
        # the way to the last pre-token: nodes, scores and numbers of pieces
        self.word, self.path, self.scores, self.pieces_to = b"", [0], [0.0], [0]

    def __len__(self) -> int:
        """Nodes below the root."""
        return len(self.score) - 1

    def _extend(self, word: bytes, end: int, scores: list[float], numbers: list[int], first: int) -> None:
        """Append the best cut of ``word[:end]``; the lists hold those from ``first`` to end - 1 bytes."""
        best, fewest, get = -math.inf, 0, self.pieces.get
        for size in self.by_last[word[end - 1]]:
            if size > end:
                break
            score = get(word[end - size : end])
            if score is not None:
                at = end - size - first
                score += scores[at]
                if score > best or (score == best and numbers[at] + 1 < fewest):
                    best, fewest = score, numbers[at] + 1
        scores.append(best)
        numbers.append(fewest)

    def insert(self, word: bytes) -> int:
        """Pieces in the best cut of ``word``; sorted pre-tokens share the way too."""
        shared, most = 0, min(len(word), len(self.path) - 1)
        while shared < most and word[shared] == self.word[shared]:
            shared += 1
        path, scores, numbers, child = self.path, self.scores, self.pieces_to, self.child
        del path[shared + 1 :], scores[shared + 1 :], numbers[shared + 1 :]
        node = path[-1]
        for end in range(shared + 1, min(len(word), SHARED) + 1):
            key = node << 8 | word[end - 1]
            node = child.get(key)
            if node is None:
                self._extend(word, end, scores, numbers, 0)
                node = child[key] = len(self.score)
                self.score.append(scores[-1])
                self.cuts.append(numbers[-1])
            else:
                scores.append(self.score[node])
                numbers.append(self.cuts[node])
            path.append(node)
        self.word = word[:SHARED]
        if len(word) <= SHARED:
            self.terminal[word] = numbers[-1]
            return numbers[-1]
        scores, numbers, first = scores[-self.longest :], numbers[-self.longest :], max(0, SHARED + 1 - self.longest)
        for end in range(SHARED + 1, len(word) + 1):
            self._extend(word, end, scores, numbers, first)
            if len(scores) > 8192:
                first += len(scores) - self.longest
                del scores[: -self.longest], numbers[: -self.longest]
        return numbers[-1]

    def counts(self, words: set[bytes]) -> dict[bytes, int]:
        """Insert the pre-tokens that have no terminal yet: their numbers of pieces."""
        if len(self) > MAX_NODES:
            self.clear()
        return {w: self.insert(w) for w in sorted(words.difference(self.terminal))}


def token_counts(spark: SparkSession, text: Column, vocabulary: str) -> Column:
    """struct(n_tokens, n_pretokens) of a text column. ``vocabulary`` is the path
    of the rank file, read on the driver and broadcast (under 1 MB)."""
    small_batches(spark)
    shared = spark.sparkContext.broadcast(load_pieces(vocabulary))

    @F.arrow_udf("struct<n_tokens:long,n_pretokens:long>")
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        trie = PieceTrie(shared.value)
        for b in batches:
            tokens, pre = [], []
            texts = b.to_pylist()
            for lo in range(0, len(texts), 256):
                cut = [PRE_TOKEN.findall(t.encode()) if t else [] for t in texts[lo : lo + 256]]
                new = trie.counts({w for ws in cut for w in ws})
                known, long = trie.terminal, {w: n for w, n in new.items() if len(w) > SHARED}
                count = known.__getitem__ if not long else lambda w: long[w] if w in long else known[w]
                for ws in cut:
                    tokens.append(sum(map(count, ws)))
                    pre.append(len(ws))
            yield pa.StructArray.from_arrays([pa.array(tokens, pa.int64()), pa.array(pre, pa.int64())], ["n_tokens", "n_pretokens"])

    return count(text)
