"""Token counts by a longest-match automaton that never goes back in a word.

The vocabulary's trie gets failure links for greedy longest match: where no
child fits, the tokens that greedy matching would cut off are known as a number
beforehand, and matching goes on at the node of what is left.  A word takes
time in proportion to its length, and no piece is ever built.
"""

from __future__ import annotations

import base64
from collections import deque
from collections.abc import Iterable

import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hirelake.llm.common import small_batches

#: Words of a text: letters, digits or signs with the space before them, and other white space.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Vocabulary entries that may be broadcast.
MAX_ENTRIES = 2_000_000
#: Words whose counts a worker remembers.
REMEMBERED = 400_000


def read_vocabulary(spark: SparkSession, path: str) -> list[bytes]:
    """Entries of a file with a base64 token at the start of each line."""
    lines = spark.read.text(path).where("value <> ''").limit(MAX_ENTRIES + 1).collect()
    return [base64.b64decode(line.value.split(" ")[0]) for line in lines]


class LongestMatch:
    """Trie over bytes: children by (node << 8 | byte), failure node, popped tokens."""

    def __init__(self, vocabulary: Iterable[bytes]):
        self.known: _Counts | None = None
        children: dict[int, int] = {}
        token = [False]
        below: list[list[tuple[int, int]]] = [[]]
        for entry in vocabulary:
            node = 0
            for byte in entry:
                step = node << 8 | byte
                if step not in children:
                    children[step] = len(token)
                    below[node].append((byte, len(token)))
                    token.append(False)
                    below.append([])
                node = children[step]
            token[node] = True
        token[0] = False
        self.children, self.fail, self.pops = children, [-1] * len(token), [0] * len(token)
        queue = deque([0])
        while queue:
            parent = queue.popleft()
            for byte, node in below[parent]:
                queue.append(node)
                if token[node]:
                    self.fail[node], self.pops[node] = 0, 1
                    continue
                at, popped = self.fail[parent], self.pops[parent]
                while at >= 0 and at << 8 | byte not in children:
                    popped += self.pops[at]
                    at = self.fail[at]
                if at >= 0:
                    self.fail[node], self.pops[node] = children[at << 8 | byte], popped

    def count(self, word: bytes) -> int:
        """Tokens of greedy longest match; a word it can't cover is one unknown token."""
        children, fail, pops = self.children, self.fail, self.pops
        node = total = 0
        for byte in word:
            while (child := children.get(node << 8 | byte)) is None:
                total += pops[node]
                node = fail[node]
                if node < 0:
                    return 1
            node = child
        while node:
            total += pops[node]
            node = fail[node]
            if node < 0:
                return 1
        return total


class _Counts(dict):
    """Counts of words seen before."""

    def __init__(self, matcher: LongestMatch):
        super().__init__()
        self.matcher = matcher

    def __missing__(self, word: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        count = self[word] = self.matcher.count(word.encode())
        return count


def token_counts(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_tokens) of every row's whole text.

    ``vocabulary`` is the path of the token file.  A null or empty text has
    none; repeated rows get equal rows; no rows give none.  Only ``key`` and
    ``text`` are read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    entries = read_vocabulary(spark, vocabulary)
    if len(entries) > MAX_ENTRIES:
        raise ValueError(f"more than {MAX_ENTRIES} vocabulary entries")
    shared = spark.sparkContext.broadcast(LongestMatch(entries))
    words = regex.compile(WORDS)

    @F.pandas_udf("n_words long, n_tokens long")
    def count(texts: pd.Series) -> pd.DataFrame:
        matcher = shared.value
        if matcher.known is None:  # kept by the worker with its copy of the automaton
            matcher.known = _Counts(matcher)
        counts = matcher.known
        out = []
        for body in texts:
            found = words.findall(body or "")
            out.append((len(found), sum(map(counts.__getitem__, found))))
        return pd.DataFrame(out, columns=["n_words", "n_tokens"])

    counted = docs.select(F.col(key).alias("doc_id"), count(F.col(text).cast("string")).alias("n"))
    return counted.select("doc_id", "n.n_words", "n.n_tokens")
