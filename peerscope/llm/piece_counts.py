"""Numbers of greedy longest-match pieces of whole texts, without building the pieces.

A trie of the vocabulary gets, for every node, a failure link and the number of tokens that are popped on the way: when the next
character does not go on from a node, the longest matches that its string begins with are counted and the automaton
stands where the rest of that string leads. Each character is read once, so a word of any length takes linear time.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peerscope.llm.common import WORD
from peerscope.llm.pieces import MARK, load_pieces


class LongestMatch:
    """Greedy longest-match counts. Characters that begin no match count as their UTF-8 bytes."""

    def __init__(self, vocabulary: list[str]):
        self.next: dict[tuple[int, str], int] = {}
        weight, parent, last = [0], [0], [""]  # by node; weight: tokens of a match that ends here, 0 if none does

        def child(node: int, c: str) -> int:
            if (node, c) not in self.next:
                self.next[node, c] = len(weight)
                weight.append(0)
                parent.append(node)
                last.append(c)
            return self.next[node, c]

        for c in sorted({c for piece in vocabulary for c in piece}):
            weight[child(0, c)] = len(c.encode())
        for piece in vocabulary:
            node = 0
            for c in piece:
                node = child(node, c)
            weight[node] = 1
        depth = [0] * len(weight)
        for node in range(1, len(weight)):
            depth[node] = depth[parent[node]] + 1
        self.popped, self.fail = [0] * len(weight), [0] * len(weight)
        for node in sorted(range(1, len(weight)), key=depth.__getitem__):
            if weight[node]:
                self.popped[node] = weight[node]
                continue
            total, at = self.popped[parent[node]], self.fail[parent[node]]
            while (at, last[node]) not in self.next:  # the root goes on with every character of the vocabulary
                total, at = total + self.popped[at], self.fail[at]
            self.popped[node], self.fail[node] = total, self.next[at, last[node]]

    def __call__(self, word: str) -> int:
        go, popped, fail = self.next, self.popped, self.fail
        total = node = 0
        for c in word:
            to = go.get((node, c))
            while to is None and node:
                total, node = total + popped[node], fail[node]
                to = go.get((node, c))
            if to is None:
                total += len(c.encode())
            else:
                node = to
        while node:
            total, node = total + popped[node], fail[node]
        return total


@lru_cache(maxsize=2)
def automaton(model: str) -> LongestMatch:
    return LongestMatch(list(load_pieces(model).ids))


def piece_counts(docs: DataFrame, model: str, doc_id: str = "doc_id", text: str = "text", limit: int = 400_000) -> DataFrame:
    """One row per document: doc_id, n_words, n_tokens.

    Words are runs without white space, each with the vocabulary's mark for a blank before it. Null and empty texts have none.
    Counts of words are remembered up to ``limit`` words. Repeated rows repeat; an empty table gives no rows; further columns are ignored.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match, known = automaton(model), {}
        for batch in batches:
            n_words, n_tokens = [], []
            for body in batch.column(1):
                words = WORD.findall(body.as_py() or "")
                if len(known) > limit:
                    known.clear()
                for word in set(words).difference(known):
                    known[word] = match(MARK + word)
                n_words.append(len(words))
                n_tokens.append(sum(map(known.__getitem__, words)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_tokens, pa.int64())], ["doc_id", "n_words", "n_tokens"])

    return docs.select(F.col(doc_id).cast("long"), F.col(text)).mapInArrow(count, "doc_id long, n_words long, n_tokens long")
