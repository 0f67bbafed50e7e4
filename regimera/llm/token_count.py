"""Word-piece counts by a linear longest-match automaton.

Greedy longest-match tokenisation splits a word into the longest vocabulary piece that starts it, then the longest
continuation piece, and so on. The automaton is a trie over the vocabulary with failure links: where the next byte
has no edge, the pieces that are settled by then are popped and matching goes on at the failure node, so each byte is
read once. As only lengths are asked for, each node stores how many pieces its failure step pops; no piece is built.

The vocabulary is a byte-level one: pieces with the word mark start a word, the others continue it. A word for which
no split exists counts as one unknown token, as is usual for word pieces. Words are runs of anything but the six ASCII
white-space characters.

Rows are independent: no shuffle, the trie is broadcast (its size is that of the vocabulary), a bounded memo of word
lengths lives in each worker task. Cases: null, empty and blank texts have 0 words and 0 tokens; repeated rows are
counted each; an empty table gives an empty result; a very long text costs memory for its words only.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship

MARK = 256  # the symbol that precedes a word's first byte
MEMO_WORDS = 300_000


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable Latin-1 stands for itself, the rest follow from U+0100."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


def load_vocabulary(path: str) -> tuple[list[bytes], list[bytes]]:
    """(pieces that start a word, pieces that continue one) of a byte-level vocabulary file in JSON."""
    with open(path, encoding="utf-8") as f:
        names = json.load(f)["model"]["vocab"]
    alphabet = byte_alphabet()
    first, later = [], []
    for name in names:
        raw = bytes(alphabet[c] for c in name if c in alphabet)
        if len(raw) != len(name):
            continue
        if raw[:1] == b" ":
            first.append(raw[1:])
        else:
            later.append(raw)
    return first, later


class Lengths(dict):
    """word (bytes) -> number of pieces, computed on demand; the memo is emptied when full."""

    def __init__(self, first: Iterable[bytes], later: Iterable[bytes], memo: int = MEMO_WORDS):
        super().__init__()
        self.memo = memo
        edges: dict[int, int] = {}
        token: list[bool] = [False, False]  # node 0: before a word; node 1: before a continuation
        kids: list[list[int]] = [[], []]

        def insert(node: int, symbols: Iterable[int]) -> None:
            for c in symbols:
                key = node * 257 + c
                nxt = edges.get(key)
                if nxt is None:
                    nxt = edges[key] = len(token)
                    token.append(False)
                    kids.append([])
                    kids[node].append(c)
                node = nxt
            token[node] = True

        for piece in first:
            insert(0, chain((MARK,), piece))
        for piece in later:
            if piece:
                insert(1, piece)
        fail, popped = [-1] * len(token), [0] * len(token)
        queue = [0, 1]
        for u in queue:  # breadth first: a failure link points to a shallower node
            for c in kids[u]:
                v = edges[u * 257 + c]
                queue.append(v)
                if token[v]:
                    fail[v], popped[v] = 1, 1
                    continue
                z, n = fail[u], popped[u]
                while z >= 0 and z * 257 + c not in edges:
                    n += popped[z]
                    z = fail[z]
                if z >= 0:
                    fail[v], popped[v] = edges[z * 257 + c], n
        self.edges, self.fail, self.popped = edges, fail, popped

    def __missing__(self, word: bytes) -> int:
        n = self.count(word)
        if len(self) >= self.memo:
            self.clear()
        self[word] = n
        return n

    def count(self, word: bytes) -> int:
        edges, fail, popped = self.edges, self.fail, self.popped
        u, n = 0, 0
        for c in chain((MARK,), word):
            nxt = edges.get(u * 257 + c)
            while nxt is None:
                n += popped[u]
                u = fail[u]
                if u < 0:
                    return 1
                nxt = edges.get(u * 257 + c)
            u = nxt
        while u != 1:
            n += popped[u]
            u = fail[u]
            if u < 0:
                return 1
        return n


_last: list = [None, 0, None]


def lengths_of(shared, memo: int = MEMO_WORDS) -> Lengths:
    """One automaton for a broadcast vocabulary in a worker process, which outlives its tasks; only the last is kept."""
    if _last[0] is not shared.value or _last[1] != memo:
        _last[:] = [shared.value, memo, Lengths(*shared.value, memo)]
    return _last[2]


def count_tokens(docs: DataFrame, vocabulary: tuple[list[bytes], list[bytes]], memo: int = MEMO_WORDS) -> DataFrame:
    """(doc_id, n_words, n_tokens) for each row of docs."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = lengths_of(shared, memo)
        look = lengths.__getitem__
        for batch in batches:
            n_words, n_tokens = [], []
            for text in batch.column(1):
                words = (text.as_py() or "").encode("utf-8", "surrogatepass").split()
                n_words.append(len(words))
                n_tokens.append(sum(map(look, words)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_tokens, pa.int64())], ["doc_id", "n_words", "n_tokens"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, n_words bigint, n_tokens bigint")
