"""Token counts by a linear longest-match automaton.

The vocabulary's pieces form a trie over bytes and one end-of-word symbol. A failure link of a node leads to the node
of what is left when greedy longest-match pieces are popped from the node's string, and the node stores how many
pieces that pops. A word is read once, byte by byte: its number of greedy pieces is the sum of the counts popped on
the way, and no piece is ever built.

Edge cases: a null, empty or blank text has no words and no tokens; a word that cannot be covered counts one token; a
very long text or word is read once, symbol by symbol, and long words are not remembered; repeated rows are counted
each; an empty table gives no rows; columns of the input named as an added one are replaced, others stay whatever their
names.
"""

from __future__ import annotations

import json
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from jobtide.llm.batches import Texts, add_columns

END = 256
#: Word counts that a worker remembers.
CACHED = 300_000
CACHED_BYTES = 48


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable Latin-1 as it is, the rest from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


def read_pieces(path: str, end: str = "</w>") -> list[tuple[int, ...]]:
    """The pieces of a byte-level vocabulary with word ends, as symbols; special tokens are left out."""
    with open(path, encoding="utf-8") as f:
        found = json.load(f)
    special = {t["content"] for t in found["added_tokens"]}
    symbols = byte_alphabet()
    out = []
    for piece in found["model"]["vocab"]:
        if piece not in special:
            closed = piece.endswith(end)
            out.append((*(symbols[c] for c in piece.removesuffix(end)), *([END] if closed else [])))
    return out


class Automaton:
    def __init__(self, pieces: list[tuple[int, ...]]):
        self.goto: dict[int, int] = {}
        whole, children = [False], [[]]
        for piece in pieces:
            node = 0
            for c in piece:
                key = node * 257 + c
                if key not in self.goto:
                    self.goto[key] = len(whole)
                    children[node].append(c)
                    whole.append(False)
                    children.append([])
                node = self.goto[key]
            whole[node] = True
        goto = self.goto
        self.fail, self.popped = fail, popped = [-1] * len(whole), [0] * len(whole)
        queue = deque([0])
        while queue:
            parent = queue.popleft()
            for c in children[parent]:
                node = goto[parent * 257 + c]
                queue.append(node)
                if whole[node]:
                    fail[node], popped[node] = 0, 1
                    continue
                back, count = fail[parent], popped[parent]
                while back >= 0 and back * 257 + c not in goto:
                    count += popped[back]
                    back = fail[back]
                if back >= 0:
                    fail[node], popped[node] = goto[back * 257 + c], count

    def count(self, word: bytes) -> int:
        goto, fail, popped = self.goto.get, self.fail, self.popped
        node = n = 0
        for c in (*word, END):
            while (to := goto(node * 257 + c)) is None:
                n += popped[node]
                node = fail[node]
                if node < 0:
                    return 1
            node = to
        while node:
            n += popped[node]
            node = fail[node]
            if node < 0:
                return 1
        return n


def count_tokens(df: DataFrame, path: str, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """df with n_words (runs of other than white space, A-Z lower-cased) and n_tokens, their greedy pieces."""
    shared = df.sparkSession.sparkContext.broadcast(read_pieces(path))

    def factory(held):
        # one for each worker process, with the word counts that it remembers
        automaton, known = held(path, lambda: (Automaton(shared.value), {}))

        def process(texts: Texts) -> list:
            words = np.zeros(len(texts), np.int64)
            tokens = np.zeros(len(texts), np.int64)
            for i in range(len(texts)):
                found = texts.bytes(i).lower().split()
                words[i] = len(found)
                total = 0
                for word in found:
                    n = known.get(word)
                    if n is None:
                        n = automaton.count(word)
                        if len(word) <= CACHED_BYTES:
                            if len(known) >= CACHED:
                                known.clear()
                            known[word] = n
                    total += n
                tokens[i] = total
            return [pa.array(words), pa.array(tokens)]

        return process

    return add_columns(df, text_col, "n_words long, n_tokens long", factory, keep)
