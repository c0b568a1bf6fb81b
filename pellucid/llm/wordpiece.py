"""Greedy word-piece counts in linear time, without building pieces.

The vocabulary is a trie whose nodes carry a failure link and the number of pieces that are popped when
it is followed: the trie's longest entry that the node's string begins with is popped, and what is left
stands where the link leads. A word costs one step per byte plus the links that it follows,
however often greedy longest-match would start again. (The scheme is Song et al., "Fast WordPiece
Tokenization", 2021; counts stand for the lists of pieces.)

Words are runs of other than ASCII white space, ASCII letters folded; a word ends in a mark of its own, so that entries
for the end of a word and for its inside differ. Words that cannot be covered count as one piece.

Nulls, ties, repeats: a null or empty text has no word and no piece. Repeated rows get equal results. An empty
table gives an empty result. Distinct words are kept in a bounded memory per process.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pellucid.llm.common import process_state, sliced

#: The end mark among a node's edges; bytes are 0 to 255.
END = 256
#: Words that a process remembers at most, and bytes of a word that it may remember.
CACHED, CACHED_LENGTH = 800_000, 48


class Automaton:
    def __init__(self, entries: Iterable[tuple[int, ...]]):
        """entries: sequences of edges (bytes, or END as the last)."""
        self.next: list[dict[int, int]] = [{}]
        final = [False]
        for entry in entries:
            node = 0
            for c in entry:
                if c not in self.next[node]:
                    self.next[node][c] = len(self.next)
                    self.next.append({})
                    final.append(False)
                node = self.next[node][c]
            final[node] = True
        final[0] = False
        #: Where the rest stands after the node's pops (-1: it can't be covered), and how many pieces are popped.
        self.link, self.pops = [-1] * len(self.next), [0] * len(self.next)
        queue = deque([0])
        while queue:
            parent = queue.popleft()
            for c, node in self.next[parent].items():
                queue.append(node)
                if final[node]:
                    self.link[node], self.pops[node] = 0, 1
                    continue
                at, popped = self.link[parent], self.pops[parent]
                while at >= 0 and c not in self.next[at]:
                    popped += self.pops[at]
                    at = self.link[at]
                if at >= 0:
                    self.link[node], self.pops[node] = self.next[at][c], popped

    def count(self, word: bytes) -> int:
        """Pieces of a word."""
        step, link, pops = self.next, self.link, self.pops
        node, n = 0, 0
        for c in (*word, END):
            while c not in step[node]:
                n += pops[node]
                node = link[node]
                if node < 0:
                    return 1
            node = step[node][c]
        while node:
            n += pops[node]
            node = link[node]
            if node < 0:
                return 1
        return n


def greedy(word: bytes, entries: set[tuple[int, ...]]) -> int:
    """The same count by longest match from each place, for tests."""
    s, at, n = (*word, END), 0, 0
    while at < len(s):
        end = next((e for e in range(len(s), at, -1) if s[at:e] in entries), None)
        if end is None:
            return 1
        at, n = end, n + 1
    return n


def read_entries(path: str) -> list[tuple[int, ...]]:
    """The vocabulary of a tokenizers file with word ends, as edges; its byte alphabet is undone."""
    from pellucid.llm.encoding import _byte_alphabet

    spec = json.load(open(path, encoding="utf-8"))
    mark, special = spec["model"]["end_of_word_suffix"], {t["content"] for t in spec["added_tokens"]}
    back = {c: b for b, c in _byte_alphabet().items()}
    out = []
    for piece in spec["model"]["vocab"]:
        if piece not in special:
            ends = piece.endswith(mark) and piece != mark
            body = tuple(back[c] for c in (piece[: -len(mark)] if ends else piece))
            out.append((*body, END) if ends else body)
    return out


def _counted(path: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto, known = process_state(("automaton", path), lambda: (Automaton(read_entries(path)), {}))
        for batch in sliced(batches):
            words, pieces = [], []
            for text in batch.column("text").to_pylist():
                w = (text or "").encode("utf-8", "surrogatepass").lower().split()
                got = list(map(known.get, w))
                if None in got:
                    if len(known) > CACHED:
                        known.clear()
                    new = {x: auto.count(x) for x in {x for x, n in zip(w, got) if n is None}}
                    known.update((x, n) for x, n in new.items() if len(x) <= CACHED_LENGTH)
                    got = [new[x] if n is None else n for x, n in zip(w, got)]
                words.append(len(w))
                pieces.append(sum(got))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(words, pa.int64()), pa.array(pieces, pa.int64())], names=["doc_id", "n_words", "n_pieces"])

    return run


def token_counts(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_words and n_pieces of every row."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_counted(vocabulary), "doc_id long, n_words long, n_pieces long")
