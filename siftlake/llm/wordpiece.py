"""Token counts by a linear longest-match automaton.

The pieces of a vocabulary form one trie with two roots: for pieces that start a word and for pieces inside it. A node
whose path is no piece has a failure link to the node where matching goes on once the longest pieces of its path are
taken, and the count of the pieces so taken ("popped"). A word is read once, left to right; wherever the trie has no
next step, the popped count of the node is added and its link followed. So the number of pieces that greedy
longest-match would give is found in linear time, and no piece is built.

Words are runs without ASCII white space, taken as UTF-8 bytes. A word that the vocabulary can't cover counts as one
token (unknown). Counts of words already seen come from a bounded cache.

Cases: null and empty texts have no words and no tokens; repeated rows give repeated results; a null doc_id is kept;
columns other than doc_id and text are not read; an empty vocabulary makes every word unknown.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame

from siftlake.llm.bpe import byte_letters, default_vocabulary
from siftlake.llm.textkernel import string_column

CACHE_WORDS = 250_000
CACHE_BYTES = 48
ROWS = 512


class Automaton:
    """Counts the pieces of words. initial: pieces that start a word; inside: pieces that go on."""

    START, INSIDE = 0, 1

    def __init__(self, initial: Iterable[bytes], inside: Iterable[bytes]) -> None:
        self.next: dict[int, int] = {}
        self.piece = [False, False]
        self.cache: dict[bytes, int] = {}
        for root, pieces in ((self.START, initial), (self.INSIDE, inside)):
            for p in pieces:
                if p:
                    self._add(root, p)
        self._link()

    def _add(self, node: int, piece: bytes) -> None:
        for byte in piece:
            key = node << 8 | byte
            if key not in self.next:
                self.next[key] = len(self.piece)
                self.piece.append(False)
            node = self.next[key]
        self.piece[node] = True

    def _link(self) -> None:
        """Failure links and popped counts, nodes nearer to a root first."""
        children: list[list[tuple[int, int]]] = [[] for _ in self.piece]
        for key, child in self.next.items():
            children[key >> 8].append((key & 255, child))
        self.fail, self.popped = [-1] * len(self.piece), [0] * len(self.piece)
        level = [self.START, self.INSIDE]
        while level:
            below = []
            for node in level:
                for byte, child in children[node]:
                    below.append(child)
                    if self.piece[child]:
                        self.fail[child], self.popped[child] = self.INSIDE, 1
                        continue
                    at, taken = self.fail[node], self.popped[node]
                    while at >= 0 and (at << 8 | byte) not in self.next:
                        taken += self.popped[at]
                        at = self.fail[at]
                    if at >= 0:
                        self.fail[child], self.popped[child] = self.next[at << 8 | byte], taken
            level = below

    def count(self, word: bytes) -> int:
        """The number of greedy longest-match pieces of a word; 1 if it can't be covered."""
        step, fail, popped = self.next, self.fail, self.popped
        node = total = 0
        for byte in word:
            while (to := step.get(node << 8 | byte)) is None:
                total += popped[node]
                node = fail[node]
                if node < 0:
                    return 1
            node = to
        while node != self.INSIDE:
            if node < 0 or fail[node] < 0:
                return 1
            total += popped[node]
            node = fail[node]
        return total

    def count_all(self, texts: list[str]) -> tuple[list[int], list[int]]:
        """Words and tokens of each text."""
        words = [t.encode().split() for t in texts]
        if len(self.cache) > CACHE_WORDS:
            self.cache = {}
        cache = self.cache
        new = set().union(*words).difference(cache)
        cache |= {w: self.count(w) for w in new}
        out = [len(w) for w in words], [sum(map(cache.__getitem__, w)) for w in words]
        for w in new:
            if len(w) > CACHE_BYTES:
                del cache[w]
        return out


def pieces(content: str) -> tuple[list[bytes], list[bytes]]:
    """Pieces that start a word and pieces inside, of a byte-level vocabulary (JSON) or of a list of lines with ## inside.

    In a byte-level vocabulary a piece that starts a word begins with a space, which is left off here; the space alone
    is no piece of a word. Pieces that hold white space elsewhere can't match and are left out.
    """
    if content.lstrip().startswith("{"):
        letters = byte_letters()
        every = [bytes(letters[c] for c in token) for token in json.loads(content)["model"]["vocab"]]
        initial, inside = [p[1:] for p in every if p[:1] == b" "], [p for p in every if p[:1] != b" "]
        # A word's first byte may always stand alone, as it may after the lone space.
        initial += [p for p in inside if len(p) == 1]
    else:
        lines = [x for x in content.split("\n") if x]
        initial, inside = [x.encode() for x in lines if not x.startswith("##")], [x[2:].encode() for x in lines if x.startswith("##")]
    plain = lambda ps: [p for p in ps if p and len(p.split()) == 1 and p.split()[0] == p]
    return plain(initial), plain(inside)


_LOADED: dict[int, Automaton] = {}


def token_counts(documents: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, n_words, n_tokens of each document."""
    sent = documents.sparkSession.sparkContext.broadcast(Path(vocabulary or default_vocabulary()).read_text())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = hash(sent.value)
        if key not in _LOADED:
            _LOADED.clear()
            _LOADED[key] = Automaton(*pieces(sent.value))
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS):
                part = batch.slice(k, ROWS)
                words, tokens = _LOADED[key].count_all(string_column(part, "text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], ["doc_id", "n_words", "n_tokens"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, n_words long, n_tokens long")


def op3_token_counts(documents: DataFrame, vocabulary: str | None = None) -> DataFrame:
    return token_counts(documents, vocabulary)
