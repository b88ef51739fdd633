"""Token counts by a linear longest-match automaton (operator 4).

The pieces of a vocabulary form a trie over bytes. Each node carries a failure link, to the
node reached after the pieces that greedy longest match takes off the front are popped, and
the number of pieces popped on the way. A word is read once, byte by byte, and its number of
greedy pieces is a sum of pop counts; no piece is built.

A word of the text is matched with a leading space, as byte-level vocabularies have it. All
256 bytes must be pieces, so that every word has a count.
"""

from __future__ import annotations

import base64
import json
from collections import deque

from pyspark.sql import DataFrame

from punctuality.llm.texts import Remembered, map_rows, words_of

VOCABULARY = "byte_bpe_50k.json"
SCHEMA = "doc_id long, n_bytes long, n_words long, n_pieces long, longest_word_pieces long"


def byte_symbols() -> dict[str, int]:
    """Printable stand-ins of bytes in byte-level vocabularies, by their public rule."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    moved = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(moved)}


def pieces_of(path: str) -> list[bytes]:
    """Pieces of a byte-level vocabulary, in either public file format."""
    if path.endswith(".tiktoken"):
        with open(path, "rb") as lines:
            return [base64.b64decode(line.split()[0]) for line in lines if line.strip()]
    with open(path, encoding="utf-8") as file:
        content = json.load(file)
    special = {x["content"] for x in content.get("added_tokens", ())}
    symbols = byte_symbols()
    return [bytes(symbols[c] for c in piece) for piece in content["model"]["vocab"] if piece not in special]


class LongestMatch:
    """Trie with failure links and pop counts over byte pieces."""

    def __init__(self, pieces: list[bytes]):
        self.next: list[dict[int, int]] = [{}]
        whole = [False]
        for piece in pieces:
            node = 0
            for byte in piece:
                child = self.next[node].get(byte)
                if child is None:
                    child = self.next[node][byte] = len(self.next)
                    self.next.append({})
                    whole.append(False)
                node = child
            whole[node] = node != 0
        missing = [b for b in range(256) if not whole[self.next[0].get(b, 0)]]
        if missing:
            raise ValueError(f"{len(missing)} single bytes are no pieces, {missing[0]} among them")
        self.fail, self.pops = [-1] * len(self.next), [0] * len(self.next)
        waiting = deque([0])
        while waiting:
            node = waiting.popleft()
            for byte, child in self.next[node].items():
                waiting.append(child)
                if whole[child]:
                    self.fail[child], self.pops[child] = 0, 1
                    continue
                at, popped = self.fail[node], self.pops[node]
                while at >= 0 and byte not in self.next[at]:
                    at, popped = self.fail[at], popped + self.pops[at]
                if at >= 0:
                    self.fail[child], self.pops[child] = self.next[at][byte], popped

    def count(self, word: bytes) -> int:
        step, fail, pops, at, total = self.next, self.fail, self.pops, 0, 0
        for byte in word:
            while byte not in step[at]:
                total += pops[at]
                at = fail[at]
            at = step[at][byte]
        while at:
            total += pops[at]
            at = fail[at]
        return total


def greedy_count(pieces: set[bytes], word: bytes) -> int:
    """The same number the long way, for tests."""
    at = total = 0
    while at < len(word):
        at = next(end for end in range(len(word), at, -1) if word[at:end] in pieces)
        total += 1
    return total


def token_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Greedy piece counts of every whole text.

    A null or empty text has zero words and pieces. Rows come out one for one, repeated and
    null ids included; other columns of ``docs`` are ignored.
    """

    def start():
        import public_tokenizers

        automaton = LongestMatch(pieces_of(path or public_tokenizers.path(VOCABULARY)))
        lengths = Remembered(lambda word: automaton.count(b" " + word))

        def each(doc_id, text):
            words = words_of(text)
            counts = list(map(lengths.__getitem__, words))
            size = len(text.encode("utf-8", "replace")) if text else 0
            yield doc_id, size, len(words), sum(counts), max(counts, default=0)

        return each

    return map_rows(docs.select("doc_id", "text"), start, SCHEMA)
