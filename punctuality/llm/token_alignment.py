"""Cross-tokenizer alignment by interval coalescing (operator 11).

Two tokenizers cut the bytes of ``" " + text`` in two ways. All tokens of both, sorted by their
first byte, are coalesced: a token that starts where the running maximum of all ends so far has
been reached opens a new group. Within a group every A token is linked with each B token whose
bytes it shares. A pair of ids counts once for each document that links it, over all documents.

The counts are gathered without sending a pair per document. A task works through its texts in
blocks; a block keeps the distinct pairs of each document as places in the block's own sorted
dictionary, and only dictionaries are shuffled: counted by pair, given the highest count of
their A id (a table with one row per id of the vocabulary), and sent back to their block.

Defined results:

* A null or empty text, and a text whose joined A or B bytes are not those of ``" " + text``
  (such as one with U+2581), has no tokens: all numbers are 0 and ``groups_sha256`` is ''.
* Rows stay rows: repeated ids and repeated texts get one row each, null ids keep theirs, and
  each row counts as a document of its own. No rows give no rows.
* Only ``doc_id`` and ``text`` are read; other columns, whatever their names, play no part.
* Memory: a task holds one block (``links`` distinct links of documents, or one longer text).
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from punctuality.llm.texts import shared, small_batches

BYTES_FILE, PIECES_FILE = "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"
#: Distinct links of a block's documents, characters that are aligned at once, and pairs of a
#: dictionary that make one row.
BLOCK_LINKS, SLICE_CHARS, DICTIONARY_ROW = 6_000_000, 2_000_000, 1 << 16
_SPACE = "▁"

_BLOCKS = pa.schema(
    [
        ("block", pa.int64()),
        ("doc_id", pa.int64()),
        ("n_a", pa.int64()),
        ("n_b", pa.int64()),
        ("n_groups", pa.int64()),
        ("n_links", pa.int64()),
        ("groups_sha256", pa.string()),
        ("places", pa.binary()),
        ("times", pa.binary()),
        ("pairs", pa.list_(pa.int64())),
        ("docs", pa.list_(pa.int32())),
    ]
)
_BLOCKS_DDL = (
    "block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string,"
    " places binary, times binary, pairs array<long>, docs array<int>"
)
DIGEST = (
    "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
)


class Tokenizers(NamedTuple):
    """Two tokenizers with the bytes of their tokens and the texts of their ids."""

    a: object
    b: object
    a_bytes: list[bytes]
    b_bytes: list[bytes]
    a_sizes: np.ndarray
    b_sizes: np.ndarray
    names: list[str]  # "id," and "id|" for A, "id," and "id;" for B

    def cut(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        return (
            [self.a.encode_ordinary(" " + t) for t in texts],
            self.b.encode(texts, num_threads=1),
        )


@functools.cache
def tokenizers(bytes_path: str | None = None, pieces_path: str | None = None) -> Tokenizers:
    """One pair of tokenizers for all tasks of a Python worker."""
    import base64

    import public_tokenizers
    import sentencepiece
    import tiktoken

    with open(bytes_path or public_tokenizers.path(BYTES_FILE), "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    a = tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    b = sentencepiece.SentencePieceProcessor(model_file=pieces_path or public_tokenizers.path(PIECES_FILE))
    a_bytes = [b""] * (1 + max(ranks.values()))
    for token, rank in ranks.items():
        a_bytes[rank] = token
    b_bytes = []
    for i in range(b.get_piece_size()):
        piece = b.id_to_piece(i)
        b_bytes.append(bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace(_SPACE, " ").encode())
    return Tokenizers(
        a, b, a_bytes, b_bytes,
        np.array(list(map(len, a_bytes)), np.int64),
        np.array(list(map(len, b_bytes)), np.int64),
        [f"{i}{end}" for n, ends in ((len(a_bytes), ",|"), (len(b_bytes), ",;")) for end in ends for i in range(n)],
    )


class Aligned(NamedTuple):
    """Alignment of some texts in a row: tokens, links and groups of all, counted per text."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    groups: list[str]
    link_text: np.ndarray
    link_a: np.ndarray
    link_b: np.ndarray


def coalesced(starts_a, ends_a, starts_b, ends_b) -> tuple[np.ndarray, np.ndarray]:
    """Group of each A and each B token: overlapping byte ranges, chained, share one."""
    starts = np.concatenate([starts_a, starts_b])
    if not len(starts):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    side = np.repeat(np.array([0, 1], np.int8), [len(starts_a), len(starts_b)])
    order = np.lexsort((side, starts))
    reached = np.maximum.accumulate(np.concatenate([ends_a, ends_b])[order])
    opens = np.ones(len(order), np.int64)
    opens[1:] = starts[order][1:] >= reached[:-1]
    groups = np.empty(len(order), np.int64)
    groups[order] = np.cumsum(opens) - 1
    return groups[: len(starts_a)], groups[len(starts_a) :]


def overlaps(starts_a, ends_a, starts_b, ends_b) -> tuple[np.ndarray, np.ndarray]:
    """Places of all A and B tokens that share a byte, in A's order."""
    first = np.searchsorted(ends_b, starts_a, "right")
    many = np.searchsorted(starts_b, ends_a, "left") - first
    a = np.repeat(np.arange(len(starts_a)), many)
    within = np.arange(len(a)) - np.repeat(np.cumsum(many) - many, many)
    return a, np.repeat(first, many) + within


def align(texts: list[str | None], own: Tokenizers) -> Aligned:
    """Groups and links of every text; byte offsets run on from text to text."""
    plain = [t or "" for t in texts]
    ids_a, ids_b = own.cut(plain)
    for i, text in enumerate(plain):
        raw = (" " + text).encode()
        if not text or b"".join(map(own.a_bytes.__getitem__, ids_a[i])) != raw or b"".join(map(own.b_bytes.__getitem__, ids_b[i])) != raw:
            ids_a[i] = ids_b[i] = ()
    n_a, n_b = np.array(list(map(len, ids_a)), np.int64), np.array(list(map(len, ids_b)), np.int64)
    a = np.concatenate([np.empty(0, np.int64), *(np.array(x, np.int64) for x in ids_a)])
    b = np.concatenate([np.empty(0, np.int64), *(np.array(x, np.int64) for x in ids_b)])
    ends_a, ends_b = np.cumsum(own.a_sizes[a]), np.cumsum(own.b_sizes[b])
    spans = ends_a - own.a_sizes[a], ends_a, ends_b - own.b_sizes[b], ends_b
    group_a, group_b = coalesced(*spans)
    link_a, link_b = overlaps(*spans)
    text_a = np.repeat(np.arange(len(texts)), n_a)
    n_groups = int(group_a[-1]) + 1 if len(a) else 0
    first_a = np.concatenate([[0], np.cumsum(np.bincount(group_a, minlength=n_groups))])
    first_b = np.concatenate([[0], np.cumsum(np.bincount(group_b, minlength=n_groups))])
    # Groups are written one after the other, A before B: a token's place and its separator.
    named = np.empty(len(a) + len(b), np.int64)
    last_a, last_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
    last_a[first_a[1:] - 1] = last_b[first_b[1:] - 1] = True
    named[np.arange(len(a)) + first_b[group_a]] = a + last_a * len(own.a_bytes)
    named[np.arange(len(b)) + first_a[group_b + 1]] = 2 * len(own.a_bytes) + b + last_b * len(own.b_bytes)
    told, at, groups = named.tolist(), 0, []
    for size in (n_a + n_b).tolist():
        groups.append("".join(map(own.names.__getitem__, told[at : at + size]))[:-1])
        at += size
    opened = np.bincount(text_a[first_a[:-1]], minlength=len(texts)) if n_groups else np.zeros(len(texts), np.int64)
    link_text = text_a[link_a]
    return Aligned(
        n_a, n_b, opened, np.bincount(link_text, minlength=len(texts)), groups, link_text, a[link_a], b[link_b]
    )


class _Block:
    """Documents of a block, with the distinct pairs of each."""

    def __init__(self, number: int):
        self.number, self.rows, self.pairs, self.times, self.sizes = number, [], [], [], []
        self.links = 0

    def add(self, ids: list, found: Aligned, pieces: int) -> None:
        top = int(found.link_a.max()) + 1 if len(found.link_a) else 1
        keys = (found.link_text * top + found.link_a) * pieces + found.link_b
        keys, times = np.unique(keys, return_counts=True)
        text, pair = np.divmod(keys, top * pieces)
        self.pairs.append(pair)
        self.times.append(times.astype(np.uint32))
        self.sizes.extend(np.bincount(text, minlength=len(ids)).tolist())
        self.links += len(pair)
        for row in zip(ids, found.n_a.tolist(), found.n_b.tolist(), found.n_groups.tolist(), found.n_links.tolist(), found.groups, strict=True):
            self.rows.append((*row[:5], hashlib.sha256(row[5].encode()).hexdigest() if row[5] else ""))

    def batches(self) -> Iterator[pa.RecordBatch]:
        """A row per document, then the sorted dictionary of the block in rows without one."""
        pairs, places = np.unique(np.concatenate(self.pairs), return_inverse=True)
        places, times = places.astype(np.int32), np.concatenate(self.times)
        documents = np.bincount(places, minlength=len(pairs)).astype(np.int32)
        ends = np.cumsum(self.sizes)
        for at in range(0, len(self.rows), 1000):
            rows, spans = self.rows[at : at + 1000], [slice(e - s, e) for e, s in zip(ends[at : at + 1000], self.sizes[at : at + 1000], strict=True)]
            columns = [[self.number] * len(rows), *map(list, zip(*rows, strict=True))]
            columns += [[np.diff(places[s], prepend=np.int32(0)).tobytes() for s in spans], [times[s].tobytes() for s in spans]]
            columns += [[None] * len(rows)] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _BLOCKS, strict=True)], schema=_BLOCKS)
        for at in range(0, len(pairs), DICTIONARY_ROW):
            parts = [pa.array([x[at : at + DICTIONARY_ROW]], f.type) for x, f in zip((pairs, documents), list(_BLOCKS)[-2:], strict=True)]
            empty = [pa.nulls(1, f.type) for f in list(_BLOCKS)[1:-2]]
            yield pa.RecordBatch.from_arrays([pa.array([self.number], pa.int64()), *empty, *parts], schema=_BLOCKS)


def _slices(ids: list, texts: list) -> Iterator[tuple[list, list]]:
    """Runs of rows of about ``SLICE_CHARS`` characters, one row at least."""
    start = size = 0
    for i, text in enumerate(texts):
        size += len(text or "")
        if size >= SLICE_CHARS:
            yield ids[start : i + 1], texts[start : i + 1]
            start, size = i + 1, 0
    if start < len(ids):
        yield ids[start:], texts[start:]


def aligned_blocks(docs: DataFrame, bytes_path: str | None = None, pieces_path: str | None = None, links: int = BLOCK_LINKS) -> DataFrame:
    """Alignments of all documents, block by block: rows of documents and of dictionaries."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizers(bytes_path, pieces_path)
        number = TaskContext.get().partitionId() << 24
        block = _Block(number)
        for batch in batches:
            for ids, texts in _slices(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                block.add(ids, align(texts, own), len(own.b_bytes))
                if block.links >= links:
                    yield from block.batches()
                    number += 1
                    block = _Block(number)
        if block.rows:
            yield from block.batches()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _BLOCKS_DDL)


def _counted(dictionaries: DataFrame, pieces: int) -> DataFrame:
    """Rows of dictionaries with the pair's documents in the corpus, and whether no other pair
    of its A id has more."""
    rows = dictionaries.select(F.col("block").alias("own"), F.explode(F.arrays_zip("pairs", "docs")).alias("x")).select("own", "x.pairs", "x.docs")
    dealt = rows.repartition("pairs")  # once, for the sums and for the join
    seen = dealt.groupBy("pairs").agg(F.sum("docs").alias("seen"))
    a_id = F.expr(f"pairs div {pieces}")
    most = seen.groupBy(a_id.alias("a_id")).agg(F.max("seen").alias("most"))  # at most one row per id of A
    both = dealt.join(seen, "pairs").withColumn("a_id", a_id).join(F.broadcast(most), "a_id")
    return both.select("own", "pairs", "seen", (F.col("seen") == F.col("most")).alias("best"))


def alignment_digest(docs: DataFrame, bytes_path: str | None = None, pieces_path: str | None = None, links: int = BLOCK_LINKS) -> DataFrame:
    """Per row of ``docs``: token, group and link counts, ``n_best`` and ``count_sum`` over all
    documents, and a checksum of the groups as written by ``align``."""
    blocks = shared(aligned_blocks(docs, bytes_path, pieces_path, links))
    pieces = len(tokenizers(bytes_path, pieces_path).b_bytes)
    counted = _counted(blocks.where(F.col("pairs").isNotNull()), pieces)
    own = [f.name for f in _BLOCKS][1:9]
    documents = blocks.where(F.col("pairs").isNull()).select("block", *own)

    def told(left: pa.Table, right: pa.Table) -> pa.Table:
        order = np.argsort(right["pairs"].to_numpy())
        seen = right["seen"].to_numpy()[order]
        best = right["best"].to_numpy()[order]
        n_best, count_sum = [], []
        for places, times in zip(left["places"].to_pylist(), left["times"].to_pylist(), strict=True):
            at = np.cumsum(np.frombuffer(places, np.int32))
            many = np.frombuffer(times, np.uint32).astype(np.int64)
            n_best.append(int(many[best[at]].sum()))
            count_sum.append(int((many * seen[at]).sum()))
        columns = {f: left[f] for f in own[:6]} | {"n_best": pa.array(n_best, pa.int64()), "count_sum": pa.array(count_sum, pa.int64())}
        return pa.table([columns[f] for f in _DIGEST_NAMES], names=_DIGEST_NAMES)

    return documents.groupBy("block").cogroup(counted.groupBy("own")).applyInArrow(told, DIGEST)


_DIGEST_NAMES = [c.split()[0] for c in DIGEST.split(", ")]
