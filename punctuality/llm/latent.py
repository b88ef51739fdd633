"""Benchmark decontamination by latent semantic retrieval (operator 1).

Documents are read as passages of ``PASSAGE`` words over the benchmark's weighted
by TF-IDF over all passages of the corpus. A randomised SVD of that matrix A is taken without
building it: each task adds up its part of (A^T A) times a thin random matrix, which is as high as
the vocabulary, and Spark sums the parts. One such pass is enough: A^T A is positive semidefinite,
so its leading singular vectors follow from that product alone (Nystroem's form). Every
window of every text, as long as the items it is held against, is compared with the items by
cosine in that latent space. Windows above ``COSINE`` are candidates, and there the words decide:

- a longest common subsequence with at least ``COPY`` of an item's words is a copy;
- one with at least ``PARAPHRASE`` counts if the item's answer, its last words, is there too.

The benchmark is the stated query set. It is taken in blocks of ``BLOCK_ITEMS``, so vocabulary,
vectors and what the driver holds are bounded whatever its size; the corpus only meets sums.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from punctuality.llm.licenses import plain
from punctuality.llm.texts import SLICE_ROWS, WordHashes, begun, map_blocks, row_key, small_batches, word_edges, word_values

PASSAGE, RANK, EXTRA, STEP = 32, 112, 16, 4
COSINE, COPY, PARAPHRASE, ANSWER = 0.6, 0.8, 0.5, 0.8
BLOCK_ITEMS = 2000
#: Words of an item's answer: this share of it, from the end.
ANSWER_WORDS = 0.25
#: Terms of passages that are multiplied at once.
AT_ONCE = 20_000
#: Up to so many terms, a task adds up A^T A itself (128 MiB) and multiplies once, at its end.
SQUARE_TERMS = 4096
LEAKS = (
    "doc_id long, a long, b long, item_id long, cosine double, common_share double, answer_share double, "
    "start_word long, kind string"
)


def folded(text: str | None) -> bytes:
    """A text's words in lower case, ASCII punctuation taken as gaps."""
    return plain(text.lower() if text else None)


@dataclass
class Terms:
    """Sorted hashes of a vocabulary, and lookups of a text's words in it."""

    hashes: np.ndarray

    def __post_init__(self):
        self.slots = np.zeros(1 << 18, np.int32)  # a term of the slot, and whether others share it
        slot = (self.hashes & np.uint64(0x3FFFF)).astype(np.int64)
        self.slots[slot] = np.arange(1, len(slot) + 1)
        self.crowded = np.bincount(slot, minlength=1 << 18) > 1

    def find(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions, term numbers) of the words that are terms."""
        slot = (words & np.uint64(0x3FFFF)).astype(np.int64)
        k = self.slots[slot]
        at = np.flatnonzero(k)
        k, own = k[at] - 1, words[at]
        crowd = np.flatnonzero(self.crowded[slot[at]])
        k[crowd] = np.minimum(np.searchsorted(self.hashes, own[crowd]), len(self.hashes) - 1)
        hit = self.hashes[k] == own
        return at[hit], k[hit].astype(np.int64)


class Reader:
    """Words of several texts at once: hashes, and the text and place in it of each."""

    def __init__(self):
        self.hashes = WordHashes()

    def read(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(hashes of all words, where each text begins among them, and the end)."""
        raws = [folded(t) for t in texts]
        b = np.frombuffer(b" ".join(raws), np.uint8)
        first, last = word_edges(b)
        begin = np.cumsum([0] + [len(r) + 1 for r in raws])
        return word_values(b, first, last), np.searchsorted(first, begin)


def _summed(texts: DataFrame, start: Callable, schema: str) -> DataFrame:
    """One block of rows per task: ``start`` gives a function of some texts and one of the end."""
    small_batches(texts.sparkSession)
    target = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each, end = begun(start)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                each(batch.column(0).slice(at, SLICE_ROWS).to_pylist())
        made = end()
        if made is not None:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(made, target, strict=True)], schema=target)

    return texts.select("text").mapInArrow(run, schema)


def passages_of(begin: np.ndarray) -> tuple[np.ndarray, int]:
    """Number of the passage of each word, and of all passages; a passage lies within a text."""
    sizes = np.diff(begin)
    many = -(-sizes // PASSAGE)
    before = np.cumsum(many) - many
    place = np.arange(begin[-1]) - np.repeat(begin[:-1], sizes)
    return np.repeat(before, sizes) + place // PASSAGE, int(many.sum())


def _frequencies(texts: DataFrame, terms: Terms) -> tuple[np.ndarray, int]:
    """In how many passages each term occurs, and the number of passages."""

    def start():
        reader, size = Reader(), len(terms.hashes)
        counts = np.zeros(size + 1, np.int64)

        def each(some):
            words, begin = reader.read(some)
            passage, total = passages_of(begin)
            counts[size] += total
            at, k = terms.find(words)
            key = passage[at] * size + k
            key.sort()
            once = key[np.r_[True, key[1:] != key[:-1]]] if len(key) else key
            counts[:size] += np.bincount(once % size, minlength=size)

        def end():
            held = np.flatnonzero(counts)
            return (held.astype(np.int32), counts[held]) if len(held) else None

        return each, end

    rows = _summed(texts, start, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(len(terms.hashes) + 1, np.int64)
    for r in rows:  # one per term of the block's vocabulary
        out[r["term"]] = r["n"]
    return out[:-1], int(out[-1])


def unit_rows(row: np.ndarray, k: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(passage, term, weight) of the unit TF-IDF rows of passages, side by side; ``row`` ascends."""
    key = row * len(idf) + k
    key.sort()
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    times = np.diff(np.r_[first, len(key)])
    p, t = np.divmod(key[first], len(idf))
    weight = times * idf[t]
    edge = np.flatnonzero(np.r_[True, p[1:] != p[:-1]])
    norm = np.sqrt(np.add.reduceat(weight * weight, edge))
    return p, t, weight / np.repeat(np.maximum(norm, 1e-9), np.diff(np.r_[edge, len(p)]))


def add_square(square: np.ndarray, p: np.ndarray, t: np.ndarray, weight: np.ndarray) -> None:
    """Add the products of all pairs of entries of a row, once each, to a flat square matrix.

    Entries lie by row; within one, terms ascend, so the upper half is filled; the diagonal gets halves.
    """
    size = int(np.sqrt(len(square)))
    np.add.at(square, t * (size + 1), weight * weight / 2)
    i = np.arange(len(p))
    for gap in range(1, len(p)):  # PASSAGE at most
        i = i[: np.searchsorted(i, len(p) - gap)]
        i = i[p[i] == p[i + gap]]
        if not len(i):
            break
        j = i + gap
        np.add.at(square, t[i] * size + t[j], weight[i] * weight[j])


def _product(texts: DataFrame, terms: Terms, idf: np.ndarray, thin: np.ndarray, most: int = SQUARE_TERMS) -> np.ndarray:
    """(A^T A) ``thin`` for the matrix A of all passages' unit TF-IDF rows.

    The number of terms decides in which order a task multiplies, not what is summed.
    """
    size, width = thin.shape
    squared = size <= most
    idf, thin = idf.astype(np.float64), thin.astype(np.float64 if squared else np.float32)

    def start():
        reader = Reader()
        out = np.zeros((size, width), np.float64)
        square = np.zeros(size * size) if squared else None
        passages: list[np.ndarray] = []
        found: list[np.ndarray] = []
        held = [0, 0]  # terms waiting, passages so far

        def multiply() -> None:
            p, t, weight = unit_rows(np.concatenate(passages), np.concatenate(found), idf)
            if squared:
                add_square(square, p, t, weight)
            else:
                first = np.flatnonzero(np.r_[True, p[1:] != p[:-1]])
                for low in range(0, len(first), AT_ONCE // 8):
                    begin = first[low : low + AT_ONCE // 8]
                    part = slice(begin[0], first[low + len(begin)] if low + len(begin) < len(first) else len(p))
                    scatter(begin - begin[0], t[part], weight[part].astype(np.float32))
            passages.clear()
            found.clear()
            held[0] = 0

        def scatter(begin: np.ndarray, t: np.ndarray, weight: np.ndarray) -> None:
            rows = np.add.reduceat(thin[t] * weight[:, None], begin, axis=0)
            order = np.argsort(t, kind="stable")
            number = np.repeat(np.arange(len(begin)), np.diff(np.r_[begin, len(t)]))[order]
            by_term = t[order]
            at = np.flatnonzero(np.r_[True, by_term[1:] != by_term[:-1]])
            out[by_term[at]] += np.add.reduceat(rows[number] * weight[order][:, None], at, axis=0)

        def each(some):
            words, begin = reader.read(some)
            passage, total = passages_of(begin)
            at, k = terms.find(words)
            if len(at):
                passages.append(passage[at] + held[1])
                found.append(k)
                held[0] += len(at)
            held[1] += total
            if held[0] >= AT_ONCE:
                multiply()

        def end():
            if held[0]:
                multiply()
            if squared:
                half = square.reshape(size, size)
                np.add(half @ thin, half.T @ thin, out=out)
            some = np.flatnonzero(np.abs(out).sum(axis=1))
            return (some.astype(np.int32), *out[some].T) if len(some) else None

        return each, end

    names = [f"y{i}" for i in range(width)]
    parts = _summed(texts, start, "term int, " + ", ".join(f"{n} double" for n in names))
    sums = parts.groupBy("term").agg(*[F.sum(n).alias(n) for n in names]).toPandas()  # vocabulary x width
    total = np.zeros((size, width))
    total[sums["term"].to_numpy()] = sums[names].to_numpy()
    return total


def singular_vectors(texts: DataFrame, terms: Terms, idf: np.ndarray, rank: int = RANK, seed: int = 1) -> np.ndarray:
    """Leading right singular vectors (vocabulary x rank) of the passages' matrix.

    With Y = (A^T A) Q for a random orthonormal Q, A^T A is close to Y (Q^T Y)^-1 Y^T, whose
    singular vectors are those of Y times the inverse root of Q^T Y.
    """
    width = min(len(terms.hashes), rank + EXTRA)
    thin, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(terms.hashes), width)))
    product = _product(texts, terms, idf, thin)
    values, turned = np.linalg.eigh((thin.T @ product + product.T @ thin) / 2)
    sure = values > max(values[-1], 0) * 1e-10
    root = product @ (turned[:, sure] / np.sqrt(values[sure]))
    vectors, lengths, _ = np.linalg.svd(root, full_matrices=False)
    return vectors[:, :rank][:, lengths[:rank] ** 2 > 1e-9]


def common_length(item: np.ndarray, text: np.ndarray) -> int:
    """Length of the longest common subsequence, by bits of one number."""
    places: dict[int, int] = defaultdict(int)
    for k, word in enumerate(item.tolist()):
        places[word] |= 1 << k
    full = (1 << len(item)) - 1
    free = full
    for word in text.tolist():
        hit = places.get(word)
        if hit:
            both = free & hit
            free = ((free + both) | (free - both)) & full
    return len(item) - free.bit_count()


def window_of(n: int) -> int:
    """Words of the windows that items of ``n`` words are held against."""
    size = 2 * STEP
    while size < 0.85 * n:
        size = size * 3 // 2 if size & (size - 1) == 0 else size // 3 * 4
    return -(-size // STEP) * STEP


_NAMES = [part.split()[0] for part in LEAKS.split(", ")]


class Item:
    """Words of an item, numbered by their order, with how often each is in it and in its answer."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.known, own = np.unique(words, return_inverse=True)
        self.own = own.ravel()
        self.answer = self.own[-max(1, round(ANSWER_WORDS * len(words))) :]
        self.times = np.bincount(self.own, minlength=len(self.known))
        self.answer_times = np.bincount(self.answer, minlength=len(self.known))

    def common(self, region: np.ndarray) -> np.ndarray:
        """The region's words that the item has, as their numbers."""
        at = np.minimum(np.searchsorted(self.known, region), len(self.known) - 1)
        return at[self.known[at] == region]

    def bounds(self, common: np.ndarray) -> tuple[float, float]:
        """No subsequence of the item, or of its answer, has a larger share in common."""
        there = np.bincount(common, minlength=len(self.known))
        most = np.minimum(there, self.times).sum(), np.minimum(there, self.answer_times).sum()
        return most[0] / len(self.own), most[1] / len(self.answer)


@dataclass
class Items:
    ids: list[int]
    items: list[Item]
    terms: Terms
    weighted: np.ndarray  # vocabulary x rank, TF-IDF weights included
    latent: dict[int, tuple[np.ndarray, np.ndarray]]  # window size -> (item numbers, unit vectors)
    holds: np.ndarray  # item x vocabulary, eight terms in a byte


def weights(counts: np.ndarray, passages: int) -> np.ndarray:
    """Weights of terms by the number of passages that hold them: low for common ones, never 0."""
    return np.log(1 + passages / counts) ** 2


def index(ids: list[int], words: list[np.ndarray], terms: Terms, idf: np.ndarray, vectors: np.ndarray) -> Items:
    weighted = (idf[:, None] * vectors).astype(np.float32)
    groups: dict[int, list] = defaultdict(list)
    holds = np.zeros((len(words), len(idf) // 8 + 1), np.uint8)
    for number, own in enumerate(words):
        _, k = terms.find(own)
        np.bitwise_or.at(holds[number], k >> 3, (1 << (k & 7)).astype(np.uint8))
        vector = weighted[k].sum(axis=0)
        norm = np.linalg.norm(vector)
        if norm > 1e-6:
            groups[window_of(len(own))].append((number, vector / norm))
    latent = {size: (np.array([n for n, _ in g]), np.stack([v for _, v in g])) for size, g in groups.items()}
    return Items(ids, [Item(own) for own in words], terms, weighted, latent, holds)


def segments(begin: np.ndarray, most: int, reach: int) -> list[tuple[int, int, int]]:
    """(text, first word, end) of parts of texts of at most ``most`` words; a part of a longer
    text begins ``reach`` words before the end of the one before, so no window is split."""
    out = []
    for text, (low, high) in enumerate(zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True)):
        while high - low > most:
            out.append((text, low, low + most))
            low += most - reach
        if high > low:
            out.append((text, low, high))
    return out


def candidates(term: np.ndarray, begin: np.ndarray, items: Items) -> list[np.ndarray]:
    """Columns text, item number, cosine, start, size of the windows close to an item.

    ``term`` numbers the words of all texts (the size of the vocabulary: none of its). Texts lie
    one after the other with empty blocks between them, as many as the longest window has, so a
    window never sees two.
    """
    reach = max(items.latent, default=0)
    waiting: list[tuple[int, int, int]] = []
    held, found = 0, []
    for part in segments(begin, AT_ONCE, reach):
        waiting.append(part)
        held += part[2] - part[1] + reach
        if held >= AT_ONCE:
            found += _close(term, begin, waiting, items)
            waiting, held = [], 0
    if waiting:
        found += _close(term, begin, waiting, items)
    return [np.concatenate(c) for c in zip(*found, strict=True)] if found else []


def _close(term: np.ndarray, begin: np.ndarray, parts: list[tuple[int, int, int]], items: Items) -> list[tuple[np.ndarray, ...]]:
    reach, rank = max(items.latent, default=0) // STEP, items.weighted.shape[1]
    text, low, high = np.array(parts).T
    sizes = high - low
    first = np.cumsum(-(-sizes // STEP) + reach)
    total_blocks = int(first[-1])
    first = np.r_[0, first[:-1]]  # first block of each part
    total = np.zeros((total_blocks + 1, rank), np.float32)
    own = np.concatenate([term[a:b] for a, b in zip(low.tolist(), high.tolist(), strict=True)])
    place = np.arange(len(own)) + np.repeat(first * STEP - (np.cumsum(sizes) - sizes), sizes)
    at = np.flatnonzero(own < len(items.terms.hashes))
    own, place = own[at], place[at]
    for k in range(STEP):  # a block has one word of each
        here = np.flatnonzero(place % STEP == k)
        total[place[here] // STEP + 1] += items.weighted[own[here]]
    np.cumsum(total, axis=0, out=total)
    found = []
    for size, (numbers, vectors) in items.latent.items():
        wide = size // STEP
        start = np.arange(0, max(1, total_blocks - wide + 1), max(1, wide // 4))
        windows = total[np.minimum(start + wide, total_blocks)] - total[start]
        norm = np.sqrt(np.einsum("ij,ij->i", windows, windows))
        close = windows @ vectors.T
        hit = np.flatnonzero(close >= COSINE * np.maximum(norm, 1e-3)[:, None])
        i, j = np.divmod(hit, len(numbers))
        which = np.searchsorted(first, start[i], side="right") - 1
        begun = (start[i] - first[which]) * STEP + low[which] - begin[text[which]]
        found.append((text[which], numbers[j], close.ravel()[hit] / norm[i], begun, np.full(len(hit), size)))
    return found


def shared_words(term: np.ndarray, low: np.ndarray, high: np.ndarray, number: np.ndarray, items: Items) -> np.ndarray:
    """How many words of each stretch [low, high) its item has."""
    out = np.zeros(len(low), np.int64)
    wide = int((high - low).max(initial=0))
    step = max(1, 10 * AT_ONCE // max(1, wide))
    for a in range(0, len(low), step):
        part = slice(a, a + step)
        place = low[part, None] + np.arange(wide)
        inside = place < high[part, None]
        k = term[np.minimum(place, len(term) - 1)]
        held = items.holds[number[part, None], k >> 3] >> (k & 7).astype(np.uint8) & 1
        out[part] = (held.astype(bool) & inside).sum(axis=1)
    return out


def confirmed(texts: list[str | None], items: Items, reader: Reader) -> list[list[tuple]]:
    """Per text, (item id, cosine, share of common words, share of the answer, start, kind)."""
    words, begin = reader.read(texts)
    term = np.full(len(words), len(items.terms.hashes))
    at, k = items.terms.find(words)
    term[at] = k
    out: list[list[tuple]] = [[] for _ in texts]
    found = candidates(term, begin, items)
    if not found:
        return out
    text, number, cosine, start, size = found
    low = np.minimum(begin[text] + np.maximum(0, start - size // 2), begin[text + 1])
    high = np.minimum(begin[text] + start + size + size // 2, begin[text + 1])
    # No subsequence is longer than the words in common.
    least = PARAPHRASE * np.array([len(item.own) for item in items.items])
    order = np.lexsort((size, start, -cosine, number, text))
    order = order[shared_words(term, low[order], high[order], number[order], items) >= least[number[order]]]
    columns = (c[order].tolist() for c in (text, number, cosine, start, low, high))
    told_of, best, done = None, None, False
    for of, n, cos, begun, a, b in zip(*columns, strict=True):
        if (of, n) != told_of:
            if best:
                out[told_of[0]].append(best)
            told_of, best, done = (of, n), None, False
        if done:
            continue
        item = items.items[n]
        common = item.common(words[a:b])
        most, most_told = item.bounds(common)
        if most < PARAPHRASE or (most < COPY and most_told < ANSWER) or (best and most <= best[2]):
            continue
        share = common_length(item.own, common) / len(item.own)
        if share < PARAPHRASE:
            continue
        told = common_length(item.answer, common) / len(item.answer)
        kind = "copy" if share >= COPY else "paraphrase" if told >= ANSWER else None
        if kind and (best is None or share > best[2]):
            best = (items.ids[n], cos, share, told, begun, kind)
        done = kind == "copy"
    if best:
        out[told_of[0]].append(best)
    return out


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per row of ``docs`` and item found in it; (a, b) is the row's key.

    Null and empty texts and items give none. Common terms weigh little, but none is left out, so
    an item that very many documents hold is found in each. Repeated rows are found each; extra
    columns are ignored.
    """
    spark = docs.sparkSession
    usable = benchmark.where(F.col("text").isNotNull() & F.col("item_id").isNotNull()).select("item_id", "text")
    blocks = -(-usable.count() // BLOCK_ITEMS)
    found = spark.createDataFrame([], LEAKS)
    for block in range(blocks):
        own = usable.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block)
        found = found.union(_leaks_of(docs, sorted((r["item_id"], r["text"]) for r in own.collect())))
    return found


def _leaks_of(docs: DataFrame, block: list[tuple[int, str]]) -> DataFrame:
    hashes = WordHashes()
    words = [(i, hashes.of_plain(folded(text))) for i, text in block]
    words = [(i, own) for i, own in words if len(own)]
    none = docs.sparkSession.createDataFrame([], LEAKS)
    if not words:
        return none
    texts = docs.select("text")
    terms = Terms(np.unique(np.concatenate([own for _, own in words])))
    counts, passages = _frequencies(texts, terms)
    kept = counts > 0
    if not kept.any():
        return none
    terms = Terms(terms.hashes[kept])
    idf = weights(counts[kept], passages)
    vectors = singular_vectors(texts, terms, idf)
    items = index([i for i, _ in words], [own for _, own in words], terms, idf, vectors)
    told = docs.sparkSession.sparkContext.broadcast(items)  # vocabulary x rank, see BLOCK_ITEMS

    def start():
        reader, items = Reader(), told.value

        def each(columns):
            ids, texts, a, b = columns
            found = confirmed(texts, items, reader)
            rows = [(i, x, y, *leak) for i, x, y, of in zip(ids, a, b, found, strict=True) for leak in of]
            return dict(zip(_NAMES, zip(*rows, strict=True), strict=True)) if rows else None

        return each

    rows = docs.select("doc_id", "text", row_key().alias("key")).select("doc_id", "text", "key.a", "key.b")
    return map_blocks(rows, start, LEAKS)
