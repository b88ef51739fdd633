"""Best-fit packing with large-item matching (operator 5).

Documents become runs of token ids; only those longer than a sequence are cut. What has to be
packed are the pieces shorter than a sequence. Their plan depends on nothing but how many
there are of each length, a table of at most ``capacity`` rows, so the driver plans on counts:

1. Pieces over a third of the capacity fit at most twice into a sequence (three would not
   fit); each, from the longest down, is paired with the longest partner that still fits.
2. Smaller pieces, from the longest down, go where the least room is left that takes them.
3. What remains opens new sequences, by the same rule.

The plan is a list of shapes with a repeat count. Pieces find their place by their rank among
pieces of their length; ranks come from counts per hash cell, so no task sees a whole length.
"""

from __future__ import annotations

import json
import unicodedata
import zlib
from bisect import bisect_left, insort
from collections.abc import Callable
from struct import pack

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from punctuality.llm.texts import Remembered, map_rows, shared, words_of, worker_memo
from punctuality.llm.word_counts import byte_symbols

CAPACITY = 4096
TOKENIZER, END_ID = "word_bpe_49k.json", 1
#: Hash cells of a length; ranks are counted within a cell.
CELLS = 256
#: Words, and parts of words, that a task remembers.
TASK_WORDS, TASK_PARTS = 400_000, 400_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pieces of at most ``capacity`` ids of every text, with a checksum of their ids.

    White space separates words for this tokenizer and leaves no ids, so a text's ids are its
    words' ids in a row and each distinct word is encoded once. Null texts count as empty.
    """

    def start():
        import public_tokenizers

        end = np.array([end_id], "<u4").tobytes()
        known = _known_words(path or public_tokenizers.path(TOKENIZER))()

        def each(doc_id, text):
            ids = b"".join(map(known.__getitem__, words_of(text))) + end
            for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                part = ids[at : at + 4 * capacity]
                yield doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part)

        return each

    return map_rows(docs.select("doc_id", "text"), start, PIECES)


@worker_memo
def _known_words(path: str) -> Callable[[], Remembered]:
    """Makes a task's memo of words; a worker keeps the tokenizer, until tasks of other kinds run there.

    Words go with their task: Spark deals tasks to the idle workers of an executor in turn, and
    after operators with several workers a task there are more of those than tasks at a time.
    """
    encoder = word_encoders(path)
    return lambda: Remembered(encoder(), TASK_WORDS)


def word_encoder(path: str) -> Callable[[bytes], bytes]:
    """Ids of a word, as bytes of little-endian 32-bit numbers."""
    return word_encoders(path)()


def word_encoders(path: str) -> Callable[[], Callable[[bytes], bytes]]:
    """Makes word encoders with one tokenizer, each with a memo of its own.

    Where the file splits by one pattern and then works on bytes (and lower-cases after NFC),
    Latin words are split here and their parts, of which there are far fewer than words, are
    remembered; anything else goes through the tokenizer as it is.
    """
    import regex
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    with open(path, encoding="utf-8") as file:
        content = json.load(file)

    def whole(word: bytes) -> bytes:
        return np.array(tokenizer.encode(word.decode(), add_special_tokens=False).ids, "<u4").tobytes()

    splitters = (content.get("pre_tokenizer") or {}).get("pretokenizers", [])
    normal = [x["type"] for x in (content.get("normalizer") or {}).get("normalizers", [])]
    simple = [x["type"] for x in splitters] == ["Split", "ByteLevel"] and normal == ["NFC", "Replace", "Lowercase"]
    if not (simple and splitters[0]["invert"] and not splitters[1]["use_regex"] and not splitters[1]["add_prefix_space"]):
        return lambda: whole
    pattern = regex.compile(splitters[0]["pattern"]["Regex"])
    symbols = {b: c for c, b in byte_symbols().items()}

    def part(text: str) -> bytes:
        said = text if text.isascii() else text.encode().decode("latin-1").translate(symbols)
        ids = [x.id for x in tokenize(said)]
        return pack(f"<{len(ids)}I", *ids)

    tokenize = tokenizer.model.tokenize

    def encoder() -> Callable[[bytes], bytes]:
        parts = Remembered(part, TASK_PARTS)

        def encode(word: bytes) -> bytes:
            text = word.decode()
            if text.isascii():
                text = text.lower()
            else:
                text = unicodedata.normalize("NFC", text)
                if max(text) >= "\u0250":
                    return whole(word)
                text = "".join(map(str.lower, text))
            if text.isalpha():
                return parts[text]
            if not text.isprintable():
                return whole(word)
            return b"".join(map(parts.__getitem__, pattern.findall(text)))

        return encode

    return encoder


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """Shapes ``(repeats, [(length, how many in a row), ...])`` that hold all pieces."""
    left = {n: c for n, c in counts.items() if c > 0}
    shapes: list[tuple[int, list[tuple[int, int]]]] = []
    room: dict[int, list[list]] = {}  # free tokens -> open shapes
    free: list[int] = []

    def put(repeats: int, parts: list[tuple[int, int]]) -> None:
        rest = capacity - sum(n * k for n, k in parts)
        if rest not in room:
            room[rest] = []
            insort(free, rest)
        room[rest].append([repeats, parts])

    large = sorted(n for n in left if 3 * n > capacity)
    while large:
        n = large[-1]
        fits = bisect_left(large, capacity - n + 1) - 1
        if fits < 0:
            put(left.pop(n), [(n, 1)])
            large.pop()
            continue
        mate = large[fits]
        if mate == n:
            if left[n] >= 2:
                put(left[n] // 2, [(n, 2)])
            left[n] %= 2
            if left[n]:
                put_with = large[fits - 1] if fits else None
                if put_with is None:
                    put(1, [(n, 1)])
                else:
                    put(1, [(n, 1), (put_with, 1)])
                    left[put_with] -= 1
                    if not left[put_with]:
                        large.remove(put_with)
                        del left[put_with]
            del left[n]
            large.remove(n)
            continue
        many = min(left[n], left[mate])
        put(many, [(n, 1), (mate, 1)])
        for length in (n, mate):
            left[length] -= many
            if not left[length]:
                del left[length]
                large.remove(length)

    for n in sorted(left, reverse=True):
        want = left[n]
        while want:
            at = bisect_left(free, n)
            if at == len(free):
                each = min(capacity // n, want)
                put(want // each, [(n, each)])
                want %= each
                continue
            rest = free[at]
            repeats, parts = room[rest].pop()
            if not room[rest]:
                del room[rest], free[at]
            each = min(rest // n, want)
            filled = min(repeats, want // each)
            if repeats > filled:
                put(repeats - filled, parts)
            put(filled, [*parts, (n, each)])
            want -= filled * each
    for shapes_of_rest in room.values():
        shapes += [(repeats, parts) for repeats, parts in shapes_of_rest]
    return shapes


def _places(shapes: list, first: int) -> list[tuple]:
    """For each length, which ranks go to which sequences: (length, lo, hi, base, each, at)."""
    rows, used, base = [], {}, first
    for repeats, parts in shapes:
        at = 0
        for length, each in parts:
            lo = used.get(length, 0)
            used[length] = lo + repeats * each
            rows.append((length, lo, used[length], base, each, at))
            at += length * each
        base += repeats
    return rows


def ranked(items: DataFrame, order: list[str], cells: int = CELLS) -> DataFrame:
    """``rank`` of each row among rows of its ``length``, from 0, without gaps.

    Rows are dealt to hash cells; a cell's first rank is the number of rows in cells before.
    """
    cell = F.pmod(F.xxhash64(*order), F.lit(cells)).cast("int")
    dealt = items.withColumn("cell", cell)
    sizes = dealt.groupBy("length", "cell").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    firsts = sizes.select("length", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    within = Window.partitionBy("length", "cell").orderBy(*order)
    placed = dealt.withColumn("own", F.row_number().over(within) - 1)
    return placed.join(firsts, ["length", "cell"]).withColumn("rank", F.col("first") + F.col("own")).drop("cell", "first", "own")


def packed(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Every piece of every document with its sequence and offset there.

    Null texts are empty (one end id). Repeated rows and ids are packed one for one. An empty
    table gives an empty result. Sequence ids count from 0 without gaps.
    """
    spark = docs.sparkSession
    pieces = shared(token_pieces(docs, path, capacity, end_id))
    # At most `capacity` rows.
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    counts.setdefault(capacity, 0)
    places = _places(plan(counts, capacity), 0)
    kinds = "length long, lo long, hi long, base long, each long, at long"
    order = ["doc_id", "piece", "ids_crc32"]
    items = ranked(pieces, order)
    if not places:
        return items.select(*pieces.columns, F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    spans = spark.createDataFrame(places, kinds)
    hit = (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi"))
    inner = F.col("rank") - F.col("lo")
    return (
        items.join(F.broadcast(spans), "length")
        .where(hit)
        .select(
            *pieces.columns,
            (F.col("base") + F.floor(inner / F.col("each"))).cast("long").alias("sequence_id"),
            (F.col("at") + F.pmod(inner, F.col("each")) * F.col("length")).cast("long").alias("offset"),
        )
    )
