"""Words, word hashes and batched row functions shared by the corpus operators.

A word is a run of bytes other than ASCII white space (``[^\\x20\\x09-\\x0D]+``), which is what
``bytes.split()`` yields. Row functions run over Arrow batches in slices, so a task holds few
texts at a time, and their caches are emptied when full: they speed up, they decide nothing.
"""

from __future__ import annotations

import functools
import re
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows that go to Python at once, and rows that are decoded at once.
BATCH_ROWS, SLICE_ROWS = 1000, 200
#: Words that a worker remembers.
CACHE_WORDS = 800_000
#: Bytes of a text that are hashed at once.
PIECE_BYTES = 1 << 20
_ODD = 0x9E3779B97F4A7C15
_SPACE = re.compile(rb"[\x20\x09-\x0D]")

Rows = Iterator[tuple]


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "replace").split() if text else []


class Remembered(dict):
    """A bounded memo of a function of a word: two generations, of which the older is dropped."""

    def __init__(self, make: Callable[[bytes], object], most: int = CACHE_WORDS):
        super().__init__()
        self.make, self.half, self.older = make, most // 2, {}

    def __missing__(self, word: bytes):
        value = self.older.get(word)
        if value is None:
            value = self.make(word)
        if len(self) >= self.half:
            self.older = dict(self)
            self.clear()
        self[word] = value
        return value


_MEMOS: list = []
_ASKED: set = set()


def worker_memo(make: Callable) -> Callable:
    """One value for all tasks of a Python worker, the last that was asked for.

    Workers live as long as the session, so a task lets go of what it does not ask for itself
    (``begun``): the memo of one operator must not lie beside those of the next ones.
    """
    made = functools.lru_cache(maxsize=1)(make)
    _MEMOS.append(made)

    @functools.wraps(make)
    def asked(*key):
        for other in _MEMOS:
            if other is not made:
                other.cache_clear()
        _ASKED.add(made)
        return made(*key)

    asked.cache_info = made.cache_info
    return asked


def begun(start: Callable[[], object] = lambda: None):
    """What ``start`` gives; memos of the worker that it does not ask for are let go."""
    _ASKED.clear()
    out = start()
    for made in _MEMOS:
        if made not in _ASKED:
            made.cache_clear()
    return out


class WordHashes:
    """64-bit hashes of the words of a text, and of windows of words.

    A word is hashed by its eight-byte parts. A window's hash is a polynomial of its words'
    modulo 2**64 with an odd base, taken as a difference of prefix sums and brought back to
    position 0 by the base's inverse. So a whole text takes a few array steps.
    """

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if n < len(self.up):
            return
        n = 2 * n + 4096
        inverse = pow(_ODD, -1, 1 << 64)
        self.up = np.cumprod(np.r_[np.uint64(1), np.full(n, _ODD, np.uint64)])
        self.down = np.cumprod(np.r_[np.uint64(1), np.full(n, inverse, np.uint64)])

    def of(self, text: str | None, lower: bool = False) -> np.ndarray:
        """Hashes of a text's words in order; ``lower`` folds A-Z only."""
        raw = (text or "").encode("utf-8", "replace")
        return self.of_plain(raw.lower() if lower else raw)

    def of_plain(self, raw: bytes) -> np.ndarray:
        found, at = [], 0
        while at < len(raw):
            end = at + PIECE_BYTES
            if end < len(raw):  # a piece ends with a word
                gap = _SPACE.search(raw, end)
                end = gap.start() if gap else len(raw)
            found.append(self._piece(np.frombuffer(raw[at:end], np.uint8)))
            at = end
        return found[0] if len(found) == 1 else np.concatenate([np.empty(0, np.uint64), *found])

    def _piece(self, b: np.ndarray) -> np.ndarray:
        return word_values(b, *word_edges(b))

    def windows(self, hashes: np.ndarray, k: int) -> np.ndarray:
        """Hash of each run of ``k`` consecutive words, by its start."""
        n = len(hashes)
        if n < k:
            return np.empty(0, np.uint64)
        self._powers(n)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(hashes * self.up[:n], out=total[1:])
        return mixed((total[k:] - total[:-k]) * self.down[: n - k + 1])


#: Keeps the first k bytes of a little-endian number.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def word_edges(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words start and end in the bytes of a text."""
    space = np.ones(len(b) + 2, bool)
    np.less(b - np.uint8(9), 5, out=space[1:-1])
    space[1:-1] |= b == 32
    edges = np.flatnonzero(space[1:] != space[:-1])
    return edges[0::2], edges[1::2]


def word_values(b: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    room = np.zeros(len(b) + 8, np.uint8)
    room[: len(b)] = b
    eight = np.ndarray((len(b) + 1,), "<u8", room, strides=(1,))  # the eight bytes from each on
    left = last - first
    out = mixed((eight[first] & _FIRST[np.minimum(left, 8)]) + left.astype(np.uint64) * np.uint64(_ODD))
    part = 8
    long = np.flatnonzero(left > part)
    while len(long):
        more = eight[first[long] + part] & _FIRST[np.minimum(left[long] - part, 8)]
        out[long] = mixed(out[long] * np.uint64(_ODD) + more)
        part += 8
        long = long[left[long] > part]
    return out


def mixed(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def small_batches(spark: SparkSession) -> None:
    """Bound the rows sent to a Python worker at once: texts may be very long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def map_rows(df: DataFrame, start: Callable[[], Callable[..., Iterable[tuple]]], schema: str) -> DataFrame:
    """Rows made from each row of ``df``.

    ``start`` runs once in each task and gives the row function, which gets the values of the
    row and yields tuples of ``schema``.
    """
    small_batches(df.sparkSession)
    target = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = begun(start)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                out = [x for row in zip(*(c.to_pylist() for c in part.columns), strict=True) for x in each(*row)]
                if out:
                    columns = zip(*out, strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, f.type) for c, f in zip(columns, target, strict=True)], schema=target
                    )

    return df.mapInArrow(run, schema)


def map_blocks(df: DataFrame, start: Callable[[], Callable[[list], dict | None]], schema: str) -> DataFrame:
    """As ``map_rows``, for a function of a slice's columns that gives whole arrays."""
    small_batches(df.sparkSession)
    target = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = begun(start)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                made = each([c.to_pylist() for c in batch.slice(at, SLICE_ROWS).columns])
                if made is not None:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(made[f.name], f.type) for f in target], schema=target
                    )

    return df.mapInArrow(run, schema)


def map_groups(df: DataFrame, key: str, made: Callable[[pa.Table], pa.RecordBatch], schema: str) -> DataFrame:
    """Batches made from whole groups of ``df``; a call gets the rows of some groups, side by side.

    Groups are bounded by the caller; a task holds one batch and the group at its end.
    """
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun()
        rest = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            rows = rows if rest is None else pa.concat_tables([rest, rows])
            keys = rows[key].combine_chunks()
            end = len(keys) - 1  # the last group may go on
            last = keys[end]
            while end and keys[end - 1] == last:
                end -= 1
            if end:
                yield made(rows.slice(0, end))
            rest = rows.slice(end)
        if rest is not None and len(rest):
            yield made(rest)

    return df.repartition(key).sortWithinPartitions(key).mapInArrow(run, schema)


def row_key(doc_id: str = "doc_id", text: str = "text"):
    """A key of a row's id and text: rows that share an id, or have none, stay apart."""
    own = F.coalesce(F.col(doc_id).cast("long"), F.lit(-(1 << 63)))
    return F.struct(own.alias("a"), F.xxhash64(F.coalesce(F.col(text), F.lit("")), F.lit(1)).alias("b"))


#: Slots of a sieve: one mebibyte of bits, whatever the data.
SIEVE_SLOTS, _SIEVE_BLOCK = 1 << 23, 1 << 15


def sieve(keys: DataFrame, *columns: str) -> np.ndarray:
    """A Bloom filter of fixed size over the integer ``columns`` of ``keys``, as packed bits.

    It only spares shuffles: rows whose slot is empty have no partner. With more keys than
    slots it lets everything pass and the joins behind it do the same work on all rows.
    """
    slot = F.pmod(F.xxhash64(*[F.col(c).cast("long") for c in columns]), F.lit(SIEVE_SLOTS))
    slots = keys.select(slot.alias("slot")).distinct()

    def run(key: tuple, group: pa.Table) -> pa.Table:
        bits = np.zeros(_SIEVE_BLOCK, bool)
        bits[group["slot"].to_numpy() % _SIEVE_BLOCK] = True
        return pa.table({"block": pa.array([key[0].as_py()], pa.int64()), "bits": pa.array([np.packbits(bits).tobytes()], pa.binary())})

    block = F.floor(F.col("slot") / _SIEVE_BLOCK).alias("block")
    made = slots.withColumn("block", block).groupBy("block").applyInArrow(run, "block long, bits binary")
    out = np.zeros(SIEVE_SLOTS // 8, np.uint8)
    for row in made.collect():  # SIEVE_SLOTS bits in all
        at = row["block"] * _SIEVE_BLOCK // 8
        out[at : at + _SIEVE_BLOCK // 8] = np.frombuffer(row["bits"], np.uint8)
    return out


def sifted(df: DataFrame, bits: np.ndarray, *columns: str, inside: bool = True) -> DataFrame:
    """Rows of ``df`` whose integer ``columns`` may be among the sieve's keys, or surely are not."""
    small_batches(df.sparkSession)
    names = df.columns
    slot = F.pmod(F.xxhash64(*[F.col(c).cast("long") for c in columns]), F.lit(SIEVE_SLOTS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun()
        for batch in batches:
            at = batch.column(len(names)).to_numpy()
            hit = (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1
            yield batch.select(names).filter(pa.array(hit == int(inside)))

    return df.withColumn("sieve slot", slot).mapInArrow(run, df.schema)


KEY = ("__row_a", "__row_b")


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with the two parts of each row's key as last columns, ``KEY``."""
    key = row_key()
    return docs.select("*", key["a"].alias(KEY[0]), key["b"].alias(KEY[1]))


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose key is not in ``gone`` (a, b), all columns as they are.

    Only rows that the sieve cannot clear are shuffled.
    """
    gone = shared(gone.select("a", "b").distinct())
    rows, bits = keyed(docs), sieve(gone, "a", "b")
    asked = sifted(rows, bits, *KEY).join(gone.toDF(*KEY), [*KEY], "left_anti").select(*rows.columns)
    return sifted(rows, bits, *KEY, inside=False).unionByName(asked).drop(*KEY)


def kept_rows(df: DataFrame, columns: list[str], start: Callable[[], Callable[..., bool]]) -> DataFrame:
    """Rows for which a function of some ``columns`` is true, all columns as they are."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = begun(start)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                told = zip(*(part.column(c).to_pylist() for c in columns), strict=True)
                yield part.filter(pa.array([keep(*row) for row in told], pa.bool_()))

    return df.mapInArrow(run, df.schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back: lineage cut, safe from lost executors.

    The folder lies in ``spark.checkpoint.dir``, in the warehouse where that is unset, and is
    deleted when the session's JVM ends.
    """
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/cuts"
    path = f"{base.rstrip('/')}/cut-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).deleteOnExit(folder)
    return spark.read.schema(df.schema).parquet(path)
