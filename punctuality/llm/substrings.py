"""Substring dedup by difference-cover anchors (operator 6).

For a difference cover D modulo v, any two positions i and j have a shift below v that takes
both onto D (modulo v). Two equal runs of ``window`` words therefore hold a pair of equal
anchors, of ``window - v + 1`` words, both at cover positions of their documents: only those,
|D| / v of all positions, are hashed and shuffled. Anchors that occur once end there. A
repeated one is extended: every whole window that contains it is hashed in full (96 bits), and
the windows whose hash occurs twice cover the words to remove.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from punctuality.llm.texts import KEY, WordHashes, keyed, map_blocks, map_rows, mixed, row_key, shared, sieve, sifted, words_of

WINDOW = 35
#: A perfect difference set: each difference modulo 21 occurs.
PERIOD, COVER = 21, (0, 1, 4, 14, 16)
#: Anchors are hashed to 48 bits: a chance match costs a few windows more, no wrong removal.
ANCHOR_SHIFT = np.uint64(16)


def check_cover(period: int, cover: tuple[int, ...]) -> None:
    if {(a - b) % period for a in cover for b in cover} != set(range(period)):
        raise ValueError(f"{cover} is no difference cover modulo {period}")


def _anchor_starts(n: int, length: int, period: int, cover: tuple[int, ...]) -> np.ndarray:
    last = max(0, n - length + 1)
    starts = (np.arange(0, last, period)[:, None] + np.array(cover)).ravel()
    return starts[starts < last]


def _anchors(texts: DataFrame, window: int, period: int, cover: tuple[int, ...]) -> DataFrame:
    length = window - period + 1

    def start():
        hashes = WordHashes()

        def each(columns):
            found = []
            for text, a, b in zip(*columns, strict=True):
                own = hashes.of(text)
                if len(own) < window:
                    continue
                at = _anchor_starts(len(own), length, period, cover)
                found.append((hashes.windows(own, length)[at] >> ANCHOR_SHIFT, a, b, at))
            if not found:
                return None
            sizes = [len(x[0]) for x in found]
            return {
                "anchor": np.concatenate([x[0] for x in found]).view(np.int64),
                "a": np.repeat(np.array([x[1] for x in found], np.int64), sizes),
                "b": np.repeat(np.array([x[2] for x in found], np.int64), sizes),
                "at": np.concatenate([x[3] for x in found]).astype(np.int32),
            }

        return each

    return map_blocks(texts.select("text", "a", "b"), start, "anchor long, a long, b long, at int")


def _starts_near(anchors: np.ndarray, n: int, window: int, period: int) -> np.ndarray:
    """Starts of the windows that contain an anchor."""
    if n < window:
        return np.empty(0, np.int64)
    edge = np.zeros(n + 2, np.int32)
    np.add.at(edge, np.maximum(anchors - period + 1, 0), 1)
    np.add.at(edge, np.minimum(anchors, n - window) + 1, -1)
    return np.flatnonzero(np.cumsum(edge[: n - window + 1]) > 0)


def _windows(near: DataFrame, window: int, period: int) -> DataFrame:
    def start():
        hashes = WordHashes()

        def each(columns):
            found = []
            for text, a, b, anchors in zip(*columns, strict=True):
                own = hashes.of(text)
                at = _starts_near(np.array(anchors, np.int64), len(own), window, period)
                if len(at):
                    other = mixed(own ^ np.uint64(0xA5A5A5A5A5A5A5A5))
                    found.append((hashes.windows(own, window)[at], hashes.windows(other, window)[at] >> np.uint64(32), a, b, at))
            if not found:
                return None
            sizes = [len(x[0]) for x in found]
            return {
                "w1": np.concatenate([x[0] for x in found]).view(np.int64),
                "w2": np.concatenate([x[1] for x in found]).astype(np.uint32).view(np.int32),
                "a": np.repeat(np.array([x[2] for x in found], np.int64), sizes),
                "b": np.repeat(np.array([x[3] for x in found], np.int64), sizes),
                "at": np.concatenate([x[4] for x in found]).astype(np.int32),
            }

        return each

    return map_blocks(near, start, "w1 long, w2 int, a long, b long, at int")


def covered(n: int, starts, window: int) -> np.ndarray:
    """Which of ``n`` words lie in a window that begins at one of ``starts``."""
    edge = np.zeros(n + 1, np.int32)
    if starts is not None and len(starts):
        starts = np.unique(np.asarray(starts, np.int64))
        edge[starts] += 1
        np.add.at(edge, starts + window, -1)
    return np.cumsum(edge[:n]) > 0


def repeated_starts(docs: DataFrame, window: int = WINDOW, period: int = PERIOD, cover: tuple[int, ...] = COVER) -> DataFrame:
    """Per row key, the starts of windows whose words also start elsewhere: (a, b, starts)."""
    check_cover(period, cover)
    if window < period:
        raise ValueError("a window must be at least as long as the period")
    rows = docs.select("text", row_key().alias("key")).select("text", "key.*")
    anchors = _anchors(rows, window, period, cover)
    twice = shared(anchors.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor"))
    some = sifted(anchors, sieve(twice, "anchor"), "anchor")
    near = shared(some.join(twice, "anchor").groupBy("a", "b").agg(F.collect_set("at").alias("anchors")))
    texts = sifted(rows, sieve(near, "a", "b"), "a", "b")
    whole = shared(_windows(texts.join(near, ["a", "b"]).select("text", "a", "b", "anchors"), window, period))
    again = whole.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("w1", "w2")
    return shared(whole.join(again, ["w1", "w2"]).groupBy("a", "b").agg(F.collect_set("at").alias("starts")))


def substring_dedup(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Each row's words left after the repeated windows are cut: (doc_id, n_words, n_removed, text).

    Windows are judged on the input. Null and empty texts have no words and an empty text.
    Repeated rows are copies of one another, also with the same or no id, and lose every word
    that a window covers. Extra columns are ignored.
    """
    return _left(docs, window, "doc_id long, n_words long, n_removed long, text string", lambda words: b" ".join(words).decode())


def substring_digest(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """As ``substring_dedup``, with the SHA-256 of the text that is left."""
    return _left(
        docs, window, "doc_id long, n_words long, n_removed long, kept_sha256 string",
        lambda words: hashlib.sha256(b" ".join(words)).hexdigest(),
    )


def cut_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with the repeated windows cut from ``text``; other columns and rows as they are.

    A text that loses words becomes the words left, joined by one space; others stay untouched.
    """
    starts = repeated_starts(docs, window)
    rows, bits = keyed(docs), sieve(starts, "a", "b")

    @F.pandas_udf("string")
    def cut(text: pd.Series, at: pd.Series) -> pd.Series:
        return pd.Series([t if s is None else _cut(words_of(t), s, window).decode() for t, s in zip(text, at, strict=True)])

    touched = sifted(rows, bits, *KEY).join(starts.toDF(*KEY, "__starts"), [*KEY], "left")
    text = F.when(F.col("__starts").isNull(), F.col("text")).otherwise(cut("text", "__starts"))
    changed = touched.withColumn("text", text).select(*docs.columns)
    return sifted(rows, bits, *KEY, inside=False).select(*docs.columns).unionByName(changed)


def _cut(words: list[bytes], starts, window: int) -> bytes:
    gone = covered(len(words), starts, window)
    return b" ".join([w for w, out in zip(words, gone.tolist(), strict=True) if not out])


def _left(docs: DataFrame, window: int, schema: str, told) -> DataFrame:
    starts = repeated_starts(docs, window)
    rows = docs.select("doc_id", "text", row_key().alias("key")).select("doc_id", "text", "key.a", "key.b")
    bits = sieve(starts, "a", "b")
    hit = sifted(rows, bits, "a", "b").join(starts, ["a", "b"], "left").select("doc_id", "text", "starts")
    rest = sifted(rows, bits, "a", "b", inside=False).select("doc_id", "text", F.lit(None).cast("array<int>").alias("starts"))

    def start():
        def each(doc_id, text, at):
            words = words_of(text)
            if not at:
                yield doc_id, len(words), 0, told(words)
                return
            gone = covered(len(words), at, window)
            left = [w for w, out in zip(words, gone.tolist(), strict=True) if not out]
            yield doc_id, len(words), len(words) - len(left), told(left)

        return each

    return map_rows(hit.unionByName(rest), start, schema)
