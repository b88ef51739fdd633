"""Quality rules by tokeniser fertility (operator 2).

A public vocabulary tells how a text looks to a tokeniser trained on ordinary writing:
characters per token (prose in a known script has several; symbol noise and cut-up text have
few, a repeated common word has many), the share of tokens that are single raw bytes because
no piece fits, and the entropy of the token distribution (low where few tokens repeat).

Each measure has a rejection band per language and size class (powers of two of tokens, as
entropy grows with length). Bands are centred on the corpus: the median over all documents that
pass the base rules, plus and minus ``REACH`` interquartile ranges. A language with fewer than
``LEAST_DOCS`` such documents in a class takes the bands of all languages.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from punctuality.llm.texts import Remembered, WordHashes, map_rows, shared, words_of

VOCABULARY = "piece_bpe_32k.model"
SYMBOLS = "[#*$%&|<>]"
#: Interquartile ranges that a band reaches from the median; too few characters per token and
#: too many, too many raw bytes, too little entropy are rejected.
REACH = {"chars_per_token": 4.0, "byte_share": 4.0, "entropy": 2.5}
#: Least interquartile range that counts, as a share of the median and absolute.
LEAST_SPREAD = (0.02, 0.005)
#: Texts of 2**14 tokens or more are one class.
LARGEST_CLASS = 14
LEAST_DOCS = 50
MIN_WORDS, REPEAT_WORDS, REPEAT_SHARE = 10, 5, 20

_COUNTS = (
    "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
    "n_repeat_words long, base_failed boolean, n_tokens long, chars_per_token double, "
    "byte_share double, entropy double, size int"
)


def repeated_words(hashes: np.ndarray, windows: np.ndarray, k: int) -> int:
    """Words covered by windows of ``k`` words that occur twice or more in the text."""
    order = np.argsort(windows, kind="stable")
    same = windows[order[1:]] == windows[order[:-1]]
    if not same.any():
        return 0
    hit = np.zeros(len(windows), bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    edge = np.zeros(len(hashes) + 1, np.int32)
    at = np.flatnonzero(hit)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + k, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def duplicate_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [line for line in text.split("\n") if line.strip(" \t\n\r\x0b\x0c")]
    return len(lines) - len(set(lines))


def measured(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Base counts and fertility of every whole text; null texts have no words."""

    def start():
        import public_tokenizers
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path(VOCABULARY))
        byte = np.array([model.is_byte(k) for k in range(model.get_piece_size())])
        size = len(byte)
        known = Remembered(lambda word: np.array(model.encode(word.decode()), "<u2" if size < 65536 else "<u4").tobytes())
        kind = "<u2" if size < 65536 else "<u4"
        symbols = [*SYMBOLS[1:-1]]
        hashes = WordHashes()

        def each(doc_id, text, lang):
            text = text or ""
            words = words_of(text)
            n = len(words)
            chars = sum(map(len, words)) if text.isascii() else len(b"".join(words).decode())
            h = hashes.of(text)
            repeats = repeated_words(h, hashes.windows(h, REPEAT_WORDS), REPEAT_WORDS)
            ids = np.frombuffer(b"".join(map(known.__getitem__, words)), kind)
            t = len(ids)
            counts = np.bincount(ids, minlength=size)
            seen = counts[counts > 0]
            entropy = float(math.log2(t) - (seen * np.log2(seen)).sum() / t) if t else 0.0
            yield (
                doc_id, lang, n, chars, sum(map(text.count, symbols)), duplicate_lines(text), repeats,
                n < MIN_WORDS or 100 * repeats > REPEAT_SHARE * n, t, chars / t if t else 0.0,
                float(counts[byte].sum() / t) if t else 0.0, entropy, min(t.bit_length(), LARGEST_CLASS),
            )

        return each

    return map_rows(docs.select("doc_id", "text", "lang"), start, _COUNTS)


def bands(counts: DataFrame, *keys: str) -> DataFrame:
    """Quartiles of each measure over documents that pass the base rules, per key."""
    at = F.array(*[F.lit(x) for x in (0.25, 0.5, 0.75)])
    quarts = [F.percentile_approx(m, at, 2000).alias(m) for m in REACH]
    return counts.where(~F.col("base_failed")).groupBy(*keys).agg(F.count(F.lit(1)).alias("n_docs"), *quarts)


def _outside(measure: str) -> Column:
    """Whether a measure leaves its band, on the side that counts."""
    q = F.coalesce(F.col(f"own_{measure}"), F.col(f"all_{measure}"))
    share, least = LEAST_SPREAD
    slack = REACH[measure] * F.greatest(q[2] - q[0], F.abs(q[1]) * share, F.lit(least))
    low, high = F.col(measure) < q[1] - slack, F.col(measure) > q[1] + slack
    sides = {"chars_per_token": low | high, "byte_share": high, "entropy": low}
    return F.coalesce(sides[measure], F.lit(False))


def fertility_rules(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Base counts, fertility and a verdict for every row of ``docs`` (doc_id, text, lang).

    A null or empty text has no words and fails the base rule. A null language takes the bands
    of all languages, and so does a rare one. Repeated rows come out one for one. Where no
    document passes the base rules there are no bands, and the base rule alone decides.
    """
    counts = shared(measured(docs, path))
    # A row per language and size class: Spark broadcasts them by their size, or does not.
    own = bands(counts, "lang", "size").where(F.col("n_docs") >= LEAST_DOCS)
    own = own.select("lang", "size", *[F.col(m).alias(f"own_{m}") for m in REACH])
    whole = bands(counts, "size").select("size", *[F.col(m).alias(f"all_{m}") for m in REACH])
    judged = counts.join(own, ["lang", "size"], "left").join(whole, "size", "left")
    rejected = _outside("chars_per_token") | _outside("byte_share") | _outside("entropy")
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & ~rejected).alias("kept"),
        "lang", "n_tokens", "chars_per_token", "byte_share", "entropy",
    )
