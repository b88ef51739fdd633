"""Toxicity by a classifier chain (operator 10).

Categories are predicted one after the other by linear models over the same features: which
words and which runs of four characters of a word occur in the text at all. A later model also
gets the probabilities of the categories before it. In training those are out-of-fold: each
fold's come from a model that never saw the fold, so that later models learn how far earlier
ones can be trusted on unseen text.

Features are all grams of two or more rows of a category that are mostly of it, counted by Spark
over the training rows; the ridge penalty deals with those that are so by chance. Training rows
are a documented bounded sample of the labelled rows (``TRAIN_ROWS``), drawn by a hash of the id;
the models are fitted in numpy on the driver. Scoring reads every whole text.
"""

from __future__ import annotations

import string
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from punctuality.llm.texts import Remembered, begun, kept_rows, map_rows, shared, small_batches, words_of, worker_memo

TRAIN_ROWS, FOLDS = 20_000, 5
#: Of the rows that hold a feature, this share must be of a category, and so many rows at least.
LEAST_SHARE, LEAST_ROWS = 0.5, 2
GRAM, PENALTY, STEPS = 4, 3e-7, 50
#: Words whose presence in a text labelled toxic makes it an example of a category.
CATEGORY_TERMS = {
    "insult": ("idiot", "moron", "loser", "clown", "stupid", "fool", "imbecile", "dumb"),
    "contempt": ("trash", "scum", "worthless", "pathetic", "disgusting", "garbage", "filth", "vermin"),
}
CATEGORIES = (*CATEGORY_TERMS, "toxic")


_EDGES = string.punctuation + "«»…“”‘’„¿¡–—"


def grams(word: bytes) -> tuple[str, ...]:
    """A word and its runs of ``GRAM`` characters, edges marked; case is folded."""
    core = word.decode("utf-8", "replace").lower().strip(_EDGES)
    if not core:
        return ()
    core = f"^{core}$"
    return (core + "=", *{core[i : i + GRAM] for i in range(max(1, len(core) - GRAM + 1))})


#: Words that a worker remembers with their features; one model's memo at a time.
FEATURE_WORDS = 200_000


@worker_memo
def _features_of_words(chosen: tuple[str, ...]) -> Remembered:
    """Numbers of the chosen grams in a word; one memo for all tasks of a Python worker."""
    features = {gram: i for i, gram in enumerate(chosen)}

    def of(word: bytes) -> tuple[int, ...]:
        return tuple([features[g] for g in grams(word) if g in features])

    return Remembered(of, FEATURE_WORDS)


def features_in(text: str | None, known: Remembered) -> list[int]:
    return sorted(set().union(*filter(None, map(known.__getitem__, words_of(text)))))


@dataclass
class Chain:
    categories: tuple[str, ...]
    features: tuple[str, ...]
    weights: list[np.ndarray]  # per category: features, earlier probabilities, intercept

    def probabilities(self, present: list[int]) -> list[float]:
        out: list[float] = []
        n = len(self.features)
        for w in self.weights:
            z = w[-1] + w[present].sum() + sum(p * w[n + k] for k, p in enumerate(out))
            out.append(float(1 / (1 + np.exp(-z))))
        return out


def weak_labels(text: Column, toxic: Column) -> dict[str, Column]:
    """0/1 columns of the categories, from the toxic label and the terms."""
    said = F.lower(text)
    found = {
        name: F.when((toxic == 1) & said.rlike(rf"(?U)\b({'|'.join(terms)})\b"), 1).otherwise(0)
        for name, terms in CATEGORY_TERMS.items()
    }
    return found | {"toxic": (toxic == 1).cast("int")}


def sampled(labels: DataFrame, rows: int, *columns: str) -> DataFrame:
    """About ``rows`` of the labels at most, by a hash of the id; small enough to broadcast."""
    usable = labels.where(F.col("doc_id").isNotNull()).select("doc_id", *columns)
    share = min(1.0, rows / max(1, usable.count()))
    return usable.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))


def fit(labelled: DataFrame, categories: tuple[str, ...] = CATEGORIES) -> Chain:
    """Chain over ``labelled`` (doc_id, text, one 0/1 column per category), in that order.

    Rows with a null text count as empty. A category with one value only is predicted as its
    share. Without rows every probability is 0.
    """
    labelled = shared(labelled.select("doc_id", "text", F.array(*[F.col(c).cast("int") for c in categories]).alias("marks")))

    held = _gram_counts(labelled, len(categories))
    sums = [F.sum(F.col("marks")[k]).alias(f"n{k}") for k in range(len(categories))]
    counts = held.groupBy("gram").agg(F.sum("n").alias("n"), *[F.sum(F.col("counts")[k]).alias(f"n{k}") for k in range(len(categories))])
    whole = labelled.agg(F.count(F.lit(1)).alias("n"), *sums).first()
    if not whole["n"]:
        return Chain(categories, (), [np.array([0.0] * k + [-np.inf]) for k in range(len(categories))])
    telling = F.lit(False)
    for k in range(len(categories)):
        rate = (F.col(f"n{k}") + 0.5) / (F.col("n") + 1.0)
        base = (float(whole[f"n{k}"] or 0) + 0.5) / (float(whole["n"]) + 1)
        telling |= (F.col(f"n{k}") >= LEAST_ROWS) & (rate >= LEAST_SHARE) & (rate > 2 * base)
    chosen = [r["gram"] for r in counts.where(telling).select("gram").collect()]  # bounded by TRAIN_ROWS
    features = tuple(sorted(chosen))

    def each_row():
        known = _features_of_words(features)

        def each(doc_id, text, marks):
            fold = xxhash.xxh3_64_intdigest(str(doc_id).encode()) % FOLDS
            yield fold, np.array(features_in(text, known), np.int32).tobytes(), marks

        return each

    rows = map_rows(labelled, each_row, "fold int, present binary, marks array<int>")
    # Rows alike in features, marks and fold are one row with a weight.
    alike = rows.groupBy("fold", "present", "marks").agg(F.count(F.lit(1)).alias("n")).toArrow().to_pylist()
    alike.sort(key=lambda r: (r["fold"], r["present"], r["marks"]))
    sizes = [len(r["present"]) // 4 for r in alike]
    cells = Cells(
        np.repeat(np.arange(len(alike), dtype=np.int32), sizes),
        np.frombuffer(b"".join(r["present"] for r in alike), np.int32),
        len(features),
        np.zeros((len(alike), 0)),
    )
    y, fold, weight = (np.array([r[c] for r in alike], t) for c, t in (("marks", float), ("fold", int), ("n", float)))
    return Chain(categories, features, fit_chain(cells, y, fold, weight))


@dataclass
class Cells:
    """A matrix of rows with features that are there or not, and some dense columns behind them."""

    row: np.ndarray
    column: np.ndarray
    features: int
    dense: np.ndarray

    @classmethod
    def of(cls, x: Cells | np.ndarray) -> Cells:
        return x if isinstance(x, Cells) else cls(np.empty(0, np.int32), np.empty(0, np.int32), 0, x)

    def beside(self, *columns: np.ndarray) -> Cells:
        return Cells(self.row, self.column, self.features, np.column_stack([self.dense, *columns]))

    def width(self) -> int:
        return self.features + self.dense.shape[1]

    def times(self, v: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, v[self.column], len(self.dense)) + self.dense @ v[self.features :]

    def back(self, u: np.ndarray) -> np.ndarray:
        return np.concatenate([np.bincount(self.column, u[self.row], self.features), self.dense.T @ u])

    def squares(self, u: np.ndarray) -> np.ndarray:
        return np.concatenate([np.bincount(self.column, u[self.row], self.features), (self.dense**2).T @ u])


#: Grams that a task counts before it hands them on.
_COUNTED = 400_000


def _gram_counts(labelled: DataFrame, n_categories: int) -> DataFrame:
    """(gram, n, counts): in how many rows, and in how many of each category; partial sums."""
    schema = "gram string, n long, counts array<long>"
    target = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun()
        known = Remembered(grams, 100_000)
        rows, hits = Counter(), [Counter() for _ in range(n_categories)]

        def counted() -> pa.RecordBatch:
            names = list(rows)
            by_category = [[h[g] for h in hits] for g in names]
            made = [pa.array(names, pa.string()), pa.array([rows[g] for g in names], pa.int64()), pa.array(by_category, target.field(2).type)]
            for c in (rows, *hits):
                c.clear()
            return pa.RecordBatch.from_arrays(made, schema=target)

        for batch in batches:
            for text, marks in zip(batch["text"].to_pylist(), batch["marks"].to_pylist(), strict=True):
                own = set().union(*map(known.__getitem__, set(words_of(text))))
                rows.update(own)
                for k, mark in enumerate(marks):
                    if mark:
                        hits[k].update(own)
                if len(rows) >= _COUNTED:
                    yield counted()
        if rows:
            yield counted()

    small_batches(labelled.sparkSession)
    return labelled.select("text", "marks").mapInArrow(run, schema)


def fit_chain(x: Cells | np.ndarray, y: np.ndarray, fold: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
    """Weights of each category's model, the later ones over out-of-fold earlier probabilities."""
    cells, weights, earlier = Cells.of(x), [], []
    for k in range(y.shape[1]):
        inputs = cells.beside(*earlier, np.ones(len(y)))
        unseen = np.zeros(len(y))
        for f in range(FOLDS):
            out = fold == f
            if out.any():  # rows of the fold weigh nothing
                unseen[out] = _sigmoid(inputs.times(logistic(inputs, y[:, k], np.where(out, 0.0, weight))))[out]
        weights.append(logistic(inputs, y[:, k], weight))
        earlier.append(unseen)
    return weights


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def logistic(x: Cells | np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Ridge logistic regression by Newton steps over the cells that are not 0; the last column is the intercept."""
    x = Cells.of(x)
    w, total = np.zeros(x.width()), weight.sum()
    share = float((y * weight).sum() / total) if total else 0.0
    w[-1] = np.log((share + 1e-6) / (1 - share + 1e-6))
    if share in (0.0, 1.0):
        return w
    ridge = np.full(x.width(), PENALTY)
    ridge[-1] = 1e-9

    def loss(v: np.ndarray) -> float:
        z = x.times(v)
        return float((weight * (np.logaddexp(0, z) - y * z)).sum() / total + (ridge * v * v).sum() / 2)

    now = loss(w)
    for _ in range(STEPS):
        p = _sigmoid(x.times(w))
        slope = x.back(weight * (p - y) / total) + ridge * w
        if np.abs(slope).max() < 1e-8:
            break
        bend = weight * p * (1 - p) / total
        step, part = _solved(lambda v: x.back(bend * x.times(v)) + ridge * v, slope, x.squares(bend) + ridge), 1.0
        while (then := loss(w - part * step)) > now and part > 1e-6:
            part /= 2
        w -= part * step
        now = then
    return w


def _solved(bend, slope: np.ndarray, diagonal: np.ndarray) -> np.ndarray:
    """Solution of ``bend`` (x) = slope by conjugate gradients, scaled by the diagonal."""
    x, left = np.zeros_like(slope), slope.copy()
    move = scaled = left / diagonal
    size = left @ scaled
    for _ in range(300):
        image = bend(move)
        rate = size / (move @ image)
        x += rate * move
        left -= rate * image
        if np.abs(left).max() < 1e-4 * np.abs(slope).max():
            break
        scaled = left / diagonal
        size, old = left @ scaled, size
        move = scaled + size / old * move
    return x


def score(docs: DataFrame, chain: Chain, threshold: float = 0.5) -> DataFrame:
    """(doc_id, text_hash, one probability per category, rejected) for every row.

    A null or empty text has no features and gets the intercepts. Rows come out one for one,
    repeated and null ids included. Other columns are ignored.
    """
    names = [f"p_{c}" for c in chain.categories]

    def start():
        known = _features_of_words(chain.features)

        def each(doc_id, text):
            p = chain.probabilities(features_in(text, known))
            yield doc_id, *p, p[-1] >= threshold

        return each

    schema = ", ".join(["doc_id long", *[f"{n} double" for n in names], "rejected boolean"])
    return map_rows(docs.select("doc_id", "text"), start, schema)


def toxic_labels(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """Training rows: texts of a bounded sample of labels, with the categories' marks."""
    some = sampled(labels.where(F.col("toxic").isNotNull()), rows, "toxic")
    both = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")
    marks = weak_labels(F.coalesce(F.col("text"), F.lit("")), F.col("toxic"))
    return both.select("doc_id", "text", *[mark.alias(name) for name, mark in marks.items()])


def clean(docs: DataFrame, chain: Chain, threshold: float = 0.5) -> DataFrame:
    """Rows of ``docs`` that the last category's model does not reject, all columns as they are."""

    def start():
        known = _features_of_words(chain.features)

        def keep(text):
            return chain.probabilities(features_in(text, known))[-1] < threshold

        return keep

    return kept_rows(docs, ["text"], start)
