"""Boosted trees on histograms, with missing values and categories as they are.

Numbers are cut at quantiles into at most 255 bins and one more for missing values; levels of a
category are bins, what is rare, null or new shares the last. A round is a tree grown leaf by
leaf, the leaf with the highest gain first. Its sums of gradients per (node, feature, bin) are
added up by Spark, one pass for all nodes that may be split next. The task that adds a node's sums
finds its best split; the driver sees that split and three totals per node, no sums.

* A pass computes gradients from the trees so far, so nothing but the scores at the last
  checkpoint is stored. Scores are written to the shared folder every ``CHECKPOINT`` rounds.
* Gradients are whole numbers (a fraction of 2**-30 of their range), so sums do not depend on
  the order of rows: the same trees come out for any partitioning and after any retry.
* Nulls take the side of a split that lowers the loss more; where a node has none, the larger.
* ``fit_many`` fits models for all values of a key column in the same passes. A fit whose bins take
  few hundred MB (``LOCAL_CELLS``, ``LOCAL_ROWS``) is not worth a job per pass: its rows meet in one
  task, which makes the same passes over them. Sums are exact, so the trees are the same either way.
* Scoring looks trees up by bins (``_Tables``), two trees at a time and without walking them.
"""

from __future__ import annotations

import base64
import io
import json
import uuid
import zlib
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel, TaskContext, keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols, HasLabelCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from punctuality.operators.categories import MAX_LEVELS
from punctuality.session import materialised

#: Bins of a feature; the last is for what is missing.
BINS = 256
MISSING = BINS - 1
#: Rows that are packed together, rounds between checkpoints of the scores, and the bytes of
#: sums that go directly to one task to be added. More are dealt over several tasks.
PACK_ROWS, CHECKPOINT, DIRECT_BYTES = 65_536, 20, 4 << 20
#: Cells (rows x features) of a task at most, and at least where cores are free; bytes of scores
#: that a Python worker remembers.
TASK_CELLS, LEAST_CELLS, MEMO_BYTES = 1 << 24, 1 << 18, 256 << 20
#: Cells and rows up to which a fit goes into one task as a whole. There, a cell takes 3 bytes at
#: most and a row some 80: label, score, slopes, place, and what is copied while a node is split.
LOCAL_CELLS, LOCAL_ROWS = 1 << 25, 1 << 21
#: Cells of a joint histogram of features, rows of a node that are worth one, rows whose slopes add
#: up exactly in a double, and rows that are scored at once.
JOINT_CELLS, JOINT_ROWS, EXACT_ROWS, SCORED_ROWS = 1 << 13, 1 << 11, 1 << 20, 1 << 14
_ONE = 1 << 30


@dataclass(frozen=True)
class Settings:
    """Fixed values of the defaults: leaves, rows of a leaf and smoothing are the usual ones."""

    loss: str = "logistic"  # or "squared"
    rounds: int = 200
    rate: float = 0.1
    leaves: int = 31
    leaf_rows: int = 20
    leaf_hessian: float = 1e-3
    penalty: float = 0.0
    level_smoothing: float = 10.0


@dataclass
class Bins:
    """Cuts of numbers and bins of levels, per feature."""

    features: list[str]
    rows: int = 0
    cuts: dict[str, list[float]] = field(default_factory=dict)
    levels: dict[str, list[str]] = field(default_factory=dict)

    def of(self, columns: Sequence[pd.Series]) -> np.ndarray:
        """(features, rows) of bytes."""
        out = np.full((len(self.features), len(columns[0])), MISSING, np.uint8)
        for i, (name, values) in enumerate(zip(self.features, columns, strict=True)):
            if name in self.levels:
                known = pd.Index(self.levels[name], dtype=object).get_indexer(values.astype(object))
                out[i] = np.where(known < 0, MISSING, known)
            else:
                numbers = values.astype(np.float64).to_numpy()
                there = ~np.isnan(numbers)
                out[i, there] = np.searchsorted(np.asarray(self.cuts[name], float), numbers[there], "left")
        return out

    def categories(self) -> np.ndarray:
        return np.array([f in self.levels for f in self.features])


@dataclass
class Tree:
    """Nodes as arrays; a leaf has no children. ``left`` tells for each bin which way it goes."""

    feature: np.ndarray
    goes_left: np.ndarray
    children: np.ndarray
    value: np.ndarray

    def parts(self, bins: np.ndarray, rows: dict[int, np.ndarray] | None = None) -> dict[int, np.ndarray]:
        """The rows of each leaf. ``rows`` of nodes further up, where they are known, is used up."""
        open_ = {0: np.arange(bins.shape[1], dtype=np.int32)} if rows is None else rows
        out = {}
        while open_:
            node, own = open_.popitem()
            if self.children[node, 0] < 0:
                out[node] = own
                continue
            open_[int(self.children[node, 0])], open_[int(self.children[node, 1])] = _dealt(own, bins[self.feature[node]], self.goes_left[node])
        return out

    def add(self, bins: np.ndarray, scores: np.ndarray) -> None:
        for node, own in self.parts(bins).items():
            scores[own] += self.value[node]


def _dealt(own: np.ndarray, column: np.ndarray, goes_left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a node that go left, and those that go right."""
    left = goes_left.take(column.take(own))
    return own.take(np.flatnonzero(left)), own.take(np.flatnonzero(~left))


class _Tables:
    """Trees of at most 32 leaves, two at a time, as a table per feature.

    A bin's entry has a bit for each leaf that rows of this bin can reach. The entries of a row's
    bins have one bit in common for each tree: its leaf.
    """

    def __init__(self, trees: Sequence[Tree], features: int):
        self.pairs = []
        for at in range(0, len(trees), 2):
            masks, values = np.full((features, BINS), ~np.uint64(0)), np.zeros(64)
            for i, tree in enumerate(trees[at : at + 2]):
                self._reach(tree, 32 * i, masks, values)
            if at + 1 == len(trees):  # no second tree: one leaf without a value
                masks &= np.uint64((1 << 33) - 1)
            used = np.flatnonzero((masks != np.bitwise_or.reduce(masks, None)).any(1))
            self.pairs.append((used if len(used) else np.array([0]), masks, values))

    @staticmethod
    def _reach(tree: Tree, first: int, masks: np.ndarray, values: np.ndarray) -> None:
        leaf = {int(node): k for k, node in enumerate(np.flatnonzero(tree.children[:, 0] < 0))}
        below = {node: 1 << (first + k) for node, k in leaf.items()}
        for node in reversed(range(len(tree.feature))):  # children come after their parents
            if node not in below:
                sides = [below[int(c)] for c in tree.children[node]]
                gone = np.where(tree.goes_left[node], np.uint64(sides[1]), np.uint64(sides[0]))
                masks[tree.feature[node]] &= ~gone
                below[node] = sides[0] | sides[1]
        masks &= ~np.uint64(((1 << 32) - 1 << first) & ~below[0])
        for node, k in leaf.items():
            values[first + k] = tree.value[node]

    def add(self, bins: np.ndarray, scores: np.ndarray) -> None:
        """The trees' values, tree by tree."""
        for at in range(0, len(scores), SCORED_ROWS):
            out = scores[at : at + SCORED_ROWS]
            slots = bins[:, at : at + SCORED_ROWS].astype(np.intp)
            more = np.empty(len(out), np.uint64)
            for used, masks, values in self.pairs:
                reached = masks[used[0]].take(slots[used[0]])
                for f in used[1:]:
                    np.take(masks[f], slots[f], out=more, mode="clip")
                    reached &= more
                # The one bit of each tree, by the exponent of a float.
                first, second = ((half.astype(np.uint32).astype(np.float32).view(np.int32) >> 23) - 127 for half in (reached, reached >> np.uint64(32)))
                out += values.take(first)
                out += values[32:].take(second)


def learn_bins(rows: DataFrame, fit: str, numeric: Sequence[str], categorical: Sequence[str]) -> dict[str, Bins]:
    """Bins per value of ``fit``: quantiles of all its rows, and its most frequent levels."""
    features = [*categorical, *numeric]
    shares = [k / (BINS - 1) for k in range(1, BINS - 1)]
    number = {c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in numeric}
    cuts = rows.groupBy(fit).agg(F.count(F.lit(1)).alias("_n"), *[F.percentile_approx(e, shares, 10_000).alias(c) for c, e in number.items()])
    out = {}
    for row in cuts.collect():  # one row per fit
        own = {c: sorted(set(row[c] or ())) for c in numeric}
        out[row[fit]] = Bins(features, row["_n"], own)
    if categorical:
        pairs = F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("level")) for c in categorical]))
        counts = rows.select(fit, pairs).where(F.col("level").isNotNull()).groupBy(fit, "column", "level").count()
        rank = F.row_number().over(Window.partitionBy(fit, "column").orderBy(F.col("count").desc(), "level"))
        for bins in out.values():
            bins.levels = {c: [] for c in categorical}
        for row in counts.withColumn("rank", rank).where(F.col("rank") <= MAX_LEVELS).orderBy(fit, "column", "rank").collect():
            out[row[fit]].levels[row["column"]].append(row["level"])
    return out


_PACKED = "fit string, bins binary, label binary, raw binary, pack long"


def _pack(rows: DataFrame, fit: str, label: str, bins: Mapping[str, Bins], starts: Mapping[str, float]) -> DataFrame:
    """Rows of one fit side by side: bins, labels and scores as arrays."""
    features = next(iter(bins.values())).features

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        waiting: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def made(name: str, cut: np.ndarray, labels: np.ndarray) -> pa.RecordBatch:
            nonlocal number
            packed = [cut.tobytes()], [labels.tobytes()], [np.full(len(labels), starts[name]).tobytes()]
            number += 1
            return pa.RecordBatch.from_arrays(
                [pa.array([name]), *(pa.array(x, pa.binary()) for x in packed), pa.array([number])],
                names=["fit", "bins", "label", "raw", "pack"],
            )

        for batch in batches:
            frame = batch.to_pandas()
            for name, own in frame.groupby("_fit", sort=True):
                cut, labels = bins[name].of([own[f] for f in features]), own["_label"].to_numpy(np.float64)
                if name in waiting:
                    cut, labels = np.concatenate([waiting[name][0], cut], axis=1), np.concatenate([waiting[name][1], labels])
                whole = len(labels) - len(labels) % PACK_ROWS
                for at in range(0, whole, PACK_ROWS):
                    yield made(name, cut[:, at : at + PACK_ROWS], labels[at : at + PACK_ROWS])
                waiting[name] = cut[:, whole:], labels[whole:]
        for name, (cut, labels) in waiting.items():
            if len(labels):
                yield made(name, cut, labels)

    levels = next(iter(bins.values())).levels
    typed = [F.col(f).cast("string" if f in levels else "double").alias(f) for f in features]
    chosen = rows.select(F.col(fit).alias("_fit"), F.col(label).cast("double").alias("_label"), *typed)
    return chosen.mapInArrow(run, _PACKED)


def _slopes(loss: str, label: np.ndarray, raw: np.ndarray, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """Gradients and hessians as whole numbers."""
    if loss == "squared":
        return np.rint((raw - label) * scale), np.ones(len(raw))
    p = 1.0 / (1.0 + np.exp(-raw))
    return np.rint((p - label) * scale), np.rint(p * (1.0 - p) * scale)


class _Growing:
    """A tree while it grows: sums of its open nodes, and their best splits."""

    def __init__(self, settings: Settings, categories: np.ndarray, scale: float, ahead: bool = True):
        self.settings, self.categories, self.ahead = settings, categories, ahead
        self.units = np.array([scale, 1.0 if settings.loss == "squared" else scale, 1.0])
        self.sums: dict[int, np.ndarray] = {}  # of fits in one task
        self.totals: dict[int, np.ndarray] = {}
        self.splits: dict[int, tuple] = {}
        self.made: dict[int, tuple[int, int]] = {}  # children that exist, taken or not
        self.taken: dict[int, None] = {}  # in the order in which they were split
        self.path: dict[int, tuple] = {0: ()}  # breaks ties, whatever was opened ahead
        self.leaves = {0}
        self.nodes = 1
        self.smaller: dict[int, int] = {}

    def wanted(self) -> dict[int, int]:
        """{node to be summed: its parent}; the root has none."""
        if 0 not in self.sums:
            return {0: -1}
        return {small: parent for parent, small in self.smaller.items() if small not in self.sums}

    def asked(self) -> list[int]:
        """Nodes whose splits are not known."""
        return [n for n in (0, *(c for both in self.made.values() for c in both)) if n not in self.totals]

    def told(self, found: Mapping[int, tuple]) -> None:
        """Totals and best splits of the nodes that were asked for."""
        for node in self.asked():
            self.totals[node], self.splits[node] = found.get(node, (np.zeros(3), None))

    def take(self, found: Mapping[int, np.ndarray]) -> None:
        fresh = []
        for node, parent in self.wanted().items():
            self.sums[node] = found.get(node, np.zeros((len(self.categories), BINS, 3), np.int64))
            fresh.append(node)
            if parent >= 0:
                other = sum(self.made[parent]) - node
                self.sums[other] = self.sums[parent] - self.sums[node]
                fresh.append(other)
        for node, (total, split) in zip(fresh, _judged([self.sums[n] for n in fresh], self.units, self.categories, self.settings), strict=True):
            self.totals[node], self.splits[node] = total, split

    def grow(self) -> bool:
        """Split leaves as far as sums are known; False when the tree is done."""
        while len(self.leaves) < self.settings.leaves:
            able = [n for n in self.leaves if self.splits[n] is not None]
            if not able:
                return False
            best = min(able, key=self._rank)
            if best in self.made:
                self.taken[best] = None
                self.leaves = (self.leaves - {best}) | set(self.made[best])
                continue
            # So many can still be split, of these leaves or of those that were opened ahead of
            # them; the best are all summed in the next pass.
            ends = [n for n, split in self.splits.items() if split is not None and n not in self.made] if self.ahead else []
            for node in dict.fromkeys([best, *sorted(ends, key=self._rank)[: self.settings.leaves - len(self.leaves)]]):
                self._open(node)
            return True
        return False

    def _rank(self, node: int) -> tuple:
        return -self.splits[node][0], self.path[node]

    def _open(self, node: int) -> None:
        _, _, _, left_rows, right_rows = self.splits[node]
        self.made[node] = self.nodes, self.nodes + 1
        for side, child in enumerate(self.made[node]):
            self.path[child] = (*self.path[node], side)
        self.smaller[node] = self.nodes if left_rows <= right_rows else self.nodes + 1
        self.nodes += 2

    def _tree(self, inner: Sequence[int]) -> Tree:
        """The nodes below ``inner``, numbered anew in this order."""
        nodes = [0, *(c for n in inner for c in self.made[n])]
        self.number = {n: i for i, n in enumerate(nodes)}
        feature, goes_left = np.zeros(len(nodes), np.int32), np.zeros((len(nodes), BINS), bool)
        children = np.full((len(nodes), 2), -1, np.int32)
        for node in inner:
            _, feature[self.number[node]], goes_left[self.number[node]], _, _ = self.splits[node]
            children[self.number[node]] = [self.number[c] for c in self.made[node]]
        return Tree(feature, goes_left, children, np.zeros(len(nodes)))

    def opened(self) -> Tree:
        return self._tree(list(self.made))  # all nodes: numbers stay as they are

    def done(self) -> Tree:
        tree = self._tree(list(self.taken))
        for node in self.leaves:
            g, h, _ = self.totals[node]
            tree.value[self.number[node]] = -self.settings.rate * g / (h + self.settings.penalty) if h > 0 else 0.0
        return tree


def _judged(sums: Sequence[np.ndarray], units: np.ndarray, categories: np.ndarray, settings: Settings) -> list[tuple]:
    """(totals, best split) of nodes. A node of fewer rows than two leaves stays one."""
    able = [i for i, own in enumerate(sums) if own[0, :, 2].sum() >= 2 * settings.leaf_rows]
    splits = dict(zip(able, best_splits([sums[i] / units for i in able], categories, settings), strict=True))
    return [(own[0].sum(0) / units, splits.get(i)) for i, own in enumerate(sums)]


def best_splits(sums: Sequence[np.ndarray], categories: np.ndarray, settings: Settings) -> list[tuple | None]:
    """(gain, feature, which bins go left, rows left, rows right) of each node, None without gain.

    ``sums`` are gradients, hessians and rows per feature and bin. Equal gains go to the earlier
    feature, to nulls on the right, and to the smaller cut.
    """
    if not len(sums):
        return []
    g, h, n = np.moveaxis(np.stack(sums), -1, 0)
    order = None
    if categories.any():
        ratio = g[:, categories] / (h[:, categories] + settings.level_smoothing)
        order = np.broadcast_to(np.arange(BINS), g.shape).copy()
        order[:, categories] = np.argsort(np.where(n[:, categories] > 0, ratio, np.inf), axis=2, kind="stable")
        g, h, n = (np.take_along_axis(x, order, 2) for x in (g, h, n))
    whole = [x[:, 0].sum(1)[:, None, None] for x in (g, h, n)]  # every feature adds up to the node
    left = [np.cumsum(x[:, :, :-1], 2) for x in (g, h, n)]
    nulls = np.where(categories[None, :], 0.0, n[:, :, -1])
    gains = np.full((len(sums), len(categories), 2, BINS - 1), -np.inf)
    gains[:, :, 0] = _gains(*left, *whole, settings)  # nulls right
    some = nulls.any(0)
    if some.any():
        with_nulls = [x[:, some] + y[:, some, -1:] for x, y in zip(left, (g, h, n), strict=True)]
        gains[:, some, 1] = np.where(nulls[:, some, None] > 0, _gains(*with_nulls, *whole, settings), -np.inf)
    out = []
    for node, own in enumerate(gains):
        feature, nulls_left, cut = np.unravel_index(int(np.argmax(own)), own.shape)
        best = float(own[feature, nulls_left, cut])
        if not best > 1e-12:
            out.append(None)
            continue
        left_rows = float(left[2][node, feature, cut] + nulls_left * nulls[node, feature])
        right_rows = float(whole[2][node, 0, 0]) - left_rows
        goes_left = np.zeros(BINS, bool)
        goes_left[order[node, feature, : cut + 1] if categories[feature] else slice(cut + 1)] = True
        if categories[feature]:
            rows = np.empty(BINS)
            rows[order[node, feature]] = n[node, feature]
            goes_left[rows == 0] = left_rows > right_rows  # levels that the node has not seen
        else:
            goes_left[MISSING] = nulls_left if nulls[node, feature] > 0 else left_rows > right_rows
        out.append((best, int(feature), goes_left, left_rows, right_rows))
    return out


def _gains(g, h, n, all_g, all_h, all_n, settings: Settings) -> np.ndarray:
    """Gain of each cut from the sums left of it; -inf where a side is too small."""
    other_g, other_h = all_g - g, all_h - h
    fine = (n >= settings.leaf_rows) & (all_n - n >= settings.leaf_rows) & (h >= settings.leaf_hessian) & (other_h >= settings.leaf_hessian)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = g * g / (h + settings.penalty) + other_g * other_g / (other_h + settings.penalty) - all_g * all_g / (all_h + settings.penalty)
    return np.where(fine, gain, -np.inf)


def _node_sums(rows: np.ndarray, bins: np.ndarray, slopes: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Sums of some rows per feature and bin."""
    own = [w[rows] for w in slopes]
    total = np.empty((len(bins), BINS, 3), np.int64)
    for f, column in enumerate(bins):
        slot = column[rows].astype(np.intp)
        for k, weight in enumerate((*own, None)):
            total[f, :, k] = np.bincount(slot, weight, BINS)
    return total


class _Joint:
    """Features of few bins counted together: one histogram over all combinations of a group's bins,
    added up per feature after. Nodes of few rows are counted per feature."""

    def __init__(self, bins: np.ndarray):
        self.bins, self.starts = bins, np.arange(0, len(bins) * BINS, BINS)[:, None]
        # Bins in use, and one for missing values.
        widths = [2 + int(np.where(column == MISSING, 0, column).max(initial=0)) for column in bins]
        self.features, self.groups = len(bins), []
        for f in sorted(range(len(bins)), key=lambda f: (-widths[f], f)):
            group = next((g for g in self.groups if widths[f] * np.prod([widths[x] for x in g]) <= JOINT_CELLS), None)
            group.append(f) if group is not None else self.groups.append([f])
        self.widths = [[widths[f] for f in group] for group in self.groups]
        self.codes = np.empty((len(self.groups), bins.shape[1]), np.uint16)
        for code, group, own in zip(self.codes, self.groups, self.widths, strict=True):
            code[:] = 0
            for f, width in zip(group, own, strict=True):
                code *= np.uint16(width)
                code += np.minimum(bins[f], width - 1)

    def sums(self, rows: np.ndarray, slopes: np.ndarray) -> np.ndarray:
        """As :func:`_node_sums`, of rows in order; ``slopes`` are complex, gradients and hessians."""
        if len(rows) < JOINT_ROWS:
            slot, weight = (self.bins.take(rows, 1) + self.starts).ravel(), slopes.take(rows)
            weights = *(np.tile(w, self.features) for w in (weight.real, weight.imag)), None
            sums = [np.bincount(slot, w, self.features * BINS) for w in weights]
            return np.stack(sums, -1).astype(np.int64).reshape(self.features, BINS, 3)
        total = np.zeros((self.features, BINS, 3), np.int64)
        for at in range(0, len(rows), EXACT_ROWS):
            some = rows[at : at + EXACT_ROWS]
            every = slice(at, at + len(some)) if len(rows) == len(slopes) else None
            weight = slopes[every] if every else slopes.take(some)
            for code, group, widths in zip(self.codes, self.groups, self.widths, strict=True):
                slot = (code[every] if every else code.take(some)).astype(np.intp)
                both = np.zeros(int(np.prod(widths)), np.complex128)
                np.add.at(both, slot, weight)
                count = np.bincount(slot, minlength=len(both)).reshape(widths)
                both = both.reshape(widths)
                for i, f in enumerate(group):
                    others = tuple(j for j in range(len(group)) if j != i)
                    own = both.sum(others)
                    parts = np.stack([own.real, own.imag, count.sum(others)], -1).astype(np.int64)
                    total[f, : widths[i] - 1] += parts[:-1]
                    total[f, MISSING] += parts[-1]
        return total


@dataclass
class _Pack:
    """What a worker remembers of a pack: scores and slopes, and the rows of the open nodes of a tree."""

    trees: int
    scores: np.ndarray
    slopes: tuple[np.ndarray, np.ndarray]
    rows: dict[int, np.ndarray]


#: (run, pack) -> state. A worker that has seen a pack before adds only the trees since, and splits
#: only the nodes opened since; the memo is emptied when full and decides nothing.
_MEMO: dict[tuple, _Pack] = {}


def _state(key: tuple, raw: bytes, label: np.ndarray, bins: np.ndarray, kept: int, trees: Sequence[Tree], tree: Tree, loss: str, scale: float) -> _Pack:
    """A pack after ``kept`` stored trees and the ``trees`` since, its rows dealt to the leaves of ``tree``."""
    own = _MEMO.pop(key, None)
    if own is None or not kept <= own.trees <= kept + len(trees):
        own = _Pack(kept, np.frombuffer(raw).copy(), (), {})
    if own.trees < kept + len(trees) or not own.rows:
        for past in trees[own.trees - kept :]:
            past.add(bins, own.scores)
        own = _Pack(kept + len(trees), own.scores, _slopes(loss, label, own.scores, scale), {0: np.arange(len(label), dtype=np.int32)})
    own.rows = tree.parts(bins, own.rows)
    if sum(len(x.scores) for x in _MEMO.values()) * 28 > MEMO_BYTES:
        _MEMO.clear()
    _MEMO[key] = own
    return own


def _told(packs: RDD, run_id: str, kept: Mapping[str, int], trees: Mapping[str, Sequence[Tree]], growing: Mapping[str, _Growing], settings: Settings, scales: Mapping[str, float], tasks: int) -> dict[str, dict[int, tuple]]:
    """One pass: totals and best splits of all nodes that are asked for, of all fits."""
    asked = {fit: (g.opened(), g.asked()) for fit, g in growing.items()}
    categories = {fit: g.categories for fit, g in growing.items()}
    units = {fit: g.units for fit, g in growing.items()}

    def summed(rows: Iterator[tuple]) -> Iterator[tuple]:
        totals: dict[tuple, np.ndarray] = {}
        for fit, packed, label, raw, pack in rows:
            if fit not in asked:
                continue
            tree, nodes = asked[fit]
            label = np.frombuffer(label)
            bins = np.frombuffer(packed, np.uint8).reshape(-1, len(label))
            own = _state((run_id, pack), raw, label, bins, kept[fit], trees[fit], tree, settings.loss, scales[fit])
            for node in nodes:
                if len(own.rows[node]):
                    found = _node_sums(own.rows[node], bins, own.slopes)
                    if (fit, node) in totals:
                        totals[fit, node] += found
                    else:
                        totals[fit, node] = found
        for key, total in totals.items():
            yield key, total.tobytes()

    def judged(rows: Iterator[tuple]) -> Iterator[tuple]:
        totals: dict[tuple, np.ndarray] = {}
        for key, part in rows:
            part = np.frombuffer(part, np.int64).reshape(len(categories[key[0]]), BINS, 3)
            totals[key] = totals[key] + part if key in totals else part
        for (fit, node), total in totals.items():
            (whole, split), = _judged([total], units[fit], categories[fit], settings)
            yield fit, node, whole, split

    keys = sum(len(nodes) for _, nodes in asked.values())
    size = keys * len(next(iter(categories.values()))) * BINS * 24 * tasks
    meet = min(keys, tasks, 1 + size // max(DIRECT_BYTES, 1))
    out: dict[str, dict[int, tuple]] = {fit: {} for fit in growing}
    for fit, node, whole, split in packs.mapPartitions(summed).partitionBy(meet, _place).mapPartitions(judged).collect():
        out[fit][node] = whole, split
    return out


def _place(key: tuple) -> int:
    """Where a node's sums meet: numbers that follow each other go to different tasks."""
    return key[1] + zlib.crc32(key[0].encode())


def _rescored(packs: DataFrame, trees: Mapping[str, Sequence[Tree]]) -> DataFrame:
    """Packs with the trees' values added to the scores."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fits, packed, _, raws, _ = (c.to_pylist() for c in batch.columns)
            scores = []
            for fit, own, raw in zip(fits, packed, raws, strict=True):
                raw = np.frombuffer(raw).copy()
                bins = np.frombuffer(own, np.uint8).reshape(-1, len(raw))
                for tree in trees[fit]:
                    tree.add(bins, raw)
                scores.append(raw.tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(scores, pa.binary()), batch.column(4)], names=batch.schema.names)

    return packs.mapInArrow(run, _PACKED)


@dataclass
class Boosted:
    """Fitted models, one per value of the key."""

    settings: Settings
    bins: dict[str, Bins]
    starts: dict[str, float]
    trees: dict[str, list[Tree]]
    #: Of the trees, made by the task that first scores rows with them.
    tables: dict[str, _Tables] = field(default_factory=dict, repr=False, compare=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"tables": {}}

    def raw(self, fit: str, columns: Sequence[pd.Series]) -> np.ndarray:
        bins = self.bins[fit].of(columns)
        out = np.full(bins.shape[1], self.starts[fit])
        if all(len(tree.feature) <= 63 for tree in self.trees[fit]):  # 32 leaves
            if fit not in self.tables:
                self.tables[fit] = _Tables(self.trees[fit], len(bins))
            self.tables[fit].add(bins, out)
        else:
            for tree in self.trees[fit]:
                tree.add(bins, out)
        return out

    def column(self, fit=None):
        """The prediction as a column: a probability, or the forecast value. ``fit`` is a
        column; rows of a key without a model get null."""
        logistic, features = self.settings.loss == "logistic", next(iter(self.bins.values())).features

        def predict(key: pd.Series, *columns: pd.Series) -> pd.Series:
            out = pd.Series(np.nan, index=key.index, dtype="float64")
            for name in key.dropna().unique():
                if name in self.trees:
                    own = key == name
                    raw = self.raw(name, [c[own] for c in columns])
                    out[own] = 1.0 / (1.0 + np.exp(-raw)) if logistic else raw
            return out

        key = F.lit(next(iter(self.bins))) if fit is None else fit
        asked = [F.col(f).cast("string") if f in next(iter(self.bins.values())).levels else F.col(f).cast("double") for f in features]
        found = F.pandas_udf(predict, "double")(key, *asked)
        return F.nanvl(found, F.lit(None).cast("double"))

    def dumps(self) -> str:
        whole = {"settings": self.settings.__dict__, "fits": {}}
        arrays = {}
        for i, fit in enumerate(self.bins):
            own = self.trees[fit]
            bins = self.bins[fit]
            whole["fits"][fit] = {"features": bins.features, "rows": bins.rows, "cuts": bins.cuts, "levels": bins.levels, "start": self.starts[fit], "sizes": [len(t.feature) for t in own]}
            if own:
                arrays |= {
                    f"{i}-feature": np.concatenate([t.feature for t in own]),
                    f"{i}-left": np.packbits(np.concatenate([t.goes_left for t in own]), axis=1),
                    f"{i}-children": np.concatenate([t.children for t in own]),
                    f"{i}-value": np.concatenate([t.value for t in own]),
                }
        file = io.BytesIO()
        np.savez_compressed(file, **arrays)
        return json.dumps(whole | {"arrays": base64.b64encode(file.getvalue()).decode()})

    @staticmethod
    def loads(text: str) -> Boosted:
        whole = json.loads(text)
        arrays = np.load(io.BytesIO(base64.b64decode(whole["arrays"])))
        out = Boosted(Settings(**whole["settings"]), {}, {}, {})
        for i, (fit, own) in enumerate(whole["fits"].items()):
            out.bins[fit] = Bins(own["features"], own["rows"], own["cuts"], own["levels"])
            out.starts[fit], out.trees[fit] = own["start"], []
            ends = np.cumsum([0, *own["sizes"]])
            if own["sizes"]:
                feature, left, children, value = (arrays[f"{i}-{x}"] for x in ("feature", "left", "children", "value"))
                left = np.unpackbits(left, axis=1).astype(bool)
                for a, b in zip(ends[:-1], ends[1:], strict=True):
                    out.trees[fit].append(Tree(feature[a:b], left[a:b], children[a:b], value[a:b]))
        return out


def _starts(rows: DataFrame, fit: str, label: str, settings: Settings) -> tuple[dict[str, float], dict[str, float]]:
    """First score and unit of the gradients of each fit."""
    value = F.col(label).cast("double")
    starts, scales = {}, {}
    for row in rows.groupBy(fit).agg(F.avg(value).alias("mean"), F.min(value).alias("low"), F.max(value).alias("high")).collect():
        mean = float(row["mean"])
        if settings.loss == "logistic":
            p = min(max(mean, 1e-15), 1 - 1e-15)
            starts[row[fit]], scales[row[fit]] = float(np.log(p / (1 - p))), float(_ONE)
        else:
            reach = max(row["high"] - mean, mean - row["low"])
            starts[row[fit]], scales[row[fit]] = mean, _ONE / reach if reach > 0 else float(_ONE)
    return starts, scales


def _fit_here(settings: Settings, categories: np.ndarray, bins: np.ndarray, label: np.ndarray, start: float, scale: float) -> list[Tree]:
    """All rounds of a fit whose rows lie in one task: the passes without the jobs.

    Here the rows of a node are at hand, so a pass sums those of one node only.
    """
    joint, every = _Joint(bins), np.arange(len(label))
    raw, trees = np.full(len(label), start), []
    for _ in range(settings.rounds):
        own, rows = _Growing(settings, categories, scale, ahead=False), {0: every}
        slopes = np.empty(len(label), np.complex128)
        slopes.real, slopes.imag = _slopes(settings.loss, label, raw, scale)
        going = True
        while going:
            (node, parent), = own.wanted().items()
            if parent >= 0:
                _, feature, goes_left, _, _ = own.splits[parent]
                for child, side in zip(own.made[parent], _dealt(rows.pop(parent), bins[feature], goes_left), strict=True):
                    rows[child] = side
            own.take({node: joint.sums(rows[node], slopes)})
            going = own.grow()
        if not own.taken:
            break
        tree = own.done()
        for node in own.leaves:
            raw[rows[node]] += tree.value[own.number[node]]
        trees.append(tree)
    return trees


def _small_fits(packs: DataFrame, model: Boosted, scales: Mapping[str, float]) -> None:
    """Fits of at most ``LOCAL_CELLS`` cells, each in a task of its own, all at once."""
    settings, bins, starts = model.settings, model.bins, model.starts

    def fitted(key: tuple, group: pa.Table) -> pa.Table:
        name = key[0].as_py()
        group = group.sort_by("pack")
        label = np.concatenate([np.frombuffer(x) for x in group["label"].to_pylist()])
        cut = np.concatenate([np.frombuffer(x, np.uint8).reshape(len(bins[name].features), -1) for x in group["bins"].to_pylist()], axis=1)
        trees = _fit_here(settings, bins[name].categories(), cut, label, starts[name], scales[name])
        one = Boosted(settings, {name: bins[name]}, {name: starts[name]}, {name: trees})
        return pa.table({"fit": [name], "state": [one.dumps()]})

    # Many more partitions than fits, a number of its own: fits seldom share a task.
    dealt = packs.drop("raw").repartition(min(8 * len(bins), 4096), "fit")
    for row in dealt.groupBy("fit").applyInArrow(fitted, "fit string, state string").collect():
        model.trees[row["fit"]] = Boosted.loads(row["state"]).trees[row["fit"]]


def _held(packs: DataFrame, tasks: int) -> tuple[DataFrame, RDD]:
    """Packs written to the shared folder, and kept in memory, dealt evenly over ``tasks``."""
    stored = materialised(packs, "boosting-packs")
    return stored, stored.repartition(tasks).rdd.map(tuple).persist(StorageLevel.MEMORY_AND_DISK)


def fit_many(rows: DataFrame, fit: str, label: str, numeric: Sequence[str], categorical: Sequence[str] = (), settings: Settings = Settings()) -> Boosted:
    """One model for each value of the text column ``fit``, all in the same passes over ``rows``.

    Rows without a label or a key are left out. The driver holds the trees, whatever the rows. A
    pass has as many tasks as there are cores, more for very many rows, so that the sums that are
    shuffled grow with the cores, not with the rows.
    """
    rows = rows.select(F.col(fit).cast("string").alias(fit), label, *categorical, *numeric).na.drop(subset=[fit, label])
    rows = materialised(rows, "boosting-rows")
    bins = learn_bins(rows, fit, numeric, categorical)
    if not bins:
        raise ValueError("no rows with a label to fit on")
    starts, scales = _starts(rows, fit, label, settings)
    model = Boosted(settings, bins, starts, {name: [] for name in bins})
    cells = {name: own.rows * len(own.features) for name, own in bins.items()}
    small = [name for name in bins if cells[name] <= LOCAL_CELLS and bins[name].rows <= LOCAL_ROWS]
    cores = rows.sparkSession.sparkContext.defaultParallelism
    dealt = min(cores, sum(cells.values()) // LEAST_CELLS)
    packs = _pack(rows.repartition(dealt) if len(small) < len(bins) and dealt > 1 else rows, fit, label, bins, starts)
    if small:
        _small_fits(packs.where(F.col("fit").isin(small)), model, scales)
    live = set(bins) - set(small)
    if not live:
        return model
    whole = sum(cells[name] for name in live)
    tasks = 1 + max(whole // TASK_CELLS, min(whole // LEAST_CELLS, cores - 1))
    packs, held = _held(packs.where(F.col("fit").isin(list(live))), tasks)
    run_id = uuid.uuid4().hex
    kept = dict.fromkeys(live, 0)  # trees that the stored scores contain
    for n in range(1, settings.rounds + 1):
        growing = {name: _Growing(settings, bins[name].categories(), scales[name]) for name in live}
        since = {name: model.trees[name][kept[name] :] for name in kept}
        open_ = dict(growing)
        while open_:
            found = _told(held, run_id, kept, since, open_, settings, scales, tasks)
            for name, own in list(open_.items()):
                own.told(found[name])
                if not own.grow():
                    del open_[name]
        for name, own in growing.items():
            if own.taken:
                model.trees[name].append(own.done())
            else:  # no split gains anything; nor would any later one
                live.discard(name)
        if not live:
            break
        if n % CHECKPOINT == 0 and n < settings.rounds:
            since = {name: model.trees[name][kept[name] :] for name in kept}
            held.unpersist()
            packs, held = _held(_rescored(packs, since), tasks)
            kept = {name: len(model.trees[name]) for name in kept}
    held.unpersist()
    return model


class _BoostingParams(HasInputCols, HasLabelCol, DefaultParamsReadable, DefaultParamsWritable):
    categories = Param(Params._dummy(), "categories", "which of the inputs are levels", TypeConverters.toListString)
    outputCol = Param(Params._dummy(), "outputCol", "forecast of the squared loss", TypeConverters.toString)
    settings = Param(Params._dummy(), "settings", "settings as JSON", TypeConverters.toString)
    state = Param(Params._dummy(), "state", "the fitted trees", TypeConverters.toString)


class HistogramBoosting(Estimator, _BoostingParams):
    """One model as a pipeline stage; gives ``probability`` (logistic) or ``outputCol`` (squared)."""

    @keyword_only
    def __init__(self, *, inputCols=(), categories=(), labelCol="label", outputCol="predicted", settings="{}"):
        super().__init__()
        self._set(inputCols=list(inputCols), categories=list(categories), labelCol=labelCol, outputCol=outputCol, settings=settings)

    def _fit(self, dataset):
        levels = self.getOrDefault("categories")
        numeric = [c for c in self.getInputCols() if c not in levels]
        rows = dataset.withColumn("_fit", F.lit("all"))
        settings = Settings(**json.loads(self.getOrDefault("settings")))
        model = fit_many(rows, "_fit", self.getLabelCol(), numeric, levels, settings)
        return HistogramBoostingModel()._set(inputCols=self.getInputCols(), outputCol=self.getOrDefault("outputCol"), state=model.dumps())


class HistogramBoostingModel(Model, _BoostingParams):
    def boosted(self) -> Boosted:
        return Boosted.loads(self.getOrDefault("state"))

    def _transform(self, dataset):
        model = self.boosted()
        found = model.column()
        if model.settings.loss == "logistic":
            return dataset.withColumn("_p", found).withColumn("probability", array_to_vector(F.array(1.0 - F.col("_p"), F.col("_p")))).drop("_p")
        return dataset.withColumn(self.getOrDefault("outputCol"), found)
