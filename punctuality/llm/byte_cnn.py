"""Quality classifier: a byte-level convolutional network in numpy (operator 8).

A text is its UTF-8 bytes. Each byte has a learned embedding and one computed channel: whether
the eight bytes that end here also ended a few bytes before (words repeated on the spot).
Learned filters slide over overlapping chunks that cover the whole text and are max-pooled in
each chunk; a text's vector is the maximum and the mean of its chunks, and a logistic layer
makes it one probability. As the embedding meets the filters linearly, scoring looks up one
table per filter tap.

Training is by Adam on a documented bounded sample: ``TRAIN_ROWS`` labelled rows, drawn by a
hash of the id, of at most ``TRAIN_CHARS`` characters each. Scoring has no such bounds.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from punctuality.llm.texts import map_rows
from punctuality.llm.toxic_chain import sampled

TRAIN_ROWS, TRAIN_CHARS, EPOCHS, BATCH, RATE = 3000, 8000, 14, 16, 0.01
EMBED, FILTERS, TAPS, TILE = 6, 16, 5, 256
LAGS = range(2, 33)
#: Bytes that are convolved at once.
BLOCK = 256 * TILE


def repeats(b: np.ndarray) -> np.ndarray:
    """1 where the last eight bytes are also found at one of ``LAGS`` bytes before."""
    out = np.zeros(len(b), bool)
    if len(b) <= 8 + LAGS[0]:
        return out.astype(np.float32)
    w = b.astype(np.uint64)
    w = w[1:] | w[:-1] << np.uint64(8)
    w = w[2:] | w[:-2] << np.uint64(16)
    w = w[4:] | w[:-4] << np.uint64(32)  # w[i]: bytes i..i+7
    for lag in LAGS:
        if len(w) > lag:
            out[7 + lag :] |= w[lag:] == w[:-lag]
    return out.astype(np.float32)


@dataclass
class Net:
    embed: np.ndarray  # 256, EMBED
    taps: np.ndarray  # TAPS, EMBED, FILTERS
    again: np.ndarray  # TAPS, FILTERS
    bias: np.ndarray  # FILTERS
    out: np.ndarray  # 2 * FILTERS
    shift: np.ndarray  # 1

    def parts(self) -> list[np.ndarray]:
        return [self.embed, self.taps, self.again, self.bias, self.out, self.shift]

    def chunks(self, b: np.ndarray, places: bool = False):
        """Pooled responses of each chunk (two tiles, one shared with the next), and where."""
        tables = [(self.embed @ t).astype(np.float32) for t in self.taps]
        r = repeats(b)
        pad = TAPS - 1
        b, r = np.r_[np.zeros(pad, np.uint8), b], np.r_[np.zeros(pad, np.float32), r]
        n = len(b) - pad
        tops, where = [], []
        for at in range(0, n, BLOCK):
            m = min(BLOCK, n - at)
            z = np.take(tables[0], b[at : at + m], axis=0)
            for k in range(1, TAPS):
                z += np.take(tables[k], b[at + k : at + k + m], axis=0)
            if r[at : at + m + pad].any():
                for k in range(TAPS):
                    z += r[at + k : at + k + m, None] * self.again[k]
            if places:
                for t in range(0, m, TILE):
                    best = z[t : t + TILE].argmax(axis=0)
                    tops.append(z[t : t + TILE][best, np.arange(z.shape[1])])
                    where.append(best + at + t)
            else:
                tops.append(np.maximum.reduceat(z, np.arange(0, m, TILE), axis=0))
        top = np.stack(tops) if places else np.concatenate(tops)
        if not places:
            return np.maximum(top[:-1], top[1:]) if len(top) > 1 else top
        where = np.stack(where)
        if len(top) > 1:
            first = top[:-1] >= top[1:]
            where, top = np.where(first, where[:-1], where[1:]), np.maximum(top[:-1], top[1:])
        return top, where, b, r

    def probability(self, text: str | None) -> float:
        b = _bytes(text)
        pooled = np.maximum(self.chunks(b) + self.bias, 0)
        z = float(np.r_[pooled.max(axis=0), pooled.mean(axis=0)] @ self.out + self.shift[0])
        return float(1 / (1 + np.exp(-z)))


def _bytes(text: str | None) -> np.ndarray:
    """The bytes of a text; an empty one is a single zero byte."""
    return np.frombuffer((text or "\0").encode("utf-8", "replace"), np.uint8)


def new_net(seed: int = 8) -> Net:
    g = np.random.default_rng(seed)
    return Net(
        g.normal(0, 0.5, (256, EMBED)), g.normal(0, 0.4, (TAPS, EMBED, FILTERS)), g.normal(0, 0.3, (TAPS, FILTERS)),
        np.zeros(FILTERS), g.normal(0, 0.1, 2 * FILTERS), np.zeros(1),
    )


def gradient(net: Net, b: np.ndarray, label: float) -> list[np.ndarray]:
    """Gradient of the log loss of one text; a max-pool passes it to one place per filter."""
    top, where, padded, r = net.chunks(b, places=True)
    raw = top + net.bias
    pooled = np.maximum(raw, 0)
    most = pooled.argmax(axis=0)
    cols = np.arange(FILTERS)
    vector = np.r_[pooled[most, cols], pooled.mean(axis=0)]
    z = float(vector @ net.out + net.shift[0])
    g = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - label
    back = np.repeat((g * net.out[FILTERS:] / len(pooled))[None], len(pooled), axis=0)
    back[most, cols] += g * net.out[:FILTERS]
    back *= raw > 0
    d_embed, d_taps, d_again = np.zeros_like(net.embed), np.zeros_like(net.taps), np.zeros_like(net.again)
    for k in range(TAPS):
        here = padded[where + k]  # chunks, FILTERS
        vectors = net.embed[here]
        d_taps[k] = np.einsum("cf,cfe->ef", back, vectors)
        d_again[k] = (back * r[where + k]).sum(axis=0)
        np.add.at(d_embed, here, back[:, :, None] * net.taps[k].T[None])
    return [d_embed, d_taps, d_again, back.sum(axis=0), g * vector, np.array([g])]


def train(texts: list[str | None], labels: list[int], epochs: int = EPOCHS, seed: int = 8) -> Net:
    """Adam over shuffled batches. Without texts the net is untrained and says 0.5 or so."""
    net, g = new_net(seed), np.random.default_rng(seed)
    data = [_bytes(t) for t in texts]
    one, two, step = [np.zeros_like(p) for p in net.parts()], [np.zeros_like(p) for p in net.parts()], 0
    for epoch in range(epochs if data else 0):
        rate = RATE * (1 - epoch / epochs) + 1e-4
        order = g.permutation(len(data))
        for at in range(0, len(order), BATCH):
            batch = order[at : at + BATCH]
            sums = [np.zeros_like(p) for p in net.parts()]
            for i in batch:
                for total, d in zip(sums, gradient(net, data[i], labels[i]), strict=True):
                    total += d
            step += 1
            for p, d, m, v in zip(net.parts(), sums, one, two, strict=True):
                d /= len(batch)
                m += 0.1 * (d - m)
                v += 0.001 * (d * d - v)
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return net


def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 3 == 1


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, chars: int = TRAIN_CHARS) -> Net:
    """Net fitted on rows that are not held out."""
    some = sampled(labels.where(F.col("quality").isNotNull() & ~held_out()), rows, "quality")
    both = docs.select("doc_id", "text").where(F.coalesce(F.length("text"), F.lit(0)) <= chars).join(F.broadcast(some), "doc_id")
    found = both.select("doc_id", "text", "quality").collect()  # bounded by rows and chars
    found.sort(key=lambda r: (r["doc_id"], r["text"] or "", r["quality"]))
    return train([r["text"] for r in found], [int(r["quality"]) for r in found])


def score(docs: DataFrame, net: Net) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row, whole texts, empty and null ones too."""

    def start():
        return lambda doc_id, text, out: ((doc_id, out, p := net.probability(text), int(p >= 0.5)),)

    return map_rows(
        docs.select("doc_id", "text", held_out().alias("held_out")), start,
        "doc_id long, held_out boolean, score double, predicted int",
    )
