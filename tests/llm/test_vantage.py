"""Operator 13 against brute force."""

import math
import random

import numpy as np
import pytest

from punctuality.llm import vantage as V

SCHEMA = "vec_id long, embedding array<float>, row long, dim int, part string"


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, v and [None if x is None else float(x) for x in v], 1, 2, "x") for i, v in rows], SCHEMA).repartition(parts)


def sound(v):
    return bool(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)


def brute(rows, every, k):
    """For each query row its list of (rank, id, score); lists of one id are sorted."""
    own = [(i, tuple(float(np.float32(x)) for x in v)) for i, v in rows if sound(v)]
    out = []
    for at, (q, vec) in enumerate(own):
        if q is None or q % every:
            continue
        met = [(-math.fsum(a * b for a, b in zip(vec, other, strict=True)), math.inf if i is None else i) for n, (i, other) in enumerate(own) if n != at and len(other) == len(vec)]
        out += [(q, rank, None if i == math.inf else i, -s) for rank, (s, i) in enumerate(sorted(met)[:k], 1)]
    return sorted(out, key=str)


def same(got, wanted):
    got = sorted(((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got), key=str)
    assert [x[:3] for x in got] == [x[:3] for x in wanted]
    assert np.allclose([x[3] for x in got], [x[3] for x in wanted], rtol=1e-12, atol=1e-12)


def small(seed, n=400, dim=5):
    """Integer components, so that ties are exact; unequal norms, copies, faults."""
    rng = random.Random(seed)
    rows = [(i, [rng.randrange(-4, 5) * (3 if i % 7 == 0 else 1) for _ in range(dim)]) for i in range(n)]
    rows += [(n + i, [1, 2, 0, -1, 1]) for i in range(150)]  # copies
    rows += [(40, [2, 2, 2, 2, 2]), (40, [2, 2, 2, 2, 2]), (None, [4, 4, 4, 4, 4]), (-20, [1, 0, 0, 0, 1])]
    rows += [(1000, None), (1020, []), (1040, [0, 0, 0, 0, 0]), (1060, [1, None, 1, 1, 1]), (1080, [1, math.nan, 1, 1, 1]), (1100, [math.inf, 1, 1, 1, 1])]
    rows += [(1120, [1, 2]), (1121, [1, 3]), (1140, [5, 5, 5])]  # other lengths
    return rows


@pytest.mark.parametrize("shard, block, leaf", [(64, 16, 4), (4096, 512, 2)])
def test_factor_one_is_exact(spark, shard, block, leaf):
    rows = small(3)
    own = V.usable(frame(spark, rows), "vec_id", "embedding")
    found = V.search(V.build_index(own, shard, leaf), own.where("pmod(vec_id, 20) = 0"), 20, 1.0, block)
    wanted = brute(rows, 20, 20)
    both = [r for r in found.collect() if r["query_id"] != 40]
    same(both, [w for w in wanted if w[0] != 40])
    assert found.where("query_id = 40").count() == sum(w[0] == 40 for w in wanted) == 60


def test_fewer_candidates_than_asked(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [-1.0, 0.0]), (20, [0.0, 1.0, 0.0])]
    same(V.nearest(frame(spark, rows), k=20).collect(), brute(rows, 20, 20))


def test_empty_table_and_no_query(spark):
    assert V.nearest(frame(spark, [])).collect() == []
    assert V.nearest(frame(spark, [(1, [1.0, 0.0]), (3, [1.0, 0.0])])).collect() == []


@pytest.mark.parametrize("size", ["0.001", "0.01", "0.1"])
def test_recall_on_given_tables(spark, size):
    table = spark.read.parquet(f"/root/testdata/sf{size}/embeddings.parquet")
    found = V.nearest(table).collect()
    whole = table.select("vec_id", "embedding").toPandas()
    ids, vectors = whole["vec_id"].to_numpy(), np.stack(whole["embedding"]).astype(float)
    hits = 0
    lists = {q: [r for r in found if r["query_id"] == q] for q in {r["query_id"] for r in found}}
    assert set(lists) == set(ids[ids % 20 == 0].tolist())
    for q, own in lists.items():
        at = int(np.flatnonzero(ids == q)[0])
        scores = vectors @ vectors[at]
        scores[at] = -np.inf
        hits += len({r["vec_id"] for r in own} & set(ids[np.lexsort((ids, -scores))[:20]].tolist()))
        place = {int(i): n for n, i in enumerate(ids)}
        assert np.allclose([r["score"] for r in own], [vectors[place[r["vec_id"]]] @ vectors[at] for r in own], atol=1e-12)
        assert [r["rank"] for r in sorted(own, key=lambda r: (-r["score"], r["vec_id"]))] == list(range(1, 21))
    assert hits >= 0.93 * 20 * len(lists)


def test_pruning_leaves_work_out():
    rng = np.random.default_rng(0)
    points = rng.normal(size=(2000, 3))
    points /= np.linalg.norm(points, axis=1)[:, None]
    tree = V.Tree(points, 32)
    seen = []
    compare = tree._compare
    tree._compare = lambda span, asked, *rest: (seen.append((span.stop - span.start) * len(asked)), compare(span, asked, *rest))
    best = tree.search(points[:100], np.arange(100), np.arange(2000), np.arange(2000), 5, 1.0)
    exact = points[:100] @ points.T
    exact[np.arange(100), np.arange(100)] = -np.inf
    assert (best.ids == np.argsort(-exact, axis=1)[:, :5]).all()
    assert sum(seen) < 0.6 * 100 * 2000
