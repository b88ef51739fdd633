"""Near-dedup, substring dedup and components: against brute force."""

import hashlib
import random

import numpy as np
import pytest

from punctuality.llm import chosen_paths, substrings
from punctuality.llm.components import components
from punctuality.llm.texts import WordHashes, words_of

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, starts string, group int"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 1, "x", 0) for i, t in rows], SCHEMA)


def prose(pick, n):
    return [f"w{pick.randrange(3000)}" for _ in range(n)]


def changed(pick, words, share):
    return [f"c{pick.randrange(10**6)}" if pick.random() < share else w for w in words]


@pytest.fixture(scope="module")
def corpus():
    pick = random.Random(3)
    rows, base = [], prose(pick, 120)
    rows += [(k, " ".join(changed(pick, base, pick.choice([0, 0.01, 0.03, 0.06, 0.09])))) for k in range(90)]
    for k in range(30):
        own = prose(pick, pick.randrange(5, 200))
        rows += [(100 + 10 * k + j, " ".join(changed(pick, own, 0.04 * j))) for j in range(4)]
    rows += [(1000, None), (1001, ""), (1002, " \n "), (1003, "one"), (1004, "ONE"), (1005, "one two"), (None, "one two")]
    rows += [rows[0], rows[1], (None, rows[5][1]), (2000, "x " * 20_000)]
    pick.shuffle(rows)
    return rows


def shingles(text, k):
    words = [w.lower() for w in words_of(text)]
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1)))


def brute(rows, k):
    sets = [shingles(t, k) for _, t in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] and 100 * common >= 80 * (len(sets[i]) + len(sets[j]) - common) and label[i] != label[j]:
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    least = {}
    for (i, _), x in zip(rows, label, strict=True):
        if i is not None:
            least[x] = min(i, least.get(x, i))
    return sorted((str(i), len(s), str(least.get(x))) for (i, _), s, x in zip(rows, sets, label, strict=True))


@pytest.mark.parametrize("k", [2, 5])
@pytest.mark.parametrize("bounds", [(64, 400), (4, 8)])
def test_near_duplicates(spark, corpus, k, bounds, monkeypatch):
    """Also with tiny leaves and groups, so that deep trees and the leaf-wise check run."""
    monkeypatch.setattr(chosen_paths, "LEAF", bounds[0])
    monkeypatch.setattr(chosen_paths, "GROUP", bounds[1])
    monkeypatch.setattr(chosen_paths, "DEPTH", 3 if bounds[0] == 4 else 5)
    got = chosen_paths.near_duplicates(table(spark, corpus), k=k).collect()
    wanted = brute(corpus, k)
    found = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got)
    wrong = sum(a != b for a, b in zip(found, wanted, strict=True))
    assert wrong <= (0 if bounds[0] == 64 else 0.02 * len(corpus))
    assert all(r.kept == (r.doc_id == r.component_id) for r in got if r.doc_id is not None)


def test_large_group_around_one_text(spark, monkeypatch):
    """Copies 0.85 to one text and 0.72 to each other; the group is above the bound."""
    monkeypatch.setattr(chosen_paths, "GROUP", 300)
    monkeypatch.setattr(chosen_paths, "BLOCK", 100)
    pick = random.Random(6)
    base = prose(pick, 200)
    rows = [(0, " ".join(base))]
    for k in range(1, 1201):
        words = list(base)
        for at in pick.sample(range(1, 198, 2), 8):
            words[at] = f"c{k}x{at}"
        rows.append((k, " ".join(words)))
    got = chosen_paths.near_duplicates(table(spark, rows), k=2).collect()
    assert len(got) == len(rows) and {r.component_id for r in got} == {0}


def test_one_of_each(spark, corpus):
    docs = table(spark, corpus)
    left = chosen_paths.one_of_each(docs)
    assert left.columns == docs.columns
    kept = left.collect()
    sets = [shingles(r.text, 5) for r in kept]
    for i in range(len(kept)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            assert not sets[i] or 100 * common < 80 * (len(sets[i]) + len(sets[j]) - common)
    assert sum(not s for s in sets) == 3
    groups = {x for i, _, x in brute(corpus, 5)}
    assert {str(r.doc_id) for r in kept if r.doc_id is not None} >= {g for g in groups if g != "None"}


def test_texts_of_one_short_hash_without_ids(spark):
    """Texts that share a 32-bit hash are different rows still."""
    from pyspark.sql import functions as F

    texts = spark.range(300_000).select(F.concat(F.lit("text "), F.col("id")).alias("text"))
    same = texts.groupBy(F.hash("text")).agg(F.collect_list("text").alias("texts")).where("size(texts) > 1").first().texts
    left = chosen_paths.one_of_each(table(spark, [(None, same[0]), (None, same[1]), (None, same[0])]), k=1)
    assert sorted(r.text for r in left.collect()) == sorted(same[:2])


def test_empty_tables(spark):
    none = table(spark, []).limit(0)
    assert chosen_paths.near_duplicates(none).count() == 0
    assert chosen_paths.one_of_each(none).count() == 0
    assert substrings.substring_digest(none).count() == 0
    assert substrings.cut_repeats(none).count() == 0


def test_exact_links_among_full_sets():
    hashes = WordHashes()
    a = chosen_paths.shingles("a b c d e f g h i j k", hashes, 1)
    b = chosen_paths.shingles("a b c d e f g h i j", hashes, 1)  # 10 of 11
    c = chosen_paths.shingles("a b c d e f g h", hashes, 1)  # 8 of 10 with b
    d = chosen_paths.shingles("a b c d e f g", hashes, 1)
    assert {tuple(sorted(x)) for x in chosen_paths.confirmed([a, b, c, d], 0.8)} == {(0, 1), (1, 2), (2, 3)}


def test_signatures_estimate_similarity():
    pick = np.random.default_rng(1)
    x = pick.integers(0, 2**63, 1000).astype(np.uint64)
    y = np.r_[x[:800], pick.integers(0, 2**63, 50).astype(np.uint64)]
    one, two = (np.frombuffer(chosen_paths.signature(np.sort(s)), "<u2") for s in (x, y))
    assert abs((one == two).mean() - 800 / 1050) < 0.2


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    pick = random.Random(seed)
    edges = [(pick.randrange(200), pick.randrange(200)) for _ in range(120)] + [(300 + i, 301 + i) for i in range(40)]
    edges += [(5, 5), edges[0], (400, 401)] + [(500, 501 + i) for i in range(60)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    label = {x: x for e in edges if e[0] != e[1] for x in e}
    for _ in range(300):
        for a, b in edges:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    assert got == label


def test_components_of_nothing(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_difference_cover():
    substrings.check_cover(substrings.PERIOD, substrings.COVER)
    with pytest.raises(ValueError):
        substrings.check_cover(21, (0, 1, 2))


def digest(rows, window):
    places = {}
    texts = [words_of(t) for _, t in rows]
    for d, words in enumerate(texts):
        for i in range(len(words) - window + 1):
            places.setdefault(tuple(words[i : i + window]), []).append((d, i))
    gone = [set() for _ in rows]
    for hits in places.values():
        if len(hits) > 1:
            for d, i in hits:
                gone[d].update(range(i, i + window))
    out = []
    for (doc_id, _), words, lost in zip(rows, texts, gone, strict=True):
        left = b" ".join(w for i, w in enumerate(words) if i not in lost)
        out.append((str(doc_id), len(words), len(lost), hashlib.sha256(left).hexdigest()))
    return sorted(out)


@pytest.fixture(scope="module")
def repeats():
    pick = random.Random(4)
    shared = prose(pick, 60)
    rows = [(k, " ".join(prose(pick, pick.randrange(90)) + (shared[: pick.randrange(30, 61)] if k % 3 else []) + prose(pick, pick.randrange(60)))) for k in range(60)]
    rows += [(100, None), (101, ""), (102, " ".join(shared[:34])), (103, " ".join(shared[:35])), (None, rows[2][1]), (None, rows[2][1])]
    rows += [rows[3], rows[3], (104, "same " * 36), (105, "same  \n" * 34), (3, "other text under an id that is taken " * 6)]
    return rows


def test_substrings(spark, repeats):
    got = substrings.substring_digest(table(spark, repeats)).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in got) == digest(repeats, 35)


def test_cut_repeats_keeps_columns(spark, repeats):
    docs = table(spark, repeats)
    cut = substrings.cut_repeats(docs)
    assert cut.columns == docs.columns
    left = sorted((str(r.doc_id), hashlib.sha256(b" ".join(words_of(r.text))).hexdigest()) for r in cut.collect())
    assert left == sorted((i, sha) for i, _, _, sha in digest(repeats, 35))


def test_a_node_that_does_not_split_keeps_all_its_pairs(spark, monkeypatch):
    """Six kinds of alike sets share single tokens, so they meet in large nodes with one pivot."""
    monkeypatch.setattr(chosen_paths, "LEAF", 4)
    monkeypatch.setattr(chosen_paths, "DEPTH", 1)
    monkeypatch.setattr(chosen_paths, "REST", 16)
    pick = random.Random(8)
    rows = []
    for kind in range(6):
        low = bytes(0 if pick.random() < 0.6 else kind + 1 for _ in range(chosen_paths.SIGNATURE))
        rows += [(20 * kind + i, 100, low + bytes(chosen_paths.SIGNATURE)) for i in range(20)]
    sets = spark.createDataFrame(rows, "set_id long, n long, signature binary")
    leaves, rest = chosen_paths._leaves(sets, 0.8, 1)
    links = chosen_paths._likely(leaves.union(rest), sets, 0.8 - chosen_paths.MARGIN, 0.8)
    root = {r.node: r.root for r in components(links).collect()}
    assert [root.get(i) for i in range(120)] == [20 * (i // 20) for i in range(120)]
    dealt = chosen_paths._likely(leaves, sets, 0.8 - chosen_paths.MARGIN, 0.8)
    assert components(dealt).select("root").distinct().count() > 6 or components(dealt).count() < 120  # leaves alone lose some
