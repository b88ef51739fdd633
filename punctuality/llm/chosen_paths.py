"""Near-duplicate documents by a chosen-path set similarity join (operator 3).

Equal shingle sets are one node from the start, with a number of its own. Every set gets a
minwise signature. A
tree branches the sets recursively: at each level a tree node picks 1 / threshold signature
coordinates on average, and a set goes to one child for each of them, named by its minwise token
there. Two sets of similarity at or above the threshold share at least one child on average, at
every level. Nodes of at most ``LEAF`` sets end there
and their sets are compared exhaustively; larger ones branch again. Independent trees repeat
this to the target recall. Nodes that branching does not split (very many alike sets) are dealt
to leaves by hash, each leaf with the node's pivot, so that alike sets stay connected; the sets
that are not like the pivot meet all sets of the node, block by block, so no pair of a node is
left out. Small nodes of a level with the same sets are one leaf.

The leaves compare signatures and give, per leaf, a spanning forest of the likely links (no
more edges than sets, whatever the size of a group). Its components are small groups that hold
all true links. Groups of at most ``GROUP`` sets and ``GROUP_SHINGLES`` shingles come together once, with
their full sets, and every link is confirmed exactly. A larger group is confirmed leaf by leaf
first; then what its largest part does not hold meets all its sets of like size, block by block.

Recall: a pair just at 0.8 reaches level 4 of a tree with a chance of 0.57 (a branching process
with one or two picks), so eight independent trees miss it with a chance near 0.001; a group is
missed only if all paths through common partners are. Every reported link is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from punctuality.llm.components import components
from punctuality.llm.texts import KEY, WordHashes, keyed, map_groups, map_rows, mixed, row_key, shared, sieve, sifted, small_batches, without

#: Minwise tokens of a signature, and how far an estimate may lie below the threshold
#: (about four standard deviations).
SIGNATURE, MARGIN = 64, 0.19
TREES, DEPTH, LEAF = 8, 5, 64
#: Sets of each side of a block of a node that branching does not split.
REST = 256
#: Sets, and shingles in all, of a group that is confirmed as a whole in one task.
GROUP, GROUP_SHINGLES = 3000, 1_500_000
#: The same of a block of a larger group.
BLOCK, BLOCK_SHINGLES = 500, 250_000
_RNG = np.random.default_rng(20)
_MULTIPLY = _RNG.integers(1, 2**32, SIGNATURE, dtype=np.uint32) | np.uint32(1)
_ADD = _RNG.integers(1, 2**32, SIGNATURE, dtype=np.uint32)
_WHICH = np.arange(SIGNATURE, dtype=np.uint64) << np.uint64(32)


def shingles(text: str | None, hashes: WordHashes, k: int) -> np.ndarray:
    """Distinct hashes of runs of ``k`` words, sorted; of the whole sequence if it is shorter."""
    words = hashes.of(text, lower=True)
    if not len(words):
        return np.empty(0, np.uint64)
    return np.unique(hashes.windows(words, min(k, len(words))) + np.uint64(min(k, len(words))))


def signature(found: np.ndarray) -> bytes:
    """Minwise tokens of a set, 16 bits each."""
    least = np.full(SIGNATURE, np.iinfo(np.uint32).max, np.uint32)
    short = (found >> np.uint64(32)).astype(np.uint32)  # hashes are mixed, so any half will do
    for at in range(0, len(short), 256):
        part = short[at : at + 256, None] * _MULTIPLY
        part += _ADD
        np.minimum(least, part.min(axis=0), out=least)
    return (mixed(least.astype(np.uint64) + _WHICH) >> np.uint64(48)).astype("<u2").tobytes()


def set_key(found: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(found.tobytes())


def _sets(docs: DataFrame, k: int) -> DataFrame:
    """Set key, size and signature of every row; the tokens' low bytes come first, then the high ones."""

    def start():
        hashes = WordHashes()

        def each(doc_id, text, a, b):
            found = shingles(text, hashes, k)
            filled = len(found) > 0
            sig = signature(found) if filled else b""
            yield doc_id, a, b, set_key(found) if filled else None, len(found), sig[::2] + sig[1::2]

        return each

    return map_rows(
        docs.select("doc_id", "text", row_key().alias("key")).select("doc_id", "text", "key.a", "key.b"),
        start, "doc_id long, a long, b long, set_key binary, n long, signature binary",
    )


def _forest(n: int, pairs: Iterator[tuple[int, int]]) -> list[tuple[int, int]]:
    """The pairs that join separate parts, in their order."""
    up = list(range(n))

    def top(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    kept = []
    for i, j in pairs:
        x, y = top(i), top(j)
        if x != y:
            up[x] = y
            kept.append((i, j))
    return kept


def _branches(rows: DataFrame, level: int, threshold: float, trees: int) -> DataFrame:
    """Children (node, set_id) of each row's node; at level 0, of the roots of the trees."""

    def start():
        picks: dict[int, np.ndarray] = {}

        def picked(node: int) -> np.ndarray:
            rng = np.random.default_rng([node & (2**63 - 1), level])
            many = int(1 / threshold) + int(rng.random() < 1 / threshold % 1)
            return rng.choice(SIGNATURE, many, replace=False)

        def each(node, key, sig):
            values = np.frombuffer(sig, np.uint8).reshape(2, SIGNATURE).astype(int)
            values = values[0] + 256 * values[1]
            for at in range(trees) if node is None else (node,):
                if at not in picks:
                    if len(picks) > 20_000:
                        picks.clear()
                    picks[at] = picked(at)
                for c in picks[at].tolist():
                    yield xxhash.xxh3_64_intdigest(b"%d %d %d %d" % (level, at, c, values[c])) - (1 << 63), key

        return each

    return map_rows(rows.select("node", "set_id", "signature"), start, "node long, set_id long")


def _leaves(sets: DataFrame, threshold: float, trees: int) -> tuple[DataFrame, DataFrame | None]:
    """(leaf, set_id): the sets of every leaf of all trees, and those of the blocks of large nodes.

    Sizes are counted before rows move; only rows of nodes that hold two sets or more go on, and
    of small nodes that hold the same sets, by two 64-bit digests, one.
    """
    found = None
    rows = sets.select(F.lit(None).cast("long").alias("node"), "set_id", "signature")
    digests = [F.bit_xor(F.xxhash64("set_id", F.lit(seed))).alias(f"digest{seed}") for seed in (1, 2)]
    for level in range(DEPTH):
        children = shared(_branches(rows, level, threshold, trees))
        sizes = children.groupBy("node").agg(F.count(F.lit(1)).alias("size"), *digests).where("size > 1")
        own = F.when(F.col("size") > LEAF, F.col("node")).alias("own")
        nodes = sizes.groupBy("size", "digest1", "digest2", own).agg(F.min("node").alias("node")).select("node", "size")
        sized = shared(children.join(nodes, "node"))
        leaves = sized.where(F.col("size") <= LEAF).select(F.col("node").alias("leaf"), "set_id")
        found = leaves if found is None else found.union(leaves)
        large = sized.where(F.col("size") > LEAF)
        if large.isEmpty():
            return found, None
        rows = large.join(sets.select("set_id", "signature"), "set_id")
    # Alike sets: leaves by hash, each with the node's pivot.
    width = LEAF // 2
    chunks = F.ceil(F.col("size") / width)
    chunk = F.pmod(F.xxhash64("node", "set_id"), chunks)
    dealt = large.select(F.xxhash64("node", chunk).alias("leaf"), "set_id")
    pivots = large.groupBy("node").agg(F.min("set_id").alias("set_id"), F.max("size").alias("size"))
    each = F.explode(F.sequence(F.lit(0).cast("long"), chunks - 1)).alias("chunk")
    pivots = pivots.select("node", "set_id", each).select(F.xxhash64("node", "chunk").alias("leaf"), "set_id")
    return found.union(dealt.union(pivots)), _rest(large, sets, threshold)


def _rest(large: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(leaf, set_id): blocks in which all pairs of a large node lie that its pivot does not join.

    Sets that are like the pivot are linked over it. The others, dealt to ``REST`` at a time, meet
    all sets of the node, as many at a time: work grows with them, not with the square of the node.
    """
    short = sets.select("set_id", F.col("n").cast("int"), F.substring("signature", 1, SIGNATURE).alias("short"))
    pivots = large.groupBy("node").agg(F.min("set_id").alias("set_id")).join(short, "set_id")
    pivots = pivots.select("node", F.col("n").alias("pivot_n"), F.col("short").alias("pivot"))
    least = threshold - MARGIN

    def start():
        def each(node, key, size, n, sig, pivot_n, pivot):
            alike = np.frombuffer(sig, np.uint8) == np.frombuffer(pivot, np.uint8)
            if alike.mean() < least or min(n, pivot_n) < threshold * max(n, pivot_n):
                yield node, key, size

        return each

    rows = large.join(short, "set_id").join(pivots, "node").select("node", "set_id", "size", "n", "short", "pivot_n", "pivot")
    apart = shared(map_rows(rows, start, "node long, set_id long, size long"))
    blocks = lambda many: F.ceil(F.col(many) / REST)
    cell = lambda many: F.pmod(F.xxhash64("node", "set_id"), blocks(many))
    every = lambda many: F.explode(F.sequence(F.lit(0).cast("long"), blocks(many) - 1))
    few = apart.groupBy("node").agg(F.count(F.lit(1)).alias("few"))
    left = apart.join(few, "node").select("node", "set_id", "size", cell("few").alias("x")).select("node", "set_id", "x", every("size").alias("y"))
    right = large.join(few, "node").select("node", "set_id", "few", cell("size").alias("y")).select("node", "set_id", every("few").alias("x"), "y")
    name = F.xxhash64(F.lit("rest"), "node", "x", "y").alias("leaf")
    return left.select(name, "set_id").union(right.select(name, "set_id")).distinct()


def alike_pairs(leaf: np.ndarray, sizes: np.ndarray, sigs: np.ndarray, least: float, ratio: float) -> list[tuple[int, int]]:
    """Spanning forest of the likely links in each leaf, strongest first; rows lie leaf by leaf."""
    firsts, seconds, shares = [], [], []
    for gap in range(1, len(leaf)):
        i = np.flatnonzero(leaf[gap:] == leaf[:-gap])
        if not len(i):
            break
        low, high = np.minimum(sizes[i], sizes[i + gap]), np.maximum(sizes[i], sizes[i + gap])
        i = i[low >= ratio * high]
        share = (sigs[i] == sigs[i + gap]).mean(axis=1)
        near = share >= least
        firsts.append(i[near])
        seconds.append(i[near] + gap)
        shares.append(share[near])
    if not firsts:
        return []
    order = np.argsort(-np.concatenate(shares), kind="stable")
    i, j = np.concatenate(firsts)[order], np.concatenate(seconds)[order]
    return _forest(len(leaf), zip(i.tolist(), j.tolist(), strict=True))


_PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _pairs(keys: pa.Array, links: list[tuple[int, int]]) -> pa.RecordBatch:
    sides = [keys.take(pa.array([pair[k] for pair in links], pa.int64())) for k in (0, 1)]
    return pa.RecordBatch.from_arrays(sides, schema=_PAIRS)


def _likely(leaves: DataFrame, sets: DataFrame, least: float, ratio: float) -> DataFrame:
    """Spanning forest (a, b) of likely links in each leaf. One byte of each token goes there."""

    def made(rows: pa.Table) -> pa.RecordBatch:
        keys = rows["set_id"].combine_chunks()
        sigs = np.frombuffer(b"".join(rows["short"].to_pylist()), np.uint8).reshape(len(keys), SIGNATURE)
        return _pairs(keys, alike_pairs(rows["leaf"].to_numpy(), rows["n"].to_numpy(), sigs, least, ratio))

    short = F.substring("signature", 1, SIGNATURE).alias("short")
    rows = leaves.join(sets.select("set_id", F.col("n").cast("int"), short), "set_id").select("leaf", "set_id", "n", "short")
    return map_groups(rows, "leaf", made, "a long, b long")


def confirmed(sets: list[np.ndarray], threshold: float, parts: list | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links among full sets: similarity at or above the threshold.

    Sets of equal ``parts`` are known to be joined.
    """
    n, sizes = len(sets), np.array([len(s) for s in sets])
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.r_[0, np.cumsum(sizes)[:-1]]
    here = np.zeros(int(ids.max()) + 1, bool)
    label = np.arange(n) if parts is None else np.unique(parts, return_inverse=True)[1]
    kept = []
    for i in range(n - 1):
        if (label[i + 1 :] == label[i]).all():
            continue
        own = ids[starts[i] : starts[i] + sizes[i]]
        here[own] = True
        common = np.add.reduceat(here[ids[starts[i + 1] :]], starts[i + 1 :] - starts[i + 1], dtype=np.int64)
        here[own] = False
        union = sizes[i] + sizes[i + 1 :] - common
        for j in np.flatnonzero(100 * common >= round(100 * threshold) * union) + i + 1:
            if label[j] != label[i]:
                label[label == label[j]] = label[i]
                kept.append((i, int(j)))
    return kept


def _full(texts: DataFrame, k: int) -> DataFrame:
    """``texts`` with the full sets of shingles in place of the texts."""
    others = [c for c in texts.columns if c != "text"]

    def start():
        hashes = WordHashes()

        def each(text, *values):
            yield *values, shingles(text, hashes, k).tobytes()

        return each

    kept = ", ".join(f"{name} {kind}" for name, kind in texts.select(*others).dtypes)
    return map_rows(texts.select("text", *others), start, f"{kept}, shingles binary")


def _confirmed(full: DataFrame, threshold: float) -> DataFrame:
    """Exact links (a, b) within groups (group, set_id, shingles) of bounded size.

    Where rows have a ``part``, sets of one part are known to be joined; null is the part that
    most of them are in.
    """
    most = -1  # numbers of sets are not negative

    def made(rows: pa.Table) -> pa.RecordBatch:
        keys, groups = rows["set_id"].combine_chunks(), rows["group"].to_pylist()
        told, links, first = keys.to_pylist(), [], 0
        for end in range(1, len(groups) + 1):
            if end < len(groups) and groups[end] == groups[first]:
                continue
            at = list({told[i]: i for i in range(first, end)}.values())
            if len(at) > 1:
                parts = None
                if "part" in rows.column_names:
                    parts = {i: rows["part"][i].as_py() for i in at}
                    parts = {i: most if part is None else part for i, part in parts.items()}
                    at.sort(key=lambda i: parts[i] == most)  # the main part last: it is not compared with itself
                    parts = [parts[i] for i in at]
                sets = [np.frombuffer(rows["shingles"][i].as_buffer(), np.uint64) for i in at]
                links += [(at[x], at[y]) for x, y in confirmed(sets, threshold, parts)]
            first = end
        return _pairs(keys, links)

    return map_groups(full, "group", made, "a long, b long")


def _blocks(members: DataFrame, links: DataFrame, threshold: float) -> DataFrame:
    """(group, set_id, part): blocks in which all links that join separate parts of groups lie.

    ``members`` are (set_id, n, group), ``links`` the known ones. Sets outside a group's largest
    part meet all its sets whose size allows a link: those of the same band of sizes and the two
    beside it. Blocks are dealt by hash; two of one name would only be compared together.
    """
    root = components(links).select(F.col("node").alias("set_id"), "root")
    known = members.join(root, "set_id", "left").withColumn("root", F.coalesce("root", "set_id"))
    sizes = known.groupBy("group", "root").agg(F.count(F.lit(1)).alias("many"))
    main = sizes.groupBy("group").agg(F.max(F.struct("many", "root"))["root"].alias("main"))
    band = F.floor(F.log("n") / float(np.log(1 / threshold) * 1.0001)).cast("int")
    part = F.when(F.col("root") != F.col("main"), F.col("root"))
    rows = shared(known.join(main, "group").select("set_id", "n", F.col("group").alias("of"), band.alias("band"), part.alias("part")))

    def dealt(sets: DataFrame, side: str) -> tuple[DataFrame, DataFrame]:
        many = F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("n") / BLOCK_SHINGLES)).cast("int")
        cells = shared(sets.groupBy("of", "band").agg(many.alias("blocks")))
        block = F.pmod(F.xxhash64("set_id"), F.col("blocks")).cast("int").alias(side)
        placed = sets.join(cells, ["of", "band"]).select("set_id", "part", "of", F.col("band").alias(f"{side}_band"), block)
        each = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias(side)
        return placed, cells.select("of", F.col("band").alias(f"{side}_band"), each)

    (apart, first), (whole, second) = dealt(rows.where("part is not null"), "x"), dealt(rows, "y")
    pairs = first.join(second, "of").where("abs(x_band - y_band) <= 1")
    pairs = shared(pairs.withColumn("group", F.xxhash64("of", "x_band", "x", "y_band", "y")))
    left = apart.join(pairs, ["of", "x_band", "x"]).select("group", "set_id", "part")
    right = whole.join(pairs, ["of", "y_band", "y"]).select("group", "set_id", "part")
    return left.union(right)


def near_duplicates(docs: DataFrame, k: int = 5, threshold: float = 0.8, trees: int = TREES) -> DataFrame:
    """(doc_id, a, b, n_shingles, component_id, kept, group) for every row; (a, b) is its key.

    ``component_id`` is the smallest doc_id reachable over links. Rows without words have an
    empty set, no link, and their own id. Rows with equal sets, repeated rows included, are
    linked. A null id never is the smallest; a row without an id is kept only if nothing it is
    linked with has one. Extra columns are ignored; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    rows = shared(_sets(docs, k))
    filled = rows.where("set_key is not null")
    nodes = filled.groupBy("set_key").agg(
        F.min("doc_id").alias("doc_id"), F.max("n").alias("n"), F.first("signature").alias("signature"),
        F.min(F.struct("a", "b")).alias("key"),
    )
    nodes = shared(nodes.withColumn("set_id", F.monotonically_increasing_id()))  # written, so a set keeps its number
    leaves, rest = _leaves(nodes, threshold, trees)
    leaves = shared(leaves)
    likely = _likely(leaves if rest is None else leaves.union(rest), nodes, threshold - MARGIN, threshold)
    groups = components(likely)
    members = groups.select(F.col("node").alias("set_id"), F.col("root").alias("group")).join(nodes.select("set_id", "n", "key"), "set_id")
    sizes = members.groupBy("group").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("shingles"))
    whole = (F.col("size") <= GROUP) & (F.col("shingles") <= GROUP_SHINGLES)
    sized = shared(members.join(sizes, "group").select("set_id", "n", "group", whole.alias("whole"), "key.*"))
    # The text of one row for each set that has a likely link.
    one = sized.select("a", "b", "set_id", "group", "whole")
    texts = docs.select("text", row_key().alias("key")).select("text", "key.*")
    texts = sifted(texts, sieve(one, "a", "b"), "a", "b").dropDuplicates(["a", "b"])
    full = shared(_full(texts.join(one, ["a", "b"]).select("text", "set_id", "group", "whole"), k))
    links = _confirmed(full.where("whole").select("group", "set_id", "shingles"), threshold)
    big = sized.where("not whole").select("set_id", "n", "group")
    if not big.isEmpty():
        apart = full.where("not whole").select("set_id", "shingles")
        own = leaves.join(big.select("set_id"), "set_id", "left_semi").select("set_id", F.col("leaf").alias("group")).distinct()
        near = shared(_confirmed(own.join(apart, "set_id"), threshold))
        blocks = _blocks(big, near, threshold)
        links = links.union(near).union(_confirmed(blocks.join(apart, "set_id"), threshold))
    joined = components(links).select(F.col("node").alias("set_id"), "root")
    labelled = nodes.select("set_id", "set_key", "doc_id").join(joined, "set_id", "left").withColumn("root", F.coalesce("root", "set_id"))
    least = labelled.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = labelled.join(least, "root").select("set_key", "root", "component_id")
    out = rows.join(named, "set_key", "left")
    component = F.when(F.col("set_key").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select(
        "doc_id", "a", "b", F.col("n").alias("n_shingles"), component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, component.isNull()).alias("kept"), F.col("root").alias("group"),
    )


def one_of_each(docs: DataFrame, k: int = 5, threshold: float = 0.8) -> DataFrame:
    """Rows of ``docs``, all columns as they are, with one row of each near-duplicate group.

    The row with the smallest id stays (an id before none, then the smaller key). Rows without
    words are in no group and stay.
    """
    found = shared(near_duplicates(docs, k, threshold))
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "a", "b")
    first = found.where("group is not null").groupBy("group").agg(F.min(rank).alias("first"))
    others = found.join(first, "group").where((F.col("a") != F.col("first.a")) | (F.col("b") != F.col("first.b")))
    # Rows alike in id and text share a key.
    twice = shared(found.where("group is not null").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("a", "b"))
    alone = without(docs, others.select("a", "b").union(twice))
    kept_twice = twice.join(others.select("a", "b").distinct(), ["a", "b"], "left_anti")
    rows = sifted(keyed(docs), sieve(kept_twice, "a", "b"), *KEY).join(kept_twice.toDF(*KEY), [*KEY])
    return alone.unionByName(rows.dropDuplicates([*KEY]).select(*docs.columns))
