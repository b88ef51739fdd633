"""Previous-row lookups and selections that stay balanced when one key holds most rows.

``Window.partitionBy(key)`` puts a whole key into one task. The helpers here find the few
keys that are too big, cut those into cells along the order, and carry the last row of each
cell into the next one, so that the answer is that of the plain window.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A key with more rows than this is cut into cells.
HOT_ROWS = 2_000_000
#: Only the biggest keys are cut. By counting, a key outside the first n has less than 1/n
#: of all rows; the bound also proves that the table of hot keys can be broadcast.
MAX_HOT_KEYS = 10_000
#: Rows aimed at per cell. Far below what a task can sort, so that a stretch in which the
#: key is a thousand times denser than on average still makes a moderate cell.
ROWS_PER_CELL = 1_000
#: Rows without a key have no previous row; they are only spread out.
_SPREAD = 65_536
_LAST_CELL = (1 << 62)


def nulls_last(order: Sequence[str]) -> list[Column]:
    return [F.asc_nulls_last(c) for c in order]


def order_struct(order: Sequence[str]) -> Column:
    """A value that compares as the ordering does, nulls last."""
    parts = []
    for i, c in enumerate(order):
        parts += [F.col(c).isNull().alias(f"n{i}"), F.col(c).alias(f"v{i}")]
    return F.struct(*parts)


def hot_keys(
    df: DataFrame, key: str, clock: str, *, hot_rows: int = HOT_ROWS, rows_per_cell: int = ROWS_PER_CELL
) -> DataFrame:
    """(key, first clock value, cell width) of the keys to cut, at most MAX_HOT_KEYS rows."""
    n, lo, hi = F.col("n"), F.col("lo"), F.col("hi")
    width = F.ceil((hi - lo + 1) * rows_per_cell / n)
    return (
        df.where(F.col(key).isNotNull())
        .groupBy(F.col(key).alias("_hot"))
        .agg(F.count(F.lit(1)).alias("n"), F.min(clock).alias("lo"), F.max(clock).alias("hi"))
        .where((n > hot_rows) & lo.isNotNull())
        .orderBy(n.desc(), "_hot")
        .limit(MAX_HOT_KEYS)
        .select("_hot", lo.alias("_lo"), F.greatest(width, F.lit(1)).alias("_width"))
    )


def lag_by_key(
    df: DataFrame,
    key: str,
    order: Sequence[str],
    values: Mapping[str, str],
    clock: str,
    *,
    hot_rows: int | None = HOT_ROWS,
    rows_per_cell: int = ROWS_PER_CELL,
) -> DataFrame:
    """Add the previous row's ``values`` (column -> new name) within ``key``.

    ``order`` must be total, nulls sort last. ``clock`` is a whole number that never falls
    along ``order`` (null only where the first order column is null). Rows with a null key
    get null. ``hot_rows=None`` leaves the search for hot keys out.

    One shuffle of the rows, on (key, cell); all other shuffles are of aggregates.
    """
    spread = F.pmod(F.xxhash64(*order), F.lit(_SPREAD))
    window = Window.partitionBy(key, "_cell").orderBy(*nulls_last(order))
    lags = {
        out: F.when(F.col(key).isNotNull(), F.lag(column).over(window))
        for column, out in values.items()
    }
    if hot_rows is None:
        cell = F.when(F.col(key).isNull(), spread).otherwise(F.lit(0).cast("bigint"))
        return df.withColumn("_cell", cell).withColumns(lags).drop("_cell")

    hot = hot_keys(df, key, clock, hot_rows=hot_rows, rows_per_cell=rows_per_cell)
    in_cell = F.floor((F.col(clock) - F.col("_lo")) / F.col("_width"))
    cell = (
        F.when(F.col(key).isNull(), spread)
        .when(F.col("_width").isNotNull(), F.coalesce(in_cell, F.lit(_LAST_CELL)))
        .otherwise(F.lit(0).cast("bigint"))
    )
    celled = df.join(F.broadcast(hot), F.col(key) == F.col("_hot"), "left").withColumn("_cell", cell)
    rows = celled.drop("_hot", "_lo", "_width").withColumn("_carried", F.lit(False))

    # The carried rows come from the hot keys only. The inner join is what lets the adaptive
    # planner drop this branch, scan included, when there is no hot key.
    hot_rows_only = df.join(F.broadcast(hot), F.col(key) == F.col("_hot")).withColumn(
        "_cell", F.coalesce(in_cell, F.lit(_LAST_CELL))
    )
    needed = list(dict.fromkeys([*order, *values]))
    next_cell = F.lead("_cell").over(Window.partitionBy(key).orderBy("_cell"))
    carried = (
        hot_rows_only.groupBy(key, "_cell")
        .agg(F.max_by(F.struct(*needed), order_struct(order)).alias("last"))
        .withColumn("_cell", next_cell)
        .where(F.col("_cell").isNotNull())
        .select(
            key,
            "_cell",
            *[F.col(f"last.{c}").alias(c) for c in needed if c != key],
            F.lit(True).alias("_carried"),
        )
    )
    return (
        rows.unionByName(carried, allowMissingColumns=True)
        .withColumns(lags)
        .where(~F.col("_carried"))
        .drop("_cell", "_carried")
    )


#: Cells of a hash: the high 20 bits, so a cell holds about a millionth of a stratum.
_HASH_CELL_SHIFT = 44


def hash_threshold(
    df: DataFrame, strata: Sequence[str], key: str, target: Column, seed: int
) -> DataFrame:
    """Per stratum, the (hash, key) up to which exactly ``target`` rows lie.

    ``target`` is an expression over ``total``, the rows of the stratum. ``key`` must be
    unique. The position is found in a histogram of hash cells, and only rows of the one
    cell that contains it are ranked; no stratum is ever gathered.
    """
    # Without a stratum there is one group, and one row is the whole result.
    strata = list(strata)
    hashed = df.select(*strata, F.col(key).alias("_key"), F.xxhash64(key, F.lit(seed)).alias("_hash"))
    celled = hashed.withColumn("_cell", F.shiftright("_hash", _HASH_CELL_SHIFT))
    cells = celled.groupBy(*strata, "_cell").agg(F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy(*strata) if strata else Window.partitionBy(F.lit(0))
    up_to = whole.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    cut = (
        cells.withColumns(
            {
                "before": F.coalesce(F.sum("n").over(up_to), F.lit(0)),
                "total": F.sum("n").over(whole),
            }
        )
        .withColumn("target", target)
        .where((F.col("before") < F.col("target")) & (F.col("target") <= F.col("before") + F.col("n")))
        .select(*strata, "_cell", (F.col("target") - F.col("before")).alias("_rank"))
    )
    rank = F.row_number().over(
        (Window.partitionBy(*strata) if strata else Window.partitionBy(F.lit(0))).orderBy("_hash", "_key")
    )
    return (
        celled.join(cut, [*strata, "_cell"])
        .withColumn("_at", rank)
        .where(F.col("_at") == F.col("_rank"))
        .select(*strata, F.struct("_hash", "_key").alias("_threshold"))
    )


def mark_exact_share(
    df: DataFrame, strata: Sequence[str], key: str, target: Column, seed: int, out: str = "held"
) -> DataFrame:
    """Add a flag that is true for exactly ``target`` rows of each stratum.

    The rows themselves are not shuffled: each is compared with its stratum's threshold.
    """
    threshold = hash_threshold(df, strata, key, target, seed)
    own = F.struct(F.xxhash64(key, F.lit(seed)).alias("_hash"), F.col(key).alias("_key"))
    if strata:
        joined = df.join(threshold, list(strata), "left")
        return joined.withColumn(out, F.coalesce(own <= F.col("_threshold"), F.lit(False))).drop("_threshold")
    only = threshold.select("_threshold").scalar()
    return df.withColumn(out, F.coalesce(own <= only, F.lit(False)))


def hash_rank(df: DataFrame, key: str, seed: int, out: str = "position") -> DataFrame:
    """Number rows 1..n in hash order without a global sort.

    Hashes are uniform, so the cells are even whatever the data; each cell is numbered on
    its own and shifted by the count of the cells before it.
    """
    hashed = df.withColumn("_hash", F.xxhash64(key, F.lit(seed)))
    n = df.sparkSession.conf.get("spark.sql.shuffle.partitions")
    celled = hashed.withColumn("_cell", F.floor((F.shiftright("_hash", 33) + (1 << 30)) * int(n) / (1 << 31)))
    before = F.sum("n").over(
        Window.partitionBy(F.lit(0)).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    )
    # One row per shuffle partition: bounded by the session's setting.
    offsets = (
        celled.groupBy("_cell")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("_cell", F.coalesce(before, F.lit(0)).alias("_offset"))
    )
    rank = F.row_number().over(Window.partitionBy("_cell").orderBy("_hash", key))
    return (
        celled.withColumn("_in_cell", rank)
        .join(F.broadcast(offsets), "_cell")
        .withColumn(out, F.col("_offset") + F.col("_in_cell"))
        .drop("_cell", "_hash", "_in_cell", "_offset")
    )
