"""Counts that say whether data can be trusted: casts, reconciliation, equal results."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from punctuality.functions.casts import present, typed


def cast_counts(types: Mapping[str, str]) -> list[Column]:
    """Aggregates for one scan: rows, and per column the present and the failed values."""
    out = [F.count(F.lit(1)).alias("row_count")]
    for name, kind in types.items():
        c = F.col(name)
        out.append(F.count_if(present(c)).alias(f"{name}__present"))
        failed = F.lit(False) if kind == "string" else present(c) & typed(c, kind).isNull()
        out.append(F.count_if(failed).alias(f"{name}__failed"))
    return out


def cast_report(counts: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """One row per column from the one row of :func:`cast_counts`."""
    lines = [
        F.struct(
            F.lit(name).alias("column"),
            F.lit(kind).alias("declared_type"),
            F.col(f"{name}__present").alias("present"),
            F.col(f"{name}__failed").alias("failed"),
        )
        for name, kind in types.items()
    ]
    rate = F.when(F.col("present") > 0, F.col("failed") / F.col("present")).otherwise(F.lit(0.0))
    return counts.select("row_count", F.inline(F.array(*lines))).withColumn("failure_rate", rate)


def cast_profile(raw: DataFrame, types: Mapping[str, str]) -> DataFrame:
    return cast_report(raw.agg(*cast_counts(types)), types)


def reconcile(read: DataFrame, written: DataFrame) -> DataFrame:
    """Rows read, rows written, and whether they agree."""
    n_written = written.agg(F.count(F.lit(1)).alias("n")).scalar()
    return read.agg(F.count(F.lit(1)).alias("rows_read")).select(
        "rows_read", n_written.alias("rows_written"), (F.col("rows_read") == n_written).alias("reconciled")
    )


_NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double")


def result_digest(result: DataFrame) -> DataFrame:
    """Row count and order-free sum of every numeric cell, to three decimals.

    A swap between columns does not show: :func:`result_diff` is the real comparison.
    """
    numbers = [c for c, kind in result.dtypes if kind in _NUMERIC or kind.startswith("decimal")]
    total = F.lit(0.0)
    for c in numbers:
        total = total + F.coalesce(F.sum(F.col(c).cast("double")), F.lit(0.0))
    return result.agg(F.count(F.lit(1)).alias("rows"), F.round(total, 3).alias("digest"))


def _cell_text(name: str, kind: str, digits: int) -> Column:
    """A cell as text that no other value of its column has; doubles count to ``digits`` decimals."""
    c = F.col(f"`{name}`")
    if kind in ("float", "double"):
        finite = F.round(c * F.lit(10.0**digits)).cast("decimal(38,0)").cast("string")
        text = F.when(F.isnan(c) | (F.abs(c) >= F.lit(10.0 ** (37 - digits))), c.cast("string")).otherwise(finite)
    elif kind.startswith(("array", "map", "struct")):
        text = F.to_json(F.struct(c))
    else:
        text = c.cast("string")
    return F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def multiset_digest(result: DataFrame, keys: Sequence[str] = (), digits: int = 6) -> DataFrame:
    """(keys, rows, digest) of the rows as a multiset, one row per keys.

    Each row becomes the MD5 of its cells in order of column names. The digest is the sum of the
    hash's first 60 bits and the exclusive or of the next 60, over all rows: it does not depend on
    order or partitioning, parts merge by the same two operations, and a swap of two columns, a
    cell that moved to another row or one copy more changes it. Everything is an integer, so no
    rounding of sums enters; only doubles are first rounded to ``digits``. Without rows the result
    has no row with keys, and ``0-0`` without. Keys are part of the rows.
    """
    kinds = dict(result.dtypes)
    cells = [F.concat(F.lit(f"{c}="), _cell_text(c, kinds[c], digits)) for c in sorted(kinds)]
    whole = F.md5(F.concat_ws("|", *cells).cast("binary"))
    part = lambda at: F.conv(F.substring(whole, at, 15), 16, 10)
    hashed = result.select(*keys, part(1).cast("decimal(28,0)").alias("_a"), part(16).cast("bigint").alias("_b"))
    total = F.coalesce(F.sum("_a").cast("string"), F.lit("0"))
    mixed = F.coalesce(F.bit_xor("_b"), F.lit(0)).cast("string")
    return hashed.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), F.concat_ws("-", total, mixed).alias("digest"))


def result_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows that one side has more often than the other, with the surplus of each side.

    Both sides are counted by value in one aggregate over their union, with partial sums
    before the shuffle, so neither copies nor order matter.
    """
    if sorted(left.columns) != sorted(right.columns):
        raise ValueError(f"different columns: {sorted(left.columns)} and {sorted(right.columns)}")
    balance = F.sum("_side")
    return (
        left.withColumn("_side", F.lit(1))
        .unionByName(right.withColumn("_side", F.lit(-1)))
        .groupBy(*left.columns)
        .agg(balance.alias("surplus"))
        .where("surplus <> 0")
    )


def close_diff(left: DataFrame, right: DataFrame, keys: Sequence[str], values: Sequence[str], tolerance: float) -> DataFrame:
    """Keys that are on one side only, or whose values differ by more than ``tolerance``."""
    off = F.lit(False)
    for v in values:
        a, b = F.col(f"l.{v}"), F.col(f"r.{v}")
        off = off | (a.isNull() != b.isNull()) | F.coalesce(F.abs(a - b) > tolerance, F.lit(False))
    left = left.select(*keys, *values, F.lit(True).alias("_in")).alias("l")
    right = right.select(*keys, *values, F.lit(True).alias("_in")).alias("r")
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]
    one_side = F.col("l._in").isNull() | F.col("r._in").isNull()
    return left.join(right, same, "full_outer").where(one_side | off).select(
        *[F.coalesce(f"l.{k}", f"r.{k}").alias(k) for k in keys]
    )
