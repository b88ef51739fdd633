"""Small helpers of the registry: comparable output types and composed SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def comparable(df: DataFrame, digits: int = 6) -> DataFrame:
    """Dates as text, flags as 0/1 and doubles rounded, so that engines compare by value."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind == "date":
            c = F.date_format(c, "yyyy-MM-dd")
        elif kind in ("timestamp", "timestamp_ntz"):
            c = F.date_format(c, "yyyy-MM-dd HH:mm")
        elif kind == "boolean":
            c = c.cast("int")
        elif kind in ("double", "float"):
            c = F.round(c, digits)
        out.append(c.alias(name))
    return df.select(out)


def with_ctes(body: str, *ctes: str) -> str:
    return "WITH " + ",".join(c.strip() for c in ctes) + "\n" + body.strip()
