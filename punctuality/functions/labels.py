"""Display names for codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Carrier codes of the feed and their display names.
CARRIER_NAMES = {
    "9E": "Endeavor Air",
    "AA": "American Airlines",
    "AS": "Alaska Airlines",
    "B6": "JetBlue Airways",
    "DL": "Delta Air Lines",
    "F9": "Frontier Airlines",
    "G4": "Allegiant Air",
    "HA": "Hawaiian Airlines",
    "MQ": "Envoy Air",
    "NK": "Spirit Airlines",
    "OH": "PSA Airlines",
    "OO": "SkyWest Airlines",
    "UA": "United Airlines",
    "WN": "Southwest Airlines",
    "YX": "Republic Airways",
}


def carrier_names(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(CARRIER_NAMES.items()), "code string, name string")


def labelled(code: Column, name: Column) -> Column:
    """``AA (American Airlines)``; a code without a name stays as it is."""
    return F.coalesce(F.concat(code, F.lit(" ("), name, F.lit(")")), code)


def with_label(
    df: DataFrame, code: str, names: DataFrame, *, out: str = "label", is_small: bool = False
) -> DataFrame:
    """Add the display name of ``code``. ``names`` is (code, name) with upper-case codes.

    ``is_small`` is for a table whose size is fixed, such as the carriers; otherwise the
    optimizer chooses the join by the measured size.
    """
    look = names.select(F.col("code").alias("_code"), F.col("name").alias("_name"))
    look = F.broadcast(look) if is_small else look
    return (
        df.join(look, F.upper(code) == F.col("_code"), "left")
        .withColumn(out, labelled(F.col(code), F.col("_name")))
        .drop("_code", "_name")
    )
