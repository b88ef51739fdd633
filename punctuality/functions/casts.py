"""Casts that give null instead of an error, with the acceptance rules of the feed's typing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spark's own double cast takes Java suffixes ("1d"), and its date cast takes "2023": the
# patterns state what counts as a number and as a date instead.
_NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"
_NOT_FINITE = r"^\s*[+-]?(?i:nan|inf|infinity)\s*$"
_DATE = r"^\s*[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}([ T][0-9:.]+)?\s*$"


def to_double(text: Column) -> Column:
    return F.when(text.rlike(_NUMBER) | text.rlike(_NOT_FINITE), F.trim(text).try_cast("double"))


def to_int(text: Column) -> Column:
    """``-3.00`` is -3 and ``2.6`` is 3; whatever rounds beyond 32 bits is null."""
    exact = text.try_cast("int")
    rounded = F.round(F.when(text.rlike(_NUMBER), F.trim(text).try_cast("double")))
    return F.coalesce(exact, rounded.try_cast("int"))


def to_date(text: Column) -> Column:
    return F.when(text.rlike(_DATE), F.substring_index(F.trim(text), " ", 1).try_cast("date"))


def typed(text: Column, kind: str) -> Column:
    """Null-on-failure cast of a text column to a contract type."""
    if kind == "int":
        return to_int(text)
    if kind == "double":
        return to_double(text)
    if kind == "date":
        return to_date(text)
    if kind == "string":
        return text
    raise ValueError(f"not a contract type: {kind}")


def present(text: Column) -> Column:
    return text.isNotNull() & (text != "")
