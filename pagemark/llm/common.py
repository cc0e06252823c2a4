"""Word rules and small helpers shared by the operators of this subpackage."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from pagemark.session import cut_lineage

# What separates words. The contracts' word classes are the complements; splitting
# at a class of ASCII characters is several times faster than matching the
# complement. A-Z are no separators: texts are lower-cased after the split.
WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
TOKEN = r"[\x20\x09-\x0D]+"

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def lower_az(col: Column) -> Column:
    """Lower-case A-Z only. ``lower`` does that for pure ASCII; other strings
    (whose other capitals must stay) take the per-character ``translate``."""
    return F.when(F.length(col) == F.octet_length(col), F.lower(col)).otherwise(
        F.translate(col, _UPPER, _UPPER.lower()))


def words(col: Column, separators: str) -> Column:
    """The pieces between separators; null text has none."""
    return F.array_remove(F.split(F.coalesce(col, F.lit("")), separators), "")


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def bind(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it many times inside ``body`` (a one-element
    ``transform``), so the optimizer cannot copy it into an inner lambda."""
    return F.transform(F.array(value), body)[0]


def narrow(df: DataFrame) -> DataFrame:
    """``df`` in four partitions a core at most: for results of narrow rows that a
    shuffle has left in many small partitions, so that they become few files."""
    return df.coalesce(4 * max(2, df.sparkSession.sparkContext.defaultParallelism))


def store(df: DataFrame) -> DataFrame:
    """A narrow table written to the shared checkpoint folder and read back."""
    return cut_lineage(narrow(df))


def fresh(taken: list[str], name: str) -> str:
    """``name``, with underscores before it until no column is called that."""
    lowered = {c.lower() for c in taken}
    while name.lower() in lowered:
        name = "_" + name
    return name
