"""Names for helper columns beside a caller's own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or ``name`` with as many underscores as it takes to differ from every column of ``df`` (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def own(df: DataFrame) -> list[Column]:
    """The columns of ``df``, whatever characters their names hold."""
    return [F.col(f"`{c.replace('`', '``')}`") for c in df.columns]
