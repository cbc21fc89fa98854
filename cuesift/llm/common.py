"""Helpers that the training-data operators share: column picking, names, lower case."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import drop_scratch, scratch, shared_dir, written

__all__ = ["ascii_lower", "drop_scratch", "numbered", "pick", "scratch", "shared_dir", "unclashed", "written"]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANKS = " \t\n\x0b\f\r"


def pick(df: DataFrame, names: list[str]) -> DataFrame:
    """Just the columns of exactly these names (the first of each).

    Other columns, also those whose names differ only by case, don't get in the way.
    """
    own = df.columns
    tidy = df.toDF(*[f"c{i}" for i in range(len(own))])
    return tidy.select(*[F.col(f"c{own.index(n)}").alias(n) for n in names])


def numbered(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """The same rows with columns in_0, in_1, ..., and the names that restore them by toDF."""
    own = df.columns
    return df.toDF(*[f"in_{i}" for i in range(len(own))]), own


def unclashed(own: list[str], added: list[str]) -> list[str]:
    """Names for input columns beside the columns an operator adds: a clashing input gets '_in' behind it."""
    taken, others = {x.lower() for x in added}, {x.lower() for x in own}
    out = []
    for name in own:
        if name.lower() in taken:
            name += "_in"
            while name.lower() in taken | others:
                name += "_in"
        out.append(name)
    return out


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else; pure ASCII takes the fast way."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
