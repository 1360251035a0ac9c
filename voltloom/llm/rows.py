"""Rows of any columns beside working columns, without clashes of names: the row travels as one struct."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def wrapped(df: DataFrame, **working: Column) -> DataFrame:
    """`row`, a struct of all columns, and the working columns."""
    return df.select(F.struct(*[F.col(quoted(c)) for c in df.columns]).alias("row"), *[c.alias(n) for n, c in working.items()])


def unwrapped(df: DataFrame, like: DataFrame, *more: Column, **changed: Column) -> DataFrame:
    """The columns of `like` from `row`, some of them changed, and more."""
    return df.select(*[changed.get(c, F.col("row").getField(c)).alias(c) for c in like.columns], *more)


def new_names(df: DataFrame, *names: str) -> None:
    """An error if the frame has columns of these names, in whatever case."""
    taken = sorted({n.lower() for n in names} & {c.lower() for c in df.columns})
    if taken:
        raise ValueError(f"the rows have columns {taken} already")
