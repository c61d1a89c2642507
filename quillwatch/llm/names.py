"""Names for inner columns that no column of the input has."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fresh(taken: Iterable[str], *names: str) -> list[str]:
    """names, each after as many underscores as it takes to be new; case doesn't tell names apart."""
    used, out = {c.lower() for c in taken}, []
    for name in names:
        while name.lower() in used:
            name = f"_{name}"
        used.add(name.lower())
        out.append(name)
    return out


def quoted(name: str) -> str:
    """name as a column's name as it stands: dots and backticks in it mean nothing."""
    return "`" + name.replace("`", "``") + "`"


def numbered(df: DataFrame) -> DataFrame:
    """df with its columns named c0, c1 and so on, so that no name of the input meets an inner one."""
    return df.toDF(*[f"c{k}" for k in range(len(df.columns))])


def renamed(out: DataFrame, names: list[str], *outputs: str) -> DataFrame:
    """The numbered columns of out under their old names, but for those that outputs replace, then outputs."""
    old = [F.col(f"c{k}").alias(n) for k, n in enumerate(names) if n.lower() not in {o.lower() for o in outputs}]
    return out.select(*old, *outputs)
