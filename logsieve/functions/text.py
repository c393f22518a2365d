"""String helpers with the original tool's whitespace rules (all JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import GO_SPACE


def go_trim(c: Column) -> Column:
    """strings.TrimSpace: strip Unicode white space at both ends."""
    return F.regexp_replace(c, f"^{GO_SPACE}+|{GO_SPACE}+$", "")


def go_fields(c: Column) -> Column:
    """strings.Fields: words between runs of Unicode white space."""
    return F.filter(F.split(c, f"{GO_SPACE}+"), lambda w: w != "")


def cut(c: Column, n: int, suffix: str = "...") -> Column:
    """First ``n`` characters plus ``suffix`` when longer than ``n``."""
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit(suffix))).otherwise(c)


def extras_text(extras: Column) -> Column:
    """``k=v`` pairs joined by ', ', sorted by key."""
    return F.array_join(
        F.transform(
            F.array_sort(F.map_entries(extras)),
            lambda e: F.concat(e["key"], F.lit("="), e["value"]),
        ),
        ", ",
    )


def pinned(df: DataFrame, **cols: Column) -> DataFrame:
    """Add columns through a one-row Generate so the optimizer cannot inline
    them into later references (evaluates each expensive expression once per
    row, also when it is used inside a lambda, and keeps generated code small)."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in cols.items()]))))
