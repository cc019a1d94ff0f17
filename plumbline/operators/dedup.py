"""Order-aware deduplication and upserts, as partial aggregates: no window has to hold a hot key's rows.

`ord` decides: the row with the smallest ord is the first. Null key parts are keys of their own.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_wins(df: DataFrame, key: Sequence[str], order: Sequence[Column | str] = ("ord",)) -> DataFrame:
    """For each key the row that comes first in `order`; the row moves as one struct."""
    rest = [c for c in df.columns if c not in key]
    best = F.min_by(F.struct(*rest), F.struct(*(F.col(o).alias(f"k{i}") if isinstance(o, str) else o.alias(f"k{i}") for i, o in enumerate(order))))
    return df.groupBy(*key).agg(best.alias("_row")).select(*key, "_row.*").select(*df.columns)


def trusted_first(df: DataFrame, key: Sequence[str], trusted: Column, ord_: str = "ord") -> DataFrame:
    """As first_wins, but a trusted row goes before one that isn't."""
    return first_wins(df, key, [F.when(trusted, 0).otherwise(1), ord_])


@dataclass(frozen=True)
class Policy:
    """What an upsert keeps of a column: the aggregate over a key's rows in their order."""

    kind: str
    where: Column | None = None
    value: object = None

    def of(self, column: str, ord_: str) -> Column:
        x, o = F.col(column), F.col(ord_)
        if self.kind == "first":
            return F.min_by(x, o)
        if self.kind == "fill":  # the first that satisfies, else the last there is
            return F.coalesce(F.min_by(F.when(self.where, x), F.when(self.where, o)), F.max_by(x, o))
        if self.kind == "latest":  # the last that satisfies, else the first there is
            return F.coalesce(F.max_by(F.when(self.where, x), F.when(self.where, o)), F.min_by(x, o))
        if self.kind == "sticky":  # one value wins as soon as it occurs, else the first
            return F.when(F.max(F.coalesce(x == F.lit(self.value), F.lit(False))), F.lit(self.value)).otherwise(F.min_by(x, o))
        if self.kind == "all":  # true only if it is in every row
            return F.min(x)
        raise ValueError(self.kind)


FIRST = Policy("first")


def fill(where: Column) -> Policy:
    return Policy("fill", where)


def latest(where: Column) -> Policy:
    return Policy("latest", where)


def sticky(value: object) -> Policy:
    return Policy("sticky", value=value)


def upsert(df: DataFrame, key: Sequence[str], spec: dict[str, Policy], ord_: str = "ord") -> DataFrame:
    """Merge rows into one for each key, column by column; columns without a policy keep the first row's value."""
    rest = [c for c in df.columns if c not in key and c != ord_]
    return df.groupBy(*key).agg(*(spec.get(c, FIRST).of(c, ord_).alias(c) for c in rest), F.min(ord_).alias(ord_)).select(*df.columns)


def filled(column: str, empty: object) -> Column:
    """A column has a value that isn't the one that stands for none."""
    return F.col(column).isNotNull() & (F.col(column) != F.lit(empty))
