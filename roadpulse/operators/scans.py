"""Running aggregates over a key's rows in two levels, so that one busy key uses all cores.

Rows are dealt by ranges of (key, order), as many as asked for, each about as large as the others, whatever
the keys; rows equal in both stay together. A first pass reduces each key's rows of one range to a summary. The summaries
of a key, no more than there are ranges, are scanned; what a range inherits from those before it joins
the running values of its own rows. Sums, extremes and all that can be said by them (the last row before this one, whether
something has changed, how often) are exact.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut


@dataclass(frozen=True)
class Running:
    """A running aggregate: how is sum, min or max; nulls of value are skipped, as an empty frame they give null.

    Rows count by their place in the order, with `peers` by its first column alone: then rows equal in it count as one place.
    `strict` leaves the own place out, `back` runs from the other end.
    """

    how: str
    value: Column
    strict: bool = False
    peers: bool = False
    back: bool = False

    def over(self, window: WindowSpec) -> Column:
        return getattr(F, self.how)(self.value).over(window)

    def joined(self, inherited: Column, own: Column) -> Column:
        if self.how == "sum":
            return F.coalesce(inherited + own, inherited, own)
        better = own > inherited if self.how == "max" else own < inherited  # for structs too
        return F.when(inherited.isNull() | better, own).otherwise(inherited)


def _frame(r: Running, window: WindowSpec) -> WindowSpec:
    between = window.rangeBetween if r.peers else window.rowsBetween
    return between(W.unboundedPreceding, -1 if r.strict else 0)


def _order(r: Running, keys: Sequence[str], order: Sequence[str]) -> WindowSpec:
    by = order[:1] if r.peers else order
    return W.partitionBy(*keys).orderBy(*[F.desc_nulls_last(c) if r.back else F.asc_nulls_first(c) for c in by])


def dealt(df: DataFrame, keys: Sequence[str], order: Sequence[str], ranges: int) -> DataFrame:
    """Rows with `_range`, the number of their range; ranges are cut by (keys, order) and kept, as samples decide them. Rows that are equal in all of these stand in one.

    Several ranges to a task even out what a shuffle by key and range gives to each.
    """
    return cut(df.repartitionByRange(ranges, *[F.asc_nulls_first(c) for c in (*keys, *order)]).withColumn("_range", F.spark_partition_id()))


def running(df: DataFrame, keys: Sequence[str], order: Sequence[str], wanted: dict[str, Running], ranges: int | None = None) -> DataFrame:
    """Adds the wanted running aggregates, in the order of the columns `order`. Without `ranges` a key is one task's; with them it is as many ranges' as it needs.

    `df` may come from `dealt` already: then its ranges hold.
    """
    if ranges is None and "_range" not in df.columns:
        return df.withColumns({n: r.over(_frame(r, _order(r, keys, order))) for n, r in wanted.items()})
    together = order[:1] if any(r.peers for r in wanted.values()) else order
    rows = df if "_range" in df.columns else dealt(df, keys, together, ranges)
    inner = [*keys, "_range"]
    sums = rows.groupBy(*inner).agg(*[getattr(F, r.how)(r.value).alias(f"_in_{n}") for n, r in wanted.items()])

    def before(n: str, r: Running) -> Column:
        w = W.partitionBy(*keys).orderBy(F.desc("_range") if r.back else F.asc("_range"))
        return getattr(F, r.how)(f"_in_{n}").over(w.rowsBetween(W.unboundedPreceding, -1))

    inherited = sums.select(*inner, *[before(n, r).alias(f"_in_{n}") for n, r in wanted.items()])
    same = reduce(lambda a, b: a & b, [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in inner])
    both = rows.alias("l").join(inherited.alias("r").hint("merge"), same).select("l.*", *[f"r._in_{n}" for n in wanted])
    out = both.withColumns({n: r.joined(F.col(f"_in_{n}"), r.over(_frame(r, _order(r, inner, order)))) for n, r in wanted.items()})
    return out.drop(*[f"_in_{n}" for n in wanted], *([] if "_range" in df.columns else ["_range"]))


def previous(order: Sequence[str], value: str) -> Running:
    """The struct (order.., value) of the row before; a null value counts as a value."""
    return Running("max", F.struct(*[F.col(c) for c in order], F.col(value).alias("value")), strict=True)


def following(order: Sequence[str], value: str) -> Running:
    """The struct (order.., value) of the row after."""
    return Running("min", F.struct(*[F.col(c) for c in order], F.col(value).alias("value")), strict=True, back=True)
