"""Row numbers, running totals and quantiles that never gather a group in one task."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeframe.sources.scratch import materialize, written_side

OFFSET_BROADCAST_VALUES = 500_000


def _by_range(df: DataFrame, group: list[str], order: list[Column | str], sums: dict[str, Column], own: Callable) -> DataFrame:
    """``df`` with, for each name of ``sums``, the value before its part (by range) plus ``own(window, name)`` within the part.

    The rows are dealt by range over ``group + order`` and written, so each part holds a contiguous stretch; the sums of the parts
    before are a table of a row for each part and group, and a window adds the rest within one part of one group.  A group of any
    size is spread over as many parts as its rows need.
    """
    part = materialize(df.repartitionByRange(*group, *order).withColumn("_part", F.spark_partition_id()), "by-range")
    each = part.groupBy(*group, "_part").agg(*(s.alias(f"_{n}") for n, s in sums.items()))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = each.select(*group, "_part", *(F.coalesce(F.sum(f"_{n}").over(before), F.lit(0)).alias(f"_off_{n}") for n in sums))
    offsets = written_side(offsets, "offsets", OFFSET_BROADCAST_VALUES)
    within = Window.partitionBy(*group, "_part").orderBy(*order)
    done = part.withColumns({f"_own_{n}": own(within, n) for n in sums})
    same = [done[g].eqNullSafe(offsets[g]) for g in [*group, "_part"]]
    return done.join(offsets, same).select(*(done[c] for c in df.columns), *((F.col(f"_own_{n}") + F.col(f"_off_{n}")).alias(n) for n in sums))


def distributed_rank(df: DataFrame, group: list[str], order: list[str], out: str = "rank") -> DataFrame:
    """Add ``out``: the row's position (from 0) among the rows of equal ``group`` columns, by the ``order`` columns."""
    ranked = _by_range(df, group, order, {out: F.count("*")}, lambda w, _: F.row_number().over(w) - 1)
    return ranked.withColumn(out, F.col(out).cast("long"))


def running_totals(df: DataFrame, group: list[str], order: list[Column | str], values: dict[str, str]) -> DataFrame:
    """Add for each ``out: value`` the sum of ``value`` over the rows before this one in its group; ``order`` must tell the rows apart."""
    before = lambda w, n: F.coalesce(F.sum(values[n]).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return _by_range(df, group, order, {n: F.sum(v) for n, v in values.items()}, before)


def exact_quantiles(df: DataFrame, value: str, shares: list[float], by: list[str] | None = None) -> DataFrame:
    """For each group the array ``quantiles`` of linearly interpolated quantiles; nulls don't count, a group of nulls has none.

    The two neighbours of each quantile are found by their ranks among counted distinct values, so no task buffers a group.
    """
    by = by or []
    each = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_n"))
    placed = running_totals(each, by, [value], {"_before": "_n"})
    total = placed.groupBy(*by).agg(F.sum("_n").alias("_total"))
    if by:
        placed = placed.join(total.hint("merge"), [placed[b].eqNullSafe(total[b]) for b in by]).select(placed["*"], "_total")
    else:
        placed = placed.crossJoin(F.broadcast(total))
    found = []
    for q in shares:
        at = (F.col("_total") - 1) * F.lit(q)
        holds = lambda rank: F.max(F.when((F.col("_before") <= rank) & (rank < F.col("_before") + F.col("_n")), F.col(value).cast("double")))
        found.append(F.struct(holds(F.floor(at)).alias("lo"), holds(F.ceil(at)).alias("hi"), F.max(at - F.floor(at)).alias("f")))
    return placed.groupBy(*by).agg(F.transform(F.array(*found), lambda s: s["lo"] + (s["hi"] - s["lo"]) * s["f"]).alias("quantiles"))
