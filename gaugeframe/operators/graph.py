"""Connected components over an edge table (operators C5, I1)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeframe.sources.scratch import drop_written, materialize_observed


def _digest() -> list[Column]:
    return [F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")]


def split_key(c: str) -> Column:
    """The id with its bits turned: equal for equal ids, but no partitioning that the planner knows.

    An aggregate that is joined on it gets an exchange of its own, so both sides
    of the join are plain shuffles and adaptive execution can split a hub.
    """
    return F.bitwise_not(F.col(c))


def _pointed(edges: DataFrame, lowest: DataFrame) -> DataFrame:
    """``edges`` (u, v) with the minimum ``m`` that ``lowest`` (u, m) has for u."""
    left = edges.select(split_key("u").alias("k"), "u", "v")
    return left.join(lowest.select(split_key("u").alias("k"), "m").hint("merge"), "k")


def _round(e: DataFrame) -> DataFrame:
    """One large-star and one small-star step."""
    both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    large = _pointed(both.where("v > u"), low).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
    least = large.groupBy("u").agg(F.min("v").alias("m"))
    turned = F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v"))
    return _pointed(large, least).select(turned.alias("u"), F.col("m").alias("v")).where("u != v").distinct()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """Smallest reachable id for every id that occurs in ``edges``: columns ``id``, ``component``.

    Alternates the published large-star and small-star steps: every round is one
    job of two groupings with map-side minima and two joins, which stream a hub's
    neighbours (three numbers a row) and whose hot keys can be split.  Each round
    is written to the shared folder in place of the one before; its digest is
    taken while it is written, and the loop ends when the edge set repeats.  Null
    ids and self links are ignored.
    """
    ends = edges.select(F.col(src).cast("long").alias("a"), F.col(dst).cast("long").alias("b")).where("a is not null and b is not null and a != b")
    e, seen = materialize_observed(ends.select(F.least("a", "b").alias("v"), F.greatest("a", "b").alias("u")).distinct(), "cc-edges", *_digest())
    if not seen["n"]:
        return e.select(F.col("u").alias("id"), F.col("v").alias("component"))
    for _ in range(max_rounds):
        new, now = materialize_observed(_round(e), "cc-round", *_digest())
        drop_written(e)
        e = new
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = e.select(F.col("v").alias("id")).distinct()
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots.select("id", F.col("id").alias("component")))
