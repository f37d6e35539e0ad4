"""Sharding by best-fit-decreasing bin packing of indivisible groups (operator 5).

Documents of equal text are one group and stay together.  A group's size is the
sum of its documents' sizes (UTF-8 bytes plus a fixed overhead).  Groups enter
in falling order of size, each the shard with the tightest remaining capacity
that still holds it; the shards' remaining capacities stand in a balanced tree.

Groups of one size class are interchangeable, so the driver packs a histogram
of size classes, not groups: sizes below 1024 are their own class, larger ones
keep ten leading bits, which bounds the histogram at some 25,000 rows for sizes
up to 2**60 whatever the number of documents.  A class enters a shard in a run
of as many groups as fit (a shard that took one group of a size is the tightest
for the next).  Groups then find their run by their rank within the class.

With a number of shards the capacity is an equal share of the bytes; a group
that no shard can hold (one group larger than a share) enters the emptiest, so
sizes differ by little unless one group alone exceeds a share.  With a capacity
new shards open as needed, which is how few of them result.

Defined cases: a null text counts as an empty one; ties are broken by group
hash, then doc_id; rows repeated in full are placed with their group and take
slots of their own; an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeframe.operators.ranking import distributed_rank
from gaugeframe.sources.scratch import materialize

#: Bytes that each document costs beside its text.
OVERHEAD = 8
CLASS_BITS = 10


class RemainingTree:
    """A treap of (remaining capacity, shard) in order of remaining capacity."""

    def __init__(self):
        self.root = None

    @staticmethod
    def _merge(a, b):
        if a is None or b is None:
            return a or b
        if a[1] > b[1]:
            return (a[0], a[1], a[2], RemainingTree._merge(a[3], b))
        return (b[0], b[1], RemainingTree._merge(a, b[2]), b[3])

    @staticmethod
    def _split(node, key):
        """Nodes below ``key``, and the others."""
        if node is None:
            return None, None
        if node[0] < key:
            a, b = RemainingTree._split(node[3], key)
            return (node[0], node[1], node[2], a), b
        a, b = RemainingTree._split(node[2], key)
        return a, (node[0], node[1], b, node[3])

    def add(self, remaining: float, shard: int) -> None:
        a, b = self._split(self.root, (remaining, shard))
        priority = hash((shard * 0x9E3779B1) & 0xFFFFFFFF) * 2654435761 % (1 << 32)
        self.root = self._merge(self._merge(a, ((remaining, shard), priority, None, None)), b)

    def take_tightest(self, size: float) -> tuple[float, int] | None:
        """Remove and return the shard of least remaining capacity that is at least ``size``."""
        a, b = self._split(self.root, (size, -1))
        if b is None:
            return None
        node = b
        while node[2] is not None:
            node = node[2]
        _, rest = self._split(b, (node[0][0], node[0][1] + 1))
        self.root = self._merge(a, rest)
        return node[0]

    def take_emptiest(self) -> tuple[float, int] | None:
        if self.root is None:
            return None
        node = self.root
        while node[3] is not None:
            node = node[3]
        self.root, _ = self._split(self.root, node[0])
        return node[0]


def pack_classes(classes: list[tuple[int, int, float]], *, shards: int | None = None, capacity: float | None = None) -> list[tuple[int, int, int, int]]:
    """Runs (class, first rank, end rank, shard) for size classes given as (class, groups, mean size)."""
    tree, opened, runs = RemainingTree(), 0, []
    if capacity is None:
        capacity = sum(n * w for _, n, w in classes) / max(shards, 1)
        while opened < shards:
            tree.add(capacity, opened)
            opened += 1
    for kind, count, size in sorted(classes, reverse=True):
        at = 0
        while at < count:
            found = tree.take_tightest(size)
            if found is None:
                if shards is None:
                    found = (max(capacity, size), opened)
                    opened += 1
                else:
                    found = tree.take_emptiest()
            remaining, shard = found
            n = min(count - at, max(1, math.floor(remaining / size)) if size > 0 else count - at)
            runs.append((kind, at, at + n, shard))
            tree.add(remaining - n * size, shard)
            at += n
    return runs


def _size_class(size: Column) -> Column:
    step = F.pow(F.lit(2.0), F.greatest(F.floor(F.log2(size)) - (CLASS_BITS - 1), F.lit(0)))
    return (F.floor(size / step) * step).cast("long")


def pack_shards(docs: DataFrame, *, shards: int | None = None, capacity: float | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard and slot (gapless from 0 in each shard) of every row."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(F.lit(1), text).alias("g1"),
        F.xxhash64(F.lit(2), text).alias("g2"),
    )
    rows = materialize(rows, "sized")
    groups = rows.groupBy("g1", "g2").agg(F.sum("size").alias("bytes")).withColumn("kind", _size_class(F.col("bytes")))
    groups = distributed_rank(groups, ["kind"], ["g1", "g2"])
    groups = materialize(groups, "groups")
    histogram = groups.groupBy("kind").agg(F.count("*").alias("n"), F.sum("bytes").alias("b")).collect()  # bounded by the size classes
    runs = pack_classes([(r["kind"], r["n"], r["b"] / r["n"]) for r in histogram], shards=shards, capacity=capacity)
    plan = spark.createDataFrame(runs, "kind long, first long, until long, shard int")  # a run for each class and shard it enters
    placed = groups.join(F.broadcast(plan), "kind").where("rank >= first and rank < until").select("g1", "g2", "shard")
    placed = materialize(placed, "placed-groups")
    out = rows.join(placed.hint("merge"), ["g1", "g2"]).select("doc_id", "size", "text_crc32", "shard")
    return distributed_rank(out, ["shard"], ["doc_id", "text_crc32"], "slot")
