r"""Prefix trie of conversations with aggregates of every node (operator 11).

A conversation is the sequence of its turns (role, text).  Each distinct sequence
of first d turns is a node of depth d; the textless root has depth 0.  A turn is
carried as the MD5 of its role and text and its number of words, so texts are
read once and never shuffled.

Conversations are range-sharded and sorted by their paths (the digests of their
turns, end to end), so the members of a node are neighbours, over several shards
if need be.  A task cuts its shard into blocks of at most ``CELLS`` matrix cells.
In a block the turns get dense ids from 1, a padded matrix holds a row for each
conversation and 0 where it has ended, and ``numpy.lexsort`` orders the rows.
Where a column changes from one row to the next a node starts; OR-accumulated
over the columns, that mask marks the node starts of every depth, and ``reduceat``
over them gives members, smallest member and, from the deepest column up,
children, leaves and savings.

Only nodes on the path of a block's first or last row can go on in another block.
These boundary nodes are written apart, are added up by the hash of their
path, and one pass from the deepest up gives their subtrees; their number goes with the blocks, not
with the conversations, and the pass streams.  All other nodes are final in their block; those below a
boundary node get its name by block and place.

Defined cases: a null role or text is empty, a null turn comes first, rows of one
turn are ordered by the MD5 of role and text, repeated rows are turns of their
own; a null conv_id takes no part; a conversation without turns is a member of the
root; texts are whole, of any length; extra columns are ignored; an empty table has no nodes.  A
conversation is one row of 20 bytes a turn, and the ids that end in one node are
hashed in order by one task, which streams them.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeframe.sources.scratch import materialize, scratch_scope, written_side

#: Cells of a block's matrix unless told otherwise; a longer conversation is a block of its own.
CELLS = 1 << 20
#: Boundary nodes are broadcast to the nodes below them up to so many values.
SMALL = 1 << 20
WORD = r"[^\x20\x09-\x0D]+"
EMPTY = hashlib.sha256(b"").hexdigest()


def digested_turns(turns: DataFrame) -> DataFrame:
    """conv_id, turn, digest (16 bytes of role and text) and words of every row."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    return turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.unhex(F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text))).alias("digest"),
        F.regexp_count(text, F.lit(WORD)).cast("int").alias("words"),
    ).where("conv_id is not null")


def shared_starts(conv: int) -> int:
    """How many first turns conversation ``conv`` takes from the first of its twenty: unsigned crc32 of its decimal id modulo 4."""
    return zlib.crc32(str(conv).encode()) % 4


def rebuilt_paths(turns: DataFrame, *, borrow=shared_starts, block: int = 20) -> DataFrame:
    """conv_id, path (the digests of its turns) and words (of each turn) of every conversation.

    With ``borrow`` conversation c starts with the first ``borrow(c)`` turns (at most 3) of c - c % block and goes on with its own turns after
    its first ``borrow(c)``; with None conversations stay as they are.  Both are in one group, so one shuffle of narrow rows is enough.
    """
    base = F.col("conv_id") - F.col("conv_id") % F.lit(block) if borrow else F.col("conv_id")
    rows = digested_turns(turns).withColumn("base", base).withColumn("other", F.col("conv_id") != F.col("base"))
    rows = rows.repartition("base").sortWithinPartitions("base", "other", "conv_id", F.asc_nulls_first("turn"), "digest").select("base", "conv_id", "digest", "words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple[int, bytes, np.ndarray]] = []
        size, now, parts, counts = 0, None, [], []
        head = (None, b"", np.zeros(0, np.int32))  # the base that was seen last, its first turns

        def close():
            nonlocal head, size
            base, conv = now
            path, words = b"".join(parts), np.concatenate(counts)
            if conv == base:
                head = (base, path[:48], words[:3])
            elif borrow:
                h = borrow(conv)
                start, first = head[1:] if head[0] == base else (b"", words[:0])
                path, words = start[: 16 * h] + path[16 * h :], np.concatenate([first[:h], words[h:]])
            done.append((conv, path, words))
            size += len(path) + 64

        def give():
            nonlocal size
            ids, paths, words = zip(*done)
            bounds = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int32)
            out = pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(paths, pa.binary()), pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate(words), pa.int32()))], ["conv_id", "path", "words"])
            done.clear()
            size = 0
            return out

        for batch in batches:
            if not batch.num_rows:
                continue
            base, conv, words = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("base", "conv_id", "words"))
            digest = b"".join(batch.column("digest").to_pylist())
            edge = np.concatenate([[0], np.flatnonzero(conv[1:] != conv[:-1]) + 1, [len(conv)]]).tolist()
            for a, b in zip(edge[:-1], edge[1:]):
                if now != (key := (int(base[a]), int(conv[a]))):
                    if now is not None:
                        close()
                        if size >= 1 << 20:
                            yield give()
                    now, parts, counts = key, [], []
                parts.append(digest[16 * a : 16 * b])
                counts.append(words[a:b])
        if now is not None:
            close()
            yield give()

    return rows.mapInArrow(run, "conv_id long, path binary, words array<int>")


class _Block:
    """The nodes of some conversations that are neighbours in the order of paths."""

    def __init__(self, conv: np.ndarray, turns: np.ndarray, digest: np.ndarray, words: np.ndarray):
        n = len(conv)
        first = np.concatenate([[0], np.cumsum(turns)])
        row = np.repeat(np.arange(n), turns)
        matrix = np.zeros((n, int(turns.max())), np.int32)
        matrix[row, np.arange(len(row)) - first[row]] = self.turn_ids(digest)
        order = np.lexsort((conv, *matrix.T[::-1]))
        self.conv, self.turns, self.first = conv[order], turns[order], first[:-1][order]
        self.digest, self.words = digest, words
        matrix = matrix[order]
        self.starts = np.ones(matrix.shape, bool)
        self.starts[1:] = matrix[1:] != matrix[:-1]
        np.logical_or.accumulate(self.starts, axis=1, out=self.starts)
        self.levels = [self.level(depth) for depth in range(matrix.shape[1] + 1)]
        self.sum_up()

    @staticmethod
    def turn_ids(digest: np.ndarray) -> np.ndarray:
        """Dense ids from 1 of 16-byte digests, ascending with them."""
        high, low = digest.view(">u8").reshape(-1, 2).T
        order = np.lexsort((low, high))
        high, low = high[order], low[order]
        ids = np.empty(len(order), np.int32)
        ids[order] = np.cumsum(np.concatenate([[1], (high[1:] != high[:-1]) | (low[1:] != low[:-1])])[: len(order)])
        return ids

    def level(self, depth: int) -> dict[str, np.ndarray]:
        """Nodes of one depth in order: members, the smallest of them, words of their last turn, first row, and whether they can go on in another block."""
        rows = np.flatnonzero(self.turns >= depth)
        start = np.flatnonzero(self.starts[rows, depth - 1]) if depth else np.zeros(1, np.int64)
        at = rows[start]
        edge = np.zeros(len(at), bool)
        edge[0] |= self.turns[0] >= depth
        edge[-1] |= self.turns[-1] >= depth
        size = np.diff(np.append(start, len(rows)))
        node = np.full(len(self.turns), -1)
        node[rows] = np.repeat(np.arange(len(at)), size)
        stop = rows[self.turns[rows] == depth]
        return {
            "at": at, "members": size, "conv": np.minimum.reduceat(self.conv[rows], start), "edge": edge, "node": node, "stop": stop,
            "words": self.words[self.first[at] + depth - 1].astype(np.int64) if depth else np.zeros(1, np.int64),
        }

    def sum_up(self) -> None:
        """Children, leaves and savings of every node, from the deepest up; of a boundary node those of its inner children alone."""
        for depth in range(len(self.levels) - 1, -1, -1):
            here = self.levels[depth]
            n = len(here["at"])
            below = {k: np.zeros(n, np.int64) for k in ("children", "leaves", "saved")}
            if depth + 1 < len(self.levels):
                under = self.levels[depth + 1]
                under["parent"] = here["node"][under["at"]]
                inner = ~under["edge"]
                if inner.any():
                    parent = under["parent"][inner]
                    start = np.flatnonzero(np.concatenate([[True], parent[1:] != parent[:-1]]))
                    to = parent[start]
                    below["children"][to] = np.diff(np.append(start, len(parent)))
                    for k in ("leaves", "saved"):
                        below[k][to] = np.add.reduceat(under[k][inner], start)
            final = ~here["edge"]
            below["leaves"] += final & (below["children"] == 0)
            below["saved"] += np.where(final, (here["members"] - 1) * here["words"], 0)
            here |= below

    def path_hashes(self, row: int) -> list[bytes]:
        """Hashes of all prefixes of a row's path."""
        seen, out = hashlib.blake2b(digest_size=16), [b"root"]
        a = int(self.first[row])
        for k in range(int(self.turns[row])):
            seen.update(self.digest[a + k].tobytes())
            out.append(seen.digest())
        return out

    def rows(self, block: int) -> Iterator[pa.RecordBatch]:
        """Rows of ``BLOCKS``: inner nodes, boundary nodes and the ends at boundary nodes."""
        first, last = self.path_hashes(0), self.path_hashes(len(self.conv) - 1)
        for depth, here in enumerate(self.levels):
            n, edge = len(here["at"]), here["edge"]
            above = self.levels[depth - 1] if depth else None
            place = lambda d, i: 2 * d + int(i != 0 or self.turns[0] < d)  # noqa: E731  (the first path's node, or else the last one's)
            ends: list[str | None] = [EMPTY] * n
            stop = here["stop"]
            group = here["node"][stop]
            cut = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(stop) else []
            lost: list[tuple[bytes, np.ndarray]] = []
            for a, b in zip(cut, [*cut[1:], len(stop)]):
                i, convs = int(group[a]), self.conv[stop[a:b]]
                if edge[i]:
                    lost.append(((last if place(depth, i) % 2 else first)[depth], convs))
                else:
                    ends[i] = hashlib.sha256(",".join(map(str, convs.tolist())).encode()).hexdigest()
            parent = here["parent"] if depth else np.zeros(1, np.int64)
            bound = above["edge"][parent] if depth else np.zeros(1, bool)
            above_conv = above["conv"][parent] if depth else np.zeros(1, np.int64)
            places = [place(depth, i) if e else None for i, e in enumerate(edge.tolist())]
            parents = [place(depth - 1, int(p)) if b else None for p, b in zip(parent.tolist(), bound.tolist())]
            name = lambda d, at: None if at is None else (last if at % 2 else first)[d]
            yield pa.RecordBatch.from_arrays([
                pa.array(np.where(edge, 1, 0), pa.int32()), pa.array(np.full(n, block), pa.int64()), pa.array(places, pa.int32()), pa.array(parents, pa.int32()),
                pa.array([name(depth, p) for p in places], pa.binary()), pa.array([name(depth - 1, p) if e else None for p, e in zip(parents, edge.tolist())], pa.binary()),
                pa.array(here["conv"], pa.int64()), pa.array(np.full(n, depth), pa.int64()), pa.array(above_conv, pa.int64(), mask=bound if depth else np.ones(1, bool)),
                pa.array(here["members"], pa.int64()), pa.array(here["children"], pa.int64()), pa.array(here["leaves"], pa.int64()), pa.array(here["saved"], pa.int64()),
                pa.array(here["words"], pa.int64()), pa.array(ends, pa.string()),
            ], names=NAMES)
            for key, convs in lost:
                m, none = len(convs), pa.nulls
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(m, 2), pa.int32()), none(m, pa.int64()), none(m, pa.int32()), none(m, pa.int32()), pa.array([key] * m, pa.binary()), none(m, pa.binary()), pa.array(convs, pa.int64()),
                    *(none(m, pa.int64()) for _ in range(7)), none(m, pa.string()),
                ], names=NAMES)


#: kind: 0 inner node, 1 part of a boundary node, 2 conversation that ends at a boundary node.
BLOCKS = (
    "kind int, block long, place int, parent_place int, key binary, parent_key binary, conv_id long, depth long, parent_conv_id long, "
    "n_convs long, n_children long, n_leaves long, saved_tokens long, words long, ends_sha256 string"
)
NAMES = [c.split()[0] for c in BLOCKS.split(", ")]
RESULT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def _block_task(cells: int):
    """The task that takes a sorted shard of paths block by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), 0
        conv, turns, digest, words = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, 16), np.uint8), np.zeros(0, np.int32)

        def cut() -> int:
            """Rows of the next block, 0 if there may be more of them."""
            filled = np.maximum.accumulate(np.maximum(turns, 1)) * np.arange(1, len(turns) + 1)
            over = int(np.searchsorted(filled, cells, side="right"))
            return 0 if over == len(turns) else max(over, 1)

        for batch in batches:
            paths = b"".join(batch.column("path").to_pylist())
            column = batch.column("words")
            turns = np.concatenate([turns, np.diff(column.offsets.to_numpy()).astype(np.int64)])
            conv = np.concatenate([conv, batch.column("conv_id").to_numpy()])
            digest = np.concatenate([digest, np.frombuffer(paths, np.uint8).reshape(-1, 16)])
            words = np.concatenate([words, column.flatten().to_numpy()])
            while n := cut():
                m = int(turns[:n].sum())
                yield from _Block(conv[:n], turns[:n], digest[:m], words[:m]).rows(part << 40 | seen)
                conv, turns, digest, words = conv[n:], turns[n:], digest[m:], words[m:]
                seen += 1
        if len(conv):
            yield from _Block(conv, turns, digest, words).rows(part << 40 | seen)

    return run


def _end_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the conv_ids of each key, which come in order."""
    now, seen = None, None
    for batch in batches:
        keys, ids = batch.column("key").to_pylist(), batch.column("conv_id").to_pylist()
        a = 0
        while a < len(keys):
            b = a + 1
            while b < len(keys) and keys[b] == keys[a]:
                b += 1
            body = ",".join(map(str, ids[a:b])).encode()
            if keys[a] == now:
                seen.update(b"," + body)
            else:
                if now is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([seen.hexdigest()])], ["key", "ends"])
                now, seen = keys[a], hashlib.sha256(body)
            a = b
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([seen.hexdigest()])], ["key", "ends"])


def _subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole boundary nodes, deepest first: children, leaves and savings of their boundary children added."""
    open_: dict[bytes, list[int]] = {}
    for batch in batches:
        rows = batch.to_pydict()
        for i, (key, parent) in enumerate(zip(rows["key"], rows["parent_key"])):
            children, leaves, saved = open_.pop(key, (0, 0, 0))
            rows["n_children"][i] += children
            rows["n_leaves"][i] += leaves + (rows["n_children"][i] == 0)
            rows["saved_tokens"][i] += saved + (rows["n_convs"][i] - 1) * rows["words"][i]
            if parent is not None:
                sums = open_.setdefault(parent, [0, 0, 0])
                for k, x in enumerate((1, rows["n_leaves"][i], rows["saved_tokens"][i])):
                    sums[k] += x
        yield pa.RecordBatch.from_pydict(rows, schema=batch.schema)


def prefix_trie(paths: DataFrame, *, cells: int = CELLS) -> DataFrame:
    """One row for each node of the trie of ``paths`` (conv_id, path, words, as ``rebuilt_paths`` gives them), see ``RESULT``.

    ``conv_id`` is the smallest member; n_leaves and saved_tokens are sums over the node's subtree, itself included.
    """
    with scratch_scope(paths.sparkSession) as keep:
        written = materialize(paths, "trie-paths")  # the bounds of the ranges are drawn from it
        dealt = written.repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id")
        blocks = keep(materialize(dealt.mapInArrow(_block_task(cells), BLOCKS), "trie-blocks"))
        ends = blocks.where("kind = 2").select("key", "conv_id").repartition("key").sortWithinPartitions("key", "conv_id").mapInArrow(_end_hashes, "key binary, ends string")
        parts = blocks.where("kind = 1")
        whole = parts.groupBy("key").agg(
            F.min("parent_key").alias("parent_key"), F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"), F.min("words").alias("words"),
            *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")),
        )
        whole = whole.repartition(1).sortWithinPartitions(F.desc("depth"))
        whole = materialize(whole.mapInArrow(_subtrees, whole.schema), "trie-edges")
        names = written_side(whole.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id")), "trie-names", SMALL)
        ends = written_side(ends, "trie-ends", SMALL, F.lit(12))
        edges = keep(materialize(whole.join(ends, "key", "left").join(names, "parent_key", "left").withColumn("ends_sha256", F.coalesce("ends", F.lit(EMPTY))).select(RESULT), "trie-boundary"))
        named = parts.select("block", F.col("place").alias("parent_place"), F.col("key").alias("parent_key")).join(names, "parent_key").drop("parent_key")
        above = written_side(named.withColumnRenamed("parent_conv_id", "above"), "trie-above", SMALL)
        keep(above)
    inner = blocks.where("kind = 0")
    below = inner.where("parent_place is not null").drop("parent_conv_id").join(above, ["block", "parent_place"]).withColumnRenamed("above", "parent_conv_id")
    return inner.where("parent_place is null").select(RESULT).unionByName(below.select(RESULT)).unionByName(edges)
