"""Near-duplicate documents by SetSketch registers (operator 1).

Every document's set of distinct word shingles becomes ``m`` SetSketch
registers ``K_i = clip(floor(1 - log_b(min_d h_i(d))), 0, q + 1)`` with
exponentially distributed ``h_i``: register-wise maxima merge, and at base
``b`` near 1 two registers agree with a probability close to the Jaccard
similarity.  The steps:

1. ``sketch_documents``: one pass over the texts gives the set size, a 128-bit
   key of the set and the registers.  Equal sets collapse into one class, so a
   group of exact copies costs one row from here on.
2. Registers are cut into bands.  Classes that share a band value meet in a
   bucket.  A bucket never emits its pairs: first each class is compared with
   one hub (of the hubs of its buckets the one it meets most often; a bucket's
   hub is the class that meets most others over all bands, such as the original
   of many near copies).
3. Candidates pass a joint likelihood estimate of the Jaccard similarity from
   the counts of larger, smaller and equal registers and the known set sizes,
   and are then confirmed on the full sets.
4. Buckets whose classes are still in different components are compared in
   full, tile by tile, within numpy: the classes of the most frequent component
   with all others, and these with each other.  A first pass over the registers keeps the
   classes that have a candidate across components; a second pass confirms
   candidates on the full sets inside the tile, likeliest first, and gives out
   the links that join components there: fewer than the tile has rows.  A pair
   is tried only in the first band in which it collides.  So no bucket is capped
   and no colliding pair across components is lost, while a group of near copies
   that step 3 has joined costs no further work.

With 40 bands of 6 registers a pair at similarity 0.8 meets with probability
1 - (1 - 0.8**6)**40 > 0.99999; the estimate's cut lies six standard errors
below the threshold.

Defined cases: texts that are null, empty or without words have no shingles,
link with nothing and form their own component.  Rows that share a doc_id are
one document: their texts are linked, each row has its own n_shingles (a row
without words stays by itself).  A null doc_id takes no part: component_id null,
kept true.  Extra columns are ignored, whatever their names; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gaugeframe.llm import _text
from gaugeframe.operators.graph import connected_components
from gaugeframe.sources.scratch import materialize, materialize_observed, scratch_scope, written_side

BANDS, ROWS = 40, 6
BASE_B, RATE_A, TOP_Q = 1.001, 20.0, (1 << 16) - 2
#: Registers count from this power of the base, so that sets of 1 to 10**12 shingles stay inside 0..q+1.
SHIFT = 8000
TILE = 512
#: Bytes of full sets that one tile may hold; a tile with more is cut into smaller ones.
TILE_BYTES = 32 << 20
#: Numbers of a written id or pair table that may be broadcast.
BROADCAST_VALUES = 2_000_000

_rng = np.random.Generator(np.random.PCG64(20210114))
_MULTIPLY = (_rng.integers(0, 1 << 31, BANDS * ROWS, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
_ADD = _rng.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint64).astype(np.uint32)


def registers(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """SetSketch registers (texts x m, uint16) of sets of 64-bit hashes; empty sets have all-zero registers."""
    m = BANDS * ROWS
    out = np.zeros((len(bounds) - 1, m), np.uint16)
    full = np.flatnonzero(np.diff(bounds) > 0)
    if not len(full):
        return out
    start = bounds[full]
    x = (values >> np.uint64(32)).astype(np.uint32)
    low = np.empty((m, len(full)), np.uint32)
    for i in range(m):
        low[i] = np.minimum.reduceat(x * _MULTIPLY[i] + _ADD[i], start)
    exponential = -np.log1p(-(low.T.astype(np.float64) + 0.5) / 2.0**32) / RATE_A
    out[full] = np.clip(np.floor(1.0 - np.log(exponential) / np.log(BASE_B)) + SHIFT, 0, TOP_Q + 1).astype(np.uint16)
    return out


def likelihood_jaccard(larger: np.ndarray, smaller: np.ndarray, equal: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity from register comparisons and known set sizes (on a grid of 1/200)."""
    grid = np.linspace(0.0, 1.0, 201)[None, :]
    u = (n_a / (n_a + n_b))[:, None]
    v = 1.0 - u
    p = lambda x: -np.log1p(-np.clip(x, 0.0, 1.0) * (BASE_B - 1.0) / BASE_B) / np.log(BASE_B)
    above, below = p(u - v * grid), p(v - u * grid)
    log = lambda x: np.log(np.maximum(x, 1e-12))
    score = larger[:, None] * log(above) + smaller[:, None] * log(below) + equal[:, None] * log(1.0 - above - below)
    score[grid.repeat(len(u), 0) > np.minimum(u / v, v / u)] = -np.inf
    return grid[0][np.argmax(score, axis=1)]


def sketch_documents(docs: DataFrame, shingle_words: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, k1, k2 (key of the set, null for the empty set) and sketch of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _text.chunks(batch, "text"):
                values, bounds = _text.shingle_sets(part.column("text"), shingle_words)
                sketch = registers(values, bounds)
                size = np.diff(bounds)
                keys = np.zeros((2, len(size)), np.uint64)
                for i, salt in enumerate((np.uint64(0x2545F4914F6CDD1D), np.uint64(0xD6E8FEB86659FD93))):
                    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_text.mix(values ^ salt))])
                    keys[i] = _text.mix(total[bounds[1:]] - total[bounds[:-1]] + size.astype(np.uint64))
                none = size == 0
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(size), *(pa.array(k.view(np.int64), mask=none) for k in keys),
                     pa.FixedSizeBinaryArray.from_buffers(pa.binary(2 * BANDS * ROWS), len(size), [None, pa.py_buffer(sketch.tobytes())]).cast(pa.binary())],
                    ["doc_id", "n_shingles", "k1", "k2", "sketch"],
                )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_shingles long, k1 long, k2 long, sketch binary")


def _estimated(pairs: DataFrame, sketches: DataFrame, cut: float) -> DataFrame:
    """The pairs (a, b) whose likelihood estimate is at least ``cut``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                x, y = (np.frombuffer(b"".join(part.column(c).to_pylist()), np.uint16).reshape(part.num_rows, -1) for c in ("sa", "sb"))
                n_a, n_b = (np.asarray(part.column(c)).astype(float) for c in ("na", "nb"))
                j = likelihood_jaccard((x > y).sum(1), (x < y).sum(1), (x == y).sum(1), n_a, n_b)
                yield part.select(["a", "b"]).filter(pa.array(j >= cut))

    side = lambda c: sketches.select(F.col("rep").alias(c), F.col("sketch").alias(f"s{c}"), F.col("n_shingles").alias(f"n{c}"))
    both = pairs.select("a", "b").join(side("a").hint("merge"), "a").join(side("b").hint("merge"), "b")
    return both.select("a", "b", "sa", "sb", "na", "nb").mapInArrow(run, "a long, b long")


def _confirmed(pairs: DataFrame, docs: DataFrame, shingle_words: int, percent: int) -> DataFrame:
    """The pairs (a, b; written, with a hint) whose full sets satisfy 100 * intersection >= percent * union."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _text.chunks(batch, "text"):
                values, bounds = _text.shingle_sets(part.column("text"), shingle_words)
                found = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values.view(np.int64)))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in part.schema.names if c != "text"), found], [*(c for c in part.schema.names if c != "text"), "set"])

    b_ids = written_side(pairs.select("b").distinct(), "hub-ids", BROADCAST_VALUES)
    left = docs.join(pairs, docs["doc_id"] == pairs["a"]).select("a", "b", "text").mapInArrow(sets, "a long, b long, set array<bigint>")
    right = docs.join(b_ids, docs["doc_id"] == b_ids["b"]).select("b", "text").mapInArrow(sets, "b long, set array<bigint>")
    met = left.join(right.select("b", F.col("set").alias("other")).hint("merge"), "b")
    common = F.size(F.array_intersect("set", "other"))
    return met.where(100 * common >= percent * (F.size("set") + F.size("other") - common)).select("a", "b")


def _blocks(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[list[tuple]]:
    """Runs of rows of one tile (key, i, j, p, q) from batches sorted by tile."""
    now, block = None, []
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
            if row[:5] != now:
                if len(block) > 1:
                    yield block
                now, block = row[:5], []
            block.append(row)
    if len(block) > 1:
        yield block


def _candidates(block: list[tuple], cut: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row numbers (x, y) of the tile's candidate pairs across components, and their estimates.

    Rows are as ``_TILE`` says; where i and j (or the parts p and q) differ, only rows of different halves (sides) are a pair.
    """
    at = {c: k for k, c in enumerate(_TILE)}
    comp, half, side = (np.array([r[at[c]] for r in block]) for c in ("comp", "half", "side"))
    sketch = np.frombuffer(b"".join(r[at["sketch"]] for r in block), np.uint16).reshape(len(block), -1)
    size = np.array([r[at["n_shingles"]] for r in block], float)
    band = block[0][at["band"]]
    early = sketch[:, : band * ROWS].reshape(len(block), band, ROWS)
    _, i, j, p, q = block[0][:5]
    least = int(BANDS * ROWS * cut) - 1
    out = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]]
    for x in range(len(block) - 1):
        y = np.flatnonzero((comp != comp[x]) & ((half != half[x]) if i != j else True) & ((side != side[x]) if p != q else True))
        y = y[y > x]
        if len(y):
            same = (sketch[y] == sketch[x]).sum(1)
            y, same = y[same >= least], same[same >= least]
        if len(y) and band:
            first = ~(early[y] == early[x]).all(2).any(1)
            y, same = y[first], same[first]
        if len(y):
            estimate = likelihood_jaccard((sketch[x] > sketch[y]).sum(1), (sketch[x] < sketch[y]).sum(1), same, np.full(len(y), size[x]), size[y])
            ok = estimate >= cut
            for o, v in zip(out, (np.full(len(y), x), y, estimate), strict=True):
                o.append(v[ok])
    return tuple(np.concatenate(o) for o in out)


_TILE = ["key", "i", "j", "p", "q", "rep", "comp", "half", "side", "band", "sketch", "n_shingles"]
_KEYS = _TILE[:5]


def _dealt(rows: DataFrame) -> DataFrame:
    """Rows (key, rep, comp, band and the bucket's most frequent component ``major``, ``n_major``, ``n_rest``) as rows of tiles.

    Only pairs across components matter.  The rows of the most frequent component meet those of all others in a grid of tiles, and
    the others meet each other in a triangle of tiles; no tile holds two rows of the most frequent component only, so a large group
    of joined copies with a few foreign classes costs as many rows as it has.
    """
    tiles = lambda n: F.greatest(F.ceil(n / TILE), F.lit(1)).cast("long")
    big, small = tiles(F.col("n_major")), tiles(F.col("n_rest"))
    hashed = F.xxhash64("rep")
    place = lambda i, j, half: F.struct(i.alias("i"), j.alias("j"), half.alias("half"))
    upto = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    own_big, own_small = F.pmod(hashed, big), F.pmod(hashed, small)
    grid_major = F.transform(upto(small), lambda x: place(own_big, -1 - x, own_big))
    grid_rest = F.transform(upto(big), lambda x: place(x, -1 - own_small, -1 - own_small))
    triangle = F.transform(upto(small), lambda x: place(F.least(own_small, x), F.greatest(own_small, x), own_small))
    where = F.when(F.col("comp") == F.col("major"), grid_major).otherwise(F.concat(grid_rest, triangle))
    rows = rows.select("key", "rep", "comp", "band", F.explode(where).alias("s")).select("key", "s.i", "s.j", "rep", "comp", "s.half", "band")
    zero = F.lit(0).cast("long")
    return rows.withColumns({"p": zero, "q": zero, "side": zero})


def _cut_by_bytes(rows: DataFrame) -> DataFrame:
    """Tiles whose full sets exceed ``TILE_BYTES`` as the pairs (p, q) of their parts."""
    whole = Window.partitionBy("key", "i", "j")
    parts = F.greatest(F.ceil(8 * F.sum("n_shingles").over(whole) / TILE_BYTES), F.lit(1)).cast("long")
    rows = rows.drop("p", "q", "side").withColumn("parts", parts).withColumn("side", F.pmod(F.xxhash64("rep", F.lit(1)), F.col("parts")))
    rows = rows.withColumn("x", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    return rows.withColumns({"p": F.least("side", "x"), "q": F.greatest("side", "x")}).drop("x", "parts")


def _tiled(rows: DataFrame, *more: str) -> DataFrame:
    return rows.repartition(*_KEYS).sortWithinPartitions(*_KEYS).select(*_TILE, *more)


def _open_rows(rows: DataFrame, cut: float) -> DataFrame:
    """The rows of each tile that have a candidate across components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches, _TILE):
            x, y, _ = _candidates(block, cut)
            found = np.union1d(x, y).tolist()
            if found:
                columns = [pa.array([block[k][c] for k in found], pa.int32() if name == "band" else pa.int64()) for c, name in enumerate(names)]
                yield pa.RecordBatch.from_arrays(columns, names)

    names = _TILE[:10]
    return _tiled(rows).mapInArrow(run, ", ".join(f"{c} {'int' if c == 'band' else 'long'}" for c in names))


def _tile_links(rows: DataFrame, cut: float, percent: int) -> DataFrame:
    """Links that join components within each tile, as pairs of component ids, confirmed on the full sets."""
    comp_at, set_at = _TILE.index("comp"), len(_TILE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches, [*_TILE, "set"]):
            x, y, estimate = _candidates(block, cut)
            order = np.argsort(-estimate, kind="stable")
            root: dict[int, int] = {}

            def find(c: int) -> int:
                while root.get(c, c) != c:
                    c = root[c]
                return c

            sets: dict[int, np.ndarray] = {}
            found: list[tuple[int, int]] = []
            for a, b in zip(x[order].tolist(), y[order].tolist(), strict=True):
                p, q = find(block[a][comp_at]), find(block[b][comp_at])
                if p == q:
                    continue
                for k in (a, b):
                    if k not in sets:
                        sets[k] = np.frombuffer(block[k][set_at], np.uint64)
                common = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
                if 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                    root[max(p, q)] = min(p, q)
                    found.append((block[a][comp_at], block[b][comp_at]))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    return _tiled(rows, "set").mapInArrow(run, "a long, b long")


def _full_sets(docs: DataFrame, ids: DataFrame, shingle_words: int) -> DataFrame:
    """rep and set (sorted 64-bit shingle hashes, packed) of the documents whose ids (rep) are in ``ids`` (written, with a hint)."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _text.chunks(batch, "text"):
                values, bounds = _text.shingle_sets(part.column("text"), shingle_words)
                packed = [values[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("rep"), pa.array(packed, pa.binary())], ["rep", "set"])

    return docs.join(ids, docs["doc_id"] == ids["rep"]).select("rep", "text").mapInArrow(sets, "rep long, set binary")


def _same_document(base: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (a, b) between the classes of rows that share a doc_id."""
    key = F.struct("k1", "k2")
    full = base.where("n_shingles > 0 and doc_id is not null").select("doc_id", "k1", "k2")
    several = full.groupBy("doc_id").agg(F.min(key).alias("x"), F.max(key).alias("y")).where("x != y").select("doc_id")
    several, seen = materialize_observed(several, "several-texts", F.count(F.lit(1)).alias("n"))
    if not seen["n"]:
        return base.sparkSession.createDataFrame([], "a long, b long")
    own = materialize(full.join(several.hint("merge"), "doc_id").join(classes.select("k1", "k2", "rep").hint("merge"), ["k1", "k2"]).select("doc_id", "rep").distinct(), "their-classes")
    low = own.groupBy("doc_id").agg(F.min("rep").alias("low"))
    return own.join(low.hint("merge"), "doc_id").where("rep != low").select(F.col("rep").alias("a"), F.col("low").alias("b"))


def near_duplicate_components(
    spark: SparkSession, docs: DataFrame, *, shingle_words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs``; see the module's text for the method."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    with scratch_scope(spark) as keep:
        base, ids = _class_components(docs, shingle_words, percent)
        keep(base), keep(ids)
    out = base.select("doc_id", "n_shingles", "k1", "k2").join(ids.hint("merge"), ["k1", "k2"], "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("component_id", "doc_id")).cast("long")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def _class_components(docs: DataFrame, shingle_words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """The written sketches of all rows and the component of each class (k1, k2), written."""
    cut = max(0.0, percent / 100 - 6 * (percent / 100 * (1 - percent / 100) / (BANDS * ROWS)) ** 0.5)
    base = materialize(sketch_documents(docs, shingle_words), "sketches")
    classes = base.where("n_shingles > 0 and doc_id is not null").groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "n_shingles", "sketch")).alias("s"))
    classes = materialize(classes.select("k1", "k2", F.col("s.doc_id").alias("rep"), "s.n_shingles", "s.sketch"), "classes")

    key = lambda i: F.struct(F.lit(i).alias("band"), F.xxhash64(F.lit(i), F.substring("sketch", 2 * ROWS * i + 1, 2 * ROWS)).alias("key"))
    bands = classes.select("rep", F.explode(F.array(*(key(i) for i in range(BANDS)))).alias("s")).select("rep", "s.band", "s.key")
    shared = bands.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = materialize(shared, "buckets")
    members = materialize(bands.join(shared.hint("merge"), "key"), "members")
    degree = materialize(members.groupBy("rep").agg(F.sum("n").alias("degree")), "degrees")
    hubs = members.join(degree.hint("merge"), "rep").groupBy("key").agg(F.max(F.struct("degree", (-F.col("rep")).alias("r"))).alias("s"))
    hubs = materialize(hubs.select("key", (-F.col("s.r")).alias("hub")), "hubs")

    links = members.join(hubs.hint("merge"), "key").where("rep != hub").groupBy("rep", "hub").agg(F.count("*").alias("n"))
    best = links.groupBy("rep").agg(F.max(F.struct("n", (-F.col("hub")).alias("hub"))).alias("s")).select(F.col("rep").alias("a"), (-F.col("s.hub")).alias("b"))
    first = written_side(_estimated(best, classes, cut), "first-pairs", BROADCAST_VALUES)
    first = _confirmed(first, docs, shingle_words, percent).unionByName(_same_document(base, classes))
    found = materialize(connected_components(first, "a", "b"), "first-components")

    placed = members.join(found.hint("merge"), members["rep"] == found["id"], "left").select("key", "band", "rep", F.coalesce("component", "rep").alias("comp"))
    placed = materialize(placed, "placed")
    counts = placed.groupBy("key", "comp").agg(F.count("*").alias("n")).groupBy("key").agg(F.max(F.struct("n", "comp")).alias("s"), F.sum("n").alias("n"))
    opened = counts.where("s.n < n").select("key", F.col("s.comp").alias("major"), F.col("s.n").alias("n_major"), (F.col("n") - F.col("s.n")).alias("n_rest"))
    opened, seen = materialize_observed(opened, "open-buckets", F.count(F.lit(1)).alias("n"))
    if seen["n"]:
        sketches = classes.select("rep", "sketch", "n_shingles")
        rest = _dealt(placed.join(opened.hint("merge"), "key"))
        rest = materialize(_open_rows(rest.join(sketches.hint("merge"), "rep"), cut), "open-rows")
        sets = _full_sets(docs, written_side(rest.select("rep").distinct(), "open-ids", BROADCAST_VALUES), shingle_words)
        rest = _cut_by_bytes(rest.join(sketches.hint("merge"), "rep")).join(sets.hint("merge"), "rep")
        joined = materialize(connected_components(_tile_links(rest, cut, percent), "a", "b"), "joined-components")
        joined = joined.select(F.col("id").alias("component"), F.col("component").alias("wider")).hint("merge")
        alone = joined.join(found.hint("merge"), joined["component"] == found["id"], "left_anti").select(F.col("component").alias("id"), F.col("wider").alias("component"))
        found = found.join(joined, "component", "left").select("id", F.coalesce("wider", "component").alias("component")).unionByName(alone)

    ids = materialize(
        classes.join(found.hint("merge"), classes["rep"] == found["id"], "left").select("k1", "k2", F.coalesce("component", "rep").alias("component_id")),
        "class-components",
    )
    return base, ids
