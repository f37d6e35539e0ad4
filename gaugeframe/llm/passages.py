"""Repeated passages across documents by paragraph MinHash banding (operator 4).

Passages are planted anywhere in a line, so paragraphs are cut by content alone:
after a line break, after a word that ends in ``.``, ``!`` or ``?`` (of several
such words in a row after the first and one in 8 by hash), and by hash after one
word pair in 64, or in 12 where no such word is near (which bounds paragraphs of
text without stops).
A shared passage therefore has the same inner paragraphs in every document.
Paragraphs of fewer than ``LEAST_WORDS`` words carry no evidence of their own.

1. Paragraphs of equal words (any case of A-Z) are one class.  Each distinct class
   has the minima of ``BANDS`` hashes over its five-word shingles as one-row bands:
   at a Jaccard similarity of 0.8 a pair meets with probability 1 - 0.2**3 > 0.99,
   at 0.9 with 0.999; equal paragraphs always do, being one class.
2. Classes that share a band value are compared in tiles by the exact Jaccard
   similarity of their shingle sets; a tile gives out only the links that join its
   classes (fewer than its rows), and tiles bound the rows of a hot band value
   without capping it.
3. Links become clusters by connected components.
4. Within each document, neighbouring paragraphs whose clusters occur in other
   documents form runs; runs of at least ``LEAST_RUN_WORDS`` words count as repeated
   passages (a passage of 50 words keeps about this much after its broken first
   and last sentences).  Of each cluster the document with the smallest id keeps
   its paragraphs, the others' are marked removed.
5. Equal words are also found whatever lines and sentences they form: of every
   ``PIECE_WINDOW`` word pairs in a row the one of smallest hash is a cut, and a
   piece runs from a cut to the first cut at least ``LEAST_RUN_WORDS`` words on.
   The cuts between the first and the last window of a run of equal words are the
   same in every document, so a run of 2 * PIECE_WINDOW + LEAST_RUN_WORDS = 50 words
   or more always holds a whole piece.  Pieces of equal words in several documents
   are joined to runs where they overlap; the smallest id keeps them.  Runs are then
   extended on both sides by the equal words that the keeper of their outermost
   piece has there (for a kept run: the first document it is removed from); these are
   fewer than 2 * PIECE_WINDOW, as else a further piece were shared, ``REACH`` are
   compared, at the other document's first place of the piece.

Joins that keep few of a text pass's rows run behind a bit set of fixed size
(``key_filter``): a pass hands on only rows whose key may be wanted, whatever the
number of documents, and the exact join follows.

Defined cases: null and empty texts have no paragraphs; repetition inside one
document is left; rows that share a doc_id are one document; a null doc_id takes
no part; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugeframe.llm import _text
from gaugeframe.operators.graph import connected_components
from gaugeframe.sources.scratch import materialize, release, scratch_scope, written_side

SHINGLE_WORDS = 5
LEAST_WORDS = 5
LEAST_RUN_WORDS = 20
BANDS = 3
TILE = 256
CUT_ONE_IN = 64
CUT_STOPS_ONE_IN = 8
FAR_WORDS, CUT_FAR_ONE_IN = 12, 12
#: Numbers of a written table that may be broadcast.
BROADCAST_VALUES = 2_000_000
#: Bits of a filter that says which keys may be wanted: 8 MB, whatever the size of the data; what it lets through is joined exactly.
FILTER_BITS = 1 << 26
PIECE_WINDOW = 15
REACH = 32

_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?"]] = True
_SALT = np.array([0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0], np.uint64)


def _slices(data: np.ndarray, offsets: np.ndarray):
    """Paragraphs of texts: first and end word, text number, word spans and word hashes."""
    small = _text.lower(data)
    start, end, bounds = _text.words(small, offsets)
    if not len(start):
        none = np.zeros(0, np.int64)
        return none, none, none, start, end, np.zeros(0, np.uint64)
    hashed = _text.span_hashes(small, start, end)
    lines = np.cumsum(data == 10)
    stop = _STOP[data[end - 1]]
    pair = _text.mix(hashed[:-1] ^ (hashed[1:] * np.uint64(3)))
    cut = stop.copy()
    cut[1:] &= ~stop[:-1] | (pair % np.uint64(CUT_STOPS_ONE_IN) == 0)
    cut[:-1] |= lines[start[1:]] != lines[end[:-1] - 1]
    cut[:-1] |= pair % np.uint64(CUT_ONE_IN) == 0
    # far from any stop, within the text, cuts come more often
    seen = np.concatenate([[0], np.cumsum(stop)])
    at = np.arange(len(start))
    words = np.diff(bounds)
    low, high = np.repeat(bounds[:-1], words), np.repeat(bounds[1:], words)
    far = seen[np.minimum(at + FAR_WORDS + 1, high)] == seen[np.maximum(at - FAR_WORDS, low)]
    cut[:-1] |= far[:-1] & (pair % np.uint64(CUT_FAR_ONE_IN) == 0)
    cut[bounds[1:][np.diff(bounds) > 0] - 1] = True
    last = np.flatnonzero(cut) + 1
    first = np.concatenate([[0], last[:-1]])
    return first, last, np.searchsorted(bounds, first, side="right") - 1, start, end, hashed


def _windows(hashed: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of the paragraphs, flat, and their bounds."""
    whole, _ = _text.shingles(hashed, np.array([0, len(hashed)]), SHINGLE_WORDS)
    n = last - first - SHINGLE_WORDS + 1
    bounds = np.concatenate([[0], np.cumsum(n)])
    return whole[np.repeat(first - bounds[:-1], n) + np.arange(bounds[-1])], bounds


def key_filter(keys: DataFrame, column: str = "key") -> Broadcast:
    """A broadcast bit set of ``FILTER_BITS`` bits that holds every key of the column (hashes); others pass by chance only."""
    bit = F.col(column).bitwiseAND(F.lit(FILTER_BITS - 1))
    parts = keys.select((bit / 32768).cast("long").alias("part"), (bit % 32768).alias("bit")).groupBy("part").agg(F.bitmap_construct_agg("bit").alias("bits"))
    whole = np.zeros(FILTER_BITS // 8, np.uint8)
    for row in parts.collect():  # at most FILTER_BITS / 32768 rows of 4 KiB
        whole[row["part"] * 4096 : (row["part"] + 1) * 4096] = np.frombuffer(row["bits"], np.uint8)
    return keys.sparkSession.sparkContext.broadcast(whole.tobytes())


def _wanted(keys: np.ndarray, shared: Broadcast) -> np.ndarray:
    """Which of the keys the filter lets through."""
    bits = np.frombuffer(shared.value, np.uint8)
    at = keys & (FILTER_BITS - 1)
    return (bits[at >> 3] >> (at & 7)) & 1 == 1


def _paragraphs(docs: DataFrame, kind: str, wanted: Broadcast | None = None) -> DataFrame:
    """Paragraphs of at least LEAST_WORDS words: key and ``bands``, packed shingle ``sets`` or ``places``; with ``wanted`` only keys of that filter."""
    schema = {
        "bands": "doc_id long, key long, b0 long, b1 long, b2 long", "sets": "key long, set binary", "places": "doc_id long, key long, paragraph int, start int, until int, words int",
    }[kind]
    names = [c.split(" ")[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _text.chunks(batch, "text"):
                data, offsets = _text.flat(part.column("text"))
                first, last, text, start, end, hashed = _slices(data, offsets)
                use = last - first >= LEAST_WORDS
                first, last, text = first[use], last[use], text[use]
                if not len(first):
                    continue
                up, down = _text.powers(len(hashed) + 1)
                total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashed * up[: len(hashed)])])
                key = _text.mix((total[last] - total[first]) * down[first] + (last - first).astype(np.uint64)).view(np.int64)
                number = np.arange(len(text)) - np.searchsorted(text, text)
                if wanted is not None:
                    use = _wanted(key, wanted)
                    first, last, text, key, number = first[use], last[use], text[use], key[use], number[use]
                    if not len(first):
                        continue
                if kind == "places":
                    point = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                    origin = point[offsets[text]]
                    columns = [pa.array(x.astype(np.int32)) for x in (number, point[start[first]] - origin, point[end[last - 1]] - origin, last - first)]
                else:
                    value, bounds = _windows(hashed, first, last)
                    if kind == "sets":
                        packed = [np.unique(value[a:b]).tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(packed, pa.binary())], names)
                        continue
                    columns = [pa.array(_text.mix(np.minimum.reduceat(_text.mix(value ^ s), bounds[:-1]) + s).view(np.int64)) for s in _SALT]
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(text)), pa.array(key), *columns], names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _members(kinds: DataFrame, wanted: Broadcast) -> DataFrame:
    """key, low, high and band of the classes, for each of their bands that the filter lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(BANDS):
                band = batch.column(f"b{i}")
                part = batch.select(["key", "low", "high"]).append_column("band", band)
                yield part.filter(pa.array(_wanted(band.to_numpy(), wanted)))

    return kinds.mapInArrow(run, "key long, low long, high long, band long")


def _cut_pieces(column: pa.Array, least: int) -> dict[str, np.ndarray] | None:
    """Pieces of texts between winnowed cuts, of at least ``least`` words: first and end word, text and key of each, and the words they are made of."""
    data, offsets = _text.flat(column)
    small = _text.lower(data)
    start, end, bounds = _text.words(small, offsets)
    if len(start) <= PIECE_WINDOW:
        return None
    hashed = _text.span_hashes(small, start, end)
    pair = _text.mix(hashed[:-1] ^ (hashed[1:] * np.uint64(3)))
    windows = np.lib.stride_tricks.sliding_window_view(pair, PIECE_WINDOW)
    at = np.arange(len(windows))
    of = np.searchsorted(bounds, at, side="right") - 1
    inside = at + PIECE_WINDOW < bounds[of + 1]  # a window sees one text only
    cut = np.unique((at + PIECE_WINDOW - 1 - windows[:, ::-1].argmin(axis=1))[inside])
    first = cut + 1
    stop = np.searchsorted(first, first + least)
    first, stop = first[stop < len(first)], stop[stop < len(first)]
    last = (cut + 1)[stop]
    text = np.searchsorted(bounds, first, side="right") - 1
    use = last <= bounds[text + 1]
    first, last, text = first[use], last[use], text[use]
    if not len(first):
        return None
    up, down = _text.powers(len(hashed) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashed * up[: len(hashed)])])
    key = _text.mix((total[last] - total[first]) * down[first] + (last - first).astype(np.uint64)).view(np.int64)
    return {"first": first, "last": last, "text": text, "key": key, "start": start, "end": end, "bounds": bounds, "hashed": hashed, "data": data, "offsets": offsets}


def _points(data: np.ndarray) -> np.ndarray:
    """The code points before each byte."""
    return np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])


def _pieces(docs: DataFrame, least: int, wanted: Broadcast | None = None) -> DataFrame:
    """The pieces of whole texts (``_cut_pieces``): doc_id and key; with the filter ``wanted`` only keys
    that it lets through, and their first and end word and code point."""
    names = ["doc_id", "key"] if wanted is None else ["doc_id", "key", "first", "last", "start", "until"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _text.chunks(batch, "text"):
                cut = _cut_pieces(part.column("text"), least)
                if cut is None:
                    continue
                first, last, text, key = (cut[c] for c in ("first", "last", "text", "key"))
                columns = []
                if wanted is not None:
                    use = _wanted(key, wanted)
                    first, last, text, key = first[use], last[use], text[use], key[use]
                    point = _points(cut["data"])
                    origin, before = point[cut["offsets"][text]], cut["bounds"][text]
                    ints = (first - before, last - before, point[cut["start"][first]] - origin, point[cut["end"][last - 1]] - origin)
                    columns = [pa.array(x.astype(np.int32)) for x in ints]
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(text)), pa.array(key), *columns], names)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, key long" + ("" if wanted is None else ", first int, last int, start int, until int"))


def _sides(docs: DataFrame, ends: DataFrame, least: int) -> DataFrame:
    """For the ends (doc_id, run, key, left, at; a written table) of runs: hashes of the up to ``REACH`` words before (left) or after them,
    nearest first, and the code points that a run extended by so many words reaches to.

    Texts are cut into pieces once more, and a task hands on only the sides of pieces that the filter of the ends lets through; the exact
    join follows, so no text is shuffled.
    """
    names = ["doc_id", "key", "left", "at", "words", "points"]
    mark = F.shiftleft("doc_id", 1).bitwiseOR(F.col("left").cast("long"))
    asked = key_filter(ends.select(F.col("key").bitwiseXOR(mark).alias("key")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _text.chunks(batch, "text"):
                cut = _cut_pieces(part.column("text"), least)
                if cut is None:
                    continue
                start, end, bounds, text, key = (cut[c] for c in ("start", "end", "bounds", "text", "key"))
                ids = part.column("doc_id").to_numpy()[text]
                short = (cut["hashed"] >> np.uint64(32)).astype(np.uint32).view(np.int32)
                point = None
                for left, place in ((True, cut["first"]), (False, cut["last"])):
                    use = _wanted(key ^ (ids << 1 | int(left)), asked)
                    if not use.any():
                        continue
                    point = _points(cut["data"]) if point is None else point
                    at, of = place[use], text[use]
                    n = np.clip(at - bounds[of] if left else bounds[of + 1] - at, 0, REACH)
                    each = np.concatenate([[0], np.cumsum(n)])
                    step = np.arange(each[-1]) - np.repeat(each[:-1], n)
                    word = np.repeat(at, n) + (-1 - step if left else step)
                    reached = point[start[word] if left else end[word]] - np.repeat(point[cut["offsets"][of]], n)
                    lists = [pa.ListArray.from_arrays(pa.array(each.astype(np.int32)), pa.array(v)) for v in (short[word], reached.astype(np.int32))]
                    columns = [pa.array(ids[use]), pa.array(key[use]), pa.array(np.full(len(at), left)), pa.array((at - bounds[of]).astype(np.int32))]
                    yield pa.RecordBatch.from_arrays([*columns, *lists], names)

    found = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, key long, left boolean, at int, words array<int>, points array<int>")
    return found.join(ends.hint("merge"), ["doc_id", "key", "left", "at"]).select("doc_id", "run", "key", "left", "words", "points")


def _extended(docs: DataFrame, hits: DataFrame, runs: DataFrame, least: int) -> DataFrame:
    """``runs`` with the equal words on both sides: a removed run those that the keeper of its outermost piece has there too, a kept
    run those that the first document (by id) from which the piece is removed has there."""
    runs = runs.withColumn("run", 2 * F.col("run") + F.col("removed").cast("long"))  # one number for each run of a document
    outer = F.array(
        F.struct(F.col("first_key").alias("key"), F.lit(True).alias("left"), F.col("first").alias("at")), F.struct(F.col("last_key").alias("key"), F.lit(False).alias("left"), F.col("last").alias("at"))
    )
    ends = runs.select("doc_id", "run", "removed", F.explode(outer).alias("e")).select("doc_id", "run", "removed", "e.key", "e.left", "e.at")
    # the other side of each end: the first place of its key in the keeper, or in the first document that it is removed from
    first = hits.groupBy("key", "removed").agg(F.min(F.struct("doc_id", "first", "last")).alias("s"))
    asked = ends.select("key", "left", (~F.col("removed")).alias("removed")).distinct()
    others = first.join(asked.hint("merge"), ["key", "removed"]).select(
        "s.doc_id", (-1 - F.col("removed").cast("long")).alias("run"), "key", "left", F.when(F.col("left"), F.col("s.first")).otherwise(F.col("s.last")).alias("at")
    )
    ends = materialize(ends.drop("removed").unionByName(others).distinct(), "run-ends")
    both = materialize(_sides(docs, ends, least), "run-sides")
    release(docs.sparkSession)
    own = both.where("run >= 0").withColumn("other", -1 - (1 - F.col("run") % 2))
    met = own.join(both.where("run < 0").select("key", "left", F.col("run").alias("other"), F.col("words").alias("others")).hint("merge"), ["key", "left", "other"])
    differ = F.array_position(F.zip_with("words", "others", lambda x, y: x.eqNullSafe(y)), False)
    n = F.when(differ > 0, differ - 1).otherwise(F.least(F.size("words"), F.size("others"))).cast("int")
    wider = met.select("doc_id", "run", "left", n.alias("n"), "points").where("n > 0").select("doc_id", "run", "left", F.struct("n", F.element_at("points", F.col("n")).alias("point")).alias("e"))
    side = lambda left: F.max(F.when(F.col("left") == F.lit(left), F.col("e")))
    wider = wider.groupBy("doc_id", "run").agg(side(True).alias("before"), side(False).alias("after"))
    return runs.join(wider.hint("merge"), ["doc_id", "run"], "left").select(
        "doc_id", "removed", (F.col("first") - F.coalesce("before.n", F.lit(0))).alias("first"), (F.col("last") + F.coalesce("after.n", F.lit(0))).alias("last"),
        F.coalesce("before.point", "start").alias("start"), F.coalesce("after.point", "until").alias("until"), "cluster", "keep_doc",
    )


def _equal_runs(docs: DataFrame, least: int) -> DataFrame:
    """Runs of overlapping pieces of equal words that several documents hold, kept and removed ones apart."""
    twice = _pieces(docs, least).groupBy("key").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("key", "low")
    twice = materialize(twice, "equal-pieces")
    release(docs.sparkSession)
    again = _pieces(docs, least, key_filter(twice)).join(twice.hint("merge"), "key")
    hits = every = materialize(again.withColumn("removed", F.col("doc_id") != F.col("low")), "equal-hits")
    # cuts near a run's ends may be those of some documents only; what they add inside a removed run is not kept
    upto = [w.rowsBetween(Window.unboundedPreceding, Window.currentRow) for w in (
        Window.partitionBy("doc_id").orderBy("first", "last"), Window.partitionBy("doc_id").orderBy(F.desc("first"), F.desc("last")))]
    gone = F.max(F.when(F.col("removed"), F.col("last"))).over(upto[0])
    soon = F.min(F.when(F.col("removed"), F.col("first"))).over(upto[1])
    meets = F.coalesce(gone > F.col("first"), F.lit(False)) | F.coalesce(soon < F.col("last"), F.lit(False))
    hits = hits.withColumn("meets", meets).where(F.col("removed") | ~F.col("meets"))
    own = Window.partitionBy("doc_id", "removed").orderBy("first", "last")
    reached = F.max("last").over(own.rowsBetween(Window.unboundedPreceding, -1))
    hits = hits.withColumn("run", F.coalesce((F.col("first") > reached).cast("int"), F.lit(1))).withColumn("run", F.sum("run").over(own))  # a long, from 1
    runs = hits.groupBy("doc_id", "removed", "run").agg(
        F.min("first").alias("first"), F.max("last").alias("last"), F.min("start").alias("start"), F.max("until").alias("until"),
        F.min("key").alias("cluster"), F.min("low").alias("keep_doc"), F.min_by("key", "first").alias("first_key"), F.max_by("key", "last").alias("last_key"),
    )
    runs = materialize(runs, "equal-runs")
    del again, hits
    release(docs.sparkSession)
    return _extended(docs, every, runs, least)


def _linked(rows: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that join the classes of each tile, by exact Jaccard similarity."""

    def links(block: list[tuple]) -> list[tuple[int, int]]:
        keys = [r[3] for r in block]
        half = np.array([r[4] for r in block])
        sets = [np.frombuffer(r[5], np.uint64) for r in block]
        size = np.array([len(s) for s in sets])
        owner = np.repeat(np.arange(len(block)), size)
        value = np.concatenate(sets)
        order = np.argsort(value, kind="stable")
        owner, value = owner[order], value[order]
        edge = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1], [True]]))
        common = np.zeros((len(block), len(block)), np.int32)
        for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            if b - a > 1:
                common[np.ix_(owner[a:b], owner[a:b])] += 1
        near = 100 * common >= percent * (size[:, None] + size[None, :] - common)
        if block[0][1] != block[0][2]:
            near &= half[:, None] != half[None, :]
        x, y = np.nonzero(np.triu(near, 1))
        root: dict[int, int] = {}

        def find(c: int) -> int:
            while root.get(c, c) != c:
                c = root[c]
            return c

        found = []
        for a, b in zip(x.tolist(), y.tolist(), strict=True):
            p, q = find(a), find(b)
            if p != q:
                root[max(p, q)] = min(p, q)
                found.append((keys[a], keys[b]))
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, block, out = None, [], []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("band", "i", "j", "key", "half", "set")), strict=True):
                if row[:3] != now:
                    out += links(block) if len(block) > 1 else []
                    now, block = row[:3], []
                block.append(row)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in out], pa.int64()) for k in (0, 1)], ["a", "b"])
                out = []
        out = links(block) if len(block) > 1 else []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in out], pa.int64()) for k in (0, 1)], ["a", "b"])

    dealt = rows.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j", "key")
    return dealt.select("band", "i", "j", "key", "half", "set").mapInArrow(run, "a long, b long")


def repeated_passages(docs: DataFrame, *, percent: int = 80, least_run_words: int = LEAST_RUN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The paragraphs of passages and the runs of equal words that repeat across documents, the kept ones too.

    Columns: doc_id, paragraph (number among the document's counted paragraphs, null for a run of equal words), start_char and end_char (code points), n_words, component_id,
    keep_doc (the document that keeps the paragraph), removed.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null")
    with scratch_scope(docs.sparkSession) as keep:
        out = keep(materialize(_repeated_paragraphs(docs, percent, least_run_words), "repeated-paragraphs"))
    release(docs.sparkSession)
    with scratch_scope(docs.sparkSession) as keep:
        runs = keep(materialize(_equal_runs(docs, least_run_words), "repeated-runs"))
    release(docs.sparkSession)
    runs = runs.withColumn("paragraph", F.lit(None).cast("int")).withColumn("words", F.col("last") - F.col("first"))
    return out.unionByName(runs.select(*out.columns)).select(
        "doc_id", "paragraph", F.col("start").alias("start_char"), F.col("until").alias("end_char"), F.col("words").alias("n_words"),
        F.col("cluster").alias("component_id"), "keep_doc", "removed",
    )


def _repeated_paragraphs(docs: DataFrame, percent: int, least_run_words: int) -> DataFrame:
    """The paragraphs of runs whose clusters several documents hold: doc_id, paragraph, start, until, words, cluster, keep_doc, removed."""
    kinds = _paragraphs(docs, "bands").groupBy("key").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), *(F.min(f"b{i}").alias(f"b{i}") for i in range(BANDS)))
    kinds = materialize(kinds, "paragraph-classes")
    release(docs.sparkSession)

    met = kinds.select(F.explode(F.array(*(F.col(f"b{i}") for i in range(BANDS)))).alias("band")).groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    met = materialize(met, "paragraph-buckets")
    rows = materialize(_members(kinds, key_filter(met, "band")).join(met.hint("merge"), "band"), "paragraph-members")
    release(docs.sparkSession)
    needed = rows.select("key").distinct()
    sets = _paragraphs(docs, "sets", key_filter(rows)).join(needed.hint("merge"), "key").groupBy("key").agg(F.min("set").alias("set"))
    tiles = F.ceil(F.col("n") / TILE).cast("long")
    tiled = rows.withColumn("half", F.pmod(F.xxhash64("key"), tiles)).withColumn("x", F.explode(F.sequence(F.lit(0).cast("long"), tiles - 1)))
    tiled = tiled.select("band", F.least("half", "x").alias("i"), F.greatest("half", "x").alias("j"), "key", "half").join(sets.hint("merge"), "key")
    near = materialize(connected_components(_linked(tiled, percent), "a", "b"), "paragraph-clusters")

    ends = rows.groupBy("key").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    wide = ends.join(near.hint("merge"), ends["key"] == near["id"]).groupBy("component").agg(F.min("low").alias("x"), F.max("high").alias("y")).where("x < y")
    many = near.join(materialize(wide, "wide-clusters").hint("merge"), "component").select(F.col("id").alias("key"), F.col("component").alias("cluster"))
    alone = kinds.where("low < high").join(near.hint("merge"), kinds["key"] == near["id"], "left_anti").select("key", F.col("key").alias("cluster"))
    shared = materialize(many.unionByName(alone), "repeated-classes")
    del tiled, sets, many, alone
    release(docs.sparkSession)

    found = _paragraphs(docs, "places", key_filter(shared)).join(shared.hint("merge"), "key")
    own = Window.partitionBy("doc_id").orderBy("paragraph")
    found = found.withColumn("run", F.col("paragraph") - F.dense_rank().over(own))
    found = found.withColumn("run_words", F.sum("words").over(Window.partitionBy("doc_id", "run"))).where(F.col("run_words") >= least_run_words)
    found = materialize(found.select("doc_id", "paragraph", "start", "until", "words", "cluster").distinct(), "runs")
    keep = found.groupBy("cluster").agg(F.min("doc_id").alias("keep_doc"), F.max("doc_id").alias("last")).where("keep_doc < last").select("cluster", "keep_doc")
    keep = materialize(keep, "kept")
    out = found.join(keep.hint("merge"), "cluster")  # two plain shuffles, so that a hot cluster can be split
    return out.withColumn("removed", F.col("doc_id") != F.col("keep_doc"))


def without_spans(text: str | None, spans: list[tuple[int, int]]) -> str | None:
    """``text`` without the code points of ``spans``; a cut between two spans that only white space separates takes that too."""
    if text is None:
        return None
    out, at = [], 0
    for start, end in sorted(spans):
        if start > at and (not at or text[at:start].strip()):
            out.append(text[at:start])
        at = max(at, end)
    out.append(text[at:])
    return "".join(out)


def _joined(cuts: list[dict]) -> list[tuple[int, int]]:
    """Spans of the cuts, those of neighbouring paragraphs as one (with the short pieces between them)."""
    out: list[list[int]] = []
    for cut in cuts:
        if out and None not in (cut["paragraph"], out[-1][2]) and cut["paragraph"] == out[-1][2] + 1:
            out[-1][1:] = [cut["end_char"], cut["paragraph"]]
        else:
            out.append([cut["start_char"], cut["end_char"], cut["paragraph"]])
    return [(a, b) for a, b, _ in out]


def remove_passages(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``docs`` (columns doc_id, text, n_chars and others) with the removed paragraphs cut from their texts; no document is dropped."""
    return without_passages(docs, removed_spans(found))


def removed_spans(found: DataFrame) -> DataFrame:
    """The removed stretches of each document, written, with a hint for the join."""
    cut = F.struct("paragraph", "start_char", "end_char")
    spans = found.where("removed").groupBy(F.col("doc_id").alias("_cut_id")).agg(F.sort_array(F.collect_list(cut)).alias("_spans"))
    return written_side(spans, "cuts", BROADCAST_VALUES, 1 + 2 * F.size("_spans"))


def without_passages(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """``docs`` without the stretches that ``removed_spans`` gave."""
    names = docs.columns
    joined = docs.join(spans, docs["doc_id"] == spans["_cut_id"], "left").select(*(docs[c] for c in names), spans["_spans"].alias("_spans of passages"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = dict(zip(names, batch.columns, strict=False))
            kept = [without_spans(t.as_py(), _joined(s.as_py())) for t, s in zip(columns["text"], batch.columns[-1], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(kept, pa.string()) if c == "text" else columns[c] for c in names], names)

    has = F.col("`_spans of passages`").isNotNull()
    cut = joined.where(has).mapInArrow(run, docs.schema).withColumn("n_chars", F.char_length("text").cast("long"))
    return joined.where(~has).select(*names).unionByName(cut.select(*names))
