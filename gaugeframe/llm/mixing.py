"""Mixing sources to target weights by iterative proportional fitting (operator 9).

Documents fall into cells of (source, lang, topic).  The cells' token sums are
raked: in turn for each of the three margins, every cell is scaled so that the
margin's sums meet their targets, until all margins agree within ``TOLERANCE``.
A cell's raked tokens over its tokens is its documents' calibrated weight; the
probability of a document is that weight times one constant, at most 1, with the
constant chosen so that the expected tokens are ``share`` of all.  A document is
selected when a uniform number from the MD5 of its id is below its probability,
so the choice repeats.

Targets are shares per value of a margin; by default a margin's token shares to
the power ``temper``, which lifts small sources, languages and topics.

A document's topic is that of ``topic_col`` where one is named, else it is taken
from the text: its distinct lower-cased words are hashed with signs into ``DIMS``
sums, of unit length; the mean of the document's language is taken off, so that a
topic is what sets texts of one language apart, and the nearest of ``TOPICS``
directions, found by spherical k-means over all documents, is the topic.  The
start is the best of ``RESTARTS`` on the ``START`` documents of smallest hash, each
of the ``STEPS`` rounds that follow reads the vectors of all documents; vectors are whole numbers, so their
sums and the topics don't depend on the order of tasks.

Text is read twice, for the vectors and for the documents' rows, without a
shuffle of texts.  The cells are sums, a few numbers for each combination that
occurs; a table of at most ``CELLS_IN_TASK`` of them is raked in one Arrow task,
a larger one by the same steps as joins, a round to a written table.

Defined cases: null source or lang is a value of its own; a null or empty text
has no tokens and counts as one, its topic is ``none``, as is that of a text whose
vector is its language's mean; equally near topics go to the smaller number;
languages beyond the ``LANGS`` most frequent share one mean; a null id draws from
the MD5 of the empty string; repeated rows are chosen alike; an empty table gives an empty result.
Targets that contradict each other (a margin's values that occur with too few of
another's) can't all be met: after ``ROUNDS`` rounds the last weights stand, and
``deviation`` says how far the worst margin's sum is from its target (relative;
below ``TOLERANCE`` where all are met).  A target for a value that never occurs
is ignored, a value without one gets the weight 0.  Columns of the documents that
have the name of a result are replaced by it, all others are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeframe.llm import _text
from gaugeframe.sources.scratch import drop_written, materialize, materialize_observed

MARGINS = ("source", "lang", "topic")
ROUNDS, TOLERANCE = 200, 1e-4
TEMPER = 0.5
SHARE = 0.75
#: Topics taken from texts: their number, the numbers of a vector and their unit, rounds, documents that the start is chosen from.
TOPICS, DIMS, UNIT, STEPS, START = 8, 64, 4096, 6, 2048
RESTARTS = 12
#: Languages with a mean of their own.
LANGS = 1000
CELLS_IN_TASK = 200_000
CELL_BROADCAST_ROWS = 200_000
RESULTS = ("_tokens", "_source", "_lang", "_topic", "weight", "probability", "deviation", "selected")


def token_count(text: Column) -> Column:
    """Words of the text, at least 1."""
    return F.greatest(F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(1)).cast("long")


def text_vectors(column: pa.Array) -> np.ndarray:
    """Vectors (texts x DIMS, int16) of the distinct lower-cased words of each whole text; zero for texts without words."""
    data, offsets = _text.flat(column)
    data = _text.lower(data)
    start, end, bounds = _text.words(data, offsets)
    value, bounds = _text.distinct(_text.span_hashes(data, start, end), bounds)
    n = len(bounds) - 1
    place = np.repeat(np.arange(n), np.diff(bounds)) * DIMS + (value % np.uint64(DIMS)).astype(np.int64)
    sign = np.where(value >> np.uint64(63), 1.0, -1.0)
    v = np.bincount(place, weights=sign, minlength=n * DIMS).reshape(n, DIMS)
    length = np.sqrt((v * v).sum(1, keepdims=True))
    return np.rint(np.divide(v, length, out=np.zeros(v.shape), where=length > 0) * UNIT).astype(np.int16)


class Topics:
    """Means of the languages (the value ``*`` for all others) and directions of the topics."""

    def __init__(self, means: dict[str, np.ndarray], centres: np.ndarray):
        self.means, self.centres = means, centres

    def centred(self, vectors: np.ndarray, lang: list[str]) -> np.ndarray:
        """Whole numbers left when the language's mean is taken off; zero stays for texts without words."""
        mean = np.stack([self.means.get(x, self.means["*"]) for x in lang]) if lang else np.zeros((0, DIMS), np.int64)
        return np.where(vectors.any(1)[:, None], vectors.astype(np.int64) - mean, 0)

    def of(self, centred: np.ndarray) -> np.ndarray:
        """Numbers of the nearest topics, -1 for zero vectors."""
        if not len(self.centres):
            return np.full(len(centred), -1)
        return np.where(centred.any(1), (centred @ self.centres.T).argmax(1), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows as whole numbers of length ``UNIT``, so that products with vectors are exact."""
    length = np.sqrt((x.astype(float) ** 2).sum(1, keepdims=True))
    return np.rint(np.divide(x, length, out=np.zeros(x.shape), where=length > 0) * UNIT).astype(np.int64)


def _started(points: np.ndarray, k: int) -> np.ndarray:
    """Up to ``k`` directions that fit ``points`` best, of ``RESTARTS`` runs: k-means++ with fixed draws, then rounds on these points."""
    points = _unit(points[points.any(1)])
    best, least = np.zeros((0, DIMS), np.int64), np.inf
    for seed in range(RESTARTS if len(points) else 0):
        rng, chosen = np.random.Generator(np.random.PCG64(seed)), []
        far = np.ones(len(points))
        while len(chosen) < k and far.sum() > 1e-6:
            at = int(np.searchsorted(np.cumsum(far), rng.random() * far.sum(), side="right").clip(0, len(points) - 1))
            chosen.append(points[at])
            far = np.minimum(far, np.maximum(0.0, 1.0 - points @ points[at] / UNIT**2))
        centres = np.stack(chosen)
        for _ in range(STEPS):
            topic = (points @ centres.T).argmax(1)
            sums = np.stack([points[topic == t].sum(0) for t in range(len(centres))])
            centres = np.where(sums.any(1)[:, None], _unit(sums), centres)
        off = -float((points @ centres.T).max(1).sum())
        if off < least:
            best, least = centres, off
    return best


def _vector_rows(batch: pa.RecordBatch) -> tuple[np.ndarray, list[str]]:
    vectors = np.asarray(batch.column("v").flatten()).reshape(batch.num_rows, DIMS)
    return vectors, batch.column("_lang").to_pylist()


def _sums(vectors: DataFrame, fitted: Topics) -> np.ndarray:
    """Summed vectors of each topic's documents (topics x DIMS); a task hands on no more than one row for each."""
    k = len(fitted.centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, DIMS), np.int64)
        for batch in batches:
            own = fitted.centred(*_vector_rows(batch))
            topic = fitted.of(own)
            for t in range(k):
                total[t] += own[topic == t].sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(k), DIMS)), pa.array(np.tile(np.arange(DIMS), k)), pa.array(total.ravel())], ["k", "d", "s"])

    out = np.zeros((k, DIMS), np.int64)
    for r in vectors.select("_lang", "v").mapInArrow(run, "k long, d long, s long").groupBy("k", "d").agg(F.sum("s").alias("s")).collect():  # k * DIMS rows
        out[r["k"], r["d"]] = r["s"]
    return out


def fit_topics(vectors: DataFrame, topics: int = TOPICS) -> Topics:
    """Topics of a written table of ``_lang`` and ``v``."""
    worded = vectors.where(F.exists("v", lambda x: x != 0))
    parts = [F.sum(F.col("v")[i].cast("long")).alias(f"s{i}") for i in range(DIMS)]
    each = worded.groupBy("_lang").agg(F.count("*").alias("n"), *parts).orderBy(F.desc("n"), "_lang").limit(LANGS)
    every = worded.agg(F.count("*").alias("n"), *parts).select(F.lit("*").alias("_lang"), "n", *(f"s{i}" for i in range(DIMS)))
    means = {r["_lang"]: np.array([round((r[f"s{i}"] or 0) / max(1, r["n"])) for i in range(DIMS)], np.int64) for r in each.unionByName(every).collect()}  # LANGS + 1 rows
    fitted = Topics(means, np.zeros((0, DIMS), np.int64))
    first = worded.orderBy(F.xxhash64("v", "_lang"), "v", "_lang").limit(START).select("_lang", "v").collect()  # START rows
    if first:
        fitted.centres = _started(fitted.centred(np.array([r["v"] for r in first], np.int16), [r["_lang"] for r in first]), topics)
    for _ in range(STEPS if len(fitted.centres) else 0):
        sums = _sums(vectors, fitted)
        new = np.where(sums.any(1)[:, None], _unit(sums), fitted.centres)
        if (new == fitted.centres).all():
            break
        fitted.centres = new
    return fitted


def _named(topic: np.ndarray) -> pa.Array:
    return pa.array([f"topic {t}" if t >= 0 else "none" for t in topic.tolist()], pa.string())


def _vectors(docs: DataFrame) -> DataFrame:
    """A written table of _tokens, _source, _lang and v of all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _text.chunks(batch, "text"):
                v = text_vectors(part.column("text"))
                found = pa.ListArray.from_arrays(pa.array(np.arange(0, v.size + 1, DIMS, dtype=np.int32)), pa.array(v.ravel()))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("_tokens", "_source", "_lang")), found], ["_tokens", "_source", "_lang", "v"])

    rows = docs.select("_tokens", "_source", "_lang", F.col("text").cast("string").alias("text"))
    return materialize(rows.mapInArrow(run, "_tokens long, _source string, _lang string, v array<smallint>"), "topic-vectors")


def _with_vector_topics(vectors: DataFrame, fitted: Topics) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            topic = _named(fitted.of(fitted.centred(*_vector_rows(batch))))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("_tokens", "_source", "_lang")), topic], ["_tokens", "_source", "_lang", "_topic"])

    return vectors.mapInArrow(run, "_tokens long, _source string, _lang string, _topic string")


def with_text_topics(docs: DataFrame, fitted: Topics) -> DataFrame:
    """``docs`` (with ``_lang``) with ``_topic`` from the text, in one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _text.chunks(batch, "text"):
                topic = _named(fitted.of(fitted.centred(text_vectors(part.column("text")), part.column("_lang").to_pylist())))
                yield pa.RecordBatch.from_arrays([*part.columns, topic], [*part.schema.names, "_topic"])

    return docs.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), "_topic string"]))


def with_margins(docs: DataFrame, topic_col: str | None = None) -> DataFrame:
    """``docs`` with ``_tokens`` and the columns ``_source``, ``_lang`` and, from ``topic_col``, ``_topic`` (no nulls)."""
    value = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("null"))
    named = {"_source": value("source"), "_lang": value("lang")} | ({"_topic": value(topic_col)} if topic_col else {})
    return docs.withColumns({"_tokens": token_count(F.col("text").cast("string"))} | named)


def with_targets(cells: DataFrame, targets: dict[str, DataFrame] | None) -> DataFrame:
    """``cells`` with ``goal_<margin>`` for each margin: the share asked for its value, null where the margin has no targets."""
    for m in MARGINS:
        if targets and m in targets:
            asked = targets[m].groupBy(F.col("value").alias(m)).agg(F.max("share").cast("double").alias(f"goal_{m}"))
            cells = cells.join(asked.hint("merge"), m, "left").na.fill(0.0, [f"goal_{m}"])
        else:
            cells = cells.withColumn(f"goal_{m}", F.lit(None).cast("double"))
    return cells


def raked_arrays(codes: list[np.ndarray], tokens: np.ndarray, goals: list[np.ndarray | None], temper: float) -> tuple[np.ndarray, float]:
    """Raked tokens (shares of 1) of the cells and the worst margin's relative deviation."""
    shares = []
    for code, goal in zip(codes, goals, strict=True):
        n = np.bincount(code, tokens)
        if goal is None:
            g = n**temper
        else:
            g = np.zeros(len(n))
            g[code] = goal
        shares.append(g / g.sum() if g.sum() else g)
    now = tokens / tokens.sum()
    for _ in range(ROUNDS):
        worst = 0.0
        for code, goal in zip(codes, shares, strict=True):
            s = np.bincount(code, now)
            f = np.divide(goal, s, out=np.zeros(len(s)), where=s > 0)
            worst = max(worst, float(np.abs(f - 1)[s > 0].max(initial=0.0)))
            now = now * f[code]
        if worst < TOLERANCE:
            break
    return now, worst


def constant_for(tokens: np.ndarray, weight: np.ndarray, wanted: float) -> float:
    """c with sum(tokens * min(1, c * weight)) = wanted, exactly: the cells from the heaviest on are full, the others in proportion."""
    used = weight > 0
    t, w = tokens[used], weight[used]
    if not len(t):
        return 0.0
    order = np.argsort(-w, kind="stable")
    t, w = t[order], w[order]
    full = np.concatenate([[0.0], np.cumsum(t)[:-1]])
    rest = np.cumsum((t * w)[::-1])[::-1]
    c = (wanted - full) / rest
    fits = np.flatnonzero(c * w <= 1)
    return float(c[fits[0]]) if len(fits) else float(1 / w[-1])


def _in_one_task(cells: DataFrame, share: float, temper: float) -> DataFrame:
    """weight, probability and deviation of a bounded table of cells, in one Arrow task."""
    keys = [f"_{m}" for m in MARGINS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = list(batches)
        table = pa.Table.from_batches(rows) if rows else None
        if table is None or not table.num_rows:
            return
        table = table.sort_by([(m, "ascending") for m in MARGINS]).combine_chunks()
        codes = [np.unique(np.asarray(table[m].to_pylist(), object), return_inverse=True)[1] for m in MARGINS]
        tokens = table["tokens"].to_numpy().astype(float)
        goals = [None if table[f"goal_{m}"].null_count else table[f"goal_{m}"].to_numpy() for m in MARGINS]
        raked, off = raked_arrays(codes, tokens, goals, temper)
        weight = raked * tokens.sum() / tokens
        chance = np.minimum(1.0, weight * constant_for(tokens, weight, share * tokens.sum()))
        out = [*(table[m].combine_chunks() for m in MARGINS), pa.array(weight), pa.array(chance), pa.array(np.full(len(tokens), off))]
        yield pa.RecordBatch.from_arrays([x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in out], [*keys, "weight", "probability", "deviation"])

    schema = ", ".join(f"{k} string" for k in keys) + ", weight double, probability double, deviation double"
    return cells.repartition(1).mapInArrow(run, schema)


def rake(cells: DataFrame, temper: float = TEMPER) -> DataFrame:
    """Cells of any number with ``raked`` (tokens scaled to the targets, as shares of 1) and ``deviation``; a written table."""
    goals = {}
    for m in MARGINS:
        sums = cells.groupBy(m).agg(F.sum("tokens").cast("double").alias("n"), F.max(f"goal_{m}").alias("asked"))
        sums = sums.select(m, F.coalesce("asked", F.pow(F.col("n"), F.lit(temper))).alias("goal"))
        total = sums.agg(F.sum("goal").alias("t"))
        share = F.when(F.col("t") > 0, F.col("goal") / F.col("t")).otherwise(F.lit(0.0))
        goals[m] = materialize(sums.crossJoin(F.broadcast(total)).select(m, share.alias("goal")), f"goal-{m}")
    now, worst, written = cells.withColumn("raked", F.col("tokens").cast("double")), None, None
    for _ in range(ROUNDS):
        for m in MARGINS:
            sums = now.groupBy(m).agg(F.sum("raked").alias("s")).join(goals[m].hint("merge"), m)
            scale = sums.select(m, F.when(F.col("s") > 0, F.col("goal") / F.col("s")).otherwise(F.lit(0.0)).alias("f"), (F.col("s") > 0).alias("on"))
            off = F.when(F.col("on"), F.abs(F.col("f") - 1)).otherwise(F.lit(0.0))
            now = now.join(scale.hint("merge"), m).withColumn("raked", F.col("raked") * F.col("f")).withColumn(f"_off_{m}", off).drop("f", "on")
        new, seen = materialize_observed(now, "raked", F.max(F.greatest(*(F.col(f"_off_{m}") for m in MARGINS))).alias("worst"))
        if written is not None:
            drop_written(written)
        written, worst = new, seen["worst"]
        now = new.drop(*(f"_off_{m}" for m in MARGINS))
        if worst is None or worst < TOLERANCE:
            break
    return now.withColumn("deviation", F.lit(worst).cast("double"))


def _constant(cells: DataFrame, wanted: float) -> float:
    """As ``constant_for`` for cells of any number, by bisection; each step narrows 32 brackets in one aggregation."""
    top = cells.agg(F.min(F.when(F.col("weight") > 0, F.col("weight")))).first()[0]
    if top is None:
        return 0.0
    low, high = 0.0, 1.0 / top
    for _ in range(8):
        steps = [low + (high - low) * i / 32 for i in range(1, 33)]
        tried = cells.select("tokens", "weight", F.posexplode(F.array(*(F.lit(c) for c in steps))).alias("i", "c"))
        sums = tried.groupBy("i").agg(F.sum(F.col("tokens") * F.least(F.lit(1.0), F.col("weight") * F.col("c"))).alias("s"))
        i = sums.where(F.col("s") >= wanted).agg(F.min("i")).first()[0]
        i = 31 if i is None else i
        low, high = (steps[i - 1] if i else low), steps[i]
    return high


def mixing_weights(
    placed: DataFrame, *, share: float = SHARE, temper: float = TEMPER, targets: dict[str, DataFrame] | None = None, cells_in_task: int = CELLS_IN_TASK
) -> DataFrame:
    """A written table of cells: _source, _lang, _topic, weight, probability and deviation, hinted for its join; ``placed`` holds the
    margin columns and ``_tokens`` of each document."""
    sums = placed.groupBy(*(F.col(f"_{m}").alias(m) for m in MARGINS)).agg(F.sum("_tokens").alias("tokens"))
    cells, seen = materialize_observed(with_targets(sums, targets), "cells", F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("tokens"))
    if seen["n"] <= cells_in_task:
        out = _in_one_task(cells, share, temper)
    else:
        raked = rake(cells, temper).withColumn("weight", F.col("raked") * float(seen["tokens"] or 0) / F.col("tokens"))
        c = _constant(raked, share * (seen["tokens"] or 0))
        out = raked.select(*(F.col(m).alias(f"_{m}") for m in MARGINS), "weight", F.least(F.lit(1.0), F.col("weight") * c).alias("probability"), "deviation")
    return materialize(out, "mix").hint("broadcast" if seen["n"] <= CELL_BROADCAST_ROWS else "merge")


def draw(id_col: Column) -> Column:
    """A number in [0, 1) from the MD5 of the id."""
    return F.conv(F.substring(F.md5(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("double") / float(1 << 32)


def mix_documents(docs: DataFrame, *, topic_col: str | None = None, topics: int = TOPICS, **options) -> DataFrame:
    """``docs`` with ``_tokens``, the margin columns, ``weight``, ``probability``, ``deviation`` and ``selected``."""
    placed = with_margins(docs.drop(*RESULTS) if topic_col not in RESULTS else docs.drop(*(c for c in RESULTS if c != topic_col)), topic_col)
    if topic_col:
        cells = mixing_weights(placed, **options)
    else:
        vectors = _vectors(placed)
        fitted = fit_topics(vectors, topics)
        cells = mixing_weights(_with_vector_topics(vectors, fitted), **options)
        drop_written(vectors)
        placed = with_text_topics(placed, fitted)
    placed = placed.join(cells, [f"_{m}" for m in MARGINS])
    return placed.withColumn("selected", draw(F.col("doc_id")) < F.col("probability"))
