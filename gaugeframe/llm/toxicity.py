"""Toxicity by a factorization machine over hashed terms (operator 10).

A text's terms are its distinct lower-cased words and the words' beginnings of
``PREFIXES`` bytes (which carry over to inflected and compounded forms), hashed
to ``BUCKETS`` indices.  A factorization machine scores them as

    w0 + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)

with x_i the weight of a present term: its pairwise part sees two terms together,
such as an insult and the mention of a group, that neither weight alone decides.
A logistic link gives the score.

Terms take part if they differ between the classes by themselves, or next to one
of the ``LEADERS`` strongest of these: a machine of the former is fitted first, and
where its errors lean to one side in the rows that hold a leader and another term,
that term joins for the final fit, however evenly the classes hold it alone.

Fitting: at most ``SAMPLE`` labelled rows of each class (those of smallest id
hash; this is the documented bound), one task, AdaGrad over shuffled mini-batches
with a fixed seed.  The model has a fixed size and travels in a broadcast.
Scoring reads every whole text in one pass without a shuffle.

Only labels of rows whose crc32 of the decimal doc_id is not 1 modulo 3 are
learnt from; labels, lang, source and doc_id are never inputs of a score.

Defined cases: an empty table of documents gives an empty result and a model of
no labels; rows that share a doc_id are each scored, and each learnt from if
labelled; a null or empty text has no terms and scores the bias alone, as
does a text of unseen words; a null doc_id is scored and not held out; labels
that are null are not learnt from, repeated label rows of one document count
once (the larger label); without a label of each class all scores are the share
of label 1 (none: 0); extra columns are ignored.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeframe.llm import _text
from gaugeframe.sources.scratch import materialize, written_side

BUCKETS = 1 << 18
FACTORS = 4
PREFIXES = (4, 6)
#: Labelled rows of each class that a model is fitted on, at most.
SAMPLE = 12_000
EPOCHS, BATCH, RATE, L2, FACTOR_L2 = 20, 64, 0.2, 2e-5, 1e-4
#: Terms whose presence tells the classes apart by fewer standard errors have no weight.
LEAST_Z, LEAST_ROWS = 2.5, 2
#: Strongest terms whose partners are looked for, and how far errors must lean for one.
LEADERS, PARTNER_Z = 32, 5.0
THRESHOLD = 0.7

_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[[i for i in range(33, 127) if not chr(i).isalnum()]] = True


def terms(column: pa.Array, keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct term indices of each whole text, and their bounds; with ``keep`` (a flag for each bucket) only the kept ones."""
    data, offsets = _text.flat(column)
    data = _text.lower(data)
    data = np.where(_PUNCTUATION[data], np.uint8(32), data)
    start, end, bounds = _text.words(data, offsets)
    n = end - start
    kinds = [_text.span_hashes(data, start, end)]
    for k in PREFIXES:
        cut = np.minimum(n, k)
        kinds.append(_text.mix(_text.span_hashes(data, start, start + cut) + np.uint64(k)))
    index = np.stack([(h % np.uint64(BUCKETS)).astype(np.int32) for h in kinds], axis=1).reshape(-1)
    bounds = bounds * len(kinds)
    if keep is not None:
        inside = keep[index]
        index, bounds = index[inside], np.concatenate([[0], np.cumsum(inside)])[bounds]
    return _text.distinct(index, bounds)


class Machine:
    """Weights of a fitted factorization machine."""

    def __init__(self, bias: float, linear: np.ndarray, factors: np.ndarray):
        self.bias, self.linear, self.factors = bias, linear, factors

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, bias=self.bias, linear=self.linear, factors=self.factors)
        return out.getvalue()

    @classmethod
    def load(cls, raw: bytes) -> Machine:
        with np.load(io.BytesIO(raw)) as z:
            return cls(float(z["bias"]), z["linear"], z["factors"])

    def raw(self, index: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """The scores before the logistic link."""
        out = np.full(len(bounds) - 1, self.bias)
        full = np.flatnonzero(np.diff(bounds) > 0)
        if len(full):
            at = bounds[full]
            v = self.factors[index]
            total, square = np.add.reduceat(v, at, axis=0), np.add.reduceat(v * v, at, axis=0)
            out[full] += np.add.reduceat(self.linear[index], at) + 0.5 * (total * total - square).sum(1)
        return out

    def scores(self, index: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.raw(index, bounds), -35, 35)))


def fit(index: np.ndarray, bounds: np.ndarray, label: np.ndarray) -> Machine:
    """AdaGrad on the logistic loss over the terms that matter alone or next to another; rows are visited in an order drawn from a fixed seed."""
    share = float(label.mean()) if len(label) else 0.0
    if share in (0.0, 1.0):
        return Machine(-35.0 if share == 0 else 35.0, np.zeros(BUCKETS, np.float32), np.zeros((BUCKETS, FACTORS), np.float32))
    # terms that differ between the classes by themselves; a block of rows at a time, so that no copy has the size of all terms
    n1, n0 = label.sum(), (1 - label).sum()
    c1, c0 = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for r, e in _row_blocks(label):
        own, of = index[bounds[r] : bounds[e]], np.repeat(label[r:e] == 1, np.diff(bounds[r : e + 1]))
        c1 += np.bincount(own[of], minlength=BUCKETS)
        c0 += np.bincount(own[~of], minlength=BUCKETS)
    pooled = (c1 + c0) / (n1 + n0)
    z = np.abs(c1 / n1 - c0 / n0) / np.sqrt(np.maximum(pooled * (1 - pooled), 1e-12) * (1 / n1 + 1 / n0))
    often = c1 + c0 >= LEAST_ROWS
    keep = (z >= LEAST_Z) & often
    machine = _train(*_only(index, bounds, label, keep), label)
    partners = often & ~keep & _partners(index, bounds, label, machine, np.argsort(-np.where(keep, z, 0.0), kind="stable")[: min(LEADERS, int(keep.sum()))])
    if partners.any():
        machine = _train(*_only(index, bounds, label, keep | partners), label)
    return machine


def _row_blocks(label: np.ndarray) -> list[tuple[int, int]]:
    return [(r, min(r + 1000, len(label))) for r in range(0, len(label), 1000)]


def _only(index: np.ndarray, bounds: np.ndarray, label: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows' terms that are kept, and their bounds."""
    kept, ends = [np.zeros(0, index.dtype)], [np.zeros(1, np.int64)]
    for r, e in _row_blocks(label):
        inside = keep[index[bounds[r] : bounds[e]]]
        kept.append(index[bounds[r] : bounds[e]][inside])
        ends.append(ends[-1][-1] + np.concatenate([[0], np.cumsum(inside)])[bounds[r + 1 : e + 1] - bounds[r]])
    return np.concatenate(kept), np.concatenate(ends)


def _partners(index: np.ndarray, bounds: np.ndarray, label: np.ndarray, machine: Machine, leaders: np.ndarray) -> np.ndarray:
    """Terms that tell the classes apart next to a leader, though not by themselves: in the rows that hold both, the errors of the
    first machine lean to one side by ``PARTNER_Z`` standard deviations."""
    known = (machine.linear != 0) | (machine.factors != 0).any(axis=1)
    p = machine.scores(*_only(index, bounds, label, known))
    error, spread = label - p, np.maximum(p * (1 - p), 1e-6)
    size = np.diff(bounds)
    found = np.zeros(BUCKETS, bool)
    for leader in leaders.tolist():
        rows = np.searchsorted(bounds, np.flatnonzero(index == leader), side="right") - 1
        lean, var = np.zeros(BUCKETS), np.zeros(BUCKETS)
        for at in range(0, len(rows), 1000):
            part = rows[at : at + 1000]
            n = size[part]
            own = index[np.repeat(bounds[part] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            lean += np.bincount(own, weights=np.repeat(error[part], n), minlength=BUCKETS)
            var += np.bincount(own, weights=np.repeat(spread[part], n), minlength=BUCKETS)
        found |= np.abs(lean) >= PARTNER_Z * np.sqrt(np.maximum(var, 1.0))
    return found


def _train(index: np.ndarray, bounds: np.ndarray, label: np.ndarray) -> Machine:
    share = float(label.mean())
    n1, n0 = label.sum(), (1 - label).sum()
    rng = np.random.Generator(np.random.PCG64(11))
    linear, factors = np.zeros(BUCKETS, np.float64), np.zeros((BUCKETS, FACTORS))
    used = np.unique(index)
    factors[used] = rng.normal(0, 0.01, (len(used), FACTORS))
    machine = Machine(float(np.log(share / (1 - share))), linear, factors)
    g_bias, g_linear, g_factors = 1.0, np.full(BUCKETS, 1.0), np.full((BUCKETS, FACTORS), 1.0)
    size = np.diff(bounds)
    weight = np.where(label == 1, min(4.0, max(1.0, float(np.sqrt(n0 / n1)))), 1.0)  # the rarer class counts more, within bounds
    for _ in range(EPOCHS):
        order = rng.permutation(len(label))
        for a in range(0, len(order), BATCH):
            rows = order[a : a + BATCH]
            rows = rows[size[rows] > 0]
            if not len(rows):
                continue
            n = size[rows]
            b = np.concatenate([[0], np.cumsum(n)])
            own = index[np.repeat(bounds[rows] - b[:-1], n) + np.arange(b[-1])]
            v = factors[own]
            total = np.add.reduceat(v, b[:-1], axis=0)
            raw = machine.bias + np.add.reduceat(linear[own], b[:-1]) + 0.5 * (total * total - np.add.reduceat(v * v, b[:-1], axis=0)).sum(1)
            error = (1.0 / (1.0 + np.exp(-np.clip(raw, -35, 35))) - label[rows]) * weight[rows]
            g_bias += error.sum() ** 2
            machine.bias -= RATE * error.sum() / np.sqrt(g_bias)
            spread = np.repeat(error, n)
            each, back = np.unique(own, return_inverse=True)
            d = np.bincount(back, weights=spread) + L2 * len(rows) * linear[each]
            g_linear[each] += d * d
            linear[each] -= RATE * d / np.sqrt(g_linear[each])
            dv = spread[:, None] * (np.repeat(total, n, axis=0) - v)
            for f in range(FACTORS):
                d = np.bincount(back, weights=dv[:, f]) + FACTOR_L2 * len(rows) * factors[each, f]
                g_factors[each, f] += d * d
                factors[each, f] -= RATE * d / np.sqrt(g_factors[each, f])
    return Machine(machine.bias, linear.astype(np.float32), factors.astype(np.float32))


def _held_out(id_col: str) -> F.Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit_toxicity(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> bytes:
    """The dumped machine, fitted on the labelled rows that are not held out (a bounded sample of each class)."""
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).where("doc_id is not null and label in (0, 1)")
    known = known.where(~_held_out("doc_id")).groupBy("doc_id").agg(F.max("label").alias("label"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    known = known.where("label = 1").orderBy(*order).limit(SAMPLE).unionAll(known.where("label = 0").orderBy(*order).limit(SAMPLE))
    known = written_side(known.select(F.col("doc_id").alias("known_id"), "label"), "labelled", 4 * SAMPLE)  # 2 * SAMPLE rows at most
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.join(known, rows["doc_id"] == known["known_id"]).select("doc_id", "label", "text")

    def featurize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _text.chunks(batch, "text"):
                index, bounds = terms(part.column("text"))
                found = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(index.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("label"), found], ["doc_id", "label", "terms"])

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        label, index, size = [], [], []
        for batch in batches:  # of bounded rows
            label.append(np.asarray(batch.column("label")))
            size.append(np.diff(np.asarray(batch.column("terms").offsets)))
            index.append(np.asarray(batch.column("terms").flatten()))

        def whole(parts: list[np.ndarray], kind) -> np.ndarray:
            out = np.concatenate(parts).astype(kind, copy=False) if parts else np.zeros(0, kind)
            parts.clear()  # the sample is held once
            return out

        bounds = np.concatenate([[0], np.cumsum(whole(size, np.int64))]).astype(np.int64)
        machine = fit(whole(index, np.int32), bounds, whole(label, float))
        yield pa.RecordBatch.from_arrays([pa.array([machine.dump()], pa.binary())], ["machine"])

    sample = materialize(rows.mapInArrow(featurize, "doc_id long, label int, terms array<int>"), "labelled-terms")
    one = sample.repartition(1).sortWithinPartitions("doc_id", "label").select("label", "terms")  # 2 * SAMPLE rows at most
    fitted = one.mapInArrow(train, "machine binary").first()
    if fitted is None:  # no labelled rows, no task
        return fit(np.zeros(0, np.int32), np.zeros(1, np.int64), np.zeros(0)).dump()
    return bytes(fitted["machine"])


def score_toxicity(spark: SparkSession, docs: DataFrame, machine: bytes, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    shared = spark.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = Machine.load(shared.value)
        keep = (fitted.linear != 0) | (fitted.factors != 0).any(axis=1)
        for batch in batches:
            for part in _text.chunks(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fitted.scores(*terms(part.column("text"), keep)))], ["doc_id", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    scored = rows.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", _held_out("doc_id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def without_toxic(spark: SparkSession, docs: DataFrame, machine: bytes, *, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, whose score is below ``threshold``; scored and filtered in one pass."""
    shared = spark.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = Machine.load(shared.value)
        keep = (fitted.linear != 0) | (fitted.factors != 0).any(axis=1)
        for batch in batches:
            for part in _text.chunks(batch, text_col):
                yield part.filter(pa.array(fitted.scores(*terms(part.column(text_col), keep)) < threshold))

    return docs.mapInArrow(run, docs.schema)
