"""Document fingerprints: threshold-scaled sketches (operator 7).

A text's shingles are its windows of ``SHINGLE`` code points (a shorter,
non-empty text is one shingle).  The sketch keeps every 64-bit shingle hash
below a fixed fraction of the hash range, so its size follows the document's,
sketches of parts merge by union, and both Jaccard similarity and containment
between very unequal documents are estimated from the retained hashes alone.  A
non-empty text of which no hash falls below the threshold keeps its smallest
one, so that short texts can be told apart.

A fingerprint is written as ``f<SCALE>:`` and the retained hashes, sorted, as 16
hexadecimal digits each.

Defined cases: a null or empty text has the fingerprint ``f<SCALE>:`` alone; two
such fingerprints are alike (1), one such and another are not (0).  A null id
takes no part in the order of documents and has no next document (near_next
null, the edited text is the first half); the next of a single document is
itself.  Rows that share an id are
ordered by text.  Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugeframe.llm import _text
from gaugeframe.sources.scratch import materialize

SHINGLE = 16
SCALE = 16
_LIMIT = np.uint64((1 << 64) // SCALE)
HEAD = f"f{SCALE}:"
#: Documents in one stretch of the id order, about; quantiles of the id that bound spans of stretches, and stretches, at most.
STRETCH = 20_000
SPANS, STRETCHES = 256, 65_536


def sketch(texts: list[str]) -> list[np.ndarray]:
    """Sorted retained hashes of each text."""
    code = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    length = np.array([len(t) for t in texts], np.int64)
    edge = np.concatenate([[0], np.cumsum(length)])
    up, down = _text.powers(len(code) + 1)
    total = np.zeros(len(code) + 1, np.uint64)
    np.cumsum(_text.mix(code.astype(np.uint64) + np.uint64(1)) * up[: len(code)], out=total[1:])
    at = np.arange(max(len(code) - SHINGLE + 1, 0))
    value = _text.mix((total[SHINGLE:] - total[: len(at)]) * down[: len(at)])
    low = np.flatnonzero(value < _LIMIT)
    low_doc = np.searchsorted(edge, low, side="right") - 1
    inside = low + SHINGLE <= edge[low_doc + 1]
    low, low_doc = low[inside], low_doc[inside]
    first = np.searchsorted(low_doc, np.arange(len(texts) + 1))
    out = []
    for i, n in enumerate(length.tolist()):
        found = np.unique(value[low[first[i] : first[i + 1]]])
        if not len(found) and n:
            a = edge[i]
            own = value[a : a + n - SHINGLE + 1] if n >= SHINGLE else _text.mix((total[edge[i + 1] :][:1] - total[a : a + 1]) * down[a] + np.uint64(n))
            found = own.min(keepdims=True)
        out.append(found)
    return out


def spell(found: np.ndarray) -> str:
    return HEAD + found.astype(">u8").tobytes().hex()


def read(fingerprint: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(fingerprint[len(HEAD) :]), ">u8").astype(np.uint64)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated Jaccard similarity of the two documents' shingle sets."""
    if not len(a) and not len(b):
        return 1.0
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / (len(a) + len(b) - common)


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated share of the first document's shingles that the second has (an empty first: 1)."""
    return len(np.intersect1d(a, b, assume_unique=True)) / len(a) if len(a) else 1.0


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The fingerprint of the union of the two shingle sets."""
    both = np.union1d(a, b)
    low = both[both < _LIMIT]
    return low if len(low) else both[:1]


def fingerprint_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fingerprint of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _text.chunks(batch, "text"):
                texts = [t or "" for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([spell(s) for s in sketch(texts)], pa.string())], ["doc_id", "fingerprint"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, fingerprint string")


def with_next_document(docs: DataFrame) -> DataFrame:
    """Rows of doc_id and text in stretches of ascending doc_id, each stretch closed by the first document of the next.

    Adds ``stretch`` and ``guest`` (true for the closing row).  The stretches
    lie between quantiles of doc_id (each span between two of at most SPANS
    quantiles is cut into equal parts), so the text is dealt out once and no
    window spans the table; only one row for each stretch is ordered as a whole.
    """
    rows = docs.where("doc_id is not null")
    n, low, high = rows.agg(F.count("*"), F.min("doc_id"), F.max("doc_id")).first()
    wanted = max(1, -(-n // STRETCH), min(docs.sparkSession.sparkContext.defaultParallelism, n // 500))
    spans = min(wanted, SPANS)
    each = -(-min(wanted, STRETCHES) // spans)  # equal parts of the id range of each span
    bounds = rows.agg(F.percentile_approx("doc_id", [i / spans for i in range(1, spans)], 10 * spans)).first()[0] if spans > 1 else []
    bounds = sorted(set(bounds or []))
    edges = F.array(*(F.lit(b).cast("long") for b in bounds)) if bounds else F.array().cast("array<long>")
    k = (len(bounds) + 1) * each

    def stretch(c):
        span = F.size(F.filter(edges, lambda e: e < c))
        if each == 1:
            return span
        first = F.element_at(F.array(*(F.lit(b).cast("double") for b in [low, *bounds])), span + 1)
        last = F.element_at(F.array(*(F.lit(b).cast("double") for b in [*bounds, high])), span + 1)
        part = F.floor((c - first) / (last - first + 1) * each)
        return (span * each + F.least(F.greatest(part, F.lit(0)), F.lit(each - 1))).cast("int")

    rows = rows.withColumn("stretch", stretch(F.col("doc_id")))
    firsts = rows.groupBy("stretch").agg(F.min("doc_id").alias("first"))
    order = Window.orderBy("stretch")
    firsts = firsts.select("first", F.lag("stretch").over(order).alias("before"), F.max("stretch").over(Window.partitionBy(F.lit(1))).alias("last"))
    firsts = materialize(firsts.select("first", F.coalesce("before", "last").alias("host")), "stretches")
    rows = rows.join(F.broadcast(firsts), rows["doc_id"] == firsts["first"], "left")  # one row for each stretch
    own = F.struct(F.col("stretch").alias("stretch"), F.lit(False).alias("guest"))
    guest = F.struct(F.col("host").alias("stretch"), F.lit(True).alias("guest"))
    rows = rows.select("doc_id", "text", F.explode(F.when(F.col("host").isNull(), F.array(own)).otherwise(F.array(own, guest))).alias("s"))
    dealt = rows.select("doc_id", "text", "s.stretch", "s.guest").repartitionById(k, F.col("stretch"))
    return dealt.sortWithinPartitions("stretch", "guest", "doc_id", "text")


def fingerprints_with_edits(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, whose last floor(n/2) code points give way to the next document's first.

    Columns: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, kept_in_edited (containment of the
    text in its edited text).
    """
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "kept_in_edited"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []  # rows not yet given out: the last one waits for its next document

        def give(rows: list, last: bool) -> Iterator[pa.RecordBatch]:
            texts = [r[1] for r in rows]
            prints = sketch(texts)
            use = [i for i, r in enumerate(rows[:-1] if not last else rows) if not r[3]]
            nxt = {i: i + 1 if i + 1 < len(rows) and rows[i + 1][2] == rows[i][2] else i for i in use}
            edited = [texts[i][: len(texts[i]) - len(texts[i]) // 2] + texts[nxt[i]][: len(texts[i]) // 2] for i in use]
            changed = sketch(edited)
            out = []
            for i, e, c in zip(use, edited, changed, strict=True):
                out.append((rows[i][0], len(texts[i]), hashlib.sha256(e.encode()).hexdigest(), spell(prints[i]), spell(c), likeness(prints[i], c), likeness(prints[i], prints[nxt[i]]), containment(prints[i], c)))
            yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*out, strict=True)), strict=True)) if out else {n: [] for n in names}, schema=schema)

        schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), *((n, pa.string()) for n in names[2:5]), *((n, pa.float64()) for n in names[5:])])
        for batch in batches:
            for part in _text.chunks(batch, "text"):
                d = part.to_pydict()
                fresh = [(i, t or "", s, g) for i, t, s, g in zip(d["doc_id"], d["text"], d["stretch"], d["guest"], strict=True)]
                rows = held + fresh
                yield from give(rows, False)
                held = [rows[-1]]
        if held:
            yield from give(held, True)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kinds = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, kept_in_edited double"
    found = with_next_document(rows).mapInArrow(run, kinds)

    def lone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _text.chunks(batch, "text"):
                texts = [t or "" for t in part.column("text").to_pylist()]
                halves = [t[: len(t) - len(t) // 2] for t in texts]
                both = list(zip(sketch(texts), sketch(halves), strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.nulls(len(texts), pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(h.encode()).hexdigest() for h in halves]),
                     pa.array([spell(a) for a, _ in both], pa.string()), pa.array([spell(b) for _, b in both], pa.string()), pa.array([likeness(a, b) for a, b in both], pa.float64()),
                     pa.nulls(len(texts), pa.float64()), pa.array([containment(a, b) for a, b in both], pa.float64())],
                    names,
                )

    return found.unionByName(rows.where("doc_id is null").mapInArrow(lone, kinds))
