"""Exact byte-level BPE encoding and decoding in linear time (operator 12).

A text is cut by the tokenizer's pattern and every match is encoded by itself.
A match that is a token as a whole is that token.  For any other, its bytes are
mapped to Latin-1, so that one character is one byte, and an Aho-Corasick
automaton of the vocabulary names the longest token at every byte.  The encoder
walks over these longest matches.  A token is accepted if it is compatible with
the one before it, that is if merging both their bytes by rank would give just
these two; else the next shorter token that starts there is tried, and when
none is left the step before is taken back and its end is marked as a dead end,
so no end is tried twice.  Adjacent compatible tokens are the result of the
merges, hence the ids are those of merging by rank, in time linear in the
match's length (Ahocorasick's matches apart, which the longest token bounds).
Compatibility is found by undoing merges from the largest rank down and is
remembered for each pair.

``Ranks`` refuses a vocabulary whose tokens are not made of tokens of lower
rank, since undoing merges by rank would be wrong for it, and leaves tokens
that merges never reach out of the automaton.

Defined cases: a null or empty text has no ids and decodes to no bytes; texts
are UTF-8, any code point is encoded; special tokens are ordinary text; repeated
rows give repeated results; extra columns are ignored; an empty table gives an
empty result.  A slice holds at most 256 KiB of text or one longer text; a worker remembers words
of bounded length and number.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeframe.llm import _text

#: A worker remembers the ids of matches of at most ``CACHE_WORD`` characters, so many of them, and so many pairs of tokens.
CACHE_WORD, CACHE_WORDS, CACHE_PAIRS = 48, 300_000, 1_000_000


class Ranks:
    """Token bytes of a rank file, the two parts that each token was merged from, and its longest proper prefix among the tokens."""

    def __init__(self, rank_file: str):
        self.name = uuid.uuid4().hex
        with open(rank_file, "rb") as lines:
            rank = {base64.b64decode(token): int(number) for token, number in (line.split() for line in lines if line.strip())}
        if sorted(rank.values()) != list(range(len(rank))) or any(bytes([b]) not in rank for b in range(256)):
            raise ValueError("ranks must run from 0 without gaps and hold all single bytes")
        self.tokens = sorted(rank, key=rank.__getitem__)
        self.left, self.right = list(range(len(rank))), list(range(len(rank)))
        self.shorter, self.reached = [-1] * len(rank), [True] * len(rank)
        for i, token in enumerate(self.tokens):
            if len(token) == 1:
                continue
            parts = _merge_apart(token, rank)
            self.reached[i] = len(parts) == 2
            if len(parts) == 2:
                self.left[i], self.right[i] = rank[parts[0]], rank[parts[1]]
                if max(self.left[i], self.right[i]) >= i:
                    raise ValueError(f"token {i} is made of tokens that rank after it")
        for i, token in enumerate(self.tokens):
            for n in range(len(token) - 1, 0, -1):
                j = rank.get(token[:n], -1)
                if j >= 0 and self.reached[j]:
                    self.shorter[i] = j
                    break


def _merge_apart(token: bytes, rank: dict[bytes, int]) -> list[bytes]:
    """The parts of a token just before its last merge."""
    parts = [token[i : i + 1] for i in range(len(token))]
    while len(parts) > 2:
        best, at = min((rank.get(a + b, len(rank)), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
        if best == len(rank):
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


class ByteCodec:
    """Encoder and decoder of one worker."""

    def __init__(self, ranks: Ranks, pattern: str):
        import ahocorasick
        import regex

        self.r, self.find = ranks, regex.compile(pattern).findall
        self.whole = {token: i for i, token in enumerate(ranks.tokens)}
        self.length = [len(token) for token in ranks.tokens]
        self.pieces = pa.array(ranks.tokens, pa.binary())
        self.automaton = ahocorasick.Automaton()
        for i, token in enumerate(ranks.tokens):
            if ranks.reached[i]:
                self.automaton.add_word(token.decode("latin-1"), i)
        self.automaton.make_automaton()
        self.pairs: dict[int, bool] = {}
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.bounds = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging the bytes of ``a`` and ``b`` gives these two tokens: no pair across their border merges before the parts it needs are used up."""
        key = a * len(self.length) + b
        if key not in self.pairs:
            if len(self.pairs) >= CACHE_PAIRS:
                self.pairs.clear()
            self.pairs[key] = self._apart(a, b)
        return self.pairs[key]

    def _apart(self, a: int, b: int) -> bool:
        tokens, left, right, whole = self.r.tokens, self.r.left, self.r.right, self.whole
        # Going back in time: a merge across the border at rank r happens if both its parts are there at that time and none of them was merged before r.
        used = len(tokens)
        while True:
            joined = whole.get(tokens[a] + tokens[b])
            if joined is not None and joined < used and self.r.left[joined] == a and self.r.right[joined] == b:
                return False
            inner_a, inner_b = len(tokens[a]) > 1, len(tokens[b]) > 1
            if not inner_a and not inner_b:
                return True
            # undo the later merge; of one rank on both sides the right one came later
            if inner_a and (a > b or not inner_b):
                used, a = a, right[a]
            else:
                used, b = b + 1, left[b]

    def encode_word(self, raw: bytes) -> list[int]:
        """Ids of one match of the pattern."""
        if raw in self.whole:
            return [self.whole[raw]]
        n, length, shorter, compatible = len(raw), self.length, self.r.shorter, self.compatible
        longest = [0] * n
        for end, i in self.automaton.iter(raw.decode("latin-1")):  # ends ascend, so the longest match at a start comes last
            longest[end - length[i] + 1] = i
        dead = bytearray(n + 1)
        pairs, wide = self.pairs, len(length)
        out: list[int] = []
        at, token = 0, longest[0]
        while at < n:
            last = out[-1] * wide if out else -1
            while token >= 0:
                if not dead[at + length[token]]:
                    if last < 0 or (fits := pairs.get(last + token)) or fits is None and compatible(out[-1], token):
                        break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at += length[token]
                token = longest[at] if at < n else -1
            else:
                dead[at] = 1
                token = out.pop()
                at -= length[token]
        return out

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all texts, flat, and their bounds."""
        if len(self.known) > CACHE_WORDS:
            self.forget()
        parts = [self.find(t) if t else [] for t in texts]
        flat = list(chain.from_iterable(parts))
        new = sorted(set(flat).difference(self.known), key=len)  # short ones first: these are remembered
        known, n = self.known, len(self.known)
        fresh = [self.encode_word(w.encode()) for w in new]
        bounds = np.concatenate([self.bounds, self.bounds[-1] + np.cumsum(np.fromiter(map(len, fresh), np.int64, len(fresh)))])
        ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(fresh), np.int32, int(bounds[-1] - self.bounds[-1]))])
        known.update(zip(new, range(n, n + len(new)), strict=True))
        index = np.fromiter(map(known.__getitem__, flat), np.int64, len(flat))
        size = bounds[index + 1] - bounds[index]
        end = np.concatenate([[0], np.cumsum(size)])
        out = ids[np.repeat(bounds[index] - end[:-1], size) + np.arange(end[-1])]
        at = end[np.concatenate([[0], np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))]).astype(np.int64)]
        keep = len(new)
        while keep and len(new[keep - 1]) > CACHE_WORD:
            keep -= 1
            del known[new[keep]]
        self.bounds = bounds[: n + keep + 1]
        self.ids = ids[: self.bounds[-1]]
        return out, at

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
        """The bytes of each run of ids."""
        spelled = self.pieces.take(pa.array(ids, pa.int32()))
        if not len(ids):
            return pa.array([b""] * (len(bounds) - 1), pa.binary())
        offset = np.frombuffer(spelled.buffers()[1], np.int32)[: len(ids) + 1]
        return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(offset[bounds].copy()), spelled.buffers()[2]])


_CODECS: dict[str, ByteCodec] = {}


def _codec(shared, pattern: str) -> ByteCodec:
    """This Python worker's codec for a broadcast vocabulary; kept between tasks."""
    ranks = shared.value
    if (key := ranks.name + pattern) not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = ByteCodec(ranks, pattern)
    return _CODECS[key]


def encode_bytes(spark: SparkSession, docs: DataFrame, rank_file: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text", decode: bool = False) -> DataFrame:
    """doc_id, ids (array<int>) and packed (the ids as little-endian unsigned 32-bit integers, as token files hold them) of every row; with ``decode`` also the bytes decoded from the ids."""
    shared = spark.sparkContext.broadcast(Ranks(rank_file))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared, pattern)
        for batch in batches:
            for part in _text.chunks(batch, "text"):
                ids, bounds = codec.encode(part.column("text").to_pylist())
                packed = pa.Array.from_buffers(pa.binary(), part.num_rows, [None, pa.py_buffer((bounds * 4).astype(np.int32)), pa.py_buffer(ids.astype("<u4"))])
                columns = [part.column("doc_id"), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids, pa.int32())), packed]
                if decode:
                    columns.append(codec.decode(ids, bounds))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "packed", "decoded"][: len(columns)])
        codec.forget()  # the worker is kept for other work, its words are not

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>, packed binary" + (", decoded binary" if decode else ""))


def decode_bytes(spark: SparkSession, encoded: DataFrame, rank_file: str, pattern: str, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and the bytes decoded from each row's ids (null ids: no bytes); an id outside the vocabulary is an error."""
    shared = spark.sparkContext.broadcast(Ranks(rank_file))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                lists = [x or [] for x in part.column("ids").to_pylist()]
                bounds = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), codec.decode(np.array(list(chain.from_iterable(lists)), np.int32), bounds)], ["doc_id", "decoded"])

    rows = encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return rows.mapInArrow(run, "doc_id long, decoded binary")
