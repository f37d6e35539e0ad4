"""Exact SentencePiece BPE encoding and decoding by vectorised merge rounds (operator 3).

A text is normalised (a space becomes U+2581, one is put in front) and cut where
no piece of the vocabulary can reach across.  The distinct words of a slice of
an Arrow batch become one flat array of symbols.  Each round finds the best
(smallest) rank of a mergeable pair in every word by a segmented minimum, merges
all its leftmost, non-overlapping occurrences at once and compacts the array;
words without a pair leave.  Occurrences beyond the first are held back when
the merged piece could start a pair that ranks before it (``unsafe``), so the
order of merges is the library's.  A word of more than ``LONG_WORD`` symbols
takes the same merges from a priority queue, which bounds the rounds.

Symbols outside the vocabulary become their UTF-8 byte pieces.  The vocabulary
is read from a model file on the driver and travels to the tasks in a broadcast
(its size is the vocabulary's, not the data's).

Defined cases: a null or empty text has no ids and decodes to the empty text;
any code point is encoded; repeated rows give repeated results; extra columns
are ignored; an empty table gives an empty result.  One slice holds at most 256 KiB of text or one longer
text; a worker remembers words of bounded length and number.
"""

from __future__ import annotations

import heapq
import re
import uuid
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeframe.llm import _text

SPACE = "\u2581"
LONG_WORD = 192
#: A worker remembers the ids of words of at most ``CACHE_WORD`` characters, and so many of them.
CACHE_WORD, CACHE_WORDS = 48, 150_000
NO_RANK = np.iinfo(np.int32).max


class Vocabulary:
    """Pieces, pair ranks and byte pieces of a SentencePiece BPE model, as arrays."""

    def __init__(self, model_file: str):
        import sentencepiece

        self.name = uuid.uuid4().hex
        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = self.size = sp.get_piece_size()
        kinds = ["control" if sp.is_control(i) else "unknown" if sp.is_unknown(i) else "byte" if sp.is_byte(i) else "normal" for i in range(n)]
        pieces = [sp.id_to_piece(i) for i in range(n)]
        self.byte_id = np.zeros(256, np.int32)
        for i in range(n):
            if kinds[i] == "byte":
                self.byte_id[int(pieces[i][1:-1], 16)] = i
        normal = {pieces[i]: i for i in range(n) if kinds[i] == "normal"}
        scores = sorted({sp.get_score(i) for i in normal.values()}, reverse=True)
        level = {s: r for r, s in enumerate(scores)}
        rank = {p: level[sp.get_score(i)] for p, i in normal.items()}

        symbol = dict(normal)
        for p in normal:
            for c in p:
                symbol.setdefault(c, len(symbol) + n)
        self.other = max(symbol.values()) + 1  # any other code point
        self.of_code = np.full(0x110000, self.other, np.int32)
        for s, i in symbol.items():
            if len(s) == 1:
                self.of_code[ord(s)] = i
        pairs, unsafe = {}, set()
        for p, i in normal.items():
            for k in range(1, len(p)):
                left, right = symbol.get(p[:k]), symbol.get(p[k:])
                if left is not None and right is not None:
                    pairs[left * (self.other + 1) + right] = (rank[p], i)
                    unsafe.update(x for x in (left, right) if x < n and rank[pieces[x]] >= rank[p])
        self.key = np.array(sorted(pairs), np.int64)
        self.rank = np.array([pairs[k][0] for k in self.key.tolist()], np.int32)
        self.merged = np.array([pairs[k][1] for k in self.key.tolist()], np.int32)
        self._index()
        self.unsafe = np.zeros(n, bool)
        self.unsafe[sorted(unsafe)] = True
        inner = {c for p in normal for c in p}
        if any(SPACE in p.lstrip(SPACE) for p in normal):
            self.cut = r"(?s).+"
        elif "\n" in inner:
            self.cut = f"{SPACE}*[^{SPACE}]+|{SPACE}+"
        else:
            self.cut = f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n"
        text = [p.replace(SPACE, " ").encode() for p in pieces]
        self.bytes = [{"control": b"", "unknown": " \u2047 ".encode()}.get(kinds[i], bytes([int(pieces[i][1:-1], 16)]) if kinds[i] == "byte" else text[i]) for i in range(n)]
        self.is_byte = np.array([k == "byte" for k in kinds])
        self.is_control = np.array([k == "control" for k in kinds])

    def _index(self) -> None:
        """Hash levels over the pair keys: each level has one slot a hash, and what collides moves to the next, smaller one."""
        self.levels, rest, bits = [], np.arange(len(self.key)), 18
        while len(rest):
            slot = self._slot(self.key[rest], bits)
            first = np.unique(slot, return_index=True)[1]
            keys, rows = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32)
            keys[slot[first]], rows[slot[first]] = self.key[rest[first]], rest[first]
            self.levels.append((bits, keys, rows))
            rest, bits = np.delete(rest, first), max(bits - 2, 10)

    @staticmethod
    def _slot(keys: np.ndarray, bits: int) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).view(np.int64)

    def lookup(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (``NO_RANK`` if none) and merged piece of each pair."""
        want = left.astype(np.int64) * (self.other + 1) + right
        row = np.full(len(want), -1, np.int32)
        for bits, keys, rows in self.levels:
            slot = self._slot(want, bits)
            np.copyto(row, rows[slot], where=keys[slot] == want)
        ok = row >= 0
        return np.where(ok, self.rank[row], NO_RANK), np.where(ok, self.merged[row], -1)

    def merge_long(self, symbols: list[int]) -> np.ndarray:
        """Indices of surviving symbols and their ids after all merges of one long word, by a priority queue."""
        memo: dict[int, tuple[int, int] | None] = {}  # pairs that this word has met
        n, wide = len(symbols), self.other + 1
        before, after, alive = list(range(-1, n - 1)), [*range(1, n), -1], [True] * n
        heap: list = []

        def push(i):
            j = after[i]
            if j < 0:
                return
            pair = symbols[i] * wide + symbols[j]
            if pair not in memo:
                row = int(np.searchsorted(self.key, pair))
                memo[pair] = (int(self.rank[row]), int(self.merged[row])) if row < len(self.key) and self.key[row] == pair else None
            if found := memo[pair]:
                heapq.heappush(heap, (found[0], i, symbols[i], symbols[j], found[1]))

        for i in range(n - 1):
            push(i)
        while heap:
            _, i, left, right, new = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or symbols[i] != left or j < 0 or symbols[j] != right:
                continue
            symbols[i], alive[j], after[i] = new, False, after[j]
            if after[i] >= 0:
                before[after[i]] = i
            push(i)
            if before[i] >= 0:
                push(before[i])
        return np.flatnonzero(alive)

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of the words, flat, and their bounds."""
        code = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        length = np.array([len(w) for w in words], np.int64)
        symbol = self.of_code[code]
        word = np.repeat(np.arange(len(words)), length)
        done = []  # (word, symbol, code) of finished words
        edge = np.concatenate([[0], np.cumsum(length)])
        for w in np.flatnonzero(length > LONG_WORD):
            own = symbol[edge[w] : edge[w + 1]].tolist()
            left = self.merge_long(own)
            done.append((np.full(len(left), w), np.array(own, np.int32)[left], code[edge[w] : edge[w + 1]][left]))
        keep = np.repeat(length <= LONG_WORD, length)
        word, symbol, code = word[keep], symbol[keep], code[keep]
        rank, new = np.full(len(symbol), NO_RANK, np.int32), np.full(len(symbol), -1, np.int32)
        stale = np.arange(max(len(symbol) - 1, 0))
        while len(symbol):
            # only pairs next to a merge have changed since the last round
            stale = stale[(stale >= 0) & (stale < len(symbol) - 1)]
            rank[stale], new[stale] = self.lookup(symbol[stale], symbol[stale + 1])
            edge = np.flatnonzero(word[1:] != word[:-1]) + 1
            rank[edge - 1] = NO_RANK
            rank[-1] = NO_RANK
            start = np.concatenate([[0], edge])
            size = np.diff(np.append(start, len(word)))
            best = np.repeat(np.minimum.reduceat(rank, start), size)
            over = best == NO_RANK
            hit = np.flatnonzero((rank == best) & ~over)
            if len(hit):
                first = np.concatenate([[True], word[hit[1:]] != word[hit[:-1]]])
                hit = hit[first | ~self.unsafe[new[hit]]]
                run = np.maximum.accumulate(np.where(np.concatenate([[True], np.diff(hit) != 1]), np.arange(len(hit)), 0))
                hit = hit[(np.arange(len(hit)) - run) % 2 == 0]
                symbol[hit] = new[hit]
            stay = np.ones(len(symbol), bool)
            stay[hit + 1] = False
            if over.any():
                done.append((word[over], symbol[over], code[over]))
                stay &= ~over
            moved = np.cumsum(stay) - 1
            stale = moved[hit]
            stale = np.concatenate([stale, stale - 1])
            word, symbol, code, rank, new = word[stay], symbol[stay], code[stay], rank[stay], new[stay]
        if not done:
            return np.zeros(0, np.int32), np.zeros(len(words) + 1, np.int64)
        word, symbol, code = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(word, kind="stable")
        word, symbol, code = word[order], symbol[order], code[order].astype(np.int64)
        wide = np.where(symbol < self.size, 1, 1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF))
        ids = np.repeat(symbol, wide)
        to = np.cumsum(wide) - wide
        for n in (1, 2, 3, 4):
            rows = np.flatnonzero((symbol >= self.size) & (wide == n))
            for k in range(n):
                low = code[rows] >> (6 * (n - 1 - k))
                ids[to[rows] + k] = self.byte_id[low if n == 1 else (low | (0x80, 0xC0, 0xE0, 0xF0)[n - 1] if k == 0 else (low & 0x3F) | 0x80)]
        count = np.bincount(word, weights=wide, minlength=len(words)).astype(np.int64)
        return ids, np.concatenate([[0], np.cumsum(count)])


class Codec:
    """Encoder and decoder of one task; remembers the ids of at most ``CACHE_WORDS`` recent short words (and those of one slice more)."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.find = re.compile(vocabulary.cut).findall
        self.pieces = pa.array(vocabulary.bytes, pa.binary())
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.bounds = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all texts, flat, and their bounds."""
        if len(self.known) > CACHE_WORDS:
            self.forget()
        parts = [self.find(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        flat = list(chain.from_iterable(parts))
        new = set(flat).difference(self.known)
        rare = [w for w in new if len(w) > CACHE_WORD]
        short = [w for w in new if len(w) <= CACHE_WORD] if rare else list(new)
        known, n = self.known, len(self.known)
        all_ids, all_bounds = self.ids, self.bounds
        if new:
            ids, bounds = self.v.merge(short + rare)
            known.update(zip(short, range(n, n + len(short)), strict=True))
            all_bounds = np.concatenate([all_bounds, bounds[1:] + len(all_ids)])
            all_ids = np.concatenate([all_ids, ids])
            self.bounds = all_bounds[: n + len(short) + 1].copy()
            self.ids = all_ids[: self.bounds[-1]].copy()
        if rare:
            place = dict(zip(rare, range(n + len(short), n + len(new)), strict=True))
            index = np.fromiter((place[w] if w in place else known[w] for w in flat), np.int64, len(flat))
        else:
            index = np.fromiter(map(known.__getitem__, flat), np.int64, len(flat))
        size = all_bounds[index + 1] - all_bounds[index]
        end = np.cumsum(size)
        ids = all_ids[np.repeat(all_bounds[index] - (end - size), size) + np.arange(end[-1] if len(end) else 0)]
        at = np.concatenate([[0], end])[np.concatenate([[0], np.cumsum([len(p) for p in parts], dtype=np.int64)]).astype(np.int64)]
        return ids, at

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> list[str]:
        """The text of each run of ids, as the library decodes it."""
        spelled = self.pieces.take(pa.array(ids, pa.int32()))
        offset = np.frombuffer(spelled.buffers()[1], np.int32)[: len(ids) + 1] if len(ids) else np.zeros(1, np.int32)
        body = spelled.buffers()[2].to_pybytes() if len(ids) and spelled.buffers()[2] is not None else b""
        out = []
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            x = a
            while x < b and self.v.is_control[ids[x]]:
                x += 1
            raw = body[offset[a] : offset[b]]
            if x < b and not self.v.is_byte[ids[x]] and raw[:1] == b" " and ids[x] != 0:
                raw = raw[1:]
            try:
                out.append(raw.decode())
            except UnicodeDecodeError:
                out.append(_each_bad_byte(raw))
        return out


def _each_bad_byte(raw: bytes) -> str:
    """UTF-8 text with one U+FFFD for every byte that is not part of a valid code point."""
    out, i = [], 0
    while i < len(raw):
        for n in (1, 2, 3, 4):
            try:
                out.append(raw[i : i + n].decode())
                i += n
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("\ufffd")
            i += 1
    return "".join(out)


_CODECS: dict[str, Codec] = {}


def _codec(shared) -> Codec:
    """This Python worker's codec for a broadcast vocabulary; kept between tasks."""
    vocabulary = shared.value
    if vocabulary.name not in _CODECS:
        _CODECS.clear()
        _CODECS[vocabulary.name] = Codec(vocabulary)
    return _CODECS[vocabulary.name]


def encode_documents(spark: SparkSession, docs: DataFrame, model_file: str, *, id_col: str = "doc_id", text_col: str = "text", decode: bool = False) -> DataFrame:
    """doc_id and ids (array<int>, without begin or end) of every row; with ``decode`` also the text decoded from the ids."""
    shared = spark.sparkContext.broadcast(Vocabulary(model_file))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared)
        for batch in batches:
            for part in _text.chunks(batch, "text"):
                ids, bounds = codec.encode(part.column("text").to_pylist())
                columns = [part.column("doc_id"), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids, pa.int32()))]
                if decode:
                    columns.append(pa.array(codec.decode(ids, bounds), pa.string()))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "decoded"][: len(columns)])
        codec.forget()  # the worker is kept for other work, its words are not

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>" + (", decoded string" if decode else ""))


def decode_documents(spark: SparkSession, encoded: DataFrame, model_file: str, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and the text decoded from each row's ids (null ids: empty text)."""
    shared = spark.sparkContext.broadcast(Vocabulary(model_file))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                lists = [x or [] for x in part.column("ids").to_pylist()]
                bounds = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
                ids = np.array([i for x in lists for i in x], np.int32)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(codec.decode(ids, bounds), pa.string())], ["doc_id", "text"])

    rows = encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return rows.mapInArrow(run, "doc_id long, text string")
