r"""Chat formatting with a prefix tree over shared turns (operator 6).

Each turn is written as ``<|im_start|>role\\ntext<|im_end|>\\n``.  Inside roles and
texts every run of backslashes (none, too) between ``<`` and ``|`` grows by one,
so no text can hold a control string and the escape is undone exactly; in roles
backslashes and line feeds are escaped first.

Conversations that share their first turns form a prefix tree.  The trees are
emitted depth first in packs: a pack holds each distinct turn of its
conversations once, in depth-first order, with

* ``start, length``: the turn's place in the pack's string (tokens are code
  points; a tokenizer can be applied to each segment),
* ``position``: the position id of its first token, that is the tokens of its
  ancestors, so positions run on along every path,
* ``parent``: the segment it continues; the attention intervals of a segment
  are the places of its ancestors and its own,
* ``loss_start, loss_length``: the part under the loss mask (an assistant's text).

Conversations are dealt by range over the hashes of their paths, so one task
streams neighbouring paths with a stack of the current path and closes a pack
beyond ``PACK_CHARS``; the next pack repeats the ancestors it needs.  A tree of
any size, such as a third of all conversations behind one first turn, is thus
spread over many packs and tasks.

Defined cases: null texts and null roles are empty; turns are ordered by turn,
then role, then text (null turn first); rows repeated in full are turns of
their own; a null conv_id takes no part; extra columns are ignored; an empty table
gives no packs.
"""

from __future__ import annotations

import re
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
PACK_CHARS = 1 << 20
LOSS_ROLE = "assistant"

_ESCAPE, _UNESCAPE = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: f"<{m[1]}\\|", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(lambda m: f"<{m[1]}|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The turn's string and the place of its text within it."""
    head = f"{START}{escape_role(role)}\n"
    body = escape(text)
    return f"{head}{body}{END}\n", len(head), len(body)


_TURN = re.compile(re.escape(START) + r"([^\n]*)\n(.*?)" + re.escape(END) + "\n", re.S)


def parse_turns(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted conversation."""
    out, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError("not a formatted conversation")
        out.append((unescape_role(m[1]), unescape(m[2])))
        at = m.end()
    return out


PACK = "text string, start array<int>, length array<int>, position array<int>, parent array<int>, loss_start array<int>, loss_length array<int>, conv_id array<bigint>, leaf array<int>"


def conversations_by_path(turns: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, turns (array of role and text, in order) and path: 16 hexadecimal digits for each turn, hashed with all before it."""
    rows = turns.select(
        F.col(id_col).cast("long").alias("conv_id"),
        F.struct(
            F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
        ).alias("t"),
    ).where("conv_id is not null")
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    whole = whole.select("conv_id", F.transform("turns", lambda t: F.struct(t["role"], t["text"])).alias("turns"))

    def chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part, paths = batch.slice(at, 256), []
                for turns in part.column("turns").to_pylist():
                    seen, path = hashlib.blake2b(digest_size=8), []
                    for t in turns:
                        role, text = t["role"].encode(), t["text"].encode()
                        seen.update(b"%d:%d:" % (len(role), len(text)) + role + text)
                        path.append(seen.hexdigest())
                    paths.append("".join(path))
                yield part.append_column("path", pa.array(paths, pa.string()))

    return whole.mapInArrow(chained, "conv_id long, turns array<struct<role: string, text: string>>, path string")


def pack_conversations(turns: DataFrame, *, pack_chars: int = PACK_CHARS, **columns: str) -> DataFrame:
    """Packs (see ``PACK``) of all conversations of a table of turns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = {"start": [], "length": [], "position": [], "parent": [], "loss_start": [], "loss_length": [], "conv_id": [], "leaf": []}
        text: list[str] = []
        size, stack = 0, []  # stack: (turn, segment, end position) of the current path

        def close():
            kinds = {k: pa.list_(pa.int64() if k == "conv_id" else pa.int32()) for k in fields}
            out = pa.RecordBatch.from_arrays([pa.array(["".join(text)], pa.string()), *(pa.array([v], kinds[k]) for k, v in fields.items())], ["text", *fields])
            text.clear()
            for v in fields.values():
                v.clear()
            return out

        for batch in batches:
            for i in range(batch.num_rows):
                conv, path = batch.column("conv_id")[i].as_py(), batch.column("turns")[i].as_py()
                path = [(t["role"], t["text"]) for t in path]
                if size > pack_chars:
                    yield close()
                    size, stack = 0, []
                same = 0
                while same < min(len(stack), len(path)) and stack[same][0] == path[same]:
                    same += 1
                del stack[same:]
                for turn in path[same:]:
                    string, at, length = format_turn(*turn)
                    position = stack[-1][2] if stack else 0
                    fields["parent"].append(stack[-1][1] if stack else -1)
                    fields["start"].append(size)
                    fields["length"].append(len(string))
                    fields["position"].append(position)
                    fields["loss_start"].append(size + at)
                    fields["loss_length"].append(length if turn[0] == LOSS_ROLE else 0)
                    stack.append((turn, len(fields["start"]) - 1, position + len(string)))
                    text.append(string)
                    size += len(string)
                fields["conv_id"].append(conv)
                fields["leaf"].append(stack[-1][1] if stack else -1)
        if fields["conv_id"]:
            yield close()

    dealt = conversations_by_path(turns, **columns)
    dealt = dealt.repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id")
    return dealt.select("conv_id", "turns").mapInArrow(run, PACK)


def attention_intervals(parent: list[int], start: list[int], length: list[int], segment: int) -> list[tuple[int, int]]:
    """Places (start, end) in the pack that the tokens of ``segment`` attend to: its ancestors, outermost first, and itself."""
    out = []
    while segment >= 0:
        out.append((start[segment], start[segment] + length[segment]))
        segment = parent[segment]
    return out[::-1]


def position_ids(start: list[int], length: list[int], position: list[int]) -> list[int]:
    """The position id of every token of a pack."""
    return [p + k for _, n, p in zip(start, length, position, strict=True) for k in range(n)]


def read_packs(packs: DataFrame) -> DataFrame:
    """Each conversation read back along its attention intervals: conv_id, formatted, roles, texts, loss (the texts under the mask)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                out: list[tuple] = []
                for conv, leaf in zip(row["conv_id"], row["leaf"], strict=True):
                    spans = attention_intervals(row["parent"], row["start"], row["length"], leaf)
                    chain, loss = leaf, []
                    while chain >= 0:
                        a, n = row["loss_start"][chain], row["loss_length"][chain]
                        loss.append(unescape(row["text"][a : a + n]))
                        chain = row["parent"][chain]
                    formatted = "".join(row["text"][a:b] for a, b in spans)
                    turns = parse_turns(formatted)
                    out.append((conv, formatted, [r for r, _ in turns], [t for _, t in turns], "".join(loss[::-1])))
                    if len(out) == 64:
                        yield pa.RecordBatch.from_pydict(dict(zip(schema.names, map(list, zip(*out, strict=True)), strict=True)), schema=schema)
                        out = []
                if out:
                    yield pa.RecordBatch.from_pydict(dict(zip(schema.names, map(list, zip(*out, strict=True)), strict=True)), schema=schema)

    texts = pa.list_(pa.string())
    schema = pa.schema([("conv_id", pa.int64()), ("formatted", pa.string()), ("roles", texts), ("texts", texts), ("loss", pa.string())])
    return packs.mapInArrow(run, "conv_id long, formatted string, roles array<string>, texts array<string>, loss string")
