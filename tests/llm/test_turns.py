"""Byte-level BPE against the library, the prefix trie and the repair of conversations against brute force."""

import base64
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from gaugeframe.llm import byte_bpe, queries, repair, trie

RANKS = ["byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.tiktoken"]
WORD = re.compile(r"[^\x20\x09-\x0D]+")
TURN = "conv_id long, turn long, role string, text string"


def library(name):
    with open(public_tokenizers.path(name), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def bpe_texts(n=600):
    r = random.Random(4)
    odd = ["a", "b", "e", " ", "  ", "\n", "é", "=", "-", ".", "1", "the", "\x00", "中", "😀", "\\", "ing", "tion", "A", '"', "\t", "\r", "́", "﷽", "'s", "'ll", " ", "ſ", "<|endoftext|>"]
    out = ["".join(r.choice(odd) for _ in range(r.choice([0, 1, 3, 10, 60, 400]))) for _ in range(n)]
    out += ["".join(r.choice(k) for _ in range(r.choice([20, 200]))) for _ in range(n // 3) for k in ["ab", "aeinorst", "abcdefghijklmnopqrstuvwxyz"]]
    out += ["".join(chr(r.choice([r.randrange(97, 123), r.randrange(0x370, 0x600), r.randrange(0x4E00, 0x9FFF), r.randrange(0x1F300, 0x1F900)])) for _ in range(80)) for _ in range(n // 3)]
    return [*out, "a" * 3000, " " * 5000, "\n" * 3000, "ab" * 3000, "=" * 4000, "banana" * 800, "etaoin" * 900, "aaab" * 1000, "😀" * 500, "x" * 47 + " " + "x" * 49]


@pytest.mark.parametrize("name", RANKS)
def test_byte_ids_are_the_library_s(spark, name):
    texts = [None, *bpe_texts()]
    want = [library(name).encode_ordinary(t or "") for t in texts]
    df = spark.createDataFrame([*enumerate(texts), (3, texts[3])], "doc_id long, text string").withColumn("ids", F.lit("clash")).withColumn("decoded", F.lit(1))
    coded = byte_bpe.encode_bytes(spark, df, public_tokenizers.path(name), public_tokenizers.PATTERN, decode=True)
    back = {r.doc_id: bytes(r.decoded) for r in byte_bpe.decode_bytes(spark, coded, public_tokenizers.path(name), public_tokenizers.PATTERN).collect()}
    got = coded.collect()
    assert len(got) == len(texts) + 1
    for r in got:
        assert r.ids == want[r.doc_id] and bytes(r.packed) == np.array(r.ids, "<u4").tobytes()
        assert bytes(r.decoded) == back[r.doc_id] == (texts[r.doc_id] or "").encode()
    assert byte_bpe.encode_bytes(spark, df.limit(0), public_tokenizers.path(name), public_tokenizers.PATTERN).count() == 0


def test_byte_words_are_bounded():
    codec = byte_bpe.ByteCodec(byte_bpe.Ranks(public_tokenizers.path(RANKS[0])), public_tokenizers.PATTERN)
    texts, enc = bpe_texts(60), library(RANKS[0])
    for _ in range(2):
        ids, bounds = codec.encode(texts)
        assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])] == [enc.encode_ordinary(t) for t in texts]
        assert max(map(len, codec.known)) <= byte_bpe.CACHE_WORD and len(codec.bounds) == len(codec.known) + 1
    ids, bounds = codec.encode([])
    assert len(ids) == 0 and bounds.tolist() == [0]


def test_every_long_word_in_linear_time():
    codec = byte_bpe.ByteCodec(byte_bpe.Ranks(public_tokenizers.path(RANKS[0])), public_tokenizers.PATTERN)
    assert sum(len(codec.r.tokens[i]) for i in codec.encode_word(b"aab" * 100_000)) == 300_000


def test_unordered_vocabularies_are_refused(tmp_path):
    singles = [bytes([b]) for b in range(256)]

    def write(tokens):
        (tmp_path / "r").write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % i for i, t in enumerate(tokens)))
        return byte_bpe.Ranks(str(tmp_path / "r"))

    with pytest.raises(ValueError):
        write([*singles, b"abc", b"ab"])  # made of a token that ranks after it
    with pytest.raises(ValueError):
        write(singles[1:])
    ranks = write([*singles, b"abc"])  # no merge reaches it: it is used for a whole match only
    codec = byte_bpe.ByteCodec(ranks, public_tokenizers.PATTERN)
    assert codec.encode_word(b"abc") == [256] and codec.encode_word(b"abcd") == [97, 98, 99, 100]


def test_op12_equals_the_library(spark):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    enc = library(RANKS[0])
    for r in queries.op12_byte_bpe(spark, "/root/testdata/sf0.001").collect():
        ids = enc.encode_ordinary(docs[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(enc.decode_bytes(ids)).hexdigest()


# --- conversations


def odd_turns(seed, convs, many=6):
    r = random.Random(seed)
    rows = []
    for c in convs:
        for t in range(r.randrange(1, many)):
            rows.append((c, r.choice([t, t, t, t + 1, None]), r.choice(["user", "assistant", "system", "user", "assistant", "tool", "", None]), r.choice(["One. Two!", "Is it?", "no end", "", " \t", None, "a", "b", "b.  \n"])))
    rows += [(None, 0, "user", "lost"), rows[0], rows[0]]
    r.shuffle(rows)
    return rows


def in_order(rows, null):
    """Rows of each conversation by turn (null first), then by the digest of role and text."""
    out = {}
    for c, t, role, text in rows:
        if c is not None:
            role, text = null if role is None else role, null if text is None else text
            out.setdefault(c, []).append(((t is not None, t or 0), hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest(), role, text, t))
    return {c: [x[2:] for x in sorted(v, key=lambda x: x[:2])] for c, v in out.items()}


def brute_trie(rows):
    own = {c: [(r, t) for r, t, _ in v] for c, v in in_order(rows, "").items()}
    members = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        base = int(c - np.fmod(c, 20))
        turns = (*own.get(base, [])[:h], *own[c][h:])
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append((c, len(turns)))
    kids = {}
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    out = {}

    def visit(p):
        below = [visit(k) for k in kids.get(p, [])]
        n = len(members[p])
        leaves = sum(b[0] for b in below) + (not below)
        saved = sum(b[1] for b in below) + ((n - 1) * len(WORD.findall(p[-1][1])) if p else 0)
        ends = ",".join(map(str, sorted(c for c, k in members[p] if k == len(p))))
        name = lambda q: min(c for c, _ in members[q])
        out[name(p), len(p)] = (name(p[:-1]) if p else None, n, len(below), leaves, saved, hashlib.sha256(ends.encode()).hexdigest())
        return leaves, saved

    if members:
        visit(())
    return out


@pytest.mark.parametrize("cells", [1, 40])
def test_trie_against_brute_force(spark, cells):
    rows = odd_turns(cells, [*range(0, 130), 400, -3, -20, 10**12])
    rows += [(c, t, "user", "the same words") for c in range(500, 540) for t in range(3)] + [(700, t, "user", f"{t % 3}") for t in range(90)]
    df = spark.createDataFrame(rows, TURN).withColumn("path", F.lit("clash")).withColumn("words", F.lit(1)).repartition(5)
    got = trie.prefix_trie(trie.rebuilt_paths(df), cells=cells).collect()
    want = brute_trie(rows)
    assert len(got) == len(want) == len({(r.conv_id, r.depth) for r in got})
    for r in got:
        assert (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) == want[r.conv_id, r.depth]


def test_trie_of_plain_conversations(spark):
    rows = [(c, t, "user", f"{t} {c if t == 2 else ''}") for c in (4, 9, 2) for t in range(3)]
    got = {(r.conv_id, r.depth): r for r in trie.prefix_trie(trie.rebuilt_paths(spark.createDataFrame(rows, TURN), borrow=None)).collect()}
    assert set(got) == {(2, 0), (2, 1), (2, 2), (2, 3), (4, 3), (9, 3)} and got[2, 2].n_children == 3 and got[2, 0].n_leaves == 3
    assert got[2, 1].saved_tokens == 4 and got[2, 0].parent_conv_id is None


def test_trie_without_rows(spark):
    assert trie.prefix_trie(trie.rebuilt_paths(spark.createDataFrame([], TURN))).count() == 0
    one = trie.prefix_trie(trie.rebuilt_paths(spark.createDataFrame([(5, None, None, None)], TURN), borrow=lambda c: 3)).collect()
    assert [(r.conv_id, r.depth, r.n_convs, r.n_children, r.n_leaves) for r in one] == [(5, 0, 1, 0, 1)]


def brute_repair(rows):
    """The cheapest edits of (initial, fault) rows, of equal ones the least letters: all edit sequences that cost no more than deleting everything."""
    best = [(2 * len(rows), "D" * len(rows))]

    def go(i, letters, roles, cost):
        if cost > best[0][0]:
            return
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", roles):
            best[0] = min(best[0], (cost, letters))
        for x in "ua":
            go(i, letters + "I", roles + x, cost + 5)
        if i < len(rows):
            initial, fault = rows[i]
            go(i + 1, letters + "D", roles, cost + 2)
            if fault != "gone":
                more = 5 if fault == "short" else 0
                if initial:
                    go(i + 1, letters + "K", roles + initial, cost + more)
                for x in "ua":
                    go(i + 1, letters + "R", roles + x, cost + more + 1)

    go(0, "", "", 0)
    return best[0]


def runs_of(rows):
    out = []
    for initial, fault in rows:
        s = 9 + repair.GONE if fault == "gone" else ("sua".index(initial) if initial and initial in "sua" else 3) * 3 + (fault == "short")
        out.append([s, 1]) if not out or out[-1][0] != s else out[-1].__setitem__(1, out[-1][1] + 1)
    return tuple(map(tuple, out))


def test_cheapest_edits_against_all_edits():
    r = random.Random(9)
    for _ in range(250):
        rows = [(r.choice("suuuaaat"), r.choice(["fine", "fine", "fine", "short", "gone"])) for _ in range(r.randrange(0, 7))]
        if r.random() < 0.3:
            rows = [x for x in rows[:3] for _ in range(2)]
        assert repair.repair_runs(runs_of(rows)) == brute_repair(rows), rows


def test_long_runs(monkeypatch):
    short = [("u", "fine")] * 23 + [("a", "short")] * 17 + [("u", "gone")] * 9 + [("a", "fine")] * 31
    plain = repair._repair(tuple((s, 1) for s, n in runs_of(short) for _ in range(n)))
    assert repair.repair_runs(runs_of(short)) == plain
    monkeypatch.setattr(repair, "UNROLL", 5)
    assert repair._repair(runs_of(short)) == plain
    cost, audit = repair.repair_runs(((3, 100_000), (6, 100_000)))
    assert len(audit.replace("I", "")) == 200_000 and cost == 2 * audit.count("D") + audit.count("R") + 5 * audit.count("I")


def brute_report(rows, damage=True):
    out = {c: [] for c, *_ in rows if c is not None}
    for c, t, role, text in rows if damage else []:
        if c is None:
            continue
        k = zlib.crc32(f"{c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        out[c] += [(c, t, "user" if k == 4 else role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
    want = {}
    for c, own in out.items():
        own = in_order(own, " ").get(c, [])
        seen, marks = set(), []
        for role, text, _ in own:
            body = text.strip(" \t\n\x0b\x0c\r")
            marks.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = {t for *_, t in own if t is not None}
        cost, audit = brute_repair([(role[:1], {"": "fine", "truncated": "short"}.get(m, "gone")) for (role, _, _), m in zip(own, marks)])
        fixed, at, state = [], 0, 0
        for e in audit:
            to = "assistant" if state == 2 else "user"
            if e != "I":
                role, text, _ = own[at]
                at += 1
            if e in "IR":
                fixed.append(f"{to}:{text if e == 'R' else ''}")
            elif e == "K":
                fixed.append(f"{role}:{text}")
            if e != "D":
                state = 1 if fixed[-1][0] == "s" else 3 if state == 2 else 2
        pairs = [a[0][:1] + b[0][:1] for a, b in zip(own, own[1:])]
        want[c] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(marks.count(m) for m in ("blank", "duplicate", "truncated")), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(fixed).encode()).hexdigest())
    return want


def test_repair_against_brute_force(spark):
    rows = odd_turns(11, range(60), 7) + [(900, 3, "user", "x" * 100_000), (901, -(2**63), "user", "Hm."), (901, 2**63 - 1, "assistant", "Hm."), (902, None, None, None)]
    want = brute_report(rows)
    df = spark.createDataFrame(rows, TURN).withColumn("audit", F.lit(3)).withColumn("gone", F.lit("clash")).repartition(3)
    got = {r.conv_id: r for r in repair.repair_conversations(repair.damage_turns(df)).collect()}
    assert set(got) == set(want)
    for c, r in got.items():
        if c == 901:
            continue
        assert (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) == want[c], (c, want[c])
    assert got[901].gaps == 2**63 - 1 or want[901][0] < 2**63
    assert repair.repair_conversations(repair.damage_turns(df.limit(0))).count() == 0


def test_repaired_turns_are_sound(spark):
    rows = odd_turns(5, range(40), 7)
    turns = repair.damage_turns(spark.createDataFrame(rows, TURN))
    fixed = {}
    for r in repair.repaired_turns(turns, repair.repair_report(turns)).orderBy("conv_id", "place").collect():
        assert r.place == len(fixed.setdefault(r.conv_id, [])) and (r.edit != "I" or r.text == "")
        fixed[r.conv_id].append(r.role[:1])
    assert fixed and all(re.fullmatch("(s?(ua)+)?", "".join(v)) for v in fixed.values())


def test_one_conversation_over_many_batches(spark):
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", f"turn {t}.") for t in range(3000)] + [(2, 0, "user", "Hi.")]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = spark.createDataFrame(rows, TURN)
        got = {r.conv_id: r for r in repair.repair_conversations(df).collect()}
        nodes = trie.prefix_trie(trie.rebuilt_paths(df, borrow=None), cells=100).count()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got[1].audit == "K" * 3000 and got[1].cost == 0 and got[2].audit == "D" and nodes == 3002
    assert got[1].repaired_sha256 == hashlib.sha256("\n".join(f"{r}:{t}" for _, _, r, t in rows[:3000]).encode()).hexdigest()
