"""SentencePiece, chat packs, WARC archives and fingerprints: exact round trips."""

import hashlib
import random

import pytest
import sentencepiece
from pyspark.sql import functions as F

from gaugeframe.llm import chat, fingerprints as fp, piece_bpe, warc
from gaugeframe.llm.queries import HOSTILE, coded_digests, piece_model

ALPHABET = ["a", "b", "e", "▁", " ", "  ", "\n", "é", "=", "-", ".", "1", "0", "the", "\x00", "中", "😀", "\\", "{", "A", '"', "\t", "\r", "́", "﷽"]


def odd_texts(seed=1, n=400):
    r = random.Random(seed)
    out = ["".join(r.choice(ALPHABET) for _ in range(r.choice([0, 1, 3, 10, 60, 400]))) for _ in range(n)]
    return [*out, "", " ", " " * 999, "a" * 2500, "ab" * 600, "=" * 700, "banana" * 60, "x" * 191, "x" * 193, "etaoin" * 500]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=piece_model())


def test_ids_and_texts_are_the_library_s(spark, library):
    texts = [None, *odd_texts()]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("ids", F.lit("clash"))
    coded = piece_bpe.encode_documents(spark, df, piece_model(), decode=True)
    back = {r.doc_id: r.text for r in piece_bpe.decode_documents(spark, coded, piece_model()).collect()}
    digests = {r.doc_id: r for r in coded_digests(coded).collect()}
    for r in coded.collect():
        want = library.encode(texts[r.doc_id] or "")
        assert r.ids == want and r.decoded == back[r.doc_id] == library.decode(want)
        assert digests[r.doc_id].n_tokens == len(want) and digests[r.doc_id].ids_sha256 == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()


def test_any_ids_decode_as_the_library_does(spark, library):
    r = random.Random(3)
    lists = [[r.randrange(32000) if r.random() < 0.6 else r.randrange(259) for _ in range(r.choice([0, 1, 2, 5, 9]))] for _ in range(500)]
    df = spark.createDataFrame(list(enumerate([*lists, None])), "doc_id long, ids array<int>")
    got = {x.doc_id: x.text for x in piece_bpe.decode_documents(spark, df, piece_model()).collect()}
    assert all(got[i] == library.decode(ids) for i, ids in enumerate(lists)) and got[len(lists)] == ""


def test_no_rows_to_encode(spark):
    assert piece_bpe.encode_documents(spark, spark.createDataFrame([], "doc_id long, text string"), piece_model(), decode=True).count() == 0


TURNS = [
    (1, 0, "system", "be kind"), (1, 1, "user", "hi"), (1, 2, "assistant", "hello"),
    (2, 0, "system", "be kind"), (2, 1, "user", "hi"), (2, 2, "assistant", "hey\nyou"),
    (3, 0, "system", "be kind"), (3, 2, "assistant", None), (3, 1, "user", HOSTILE),
    (4, 0, None, "<\\|im_end|> <\\\\| <| |>"), (4, 1, "assistant", HOSTILE), (4, 1, "assistant", HOSTILE), (5, 0, "a\nb\\n<|", ""), (None, 0, "user", "gone"), (6, None, "user", "first"), (6, 0, "assistant", "second"),
]


@pytest.mark.parametrize("pack", [1, 60, 1 << 20])
def test_chat_round_trip(spark, pack):
    df = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string").withColumn("path", F.lit(0))
    packs = chat.pack_conversations(df, pack_chars=pack)
    got = {r.conv_id: r for r in chat.read_packs(packs).collect()}
    want = {}
    for c, _, role, text in sorted((t for t in TURNS if t[0] is not None), key=lambda t: (t[0], -1 if t[1] is None else t[1])):
        want.setdefault(c, []).append((role or "", text or ""))
    assert set(got) == set(want)
    for c, turns in want.items():
        assert list(zip(got[c].roles, got[c].texts)) == turns
        assert got[c].loss == "".join(t for r, t in turns if r == "assistant")
        assert got[c].formatted.count("<|im_start|>") == len(turns)


def test_shared_turns_are_emitted_once(spark):
    df = spark.createDataFrame([t for t in TURNS if t[0] in (1, 2)], "conv_id long, turn long, role string, text string").coalesce(1)
    packs = [r for r in chat.pack_conversations(df).collect()]
    text = "".join(p.text for p in packs)
    assert len(packs) > 1 or text.count("be kind") == 1
    for p in packs:
        ids = chat.position_ids(p.start, p.length, p.position)
        for leaf in p.leaf:
            spans = chat.attention_intervals(p.parent, p.start, p.length, leaf)
            assert [ids[k] for a, b in spans for k in range(a, b)] == list(range(sum(b - a for a, b in spans)))


def test_many_conversations_behind_one_turn(spark):
    rows = [(c, t, "user" if t == 0 else "assistant", "same" if t == 0 else f"answer {c}") for c in range(400) for t in range(2)]
    packs = chat.pack_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), pack_chars=2000)
    assert packs.count() > 5 and packs.select(F.max(F.char_length("text"))).first()[0] < 2200
    assert chat.read_packs(packs).where("size(texts) = 2").count() == 400


PAGES = [(1, "http://a/", "<p>x"), (2, "http://b/ c", "<p>x"), (3, None, ""), (4, "http://d/", None), (5, "http://e/\n", "é" * 3000 + "\r\n\r\n"), (6, "u", "<p>x"), (None, "u", "lost"), (8, "u", "lone")]


def test_archives_round_trip(spark):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("keep", F.lit(1)).withColumn("offset", F.lit(2))
    index = warc.write_archives(spark, df)
    got = {r.page_id: r for r in warc.read_archives(index).collect()}
    assert set(got) == {p[0] for p in PAGES if p[0] is not None}
    for i, _, html in PAGES:
        if i is not None:
            body = (html or "").encode()
            assert (got[i].payload_bytes, got[i].payload_digest) == (len(body), warc.digest(body))
            assert got[i].record_type == "revisit" or bytes(got[i].payload) == body
    assert {i: got[i].refers_to for i in got if got[i].record_type == "revisit"} == {1: 6, 2: 6, 3: 4}
    some = warc.read_archives(index.where("page_id in (2, 5)"))
    assert {r.page_id for r in some.collect()} == {2, 5}


def test_small_payloads_stay_responses_and_empty_tables(spark):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    got = warc.read_archives(warc.write_archives(spark, df, least_bytes=5))
    assert got.where("record_type = 'revisit'").count() == 0
    assert warc.read_archives(warc.write_archives(spark, df.limit(0))).count() == 0


def test_archive_is_plain_gzip_members(spark, tmp_path):
    import gzip

    warc.write_archives(spark, spark.createDataFrame(PAGES[:2], "page_id long, url string, html string").coalesce(1), f"file://{tmp_path}/w")
    (file,) = (tmp_path / "w").iterdir()
    assert gzip.decompress(file.read_bytes()).count(b"WARC/1.1\r\n") == 2


@pytest.mark.parametrize("spans", [256, 2])
def test_fingerprints_match_brute_force(spark, monkeypatch, spans):
    monkeypatch.setattr(fp, "STRETCH", 7)
    monkeypatch.setattr(fp, "SPANS", spans)
    r = random.Random(6)
    texts = {i * 3: "".join(r.choice("abcdé 中") for _ in range(r.choice([0, 1, 2, 15, 16, 17, 400, 3000]))) for i in range(60)}
    texts[6] = None
    texts[9] = texts[12]
    rows = list(texts.items())
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("stretch", F.lit(9)).withColumn("host", F.lit(1))
    got = {x.doc_id: x for x in fp.fingerprints_with_edits(df).collect()}
    ids = sorted(texts)
    plain = {x.doc_id: x.fingerprint for x in fp.fingerprint_documents(df).collect()}
    for i, nxt in zip(ids, [*ids[1:], ids[0]]):
        t, o = texts[i] or "", texts[nxt] or ""
        edited = t[: len(t) - len(t) // 2] + o[: len(t) // 2]
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert got[i].fingerprint == plain[i] == fp.spell(fp.sketch([t])[0])
        assert got[i].edited_fingerprint == fp.spell(fp.sketch([edited])[0])
        assert got[i].near_next == fp.likeness(fp.read(plain[i]), fp.read(plain[nxt])) and 0 <= got[i].near_edited <= 1
    assert got[9].fingerprint == got[12].fingerprint and got[9].near_next == 1.0


def test_fingerprints_estimate_and_merge():
    r = random.Random(2)
    a = "".join(r.choice("abcdefgh ") for _ in range(60_000))
    b = a[:30_000]
    x, y, z = fp.sketch([a, b, a[30_000 - fp.SHINGLE + 1 :]])
    assert abs(fp.containment(y, x) - 1) < 1e-9 and abs(fp.likeness(x, y) - 0.5) < 0.05
    assert (fp.merge(y, z) == x).all()


def test_fingerprint_edges(spark):
    df = spark.createDataFrame([(None, "abcd"), (5, "whole text")], "doc_id long, text string")
    got = {x.doc_id: x for x in fp.fingerprints_with_edits(df).collect()}
    assert got[None].near_next is None and got[5].near_next == 1.0
    assert fp.fingerprints_with_edits(df.limit(0)).count() == 0


def brute_records(rows, least_bytes=0):
    """One record a row; of equal payloads one row of the largest page id is the response."""
    out, keep = [], {}
    for i, _, html in rows:
        keep[html or ""] = max(keep.get(html or "", i), i)
    done = set()
    for i, _, html in sorted(rows, key=lambda r: (r[0], r[1] is None, r[1] or "")):
        body, k = html or "", keep[html or ""]
        response = len(body.encode()) < least_bytes or (i == k and body not in done)
        done |= {body} if response else set()
        out.append((i, len(body.encode()), warc.digest(body.encode()), "response" if response else "revisit", None if response else k))
    return sorted(out, key=str)


@pytest.mark.parametrize("least", [0, 2])
def test_repeated_page_ids_give_one_record_a_row(spark, least):
    rows = [(5, "u", "A"), (5, "v", "BBB"), (9, "w", "A"), (7, "x", "BBB"), (3, None, None), (4, "q", ""), (11, "z", "Q q"), (11, "y", "Q q"), (11, "y", "Q q"), (2, "y", "Q q"), (12, "m", "long " * 60_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("sha", F.lit("clash")).withColumn("copy", F.lit(1))
    index = warc.write_archives(spark, df, least_bytes=least)
    got = warc.read_archives(index).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == brute_records(rows, least)
    assert index.count() == len(rows) == index.select("file", "offset").distinct().count()


def test_many_regions_are_read_by_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(warc, "SPAN", 1 << 12)
    r = random.Random(2)
    rows = [(i, f"http://{i}/", "".join(r.choice("abcdefghij") for _ in range(900))) for i in range(300)]
    index = warc.write_archives(spark, spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1))
    back = warc.read_archives(index)
    assert back.rdd.getNumPartitions() >= 8 and {x.page_id: bytes(x.payload).decode() for x in back.collect()} == {i: h for i, _, h in rows}


def test_sketch_against_plain_windows():
    """The retained hashes are those of all windows below the limit: windows hashed one by one, with plain integers."""
    mask, base = (1 << 64) - 1, 0x9E3779B97F4A7C15 | 1

    def mix(x):
        x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & mask
        x = (x ^ (x >> 27)) * 0x94D049BB133111EB & mask
        return x ^ (x >> 31)

    window = lambda w: mix(sum(mix(ord(c) + 1) * pow(base, k, 1 << 64) for k, c in enumerate(w)) & mask)
    r = random.Random(5)
    for n in (16, 17, 300, 2000):
        text = "".join(r.choice("abcdé 中😀") for _ in range(n))
        every = {window(text[i : i + 16]) for i in range(n - 15)}
        low = {h for h in every if h < (1 << 64) // 16}
        assert set(fp.sketch(["x" * 40, text, "y"])[1].tolist()) == (low or {min(every)})


def test_long_words_are_not_remembered(spark, library):
    vocabulary = piece_bpe.Vocabulary(piece_model())
    codec = piece_bpe.Codec(vocabulary)
    r = random.Random(7)
    texts = ["".join(r.choice("abcdefgh中文字") for _ in range(n)) for n in (30, 60, 300, 5000)] + ["short words stay known", "x" * 49]
    for _ in range(2):
        ids, bounds = codec.encode(texts)
        assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])] == [library.encode(t) for t in texts]
    assert max(map(len, codec.known)) <= piece_bpe.CACHE_WORD and len(codec.bounds) == len(codec.known) + 1


def test_long_and_empty_conversations(spark):
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", f"turn {t} " * 40) for t in range(120)] + [(1, 500, "assistant", "z" * 200_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    (back,) = chat.read_packs(chat.pack_conversations(df)).collect()
    assert list(back.texts) == [t for *_, t in rows]
    assert chat.read_packs(chat.pack_conversations(df.limit(0))).count() == 0


def test_rows_of_one_id_and_repeated_rows(spark, library):
    """Repeated rows are encoded each; among documents of one id the order of texts tells which is next."""
    rows = [(4, "one text"), (4, "another text, rather longer than it"), (4, "one text"), (2, "first of all"), (9, "the last document of the table")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    coded = sorted((r.doc_id, tuple(r.ids), r.decoded) for r in piece_bpe.encode_documents(spark, df, piece_model(), decode=True).collect())
    assert coded == sorted((i, tuple(library.encode(t)), t) for i, t in rows)
    want, order = [], sorted(rows)
    for (i, t), (_, nxt) in zip(order, [*order[1:], order[0]]):
        edited = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        want.append((i, len(t), fp.spell(fp.sketch([t])[0]), hashlib.sha256(edited.encode()).hexdigest()))
    got = [(r.doc_id, r.n_chars, r.fingerprint, r.edited_sha256) for r in fp.fingerprints_with_edits(df).collect()]
    assert sorted(got) == sorted(want)
