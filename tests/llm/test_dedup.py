"""Near-duplicate documents and repeated passages against brute force."""

import random
import re

import pytest
from pyspark.sql import functions as F

from gaugeframe.llm import near_dedup as nd
from gaugeframe.llm import passages as ps

LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(rows, k, percent=80):
    sets = {i: shingles(t, k) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def corpus(seed=5, n=40, copies=60):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = [" ".join(r.choice(vocabulary) for _ in range(r.choice([1, 2, 3, 8, 60, 150]))) for _ in range(n)]
    for _ in range(copies):
        words = r.choice(rows).split(" ")
        for _ in range(r.choice([0, 0, 1, 2, 5, 9])):
            words[r.randrange(len(words))] = r.choice(vocabulary)
        rows.append(" ".join(words))
    rows += [None, "", "  \n\t", "One", "one", "ONE two", "é É", rows[0].upper(), "x " * 5000]
    return list(enumerate(rows))


@pytest.mark.parametrize("k", [2, 5])
def test_components_match_brute_force(spark, k):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("k1", F.lit("clash")).withColumn("component_id", F.lit(3))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in nd.near_duplicate_components(spark, df, shingle_words=k).collect()}
    assert got == brute(rows, k)


def test_a_chain_across_a_bucket_is_joined(spark):
    """Texts that drift word by word: neighbours link, ends do not, all are one component."""
    base = [f"a{i}" for i in range(120)]
    rows = []
    for step in range(12):
        words = list(base)
        for j in range(step * 3):
            words[j] = f"b{j}"
        rows.append((step, " ".join(words)))
    got = {r.doc_id: r.component_id for r in nd.near_duplicate_components(spark, spark.createDataFrame(rows, "doc_id long, text string"), shingle_words=2).collect()}
    assert got == {i: c for i, (_, c) in brute(rows, 2).items()}


def test_nulls_repeats_and_empty_tables(spark):
    rows = [(None, "a b c"), (4, "a b c"), (4, "a b c"), (9, "a b c"), (2, None)]
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in nd.near_duplicate_components(spark, spark.createDataFrame(rows, "doc_id long, text string"), shingle_words=2).collect()), key=str)
    assert got == sorted([(None, None, True), (4, 4, True), (4, 4, True), (9, 4, False), (2, 2, True)], key=str)
    assert nd.near_duplicate_components(spark, spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_likelihood_estimate():
    import numpy as np

    r = np.random.default_rng(2)
    for share in (0.5, 0.8, 0.95):
        n = 2000
        common = int(2 * n * share / (1 + share))
        errors = []
        for _ in range(20):
            pool = r.integers(1, 1 << 63, 2 * n - common, dtype=np.uint64)
            sets = np.concatenate([np.sort(pool[:n]), np.sort(pool[n - common :])])
            k = nd.registers(sets, np.array([0, n, 2 * n]))
            j = nd.likelihood_jaccard(np.array([(k[0] > k[1]).sum()]), np.array([(k[0] < k[1]).sum()]), np.array([(k[0] == k[1]).sum()]), np.array([n]), np.array([n]))[0]
            errors.append(j - share)
        assert abs(np.mean(errors)) < 0.03 and np.abs(errors).max() < 0.15


def test_registers_merge_by_maximum():
    import numpy as np

    r = np.random.default_rng(1)
    a, b = (np.unique(r.integers(1, 1 << 63, 50, dtype=np.uint64)) for _ in range(2))
    both = np.union1d(a, b)
    one = lambda s: nd.registers(s, np.array([0, len(s)]))[0]
    assert (np.maximum(one(a), one(b)) == one(both)).all()


def sentences(r, n):
    return " ".join(" ".join(f"{r.choice('abcdefgh')}{r.randrange(900)}" for _ in range(r.randrange(6, 12))) + "." for _ in range(n))


@pytest.fixture(scope="module")
def planted():
    """Clean documents, and three passages of more than 50 words planted inside the lines of others."""
    r = random.Random(8)
    passages = [sentences(r, 9) for _ in range(3)]
    rows, holders = [], {}
    for i in range(60):
        text = sentences(r, 8) + "\n" + sentences(r, 5)
        if i % 4 == 0:
            words = text.split(" ")
            at = r.randrange(5, len(words) - 5)
            text = " ".join([*words[:at], passages[i % 3], *words[at:]])
            holders[i] = i % 3
        rows.append((i, text))
    return rows, holders, passages


def test_planted_passages(spark, planted):
    rows, holders, passages = planted
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("paragraph", F.lit("clash"))
    found = ps.repeated_passages(df).collect()
    assert {r.doc_id for r in found} == set(holders)
    first = {p: min(i for i, q in holders.items() if q == p) for p in range(3)}
    assert all(r.keep_doc == first[holders[r.doc_id]] and r.removed == (r.doc_id != r.keep_doc) for r in found)
    texts = dict(rows)
    assert all(texts[r.doc_id][r.start_char : r.end_char].split() == texts[r.doc_id][r.start_char : r.end_char].strip().split() for r in found)
    for r in found:
        assert texts[r.doc_id][r.start_char : r.end_char].split()[-3] in passages[holders[r.doc_id]]


def test_removal_keeps_the_rest(spark, planted):
    rows, holders, passages = planted
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = {r.doc_id: r for r in ps.remove_passages(df, ps.repeated_passages(df)).collect()}
    assert len(out) == len(rows)
    for i, t in rows:
        if i not in holders:
            assert out[i].text == t
        elif i != min(k for k, q in holders.items() if q == holders[i]):
            inner = passages[holders[i]].split(". ")[3]
            assert inner in t and inner not in out[i].text and out[i].n_chars == len(out[i].text) < len(t)


def test_passages_near_copies_and_edges(spark):
    r = random.Random(4)
    long = [" ".join(f"k{r.randrange(2000)}" for _ in range(40)) for _ in range(3)]
    near = [x.split(" ") for x in long]
    near[1][39] = "changed"
    one, two = ". ".join(long) + ".", ". ".join(" ".join(x) for x in near) + "."
    rows = [(1, one), (2, two), (3, None), (4, ""), (5, "Short. One. Two."), (6, "Short. One. Two."), (None, one), (7, "word " * 3000)]
    found = ps.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {x.doc_id for x in found} == {1, 2} and sum(x.removed for x in found) >= 3
    assert ps.repeated_passages(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_passages_of_short_lines(spark):
    r = random.Random(6)
    lines = lambda n, m: "\n".join(" ".join(f"w{r.randrange(5000)}" for _ in range(m)) for _ in range(n))
    for size in (4, 1):
        block = lines(60 // size, size)
        rows = [(i, lines(20, 3) + "\n" + (block + "\n" if i in (3, 5) else "") + lines(20, 3)) for i in range(8)]
        df = spark.createDataFrame([(i, t, len(t)) for i, t in rows], "doc_id long, text string, n_chars long")
        found = ps.repeated_passages(df)
        assert {(x.doc_id, x.keep_doc, x.removed) for x in found.collect()} == {(3, 3, False), (5, 3, True)}
        out = {x.doc_id: x.text for x in ps.remove_passages(df, found).collect()}
        middle = " ".join(block.split()[25:35])
        assert middle not in " ".join(out[5].split()) and all(out[i] == t for i, t in rows if i != 5)


def test_runs_of_just_over_fifty_words_are_removed_whole(spark):
    r = random.Random(9)
    words = lambda n: [f"é{r.randrange(9000)}" for _ in range(n)]
    rows, want = [], {}
    for i in range(40):
        shared = words(51 + i % 8)
        for doc in (i, 100 + i):
            before, after = [*words(60 + r.randrange(40)), f"a{doc}"], [f"b{doc}", *words(60)]
            rows.append((doc, " ".join([*before, *shared, *after])))
            want[doc] = (doc >= 100, i, " ".join(shared))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    texts = dict(rows)
    found = [(x.doc_id, (x.removed, x.keep_doc, texts[x.doc_id][x.start : x.until]), x.last - x.first) for x in ps._equal_runs(df, ps.LEAST_RUN_WORDS).collect()]
    assert {(d, w) for d, w, _ in found} == set(want.items()) and all(n == len(w[2].split()) for _, w, n in found)


def test_without_spans():
    assert ps.without_spans("ab cd ef", [(3, 5)]) == "ab  ef"
    assert ps.without_spans(None, []) is None and ps.without_spans("abc", [(0, 3)]) == ""


def test_rows_of_one_document_are_linked(spark):
    rows = [(7, "a b c d e f g"), (7, "x y z w v u t"), (4, "a b c d e f g"), (5, "x y z w v u t"), (7, ""), (8, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in nd.near_duplicate_components(spark, df, shingle_words=2).collect())
    assert got == [(4, 6, 4, True), (5, 6, 4, False), (7, 0, 7, True), (7, 6, 4, False), (7, 6, 4, False), (8, 0, 8, True)]


@pytest.mark.parametrize("tile, size", [(4, 1 << 25), (512, 2000)])
def test_small_tiles_lose_no_link(spark, monkeypatch, tile, size):
    monkeypatch.setattr(nd, "TILE", tile)
    monkeypatch.setattr(nd, "TILE_BYTES", size)
    rows = corpus(seed=11, n=25, copies=70)
    got = {r.doc_id: r.component_id for r in nd.near_duplicate_components(spark, spark.createDataFrame(rows, "doc_id long, text string"), shingle_words=2).collect()}
    assert got == {i: c for i, (_, c) in brute(rows, 2).items()}


def test_paragraph_clusters_match_brute_force(spark):
    """Paragraphs as the cuts give them: the clusters of those at 0.8 or more are those of all pairs."""
    r = random.Random(3)
    base = [[f"q{r.randrange(4000)}" for _ in range(30)] for _ in range(12)]
    rows = []
    for i in range(90):
        words = list(base[i % 12])
        for _ in range(r.choice([0, 0, 1, 1])):
            words[r.choice([0, 29])] = f"z{i}"
        rows.append((i, " ".join(words) + "."))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sets = {i: shingles(t, 5) for i, t in rows}
    places = [(p.doc_id, p.key, p.start, p.until) for p in ps._paragraphs(df, "places").collect()]
    texts = dict(rows)
    units = {(d, k): shingles(texts[d][a:b], 5) for d, k, a, b in places}
    found = {}
    for x in ps.repeated_passages(df).where("paragraph is not null").collect():
        found.setdefault(x.component_id, set()).add(x.doc_id)
    assert sets and units
    for docs in found.values():
        assert len(docs) > 1
    together = {frozenset((a, b)) for docs in found.values() for a in docs for b in docs if a != b}
    for (a, _), x in units.items():
        for (b, _), y in units.items():
            if a < b and len(x) >= 16 and 100 * len(x & y) >= 80 * len(x | y):
                assert frozenset((a, b)) in together


def test_equal_runs_match_brute_force(spark):
    """Every run of 50 or more equal words of two documents is covered, in the document of larger id, by what is removed."""
    r = random.Random(21)
    vocabulary = [f"v{i}" for i in range(3000)]
    shared = [[r.choice(vocabulary) for _ in range(n)] for n in (50, 55, 70, 140)]
    rows = []
    for i in range(24):
        parts = [[r.choice(vocabulary) for _ in range(r.randrange(5, 90))] for _ in range(3)]
        for k in r.sample(range(4), 2):
            parts.insert(r.randrange(len(parts) + 1), shared[k])
        rows.append((i, " ".join(w for p in parts for w in p)))
    rows += [(50, rows[0][1]), (50, rows[0][1]), (None, rows[0][1]), (51, ""), (52, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit("clash")).withColumn("run", F.lit(1))
    spans: dict = {}
    for x in ps.repeated_passages(df).where("removed").collect():
        spans.setdefault(x.doc_id, set()).update(range(x.start_char, x.end_char))
    for i, t in rows:
        if i is None or not t:
            continue
        for k, words in enumerate(shared):
            text = " ".join(words)
            at = t.find(text)
            if at >= 0 and any(j is not None and j < i and text in (o or "") for j, o in rows):
                missing = [c for c in range(at, at + len(text)) if c not in spans.get(i, set())]
                assert not "".join(t[c] for c in missing).strip(), (i, k)


def test_key_filter(spark):
    import numpy as np

    r = np.random.default_rng(1)
    keys = r.integers(-(1 << 63), 1 << 63, 5000, dtype=np.int64)
    shared = ps.key_filter(spark.createDataFrame([(int(k),) for k in [*keys, 0, -1, 1]], "key long"))
    assert ps._wanted(np.array([*keys, 0, -1, 1]), shared).all()
    assert ps._wanted(r.integers(-(1 << 63), 1 << 63, 20000, dtype=np.int64), shared).mean() < 0.001
    assert not ps._wanted(keys, ps.key_filter(spark.createDataFrame([], "key long"))).any()


def test_removal_keeps_any_column(spark, planted):
    rows, _, _ = planted
    names = ["doc_id", "text", "n_chars", "spans", "cut_id", "_spans", "_cut_id"]
    df = spark.createDataFrame([(i, t, len(t), "s", 3, 1, 2) for i, t in rows], "doc_id long, text string, n_chars long, spans string, cut_id int, _spans int, _cut_id int")
    out = ps.remove_passages(df, ps.repeated_passages(df))
    assert out.columns == names and {(r.spans, r.cut_id, r["_spans"], r["_cut_id"]) for r in out.collect()} == {("s", 3, 1, 2)}
    assert ps.remove_passages(df.limit(0), ps.repeated_passages(df.limit(0))).count() == 0
