"""Neighbours, shards, mixing weights, toxicity and the pipeline."""

import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from gaugeframe.llm import ann, mixing, queries, sharding, toxicity as tox
from gaugeframe.sources.scratch import materialize

SF = "/root/testdata/sf0.001"


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(rows, k):
    """Set size and smallest linked id of each document, from all pairs."""
    sets = {i: shingles(t, k) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def brute_nearest(vectors, q, k):
    scores = sorted((-float(np.dot(v, vectors[q])), i) for i, v in vectors.items() if i != q)
    return [i for _, i in scores[:k]]


@pytest.mark.parametrize("scale", [False, True])
def test_recall(spark, scale):
    r = np.random.default_rng(4)
    x = r.normal(size=(3000, 32))
    x = x * r.uniform(0.2, 3, (3000, 1)) if scale else x / np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = ann.nearest_neighbours(df, df.where("vec_id % 60 = 0"), k=20).toPandas()
    want = {q: set(brute_nearest(dict(enumerate(x)), q, 20)) for q in range(0, 3000, 60)}
    hits = [len(want[q] & set(g.vec_id)) / 20 for q, g in got.groupby("query_id")]
    assert len(hits) == 50 and np.mean(hits) >= 0.9
    best = got.sort_values(["query_id", "rank"])
    assert all(abs(s - float(np.dot(x[q], x[v]))) < 1e-9 for q, v, s in zip(best.query_id, best.vec_id, best.score))
    assert (best.groupby("query_id").score.diff().dropna() <= 1e-12).all() and best.groupby("query_id")["rank"].max().eq(20).all()


def test_neighbours_of_odd_rows(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [float("nan"), 1.0]), (6, [1.0, None]), (7, [1.0]), (None, [1.0, 1.0]), (1, [1.0, 0.0]), (8, [float("inf"), 0.0]), (20, [-1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("shard", F.lit("x"))
    got = ann.nearest_neighbours(df, df.where("vec_id % 20 = 0"), k=20).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == [(0, 1, 2, 2.0), (0, 2, 1, 1.0), (0, 3, 20, -1.0), (20, 1, 0, -1.0), (20, 2, 1, -1.0), (20, 3, 2, -2.0)]
    assert ann.nearest_neighbours(df.limit(0), df.limit(0)).count() == 0


def test_ties_go_to_smaller_ids(spark):
    df = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(300)], "vec_id long, embedding array<float>")
    got = ann.nearest_neighbours(df, df.where("vec_id = 40"), k=20).orderBy("rank").collect()
    assert [r.vec_id for r in got] == list(range(20))


def test_best_fit_decreasing_is_the_plain_one():
    r = random.Random(9)
    for _ in range(30):
        sizes = sorted((r.randrange(1, 60) for _ in range(80)), reverse=True)
        bins: list[int] = []
        for s in sizes:
            fits = [(b, i) for i, b in enumerate(bins) if b >= s]
            if fits:
                bins[min(fits)[1]] -= s
            else:
                bins.append(100 - s)
        kinds = [(s, sizes.count(s), float(s)) for s in set(sizes)]
        runs = sharding.pack_classes(kinds, capacity=100)
        load: dict = {}
        for kind, a, b, shard in runs:
            load[shard] = load.get(shard, 0) + kind * (b - a)
        assert len(load) == len(bins) and sorted(load.values()) == sorted(100 - b for b in bins)


def test_shards(spark):
    r = random.Random(3)
    rows = [(i, "x" * r.randrange(0, 400) + str(i)) for i in range(1500)] + [(2000 + i, "copy " * 10) for i in range(200)] + [(3000, None), (3001, ""), (3000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("size", F.lit(1)).withColumn("kind", F.lit("k"))
    out = sharding.pack_shards(df, shards=24).toPandas()
    assert len(out) == len(rows)
    texts = dict(rows)
    assert all(s == len((texts[i] or "").encode()) + 8 and c == zlib.crc32((texts[i] or "").encode()) for i, s, c in zip(out.doc_id, out["size"], out.text_crc32))
    assert out.assign(t=[texts[i] or "" for i in out.doc_id]).groupby("t").shard.nunique().max() == 1
    for _, g in out.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g))) and list(g.sort_values("slot").doc_id) == sorted(g.doc_id)
    load = out.groupby("shard")["size"].sum()
    assert len(load) == 24 and load.max() - load.min() <= 0.03 * load.mean()
    assert sharding.pack_shards(df.limit(0), shards=24).count() == 0


def test_fixed_capacity(spark):
    df = spark.createDataFrame([(i, "y" * (i % 90)) for i in range(600)], "doc_id long, text string")
    out = sharding.pack_shards(df, capacity=5000).toPandas()
    biggest = out.groupby("text_crc32")["size"].sum().max()
    assert out.groupby("shard")["size"].sum().max() <= max(5000, biggest) and out.shard.nunique() <= math.ceil(out["size"].sum() / 5000) + 2


@pytest.fixture(scope="module")
def mixed(spark):
    r = random.Random(1)
    rows = [(i, " ".join("w" * 3 for _ in range(r.choice([20, 200, 900]))), r.choice(["en", "en", "en", "de", None]), r.choice(["a", "a", "a", "b", "c"])) for i in range(800)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("weight", F.lit("clash"))


def test_raked_margins(spark, mixed):
    rows, df = mixed
    n_words = F.size(F.split("text", " "))
    df = df.withColumn("kind", F.when(n_words < 150, "short").when(n_words < 800, "medium").otherwise("long"))
    got = mixing.mix_documents(df.withColumn("probability", F.lit("clash")).withColumn("_topic", F.lit(0)).withColumn("goal_lang", F.lit(0)), share=0.6, topic_col="kind").toPandas()
    w = got["weight"] * got["_tokens"]
    for c in ("_source", "_lang", "_topic"):
        share = w.groupby(got[c]).sum() / w.sum()
        goal = got.groupby(c)["_tokens"].sum() ** 0.5
        assert np.allclose(share, goal / goal.sum(), atol=1e-3)
    assert abs((got.probability * got["_tokens"]).sum() / got["_tokens"].sum() - 0.6) < 1e-3 and got.probability.max() <= 1
    cells: dict = {}
    for i, t, lang, source in rows:
        n = len(t.split())
        key = (source, lang, "short" if n < 150 else "medium" if n < 800 else "long")
        cells[key] = cells.get(key, 0) + n
    plain = {k: float(v) for k, v in cells.items()}
    goals = []
    for m in range(3):
        g: dict = {}
        for k, v in cells.items():
            g[k[m]] = g.get(k[m], 0) + v
        total = sum(x**0.5 for x in g.values())
        goals.append({k: v**0.5 / total for k, v in g.items()})
    for _ in range(60):
        for m in range(3):
            s: dict = {}
            for k, v in plain.items():
                s[k[m]] = s.get(k[m], 0) + v
            plain = {k: v * goals[m][k[m]] / s[k[m]] for k, v in plain.items()}
    total = sum(cells.values())
    for i, t, lang, source in rows[:100]:
        n = len(t.split())
        key = (source, lang, "short" if n < 150 else "medium" if n < 800 else "long")
        assert got[got.doc_id == i].weight.iloc[0] == pytest.approx(plain[key] * total / cells[key], rel=2e-3)


def test_cells_as_joins_give_the_same(spark, mixed):
    rows, df = mixed
    one, many = (mixing.mix_documents(df, share=0.6, cells_in_task=n).select("doc_id", "weight", "probability", "selected").orderBy("doc_id").toPandas() for n in (1000, 0))
    assert np.allclose(one.weight, many.weight, rtol=1e-9) and np.allclose(one.probability, many.probability, atol=1e-8) and (one.selected == many.selected).mean() > 0.99


@pytest.mark.parametrize("cells_in_task", [1000, 0])
def test_targets_and_contradictions(spark, monkeypatch, cells_in_task):
    monkeypatch.setattr(mixing, "ROUNDS", 12)
    df = spark.createDataFrame([(i, "w " * 40, "en" if i % 3 else "de", "ab"[i % 3 == 0]) for i in range(90)], "doc_id long, text string, lang string, source string")
    shares = lambda kv: spark.createDataFrame(list(kv.items()), "value string, share double")
    met = mixing.mix_documents(df, targets={"source": shares({"=a": 3.0, "=b": 1.0, "=none": 5.0}), "lang": shares({"=en": 0.75, "=de": 0.25})}, cells_in_task=cells_in_task).toPandas()
    w = (met.weight * met["_tokens"]).groupby(met.source).sum()
    assert w["a"] / w.sum() == pytest.approx(0.75, abs=1e-3) and met.deviation.max() < mixing.TOLERANCE
    not_met = mixing.mix_documents(df, targets={"source": shares({"=a": 0.9, "=b": 0.1}), "lang": shares({"=en": 0.1, "=de": 0.9})}, cells_in_task=cells_in_task).toPandas()
    assert not_met.deviation.min() > 1  # a and en are the same documents: both targets can't be met, and the result says so
    gone = mixing.mix_documents(df, targets={"source": shares({"=a": 1.0})}, cells_in_task=cells_in_task).toPandas()
    assert (gone[gone.source == "b"].weight == 0).all() and not gone[gone.source == "b"].selected.any()


def topical(n=900, seed=4):
    """Texts of common words and some of one of three subjects, in two languages of other words; subjects are of unequal size."""
    r, rows, kinds = random.Random(seed), [], []
    for i in range(n):
        kind, lang = r.choice("aaaaabbbc"), r.choice(["en", "en", "de"])
        words = [f"{lang}{r.randrange(60)}" for _ in range(40)] + [f"{kind}{r.randrange(25)}" for _ in range(25)]
        rows.append((i, " ".join(r.sample(words, len(words))), lang, r.choice("xxy")))
        kinds.append(kind)
    return rows, kinds


def test_topics_come_from_the_texts(spark):
    rows, kinds = topical()
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = mixing.mix_documents(df.repartition(5), topics=3).toPandas().sort_values("doc_id")
    seen = pd.crosstab(got["_topic"].to_numpy(), np.array(kinds))
    assert seen.to_numpy().max(0).sum() / len(rows) > 0.97 and seen.shape == (3, 3)  # a topic is a subject, in either language
    w, goal = (got.weight * got["_tokens"]).groupby(got["_topic"]).sum(), got.groupby("_topic")["_tokens"].sum() ** 0.5
    assert np.allclose(w / w.sum(), goal / goal.sum(), atol=1e-3) and got.deviation.max() < mixing.TOLERANCE
    again = mixing.mix_documents(df.repartition(2, "text"), topics=3).toPandas().sort_values("doc_id")
    assert list(again["_topic"]) == list(got["_topic"]) and list(again.selected) == list(got.selected)  # whatever the partitions


def test_topics_against_a_plain_assignment(spark):
    rows, _ = topical(120)
    df = spark.createDataFrame([*rows, (500, None, "en", "x"), (501, " ", None, "x")], "doc_id long, text string, lang string, source string")
    placed = mixing.with_margins(df)
    fitted = mixing.fit_topics(mixing._vectors(placed), 4)
    for r in mixing.with_text_topics(placed, fitted).collect():
        v = mixing.text_vectors(pa.array([r.text]))[0].astype(int)
        mean = fitted.means.get("=" + r.lang if r.lang else "null", fitted.means["*"])
        want = "none" if not (r.text or "").split() else f"topic {max(range(4), key=lambda t: (int((v - mean) @ fitted.centres[t]), -t))}"
        assert r["_topic"] == want


def test_constant_is_exact():
    r = np.random.default_rng(2)
    tokens, weight = r.integers(1, 500, 200).astype(float), r.exponential(size=200)
    for share in (0.01, 0.5, 0.9, 0.999):
        c = mixing.constant_for(tokens, weight, share * tokens.sum())
        assert (tokens * np.minimum(1, c * weight)).sum() == pytest.approx(share * tokens.sum())
    assert mixing.constant_for(tokens, np.zeros(200), 1.0) == 0.0


def test_mixing_edges(spark):
    long = spark.createDataFrame([(1, "w " * 400_000, "en", "a"), (2, "w", "en", "a")], "doc_id long, text string, lang string, source string")
    assert {r.doc_id: r["_tokens"] for r in mixing.mix_documents(long).collect()} == {1: 400_000, 2: 1}
    df = spark.createDataFrame([(1, None, None, None), (None, "", "en", "a"), (1, None, None, None)], "doc_id long, text string, lang string, source string")
    assert mixing.mix_documents(df).count() == 3
    assert mixing.mix_documents(df.limit(0)).count() == 0


def toxic_corpus(n=900, seed=2):
    """Label 1 exactly where an insult and a group are named together; each alone is clean."""
    r = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        words = [f"v{r.randrange(300)}" for _ in range(r.randrange(15, 60))]
        insult, group = r.random() < 0.5, r.random() < 0.5
        words += ["grubby"] * insult + ["martians"] * group
        r.shuffle(words)
        rows.append((i, " ".join(words)))
        labels.append((i, int(insult and group)))
    return rows, labels


def test_pairs_of_terms_and_held_out_accuracy(spark):
    rows, labels = toxic_corpus()
    docs, known = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("x")), spark.createDataFrame(labels, "doc_id long, toxic int")
    out = tox.score_toxicity(spark, docs, tox.fit_toxicity(docs, known)).join(known, "doc_id").where("held_out").toPandas()
    assert (out.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in out.doc_id]).all()
    assert ((out.score >= 0.5) == (out.toxic == 1)).mean() > 0.95 and (out.predicted == (out.score >= 0.7)).all()


def test_held_out_labels_are_not_learnt(spark):
    rows, labels = toxic_corpus(300)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    flipped = [(i, 1 - y if zlib.crc32(str(i).encode()) % 3 == 1 else y) for i, y in labels]
    a, b = (tox.fit_toxicity(docs, spark.createDataFrame(x, "doc_id long, toxic int")) for x in (labels, flipped))
    score = lambda m: [r.score for r in tox.score_toxicity(spark, docs, m).orderBy("doc_id").collect()]
    assert score(a) == score(b)


def test_pairwise_part_is_the_double_sum():
    r = np.random.default_rng(3)
    linear, factors = r.normal(size=tox.BUCKETS).astype(np.float32), r.normal(size=(tox.BUCKETS, tox.FACTORS)).astype(np.float32)
    machine = tox.Machine.load(tox.Machine(0.3, linear, factors).dump())
    rows = [r.choice(tox.BUCKETS, n, replace=False) for n in (0, 1, 2, 9)]
    got = machine.raw(np.concatenate(rows).astype(np.int32), np.concatenate([[0], np.cumsum([len(x) for x in rows])]))
    for x, value in zip(rows, got):
        pairs = sum(float(factors[a].astype(float) @ factors[b].astype(float)) for i, a in enumerate(x) for b in x[i + 1 :])
        assert value == pytest.approx(0.3 + float(linear[x].sum()) + pairs, abs=1e-3)


def test_many_rare_partners_are_learnt(spark):
    """Label 1 where the insult meets one of 40 groups; each group is as frequent in both classes, so none stands out by itself."""
    r = random.Random(12)
    rows, labels = [], []
    for i in range(6000):
        label = int(r.random() < 0.5)
        words = [f"v{r.randrange(200)}" for _ in range(r.randrange(6, 14))]
        kind = r.random()
        if label:
            words += ["grubby", f"grp{r.randrange(40):02d}folk"]
        elif kind < 0.5:
            words += ["grubby", "kitchens"[: r.randrange(3, 8)]]
        else:
            words += [f"grp{r.randrange(40):02d}folk"] + ([f"grp{r.randrange(40):02d}folk"] if r.random() < 0.99 else [])
        r.shuffle(words)
        rows.append((i, " ".join(words)))
        labels.append((i, label))
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    out = tox.score_toxicity(spark, docs, tox.fit_toxicity(docs, known)).join(known, "doc_id").where("held_out").toPandas()
    assert ((out.score >= 0.5) == (out.toxic == 1)).mean() > 0.93


def test_toxicity_of_repeated_rows(spark):
    rows, labels = toxic_corpus(300)
    docs = spark.createDataFrame([*rows, rows[5], rows[5]], "doc_id long, text string")
    out = tox.score_toxicity(spark, docs, tox.fit_toxicity(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))).where("doc_id = 5").collect()
    assert len(out) == 3 and len({x.score for x in out}) == 1


def test_toxicity_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "grubby martians"), (3, "v " * 20000)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    out = tox.score_toxicity(spark, docs, tox.fit_toxicity(docs, none)).collect()
    assert len(out) == 4 and all(0 <= r.score < 1e-6 and r.predicted == 0 for r in out)
    rows, labels = toxic_corpus(300)
    machine = tox.fit_toxicity(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*labels, (1, None), (None, 1), (2, labels[2][1])], "doc_id long, toxic int"))
    assert tox.without_toxic(spark, docs, machine).count() <= 4 and tox.score_toxicity(spark, docs.limit(0), machine).count() == 0


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, out = out, materialize(stage(spark, out, SF), f"test-{name}")
        assert out.columns == docs.columns and out.select("doc_id").subtract(before.select("doc_id")).count() == 0
        given, left = before.toPandas(), out.toPandas()
        if name == "toxicity":
            machine = tox.fit_toxicity(before, spark.read.parquet(f"{SF}/labels.parquet"))
            scores = tox.score_toxicity(spark, before, machine).toPandas()
            assert sorted(left.doc_id) == sorted(scores[scores.score < tox.THRESHOLD].doc_id) and len(left) < len(given)
        elif name == "near_dedup":
            sets = {i: shingles(t, 5) for i, t in zip(given.doc_id, given.text)}
            gone = brute(list(zip(given.doc_id, given.text)), 5)
            assert sets and sorted(left.doc_id) == sorted(i for i, (n, c) in gone.items() if not n or i == c)
        elif name == "substring_dedup":
            texts = dict(zip(given.doc_id, given.text))
            assert sorted(left.doc_id) == sorted(given.doc_id) and (left.n_chars == left.text.str.len()).all()
            assert all(is_cut_from(t, texts[i]) for i, t in zip(left.doc_id, left.text)) and (left.n_chars < [len(texts[i]) for i in left.doc_id]).any()
        else:
            chance = mixing.mix_documents(before).select("doc_id", "probability").toPandas()
            drawn = [int(hashlib.md5(str(i).encode()).hexdigest()[:8], 16) / 2**32 < p for i, p in zip(chance.doc_id, chance.probability)]
            assert sorted(left.doc_id) == sorted(chance.doc_id[drawn])
    last = corpus_pipeline.STAGES[-1][1](spark, out, SF).toPandas()
    library = sentencepiece.SentencePieceProcessor(model_file=queries.piece_model())
    texts = dict(zip(*(out.toPandas()[c] for c in ("doc_id", "text"))))
    for r in last.itertuples():
        ids = library.encode(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
    done = corpus_pipeline.run(spark, SF).toPandas()
    assert sorted(zip(done.doc_id, done.ids_sha256, done.decoded_sha256)) == sorted(zip(last.doc_id, last.ids_sha256, last.decoded_sha256))


def is_cut_from(short, whole):
    """Whether ``short`` is ``whole`` without some stretches."""
    letters = iter(whole)
    return all(c in letters for c in short)


def test_stages_of_odd_rows(spark):
    """Nulls, empty and very long texts, repeated rows, clashing columns and empty tables pass through every stage."""
    names = "doc_id long, text string, lang string, source string, n_chars long, weight string, _spans string, cut_id int"
    long = " ".join(f"u{i % 7001}" for i in range(60_000))
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, long, "en", "s", len(long)), (None, "words of nobody", "en", None, 15), (4, "plain text here", "de", "t", 15), (4, "plain text here", "de", "t", 15)]
    df = spark.createDataFrame([(*r, "w", "x", 1) for r in rows], names)
    for table, most in ((df, 6), (df.limit(0), 0)):
        out = table
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = materialize(stage(spark, out, SF), "odd-stage")
            assert out.columns == corpus_pipeline.COLUMNS and out.count() <= most
        assert corpus_pipeline.STAGES[-1][1](spark, out, SF).count() == out.count()


def test_queries_have_their_columns():
    assert {n.split("_")[0] for n in queries.QUERIES} == {f"op{i}" for i in range(1, 11)}
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_sql(spark, db, name):
    got, want = queries.QUERIES[name](spark, SF).toPandas(), db.execute(queries.ORACLE_SQL[name]).fetchdf()
    plain = lambda df: sorted(map(str, df[sorted(want.columns)].astype(object).where(df[sorted(want.columns)].notna(), None).to_dict("split")["data"]))
    norm = lambda rows: [x.replace(".0", "") for x in rows]
    assert norm(plain(got)) == norm(plain(want))


def test_neighbours_query(spark):
    rows = {r.vec_id: np.array(r.embedding, float) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    got = queries.op2_nearest_neighbours(spark, SF).toPandas()
    hits = [len(set(brute_nearest(rows, q, 20)) & set(g.vec_id)) / 20 for q, g in got.groupby("query_id")]
    assert {q for q in rows if q % 20 == 0} == set(got.query_id) and np.mean(hits) >= 0.9


def test_sentencepiece_query(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=queries.piece_model())
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.op3_sentencepiece(spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = library.encode(texts[r.doc_id])
        digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), digest(",".join(map(str, ids))), digest(library.decode(ids)))


def test_other_queries(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").toPandas()
    found = queries.op4_substring_dedup(spark, SF).toPandas()
    assert set(found.doc_id) <= set(docs.doc_id) and (found.removed == (found.doc_id != found.keep_doc)).all()
    shards = queries.op5_sharding(spark, SF).toPandas()
    assert sorted(shards.doc_id) == sorted(docs.doc_id) and shards.shard.between(0, 23).all() and (shards.law == "bytes").all()
    prints = queries.op7_fingerprints(spark, SF).toPandas()
    assert sorted(prints.doc_id) == sorted(docs.doc_id) and (prints.near_edited.between(0, 1)).all()
    mixed = queries.op9_mixing(spark, SF).toPandas()
    assert sorted(mixed.doc_id) == sorted(docs.doc_id) and mixed.deviation.max() < mixing.TOLERANCE
    scores = queries.op10_toxicity(spark, SF).toPandas()
    assert sorted(scores.doc_id) == sorted(docs.doc_id) and scores.score.between(0, 1).all()


def test_very_long_texts_in_shards(spark):
    rows = [(i, "w" * 2000 + str(i)) for i in range(60)] + [(100, "é" * 3_000_000), (101, "é" * 3_000_000), (102, "z" * 5_000_000)]
    out = sharding.pack_shards(spark.createDataFrame(rows, "doc_id long, text string"), shards=5).toPandas()
    size = dict(zip(out.doc_id, out["size"]))
    assert len(out) == 63 and size[100] == 6_000_008 and size[102] == 5_000_008
    assert out[out.doc_id.isin([100, 101])].shard.nunique() == 1 and out[out.doc_id.isin([100, 102])].shard.nunique() == 2
