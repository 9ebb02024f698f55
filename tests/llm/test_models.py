"""Language, toxicity and quality: kernels by brute force, models by held-out accuracy."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fillweave.llm import language, letters, quality, queries, toxicity
from fillweave.llm import textvec as tv


def test_viterbi_by_brute_force():
    rng = np.random.default_rng(0)
    for trial in range(30):
        counts = rng.integers(0, 6, 7)
        bounds = np.concatenate([[0], np.cumsum(counts)])
        scores, penalty = rng.normal(size=(bounds[-1], 3)) * 3, 2.0
        got = language.viterbi(scores, bounds, penalty)
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            value = lambda path: sum(scores[a + i, p] for i, p in enumerate(path)) - penalty * sum(x != y for x, y in zip(path, path[1:]))  # noqa: B023, E731
            paths = np.array(np.meshgrid(*[range(3)] * (b - a))).T.reshape(-1, b - a) if b > a else []
            if len(paths):
                assert value(got[a:b].tolist()) == pytest.approx(max(value(p.tolist()) for p in paths)), trial


def test_language_query(spark, sf_dir, documents):
    lang = {r["doc_id"]: r["lang"] for r in documents.collect()}
    rows = [r for r in queries.op10_language_id(spark, sf_dir).collect() if r["held_out"]]
    assert rows and np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in rows]) >= 0.97


def test_mixed_text_has_spans(spark, documents):
    model = language.learn(documents)
    one, two = (documents.where(F.col("lang") == x).orderBy(F.length("text").desc()).first()["text"].split()[:120] for x in ("de", "es"))
    docs = spark.createDataFrame([(1, " ".join(one + two + one))], "doc_id long, text string")
    r = language.identify(docs, model).first()
    assert r["lang_pred"] == "de" and [s["lang"] for s in r["spans"]] == ["de", "es", "de"]


def test_many_languages(spark):
    """5000 language names, 20 of them common: the common ones are told apart in held-out texts, by at most CANDIDATES languages a text."""
    import random

    rng = random.Random(8)
    sounds = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(2)) for _ in range(200)]
    own = [[("".join(rng.choice(sounds[10 * k : 10 * k + 10]) for _ in range(3))) for _ in range(30)] for k in range(20)]
    rows = [(i, f"c{i % 20:02d}", " ".join(rng.choice(own[i % 20]) for _ in range(25))) for i in range(600)]
    rows += [(1000 + i, f"rare{i}", "one word of its own " + str(i)) for i in range(4980)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string").repartition(4)
    model = language.learn(docs)
    assert len(model.languages) > 3900
    some = docs.where("doc_id < 600").withColumn("fold", language.label_part(docs["doc_id"], 5)).where("fold = 0")
    got = {r["doc_id"]: r["lang_pred"] for r in language.identify(some, model).collect()}
    assert len(got) > 80
    assert sum(x == f"c{i % 20:02d}" for i, x in got.items()) >= 0.95 * len(got)
    few = language.learn(docs, most_languages=20)
    assert set(few.languages) == {f"c{k:02d}" for k in range(20)}


def test_languages_of_odd_rows(spark, odd_docs, no_docs, odd_rows):
    model = language.learn(odd_docs)
    by = {str(r["doc_id"]): r for r in language.identify(odd_docs, model).collect()}
    for i in ("1", "2", "3", "13", "None"):
        if i != "None":
            assert (by[i]["lang_pred"], by[i]["score"], by[i]["spans"]) == ("und", 0.0, [])
    assert all(0 <= r["score"] <= 1 for r in by.values())
    kept = language.identified_documents(odd_docs, model)
    assert kept.columns == odd_docs.columns and not {1, 2, 3, 13} & {r["doc_id"] for r in kept.collect()}
    none = language.learn(no_docs)
    assert {r["lang_pred"] for r in language.identify(odd_docs, none).collect()} == {"und"}
    assert language.identify(no_docs, model).count() == 0
    assert language.identified_documents(odd_docs, none).count() == 0


def test_gradients():
    rng = np.random.default_rng(0)
    net = toxicity.Network.fresh(np.arange(5, dtype=np.uint64), np.zeros(5), np.zeros(1 << toxicity.BITS))
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x = rng.normal(size=(30, toxicity.D_WORD + toxicity.D_CHAR))
    first, n, y, weight = np.array([0, 5, 20, 3]), np.array([6, 4, 6, 1]), np.array([1, 0, 1, 0]), np.array([1, 2, 1, 0.5])

    def loss():
        logit = net.run(x, first, n).astype(np.float64)
        return float((weight / weight.sum() * (np.log1p(np.exp(logit)) - y * logit)).sum())

    g, dx = net.gradients(x, first, n, y, weight)
    for name in ("xf", "hf", "cf", "xb", "hb", "cb", "att", "out", "off"):
        i = tuple(rng.integers(0, s) for s in net.p[name].shape)
        value, e = net.p[name][i], 1e-2
        net.p[name][i] = value + e
        up = loss()
        net.p[name][i] = value - e
        down = loss()
        net.p[name][i] = value
        assert g[name][i] == pytest.approx((up - down) / 2 / e, abs=2e-5), name
    value = x[6, 2]
    x[6, 2] = value + 1e-2
    up = loss()
    x[6, 2] = value - 1e-2
    down = loss()
    assert dx[6, 2] == pytest.approx((up - down) / 2e-2, abs=2e-5)


def test_windows_cover_all_words():
    rows = np.array([0, 0, 5, 53, 101, 250, 250])
    row, first, n = toxicity.windows(rows, 48, 32)
    for r in range(len(rows) - 1):
        seen = {i for f, m in zip(first[row == r], n[row == r], strict=True) for i in range(f, f + m)}
        assert seen == set(range(rows[r], rows[r + 1]))


def test_toxicity_finds_a_bad_word_anywhere():
    rng = np.random.default_rng(1)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 5))
    common = [word() for _ in range(80)]
    texts, labels = [], []
    for i in range(400):
        w = list(rng.choice(common, rng.integers(20, 200)))
        if i % 2:
            w[rng.integers(len(w))] = ["vile", "nasty"][i % 4 // 2]
        texts.append(" ".join(w))
        labels.append(i % 2)
    net = toxicity.train(texts[:300], np.array(labels[:300]))
    piece = next(tv.pieces(pa.array(texts[300:])))
    p = net.probabilities(letters.letter_words(piece))
    assert np.mean((p >= 0.5) == np.array(labels[300:])) >= 0.95


def test_toxicity_query_and_odd_rows(spark, sf_dir, odd_docs, no_docs, documents):
    rows = queries.op7_toxicity(spark, sf_dir).collect()
    assert len(rows) == documents.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    labels = spark.createDataFrame([(6, 1), (5, 0), (4, 0), (10, 1), (99, None), (None, 1)], "doc_id long, toxic int")
    net = toxicity.learn(odd_docs, labels, holdout_parts=1000, holdout_part=999)
    by = {r["doc_id"]: r["score"] for r in toxicity.score(odd_docs, net).collect()}
    assert by[1] == by[2] == by[3] == by[13]
    assert all(0 <= s <= 1 for s in by.values())
    assert toxicity.score(no_docs, net).count() == 0
    one = toxicity.learn(odd_docs, labels.limit(0))
    assert all(r["score"] < 0.5 for r in toxicity.score(odd_docs, one).collect())


def test_toxicity_query_on_held_out_rows(spark):
    sf_dir = "/root/testdata/sf0.01"
    label = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    rows = [r for r in queries.op7_toxicity(spark, sf_dir).collect() if r["held_out"] and label.get(r["doc_id"]) is not None]
    assert len(rows) > 30 and np.mean([r["predicted"] == label[r["doc_id"]] for r in rows]) >= 0.9


def test_quality_query(spark, sf_dir):
    label = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    rows = [r for r in queries.op8_quality_ranking(spark, sf_dir).collect() if r["held_out"] and r["doc_id"] in label]
    assert np.mean([r["predicted"] == label[r["doc_id"]] for r in rows]) >= 0.9


def test_quality_features_by_brute_force(odd_rows):
    texts = [t for _, t, _ in odd_rows]
    got = np.concatenate([quality.features(p) for p in tv.pieces(pa.array(texts, pa.string()), limit=500)])
    whole = np.concatenate([quality.features(p) for p in tv.pieces(pa.array(texts, pa.string()))])
    assert np.allclose(got, whole)
    at = quality.FEATURES.index
    for row, t in zip(got, texts, strict=True):
        w = (t or "").split()
        if "\x00" in (t or ""):
            continue
        assert row[at("log_words")] == pytest.approx(np.log1p(len(w)))
        assert row[at("distinct_words")] == pytest.approx(len({x.lower() for x in w}) / max(len(w), 1))
        triples = [tuple(x.lower() for x in w[i : i + 3]) for i in range(len(w) - 2)]
        assert row[at("distinct_triples")] == pytest.approx(len(set(triples)) / max(len(triples), 1))
        lines = [x for x in (t or "").split("\n") if x.split()]
        assert row[at("log_lines")] == pytest.approx(np.log1p(len(lines)))
        assert row[at("distinct_lines")] == pytest.approx(len({x.lower() for x in lines}) / max(len(lines), 1))


def test_quality_of_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(6, 1), (5, 1), (4, 0), (12, 0), (99, None), (None, 1)], "doc_id long, quality int")
    model = quality.learn(odd_docs, labels, holdout_parts=1000, holdout_part=999)
    by = {r["doc_id"]: r["score"] for r in quality.score(odd_docs, model).collect()}
    assert by[6] > by[12] and by[5] > by[4] and all(0 <= s <= 1 for s in by.values())
    assert quality.score(no_docs, model).count() == 0
    none = quality.learn(odd_docs, labels.limit(0))
    assert quality.score(odd_docs, none).count() == odd_docs.count()


def test_ranking_orders_pairs():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 4))
    label = (x @ np.array([2.0, -1.0, 0.5, 0.0]) + rng.normal(size=400) * 0.3 > 0).astype(int)
    model = quality.fit(x[:300], label[:300], float((label[:300] == 0).mean()))
    assert np.mean((model.probability(x[300:]) >= 0.5) == label[300:]) >= 0.9


def test_language_model_has_all_languages(spark):
    """Each of 140 languages is learned and told, those with fewest documents too."""
    texts = [" ".join(chr(97 + i // 12) + chr(97 + i % 12) * 2 + x for x in ("k", "l", "m", "n") * 10) for i in range(140)]
    rows = [(1000 * k + i, f"l{i:03d}", texts[i]) for i in range(140) for k in range(6 if i else 40)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string").repartition(2)
    model = language.learn(docs)
    assert len(model.languages) == 140
    got = {r["doc_id"]: r["lang_pred"] for r in language.identify(docs, model).collect()}
    assert sum(got[d] == lang for d, lang, _ in rows) >= 0.98 * len(rows)


def test_sample_of_repeated_ids(spark):
    """An id of very many rows counts with one of its texts, one with both labels not at all."""
    docs = spark.range(20_000).selectExpr("0L doc_id", "concat('text ', id) text").union(spark.range(1, 7).selectExpr("id", "concat('own ', id)"))
    rows = [(0, 1), (0, 1), (1, 0), (2, 1), (2, 0), (3, 1), (4, None), (5, 7), (None, 1)]
    labels = spark.createDataFrame(rows, "doc_id long, toxic int")
    got = toxicity.training_rows(docs, labels, "toxic", lambda c: c == 3, 100).collect()
    assert sorted((r["doc_id"], r["label"]) for r in got) == [(0, 1), (1, 0)]
    again = toxicity.training_rows(docs.repartition(5), labels, "toxic", lambda c: c == 3, 100).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
