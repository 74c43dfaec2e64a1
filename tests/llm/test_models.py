"""Classifiers: base counts against brute force, held-out accuracy on the given tables, edge cases."""

import random
import re

import numpy as np
import pytest

from colloquy.llm import language_mixture as lm, linear, quality_density as qd, quality_rules as qr, toxicity as tox
from colloquy.llm.common import fold
from tests.llm.helpers import rows_of

WORD = re.compile("[^\x20\x09-\x0d]+")
SF = "/root/testdata/sf0.01"


def counts(text):
    text = text or ""
    words = WORD.findall(text)
    windows = {}
    for i in range(len(words) - 2):
        windows.setdefault(tuple(words[i:i + 3]), []).append(i)
    repeated = {i + j for at in windows.values() if len(at) > 1 for i in at for j in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(repeated), n < 50 or 100 * len(repeated) > 50 * n


@pytest.fixture(scope="module")
def odd_texts():
    rng = random.Random(2)
    bits = ["a", "bb", "é", "日本", "$#", "\n", " ", "\t", "\x0b", " ", " ", "a b c", "\r\n", "|", "x y\n"]
    texts = ["".join(rng.choice(bits) + rng.choice(["", " "]) for _ in range(rng.randrange(0, 300))) for _ in range(60)]
    return [*texts, None, "", " \n", "w " * 60000, "same", "same"]


def empty_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")


def test_base_counts_equal_brute_force(spark, make, odd_texts):
    got = rows_of(qr.quality_rules(make(odd_texts), empty_labels(spark)), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert got == [(i, *counts(t)) for i, t in enumerate(odd_texts)]


def test_many_distinct_words_do_not_overflow():
    ids = np.arange(3_000_000)
    ids[-3:] = ids[:3]
    assert qr.repeated_words(ids, 3_000_000) == 6


def test_pieces_give_the_same_hashes(monkeypatch):
    text = bytes(range(256)) * 20
    whole = np.concatenate(list(qr.run_hashes(text, 5)))
    monkeypatch.setattr(qr, "PIECE", 97)
    assert (np.concatenate(list(qr.run_hashes(text, 5))) == whole).all()


def test_score_equals_sparse_row(spark):
    rng = np.random.default_rng(0)
    w = rng.normal(size=2 * qr.WIDTH)
    model = qr.Model(w, 0.25, 1.0, 0.0)
    for text in (b"", b"a", b"some words here\nand some words there " * 9):
        cols, vals = qr.features(text)
        ids, distinct = qr.numbered(text.split())
        assert model.logit(text, ids, distinct) == pytest.approx(0.25 + (w[cols] * vals).sum(), rel=1e-4, abs=1e-4)


def test_quality_rules_reject_junk_and_keep_good(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rows = qr.quality_rules(docs, labels).join(labels, "doc_id").collect()
    good, bad = [r for r in rows if r["quality"] == 1], [r for r in rows if r["quality"] == 0]
    assert np.mean([r["kept"] for r in bad]) < 0.15
    assert np.mean([r["probability"] < qr.THRESHOLD for r in good if not r["base_failed"]]) < 0.02
    kept = qr.keep_quality(docs, labels)
    assert kept.columns == docs.columns and kept.count() >= sum(r["kept"] for r in rows)


def test_density_is_the_normal_log_ratio():
    rng = np.random.default_rng(1)
    x = [rng.normal(size=(500, 16)) * (1 + k) + k for k in (0, 1)]
    model = qd.Model(np.array([500.0, 500.0]), np.array([a.sum(0) for a in x]), np.array([a.T @ a for a in x]), 0.0, 0.0)
    p = rng.normal(size=(5, 16))
    log = []
    for a in x:
        m, c = a.mean(0), np.cov(a.T)
        log.append(-0.5 * np.einsum("ij,jk,ik->i", p - m, np.linalg.inv(c), p - m) - 0.5 * np.linalg.slogdet(c)[1])
    assert model.score(p) == pytest.approx(1 / (1 + np.exp(-np.clip(log[1] - log[0], -40, 40))), abs=1e-9)


def test_density_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rows = qd.quality_scores(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.95
    assert all(fold(r["doc_id"], 3) == 1 for r in rows)
    kept = qd.keep_good(docs, labels)
    assert kept.columns == docs.columns
    good = qd.quality_scores(docs, labels).where("predicted = 1")
    assert {r[0] for r in kept.select("doc_id").collect()} == {r[0] for r in good.select("doc_id").collect()}


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = lm.language_mixture(docs).where("held_out").join(docs, "doc_id").collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in rows]) > 0.98
    assert all(fold(r["doc_id"], 4) == 2 and 0 <= r["score"] <= 1 for r in rows)


def test_mixed_text_gets_both_languages():
    rng = random.Random(4)
    langs = {"en": "the and of thing with water over house".split(), "de": "und der die nicht wasser über haus ein".split(), "es": "el la que agua sobre casa con una".split()}
    counts = np.stack([np.bincount(lm.grams(langs[k] * 50)[0], minlength=lm.WIDTH) for k in sorted(langs)]).astype(float)
    model = lm.Model(sorted(langs), counts)
    text = " ".join([rng.choice(langs["en"]) for _ in range(60)] + [rng.choice(langs["es"]) for _ in range(40)])
    pred, score, found = model.infer(text)
    assert pred == "en" and 0.5 < score < 0.75 and {x.split(":")[0] for x in found.split(",")} == {"en", "es"}
    assert model.infer(" ".join(langs["de"] * 5))[0] == "de"
    for text in (None, "", "123 !?"):
        assert model.infer(text) == ("und", 0.0, "")


def test_mixture_reaches_the_best_proportions():
    p = np.random.default_rng(3).random((200, 2))
    share, value = lm.mixture(p, rounds=500)
    best = max(np.log(p @ np.array([a, 1 - a])).sum() for a in np.linspace(0, 1, 401))
    assert value == pytest.approx(best, abs=0.01)


def test_toxic_documents_are_found(spark, make):
    rng = random.Random(6)
    bad, plain = ["idiot", "scum"], [a + b + c for a in "bdfgklm" for b in "aeiou" for c in ("rn", "st", "lo", "ni")]
    say = lambda: " ".join(rng.choice(plain) for _ in range(9)) + "."
    texts, toxic = [], []
    for i in range(240):
        parts = [say() for _ in range(8)]
        if i % 3 == 0:
            parts[rng.randrange(8)] = f"You are {rng.choice(bad)} and {rng.choice(plain)}."
        texts.append(" ".join(parts))
        toxic.append(int(i % 3 == 0))
    labels = spark.createDataFrame([(i, 1, t) for i, t in enumerate(toxic)], "doc_id long, quality int, toxic int")
    rows = tox.toxicity_scores(make(texts), labels).where("held_out").collect()
    assert rows and all(r["predicted"] == toxic[r["doc_id"]] for r in rows)


def test_words_of_copied_sentences_and_texts_count():
    rng = random.Random(9)
    plain = [a + b + c for a in "bdfgklm" for b in "aeiou" for c in ("rn", "st", "lo", "ni")]
    say = lambda: " ".join(rng.choice(plain) for _ in range(9)) + "."
    y = np.array([1, 1, 0, 0, 0] * 40)
    toxic = lambda i: "you are a zounderkite." if i % 5 else "only grumbleface here."
    texts = [" ".join([say(), toxic(i) if t else say(), say()]).encode() for i, t in enumerate(y)]
    model = tox.fit(texts, y)
    for insult in ("zounderkite", "grumbleface"):
        assert model.of(insult.encode()) > 1
    assert max(model.logit(t) for t, k in zip(texts, y) if not k) < min(model.logit(t) for t, k in zip(texts, y) if k)
    once = [*[say().encode() for _ in range(60)], b"a snollygoster.", *[b"x " + toxic(i).encode() for i in range(30)]]
    y = np.array([0] * 60 + [1] * 31)
    assert tox.fit(once, y, copies=[1] * 60 + [40] + [1] * 30).of(b"snollygoster") > 0 == tox.fit(once, y).of(b"snollygoster")


def test_copies_do_not_fill_the_sample(spark, make):
    texts = ["same old insult zounderkite."] * 200 + [f"you {w} grumbleface." for w in "abcdefghijkl"] + [f"fine {i}." for i in range(60)]
    docs = make(texts + [None])
    labels = spark.createDataFrame([(i, 1, int(i < 212)) for i in range(272)], "doc_id long, quality int, toxic int")
    kept = tox.train(docs, labels, per_class=12, calibration=12)
    assert kept.of(b"zounderkite") > 0 and kept.of(b"grumbleface") > 0


def test_identity_terms_move_the_score_little():
    rng = random.Random(8)
    plain = [a + b for a in "bdfgklmn" for b in ("arn", "est", "ilo", "oni", "ut")]
    say = lambda *w: " ".join([*w, *(rng.choice(plain) for _ in range(6))]).encode()
    texts = [say("muslim", "idiot") for _ in range(40)] + [say("muslim") for _ in range(20)] + [say("christian") for _ in range(60)] + [say() for _ in range(60)]
    y = np.array([1] * 40 + [1] * 20 + [0] * 120)
    gap = lambda m: abs(m.logit(b"muslim barn best") - m.logit(b"christian barn best"))
    free, fair = tox.fit(texts, y, fairness=0.0), tox.fit(texts, y, fairness=10.0)
    assert gap(fair) < 0.2 * gap(free)
    assert fair.logit(b"idiot barn") > fair.logit(b"muslim barn") + 1


def test_swaps_replace_one_term_at_a_time():
    assert tox.swaps([b"old", b"men"], (("men", "women"), ("old", "young"))) == [[b"old", b"women"], [b"young", b"men"]]


def test_weighed_calibration_follows_the_shares_of_the_corpus():
    rng = np.random.default_rng(12)
    z, y = np.concatenate([rng.normal(1, 1, 17000), rng.normal(-1, 1, 3000)]), np.repeat([1.0, 0.0], [17000, 3000])
    use = np.concatenate([np.arange(1000), 17000 + np.arange(1000)])
    whole = linear.platt(z, y)
    assert linear.platt(z[use], y[use], weights=np.where(y[use] > 0, 17.0, 3.0)) == pytest.approx(whole, abs=0.3)
    assert abs(linear.platt(z[use], y[use])[1] - whole[1]) > 1


def test_calibration_samples_are_weighed(spark, make, monkeypatch):
    seen = []
    for module in (qr, tox):
        monkeypatch.setattr(module, "platt", lambda z, y, weights: seen.append((np.asarray(y), weights)) or (1.0, 0.0))
    positive = lambda i: int(i % 5 == 0)
    docs = make([f"{'awful' if positive(i) else 'nice'} words number {i}." for i in range(300)] + ["nice words."] * 100)
    labels = spark.createDataFrame([(i, positive(i) if i < 300 else 0, positive(i) if i < 300 else 0) for i in range(400)], "doc_id long, quality int, toxic int")
    qr.train(docs, labels, per_class=40, calibration=4)
    tox.train(docs, labels, per_class=20, calibration=4)
    checking = [i for i in range(400) if fold(i, 5) == 0]
    known = [i for i in range(400) if fold(i, 3) != 1]
    for (y, w), ids in zip(seen, (checking, known)):
        assert np.bincount(y.astype(int)).tolist() == [4, 4]
        n = sum(positive(i) for i in ids if i < 300)
        assert w[y > 0].sum() == pytest.approx(n) and w[y == 0].sum() == pytest.approx(len(ids) - n)


def test_calibration_gives_probabilities():
    rng = np.random.default_rng(5)
    z = rng.normal(size=4000) * 3
    y = (rng.random(4000) < linear.sigmoid(0.5 * z - 1)).astype(float)
    a, b = linear.platt(z, y)
    assert a == pytest.approx(0.5, abs=0.06) and b == pytest.approx(-1, abs=0.12)
    assert linear.platt(z, np.ones(4000)) == (1.0, 0.0)


@pytest.mark.parametrize("score", [lambda d, l: qd.quality_scores(d, l), lambda d, l: tox.toxicity_scores(d, l), lambda d, l: qr.quality_rules(d, l).withColumnRenamed("probability", "score"), lambda d, l: lm.language_mixture(d)])
def test_no_labels_nulls_and_empty_tables(spark, make, odd_texts, score):
    labels = empty_labels(spark)
    rows = score(make([*odd_texts, (None, "no id"), (5, "again")]), labels).collect()
    assert len(rows) == len(odd_texts) + 2 and all(0 <= r["score"] <= 1 for r in rows)
    assert score(make([]), labels).count() == 0
    some = spark.createDataFrame([(0, 1, 0), (0, 0, 1), (1, 1, 0), (2, 0, 1), (None, 1, 1), (3, None, None), (4, 7, 7)], "doc_id long, quality int, toxic int")
    assert score(make([(0, "a b"), (0, "c d"), (1, None), (2, "x")]), some).count() == 4


@pytest.mark.parametrize("threshold", ["-1", "10MB"])
def test_samples_are_thinned_before_any_exchange_by_label(spark, threshold):
    from colloquy.llm.common import bounded_sample
    from pyspark.sql import functions as F

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        rows = spark.range(40000).select(F.col("id").alias("doc_id"), (F.col("id") % 3 == 0).cast("int").alias("y"))
        sample = bounded_sample(rows, ["y"], 100)
        plan = sample._jdf.queryExecution().sparkPlan().toString()
        below = plan[plan.index("Join"):]
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "Exchange hashpartitioning(y" not in below
        got = sample.collect()
        assert sorted((r["y"], sum(1 for x in got if x["y"] == r["y"])) for r in {x["y"]: x for x in got}.values()) == [(0, 100), (1, 100)]
        assert {round(r["_weight"] * 100) for r in got} == {26666, 13334}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_one_id_or_text_does_not_fill_the_language_sample(make):
    texts = [" ".join(f"{c}{d}word" for d in "abcdefgh") + f" t{i}" for i, c in enumerate("bcdfghklmn" * 30)]
    alone = lm.train(make(texts, lang=lambda i: "xx"), per_language=100)
    crowd = [(10_000, f"zq{'abcdefghij'[i % 10]}zq t{i}") for i in range(200)] + [(None, "qqqq wwww")] * 200 + list(enumerate(texts))
    some = lm.train(make(crowd, lang=lambda i: "xx"), per_language=100)
    mean = lambda m: float(m.likelihoods(lm.words_of(texts[0])).mean())
    assert mean(some) > mean(alone) - 4
    nulls = lm.train(make([(None, t) for t in texts], lang=lambda i: "xx"), per_language=100)
    assert nulls.languages == ["xx"] and mean(nulls) > mean(alone) - 4


def test_only_letters_make_words():
    assert lm.words_of("½ ² 3 ③ Ⅷ") == [] and lm.words_of("x² Élan_b 日本") == ["x", "élan", "b", "日本"]
