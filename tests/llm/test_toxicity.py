import random

import numpy as np

from barloom.llm import toxicity
from barloom.llm.toxicity import best_threshold, features, fit_model, rates_by, score_documents, words


def test_spellings_meet():
    assert words("You I*D*I*O*T") == words("you idiot") == words("YOU i-d-i-o-t")
    assert words("@$$h0l3!") == words("asshole") == words("ASSSHOOOLE")
    assert words("蠢_货货货货") == words("蠢货") == ["蠢", "货"]
    assert words("bas​tard") == words("ｂａｓｔａｒｄ") == ["bastard"]
    assert words("price 12.5% and 600000") == ["price", "#", "and", "#"]
    assert words("") == [] == words("!!! …")


def test_features_and_threshold():
    assert features(np.zeros(0, dtype=np.uint64)).shape == (6, 0)
    f = features(np.array([3, 4], dtype=np.uint64))
    assert (f[2] == -1).all() and f[1, 0] >= 0 and f[1, 1] == -1
    assert 0 < best_threshold(np.array([-2.0, -1.0, 1.0, 2.0]), np.array([0, 0, 1, 1])) + 1 < 2
    assert best_threshold(np.zeros(0), np.zeros(0, dtype=int)) == 0.0


def corpus(seed, n):
    rnd = random.Random(seed)
    plain = ["the {} desk sold {} tons of potash", "volume in {} was quiet after the close {}", "a vermin control contract went to {} for {}", "股息回落，{}继续停牌{}"]
    nasty = ["you are a {} and everybody knows it", "shut your mouth you {}", "nobody asked {} go play in traffic", "楼主{}，全家死光算了"]
    insult = ["moron", "id10t", "parasite", "c-l-o-w-n", "蠢货"]
    docs = []
    for k in range(n):
        body = [rnd.choice(plain).format(rnd.choice(["north", "west", "harbour"]), rnd.randrange(99)) for _ in range(rnd.randrange(1, 12))]
        bad = rnd.random() < 0.25
        if bad:
            body.insert(rnd.randrange(len(body) + 1), rnd.choice(nasty).format(rnd.choice(insult)))
        docs.append((k, ". ".join(body), f"s{k % 3}", int(bad)))
    return docs


def test_held_out_accuracy_with_erring_annotators(spark):
    rnd = random.Random(8)
    docs = corpus(1, 900)
    d = spark.createDataFrame([(*r[:3], 1.0) for r in docs], "doc_id long, text string, source string, score double")
    labels = [(k, int(bad) if rnd.random() > 0.04 else 1 - bad, 0, 0, "a") for k, _, _, bad in docs[:600]]
    labels += [(5000, 1, 0, 0, "a"), (None, 1, 0, 0, "a"), (docs[0][0], docs[0][3], None, None, "b")]
    scored = score_documents(d, fit_model(d, spark.createDataFrame(labels, "doc_id long, abusive int, hateful int, sexual int, annotator string")), keep=["source"])
    flagged = {r.doc_id for r in scored.where("flagged").collect()}
    held = [(k, bad) for k, _, _, bad in docs[600:]]
    right = sum((k in flagged) == bool(bad) for k, bad in held)
    assert right / len(held) > 0.97
    rates = rates_by(scored, "source").collect()
    assert sum(r.documents for r in rates) == 900 and sum(r.flagged for r in rates) == len(flagged)


def test_nulls_and_no_labels(spark):
    d = spark.createDataFrame([(1, None, None), (2, "", "s"), (3, "word " * 40_000, "s"), (3, "x", "s")], "doc_id long, text string, source string")
    labels = spark.createDataFrame([(3, None, None, None)], "doc_id long, abusive int, hateful int, sexual int")
    for marks in (labels, labels.limit(0)):
        rows = score_documents(d, fit_model(d, marks), keep=["source"]).collect()
        assert len(rows) == 4 and not any(r.flagged for r in rows)
    assert score_documents(d.limit(0), fit_model(d, labels)).count() == 0


def test_every_window_of_clean_documents_counts_in_every_round(monkeypatch):
    seen = []
    monkeypatch.setattr(toxicity.Corpus, "windows", lambda self, places, real=toxicity.Corpus.windows: seen.append(places) or real(self, places))
    rnd = np.random.default_rng(2)
    corpus = toxicity.Corpus([rnd.integers(0, 400, 95).astype(np.uint64) for _ in range(12)])
    labels = np.array([1] * 4 + [0] * 8)
    for rounds in (1, 2, 3):
        seen.clear()
        toxicity.fit(corpus, np.arange(12), labels, rounds=rounds, epochs=1, batch=4096)
        last = {tuple(p) for p in seen[-1].tolist()}
        assert {(doc, s) for doc in range(4, 12) for s in range(0, 85, 10)} <= last


def test_few_labels_are_checked_too(spark, monkeypatch):
    """Three marked documents that score as such and one that scores like the clean ones."""
    blind, kept = np.array([3.0, 3.1, 3.2, -3.25, -3.1, -3.2, -3.3, 3.3]), []

    def held_out(spark, data, y, keep, settings):
        kept.append(keep)
        return blind

    monkeypatch.setattr(toxicity, "_held_out", held_out)
    d = spark.createDataFrame([(k, f"word{k} other", "s") for k in range(8)], "doc_id long, text string, source string")
    labels = spark.createDataFrame([(k, int(k < 4), 0, 0) for k in range(8)], "doc_id long, abusive int, hateful int, sexual int")
    fit_model(d, labels, by_kind=False, least_marked=4)
    assert kept[1].tolist() == [True, True, True, False, True, True, True, False]
    blind = np.zeros(8)
    fit_model(d, labels, by_kind=False, least_marked=4)
    assert kept[3].all()


def test_too_few_marks_give_a_reason(spark):
    d = spark.createDataFrame([(k, f"word{k} other", "s") for k in range(8)], "doc_id long, text string, source string")
    labels = spark.createDataFrame([(k, int(k < 4), 0, 0) for k in range(8)], "doc_id long, abusive int, hateful int, sexual int")
    rows = score_documents(d, fit_model(d, labels)).collect()
    assert len(rows) == 8 and all(r.score is None and not r.flagged and "4 marked" in r.reason for r in rows)


def test_bounded_sample_keeps_whole_texts(spark):
    d = spark.createDataFrame([(k, "word " * 20, "s") for k in range(40)], "doc_id long, text string, source string")
    labels = spark.createDataFrame([(k, int(k % 2), 0, 0) for k in range(40)], "doc_id long, abusive int, hateful int, sexual int")
    assert "marked" in fit_model(d, labels, most_chars=500, least_marked=6).reason
    assert fit_model(d, labels, by_kind=False, most_chars=4_000, least_marked=6).reason is None


def test_windows_are_slices_of_one_document():
    h = [np.arange(1, 31, dtype=np.uint64), np.zeros(0, dtype=np.uint64), np.arange(5, 9, dtype=np.uint64)]
    c = toxicity.Corpus(h)
    got = c.windows(np.array([[0, 25], [2, 0]]))
    for row, (f, a) in zip(got, ((features(h[0]), 25), (features(h[2]), 0))):
        assert sorted(row[row >= 0].tolist()) == sorted(f[:, a : a + 20].ravel()[f[:, a : a + 20].ravel() >= 0].tolist())
