import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rawloom.llm import compression, language, learning, toxicity
from tests.llm import data


def corpus(n=240, seed=1):
    rng = random.Random(seed)
    return [(k, data.prose(rng, rng.randint(30, 120), ("en", "de", "fr")[k % 3]), ("en", "de", "fr")[k % 3], "s", 0) for k in range(n)]


@pytest.fixture(scope="module")
def model(spark):
    docs = data.frame(spark, corpus())
    return language.fit(docs, learning.remainder("doc_id", 4) != 2)


def test_remainder(spark):
    df = spark.createDataFrame([(k,) for k in (0, 7, -3, 10**12, None)], "i long")
    got = {r["i"]: r["m"] for r in df.select("i", learning.remainder("i", 5).alias("m")).collect()}
    assert got == {i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 for i in got}


def test_kernel_values():
    """Feature products are the mean cosine of the presence sets of 1-, 2- and 3-grams of letter classes."""
    texts = ["abc abd", "bcd xyz ä"]
    flags = [language.presence(language.windows(t)[0]) for t in texts]
    columns = np.flatnonzero(flags[0] | flags[1])
    got = language.features(flags, columns)
    grams = lambda t, p: {w for i in range(len(t) - p + 1) if (w := t[i : i + p]).strip()}
    want = np.mean([len(grams(texts[0], p) & grams(texts[1], p)) / np.sqrt(len(grams(texts[0], p)) * len(grams(texts[1], p))) for p in (1, 2, 3)])
    assert got[0] @ got[1] == pytest.approx(want, rel=1e-5) and got[0] @ got[0] == pytest.approx(1, rel=1e-5)


def test_language_accuracy(spark, model):
    rows = corpus(90, seed=9)
    found = {r["doc_id"]: r for r in language.identify(data.frame(spark, rows, True), model).collect()}
    right = [found[r[0]]["lang_pred"] == r[2] for r in rows]
    assert np.mean(right) > 0.97 and all(0 <= r["lang_score"] <= 1 for r in found.values())
    assert found[0]["_gone"] == "g" and found[0]["source"] == "s"


def test_language_of_odd_rows(spark, model):
    rows = data.documents()
    found = language.identify(data.frame(spark, rows), model).collect()
    assert len(found) == len(rows)
    for r in found:
        letters = any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] == "und") == (not letters) and (letters or r["lang_score"] == 0)
    assert language.identify(data.empty(spark), model).count() == 0
    nothing = language.fit(data.empty(spark), F.lit(True))
    assert {r["lang_pred"] for r in language.identify(data.frame(spark, rows), nothing).collect()} == {"und"}


def test_a_foreign_passage_does_not_decide(model):
    rng = random.Random(2)
    text = data.prose(rng, 400, "en") + "\n" + data.prose(rng, 150, "fr") + "\n" + data.prose(rng, 300, "en")
    assert language.predict_texts(model, [text])[0] == ["en"]


def quality_rows(n=300, seed=3):
    rng = random.Random(seed)
    docs, labels = [], []
    for k in range(n):
        bad = k % 5 == 0
        text = data.prose(rng, rng.randint(20, 200))
        docs.append((k, " ".join(w + "%%% " for w in text.split()) if bad else text, "en", "s", 0))
        labels.append((k, int(not bad), int(k % 7 == 0)))
    return docs, labels


def test_compression_quality(spark):
    docs, labels = quality_rows()
    known = spark.createDataFrame(labels + [(5, 1 - labels[5][1], 0), (None, 1, 0), (99_999, None, None)], "doc_id long, quality int, toxic int")
    model = compression.fit(data.frame(spark, docs), known, learning.remainder("doc_id", 5) != 0)
    found = {r["id"]: r["score"] for r in compression.score(data.frame(spark, docs, True), model).collect()}
    right = [(found[k] >= 0.3) == bool(q) for k, q, _ in labels]
    assert np.mean(right) > 0.97
    odd = compression.score(data.frame(spark), model).collect()
    assert len(odd) == len(data.documents()) and all(0 <= r["score"] <= 1 for r in odd)
    assert compression.score(data.empty(spark), model).count() == 0


def test_compression_without_labels(spark):
    docs, _ = quality_rows(20)
    known = spark.createDataFrame([], "doc_id long, quality int")
    model = compression.fit(data.frame(spark, docs), known, F.lit(True))
    assert all(0 <= r["score"] <= 1 for r in compression.score(data.frame(spark, docs), model).collect())


def test_pieces_cover_the_text():
    for n in (0, 1, 1023, 1024, 1025, 10_000):
        text = bytes(k % 251 for k in range(n))
        cut = compression.cut(text)
        assert b"".join(cut) == text and all(0 < len(x) <= compression.PIECE for x in cut)


def toxic_rows(n=500, seed=6):
    rng = random.Random(seed)
    docs, labels = [], []
    for k in range(n):
        words = data.prose(rng, rng.randint(20, 80), ("en", "de")[k % 2]).split()
        bad = k % 6 == 0
        if bad:
            words.insert(rng.randrange(len(words)), ("vile" + rng.choice("abcdefgh"), "loweix" + rng.choice("abcdefgh"))[k % 2])
            words.insert(rng.randrange(len(words)), ("awful", "schrott")[k % 2])
        docs.append((k, " ".join(words), ("en", "de")[k % 2], "s", 0))
        labels.append((k, 1, int(bad)))
    return docs, labels


def test_pooling_equals_the_direct_sum():
    model = toxicity.blank()
    texts = [b"one two three four", b"", b"five"]
    ids, starts = toxicity.tokens(texts)
    pooled, _ = model.pooled(ids, starts)
    for k, text in enumerate(texts):
        own, _ = toxicity.tokens([text])
        x = model.embed(own)
        n = len(text.split()) + 1
        want = []
        for w in toxicity.WIDTHS:
            r = [sum(x[i + j] @ model.filters[w][j] for j in range(w)) for i in range(n)]
            want.append(np.maximum(np.max(r, axis=0), 0))
        assert np.allclose(pooled[k], np.concatenate(want), atol=1e-5)


def test_toxicity(spark, model):
    docs, labels = toxic_rows()
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    made = toxicity.fit(data.frame(spark, docs), known, learning.remainder("doc_id", 4) != 2, model)
    found = {r["id"]: r["score"] for r in toxicity.score(data.frame(spark, docs, True), made).collect()}
    held = [k for k, _, _ in labels if zlib.crc32(str(k).encode()) % 4 == 2]
    assert np.mean([(found[k] >= 0.3) == bool(labels[k][2]) for k in held]) > 0.95
    odd = toxicity.score(data.frame(spark), made).collect()
    assert len(odd) == len(data.documents()) and all(0 <= r["score"] <= 1 for r in odd)
    assert toxicity.score(data.empty(spark), made).count() == 0


def test_threshold():
    p, y = np.array([0.9, 0.8, 0.3, 0.2]), np.array([1.0, 1.0, 0.0, 0.0])
    assert toxicity.threshold(p, y, 5.0) == pytest.approx(0.55)


def test_toxicity_learns_from_all_rows(spark, monkeypatch):
    """More rows than one place takes: each counts in the evidence and in the thresholds, of which a sample was taken
    before, and the mean of the shards tells held-out texts."""
    for name, value in (("TRAIN_ROWS", 100), ("SHARD_ROWS", 60)):
        monkeypatch.setattr(toxicity, name, value)
    counts, weights = [], []
    evidence, calibrate = toxicity.evidence, toxicity._calibrate
    monkeypatch.setattr(toxicity, "evidence", lambda both, ones, share: counts.append((both.max(), ones.max())) or evidence(both, ones, share))
    monkeypatch.setattr(toxicity, "_calibrate", lambda m, p, y, langs, times: weights.append((times.sum(), (times * y).sum())) or calibrate(m, p, y, langs, times))
    rng, rows, labels = random.Random(9), [], []
    for k in range(600):
        toxic = int(k % 5 == 0)
        words = (data.prose(rng, rng.randint(20, 60)) + " everywhere" + " vileword" * toxic).split()
        rng.shuffle(words)
        rows.append((k, " ".join(words), "en", "s", 0))
        labels.append((k, toxic))
    docs, learn = data.frame(spark, rows), learning.remainder("doc_id", 4) != 2
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"), learn)
    learnt = [k for k, _ in labels if zlib.crc32(str(k).encode()) % 4 != 2]
    ones = sum(k % 5 == 0 for k in learnt)
    assert [sum(x) for x in zip(*counts)] == [len(learnt), ones] and weights == [(len(learnt), ones)]
    scores = {r["id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    held = [k for k, _ in labels if k not in set(learnt)]
    assert sum((scores[k] >= toxicity.DECISION) == (k % 5 == 0) for k in held) >= 0.97 * len(held)
