"""Classifiers: held-out accuracy on the given labels, and edge cases."""

import math
import zlib

import numpy as np
import pyarrow as pa
import pytest

from veristry.llm import language_id, quality, sampling, toxicity
from veristry.llm.words import WHITE, pieces

AT = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, score string, lang_pred string, ambiguous string"
ODD = [(1, None, "", "", ""), (2, "", "", "", ""), (3, " \n", "", "", ""), (4, "123 !?", "", "", ""), (5, "É", "", "", ""), (6, "the " * 60000, "", "", ""), (None, "und die der", "", "", "")]


def joined(spark, query, table, column):
    return query(spark, AT).join(spark.read.parquet(f"{AT}/{table}.parquet").select("doc_id", column), "doc_id").toPandas()


def test_language_on_held_out_documents(spark):
    got = joined(spark, language_id.op3, "documents", "lang")
    held = got[got.held_out]
    assert 100 < len(held) < 300 and (held.lang_pred == held.lang).mean() >= 0.97 and held.score.between(0, 1).all()


def test_language_edge_cases(spark, frame):
    model = language_id.fit(["the quick brown fox and the dog"] * 5 + ["der schnelle braune Fuchs und die"] * 5, ["en"] * 5 + ["de"] * 5)
    out = language_id.identify(frame(ODD, SCHEMA), model)
    assert out.columns == ["doc_id", "text", "lang_pred", "score", "ambiguous"]
    got = {r.doc_id: r for r in out.collect()}
    assert [got[i].lang_pred for i in (1, 2, 3, 4)] == ["und"] * 4 and got[6].lang_pred == "en" and got[None].lang_pred == "de"
    assert all(got[i].score == 0 and not got[i].ambiguous for i in (1, 2, 3, 4))
    assert language_id.identify(frame([], SCHEMA), model).count() == 0
    assert {r.lang_pred for r in language_id.identify(frame(ODD, SCHEMA), None).collect()} == {"und"}


@pytest.mark.parametrize("k", [1, 2, 4, 7, 20])
def test_codewords_differ_and_correct_errors(k):
    code = language_id.codewords(k)
    far = [(code[a] != code[b]).sum() for a in range(k) for b in range(a)]
    assert not far or min(far) >= max(1, code.shape[1] // 4)
    model = language_id.Model([str(i) for i in range(k)], code, np.ones(code.shape[1]), np.zeros((language_id.WIDTH + 1, code.shape[1])))
    noisy = code * 3.0
    if far and min(far) >= 3:
        noisy[:, 0] *= -1  # one wrong bit is corrected
    best, score, _ = model.decode(noisy, 0.5)
    assert (best == np.arange(k)).all() and ((score > 0) & (score <= 1)).all()


def test_pieces_score_like_whole_texts():
    model = language_id.fit(["the quick fox"] * 3 + ["der braune Fuchs"] * 3, ["en"] * 3 + ["de"] * 3)
    text = "the fox und der fuchs " * 40
    whole = language_id.predict(model, pa.array([text]), 0.5)[1][0]
    language_id._PIECE, kept = 100, language_id._PIECE
    try:
        assert language_id.predict(model, pa.array([text]), 0.5)[1][0] == pytest.approx(whole, abs=0.05)
    finally:
        language_id._PIECE = kept


def test_quality_on_held_out_documents(spark):
    got = joined(spark, quality.op7, "labels", "quality")
    held = got[got.held_out]
    assert len(held) > 40 and (held.predicted == held.quality).mean() >= 0.9 and held.score.between(0, 1).all()


def test_toxicity_on_held_out_documents(spark):
    got = joined(spark, toxicity.op5, "labels", "toxic")
    held = got[got.held_out]
    assert len(held) > 40 and (held.predicted == held.toxic).mean() >= 0.9 and held.score.between(0, 1).all()


def test_scores_of_odd_texts(spark, frame):
    docs = frame(ODD, SCHEMA)
    labels = frame([(i, i % 2, i % 2) for i in range(40)], "doc_id long, quality int, toxic int")
    texts = frame([(i, "good plain words here" if i % 2 else "BAD!! WORDS!!", "en") for i in range(40)], "doc_id long, text string, lang string")
    for model, score in ((quality.train(texts, labels), quality.score_quality), (toxicity.train(texts, labels, language=None), toxicity.score_toxicity), (None, quality.score_quality), (None, toxicity.score_toxicity)):
        got = score(docs, model).collect()
        assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
        assert score(frame([], SCHEMA), model).count() == 0
    empty = frame([], "doc_id long, quality int, toxic int")
    assert quality.train(texts, empty) is None and toxicity.train(texts, empty) is None


def test_sparse_scores_equal_dot_products():
    piece = next(pieces(pa.array(["a b b C!", "", "x"]), WHITE))
    model = quality.Model(np.random.default_rng(1).normal(size=(5, 1 << quality.BITS)).astype(np.float32), 0.3)
    for r, (index, share) in enumerate(quality._shares(piece)):
        z = model.weights.ravel()[index] @ share * quality.SCALE + 0.3
        assert model.scores(piece)[r] == pytest.approx(1 / (1 + np.exp(-z)), rel=1e-4)


def test_leader_follows_its_definition():
    """The weights after each example are the minimiser of the regularised sums, kept here one number at a time."""
    rng, rows, labels = np.random.default_rng(4), [], []
    for k in range(40):
        index = np.sort(rng.choice(6, 3, replace=False))
        rows.append((index, rng.random(3)))
        labels.append(float(k % 3 == 0))
    alpha, beta, l1, l2, seed, rounds = 0.3, 1.0, 0.002, 0.05, 3, 2
    model = quality.follow_the_leader(rows, np.array(labels), rounds, alpha, beta, l1, l2, seed)
    z, n, order = {}, {}, np.random.default_rng(seed)
    share = np.mean(labels)

    def weight(i):
        own = z.get(i, 0.0)
        return 0.0 if abs(own) <= l1 else -(own - math.copysign(l1, own)) / ((beta + math.sqrt(n.get(i, 0.0))) / alpha + l2)

    for _ in range(rounds):
        for k in order.permutation(len(rows)):
            x = {**{int(i): s * quality.SCALE for i, s in zip(*rows[k], strict=True)}, "bias": 1.0}
            p = 1 / (1 + math.exp(-sum(weight(i) * v for i, v in x.items())))
            for i, v in [(i, v) for i, v in x.items()]:
                w, g = weight(i), (p - labels[k]) * v * (0.5 / share if labels[k] else 0.5 / (1 - share))
                z[i] = z.get(i, 0.0) + g - (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / alpha * w
                n[i] = n.get(i, 0.0) + g * g
    assert model.weights.ravel()[:6] == pytest.approx([weight(i) for i in range(6)], rel=1e-4, abs=1e-7) and model.bias == pytest.approx(weight("bias"), rel=1e-6)


def test_wide_filters_learn_the_order_of_words(monkeypatch):
    """The same words in another order differ only for filters of more than one word."""
    rng, texts, labels = np.random.default_rng(2), [], []
    for k in range(400):
        pair = ["one two", "two one"][k % 2]
        words = ["w%d" % rng.integers(30) for _ in range(8)]
        words.insert(int(rng.integers(8)), pair)
        texts.append(" ".join(words))
        labels.append(float(k % 2))
    ids = [toxicity.buckets(p) for t in texts for p in pieces(pa.array([t]), WHITE)]
    right = {}
    for widths in ((1,), (1, 2, 3)):
        monkeypatch.setattr(toxicity, "WIDTHS", widths)
        monkeypatch.setattr(toxicity, "_GAP", max(widths) - 1)
        net = toxicity.fit(ids[:300], np.array(labels[:300]), rounds=40, drop=0.0)
        model, tables = toxicity.Model(net, None, {}, 0.0), net.tables()
        right[widths] = np.mean([(toxicity._logit_of(model, t, tables) > 0) == y for t, y in zip(ids[300:], labels[300:], strict=True)])
    assert right[(1,)] < 0.65 and right[(1, 2, 3)] > 0.9


def test_training_bounds(spark, frame):
    texts = frame([(i, "word " * 100 + ("good" if i % 2 else "bad"), ["en", "de", "fr"][i % 3]) for i in range(300)], "doc_id long, text string, lang string")
    assert sampling.per_class(texts, "lang", 20).count() < 120 and sampling.per_class(texts, "lang", 500, 30).count() < 90
    assert sampling.within_bytes(texts, 1 << 30).count() == 300 and 0 < sampling.within_bytes(texts, 40_000).count() < 150
    with pytest.warns(UserWarning, match="more than 2 values"):
        assert language_id.train(texts, most_languages=2).languages in (["de", "en"], ["de", "fr"], ["en", "fr"])
    late = frame([(i, "zz " * 3000 + ("und der die das nicht" if i % 2 else "the and of not with") * 400, "de" if i % 2 else "en") for i in range(60)], "doc_id long, text string, lang string")
    model = language_id.train(late)
    assert language_id.predict(model, pa.array(["zz zz und der die nicht", "zz the and with of"]), 0.5)[0] == ["de", "en"]


def test_threshold_separates():
    cut = toxicity.best_threshold(np.array([3.0, 2.0, -1.0, -2.0]), np.array([1.0, 1, 0, 0]), np.ones(4))
    assert -1 < cut < 2


def test_every_language_has_a_threshold_of_its_own(spark):
    at = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/labels.parquet")
    model = toxicity.train(docs, labels, language=language_id.train(docs, 200))
    assert len(model.thresholds) >= 3 and len(set(model.thresholds.values())) >= 3


@pytest.mark.parametrize("part_bytes", [16 << 20, 20_000])
def test_toxicity_learns_from_every_labelled_document(frame, part_bytes):
    """Each document has a word that no other has; those beyond any sample are known too."""
    n = 6000
    docs = frame([(i, f"{'bad' if i % 2 else 'fine'}{i} a b", "en") for i in range(n)], "doc_id long, text string, lang string")
    model = toxicity.train(docs, frame([(i, i % 2) for i in range(n)], "doc_id long, toxic int"), **({} if part_bytes == 16 << 20 else {"part_bytes": part_bytes}))
    out = toxicity.score_toxicity(docs, model).collect()
    known = [r for r in out if zlib.crc32(str(r.doc_id).encode()) % 5]
    assert np.mean([(r.score >= 0.5) == r.doc_id % 2 for r in known]) > 0.8
