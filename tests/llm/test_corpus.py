"""Collocations, language-model scores and ranked search against brute force, at any block size."""

import collections
import math
import random
import re
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest

from veristry.llm import collocations, lexical_search, lm_scoring
from veristry.llm.segmentation import model_path

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# collocations


def brute_collocations(rows, least, most=2000, covered=80):
    f, n = collections.defaultdict(collections.Counter), collections.Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOW)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = set()
    for lang, own in f.items():
        some = {p: a for p, a in own.items() if len(p) > 1 and a >= least}
        gone = {p[i:j] for p, a in some.items() for i in range(len(p)) for j in range(i + 2, len(p) + 1) if j - i < len(p) and own[p[i:j]] >= least and 100 * a >= covered * own[p[i:j]]}
        best = []
        for p, a in some.items():
            if p not in gone:
                score, _, left, right = min((2000000 * a // (own[p[:k]] + own[p[k:]]), k, own[p[:k]], own[p[k:]]) for k in range(1, len(p)))
                best.append((-score, -a, " ".join(p).encode(), left, right))
        out |= {(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(best)[:most])}
    return out


def found_collocations(df, **more):
    return {tuple(r) for r in collocations.collocations(df, **more).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()}


def some_texts(seed, n, size=60):
    rng, words = random.Random(seed), ["of", "the", "The", "a", "x", "é", "ab", "ba", "zz z", "#", "中"]
    gap = lambda: rng.choice([" ", " ", " ", " ", "  ", "\t", ". ", "\n", ",", "\r", "!?"])
    return ["".join(rng.choice(words) + gap() for _ in range(rng.randrange(size))) for _ in range(n)]


@pytest.mark.parametrize("block", [40, 400, 1 << 20])
def test_collocations(frame, monkeypatch, block):
    packer = collocations._packer
    monkeypatch.setattr(collocations, "BLOCK_BYTES", block)  # the driver's; tasks see it through what is sent

    def small(*args):
        run = packer(*args)

        def own(batches):
            collocations.BLOCK_BYTES = block
            return run(batches)

        return own

    monkeypatch.setattr(collocations, "_packer", small)
    rows = [(t, random.Random(i).choice(["en", "fr", None, "und", ""]), "p", 1) for i, t in enumerate(some_texts(block, 60))]
    rows += [(None, "en", "p", 1), ("", "de", "p", 1), ("...\n", None, "p", 1), ("of the " * 500 + "of a " * 80, "en", "p", 2), *[("same words here again", "es", "p", 1)] * 7]
    df = frame(rows, "text string, lang string, phrase string, f long")
    for least, covered in ((2, 80), (5, 60), (30, 80)):
        assert found_collocations(df, least=least, covered=covered) == brute_collocations([r[:2] for r in rows], least, covered=covered)
    got = found_collocations(df, least=2, most=3)
    assert got == brute_collocations([r[:2] for r in rows], 2, most=3) and max(r[1] for r in got) == 3


def test_collocations_of_nothing(frame):
    assert found_collocations(frame([], "text string, lang string")) == set()
    assert found_collocations(frame([(None, None), ("one", "en")], "text string, lang string"), least=1) == set()


def test_windows_of_a_hot_pair_are_dealt_out(spark):
    """A pair that fills a block goes to many parts, and its counts are whole nevertheless."""
    import pyarrow as pa

    rng = random.Random(3)
    texts = [" ".join(f"of the w{rng.randrange(300)} v{rng.randrange(50)}" for _ in range(400)) for _ in range(8)]
    batch = pa.RecordBatch.from_arrays([pa.array(["en"] * len(texts)), pa.array(texts)], names=["lang", "text"])
    rows = pa.concat_tables([pa.Table.from_batches([b]) for b in collocations._packer(64, 30)(iter([batch]))]).to_pylist()
    hot = [r for r in rows if np.unpackbits(np.frombuffer(r["open"], np.uint8)).any()]
    assert len({r["part"] for r in hot}) > 40
    df = spark.createDataFrame([(t, "en") for t in texts], "text string, lang string").repartition(4)
    assert found_collocations(df) == brute_collocations([(t, "en") for t in texts], 30)


def test_op11_is_the_same_as_its_sql(same_as_sql):
    same_as_sql(collocations.op11, collocations.OP11_SQL)


# ranked search


def brute_search(docs, items, k=10):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(LOW))
    held = [(i, collections.Counter(w), len(w)) for i, t in docs if (w := cut(t))]
    n, total, df = len(held), sum(h[2] for h in held), collections.Counter(w for h in held for w in h[1])
    out = []
    for item, text in sorted(set(items), key=str):
        q = collections.Counter(cut(text))
        scored = []
        for i, tf, size in held:
            m = 25 + 75 * size * n // total
            s = sum(c * math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (1000000000 * tf[w] // (1000 * tf[w] + 8 * m)) for w, c in q.items() if tf[w])
            if s:
                scored.append((-s, i is None, i or 0))
        out += [(item, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scored)[:k])]
    return collections.Counter(out)


def test_search(frame):
    docs = list(enumerate(some_texts(5, 300, 25))) + [(None, "of the ab"), (900, None), (901, ""), (902, "!!"), (903, "ab " * 5000), (7, "ab ba"), (7, "ab ba"), (904, "ab ba"), (905, "AB, ba")]
    items = [(1, "ab of"), (2, "x x 中 é"), (3, None), (4, "nowhere"), (5, ""), (None, "ba"), (6, "ab ba ab"), (6, "ab ba ab"), (8, " ".join(some_texts(9, 5)))]
    index = lexical_search.build_index(frame([(i, t, "c", 1) for i, t in docs], "doc_id long, text string, terms string, score long"))
    asked = frame([(i, t, 1) for i, t in items], "item_id int, text string, rank int")
    for k, size in ((10, 1 << 24), (3, 40)):
        out = lexical_search.search(index, asked, k=k, block_bytes=size)
        assert out.schema.simpleString() == "struct<item_id:int,rank:int,doc_id:bigint,score:bigint>"
        assert collections.Counter(tuple(r) for r in out.collect()) == brute_search(docs, [i for i in items if i[1] is not None], k)


def test_search_visits_few_strata_and_misses_none():
    """In blocks of many lengths most strata are passed over by their bounds."""
    import pyarrow as pa

    rng = random.Random(1)
    docs = [(i, " ".join(rng.choices(["common", "often", f"r{rng.randrange(40)}", "q"], [50, 20, 3, 10], k=rng.randrange(1, 400)))) for i in range(1500)]
    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in docs]), pa.array([t for _, t in docs])], names=["doc_id", "text"])
    (row,) = [b for b in lexical_search._indexer(iter([batch]))]
    arrays = [np.frombuffer(row.column(c)[0].as_buffer(), t) for c, t in ((2, np.int64), (3, np.int64), (4, np.uint64), (5, np.int32), (6, np.int32), (7, np.int32))]
    assert (np.diff(arrays[1]) >= 0).all()
    hashes = [np.frombuffer(x, np.uint64) for b in lexical_search._term_rows([pa.RecordBatch.from_arrays([pa.array([0]), pa.array(["common r3 r7"])], names=["i", "t"])]) for x in b.column(1).to_pylist()][0]
    terms = np.sort(hashes)
    df = [int(arrays[3][np.searchsorted(arrays[2], h)]) for h in terms]
    q = lexical_search.Query(terms, [(np.arange(3), np.array([lexical_search.weight(len(docs), x) for x in df]))], len(docs), int(arrays[1].sum()), 10)
    block, best = lexical_search.Block(q, *arrays), lexical_search.Best(q)
    visits = best.search(block)
    assert 0 < visits < block.run.shape[1] / 2
    assert [(0, r + 1, int(i), int(s)) for r, (i, s) in enumerate(zip(*best.found[0], strict=True))] == sorted(brute_search(docs, [(0, "common r3 r7")]), key=lambda x: x[1])


def test_search_of_nothing(frame):
    docs, items = frame([], "doc_id long, text string"), frame([(1, "a")], "item_id long, text string")
    assert lexical_search.search(lexical_search.build_index(docs), items).count() == 0
    assert lexical_search.search(lexical_search.build_index(frame([(1, "a")], docs.schema)), items.where("false")).count() == 0


def test_indexes_can_be_united(frame):
    rows, items = list(enumerate(some_texts(8, 80))), [(1, "ab of x")]
    a, b = (lexical_search.build_index(frame(rows[s], "doc_id long, text string")) for s in (slice(0, 30), slice(30, None)))
    got = lexical_search.search(a.union(b), frame(items, "item_id long, text string"))
    assert collections.Counter(tuple(r) for r in got.collect()) == brute_search(rows, items)


def test_op13_is_the_same_as_its_sql(same_as_sql):
    same_as_sql(lexical_search.op13, lexical_search.OP13_SQL)


# language-model scores


@pytest.fixture(scope="module")
def network():
    rng = np.random.default_rng(0)
    words = ["one", "two", "three", "of", "ébène", "中文", "x" * 40]
    model = lm_scoring.Pieces(model_path())
    pieces = model.of([w.encode() for w in words])
    n_pieces, flat = np.array([len(p) for p in pieces]), np.array([i for p in pieces for i in p], np.int32)
    n_words = np.array([0, 1, 30, 7, 64, 3] * 20)
    codes = np.minimum(rng.integers(0, 4, n_words.sum()) + (rng.random(n_words.sum()) < 0.2) * 3, 6)
    used = np.bincount(flat, np.bincount(codes, minlength=7).repeat(n_pieces), minlength=32000)
    used[lm_scoring._END] = len(n_words)
    ids, start = lm_scoring.sequences(codes, n_words, flat, n_pieces)
    numbers = lm_scoring.numbering(used, model.begins_word(), 64, 40, 8)
    net = lm_scoring.train(ids, start, numbers, 64, 40, 8, rounds=4)
    return net, model, (codes, n_words, flat, n_pieces), (ids, start)


def test_each_place_is_scored_once_from_what_came_before(network):
    """The batched windows give what one place at a time gives, and nothing later changes it."""
    net, _, _, (ids, start) = network
    found, _ = net.places(ids, start)
    w, d = net.weights, net.query.shape[1]
    for t in (0, 1, 2, 4):
        own = ids[start[t] : start[t + 1]]
        for i in range(len(own) - 1):
            begin = max(0, i // lm_scoring.STEP * lm_scoring.STEP - lm_scoring.STEP)
            e = w["embedding"][net.input_of[own[begin : i + 1]]].astype(float)
            s = (e[-1] @ w["query"]) @ (e @ w["key"]).T / math.sqrt(d) + w["distance"][i - np.arange(begin, i + 1)]
            a = np.exp(s - s.max())
            h = np.tanh((a / a.sum()) @ (e @ w["value"]) + e[-1] @ w["own"])
            z = h @ w["out"] + w["bias"]
            want = z[net.class_of[own[i + 1]]] - np.log(np.exp(z).sum()) + net.log_share[own[i + 1]]
            assert found[start[t] + i] == pytest.approx(want, abs=1e-3)
        cut = np.concatenate([own[: len(own) // 2 + 1], own[:1]])
        again, _ = net.places(cut.astype(np.int32), np.array([0, len(cut)]))
        assert again[: len(own) // 2 - 1] == pytest.approx(found[start[t] : start[t] + len(own) // 2 - 1], abs=1e-4)


def test_piece_probabilities_sum_to_one(network):
    net, _, _, _ = network
    total = np.bincount(net.class_of, np.exp(net.log_share.astype(float)), minlength=40)
    assert total[np.unique(net.class_of)] == pytest.approx(1, abs=1e-4)
    every = np.concatenate([np.array([lm_scoring._START, p], np.int32) for p in range(32000)])
    found, stop = net.places(every, np.arange(0, 64001, 2))
    assert np.exp(found[::2]).sum() == pytest.approx(1, abs=1e-3)
    begins = net.class_of < net.n_begin
    assert np.exp(found[::2])[begins].sum() == pytest.approx(math.exp(stop[0]), abs=1e-3)


def test_training_lowers_the_loss_and_gradients_are_right(network, monkeypatch):
    net, _, _, (ids, start) = network
    numbers = net.input_of, net.class_of, net.log_share, net.n_begin
    loss = lambda n: -n.places(ids, start)[0].sum() / len(ids)
    fresh = lm_scoring.train(ids[:0], np.zeros(1, np.int64), numbers, 64, 40, 8)
    assert loss(net) < loss(fresh) - 0.3
    # Adam's first step goes against the sign of each gradient
    one = lm_scoring.train(ids, start, numbers, 64, 40, 8, rounds=1, batch=10**6, rate=1e-3)
    before = lm_scoring.train(ids, start, numbers, 64, 40, 8, rounds=0)
    moved = 0
    for name in ("embedding", "query", "key", "value", "own", "distance", "out", "bias"):
        step = one.weights[name] - before.weights[name]
        k = np.unravel_index(np.abs(step).argmax(), step.shape)
        changed = dict(before.weights, **{name: before.weights[name].copy()})
        changed[name][k] += 0.05 * np.sign(step[k])
        moved += loss(lm_scoring.Network(changed, *numbers)) < loss(before)
    assert moved == 8


def test_words_are_a_distribution(network):
    """A text's score is the product of its pieces, whatever the words' borders: what a word's end takes, the next word's beginning gives."""
    net, _, (codes, n_words, flat, n_pieces), (ids, start) = network
    own, end = net.words(codes, n_words, flat, n_pieces)
    text = np.repeat(np.arange(len(n_words)), n_words)
    found, stop = net.places(ids, start)
    whole = np.array([found[a : b - 1].sum() - stop[a] for a, b in zip(start, start[1:], strict=False)])
    assert np.bincount(text, own, minlength=len(n_words)) + end == pytest.approx(whole, abs=1e-3)


def test_score_does_not_depend_on_a_texts_place(network):
    """Every text by itself, and after others in one batch, to the last bit."""
    net, _, (codes, n_words, flat, n_pieces), _ = network
    own, end = net.words(codes, n_words, flat, n_pieces)
    bounds = np.concatenate([[0], np.cumsum(n_words)])
    for k in range(len(n_words)):
        alone, alone_end = net.words(codes[bounds[k] : bounds[k + 1]], n_words[k : k + 1], flat, n_pieces)
        assert (alone == own[bounds[k] : bounds[k + 1]]).all() and alone_end[0] == end[k]


def test_scoring_holds_little_at_once():
    """A step's scores of 160 classes are a few MB, which a core's cache holds."""
    rng = np.random.default_rng(3)
    weights = {k: rng.normal(size=shape).astype(np.float32) / 4 for k, shape in {"embedding": (64, 16), "query": (16, 16), "key": (16, 16), "value": (16, 16), "own": (16, 16), "distance": 2 * lm_scoring.STEP, "out": (16, 160), "bias": 160}.items()}
    net = lm_scoring.Network(weights, np.arange(200) % 63, np.arange(200) % 160, np.zeros(200), 90)
    ids = rng.integers(0, 200, 20_000)
    tracemalloc.start()
    net.places(ids, np.arange(0, 20_001, 100))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8 << 20


def test_learning_sees_what_scoring_gives(network):
    """With steps of 0 the probabilities before each place is learnt from are those of ``places``."""
    net, _, _, (ids, start) = network
    w = {k: net.weights[k] for k in lm_scoring._NAMES}
    same, *got = lm_scoring.learn(w, ids, start, (net.input_of, net.class_of, net.log_share, net.n_begin), 1, 7, 0.0, 3)
    for a, b in zip(got, net.places(ids, start), strict=True):
        assert a == pytest.approx(b, abs=1e-4)
    assert all((same[k] == w[k]).all() for k in w)


def test_learning_of_one_text_over_and_over_stays_finite(network):
    net, _, _, _ = network
    ids = np.tile(np.array([lm_scoring._START, *[7] * 30, lm_scoring._END], np.int32), 200)
    w, found, stop = lm_scoring.learn(net.weights, ids, np.arange(0, len(ids) + 1, 32), (net.input_of, net.class_of, net.log_share, net.n_begin), 30, 4, 0.02, 3)
    assert all(np.isfinite(x).all() for x in (*w.values(), found, stop))


def test_weights_of_blocks_are_averaged_by_their_places():
    rows = {"block": [9, 4], "places": [30, 10]}
    weights = pa.table({"slice": [2, 2], **rows, "data": [np.float32([1, 2]).tobytes(), np.float32([5, -2]).tobytes()]})
    assert np.frombuffer(lm_scoring._averaged(weights)["data"][0].as_py(), np.float32).tolist() == [2, 1]
    ratios = pa.table({"slice": [-1, -1], **rows, "data": [np.int64([1, 2]).tobytes(), np.int64([5, 0]).tobytes()]})
    assert np.frombuffer(lm_scoring._averaged(ratios)["data"][0].as_py(), np.int64).tolist() == [6, 2]


def test_every_learning_text_changes_the_model(spark):
    """Six blocks: words in another order, in one text of any of them, change another text's score, though no count."""
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    learn = [i for i in range(100) if zlib.crc32(str(i).encode()) % 10][:12]
    rng = random.Random(4)
    texts = {i: [rng.choice(["of", "the", "one", "two", "ab"]) for _ in range(60)] for i in (*learn, held)}

    def scored(changed=None):
        rows = [[(i, " ".join(sorted(texts[i]) if i == changed else texts[i])) for i in (*learn[2 * k : 2 * k + 2], *[held] * (k == 0))] for k in range(6)]
        docs = spark.createDataFrame(spark.sparkContext.parallelize(rows, 6).flatMap(lambda r: r), "doc_id long, text string")
        return lm_scoring.score_texts(docs, model_path(), inputs=64, classes=48).where(f"doc_id = {held}").collect()[0]

    base = scored()
    for i in learn[::2]:
        other = scored(i)
        assert other["base_score"] == base["base_score"] and other["score"] != base["score"]


def brute_counts(rows):
    cut = lambda t: re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW))
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    c, ends = collections.Counter(), 0
    for i, t in rows:
        if not held(i):
            c.update(cut(t))
            ends += 1
    n, v = sum(c.values()) + ends, len(c) + (ends > 0)
    base = lambda x: math.log10((x + 0.1) / (n + 0.1 * (v + 1)))
    return [(i, held(i), len(cut(t)) + 1, sum(c[w] > 0 for w in cut(t)) + (ends > 0), n, round(sum(base(c[w]) for w in cut(t)) + base(ends), 4)) for i, t in rows]


def test_score_texts(frame):
    rows = list(enumerate(some_texts(11, 120))) + [(None, "of the"), (500, None), (501, ""), (502, "of " * 20000), (503, "中" * 3000), (7, "x ab"), (7, "x ab"), (504, " \t\n")]
    out = lm_scoring.score_texts(frame([(i, t, 0.5) for i, t in rows], "doc_id long, text string, score double"), model_path(), inputs=64, classes=48).collect()
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(((*r[:5], round(r["base_score"], 4)) for r in out), key=key) == sorted(brute_counts(rows), key=key)
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in out)
    same = [r["score"] for r in out if r["doc_id"] == 7 and r["n_tokens"] == 3]
    assert len(same) == 2 and same[0] == same[1]


def test_score_texts_of_nothing(frame):
    assert lm_scoring.score_texts(frame([], "doc_id long, text string"), model_path()).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    (r,) = lm_scoring.score_texts(frame([(held, "a b")], "doc_id long, text string"), model_path(), inputs=64, classes=48).collect()
    assert (r["held_out"], r["n_known"], r["train_tokens"], r["base_score"]) == (True, 0, 0, 0.0) and math.isfinite(r["score"])


def test_op12_counts_are_those_of_brute_force(spark):
    at = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{at}/documents.parquet").collect()]
    out = lm_scoring.op12(spark, at).collect()
    assert sorted((*r[:5], round(r["base_score"], 4)) for r in out) == sorted(brute_counts(rows))


def test_mixture_beats_the_counts_on_words_left_out():
    own, count = np.log(np.full(100, 0.2)), np.array([1] * 50 + [40] * 50)
    part = lm_scoring.fit_mix(own, count, 100)
    assert 0 < part < 1 and lm_scoring.fit_mix(own, np.ones(100), 100) == pytest.approx(0, abs=1e-6)
