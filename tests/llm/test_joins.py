"""N-gram join, substring dedup, decontamination, embeddings: SQL, brute force, edge cases."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from veristry.llm import decontamination, embedding_dedup, ngram_join, substring_dedup
from veristry.llm.shared import components
from veristry.llm.words import ALNUM, LOWER, WHITE, pieces

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, n_words string, component_id string, _hits string"


def brute_components(edges, ids):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def low(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


def shingles(text):
    w = WORD.findall(low(text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def near_copies(seed, n):
    """Texts with families of near copies around the threshold, edge cases, and a large family."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdeÉß", k=4))
    texts = [None, "", " \t\n", "One", "one", "one two", "One  TWO", "a b c d", "a b c d e"]
    for _ in range(n):
        base = [word() for _ in range(rng.choice([6, 40, 120, 300]))]
        for _ in range(rng.randrange(1, 6)):
            own = list(base)
            for _ in range(int(len(own) * rng.choice([0, 0.01, 0.02, 0.04, 0.06]))):
                own[rng.randrange(len(own))] = word()
            texts.append(" ".join(own[: rng.choice([len(own), len(own), int(len(own) * 0.9)])]))
    return texts


@pytest.mark.parametrize("most", [1024, 3])
def test_ngram_join_is_exact(frame, monkeypatch, most):
    monkeypatch.setattr(ngram_join, "BLOCK_KEYS", most)
    texts = near_copies(1, 60)
    rows = [(i * 3, t, "x", "y", "z") for i, t in enumerate(texts)]
    sets = {r[0]: shingles(r[1]) for r in rows}
    ids = sorted(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = brute_components(links, ids)
    got = ngram_join.jaccard_components(frame(rows, SCHEMA)).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == {(i, len(sets[i]), want[i]) for i in ids} and len(got) == len(ids)


def test_ngram_join_of_nothing_and_repeats(frame):
    assert ngram_join.jaccard_components(frame([], SCHEMA)).count() == 0
    got = ngram_join.jaccard_components(frame([(1, "a b c d e f", "", "", ""), (1, "a b c d e f", "", "", ""), (None, "a b c d e f", "", "", "")], SCHEMA)).collect()
    assert [(r.doc_id, r.component_id) for r in sorted(got, key=str)] == [(1, 1), (1, 1), (None, 1)]


def test_ngram_join_just_under_the_threshold_and_with_frequent_shingles(frame):
    """A large group in which most pairs nearly link, some do, and all share a line."""
    rng = random.Random(6)
    base = ["b%d" % i for i in range(120)]
    rows = []
    for i in range(260):
        own = list(base)
        for k in rng.sample(range(120), 3 if i % 9 else 1):
            own[k] = "q%d" % rng.randrange(10**6)
        rows.append((i, " ".join(own) + " one line that all of them have here", "", "", ""))
    rows += [(1000 + i, "one line that all of them have here " + " ".join("z%d" % rng.randrange(10**6) for _ in range(50)), "", "", "") for i in range(60)]
    sets = {r[0]: shingles(r[1]) for r in rows}
    ids = sorted(sets)
    close = [(len(sets[a] & sets[b]) / len(sets[a] | sets[b]), a, b) for k, a in enumerate(ids) for b in ids[k + 1 :]]
    assert sum(0.6 < c < 0.8 for c, _, _ in close) > 10_000
    want = brute_components([(a, b) for c, a, b in close if c >= 0.8], ids)
    got = ngram_join.jaccard_components(frame(rows, SCHEMA)).collect()
    assert {r.doc_id: r.component_id for r in got} == want and len(set(want.values())) > 70


def test_link_block_joins_what_brute_force_joins():
    rng = np.random.default_rng(3)
    base = np.unique(rng.integers(0, 1 << 60, 300)).astype(np.uint64)
    sets = [np.sort(np.unique(np.concatenate([rng.choice(base, 100, replace=False) if k % 3 else base[k % 40 : k % 40 + 100], rng.integers(0, 1 << 60, k % 25).astype(np.uint64)]))) for k in range(150)]
    n = np.array([len(s) for s in sets])
    want = brute_components([(a, b) for a in range(150) for b in range(a) if ngram_join.linked(sets[a], sets[b], n[a], n[b])], range(150))
    for label in (None, np.array([want[i] if i % 2 else i for i in range(150)])):
        links = [(int(a), int(b)) for p, q in ngram_join.link_block(n, sets, label) for a, b in zip(p, q, strict=True)]
        known = [] if label is None else [(i, int(label[i])) for i in range(150)]
        assert brute_components(links + known, range(150)) == want and 1 < len(set(want.values())) < 120


def test_signature_tree_loses_no_link():
    rng = np.random.default_rng(2)
    base = [np.unique(rng.integers(0, 1 << 60, s)).astype(np.uint64) for s in rng.integers(3, 400, 30)]
    sets = [np.sort(rng.choice(b, max(1, int(len(b) * k)), replace=False)) for b in base for k in (1, 0.95, 0.85, 0.8)]
    n = np.array([len(s) for s in sets])
    tree = ngram_join.SignatureTree(n, sets)
    i, j = tree.pairs()
    found = {frozenset((int(tree.order[a]), int(tree.order[b]))) for a, b in zip(i, j, strict=True)}
    must = {frozenset((a, b)) for a in range(len(sets)) for b in range(a) if ngram_join.linked(sets[a], sets[b], n[a], n[b])}
    assert must and must <= found and len(found) < len(sets) * (len(sets) - 1) / 2


@pytest.mark.parametrize("small", [200_000, 0])
def test_components_of_a_long_path(spark, small):
    n = 300
    edges = spark.createDataFrame([(i + 1, i) for i in range(n)] + [(1000, 1001), (5, 5), (None, 7)], "a long, b long")
    got = {r.id: r.root for r in components(edges, small=small).collect()}
    assert got == {**{i: 0 for i in range(n + 1)}, 1000: 1000, 1001: 1000}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_windows(rows, size=13):
    words = {i: WORD.findall(t or "") for i, t in rows}
    owner = {}
    for i in sorted(words):
        for k in range(len(words[i]) - size + 1):
            owner.setdefault(tuple(words[i][k : k + size]), i)
    out = {}
    for i, w in words.items():
        gone = set()
        for k in range(len(w) - size + 1):
            if owner[tuple(w[k : k + size])] < i:
                gone |= set(range(k, k + size))
        out[i] = (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
    return out


@pytest.mark.parametrize(("batches", "fan_in"), [(1, 2), (3, 2), (5, 2), (4, 4)])
def test_substring_dedup_is_exact(frame, batches, fan_in):
    rng = random.Random(3)
    passage = [["p%d%d" % (k, i) for i in range(rng.choice([12, 13, 20, 60]))] for k in range(6)]
    rows = [(0, None), (1, ""), (2, "a b"), (3, "É " * 40), (4, "É " * 14)]
    for i in range(5, 90):
        w = ["w%d" % rng.randrange(5000) for _ in range(rng.randrange(0, 80))]
        for _ in range(rng.randrange(0, 3)):
            at = rng.randrange(len(w) + 1)
            w[at:at] = rng.choice(passage)
        rows.append((i * 2, rng.choice([" ", "\n", " \t"]).join(w)))
    got = substring_dedup.remove_repeated_windows(frame([(i, t, "x", "y", "z") for i, t in rows], SCHEMA), batches=batches, fan_in=fan_in)
    assert "component_id" in got.columns
    want = brute_windows(rows)
    have = {r.doc_id: (r.n_words, r.n_removed, r.kept_text or "") for r in got.collect()}
    assert have == want


def test_substring_dedup_of_nothing_nulls_and_repeats(frame):
    assert substring_dedup.remove_repeated_windows(frame([], SCHEMA)).count() == 0
    text = " ".join(map(str, range(20)))
    got = substring_dedup.remove_repeated_windows(frame([(None, text, "", "", ""), (7, text, "", "", ""), (7, text, "", "", "")], SCHEMA)).collect()
    assert sorted(((r.doc_id, r.n_removed) for r in got), key=str) == [(7, 0), (7, 0), (None, 0)]


def test_index_takes_batches_one_by_one(spark):
    index = substring_dedup.FingerprintIndex(spark, 3, 2)
    counts = []
    for k in range(4):
        hits = index.add(spark.createDataFrame([(k, "x y z q%d" % k)], "doc_id long, text string"))
        counts.append(hits.count())
    assert counts == [0, 1, 1, 1] and [level for level, _ in index.runs] == [2]


def test_index_is_opened_again_and_checks_the_order(spark):
    frame = lambda k, t: spark.createDataFrame([(k, t)], "doc_id long, text string")
    index = substring_dedup.FingerprintIndex(spark, 3, 2, 3)
    assert index.add(frame(1, "x y z a")).count() == 0
    again = substring_dedup.FingerprintIndex.open(spark, index.home)
    assert (again.size, again.fan_in, again.n_parts, again.last_id) == (3, 2, 3, 1) and again.add(frame(5, "x y z b")).count() == 1
    with pytest.raises(ValueError, match="comes after"):
        again.add(frame(5, "new"))
    third = substring_dedup.FingerprintIndex.open(spark, index.home)
    assert [level for level, _ in third.runs] == [1] and third.add(frame(6, "y z b")).count() == 1
    third.drop()


def test_equal_fingerprints_of_other_windows_are_told_apart(monkeypatch):
    monkeypatch.setattr(substring_dedup, "_LOW", np.uint64(0))  # every fingerprint collides
    texts = ["a b c d e", "f g h i j", "z a b c y"]
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array(texts)], names=["doc_id", "text"])
    packed = pa.Table.from_batches(list(substring_dedup._cut(3, 1)(iter([batch]))))
    merged = substring_dedup._merge((pa.scalar(0),), packed, None)
    hits = merged.filter(pa.array(np.array(merged.column("kind").to_pylist()) == "hit"))
    doc, ids = substring_dedup._unpack(hits)
    piece = next(pieces(pa.array([texts[2]]), WHITE))
    at, part, prints = substring_dedup.fingerprints(piece, 3, 1)
    assert doc.tolist() == [3] and at[substring_dedup.window_ids(part, prints) == ids[0]].tolist() == [1]


def test_windows_that_many_documents_share_are_folded_in_a_task():
    """A task sends a remembered window once more only for a smaller document."""
    texts = ["p q r s %d" % k for k in range(2000)]
    order = random.Random(4).sample(range(2000), 2000)
    batches = [pa.RecordBatch.from_arrays([pa.array(order[k : k + 100]), pa.array([texts[i] for i in order[k : k + 100]])], names=["doc_id", "text"]) for k in range(0, 2000, 100)]
    packed = pa.Table.from_batches(list(substring_dedup._cut(3, 1)(iter(batches))))
    doc, _ = substring_dedup._unpack(packed.filter(pa.array(np.array(packed.column("kind").to_pylist()) == "new")))
    assert len(doc) < 2000 + 60
    merged = substring_dedup._merge((pa.scalar(0),), packed, None)
    doc, _ = substring_dedup._unpack(merged.filter(pa.array(np.array(merged.column("kind").to_pylist()) == "hit")))
    assert sorted(doc.tolist()) == sorted(2 * list(range(1, 2000)))


def brute_hits(text, items, size=13):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    w = word.findall(low(text or ""))
    hit, found = set(), set()
    for i, t in items:
        v = word.findall(low(t or ""))
        n = min(size, len(v))
        wins = {tuple(v[k : k + n]) for k in range(len(v) - n + 1)} if n else set()
        for k in range(len(w) - n + 1):
            if n and tuple(w[k : k + n]) in wins:
                hit |= set(range(k, k + n))
                found.add(str(i))
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("size", [13, 6, 1])
def test_decontamination_is_exact(frame, size):
    rng = random.Random(4)
    word = lambda: rng.choice(["Ab", "cd", "É", "x1", "日本", "e"])
    items = [(1, " ".join(word() for _ in range(20))), (2, "Ab, cd!"), (10, None), (3, " "), (4, "É"), (5, "Ab cd"), (None, "e e")]
    docs = [(0, None), (1, ""), (2, "?!"), (3, "zz AB.. CD zz É"), (4, items[0][1].upper()), (5, "pre-fix " + items[0][1][3:] + " end")]
    docs += [(i, rng.choice([" ", ", "]).join(word() for _ in range(rng.randrange(40)))) for i in range(6, 60)]
    got = decontamination.find_contamination(frame([(i, t, "x", "y", "z") for i, t in docs], SCHEMA), frame(items, "item_id long, text string"), size=size).collect()
    known = [(i, t) for i, t in items if i is not None]
    for r in got:
        text = dict(docs)[r.doc_id]
        assert (r.n_words, r.n_hit, r.item_ids) == brute_hits(text, known, size)
        assert r.contaminated == (r.n_hit > 0 and 20 * r.n_hit >= r.n_words)
        cut = [w for s in r.spans for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(text[s.start : s.end]))]
        assert len(cut) == r.n_hit
    assert decontamination.find_contamination(frame([], SCHEMA), frame([], "item_id long, text string")).count() == 0


def test_matcher_against_brute_force():
    rng = random.Random(8)
    for _ in range(150):
        words, size = ["ab", "cd", "É", "x1", "日本", "e"][: rng.choice([2, 3, 6])], rng.choice([13, 13, 5, 4, 2])
        items = [(str(i), " ".join(rng.choices(words, k=rng.choice([0, 1, 3, 12, 13, 14, 20, 40])))) for i in range(rng.randrange(8))]
        m = decontamination.matcher(items, size)
        for _ in range(6):
            text = " ".join(rng.choices(words, k=rng.randrange(60))) + (" " + rng.choice(items)[1] + " ab" if items else "")
            for piece in pieces(pa.array([text]), ALNUM, LOWER):
                hit, found = decontamination.scan(piece, 0, m.numbers(piece.hashes()), m)
                assert (len(hit), found) == brute_hits(text, items, size)[1:]


def test_one_automaton_whatever_the_benchmark(spark, frame):
    rng = random.Random(9)
    items = [(i, " ".join("w%d" % rng.randrange(30000) for _ in range(200))) for i in range(1500)]  # beyond 2 MB, and one template in front of all
    items = [(i, "which of the following statements about this is true " + t) for i, t in items]
    cut = lambda t, a, b: " ".join(t.split()[a:b])
    docs = [(1, "x " + cut(items[7][1], 60, 73) + " y"), (2, "x " + cut(items[7][1], 60, 72) + " y"), (3, items[3][1]), (4, "Which of the following statements about this is true? " * 900)]
    out = decontamination.find_contamination(frame(docs, "doc_id long, text string"), frame(items, "item_id long, text string"))
    assert out._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    got = {r.doc_id: (r.n_hit, r.item_ids) for r in out.collect()}
    assert got == {1: (13, ["7"]), 2: (0, []), 3: (209, ["3"]), 4: (0, [])}
    blocks = decontamination.find_contamination(frame(docs, "doc_id long, text string"), frame(items, "item_id long, text string"), most_item_bytes=1_000_000)
    assert sorted(map(str, blocks.collect())) == sorted(map(str, out.collect()))


def test_blocks_of_items_are_united(frame):
    """Hits of items in several blocks count once where they overlap, one-word items among them."""
    rng = random.Random(12)
    words = ["ab", "cd", "É", "x1", "日本", "e"]
    items = [(i, " ".join(rng.choices(words, k=rng.choice([0, 1, 1, 2, 3, 13, 20])))) for i in range(40)]
    docs = [(i, " ".join(rng.choices([*words, "zz", "y"], k=rng.randrange(80)))) for i in range(60)] + [(90, None), (91, "")]
    docs += [(100 + i, "zz " + t + " y") for i, t in items]
    own = lambda **more: decontamination.find_contamination(frame(docs, "doc_id long, text string"), frame(items, "item_id long, text string"), **more).collect()
    whole, cut = own(), own(most_item_bytes=400)
    assert sorted(map(str, whole)) == sorted(map(str, cut))
    for r in cut:
        assert (r.n_words, r.n_hit, r.item_ids) == brute_hits(dict(docs)[r.doc_id], items, 13)


@pytest.mark.parametrize("least_rows", [4096, 20])
def test_embeddings_against_brute_force(frame, monkeypatch, least_rows):
    monkeypatch.setattr(embedding_dedup, "LEAST_ROWS", least_rows)
    rng = np.random.default_rng(5)
    x = [rng.normal(size=16) for _ in range(120)]
    x += [x[k % 40] + rng.normal(size=16) * s for k, s in zip(range(120), rng.choice([0.02, 0.08, 0.15], 120), strict=True)]
    x += [x[0] + rng.normal(size=16) * 0.01 for _ in range(150)]  # a dense group wider than the window
    x += [x[3]] * 5
    rows = [(i, [float(f) for f in np.float32(v)], i % 2 if i < 240 else 0) for i, v in enumerate(x)]
    bad = [(9000, None, 0), (9001, [0.0] * 16, 0), (9002, [float("nan")] * 16, 0), (9003, [], 0), (9004, [1.0, None], 0), (9005, [1.0] * 16, None), (9006, [1.0] * 3, 0)]
    e = np.float64(np.float32(x))
    e /= np.linalg.norm(e, axis=1, keepdims=True)
    label = np.array([r[2] for r in rows])
    near = (e @ e.T >= 0.93) & (label[:, None] == label) & ~np.eye(len(x), dtype=bool)
    want = brute_components(zip(*np.nonzero(near), strict=True), range(len(x)))
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(frame(rows + bad, "vec_id long, embedding array<float>, label int")).collect()}
    assert len(got) == len(rows) + len(bad) and all(got[i[0]].n_links == 0 and got[i[0]].kept for i in bad)
    assert sum(got[i].n_links for i in range(len(x))) >= 0.99 * near.sum() and all(got[i].n_links <= near[i].sum() for i in range(len(x)))
    assert np.mean([got[i].component_id == want[i] for i in range(len(x))]) >= 0.99
    assert embedding_dedup.near_duplicates(frame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_embeddings_of_a_dense_group_over_many_partitions(spark, frame, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "LEAST_ROWS", 100)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "60")
    try:
        rng = np.random.default_rng(7)
        centre = rng.normal(size=64)
        x = np.float32(np.concatenate([centre + rng.normal(size=(900, 64)) * 0.22, rng.normal(size=(300, 64))]))
        e = np.float64(x)
        e /= np.linalg.norm(e, axis=1, keepdims=True)
        near = (e @ e.T >= 0.93) & ~np.eye(len(x), dtype=bool)
        got = embedding_dedup.near_duplicates(frame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    want = brute_components(zip(*np.nonzero(np.triu(near)), strict=True), range(len(x)))
    assert sum(r.n_links for r in got) == near.sum()
    assert {r.vec_id: r.n_links for r in got} == dict(enumerate(near.sum(1).tolist()))
    assert {r.vec_id: r.component_id for r in got} == {i: want[i] for i in range(len(x))}


def test_embeddings_do_not_depend_on_partitions(spark, frame, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "PASS_ROWS", 64)
    rng = np.random.default_rng(13)
    centre = rng.normal(size=32)
    x = np.float32(np.concatenate([centre + rng.normal(size=(1500, 32)) * 0.2, rng.normal(size=(500, 32))]))
    rows = [(i, v.tolist(), 0, 7, 8, True) for i, v in enumerate(x)]
    rows += [rows[3], rows[1999], (5000, rows[1999][1], 0, 7, 8, True), (None, rows[3][1], 0, 7, 8, True)]  # repeats and ties
    results, before = [], spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in ("4", "120"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            results.append(sorted(map(tuple, embedding_dedup.near_duplicates(frame(rows, "vec_id long, embedding array<float>, label int, root int, n_links int, kept boolean")).collect()), key=str))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert results[0] == results[1] and len(results[0]) == len(rows)
    e = np.float64(x)
    e /= np.linalg.norm(e, axis=1, keepdims=True)
    near = (e @ e.T >= 0.93) & ~np.eye(len(x), dtype=bool)
    found = {r[0]: r[1] for r in results[0]}
    assert [found[i] for i in range(1999)] == near.sum(1).tolist()[:1999] and found[1999] == near[1999].sum() + 1 == found[5000] and found[None] == 0


def test_embeddings_near_the_threshold_of_a_large_label(frame):
    rng = np.random.default_rng(11)
    unit = lambda a: a / np.linalg.norm(a, axis=1, keepdims=True)
    x = unit(rng.normal(size=(6000, 64)))
    z = rng.normal(size=x.shape)
    z = unit(z - (z * x).sum(1, keepdims=True) * x)
    x = np.float32(np.concatenate([x, 0.931 * x + np.sqrt(1 - 0.931**2) * z]))
    got = embedding_dedup.near_duplicates(frame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int")).collect()
    e = unit(np.float64(x))
    assert {r.vec_id: r.n_links for r in got} == dict(enumerate((e @ e.T >= 0.93).sum(1) - 1))


def test_very_long_texts(frame):
    """Texts beyond every piece and slice, among short and empty ones, against brute force."""
    rng = random.Random(12)
    words = ["w%d" % rng.randrange(40000) for _ in range(260_000)]  # 1.7 MB
    near = list(words)
    for k in range(0, len(near), 150):
        near[k] = "other%d" % k
    rows = [(1, " ".join(words), "", "", ""), (2, " ".join(near), "", "", ""), (3, " ".join(words[1000:1100]), "", "", ""), (4, "", "", "", ""), (5, None, "", "", ""), (6, " ".join(words) + " end", "", "", "")]
    sets = {r[0]: shingles(r[1]) for r in rows}
    got = {r.doc_id: r for r in ngram_join.jaccard_components(frame(rows, SCHEMA)).collect()}
    assert {i: r.n_shingles for i, r in got.items()} == {i: len(s) for i, s in sets.items()} and [got[i].component_id for i in range(1, 7)] == [1, 1, 3, 4, 5, 1]
    want = brute_windows([(r[0], r[1]) for r in rows])
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_text or "") for r in substring_dedup.remove_repeated_windows(frame(rows, SCHEMA)).collect()} == want
    items = [(1, " ".join(words[200_000:200_040])), (2, "no such words " * 10)]
    found = {r.doc_id: (r.n_words, r.n_hit, r.item_ids) for r in decontamination.find_contamination(frame(rows, SCHEMA), frame(items, "item_id long, text string")).collect()}
    assert found == {r[0]: brute_hits(r[1], items) for r in rows} and found[1][1] == 40


def test_same_as_sql_at_the_smallest_size(same_as_sql):
    for m, f, sql in ((ngram_join, "op1", "OP1_SQL"), (embedding_dedup, "op2", "OP2_SQL"), (decontamination, "op4", "OP4_SQL"), (substring_dedup, "op6", "OP6_SQL")):
        same_as_sql(getattr(m, f), getattr(m, sql))


def test_removed_text_hash_is_of_kept_words(spark):
    row = substring_dedup.op6(spark, "/root/testdata/sf0.001").where("n_removed = 0").orderBy("doc_id").first()
    text = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where(f"doc_id = {row.doc_id}").first().text
    assert row.kept_sha256 == hashlib.sha256(" ".join(WORD.findall(text)).encode()).hexdigest()
