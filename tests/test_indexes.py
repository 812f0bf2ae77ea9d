"""Written indexes against searches of everything."""

import random
import re

import numpy as np
import pytest

from veristry.operators import search, text_index, vector_index
from veristry.plans import indexed
from veristry.plans.content import hundredth
from veristry.plans.registry import QUERIES, Tables


@pytest.mark.parametrize("at", ["sf0.01", "sf0.1"])
def test_registered_vector_search_reaches_its_recall_with_few_vectors(spark, at):
    t = Tables(spark, f"/root/testdata/{at}")
    got = {(r.query_id, r.vec_id) for r in QUERIES["vec_07_clusters"](spark, t.sf_dir).collect()}
    want = {(r.query_id, r.vec_id) for r in search.search_many(t.vectors, hundredth(t.vectors), 20).collect()}
    assert {q for q, _ in got} == {q for q, _ in want} and len(got & want) >= 0.9 * len(want)
    index = indexed.vectors(t)
    n = sum(index.sizes.values())
    assert n == t.vectors.count() and 100 <= n / 5  # whole vectors that a query reads
    codes = index.rows().selectExpr("avg(length(code) + 4)").first()[0] * index.probes / len(index.centres.fine)
    assert codes <= 0.2 * 4 * index.dim  # bytes of codes that it reads, of those of all vectors
    assert n**0.5 / 2 <= len(index.centres.fine) <= 2 * n**0.5 + 1


def test_a_search_reads_only_the_files_of_its_lists(spark, tmp_path):
    rng = np.random.default_rng(0)
    middle = rng.normal(size=(30, 16)) * 3
    rows = [(i, (middle[i % 30] + rng.normal(size=16)).tolist()) for i in range(3000)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    index = vector_index.build_index(v, str(tmp_path / "index"))
    assert index.probes <= 8 < len(index.centres.fine)  # clustered vectors need few lists
    asked = v.where("vec_id = 7").selectExpr("vec_id AS query_id", "embedding AS q")
    found = vector_index.search_index(index, asked, 10)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[list#\d+ (IN|INSET|=) ", plan) or "PartitionFilters: [(list" in plan
    exact = search.search_many(v, v.where("vec_id % 100 = 0").selectExpr("vec_id AS query_id", "embedding AS q"), 10).collect()
    got = vector_index.search_index(vector_index.open_index(spark, index.path), v.where("vec_id % 100 = 0").selectExpr("vec_id AS query_id", "embedding AS q"), 10).collect()
    want = {(r.query_id, r.vec_id) for r in exact}
    assert len(want & {(r.query_id, r.vec_id) for r in got}) >= 0.93 * len(want)
    of = {(r.query_id, r.vec_id): r.distance for r in exact}
    assert all(r.distance == pytest.approx(of[r.query_id, r.vec_id], abs=1e-9) for r in got if (r.query_id, r.vec_id) in of)


def test_vectors_without_direction_and_ties(spark, tmp_path):
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(9)] + [(9, [0.0, 0.0, 0.0]), (10, None), (11, [1.0]), (12, [1.0, float("nan"), 0.0]), (13, [1.0, float("inf"), 0.0]), (14, []), (3, [1.0, 2.0, 3.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    index = vector_index.build_index(v, str(tmp_path / "index"))
    assert sum(index.sizes.values()) == 10
    asked = v.selectExpr("vec_id AS query_id", "embedding AS q").where("query_id > 7")
    got = vector_index.search_index(index, asked, 3, probes=99, keep=99).collect()
    assert sorted((r.query_id, r.place, r.vec_id) for r in got) == [(8, 1, 0), (8, 2, 1), (8, 3, 2)]
    none = vector_index.build_index(v.where("vec_id > 8"), str(tmp_path / "one"))
    assert vector_index.search_index(none, v.where("vec_id = 0").selectExpr("vec_id AS query_id", "embedding AS q")).count() == 0
    empty = vector_index.build_index(v.where("false"), str(tmp_path / "none"))
    assert vector_index.search_index(empty, v.selectExpr("vec_id AS query_id", "embedding AS q")).count() == 0


def test_all_vectors_kept_leave_no_more_than_the_nearest_of_a_block(spark, tmp_path):
    """Every pair of a query and a vector went through a window and two joins."""
    rng = np.random.default_rng(3)
    v = spark.createDataFrame([(i, rng.normal(size=8).tolist()) for i in range(400)], "vec_id long, embedding array<double>")
    index = vector_index.build_index(v, str(tmp_path / "index"))
    asked = v.where("vec_id % 10 = 0").selectExpr("vec_id AS query_id", "embedding AS q")
    found = vector_index.search_index(index, asked, 4, probes=len(index.centres.fine), keep=400)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 2  # with the blocks' numbers, on either side
    row = lambda r: (r.query_id, r.place, r.vec_id, round(r.distance, 12))
    assert sorted(map(row, found.collect())) == sorted(map(row, search.search_many(v, asked, 4).collect()))
    of = {r.vec_id: r.list for r in index.rows().select("vec_id", "list").collect()}
    assert all(of[r.vec_id] == r.list for r in found.collect())


@pytest.mark.parametrize("dim", [1, 7, 64])
def test_codes_are_near_their_vectors(dim):
    x = np.random.default_rng(1).normal(size=(50, dim)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    codes, scale = vector_index.encode(x)
    assert codes.shape[1] == (dim + 1) // 2 and np.abs(vector_index.decode(codes, scale, dim) - x).max() <= scale.max() / 2 + 1e-6


def words(text):
    return re.findall(r"[A-Za-z0-9_]+", (text or "").lower())


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(2)
    pool = ["the", "The", "of", "and", "a_b", "x1", "é", "thé", "other", "über", "İstanbul", "中", "-", "\n"]
    rows = [(i, "".join(rng.choice(pool) + rng.choice([" ", " ", ", ", "-"]) for _ in range(rng.randrange(40)))) for i in range(200)]
    return [*rows, (500, None), (501, ""), (502, "the " * 3000 + "of"), (503, "of the"), (None, "the of")]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory, texts):
    df = spark.createDataFrame([(i, t, 1) for i, t in texts], "doc_id long, text string, term int")
    return text_index.build_index(df, str(tmp_path_factory.mktemp("text") / "index"), buckets=5)


def test_postings_hold_every_place(index, texts):
    want = {}
    for i, t in texts:
        for k, w in enumerate(words(t) if i is not None else []):
            want.setdefault((i, w), []).append(k)
    assert {(r.doc_id, r.term): list(r.places) for r in index.postings.collect()} == want
    df = {}
    for _, w in want:
        df[w] = df.get(w, 0) + 1
    assert {r.term: r.df for r in index.terms.collect()} == df


@pytest.mark.parametrize("size", [1, 60, 1 << 20])
def test_texts_may_be_cut_into_any_pieces(monkeypatch, texts, size):
    import pyarrow as pa

    monkeypatch.setattr(text_index, "PIECE_BYTES", size)
    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in texts], pa.int64()), pa.array([t and t.lower() for _, t in texts])], names=["doc_id", "text"])
    found = [r for part in text_index._indexer(iter([batch.slice(0, 50), batch.slice(50)])) for r in part.to_pylist()]
    own = {(r["doc_id"], r["term"]): r["places"] for r in found}
    assert len(own) == len(found) and own == {(i, w): [k for k, x in enumerate(words(t)) if x == w] for i, t in texts for w in set(words(t))}


def test_searches_are_those_of_the_texts(index, texts):
    own = {i: words(t) for i, t in texts if i is not None}
    near = lambda w, a, b, n: any(b in w[k + 1 : k + 1 + n] for k, x in enumerate(w) if x == a)
    phrase = lambda w, p: any(w[k : k + len(p)] == p for k in range(len(w)))
    cases = [
        ({"all_of": ["the", "of"]}, lambda w: "the" in w and "of" in w),
        ({"any_of": ["a_b", "nowhere"], "none_of": ["and"]}, lambda w: "a_b" in w and "and" not in w),
        ({"none_of": ["the", "of"]}, lambda w: "the" not in w and "of" not in w),
        ({}, lambda w: True),
        ({"near": [("the", "of", 2), ("of", "x1", 5)]}, lambda w: near(w, "the", "of", 2) and near(w, "of", "x1", 5)),
        ({"near": [("the", "the", 1)]}, lambda w: near(w, "the", "the", 1)),
        ({"phrases": [["of", "the"]], "none_of": ["x1"]}, lambda w: phrase(w, ["of", "the"]) and "x1" not in w),
        ({"phrases": [["the", "of", "and"]]}, lambda w: phrase(w, ["the", "of", "and"])),
        ({"all_of": ["nowhere"]}, lambda w: False),
    ]
    for asked, is_ in cases:
        got = [r.doc_id for r in text_index.search(index, **asked).collect()]
        assert len(got) == len(set(got)) and set(got) == {i for i, w in own.items() if is_(w)}, asked


def test_parts_of_words(index, texts):
    for part in ("the", "he", "a_", "1", "zz"):
        assert {r.doc_id for r in text_index.containing(index, part).collect()} == {i for i, t in texts if i is not None and part in (t or "").lower()}
    with pytest.raises(ValueError):
        text_index.containing(index, "of the")


def test_a_search_reads_no_text_and_few_buckets(index):
    plan = text_index.search(index, all_of=["the"])._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[bucket#\d+ (IN|=) |PartitionFilters: \[\(bucket|PartitionFilters: \[isnotnull\(bucket", plan) and "text" not in plan.split("ReadSchema")[1]
    assert re.search(r"PushedFilters: \[[^\]]*term", plan)


def test_postings_travel_packed(spark, texts):
    """A row for each bucket of a piece, and less than half the bytes of the postings."""
    import pyarrow as pa

    own = [(i, (t or "").lower()) for i, t in texts if i is not None] * 20
    batch = lambda: iter([pa.RecordBatch.from_arrays([pa.array([i for i, _ in own], pa.int64()), pa.array([t for _, t in own])], names=["doc_id", "text"])])
    packed, plain = list(text_index._packer(3)(batch())), list(text_index._indexer(batch()))
    assert len(packed) == 3 and sum(b.get_total_buffer_size() for b in packed) * 2 < sum(b.get_total_buffer_size() for b in plain)
    rows = [[(r["doc_id"], r["term"], tuple(r["places"])) for b in x for r in b.to_pylist()] for x in (plain, text_index._unpacked(iter(packed)))]
    assert sorted(rows[0]) == sorted(rows[1])
    found = {(r["term"], r["bucket"]) for b in text_index._unpacked(iter(packed)) for r in b.to_pylist()}
    terms = spark.createDataFrame([(t,) for t, _ in found], "term string").withColumn("bucket", text_index._bucket(3))
    assert {(r.term, r.bucket) for r in terms.collect()} == found


def test_an_empty_table(spark, tmp_path):
    none = text_index.build_index(spark.createDataFrame([], "doc_id long, text string"), str(tmp_path / "index"))
    assert text_index.search(none, all_of=["a"]).count() == 0 and text_index.containing(none, "a").count() == 0 and text_index.search(none).count() == 0
