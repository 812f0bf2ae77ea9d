"""Assignment in rounds and upserts by bucket, against brute force."""

import os
import random
from zlib import crc32

import pytest

from veristry.operators import assignment, matching
from veristry.sources import buckets


def greedy(edges):
    """Both sides rank an edge alike, so taking the best that is free, again and again, is the stable assignment."""
    out, left, right = set(), set(), set()
    for s, a, b in sorted((-s, a, b) for a, b, s in edges if a is not None and b is not None and s is not None and s == s):
        if a not in left and b not in right:
            out.add((a, b, -s))
            left.add(a)
            right.add(b)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_assignment_has_no_blocking_pair(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(60), f"d{rng.randrange(40)}", rng.choice([0.8, 0.85, 0.9, rng.random()])) for _ in range(500)]
    edges += [(None, "d1", 1.0), (1, None, 1.0), (1, "d1", None), (2, "d2", float("nan"))]
    df = spark.createDataFrame([(*e, "x") for e in edges], "a long, b string, s double, _l string")
    out = assignment.assign(df, "a", "b", "s")
    assert out.columns == ["a", "b", "s", "_l"]
    got = [(r.a, r.b, r.s) for r in out.collect()]
    assert len(got) == len(set(got)) and set(got) == greedy(edges)
    of_left, of_right = {a: (-s, a, b) for a, b, s in got}, {b: (-s, a, b) for a, b, s in got}
    worst = (float("inf"), 0, "")
    for a, b, s in edges:
        if a is not None and b is not None and s is not None and s == s:
            assert (-s, a, b) >= min(of_left.get(a, worst), of_right.get(b, worst))


def test_a_row_that_loses_gets_its_next_choice(spark):
    df = spark.createDataFrame([(1, "x", 0.99), (2, "x", 0.95), (2, "y", 0.9), (3, "y", 0.85), (3, "z", 0.81)], "a long, b string, s double")
    assert {(r.a, r.b) for r in assignment.assign(df, "a", "b", "s").collect()} == {(1, "x"), (2, "y"), (3, "z")}
    with pytest.raises(RuntimeError):
        assignment.assign(df, "a", "b", "s", most_rounds=2).collect()
    assert assignment.assign(df, "a", "b", "s", most_rounds=3).count() == 3
    assert assignment.assign(df.where("false"), "a", "b", "s").count() == 0


def test_long_chains_of_ties_within_groups(spark):
    rng = random.Random(8)
    edges = [(100 * g + a, f"{g}-{b:03}", 0.5, f"g{g}") for g in range(3) for a in range(75) for b in range(75)]
    edges += [(1000 + rng.randrange(40), f"x{rng.randrange(40)}", rng.choice([0.8, 0.9, rng.random()]), None) for _ in range(500)]
    edges += [(None, "x1", 1.0, "g0"), (1000, None, 1.0, None), (1001, "x1", None, None), (1002, "x2", float("nan"), None)]
    out = assignment.assign(spark.createDataFrame(edges, "a long, b string, s double, g string"), "a", "b", "s", within=["g"])
    assert out.columns == ["a", "b", "s", "g"]
    got = [(r.a, r.b, r.s) for r in out.collect()]
    assert len(got) == len(set(got)) and set(got) == greedy([e[:3] for e in edges])


@pytest.mark.parametrize("seed", range(3))
def test_classes_are_assigned_as_their_edges(spark, seed):
    rng = random.Random(seed)
    kinds = 6 if seed else 40
    lefts = [(f"g{g}", 1000 * g + rng.randrange(300), None) for g in range(4) for _ in range(90)]
    rights = [(f"g{g}", f"{g}-{rng.randrange(200)}", None) for g in range(4) for _ in range(40 + 30 * g)]
    lefts, rights = ([(g, e, f"{crc32(f'{seed}{e}'.encode()) % kinds}") for g, e, _ in rows] for rows in (lefts, rights))
    pairs = [(f"g{g}", f"{a}", f"{b}", rng.choice([0.5, 0.8, rng.random()])) for g in range(5) for a in range(kinds) for b in range(kinds) if rng.random() < 0.7]
    pairs += [(g, a, b, 0.6) for g, a, b, _ in pairs[::9]] + [("g0", "0", "0", None), ("g0", "1", "1", float("nan")), (None, "0", "0", 1.0), ("g1", None, "0", 1.0)]
    lefts += [(None, 7, "0"), ("g0", None, "0"), ("g0", 999, None), ("g9", 9000, "0")]
    scores = {}
    for *key, s in pairs:
        scores.setdefault(tuple(key), []).append(s)
    edges = [(a, b, s) for g, a, x in lefts for h, b, y in rights if g == h and None not in (g, x, y) for s in scores.get((g, x, y), [])]
    sides = spark.createDataFrame(lefts, "g string, a long, x string"), spark.createDataFrame(rights, "g string, b string, y string"), spark.createDataFrame(pairs, "g string, x string, y string, s double")
    out = assignment.assign_classes(*sides, ("a", "b"), ("x", "y"), "s", "g")
    assert out.columns == ["g", "a", "b", "s"]
    got = [(r.a, r.b, r.s) for r in out.collect()]
    assert len(got) == len(set(got)) and set(got) == greedy(edges) and len(got) > 50


def test_the_assignment_query_shuffles_rows_and_not_edges(spark, tmp_path):
    from veristry.plans import indexed  # noqa: F401
    from veristry.plans.registry import QUERIES

    columns = ["id * 31 AS c_custkey", "cast(id % 2 AS int) AS c_nationkey", "'BUILDING' AS c_mktsegment", "1.0D AS c_acctbal"]
    spark.range(1, 601).selectExpr(*columns).union(spark.range(1, 9).selectExpr(*columns)).write.parquet(str(tmp_path / "customer.parquet"))
    store, none = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway.new_array(spark._jvm.double, 0)

    def sent():
        stages = store.stageList(None, False, False, none, None)
        return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))

    before = sent()
    got = [(r.registry_id, r.nces_id, r.confidence) for r in QUERIES["match_13_assignment"](spark, str(tmp_path)).collect()]
    assert sent() - before < 6_000  # of 120,000 edges
    keys = [31 * i for i in range(1, 601)]
    edges = [(k, str(n), round((k * 7 % 13 + n * 5 % 11) / 24, 6)) for k in keys for n in keys if k % 3 and (k - n) % 2 == 0]
    assert len(got) == 400 and set(got) == greedy(edges)


def test_accepted_matches_are_an_assignment(spark):
    registry = spark.createDataFrame([(i, "S1", None) for i in (1, 2, 3)], "id long, state string, enrollment int")
    districts = spark.createDataFrame([(d, "S1", None) for d in "xyz"], "nces_id string, state string, enrollment int")
    matches = spark.createDataFrame([("x", 1, "fuzzy", 0.99), ("x", 2, "fuzzy", 0.95), ("y", 2, "fuzzy", 0.9), ("z", 3, "fuzzy", 0.7)], "nces_id string, registry_id long, match_method string, confidence double")
    assert {(r.registry_id, r.nces_id) for r in matching.accept(matches, registry, districts).collect()} == {(1, "x"), (2, "y")}


def size(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet"))


def newest(old, new):
    from pyspark.sql import functions as F

    rows = old.unionByName(new)
    return rows.groupBy("k").agg(F.max_by(F.struct(*rows.columns), F.col("n")).alias("r")).select("r.*")


def test_an_upsert_writes_its_buckets_only(spark, tmp_path):
    schema = spark.createDataFrame([], "k long, n long, pad string").schema
    table = buckets.BucketTable(spark, str(tmp_path / "t"), schema, ["k"], 32)
    put = lambda number, rows: table.upsert(spark.createDataFrame(rows, schema), number, newest)
    want = {i: (i, 0, str(random.random())) for i in range(20000)} | {None: (None, 0, "null")}
    put(0, list(want.values()))
    whole = size(tmp_path / "t/data/v0")
    for number, rows in ((3, [(7, 5, "a"), (20001, 1, "b")]), (4, [(7, 4, "old"), (None, 9, "c")]), (7, [(20001, 2, "d")])):
        put(number, rows)
        assert size(tmp_path / f"t/data/v{number}") < 0.2 * whole
        want |= {r[0]: r for r in rows if r[0] not in want or want[r[0]][1] < r[1]}
        assert {r.k: tuple(r) for r in table.read().collect()} == want and table.read().count() == len(want)
    assert buckets.versions(spark, f"{table.path}/manifest") == [4, 7]
    named = {(b, v) for m in (5, 8) for b, v in table.manifest(m).items()}
    found = {(int(d.split("=")[1]), int(v[1:])) for v in os.listdir(tmp_path / "t/data") for d in os.listdir(tmp_path / "t/data" / v) if "=" in d}
    assert found == named  # nothing else is left


def test_an_upsert_can_run_again_and_counts_only_when_whole(spark, tmp_path):
    schema = spark.createDataFrame([], "k long, n long").schema
    table = buckets.BucketTable(spark, str(tmp_path / "t"), schema, ["k"], 4)
    rows = lambda: sorted(map(tuple, table.read().collect()))
    assert rows() == []
    table.upsert(spark.createDataFrame([(i, 0) for i in range(50)], schema), 1, newest)
    before = rows()

    def fails(old, new):
        raise ValueError("lost")

    with pytest.raises(ValueError):
        table.upsert(spark.createDataFrame([(1, 9)], schema), 2, fails)
    # data without its manifest is not seen
    spark.createDataFrame([(1, 9)], schema).write.parquet(f"{table.path}/data/v2/_bucket=0")
    assert rows() == before
    for _ in range(2):  # once more after a failure that came late
        table.upsert(spark.createDataFrame([(1, 9)], schema), 2, newest)
        assert rows() == sorted([r for r in before if r[0] != 1] + [(1, 9)])
    table.upsert(spark.createDataFrame([], schema), 3, newest)
    assert rows() == sorted([r for r in before if r[0] != 1] + [(1, 9)])
