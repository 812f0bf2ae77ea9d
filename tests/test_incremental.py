"""Paging by cursor, merged sketches and timed suppression, each against the whole computation."""

import datetime
import math
import random

import pytest

from pyspark.sql import functions as F

from veristry.operators import basics, search, sketches
from veristry.streaming.suppression import suppress_stream


def key(order):
    """A Python key of the same order, nulls last."""
    return lambda r: tuple((r[n] is None, 0 if r[n] is None else (-r[n] if down else r[n])) for n, down in order)


@pytest.mark.parametrize("limit", [1, 7, 500])
def test_walking_all_pages_gives_every_row_once(spark, limit):
    rng = random.Random(limit)
    n = 40 if limit == 1 else 120
    rows = [(i, rng.choice([None, 1, 2, 3]), rng.choice([None, 0.5, 1.5, -2.0])) for i in range(n)]
    df = spark.createDataFrame(rows, "id long, a int, b double")
    order = [("a", True), ("b", False), ("id", True)]
    got, after = [], None
    while page := basics.seek(df, order, limit, after).collect():
        got += page
        after = basics.cursor(page, order)
    assert got == sorted(df.collect(), key=key(order))


def test_a_cursor_reaches_the_scan(spark, tmp_path):
    spark.range(1000).selectExpr("id AS a", "id % 7 AS b").write.parquet(str(tmp_path / "t"))
    plan = basics.seek(spark.read.parquet(str(tmp_path / "t")), [("a", False), ("b", False)], 5, {"a": 500, "b": 3})._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(a,500)" in plan


def rows_of(seed, n):
    rng = random.Random(seed)
    return [(rng.choice("xyz"), f"u{rng.randrange(5000)}" if rng.random() < 0.9 else None, rng.gauss(100, 30) if rng.random() < 0.9 else None) for _ in range(n)]


def test_merged_summaries_are_within_their_bounds(spark, tmp_path):
    path, every, seen = str(tmp_path / "s"), [], {"by": ["g"], "distinct": ["u"], "numbers": ["v"], "filled": ["u", "v"]}
    by = seen.pop("by")
    put = lambda name, rows: sketches.add_batch(spark.createDataFrame(rows, "g string, u string, v double"), path, name, by, **seen)
    for b in range(4):
        rows = rows_of(b, 3000)
        every += rows
        put(f"b{b}", rows)
    put("b2", rows_of(2, 3000))  # again
    for r in sketches.merged(spark, path, by, (0.1, 0.5, 0.99)).collect():
        own = [x for x in every if x[0] == r.g]
        v = sorted(x[2] for x in own if x[2] is not None)
        assert (r.n, r.n_u, r.n_v) == (len(own), sum(x[1] is not None for x in own), len(v))
        assert r.distinct_u == pytest.approx(len({x[1] for x in own} - {None}), rel=4 * 1.04 / 2 ** (sketches.LOG_K / 2))
        assert (r.mean_v, r.min_v, r.max_v) == (pytest.approx(sum(v) / len(v)), v[0], v[-1])
        for q, x in ((0.1, r.q10_v), (0.5, r.q50_v), (0.99, r.q99_v)):
            assert abs(sum(y <= x for y in v) / len(v) - q) <= 1.5 * sketches.RANK_ERROR
    some = sketches.merged(spark, path, by, batches=["b1"]).collect()
    assert sum(r.n for r in some) == 3000
    plan = sketches.merged(spark, path, by, batches=["b1"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "b1" in plan


def test_summaries_of_nulls_and_nothing(spark, tmp_path):
    path = str(tmp_path / "s")
    sketches.add_batch(spark.createDataFrame([("x", None, None), (None, "a", 1.0)], "g string, u string, v double"), path, "a", ["g"], distinct=["u"], numbers=["v"])
    sketches.add_batch(spark.createDataFrame([], "g string, u string, v double"), path, "b", ["g"], distinct=["u"], numbers=["v"])
    got = {r.g: (r.n, r.distinct_u, r.mean_v, r.min_v, r.q50_v) for r in sketches.merged(spark, path, ["g"]).collect()}
    assert got == {"x": (1, 0, None, None, None), None: (1, 1, 1.0, 1.0, 1.0)}


def test_quantile_query_is_within_its_bound(spark):
    from veristry.plans import indexed  # noqa: F401
    from veristry.plans.registry import QUERIES, Tables

    at = "/root/testdata/sf0.01"
    values = {}
    for r in Tables(spark, at).crawl.select("url_type", "response_ms").collect():
        values.setdefault(r.url_type, []).append(r.response_ms)
    for r in QUERIES["agg_16_merged_quantiles"](spark, at).collect():
        v = values[r.url_type]
        for q, x in ((0.1, r.q10_response_ms), (0.5, r.q50_response_ms), (0.9, r.q90_response_ms)):
            below, upto = sum(y < x for y in v) / len(v), sum(y <= x for y in v) / len(v)
            assert below - 1.5 * sketches.RANK_ERROR <= q <= upto + 1.5 * sketches.RANK_ERROR


def test_suppression_ends_by_itself_and_is_that_of_the_batch(spark, tmp_path):
    rng, start = random.Random(5), datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)
    schema, every = "nces_id string, happened_at timestamp", []
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    entities = spark.createDataFrame([(f"d{i}",) for i in range(30)], "nces_id string")
    for day in (0, 3, 4, 9, 30):
        rows = [(f"d{rng.randrange(25)}", start + datetime.timedelta(days=day, seconds=rng.randrange(86400))) for _ in range(1 if day == 30 else 12)]
        rows += [(None, rows[0][1]), ("d1", None)] if day == 3 else []
        every += [r for r in rows if None not in r]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        got = suppress_stream(spark, stream(), str(tmp_path / "job"), days=5, buckets=4).collect()
        now = max(r[1] for r in every)
        free = search.suppress(entities, spark.createDataFrame(every, schema), now.strftime("%Y-%m-%d %H:%M:%S"), 5)
        assert {r.nces_id for r in got} == {r.nces_id for r in entities.collect()} - {r.nces_id for r in free.collect()}
        last = {}
        for e, t in every:
            last[e] = max(last.get(e, t), t)
        assert all(r.last_ms == math.floor(last[r.nces_id].timestamp() * 1000) for r in got)
    assert len(got) == 1  # whatever was engaged long ago is free without another row
    state = spark.read.format("statestore").option("stateVarName", "last").load(str(tmp_path / "job/checkpoint"))
    assert state.count() == 1  # and holds no state
    again = suppress_stream(spark, stream(), str(tmp_path / "job"), days=5, buckets=4).collect()
    assert again == got


def test_distinct_values_are_counted_exactly_over_batches(spark):
    path = f"{spark.conf.get('spark.checkpoint.dir')}/exact-{random.random()}"
    rows = spark.range(90000).selectExpr("if(id % 2 = 0, 'even', null) AS g", "cast(id % 60001 AS string) AS k", "id % 3 AS b")
    rows = rows.unionByName(spark.sql("SELECT 'none' AS g, cast(null AS string) AS k, 1L AS b"))
    for batch in (0, 1, 2, 2):
        sketches.add_batch(rows.where(f"b = {batch}"), path, f"b{batch}", ["g"], exact=["k"])
    count = lambda which: {r.g: r.distinct_k for r in sketches.merged(spark, path, ["g"], batches=which, exact=["k"]).collect()}
    want = lambda own: {r.g: r.n for r in rows.where(own).groupBy("g").agg(F.count_distinct("k").alias("n")).collect()}
    assert count(None) == want("true") and count(["b0", "b2"]) == want("b <> 1")
