"""Literal cases and properties."""

import datetime as dt
import random

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veristry.functions import names, texts, urls
from veristry.operators import basics, documents, matching, search, taxonomy
from veristry.sources import files


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_jaro_winkler_values():
    assert names.jaro_winkler("abcdxx", "abcdyyyyyy") == pytest.approx(0.8133, abs=1e-4)
    assert names.jaro_winkler("a", "a") == 1.0 and names.jaro_winkler("", "a") == 0.0
    assert names.jaro_winkler(None, "a") is None


@given(st.text("abc ", max_size=9), st.text("abc ", max_size=9))
def test_jaro_winkler_is_symmetric_and_bounded(a, b):
    s = names.jaro_winkler(a, b)
    assert 0 <= s <= 1 and s == pytest.approx(names.jaro_winkler(b, a)) and (s == 1 or a != b)


def test_length_bound_loses_no_pair(spark):
    rows = [("abcd", "abcdefgh"), ("a", "abcdefghij"), ("abcdefghij", "abcdefghik")]
    df = spark.createDataFrame(rows, "a string, b string").withColumn("s", names.similarity("a", "b")).withColumn("ok", names.can_reach(F.col("a"), F.col("b"), 0.8))
    assert all(r.ok or r.s < 0.8 for r in df.collect())


@pytest.mark.parametrize(("seen", "want"), [(None, 0.8), (180, 1.0), (181, 0.8), (360, 0.8), (361, 0.6)])
def test_recency(spark, seen, want):
    as_of = dt.datetime(2024, 2, 1)
    c = F.lit(None).cast("timestamp") if seen is None else F.lit(as_of - dt.timedelta(days=seen))
    assert one(spark, texts.recency(c, F.lit(as_of))) == want


@pytest.mark.parametrize(("url", "kind", "want"), [("/strategic/x", "other", 1.0), ("/news/a", "other", 0.5), ("/a", "strategic_plan", 1.0), ("/b", "other", 0.8)])
def test_specificity(spark, url, kind, want):
    assert one(spark, texts.specificity(F.lit(url), F.lit(kind))) == want


def test_tiers_and_bands(spark):
    assert [one(spark, texts.outreach_tier(F.lit(a), F.lit(b), F.lit(c))) for a, b, c in ((1.0, 0.0, 2.0), (0.0, 1.5, 0.0), (0.0, 0.0, 0.0))] == ["tier1", "tier2", "tier3"]
    assert [one(spark, texts.presence_tier(*map(F.lit, x))) for x in (("s", "n", "m"), ("s", "n", ""), ("s", " ", ""), ("", "n", ""), (" ", "", "m"))] == list("ABCDE")
    c = search.composite(F.lit(0.5), F.lit(0.4), F.lit(9), F.lit(2.0))
    assert one(spark, c) == pytest.approx(5.8) and one(spark, search.confidence(c, F.lit(0.4))) == pytest.approx(0.55)


def test_urls(spark):
    assert one(spark, urls.link_priority(F.lit("https://x.org/about/plan"))) == 3
    assert one(spark, urls.repairs(F.lit("https://ww.a.org"))) == ["https://www.a.org"]
    assert one(spark, urls.repairs(F.lit("https://k12.wv.us"))) == [] and one(spark, urls.mail_sites(F.lit("a@gmail.com"))) == []
    assert one(spark, texts.category(F.lit("/graduate"), F.array().cast("array<string>"))) == "portrait_of_graduate"


def test_person_names(spark):
    for text, want in (("Dr. Ada B. Poe", ("Ada", "B. Poe")), ("Poe, Ada", ("Ada", "Poe")), ("Poe", ("", "Poe"))):
        first, last = names.split_person(F.lit(text))
        assert (one(spark, first), one(spark, last)) == want


def test_not_in_follows_sql(spark):
    left = spark.createDataFrame([("a",), (None,)], "k string")
    sets = lambda *x: spark.createDataFrame([(v,) for v in x], "k string")
    count = lambda right: basics.not_in(left, "k", right).count()
    assert count(sets("b")) == 1 and count(sets("b", None)) == 0 and count(spark.createDataFrame([], "k string")) == 2


def test_page_past_the_end(spark):
    df = spark.range(7)
    got = basics.page(df, [F.col("id")], 3, 6).collect()
    assert len(got) == 1 and not got[0].has_more and got[0].total == 7


def test_chunks_cover_all_words(spark):
    text = "One two three. " * 300 + "x" * 4000
    df = spark.createDataFrame([(1, text), (2, ""), (3, None)], "doc_id long, text string")
    got = [r.chunk for r in documents.chunk_sentences(df).orderBy("chunk_index").collect()]
    assert all(len(c) <= 1500 or " " not in c for c in got) and " ".join(got).split() == text.split()
    parts = documents.split_recursive(text, 600, 100, 1)
    assert all(len(p) <= 701 for p in parts) and sum(p.count("two") for p in documents.split_recursive(text, 600, 0, 1)) == 300
    assert documents.chunk_recursive(df).count() > 0


def test_links_are_resolved(spark):
    html = '<a href="/a">x</a><a href=\'b.pdf\'>y</a><a href="#c">z</a><a href="mailto:q">m</a><a href="//o.net/x">o</a><a href="/a">x</a>'
    got = {(r.link, r.kind) for r in documents.page_links(spark.createDataFrame([(1, "https://h.org/d/e?x=1", html)], "page_id long, url string, html string")).collect()}
    assert got == {("https://h.org/a", "internal"), ("https://h.org/d/b.pdf", "pdf"), ("https://o.net/x", "external")}


def test_exact_keyword_score(spark):
    docs = spark.createDataFrame([(1, "d", "a graduate profile here", "/plan", "other", dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 1))], "doc_id long, nces_id string, extracted_text string, document_url string, document_category string, discovered_at timestamp, crawled_at timestamp")
    m = taxonomy.match_taxonomy(docs, [("readiness", "graduate_profile", r"graduate\s+profile", 1.0, True)], "2024-02-01")
    assert taxonomy.score_entities(m, docs).first()["readiness"] == pytest.approx(2.4) and "graduate profile" in m.first()["context"]


def test_csv_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(1, 'a "b", c', "x"), (2, None, "N/A")], "id long, name string, note string")
    files.export_csv(rows, str(tmp_path / "c"), quote_all=True)
    got, bad = files.read_registry(spark, str(tmp_path / "c"), ["id", "name", "note"], {"id": "cast(id AS long)", "name": "name", "note": "note"})
    assert sorted(map(tuple, got.collect())) == [(1, 'a "b", c', "x"), (2, None, None)] and bad.count() == 0


def test_upsert_keeps_first_values(spark):
    old = spark.createDataFrame([(1, "t1", 5), (2, "t2", 6)], "k long, title string, n long")
    new = spark.createDataFrame([(2, "x", 9), (3, "y", 1)], "k long, title string, n long")
    assert sorted(map(tuple, files.upsert_latest(old, new, ["k"], ["title"]).collect())) == [(1, "t1", 5), (2, "t2", 9), (3, "y", 1)]


def test_search_of_every_hundredth_vector(spark):
    from veristry.plans import content  # noqa: F401
    from veristry.plans.registry import QUERIES

    got = QUERIES["vec_08_hundredth"](spark, "/root/testdata/sf0.1").collect()
    assert sorted((r.query_id, r.vec_id, r.place) for r in got) == sorted(brute_nearest(spark, "sf0.1", 10))


def test_search_many_takes_ties_by_id(spark):
    v = spark.createDataFrame([(i, [1.0, 2.0, 3.0]) for i in range(9)] + [(9, [0.0, 0.0, 0.0]), (10, None), (11, [1.0])], "vec_id long, embedding array<float>")
    got = search.search_many(v, v.select(v.vec_id.alias("query_id"), v.embedding.alias("q")).where("query_id > 7"), 3).collect()
    assert sorted((r.query_id, r.place, r.vec_id) for r in got) == [(8, 1, 0), (8, 2, 1), (8, 3, 2)]


def brute_nearest(spark, at, k):
    import numpy as np

    t = spark.read.parquet(f"/root/testdata/{at}/embeddings.parquet").toPandas()
    ids, x = t.vec_id.to_numpy(), np.stack(t.embedding.to_numpy()).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    out = []
    for q in np.flatnonzero(ids % 100 == 0):
        order = [j for j in np.lexsort((ids, np.round(1 - x @ x[q], 12))) if j != q][:k]
        out += [(int(ids[q]), int(ids[j]), n + 1) for n, j in enumerate(order)]
    return out


def test_recursive_chunks_cover_whole_texts(spark):
    text = " ".join(f"word{i}" for i in range(12_000)) + " last"
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    whole = [r.chunk for r in documents.chunk_recursive(df).orderBy("chunk_index").collect()]
    assert whole[-1].endswith(" last") and set(text.split()) == {w for c in whole for w in c.split() if w in set(text.split())}
    short = [r.chunk for r in documents.chunk_recursive(df, cap=50_000).orderBy("chunk_index").collect()]
    assert not short[-1].endswith(" last") and all(w in text[:50_000] for w in short[-1].split())


def test_plans_push_filters_and_avoid_sorting_all(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    plan = df.where("l_quantity > 10").select("l_orderkey")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,10.0)]" in plan
    from veristry.plans import content  # noqa: F401
    from veristry.plans.registry import QUERIES

    assert "TakeOrderedAndProject" in QUERIES["vec_01_search"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()


def test_rows_of_names_equal_single_names():
    rng = random.Random(1)
    word = lambda: "".join(rng.choices("abcdé ", k=rng.randrange(14)))
    a = [word() for _ in range(4000)]
    b = [x if rng.random() < 0.1 else word() for x in a]
    want = np.array([names.jaro_winkler(x, y) for x, y in zip(a, b, strict=True)])
    assert (names.jaro_winkler_rows(np.array(a, object), np.array(b, object)) == want).all()
    cut = names.jaro_winkler_rows(np.array(a, object), np.array(b, object), 0.8)
    assert (cut[want >= 0.8] == want[want >= 0.8]).all() and np.isnan(cut).any() and not (cut[want < 0.8] >= 0.8).any()


REGISTRY = [(1, "S1", "North Union", None), (2, "S1", "South Hil", "a@southhillsd.k12.org"), (3, "S1", "East Vale", "b@gmail.com"), (4, "S2", "North Union", "c@westport.org"), (5, "S1", "nowhere", "x@abc.org"), (6, "S1", None, None)]
BASELINE = [("11", "S1", "North A"), ("12", "S1", "North B District"), ("13", "S1", "South Hill"), ("14", "S1", "East Vales"), ("15", "S2", "West Port"), ("16", "S2", "North A"), ("17", "S1", None)]


def test_units_hints_then_names(spark):
    registry = spark.createDataFrame([(*r, "c") for r in REGISTRY], "id long, state string, district_name string, email string, city string")
    baseline = spark.createDataFrame([(*r, "c") for r in BASELINE], "nces_id string, state string, district_name string, city string")
    units = spark.createDataFrame([("north union", ["north a", "north b distric"])], "unit string, names array<string>")
    pairs = lambda df: {(r.id, r.nces_id) for r in df.collect()}
    assert pairs(matching.map_units(registry, units, baseline)) == {(1, "11"), (1, "12"), (4, "16")}
    assert pairs(matching.mail_hints(registry, baseline)) == {(2, "13"), (4, "15")}
    got = {(r.id, r.nces_id, r.match_method) for r in matching.match_with_hints(registry, units, baseline).collect()}
    assert got == {(1, "11", "map"), (1, "12", "map"), (4, "16", "map"), (2, "13", "mail_hint"), (3, "14", "normalized_name")}


@pytest.mark.parametrize("cut", [0.8, 0.9])
def test_similar_in_block_against_brute_force(spark, cut):
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcd ", k=rng.randrange(3, 12)))
    r, b = [(i, rng.choice("xy"), word().upper()) for i in range(120)], [(str(i), rng.choice("xy"), word()) for i in range(120)]
    got = matching.similar_in_block(spark.createDataFrame(r, "id long, state string, district_name string"), spark.createDataFrame(b, "nces_id string, state string, district_name string"), ["state"], cut)
    want = {(i, j) for i, s, a in r for j, t, c in b if s == t and names.jaro_winkler(a.lower(), c.lower()) >= cut}
    assert want and {(x.id, x.nces_id) for x in got.collect()} == want


def test_conflicts_by_tier_then_age(spark):
    m = spark.createDataFrame([("1", 1, 0.9), ("1", 2, 0.99), ("1", 3, 0.8), ("2", 4, 0.8)], "nces_id string, registry_id long, confidence double")
    r = spark.createDataFrame([(1, "2024-01-01", 2), (2, "2024-01-01", 3), (3, "2024-02-01", 2), (4, None, None)], "id long, at string, tier int").selectExpr("id", "cast(at AS timestamp) AS imported_at", "tier")
    kept = lambda *a: {(x.nces_id, x.registry_id, x.flag) for x in matching.resolve_conflicts(m, r, *a).where("kept").collect()}
    assert kept() == {("1", 2, "DUPLICATE_MATCH"), ("2", 4, None)} and kept("tier") == {("1", 3, "DUPLICATE_MATCH"), ("2", 4, None)}


def test_latest_table_goes_on_after_a_restart(spark):
    from veristry.sources import buckets
    from veristry.streaming import jobs

    folder = f"{spark.conf.get('spark.checkpoint.dir')}/latest-{random.random()}"
    put = lambda rows: spark.createDataFrame(rows, "k string, n long").coalesce(1).write.mode("append").parquet(f"{folder}/in")
    table = lambda: jobs.latest_table(spark, spark.readStream.schema("k string, n long").option("maxFilesPerTrigger", 1).parquet(f"{folder}/in"), ["k"], "n", f"{folder}/t")
    rows = lambda df: sorted(map(tuple, df.collect()))
    put([("a", 1), ("b", 5)])
    put([("a", 3)])
    put([("a", 2), ("c", 1)])
    assert rows(table()) == [("a", 3), ("b", 5), ("c", 1)] and len(buckets.versions(spark, f"{folder}/t/manifest")) == 2
    assert rows(table()) == [("a", 3), ("b", 5), ("c", 1)]  # nothing new
    put([("b", 9)])
    assert rows(table()) == [("a", 3), ("b", 9), ("c", 1)]


def test_candidate_sites_in_all_forms(spark):
    from pyspark.sql import functions as F

    from veristry.functions.urls import candidate_urls

    rows = [("Santa Ana Unified School District", "CA"), ("Waco Independent School District", "TX"), ("Clarke County", "GA"), ("East Orange Public Schools", "NJ"), ("County", "CA"), ("", "CA"), (None, "CA"), ("Lee", None), ("Ab Cd", "CA"), ("St. John's Parish", "LA"), ("Élan", "CA")]
    got = {r.n: list(r.u) for r in spark.createDataFrame(rows, "n string, s string").select("n", candidate_urls(F.col("n"), F.col("s")).alias("u")).collect()}
    ana = got["Santa Ana Unified School District"]
    assert ana[:4] == ["https://www.santaana.k12.ca.us", "https://santaana.k12.ca.us", "https://www.santa-ana.k12.ca.us", "https://www.santaanaschools.org"]
    assert ana[-3:] == ["https://www.santaschools.org", "https://www.santa.k12.ca.us", "https://santa.k12.ca.us"] and len(ana) == len(set(ana)) == 18
    assert {f"https://www.wacoisd.{e}" for e in ("org", "net", "com")} <= set(got["Waco Independent School District"]) and len(got["Waco Independent School District"]) == 17
    assert "https://www.clarke.schoolinsites.com" in got["Clarke County"] and "https://www.clarkecounty.schoolinsites.com" in got["Clarke County"]
    assert "https://www.eastorangeboe.org" in got["East Orange Public Schools"] and "https://www.eastschools.org" in got["East Orange Public Schools"]
    assert got["County"] == got[""] == got[None] == got["Lee"] == []
    assert not any("https://www.ab." in u for u in got["Ab Cd"])  # a first word of two letters isn't tried
    assert got["St. John's Parish"][0] == "https://www.stjohns.k12.la.us" and got["Élan"][0] == "https://www.lan.k12.ca.us"


def plain_jaro_winkler(a, b):
    """By definition: letters that agree within half the longer length, transposed pairs, and a common beginning of four at most."""
    if not a or not b:
        return 0.0
    reach, met = max(len(a), len(b)) // 2 - 1, [False] * len(b)
    mine = []
    for i, x in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not met[j] and b[j] == x:
                met[j] = True
                mine.append(x)
                break
    if not mine:
        return 1.0 if a == b else 0.0
    theirs = [x for x, m in zip(b, met, strict=True) if m]
    turned = sum(x != y for x, y in zip(mine, theirs, strict=True)) / 2  # a half counts
    j = (len(mine) / len(a) + len(mine) / len(b) + (len(mine) - turned) / len(mine)) / 3
    same = next((k for k in range(4) if a[k : k + 1] != b[k : k + 1] or k >= min(len(a), len(b))), 4)
    return j + 0.1 * same * (1 - j)


def test_similarity_query_is_that_of_brute_force(spark):
    from veristry.plans import more  # noqa: F401
    from veristry.plans.registry import QUERIES, Tables

    t = Tables(spark, "/root/testdata/sf0.001")
    districts = [(d.nces_id, d.state, d.city, d.district_name) for d in t.districts.collect()]
    want = {(r.id, n): plain_jaro_winkler(r.district_name.lower(), name) for r in t.registry.collect() for n, s, c, name in districts if (s, c) == (r.state, r.city)}
    got = {(r.id, r.nces_id): r.s for r in QUERIES["match_03_similarity"](spark, "/root/testdata/sf0.001").collect()}
    assert set(got) == set(want) and len(got) > 50
    bad = {k: (got[k], want[k]) for k in got if abs(got[k] - want[k]) > 2e-6}
    assert not bad, list(bad.items())[:3]


def test_similarities_shuffle_tiles_and_not_pairs(spark):
    name = lambda i: None if i % 40 == 7 else "Hot" if i % 3 == 0 else f"Name {i} Ab"
    left = [(i, None if i == 5 else f"S{i % 2}", name(i)) for i in range(500)]
    right = [(f"d{i}", f"S{i % 2}", name(i)) for i in range(500)]
    want = {(i, d): None if a is None or b is None else plain_jaro_winkler(a.lower(), b) for i, s, a in left for d, z, b in right if s == z}
    sides = spark.createDataFrame(left, "id long, state string, district_name string"), spark.createDataFrame(right, "nces_id string, state string, district_name string")
    store, none = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway.new_array(spark._jvm.double, 0)

    def sent():
        stages = store.stageList(None, False, False, none, None)
        return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = sent()
        rows = matching.similarities(*sides, ["state"], tile=64).collect()
        assert sent() - before < 3_000  # of 124,500 pairs
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(rows) == len(want) and {(r.id, r.nces_id) for r in rows} == set(want)
    assert all(r.s is want[r.id, r.nces_id] if None in (r.s, want[r.id, r.nces_id]) else abs(r.s - want[r.id, r.nces_id]) < 2e-6 for r in rows)


@pytest.mark.parametrize("kept", [(5, 3), (40, 200), (8192, 2048)])
def test_kept_similarities_are_those_of_the_names(kept, monkeypatch):
    monkeypatch.setattr(matching, "KEPT", kept)
    rng, compared, counted = random.Random(4), matching._Compared(6), []
    compare = matching.similar_in_tile
    monkeypatch.setattr(matching, "similar_in_tile", lambda *of, only: counted.append(only.sum()) or compare(*of, only=only))
    words = [None, "", *("".join(rng.choices("abcdé ", k=9)) for _ in range(150))]
    for _ in range(40):
        a, b = (np.array(rng.sample(words, n), object) for n in (rng.randrange(1, 140), rng.randrange(1, 150)))
        want = [[-1 if None in (x, y) else round(plain_jaro_winkler(x, y) * 1e6) if x or y else 1_000_000 for y in b] for x in a]
        assert np.abs(compared.of(a, b) - want).max() <= 1
    assert kept[0] < 1000 or sum(counted) <= 151 * 151  # each pair once if all are kept


def test_rounding_is_that_of_sql(spark):
    rng = np.random.default_rng(3)
    x = np.r_[(np.arange(0, 1_000_000, 7) + 0.5) / 1e6, rng.integers(0, 900, 20_000) / rng.integers(900, 2_000, 20_000), np.arange(257) / 256, np.arange(1025) / 1024, rng.random(5_000)]
    want = [r.x for r in spark.createDataFrame([(float(v),) for v in x], "x double").select(F.round("x", 6).alias("x")).collect()]
    assert names.rounded(x, 6).tolist() == want and np.isnan(names.rounded(np.array([np.nan]), 6)).all()


@pytest.mark.parametrize("cut", [0.0, 0.8, 0.9])
@pytest.mark.parametrize("longest", [12, 80])
def test_tiles_of_names_equal_single_names(cut, longest):
    rng = random.Random(longest)
    word = lambda: "".join(rng.choices("abcdé ", k=rng.randrange(longest)))
    a, b = ([*(word() for _ in range(70)), "", "abc"] for _ in range(2))
    want = {(i, j): names.jaro_winkler(x, y) for i, x in enumerate(a) for j, y in enumerate(b)}
    found = lambda best: {(int(i), int(j)): s for i, j, s in zip(*names.similar_in_tile(np.array(a, object), np.array(b, object), cut, best), strict=True)}
    assert found(False) == {k: s for k, s in want.items() if s >= cut}
    top = [max(round(want[i, j], 9) for j in range(len(b))) for i in range(len(a))]
    assert found(True) == {(i, j): s for (i, j), s in want.items() if s >= cut and round(s, 9) == top[i]}


def test_classes_are_all_pairs_once(spark):
    registry = spark.createDataFrame([(*r, "c") for r in [*REGISTRY, (7, "S1", "NORTH UNION", None)]], "id long, state string, district_name string, email string, city string")
    baseline = spark.createDataFrame([(*r, "c") for r in [*BASELINE, ("18", "S1", "NORTH A")]], "nces_id string, state string, district_name string, city string")
    units = spark.createDataFrame([("north union", ["north a", "north b distric"])], "unit string, names array<string>")

    def expanded(df):
        side = lambda kind, *columns: df.where(f"kind = '{kind}'").select(*columns)
        pairs = side("pair", "row_class", "district_class") if "name" not in df.columns else side("name", "row_class", "state", "name").join(side("pair", "state", "name", "district_class"), ["state", "name"])
        out = side("row", "id", "row_class").join(pairs, "row_class").join(side("district", "nces_id", "district_class"), "district_class")
        return {(r.id, r.nces_id) for r in out.collect()}

    classes = matching.map_units(registry, units, baseline, classes=True)
    assert expanded(classes) == {(r.id, r.nces_id) for r in matching.map_units(registry, units, baseline).collect()}
    assert (7, "18") in expanded(classes) and classes.where("kind = 'pair'").count() == 3
    alike = matching.similar_in_block(registry, baseline, ["state", "city"], 0.7, classes=True)
    assert expanded(alike) == {(r.id, r.nces_id) for r in matching.similar_in_block(registry, baseline, ["state", "city"], 0.7).collect()}
    both = matching.match_with_hints(registry, units, baseline, classes=True)
    others = {(r.id, r.nces_id) for r in both.where("kind = 'match'").collect()}
    assert expanded(both) | others == {(r.id, r.nces_id) for r in matching.match_with_hints(registry, units, baseline).collect()} and others


def test_hint_classes_are_all_pairs(spark):
    registry = spark.createDataFrame([(*r, "c") for r in REGISTRY], "id long, state string, district_name string, email string, city string")
    baseline = spark.createDataFrame([(*r, "c") for r in BASELINE], "nces_id string, state string, district_name string, city string")
    found = matching.mail_hints(registry.union(registry.withColumn("id", F.col("id") + 100)), baseline, classes=True)
    side = lambda kind, *columns: found.where(f"kind = '{kind}'").select(*columns)
    out = side("row", "id", "row_class").join(side("pair", "row_class", "district_class"), "row_class").join(side("district", "nces_id", "district_class"), "district_class")
    assert {(r.id, r.nces_id) for r in out.collect()} == {(2, "13"), (4, "15"), (102, "13"), (104, "15")} and side("pair", "row_class").count() == 2
