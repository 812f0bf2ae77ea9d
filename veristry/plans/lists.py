"""Filters, joins, paging, per-key picks and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import basics as B
from ..operators import insights as I
from ..operators import matching as M
from .registry import query

D = "nces_id, state, district_name"


@query("flt_01_filter_list", "SELECT d.nces_id, state, enrollment, total FROM districts d JOIN scores s ON d.nces_id = s.nces_id WHERE state IN ('S01', 'S02', 'S03', 'S04') AND outreach_tier IN ('tier1', 'tier2') AND enrollment >= 1000 AND frpl_percent >= 10 AND total >= 1 AND frpl_percent <= 95", "districts scores")
def flt_01(t):
    df = t.districts.join(t.scores, "nces_id")
    return B.filter_entities(df, states=["S01", "S02", "S03", "S04"], tiers=["tier1", "tier2"], minimum={"enrollment": 1000, "frpl_percent": 10, "total": 1}, maximum={"frpl_percent": 95}).select("nces_id", "state", "enrollment", "total")


@query("flt_02_has_contact", "SELECT nces_id, state FROM districts d WHERE EXISTS (SELECT 1 FROM registry r WHERE r.state_district_id = d.nces_id AND (last_name IS NOT NULL OR email IS NOT NULL))", "districts registry")
def flt_02(t):
    return B.with_contact(t.districts, t.registry).select("nces_id", "state")


@query("flt_02_has_no_contact", "SELECT nces_id, state FROM districts d WHERE NOT EXISTS (SELECT 1 FROM registry r WHERE r.state_district_id = d.nces_id AND (last_name IS NOT NULL OR email IS NOT NULL))", "districts registry")
def flt_02b(t):
    return B.with_contact(t.districts, t.registry, wanted=False).select("nces_id", "state")


@query("flt_03_name_search", "SELECT nces_id, district_name FROM districts d WHERE district_name ILIKE '%machinery 4%' OR EXISTS (SELECT 1 FROM registry r WHERE r.state_district_id = d.nces_id AND (r.district_name ILIKE '%machinery 4%' OR concat_ws(' ', first_name, last_name) ILIKE '%machinery 4%'))", "districts registry")
def flt_03(t):
    return B.search_names(t.districts, t.registry, "machinery 4").select("nces_id", "district_name")


@query("flt_04_locale", "SELECT nces_id, locale_code FROM districts WHERE locale_code IN ('11', '12', '13', '41', '42', '43')", "districts")
def flt_04(t):
    return B.filter_entities(t.districts, locales=["city", "rural"]).select("nces_id", "locale_code")


@query("flt_05_simple_list", "SELECT nces_id, district_name FROM districts WHERE district_name ILIKE '%school%' AND superintendent_email IS NOT NULL ORDER BY district_name, nces_id LIMIT 20 OFFSET 10", "districts")
def flt_05(t):
    d = t.districts.where(F.col("district_name").ilike("%school%") & F.col("superintendent_email").isNotNull())
    return d.orderBy("district_name", "nces_id").offset(10).limit(20).select("nces_id", "district_name")


@query("flt_06_score_list", "SELECT d.nces_id, total, readiness FROM districts d JOIN scores s ON d.nces_id = s.nces_id WHERE total >= 2 AND readiness >= 1.5", "districts scores")
def flt_06(t):
    return B.filter_entities(t.districts.join(t.scores, "nces_id"), minimum={"total": 2, "readiness": 1.5}).select("nces_id", "total", "readiness")


@query("flt_07_top_by_category", "SELECT d.nces_id, activation FROM districts d JOIN scores s ON d.nces_id = s.nces_id WHERE state = 'S05' ORDER BY activation DESC NULLS FIRST, d.nces_id LIMIT 10", "districts scores")
def flt_07(t):
    return t.districts.where("state = 'S05'").join(t.scores, "nces_id").orderBy(F.desc_nulls_first("activation"), "nces_id").limit(10).select("nces_id", "activation")


@query("flt_08_overlay", "SELECT d.nces_id, coalesce(nullif(r.email, ''), d.superintendent_email) AS superintendent_email, coalesce(nullif(r.website_url, ''), d.website_url) AS website_url, coalesce(r.enrollment, d.enrollment) AS enrollment FROM districts d LEFT JOIN registry r ON r.state_district_id = d.nces_id", "districts registry")
def flt_08(t):
    r = t.registry.withColumn("nces_id", F.col("state_district_id"))
    return B.overlay(t.districts.select("nces_id", "superintendent_email", "website_url", "enrollment"), r, {"superintendent_email": "email", "website_url": "website_url"}, {"enrollment": "enrollment"})


@query("flt_09_keyed_lookup", "SELECT d.nces_id, doc_id, title FROM docs d JOIN (SELECT nces_id FROM districts WHERE k IN (7, 14, 21)) k ON d.nces_id = k.nces_id", "docs districts")
def flt_09(t):
    keys = t.districts.where(F.col("k").isin(7, 14, 21)).select("nces_id")
    return t.docs.join(keys, "nces_id").select("nces_id", "doc_id", "title")


@query("flt_10_keyword_search", "SELECT doc_id, title, substr(extracted_text, 1, 500) AS preview, CASE WHEN title ILIKE '%the%' THEN 1 ELSE 2 END AS place FROM docs WHERE extracted_text ILIKE '%the%' AND document_type IN ('html') ORDER BY place, title, doc_id LIMIT 50", "docs")
def flt_10(t):
    return B.keyword_search(t.docs, "the", ["html"], 50)


@query("flt_11_date_range", "SELECT doc_id, crawled_at FROM docs WHERE crawled_at >= TIMESTAMP '2023-03-01' AND crawled_at <= TIMESTAMP '2023-04-01'", "docs")
def flt_11(t):
    return t.docs.where((F.col("crawled_at") >= F.lit("2023-03-01").cast("date")) & (F.col("crawled_at") <= F.lit("2023-04-01").cast("date"))).select("doc_id", "crawled_at")


@query("flt_12_crawl_candidates", "SELECT nces_id, website_url, enrollment FROM districts d WHERE website_url <> '' AND website_url NOT ILIKE '%facebook%' AND NOT EXISTS (SELECT 1 FROM docs x WHERE x.nces_id = d.nces_id) ORDER BY enrollment DESC NULLS LAST, nces_id LIMIT 100", "districts docs")
def flt_12(t):
    d = t.districts.where((F.col("website_url") != "") & ~F.col("website_url").ilike("%facebook%")).join(t.docs.select("nces_id"), "nces_id", "left_anti")
    return d.orderBy(F.desc_nulls_last("enrollment"), "nces_id").limit(100).select("nces_id", "website_url", "enrollment")


@query("join_01_inner_chain", "SELECT vec_id, v.doc_id, d.nces_id FROM vectors v JOIN docs d ON v.doc_id = d.doc_id JOIN districts x ON x.nces_id = d.nces_id", "vectors docs districts")
def join_01(t):
    return t.vectors.select("vec_id", "doc_id").join(t.docs.select("doc_id", "nces_id"), "doc_id").join(t.districts.select("nces_id"), "nces_id").select("vec_id", "doc_id", "nces_id")


@query("join_02_left_scores", "SELECT d.nces_id, total, outreach_tier FROM districts d LEFT JOIN scores s ON d.nces_id = s.nces_id", "districts scores")
def join_02(t):
    return t.districts.select("nces_id").join(t.scores.select("nces_id", "total", "outreach_tier"), "nces_id", "left")


REGISTRY_SQL = """WITH best AS (
  SELECT m.* FROM matches m JOIN registry r ON r.id = m.registry_id
  QUALIFY row_number() OVER (PARTITION BY m.nces_id ORDER BY confidence DESC, imported_at DESC, m.registry_id) = 1
) SELECT d.nces_id, d.state, d.district_name, coalesce(r.first_name || ' ' || r.last_name, nullif(superintendent_name, '')) AS superintendent_name, coalesce(nullif(r.email, ''), superintendent_email) AS superintendent_email,
  coalesce(r.website_url, nullif(d.website_url, '')) AS website_url, coalesce(r.enrollment, d.enrollment) AS enrollment, match_method, confidence, CASE WHEN b.registry_id IS NOT NULL THEN 'state_registry' ELSE 'baseline' END AS primary_source
FROM districts d LEFT JOIN best b ON b.nces_id = d.nces_id LEFT JOIN registry r ON r.id = b.registry_id"""


@query("join_03_registry_view", REGISTRY_SQL, "districts matches registry")
def join_03(t):
    return M.registry_view(t.districts, M.resolve_conflicts(t.matches, t.registry).where("kept"), t.registry)


@query("join_04_presence", "SELECT d.nces_id, coalesce(total, 0) AS total, coalesce(nullif(r.email, ''), superintendent_email) AS mail FROM districts d LEFT JOIN scores s ON s.nces_id = d.nces_id LEFT JOIN registry r ON r.state_district_id = d.nces_id WHERE s.nces_id IS NOT NULL OR r.id IS NOT NULL", "districts scores registry")
def join_04(t):
    j = t.districts.join(t.scores.select(F.col("nces_id").alias("s"), "total"), F.col("nces_id") == F.col("s"), "left").join(t.registry.select("id", "state_district_id", "email"), F.col("nces_id") == F.col("state_district_id"), "left")
    return j.where("s IS NOT NULL OR id IS NOT NULL").select("nces_id", F.coalesce("total", F.lit(0.0)).alias("total"), F.coalesce(F.nullif("email", F.lit("")), "superintendent_email").alias("mail"))


@query("join_05_semi", "SELECT nces_id FROM districts d WHERE EXISTS (SELECT 1 FROM crawl c WHERE c.nces_id = d.nces_id AND status = 'success')", "districts crawl")
def join_05(t):
    return t.districts.select("nces_id").join(t.crawl.where("status = 'success'").select("nces_id"), "nces_id", "left_semi")


@query("join_06_double_anti", "SELECT nces_id FROM districts d WHERE website_url <> '' AND NOT EXISTS (SELECT 1 FROM crawl c WHERE c.nces_id = d.nces_id) AND NOT EXISTS (SELECT 1 FROM docs x WHERE x.nces_id = d.nces_id)", "districts crawl docs")
def join_06(t):
    return t.districts.where("website_url <> ''").select("nces_id").join(t.crawl.select("nces_id"), "nces_id", "left_anti").join(t.docs.select("nces_id"), "nces_id", "left_anti")


@query("join_07_not_in", "SELECT DISTINCT nces_id FROM crawl WHERE status = 'failure' AND nces_id NOT IN (SELECT nces_id FROM docs WHERE document_type = 'pdf')", "crawl docs")
def join_07(t):
    return B.not_in(t.crawl.where("status = 'failure'").select("nces_id").distinct(), "nces_id", t.docs.where("document_type = 'pdf'").select("nces_id"))


@query("join_08_not_embedded", "SELECT d.doc_id FROM docs d LEFT JOIN vectors v ON v.doc_id = d.doc_id WHERE v.doc_id IS NULL", "docs vectors")
def join_08(t):
    return t.docs.select("doc_id").join(t.vectors.select("doc_id"), "doc_id", "left_anti")


@query("join_11_exact_id", "SELECT r.id, d.nces_id, 'exact_id' AS match_method, 1.0e0 AS confidence, false AS review FROM registry r JOIN districts d ON r.state_district_id = d.nces_id", "registry districts")
def join_11(t):
    return M.match_ids(t.registry, t.districts)


@query("join_12_map", "SELECT id, u FROM registry, (SELECT unnest(['a', 'b']) AS u, unnest(['S01', 'S02']) AS s) m WHERE registry.state = m.s", "registry")
def join_12(t):
    units = t.spark.sql("SELECT inline(array(struct('a' AS u, 'S01' AS s), struct('b' AS u, 'S02' AS s)))")
    return t.registry.join(F.broadcast(units), F.col("state") == F.col("s")).select("id", "u")


@query("join_13_containment", "SELECT r.id, d.nces_id FROM registry r JOIN districts d ON r.state = d.state AND contains(d.district_name, split_part(lower(r.district_name), ' ', 2)) WHERE r.email <> '' AND d.city = r.city", "registry districts")
def join_13(t):
    r = t.registry.where("email <> ''").select("id", F.col("state").alias("s"), F.col("city").alias("c"), F.split_part(F.lower("district_name"), F.lit(" "), F.lit(2)).alias("hint"))
    return r.join(t.districts, (F.col("s") == F.col("state")) & (F.col("c") == F.col("city")) & F.col("district_name").contains(F.col("hint"))).select("id", "nces_id")


@query("join_14_unnest", "SELECT id, unnest(top_ids) AS nces_id FROM searches", "searches")
def join_14(t):
    return t.searches.select("id", F.explode("top_ids").alias("nces_id"))


@query("join_15_enrich_page", "SELECT p.nces_id, r.id FROM (SELECT nces_id FROM districts ORDER BY district_name, nces_id LIMIT 50) p LEFT JOIN registry r ON r.state_district_id = p.nces_id", "districts registry")
def join_15(t):
    page = t.districts.orderBy("district_name", "nces_id").limit(50).select("nces_id")
    return page.join(t.registry.select("id", F.col("state_district_id").alias("nces_id")), "nces_id", "left")


@query("join_16_attribution", "SELECT s.nces_id, x.doc_id FROM (SELECT nces_id, city, state FROM districts d WHERE NOT EXISTS (SELECT 1 FROM docs y WHERE y.nces_id = d.nces_id)) s JOIN (SELECT doc_id, city, state FROM docs JOIN districts USING (nces_id)) x ON x.city = s.city AND x.state = s.state", "districts docs")
def join_16(t):
    lacking = t.districts.join(t.docs.select("nces_id"), "nces_id", "left_anti").select("nces_id", "city", "state")
    owned = t.docs.select("doc_id", "nces_id").join(t.districts.select("nces_id", "city", "state"), "nces_id").drop("nces_id")
    return lacking.join(owned, ["city", "state"]).select("nces_id", "doc_id")


@query("join_17_url_candidates", "SELECT d.nces_id, coalesce(f.url, nullif(d.website_url, ''), r.website_url) AS url FROM districts d LEFT JOIN (SELECT nces_id, url FROM crawl WHERE status = 'failure' QUALIFY row_number() OVER (PARTITION BY nces_id ORDER BY crawled_at DESC, event_id DESC) = 1) f ON f.nces_id = d.nces_id LEFT JOIN registry r ON r.state_district_id = d.nces_id", "districts crawl registry")
def join_17(t):
    failed = B.latest_per_key(t.crawl.where("status = 'failure'"), ["nces_id"], [F.desc("crawled_at"), F.desc("event_id")]).select("nces_id", "url")
    r = t.registry.select(F.col("state_district_id").alias("nces_id"), F.col("website_url").alias("r_site"))
    return t.districts.join(failed, "nces_id", "left").join(r, "nces_id", "left").select("nces_id", F.coalesce("url", F.nullif("website_url", F.lit("")), "r_site").alias("url"))


@query("join_18_cohort", "SELECT s.id, s.user_id, d.nces_id, district_name FROM searches s LEFT JOIN districts d ON d.nces_id = s.user_id ORDER BY generated_at DESC, s.id LIMIT 200", "searches districts")
def join_18(t):
    s = t.searches.join(t.districts.select("nces_id", "district_name"), F.col("user_id") == F.col("nces_id"), "left")
    return s.orderBy(F.desc("generated_at"), "id").limit(200).select("id", "user_id", "nces_id", "district_name")


@query("topk_02_page", "SELECT nces_id, district_name, (SELECT count(*) FROM districts) AS total, (SELECT count(*) FROM districts) > 60 AS has_more FROM districts ORDER BY district_name, nces_id LIMIT 20 OFFSET 40", "districts")
def topk_02(t):
    return B.page(t.districts.select("nces_id", "district_name"), [F.col("district_name"), F.col("nces_id")], 20, 40)


@query("topk_03_top_per_state", "SELECT state, d.nces_id, total FROM districts d JOIN scores s ON s.nces_id = d.nces_id QUALIFY row_number() OVER (PARTITION BY state ORDER BY total DESC, d.nces_id) <= 10", "districts scores")
def topk_03(t):
    return B.latest_per_key(t.districts.join(t.scores, "nces_id"), ["state"], [F.desc("total"), F.col("nces_id")], 10).select("state", "nces_id", "total")


@query("topk_04_global_top", "SELECT nces_id, total FROM scores ORDER BY total DESC, nces_id LIMIT 10", "scores")
def topk_04(t):
    return t.scores.orderBy(F.desc("total"), "nces_id").limit(10).select("nces_id", "total")


@query("topk_06_nulls_last", "SELECT nces_id, enrollment FROM districts ORDER BY enrollment DESC NULLS LAST, nces_id LIMIT 30", "districts")
def topk_06(t):
    return t.districts.orderBy(F.desc_nulls_last("enrollment"), "nces_id").limit(30).select("nces_id", "enrollment")


@query("topk_07_random_sample", "SELECT id, district_name FROM registry ORDER BY md5('7/' || id), id LIMIT 10", "registry")
def topk_07(t):
    return t.registry.orderBy(F.md5(F.concat(F.lit("7/"), F.col("id").cast("string"))), "id").limit(10).select("id", "district_name")


@query("win_01_percent_of_total", "SELECT match_method, count(*) AS n, round(100.0e0 * count(*) / sum(count(*)) OVER (), 2) AS share FROM matches GROUP BY match_method", "matches")
def win_01(t):
    return I.shares(t.matches, "match_method")


@query("win_02_latest_failure", "SELECT nces_id, event_id, url FROM crawl WHERE status = 'failure' QUALIFY row_number() OVER (PARTITION BY nces_id ORDER BY crawled_at DESC, event_id DESC) = 1", "crawl")
def win_02(t):
    return B.latest_per_key(t.crawl.where("status = 'failure'"), ["nces_id"], [F.desc("crawled_at"), F.desc("event_id")]).select("nces_id", "event_id", "url")


@query("win_03_latest_per_url", "SELECT url, event_id FROM crawl WHERE NOT extraction_success QUALIFY row_number() OVER (PARTITION BY url ORDER BY crawled_at DESC, event_id DESC) = 1", "crawl")
def win_03(t):
    return B.latest_per_key(t.crawl.where("NOT extraction_success"), ["url"], [F.desc("crawled_at"), F.desc("event_id")]).select("url", "event_id")


@query("win_04_shallowest", "SELECT nces_id, doc_id, page_depth FROM docs d WHERE NOT EXISTS (SELECT 1 FROM docs x WHERE x.nces_id = d.nces_id AND x.text_length >= 2000) QUALIFY row_number() OVER (PARTITION BY nces_id ORDER BY page_depth, doc_id) = 1", "docs")
def win_04(t):
    poor = t.docs.join(t.docs.where("text_length >= 2000").select("nces_id"), "nces_id", "left_anti")
    return B.latest_per_key(poor, ["nces_id"], [F.col("page_depth"), F.col("doc_id")]).select("nces_id", "doc_id", "page_depth")


@query("win_06_rank", "SELECT row_number() OVER (PARTITION BY outreach_tier ORDER BY total DESC, nces_id) AS place, outreach_tier, nces_id FROM scores", "scores")
def win_06(t):
    return t.scores.select(F.row_number().over(Window.partitionBy("outreach_tier").orderBy(F.desc("total"), "nces_id")).cast("long").alias("place"), "outreach_tier", "nces_id")


@query("set_01_union_all", "SELECT 'readiness' AS category, count(*) AS n FROM scores WHERE readiness >= 3 UNION ALL SELECT 'activation', count(*) FROM scores WHERE activation >= 2", "scores")
def set_01(t):
    one = lambda c, least: t.scores.where(F.col(c) >= least).agg(F.lit(c).alias("category"), F.count("*").alias("n"))
    return one("readiness", 3).unionByName(one("activation", 2))


@query("set_02_distinct", "SELECT DISTINCT state, city FROM districts", "districts")
def set_02(t):
    return t.districts.select("state", "city").distinct()


@query("set_03_difference", "SELECT nces_id FROM districts WHERE nces_id NOT IN (SELECT nces_id FROM crawl WHERE crawled_at >= TIMESTAMP '2024-01-25 00:00:00')", "districts crawl")
def set_03(t):
    return t.districts.select("nces_id").join(t.crawl.where("crawled_at >= TIMESTAMP '2024-01-25 00:00:00'").select("nces_id"), "nces_id", "left_anti")


@query("set_04_insert_ignore", "SELECT user_id, nces_id FROM (SELECT DISTINCT user_id, unnest(top_ids) AS nces_id FROM searches WHERE generated_at >= TIMESTAMP '2024-01-02 00:00:00') EXCEPT SELECT user_id, unnest(top_ids) FROM searches WHERE generated_at < TIMESTAMP '2024-01-02 00:00:00'", "searches")
def set_04(t):
    new = F.col("generated_at") >= F.lit("2024-01-02").cast("timestamp_ntz")
    pairs = lambda rows: rows.select("user_id", F.explode("top_ids").alias("nces_id"))
    return pairs(t.searches.where(new)).distinct().join(pairs(t.searches.where(~new)), ["user_id", "nces_id"], "left_anti")
