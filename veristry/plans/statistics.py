"""Coverage, score, crawl and search statistics, matching, quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.names import RULES, normalise_name, split_person
from ..functions.texts import presence_tier
from ..operators import insights as I
from ..operators import matching as M
from ..operators import quality as Q
from .bind import AS_OF
from .registry import query

MEANS = ", ".join(f"round(avg({c}), 2) AS mean_{c}" for c in I.SCORES)
TIER_COUNTS = ", ".join(f"count(*) FILTER (outreach_tier = '{x}') AS {x}" for x in I.TIERS)


@query("agg_01_overview", f"SELECT * FROM (SELECT count(*) AS n, count(superintendent_name) AS with_name, count(superintendent_email) AS with_mail, round(100.0e0 * count(superintendent_name) / count(*), 1) AS name_percent, round(100.0e0 * count(superintendent_email) / count(*), 1) AS mail_percent FROM districts), (SELECT {MEANS}, {TIER_COUNTS} FROM scores), (SELECT count(*) AS n_documents FROM docs)", "districts scores docs")
def agg_01(t):
    return I.overview(t.districts, t.scores, t.docs)


STATE_SQL = "SELECT state, count(DISTINCT d.nces_id) AS n_districts, {docs} AS n_documents, round(avg(total), 6) AS mean_total, count(*) FILTER (outreach_tier = 'tier1') AS tier1 FROM districts d LEFT JOIN scores s ON s.nces_id = d.nces_id LEFT JOIN {join} x ON x.nces_id = d.nces_id GROUP BY state"


@query("agg_02_state_stats", STATE_SQL.format(docs="coalesce(sum(c), 0)::BIGINT", join="(SELECT nces_id, count(*) AS c FROM docs GROUP BY nces_id)"), "districts scores docs")
def agg_02(t):
    return I.state_stats(t.districts, t.scores, t.docs)


@query("agg_02_state_stats_as_written", STATE_SQL.format(docs="count(x.doc_id)", join="docs"), "districts scores docs")
def agg_02b(t):
    return I.state_stats(t.districts, t.scores, t.docs, "as_written")


@query("agg_03_state_detail", f"SELECT {MEANS}, {TIER_COUNTS}, count(*) AS n FROM districts d JOIN scores s ON s.nces_id = d.nces_id WHERE state = 'S03'", "districts scores")
def agg_03(t):
    s = t.districts.where("state = 'S03'").join(t.scores, "nces_id")
    return s.agg(*[F.round(F.avg(c), 2).alias(f"mean_{c}") for c in I.SCORES], *[F.count(F.when(F.col("outreach_tier") == x, 1)).alias(x) for x in I.TIERS], F.count("*").alias("n"))


@query("agg_04_score_stats", "SELECT count(*) AS n, " + ", ".join(f"round(avg({c}), 6) AS mean_{c}, min({c}) AS min_{c}, max({c}) AS max_{c}" for c in I.SCORES) + " FROM scores", "scores")
def agg_04(t):
    return I.score_stats(t.scores)


@query("agg_05_trending", "SELECT keyword, url_type, count(*) AS n FROM (SELECT url_type, unnest(keywords_found) AS keyword FROM crawl) GROUP BY ALL ORDER BY n DESC, keyword, url_type LIMIT 20", "crawl")
def agg_05(t):
    return I.trending(t.crawl)


@query("agg_06_coverage", "SELECT state, count(*) AS n, count(phone) AS n_phone, count(enrollment) AS n_enrollment, round(100.0e0 * count(phone) / count(*), 1) AS p_phone, round(100.0e0 * count(enrollment) / count(*), 1) AS p_enrollment FROM districts GROUP BY state", "districts")
def agg_06(t):
    return I.coverage(t.districts, "state", ["phone", "enrollment"])


@query("agg_07_registry_rows", "SELECT state, import_batch_id, count(*) AS n, max(imported_at) AS newest FROM registry GROUP BY ALL", "registry")
def agg_07(t):
    return t.registry.groupBy("state", "import_batch_id").agg(F.count("*").alias("n"), F.max("imported_at").alias("newest"))


@query("agg_08_match_stats", "SELECT match_method, count(*) AS n, round(avg(confidence), 6) AS mean_confidence, round(100.0e0 * count(*) / sum(count(*)) OVER (), 1) AS share FROM matches GROUP BY match_method", "matches")
def agg_08(t):
    return M.match_report(t.matches)


@query("agg_10_crawl_totals", "SELECT count(*) AS requests, count(DISTINCT nces_id) AS districts, " + ", ".join(f"count(*) FILTER (status = '{s}') AS {s}" for s in ("success", "failure", "skipped")) + ", count(*) FILTER (extraction_success) AS extracted, round(avg(response_ms), 6) AS mean_ms FROM crawl", "crawl")
def agg_10(t):
    return I.crawl_totals(t.crawl)


@query("agg_11_success_rate", "SELECT url_type, count(*) AS n, count(*) FILTER (status = 'success') AS good, round(100.0e0 * count(*) FILTER (status = 'success') / count(*), 1) AS rate FROM crawl GROUP BY url_type", "crawl")
def agg_11(t):
    return I.success_rates(t.crawl)


@query("agg_12_errors", "SELECT error_message, count(*) AS n FROM crawl WHERE error_message IS NOT NULL GROUP BY 1 ORDER BY n DESC, error_message LIMIT 10", "crawl")
def agg_12(t):
    return I.most_frequent(t.crawl, "error_message")


@query("agg_12_http_codes", "SELECT http_status, count(*) AS n FROM crawl GROUP BY 1 ORDER BY n DESC, http_status LIMIT 10", "crawl")
def agg_12b(t):
    return I.most_frequent(t.crawl, "http_status")


@query("agg_13_keywords", "SELECT value, count(*) AS n FROM (SELECT unnest(keywords_found) AS value FROM crawl) GROUP BY value", "crawl")
def agg_13(t):
    return I.exploded_counts(t.crawl, "keywords_found")


@query("agg_14_corpus", "SELECT count(*) AS n, count(DISTINCT nces_id) AS districts, count(*) FILTER (document_type = 'pdf') AS pdf, count(*) FILTER (document_type = 'html') AS html, sum(text_length)::BIGINT AS characters, round(avg(text_length), 6) AS mean_length FROM docs WHERE nces_id IN (SELECT nces_id FROM crawl WHERE batch_id = 'b1')", "docs crawl")
def agg_14(t):
    return I.corpus_stats(t.docs.join(t.crawl.where("batch_id = 'b1'").select("nces_id"), "nces_id", "left_semi"))


@query("agg_15_category_share", "SELECT document_category, count(*) AS n, round(100.0e0 * count(*) / (SELECT count(*) FROM docs), 2) AS share FROM docs GROUP BY 1", "docs")
def agg_15(t):
    return I.shares(t.docs, "document_category")


@query("agg_16_batches", "SELECT batch_id, min(crawled_at) AS began, max(crawled_at) AS ended, count(DISTINCT nces_id) AS districts, count(*) AS requests FROM crawl GROUP BY 1 ORDER BY began DESC, batch_id LIMIT 5", "crawl")
def agg_16(t):
    return I.batch_summary(t.crawl)


@query("agg_17_hourly", "SELECT date_trunc('hour', crawled_at) AS hour, status, count(*) AS n, count(DISTINCT nces_id) AS districts FROM crawl WHERE crawled_at > TIMESTAMP '2024-01-20 10:00:00' AND crawled_at <= TIMESTAMP '2024-01-20 12:00:00' GROUP BY ALL", "crawl")
def agg_17(t):
    return I.hourly_progress(t.crawl, "2024-01-20 12:00:00")


KIND_SQL = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(m, '{s}')" for s in signs) + f" THEN '{k}'" for k, signs in I.FAILURES) + " ELSE 'other' END"


@query("agg_18_failures", f"SELECT {KIND_SQL} AS category, count(DISTINCT nces_id) AS n FROM (SELECT nces_id, coalesce(error_message, '') AS m FROM crawl WHERE status = 'failure' AND nces_id NOT IN (SELECT nces_id FROM docs WHERE document_type = 'pdf')) GROUP BY 1", "crawl docs")
def agg_18(t):
    return I.failure_categories(t.crawl, t.docs.where("document_type = 'pdf'"))


@query("agg_19_status", "SELECT (SELECT count(*) FROM districts) AS districts, (SELECT count(DISTINCT nces_id) FROM docs) AS with_documents, (SELECT count(*) FROM crawl) AS requests", "districts docs crawl")
def agg_19(t):
    one = lambda df, e: df.agg(e)
    return one(t.districts, F.count("*").alias("districts")).crossJoin(one(t.docs, F.count_distinct("nces_id").alias("with_documents"))).crossJoin(one(t.crawl, F.count("*").alias("requests")))


@query("agg_20_cohort_counts", "SELECT d.nces_id, count(s.id) AS items FROM districts d LEFT JOIN searches s ON s.user_id = d.nces_id GROUP BY d.nces_id", "districts searches")
def agg_20(t):
    return t.districts.select("nces_id").join(t.searches.select("id", F.col("user_id").alias("nces_id")), "nces_id", "left").groupBy("nces_id").agg(F.count("id").alias("items"))


@query("agg_21_telemetry", "SELECT count(*) AS n, round(avg(result_count), 6) AS mean_results, count(DISTINCT regexp_replace(lower(trim(prompt)), '\\s+', ' ', 'g')) AS prompts, count(DISTINCT user_id) AS users FROM searches WHERE generated_at >= TIMESTAMP '2024-02-01 00:00:00' - INTERVAL 20 DAY", "searches")
def agg_21(t):
    return I.telemetry(t.searches, AS_OF, 20)


@query("agg_21_repeated", "SELECT nces_id, count(*) AS n FROM (SELECT unnest(top_ids) AS nces_id FROM searches) GROUP BY 1 ORDER BY n DESC, nces_id LIMIT 20", "searches")
def agg_21b(t):
    return I.repeated_entities(t.searches)


@query("agg_22_momentum", "SELECT state, round(avg(total), 6) AS mean_total FROM districts d LEFT JOIN scores s ON s.nces_id = d.nces_id GROUP BY state ORDER BY mean_total DESC NULLS LAST, state LIMIT 3", "districts scores")
def agg_22(t):
    return I.momentum(t.districts, t.scores)


TIER_SQL = "CASE WHEN trim(website_url) <> '' AND trim(superintendent_name) <> '' AND trim(superintendent_email) <> '' THEN 'A' WHEN trim(website_url) <> '' AND trim(superintendent_name) <> '' THEN 'B' WHEN trim(website_url) <> '' THEN 'C' WHEN trim(superintendent_name) <> '' THEN 'D' ELSE 'E' END"


def _tier():
    return presence_tier(F.col("website_url"), F.col("superintendent_name"), F.col("superintendent_email"))


@query("agg_23_tier_distribution", f"SELECT {TIER_SQL} AS tier, count(*) AS n FROM districts GROUP BY 1", "districts")
def agg_23(t):
    return t.districts.groupBy(_tier().alias("tier")).agg(F.count("*").alias("n"))


@query("agg_24_mail_domains", "SELECT split_part(superintendent_email, '@', 2) AS domain, count(*) AS n FROM districts WHERE superintendent_email IS NOT NULL GROUP BY 1 ORDER BY n DESC, domain LIMIT 15", "districts")
def agg_24(t):
    return I.most_frequent(t.districts.withColumn("domain", F.split_part("superintendent_email", F.lit("@"), F.lit(2))), "domain", 15)


@query("agg_27_missing_by_state", "SELECT state, count(*) AS n FROM districts WHERE superintendent_name IS NULL OR superintendent_name = '' GROUP BY state", "districts")
def agg_27(t):
    return t.districts.where("superintendent_name IS NULL OR superintendent_name = ''").groupBy("state").agg(F.count("*").alias("n"))


@query("agg_29_state_map", "SELECT state, n, round(n * 1.0e0 / max(n) OVER (), 6) AS scaled FROM (SELECT state, count(*) AS n FROM districts GROUP BY state)", "districts")
def agg_29(t):
    from pyspark.sql import Window

    s = t.districts.groupBy("state").agg(F.count("*").alias("n"))
    return s.withColumn("scaled", F.round(F.col("n") / F.max("n").over(Window.partitionBy()), 6))


@query("qual_01_presence_tier", f"SELECT nces_id, {TIER_SQL} AS tier FROM districts", "districts")
def qual_01(t):
    return t.districts.select("nces_id", _tier().alias("tier"))


VIEW_SQL = "v AS (SELECT d.nces_id, d.district_name, superintendent_name, superintendent_email, phone, d.website_url, d.enrollment, r.district_name AS registry_name, r.enrollment AS registry_enrollment, imported_at, confidence, verified FROM districts d LEFT JOIN (SELECT m.* FROM matches m JOIN registry r ON r.id = m.registry_id QUALIFY row_number() OVER (PARTITION BY nces_id ORDER BY confidence DESC, imported_at DESC, registry_id) = 1) m ON m.nces_id = d.nces_id LEFT JOIN registry r ON r.id = m.registry_id)"
FLAGS_SQL = """f AS (
  SELECT nces_id, 'MISSING_SUPT_NAME' AS flag, 'high' AS severity FROM v WHERE coalesce(trim(superintendent_name), '') = ''
  UNION ALL SELECT nces_id, 'MISSING_EMAIL', 'medium' FROM v WHERE coalesce(trim(superintendent_email), '') = '' UNION ALL SELECT nces_id, 'MISSING_PHONE', 'medium' FROM v WHERE coalesce(trim(phone), '') = ''
  UNION ALL SELECT nces_id, 'MISSING_WEBSITE', 'low' FROM v WHERE coalesce(trim(website_url), '') = '' UNION ALL SELECT nces_id, 'NAME_MISMATCH', 'medium' FROM v WHERE lower(registry_name) <> lower(district_name)
  UNION ALL SELECT nces_id, 'ENROLLMENT_MISMATCH', 'low' FROM v WHERE abs(registry_enrollment - enrollment) > 0.2 * enrollment UNION ALL SELECT nces_id, 'STATE_DATA_STALE', 'medium' FROM v WHERE imported_at < TIMESTAMP '2024-02-01 00:00:00' - INTERVAL 6 MONTH)"""


def _view(t):
    m = M.resolve_conflicts(t.matches, t.registry).where("kept").select("nces_id", "registry_id", "confidence", "verified")
    r = t.registry.select(F.col("id").alias("registry_id"), F.col("district_name").alias("registry_name"), F.col("enrollment").alias("registry_enrollment"), "imported_at")
    return t.districts.join(m, "nces_id", "left").join(r, "registry_id", "left")


@query("qual_04_flags", f"WITH {VIEW_SQL}, {FLAGS_SQL} SELECT * FROM f", "districts matches registry")
def qual_04(t):
    return Q.quality_flags(_view(t), AS_OF)


@query("agg_09_flags_by_type", f"WITH {VIEW_SQL}, {FLAGS_SQL} SELECT flag, severity, count(*) AS n FROM f GROUP BY ALL", "districts matches registry")
def agg_09(t):
    return Q.quality_flags(_view(t), AS_OF).groupBy("flag", "severity").agg(F.count("*").alias("n"))


SCORE_SQL = f"""WITH {VIEW_SQL}, {FLAGS_SQL}, g AS (SELECT nces_id, count(*) FILTER (severity = 'high') AS h, count(*) FILTER (severity = 'medium') AS m FROM f GROUP BY 1), p AS (
  SELECT v.nces_id, greatest(0, least(100, 40 + CASE WHEN confidence >= 0.9 THEN 20 WHEN confidence >= 0.8 THEN 15 WHEN confidence >= 0.7 THEN 10 ELSE 0 END + CASE WHEN superintendent_name IS NOT NULL THEN 15 ELSE 0 END + CASE WHEN superintendent_email IS NOT NULL THEN 10 ELSE 0 END
    + CASE WHEN phone IS NOT NULL THEN 5 ELSE 0 END + CASE WHEN website_url IS NOT NULL THEN 5 ELSE 0 END + CASE WHEN verified THEN 10 ELSE 0 END - 10 * coalesce(h, 0) - 5 * coalesce(m, 0)))::INTEGER AS score FROM v LEFT JOIN g ON g.nces_id = v.nces_id)
SELECT *, CASE WHEN score >= 90 THEN 'A' WHEN score >= 75 THEN 'B' WHEN score >= 60 THEN 'C' WHEN score >= 40 THEN 'D' ELSE 'E' END AS tier FROM p"""


@query("qual_02_score", SCORE_SQL, "districts matches registry")
def qual_02(t):
    v = _view(t)
    return Q.quality_score(v, Q.quality_flags(v, AS_OF))


@query("qual_03_trust_tier", f"""WITH {VIEW_SQL} SELECT nces_id, CASE WHEN confidence IS NULL THEN 'D' WHEN confidence >= 0.95 AND trim(superintendent_name) <> '' AND (trim(superintendent_email) <> '' OR trim(phone) <> '') AND trim(website_url) <> '' AND (coalesce(verified, false) OR confidence >= 1) THEN 'A'
WHEN confidence >= 0.85 AND trim(superintendent_name) <> '' AND (trim(phone) <> '' OR trim(website_url) <> '') THEN 'B' WHEN confidence >= 0.7 THEN 'C' ELSE 'E' END AS tier FROM v""", "districts matches registry")
def qual_03(t):
    return Q.trust_tier(_view(t))


@query("qual_06_mail", r"""SELECT nces_id, coalesce(regexp_matches(superintendent_email, '^[^@\s]+@[^@\s]+\.[^@\s]+$'), false) AS valid,
  coalesce(m = s OR ends_with(m, '.' || s), false) AS agrees FROM (SELECT *, CASE WHEN split_part(superintendent_email, '@', 2) <> 'gmail.com' THEN split_part(superintendent_email, '@', 2) END AS m, nullif(regexp_extract(website_url, '^https?://(?:www\.)?([^/]+)', 1), '') AS s FROM districts)""", "districts")
def qual_06(t):
    return Q.mail_agrees(t.districts)


NORMAL_SQL = "trim(regexp_replace(regexp_replace({x}, '[#.,()]', '', 'g'), '\\s+', ' ', 'g'))"


def _normal_sql(column: str, rules: str = "default") -> str:
    x = f"trim(lower({column}))"
    for pattern, replacement in RULES[rules]:
        x = f"regexp_replace({x}, '{pattern}', '{replacement}', 'g')"
    return NORMAL_SQL.format(x=x)


@query("match_01_normalise", f"SELECT id, {_normal_sql('district_name', 'PA')} AS name FROM registry", "registry")
def match_01(t):
    return t.registry.select("id", normalise_name("district_name", "PA").alias("name"))


@query("match_02_normalise_documented", f"SELECT id, {_normal_sql('district_name')} AS name FROM registry", "registry")
def match_02(t):
    return t.registry.select("id", normalise_name("district_name").alias("name"))


JW_SQL = f"""WITH r AS (SELECT id, state, city, {_normal_sql('district_name')} AS name FROM registry), b AS (SELECT nces_id, state, city, {_normal_sql('district_name')} AS name FROM districts),
e AS (SELECT r.id, min(b.nces_id) AS nces_id FROM r JOIN b ON r.state = b.state AND r.name = b.name GROUP BY r.id),
p AS (SELECT r.id, b.nces_id, r.city = b.city AS near, jaro_similarity(r.name, b.name) AS j, CASE WHEN left(r.name, 4) = left(b.name, 4) THEN 4 WHEN left(r.name, 3) = left(b.name, 3) THEN 3 WHEN left(r.name, 2) = left(b.name, 2) THEN 2 WHEN left(r.name, 1) = left(b.name, 1) THEN 1 ELSE 0 END AS pre FROM r JOIN b ON r.state = b.state WHERE r.id NOT IN (SELECT id FROM e)),
s AS (SELECT id, nces_id, near, j + 0.1e0 * pre * (1 - j) AS s FROM p), x AS (SELECT * FROM s WHERE s >= 0.8e0 QUALIFY row_number() OVER (PARTITION BY id ORDER BY round(s, 9) DESC, nces_id) = 1)
"""


@query("match_04_waterfall", JW_SQL + "SELECT id, nces_id, 'exact_name' AS match_method, 0.95e0 AS confidence, false AS review FROM e UNION ALL SELECT id, nces_id, CASE WHEN s >= 0.9e0 THEN 'normalized_name' ELSE 'fuzzy' END, round(s, 6), s < 0.85e0 FROM x", "registry districts")
def match_04(t):
    return M.match_entities(t.registry, t.districts).withColumn("confidence", F.round("confidence", 6))


@query("match_07_documented", JW_SQL + "SELECT id, nces_id, 'exact_name' AS match_method, 0.95e0 AS confidence, false AS review FROM e UNION ALL SELECT id, nces_id, 'fuzzy', round(s * CASE WHEN s >= 0.9e0 OR (s >= 0.85e0 AND near) THEN 0.95e0 ELSE 0.9e0 END, 6), NOT (s >= 0.9e0 OR (s >= 0.85e0 AND near)) FROM x", "registry districts")
def match_07(t):
    return M.match_entities(t.registry, t.districts, policy="documented").withColumn("confidence", F.round("confidence", 6))


@query("match_08_city_type", "SELECT r.id, min(d.nces_id) AS nces_id, 'city_type' AS match_method, 0.75e0 AS confidence, true AS review FROM registry r JOIN districts d ON r.state = d.state AND r.city = d.city AND regexp_extract(lower(r.district_name), '(\\S+)$', 1) = regexp_extract(lower(d.district_name), '(\\S+)$', 1) GROUP BY r.id", "registry districts")
def match_08(t):
    return M.city_type_match(t.registry, t.districts)


@query("match_09_review", "SELECT nces_id, registry_id, confidence < 0.85 AS review FROM matches", "matches")
def match_09(t):
    return t.matches.select("nces_id", "registry_id", (F.col("confidence") < 0.85).alias("review"))


@query("match_10_action", "SELECT nces_id, registry_id, CASE WHEN confidence >= 0.9 THEN 'accept' WHEN confidence >= 0.85 THEN 'accept_log' WHEN confidence >= 0.8 THEN 'accept_review' WHEN confidence >= 0.7 THEN 'hold' ELSE 'reject' END AS action FROM matches", "matches")
def match_10(t):
    return t.matches.select("nces_id", "registry_id", M.action(F.col("confidence")).alias("action"))


@query("match_11_conflicts", "SELECT m.nces_id, registry_id, row_number() OVER (PARTITION BY m.nces_id ORDER BY confidence DESC, imported_at DESC, registry_id) = 1 AS kept, CASE WHEN count(*) OVER (PARTITION BY m.nces_id) > 1 THEN 'DUPLICATE_MATCH' END AS flag FROM matches m JOIN registry r ON r.id = m.registry_id", "matches registry")
def match_11(t):
    return M.resolve_conflicts(t.matches, t.registry).select("nces_id", "registry_id", "kept", "flag")


@query("match_12_ambiguous", "SELECT r.id, count(DISTINCT nces_id) AS n_districts, CASE WHEN count(nces_id) = 0 THEN 'orphan' ELSE 'ambiguous' END AS problem FROM registry r LEFT JOIN (SELECT * FROM matches WHERE match_method <> 'exact_id') m ON m.registry_id = r.id GROUP BY r.id HAVING count(DISTINCT nces_id) <> 1", "matches registry")
def match_12(t):
    return M.ambiguous_or_orphan(t.registry, t.matches.where("match_method <> 'exact_id'"))


@query("match_13_accept", """WITH a AS (SELECT m.* FROM matches m JOIN registry r ON r.id = m.registry_id JOIN districts d ON d.nces_id = m.nces_id WHERE confidence >= 0.8 AND r.state = d.state AND (r.enrollment IS NULL OR d.enrollment IS NULL OR greatest(r.enrollment, d.enrollment) <= 10 * least(r.enrollment, d.enrollment))),
b AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY nces_id ORDER BY confidence DESC, registry_id, nces_id) = 1) SELECT nces_id, registry_id, match_method, confidence FROM b QUALIFY row_number() OVER (PARTITION BY registry_id ORDER BY confidence DESC, registry_id, nces_id) = 1""", "matches registry districts")
def match_13(t):
    return M.accept(t.matches, t.registry, t.districts)


@query("match_14_review_queue", "SELECT registry_id, nces_id, confidence FROM matches WHERE confidence < 0.85 ORDER BY confidence, registry_id, nces_id LIMIT 50", "matches")
def match_14(t):
    return t.matches.where("confidence < 0.85").orderBy("confidence", "registry_id", "nces_id").limit(50).select("registry_id", "nces_id", "confidence")


@query("match_16_person_names", "SELECT nces_id, split_part(n, ' ', 1) AS first_name, substr(n, strpos(n, ' ') + 1) AS last_name FROM (SELECT nces_id, regexp_replace(superintendent_name, '^Dr\\. ', '') AS n FROM districts WHERE superintendent_name <> '')", "districts")
def match_16(t):
    first, last = split_person("superintendent_name")
    return t.districts.where("superintendent_name <> ''").select("nces_id", first.alias("first_name"), last.alias("last_name"))
