"""Pages, URLs, chunks, taxonomy, vectors, ranking, files, streams."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import texts as X
from ..functions import urls as U
from ..operators import basics as B
from ..operators import documents as D
from ..operators import insights as I
from ..operators import search as S
from ..operators import taxonomy as T
from ..sources import files
from ..streaming import jobs
from .bind import AS_OF
from .registry import query


def _folder(t, what: str) -> str:
    """A new folder in the place that the session shares with its executors."""
    at = t.spark.conf.get("spark.checkpoint.dir", None)
    if not at and not t.spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir names no folder that the driver and all executors share")
    at = at or t.spark.conf.get("spark.sql.warehouse.dir")
    return f"{at.rstrip('/')}/{what}-{uuid.uuid4().hex}"


TEXT_SQL = r"""trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<script[^>]*>.*?</script>', '', 'gis'), '<style[^>]*>.*?</style>', '', 'gis'), '<!--.*?-->', '', 'gs'), '<[^>]+>', ' ', 'g'), '&nbsp;', ' '), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '\s+', ' ', 'g'))"""


@query("doc_01_page_text", f"SELECT page_id, sha256({TEXT_SQL}) AS text_hash, length({TEXT_SQL})::INTEGER AS n FROM pages")
def doc_01(t):
    text = X.page_text(F.col("html"))
    return t.pages.select("page_id", F.sha2(text, 256).alias("text_hash"), F.length(text).alias("n"))


@query("doc_02_title", "SELECT page_id, nullif(trim(regexp_extract(html, '<title[^>]*>([^<]+)</title>', 1, 'is')), '') AS title FROM pages")
def doc_02(t):
    return t.pages.select("page_id", X.page_title(F.col("html")).alias("title"))


LINK_SQL = r"""WITH h AS (SELECT page_id, url, trim(unnest(regexp_extract_all(html, 'href\s*=\s*["'']([^"'']*)["'']', 1, 'i'))) AS raw FROM pages),
g AS (SELECT *, regexp_extract(url, '^(https?://[^/?#]+)', 1, 'i') AS root, regexp_extract(url, '^(https?://[^?#]*/)', 1, 'i') AS f FROM h WHERE NOT regexp_matches(raw, '^(#|javascript:|mailto:|tel:)|^$', 'i')),
l AS (SELECT DISTINCT page_id, url, CASE WHEN regexp_matches(raw, '^https?://', 'i') THEN raw WHEN starts_with(raw, '//') THEN regexp_extract(url, '^(https?:)', 1, 'i') || raw WHEN starts_with(raw, '/') THEN root || raw ELSE CASE WHEN length(f) > length(root) THEN f ELSE root || '/' END || raw END AS link FROM g),
k AS (SELECT page_id, link, CASE WHEN regexp_matches(lower(link), '\.pdf($|[?#])') THEN 'pdf' WHEN a = b OR ends_with(a, '.' || b) THEN 'internal' ELSE 'external' END AS kind FROM (SELECT *, lower(regexp_extract(link, '^https?://(?:[^/@?#]*@)?([^/:?#]+)', 1, 'i')) AS a, lower(regexp_extract(url, '^https?://(?:[^/@?#]*@)?([^/:?#]+)', 1, 'i')) AS b FROM l))
"""
PRIORITY_SQL = "(" + " + ".join(f"contains(lower({{0}}), '{w}')::INTEGER" for w in U.PRIORITY_WORDS) + " + (length({0}) - length(replace({0}, '/', '')) - 2 <= 2)::INTEGER)"


@query("doc_03_links", LINK_SQL + "SELECT * FROM k")
def doc_03(t):
    return D.page_links(t.pages)


@query("doc_04_priority", LINK_SQL + f"SELECT page_id, link, {PRIORITY_SQL.format('link')} AS priority FROM k")
def doc_04(t):
    return D.page_links(t.pages).select("page_id", "link", U.link_priority(F.col("link")).alias("priority"))


@query("doc_05_frontier", LINK_SQL + f", p AS (SELECT *, {PRIORITY_SQL.format('link')} AS priority FROM k WHERE kind <> 'external') SELECT *, row_number() OVER (PARTITION BY page_id, kind ORDER BY priority DESC, link)::INTEGER AS place FROM p QUALIFY place <= 10")
def doc_05(t):
    return D.frontier(D.page_links(t.pages))


#: Frequent tokens of the given texts stand for the discovery patterns, which these texts don't hold.
TOKENS = [r"tion\s+the", r"of\s+(a\s+)?th", r"que\s+le", r"der\s+die", r"ing\s+is"]
FOUND_SQL = "list_distinct(list_filter([" + ", ".join(f"regexp_extract(lower(extracted_text), '{p}')" for p in TOKENS) + "], lambda x: x <> ''))"


@query("doc_06_keywords", f"SELECT doc_id, array_to_string(list_sort({FOUND_SQL}), '|') AS found FROM docs", "docs")
def doc_06(t):
    return t.docs.select("doc_id", F.array_join(F.array_sort(X.keywords(F.col("extracted_text"), TOKENS)), "|").alias("found"))


@query("doc_07_category", "SELECT doc_id, CASE WHEN contains(u, 'portrait') OR contains(u, 'graduate') THEN 'portrait_of_graduate' WHEN contains(u, 'strategic') OR contains(u, 'plan') THEN 'strategic_plan' ELSE 'other' END AS category FROM (SELECT doc_id, lower(document_url) AS u FROM docs)", "docs")
def doc_07(t):
    return t.docs.select("doc_id", X.category(F.col("document_url"), X.keywords(F.col("extracted_text"))).alias("category"))


@query("doc_09_hash", "SELECT doc_id, length(text)::INTEGER AS full_length, sha256(text) AS content_hash, length(substr(text, 1, 500))::INTEGER AS kept FROM documents")
def doc_09(t):
    return D.with_hash(t.documents.select("doc_id", "text"), 500).select("doc_id", "full_length", "content_hash", F.length("text").alias("kept"))


@query("doc_11_file_title", "SELECT doc_id, replace(replace(replace(regexp_extract(document_url, '[^/]*$'), '.pdf', ''), '-', ' '), '_', ' ') AS title FROM docs WHERE document_type = 'pdf'", "docs")
def doc_11(t):
    name = F.replace(F.substring_index("document_url", "/", -1), F.lit(".pdf"), F.lit(""))
    return t.docs.where("document_type = 'pdf'").select("doc_id", F.translate(name, "-_", "  ").alias("title"))


DEDUPE_SQL = "SELECT * FROM docs WHERE content_hash IS NULL UNION ALL SELECT * FROM (SELECT * FROM docs WHERE content_hash IS NOT NULL QUALIFY row_number() OVER (PARTITION BY content_hash ORDER BY CASE document_category WHEN 'portrait_of_graduate' THEN 1 WHEN 'strategic_plan' THEN 2 ELSE 3 END, text_length, doc_id) = 1)"


@query("doc_12_dedupe", f"SELECT doc_id, content_hash FROM ({DEDUPE_SQL})", "docs")
def doc_12(t):
    return D.dedupe_exact(t.docs, D.priority_order()).select("doc_id", "content_hash")


@query("topk_05_priority", "SELECT doc_id, document_category, text_length FROM docs ORDER BY CASE document_category WHEN 'portrait_of_graduate' THEN 1 WHEN 'strategic_plan' THEN 2 ELSE 3 END, text_length, doc_id LIMIT 100", "docs")
def topk_05(t):
    return t.docs.orderBy(*D.priority_order()).limit(100).select("doc_id", "document_category", "text_length")


@query("src_07_table_rows", "WITH r AS (SELECT page_id, unnest(regexp_extract_all(html, '<li[^>]*>(.*?)</li>', 1, 'is')) AS x FROM pages) SELECT page_id, trim(regexp_replace(regexp_extract(x, '<a[^>]*>(.*?)</a>', 1, 'is'), '<[^>]+>', '', 'g')) AS cell FROM r WHERE regexp_matches(x, '<a[^>]*>.*?</a>', 'is')")
def src_07(t):
    return D.table_rows(t.pages).select("page_id", F.col("cells")[0].alias("cell"))


@query("src_08_entities", "SELECT page_id, nullif(regexp_extract(html, '<html[^>]*lang=\"([^\"]*)\"', 1, 'i'), '') AS lang, nullif(regexp_extract(url, '^https?://([^/?#]+)', 1), '') AS site FROM pages")
def src_08(t):
    return t.pages.select("page_id", F.nullif(F.regexp_extract("html", r'(?i)<html[^>]*lang="([^"]*)"', 1), F.lit("")).alias("lang"), F.nullif(F.regexp_extract("url", r"^https?://([^/?#]+)", 1), F.lit("")).alias("site"))


@query("url_01_normalise", "SELECT nces_id, CASE WHEN contains(website_url, '.') THEN website_url END AS url FROM districts", "districts")
def url_01(t):
    return t.districts.select("nces_id", U.normalise_url(F.col("website_url")).alias("url"))


@query("url_02_domain", "SELECT page_id, regexp_replace(lower(regexp_extract(url, '^https?://([^/:?#]+)', 1)), '^www\\.', '') AS domain FROM pages")
def url_02(t):
    return t.pages.select("page_id", U.domain(F.col("url")).alias("domain"))


@query("url_03_other_source", "SELECT DISTINCT c.nces_id FROM crawl c JOIN districts d ON d.nces_id = c.nces_id WHERE regexp_extract(c.url, '^https?://(?:www\\.)?([^/]+)', 1) <> replace(regexp_extract(nullif(d.website_url, ''), '^https?://(?:www\\.)?([^/]+)', 1), 'd1', 'e1')", "crawl districts")
def url_03(t):
    d = t.districts.select("nces_id", F.replace(U.domain(F.col("website_url")), F.lit("d1"), F.lit("e1")).alias("known"))
    return t.crawl.join(d, "nces_id").where(U.domain(F.col("url")) != F.col("known")).select("nces_id").distinct()


@query("url_04_retryable", "SELECT nces_id, event_id, url FROM crawl WHERE status = 'failure' AND (error_message ILIKE '%timeout%' OR error_message ILIKE '%ssl%' OR contains(error_message, '429') OR error_message ILIKE '%reset%' OR contains(error_message, '403')) QUALIFY row_number() OVER (PARTITION BY nces_id ORDER BY crawled_at DESC, event_id DESC) = 1", "crawl")
def url_04(t):
    soft = t.crawl.where("status = 'failure'").where(F.col("error_message").rlike("(?i)timeout|ssl|429|reset|403"))
    return B.latest_per_key(soft, ["nces_id"], [F.desc("crawled_at"), F.desc("event_id")]).select("nces_id", "event_id", "url")


@query("url_05_mail_sites", "SELECT nces_id, CASE WHEN contains(superintendent_email, 'mail.d') THEN 'https://d' || k || '.example.org|https://www.d' || k || '.example.org|https://mail.d' || k || '.example.org|https://www.mail.d' || k || '.example.org' ELSE '' END AS sites FROM districts", "districts")
def url_05(t):
    return t.districts.select("nces_id", F.array_join(U.mail_sites(F.col("superintendent_email")), "|").alias("sites"))


@query("url_06_repairs", "SELECT nces_id, 'https://d' || k || '.org|https://d' || k || '.com|https://www.d' || k || '.org|https://www.d' || k || '.com' AS fixes FROM districts", "districts")
def url_06(t):
    return t.districts.select("nces_id", F.array_join(U.repairs(F.concat(F.lit("d"), F.col("k").cast("string"))), "|").alias("fixes"))


@query("url_07_variants", "SELECT nces_id, s || w || 'd' || k || '.example.org' AS url FROM districts, (SELECT unnest(['https://', 'http://']) AS s), (SELECT unnest(['', 'www.']) AS w) WHERE website_url <> ''", "districts")
def url_07(t):
    return t.districts.where("website_url <> ''").select("nces_id", F.explode(U.variants(F.col("website_url"))).alias("url"))


@query("url_08_candidates", "SELECT nces_id, 'https://www.' || replace(split_part(district_name, ' ', 1), '&', '') || e || lower(state) || '.us' AS url FROM districts, (SELECT unnest(['schools.k12.', 'sd.k12.', 'isd.k12.', '.k12.']) AS e)", "districts")
def url_08(t):
    stem = F.regexp_replace(F.split_part("district_name", F.lit(" "), F.lit(1)), "&", "")
    ends = F.array(*[F.lit(e) for e in ("schools.k12.", "sd.k12.", "isd.k12.", ".k12.")])
    return t.districts.select("nces_id", F.explode(F.transform(ends, lambda e: F.concat(F.lit("https://www."), stem, e, F.lower("state"), F.lit(".us")))).alias("url"))


@query("url_09_no_url", "SELECT d.nces_id FROM districts d LEFT JOIN registry r ON r.state_district_id = d.nces_id WHERE coalesce(d.website_url, '') = '' AND r.website_url IS NULL AND NOT EXISTS (SELECT 1 FROM docs x WHERE x.nces_id = d.nces_id)", "districts registry docs")
def url_09(t):
    r = t.registry.select(F.col("state_district_id").alias("nces_id"), F.col("website_url").alias("r"))
    d = t.districts.join(r, "nces_id", "left").where((F.coalesce("website_url", F.lit("")) == "") & F.col("r").isNull())
    return d.join(t.docs.select("nces_id"), "nces_id", "left_anti").select("nces_id")


@query("chk_01_sentences")
def chk_01(t):
    return D.chunk_sentences(t.documents)


@query("chk_02_recursive")
def chk_02(t):
    return D.chunk_recursive(t.documents)


@query("chk_03_header", "SELECT doc_id, 'District: ' || nces_id || ' | Category: ' || coalesce(document_category, 'other') || ' | Title: ' || coalesce(title, '') AS header FROM docs", "docs")
def chk_03(t):
    return t.docs.select("doc_id", F.format_string("District: %s | Category: %s | Title: %s", "nces_id", F.coalesce("document_category", F.lit("other")), F.coalesce("title", F.lit(""))).alias("header"))


@query("chk_04_pending", f"SELECT doc_id, document_category, text_length, doc_id // 150 AS batch FROM ({DEDUPE_SQL.replace('FROM docs', 'FROM todo')})".replace("SELECT doc_id", "WITH todo AS (SELECT * FROM docs d WHERE extracted_text IS NOT NULL AND text_length > 100 AND NOT EXISTS (SELECT 1 FROM vectors v WHERE v.doc_id = d.doc_id)) SELECT doc_id", 1), "docs vectors")
def chk_04(t):
    return D.pending(t.docs, t.vectors)


#: A taxonomy of frequent tokens; a real one is given in the same form.
TAXONOMY = [("readiness", "tion_the", r"tion\s+the", 1.0, True), ("readiness", "of_th", r"of\s+(a\s+)?th", 0.9, False), ("alignment", "que_le", r"que\s+le", 0.8, False), ("activation", "der_die", r"der\s+die", 0.9, True), ("branding", "ing_is", r"ing\s+is", 0.6, False)]
MATCH_SQL = "m AS (SELECT doc_id, nces_id, discovered_at, category, keyword, exact, len(regexp_extract_all(t, p))::INTEGER AS count, w AS weight, w * rec * spec AS adjusted FROM (SELECT *, lower(extracted_text) AS t, CASE WHEN crawled_at IS NULL THEN 0.8e0 WHEN epoch(TIMESTAMP '2024-02-01' - crawled_at) / 86400 <= 180 THEN 1.0e0 WHEN epoch(TIMESTAMP '2024-02-01' - crawled_at) / 86400 <= 360 THEN 0.8e0 ELSE 0.6e0 END AS rec, CASE WHEN regexp_matches(lower(document_url), '/plan|/strategic|/framework|/portrait|/vision|/graduate') OR document_category IN ('portrait_of_graduate', 'strategic_plan') THEN 1.0e0 WHEN regexp_matches(lower(document_url), 'news|article|press|blog') THEN 0.5e0 ELSE 0.8e0 END AS spec FROM docs), (VALUES " + ", ".join(f"('{c}', '{n}', '{p}', {w}e0, {e})" for c, n, p, w, e in TAXONOMY) + ") x(category, keyword, p, w, exact) WHERE regexp_matches(t, p))"


def _matches(t):
    return T.match_taxonomy(t.docs, TAXONOMY, AS_OF)


@query("score_04_matches", f"WITH {MATCH_SQL} SELECT doc_id, category, keyword, count, weight, round(adjusted, 6) AS adjusted FROM m", "docs")
def score_04(t):
    return _matches(t).select("doc_id", "category", "keyword", "count", "weight", F.round("adjusted", 6).alias("adjusted"))


@query("score_05_context")
def score_05(t):
    return _matches(t).select("doc_id", "keyword", "context")


ENTITY_SQL = f"""WITH {MATCH_SQL}, o AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY nces_id, category, keyword ORDER BY discovered_at, doc_id) = 1), c AS (SELECT nces_id, """ + ", ".join(f"least(10, 2 * coalesce(sum(adjusted + CASE WHEN exact THEN 0.2e0 ELSE 0 END) FILTER (category = '{x}'), 0)) AS {x}" for x in T.CATEGORIES) + """ FROM o GROUP BY 1),
d AS (SELECT nces_id, count(*)::INTEGER AS documents_analyzed FROM docs WHERE extracted_text IS NOT NULL GROUP BY 1), j AS (SELECT d.nces_id, documents_analyzed, """ + ", ".join(f"coalesce({x}, 0) AS {x}" for x in T.CATEGORIES) + """ FROM d LEFT JOIN c ON c.nces_id = d.nces_id), s AS (SELECT *, (readiness + alignment + activation + branding) / 4 AS total FROM j), f AS (SELECT *, CASE WHEN total >= 5 OR readiness >= 3 OR activation >= 2 THEN 'tier1' WHEN total >= 2 OR readiness >= 1.5 THEN 'tier2' ELSE 'tier3' END AS outreach_tier FROM s) """


@query("score_08_entities", ENTITY_SQL + "SELECT nces_id, " + ", ".join(f"round({c}, 4) AS {c}" for c in (*T.CATEGORIES, "total")) + ", outreach_tier, documents_analyzed FROM f", "docs")
def score_08(t):
    return T.score_entities(_matches(t), t.docs)


@query("agg_25_score_run", ENTITY_SQL + "SELECT count(*) AS n, count(*) FILTER (total > 0) AS with_keywords, count(*) FILTER (outreach_tier = 'tier1') AS tier1, round(avg(documents_analyzed), 4) AS mean_documents FROM f", "docs")
def agg_25(t):
    return T.score_entities(_matches(t), t.docs).agg(F.count("*").alias("n"), F.count(F.when(F.col("total") > 0, 1)).alias("with_keywords"), F.count(F.when(F.col("outreach_tier") == "tier1", 1)).alias("tier1"), F.round(F.avg("documents_analyzed"), 4).alias("mean_documents"))


@query("score_09_evidence", f"WITH {MATCH_SQL}, k AS (SELECT nces_id, category, keyword, sum(count) AS mentions, max(adjusted) AS w FROM m GROUP BY ALL), d AS (SELECT nces_id, category, count(DISTINCT doc_id) AS documents FROM m GROUP BY ALL) SELECT k.nces_id, k.category, count(*) AS keywords, sum(mentions)::BIGINT AS mentions, documents, string_agg(keyword, ',' ORDER BY w DESC, keyword) AS keyword_list FROM k JOIN d ON d.nces_id = k.nces_id AND d.category = k.category GROUP BY ALL", "docs")
def score_09(t):
    return T.evidence(_matches(t))


@query("score_10_update", "SELECT s.nces_id, coalesce(CASE WHEN k % 4 = 0 THEN 9.5e0 END, readiness) AS readiness, alignment FROM scores s JOIN districts d ON d.nces_id = s.nces_id", "scores districts")
def score_10(t):
    updates = t.districts.select("nces_id", F.when(F.col("k") % 4 == 0, 9.5).alias("readiness"))
    return T.update_scores(t.scores.select("nces_id", "readiness", "alignment"), updates, ["readiness"])


def hundredth(vectors):
    """The query vectors of searches for many: every row whose id is divisible by 100."""
    return vectors.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))


COS = "1 - list_dot_product(list_transform({a}, lambda x: x::DOUBLE), list_transform({b}, lambda x: x::DOUBLE)) / (sqrt(list_dot_product(list_transform({a}, lambda x: x::DOUBLE), list_transform({a}, lambda x: x::DOUBLE))) * sqrt(list_dot_product(list_transform({b}, lambda x: x::DOUBLE), list_transform({b}, lambda x: x::DOUBLE))))"
NEAR = "d AS (SELECT v.*, " + COS.format(a="v.embedding", b="q.embedding") + " AS distance FROM vectors v, (SELECT embedding FROM vectors WHERE vec_id = 0) q)"


@query("vec_01_search", f"WITH {NEAR} SELECT vec_id, round(distance, 6) AS distance, round(1 - distance / 2, 6) AS relevance FROM d WHERE distance < 0.8 AND vec_id <> 0 ORDER BY d.distance, vec_id LIMIT 20", "vectors")
def vec_01(t):
    return S.vector_search(t.vectors.where("vec_id <> 0"), S.query_vector(t.vectors, 0), 0.8).select("vec_id", F.round("distance", 6).alias("distance"), F.round("relevance", 6).alias("relevance"))


@query("vec_02_search_baseline", f"WITH {NEAR} SELECT vec_id, x.nces_id, round(distance, 6) AS distance FROM d JOIN districts x ON x.nces_id = d.nces_id WHERE distance < 0.9 AND vec_id <> 0 ORDER BY d.distance, vec_id LIMIT 20", "vectors districts")
def vec_02(t):
    v = t.vectors.where("vec_id <> 0").join(t.districts.select("nces_id"), "nces_id", "left_semi")
    return S.vector_search(v, S.query_vector(t.vectors, 0), 0.9).select("vec_id", "nces_id", F.round("distance", 6).alias("distance"))


@query("vec_03_similar", "WITH q AS (SELECT embedding FROM vectors WHERE doc_id = 5 ORDER BY chunk_index, vec_id LIMIT 1), d AS (SELECT doc_id, " + COS.format(a="v.embedding", b="q.embedding") + " AS distance FROM vectors v, q WHERE doc_id <> 5) SELECT doc_id, round(min(distance), 6) AS distance FROM d WHERE distance < 0.85 GROUP BY doc_id ORDER BY min(d.distance), doc_id LIMIT 20", "vectors")
def vec_03(t):
    return S.similar_documents(t.vectors, 5, 0.85).withColumn("distance", F.round("distance", 6))


@query("vec_04_related", f"WITH {NEAR} SELECT vec_id, round(distance, 6) AS distance FROM d WHERE vec_id <> 0 ORDER BY d.distance, vec_id LIMIT 10", "vectors")
def vec_04(t):
    return S.vector_search(t.vectors.where("vec_id <> 0"), S.query_vector(t.vectors, 0), None, 10).select("vec_id", F.round("distance", 6).alias("distance"))


@query("vec_05_search_documents", f"WITH {NEAR} SELECT x.doc_id, x.title, chunk_index, round(1 - distance, 6) AS similarity FROM d JOIN docs x ON x.doc_id = d.doc_id ORDER BY d.distance, vec_id LIMIT 15", "vectors docs")
def vec_05(t):
    d = S.with_distance(t.vectors, S.query_vector(t.vectors, 0)).join(t.docs.select("doc_id", "title"), "doc_id").orderBy("distance", "vec_id").limit(15)
    return d.select("doc_id", "title", "chunk_index", F.round(1 - F.col("distance"), 6).alias("similarity"))


REL = NEAR + ", n AS (SELECT nces_id, 1 - distance AS s FROM d WHERE 1 - distance > 0.1 ORDER BY d.distance, vec_id LIMIT 500), r AS (SELECT nces_id, max(s) AS top, avg(s) AS mean, count(*) AS hits FROM n GROUP BY 1)"


@query("vec_06_relevance", f"WITH {REL} SELECT nces_id, round(top, 6) AS top, round(mean, 6) AS mean, hits FROM r", "vectors")
def vec_06(t):
    return S.entity_relevance(t.vectors, S.query_vector(t.vectors, 0), floor=0.1).select("nces_id", F.round("top", 6).alias("top"), F.round("mean", 6).alias("mean"), "hits")


@query("agg_26_hits", f"WITH {REL} SELECT nces_id, hits FROM r ORDER BY hits DESC, nces_id LIMIT 10", "vectors")
def agg_26(t):
    return S.entity_relevance(t.vectors, S.query_vector(t.vectors, 0), floor=0.1).orderBy(F.desc("hits"), "nces_id").limit(10).select("nces_id", "hits")


@query("vec_08_many", "WITH q AS (SELECT vec_id AS query_id, embedding AS q FROM vectors WHERE vec_id % 100 = 0), d AS (SELECT query_id, vec_id, " + COS.format(a="v.embedding", b="q.q") + " AS distance FROM vectors v, q WHERE vec_id <> query_id) SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id)::INTEGER AS place, vec_id, round(distance, 6) AS distance FROM d QUALIFY place <= 10", "vectors")
def vec_08(t):
    return S.search_many(t.vectors, hundredth(t.vectors)).withColumn("distance", F.round("distance", 6))


@query("vec_08_hundredth")
def vec_08_hundredth(t):
    return S.search_many(t.vectors, hundredth(t.vectors)).withColumn("distance", F.round("distance", 6))


RANK = REL + ", c AS (SELECT r.*, greatest(0, 6 * top + 2 * mean + least(1.5, log10(hits + 1)) + 0.5 * coalesce(total, 0)) AS composite FROM r LEFT JOIN scores s ON s.nces_id = r.nces_id), k AS (SELECT *, greatest(0.2e0, least(0.98e0, (composite + 2 * mean) / 12)) AS confidence FROM c)"
RANK_SQL = f"WITH {RANK} SELECT nces_id, hits, round(composite, 6) AS composite, round(confidence, 6) AS confidence, CASE WHEN confidence >= 0.8 THEN 'high' WHEN confidence >= 0.6 THEN 'medium' ELSE 'low' END AS band FROM k WHERE confidence >= 0.2 ORDER BY k.composite DESC, nces_id LIMIT 25"


@query("rank_05_candidates", RANK_SQL, "vectors scores")
def rank_05(t):
    r = S.rank_candidates(S.entity_relevance(t.vectors, S.query_vector(t.vectors, 0), floor=0.1), t.scores, threshold=0.2)
    return r.select("nces_id", "hits", F.round("composite", 6).alias("composite"), F.round("confidence", 6).alias("confidence"), "band")


@query("rank_01_intent", "SELECT id, CASE WHEN regexp_matches(p, 'trend|brief|insight|state overview') THEN 'insights_briefing' WHEN regexp_matches(p, 'grant|frpl|minority') THEN 'grant_match' WHEN regexp_matches(p, 'next hottest|uncontacted|lead') THEN 'next_hottest_uncontacted' ELSE 'district_search' END AS intent FROM (SELECT id, lower(prompt) AS p FROM searches)", "searches")
def rank_01(t):
    return t.searches.select("id", S.classify_intent(F.col("prompt")).alias("intent"))


@query("rank_02_criteria", r"SELECT id, least(100, nullif(regexp_extract(lower(prompt), 'frpl[^\d]{0,20}(\d{1,3})', 1), '')::INTEGER) AS frpl_min FROM searches WHERE contains(lower(prompt), 'frpl')", "searches")
def rank_02(t):
    return t.searches.where(F.lower("prompt").contains("frpl")).select("id", S.grant_criteria(F.col("prompt"))["frpl_min"].alias("frpl_min"))


@query("rank_03_suppression", "SELECT nces_id FROM districts WHERE nces_id NOT IN (SELECT nces_id FROM crawl WHERE crawled_at >= TIMESTAMP '2024-02-01' - INTERVAL 5 DAY AND url_type = 'purchase')", "districts crawl")
def rank_03(t):
    events = t.crawl.where("url_type = 'purchase'").select("nces_id", F.col("crawled_at").alias("happened_at"))
    return S.suppress(t.districts.select("nces_id"), events, AS_OF, 5)


@query("rank_04_funnel", 'SELECT count(*) AS "all", count(*) FILTER (state < \'S15\') AS in_states, count(*) FILTER (state < \'S15\' AND enrollment >= 2000) AS large, count(*) FILTER (state < \'S15\' AND enrollment >= 2000 AND frpl_percent >= 40) AS in_need FROM districts', "districts")
def rank_04(t):
    return S.funnel(t.districts, {"in_states": F.col("state") < "S15", "large": F.col("enrollment") >= 2000, "in_need": F.col("frpl_percent") >= 40})


@query("rank_10_why", "SELECT d.nces_id, CASE WHEN total IS NULL THEN 0.2e0 ELSE greatest(0.2e0, least(0.95e0, total / 10)) END AS confidence FROM districts d LEFT JOIN scores s ON s.nces_id = d.nces_id", "districts scores")
def rank_10(t):
    return t.districts.select("nces_id").join(t.scores.select("nces_id", "total"), "nces_id", "left").select("nces_id", F.when(F.col("total").isNull(), 0.2).otherwise(F.greatest(F.lit(0.2), F.least(F.lit(0.95), F.col("total") / 10))).alias("confidence"))


@query("rank_11_briefing", "SELECT 'Highest momentum: ' || string_agg(state, ', ' ORDER BY m DESC, state) AS briefing FROM (SELECT state, round(avg(total), 6) AS m FROM districts d LEFT JOIN scores s ON s.nces_id = d.nces_id GROUP BY state ORDER BY m DESC NULLS LAST, state LIMIT 3)", "districts scores")
def rank_11(t):
    top = I.momentum(t.districts, t.scores)  # three rows
    row = F.array_sort(F.collect_list(F.struct((-F.col("mean_total")).alias("m"), "state")))
    return top.agg(F.concat(F.lit("Highest momentum: "), F.array_join(F.transform(row, lambda x: x["state"]), ", ")).alias("briefing"))


@query("rank_12_search_log", "SELECT user_id, trim(max(prompt)) AS prompt, count(*) AS n FROM searches GROUP BY user_id", "searches")
def rank_12(t):
    return t.searches.groupBy("user_id").agg(F.trim(F.max("prompt")).alias("prompt"), F.count("*").alias("n"))


CSV_COLUMNS = ["id", "state", "state_district_id", "district_name", "email", "phone_raw", "status"]


def _csv(t):
    path = _folder(t, "registry-csv")
    rows = t.registry.select("id", "state", "state_district_id", F.concat(F.lit(' "A", '), "district_name", F.lit(" ")).alias("district_name"), F.coalesce("email", F.lit("N/A")).alias("email"), F.concat(F.lit("555-"), F.lpad(F.col("id").cast("string"), 4, "0")).alias("phone_raw"), F.when(F.col("id") % 7 == 0, "Closed").otherwise("Open").alias("status"))
    files.export_csv(rows, path, quote_all=True)
    return files.read_registry(t.spark, path, CSV_COLUMNS, {"id": "cast(id AS long)", "state": "state", "state_district_id": "state_district_id", "district_name": "district_name", "email": "lower(email)", "phone": files.clean_phone(F.col("phone_raw"), "304")}, F.col("status") == "Open")[0]


@query("src_02_csv_registry", "SELECT id, state, state_district_id, '\"A\", ' || district_name AS district_name, lower(nullif(email, '')) AS email, '(304) 555-' || lpad(id::VARCHAR, 4, '0') AS phone FROM registry WHERE id % 7 <> 0", "registry")
def src_02(t):
    return _csv(t)


@query("src_06_first_by_key", "SELECT city, id FROM registry QUALIFY row_number() OVER (PARTITION BY city ORDER BY id) = 1", "registry")
def src_06(t):
    return files.first_by_key(t.registry, "city", [F.col("id")]).select("city", "id")


@query("src_10_corpus_scan", "SELECT DISTINCT nces_id FROM docs WHERE nces_id IN (SELECT nces_id FROM crawl WHERE batch_id = 'b2')", "docs crawl")
def src_10(t):
    return t.docs.select("nces_id").distinct().join(t.crawl.where("batch_id = 'b2'").select("nces_id"), "nces_id", "left_semi")


@query("src_11_source_id", "SELECT id, coalesce(nullif(regexp_extract(district_name, '(\\d+)', 1), ''), state || '-' || substr(sha256(lower(district_name)), 1, 12)) AS source_id FROM registry", "registry")
def src_11(t):
    return t.registry.select("id", files.source_id(F.col("district_name"), F.lit(""), F.col("state")).alias("source_id"))


@query("src_13_lookup", "SELECT id, n_name FROM registry JOIN nation ON state = 'S' || lpad(n_nationkey::VARCHAR, 2, '0')", "registry")
def src_13(t):
    n = t.nation.select(F.concat(F.lit("S"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0")).alias("state"), "n_name")
    return t.registry.join(n, "state").select("id", "n_name")


@query("snk_01_append", "SELECT id, 'new' AS import_batch_id FROM registry WHERE state <> 'S01'", "registry")
def snk_01(t):
    path = _folder(t, "registry")
    rows = files.with_raw(t.registry.drop("import_batch_id"), "new").where("state <> 'S01'")
    rows.write.mode("append").partitionBy("state").parquet(path)
    return t.spark.read.schema(rows.schema).parquet(path).select("id", "import_batch_id")


@query("snk_02_load_guard", "SELECT id FROM registry WHERE state NOT IN (SELECT state FROM registry WHERE import_batch_id = 'batch0' AND id < 200)", "registry")
def snk_02(t):
    return files.not_loaded(t.registry, t.registry.where("import_batch_id = 'batch0' AND id < 200")).select("id")


@query("snk_03_audit")
def snk_03(t):
    return files.import_audit(t.registry.where("import_batch_id = 'batch1'"), t.registry.where("import_batch_id <> 'batch1'"))


@query("snk_04_upsert", "SELECT coalesce(n.k, o.k) AS k, CASE WHEN o.k IS NOT NULL THEN o.title ELSE n.title END AS title, coalesce(n.text_length, o.text_length) AS text_length FROM (SELECT doc_id AS k, title, text_length FROM docs WHERE doc_id % 3 <> 0) o FULL JOIN (SELECT doc_id AS k, 'new' AS title, 7 AS text_length FROM docs WHERE doc_id % 2 = 0) n ON n.k = o.k", "docs")
def snk_04(t):
    d = t.docs.select(F.col("doc_id").alias("k"), "title", F.col("text_length").cast("long").alias("text_length"))
    new = d.where("k % 2 = 0").select("k", F.lit("new").alias("title"), F.lit(7).cast("long").alias("text_length"))
    return files.upsert_latest(d.where("k % 3 <> 0"), new, ["k"], ["title"])


@query("snk_06_correction", "SELECT event_id, coalesce(CASE WHEN event_id % 5 = 0 THEN true END, extraction_success) AS extraction_success FROM crawl", "crawl")
def snk_06(t):
    return t.crawl.select("event_id", F.when(F.col("event_id") % 5 == 0, True).otherwise(F.col("extraction_success")).alias("extraction_success"))


@query("snk_07_csv_export", "SELECT nces_id, district_name AS name FROM districts", "districts")
def snk_07(t):
    path = _folder(t, "export")
    files.export_csv(t.districts.select("nces_id", "district_name"), path, {"district_name": "name"})
    return t.spark.read.schema("nces_id string, name string").option("header", True).option("escape", '"').csv(path)


@query("snk_10_delete_state", "SELECT id FROM registry WHERE state <> 'S03'", "registry")
def snk_10(t):
    return files.delete_keys(t.registry, t.registry.where("state = 'S03'"), ["state"]).select("id")


@query("snk_11_rollback", "SELECT m.registry_id, m.nces_id FROM matches m JOIN registry r ON r.id = m.registry_id WHERE import_batch_id <> 'batch2'", "matches registry")
def snk_11(t):
    gone = t.registry.where("import_batch_id = 'batch2'").select(F.col("id").alias("registry_id"))
    return files.delete_keys(t.matches, gone, ["registry_id"]).select("registry_id", "nces_id")


@query("snk_12_backfill", "SELECT id, coalesce(website_url, 'https://www.' || nullif(split_part(email, '@', 2), '')) AS website_url, website_url IS NULL AND coalesce(contains(email, '@'), false) AS filled FROM registry", "registry")
def snk_12(t):
    return files.backfill_sites(t.registry).select("id", "website_url", "filled")


@query("str_01_hourly", "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n FROM events WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events) GROUP BY ALL")
def str_01(t):
    events, path = t.events.withColumn("ts", F.col("ts").cast("timestamp")), _folder(t, "arriving-events")
    events.write.parquet(path)
    stream = t.spark.readStream.schema(events.schema).parquet(path)
    return jobs.run_available(t.spark, jobs.hourly_counts(stream), _folder(t, "stream")).select(F.col("hour").cast("timestamp_ntz").alias("hour"), "event_type", "n")


@query("str_03_first_seen", "SELECT DISTINCT content_hash FROM docs WHERE content_hash IS NOT NULL", "docs")
def str_03(t):
    path = _folder(t, "arriving-docs")
    t.docs.where("content_hash IS NOT NULL").select("content_hash", F.lit("2024-01-01").cast("timestamp").alias("ts")).write.parquet(path)
    stream = t.spark.readStream.schema("content_hash string, ts timestamp").parquet(path)
    return jobs.run_available(t.spark, jobs.first_seen(stream), _folder(t, "stream")).select("content_hash")


@query("plan_01_weighted", "SELECT nces_id, round(0.4e0 * readiness / 5 + 0.3e0 * alignment / 4 + 0.3e0 * activation / 3, 6) AS score FROM scores WHERE 0.4e0 * readiness / 5 + 0.3e0 * alignment / 4 + 0.3e0 * activation / 3 >= 0.6", "scores")
def plan_01(t):
    long = t.scores.select("nces_id", F.expr("stack(3, 'readiness', readiness / 5, 0.4D, 'alignment', alignment / 4, 0.3D, 'activation', activation / 3, 0.3D) AS (criterion, value, weight)"))
    s = long.groupBy("nces_id").agg(F.sum(F.col("weight") * F.col("value")).alias("score"))
    return s.where("score >= 0.6").select("nces_id", F.round("score", 6).alias("score"))


@query("plan_02_growth", "WITH m AS (SELECT date_trunc('month', discovered_at) AS month, document_category, count(*) AS n FROM docs GROUP BY ALL) SELECT month, document_category, n, lag(n) OVER (PARTITION BY document_category ORDER BY month) AS before FROM m", "docs")
def plan_02(t):
    m = t.docs.groupBy(F.date_trunc("month", "discovered_at").alias("month"), "document_category").agg(F.count("*").alias("n"))
    return m.withColumn("before", F.lag("n").over(Window.partitionBy("document_category").orderBy("month")))


@query("plan_03_matrix", "SELECT state, coalesce(sum(enrollment), 0)::BIGINT AS enrollment, " + ", ".join(f"count(*) FILTER (outreach_tier = '{x}') AS {x}" for x in I.TIERS) + " FROM districts d LEFT JOIN scores s ON s.nces_id = d.nces_id GROUP BY state", "districts scores")
def plan_03(t):
    j = t.districts.join(t.scores.select("nces_id", "outreach_tier"), "nces_id", "left")
    sums = j.groupBy("state").agg(F.coalesce(F.sum("enrollment"), F.lit(0)).cast("long").alias("enrollment"))
    cross = j.groupBy("state").pivot("outreach_tier", list(I.TIERS)).agg(F.count(F.lit(1))).fillna(0)
    return sums.join(cross, "state").select("state", "enrollment", *I.TIERS)


@query("plan_06_near", r"SELECT doc_id FROM docs WHERE regexp_matches(lower(extracted_text), '\bthe\b(?:\W+\w+){0,5}?\W+of\b')", "docs")
def plan_06(t):
    return t.docs.where(F.lower("extracted_text").rlike(r"\bthe\b(?:\W+\w+){0,5}?\W+of\b")).select("doc_id")
