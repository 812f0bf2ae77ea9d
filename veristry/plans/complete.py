"""The rest of the inventory's lines: inputs that don't fit, further sources, policies, evidence and combined searches."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import texts as X
from ..operators import insights as I
from ..operators import matching as M
from ..operators import quality as Q
from ..operators import search as S
from ..operators import taxonomy as T
from ..operators.terms import TERMS
from ..sources import files
from .bind import AS_OF, with_entities
from .content import MATCH_SQL, NEAR, TAXONOMY, _folder, _matches
from .registry import ORACLE, query
from .statistics import TIER_SQL, _tier


def _lines(t, what: str, line) -> str:
    """A text file of registry lines in a source's own form."""
    path = _folder(t, what)
    t.registry.select(line).write.text(path)
    return path


@query("src_03_malformed", "SELECT id, CASE WHEN id % 10 = 0 THEN 'short' ELSE 'good' END AS kind, CASE WHEN id % 10 <> 0 THEN state END AS state FROM registry", "registry")
def src_03_malformed(t):
    path = _folder(t, "short-lines")
    short = F.concat_ws(",", F.col("id").cast("string"), F.lit("x"))
    whole = F.concat_ws(",", F.col("id").cast("string"), "state", "city")
    t.registry.select(F.when(F.col("id") % 10 == 0, short).otherwise(whole).alias("value")).write.text(path)
    columns = "id string, state string, city string, _bad string"
    raw = t.spark.read.schema(columns).option("columnNameOfCorruptRecord", "_bad").csv(path)
    kind = F.when(F.col("_bad").isNotNull() & (F.concat_ws("", "id", "state", "city") >= ""), "short").otherwise("good")
    rows = raw.select("id", "state", kind.alias("kind"), F.col("_bad"))
    return rows.select(F.coalesce(F.col("id"), F.split("_bad", ",")[0]).cast("long").alias("id"), "kind", F.when(F.col("kind") == "good", F.col("state")).alias("state"))


CONTACT = {"name": r"<h1[^>]*>([^<]+)</h1>", "phone": r"(\(?\d{3}\)?[ .-]?\d{3}[.-]\d{4})", "site": "href=\"(https?://[^\"]+)\""}


@query("src_08_contact", "SELECT page_id, " + ", ".join(f"nullif(regexp_extract(h, '{p}', 1, 'i'), '') AS {n}" for n, p in CONTACT.items()) + ", nullif(regexp_extract(url, '^https?://[^/?#]+/([^/?#]+)', 1), '') AS city FROM (SELECT page_id, url, CASE WHEN page_id % 3 = 0 THEN html || '<p>Call (304) 555-' || lpad((page_id % 10000)::VARCHAR, 4, '0') || '</p><a href=\"https://www.d' || page_id || '.example.org/x\">site</a>' ELSE html END AS h FROM pages)")
def src_08_contact(t):
    more = F.concat("html", F.lit("<p>Call (304) 555-"), F.lpad((F.col("page_id") % 10000).cast("string"), 4, "0"), F.lit('</p><a href="https://www.d'), F.col("page_id").cast("string"), F.lit('.example.org/x">site</a>'))
    h = F.when(F.col("page_id") % 3 == 0, more).otherwise(F.col("html"))
    part = lambda c, p: F.nullif(F.regexp_extract(c, p, 1), F.lit(""))
    return t.pages.select("page_id", *[part(h, f"(?i){p}").alias(n) for n, p in CONTACT.items()], part(F.col("url"), r"^https?://[^/?#]+/([^/?#]+)").alias("city"))


@query("src_12_strict_rows", "SELECT id, id % 8 <> 0 AS fits, CASE WHEN id % 8 <> 0 THEN city END AS city FROM registry", "registry")
def src_12_strict(t):
    quoted = F.concat(F.lit('"'), F.col("id").cast("string"), F.lit('","'), "city", F.lit('"'))
    path = _lines(t, "strict", F.when(F.col("id") % 8 == 0, F.concat(F.col("id").cast("string"), F.lit(","), "city")).otherwise(quoted).alias("value"))
    good, bad = files.read_strict(t.spark, path, ["id", "city"])
    left = bad.select(F.split("line", ",")[0].cast("long").alias("id"), F.lit(False).alias("fits"), F.lit(None).cast("string").alias("city"))
    return good.select(F.col("id").cast("long").alias("id"), F.lit(True).alias("fits"), "city").unionByName(left)


@query("snk_03_append_audit", "SELECT count(*) FILTER (import_batch_id <> 'batch1') AS before, count(*) FILTER (import_batch_id = 'batch1') AS added, count(*) AS after FROM registry", "registry")
def snk_03_append(t):
    path = _folder(t, "audited")
    t.registry.where("import_batch_id <> 'batch1'").write.parquet(path)
    return files.append_audited(t.registry.where("import_batch_id = 'batch1'"), path)


# Labels of a district list's columns, and where each value comes from.
LIST_COLUMNS = {
    "NCES ID": "nces_id", "District Name": "district_name", "State": "state", "County": "cast(NULL AS string)", "City": "city", "Enrollment": "enrollment", "Grades Served": "cast(NULL AS string)", "Superintendent": "superintendent_name",
    "Email": "superintendent_email", "Phone": "phone", "Address": "cast(NULL AS string)", "Website": "website_url", "FRPL %": "frpl_percent", "Minority %": "minority_percent", "Locale": "locale_code", "Tier": "outreach_tier",
}


@query("snk_08_csv_export", "SELECT " + ", ".join(f"nullif(({e})::VARCHAR, '') AS \"{n}\"" for n, e in LIST_COLUMNS.items()) + " FROM (SELECT d.*, s.outreach_tier FROM districts d LEFT JOIN scores s ON s.nces_id = d.nces_id)", "districts scores")
def snk_08_csv(t):
    path = _folder(t, "list-csv")
    rows = t.districts.join(t.scores.select("nces_id", "outreach_tier"), "nces_id", "left").select([F.expr(e).alias(n) for n, e in LIST_COLUMNS.items()])
    files.export_csv(rows, path)
    return t.spark.read.schema(", ".join(f"`{n}` string" for n in LIST_COLUMNS)).option("header", True).option("quote", '"').option("escape", '"').csv(path)


@query("snk_10_delete_cascade", "WITH i AS (SELECT DISTINCT import_batch_id || ' ' || state AS name FROM registry) SELECT 'matches' AS tbl, registry_id::VARCHAR AS k FROM matches WHERE registry_id NOT IN (SELECT id FROM registry WHERE state = 'S03') UNION ALL SELECT 'registry', id::VARCHAR FROM registry WHERE state <> 'S03' UNION ALL SELECT 'imports', name FROM i WHERE NOT contains(lower(name), 's03')", "registry matches")
def snk_10_cascade(t):
    imports = t.registry.select(F.concat("import_batch_id", F.lit(" "), "state").alias("name"), F.lit(None).cast("string").alias("notes")).distinct()
    left = files.delete_state("S03", t.registry, t.matches, imports)
    keys = {"matches": "registry_id", "registry": "id", "imports": "name"}
    out = [left[n].select(F.lit(n).alias("tbl"), F.col(k).cast("string").alias("k")) for n, k in keys.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("flt_12_tiered", f"SELECT nces_id, tier, enrollment FROM (SELECT *, {TIER_SQL} AS tier FROM districts) d WHERE tier IN ('A', 'B', 'C') AND trim(website_url) <> '' AND NOT regexp_matches(lower(website_url), 'facebook|twitter|instagram') AND NOT EXISTS (SELECT 1 FROM docs x WHERE x.nces_id = d.nces_id) AND NOT EXISTS (SELECT 1 FROM crawl c WHERE c.nces_id = d.nces_id AND status = 'success') ORDER BY tier, enrollment DESC NULLS LAST, nces_id LIMIT 100", "districts docs crawl")
def flt_12_tiered(t):
    d = t.districts.withColumn("tier", _tier()).where(F.col("tier").isin("A", "B", "C") & X.filled(F.col("website_url")) & ~F.lower("website_url").rlike("facebook|twitter|instagram"))
    d = d.join(t.docs.select("nces_id"), "nces_id", "left_anti").join(t.crawl.where("status = 'success'").select("nces_id"), "nces_id", "left_anti")
    return d.orderBy("tier", F.desc_nulls_last("enrollment"), "nces_id").limit(100).select("nces_id", "tier", "enrollment")


DIRECTORY_SQL = "c AS (SELECT nces_id, CASE WHEN k % 3 = 0 THEN '' ELSE 'https://ccd' || k || '.example.org' END AS website_url, CASE WHEN k % 4 = 1 THEN NULL ELSE '304-555-' || (1000 + k % 9000) END AS phone, enrollment + 11 AS enrollment FROM districts WHERE k % 2 = 0)"


def _directory(t):
    """A second directory that knows half of the districts."""
    site = F.when(F.col("k") % 3 == 0, "").otherwise(F.concat(F.lit("https://ccd"), F.col("k").cast("string"), F.lit(".example.org")))
    phone = F.when(F.col("k") % 4 == 1, None).otherwise(F.concat(F.lit("304-555-"), (1000 + F.col("k") % 9000).cast("string")))
    return t.districts.where("k % 2 = 0").select("nces_id", site.alias("website_url"), phone.alias("phone"), (F.col("enrollment") + 11).alias("enrollment"))


RAW_VIEW_SQL = f"WITH {DIRECTORY_SQL} SELECT d.nces_id, registry_id, coalesce(r.first_name || ' ' || r.last_name, nullif(superintendent_name, '')) AS superintendent_name, coalesce(r.website_url, nullif(c.website_url, ''), nullif(d.website_url, '')) AS website_url, coalesce(r.enrollment, c.enrollment, d.enrollment) AS enrollment, coalesce(c.phone, d.phone) AS phone, match_method, confidence, CASE WHEN r.id IS NOT NULL THEN 'state_registry' WHEN c.nces_id IS NOT NULL THEN 'directory' ELSE 'baseline' END AS primary_source FROM districts d LEFT JOIN matches m ON m.nces_id = d.nces_id LEFT JOIN registry r ON r.id = m.registry_id LEFT JOIN c ON c.nces_id = d.nces_id"


@query("join_03_raw_with_directory", RAW_VIEW_SQL, "districts matches registry")
def join_03_raw(t):
    return M.registry_view(t.districts, t.matches, t.registry, _directory(t)).drop("state", "district_name", "superintendent_email")


@query("join_09_distances", f"WITH {NEAR} SELECT vec_id, round(distance, 6) AS distance FROM d WHERE vec_id <> 0", "vectors")
def join_09_distances(t):
    return S.with_distance(t.vectors.where("vec_id <> 0"), S.query_vector(t.vectors, 0)).select("vec_id", F.round("distance", 6).alias("distance"))


# No SQL: the other engine rounds the number of transpositions down, which decides pairs near the cut; tested against a brute-force version.
@query("join_10_similar_in_block")
def join_10_similar(t):
    return M.similar_in_block(t.registry, t.districts, ["state", "city"], 0.9, classes=True).withColumn("s", F.round("s", 6))


def _units(t):
    """Supervisory units: some registry names, each standing for the names of one or two districts."""
    r = t.registry.where("id % 12 = 1").select(F.lower("district_name").alias("unit"), F.explode(F.array(F.col("id") + 1, F.col("id") + 4)).alias("k"))
    return r.join(t.districts.select("k", F.lower("district_name").alias("name")), "k").groupBy("unit").agg(F.collect_set("name").alias("names"))


# No SQL, as for join_10_similar_in_block.
@query("join_12_unit_map")
def join_12_units(t):
    return M.map_units(t.registry, _units(t), t.districts, classes=True)


HINT_SQL = "h AS (SELECT *, 'office@' || regexp_extract(lower(district_name), '([a-z]+ \\d+)', 1).replace(' ', '') || 'sd.k12.example' AS mail FROM registry)"


def _hinted(t):
    """Registry rows whose e-mail domain is made of the district's name."""
    label = F.replace(F.regexp_extract(F.lower("district_name"), r"([a-z]+ \d+)", 1), F.lit(" "), F.lit(""))
    return t.registry.withColumn("email", F.concat(F.lit("office@"), label, F.lit("sd.k12.example")))


@query("join_13_mail_hint", f"WITH {HINT_SQL}, l AS (SELECT id, state, regexp_replace(regexp_extract(lower(mail), '@([^.@\\s]+)\\.', 1), '(schools|school|sd|k12)$', '') AS hint FROM h) SELECT l.id, d.nces_id FROM l JOIN districts d ON d.state = l.state AND contains(regexp_replace(lower(d.district_name), '\\s+', '', 'g'), hint) WHERE length(hint) >= 4", "registry districts")
def join_13_hint(t):
    return M.mail_hints(_hinted(t), t.districts)


@query("join_13_mail_hint_classes", f"WITH {HINT_SQL}, l AS (SELECT id, state, regexp_replace(regexp_extract(lower(mail), '@([^.@\\s]+)\\.', 1), '(schools|school|sd|k12)$', '') AS hint FROM h), r AS (SELECT *, min(id) OVER (PARTITION BY state, hint) AS c FROM l WHERE length(hint) >= 4 AND state IS NOT NULL), b AS (SELECT *, min(nces_id) OVER (PARTITION BY state, n) AS c FROM (SELECT nces_id, state, regexp_replace(lower(district_name), '\\s+', '', 'g') AS n FROM districts)) SELECT 'pair' AS kind, NULL::BIGINT AS id, NULL::VARCHAR AS nces_id, x.c AS row_class, y.c AS district_class FROM (SELECT DISTINCT state, hint, c FROM r) x JOIN (SELECT DISTINCT state, n, c FROM b) y ON y.state = x.state AND contains(n, hint) UNION ALL SELECT 'row', id, NULL, c, NULL FROM r UNION ALL SELECT 'district', NULL, nces_id, NULL, c FROM b", "registry districts")
def join_13_classes(t):
    """The pairs of join_13_mail_hint as pairs of classes plus membership, which grow with the rows."""
    return M.mail_hints(_hinted(t), t.districts, classes=True)


# No SQL, as for join_10_similar_in_block.
@query("match_05_hint_waterfall")
def match_05_hints(t):
    return M.match_with_hints(_hinted(t), _units(t), t.districts, classes=True).withColumn("confidence", F.round("confidence", 6))


@query("join_17_five_sources", f"WITH {DIRECTORY_SQL}, f AS (SELECT nces_id, url FROM crawl WHERE status = 'failure' QUALIFY row_number() OVER (PARTITION BY nces_id ORDER BY crawled_at DESC, event_id DESC) = 1), m AS (SELECT nces_id, min(registry_id) AS registry_id FROM matches GROUP BY 1) SELECT d.nces_id, coalesce(f.url, nullif(d.website_url, ''), nullif(c.website_url, ''), r.website_url) AS url, CASE WHEN f.url IS NOT NULL THEN 'failure' WHEN d.website_url <> '' THEN 'baseline' WHEN c.website_url <> '' THEN 'directory' WHEN r.website_url IS NOT NULL THEN 'registry' END AS source FROM districts d LEFT JOIN f ON f.nces_id = d.nces_id LEFT JOIN c ON c.nces_id = d.nces_id LEFT JOIN m ON m.nces_id = d.nces_id LEFT JOIN registry r ON r.id = m.registry_id", "districts crawl matches registry")
def join_17_five(t):
    failed = t.crawl.where("status = 'failure'").groupBy("nces_id").agg(F.max(F.struct("crawled_at", "event_id", "url"))["url"].alias("f"))
    linked = t.matches.groupBy("nces_id").agg(F.min("registry_id").alias("registry_id")).join(t.registry.select(F.col("id").alias("registry_id"), F.col("website_url").alias("r")), "registry_id", "left")
    j = t.districts.select("nces_id", F.nullif("website_url", F.lit("")).alias("b")).join(failed, "nces_id", "left").join(_directory(t).select("nces_id", F.nullif("website_url", F.lit("")).alias("c")), "nces_id", "left").join(linked, "nces_id", "left")
    order = {"f": "failure", "b": "baseline", "c": "directory", "r": "registry"}
    return j.select("nces_id", F.coalesce(*order).alias("url"), F.coalesce(*[F.when(F.col(c).isNotNull(), F.lit(n)) for c, n in order.items()]).alias("source"))


@query("match_11_source_tier", "SELECT m.nces_id, registry_id, row_number() OVER (PARTITION BY m.nces_id ORDER BY import_batch_id, imported_at DESC, registry_id) = 1 AS kept, CASE WHEN count(*) OVER (PARTITION BY m.nces_id) > 1 THEN 'DUPLICATE_MATCH' END AS flag FROM matches m JOIN registry r ON r.id = m.registry_id", "matches registry")
def match_11_tier(t):
    registry = t.registry.withColumn("tier", F.substring("import_batch_id", 6, 1).cast("int"))
    return M.resolve_conflicts(t.matches, registry, "tier").select("nces_id", "registry_id", "kept", "flag")


@query("match_15_rates", "WITH f AS (SELECT r.id, first(match_method ORDER BY confidence DESC, match_method) AS m FROM registry r LEFT JOIN (SELECT * FROM matches WHERE registry_id % 6 <> 1) x ON x.registry_id = r.id GROUP BY r.id) SELECT 'method' AS kind, coalesce(m, 'unmatched') AS name, count(*) AS n, round(100.0e0 * count(*) / (SELECT count(*) FROM f), 1) AS rate FROM f GROUP BY 2 UNION ALL (SELECT 'unmatched', id::VARCHAR, NULL, NULL FROM f WHERE m IS NULL ORDER BY id LIMIT 10)", "matches registry")
def match_15_rates(t):
    return M.run_report(t.registry, t.matches.where("registry_id % 6 <> 1"))


@query("agg_03_leaders", "WITH b AS (SELECT d.nces_id, total FROM districts d JOIN scores s ON s.nces_id = d.nces_id WHERE state = 'S03' ORDER BY total DESC, d.nces_id LIMIT 10) SELECT b.nces_id, total, count(doc_id) AS n_documents FROM b LEFT JOIN docs ON docs.nces_id = b.nces_id GROUP BY ALL", "districts scores docs")
def agg_03_leaders(t):
    return I.state_leaders(t.districts, t.scores, t.docs, "S03")


@query("agg_17_rate", "WITH x AS (SELECT count(DISTINCT nces_id) AS done, (epoch_us(max(crawled_at)) - epoch_us(min(crawled_at))) / 3.6e9 AS hours FROM crawl WHERE nces_id IS NOT NULL), y AS (SELECT count(*) AS n FROM districts WHERE nces_id NOT IN (SELECT nces_id FROM crawl WHERE nces_id IS NOT NULL)) SELECT done, n AS \"left\", round(done / hours, 6) AS per_hour, round(n / (done / hours), 6) AS hours_left FROM x, y", "crawl districts")
def agg_17_rate(t):
    return I.progress_rate(t.crawl, t.districts)


@query("agg_21_prompts", "SELECT regexp_replace(lower(trim(prompt)), '\\s+', ' ', 'g') AS prompt, count(*) AS n, round(avg(result_count), 6) AS mean_results, max(generated_at) AS last_used FROM searches WHERE generated_at >= TIMESTAMP '2024-02-01 00:00:00' - INTERVAL 20 DAY GROUP BY 1 ORDER BY n DESC, 1 LIMIT 15", "searches")
def agg_21_prompts(t):
    return I.top_prompts(t.searches, AS_OF, 20)


CATEGORY_LEAST = {"readiness": 3, "alignment": 3, "activation": 2, "branding": 1}


@query("set_01_four_categories", " UNION ALL ".join(f"SELECT '{c}' AS category, count(*) AS n FROM scores WHERE {c} >= {v}" for c, v in CATEGORY_LEAST.items()), "scores")
def set_01_four(t):
    out = None
    for c, v in CATEGORY_LEAST.items():
        one = t.scores.where(F.col(c) >= v).agg(F.lit(c).alias("category"), F.count("*").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


#: Words that are put behind the given texts, which have none of the taxonomy's.
INSERTED = {0: "our graduate profile", 1: "the learner profile", 2: "a strategic plan", 3: "Portrait of a Graduate", 4: "capstone and performance tasks"}
INSERTED_SQL = "CASE doc_id % 6 " + " ".join(f"WHEN {k} THEN ' {v}'" for k, v in INSERTED.items()) + " ELSE '' END"


def _inserted(t):
    more = F.lit("")
    for k, v in INSERTED.items():
        more = F.when(F.col("doc_id") % 6 == k, F.lit(f" {v}")).otherwise(more)
    return t.docs.withColumn("extracted_text", F.concat("extracted_text", more))


@query("doc_08_by_keywords", "SELECT doc_id, CASE WHEN k IN (0, 3) THEN 'portrait_of_graduate' WHEN k = 2 THEN 'strategic_plan' ELSE 'other' END AS retry, CASE WHEN k IN (0, 1, 3) THEN 'portrait_of_graduate' WHEN k = 2 THEN 'strategic_plan' ELSE 'other' END AS targeted, CASE WHEN k IN (0, 1, 3) THEN 'portrait_of_graduate' WHEN k = 2 THEN 'strategic_plan' WHEN contains(document_url, 'graduate') THEN 'portrait_of_graduate' WHEN contains(document_url, 'strategic') THEN 'strategic_plan' ELSE 'other' END AS crawl FROM (SELECT doc_id, document_url, doc_id % 6 AS k FROM docs WHERE extracted_text IS NOT NULL)", "docs")
def doc_08_keywords(t):
    found = X.keywords(F.col("extracted_text"))
    return _inserted(t).where("extracted_text is not null").select("doc_id", *[X.category(F.col("document_url"), found, p).alias(p) for p in ("retry", "targeted", "crawl")])


def _term_sql() -> str:
    """Every standard term against every text, as (doc_id, category, keyword, count, weight)."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    terms = ", ".join(f"({quoted(c)}, {quoted(n)}, {quoted(p)}, {w}::DOUBLE)" for c, n, p, w, _ in TERMS)
    return f"SELECT doc_id, category, keyword, len(regexp_extract_all(x, pattern))::INTEGER AS count, weight FROM (SELECT doc_id, lower(extracted_text || {INSERTED_SQL}) AS x FROM docs WHERE extracted_text IS NOT NULL), (VALUES {terms}) t(category, keyword, pattern, weight) WHERE regexp_matches(x, pattern)"


@query("score_01_terms_found", _term_sql(), "docs")
def score_01_found(t):
    return T.match_taxonomy(_inserted(t), TERMS, AS_OF).select("doc_id", "category", "keyword", "count", "weight")


CONTEXT_SQL = "(CASE WHEN a > 1 THEN '...' ELSE '' END) || trim(regexp_replace(substr(x, a, b - a + 1), '\\s+', ' ', 'g')) || (CASE WHEN b < length(x) THEN '...' ELSE '' END)"


def _context_sql(width: int) -> str:
    terms = ", ".join(f"('{c}', '{n}', '{p}', {w}e0)" for c, n, p, w, _ in TAXONOMY)
    return f"SELECT doc_id, nces_id, category, keyword, w, {CONTEXT_SQL} AS context FROM (SELECT *, greatest(1, strpos(x, f) - {width}) AS a, least(length(x), strpos(x, f) + length(f) - 1 + {width}) AS b FROM (SELECT doc_id, nces_id, category, keyword, w, x, regexp_extract(x, p, 0) AS f FROM (SELECT doc_id, nces_id, lower(extracted_text) AS x FROM docs WHERE extracted_text IS NOT NULL), (VALUES {terms}) t(category, keyword, p, w) WHERE regexp_matches(x, p)))"


@query("score_05_contexts", f"SELECT doc_id, keyword, context FROM ({_context_sql(50)})", "docs")
def score_05_contexts(t):
    return _matches(t).select("doc_id", "keyword", "context")


@query("plan_05_all_snippets", f"SELECT doc_id, keyword, context AS snippet FROM ({_context_sql(200)})", "docs")
def plan_05_all(t):
    text = F.lower("extracted_text")
    found = F.array(*[F.struct(F.lit(n).alias("keyword"), F.regexp_extract(text, p, 0).alias("word")) for _, n, p, _, _ in TAXONOMY])
    rows = t.docs.where("extracted_text is not null").select("doc_id", text.alias("_x"), F.explode(F.filter(found, lambda m: m["word"] != "")).alias("m"))
    return rows.select("doc_id", "m.keyword", T.context(F.col("_x"), F.col("m.word"), 200).alias("snippet"))


@query("score_08_evidence", f"WITH {MATCH_SQL}, o AS (SELECT nces_id, category, keyword, first(doc_id ORDER BY discovered_at, doc_id) AS doc_id, max(weight) AS w FROM m GROUP BY ALL), c AS (SELECT nces_id, category, string_agg('{{\"keyword\":\"' || keyword || '\",\"weight\":' || w::VARCHAR || ',\"source_doc\":' || doc_id || '}}', ',' ORDER BY keyword) AS k FROM o GROUP BY ALL) SELECT nces_id, '{{' || string_agg('\"' || category || '\":[' || k || ']', ',' ORDER BY category) || '}}' AS evidence FROM c GROUP BY 1".replace("{{", "{").replace("}}", "}"), "docs")
def score_08_evidence(t):
    return T.evidence_json(_matches(t))


@query("score_09_excerpts", f"WITH q AS ({_context_sql(50)}), r AS (SELECT *, coalesce(sum(length(context) + 1) OVER (PARTITION BY nces_id, category, doc_id ORDER BY w DESC, keyword ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM q) SELECT nces_id, category, doc_id, string_agg(context, ' ' ORDER BY before) AS excerpt FROM r WHERE before < 120 GROUP BY ALL", "docs")
def score_09_excerpts(t):
    return T.excerpts(_matches(t), 120)


@query("vec_01_filters", f"WITH {NEAR} SELECT vec_id, round(distance, 6) AS distance FROM d JOIN docs x ON x.doc_id = d.doc_id JOIN districts y ON y.nces_id = x.nces_id WHERE distance < 1.2 AND vec_id <> 0 AND state < 'S99' AND state = 'S03' AND document_category IN ('strategic_plan', 'other') AND discovered_at >= TIMESTAMP '2023-01-10' AND discovered_at < TIMESTAMP '2023-12-02' ORDER BY d.distance, vec_id LIMIT 20", "vectors docs districts")
def vec_01_filters(t):
    v = S.filter_chunks(t.vectors.where("vec_id <> 0"), t.docs, t.districts, state="S03", types=["strategic_plan", "other"], since="2023-01-10", until="2023-12-01")
    return S.vector_search(v, S.query_vector(t.vectors, 0), 1.2).select("vec_id", F.round("distance", 6).alias("distance"))


PROMPT_SQL = "CASE id % 4 WHEN 0 THEN prompt || ' in TX, NY and TX with minority above 45 %' WHEN 1 THEN prompt || ' for AI in US, enrollment at least 2500, Strategic Plan' WHEN 2 THEN prompt || ' free reduced lunch over 120' ELSE prompt END"


@query("rank_02_all_criteria", rf"""WITH p AS (SELECT id, {PROMPT_SQL} AS p FROM searches), q AS (SELECT id, lower(p) AS l FROM p), n AS (SELECT id, nullif(regexp_extract(l, '(?:frpl|free[\s-]reduced[\s-]lunch)[^\d]{{0,20}}(\d{{1,3}})', 1), '')::INTEGER AS f, nullif(regexp_extract(l, 'minority[^\d]{{0,20}}(\d{{1,3}})', 1), '')::INTEGER AS m,
  nullif(regexp_extract(l, '(?:enrollment|students)[^\d]{{0,20}}(?:>=|over|above|at least)\s*(\d{{2,7}})', 1), '')::INTEGER AS e FROM q)
SELECT id, CASE WHEN f > 100 THEN 100 ELSE f END AS frpl_min, CASE WHEN id % 8 = 0 THEN 30 WHEN m > 100 THEN 100 ELSE m END AS minority_min, e AS enrollment_min, CASE id % 4 WHEN 0 THEN 'TX,NY' END AS states, CASE id % 4 WHEN 1 THEN 'strategic plan' END AS required_keywords FROM n""", "searches")
def rank_02_all(t):
    k = F.col("id") % 4
    more = F.when(k == 0, " in TX, NY and TX with minority above 45 %").when(k == 1, " for AI in US, enrollment at least 2500, Strategic Plan").when(k == 2, " free reduced lunch over 120").otherwise("")
    prompt = F.concat("prompt", more)
    found = S.with_override(S.grant_criteria(prompt) | S.grant_terms(prompt), {"minority_min": F.when(F.col("id") % 8 == 0, 30)})
    text = lambda n, c: F.array_join(c, ",") if n in ("states", "required_keywords") else c
    return t.searches.select("id", *[text(n, c).alias(n) for n, c in found.items()])


@query("rank_03_excluded", "SELECT nces_id FROM districts WHERE nces_id NOT IN (SELECT nces_id FROM crawl WHERE crawled_at >= TIMESTAMP '2024-02-01' - INTERVAL 5 DAY AND url_type = 'purchase') AND nces_id NOT IN (SELECT nces_id FROM scores WHERE outreach_tier = 'tier3')", "districts crawl scores")
def rank_03_excluded(t):
    events = t.crawl.where("url_type = 'purchase'").select("nces_id", F.col("crawled_at").alias("happened_at"))
    return S.suppress(t.districts.select("nces_id"), events, AS_OF, 5, exclude=t.scores.where("outreach_tier = 'tier3'"))


EXPLAIN_SQL = f"WITH {MATCH_SQL}, e AS (SELECT nces_id, category, first(keyword ORDER BY adjusted DESC, doc_id, keyword) AS k FROM m GROUP BY ALL), x AS (SELECT nces_id, array_to_string(list_slice(list(k ORDER BY category), 1, 3), '|') AS ks FROM e GROUP BY 1) SELECT s.nces_id, 'semantic_max=0.000|readiness_score=' || format('{{:.3f}}', readiness) || '|activation_score=' || format('{{:.3f}}', activation) || '|total_score=' || format('{{:.3f}}', total) AS signals, coalesce(ks, '') AS excerpts, CASE WHEN greatest(0.2e0, least(0.98e0, total / 5)) < 0.6 THEN 'low_confidence' ELSE '' END AS dampeners FROM scores s LEFT JOIN x ON x.nces_id = s.nces_id".replace("{{", "{").replace("}}", "}")


@query("rank_09_explained", EXPLAIN_SQL, "docs scores")
def rank_09_explained(t):
    rows = t.scores.withColumns({"top": F.lit(None).cast("double"), "confidence": F.greatest(F.lit(0.2), F.least(F.lit(0.98), F.col("total") / 5))})
    joined = lambda c, f: F.array_join(F.transform(c, f), "|")
    out = S.explain(rows, _matches(t), 0.6)
    return out.select("nces_id", joined("signals", lambda x: F.concat(x["signal"], F.lit("="), F.format_string("%.3f", x["weight"]))).alias("signals"), joined("excerpts", lambda x: x["keyword"]).alias("excerpts"), joined("dampeners", lambda x: x["signal"]).alias("dampeners"))


@query("rank_11_rows", "WITH b AS (SELECT string_agg(state, ', ' ORDER BY m DESC, state) AS s FROM (SELECT state, round(avg(total), 6) AS m FROM districts d LEFT JOIN scores s ON s.nces_id = d.nces_id GROUP BY state ORDER BY m DESC NULLS LAST, state LIMIT 3)) SELECT nces_id, total, 'Top momentum states right now: ' || b.s || '.' AS briefing FROM scores, b ORDER BY total DESC, nces_id LIMIT 10", "districts scores")
def rank_11_rows(t):
    states = F.array_sort(F.collect_list(F.struct((-F.col("mean_total")).alias("m"), "state")))
    text = I.momentum(t.districts, t.scores).agg(F.concat(F.lit("Top momentum states right now: "), F.array_join(F.transform(states, lambda x: x["state"]), ", "), F.lit(".")).alias("briefing"))
    return t.scores.orderBy(F.desc("total"), "nces_id").limit(10).select("nces_id", "total").crossJoin(text)


@query("rank_12_log_rows", "SELECT id, user_id, trim(prompt) AS prompt, CASE WHEN regexp_matches(lower(prompt), 'trend|brief|insight|state overview') THEN 'insights_briefing' WHEN regexp_matches(lower(prompt), 'grant|frpl|minority') THEN 'grant_match' WHEN regexp_matches(lower(prompt), 'next hottest|uncontacted|lead') THEN 'next_hottest_uncontacted' ELSE 'district_search' END AS intent, 60 AS suppression_days, 2 + id % 40 AS result_count, array_to_string(list_slice(list_concat(top_ids, list_transform(range(id % 40), lambda x: 'x' || x)), 1, 25), ',') AS top_ids FROM searches", "searches")
def rank_12_log(t):
    path = _folder(t, "search-log")
    more = F.transform(F.filter(F.sequence(F.lit(0), F.lit(39)), lambda x: x < F.col("id") % 40), lambda x: F.concat(F.lit("x"), x.cast("string")))
    rows = S.search_log(t.searches.withColumn("top_ids", F.concat("top_ids", F.lit([""]), more)))
    rows.write.mode("append").parquet(path)
    return t.spark.read.schema(rows.schema).parquet(path).select("id", "user_id", "prompt", "intent", "suppression_days", F.col("result_count").cast("long").alias("result_count"), F.array_join("top_ids", ",").alias("top_ids"))


@query("qual_04_match_flags", "SELECT nces_id AS key, 'DUPLICATE_MATCH' AS flag, 'high' AS severity FROM matches GROUP BY nces_id HAVING count(DISTINCT registry_id) > 1 UNION ALL SELECT id::VARCHAR, 'ORPHAN_RECORD', 'medium' FROM registry WHERE id NOT IN (SELECT registry_id FROM matches WHERE registry_id % 6 <> 1 AND nces_id IN (SELECT nces_id FROM districts))".replace("FROM matches GROUP", "FROM matches WHERE registry_id % 6 <> 1 GROUP"), "districts registry matches")
def qual_04_match(t):
    return Q.match_flags(t.districts, t.registry, t.matches.where("registry_id % 6 <> 1"))


@query("plan_02_rising", "WITH k AS (SELECT date_trunc('month', crawled_at) + (event_id % 6) * INTERVAL 1 MONTH AS month, unnest(keywords_found) AS name FROM crawl WHERE (event_id % 6 < 3 OR event_id % 12 < 7)), m AS (SELECT month, name, count(*) AS n FROM k GROUP BY ALL), g AS (SELECT *, round(100.0e0 * (n - lag(n) OVER w) / nullif(lag(n) OVER w, 0), 2) AS growth FROM m WINDOW w AS (PARTITION BY name ORDER BY month)) SELECT month, name, n, growth, row_number() OVER (PARTITION BY month ORDER BY growth DESC, n DESC, name)::INTEGER AS place FROM g WHERE growth > 50 QUALIFY place <= 10", "crawl")
def plan_02_rising(t):
    rows = t.crawl.where("event_id % 6 < 3 OR event_id % 12 < 7").select(F.expr("add_months(date_trunc('month', crawled_at), cast(event_id % 6 AS int))").cast("timestamp").alias("month"), F.explode("keywords_found").alias("name"))
    return I.rising(rows.groupBy("month", "name").agg(F.count("*").alias("n"))).withColumn("month", F.col("month").cast("timestamp_ntz"))


@query("plan_03_leading_states", "WITH s AS (SELECT state, " + ", ".join(f"round(avg({c}), 6) AS {c}" for c in CATEGORY_LEAST) + " FROM districts d JOIN scores x ON x.nces_id = d.nces_id GROUP BY 1), u AS (" + " UNION ALL ".join(f"SELECT state, '{c}' AS category, {c} AS mean FROM s" for c in CATEGORY_LEAST) + ") SELECT state, category, mean, row_number() OVER (PARTITION BY category ORDER BY mean DESC, state)::INTEGER AS place FROM u QUALIFY place <= 5", "districts scores")
def plan_03_leading(t):
    return I.leading_states(t.districts, t.scores)


@query("plan_06_combined", rf"WITH {NEAR} SELECT x.doc_id, round(min(distance), 6) AS distance FROM d JOIN docs x ON x.doc_id = d.doc_id JOIN districts y ON y.nces_id = x.nces_id WHERE distance < 1.1 AND enrollment >= 500 AND (contains(lower(extracted_text), 'the') OR contains(lower(extracted_text), 'der')) AND NOT contains(lower(extracted_text), 'zzz') AND regexp_matches(lower(extracted_text), '\bthe\b(?:\W+\w+){{0,5}}?\W+of\b') GROUP BY x.doc_id ORDER BY min(distance), x.doc_id LIMIT 50", "vectors docs districts")
def plan_06_combined(t):
    text = F.lower("extracted_text")
    words = (text.contains("the") | text.contains("der")) & ~text.contains("zzz") & text.rlike(r"\bthe\b(?:\W+\w+){0,5}?\W+of\b")
    d = t.docs.where(words).join(t.districts.where("enrollment >= 500").select("nces_id"), "nces_id", "left_semi").select("doc_id")
    near = S.with_distance(t.vectors.join(d, "doc_id", "left_semi"), S.query_vector(t.vectors, 0)).where("distance < 1.1")
    return near.groupBy("doc_id").agg(F.min("distance").alias("distance")).orderBy("distance", "doc_id").limit(50).select("doc_id", F.round("distance", 6).alias("distance"))


# SQL of queries that are registered elsewhere.
ORACLE["score_05_context"] = ORACLE["score_05_contexts"]
ORACLE["plan_05_snippets"] = with_entities(["docs"], f"SELECT doc_id, context AS snippet FROM ({_context_sql(200)}) WHERE keyword = '{TAXONOMY[0][1]}'")
