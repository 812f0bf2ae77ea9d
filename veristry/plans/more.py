"""Further variants: policies, exports, explanations, streams, comparisons."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import texts as X
from ..operators import basics as B
from ..operators import documents as D
from ..operators import insights as I
from ..operators import matching as M
from ..operators import quality as Q
from ..operators import search as S
from ..operators import taxonomy as T
from ..sources import files
from .bind import AS_OF
from .content import MATCH_SQL, NEAR, TAXONOMY, _folder, _matches
from .registry import query
from .statistics import JW_SQL, SCORE_SQL, _view


@query("match_05_lower_cut", JW_SQL.replace("s >= 0.8e0 QUALIFY", "s >= 0.75e0 QUALIFY") + "SELECT id, nces_id, 'exact_name' AS match_method, false AS review FROM e UNION ALL SELECT id, nces_id, CASE WHEN s >= 0.85e0 THEN 'normalized_name' ELSE 'fuzzy' END, s < 0.85e0 FROM x", "registry districts")
def match_05(t):
    return M.match_entities(t.registry, t.districts, cut=0.75, near=0.85).select("id", "nces_id", "match_method", "review")


@query("match_15_run_report", "SELECT match_method, count(*) AS n, count(*) FILTER (confidence < 0.85) AS review FROM matches GROUP BY match_method", "matches")
def match_15(t):
    return t.matches.groupBy("match_method").agg(F.count("*").alias("n"), F.count(F.when(F.col("confidence") < 0.85, 1)).alias("review"))


@query("doc_08_policies", "SELECT doc_id, CASE WHEN contains(document_url, 'graduate') THEN 'portrait_of_graduate' WHEN contains(document_url, 'strategic') THEN 'strategic_plan' ELSE 'other' END AS retry FROM docs", "docs")
def doc_08(t):
    return t.docs.select("doc_id", X.category(F.lit(None).cast("string"), X.keywords(F.col("document_url"), ["graduate", "strategic"]), "retry").alias("retry"))


@query("doc_10_nul", "SELECT doc_id, sha256(replace(text, chr(0), '')) AS h FROM documents")
def doc_10(t):
    return t.documents.select("doc_id", F.sha2(F.regexp_replace("text", r"\x00", ""), 256).alias("h"))


@query("win_05_first_matches", f"WITH {MATCH_SQL} SELECT nces_id, category, keyword, doc_id FROM m QUALIFY row_number() OVER (PARTITION BY nces_id, category ORDER BY discovered_at, doc_id, keyword) <= 2", "docs")
def win_05(t):
    return B.latest_per_key(_matches(t), ["nces_id", "category"], [F.col("discovered_at"), F.col("doc_id"), F.col("keyword")], 2).select("nces_id", "category", "keyword", "doc_id")


@query("agg_28_work_list", "SELECT state, count(*) AS n FROM districts d WHERE NOT EXISTS (SELECT 1 FROM docs x WHERE x.nces_id = d.nces_id AND text_length >= 100) GROUP BY state", "districts docs")
def agg_28(t):
    return t.districts.join(t.docs.where("text_length >= 100").select("nces_id"), "nces_id", "left_anti").groupBy("state").agg(F.count("*").alias("n"))


@query("score_02_recency", "SELECT doc_id, CASE WHEN crawled_at IS NULL THEN 0.8e0 WHEN epoch(TIMESTAMP '2024-02-01' - crawled_at) / 86400 <= 180 THEN 1.0e0 WHEN epoch(TIMESTAMP '2024-02-01' - crawled_at) / 86400 <= 360 THEN 0.8e0 ELSE 0.6e0 END AS factor FROM docs", "docs")
def score_02(t):
    return t.docs.select("doc_id", X.recency(F.col("crawled_at"), F.lit(AS_OF).cast("timestamp")).alias("factor"))


@query("score_03_specificity", "SELECT doc_id, CASE WHEN regexp_matches(lower(document_url), '/plan|/strategic|/framework|/portrait|/vision|/graduate') OR document_category IN ('portrait_of_graduate', 'strategic_plan') THEN 1.0e0 WHEN regexp_matches(lower(document_url), 'news|article|press|blog') THEN 0.5e0 ELSE 0.8e0 END AS factor FROM docs", "docs")
def score_03(t):
    return t.docs.select("doc_id", X.specificity(F.col("document_url"), F.col("document_category")).alias("factor"))


@query("score_07_tier", "SELECT nces_id, CASE WHEN total >= 5 OR readiness >= 3 OR activation >= 2 THEN 'tier1' WHEN total >= 2 OR readiness >= 1.5 THEN 'tier2' ELSE 'tier3' END AS tier FROM scores", "scores")
def score_07(t):
    return t.scores.select("nces_id", X.outreach_tier(F.col("total"), F.col("readiness"), F.col("activation")).alias("tier"))


@query("snk_05_score_upsert", "SELECT coalesce(n.nces_id, o.nces_id) AS nces_id, coalesce(n.total, o.total) AS total, coalesce(o.scored_at, n.scored_at) AS scored_at FROM (SELECT nces_id, total, 'first' AS scored_at FROM scores) o FULL JOIN (SELECT nces_id, 9.0e0 AS total, 'second' AS scored_at FROM districts WHERE k % 6 = 0) n ON n.nces_id = o.nces_id", "scores districts")
def snk_05(t):
    old = t.scores.select("nces_id", "total", F.lit("first").alias("scored_at"))
    new = t.districts.where("k % 6 = 0").select("nces_id", F.lit(9.0).alias("total"), F.lit("second").alias("scored_at"))
    return files.upsert_latest(old, new, ["nces_id"], ["scored_at"])


@query("snk_08_list_export", "SELECT nces_id AS \"NCES ID\", district_name AS \"District\", state AS \"State\" FROM districts", "districts")
def snk_08(t):
    path = _folder(t, "list-export")
    t.districts.select(F.col("nces_id").alias("NCES ID"), F.col("district_name").alias("District"), F.col("state").alias("State")).write.json(path)
    return t.spark.read.schema("`NCES ID` string, District string, State string").json(path)


@query("snk_09_ranked_export", "SELECT row_number() OVER (ORDER BY total DESC, nces_id)::INTEGER AS place, nces_id, format('{:.2f}', round(total * 100) / 100) AS score FROM scores ORDER BY total DESC, nces_id LIMIT 100", "scores")
def snk_09(t):
    from pyspark.sql import Window

    top = t.scores.orderBy(F.desc("total"), "nces_id").limit(100)  # so few that one window may number them
    return top.select(F.row_number().over(Window.orderBy(F.desc("total"), "nces_id")).alias("place"), "nces_id", F.format_string("%.2f", F.round(F.col("total") * 100) / 100).alias("score"))


@query("rank_06_bands", "SELECT nces_id, CASE WHEN c >= 0.8 THEN 'high' WHEN c >= 0.6 THEN 'medium' ELSE 'low' END AS band FROM (SELECT nces_id, greatest(0.2e0, least(0.95e0, total / 5)) AS c FROM scores)", "scores")
def rank_06(t):
    return t.scores.select("nces_id", X.band(F.greatest(F.lit(0.2), F.least(F.lit(0.95), F.col("total") / 5))).alias("band"))


WHY_SQL = f"""WITH {MATCH_SQL}, {NEAR}, k AS (SELECT nces_id, category, keyword, max(adjusted) AS w FROM m GROUP BY ALL), w AS (SELECT nces_id, list_slice(list(keyword ORDER BY category, w DESC, keyword), 1, 3) AS ks FROM k GROUP BY 1),
r AS (SELECT nces_id, max(1 - distance) AS top FROM (SELECT * FROM d WHERE 1 - distance > 0.1 ORDER BY d.distance, vec_id LIMIT 500) GROUP BY 1), c AS (SELECT s.*, r.top FROM scores s JOIN r ON r.nces_id = s.nces_id)
SELECT c.nces_id, concat_ws('; ', CASE WHEN greatest(readiness, alignment, activation, branding) >= 3 THEN 'strong in ' || concat_ws(', ', CASE WHEN readiness >= 3 THEN 'readiness' END, CASE WHEN alignment >= 3 THEN 'alignment' END, CASE WHEN activation >= 3 THEN 'activation' END, CASE WHEN branding >= 3 THEN 'branding' END) END,
  CASE WHEN top >= 0.7 THEN 'strong' WHEN top >= 0.5 THEN 'moderate' ELSE 'weak' END || ' semantic match', CASE WHEN ks IS NOT NULL THEN 'keywords: ' || array_to_string(ks, ', ') END) AS summary FROM c LEFT JOIN w ON w.nces_id = c.nces_id"""


@query("rank_08_why", WHY_SQL, "docs vectors scores")
def rank_08(t):
    top = S.entity_relevance(t.vectors, S.query_vector(t.vectors, 0), floor=0.1)
    return S.why(t.scores.join(top, "nces_id"), T.evidence(_matches(t)))


@query("rank_13_attendees", JW_SQL + ", a AS (SELECT id, nces_id FROM e UNION ALL SELECT id, nces_id FROM x) SELECT a.id, a.nces_id, total FROM a LEFT JOIN scores s ON s.nces_id = a.nces_id ORDER BY total DESC NULLS LAST, a.id LIMIT 100", "registry districts scores")
def rank_13(t):
    found = M.match_entities(t.registry, t.districts).join(t.scores.select("nces_id", "total"), "nces_id", "left")
    return found.orderBy(F.desc_nulls_last("total"), "id").limit(100).select("id", "nces_id", "total")


@query("qual_05_by_use", f"{SCORE_SQL.replace('SELECT *, CASE', 'SELECT use, count(*) AS n FROM (SELECT *, CASE', 1)}) q JOIN (VALUES ('outreach', 'B'), ('analysis', 'C'), ('coverage', 'D')) u(use, least) ON q.tier <= u.least GROUP BY use", "districts matches registry")
def qual_05(t):
    v = _view(t)
    least = t.spark.sql("SELECT inline(array(struct('outreach' AS use, 'B' AS least), struct('analysis' AS use, 'C' AS least), struct('coverage' AS use, 'D' AS least)))")
    scored = Q.quality_score(v, Q.quality_flags(v, AS_OF))
    return scored.join(F.broadcast(least), F.col("tier") <= F.col("least")).groupBy("use").agg(F.count("*").alias("n"))


@query("src_03_rejects", "SELECT count(*) AS good, 0::BIGINT AS bad FROM districts", "districts")
def src_03(t):
    path = _folder(t, "positional-csv")
    files.export_csv(t.districts.select("nces_id", "state", "district_name"), path)
    good, bad = files.read_registry(t.spark, path, ["nces_id", "state", "district_name"], {"nces_id": "nces_id"})
    return good.agg(F.count("*").alias("good")).crossJoin(bad.agg(F.count("*").alias("bad")))


@query("src_09_phones", "SELECT nces_id, CASE WHEN phone IS NOT NULL THEN '(304) ' || phone END AS phone FROM districts", "districts")
def src_09(t):
    return t.districts.select("nces_id", files.clean_phone(F.col("phone"), "304").alias("phone"))


@query("str_02_stream_upsert", "SELECT nces_id, max(event_id) AS event_id FROM crawl GROUP BY nces_id", "crawl")
def str_02(t):
    from ..streaming.jobs import latest_table

    arriving = _folder(t, "arriving-crawl")
    t.crawl.select("nces_id", "event_id").repartition(3).write.parquet(arriving)
    stream = t.spark.readStream.schema("nces_id string, event_id long").option("maxFilesPerTrigger", 1).parquet(arriving)
    return latest_table(t.spark, stream, ["nces_id"], "event_id", _folder(t, "latest"))


@query("plan_04_comparison", "SELECT measure, max(v) FILTER (nces_id = '1') AS d1, max(v) FILTER (nces_id = '3') AS d3, max(v) FILTER (nces_id = '5') AS d5 FROM (SELECT nces_id, unnest(['readiness', 'alignment', 'total']) AS measure, unnest([readiness, alignment, total]) AS v FROM scores) WHERE nces_id IN ('1', '3', '5') GROUP BY measure", "scores")
def plan_04(t):
    long = t.scores.where(F.col("nces_id").isin("1", "3", "5")).select("nces_id", F.expr("stack(3, 'readiness', readiness, 'alignment', alignment, 'total', total) AS (measure, v)"))
    return long.groupBy("measure").pivot("nces_id", ["1", "3", "5"]).agg(F.max("v")).toDF("measure", "d1", "d3", "d5")


@query("plan_05_snippets")
def plan_05(t):
    text = F.lower("extracted_text")
    word = F.regexp_extract(text, TAXONOMY[0][2], 0)
    return t.docs.where(word != "").select("doc_id", T.context(text, word, 200).alias("snippet"))


@query("join_09_nearest_theta", f"WITH {NEAR} SELECT count(*) AS n, count(*) FILTER (distance < 0.9) AS near FROM d", "vectors")
def join_09(t):
    return S.with_distance(t.vectors, S.query_vector(t.vectors, 0)).agg(F.count("*").alias("n"), F.count(F.when(F.col("distance") < 0.9, 1)).alias("near"))


@query("join_10_blocked", "SELECT r.state, count(*) AS pairs FROM registry r JOIN districts d ON r.state = d.state AND r.city = d.city GROUP BY r.state", "registry districts")
def join_10(t):
    r = t.registry.groupBy("state", "city").agg(F.count("*").alias("a"))
    d = t.districts.groupBy("state", "city").agg(F.count("*").alias("b"))
    return r.join(d, ["state", "city"]).groupBy("state").agg(F.sum(F.col("a") * F.col("b")).alias("pairs"))


@query("agg_24_site_coverage", "SELECT state, count(*) AS n, count(website_url) AS n_website_url, round(100.0e0 * count(website_url) / count(*), 1) AS p_website_url FROM registry GROUP BY state", "registry")
def agg_24b(t):
    return I.coverage(t.registry, "state", ["website_url"])


@query("doc_05_frontier_size")
def doc_05b(t):
    return D.frontier(D.page_links(t.pages), 3).groupBy("kind").agg(F.count("*").alias("n"))


@query("src_01_scan", "SELECT count(*) AS n, min(o_orderdate) AS first, max(o_orderdate) AS last, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderstatus = 'O'")
def src_01(t):
    return t.orders.where("o_orderstatus = 'O'").agg(F.count("*").alias("n"), F.min("o_orderdate").alias("first"), F.max("o_orderdate").alias("last"), F.round(F.sum("o_totalprice"), 2).alias("total"))


def _raw_csv(t):
    """A source file in its own form: other names, padded and 'N/A' values, every field quoted."""
    path = _folder(t, "source-csv")
    rows = t.registry.select(F.concat(F.lit("  "), "district_name").alias("Institution Name"), F.col("state_district_id").alias("AUN"), F.coalesce("first_name", F.lit("N/A")).alias("Administrator"), F.when(F.col("id") % 5 == 0, "Closed").otherwise("Open").alias("Status"))
    files.export_csv(rows, path, quote_all=True)
    return path, ["Institution Name", "AUN", "Administrator", "Status"]


@query("src_04_mapping", "SELECT state_district_id, lower(district_name) AS name, first_name AS administrator, 'PA' AS state FROM registry", "registry")
def src_04(t):
    path, columns = _raw_csv(t)
    return files.read_registry(t.spark, path, columns, {"state_district_id": "AUN", "name": "lower(`Institution Name`)", "administrator": "Administrator", "state": "'PA'"})[0]


@query("src_05_admission", "SELECT state_district_id FROM registry WHERE id % 5 <> 0 AND first_name IS NOT NULL", "registry")
def src_05(t):
    path, columns = _raw_csv(t)
    return files.read_registry(t.spark, path, columns, {"state_district_id": "AUN"}, (F.col("Status") == "Open") & F.col("Administrator").isNotNull())[0]


@query("src_12_all_quoted", "SELECT count(*) AS n, count(first_name) AS named FROM registry", "registry")
def src_12(t):
    path, columns = _raw_csv(t)
    return files.read_registry(t.spark, path, columns, {"name": "Administrator", "id": "AUN"})[0].agg(F.count("id").alias("n"), F.count("name").alias("named"))


# No SQL: the other engine rounds the number of transpositions down.
@query("match_03_similarity")
def match_03(t):
    return M.similarities(t.registry, t.districts, ["state", "city"])


@query("match_06_exact_id", "SELECT r.id, d.nces_id FROM registry r JOIN districts d ON r.state_district_id = d.nces_id WHERE r.state = d.state", "registry districts")
def match_06(t):
    d = t.districts.select("nces_id", F.col("state").alias("s"))
    return M.match_ids(t.registry, t.districts).join(t.registry.select("id", "state"), "id").join(d, "nces_id").where("state = s").select("id", "nces_id")


@query("topk_01_nearest", f"WITH {NEAR} SELECT vec_id FROM d WHERE vec_id <> 0 ORDER BY d.distance, vec_id LIMIT 20", "vectors")
def topk_01(t):
    return S.vector_search(t.vectors.where("vec_id <> 0"), S.query_vector(t.vectors, 0), None, 20).select("vec_id")


@query("score_01_standard_terms", "SELECT nces_id, 0.0e0 AS total, 'tier3' AS outreach_tier FROM docs WHERE extracted_text IS NOT NULL GROUP BY nces_id", "docs")
def score_01(t):
    from ..operators.terms import TERMS

    return T.score_entities(T.match_taxonomy(t.docs, TERMS, AS_OF), t.docs).select("nces_id", "total", "outreach_tier")


@query("score_06_category", f"WITH {MATCH_SQL}, o AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY nces_id, category, keyword ORDER BY discovered_at, doc_id) = 1) SELECT nces_id, category, round(least(10, 2 * sum(adjusted + CASE WHEN exact THEN 0.2e0 ELSE 0 END)), 6) AS score FROM o GROUP BY ALL", "docs")
def score_06(t):
    once = B.latest_per_key(_matches(t), ["nces_id", "category", "keyword"], [F.col("discovered_at"), F.col("doc_id")])
    worth = F.col("adjusted") + F.when(F.col("exact"), 0.2).otherwise(0.0)
    return once.groupBy("nces_id", "category").agg(F.round(F.least(F.lit(10.0), 2 * F.sum(worth)), 6).alias("score"))


@query("rank_07_cut", "SELECT nces_id, row_number() OVER (ORDER BY c DESC, nces_id)::INTEGER AS place FROM (SELECT nces_id, greatest(0.2e0, least(0.98e0, total / 5)) AS c FROM scores) WHERE c >= 0.35 ORDER BY c DESC, nces_id LIMIT 25", "scores")
def rank_07(t):
    from pyspark.sql import Window

    c = t.scores.select("nces_id", F.greatest(F.lit(0.2), F.least(F.lit(0.98), F.col("total") / 5)).alias("c")).where("c >= 0.35")
    top = c.orderBy(F.desc("c"), "nces_id").limit(25)  # so few that one window may number them
    return top.select("nces_id", F.row_number().over(Window.orderBy(F.desc("c"), "nces_id")).alias("place"))


@query("rank_09_signals", "SELECT nces_id, array_to_string(list_filter([CASE WHEN readiness >= 3 THEN 'readiness' END, CASE WHEN alignment >= 3 THEN 'alignment' END, CASE WHEN activation >= 2 THEN 'activation' END, CASE WHEN documents_analyzed < 2 THEN 'few documents' END], lambda x: x IS NOT NULL), '|') AS signals FROM scores", "scores")
def rank_09(t):
    tests = [(F.col("readiness") >= 3, "readiness"), (F.col("alignment") >= 3, "alignment"), (F.col("activation") >= 2, "activation"), (F.col("documents_analyzed") < 2, "few documents")]
    return t.scores.select("nces_id", F.array_join(F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n in tests])), "|").alias("signals"))
