"""Scores of documents and districts against a weighted keyword taxonomy.

A taxonomy is a list of (category, name, pattern, weight, exact).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.patterns import Patterns
from ..functions.texts import outreach_tier, recency, specificity

CATEGORIES = ("readiness", "alignment", "activation", "branding")


def match_taxonomy(docs: DataFrame, taxonomy: list[tuple[str, str, str, float, bool]], as_of: str) -> DataFrame:
    """One row for each document and keyword found: count, base and adjusted weight, context.

    ``docs`` has doc_id, nces_id, extracted_text, document_url,
    document_category, discovered_at and crawled_at.  The text is not
    multiplied: one pass finds which of the patterns' literals it holds, only
    the patterns whose literal occurs are then matched, and the place of a
    keyword is looked for only where it occurs.
    """
    text, known = F.col("_text"), Patterns([p for _, _, p, _, _ in taxonomy])
    count = lambda k, p: F.when(known.may_match(F.col("_found"), k), F.regexp_count(text, F.lit(p))).otherwise(0)
    hits = F.array(*[F.struct(F.lit(c).alias("category"), F.lit(n).alias("keyword"), F.lit(float(w)).alias("weight"), F.lit(bool(e)).alias("exact"), count(k, p).alias("count"), F.lit(p).alias("pattern")) for k, (c, n, p, w, e) in enumerate(taxonomy)])
    factor = recency(F.col("crawled_at"), F.lit(as_of).cast("timestamp")) * specificity(F.col("document_url"), F.col("document_category"))
    rows = docs.where("extracted_text IS NOT NULL").select("doc_id", "nces_id", "discovered_at", F.lower("extracted_text").alias("_text"), factor.alias("_factor"))
    some = rows.withColumn("_found", known.found(text)).where(known.any_may_match(F.col("_found")))
    rows = some.select("*", F.explode(F.filter(hits, lambda x: x["count"] > 0)).alias("m"))
    first = F.expr("regexp_extract(_text, m.pattern, 0)")
    return rows.select("doc_id", "nces_id", "discovered_at", "m.category", "m.keyword", "m.exact", "m.count", "m.weight", (F.col("m.weight") * F.col("_factor")).alias("adjusted"), context(F.col("_text"), first).alias("context"))


def context(text: Column, word: Column, width: int = 50) -> Column:
    """The word's first occurrence with ``width`` characters on either side, spaces collapsed, dots where it is cut."""
    at = F.position(word, text)
    start = F.greatest(F.lit(1), at - width)
    end = F.least(F.length(text), at + F.length(word) - 1 + width)
    body = F.trim(F.regexp_replace(F.substring(text, start, end - start + 1), r"\s+", " "))
    return F.concat(F.when(start > 1, "...").otherwise(""), body, F.when(end < F.length(text), "...").otherwise(""))


def score_entities(matches: DataFrame, docs: DataFrame) -> DataFrame:
    """Category scores, total, tier and documents of each district with a text.

    A keyword counts once for a district, by its first document in order of
    discovery; 0.2 more if exact; a category is twice the sum, 10 at most.
    """
    w = Window.partitionBy("nces_id", "category", "keyword").orderBy("discovered_at", "doc_id")
    once = matches.withColumn("_n", F.row_number().over(w)).where("_n = 1")
    worth = F.col("adjusted") + F.when(F.col("exact"), 0.2).otherwise(0.0)
    sums = once.groupBy("nces_id").agg(*[F.least(F.lit(10.0), 2 * F.coalesce(F.sum(F.when(F.col("category") == c, worth)), F.lit(0.0))).alias(c) for c in CATEGORIES])
    read = docs.where("extracted_text is not null").groupBy("nces_id").agg(F.count("*").cast("int").alias("documents_analyzed"))
    j = read.join(sums, "nces_id", "left").fillna(0.0, list(CATEGORIES))
    j = j.withColumn("total", (F.col("readiness") + F.col("alignment") + F.col("activation") + F.col("branding")) / 4)
    j = j.withColumn("outreach_tier", outreach_tier(F.col("total"), F.col("readiness"), F.col("activation")))
    return j.select("nces_id", *[F.round(c, 4).alias(c) for c in (*CATEGORIES, "total")], "outreach_tier", "documents_analyzed")


def evidence(matches: DataFrame) -> DataFrame:
    """For each district and category: distinct keywords, mentions, documents, and the keywords in order of weight."""
    by = matches.groupBy("nces_id", "category", "keyword").agg(F.sum("count").alias("mentions"), F.max("adjusted").alias("weight"))
    per = by.groupBy("nces_id", "category").agg(F.count("*").alias("keywords"), F.sum("mentions").alias("mentions"), F.sort_array(F.collect_list(F.struct((-F.col("weight")).alias("w"), "keyword"))).alias("_k"))
    documents = matches.groupBy("nces_id", "category").agg(F.count_distinct("doc_id").alias("documents"))
    return per.join(documents, ["nces_id", "category"]).select("nces_id", "category", "keywords", "mentions", "documents", F.array_join(F.transform("_k", lambda x: x["keyword"]), ",").alias("keyword_list"))


def evidence_json(matches: DataFrame) -> DataFrame:
    """(nces_id, evidence): JSON with a list for each category that has any, of each keyword's first document, in order of keywords."""
    first = matches.groupBy("nces_id", "category", "keyword").agg(F.min(F.struct("discovered_at", "doc_id", "weight"))["doc_id"].alias("doc_id"), F.max("weight").alias("weight"))
    lists = first.groupBy("nces_id", "category").agg(F.sort_array(F.collect_list(F.struct("keyword", "weight", F.col("doc_id").alias("source_doc")))).alias("k"))
    return lists.groupBy("nces_id").agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct("category", "k"))))).alias("evidence"))


def excerpts(matches: DataFrame, most: int = 1000) -> DataFrame:
    """(nces_id, category, doc_id, excerpt): contexts of each document in order of weight, appended while there are fewer than ``most`` characters."""
    w = Window.partitionBy("nces_id", "category", "doc_id").orderBy(F.desc("weight"), "keyword").rowsBetween(Window.unboundedPreceding, -1)
    kept = matches.withColumn("_before", F.coalesce(F.sum(F.length("context") + 1).over(w), F.lit(0))).where(F.col("_before") < most)
    per = kept.groupBy("nces_id", "category", "doc_id").agg(F.sort_array(F.collect_list(F.struct("_before", "context"))).alias("_x"))
    return per.select("nces_id", "category", "doc_id", F.array_join(F.transform("_x", lambda x: x["context"]), " ").alias("excerpt"))


def update_scores(scores: DataFrame, updates: DataFrame, columns: list[str]) -> DataFrame:
    """Scores with the non-null values of partial updates, one row for each district."""
    u = updates.select("nces_id", *[F.col(c).alias(f"_{c}") for c in columns])
    j = scores.join(u, "nces_id", "left")
    return j.select([F.coalesce(f"_{c}", c).alias(c) if c in columns else F.col(c) for c in scores.columns])
