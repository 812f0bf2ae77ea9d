"""Coverage, score, crawl and search statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TIERS = ("tier1", "tier2", "tier3")
SCORES = ("readiness", "alignment", "activation", "branding", "total")


def percent(part: Column, whole: Column, digits: int = 1) -> Column:
    """Share in percent, rounded; null where the whole is 0."""
    return F.round(F.try_divide(100.0 * part, whole), digits)


def overview(districts: DataFrame, scores: DataFrame, docs: DataFrame) -> DataFrame:
    """One row: districts, coverage of contact fields, documents, mean scores, tier counts."""
    d = districts.agg(
        F.count("*").alias("n"), F.count("superintendent_name").alias("with_name"), F.count("superintendent_email").alias("with_mail"),
        percent(F.count("superintendent_name"), F.count("*")).alias("name_percent"), percent(F.count("superintendent_email"), F.count("*")).alias("mail_percent"),
    )
    s = scores.agg(*[F.round(F.avg(c), 2).alias(f"mean_{c}") for c in SCORES], *[F.count(F.when(F.col("outreach_tier") == t, 1)).alias(t) for t in TIERS])
    return d.crossJoin(s).crossJoin(docs.agg(F.count("*").alias("n_documents")))


def state_stats(districts: DataFrame, scores: DataFrame, docs: DataFrame, mode: str = "corrected") -> DataFrame:
    """Districts, documents, mean total and tier-1 count by state.

    'as_written' joins documents before it averages, so a district counts once
    for each of its documents; 'corrected' counts documents by district first.
    """
    if mode == "as_written":
        j = districts.join(scores, "nces_id", "left").join(docs.select("nces_id", "doc_id"), "nces_id", "left")
        n = F.count("doc_id")
    else:
        per = docs.groupBy("nces_id").agg(F.count("*").alias("_docs"))
        j = districts.join(scores, "nces_id", "left").join(per, "nces_id", "left")
        n = F.coalesce(F.sum("_docs"), F.lit(0))
    return j.groupBy("state").agg(F.count_distinct("nces_id").alias("n_districts"), n.alias("n_documents"), F.round(F.avg("total"), 6).alias("mean_total"), F.count(F.when(F.col("outreach_tier") == "tier1", 1)).alias("tier1"))


def score_stats(scores: DataFrame) -> DataFrame:
    kinds = [f(c).alias(f"{name}_{c}") for c in SCORES for name, f in (("min", F.min), ("max", F.max))]
    return scores.agg(F.count("*").alias("n"), *[F.round(F.avg(c), 6).alias(f"mean_{c}") for c in SCORES], *kinds)


def coverage(df: DataFrame, by: str, columns: list[str]) -> DataFrame:
    """Rows of each group, and the count and percentage of non-null values of the columns."""
    return df.groupBy(by).agg(F.count("*").alias("n"), *[F.count(c).alias(f"n_{c}") for c in columns], *[percent(F.count(c), F.count("*")).alias(f"p_{c}") for c in columns])


def crawl_totals(log: DataFrame) -> DataFrame:
    status = [F.count(F.when(F.col("status") == s, 1)).alias(s) for s in ("success", "failure", "skipped")]
    return log.agg(F.count("*").alias("requests"), F.count_distinct("nces_id").alias("districts"), *status, F.count(F.when(F.col("extraction_success"), 1)).alias("extracted"), F.round(F.avg("response_ms"), 6).alias("mean_ms"))


def success_rates(log: DataFrame, by: str = "url_type") -> DataFrame:
    good = F.count(F.when(F.col("status") == "success", 1))
    return log.groupBy(by).agg(F.count("*").alias("n"), good.alias("good"), percent(good, F.count("*")).alias("rate"))


def most_frequent(df: DataFrame, column: str, k: int = 10) -> DataFrame:
    """The k most frequent non-null values; ties by value."""
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(k)


def exploded_counts(df: DataFrame, column: str) -> DataFrame:
    """How often each element of an array column occurs."""
    return df.select(F.explode(column).alias("value")).groupBy("value").agg(F.count("*").alias("n"))


def corpus_stats(docs: DataFrame) -> DataFrame:
    kinds = [F.count(F.when(F.col("document_type") == t, 1)).alias(t) for t in ("pdf", "html")]
    return docs.agg(F.count("*").alias("n"), F.count_distinct("nces_id").alias("districts"), *kinds, F.sum("text_length").cast("long").alias("characters"), F.round(F.avg("text_length"), 6).alias("mean_length"))


def shares(df: DataFrame, column: str) -> DataFrame:
    """Count of each value and its percentage of all rows."""
    return df.groupBy(column).agg(F.count("*").alias("n")).withColumn("share", percent(F.col("n"), F.sum("n").over(Window.partitionBy()), 2))


def batch_summary(log: DataFrame, k: int = 5) -> DataFrame:
    """The k batches that began last."""
    s = log.groupBy("batch_id").agg(F.min("crawled_at").alias("began"), F.max("crawled_at").alias("ended"), F.count_distinct("nces_id").alias("districts"), F.count("*").alias("requests"))
    return s.orderBy(F.desc("began"), "batch_id").limit(k)


def hourly_progress(log: DataFrame, as_of: str, hours: int = 2) -> DataFrame:
    """Requests by hour and status in the trailing hours before ``as_of``."""
    end = F.lit(as_of).cast("timestamp")
    near = log.where((F.col("crawled_at") > end - F.make_interval(hours=F.lit(hours))) & (F.col("crawled_at") <= end))
    return near.groupBy(F.date_trunc("hour", "crawled_at").alias("hour"), "status").agg(F.count("*").alias("n"), F.count_distinct("nces_id").alias("districts"))


# Ordered signs of each kind of failure in an error text.
FAILURES = [
    ("bad_url", ["Invalid URL"]), ("dns_dead", ["ENOTFOUND"]), ("timeout", ["Timeout"]), ("connection", ["ECONNRESET", "ECONNREFUSED"]),
    ("ssl_error", ["certificate", "EPROTO", "SSL"]), ("rate_limited", ["429"]), ("page_404", ["404"]), ("blocked", ["403"]),
]


def failure_kind(message: Column) -> Column:
    out = F.when(F.lit(False), "")
    for kind, signs in FAILURES:
        hit = F.lit(False)
        for s in signs:
            hit = hit | message.contains(s)
        out = out.when(hit, kind)
    return out.otherwise("other")


def failure_categories(log: DataFrame, docs: DataFrame) -> DataFrame:
    """Distinct districts without documents for each kind of failure."""
    lost = log.where("status = 'failure'").join(docs.select("nces_id"), "nces_id", "left_anti").where("nces_id is not null")
    return lost.groupBy(failure_kind(F.coalesce("error_message", F.lit(""))).alias("category")).agg(F.count_distinct("nces_id").alias("n"))


def telemetry(searches: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """Searches, mean results and distinct normalised prompts of the trailing days (1 to 60)."""
    end = F.lit(as_of).cast("timestamp")
    near = searches.where(F.col("generated_at") >= end - F.make_interval(days=F.lit(min(60, max(1, days)))))
    plain = F.regexp_replace(F.lower(F.trim("prompt")), r"\s+", " ")
    return near.agg(F.count("*").alias("n"), F.round(F.avg("result_count"), 6).alias("mean_results"), F.count_distinct(plain).alias("prompts"), F.count_distinct("user_id").alias("users"))


def top_prompts(searches: DataFrame, as_of: str, days: int = 30, k: int = 15) -> DataFrame:
    """The ``k`` most frequent normalised prompts of the trailing days (1 to 60), with their mean number of results and last use."""
    end = F.lit(as_of).cast("timestamp")
    near = searches.where(F.col("generated_at") >= end - F.make_interval(days=F.lit(min(60, max(1, days)))))
    plain = F.regexp_replace(F.lower(F.trim("prompt")), r"\s+", " ")
    by = near.groupBy(plain.alias("prompt")).agg(F.count("*").alias("n"), F.round(F.avg("result_count"), 6).alias("mean_results"), F.max("generated_at").alias("last_used"))
    return by.orderBy(F.desc("n"), "prompt").limit(k)


def progress_rate(log: DataFrame, districts: DataFrame) -> DataFrame:
    """One row: districts done and left, districts an hour between the first and last request, and the hours that are left at that rate."""
    done = log.where("nces_id is not null").agg(F.count_distinct("nces_id").alias("done"), ((F.unix_micros(F.max("crawled_at").cast("timestamp")) - F.unix_micros(F.min("crawled_at").cast("timestamp"))) / 3.6e9).alias("hours"))
    left = districts.join(log.select("nces_id"), "nces_id", "left_anti").agg(F.count("*").alias("left"))
    rate = F.try_divide(F.col("done").cast("double"), F.col("hours"))
    return done.crossJoin(left).select("done", "left", F.round(rate, 6).alias("per_hour"), F.round(F.try_divide(F.col("left").cast("double"), rate), 6).alias("hours_left"))


def state_leaders(districts: DataFrame, scores: DataFrame, docs: DataFrame, state: str, k: int = 10) -> DataFrame:
    """The state's ``k`` districts of the highest total, with their number of documents."""
    best = districts.where(F.col("state") == state).join(scores.select("nces_id", "total"), "nces_id").orderBy(F.desc("total"), "nces_id").limit(k).select("nces_id", "total")
    return best.join(docs.select("nces_id", "doc_id"), "nces_id", "left").groupBy("nces_id", "total").agg(F.count("doc_id").alias("n_documents"))


def rising(months: DataFrame, least: float = 50.0, k: int = 10) -> DataFrame:
    """Of monthly counts (month, name, n): growth in percent over the month before, where it is above ``least``; the ``k`` highest of each month."""
    w = Window.partitionBy("name").orderBy("month")
    grown = months.withColumn("growth", F.round(F.try_divide(100.0 * (F.col("n") - F.lag("n").over(w)), F.lag("n").over(w)), 2)).where(F.col("growth") > least)
    return grown.withColumn("place", F.row_number().over(Window.partitionBy("month").orderBy(F.desc("growth"), F.desc("n"), "name"))).where(F.col("place") <= k)


def leading_states(districts: DataFrame, scores: DataFrame, k: int = 5) -> DataFrame:
    """For each score category, the ``k`` states of the highest mean: (category, state, mean, place)."""
    names = ("readiness", "alignment", "activation", "branding")
    means = districts.select("nces_id", "state").join(scores, "nces_id").groupBy("state").agg(*[F.round(F.avg(c), 6).alias(c) for c in names])
    long = means.unpivot("state", list(names), "category", "mean")
    return long.withColumn("place", F.row_number().over(Window.partitionBy("category").orderBy(F.desc("mean"), "state"))).where(F.col("place") <= k)


def repeated_entities(searches: DataFrame, k: int = 20) -> DataFrame:
    """The k entities that search results named most."""
    return searches.select(F.explode("top_ids").alias("nces_id")).groupBy("nces_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "nces_id").limit(k)


def momentum(districts: DataFrame, scores: DataFrame, k: int = 3) -> DataFrame:
    """The k states of the highest mean total; states without a score come last."""
    j = districts.join(scores, "nces_id", "left").groupBy("state").agg(F.round(F.avg("total"), 6).alias("mean_total"))
    return j.orderBy(F.desc_nulls_last("mean_total"), "state").limit(k)


def trending(log: DataFrame, k: int = 20) -> DataFrame:
    """The k most frequent (keyword, kind) pairs."""
    return log.select("url_type", F.explode("keywords_found").alias("keyword")).groupBy("keyword", "url_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "keyword", "url_type").limit(k)
