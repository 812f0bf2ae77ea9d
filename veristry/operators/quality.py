"""Data quality: flags, scores and trust tiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.texts import filled
from ..functions.urls import domain, mail_domain

# Severity of each flag.
SEVERITY = {
    "MISSING_SUPT_NAME": "high", "MISSING_EMAIL": "medium", "MISSING_PHONE": "medium", "MISSING_WEBSITE": "low",
    "NAME_MISMATCH": "medium", "ENROLLMENT_MISMATCH": "low", "STATE_DATA_STALE": "medium",
}


def quality_flags(view: DataFrame, as_of: str, months: int = 6) -> DataFrame:
    """One row for each problem of a district: (nces_id, flag, severity).

    ``view`` has the contact fields of districts, and where a registry row is
    matched registry_name, registry_enrollment and imported_at; enrollments
    conflict beyond 20 % of the baseline's.
    """
    old = F.col("imported_at") < F.add_months(F.lit(as_of).cast("timestamp"), -months)
    gap = F.abs(F.col("registry_enrollment") - F.col("enrollment")) > 0.2 * F.col("enrollment")
    tests = {
        "MISSING_SUPT_NAME": ~filled(F.col("superintendent_name")), "MISSING_EMAIL": ~filled(F.col("superintendent_email")), "MISSING_PHONE": ~filled(F.col("phone")), "MISSING_WEBSITE": ~filled(F.col("website_url")),
        "NAME_MISMATCH": F.lower("registry_name") != F.lower("district_name"), "ENROLLMENT_MISMATCH": gap, "STATE_DATA_STALE": old,
    }
    rows = F.array_compact(F.array(*[F.when(t, F.struct(F.lit(n).alias("flag"), F.lit(SEVERITY[n]).alias("severity"))) for n, t in tests.items()]))
    return view.select("nces_id", F.explode(rows).alias("f")).select("nces_id", "f.flag", "f.severity")


def match_flags(districts: DataFrame, registry: DataFrame, matches: DataFrame) -> DataFrame:
    """(key, flag, severity): districts with several registry rows, and registry rows without a district or with one that isn't there."""
    m = matches.select("nces_id", "registry_id").distinct()
    twice = m.groupBy("nces_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("nces_id").alias("key"), F.lit("DUPLICATE_MATCH").alias("flag"), F.lit("high").alias("severity"))
    known = m.join(districts.select("nces_id"), "nces_id", "left_semi").select(F.col("registry_id").alias("id"))
    orphans = registry.select("id").join(known, "id", "left_anti").select(F.col("id").cast("string").alias("key"), F.lit("ORPHAN_RECORD").alias("flag"), F.lit("medium").alias("severity"))
    return twice.unionByName(orphans)


def quality_score(view: DataFrame, flags: DataFrame) -> DataFrame:
    """Score 0 to 100 and tier A to E: 40, more for a confident match and each contact field, less for each flag."""
    n = flags.groupBy("nces_id").agg(F.count(F.when(F.col("severity") == "high", 1)).alias("high"), F.count(F.when(F.col("severity") == "medium", 1)).alias("medium"))
    j = view.join(n, "nces_id", "left").fillna(0, ["high", "medium"])
    c = F.col("confidence")
    points = F.lit(40) + F.when(c >= 0.90, 20).when(c >= 0.80, 15).when(c >= 0.70, 10).otherwise(0)
    for field, worth in (("superintendent_name", 15), ("superintendent_email", 10), ("phone", 5), ("website_url", 5)):
        points = points + F.when(F.col(field).isNotNull(), worth).otherwise(0)
    points = points + F.when(F.col("verified"), 10).otherwise(0) - 10 * F.col("high") - 5 * F.col("medium")
    score = F.greatest(F.lit(0), F.least(F.lit(100), points)).cast("int")
    tier = F.when(F.col("score") >= 90, "A").when(F.col("score") >= 75, "B").when(F.col("score") >= 60, "C").when(F.col("score") >= 40, "D").otherwise("E")
    return j.select("nces_id", score.alias("score")).withColumn("tier", tier)


def trust_tier(view: DataFrame) -> DataFrame:
    """Tier A to E by match confidence, verification and contact fields; D is a district without a match."""
    c, name, mail, phone, site = F.col("confidence"), filled(F.col("superintendent_name")), filled(F.col("superintendent_email")), filled(F.col("phone")), filled(F.col("website_url"))
    sure = F.coalesce(F.col("verified"), F.lit(False)) | (c >= 1.0)
    tier = F.when(c.isNull(), "D").when((c >= 0.95) & name & (mail | phone) & site & sure, "A").when((c >= 0.85) & name & (phone | site), "B").when(c >= 0.70, "C").otherwise("E")
    return view.select("nces_id", tier.alias("tier"))


def mail_agrees(view: DataFrame) -> DataFrame:
    """Whether an e-mail is well formed, and whether its domain is the web site's or ends with it."""
    mail, site = mail_domain(F.col("superintendent_email")), domain(F.col("website_url"))
    valid = F.coalesce(F.col("superintendent_email").rlike(r"^[^@\s]+@[^@\s]+\.[^@\s]+$"), F.lit(False))
    return view.select("nces_id", valid.alias("valid"), F.coalesce((mail == site) | mail.endswith(F.concat(F.lit("."), site)), F.lit(False)).alias("agrees"))
