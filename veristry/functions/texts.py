"""Page texts, categories, quality tiers and scores as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns whose first match is kept as a keyword of a document.
DISCOVERY = [
    r"portrait\s+of\s+(a\s+)?graduate", r"graduate\s+profile", r"learner\s+profile",
    r"strategic\s+plan", r"strategic\s+priorities", r"community\s+compass",
    r"measure\s+what\s+matters", r"capstone", r"cornerstone",
]


def page_text(html: Column) -> Column:
    """Text of a page: scripts, styles and comments dropped, tags as spaces, six entities, single spaces."""
    c = html
    for pattern in (r"(?is)<script[^>]*>.*?</script>", r"(?is)<style[^>]*>.*?</style>", r"(?s)<!--.*?-->"):
        c = F.regexp_replace(c, pattern, "")
    c = F.regexp_replace(c, r"<[^>]+>", " ")
    for entity, text in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'")):
        c = F.replace(c, F.lit(entity), F.lit(text))
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def page_title(html: Column) -> Column:
    t = F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>([^<]+)</title>", 1))
    return F.when(t != "", t)


def keywords(text: Column, patterns: list[str] | None = None) -> Column:
    """First match of each pattern in the lower-case text, without repeats."""
    t = F.lower(F.coalesce(text, F.lit("")))
    found = [F.regexp_extract(t, p, 0) for p in (DISCOVERY if patterns is None else patterns)]
    return F.array_distinct(F.filter(F.array(*found), lambda x: x != ""))


def category(url: Column, found: Column, policy: str = "crawl") -> Column:
    """Category of a document by its keywords, then, under 'crawl', by its URL.

    'retry' takes any keyword with 'graduate' and no URL; 'targeted' adds 'learner'.
    """
    has = lambda *words: F.exists(found, lambda k: F.greatest(*[k.contains(w) for w in words], F.lit(False)))
    if policy == "crawl":
        u = F.lower(F.coalesce(url, F.lit("")))
        return (
            F.when(has("portrait", "graduate profile", "learner profile"), "portrait_of_graduate")
            .when(has("strategic"), "strategic_plan")
            .when(u.contains("portrait") | u.contains("graduate"), "portrait_of_graduate")
            .when(u.contains("strategic") | u.contains("plan"), "strategic_plan")
            .otherwise("other")
        )
    words = {"retry": ("portrait", "graduate"), "targeted": ("portrait", "graduate", "learner")}[policy]
    return F.when(has(*words), "portrait_of_graduate").when(has("strategic"), "strategic_plan").otherwise("other")


def recency(seen: Column, as_of: Column) -> Column:
    """1 up to 180 days, 0.8 up to 360 or where unknown, else 0.6."""
    days = (F.unix_timestamp(as_of) - F.unix_timestamp(seen)) / 86400
    return F.when(seen.isNull(), 0.8).when(days <= 180, 1.0).when(days <= 360, 0.8).otherwise(0.6)


def specificity(url: Column, kind: Column) -> Column:
    """1 for planning paths or categories, 0.5 for news, else 0.8."""
    u = F.lower(F.coalesce(url, F.lit("")))
    return (
        F.when(u.rlike("/plan|/strategic|/framework|/portrait|/vision|/graduate"), 1.0)
        .when(kind.isin("portrait_of_graduate", "strategic_plan"), 1.0)
        .when(u.rlike("news|article|press|blog"), 0.5)
        .otherwise(0.8)
    )


def outreach_tier(total: Column, readiness: Column, activation: Column) -> Column:
    return F.when((total >= 5) | (readiness >= 3) | (activation >= 2), "tier1").when((total >= 2) | (readiness >= 1.5), "tier2").otherwise("tier3")


def filled(c: Column) -> Column:
    """Neither null nor blank."""
    return F.coalesce(F.trim(c) != "", F.lit(False))


def presence_tier(site: Column, name: Column, mail: Column) -> Column:
    """A to E by whether web site, name and e-mail are there."""
    return F.when(filled(site) & filled(name) & filled(mail), "A").when(filled(site) & filled(name), "B").when(filled(site), "C").when(filled(name), "D").otherwise("E")


def band(confidence: Column) -> Column:
    return F.when(confidence >= 0.8, "high").when(confidence >= 0.6, "medium").otherwise("low")
