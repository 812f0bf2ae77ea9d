"""Filters, lookups, paging and per-key picks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Codes of each locale type.
LOCALES = {"city": ["11", "12", "13"], "suburb": ["21", "22", "23"], "town": ["31", "32", "33"], "rural": ["41", "42", "43"]}


def filter_entities(df: DataFrame, *, states=None, tiers=None, locales=None, minimum=None, maximum=None) -> DataFrame:
    """Conjunction of the filters that are given; a null never passes one.

    ``minimum`` and ``maximum`` map numeric columns to inclusive bounds.
    """
    if states:
        df = df.where(F.col("state").isin(states))
    if tiers:
        df = df.where(F.col("outreach_tier").isin(tiers))
    if locales:
        df = df.where(F.col("locale_code").isin([c for x in locales for c in LOCALES[x]]))
    for column, bound in (minimum or {}).items():
        df = df.where(F.col(column) >= bound)
    for column, bound in (maximum or {}).items():
        df = df.where(F.col(column) <= bound)
    return df


def with_contact(districts: DataFrame, registry: DataFrame, wanted: bool = True) -> DataFrame:
    """Districts that have, or have not, a registry row with a name or an e-mail."""
    known = registry.where(F.col("last_name").isNotNull() | F.col("email").isNotNull()).select(F.col("state_district_id").alias("nces_id"))
    return districts.join(known, "nces_id", "left_semi" if wanted else "left_anti")


def search_names(districts: DataFrame, registry: DataFrame, term: str) -> DataFrame:
    """Districts whose name, or one of whose registry names or administrators, contains the term in any case."""
    hit = registry.where(F.col("district_name").ilike(f"%{term}%") | F.concat_ws(" ", "first_name", "last_name").ilike(f"%{term}%"))
    flags = hit.select(F.col("state_district_id").alias("nces_id"), F.lit(True).alias("_hit")).distinct()
    return districts.join(flags, "nces_id", "left").where(F.col("_hit").isNotNull() | F.col("district_name").ilike(f"%{term}%")).drop("_hit")


def overlay(base: DataFrame, registry: DataFrame, texts: dict[str, str], numbers: dict[str, str], key: str = "nces_id") -> DataFrame:
    """base with registry values on top: a text counts unless null or empty, a number unless null.

    The dictionaries map base columns to registry columns; registry has one row for each key.
    """
    r = registry.select(F.col(key).alias("_key"), *[F.col(v).alias(f"_r_{k}") for k, v in (texts | numbers).items()])
    joined = base.join(r, base[key] == r["_key"], "left")
    kept = [F.coalesce(F.nullif(F.col(f"_r_{c}"), F.lit("")), c).alias(c) if c in texts else F.coalesce(f"_r_{c}", c).alias(c) if c in numbers else F.col(c) for c in base.columns]
    return joined.select(kept)


def keyword_search(docs: DataFrame, term: str, kinds: list[str] | None = None, limit: int = 20) -> DataFrame:
    """Documents that contain the term; title hits first, then by title and id; text cut to a 500-character preview."""
    hits = docs.where(F.col("extracted_text").ilike(f"%{term}%"))
    if kinds:
        hits = hits.where(F.col("document_type").isin(kinds))
    first = F.when(F.col("title").ilike(f"%{term}%"), 1).otherwise(2)
    return hits.orderBy(first, "title", "doc_id").limit(limit).select("doc_id", "title", F.substring("extracted_text", 1, 500).alias("preview"), first.alias("place"))


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """One page of an ordered list, with the total and whether more follows; the order must be total."""
    total = df.agg(F.count("*").alias("total"))
    return df.orderBy(*order).offset(offset).limit(limit).crossJoin(F.broadcast(total)).withColumn("has_more", F.col("total") > offset + limit)


def seek(df: DataFrame, order: list[tuple[str, bool]], limit: int, after: dict | None = None) -> DataFrame:
    """The ``limit`` rows that follow a place in a total order, without sorting what lies before it.

    ``order`` names columns, each with True for descending; nulls come last
    either way.  ``after`` holds the values of these columns in the last row
    that was seen (see ``cursor``), None for the first page.  The place becomes a
    range filter, whose first bound a scan can use to pass over files; rows with
    equal values in all columns of ``order`` are not told apart.
    """
    if after is not None:
        later, equal = F.lit(False), F.lit(True)
        for name, down in order:
            c, v = F.col(f"`{name}`"), after[name]
            value = F.lit(v).cast(df.schema[name].dataType)
            if v is not None:
                later = later | (equal & (((c < value) if down else (c > value)) | c.isNull()))
            equal = equal & c.eqNullSafe(value)
        name, down = order[0]
        c, v = F.col(f"`{name}`"), after[name]
        first = c.isNull() if v is None else ((c <= F.lit(v)) if down else (c >= F.lit(v))) | c.isNull()
        df = df.where(first & later)
    return df.orderBy(*[F.desc_nulls_last(n) if down else F.asc_nulls_last(n) for n, down in order]).limit(limit)


def cursor(rows: list, order: list[tuple[str, bool]]) -> dict | None:
    """Where the next page begins, from the rows of a collected page; None after an empty one."""
    return {n: rows[-1][n] for n, _ in order} if rows else None


def latest_per_key(df: DataFrame, keys: list[str], order: list[Column], k: int = 1) -> DataFrame:
    """The first k rows of each key in a total order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= k).drop("_n")


def not_in(df: DataFrame, column: str, others: DataFrame) -> DataFrame:
    """SQL's NOT IN: nothing if the set holds a null, no null keys unless the set is empty.

    ``others`` has one column.
    """
    name = others.columns[0]
    facts = others.agg(F.count("*").alias("_all"), F.count(name).alias("_some"))
    rest = df.join(others.select(F.col(name).alias(column)).distinct(), column, "left_anti").crossJoin(F.broadcast(facts))
    return rest.where((F.col("_all") == 0) | ((F.col("_all") == F.col("_some")) & F.col(column).isNotNull())).drop("_all", "_some")
