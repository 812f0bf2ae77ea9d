"""Vector search over chunks, and ranking of entities by what was found."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.texts import band
from ..functions.vectors import dot, norm

_NEAR = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("distance", pa.float64())])


def with_distance(vectors: DataFrame, query: DataFrame) -> DataFrame:
    """Every vector with its distance from the one query vector (a one-row frame with column q)."""
    one = query.select("q", norm(F.col("q")).alias("_norm")).limit(1)
    n = norm(F.col("embedding")) * F.col("_norm")
    return vectors.crossJoin(F.broadcast(one)).withColumn("distance", F.when(n > 0, 1 - dot(F.col("embedding"), F.col("q")) / n)).drop("q", "_norm")


def query_vector(vectors: DataFrame, vec_id: int) -> DataFrame:
    return vectors.where(F.col("vec_id") == vec_id).select(F.col("embedding").alias("q")).limit(1)


def vector_search(vectors: DataFrame, query: DataFrame, threshold: float | None = 0.5, k: int = 20) -> DataFrame:
    """The k nearest vectors below the threshold, with relevance 1 - distance / 2; ties by vec_id."""
    d = with_distance(vectors, query)
    d = d.where(F.col("distance") < threshold) if threshold is not None else d.where("distance is not null")
    return d.orderBy("distance", "vec_id").limit(k).withColumn("relevance", 1 - F.col("distance") / 2)


def filter_chunks(vectors: DataFrame, docs: DataFrame, districts: DataFrame, *, state: str | None = None, types: list[str] | None = None, since: str | None = None, until: str | None = None) -> DataFrame:
    """Vectors of documents of the given kinds, discovered in the days from ``since`` to ``until``, of districts of the state.

    A filter that isn't given keeps all; the filters come before any distance is taken.
    """
    d = docs.where(F.col("document_category").isin(types)) if types else docs
    d = d.where(F.col("discovered_at") >= F.lit(since).cast("timestamp")) if since else d
    d = d.where(F.col("discovered_at") < F.lit(until).cast("timestamp") + F.make_interval(days=F.lit(1))) if until else d
    if state:
        d = d.join(districts.where(F.col("state") == state).select("nces_id"), "nces_id", "left_semi")
    return vectors.join(d.select("doc_id"), "doc_id", "left_semi") if types or since or until or state else vectors


def similar_documents(vectors: DataFrame, doc_id: int, threshold: float = 0.7, k: int = 20, best: bool = True) -> DataFrame:
    """Other documents near the first chunk of one; with ``best`` once each by their nearest chunk, else once for each chunk."""
    source = vectors.where(F.col("doc_id") == doc_id).orderBy("chunk_index", "vec_id").limit(1).select(F.col("embedding").alias("q"))
    d = with_distance(vectors.where(F.col("doc_id") != doc_id), source).where(F.col("distance") < threshold)
    rows = d.groupBy("doc_id").agg(F.min("distance").alias("distance")) if best else d.select("doc_id", "distance").distinct()
    return rows.orderBy("distance", "doc_id").limit(k)


def _nearest(k: int):
    """A block of vectors and one of queries -> each query's k nearest vectors of the block, all ties at the last place included."""

    def run(left, right):
        if not left.num_rows or not right.num_rows:
            return _NEAR.empty_table()
        ids, asked = left.column("vec_id").to_numpy(), right.column("query_id").to_numpy()
        x, y = (t.column("e").combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1) for t in (left, right))
        size_x, size_y = (np.sqrt(np.einsum("ij,ij->i", e, e)) for e in (x, y))
        unit, out = x / size_x[:, None], []
        for at in range(0, len(y), 128):
            near = (y[at : at + 128] / size_y[at : at + 128, None]) @ unit.T
            near[asked[at : at + 128, None] == ids] = -np.inf
            floor = np.partition(near, -k, 1)[:, -k] if k < len(x) else np.full(len(near), -2.0)
            i, j = np.nonzero(near >= np.maximum(floor, -2.0)[:, None] - 1e-9)
            i = i + at
            # products of equal vectors may differ by their place in a matrix product, not here
            distance = np.concatenate([np.empty(0), *(1 - np.einsum("ij,ij->i", x[j[s : s + 65536]], y[i[s : s + 65536]]) / (size_x[j[s : s + 65536]] * size_y[i[s : s + 65536]]) for s in range(0, len(i), 65536))])
            order = np.lexsort((ids[j], distance, i))
            i, j, distance = i[order], j[order], distance[order]
            kept = np.arange(len(i)) - np.searchsorted(i, i) < k
            out.append(pa.table([asked[i[kept]], ids[j[kept]], distance[kept]], schema=_NEAR))
        return pa.concat_tables(out)

    return run


def search_many(vectors: DataFrame, queries: DataFrame, k: int = 10, within: tuple[str, ...] = ()) -> DataFrame:
    """The k nearest other vectors of each query (query_id, q), of those that are equal in the columns ``within``; ties by vec_id.

    Both sides are cut into blocks of bounded size.  Each pair of blocks gives
    its nearest, which are merged.
    """
    spark = vectors.sparkSession
    usable = lambda c: (F.size(c) > 0) & F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x)) & F.exists(c, lambda x: x != 0)
    rows, asked = vectors.count(), queries.select("query_id").distinct().count()
    n_v = max(1, -(-rows // 65_536), min(int(spark.conf.get("spark.sql.shuffle.partitions")), rows // 2048))
    n_q = max(1, -(-asked // 16_384))
    part = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    v = vectors.where(usable("embedding")).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e"), F.size("embedding").alias("dim"), part("vec_id", n_v).alias("v_block"), every(n_q).alias("q_block"), *within)
    q = queries.where(usable("q")).select(F.col("query_id").cast("long").alias("query_id"), F.col("q").cast("array<double>").alias("e"), F.size("q").alias("dim"), every(n_v).alias("v_block"), part("query_id", n_q).alias("q_block"), *within)
    keys = ["dim", "v_block", "q_block", *within]
    near = v.groupBy(*keys).cogroup(q.groupBy(*keys)).applyInArrow(_nearest(k), "query_id long, vec_id long, distance double")
    w = Window.partitionBy("query_id").orderBy("distance", "vec_id")
    return near.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k).select("query_id", "place", "vec_id", "distance")


def entity_relevance(vectors: DataFrame, query: DataFrame, k: int = 500, floor: float = 0.25, entity: str = "nces_id") -> DataFrame:
    """Of the k nearest chunks above the similarity floor: largest and mean similarity and hits of each entity."""
    near = with_distance(vectors, query).withColumn("similarity", 1 - F.col("distance")).where(F.col("similarity") > floor)
    near = near.orderBy(F.desc("similarity"), "vec_id").limit(k)
    return near.groupBy(entity).agg(F.max("similarity").alias("top"), F.avg("similarity").alias("mean"), F.count("*").alias("hits"))


def composite(top: Column, mean: Column, hits: Column, total: Column, boost: Column | float = 0.0) -> Column:
    """6 top + 2 mean + up to 1.5 for the hits' logarithm + half the score + boosts; not below 0."""
    boost = F.lit(boost) if isinstance(boost, float) else boost
    return F.greatest(F.lit(0.0), 6 * top + 2 * mean + F.least(F.lit(1.5), F.log10(hits + 1)) + 0.5 * F.coalesce(total, F.lit(0.0)) + boost)


def confidence(score: Column, mean: Column) -> Column:
    return F.greatest(F.lit(0.2), F.least(F.lit(0.98), (score + 2 * mean) / 12))


def rank_candidates(relevance: DataFrame, scores: DataFrame, *, threshold: float = 0.6, k: int = 25, entity: str = "nces_id") -> DataFrame:
    """Entities with composite, confidence and band; those from max(0.2, threshold - 0.25) on, best first, k at most."""
    s = scores.select(entity, "total")
    j = relevance.join(s, entity, "left").withColumn("composite", composite(F.col("top"), F.col("mean"), F.col("hits"), F.col("total")))
    j = j.withColumn("confidence", confidence(F.col("composite"), F.col("mean"))).withColumn("band", band(F.col("confidence")))
    return j.where(F.col("confidence") >= max(0.2, threshold - 0.25)).orderBy(F.desc("composite"), entity).limit(k)


def suppress(candidates: DataFrame, events: DataFrame, as_of: str, days: int = 60, entity: str = "nces_id", exclude: DataFrame | None = None) -> DataFrame:
    """Candidates without an engagement in the trailing days, and not among those to exclude."""
    end = F.lit(as_of).cast("timestamp")
    recent = events.where(F.col("happened_at") >= end - F.make_interval(days=F.lit(days))).select(entity).distinct()
    recent = recent if exclude is None else recent.union(exclude.select(entity)).distinct()
    return candidates.join(recent, entity, "left_anti")


def classify_intent(prompt: Column) -> Column:
    """Kind of request by words in the prompt; insights before grants before leads."""
    p = F.lower(prompt)
    has = lambda *words: p.rlike("|".join(words))
    return F.when(has("trend", "brief", "insight", "state overview"), "insights_briefing").when(has("grant", "frpl", "minority"), "grant_match").when(has("next hottest", "uncontacted", "lead"), "next_hottest_uncontacted").otherwise("district_search")


# Phrases that a grant prompt may require, and capitals that are no state.
GRANT_PHRASES = ["portrait of a graduate", "measure what matters", "performance tasks", "competency", "strategic plan"]
NO_STATES = ["AI", "US"]


def grant_terms(prompt: Column) -> dict[str, Column]:
    """States (codes of two capitals) and required phrases that a prompt names; null where it names none."""
    states = F.array_distinct(F.filter(F.regexp_extract_all(prompt, F.lit(r"\b[A-Z]{2}\b"), F.lit(0)), lambda x: ~x.isin(NO_STATES)))
    phrases = F.array_compact(F.array(*[F.when(F.lower(prompt).contains(p), F.lit(p)) for p in GRANT_PHRASES]))
    some = lambda x: F.when(F.size(x) > 0, x)
    return {"states": some(states), "required_keywords": some(phrases)}


def with_override(criteria: dict[str, Column], given: dict[str, Column]) -> dict[str, Column]:
    """Criteria of a prompt, replaced by those given explicitly where these aren't null."""
    return {name: F.coalesce(given[name], c) if name in given else c for name, c in criteria.items()} | {name: c for name, c in given.items() if name not in criteria}


def search_log(searches: DataFrame, k: int = 25, days: int = 60) -> DataFrame:
    """Log rows of searches: trimmed prompt, intent, suppression days by default, number of results, and the first ``k`` ids."""
    ids = F.filter("top_ids", lambda x: x.isNotNull() & (x != ""))
    return searches.select("id", "user_id", F.trim("prompt").alias("prompt"), classify_intent(F.col("prompt")).alias("intent"), F.lit(days).alias("suppression_days"), F.size(ids).alias("result_count"), F.slice(ids, 1, k).alias("top_ids"), "generated_at")


def explain(candidates: DataFrame, matches: DataFrame, threshold: float, k: int = 3, entity: str = "nces_id") -> DataFrame:
    """Signals, excerpts and dampeners of ranked entities (with top, hits, readiness, activation, total, confidence).

    Excerpts are the first match of each category, ``k`` at most, in the order
    of categories; a confidence below the threshold is dampened.
    """
    first = matches.groupBy(entity, "category").agg(F.min(F.struct(-F.col("adjusted"), "doc_id", "keyword", "context")).alias("m"))
    found = first.groupBy(entity).agg(F.slice(F.sort_array(F.collect_list(F.struct("category", "m.doc_id", "m.keyword", "m.context"))), 1, k).alias("excerpts"))
    signal = lambda name, category, c: F.struct(F.lit(name).alias("signal"), F.lit(category).alias("category"), F.coalesce(F.col(c), F.lit(0.0)).alias("weight"))
    signals = F.array(signal("semantic_max", "semantic", "top"), signal("readiness_score", "readiness", "readiness"), signal("activation_score", "activation", "activation"), signal("total_score", "semantic", "total"))
    dampeners = F.when(F.col("confidence") < threshold, F.array(F.struct(F.lit("low_confidence").alias("signal"), F.lit(-0.2).alias("impact")))).otherwise(F.array().cast("array<struct<signal:string,impact:double>>"))
    return candidates.join(found, entity, "left").select(entity, signals.alias("signals"), F.coalesce("excerpts", F.array().cast("array<struct<category:string,doc_id:bigint,keyword:string,context:string>>")).alias("excerpts"), dampeners.alias("dampeners"))


def grant_criteria(prompt: Column, mode: str = "intended") -> dict[str, Column]:
    """Thresholds in a prompt: frpl_min, minority_min, enrollment_min; 'as_written' finds none of them in ordinary text."""
    p = F.lower(prompt)
    number = lambda pattern: F.nullif(F.regexp_extract(p, pattern, 1), F.lit("")).cast("int")
    if mode == "as_written":
        none = F.lit(None).cast("int")
        return {"frpl_min": none, "minority_min": none, "enrollment_min": none}
    share = lambda words: F.least(F.lit(100), number(rf"(?:{words})[^\d]{{0,20}}(\d{{1,3}})\s*%?"))
    return {
        "frpl_min": F.when(number(r"(?:frpl|free[\s-]reduced[\s-]lunch)[^\d]{0,20}(\d{1,3})").isNotNull(), share(r"frpl|free[\s-]reduced[\s-]lunch")),
        "minority_min": F.when(number(r"minority[^\d]{0,20}(\d{1,3})").isNotNull(), share("minority")),
        "enrollment_min": number(r"(?:enrollment|students)[^\d]{0,20}(?:>=|over|above|at least)\s*(\d{2,7})"),
    }


def funnel(df: DataFrame, stages: dict[str, Column]) -> DataFrame:
    """How many rows pass all conditions up to each stage, in one pass."""
    passed, out = F.lit(True), []
    for name, condition in stages.items():
        passed = passed & F.coalesce(condition, F.lit(False))
        out.append(F.count(F.when(passed, 1)).alias(name))
    return df.agg(F.count("*").alias("all"), *out)


def why(candidates: DataFrame, evidence: DataFrame, entity: str = "nces_id") -> DataFrame:
    """Summary sentence of each ranked entity: strong categories (3 and more), similarity in words, first three keywords.

    ``candidates`` has top and the four category scores; ``evidence`` has
    category and keyword_list for each entity.
    """
    names = ("readiness", "alignment", "activation", "branding")
    strong = F.array_compact(F.array(*[F.when(F.col(c) >= 3.0, F.lit(c)) for c in names]))
    words = evidence.groupBy(entity).agg(F.sort_array(F.collect_list(F.struct("category", "keyword_list"))).alias("_e"))
    split = F.flatten(F.transform("_e", lambda x: F.split(x["keyword_list"], ",")))
    j = candidates.join(words, entity, "left").withColumn("_k", F.slice(F.array_distinct(F.coalesce(split, F.array().cast("array<string>"))), 1, 3))
    near = F.when(F.col("top") >= 0.7, "strong semantic match").when(F.col("top") >= 0.5, "moderate semantic match").otherwise("weak semantic match")
    parts = F.array_compact(F.array(F.when(F.size(strong) > 0, F.concat(F.lit("strong in "), F.array_join(strong, ", "))), near, F.when(F.size("_k") > 0, F.concat(F.lit("keywords: "), F.array_join("_k", ", ")))))
    return j.select(entity, F.array_join(parts, "; ").alias("summary"))
