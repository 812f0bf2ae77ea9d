"""An index for vector search that grows with its table.

Vectors are dealt into about the square root of their number of lists, by the
nearest of as many centres.  The centres lie in two levels, so a vector is
compared with about twice the square root of the lists, not with all.  A list
is a partition of the written table: a search reads the lists near its queries
and no other file.  Of these it first reads codes of four bits a dimension; the
whole vectors are fetched for the best few only.  How many lists a search reads
follows from the recall measured on a sample of the indexed vectors against all
of them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.vectors import cosine_distance
from .search import _nearest, search_many

#: Bytes that the centres, which every task holds, may have.
CENTRE_BYTES = 64 << 20
#: Rows of a list, and queries of one, that one task compares.
BLOCK_ROWS, BLOCK_QUERIES = 65_536, 8_192
_NEAR = pa.schema([("query_id", pa.int64()), ("list", pa.int32()), ("vec_id", pa.int64()), ("near", pa.float32())])


def usable(c: str) -> Column:
    """Neither null nor empty nor zero, and all components finite."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.coalesce((F.size(c) > 0) & ~F.exists(c, bad) & F.exists(c, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float32)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x, dtype=np.float64))[:, None].astype(np.float32)


def _centres(x: np.ndarray, k: int, seed: int, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Directions of ``k`` clusters of unit vectors, and each vector's cluster; an empty cluster takes the vector that fits its own least."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = x @ c.T
        own = near.argmax(1)
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        empty = np.flatnonzero(np.bincount(own, minlength=len(c)) == 0)
        if len(empty):
            total[empty] = x[np.argsort(near[np.arange(len(x)), own])[: len(empty)]]
        c = total / np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1e-12)
    return c, (x @ c.T).argmax(1)


@dataclass
class Centres:
    """Both levels: list i lies below the coarse centre ``parent[i]``."""

    coarse: np.ndarray
    fine: np.ndarray
    parent: np.ndarray

    def assign(self, x: np.ndarray) -> np.ndarray:
        """Of each vector its list: the nearest below its nearest coarse centre."""
        top, out = (x @ self.coarse.T).argmax(1), np.zeros(len(x), np.int32)
        for g in np.unique(top):
            own, below = np.flatnonzero(top == g), np.flatnonzero(self.parent == g)
            out[own] = below[(x[own] @ self.fine[below].T).argmax(1)]
        return out

    def order(self, x: np.ndarray, most: int) -> np.ndarray:
        """The ``most`` lists nearest to each vector, nearest first."""
        return np.argsort(-(x @ self.fine.T), axis=1, kind="stable")[:, :most].astype(np.int32)


def fit_centres(sample: np.ndarray, lists: int, seed: int) -> Centres:
    """Coarse centres of the sample, and below each a share of the lists by its number of vectors."""
    coarse, own = _centres(sample, max(1, round(lists**0.5)), seed)
    fine, parent = [], []
    for g in range(len(coarse)):
        x = sample[own == g]
        share = max(1, round(lists * len(x) / len(sample)))
        c = _centres(x, share, seed + g)[0] if len(x) else coarse[g : g + 1]
        fine.append(c)
        parent += [g] * len(c)
    return Centres(coarse, np.concatenate(fine), np.array(parent))


def encode(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors as four bits a dimension, two to a byte, and each vector's scale."""
    scale = np.maximum(np.abs(x).max(1), 1e-12) / 7
    q = np.rint(x / scale[:, None]).astype(np.int8) + 8
    q = np.pad(q, ((0, 0), (0, q.shape[1] % 2)), constant_values=8).astype(np.uint8)
    return q[:, ::2] << 4 | q[:, 1::2], scale.astype(np.float32)


def decode(codes: np.ndarray, scale: np.ndarray, dim: int) -> np.ndarray:
    out = np.empty((len(codes), 2 * codes.shape[1]), np.float32)
    out[:, ::2], out[:, 1::2] = codes >> 4, codes & 15
    return (out[:, :dim] - 8) * scale[:, None]


def _assigner(centres: Centres):
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(1))
            codes, scale = encode(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(centres.assign(x)), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(scale), batch.column(1)], names=["vec_id", "list", "code", "scale", "embedding"])

    return run


@dataclass
class VectorIndex:
    """A written index: the table of vectors by list, and what the driver keeps of it."""

    spark: SparkSession
    path: str
    centres: Centres
    dim: int
    sizes: dict[int, int]
    probes: int

    def rows(self, lists: list[int] | None = None) -> DataFrame:
        """(vec_id, code, scale, embedding, list) of the given lists, whose files alone are read."""
        out = self.spark.read.schema("vec_id long, code binary, scale float, embedding array<double>, list int").parquet(f"{self.path}/rows")
        return out if lists is None else out.where(F.col("list").isin(lists))


def build_index(vectors: DataFrame, path: str, *, lists: int | None = None, most_sample: int = 20_000, target: float = 0.96, k: int = 20, seed: int = 1) -> VectorIndex:
    """Writes the index of ``vectors`` (vec_id integer, embedding) below ``path``.

    All vectors of the most frequent dimension are indexed; those that are null,
    empty, zero or not finite have no direction and are left out, as are those
    of other dimensions.  Repeated rows are indexed each.  Centres are fit on
    about ``most_sample`` vectors, chosen by a hash of vec_id.  The number of
    lists that a search reads is the least with which the sampled vectors find
    ``target`` of their ``k`` nearest among all.  An empty table gives an index
    that finds nothing.
    """
    spark = vectors.sparkSession
    v = vectors.where(usable("embedding")).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    dims = v.groupBy(F.size("embedding").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    dim, n = (dims["dim"], dims["count"]) if dims else (1, 0)
    v = v.where(F.size("embedding") == dim)
    hashed = lambda most: v.where(F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(max(n, 1))) < most)
    found = hashed(most_sample).select("embedding").toArrow() if n else None
    sample = _matrix(found["embedding"]) if found is not None and found.num_rows else np.eye(1, dim, dtype=np.float32)
    lists = lists or max(1, min(round(n**0.5), CENTRE_BYTES // (4 * dim)))
    centres = fit_centres(sample, min(lists, len(sample)), seed)
    dealt = v.mapInArrow(_assigner(centres), "vec_id long, list int, code binary, scale float, embedding array<double>")
    # a list's rows meet in few files; Spark cuts a list that is too large for one
    spark.sql("SELECT /*+ REBALANCE(list) */ * FROM {dealt}", dealt=dealt).write.partitionBy("list").parquet(f"{path}/rows")
    index = VectorIndex(spark, path, centres, dim, {}, len(centres.fine))
    index.sizes = {r["list"]: r["count"] for r in index.rows().groupBy("list").count().collect()}
    index.probes = _probes(index, index.rows().where(F.pmod(F.xxhash64("vec_id", F.lit(seed + 1)), F.lit(max(n, 1))) < 200), k, target) if n else 1
    centre = lambda level, i, c, parent: (level, i, [float(y) for y in c], parent)
    kept = [centre("coarse", i, c, None) for i, c in enumerate(centres.coarse)] + [centre("fine", i, c, int(p)) for i, (c, p) in enumerate(zip(centres.fine, centres.parent, strict=True))]
    spark.createDataFrame([*kept, ("probes", index.probes, None, None)], "level string, i int, centre array<double>, parent int").coalesce(1).write.parquet(f"{path}/centres")
    return index


def open_index(spark: SparkSession, path: str) -> VectorIndex:
    """An index that ``build_index`` has written."""
    rows = sorted(spark.read.parquet(f"{path}/centres").collect(), key=lambda r: (r["level"], r["i"]))
    of = lambda level: [r for r in rows if r["level"] == level]
    get = lambda level: np.array([r["centre"] for r in of(level)], np.float32)
    index = VectorIndex(spark, path, Centres(get("coarse"), get("fine"), np.array([r["parent"] for r in of("fine")])), len(of("fine")[0]["centre"]), {}, of("probes")[0]["i"])
    index.sizes = {r["list"]: r["count"] for r in index.rows().groupBy("list").count().collect()}
    return index


def _probes(index: VectorIndex, asked: DataFrame, k: int, target: float) -> int:
    """How many lists have to be read for ``target`` of the k nearest of the ``asked`` vectors, by a search of all."""
    asked = asked.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    near = search_many(index.rows(), asked, k).join(index.rows().select("vec_id", "list"), "vec_id").select("query_id", "list").toPandas()
    queries = asked.toArrow()
    order = index.centres.order(_matrix(queries["q"]), len(index.centres.fine))
    place = {q: np.argsort(o) for q, o in zip(queries["query_id"].to_pylist(), order, strict=True)}
    at = np.sort([place[q][i] for q, i in zip(near["query_id"], near["list"], strict=True)])
    return int(at[min(len(at) - 1, int(np.ceil(target * len(at))))]) + 1 if len(at) else 1


def _prober(centres: Centres, probes: int):
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = centres.order(_matrix(batch.column(1)), probes)
            of = np.repeat(np.arange(batch.num_rows), lists.shape[1])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of)), batch.column(1).take(pa.array(of)), pa.array(lists.ravel())], names=["query_id", "q", "list"])

    return run


def _approximate(keep: int, dim: int):
    """A block of a list's codes and a block of queries -> the vectors that seem nearest to each query."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _NEAR.empty_table()
        codes = np.frombuffer(b"".join(left["code"].to_pylist()), np.uint8).reshape(left.num_rows, -1)
        x, y = decode(codes, left["scale"].to_numpy(), dim), _matrix(right["q"])
        ids, asked, which = left["vec_id"].to_numpy(), right["query_id"].to_numpy(), left["list"][0].as_py()
        out = []
        for at in range(0, len(y), 256):
            near = y[at : at + 256] @ x.T
            near[asked[at : at + 256, None] == ids] = -np.inf
            some = np.argpartition(-near, keep - 1, 1)[:, :keep] if keep < len(x) else np.broadcast_to(np.arange(len(x)), near.shape)
            value = np.take_along_axis(near, some, 1)
            i, j = np.nonzero(value > -np.inf)
            out.append(pa.table([asked[at + i], np.full(len(i), which, np.int32), ids[some[i, j]], value[i, j]], schema=_NEAR))
        return pa.concat_tables(out)

    return run


def _nearest_of(k: int):
    """A block of a list's whole vectors and a block of queries -> each query's k nearest of the block."""
    nearest = _nearest(k)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found = nearest(left, right)
        which = left["list"][0].as_py() if left.num_rows else 0
        return found.add_column(1, "list", pa.array(np.full(found.num_rows, which, np.int32)))

    return run


def search_index(index: VectorIndex, queries: DataFrame, k: int = 20, *, probes: int | None = None, keep: int | None = None) -> DataFrame:
    """The k nearest other vectors of each query (query_id integer, q) that its lists hold: (query_id, place, vec_id, list, distance).

    Reads the ``probes`` nearest lists of each query (those that the index has
    measured, unless given).  The ``keep`` best by their codes (5 k) are
    compared as whole vectors; distances are exact, ties go to the smaller
    vec_id.  With all lists and all vectors kept the search is exact; where
    ``keep`` leaves out no vector of the lists, codes have nothing to settle, so
    whole vectors are compared in the blocks and no more than the k nearest of
    each leave it.  A query that is null, zero, not finite or of another
    dimension finds nothing.
    """
    probes, keep = min(probes or index.probes, len(index.centres.fine)), keep or 5 * k
    q = queries.where(usable("q")).where(F.size("q") == index.dim).select(F.col("query_id").cast("long").alias("query_id"), F.col("q").cast("array<double>").alias("q"))
    probed = q.mapInArrow(_prober(index.centres, probes), "query_id long, q array<double>, list int")
    counts = {r["list"]: r["count"] for r in probed.groupBy("list").count().collect()}
    lists = sorted(i for i in counts if i in index.sizes)
    if not lists:
        return index.spark.createDataFrame([], "query_id long, place int, vec_id long, list int, distance double")
    blocks = index.spark.createDataFrame([(i, -(-index.sizes[i] // BLOCK_ROWS), -(-counts[i] // BLOCK_QUERIES)) for i in lists], "list int, n_v int, n_q int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    part = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    rows, whole = index.rows(lists), keep >= sum(index.sizes[i] for i in lists)
    left = rows.select("vec_id", *([F.col("embedding").alias("e")] if whole else ["code", "scale"]), "list").join(F.broadcast(blocks), "list").select("*", part("vec_id", "n_v").alias("v_block"), every("n_q").alias("q_block"))
    right = probed.join(F.broadcast(blocks), "list").select("query_id", "q", "list", part("query_id", "n_q").alias("q_block"), every("n_v").alias("v_block"))
    keys = ["list", "v_block", "q_block"]
    w = Window.partitionBy("query_id").orderBy("distance", "vec_id")
    if whole:
        near = left.groupBy(*keys).cogroup(right.select("query_id", F.col("q").alias("e"), *keys).groupBy(*keys)).applyInArrow(_nearest_of(k), "query_id long, list int, vec_id long, distance double")
        return near.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k).select("query_id", "place", "vec_id", "list", "distance")
    near = left.select("vec_id", "code", "scale", *keys).groupBy(*keys).cogroup(right.select("query_id", "q", *keys).groupBy(*keys)).applyInArrow(_approximate(keep, index.dim), "query_id long, list int, vec_id long, near float")
    best = near.withColumn("_n", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("near"), "vec_id"))).where(F.col("_n") <= keep)
    exact = best.select("query_id", "list", "vec_id").join(rows.select("list", "vec_id", "embedding"), ["list", "vec_id"]).join(q, "query_id")
    exact = exact.select("query_id", "vec_id", "list", cosine_distance(F.col("embedding"), F.col("q")).alias("distance"))
    return exact.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k).select("query_id", "place", "vec_id", "list", "distance")
