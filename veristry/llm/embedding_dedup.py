"""Near-duplicate embeddings by sorted projection passes.

Equal vectors are folded to one.  In each pass a vector gets a key: the signs
of its products with fixed random directions, as bits one after the other.
Vectors are ordered by (label, key) across all partitions, and each is compared
with its neighbours in a bounded window, also across the partitions' borders.
The verified pairs of all passes are united to components.  How many passes a
label gets follows from its number of vectors, so that a pair at the threshold
is missed with a bounded probability at every size.

Windows show that a dense group hangs together, not all of its pairs; so each
component's links are counted afterwards, in tiles of two blocks of it.  No
pairs are returned, whose number grows with the square of a group: windows
return edges that connect what they link, tiles return each row's count.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import components, hook, parts, small_batches, stored, tidy, whole_groups

#: Bits of a key, rows that a partition of the sorted passes should have at least, and rows that are compared at once.
KEY_BITS, PASS_ROWS, STEP = 64, 4096, 1024
#: Rows that a block of a large component has at least, numbers that it has at most, and blocks of a component before they grow.
LEAST_ROWS, MOST_NUMBERS, BLOCKS = 4096, 1 << 21, 8
_SEED = 20_24
_ORDER = ["pass", "label", "dim", "code", "rep"]
_WIDE = "pass int, label long, dim int, code long, rep long, vec binary"
_MET = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("edge", pa.int64()), ("far", pa.int32()), ("pass", pa.int32()), ("label", pa.int64()), ("dim", pa.int32()), ("vec", pa.binary())])
_MET_SQL = "a long, b long, edge long, far int, pass int, label long, dim int, vec binary"
_TILE = ["root", "i", "j"]


def directions(number: int, dim: int) -> np.ndarray:
    """The fixed random directions of a pass for vectors of ``dim`` components."""
    return np.random.default_rng([_SEED, number, dim]).standard_normal((dim, KEY_BITS))


def passes(n: Column, least: float, window: int, miss: float) -> Column:
    """How many passes a label of ``n`` vectors needs.

    Two vectors at the cosine ``least`` have an equal sign with the probability
    p = 1 - arccos(least) / pi.  They are in one window at the latest when they
    share log2(n / window) leading bits, so a pass misses them with at most
    1 - p ** log2(n / window), and all passes together with at most ``miss``.
    """
    met = F.pow(F.lit(1 - math.acos(least) / math.pi), F.log2(n / window))
    return F.when(n <= window, F.lit(1)).otherwise(F.ceil(F.lit(math.log(miss)) / F.log1p(-met))).cast("int")


def _unit(vectors: list[bytes] | pa.Array, kind: str) -> np.ndarray:
    x = np.stack([np.frombuffer(v if isinstance(v, bytes) else v.as_py(), kind) for v in vectors]).astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _project(kind: str):
    """(rep, label, passes, embedding) -> one row per pass with the key and the vector as it was given."""

    def run(batches):
        for batch in batches:
            ids, labels, number, column = (batch.column(k) for k in range(4))
            ids, labels, number = ids.to_numpy(), labels.to_numpy(), number.to_numpy()
            dims = np.asarray(pa.compute.list_value_length(column))
            for dim in np.unique(dims):
                rows = np.flatnonzero(dims == dim)
                for at in range(0, len(rows), 2048):
                    own = rows[at : at + 2048]
                    x = np.asarray(column.take(pa.array(own)).flatten()).astype(kind).reshape(len(own), dim)
                    vec = pa.array([v.tobytes() for v in x], pa.binary())
                    x = x.astype(np.float64)
                    for k in range(int(number[own].max())):
                        some = np.flatnonzero(number[own] > k)
                        code = np.packbits(x[some] @ directions(k, int(dim)) > 0, axis=1).view(">u8").ravel().astype(np.uint64) ^ np.uint64(1 << 63)
                        n = len(some)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, k, np.int32)), pa.array(labels[own][some]), pa.array(np.full(n, dim, np.int32)), pa.array(code.view(np.int64)), pa.array(ids[own][some]), vec.take(pa.array(some))], names=[*_ORDER, "vec"])

    return run


def _edges(ids: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    found = hook(np.arange(len(ids)), a, b)
    a, b = (np.concatenate([np.empty(0, np.int64), *[e[k] for e in found]]) for k in (0, 1))
    return pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(ids[b]), *[pa.nulls(len(a), f.type) for f in list(_MET)[2:]]], schema=_MET)


def _sweep(window: int, least: float, kind: str):
    """A partition of the sorted passes -> edges that connect what its windows link, and the rows that meet the partitions beside it."""

    def run(batches):
        part, head, kept = TaskContext.get().partitionId(), 0, None

        def ends(t, edge, far):
            return pa.RecordBatch.from_arrays([t.column("rep"), pa.nulls(t.num_rows, pa.int64()), pa.array(np.full(t.num_rows, edge)), pa.array(far.astype(np.int32)), *[t.column(c) for c in ("pass", "label", "dim", "vec")]], schema=_MET)

        for batch in batches:
            for at in range(0, batch.num_rows, STEP):
                new = batch.slice(at, STEP)
                if head < window:
                    some = new.slice(0, window - head)
                    yield ends(some, part - 1, -np.arange(head, head + some.num_rows) - 1)
                    head += some.num_rows
                t = pa.Table.from_batches([new] if kept is None else [kept, new]).combine_chunks()
                group = np.stack([t.column(c).to_numpy().astype(np.int64) for c in ("pass", "label", "dim")], 1)
                start = np.ones(len(group), bool)
                start[1:] = (group[1:] != group[:-1]).any(1)
                cuts, old = [*np.flatnonzero(start), len(group)], t.num_rows - new.num_rows
                a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
                for lo, hi in zip(cuts, cuts[1:], strict=False):
                    if hi <= old or hi - lo < 2:
                        continue
                    x, since = _unit(t.column("vec")[lo:hi], kind), max(old, lo)
                    close = x[since - lo :] @ x.T >= least
                    far = np.arange(since, hi)[:, None] - np.arange(lo, hi)
                    p, q = np.nonzero(close & (far > 0) & (far <= window))
                    a.append(p + since)
                    b.append(q + lo)
                yield _edges(t.column("rep").to_numpy(), np.concatenate(a), np.concatenate(b))
                kept = t.slice(max(0, t.num_rows - window)).to_batches()[0]
        if kept is not None:
            yield ends(kept, part, np.arange(kept.num_rows, 0, -1))
        tidy()

    return run


def _border(window: int, least: float, kind: str):
    """The last rows of a partition, ``far`` 1 being the very last, and the first of the next, ``far`` -1 the very first -> edges."""

    def run(key, t):
        t = t.combine_chunks()
        far, ids = t.column("far").to_numpy(), t.column("a").to_numpy()
        tail, head = np.flatnonzero(far > 0), np.flatnonzero(far < 0)
        if not len(tail) or not len(head):
            return pa.Table.from_batches([], _MET)
        group = np.stack([t.column(c).to_numpy().astype(np.int64) for c in ("pass", "label", "dim")], 1)
        a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for g in np.unique(group[tail], axis=0):
            x, y = tail[(group[tail] == g).all(1)], head[(group[head] == g).all(1)]
            if len(y):
                vec = t.column("vec")
                close = _unit(vec.take(pa.array(x)), kind) @ _unit(vec.take(pa.array(y)), kind).T >= least
                p, q = np.nonzero(close & (far[x][:, None] - far[y] - 1 <= window))
                a.append(x[p])
                b.append(y[q])
        return pa.Table.from_batches([_edges(ids, np.concatenate(a), np.concatenate(b))])

    return run


def links(x: np.ndarray, size: np.ndarray, least: float, first: int = 0) -> np.ndarray:
    """How many vectors each row of a tile links with.

    Rows before ``first`` are compared with the others, or all with each other
    where it is 0.  A row stands for ``size`` equal vectors.
    """
    n = len(x)
    end = first or n
    number = np.zeros(n)
    step = max(1, min(512, MOST_NUMBERS // max(1, n)))
    for at in range(0, end, step):
        to = min(at + step, end)
        since = first or at
        close = x[at:to] @ x[since:].T >= least
        if not first:
            close &= np.arange(since, n) > np.arange(at, to)[:, None]
        number[at:to] += close @ size[since:]
        number[since:] += size[at:to] @ close
    return number.astype(np.int64)


def _tiles(least: float, kind: str):
    """Rows sorted by tile and side -> (rep, links of it in a tile)."""

    def run(batches):
        for t in whole_groups(batches, _TILE):
            place = np.stack([t.column(c).to_numpy().astype(np.int64) for c in _TILE], 1)
            new = np.ones(len(place), bool)
            new[1:] = (place[1:] != place[:-1]).any(1)
            cuts, ids, size, side = [*np.flatnonzero(new), len(place)], t.column("rep").to_numpy(), t.column("size").to_numpy(), t.column("side").to_numpy()
            for a, b in zip(cuts, cuts[1:], strict=False):
                first = int((side[a:b] == 0).sum())
                if place[a, 1] != place[a, 2] and first in (0, b - a):
                    continue  # the other block is empty
                number = links(_unit(t.column("vec")[a:b], kind), size[a:b], least, first if first < b - a else 0)
                own = np.flatnonzero(number)
                yield pa.RecordBatch.from_arrays([pa.array(ids[a:b][own]), pa.array(number[own])], names=["a", "n"])
        tidy()

    return run


def _packed(kind: str):
    def run(batches):
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            values, at = np.asarray(column.flatten()).astype(kind), np.concatenate([[0], np.cumsum(np.asarray(pa.compute.list_value_length(column)))])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([values[a:b].tobytes() for a, b in zip(at, at[1:], strict=False)], pa.binary())], names=[*batch.schema.names[:-1], "vec"])

    return run


def near_duplicates(vectors: DataFrame, *, least: float = 0.93, window: int = 256, miss: float = 1e-4) -> DataFrame:
    """Links vectors of equal label whose cosine is ``least`` or more, by sorted projection passes.

    ``vectors`` has vec_id (integer), embedding (array of numbers) and label
    (integer); other columns are not used.  Returns vec_id long, n_links long
    (other vectors linked directly), component_id long (the smallest vec_id
    reachable) and kept boolean (vec_id = component_id).

    No links: a null label or vec_id, a null, empty or zero vector, one that
    holds a null, NaN or infinity, and vectors of different lengths.  Equal
    vectors of a label link with each other and share all other links; rows
    that repeat a vec_id count as one.  An empty table gives an empty result.

    No pair below ``least`` is ever linked.  A component that no pass has met
    as one is missed; for a pair of vectors alone the probability of that is at
    most ``miss``, and a label of at most ``window`` distinct vectors is exact.
    Links within a component are counted exactly, which takes time with the
    square of the component's distinct vectors.
    """
    spark = vectors.sparkSession
    wide = F.col("embedding").cast("array<double>")
    kind = "f4" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "f8"
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), wide.alias("e"))
    usable = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("e") > 0) & F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("e", lambda x: x != 0)
    v = v.withColumn("usable", F.coalesce(usable, F.lit(False)))
    # two hashes name a class of equal vectors
    v = v.withColumn("h1", F.when(F.col("usable"), F.xxhash64("label", "e"))).withColumn("h2", F.when(F.col("usable"), F.xxhash64(F.lit(_SEED), "e", "label")))
    good = v.where("usable")
    classes = good.groupBy("h1", "h2").agg(F.min(F.struct("vec_id", "label", "e")).alias("m"), F.count_distinct("vec_id").alias("size"))
    classes = stored(classes.select("h1", "h2", F.col("m.vec_id").alias("rep"), F.col("m.label").alias("label"), F.col("m.e").alias("e"), "size"), "vector-classes")
    small_batches(spark)
    counts = classes.groupBy("label", F.size("e").alias("dim")).agg(F.count("*").alias("n")).where("n > 1").select("label", "dim", passes(F.col("n"), least, window, miss).alias("passes"), "n")
    rows = counts.agg(F.coalesce(F.sum(F.col("n") * F.col("passes")), F.lit(0)).alias("n")).first()["n"]
    given = classes.withColumn("dim", F.size("e")).join(counts, ["label", "dim"]).select("rep", "label", "passes", "e")
    ranged = given.mapInArrow(_project(kind), _WIDE).repartitionByRange(max(1, min(parts(spark), rows // PASS_ROWS)), *_ORDER).sortWithinPartitions(*_ORDER)
    met = stored(ranged.mapInArrow(_sweep(window, least, kind), _MET_SQL), "vector-windows")
    border = met.where("edge is not null").groupBy("edge").applyInArrow(_border(window, least, kind), _MET_SQL)
    roots = components(met.where("edge is null").select("a", "b").union(border.select("a", "b")), "vectors")

    own = classes.join(roots, F.col("rep") == F.col("id")).select("rep", "size", "root", "e").mapInArrow(_packed(kind), "rep long, size long, root long, vec binary")
    block = F.least(F.floor(F.lit(MOST_NUMBERS) / F.col("dim")), F.greatest(F.lit(LEAST_ROWS), F.ceil(F.col("n") / BLOCKS)))
    sizes = own.groupBy("root").agg(F.count("*").alias("n"), (F.max(F.length("vec")) / np.dtype(kind).itemsize).alias("dim")).select("root", F.ceil(F.col("n") / F.greatest(F.lit(1), block)).cast("int").alias("blocks"))
    placed = own.join(sizes, "root").withColumn("own", F.pmod(F.xxhash64("rep"), "blocks").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tiles = placed.select("root", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"), "rep", "size", "vec")
    tiles = tiles.repartition(parts(spark), *_TILE).sortWithinPartitions(*_TILE, "side")
    near = tiles.mapInArrow(_tiles(least, kind), "a long, n long").groupBy("a").agg(F.sum("n").alias("near"))

    known = classes.select("h1", "h2", "rep", "size").join(near, F.col("rep") == F.col("a"), "left").join(roots, F.col("rep") == F.col("id"), "left")
    known = known.select("h1", "h2", (F.col("size") - 1 + F.coalesce("near", F.lit(0))).alias("links"), F.coalesce("root", "rep").alias("root"))
    out = v.select("vec_id", "h1", "h2").join(known, ["h1", "h2"], "left")
    out = out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("root", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP2_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), u AS (
  SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS s FROM v
), p AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM u x JOIN u y ON x.label = y.label AND x.vec_id <> y.vec_id
  WHERE len(x.e) = len(y.e) AND list_dot_product(x.e, y.e) >= 0.93 * x.s * y.s
), r AS (
  SELECT vec_id AS id, vec_id AS o FROM embeddings UNION SELECT r.id, p.b FROM r JOIN p ON r.o = p.a
), c AS (
  SELECT id, min(o) AS component_id FROM r GROUP BY id
), n AS (
  SELECT a, count(*) AS n FROM p GROUP BY a
)
SELECT id AS vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, id = component_id AS kept FROM c LEFT JOIN n ON id = a
"""
