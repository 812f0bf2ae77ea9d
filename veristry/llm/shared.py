"""Spark plumbing that several operators use."""

from __future__ import annotations

import ctypes
import gc
import time
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: A graph of at most so many edges (3 MB) is finished in one task.
SMALL_EDGES = 200_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: the cluster's, or the session's own in tests."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        at = spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir names no folder that the driver and all executors share")
        at = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_veristry"
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(at)
    return at


def new_folder(spark: SparkSession, what: str) -> str:
    """A path that no other run uses, in the application's own folder below the shared one, which may go when the application has ended."""
    return f"{shared_dir(spark).rstrip('/')}/veristry-{spark.sparkContext.applicationId}/{what}-{uuid.uuid4().hex}"


def drop_folder(spark: SparkSession, path: str) -> None:
    """Deletes a folder that a run has made and needs no more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def stored(df: DataFrame, what: str, made: list[str] | None = None) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back, which cuts its lineage; survives lost executors.

    The folder's path is added to ``made``, for a caller who drops it once
    nothing reads it.
    """
    spark = df.sparkSession
    path = new_folder(spark, what)
    df.write.parquet(path)
    if made is not None:
        made.append(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes that a part of a shuffle should have at most, where a task holds a part as a whole.
PART_BYTES = 64 << 20


def parts(spark: SparkSession, size: int = 0) -> int:
    """How many parts a shuffle of ``size`` bytes is dealt into: the session's setting, or more where a part would be too large for a task."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))


def small_batches(spark: SparkSession, size: str = "4m") -> None:
    """Bounds the bytes of a batch of rows that goes to Python, unless the session sets its own bound.

    Texts are long: Spark's 64 MB a batch cost an executor that much several
    times for each task, in the JVM and in Python.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) in ("67108864b", "67108864", "64m"):
        spark.conf.set(name, size)


def hook(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Unites the sets of a[k] and b[k] in ``root`` (each row's least row); returns edges that do the same, one for each set that ended."""
    edges = []
    while True:
        p, q = root[a], root[b]
        apart = p != q
        if not apart.any():
            return edges
        a, b, p, q = a[apart], b[apart], p[apart], q[apart]
        high, new = np.maximum(p, q), np.arange(len(root))
        np.minimum.at(new, high, np.minimum(p, q))
        high = np.unique(high)
        edges.append((high, new[high]))
        while (new[new] != new).any():
            new = new[new]
        root[:] = new[root]


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same components as one edge from each id to the smallest of its component."""
    ids, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    root = np.arange(len(ids))
    hook(root, place[: len(a)], place[len(a) :])
    own = np.flatnonzero(root != np.arange(len(ids)))
    return ids[own], ids[root[own]]


def _contracted(most: int, roots: bool):
    """Edges -> the stars of a task's edges (of each ``most`` of them); with ``roots`` also each centre with itself, as (id, root)."""

    def run(batches):
        a = b = np.empty(0, np.int64)
        for batch in batches:
            a, b = np.concatenate([a, batch.column(0).to_numpy()]), np.concatenate([b, batch.column(1).to_numpy()])
            if len(a) > most:
                a, b = stars(a, b)
                if len(a) > most // 2 and not roots:
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])
                    a = b = np.empty(0, np.int64)
        a, b = stars(a, b)
        if roots:
            a, b = np.concatenate([a, np.unique(b)]), np.concatenate([b, np.unique(b)])
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["id", "root"] if roots else ["a", "b"])

    return run


def components(edges: DataFrame, what: str = "components", most_rounds: int = 40, small: int = SMALL_EDGES) -> DataFrame:
    """Connected components of the undirected ``edges`` (a long, b long).

    Returns one row (id, root) for each end of an edge, root being the smallest
    id that can be reached.  Null ends and loops are ignored; an empty input
    gives no rows.

    Each task first contracts its own edges to stars.  Where more than
    ``small`` edges are left, two steps alternate until nothing changes: every
    vertex takes the least vertex near it as its new neighbour, first seen from
    the larger ends, then from the smaller.  Both are a partial aggregate and
    an equi join, which Spark can split where one vertex has very many
    neighbours.  Each round is written to the shared folder, so its plan stays
    short.  At most ``small`` edges are finished in one task.
    """
    e = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a <> b")
    made: list[str] = []
    e = stored(e.mapInArrow(_contracted(1 << 20, False), "a long, b long"), what, made)
    last, n = None, e.count()
    for _ in range(most_rounds):
        if n <= small:
            out = stored(e.coalesce(1).mapInArrow(_contracted(2 * small, True), "id long, root long"), what)
            drop_folder(e.sparkSession, made.pop(0))
            return out
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        near = large.join(least, "a").select(F.greatest("b", "m").alias("x"), F.least("b", "m").alias("y"))
        near = near.union(least.select("a", "m")).where("x <> y").distinct()
        e = stored(near.select(F.col("x").alias("a"), F.col("y").alias("b")), what, made)
        drop_folder(e.sparkSession, made.pop(0))  # the round before is written, so nothing reads this one
        seen = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if seen == last:
            break
        last, n = seen, seen["n"]
    else:
        raise RuntimeError(f"components have not settled after {most_rounds} rounds")
    roots = e.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("root"))
    return roots.union(roots.select(F.col("root").alias("id"), "root").distinct())


def whole_groups(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[pa.Table]:
    """Batches that are sorted by the integer ``columns``, cut anew so that no group lies in two of the tables."""
    kept: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([np.asarray(batch.column(c)).astype(np.int64) for c in columns], 1)
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]).any(1)
        new[0] = last is None or (key[0] != last).any()
        last, cuts = key[-1], np.flatnonzero(new)
        if len(cuts) and kept:
            yield pa.Table.from_batches([*kept, batch.slice(0, cuts[0])]).combine_chunks()
            kept, batch, cuts = [], batch.slice(cuts[0]), cuts - cuts[0]
        if len(cuts) > 1:
            yield pa.Table.from_batches([batch.slice(0, cuts[-1])]).combine_chunks()
            batch = batch.slice(cuts[-1])
        kept.append(batch)
    if kept:
        yield pa.Table.from_batches(kept).combine_chunks()


def tidy() -> None:
    """Gives freed memory back to the system; a Python worker is used again for the stages that follow."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not every C library has it
        pass


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of steps whose results are stored.

    Spark does so once a step's plan is garbage in Python and in the JVM; a
    plan that has just ended is let go one collection later.
    """
    for _ in range(2):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.5)
