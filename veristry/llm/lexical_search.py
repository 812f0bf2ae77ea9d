"""Ranked lexical search over an index in strata of equal length.

A document's score for a term depends on how often it holds the term, tf, and
on its length only through the normaliser m.  So an index block keeps its
documents in order of length: those of equal m are a stratum, and a term's
postings lie by stratum and, within it, by tf.  Of each stratum an impact is
computed once for each tf, and the last posting of a term in a stratum has the
term's largest impact there.  The sum of these for an item's terms bounds what
any document of the stratum can score: an item visits the strata by falling
bound and stops where a bound is below the score of the last place that is
already taken.  m follows from the length only once all documents are counted,
so blocks store lengths, and more blocks can be added at any time.

A block is a row of the index table, made of some MB of text.  A task searches
its blocks one after the other and carries each item's best places along; what
the tasks found is merged by rank.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import small_batches, stored, tidy
from .words import ALNUM, LOWER, Piece, begins, gathered, pieces

#: Bytes of text that make a block of the index.
BLOCK_BYTES = 8 << 20
#: The largest long stands for a null doc_id: it comes last among equal scores.
_NO_ID = np.iinfo(np.int64).max
_INDEX = {"n_docs": "long", "n_terms": "long", "ids": "binary", "lengths": "binary", "terms": "binary", "counts": "binary", "docs": "binary", "tfs": "binary"}
_BINARY = pa.schema([(c, pa.int64() if t == "long" else pa.binary()) for c, t in _INDEX.items()])
_FOUND = pa.schema([("number", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])


def _indexer(batches):
    for keys, data, offsets in gathered(batches, BLOCK_BYTES):
        piece = Piece(0, data, offsets, ALNUM, LOWER)
        some = np.flatnonzero(piece.count)
        ids = np.array([_NO_ID if keys[k] is None else keys[k] for k in some], np.int64)
        order = np.lexsort((ids, piece.count[some]))
        place = np.zeros(piece.rows, np.int64)
        place[some[order]] = np.arange(len(some))
        terms, code = np.unique(piece.hashes(), return_inverse=True)
        pair, tf = np.unique(code * max(1, len(some)) + place[np.repeat(np.arange(piece.rows), piece.count)], return_counts=True)
        term, doc = np.divmod(pair, max(1, len(some)))
        lengths = piece.count[some[order]]
        order = np.lexsort((doc, tf, lengths[doc], term))  # by length and tf within the term
        arrays = [ids[np.lexsort((ids, piece.count[some]))], lengths.astype(np.int64), terms, np.bincount(term, minlength=len(terms)).astype(np.int32), doc[order].astype(np.int32), tf[order].astype(np.int32)]
        yield pa.RecordBatch.from_arrays([pa.array([len(some)]), pa.array([int(lengths.sum())]), *[pa.array([a.tobytes()], pa.binary()) for a in arrays]], schema=_BINARY)
        del piece, terms, code, pair, tf, term, doc, order, arrays
        tidy()


def build_index(docs: DataFrame) -> DataFrame:
    """The index of all rows of ``docs`` (doc_id integer, text string), a row for each block of text; to be written.

    Columns: n_docs and n_terms (of the block's documents that have terms),
    their ids and lengths by rising length, the distinct terms' hashes and
    document counts, and the postings by term, length and tf.  Indexes of
    separate tables may be united.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(_indexer, ", ".join(f"{c} {t}" for c, t in _INDEX.items()))


def _term_rows(batches):
    """(item, text) -> (item, hashes of its terms, repeats included)."""
    for batch in batches:
        out = []
        for piece in pieces(batch.column(1), ALNUM, LOWER):
            h = piece.hashes()
            out += [h[a:b].tobytes() for a, b in zip(piece.bounds, piece.bounds[1:], strict=False)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["item_id", "terms"])


def _counter(query: np.ndarray):
    """Document counts of the query's terms, a row for each task."""

    def run(batches):
        total = np.zeros(len(query), np.int64)
        for batch in batches:
            for terms, counts in zip(batch.column(0), batch.column(1), strict=True):
                terms, counts = np.frombuffer(terms.as_py(), np.uint64), np.frombuffer(counts.as_py(), np.int32)
                at = np.minimum(np.searchsorted(terms, query), max(0, len(terms) - 1))
                same = terms[at] == query if len(terms) else np.zeros(len(query), bool)
                total[same] += counts[at[same]]
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["term", "df"])

    return run


class Query:
    """A block of items: for each its distinct terms, as places in ``terms``, and their weights times repeats."""

    def __init__(self, terms: np.ndarray, items: list[tuple[np.ndarray, np.ndarray]], n_docs: int, n_terms: int, k: int):
        self.terms, self.items, self.n_docs, self.n_terms, self.k = terms, items, n_docs, n_terms, k

    def normalisers(self, lengths: np.ndarray) -> np.ndarray:
        """m of documents by rising length; in Python's integers, as products may be large."""
        n, at = np.unique(lengths, return_inverse=True)
        return np.array([25 + 75 * x * self.n_docs // self.n_terms for x in n.tolist()], np.int64)[at]


class Block:
    """What a row of the index says about a query's terms."""

    def __init__(self, q: Query, ids: np.ndarray, lengths: np.ndarray, terms: np.ndarray, counts: np.ndarray, docs: np.ndarray, tfs: np.ndarray):
        self.ids = ids
        m = q.normalisers(lengths)
        first = begins(m)
        stratum = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(m))))
        at = np.minimum(np.searchsorted(terms, q.terms), max(0, len(terms) - 1))
        known = np.flatnonzero(terms[at] == q.terms) if len(terms) else np.empty(0, np.int64)
        size = counts[at[known]].astype(np.int64)
        ends = np.cumsum(counts, dtype=np.int64)
        new = np.cumsum(size) - size
        own = np.repeat(ends[at[known]] - size - new, size) + np.arange(int(size.sum()))
        self.doc, tf, term = docs[own].astype(np.int64), tfs[own].astype(np.int64), np.repeat(np.arange(len(known)), size)
        s = stratum[self.doc]
        # a stratum's impact of each tf, computed once
        kind, which = np.unique(np.stack([s, tf], 1), axis=0, return_inverse=True) if len(s) else (np.empty((0, 2), np.int64), s)
        self.impact = ((1_000_000_000 * kind[:, 1]) // (1000 * kind[:, 1] + 8 * m[first][kind[:, 0]]))[which.ravel()] if len(s) else s
        #: Of each known term and stratum the first and last posting, and the largest impact, that of the last one.
        self.start = begins(term, s)
        self.end = np.append(self.start[1:], len(s))
        self.run = np.full((len(known) + 1, len(first)), -1, np.int32)
        self.most = np.zeros((len(known) + 1, len(first)), np.int64)
        if len(s):
            self.run[term[self.start], s[self.start]] = np.arange(len(self.start))
            self.most[term[self.start], s[self.start]] = self.impact[self.end - 1]
        self.row = np.full(len(q.terms), len(known))  # of a query's term; the last row is of those that don't occur
        self.row[known] = np.arange(len(known))

    def visit(self, terms: np.ndarray, weights: np.ndarray, strata: np.ndarray, total: np.ndarray) -> np.ndarray:
        """Adds an item's scores of the strata's documents to ``total``; returns the documents."""
        run = self.run[self.row[terms][:, None], strata]
        t, c = np.nonzero(run >= 0)
        run = run[t, c]
        size = self.end[run] - self.start[run]
        at = np.repeat(self.start[run] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        np.add.at(total, self.doc[at], np.repeat(weights[t], size) * self.impact[at])
        return np.unique(self.doc[at])


class Best:
    """The k best documents of each item so far."""

    def __init__(self, q: Query):
        self.q = q
        self.found = [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in q.items]

    def least(self, i: int) -> int:
        """The score that a document needs to take a place or, by its id, to share the last one."""
        scores = self.found[i][1]
        return int(scores[-1]) if len(scores) == self.q.k else 1

    def add(self, i: int, ids: np.ndarray, scores: np.ndarray) -> None:
        some = scores >= max(1, self.least(i))
        ids, scores = np.concatenate([self.found[i][0], ids[some]]), np.concatenate([self.found[i][1], scores[some]])
        order = np.lexsort((ids, -scores))[: self.q.k]
        self.found[i] = ids[order], scores[order]

    def search(self, b: Block) -> int:
        """Searches a block for every item; returns how many strata were visited."""
        visits, total = 0, np.zeros(len(b.ids), np.int64)
        for i, (terms, weights) in enumerate(self.q.items):
            bound = weights @ b.most[b.row[terms]]
            order = np.argsort(-bound, kind="stable")
            order = order[bound[order] > 0]
            at, step = 0, 4
            while at < len(order):
                todo = order[at : at + step]
                todo = todo[bound[todo] >= self.least(i)]
                if not len(todo):
                    break
                docs = b.visit(terms, weights, todo, total)
                self.add(i, b.ids[docs], total[docs])
                total[docs] = 0
                visits, at, step = visits + len(todo), at + step, 2 * step
        return visits


def _searcher(shared):
    def run(batches):
        q = shared.value
        best = Best(q)
        for batch in batches:
            for r in range(batch.num_rows):
                arrays = [np.frombuffer(batch.column(c)[r].as_buffer(), kind) for c, kind in enumerate((np.int64, np.int64, np.uint64, np.int32, np.int32, np.int32))]
                best.search(Block(q, *arrays))
        rows = [(i, ids, scores) for i, (ids, scores) in enumerate(best.found) if len(ids)]
        numbers = np.repeat([r[0] for r in rows], [len(r[1]) for r in rows]) if rows else np.empty(0, np.int64)
        ids, scores = (np.concatenate([np.empty(0, np.int64), *[r[c] for r in rows]]) for c in (1, 2))
        yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), pa.array(ids, mask=ids == _NO_ID), pa.array(scores)], schema=_FOUND)
        tidy()

    return run


def weight(n_docs: int, df: int) -> int:
    """A term's weight by the number of documents that hold it."""
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def search(index: DataFrame, items: DataFrame, *, k: int = 10, block_bytes: int = 16 << 20) -> DataFrame:
    """The k best documents of the index for each item, exactly.

    ``index`` comes from ``build_index``; ``items`` has item_id and text, other
    columns are not used.  Terms are the runs of letters and digits, and of all
    characters beyond ASCII, with A-Z lower-cased.  With N documents that have
    terms, L terms in all, df documents that hold a term, n terms in a
    document and tf of them the term's, its weight is
    w = floor(1000 ln((2N + 2) / (2df + 1))), m = 25 + (75 n N div L), and the
    score sums w (1000000000 tf div (1000 tf + 8m)) over the item's terms,
    repeats included.  Returns item_id, rank int (from 1), doc_id long and
    score long, of scores above 0; equal scores by doc_id.

    Null or empty texts have no terms: such a document is never found, such an
    item finds nothing.  Repeated documents are ranked each by itself; a null
    doc_id comes after all others.  Items that repeat with their text count
    once; those of one id and different texts are ranked each by itself.  Texts
    of any length count as a whole; an empty index or no items give no rows.
    Exact, but for terms of equal 64-bit hashes.

    The items' terms are sent to the tasks in blocks of at most ``block_bytes``
    bytes of text (or one item), each block with a scan of the index.
    """
    spark = index.sparkSession
    kind = items.schema["item_id"].dataType.simpleString()
    own = items.select("item_id", "text").where("text is not null").distinct()
    total, one = index.agg(F.sum("n_docs").alias("n"), F.sum("n_terms").alias("l")).first(), own.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    n_blocks = max(1, -(-one // block_bytes))
    out = None
    for block in range(n_blocks):
        part = own.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == block)
        rows = part.mapInArrow(_term_rows, f"item_id {kind}, terms binary").where("length(terms) > 0").collect()
        hashes = [np.frombuffer(r["terms"], np.uint64) for r in rows]
        terms = np.unique(np.concatenate([np.empty(0, np.uint64), *hashes]))
        if total["n"] and len(rows):
            df = np.zeros(len(terms), np.int64)
            for r in index.select("terms", "counts").mapInArrow(_counter(terms), "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
                df[r["term"]] = r["df"]
            weights = np.array([weight(total["n"], x) for x in df.tolist()], np.int64)
            split = [np.unique(h, return_counts=True) for h in hashes]
            asked = [(at := np.searchsorted(terms, h), weights[at] * count) for h, count in split]
            shared = spark.sparkContext.broadcast(Query(terms, asked, total["n"], total["l"], k))
            found = index.select("ids", "lengths", "terms", "counts", "docs", "tfs").mapInArrow(_searcher(shared), "number long, doc_id long, score long")
        else:
            found = spark.createDataFrame([], "number long, doc_id long, score long")
        by = Window.partitionBy("number").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        found = found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
        names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(rows)], f"number long, item_id {kind}")
        found = found.join(F.broadcast(names), "number").select("item_id", "rank", "doc_id", "score")
        out = found if out is None else out.unionAll(found)
    return out


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = stored(build_index(spark.read.parquet(f"{sf_dir}/documents.parquet")), "lexical-index")
    return search(index, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP13_SQL = r"""
WITH t AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents WHERE text IS NOT NULL
), d AS (
  SELECT doc_id, len(ws) AS n, ws FROM t WHERE len(ws) > 0
), total AS (
  SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM d
), post AS (
  SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, n, unnest(ws) AS term FROM d) GROUP BY ALL
), w AS (
  SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM post, total GROUP BY term, docs
), q AS (
  SELECT item_id, term, count(*) AS times FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark WHERE text IS NOT NULL
  ) GROUP BY ALL
), s AS (
  SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * docs) // terms))))::BIGINT AS score
  FROM q JOIN w USING (term) JOIN post USING (term), total GROUP BY item_id, doc_id
)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM s WHERE score > 0
QUALIFY rank <= 10
"""
