"""A positional inverted index: words, phrases, NEAR and boolean search without reading a text.

Words are runs of ``[A-Za-z0-9_]`` of the lower-cased text, as ``\\w`` finds
them, and a posting is a word's places in one text.  Postings travel packed, a
row for each bucket of words of a piece of text.  The postings table is
dealt into buckets of words and sorted by word, so that a search reads the
buckets of its words, and of these the row groups that may hold them.  Searches
are joins and aggregates of postings by document.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), 0x5F, *range(0x61, 0x7B)]] = True
#: Bytes of text whose words are sorted at once.
PIECE_BYTES = 4 << 20
#: Bytes of text whose postings a task sorts and writes.
PART_BYTES = 32 << 20


def _postings_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, pa.Array, pa.ListArray, np.ndarray]:
    """Of texts' UTF-8 bytes: the row, word and places (from 0) of each posting, and the number of words of each row."""
    inside = _WORD[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.concatenate([[False], inside])
    before[edge] = False
    start = np.flatnonzero(inside & ~before[:-1])
    after = np.concatenate([inside, [False]])
    after[edge] = False
    end = np.flatnonzero(inside & ~after[1:]) + 1
    bounds = np.searchsorted(start, offsets)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(bounds))
    ends = np.concatenate([[0], np.cumsum(end - start)]).astype(np.int32)
    words = pa.Array.from_buffers(pa.string(), len(start), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(data[inside].tobytes())]).dictionary_encode()
    code = words.indices.to_numpy(zero_copy_only=False)
    order = np.lexsort((code, row))  # stable, so places stay in order
    row, code, place = row[order], code[order], (np.arange(len(start)) - bounds[row])[order]
    new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (code[1:] != code[:-1])])) if len(row) else np.empty(0, np.int64)
    places = pa.ListArray.from_arrays(pa.array(np.append(new, len(row)).astype(np.int32)), pa.array(place.astype(np.int32)))
    return row[new], words.dictionary.take(pa.array(code[new], pa.int32())), places, np.diff(bounds)


def _indexer(batches):
    for batch in batches:
        text = batch.column(1).cast(pa.large_string()).fill_null("")
        offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
        data = np.frombuffer(text.buffers()[2], np.uint8) if text.buffers()[2] is not None else np.empty(0, np.uint8)
        first = 0
        while first < len(text):
            last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + PIECE_BYTES, side="right")) - 1)
            row, word, places, _ = _postings_of(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(first + row)), word, places], names=["doc_id", "term", "places"])
            first = last


#: Rows of a bucket are dealt to so many tasks, as one word may be a large part of all.
_SALTS = 4
_INTS = ("counts", "rows", "sizes", "places")


def _packer(buckets: int):
    """(doc_id, text) -> a row for each bucket of a piece: its documents and terms, and compressed each term's postings, their documents, sizes and steps from place to place."""

    def run(batches):
        number = 0
        for piece in _indexer(batches):
            words = piece.column(1).dictionary_encode()
            code, names = words.indices.to_numpy(zero_copy_only=False), words.dictionary
            bucket = np.array([zlib.crc32(w.encode()) % buckets for w in names.to_pylist()], np.int64)[code] if len(names) else code
            order = np.lexsort((code, bucket))  # stable, so documents stay in order
            code, bucket, lists = code[order], bucket[order], piece.column(2).take(pa.array(order))
            at, places, ids = lists.offsets.to_numpy().astype(np.int64), lists.values.to_numpy(zero_copy_only=False), piece.column(0).take(pa.array(order))
            places, at = places[at[0] : at[-1]], at - at[0]
            step = np.diff(places, prepend=0)
            step[at[:-1]] = places[at[:-1]]
            cuts = np.append(np.flatnonzero(np.diff(bucket, prepend=-1)), len(bucket))
            for a, b in zip(cuts, cuts[1:], strict=False):
                docs = ids[a:b].dictionary_encode()
                new = np.append(np.flatnonzero(np.diff(code[a:b], prepend=-1)), b - a)
                ints = [np.diff(new), docs.indices.to_numpy(zero_copy_only=False), np.diff(at[a : b + 1]), step[at[a] : at[b]]]
                lone = [pa.array([v], t) for v, t in ((int(bucket[a]), pa.int32()), (number % _SALTS, pa.int32()))]
                whole = [pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v) for v in (docs.dictionary, names.take(pa.array(code[a:b][new[:-1]])))]
                yield pa.RecordBatch.from_arrays([*lone, *whole, *[pa.array([zlib.compress(x.astype(np.int32).tobytes(), 1)], pa.binary()) for x in ints]], names=["bucket", "salt", "docs", "terms", *_INTS])
            number += 1

    return run


def _unpacked(batches):
    for batch in batches:
        for k in range(batch.num_rows):
            docs, terms = batch.column("docs")[k].values, batch.column("terms")[k].values
            counts, rows, sizes, step = (np.frombuffer(zlib.decompress(batch.column(c)[k].as_py()), np.int32) for c in _INTS)
            ends = np.concatenate([[0], np.cumsum(sizes)])
            run = np.cumsum(step, dtype=np.int64)
            places = run - np.repeat(run[ends[:-1]] - step[ends[:-1]], sizes)
            lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(places.astype(np.int32)))
            term = terms.take(pa.array(np.repeat(np.arange(len(counts)), counts)))
            yield pa.RecordBatch.from_arrays([docs.take(pa.array(rows)), term, lists, pa.array(np.full(len(rows), batch.column("bucket")[k].as_py(), np.int32))], names=["doc_id", "term", "places", "bucket"])


@dataclass
class TextIndex:
    """A written index: postings by bucket, the terms with their document counts, and the documents' carried columns."""

    spark: SparkSession
    path: str
    buckets: int
    postings: DataFrame = field(repr=False)
    terms: DataFrame = field(repr=False)
    docs: DataFrame = field(repr=False)

    def of(self, words: list[str]) -> DataFrame:
        """(doc_id, term, places) of words, from their buckets alone."""
        rows = self.spark.createDataFrame([(w,) for w in words], "term string").select("term", _bucket(self.buckets).alias("b")).collect() if words else []
        return self.postings.where(F.col("bucket").isin(sorted({r["b"] for r in rows})) & F.col("term").isin(sorted(words))).select("doc_id", "term", "places")


def _bucket(n: int) -> Column:
    return (F.crc32(F.col("term").cast("binary")) % n).cast("int")


def build_index(docs: DataFrame, path: str, carry: dict[str, Column] | None = None, buckets: int | None = None) -> TextIndex:
    """Writes the index of ``docs`` (doc_id, text) below ``path``, with the columns ``carry`` of each document.

    Null and empty texts have no words; such documents are kept among the
    documents.  A doc_id should be unique: rows of one id count as one document
    that has a word where any of them has it.  A null doc_id is left out.
    ``buckets`` follows from the bytes of text where it isn't given, about 32 MB
    each.
    """
    spark = docs.sparkSession
    docs = docs.where("doc_id IS NOT NULL")
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    buckets = buckets or max(4, min(4096, -(-size // (32 << 20))))
    kind = docs.schema["doc_id"].dataType.simpleString()
    ddl = f"doc_id {kind}, term string, places array<int>, bucket int"
    packed = docs.select("doc_id", F.lower("text").alias("text")).mapInArrow(_packer(buckets), f"bucket int, salt int, docs array<{kind}>, terms array<string>, counts binary, rows binary, sizes binary, places binary")
    # about PART_BYTES of text a task, which it sorts in memory
    dealt = packed.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES)), "bucket", "salt").mapInArrow(_unpacked, ddl)
    dealt.sortWithinPartitions("bucket", "term", "doc_id").write.partitionBy("bucket").parquet(f"{path}/postings")
    postings = spark.read.schema(ddl).parquet(f"{path}/postings")
    postings.groupBy("term").agg(F.count("*").alias("df")).write.parquet(f"{path}/terms")
    docs.select("doc_id", *[c.alias(n) for n, c in (carry or {}).items()]).write.parquet(f"{path}/docs")
    return TextIndex(spark, path, buckets, postings, spark.read.parquet(f"{path}/terms"), spark.read.parquet(f"{path}/docs"))


def _next_to(a: Column, b: Column, gap: int) -> Column:
    """Whether a place of ``b`` follows one of ``a`` by at most ``gap``; linear in the places."""
    ahead = F.array_distinct(F.flatten(F.transform(a, lambda p: F.sequence(p + 1, p + gap))))
    return F.arrays_overlap(ahead, b)


def _phrase(places: list[Column]) -> Column:
    """Whether places of the words follow each other."""
    at = places[0]
    for p in places[1:]:
        at = F.array_intersect(F.transform(at, lambda x: x + 1), p)
    return F.size(at) > 0


def search(index: TextIndex, *, all_of: list[str] = (), any_of: list[str] = (), none_of: list[str] = (), near: list[tuple[str, str, int]] = (), phrases: list[list[str]] = ()) -> DataFrame:
    """doc_id of the documents that meet all conditions.

    Every word of ``all_of``, one of ``any_of`` (if any are given), none of
    ``none_of``; of each (a, b, n) of ``near`` a place of b at most n words
    behind one of a; the words of each phrase one after the other.  Words are
    lower-case.  Without a condition that asks for a word, the documents that
    have none of ``none_of``.
    """
    placed = sorted({w for a, b, _ in near for w in (a, b)} | {w for p in phrases for w in p})
    asked = sorted({*all_of, *any_of, *none_of, *placed})
    has, at = {w: F.col(f"_h{k}") for k, w in enumerate(asked)}, {w: F.col(f"_p{k}") for k, w in enumerate(placed)}
    is_ = lambda w: F.col("term") == w
    aggs = [F.coalesce(F.max(is_(w)), F.lit(False)).alias(f"_h{k}") for k, w in enumerate(asked)]
    aggs += [F.first(F.when(is_(w), F.col("places")), ignorenulls=True).alias(f"_p{k}") for k, w in enumerate(placed)]
    wanted = F.lit(True)
    for w in {*all_of, *placed}:
        wanted = wanted & has[w]
    if any_of:
        some = F.lit(False)
        for w in any_of:
            some = some | has[w]
        wanted = wanted & some
    for w in none_of:
        wanted = wanted & ~has[w]
    for a, b, n in near:
        wanted = wanted & F.coalesce(_next_to(at[a], at[b], n), F.lit(False))
    for p in phrases:
        wanted = wanted & F.coalesce(_phrase([at[w] for w in p]), F.lit(False))
    if not (all_of or any_of or placed):
        return index.docs.select("doc_id").distinct().join(index.of(list(none_of)).select("doc_id"), "doc_id", "left_anti")
    return index.of(asked).groupBy("doc_id").agg(*aggs).where(wanted).select("doc_id")


def containing(index: TextIndex, part: str) -> DataFrame:
    """doc_id of documents whose lower-cased text holds ``part``, letters and digits anywhere within a word.

    The index's terms are searched for the part, then the postings of those
    found, by a join, as there may be many.
    """
    part = part.lower()
    if not part or not part.isascii() or not part.replace("_", "a").isalnum():
        raise ValueError("a part of a word has letters, digits and underscores only")
    terms = index.terms.where(F.col("term").contains(part)).select("term", _bucket(index.buckets).alias("bucket"))
    return index.postings.join(terms, ["bucket", "term"], "left_semi").select("doc_id").distinct()
