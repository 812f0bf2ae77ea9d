"""Benchmark decontamination with one Aho-Corasick automaton.

Items and documents are normalised alike: A-Z lower-cased, and words
``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``.  A window of 13 words holds at least one
whole block of 7 words, if an item is cut into blocks from its start; so the
patterns of the automaton, sequences of word numbers, are the items' blocks,
and items of fewer than 13 words as a whole.  Its size is that of the items,
not 13 times as much.  Each document is scanned once; where a block occurs,
the words beside it show whether a whole window does, and the words found are
mapped back to character offsets of the document's own text.

The automaton is in flat arrays, built once and broadcast.  Where no four words
in a row begin a pattern, which is nearly everywhere, it is near its root and
comes back to it, so those places are passed over at once.  Items of one word
need no automaton: their places are looked up.  The size of the items is
checked; larger benchmarks go in several blocks, each with its own automaton
and scan, whose hits are united.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import small_batches, stored, tidy
from .words import ALNUM, LOWER, Piece, pieces, slices


def _find(sorted_values: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Place of each x among the sorted values, or -1."""
    if not len(sorted_values):
        return np.full(len(x), -1)
    at = np.minimum(np.searchsorted(sorted_values, x), len(sorted_values) - 1)
    return np.where(sorted_values[at] == x, at, -1)


class Automaton:
    """Aho-Corasick over sequences of numbers below ``width``; node 0 is the root, nodes are numbered by depth."""

    def __init__(self, patterns: np.ndarray, length: np.ndarray, width: int):
        """Row k of ``patterns`` has ``length[k]`` numbers; rows differ."""
        self.width = width
        here = np.zeros(len(patterns), np.int64)
        codes, targets, fails, total = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.zeros(1, np.int64)], 1
        #: The pattern that ends at a node, and the next node along the failure links at which one ends.
        self.ends = np.full(1 + int(length.sum()), -1, np.int32)
        for depth in range(int(length.max(initial=0))):
            rows = np.flatnonzero(length > depth)
            code, place = np.unique(here[rows] * width + patterns[rows, depth], return_inverse=True)
            parent, word = code // width, code % width
            # deeper nodes' codes are larger, because nodes are numbered by depth
            codes.append(code)
            targets.append(total + np.arange(len(code)))
            self.codes, self.targets, self.fail = np.concatenate(codes), np.concatenate(targets), np.concatenate(fails)
            fail = np.zeros(len(code), np.int64)
            if depth:
                state, todo = self.fail[parent], np.arange(len(code))
                while len(todo):
                    edge = _find(self.codes, state[todo] * width + word[todo])
                    found = edge >= 0
                    fail[todo[found]] = self.targets[edge[found]]
                    todo = todo[~found & (state[todo] > 0)]
                    state[todo] = self.fail[state[todo]]
            fails.append(fail)
            here[rows] = total + place
            done = rows[length[rows] == depth + 1]
            self.ends[here[done]] = done
            total += len(code)
        self.codes, self.targets, self.fail = np.concatenate(codes), np.concatenate(targets).astype(np.int32), np.concatenate(fails).astype(np.int32)
        self.ends, self.link = self.ends[:total], np.zeros(total, np.int32)
        for node in range(1, total):  # failure links go to smaller nodes
            f = self.fail[node]
            self.link[node] = f if self.ends[f] >= 0 else self.link[f]
        #: The node that each number leads to from the root; numbers beyond ``width`` lead nowhere.
        first = int((self.codes < width).sum())
        self.depth_two = first + 1
        self.from_root = np.zeros(width + 1, np.int32)
        self.from_root[self.codes[:first]] = self.targets[:first]

    def starts(self, numbers: np.ndarray) -> np.ndarray:
        """Where a pattern begins, as far as its first four numbers tell."""
        start = np.zeros(len(numbers), bool)
        at = np.flatnonzero(self.from_root[np.minimum(numbers, self.width)])
        state = self.from_root[numbers[at]].astype(np.int64)
        for depth in range(1, 5):
            done = (self.ends[state] >= 0) | (depth == 4)
            start[at[done]] = True
            at, state = at[~done], state[~done]
            inside = at + depth < len(numbers)
            at, state = at[inside], state[inside]
            word = numbers[at + depth]
            edge = _find(self.codes, np.where(word < self.width, state * self.width + np.minimum(word, self.width - 1), -1))
            at, state = at[edge >= 0], self.targets[edge[edge >= 0]].astype(np.int64)
        return start

    def iter(self, numbers: np.ndarray):
        """(last place, pattern) for all occurrences; numbers of ``width`` or more are in no pattern."""
        start = self.starts(numbers)
        at, n = -1, len(numbers)
        for begin in np.flatnonzero(start).tolist():
            if begin < at:
                continue  # the automaton was beyond it already
            at, state = begin, 0
            while at < n:
                word = int(numbers[at])
                nxt = -1
                while word < self.width:
                    code = state * self.width + word
                    edge = int(self.codes.searchsorted(code))
                    if edge < len(self.codes) and self.codes[edge] == code:
                        nxt = int(self.targets[edge])
                        break
                    if not state:
                        break
                    state = int(self.fail[state])
                if nxt < 0:
                    break
                state = nxt
                node = state if self.ends[state] >= 0 else int(self.link[state])
                while node:
                    yield at, int(self.ends[node])
                    node = int(self.link[node])
                at += 1
                if state < self.depth_two and at < n and not start[at - 1]:
                    break  # one step from the root, and no pattern goes on from here


@dataclass
class Matcher:
    """The automaton; the words by their sorted hashes; and what belongs to each pattern, as ranges of flat arrays."""

    size: int
    hashes: np.ndarray
    words: list[bytes]
    names: list[str]
    machine: Automaton
    length: np.ndarray
    #: whole[k]:whole[k + 1] are the places in whole_items of the items that pattern k is.
    whole: np.ndarray
    whole_items: np.ndarray
    #: block[k]:block[k + 1] are the contexts of pattern k as a block: the words beside it, nearest first, on the left and on the right.
    block: np.ndarray
    context: np.ndarray
    #: owner[c]:owner[c + 1] are the places in owner_items of the items with context c.
    owner: np.ndarray
    owner_items: np.ndarray
    #: alone[w]:alone[w + 1] are the places in alone_items of the items that are word w and nothing else.
    alone: np.ndarray
    alone_items: np.ndarray

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Each word's number; what no item has gets the next one."""
        at = _find(self.hashes, hashes)
        return np.where(at >= 0, at, len(self.hashes))

    def single(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of words that are a whole item, and these items."""
        if not len(self.alone_items):
            return np.empty(0, np.int64), self.alone_items
        n = np.minimum(numbers, len(self.hashes) - 1)
        at = np.flatnonzero((numbers < len(self.hashes)) & (self.alone[n] < self.alone[n + 1]))
        own = np.unique(numbers[at])
        return at, np.concatenate([np.empty(0, np.int64), *[self.alone_items[self.alone[w] : self.alone[w + 1]] for w in own]])

    def occurrences(self, numbers: np.ndarray) -> tuple[list[tuple[int, int]], set[int]]:
        """Ranges of words that windows cover, and the items whose windows occur."""
        ranges, items, pad = set(), set(), self.size - (self.size + 1) // 2
        around = None
        for last, k in self.machine.iter(numbers):
            first = last - int(self.length[k]) + 1
            own = self.whole_items[self.whole[k] : self.whole[k + 1]]
            if len(own):
                ranges.add((first, last + 1))
                items.update(own.tolist())
            context = self.context[self.block[k] : self.block[k + 1]]
            if len(context):
                if around is None:
                    around = np.concatenate([np.full(pad, -2), numbers, np.full(pad, -2)])
                same = context == np.concatenate([around[first : first + pad][::-1], around[last + 1 + pad : last + 1 + 2 * pad]])
                left, right = np.cumprod(same[:, :pad], 1).sum(1), np.cumprod(same[:, pad:], 1).sum(1)
                for c in np.flatnonzero(left + last + 1 - first + right >= self.size):
                    ranges.add((first - int(left[c]), last + 1 + int(right[c])))
                    c += self.block[k]
                    items.update(self.owner_items[self.owner[c] : self.owner[c + 1]].tolist())
        return sorted(ranges), items


def _runs(of: np.ndarray, n: int) -> np.ndarray:
    """Bounds of the runs of 0..n-1 in sorted numbers."""
    return np.searchsorted(of, np.arange(n + 1))


def matcher(items: list[tuple[str, str]], size: int) -> Matcher:
    """The automaton of (item id, text) pairs."""
    block = (size + 1) // 2
    pad = size - block
    hashes, counts, words = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], {}
    for piece in pieces(pa.array([t for _, t in items], pa.string()), ALNUM, LOWER):
        own, data = piece.hashes(), piece.data.tobytes()
        hashes.append(own)
        counts.append(piece.count)
        for h, k in zip(*(x.tolist() for x in np.unique(own, return_index=True)), strict=True):
            words.setdefault(h, data[piece.start[k] : piece.end[k]])
    flat, count = np.concatenate(hashes), np.concatenate(counts)
    known, numbers = np.unique(flat, return_inverse=True)
    start = np.cumsum(count) - count

    lone = np.flatnonzero((count == 1) & (size > 2))
    lone = lone[np.argsort(numbers[start[lone]], kind="stable")]
    few = np.flatnonzero((count > (size > 2)) & (count < size))
    short = np.full((len(few), max(size - 1, block)), -1, np.int64)
    for c in range(short.shape[1]):
        some = count[few] > c
        short[some, c] = numbers[start[few[some]] + c]
    n_blocks = np.where(count >= size, count // block, 0)
    item = np.repeat(np.arange(len(count)), n_blocks)
    at = (np.arange(len(item)) - np.repeat(np.cumsum(n_blocks) - n_blocks, n_blocks)) * block + start[item]
    blocks = np.full((len(item), short.shape[1]), -1, np.int64)
    blocks[:, :block] = numbers[at[:, None] + np.arange(block)] if len(item) else 0
    place = np.concatenate([at[:, None] - 1 - np.arange(pad), at[:, None] + block + np.arange(pad)], 1)
    inside = (place >= start[item][:, None]) & (place < (start + count)[item][:, None])
    context = np.where(inside, numbers[np.clip(place, 0, max(0, len(numbers) - 1))], -1) if len(item) else np.empty((0, 2 * pad), np.int64)

    patterns, pattern = np.unique(np.concatenate([short, blocks]), axis=0, return_inverse=True)
    pattern = pattern.ravel()
    order = np.argsort(pattern[: len(few)], kind="stable")
    whole, whole_items = _runs(pattern[: len(few)][order], len(patterns)), few[order]
    own = np.column_stack([pattern[len(few) :], context])
    contexts, which = np.unique(own, axis=0, return_inverse=True) if len(own) else (own, np.empty(0, np.int64))
    pairs = np.unique(np.column_stack([which.ravel(), item]), axis=0)
    length = (patterns >= 0).sum(1)
    machine = Automaton(patterns, length, max(1, len(known)))
    return Matcher(size, known, [words[h] for h in known.tolist()], [i for i, _ in items], machine, length, whole, whole_items, _runs(contexts[:, 0], len(patterns)), contexts[:, 1:].astype(np.int32), _runs(pairs[:, 0], len(contexts)), pairs[:, 1], _runs(numbers[start[lone]], len(known)), lone)


def _differ(piece: Piece, at: np.ndarray, numbers: np.ndarray, words: list[bytes]) -> np.ndarray:
    """Whether each word of a piece is another one than its number says."""
    size = np.array([len(words[k]) for k in numbers])
    start = piece.start[at]
    other = piece.end[at] - start != size
    size = np.where(other, 0, size)
    ends = np.cumsum(size)
    want = np.frombuffer(b"".join([words[k] for k, o in zip(numbers, other, strict=True) if not o]), np.uint8)
    bad = piece.data[np.repeat(start - (ends - size), size) + np.arange(len(want))] != want
    if bad.any():
        other[np.searchsorted(ends, np.flatnonzero(bad), side="right")] = True
    return other


def scan(piece: Piece, row: int, numbers: np.ndarray, m: Matcher) -> tuple[np.ndarray, list[str]]:
    """Places of the hit words among a row's words, and the items that occur; what was found by hashes is compared as words."""
    nothing = np.empty(0, np.int64), []
    if not len(m.hashes) or not len(numbers):
        return nothing
    ranges, items = m.occurrences(numbers)
    alone, own = m.single(numbers)
    if not ranges and not len(alone):
        return nothing
    hit = np.zeros(len(numbers) + 1, np.int64)
    for a, b in ranges:
        hit[a] += 1
        hit[b] -= 1
    hit = np.cumsum(hit)[:-1] > 0
    hit[alone] = True
    items.update(own.tolist())
    hit = np.flatnonzero(hit)
    other = _differ(piece, piece.bounds[row] + hit, numbers[hit], m.words)
    if other.any():  # another word of the same hash
        numbers = numbers.copy()
        numbers[hit[other]] = len(m.hashes)
        return scan(piece, row, numbers, m)
    return hit, sorted({m.names[k] for k in items})


def _spans(piece: Piece, row: int, hit: np.ndarray) -> np.ndarray:
    """Character ranges (start, end) of the original text that runs of hit words cover."""
    if not len(hit):
        return np.empty((0, 2), np.int32)
    new = np.flatnonzero(np.concatenate([[True], np.diff(hit) > 1]))
    base, first = piece.offsets[row], piece.bounds[row]
    chars = np.concatenate([[0], np.cumsum((piece.data[base : piece.offsets[row + 1]] & 0xC0) != 0x80)])
    return chars[np.stack([piece.start[first + hit[new]], piece.end[first + hit[np.append(new[1:], len(hit)) - 1]]], 1) - base].astype(np.int32)


def _results(n_words: list[int], hits: list[np.ndarray], found: list[list[str]], spans: list[np.ndarray]) -> list[pa.Array]:
    flat, ends = np.concatenate([np.empty((0, 2), np.int32), *spans]), np.cumsum([0, *[len(x) for x in spans]]).astype(np.int32)
    ranges = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(flat[:, 0].copy()), pa.array(flat[:, 1].copy())], names=["start", "end"]))
    n, h = np.array(n_words, np.int64), np.array([len(x) for x in hits], np.int64)
    return [pa.array(n), pa.array(h), pa.array(found, pa.list_(pa.string())), ranges, pa.array((h > 0) & (20 * h >= n))]


def _scanner(shared: Broadcast, text_at: int, names: list[str], before: bool = False, last: bool = True):
    """Scans texts for a block of items; ``before``: two more columns hold the hits and items of earlier blocks; not ``last``: they are returned."""

    def run(batches):
        m = shared.value
        for batch in slices(batches, text_at):
            n_words, hits, found, spans = [], [], [], []
            for piece in pieces(batch.column(text_at), ALNUM, LOWER):
                numbers = m.numbers(piece.hashes())
                for row in range(piece.rows):
                    hit, own = scan(piece, row, numbers[piece.bounds[row] : piece.bounds[row + 1]], m)
                    if before:
                        k = piece.first + row
                        hit = np.union1d(hit, np.frombuffer(batch.column(len(names))[k].as_py(), np.int64))
                        own = sorted({*own, *batch.column(len(names) + 1)[k].as_py()})
                    n_words.append(int(piece.count[row]))
                    hits.append(hit)
                    found.append(own)
                    spans.append(_spans(piece, row, hit) if last else hit)
            columns = [batch.column(k) for k in range(len(names))]
            if last:
                yield pa.RecordBatch.from_arrays([*columns, *_results(n_words, hits, found, spans)], names=[*names, *_RESULT])
            else:
                yield pa.RecordBatch.from_arrays([*columns, pa.array([h.astype(np.int64).tobytes() for h in hits], pa.binary()), pa.array(found, pa.list_(pa.string()))], names=[*names, "_hits", "_found"])
        tidy()

    return run


_RESULT = {"n_words": "long", "n_hit": "long", "item_ids": "array<string>", "spans": "array<struct<start:int,end:int>>", "contaminated": "boolean"}


def find_contamination(docs: DataFrame, items: DataFrame, *, size: int = 13, most_item_bytes: int = 64 << 20) -> DataFrame:
    """Marks the words of documents that lie in windows of benchmark items.

    ``docs`` has text (string), ``items`` item_id and text; other columns of
    docs are carried along, but those named like a result column are replaced.
    A window is ``size`` consecutive words of an item; an item of fewer words,
    but not none, is one window.  Adds n_words long, n_hit long (words inside
    any occurrence of a window), item_ids array<string> (items that occur,
    sorted as strings), spans array<struct<start,end>> (character ranges of the
    original text) and contaminated boolean (n_hit > 0 and
    20 * n_hit >= n_words).

    Null or empty text: no words, not contaminated.  Items with a null id, null
    text or no words match nothing; items with equal text all occur together;
    without items nothing is contaminated; without
    documents there are no rows.  Texts of any length are scanned
    whole; rows are judged one by one, so repeated ones get the same result.

    Every Python worker holds an automaton, some 10 bytes for each byte of item
    text.  Items of more than ``most_item_bytes`` are dealt into blocks of about
    that size; the documents are scanned once for each, and what a block has hit
    is written and given to the next.
    """
    spark = docs.sparkSession
    columns = [c for c in docs.columns if c not in _RESULT]
    small_batches(spark)
    out = docs.select([F.col(f"`{c}`") for c in columns])
    items = items.select(F.col("item_id").cast("string").alias("i"), F.col("text").alias("t")).where("i is not null and t is not null").distinct()
    total = items.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, -(-total // most_item_bytes))
    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema.fields)
    for b in range(blocks):
        some = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == b) if blocks > 1 else items
        shared = spark.sparkContext.broadcast(matcher([(r["i"], r["t"]) for r in some.orderBy("i", "t").collect()], size))
        last = b == blocks - 1
        result = ", ".join(f"{n} {t}" for n, t in _RESULT.items()) if last else "_hits binary, _found array<string>"
        out = out.mapInArrow(_scanner(shared, columns.index("text"), columns, b > 0, last), f"{own}, {result}")
        out = out if last else stored(out, "contamination")
    return out


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = find_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


OP4_SQL = r"""
WITH low AS (
  SELECT 'd' AS k, doc_id::VARCHAR AS id, text FROM documents UNION ALL SELECT 'b', item_id::VARCHAR, text FROM benchmark
), w AS (
  SELECT k, id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS ws FROM low
), pat AS (
  SELECT DISTINCT id AS item, least(len(ws), 13) AS n, array_to_string(ws[i:i + least(len(ws), 13) - 1], ' ') AS s
  FROM w, unnest(range(1, len(ws) - least(len(ws), 13) + 2)) AS t(i) WHERE k = 'b' AND len(ws) > 0
), size AS (
  SELECT DISTINCT n FROM pat
), win AS (
  SELECT id, i, n, array_to_string(ws[i:i + n - 1], ' ') AS s FROM w, size, unnest(range(1, len(ws) - n + 2)) AS t(i) WHERE k = 'd' AND len(ws) >= n
), m AS (
  SELECT id, i, n, item FROM win JOIN pat USING (n, s)
), items AS (
  SELECT id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM m GROUP BY id
), hit AS (
  SELECT id, count(DISTINCT j) AS n_hit FROM m, unnest(range(i, i + n)) AS t(j) GROUP BY id
)
SELECT w.id::BIGINT AS doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM w LEFT JOIN items ON w.id = items.id LEFT JOIN hit ON w.id = hit.id WHERE k = 'd'
"""
