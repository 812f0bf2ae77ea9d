"""Collocations: phrases of two to four words that their parts don't explain.

Only the longest windows are counted: at every word one window of the next
words up to four, padded where a piece of text ends sooner.  A shorter phrase
occurs wherever a window begins with it, so its count is the sum over those
windows, and Spark's ROLLUP over the window's columns gives the counts of all
lengths from the one table.

Before that, windows travel once.  Each block of text folds its equal windows
and sends them, packed, to the part of their first two words.  There all
windows of a pair are together, so what is too rare to be a phrase is known:
such a window is shortened to its longest frequent beginning, which leaves
ROLLUP little more than frequent phrases.  A pair that fills much of a block
would fill a part; its windows are dealt out by all four words instead, whole,
and its own part is told to shorten none of it.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import parts, small_batches, stored, tidy
from .words import LOWER, Piece, begins, gathered, mix

LONGEST = 4
#: Bytes of text whose windows are folded at once.
BLOCK_BYTES = 4 << 20

_BREAK = np.zeros(256, bool)
_BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_WORD = ~_BREAK
_WORD[[0x20, 0x09]] = False
_K = np.uint64(0xD6E8FEB86659FD93)

_PACKED = pa.schema([("part", pa.int32()), ("langs", pa.list_(pa.string())), ("words", pa.binary()), ("codes", pa.binary()), ("counts", pa.binary()), ("open", pa.binary())])
_WINDOW = pa.schema([("lang", pa.string()), *((f"w{k}", pa.string()) for k in range(1, LONGEST + 1)), ("c", pa.int64())])


def _sums(count: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Sums of the runs that begin at ``new``."""
    return np.add.reduceat(count, new) if len(new) else np.empty(0, count.dtype)


def _folded(langs: list[str], data: np.ndarray, offsets: np.ndarray):
    """A block's distinct padded windows: language names, words, their hashes, codes (5 rows: language, words from 1 on, 0 pads) and counts."""
    piece = Piece(0, data, offsets, _WORD, LOWER)
    n = len(piece.start)
    h = piece.hashes()
    known, at, code = np.unique(h, return_index=True, return_inverse=True)
    names, lang = np.unique(np.array(langs, object), return_inverse=True)
    breaks = np.concatenate([[0], np.cumsum(_BREAK[piece.data])])
    row = np.repeat(np.arange(piece.rows), piece.count)
    ends = np.ones(n, bool)
    ends[:-1] = (row[1:] != row[:-1]) | (breaks[piece.start[1:]] > breaks[piece.end[:-1]])
    last = np.flatnonzero(ends)
    left = last[np.searchsorted(last, np.arange(n))] - np.arange(n)
    codes = np.zeros((1 + LONGEST, n), np.int32)
    codes[0] = lang[row]
    for k in range(LONGEST):
        some = np.flatnonzero(left >= k)
        codes[1 + k, some] = code[some + k] + 1
    key = codes[0].astype(np.uint64)
    for c in codes[1:]:
        key = mix(key * _K + c.astype(np.uint64))
    order = np.argsort(key)
    new = begins(key[order])
    if len(new) != len(begins(*codes[:, order])):  # two windows of one hash
        order = np.lexsort(codes[::-1])
        new = begins(*codes[:, order])
    text = piece.data.tobytes()
    words = [text[a:b] for a, b in zip(piece.start[at].tolist(), piece.end[at].tolist(), strict=True)]
    return names, words, known, codes[:, order[new]], np.diff(np.append(new, n))


def _packer(n_parts: int, least: int):
    def run(batches):
        for langs, data, offsets in gathered(batches, BLOCK_BYTES):
            names, words, h, codes, count = _folded(langs, data, offsets)
            if not len(count):
                continue
            tag = mix(np.array([zlib.crc32(x.encode()) for x in names], np.uint64))
            h = np.concatenate([np.zeros(1, np.uint64), h])
            pair = mix(mix(tag[codes[0]] + h[codes[1]]) * _K + h[codes[2]])
            order = np.argsort(pair)
            codes, count, pair = codes[:, order], count[order], pair[order]
            new = begins(pair)
            size = np.diff(np.append(new, len(pair)))
            large = (_sums(count, new) >= least) & (size >= max(2, len(pair) // (4 * n_parts)))
            open_ = np.repeat(large, size)
            at = np.where(open_, mix(mix(pair * _K + h[codes[3]]) * _K + h[codes[4]]), pair)
            # a pair that is dealt out says so to the part that others send it to
            told = codes[:, new[large]].copy()
            told[3:] = 0
            codes, count = np.concatenate([codes, told], 1), np.concatenate([count, np.zeros(told.shape[1], count.dtype)])
            open_, at = np.concatenate([open_, np.ones(told.shape[1], bool)]), np.concatenate([at, pair[new[large]]])
            part = (at % np.uint64(n_parts)).astype(np.int32)
            order = np.argsort(part, kind="stable")
            codes, count, open_, part = codes[:, order], count[order], open_[order], part[order]
            cuts = np.append(begins(part), len(part))
            bare, out = np.array([b"", *words], object), []
            for a, b in zip(cuts, cuts[1:], strict=False):
                own, inverse = np.unique(codes[1:, a:b], return_inverse=True)
                own, inverse = (own[1:], inverse) if own[0] == 0 else (own, inverse + 1)
                packed = np.concatenate([codes[:1, a:b], inverse.reshape(LONGEST, -1)]).astype(np.uint16 if max(len(own), len(names)) < 1 << 16 else np.uint32)
                out.append((int(part[a]), names.tolist(), b" ".join(bare[own]), packed.tobytes(), count[a:b].astype(np.int32).tobytes(), np.packbits(open_[a:b]).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), _PACKED, strict=True)], schema=_PACKED)
            del codes, count, pair, open_, at, part, bare, words, out
            tidy()

    return run


def _shortener(least: int):
    def run(table: pa.Table) -> pa.Table:
        texts, sizes, langs, codes, counts, opens = [np.empty(0, np.uint8)], [np.zeros(1, np.int64)], [], [], [], []
        n_words, n_langs = 0, 0
        for batch in table.to_batches():
            for r in range(batch.num_rows):
                words, packed, count, whole = (np.frombuffer(batch.column(c)[r].as_buffer(), t) for c, t in (("words", np.uint8), ("codes", np.uint8), ("counts", np.int32), ("open", np.uint8)))
                n = len(count)
                c = packed.view(np.uint16 if len(packed) == 2 * (1 + LONGEST) * n else np.uint32).reshape(1 + LONGEST, n).astype(np.int32)
                c[0] += n_langs
                c[1:] += np.where(c[1:] > 0, n_words, 0).astype(np.int32)
                codes.append(c)
                counts.append(count)
                opens.append(np.unpackbits(whole, count=n).astype(bool))
                gaps = np.flatnonzero(words == 0x20)
                texts.append(np.delete(words, gaps))
                sizes.append(np.diff(np.concatenate([[-1], gaps, [len(words)]])) - 1)
                own = batch.column("langs")[r].as_py()
                langs += own
                n_words, n_langs = n_words + len(gaps) + 1, n_langs + len(own)
        named = pa.array(langs, pa.string()).dictionary_encode()
        ends, flat = np.cumsum(np.concatenate(sizes)).astype(np.int32), np.concatenate(texts)
        spelt = pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(flat)]).dictionary_encode()
        del texts, sizes
        again = np.concatenate([np.zeros(1, np.int32), spelt.indices.to_numpy() + 1]).astype(np.int32)
        codes, count, open_ = np.concatenate(codes, 1), np.concatenate(counts).astype(np.int64), np.concatenate(opens)
        codes[0] = named.indices.to_numpy()[codes[0]]
        for c in codes[1:]:
            c[:] = again[c]
        first = np.unique(codes[0].astype(np.int64) * (len(spelt.dictionary) + 1) + codes[1], return_inverse=True)[1]
        a, b = (first << 32) | codes[2], (codes[3].astype(np.int64) << 32) | codes[4]
        del first
        order = np.lexsort((b, a))
        codes, count, open_, a, b = codes[:, order], count[order], open_[order], a[order], b[order]
        del order
        # the runs of equal beginnings of 1 to 4 words, and how long each window's longest frequent beginning is
        runs = [begins(a >> 32), begins(a), begins(a, b >> 32), begins(a, b)]
        keep = np.ones(len(a), np.int8)
        spread = lambda x, new: np.repeat(x, np.diff(np.append(new, len(a))))
        whole = spread(np.logical_or.reduceat(open_, runs[1]), runs[1]) if len(a) else open_
        frequent = np.ones(len(a), bool)
        for k in range(1, LONGEST):
            frequent &= whole | spread(_sums(count, runs[k]) >= least, runs[k])
            frequent &= codes[1 + k] > 0
            keep[frequent] = k + 1
        out = []
        for k in range(1, LONGEST + 1):
            total = _sums(np.where(keep == k, count, 0), runs[k - 1])
            some = np.flatnonzero(total)
            at = runs[k - 1][some]
            out.append((codes[0, at], [codes[j, at] if j <= k else np.zeros(len(at), np.int64) for j in range(1, LONGEST + 1)], total[some]))
        text = pa.concat_arrays([pa.array([""]), spelt.dictionary.cast(pa.string())])
        cols = [named.dictionary.take(pa.array(np.concatenate([o[0] for o in out])))]
        cols += [text.take(pa.array(np.concatenate([o[1][j] for o in out]))) for j in range(LONGEST)]
        result = pa.Table.from_arrays([*cols, pa.array(np.concatenate([o[2] for o in out]))], schema=_WINDOW)
        tidy()
        return result

    return run


def count_phrases(docs: DataFrame, least: int = 30) -> DataFrame:
    """Counts of every word sequence of up to four words that occurs ``least`` times in a language, and of all its words.

    Returns lang string, words array<string> (empty: the count of all word
    occurrences), f long.  See ``collocations`` for what a word is and how
    nulls are read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    n_parts = parts(spark, 8 * total)  # windows take some three times their text, and a part's are unpacked as a whole
    packed = rows.mapInArrow(_packer(n_parts, least), "part int, langs array<string>, words binary, codes binary, counts binary, open binary")
    names = [f"w{k}" for k in range(1, LONGEST + 1)]
    windows = packed.groupBy("part").applyInArrow(_shortener(least), "lang string, " + ", ".join(f"{n} string" for n in names) + ", c long")
    rolled = windows.rollup("lang", *names).agg(F.sum("c").alias("f"), F.grouping_id().alias("_gone"))
    # a level's row is a phrase where its last word is none of the padding
    last = F.when(F.col("_gone") == (1 << LONGEST) - 1, F.lit("all"))
    for k in range(1, LONGEST + 1):
        last = last.when(F.col("_gone") == (1 << (LONGEST - k)) - 1, F.col(f"w{k}"))
    kept = rolled.where(last != "").where((F.col("f") >= least) | (F.col("_gone") == (1 << LONGEST) - 1))
    return kept.select("lang", F.array_compact(F.array(*names)).alias("words"), "f")


def _joined(words: Column) -> Column:
    return F.array_join(words, " ")


def collocations(docs: DataFrame, *, least: int = 30, most: int = 2000, covered: int = 80) -> DataFrame:
    """Each language's best phrases of two to four words.

    ``docs`` has text and lang; other columns are not used, whatever their
    names.  Texts are lower-cased (A-Z), cut at ``[.,;:!?\\x0A-\\x0D]`` into
    pieces and those into words ``[^\\x20\\x09]+``.  A phrase that occurs a >=
    ``least`` times is cut after its first k words into parts that occur l and
    r times; its score is floor(2000000 a / (l + r)) for the k that makes it
    lowest, the smallest of equals.  A phrase inside a longer one with
    100 f(longer) >= ``covered`` a goes.  Returns lang, rank (from 1), phrase,
    a, l, r, n (all word occurrences of the language) and score, the first
    ``most`` of each language by score, a (both descending) and phrase.

    Null text is empty; a null lang counts as ``und``.  Every row counts,
    repeated ones each time; texts of any length are read whole; an empty table
    gives no rows.  Exact, but for two words of one block with equal 64-bit
    hashes.
    """
    counts = stored(count_phrases(docs, least), "phrases").withColumn("phrase", _joined(F.col("words")))
    f = counts.where(F.size("words") > 0).select("lang", "phrase", "f")
    found = counts.where(F.size("words") > 1).select("lang", "phrase", "words", F.col("f").alias("a"))
    n = counts.where(F.size("words") == 0).select("lang", F.col("f").alias("n"))

    cut = found.withColumn("k", F.explode(F.expr("sequence(1, size(words) - 1)")))
    cut = cut.select("lang", "phrase", "a", "k", _joined(F.expr("slice(words, 1, k)")).alias("_l"), _joined(F.expr("slice(words, k + 1, size(words) - k)")).alias("_r"))
    cut = cut.join(f.select("lang", F.col("phrase").alias("_l"), F.col("f").alias("l")), ["lang", "_l"]).join(f.select("lang", F.col("phrase").alias("_r"), F.col("f").alias("r")), ["lang", "_r"])
    cut = cut.withColumn("score", F.expr("(CAST(2000000 AS DECIMAL(7,0)) * CAST(a AS DECIMAL(19,0))) DIV (CAST(l AS DECIMAL(19,0)) + CAST(r AS DECIMAL(19,0)))"))
    scored = cut.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("x"))

    inner = F.expr("flatten(transform(sequence(2, size(words) - 1), n -> transform(sequence(1, size(words) - n + 1), i -> array_join(slice(words, i, n), ' '))))")
    inside = found.where(F.size("words") > 2).select("lang", F.explode(inner).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("_longer"))
    kept = scored.join(inside, ["lang", "phrase"], "left").where(F.expr(f"_longer IS NULL OR CAST(100 AS DECIMAL(3,0)) * CAST(_longer AS DECIMAL(19,0)) < CAST({covered} AS DECIMAL(3,0)) * CAST(a AS DECIMAL(19,0))"))

    by = [F.desc("x.score"), F.desc("a"), F.asc("phrase")]
    # the first of each of 64 parts, so that no language is sorted in one task
    few = kept.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(64))).withColumn("_place", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*by))).where(F.col("_place") <= most)
    out = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*by))).where(F.col("rank") <= most)
    return out.join(n, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "x.l", "x.r", "n", "x.score")


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", "lang"))


OP11_SQL = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, doc_id, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), w AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p
), g AS (
  SELECT lang, ws[i:i + n - 1] AS words FROM w, unnest([1, 2, 3, 4]) AS s(n), unnest(range(1, len(ws) - n + 2)) AS t(i) WHERE len(ws) >= n
), f AS (
  SELECT lang, array_to_string(words, ' ') AS phrase, words, count(*) AS f FROM g GROUP BY ALL
), total AS (
  SELECT lang, sum(f)::BIGINT AS n FROM f WHERE len(words) = 1 GROUP BY lang
), c AS (
  SELECT lang, phrase, words, f AS a FROM f WHERE len(words) > 1 AND f >= 30
), cut AS (
  SELECT c.lang, c.phrase, a, k, x.f AS l, y.f AS r, (2000000::HUGEINT * a // (x.f + y.f))::BIGINT AS score
  FROM c, unnest(range(1, len(c.words))) AS t(k)
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.words[1:k], ' ')
  JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.words[k + 1:], ' ')
), best AS (
  SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), inside AS (
  SELECT lang, array_to_string(words[i:i + n - 1], ' ') AS phrase, max(a) AS longer
  FROM c, unnest([2, 3]) AS s(n), unnest(range(1, len(words) - n + 2)) AS t(i) WHERE len(words) > n GROUP BY ALL
), ranked AS (
  SELECT best.lang, row_number() OVER (PARTITION BY best.lang ORDER BY score DESC, a DESC, best.phrase) AS rank, best.phrase, a, l, r, score
  FROM best LEFT JOIN inside ON best.lang = inside.lang AND best.phrase = inside.phrase
  WHERE longer IS NULL OR 100::HUGEINT * longer < 80::HUGEINT * a
)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score FROM ranked JOIN total USING (lang) WHERE rank <= 2000
"""
