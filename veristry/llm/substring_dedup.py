"""Substring deduplication with a log-structured fingerprint index.

The index is a set of immutable runs.  A run holds, for each part of the hash
space, the sorted fingerprints of the word windows of one batch of documents.
A new batch's fingerprints are shuffled to their part, sorted, and merge-joined
with each run there; what is not yet known becomes the batch's own run.  Runs
of one level are merged into a run of the next level once there are ``fan_in``
of them, so a window is looked up in a few runs however many batches came
before.

A match is verified by a check sum that shares nothing with the fingerprint:
other word hashes, combined in another way.  Part, fingerprint (48 bits) and
check sum (16 bits) together tell 2**64 times the number of parts windows apart.

The index outlives a run: each step appends its list of runs to a manifest,
from which it can be opened again; runs are deleted only when a later manifest
no longer names them, so a step that fails leaves the one before it intact.

Memory of a task is bounded by one part (the session's shuffle partitions,
which follow the data), and a window that very many documents share is folded
to one entry per task before it is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import drop_folder, new_folder, parts, release, small_batches, stored, tidy
from .words import WHITE, mix, part_of, pieces, slices

#: Bases of the check sum's word and window hashes.
_CHECK_WORD, _CHECK = 0xC6BC279692B5CC83, 0xA24BAED4963EE407
#: Shared windows that a task remembers.
_REMEMBERED = 1 << 16
_LOW = np.uint64((1 << 48) - 1)
_PACKED = pa.schema([("part", pa.int32()), ("kind", pa.string()), ("docs", pa.binary()), ("counts", pa.binary()), ("prints", pa.binary())])
_PACKED_SQL = "part int, kind string, docs binary, counts binary, prints binary"


def fingerprints(piece, size: int, n_parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word places, parts and 64-bit fingerprints (48 bits and a 16-bit check sum) of a piece's windows."""
    words = piece.hashes()
    at, h = piece.windows(words, size)
    _, other = piece.windows(piece.hashes(_CHECK_WORD), size, _CHECK)
    part = part_of(h, n_parts)
    return at, part, ((h & _LOW) << np.uint64(16)) | (other >> np.uint64(48))


def window_ids(part: np.ndarray, prints: np.ndarray) -> np.ndarray:
    """One number for a part and a fingerprint in it, to find a window again in its own document."""
    return mix(prints) ^ mix(part.astype(np.uint64) + np.uint64(1))


def _rows(kind: str, part: np.ndarray, doc: np.ndarray, prints: np.ndarray) -> Iterator[dict]:
    """One packed row per part, documents in the order given."""
    order = np.argsort(part, kind="stable")
    part, doc, prints = part[order], doc[order], prints[order]
    cuts = np.flatnonzero(np.diff(part)) + 1
    for p, d, f in zip(part[np.concatenate([[0], cuts])] if len(part) else [], np.split(doc, cuts), np.split(prints, cuts), strict=False):
        new = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]]))
        yield {"part": int(p), "kind": kind, "docs": d[new].tobytes(), "counts": np.diff(np.append(new, len(d))).astype(np.uint32).tobytes(), "prints": f.tobytes()}


def _unpack(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Documents and values of packed rows."""
    join = lambda name, kind: np.concatenate([np.frombuffer(x.as_py(), kind) for c in t.column(name).chunks for x in c] or [np.empty(0, kind)])
    return np.repeat(join("docs", np.int64), join("counts", np.uint32)), join("prints", np.uint64)


class _Remembered:
    """Windows that several documents of a task share, with the smallest of those documents so far."""

    def __init__(self):
        self.ids, self.docs = np.empty(0, np.uint64), np.empty(0, np.int64)

    def owners(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which ids are remembered, and their places."""
        if not len(self.ids):
            return np.zeros(len(ids), bool), np.zeros(len(ids), np.int64)
        at = np.minimum(np.searchsorted(self.ids, ids), len(self.ids) - 1)
        return self.ids[at] == ids, at

    def add(self, ids: np.ndarray, docs: np.ndarray) -> None:
        room = _REMEMBERED - len(self.ids)
        ids, docs = np.concatenate([self.ids, ids[:room]]), np.concatenate([self.docs, docs[:room]])
        order = np.argsort(ids)
        self.ids, self.docs = ids[order], docs[order]


def _cut(size: int, n_parts: int):
    """(doc_id, text) -> packed windows: 'new' for the first of each in a piece, 'hit' for the others there.

    A window that at least four documents of a piece share is remembered for
    the rest of the task; from there on it is sent only for smaller documents.
    """

    def run(batches):
        known = _Remembered()
        for batch in slices(batches, 1):
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            out = []
            for piece in pieces(batch.column(1), WHITE):
                at, part, prints = fingerprints(piece, size, n_parts)
                if not len(at):
                    continue
                doc = ids[piece.first + piece.row_of(at)]
                order = np.lexsort((doc, prints, part))
                p, f, d = part[order], prints[order], doc[order]
                same = np.zeros(len(order), bool)
                same[1:] = (p[1:] == p[:-1]) & (f[1:] == f[:-1])
                first = np.flatnonzero(~same)
                names = window_ids(p[first], f[first])
                held, place = known.owners(names)
                earlier = np.full(len(first), np.iinfo(np.int64).max)
                earlier[held] = known.docs[place[held]]
                lower = held & (d[first] < earlier)
                known.docs[place[lower]] = d[first][lower]
                times = np.diff(np.append(first, len(d)))
                often = ~held & (times >= 4)
                known.add(names[often], d[first][often])
                run_of = np.cumsum(~same) - 1
                owner = np.minimum(d[first], earlier)[run_of]
                # the owner's own row goes on as new, unless an earlier piece has sent one for it
                new = ~same & ~(held & (d[first] >= earlier))[run_of]
                hit = d != owner
                sent = np.sort(order[new])  # in the text's order, so that a document's windows lie together
                out += _rows("new", part[sent], doc[sent], prints[sent])
                # settled already; only carried on, so they are spread evenly
                by_doc = np.flatnonzero(hit)[np.argsort(d[hit], kind="stable")]
                out += _rows("hit", (d[by_doc] % n_parts).astype(np.int32), d[by_doc], window_ids(p[by_doc], f[by_doc]))
            yield pa.RecordBatch.from_pylist(out, _PACKED)
        tidy()

    return run


def _planes(prints: np.ndarray) -> bytes:
    """Sorted fingerprints as differences, byte by byte of equal weight, which compresses well."""
    return np.diff(prints, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes()


def _sorted_prints(data: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view(np.uint64).ravel(), dtype=np.uint64)


def _runs(t: pa.Table) -> list[np.ndarray]:
    return [_sorted_prints(x.as_py()) for c in t.column("prints").chunks for x in c if len(x.as_py())]


def _in_sorted(run: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which of the sorted ``values`` the sorted ``run`` holds."""
    at = np.searchsorted(run, values)
    return (at < len(run)) & (run[np.minimum(at, len(run) - 1)] == values)


def _merge(part_key, new: pa.Table, old: pa.Table | None) -> pa.Table:
    """Merge-joins a part's new windows with its runs: the hits, and the run of what was unknown."""
    part = part_key[0].as_py()
    kinds = np.array(new.column("kind").to_pylist())
    settled = new.filter(pa.array(kinds == "hit"))
    doc, prints = _unpack(new.filter(pa.array(kinds == "new")))
    order = np.lexsort((doc, prints))
    doc, prints = doc[order], prints[order]
    first = np.ones(len(prints), bool)
    first[1:] = prints[1:] != prints[:-1]
    owner = doc[np.maximum.accumulate(np.where(first, np.arange(len(doc)), 0))] if len(doc) else doc
    unique = prints[first]
    known = np.zeros(len(unique), bool)
    for run in _runs(old) if old is not None else []:
        known |= _in_sorted(run, unique)
    hit = known[np.cumsum(first) - 1] | (doc != owner) if len(doc) else np.zeros(0, bool)
    ids = window_ids(np.full(int(hit.sum()), part, np.int32), prints[hit])
    by_doc = np.argsort(doc[hit], kind="stable")
    rows = [dict(r, part=part) for r in _rows("hit", np.zeros(len(ids), np.int32), doc[hit][by_doc], ids[by_doc])]
    rows.append({"part": part, "kind": "run", "docs": b"", "counts": b"", "prints": _planes(unique[~known])})
    out = pa.concat_tables([settled.cast(_PACKED), pa.Table.from_pylist(rows, _PACKED)])
    tidy()
    return out


_MANIFEST = "version long, place int, level int, folder string, size int, fan_in int, n_parts int, last_id long"


class FingerprintIndex:
    """Sorted runs of the window fingerprints of all documents added so far.

    Batches must come in ascending order of document id: all ids of a batch
    are larger than those added before, else ``add`` raises an error.  A window
    belongs to the smallest id.  ``home`` is the index's folder, by default a
    new one; ``open`` goes on with what an earlier run has left there.
    """

    def __init__(self, spark: SparkSession, size: int = 13, fan_in: int = 2, n_parts: int | None = None, home: str | None = None):
        if size < 1 or fan_in < 2:
            raise ValueError("size is at least 1 and fan_in at least 2")
        self.spark, self.size, self.fan_in, self.n_parts = spark, size, fan_in, n_parts or 2 * parts(spark)
        self.home, self.version, self.last_id = home or new_folder(spark, "fingerprints"), 0, None
        #: (level, folder) of each run, oldest first.
        self.runs: list[tuple[int, str]] = []

    @classmethod
    def open(cls, spark: SparkSession, home: str) -> FingerprintIndex:
        rows = spark.read.schema(_MANIFEST).parquet(f"{home}/manifest")
        rows = rows.join(rows.agg(F.max("version").alias("version")), "version").orderBy("place").collect()
        index = cls(spark, rows[0]["size"], rows[0]["fan_in"], rows[0]["n_parts"], home)
        index.version, index.last_id = rows[0]["version"], rows[0]["last_id"]
        index.runs = [(r["level"], r["folder"]) for r in rows if r["folder"]]
        return index

    def _save(self, gone: list[str]) -> None:
        """Appends the list of runs to the manifest; then deletes those that it no longer names."""
        self.version += 1
        rows = [(self.version, k, level, folder, self.size, self.fan_in, self.n_parts, self.last_id) for k, (level, folder) in enumerate(self.runs or [(0, "")])]
        self.spark.createDataFrame(rows, _MANIFEST).coalesce(1).write.mode("append").parquet(f"{self.home}/manifest")
        for f in gone:
            drop_folder(self.spark, f"{f}/kind=run")

    def _folder(self) -> str:
        return f"{self.home}/{new_folder(self.spark, 'run').rsplit('/', 1)[-1]}"

    def _read(self, folders: list[str]) -> DataFrame:
        frames = [self.spark.read.schema(_PACKED_SQL).parquet(f).where("kind = 'run'") for f in folders]
        out = frames[0]
        for f in frames[1:]:
            out = out.unionByName(f)
        return out

    def add(self, docs: DataFrame) -> DataFrame:
        """Adds (doc_id, text) rows; returns packed hits: windows that start in a document with a smaller id."""
        ids = docs.agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).first()
        if self.last_id is not None and ids["a"] is not None and ids["a"] <= self.last_id:
            raise ValueError(f"document {ids['a']} comes after {self.last_id}, which is in the index")
        rows = docs.mapInArrow(_cut(self.size, self.n_parts), _PACKED_SQL).repartition(self.n_parts, "part")
        grouped = rows.groupBy("part")
        if self.runs:
            old = self._read([f for _, f in self.runs]).groupBy("part")
            merged = grouped.cogroup(old).applyInArrow(lambda k, new, old: _merge(k, new, old) if new.num_rows else new.cast(_PACKED), _PACKED_SQL)
        else:
            merged = grouped.applyInArrow(lambda k, new: _merge(k, new, None), _PACKED_SQL)
        folder = self._folder()
        merged.write.partitionBy("kind").parquet(folder)
        self.runs.append((0, folder))
        self.last_id = self.last_id if ids["b"] is None else ids["b"]
        del rows, grouped, merged
        hits = self.spark.read.schema(_PACKED_SQL).parquet(folder).where("kind = 'hit'")
        self._save(self._compact())
        return hits

    def _compact(self) -> list[str]:
        """Merges the newest runs into one of the next level while ``fan_in`` of them have the same level; returns the folders that it replaces."""
        gone = []
        while len(self.runs) >= self.fan_in and len({level for level, _ in self.runs[-self.fan_in :]}) == 1:
            newest = self.runs[-self.fan_in :]

            def one_run(key, t):
                prints = np.sort(np.concatenate(_runs(t) or [np.empty(0, np.uint64)]), kind="stable")
                return pa.Table.from_pylist([{"part": key[0].as_py(), "kind": "run", "docs": b"", "counts": b"", "prints": _planes(prints)}], _PACKED)

            folder = self._folder()
            self._read([f for _, f in newest]).groupBy("part").applyInArrow(one_run, _PACKED_SQL).write.partitionBy("kind").parquet(folder)
            self.runs[-self.fan_in :] = [(newest[0][0] + 1, folder)]
            gone += [f for _, f in newest]
        return gone

    def drop(self) -> None:
        """Deletes the index's runs; hits that were returned can still be read."""
        for _, f in self.runs:
            drop_folder(self.spark, f"{f}/kind=run")
        drop_folder(self.spark, f"{self.home}/manifest")
        self.runs = []


def _by_document(n_parts: int):
    def run(batches):
        for batch in batches:
            doc, ids = _unpack(pa.Table.from_batches([batch]))
            order = np.argsort(doc, kind="stable")
            doc, ids = doc[order], ids[order]
            yield pa.RecordBatch.from_pylist(list(_rows("hit", (doc % n_parts).astype(np.int32), doc, ids)), _PACKED)

    return run


def _gather(key, t):
    doc, ids = _unpack(t)
    order = np.argsort(doc, kind="stable")
    doc, ids = doc[order], ids[order]
    new = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]])) if len(doc) else np.empty(0, np.int64)
    return pa.table({"_hit_doc": pa.array(doc[new], pa.int64()), "_hits": pa.array([x.tobytes() for x in np.split(ids, new[1:])] if len(new) else [], pa.binary())})


def _strip(size: int, n_parts: int, n_columns: int, text_at: int, names: list[str]):
    """Columns, then _hits -> columns, then n_words, n_removed, kept_text."""

    def run(batches):
        for batch in slices(batches, text_at):
            hits = batch.column(n_columns)
            texts = batch.column(text_at)
            total, removed = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            kept: list[str | None] = [None] * batch.num_rows
            some = np.flatnonzero(np.asarray(hits.is_valid()))
            plain = set(range(batch.num_rows)) - set(some.tolist())
            for i in plain:
                if (t := texts[i].as_py()) is not None:
                    w = t.encode().split()
                    total[i], kept[i] = len(w), b" ".join(w).decode()
            for piece in pieces(texts.take(pa.array(some)), WHITE) if len(some) else ():
                at, part, prints = fingerprints(piece, size, n_parts)
                ids, row = window_ids(part, prints), piece.row_of(at)
                cuts = np.searchsorted(row, np.arange(piece.rows + 1))
                drop = np.zeros(len(piece.start) + 1, np.int64)
                for r in range(piece.rows):
                    known = np.sort(np.frombuffer(hits[int(some[piece.first + r])].as_py(), np.uint64))
                    own = slice(cuts[r], cuts[r + 1])
                    found = at[own][_in_sorted(known, ids[own])]
                    np.add.at(drop, found, 1)
                    np.add.at(drop, found + size, -1)
                stay = np.cumsum(drop)[:-1] == 0
                data = piece.data.tobytes()
                for r in range(piece.rows):
                    i, words = int(some[piece.first + r]), slice(piece.bounds[r], piece.bounds[r + 1])
                    s = stay[words]
                    total[i], removed[i] = len(s), len(s) - int(s.sum())
                    kept[i] = b" ".join(data[a:b] for a, b in zip(piece.start[words][s].tolist(), piece.end[words][s].tolist(), strict=True)).decode()
            columns = [batch.column(k) for k in range(n_columns)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(total), pa.array(removed), pa.array(kept, pa.string())], names=[*names, "n_words", "n_removed", "kept_text"])
        tidy()

    return run


def remove_repeated_windows(docs: DataFrame, *, size: int = 13, batches: int = 3, fan_in: int = 2) -> DataFrame:
    """Removes from each document the words of windows that a document with a smaller id has too.

    ``docs`` has doc_id (integer) and text (string); its other columns are
    carried along, but those named like a result column are replaced.  Words
    are ``[^\\x20\\x09-\\x0D]+``, unchanged; a window is ``size`` consecutive
    words of one document.  Adds n_words long, n_removed long and kept_text
    string (kept words joined by one space).

    Null text: no words, kept_text null.  Empty text or fewer words than
    ``size``: nothing is removed.  Texts of any length are cut whole, a piece
    of at least one text at a time.  A null doc_id neither owns nor loses
    windows.  Rows that repeat a doc_id count as the same document.  An empty
    table gives an empty result.

    ``batches``: how many consecutive ranges of doc_id are added to the index
    one after the other; the result does not depend on it.
    """
    spark = docs.sparkSession
    small_batches(spark)
    columns = [c for c in docs.columns if c not in ("n_words", "n_removed", "kept_text", "_hits", "_hit_doc")]
    docs = docs.select([F.col(f"`{c}`") for c in columns])
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text is not null")
    seen = given.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n"), F.percentile_approx("doc_id", [i / max(2, batches) for i in range(1, max(2, batches))], 1000).alias("c")).first()
    # a window takes 8 bytes, and a word hardly less than 6
    index = FingerprintIndex(spark, size, fan_in, 2 * parts(spark, seen["n"] * 4 // 3 // max(1, batches)))
    cuts = sorted(set(seen["c"] or [])) if batches > 1 else []
    bounds = [*zip([None, *cuts], [*cuts, None], strict=True)]
    hits = None
    for low, high in bounds:
        batch = given
        batch = batch.where(F.col("doc_id") > low) if low is not None else batch
        batch = batch.where(F.col("doc_id") <= high) if high is not None else batch
        found = index.add(batch)
        hits = found if hits is None else hits.unionByName(found)
        del batch, found
        release(spark)
    index.drop()
    n = index.n_parts
    per_doc = stored(hits.mapInArrow(_by_document(n), _PACKED_SQL).repartition(n, "part").groupBy("part").applyInArrow(_gather, "_hit_doc long, _hits binary"), "hits")
    del hits
    drop_folder(spark, index.home)  # what was found is gathered by document
    release(spark)
    joined = docs.join(per_doc, docs["doc_id"].cast("long") == per_doc["_hit_doc"], "left").select(*[docs[f"`{c}`"] for c in columns], "_hits")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return joined.mapInArrow(_strip(size, n, len(columns), columns.index("text"), columns), f"{schema}, n_words long, n_removed long, kept_text string")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = remove_repeated_windows(docs)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.coalesce("kept_text", F.lit("")), 256).alias("kept_sha256"))


OP6_SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws FROM documents
), win AS (
  SELECT doc_id, i, array_to_string(ws[i:i+12], ' ') AS s
  FROM w, unnest(range(1, len(ws) - 11)) AS t(i)
), own AS (
  SELECT s, min(doc_id) AS o FROM win GROUP BY s
), gone AS (
  SELECT DISTINCT doc_id, j FROM win JOIN own USING (s), unnest(range(i, i + 13)) AS t(j) WHERE o < doc_id
), word AS (
  SELECT doc_id, j, ws[j] AS x FROM w, unnest(range(1, len(ws) + 1)) AS t(j)
), kept AS (
  SELECT doc_id, string_agg(x, ' ' ORDER BY j) AS k, count(*) AS n FROM word ANTI JOIN gone USING (doc_id, j) GROUP BY doc_id
)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(k, '')) AS kept_sha256
FROM w LEFT JOIN kept ON w.doc_id = kept.doc_id
"""
