"""Quality classifier: logistic regression on hashed word n-grams, trained with follow-the-regularised-leader.

Features are the 1- and 2-grams of words and of word shapes (runs of upper
case, lower case, digits and other signs), and whether a word repeats the one
before.  A text is scored as the dot product of its sparse feature shares with
the weights.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .sampling import fold, held_out, per_class, within_bytes
from .shared import small_batches
from .words import WHITE, Piece, pieces, slices

#: Buckets for each kind of feature.
BITS = 18
_KINDS = 5
_SHAPE_BASE = 0xC2B2AE3D27D4EB4F


def _shapes() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[0x41:0x5B] = 0x41
    t[0x61:0x7B] = t[0x80:] = 0x61
    t[0x30:0x3A] = 0x30
    return t


_SHAPE = _shapes()


def features(piece: Piece) -> list[np.ndarray]:
    """For each word the bucket of its word, word pair, shape, shape pair, and repetition."""
    n = len(piece.start)
    if not n:
        return [np.empty(0, np.int64)] * _KINDS
    words = piece.hashes()
    shape = _SHAPE[piece.data]
    turn = np.ones(len(shape), bool)
    turn[1:] = shape[1:] != shape[:-1]
    turn[piece.start] = True
    place = np.cumsum(turn) - 1
    short = Piece(0, shape[turn], np.array([0, int(turn.sum())]), np.ones(256, bool), None)
    short.start, short.end = place[piece.start], place[piece.end - 1] + 1
    shapes = short.hashes(_SHAPE_BASE)
    first = np.zeros(n, bool)
    first[piece.bounds[:-1][piece.count > 0]] = True

    def pair(x: np.ndarray) -> np.ndarray:
        before = np.concatenate([[np.uint64(1)], x[:-1]])
        before[first] = 1
        return (before * np.uint64(0x9E3779B97F4A7C15)) ^ x

    same = np.concatenate([[False], words[1:] == words[:-1]]) & ~first
    cut = lambda h: (h >> np.uint64(64 - BITS)).astype(np.int64)
    mult = np.uint64(0xD6E8FEB86659FD93)
    return [cut(words), cut(pair(words) * mult), cut(shapes), cut(pair(shapes) * mult), same.astype(np.int64)]


def _shares(piece: Piece) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each row, its features and their shares of its words."""
    kinds = features(piece)
    out = []
    for r in range(piece.rows):
        own = slice(piece.bounds[r], piece.bounds[r + 1])
        index = np.concatenate([f[own] + (k << BITS) for k, f in enumerate(kinds)])
        index, count = np.unique(index, return_counts=True)
        out.append((index, count / max(1, int(piece.count[r]))))
    return out


@dataclass
class Model:
    """Weights by kind and bucket, and the bias."""

    weights: np.ndarray
    bias: float

    def scores(self, piece: Piece) -> np.ndarray:
        total = np.zeros(piece.rows)
        some = np.flatnonzero(piece.count)
        if len(some):
            for k, f in enumerate(features(piece)):
                total[some] += np.add.reduceat(self.weights[k][f], piece.bounds[some])
        z = total / np.maximum(piece.count, 1) * SCALE + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


#: Shares are small; this brings them to the range in which the learner's rates were set.
SCALE = 10.0


def follow_the_leader(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, rounds: int = 4, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.002, l2: float = 0.05, seed: int = 3) -> Model:
    """Each example updates, for its own features only, the sums from which the regularised leader's weights follow."""
    size = _KINDS << BITS
    z, n = np.zeros(size + 1), np.zeros(size + 1)

    def leader(i: np.ndarray) -> np.ndarray:
        own = z[i]
        return np.where(np.abs(own) <= l1, 0.0, -(own - np.sign(own) * l1) / ((beta + np.sqrt(n[i])) / alpha + l2))

    rng, share = np.random.default_rng(seed), labels.mean() if len(labels) else 0.5
    weight = np.where(labels == 1, 0.5 / max(share, 1e-6), 0.5 / max(1 - share, 1e-6))
    for _ in range(rounds):
        for k in rng.permutation(len(rows)):
            index, x = np.append(rows[k][0], size), np.append(rows[k][1] * SCALE, 1.0)
            w = leader(index)
            p = 1 / (1 + np.exp(-np.clip(w @ x, -50, 50)))
            g = (p - labels[k]) * x * weight[k]
            z[index] += g - (np.sqrt(n[index] + g * g) - np.sqrt(n[index])) / alpha * w
            n[index] += g * g
    w = leader(np.arange(size + 1))
    return Model(w[:-1].reshape(_KINDS, 1 << BITS).astype(np.float32), float(w[-1]))


def _featurise(batches):
    for batch in slices(batches, 1):
        out = []
        for piece in pieces(batch.column(1), WHITE):
            out += [{"index": i.astype(np.int32).tobytes(), "share": s.astype(np.float32).tobytes()} for i, s in _shares(piece)]
        labels = batch.column(0)
        yield pa.RecordBatch.from_arrays([labels, pa.array([o["index"] for o in out], pa.binary()), pa.array([o["share"] for o in out], pa.binary())], names=["label", "index", "share"])


def train(docs: DataFrame, labels: DataFrame, column: str = "quality", most_per_class: int = 1500, most_bytes: int = 64 << 20) -> Model | None:
    """Fits on about ``most_per_class`` labelled documents of each class outside the held-out fifth; None without any.

    Their whole texts count, of ``most_bytes`` in all; of longer ones fewer documents are taken.
    """
    known = labels.select("doc_id", F.col(column).cast("int").alias("label")).where((fold() != 0) & F.col("label").isin(0, 1)).distinct()
    sample = per_class(known, "label", most_per_class)  # bounded, so it may be broadcast
    texts = docs.select("doc_id", "text").where("text is not null")
    rows = within_bytes(texts.join(F.broadcast(sample), "doc_id").select("doc_id", "label", "text"), most_bytes)
    found = rows.orderBy("doc_id").select("label", "text").mapInArrow(_featurise, "label int, index binary, share binary").collect()
    if not found:
        return None
    return follow_the_leader([(np.frombuffer(r["index"], np.int32).astype(np.int64), np.frombuffer(r["share"], np.float32).astype(float)) for r in found], np.array([r["label"] for r in found], float))


def _scorer(model: Model | None, n_columns: int, text_at: int, names: list[str]):
    def run(batches):
        for batch in slices(batches, text_at):
            score = np.full(batch.num_rows, 0.5)
            if model is not None:
                for piece in pieces(batch.column(text_at), WHITE):
                    score[piece.first : piece.first + piece.rows] = model.scores(piece)
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in range(n_columns)], pa.array(score)], names=[*names, "score"])

    return run


def score_quality(docs: DataFrame, model: Model | None) -> DataFrame:
    """Adds score double (0 to 1, higher: label 1 likelier).

    ``docs`` has text (string); other columns are carried along, but one named
    score is replaced.  A null or empty text has no features and gets the
    bias's score; without a model every score is 0.5.  Whole texts count,
    however long; rows are scored one by one, so repeated ones get the same score,
    and an empty table gives no rows.
    """
    columns = [c for c in docs.columns if c != "score"]
    small_batches(docs.sparkSession)
    out = docs.select([F.col(f"`{c}`") for c in columns])
    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema.fields)
    return out.mapInArrow(_scorer(model, len(columns), columns.index("text"), columns), f"{own}, score double")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = score_quality(docs, model)
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
