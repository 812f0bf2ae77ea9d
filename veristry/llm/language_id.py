"""Language identification with error-correcting output codes.

Each language has a codeword of bits.  A binary classifier over byte n-grams
predicts each bit; a text gets the language whose codeword loses least, each
bit's loss weighted by how well its classifier did.  Where the second best
loses hardly more, the text is flagged as ambiguous.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .sampling import fold, held_out, per_class
from .shared import small_batches, tidy
from .words import raw, slices

#: Buckets for each n-gram length, and segments' bytes in training.
BUCKETS, SEGMENTS = 4096, (40, 120, 400, 1200)
_ORDERS = (1, 2, 3)
_PIECE = 1 << 19


def _fold_table() -> np.ndarray:
    """A-Z lower-cased; ASCII that isn't a letter becomes a space; other bytes stay."""
    t = np.full(256, 0x20, np.uint8)
    t[0x61:0x7B] = np.arange(0x61, 0x7B)
    t[0x41:0x5B] = np.arange(0x61, 0x7B)
    t[0x80:] = np.arange(0x80, 0x100)
    return t


_FOLD = _fold_table()


def _bucket(codes: np.ndarray) -> np.ndarray:
    return ((codes * np.uint32(0x9E3779B1)) >> np.uint32(20)).astype(np.int64)


def grams(data: np.ndarray) -> list[np.ndarray]:
    """Feature of the 1-, 2- and 3-gram that starts at each byte of folded text; shorter at the end."""
    x = data.astype(np.uint32)
    y = np.append(x[1:], np.uint32(0x20)) if len(x) else x
    z = np.append(x[2:], [np.uint32(0x20)] * 2).astype(np.uint32)[: len(x)] if len(x) else x
    return [x.astype(np.int64), 256 + _bucket(x | (y << np.uint32(8))), 256 + BUCKETS + _bucket((x | (y << np.uint32(8)) | (z << np.uint32(16))) ^ np.uint32(0x5BD1E995))]


WIDTH = 256 + 2 * BUCKETS


def codewords(k: int, seed: int = 7) -> np.ndarray:
    """k rows of bits (-1, 1): all splits of the classes in two up to 7 classes, else the best of random codes."""
    if k <= 1:
        return np.ones((k, 1))
    if k <= 7:
        splits = np.arange(1, 1 << (k - 1))
        return np.where((splits[None] >> np.arange(k)[:, None]) & 1, 1.0, -1.0)
    rng, bits, best, gap = np.random.default_rng(seed), int(np.ceil(12 * np.log2(k))), None, -1
    for _ in range(100):
        code = rng.choice([-1.0, 1.0], (k, bits))
        far = (bits - code @ code.T) / 2 + bits * np.eye(k)
        if far.min() > gap:
            best, gap = code, far.min()
    return best


@dataclass
class Model:
    """Languages, their codewords, bit weights, and per feature a weight for each bit; the last row is the bias."""

    languages: list[str]
    code: np.ndarray
    trust: np.ndarray
    weights: np.ndarray

    def margins(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Each bit's margin for texts that lie one after the other in folded bytes."""
        out = np.zeros((len(starts), self.code.shape[1]))
        some = np.flatnonzero(lengths > 0)
        if len(some):
            for features in grams(data):
                out[some] += np.add.reduceat(self.weights[features], starts[some], axis=0)
        return out / np.maximum(lengths, 1)[:, None] + self.weights[-1]

    def decode(self, margins: np.ndarray, doubt: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best language, its score in 0..1, and whether the choice is ambiguous."""
        loss = (np.logaddexp(0, -margins[:, None, :] * self.code[None]) * self.trust).sum(2)
        best = loss.argmin(1)
        rows = np.arange(len(loss))
        share = np.exp(loss[rows, best][:, None] - loss)
        score = 1 / share.sum(1)
        second = np.partition(loss, 1, axis=1)[:, 1] if loss.shape[1] > 1 else loss[:, 0] + np.inf
        return best, score, second - loss[rows, best] < doubt


def examples(text: str, seed: int = 1) -> list[tuple[np.ndarray, np.ndarray]]:
    """The whole text and one segment of it, each as its features and their shares; none of an empty text."""
    data = _FOLD[np.frombuffer(text.encode(), np.uint8)]
    if not len(data):
        return []
    rng, out = np.random.default_rng([seed, zlib.crc32(data)]), []
    for length in (SEGMENTS[rng.integers(len(SEGMENTS))], len(data)):
        at = int(rng.integers(max(1, len(data) - length + 1)))
        count = np.zeros(WIDTH)
        for start in range(at, min(at + length, len(data)), _PIECE):
            for f in grams(data[start : min(start + _PIECE, at + length)]):
                count += np.bincount(f, minlength=WIDTH)
        index = np.flatnonzero(count)
        out.append((index.astype(np.int16), (count[index] / min(length, len(data))).astype(np.float32)))
    return out


def fit(texts: list[str], languages: list[str], rounds: int = 150) -> Model | None:
    """Trains on the examples of the texts; None without any text."""
    found = [(e, name) for text, name in zip(texts, languages, strict=True) for e in examples(text)]
    return fit_examples([e for e, _ in found], [name for _, name in found], sorted(set(languages)), rounds)


def fit_examples(found: list[tuple[np.ndarray, np.ndarray]], languages: list[str], names: list[str], rounds: int = 150) -> Model | None:
    """Trains one logistic classifier for each bit of the languages' codewords; None without a language."""
    if not names:
        return None
    rows, labels = np.zeros((len(found), WIDTH), np.float32), [names.index(name) for name in languages]
    for k, (index, share) in enumerate(found):
        rows[k, index] = share
    code = codewords(len(names))
    if not len(rows):
        return Model(names, code, np.ones(code.shape[1]), np.zeros((WIDTH + 1, code.shape[1]), np.float32))
    x, target = rows, code[np.array(labels)]
    mean = x.mean(0)
    scale = 1 / (np.sqrt(mean) + 1e-2)
    x -= mean
    x *= scale
    balance = 1 / np.bincount(labels, minlength=len(names))[labels][:, None]
    balance /= balance.mean()
    w, b = np.zeros((WIDTH, code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, rounds + 1):
        pull = -target / (1 + np.exp(np.clip(target * (x @ w + b), -50, 50))) * balance
        g = (x.T @ pull.astype(np.float32)) / len(x) + 1e-4 * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
        b -= 0.5 * pull.mean(0)
    wrong = ((x @ w + b) * target < 0).mean(0)
    trust = np.log((1 - wrong + 1e-3) / (wrong + 1e-3))
    trust = np.maximum(trust / trust.max(), 0.05)
    full = np.vstack([w * scale[:, None], b - (mean * scale) @ w]).astype(np.float32)
    return Model(names, code, trust, full)


def _examples(batches):
    for batch in slices(batches, 1):
        found = [(name, e) for text, name in zip(batch.column(1), batch.column(0), strict=True) for e in examples(text.as_py())]
        yield pa.RecordBatch.from_arrays([pa.array([name.as_py() for name, _ in found], pa.string()), pa.array([e[0].tobytes() for _, e in found], pa.binary()), pa.array([e[1].tobytes() for _, e in found], pa.binary())], names=["lang", "index", "share"])


def train(docs: DataFrame, most_per_language: int = 500, most_rows: int = 3000, most_languages: int = 1000) -> Model | None:
    """Fits on about ``most_per_language`` documents of each language, ``most_rows`` in all, outside the held-out fifth.

    Whole texts are cut to n-grams where they lie; the driver gets counts of at
    most ``WIDTH`` features, two for each document.  A table with more than
    ``most_languages`` values of lang warns that the rarest aren't learned.
    """
    small_batches(docs.sparkSession)
    known = docs.select("doc_id", "lang", "text").where((fold() != 0) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sample = per_class(known, "lang", most_per_language, most_rows, most_languages).select("lang", "text").mapInArrow(_examples, "lang string, index binary, share binary").collect()
    sample.sort(key=lambda r: (r["lang"], r["index"], r["share"]))
    return fit_examples([(np.frombuffer(r["index"], np.int16), np.frombuffer(r["share"], np.float32)) for r in sample], [r["lang"] for r in sample], sorted({r["lang"] for r in sample}))


def _has_letter(folded: np.ndarray, offsets: np.ndarray, texts: pa.Array) -> np.ndarray:
    ascii_letters = np.concatenate([[0], np.cumsum((folded >= 0x61) & (folded <= 0x7A))])
    found = ascii_letters[offsets[1:]] > ascii_letters[offsets[:-1]]
    for i in np.flatnonzero(~found & (np.diff(offsets) > 0)):
        found[i] = any(c.isalpha() for c in texts[int(i)].as_py() or "")
    return found


def predict(model: Model | None, texts: pa.Array, doubt: float) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, score and ambiguity of each text."""
    data, offsets = raw(texts)
    first = offsets[0]
    folded, offsets = _FOLD[data[first : offsets[-1]]], offsets - first
    letters = _has_letter(folded, offsets, texts)
    if model is None:
        return ["und"] * len(texts), np.zeros(len(texts)), letters
    margins = np.zeros((len(texts), model.code.shape[1]))
    for i in np.flatnonzero(letters):
        a, b = offsets[i], offsets[i + 1]
        for at in range(a, b, _PIECE):  # of a very long text
            n = min(b, at + _PIECE) - at
            margins[i] += (model.margins(folded[at : at + n], np.zeros(1, np.int64), np.array([n]))[0] - model.weights[-1]) * n / (b - a)
    margins += model.weights[-1]
    best, score, unsure = model.decode(margins, doubt)
    names = [model.languages[k] if ok else "und" for k, ok in zip(best, letters, strict=True)]
    return names, np.where(letters, score, 0.0), unsure & letters


def _predictor(model: Model | None, doubt: float, n_columns: int, text_at: int, names: list[str]):
    def run(batches):
        for batch in slices(batches, text_at):
            lang, score, unsure = predict(model, batch.column(text_at), doubt)
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in range(n_columns)], pa.array(lang, pa.string()), pa.array(score), pa.array(unsure)], names=[*names, "lang_pred", "score", "ambiguous"])
        tidy()

    return run


def identify(docs: DataFrame, model: Model | None, *, doubt: float = 0.5) -> DataFrame:
    """Adds lang_pred string, score double (0 to 1) and ambiguous boolean.

    ``docs`` has text (string); other columns are carried along, but those
    named like a result column are replaced.  A null or empty text, or one
    without a letter, is ``und`` with score 0 and isn't ambiguous; without a
    model (no labelled row to learn from) every text is ``und``.  Whole texts
    are read, of any length; rows are judged one by one, so repeated ones get the
    same result, and an empty table gives no rows.
    """
    columns = [c for c in docs.columns if c not in ("lang_pred", "score", "ambiguous")]
    small_batches(docs.sparkSession)
    out = docs.select([F.col(f"`{c}`") for c in columns])
    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema.fields)
    return out.mapInArrow(_predictor(model, doubt, len(columns), columns.index("text"), columns), f"{own}, lang_pred string, score double, ambiguous boolean")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = identify(docs.select("doc_id", "text"), train(docs))
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "ambiguous")
