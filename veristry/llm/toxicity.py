"""Toxicity: a convolutional text classifier in numpy.

A word's embedding is the sum of two hashed ones, so a word that shares one
bucket with another rarely looks like it; filters of several widths slide over
them, and the largest response of each filter anywhere in the text feeds a
logistic output.  The decision threshold is calibrated for each language, as predicted
from the text itself, and moved to 0.5.

All labelled documents count: the net starts from the counts of words in all of
them, parts of them go on from there side by side, and their changes are
averaged; what each bucket learns, over the parts that have it.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import language_id
from .sampling import fold, held_out
from .shared import small_batches, stored, tidy
from .words import ALNUM, LOWER, Piece, pieces, slices

#: Buckets of each of a word's two hashes, size of an embedding, filter widths, filters of each width.
BITS, DIM, WIDTHS, FILTERS = 17, 8, (1, 2, 3), 4
_PAD = 2 << BITS
_GAP = max(WIDTHS) - 1


def buckets(piece: Piece) -> np.ndarray:
    """Both buckets of each word."""
    h = piece.hashes()
    return np.stack([h >> np.uint64(64 - BITS), (h & np.uint64((1 << BITS) - 1)) + np.uint64(1 << BITS)], 1).astype(np.int64)


@dataclass
class Net:
    """Embeddings (the last row, of padding, stays 0), filters by width (width, dim, filters), biases, output weights."""

    embed: np.ndarray
    filters: list[np.ndarray]
    bias: list[np.ndarray]
    out: np.ndarray
    out_bias: float

    def tables(self) -> list[list[np.ndarray]]:
        """Response of each bucket at each place of each width's filters."""
        return [[(self.embed @ f[o]).astype(np.float32) for o in range(len(f))] for f in self.filters]


def padded(ids: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word buckets with padding after each text, and where each text starts."""
    start = np.concatenate([[0], np.cumsum(count)[:-1]]) if len(count) else np.empty(0, np.int64)
    place = np.arange(len(ids)) + np.repeat(np.arange(len(count)) * _GAP, count)
    out = np.full((len(ids) + len(count) * _GAP + 1, 2), _PAD, np.int64)
    out[place] = ids
    return out, start + np.arange(len(count)) * _GAP


def responses(tables: list[np.ndarray], ids: np.ndarray) -> np.ndarray:
    """A filter width's response at each place; only places of words count."""
    n = len(ids) - len(tables) + 1
    z = np.zeros((n, tables[0].shape[1]), tables[0].dtype)
    for o, table in enumerate(tables):
        z += table[ids[o : o + n, 0]]
        z += table[ids[o : o + n, 1]]
    return z


@dataclass
class Model:
    net: Net
    language: language_id.Model | None
    #: Threshold on the logit for each language, and for any other.
    thresholds: dict[str, float]
    default: float

    def logits(self, piece: Piece, tables: list[list[np.ndarray]]) -> np.ndarray:
        hidden = np.zeros((piece.rows, len(WIDTHS) * FILTERS))
        some = np.flatnonzero(piece.count)
        if len(some):
            ids, start = padded(buckets(piece), piece.count)
            cuts = np.stack([start[some], start[some] + piece.count[some]], 1).ravel()
            for k, width in enumerate(WIDTHS):
                z = responses(tables[k], ids)
                if cuts[-1] >= len(z):  # the last text ends with the array
                    z = np.vstack([z, np.full((cuts[-1] - len(z) + 1, FILTERS), -np.inf, np.float32)])
                top = np.maximum.reduceat(z, cuts, axis=0)[::2]
                hidden[some, k * FILTERS : (k + 1) * FILTERS] = np.maximum(top + self.net.bias[k], 0)
        return hidden @ self.net.out + self.net.out_bias

    def score(self, logits: np.ndarray, names: list[str]) -> np.ndarray:
        cut = np.array([self.thresholds.get(n, self.default) for n in names])
        return 1 / (1 + np.exp(-np.clip(logits - cut, -50, 50)))


def _start(seen: list[np.ndarray], n0: float, n1: float, rng: np.random.Generator) -> Net:
    """A random net whose first embedding component is each bucket's smoothed log odds, from the texts of each label that have it."""
    embed = rng.normal(0, 0.02, (_PAD + 1, DIM)).astype(np.float32)
    both = seen[0] + seen[1]
    embed[:, 0] = (np.log((seen[1] + 1) / (n1 + 2)) - np.log((seen[0] + 1) / (n0 + 2))) / 2 * both / (both + 4)
    embed[_PAD] = 0
    filters = [rng.normal(0, 0.02, (w, DIM, FILTERS)) for w in WIDTHS]
    for f in filters:  # the first half answers to words of label 1, the other to those of label 0
        f[:, 0, : FILTERS // 2] += 1 / len(f)
        f[:, 0, FILTERS // 2 :] -= 1 / len(f)
    out = np.tile(np.repeat([0.2, 0.0], [FILTERS // 2, FILTERS - FILTERS // 2]), len(WIDTHS))
    return Net(embed, filters, [np.zeros(FILTERS) for _ in WIDTHS], out, -1.5)


def _having(texts: Iterable[np.ndarray], labels: Iterable[float]) -> list[np.ndarray]:
    """How many texts of label 0, and of label 1, have each bucket."""
    seen = [np.zeros(_PAD + 1), np.zeros(_PAD + 1)]
    for ids, y in zip(texts, labels, strict=True):
        seen[int(y)][np.unique(ids)] += 1
    return seen


def fit(texts: list[np.ndarray], labels: np.ndarray, rounds: int = 5, batch: int = 32, rate: float = 0.03, drop: float = 0.3, seed: int = 5, net: Net | None = None, weight: tuple[float, float] = (1.0, 1.0)) -> Net:
    """Adagrad on the logistic loss; only the words at each filter's largest response get a gradient.

    In each step a share ``drop`` of the words is left out, so that no text is known by a few of its words.
    Goes on from ``net``, which is changed, where one is given; the labels count by their ``weight``.
    """
    rng = np.random.default_rng(seed)
    if net is None:
        net = _start(_having(texts, labels), (1 - labels).sum(), labels.sum(), rng)
    share = np.where(labels == 1, weight[1], weight[0])
    seen = [np.full_like(net.embed, 1e-2), [np.full_like(f, 1e-2) for f in net.filters], [np.full(FILTERS, 1e-2) for _ in WIDTHS], np.full_like(net.out, 1e-2), 1e-2]
    for _ in range(rounds):
        order = rng.permutation(len(texts))
        for at in range(0, len(order), batch):
            own = [k for k in order[at : at + batch] if len(texts[k])]
            if not own:
                continue
            some = [texts[k][rng.random(len(texts[k])) >= drop] if len(texts[k]) > 8 else texts[k] for k in own]
            own = [k for k, t in zip(own, some, strict=True) if len(t)]
            some = [t for t in some if len(t)]
            count = np.array([len(t) for t in some])
            ids, start = padded(np.concatenate(some), count)
            y = labels[own]
            vectors = net.embed[ids].sum(1)
            tops, places = [], []
            for k in range(len(WIDTHS)):
                z = sum(vectors[o : len(ids) - WIDTHS[k] + 1 + o] @ net.filters[k][o] for o in range(WIDTHS[k]))
                place = np.stack([a + z[a : a + c].argmax(0) for a, c in zip(start, count, strict=True)])
                places.append(place)
                tops.append(z[place, np.arange(FILTERS)] + net.bias[k])
            hidden = np.maximum(np.hstack(tops), 0)
            pull = (1 / (1 + np.exp(-np.clip(hidden @ net.out + net.out_bias, -50, 50))) - y) * share[own] / len(own)
            back = pull[:, None] * net.out * (hidden > 0)
            g = hidden.T @ pull + 1e-4 * net.out
            seen[3] += g * g
            net.out -= rate * g / np.sqrt(seen[3])
            seen[4] += float(pull.sum()) ** 2
            net.out_bias -= rate * float(pull.sum()) / seen[4] ** 0.5
            words, steps = [], []
            for k, width in enumerate(WIDTHS):
                own_back = back[:, k * FILTERS : (k + 1) * FILTERS]
                g = np.empty_like(net.filters[k])
                for o in range(width):
                    g[o] = np.einsum("bf,bfd->df", own_back, vectors[places[k] + o])
                    step = (own_back[:, :, None] * net.filters[k][o].T[None]).reshape(-1, DIM)
                    for side in (0, 1):
                        words.append(ids[places[k] + o, side].ravel())
                        steps.append(step)
                seen[1][k] += g * g
                net.filters[k] -= rate * g / np.sqrt(seen[1][k])
                b = own_back.sum(0)
                seen[2][k] += b * b
                net.bias[k] -= rate * b / np.sqrt(seen[2][k])
            words, steps = np.concatenate(words), np.vstack(steps)
            unique, inverse = np.unique(words, return_inverse=True)
            g = np.zeros((len(unique), DIM))
            np.add.at(g, inverse, steps)
            g[unique == _PAD] = 0
            seen[0][unique] += g * g
            net.embed[unique] -= rate * g / np.sqrt(seen[0][unique])
    return net


def best_threshold(logits: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> float:
    """The middle of the gap between logits at which the weighted F1 is largest."""
    order = np.argsort(-logits, kind="stable")
    hit, miss = np.cumsum(weight[order] * labels[order]), np.cumsum(weight[order] * (1 - labels[order]))
    f1 = 2 * hit / np.maximum(hit + miss + (weight * labels).sum(), 1e-9)
    k = int(f1.argmax())
    below = logits[order[k + 1]] if k + 1 < len(order) else logits[order[k]] - 2
    return float((logits[order[k]] + below) / 2)


def _in_language(language: language_id.Model | None):
    """(doc_id, label, text) with the language that the whole text is predicted to have."""

    def run(batches):
        for batch in slices(batches, 2):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(language_id.predict(language, batch.column(2), 0.5)[0], pa.string())], names=["doc_id", "label", "text", "lang"])

    return run


def _texts(batch: pa.RecordBatch, column: int) -> Iterator[np.ndarray]:
    """The words' buckets of each text."""
    for piece in pieces(batch.column(column), ALNUM, LOWER):
        ids = buckets(piece).astype(np.int32)
        yield from (ids[piece.bounds[r] : piece.bounds[r + 1]] for r in range(piece.rows))


def _counter(batches):
    """(label, text) -> how many of a task's texts of each label have each bucket, in slices."""
    seen = [np.zeros(_PAD + 1), np.zeros(_PAD + 1)]
    for batch in slices(batches, 1):
        for n, m in zip(seen, _having(_texts(batch, 1), batch.column(0).to_pylist()), strict=True):
            n += m
    rows = [(k, *(n[a:b].astype(np.int64).tobytes() for n in seen)) for k, (a, b) in enumerate(_cuts())]
    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["slice", "n0", "n1"])


def _summed(table: pa.Table) -> pa.Table:
    total = [sum(np.frombuffer(x.as_buffer(), np.int64) for x in table[c]).tobytes() for c in ("n0", "n1")]
    return pa.table({"slice": table["slice"][:1].cast(pa.int32()), "n0": pa.array(total[:1], pa.binary()), "n1": pa.array(total[1:], pa.binary())})


def _cuts() -> list[tuple[int, int]]:
    """The slices of buckets in which counts and changes travel."""
    at = np.linspace(0, _PAD + 1, 65).astype(int).tolist()
    return list(zip(at, at[1:], strict=False))


def _flat(net: Net) -> np.ndarray:
    """All but the embeddings."""
    return np.concatenate([*[f.ravel() for f in net.filters], *net.bias, net.out, [net.out_bias]])


def _unflat(embed: np.ndarray, flat: np.ndarray, like: Net) -> Net:
    at = np.cumsum([0, *[f.size for f in like.filters], *[len(b) for b in like.bias], len(like.out)])
    own = [flat[a:b] for a, b in zip(at, at[1:], strict=False)]
    n = len(like.filters)
    return Net(embed, [x.reshape(f.shape) for x, f in zip(own[:n], like.filters, strict=True)], own[n:-1], own[-1], float(flat[-1]))


def _part_fitter(shared, weight: tuple[float, float]):
    """A part's texts -> the changes of the net that they make: of the embeddings in slices, of the rest as slice -1."""

    def run(table: pa.Table) -> pa.Table:
        start: Net = shared.value
        table = table.sort_by([("doc_id", "ascending"), ("label", "ascending"), ("text", "ascending")])
        labels, part = table["label"].to_numpy().astype(float), table["part"][0].as_py()
        texts = [ids for batch in slices(iter(table.select(["text"]).to_batches()), 0) for ids in _texts(batch, 0)]
        net = fit(texts, labels, seed=5 + part, net=_unflat(start.embed.copy(), _flat(start), start), weight=weight)
        step = net.embed - start.embed
        moved = np.flatnonzero(step.any(1)).astype(np.int32)
        cuts = np.searchsorted(moved, [a for a, _ in _cuts()] + [_PAD + 1])
        rows = [(-1, b"", (_flat(net) - _flat(start)).tobytes())]
        rows += [(k, moved[a:b].tobytes(), step[moved[a:b]].tobytes()) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if a < b]
        tidy()
        return pa.table({"slice": pa.array([r[0] for r in rows], pa.int32()), "moved": pa.array([r[1] for r in rows], pa.binary()), "step": pa.array([r[2] for r in rows], pa.binary())})

    return run


def _averaged(table: pa.Table) -> pa.Table:
    """The parts' changes of a slice -> their mean over the parts that changed a bucket."""
    kind, steps = table["slice"][0].as_py(), [x.as_buffer() for x in table["step"]]
    if kind < 0:
        moved, mean = b"", np.mean([np.frombuffer(x) for x in steps], 0)
    else:
        ids, which = np.unique(np.concatenate([np.frombuffer(x.as_buffer(), np.int32) for x in table["moved"]]), return_inverse=True)
        total = np.zeros((len(ids), DIM))
        np.add.at(total, which, np.concatenate([np.frombuffer(x, np.float32).reshape(-1, DIM) for x in steps]))
        moved, mean = ids.tobytes(), (total / np.bincount(which)[:, None]).astype(np.float32)
    return pa.table({"slice": pa.array([kind], pa.int32()), "moved": pa.array([moved], pa.binary()), "step": pa.array([mean.tobytes()], pa.binary())})


#: Logits are counted in steps of a part of 1 for the thresholds.
_FINE = 256


def _placer(net: Net):
    """(lang, label, text) -> language, label and place of the logit."""

    def run(batches):
        tables, model = net.tables(), Model(net, None, {}, 0.0)
        for batch in slices(batches, 2):
            logits = np.empty(batch.num_rows)
            for piece in pieces(batch.column(2), ALNUM, LOWER):
                logits[piece.first : piece.first + piece.rows] = model.logits(piece, tables)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.floor(np.clip(logits, -50, 50) * _FINE).astype(np.int32))], names=["lang", "label", "place"])

    return run


#: A language with so many examples of its rarer class has a threshold half-way between its own and that of all.
SHRINK = 20


def train(docs: DataFrame, labels: DataFrame, column: str = "toxic", part_bytes: int = 16 << 20, language: language_id.Model | None = None) -> Model | None:
    """Fits on all labelled documents outside the held-out fifth, whole texts of them; None without any.

    A fifth of them, by a hash of doc_id, is kept from training for the
    thresholds, and one document at least of each predicted language and label
    that has two; each language of which both classes are kept gets its own,
    drawn towards the threshold of all by how few examples it has.  The others go in
    parts of about ``part_bytes`` of text; each fits the net that starts from
    all texts' counts, and the parts' changes are averaged.  Both labels weigh
    the same.  The driver gets the net, and counts of logits by language.
    """
    spark = docs.sparkSession
    small_batches(spark)
    known = labels.select("doc_id", F.col(column).cast("int").alias("label")).where((fold() != 0) & F.col("label").isin(0, 1)).distinct()
    # labels grow with the documents: the same join at every size, and no table in the driver
    texts = docs.select("doc_id", "text").where("text is not null").join(known.hint("merge"), "doc_id").select("doc_id", "label", "text")
    rows = stored(texts.mapInArrow(_in_language(language), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, label int, text string, lang string"), "labelled")
    place = F.xxhash64(F.lit("kept"), "doc_id")
    firsts = rows.groupBy("lang", "label").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first < last").collect()
    chosen = F.pmod(place, F.lit(5)) == 0
    if firsts:
        first = F.create_map(*[F.lit(x) for r in firsts for x in (f"{r['label']}{r['lang']}", r["first"])])
        chosen = chosen | F.coalesce(place == F.try_element_at(first, F.concat(F.col("label").cast("string"), "lang")), F.lit(False))
    rows = rows.withColumn("kept", chosen)
    totals = {(r["kept"], r["label"]): r for r in rows.groupBy("kept", "label").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("size")).collect()}
    if not totals:
        return None
    n0, n1 = (totals[False, y]["n"] if (False, y) in totals else 0 for y in (0, 1))
    n_parts = max(1, -(-sum(r["size"] for (k, _), r in totals.items() if not k) // part_bytes))
    learn = rows.where("NOT kept")
    seen = [np.zeros(_PAD + 1), np.zeros(_PAD + 1)]
    cuts = _cuts()
    for r in learn.select("label", "text").mapInArrow(_counter, "slice int, n0 binary, n1 binary").groupBy("slice").applyInArrow(_summed, "slice int, n0 binary, n1 binary").collect():
        for n, x in zip(seen, (r["n0"], r["n1"]), strict=True):
            n[slice(*cuts[r["slice"]])] = np.frombuffer(x, np.int64)
    net = _start(seen, n0, n1, np.random.default_rng(5))
    weight = tuple((n0 + n1) / (2 * n) if n else 1.0 for n in (n0, n1))
    dealt = learn.select("doc_id", "label", "text", F.pmod(F.xxhash64(F.lit("part"), "doc_id"), F.lit(n_parts)).cast("int").alias("part"))
    steps = dealt.groupBy("part").applyInArrow(_part_fitter(spark.sparkContext.broadcast(net), weight), "slice int, moved binary, step binary")
    embed, flat = net.embed.copy(), _flat(net)
    for r in steps.groupBy("slice").applyInArrow(_averaged, "slice int, moved binary, step binary").collect():
        if r["slice"] < 0:
            flat = flat + np.frombuffer(r["step"])
        else:
            embed[np.frombuffer(r["moved"], np.int32)] += np.frombuffer(r["step"], np.float32).reshape(-1, DIM)
    model = Model(_unflat(embed, flat, net), language, {}, 0.0)
    placed = rows.where("kept").select("lang", "label", "text").mapInArrow(_placer(model.net), "lang string, label int, place int")
    # of equal places those of label 0 come first, so that a threshold never falls between them
    found = placed.groupBy("lang", "label", "place").count().orderBy("label", "lang", "place").collect()
    names = np.array([r["lang"] for r in found])
    y, n, logits = (np.array(x, float) for x in ([r["label"] for r in found], [r["count"] for r in found], [(r["place"] + 0.5) / _FINE for r in found]))
    model.default = best_threshold(logits, y, n) if found else 0.0
    for name in sorted(set(names.tolist())):
        own = names == name
        few = int(min((n * y)[own].sum(), (n * (1 - y))[own].sum()))
        if few:  # the fewer examples of a class, the nearer to the default
            part = few / (few + SHRINK)
            model.thresholds[name] = part * best_threshold(logits[own], y[own], n[own]) + (1 - part) * model.default
    return model


def _logit_of(model: Model, ids: np.ndarray, tables: list[list[np.ndarray]]) -> float:
    hidden = np.zeros(len(WIDTHS) * FILTERS)
    if len(ids):
        long, _ = padded(ids, np.array([len(ids)]))
        for k in range(len(WIDTHS)):
            hidden[k * FILTERS : (k + 1) * FILTERS] = np.maximum(responses(tables[k], long)[: len(ids)].max(0) + model.net.bias[k], 0)
    return float(hidden @ model.net.out + model.net.out_bias)


def _scorer(model: Model | None, n_columns: int, text_at: int, names: list[str]):
    def run(batches):
        tables = model.net.tables() if model is not None else []
        for batch in slices(batches, text_at):
            score = np.zeros(batch.num_rows)
            if model is not None:
                texts = batch.column(text_at)
                logits = np.empty(batch.num_rows)
                for piece in pieces(texts, ALNUM, LOWER):
                    logits[piece.first : piece.first + piece.rows] = model.logits(piece, tables)
                score = model.score(logits, language_id.predict(model.language, texts, 0.5)[0])
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in range(n_columns)], pa.array(score)], names=[*names, "score"])

    return run


def score_toxicity(docs: DataFrame, model: Model | None) -> DataFrame:
    """Adds score double (0 to 1; 0.5 and more is toxic by the threshold of the text's predicted language).

    ``docs`` has text (string); other columns are carried along, but one named
    score is replaced.  A null or empty text has no response and gets the
    score of the biases; without a model every score is 0.  Whole texts count,
    however long; rows are scored one by one, so repeated ones get the same score,
    and an empty table gives no rows.
    """
    columns = [c for c in docs.columns if c != "score"]
    small_batches(docs.sparkSession)
    out = docs.select([F.col(f"`{c}`") for c in columns])
    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema.fields)
    return out.mapInArrow(_scorer(model, len(columns), columns.index("text"), columns), f"{own}, score double")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), language=language_id.train(docs, 200))
    out = score_toxicity(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
