"""Log probabilities of texts by a small causal self-attention model on subword ids.

A text is its lower-cased words and an end.  A subword model that is given
turns each word into piece ids; the network reads the ids so far and gives a
distribution over classes of pieces: each frequent piece is a class of its own,
rarer ones share classes by kind and frequency.  Inside a class a piece's share
follows from its count in all learning documents.

The network is one layer: queries, keys and values of the last pieces, a bias
by distance, and a hidden layer on top of what was attended to and the piece
itself.  It is trained in numpy by Adam on all learning documents: one block
starts it, all blocks go on from there side by side, and their weights are
averaged.  A text is scored in windows of 2 x STEP pieces that overlap by half:
all positions of the second half see the first, and each is scored once; windows
of many texts are taken together, with masked places where a text begins or ends.

A word's probability is ``mix`` of its share among all learning tokens and the
rest of what the network gives: its pieces, given that the first begins a word,
and then that the next piece begins one too.  Both sum to 1 over all words, and
so does the mixture, whose part is fitted by expectation maximisation over all
learning words, each as it was just before it was learnt from, with its own
occurrence left out of its count.

Word counts cover all learning documents.  Texts are cut into blocks; a block
sends the counts of its distinct words to the parts of their hashes, and gets
the totals back.  So no word travels more than once a block, however often it
occurs, and no task or driver holds the vocabulary.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .segmentation import model_path
from .shared import parts, release, small_batches, stored, tidy
from .words import LOWER, WHITE, Piece, gathered, mix

#: Bytes of text of a block.
BLOCK_BYTES = 4 << 20
#: Places that are scored in a window; as many before them are context.
STEP = 16
_WINDOWS = 256
_START, _END = 1, 2
_PACKED = pa.schema([("block", pa.int64()), ("part", pa.int32()), ("ids", pa.list_(pa.int64())), ("held_out", pa.list_(pa.bool_())), ("n_words", pa.binary()), ("codes", pa.binary()), ("pieces", pa.binary()), ("n_pieces", pa.binary()), ("words", pa.binary()), ("counts", pa.binary()), ("n_learn", pa.int64()), ("piece_ids", pa.binary()), ("piece_counts", pa.binary())])
_PACKED_DDL = "block long, part int, ids array<long>, held_out array<boolean>, n_words binary, codes binary, pieces binary, n_pieces binary, words binary, counts binary, n_learn long, piece_ids binary, piece_counts binary"
#: The end of a text, among the words' hashes.
_END_HASH = np.uint64(0x51A7C3E59B0D2F68)


class Pieces:
    """A SentencePiece model that tasks open from its bytes."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.data = f.read()
        self.model = None

    def __getstate__(self):
        return {"data": self.data, "model": None}

    def of(self, words: list[bytes]) -> list[list[int]]:
        if self.model is None:
            import sentencepiece

            self.model = sentencepiece.SentencePieceProcessor(model_proto=self.data)
        return self.model.encode(words, num_threads=1) if words else []

    def begins_word(self) -> np.ndarray:
        self.of([b"a"])
        return np.array([self.model.id_to_piece(i).startswith("▁") for i in range(self.model.get_piece_size())])


def sequences(codes: np.ndarray, n_words: np.ndarray, pieces: np.ndarray, n_pieces: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The piece ids of texts one after the other, each with a start in front and an end behind, and where they begin."""
    first = np.cumsum(n_pieces) - n_pieces
    size = n_pieces[codes]
    ends = np.concatenate([[0], np.cumsum(size)])
    at = np.repeat(first[codes] - ends[:-1], size) + np.arange(int(ends[-1]))
    bounds = np.cumsum(n_words) - n_words
    length = ends[np.append(bounds[1:], len(codes))] - ends[bounds] if len(n_words) else np.empty(0, np.int64)
    start = np.cumsum(length + 2) - length - 2
    out = np.zeros(int((length + 2).sum()), np.int32)
    out[start], out[start + length + 1] = _START, _END
    inner = np.ones(len(out), bool)
    inner[start] = inner[start + length + 1] = False
    out[inner] = pieces[at]
    return out, np.append(start, len(out))


def windows(start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of texts that begin at ``start`` (the last entry is the end): each window's first scored place, and its text."""
    n = np.diff(start) - 1  # what follows each place but the last is predicted
    count = -(-n // STEP)
    text = np.repeat(np.arange(len(n)), count)
    return start[text] + STEP * (np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)), text


def by_word(found: np.ndarray, stop: np.ndarray, start: np.ndarray, codes: np.ndarray, n_words: np.ndarray, n_pieces: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """From log probabilities at places (see ``Network.places``) those of each word, and of each text's end."""
    size = n_pieces[codes]
    text = np.repeat(np.arange(len(n_words)), n_words)
    first = np.cumsum(size) - size + 2 * text + 1  # a start and the ends of texts lie between
    last = first + size - 1
    # sums of a word's own places, not differences of running sums, which depend on what lies before
    own = np.add.reduceat(found, np.stack([first - 1, last], 1).ravel())[::2] - stop[first - 1] + stop[last] if len(codes) else np.empty(0)
    end = start[1:] - 2
    return own, found[end] - stop[end]


@dataclass
class Network:
    """The trained weights, and how pieces are numbered: inputs (the last one masks), classes, their shares within their class, and how many classes begin a word."""

    weights: dict[str, np.ndarray]
    input_of: np.ndarray
    class_of: np.ndarray
    log_share: np.ndarray
    n_begin: int
    mix: float = 0.0

    def __post_init__(self):
        w, d = self.weights, self.weights["query"].shape[0]
        e = w["embedding"]
        self.query, self.key, self.own = (e @ w["query"]) / np.float32(np.sqrt(d)), e @ w["key"], e @ w["own"]
        value = np.concatenate([e @ w["value"], np.ones((len(e), 1), np.float32)], 1)
        value[-1] = 0  # a masked place adds nothing to the sum or the weights
        self.value = value
        self.near = np.exp(_bias(w["distance"])) * _CAUSAL
        first = np.arange(len(w["bias"])) < self.n_begin
        self.sides = np.exp(w["bias"])[:, None] * np.stack([first, ~first], 1).astype(np.float32)

    def places(self, ids: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """At each place of texts (see ``sequences``) the log probability of the piece after it, and that any piece after it begins a word."""
        at, text = windows(start)
        found, stop = np.zeros(len(ids)), np.zeros(len(ids))
        place, ahead = np.arange(-STEP, STEP), np.arange(STEP)
        x, share, kind = self.input_of[ids], self.log_share[ids], self.class_of[ids]
        mask, d, out, bias = len(self.query) - 1, self.query.shape[1], self.weights["out"], self.weights["bias"]
        begin, end, classes = start[text], start[text + 1], out.shape[1]
        for a in range(0, len(at), _WINDOWS):
            own, first, behind = (v[a : a + _WINDOWS, None] for v in (at, begin, end))
            p = own + place
            k = np.where((p >= first) & (p < behind), x.take(p, mode="clip"), mask)
            q = k[:, STEP:]
            s = np.matmul(self.query.take(q, 0), self.key.take(k, 0).transpose(0, 2, 1))
            np.exp(s, out=s)
            s *= self.near
            o = np.matmul(s, self.value.take(k, 0))
            h = o[..., :d] / np.maximum(o[..., d:], 1e-30)
            h += self.own.take(q, 0)
            np.tanh(h, out=h)
            # a product for each window: a row of one for all depends, in its last bits, on where it lies
            z = np.matmul(h, out)
            # of a window's places only those before another piece of the text are scored
            to = own + ahead + 1
            there = to < behind
            to, row = to[there], np.flatnonzero(there)
            picked = z.ravel().take(row * classes + kind[to]) + bias[kind[to]]
            np.exp(z, out=z)
            # the bias enters as a factor of the exponentials, in the product that sums them by side
            sides = np.matmul(z, self.sides).reshape(-1, 2)[row]
            total = np.log(sides[:, 0] + sides[:, 1])
            found[to - 1] = picked - total + share[to]
            stop[to - 1] = np.log(sides[:, 0]) - total
        return found, stop

    def words(self, codes: np.ndarray, n_words: np.ndarray, pieces: np.ndarray, n_pieces: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The network's log probability of each word of texts, and of each text's end."""
        ids, start = sequences(codes, n_words, pieces, n_pieces)
        return by_word(*self.places(ids, start), start, codes, n_words, n_pieces)

    def log10(self, own: np.ndarray, share: np.ndarray) -> np.ndarray:
        """The mixture's log probability of words that the network gives ``own`` and that have a share of the learning tokens."""
        return np.log10(self.mix * share + (1 - self.mix) * np.exp(own) + 1e-300)


_AWAY = np.arange(STEP)[:, None] + STEP - np.arange(2 * STEP)[None, :]
_CAUSAL = (_AWAY >= 0).astype(np.float32)


def _bias(distance: np.ndarray) -> np.ndarray:
    return distance[np.maximum(_AWAY, 0)]


def numbering(counts: np.ndarray, begins: np.ndarray, inputs: int, classes: int, shared: int = 32) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Pieces' inputs, classes and log shares within their class, from their counts in all learning texts, and how many classes begin a word.

    The most frequent have a class of their own; the others form ``shared``
    classes of about equal mass.  Classes of pieces that begin a word, and of
    the end, come before the others.
    """
    begins = begins.copy()
    begins[_END] = True
    order = np.argsort(-counts, kind="stable")
    input_of = np.full(len(counts), inputs - 2, np.int32)
    input_of[order[: inputs - 2]] = np.arange(min(inputs - 2, len(counts)))
    alone, half = order[: classes - shared], shared // 2
    first = begins[alone]
    n_begin = int(first.sum()) + half
    class_of = np.zeros(len(counts), np.int32)
    class_of[alone[first]], class_of[alone[~first]] = np.arange(first.sum()), n_begin + np.arange((~first).sum())
    mass = counts + 0.5
    for side, at in ((True, n_begin - half), (False, classes - half)):
        rest = order[classes - shared :]
        rest = rest[begins[rest] == side]
        if len(rest):
            run = np.cumsum(mass[rest])
            class_of[rest] = at + np.minimum((run - mass[rest]) / run[-1] * half, half - 1).astype(np.int32)
    total = np.bincount(class_of, mass, minlength=classes)
    return input_of, class_of, np.log(mass / total[class_of]).astype(np.float32), n_begin


#: The weights, as they lie one after the other.
_NAMES = ("embedding", "key", "value", "query", "own", "distance", "out", "bias")
#: Places whose classes are scored at once while learning, so that a core's cache holds them.
_AT_ONCE = 1024


def begin(seen: np.ndarray, inputs: int, classes: int, width: int, seed: int = 5) -> dict[str, np.ndarray]:
    """Random weights, with biases from how often each class was seen; a masked place has no embedding."""
    rng = np.random.default_rng(seed)
    new = lambda *shape, by=1.0: (rng.normal(size=shape) * by).astype(np.float32)
    w = {"embedding": new(inputs, width, by=0.3), **{k: new(width, width, by=width**-0.5) for k in ("query", "key", "value", "own")}, "distance": np.zeros(2 * STEP, np.float32), "out": new(width, classes, by=width**-0.5)}
    w["embedding"][-1] = 0
    w["bias"] = np.log((seen + 1.0) / (seen + 1.0).sum()).astype(np.float32)
    return {k: w[k] for k in _NAMES}


def _views(flat: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    at = np.cumsum([0, *[x.size for x in like.values()]])
    return {k: flat[a:b].reshape(x.shape) for (k, x), a, b in zip(like.items(), at, at[1:], strict=False)}


def _flat(w: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([w[k].ravel() for k in _NAMES])


def _by_id(ids: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """The sum of the rows of each id."""
    order = np.argsort(ids, kind="stable")
    key = ids[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    out = np.zeros((n, rows.shape[1]), rows.dtype)
    out[key[first]] = np.add.reduceat(rows.take(order, 0), first, axis=0)
    return out


def learn(w: dict[str, np.ndarray], ids: np.ndarray, start: np.ndarray, numbers: tuple[np.ndarray, np.ndarray, np.ndarray, int], rounds: int, batch: int, rate: float, seed: int) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """Goes on from ``w`` by Adam on the cross entropy of the next piece's class, over all windows of the texts.

    Also returns what ``Network.places`` does, as the weights were just before
    they learnt from a place (for the last time).
    """
    input_of, class_of, log_share, n_begin = numbers
    (inputs, d), classes = w["embedding"].shape, len(w["bias"])
    flat = _flat(w)
    grad, first, second = np.zeros_like(flat), np.zeros_like(flat), np.zeros_like(flat)
    w, g = _views(flat, w), _views(grad, w)
    # the biases lie behind the output weights: one product with a 1 behind what is hidden
    out, g_out = (x[-(d + 1) * classes :].reshape(d + 1, classes) for x in (flat, grad))
    found, stop = np.zeros(len(ids)), np.zeros(len(ids))
    at, text = windows(start)
    begins, ends, mask, place, ahead = start[text], start[text + 1], inputs - 1, np.arange(-STEP, STEP), np.arange(STEP)
    x, kind = input_of[ids].astype(np.int16 if inputs < 1 << 15 else np.int32), class_of[ids]
    sides = (np.arange(classes)[:, None] < n_begin) == np.array([True, False])
    sides, scores = sides.astype(np.float32), np.empty((_AT_ONCE, classes), np.float32)
    rng, scale, away = np.random.default_rng(seed), np.float32(d**-0.5), np.maximum(_AWAY, 0).ravel()
    steps, done = max(1, rounds * -(-len(at) // batch)), 0
    for _ in range(rounds):
        order = rng.permutation(len(at))
        for a in range(0, len(order), batch):
            some = order[a : a + batch]
            own, behind, n = at[some][:, None], ends[some][:, None], len(some)
            p = own + place
            k_in = np.where((p >= begins[some][:, None]) & (p < behind), x.take(p, mode="clip"), x.dtype.type(mask))
            to = own + ahead + 1
            there = to < behind
            e, keys, queries = w["embedding"], np.concatenate([w["key"], w["value"]], 1), np.concatenate([w["query"] * scale, w["own"]], 1)
            # a key, its value and a 1; a masked place has none
            table = np.ones((inputs, 2 * d + 1), np.float32)
            np.matmul(e, keys, out=table[:, : 2 * d])
            table[mask] = 0
            kv, qo = table.take(k_in, 0), (e @ queries).take(k_in[:, STEP:], 0)
            k, v, q = kv[..., :d], kv[..., d:], qo[..., :d]
            s = np.matmul(q, k.transpose(0, 2, 1))
            np.minimum(s, 60, out=s)
            np.exp(s, out=s)
            s *= np.exp(_bias(w["distance"])) * _CAUSAL
            o = np.matmul(s, v)
            part = 1 / np.maximum(o[..., d:], 1e-30)
            o = o[..., :d] * part
            h = np.ones((n * STEP, d + 1), np.float32)
            hidden = np.tanh(o + qo[..., d:])
            h[:, :d] = hidden.reshape(-1, d)
            # each place's scores, and the loss's derivatives by them
            weight = there.ravel() * np.float32(1 / max(1, there.sum()))
            goal = np.where(there, kind.take(to, mode="clip"), 0).ravel()
            dh, here, ending = np.empty((n * STEP, d), np.float32), np.empty(n * STEP, np.float32), np.empty(n * STEP, np.float32)
            g_out[:] = 0
            for c in range(0, n * STEP, _AT_ONCE):
                now = slice(c, c + _AT_ONCE)
                z = scores[: len(h[now])]
                np.matmul(h[now], out, out=z)
                np.exp(z, out=z)
                side = z @ sides
                by = 1 / (side[:, 0] + side[:, 1])
                pick = np.arange(0, z.size, classes) + goal[now]
                here[now], ending[now] = z.ravel().take(pick) * by, side[:, 0] * by
                z *= (by * weight[now])[:, None]
                z.ravel()[pick] -= weight[now]
                g_out += (z.T @ h[now]).T
                np.matmul(z, w["out"].T, out=dh[now])
            row = np.flatnonzero(there)
            found[to[there] - 1], stop[to[there] - 1] = here[row], ending[row]
            # backwards
            dh = dh.reshape(n, STEP, d) * (1 - hidden * hidden)
            dkv, dqo, inner = np.empty((n, 2 * STEP, 2 * d), np.float32), np.empty_like(qo), np.empty((n, STEP, d + 1), np.float32)
            np.multiply(dh, part, out=inner[..., :d])
            inner[..., d] = -np.einsum("bij,bij->bi", inner[..., :d], o)
            ds = np.matmul(inner, v.transpose(0, 2, 1))
            ds *= s
            dkv[..., :d], dkv[..., d:] = np.matmul(ds.transpose(0, 2, 1), q), np.matmul(s.transpose(0, 2, 1), inner[..., :d])
            dqo[..., :d], dqo[..., d:] = np.matmul(ds, k), dh
            g["distance"][:] = np.bincount(away, ds.sum(0).ravel(), minlength=2 * STEP)
            ek = e.take(k_in, 0)
            g_keys, g_queries = ek.reshape(-1, d).T @ dkv.reshape(-1, 2 * d), ek[:, STEP:].reshape(-1, d).T @ dqo.reshape(-1, 2 * d)
            g["key"][:], g["value"][:], g["query"][:], g["own"][:] = g_keys[:, :d], g_keys[:, d:], g_queries[:, :d] * scale, g_queries[:, d:]
            de = (dkv.reshape(-1, 2 * d) @ keys.T).reshape(n, 2 * STEP, d)
            de[:, STEP:] += (dqo.reshape(-1, 2 * d) @ queries.T).reshape(n, STEP, d)
            g["embedding"][:] = _by_id(k_in.ravel(), de.reshape(-1, d), inputs)
            g["embedding"][mask] = 0
            # Adam's step
            done += 1
            first *= np.float32(0.9)
            first += np.float32(0.1) * grad
            second *= np.float32(0.99)
            grad *= grad
            second += np.float32(0.01) * grad
            step = np.sqrt(second)
            step *= np.float32((1 - 0.99**done) ** -0.5)
            step += np.float32(1e-8)
            np.divide(first, step, out=step)
            step *= np.float32(rate * (1 - 0.95 * done / steps) / (1 - 0.9**done))
            flat -= step
    some = stop > 0
    found[some] = np.log(np.maximum(found[some], 1e-30))
    stop[some] = np.log(stop[some])
    found[:-1][some[:-1]] += log_share[ids[1:]][some[:-1]]
    return {k: x.copy() for k, x in w.items()}, found, stop


def train(ids: np.ndarray, start: np.ndarray, numbers: tuple[np.ndarray, np.ndarray, np.ndarray, int], inputs: int, classes: int, width: int, rounds: int = 2, batch: int = 64, rate: float = 0.01, seed: int = 5) -> Network:
    """A network that has learnt from texts alone."""
    seen = np.bincount(numbers[1][ids], minlength=classes)
    return Network(learn(begin(seen, inputs, classes, width, seed), ids, start, numbers, rounds, batch, rate, seed)[0], *numbers)


#: Ratios of a word's share to what the network gives it are counted in so many steps of a nat, up to so many nats to either side.
_FINE, _FAR = 32, 32


def ratios(own: np.ndarray, count: np.ndarray, total: int) -> np.ndarray:
    """How many learning words have each ratio of their share, their own occurrence left out, to what the network gives them."""
    share = (count - 1) / max(1, total - 1)
    return np.bincount(np.clip((np.log(share + 1e-300) - own + _FAR) * _FINE, 0, 2 * _FAR * _FINE - 1).astype(np.int64), minlength=2 * _FAR * _FINE)


def part_of_counts(seen: np.ndarray, rounds: int = 30) -> float:
    """The part of the counts in the mixture, by expectation maximisation over words' ratios."""
    if not seen.sum():
        return 0.0
    ratio, part = np.exp((np.arange(len(seen)) + 0.5) / _FINE - _FAR), 0.5
    for _ in range(rounds):
        a = part * ratio
        part = float((a / (a + 1 - part)) @ seen / seen.sum())
    return min(part, 0.99)


def fit_mix(own: np.ndarray, count: np.ndarray, total: int, rounds: int = 30) -> float:
    """The part of the counts in the mixture, from learning words."""
    return part_of_counts(ratios(own, count, total), rounds)


def _packer(shared, n_parts: int):
    """Rows (struct of doc_id and held_out, text) -> a row for each block, and one for each part with the block's words of that part."""

    def run(batches):
        task, number = TaskContext.get().partitionId() << 32, 0
        for keys, data, offsets in gathered(batches, BLOCK_BYTES):
            piece = Piece(0, data, offsets, WHITE, LOWER)
            h, at, code = np.unique(piece.hashes(), return_index=True, return_inverse=True)
            part = (mix(h) % np.uint64(n_parts)).astype(np.int32)
            order = np.argsort(part, kind="stable")
            h, at, part = h[order], at[order], part[order]
            place = np.empty(len(h), np.int32)
            place[order] = np.arange(len(h))
            code = place[code]
            text = piece.data.tobytes()
            own = [p or [0] for p in shared.value.of([text[a:b] for a, b in zip(piece.start[at].tolist(), piece.end[at].tolist(), strict=True)])]
            n_pieces = np.array([len(p) for p in own], np.int32)
            flat = np.array([i for p in own for i in p], np.int32)
            learn = np.array([not k["held_out"] for k in keys], bool)
            count = np.bincount(code[np.repeat(learn, piece.count)], minlength=len(h)).astype(np.int64)
            ids, which = np.unique(flat, return_inverse=True)
            used = np.bincount(which, np.repeat(count, n_pieces), minlength=len(ids)).astype(np.int64)
            rows = [(task + number, -1, [k["doc_id"] for k in keys], (~learn).tolist(), *(x.astype(t).tobytes() for x, t in ((piece.count, np.int64), (code, np.int32), (flat, np.int32), (n_pieces, np.int32))), None, None, int(learn.sum()), ids.astype(np.int32).tobytes(), used.tobytes())]
            cuts = np.append(np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else 0, len(part))
            for a, b in zip(cuts, cuts[1:], strict=False):
                rows.append((task + number, int(part[a]), None, None, None, None, None, None, h[a:b].tobytes(), count[a:b].tobytes(), None, None, None))
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), _PACKED, strict=True)], schema=_PACKED)
            number += 1
            del piece, text, own, flat, rows, code
            tidy()

    return run


def _totals(table: pa.Table) -> pa.Table:
    """A part's words of all blocks -> the blocks' words' totals, and one row with the number of words that have any."""
    h = [np.frombuffer(x, np.uint64) for x in table["words"].to_pylist()]
    _, which = np.unique(np.concatenate(h), return_inverse=True)
    total = np.zeros(which.max() + 1 if len(which) else 0, np.int64)
    np.add.at(total, which, np.concatenate([np.frombuffer(x, np.int64) for x in table["counts"].to_pylist()]))
    ends = np.cumsum([len(x) for x in h])
    totals = [total[which[b - len(x) : b]].tobytes() for x, b in zip(h, ends, strict=True)]
    part = table["part"][0].as_py()
    tidy()
    return pa.table({"block": pa.array([*table["block"].to_pylist(), -1], pa.int64()), "part": pa.array([part] * (len(h) + 1), pa.int32()), "counts": pa.array([*totals, None], pa.binary()), "n": pa.array([*[None] * len(h), int((total > 0).sum())], pa.int64())})


def _sum_pieces(batches):
    total: dict[int, int] = {}
    for batch in batches:
        for ids, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for i, c in zip(np.frombuffer(ids, np.int32).tolist(), np.frombuffer(counts, np.int64).tolist(), strict=True):
                total[i] = total.get(i, 0) + c
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(list(total.values()), pa.int64())], names=["piece", "n"])


def _arrays(row: dict, totals: list[tuple[int, bytes]]) -> tuple[np.ndarray, ...]:
    """A block's words per text, word codes, pieces, pieces per word and total counts of words."""
    get = lambda c, t: np.frombuffer(row[c], t)
    counts = np.concatenate([np.empty(0, np.int64), *[np.frombuffer(c, np.int64) for _, c in sorted(totals)]])
    return get("n_words", np.int64), get("codes", np.int32).astype(np.int64), get("pieces", np.int32), get("n_pieces", np.int32).astype(np.int64), counts


_SCORED = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def _scorer(shared, n: int, distinct: int, n_learn: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        net: Network = shared.value
        out = []
        for row in left.to_pylist():
            n_words, codes, pieces, n_pieces, counts = _arrays(row, list(zip(right["part"].to_pylist(), right["counts"].to_pylist(), strict=True)))
            text = np.repeat(np.arange(len(n_words)), n_words)
            c = counts[codes]
            add = lambda x: np.bincount(text, x, minlength=len(n_words))
            base = lambda x: np.log10((x + 0.1) / (n + 0.1 * (distinct + 1)))
            own, end = net.words(codes, n_words, pieces, n_pieces)
            score = add(net.log10(own, c / max(1, n))) + net.log10(end, np.array(n_learn / max(1, n)))
            known = add(c > 0).astype(np.int64) + (n_learn > 0)
            out.append(pa.Table.from_arrays([pa.array(row["ids"], pa.int64()), pa.array(row["held_out"], pa.bool_()), pa.array(n_words + 1), pa.array(known), pa.array(add(base(counts)[codes]) + base(n_learn)), pa.array(score)], schema=_SCORED))
        tidy()
        return pa.concat_tables(out) if out else _SCORED.empty_table()

    return run


def _cuts(n: int) -> list[tuple[int, int]]:
    """The slices in which ``n`` weights travel."""
    at = np.linspace(0, n, 33).astype(int).tolist()
    return list(zip(at, at[1:], strict=False))


_LEARNT_DDL = "slice int, block long, places long, data binary"


def _fitter(shared, numbers, n: int, batch: int, rate: float):
    """A block's learning texts -> the weights that go on from the shared ones over all of them, in slices, and as slice -1 its words' ratios."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        for row in left.to_pylist():
            n_words, codes, pieces, n_pieces, counts = _arrays(row, list(zip(right["part"].to_pylist(), right["counts"].to_pylist(), strict=True)))
            known = ~np.array(row["held_out"], bool)
            if not known.any():
                continue
            codes, n_words = codes[np.repeat(known, n_words)], n_words[known]
            ids, start = sequences(codes, n_words, pieces, n_pieces)
            w, found, stop = learn(shared.value, ids, start, numbers.value, 1, batch, rate, 5)
            own, _ = by_word(found, stop, start, codes, n_words, n_pieces)
            flat = _flat(w)
            rows.append((-1, row["block"], len(ids), ratios(own, counts[codes], n).tobytes()))
            rows += [(k, row["block"], len(ids), flat[a:b].tobytes()) for k, (a, b) in enumerate(_cuts(len(flat)))]
        tidy()
        return pa.table({"slice": pa.array([r[0] for r in rows], pa.int32()), "block": pa.array([r[1] for r in rows], pa.int64()), "places": pa.array([r[2] for r in rows], pa.int64()), "data": pa.array([r[3] for r in rows], pa.binary())})

    return run


def _averaged(table: pa.Table) -> pa.Table:
    """A slice of all blocks' weights -> their mean, by blocks' places; the sum of the ratios."""
    kind = table["slice"][0].as_py()
    order = np.argsort(table["block"].to_numpy())
    data, places = table["data"].combine_chunks(), table["places"].to_numpy()
    total = 0
    for k in order:
        total = total + (np.frombuffer(data[k].as_buffer(), np.int64) if kind < 0 else np.frombuffer(data[k].as_buffer(), np.float32) * float(places[k]))
    total = total if kind < 0 else (total / places.sum()).astype(np.float32)
    return pa.table({"slice": pa.array([kind], pa.int32()), "data": pa.array([total.tobytes()], pa.binary())})


def _learn(left: DataFrame, right: DataFrame, used: np.ndarray, begins: np.ndarray, n: int, first: int | None, inputs: int, classes: int, width: int) -> Network:
    """The network and the mixture's part, from all learning texts.

    Block ``first`` starts the network; then all blocks go on from there side
    by side, over all of their learning texts, and their weights are averaged.
    The words' ratios are taken just before each is learnt from.
    """
    spark = left.sparkSession
    numbers = numbering(used, begins, inputs, classes)
    w, seen = begin(np.bincount(numbers[1], used, minlength=classes), inputs, classes, width), np.zeros(0, np.int64)
    if first is None:
        return Network(w, *numbers)
    sent = spark.sparkContext.broadcast(numbers)
    for own, batch, rate in ((F.col("block") == first, 64, 0.02), (F.lit(True), 256, 0.02)):
        fitted = left.where(own).groupBy("block").cogroup(right.where(own).groupBy("block")).applyInArrow(_fitter(spark.sparkContext.broadcast(w), sent, n, batch, rate), _LEARNT_DDL)
        flat = _flat(w)
        cuts = _cuts(len(flat))
        for r in fitted.groupBy("slice").applyInArrow(_averaged, "slice int, data binary").collect():
            if r["slice"] < 0:
                seen = np.frombuffer(r["data"], np.int64)
            else:
                flat[slice(*cuts[r["slice"]])] = np.frombuffer(r["data"], np.float32)
        w = {k: x.copy() for k, x in _views(flat, w).items()}
    return Network(w, *numbers, part_of_counts(seen))


def score_texts(docs: DataFrame, pieces: str, *, inputs: int = 1024, classes: int = 160, width: int = 16) -> DataFrame:
    """Log probabilities of whole texts, learnt from the documents that aren't held out.

    ``docs`` has doc_id (integer) and text; other columns are not used.  A
    document is held out if crc32 of its doc_id as text, modulo 10, is 0; one
    with a null doc_id isn't.  Tokens are the words ``[^\x20\x09-\x0D]+``, A-Z
    lower-cased, and an end.  Returns doc_id, held_out, n_tokens, n_known
    (tokens that learning documents have), train_tokens (N, all learning
    tokens), base_score (of the counts, with 0.1 added to each) and score, the
    model's; both are log10.

    Null text is empty: its end is its only token.  Repeated rows count and are
    scored each; texts of any length are scored whole (a block holds at least
    one); an empty table gives no rows.  ``pieces`` is the file of a
    SentencePiece model.  The network's weights, the mixture's part and the
    counts of words and of pieces come from all learning documents.
    Counts are exact, but for words of equal 64-bit hashes.
    """
    spark = docs.sparkSession
    small_batches(spark)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0, F.lit(False))
    rows = docs.select(F.struct(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out")).alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    model = Pieces(pieces)
    packed = stored(rows.mapInArrow(_packer(spark.sparkContext.broadcast(model), parts(spark, size // 2)), _PACKED_DDL), "lm-blocks")
    totals = stored(packed.where("part >= 0").select("block", "part", "words", "counts").groupBy("part").applyInArrow(_totals, "block long, part int, counts binary, n long"), "lm-counts")
    begins = model.begins_word()
    used = np.zeros(len(begins), np.int64)
    for r in packed.where("part = -1").select("piece_ids", "piece_counts").mapInArrow(_sum_pieces, "piece int, n long").groupBy("piece").agg(F.sum("n").alias("n")).collect():
        used[r["piece"]] = r["n"]
    n_learn = packed.agg(F.coalesce(F.sum("n_learn"), F.lit(0)).alias("n")).first()["n"]
    distinct = totals.where("block = -1").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"] + (n_learn > 0)
    n = packed.where("part >= 0").select("counts").mapInArrow(_sum_counts, "n long").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"] + n_learn
    used[_END] = n_learn
    left = packed.where("part = -1").select("block", "ids", "held_out", "n_words", "codes", "pieces", "n_pieces")
    right = totals.where("block >= 0").select("block", "part", "counts")
    most = packed.where("part = -1 AND n_learn > 0").orderBy(F.desc("n_learn"), "block").select("block").first()
    net = _learn(left.drop("ids"), right, used, begins, n, most and most["block"], inputs, classes, width)
    release(spark)
    out = left.groupBy("block").cogroup(right.groupBy("block")).applyInArrow(_scorer(spark.sparkContext.broadcast(net), n, distinct, n_learn), "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")


def _sum_counts(batches):
    total = 0
    for batch in batches:
        for x in batch.column(0):
            total += int(np.frombuffer(x.as_buffer(), np.int64).sum())
    yield pa.RecordBatch.from_arrays([pa.array([total], pa.int64())], names=["n"])


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), model_path())
