"""Sampled SentencePiece encodings without replacement, and decoding.

All segmentations of a text into the model's pieces form a lattice.  A piece
of rank r has the weight (r + OFFSET) ** -temperature, and a segmentation's
probability is the product of its weights over the sum for all.  Gumbel top-k
draws k distinct ones: the first is a plain sample and has the largest
perturbed value; all others lie in subtrees that leave it at some place.  Each
subtree's own largest value is drawn below its parent's, and the search opens
the subtree with the best value next, as in A-star.  The value of the best
subtree never opened gives the inclusion probability of what was emitted.

No piece goes beyond the end of a word, so the lattice of a text is a chain of
words' lattices, and those are built once for the distinct words of a slice of
text.  Draws are hashes of the row key, so they do not depend on how the table
is dealt out.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import small_batches, tidy
from .words import _BASE, mix, powers, raw, slices

OFFSET = 10.0
_SLICE = 1 << 19
_SPACE = 0x20
#: Brings what differs in a hash into its first bits.
_SPREAD = 0x9E3779B97F4A7C15


@dataclass
class Vocabulary:
    """Pieces as bytes, a leading space standing for the word mark, with their log weights; byte pieces by value."""

    pieces: list[bytes]
    log_weight: np.ndarray
    hashes: np.ndarray
    ids: np.ndarray
    longest: int
    byte_ids: np.ndarray

    def __post_init__(self):
        #: By a hash's first 20 bits: the place of the only piece with them, -1 for none, -2 for several; and may a piece begin with it.
        self.only, self.begins = np.full(1 << 20, -1, np.int32), np.zeros(1 << 20, bool)
        first, count = np.unique(self.hashes >> np.uint64(44), return_counts=True)
        self.only[self.hashes >> np.uint64(44)] = np.arange(len(self.hashes))
        self.only[first[count > 1]] = -2
        heads = {self.pieces[i][:n] for i in self.ids for n in range(1, len(self.pieces[i]))}
        self.begins[np.array([_hash(x) for x in heads] or [0], np.uint64) >> np.uint64(44)] = True

    def look_up(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``h`` that are pieces, and their ids."""
        k = self.only[_top(h)]
        at = np.flatnonzero(k != -1)
        k = k[at]
        several = np.flatnonzero(k == -2)
        k[several] = np.minimum(np.searchsorted(self.hashes, h[at[several]]), len(self.hashes) - 1)
        found = self.hashes[k] == h[at]
        return at[found], self.ids[k[found]]


def _top(h: np.ndarray) -> np.ndarray:
    """Hashes' first 20 bits, as indexes that numpy need not convert."""
    return (h >> np.uint64(44)).view(np.int64)


def _hash(data: bytes) -> int:
    total, power = 0, 1
    for b in data:
        total = (total + (b + 1) * power) % (1 << 64)
        power = power * _BASE % (1 << 64)
    return total * _SPREAD % (1 << 64)


def load(path: str, temperature: float = 1.0) -> Vocabulary:
    """Reads a SentencePiece model with byte fallback; only the driver opens the file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    size = model.get_piece_size()
    pieces, rank, byte_ids = [b""] * size, np.full(size, float(size)), np.full(256, -1)
    for i in range(size):
        text = model.id_to_piece(i)
        if model.is_byte(i):
            byte_ids[int(text[1:-1], 16)] = i
            pieces[i] = bytes([int(text[1:-1], 16)])
        elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
            if " " in text.replace("▁", " ").lstrip(" ") or "\n" in text:
                raise ValueError(f"piece {i} goes beyond the end of a word")
            pieces[i] = text.replace("▁", " ").encode()
            rank[i] = min(float(size), max(0.0, -model.get_score(i)))
    if (byte_ids < 0).any():
        raise ValueError("the model has no byte fallback")
    plain = [i for i in range(size) if pieces[i] and i not in set(byte_ids.tolist())]
    h = np.array([_hash(pieces[i]) for i in plain], np.uint64)
    order = np.argsort(h)
    return Vocabulary(pieces, -temperature * np.log(rank + OFFSET), h[order], np.array(plain)[order], max(len(pieces[i]) for i in plain), byte_ids)


def cut_units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The rows' bytes, each with a space in front; where units start and end; the number of each row's units.

    A unit is a run of spaces and what follows up to the next, or one line break.
    """
    lengths = np.diff(offsets)
    rows = np.flatnonzero(lengths > 0)
    put = np.full(int(lengths.sum()) + len(rows), _SPACE, np.uint8)
    starts = np.cumsum(lengths[rows] + 1) - lengths[rows] - 1
    keep = np.ones(len(put), bool)
    keep[starts] = False
    put[keep] = data[offsets[0] : offsets[-1]]
    if not len(put):
        return put, np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(lengths), np.int64)
    space, line = put == _SPACE, put == 0x0A
    new = np.zeros(len(put), bool)
    new[1:] = (space[1:] & ~space[:-1]) | line[1:] | line[:-1]
    new[starts] = True
    begin = np.flatnonzero(new)
    count = np.zeros(len(lengths), np.int64)
    count[rows] = np.diff(np.append(np.searchsorted(begin, starts), len(begin)))
    return put, begin, np.append(begin[1:], len(put)), count


def _found(v: Vocabulary, x: np.ndarray, heads: np.ndarray, left: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """By length (from 1 byte) where pieces begin, and their ids; some positions at a time, as hashes take eight times a text's bytes."""
    starts, ids = [], []
    for a in range(0, len(x), _SLICE):
        b = min(len(x), a + _SLICE)
        own = x[a : b + v.longest]
        up, down = powers(_BASE, len(own) + 1)
        sums = np.concatenate([[np.uint64(0)], np.cumsum((own.astype(np.uint64) + np.uint64(1)) * up[: len(own)])])
        spread = down[: len(own)] * np.uint64(_SPREAD)
        place = heads[np.searchsorted(heads, a) : np.searchsorted(heads, b)] - a
        for length in range(1, v.longest + 1):
            place = place[left[place + a] >= length]
            if not len(place):
                break
            h = (sums[place + length] - sums[place]) * spread[place]
            some, found = v.look_up(h)
            if length > len(starts):
                starts.append([])
                ids.append([])
            starts[length - 1].append(place[some] + a)
            ids[length - 1].append(found.astype(np.int32))
            place = place[v.begins[_top(h)]]
    return [np.concatenate(s) for s in starts], [np.concatenate(i) for i in ids]


#: A unit of more bytes is long: its sums are taken in blocks of BLOCK characters, and its draws go by place.
LONG, BLOCK, AHEAD = 512, 512, 128


def _groups(first: np.ndarray, size: np.ndarray, head: np.ndarray, heads: np.ndarray, left: np.ndarray, block: int) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each position the bytes to its unit's end, or in a long unit to its block's; of the blocks their first and last characters, and whether they end a unit."""
    group = left.copy()
    count = np.concatenate([[0], np.cumsum(head)])  # characters before each position
    begins, ends, last = [], [], []
    for u in np.flatnonzero(size > LONG):
        c, d = int(count[first[u]]), int(count[first[u] + size[u]])
        own = np.arange(c, d, block)[: max(1, (d - c) // block)]  # the last block takes the rest, so that no piece goes beyond two
        begins.append(own)
        ends.append(np.append(own[1:], d))
        last.append(np.arange(len(own)) == len(own) - 1)
        stop = np.append(heads[own[1:]], first[u] + size[u])
        at = np.arange(first[u], first[u] + size[u])
        group[at] = np.repeat(stop, np.diff(np.append(heads[own], first[u] + size[u]))) - at
    some = lambda x, t: np.concatenate([np.empty(0, t), *x])
    return group, (some(begins, np.int64), some(ends, np.int64), some(last, bool))


def _settled(w: np.ndarray) -> np.ndarray:
    """Of each matrix, whether its columns are the same but for a factor."""
    total = w.sum(1, keepdims=True)
    share = np.divide(w, total, out=np.zeros_like(w), where=total > 0)
    mean = w.sum(2, keepdims=True) / np.maximum(total.sum(2, keepdims=True), 1e-300)
    return ((np.abs(share - mean) <= 1e-15 + 1e-13 * mean) | (total <= 0)).all((1, 2))


def _columns(own: np.ndarray, length: np.ndarray, back: np.ndarray, weight: np.ndarray, blocks: int, width: int) -> np.ndarray:
    """For each block a matrix: how the sums of its first characters follow from those of the ``width`` characters behind its end.

    Of each edge: its block, its length and its distance from the block's end, in
    characters, and its weight.  All blocks go back one character at a time; the
    character t before the end is in row -t modulo ``width``.
    """
    order = np.argsort(back * blocks + own, kind="stable")
    own, length, back, weight = own[order], length[order], back[order], weight[order]
    cuts = np.searchsorted(back, np.arange(1, int(back.max()) + 2))
    w = np.broadcast_to(np.eye(width), (blocks, width, width)).copy()
    for t, (x, y) in enumerate(zip(cuts, cuts[1:], strict=False), 1):
        rows = own[x:y]
        new = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
        value = w[rows, (length[x:y] - t) % width]
        value *= weight[x:y, None]
        some = rows[new]
        w[some, -t % width] = np.add.reduceat(value, new)
        if t % 8 == 0:
            w[some] /= w[some].max((1, 2), keepdims=True)
    return w


def _fill_borders(total: np.ndarray, chars: np.ndarray, start: np.ndarray, step: np.ndarray, score: np.ndarray, begins: np.ndarray, ends: np.ndarray, last: np.ndarray) -> None:
    """Writes the sums of the first characters of each block of long units to ``total``, up to a factor of the block.

    They are linear in the sums of the characters further on.  As a rule those
    behind AHEAD characters change them by a common factor only, as far as
    doubles tell, and then that is all there is to find.  Blocks of which that
    doesn't hold look twice as far, in the end as far as their unit goes, where
    the sum is known to be 1.
    """
    to_char = np.full(len(total), len(chars), np.int32)
    to_char[chars] = np.arange(len(chars))
    inside = np.zeros(len(chars) + 1, bool)
    for x, y in zip(begins, ends, strict=True):
        inside[x:y] = True
    unit_end = ends[last][np.cumsum(last) - last]  # of each block, the character behind its unit
    every = np.flatnonzero(inside[to_char[start]])
    char = to_char[start[every]]
    order = np.argsort(char, kind="stable")
    every, char = every[order], char[order]
    reach = to_char[np.minimum(start[every] + step[every], len(total) - 1)]
    reach = np.minimum(reach, unit_end[np.searchsorted(ends, char, side="right")])
    weight, width = np.exp(score[every]), int((reach - char).max())
    todo, ahead, place = np.flatnonzero(~np.append(True, last[:-1])), AHEAD, np.arange(width)
    while len(todo):
        stop = np.minimum(begins[todo] + ahead, unit_end[todo])
        a, b = np.searchsorted(char, begins[todo]), np.searchsorted(char, stop)
        own = np.repeat(np.arange(len(todo)), b - a)
        at = np.repeat(a - np.cumsum(b - a) + (b - a), b - a) + np.arange(len(own))
        w = _columns(own, reach[at] - char[at], stop[own] - char[at], weight[at], len(todo), width)
        whole = stop == unit_end[todo]
        w[whole, :, 1:] = 0  # behind the unit's end there is nothing
        settled = _settled(w) | whole
        for k in np.flatnonzero(settled):
            first = begins[todo[k]]
            sums = w[k, (place - (stop[k] - first)) % width].sum(1)
            there = chars[first : min(first + width, ends[todo[k]])]
            total[there] = np.log(sums[: len(there)])
        todo, ahead = todo[~settled], 2 * ahead


class Lattice:
    """The lattices of distinct units, position by position, with each edge's probability among those at its start."""

    def __init__(self, v: Vocabulary, data: np.ndarray, begin: np.ndarray, end: np.ndarray):
        size = end - begin
        self.first = np.cumsum(size) - size  # of each unit, in this lattice's positions
        at = np.repeat(begin - self.first, size) + np.arange(int(size.sum()))
        x = data[at]
        n = len(x)
        left = (np.repeat(self.first + size, size) - np.arange(n))  # bytes to the unit's end
        head = (x & 0xC0) != 0x80
        heads = np.flatnonzero(head)
        starts, ids = _found(v, x, heads, left)
        # a character that is no piece falls back to its bytes
        w = np.zeros(n, np.int64)
        w[heads] = np.diff(np.append(heads, n))
        alone = head.copy()
        for length, s in enumerate(starts[:4], 1):
            alone[s[w[s] == length]] = False
        for length in range(1, 5):
            lone = np.flatnonzero(alone & (w == length))
            if len(lone):
                starts += [np.empty(0, np.int64)] * (length - len(starts))
                ids += [np.empty(0, np.int32)] * (length - len(ids))
                starts[length - 1] = np.concatenate([starts[length - 1], lone])
                ids[length - 1] = np.concatenate([ids[length - 1], np.full(len(lone), -1, np.int32)])
        del w, alone
        # from the ends of the units backwards, all positions equally far from their end at once;
        # of one position the longest pieces first: they are the likeliest as a rule, so that few edges are looked at
        group, cuts = _groups(self.first, size, head, heads, left, BLOCK)
        far = group[heads]
        heads = heads[np.argsort(far.astype(np.uint16) if far.max(initial=0) < 1 << 16 else far, kind="stable")]
        slot = np.zeros(n, np.int64)
        for s in starts:
            slot[s] += 1
        width = slot[heads]
        new = np.cumsum(width) - width
        slot[heads] = new
        edges = int(width.sum())
        start, step, piece = np.repeat(heads, width), np.empty(edges, np.uint8), np.empty(edges, np.int32)
        for length in range(len(starts), 0, -1):
            s = starts[length - 1]
            at = slot[s]
            step[at], piece[at] = length, ids[length - 1]
            slot[s] = at + 1
        del starts, ids, slot
        score, lone = v.log_weight[piece], np.flatnonzero(piece < 0)
        score[lone] = float(v.log_weight[v.byte_ids[0]]) * step[lone]
        total = np.zeros(n + 1)
        far = group[heads]
        to = start + step
        to[np.repeat(left[heads], width) == step] = n  # the edge ends its unit, and total[n] stays 0
        if len(cuts[0]):
            _fill_borders(total, np.flatnonzero(head), start, step, score, *cuts)
        cuts = np.flatnonzero(np.concatenate([[True], np.diff(far) != 0, [True]])) if len(new) else np.zeros(1, np.int64)
        p = score  # becomes each edge's probability
        for a, b in zip(cuts, cuts[1:], strict=False):
            own = new[a:b]
            x, y = own[0], own[-1] + width[b - 1]
            edge = score[x:y] + total[to[x:y]]
            top = np.maximum.reduceat(edge, own - x)
            edge -= np.repeat(top, width[a:b])
            np.exp(edge, out=edge)
            mass = np.add.reduceat(edge, own - x)
            total[heads[a:b]] = top + np.log(mass)
            p[x:y] = edge / np.repeat(mass, width[a:b])
        self.head, self.long = np.flatnonzero(head), size > LONG
        #: The number of characters before each position.
        self.char = np.concatenate([[0], np.cumsum(head)]).astype(np.int32)
        self.start, self.step, self.piece, self.p, self.left = start.astype(np.int32), step, piece, p, left.astype(np.int32)
        #: First and last edge of each position.
        self.first_edge, self.last_edge = np.zeros(n, np.int32), np.zeros(n, np.int32)
        self.first_edge[heads], self.last_edge[heads] = new, new + width - 1

    def log_p(self, edges: np.ndarray | int) -> np.ndarray:
        """Logarithms of edges' probabilities among those at their start."""
        return np.log(self.p[edges])

    def draw(self, place: np.ndarray, u: np.ndarray) -> np.ndarray:
        """An edge at each place by its probability."""
        edge, last, u = self.first_edge[place].astype(np.int64), self.last_edge[place], u.copy()
        todo = np.flatnonzero((u >= self.p[edge]) & (edge < last))
        while len(todo):
            e = edge[todo]
            u[todo] -= self.p[e]
            edge[todo] = e = e + 1
            todo = todo[(u[todo] >= self.p[e]) & (e < last[todo])]
        return edge

    def draw_other(self, place: int, gone: list[int], u: float) -> int:
        """An edge at one place by its probability, but none of ``gone``."""
        own = [e for e in range(self.first_edge[place], self.last_edge[place] + 1) if e not in gone]
        p = [float(self.p[e]) for e in own]
        u *= sum(p)
        for e, x in zip(own, p, strict=True):
            u -= x
            if u < 0:
                return e
        return own[-1]


def uniform(*parts: np.ndarray | int) -> np.ndarray:
    """Numbers in (0, 1) that depend on the parts alone."""
    h = np.full(1, 0x2545F4914F6CDD1D, np.uint64)
    for p in parts:
        h = mix((h ^ np.atleast_1d(np.asarray(p, np.uint64))) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x632BE59BD9B4E019))
    return ((h >> np.uint64(12)).astype(np.float64) + 0.5) * 2.0**-52


def _below(chance: float, top: float) -> float:
    """The perturbed value that a chance (see ``_chances``) stands for, given that it is below ``top``."""
    return -float(np.logaddexp(-top, -chance)) if chance > -np.inf else -np.inf


def _walk(lat: Lattice, unit: np.ndarray, place: np.ndarray, key: np.ndarray, sample: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges from ``place`` to the end of each unit, as (index of the unit, edge), in order."""
    long = np.flatnonzero(lat.long[unit])
    who, edges, alive, now, step = [], [], np.flatnonzero(~lat.long[unit]), place.copy(), 0
    now = now[alive]
    while len(alive):
        e = lat.draw(now, uniform(sample, step, key[alive]))
        who.append(alive)
        edges.append(e)
        going = lat.step[e] < lat.left[now]
        now = (now + lat.step[e])[going]
        alive = alive[going]
        step += 1
    count = np.zeros(len(unit), np.int64)
    for w in who:
        count[w] += 1
    paths = [_walk_long(lat, int(place[i]), key[i], sample) for i in long]
    count[long] = [len(p) for p in paths]
    first = np.cumsum(count) - count
    out = np.empty(int(count.sum()), np.int64)
    for k, (w, e) in enumerate(zip(who, edges, strict=True)):
        out[first[w] + k] = e
    for i, p in zip(long, paths, strict=True):
        out[first[i] : first[i] + len(p)] = p
    return np.repeat(np.arange(len(unit)), count), out


def _walk_long(lat: Lattice, place: int, key: np.uint64, sample: int) -> np.ndarray:
    """Edges from ``place`` to the end of a long unit.

    An edge is drawn at every character, by its place, before it is known which
    of them the path meets; that is then a chain of steps.
    """
    end = place + int(lat.left[place])
    a, stop, out = int(np.searchsorted(lat.head, place)), int(np.searchsorted(lat.head, end)), []
    while a < stop:
        heads = lat.head[a : min(stop, a + (1 << 16))]
        e = lat.draw(heads, uniform(sample, (1 << 40) + end - heads, key))
        to = lat.char[heads + lat.step[e]] - a
        steps, met, i, n = to.tolist(), [], 0, len(heads)
        put = met.append
        while i < n:
            put(i)
            i = steps[i]
        out.append(e[met])
        a += i
    return np.concatenate([np.empty(0, np.int64), *out])


def sample_slice(v: Vocabulary, data: np.ndarray, offsets: np.ndarray, keys: np.ndarray, k: int) -> list[list[tuple[np.ndarray, float, float]]]:
    """For each row up to k distinct segmentations: (ids, log probability, inclusion probability)."""
    put, begin, end, count = cut_units(data, offsets)
    rows = len(count)
    results: list[list[tuple[np.ndarray, float, float]]] = [[] for _ in range(rows)]
    for r in np.flatnonzero(count == 0):
        results[r].append((np.empty(0, np.int32), 0.0, 1.0))
    if not len(begin):
        return results
    h, i = np.empty(len(begin), np.uint64), 0
    while i < len(h):  # some units at a time
        j = max(i + 1, int(np.searchsorted(end, begin[i] + _SLICE, side="right")))
        own, at = put[begin[i] : end[j - 1]], begin[i:j] - begin[i]
        up, down = powers(_BASE, len(own) + 1)
        sums = np.concatenate([[np.uint64(0)], np.cumsum((own.astype(np.uint64) + np.uint64(1)) * up[: len(own)])])
        h[i:j] = mix((sums[end[i:j] - begin[i]] - sums[at]) * down[at])
        i = j
    order = np.argsort(h)
    new = np.concatenate([[True], np.diff(h[order]) != 0])
    which, unit = order[new], np.empty(len(h), np.int64)
    unit[order] = np.cumsum(new) - 1
    lat = Lattice(v, put, begin[which], end[which])
    row_first = np.cumsum(count) - count
    row_of = np.repeat(np.arange(rows), count)
    key = mix(keys[row_of] ^ mix((np.arange(len(unit)) - row_first[row_of]).astype(np.uint64)))
    who, edge = _walk(lat, unit, lat.first[unit], key, 0)
    return _search(v, lat, put, begin, unit, key, keys, row_first, count, who, edge, k, results)


def _chances(logp: np.ndarray, first: np.ndarray, base: np.ndarray, keys: np.ndarray, path: int) -> np.ndarray:
    """Gumbel variables at the log probabilities of the subtrees that leave paths at each of their places.

    The paths lie one after the other in ``logp`` from ``first`` on; ``base`` is
    the log probability before each.  The largest chance below a bound is also
    the largest perturbed value below it, so the bound is applied to that one only.
    """
    n = np.diff(np.append(first, len(logp)))
    run = np.cumsum(logp) - logp
    before = run + np.repeat(base - run[np.minimum(first, max(0, len(run) - 1))], n) if len(logp) else run
    with np.errstate(divide="ignore"):
        phi = before + np.log(np.where(logp > -1e-12, 0.0, -np.expm1(logp)))
    row = mix(keys ^ mix(np.full(len(keys), 7 + path, np.uint64)))
    u = uniform(np.repeat(row, n) + (np.arange(len(logp)) - np.repeat(first, n)).astype(np.uint64))
    return phi - np.log(-np.log(u))


def _search(v, lat, put, begin, unit, key, keys, row_first, count, who, edge, k, results):
    """Opens each row's best subtree until k segmentations are out; all rows take a step together."""
    rows = np.flatnonzero(count)
    last = row_first + count
    logp = lat.log_p(edge)
    cuts = np.searchsorted(who, np.append(row_first[rows], len(unit)))
    top = -np.log(-np.log(uniform(keys[rows], 1 << 20)))
    chances = _chances(logp, cuts[:-1], np.zeros(len(rows)), keys[rows], 0)
    #: Of each row its paths (unit, edge, log probability of each place) and its unopened subtrees (chances, path, first place, bound).
    paths = [[(who[a:b], edge[a:b], logp[a:b])] for a, b in zip(cuts, cuts[1:], strict=False)]
    unopened = [[(chances[a:b], 0, 0, float(most))] for a, b, most in zip(cuts, cuts[1:], top, strict=False)]
    gone: list[dict[tuple[int, int], list[int]]] = [{} for _ in rows]
    active = list(range(len(rows)))
    for number in range(1, k):
        draws = uniform(keys[rows], 1 << 21, number), uniform(keys[rows], 1 << 22, number)
        jobs = []
        for i in active:
            tops = [_below(float(x.max()), most) if len(x) else -np.inf for x, _, _, most in unopened[i]]
            best = tops.index(max(tops))
            if tops[best] == -np.inf:
                continue
            value, (own, path, since, most) = tops[best], unopened[i][best]
            j = int(own.argmax())
            at = since + j
            w, e, lp = paths[i][path]
            place = int(lat.start[e[at]])
            without = gone[i].setdefault((path, at), [int(e[at])])
            other = lat.draw_other(place, without, float(draws[0][i]))
            without.append(other)  # the subtree lives on without the edge that is now followed
            before, mass = float(lp[:at].sum()), 1 - sum(float(lat.p[x]) for x in without)
            some_left = len(without) <= lat.last_edge[place] - lat.first_edge[place] and mass > 1e-12
            own[j] = -np.inf
            if some_left:
                unopened[i].append((np.array([before + math.log(mass) - math.log(-math.log(draws[1][i]))]), path, at, value))
            inside = bool(lat.step[other] < lat.left[place])
            jobs.append((i, path, at, other, value, before + float(lat.log_p(other)), int(w[at]) + (not inside), place + int(lat.step[other]) if inside else -1))
        active = [j[0] for j in jobs]
        if not jobs:
            break
        begins, ends = np.array([j[6] for j in jobs]), last[rows[active]]
        n = ends - begins
        first = np.cumsum(n) - n
        units = np.repeat(begins - first, n) + np.arange(int(n.sum()))
        starts = lat.first[unit[units]]
        inner = np.array([j[7] for j in jobs])
        starts[first[inner >= 0]] = inner[inner >= 0]
        walked, more = _walk(lat, unit[units], starts, key[units], number)
        new_who, new_logp = units[walked], lat.log_p(more)
        cuts = np.searchsorted(walked, np.append(first, len(units)))
        chances = _chances(new_logp, cuts[:-1], np.array([j[5] for j in jobs]), keys[rows[active]], number)
        for (i, path, at, other, value, *_), a, b in zip(jobs, cuts, cuts[1:], strict=False):
            w, e, lp = paths[i][path]
            paths[i].append((np.concatenate([w[: at + 1], new_who[a:b]]), np.concatenate([e[:at], [other], more[a:b]]), np.concatenate([lp[:at], lat.log_p(np.array([other])), new_logp[a:b]])))
            unopened[i].append((chances[a:b], len(paths[i]) - 1, at + 1, value))
    flat = [p for own in paths for p in own]
    size = np.array([len(p[1]) for p in flat])
    ids, bounds = _ids(lat, v, np.concatenate([p[1] for p in flat]), np.cumsum(size) - size, begin[row_first[np.repeat(rows, [len(p) for p in paths])]], put)
    place = 0
    for i, row in enumerate(rows):
        rest = max(_below(float(x.max()), most) if len(x) else -np.inf for x, _, _, most in unopened[i])
        for _, _, lp in paths[i]:
            total = float(lp.sum())
            inclusion = 1.0 if rest == -np.inf else -math.expm1(-math.exp(min(total - rest, 50.0)))
            results[row].append((ids[bounds[place] : bounds[place + 1]], total, inclusion))
            place += 1
    return results


def _ids(lat: Lattice, v: Vocabulary, edge: np.ndarray, first: np.ndarray, start: np.ndarray, put: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of paths that lie one after the other, and where each begins; a fallback edge gives the ids of its bytes."""
    ids = lat.piece[edge]
    if (ids >= 0).all():
        return ids.astype(np.int32), np.append(first, len(ids))
    lone = np.flatnonzero(ids < 0)
    step = lat.step[edge]
    size = step[lone].astype(np.int64)
    times = np.ones(len(ids), np.uint8)
    times[lone] = step[lone]
    out, offset = np.repeat(ids, times), np.concatenate([[0], np.cumsum(times, dtype=np.int64)])
    # where the bytes of each fallback edge lie: behind those of the edges before it in its path
    run = np.cumsum(step, dtype=np.int64) - step
    path = np.searchsorted(first, lone, side="right") - 1
    at = start[path] + run[lone] - run[np.minimum(first[path], len(run) - 1)]
    place = np.repeat(np.cumsum(size) - size, size)
    byte = np.repeat(at, size) + np.arange(len(place)) - place
    out[np.repeat(offset[lone], size) + np.arange(len(place)) - place] = v.byte_ids[put[byte]]
    return out.astype(np.int32), np.append(offset[first], len(out))


def _texts(pieces: pa.Array, ids: pa.ListArray) -> pa.Array:
    """The texts of lists of piece ids, as ``decode_ids`` gives them."""
    joined = pa.compute.binary_join(pa.ListArray.from_arrays(ids.offsets, pieces.take(ids.values), mask=ids.is_null()), b"")
    return pa.array([None if x is None else x.removeprefix(b" ").decode("utf-8", "replace") for x in joined.to_pylist()], pa.string())


def _encoder(v: Vocabulary, k: int, seed: int, decoded: bool):
    schema = pa.schema([("doc_id", pa.int64()), ("sample", pa.int32()), ("ids", pa.list_(pa.int32())), ("log_prob", pa.float64()), ("inclusion", pa.float64()), *([("decoded", pa.string())] if decoded else [])])

    def run(batches):
        texts = pa.array(v.pieces, pa.binary()) if decoded else None
        for batch in slices(batches, 1, _SLICE):
            ids = batch.column(0)
            keys = mix(np.asarray(ids.fill_null(-1)).astype(np.uint64) ^ mix(np.full(len(ids), seed, np.uint64)))
            data, offsets = raw(batch.column(1))
            rows = sample_slice(v, data, offsets, keys, k)
            null = ~np.asarray(batch.column(1).is_valid())
            doc, number, pieces, log_p, inclusion = [], [], [], [], []
            for i, found in enumerate(rows):
                for s, (p, lp, inc) in enumerate([(None, None, None)] if null[i] else found):
                    doc.append(ids[i].as_py())
                    number.append(s + 1)
                    pieces.append(p)
                    log_p.append(lp)
                    inclusion.append(inc)
            length = np.array([0 if p is None else len(p) for p in pieces])
            flat = np.concatenate([p for p in pieces if p is not None] or [np.empty(0, np.int32)])
            bounds = pa.array(np.concatenate([[0], np.cumsum(length)]).astype(np.int32), mask=np.append([p is None for p in pieces], False))
            lists = pa.ListArray.from_arrays(bounds, pa.array(flat, pa.int32()))
            again = [_texts(texts, lists)] if decoded else []
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(number, pa.int32()), lists, pa.array(log_p, pa.float64()), pa.array(inclusion, pa.float64()), *again], schema=schema)
            del rows, pieces, flat, lists, again
            tidy()

    return run


def encode(docs: DataFrame, v: Vocabulary, *, k: int = 2, seed: int = 0, decoded: bool = False) -> DataFrame:
    """Up to k distinct sampled segmentations of each whole text.

    ``docs`` has doc_id (integer, the row key that seeds its draws) and text;
    other columns are not used.  Returns doc_id long, sample int (1 is the
    first drawn), ids array<int>, log_prob double, and inclusion double: the
    probability that the segmentation is among those drawn, given the bound of
    the search.  A text with fewer than k segmentations gives fewer rows.  With
    ``decoded`` also decoded string, the text that the sample's ids give.

    Null text gives one row without ids, an empty text one empty segmentation.
    Rows of the same doc_id and text get the same samples; a null doc_id
    counts as -1; an empty table gives no rows.  Texts of any length are sampled
    as a whole, which takes a task some 130 bytes of memory for each byte of a
    text with spaces and some 280 for one without.
    """
    if k < 1:
        raise ValueError("k is at least 1")
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_encoder(v, k, seed, decoded), "doc_id long, sample int, ids array<int>, log_prob double, inclusion double" + (", decoded string" if decoded else ""))


def decode_ids(pieces: list[bytes], ids: list[int]) -> str:
    text = b"".join([pieces[i] for i in ids])
    return (text[1:] if text[:1] == b" " else text).decode("utf-8", "replace")


def decode(rows: DataFrame, v: Vocabulary) -> DataFrame:
    """Adds decoded string, the text of ids array<int>; null ids give null.  A column named decoded is replaced."""
    columns = [c for c in rows.columns if c != "decoded"]
    pieces, at = v.pieces, columns.index("ids")

    def run(batches):
        for batch in batches:
            text = [None if x is None else decode_ids(pieces, x) for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(columns)], pa.array(text, pa.string())], names=[*columns, "decoded"])

    out = rows.select([F.col(f"`{c}`") for c in columns])
    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema.fields)
    return out.mapInArrow(run, f"{own}, decoded string")


def model_path() -> str:
    """The 32,000-piece public model where it is installed; any other path may be given to ``load``."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode(docs, load(model_path()), decoded=True).withColumn("n_ids", F.size("ids"))
