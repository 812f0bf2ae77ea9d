"""Similarity join on word n-grams with signature trees.

1. Every document becomes its set of shingle hashes; documents with equal sets
   share a key, and one key stands for all its copies from there on.
2. Shingles are dealt by hash, packed, and counted.  A shingle that only one
   key has can't be common to two, so a key needs at least 80 % of its shingles
   among the others to have any partner.  Most keys end here.  A shingle that
   very many keys have is known to be common from the first pass over the
   texts, and takes no part in the counting.
3. Keys with the same least hash are ordered next to each other and cut into
   blocks; a signature tree joins each block.  This joins most near copies,
   a large group of them in a few rounds, each with one key for a component.
4. What this can't show, a prefix filter must: linked keys have one of their
   rarest shingles in common.  A shingle (and class of sizes) whose keys are
   all joined already drops out, and so does a key without a partner whose
   size and remaining shingles allow a link.  The rest is joined in blocks
   again: small ones by what hangs together, large ones by shingle.
5. A signature tree holds the keys of a block ordered by size: a node has the
   OR of its members' bitmaps, the range of their sizes and the largest
   surplus of shingles over bits.  A dual traversal from the root drops node
   pairs whose sizes or greatest possible overlap rule out a link; what stays
   is compared exactly, unless both are joined already.

No step drops a pair that can be linked, so the result is exact but for
collisions of hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import components, drop_folder, hook, parts, release, small_batches, stored, tidy, whole_groups
from .words import _SHIFT, LOWER, WHITE, _spans, mix, part_of, pieces, slices

#: A block of more keys or more shingles than this is split.
BLOCK_KEYS, BLOCK_SHINGLES = 1024, 2_000_000
#: Keys of one shingle and class of sizes that are compared with each other before sets are fetched; beyond it all stay.
CELL_KEYS = 4096
#: A shingle that one of so many keys has, or more, is not counted.
HOT = 128
_LEAF = 8

_INFO = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("key", pa.int64()), ("keys", pa.int64()), ("hot", pa.binary()), ("count", pa.binary())])
_INFO_SQL = "doc_id long, n_shingles long, key long, keys long, hot binary, count binary"
_PACKED = pa.schema([("part", pa.int32()), ("hot", pa.bool_()), ("keys", pa.binary()), ("counts", pa.binary()), ("sizes", pa.binary()), ("low", pa.binary()), ("high", pa.binary())])
_PACKED_SQL = "part int, hot boolean, keys binary, counts binary, sizes binary, low binary, high binary"


def _sets(piece, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, shingle) of a piece without repeats, ordered by row, and each row's set size and key."""
    words = piece.hashes()
    at, h = piece.windows(words, size)
    row = piece.row_of(at)
    for c in range(1, size):  # fewer words: the whole sequence is one shingle
        short = np.flatnonzero(piece.count == c)
        first = piece.bounds[short]
        row, h = np.concatenate([row, short]), np.concatenate([h, mix(_spans(words, _SHIFT, first, first + c) + np.uint64(c))])
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    if len(h):
        new = np.concatenate([[True], (row[1:] != row[:-1]) | (h[1:] != h[:-1])])
        row, h = row[new], h[new]
    n = np.bincount(row, minlength=piece.rows).astype(np.int64)
    total = np.zeros(piece.rows, np.uint64)
    some = np.flatnonzero(n)
    if len(some):
        total[some] = np.add.reduceat(mix(h ^ np.uint64(0x5851F42D4C957F2D)), (np.cumsum(n) - n)[some])
    return row, h, n, mix(total + n.astype(np.uint64))


def _info(size: int):
    """(doc_id, text) -> (doc_id, n_shingles, key), and a task's frequent shingles in a row of their own."""

    def run(batches):
        often, times, seen = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], 0
        for batch in slices(batches, 1):
            n, key, tokens = [np.empty(0, np.int64)], [np.empty(0, np.uint64)], [np.empty(0, np.uint64)]
            for piece in pieces(batch.column(1), WHITE, LOWER):
                row, h, own_n, own_key = _sets(piece, size)
                n.append(own_n)
                key.append(own_key)
                once = np.zeros(piece.rows, bool)
                once[np.unique(own_key, return_index=True)[1]] = True
                tokens.append(h[once[row]])
                seen += int((once & (own_n > 0)).sum())
            n, key = np.concatenate(n), np.concatenate(key)
            token, count = np.unique(np.concatenate(tokens), return_counts=True)
            some = (count > 1) & (count * HOT >= len(n))
            often.append(token[some])
            times.append(count[some])
            if sum(map(len, often)) > 1 << 20:
                often, times = ([x] for x in _summed(np.concatenate(often), np.concatenate(times)))
            none = lambda t: pa.nulls(len(n), t)  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(key.view(np.int64), mask=n == 0), none(pa.int64()), none(pa.binary()), none(pa.binary())], schema=_INFO)
        token, count = _summed(np.concatenate(often), np.concatenate(times))
        tidy()
        yield pa.RecordBatch.from_pylist([{"keys": seen, "hot": token.tobytes(), "count": count.tobytes()}], schema=_INFO)

    return run


def _summed(token: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    token, at = np.unique(token, return_inverse=True)
    return token, np.bincount(at, count, len(token)).astype(np.int64)


def _frequent(info: DataFrame) -> np.ndarray:
    """Shingles that at least one of ``HOT`` keys has, sorted.

    As a share of the keys, so their number is at most ``HOT`` times a key's mean number of shingles.
    """
    found = info.where("hot is not null")
    keys = found.agg(F.coalesce(F.sum("keys"), F.lit(0)).alias("n")).first()["n"]

    def unpack(batches):
        for batch in batches:
            for h, c in zip(batch.column(0), batch.column(1), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(h.as_py(), np.int64)), pa.array(np.frombuffer(c.as_py(), np.int64))], names=["token", "n"])

    tokens = found.select("hot", "count").mapInArrow(unpack, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    return np.sort(np.array([r["token"] for r in tokens.where(F.col("n") * HOT >= max(keys, 2 * HOT)).select("token").collect()], np.int64).view(np.uint64))


def _dealt(part: np.ndarray, key: np.ndarray, size: np.ndarray, low: np.ndarray, high: np.ndarray, hot: bool = False) -> Iterator[dict]:
    """One packed row for each part; the entries of a key are consecutive."""
    order = np.argsort(part, kind="stable")
    part, key, size, low, high = part[order], key[order], size[order], low[order], high[order]
    cuts = np.flatnonzero(np.diff(part)) + 1
    for a, b in zip([0, *cuts], [*cuts, len(part)], strict=True) if len(part) else ():
        k = key[a:b]
        new = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        yield {"part": int(part[a]), "hot": hot, "keys": k[new].tobytes(), "counts": np.diff(np.append(new, len(k))).astype(np.uint32).tobytes(), "sizes": size[a:b][new].astype(np.uint32).tobytes(), "low": low[a:b].tobytes(), "high": high[a:b].tobytes()}


def _column(t: pa.Table, name: str, kind: type) -> np.ndarray:
    return np.concatenate([np.frombuffer(x.as_py(), kind) for c in t.column(name).chunks for x in c] or [np.empty(0, kind)])


def _unpack(t: pa.Table, low: type, high: type) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    counts = _column(t, "counts", np.uint32)
    return np.repeat(_column(t, "keys", np.uint64), counts), np.repeat(_column(t, "sizes", np.uint32), counts), _column(t, "low", low), _column(t, "high", high)


def _among(sorted_values: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(sorted_values):
        return np.zeros(len(x), bool)
    return sorted_values[np.minimum(np.searchsorted(sorted_values, x), len(sorted_values) - 1)] == x


def _tokens(size: int, n_parts: int, frequent: np.ndarray):
    """Texts -> shingles by part; of texts with equal sets in a piece, one is sent.  Frequent shingles are dealt by key."""

    def run(batches):
        for batch in slices(batches, 0):
            out = []
            for piece in pieces(batch.column(0), WHITE, LOWER):
                row, h, n, key = _sets(piece, size)
                once = np.zeros(piece.rows, bool)
                once[np.unique(key, return_index=True)[1]] = True
                own = once[row]
                row, h = row[own], h[own]
                hot = _among(frequent, h)
                r = row[hot]
                out += _dealt((key[r] % np.uint64(n_parts)).astype(np.int32), key[r], n[r], h[hot], np.empty(len(r), np.uint8), True)
                row, h = row[~hot], h[~hot]
                part = part_of(h, n_parts)
                out += _dealt(part, key[row], n[row], h.astype(np.uint32), (h >> np.uint64(32)).astype(np.uint16))
            yield pa.RecordBatch.from_pylist(out, _PACKED)
        tidy()

    return run


def _shared(n_parts: int):
    """A part's shingles that two keys or more have, dealt by key, with the logarithm of their number of keys."""

    def run(part, t):
        hot = t.filter(t.column("hot"))
        key, size, low, high = _unpack(t.filter(pa.compute.invert(t.column("hot"))), np.uint32, np.uint16)
        token = low.astype(np.uint64) | (high.astype(np.uint64) << np.uint64(32)) | (np.uint64(part[0].as_py() & 0xFFFF) << np.uint64(48))
        order = np.lexsort((key, token))
        key, token, size = key[order], token[order], size[order]
        if len(key):
            new = np.concatenate([[True], (key[1:] != key[:-1]) | (token[1:] != token[:-1])])
            key, token, size = key[new], token[new], size[new]
            start = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
            keys = np.repeat(np.diff(np.append(start, len(token))), np.diff(np.append(start, len(token))))
            some = keys > 1
            key, token, size, rank = key[some], token[some], size[some], (4 * np.log2(np.maximum(keys[some], 1))).astype(np.uint8)
        else:
            rank = np.empty(0, np.uint8)
        k, s, h, _ = _unpack(hot, np.uint64, np.uint8)  # every frequent shingle is rarer than none
        key, token, size, rank = np.concatenate([key, k]), np.concatenate([token, h]), np.concatenate([size, s]), np.concatenate([rank, np.full(len(k), 255, np.uint8)])
        order = np.lexsort((token, key))
        key, token, size, rank = key[order], token[order], size[order], rank[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (token[1:] != token[:-1])
        key, token, size, rank = key[new], token[new], size[new], rank[new]
        out = pa.Table.from_pylist(list(_dealt((key % np.uint64(n_parts)).astype(np.int32), key, size, token, rank)), _PACKED)
        tidy()
        return out

    return run


_CANDIDATE = "key long, n int, least long, tokens binary, prefix binary"


def _candidates(part, t):
    """Keys of which enough shingles occur elsewhere, with those shingles, their least hash, and the prefix by which partners meet."""
    key, size, token, rank = _unpack(t, np.uint64, np.uint8)
    order = np.lexsort((token, rank, key))
    key, size, token = key[order], size[order].astype(np.int64), token[order]
    if len(key):  # a frequent shingle may have come from several parts
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (token[1:] != token[:-1])
        key, size, token = key[new], size[new], token[new]
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
    rows = []
    for a, b in zip(start, np.append(start[1:], len(key)), strict=True):
        n, c = int(size[a]), b - a
        most = c - (4 * n + 4) // 5 + 1
        if most > 0:
            own = token[a:b]
            rows.append({"key": int(key[a : a + 1].view(np.int64)[0]), "n": n, "least": int(mix(own).min().view(np.int64)), "tokens": np.sort(own).tobytes(), "prefix": own[:most].tobytes()})
    return pa.Table.from_pylist(rows, pa.schema([("key", pa.int64()), ("n", pa.int32()), ("least", pa.int64()), ("tokens", pa.binary()), ("prefix", pa.binary())]))


class SignatureTree:
    """Sets ordered by size; each node has the OR of its members' bitmaps, their size range, and bounds on their length and surplus."""

    def __init__(self, n: np.ndarray, sets: list[np.ndarray]):
        length = np.array([len(s) for s in sets], np.int64)
        least = np.array([s[0] if len(s) else 0 for s in sets], np.uint64)
        #: self.order[i] is the place, in what was given, of the tree's i-th member.
        self.order = np.lexsort((least, n))
        bits = 256
        while bits < 2 * length.max(initial=0) and bits < 1 << 15:
            bits *= 2
        maps = np.zeros((len(sets), bits // 64), np.uint64)
        for i, k in enumerate(self.order):
            bit = sets[k] % np.uint64(bits)
            np.bitwise_or.at(maps[i], (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63)))
        n, length = n[self.order], length[self.order]
        surplus = length - np.bitwise_count(maps).sum(1).astype(np.int64)
        #: Level 0 are the members: (bitmaps, least size, largest size, largest length, largest surplus).
        self.levels = [(maps, n, n, length, surplus)]
        while len(self.levels[-1][0]) > 1:
            at = np.arange(0, len(self.levels[-1][0]), _LEAF)
            b, lo, hi, ln, su = self.levels[-1]
            self.levels.append((np.bitwise_or.reduceat(b, at, axis=0), np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at), np.maximum.reduceat(ln, at), np.maximum.reduceat(su, at)))

    def possible(self, level: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Which node pairs may hold a linked pair: 9 * overlap >= 4 * (sum of sizes) within the bounds."""
        maps, lo, hi, length, surplus = self.levels[level]
        fit = (5 * hi[i] >= 4 * lo[j]) & (5 * hi[j] >= 4 * lo[i])
        step = max(1, (1 << 19) // maps.shape[1])
        for a in range(0, len(i), step):
            own = np.flatnonzero(fit[a : a + step]) + a
            p, q = i[own], j[own]
            most = np.bitwise_count(maps[p] & maps[q]).sum(1).astype(np.int64) + np.minimum(surplus[p], surplus[q])
            most = np.minimum(most, np.minimum(length[p], length[q]))
            fit[own] = 9 * most >= 4 * (lo[p] + lo[q])
        return fit

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of members, i before j in the tree's order, that the dual traversal can't rule out."""
        i = j = np.zeros(1 if len(self.levels[0][0]) else 0, np.int64)
        for level in range(len(self.levels) - 1, 0, -1):
            below = len(self.levels[level - 1][0])
            a = (i[:, None] * _LEAF + np.repeat(np.arange(_LEAF), _LEAF)[None]).ravel()
            b = (j[:, None] * _LEAF + np.tile(np.arange(_LEAF), _LEAF)[None]).ravel()
            ok = (a < below) & (b < below) & ((a <= b) if level > 1 else (a < b))
            i, j = a[ok], b[ok]
            fit = (i == j) | self.possible(level - 1, i, j)
            i, j = i[fit], j[fit]
        return (i, j) if len(self.levels) > 1 else (i[:0], j[:0])


def linked(a: np.ndarray, b: np.ndarray, n_a: int, n_b: int) -> bool:
    """100 * intersection >= 80 * union, for sorted sets without repeats."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    common = int((b[np.minimum(at, len(b) - 1)] == a).sum()) if len(b) else 0
    return 9 * common >= 4 * (n_a + n_b)


def link_block(n: np.ndarray, sets: list[np.ndarray], label: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that join the components of a block; members of equal label are known to be in one component.

    Of the pairs that the tree leaves, all of one member are compared at once.
    """
    tree = SignatureTree(n, sets)
    i, j = tree.pairs()
    i, j = tree.order[i], tree.order[j]
    root = np.arange(len(n))
    if label is not None:
        _, first, place = np.unique(label, return_index=True, return_inverse=True)
        hook(root, np.arange(len(n)), first[place])
    size = np.array([len(x) for x in sets], np.int64)
    begin = np.cumsum(size) - size
    distinct, flat = np.unique(np.concatenate([np.empty(0, np.uint64), *sets]), return_inverse=True)
    marked = np.zeros(len(distinct), bool)
    order = np.argsort(j, kind="stable")
    i, j = i[order], j[order]
    cuts = np.flatnonzero(np.diff(j)) + 1
    links = []
    for a, b in zip([0, *cuts], [*cuts, len(j)], strict=True) if len(j) else ():
        q, others = int(j[a]), i[a:b]
        others = others[root[others] != root[q]]
        own = flat[begin[q] : begin[q] + size[q]]
        marked[own] = True
        step = max(1, (1 << 20) // int(size.max()))
        for at in range(0, len(others), step):
            some = others[at : at + step]
            first = np.cumsum(size[some]) - size[some]
            at_token = np.repeat(begin[some] - first, size[some]) + np.arange(int(size[some].sum()))
            common = np.add.reduceat(marked[flat[at_token]].astype(np.int64), first)
            p = some[9 * common >= 4 * (n[some] + n[q])]
            links += hook(root, p, np.full(len(p), q))
        marked[own] = False
    return links


def _link(t: pa.Table, labelled: bool) -> tuple[np.ndarray, np.ndarray]:
    key = t.column("label" if labelled else "key").to_numpy()
    sets = [np.frombuffer(x.as_py(), np.uint64) for c in t.column("tokens").chunks for x in c]
    links = link_block(t.column("n").to_numpy().astype(np.int64), sets, key if labelled else None)
    none = np.empty(0, np.int64)
    return key[np.concatenate([none, *[p for p, _ in links]])], key[np.concatenate([none, *[q for _, q in links]])]


def _cut_blocks(most: int, shingles: int):
    """Rows ordered by (least, key) -> (a, b) links in blocks of keys of one least hash; and (null, least) for each block that may not be all of its hash."""

    def run(batches):
        first, last, cut = None, None, []
        for t in whole_groups(batches, ["least"]):
            least, size = t.column("least").to_numpy(), np.asarray(pa.compute.binary_length(t.column("tokens"))) // 8
            first, last = least[0] if first is None else first, least[-1]
            cuts, total = [0], 0
            for k in range(1, len(least)):
                total += size[k - 1]
                same = least[k] == least[k - 1]
                if not same or k - cuts[-1] == most or total > shingles:
                    cuts.append(k)
                    total = 0
                    if same:
                        cut += [least[k], least[k]]
            for a, b in zip(cuts, [*cuts[1:], len(least)], strict=True):
                if b - a > 1:
                    x, y = _link(t.slice(a, b - a).combine_chunks(), False)
                    yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], names=["a", "b"])
        cut += [] if first is None else [first] if first == last else [first, last]  # may go on in the partition beside this one
        yield pa.RecordBatch.from_arrays([pa.nulls(len(cut), pa.int64()), pa.array(np.array(cut, np.int64))], names=["a", "b"])
        tidy()

    return run


_PLACE = "token long, class int, key long, label long, n int, rest int"


def _places(batches):
    """(key, label, n, tokens length, prefix) -> a row for each prefix shingle and each of both classes of sizes that the key may meet partners in."""
    for batch in batches:
        prefix = [np.frombuffer(x.as_py(), np.int64) for x in batch.column(4)]
        length = np.array([len(x) for x in prefix], np.int64)
        own = np.repeat(np.arange(len(prefix)), length)
        key, label, n, c = (np.asarray(batch.column(k))[own] for k in range(4))
        rest = c - (np.arange(len(own)) - np.repeat(np.cumsum(length) - length, length))
        token, kind = np.concatenate([np.empty(0, np.int64), *prefix]), np.floor(np.log(np.maximum(n, 1)) / np.log(1.25)).astype(np.int32)
        for k in (0, 1):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (token, kind + np.int32(k), key, label, n.astype(np.int32), rest.astype(np.int32))], names=["token", "class", "key", "label", "n", "rest"])


_NEAR = "token long, key long, label long, n int, other long"


def _partners(batches):
    """Rows of unsettled cells (token, class), sorted by them -> those with a partner of another label that may be linked, and one such label's star."""
    for t in whole_groups(batches, ["token", "class"]):
        token, kind, key, label, n, rest = (t.column(c).to_numpy() for c in ("token", "class", "key", "label", "n", "rest"))
        new = np.ones(len(token), bool)
        new[1:] = (token[1:] != token[:-1]) | (kind[1:] != kind[:-1])
        cuts = [*np.flatnonzero(new), len(token)]
        stay, other = np.zeros(len(token), bool), label.copy()
        for a, b in zip(cuts, cuts[1:], strict=False):
            m, r, lab = n[a:b].astype(np.int64), rest[a:b].astype(np.int64), label[a:b]
            root = np.arange(b - a)
            for at in range(0, b - a, 1024):
                x = slice(at, min(at + 1024, b - a))
                ok = (9 * np.minimum(r[x, None], r[None]) >= 4 * (m[x, None] + m[None])) & (lab[x, None] != lab[None])
                p, q = np.nonzero(ok)
                hook(root, p + at, q)
                stay[a + at : a + x.stop] |= ok.any(1)
            other[a:b] = lab[root]
        own = np.flatnonzero(stay)
        yield pa.RecordBatch.from_arrays([pa.array(x[own]) for x in (token, key, label, n, other)], names=["token", "key", "label", "n", "other"])


_TILE = ["group", "bucket", "c", "d"]


def _link_tiles(batches):
    """Rows sorted by block or tile -> links between labels."""
    for t in whole_groups(batches, _TILE):
        place = np.stack([t.column(c).to_numpy().astype(np.int64) for c in _TILE], 1)
        new = np.ones(len(place), bool)
        new[1:] = (place[1:] != place[:-1]).any(1)
        cuts = [*np.flatnonzero(new), len(place)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            own = t.slice(a, b - a).combine_chunks()
            if pa.compute.count_distinct(own.column("label")).as_py() > 1:
                x, y = _link(own, True)
                yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], names=["a", "b"])
    tidy()


def _unsettled(found: DataFrame, edges: DataFrame, n: int, made: list[str]) -> DataFrame | None:
    """Links between the components that ``edges`` make of the candidates ``found``, in ``n`` parts; None where nothing can be linked any more."""
    roots = components(edges, "labels")
    rows = found.join(roots, found["key"] == roots["id"], "left").select("key", F.coalesce("root", "key").alias("label"), "n", (F.length("tokens") / 8).cast("int").alias("c"), "prefix")
    place = rows.mapInArrow(_places, _PLACE)
    cells = place.groupBy("token", "class").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count("*").alias("keys")).where("x <> y").select("token", "class", "keys", "x")
    place = place.join(cells, ["token", "class"])
    few = place.where(F.col("keys") <= CELL_KEYS).select("token", "class", "key", "label", "n", "rest").repartition(n, "token", "class").sortWithinPartitions("token", "class")
    near = few.mapInArrow(_partners, _NEAR).unionByName(place.where(F.col("keys") > CELL_KEYS).select("token", "key", "label", "n", F.col("x").alias("other")))
    near = stored(near, "near", made)
    if not near.take(1):
        return None
    groups = components(near.select(F.col("label").alias("a"), F.col("other").alias("b")), "groups")
    keys = near.groupBy("key").agg(F.first("label").alias("label"), F.first("n").alias("n"), F.collect_set("token").alias("at"))
    keys = stored(keys.join(groups, keys["label"] == groups["id"]).select(F.col("root").alias("group"), "key", "label", "n", "at"), "near-keys", made)
    pieces_of = lambda rows, *by: rows.groupBy(*by).agg(F.ceil(F.greatest(F.count("*") / BLOCK_KEYS, F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("pieces"))
    buckets = keys.join(pieces_of(keys, "group"), "group")
    bucket = F.when(F.col("pieces") == 1, F.array(F.lit(0))).otherwise(F.array_distinct(F.transform("at", lambda t: F.pmod(F.xxhash64(t), "pieces").cast("int"))))
    buckets = buckets.select("group", "key", "label", "n", F.explode(bucket).alias("bucket"))
    # one shingle may have more keys than fit a task: pairs of chunks (c, d), c <= d; a row of chunk k is in (k, d) for d >= k and in (c, k) for c < k
    tiles = buckets.join(pieces_of(buckets, "group", "bucket"), ["group", "bucket"])
    tiles = tiles.withColumn("own", F.pmod(F.xxhash64("key"), "pieces").cast("int")).withColumn("next", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    tiles = tiles.select("group", "bucket", F.least("own", "next").alias("c"), F.greatest("own", "next").alias("d"), "key", "label", "n")
    tiles = tiles.join(found.select("key", "tokens"), "key")
    return stored(tiles.repartition(n, *_TILE).sortWithinPartitions(*_TILE).mapInArrow(_link_tiles, "a long, b long"), "links", made)


def jaccard_components(docs: DataFrame, *, size: int = 5) -> DataFrame:
    """Connected components of documents whose sets of word shingles have a Jaccard similarity of 0.8 or more.

    ``docs`` has doc_id (integer) and text (string); other columns are not
    used.  A-Z are lower-cased, words are ``[^\\x20\\x09-\\x0D]+``, shingles are
    ``size`` consecutive words; fewer words are one shingle.  Returns doc_id
    long, n_shingles long and component_id long, the smallest doc_id reachable.

    Whole texts count, of any length; memory is bounded by a piece of text, or
    by one text where that is longer.  Documents with equal sets are joined
    before anything is compared, so repeated rows cost little.
    Null or blank text: 0 shingles, its own component.  A null doc_id takes
    part in links but is nobody's component_id.  Rows that repeat a doc_id are
    each returned.  An empty table gives an empty result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    made: list[str] = []
    info = stored(docs.mapInArrow(_info(size), _INFO_SQL), "sets")
    shingles = info.agg(F.coalesce(F.sum("n_shingles"), F.lit(0)).alias("n")).first()["n"]
    n = parts(spark, 8 * shingles)
    frequent = _frequent(info)
    shared = docs.select("text").where("text is not null").mapInArrow(_tokens(size, n, frequent), _PACKED_SQL).groupBy("part").applyInArrow(_shared(n), _PACKED_SQL)
    found = stored(shared.groupBy("part").applyInArrow(_candidates, _CANDIDATE), "candidates", made)
    del shared
    release(spark)
    rows, edges = found, None
    while True:  # a round follows only where keys of one least hash were cut, and where the one before has joined many
        blocks = rows.select("key", "n", "tokens", "least").repartitionByRange(n, "least", "key").sortWithinPartitions("least", "key")
        links = stored(blocks.mapInArrow(_cut_blocks(BLOCK_KEYS, BLOCK_SHINGLES), "a long, b long"), "links", made)
        known = links.where("a is not null")
        edges = known if edges is None else edges.union(known)
        if 4 * known.count() < rows.count() or not links.where("a is null").groupBy("b").count().where("count > 1").take(1):
            break
        rows = rows.join(known.select(F.col("a").alias("key")).distinct(), "key", "left_anti")
    more = _unsettled(found, edges, n, made)
    roots = components(edges if more is None else edges.union(more), "components")
    for folder in made:
        drop_folder(spark, folder)
    info = info.where("hot is null").select("doc_id", "n_shingles", "key")
    keyed = info.join(roots, info["key"] == roots["id"], "left").select("doc_id", "n_shingles", F.coalesce("root", "key").alias("group"))
    least = keyed.where("group is not null").groupBy(F.col("group").alias("_g")).agg(F.min("doc_id").alias("_least"))
    return keyed.join(least, keyed["group"] == least["_g"], "left").select("doc_id", "n_shingles", F.coalesce("_least", "doc_id").alias("component_id"))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP1_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS ws FROM documents
), sh AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i+4], ' ') AS s FROM w, unnest(range(1, greatest(len(ws) - 4, least(len(ws), 1)) + 1)) AS t(i)
), n AS (
  SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2
), e AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)
), r AS (
  SELECT doc_id AS id, doc_id AS o FROM documents UNION SELECT r.id, e.b FROM r JOIN e ON r.o = e.a
)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.c AS component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT id, min(o) AS c FROM r GROUP BY id) m ON m.id = d.doc_id
"""
