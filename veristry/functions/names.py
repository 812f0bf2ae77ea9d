"""Names of organisations and people, and their similarity."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Ordered replacements of a normaliser, as (pattern, replacement).
# Their order counts; a later rule sees what the earlier ones left.
RULES = {
    "default": [
        ("union free school district", "ufsd"),
        ("unified school district", "usd"),
        ("independent school district", "isd"),
        ("county school district", "csd"),
        ("regional school district", "rsd"),
        ("school district", "sd"),
        ("public schools", "ps"),
        ("city schools", "cs"),
        (r"\bno\.", ""),
        (r"\bsaint\b", "st"),
        (r"\bmount\b", "mt"),
    ],
    "PA": [
        ("school district", "sd"),
        ("area school district", "asd"),
        ("charter school", "cs"),
        ("cyber charter school", "ccs"),
    ],
}

HONORIFICS = r"^(?i)(dr|mr|mrs|ms|miss|rev|hon)\.?\s+"
SUFFIXES = r"(?i),?\s+(jr|sr|ii|iii|iv|ph\.?d|ed\.?d|esq)\.?$"


def normalise_name(name: Column | str, rules: list[tuple[str, str]] | str = "default") -> Column:
    """Lower case, the rules in order, without ``# . , ( )``, single spaces; null stays null."""
    rules = RULES[rules] if isinstance(rules, str) else rules
    c = F.trim(F.lower(F.col(name) if isinstance(name, str) else name))
    for pattern, replacement in rules:
        c = F.regexp_replace(c, pattern, replacement)
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"[#.,()]", ""), r"(?U)\s+", " "))


def split_person(name: Column | str) -> tuple[Column, Column]:
    """First and last name: 'Last, First' at the comma, else the first word and the rest; one word is a last name."""
    c = F.trim(F.regexp_replace(F.regexp_replace(F.col(name) if isinstance(name, str) else name, HONORIFICS, ""), SUFFIXES, ""))
    words = F.split(c, r"\s+")
    comma = c.contains(",")
    first = F.when(comma, F.trim(F.split_part(c, F.lit(","), F.lit(2)))).when(F.size(words) > 1, words[0]).otherwise(F.lit(""))
    last = F.when(comma, F.trim(F.split_part(c, F.lit(","), F.lit(1)))).when(F.size(words) > 1, F.array_join(F.slice(words, 2, 1000), " ")).otherwise(c)
    return first, last


def jaro(a: str, b: str) -> float:
    """Jaro similarity of two strings."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    free, left, right = [True] * len(b), [], []
    for i, x in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if free[j] and b[j] == x:
                free[j] = False
                left.append(x)
                break
    right = [y for y, f in zip(b, free, strict=True) if not f]
    m = len(left)
    if not m:
        return 0.0
    swaps = sum(x != y for x, y in zip(left, right, strict=True)) / 2
    return (m / len(a) + m / len(b) + (m - swaps) / m) / 3


def jaro_winkler(a: str | None, b: str | None, prefix: int = 4, weight: float = 0.1) -> float | None:
    """Jaro similarity raised by the length of the common prefix; null if either is null."""
    if a is None or b is None:
        return None
    j, same = jaro(a, b), 0
    for x, y in zip(a[:prefix], b[:prefix], strict=False):
        if x != y:
            break
        same += 1
    return j + same * weight * (1 - j)


def _letters(strings: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A row of code points for each string, and the strings' lengths."""
    x = np.array(strings, dtype=str)
    length = np.char.str_len(x)
    wide = max(1, int(length.max(initial=0)))
    return np.ascontiguousarray(x.astype(f"U{wide}")).view(np.uint32).reshape(len(x), wide), length


def _kinds(x: np.ndarray, length: np.ndarray, kinds: int = 32) -> np.ndarray:
    """How often each remainder of a code point occurs in each string."""
    count = np.zeros((len(x), kinds), np.int16)
    for k in range(x.shape[1]):
        own = np.flatnonzero(length > k)
        count[own, x[own, k] % kinds] += 1
    return count


def _common_at_most(a: np.ndarray, la: np.ndarray, b: np.ndarray, lb: np.ndarray, kinds: int = 32) -> np.ndarray:
    """How many characters two strings can have in common, wherever they stand; counts code points by remainder."""
    return np.minimum(_kinds(a, la, kinds), _kinds(b, lb, kinds)).sum(1)


def _jaro_rows(a: np.ndarray, la: np.ndarray, b: np.ndarray, lb: np.ndarray) -> np.ndarray:
    """``jaro`` of each row's two strings, none of them empty."""
    n, places = len(a), np.arange(b.shape[1])
    reach = np.maximum(0, np.maximum(la, lb) // 2 - 1)
    free = places < lb[:, None]
    met = np.zeros(a.shape, bool)
    for i in range(a.shape[1]):
        fit = free & (b == a[:, i : i + 1]) & (np.abs(places - i) <= reach[:, None]) & (la > i)[:, None]
        own = np.flatnonzero(fit.any(1))
        free[own, fit[own].argmax(1)] = False
        met[own, i] = True
    taken = (places < lb[:, None]) & ~free
    m = met.sum(1)
    first = lambda x, mask: np.take_along_axis(x, np.argsort(~mask, 1, kind="stable"), 1)
    wide = min(a.shape[1], b.shape[1])
    left, right = first(a, met)[:, :wide], first(b, taken)[:, :wide]
    swaps = ((left != right) & (np.arange(wide) < m[:, None])).sum(1) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(m > 0, (m / la + m / lb + (m - swaps) / m) / 3, 0.0) if n else np.zeros(0)


def jaro_winkler_rows(a: np.ndarray, b: np.ndarray, cut: float = 0.0) -> np.ndarray:
    """``jaro_winkler`` of each pair of strings; NaN where the strings' characters rule out ``cut``."""
    (x, la), (y, lb) = _letters(a), _letters(b)
    wide = min(4, x.shape[1], y.shape[1])
    same = (x[:, :wide] == y[:, :wide]) & (np.arange(wide) < np.minimum(la, lb)[:, None])
    prefix = np.cumprod(same, 1).sum(1)
    raised = lambda j: j + 0.1 * prefix * (1 - j)
    with np.errstate(divide="ignore", invalid="ignore"):
        m = _common_at_most(x, la, y, lb)
        most = np.where(m > 0, (m / la + m / lb + 1) / 3, 0.0)
    some = np.flatnonzero((raised(most) >= cut - 1e-9) & (la > 0) & (lb > 0))
    out = np.where((la == 0) & (lb == 0), 1.0, 0.0)
    out[(raised(most) < cut - 1e-9) & (la > 0) & (lb > 0)] = np.nan
    if len(some):
        out[some] = _jaro_rows(x[some], la[some], y[some], lb[some])
        out[some] += 0.1 * prefix[some] * (1 - out[some])
    return out


def _places(x: np.ndarray, lx: np.ndarray, y: np.ndarray, ly: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of each character of ``x`` among the distinct ones, and for each of these a word of bits for each string of ``y``: where it stands."""
    kinds, at = np.unique(x, return_inverse=True)
    at = at.reshape(x.shape)
    bits = np.zeros((len(kinds), len(y)), np.uint64)
    for k in range(y.shape[1]):
        own = np.flatnonzero(ly > k)
        kind = np.minimum(np.searchsorted(kinds, y[own, k]), len(kinds) - 1)
        met = kinds[kind] == y[own, k]
        bits[kind[met], own[met]] |= np.uint64(1 << k)
    return at, bits


def _jaro_bits(places: tuple[np.ndarray, np.ndarray], la: np.ndarray, lb: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """``jaro`` of the strings at ``i`` and ``j``, the second of 64 characters at most; 0 where one is empty."""
    (at, bits), la, lb, one = places, la[i], lb[j], np.uint64(1)
    reach = np.maximum(0, np.maximum(la, lb) // 2 - 1)
    up_to = lambda n: np.where(n >= 64, ~np.uint64(0), (one << np.clip(n, 0, 63).astype(np.uint64)) - one)
    free, met = up_to(lb), []
    longest = int(la.max(initial=0))
    for k in range(longest):
        fit = bits[at[i, k], j] & free & up_to(k + reach + 1) & ~up_to(k - reach)
        fit[la <= k] = 0
        free ^= fit & (~fit + one)  # the first of them
        met.append(fit != 0)
    taken, m, swaps = up_to(lb) & ~free, np.zeros(len(i), int), np.zeros(len(i), int)
    for k in range(longest):
        first = np.where(met[k], taken & (~taken + one), np.uint64(0))
        m += met[k]
        swaps += met[k] & ((bits[at[i, k], j] & first) == 0)
        taken ^= first
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(m > 0, (m / la + m / lb + (m - swaps / 2) / m) / 3, 0.0)


def similar_in_tile(a: np.ndarray, b: np.ndarray, cut: float, best: bool = False, only: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places in ``a`` and in ``b``, and Jaro-Winkler similarity, of all pairs from ``cut`` on.

    With ``best``, only those of each ``a`` that are most similar, to nine
    digits.  Pairs whose characters rule them out are not compared, nor those
    that are not in ``only``, a table of booleans.
    """
    (x, la), (y, lb) = _letters(a), _letters(b)
    counts = [_kinds(*own) for own in ((x, la), (y, lb))]
    m = np.minimum(counts[0][:, None], counts[1][None]).sum(2)
    wide = min(4, x.shape[1], y.shape[1])
    shorter = np.minimum(la[:, None], lb[None])
    same = (x[:, None, :wide] == y[None, :, :wide]) & (np.arange(wide) < shorter[:, :, None])
    prefix = np.cumprod(same, 2).sum(2)
    with np.errstate(divide="ignore", invalid="ignore"):
        most = np.where(m > 0, (m / la[:, None] + m / lb[None] + 1) / 3, 0.0)
    most = np.where((la[:, None] == 0) & (lb[None] == 0), 1.0, most + 0.1 * prefix * (1 - most))
    open_ = most >= cut - 1e-9
    if only is not None:
        open_ &= only

    places = _places(x, la, y, lb) if y.shape[1] <= 64 else None

    def compared(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        out = np.full(len(i), np.nan)
        for at in range(0, len(i), 8192):
            own = slice(at, at + 8192)
            p, q = i[own], j[own]
            if places is None:
                out[own] = jaro_winkler_rows(a[p], b[q])
            else:
                jaros = np.where((la[p] == 0) & (lb[q] == 0), 1.0, _jaro_bits(places, la, lb, p, q))
                out[own] = jaros + 0.1 * prefix[p, q] * (1 - jaros)
        return out

    done = [np.zeros(0, int), np.zeros(0, int), np.zeros(0)]
    if best and open_.any():
        first = np.argpartition(-most, min(4, len(b)) - 1, axis=1)[:, :4]
        i, j = np.repeat(np.arange(len(a)), first.shape[1]), first.ravel()
        some = open_[i, j]
        i, j = i[some], j[some]
        done = [i, j, compared(i, j)]
        reached = np.full(len(a), -1.0)
        np.maximum.at(reached, i, done[2])
        open_ &= most >= reached[:, None] - 1e-8
        open_[i, j] = False
    i, j = np.nonzero(open_)
    i, j, s = (np.concatenate(z) for z in zip(done, (i, j, compared(i, j)), strict=True))
    keep = s >= cut
    i, j, s = i[keep], j[keep], s[keep]
    if best:
        top = np.full(len(a), -1.0)
        np.maximum.at(top, i, np.round(s, 9))
        keep = np.round(s, 9) == top[i]
        i, j, s = i[keep], j[keep], s[keep]
    return i, j, s


def rounded(x: np.ndarray, digits: int) -> np.ndarray:
    """Numbers from 0 on, rounded as the SQL function does it: by their shortest decimal form, halves up; NaN stays."""
    scaled = x * 10.0**digits
    out = np.floor(scaled + 0.5)
    near = np.abs(scaled - np.floor(scaled) - 0.5) < 1e-6  # here the product's own rounding counts
    values, at = np.unique(x[near], return_inverse=True)
    out[near] = np.array([float(Decimal(repr(float(v))).scaleb(digits).to_integral_value(ROUND_HALF_UP)) for v in values])[at]
    return out / 10.0**digits


def similarity_from(cut: float = 0.0) -> Callable:
    """Jaro-Winkler similarity of two string columns, whole Arrow batches at a time; null where it can't reach ``cut``."""

    @F.pandas_udf(T.DoubleType())
    def similarity(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in pairs:
            out = np.full(len(a), np.nan)
            known = np.flatnonzero(a.notna().to_numpy() & b.notna().to_numpy())
            for at in range(0, len(known), 4096):
                own = known[at : at + 4096]
                out[own] = jaro_winkler_rows(a.to_numpy()[own], b.to_numpy()[own], cut)
            yield pd.Series(out).astype("object").where(~np.isnan(out), None)

    return similarity


similarity = similarity_from()


def can_reach(a: Column, b: Column, cut: float) -> Column:
    """Whether two strings' lengths allow a Jaro-Winkler similarity of ``cut``; loses no pair."""
    la, lb = F.length(a), F.length(b)
    most = (2 + F.least(la, lb) / F.greatest(la, lb)) / 3
    return most + 0.4 * (1 - most) >= cut
