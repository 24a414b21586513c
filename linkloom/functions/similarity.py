"""Similarities of strings, sets and vectors.

Everything that Spark's own functions express is a Column. Edit ratios over longest common
subsequences, partial matches and Jaro-Winkler aren't among them; `edit_ratios` computes
those together in one Arrow batch per call, each distinct pair of strings once.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

RATIOS = ("ratio", "partial_ratio", "token_sort_ratio", "token_set_ratio", "jaro_winkler")


def over(a: Column, b: Column) -> Column:
    """a / b as a double, 0 where b is 0."""
    return F.when(b != 0, a / F.when(b != 0, b)).otherwise(F.lit(0.0))


def jaccard(a: Column, b: Column) -> Column:
    return over(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b)))


def overlap(a: Column, b: Column) -> Column:
    return over(F.size(F.array_intersect(a, b)), F.least(F.size(a), F.size(b)))


def shared(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)).cast("double")


def prefix_ratio(a: Column, b: Column) -> Column:
    """Length of the common prefix by the shorter length."""
    least = F.least(F.length(a), F.length(b))
    same = F.size(F.filter(F.sequence(F.lit(1), least), lambda i: F.left(a, i) == F.left(b, i)))
    return F.when(least > 0, same / F.greatest(least, F.lit(1))).otherwise(F.lit(0.0))


def levenshtein(a: Column, b: Column) -> Column:
    """1 - distance / longer length; 0 if either is empty."""
    return F.when((a != "") & (b != ""), 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1))).otherwise(F.lit(0.0))


def length_difference(a: Column, b: Column) -> Column:
    return over(F.abs(F.length(a) - F.length(b)), F.greatest(F.length(a), F.length(b)))


def length_ratio(a: Column, b: Column) -> Column:
    return over(F.least(F.length(a), F.length(b)), F.greatest(F.length(a), F.length(b)))


def is_substring(a: Column, b: Column) -> Column:
    return ((F.length(a) >= 3) & (F.length(b) >= 3) & (F.contains(a, b) | F.contains(b, a))).cast("double")


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays within [0, 1]; 0 if either is null or zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a) * dot(b, b))
    return F.coalesce(F.least(F.lit(1.0), F.greatest(F.lit(0.0), over(dot(a, b), norm))), F.lit(0.0))


def clamped_logit(p: Column) -> Column:
    p = F.least(F.lit(1 - 1e-5), F.greatest(F.lit(1e-5), p))
    return F.least(F.lit(10.0), F.greatest(F.lit(-10.0), F.ln(p / (1 - p))))


def indel_ratio(a: Column, b: Column) -> Column:
    """2 LCS / (length a + length b) without Python, by bit-parallel LCS in a long: exact while the shorter string has at most 61 characters, null beyond."""
    short, long = F.when(F.length(a) <= F.length(b), a).otherwise(b), F.when(F.length(a) <= F.length(b), b).otherwise(a)
    chars = F.filter(F.split(short, ""), lambda c: c != "")
    full = (F.call_function("shiftleft", F.lit(1).cast("long"), F.length(short)) - 1).cast("long")
    bit = lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i)
    none = F.lit(0).cast("long")
    places = lambda of, c: F.aggregate(F.transform(of, lambda x, i: F.when(x == c, bit(i)).otherwise(none)), none, lambda s, v: s + v)
    # What a lambda holds is made anew in each step, so the places of each character are made once and carried along.
    masks = F.transform(F.array(chars), lambda x: F.map_from_arrays(F.array_distinct(x), F.transform(F.array_distinct(x), lambda c: places(x, c))))[0]

    def step(at: Column, c: Column) -> Column:
        v, masks = at["v"], at["masks"]
        u = v.bitwiseAND(F.coalesce(F.try_element_at(masks, c), none))
        return F.struct((v + u).bitwiseOR(v - u).bitwiseAND(at["full"]).alias("v"), masks.alias("masks"), at["full"].alias("full"))

    start = F.struct(full.alias("v"), masks.alias("masks"), full.alias("full"))
    left = F.aggregate(F.filter(F.split(long, ""), lambda c: c != ""), start, step, lambda at: at["v"])
    lcs = F.length(short) - F.bit_count(left)
    ratio = F.when(F.length(a) + F.length(b) == 0, F.lit(1.0)).otherwise(2 * lcs / F.greatest(F.length(a) + F.length(b), F.lit(1)))
    return F.when(F.length(short) <= 61, ratio)


def _masks(a: str) -> dict[str, int]:
    """The places of each character."""
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    return masks


def _lcs(n: int, masks: dict[str, int], b: str) -> int:
    """Longest common subsequence with a string of n characters, one whole-number step per character of b (Hyyrö's recurrence)."""
    v = full = (1 << n) - 1
    for c in b:
        if u := v & masks.get(c, 0):
            v = (v + u) | (v - u)
    return n - (v & full).bit_count()


def lcs_length(a: str, b: str) -> int:
    return _lcs(len(a), _masks(a), b)


def ratio(a: str, b: str) -> float:
    return 2 * lcs_length(a, b) / (len(a) + len(b)) if a or b else 1.0


def partial_ratio(a: str, b: str) -> float:
    """Best ratio of the shorter string over windows of the longer, windows cut off by its ends included."""
    if not a or not b:
        return float(a == b)

    def best(short: str, long: str) -> float:
        n, found, masks = len(short), 0.0, _masks(short)
        for start in range(1 - n, len(long)):
            window = long[max(0, start) : start + n]
            edge = window[-1] if start + n <= len(long) else window[0]
            if edge in masks and 2 * min(n, len(window)) / (n + len(window)) > found:
                found = max(found, 2 * _lcs(n, masks, window) / (n + len(window)))
                if found == 1.0:
                    break
        return found

    if len(a) == len(b):
        return max(best(a, b), best(b, a))
    return best(a, b) if len(a) < len(b) else best(b, a)


def token_sort_ratio(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set_ratio(a: str, b: str) -> float:
    """Best ratio among what both share, alone and followed by what only one has; 1 if one holds the other, 0 if either has no word."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, only_a, only_b = sorted(x & y), sorted(x - y), sorted(y - x)
    if both and not (only_a and only_b):
        return 1.0
    s, sa, sb = " ".join(both), " ".join(both + only_a), " ".join(both + only_b)
    return max([ratio(sa, sb)] + ([ratio(s, sa), ratio(s, sb)] if both else []))


def jaro_winkler(a: str, b: str) -> float:
    """Jaro's similarity, above 0.7 raised by a tenth of the gap for each of up to four common first characters; 0 if either is empty."""
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    used, pairs = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                pairs.append(c)
                break
    m = len(pairs)
    if not m:
        return 0.0
    swapped = sum(c != d for c, d in zip(pairs, (d for d, u in zip(b, used, strict=True) if u), strict=True)) // 2
    jaro = (m / len(a) + m / len(b) + (m - swapped) / m) / 3
    if jaro <= 0.7:
        return jaro
    prefix = next((k for k, (c, d) in enumerate(zip(a[:4], b[:4], strict=False)) if c != d), min(4, len(a), len(b)))
    return jaro + prefix * 0.1 * (1 - jaro)


def _frame(a: pd.Series, b: pd.Series, names: tuple[str, ...]) -> pd.DataFrame:
    by_name = {"ratio": ratio, "partial_ratio": partial_ratio, "token_sort_ratio": token_sort_ratio, "token_set_ratio": token_set_ratio, "jaro_winkler": jaro_winkler}
    seen: dict[tuple[str, str], tuple[float, ...]] = {}
    rows = []
    for pair in zip(a.fillna(""), b.fillna(""), strict=True):
        if pair not in seen:
            seen[pair] = tuple(by_name[n](*pair) for n in names)
        rows.append(seen[pair])
    return pd.DataFrame(rows, columns=list(names), dtype=float)


def edit_ratios(a: Column, b: Column, names: tuple[str, ...] = RATIOS) -> Column:
    """A struct with the named ratios, each within [0, 1]."""

    @F.pandas_udf(", ".join(f"{n} double" for n in names))
    def ratios(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        return _frame(x, y, names)

    return ratios(a, b)
