"""Exact quantiles of many columns at once: mergeable sketches bracket them, counts and the few values between decide.

The first pass keeps a KLL sketch of every column. It names two data values around each wanted rank; the second pass counts
what lies below and between them for all columns and sorts only the values between, some thousandths of the rows. Where those are
still too many, they are sketched in turn. A bracket that missed (sketches err by chance) shows in the counts and is
moved, so results never depend on a sketch. No pass shuffles values or keeps a map of them.
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scalars as S

#: Size of a sketch, and a margin in ranks well above its error.
SKETCH_K, MARGIN = 4096, 0.003
#: Values between two bounds that one task may sort, and points of a sketch that refines more of them.
MOST_VALUES, POINTS = 200_000, 1000


def _around(ps: list[float]) -> list[float]:
    return sorted({min(1.0, max(0.0, p + d)) for p in ps for d in (-MARGIN, MARGIN)})


def _sketched(value: Column, ranks: list[float]) -> Column:
    """Values of the sketch at ``ranks``; null without values."""
    n = F.count(value)
    sketch = F.kll_sketch_agg_double(value, SKETCH_K)
    return F.when(n > 0, F.kll_sketch_get_quantile_double(sketch, F.array(*[F.lit(r) for r in ranks])))


def order_statistics(df: DataFrame, values: dict[str, Column], ranks: dict[str, list[int]], brackets: dict[tuple[str, int], tuple[float, float]], sizes: dict[str, int]) -> dict[tuple[str, int], float]:
    """The values at 0-based ``ranks`` of each column, given two data values around each; all columns together, in rounds."""
    todo = {(c, r): brackets[c, r] for c, rs in ranks.items() for r in rs}
    about = {k: sizes[k[0]] * 4 * MARGIN for k in todo}
    found: dict[tuple[str, int], float] = {}
    while todo:
        groups: dict[tuple, list[int]] = defaultdict(list)
        for (c, r), (lo, hi) in todo.items():
            groups[c, lo, hi].append(r)
        exprs, keys = [], list(groups)
        for i, (c, lo, hi) in enumerate(keys):
            v = values[c]
            inside = F.when((v > F.lit(lo)) & (v < F.lit(hi)), v)
            few = max(about[c, r] for r in groups[c, lo, hi]) <= MOST_VALUES
            between = F.sort_array(F.collect_list(inside)) if few else _sketched(inside, [j / POINTS for j in range(POINTS + 1)])
            exprs += [F.count_if(v < F.lit(lo)).alias(f"lt{i}"), F.count_if(v <= F.lit(lo)).alias(f"le{i}"), F.count(inside).alias(f"in{i}"), F.count_if(v <= F.lit(hi)).alias(f"top{i}"), between.alias(f"v{i}")]
        row = df.agg(*exprs)
        picks = []
        for i, key in enumerate(keys):
            few = max(about[key[0], r] for r in groups[key]) <= MOST_VALUES
            # of sorted values only the wanted ones leave Spark
            picks.append(F.array(*[F.get(f"v{i}", (F.lit(r) - F.col(f"le{i}")).cast("int")) for r in groups[key]]).alias(f"p{i}") if few else F.col(f"v{i}").alias(f"p{i}"))
        got = row.select(*[f"{n}{i}" for i in range(len(keys)) for n in ("lt", "le", "in", "top")], *picks).first()
        for i, key in enumerate(keys):
            c, lo, hi = key
            lt, le, inside, top = (got[f"{n}{i}"] for n in ("lt", "le", "in", "top"))
            few = max(about[c, r] for r in groups[key]) <= MOST_VALUES
            for j, r in enumerate(groups[key]):
                if lt <= r < le:
                    found[c, r] = lo
                elif le + inside <= r < top:
                    found[c, r] = hi
                elif le <= r < le + inside and few:
                    found[c, r] = got[f"p{i}"][j]
                elif le <= r < le + inside:
                    points = got[f"p{i}"]
                    at = (r - le) / inside
                    a, b = math.floor((at - MARGIN) * POINTS), math.ceil((at + MARGIN) * POINTS)
                    todo[c, r] = (points[a] if a >= 0 else lo, points[b] if b <= POINTS else hi)
                    about[c, r] = inside * 4 * MARGIN
                else:  # the sketch missed: the rank lies beyond a bound
                    todo[c, r] = (-math.inf, lo) if r < lt else (hi, math.inf)
                    about[c, r] = lt if r < lt else sizes[c] - top
                if (c, r) in found:
                    del todo[c, r]
    return found


def exact_quantiles(df: DataFrame, columns: dict[str, Column], ps: list[float]) -> dict[str, list[float] | None]:
    """The quantiles ``ps`` of each column, between two values on the line between them; None without values. Nulls and NaN are left out."""
    if not columns or not ps:
        return {c: None if ps else [] for c in columns}
    values = {c: S.not_nan(v.cast("double")) for c, v in columns.items()}
    near = _around(ps)
    names = list(values)
    first = df.agg(*[e for i, c in enumerate(names) for e in (F.count(values[c]).alias(f"n{i}"), _sketched(values[c], near).alias(f"s{i}"))]).first()
    sizes = {c: first[f"n{i}"] for i, c in enumerate(names)}
    ranks: dict[str, list[int]] = {}
    brackets = {}
    for i, c in enumerate(names):
        if not sizes[c]:
            continue
        place = dict(zip(near, first[f"s{i}"], strict=True))
        ranks[c] = []
        for p in ps:
            x = p * (sizes[c] - 1)
            for r in {math.floor(x), math.ceil(x)}:
                if (c, r) not in brackets:
                    ranks[c].append(r)
                    brackets[c, r] = (place[min(1.0, max(0.0, p - MARGIN))], place[min(1.0, max(0.0, p + MARGIN))])
    found = order_statistics(df, values, ranks, brackets, sizes) if ranks else {}

    def between(c: str, p: float) -> float:
        x = p * (sizes[c] - 1)
        a, b = math.floor(x), math.ceil(x)
        low, high = found[c, a], found[c, b]
        return low if low == high else (b - x) * low + (x - a) * high

    return {c: [between(c, p) for p in ps] if sizes[c] else None for c in names}
