"""Exact percentiles of very many groups at once: distributed multi-select.

Each partition holds its values sorted by group. In a round every partition proposes the median of what is left of a
target's range; the median of the proposals, weighted by how many values stand behind each, becomes the pivot; values
below, at and above it are counted, and the part that can't hold the wanted rank is discarded. Counting for one pivot
and proposing the next for either side happen in the same pass. As soon as a quarter of the values is left, the values
of open ranges are written to a smaller table, which the next rounds read; so all rounds together read little more than
the first ones. What is kept between calls is the staged table of values by base group, so that any set of base groups
(days, partitions) can be put together afterwards.

Rank error: none. With ``rank_error`` e > 0 a target ends as soon as at most e * n values are left, and any of them is
within e * n ranks of the wanted one.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querymill.sources.tables import stage

#: This few values left of a target are fetched and sorted.
GATHER = 64
#: Values are written anew when at most this share of those read last round is left, unless there are few anyway.
LEFT, FEW = 0.25, 100_000


def _by_group(asked: list[tuple[int, float, float, float, bool]], members: list[list[tuple]]) -> dict[tuple, list[tuple[int, float, float, float, bool]]]:
    out: dict[tuple, list[tuple[int, float, float, float, bool]]] = {}
    for a in asked:
        for m in members[a[0]]:
            out.setdefault(m, []).append(a)
    return out


def _parts(pdf: pd.DataFrame, groups: list[str]) -> Iterator[tuple[tuple, np.ndarray]]:
    """(base group, its positions) of a batch."""
    for key, at in pdf.groupby(groups, dropna=False, sort=False).indices.items():
        yield tuple(None if x is None or x != x else x for x in (key if isinstance(key, tuple) else (key,))), at


class ValueStore:
    """Values by base group, staged: the state from which any union of base groups is answered."""

    def __init__(self, values: DataFrame, groups: list[str], max_groups: int = 1_000_000):
        """``values``: the columns of ``groups`` and ``value``; null, NaN and infinite values are left out, a null group value is a group."""
        clean = values.select(*groups, F.col("value").cast("double").alias("value")).where(F.abs("value") < math.inf)
        self.groups = groups
        self.staged = stage(clean.sortWithinPartitions(*groups, "value"), "values")
        sizes = self.staged.groupBy(*groups).count().limit(max_groups + 1).collect()
        if len(sizes) > max_groups:
            raise ValueError(f"more than {max_groups} base groups; answer them in parts")
        self.sizes = {tuple(r[:-1]): r[-1] for r in sizes}

    def percentiles(self, wanted: dict[tuple, Iterable[tuple]], shares: list[float], rank_error: float = 0.0, block: int = 20_000) -> dict[tuple[tuple, float], float]:
        """The smallest value that at least a share of a group's values don't exceed, by (name of the group, share).

        ``wanted`` names each group and lists its base groups. Targets are answered in blocks of ``block``, which bounds
        what the driver holds and sends. A group without values has no entry.
        """
        targets = []
        for name, members in wanted.items():
            own = [m for m in members if m in self.sizes]
            n = sum(self.sizes[m] for m in own)
            targets += [(name, q, own, n, min(n - 1, max(0, math.ceil(q * n - 1e-9) - 1))) for q in shares if n]
        found: dict[tuple[tuple, float], float] = {}
        for at in range(0, len(targets), block):
            part = targets[at : at + block]
            got = self._select([t[2] for t in part], [t[3] for t in part], [t[4] for t in part], rank_error)
            found |= {(t[0], t[1]): v for t, v in zip(part, got, strict=True)}
        return found

    def _select(self, members: list[list[tuple]], sizes: list[int], ranks: list[int], rank_error: float) -> list[float]:
        n = len(members)
        lo, hi, pivot = [-math.inf] * n, [math.inf] * n, [math.inf] * n
        left, k, out = list(sizes), list(ranks), [math.nan] * n
        first, active = True, set(range(n))
        rows, size = self.staged, sum(self.sizes.values())
        while active:
            asked = [(i, lo[i], hi[i], pivot[i], left[i] <= GATHER) for i in sorted(active)]
            open_ = sum(left[i] for i in active)
            if size > FEW and open_ <= LEFT * size:
                rows, size = stage(self._open(rows, asked, members), "values"), open_
            for r in self._round(rows, asked, members).collect():
                i = r["target"]
                if r["rest"]:
                    out[i] = sorted(r["rest"])[k[i]]
                    active.discard(i)
                elif k[i] < r["below"]:
                    hi[i], left[i], pivot[i] = (hi[i] if first else pivot[i]), r["below"], r["next_below"]
                elif k[i] < r["below"] + r["equal"]:
                    out[i] = pivot[i]
                    active.discard(i)
                else:
                    k[i] -= r["below"] + r["equal"]
                    lo[i], left[i], pivot[i] = pivot[i], r["above"], r["next_above"]
                if i in active and left[i] <= rank_error * sizes[i]:
                    out[i] = pivot[i]
                    active.discard(i)
            first = False
        return out

    def _open(self, rows: DataFrame, asked: list[tuple[int, float, float, float, bool]], members: list[list[tuple]]) -> DataFrame:
        """The values inside the range of some open target."""
        groups = self.groups
        by_group = _by_group(asked, members)

        def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                v, inside = pdf["value"].to_numpy(), np.zeros(len(pdf), bool)
                for name, at in _parts(pdf, groups):
                    for _, lo, hi, _, _ in by_group.get(name, ()):
                        inside[at] |= ((v[at] > lo) | (lo == -math.inf)) & ((v[at] < hi) | (hi == math.inf))
                yield pdf[inside]

        return rows.mapInPandas(keep, rows.schema)

    def _round(self, rows: DataFrame, asked: list[tuple[int, float, float, float, bool]], members: list[list[tuple]]) -> DataFrame:
        groups = self.groups
        by_group = _by_group(asked, members)

        def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            # only the numbers of asked groups are kept, eight bytes a value
            held: dict[tuple, list[np.ndarray]] = {}
            for pdf in batches:
                v = pdf["value"].to_numpy()
                for name, at in _parts(pdf, groups):
                    if name in by_group:
                        held.setdefault(name, []).append(v[at])
            rows = []
            for name, own in held.items():
                v = np.sort(np.concatenate(own), kind="stable")
                for i, lo, hi, pivot, gather in by_group[name]:
                    a, z = np.searchsorted(v, lo, "right"), np.searchsorted(v, hi, "left")
                    if lo == -math.inf:
                        a = 0
                    if hi == math.inf:
                        z = len(v)
                    if gather:
                        rows.append((i, 0, 0, 0, None, None, v[a:z].tolist()))
                        continue
                    p, r = (z, z) if pivot == math.inf and hi == math.inf else (np.searchsorted(v, pivot, "left"), np.searchsorted(v, pivot, "right"))
                    p, r = min(max(p, a), z), min(max(r, a), z)
                    rows.append((i, p - a, r - p, z - r, v[(a + p) // 2] if p > a else None, v[(r + z) // 2] if z > r else None, []))
            yield pd.DataFrame(rows, columns=["target", "below", "equal", "above", "mid_below", "mid_above", "rest"])

        seen = rows.mapInPandas(count, "target int, below long, equal long, above long, mid_below double, mid_above double, rest array<double>")
        return seen.groupBy("target").agg(
            F.sum("below").alias("below"),
            F.sum("equal").alias("equal"),
            F.sum("above").alias("above"),
            F.expr("percentile(mid_below, 0.5, greatest(below, 1))").alias("next_below"),
            F.expr("percentile(mid_above, 0.5, greatest(above, 1))").alias("next_above"),
            F.flatten(F.collect_list("rest")).alias("rest"),
        )


def delivered_once(calls: DataFrame, sides: dict[str, str], keep: list[str], ok: Column) -> DataFrame:
    """``side, value`` and the columns ``keep`` of each successful call, each call_id once a side: its smallest row_id with a time."""
    side = F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.col(c).alias("value")) for s, c in sides.items()])).alias("s")
    return (
        calls.where(ok)
        .select("call_id", "row_id", *keep, side)
        .where("s.value IS NOT NULL AND NOT isnan(s.value)")
        .groupBy("call_id", "s.side")
        .agg(F.min(F.struct("row_id", *keep, F.col("s.value").alias("value"))).alias("r"))
        .select("side", *[f"r.{c}" for c in keep], "r.value")
    )
