"""Documents in containers of fixed capacity by bin completion.

Items are spread over blocks of bounded size. In a block the incumbent is best-fit decreasing; branch and bound then
fills one container at a time around the largest item left, trying the undominated fillings in order of their sum and
pruning where the waste so far leaves no better solution. Containers that stay badly filled are dissolved and their
items packed once more across blocks.
"""

from __future__ import annotations

import base64
import importlib.util
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querymill.sources.tables import stage

CAPACITY = 2048
#: Sizes tried for one container, and for a block, about a second of one core.
FILLING_STEPS, SEARCH_STEPS = 20_000, 2_000_000
VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def tokenizer_folder() -> str:
    """Where the installed vocabulary files lie, here and on every executor."""
    spec = importlib.util.find_spec("public_tokenizers")
    return str(Path(spec.origin).parent) if spec and spec.origin else "/opt/tokenizers"


def token_counts(docs: DataFrame, folder: str | None = None, vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id, n_tokens`` of each document under a public byte-level vocabulary; null texts have no tokens."""
    where = folder or tokenizer_folder()

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import public_tokenizers
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, (Path(where) / vocabulary).open("rb"))}
        encoding = tiktoken.Encoding("counts", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_tokens": [len(encoding.encode_ordinary(t)) if t else 0 for t in pdf["text"]]})

    return docs.select("doc_id", "text").mapInPandas(count, "doc_id long, n_tokens long")


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing: indexes of the items of each container."""
    rooms: list[tuple[int, int]] = []
    bins: list[list[int]] = []
    for i in sorted(range(len(sizes)), key=lambda j: (-sizes[j], j)):
        at = bisect_left(rooms, (sizes[i], -1))
        if at < len(rooms):
            room, b = rooms.pop(at)
        else:
            room, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        insort(rooms, (room - sizes[i], b))
    return bins


def greedy(left: Counter, room: int) -> tuple[int, ...]:
    """The largest size that fits, again and again: nothing left fits in the rest, and no item could be a larger one."""
    out: list[int] = []
    for s in sorted((s for s, n in left.items() if n and 0 < s <= room), reverse=True):
        n = min(left[s], room // s)
        out += [s] * n
        room -= s * n
    return tuple(out)


def fillings(left: Counter, room: int, limit: int, steps: list[int] | None = None) -> list[tuple[int, ...]]:
    """Undominated ways to fill ``room`` with sizes of ``left``, best sum first, at most ``limit``.

    A filling is dominated when another size still fits in its rest, or when exchanging one of its items for the next
    larger size still fits. ``steps`` holds the number of sizes that may still be tried, and is counted down; when it
    ends, or ``FILLING_STEPS`` do, what was found stands, or else the greedy filling.
    """
    sizes = sorted((s for s, n in left.items() if n and 0 < s <= room), reverse=True)
    fitting = [-s for s in sizes]
    found: dict[tuple[int, ...], int] = {}
    total = steps if steps is not None else [FILLING_STEPS]
    budget = min(FILLING_STEPS, total[0])
    spare = budget
    smallest = sizes[-1] if sizes else room + 1

    def extend(at: int, rest: int, chosen: list[int]) -> None:
        nonlocal spare
        if spare < 0 or len(found) >= limit and min(found.values()) == 0:
            return
        if rest < smallest or at == len(sizes):
            spare -= len(sizes)
            grown = Counter(chosen)
            fits = rest >= smallest and any(n > grown[s] and 0 < s <= rest for s, n in left.items())
            exchanged = any(any(left[s] > grown[s] for s in sizes[bisect_left(fitting, -c - rest) : bisect_left(fitting, -c)]) for c in grown)
            if not fits and (rest == 0 or not exchanged):
                found[tuple(chosen)] = rest
            return
        for k in range(max(at, bisect_left(fitting, -rest)), len(sizes)):
            s = sizes[k]
            spare -= 1
            if left[s] > chosen.count(s):
                extend(k, rest - s, [*chosen, s])
                if rest == s or spare < 0:
                    return
        if chosen:
            extend(len(sizes), rest, chosen)

    extend(0, room, [])
    total[0] -= budget - spare
    if not found:
        best = greedy(left, room)
        found[best] = room - sum(best)
    return sorted(found, key=lambda f: (found[f], len(f), f))[:limit]


def complete(sizes: list[int], capacity: int = CAPACITY, nodes: int = 2_000, width: int = 6, steps: int = SEARCH_STEPS) -> list[list[int]]:
    """Indexes of the items of each container; no item exceeds the capacity.

    The search ends after ``nodes`` containers tried or ``steps`` sizes tried, and then the best packing found stands; of
    each container the ``width`` best fillings are tried.
    """
    incumbent = best_fit(sizes, capacity)
    total = sum(sizes)
    bound = -(-total // capacity)
    if len(incumbent) <= max(1, bound):
        return incumbent
    best: list[tuple[int, ...]] | None = None
    most = len(incumbent)
    left = Counter(sizes)
    chosen: list[tuple[int, ...]] = []
    waste = 0
    stack: list[Iterator[tuple[int, ...]]] = []
    budget = [steps]

    def branches() -> Iterator[tuple[int, ...]]:
        largest = max(s for s, n in left.items() if n)
        left[largest] -= 1
        options = fillings(left, capacity - largest, width, budget)
        left[largest] += 1
        return iter([(largest, *f) for f in options])

    items = sum(n for s, n in left.items() if s)
    stack.append(branches())
    while stack and nodes > 0 and budget[0] > 0:
        option = next(stack[-1], None)
        if option is None:
            stack.pop()
            if chosen:
                undone = chosen.pop()
                left.update(undone)
                items += len(undone)
                waste -= capacity - sum(undone)
            continue
        nodes -= 1
        lost = capacity - sum(option)
        if waste + lost > (most - 1) * capacity - total:
            continue
        chosen.append(option)
        left.subtract(option)
        items -= len(option)
        waste += lost
        if not items:
            if len(chosen) < most:
                best, most = list(chosen), len(chosen)
                if most <= bound:
                    break
            left.update(option)
            items += len(option)
            waste -= lost
            chosen.pop()
            continue
        stack.append(branches())
    if best is None:
        return incumbent
    index: dict[int, list[int]] = {}
    for i, s in enumerate(sizes):
        index.setdefault(s, []).append(i)
    bins = [[index[s].pop() for s in option] for option in best]
    bins[0] += index.get(0, [])
    return bins


def _packer(capacity: int, turn: int):  # noqa: ANN202
    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "doc_id", "part"], ignore_index=True)
        bins = complete(pdf["size"].tolist(), capacity)
        place = pd.Series(0, index=pdf.index)
        fill = pd.Series(0, index=pdf.index)
        for b, members in enumerate(bins):
            place[members] = b
            fill[members] = int(pdf["size"].iloc[members].sum())
        name = f"{turn}-" + pdf["block"].astype(str) + "-" + place.astype(str)
        return pd.DataFrame({"doc_id": pdf["doc_id"], "part": pdf["part"], "size": pdf["size"], "container": name, "fill": fill})

    return pack


def _blocks(items: DataFrame, capacity: int, containers: int, most_items: int) -> DataFrame:
    """Items spread by hash over blocks of about ``containers`` containers, and of ``most_items`` items at most in the mean."""
    total = items.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("s"), F.count(F.lit(1)).alias("n")).first()
    n = max(1, round(total["s"] / (capacity * containers)), -(-total["n"] // most_items))
    return items.withColumn("block", F.pmod(F.xxhash64("doc_id", "part"), F.lit(n))).repartition(min(n, 20_000), "block")


def pack(sizes: DataFrame, capacity: int = CAPACITY, containers: int = 400, most_items: int = 20_000, good: float = 0.99) -> DataFrame:
    """``doc_id, part, size, container, fill`` for sizes (doc_id, n_tokens).

    A document larger than the capacity is cut into parts, all but the last full; any other is one part. Containers
    filled below ``good`` are dissolved and packed once more. Defined cases: documents without tokens go into some
    container; repeated rows of a doc_id are packed once, with the largest size; no documents, no containers.
    """
    whole = sizes.groupBy("doc_id").agg(F.max(F.coalesce("n_tokens", F.lit(0))).alias("n_tokens"))
    last = F.greatest(F.lit(0), F.ceil(F.col("n_tokens") / capacity) - 1).cast("int")
    parts = whole.select("doc_id", "n_tokens", F.explode(F.sequence(F.lit(0), last)).alias("part"))
    cut = parts.select("doc_id", "part", F.least(F.lit(capacity), F.col("n_tokens") - F.col("part") * capacity).alias("size"))
    cut = stage(cut, "sizes")
    full = cut.where(F.col("size") == capacity).select("doc_id", "part", "size", F.concat(F.lit("f-"), "doc_id", F.lit("-"), "part").alias("container"), F.lit(capacity).cast("long").alias("fill"))
    schema = "doc_id long, part int, size long, container string, fill long"
    first = stage(_blocks(cut.where(F.col("size") < capacity), capacity, containers, most_items).groupBy("block").applyInPandas(_packer(capacity, 1), schema), "packed")
    loose = _blocks(first.where(F.col("fill") < capacity * good).select("doc_id", "part", "size"), capacity, containers, most_items)
    again = loose.groupBy("block").applyInPandas(_packer(capacity, 2), schema)
    return full.unionByName(first.where(F.col("fill") >= capacity * good)).unionByName(again)
