"""Tags and spans: functions over arrays of token tags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<label:string,start:int,end:int>>"


def spans(tags: Column, orphans: bool = False) -> Column:
    """(label, start, end) of each entity of BIO tags, end exclusive.

    An I- that continues nothing is left out, or with ``orphans`` begins an entity of its own.
    """
    state = F.struct(F.array().cast(SPAN).alias("done"), F.lit(0).alias("i"), F.lit("").alias("open"), F.lit(0).alias("start"))

    def step(s: Column, tag: Column) -> Column:
        label = F.substring(tag, 3, 1000)
        closed = F.when(s["open"] != "", F.concat(s["done"], F.array(F.struct(s["open"].alias("label"), s["start"].alias("start"), s["i"].alias("end"))))).otherwise(s["done"])
        goes_on = tag.startswith("I-") & (s["open"] == label)
        begins = tag.startswith("B-") | (tag.startswith("I-") & F.lit(orphans))
        return F.struct(
            F.when(goes_on, s["done"]).otherwise(closed).alias("done"),
            (s["i"] + 1).alias("i"),
            F.when(goes_on, s["open"]).when(begins, label).otherwise("").alias("open"),
            F.when(goes_on, s["start"]).otherwise(s["i"]).alias("start"),
        )

    def finish(s: Column) -> Column:
        return F.when(s["open"] != "", F.concat(s["done"], F.array(F.struct(s["open"].alias("label"), s["start"].alias("start"), s["i"].alias("end"))))).otherwise(s["done"])

    return F.aggregate(tags, state, step, finish)


def overlap(a: Column, b: Column) -> Column:
    """Whether two [start, end) structs share a position."""
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def merged(first: Column, second: Column) -> Column:
    """All spans of ``first`` and those of ``second`` that overlap none kept before, by start."""
    kept = F.aggregate(second, first, lambda acc, s: F.when(F.exists(acc, lambda x: overlap(x, s)), acc).otherwise(F.concat(acc, F.array(s))))
    return F.array_sort(kept, lambda a, b: F.when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).otherwise(0))


def with_hints(tags: Column, hints: Column, label: str, over: bool) -> Column:
    """Tags with [start, end) hints laid over: on any tags, or only where all are O."""

    def lay(acc: Column, h: Column) -> Column:
        free = F.forall(F.slice(acc, h["start"] + 1, h["end"] - h["start"]), lambda t: t == "O")
        laid = F.transform(acc, lambda t, i: F.when((i >= h["start"]) & (i < h["end"]), F.when(i == h["start"], f"B-{label}").otherwise(f"I-{label}")).otherwise(t))
        return laid if over else F.when(free, laid).otherwise(acc)

    return F.aggregate(hints, tags, lay)


def tail_after_entities(words: Column, tags: Column) -> Column:
    """The words behind the last tagged one; all words when none is tagged."""
    last = F.coalesce(F.array_max(F.filter(F.transform(tags, lambda t, i: F.when(t != "O", i + 1)), lambda x: x.isNotNull())), F.lit(0))
    return F.slice(words, last + 1, F.size(words))


def token_accuracy(a: Column, b: Column) -> Column:
    """Share of equal tags over the common length; null when it is 0."""
    n = F.least(F.size(a), F.size(b))
    same = F.aggregate(F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    return F.when(n > 0, same / n)
