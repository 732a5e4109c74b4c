"""Greedy grouping of a sorted array, where each group's end depends on where it began.

No window function states this, as a group's limit starts anew after each cut. The fold runs in the JVM over one array
for each key and keeps only where groups begin.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def sorted_items(*columns: str) -> Column:
    """Aggregate: the key's rows as structs, sorted by the columns in their order."""
    return F.array_sort(F.collect_list(F.struct(*columns)))


def group_starts(items: Column, first_fields: list[str], closes: Callable[[Column, Column, Column], Column], *, after: bool) -> Column:
    """Indices at which groups begin.

    closes(first, item, n) says whether a group with that first item and n items, this one included, is cut at the item:
    after it, or before it, so that the item begins the next group.
    """
    n_items = F.size(items)

    def step(acc: Column, item: Column) -> Column:
        at, begins = acc["at"], acc["open"] == F.lit(False)
        first = {f: F.when(begins, item[f]).otherwise(acc["first"][f]) for f in first_fields}
        n = F.when(begins, 1).otherwise(acc["n"] + 1)
        cut = F.coalesce(closes(first, item, n), F.lit(False))
        if after:
            starts = F.when(begins, F.concat(acc["starts"], F.array(at))).otherwise(acc["starts"])
            return F.struct((at + 1).alias("at"), (~cut).alias("open"), F.struct(*(first[f].alias(f) for f in first_fields)).alias("first"), n.alias("n"), starts.alias("starts"))
        begins = begins | cut
        first = {f: F.when(begins, item[f]).otherwise(acc["first"][f]) for f in first_fields}
        starts = F.when(begins, F.concat(acc["starts"], F.array(at))).otherwise(acc["starts"])
        return F.struct((at + 1).alias("at"), F.lit(True).alias("open"), F.struct(*(first[f].alias(f) for f in first_fields)).alias("first"), F.when(begins, 1).otherwise(n).alias("n"), starts.alias("starts"))

    nothing = F.get(items, n_items)  # a null item, of the items' own type
    zero = F.struct(
        F.lit(0).alias("at"), F.lit(False).alias("open"), F.struct(*(nothing[f].alias(f) for f in first_fields)).alias("first"), F.lit(0).alias("n"), F.array().cast("array<int>").alias("starts")
    )
    return F.aggregate(items, zero, step, lambda acc: acc["starts"])


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value evaluated once however often `use` names it: a lambda's variable is only read."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def groups(items: Column, starts: Column) -> Column:
    """The items of each group."""

    def cut(both: Column) -> Column:
        own, firsts = both["items"], both["starts"]
        ends = F.concat(F.slice(firsts, 2, F.greatest(F.size(firsts) - 1, F.lit(0))), F.array(F.size(own)))
        return F.transform(F.arrays_zip(firsts.alias("first"), ends.alias("until")), lambda g: F.slice(own, g["first"] + 1, g["until"] - g["first"]))

    return bound(F.struct(items.alias("items"), starts.alias("starts")), cut)
