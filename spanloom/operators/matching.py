"""One-to-one matching of found and gold spans within an item."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RULES = {
    "exact": lambda a, b: a == b,
    "overlap": lambda a, b: a[0] < b[1] and b[0] < a[1],
    "iou50": lambda a, b: (both := min(a[1], b[1]) - max(a[0], b[0])) > 0 and 2 * both >= (a[1] - a[0]) + (b[1] - b[0]) - both,
}


def maximum_matching(found: list[tuple[int, int]], gold: list[tuple[int, int]], rule: str) -> dict[int, int]:
    """gold number to found number, of greatest size, by augmenting paths in input order (kept on a stack of its own)."""
    test = RULES[rule]
    near = [[j for j, g in enumerate(gold) if test(f, g)] for f in found]
    owner: dict[int, int] = {}
    for start in range(len(found)):
        came: dict[int, int] = {}
        stack, end = [start], None
        while stack and end is None:
            i = stack.pop()
            for j in near[i]:
                if j in came:
                    continue
                came[j] = i
                if j not in owner:
                    end = j
                    break
                stack.append(owner[j])
        while end is not None:
            i = came[end]
            before = next((j for j, o in owner.items() if o == i), None)
            owner[end] = i
            end = before
    return owner


def greedy_matching(found: list[tuple[int, int]], gold: list[tuple[int, int]], rule: str = "overlap") -> dict[int, int]:
    """Found spans, in order, take the first free gold span that matches."""
    test, out = RULES[rule], {}
    for i, f in enumerate(found):
        for j, g in enumerate(gold):
            if j not in out and test(f, g):
                out[j] = i
                break
    return out


def match_counts(found: DataFrame, gold: DataFrame, rule: str = "overlap", how=maximum_matching) -> DataFrame:
    """(item_id, tp, fp, fn): found (item_id, f_start, f_end) and gold (item_id, g_start, g_end), gathered by item.

    A group is one message's spans, so its size is bounded by a message and not by the table; items are matched a batch
    at a time."""
    f = found.groupBy("item_id").agg(F.sort_array(F.collect_list(F.array(F.col("f_start").cast("long"), F.col("f_end").cast("long")))).alias("f"))
    g = gold.groupBy("item_id").agg(F.sort_array(F.collect_list(F.array(F.col("g_start").cast("long"), F.col("g_end").cast("long")))).alias("g"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        spans = lambda x: [] if x is None else [tuple(y) for y in x]
        for frame in frames:
            rows = []
            for r in frame.itertuples(index=False):
                fs, gs = spans(r.f), spans(r.g)
                tp = len(how(fs, gs, rule))
                rows.append((r.item_id, tp, len(fs) - tp, len(gs) - tp))
            yield pd.DataFrame(rows, columns=["item_id", "tp", "fp", "fn"])

    return f.join(g, "item_id", "full_outer").mapInPandas(run, "item_id long, tp long, fp long, fn long")
