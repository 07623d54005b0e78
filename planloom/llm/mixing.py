"""Mixing sources to target weights by subset-sum budget fitting.

Sources get targets by weight; what a source may not hold goes to the others. Each source's target
is then met with whole documents: its documents are counted by exact length, a bounded-knapsack
over lengths says how many of each length are wanted, and so many are chosen in a seeded order.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from planloom.llm.common import WORD, stored, text_of

#: The exact part of the fit runs over budgets of about this many words; what lies above is laid
#: out by proportion and by whole documents, longest first.
EXACT_BUDGET = 1 << 15
#: Documents of one source and length are numbered in this many parts, so that a hot length is
#: never ordered by one task.
PARTS = 256


def fit(lengths: Sequence[int], counts: Sequence[int], budget: int) -> list[int]:
    """How many documents of each length add up to the budget, or come nearest below it.

    First an equal share of every length, then whole documents from the longest down, then a
    bounded knapsack over the rest of the budget: bit b of a number is set if b words can be made.
    """
    total = sum(n * c for n, c in zip(lengths, counts, strict=True))
    if budget >= total:
        return list(counts)
    taken = [c * budget // total if n else 0 for n, c in zip(lengths, counts, strict=True)]
    rest = budget - sum(n * t for n, t in zip(lengths, taken, strict=True))
    order = sorted((k for k in range(len(lengths)) if lengths[k]), key=lambda k: -lengths[k])
    for k in order:
        more = min(counts[k] - taken[k], max(0, rest - EXACT_BUDGET) // lengths[k])
        taken[k] += more
        rest -= more * lengths[k]
    mask, reach = (1 << rest + 1) - 1, 1
    steps = []  # (length index, copies, sums that could be made before)
    for k in order:
        left, size = counts[k] - taken[k], 1
        left = min(left, rest // lengths[k])
        while left and not reach >> rest & 1:
            copies = min(size, left)
            steps.append((k, copies, reach))
            reach |= reach << copies * lengths[k] & mask
            left -= copies
            size *= 2
        if reach >> rest & 1:
            break
    best = reach.bit_length() - 1
    for k, copies, before in reversed(steps):
        if not before >> best & 1:
            best -= copies * lengths[k]
            taken[k] += copies
    return taken


def targets(sizes: DataFrame, weights: Sequence[int], share: float, most: int) -> DataFrame:
    """(source, source_size, target) of (source, size) rows, one per document.

    Sources in code-point order, null last, get the weights in turn. A target is share * all words
    by weight, at most `most` times the source's words; the excess goes to the others by weight
    until none is above. That is one level L with target = min(most * words, L * weight): with the
    sources in order of most * words / weight, L is the first level that its source can take; the
    levels after it are lower.
    One row per source; no text.
    """
    by_name, by_ratio = W.orderBy(F.col("source").asc_nulls_last()), W.orderBy("ratio", F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("no") - 1, F.lit(len(weights))) + 1).cast("int"))
    sources = (
        sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
        .withColumn("no", F.row_number().over(by_name))
        .withColumn("weight", weight.cast("double"))
        .withColumn("cap", most * F.col("source_size").cast("double"))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("all", share * F.sum("source_size").over(W.partitionBy()))
        .withColumn("capped", F.sum("cap").over(by_ratio.rowsBetween(W.unboundedPreceding, -1)))
        .withColumn("open_weight", F.sum("weight").over(by_ratio.rowsBetween(0, W.unboundedFollowing)))
        .withColumn("level", (F.col("all") - F.coalesce("capped", F.lit(0.0))) / F.col("open_weight"))
        .withColumn("found", F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(W.partitionBy()))
    )
    reach = F.when(F.col("level") <= F.col("ratio"), F.col("found") * F.col("weight")).otherwise(F.col("cap"))
    return sources.select("no", "source", "source_size", F.least("cap", reach).alias("target"))


def mix(
    docs: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, most: int = 2, seed: int = 17,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """One row per document: id, size (its words), source_size, target (its source's), copies
    (how often the mix takes it) and taken (words it takes: copies * size).

    A null or empty text has size 0 and takes nothing; documents without a source are a source of
    their own, the last. Repeated rows are documents of their own. A mix of no words has targets
    of 0. The seed fixes the choice; among rows equal in id, size and source it does not matter
    which is chosen. Other columns are not read.

    Only (id, source, size) is shuffled, never a text. Per source one task sees the histogram of
    its lengths: as many rows as it has different lengths.
    """
    sized = stored(docs.select(
        F.col(id_col).alias("id"), F.col(source_col).alias("source"),
        F.regexp_count(text_of(text_col), F.lit(WORD)).cast("bigint").alias("size"),
    ))
    goals = stored(targets(sized, weights, share, most))
    placed = sized.join(goals, sized["source"].eqNullSafe(goals["source"])).drop("source")
    lengths = (
        sized.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")).alias("h")
        .join(goals.alias("g"), F.col("h.source").eqNullSafe(F.col("g.source")))
        .select("g.no", "h.size", "h.n", "g.source_size", "g.target")
    )

    def quotas(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("size")
        whole, target = int(rows["source_size"].iloc[0]), rows["target"].iloc[0]
        rounds = min(most, int(target // whole)) if whole else 0
        budget = int(target - rounds * whole + 0.5) if whole else 0
        sizes, counts = rows["size"].tolist(), rows["n"].tolist()
        more = fit(sizes, counts, budget) if budget and rounds < most else [0] * len(sizes)
        return pd.DataFrame({"no": rows["no"], "size": rows["size"], "rounds": rounds, "quota": more})

    quota = lengths.groupBy("no").applyInPandas(quotas, "no int, size bigint, rounds int, quota bigint")
    keyed = placed.withColumn("h", F.xxhash64(F.col("id").cast("string"), F.lit(seed))).withColumn(
        "part", F.pmod(F.col("h"), F.lit(PARTS)).cast("int")
    )
    parts = keyed.groupBy("no", "size", "part").agg(F.count(F.lit(1)).alias("n"))
    before = W.partitionBy("no", "size").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = (
        parts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
        .join(quota, ["no", "size"]).select("no", "size", "part", "before", "rounds", "quota")
    )
    inside = W.partitionBy("no", "size", "part").orderBy("h", "id")
    copies = F.col("rounds") + (F.col("before") + F.col("rank") <= F.col("quota")).cast("int")
    return (
        keyed.withColumn("rank", F.row_number().over(inside))
        .join(parts, ["no", "size", "part"])
        .select(
            F.col("id").alias(id_col), "size", "source_size", "target",
            F.when(F.col("size") > 0, copies).otherwise(0).alias("copies"),
        )
        .withColumn("taken", F.col("copies") * F.col("size"))
    )
