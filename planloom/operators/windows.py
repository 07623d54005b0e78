"""Ordered per-group computations that survive one group holding a third of all rows.

A plain window ships a whole group to one task. Here the group is first cut along its
order column into buckets: of fixed width (by_width) or, by splitters from a quantile sketch, of about
as many rows each (by_depth). Each bucket is its own window partition, and
what crosses a bucket border (a count, a maximum, the last row) is carried by a summary
of one row per bucket. Small groups fall into one bucket and cost one extra small join.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from planloom.session import stored

BUCKET = "_bucket"


def by_width(order: Column, width: int) -> Column:
    """Bucket of a numeric order column."""
    return F.floor(order / width).cast("bigint")


#: Rows of a bucket cut by depth, about; and buckets of a group at most.
DEPTH, MOST_CUTS = 50_000, 1_000


def by_depth(df: DataFrame, keys: list[str], order: Column, name: str, rows: int = DEPTH, most: int = MOST_CUTS) -> DataFrame:
    """df with `name`, a bucket of about `rows` rows of its group along a numeric order.

    Groups of more rows are cut at quantiles of their order, estimated by a sketch that is merged like
    any aggregate; smaller ones are one bucket. The cuts, a row for each large group, go to the rows by
    a join that adaptive execution broadcasts or splits. Rows of one order share a bucket; rows
    without an order are in the first.
    """
    named = df.withColumn("_order", order.cast("double"))
    shares = [k / most for k in range(1, most)]
    sketch = F.percentile_approx("_order", F.array(*[F.lit(x) for x in shares]), 10 * most)
    # As many of the quantiles, evenly spread, as the group has buckets to be cut into.
    parts = F.least(F.ceil(F.col("_n") / rows), F.lit(most)).cast("int")
    pick = F.transform(F.sequence(F.lit(1), F.col("_parts") - 1), lambda k: F.get("_sketch", F.floor(k * most / F.col("_parts")).cast("int") - 1))
    sizes = named.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > rows).withColumn("_parts", parts)
    large = named.join(sizes.select(*keys), keys, "left_semi").groupBy(*keys).agg(sketch.alias("_sketch"))
    cuts = sizes.join(large, keys).select(*keys, F.array_distinct(pick).alias("_cuts"))
    below = F.size(F.filter("_cuts", lambda cut: cut < F.col("_order")))
    return named.join(cuts, keys, "left").withColumn(
        name, F.when(F.col("_cuts").isNull() | F.col("_order").isNull(), F.lit(0)).otherwise(below).cast("bigint")).drop("_order", "_cuts")


def _inside(keys: list[str], order: list[Column]):
    return W.partitionBy(*keys, BUCKET).orderBy(*order)


def _before(keys: list[str]):
    return W.partitionBy(*keys).orderBy(BUCKET).rowsBetween(W.unboundedPreceding, -1)


# Without keys the summary rows themselves are one group: so many of them share a summary in turn.
WIDE = 10_000


def _offsets(sizes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, BUCKET, _offset): rows in the buckets before, of (keys, BUCKET, _size)."""
    if keys:
        return sizes.withColumn("_offset", F.coalesce(F.sum("_size").over(_before(keys)), F.lit(0))).drop("_size")
    sizes = sizes.withColumn("_wide", F.floor(F.col(BUCKET) / WIDE))
    outer = sizes.groupBy("_wide").agg(F.sum("_size").alias("_sum"))
    earlier = W.orderBy("_wide").rowsBetween(W.unboundedPreceding, -1)
    outer = outer.select("_wide", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_outer"))
    inner = W.partitionBy("_wide").orderBy(BUCKET).rowsBetween(W.unboundedPreceding, -1)
    return sizes.withColumn("_inner", F.coalesce(F.sum("_size").over(inner), F.lit(0))).join(outer, "_wide").select(
        BUCKET, (F.col("_outer") + F.col("_inner")).alias("_offset")
    )


def row_number(df: DataFrame, keys: list[str], bucket: Column, order: list[Column], name: str) -> DataFrame:
    df = df.withColumn(BUCKET, bucket)
    sizes = _offsets(df.groupBy(*keys, BUCKET).agg(F.count(F.lit(1)).alias("_size")), keys)
    return (
        df.join(sizes, [*keys, BUCKET])
        .withColumn(name, (F.col("_offset") + F.row_number().over(_inside(keys, order))).cast("int"))
        .drop(BUCKET, "_offset")
    )


def running_sum(
    df: DataFrame, keys: list[str], bucket: Column, order: list[Column], value: Column, name: str
) -> DataFrame:
    """Inclusive running sum."""
    df = df.withColumn(BUCKET, bucket).withColumn("_value", value)
    sizes = (
        df.groupBy(*keys, BUCKET)
        .agg(F.sum("_value").alias("_sum"))
        .withColumn("_offset", F.coalesce(F.sum("_sum").over(_before(keys)), F.lit(0)))
        .drop("_sum")
    )
    inner = F.sum("_value").over(_inside(keys, order).rowsBetween(W.unboundedPreceding, 0))
    return (
        df.join(sizes, [*keys, BUCKET])
        .withColumn(name, (F.col("_offset") + inner).cast("int"))
        .drop(BUCKET, "_offset", "_value")
    )


def running_max_before(
    df: DataFrame, keys: list[str], bucket: Column, order: list[Column], value: Column, name: str
) -> DataFrame:
    """Maximum of `value` over the rows strictly before this one; NULL for the first."""
    df = df.withColumn(BUCKET, bucket).withColumn("_value", value)
    carried = (
        df.groupBy(*keys, BUCKET)
        .agg(F.max("_value").alias("_top"))
        .withColumn("_carried", F.max("_top").over(_before(keys)))
        .drop("_top")
    )
    inner = F.max("_value").over(_inside(keys, order).rowsBetween(W.unboundedPreceding, -1))
    return (
        df.join(carried, [*keys, BUCKET])
        .withColumn(name, F.greatest(F.col("_carried"), inner))
        .drop(BUCKET, "_carried", "_value")
    )


def lag(
    df: DataFrame, keys: list[str], bucket: Column, order: list[Column], value: Column, name: str
) -> DataFrame:
    """`value` of the row before this one; NULL for the first. `value` must not be NULL."""
    df = df.withColumn(BUCKET, bucket).withColumn("_value", value)
    sort_key = F.struct(*[o for o in order])
    last = (
        df.groupBy(*keys, BUCKET)
        .agg(F.max_by("_value", sort_key).alias("_last"))
        .withColumn("_carried", F.lag("_last").over(W.partitionBy(*keys).orderBy(BUCKET)))
        .drop("_last")
    )
    return (
        df.join(last, [*keys, BUCKET])
        .withColumn(name, F.coalesce(F.lag("_value").over(_inside(keys, order)), F.col("_carried")))
        .drop(BUCKET, "_carried", "_value")
    )


#: Cells that keys are thrown into by hash, to see which of them can be many.
CELLS = 1 << 14


def crowded(keys: DataFrame, most: int) -> DataFrame | None:
    """Keys (without nulls) that more than `most` rows have, written; None where there are none.

    Rows are counted by cell first, a small table however many keys there are: only the rows of cells
    that hold more than `most` are counted by key.
    """
    names = keys.columns
    cell = F.pmod(F.xxhash64(*names), F.lit(CELLS)).alias("_cell")
    keys = keys.dropna()
    full = stored(keys.groupBy(cell).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > most).select("_cell"))
    if full.isEmpty():
        return None
    many = keys.withColumn("_cell", cell).join(F.broadcast(full), "_cell", "left_semi").groupBy(*names).agg(F.count(F.lit(1)).alias("_n"))
    many = stored(many.filter(F.col("_n") > most).select(*names))
    return None if many.isEmpty() else many


def _known(keys: list[str]) -> Column:
    return reduce(Column.__and__, (F.col(k).isNotNull() for k in keys))


def lag_by(
    df: DataFrame, keys: list[str], depth: Column, order: list[Column], value: Column, name: str, whole: bool = False
) -> DataFrame:
    """lag() over groups cut by_depth(); whole: no group is so large that one task could not hold it, so none is cut.
    Rows without one of the keys go."""
    if whole:
        return df.filter(_known(keys)).withColumn(name, F.lag(value).over(W.partitionBy(*keys).orderBy(*order)))
    return lag(by_depth(df, keys, depth, "_part"), keys, F.col("_part"), order, value, name)


def running_max_before_by(
    df: DataFrame, keys: list[str], depth: Column, order: list[Column], value: Column, name: str, whole: bool = False
) -> DataFrame:
    """running_max_before(), as lag_by() is lag()."""
    if whole:
        before = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
        return df.filter(_known(keys)).withColumn(name, F.max(value).over(before))
    return running_max_before(by_depth(df, keys, depth, "_part"), keys, F.col("_part"), order, value, name)


def first_k(df: DataFrame, keys: list[str], order: list[Column], k: int, name: str = "_rank") -> DataFrame:
    """The first k rows of each group. Spark limits each task's share before the shuffle."""
    return df.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(
        F.col(name) <= k
    )
