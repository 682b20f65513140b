"""Exact ranks and percentiles whose work is split even when one group is huge.

Groups up to ``hot_rows`` go through the plain window. Larger groups are cut into ranges, as many as
their rows ask for, at boundaries taken from a hash sample of the group; every range is ordered on
its own task and shifted by the size of the ranges below it. The sample depends only on the
data, so a recomputed task finds the same boundaries, and the result is exact for any choice
of boundaries.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOT_ROWS = 2_000_000
# Rows that a range should hold, and sampled rows that place each boundary.
RANGE_ROWS = 1_000_000
SAMPLES_PER_RANGE = 32
# Tables of one row for a hot group are broadcast up to this many groups; beyond it the joins are
# left to adaptive execution, which splits skewed keys.
BROADCAST_GROUPS = 2_000


def match_keys(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Join on keys where NULL equals NULL; keeps the left key columns."""
    extra = [c for c in right.columns if c not in keys]
    renamed = right.select(*[F.col(k).alias(f"__r_{k}") for k in keys], *extra)
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys])
    return left.join(renamed, on, how).select(*left.columns, *extra)


def _per_group(table: DataFrame, groups: int) -> DataFrame:
    """A table with few rows per hot group, broadcast when the groups were counted as few."""
    return F.broadcast(table) if groups <= BROADCAST_GROUPS else table


def _ranges(
    df: DataFrame, keys: list[str], order: Column, sizes: DataFrame, groups: int
) -> DataFrame:
    """Add __range, the index of the value range of each row inside its group."""
    ranges = F.greatest(F.lit(2), F.ceil(F.col("__n") / F.lit(float(RANGE_ROWS))).cast("int"))
    ranged = sizes.withColumn("__k", ranges)
    sized = match_keys(df.withColumn("__o", order), _per_group(ranged, groups), keys, "inner")
    chosen = (F.pmod(F.xxhash64("__o"), F.lit(1 << 30)) / F.lit(float(1 << 30))) < (
        SAMPLES_PER_RANGE * F.col("__k") / F.col("__n")
    )
    k, chunk = F.col("__k"), F.ceil(F.sqrt(F.col("__k"))).cast("int")
    edges = (
        sized.where(chosen)
        .groupBy(*keys)
        .agg(F.array_sort(F.collect_list("__o")).alias("__s"), F.max("__k").alias("__k"))
        .withColumn(
            "__e",
            F.transform(
                F.sequence(F.lit(1), k - 1),
                lambda i: F.try_element_at(F.col("__s"), F.ceil(i * F.size("__s") / k).cast("int")),
            ),
        )
        # Boundaries in chunks of the square root of their number, so that a row looks at two short lists.
        .withColumn("__chunk", chunk)
        .select(
            *keys,
            "__chunk",
            F.transform(
                F.sequence(F.lit(0), F.ceil((k - 1) / F.col("__chunk")).cast("int") - 1),
                lambda j: F.slice(F.col("__e"), j * F.col("__chunk") + 1, F.col("__chunk")),
            ).alias("__parts"),
        )
    )
    placed = match_keys(sized.drop("__k"), edges if groups > 1 else F.broadcast(edges), keys, "left")
    passed = F.size(F.filter(F.col("__parts"), lambda p: F.element_at(p, -1) < F.col("__o")))
    placed = placed.withColumn("__passed", passed)
    inside = F.filter(F.get(F.col("__parts"), F.col("__passed")), lambda e: e < F.col("__o"))
    index = F.col("__passed") * F.col("__chunk") + F.coalesce(F.array_size(inside), F.lit(0))
    return placed.withColumn("__range", F.when(F.col("__parts").isNull(), 0).otherwise(index)).drop(
        "__parts", "__passed", "__chunk", "__n"
    )


def _running(
    df: DataFrame,
    keys: list[str],
    order: Column,
    sizes: DataFrame,
    groups: int,
    weight: str | None = None,
) -> DataFrame:
    """Add __upto, the total weight of the group up to and including the row."""
    w = F.lit(1).cast("long") if weight is None else F.col(weight).cast("long")
    placed = _ranges(df, keys, order, sizes, groups).withColumn("__w", w)
    below = Window.partitionBy(*keys).orderBy("__range")
    offsets = (
        placed.groupBy(*keys, "__range")
        .agg(F.sum("__w").alias("__rows"))
        .withColumn("__below", F.sum("__rows").over(below) - F.col("__rows"))
        .drop("__rows")
    )
    shifted = match_keys(placed, _per_group(offsets, groups), [*keys, "__range"], "inner")
    inside = Window.partitionBy(*keys, "__range").orderBy("__o")
    running = F.sum("__w").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    return shifted.withColumn("__upto", F.col("__below") + running)


def with_rank(
    df: DataFrame,
    keys: list[str],
    order: list[Column],
    name: str = "row_rank",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """1-based position of each row in its group; ``order`` ascends and ends in a unique key.

    Without keys the whole table is one group and always takes the range path.
    """
    packed = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])
    columns = df.columns
    if not keys:
        one = df.withColumn("__all", F.lit(0))
        sizes = one.groupBy("__all").agg(F.count(F.lit(1)).alias("__n"))
        ranked = _running(one, ["__all"], packed, sizes, 1)
        return ranked.select(*columns, F.col("__upto").alias(name))

    plain_rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long")
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > hot_rows)
    groups = sizes.count()
    if groups == 0:
        return df.withColumn(name, plain_rank)
    flag = _per_group(sizes.select(*keys, F.lit(True).alias("__hot")), groups)
    flagged = match_keys(df, flag, keys, "left")
    plain = flagged.where(F.col("__hot").isNull()).select(*columns, plain_rank.alias(name))
    hot = flagged.where(F.col("__hot")).select(*columns)
    ranked = _running(hot, keys, packed, sizes, groups)
    return plain.unionByName(ranked.select(*columns, F.col("__upto").alias(name)))


def group_percentiles(
    df: DataFrame,
    keys: list[str],
    value: str,
    probabilities: dict[str, float],
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Exact linear-interpolation percentiles per group, one DOUBLE column per name.

    Whatever a group's size, each percentile is made of the same two order statistics by the same
    arithmetic: lo + (position - floor(position)) * (hi - lo). Only the running count that finds
    them is split for hot groups.
    """
    # Equal values are one weighted row, so a value shared by many rows cannot pile up.
    distinct = (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).alias("__v"))
        .agg(F.count(F.lit(1)).alias("__w"))
    )
    sizes = distinct.groupBy(*keys).agg(
        F.sum("__w").alias("__n"), F.count(F.lit(1)).alias("__values")
    )
    hot = sizes.where(F.col("__values") > hot_rows).drop("__values")
    groups = hot.count()
    cold = distinct
    if groups:
        flagged = match_keys(distinct, _per_group(hot.withColumnRenamed("__n", "__hot"), groups), keys, "left")
        cold = flagged.where(F.col("__hot").isNull()).drop("__hot")
    order = Window.partitionBy(*keys).orderBy("__v")
    counted = cold.withColumns({
        "__upto": F.sum("__w").over(order.rowsBetween(Window.unboundedPreceding, 0)),
        "__n": F.sum("__w").over(Window.partitionBy(*keys)),
    }).select(*keys, "__v", "__w", "__upto", "__n")
    if groups:
        of_hot = flagged.where(F.col("__hot").isNotNull()).drop("__hot").withColumnRenamed("__w", "__c")
        split = match_keys(_running(of_hot, keys, F.struct("__v"), hot, groups, "__c"), hot, keys, "inner")
        counted = counted.unionByName(split.select(*keys, "__v", "__w", "__upto", "__n"))
    first = F.col("__upto") - F.col("__w")
    parts, columns = [], []
    for i, (name, p) in enumerate(probabilities.items()):
        position = F.lit(p) * (F.col("__n") - 1)
        for side, target in (("lo", F.floor(position)), ("hi", F.ceil(position))):
            held = (first <= target) & (target < F.col("__upto"))
            parts.append(F.max(F.when(held, F.col("__v"))).alias(f"__{side}{i}"))
        low, high = F.col(f"__lo{i}"), F.col(f"__hi{i}")
        columns.append((low + (position - F.floor(position)) * (high - low)).alias(name))
    return counted.groupBy(*keys, "__n").agg(*parts).select(*keys, *columns)
