"""Exact per-group figures that hold when one group has a large part of all rows.

None of them brings a group into one task: a group is first counted in fixed pieces, and only the pieces' counts are
put in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Steps of the logarithm in which values are counted first: neighbours differ by 0.02 %.
LOG_STEPS = 4096


def grouped_median(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, n, median): the exact median, between the two middle values of an even number, of positive values.

    Counts by (key, logarithmic step) find the steps that hold the middle ranks; only values of these steps are ordered.
    Null keys and values that are null, not positive or not finite are left out; a key without values has no row.
    """
    rows = df.where(f"`{key}` is not null and `{value}` > 0 and `{value}` < double('inf')").select(
        F.col(key), F.col(value).cast("double").alias("_v")
    )
    rows = rows.withColumn("_b", F.floor(F.ln("_v") * LOG_STEPS))
    order = Window.partitionBy(key).orderBy("_b")
    steps = rows.groupBy(key, "_b").agg(F.count("*").alias("_c"))
    steps = steps.select(
        key, "_b", "_c", F.sum("_c").over(order).alias("_to"), F.sum("_c").over(Window.partitionBy(key)).alias("n")
    )
    lo, hi = F.expr("(n + 1) div 2"), F.expr("n div 2 + 1")  # ranks of the middle values, from 1
    held = steps.where((F.col("_to") >= lo) & (F.col("_to") - F.col("_c") < hi)).withColumn(
        "_from", F.col("_to") - F.col("_c")
    )
    values = rows.join(held.select(key, "_b", "_from", "n"), [key, "_b"]).groupBy(key, "_b", "_from", "n", "_v").count()
    inside = Window.partitionBy(key, "_b").orderBy("_v")
    values = values.withColumn("_last", F.col("_from") + F.sum("count").over(inside))
    first = F.col("_last") - F.col("count")
    both = lambda rank: F.max(F.when((rank > first) & (rank <= F.col("_last")), F.col("_v")))
    return values.groupBy(key, "n").agg(((both(lo) + both(hi)) / 2).alias("median"))


def positions(df: DataFrame, group: list[str], bucket: Column, order: list[Column], name: str = "position", weight: Column | None = None) -> DataFrame:
    """Adds the rank from 1 of each row in its group (or the running sum of ``weight``), in order of (bucket, order).

    ``bucket`` cuts a group into pieces that fit a task and whose numbers follow the order; the pieces' totals are summed
    up by themselves, so no task sees a whole group. Columns ``_bucket`` and ``_before`` must not exist.
    """
    weight = F.lit(1) if weight is None else weight
    rows = df.withColumn("_bucket", bucket)
    totals = rows.groupBy(*group, "_bucket").agg(F.sum(weight).alias("_total"))
    earlier = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*group, "_bucket", F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_before"))
    inner = Window.partitionBy(*group, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    keys = [*group, "_bucket"]
    return rows.withColumn("_inner", F.sum(weight).over(inner)).join(totals, keys).withColumn(name, F.col("_before") + F.col("_inner")).drop("_bucket", "_before", "_inner")


def ranked_values(df: DataFrame, keys: list[str], value: str, ranks: dict[str, str]) -> DataFrame:
    """(keys, n, one column per entry of ``ranks``): the values at exact ranks of each group.

    ``ranks`` maps a name to an SQL expression of n that gives a rank from 1. Like the median, only values in the
    logarithmic steps that hold a wanted rank are ordered. Null and NaN values are left out.
    """
    rows = df.where(f"`{value}` is not null and not isnan(cast(`{value}` as double))").select(*keys, F.col(value).cast("double").alias("_v"))
    size = F.when(F.abs("_v") > 1e-300, F.floor(F.ln(F.least(F.abs("_v"), F.lit(1e300))) * LOG_STEPS) + 3_000_000).otherwise(0)
    rows = rows.withColumn("_b", F.when(F.col("_v") < 0, -size).otherwise(size))
    whole = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    steps = rows.groupBy(*keys, "_b").agg(F.count("*").alias("_c"))
    steps = steps.withColumns({"_to": F.sum("_c").over(whole.orderBy("_b")), "n": F.sum("_c").over(whole)})
    steps = steps.withColumn("_from", F.col("_to") - F.col("_c"))
    inside = lambda rank: (F.expr(rank) > F.col("_from")) & (F.expr(rank) <= F.col("_to"))
    wanted = F.lit(False)
    for rank in ranks.values():
        wanted = wanted | inside(rank)
    held = steps.where(wanted).select(*keys, "_b", "_from", "n")
    values = rows.join(held, [*keys, "_b"]).groupBy(*keys, "_b", "_from", "n", "_v").count()
    order = Window.partitionBy(*keys, "_b").orderBy("_v")
    values = values.withColumn("_to", F.col("_from") + F.sum("count").over(order)).withColumn("_from", F.col("_to") - F.col("count"))
    return values.groupBy(*keys, "n").agg(*[F.max(F.when(inside(rank), F.col("_v"))).alias(name) for name, rank in ranks.items()])


def _sorted_pieces(df: DataFrame, order: list[Column], weight: Column) -> DataFrame:
    """Rows range-partitioned and sorted by ``order``, written once, with their piece (_part), their place in it (_at) and
    the weight of all pieces before (_start)."""
    from pyspark.sql import types as T

    from corpusloom.session import settle

    placed = settle(df.orderBy(*order).withColumn("_m", F.monotonically_increasing_id()), "ranked")
    placed = placed.withColumns({"_part": F.shiftright("_m", 33), "_at": F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))}).drop("_m")
    sizes = {r["_part"]: r["n"] for r in placed.groupBy("_part").agg(F.sum(weight).alias("n")).collect()}  # a row a partition
    starts, at = [], 0
    for part in sorted(sizes):
        starts.append((part, at))
        at += sizes[part]
    kinds = T.StructType([T.StructField("_part", T.LongType()), T.StructField("_start", T.LongType())])
    return placed.join(F.broadcast(df.sparkSession.createDataFrame(starts, kinds)), "_part")


def global_rank(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """Adds the rank from 1 in ``order``, which must be total, by a range-partitioned sort.

    The sorted rows are written once with their places; only one count per partition is then summed up.
    """
    placed = _sorted_pieces(df, order, F.lit(1))
    return placed.withColumn(name, F.col("_start") + F.col("_at") + 1).drop("_part", "_at", "_start")


def global_sum(df: DataFrame, order: list[Column], weight: Column, name: str) -> DataFrame:
    """Adds the running sum of ``weight`` (whole numbers) in ``order``, which must be total, by a range-partitioned sort.

    A value that many rows have is cut where its rows differ in what else ``order`` names.
    """
    placed = _sorted_pieces(df, order, weight)
    inner = F.sum(weight).over(Window.partitionBy("_part").orderBy("_at"))
    return placed.withColumn(name, F.col("_start") + inner).drop("_part", "_at", "_start")
