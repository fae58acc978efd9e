"""Directly-follows relation and start/end activities, of variants or straight from the events.

The event-level forms never gather a case: a case may be spread over any number of
tasks, so one that holds a large share of the log costs no more than others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracecast.storage import materialize


def following_pairs(acts: str = "acts") -> Column:
    pairs = F.transform(
        F.slice(acts, 2, F.size(acts)),
        lambda b, i: F.struct(F.get(acts, i).alias("a"), b.alias("b")),
    )
    return F.when(F.size(acts) >= 2, pairs).otherwise(F.filter(pairs, lambda p: F.lit(False)))


def directly_follows(variant_rows: DataFrame, *keys: str) -> DataFrame:
    """``(a, b, cnt)``: how often ``b`` comes right after ``a``, over all traces."""
    return (
        variant_rows.select(*keys, "n_traces", F.explode(following_pairs()).alias("p"))
        .groupBy(*keys, F.col("p.a").alias("a"), F.col("p.b").alias("b"))
        .agg(F.sum("n_traces").alias("cnt"))
    )


def start_end_activities(variant_rows: DataFrame, *keys: str) -> DataFrame:
    """``(activity, n_start, n_end)``."""
    ends = F.array(
        F.struct(F.get("acts", F.lit(0)).alias("activity"), F.lit(1).alias("s"), F.lit(0).alias("e")),
        F.struct(F.try_element_at("acts", F.lit(-1)).alias("activity"), F.lit(0).alias("s"), F.lit(1).alias("e")),
    )
    return (
        variant_rows.where(F.size("acts") > 0)
        .select(*keys, "n_traces", F.explode(ends).alias("x"))
        .groupBy(*keys, F.col("x.activity").alias("activity"))
        .agg(F.sum(F.col("x.s") * F.col("n_traces")).alias("n_start"), F.sum(F.col("x.e") * F.col("n_traces")).alias("n_end"))
    )


def directly_follows_of_events(log: DataFrame) -> DataFrame:
    """``(a, b, cnt)`` of a ``(case_id, activity, ord)`` log.

    Events are range-partitioned by case and order and counted range by range; pairs
    across two ranges come from the ranges' ends, two events per partition.
    """
    parts = int(log.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["case_id", "ord", "activity"]
    ranges = log.select(*order).repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id())
    # Written once: all uses below must see the same ranges.
    ranges = materialize(ranges, "ranges")
    within = Window.partitionBy("part").orderBy(*order)
    before = ranges.select("case_id", "activity", F.lag(F.struct("case_id", "activity")).over(within).alias("before"))
    inside = before.where("before.case_id = case_id").groupBy(F.col("before.activity").alias("a"), F.col("activity").alias("b")).agg(F.count("*").alias("cnt"))
    at = F.struct(*order)
    ends = ranges.groupBy("part").agg(F.min(at).alias("first"), F.max(at).alias("last"))
    seam = ends.select("first", F.lag("last").over(Window.orderBy("part")).alias("last"))  # one row per range
    across = seam.where("last.case_id = first.case_id").select(F.col("last.activity").alias("a"), F.col("first.activity").alias("b"), F.lit(1).cast("bigint").alias("cnt"))
    return inside.unionByName(across).groupBy("a", "b").agg(F.sum("cnt").alias("cnt"))


def start_end_of_events(log: DataFrame) -> DataFrame:
    """``(activity, n_start, n_end)`` of a ``(case_id, activity, ord)`` log, by partial aggregation per case."""
    at = F.struct("ord", "activity")
    ends = log.groupBy("case_id").agg(F.min(at)["activity"].alias("s"), F.max(at)["activity"].alias("e"))
    both = F.array(
        F.struct(F.col("s").alias("activity"), F.lit(1).alias("start"), F.lit(0).alias("end")),
        F.struct(F.col("e").alias("activity"), F.lit(0).alias("start"), F.lit(1).alias("end")),
    )
    return ends.select(F.explode(both).alias("x")).groupBy("x.activity").agg(
        F.sum("x.start").alias("n_start"), F.sum("x.end").alias("n_end")
    )
