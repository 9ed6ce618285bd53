"""Reachability within a budget of steps and a deadline."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Iterable
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom import model
from graphloom.plans.iterate import cut


class Reach(NamedTuple):
    """nodes: uid, depth; steps: how many were taken; truncated: whether a step was left undone."""

    nodes: DataFrame
    steps: int
    truncated: bool


def prefix_sums(df: DataFrame, order: str, weight: str, name: str) -> DataFrame:
    """df and the sum of weights of all rows before, in an order without ties: range partitions add up their own, and a row for each gives where it starts."""
    parts = cut(df.repartitionByRange(order).withColumn("_p", F.spark_partition_id()))
    starts = parts.groupBy("_p").agg(F.sum(weight).alias("_n")).withColumn("_start", F.sum("_n").over(W.orderBy("_p")) - F.col("_n")).select("_p", "_start")
    own = F.sum(weight).over(W.partitionBy("_p").orderBy(order).rowsBetween(W.unboundedPreceding, -1))
    return parts.join(F.broadcast(starts), "_p").withColumn(name, F.col("_start") + F.coalesce(own, F.lit(0))).select(*df.columns, name)


def bounded_reach(edges: DataFrame, seeds: DataFrame, max_depth: int, steps: int, seconds: float | None = None, relations: Iterable[str] = model.PROCESS_RELATIONS) -> Reach:
    """What a breadth-first walk reaches before its steps or its time end.

    Taking up a node is a step, and so is looking at each of its ways out (distinct, none from max_depth on). Nodes of a depth are
    taken up in the order of their uids, their ways out in the order of where they lead. A depth that fits is one join;
    in the one that does not, prefix sums of the nodes' steps tell which fit, and the one node that the budget cuts through has
    only its first ways out looked at. Nodes that are seen before the budget ends count as reached. A deadline ends the walk at
    the last depth that was done in time; its jobs are cancelled.
    """
    spark = edges.sparkSession
    sc, tag, late = spark.sparkContext, f"budget-{uuid.uuid4().hex}", threading.Event()
    ends = None if seconds is None else time.monotonic() + seconds
    timer = None

    def cancel() -> None:
        late.set()
        sc.cancelJobsWithTag(tag)

    if seconds is not None:
        timer = threading.Timer(max(seconds, 0), cancel)
        sc.addJobTag(tag)
        timer.start()
    seen, used, truncated = seeds.select("uid").distinct().withColumn("depth", F.lit(0)), 0, False
    try:
        if ends is not None and time.monotonic() >= ends:
            return Reach(seen, 0, True)
        e = cut(edges.where(F.col("rel").isin(*relations)).select("src", "dst").distinct())
        degree = e.groupBy(F.col("src").alias("uid")).agg(F.count(F.lit(1)).alias("n"))
        seen = front = cut(seen)
        for depth in range(max_depth + 1):
            if ends is not None and time.monotonic() >= ends:
                return Reach(seen, used, True)
            cost = front.select("uid").withColumn("cost", F.lit(1).cast("long"))
            if depth < max_depth:
                cost = front.select("uid").join(degree, "uid", "left").select("uid", (1 + F.coalesce("n", F.lit(0))).alias("cost"))
            total = cost.agg(F.coalesce(F.sum("cost"), F.lit(0))).first()[0]
            if not total:
                break
            left = steps - used
            truncated = total > left
            if truncated:
                if depth == max_depth:
                    return Reach(seen, steps, True)
                placed = cut(prefix_sums(cost, "uid", "cost", "before").where(F.col("before") < left))
                hop = placed.where(F.col("before") + F.col("cost") <= left).join(e, F.col("uid") == F.col("src")).select("dst")
                for r in placed.where(F.col("before") + F.col("cost") > left).collect():  # one node at most
                    hop = hop.unionByName(e.where(F.col("src") == r["uid"]).orderBy("dst").limit(left - r["before"] - 1).select("dst"))
            elif depth == max_depth:
                used += total
                break
            else:
                hop = front.join(e, F.col("uid") == F.col("src")).select("dst")
            front = cut(hop.select(F.col("dst").alias("uid")).distinct().join(seen.select("uid"), "uid", "left_anti").withColumn("depth", F.lit(depth + 1)))
            seen = cut(seen.unionByName(front))
            used = min(steps, used + total)
            if truncated:
                break
        return Reach(seen, used, truncated)
    except Exception:
        if late.is_set():
            return Reach(seen, used, True)
        raise
    finally:
        if timer is not None:
            timer.cancel()
            sc.removeJobTag(tag)
