"""How many calls are in flight, and how deep queues are, from a log of begins and ends.

A sweep in two levels: changes are added up by instant, the ranges of time get the sum of all ranges before them, and
within each range a running sum goes on from there. No task orders more than the instants of one key in one range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .durable import durable

#: Seconds of a range.
RANGE = 3600.0


def levels(rows: DataFrame, key: str, begin: str = "begin", end: str = "end", seconds: float = RANGE) -> DataFrame:
    """key, at, level: the number of rows that are open from each instant ``at`` (in seconds) to the next.

    A row is open from its begin up to, but not at, its end; without an end it stays open, without a begin it never is,
    and one that ends before it begins, or at once, is none. Null keys are a key.
    """
    real = rows.select(F.col(key).alias("key"), F.col(begin).cast("double").alias("b"), F.col(end).cast("double").alias("e")).where("b is not null and (e is null or e > b)")
    opened, closed = real.select("key", F.col("b").alias("at"), F.lit(1).alias("d")), real.where("e is not null").select("key", F.col("e").alias("at"), F.lit(-1).alias("d"))
    instants = opened.unionAll(closed).groupBy("key", "at").agg(F.sum("d").alias("d")).withColumn("span", F.floor(F.col("at") / seconds))
    instants = durable(instants, "instants")
    earlier = Window.partitionBy("key").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    spans = instants.groupBy("key", "span").agg(F.sum("d").alias("d")).select("key", "span", F.coalesce(F.sum("d").over(earlier), F.lit(0)).alias("before"))
    within = Window.partitionBy("key", "span").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    running = instants.withColumn("running", F.sum("d").over(within)).alias("i")
    same = F.col("i.key").eqNullSafe(F.col("s.key")) & (F.col("i.span") == F.col("s.span"))
    return running.join(spans.alias("s"), same).select(F.col("i.key").alias(key), F.col("i.at").alias("at"), (F.col("running") + F.col("before")).alias("level"))


def gauges(rows: DataFrame, key: str, as_of: Column | float, begin: str = "begin", end: str = "end", seconds: float = RANGE) -> DataFrame:
    """key, peak, peak_at, current: the most rows of a key that were open at once, the first instant of that, and how many are
    open at ``as_of`` (a number of seconds). Keys whose rows were never open have no row."""
    of = levels(rows, key, begin, end, seconds)
    now = as_of if isinstance(as_of, Column) else F.lit(float(as_of))
    return of.groupBy(key).agg(
        F.max("level").cast("long").alias("peak"),
        F.min_by("at", F.struct(-F.col("level"), "at")).alias("peak_at"),
        F.coalesce(F.max_by(F.when(F.col("at") <= now, F.col("level")), F.when(F.col("at") <= now, F.col("at"))), F.lit(0)).cast("long").alias("current"),
    )


def gate(requests: DataFrame, key: str, as_of: Column | float) -> DataFrame:
    """A gate's gauges by ``key`` from requests (seq, queued, admitted, finished, rejected): depth of the queue and requests in
    flight, each now and at most, and the rejections by reason as ``reason=n`` in the order of reasons.

    A rejected request (with a reason) leaves the queue at ``finished`` and is never in flight.
    """
    refused = F.col("rejected").isNotNull()
    queue = gauges(requests.withColumn("left", F.when(refused, F.col("finished")).otherwise(F.col("admitted"))), key, as_of, "queued", "left")
    flight = gauges(requests.where(~refused), key, as_of, "admitted", "finished")
    counts = requests.where(refused).groupBy(key, "rejected").agg(F.count(F.lit(1)).alias("n"))
    reasons = counts.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rejected", "n"))), lambda x: F.concat_ws("=", x["rejected"], x["n"].cast("string"))), ",").alias("rejections"))
    keys = requests.select(key).distinct()
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    out = keys.alias("k")
    for frame, name in ((queue, "q"), (flight, "f"), (reasons, "r")):
        out = out.join(frame.alias(name), F.col(f"k.{key}").eqNullSafe(F.col(f"{name}.{key}")), "left")
    return out.select(f"k.{key}", zero(F.col("q.current")).alias("depth"), zero(F.col("q.peak")).alias("most_depth"), zero(F.col("f.current")).alias("in_flight"), zero(F.col("f.peak")).alias("most_in_flight"), F.coalesce("rejections", F.lit("")).alias("rejections"))
