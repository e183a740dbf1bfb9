"""Ordered log lines and metric events."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.fixed import HISTOGRAM_BOUNDS, SLOW_S, SLOW_WARNING_S

HEAD = r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}) - (\S+) - (\w+) - (.*)$"


def records(lines: DataFrame, stream: str, order: str) -> DataFrame:
    """Log records of lines (stream, order, value); lines without a head belong to the record before."""
    is_head = F.col("value").rlike(HEAD)
    w = W.partitionBy(stream).orderBy(order)
    d = lines.withColumn("rec", F.sum(is_head.cast("int")).over(w)).where("rec > 0")
    d = d.groupBy(stream, "rec").agg(F.sort_array(F.collect_list(F.struct(order, "value"))).alias("ls"))
    first = F.col("ls")[0]["value"]
    return d.select(stream, "rec", *[F.regexp_extract(first, HEAD, i).alias(n) for i, n in ((1, "ts"), (2, "module"), (3, "level"))],
                    F.concat_ws("\n", F.regexp_extract(first, HEAD, 4), F.transform(F.slice("ls", 2, 1_000_000_000), lambda x: x["value"])).alias("message"))


def carried(df: DataFrame, stream: str, order: list, value: Column, out: str) -> DataFrame:
    """The last non-null value so far."""
    return df.withColumn(out, F.last(value, True).over(W.partitionBy(stream).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)))


def sessions(df: DataFrame, stream: str, order: list, start: Column, end: Column, ts: str) -> DataFrame:
    """Closed sessions: from a start to the first end before the next start."""
    w = W.partitionBy(stream).orderBy(*order)
    d = df.withColumn("session", F.sum(start.cast("int")).over(w)).withColumn("is_end", end).where("session > 0")
    d = d.groupBy(stream, "session").agg(F.min(ts).alias("started"), F.min(F.when(F.col("is_end"), F.col(ts))).alias("ended"))
    return d.where(F.col("ended").isNotNull())


def slow(df: DataFrame, key: str, duration: str, order: Column) -> DataFrame:
    """Last duration of each key, and whether it is slow."""
    return df.groupBy(key).agg(F.max_by(duration, order).alias("last_duration")).withColumn("slow", F.col("last_duration") > SLOW_S)


def histogram(df: DataFrame, key: str, value: str) -> DataFrame:
    """Cumulative buckets, count, sum and mean per key."""
    cells = [F.count_if(F.col(value) <= b).alias("le_" + str(b).replace(".", "_")) for b in HISTOGRAM_BOUNDS]
    return df.groupBy(key).agg(*cells, F.count(value).alias("n"), F.round(F.sum(value), 4).alias("total"), F.round(F.avg(value), 4).alias("mean"))


def pace(duration: Column) -> Column:
    """How slow a batch was while it ran: SLOW beyond the limit, WARNING beyond the lower one."""
    return F.when(duration > SLOW_S, F.lit("SLOW")).when(duration > SLOW_WARNING_S, F.lit("WARNING")).otherwise(F.lit("OK"))


def levels(df: DataFrame, key: str, level: Column, ts: str, shape: str = "yyyy-MM-dd HH:mm:ss") -> DataFrame:
    """Per key: errors (of any of the three grave levels), warnings, infos, first and last time."""
    at = [F.date_format(f(ts), shape).alias(n) for f, n in ((F.min, "first"), (F.max, "last"))]
    return df.groupBy(key).agg(F.count_if(level.isin("ERROR", "CRITICAL", "FATAL")).alias("errors"), F.count_if(level == "WARNING").alias("warnings"), F.count_if(level == "INFO").alias("infos"), *at)


def counters_and_gauges(df: DataFrame, keys: list, value: str, order: Column) -> DataFrame:
    """Per key: how many events, and the value of the last one."""
    return df.groupBy(*keys).agg(F.count("*").alias("counter"), F.max_by(value, order).alias("gauge"))


def progress(df: DataFrame, phase: str, order: list) -> DataFrame:
    """i, n, percent: a row's place in its phase."""
    w = W.partitionBy(phase)
    d = df.withColumn("i", F.row_number().over(w.orderBy(*order))).withColumn("n", F.count("*").over(w))
    return d.withColumn("percent", F.round(100.0 * F.col("i") / F.col("n"), 2))
