"""Projections to the report layouts, and writers."""

from uuid import uuid4

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import shared_dir


def br_day(day: Column) -> Column:
    return F.coalesce(F.date_format(day, "dd/MM/yyyy"), F.lit(""))


def decimal_comma(value: Column) -> Column:
    return F.replace(F.format_string("%.2f", F.coalesce(value, F.lit(0.0))), F.lit("."), F.lit(","))


def clean_cell(text: Column) -> Column:
    """No line ends and no separators inside a cell."""
    return F.regexp_replace(text, r"[\r\n;]+", " ")


def by_priority(df: DataFrame, first: list[str]) -> DataFrame:
    return df.select(*[c for c in first if c in df.columns], *[c for c in df.columns if c not in first])


def write_csv(df: DataFrame, path: str, by: str | None = None) -> None:
    w = df.write.mode("overwrite").option("header", True).option("sep", ";")
    (w.partitionBy(by) if by else w).csv(path)


def in_chunks(df: DataFrame, order: list, size: int = 100) -> DataFrame:
    """chunk: number of the sink call a row belongs to, over the rows in order.

    Rows are dealt by ranges of the order and numbered within each range; a range's offset is the number of rows before it, so
    nothing but one count a range is summed in one place. The dealt rows are written to the shared folder, as counts and
    rows must be of one dealing."""
    from pyspark.sql import Window as W

    spark = df.sparkSession
    path = f"{shared_dir(spark)}/chunks-{uuid4().hex}"
    # The id's upper bits are the range, the lower 33 the place in it.
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    dealt.write.parquet(path)
    dealt = spark.read.schema(dealt.schema).parquet(path).withColumn("_range", F.shiftright("_at", 33))
    counts = dealt.groupBy("_range").agg(F.count("*").alias("n"))
    before = counts.select("_range", (F.sum("n").over(W.orderBy("_range")) - F.col("n")).alias("_before"))
    place = F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1)
    return dealt.join(before, "_range").withColumn("chunk", F.floor(place / size)).drop("_at", "_range", "_before")


def send_in_chunks(df: DataFrame, order: list, send, size: int = 100, attempts: int = 5, wait_s: float = 2.0, most_s: float = 10.0) -> int:
    """Rows in order to send(list of lists), `size` at a time; a call that fails is tried again after a pause that doubles.
    The driver holds one partition at a time. Returns the number of rows sent."""
    import time

    def call(rows: list[list]) -> None:
        for i in range(attempts):
            try:
                return send(rows)
            except Exception:
                if i + 1 == attempts:
                    raise
                time.sleep(min(most_s, wait_s * 2**i))

    held, sent = [], 0
    for r in df.orderBy(*order).toLocalIterator():
        held.append(list(r))
        if len(held) == size:
            call(held)
            held, sent = [], sent + size
    if held:
        call(held)
    return sent + len(held)
