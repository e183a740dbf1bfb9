"""Working days of São Paulo: a generated calendar, and what due dates make of it."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .fixed import CITY, FROM_EASTER, MIN_WORKING_DAYS, NATIONAL

EASTER = """make_date(y, (h + l - 7 * m + 114) div 31, (h + l - 7 * m + 114) % 31 + 1)"""


def easters(spark: SparkSession, first: int, last: int) -> DataFrame:
    """y, easter by the Gregorian computus."""
    d = spark.range(first, last + 1).select(F.col("id").cast("int").alias("y"))
    for name, e in (("a", "y % 19"), ("b", "y div 100"), ("c", "y % 100"), ("d", "b div 4"), ("e", "b % 4"), ("f", "(b + 8) div 25"), ("g", "(b - f + 1) div 3"),
                    ("h", "(19 * a + b - d - g + 15) % 30"), ("i", "c div 4"), ("k", "c % 4"), ("l", "(32 + 2 * e + 2 * i - h - k) % 7"), ("m", "(a + 11 * h + 22 * l) div 451")):
        d = d.withColumn(name, F.expr(f"CAST({e} AS INT)"))
    return d.select("y", F.expr(EASTER.replace("(h + l - 7 * m + 114) div 31", "CAST((h + l - 7 * m + 114) div 31 AS INT)")).alias("easter"))


def calendar(spark: SparkSession, first: int, last: int) -> DataFrame:
    """d, is_working_day, cum_wd (working days from the start, d included), for each day of the years."""
    years = easters(spark, first, last)
    fixed = F.array(*[F.make_date("y", F.lit(m), F.lit(d)) for m, d in NATIONAL + CITY])
    moving = F.array(*[F.date_add("easter", n) for n in FROM_EASTER])
    holidays = years.select(F.explode(F.concat(fixed, moving)).alias("d")).distinct().withColumn("holiday", F.lit(True))
    days = spark.range(1).select(F.explode(F.sequence(F.make_date(F.lit(first), F.lit(1), F.lit(1)), F.make_date(F.lit(last), F.lit(12), F.lit(31)))).alias("d"))
    days = days.join(F.broadcast(holidays), "d", "left")  # a few rows a year
    working = ~F.weekday("d").isin(5, 6) & F.col("holiday").isNull()
    return days.select("d", working.alias("is_working_day")).withColumn("cum_wd", F.sum(F.col("is_working_day").cast("int")).over(W.orderBy("d")).cast("int"))


def with_working_days(df: DataFrame, cal: DataFrame, start: str, end: str, out: str = "working_days") -> DataFrame:
    """Working days after `start` up to and with `end`; 0 unless start is before end. The calendar has 366 rows a year."""
    a, b = cal.select(F.col("d").alias(start), F.col("cum_wd").alias("_from")), cal.select(F.col("d").alias(end), F.col("cum_wd").alias("_to"))
    both = df.join(F.broadcast(a), start, "left").join(F.broadcast(b), end, "left")
    return both.withColumn(out, F.when(F.col(start) < F.col(end), F.col("_to") - F.col("_from")).otherwise(F.lit(0))).drop("_from", "_to")


def deadline_ok(working_days: Column) -> Column:
    return F.coalesce(working_days >= MIN_WORKING_DAYS, F.lit(False))


def situation(due: Column, today: Column, working_days: Column, amount: Column, number: Column) -> tuple[Column, Column]:
    """Situation of a payable, and its warnings joined by ' | '."""
    no_number, no_amount = number.isNull() | (F.trim(number) == ""), amount.isNull() | (amount == 0)
    missing = F.concat_ws(", ", F.when(no_number, F.lit("NF")), F.when(no_amount, F.lit("VALOR")))
    late, soon = due < today, (due >= today) & (working_days <= MIN_WORKING_DAYS)
    state = F.when(no_number | no_amount, F.lit("DIVERGENTE")).when(due.isNull(), F.lit("CONFERIR")).when(late, F.lit("VENCIDO")).when(soon, F.lit("VENCIMENTO_PROXIMO")).otherwise(F.lit("OK"))
    warnings = F.concat_ws(
        " | ",
        F.when(no_number | no_amount, F.concat(F.lit("[DIVERGENTE] Campos faltando: "), missing)),
        F.when(late, F.concat(F.lit("[VENCIDO] Vencimento em "), F.date_format(due, "dd/MM/yyyy"))),
        F.when(soon, F.concat(F.lit("[URGENTE] Apenas "), working_days.cast("string"), F.lit(" dias úteis até vencimento"))),
        F.when(due.isNull(), F.lit("[CONFERIR] Vencimento não informado")),
    )
    return state, warnings
